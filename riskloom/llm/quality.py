"""Quality: histogram gradient-boosted trees over document statistics.

Trees grow level by level on binned features; scoring walks all trees of all documents at once through flat arrays. The features are
statistics of the whole text, whatever its length, made on the executors; only these numbers reach the driver, for at most SAMPLE labelled
documents. Null counts as empty, and empty texts get the score of their statistics. Of splits that gain the same, the first feature and the
lowest limit is taken; values that tie go the same way. Without labels of both kinds, the score is the share of label 1 (or 0.5). An empty
table gives an empty result. Extra columns are never read, whatever their names and types; rows that repeat score alike.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_batches, text_of

FOLDS, HELD_OUT = 5, 0
#: Labelled documents of each class to learn from, at most.
SAMPLE = {0: 3000, 1: 5000}
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAF = 80, 4, 64, 0.15, 5
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".!?", "pause": b",;:", "bar": b"|", "money": b"#$%&*@~^", "bracket": b"()[]{}<>", "line": b"\n", "space": b" \t", "quote": b"\"'`", "math": b"=+/\\_-"}
NAMES = ["chars", "words", "word_length", "longest_word", "short_words", "distinct_words", "commonest_word", "lines", "line_length", "distinct_lines", "short_lines", "ended_lines", "beyond_ascii", "odd_words", *_CLASSES]
_MASK = np.zeros((256, len(_CLASSES)))
for _k, _s in enumerate(_CLASSES.values()):
    _MASK[list(_s), _k] = 1


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    nw, nl = max(1, len(words)), len(lines)
    distinct = Counter(words)
    common = max(distinct.values(), default=0)
    ended = sum(x.rstrip()[-1:] in (".", "!", "?") for x in lines)
    odd = sum(w[-3:] == w[-1:] * 3 for w in distinct)
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(lengths.mean()) if len(words) else 0.0, float(lengths.max()) if len(words) else 0.0,
        float((lengths <= 3).sum()) / nw, len(distinct) / nw, common / nw, float(np.log1p(nl)), len(text) / nl, len(set(lines)) / nl, sum(len(x) < 20 for x in lines) / nl, ended / nl,
        float(counts[128:].sum()) / max(1, n), odd / max(1, len(distinct)), *(counts @ _MASK / max(1, n)).tolist(),
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


class Model:
    """Trees as arrays: of each node its feature, the value up to which rows go left, its left child (right: the next), its value."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, child: np.ndarray, value: np.ndarray, roots: np.ndarray):
        self.base, self.feature, self.limit, self.child, self.value, self.roots = base, feature, limit, child, value, roots

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            # Leaves are their own left child, with a limit that no value exceeds.
            at = self.child[at] + (x[rows, self.feature[at]] > self.limit[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(1) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, d), int)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    f, nodes, roots = np.full(n, base), [], []
    for _ in range(TREES if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        nodes.append(None)
        level = [(roots[-1], np.arange(n))]
        for depth in range(DEPTH + 1):
            following = []
            for me, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                leaf = -RATE * gs / (hs + 1.0)
                best = (1e-6, None, None)
                if depth < DEPTH and len(rows) >= 2 * LEAF:
                    flat = (binned[rows] + np.arange(d) * BINS).ravel()
                    hist = [np.bincount(flat, np.repeat(v[rows], d) if v is not None else None, d * BINS).reshape(d, BINS).cumsum(1) for v in (g, h, None)]
                    gl, hl, nl = hist
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = -1
                    for j in range(d):
                        gain[j, len(cuts[j]) :] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    best = (gain[j, b], j, b) if gain[j, b] > best[0] else best
                if best[1] is None:
                    nodes[me] = (0, np.inf, me, leaf)
                    f[rows] += leaf
                else:
                    _, j, b = best
                    nodes[me] = (j, cuts[j][b], len(nodes), 0.0)
                    left = binned[rows, j] <= b
                    following += [(len(nodes), rows[left]), (len(nodes) + 1, rows[~left])]
                    nodes += [None, None]
            level = following
    feature, limit, child, value = (np.array([r[k] for r in nodes]) for k in range(4)) if nodes else (np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0))
    return Model(base, feature, limit, child, value, np.array(roots, int))


_STATS = ", ".join(f"x_{n} double" for n in NAMES)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE).select("doc_id", "text", "label")

    def make():
        def f(c):
            x = matrix(c["text"])
            return {"doc_id": c["doc_id"], "label": c["label"], **{f"x_{n}": x[:, j].tolist() for j, n in enumerate(NAMES)}}

        return f

    got = sorted(tuple(r) for r in map_batches(rows, make, f"doc_id bigint, label int, {_STATS}").collect())
    a = np.array(got, np.float64).reshape(len(got), 2 + len(NAMES))
    return train(a[:, 2:], a[:, 1])


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)

    def make():
        def f(c):
            return {"doc_id": c["doc_id"], "score": model.score(matrix(c["text"])).tolist()}

        return f

    out = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), make, "doc_id bigint, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

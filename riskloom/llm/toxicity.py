"""Toxicity: a support vector machine with a subsequence string kernel, by Nyström landmarks.

Kernel: a text's features are its subsequences of three symbols within SPAN symbols, each weighted by DECAY for every symbol that
it skips. So an insult with signs or letters put in between keeps most of its features, at less weight. The machine works on windows
of WINDOW starts, slid over the whole text; a document's score is a logistic function of its TOP highest
windows that don't overlap, and its length, fitted last.

Training (on the driver, from a bounded sample of labelled documents): sentences of clean documents are negative; the sentences of
toxic documents that hold what is most typical of toxic documents are positive. Landmarks are windows of both kinds. Windows of clean
documents that score highest are added as negatives, and toxic documents' own highest windows as positives, for ROUNDS rounds. The
machine is linear in the kernel's features, so its weights fold into one table of 64**3 numbers: the whole model, 1 MB.

Null, empty and very short texts have no window and the lowest score. Texts of any length are scanned in full, in stretches that overlap by
a window; only the bounded sample to learn from has passages of texts above 65,536 characters. Of windows that tie, the first is taken.
Without labels of both kinds every score is 0; an empty table gives an empty result. Extra columns are never read, whatever their names and
types; rows that repeat score alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import BITS, SYMBOLS, symbols
from .common import fold, labelled_sample, passages, text_of
from .nystrom import logistic_fit, whitener
from .sampling import slices

SPAN, WINDOW, DECAY = 6, 9, 0.8
#: Labelled documents of each class to learn from, at most.
SAMPLE = {1: 1500, 0: 2500}
LANDMARKS, ROUNDS, PER_ROUND = 700, 3, 1200
#: The cost of a window on the wrong side.
COST = 10.0
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Windows of a document that its score reads.
TOP = 4
#: The log ratio from which a word is typical of toxic documents.
TYPICAL = 1.6
#: Symbols scanned at once.
STRETCH = 1 << 18
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_PAD = WINDOW + SPAN


def start_scores(codes: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """For each symbol, the weighted sum of the model's weights over the subsequences that start there."""
    n = len(codes)
    c = np.concatenate([codes, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    high, mid = c[:n] << (2 * BITS), c << BITS
    total = np.zeros(n, np.float32)
    for b in range(2, SPAN):
        last, part = high + c[b : b + n], np.zeros(n, np.float32)
        for a in range(1, b):
            part += beta.take(last + mid[a : a + n])
        total += part * np.float32(DECAY ** (b - 2))
    return total


def window_scores(codes: np.ndarray, beta: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(start_scores(codes, beta), dtype=np.float64)])
    n = len(codes)
    return run[np.minimum(np.arange(n) + WINDOW, n)] - run[:n]


def between_single_letters(codes: np.ndarray) -> np.ndarray:
    """Where a sign or space stands between two letters that each stand alone, as in a word spelled out: those are left out of the scan."""
    c = np.concatenate([np.zeros(2, np.uint8), codes, np.zeros(2, np.uint8)])
    sign = (c == 0) | (c > 58)
    letter = ~sign & (c < 58)
    return sign[2:-2] & letter[1:-3] & letter[3:-1] & sign[:-4] & sign[4:]


def highest(texts: list[str], beta: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Of each text, its TOP highest scores of windows that don't overlap (-inf where there are fewer), and where the highest starts (-1: nowhere)."""
    best, where = np.full((len(texts), TOP), -np.inf), [-1] * len(texts)
    held: list[tuple[int, int, np.ndarray]] = []
    moved: dict[int, np.ndarray] = {}
    size = 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        pad = np.zeros(_PAD, np.uint8)
        # A separator stands before each stretch, so that a word at its start looks as it does elsewhere.
        scores = window_scores(np.concatenate([x for _, _, c in held for x in (pad[:1], c, pad)]), beta)
        at = 0
        for i, begin, c in held:
            own = scores[at : at + len(c) + 1]
            tops = np.full(TOP, -np.inf)
            for t in range(TOP):
                k = int(own.argmax())
                if own[k] == -np.inf:
                    break
                tops[t] = own[k]
                if t == 0 and own[k] > best[i, 0]:
                    where[i] = max(begin + k - 1, 0)
                own[max(0, k - WINDOW + 1) : k + WINDOW] = -np.inf
            best[i] = np.sort(np.concatenate([best[i], tops]))[::-1][:TOP]
            at += 1 + len(c) + _PAD
        held, size = [], 0

    for i, t in enumerate(texts):
        c = symbols(t)
        gone = between_single_letters(c)
        if gone.any():
            moved[i] = np.flatnonzero(~gone)
            c = c[~gone]
        for begin in range(0, len(c), STRETCH):
            part = c[begin : begin + STRETCH + _PAD]
            held.append((i, begin, part))
            size += len(part) + _PAD + 1
            if size > STRETCH:
                flush()
    flush()
    for i, places in moved.items():
        where[i] = int(places[min(where[i], len(places) - 1)]) if where[i] >= 0 else -1
    return best, where


def document_features(best: np.ndarray, texts: list[str], low: float) -> np.ndarray:
    """What the logistic curve reads: the highest scores (low where a text has fewer windows) and the logarithm of the length."""
    return np.concatenate([np.where(np.isfinite(best), best, low), np.log1p([[len(t)] for t in texts])], 1)


#: The weight of each of a start's subsequences, for all starts of a window.
WEIGHTS = np.tile(np.array([DECAY ** (b - 2) for _, b in _PAIRS], np.float32), WINDOW)


def features(windows: list[np.ndarray]) -> np.ndarray:
    """The explicit features of windows of WINDOW + SPAN - 1 symbols, a row for each: numbers of subsequences (some repeat), weighted by WEIGHTS."""
    w = np.zeros((len(windows), _PAD - 1), np.int32)
    for i, x in enumerate(windows):
        w[i, : len(x)] = x
    return np.stack([(w[:, i] << (2 * BITS)) | (w[:, i + a] << BITS) | w[:, i + b] for i in range(WINDOW) for a, b in _PAIRS], 1)


def kernel(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel values of windows with landmarks (features of both), in blocks: a few MB at a time."""
    out, table = np.zeros((len(x), len(marks)), np.float32), np.zeros(SYMBOLS**3, np.int32)
    for j in range(0, len(marks), 64):
        part = marks[j : j + 64]
        names = np.unique(part)
        table[:] = 0
        table[names] = np.arange(1, len(names) + 1)
        g = np.zeros((len(names) + 1, len(part)), np.float32)
        np.add.at(g, (table[part], np.arange(len(part))[:, None]), WEIGHTS)
        for i in range(0, len(x), 256):
            out[i : i + 256, j : j + 64] = np.einsum("p,ipj->ij", WEIGHTS, g[table[x[i : i + 256]]])
    return out


def cut(text: str, start: int) -> np.ndarray:
    """The window at start - 1 (the separator before a word), or one with a separator of its own before it."""
    c = symbols(text[max(start, 0) : start + _PAD])
    return np.concatenate([np.zeros(1, np.uint8), c])[: _PAD - 1]


def spread(window: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The window with signs put between its letters, as those do who mask an insult."""
    sign = rng.choice([0, 59, 60, 61, 62, 63])
    every = rng.integers(1, 3)
    out: list[int] = []
    for k, x in enumerate(window.tolist()):
        out.append(x)
        if x and k % every == 0 and k + 1 < len(window) and window[k + 1]:
            out.append(int(sign))
    return np.array(out[: _PAD - 1], np.uint8)


def sentences(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in re.finditer(r"[^.!?\n]+", text)]


def typical(toxic: list[str], clean: list[str]) -> dict[str, float]:
    """Log ratios of how often words, and their first four and five letters, stand in toxic documents and in clean ones (in a document at most 8 times)."""

    def parts(t: str) -> Counter:
        words = Counter(re.findall(r"[^\W\d_]+", t.lower()))
        out = Counter(words)
        for w, n in words.items():
            for k in (4, 5):
                if len(w) > k:
                    out[w[:k] + "~"] += n
        return out

    a, b, docs = Counter(), Counter(), Counter()
    for side, texts in ((a, toxic), (b, clean)):
        for t in texts:
            got = parts(t)
            side.update({w: min(n, 8) for w, n in got.items()})
            if side is a:
                docs.update(got.keys())
    return {w: np.log((n + 0.1) / (len(toxic) + 1)) - np.log((b[w] + 0.5) / (len(clean) + 1)) for w, n in a.items() if docs[w] >= 3}


def _word_score(word: str, odds: dict[str, float]) -> float:
    return max(odds.get(word, -9.0), odds.get(word[:4] + "~", -9.0), odds.get(word[:5] + "~", -9.0))


def svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = 15, seed: int = 7) -> np.ndarray:
    """Linear SVM with hinge loss, by dual coordinate descent. y is 1 or -1; the bias is a feature of its own."""
    rng, alpha, w = np.random.default_rng(seed), np.zeros(len(x)), np.zeros(x.shape[1])
    q = np.maximum(np.einsum("ij,ij->i", x, x), 1e-12)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    def __init__(self, beta: np.ndarray, weights: np.ndarray, shift: float, low: float):
        self.beta, self.weights, self.shift, self.low = beta, weights, shift, low

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        best = highest(texts, self.beta)[0]
        z = document_features(best, texts, self.low) @ self.weights + self.shift
        return 1 / (1 + np.exp(-np.clip(np.where(np.isfinite(best[:, 0]), z, -30.0), -30, 30)))


def _fit_windows(pos: list[np.ndarray], neg: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """The table of weights that an SVM on Nyström features of these windows folds into."""
    distinct = lambda xs: list({x.tobytes(): x for x in xs}.values())
    p, n = distinct(pos), distinct(neg)
    half = LANDMARKS // 2
    marks = features([p[i] for i in rng.permutation(len(p))[:half]] + [n[i] for i in rng.permutation(len(n))[:half]])
    own = kernel(marks, marks)
    # Landmarks' kernel values with themselves are 1 on the mean.
    scale = 1 / own.diagonal().mean()
    white = whitener(own.astype(np.float64) * scale) * scale
    x = features(pos + neg)
    z = np.ones((len(x), white.shape[1] + 1), np.float32)
    for i in range(0, len(x), 1024):
        z[i : i + 1024, :-1] = kernel(x[i : i + 1024], marks) @ white
    w = svm(z, np.concatenate([np.ones(len(pos)), -np.ones(len(neg))]))
    beta = np.zeros(SYMBOLS**3)
    np.add.at(beta, marks, (white @ w[:-1])[:, None] * WEIGHTS)
    return beta.astype(np.float32)


def train(rows: list[tuple[str, int]], seed: int = 5) -> Model | None:
    """A model from (text, toxic) rows; None if one of the labels is missing."""
    toxic, clean = [t for t, y in rows if y and t], [t for t, y in rows if not y and t]
    if not toxic or not clean:
        return None
    rng, odds = np.random.default_rng(seed), typical(toxic, clean)
    pos: list[np.ndarray] = []
    for t in toxic:
        found = [(_word_score(m[0].lower(), odds), s + m.start()) for s, x in sentences(t) for m in re.finditer(r"[^\W\d_]+", x)]
        top = max(found, default=(0, 0))[0]
        pos += [cut(t, at) for v, at in found if v >= max(TYPICAL, top - 1.5)][:4]
    neg: list[np.ndarray] = []
    for t in clean:
        starts = [s + m.start() for s, x in sentences(t) for m in re.finditer(r"\S+", x)]
        neg += [cut(t, starts[i]) for i in rng.integers(0, len(starts), min(2, len(starts)))] if starts else []
    if not pos:
        pos = [cut(t, highest([t], np.ones(SYMBOLS**3, np.float32))[1][0]) for t in toxic]
    # Masked forms are made from half of the positives and kept out of the clean windows' way by as many masked negatives.
    rng.shuffle(pos)
    pos = pos[:PER_ROUND]
    extra_pos = [spread(x, rng) for x in pos[::2]]
    extra_neg = [spread(x, rng) for x in neg[::9]]
    neg = neg[: 2 * PER_ROUND]
    beta = _fit_windows(pos + extra_pos, neg + extra_neg, rng)
    for _ in range(ROUNDS):
        best, where = highest(clean, beta)
        # A clean document may hold one word that is typical of toxic ones: such windows are no negatives, and the document's score weighs how many there are.
        at = [(i, where[i]) for i in np.argsort(-best[:, 0]).tolist() if where[i] >= 0]
        words = [(i, w, re.search(r"[^\W\d_]+", clean[i][w : w + 30])) for i, w in at[: 2 * PER_ROUND]]
        hard = [cut(clean[i], w + 1 if w else 0) for i, w, m in words if not m or _word_score(m[0].lower(), odds) < TYPICAL][:PER_ROUND]
        neg = (hard + neg)[: 3 * PER_ROUND]
        beta = _fit_windows(pos + extra_pos, neg + extra_neg, rng)
    best = np.concatenate([highest(toxic, beta)[0], highest(clean, beta)[0]])
    low = float(best[np.isfinite(best)].min())
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    weights, shift = logistic_fit(document_features(best, toxic + clean, low), y)
    return Model(beta, weights, shift, low)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """From at most SAMPLE rows of bounded size: the driver holds 250 MB of texts at most."""
    picked = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE)
    return train(sorted((r["text"], r["label"]) for r in picked.select(passages(F.col("text")).alias("text"), "label").collect()))


def _scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    """In runs of bounded size, whatever the length of a text."""
    if model is None:
        return np.zeros(len(texts))
    return np.concatenate([np.empty(0), *(model.score(texts.slice(i, j - i).to_pylist()) for i, j in slices(texts))])


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns: rows are taken out of Arrow batches, whatever their types."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(at).cast(pa.string()), "")
            yield b.filter(pa.array(_scores(model, texts) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)

"""Language identification: blended-spectrum presence kernels with Nyström landmarks and one-versus-rest kernel ridge regression.

Kernel of two texts: how many symbol n-grams (n = 1, 2, 3) both hold, over the root of the product of how many each holds. Symbols are code
points in lower case, with white space and pauses as one separator and digits as one digit; an n-gram is one 63-bit number, so no two share
one, in any script. Landmarks are sample documents of each language. Ridge regression on the Nyström features gives a number for each
language, and the score is their softmax. That number is linear in the kernel's values with the landmarks, and those are linear in a text's
presence vector; so landmarks and weights fold into one table (n-grams of the landmarks, all of them, by languages), and a batch of texts is
scored by one matrix product.

Training texts are a bounded sample: at most ROWS documents, as many of each language (of at most ROWS languages, the commonest), by a hash of
doc_id; of documents above LONG characters evenly spread passages. Predictions read whole texts of any length.

Texts that are null or have no letter are `und` with score 0. If no language can be learned, all are; so an empty table gives an empty result.
Where two languages tie, the first by name is said. Rows that repeat score alike, and one of those that share a doc_id may be learned from.
Extra columns are never read, whatever their names and types.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import early, fold, map_batches, passages, shuffled_order, text_of
from .nystrom import whitener

FOLDS, HELD_OUT = 4, 2
#: Documents to learn from, at most: in all, and of a language.
ROWS, PER_LANGUAGE = 2400, 600
#: Landmarks (or one of each language, if there are more, up to MOST_LANDMARKS) and how sharp the softmax is.
LANDMARKS, MOST_LANDMARKS, SHARPNESS = 200, 1000, 4.0
#: Numbers of a batch's presence matrix, at most (one text may need more).
BATCH = 1 << 22
#: Code points of which n-grams are made at once.
STRETCH = 1 << 20
_SEPARATOR, _DIGIT = 0x20, 0x30
_TABLE: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.int64)
    # Beyond 0x1FFFF no code point has another case, is a digit or is white space.
    for p in range(0x20000):
        c = chr(p)
        if c.isspace() or not c.isprintable() or c in ".,;:!?":
            out[p] = _SEPARATOR
        elif c.isdigit():
            out[p] = _DIGIT
        else:
            out[p] = ord(c.lower()[0])
    return out


def symbols(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_symbols())
    return _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def ngrams(text: str) -> np.ndarray:
    """The distinct n-grams of a text, ascending. Symbols have 21 bits and are never 0, so n-grams of different lengths differ too."""
    parts = []
    for k in range(0, max(1, len(text)), STRETCH):
        c = symbols(text[k : k + STRETCH + 2])
        two = (c[:-1] << 21) | c[1:]
        parts.append(np.unique(np.concatenate([c, two, (two[:-1] << 21) | c[2:]])))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Model:
    def __init__(self, names: list[str], known: np.ndarray, table: np.ndarray, bias: np.ndarray):
        """known: the landmarks' n-grams, ascending; table: known x languages; bias: languages."""
        self.names, self.known, self.table, self.bias = names, known, table, bias

    def values(self, texts: list[str]) -> np.ndarray:
        """A number for each text and language."""
        p, norms = np.zeros((len(texts), len(self.known)), np.float32), np.ones(len(texts))
        for i, t in enumerate(texts):
            there = ngrams(t)
            at = np.minimum(np.searchsorted(self.known, there), len(self.known) - 1)
            p[i, at[self.known[at] == there]] = 1
            norms[i] = np.sqrt(max(1, len(there)))
        return (p @ self.table) / norms[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and has_letter(t)]
        batch = max(1, BATCH // len(self.known))
        for k in range(0, len(some), batch):
            part = some[k : k + batch]
            z = SHARPNESS * self.values([texts[i] for i in part]).astype(np.float64)
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            for i, row in zip(part, z, strict=True):
                best = int(row.argmax())
                names[i], scores[i] = self.names[best], float(row[best])
        return names, scores


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def kernel(found: list[np.ndarray], known: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel values of texts (their n-grams) with the landmarks (known x landmarks, each column over the root of its n-grams)."""
    out = np.zeros((len(found), marks.shape[1]))
    for i, f in enumerate(found):
        at = np.minimum(np.searchsorted(known, f), len(known) - 1)
        out[i] = marks[at[known[at] == f]].sum(0, dtype=np.float64) / np.sqrt(max(1, len(f)))
    return out


def train(rows: list[tuple[str, str]], seed: int = 3, ridge: float = 1e-2) -> Model | None:
    """A model from (text, lang) rows."""
    rows = [(t, y) for t, y in rows if t and y is not None and has_letter(t)]
    if not rows:
        return None
    names = sorted({y for _, y in rows})
    number = {y: j for j, y in enumerate(names)}
    of = np.array([number[y] for _, y in rows])
    rng, turns = np.random.default_rng(seed), np.zeros(len(rows), int)
    for j in range(len(names)):
        own = np.flatnonzero(of == j)
        turns[rng.permutation(own)] = np.arange(len(own))
    # Languages take turns, so that each has landmarks as long as there are any left.
    picks = np.lexsort((of, turns))[: min(MOST_LANDMARKS, max(LANDMARKS, len(names)))]
    found = [ngrams(t) for t, _ in rows]
    known = np.unique(np.concatenate([found[i] for i in picks]))
    marks = np.zeros((len(known), len(picks)), np.float32)
    for j, i in enumerate(picks):
        marks[np.searchsorted(known, found[i]), j] = 1 / np.sqrt(len(found[i]))
    k = kernel(found, known, marks)
    white = whitener(k[picks])
    z = np.concatenate([k @ white, np.ones((len(rows), 1))], 1)
    # One against the rest: each language's positives weigh as much as all others together.
    weights, every = np.zeros((z.shape[1], len(names))), z.T @ z
    for j in range(len(names)):
        own = of == j
        a, b = (len(rows) * 0.5 / max(1, n) for n in (own.sum(), (~own).sum()))
        gram = b * every + (a - b) * (z[own].T @ z[own]) + ridge * len(rows) * np.eye(z.shape[1])
        weights[:, j] = np.linalg.solve(gram, a * z[own].sum(0) - b * z[~own].sum(0))
    return Model(names, known, (marks @ (white @ weights[:-1])).astype(np.float32), weights[-1].astype(np.float32))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(text, lang) of the documents to learn from; only their ids are broadcast."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    counts = rows.groupBy("lang").count()
    n = counts.count()
    if n == 0:
        return []
    # One row a language, and no more than ROWS of them.
    per, known = max(1, min(PER_LANGUAGE, ROWS // n)), F.broadcast(counts.orderBy(F.desc("count"), "lang").limit(ROWS))
    few = rows.join(known, "lang").where(early("doc_id", F.col("count"), per))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(shuffled_order("doc_id"), "doc_id"))
    ids = few.withColumn("nth", nth).where(F.col("nth") <= per).select("doc_id").distinct()
    texts = docs.select("doc_id", passages(text_of()).alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL").join(F.broadcast(ids), "doc_id")
    return sorted((r["text"], r["lang"]) for r in texts.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.*").collect())


def query(docs: DataFrame) -> DataFrame:
    model = train(sample(docs))

    def make():
        def f(c):
            names, scores = model.predict(c["text"]) if model else (["und"] * len(c["text"]), [0.0] * len(c["text"]))
            return {"doc_id": c["doc_id"], "lang_pred": names, "score": scores}

        return f

    out = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")

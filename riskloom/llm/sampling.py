"""Consistent weighted sampling: samples of weighted terms that two texts share as often as their generalised Jaccard similarity says.

For a term of weight w, sample k has r and c from Gamma(2, 1) and b from [0, 1), all fixed by (term, k):
t = floor(ln w / r + b), a = c / exp(r (t - b + 1)); the sample is the (term, t) of the smallest a.

The three numbers are made of three exponential ones, fixed by (term, k): c = e1 + e2, r = ln(c / e1) + e3, b = e3 / r. Sums of two independent
exponential numbers are Gamma(2, 1), e1 / c is uniform and independent of c, and e3 / r is uniform and independent of r, so these are the r, c
and b that the method asks for. With them a is e1 for a weight of 1, and a falls as the weight grows. So a term of weight 1 or less can't be
the sample unless its e1 is at most the smallest a of all.

Hence not all e1 of a term are made. They come in ascending order, as exponential numbers do: the j-th of n is Exp(n - j + 1) above the one
before, and belongs to sample (x + j y) mod n, where x and y are hashes of the term and n is a prime (samples from n on are left out). For any
two samples that is the law of two independent numbers. A term stops at its text's limit, below which EXPECTED terms of each sample have
their e1; in the few texts where some smallest a exceeds the limit, it is raised. Nothing is approximated.

A weight above 1 is cut in layers of 1 and what is left, each a term of its own: that leaves the sums of minima and maxima as they are.
Terms are 64-bit hashes and are never folded. No table is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The sample of a text without terms.
NONE = np.uint64((1 << 64) - 1)
#: Terms below a sample's limit, how much it is raised where that is too few, and those looked at first.
EXPECTED, RAISE, SOON = 8.0, 4.0, 2.0
#: Bytes of text handled at once.
AT_ONCE = 1 << 21
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


class Sampler:
    """`top` is the weight that counts as 1: all weights are divided by it, which leaves similarities as they are."""

    def __init__(self, samples: int, seed: int, top: float = 1.0):
        rng = np.random.default_rng(seed)
        self.samples, self.top, self.n = samples, top, _prime(max(2, samples))
        self.salt = rng.integers(0, 1 << 64, self.n, np.uint64)
        self.step = rng.integers(0, 1 << 64, self.n + 1, np.uint64)

    def rated(self, term: np.ndarray, k: np.ndarray, e1: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and t of terms in samples k."""
        z = mixed(term ^ self.salt[k])
        e2 = -np.log(((z >> np.uint64(32)) + 0.5) * 2.0**-32)
        e3 = -np.log(((z & np.uint64(0xFFFFFFFF)) + 0.5) * 2.0**-32)
        c = e1 + e2
        r = np.log(c / e1) + e3
        b = np.minimum(e3 / r, 1 - 1e-12)
        t = np.floor(np.log(weight) / r + b)
        return np.log(c) - r * (t - b + 1), t.astype(np.int64)

    def first(self, terms: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which term, sample, e1) of all e1 up to each term's limit."""
        h = mixed(terms ^ self.step[-1])
        n = np.uint64(self.n)
        at, turn = (h % n).astype(np.int64), (np.uint64(1) + (h >> np.uint64(32)) % (n - np.uint64(1))).astype(np.int64)
        rows, e, out = np.arange(len(terms)), np.zeros(len(terms)), []
        for j in range(self.n):
            u = ((mixed(terms[rows] ^ self.step[j]) >> np.uint64(11)) + 0.5) * _UNIT
            e = e - np.log(u) / (self.n - j)
            on = e <= limit[rows]
            rows, e = rows[on], e[on]
            if not len(rows):
                break
            out.append((rows, at[rows], e))
            at[rows] = (at[rows] + turn[rows]) % self.n
        which, k, e1 = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        there = k < self.samples
        return which[there], k[there], e1[there]

    def layers(self, terms: np.ndarray, weights: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with no weight above 1."""
        high = np.flatnonzero(weights > 1)
        if not len(high):
            return terms, weights, of
        more = np.ceil(weights[high]).astype(np.int64) - 1
        again = np.repeat(high, more)
        layer = np.arange(len(again)) - np.repeat(np.cumsum(more) - more, more) + 1
        every = np.concatenate([terms, mixed(terms[again] + layer.astype(np.uint64) * _GOLDEN)])
        return every, np.concatenate([np.minimum(weights, 1), np.minimum(weights[again] - layer, 1)]), np.concatenate([of, of[again]])

    def sample(self, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """64-bit hashes of the samples, a row for each text. Text i has the distinct terms from starts[i] up to starts[i + 1]; one without terms has NONE."""
        n = len(starts) - 1
        out, best = np.full(n * self.samples, NONE, np.uint64), np.full(n * self.samples, np.inf)
        terms, weights, of = self.layers(terms, np.asarray(weights, np.float64) / self.top, np.repeat(np.arange(n), np.diff(starts)))
        if not len(terms):
            return out.reshape(n, self.samples)
        total = np.bincount(of, weights, n)
        limit = EXPECTED / np.maximum(total, 1e-300)
        while True:
            which, k, e1 = self.first(terms, limit[of])
            cell = of[which] * self.samples + k
            soon = e1 * total[of[which]] <= SOON
            for part in (np.flatnonzero(soon), np.flatnonzero(~soon)):
                part = part[np.log(e1[part]) <= best[cell[part]]]
                a, t = self.rated(terms[which[part]], k[part], e1[part], weights[which[part]])
                np.minimum.at(best, cell[part], a)
                won = a == best[cell[part]]
                out[cell[part[won]]] = mixed(mixed(terms[which[part[won]]]) + t[won].astype(np.uint64) * _GOLDEN)
            # Terms that were passed over have an e1, and so an a, above the limit.
            short = (best.reshape(n, self.samples) > np.log(limit)[:, None]).any(1) & (total > 0)
            if not short.any():
                return out.reshape(n, self.samples)
            rest = short[of]
            terms, weights, of = terms[rest], weights[rest], of[rest]
            limit = limit * RAISE
            total = np.where(short, total, 0.0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, rows: int = 1024) -> list[tuple[int, int]]:
    """(from, to) of runs of texts with at most AT_ONCE bytes (a longer text is alone) and at most `rows` rows."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    out, begin, size = [], 0, 0
    for i, s in enumerate(sizes):
        if i > begin and (size + s > AT_ONCE or i - begin >= rows):
            out.append((begin, i))
            begin, size = i, 0
        size += s
    return [*out, (begin, len(sizes))] if len(sizes) > begin else out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in turn, and where each text's begin (one more than texts). White space is space and tab to carriage return."""
    import xxhash

    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = split.flatten().dictionary_encode()
    # Distinct words are cut from the dictionary's bytes: Arrow takes several times as long to make Python values of them.
    _, ends, data = words.dictionary.buffers()
    data, n_names = data.to_pybytes() if data else b"", len(words.dictionary)
    ends = np.frombuffer(ends, np.int64, n_names + 1) if n_names else np.zeros(1, np.int64)
    cuts = ends.tolist()
    known = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), np.uint64, n_names)
    at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Empty words come from white space at a text's ends.
    keep = np.diff(ends)[at] > 0 if n_names else np.zeros(0, bool)
    offsets = split.offsets.to_numpy().astype(np.int64)
    return known[at[keep]], np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]]


def bags_of(h: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """terms, counts, starts: of each text its distinct runs of `width` words as 64-bit hashes, ascending, and how often they stand in it.

    A text with fewer words has one term of them all; one without words has none.
    """
    n = np.diff(begin)
    terms = runs(h, width)
    counts_of = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    ends = np.cumsum(counts_of)
    first = ends - counts_of
    take = np.repeat(begin[:-1] - first, counts_of) + np.arange(ends[-1] if len(ends) else 0)
    out = np.empty(len(take), np.uint64)
    whole = take < len(terms)
    out[whole] = terms[take[whole]]
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        out[first[i]] = runs(h[begin[i] : begin[i + 1]], int(n[i]))[0]
    for i, j in zip(first.tolist(), ends.tolist(), strict=True):
        out[i:j].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[first[counts_of > 0]] = True
    places = np.flatnonzero(new)
    starts = np.searchsorted(places, np.concatenate([first, ends[-1:]])) if len(first) else np.zeros(1, np.int64)
    return out[places], np.diff(places, append=len(out)), starts


def bags(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return bags_of(*words_of(texts), width)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` hashes; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out *= _GOLDEN
        out ^= out >> np.uint64(29)
        out += hashes[k : n + k]
    return mixed(out)

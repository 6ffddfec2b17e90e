"""Secret scans: fixed patterns, and formats learned by grammar inference.

The fixed patterns are the base. What the base finds in the whole table are the labelled credentials of each kind, of which those with the
smallest hashes are taken: a prefix tree of their symbol strings is reduced to a probabilistic automaton by merging states whose counts are statistically
compatible (Hoeffding bounds, red-blue order). A second automaton is inferred from ordinary tokens of a bounded sample of documents: short ones, and
those long ones that no format's automaton rates nearly as high as its own credentials, so that bare credentials, however common, don't
teach it their format. Every other candidate token of every text is scored by its log likelihood for each symbol under a format's automaton, less that under the ordinary
one; it is a span of kind `format` if that is at least what nearly all labelled credentials of the format reach. Base spans are scored in the
same way and stay whatever they score; other candidates that overlap one are left out.

Null counts as empty; texts of any length are scanned whole; rows that repeat are scanned as they stand; an empty table gives an empty
result; spans that begin at the same place come in the order of the kinds; extra columns are never read. With no labelled credentials there is
no `format` span.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_ids, map_batches, stored, text_of

KINDS = ("assign", "access", "hex", "format")
#: Documents from which ordinary tokens are taken, at most.
SAMPLE_DOCS = 8000
#: Credentials of a kind, and ordinary tokens (short ones, and candidates), to learn from, at most; and how long these are at most.
BOUNDS, LONGEST = {"assign": 400, "access": 400, "hex": 400, "plain": 3000, "long": 3000}, 512
#: Confidence of the state merging; candidates' least length; the share of labelled credentials below the threshold.
ALPHA, LEAST, BELOW = 0.05, 12, 0.02
#: No candidate passes unless it is at least this likelier, for each symbol, as a credential than as an ordinary token.
MARGIN = 1.0
# ASCII only, so that no letter outside ASCII matches in the other case.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Leftmost runs of [0-9a-f]+ are the maximal runs; those of 16 and more are the ones that count.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order of start and kind."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def credential(text: str, start: int, kind: int, end: int) -> str:
    """What is secret in a base span: of an assignment, its value."""
    return _ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Tokens of an assignment's characters, long enough to be credentials, that overlap no base span."""
    out: list[tuple[int, int, str]] = []
    # Both stand in order of their starts, so one pass tells how far the base spans reach that begin before a candidate's end.
    k = reach = 0
    for m in _CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def symbols(token: str) -> str:
    """A letter for each character: a hex, A upper hex, b other lower, B other upper, 0 digit, signs as themselves."""
    return token.translate(_CLASS)


_CLASS = str.maketrans({**{c: "a" for c in "abcdef"}, **{c: "b" for c in "ghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEF"}, **{c: "B" for c in "GHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "123456789"}})


class Automaton:
    """A probabilistic automaton: counts of each state's transitions and ends."""

    def __init__(self, nexts: list[dict[str, int]], counts: list[dict[str, float]], ends: list[float]):
        self.nexts, self.ends = nexts, ends
        self.total = [sum(c.values()) + e for c, e in zip(counts, ends, strict=True)]
        self.logs = [{s: math.log(v / t) for s, v in c.items()} for c, t in zip(counts, self.total, strict=True)]

    def rate(self, word: str, unseen: float = math.log(1e-3)) -> float:
        """Log likelihood of a word, for each symbol and its end. What no training word did costs `unseen`; an unknown way stays in its state."""
        state, sum_ = 0, 0.0
        for s in word:
            sum_ += self.logs[state].get(s, unseen)
            state = self.nexts[state].get(s, state)
        end = self.ends[state]
        return (sum_ + (math.log(end / self.total[state]) if end else unseen)) / (len(word) + 1)


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """State merging on the prefix tree of words: a blue state joins the first red one that it is compatible with, else turns red.

    Merged states are found through `parent` (a union-find), and folding a subtree adds its counts to those of what it joins.
    """
    nexts: list[dict[str, int]] = [{}]
    counts: list[dict[str, float]] = [{}]
    ends = [0.0]
    for w in words:
        at = 0
        for s in w:
            counts[at][s] = counts[at].get(s, 0) + 1
            if s not in nexts[at]:
                nexts[at][s] = len(nexts)
                nexts.append({})
                counts.append({})
                ends.append(0.0)
            at = nexts[at][s]
        ends[at] += 1
    slack = math.sqrt(0.5 * math.log(2 / alpha))

    def total(q: int) -> float:
        return sum(counts[q].values()) + ends[q]

    def differ(f1: float, n1: float, f2: float, n2: float) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > slack * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = total(a), total(b)
            if differ(ends[a], n1, ends[b], n2):
                return False
            for s in counts[a].keys() | counts[b].keys():
                if differ(counts[a].get(s, 0), n1, counts[b].get(s, 0), n2):
                    return False
                if s in nexts[a] and s in nexts[b]:
                    todo.append((nexts[a][s], nexts[b][s]))
        return True

    def absorb(a: int, b: int) -> None:
        """b and what follows it, a tree, fold into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            ends[a] += ends[b]
            for s, v in counts[b].items():
                counts[a][s] = counts[a].get(s, 0) + v
                if s in nexts[a]:
                    todo.append((nexts[a][s], nexts[b][s]))
                else:
                    nexts[a][s] = nexts[b][s]

    red = [0]
    while True:
        known = set(red)
        blue = [(q, s, t) for q in red for s, t in sorted(nexts[q].items()) if t not in known]
        if not blue:
            break
        q, s, t = max(blue, key=lambda x: total(x[2]))
        for r in red:
            if compatible(r, t):
                nexts[q][s] = r
                absorb(r, t)
                break
        else:
            red.append(t)
    number = {q: i for i, q in enumerate(red)}
    return Automaton([{s: number[t] for s, t in nexts[q].items()} for q in red], [counts[q] for q in red], [ends[q] for q in red])


class Formats:
    """The learned formats, each with its threshold, and the automaton of ordinary tokens.

    Of unlabelled tokens, which may be credentials, those are ordinary that every format rates further below the median of its
    labelled ones than twice as far as nearly all of these lie.
    """

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str], unlabelled: list[str] | None = None):
        self.parts: list[tuple[Automaton, float]] = []
        formats = [(infer([symbols(w) for w in words]), words) for words in labelled.values() if len(words) >= 8]
        plain = [symbols(w) for w in ordinary]
        if unlabelled:
            floors = []
            for own, words in formats:
                rates = sorted(own.rate(symbols(w)) for w in words)
                floors.append((own, 2 * rates[int(BELOW * len(rates))] - rates[len(rates) // 2]))
            plain += [w for w in map(symbols, unlabelled) if all(own.rate(w) < floor for own, floor in floors)]
        self.plain = infer(plain) if plain else None
        for own, words in formats:
            if self.plain:
                rates = sorted(self.gain(own, symbols(w)) for w in words)
                self.parts.append((own, max(MARGIN, rates[int(BELOW * len(rates))])))

    def gain(self, own: Automaton, word: str) -> float:
        return own.rate(word) - self.plain.rate(word)

    def score(self, token: str) -> float:
        """How far a token's best gain is above the threshold of its format: 0 and more is likely."""
        w = symbols(token)
        return max((self.gain(own, w) - least for own, least in self.parts), default=-math.inf)

    def likely(self, token: str) -> bool:
        return self.score(token) >= 0


def scan(text: str, formats: Formats | None) -> list[tuple[int, int, int]]:
    return [x[:3] for x in scored(text, formats)]


def scored(text: str, formats: Formats | None) -> list[tuple[int, int, int, float | None]]:
    """(start, kind number, end, score) of all spans. Base spans stay whatever they score; without formats nothing is scored."""
    spans = base_spans(text)
    if not (formats and formats.parts):
        return [(*x, None) for x in spans]
    found = [(s, k, e, formats.score(credential(text, s, k, e))) for s, k, e in spans]
    more = ((s, 3, e, formats.score(w)) for s, e, w in candidates(text, spans))
    return sorted(found + [x for x in more if x[3] >= 0])


class Least:
    """The distinct words with the smallest hashes, up to a number of them: a sample that doesn't depend on where a word stands."""

    def __init__(self, most: int):
        self.most, self.kept, self.heap = most, set(), []

    def add(self, word: str) -> bool:
        """Whether the word is among the smallest so far, and new."""
        h = -xxhash.xxh3_64_intdigest(word.encode())
        if (len(self.heap) == self.most and h <= self.heap[0][0]) or word in self.kept:
            return False
        self.kept.add(word)
        heapq.heappush(self.heap, (h, word))
        if len(self.heap) > self.most:
            self.kept.discard(heapq.heappop(self.heap)[1])
        return True


def learn(docs: DataFrame) -> Formats:
    """Formats of credentials from all documents, ordinary tokens from at most SAMPLE_DOCS, picked by a hash of doc_id; only their ids are broadcast.

    Of each kind the words with the smallest hashes are learned from, first in each task (a word that isn't among its task's can't be among
    the table's), then of all. A word above LONGEST characters is no example.
    """
    ids = first_ids(docs.where(F.col("doc_id").isNotNull()).select("doc_id"), SAMPLE_DOCS).distinct()

    def words_of(found):
        def make():
            least: dict[str, Least] = {}

            def f(c):
                out = {"kind": [], "word": []}
                for t in c["text"]:
                    for kind, word in found(t):
                        if len(word) <= LONGEST and least.setdefault(kind, Least(BOUNDS[kind])).add(word):
                            out["kind"].append(kind)
                            out["word"].append(word)
                return out

            return f

        return make

    def credentials(t):
        return [(KINDS[k], credential(t, s, k, e)) for s, k, e in base_spans(t)]

    def tokens(t):
        return [("long", w) for _, _, w in candidates(t, base_spans(t))] + [("plain", w) for w in _TOKEN.findall(t) if len(w) < LEAST]

    picked = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").select("text")
    schema = "kind string, word string"
    every = map_batches(docs.select(text_of().alias("text")), words_of(credentials), schema).unionByName(map_batches(picked, words_of(tokens), schema))
    every = stored(every.distinct(), "credentials")
    words = {}
    for kind, most in BOUNDS.items():
        words[kind] = [r["word"] for r in every.where(F.col("kind") == kind).orderBy(F.md5("word"), "word").limit(most).collect()]
    return Formats({k: words[k] for k in KINDS[:3]}, words["plain"], words["long"])


def query(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """The contract's columns, and scores: of each span in `spans`, in turn, how far its format's likelihood is above the format's threshold."""
    formats = formats or learn(docs)

    def make():
        def f(c):
            out = {n: [] for n in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores")}
            for d, t in zip(c["doc_id"], c["text"], strict=True):
                spans = scored(t, formats)
                said = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans]
                base = ",".join(x for x, r in zip(said, spans, strict=True) if r[1] < 3)
                scores = ",".join("" if r[3] is None else f"{r[3]:.2f}" for r in spans)
                row = (d, *(sum(r[1] == j for r in spans) for j in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(said), scores)
                for n, v in zip(out, row, strict=True):
                    out[n].append(v)
            return out

        return f

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), make, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, scores string")

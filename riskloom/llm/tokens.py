"""Encoding whole texts with a public tokenizer file; no tokenizer is trained here."""

from __future__ import annotations

import gc
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers at once; then it starts anew. It bounds memory and changes no result.
REMEMBER = 800_000
GROUP = 100
#: Characters handled at once.
AT_ONCE = 1 << 21


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids of texts, equal to encode(text, add_special_tokens=False).

    This vocabulary drops white space and never joins what stands on two sides of it, so a text's ids are those of its
    white-space-separated words in turn, and each distinct word is encoded once. Vocabularies for which that doesn't hold are
    encoded as whole texts (by_word=False).
    """

    def __init__(self, path: str | None = None, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.by_word, self.known = Tokenizer.from_file(path or default_path()), by_word, {}
        names = self.tok.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for w, i in names.items() if w.endswith("</w>")]] = True

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        # Hundreds of thousands of small objects come to be at once, none of them in a cycle: looking for cycles would only cost time.
        on = gc.isenabled()
        gc.disable()
        try:
            return self._parts(texts)
        finally:
            if on:
                gc.enable()

    def _parts(self, texts: list[str]) -> list[np.ndarray]:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size > AT_ONCE:
                out += self._words(part)
                part, size = [], 0
        return out + self._words(part)

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        # Where a text may hold a special token, in any case, the next step could make or unmake one.
        special = [i for i, t in enumerate(texts) if "<|" in t]
        column = pc.ascii_lower(pa.array([t if "<|" not in t else "" for t in texts] if special else texts, pa.large_string()))
        split = pc.ascii_split_whitespace(column)
        # Distinct words are found, and ids put together, without a Python step for each word.
        words = split.flatten().dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBER:
            self.known = {}
        known = self.known
        data = list(map(known.get, names))
        missing = [i for i, x in enumerate(data) if x is None]
        # Signs after a Latin letter are a piece of their own: most new words are known but for these.
        new = {names[i]: (names[i], "") if names[i].isalpha() else _plain(names[i]) for i in missing}
        self._encode(list(({p for p, _ in new.values()} | {end for _, end in new.values() if end}).difference(known)))
        for w, (p, end) in new.items():
            if end:
                known[w] = known[p] + known[end]
        for i in missing:
            data[i] = known[names[i]]
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        every, starts = np.frombuffer(b"".join(data), np.uint32), np.cumsum(sizes) - sizes
        at = words.indices.to_numpy(zero_copy_only=False)
        counts = sizes[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        flat = every[np.repeat(starts[at] - upto[:-1], counts) + np.arange(upto[-1])]
        ends = upto[split.offsets.to_numpy().astype(np.int64)]
        out = [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i in special:
            out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _encode(self, words: list[str]) -> None:
        """Words of letters alone are one piece each, so many are encoded in one text and told apart by the ids that end a piece."""
        groups: list[list[str]] = []
        letters = [w for w in words if w.isalpha()]
        for i in range(0, len(letters), GROUP):
            groups.append(letters[i : i + GROUP])
        rest = [w for w in words if not w.isalpha()]
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group):
                rest += group
                continue
            data, at = ids.tobytes(), 0
            for w, to in zip(group, (ends * 4).tolist(), strict=True):
                self.known[w] = data[at:to]
                at = to
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = array("I", e.ids).tobytes()


_SIGNS = ".,;:!?#$%&*@|)(][}{/+=~^-"


def _plain(word: str) -> tuple[str, str]:
    stem = word.rstrip(_SIGNS)
    if len(stem) < len(word) and stem[-1:].isalpha() and stem[-1] < "\u0100":
        return stem, word[len(stem) :]
    return word, ""


def encoder(path: str | None = None) -> Encoder:
    """One for each worker process."""
    return held(f"encoder {path}", lambda: Encoder(path))

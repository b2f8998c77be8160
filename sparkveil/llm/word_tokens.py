"""Token ids of whole texts through the ``tokenizers`` library, each distinct word encoded once per worker.

A byte-level or word-end BPE never merges across the pieces that its pre-tokenizer cuts,
so a text may be encoded piece by piece.  The places used here are cuts for both
vocabularies whatever surrounds them (tests compare with whole-text encoding):

* byte-level: before a space that a non-space character follows, and around a single
  line feed between non-space characters;
* word-end: at any space or line feed;
* both: between letters and one mark of ``.,!?;:`` that ends the piece.

Texts with anything rarer (runs of white space, special-token strings) are encoded whole.  New
words are encoded many at a time, as one text that is cut at the same places again.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARKS = frozenset(".,!?;:")
#: Entries of each of the two generations of a worker's cache; bounds its memory, not the result.
CACHE_WORDS = 150_000
#: New words that are encoded as one text, and such texts at a time.
JOINED, TEXTS = 500, 50
#: Stands between joined words of a word-end vocabulary: one byte that is a piece of its own between spaces.
MARK = "\x01"


class WordEncoder:
    def __init__(self, path: str, keeps_spaces: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_spaces = keeps_spaces
        vocab = self.tokenizer.get_vocab()
        self.code = "H" if len(vocab) <= 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether an id tells joined words apart: it begins with a space or line feed, or is the mark between them.
        self.parts = np.zeros(max(vocab.values()) + 1, bool)
        if keeps_spaces:
            self.parts[[k for token, k in vocab.items() if token[0] in "ĠĊ"]] = True
        else:
            self.parts[self.tokenizer.encode(MARK, add_special_tokens=False).ids] = True
        #: Ids of a piece that follows a space or begins with its line feed; None where the text must be encoded whole.
        self.cache: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.marks = {m: self.whole(m) for m in sorted(MARKS)}

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _join(self, words: list[str]) -> str:
        if self.keeps_spaces:
            return "".join([w if w[0] == "\n" else " " + w for w in words])
        return f" {MARK} ".join(words)

    def _split(self, words: list[str], ids: list[int]) -> list[bytes]:
        """The ids of each of the joined words."""
        flat = np.array(ids, self.dtype)
        at = np.flatnonzero(self.parts[flat])
        if self.keeps_spaces:
            first, last = at, np.append(at[1:], len(flat))
        else:
            first, last = np.append(0, at + 1), np.append(at, len(flat))
        if len(first) != len(words) or first[0]:  # a word holds the mark
            return [self.whole(self._join([w])) for w in words]
        size, data = flat.itemsize, flat.tobytes()
        return [data[a:b] for a, b in zip((first * size).tolist(), (last * size).tolist(), strict=True)]

    def _ids(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), JOINED * TEXTS):
            runs = [words[a : a + JOINED] for a in range(k, min(len(words), k + JOINED * TEXTS), JOINED)]
            coded = self.tokenizer.encode_batch_fast([self._join(run) for run in runs], add_special_tokens=False)
            for run, e in zip(runs, coded, strict=True):
                out += self._split(run, e.ids)
        return out

    @staticmethod
    def _stem(piece: str) -> str | None:
        """The letters of a piece that ends with one mark."""
        stem = piece[:-1]
        return stem if piece[-1:] in MARKS and stem.isalpha() and stem.lower().isalpha() else None

    def _add(self, new: set[str]) -> None:
        cache, old = self.cache, self.old
        need, marked = set(), []
        for w in new:
            if w in old:
                cache[w] = old[w]
            elif w.isalpha():
                need.add(w)
            elif (stem := self._stem(w)) is not None:
                marked.append(w)
                if stem in old:
                    cache[stem] = old[stem]
                elif stem not in cache:
                    need.add(stem)
            elif not self.keeps_spaces or w.split() == [w[1:] if w[:1] == "\n" else w]:
                need.add(w)
            else:
                cache[w] = None
        words = [*need]
        cache.update(zip(words, self._ids(words), strict=True))
        for w in marked:
            cache[w] = cache[w[:-1]] + self.marks[w[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``; an empty text has none."""
        if not texts:
            return []
        special = np.array([any(s in text for s in self.special) for text in texts])
        # the first piece stands as behind a space, or else as behind a line feed whose id is left out below
        fed = np.array([self.keeps_spaces and text[:1] not in ("", " ", "\n") for text in texts])
        if self.keeps_spaces:
            spaced = [("\n" + t if f else t).replace("\n", " \n") for t, f in zip(texts, fed.tolist(), strict=True)]
            spaced = [t[1:] for t in spaced]  # each that has a character begins with a space
        else:
            spaced = [t.replace("\n", " ") for t in texts]
        pieces = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        coded = pieces.values.dictionary_encode()
        # each different piece is looked up once, then its ids go wherever it stands
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()  # to_pylist makes a scalar of each
        if new := set(words).difference(self.cache):
            self._add(new)
        found = [*map(self.cache.__getitem__, words)]
        odd = np.zeros(len(index), bool)
        if None in found:
            odd = np.array([x is None for x in found])[index]
            found = [x or b"" for x in found]
        data = np.frombuffer(b"".join(found), self.dtype)
        size = data.itemsize
        length = np.fromiter(map(len, found), np.int64, len(found)) // size
        count = length[index]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = data[np.repeat((np.cumsum(length) - length)[index] - ends[:-1], count) + np.arange(ends[-1])].tobytes()
        cuts = pieces.offsets.to_numpy()
        whole = special | (np.diff(np.concatenate([[0], np.cumsum(odd)])[cuts]) > 0)
        first, last = (ends[cuts[:-1]] + fed) * size, ends[cuts[1:]] * size
        out = [self.whole(t) if w else ids[x:y] for t, w, x, y in zip(texts, whole.tolist(), first.tolist(), last.tolist(), strict=True)]
        if len(self.cache) > CACHE_WORDS:
            self.old, self.cache = self.cache, {}
        return out


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, keeps_spaces: bool) -> WordEncoder:
    """One encoder in each Python worker; its vocabulary and cache outlive a task."""
    if (path, keeps_spaces) not in _ENCODERS:
        _ENCODERS[path, keeps_spaces] = WordEncoder(path, keeps_spaces)
    return _ENCODERS[path, keeps_spaces]

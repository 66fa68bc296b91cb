"""Token ids by the tokenizers library, encoding each distinct run of letters of a group of texts once.

Texts are cut only where the tokenizer's own pre-tokenizer always cuts.  Arrow finds the
distinct cuts of a group of texts and parts those of plain letters and punctuation in two;
each part goes through the tokenizer's model as the pre-tokenizer would hand it over.  Any
other cut goes through the whole tokenizer.  What short parts gave is remembered in two
generations of bounded size, so common ones stay and the memory is bounded.  Texts that
can't be cut safely go to the library whole.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from panelkit.llm.token_count import byte_letters, splits_at_spaces

#: Bounds of the memo: entries of a generation, and characters of what is remembered.
MEMO_WORDS, MEMO_CHARS = 150_000, 48
#: Entries for what isn't a plain run of letters: most of it is seen once.
MEMO_OTHERS = 20_000
#: Letters that are stable under normalisation and lower-cased one by one; ASCII punctuation.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+", "[!-/:-@\\[-`{-~]*"
PLAIN = re.compile(f"({LETTERS})({MARKS})")
#: Line ends with something on both sides.
LINE_ENDS = re.compile("(\n+)")


class Memo(dict):
    """Remembers what ``make(key)`` gave; half of it is dropped from time to time, the common keys stay."""

    def __init__(self, make, entries: int = MEMO_WORDS):
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_level = self.tokenizer.normalizer is None
        self.before = " " if self.byte_level else ""
        self.letters = {b: c for c, b in byte_letters().items()}
        self.piece = Memo(self._piece, MEMO_OTHERS)
        self.run = Memo(lambda run: self._piece(" " + run if self.byte_level else run.lower()))
        self.other = Memo(lambda cut: self._word(cut, self.before), MEMO_OTHERS)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of what the pre-tokenizer keeps together, already lower-cased if need be."""
        if piece.isascii():
            piece = piece.replace(" ", self.letters[32]).replace("\n", self.letters[10])
        else:
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str, before: str) -> bytes:
        """Ids of a cut that follows ``before``, a space or nothing."""
        plain = PLAIN.fullmatch(word)
        if plain:
            letters, marks = plain.groups()
            head = self.run[letters] if before == self.before else self.piece[letters]
            return head + self.piece[marks] if marks else head
        if self.byte_level and "\n" in word:
            # the pre-tokenizer takes all line ends but the last as one piece, then the last
            parts = LINE_ENDS.split(word)
            if all(map(PLAIN.fullmatch, parts[::2])):
                out = [self._word(parts[0], before)]
                for ends, part in zip(parts[1::2], parts[2::2]):
                    out += [self.piece[ends[1:]] if len(ends) > 1 else b"", self.piece["\n"], self._word(part, "")]
                return b"".join(out)
        return self.whole(before + word)

    def _cuts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(offsets of the texts' cuts, two codes for each cut, ids of each code)."""
        texts = pa.array(texts, pa.large_string())
        cut = pc.split_pattern(texts, " ") if self.byte_level else pc.ascii_split_whitespace(texts)
        offsets, values = cut.offsets.to_numpy(), cut.flatten()
        coded = values.dictionary_encode()
        cuts, codes = coded.dictionary, coded.indices.to_numpy()
        ids = [b""]
        part = np.zeros((len(cuts), 2), np.int64)
        found = pc.extract_regex(cuts, f"^(?P<run>{LETTERS})(?P<marks>{MARKS})$")
        plain = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
        for column, (name, memo) in enumerate((("run", self.run), ("marks", self.piece))):
            some = found.take(pa.array(plain)).field(name).dictionary_encode()
            part[plain, column] = some.indices.to_numpy() + len(ids)
            ids += [memo[x] if x else b"" for x in some.dictionary.to_pylist()]
        other = np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
        part[other, 0] = np.arange(len(other)) + len(ids)
        ids += [self.other[x] for x in cuts.take(pa.array(other)).to_pylist()]
        part = part[codes]
        if self.byte_level:
            # no space comes before the first cut of a text
            first = offsets[:-1]
            coded = values.take(pa.array(first)).dictionary_encode()
            part[first, 0] = coded.indices.to_numpy() + len(ids)
            part[first, 1] = 0
            ids += [self._word(w, "") if w else b"" for w in coded.dictionary.to_pylist()]
        return offsets, part.ravel(), ids

    def _encode(self, texts: list[str]) -> list[bytes]:
        offsets, codes, known = self._cuts(texts)
        pool = np.frombuffer(b"".join(known), "<u4")
        size = np.array([len(k) >> 2 for k in known], np.int64)
        start = np.cumsum(size) - size
        length = size[codes]
        end = np.cumsum(length)
        shift = np.repeat(start[codes] - (end - length), length)
        shift += np.arange(len(shift))
        ids = pool[shift].tobytes()
        bounds = (4 * np.append(0, end)[2 * offsets]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        safe = [not self.byte_level or splits_at_spaces(t) for t in texts]
        found = iter(self._encode([t for t, ok in zip(texts, safe) if ok]) if any(safe) else [])
        return [next(found) if ok else self.whole(t) for t, ok in zip(texts, safe)]


@functools.lru_cache(4)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    return WordEncoder(path)


def text_groups(ids: list, texts: list, chars: int = 1 << 22):
    """Consecutive (ids, texts) of about ``chars`` characters; null texts become empty."""
    start = size = 0
    texts = [t or "" for t in texts]
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield ids[start : k + 1], texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]

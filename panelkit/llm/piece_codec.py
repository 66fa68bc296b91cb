"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest prefixes the model's compiled character map knows; an
array beside the normalised bytes records at which byte of the original each of them began.
The normalised text is segmented, and every piece is projected through that array to the span
of original bytes it stands for.

Where no piece has a space after something else, words are segmented by themselves, each
distinct one once; what was found is remembered (a bounded memo).

Edge cases: null texts count as empty and have no pieces; repeated rows and null ids are rows
of their own; an empty table gives an empty result; columns of the table are kept, and one
that has the name of the result is replaced.  Memory for a text is about twelve bytes a piece,
and some hundred a character for the longest run that can't be cut.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from panelkit.llm.encoders import MEMO_WORDS

SPACE, WIDE_SPACE = " ", "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BAD = "�"
#: Cuts beyond this many characters are cut again wherever no piece spans the border.
LONG = 64
#: Characters of the texts that a task encodes before it hands the pieces on.
GROUP_CHARS = 1 << 21
PIECES = "ids array<int>, begins array<int>, ends array<int>"


class CharacterMap:
    """The compiled map: a double-array trie over bytes, then replacements that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]
        self.starts = re.compile(f"[{''.join(map(re.escape, self._first_characters()))}]")

    @staticmethod
    def _below(unit: int) -> int:
        """Offset of the children of a unit."""
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child(self, node: int, byte: int) -> int | None:
        node ^= byte
        found = self.units[node] if node < len(self.units) else 0
        return node if found & 0x800000FF == byte else None

    def _first_characters(self) -> Iterator[str]:
        """Characters that a key of the map starts with; found level by level over their bytes."""
        level = [(self._below(self.units[0]), b"")]
        while level:
            deeper = []
            for base, seen in level:
                for byte in range(1, 256):
                    node = self._child(base, byte)
                    if node is None:
                        continue
                    key = seen + bytes([byte])
                    lead = key[0]
                    if len(key) == 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0):
                        yield key.decode("utf-8", "ignore")
                    else:
                        deeper.append((node ^ self._below(self.units[node]), key))
            level = deeper

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length of the longest key at ``at``, its replacement)."""
        base, best = self._below(self.units[0]), None
        for k in range(at, len(text)):
            node = self._child(base, text[k])
            if node is None:
                break
            unit = self.units[node]
            base = node ^ self._below(unit)
            if unit >> 8 & 1:
                best = k + 1 - at, self.units[base] & 0x7FFFFFFF
        if best is None:
            return None
        length, value = best
        return length, self.replacements[value : self.replacements.index(b"\0", value)]


def _origins(raw: bytes) -> np.ndarray:
    """For each byte, the place of the first byte of its character."""
    octets = np.frombuffer(raw, np.uint8)
    place = np.arange(len(octets), dtype=np.int32)
    return np.maximum.accumulate(np.where(octets & 0xC0 != 0x80, place, 0)) if len(octets) else place


class Normalizer:
    """``run(text)`` gives the normalised text, and for each of its bytes and its end the original byte."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if len(spec.precompiled_charsmap) > 4 else None
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def _mapped(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after the character map, and where each came from."""
        raw = text.encode()
        octets, origin = np.frombuffer(raw, np.uint8), _origins(raw)
        if self.map is None:
            return octets, origin
        out, places, done, seen, at = [], [], 0, 0, 0
        for m in self.map.starts.finditer(text):
            at += len(text[seen : m.start()].encode())
            seen = m.start()
            if at < done:
                continue
            found = self.map.longest(raw, at)
            if found is None:
                continue
            length, new = found
            out += [octets[done:at], np.frombuffer(new, np.uint8)]
            places += [origin[done:at], np.full(len(new), at, np.int32)]
            done = at + length
        return np.concatenate([*out, octets[done:]]), np.concatenate([*places, origin[done:]])

    def _leading_blanks(self, text: str) -> int:
        """Bytes at the start that become single spaces."""
        raw, at = text.encode(), 0
        while at < len(raw):
            found = self.map.longest(raw, at) if self.map else None
            length, new = found or (1, raw[at : at + 1])
            if new != b" ":
                break
            at += length
        return at

    def run(self, text: str) -> tuple[str, np.ndarray]:
        octets, origin = self._mapped(text)
        end = len(text.encode())
        if self.trim and len(octets):
            blank = octets == 0x20
            keep = ~(blank & np.append(True, blank[:-1]))
            last = np.flatnonzero(~blank)
            stop = last[-1] + 1 if len(last) else 0
            end = int(origin[stop]) if stop < len(octets) else end
            keep[stop:] = False
            octets, origin = octets[keep], origin[keep]
        if not len(octets):
            return "", np.array([end], np.int32)
        if self.prefix:
            octets, origin = np.append(np.uint8(0x20), octets), np.append(np.int32(self._leading_blanks(text) if self.trim else 0), origin)
        new = octets.tobytes().decode()
        if self.escape:
            new = new.replace(SPACE, WIDE_SPACE)
            origin = np.repeat(origin, np.where(octets == 0x20, len(WIDE_SPACE.encode()), 1))
        return new, np.append(origin, np.int32(end))


class PieceCodec:
    """Encoder with offsets and decoder of one model.

    The library segments what is normalised already, with the model's own normaliser taken out.
    """

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = {p.type for p in proto.pieces}
        if kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model of normal, unknown, control and byte pieces is needed, with spaces before words")
        self.normalizer = Normalizer(proto.normalizer_spec)
        bare = sentencepiece_model_pb2.ModelProto()
        bare.CopyFrom(proto)
        bare.normalizer_spec.CopyFrom(sentencepiece_model_pb2.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False))
        self.segment = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        #: Pairs of characters that a piece holds side by side.
        self.beside = {pair for p in proto.pieces if p.type == NORMAL for pair in zip(p.piece, p.piece[1:])}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        # bytes of the normalised text that a piece covers; an unknown one covers what it covers
        self.length = [len(p.piece) for p in proto.pieces]
        self.characters = {p.piece for p in proto.pieces if p.type == NORMAL and len(p.piece) == 1}
        self.covers = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        spaced = lambda p: p.replace(WIDE_SPACE, SPACE) if self.normalizer.escape else p
        said = {NORMAL: lambda p: spaced(p.piece), UNKNOWN: lambda p: proto.trainer_spec.unk_surface, CONTROL: lambda p: ""}
        self.surface = [bytes([self.byte_of[k]]) if p.type == BYTE else said[p.type](p).encode() for k, p in enumerate(proto.pieces)]
        self.leading = {k for k, p in enumerate(proto.pieces) if p.type == NORMAL and p.piece.startswith(WIDE_SPACE)}
        # words start with their spaces if no piece has a space after something else
        self.word = re.compile(f"{WIDE_SPACE}*[^{WIDE_SPACE}]+|{WIDE_SPACE}+")
        self.cuts_at_spaces = not any(b == WIDE_SPACE and a != WIDE_SPACE for a, b in self.beside)
        self.known, self.old = {}, {}

    def _learn(self, runs: Iterable[str]) -> list[str]:
        """Makes the ids of all runs known; returns those that are too long to be remembered."""
        missing, cuts = [], {}
        for run in runs:
            if run in self.known:
                continue
            if run in self.old:
                self.known[run] = self.old[run]
            elif len(run) <= LONG:
                missing.append(run)
            else:
                # cut where no piece spans the border
                border = [k for k in range(1, len(run)) if (run[k - 1], run[k]) not in self.beside]
                cuts[run] = [run[a:b] for a, b in zip([0, *border], [*border, len(run)])]
        for run, ids in zip(missing, self.segment.encode(missing, num_threads=1)):
            self.known[run] = array("i", ids).tobytes()
        for run, parts in cuts.items():
            self.known[run] = array("i", chain.from_iterable(self.segment.encode(parts, num_threads=1))).tobytes()
        return list(cuts)

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the ids of its pieces, and the first and end byte of what each stands for.

        Of a character given as bytes the last one has its span; the others are empty at its start.
        """
        normal = [self.normalizer.run(t) for t in texts]
        runs = [self.word.findall(new) if self.cuts_at_spaces else [new] if new else [] for new, _ in normal]
        long = self._learn(set(chain.from_iterable(runs)))
        out = []
        for (new, origin), some in zip(normal, runs):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, some)), np.int32)
            if self.bytes:
                end = np.cumsum(self.covers[ids])
                begin = end - self.covers[ids]
            else:
                ids, begin, end = self._with_unknown(ids, new)
            out.append((ids, origin[begin], origin[end]))
        for run in long:
            del self.known[run]
        if len(self.known) > MEMO_WORDS:
            self.known, self.old = {}, self.known
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]

    def _with_unknown(self, ids: np.ndarray, new: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without byte pieces: an unknown piece covers the characters up to the next that is a piece."""
        at, byte, spans = 0, 0, []
        for k in ids.tolist():
            if k != self.unknown:
                spans.append([k, byte, byte + int(self.covers[k])])
                at += self.length[k]
            elif spans and spans[-1][0] == k:
                continue  # a run ended between unknown characters
            else:
                stop = at
                while stop < len(new) and new[stop] not in self.characters:
                    stop += 1
                spans.append([k, byte, byte + len(new[at:stop].encode())])
                at = stop
            byte = spans[-1][2]
        out = np.array(spans, np.int32).reshape(-1, 3)
        return out[:, 0], out[:, 1], out[:, 2]

    def _decode_bytes(self, run: bytes) -> str:
        """Valid characters; each byte that is in none becomes the replacement character."""
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append(BAD)
                at += 1
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces, without the space that encoding put first."""
        parts = [self.surface[k] for k in ids]
        if self.normalizer.prefix or self.normalizer.trim:
            for k, piece in enumerate(ids):
                if piece in self.leading:
                    parts[k] = parts[k][1:]
                    if not self.normalizer.trim:
                        break
                if parts[k]:
                    break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        out, run = [], bytearray()
        for piece, part in zip(ids, parts):
            if piece in self.byte_of:
                run += part
            else:
                out += [self._decode_bytes(bytes(run)), part.decode()]
                run.clear()
        return "".join([*out, self._decode_bytes(bytes(run))])


@functools.lru_cache(2)
def codec(path: str) -> PieceCodec:
    """One codec for each worker process and model file."""
    return PieceCodec(path)


def _lists(parts: list[np.ndarray], offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32, copy=False)))


def _groups(batches: Iterator[pa.Array], size: Callable[[pa.Scalar], int], most: int) -> Iterator[list]:
    """Python values of consecutive rows, about ``most`` by ``size`` in all; fewer rows are held at once."""
    for batch in batches:
        group, held = [], 0
        for scalar in batch:
            value = scalar.as_py()
            group.append(value)
            held += size(value)
            if held >= most:
                yield group
                group, held = [], 0
        if group:
            yield group


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "pieces", decoded: bool = False) -> DataFrame:
    """``docs`` with a struct ``out`` of ids, begins and ends, one entry a piece, in bytes of the text.

    With ``decoded`` the struct also has the text that the ids stand for.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _groups(batches, lambda t: len(t or ""), GROUP_CHARS):
            found = codec(path).encode_all([t or "" for t in texts])
            offsets = np.append(0, np.cumsum([len(f[0]) for f in found], dtype=np.int64))
            fields = {name: _lists([f[k] for f in found], offsets) for k, name in enumerate(("ids", "begins", "ends"))}
            if decoded:
                fields["decoded"] = pa.array([codec(path).decode(f[0].tolist()) for f in found], pa.string())
            yield pa.StructArray.from_arrays(list(fields.values()), names=list(fields))

    kind = PIECES + (", decoded string" if decoded else "")
    return docs.withColumn(out, F.arrow_udf(run, kind).asNondeterministic()(F.col(text)))


def decode(ids: Column, path: str) -> Column:
    """The texts that arrays of ids stand for; null for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in _groups(batches, lambda x: len(x or []), GROUP_CHARS // 4):
            yield pa.array([None if x is None else codec(path).decode(x) for x in some], pa.string())

    return F.arrow_udf(run, "string")(ids)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, end_byte): every text encoded and decoded again.

    ``end_byte`` is where the last piece ends in the text, 0 for texts without pieces.
    """
    coded = encode(docs.select("doc_id", "text"), path, decoded=True)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    ids = F.col("pieces.ids")
    return coded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        sha(F.array_join(ids.cast("array<string>"), ",")).alias("ids_sha256"),
        sha(F.col("pieces.decoded")).alias("decoded_sha256"),
        F.coalesce(F.element_at(F.col("pieces.ends"), F.when(F.size(ids) > 0, F.size(ids))), F.lit(0)).cast("long").alias("end_byte"),
    )

"""Language-model scores: marginal likelihood over subword segmentations.

A word's lattice has an edge for each piece of an existing vocabulary and one for the whole
word.  Piece weights are counted on the distinct words of the training texts, segmented by
the vocabulary's own tokenizer, with one stop for each word, and smoothed.  The lattice
probability of a word is the sum over *all* its segmentations, by a log-space forward
recursion, times the stop.  Characters outside the vocabulary go through byte pieces.  The
edge of the whole word has the word's corpus count c of N training tokens; V distinct ones
weigh the pieces against it, so a token's probability is (c + V p) / (N + V) with lattice
probability p, a text's the product over its words and one end.

The base score (add-one word unigrams) needs the corpus count of every word.  Words that
make up at least one in ``HEAVY`` training tokens (there can't be more than HEAVY of them)
are looked up in a broadcast table; the others are joined by word, where no word is
frequent enough to make a large group.

Edge cases: a null text is empty, so it has one token, the end; null ids don't teach and
count as held out; with nothing to learn from all counts are 0 and pieces are equally
likely, with V taken as 1; repeated ids are separate rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import by_size, materialize

HEAVY = 1 << 16
SMOOTH = 0.1
WORD_START = "▁"
MEMO_WORDS = 400_000
FLUSH_WORDS = 600_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(2)
def _processor(path: str):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _tokens(text: str | None) -> list[bytes]:
    # bytes.lower and bytes.split know exactly A-Z and the six white space characters
    return (text or "").encode().lower().split()


def _count_words(batches):
    found: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    for batch in by_size(batches, "text"):
        for text in batch["text"].to_pylist():
            found.update(_tokens(text))
            if len(found) > FLUSH_WORDS:
                yield flush()
                found.clear()
    yield flush()


def _count_pieces(path: str):
    def run(batches):
        sp = _processor(path)
        total = np.zeros(sp.get_piece_size())
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch["word"].to_pylist()]
            ids = sp.encode(words, num_threads=1)
            total += np.bincount(np.fromiter(itertools.chain.from_iterable(ids), np.int64), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])

    return run


class PieceModel:
    """Natural-log probabilities of pieces and of the stop at a word's end."""

    def __init__(self, path: str, counts: np.ndarray, ends: float):
        sp = _processor(path)
        kept = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k))]
        total = counts[kept].sum() + ends + SMOOTH * (len(kept) + 1)
        self.end = math.log((ends + SMOOTH) / total)
        pieces = {sp.id_to_piece(k): math.log((counts[k] + SMOOTH) / total) for k in kept if not sp.is_byte(k)}
        self.byte = {int(sp.id_to_piece(k)[3:5], 16): math.log((counts[k] + SMOOTH) / total) for k in kept if sp.is_byte(k)}
        self.char = {p: lp for p, lp in pieces.items() if len(p) == 1}
        self.longest = max(map(len, pieces))
        by_length: dict[int, list] = {}
        for p, lp in pieces.items():
            by_length.setdefault(len(p), []).append((p, lp))
        self.table = {}
        for size, some in by_length.items():
            if size == 1:
                continue
            keys = self._hash(np.array([[ord(c) for c in p] for p, _ in some], np.uint64))
            order = np.argsort(keys)
            self.table[size] = keys[order], np.array([lp for _, lp in some])[order]

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        h = np.zeros(chars.shape[0], np.uint64)
        for k in range(chars.shape[1]):
            h = PieceModel._extend(h, chars[:, k])
        return h

    @staticmethod
    def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h + c + np.uint64(1)) * _PRIME
        return h ^ (h >> np.uint64(29))

    def _char(self, c: str) -> float:
        found = self.char.get(c)
        return sum(self.byte[b] for b in c.encode("utf-8", "surrogatepass")) if found is None else found

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, summed over its segmentations, without the stop."""
        out = np.empty(len(words))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(k)
        for n, at in by_length.items():
            step = max(1, (1 << 18) // n)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                out[some] = self._lattice(["".join((WORD_START, words[j])) for j in some], n)
        return out

    def _lattice(self, words: list[str], n: int) -> np.ndarray:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n)
        unique, place = np.unique(chars, return_inverse=True)
        single = np.array([self._char(chr(c)) for c in unique])[place.reshape(chars.shape)]
        most = min(n, self.longest)
        wide = chars.astype(np.uint64)
        weight = [None, single]
        h = self._extend(np.zeros_like(wide), wide)
        for size in range(2, most + 1):
            h = self._extend(h[:, : n - size + 1], wide[:, size - 1 :])
            if size not in self.table:
                weight.append(None)
                continue
            keys, lp = self.table[size]
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            weight.append(np.where(keys[at] == h, lp[at], -np.inf))
        alpha = np.full((n + 1, len(words)), -np.inf)
        alpha[0] = 0.0
        for end in range(1, n + 1):
            value = alpha[end - 1] + single[:, end - 1]
            for size in range(2, min(most, end) + 1):
                if weight[size] is not None:
                    value = np.logaddexp(value, alpha[end - size] + weight[size][:, end - size])
            alpha[end] = value
        return alpha[n]


def _score(shared, heavy_shared, n_tokens: int, n_words: int, end_count: int):
    def run(batches):
        model, heavy = shared.value, heavy_shared.value
        memo: dict[bytes, float] = {}
        row, ln10, floor, kinds = TaskContext.get().partitionId() << 33, math.log(10), math.log10(n_tokens + n_words + 1), max(n_words, 1)
        whole = math.log10(n_tokens + kinds)
        end = math.log10(end_count + kinds * math.exp(model.end)) - whole
        for batch in by_size(batches, "text"):
            bags = [Counter(_tokens(t)) for t in batch["text"].to_pylist()]
            if len(memo) > MEMO_WORDS:
                memo.clear()
            new = list(set().union(*bags).difference(memo))
            memo.update(zip(new, ((model.words([w.decode("utf-8", "replace") for w in new]) + model.end) / ln10).tolist()))
            out = [[] for _ in range(8)]
            for bag in bags:
                score, base, known, tokens = end, math.log10(end_count + 1) - floor, int(end_count > 0), 1
                rare, times, chances = [], [], []
                for word, k in bag.items():
                    tokens += k
                    c = heavy.get(word)
                    if c is None:
                        rare.append(word)
                        times.append(k)
                        chances.append(memo[word])
                    else:
                        base += k * (math.log10(c + 1) - floor)
                        score += k * (math.log10(c + kinds * 10 ** memo[word]) - whole)
                        known += k
                for column, value in zip(out, (row, tokens, score, base, known, rare, times, chances)):
                    column.append(value)
                row += 1
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.float32()))
            names = ["row", "n_tokens", "score", "base", "known", "words", "times", "chances"]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *made.columns], names=["doc_id", "held_out", *names])

    return run


def score_documents(docs: DataFrame, held_out: Column, vocabulary: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from rows where ``held_out`` is false; ``vocabulary`` is a sentencepiece file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), "text")
    train = rows.where(~F.col("held_out"))
    counts = train.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "word-counts")
    ends = train.count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    pieces = np.zeros(_processor(vocabulary).get_piece_size())
    # one row for each piece of the vocabulary at most
    for r in counts.mapInArrow(_count_pieces(vocabulary), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        pieces[r["piece"]] = r["n"]
    model = spark.sparkContext.broadcast(PieceModel(vocabulary, pieces, ends))
    # HEAVY words at most: each has a HEAVY-th of the tokens or more
    heavy = counts.where(F.col("n") * HEAVY >= n)
    heavy_words = {bytes(r["word"]): r["n"] for r in heavy.toLocalIterator()}
    heavy_words = spark.sparkContext.broadcast(heavy_words)
    schema = "doc_id long, held_out boolean, row long, n_tokens long, score double, base double, known long, words array<binary>, times array<int>, chances array<float>"
    scored = materialize(rows.mapInArrow(_score(model, heavy_words, n, v, ends), schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times", "chances")).alias("x")).select("row", F.col("x.words").alias("word"), "x.times", F.col("x.chances").cast("double").alias("chance"))
    light = counts.where(F.col("n") * HEAVY < n)
    c = F.coalesce(F.col("n"), F.lit(0))
    kinds = float(max(v, 1))
    chance = F.when(c == 0, F.col("chance") + math.log10(kinds)).otherwise(F.log10(c + kinds * F.pow(F.lit(10.0), "chance")))
    part = rare.join(light, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(c + 1) - math.log10(n + v + 1))).alias("rare_base"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * (chance - math.log10(n + kinds))).alias("rare_score"),
    )
    whole = scored.drop("words", "times", "chances").join(part, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )

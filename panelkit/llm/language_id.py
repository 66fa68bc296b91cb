"""Language identification by mixture inference.

Learning counts byte trigrams of each language's texts in ``BUCKETS`` hashed cells.  A
document is taken as a mixture: each of its trigrams comes from one of the languages, in
unknown proportions.  Expectation maximisation estimates the proportions; the set of
languages is the one whose likelihood, less a penalty for each further language, is
highest.  The prediction is the language with the largest proportion in that set, the
score that proportion.

The learned table has BUCKETS numbers for each language, whatever the input; it is all
that reaches the driver.

Edge cases: a null text, or one with no letter, gives ``und`` with score 0, as does any
text when nothing could be learned; rows with null language or null text don't teach; ties
go to the language that sorts first; null or repeated ids are separate rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import by_size, give_back

BUCKETS = 1 << 16
UNKNOWN = "und"
ROUNDS = 25
#: Likelihood that a further language must add, in units of the log of the text's trigrams.
#: Trigrams overlap, so each character counts three times; the usual half is raised for that.
PENALTY = 4.0


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text between spaces; words are marked off by them."""
    b = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch in by_size(batches, "text"):
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            if lang not in total:
                total[lang] = np.zeros(BUCKETS, np.int64)
            total[lang] += np.bincount(trigrams(text), minlength=BUCKETS) if len(text) > 20_000 else 0
            if len(text) <= 20_000:
                cells, n = np.unique(trigrams(text), return_counts=True)
                total[lang][cells] += n
    for lang, counts in total.items():
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells)), pa.array(cells, pa.int32()), pa.array(counts[cells], pa.int64())], names=["lang", "cell", "n"])


class LanguageModel:
    """Trigram probabilities of each language, add-one-half smoothed."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.prob = (smooth / smooth.sum(axis=0)).astype(np.float64) if len(languages) else smooth

    def mixture(self, prob: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the languages (columns of ``prob``) and the log likelihood."""
        share = np.full(prob.shape[1], 1.0 / prob.shape[1])
        for _ in range(ROUNDS if prob.shape[1] > 1 else 1):
            weighted = prob * share
            each = weighted.sum(axis=1)
            new = (n / each) @ weighted / n.sum()
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(prob @ share))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        cells, n = np.unique(trigrams(text), return_counts=True)
        prob, n = self.prob[cells], n.astype(np.float64)
        share, _ = self.mixture(prob, n)
        order = np.argsort(-share, kind="stable")
        single = n @ np.log(prob)
        # the best single language starts; further ones come in the order of their share
        first = int(np.argmax(single))
        order = np.array([first, *(k for k in order if k != first)])
        best, price = (np.array([1.0]), float(single[first]), 1), PENALTY * np.log(max(2.0, n.sum()))
        for k in range(2, len(order) + 1):
            part, likelihood = self.mixture(prob[:, order[:k]], n)
            if likelihood - price * (k - 1) <= best[1] - price * (best[2] - 1):
                break
            best = part, likelihood, k
        top = int(np.argmax(best[0]))
        return self.languages[order[top]], float(best[0][top])


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from all rows of ``docs`` that have a text and a language."""
    known = docs.where("text is not null and lang is not null").select("lang", "text")
    counted = known.mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = counted.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).toArrow()
    languages = sorted(table["lang"].to_pylist())
    counts = np.zeros((BUCKETS, len(languages)))
    for lang, cells in zip(table["lang"].to_pylist(), table["cells"]):
        flat = cells.values
        counts[flat.field("cell").to_numpy(), languages.index(lang)] = flat.field("n").to_numpy()
    return LanguageModel(languages, counts)


def with_prediction(docs: DataFrame, model: LanguageModel, out: str) -> DataFrame:
    """``docs`` with a struct column ``out`` of lang_pred and score.

    Only the texts go to Python; all other columns stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            found = [shared.value.predict(t.as_py()) for t in some]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])
        give_back()

    # taken for not deterministic, so that a filter on it doesn't run it a second time
    told = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()
    return docs.withColumn(out, told(F.col("text")))


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from rows where ``held_out`` is false."""
    flagged = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    model = fit(flagged.where(~F.col("held_out")))
    return with_prediction(flagged, model, "told").select("doc_id", "held_out", "told.lang_pred", "told.score")

"""Quality rules with risk-controlled thresholds.

Each rule is a number that is high for bad texts, and a cutoff above which a text is
rejected.  Cutoffs come from a labelled holdout.  For each stratum (language) and rule the
cutoffs of a fixed grid are tested from the loosest on: of n good documents the cutoff
rejects k, and the test asks whether so few would be seen if the true rate of false
rejections were the rule's share of ``risk``, by the exact binomial lower tail P(X <= k).
A cutoff is safe if that is at most ``error`` over the number of sequences (strata x
rules; Bonferroni).  Cutoffs are nested and tested in a fixed order, so a sequence needs
no further correction for its grid.  With probability 1 - ``error`` all chosen cutoffs are
safe at once, and a stratum loses at most ``risk`` of its good documents to all rules
together.  Among safe cutoffs the one whose rejection rates of bad and good documents
differ most is used, the loosest of equals; where none is safe, as with few labels, the
rule does not reject.

Only DataFrame functions are used: texts are read once, every later step works on numbers.

Edge cases: a null text has no words and fails the base rules; null language is a stratum
of its own; documents without label, or whose stratum has no labels, are judged by the
base rules alone; several labels of an id count each; null ids match no label; repeated
ids are separate rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import SPACE, materialize

RISK = 0.02
ERROR = 0.05
GRID = 64


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", text.alias("t"))
    d = d.withColumn("w", F.array_remove(F.split("t", f"[{SPACE}]+"), ""))
    n = F.size("w")
    # each window of three words as a hash; a document without equal windows is done here
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(F.col("w"), 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    d = d.withColumn("h", windows)
    equal = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(equal, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = lambda x, k: (x["h"] == F.get("s", k - 1)["h"]) | F.coalesce(x["h"] == F.get("s", k + 1)["h"], F.lit(False))
    first = lambda x, k: F.when(k > 0, twice(x, k)).otherwise(F.coalesce(x["h"] == F.get("s", k + 1)["h"], F.lit(False)))
    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s", first), lambda x: x["i"])))
    covered = F.aggregate(
        F.coalesce("p", F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.regexp_replace(x, f"[{SPACE}]+", "")) > 0)
    d = d.withColumn("lines", lines)
    kept = lambda drop: F.char_length(F.regexp_replace("t", drop, ""))
    return d.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        kept(f"[{SPACE}]+").cast("long").alias("word_chars"),
        (F.char_length("t") - kept(r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.char_length("t") - kept(r"[!?]+")).cast("long").alias("n_marks"),
    )


def base_failed(least_words: int = 50, most_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))


def rules() -> dict[str, tuple[Column, float]]:
    """Rules: a document's number, and the cutoff at the last grid point."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": (F.col("n_symbols") / words, 1.0),
        "marks": (F.col("n_marks") / words, 1.0),
        "repeats": (F.col("n_repeat_words") / words, 0.5),
        "dup_lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 1.0),
    }


def _log_gamma(x: Column) -> Column:
    """log Gamma for x >= 1, by Stirling's series eight steps up."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    down = F.log(x)
    for k in range(1, 8):
        down = down + F.log(x + float(k))
    return series - down


def binomial_tail(k: Column, n: Column, rate: float, terms: int = 400) -> Column:
    """P(X <= k) for X binomial(n, rate), for k below n * rate; 1 otherwise.

    Terms fall from k downwards by at least the ratio between the first two.  ``terms`` of
    them are added; if there are more, the geometric bound on the rest is added too, so the
    value is never too low.
    """
    k, n = k.cast("double"), n.cast("double")
    log_first = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate))
    odds = (1 - rate) / rate
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int"))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    added = F.aggregate(steps, zero, lambda acc, j: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * (k - j) / (n - k + j + 1.0) * odds).alias("term")))
    ratio = F.least(k / (n - k + 1.0) * odds, F.lit(1 - 1e-12))
    total = F.exp(log_first) * (added["sum"] + added["term"] / (1.0 - ratio))
    return F.when((k < n * rate) & (n > 0), F.least(total, F.lit(1.0))).otherwise(F.lit(1.0))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, one column of the chosen grid point for each rule).

    ``labels`` has doc_id and quality, 1 good and 0 bad.
    """
    labelled = measured.join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id").where(~base_failed())
    names = list(rules())
    # the least grid point that a document would not be rejected at
    cell = lambda rule: F.least(F.ceil(rule[0] / rule[1] * GRID), F.lit(GRID + 1)).cast("int")
    by_rule = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), cell(r).alias("cell")) for name, r in rules().items()]))
    cells = labelled.select("lang", "quality", by_rule.alias("x")).groupBy("lang", "x.rule", "x.cell").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    # from here on: strata x rules x grid rows
    tests = cells.groupBy("lang", "rule").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("cell", "good", "bad")).alias("cells"))
    tests = tests.withColumn("sequences", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("point", F.explode(F.sequence(F.lit(1), F.lit(GRID))))
    above = lambda what: F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["cell"] > F.col("point"), c[what]).otherwise(F.lit(0)))
    tests = tests.withColumn("k", above("good")).withColumn("caught", above("bad"))
    safe = binomial_tail(F.col("k"), F.col("n"), risk / len(names)) <= F.lit(error) / F.col("sequences")
    gain = F.col("caught") / F.greatest("n_bad", F.lit(1)) - F.col("k") / F.greatest("n", F.lit(1))
    chosen = tests.where(safe).groupBy("lang", "rule").agg(F.max(F.struct(gain.alias("gain"), "point"))["point"].alias("point"))
    return chosen.groupBy("lang").pivot("rule", names).agg(F.min("point"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Measures of every row with base_failed and kept."""
    measured = materialize(measures(docs), "measures")
    chosen = materialize(cutoffs(measured, labels, risk, error), "cutoffs")
    chosen = chosen.withColumnRenamed("lang", "stratum")
    # one row for each language that has labels
    judged = measured.join(F.broadcast(chosen) if chosen.count() <= 10_000 else chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    rejected = F.lit(False)
    for name, (number, last) in rules().items():
        rejected = rejected | F.coalesce(number > F.col(name) * (last / GRID), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~rejected).alias("kept"),
    )

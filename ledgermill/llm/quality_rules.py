"""Quality rules with robust multivariate outliers: a minimum-covariance-determinant estimate per language and source.

Only DataFrame and SQL functions run. Counts of a text (words, symbols, repeated lines, repeated 3-word windows) come
from array functions on its own row. A vector of transformed statistics then meets a robust centre and scatter of its
(lang, source) group. Concentration steps keep the nearest three quarters of the rows and take mean and covariance anew.
They start from coordinate medians with median deviations, and from mean and covariance of all rows; after FIRST steps
the start of the lesser determinant goes on alone, until no group's determinant falls any more (or MOST_STEPS). A row is
rejected where its squared Mahalanobis distance is beyond CUTOFF. Quantiles come from counted buckets, so a group with a
third of all rows is aggregated in every task before it is shuffled, and results do not depend on the partitions. Groups'
estimates are broadcast while there are at most MOST_GROUPS of them, and joined beyond that.

Cases: null text counts as empty and fails the base rules; null lang and null source are groups of their own; a group of
fewer than LEAST rows that pass the base rules is judged with its language's other small groups, then with all such; if
those are fewer too, the base rules decide alone. Equal rows get equal verdicts. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fields, save

#: Rows that a group needs, the share that a concentration step keeps, steps from all starts and in all, the fall of a
#: determinant that asks for another step, and the largest distance squared that stays (a chi-squared of five degrees
#: passes 50 once in 700 million).
LEAST, KEEP, FIRST, MOST_STEPS, FALL, CUTOFF = 50, 0.75, 2, 8, 1.02, 50.0
#: Groups whose estimates are broadcast: some 30 numbers each.
MOST_GROUPS = 50_000
#: Fixed value: the covariance of the nearest 3/4 of five normal variables, times this, is that of all.
CONSISTENCY = 1.41
#: The statistics and the standard deviation that each has at least: below it differences don't matter.
STATISTICS = {"x_chars": 0.06, "x_symbols": 0.06, "x_lines": 0.12, "x_repeats": 0.12, "x_length": 0.5}
NAMES = list(STATISTICS)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts, n_lines and base_failed of every whole text."""
    t = fields(docs, "doc_id", "lang", "source", "text").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("t"))
    t = t.select("*", F.array_remove(F.split("t", SPACE), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    t = t.select(
        "doc_id", "lang", "source", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # 64-bit hashes stand for 3-word windows within one text
    t = t.withColumn("h", F.expr("slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, greatest(size(w) - 2, 0))"))
    t = t.withColumn("s", F.expr("if(size(array_distinct(h)) = size(h), cast(null as array<struct<h: bigint, i: int>>), sort_array(transform(h, (x, i) -> struct(x as h, i as i))))"))
    t = t.withColumn("p", F.expr("sort_array(transform(filter(s, (x, i) -> x.h <=> get(s, i - 1).h or x.h <=> get(s, i + 1).h), x -> x.i))"))
    repeats = F.expr("coalesce(aggregate(p, struct(-3 as last, 0L as n), (a, x) -> struct(x as last, a.n + least(3, x - a.last) as n), a -> a.n), 0L)")
    t = t.select("doc_id", "lang", "source", *[c for c in BASE if c != "n_repeat_words"], "n_lines", repeats.alias("n_repeat_words"))
    return t.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def statistics(c: DataFrame) -> DataFrame:
    """The transformed statistic vector: logarithms of sizes, square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return c.select(
        "*",
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("x_chars"),
        F.sqrt(F.col("n_symbols") / n).alias("x_symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x_repeats"),
        F.log(n).alias("x_length"),
    )


def _names(x: DataFrame) -> DataFrame:
    """g0 (lang and source), g (the group that judges its rows) and fit, whether g has rows enough for an estimate."""
    small = x.filter(~F.col("base_failed")).groupBy("g0", "g1").count().withColumn("own", F.col("count") >= LEAST)
    pooled = small.withColumn("g2", F.when(F.col("own"), F.col("g0")).otherwise(F.col("g1")))
    size = lambda c: F.sum("count").over(Window.partitionBy(c))
    pooled = pooled.withColumn("g", F.when(size("g2") >= LEAST, F.col("g2")).otherwise(F.lit("*")))
    return pooled.withColumn("fit", size("g") >= LEAST).select("g0", "g", "fit")


def _quantile(df: DataFrame, keys: list[str], bucket: Column, q: float) -> DataFrame:
    """For each key the least bucket below or in which q of the rows are; the window runs over counts of buckets."""
    counted = df.groupBy(*keys, bucket.alias("b")).count()
    w = Window.partitionBy(*keys)
    seen = counted.select(*keys, "b", F.sum("count").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("count").over(w).alias("all"))
    return seen.filter(F.col("upto") >= q * F.col("all")).groupBy(*keys).agg(F.min("b").alias("cut"))


def _medians(good: DataFrame, small) -> DataFrame:
    """Medians, and a diagonal scatter of median deviations, of each statistic and group."""
    long = good.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(n).alias("v")) for i, n in enumerate(NAMES)])).alias("e")).select("g", "e.k", "e.v")
    middle = save(_quantile(long, ["g", "k"], F.round(F.col("v") * 200), 0.5).select("g", "k", (F.col("cut") / 200).alias("m")), "rules-medians")
    away = long.join(small(middle), ["g", "k"]).select("g", "k", F.abs(F.col("v") - F.col("m")).alias("a"))
    spread = _quantile(away, ["g", "k"], F.round(F.col("a") * 200), 0.5).select("g", "k", (F.col("cut") / 200).alias("d"))
    pick = lambda c, i: F.max(F.when(F.col("k") == i, F.col(c)))
    out = middle.join(spread, ["g", "k"]).groupBy("g").agg(*[pick("m", i).alias(f"m{i}") for i in range(len(NAMES))], *[pick("d", i).alias(f"d{i}") for i in range(len(NAMES))])
    scatter = [(F.pow(F.col(f"d{i}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(len(NAMES)) for j in range(i + 1)]
    return _factored(out.select("g", F.lit(0).alias("s"), *[f"m{i}" for i in range(len(NAMES))], *scatter))


def _moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Means and covariances (times scale) of each key's rows."""
    k = range(len(NAMES))
    sums = rows.groupBy(*keys).agg(*[F.avg(NAMES[i]).alias(f"m{i}") for i in k], *[F.avg(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"e{i}{j}") for i in k for j in range(i + 1)])
    scatter = [((F.col(f"e{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale).alias(f"c{i}{j}") for i in k for j in range(i + 1)]
    return _factored(sums.select(*keys, *[f"m{i}" for i in k], *scatter))


def _factored(p: DataFrame) -> DataFrame:
    """Cholesky factors l_ij of the scatter matrices, whose variances have their floors added, and the log determinant."""
    for i in range(len(NAMES)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(list(STATISTICS.values())[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            p = p.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = sum((2 * F.log(f"l{i}{i}") for i in range(1, len(NAMES))), 2 * F.log("l00"))
    return p.withColumn("log_det", log_det).drop(*[f"c{i}{j}" for i in range(len(NAMES)) for j in range(i + 1)])


def _distance(x: DataFrame, p: DataFrame, keys: list[str], small) -> DataFrame:
    """x with d2, the squared Mahalanobis distance by forward substitution; null where the group has no estimate."""
    x = x.join(small(p), keys, "left")
    for i, n in enumerate(NAMES):
        rest = F.col(n) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        x = x.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(NAMES))), F.col("z0") * F.col("z0"))
    return x.withColumn("d2", d2).drop(*[c for c in p.columns if c not in keys], *[f"z{i}" for i in range(len(NAMES))])


def _step(good: DataFrame, p: DataFrame, starts: list[int], small) -> DataFrame:
    """One concentration step from each start: the nearest KEEP of each group give the next mean and covariance."""
    tried = good.withColumn("s", F.explode(F.array(*map(F.lit, starts))))
    near = _distance(tried, p, ["g", "s"], small).withColumn("b", F.floor(F.log(F.col("d2") + 1e-6) * 16))
    cut = save(_quantile(near, ["g", "s"], F.col("b"), KEEP), "rules-cut")
    return save(_moments(near.join(small(cut), ["g", "s"]).filter(F.col("b") <= F.col("cut")), ["g", "s"], CONSISTENCY), "rules-fit")


def estimate(good: DataFrame, small=F.broadcast) -> DataFrame:
    """Centre m_i and Cholesky factor l_ij of each group g of vectors: of two starts the one of the lesser determinant."""
    p = save(_medians(good, small).unionByName(_moments(good.withColumn("s", F.lit(1)), ["g", "s"], 1.0)), "rules-fit")
    for _ in range(FIRST):
        p = _step(good, p, [0, 1], small)
    one = F.struct("log_det", "s", *[c for c in p.columns if c not in ("g", "s", "log_det")])
    p = save(p.groupBy("g").agg(F.min(one).alias("p")).select("g", "p.*").withColumn("s", F.lit(0)), "rules-fit")
    for _ in range(MOST_STEPS - FIRST):
        new = _step(good, p, [0], small)
        fell = new.join(p.select("g", F.col("log_det").alias("old")), "g").agg(F.max(F.col("old") - F.col("log_det"))).first()[0]
        # a step that doesn't lessen a group's determinant is not taken
        better = F.col("new.log_det") < F.col("old.log_det")
        kept = new.alias("new").join(p.alias("old"), "g").select("g", *[F.when(better, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in p.columns if c != "g"])
        p = save(kept, "rules-fit")
        if fell is None or fell <= math.log(FALL):
            break
    return p.drop("s", "log_det")


def judge(docs: DataFrame) -> DataFrame:
    """Every document's counts, base_failed, its squared distance (null without an estimate) and kept."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    x = statistics(counts(docs)).withColumn("g0", F.concat_ws("\x01", name("lang"), name("source"))).withColumn("g1", name("lang"))
    x = save(x.select("doc_id", *BASE, "base_failed", "g0", "g1", *NAMES), "rules-vectors")
    names = save(_names(x), "rules-groups")
    small = F.broadcast if names.count() <= MOST_GROUPS else (lambda df: df)
    x = x.join(small(names), "g0", "left").drop("g0", "g1")
    p = estimate(x.filter(~F.col("base_failed") & F.col("fit")).select("g", *NAMES), small)
    out = _distance(x, p, ["g"], small)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)
    return out.select("doc_id", *BASE, "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))

"""Temperature mixing of sources, realised as budgeted block permutations; DataFrame and SQL functions alone.

Token shares p of the sources become weights p**a / sum(p**a). The exponent a in [0, 1] is found by bisection: the
largest whose entropy is still the target share of log(number of sources), raised where some source would otherwise be
repeated beyond the limit (the limit wins). A source's weight times the budget is its quota of tokens. Its documents
lie in blocks of bounded size; each epoch permutes the blocks by a keyed hash, documents keep a hashed order in their
block, and the stream of epochs is cut where the quota is met, at whole documents. Only sums of stretches of blocks
meet in a window over a source; blocks meet in windows over a stretch, documents in windows over a block.

Cases: null text counts as empty; null source is a source of its own; a source without tokens has weight 0 and its
documents come once; rows with the same doc_id come each; ties of the hash are ordered by size; an empty table gives no
rows; other columns are ignored. The sources' totals lie in one row: 8 bytes a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fields, save

#: About how many documents a block has, halvings of the exponent's interval, and hexadecimal digits of the blocks' order
#: that make a stretch of it (16**STRETCH stretches a source at most).
BLOCK_DOCS, HALVINGS, STRETCH = 1000, 40, 3

_ENTROPY = """(aggregate(p, struct(0D as z, 0D as e), (s, x) -> struct(s.z + pow(x, {a}) as z, s.e + pow(x, {a}) * ln(x) as e),
    s -> ln(s.z) - {a} * s.e / s.z))"""
_MOST = "(array_max(transform(p, x -> pow(x, {a} - 1))) * {budget} / (total * aggregate(p, 0D, (s, x) -> s + pow(x, {a}))))"


def _bisect(low_if: str) -> str:
    """The interval's lower and upper end after all halvings; low_if: the lower end moves to the middle where it holds."""
    middle = "((b.lo + b.hi) / 2)"
    cond = low_if.replace("{a}", middle)
    return f"aggregate(sequence(1, {HALVINGS}), struct(0D as lo, 1D as hi), (b, i) -> if({cond}, struct({middle} as lo, b.hi as hi), struct(b.lo as lo, {middle} as hi)))"


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, a hash of the text, and its words."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")).cast("long")
    return fields(docs, "doc_id", "source", "text").select("doc_id", "source", F.xxhash64("text").alias("text_key"), words.alias("n_tokens"))


def weights(sources: DataFrame, budget_share: float, entropy: float, repeats: float) -> DataFrame:
    """source (null-safe key s), its tokens, exponent, weight and quota from totals (s, tokens, n_docs)."""
    positive = F.when(F.col("tokens") > 0, F.col("tokens").cast("double"))
    total = sources.agg(F.sum("tokens").cast("double").alias("total"), F.sort_array(F.collect_list(positive)).alias("sizes"))
    one = total.select("total", F.transform("sizes", lambda x: x / F.col("total")).alias("p"), (F.col("total") * budget_share).alias("budget"))
    by_entropy = _bisect(f"{_ENTROPY} >= {entropy}D * ln(size(p))")
    repeats = min(repeats, 1e300)
    by_repeats = _bisect(f"{_MOST.replace('{budget}', 'budget')} > {repeats}D")
    one = one.select("*", F.expr(f"if({_ENTROPY.replace('{a}', '1D')} >= {entropy}D * ln(size(p)), 1D, ({by_entropy}).lo)").alias("a1"), F.expr(f"if({_MOST.replace('{a}', '0D').replace('{budget}', 'budget')} <= {repeats}D, 0D, ({by_repeats}).hi)").alias("a2"))
    one = one.select("total", "budget", F.greatest("a1", "a2").alias("exponent"), "p").withColumn("z", F.expr("aggregate(p, 0D, (s, x) -> s + pow(x, exponent))"))
    found = one.select("total", "budget", "exponent", "z").first()  # four numbers
    total, budget, exponent, z = (F.lit(x) for x in found)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, exponent) / z).otherwise(F.lit(0.0))
    return sources.select("s", "tokens", "n_docs", exponent.alias("exponent"), weight.alias("weight"), F.coalesce(F.round(weight * budget), F.lit(0.0)).alias("quota"))


def _counted(docs: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their counts, source key s and hash h that orders them; totals (s, tokens, n_docs). Both are saved."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    unnamed = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))  # rows without doc_id, however many, lie in many blocks
    d = token_counts(docs).select("*", key.alias("s"), F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), unnamed)).cast("binary")).alias("h"))
    d = save(d, "mix-counts")
    return d, save(d.groupBy("s").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "mix-totals")


def mix(docs: DataFrame, budget_share: float = 1.0, entropy: float = 0.95, repeats: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row for each time that a document is used: epoch, block, stream_offset (its source's tokens before it) and
    position in [0, 1): ordering all rows by position interleaves the sources at their weights."""
    return _placed(*_counted(docs, seed), budget_share, entropy, repeats, seed)


def _placed(d: DataFrame, totals: DataFrame, budget_share: float, entropy: float, repeats: float, seed: str) -> DataFrame:
    totals = save(weights(totals, budget_share, entropy, repeats), "mix-weights")
    blocks = F.ceil(F.col("n_docs") / BLOCK_DOCS).cast("long")
    block = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), blocks)
    d = d.join(totals, "s").select("s", "doc_id", "source", "text_key", "n_tokens", "h", block.alias("block"), "weight")
    sizes = d.groupBy("s", "block").agg(F.sum("n_tokens").alias("size"))
    epochs = sizes.join(totals, "s").select("s", "block", "size", "tokens", "quota", F.explode(F.sequence(F.lit(0), F.coalesce(F.floor(F.try_divide("quota", "tokens")), F.lit(0)).cast("int"))).alias("epoch"))
    order = F.md5(F.concat_ws("|", F.lit(seed), "s", "block", "epoch").cast("binary"))
    # prefix sums in two steps, so that no window has all blocks of a source: within stretches of the order, and over stretches
    epochs = epochs.withColumn("order", order).withColumn("stretch", F.substring("order", 1, STRETCH))
    stretches = epochs.groupBy("s", "epoch", "stretch").agg(F.sum("size").alias("size"))
    earlier = F.sum("size").over(Window.partitionBy("s", "epoch").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    stretches = stretches.select("s", "epoch", "stretch", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    before = F.sum("size").over(Window.partitionBy("s", "epoch", "stretch").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1))
    epochs = epochs.withColumn("before", F.coalesce(before, F.lit(0))).join(stretches, ["s", "epoch", "stretch"])
    epochs = epochs.select("s", "block", "epoch", "quota", (F.col("epoch") * F.col("tokens") + F.col("earlier") + F.col("before")).alias("block_offset"))
    epochs = epochs.filter(F.col("block_offset") <= F.col("quota"))
    within = F.sum("n_tokens").over(Window.partitionBy("s", "block").orderBy("h", "n_tokens", "text_key").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("within", F.coalesce(within, F.lit(0)))
    out = d.join(epochs, ["s", "block"]).withColumn("stream_offset", F.col("block_offset") + F.col("within"))
    out = out.filter(F.col("stream_offset") + F.col("n_tokens") <= F.col("quota"))
    position = F.coalesce(F.try_divide(F.col("stream_offset").cast("double"), F.col("quota")), F.lit(0.0))
    return out.select("doc_id", "source", "text_key", "epoch", "block", "stream_offset", "n_tokens", "weight", position.alias("position"))


def whole_share(totals: DataFrame, entropy: float, least: float) -> float:
    """The largest budget, as a share of all tokens and `least` at least, whose mix needs no source twice: 1 where the
    natural mix meets the entropy target, else the least ratio of a source's share to its tempered weight."""
    tempered = weights(totals, 1.0, entropy, float("inf")).filter("weight > 0")
    ratio = tempered.agg(F.sum("tokens").alias("total"), F.min(F.col("tokens") / F.col("weight")).alias("least")).first()
    share = ratio["least"] / ratio["total"] if ratio["total"] else 1.0
    return 1.0 if share > 1 - 1e-9 else max(least, share)


def sample_once(docs: DataFrame, entropy: float = 0.95, least: float = 0.5, seed: str = "mix") -> DataFrame:
    """The rows of docs, with all columns, that a mix without repetition uses, over the largest budget that needs none.

    Rows are told apart by doc_id, source and text; null ones as well.
    """
    d, totals = _counted(docs, seed)
    share = whole_share(totals, entropy, least)
    if share == 1.0:
        return docs
    used = _placed(d, totals, share, entropy, 1.0, seed).filter("epoch = 0").select(*[F.col(c).alias(f"used_{c}") for c in ("doc_id", "source", "text_key")])
    same = docs["doc_id"].eqNullSafe(F.col("used_doc_id")) & docs["source"].eqNullSafe(F.col("used_source")) & (F.xxhash64(docs["text"]) == F.col("used_text_key"))
    return docs.join(used, same, "left_semi")

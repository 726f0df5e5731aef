"""Which pages of a document are worth reading: Okapi BM25 of each page within its own document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import any_of, tokens
from ..lineage import keep, once
from .vectors import Index

#: Okapi's constants, the share of the mean idf that stands for negative ones, and the cut below the best page.
K1, B, EPSILON, CUT = 1.5, 0.75, 0.25, 0.4


def bm25(pages: DataFrame, query: list[str] | None = None) -> DataFrame:
    """doc_id, page, score of (doc_id, page, text); idf is ln(N - df + 0.5) - ln(df + 0.5) within the document, negative
    ones become a quarter of the document's mean idf.

    Query terms are counted within their page's row. Only documents with a negative idf need the mean over all their
    words: those are counted by document and word, then by how many pages have them, and no table of words meets pages.
    """
    wanted = [*(query or K.QUERY_TERMS), K.DATE_HIT]
    words = tokens(F.col("text"))
    counted = once(pages.select("doc_id", "page", "text"), words=words).drop("text")
    tf = [(F.size("words") - F.size(F.array_remove("words", t))).alias(f"tf{i}") for i, t in enumerate(wanted)]
    counted = keep(counted.select("doc_id", "page", F.size("words").alias("size"), *tf), "page-counts")  # statistics and scores read it
    idf = lambda n, df: F.log(n - df + 0.5) - F.log(df + 0.5)
    stats = counted.groupBy("doc_id").agg(F.count("*").alias("pages"), F.avg("size").alias("mean_size"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    stats = stats.select("doc_id", "pages", "mean_size", *[F.when(F.col(f"df{i}") > 0, idf(F.col("pages"), F.col(f"df{i}"))).alias(f"raw{i}") for i in range(len(wanted))])
    stats = keep(stats, "page-statistics")
    negative = stats.filter(any_of([F.coalesce(F.col(f"raw{i}") < 0, F.lit(False)) for i in range(len(wanted))])).select("doc_id", "pages")
    terms = pages.join(negative.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(words)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    means = terms.groupBy("doc_id", "df").agg(F.count("*").alias("n")).join(negative, "doc_id").groupBy("doc_id").agg((F.sum(idf(F.col("pages"), F.col("df")) * F.col("n")) / F.sum("n") * EPSILON).alias("floor"))
    known = stats.join(means, "doc_id", "left").select("doc_id", "mean_size", *[F.when(F.col(f"raw{i}") < 0, F.col("floor")).otherwise(F.col(f"raw{i}")).alias(f"idf{i}") for i in range(len(wanted))])
    scored = counted.join(known, "doc_id")
    part = lambda i: F.when(F.col(f"tf{i}") > 0, F.col(f"idf{i}") * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))).otherwise(F.lit(0.0))
    return scored.select("doc_id", "page", sum((part(i) for i in range(1, len(wanted))), part(0)).alias("score"))


def relevant_pages(pages: DataFrame, threshold: float = CUT, query: list[str] | None = None) -> DataFrame:
    """The pages at the threshold's share of their document's best score or above; all pages where that is not above 0."""
    scored = bm25(pages, query)
    best = scored.groupBy("doc_id").agg(F.max("score").alias("best"))
    return scored.join(best, "doc_id").filter((F.col("best") <= 0) | (F.col("score") >= threshold * F.col("best"))).select("doc_id", "page", "score")


def nearest_label(vectors: DataFrame, anchors: DataFrame, digits: int = 9, plain: bool = False) -> DataFrame:
    """id, label, score: the label whose anchors have the highest cosine (to `digits` decimals) with each vector; the least
    label on ties. vectors: id, vector; anchors: label, anchor, as many as there are. plain: cosines as in SQL (see vectors)."""
    index = Index(anchors.select(F.col("label").alias("name"), F.col("anchor").alias("vector")), plain)
    return index.nearest(vectors, digits).select("id", F.col("name").alias("label"), "score")

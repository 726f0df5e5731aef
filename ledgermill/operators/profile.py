"""What a document looks like before it is read, and which way of reading that suggests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: what a profile says of every document, since nothing judges it
NOT_JUDGED = {"garbage_value_ratio": 0.0, "line_readable": True, "header_structure": "single_row", "merged_cell_density": 0.0, "language": "single", "date_format_locale": "ambiguous", "numeric_format_locale": "ambiguous", "skew_or_rotation": False}


def profile(files: DataFrame) -> DataFrame:
    """Adds the fifteen fields of a document's profile; those of NOT_JUDGED have the same value for every document.

    files: path; for PDF files also n_pages, has_text, has_tables (null n_pages: the file could not be read).
    """
    ext = F.regexp_extract(F.lower("path"), r"(\.[^./\\]+)$", 1)
    kind = F.when(ext == ".pdf", "pdf").when(ext.isin(".xlsx", ".xls"), "xlsx").when(ext == ".csv", "csv").otherwise("unknown")
    col = lambda n, t: F.col(n) if n in files.columns else F.lit(None).cast(t)
    f = files.withColumn("file_type", kind).withColumn("p_", col("n_pages", "int")).withColumn("t_", F.coalesce(col("has_text", "boolean"), F.lit(False))).withColumn("b_", F.coalesce(col("has_tables", "boolean"), F.lit(False)))
    pdf, bad, sheet = F.col("file_type") == "pdf", (F.col("file_type") == "pdf") & F.col("p_").isNull(), F.col("file_type").isin("xlsx", "csv")
    return (
        f.withColumn("text_layer_present", F.when(sheet, True).when(pdf & ~bad, F.col("t_")).otherwise(False))
        .withColumn("table_border_type", F.when(bad, "implicit").when(F.col("file_type") == "csv", "borderless").when(pdf & ~F.col("b_"), "borderless").otherwise("bordered"))
        .withColumn("layout_complexity", F.when(sheet, "low").when(pdf & ~bad, "medium").otherwise("high"))
        .withColumn("page_count", F.when(pdf, F.coalesce("p_", F.lit(1))).otherwise(1))
        .withColumn("ocr_noise_level", F.when(bad, "high").otherwise("low"))
        .withColumn("page_role_estimate", F.when(bad | (F.col("file_type") == "unknown"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(page_roles(F.col("page_count"))))
        .withColumns({name: F.lit(value) for name, value in NOT_JUDGED.items()})
        .drop("p_", "t_", "b_")
    )


def route(text: Column, border: Column, complexity: Column, merged: Column, language: Column, header: Column) -> Column:
    """The way of reading, by rules in order."""
    return (
        F.when(text & (border == "bordered") & (complexity == "low"), "digital_text_simple_table")
        .when(text & (border == "borderless"), "digital_text_borderless_table")
        .when(~text & (merged < 0.4) & (complexity != "high") & (language == "single"), "scanned_single_language")
        .when(~text & (merged < 0.4) & (complexity != "high"), "scanned_multilingual")
        .when((merged > 0.4) | (header == "split_cell") | (complexity == "high"), "irregular_or_merged_cells")
        .otherwise("full_pipeline_fallback")
    )


def needs_retrieval(page_count: Column, threshold: int = 5) -> Column:
    return page_count > threshold


def page_role(page: Column, page_count: Column) -> Column:
    """The first of several pages is a cover, all others hold the table."""
    return F.when((page == 1) & (page_count > 1), "cover").otherwise("transaction_table")


def page_roles(page_count: Column) -> Column:
    """page_1, page_2, ... -> role."""
    return F.map_from_entries(F.transform(F.sequence(F.lit(1), F.greatest(page_count, F.lit(1))), lambda i: F.struct(F.concat(F.lit("page_"), i.cast("string")).alias("key"), page_role(i, page_count).alias("value"))))

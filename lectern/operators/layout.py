"""From a layout parser's spans to blocks, and from rated pages to text: font statistics, table notes, metadata, OCR routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions import fixed
from ..functions import text as T
from . import parsing


def _blank(column: str) -> Column:
    return T.strip(F.coalesce(F.col(column), F.lit(""))) == ""


def span_blocks(spans: DataFrame) -> DataFrame:
    """spans (document_id, page, block_index, line_index, span_index, text, size, flags, font) as blocks: text, max_font_size,
    avg_font_size, is_bold.

    A line is its spans put together, a blank one is left out, a block's lines are joined and stripped. Sizes and weight are of
    spans that aren't blank: one is bold by its flag and again by its font's name, and a block is if it has half as many such
    votes as spans, one at least. A block without such spans has size 0. Blocks without text are left out.
    """
    key = ["document_id", "page", "block_index"]
    voted = (F.col("flags").bitwiseAND(fixed.BOLD_FLAG) != 0).cast("int") + T.any_in(F.lower(F.coalesce("font", F.lit(""))), fixed.BOLD_FONTS).cast("int")
    seen = F.when(~_blank("text"), F.lit(1))
    item = F.struct("span_index", F.coalesce("text", F.lit("")).alias("t"))
    lines = spans.groupBy(*key, "line_index").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "").alias("line"), F.max(seen * F.col("size")).alias("most"), F.sum(seen * F.col("size")).alias("sum"),
        F.count(seen).alias("n"), F.coalesce(F.sum(seen * voted), F.lit(0)).alias("votes"),
    )
    kept = F.when(T.strip(F.col("line")) != "", F.struct("line_index", "line"))
    blocks = lines.groupBy(*key).agg(
        T.strip(F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["line"]), "\n")).alias("text"), F.coalesce(F.max("most"), F.lit(0.0)).cast("double").alias("max_font_size"),
        F.coalesce(F.sum("sum") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("avg_font_size"), ((F.sum("n") > 0) & (F.sum("votes") >= F.greatest(F.lit(1), F.floor(F.sum("n") / 2)))).alias("is_bold"),
    )
    return blocks.where("text <> ''")


def table_notes(tables: DataFrame) -> DataFrame:
    """tables (document_id, page, table_index, rows) as (document_id, page, notes): the tables of a page in Markdown, in order.
    Tables without a header are left out."""
    found = tables.withColumn("markdown", T.markdown_table(F.col("rows"))).where("markdown IS NOT NULL")
    return found.groupBy("document_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("table_index", "markdown"))), lambda x: x["markdown"]).alias("notes"))


def metadata(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """documents (document_id, title, author, subject, keywords, creation_date, modification_date: raw strings), pages
    (document_id, page, language): the same with page_count, the language voted by the pages, empty strings as null and dates in
    ISO form."""
    count = pages.groupBy("document_id").agg(F.count("*").alias("page_count"))
    rows = documents.join(count, "document_id", "left").join(parsing.document_language(pages), "document_id", "left")
    own = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("title", "author", "subject", "keywords")]
    dates = [T.pdf_date(F.nullif(F.col(c), F.lit(""))).alias(c) for c in ("creation_date", "modification_date")]
    return rows.select("document_id", *own, F.coalesce("page_count", F.lit(0)).alias("page_count"), "language", *dates)


def route_pages(blocks: DataFrame, pages: DataFrame, read: Callable[[bytes, int], tuple[str, float | None]] | None, cfg: EngineConfig = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(blocks to index, rated pages). pages: document_id, page, width, height, image_area and, for OCR, image.

    Scanned and corrupted pages go to `read`, again at a higher resolution while the gate says so, and what it reads is judged
    as a scanned page's text; without `read`, or without an image, they are judged by what they have. A page read by OCR is one
    block. The rated pages hold classification, quality_score, quality_status, retry_count, source_type, warning, excluded and,
    for excluded ones, raw_text: kept for review, but in no block.
    """
    rated = parsing.page_signals(blocks, pages).withColumn("classification", parsing.page_class(cfg))
    bad = F.col("classification").isin("scanned", "corrupted")
    if read is not None and "image" in pages.columns:
        needs = rated.where(bad).join(pages.select("document_id", "page", "image"), ["document_id", "page"]).where("image IS NOT NULL") if "image" not in rated.columns else rated.where(bad & F.col("image").isNotNull())
        got = parsing.ocr(needs, read, cfg).select("document_id", "page", T.strip(F.coalesce("text", F.lit(""))).alias("ocr_text"), "confidence", F.col("retries").alias("retry_count"))
        rated = rated.join(got, ["document_id", "page"], "left")
    else:
        rated = rated.withColumns({"ocr_text": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "retry_count": F.lit(None).cast("int")})
    read_ = F.col("source_type") == "ocr"
    rated = rated.withColumn("source_type", F.when(F.col("ocr_text").isNotNull(), "ocr").otherwise("native_text"))
    rated = rated.withColumns({"retry_count": F.coalesce("retry_count", F.lit(0)), "text": F.when(read_, F.col("ocr_text")).otherwise(F.col("text"))})
    judged = F.when(read_, F.lit("scanned")).otherwise(F.col("classification"))
    rated = parsing.signals(rated).withColumn("judged", judged)
    rated = rated.withColumn("quality_score", parsing.quality_score(F.col("judged"), F.col("confidence"), F.col("retry_count")))
    # What can't be read again has no retry left.
    tried = F.when(bad & ~read_, cfg.quality_max_retries).otherwise(F.col("retry_count"))
    rated = rated.withColumn("quality_status", parsing.quality_gate(F.col("judged"), F.col("quality_score"), tried, cfg))
    rated = rated.withColumn("excluded", parsing.excluded(F.col("quality_status"), cfg))
    warning = F.when(F.col("classification") == "mixed", F.lit("only the native text is indexed")).when((F.col("classification") == "corrupted") & read_, F.lit("native text is corrupted; read by OCR"))
    rated = rated.withColumns({"warning": warning, "raw_text": F.when(F.col("excluded"), F.nullif(F.col("text"), F.lit("")))})
    own = blocks.join(rated.where(~F.col("excluded") & (F.col("source_type") == "native_text")).select("document_id", "page"), ["document_id", "page"], "left_semi")
    whole = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    seen = rated.where(~F.col("excluded") & (F.col("source_type") == "ocr") & (F.col("text") != ""))
    seen = seen.select("document_id", "page", F.lit(0).alias("block_index"), "text", whole.alias("bbox"), F.lit(0.0).alias("max_font_size"), F.lit(0.0).alias("avg_font_size"), F.lit(False).alias("is_bold"))
    out = own.select("document_id", "page", "block_index", "text", "bbox", "max_font_size", "avg_font_size", "is_bold").unionByName(seen)
    return out, rated.drop("judged", "ocr_text", "image")

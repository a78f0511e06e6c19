"""The chunk view and message view over the tables, and empty frames of the engine's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

CHUNK_DDL = (
    "chat_id bigint, document_id string, id bigint, ord int, page int, page_label string, text string, embedding array<float>, chapter string, section string, "
    "subsection string, heading string, paragraph_index int, bbox struct<x0:double,y0:double,x1:double,y1:double>, language string, word_count int, "
    "previous_chunk_id string, next_chunk_id string, chunk_type string, quality_status string, source_type string, page_classification string, quality_score double, local_id string"
)
BLOCK_DDL = (
    "document_id string, page int, block_index int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, max_font_size double, avg_font_size double, is_bold boolean, `column` int"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = False, body: bool = True) -> DataFrame:
    """Documents as the chunks of their source's chat: ten to a chapter, five to a section, two to a page; some lack either.

    `ord` counts from 0 within a chat. Places and links come from a window over ids alone; texts meet them by id, so that no
    text is sorted within its source. Without `body` no text is read. Vectors are joined on request only.
    """
    docs = table(spark, sf_dir, "documents")
    order = W.partitionBy("source").orderBy("doc_id")
    o = F.row_number().over(order)
    found = docs.select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("chat_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("id"), o.alias("o"),
        F.lag("doc_id").over(order).cast("string").alias("previous_chunk_id"), F.lead("doc_id").over(order).cast("string").alias("next_chunk_id"), F.col("lang").alias("language"),
    )
    if body:
        found = docs.select(F.col("doc_id").alias("id"), "text").join(found, "id")
    found = found.select(
        "chat_id", "document_id", "id", (F.col("o") - 1).alias("ord"), (F.floor((F.col("o") - 1) / 2) + 1).cast("int").alias("page"),
        F.when(F.col("o") % 17 != 0, F.concat(F.lit("Chapter "), (F.floor((F.col("o") - 1) / 10) + 1).cast("string"))).alias("chapter"),
        F.when(F.col("o") % 11 != 0, F.concat(F.lit("Section "), (F.floor((F.col("o") - 1) / 5) + 1).cast("string"))).alias("section"),
        F.lit(None).cast("string").alias("subsection"), F.lit(None).cast("string").alias("heading"), ((F.col("o") - 1) % 2).alias("paragraph_index"),
        *(["text"] if body else []), "language", "previous_chunk_id", "next_chunk_id", F.col("id").cast("string").alias("local_id"),
    )
    if vectors:
        vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("__vec"), "embedding")
        found = found.join(vec, found["id"] == vec["__vec"], "left").drop("__vec")
    return found


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


HTML_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
HTML_BLOCK = r"(?i)<(/?)(h[1-6]|p|li|td|th|title|div|ul|ol|table|tr|body|head|html|article|section|header|footer|nav|main|aside|blockquote|pre|br|hr)\b[^>]*>"


def html_blocks(pages: DataFrame) -> DataFrame:
    """Layout blocks of web pages (page_id, html), the stand-in for a PDF parser's: headings by level, paragraphs, list items,
    and whatever else stands between block tags.

    One pass of expressions: scripts and styles go, the text is cut at each block tag, open or closed, other tags go, entities
    that matter are put back. block_index counts all cuts; blank blocks are left out. A null page has no block.
    """
    cut = F.regexp_replace(F.regexp_replace("html", HTML_HIDDEN, " "), HTML_BLOCK, "\x1e<$1$2>")
    blocks = pages.select("page_id", F.posexplode(F.split(cut, "\x1e", -1)).alias("block_index", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"(?i)^<([a-z0-9]+)", 1))
    body = F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"&nbsp;", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.regexp_replace(body, entity, char)
    plain = text.strip(F.regexp_replace(body, text.SPACE, " "))
    size = F.when(tag == "title", 24.0).when(tag.rlike("^h[1-6]$"), 22.0 - 2.0 * F.substring(tag, 2, 1).cast("double")).otherwise(10.0)
    found = blocks.select("page_id", "block_index", tag.alias("tag"), plain.alias("text"), size.alias("max_font_size"), size.alias("avg_font_size"), tag.rlike("^(h[1-6]|title)$").alias("is_bold"))
    return found.where("text <> ''").withColumn("document_id", F.col("page_id").cast("string")).withColumn("page", F.lit(1))

"""From layout blocks to chunks: page signals and classes, the quality gate, heading levels, the outline tree, semantic chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions import text as T

HEADINGS = ("title", "chapter", "section", "subsection", "heading")
RANKS = {"title": 0, "chapter": 1, "section": 2, "subsection": 3, "heading": 4, "paragraph": 5, "list_item": 5}


def rect_area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x1"] - box["x0"]) * F.greatest(F.lit(0.0), box["y1"] - box["y0"])


def page_signals(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks (document_id, page, block_index, text, bbox), pages (document_id, page, width, height, image_area): a row per
    page with counts of characters, words, suspicious characters, blocks, and the shares covered by text and images. Pages
    without blocks are there too."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"]), "\n")
    own = blocks.groupBy("document_id", "page").agg(body.alias("text"), F.sum(rect_area(F.col("bbox"))).alias("area"), F.count("*").alias("block_count"))
    rows = pages.join(own, ["document_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    whole = F.col("width") * F.col("height")

    def share(area: Column) -> Column:
        return F.when(whole > 0, F.least(F.lit(1.0), F.coalesce(area, F.lit(0.0)) / whole)).otherwise(0.0)

    return signals(rows).withColumns({"text_block_coverage": share(F.col("area")), "image_coverage": share(F.col("image_area")), "block_count": F.coalesce("block_count", F.lit(0))}).drop("area")


def signals(rows: DataFrame) -> DataFrame:
    """rows with the counts and ratios of `text`."""
    bad, control = T.suspicious(F.col("text"))
    rows = rows.withColumns({"char_count": F.length("text").cast("long"), "word_count": T.word_count(F.col("text")).cast("long"), "replacement_char_count": bad, "control_char_count": control})
    rate = F.when(F.col("char_count") > 0, (F.col("replacement_char_count") + F.col("control_char_count")) / F.col("char_count")).otherwise(0.0)
    return rows.withColumns({"suspicious_char_rate": rate, "avg_word_length": F.when(F.col("word_count") > 0, F.col("char_count") / F.col("word_count")).otherwise(0.0)})


def page_class(cfg: EngineConfig = DEFAULTS) -> Column:
    image = F.col("image_coverage") >= cfg.page_trivial_coverage
    enough = (F.col("char_count") >= cfg.page_min_chars) & (F.col("word_count") >= cfg.page_min_words)
    return (
        F.when((F.col("char_count") == 0) & ~image, "empty")
        .when(enough & (F.col("suspicious_char_rate") > cfg.page_suspicious_rate), "corrupted")
        .when(enough & (F.col("avg_word_length") > 0) & (F.col("avg_word_length") < cfg.page_min_word_length), "corrupted")
        .when(~enough & (image | (F.col("char_count") > 0)), "scanned")
        .when(~enough, "empty")
        .when(image & (F.col("image_coverage") >= cfg.page_image_coverage), "mixed")
        .otherwise("native")
    )


def quality_score(kind: Column, confidence: Column, retries: Column) -> Column:
    """Of a page by its class, from the rate of suspicious characters, an OCR confidence where there is one, or the density of
    words; each retry costs a little."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    penalty = F.least(F.lit(1.0), F.col("suspicious_char_rate") * 4)
    density = 0.9 * F.least(F.lit(1.0), F.col("word_count") / 40)
    native = F.greatest(F.lit(0.0), 0.95 - penalty)
    base = (
        F.when(kind == "corrupted", F.greatest(F.lit(0.0), 1.0 - penalty))
        .when(kind == "scanned", F.when(confidence.isNotNull(), clip(confidence)).otherwise(density))
        .when((kind == "mixed") & confidence.isNotNull(), (native + clip(confidence)) / 2).otherwise(native)
    )
    return F.when(kind == "empty", 1.0).otherwise(clip(base - F.least(F.lit(0.15), 0.05 * retries)))


def quality_gate(kind: Column, score: Column, retries: Column, cfg: EngineConfig = DEFAULTS) -> Column:
    return (
        F.when(kind == "empty", "accepted").when(score.isNull(), "needs_review").when(score >= cfg.quality_accept, "accepted")
        .when((retries < cfg.quality_max_retries) & (score < cfg.quality_retry), "needs_retry").when(score >= cfg.quality_review, "needs_review").otherwise("failed")
    )


def excluded(status: Column, cfg: EngineConfig = DEFAULTS) -> Column:
    return (status == "failed") | ((status == "needs_review") & F.lit(not cfg.include_needs_review))


def body_sizes(blocks: DataFrame) -> DataFrame:
    """(document_id, body_size): the commonest average size to one decimal, of equally common ones the first; 10 without any."""
    sized = blocks.where("avg_font_size > 0").select("document_id", F.bround("avg_font_size", 1).alias("size"), F.struct("page", "block_index").alias("at"))
    counts = sized.groupBy("document_id", "size").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    order = W.partitionBy("document_id").orderBy(F.desc("n"), "at")
    best = counts.withColumn("r", F.row_number().over(order)).where("r = 1").select("document_id", F.col("size").alias("body_size"))
    return blocks.select("document_id").distinct().join(best, "document_id", "left").select("document_id", F.coalesce("body_size", F.lit(10.0)).alias("body_size"))


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with `level`: list items and chapters by their wording, other headings by size and weight against the body."""
    rows = blocks.join(body_sizes(blocks), "document_id").withColumn("__words", T.word_count(F.col("text")))
    plain, ratio, brief = T.strip(F.col("text")), F.col("max_font_size") / F.col("body_size"), F.col("__words") <= 20
    level = (
        F.when(plain.rlike(r"(?U)^\s*(([-•*–]|\d+[.)]|[a-zA-Z][.)])\s+)"), "list_item")
        .when(plain.rlike(r"(?iU)^\s*(chapter|الفصل|فصل)\s+\S+") & brief, "chapter")
        .when(~(((ratio >= 1.15) | F.col("is_bold")) & brief), "paragraph")
        .when(ratio >= 1.8, "title").when(ratio >= 1.5, "chapter").when(ratio >= 1.3, "section").when(ratio >= 1.15, "subsection").otherwise("heading")
    )
    return rows.withColumn("level", level).drop("__words", "body_size")


def two_columns(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks with is_two_column, column and reading_order: left column down, then right, where most blocks lie in a half."""
    rows = blocks.drop("column").join(pages.select("document_id", "page", "width"), ["document_id", "page"])
    mid, near = F.col("width") / 2, F.col("width") * 0.05
    left = F.col("bbox.x1") <= mid + near
    right = ~left & (F.col("bbox.x0") >= mid - near)
    w = W.partitionBy("document_id", "page")
    rows = rows.withColumns({"__l": F.count_if(left).over(w), "__r": F.count_if(right).over(w), "__n": F.count("*").over(w)})
    two = (F.col("__l") >= 2) & (F.col("__r") >= 2) & (F.col("__n") - F.col("__l") - F.col("__r") <= F.greatest(F.lit(2), F.floor(F.col("__n") / 4)))
    rows = rows.withColumn("is_two_column", two)
    rows = rows.withColumn("column", F.when(F.col("is_two_column") & (F.col("bbox.x0") >= mid - near), 1).otherwise(0))
    place = F.when(F.col("is_two_column"), F.struct(F.col("column").cast("double").alias("a"), F.col("bbox.y0").alias("b"), F.col("bbox.x0").alias("c"))).otherwise(F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c")))
    return rows.withColumn("reading_order", F.row_number().over(w.orderBy(place, "block_index"))).drop("__l", "__r", "__n", "width")


def hierarchy(blocks: DataFrame) -> DataFrame:
    """The outline as an adjacency list: document_id, node_id (the place in the document), parent_id, level, text, page, bbox.

    A heading's parent is the nearest heading before it of a lesser rank; a block's is the nearest heading. The nearest of
    each rank is a window's last value; one of rank r is still open if no heading of r or less came since, so the parent is
    the latest among the lesser ranks.
    """
    order = W.partitionBy("document_id").orderBy("page", "block_index")
    rows = blocks.withColumn("node_id", F.row_number().over(order))
    rank = F.lit(None).cast("int")
    for name, r in RANKS.items():
        rank = F.when(F.col("level") == name, F.lit(r)).otherwise(rank)
    rows = rows.withColumn("rank", rank)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    for r in range(5):
        rows = rows.withColumn(f"__{r}", F.max(F.when(F.col("rank") == r, F.col("node_id"))).over(before))
    parent = F.lit(None).cast("int")
    for r in range(1, 6):
        parent = F.when(F.col("rank") == r, F.greatest(*(F.col(f"__{k}") for k in range(r)), F.lit(None).cast("int"))).otherwise(parent)
    return rows.withColumn("parent_id", parent).select("document_id", "node_id", "parent_id", "rank", "level", F.substring("text", 1, 300).alias("text"), "page", "bbox")


def contexts(blocks: DataFrame) -> DataFrame:
    """blocks with the chapter, section, subsection and heading that hold at each: a chapter ends section and subsection, a
    section ends the subsection, a heading outlives all; titles don't count."""
    order = W.partitionBy("document_id").orderBy("page", "block_index")
    name = T.strip(F.col("text"))
    rows = blocks.withColumns({"__c": F.sum((F.col("level") == "chapter").cast("int")).over(order), "__s": F.sum(F.col("level").isin("chapter", "section").cast("int")).over(order)})

    def last(level: str, *reset: str) -> Column:
        w = W.partitionBy("document_id", *reset).orderBy("page", "block_index") if reset else order
        return F.last(F.when(F.col("level") == level, name), ignorenulls=True).over(w)

    return rows.withColumns({"chapter": last("chapter"), "section": last("section", "__c"), "subsection": last("subsection", "__s"), "heading": last("heading")}).drop("__c", "__s")


_CHUNK_OUT = "document_id string, ord int, page int, text string, chapter string, section string, subsection string, heading string, paragraph_index int, chunk_type string, x0 double, y0 double, x1 double, y1 double"


def chunk_blocks(blocks: DataFrame, least: int = 300, alone: int = 60) -> DataFrame:
    """Semantic chunks of classified blocks, with links to the one before and after.

    A chunk closes at a heading once it has half of `least` tokens, and after a block once it has `least`; a chunk under
    `alone` joins the one before on its page. A chunk's headings are those that hold when it closes, so one that a heading
    closes is named by that heading. A null text is an empty one; a document of blank blocks has no chunk. The state runs through a document, so each is folded in one task; a document is a row of
    some files' worth, and documents are spread over tasks.
    """
    size = lambda words: int(words * 1.3)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["page", "block_index"])
        out: list[dict] = []
        held: list[dict] = []
        words = paragraph = 0
        now: dict = {}

        def close() -> None:
            nonlocal held, words
            body = "\n\n".join(b["text"] or "" for b in held).strip()
            if body:
                kinds = {b["level"] for b in held}
                boxes = [b["bbox"] or {"x0": 0.0, "y0": 0.0, "x1": 0.0, "y1": 0.0} for b in held]
                out.append(
                    {"page": held[0]["page"], "text": body, "paragraph_index": held[0]["par"], "chunk_type": kinds.pop() if len(kinds) == 1 else "mixed", **now}
                    | {k: f(b[k] for b in boxes) for k, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}
                )
            held, words = [], 0

        for b in group.to_dict("records"):
            heading = b["level"] in HEADINGS
            now = {k: b[k] for k in ("chapter", "section", "subsection", "heading")}
            if heading and held and size(words) >= least // 2:
                close()
            held.append(b | {"par": paragraph})
            words += len((b["text"] or "").split())
            if not heading:
                paragraph += 1
                if size(words) >= least:
                    close()
        if held:
            close()
        merged: list[dict] = []
        for c in out:
            if merged and size(len(c["text"].split())) < alone and merged[-1]["page"] == c["page"]:
                merged[-1]["text"] += "\n\n" + c["text"]
            else:
                merged.append(c)
        rows = [{"document_id": group["document_id"].iloc[0], "ord": i, **c} for i, c in enumerate(merged)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _CHUNK_OUT.split(", ")])

    found = contexts(blocks).select("document_id", "page", "block_index", "text", "bbox", "level", "chapter", "section", "subsection", "heading").groupBy("document_id").applyInPandas(fold, _CHUNK_OUT)
    w = W.partitionBy("document_id").orderBy("ord")
    found = found.withColumn("local_id", F.concat_ws("-", "document_id", F.col("ord").cast("string")))
    return found.withColumns(
        {
            "bbox": F.struct("x0", "y0", "x1", "y1"), "language": T.language(F.col("text")), "word_count": T.word_count(F.col("text")),
            "previous_chunk_id": F.lag("local_id").over(w), "next_chunk_id": F.lead("local_id").over(w),
        }
    ).drop("x0", "y0", "x1", "y1")


def tag_quality(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks with the gate's verdict on their page."""
    return chunks.join(pages.select("document_id", "page", "quality_status", "quality_score", F.col("classification").alias("page_classification"), "source_type"), ["document_id", "page"], "left")


def document_language(pages: DataFrame, by: str = "document_id") -> DataFrame:
    """(by, language): the commonest of the pages' languages; Arabic and English without mixed pages make mixed. Ties: mixed,
    then ar, then en. Null without any."""
    langs = ("mixed", "ar", "en")
    n = pages.groupBy(by).agg(*(F.count_if(F.col("language") == x).alias(x) for x in langs))
    top = F.greatest(*langs)
    vote = F.when(top == 0, F.lit(None).cast("string")).when((F.col("mixed") == 0) & (F.col("ar") > 0) & (F.col("en") > 0), "mixed")
    for x in langs:
        vote = vote.when(F.col(x) == top, x)
    return n.select(by, vote.alias("language"))


def page_labels(words: DataFrame, pages: DataFrame) -> DataFrame:
    """words (document_id, page, word_index, y0, word), pages (document_id, page, height, catalog_label): (document_id, page,
    page_label), the catalogue's, else the first word in the top or bottom tenth that looks like one."""
    rows = words.join(pages.select("document_id", "page", "height"), ["document_id", "page"])
    edge = (F.col("y0") < 0.1 * F.col("height")) | (F.col("y0") > 0.9 * F.col("height"))
    seen = rows.where(edge & T.page_label(F.col("word"))).groupBy("document_id", "page").agg(F.min_by(T.strip(F.col("word")), "word_index").alias("seen"))
    return pages.join(seen, ["document_id", "page"], "left").select("document_id", "page", F.coalesce("catalog_label", "seen").alias("page_label"))


def nearest_blocks(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """images (document_id, page, image_index, bbox) with the text of the block whose middle is nearest in height."""
    mid = lambda c: (F.col(f"{c}.y0") + F.col(f"{c}.y1")) / 2
    pairs = images.withColumn("__m", mid("bbox")).join(blocks.select("document_id", "page", "block_index", F.col("text").alias("__text"), mid("bbox").alias("__b")), ["document_id", "page"], "left")
    near = F.min_by("__text", F.struct(F.abs(F.col("__m") - F.col("__b")), "block_index"))
    return pairs.groupBy("document_id", "page", "image_index").agg(F.first("bbox").alias("bbox"), near.alias("nearby_text"))


def ocr(pages: DataFrame, read: Callable[[bytes, int], tuple[str, float | None]], cfg: EngineConfig = DEFAULTS, first_dpi: int = 200, retry_dpi: int = 300, most_dpi: int = 600) -> DataFrame:
    """pages (document_id, page, image) read by a provider, which is called again at a higher resolution while the text is
    poor: document_id, page, text, confidence, retries. The loop is within the task; filter to what needs OCR first."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, page, image in zip(b["document_id"], b["page"], b["image"]):
                dpi, retries = first_dpi, 0
                got, sure = read(image, dpi)
                while retries < cfg.quality_max_retries and (sure if sure is not None else 0.9 * min(1.0, len(got.split()) / 40)) < cfg.quality_retry:
                    dpi, retries = min(most_dpi, max(retry_dpi, dpi + 100)), retries + 1
                    got, sure = read(image, dpi)
                rows.append((doc, page, got, sure, retries))
            yield pd.DataFrame(rows, columns=["document_id", "page", "text", "confidence", "retries"])

    return pages.select("document_id", "page", "image").mapInPandas(run, "document_id string, page int, text string, confidence double, retries int")

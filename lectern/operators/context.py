"""What of the retrieved chunks goes into a prompt: dedupe, merge, clean, order, budget; outlines and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions import text


def dedupe(selected: DataFrame) -> DataFrame:
    """selected (question_id, pos, id, text, ...) without repeated ids and without texts that hold or are held by one kept
    before, blanks and case aside. Folds over a question's few chunks as one array; only ids are exploded again."""
    norm = F.lower(F.array_join(text.words(F.col("text")), " "))
    item = F.struct("pos", "id", norm.alias("norm"))
    lists = selected.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = selected.schema["id"].dataType.simpleString()
    start = F.from_json(F.lit("[]"), f"array<struct<pos:{selected.schema['pos'].dataType.simpleString()},id:{kind},norm:string>>")

    def step(kept: Column, x: Column) -> Column:
        known = F.exists(kept, lambda k: k["id"] == x["id"])
        held = (x["norm"] != "") & F.exists(kept, lambda k: F.contains(k["norm"], x["norm"]) | F.contains(x["norm"], k["norm"]))
        return F.when(F.coalesce(known, F.lit(False)) | held, kept).otherwise(F.concat(kept, F.array(x)))

    keep = lists.select("question_id", F.explode(F.aggregate("items", start, step)).alias("k")).select("question_id", "k.pos")
    return selected.join(keep, ["question_id", "pos"], "left_semi")


def merge_adjacent(selected: DataFrame) -> DataFrame:
    """Chunks that follow each other in the document (by their links) within a chapter and section become one, which starts
    with the one that comes first in `pos` and takes what follows it. Chunks without local_id stay alone.

    selected: question_id, pos, ord, id, local_id, previous_chunk_id, chapter, section, page, text. Gaps and islands: a run
    breaks where a link or heading does, and where a later place in the run comes earlier in pos than all before it.
    """
    by = W.partitionBy("question_id").orderBy("ord", "pos")
    linked = (F.lag("local_id").over(by) == F.col("previous_chunk_id")) & F.lag("chapter").over(by).eqNullSafe(F.col("chapter")) & F.lag("section").over(by).eqNullSafe(F.col("section"))
    runs = selected.withColumn("__run", F.sum(F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).over(by))
    in_run = W.partitionBy("question_id", "__run").orderBy("ord", "pos")
    head = F.coalesce(F.col("pos") < F.min("pos").over(in_run.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    runs = runs.withColumn("__head", head.cast("int")).withColumn("__group", F.sum("__head").over(in_run))
    parts = F.sort_array(F.collect_list(F.struct("ord", "pos", "text")))
    first = {c: F.min_by(c, F.struct("ord", "pos")) for c in ("pos", "ord", "id", "local_id", "chapter", "section", "page")}
    return runs.groupBy("question_id", "__run", "__group").agg(
        *(v.alias(c) for c, v in first.items()), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("merged")
    ).drop("__run", "__group")


def order_context(selected: DataFrame) -> DataFrame:
    """selected (question_id, pos, chapter, section, page, relevance) with `place`: sections by their best relevance, then by
    first place, and by page within; a missing relevance is 0. Null headings are one section."""
    group = W.partitionBy("question_id", "chapter", "section")
    rows = selected.withColumns({"__best": F.max(F.coalesce("relevance", F.lit(0.0))).over(group), "__first": F.min("pos").over(group)})
    return rows.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("__best"), "__first", "page", "pos"))).drop("__best", "__first")


def fit_budget(ordered: DataFrame, budget: int | None = None, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """ordered (question_id, place, text, keywords, numbers) cut to the budget of estimated tokens.

    From the last chunk backwards each one is compressed as long as the sum is over the budget; then chunks are dropped from
    the end. Since a chunk's compressed size depends on nothing else, a suffix sum says which ones are compressed and a
    prefix sum which ones stay. Adds tokens, compressed, kept; dropped chunks remain as rows.
    """
    b = cfg.context_token_budget if budget is None else budget
    own = text.estimated_tokens(F.col("text"))
    target = F.greatest(F.least(F.lit(40), F.lit(b)), F.least(F.floor(F.col("__own") / 2), F.lit(b)))
    rows = ordered.withColumn("__own", own)
    terms = (F.size("keywords") > 0) | (F.size("numbers") > 0)
    over = F.sum("__own").over(W.partitionBy("question_id")) > b
    rows = rows.withColumn("__over", over & terms)
    short = F.when(F.col("__over"), text.compressed(F.col("text"), target, F.col("keywords"), F.col("numbers"))).otherwise(F.col("text"))
    rows = rows.withColumn("__short", short).withColumn("__less", F.when(F.col("__over"), text.estimated_tokens(F.col("__short"))).otherwise(F.col("__own")))
    later = W.partitionBy("question_id").orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, -1)
    saved = F.coalesce(F.sum(F.col("__own") - F.col("__less")).over(later), F.lit(0))
    cut = F.col("__over") & (F.sum("__own").over(W.partitionBy("question_id")) - saved > b)
    rows = rows.withColumn("__cut", cut)
    rows = rows.withColumns({"compressed": F.col("__cut") & (F.col("__short") != F.col("text")), "tokens": F.when(F.col("__cut"), F.col("__less")).otherwise(F.col("__own"))})
    rows = rows.withColumn("kept", F.sum("tokens").over(W.partitionBy("question_id").orderBy("place")) <= b)
    return rows.withColumn("text", F.when(F.col("__cut"), F.col("__short")).otherwise(F.col("text"))).drop("__own", "__over", "__short", "__less", "__cut")


def prepare(selected: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """selected (question_id, pos, ord, id, local_id, previous_chunk_id, chapter, section, page, text, relevance, keywords,
    numbers) through dedupe, merge, cleaning, order and budget."""
    few = dedupe(selected)
    merged = merge_adjacent(few)
    extra = few.select("question_id", "id", "relevance", "keywords", "numbers")
    rows = merged.join(extra, ["question_id", "id"]).withColumn("text", text.clean(F.col("text")))
    return fit_budget(order_context(rows), None, cfg)


def distinct_citations(chunks: DataFrame, by: list[str], *order: str, limit: int = 12) -> DataFrame:
    """The first chunk of each (page, section, heading), in order, `limit` for each `by`."""
    first = chunks.withColumn("__n", F.row_number().over(W.partitionBy(*by, "page", "section", "heading").orderBy(*order))).where("__n = 1").drop("__n")
    return first.withColumn("citation_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("citation_rank") <= limit)


def citations(matched: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(question_id, citations): of a question's chunks (question_id, at, and a chunk's columns) the first of each page, section
    and heading, in order, cfg.citation_cap at most."""
    few = distinct_citations(matched, ["question_id"], "at", limit=cfg.citation_cap)
    item = F.struct("citation_rank", "document_id", F.col("page").alias("physical_page"), "chapter", "section", "heading", "bbox")
    each = F.transform(F.sort_array(F.collect_list(item)), lambda c: F.struct(*(c[n].alias(n) for n in ("document_id", "physical_page", "chapter", "section", "heading", "bbox"))))
    return few.groupBy("question_id").agg(each.alias("citations"))


def outline(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Sections, subsections and headings in reading order, each (level, text) once: by, level, text, page, position, number.
    Sections are numbered."""
    levels = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("level"), F.col(n).alias("text")) for i, n in enumerate(("section", "subsection", "heading"))))
    rows = chunks.select(*by, "page", F.coalesce("paragraph_index", F.lit(0)).alias("par"), "ord", F.explode(levels).alias("e")).select(*by, "page", "par", "ord", "e.*").where("text <> ''")
    first = rows.withColumn("__n", F.row_number().over(W.partitionBy(*by, "level", "text").orderBy("page", "par", "ord", "i"))).where("__n = 1")
    order = W.partitionBy(*by).orderBy("page", "par", "ord", "i")
    return first.select(*by, "level", "text", "page", F.row_number().over(order).alias("position"), F.sum((F.col("level") == "section").cast("int")).over(order).alias("number"))


def outline_markdown(entries: DataFrame, by: list[str], title: str | None = None) -> DataFrame:
    line = F.when(F.col("level") == "section", F.concat(F.col("number").cast("string"), F.lit(". "), F.col("text"))).when(F.col("level") == "subsection", F.concat(F.lit("   - "), F.col("text"))).otherwise(F.concat(F.lit("   • "), F.col("text")))
    body = entries.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"]), "\n").alias("markdown"))
    return body.withColumn("markdown", F.concat_ws("\n", F.concat(F.lit("# "), F.col(title)), "markdown")) if title else body


def excerpt(page: Column, *crumbs: Column) -> Column:
    """[Page n — a > b], each heading once."""
    path = F.array_distinct(F.filter(F.array(*crumbs), lambda c: c.isNotNull() & (c != "")))
    return F.concat(F.lit("[Page "), page.cast("string"), F.when(F.size(path) > 0, F.concat(F.lit(" — "), F.array_join(path, " > "))).otherwise(F.lit("")), F.lit("]"))

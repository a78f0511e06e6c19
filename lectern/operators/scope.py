"""Scoped retrieval: page ranges, chapters, sections, whole documents; runs, batches and samples for summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions import fixed
from ..functions.query import digits


def reading_order() -> tuple[Column, ...]:
    return F.col("page"), F.coalesce("paragraph_index", F.lit(0)), F.col("ord")


def page_range(chunks: DataFrame, start: int, end: int) -> DataFrame:
    return chunks.where(F.col("page").between(start, end))


def heading_number(heading: Column) -> Column:
    """The first number in a heading."""
    return digits(F.nullif(F.regexp_extract(heading, r"\p{Nd}+", 0), F.lit("")))


def heading_pattern(n: Column) -> Column:
    """A pattern for chapter n's heading in text; an Arabic ordinal too for 1 to 10."""
    number = n.cast("string")
    word = F.lit(None).cast("string")
    for name, i in reversed(fixed.ARABIC_ORDINALS.items()):
        word = F.when(n == i, F.lit(name)).otherwise(word)
    plain = F.concat(F.lit(r"(?iu)chapter\s*0*"), number, F.lit(r"\b|(?:الفصل|فصل)\s*0*"), number, F.lit(r"\b"))
    return F.concat(plain, F.coalesce(F.concat(F.lit(r"|(?:الفصل|فصل)\s+"), word, F.lit(r"\b")), F.lit("")))


def chapters(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """wanted (question_id, chat_id, ref_pos, ref) with the chunks of each chapter: question_id, ref_pos, ref, id.

    By the number in a chunk's chapter; a reference that isn't a number finds chapters without one. Where no chunk's chapter
    has the number, the stretch from the first text with its heading to the next one with the following chapter's.
    """
    wanted = wanted.withColumn("n", digits(F.col("ref")))
    meta = chunks.select(F.col("chat_id").alias("__chat"), "id", "ord", "chapter")
    own = wanted.join(meta.where("chapter <> ''"), (F.col("chat_id") == F.col("__chat")) & heading_number(F.col("chapter")).eqNullSafe(F.col("n")))
    own = own.select("question_id", "ref_pos", "ref", "id")
    rest = wanted.where("n IS NOT NULL").join(own.select("question_id", "ref_pos").distinct(), ["question_id", "ref_pos"], "left_anti")
    texts = chunks.select(F.col("chat_id").alias("__chat"), "id", "ord", "text")
    seen = rest.join(texts, F.col("chat_id") == F.col("__chat"))
    seen = seen.withColumns({"__a": F.rlike("text", heading_pattern(F.col("n"))), "__b": F.rlike("text", heading_pattern(F.col("n") + 1))})
    begin = seen.groupBy("question_id", "ref_pos").agg(F.min(F.when(F.col("__a"), F.col("ord"))).alias("begin")).where("begin IS NOT NULL")
    seen = seen.join(begin, ["question_id", "ref_pos"])
    end = seen.groupBy("question_id", "ref_pos").agg(F.min(F.when(F.col("__b") & (F.col("ord") > F.col("begin")), F.col("ord"))).alias("end"))
    span = seen.join(end, ["question_id", "ref_pos"]).where("ord >= begin AND (end IS NULL OR ord < end)")
    return own.unionByName(span.select("question_id", "ref_pos", "ref", "id"))


def sections(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """wanted (question_id, chat_id, hint) with the chunks whose section, subsection or heading holds the hint."""
    hint = F.lower(F.trim("hint"))
    has = F.lit(False)
    for c in ("section", "subsection", "heading"):
        has = has | ((F.col(c) != "") & F.contains(F.lower(c), hint))
    meta = chunks.select(F.col("chat_id").alias("__chat"), "id", "section", "subsection", "heading")
    return wanted.join(meta, F.col("chat_id") == F.col("__chat")).where(F.coalesce(has, F.lit(False))).select("question_id", "id")


def resolve(questions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts) for questions (question_id, chat_id, scope): rows are question_id, position, id in reading order, the
    chapters of a comparison one after the other; verdicts are question_id, focus, confidence, not_found. A scope that was
    asked for and isn't there stays empty; of two chapters one is enough for half confidence."""
    s = F.col("scope")
    q = questions.select("question_id", "chat_id", s["query_type"].alias("kind"), s["chapters"].alias("refs"), s["page_from"].alias("a"), s["page_to"].alias("b"), s["section_hint"].alias("hint"))
    meta = chunks.select(F.col("chat_id").alias("__chat"), "id", "page")
    pages = q.where("kind = 'page_range'").join(meta, (F.col("chat_id") == F.col("__chat")) & F.col("page").between(F.col("a"), F.col("b"))).select("question_id", F.lit(0).alias("ref_pos"), "id")
    refs = q.where("kind IN ('chapter_query', 'multi_chapter_query')").select("question_id", "chat_id", F.posexplode("refs").alias("ref_pos", "ref"))
    by_chapter = chapters(refs, chunks).select("question_id", "ref_pos", "id")
    by_section = sections(q.where("kind = 'section_query'").select("question_id", "chat_id", "hint"), chunks).select("question_id", F.lit(0).alias("ref_pos"), "id")
    whole = q.where("kind IN ('document_query', 'normal_query')").join(meta, F.col("chat_id") == F.col("__chat")).select("question_id", F.lit(0).alias("ref_pos"), "id")
    rows = pages.unionByName(by_chapter).unionByName(by_section).unionByName(whole).join(chunks.select("id", "page", "paragraph_index", "ord"), "id")
    rows = rows.select("question_id", "id", "ref_pos", F.row_number().over(W.partitionBy("question_id").orderBy("ref_pos", *reading_order())).alias("position"))
    got = rows.groupBy("question_id").agg(F.count_distinct("ref_pos").alias("refs_found"), F.min("ref_pos").alias("first_ref"), F.count("*").alias("n"))
    v = q.join(got, "question_id", "left")
    two = F.col("kind") == "multi_chapter_query"
    page = F.when(F.col("a") == F.col("b"), F.concat(F.lit("page "), F.col("a"))).otherwise(F.concat(F.lit("pages "), F.col("a"), F.lit("-"), F.col("b")))
    pair = F.concat(F.lit("chapter "), F.get("refs", F.lit(0)), F.lit(" and chapter "), F.get("refs", F.lit(1)))
    n = F.coalesce("n", F.lit(0))
    half = two & (F.col("refs_found") == 1)
    named = (
        F.when(F.col("kind") == "page_range", page).when(F.col("kind") == "chapter_query", F.concat(F.lit("Chapter "), F.get("refs", F.lit(0)))).when(two, pair)
        .when(F.col("kind") == "section_query", F.concat(F.lit('the section on "'), F.col("hint"), F.lit('"'))).otherwise(F.lit("the document"))
    )
    asked = ~F.col("kind").isin("document_query", "normal_query")
    missing = F.when(F.col("kind") == "section_query", F.concat(F.lit('I couldn\'t find a section on "'), F.col("hint"), F.lit('" in this document.'))).otherwise(F.concat(F.lit("I couldn't find "), named, F.lit(" in this document.")))
    focus = F.when(half, F.concat(named, F.lit(" (only chapter "), F.get("refs", F.col("first_ref")), F.lit(" was found)"))).otherwise(named)
    verdicts = v.select(
        "question_id", "kind", focus.alias("focus"), F.when(asked & (n == 0), 0.0).when(half, 0.5).otherwise(1.0).alias("confidence"),
        F.when(asked & (n == 0), missing).alias("not_found"), n.cast("long").alias("chunks"),
    )
    return rows.select("question_id", "position", "id"), verdicts


def section_runs(chunks: DataFrame) -> DataFrame:
    """chunks with `run`: numbers of stretches of equal (chapter, section) in a chat, a missing chapter equal to a missing one; a
    chunk whose section is missing or empty is a run alone."""
    by = W.partitionBy("chat_id").orderBy(*reading_order())
    same = F.lag("chapter").over(by).eqNullSafe(F.col("chapter")) & (F.lag("section").over(by) == F.col("section")) & (F.col("section") != "")
    first = F.row_number().over(by) == 1
    return chunks.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)) & ~first, 0).otherwise(1)).over(by))


def summary_batches(chunks: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """chunks with `run` and `batch`, a run's chunks by tens; and chars and single_shot of the chat."""
    rows = section_runs(chunks)
    place = F.row_number().over(W.partitionBy("chat_id", "run").orderBy(*reading_order()))
    chars = F.sum(F.length("text")).over(W.partitionBy("chat_id"))
    return rows.withColumns({"batch": F.floor((place - 1) / cfg.section_batch).cast("long"), "chars": chars, "single_shot": chars <= cfg.single_shot_chars})


def overview_sample(chunks: DataFrame, most: int = 40) -> DataFrame:
    """Every n-th chunk of a chat with more than `most`, n so that about that many remain; all of a smaller one."""
    count = F.count("*").over(W.partitionBy("chat_id"))
    place = F.row_number().over(W.partitionBy("chat_id").orderBy("ord"))
    step = F.greatest(F.lit(1), F.floor(count / most))
    return chunks.withColumn("__take", (count <= most) | ((place - 1) % step == 0)).where("__take").drop("__take")


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each chat."""
    return messages.withColumn("__n", F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("id")))).where(F.col("__n") <= n).drop("__n")

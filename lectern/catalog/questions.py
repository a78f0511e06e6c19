"""Queries over questions: user turns and a fixed list that has what the turns lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import query as Q
from ..operators import scope
from ..plans import longform
from ..sources.tables import chunks, table
from .common import CHUNKS, first_of, quoted, re2, registry

REGISTRY, register = registry()

QUESTIONS = (
    "What is equation 3?", "Compare chapter 2 and chapter 5", "Explain chapter 3 in detail", "page 12", "pages 9-4 please", "Summarize pages 10 to 12", "briefly explain recursion",
    "Who wrote this book?", "How many layers does the cnn use in 1999 or 2100?", "List the types of widgets in Flutter and JavaScript", "translate this in English",
    'What does the section on "Memory models" say?', "section about Neural networks", "study notes for chapter 4", "exam prep: quiz me", "history of Java 1499 1500 2099", "cite the source for 92.5 percent",
    "this code uses a rest api", "make it shorter", "go deeper and say more", "Is it true?", "Is it true and why?", "teach me like a teacher", "bullet points, formal tone", "where can i find formula 7 on page 8",
    "explain this chapter", "summarize the whole document", "outline", "eli5: how does bert work", "in depth technical detail", "chapter iv overview of sql", "tl;dr", "what's the difference between lstm and rnn?",
    "chapters 2 and 77", "Explain ch. 1", "eq. 12 and Equation 4",
)
_VALUES = ", ".join(f"('l{i:02d}', {i % 20}, {quoted(q)})" for i, q in enumerate(QUESTIONS))
_Q = f"q AS (SELECT 'c' || conv_id || '-' || turn AS question_id, conv_id % 20 AS chat_id, text AS q FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES {_VALUES}) t(question_id, chat_id, q))"


def all_questions(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    asked = turns.select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("question_id"), (F.col("conv_id") % 20).alias("chat_id"), F.col("text").alias("question"))
    return asked.union(fixed_questions(spark))


def fixed_questions(spark):
    return spark.createDataFrame([(f"l{i:02d}", i % 20, q) for i, q in enumerate(QUESTIONS)], "question_id string, chat_id long, question string")


@register(f"WITH {_Q} SELECT question_id, {first_of('q', fixed.INTENTS, fixed.DEFAULT_INTENT)} AS intent, {first_of('q', fixed.COMPLEXITIES, fixed.DEFAULT_COMPLEXITY)} AS complexity FROM q")
def intent_classification(spark, d):
    return all_questions(spark, d).select("question_id", Q.intent(F.col("question")).alias("intent"), Q.complexity(F.col("question")).alias("complexity"))


@register(f"WITH {_Q} SELECT question_id, {first_of('q', fixed.STYLES, fixed.DEFAULT_STYLE)} AS style FROM q")
def answer_style(spark, d):
    return all_questions(spark, d).select("question_id", Q.style(F.col("question")).alias("style"))


@register(f"WITH {_Q} SELECT question_id, CASE WHEN regexp_matches(q, {re2(fixed.EXPLAIN)}) THEN 'explain' ELSE 'specific' END AS depth, regexp_matches(q, {re2(fixed.OUTLINE_REQUEST)}) AS outline FROM q")
def explain_and_outline(spark, d):
    q = F.col("question")
    return all_questions(spark, d).select("question_id", Q.explains(q).alias("depth"), longform.wants_outline(q, F.lit("document_query")).alias("outline"))


def _group(pattern: str, group: int = 1) -> str:
    return f"CASE WHEN regexp_matches(q, {re2(pattern)}) THEN regexp_extract(q, {re2(pattern)}, {group}) END"


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(q, {re2(pattern)}, {group})"


_RE = {name: getattr(fixed, name).replace("؀-ۿ", r"\x{0600}-\x{06FF}") for name in ("SECTION_HINT", "CHAPTER_HINT", "PAGE_REFERENCE", "NUMBER", "YEAR", "QUOTED", "QUOTED_SECTION")}
_TECH = r"(?iu)\b(" + "|".join(fixed.TECHNOLOGIES) + r")\b"
_PAGES = f"list_transform({_all(_RE['PAGE_REFERENCE'], 1)}, lambda x: CAST(x AS INTEGER))"


@register(
    f"""WITH {_Q} SELECT question_id, array_to_string({_all(_RE['NUMBER'])}, ',') AS numbers, array_to_string({_PAGES}, ',') AS pages, trim({_group(_RE['CHAPTER_HINT'])}) AS chapter_hint,
    trim(coalesce({_group(_RE['QUOTED'])}, {_group(_RE['SECTION_HINT'])})) AS section_hint, array_to_string({_all(_RE['YEAR'], 1)}, ',') AS dates,
    array_to_string(list_sort(list_distinct(list_transform({_all(_TECH, 1)}, lambda x: lower(x)))), ',') AS technologies,
    array_to_string(list_transform(list_zip({_all(fixed.FORMULA, 1)}, {_all(fixed.FORMULA, 2)}), lambda x: x[1] || ' ' || x[2]), ',') AS formulas FROM q"""
)
def entity_extraction(spark, d):
    u = Q.understand(all_questions(spark, d))
    return u.select(
        "question_id", F.array_join("numbers", ",").alias("numbers"), F.array_join(F.transform("page_references", lambda x: x.cast("string")), ",").alias("pages"), "chapter_hint", "section_hint",
        F.array_join("dates", ",").alias("dates"), F.array_join("technologies", ",").alias("technologies"), F.array_join("formulas", ",").alias("formulas"),
    )


_STRATEGY = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.STRATEGIES.items()) + f" ELSE '{fixed.DEFAULT_STRATEGY}' END"
_DEPTH = "CASE WHEN intent IN (" + ", ".join(f"'{i}'" for i in fixed.DEEP_INTENTS) + ") THEN 'explain' ELSE 'specific' END"


@register(
    f"""WITH {_Q}, i AS (SELECT question_id, {first_of('q', fixed.INTENTS, fixed.DEFAULT_INTENT)} AS intent, {_PAGES} AS pages FROM q), s AS (SELECT *, {_STRATEGY} AS strategy FROM i)
    SELECT question_id, strategy, {_DEPTH} AS depth, CASE strategy WHEN 'filter_only' THEN 0.5::DOUBLE WHEN 'multi_target' THEN 1.5::DOUBLE ELSE 1::DOUBLE END AS candidate_multiplier, CASE WHEN len(pages) = 1 THEN pages[1] END AS filter_page FROM s"""
)
def query_plan(spark, d):
    return Q.understand(all_questions(spark, d)).select("question_id", "strategy", "depth", "candidate_multiplier", "filter_page")


@register(
    f"""WITH {_Q}, i AS (SELECT *, {first_of('q', fixed.INTENTS, fixed.DEFAULT_INTENT)} AS intent FROM q), d AS (SELECT *, {_DEPTH} AS depth, trim(q) AS s FROM i)
    SELECT question_id, CASE {' '.join(f"WHEN regexp_matches(q, {re2(p)}) THEN '{n}'" for n, p in fixed.LENGTH_SIGNALS)} WHEN depth = 'explain' THEN 'long'
    WHEN regexp_matches(s, {re2(fixed.SIMPLE_FACT)}) AND length(s) - length(replace(s, '?', '')) <= 1 AND NOT contains(lower(s), ' and ') THEN 'short' ELSE 'auto' END AS response_length FROM d"""
)
def response_length(spark, d):
    return Q.understand(all_questions(spark, d)).select("question_id", "response_length")


_CH = re2(fixed.CHAPTER)
SCOPES = f"""s0 AS (SELECT *, {first_of('q', fixed.STYLES, fixed.DEFAULT_STYLE)} AS mode, CAST({_group(fixed.CHAPTER)} AS INTEGER) AS ch, trim(coalesce({_group(_RE['QUOTED_SECTION'])}, {_group(_RE['SECTION_HINT'])})) AS sec,
    CAST({_group(fixed.SINGLE_PAGE)} AS INTEGER) AS pg, CAST({_group(fixed.PAGE_RANGE, 1)} AS INTEGER) AS pa, CAST({_group(fixed.PAGE_RANGE, 2)} AS INTEGER) AS pb FROM q),
  s1 AS (SELECT *, CASE WHEN regexp_matches(q, {re2(fixed.MULTI_CHAPTER)}) THEN 'multi_chapter_query' WHEN pa IS NOT NULL THEN 'page_range' WHEN ch IS NOT NULL THEN 'chapter_query' WHEN regexp_matches(q, {re2(fixed.WHOLE_DOCUMENT)}) THEN 'document_query'
    WHEN sec <> '' THEN 'section_query' WHEN pg IS NOT NULL THEN 'page_range' WHEN regexp_matches(q, {re2(fixed.IMPLIED_SCOPE)}) THEN 'document_query' ELSE 'normal_query' END AS query_type FROM s0),
  scopes AS (SELECT question_id, chat_id, query_type, CASE query_type WHEN 'multi_chapter_query' THEN regexp_extract(q, {re2(fixed.MULTI_CHAPTER)}, 1) || ',' || regexp_extract(q, {re2(fixed.MULTI_CHAPTER)}, 2) WHEN 'chapter_query' THEN ch::VARCHAR ELSE '' END AS chapters,
    CASE WHEN query_type = 'page_range' THEN coalesce(least(pa, pb), pg) END AS page_from, CASE WHEN query_type = 'page_range' THEN coalesce(greatest(pa, pb), pg) END AS page_to, CASE WHEN query_type = 'section_query' THEN sec END AS section_hint, mode AS explanation_mode,
    CASE WHEN mode IN ('detailed', 'academic', 'teaching', 'study_notes') THEN 'long' ELSE 'auto' END AS response_length FROM s1)"""


@register(f"WITH {_Q}, {SCOPES} SELECT question_id, query_type, chapters, page_from, page_to, section_hint, explanation_mode, response_length FROM scopes")
def long_context_scope(spark, d):
    s = all_questions(spark, d).select("question_id", Q.scope(F.col("question")).alias("s")).select("question_id", "s.*")
    return s.withColumn("chapters", F.array_join("chapters", ","))


_NAMED = "named AS (SELECT * FROM scopes WHERE query_type <> 'normal_query')"


def _scoped(spark, d):
    """Questions that name a scope; the others never meet the chunks."""
    return all_questions(spark, d).withColumn("scope", Q.scope(F.col("question"))).where("scope.query_type <> 'normal_query'")


_MATCH = f"""hit AS (SELECT question_id, r.pos AS ref_pos, c.id, c.page, c.paragraph_index, c.ord FROM named s, LATERAL (SELECT unnest(range(len(string_split(s.chapters, ',')))) AS pos, unnest(string_split(s.chapters, ',')) AS ref) r JOIN chunks c ON TRUE
    WHERE c.chat_id = s.chat_id AND CASE s.query_type WHEN 'page_range' THEN c.page BETWEEN s.page_from AND s.page_to WHEN 'section_query' THEN coalesce(contains(lower(c.section), lower(s.section_hint)), false)
    WHEN 'document_query' THEN true WHEN 'normal_query' THEN true ELSE coalesce(TRY_CAST(regexp_extract(c.chapter, '[0-9]+') AS INTEGER) = TRY_CAST(r.ref AS INTEGER), false) END)"""


@register(
    f"""WITH {CHUNKS}, {_Q}, {SCOPES}, {_NAMED}, {_MATCH}, g AS (SELECT s.*, count(h.id) AS n, count(DISTINCT h.ref_pos) AS refs, min(h.ref_pos) AS first FROM named s LEFT JOIN hit h USING (question_id) GROUP BY ALL),
    f AS (SELECT *, CASE query_type WHEN 'page_range' THEN CASE WHEN page_from = page_to THEN 'page ' || page_from ELSE 'pages ' || page_from || '-' || page_to END WHEN 'chapter_query' THEN 'Chapter ' || chapters
      WHEN 'multi_chapter_query' THEN 'chapter ' || string_split(chapters, ',')[1] || ' and chapter ' || string_split(chapters, ',')[2] WHEN 'section_query' THEN 'the section on "' || section_hint || '"' ELSE 'the document' END AS named, query_type = 'multi_chapter_query' AND refs = 1 AS half,
      query_type NOT IN ('document_query', 'normal_query') AND n = 0 AS lost FROM g)
    SELECT question_id, query_type AS kind, named || CASE WHEN half THEN ' (only chapter ' || string_split(chapters, ',')[first + 1] || ' was found)' ELSE '' END AS focus, CASE WHEN lost THEN 0::DOUBLE WHEN half THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS confidence,
    CASE WHEN lost AND query_type = 'section_query' THEN 'I couldn''t find a section on "' || section_hint || '" in this document.' WHEN lost THEN 'I couldn''t find ' || named || ' in this document.' END AS not_found, n AS chunks FROM f"""
)
def scope_resolution_failclosed(spark, d):
    return scope.resolve(_scoped(spark, d), chunks(spark, d))[1]


@register(
    f"""WITH {CHUNKS}, {_Q}, {SCOPES}, {_NAMED}, {_MATCH} SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY ref_pos, page, paragraph_index, ord) AS position, id FROM hit"""
)
def scope_chunks(spark, d):
    return scope.resolve(_scoped(spark, d), chunks(spark, d))[0].select("question_id", F.col("position").cast("bigint").alias("position"), "id")

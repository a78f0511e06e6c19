"""Queries over the chunk view: search, fusion, filters, neighbours, scopes, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.query import understand
from ..operators import context, retrieval, scope
from ..sources.tables import chunks, table
from .common import CHUNKS, TRIM, first_of, keywords, registry, sentences, tokens, words

REGISTRY, register = registry()

_QUERY = "the reader of those onion and the tion"


def asked(spark, d):
    """Benchmark items as questions, each to the chat of its number modulo 20, with the vector of its number, if there is one."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") % 20).alias("chat_id"), F.col("text").alias("question"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return q.join(v, "question_id", "left").withColumn("search_text", F.col("question"))


def one_question(spark, d, text=_QUERY):
    """One question to every chat."""
    chats = chunks(spark, d, body=False).select("chat_id").distinct()
    return chats.select(F.col("chat_id").alias("question_id"), "chat_id", F.lit(text).alias("search_text"))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_Q = "q AS (SELECT item_id AS question_id, item_id % 20 AS chat_id, b.text AS question, CAST(embedding AS DOUBLE[]) AS vector FROM benchmark b LEFT JOIN embeddings ON vec_id = item_id)"
_INDEX = f"""toks AS (SELECT chat_id, id, ord, {tokens('text')} AS t FROM chunks), corpus AS (SELECT chat_id, count(*) AS n, avg(len(t)) AS avgdl FROM toks GROUP BY 1),
  post AS (SELECT chat_id, id, ord, len, term, count(*) AS tf FROM (SELECT chat_id, id, ord, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY ALL), df AS (SELECT chat_id, term, count(*) AS df FROM post GROUP BY ALL)"""
_BM25 = """bm AS (SELECT question_id, id, ord, sum(times * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 1e-9::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))) AS bm25
  FROM terms JOIN post USING (chat_id, term) JOIN df USING (chat_id, term) JOIN corpus USING (chat_id) GROUP BY ALL)"""


def _terms(source: str) -> str:
    return f"terms AS (SELECT question_id, chat_id, term, count(*) AS times FROM (SELECT question_id, chat_id, unnest({tokens('question')}) AS term FROM {source}) GROUP BY ALL)"


_ONE = f"one AS (SELECT DISTINCT chat_id AS question_id, chat_id, '{_QUERY}' AS question FROM chunks)"


@register(
    f"""WITH {CHUNKS}, {_ONE}, {_INDEX}, {_terms('one')}, {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9) DESC, ord) AS rank FROM bm WHERE bm25 > 0)
    SELECT question_id, id, round(bm25 / max(bm25) OVER (PARTITION BY question_id), 6) AS keyword_score, rank FROM r WHERE rank <= 8"""
)
def bm25_search_topk(spark, d):
    found = retrieval.keyword_search(one_question(spark, d), chunks(spark, d), 8)
    return _rounded(found.select("question_id", "id", "keyword_score", F.col("rank").cast("bigint").alias("rank")), "keyword_score")


@register(
    f"""WITH {CHUNKS}, {_Q}, {_INDEX}, {_terms('q')}, {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9) DESC, ord) AS rank FROM bm)
    SELECT question_id, id, round(bm25, 6) AS bm25, rank FROM r WHERE rank <= 30"""
)
def bm25_batch_queries(spark, d):
    found = retrieval.bm25(asked(spark, d), chunks(spark, d))
    found = retrieval.ranked(found, ["question_id"], retrieval.tied("bm25"), F.col("ord")).where("rank <= 30")
    return _rounded(found.select("question_id", "id", "bm25", F.col("rank").cast("bigint").alias("rank")), "bm25")


@register(
    """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score
    FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 10"""
)
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id = 7").select("embedding").scalar()
    scored = e.select("vec_id", "embedding", q.alias("vector")).select("vec_id", T.let(F.col("vector"), lambda v: T.cosine(F.col("embedding"), v)).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("score"))


_NEAR = f"""near AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 9) DESC, ord) AS rank FROM (SELECT question_id, c.id, c.ord, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.vector) AS s
  FROM q JOIN chunks c USING (chat_id) JOIN embeddings e ON e.vec_id = c.id WHERE q.vector IS NOT NULL))"""


@register(f"WITH {CHUNKS}, {_Q}, {_NEAR} SELECT question_id, id, round(s, 6) AS semantic_score, rank FROM near WHERE rank <= 8")
def cosine_batch_topk(spark, d):
    found = retrieval.semantic_search(asked(spark, d), chunks(spark, d, vectors=True), 8, -2.0)
    return _rounded(found.select("question_id", "id", "semantic_score", F.col("rank").cast("bigint").alias("rank")), "semantic_score")


@register(f"WITH {CHUNKS}, {_Q}, {_NEAR} SELECT question_id, id, round(s, 6) AS semantic_score FROM near WHERE rank <= 8 AND s >= 0.1::DOUBLE")
def semantic_threshold(spark, d):
    found = retrieval.semantic_search(asked(spark, d), chunks(spark, d, vectors=True), 8, 0.1)
    return _rounded(found.select("question_id", "id", "semantic_score"), "semantic_score")


_SIDES = f"""sem AS (SELECT question_id, id, ord, s, rank FROM near WHERE rank <= most AND s >= 0),
  kw0 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9) DESC, ord) AS r0 FROM bm WHERE bm25 > 0),
  kw AS (SELECT question_id, id, ord, bm25 / max(bm25) OVER (PARTITION BY question_id) AS k, r0 AS rank FROM kw0 JOIN plan USING (question_id) WHERE r0 <= most),
  fused AS (SELECT question_id, id, ord, sum(s) AS semantic_score, max(k) AS keyword_score, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT question_id, id, ord, s, 0::DOUBLE AS k, rank FROM sem UNION ALL SELECT question_id, id, ord, 0::DOUBLE, k, rank FROM kw) GROUP BY ALL)"""
_PLAN30 = "plan AS (SELECT question_id, 30 AS most FROM q)"
_NEARP = _NEAR.replace("SELECT *, row_number()", "SELECT x.*, most, row_number()").replace("c.id WHERE q.vector IS NOT NULL)", "c.id WHERE q.vector IS NOT NULL) x JOIN plan USING (question_id)")


@register(f"WITH {CHUNKS}, {_Q}, {_PLAN30}, {_NEARP}, {_INDEX}, {_terms('q')}, {_BM25}, {_SIDES} SELECT question_id, id, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score, round(rrf, 6) AS rrf FROM fused")
def rrf_fusion(spark, d):
    q, c = asked(spark, d), chunks(spark, d, vectors=True)
    both = retrieval.fuse(retrieval.semantic_search(q, c, 30), retrieval.keyword_search(q, c, 30))
    return _rounded(both.drop("ord"), "semantic_score", "keyword_score", "rrf")


_INTENT = first_of("question", fixed.INTENTS, fixed.DEFAULT_INTENT)
_DEEP = "intent IN (" + ", ".join(f"'{i}'" for i in fixed.DEEP_INTENTS) + ")"
_UNDERSTOOD = f"""u AS (SELECT question_id, {keywords('question')} AS kws, regexp_extract_all(question, '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?') AS nums, {_INTENT} AS intent FROM q),
  plan AS (SELECT question_id, kws, nums, CASE WHEN {_DEEP} THEN 8 ELSE 4 END AS k, CAST(floor(30 * CASE intent WHEN 'page_request' THEN 0.5::DOUBLE WHEN 'comparison' THEN 1.5::DOUBLE ELSE 1 END) AS INTEGER) AS most FROM u)"""
_RERANKED = f"""rr AS (SELECT f.*, plan.k AS topk, least(1::DOUBLE, CASE WHEN len(nums) > 0 THEN 0.35::DOUBLE * len(list_filter(nums, lambda n: contains(c.text, n))) / len(nums) ELSE 0 END
    + CASE WHEN len(kws) > 0 THEN 0.35::DOUBLE * least(1::DOUBLE, len(list_filter(kws, lambda w: contains(lower(c.text), w))) / len(kws)) ELSE 0 END) AS rerank_score FROM fused f JOIN plan USING (question_id) JOIN chunks c USING (id)),
  best AS (SELECT *, 0.3::DOUBLE * semantic_score + 0.2::DOUBLE * keyword_score + 0.5::DOUBLE * rerank_score AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(0.3::DOUBLE * semantic_score + 0.2::DOUBLE * keyword_score + 0.5::DOUBLE * rerank_score, 9) DESC, round(rrf, 9) DESC, ord) AS rank FROM rr)"""
HYBRID_SQL = f"{CHUNKS}, {_Q}, {_UNDERSTOOD}, {_NEARP}, {_INDEX}, {_terms('q')}, {_BM25}, {_SIDES}, {_RERANKED}, top AS (SELECT * FROM best WHERE rank <= topk)"


def hybrid(spark, d):
    return retrieval.hybrid_search(understand(asked(spark, d)), chunks(spark, d, vectors=True))


@register(f"WITH {HYBRID_SQL} SELECT question_id, id, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score, round(rerank_score, 6) AS rerank_score, round(score, 6) AS score, rank FROM top")
def hybrid_rerank_topk(spark, d):
    found = hybrid(spark, d).select("question_id", "id", "semantic_score", "keyword_score", "rerank_score", "score", F.col("rank").cast("bigint").alias("rank"))
    return _rounded(found, "semantic_score", "keyword_score", "rerank_score", "score")


@register(f"WITH {HYBRID_SQL} SELECT q.question_id, round(max(semantic_score), 6) AS best, coalesce(max(semantic_score) < 0.25::DOUBLE, true) AS is_out_of_scope FROM q LEFT JOIN top USING (question_id) GROUP BY 1")
def out_of_scope_flag(spark, d):
    q = understand(asked(spark, d))
    return _rounded(retrieval.out_of_scope(q, retrieval.hybrid_search(q, chunks(spark, d, vectors=True))), "best")


@register(f"WITH {CHUNKS} SELECT chat_id, id, page FROM chunks WHERE contains(lower(chapter), 'chapter 3') AND contains(lower(section), 'section') AND contains(document_id, CAST(chat_id AS VARCHAR))")
def metadata_filter(spark, d):
    """Each chat's question names its own document; page 0 names none."""
    own = chunks(spark, d, body=False)
    wanted = own.groupBy("chat_id").agg(F.min("document_id").alias("wanted"))
    keep = retrieval.metadata_filter(F.col("wanted"), F.lit(" Chapter 3 "), F.lit("section"), F.lit(0))
    return own.join(wanted, "chat_id").where(keep).select("chat_id", "id", "page")


_HINTS = "h AS (SELECT c.chat_id * 10 + k AS question_id, c.chat_id, hint, p FROM (SELECT DISTINCT chat_id FROM chunks) c, (VALUES (0, 'chapter 2', NULL), (1, 'chapter 99', NULL), (2, NULL, 3), (3, 'chapter 1', 2), (4, NULL, NULL), (5, 'chapter 1', 77)) t(k, hint, p))"


def hints(spark, d):
    """Six questions to every chat; some hints are found nowhere."""
    rows = ((0, "chapter 2", None), (1, "chapter 99", None), (2, None, 3), (3, "chapter 1", 2), (4, None, None), (5, "chapter 1", 77))
    every = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(h).cast("string").alias("hint"), F.lit(p).cast("int").alias("p")) for k, h, p in rows))
    chats = chunks(spark, d, body=False).select("chat_id").distinct()
    return chats.select("chat_id", F.explode(every).alias("h")).select((F.col("chat_id") * 10 + F.col("h.k")).alias("question_id"), "chat_id", "h.hint", "h.p")


@register(
    f"""WITH {CHUNKS}, {_HINTS}, m AS (SELECT question_id, id, (hint IS NULL OR coalesce(contains(lower(chapter), hint), false)) AND (p IS NULL OR page = p) AS ok FROM h JOIN chunks USING (chat_id))
    SELECT question_id, id FROM (SELECT *, bool_or(ok) OVER (PARTITION BY question_id) AS hit FROM m) WHERE ok OR NOT hit"""
)
def metadata_filter_fallback(spark, d):
    pairs = chunks(spark, d, body=False).join(hints(spark, d), "chat_id")
    return retrieval.with_fallback(pairs, retrieval.metadata_filter(None, F.col("hint"), None, F.col("p"))).select("question_id", "id")


@register(
    f"""WITH {CHUNKS}, {_ONE}, {_INDEX}, {_terms('one')}, {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9) DESC, ord) AS rank FROM bm)
    SELECT question_id, r.id, rank FROM r JOIN chunks c ON c.id = r.id WHERE rank <= 15 AND contains(lower(chapter), 'chapter 2')"""
)
def limit_then_filter(spark, d):
    c = chunks(spark, d)
    pool = chunks(spark, d, body=False).where(retrieval.contains(F.col("chapter"), F.lit("chapter 2"))).select("id")
    found = retrieval.keyword_search(one_question(spark, d), c, 15).join(pool, "id", "left_semi")
    return found.select("question_id", "id", F.col("rank").cast("bigint").alias("rank"))


@register(f"WITH {HYBRID_SQL} SELECT DISTINCT question_id, n.id, n.ord FROM top t JOIN chunks c ON c.id = t.id JOIN chunks n ON n.chat_id = c.chat_id AND n.ord BETWEEN c.ord - 1 AND c.ord + 1")
def neighbor_expansion(spark, d):
    c = chunks(spark, d, body=False)
    picked = hybrid(spark, d).select("question_id", "id").join(c.select("id", "chat_id", "ord"), "id")
    return retrieval.neighbours(picked, c, 1).select("question_id", "id", "ord")


@register(f"WITH {CHUNKS} SELECT id, previous_chunk_id, next_chunk_id FROM chunks")
def prev_next_links(spark, d):
    return chunks(spark, d, body=False).select("id", "previous_chunk_id", "next_chunk_id")


@register(f"WITH {CHUNKS} SELECT chat_id, id, page, row_number() OVER (PARTITION BY chat_id ORDER BY page, paragraph_index, ord) AS position FROM chunks WHERE page BETWEEN 4 AND 9")
def page_range_scope(spark, d):
    rows = scope.page_range(chunks(spark, d, body=False), 4, 9)
    return retrieval.ranked(rows, ["chat_id"], *scope.reading_order(), name="position").select("chat_id", "id", "page", F.col("position").cast("bigint").alias("position"))


@register(f"WITH {CHUNKS} SELECT chat_id, id FROM chunks WHERE CAST(regexp_extract(chapter, '[0-9]+') AS INTEGER) = 3")
def chapter_scope(spark, d):
    c = chunks(spark, d)
    wanted = chunks(spark, d, body=False).select("chat_id").distinct().select(F.col("chat_id").alias("question_id"), "chat_id", F.lit(0).alias("ref_pos"), F.lit("3").alias("ref"))
    return scope.chapters(wanted, c).select(F.col("question_id").alias("chat_id"), "id")


@register(f"WITH {CHUNKS}, w AS (SELECT * FROM (VALUES (0, '2'), (1, '5'), (2, '77')) t(ref_pos, ref)) SELECT chat_id, ref_pos, ref, id FROM w JOIN chunks ON TRY_CAST(regexp_extract(chapter, '[0-9]+') AS INTEGER) = CAST(ref AS INTEGER)")
def multi_chapter_scope(spark, d):
    c = chunks(spark, d)
    wanted = chunks(spark, d, body=False).select("chat_id").distinct().select(F.col("chat_id").alias("question_id"), "chat_id", F.posexplode(T.literals(("2", "5", "77"))).alias("ref_pos", "ref"))
    return scope.chapters(wanted, c).select(F.col("question_id").alias("chat_id"), "ref_pos", "ref", "id")


@register(f"WITH {CHUNKS} SELECT chat_id, id FROM chunks WHERE contains(lower(section), 'section 4')")
def section_scope(spark, d):
    c = chunks(spark, d, body=False)
    wanted = c.select("chat_id").distinct().select(F.col("chat_id").alias("question_id"), "chat_id", F.lit(" Section 4").alias("hint"))
    return scope.sections(wanted, c).select(F.col("question_id").alias("chat_id"), "id")


_REL = "(id % 13)::DOUBLE / 13"


_TENS = "sel AS (SELECT *, chat_id * 1000000 + ord // 10 AS question_id, ord AS pos FROM chunks)"


def _selected(spark, d, body=True):
    """All chunks, ten in a row of a chat as what one question has selected."""
    c = chunks(spark, d, body=body)
    question = (F.col("chat_id") * 1_000_000 + F.floor(F.col("ord") / 10)).cast("bigint").alias("question_id")
    more = ["text"] if body else []
    return c.select(question, "chat_id", F.col("ord").alias("pos"), "ord", "id", "local_id", "previous_chunk_id", "chapter", "section", "heading", "page", *more, ((F.col("id") % 13).cast("double") / 13).alias("relevance"))


@register(
    f"""WITH {CHUNKS}, {_TENS}, s AS (SELECT question_id, pos, id, chapter, section, page, max({_REL}) OVER g AS best, min(pos) OVER g AS first FROM sel WINDOW g AS (PARTITION BY question_id, chapter, section))
    SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY best DESC, first, page, pos) AS place FROM s"""
)
def context_ordering(spark, d):
    return context.order_context(_selected(spark, d, body=False)).select("question_id", "id", F.col("place").cast("bigint").alias("place"))


_RUNS = f"""r AS (SELECT *, sum(CASE WHEN section <> '' AND section = ps AND chapter IS NOT DISTINCT FROM pc THEN 0 ELSE 1 END) OVER (PARTITION BY chat_id ORDER BY page, paragraph_index, ord) AS run FROM
  (SELECT *, lag(chapter) OVER w AS pc, lag(section) OVER w AS ps FROM chunks WINDOW w AS (PARTITION BY chat_id ORDER BY page, paragraph_index, ord)))"""


@register(f"WITH {CHUNKS}, {_RUNS} SELECT chat_id, run::BIGINT AS run, any_value(chapter) AS chapter, any_value(section) AS section, count(*) AS n, min(id) AS first_id FROM r GROUP BY chat_id, run")
def section_runs(spark, d):
    r = scope.section_runs(chunks(spark, d, body=False))
    return r.groupBy("chat_id", "run").agg(F.max("chapter").alias("chapter"), F.max("section").alias("section"), F.count("*").alias("n"), F.min("id").alias("first_id"))


@register(
    f"""WITH {CHUNKS}, {_RUNS}, b AS (SELECT *, (row_number() OVER (PARTITION BY chat_id, run ORDER BY page, paragraph_index, ord) - 1) // 10 AS batch, sum(length(text)) OVER (PARTITION BY chat_id) AS total FROM r)
    SELECT chat_id, run::BIGINT AS run, batch::BIGINT AS batch, count(*) AS n, sum(length(text))::BIGINT AS chars, any_value(total) <= 300000 AS single_shot FROM b GROUP BY ALL"""
)
def map_reduce_batches(spark, d):
    b = scope.summary_batches(chunks(spark, d))
    return b.groupBy("chat_id", "run", "batch").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("single_shot").alias("single_shot"))


@register(f"WITH {CHUNKS}, c AS (SELECT *, count(*) OVER (PARTITION BY chat_id) AS n FROM chunks) SELECT chat_id, id, substr(text, 1, 300) AS snippet FROM c WHERE n <= 40 OR ord % greatest(1, n // 40) = 0")
def overview_sample(spark, d):
    return scope.overview_sample(chunks(spark, d)).select("chat_id", "id", F.substring("text", 1, 300).alias("snippet"))


@register(
    f"""WITH {CHUNKS}, f AS (SELECT *, row_number() OVER (PARTITION BY chat_id, chapter, section ORDER BY page, paragraph_index, ord) AS n FROM chunks WHERE section IS NOT NULL)
    SELECT chat_id, chapter, 'section' AS level, section AS text, page, row_number() OVER w AS position, row_number() OVER w AS number FROM f WHERE n = 1 WINDOW w AS (PARTITION BY chat_id, chapter ORDER BY page, paragraph_index, ord)"""
)
def chapter_outline(spark, d):
    o = context.outline(chunks(spark, d, body=False), ["chat_id", "chapter"])
    return o.select("chat_id", "chapter", "level", "text", "page", F.col("position").cast("bigint").alias("position"), "number")


@register(
    f"""WITH {CHUNKS}, f AS (SELECT *, row_number() OVER (PARTITION BY chat_id, page, section, heading ORDER BY ord) AS n FROM chunks), g AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ord) AS r FROM f WHERE n = 1)
    SELECT chat_id, document_id, page, chapter, section, r AS citation_rank FROM g WHERE r <= 12"""
)
def citations_distinct(spark, d):
    c = context.distinct_citations(chunks(spark, d, body=False), ["chat_id"], "ord")
    return c.select("chat_id", "document_id", "page", "chapter", "section", F.col("citation_rank").cast("bigint").alias("citation_rank"))


_DEDUPED = f"""n AS (SELECT question_id, id, pos, lower(array_to_string({words('text')}, ' ')) AS norm, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS k FROM {{0}}),
  fold AS (SELECT DISTINCT question_id, 0::BIGINT AS k, []::VARCHAR[] AS kept, []::BIGINT[] AS ids FROM n
    UNION ALL SELECT f.question_id, f.k + 1, CASE WHEN held THEN kept ELSE list_append(kept, norm) END, CASE WHEN held THEN ids ELSE list_append(ids, id) END
    FROM fold f JOIN n ON n.question_id = f.question_id AND n.k = f.k + 1, LATERAL (SELECT list_contains(ids, id) OR norm <> '' AND len(list_filter(kept, lambda x: contains(x, norm) OR contains(norm, x))) > 0 AS held)),
  few AS (SELECT question_id, unnest(arg_max(ids, k)) AS id FROM fold GROUP BY question_id)"""


@register(f"WITH RECURSIVE {CHUNKS}, {_TENS}, {_DEDUPED.replace('{0}', 'sel')} SELECT question_id, id FROM few")
def containment_dedupe(spark, d):
    return context.dedupe(_selected(spark, d)).select("question_id", "id")


_STEPPED = "sel AS (SELECT *, chat_id * 2 + CAST(ord % 5 >= 3 AS INTEGER) AS question_id, CAST((id * 7) % 31 AS INTEGER) AS pos FROM chunks)"
_MERGED = """lk AS (SELECT a.*, b.id IS NOT NULL AS linked FROM {0} a LEFT JOIN {0} b ON b.question_id = a.question_id AND CAST(b.id AS VARCHAR) = a.previous_chunk_id AND b.chapter IS NOT DISTINCT FROM a.chapter AND b.section IS NOT DISTINCT FROM a.section),
  rn AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY question_id ORDER BY ord) AS run FROM lk),
  hd AS (SELECT *, NOT EXISTS (SELECT 1 FROM rn y WHERE y.question_id = x.question_id AND y.run = x.run AND y.ord < x.ord AND (y.pos, y.ord) <= (x.pos, x.ord)) AS head FROM rn x),
  gr AS (SELECT *, max(CASE WHEN head THEN ord END) OVER (PARTITION BY question_id, run ORDER BY ord) AS grp FROM hd),
  merged AS (SELECT question_id, arg_min(id, ord) AS id, min(ord) AS ord, arg_min(pos, ord) AS pos, arg_min(chapter, ord) AS chapter, arg_min(section, ord) AS section, arg_min(page, ord) AS page, count(*) AS merged, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM gr GROUP BY question_id, run, grp)"""


@register(f"WITH {CHUNKS}, {_STEPPED}, {_MERGED.replace('{0}', 'sel')} SELECT question_id, id, merged, length(text) AS chars FROM merged")
def merge_adjacent(spark, d):
    """All chunks, of each five in a row three selected by one question and two by another, in a place of their own."""
    question = (F.col("chat_id") * 2 + (F.col("ord") % 5 >= 3).cast("int")).cast("bigint")
    c = chunks(spark, d).withColumns({"question_id": question, "pos": F.pmod(F.col("id") * 7, F.lit(31)).cast("int")})
    m = context.merge_adjacent(c)
    return m.select("question_id", "id", "merged", F.length("text").cast("bigint").alias("chars"))


_OWN = f"CAST(floor(len({words('text')}) * 1.3::DOUBLE) AS BIGINT)"


@register(f"WITH {CHUNKS}, {_TENS}, t AS (SELECT question_id, id, pos, {_OWN} AS tokens FROM sel) SELECT question_id, id, tokens, sum(tokens) OVER (PARTITION BY question_id ORDER BY pos) <= 3000 AS kept FROM t")
def context_budget(spark, d):
    """Without search terms nothing is compressed: chunks are dropped from the end."""
    none = F.array().cast("array<string>")
    rows = _selected(spark, d).withColumns({"place": F.col("pos"), "keywords": none, "numbers": none})
    return context.fit_budget(rows, 3000).select("question_id", "id", "tokens", "kept")


def _fitted(rows: str, keywords: str, numbers: str, budget: int) -> str:
    """Rows (question_id, id, place, text, ...) with `short`, tokens, compressed, kept."""
    est = lambda t: f"CAST(floor(len({words(t)}) * 1.3::DOUBLE) AS BIGINT)"
    score = f"len(list_filter({keywords}, lambda k: contains(lower(x), k))) * 1.0::DOUBLE + len(list_filter({numbers}, lambda k: contains(x, k))) * 1.5::DOUBLE"
    item = "{{'s': {0}, 'i': {1}, 'n': {2}, 't': {3}, 'kept': {4}}}"
    none = "[]::STRUCT(i BIGINT, t VARCHAR)[]"
    first = item.format("0::DOUBLE", "0::BIGINT", "0::BIGINT", "''", none)
    fits = "(a.n + x.n <= target OR len(a.kept) = 0)"
    step = item.format("0::DOUBLE", "0::BIGINT", f"CASE WHEN {fits} THEN a.n + x.n ELSE a.n END", "''", f"CASE WHEN {fits} THEN list_append(a.kept, {{'i': x.i, 't': x.t}}) ELSE a.kept END")
    own = item.format(f"-({score})", "i::BIGINT", est("x"), "x", none)
    return f"""b0 AS (SELECT *, {est('text')} AS own, {sentences('text')} AS parts FROM {rows}), b1 AS (SELECT *, sum(own) OVER (PARTITION BY question_id) AS total,
    greatest(least(40, {budget}), least(own // 2, {budget})) AS target FROM b0), b2 AS (SELECT *, total > {budget} AND len({keywords}) + len({numbers}) > 0 AS over FROM b1),
    b3 AS (SELECT *, CASE WHEN over AND own > target AND len(parts) > 1 THEN array_to_string(list_transform(list_sort(list_reduce(list_sort(list_transform(parts, lambda x, i: {own})), lambda a, x: {step}, {first}).kept), lambda k: k.t), ' ') ELSE text END AS short FROM b2),
    b4 AS (SELECT *, {est('short')} AS less FROM b3), b5 AS (SELECT *, over AND total - coalesce(sum(own - less) OVER (PARTITION BY question_id ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > {budget} AS cut FROM b4),
    b6 AS (SELECT *, cut AND short <> text AS compressed, CASE WHEN cut THEN less ELSE own END AS tokens FROM b5),
    fitted AS (SELECT *, sum(tokens) OVER (PARTITION BY question_id ORDER BY place) <= {budget} AS kept FROM b6)"""


_THE, _TWELVE = "['the', 'tion']", "['12']"


@register(f"WITH {CHUNKS}, {_TENS}, o AS (SELECT *, pos AS place FROM sel), {_fitted('o', _THE, _TWELVE, 3000)} SELECT question_id, id, tokens, compressed, kept FROM fitted")
def context_compression(spark, d):
    """With terms, the last chunks are compressed to their best sentences first."""
    rows = _selected(spark, d).withColumns({"place": F.col("pos"), "keywords": T.literals(("the", "tion")), "numbers": T.literals(("12",))})
    return context.fit_budget(rows, 3000).select("question_id", "id", "tokens", "compressed", "kept")


_AROUND = """sel AS (SELECT x.question_id, c.*, c.ord AS pos FROM (SELECT DISTINCT question_id, n.id FROM top t JOIN plan USING (question_id) JOIN chunks c ON c.id = t.id JOIN chunks n ON n.chat_id = c.chat_id AND abs(n.ord - c.ord) <= CASE WHEN plan.k = 8 THEN 1 ELSE 0 END) x JOIN chunks c USING (id))"""
_CLEANED = f"""cl AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), {TRIM})), lambda x: x = '' OR NOT regexp_matches(x, '^[^\\p{{L}}\\p{{N}}]{{1,10}}$')) AS l FROM merged),
  cleaned AS (SELECT * REPLACE (trim(regexp_replace(array_to_string(list_filter(l, lambda x, i: x = '' OR i = 1 OR x <> l[i - 1]), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), {TRIM}) AS text) FROM cl)"""
_ORDERED = """rel AS (SELECT m.*, kws, nums, coalesce(top.score, 0) AS relevance FROM cleaned m JOIN plan USING (question_id) LEFT JOIN top ON top.question_id = m.question_id AND top.id = m.id),
  og AS (SELECT *, max(relevance) OVER g AS best, min(pos) OVER g AS first FROM rel WINDOW g AS (PARTITION BY question_id, chapter, section)),
  o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY best DESC, first, page, pos) AS place FROM og)"""


@register(
    f"""WITH RECURSIVE {HYBRID_SQL}, {_AROUND}, {_DEDUPED.replace('{0}', 'sel')}, kept0 AS (SELECT sel.* FROM sel JOIN few USING (question_id, id)), {_MERGED.replace('{0}', 'kept0')}, {_CLEANED}, {_ORDERED}, {_fitted('o', 'kws', 'nums', 7000)}
    SELECT question_id, id, place, tokens, compressed, merged FROM fitted WHERE kept"""
)
def prepared_context(spark, d):
    """Retrieved chunks and their neighbours, where the question wants an explanation, through dedupe, merge, cleaning, order and budget."""
    c = chunks(spark, d)
    q = understand(asked(spark, d))
    found = retrieval.hybrid_search(q, chunks(spark, d, vectors=True))
    places = chunks(spark, d, body=False).select("id", "chat_id", "ord")
    picked = found.select("question_id", "id").join(places, "id").join(q.select("question_id", "depth"), "question_id")
    near = retrieval.neighbours(picked, places, retrieval.window_of(F.col("depth")))
    rows = near.select("question_id", "id").join(c, "id").join(found.select("question_id", "id", F.col("score").alias("relevance")), ["question_id", "id"], "left")
    rows = rows.withColumn("pos", F.col("ord")).join(q.select("question_id", "keywords", "numbers"), "question_id")
    return context.prepare(rows).where("kept").select("question_id", "id", F.col("place").cast("bigint").alias("place"), "tokens", "compressed", "merged")


_ASKED = "[" + ", ".join(f"'{w}'" for w in _QUERY.split() if len(w) > 2) + "]"


@register(f"WITH {CHUNKS} SELECT id, least(1::DOUBLE, len(list_filter({_ASKED}, lambda w: contains(lower(text), w))) / len({_ASKED})) AS score FROM chunks")
def plain_rerank(spark, d):
    """Every chunk against one question of which nothing is known but its words."""
    return chunks(spark, d).select("id", retrieval.plain_rerank(F.lit(_QUERY)).alias("score"))

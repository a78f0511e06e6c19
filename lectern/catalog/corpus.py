"""Queries over texts: tokens, terms, languages, sentences, estimates, page signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parsing, retrieval
from ..sources.tables import chunks, table
from .common import CHUNKS, registry, sentences, tokens, words

REGISTRY, register = registry()


@register(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)")
def tokenize_stats(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@register(
    f"""WITH c AS (SELECT source, term, count(*) AS tf FROM (SELECT source, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tf DESC, term) AS rank FROM c) SELECT source, term, tf, rank FROM r WHERE rank <= 20"""
)
def doc_term_frequency_topk(spark, d):
    terms = table(spark, d, "documents").select("source", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("tf"))
    return retrieval.ranked(terms, ["source"], F.desc("tf"), F.col("term")).where("rank <= 20").select("source", "term", "tf", F.col("rank").cast("bigint").alias("rank"))


_TERMS = f"terms AS (SELECT chat_id, id, ord, {tokens('text')} AS t FROM chunks), post AS (SELECT chat_id, id, ord, term, count(*) AS tf FROM (SELECT chat_id, id, ord, unnest(t) AS term FROM terms) GROUP BY ALL), corpus AS (SELECT chat_id, count(*) AS n, avg(len(t)) AS avgdl FROM terms GROUP BY 1)"


@register(
    f"""WITH {CHUNKS}, {_TERMS}, df AS (SELECT chat_id, term, count(*) AS df FROM post GROUP BY ALL)
    SELECT chat_id, term, df, round(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 1e-9::DOUBLE), 6) AS idf FROM df JOIN corpus USING (chat_id)"""
)
def bm25_idf(spark, d):
    return retrieval.term_stats(chunks(spark, d)).select("chat_id", "term", "df", F.round("idf", 6).alias("idf"))


@register(
    f"""WITH l AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x{{0600}}-\\x{{06FF}}]')) AS ar, len(regexp_extract_all(text, '[A-Za-z]')) AS la FROM documents)
    SELECT doc_id, CASE WHEN ar + la = 0 THEN NULL WHEN ar >= 0.15::DOUBLE * (ar + la) AND la >= 0.15::DOUBLE * (ar + la) THEN 'mixed' WHEN ar > la THEN 'ar' ELSE 'en' END AS language FROM l"""
)
def detect_language(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


@register(
    f"""WITH {CHUNKS}, l AS (SELECT document_id || '/' || (ord // 6) AS document_id, CASE id % 7 WHEN 0 THEN 'ar' WHEN 1 THEN 'mixed' WHEN 2 THEN NULL WHEN 3 THEN 'ar' ELSE 'en' END AS language FROM chunks)
    SELECT document_id, CASE WHEN m = 0 AND a > 0 AND e > 0 THEN 'mixed' WHEN greatest(m, a, e) = 0 THEN NULL WHEN m = greatest(m, a, e) THEN 'mixed' WHEN a = greatest(m, a, e) THEN 'ar' ELSE 'en' END AS language
    FROM (SELECT document_id, count(*) FILTER (language = 'mixed') AS m, count(*) FILTER (language = 'ar') AS a, count(*) FILTER (language = 'en') AS e FROM l GROUP BY 1)"""
)
def document_language_vote(spark, d):
    """Every six chunks of a chat are a document's pages; their languages are dealt by id, so that votes of all kinds occur."""
    pages = chunks(spark, d, body=False).withColumn("language", F.expr("CASE id % 7 WHEN 0 THEN 'ar' WHEN 1 THEN 'mixed' WHEN 2 THEN NULL WHEN 3 THEN 'ar' ELSE 'en' END"))
    return parsing.document_language(pages.withColumn("document_id", F.concat("document_id", F.lit("/"), F.floor(F.col("ord") / 6).cast("string"))))


@register(f"SELECT doc_id, CAST(floor(len({words('text')}) * 1.3::DOUBLE) AS BIGINT) AS tokens, sum(CAST(floor(len({words('text')}) * 1.3::DOUBLE) AS BIGINT)) OVER (PARTITION BY source)::BIGINT AS source_tokens FROM documents")
def token_estimates(spark, d):
    own = table(spark, d, "documents").select("doc_id", "source", T.estimated_tokens(F.col("text")).alias("tokens"))
    sums = own.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    return own.join(sums, "source").select("doc_id", "tokens", "source_tokens")


@register(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s[1] AS first, s[-1] AS last FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)")
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.get("s", F.lit(0)).alias("first"), F.get("s", F.size("s") - 1).alias("last"))


_KW = ("the", "tion", "password", "de")


@register(
    f"""WITH s AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)),
    r AS (SELECT doc_id, i, {' + '.join(f"contains(lower(sentence), '{k}')::INT * 1.0::DOUBLE" for k in _KW)} + contains(sentence, '12')::INT * 1.5::DOUBLE AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank FROM s)
    SELECT doc_id, i::BIGINT AS i, score, rank FROM r WHERE rank <= 3"""
)
def sentence_scoring(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    s = s.withColumn("score", T.sentence_score(F.col("sentence"), T.literals(_KW), T.literals(("12",))))
    return retrieval.ranked(s, ["doc_id"], F.desc("score"), F.col("i")).where("rank <= 3").select("doc_id", F.col("i").cast("bigint").alias("i"), "score", F.col("rank").cast("bigint").alias("rank"))


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register(
    rf"""WITH l AS (SELECT doc_id, i, trim(regexp_replace(line, '[ \t]+', ' ', 'g'), {_TRIM}) AS x FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
    k AS (SELECT * FROM l WHERE x = '' OR NOT regexp_matches(x, '^[^\p{{L}}\p{{N}}]{{1,10}}$')),
    m AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM k),
    t AS (SELECT doc_id, trim(regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (x = '' OR p IS NULL OR x <> p), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), {_TRIM}) AS t FROM m GROUP BY 1)
    SELECT d.doc_id, md5(coalesce(t, '')) AS cleaned, length(coalesce(t, ''))::BIGINT AS chars FROM documents d LEFT JOIN t USING (doc_id)"""
)
def clean_text_lines(spark, d):
    c = table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("t"))
    return c.select("doc_id", F.md5(F.col("t").cast("binary")).alias("cleaned"), F.length("t").cast("bigint").alias("chars"))


_SIGNALS = f"""g AS (SELECT doc_id, length(text) AS char_count, len({words('text')}) AS word_count, length(text) - length(replace(text, chr(65533), '')) + len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]')) AS bad,
  (doc_id % 7)::DOUBLE / 10 AS image_coverage, (doc_id % 4)::INTEGER AS retries, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 11)::DOUBLE / 10 END AS conf FROM documents),
  h AS (SELECT *, CASE WHEN char_count > 0 THEN bad / char_count ELSE 0::DOUBLE END AS rate, CASE WHEN word_count > 0 THEN char_count / word_count ELSE 0::DOUBLE END AS awl, char_count >= 20 AND word_count >= 5 AS enough FROM g),
  c AS (SELECT *, CASE WHEN char_count = 0 AND image_coverage < 0.02::DOUBLE THEN 'empty' WHEN enough AND rate > 0.02::DOUBLE THEN 'corrupted' WHEN enough AND awl > 0 AND awl < 1.5::DOUBLE THEN 'corrupted'
    WHEN NOT enough AND (image_coverage >= 0.02::DOUBLE OR char_count > 0) THEN 'scanned' WHEN NOT enough THEN 'empty' WHEN image_coverage >= 0.35::DOUBLE THEN 'mixed' ELSE 'native' END AS classification FROM h)"""


def _pages(spark, d):
    rows = parsing.signals(table(spark, d, "documents").select("doc_id", "text"))
    rows = rows.withColumns({"image_coverage": (F.col("doc_id") % 7).cast("double") / 10, "retries": (F.col("doc_id") % 4).cast("int"), "conf": F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 11).cast("double") / 10)})
    return rows.withColumn("classification", parsing.page_class())


@register(f"WITH {_SIGNALS} SELECT doc_id, char_count::BIGINT AS char_count, word_count::BIGINT AS word_count, round(rate, 6) AS rate, round(awl, 6) AS avg_word_length, classification FROM c")
def page_signals_and_class(spark, d):
    p = _pages(spark, d)
    return p.select("doc_id", "char_count", "word_count", F.round("suspicious_char_rate", 6).alias("rate"), F.round("avg_word_length", 6).alias("avg_word_length"), "classification")


@register(
    f"""WITH {_SIGNALS}, n AS (SELECT *, greatest(0::DOUBLE, 0.95::DOUBLE - least(1::DOUBLE, 4 * rate)) AS nat, least(1::DOUBLE, greatest(0::DOUBLE, conf)) AS cf FROM c),
    s AS (SELECT *, CASE WHEN classification = 'empty' THEN 1::DOUBLE ELSE least(1::DOUBLE, greatest(0::DOUBLE, CASE WHEN classification = 'corrupted' THEN greatest(0::DOUBLE, 1 - least(1::DOUBLE, 4 * rate))
      WHEN classification = 'scanned' AND conf IS NOT NULL THEN cf WHEN classification = 'scanned' THEN 0.9::DOUBLE * least(1::DOUBLE, word_count / 40) WHEN classification = 'mixed' AND conf IS NOT NULL THEN (nat + cf) / 2 ELSE nat END
      - least(0.15::DOUBLE, 0.05::DOUBLE * retries))) END AS score FROM n),
    t AS (SELECT *, CASE WHEN classification = 'empty' OR score >= 0.75::DOUBLE THEN 'accepted' WHEN retries < 2 AND score < 0.5::DOUBLE THEN 'needs_retry' WHEN score >= 0.3::DOUBLE THEN 'needs_review' ELSE 'failed' END AS status FROM s)
    SELECT doc_id, classification, round(score, 6) AS quality_score, status, status IN ('failed', 'needs_review') AS excluded FROM t"""
)
def quality_score_gate(spark, d):
    p = _pages(spark, d).withColumn("score", parsing.quality_score(F.col("classification"), F.col("conf"), F.col("retries")))
    p = p.withColumn("status", parsing.quality_gate(F.col("classification"), F.col("score"), F.col("retries")))
    return p.select("doc_id", "classification", F.round("score", 6).alias("quality_score"), "status", parsing.excluded(F.col("status")).alias("excluded"))


@register(
    f"""WITH RECURSIVE w AS (SELECT doc_id, {words('text')} AS w FROM documents),
    f AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS chunk FROM w UNION ALL
      SELECT doc_id, i + 1, CASE WHEN n + length(w[i + 1]) + 1 > 800 THEN 0 ELSE n END + length(w[i + 1]) + 1, chunk + CASE WHEN n + length(w[i + 1]) + 1 > 800 THEN 1 ELSE 0 END FROM f JOIN w USING (doc_id) WHERE i < len(w))
    SELECT doc_id, chunk, string_agg(w[i], ' ' ORDER BY i) AS body FROM f JOIN w USING (doc_id) WHERE i > 0 GROUP BY doc_id, chunk"""
)
def fixed_size_chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"))).alias("chunk", "body"))
    return c.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), "body")


@register("WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id AS chat_id, turn AS id, role, text AS content FROM m WHERE r <= 6")
def recent_messages(spark, d):
    from ..operators.scope import recent
    from ..sources.tables import messages

    return recent(messages(spark, d), 6)


@register("SELECT conv_id AS chat_id, role, count(*) AS n, max(turn) AS last_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id, role")
def message_roles_by_chat(spark, d):
    from ..sources.tables import messages

    return messages(spark, d).groupBy("chat_id", "role").agg(F.count("*").alias("n"), F.max("id").alias("last_id"), F.sum(F.length("content")).alias("chars"))

"""Queries over draft answers: claims, their features, verdicts, repair, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import fixed
from ..functions import text as T
from ..operators import grounding, retrieval
from ..sources.tables import chunks, table
from .common import CHUNKS, any_in, quoted, re2, registry, sentences, significant

REGISTRY, register = registry()

DRAFTS = (
    "The system uses FastAPI, Qdrant, PostgreSQL, and Redis [p. 3].\n\nI couldn't find more.", "In total 50 pupils passed [p. 4]. Exactly 100 users joined [p. 4].", "Recall was 92% [p. 5]. Precision was 92% [p. 5].",
    "The service is not encrypted [p. 6]. It is encrypted [p. 6].", "See [P. 3] and [p. 10-12] and [p. 99].\n- a point. Another one!\n\n\n\nNode runs here because of that.", "It costs $1,200.50 or 3.5 usd. v1.2.3 was out in 1999; 42 is more than 41.",
    "Overall, this is defined as x = y. It always works? Never mind the table.", "لا يوجد شيء. نعم!", "", "ok. a? The end is near.",
)
EVIDENCE = (
    (3, "The system uses FastAPI for its interface and PostgreSQL for storage. Redis is the cache."), (4, "20 boys and 30 girls passed the pupils' test. Approximately 100 users joined the service."),
    (5, "Precision was 92% on the held-out set."), (6, "The service is encrypted. Bananas are not blue."), (7, "Node runs here. 42 is more than 41."),
)
_D = ", ".join(f"('d{i}', {quoted(x)})" for i, x in enumerate(DRAFTS))
_A = f"a AS (SELECT 'c' || conv_id || '-' || turn AS answer_id, text AS draft FROM conversations WHERE role = 'assistant' UNION ALL SELECT * FROM (VALUES {_D}) t(answer_id, draft))"
_MARK = r"\[[pP]\.\s*([^\]]+)\]"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CLAIMS = f"""ln AS (SELECT answer_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_index FROM (SELECT answer_id, string_split(draft, chr(10)) AS p FROM a)),
  st AS (SELECT answer_id, line_index, {sentences(f"regexp_replace(trim(line, {_WS}), '{chr(92)}[([pP]){chr(92)}.({chr(92)}s*[^{chr(92)}]]+){chr(92)}]', '[{chr(92)}1' || chr(1) || '{chr(92)}2]', 'g')", fixed.SENTENCE_END)} AS s FROM ln),
  cl0 AS (SELECT answer_id, line_index, unnest(s) AS m, generate_subscripts(s, 1) - 1 AS claim_index FROM st),
  cl1 AS (SELECT answer_id, line_index, claim_index, replace(m, chr(1), '.') AS text FROM cl0),
  claims AS (SELECT *, trim(regexp_replace(text, '{_MARK}', '', 'g'), {_WS}) AS bare, list_transform(regexp_extract_all(text, '{_MARK}', 1), lambda x: trim(x)) AS cited FROM cl1 WHERE length(text) >= 3 AND trim(regexp_replace(text, '{_MARK}', '', 'g'), {_WS}) <> '')"""


def drafts(spark, d):
    turns = table(spark, d, "conversations").where("role = 'assistant'").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("answer_id"), F.col("text").alias("draft"))
    return turns.union(fixed_drafts(spark))


def fixed_drafts(spark):
    return spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(DRAFTS)], "answer_id string, draft string")


def fixed_context(spark):
    own = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(str(p)).alias("label"), F.lit(p).alias("page"), F.lit(1000 + p).cast("long").alias("id"), F.lit(x).alias("text")) for i, (p, x) in enumerate(EVIDENCE)))
    return fixed_drafts(spark).select("answer_id", F.explode(own).alias("e")).select("answer_id", "e.*")


_NUMBERS = (fixed.PERCENT, fixed.MONEY, fixed.PLAIN_NUMBER, fixed.DECIMAL)
_KIND = (
    "CASE WHEN " + " OR ".join(f"regexp_matches(bare, {re2(p)})" for p in _NUMBERS) + " THEN 'numerical' "
    + " ".join(f"WHEN {any_in('bare' if n == 'formula' else 'lower(bare)', c)}" + (r" OR regexp_matches(lower(bare), '\b[\p{L}\p{N}_]+er\s+than\b')" if p else "") + f" THEN '{n}'" for n, c, p in fixed.KINDS)
    + " ELSE 'factual' END"
)


@register(f"WITH {_A}, {_CLAIMS} SELECT answer_id, line_index::BIGINT AS line_index, claim_index::BIGINT AS claim_index, text, bare, array_to_string(cited, '|') AS cited FROM claims")
def claim_extraction(spark, d):
    c = grounding.extract(drafts(spark, d))
    return c.select("answer_id", F.col("line_index").cast("bigint").alias("line_index"), F.col("claim_index").cast("bigint").alias("claim_index"), "text", "bare", F.array_join("cited", "|").alias("cited"))


@register(f"WITH {_A}, {_CLAIMS} SELECT answer_id, line_index::BIGINT AS line_index, claim_index::BIGINT AS claim_index, CASE WHEN regexp_matches(bare, {re2(fixed.CONVERSATIONAL)}) THEN 'conversational' ELSE {_KIND} END AS kind, regexp_matches(bare, {re2(fixed.MAJOR_CLAIM)}) AS major FROM claims")
def claim_kind(spark, d):
    c = grounding.extract(drafts(spark, d))
    return c.select("answer_id", F.col("line_index").cast("bigint").alias("line_index"), F.col("claim_index").cast("bigint").alias("claim_index"), "kind", C.is_major(F.col("bare")).alias("major"))


_RE_MARKS = re2(fixed.PAGE_MARKS.replace("٠-٩", r"\x{0660}-\x{0669}"))
_RE_MARK = re2(fixed.PAGE_MARK.replace("٠-٩", r"\x{0660}-\x{0669}"))


@register(
    f"""WITH {_A} SELECT answer_id, array_to_string(list_transform(regexp_extract_all(draft, {_RE_MARKS}), lambda r: array_to_string(regexp_extract_all(r, {_RE_MARK}, 1), ' , ')), '|') AS marks,
    trim(regexp_replace(draft, {re2(fixed.SHOWN_MARK)}, '', 'g'), {_WS}) AS plain, regexp_matches(draft, '[\\x{{0600}}-\\x{{06FF}}]') AS arabic FROM a"""
)
def page_references(spark, d):
    """Marks as the client shows them, and the text as it is copied."""
    x = F.col("draft")
    return drafts(spark, d).select("answer_id", F.array_join(T.page_marks(x), "|").alias("marks"), T.without_marks(x).alias("plain"), T.has_arabic(x).alias("arabic"))


def _nums(column: str) -> str:
    rules = (fixed.PERCENT, fixed.MONEY, fixed.VERSION, fixed.DECIMAL, fixed.CLAIM_YEAR, fixed.PLAIN_NUMBER)
    return "flatten([" + ", ".join(f"regexp_extract_all({column}, {re2(r)})" for r in rules) + "])"


@register(
    f"""WITH n AS (SELECT doc_id, {_nums('text')} AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM n),
    k AS (SELECT doc_id, regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_.%]', '', 'g') AS k, arg_min(x, i) AS x, min(i) AS i FROM u GROUP BY doc_id, k)
    SELECT n.doc_id, coalesce(string_agg(x, '|' ORDER BY k.i), '') AS numbers FROM n LEFT JOIN k USING (doc_id) GROUP BY n.doc_id"""
)
def numeric_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(C.numeric_tokens(F.col("text")), "|").alias("numbers"))


@register(
    f"""WITH {CHUNKS}, b AS (SELECT item_id, {significant('text')} AS s FROM benchmark), c AS (SELECT id, chat_id, {significant('text')} AS s FROM chunks),
    o AS (SELECT item_id, id, CASE WHEN len(b.s) = 0 THEN 0::DOUBLE ELSE len(list_intersect(b.s, c.s)) / len(b.s) END AS o FROM b JOIN c ON c.chat_id = item_id % 20)
    SELECT item_id, id, round(o, 6) AS overlap FROM o WHERE o >= 0.12::DOUBLE"""
)
def lexical_overlap(spark, d):
    b = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 20).alias("chat_id"), T.significant(F.col("text")).alias("own"))
    shares = retrieval.token_overlap(b, ["item_id"], chunks(spark, d))
    return shares.where("overlap >= 0.12").select("item_id", "id", F.round("overlap", 6).alias("overlap"))


_NEG = "(" + " OR ".join(f"contains(' ' || lower(x) || ' ', {quoted(w if any('؀' <= c <= 'ۿ' for c in w) else f' {w} ')}) OR starts_with(trim(lower(x), {_WS}), {quoted(w)})" for w in fixed.NEGATIONS) + ")"


@register(
    f"""WITH s AS (SELECT doc_id, {sentences('text', fixed.SENTENCE_END)} AS s FROM documents), p AS (SELECT doc_id, s[1] AS claim, CASE WHEN len(s) <= 1 THEN s ELSE list_filter(s, lambda y: list_has_any({significant('y')}, {significant('s[1]')})) END AS near, s AS every FROM s WHERE len(s) > 0),
    e AS (SELECT doc_id, claim, array_to_string(CASE WHEN len(near) = 0 THEN every ELSE near END, ' ') AS ev FROM p)
    SELECT doc_id, (SELECT {_NEG} FROM (SELECT claim AS x)) AS claim_negated, (SELECT {_NEG} FROM (SELECT ev AS x)) AS evidence_negated FROM e"""
)
def negation_scope(spark, d):
    """The first sentence of each document as a claim against the sentences that share a word with it."""
    s = table(spark, d, "documents").select("doc_id", "text", F.get(T.sentences(F.col("text"), fixed.SENTENCE_END), F.lit(0)).alias("claim")).where("claim IS NOT NULL")
    return s.select("doc_id", C.has_negation(F.col("claim")).alias("claim_negated"), C.has_negation(C.relevant(F.col("claim"), F.col("text"))).alias("evidence_negated"))


@register(
    f"""WITH {_A}, l AS (SELECT answer_id, list_transform(regexp_extract_all(draft, '{_MARK}', 1), lambda x: trim(x)) AS c FROM a)
    SELECT answer_id, array_to_string(list_filter(c, lambda x: list_contains(['3', '4', '5', '6', '7'], lower(x))), '|') AS valid, array_to_string(list_filter(c, lambda x: NOT list_contains(['3', '4', '5', '6', '7'], lower(x))), '|') AS invalid,
    CASE WHEN len(c) > 0 THEN 0.5::DOUBLE * len(list_filter(c, lambda x: NOT list_contains(['3', '4', '5', '6', '7'], lower(x)))) / len(c) ELSE 0::DOUBLE END AS penalty FROM l"""
)
def citation_validation(spark, d):
    a = drafts(spark, d)
    labels = a.select("answer_id", F.explode(T.literals([str(p) for p, _ in EVIDENCE])).alias("label"))
    v = grounding.validate_citations(a, labels)
    return v.select("answer_id", F.array_join("valid", "|").alias("valid"), F.array_join("invalid", "|").alias("invalid"), "penalty")


_CITED = "regexp_replace(text, '([.!?]?)\\s*$', CASE WHEN item_id % 2 = 0 THEN ' [p. ' || (1 + (item_id // 2) % 3) || ']' ELSE '' END || '\\1')"


def _benchmark(spark, d):
    """Benchmark items as drafts, every other one ending in a mark for page 1, 2 or 3; their context is the first four chunks of
    a chat, which are pages 1 and 2, so marks for page 3 are invalid."""
    mark = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" [p. "), (1 + F.floor(F.col("item_id") / 2) % 3).cast("string"), F.lit("]"))).otherwise("")
    draft = F.concat(F.regexp_replace("text", r"([.!?]?)\s*$", ""), mark, F.regexp_extract("text", r"([.!?]?)\s*$", 1))
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("answer_id"), (F.col("item_id") % 20).alias("chat_id"), draft.alias("draft"), F.lit(0.8).alias("retrieval_score"))
    c = chunks(spark, d).where("ord < 4").select("chat_id", F.col("ord").alias("pos"), F.col("page").cast("string").alias("label"), "page", "id", "text")
    return a, a.select("answer_id", "chat_id").join(c, "chat_id").drop("chat_id")


_BENCH = f"a AS (SELECT item_id AS answer_id, {_CITED} AS draft FROM benchmark), " + _CLAIMS


@register(
    f"""WITH {CHUNKS}, {_BENCH}, w AS (SELECT *, answer_id % 20 AS chat_id, {significant('bare')} AS sw FROM claims),
    o AS (SELECT answer_id, line_index, claim_index, k.id, k.ord, len(list_intersect(sw, sk)) / len(sw) AS o FROM w JOIN (SELECT id, ord, chat_id, {significant('text')} AS sk FROM chunks WHERE ord >= 4) k USING (chat_id) WHERE len(sw) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY answer_id, line_index, claim_index ORDER BY o DESC, ord) AS rank FROM o WHERE o >= 0.12::DOUBLE) SELECT answer_id, claim_index::BIGINT AS claim_index, id, round(o, 6) AS overlap, rank FROM r WHERE rank <= 3"""
)
def secondary_evidence(spark, d):
    a, ctx = _benchmark(spark, d)
    ids = ctx.groupBy("answer_id").agg(F.collect_list(F.struct("id")).alias("evidence"))  # four of each
    top = grounding.other_evidence(grounding.extract(a).join(ids, "answer_id"), a, chunks(spark, d))
    return top.select("answer_id", F.col("claim_index").cast("bigint").alias("claim_index"), "id", F.round("overlap", 6).alias("overlap"), F.col("rank").cast("bigint").alias("rank"))


_FEATURES = f"""ctx AS (SELECT chat_id, ord, page::VARCHAR AS label, text FROM chunks WHERE ord < 4),
    cv AS (SELECT *, list_filter(cited, lambda x: list_contains(['1', '2'], lower(x))) AS valid FROM claims),
    f AS (SELECT c.*, len(cited) > 0 AND len(valid) = 0 AS wrong, len(valid) > 0 AS has, {_KIND} AS kind, {_nums('bare')} AS nums,
      CASE WHEN len(cited) > 0 AND len(valid) = 0 THEN '' ELSE (SELECT string_agg(text, chr(10) ORDER BY ord) FROM ctx WHERE ctx.chat_id = c.answer_id % 20 AND (len(c.valid) = 0 OR list_contains(c.valid, label))) END AS ev FROM cv c),
    g AS (SELECT *, {significant('bare')} AS sb, {sentences('ev', fixed.SENTENCE_END)} AS es FROM f),
    h AS (SELECT *, CASE WHEN len(sb) = 0 THEN 0::DOUBLE ELSE len(list_intersect(sb, {significant('ev')})) / len(sb) END AS ov, list_filter(es, lambda y: list_has_any({significant('y')}, sb)) AS near,
      list_filter(nums, lambda x: NOT contains(regexp_replace(lower(ev), '[,\\s]', '', 'g'), regexp_replace(lower(x), '[,\\s]', '', 'g'))) AS missing, kind IN ('causal', 'comparison', 'conclusion') OR regexp_matches(bare, {re2(fixed.MAJOR_CLAIM)}) AS risky FROM g),
    i AS (SELECT *, (SELECT {_NEG} FROM (SELECT bare AS x)) OR (SELECT {_NEG} FROM (SELECT CASE WHEN len(sb) = 0 OR len(es) <= 1 OR len(near) = 0 THEN ev ELSE array_to_string(near, ' ') END AS x)) AS negated,
      CASE WHEN has THEN greatest(ov, 0.6::DOUBLE) ELSE ov END AS trusted, len(list_filter(string_split_regex(bare, '\\s+'), lambda x: x <> '')) AS n_words FROM h),
    v AS (SELECT *, CASE WHEN wrong THEN 'cited page is not part of the supplied evidence' WHEN len(missing) > 0 THEN 'figure not present in evidence'
      WHEN len(nums) > 0 THEN CASE WHEN (has OR ov >= 0.5::DOUBLE) AND NOT negated THEN 'figure matches evidence exactly (Stage 1)' WHEN negated THEN 'negation cue present; cannot verify polarity without semantic check' ELSE 'figure present but low overall overlap (Stage 2 unavailable)' END
      WHEN NOT negated AND NOT risky AND (has AND ov >= 0.5::DOUBLE OR ov >= 0.6::DOUBLE) THEN 'high lexical overlap with cited evidence (Stage 1)' WHEN negated THEN 'negation cue present; cannot verify polarity without semantic check'
      WHEN risky AND ov < 0.6::DOUBLE THEN '''' || kind || ''' claims require semantic verification to accept' WHEN has OR ov >= 0.12::DOUBLE OR n_words <= 4 THEN 'lexical overlap heuristic (Stage 2 unavailable)'
      WHEN ov >= 0.05::DOUBLE THEN 'partial lexical overlap heuristic (Stage 2 unavailable)' ELSE 'no lexical overlap with evidence' END AS reason FROM i),
    verdicts AS (SELECT *, CASE WHEN reason IN ('cited page is not part of the supplied evidence', 'figure not present in evidence', 'no lexical overlap with evidence') THEN 'UNSUPPORTED' WHEN starts_with(reason, 'negation') OR ends_with(reason, 'to accept') THEN 'UNCERTAIN'
      WHEN starts_with(reason, 'partial') OR starts_with(reason, 'figure present') THEN 'PARTIALLY_SUPPORTED' ELSE 'SUPPORTED' END AS status,
      CASE WHEN wrong OR len(missing) > 0 OR starts_with(reason, 'negation') THEN 0::DOUBLE WHEN starts_with(reason, 'figure matches') THEN greatest(ov, 0.6::DOUBLE) WHEN starts_with(reason, 'high') OR starts_with(reason, 'lexical') THEN trusted ELSE ov END AS score FROM v)"""


def _verdicts(spark, d):
    a, ctx = _benchmark(spark, d)
    return a, ctx, grounding.verify(grounding.extract(a), ctx)


@register(f"WITH {CHUNKS}, {_BENCH}, {_FEATURES} SELECT answer_id, claim_index::BIGINT AS claim_index, status FROM verdicts")
def claim_status_stage1(spark, d):
    """Cited and uncited claims against their pages, without a verifier."""
    return _verdicts(spark, d)[2].select("answer_id", F.col("claim_index").cast("bigint").alias("claim_index"), "status")


@register(f"WITH {CHUNKS}, {_BENCH}, {_FEATURES} SELECT answer_id, line_index::BIGINT AS line_index, claim_index::BIGINT AS claim_index, kind, status, round(score, 6) AS score, reason, NULL::VARCHAR AS repaired FROM verdicts")
def claim_verdicts(spark, d):
    """With scores and reasons. The benchmark's items list nothing, so nothing is cut out of a claim; tests have listings."""
    v = _verdicts(spark, d)[2]
    numbers = [F.col(x).cast("bigint").alias(x) for x in ("line_index", "claim_index")]
    return v.select("answer_id", *numbers, "kind", "status", F.round("score", 6).alias("score"), "reason", "repaired")


_REPAIRED = f"""mk AS (SELECT chat_id, ' ' || string_agg('[p. ' || label || ']', '' ORDER BY label) AS marks FROM (SELECT DISTINCT chat_id, label FROM ctx) GROUP BY 1),
    sh AS (SELECT v.*, status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED') AS good, CASE WHEN status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED') THEN CASE WHEN len(cited) > 0 THEN text ELSE text || marks END END AS shown FROM verdicts v JOIN mk ON mk.chat_id = answer_id % 20),
    lj AS (SELECT answer_id, line_index, coalesce(string_agg(shown, ' ' ORDER BY claim_index), '') AS line FROM sh GROUP BY 1, 2),
    bd AS (SELECT l.answer_id, string_agg(coalesce(lj.line, ''), chr(10) ORDER BY l.line_index) FILTER (lj.line <> '' OR lj.line IS NULL AND trim(l.line, {_WS}) = '') AS g FROM ln l LEFT JOIN lj USING (answer_id, line_index) GROUP BY 1),
    ft AS (SELECT answer_id, count(*) AS facts, count(*) FILTER (good) AS good FROM sh GROUP BY 1),
    repaired AS (SELECT a.answer_id, CASE WHEN coalesce(facts, 0) > 0 AND ft.good = 0 OR coalesce(g, '') = '' THEN CASE WHEN regexp_matches(draft, '[؀-ۿ]') THEN {quoted(fixed.NOT_FOUND_AR)} ELSE {quoted(fixed.NOT_FOUND_EN)} END
      ELSE regexp_replace(trim(g, {_WS}), '\\n{{3,}}', chr(10) || chr(10), 'g') END AS grounded_answer FROM a LEFT JOIN bd USING (answer_id) LEFT JOIN ft USING (answer_id))"""


@register(f"WITH {CHUNKS}, {_BENCH}, {_FEATURES}, {_REPAIRED} SELECT answer_id, grounded_answer FROM repaired")
def answer_repair(spark, d):
    """Drafts put together again from what was accepted of them, with page marks, or the message that nothing was found."""
    a, _, v = _verdicts(spark, d)
    return grounding.repair(a, v)


@register(
    f"""WITH {CHUNKS}, {_BENCH}, {_FEATURES}, {_REPAIRED}, sc AS (SELECT *, CASE WHEN regexp_matches(text, {re2(fixed.MAJOR_CLAIM)}) THEN 2::DOUBLE ELSE 1::DOUBLE END AS w, CASE status WHEN 'SUPPORTED' THEN 1::DOUBLE WHEN 'PARTIALLY_SUPPORTED' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS s FROM sh),
    sg AS (SELECT answer_id, sum(w * s) / sum(w) AS cov, avg(CASE WHEN len(cited) = 0 OR len(valid) > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) FILTER (good) AS cit FROM sc GROUP BY 1),
    sf AS (SELECT a.answer_id, 0.8::DOUBLE AS r, coalesce(cov, 1) AS cov, coalesce(cit, 1) AS cit FROM a LEFT JOIN sg USING (answer_id))
    SELECT answer_id, r AS retrieval_score, round_even(cov, 4) AS evidence_coverage, round_even(cit, 4) AS citation_score, round_even(0.5::DOUBLE * cov + 0.25::DOUBLE * cit + 0.25::DOUBLE * r, 4) AS grounding_score FROM sf"""
)
def grounding_scores(spark, d):
    a, ctx, v = _verdicts(spark, d)
    return grounding.scores(a, v, grounding.repair(a, v), ctx)


def scenario_verdicts(spark):
    """The scenario drafts, with listings, sums, hedges, metrics and negations."""
    return grounding.verify(grounding.extract(fixed_drafts(spark)), fixed_context(spark))

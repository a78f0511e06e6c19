"""Retrieval: BM25, cosine, metadata filters, rank fusion, reranking, neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions import fixed, text


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def tied(score: str) -> Column:
    """Descending; scores that differ by the order of a sum only are ties, which the place in the document decides."""
    return F.desc(F.round(score, 9))


def doc_terms(chunks: DataFrame) -> DataFrame:
    """(chat_id, id, ord, len, toks): tokens of each chunk and their number."""
    return chunks.select("chat_id", "id", "ord", text.tokens(F.col("text")).alias("toks")).withColumn("len", F.size("toks"))


def postings(chunks: DataFrame) -> DataFrame:
    """(chat_id, id, term, tf, len)."""
    return doc_terms(chunks).select("chat_id", "id", "len", F.explode("toks").alias("term")).groupBy("chat_id", "id", "term", "len").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return doc_terms(chunks).groupBy("chat_id").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def idf(df: Column, n: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1.0), F.lit(1e-9))


def term_stats(chunks: DataFrame) -> DataFrame:
    """(chat_id, term, df, idf) of all terms."""
    # A chunk counts once for each of its terms: one aggregate, with partial counts before the shuffle.
    df = doc_terms(chunks).select("chat_id", F.explode(F.array_distinct("toks")).alias("term")).groupBy("chat_id", "term").agg(F.count("*").alias("df"))
    n = chunks.groupBy("chat_id").agg(F.count("*").alias("n"))
    return df.join(n, "chat_id").select("chat_id", "term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def token_overlap(wanted: DataFrame, keys: list[str], chunks: DataFrame) -> DataFrame:
    """wanted (keys, chat_id, own: distinct tokens) against the chunks of its chat: (keys, chat_id, id, ord, overlap), the share of
    own that a chunk has, for chunks that have any. Only tokens that are asked for meet in the join, never whole texts."""
    terms = wanted.select(*keys, "chat_id", F.size("own").alias("__of"), F.explode("own").alias("term"))
    held = chunks.select("chat_id", "id", "ord", F.explode(text.significant(F.col("text"))).alias("term"))
    held = held.join(terms.select("chat_id", "term").distinct(), ["chat_id", "term"], "left_semi")
    shared = terms.join(held, ["chat_id", "term"]).groupBy(*keys, "chat_id", "__of", "id", "ord").agg(F.count("*").alias("__n"))
    return shared.select(*keys, "chat_id", "id", "ord", (F.col("__n") / F.col("__of")).alias("overlap"))


def keyword_index(chunks: DataFrame, path: str) -> DataFrame:
    """Writes the chunks' postings (chat_id, id, ord, term, tf, len), a chat in its own folder, and reads them back: what
    bm25() takes instead of chunks, so that no question tokenises the corpus again. A chunk without a token has one row, its
    term null. Chats in chunks are replaced, others stay, as they do when a document is uploaded again."""
    toks = doc_terms(chunks).select("chat_id", "id", "ord", "len", F.explode_outer("toks").alias("term"))
    rows = toks.groupBy("chat_id", "id", "ord", "len", "term").agg(F.count("*").alias("tf"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chat_id").parquet(path)
    return chunks.sparkSession.read.schema(rows.schema).parquet(path)


def bm25(questions: DataFrame, chunks: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(question_id, id, ord, bm25) of all chunks of a question's chat with a positive score.

    questions: question_id, chat_id, search_text; chunks, or a keyword_index of them. A term that a question repeats counts as
    often. Only the questions' terms are ever counted: the exploded tokens meet them before anything is shuffled on a chunk's
    key.
    """
    terms = questions.select("question_id", "chat_id", F.explode(text.tokens(F.col("search_text"))).alias("term")).groupBy("question_id", "chat_id", "term").agg(F.count("*").alias("times"))
    wanted = terms.select("chat_id", "term").distinct()
    if "tf" in chunks.columns:
        hits = chunks.select("chat_id", "term", "id", "ord", "len", "tf").join(wanted, ["chat_id", "term"], "left_semi")
        stats = chunks.groupBy("chat_id", "id", "len").agg(F.count("*").alias("terms")).groupBy("chat_id").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    else:
        docs = doc_terms(chunks)
        hits = docs.select("chat_id", "id", "ord", "len", F.explode("toks").alias("term")).join(wanted, ["chat_id", "term"], "left_semi")
        hits = hits.groupBy("chat_id", "term", "id", "ord", "len").agg(F.count("*").alias("tf"))
        stats = chunks.select("chat_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(fixed.TOKEN)).alias("len")).groupBy("chat_id").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    df = hits.groupBy("chat_id", "term").agg(F.count("*").alias("df"))
    weights = terms.join(df, ["chat_id", "term"]).join(stats, "chat_id").withColumn("w", F.col("times") * idf(F.col("df"), F.col("n")))
    k1, b = cfg.bm25_k1, cfg.bm25_b
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return hits.join(weights.select("chat_id", "term", "question_id", "w", "avgdl"), ["chat_id", "term"]).groupBy("question_id", "id", "ord").agg(F.sum(part).alias("bm25")).where("bm25 > 0")


def keyword_search(questions: DataFrame, chunks: DataFrame, k: Column | int = 8, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """The k best by BM25, their score as a share of the best one's: (question_id, id, ord, keyword_score, rank)."""
    found = ranked(bm25(questions, chunks, cfg), ["question_id"], tied("bm25"), F.col("ord"))
    if isinstance(k, Column):
        found = found.join(questions.select("question_id", k.alias("__k")), "question_id").where("rank <= __k").drop("__k")
    else:
        found = found.where(F.col("rank") <= k)
    return found.select("question_id", "id", "ord", (F.col("bm25") / F.max("bm25").over(W.partitionBy("question_id"))).alias("keyword_score"), "rank")


def semantic_search(questions: DataFrame, chunks: DataFrame, k: Column | int = 8, threshold: float = 0.0) -> DataFrame:
    """The k nearest by cosine, then those under the threshold dropped: (question_id, id, ord, semantic_score, rank).

    questions: question_id, chat_id, vector; chunks without a vector are left out. Exact: filter, then limit. A pair's score
    is one number, so the rank needs no text or vector in its shuffle.
    """
    q = questions.select("question_id", F.col("chat_id").alias("__chat"), "vector", (k if isinstance(k, Column) else F.lit(k)).alias("__k"))
    pool = chunks.where("embedding IS NOT NULL").select("chat_id", "id", "ord", "embedding")
    pairs = pool.join(q.where("vector IS NOT NULL"), F.col("chat_id") == F.col("__chat")).select("question_id", "id", "ord", "__k", text.cosine(F.col("embedding"), F.col("vector")).alias("semantic_score"))
    return ranked(pairs, ["question_id"], tied("semantic_score"), F.col("ord")).where((F.col("rank") <= F.col("__k")) & (F.col("semantic_score") >= threshold)).drop("__k")


def contains(haystack: Column, needle: Column) -> Column:
    """Literal part, whatever the case; an empty needle is in all, nothing is in null."""
    n = F.lower(text.strip(F.coalesce(needle, F.lit(""))))
    return F.when(n == "", F.lit(True)).otherwise(F.coalesce(F.contains(F.lower(text.strip(haystack)), n), F.lit(False)))


def metadata_filter(document_id: Column | None = None, chapter: Column | None = None, section: Column | None = None, page: Column | None = None) -> Column:
    """All of the given hints; one that is null doesn't filter, nor does page 0."""
    out = F.lit(True)
    if document_id is not None:
        out = out & (document_id.isNull() | (F.col("document_id") == document_id))
    if chapter is not None:
        out = out & (chapter.isNull() | contains(F.col("chapter"), chapter))
    if section is not None:
        out = out & (section.isNull() | contains(F.col("section"), section))
    if page is not None:
        out = out & (page.isNull() | (page == 0) | (F.col("page") == page))
    return out


def with_fallback(pairs: DataFrame, keep: Column, by: str = "question_id") -> DataFrame:
    """pairs that pass; all of a question's if none does."""
    marked = pairs.withColumn("__keep", F.coalesce(keep, F.lit(False)))
    passed = marked.groupBy(by).agg(F.max("__keep").alias("__any"))
    return marked.join(passed, by).where("__keep OR NOT __any").drop("__keep", "__any")


def fuse(semantic: DataFrame, keyword: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Both ranked lists as one: (question_id, id, semantic_score, keyword_score, rrf). What one list lacks scores 0 there."""
    one = 1.0 / (cfg.rrf_k + F.col("rank"))
    none = F.lit(0.0)
    rows = semantic.select("question_id", "id", "ord", "semantic_score", none.alias("keyword_score"), one.alias("rrf")).unionByName(
        keyword.select("question_id", "id", "ord", none.alias("semantic_score"), "keyword_score", one.alias("rrf"))
    )
    return rows.groupBy("question_id", "id", "ord").agg(F.sum("semantic_score").alias("semantic_score"), F.max("keyword_score").alias("keyword_score"), F.sum("rrf").alias("rrf"))


def local_rerank(low: Column | None = None) -> Column:
    """How well a candidate's text, page and headings answer what its question names; columns as understand() gives them."""
    body, low = F.col("text"), F.lower("text")

    def share(hits: Column, of: Column) -> Column:
        return F.when(F.size(of) > 0, F.least(F.size(hits) / F.size(of), F.lit(1.0))).otherwise(0.0)

    hit = F.size(F.filter("numbers", lambda n: F.contains(body, n)))
    score = F.when(F.size("numbers") > 0, fixed.NUMBER_WEIGHT * F.least(hit / F.size("numbers"), F.lit(1.0))).otherwise(0.0)
    score = score + fixed.KEYWORD_WEIGHT * share(F.filter("keywords", lambda w: F.contains(low, w)), F.col("keywords"))
    score = score + F.when(F.array_contains("page_references", F.col("page")), fixed.PAGE_WEIGHT).otherwise(0.0)
    heading = F.coalesce(F.contains(F.lower("chapter"), F.lower("chapter_hint")), F.lit(False)) | F.coalesce(F.contains(F.lower("section"), F.lower("section_hint")), F.lit(False))
    return F.least(score + F.when(heading, fixed.HEADING_WEIGHT).otherwise(0.0), F.lit(1.0))


def plain_rerank(question: Column) -> Column:
    """Without an analysis: the share of the question's words of over two characters that the text has."""
    terms = F.filter(text.words(F.lower(question)), lambda w: F.length(w) > 2)
    low = F.lower("text")
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.least(F.size(F.filter(terms, lambda w: F.contains(low, w))) / F.size(terms), F.lit(1.0)))


def combined(cfg: EngineConfig = DEFAULTS) -> Column:
    return cfg.semantic_weight * F.col("semantic_score") + cfg.keyword_weight * F.col("keyword_score") + cfg.rerank_weight * F.col("rerank_score")


def hybrid_search(questions: DataFrame, chunks: DataFrame, cfg: EngineConfig = DEFAULTS, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(question_id, id, ord, semantic_score, keyword_score, rrf, rerank_score, score, rank): the best of each question.

    questions: question_id, chat_id, search_text, vector, understand()'s columns, and document_hint where a question is put to
    one document of its chat. A null vector leaves the keyword side. The semantic side is filtered by
    metadata first; the keyword side takes its best of the whole chat and then loses what the filter excludes. Text meets
    the candidates only after both sides are cut to their widths. reranker: candidates (with question, text, rrf and
    understand()'s columns) to the same with rerank_score; the local rule without one.
    """
    most = F.floor(F.lit(cfg.rerank_candidate_count) * F.col("candidate_multiplier")).cast("int")
    keep = F.coalesce(metadata_filter(F.col("document_hint"), F.col("chapter_hint"), F.col("section_hint"), F.col("filter_page")), F.lit(False))
    document = F.col("document_hint") if "document_hint" in questions.columns else F.lit(None).cast("string").alias("document_hint")
    hints = questions.select("question_id", F.col("chat_id").alias("__chat"), document, "chapter_hint", "section_hint", "filter_page", most.alias("most"))
    named = hints.where("document_hint IS NOT NULL OR chapter_hint IS NOT NULL OR section_hint IS NOT NULL OR filter_page IS NOT NULL")
    meta = chunks.select("chat_id", "document_id", "chapter", "section", "page")
    # Whether any chunk passes is a bit for each question that has a hint; the pairs themselves are never shuffled for it.
    strict = meta.join(named, F.col("chat_id") == F.col("__chat")).where(keep).select("question_id").distinct().withColumn("__strict", F.lit(True))
    sized = hints.join(strict, "question_id", "left")
    stays = F.col("__strict").isNull() | keep
    q = sized.join(questions.select("question_id", "vector"), "question_id")
    pool = chunks.where("embedding IS NOT NULL").select("chat_id", "id", "ord", "document_id", "chapter", "section", "page", "embedding")
    near = pool.join(q.where("vector IS NOT NULL"), F.col("chat_id") == F.col("__chat")).where(stays).select("question_id", "id", "ord", "most", text.cosine(F.col("embedding"), F.col("vector")).alias("semantic_score"))
    near = ranked(near, ["question_id"], tied("semantic_score"), F.col("ord")).where("rank <= most AND semantic_score >= 0").drop("most")
    words = ranked(bm25(questions.select("question_id", "chat_id", "search_text"), chunks, cfg), ["question_id"], tied("bm25"), F.col("ord"))
    words = words.join(sized, "question_id").where("rank <= most").withColumn("keyword_score", F.col("bm25") / F.max("bm25").over(W.partitionBy("question_id")))
    # The few that are left get their headings and what the filter excludes goes.
    words = words.join(chunks.select("id", "document_id", "chapter", "section", "page"), "id").where(stays).select("question_id", "id", "ord", "keyword_score")
    words = ranked(words, ["question_id"], tied("keyword_score"), F.col("ord"))
    both = fuse(near, words, cfg)
    asked = questions.select("question_id", *(["question"] if "question" in questions.columns else []), "keywords", "numbers", "page_references", "chapter_hint", "section_hint", "depth")
    rows = chunks.select("id", "text", "page", "chapter", "section").join(both, "id").join(asked, "question_id")
    rows = reranker(rows) if reranker else rows.withColumn("rerank_score", local_rerank())
    rows = rows.withColumn("score", combined(cfg))
    k = F.when(F.col("depth") == "explain", cfg.explain_chunks).otherwise(cfg.specific_chunks)
    best = ranked(rows, ["question_id"], tied("score"), tied("rrf"), F.col("ord")).where(F.col("rank") <= k)
    return best.select("question_id", "id", "ord", "semantic_score", "keyword_score", "rrf", "rerank_score", "score", "rank")


def out_of_scope(questions: DataFrame, retrieved: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(question_id, best, is_out_of_scope): nothing kept, or nothing near enough among what was kept."""
    best = retrieved.groupBy("question_id").agg(F.max("semantic_score").alias("best"))
    out = questions.select("question_id").join(best, "question_id", "left")
    return out.withColumn("is_out_of_scope", F.coalesce(F.col("best") < cfg.out_of_scope_similarity, F.lit(True)))


def window_of(depth: Column, cfg: EngineConfig = DEFAULTS) -> Column:
    """How many places around a chunk an answer of this depth reads."""
    return F.when(depth == "explain", cfg.explain_window).otherwise(cfg.specific_window)


def neighbours(selected: DataFrame, chunks: DataFrame, window: Column | int = 1) -> DataFrame:
    """(question_id, chat_id, ord, id) of selected chunks (question_id, chat_id, ord) and of those up to `window` places before
    and after, in the document's order; each once. An equi-join on the place: no range join, no pass over chats not asked."""
    around = selected.select("question_id", "chat_id", F.explode(F.sequence(F.col("ord") - window, F.col("ord") + window)).alias("ord")).distinct()
    return around.join(chunks.select("chat_id", "ord", "id"), ["chat_id", "ord"])

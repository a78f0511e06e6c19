"""Answers beyond the best chunks: summaries of a scope by map and reduce, study guides, outlines, redirections, model intents and rerankers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions import fixed, query
from ..operators import context, retrieval, scope
from . import prompts
from .providers import Llm, complete, json_of, rerank_reply, study_guide

EMPTY = "I couldn't find that section in this document."


def _parts(order: list[str]) -> Column:
    """Excerpts with their headers, in order."""
    text = F.concat(context.excerpt(F.col("page"), F.col("chapter"), F.col("section")), F.lit("\n"), F.col("text"))
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("x")))), lambda r: r["x"])


def _joined(rows: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, column))), lambda r: r[column]).alias("parts"))


def explain_scope(questions: DataFrame, chunks: DataFrame, provider: Llm, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(question_id, draft) for questions (question_id, question, focus, explanation_mode, response_length) with the chunks of
    their scopes (question_id, position, chapter, section, page, paragraph_index, ord, text).

    A scope of up to cfg.single_shot_chars characters is one prompt. A longer one is summed up by runs of a section, ten chunks
    at a time, then cfg.reduce_batch summaries at a time until no more than that are left, and these answer the question. How
    many rounds that takes follows from the counts of batches, the one thing that comes to the driver. A scope without chunks
    has the message that it wasn't found.
    """
    said = prompts.style(F.col("explanation_mode"), F.col("response_length"))
    asked = questions.select("question_id", "question", "focus", said.alias("said"))
    sizes = chunks.groupBy("question_id").agg(F.sum(F.length("text")).alias("chars"))
    small = chunks.join(sizes.where(F.col("chars") <= cfg.single_shot_chars).select("question_id"), "question_id", "left_semi")
    one = small.groupBy("question_id").agg(_parts(["position"]).alias("parts")).join(asked, "question_id")
    one = complete(one, prompts.whole(F.col("question"), F.col("focus"), F.col("parts"), F.col("said")), "draft", provider).select("question_id", "draft")
    large = chunks.join(sizes.where(F.col("chars") > cfg.single_shot_chars).select("question_id"), "question_id", "left_semi")
    batches = scope.summary_batches(large.withColumn("chat_id", F.col("question_id")), cfg)
    counts = batches.select("question_id", "run", "batch").distinct().groupBy("question_id").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    texts = batches.groupBy("question_id", "run", "batch").agg(_parts(["position"]).alias("parts")).join(asked, "question_id")
    now = complete(texts, prompts.batch(F.col("parts"), F.col("said")), "s", provider)
    now = retrieval.ranked(now, ["question_id"], F.col("run"), F.col("batch"), name="n").select("question_id", (F.col("n") - 1).alias("n"), F.coalesce("s", F.lit("")).alias("s"))
    left = counts
    while most > cfg.reduce_batch:
        # Scopes that are small enough already wait for the others.
        done = now.join(left.where(F.col("n") <= cfg.reduce_batch).select("question_id"), "question_id", "left_semi")
        more = now.join(left.where(F.col("n") > cfg.reduce_batch).select("question_id"), "question_id", "left_semi")
        more = _joined(more.withColumn("b", F.floor(F.col("n") / cfg.reduce_batch)), ["question_id", "b"], "n", "s").join(asked, "question_id")
        more = complete(more, prompts.merge(F.col("focus"), F.col("parts"), F.col("said")), "s", provider).select("question_id", F.col("b").cast("int").alias("n"), F.coalesce("s", F.lit("")).alias("s"))
        now = done.unionByName(more)
        left = left.select("question_id", F.when(F.col("n") > cfg.reduce_batch, F.ceil(F.col("n") / cfg.reduce_batch)).otherwise(F.col("n")).alias("n"))
        most = -(-most // cfg.reduce_batch)
    final = _joined(now, ["question_id"], "n", "s").join(asked, "question_id")
    final = complete(final, prompts.merge(F.col("focus"), F.col("parts"), F.col("said"), F.col("question")), "draft", provider).select("question_id", "draft")
    found = one.unionByName(final)
    none = asked.select("question_id").join(sizes.select("question_id"), "question_id", "left_anti").withColumn("draft", F.lit(EMPTY))
    return found.unionByName(none)


def study_guides(questions: DataFrame, chunks: DataFrame, provider: Llm, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(question_id, guide) for questions (question_id, focus) and the chunks of their scopes: lists of at most 15, empty where
    the reply isn't JSON. What is too long for one prompt is condensed first."""
    more = F.concat(F.lit("Cover everything notable in "), F.col("focus"), F.lit(" in detail for a study guide."))
    sizes = chunks.groupBy("question_id").agg(F.sum(F.length("text")).alias("chars"), _parts(["position"]).alias("parts"))
    short = sizes.where(F.col("chars") <= cfg.single_shot_chars).select("question_id", prompts.excerpts(F.col("parts")).alias("material"))
    long_ = sizes.where(F.col("chars") > cfg.single_shot_chars).select("question_id")
    wide = questions.join(long_, "question_id", "left_semi").select("question_id", more.alias("question"), "focus", F.lit("detailed").alias("explanation_mode"), F.lit("long").alias("response_length"))
    condensed = explain_scope(wide, chunks.join(long_, "question_id", "left_semi"), provider, cfg).withColumnRenamed("draft", "material")
    rows = questions.select("question_id", "focus").join(short.unionByName(condensed), "question_id")
    replies = complete(rows, prompts.guide(F.col("focus"), F.col("material")), "reply", provider)
    return replies.select("question_id", study_guide(json_of(F.col("reply"))).alias("guide"))


def highlights(reply: Column, concepts: Column, exam: Column) -> Column:
    """A reply with a guide's grounded key concepts (array, those of eight that were accepted) and up to five exam questions."""
    few = F.slice(F.coalesce(exam, F.array().cast("array<string>")), 1, 5)
    parts = F.array(
        F.when(F.size(concepts) > 0, F.concat(F.lit("**Key concepts:** "), F.array_join(concepts, ", "))),
        F.when(F.size(few) > 0, F.concat(F.lit("**Possible exam questions:**\n"), F.array_join(F.transform(few, lambda q: F.concat(F.lit("- "), q)), "\n"))),
    )
    return F.array_join(F.concat(F.array(reply), F.filter(parts, lambda x: x.isNotNull())), "\n\n")


def wants_outline(question: Column, kind: Column) -> Column:
    """Whether the headings themselves are asked for; not for pages."""
    return question.rlike(fixed.OUTLINE_REQUEST) & (kind != "page_range")


def outlines(chunks: DataFrame) -> DataFrame:
    """(question_id, markdown): the headings of each scope (question_id and a chunk's columns), made without a model."""
    return context.outline_markdown(context.outline(chunks, ["question_id"]), ["question_id"])


def overviews(chunks: DataFrame, provider: Llm) -> DataFrame:
    """(chat_id, overview) of what each chat's document covers, from the heads of some forty chunks."""
    some = scope.overview_sample(chunks).withColumn("text", F.substring("text", 1, 300))
    rows = some.groupBy("chat_id").agg(_parts(["ord"]).alias("parts"))
    return complete(rows, prompts.overview(F.col("parts")), "overview", provider).select("chat_id", "overview")


def redirects(questions: DataFrame, topics: DataFrame, provider: Llm) -> DataFrame:
    """(question_id, reply) for questions (question_id, chat_id, question) that the document doesn't cover."""
    rows = questions.select("question_id", "chat_id", "question").join(topics, "chat_id", "left")
    return complete(rows, prompts.redirect(F.col("question"), F.col("overview")), "reply", provider).select("question_id", "reply")


def model_intents(questions: DataFrame, provider: Llm) -> DataFrame:
    """questions with intent and complexity as the provider tells them; the rules decide where its reply isn't JSON with a known
    value of both."""
    intents = tuple(dict.fromkeys([n for n, _ in fixed.INTENTS] + [fixed.DEFAULT_INTENT]))
    levels = tuple(dict.fromkeys([n for n, _ in fixed.COMPLEXITIES] + [fixed.DEFAULT_COMPLEXITY]))
    rows = complete(questions, prompts.intent(F.col("question"), intents, levels), "__reply", provider)
    said = F.from_json(json_of(F.col("__reply")), "intent string, complexity string")
    ok = said["intent"].isin(*intents) & said["complexity"].isin(*levels)
    q = F.coalesce("question", F.lit(""))
    return rows.withColumns({"intent": F.when(ok, said["intent"]).otherwise(query.intent(q)), "complexity": F.when(ok, said["complexity"]).otherwise(query.complexity(q))}).drop("__reply")


def model_reranker(provider: Llm) -> Callable[[DataFrame], DataFrame]:
    """A reranker that rates a question's candidates in one prompt; the local rule where the reply isn't JSON."""

    def rerank(rows: DataFrame) -> DataFrame:
        placed = retrieval.ranked(rows, ["question_id"], F.desc("rrf"), F.col("ord"), name="__place").withColumn("__place", F.col("__place") - 1)
        asked = placed.groupBy("question_id").agg(F.first("question").alias("question"), F.transform(F.sort_array(F.collect_list(F.struct("__place", "text"))), lambda x: x["text"]).alias("texts"))
        replies = complete(asked, prompts.relevance(F.col("question"), F.col("texts")), "__reply", provider).select("question_id", json_of(F.col("__reply")).alias("__reply"))
        told = F.from_json("__reply", "map<string,double>").isNotNull()
        score = F.when(told, rerank_reply(F.col("__reply"), F.col("__place"))).otherwise(retrieval.local_rerank())
        return placed.join(replies, "question_id", "left").withColumn("rerank_score", score).drop("__reply", "__place")

    return rerank


def cross_encoder(predict: Callable[[list[tuple[str, str]]], list[float]] | None) -> Callable[[DataFrame], DataFrame]:
    """A reranker of a model that scores (question, text) pairs, squashed into 0 to 1. Without a model, or for a batch on which it
    fails, the local rule."""

    def rerank(rows: DataFrame) -> DataFrame:
        if predict is None:
            return rows.withColumn("rerank_score", retrieval.local_rerank())

        @F.pandas_udf("double")
        def logits(questions: pd.Series, texts: pd.Series) -> pd.Series:
            try:
                return pd.Series([float(x) for x in predict(list(zip(questions.fillna(""), texts.fillna(""))))])
            except Exception:  # a model that can't be run leaves the choice to the rule
                return pd.Series([None] * len(texts), dtype="float64")

        raw = rows.withColumn("__logit", logits("question", "text"))
        return raw.withColumn("rerank_score", F.coalesce(sigmoid(F.col("__logit")), retrieval.local_rerank())).drop("__logit")

    return rerank


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))

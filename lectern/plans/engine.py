"""The engine as a whole: ingest layout blocks, ask batches of questions, get grounded answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig
from ..functions import fixed
from ..functions.query import understand
from ..operators import context, grounding, layout, parsing, retrieval, scope
from ..sources.store import ChunkStore
from . import longform, prompts
from .providers import Embedder, HashingEmbedder, Llm, NoLlm, complete, embed, rewritten, verifier_prompt


@dataclass
class Engine:
    spark: SparkSession
    store: ChunkStore
    cfg: EngineConfig = DEFAULTS
    embedder: Embedder = field(default_factory=HashingEmbedder)
    llm: Llm = field(default_factory=NoLlm)
    reranker: Callable[[DataFrame], DataFrame] | None = None

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table beside the chunks: lineage ends here, so a provider is asked once whatever is lost later."""
        path = f"{self.store.path.rstrip('/')}-work/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def ingest(self, blocks: DataFrame, pages: DataFrame, chats: DataFrame, read: Callable[[bytes, int], tuple[str, float | None]] | None = None) -> DataFrame:
        """blocks and page geometry of documents, chats (document_id, chat_id): classified, gated, chunked, embedded, stored;
        returns the rated pages. Scanned and corrupted pages go to `read` if their image is there. Pages that the gate excludes
        are left out of the index, their text stays with the rated pages."""
        good, rated = layout.route_pages(blocks, pages, read, self.cfg)
        rated = self._kept(rated, "pages")
        chunks = parsing.tag_quality(parsing.chunk_blocks(parsing.classify_blocks(good)), rated)
        chunks = embed(chunks.join(chats, "document_id"), "text", "embedding", self.embedder)
        self.store.save_many(chunks.withColumn("id", F.lit(None).cast("bigint")))
        return rated

    def replace(self, chunks: DataFrame) -> None:
        self.store.replace_for_chat(chunks)

    def delete(self, chat_id: int) -> None:
        self.store.delete_for_chat(chat_id)

    def understood(self, questions: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """questions (question_id, chat_id, question) that aren't blank with all that is known of them, and their vectors."""
        asked = questions.where("trim(question) <> ''")
        asked = rewritten(asked, history, self.llm) if history is not None else asked.withColumn("search_text", F.col("question"))
        return embed(understand(asked), "search_text", "vector", self.embedder)

    def search(self, questions: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(questions with all that is known of them, the best chunks of each)."""
        known = self.understood(questions, history)
        return known, retrieval.hybrid_search(known, self.store.all(), self.cfg, self.reranker)

    def _plain(self, plain: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
        """What the model is shown for questions without a scope: (question_id, place, id, page, chapter, section, text)."""
        near = found.join(plain.select("question_id", "chat_id", "depth"), "question_id").select("question_id", "chat_id", "ord", "depth")
        near = retrieval.neighbours(near, chunks, retrieval.window_of(F.col("depth"), self.cfg)).select("question_id", "id")
        score = found.select("question_id", "id", F.col("score").alias("relevance"))
        rows = near.join(chunks, "id").join(score, ["question_id", "id"], "left").join(plain.select("question_id", "keywords", "numbers"), "question_id")
        return context.prepare(rows.withColumn("pos", F.col("ord")), self.cfg).where("kept").select("question_id", "place", "id", "page", "chapter", "section", "text")

    def _grounded(self, answers: DataFrame, evidence: DataFrame, chunks: DataFrame | None) -> DataFrame:
        claims = self._kept(grounding.verify(grounding.extract(answers), evidence, None, self.cfg), "claims")
        if not isinstance(self.llm, NoLlm):
            asked = complete(grounding.open_claims(claims), verifier_prompt(F.col("bare"), F.col("evidence")), "reply", self.llm)
            replies = self._kept(asked.select(*grounding.KEY, "reply"), "replies")
            claims = self._kept(grounding.verify(grounding.extract(answers), evidence, replies, self.cfg), "claims")
        return grounding.report(answers, claims, evidence, chunks, self.cfg)

    def _studied(self, scoped: DataFrame, rows: DataFrame) -> DataFrame:
        """(question_id, concepts, exam): of study guides for those who ask for notes or an exam, key concepts as far as the
        scope bears them out."""
        wanted = scoped.where(F.col("scope.explanation_mode").isin("study_notes", "exam_prep"))
        guides = self._kept(longform.study_guides(wanted, rows.join(wanted.select("question_id"), "question_id", "left_semi"), self.llm, self.cfg), "guides")
        draft = F.array_join(F.slice("guide.key_concepts", 1, 8), "\n")
        answers = guides.where(F.size("guide.key_concepts") > 0).select(F.col("question_id").alias("answer_id"), F.lit(None).cast("bigint").alias("chat_id"), draft.alias("draft"), F.lit(1.0).alias("retrieval_score"))
        told = self._grounded(answers, _evidence(rows.join(answers.select(F.col("answer_id").alias("question_id")), "question_id", "left_semi"), "position"), None)
        lines = F.filter(F.split("grounded_answer", "\n"), lambda x: (F.trim(x) != "") & ~x.isin(fixed.NOT_FOUND_EN, fixed.NOT_FOUND_AR))
        return guides.join(told.select(F.col("answer_id").alias("question_id"), lines.alias("concepts")), "question_id", "left").select("question_id", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"), F.col("guide.exam_questions").alias("exam"))

    def ask(self, questions: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """A row for each question: answer, citations, used_chunks, confidence, retrieval_score, evidence_coverage,
        citation_score, grounding_score, is_out_of_scope.

        A scope that was named is resolved and fails closed; its headings are listed if they are asked for, else it is explained
        as a whole. Other questions are answered from the best chunks, or told what the document covers if none is near enough.
        Every answer of the model is checked against what it was shown. A blank question gets nulls.
        """
        chunks = self.store.all()
        known = self._kept(self.understood(questions, history), "questions")
        normal = F.col("scope.query_type") == "normal_query"
        plain, scoped = known.where(normal), known.where(~normal)
        found = self._kept(retrieval.hybrid_search(plain, chunks, self.cfg, self.reranker), "found")
        away = retrieval.out_of_scope(plain, found, self.cfg).where("is_out_of_scope").select("question_id")
        near = plain.join(away, "question_id", "left_anti")
        ready = self._kept(self._plain(near, found, chunks), "ready")
        places, verdicts = scope.resolve(scoped, chunks)
        verdicts = self._kept(verdicts, "scopes")
        rows = self._kept(places.join(chunks, "id"), "scope-chunks")

        told = scoped.join(verdicts.select("question_id", "focus", "confidence", "not_found"), "question_id")
        headings = told.where(longform.wants_outline(F.col("question"), F.col("scope.query_type")) & F.col("not_found").isNull())
        listed = longform.outlines(rows.join(headings.select("question_id"), "question_id", "left_semi"))
        outlines = headings.select("question_id").join(listed, "question_id", "left").select("question_id", F.coalesce("markdown", F.lit("")).alias("reply"))
        whole = told.where("not_found IS NULL").join(headings.select("question_id"), "question_id", "left_anti")
        whole = whole.select("question_id", "chat_id", "question", "focus", "confidence", F.col("scope.explanation_mode").alias("explanation_mode"), F.col("scope.response_length").alias("response_length"))
        own = rows.join(whole.select("question_id"), "question_id", "left_semi")
        long_ = longform.explain_scope(whole, own, self.llm, self.cfg)
        head = context.excerpt(F.col("page"), F.col("chapter"), F.col("section"))
        parts = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat(head, F.lit("\n"), "text").alias("x")))), lambda r: r["x"])
        shown = near.select("question_id", "question", "answer_style", "response_length").join(ready.groupBy("question_id").agg(parts.alias("parts")), "question_id")
        said = prompts.style(F.col("answer_style"), F.col("response_length"))
        short = complete(shown, prompts.answer(F.col("question"), F.col("parts"), said), "draft", self.llm).select("question_id", "draft")

        best = found.groupBy("question_id").agg(F.least(F.max("score"), F.lit(1.0)).alias("retrieval_score")).unionByName(whole.select("question_id", F.col("confidence").alias("retrieval_score")))
        drafts = self._kept(short.unionByName(long_).where("draft IS NOT NULL"), "drafts")
        answers = drafts.join(known.select("question_id", "chat_id"), "question_id").join(best, "question_id", "left").select(F.col("question_id").alias("answer_id"), "chat_id", "draft", F.coalesce("retrieval_score", F.lit(1.0)).alias("retrieval_score"))
        evidence = _evidence(ready, "place").unionByName(_evidence(own, "position"))
        report = self._kept(self._grounded(answers, evidence, chunks).withColumnRenamed("answer_id", "question_id"), "report")
        penalty = grounding.validate_citations(answers.select("answer_id", "draft"), evidence.select("answer_id", "label")).select(F.col("answer_id").alias("question_id"), "penalty")

        reply = report.select("question_id", F.col("grounded_answer").alias("reply")).unionByName(outlines)
        studied = self._studied(told.where("not_found IS NULL").join(headings.select("question_id"), "question_id", "left_anti"), own)
        reply = reply.join(studied, "question_id", "left").select("question_id", F.when(F.col("concepts").isNotNull(), longform.highlights(F.col("reply"), F.col("concepts"), F.col("exam"))).otherwise(F.col("reply")).alias("reply"))
        lost = plain.join(away, "question_id", "left_semi")
        topics = longform.overviews(chunks.join(lost.select("chat_id").distinct(), "chat_id", "left_semi"), self.llm)
        away_reply = longform.redirects(lost, topics, self.llm).select("question_id", F.coalesce("reply", F.lit(fixed.NOT_FOUND_EN)).alias("reply"))
        reply = reply.unionByName(away_reply).unionByName(told.where("not_found IS NOT NULL").select("question_id", F.col("not_found").alias("reply")))

        matched = found.join(away, "question_id", "left_anti").select("question_id", "id", F.col("rank").alias("at")).join(chunks.drop("ord"), "id")
        cited = context.citations(matched.unionByName(rows.withColumnRenamed("position", "at").drop("ord"), allowMissingColumns=True), self.cfg)
        used = ready.select("question_id", "place", "id").unionByName(rows.select("question_id", F.col("position").alias("place"), "id"))
        used = used.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("used_chunks"))
        out = questions.select("question_id").join(reply, "question_id", "left").join(cited, "question_id", "left").join(used, "question_id", "left")
        out = out.join(report.drop("grounded_answer"), "question_id", "left").join(penalty, "question_id", "left").join(told.select("question_id", "confidence"), "question_id", "left").join(away.withColumn("away", F.lit(True)), "question_id", "left")
        sure = F.when(F.col("away"), 0.0).otherwise(F.coalesce("confidence", grounding.confidence(F.col("retrieval_score"), F.coalesce("penalty", F.lit(0.0)))))
        sure = F.when(F.col("reply").isNotNull(), sure)
        none = F.array().cast(cited.schema["citations"].dataType)
        return out.withColumn("sure", sure).select(
            "question_id", F.col("reply").alias("answer"), F.coalesce("citations", none).alias("citations"), F.coalesce("used_chunks", F.array().cast("array<bigint>")).alias("used_chunks"), F.col("sure").alias("confidence"),
            F.coalesce("retrieval_score", "sure").alias("retrieval_score"), *(F.coalesce(c, F.when(F.col("reply").isNotNull(), 1.0)).alias(c) for c in ("evidence_coverage", "citation_score")),
            F.coalesce("grounding_score", "sure").alias("grounding_score"), F.coalesce("away", F.lit(False)).alias("is_out_of_scope"),
        )


def _evidence(rows: DataFrame, place: str) -> DataFrame:
    return rows.select(F.col("question_id").alias("answer_id"), F.col(place).cast("int").alias("pos"), F.col("page").cast("string").alias("label"), "page", "id", "text")

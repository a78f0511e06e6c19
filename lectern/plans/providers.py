"""What the engine takes from outside: embeddings, completions, OCR. Defaults are deterministic and need no network."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Llm(Protocol):
    def complete(self, prompts: list[str]) -> list[str | None]: ...


class HashingEmbedder:
    """Tokens hashed to signed places, scaled to length one."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for token in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


class NoLlm:
    """Never answers; every caller then takes its own fallback."""

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [None] * len(prompts)


class ExtractiveLlm:
    """Answers with the first sentences of a prompt's excerpts, marked with their pages."""

    def __init__(self, sentences: int = 3):
        self.sentences = sentences

    def complete(self, prompts: list[str]) -> list[str | None]:
        out = []
        for p in prompts:
            found = []
            for page, body in re.findall(r"\[Page (\d+)[^\]]*\]\n(.*?)(?=\n---\n|\Z)", p or "", re.S):
                first = re.split(r"(?<=[.!?])\s+", body.strip())[0]
                found.append(f"{first} [p. {page}]")
            out.append(" ".join(found[: self.sentences]) or None)
        return out


def embed(df: DataFrame, text: str, to: str, provider: Embedder) -> DataFrame:
    """df with the column's vectors, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(provider.embed(s.fillna("").tolist()))

    return df.withColumn(to, run(F.col(text)))


def complete(df: DataFrame, prompt: Column, to: str, provider: Llm) -> DataFrame:
    """df with replies to the prompts. Python runs for every row that is there: filter to those that need it first."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(provider.complete(s.tolist()), dtype=object)

    return df.withColumn(to, run.asNondeterministic()(prompt))


def verifier_prompt(claim: Column, evidence: Column) -> Column:
    """Claim and evidence for a semantic verifier, which answers in JSON."""
    blocks = F.array_join(F.transform(evidence, lambda x: F.concat(F.lit("[p. "), x["label"], F.lit("] "), x["text"])), "\n\n")
    rule = "Judge the claim by the evidence alone. Answer as JSON: status (SUPPORTED, PARTIALLY_SUPPORTED, CONTRADICTED, UNSUPPORTED, UNCERTAIN), score, reason, supporting_pages."
    return F.concat(F.lit(f"{rule}\n\nCLAIM: "), claim, F.lit("\n\nEVIDENCE:\n"), F.coalesce(F.nullif(blocks, F.lit("")), F.lit("(none)")))


def json_of(reply: Column) -> Column:
    """A reply without the fence or the word json around it."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(reply), r"^`+|`+$", "")), r"(?i)^json", ""))


def rerank_reply(reply: Column, place: Column) -> Column:
    """A candidate's score out of {"0": 7, ...}: tenths, within 0 and 1; 0 if it isn't there."""
    scores = F.from_json(reply, "map<string,double>")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at(scores, place.cast("string")), F.lit(0.0)) / 10))


def study_guide(reply: Column) -> Column:
    """A study guide's JSON as lists of at most 15 entries; malformed entries are dropped."""
    pair = lambda a, b: f"array<struct<{a}:string,{b}:string>>"
    x = F.from_json(reply, f"key_concepts array<string>, definitions {pair('term', 'definition')}, formulas array<string>, faqs {pair('question', 'answer')}, exam_questions array<string>, flashcards {pair('front', 'back')}")
    cut = lambda name: F.slice(F.filter(F.coalesce(x[name], F.array().cast(kinds[name])), lambda e: e.isNotNull()), 1, 15).alias(name)
    kinds = {"key_concepts": "array<string>", "definitions": pair("term", "definition"), "formulas": "array<string>", "faqs": pair("question", "answer"), "exam_questions": "array<string>", "flashcards": pair("front", "back")}
    return F.struct(*(cut(n) for n in kinds))


def rewritten(questions: DataFrame, history: DataFrame, provider: Llm, turns: int = 6) -> DataFrame:
    """questions with search_text: rewritten by the provider where the chat has earlier turns, else the question as it is."""
    from ..operators.scope import recent

    log = recent(history, turns).groupBy("chat_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.concat("role", F.lit(": "), "content").alias("l")))), lambda x: x["l"]), "\n").alias("__log"))
    rows = questions.join(log, "chat_id", "left")
    fresh = rows.where("__log IS NULL").withColumn("search_text", F.col("question"))
    asked = complete(rows.where("__log IS NOT NULL"), F.concat(F.lit("Rewrite the question to stand alone.\n"), F.col("__log"), F.lit("\nQUESTION: "), F.col("question")), "__reply", provider)
    done = asked.withColumn("search_text", F.coalesce(F.nullif(F.trim(F.regexp_replace("__reply", '^\\s*"|"\\s*$', "")), F.lit("")), F.col("question"))).drop("__reply")
    return fresh.unionByName(done).drop("__log")

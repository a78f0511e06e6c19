"""Parquet-backed tables by chat: append, read, delete, replace, upsert; vectors with their checks and guards."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, EngineConfig

T = TypeVar("T")


class StoreError(Exception):
    """A table can't do what was asked of it."""


class StoreUnavailable(StoreError):
    """A call failed as often as it was tried."""


class TableNotFound(StoreError):
    """There is no table yet."""


class DimensionError(StoreError):
    """A vector has another size than the table's."""


class InsertFailed(StoreError):
    """Rows couldn't be written."""


class DeleteFailed(StoreError):
    """Rows couldn't be taken away."""


class UnfilteredDelete(DeleteFailed):
    """A delete without any condition is refused."""


class SearchFailed(StoreError):
    """A search couldn't be run."""


def with_retry(call: Callable[[], T], tries: int = 3, backoff: float = 0.5, name: str = "call") -> T:
    """What call() gives; tried again after `backoff` seconds, twice that, and so on. An error that another try can't mend (a
    wrong type or name, or one of the store's own) is raised at once."""
    for attempt in range(1, max(1, tries) + 1):
        try:
            return call()
        except (AttributeError, TypeError, StoreError):
            raise
        except Exception as error:
            if attempt >= tries:
                raise StoreUnavailable(f"{name} failed {attempt} times") from error
            time.sleep(backoff * attempt)
    raise AssertionError


class ChunkStore:
    """Chunks with their vectors in one table, partitioned by chat_id; so there is no second copy to keep in step."""

    def __init__(self, spark: SparkSession, path: str, cfg: EngineConfig = DEFAULTS):
        self.spark, self.path, self.cfg = spark, path, cfg

    def exists(self) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return bool(where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where))

    def all(self) -> DataFrame:
        if not self.exists():
            raise TableNotFound(self.path)
        return self.spark.read.parquet(self.path)

    def save_many(self, chunks: DataFrame) -> DataFrame:
        """Appends chunks; ids that are null are numbered on from the chat's greatest, in `ord`. Returns what was written."""
        if self.exists():
            # Only the folders of the chats that are written to are read.
            own = chunks.select("chat_id").distinct()
            top = self.all().select("chat_id", "id").join(F.broadcast(own), "chat_id", "left_semi").groupBy("chat_id").agg(F.max("id").alias("__top"))
            chunks = chunks.join(top, "chat_id", "left")
        else:
            chunks = chunks.withColumn("__top", F.lit(None).cast("bigint"))
        new = F.row_number().over(W.partitionBy("chat_id").orderBy(F.col("id").isNotNull(), "ord")) + F.coalesce("__top", F.lit(0))
        chunks = chunks.withColumn("id", F.coalesce("id", new.cast("bigint"))).drop("__top")
        self._checked(chunks).write.mode("append").partitionBy("chat_id").parquet(self.path)
        return chunks

    def get_for_chat(self, chat_id: int) -> DataFrame:
        """A chat's chunks by page, then id; only its partition is read."""
        return self.all().where(F.col("chat_id") == chat_id).orderBy("page", "id")

    def delete_for_chat(self, chat_id: int) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/chat_id={int(chat_id)}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def replace_for_chat(self, chunks: DataFrame) -> None:
        """The partitions of the chats in chunks are overwritten, others stay."""
        self._checked(chunks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chat_id").parquet(self.path)

    def upsert(self, chunks: DataFrame, to: str) -> None:
        """A new table at `to`: rows of chunks instead of those with their (chat_id, id), the others as they were."""
        kept = self.all().join(chunks.select("chat_id", "id"), ["chat_id", "id"], "left_anti")
        kept.unionByName(self._checked(chunks), allowMissingColumns=True).write.partitionBy("chat_id").parquet(to)

    def delete_by_filter(self, condition: Column | None, to: str) -> None:
        """A new table at `to` without the rows that meet the condition; there must be one."""
        if condition is None:
            raise UnfilteredDelete("a condition is needed")
        self.all().where(~F.coalesce(condition, F.lit(False))).write.partitionBy("chat_id").parquet(to)

    def delete_by_ids(self, ids: DataFrame, to: str) -> None:
        self.all().join(ids.select("id"), "id", "left_anti").write.partitionBy("chat_id").parquet(to)

    def count(self, condition: Column | None = None) -> int:
        return (self.all() if condition is None else self.all().where(condition)).count()

    def _checked(self, chunks: DataFrame) -> DataFrame:
        if "embedding" not in chunks.columns:
            return chunks
        size = F.size("embedding")
        wrong = F.raise_error(F.concat(F.lit("vector of "), size.cast("string"), F.lit(f" numbers; the table has {self.cfg.vector_size}"))).cast("array<float>")
        return chunks.withColumn("embedding", F.when(F.col("embedding").isNull() | (size == self.cfg.vector_size), F.col("embedding")).otherwise(wrong))


def vector_filter(**wanted: object) -> Column | None:
    """Equality on each given field, membership for lists; None (no field given) filters nothing."""
    out = None
    for name, value in wanted.items():
        if value is None:
            continue
        one = F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value
        out = one if out is None else out & one
    return out


def read_binary(spark: SparkSession, pattern: str) -> DataFrame:
    """Files as (path, content), for a parser that a provider brings."""
    return spark.read.format("binaryFile").load(pattern).select("path", "content")

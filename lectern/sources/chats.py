"""Chats and their messages as append-only Parquet tables: create, own, list, delete; add, last n, all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import ranked
from ..operators.scope import recent
from .store import TableNotFound

CHAT_DDL = "chat_id bigint, user_id bigint, title string, pdf_name string, overview string, deleted boolean, version bigint"
MESSAGE_DDL = "chat_id bigint, id bigint, role string, content string"


class _Table:
    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path, self.ddl = spark, path, ddl

    def read(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(self.ddl).parquet(self.path) if there else self.spark.createDataFrame([], self.ddl)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


class ChatTable:
    """A chat is its latest version; a deleted one is a version that says so. Every read names the user it is for."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = _Table(spark, path, CHAT_DDL)
        self.spark = spark

    def _now(self) -> DataFrame:
        latest = self.table.read().groupBy("chat_id").agg(F.max_by(F.struct("user_id", "title", "pdf_name", "overview", "deleted", "version"), "version").alias("v"))
        return latest.select("chat_id", "v.*").where("NOT deleted")

    def create(self, chats: DataFrame) -> DataFrame:
        """chats (user_id, title, pdf_name) with the ids that they get, in the order of user and title; returns them."""
        top = self.table.read().agg(F.coalesce(F.max("chat_id"), F.lit(0))).first()[0]
        rows = sorted((tuple(r) for r in chats.select("user_id", "title", "pdf_name").collect()), key=str)  # an upload's few
        made = self.spark.createDataFrame([(top + i, *r, None, False, 1) for i, r in enumerate(rows, 1)], CHAT_DDL)
        self.table.add(made)
        return made.drop("deleted", "version")

    def owned(self, user_id: int, chat_id: int) -> DataFrame:
        """The chat, if it is the user's; no row otherwise."""
        return self._now().where((F.col("chat_id") == chat_id) & (F.col("user_id") == user_id)).drop("deleted", "version")

    def list_for_user(self, user_id: int) -> DataFrame:
        """The user's chats, the newest first."""
        return self._now().where(F.col("user_id") == user_id).drop("deleted", "version").orderBy(F.desc("chat_id"))

    def _put(self, user_id: int, chat_id: int, **change: object) -> None:
        own = self._now().where((F.col("chat_id") == chat_id) & (F.col("user_id") == user_id))
        row = own.first()
        if row is None:
            raise TableNotFound(f"user {user_id} has no chat {chat_id}")
        new = row.asDict() | change | {"version": row.version + 1}
        names = [c.split()[0] for c in CHAT_DDL.split(", ")]
        self.table.add(self.spark.createDataFrame([tuple(new[n] for n in names)], CHAT_DDL))

    def set_overview(self, user_id: int, chat_id: int, overview: str) -> None:
        self._put(user_id, chat_id, overview=overview)

    def delete(self, user_id: int, chat_id: int) -> None:
        """Only its owner's chat goes."""
        self._put(user_id, chat_id, deleted=True)


def owned_rows(rows: DataFrame, chats: DataFrame, user_id: int) -> DataFrame:
    """rows (chat_id) of the user's chats alone."""
    return rows.join(chats.where(F.col("user_id") == user_id).select("chat_id").distinct(), "chat_id", "left_semi")


class MessageTable:
    def __init__(self, spark: SparkSession, path: str):
        self.table = _Table(spark, path, MESSAGE_DDL)

    def add(self, messages: DataFrame) -> None:
        """messages (chat_id, turn, role, content) after those that are there, in the order of `turn`."""
        top = self.table.read().groupBy("chat_id").agg(F.max("id").alias("__top"))
        rows = ranked(messages.join(top, "chat_id", "left"), ["chat_id"], F.col("turn"), name="__n")
        self.table.add(rows.select("chat_id", (F.coalesce("__top", F.lit(0)) + F.col("__n")).cast("bigint").alias("id"), "role", "content"))

    def all(self, chat_id: int) -> DataFrame:
        return self.table.read().where(F.col("chat_id") == chat_id).orderBy("id")

    def last(self, n: int) -> DataFrame:
        """The last n messages of every chat, in any order of rows; `id` tells theirs."""
        return recent(self.table.read(), n)


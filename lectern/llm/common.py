"""Shared pieces of the training-data operators: table access, shared scratch tables, batches of whole texts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and tab to carriage return. bytes.split() cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where it is unset and the session runs in one process
    (tests), a local folder is set; a cluster without it is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lectern-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that no more texts than those are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The column's UTF-8 bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def by_volume(texts: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts holding about `most` bytes each, a longer text alone in its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def crc_mod(id_column: str, n: int):
    """crc32 of the id's decimal digits, modulo n: the folds of the learned operators. A null id has no digits: its fold is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is its component's least node.

    edges: columns u, v of one orderable type, any direction, repeats allowed. Alternates large-star and small-star steps
    until the edge set is stable: O(log^2 n) rounds whatever the shape of a component. Minima are pre-aggregated, so a hub
    only ever meets its rows in a plain join that adaptive execution can split. Each round is cut off with checkpoint().
    """
    shared_dir(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = moved.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        if (then := state(now)) == seen:
            break
        seen = then
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

"""Preference formatting in column expressions: the common turns once as prompt, then two masked completions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is OPEN role CLOSE newline text END newline. OPEN within a text or a role is broken up, so no turn can be forged.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
BROKEN = "< |"
LEARNED = "assistant"
NO_ROLE = "unknown"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(F.coalesce(turn["role"], F.lit(NO_ROLE)), F.lit(OPEN), F.lit(BROKEN)), F.lit(CLOSE + "\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit(OPEN), F.lit(BROKEN)), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def learned(turns: Column) -> Column:
    """start:end of the parts of rendered turns that are learned from, in code points, comma-joined: an assistant's text and
    its end mark. All else is masked."""
    sizes = F.transform(turns, lambda t: F.struct(F.length(_head(t)).alias("h"), F.length(_body(t)).alias("b"), (F.coalesce(t["role"], F.lit("")) == LEARNED).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["h"]
        z = a + x["b"]
        span = F.concat(F.when(acc["out"] == "", F.lit("")).otherwise(F.lit(",")), a.cast("string"), F.lit(":"), z.cast("string"))
        return F.struct((z + 1).alias("at"), F.when(x["own"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal in role and text; null equals null only."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def step(acc: Column, p: Column) -> Column:
        there = p["x"].isNotNull() & p["y"].isNotNull()
        same = acc["open"] & there & p["x"]["role"].eqNullSafe(p["y"]["role"]) & p["x"]["text"].eqNullSafe(p["y"]["text"])
        return F.struct(same.alias("open"), (acc["n"] + same.cast("int")).alias("n"))

    return F.aggregate(pairs, F.struct(F.lit(True).alias("open"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """One row per pair_id in either table: prompt_turns, prompt, chosen, chosen_learned, rejected, rejected_learned.

    Both have pair_col, turn, role, text; other columns are not read. Turns are ordered by turn, role, text (nulls first);
    repeated rows are repeated turns. A pair on one side only, or with equal sides, has the respective completions empty. A
    null role is rendered as `unknown` and masked, a null text as empty. A null pair_id is a pair. One exchange gathers a
    conversation, which is one value of the result and must fit a row.
    """

    def side(df: DataFrame, which: int) -> DataFrame:
        return df.select(F.col(pair_col).alias("pair_id"), F.lit(which).alias("side"), F.struct("turn", "role", "text").alias("t"))

    both = side(chosen, 0).union(side(rejected, 1)).groupBy("pair_id")
    got = both.agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == i, F.col("t")))).alias(n) for i, n in ((0, "a"), (1, "b"))))
    got = got.withColumn("n", common_prefix(F.col("a"), F.col("b")))
    head = F.slice("a", 1, F.col("n"))
    rest = [F.slice(c, F.col("n") + 1, F.greatest(F.size(c), F.lit(0))) for c in ("a", "b")]
    return got.select(
        "pair_id", F.col("n").cast("long").alias("prompt_turns"), rendered(head).alias("prompt"),
        rendered(rest[0]).alias("chosen"), learned(rest[0]).alias("chosen_learned"), rendered(rest[1]).alias("rejected"), learned(rest[1]).alias("rejected_learned"),
    )


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Rejected sides for conversations (conv_id, turn, role, text): each one up to its last assistant turn, in whose place
    stands the last assistant turn of the neighbour, whose id differs in the lowest bit. Without an assistant turn a
    conversation is its own rejected side; without one in the neighbour nothing follows."""
    turns = turns.select("conv_id", "turn", "role", "text")
    last = turns.where(F.col("role") == LEARNED).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    a, b = last.select("conv_id", F.col("last.turn").alias("at")), last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("last.text").alias("text"))
    kept = turns.join(a.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").where("at IS NULL OR turn < at").select("conv_id", "turn", "role", "text")
    replies = a.withColumnRenamed("conv_id", "c").join(b, F.col("c").eqNullSafe(F.col("conv_id"))).select("conv_id", F.col("at").alias("turn"), F.lit(LEARNED).alias("role"), "text")
    return kept.union(replies)


def _query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = format_preferences(turns.withColumnRenamed("conv_id", "pair_id"), swapped_replies(turns).withColumnRenamed("conv_id", "pair_id"))
    return out.withColumnRenamed("pair_id", "conv_id")


def _sql() -> str:
    head = f"'{OPEN}' || replace(coalesce(role, '{NO_ROLE}'), '{OPEN}', '{BROKEN}') || '{CLOSE}' || chr(10)"
    body = f"replace(coalesce(text, ''), '{OPEN}', '{BROKEN}') || '{END}'"
    return f"""WITH last AS (SELECT conv_id, max(turn) AS at, arg_max(text, (turn, text)) AS text FROM conversations WHERE role = '{LEARNED}' GROUP BY conv_id),
      r AS (SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c LEFT JOIN last l ON c.conv_id = l.conv_id WHERE l.at IS NULL OR c.turn < l.at
        UNION ALL SELECT a.conv_id, a.at, '{LEARNED}', b.text FROM last a JOIN last b ON xor(b.conv_id, 1) = a.conv_id),
      x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
      y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM r),
      p AS (SELECT conv_id, count(*) FILTER (same) AS n FROM (SELECT conv_id, k, bool_and(x.k IS NOT NULL AND y.k IS NOT NULL AND x.role IS NOT DISTINCT FROM y.role
          AND x.text IS NOT DISTINCT FROM y.text) OVER (PARTITION BY conv_id ORDER BY k) AS same FROM x FULL JOIN y USING (conv_id, k)) GROUP BY conv_id),
      t AS (SELECT conv_id, k, n, side, role, {head} AS h, {body} AS b FROM (SELECT conv_id, k, role, text, 0 AS side FROM x UNION ALL SELECT conv_id, k, role, text, 1 FROM y) JOIN p USING (conv_id)),
      o AS (SELECT *, sum(length(h) + length(b) + 1) OVER (PARTITION BY conv_id, side, k > n ORDER BY k) - length(b) - 1 AS s FROM t)
      SELECT conv_id, CAST(max(n) AS BIGINT) AS prompt_turns, coalesce(string_agg(h || b || chr(10), '' ORDER BY k) FILTER (k <= n AND side = 0), '') AS prompt,
      {", ".join(f"coalesce(string_agg(h || b || chr(10), '' ORDER BY k) FILTER (k > n AND side = {i}), '') AS {c}, coalesce(string_agg(s || ':' || (s + length(b)), ',' ORDER BY k) FILTER (k > n AND side = {i} AND role = '{LEARNED}'), '') AS {c}_learned" for i, c in ((0, "chosen"), (1, "rejected")))}
      FROM o GROUP BY conv_id"""


QUERIES: dict[str, Callable] = {"op1_preference_format": _query}
SQL = {"op1_preference_format": _sql()}

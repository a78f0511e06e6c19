"""Secret scans in column expressions only: fixed patterns, and windows of high Shannon entropy in candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Fewer characters than these fail; for runs of one class a failing match and a match that isn't tried are the same.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"


@dataclass(frozen=True)
class Rule:
    """A character class: its candidates, the window in characters, and the entropy in bits that a window must exceed."""

    candidate: str
    only: str
    window: int
    bits: float


#: Hex digits first: what has none but hex digits is judged by the first rule, the rest by the second.
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
RULES = (Rule(CANDIDATE, r"^[0-9a-fA-F]+$", 16, 2.95), Rule(CANDIDATE, r"^[A-Za-z0-9+/=_-]+$", 20, 3.87))
#: Not secrets: digits or letters alone, UUIDs, alphabets and placeholders.
ALLOWED = (
    r"^[0-9]+$",
    r"^[A-Za-z+/=_-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i:example|placeholder|changeme|redacted|dummy|xxxxx|0123456789|1234567890|abcdefgh)",
)
#: Runs of one class, so that no name or path is a part of them: hex digits of one case, and letters with digits.
RUN = r"[A-Za-z0-9]{16,}"
RUN_RULES = (Rule(RUN, r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 2.95), Rule(RUN, r"^[A-Za-z0-9]+$", 20, 3.4))


def entropy(candidate: Column, window: int) -> Column:
    """The greatest Shannon entropy in bits of the candidate's windows; 0 if it is shorter than one.

    One pass: a step adds the character that enters and takes away the one that leaves; of sum(c * log2 c) only the two
    counts that change are recomputed.
    """
    weigh = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    codes = F.transform(F.split(candidate, "", -1), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), 1, F.length(candidate))
    steps = F.zip_with(codes, leaving, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(0.0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        a, b, leaves = x["a"], x["b"], x["b"] > 0
        into = F.get(acc["n"], a)
        out = F.get(acc["n"], b) + (a == b).cast("int")
        total = acc["sum"] + F.get(weigh, into + 1) - F.get(weigh, into) + F.when(leaves, F.get(weigh, out - 1) - F.get(weigh, out)).otherwise(0.0)
        counts = F.transform(acc["n"], lambda c, j: c + (j == a).cast("int") - (leaves & (j == b)).cast("int"))
        bits = F.when(acc["i"] >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(0.0)
        return F.struct(counts.alias("n"), total.alias("sum"), (acc["i"] + 1).alias("i"), F.greatest(acc["best"], bits).alias("best"))

    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def _found(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches: start, rank, kind, end, and what `group` matched."""
    matched = F.zip_with(
        F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
        F.split(text, pattern, -1),
        lambda x, before: F.struct(x["m"].alias("m"), x["g"].alias("g"), F.length(before).alias("gap")),
    )
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["g"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(F.filter(matched, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["spans"])
    # Most texts match nothing: one search is all they cost.
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _high(span: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    value, verdict = span["value"], F.lit(False)
    for rule in reversed(rules):
        verdict = F.when(value.rlike(rule.only), entropy(value, rule.window) > rule.bits).otherwise(verdict)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(verdict)


def spans(docs: DataFrame, text_col: str = "text", base_col: str = "__base", all_col: str = "__all") -> DataFrame:
    """docs with base_col and all_col: sorted arrays of spans (start, rank, kind, end, value) in code points, end exclusive.

    A null text is an empty one and has none. Base kinds may overlap each other. Entropy spans are candidates of high entropy,
    and runs of letters and digits that are by themselves, whatever name or path they are glued to; one that overlaps a span
    already found is that secret again and is not added. The whole text is searched, however long.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(_found(text, ASSIGN, "assign", 1), lambda x: F.length(x["value"]) >= 8)
    base = F.array_sort(F.concat(assign, _found(text, ACCESS, "access"), _found(text, HEX, "hex")))

    def added(found: Column, to: str, rules: tuple[Rule, ...]) -> Column:
        fresh = F.filter(found, lambda x: ~F.exists(F.col(to), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
        return F.array_sort(F.concat(F.col(to), F.filter(fresh, lambda x: _high(x, rules))))

    with_base = docs.withColumn(base_col, base)
    whole = with_base.withColumn(all_col, added(_found(text, CANDIDATE, "entropy"), base_col, RULES))
    return whole.withColumn(all_col, added(_found(text, RUN, "entropy"), all_col, RUN_RULES))


def _joined(array: str) -> Column:
    return F.array_join(F.transform(F.col(array), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, counts of the base kinds, base_sha256 and spans. Other columns are not read."""
    found = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def count(kind: str) -> Column:
        return F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(_joined("__base"), 256).alias("base_sha256"), _joined("__all").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each span, overlapping ones as one, replaced by the mark. Besides the spans of `scan`, runs of letters and
    digits are judged by themselves, whatever they are glued to and whichever span they touch. Texts without a secret stay as
    they are, null too. A span ends with the secret's last character: a quote that closes it stays. Other columns stay,
    whatever their names."""
    text = F.col(text_col)
    base_col, all_col = free(docs, "__base"), free(docs, "__all")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    runs = F.filter(_found(F.coalesce(text, F.lit("")), RUN, "entropy"), lambda x: _high(x, RUN_RULES))
    found = spans(docs, text_col, base_col, all_col).withColumn(all_col, F.array_sort(F.concat(all_col, runs)))
    clean = F.aggregate(F.col(all_col), start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(all_col) > 0, clean).otherwise(text)).drop(base_col, all_col)


def _query(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def part(kind: str, pattern: str, group: int) -> str:
        p = quoted(pattern)
        return f"""SELECT row, {KINDS.index(kind)} AS rank, '{kind}' AS kind, unnest(range(len(m))) AS i, m, g, gaps FROM (
            SELECT row, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS g, string_split_regex(t, {p}) AS gaps FROM d)"""

    def verdict(rules: tuple[Rule, ...]) -> str:
        out = "ELSE false"
        for r in reversed(rules):
            top = f"list_max(list_transform(range(1, len(value) - {r.window} + 2), lambda i: list_entropy(string_split(substr(value, i, {r.window}), ''))))"
            out = f"WHEN regexp_matches(value, {quoted(r.only)}) THEN coalesce({top}, 0) > {r.bits} {out}"
        return f"CASE {out} END"

    allowed = " OR ".join(f"regexp_matches(value, {quoted(p)})" for p in ALLOWED)
    joined = "coalesce(string_agg({0}kind || ':' || b || ':' || e, ',' ORDER BY b, rank, e){1}, '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
      m AS ({" UNION ALL ".join((part("assign", ASSIGN, 1), part("access", ACCESS, 0), part("hex", HEX, 0), part("entropy", CANDIDATE, 0), part("entropy", RUN, 0).replace("'entropy' AS kind", "'run' AS kind")))}),
      s AS (SELECT row, rank, kind, g[i + 1] AS value,
              list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS b,
              b + length(m[i + 1]) AS e FROM m),
      base AS (SELECT row, rank, kind, value, b, e FROM s WHERE kind IN ('access', 'hex') OR kind = 'assign' AND length(value) >= 8),
      more AS (SELECT row, rank, kind, value, b, e FROM s WHERE kind = 'entropy' AND NOT ({allowed}) AND {verdict(RULES)}
              AND NOT EXISTS (SELECT 1 FROM base x WHERE x.row = s.row AND x.b < s.e AND s.b < x.e)),
      seen AS (SELECT * FROM base UNION ALL SELECT * FROM more),
      runs AS (SELECT row, rank, 'entropy' AS kind, value, b, e FROM s WHERE kind = 'run' AND NOT ({allowed}) AND {verdict(RUN_RULES)}
              AND NOT EXISTS (SELECT 1 FROM seen x WHERE x.row = s.row AND x.b < s.e AND s.b < x.e)),
      u AS (SELECT *, true AS own FROM base UNION ALL SELECT *, false FROM more UNION ALL SELECT *, false FROM runs)
      SELECT doc_id, CAST(count(*) FILTER (kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (kind = 'access') AS BIGINT) AS n_access,
        CAST(count(*) FILTER (kind = 'hex') AS BIGINT) AS n_hex,
        sha256({joined.format("", " FILTER (own)")}) AS base_sha256, {joined.format("", " FILTER (kind IS NOT NULL)")} AS spans
      FROM d LEFT JOIN u USING (row) GROUP BY row, doc_id"""


QUERIES: dict[str, Callable] = {"op9_secret_scan": _query}
SQL = {"op9_secret_scan": _sql()}

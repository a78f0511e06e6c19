"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded choice of whole documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, free, stored

#: Hash buckets of a pattern. One level of sums over them finds where a quota ends; only what lies there is ordered.
BUCKETS = 1 << 13
#: Documents, from where a quota ends on, among which the rest of the quota is filled up.
FILL = 1000
#: Documents on either side of the place where a quota ends that are combined freely, to fill it up.
LOOK = 64
#: Rows of a pattern around the end of its quota that are ordered in one task; with more, the hash is looked at more closely.
MOST_ROWS = 20_000
#: A table of patterns and one of sources come to the driver. Both are label sets, not data; beyond this many the job says so.
MOST_PATTERNS = 200_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: float = 2.0) -> dict[str | None, float]:
    """Words for each source: `share` of all, by weight (sources by code point, null last, weights repeating); what exceeds
    `repeat` times a source's size is dealt again by weight among the others until none exceeds it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] / total > repeat * sizes[s]]
        if not full:
            return out | {s: rest * weight[s] / total for s in open_}
        out |= {s: float(repeat * sizes[s]) for s in full}
        rest -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def flow(patterns: list[tuple[tuple, int]], quotas: dict, epochs: int = 2) -> list[int]:
    """Words to take from each (members, words) pattern so that the sources' quotas are met at the least cost.

    A network: pattern to each source that it belongs to, source to sink with its quota, and into the pattern one arc per
    epoch with the pattern's words as its capacity and the epoch's number as its cost, so that repetition costs more the
    more there is of it (convex). Successive shortest paths: an epoch's arcs are used up before the next epoch's, and within
    one a path may push flow back out of a source to hand it another pattern. Paths are sought among sources alone: one leads
    to another by any pattern that gives to the first and belongs to the other. What can't reach the sink once never can again.
    """
    left = {s: int(round(q)) for s, q in quotas.items()}
    through = [dict.fromkeys(m, 0) for m, _ in patterns]
    #: Of each pair of sources the patterns that give to the first and belong to the second, in the order of their coming.
    ways: dict = {s: {} for s in quotas}
    dead: set = set()
    begin = object()

    def add(p: int, s: object, n: int) -> None:
        before, through[p][s] = through[p][s], through[p][s] + n
        if (before > 0) != (through[p][s] > 0):
            for other in patterns[p][0]:
                if other != s:
                    own = ways[s].setdefault(other, {})
                    if before:
                        del own[p]
                    else:
                        own[p] = None

    def push(p: int, room: int) -> int:
        """Moves up to `room` words from pattern p to the sink along one path; 0 if there is none."""
        came: dict = {s: begin for s in patterns[p][0] if s not in dead}
        queue = list(came)
        for s in queue:
            if left[s]:
                path = [s]
                while came[path[-1]] is not begin:
                    path.append(came[path[-1]])
                path.reverse()
                hands = [next(iter(ways[a][b])) for a, b in zip(path, path[1:])]
                most = min([room, left[s]] + [through[q][a] for q, a in zip(hands, path)])
                add(p, path[0], most)
                for q, a, b in zip(hands, path, path[1:]):
                    add(q, a, -most)
                    add(q, b, most)
                left[s] -= most
                return most
            for other, by in ways[s].items():
                if by and other not in came and other not in dead:
                    came[other] = s
                    queue.append(other)
        dead.update(came)
        return 0

    taken = [0] * len(patterns)
    order = sorted((len(m), i) for i, (m, n) in enumerate(patterns) if n)
    for _ in range(epochs):
        # Patterns with the fewest sources first: they have the fewest other ways.
        for _, i in order:
            room = patterns[i][1]
            while room and (moved := push(i, room)):
                room -= moved
                taken[i] += moved
    return taken


def fitting(sizes: list[int], rest: int, bits: int = 1 << 22) -> list[bool]:
    """Which of the sizes to take: in order while they fit, then of the LOOK before and the LOOK after that place the subset
    that leaves the least of the rest (subset sums as the bits of an integer; a place in words beyond `bits` isn't left)."""
    more, i = [False] * len(sizes), 0
    while i < len(sizes) and (sizes[i] <= rest or rest > bits):
        more[i] = sizes[i] <= rest
        rest -= sizes[i] * more[i]
        i += 1
    top = i + LOOK
    for _ in range(LOOK):
        if i and rest + sizes[i - 1] * more[i - 1] <= bits:
            i -= 1
            rest += sizes[i] * more[i]
            more[i] = False
    reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for n in sizes[i:top]:
        steps.append(reach)
        if n <= rest:
            reach |= (reach << n) & mask
    at = reach.bit_length() - 1
    for j in range(len(steps) - 1, -1, -1):
        if not steps[j] >> at & 1:
            more[i + j] = True
            at -= sizes[i + j]
    return more


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _ended(group: pd.DataFrame) -> pd.DataFrame:
    """Of a pattern's buckets (BUCKETS a level at most, with sums of words and rows): those up to `low` lie wholly within the
    quota and well before its end; `high` is the last that may still be needed; rows: how many lie between."""
    group = group.sort_values("bucket")
    words, rows, quota = group["n"].cumsum(), group["rows"].cumsum(), int(group["rest"].iloc[0])
    within = int((words <= quota).sum())
    before = 0 if within == 0 else rows.iloc[within - 1]
    sure = int((rows.iloc[:within] <= before - LOOK).sum())
    last = min(int((rows < before + FILL).sum()), len(group) - 1)
    low, full = (int(group["bucket"].iloc[sure - 1]), int(words.iloc[sure - 1])) if sure else (int(group["bucket"].iloc[0]) - 1, 0)
    high = max(low, int(group["bucket"].iloc[last]))
    between = group["rows"][(group["bucket"] > low) & (group["bucket"] <= high)].sum()
    return pd.DataFrame({"p": [group["p"].iloc[0]], "low": [low], "high": [high], "rest": [quota - full], "rows": [int(between)]})


def _filled(group: pd.DataFrame) -> pd.DataFrame:
    """Rows (h, doc_id, size, copies) of a pattern around the end of its quota: how many of the copies are taken once more."""
    # Buckets are the leading bits, so hashes are ordered as numbers without a sign.
    group = group.assign(u=group["h"].to_numpy().astype("uint64")).sort_values(["u", "doc_id", "size"], kind="stable", na_position="last")
    rest, taken, sizes, owners, held = int(group["rest"].iloc[0]), [0] * len(group), [], [], 0
    for i, (n, copies) in enumerate(zip(group["size"].astype(int).tolist(), group["copies"].astype(int).tolist())):
        # Of very many copies those well within what is left are taken, those well beyond it aren't; the rest are weighed.
        sure = max(0, min(copies, (rest - held) // n) - LOOK)
        taken[i], rest = sure, rest - sure * n
        few = min(copies - sure, FILL + LOOK)
        sizes += [n] * few
        owners += [i] * few
        held += n * few
    for i, more in zip(owners, fitting(sizes, rest)):
        taken[i] += more
    return group.assign(taken=taken)[["p", "h", "doc_id", "size", "taken"]]


@dataclass
class _Mix:
    """What a mix has decided. rows: a stored table (doc_id, pattern, size, h); names: (pattern, p, whole, quota); ends: (p, low,
    high, rest, level); filled: (p, h, doc_id, size, taken) for what lies between low and high."""

    rows: DataFrame
    names: DataFrame
    ends: DataFrame
    filled: DataFrame

    def placed(self, rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        """(sure, edge) of rows with the columns of self.rows: sure has `times`, edge is to meet `filled`."""
        own = rows.withColumn("pattern", F.coalesce("pattern", F.array().cast("array<string>"))).join(F.broadcast(self.names), "pattern").join(F.broadcast(self.ends), "p")
        at = _bucket(F.col("h"), F.col("level"))
        inner = (F.col("size") > 0) & (F.col("rest") > 0) & (at > F.col("low")) & (at <= F.col("high"))
        within = (F.col("whole") + (at <= F.col("low")).cast("long")).alias("times")
        names = ["doc_id", "pattern", "size", "h", "p", "whole", *more]
        return own.where(~inner).select("doc_id", "pattern", "size", within, *more), own.where(inner).select(*names)


def _bucket(h: Column, level: Column | int) -> Column:
    """The leading bits of the hash, log2(BUCKETS) for each level."""
    bits = BUCKETS.bit_length() - 1
    return F.call_function("shiftrightunsigned", h, (64 - bits * (F.lit(level) if isinstance(level, int) else level)).cast("int"))


def _order(id_col: Column, size: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_col, size)


def _decided(docs: DataFrame, members: Column, quotas: Callable[[dict], dict], id_col: str, text_col: str, seed: int, epochs: int) -> _Mix:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(members)).alias("pattern"), word_count(F.col(text_col)).alias("size"))
    rows = stored(rows.withColumn("h", _order(F.col("doc_id"), F.col("size"), seed)), "mix-sizes")
    found = rows.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = [(tuple(r.pattern or ()), int(r.n or 0)) for r in sorted(found, key=lambda r: [(x is None, x or "") for x in r.pattern or ()])]
    sizes: dict = {}
    for m, n in patterns:
        for s in m:
            sizes[s] = sizes.get(s, 0) + n
    taken = flow(patterns, quotas(sizes), epochs)
    plan = [(list(m), i, t // n if n else 0, t - t // n * n if n else 0) for i, ((m, n), t) in enumerate(zip(patterns, taken))]
    # One row per pattern, MOST_PATTERNS at most: names and ends are bounded.
    names = spark.createDataFrame(plan, "pattern array<string>, p int, whole long, quota long")
    own = rows.withColumn("pattern", F.coalesce("pattern", F.array().cast("array<string>"))).join(F.broadcast(names), "pattern").select("p", "doc_id", "size", "h", "quota")
    ddl, levels = "p int, low long, high long, rest long, rows long", 63 // (BUCKETS.bit_length() - 1)
    ends = {i: (-1, (1 << 62), quota, 0) for _, i, _, quota in plan}
    open_ = own.withColumn("rest", F.col("quota"))
    for level in range(1, levels + 1):
        sums = open_.groupBy("p", _bucket(F.col("h"), level).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("rest").alias("rest"))
        got = sums.groupBy("p").applyInPandas(_ended, ddl).collect()
        ends |= {r.p: (r.low, r.high, r.rest, level) for r in got}
        wide = [(r.p, r.low, r.high, r.rest) for r in got if r.rows > MOST_ROWS and r.rest > 0]
        if not wide or level == levels:
            break
        # Patterns of which too much lies around the end are looked at again there, by more bits of the hash.
        again = F.broadcast(spark.createDataFrame(wide, "p int, low long, high long, rest long"))
        open_ = own.join(again, "p").where((_bucket(F.col("h"), level) > F.col("low")) & (_bucket(F.col("h"), level) <= F.col("high"))).select("p", "doc_id", "size", "h", "rest")
    ends = spark.createDataFrame([(p, *e) for p, e in ends.items()], "p int, low long, high long, rest long, level int")
    mix_ = _Mix(rows, names, ends, rows)
    edge = mix_.placed(rows)[1].join(F.broadcast(ends.select("p", "rest")), "p").groupBy("p", "h", "doc_id", "size", "rest").agg(F.count("*").alias("copies"))
    kind = docs.schema[id_col].dataType.simpleString()
    mix_.filled = edge.groupBy("p").applyInPandas(_filled, f"p int, h long, doc_id {kind}, size long, taken long")
    return mix_


def mix(docs: DataFrame, members: Column, quotas: Callable[[dict], dict], id_col: str = "doc_id", text_col: str = "text", seed: int = 17, epochs: int = 2) -> DataFrame:
    """(doc_id, pattern, size, taken) for each row of docs: taken is size times how often the mix takes the document.

    members: an array of source names (null is a name); quotas: sizes by source (a document counts for each of its sources)
    to words by source. Documents are whole; a pattern that is to give more than its words gives each of them once and some
    twice. Which: those with the lowest seeded hash of id and size, ordered by hash, id and size; where the quota ends, the
    next documents are looked through for those that fill it best. Where more than MOST_ROWS lie there, further bits of the
    hash narrow it down, and repeats are one row with their number, so no pattern's documents are ever gathered in one task.
    Reruns and other partitionings agree. Rows that repeat an id are rows of their own. No member: nothing is taken. An empty
    text or null has size 0 and is taken as 0. An empty table gives an empty result.
    """
    made = _decided(docs, members, quotas, id_col, text_col, seed, epochs)
    sure, edge = made.placed(made.rows)
    numbered = edge.groupBy("p", "pattern", "whole", "h", "doc_id", "size").agg(F.count("*").alias("copies"))
    f = made.filled.select(F.col("p").alias("fp"), F.col("h").alias("fh"), F.col("doc_id").alias("fd"), F.col("size").alias("fs"), F.col("taken").alias("more"))
    same = (F.col("p") == F.col("fp")) & (F.col("h") == F.col("fh")) & F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("size") == F.col("fs"))
    both = numbered.join(f, same)
    copies = both.select("doc_id", "pattern", "size", (F.col("whole") + 1).alias("times"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("more"))).alias("i")).where("i > 0").drop("i")
    others = both.select("doc_id", "pattern", "size", F.col("whole").alias("times"), F.explode(F.sequence(F.col("more"), F.col("copies"))).alias("i"), "more").where("i > more").drop("i", "more")
    out = sure.unionByName(copies).unionByName(others)
    return out.select("doc_id", "pattern", "size", (F.col("size") * F.col("times")).alias("taken"))


def _by_source(weights: tuple[int, ...], share: float, repeat: float) -> tuple[dict, Callable[[dict], dict]]:
    wanted: dict = {}

    def quotas(sizes: dict) -> dict:
        wanted.update({s: (n, t) for (s, t) in targets(sizes, weights, share, repeat).items() for n in [sizes[s]]})
        return {s: t for s, (_, t) in wanted.items()}

    return wanted, quotas


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) where each document belongs to its one source (null is a source)."""
    wanted, quotas = _by_source(weights, share, repeat)
    taken = mix(docs, F.array(F.col("source").cast("string")), quotas, seed=seed, epochs=int(repeat))
    table = docs.sparkSession.createDataFrame([(s, n, t) for s, (n, t) in wanted.items()], "source string, source_size long, target double")
    taken = taken.withColumn("source", F.get("pattern", F.lit(0)))
    return taken.join(F.broadcast(table), taken["source"].eqNullSafe(table["source"])).select("doc_id", "size", "source_size", "target", "taken", taken["source"])


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: float = 2.0, seed: int = 17) -> DataFrame:
    """docs as the mix has them: each row as often as it is taken. Rows without words, which no quota can count, stay once.

    Where the place of a row's hash decides, it does so beside the text: only rows around the end of a quota are joined to
    what was decided there, so the texts are not shuffled. Rows that repeat id and size are told apart by a hash of their
    text; of equal ones as many are taken as the mix says. Other columns stay, whatever their names.
    """
    _, quotas = _by_source(weights, share, repeat)
    members = F.array(F.col("source").cast("string"))
    made = _decided(docs, members, quotas, "doc_id", "text", seed, int(repeat))
    row = free(docs, "__row")
    whole = docs.select(F.col("doc_id"), members.alias("pattern"), word_count(F.col("text")).alias("size"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row))
    sure, edge = made.placed(whole.withColumn("h", _order(F.col("doc_id"), F.col("size"), seed)), row)
    number = F.row_number().over(W.partitionBy("p", "h", "doc_id", "size").orderBy(F.xxhash64(f"{row}.text")))
    f = made.filled.select(F.col("p").alias("fp"), F.col("h").alias("fh"), F.col("doc_id").alias("fd"), F.col("size").alias("fs"), F.col("taken").alias("more"))
    same = (F.col("p") == F.col("fp")) & (F.col("h") == F.col("fh")) & F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("size") == F.col("fs"))
    filled = edge.withColumn("n", number).join(f, same).select("size", (F.col("whole") + (F.col("n") <= F.col("more")).cast("long")).alias("times"), row)
    out = sure.select("size", "times", row).unionByName(filled)
    times = F.when(F.col("size") > 0, F.col("times")).otherwise(1).cast("int")
    return out.select(row, times.alias("times")).where("times > 0").select(row, F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("i")).select(f"{row}.*")


def _query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


QUERIES: dict[str, Callable] = {"op2_mix_flow": _query}
SQL: dict[str, str] = {}

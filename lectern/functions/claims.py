"""Features of claims and of the evidence for them, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import any_in, let, literals, significant, strip


def bare(sentence: Column) -> Column:
    return strip(F.regexp_replace(sentence, fixed.CITATION, ""))


def cited(sentence: Column) -> Column:
    return F.transform(F.regexp_extract_all(sentence, F.lit(fixed.CITATION), F.lit(1)), strip)


def answer_lines(answer: Column) -> Column:
    """array<array<string>>: the sentences of each line. A period in a citation mark ends none."""
    mark = "\x01"

    def line(x: Column) -> Column:
        masked = F.regexp_replace(strip(x), r"(?i)\[(p)\.(\s*[^\]]+)\]", f"[$1{mark}$2]")
        parts = F.split(masked, rf"(?<=[{fixed.SENTENCE_END}])(?U)[\s\x1c-\x1f]+")
        return F.filter(F.transform(parts, lambda s: F.replace(strip(s), F.lit(mark), F.lit("."))), lambda s: s != "")

    return F.transform(F.split(F.coalesce(answer, F.lit("")), "\n", -1), line)


def numeric_tokens(t: Column) -> Column:
    """Percentages, sums of money, versions, decimals, years, numbers of two digits or more; each figure once."""
    rules = (fixed.PERCENT, fixed.MONEY, fixed.VERSION, fixed.DECIMAL, fixed.CLAIM_YEAR, fixed.PLAIN_NUMBER)
    every = F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(r), F.lit(0)) for r in rules)))
    keyed = F.transform(every, lambda x: F.struct(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_.%]", "").alias("k"), x.alias("x")))
    start = F.from_json(F.lit("[]"), "array<struct<k:string,x:string>>")
    once = F.aggregate(keyed, start, lambda acc, v: F.when(F.exists(acc, lambda a: a["k"] == v["k"]), acc).otherwise(F.concat(acc, F.array(v))))
    return F.transform(once, lambda v: v["x"])


def normal_number(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"(?U)[,\s\x1c-\x1f]", "")


def missing_numbers(tokens: Column, evidence: Column) -> Column:
    """Those that the squeezed evidence doesn't have as a part: 12 is found in 2012."""
    return let(normal_number(evidence), lambda e: F.filter(tokens, lambda x: ~F.contains(e, normal_number(x))))


def kind(t: Column) -> Column:
    """numerical first, then by cue words, else factual. A year is a number of two digits or more, so none is a date."""
    low, out = F.lower(t), F.lit("factual")
    for name, cues, pattern in reversed(fixed.KINDS):
        hit = any_in(t if name == "formula" else low, cues)
        out = F.when(hit | low.rlike(pattern) if pattern else hit, F.lit(name)).otherwise(out)
    out = F.when(t.rlike(fixed.CLAIM_YEAR), F.lit("date")).otherwise(out)
    number = t.rlike(fixed.PERCENT) | t.rlike(fixed.MONEY) | t.rlike(fixed.PLAIN_NUMBER) | t.rlike(fixed.DECIMAL)
    return F.when(number, F.lit("numerical")).otherwise(out)


def claim_kind(t: Column) -> Column:
    return F.when(t.rlike(fixed.CONVERSATIONAL), F.lit("conversational")).otherwise(kind(t))


def is_major(t: Column) -> Column:
    return t.rlike(fixed.MAJOR_CLAIM)


def has_negation(t: Column, strict: bool = False) -> Column:
    """A negation as a word, an Arabic one as a part. Unless strict, a text that merely begins with one's letters has it too."""
    parts = [w for w in fixed.NEGATIONS if any("؀" <= c <= "ۿ" for c in w)]
    inside = literals([*parts, *(f" {w} " for w in fixed.NEGATIONS if w not in parts)])

    def seen(padded: Column) -> Column:
        hit = F.exists(inside, lambda w: F.contains(padded, w))
        return hit if strict else hit | let(strip(padded), lambda begins: F.exists(literals(fixed.NEGATIONS), lambda w: F.startswith(begins, w)))

    return let(F.concat(F.lit(" "), F.lower(t), F.lit(" ")), seen)


def relevant(claim: Column, evidence: Column) -> Column:
    """The evidence's sentences that share a significant token with the claim; all of it where that says nothing."""
    sentences = F.filter(F.split(evidence, rf"(?<=[{fixed.SENTENCE_END}])(?U)[\s\x1c-\x1f]+"), lambda s: strip(s) != "")

    def choose(own: Column, parts: Column) -> Column:
        shared = let(F.filter(parts, lambda s: F.arrays_overlap(significant(s), own)), lambda near: F.when(F.size(near) == 0, evidence).otherwise(F.array_join(near, " ")))
        return F.when((F.size(own) == 0) | (F.size(parts) <= 1), evidence).otherwise(shared)

    return let(significant(claim), lambda own: let(sentences, lambda parts: choose(own, parts)))


def negation_risk(claim: Column, evidence: Column, strict: bool = False) -> Column:
    return has_negation(claim, strict) | has_negation(relevant(claim, evidence), strict)


def hedged(number: Column, t: Column, window: int = 40) -> Column:
    """Whether a hedge stands within `window` characters before the number's first place."""
    low = F.lower(t)
    at = F.call_function("instr", low, normal_number(number))
    at = F.when(at == 0, F.call_function("instr", low, F.lower(number))).otherwise(at)
    begin = F.greatest(at - window, F.lit(1))
    return (at > 0) & any_in(F.substring(low, begin, at - begin), fixed.HEDGES)


def metric_mismatch(claim: Column, evidence: Column) -> Column:
    own = F.filter(literals(fixed.METRICS), lambda m: F.contains(F.lower(claim), m))
    return (F.size(own) > 0) & ~F.exists(own, lambda m: F.contains(F.lower(evidence), m))


def derived(value: Column, evidence: Column, terms: int = 4, most: int = 8) -> Column:
    """Whether the value is a sum of two to `terms` of the first `most` figures of the evidence; years don't count."""
    raw = F.filter(F.regexp_extract_all(evidence, F.lit(fixed.GROUPED_NUMBER), F.lit(0)), lambda x: ~x.rlike("^(?:" + fixed.CLAIM_YEAR + ")$"))
    figures = F.slice(F.filter(F.transform(raw, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull() & (x != value)), 1, most)
    start = F.array(F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s")))
    sums = F.aggregate(figures, start, lambda acc, x: F.concat(acc, F.transform(F.filter(acc, lambda a: a["n"] < terms), lambda a: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s")))))
    return F.exists(sums, lambda a: (a["n"] >= 2) & (F.abs(a["s"] - value) < 1e-6))


def enumeration(claim: Column, evidence: Column) -> Column:
    """struct<items, kept, repaired> of a listing clause of three items or more; items is 0 otherwise. An item stays if its
    figures are in the evidence and one of its significant tokens is (or it has none)."""
    pattern = r"(?s)^(.*?" + fixed.LIST_HEAD + r")(.*)$"
    has = claim.rlike(fixed.LIST_HEAD)
    head, tail = F.regexp_extract(claim, pattern, 1), F.regexp_replace(F.regexp_extract(claim, pattern, 3), r"[ .]+$", "")
    every = F.filter(F.transform(F.split(tail, fixed.LIST_SPLIT), strip), lambda x: x != "")

    def stays(x: Column, ev: Column) -> Column:
        return (F.size(missing_numbers(numeric_tokens(x), evidence)) == 0) & let(significant(x), lambda s: (F.size(s) == 0) | F.arrays_overlap(s, ev))

    def listed(kept: Column) -> Column:
        n = F.size(kept)
        many = F.concat(F.array_join(F.slice(kept, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(kept, n - 1))
        return F.when(n == 1, F.get(kept, F.lit(0))).when(n == 2, F.array_join(kept, " and ")).otherwise(many)

    def told(items: Column, kept: Column) -> Column:
        n = F.size(kept)
        return F.struct(F.size(items).alias("items"), n.alias("kept"), F.when(n > 0, F.concat(head, listed(kept), F.lit("."))).alias("repaired"))

    def judged(items: Column) -> Column:
        return let(significant(evidence), lambda ev: let(F.filter(items, lambda x: stays(x, ev)), lambda kept: told(items, kept)))

    none = F.struct(F.lit(0).alias("items"), F.lit(0).alias("kept"), F.lit(None).cast("string").alias("repaired"))
    return F.when(has, let(every, lambda items: F.when(F.size(items) >= 3, judged(items)).otherwise(none))).otherwise(none)


def verdict(reply: Column) -> Column:
    """struct<status, score, reason, pages> of a verifier's JSON, null if it isn't one. Fences and text around the object are
    cut off; a score may be a string, pages a single value."""
    plain = F.regexp_replace(F.regexp_replace(strip(reply), r"^```[a-zA-Z]*\n?", ""), r"```\s*$", "")
    body = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    x = F.from_json(body, "status string, score string, reason string, supporting_pages string")
    status = F.upper(strip(x["status"]))
    pages = F.coalesce(F.from_json(x["supporting_pages"], "array<string>"), F.when(strip(x["supporting_pages"]) != "", F.array(x["supporting_pages"])), F.array().cast("array<string>"))
    pages = F.filter(F.transform(pages, strip), lambda p: p.isNotNull() & (p != ""))
    ok = status.isin("SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "CONTRADICTED", "UNCERTAIN", "NOT_FACTUAL")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["score"].try_cast("double"), F.lit(0.0))))
    return F.when(ok, F.struct(status.alias("status"), score.alias("score"), strip(F.coalesce(x["reason"], F.lit(""))).alias("reason"), pages.alias("pages")))

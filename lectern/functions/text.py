"""Text functions as columns: tokens, keywords, languages, sentences, cleaning, scores. All stay within the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: White space as Python splits at it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.TOKEN), F.lit(0)), F.lower)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once and not once for each time that body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literals(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def any_in(text: Column, values: tuple[str, ...]) -> Column:
    """Whether one of the literal values is a part of text."""
    found = F.lit(False)
    for v in values:
        found = found | F.contains(text, F.lit(v))
    return found


def keywords(question: Column) -> Column:
    stop = literals(fixed.QUESTION_STOPWORDS_EN + fixed.QUESTION_STOPWORDS_AR)
    return F.filter(tokens(question), lambda t: ~F.array_contains(stop, t) & (F.length(t) >= 2))


def significant(text: Column) -> Column:
    """Distinct tokens of two characters or more that aren't function words."""
    stop = literals(fixed.CLAIM_STOPWORDS)
    return F.array_distinct(F.filter(tokens(text), lambda t: ~F.array_contains(stop, t) & (F.length(t) >= 2)))


def overlap(claim: Column, evidence: Column) -> Column:
    """Share of the claim's significant tokens that the evidence has; 0 for none."""
    own = significant(claim)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, significant(evidence))) / F.size(own))


def estimated_tokens(text: Column) -> Column:
    return F.floor(word_count(text) * F.lit(1.3)).cast("long")


def language(text: Column) -> Column:
    """ar, en or mixed by the letters' scripts; null without either. Both at 15 % or more: mixed; a tie below that: en."""
    text = F.coalesce(text, F.lit(""))
    arabic, latin = F.regexp_count(text, F.lit(fixed.ARABIC)), F.regexp_count(text, F.lit("[A-Za-z]"))
    total = arabic + latin
    both = (arabic / total >= 0.15) & (latin / total >= 0.15)
    return F.when(total == 0, F.lit(None).cast("string")).when(both, F.lit("mixed")).when(arabic > latin, F.lit("ar")).otherwise(F.lit("en"))


def sentences(text: Column, ends: str = ".!?؟۔") -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?<=[{ends}])(?U)[\s\x1c-\x1f]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentence_score(sentence: Column, keywords: Column, numbers: Column) -> Column:
    """One for each keyword and one and a half for each number that the sentence has."""
    low = F.lower(sentence)
    return F.size(F.filter(keywords, lambda k: F.contains(low, k))) * F.lit(1.0) + F.size(F.filter(numbers, lambda n: F.contains(sentence, n))) * F.lit(1.5)


def clean(text: Column) -> Column:
    """Blanks collapsed, lines of up to ten symbols dropped, a line that repeats the one before dropped, two newlines at most."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    lines = F.filter(lines, lambda x: (x == "") | ~x.rlike(r"^[^\p{L}\p{N}]{1,10}$"))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("any"), F.lit("").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        keep = (x == "") | (x != acc["last"])
        out = F.when(~acc["any"], x).otherwise(F.concat(acc["out"], F.lit("\n"), x))
        return F.struct(F.when(keep, out).otherwise(acc["out"]).alias("out"), (acc["any"] | keep).alias("any"), F.when(keep, x).otherwise(acc["last"]).alias("last"))

    return strip(F.regexp_replace(F.aggregate(lines, start, step, lambda acc: acc["out"]), r"\n{3,}", "\n\n"))


def compressed(text: Column, target: Column, keywords: Column, numbers: Column) -> Column:
    """The best sentences, in their order, that fit into target tokens; the best one always. A text within the target, or of
    one sentence, stays as it is."""
    parts = sentences(text)
    scored = F.transform(parts, lambda s, i: F.struct((-sentence_score(s, keywords, numbers)).alias("s"), i.alias("i"), s.alias("t"), estimated_tokens(s).alias("n")))
    kind = "struct<n:bigint,kept:array<struct<i:int,t:string>>>"
    start = F.from_json(F.lit('{"n":0,"kept":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] + x["n"] <= target) | (F.size(acc["kept"]) == 0)
        more = F.concat(acc["kept"], F.array(F.struct(x["i"].alias("i"), x["t"].alias("t"))))
        return F.struct(F.when(fits, acc["n"] + x["n"]).otherwise(acc["n"]).alias("n"), F.when(fits, more).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate(F.array_sort(scored), start, step, lambda acc: F.array_join(F.transform(F.array_sort(acc["kept"]), lambda k: k["t"]), " "))
    return F.when((estimated_tokens(text) <= target) | (F.size(parts) <= 1), text).otherwise(kept)


def fixed_chunks(text: Column, limit: int = 800) -> Column:
    """Words packed greedily into chunks of at most `limit` characters, a space after each word counted. A first word beyond
    the limit leaves an empty chunk before it."""
    start = F.from_json(F.lit('{"done":[],"now":"","n":0}'), "struct<done:array<string>,now:string,n:int>")

    def step(acc: Column, w: Column) -> Column:
        full = acc["n"] + F.length(w) + 1 > limit
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), w).otherwise(F.concat(acc["now"], F.lit(" "), w)).alias("now"),
            F.when(full, F.length(w) + 1).otherwise(acc["n"] + F.length(w) + 1).alias("n"),
        )

    return F.aggregate(words(text), start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; 0 if a vector has no length. In doubles."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def suspicious(text: Column) -> tuple[Column, Column]:
    """How many replacement characters and how many control characters other than tab, newline and return."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit("�")).cast("long"), F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")).cast("long")


def page_label(token: Column) -> Column:
    """Whether a word looks like a printed page number."""
    t = F.regexp_replace(strip(token), r"^[.\-–—]+|[.\-–—]+$", "")
    return t.rlike(r"^[0-9٠-٩]{1,4}$") | t.rlike(r"^[ivxlcdmIVXLCDM]{1,7}$") | t.rlike(r"^[a-zA-Z]$") | t.isin(*fixed.ABJAD)


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a table, its first row the header; null if that is blank or missing."""
    flat = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))))
    head = F.get(flat, F.lit(0))
    width = F.size(head)

    def line(cells: Column) -> Column:
        padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(flat, F.lit(2), F.greatest(F.size(flat) - 1, F.lit(0))), line)
    blank = head.isNull() | ~F.exists(head, lambda c: c != "")
    return F.when(~blank, F.array_join(F.concat(F.array(line(head), rule), body), "\n"))


def page_marks(answer: Column) -> Column:
    """array<string>: each run of adjacent page marks as the pages that it names, joined by ` , `."""
    runs = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(fixed.PAGE_MARKS), F.lit(0))
    return F.transform(runs, lambda r: F.array_join(F.regexp_extract_all(r, F.lit(fixed.PAGE_MARK), F.lit(1)), " , "))


def without_marks(answer: Column) -> Column:
    """The text as it is copied: page marks go."""
    return strip(F.regexp_replace(answer, fixed.SHOWN_MARK, ""))


def has_arabic(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(fixed.ARABIC)


def pdf_date(raw: Column) -> Column:
    """D:YYYYMMDDhhmmss as an ISO time in UTC; what can't be read stays as it is."""
    digits = F.regexp_extract(raw, r"^D?:?(\d{14})", 1)
    at = F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), raw)

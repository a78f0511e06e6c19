"""What a question asks for, as columns: entities, intent, plan, style, length, scope."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import keywords, strip


def first_of(q: Column, rules: tuple, default: str) -> Column:
    """The name of the first pattern that is found."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(q.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def found(q: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.when(q.rlike(pattern), F.regexp_extract(q, pattern, group))


def all_found(q: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(q, F.lit(pattern), F.lit(group))


def numbers(q: Column) -> Column:
    return all_found(q, fixed.NUMBER)


def page_references(q: Column) -> Column:
    return F.transform(all_found(q, fixed.PAGE_REFERENCE, 1), digits)


def digits(x: Column) -> Column:
    """An integer from digits, Arabic-Indic ones included."""
    return F.translate(x, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789").try_cast("int")


def chapter_hint(q: Column) -> Column:
    return strip(found(q, fixed.CHAPTER_HINT))


def section_hint(q: Column) -> Column:
    return strip(F.coalesce(found(q, fixed.QUOTED), found(q, fixed.SECTION_HINT)))


def dates(q: Column) -> Column:
    return all_found(q, fixed.YEAR, 1)


def technologies(q: Column) -> Column:
    pattern = r"(?iu)\b(" + "|".join(re.escape(t) for t in fixed.TECHNOLOGIES) + r")\b"
    return F.array_sort(F.array_distinct(F.transform(all_found(q, pattern, 1), F.lower)))


def formulas(q: Column) -> Column:
    return F.zip_with(all_found(q, fixed.FORMULA, 1), all_found(q, fixed.FORMULA, 2), lambda a, b: F.concat_ws(" ", a, b))


def intent(q: Column) -> Column:
    return first_of(q, fixed.INTENTS, fixed.DEFAULT_INTENT)


def complexity(q: Column) -> Column:
    return first_of(q, fixed.COMPLEXITIES, fixed.DEFAULT_COMPLEXITY)


def style(q: Column) -> Column:
    return first_of(q, fixed.STYLES, fixed.DEFAULT_STYLE)


def strategy(intent: Column) -> Column:
    out = F.lit(fixed.DEFAULT_STRATEGY)
    for name, s in fixed.STRATEGIES.items():
        out = F.when(intent == name, F.lit(s)).otherwise(out)
    return out


def depth(intent: Column) -> Column:
    return F.when(intent.isin(*fixed.DEEP_INTENTS), F.lit("explain")).otherwise(F.lit("specific"))


def width(strategy: Column) -> Column:
    out = F.lit(1.0)
    for name, w in fixed.WIDTHS.items():
        out = F.when(strategy == name, F.lit(w)).otherwise(out)
    return out


def explains(q: Column) -> Column:
    return F.when(q.rlike(fixed.EXPLAIN), F.lit("explain")).otherwise(F.lit("specific"))


def response_length(q: Column, depth: Column) -> Column:
    """short, long or auto: said outright, else by the question's shape."""
    plain = strip(q)
    simple = plain.rlike(fixed.SIMPLE_FACT) & (F.regexp_count(plain, F.lit(r"\?")) <= 1) & ~F.contains(F.lower(plain), F.lit(" and "))
    said = F.lit(None).cast("string")
    for name, pattern in reversed(fixed.LENGTH_SIGNALS):
        said = F.when(q.rlike(pattern), F.lit(name)).otherwise(said)
    shape = F.when(depth == "explain", F.lit("long")).when((depth == "specific") & simple, F.lit("short")).otherwise(F.lit("auto"))
    return F.coalesce(said, shape)


def chapter_number(q: Column) -> Column:
    ordinals = F.create_map(*[F.lit(v) for pair in fixed.ARABIC_ORDINALS.items() for v in pair])
    names = "|".join(sorted(fixed.ARABIC_ORDINALS, key=len, reverse=True))
    return F.coalesce(digits(found(q, fixed.CHAPTER)), F.try_element_at(ordinals, found(q, rf"(?:الفصل|فصل)\s+({names})")))


def scope(q: Column) -> Column:
    """struct<query_type, chapters, page_from, page_to, section_hint, explanation_mode, response_length>, the first that fits:
    two chapters, a page range, a chapter, the whole document, a section, a page, an implied scope, none."""
    ints = F.array().cast("array<string>")
    none = {"chapters": ints, "page_from": F.lit(None).cast("int"), "page_to": F.lit(None).cast("int"), "section_hint": F.lit(None).cast("string")}
    mode = style(q)
    length = F.when(mode.isin(*fixed.LONG_STYLES), F.lit("long")).otherwise(F.lit("auto"))

    def plan(kind: str, **own: Column) -> Column:
        return F.struct(F.lit(kind).alias("query_type"), *(own.get(k, v).alias(k) for k, v in none.items()), mode.alias("explanation_mode"), length.alias("response_length"))

    multi = F.filter(F.array(*(F.nullif(F.regexp_extract(q, fixed.MULTI_CHAPTER, i), F.lit("")) for i in (1, 2, 3, 4))), lambda x: x.isNotNull())
    a, b = digits(found(q, fixed.PAGE_RANGE, 1)), digits(found(q, fixed.PAGE_RANGE, 2))
    chapter, page = chapter_number(q), digits(found(q, fixed.SINGLE_PAGE))
    section = strip(F.coalesce(found(q, fixed.QUOTED_SECTION), found(q, fixed.SECTION_HINT)))
    return (
        F.when(q.rlike(fixed.MULTI_CHAPTER), plan("multi_chapter_query", chapters=F.slice(multi, 1, 2)))
        .when(q.rlike(fixed.PAGE_RANGE), plan("page_range", page_from=F.least(a, b), page_to=F.greatest(a, b)))
        .when(chapter.isNotNull(), plan("chapter_query", chapters=F.array(chapter.cast("string"))))
        .when(q.rlike(fixed.WHOLE_DOCUMENT), plan("document_query"))
        .when(section.isNotNull() & (section != ""), plan("section_query", section_hint=section))
        .when(page.isNotNull(), plan("page_range", page_from=page, page_to=page))
        .when(q.rlike(fixed.IMPLIED_SCOPE), plan("document_query"))
        .otherwise(plan("normal_query"))
    )


def understand(questions: DataFrame, column: str = "question") -> DataFrame:
    """questions with all that retrieval needs to know, as columns. Keywords, numbers and hints come from the question as it
    was put, even where another text is searched with."""
    q = F.coalesce(F.col(column), F.lit(""))
    out = questions.withColumns(
        {
            "keywords": keywords(q), "numbers": numbers(q), "page_references": page_references(q), "chapter_hint": chapter_hint(q), "section_hint": section_hint(q),
            "dates": dates(q), "technologies": technologies(q), "formulas": formulas(q), "intent": intent(q), "complexity": complexity(q), "answer_style": style(q), "scope": scope(q),
        }
    )
    out = out.withColumns({"strategy": strategy(F.col("intent")), "depth": depth(F.col("intent"))})
    page = F.when(F.size("page_references") == 1, F.get("page_references", F.lit(0)))
    return out.withColumns({"candidate_multiplier": width(F.col("strategy")), "filter_page": page, "response_length": response_length(q, F.col("depth"))})



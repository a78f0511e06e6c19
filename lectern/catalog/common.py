"""Registration, and SQL fragments that several queries share. SQL patterns are in RE2's dialect."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import fixed

CHUNKS = """chunks AS (SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS chat_id, source AS document_id, doc_id AS id, CAST(o - 1 AS INTEGER) AS ord,
  CAST((o - 1) // 2 + 1 AS INTEGER) AS page, CASE WHEN o % 17 <> 0 THEN 'Chapter ' || ((o - 1) // 10 + 1) END AS chapter, CASE WHEN o % 11 <> 0 THEN 'Section ' || ((o - 1) // 5 + 1) END AS section,
  CAST(NULL AS VARCHAR) AS heading, CAST((o - 1) % 2 AS INTEGER) AS paragraph_index, text, CAST(lag(doc_id) OVER w AS VARCHAR) AS previous_chunk_id, CAST(lead(doc_id) OVER w AS VARCHAR) AS next_chunk_id
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id))"""

#: The characters that trim() is to take off.
TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
RE_TOKEN = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern for RE2 as a literal: it has no flag u."""
    return quoted(pattern.replace("(?iu)", "(?i)"))


def tokens(column: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({column}, ''), '{RE_TOKEN}'), lambda x: lower(x))"


def words(column: str) -> str:
    return f"list_filter(string_split_regex(coalesce({column}, ''), '\\s+'), lambda x: x <> '')"


def names(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def keywords(column: str) -> str:
    return f"list_filter({tokens(column)}, lambda t: NOT list_contains({names(fixed.QUESTION_STOPWORDS_EN + fixed.QUESTION_STOPWORDS_AR)}, t) AND length(t) >= 2)"


def significant(column: str) -> str:
    return f"list_distinct(list_filter({tokens(column)}, lambda t: NOT list_contains({names(fixed.CLAIM_STOPWORDS)}, t) AND length(t) >= 2))"


def first_of(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {re2(p)}) THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


def any_in(column: str, values) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(v)})" for v in values) + ")"


def sentences(column: str, ends: str = ".!?؟۔") -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({column}, '([{ends}])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"


def registry() -> tuple[dict, Callable]:
    found: dict[str, tuple[Callable, str | None]] = {}

    def register(sql: str | None = None, name: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            found[name or f.__name__] = (f, sql)
            return f

        return put

    return found, register

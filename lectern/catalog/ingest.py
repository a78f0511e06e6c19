"""Queries from layout blocks to chunks: web pages stand in for a PDF parser's output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, parsing
from ..sources.tables import HTML_BLOCK, HTML_HIDDEN, html_blocks, table
from .common import TRIM, quoted, registry

REGISTRY, register = registry()


def blocks(spark, d):
    found = html_blocks(table(spark, d, "pages"))
    y = F.col("block_index") * 12.0
    return found.withColumn("bbox", F.struct(F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(550.0).alias("x1"), (y + 10).alias("y1")))


def document_blocks(spark, d):
    """Documents as blocks, a line each: the first line of every fourth document is set larger."""
    lines = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("block_index", "text")).where("trim(text) <> ''")
    size = F.when((F.col("block_index") == 0) & (F.col("document_id").cast("long") % 4 == 0), 16.0).when(F.col("block_index") % 9 == 5, 13.5).otherwise(10.0)
    y = F.col("block_index") * 12.0
    return lines.select(
        "document_id", F.floor(F.col("block_index") / 12).cast("int").alias("page"), "block_index", "text", F.struct(F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(550.0).alias("x1"), (y + 10).alias("y1")).alias("bbox"),
        size.alias("max_font_size"), size.alias("avg_font_size"), F.lit(False).alias("is_bold"),
    )


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _put_back(column: str) -> str:
    for entity, char in _ENTITIES:
        column = f"replace({column}, '{entity}', {quoted(char)})"
    return column


@register(
    f"""WITH c AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, {quoted(HTML_HIDDEN)}, ' ', 'g'), {quoted(HTML_BLOCK)}, chr(30) || '<\\1\\2>', 'g'), chr(30)) AS p FROM pages),
    b AS (SELECT page_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS i FROM c),
    t AS (SELECT *, lower(regexp_extract(raw, '(?i)^<([a-z0-9]+)', 1)) AS tag, trim(regexp_replace({_put_back("regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g')")}, '[\\s\\x0b]+', ' ', 'g'), {TRIM}) AS text FROM b)
    SELECT page_id::VARCHAR AS document_id, i::BIGINT AS block_index, tag, text, CASE WHEN tag = 'title' THEN 24::DOUBLE WHEN regexp_matches(tag, '^h[1-6]$') THEN 22::DOUBLE - 2::DOUBLE * CAST(substr(tag, 2, 1) AS DOUBLE) ELSE 10::DOUBLE END AS max_font_size,
    regexp_matches(tag, '^(h[1-6]|title)$') AS is_bold FROM t WHERE text <> ''"""
)
def html_blocks_to_text(spark, d):
    return blocks(spark, d).select("document_id", F.col("block_index").cast("bigint").alias("block_index"), "tag", "text", "max_font_size", "is_bold")


_LINES = """l AS (SELECT doc_id, i - 1 AS b, line FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(line, ' ') <> ''),
  z AS (SELECT *, CASE WHEN b = 0 AND doc_id % 4 = 0 THEN 16::DOUBLE WHEN b % 9 = 5 THEN 13.5::DOUBLE ELSE 10::DOUBLE END AS size, len(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) AS words FROM l),
  n AS (SELECT doc_id, size, count(*) AS n, min(b) AS b0 FROM z GROUP BY ALL), body AS (SELECT doc_id, arg_max(size, (n, -b0)) AS body FROM n GROUP BY 1),
  k AS (SELECT z.*, size / body AS ratio, CASE WHEN regexp_matches(trim(line), '^\\s*(([-•*–]|[0-9]+[.)]|[a-zA-Z][.)])\\s+)') THEN 'list_item' WHEN regexp_matches(trim(line), '(?i)^\\s*(chapter|الفصل|فصل)\\s+\\S+') AND words <= 20 THEN 'chapter'
    WHEN NOT (size / body >= 1.15::DOUBLE AND words <= 20) THEN 'paragraph' WHEN size / body >= 1.8::DOUBLE THEN 'title' WHEN size / body >= 1.5::DOUBLE THEN 'chapter' WHEN size / body >= 1.3::DOUBLE THEN 'section' ELSE 'subsection' END AS level FROM z JOIN body USING (doc_id))"""


@register(f"WITH {_LINES} SELECT doc_id::VARCHAR AS document_id, b::BIGINT AS block_index, level FROM k")
def block_levels(spark, d):
    return parsing.classify_blocks(document_blocks(spark, d)).select("document_id", F.col("block_index").cast("bigint").alias("block_index"), "level")


@register(
    f"""WITH {_LINES}, o AS (SELECT doc_id, b, level, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS node, CASE level WHEN 'title' THEN 0 WHEN 'chapter' THEN 1 WHEN 'section' THEN 2 WHEN 'subsection' THEN 3 WHEN 'heading' THEN 4 ELSE 5 END AS rank FROM k)
    SELECT x.doc_id::VARCHAR AS document_id, x.node AS node_id, max(y.node) AS parent_id, x.rank AS rank FROM o x LEFT JOIN o y ON y.doc_id = x.doc_id AND y.node < x.node AND y.rank < x.rank AND y.rank < 5 GROUP BY x.doc_id, x.node, x.rank"""
)
def hierarchy_tree(spark, d):
    h = parsing.hierarchy(parsing.classify_blocks(document_blocks(spark, d)))
    return h.select("document_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("parent_id").cast("bigint").alias("parent_id"), "rank")


@register(
    f"""WITH {_LINES}, c AS (SELECT *, count(*) FILTER (level = 'chapter') OVER w AS c, count(*) FILTER (level IN ('chapter', 'section')) OVER w AS s FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY b))
    SELECT doc_id::VARCHAR AS document_id, b::BIGINT AS block_index, md5(last_value(CASE WHEN level = 'chapter' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY b)) AS chapter,
    md5(last_value(CASE WHEN level = 'section' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id, c ORDER BY b)) AS section, md5(last_value(CASE WHEN level = 'subsection' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id, s ORDER BY b)) AS subsection FROM c"""
)
def heading_context(spark, d):
    c = parsing.contexts(parsing.classify_blocks(document_blocks(spark, d)))
    return c.select("document_id", F.col("block_index").cast("bigint").alias("block_index"), *(F.md5(F.col(x).cast("binary")).alias(x) for x in ("chapter", "section", "subsection")))


_HEADS = "('title', 'chapter', 'section', 'subsection', 'heading')"


@register(
    f"""WITH RECURSIVE {_LINES}, c AS (SELECT *, count(*) FILTER (level = 'chapter') OVER w AS c, count(*) FILTER (level IN ('chapter', 'section')) OVER w AS s, row_number() OVER w AS j, level IN {_HEADS} AS head FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY b)),
    x AS (SELECT *, last_value(CASE WHEN level = 'chapter' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY b) AS chapter, last_value(CASE WHEN level = 'section' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id, c ORDER BY b) AS section FROM c),
    f AS (SELECT doc_id, 0::BIGINT AS j, 0::BIGINT AS held, 0::BIGINT AS par, -1::BIGINT AS chunk, true AS fresh, 0::BIGINT AS own FROM (SELECT DISTINCT doc_id FROM x)
      UNION ALL SELECT f.doc_id, f.j + 1, CASE WHEN NOT head AND now * 1.3::DOUBLE >= 300 THEN 0 ELSE now END, f.par + CASE WHEN head THEN 0 ELSE 1 END, f.chunk + CASE WHEN f.fresh OR ends THEN 1 ELSE 0 END, NOT head AND now * 1.3::DOUBLE >= 300, f.par
      FROM f JOIN x ON x.doc_id = f.doc_id AND x.j = f.j + 1, LATERAL (SELECT NOT f.fresh AND head AND floor(f.held * 1.3::DOUBLE) >= 150 AS ends), LATERAL (SELECT words + CASE WHEN ends THEN 0 ELSE f.held END AS now)),
    r AS (SELECT x.*, f.chunk, f.own, x.b // 12 AS page, lead(f.chunk) OVER (PARTITION BY x.doc_id ORDER BY x.j) AS next_chunk, lead(head) OVER (PARTITION BY x.doc_id ORDER BY x.j) AS next_head, lead(chapter) OVER (PARTITION BY x.doc_id ORDER BY x.j) AS nc, lead(section) OVER (PARTITION BY x.doc_id ORDER BY x.j) AS ns, f.fresh AS closed FROM x JOIN f ON f.doc_id = x.doc_id AND f.j = x.j),
    raw AS (SELECT doc_id, chunk, arg_min(page, j) AS page, arg_min(own, j) AS paragraph_index, CASE WHEN count(DISTINCT level) = 1 THEN min(level) ELSE 'mixed' END AS chunk_type, sum(words) AS words, bool_or(closed) AS closed, max(j) AS last,
      arg_max(CASE WHEN next_chunk IS NOT NULL AND NOT closed THEN nc ELSE chapter END, j) AS chapter0, arg_max({{'v': CASE WHEN next_chunk IS NOT NULL AND NOT closed THEN nc ELSE chapter END}}, j) AS ch, arg_max({{'v': CASE WHEN next_chunk IS NOT NULL AND NOT closed THEN ns ELSE section END}}, j) AS se FROM r GROUP BY doc_id, chunk),
    g AS (SELECT doc_id, -1::BIGINT AS chunk, -1::BIGINT AS page, -1::BIGINT AS ord FROM (SELECT DISTINCT doc_id FROM raw)
      UNION ALL SELECT g.doc_id, g.chunk + 1, CASE WHEN joins THEN g.page ELSE raw.page END, g.ord + CASE WHEN joins THEN 0 ELSE 1 END
      FROM g JOIN raw ON raw.doc_id = g.doc_id AND raw.chunk = g.chunk + 1, LATERAL (SELECT g.ord >= 0 AND floor(raw.words * 1.3::DOUBLE) < 60 AND g.page = raw.page AS joins)),
    m AS (SELECT raw.doc_id, g.ord, arg_min(raw.page, raw.chunk) AS page, arg_min(ch, raw.chunk).v AS chapter, arg_min(se, raw.chunk).v AS section, arg_min(chunk_type, raw.chunk) AS chunk_type, sum(words) AS word_count, arg_min(paragraph_index, raw.chunk) AS paragraph_index FROM raw JOIN g ON g.doc_id = raw.doc_id AND g.chunk = raw.chunk GROUP BY raw.doc_id, g.ord)
    SELECT doc_id::VARCHAR AS document_id, ord::BIGINT AS ord, page::BIGINT AS page, md5(chapter) AS chapter, md5(section) AS section, chunk_type, word_count::BIGINT AS word_count, paragraph_index::BIGINT AS paragraph_index,
    CASE WHEN ord > 0 THEN doc_id || '-' || (ord - 1) END AS previous_chunk_id, CASE WHEN ord < max(ord) OVER (PARTITION BY doc_id) THEN doc_id || '-' || (ord + 1) END AS next_chunk_id FROM m"""
)
def semantic_chunks(spark, d):
    """The chunker over each document's lines."""
    c = parsing.chunk_blocks(parsing.classify_blocks(document_blocks(spark, d)))
    numbers = [F.col(x).cast("bigint").alias(x) for x in ("ord", "page", "word_count", "paragraph_index")]
    return c.select("document_id", *numbers, *(F.md5(F.col(x).cast("binary")).alias(x) for x in ("chapter", "section")), "chunk_type", "previous_chunk_id", "next_chunk_id")


@register(
    """WITH b AS (SELECT page_id, w.i AS i, CASE WHEN (page_id * 31 + w.i * 17) % 5 = 0 THEN 40 ELSE 320 * ((page_id + w.i) % 2) + 20 END::DOUBLE AS x0, (page_id * 13 + w.i * 7) % 700::DOUBLE AS y0, CASE WHEN (page_id * 31 + w.i * 17) % 5 = 0 THEN 500 ELSE 250 END::DOUBLE AS width FROM pages, range(9) w(i)),
    c AS (SELECT *, x0 + width <= 330 AS l, x0 + width > 330 AND x0 >= 270 AS r FROM b), n AS (SELECT *, count(*) FILTER (l) OVER p AS nl, count(*) FILTER (r) OVER p AS nr, count(*) OVER p AS nn FROM c WINDOW p AS (PARTITION BY page_id)),
    t AS (SELECT *, nl >= 2 AND nr >= 2 AND nn - nl - nr <= greatest(2, nn // 4) AS two FROM n), k AS (SELECT *, CASE WHEN two AND x0 >= 270 THEN 1 ELSE 0 END AS col FROM t)
    SELECT page_id::VARCHAR AS document_id, i AS block_index, two AS is_two_column, col AS "column", row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN two THEN col ELSE 0 END, CASE WHEN two THEN y0 ELSE 0 END, CASE WHEN two THEN x0 ELSE 0 END, i) AS reading_order FROM k"""
)
def column_detection(spark, d):
    p = table(spark, d, "pages").select("page_id")
    b = p.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("i"))
    wide = (F.col("page_id") * 31 + F.col("i") * 17) % 5 == 0
    x0 = F.when(wide, 40).otherwise(320 * ((F.col("page_id") + F.col("i")) % 2) + 20).cast("double")
    y0 = ((F.col("page_id") * 13 + F.col("i") * 7) % 700).cast("double")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.when(wide, 500).otherwise(250)).alias("x1"), (y0 + 10).alias("y1"))
    b = b.select(F.col("page_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.col("i").alias("block_index"), box.alias("bbox"))
    geometry = p.select(F.col("page_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.lit(600.0).alias("width"))
    out = parsing.two_columns(b, geometry)
    return out.select("document_id", "block_index", "is_two_column", "column", F.col("reading_order").cast("bigint").alias("reading_order"))


@register(
    """WITH w AS (SELECT page_id, i, (page_id * 13 + i * 7) % 700::DOUBLE AS y0, CASE (page_id + i) % 6 WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN 'xii' WHEN 2 THEN '-4-' WHEN 3 THEN '12345' ELSE 'word' END AS word FROM pages, range(9) t(i)),
    s AS (SELECT page_id, arg_min(word, i) AS seen FROM w WHERE (y0 < 70 OR y0 > 630) AND regexp_matches(regexp_replace(word, '^[.-]+|[.-]+$', '', 'g'), '^([0-9]{1,4}|[ivxlcdmIVXLCDM]{1,7}|[a-zA-Z])$') GROUP BY 1)
    SELECT page_id::VARCHAR AS document_id, coalesce(CASE WHEN page_id % 5 = 0 THEN 'C' || page_id END, seen) AS page_label FROM pages LEFT JOIN s USING (page_id)"""
)
def page_labels(spark, d):
    """The catalogue's label, else a word at the edge of a page that looks like one."""
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("document_id"), F.lit(1).alias("page"))
    words = p.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("word_index"))
    kind = (F.col("page_id") + F.col("word_index")) % 6
    word = F.when(kind == 0, F.col("page_id").cast("string")).when(kind == 1, "xii").when(kind == 2, "-4-").when(kind == 3, "12345").otherwise("word")
    words = words.withColumns({"word": word, "y0": ((F.col("page_id") * 13 + F.col("word_index") * 7) % 700).cast("double")})
    geometry = p.withColumns({"height": F.lit(700.0), "catalog_label": F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("C"), F.col("page_id").cast("string")))})
    return parsing.page_labels(words, geometry).select("document_id", "page_label")


@register(
    """WITH b AS (SELECT page_id, i, (page_id * 13 + i * 7) % 700 + 5::DOUBLE AS mid, 'block ' || i AS text FROM pages, range(9) t(i)), m AS (SELECT page_id, j, (page_id * 29 + j * 311) % 700 + 20::DOUBLE AS mid FROM pages, range(2) t(j))
    SELECT m.page_id::VARCHAR AS document_id, m.j AS image_index, arg_min(b.text, (abs(m.mid - b.mid), b.i)) AS nearby_text FROM m JOIN b USING (page_id) GROUP BY ALL"""
)
def nearest_blocks(spark, d):
    """The block beside each of two images of a page."""
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("document_id"), F.lit(1).alias("page"))
    box = lambda y, h: F.struct(F.lit(0.0).alias("x0"), y.cast("double").alias("y0"), F.lit(9.0).alias("x1"), (y + h).cast("double").alias("y1"))
    b = p.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("block_index"))
    b = b.withColumns({"text": F.concat(F.lit("block "), F.col("block_index").cast("string")), "bbox": box((F.col("page_id") * 13 + F.col("block_index") * 7) % 700, 10)})
    m = p.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("image_index"))
    m = m.withColumn("bbox", box((F.col("page_id") * 29 + F.col("image_index") * 311) % 700, 40))
    return parsing.nearest_blocks(m, b).select("document_id", "image_index", "nearby_text")


@register(
    """WITH l AS (SELECT doc_id, i - 1 AS line, w FROM (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
    s AS (SELECT doc_id, line, unnest(p) AS word, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, line, string_split(w, ' ') AS p FROM l)),
    z AS (SELECT *, 8 + length(word) % 5::DOUBLE AS size, CAST(length(word) % 7 = 0 AS INTEGER) + CAST(length(word) % 11 = 3 AS INTEGER) AS votes FROM s),
    n AS (SELECT doc_id, line, string_agg(word || ' ', '' ORDER BY k) AS text, max(size) FILTER (trim(word) <> '') AS most, sum(size) FILTER (trim(word) <> '') AS total, count(*) FILTER (trim(word) <> '') AS n, coalesce(sum(votes) FILTER (trim(word) <> ''), 0) AS votes FROM z GROUP BY 1, 2),
    b AS (SELECT doc_id, line // 3 AS block, trim(string_agg(text, chr(10) ORDER BY line) FILTER (trim(text) <> ''), ' ' || chr(10)) AS text, max(most) AS most, sum(total) / nullif(sum(n), 0) AS avg, sum(n) AS n, sum(votes) AS votes FROM n GROUP BY 1, 2)
    SELECT doc_id::VARCHAR AS document_id, block::BIGINT AS block_index, md5(text) AS text, most AS max_font_size, round(avg, 6) AS avg_font_size, n > 0 AND votes >= greatest(1, n // 2) AS is_bold FROM b WHERE text <> ''"""
)
def font_statistics(spark, d):
    """Each word of a document as a span, its size and weight by its length; three lines to a block."""
    lines = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("line", "w"))
    words = lines.select("document_id", "line", F.posexplode(F.split("w", " ", -1)).alias("span_index", "word"))
    n = F.length("word")
    spans = words.select(
        "document_id", F.lit(1).alias("page"), F.floor(F.col("line") / 3).alias("block_index"), (F.col("line") % 3).alias("line_index"), "span_index", F.concat("word", F.lit(" ")).alias("text"), (8 + n % 5).cast("double").alias("size"),
        F.when(n % 7 == 0, 16).otherwise(0).alias("flags"), F.when(n % 11 == 3, "Face-Heavy").otherwise("Face").alias("font"),
    )
    out = layout.span_blocks(spans)
    return out.select("document_id", "block_index", F.md5(F.col("text").cast("binary")).alias("text"), "max_font_size", F.round("avg_font_size", 6).alias("avg_font_size"), "is_bold")

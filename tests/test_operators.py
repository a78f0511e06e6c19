import random

from pyspark.sql import functions as F

from lectern.catalog import answers
from lectern.operators import context, grounding, parsing, retrieval, scope


def test_scenarios(spark):
    got = {(r.answer_id, r.line_index, r.claim_index): r for r in answers.scenario_verdicts(spark).collect()}
    assert got["d0", 0, 0].repaired == "The system uses FastAPI, PostgreSQL, and Redis." and got["d0", 0, 0].status == "PARTIALLY_SUPPORTED"
    assert got["d1", 0, 0].status == "SUPPORTED" and got["d1", 0, 0].score == 0.8
    assert got["d1", 0, 1].status == "PARTIALLY_SUPPORTED" and got["d2", 0, 0].status == "UNCERTAIN" and got["d2", 0, 1].status == "SUPPORTED"
    assert got["d3", 0, 0].status == "UNCERTAIN" and got["d3", 0, 1].status == "SUPPORTED"


def test_repair(spark):
    kind = "array<struct<pos:int,label:string,page:int,id:bigint,text:string>>"
    page = lambda n: [(0, str(n), n, n, "e")]
    rows = [
        ("a", 0, 0, "One holds.", "factual", "SUPPORTED", [], None, page(4)), ("a", 0, 1, "Two fails.", "factual", "UNSUPPORTED", [], None, page(4)), ("a", 2, 0, "It has x, y, and z [p. 9].", "factual", "PARTIALLY_SUPPORTED", ["9"], "It has x and y.", page(9)),
        ("a", 3, 0, "Hope this helps.", "conversational", "NOT_FACTUAL", [], None, []), ("b", 0, 0, "Nothing is so.", "factual", "UNCERTAIN", [], None, []), ("c", 0, 0, "لا شيء هنا.", "factual", "UNSUPPORTED", [], None, []),
    ]
    v = spark.createDataFrame(rows, f"answer_id string, line_index int, claim_index int, text string, kind string, status string, cited array<string>, repaired string, evidence {kind}")
    v = v.withColumn("supporting", F.lit(None).cast("array<string>"))
    drafts = spark.createDataFrame([("a", "One holds. Two fails.\n\nIt has x, y, and z [p. 9].\nHope this helps."), ("b", "Nothing is so."), ("c", "لا شيء هنا.")], "answer_id string, draft string")
    got = {r.answer_id: r.grounded_answer for r in grounding.repair(drafts, v).collect()}
    assert got["a"] == "One holds. [p. 4]\n\nIt has x and y. [p. 9]\nHope this helps."
    assert got["b"] == "I couldn't find that in this document." and got["c"] == "لم أجد ذلك في هذا المستند."


def test_scores(spark):
    rows = [("a", "SUPPORTED", "It always works.", "3"), ("a", "UNSUPPORTED", "It flies.", ""), ("a", "PARTIALLY_SUPPORTED", "It may float.", "9"), ("b", "NOT_FACTUAL", "Hope this helps.", ""), ("c", "SUPPORTED", "Ten of 12.", "4"), ("c", "UNCERTAIN", "Never.", "4"), ("d", "UNSUPPORTED", "No.", "1")]
    rows = [(a, 0, i, t, "conversational" if k == "NOT_FACTUAL" else "factual", k, [c] if c else []) for i, (a, k, t, c) in enumerate(rows)]
    v = spark.createDataFrame(rows, "answer_id string, line_index int, claim_index int, text string, kind string, status string, cited array<string>")
    empty = "array<struct<pos:int,label:string,page:int,id:bigint,text:string>>"
    v = v.withColumns({"repaired": F.lit(None).cast("string"), "evidence": F.from_json(F.lit("[]"), empty), "supporting": F.lit(None).cast("array<string>")})
    own = v.groupBy("answer_id").agg(F.lit(0.8).alias("retrieval_score"))
    shown = v.groupBy("answer_id").agg(F.array_join(F.collect_list("text"), " ").alias("grounded_answer"))
    labels = own.select("answer_id", F.explode(F.array(F.lit("3"), F.lit("4"))).alias("label"))
    got = {r.answer_id: tuple(r)[2:] for r in grounding.scores(own, v, shown, labels).collect()}
    assert got["a"] == (0.625, 0.5, 0.6375) and got["b"] == (1.0, 1.0, 0.95)
    assert got["c"] == (0.3333, 1.0, 0.6167) and got["d"] == (0.0, 1.0, 0.45)


def budget_model(chunks, budget, short):
    own = [n for n, _ in chunks]
    now = list(own)
    for i in range(len(now) - 1, -1, -1):
        if sum(now) <= budget:
            break
        now[i] = short[i]
    while now and sum(now) > budget:
        now.pop()
    return len(now)


def test_budget_fold(spark):
    rng = random.Random(3)
    rows = [(q, i, " ".join(rng.choice(["alpha.", "beta", "gamma", "delta."]) for _ in range(rng.randrange(5, 200))), ["alpha"], []) for q in range(12) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "question_id int, place int, text string, keywords array<string>, numbers array<string>")
    got = context.fit_budget(df, 300).collect()
    for q in range(12):
        own = sorted((r for r in got if r.question_id == q), key=lambda r: r.place)
        assert sum(r.tokens for r in own if r.kept) <= 300
        assert [r.kept for r in own] == sorted((r.kept for r in own), reverse=True)
        first = next((r.place for r in own if r.compressed), None)
        assert first is None or all(r.tokens <= 130 or r.place >= first for r in own if r.compressed)


def test_merge_and_dedupe(spark):
    rows = [(1, 0, 5, 50, "e", "5", "4", "A", "s"), (1, 1, 4, 40, "d", "4", "3", "A", "s"), (1, 2, 6, 60, "f", "6", "5", "A", "s"), (1, 3, 7, 70, "g", "7", "6", "B", "s"), (1, 4, 9, 90, "E and more", "9", "8", "B", "s"), (1, 5, 9, 90, "x", "9", "8", "B", "s")]
    df = spark.createDataFrame(rows, "question_id int, pos int, ord int, id long, text string, local_id string, previous_chunk_id string, chapter string, section string").withColumn("page", F.col("ord"))
    merged = {r.id: r.text for r in context.merge_adjacent(df.where("pos < 4")).collect()}
    assert merged == {50: "e\n\nf", 40: "d", 70: "g"}
    assert sorted(r.pos for r in context.dedupe(df).collect()) == [0, 1, 2, 3, 5]


def test_chunker_model(spark):
    words = lambda n: " ".join(["w"] * n)
    blocks = [(words(120), 10.0), ("Heading one", 13.5), (words(100), 10.0), (words(200), 10.0), ("Heading two", 13.5), (words(20), 10.0)]
    rows = [("d", 1, i, t, (0.0, i * 1.0, 1.0, i + 1.0), s, s, False) for i, (t, s) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "document_id string, page int, block_index int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, max_font_size double, avg_font_size double, is_bold boolean")
    got = parsing.chunk_blocks(parsing.classify_blocks(df)).orderBy("ord").collect()
    assert [(r.word_count, r.section, r.paragraph_index, r.chunk_type) for r in got] == [(120, "Heading one", 0, "paragraph"), (302 + 22, "Heading one", 1, "mixed")]
    assert got[0].next_chunk_id == got[1].local_id and got[1].previous_chunk_id == got[0].local_id
    tree = {r.node_id: (r.parent_id, r.level) for r in parsing.hierarchy(parsing.classify_blocks(df)).collect()}
    assert tree[1] == (None, "paragraph") and tree[2] == (None, "section") and tree[3] == (2, "paragraph") and tree[6] == (5, "paragraph")


def test_fusion(spark):
    sem = spark.createDataFrame([(1, 10, 0, 0.9, 1), (1, 11, 1, 0.8, 2)], "question_id int, id long, ord int, semantic_score double, rank int")
    kw = spark.createDataFrame([(1, 11, 1, 1.0, 1), (1, 12, 2, 0.5, 2)], "question_id int, id long, ord int, keyword_score double, rank int")
    got = {r.id: (r.semantic_score, r.keyword_score, round(r.rrf, 6)) for r in retrieval.fuse(sem, kw).collect()}
    assert got == {10: (0.9, 0.0, round(1 / 61, 6)), 11: (0.8, 1.0, round(1 / 62 + 1 / 61, 6)), 12: (0.0, 0.5, round(1 / 62, 6))}


def test_a_run_needs_a_section(spark):
    rows = [(1, 0, None, "S"), (1, 1, None, "S"), (1, 2, "C", ""), (1, 3, "C", ""), (1, 4, "C", None), (1, 5, "C", "T"), (1, 6, "C", "T"), (1, 7, "D", "T")]
    df = spark.createDataFrame(rows, "chat_id int, ord int, chapter string, section string").withColumns({"page": F.lit(1), "paragraph_index": F.lit(0)})
    assert [r.run for r in scope.section_runs(df).orderBy("ord").collect()] == [1, 1, 2, 3, 4, 5, 5, 6]


def test_chunker_without_text(spark):
    kind = "document_id string, page int, block_index int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, max_font_size double, avg_font_size double, is_bold boolean"
    df = spark.createDataFrame([("a", 1, 0, " ", None, 10.0, 10.0, False), ("b", 1, 0, None, None, 10.0, 10.0, False), ("b", 1, 1, "word", None, 10.0, 10.0, False)], kind)
    got = parsing.chunk_blocks(parsing.classify_blocks(df)).collect()
    assert [(r.document_id, r.text) for r in got] == [("b", "word")]
    assert parsing.chunk_blocks(parsing.classify_blocks(df.limit(0))).count() == 0


def test_window_by_depth(spark):
    df = spark.createDataFrame([(1, 1, 5, "explain"), (2, 1, 5, "specific")], "question_id int, chat_id int, ord int, depth string")
    chunks = spark.range(10).select(F.lit(1).alias("chat_id"), F.col("id").cast("int").alias("ord"), "id")
    got = sorted((r.question_id, r.ord) for r in retrieval.neighbours(df, chunks, retrieval.window_of(F.col("depth"))).collect())
    assert got == [(1, 4), (1, 5), (1, 6), (2, 5)]

from pyspark.sql import functions as F

from lectern.functions import claims, query, text


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_languages(spark):
    rows = [("hello", "en"), ("مرحبا", "ar"), ("مرحبا hello", "mixed"), ("123 !", None), ("", None), (None, None), ("a" * 86 + "م" * 14, "en"), ("a" * 85 + "م" * 15, "mixed")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", text.language(F.col("t")).alias("x"))
    assert [r.x for r in df.orderBy("i").collect()] == [x for _, x in rows]


def test_clean_and_sentences(spark):
    t = "  a\t b \n***\n\n\n\nsame\nsame\n\nsame\n_-_\nend. "
    got = spark.createDataFrame([(t,)], "t string").select(text.clean(F.col("t")).alias("c"), text.sentences(F.lit("One. Two!  Three؟ four")).alias("s")).first()
    assert got.c == "a b\n\nsame\n\nsame\nend." and got.s == ["One.", "Two!", "Three؟", "four"]


def test_compression_keeps_the_best_in_order(spark):
    t = "Alpha beta gamma delta. Nothing here at all. Recall is 92 percent today. Filler words again."
    c = text.compressed(F.lit(t), F.lit(8), text.literals(["recall", "beta"]), text.literals(["92"]))
    assert one(spark, c) == "Recall is 92 percent today."
    assert one(spark, text.compressed(F.lit(t), F.lit(99), text.literals(["x"]), text.literals(["y"]))) == t


def test_fixed_chunks(spark):
    assert one(spark, text.fixed_chunks(F.lit("aa bb cc"), 6)) == ["aa bb", "cc"]
    assert one(spark, text.fixed_chunks(F.lit("x" * 20 + " b"), 6))[0] == ""
    assert one(spark, text.fixed_chunks(F.lit(" "), 6)) == []


def test_labels_tables_dates(spark):
    df = spark.createDataFrame([("12",), ("xiv",), ("-7-",), ("أ",), ("z",), ("12345",), ("word",), ("",)], "t string")
    assert [r.x for r in df.select(text.page_label(F.col("t")).alias("x")).collect()] == [True, True, True, True, True, False, False, False]
    rows = spark.createDataFrame([([["a", "b\nc"], ["1"], ["2", "3", "4"]],), ([["", None]],), ([],)], "r array<array<string>>")
    got = [r.x for r in rows.select(text.markdown_table(F.col("r")).alias("x")).collect()]
    assert got == ["| a | b c |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |", None, None]
    dates = spark.createDataFrame([("D:20240131235959+01'00'",), ("yesterday",), (None,)], "t string")
    assert [r.x for r in dates.select(text.pdf_date(F.col("t")).alias("x")).collect()] == ["2024-01-31T23:59:59+00:00", "yesterday", None]


def test_arabic_questions(spark):
    rows = [("اشرح الفصل الثاني", "chapter_query", "2", "explanation"), ("لخص هذا الكتاب", "document_query", "", "summary"), ("صفحة ٣", "page_range", "", "page_request"), ("قارن الفصل 2 و الفصل 5", "multi_chapter_query", "2,5", "comparison")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, question string")
    got = query.understand(df).orderBy("i").collect()
    assert [(r.scope.query_type, ",".join(r.scope.chapters), r.intent) for r in got] == [r[1:] for r in rows]
    assert got[2].scope.page_from == 3 and got[2].page_references == [3]


def test_claim_features(spark):
    assert one(spark, claims.numeric_tokens(F.lit("3.5 % in 1999, then 42 and 42"))) == ["3.5 %", "3.5", "1999", "42"]
    assert one(spark, claims.missing_numbers(text.literals(["12", "77"]), F.lit("in 2 012"))) == ["77"]
    assert one(spark, claims.derived(F.lit(50.0), F.lit("20 boys, 30 girls in 1999"))) and not one(spark, claims.derived(F.lit(51.0), F.lit("20 boys, 30 girls")))
    assert one(spark, claims.hedged(F.lit("100"), F.lit("approximately 100 users"))) and not one(spark, claims.hedged(F.lit("100"), F.lit("exactly 100")))
    assert one(spark, claims.has_negation(F.lit("Node runs"))) and not one(spark, claims.has_negation(F.lit("Node runs"), strict=True))
    v = one(spark, claims.verdict(F.lit('```json\n{"status":"supported","score":"1.7","reason":" ok ","supporting_pages":3}\n```')))
    assert (v.status, v.score, v.reason, v.pages) == ("SUPPORTED", 1.0, "ok", ["3"])
    assert one(spark, claims.verdict(F.lit("no json"))) is None and one(spark, claims.verdict(F.lit('{"status":"MAYBE"}'))) is None
    v = one(spark, claims.verdict(F.lit('x {"status":"UNCERTAIN","score":0.5,"supporting_pages":["1"," ",2]} y')))
    assert (v.status, v.pages) == ("UNCERTAIN", ["1", "2"])

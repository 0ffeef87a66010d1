from pyspark.sql import functions as F

from tessera.functions import jsonx


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")


def test_strict_json(spark):
    raws = ['```json\n{"a":1}\n```', '{"a":1} y {"b":2}', "none", None, "{bad}", '{"a":1,"a":2}', "[1] {\"a\": {\"b\": 1}} x"]
    got = [r[0] for r in rows(spark, raws).orderBy("i").select(jsonx.extract_json(F.col("raw"))).collect()]
    assert got == ['{"a": 1}', None, None, None, None, '{"a": 2}', '{"a": {"b": 1}}']


def test_judgement(spark):
    long = "画面中可以看到一个清晰的二维码"
    raws = [
        f'{{"label":"相关","analysis":"{long}","confidence":0.93}}',
        f'{{"label":"不相关","analysis":"{long}","confidence":0.95}}',
        f'{{"label":"相关","analysis":"{long}"}}',
        '{"label":"相关","analysis":"太短太短太短太短太","confidence":1}',
        f'{{"label":"可能","analysis":"{long}"}}',
        f'{{"label":"相关","analysis":"{long}","confidence":"0.9"}}',
        f'{{"label":"相关","analysis":"{long}","confidence":"high"}}',
    ]
    got = rows(spark, raws).orderBy("i").select(jsonx.parse_judgement(jsonx.extract_json(F.col("raw"))).alias("p")).select("p.*").collect()
    assert [r["teacher_score"] for r in got] == [0.93, 0.05, 0.5, None, None, 0.9, None]
    assert [r["reason"] for r in got] == [None, None, None, "analysis", "label", None, "confidence"]


def test_candidates(spark):
    rel = lambda n: "[" + ",".join(f'{{"id":"R{k}","evidence":"e"}}' for k in range(n)) + "]"
    raws = [f'{{"relevant":{rel(n)},"irrelevant":{rel(3)}}}' for n in (0, 2, 4)] + ['{"relevant":[{"x":1}],"irrelevant":[]}', '{"relevant":1,"irrelevant":[]}', "x"]
    got = rows(spark, raws).orderBy("i").select(jsonx.parse_candidates(jsonx.extract_json(F.col("raw"))).alias("p")).select("p.*").collect()
    assert [r["reason"] is None for r in got] == [False, True, False, False, False, False]
    assert len(got[1]["candidates"]) == 5 and [c["reason_text"] for c in got[1]["candidates"]] == ["e", "e", "", "", ""]


def test_table_functions(spark):
    from pyspark.sql import functions as F

    from tessera.functions import jsonx, table_functions

    table_functions.register(spark)
    answers = [
        'so: {"relevant": [{"id": "R1", "evidence": "e"}], "irrelevant": [{"id": 2}, {"id": "R3", "evidence": null}]} end',
        '{"relevant": [], "irrelevant": []}',
        '{"relevant": [{"id": "a"}, {"id": "b"}, {"id": "c"}, {"id": "d"}], "irrelevant": []}',
        '{"relevant": [{"evidence": "e"}], "irrelevant": []}',
        '{"relevant": [{"id": "R1"}]}',
        "[1]",
        "{broken}",
        "",
        None,
    ]
    spark.createDataFrame(list(enumerate(answers)), "k int, raw string").createOrReplaceTempView("a")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM explode_candidates(TABLE(a))").collect())
    parsed = spark.table("a").select("k", jsonx.parse_candidates(jsonx.extract_json(F.col("raw"))).alias("p"))
    want = sorted(tuple(r) for r in parsed.filter("p.reason is null").select("k", F.inline("p.candidates")).collect())
    assert got == want and len(got) == 3
    spark.createDataFrame([("x", 2, "b - c"), ("x", 1, '1. "a"\n\n'), ("y", 1, None)], "g string, o int, raw string").createOrReplaceTempView("t")
    rows = spark.sql("SELECT g, o, line_no, line FROM explode_lines(TABLE(t) PARTITION BY g ORDER BY o)").collect()
    assert sorted(tuple(r) for r in rows) == [("x", 1, 0, "a"), ("x", 2, 1, "b"), ("x", 2, 2, "c")]
    spark.sql("SELECT g AS line, raw FROM t").createOrReplaceTempView("u")
    for bad in ("TABLE(SELECT 1 AS k)", "TABLE(u)"):
        try:
            spark.sql(f"SELECT * FROM explode_lines({bad})").collect()
        except Exception as e:
            assert "column" in str(e)
        else:
            raise AssertionError(bad)

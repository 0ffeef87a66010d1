from pyspark.sql import functions as F

from tessera.functions import text


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col).first()[0]


def test_clean_text(spark):
    f = lambda s: one(spark, text.clean_text(F.col("t")), t=s)
    assert f("  a　b \n cde ") == "a b cde"
    assert f("abcd") is None and f(None) is None and f("") is None
    assert f("x" * 200) == "x" * 200 and f("x" * 201) is None


def test_parse_lines(spark):
    raw = "1. 红色的狗绳\n- “蓝色T恤”\n\n2个红苹果"
    assert one(spark, text.parse_lines(F.col("t")), t=raw) == ["红色的狗绳", "蓝色T恤", "个红苹果"]
    assert one(spark, text.parse_lines(F.col("t")), t=None) == []


def test_attribute_expressions(spark):
    cap = "一个穿着蓝色T恤的男人在一片绿色的草地上玩一个红色的球"
    assert one(spark, text.attribute_expressions(F.col("t")), t=cap) == ["一个穿着蓝色T恤的男人在一片绿", "一个红色的球"]


def test_valid_expression_profiles(spark):
    v = lambda e, c, p=text.DEFAULT_PROFILE: one(spark, text.valid_expression(F.col("e"), F.col("c"), p), e=e, c=c)
    assert v("红色的球", "一个红色的球") and not v("蓝色的球", "一个红色的球") and not v("球", "球")
    assert not v("他的红球", "他的红球") and v("他的红球", "", text.LEGACY_PROFILE) and not v(None, "x")


def test_replacements(spark):
    got = one(spark, text.replacements(F.col("e"), ((text.COLOURS),)), e="一辆黑色汽车和红色的车")
    assert len(got) == 2 and all(g.startswith("一辆") and g.endswith("汽车和红色的车") and "黑色" not in g for g in got)
    assert one(spark, text.replacements(F.col("e"), text.ACTIONS), e="躺在草地上的狗") == ["站在草地上的狗"]
    assert one(spark, text.replacements(F.col("e"), text.ACTIONS), e="没有") == []


def test_keys(spark):
    import hashlib

    plain = one(spark, text.make_key(F.col("i"), "judge", "v1"), i="a.jpg")
    empty = one(spark, text.make_key(F.col("i"), "judge", "v1", F.lit(""), F.lit(True)), i="a.jpg")
    assert plain == hashlib.sha1(b"a.jpg|judge|v1").hexdigest() and empty == hashlib.sha1(b"a.jpg|judge|v1|").hexdigest()
    assert one(spark, text.make_key(F.col("i"), "judge", "v1"), i=None) == hashlib.sha1(b"|judge|v1").hexdigest()


def test_paths_and_prompts(spark):
    assert one(spark, text.suffix(F.col("p")), p="/a/b.c/X.JPG") == ".jpg" and one(spark, text.suffix(F.col("p")), p="/a.b/noext") == ""
    assert one(spark, text.checkpoint_step(F.col("p")), p="ckpt_step200.pt") == 200 and one(spark, text.checkpoint_step(F.col("p")), p="x.pt") is None
    assert one(spark, text.prompt("rule {rid} {t}!", rid=F.col("a"), t=F.lit(None).cast("string")), a="R1") == "rule R1 !"

import unicodedata

from hypothesis import given, settings, strategies as st

from gridloom.llm.canonical import alike_classes, alike_pairs, canonical, canonical_text, canonical_whole
from pyspark.sql import functions as F


def test_forms():
    assert canonical("Ａｂ　c") == "Ab c" and canonical("é") == "é" and canonical("a​b­") == "ab"
    assert canonical("аеο") == "aeo" and canonical("ＡＢ C") == "AB C"
    assert canonical("é") != canonical("e") and canonical("A") != canonical("a") and canonical("²") == "²" and canonical("a–b") == "a–b"
    assert canonical("ｻﾞ") == "ザ" and canonical("") == "" and canonical("plain") == "plain"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aeó̧̈​ 　Ａа각가̸=<ﾞｶﬁ")), max_size=12))
def test_splicing_equals_whole_and_repeats(text):
    got = canonical(text)
    assert got == canonical_whole(text)
    assert canonical(got) == got
    assert unicodedata.is_normalized("NFC", got)


def test_long_text():
    t = "x" * 100_000 + "é" + "y" * 100_000
    assert canonical(t) == "x" * 100_000 + "é" + "y" * 100_000


def test_pairs(spark):
    rows = [(1, 1, "Rom"), (2, 1, "Rоm"), (3, 1, "Rom"), (4, 2, "Rom"), (5, 1, None), (6, 1, ""), (7, 1, "rom"), (None, 1, "Ro​m"), (8, None, "Rom"), (9, None, "Rоm"), (2, 1, "Rоm")]
    df = spark.createDataFrame(rows, "id long, batch long, name string").withColumn("key_a", F.lit(1)).withColumn("form", F.lit("x"))
    assert sorted(map(tuple, alike_pairs(df, "id", ["batch"], "name").collect())) == [(1, 2), (2, 3)]
    assert alike_pairs(df.where("false"), "id", ["batch"], "name").count() == 0
    got = [r.c for r in df.orderBy(F.col("id").asc_nulls_first()).select(canonical_text(F.col("name")).alias("c")).collect()]
    assert got.count(None) == 1 and got.count("") == 1


def test_classes_count_rows_and_spellings(spark):
    rows = [("a", "Ｒｏｍ")] * 5 + [("a", "Rom")] * 3 + [("a", "Bern"), ("b", "Rom"), ("a", None), ("a", "")]
    got = alike_classes(spark.createDataFrame(rows, "g string, t string"), ["g"], "t").collect()
    assert [(r.g, r.form, r.spellings, r.rows) for r in got] == [("a", "Rom", 2, 8)]
    assert alike_classes(spark.createDataFrame([], "g string, t string"), ["g"], "t").count() == 0

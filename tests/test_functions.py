import random

import pytest
from pyspark.sql import functions as F

from karwan.functions import similarity as S
from karwan.functions import text as T
from karwan.sources import dump


def lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(p[j + 1], q[j]))
        p = q
    return p[-1]


def values(spark, f, rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_normalisation(spark):
    assert values(spark, T.normalize_latin, ["  Ｆｕｌｌ  Cream-", None, "", ".,-_"]) == ["full cream", None, "", ""]
    assert values(spark, T.normalize_arabic, ["أَلبانٍ طـــازجة", "مربى", None]) == ["البان طازجة", "مربي", None]
    assert values(spark, T.raw_tokens, ["Milk 1.5 L حَليب", "", None, "!!"]) == [["milk", "1", "5", "l", "ح", "ليب"], [], [], []]
    assert values(spark, T.slugify, ["Fresh Milk & Co.", "حليب", ""]) == ["fresh_milk_co", "", ""]
    assert values(spark, T.brand_slug, ["Al Nasider", "نودوت الواحة"]) == ["al_nasider", "نودوت الواحة"]
    assert values(spark, T.brand_slug, ["★"])[0].startswith("brand_")
    assert values(spark, T.strip_article, ["الحليب ال الطازج"]) == ["حليب ال طازج"]
    assert values(spark, T.repeat_key, ["  A \n b "]) == ["a b"]


def test_plurals(spark):
    words = spark.createDataFrame([("cookies",), ("boxes",), ("berries",), ("glass",), ("gas",), ("kisses",), ("matches",), (None,)], "token string")
    assert {r.token for r in T.trim_plurals(words).collect()} == {"cooky", "boxe", "berry", "glass", "gas", "kisse", "matche", None}
    known = spark.createDataFrame([("cookie", 5), ("box", 4), ("boxe", 0), ("berry", 9), ("kiss", 7), ("match", 7)], "word string, freq long")
    assert {r.token for r in T.trim_plurals(words, known).collect()} == {"cookie", "box", "berry", "glass", "gas", "kisse", "matche", None}


def test_placeholders(spark):
    typed = ["Please select a brand.", "N/A", "na", "Testament", "test", "LG", "Misc.", "اختر", "بدون", "Not  specified", "not specified", "", None]
    assert values(spark, T.is_placeholder_brand, typed) == [True, True, True, False, True, False, True, True, True, False, True, False, None]
    assert values(spark, T.is_test_category, ["test", "test12", "test a", "latest", None]) == [True, True, False, False, None]


def test_single_edits(spark):
    got = {(r.kind, r.variant) for r in T.single_edits(spark.createDataFrame([("ab",), ("",)], "word string"), "xb").where("word = 'ab'").collect()}
    want = {("deletion", "b"), ("deletion", "a"), ("transposition", "ba")} | {("insertion", v) for v in ("xab", "bab", "axb", "abb", "abx")} | {("substitution", v) for v in ("xb", "bb", "ax")}
    assert got == want


def test_known_ratios(spark):
    pairs = [("milq", "mil", 85.7), ("milq", "milk", 75.0), ("wafers", "wafeer", 83.3), ("breast", "beast", 90.9), ("paste", "pasta", 80.0), ("peas", "pears", 88.9), ("جهينة", "جهينه", 80.0), ("", "", 100.0), ("a", "", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in df.withColumn("got", S.indel_ratio(F.col("a"), F.col("b"))).collect():
        assert abs(r.got - r.want) < 0.06, r
    assert spark.range(1).select(S.indel_ratio(F.lit(None).cast("string"), F.lit("a"))).first()[0] is None
    assert spark.range(1).select(S.token_sort_ratio(F.lit("b  a"), F.lit("a b"))).first()[0] == 100.0


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(90)})
    df = lambda c: spark.createDataFrame([(w,) for w in [*words, words[0], None, ""]], f"{c} string")
    for c in (70, 85):
        want = {(a, b) for a in words for b in words if 200 * lcs(a, b) / (len(a) + len(b)) >= c - 1e-9}
        assert {(r.l, r.r) for r in S.similar_pairs(df("l"), df("r"), c).collect()} == want


def test_deletes_join(spark):
    words = spark.createDataFrame([("milq",), ("x",)], "word string")
    vocabulary = spark.createDataFrame([("milk", 3), ("silk", 1), ("butter", 9), ("milq", 1)], "candidate string, freq long")
    got = {(r.word, r.candidate, r.edits) for r in S.neighbours_by_deletes(words, vocabulary).collect()}
    assert got == {("milq", "milk", 1), ("milq", "silk", 2), ("milq", "milq", 0)}


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(S.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - (1 - 0.5**0.5)) < 1e-9 and got[1] is None


def test_dump_fields_of_any_length(spark, tmp_path):
    big, quoted = "x" * 1_000_000, "it''s, (a) \\'b\\' " * 50_000
    many = ",".join(f"({i},'a{i}')" for i in range(300_000))
    (tmp_path / "dump.sql").write_text(f"CREATE TABLE `t`;\nINSERT INTO `t` VALUES (1,'{big}'),(2,'{quoted}'),(3,NULL);\nINSERT INTO `u` VALUES (9,'z');\nINSERT INTO `t` VALUES {many};\n")
    rows = dump.read_table(spark, str(tmp_path / "dump.sql"), "t", ["id", "name"])
    first = {r.id: r.name for r in rows.where("length(name) > 100 or name is null").collect()}
    assert first == {"1": big, "2": "it's, (a) 'b' " * 50_000, "3": None}
    assert rows.count() == 300_003
    (tmp_path / "bad.sql").write_text("INSERT INTO `t` VALUES (1,'a',2);\n")
    with pytest.raises(Exception, match="another number of fields"):
        dump.read_table(spark, str(tmp_path / "bad.sql"), "t", ["id", "name"]).collect()

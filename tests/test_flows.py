import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from karwan.functions import text as T
from karwan.operators import retrieval
from karwan.plans import phrases
from karwan.sources import dump, files
from karwan.streaming import sessions

START = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, u, START + timedelta(seconds=s) if s is not None else None, t) for i, (u, s, t) in enumerate(rows)], "event_id long, user_id long, ts timestamp, text string")


def test_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_bytes(b"-- x\nINSERT INTO `t` VALUES (1,'a\\'b (c), d\\n',NULL),(2,'',3.5);\nINSERT INTO `tt` VALUES (9,'no',1);\nINSERT INTO `t` VALUES (3,'\\\\n\xff',-1);\n")
    rows = sorted(tuple(r) for r in dump.read_table(spark, str(tmp_path / "d.sql"), "t", ["id", "name", "price"]).collect())
    assert rows == [("1", "a'b (c), d\n", None), ("2", "", "3.5"), ("3", "\\n�", "-1")]
    with pytest.raises(Exception, match="another number of fields"):
        dump.read_table(spark, str(tmp_path / "d.sql"), "t", ["id"]).collect()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "q", b', None), (1, "خط", "x")], "n int, s string, t string")
    files.write_review(df, str(tmp_path / "r"), ["n"])
    assert [tuple(r) for r in files.read_review(spark, str(tmp_path / "r"), df.schema.simpleString()[7:-1].replace(":", " ")).orderBy("n").collect()] == [(1, "خط", "x"), (2, 'a "q", b', None)]
    assert files.write_json(df, str(tmp_path / "j")) == files.digest(df.orderBy("s").repartition(3))
    assert files.digest(df) != files.digest(df.union(df))
    files.gate({"fine": df.limit(0)})
    with pytest.raises(ValueError, match="bad"):
        files.gate({"bad": df})
    files.write_table(df, str(tmp_path / "p"), "n")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert [tuple(r) for r in files.counts({"a": df, "b": df}, {"a": 2, "b": 3}).collect()] == [("b", 2, 3)]


def test_idle_limit_is_strict(spark):
    e = events(spark, [(1, 0, "a"), (1, 2700, "b"), (1, 5401, "c"), (2, 0, "x"), (None, 0, "n"), (3, None, "n")])
    got = {r.event_id: r.session_no for r in sessions.sessionize(e, "user_id", "ts", "event_id").collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 1}
    assert sorted((r.user_id, r.n) for r in sessions.session_windows(e.where("ts is not null"), "user_id", "ts").collect()) == [(1, 1), (1, 2), (2, 1)]


REPEATS = [(1, 0, "Hi"), (1, 5, "hi "), (1, 10, "hi"), (1, 12, "HI"), (1, 30, "hi"), (1, 31, "hi"), (1, 32, "yo"), (1, 33, "hi"), (2, 1, None)]


def test_repeats(spark):
    got = {r.event_id: r.blocked for r in sessions.repeats(events(spark, REPEATS), "user_id", "ts", "event_id", "text").collect()}
    assert [got[i] for i in range(9)] == [False, False, False, True, True, False, False, False, False]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    e = events(spark, REPEATS)
    e.where("event_id < 4").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = sessions.stream_repeats(stream, "user_id", "ts", "text")
    for part in (None, "event_id >= 4"):
        if part:
            e.where(part).coalesce(1).write.mode("append").parquet(src)
        q = out.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("key").agg(F.max("n_messages").alias("n"), F.max("n_blocked").alias("b"))
    assert {tuple(r) for r in got.collect()} == {("1", 8, 2), ("2", 1, 0)}


def test_retrieval(spark):
    rows = spark.createDataFrame([(1, "fresh milk", "S-1", "fresh-milk"), (2, "milk powder milk", "S-2", None), (3, "butter", None, ""), (4, None, "", None), (5, "fresh butter milk", "S-5", None)], "id long, name string, sku string, url_key string")
    index = retrieval.Index.build(rows, ["name"])
    q = spark.createDataFrame([(1, "milk"), (2, "S-2"), (3, "!!"), (4, "milq buttr")], "qid long, q string")
    got = {(r.qid, r.id): r.score for r in retrieval.rank(index, q, rows).collect()}
    assert {k for k in got if k[0] == 1} == {(1, 1), (1, 2), (1, 5)} and got[1, 1] > 2 and got[2, 2] >= 100
    assert {k: v for k, v in got.items() if k[0] == 3} == {(3, i): 0.0 for i in range(1, 6)}  # no word: every candidate
    coded = {(r.qid, r.id): r.score for r in retrieval.rank(index, spark.createDataFrame([(1, "milk"), (2, "milk xS-1x")], "qid long, q string"), rows).collect()}
    assert abs(coded[2, 1] - coded[1, 1] - 100) < 1e-9 and coded[2, 5] == coded[1, 5]  # a code inside the text counts
    fixed = {r.qid: r.corrected for r in retrieval.correct(index, q).collect()}
    assert fixed == {1: None, 2: None, 3: None, 4: None}  # milk is known by three documents, but at 75 it isn't near enough
    assert index.stats.first()["n_docs"] == 5
    page = retrieval.ranked(retrieval.rank(index, q, rows), [F.desc("score")], limit=1, offset=1).where("qid = 1").collect()
    assert len(page) == 1 and page[0].total == 3
    with pytest.raises(ValueError):
        retrieval.hard_filter(rows, between={"id": (3, 1)})
    assert [r.id for r in retrieval.hard_filter(rows, {"sku": "S-1"}, {"id": (None, 2)}).collect()] == [1]


def test_fusion_gate_and_vectors(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid int, id int, r int")
    b = spark.createDataFrame([(1, 11, 1)], "qid int, id int, r int")
    got = {r.id: r.score for r in retrieval.fuse([a, b]).collect()}
    assert abs(got[11] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got[10] - 1 / 61) < 1e-12
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id int, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [-1.0, 0.0])], "qid int, vector array<double>")
    assert {(r.qid, r.id) for r in retrieval.vector_rank(v, q, gate=0.3).collect()} == {(1, 1), (1, 2)}


def test_exact_phrases(spark):
    names = spark.createDataFrame([("milk", "Milk"), ("goat_milk", "Goat Milk"), ("cheese", "Cheese"), ("laban", "حليب طازج"), ("sweet", "الحلوى"), ("meat", "Meat & Poultry"), ("long", "a b c d e f g h")], "slug string, phrase string")
    texts = ["cheese with goat  MILK!", "chese", "milkshake", "حليب طازج كبير", "", None, "cheese milk", "حلوى حليب طازج", "Fresh meat & poultry now", "x a b c d e f g h", "goat, milk", "a milk, milk cheese"]
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, q string")
    got = {r.qid: (r.slug, r.start, r.words, r.rest) for r in phrases.exact_phrases(q, names).collect()}
    assert got == {
        0: ("goat_milk", 12, 2, "cheese with !"), 3: ("laban", 0, 2, " كبير"), 6: ("milk", 7, 1, "cheese "), 7: ("laban", 5, 2, "حلوى "), 8: ("meat", 6, 3, "Fresh  now"), 9: ("long", 2, 8, "x "),
        10: ("milk", 6, 1, "goat, "), 11: ("cheese", 13, 1, "a milk, milk "),
    }


@pytest.fixture(scope="module")
def names(spark):
    texts = ["frozen peas"] * 4 + ["tomato paste"] * 4 + ["juhayna milk"] * 4 + ["full cream cheese"] * 3 + ["aqua delta water", "oat drink", "gluten free bread", "pears soap", "pasta shells"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    categories = [("pasta", "Pasta"), ("frozen_meat", "Frozen Meat"), ("milk", "Milk"), ("cheese", "Cheese"), ("gluten_free", "Gluten Free Food"), ("detergent", "البسكويت")]
    brands = [("pears", "Pears"), ("aqua", "Aqua"), ("aqua_delta", "Aqua Delta"), ("juhayna", "Juhayna"), ("milka", "Milka"), ("hero", "Hero")]
    df = lambda r: spark.createDataFrame(r, "slug string, phrase string")
    held = lambda r: spark.createDataFrame(r, "slug string, id long")
    return phrases.Names(retrieval.Index.build(rows, ["name"]), df(categories), df(brands), held([("milk", i) for i in range(8, 12)]), held([("juhayna", i) for i in range(8, 12)]))


def ask(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, q string")


def test_evidence_protects_words(spark, names):
    """A word of the corpus isn't taken for a name that only resembles it, a misspelt or exact name is."""
    brand = {r.qid: (r.slug, r.words, r.rest) for r in names.fuzzy_brand(ask(spark, ["peas", "pear", "aqua delta still", "juhaina", "juhayna", "pears", "بدون pears", "wafer", ""])).collect()}
    assert brand == {1: ("pears", 1, ""), 2: ("aqua_delta", 2, "still"), 3: ("juhayna", 1, ""), 4: ("juhayna", 1, ""), 5: ("pears", 1, ""), 6: ("pears", 1, "بدون")}
    cat = {r.qid: r.slug for r in names.fuzzy_category(ask(spark, ["paste", "pastta", "frozen peas", "milka", "milks", "بسكوت", "البسكوت"])).collect()}
    assert cat == {1: "pasta", 4: "milk", 5: "detergent", 6: "detergent"}
    exact = names.brand_text(ask(spark, ["juhayna", "juhayn", "peas"])).collect()
    assert {(r.qid, r.slug) for r in exact} == {(0, "juhayna"), (1, "juhayna")}


def test_overlap_exempts(spark, names):
    """milk is attested by documents that are members of the category, so a near name of it still counts; without members it doesn't."""
    q, near = ask(spark, ["milk"]), spark.createDataFrame([("milk", "milky")], "slug string, phrase string")
    assert [r.slug for r in phrases.fuzzy_phrases(names.index, q, near, 1, members=names.category_members).collect()] == ["milk"]
    assert phrases.fuzzy_phrases(names.index, q, near, 1).collect() == []
    held = spark.createDataFrame([(0, "milka")], "qid long, word string")
    assert phrases.fuzzy_phrases(names.index, ask(spark, ["milka"]), near, 1, protected=held).collect() == []
    assert [r.words for r in phrases.attested_window(names.index, ask(spark, ["big frozen peas", "peas tomato"])).collect()] == [2]


def test_parse(spark, names):
    texts = ["aqua delta milk", "cheese without glutn please", "juhayna", "pasta pears", "no sugar cheese", "", None, "!!", "notes on cheese"]
    got = {r.qid: (r.category, r.brand, r.text) for r in names.parse(ask(spark, texts)).collect()}
    assert got == {
        0: ("milk", "aqua_delta", None), 1: ("gluten_free", None, "cheese  please"), 2: (None, "juhayna", None), 3: ("pasta", "pears", None), 4: ("cheese", None, "no sugar"),
        5: (None, None, None), 6: (None, None, None), 7: (None, None, "!!"), 8: ("cheese", None, "notes on"),
    }
    assert {(r.qid, r.slug) for r in names.category_hint(ask(spark, ["Milk", "pastta", "zzz"])).collect()} == {(0, "milk"), (1, "pasta")}
    assert {(r.qid, r.word) for r in names.protected_words(ask(spark, ["Milk, chocolate", "milk pears"])).collect()} == {(0, "milk"), (1, "milk")}


def test_entry_point_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.isdir("/root/testdata/sf0.001") is False or e.entry(spark).count() >= 0


def test_holders_follow_the_words_of_documents(spark, names):
    """As brute force has it, and without a row for every document of a common word."""
    rows = [(i, " ".join(w for j, w in enumerate(("salt", "pepper", "mint", "lemon")) if i >> j & 1) + (" box" if i % 3 else "")) for i in range(1, 64)]
    index = retrieval.Index.build(spark.createDataFrame(rows, "id long, name string"), ["name"])
    asked = [["salt", "box"], ["box"], ["lemon", "salt", "mint"], ["salt", "salt"], ["salt", "unheard"], ["--", "salt"], ["mint", "pepper", "lemon", "box"]]
    found = spark.createDataFrame([(a,) for a in asked], "parts array<string>")
    keyed = phrases._held_words(index, found)
    got = {}
    for r in keyed.join(phrases.holders(index, keyed), "key").collect():
        got.setdefault(tuple(r.parts), []).append(r.id)
    want = {tuple(a): [i for i, t in rows if set(a) <= set(t.split())] for a in asked}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_context_of_equal_words_is_looked_up_once(spark, names):
    rows = [(i, ("hill milk" if i % 2 else "hill farm juice") + (" rare" if i == 6 else "")) for i in range(200)]
    index = retrieval.Index.build(spark.createDataFrame(rows, "id long, name string"), ["name"])
    words = spark.createDataFrame([(q, w) for q in range(300) for w in ("hill", "farm")] + [(300, "rare"), (300, "milk"), (302, "nothing")], "qid long, token string")
    found = spark.createDataFrame([(q, c, 90.0, 100) for q in range(303) for c in ("milk", "juice")], "qid long, candidate string, score double, df long")
    got = {(r.qid, r.candidate): (r.support, r.has_context) for r in retrieval.with_context(index, words, found).collect()}
    assert len(got) == 606 and set(got[q, "milk"] for q in range(300)) == {(0, True)} and set(got[q, "juice"] for q in range(300)) == {(100, True)}
    assert got[300, "milk"] == (100, True) and got[300, "juice"] == (1, True)  # no document holds both: any counts
    assert got[301, "milk"] == got[302, "milk"] == (0, False)


def test_windows_normalise_as_a_whole(spark):
    """A window put together from its words is what normalising its text gives, whatever its scripts, blanks and signs."""
    texts = ["Milk، حَليب ـ  FOO", " a\u2003B\u00a0ﺣﻠﻴﺐ ", "ـ ـ", ".,- -x-", None, "", "ΑΣ ΣΑ İX ﻻ إلى ﻻ", "_ ,x. Ｆｕｌｌ"]
    parts = [(i, a, n, " ".join(t.split()[a : a + n])) for i, t in enumerate(texts) if t for a in range(len(t.split())) for n in (1, 2, 3) if a + n <= len(t.split())]
    want = spark.createDataFrame(parts, "qid long, start int, words int, t string").withColumn("phrase", T.normalize(F.col("t"))).where("phrase <> ''")
    got = phrases.windows(ask(spark, texts), 3).withColumn("t", F.array_join("parts", " "))
    key = lambda df: sorted((r.qid, r.start, r.words, r.t, r.phrase) for r in df.collect())
    assert key(got) == key(want)
    fixed = [*phrases.BRAND_BLOCKED, *phrases.CATEGORY_BLOCKED, *phrases.FREE_MARKS, " .Ｆｕ  LL-", "ﻻ أَمــى X"]
    assert [r.n for r in spark.createDataFrame([(i, v) for i, v in enumerate(fixed)], "i long, v string").select("i", T.normalize(F.col("v")).alias("n")).orderBy("i").collect()] == [T.normalized(v) for v in fixed]


def test_windows_of_texts_are_not_kept(spark, names, monkeypatch):
    """What is written grows with what is similar to a name, not with the windows of all texts."""
    kept, write = [], phrases.cut
    monkeypatch.setattr(phrases, "cut", lambda df: [c := write(df), kept.append(c.count())][0])
    texts = [f"w{i} w{i + 1} w{i + 2} pastta w{i + 3} w{i + 4}" for i in range(60)]
    got = names.fuzzy_category(ask(spark, texts)).collect()
    assert {(r.qid, r.slug, r.start, r.words) for r in got} == {(i, "pasta", 3, 1) for i in range(60)}
    assert kept and max(kept) < 60 * 21 / 4


def test_category_compares_all_texts_in_one_go(spark, names, monkeypatch):
    """A singular alias yields to a longer name only; both kinds of text meet the names once."""
    runs, fuzzy = [], phrases.fuzzy_phrases
    monkeypatch.setattr(phrases, "fuzzy_phrases", lambda *a, **k: runs.append(1) or fuzzy(*a, **k))
    texts = ["جبنة", "frozen meet جبنة", "pastta جبنة", "pastta", "zzzz", "لحمة مجمدة", "cheese frozen meet", "جبن جبنه"]
    got = {r.qid: (r.slug, r.words, r.rest) for r in names.category(ask(spark, texts)).collect()}
    assert got == {0: ("cheese", 1, ""), 1: ("frozen_meat", 2, "جبنة"), 2: ("cheese", 1, "pastta "), 3: ("pasta", 1, ""), 5: ("meat", 1, " مجمدة"), 6: ("cheese", 1, " frozen meet"), 7: ("cheese", 1, " جبنه")}
    assert len(runs) == 1

from pyspark.sql import functions as F

from karwan.operators import corpus as C
from karwan.operators import recommend, retrieval


def corpus(spark):
    rows = [(1, "fresh milk"), (2, "milk powder"), (3, "fresh milk cow"), (4, "silk scarf"), (5, "silk scarf red"), (6, "silk dress"), (7, "silk tie"), (8, None)]
    return spark.createDataFrame([(*r, None, None) for r in rows], "id long, name string, sku string, url_key string")


def test_context_decides_before_frequency(spark):
    index = retrieval.Index.build(corpus(spark), ["name"])
    found = spark.createDataFrame([(1, "milk", 75.0, 3), (1, "silk", 75.0, 4), (2, "milk", 75.0, 3), (2, "silk", 75.0, 4)], "qid long, candidate string, score double, df long")
    words = spark.createDataFrame([(1, "fresh")], "qid long, token string")
    held = retrieval.with_context(index, words, found)
    assert {(r.qid, r.candidate, r.support, r.has_context) for r in held.collect()} == {(1, "milk", 2, True), (1, "silk", 0, True), (2, "milk", 0, False), (2, "silk", 0, False)}
    assert {tuple(r) for r in retrieval.select_best(held, margin=1).collect()} == {(1, "milk"), (2, "silk")}
    assert {tuple(r) for r in retrieval.select_best(held, margin=2).collect()} == {(1, "milk")}


def test_each_query_takes_its_plan(spark):
    rows = corpus(spark)
    index = retrieval.Index.build(rows, ["name"])
    q = spark.createDataFrame([(1, "silk"), (2, "scarg"), (3, "qqqq"), (4, "zzzz"), (5, "dress")], "qid long, q string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None)], "id long, vector array<double>")
    qv = spark.createDataFrame([(i, v) for i, v in ((1, [1.0, 0.0]), (3, [1.0, 0.1]), (4, [-1.0, -1.0]))], "qid long, vector array<double>")
    got = {}
    for r in retrieval.hybrid(index, rows, q, vectors, qv, wide=3).collect():
        got.setdefault((r.qid, r.plan), set()).add(r.id)
    assert got.pop((1, "fused")) == {1, 2, 4, 5, 6, 7}  # of more than `wide` candidates what is found is fused with the vectors
    assert got.pop((3, "vector")) == {1, 2} and got.pop((5, "fused")) == {6}
    few = retrieval.hybrid(index, rows.where("id <> 7").withColumn("price", 9 - rows["id"]), q.where("qid in (1, 5)").union(spark.createDataFrame([(6, ""), (7, None)], "qid long, q string")), vectors, qv, wide=7, price_col="price")
    by = {(r.qid, r.place): (r.plan, r.id) for r in few.collect()}
    assert by[5, 1] == ("keyword", 6) and {by[1, i][0] for i in (1, 2, 3)} == {"keyword"} and (1, 4) not in by
    assert [by[6, i] for i in (1, 2)] == [("filter", 8), ("filter", 6)] and by[7, 7] == ("filter", 1)
    assert not [k for k in got if k[0] == 4] and all(k == (2, "corrected") for k in got)


def test_fitted_clusters_part_the_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 2), float(i % 2) + 0.01 * i]) for i in range(20)], "id long, vector array<double>")
    got = {r.id: r.cluster for r in recommend.assign(v, recommend.fit_centroids(v, 2)).collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == len({got[i] for i in range(1, 20, 2)}) == 1 and got[0] != got[1]


def test_forced_rows_come_first(spark):
    rows = spark.createDataFrame([(i, i % 10 == 0 if i % 7 else None) for i in range(100)], "id long, must boolean")
    must = {i for i in range(100) if i % 10 == 0 and i % 7}
    got = {r.id: r.forced for r in C.sample_with_forced(rows, 20, F.col("must")).collect()}
    assert len(got) == 20 and {i for i, f in got.items() if f} == must
    assert got == {r.id: r.forced for r in C.sample_with_forced(rows.repartition(5), 20, F.col("must")).collect()}
    assert {r.id for r in C.sample_with_forced(rows, 3, F.col("must")).collect()} < must
    assert C.sample_with_forced(rows.where("id < 0"), 3, F.col("must")).collect() == [] and C.sample_with_forced(rows, 500, F.col("must")).count() == 100

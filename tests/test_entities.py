import random

import pytest
from pyspark.sql import functions as F

from karwan.operators import entities as E


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(1, 150), rng.randint(1, 150)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in E.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert E.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        E.components(chain, rounds=2)


def test_complete_linkage_needs_all_pairs(spark):
    edges = [("a", "b", 95.0), ("b", "c", 94.0), ("d", "e", 91.0), ("a", "c", 90.0), ("c", "d", 99.0)]
    got = {r.node: r.cluster for r in E.complete_linkage(spark.createDataFrame(edges, "a string, b string, score double")).collect()}
    assert got == {"c": "c", "d": "c", "a": "a", "b": "a", "e": "e"}


def test_gate_upsert_and_alias(spark):
    rows = spark.createDataFrame([(False, None), (True, "Approve"), (True, "reject "), (True, None)], "needs boolean, decision string")
    gated = rows.withColumn("gate", E.review_gate(F.col("needs"), F.col("decision")))
    assert sorted(r.gate for r in gated.collect()) == ["apply", "apply", "pending", "reject"]
    with pytest.raises(ValueError):
        E.require_decided(gated)
    old, new = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string"), spark.createDataFrame([("b", "2", 1), ("b", "3", 2), ("c", None, 1)], "k string, v string, ord int")
    assert {tuple(r) for r in E.upsert(old, new, "k", ["v"]).collect()} == {("a", "1"), ("b", "3"), ("c", None)}
    p = spark.createDataFrame([(1, "x", "y"), (2, None, "y"), (3, "z", None)], "id int, en string, ar string")
    alias = spark.createDataFrame([("x", 5), ("y", 6)], "raw_value string, target int")
    assert {(r.id, r.t) for r in E.coalesce_alias(p, alias, "en", "ar", "t").collect()} == {(1, 5), (2, 6), (3, None)}


def test_categories_are_merged_linked_and_reviewed(spark):
    names = ["Fresh Milk", "fresh  milk", "Olive Oil", "Oil Olives", "Tea", "test12", "Ground Coffee", "Ground Coffees", None]
    rows = spark.createDataFrame([(i + 1, n, f"ar{i + 1}") for i, n in enumerate(names)], "id long, name_en string, name_ar string")
    links = spark.createDataFrame([(2,), (2,), (3,), (8,), (None,)], "category_id long")
    got = {r.id: r for r in E.canonical_categories(rows, links).collect()}
    assert {i: r.method for i, r in got.items()} == {1: "exact_auto_merge", 2: "exact_auto_merge", 3: "fuzzy_candidate", 4: "fuzzy_candidate", 5: "singleton_unique", 6: "junk_excluded", 7: "fuzzy_candidate", 8: "fuzzy_candidate", 9: "singleton_unique"}
    assert (got[1].slug, got[1].display_ar, got[1].group_id) == ("fresh_milk", "ar2", 1) and got[4].display_en == "Olive Oil" and got[7].display_en == "Ground Coffees"
    assert got[3].confidence == 94.7 and got[3].needs_review and got[6].needs_review and not got[5].needs_review
    decide = {3: "approve", 4: " Approve", 7: "approve", 8: "reject", 6: "reject"}
    reviewed = E.canonical_categories(rows, links).join(rows, "id").join(spark.createDataFrame(list(decide.items()), "id long, decision string"), "id", "left")
    out = {r.id: (r.outcome, r.slug, r.display_en) for r in E.apply_reviews(reviewed).collect()}
    assert out[1] == out[2] == ("assigned", "fresh_milk", "fresh  milk") and out[3] == out[4] == ("assigned", "olive_oil", "Olive Oil")
    assert out[5] == ("assigned", "tea_5", "Tea") and out[6] == ("assigned", "test12_6", "test12") and out[7] == ("assigned", "ground coffee_7", "Ground Coffee")
    open_ = {r.id: r.outcome for r in E.apply_reviews(reviewed.withColumn("decision", F.when(F.col("id") == 3, "approve").when(F.col("id") == 6, "approve"))).collect()}
    assert open_[3] == open_[4] == open_[7] == "pending" and open_[6] == "junk" and open_[1] == "assigned"


def test_survivors(spark):
    pairs = spark.createDataFrame([("milka", "ميلكا"), ("milca", "ميلكا"), ("أ", "ب")], "a string, b string")
    keys = spark.createDataFrame([("milka", "latin"), ("milca", "latin"), ("ميلكا", "arabic"), ("أ", "arabic"), ("ب", "arabic"), ("lone", "latin")], "key string, script string")
    assert {(r.key, r.survivor) for r in E.survivors(pairs, keys).collect()} == {("milka", "milca"), ("milca", "milca"), ("ميلكا", "milca"), ("أ", "أ"), ("ب", "أ"), ("lone", "lone")}

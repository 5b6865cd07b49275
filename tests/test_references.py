from datetime import datetime as D

from karwan.operators import references as R


def tables(spark, links, products, categories, log):
    t = "id long, created_at timestamp, updated_at timestamp, link_id string"  # a column that clashes with the result's
    targets = [R.Target("product_id", spark.createDataFrame(products, t), "product"), R.Target("category_id", spark.createDataFrame(categories, t), "category")]
    return spark.createDataFrame(links, "id long, product_id long, category_id long, created_at timestamp"), targets, spark.createDataFrame(log, "entity string, record_id long, deleted_at timestamp")


def test_states_and_counts(spark):
    a, b, c = D(2024, 1, 5), D(2024, 1, 20), D(2024, 3, 1)
    products = [(1, a, a, ""), (1, a, b, ""), (2, b, None, ""), (3, None, None, ""), (4, a, a, "")]
    categories = [(7, b, b, None)]
    log = [("product", 9, a), ("product", 1, b), ("product", 2, a), ("product", 3, a), ("category", 1, a), ("product", 9, c), (None, 4, c), ("product", None, c)]
    links = [(10, 1, 7, c), (11, 2, 7, c), (12, 3, 7, a), (13, 4, 7, None), (14, 9, 8, c), (15, 77, None, c), (16, None, 7, D(2024, 1, 25)), (16, None, 7, D(2024, 1, 10))]
    want = {(10, "product_id", "deleted"), (12, "product_id", "deleted"), (12, "category_id", "late"), (14, "product_id", "deleted"), (14, "category_id", "missing"), (15, "product_id", "missing"), (16, "category_id", "late")}
    t = tables(spark, links, products, categories, log)
    assert {tuple(x) for x in R.orphan_links(*t).collect()} == want
    counts = {(r.ref_field, str(r.month)[:7], r.ref_state): r.n_refs for r in R.orphan_counts(*t).collect()}
    assert counts == {("product_id", "2024-03", "deleted"): 2, ("product_id", "2024-01", "deleted"): 1, ("category_id", "2024-01", "late"): 2, ("category_id", "2024-03", "missing"): 1, ("product_id", "2024-03", "missing"): 1}


def test_hot_key_and_cold_keys_agree(spark):
    a = D(2024, 1, 5)
    links = [(i, 5 if i % 3 else i, 1, a) for i in range(3000)]
    t = tables(spark, links, [(i, a, a, "") for i in range(3000) if i % 2], [(1, a, a, "")], [])
    got = {r.link_id for r in R.orphan_links(*t).collect()}
    assert got == {i for i in range(3000) if i % 3 == 0 and i % 2 == 0}


def test_empty_tables(spark):
    t = tables(spark, [], [], [], [])
    assert R.orphan_links(*t).collect() == [] and R.orphan_counts(*t).collect() == []
    t = tables(spark, [(1, 2, None, None)], [], [], [])
    assert [tuple(x) for x in R.orphan_links(*t).collect()] == [(1, "product_id", "missing")]

import random

from karwan.operators import hierarchy as H

SCHEMA = "id long, parent long, seen long, name string"


def brute(links: dict):
    out = {}
    for x in links:
        path, at = [x], x
        while True:
            up = links[at]
            if up is None or up not in links:
                out[x] = (at, len(path) - 1, path[::-1])
                break
            if up in path:
                out[x] = (min(path[path.index(up) :]), -1, None)
                break
            path.append(up)
            at = up
    return out


def run(spark, links, **kw):
    df = spark.createDataFrame([(k, v) for k, v in links.items()], "id long, parent long").repartition(4)
    return {r.id: (r.root_id, r.depth, list(r.path) if r.path is not None else None) for r in H.resolve(df, with_paths=True, **kw).collect()}


def test_random_forests_with_rings(spark):
    rng = random.Random(3)
    ids = rng.sample(range(1, 10**12), 300)
    links = {x: rng.choice([None, 5, *ids[:200]]) for x in ids}
    for i in range(60, 119):  # a deep branch
        links[ids[i]] = ids[i + 1]
    links[ids[7]] = ids[7]
    assert run(spark, links) == brute(links)


def test_levels_that_are_too_large_for_one_task(spark):
    rng = random.Random(5)
    ids = list(range(1, 81))
    links = {x: rng.choice([None, x + 1, *ids]) for x in ids}
    assert run(spark, links, top_rows=25) == brute(links)
    ring = {x: x % 24 + 1 for x in range(1, 25)} | {100 + x: x for x in range(1, 20)}
    assert run(spark, ring, top_rows=15) == brute(ring)


def test_latest_row_ties_nulls_and_empty(spark):
    rows = [(1, None, 1, "a"), (1, 2, 2, "b"), (1, 2, 2, "b"), (2, 9, None, None), (None, 1, 1, "x"), (3, 1, 1, "c")]
    links = H.latest_links(spark.createDataFrame(rows, SCHEMA), "id", "parent", ["seen"])
    got = {r.id: (r.root_id, r.depth) for r in H.resolve(links).collect()}
    assert got == {1: (2, 1), 2: (2, 0), 3: (2, 2)}
    empty = H.resolve(spark.createDataFrame([], "id long, parent long"), with_paths=True)
    assert empty.collect() == [] and H.descendants(empty).collect() == []


def test_descendants_and_rings(spark):
    links = {1: None, 2: 1, 3: 2, 4: 1, 8: 9, 9: 8, 10: 9}
    df = spark.createDataFrame(list(links.items()), "id long, parent long")
    r = H.resolve(df, with_paths=True)
    assert {tuple(x) for x in H.descendants(r).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1)}
    assert [tuple(x) for x in H.rings(r, df).collect()] == [(8, 3)]

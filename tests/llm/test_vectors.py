import numpy as np
import pyarrow as pa
import pytest

from karwan.llm import ann, mixture
from karwan.llm.quantiser import Quantiser

WIDTH = 16


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    means = unit(rng.normal(size=(6, WIDTH)))
    x = unit(means[rng.integers(0, 6, 900)] + 0.12 * rng.normal(size=(900, WIDTH)))
    x[:60] = unit(x[60:120] + 0.02 * rng.normal(size=(60, WIDTH)))
    x[120:132] = x[120]  # exact copies
    return x.astype(np.float32)


def frame(spark, x, first=1):
    rows = [(first + i, [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vector array<float>")


def bad(spark):
    return spark.createDataFrame([(5001, None), (5002, [0.0] * WIDTH), (5003, [float("nan")] + [1.0] * (WIDTH - 1)), (5004, [1.0] * 3), (None, [1.0] * WIDTH), (5005, [])], "id long, vector array<float>")


def brute(x, least, k):
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -1)
    out = {}
    for i, row in enumerate(s):
        c = np.flatnonzero(row >= least)
        out[i + 1] = {int(j) + 1: row[j] for j in c[np.lexsort((c, -np.round(row[c], 6)))][:k]}
    return out


def test_neighbours_recall(spark, data):
    got = {}
    rows = frame(spark, data).union(frame(spark, data[:9])).union(bad(spark))
    for r in ann.neighbours(rows, 5, 0.95, WIDTH).collect():
        got.setdefault(r.id, {})[r.other_id] = r.cosine
    want = brute(data, 0.95, 5)
    pairs = [(i, j) for i in want for j in want[i]]
    hit = sum(j in got.get(i, {}) or any(abs(want[i][j] - c) < 1e-5 for c in got.get(i, {}).values()) for i, j in pairs)
    assert hit / len(pairs) >= 0.9
    assert max(map(len, got.values())) <= 5 and not set(got) & set(range(5001, 5006))
    assert set(got[121]) == {122, 123, 124, 125, 126} and set(got[132]) == {121, 122, 123, 124, 125}


def test_many_copies_and_crowded_cells(spark, data, monkeypatch):
    copies = np.repeat(data[:1], 300, 0)
    near = unit(data[1:2] + 0.004 * np.random.default_rng(2).normal(size=(400, WIDTH))).astype(np.float32)
    monkeypatch.setattr(ann, "CELL_ROWS", 150)
    got = {}
    for r in ann.neighbours(frame(spark, np.concatenate([copies, near])), 3, 0.99, WIDTH).collect():
        got.setdefault(r.id, set()).add(r.other_id)
    assert got[1] == {2, 3, 4} and got[300] == {1, 2, 3}
    want = brute(near, 0.99, 3)
    hit = sum(len(set(want[i]) & {j - 300 for j in got.get(300 + i, ())}) for i in want) / sum(map(len, want.values()))
    assert hit >= 0.9


def test_a_third_of_copies_leaves_the_other_cells_shallow(spark):
    rng = np.random.default_rng(6)
    one = unit(rng.normal(size=(7_000, 32)))
    other = unit(one + 0.06 * rng.normal(size=one.shape))
    x = np.concatenate([one, other, np.repeat(one[:1], 7_000, 0)]).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"id": np.arange(1, len(x) + 1), "vector": list(x)}))
    want = {i + 1 for i in range(1, 7_000) if x[i] @ x[7_000 + i] >= 0.93}
    got = {r.id for r in ann.neighbours(rows, 3, 0.93, 32).where("other_id = id + 7000").collect()}
    assert len(want) > 3000 and len(want & got) / len(want) >= 0.97


def test_a_tight_third_leaves_the_other_cells_shallow():
    rng = np.random.default_rng(6)
    x = unit(rng.normal(size=(14_000, 32)))
    x = np.concatenate([x, unit(x[:1] + 0.0005 * rng.normal(size=(7_000, 32)))]).astype(np.float32)
    codes = Quantiser.train(x, 6, ann.CODEWORDS).encode(x, ann.BEAM)[0][:, 0]
    assert ann.level_for(codes, 234_000) == 1


def test_a_cell_that_stays_crowded_is_compared_exactly(spark, data, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 60)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "DEEPEST", 0)
    tight = unit(data[:1] + 0.03 * np.random.default_rng(5).normal(size=(700, WIDTH))).astype(np.float32)
    rows = frame(spark, np.concatenate([data[130:400], tight]))
    got = {}
    twice = spark.createDataFrame([(300, [float(a) for a in data[500]])], rows.schema)  # an id with a second vector
    for r in ann.neighbours(rows.union(twice), 3, 0.95, WIDTH).where("id > 270 and id <> 300").collect():
        got.setdefault(r.id, []).append(r.cosine)
    want = brute(tight, 0.95, 3)
    assert len(want) == 700
    assert all(np.allclose(sorted(got[270 + i]), sorted(want[i].values()), atol=2e-6) for i in want if i != 30)


def test_cells(data, monkeypatch):
    q = Quantiser.train(data, ann.STAGES, ann.CODEWORDS)
    codes, first = q.encode(data, 8, early=2)
    got = ann.cells(codes[:, 0], first).to_pylist()
    assert all(1 <= len(c) == len(set(c)) <= ann.PROBES[2] for c in got)
    assert [c[0] for c in got] == ann.names(codes[:, 0, :2]).tolist()
    assert ann.level_for(codes[:, 0], 900) == 0
    monkeypatch.setattr(ann, "MEET", 20)
    assert ann.level_for(codes[:, 0], 900) == 1


@pytest.mark.parametrize("level", range(1, ann.DEEPEST + 1))
def test_recall_of_cells_at_every_depth(level):
    """As fine as 128 ** level cells make it: what matters is only whether near pairs still share one."""
    rng = np.random.default_rng(11)
    means = unit(rng.normal(size=(60, 64)))
    x = unit(means[rng.integers(0, 60, 6_000)] + 0.08 * rng.normal(size=(6_000, 64)))
    x[3_000:] = unit(x[:3_000] + rng.uniform(0.01, 0.052, (3_000, 1)) * rng.normal(size=(3_000, 64)))
    x = x.astype(np.float32)
    near = np.flatnonzero((x[:3_000] * x[3_000:]).sum(1) >= 0.92)
    q = Quantiser.train(x, ann.STAGES, ann.CODEWORDS, rounds=4)
    codes = q.encode(x, ann.BEAM)[0][:, 0]
    got = [set(c) for c in ann.cells(codes, q.encode(x, ann.BEAMS[level], early=level)[1]).to_pylist()]
    own = ann.names(codes[:, :level])
    met = [own[i] in got[i + 3_000] or own[i + 3_000] in got[i] for i in near]
    assert len(near) > 2_000 and np.mean(met) >= 0.95


def test_near_pairs_of_loose_groups_meet_in_the_deepest_cells(spark, monkeypatch):
    """As a table of millions has them: cells named by DEEPEST codes, and groups whose own spread outweighs the codes."""
    rng = np.random.default_rng(12)
    means = unit(rng.normal(size=(60, 64)))
    one = unit(means[rng.integers(0, 60, 6_000)] + 0.1 * rng.normal(size=(6_000, 64)))
    other = unit(one + rng.uniform(0.02, 0.042, (6_000, 1)) * rng.normal(size=one.shape))
    x = np.concatenate([one, other]).astype(np.float32)
    near = {i + 1 for i in np.flatnonzero((x[:6_000] * x[6_000:]).sum(1) >= 0.92)}
    monkeypatch.setattr(ann, "level_for", lambda codes, n: ann.DEEPEST)
    rows = spark.createDataFrame(pa.table({"id": np.arange(1, len(x) + 1), "vector": list(x)}))
    got = {r.id for r in ann.neighbours(rows, 3, 0.92, 64).where("other_id = id + 6000").collect()}
    assert len(near) > 5_000 and len(near & got) / len(near) >= 0.985


def test_large_groups_give_the_pairs_of_the_tables(data, monkeypatch):
    q = Quantiser.train(data, ann.STAGES, ann.CODEWORDS)
    codes = q.encode(data, 8)[0][:, 0]
    rows = [(c, 0, i, codes[i].tobytes(), float(np.linalg.norm(q.decode(codes[i]))), i % 3 < 2) for c in (1, 2) for i in range(c, 900, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float32(), pa.bool_()))], ["cell", "block", "id", "codes", "norm", "kept"])
    got = []
    for least in (ann.WHOLE_GROUP, 10_000):
        monkeypatch.setattr(ann, "WHOLE_GROUP", least)
        got.append(sorted((a, b) for r in ann._pairs_in_cells(q, 0.9)(iter([batch])) for a, b in zip(r["a"].to_pylist(), r["b"].to_pylist())))
    assert got[0] == got[1] and len(got[0]) > 1_000


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    assert ann.neighbours(none, 5, 0.9, WIDTH).collect() == []
    assert ann.neighbours(bad(spark), 5, 0.9, WIDTH).collect() == []
    assert ann.neighbours(frame(spark, np.eye(WIDTH)[:1]), 5, 0.9, WIDTH).collect() == []
    assert mixture.members(none, WIDTH).collect() == []
    assert mixture.members(bad(spark), WIDTH).collect() == []
    assert mixture.members(frame(spark, np.eye(WIDTH)[:3]), WIDTH).collect() == []


def test_quantiser_tables_and_beam(data):
    q = Quantiser.train(data, 4, 32)
    wide, narrow = q.encode(data, 8), q.encode(data, 1)
    err = lambda c: ((data - q.decode(c[0][:, 0])) ** 2).sum()
    assert err(wide) <= err(narrow) + 1e-3
    codes = wide[0][:, 0]
    t = q.tables(data[:5])
    sums = sum(t[:, m * 32 + codes[:, m]] for m in range(4))
    assert np.allclose(sums, data[:5] @ q.decode(codes).T, atol=1e-4)


def test_clusters(spark):
    rng = np.random.default_rng(4)
    means = np.linalg.qr(rng.normal(size=(64, 64)))[0][:5]
    sizes = [400, 90, 60, 40, 30]
    x = np.concatenate([unit(m + 0.1 * rng.normal(size=(n, 64))) for m, n in zip(means, sizes)] + [unit(rng.normal(size=(25, 64)))])
    label = np.repeat(np.arange(6), [*sizes, 25])
    order = rng.permutation(len(x))
    x, label = x[order].astype(np.float32), label[order]
    rows = frame(spark, x).union(frame(spark, x[:30])).union(spark.createDataFrame([(9001, [0.0] * 64), (9002, None)], "id long, vector array<float>"))
    placed = mixture.members(rows, 64)
    got = {r.id: r.cluster_id for r in placed.collect()}
    first = {c: min(i + 1 for i in np.flatnonzero(label == c)) for c in range(5)}
    assert got == {i + 1: first[c] for i, c in enumerate(label) if c < 5}
    d = {r.cluster_id: r for r in mixture.described(placed, 3).collect()}
    assert d[first[0]].n_members == 400 and len(d[first[4]].typical_ids) == 3


def around(rng, mean, n, cos):
    e = rng.normal(size=(n, len(mean)))
    e = unit(e - np.outer(e @ mean, mean))
    return unit(mean + np.sqrt(1 / cos**2 - 1) * e)


@pytest.mark.parametrize("loose", [3_000, 30_000])
def test_small_groups_are_found_whatever_lies_beside_them(spark, loose):
    rng = np.random.default_rng(8)
    sizes = [1_000] * 3 + [20] * 6 + [10] * 6 + [5] * 6
    means = unit(rng.normal(size=(len(sizes), 64)))
    x = np.concatenate([unit(rng.normal(size=(loose, 64))), *[around(rng, m, n, 0.776) for m, n in zip(means, sizes)]])
    label = np.concatenate([np.full(loose, -1), np.repeat(np.arange(len(sizes)), sizes)])
    order = rng.permutation(len(x))
    x, label = x[order].astype(np.float32), label[order]
    rows = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "vector": list(x)}))
    got = {}
    for r in mixture.members(rows).collect():
        got.setdefault(r.cluster_id, set()).add(r.id)
    want = [set(np.flatnonzero(label == g).tolist()) for g in range(len(sizes))]
    assert all(w == got.get(min(w)) for w in want)
    assert len(got) == len(sizes)


def test_all_vectors_are_fitted_again_only_when_the_search_has_ended(spark, monkeypatch):
    rng = np.random.default_rng(14)
    sizes = [500] * 2 + [12] * 14
    means = unit(rng.normal(size=(len(sizes), 64)))
    x = np.concatenate([unit(rng.normal(size=(20_000, 64))), *[around(rng, m, n, 0.8) for m, n in zip(means, sizes)]]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    monkeypatch.setattr(mixture, "SAMPLE_ROWS", 1_000)
    monkeypatch.setattr(mixture, "TURN_SEEDS", 6)  # many turns
    fitted, over = mixture._fitted, []
    monkeypatch.setattr(mixture, "_fitted", lambda vectors, *rest: (over.append(vectors), fitted(vectors, *rest))[1])
    mix = mixture.fit(spark.createDataFrame(pa.table({"id": np.arange(len(x)), "vector": list(x)})))[1]
    assert ((mix.direction @ means.T).max(0) >= 0.9).all()
    assert len(over) >= 5 and sum(v is over[0] for v in over) <= 2


def test_the_chance_cosine_counts_every_row(spark):
    """Rows of a narrower kind, too few for a sample to show, still shift it; the order of the rows doesn't."""
    rng = np.random.default_rng(13)
    x = unit(rng.normal(size=(30_000, 16))).astype(np.float32)
    rows = lambda v: spark.createDataFrame(pa.table({"vector": list(v)}))
    got = mixture.spread(rows(x), 16, len(x), 5)
    cos = np.sort((x[:3_000] @ x.T).ravel())
    want = cos[[len(cos) // 2, int(0.16 * len(cos))]]
    assert np.allclose(got, [want[0], want[0] - want[1]], atol=0.003)
    means = unit(rng.normal(size=(3, 16)))
    ordered = np.concatenate([unit(m + 0.1 * rng.normal(size=(8_000, 16))) for m in means]).astype(np.float32)
    assert np.allclose(mixture.spread(rows(ordered), 16, len(ordered), 5), mixture.spread(rows(ordered[rng.permutation(len(ordered))]), 16, len(ordered), 5), atol=0.02)
    half = mixture.pair_counts(x[:20_000]) + mixture.pair_counts(x[20_000:])
    assert half.sum() == len(x) * mixture.PARTNERS


def test_cells_find_what_a_sample_does_not_show(monkeypatch):
    rng = np.random.default_rng(9)
    means = unit(rng.normal(size=(8, 64)))
    x = np.concatenate([unit(rng.normal(size=(4_000, 64))), *[around(rng, m, 12, 0.8) for m in means]]).astype(np.float32)
    least = mixture.chance_cosine(x, len(x), 1)
    found, rows = mixture.local_seeds(x, least, mixture.OTHERS)
    assert ((found @ means.T).max(0) >= 0.9).all() and (rows >= 3).all()
    assert mixture.directions_for(mixture.CELL_ROWS, 64, 0) == []
    assert [len(d) for d in mixture.directions_for(mixture.CELL_ROWS * 1000, 64, 0)] == [32, 32]

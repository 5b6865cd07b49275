"""Most similar vectors for every vector, by additive quantisation.

Vectors are encoded by beam search over full-dimensional residual codebooks. The beam's code prefixes are
the cells a vector is looked up in, the best one the cell it is kept in. Inside a cell pairs are scored from
codes, stored norms and lookup tables alone; pairs that may reach the wanted cosine are reranked exactly on the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karwan.llm.quantiser import Quantiser
from karwan.runtime import cut, width

STAGES, CODEWORDS, BEAM = 10, 128, 8
#: A cell is named by so many codes at most.
DEEPEST = 3
#: Cells that a vector is looked up in, its own and the best others of the beam, by the number of codes that name them: more
#: where cells are finer, so that the recall stays (README has it for every depth). In crowded cells 4 * BEAM finer ones are looked into.
PROBES = (1, 6, 8, 32)
#: Cells that a vector is kept in, the first of those that it is looked up in, by the number of codes that name them; FINER_KEPT of those in crowded cells.
KEPT, FINER_KEPT = (1, 1, 2, 4), 2
#: Width of the beam by the number of codes that name a cell.
BEAMS = (8, 8, 8, 32)
#: Vectors that most meet in their own cell, at most; cells with more than CELL_ROWS vectors are made finer.
MEET, CELL_ROWS = 1500, 20_000
#: Rows of one block of a cell that stays crowded.
BLOCK_ROWS = 2048
#: Rows of the bounded sample that the codebooks are fitted on.
SAMPLE_ROWS = 40_000
#: How far the estimate from codes may lie under the wanted cosine.
SLACK = 0.1
PAIRS_AT_ONCE = 500_000
#: Groups that keep so many vectors are scored by products of their decoded sums, which is what the tables add up to.
WHOLE_GROUP = 64


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors (float32) of the usable entries: not null, of that width, finite, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    at = np.flatnonzero(np.asarray(column.is_valid()) & (lengths == size))
    starts = column.offsets.to_numpy()[:-1][at]
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    if len(at) == 0:
        return at, np.zeros((0, size), np.float32)
    x = flat[starts[:, None] + np.arange(size)]
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    at, x = at[fine], x[fine].astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return at, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def digests(x: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(v.tobytes(), digest_size=12).digest() for v in x]


def _distinct(size: int, part: float | None = None):
    """(key, x) of unit vectors, equal for exact copies; only keys, or only the vectors whose key lies in the first `part` of all."""

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = matrix(b.column(0), size)
            key = np.frombuffer(b"".join(d[:8] for d in digests(x)), np.uint64)
            key, first = np.unique(key, return_index=True)
            if part is not None:
                chosen = key <= part * (2.0**64 - 1)
                key, first = key[chosen], first[chosen]
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([x[i].tobytes() if part is not None else None for i in first], pa.binary())], ["key", "x"])

    return choose


def sample(vectors: DataFrame, size: int, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, int]:
    """At most about `rows` distinct unit vectors, chosen by their digests, and about how many distinct ones there are."""
    plain = vectors.select("vector")
    n = plain.mapInArrow(_distinct(size), "key long, x binary").agg(F.approx_count_distinct("key", 0.02)).first()[0]
    chosen = plain.mapInArrow(_distinct(size, min(1.0, rows / max(n, 1))), "key long, x binary").groupBy("key").agg(F.first("x").alias("x")).toArrow()
    chosen = chosen.sort_by("key")["x"].to_pylist()
    return np.frombuffer(b"".join(chosen), np.float32).reshape(-1, size), n


def names(codes: np.ndarray) -> np.ndarray:
    """Codes along the last axis as one number."""
    out = np.zeros(codes.shape[:-1], np.int64)
    for s in range(codes.shape[-1]):
        out = out * CODEWORDS + codes[..., s]
    return out


def cells(own: np.ndarray, first: np.ndarray, most: int | None = None) -> pa.Array:
    """For each row its own cell, then the other distinct ones of the beam's first stages, best first, `most` in all at most."""
    level = first.shape[-1]
    most = PROBES[level] if most is None else most
    all_ = np.concatenate([names(own[:, :level])[:, None], names(first)], 1)
    fresh = np.ones(all_.shape, bool)
    for j in range(1, all_.shape[1]):
        fresh[:, j] = (all_[:, :j] != all_[:, j : j + 1]).all(1)
    fresh &= np.cumsum(fresh, 1) <= most
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(fresh.sum(1))]).astype(np.int32)), pa.array(all_[fresh]))


def _encoder(q: Quantiser, size: int, level: int):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = matrix(b.column(1), size)
            if not len(at):
                continue
            codes, first = q.encode(x, BEAMS[level], early=level)
            own = np.ascontiguousarray(codes[:, 0])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at)),
                    pa.array(digests(x), pa.binary()),
                    pa.array([c.tobytes() for c in own], pa.binary()),
                    pa.array(np.linalg.norm(q.decode(own), axis=1).astype(np.float32)),
                    cells(own, first),
                ],
                ["id", "digest", "codes", "norm", "cells"],
            )

    return encode


def _finer(q: Quantiser, size: int, level: int):
    """(rep, digest, codes, norm, cells) again with cells of that level, from the vectors; rows are (rep, digest, codes, norm, vector)."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _own(b.column(4), b.column(1), size)
            if len(at):
                rows = [b.column(i).take(pa.array(at)) for i in range(4)]
                own = np.frombuffer(b"".join(rows[2].to_pylist()), np.uint8).reshape(-1, STAGES)
                yield pa.RecordBatch.from_arrays([*rows, cells(own, q.encode(x, 4 * BEAM, early=level)[1], 4 * BEAM)], ["rep", "digest", "codes", "norm", "cells"])

    return encode


def _own(vectors: pa.Array, of: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """matrix() of the vectors that have the digest beside them: an id may have come with several vectors."""
    at, x = matrix(vectors, size)
    same = np.array([d == of[int(i)].as_py() for d, i in zip(digests(x), at)], bool)
    return at[same], x[same]


def level_for(codes: np.ndarray, n: int) -> int:
    """How many codes name a cell: as few as leave most of n distinct vectors at most MEET others in their own cell, judged by a sample's codes.

    Most, not the average: a dense group must not deepen everybody's cells; _candidates makes the cells finer that it crowds.
    Vectors that even the deepest cells leave crowded don't count. Beyond DEEPEST codes too many near pairs would share no cell, so
    then cells grow, and those that are crowded are compared exactly.
    """
    met = []
    for level in range(DEEPEST + 1):
        _, cell, rows = np.unique(names(codes[:, :level]), return_inverse=True, return_counts=True)
        met.append((rows[cell] - 1) / max(len(codes) - 1, 1) * n)
    parted = met[-1] <= MEET
    for level, m in enumerate(met):
        if not parted.any() or np.median(m[parted]) <= MEET:
            return level
    return DEEPEST


def _pairs_in_cells(q: Quantiser, least: float):
    """Pairs of one cell whose estimated cosine is at least `least`; rows are (cell, block, id, codes, norm, kept)."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and block; what is held is one batch and the group that it breaks off in."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            cell, block = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero((cell != cell[-1]) | (block != block[-1]))[-1] + 1) if (cell[0], block[0]) != (cell[-1], block[-1]) else 0
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (cell[0], block[0]):
                yield from pairs(held)
                held = []
            if last:
                yield from pairs([*held, b.slice(0, last)])
                held = []
            held.append(b.slice(last))
        if held:
            yield from pairs(held)

    def pairs(whole: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(whole)
        cell, block, ids, kept = (t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "block", "id", "kept"))
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(-1, STAGES)
        norms = t["norm"].to_numpy()
        order = np.lexsort((~kept, block, cell))
        cell, block, ids, kept, codes, norms = cell[order], block[order], ids[order], kept[order], codes[order], norms[order]
        n = len(ids)
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])])
        start = np.flatnonzero(new)[np.cumsum(new) - 1]  # where each row's group begins
        group = np.cumsum(new) - 1
        n_kept = np.bincount(group, weights=kept).astype(np.int64)[group]
        partners = np.where(kept, np.arange(n) - start, n_kept)  # kept rows meet the kept ones before them, the others all kept ones
        large = n_kept >= WHOLE_GROUP
        for at in np.flatnonzero(new & large):
            end = at + int(np.searchsorted(group[at:], group[at], "right"))
            among = at + int(n_kept[at])  # kept rows come first
            sums = q.decode(codes[at:end]) / np.maximum(norms[at:end], 1e-6)[:, None]
            step = max(1, 2 * PAIRS_AT_ONCE // (among - at))
            for some in range(at, end, step):
                cos = sums[some - at : some - at + step] @ sums[: among - at].T
                i, j = np.nonzero(cos >= least)
                i, j = i + some, j + at
                fine = ((i >= among) | (j < i)) & (ids[i] != ids[j])
                a, b = ids[i[fine]], ids[j[fine]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        partners[large] = 0
        until = np.cumsum(partners)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            end = min(end, at + 20_000, n)
            rows = np.arange(at, end)[partners[at:end] > 0]
            at = end
            if not len(rows):
                continue
            for some in np.array_split(rows, max(1, len(rows) // 4000)):
                c = partners[some]
                left = np.repeat(np.arange(len(some)), c)
                right = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[some], c)
                tables = q.tables(q.decode(codes[some]))
                s = np.zeros(len(left), np.float32)
                for m in range(STAGES):
                    s += tables[left, m * CODEWORDS + codes[right, m].astype(np.int64)]
                s /= np.maximum(norms[some][left] * norms[right], 1e-12)
                a, b = ids[some][left], ids[right]
                hit = (s >= least) & (a != b)
                if hit.any():
                    a, b = a[hit], b[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return score


def _cosines(size: int, least: float):
    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            i, x = matrix(t.column(2), size)
            j, y = matrix(t.column(3), size)
            both, k, m = np.intersect1d(i, j, return_indices=True)
            cos = np.einsum("ij,ij->i", x[k].astype(np.float64), y[m].astype(np.float64))
            fine = cos >= least
            at = pa.array(both[fine])
            yield pa.RecordBatch.from_arrays([t.column(0).take(at), t.column(1).take(at), pa.array(cos[fine])], ["a", "b", "cosine"])

    return exact


def neighbours(vectors: DataFrame, k: int = 5, least: float = 0.92, size: int = 64) -> DataFrame:
    """(id, other_id, cosine): for every id its at most k most similar other ids with a cosine of at least `least`.

    vectors: (id, vector). Null, zero, non-finite vectors and those of another width have no neighbours and are none.
    Several rows of an id count once. Equal cosines are ordered by id, so of a group of exact copies (of any size) every
    member gets the k copies with the smallest ids. Exact copies are searched once, as a class.
    """
    vectors = vectors.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == size)).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    some, n = sample(vectors, size)
    q = Quantiser.train(some, STAGES, CODEWORDS)
    level = level_for(q.encode(some, BEAM)[0][:, 0], n)
    encoded = cut(vectors.mapInArrow(_encoder(q, size, level), "id long, digest binary, codes binary, norm float, cells array<long>"))
    classes = cut(encoded.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("codes").alias("codes"), F.first("norm").alias("norm"), F.first("cells").alias("cells")))
    pairs, dense = _candidates(classes, vectors, size, q, level, k, least)
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # one row an id: a row delivered twice would double its pairs
    needed = vectors.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("vector").alias("vector"))
    with_a = pairs.join(needed.select(F.col("id").alias("a"), F.col("vector").alias("va")), "a")
    with_b = with_a.join(needed.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b").select("a", "b", "va", "vb")
    exact = with_b.mapInArrow(_cosines(size, least), "a long, b long, cosine double")
    return _best(exact if dense is None else exact.unionByName(dense), encoded, classes, k)


def _candidates(classes: DataFrame, vectors: DataFrame, size: int, q: Quantiser, level: int, k: int, least: float) -> tuple[DataFrame, DataFrame | None]:
    """(a, b), a < b: class representatives that share a cell and may reach the cosine; and (a, b, cosine) of crowded cells or None.

    A cell that is crowded is named by one code more, DEEPEST at most, which its vectors are encoded for again. Vectors of a
    cell that still is crowded are compared with each other exactly.
    """
    live, rows, crowded, dense, kept = classes.select("rep", "digest", "codes", "norm", "cells"), None, None, None, KEPT[level]
    while True:
        looked = live.select("rep", "digest", "codes", "norm", F.posexplode("cells").alias("at", "cell"))
        if crowded is not None:  # only what lies in a cell that was crowded a level before
            parent = F.floor(F.col("cell") / F.lit(CODEWORDS)).cast("long")
            looked = looked.withColumn("parent", parent).join(crowded.select(F.col("cell").alias("parent")), "parent", "left_semi").drop("parent")
        crowded = cut(looked.where("at = 0").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS))
        part = looked.join(crowded.select("cell"), "cell", "left_anti").withColumn("level", F.lit(level)).withColumn("kept", F.col("at") < kept).drop("digest")
        rows = part if rows is None else rows.unionByName(part)
        if crowded.isEmpty():
            break
        inside = looked.join(crowded.select("cell"), "cell", "left_semi")
        if level == DEEPEST:
            dense = _dense(inside, crowded, vectors, size, k, least)
            break
        level, kept = level + 1, FINER_KEPT
        again = inside.select("rep", "digest", "codes", "norm").distinct().join(vectors.select(F.col("id").alias("rep"), "vector"), "rep").select("rep", "digest", "codes", "norm", "vector")
        live = cut(again.mapInArrow(_finer(q, size, level), "rep long, digest binary, codes binary, norm float, cells array<long>").dropDuplicates(["rep", "digest"]))
    rows = rows.select((F.col("cell") * (STAGES + 1) + F.col("level")).alias("cell"), F.lit(0).alias("block"), F.col("rep").alias("id"), "codes", "norm", "kept")
    scored = rows.repartition(width(classes.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(_pairs_in_cells(q, least - SLACK), "a long, b long")
    return cut(scored.distinct()), dense


def _dense(inside: DataFrame, crowded: DataFrame, vectors: DataFrame, size: int, k: int, least: float) -> DataFrame:
    """(a, b, cosine): for every vector that looks into a crowded cell its k nearest of those kept there, exactly.

    Vectors travel in blocks; each block of looking ones meets each block of kept ones once, spread over as many tasks as a
    cell has blocks of looking ones, and gives k rows a vector at most, never all pairs.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int")
    rows = inside.select("rep", "digest", "at", "cell").join(crowded.select("cell", blocks.alias("blocks")), "cell").join(vectors.select(F.col("id").alias("rep"), "vector"), "rep")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", "digest"), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        at, x = _own(t["vector"].combine_chunks(), t["digest"].combine_chunks(), size)
        ids, first = np.unique(t["rep"].to_numpy()[at], return_index=True)
        n = int(len(ids) > 0)
        return pa.table({"cell": t["cell"][:n], "block": t["block"][:n], "blocks": t["blocks"][:n], "ids": pa.array([ids.tolist()][:n], pa.list_(pa.int64())), "x": pa.array([x[first].tobytes()][:n], pa.binary())})

    schema = "cell long, block int, blocks int, ids array<long>, x binary"
    packed = lambda r: cut(r.select("cell", "block", "blocks", "rep", "digest", "vector").groupBy("cell", "block").applyInArrow(lambda t: pack(t), schema))
    kept, looking = packed(rows.where("at = 0")), packed(rows)
    spread = F.ceil(F.sqrt("blocks")).cast("int")
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), spread - 1))).select("cell", "salt", F.col("ids").alias("k_ids"), F.col("x").alias("k_x"))
    looking = looking.withColumn("salt", F.pmod("block", spread).cast("int")).select("cell", "salt", "ids", "x")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, k_ids, k_x in zip(*(b.column(c).to_pylist() for c in range(4))):
                ids, k_ids = np.array(ids), np.array(k_ids)
                cos = np.frombuffer(x, np.float32).reshape(-1, size).astype(np.float64) @ np.frombuffer(k_x, np.float32).reshape(-1, size).astype(np.float64).T
                cos[ids[:, None] == k_ids[None, :]] = -2
                last = np.partition(cos, -k, axis=1)[:, -k :][:, :1] if cos.shape[1] > k else np.full((len(ids), 1), -2.0)
                i, j = np.nonzero((cos >= last) & (cos >= least))
                order = np.lexsort((k_ids[j], -cos[i, j], i))
                i, j = i[order], j[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[top], j[top]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(k_ids[j]), pa.array(cos[i, j])], ["a", "b", "cosine"])

    return looking.join(kept, ["cell", "salt"]).select("ids", "x", "k_ids", "k_x").mapInArrow(meet, "a long, b long, cosine double")


def _best(exact: DataFrame, encoded: DataFrame, classes: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """The k best of every id from the exact pairs of class representatives and the classes' members."""
    multi = classes.where(F.col("rep") < F.col("last")).select("digest", "rep")
    members = encoded.select("digest", "id").join(multi, "digest").distinct()
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).where(F.col("r") <= k + 1)
    firsts = cut(ranked.groupBy("digest", "rep").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    spread = firsts.select("digest", "ids", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    copies = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(spread, ["digest", "salt"])
    copies = copies.select("id", F.explode(F.slice(F.array_except("ids", F.array("id")), 1, k)).alias("other_id"), F.lit(1.0).alias("cosine"))
    both = exact.select("a", "b", "cosine").unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    info = firsts.select("rep", "ids")
    both = both.join(info.select(F.col("rep").alias("a"), F.col("ids").alias("ia")), "a", "left").join(info.select(F.col("rep").alias("b"), F.col("ids").alias("ib")), "b", "left")
    both = both.select("cosine", F.coalesce("ia", F.array("a")).alias("ia"), F.slice(F.coalesce("ib", F.array("b")), 1, k).alias("ib")).where(F.size("ia") <= k)
    spread_pairs = both.select("cosine", F.explode("ia").alias("id"), "ib").select("id", F.explode("ib").alias("other_id"), "cosine").where("id <> other_id")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other_id")
    pairs = copies.unionByName(spread_pairs).groupBy("id", "other_id").agg(F.max("cosine").alias("cosine"))
    return pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")

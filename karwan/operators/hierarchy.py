"""Parent-child links to full hierarchies: roots, depths, rings, paths and descendants.

Weighted disjoint-set forests: every partition unites its own links in a forest whose weights are
the hops to the local top; what a top still points to outside its partition (its anchor) is the only
thing that the next level sees. Levels are merged until one bounded forest is left, then the results
are substituted downwards, one equi-join a level.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karwan.runtime import cut

#: Rows of a level that one task may hold; a larger level is first shortened by pointer doubling.
TOP_ROWS = 1_000_000

_STATE = "id long, anchor long, hops long, low long, last long, root long, depth long, seg array<long>"


class WeightedForest:
    """A disjoint-set forest over links child -> parent, each with a weight in hops.

    find() compresses paths and keeps, per node, the hops to its top and the smallest id on the way.
    A link that would lead back into its own set closes a ring; the ring's smallest id marks the set.
    """

    def __init__(self, ids: np.ndarray, parents: np.ndarray, has: np.ndarray, hops: np.ndarray, lows: np.ndarray, lasts: np.ndarray):
        self.ids, self.parents, self.has, self.weight, self.lasts = ids.tolist(), parents.tolist(), has.tolist(), hops.tolist(), lasts.tolist()
        self.seat = {x: i for i, x in enumerate(self.ids)}
        n = len(self.ids)
        self.up = list(range(n))  # a top is its own parent
        self.off = [0] * n
        self.own_low = lows.tolist()
        self.low = list(self.own_low)  # smallest id from the node up to, not including, what it points to
        self.ring: dict[int, int] = {}
        for i in range(n):
            if self.has[i] and (j := self.seat.get(self.parents[i])) is not None:
                self._unite(i, j)

    def find(self, i: int) -> int:
        trail = []
        while self.up[i] != i:
            trail.append(i)
            i = self.up[i]
        off, low = 0, None
        for j in reversed(trail):
            off += self.off[j]
            low = self.low[j] if low is None else min(low, self.low[j])
            self.up[j], self.off[j], self.low[j] = i, off, low
        return i

    def _unite(self, child: int, parent: int) -> None:
        top = self.find(parent)
        if top == child:
            low, j = self.own_low[child], parent
            while j != child:
                low = min(low, self.own_low[j])
                j = self.seat[self.parents[j]]
            self.ring[child] = low
        else:
            self.up[child], self.off[child], self.low[child] = parent, self.weight[child], self.own_low[child]

    @staticmethod
    def _piece(segments: list, i: int) -> list:
        return [] if segments[i] is None else list(segments[i])

    def rows(self, segments: list | None) -> Iterator[tuple]:
        """id, anchor, hops to it, smallest id on the way, last node before it, root, depth, segment."""
        for i, x in enumerate(self.ids):
            top = self.find(i)
            if top in self.ring:
                yield x, None, 0, 0, 0, self.ring[top], -1, None
                continue
            seg = None
            if segments is not None:
                seg, j = self._piece(segments, i), i
                while j != top:
                    j = self.seat[self.parents[j]]
                    seg += self._piece(segments, j)
            if self.has[top]:
                low = self.own_low[i] if i == top else min(self.low[i], self.own_low[top])
                yield x, self.parents[top], self.off[i] + self.weight[top], low, self.lasts[top], None, None, seg
            else:
                yield x, None, 0, 0, 0, self.ids[top], self.off[i], seg


def _forest(with_paths: bool):
    def unite(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        t = pd.concat(whole, ignore_index=True)
        del whole
        forest = WeightedForest(*(t[c].to_numpy() for c in ("id", "parent", "has", "hops", "low", "last")))
        names = ["id", "anchor", "hops", "low", "last", "root", "depth", "seg"]
        chunk = []
        for row in forest.rows(t["seg"].tolist() if with_paths else None):
            chunk.append(row)
            if len(chunk) == 50_000:
                yield pd.DataFrame(chunk, columns=names).astype({c: "Int64" for c in names[:-1]})
                chunk = []
        if chunk:
            yield pd.DataFrame(chunk, columns=names).astype({c: "Int64" for c in names[:-1]})

    return unite


def _links(df: DataFrame, with_paths: bool) -> DataFrame:
    """What the forest reads: a link's parent is given as a value and a flag, so that ids stay exact."""
    return df.select(
        "id", F.coalesce("anchor", F.lit(0)).alias("parent"), F.col("anchor").isNotNull().alias("has"),
        "hops", "low", "last", *(["seg"] if with_paths else []),
    )


def latest_links(rows: DataFrame, id_col: str, parent_col: str, order_cols: list[str]) -> DataFrame:
    """One row (id, parent) an id: the last in order_cols (nulls first); ties take the largest parent. Null ids are left out."""
    versions = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.struct(*[F.col(c) for c in order_cols], F.col(parent_col).cast("long").alias("parent")).alias("v"))
    return versions.groupBy("id").agg(F.max("v").alias("v")).select("id", F.col("v.parent").alias("parent"))


def resolve(links: DataFrame, with_paths: bool = False, top_rows: int = TOP_ROWS) -> DataFrame:
    """(id, root_id, depth[, path]) for links (id unique, parent nullable).

    * a null parent, or one that has no row, makes a root of depth 0;
    * on and below a ring (a node that is its own parent too) root_id is the ring's smallest id, depth -1
      and path null;
    * path holds the ids from the root down to the node itself;
    * an empty input gives an empty result.
    """
    base = links.select("id", F.col("parent").alias("anchor"), F.lit(1).cast("long").alias("hops"), F.col("id").alias("low"), F.col("id").alias("last"), F.array("id").alias("seg"))
    levels = [cut(_links(base, with_paths).mapInPandas(_forest(with_paths), _STATE))]
    while True:
        below = levels[-1]
        wanted = below.where("anchor is not null").select("anchor").distinct()
        part = below.join(wanted.select(F.col("anchor").alias("id")), "id", "left_semi")
        # an anchor without a row drops out here: what points to it is a root
        part = cut(part)
        n = part.count()
        if n <= top_rows:
            break
        levels.append(_shorten(part, with_paths))
        if len(levels) > 2 + int(np.ceil(np.log2(n + 1))):  # every path is used up: only rings are left
            part = _rings_only(levels.pop())
            return _substitute(levels, part, with_paths)
    top = _links(part, with_paths).coalesce(1).mapInPandas(_forest(with_paths), _STATE)
    return _substitute(levels, _finish(top, part.where("anchor is null")), with_paths)


def _finish(top: DataFrame, settled: DataFrame) -> DataFrame:
    """Results of the topmost forest: (id, root, depth, seg). Its tops are settled nodes or links into nothing."""
    tops = settled.select(F.col("id").alias("top_id"), F.col("root").alias("top_root"), F.col("depth").alias("top_depth"), F.col("seg").alias("top_seg"))
    ended = top.withColumn("top_id", F.when(F.col("anchor").isNull() & (F.col("depth") >= 0), F.col("root")))
    return ended.join(tops, "top_id", "left").select(
        "id",
        F.coalesce("top_root", F.when(F.col("anchor").isNotNull(), F.col("last")).otherwise(F.col("root"))).alias("root"),
        F.when(F.col("top_depth") < 0, F.lit(-1)).when(F.col("top_depth").isNotNull(), F.col("depth") + F.col("top_depth")).when(F.col("anchor").isNotNull(), F.col("hops") - 1).otherwise(F.col("depth")).cast("long").alias("depth"),
        "seg",
    )


def _shorten(part: DataFrame, with_paths: bool) -> DataFrame:
    """One step of pointer doubling over a level that is too large for one task."""
    to = part.select(*[F.col(c).alias("n_" + c) for c in ("id", "anchor", "hops", "low", "last", "root", "depth", "seg")])
    j = part.join(to, F.col("anchor") == F.col("n_id"), "left")
    open_, hit = F.col("anchor").isNotNull(), F.col("n_id").isNotNull()
    ended = open_ & hit & F.col("n_root").isNotNull()
    seg = F.when(open_ & hit & (F.coalesce("n_depth", F.lit(0)) >= 0), F.concat("seg", "n_seg")).otherwise(F.col("seg"))
    return cut(j.select(
        "id",
        F.when(open_ & hit & ~ended, F.col("n_anchor")).alias("anchor"),
        F.when(open_ & hit & ~ended, F.col("hops") + F.col("n_hops")).otherwise(F.lit(0)).cast("long").alias("hops"),
        F.when(open_ & hit & ~ended, F.least("low", "n_low")).otherwise(F.lit(0)).cast("long").alias("low"),
        F.when(open_ & hit & ~ended, F.col("n_last")).otherwise(F.lit(0)).cast("long").alias("last"),
        F.when(~open_, F.col("root")).when(~hit, F.col("last")).when(ended, F.col("n_root")).cast("long").alias("root"),
        F.when(~open_, F.col("depth")).when(~hit, F.col("hops") - 1).when(ended & (F.col("n_depth") < 0), F.lit(-1)).when(ended, F.col("hops") + F.col("n_depth")).cast("long").alias("depth"),
        seg.alias("seg") if with_paths else F.lit(None).cast("array<long>").alias("seg"),
    ))


def _rings_only(level: DataFrame) -> DataFrame:
    """After enough doublings a node that is still open points at a node of its ring, whose low is the ring's smallest id."""
    ring = level.select(F.col("id").alias("r_id"), F.col("low").alias("r_low"))
    return level.join(ring, F.col("anchor") == F.col("r_id"), "left").select("id", F.coalesce("r_low", "root").alias("root"), F.when(F.col("r_low").isNotNull(), F.lit(-1)).otherwise(F.col("depth")).cast("long").alias("depth"), "seg")


def _substitute(levels: list[DataFrame], known: DataFrame, with_paths: bool) -> DataFrame:
    known = cut(known)
    for level in reversed(levels):
        up = known.select(F.col("id").alias("u_id"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"), F.col("seg").alias("u_seg"))
        j = level.join(up, F.col("anchor") == F.col("u_id"), "left")
        open_, hit = F.col("anchor").isNotNull(), F.col("u_id").isNotNull()
        known = j.select(
            "id",
            F.when(~open_, F.col("root")).when(hit, F.col("u_root")).otherwise(F.col("last")).alias("root"),
            F.when(~open_, F.col("depth")).when(hit & (F.col("u_depth") < 0), F.lit(-1)).when(hit, F.col("hops") + F.col("u_depth")).otherwise(F.col("hops") - 1).cast("long").alias("depth"),
            F.when(open_ & hit, F.concat("seg", "u_seg")).otherwise(F.col("seg")).alias("seg"),
        )
    out = [F.col("id"), F.col("root").alias("root_id"), F.col("depth")]
    return known.select(*out, *([F.when(F.col("depth") >= 0, F.reverse("seg")).alias("path")] if with_paths else []))


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for every node and each node above it, from resolve(with_paths=True).

    One row a pair, so that no task ever holds all descendants of a root; nodes on or below rings have none.
    """
    return (
        paths.where("depth > 0")
        .select(F.col("id").alias("descendant_id"), "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "ancestor_id"))
        .select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).cast("long").alias("distance"))
    )


def rings(resolved: DataFrame, links: DataFrame) -> DataFrame:
    """(ring_id, n_caught): each ring by its smallest id, with the number of nodes on it or below it."""
    return resolved.where("depth = -1").groupBy(F.col("root_id").alias("ring_id")).agg(F.count("*").alias("n_caught"))

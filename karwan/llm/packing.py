"""Filling fixed-capacity containers with texts: first-fit decreasing in randomised groups.

In a group the items go, longest first, into the first container with room; a tournament tree over the containers'
free space finds it in logarithmic time. Groups are drawn by hash, so that each has the whole mix of lengths.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a group on average: enough that the last containers of a group don't count, few enough for one task.
GROUP_ITEMS = 20_000


class Tournament:
    """A binary tree of the largest free space below each node; leaves are containers in the order of their opening."""

    def __init__(self, leaves: int):
        self.size = 1
        while self.size < max(1, leaves):
            self.size *= 2
        self.best = [0] * (2 * self.size)

    def set(self, leaf: int, free: int) -> None:
        i = self.size + leaf
        best = self.best
        best[i] = free
        i >>= 1
        while i:
            a, b = best[2 * i], best[2 * i + 1]
            best[i] = a if a >= b else b
            i >>= 1

    def first(self, need: int) -> int:
        """The first leaf with at least that much room, or -1."""
        best = self.best
        if best[1] < need:
            return -1
        i = 1
        while i < self.size:
            i *= 2
            if best[i] < need:
                i += 1
        return i - self.size


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item; items keep their order where sizes are equal."""
    tree, placed, opened = Tournament(len(sizes)), [0] * len(sizes), 0
    free: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.first(sizes[i])
        if at < 0:
            at, opened = opened, opened + 1
            free.append(capacity)
        free[at] -= sizes[i]
        tree.set(at, free[at])
        placed[i] = at
    return placed


def pack(items: DataFrame, capacities: list[tuple[str, int]], seed: int = 3, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_kind, capacity_tokens, container_id, doc_id, start_token, end_token) for every kind of container.

    items: (doc_id, n_tokens). Every item with tokens is packed whole into one container of each kind; only one that is longer
    than the capacity is cut, into full containers and a rest that is packed like an item. Items without tokens (null or
    zero) take no room and are in none. Repeated rows are items of their own. Capacities must be positive.
    """
    if any(c is None or c <= 0 for _, c in capacities):
        raise ValueError("capacities must be positive")
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity_tokens")) for k, c in capacities])
    live = items.where("n_tokens > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))
    groups = max(1, -(-live.count() // group_items))
    each = live.withColumn("kind", F.explode(kinds)).select("doc_id", "n_tokens", "kind.*")
    full = (F.col("n_tokens") / F.col("capacity_tokens")).cast("long")
    whole = each.where(F.col("n_tokens") >= F.col("capacity_tokens")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)))
    whole = whole.select(
        "container_kind", "capacity_tokens", F.concat_ws("-", F.lit("whole"), "doc_id", "piece", F.monotonically_increasing_id()).alias("container_id"), "doc_id",
        (F.col("piece") * F.col("capacity_tokens")).alias("start_token"), ((F.col("piece") + 1) * F.col("capacity_tokens")).alias("end_token"),
    )
    start = full * F.col("capacity_tokens")
    rest = each.withColumn("start_token", start).withColumn("size", F.col("n_tokens") - start).where("size > 0")
    rest = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))

    def fill(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["size", "doc_id", "start_token"], ascending=[False, True, True])
        at = first_fit_decreasing(t["size"].tolist(), int(key[1]))
        return pd.DataFrame({
            "container_kind": key[0], "capacity_tokens": key[1], "container_id": [f"{key[2]}-{x}" for x in at], "doc_id": t["doc_id"],
            "start_token": t["start_token"], "end_token": t["start_token"] + t["size"],
        })

    schema = "container_kind string, capacity_tokens int, container_id string, doc_id long, start_token long, end_token long"
    packed = rest.groupBy("container_kind", "capacity_tokens", "group").applyInPandas(fill, schema)
    return packed.unionByName(whole)


def report(packed: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, n_containers, n_tokens, unused_share) per kind of container."""
    bins = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("used"))
    per = bins.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))
    return per.withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))

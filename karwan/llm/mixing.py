"""Mixing overlapping sources to target weights by a min-cost flow.

Texts are aggregated by the set of sources that hold them. The flow runs from the uses of each such set (every
further use costs more) to the sources' quotas; its solution says how many tokens of each set go to which source at
which repetition. The texts of a set lie in a seeded order on a line of tokens, and each part of the flow takes a stretch of it.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karwan.runtime import cut

#: Parts of a set's line whose sums are formed before texts are ordered inside a part.
BUCKETS = 16_384
#: A text is long for a stretch if it fills more than one in so many parts of it.
FINE = 50


class Flow:
    """Successive shortest paths with potentials; amounts and costs are whole numbers, costs not negative."""

    def __init__(self, nodes: int):
        self.out: list[list[list]] = [[] for _ in range(nodes)]  # [to, room, cost, index of the way back]

    def add(self, a: int, b: int, room: int, cost: int) -> list:
        arc = [b, room, cost, len(self.out[b])]
        self.out[a].append(arc)
        self.out[b].append([a, 0, -cost, len(self.out[a]) - 1])
        return arc

    def run(self, s: int, t: int) -> int:
        n, total = len(self.out), 0
        height = [0] * n
        while True:
            dist, via = [math.inf] * n, [None] * n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for arc in self.out[a]:
                    if arc[1] > 0 and d + arc[2] + height[a] - height[arc[0]] < dist[arc[0]]:
                        dist[arc[0]] = d + arc[2] + height[a] - height[arc[0]]
                        via[arc[0]] = (a, arc)
                        heapq.heappush(heap, (dist[arc[0]], arc[0]))
            if dist[t] == math.inf:
                return total
            height = [h + d if d < math.inf else h for h, d in zip(height, dist)]
            room, a = math.inf, t
            while a != s:
                a, arc = via[a]
                room = min(room, arc[1])
            a = t
            while a != s:
                b = a
                a, arc = via[a]
                arc[1] -= room
                self.out[b][arc[3]][1] += room
            total += room


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[int, dict[tuple, int]]:
    """Tokens that reach their quota and {(pattern, use, source): tokens}. A text's uses, over all sources, are at most
    the smallest max_repeats of the sources that hold it; the k-th use costs k * k."""
    names = list(targets)
    sets = [(p, n) for p, n in patterns.items() if n > 0]
    flow = Flow(2 + len(names) + len(sets) * (1 + max((t[1] for t in targets.values()), default=1)))
    at = 2 + len(names)
    arcs: dict[tuple, list] = {}
    for p, n in sets:
        for use in range(1, min(targets[s][1] for s in p) + 1):
            flow.add(0, at, n, use * use)
            for s in p:
                arcs[p, use, s] = flow.add(at, 2 + names.index(s), n, 0)
            at += 1
    room = {k: a[1] for k, a in arcs.items()}
    for i, s in enumerate(names):
        flow.add(2 + i, 1, int(round(targets[s][0] * total)), 0)
    reached = flow.run(0, 1)
    return reached, {k: room[k] - a[1] for k, a in arcs.items() if room[k] > a[1]}


def largest_total(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest mixture in which every source with texts has its quota filled."""
    full = {s for p in patterns for s in p}
    live = {s: t for s, t in targets.items() if s in full and t[0] > 0}
    if not live:
        return 0
    high = int(min(sum(n * t[1] for p, n in patterns.items() if s in p) / t[0] for s, t in live.items()))
    low = 0
    while high - low > max(1, high // 10_000):
        mid = (low + high + 1) // 2
        quota = sum(int(round(t[0] * mid)) for t in live.values())
        low, high = (mid, high) if route(patterns, live | {s: t for s, t in targets.items() if s not in live}, mid)[0] >= quota else (low, mid - 1)
    return low


def mix(documents: DataFrame, targets: list[tuple[str, float, int]], total: int | None = None, seed: int = 9) -> DataFrame:
    """(source, doc_id, use_no, n_tokens): the mixture, one row for every use of a text.

    documents: (doc_id, source, text_key, n_tokens); equal text_keys are one text, whichever sources hold it. A text's uses, in
    all sources together, number at most the smallest max_repeats of the sources that hold it. total defaults to the largest
    mixture in which every source with texts reaches its share; a source without texts stays empty. Texts without tokens
    (null or zero) and rows with a null source or one without a target are left out. targets is a small table; max_repeats
    under 1 or a null or negative share leaves a source out. The choice depends on the seed and the texts alone.
    """
    wanted = {s: (float(x), int(r)) for s, x, r in targets if s is not None and x is not None and x > 0 and r is not None and r >= 1}
    spark = documents.sparkSession
    rows = documents.where((F.col("n_tokens") > 0) & F.col("source").isin(list(wanted)))
    held = rows.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = held.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("at"), F.max("n_tokens").alias("n_tokens"))
    texts = cut(texts.withColumn("pattern", F.transform("at", lambda x: x["source"])))
    # at most one row for every set of sources
    patterns = {tuple(r.pattern): int(r.n) for r in texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()}
    goal = largest_total(patterns, wanted) if total is None else total
    parts = route(patterns, wanted, goal)[1]
    stretches, upto = [], {}
    for (p, use, s), n in sorted(parts.items()):
        a = upto.get((p, use), 0)
        upto[p, use] = a + n
        stretches.append((list(p), (use, s, a, a + n)))
    by_pattern: dict[tuple, list] = {}
    for p, x in stretches:
        by_pattern.setdefault(tuple(p), []).append(x)
    plan = spark.createDataFrame([(list(p), x) for p, x in by_pattern.items()], "pattern array<string>, takes array<struct<use:int,source:string,start:long,stop:long>>")
    # one row for every set of sources; texts that are long for the shortest stretch come later, the longest
    # last, so that the ends stay fine
    keyed = texts.join(F.broadcast(plan), "pattern").withColumn("h", F.xxhash64("text_key", F.lit(seed)))
    fill = F.col("n_tokens") * FINE / F.array_min(F.transform("takes", lambda x: x["stop"] - x["start"]))
    keyed = keyed.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)) + F.greatest(F.ceil(F.log2(fill)), F.lit(0)) * BUCKETS)
    sums = keyed.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("pattern", "bucket", before.alias("base"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("h", "text_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the middle of a text decides, so that what one stretch loses at its ends another gains
    lined = keyed.withColumn("inner", inner).join(starts, ["pattern", "bucket"]).withColumn("middle", F.col("base") + F.col("inner") + F.col("n_tokens") / 2)
    used = lined.withColumn("take", F.explode(F.filter("takes", lambda x: (x["start"] <= F.col("middle")) & (F.col("middle") < x["stop"]))))
    doc = F.filter("at", lambda x: x["source"] == F.col("take.source"))[0]["doc_id"]
    return used.select(F.col("take.source").alias("source"), doc.alias("doc_id"), F.col("take.use").alias("use_no"), "n_tokens")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_uses, n_tokens, actual_share) for every row of the targets."""
    got = mixture.groupBy("source").agg(F.count("*").alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))
    both = targets.select("source", "target_share").join(got, "source", "left").na.fill(0, ["n_uses", "n_tokens"])
    total = F.sum("n_tokens").over(Window.partitionBy())
    return both.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0))

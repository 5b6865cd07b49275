"""Entity resolution: exact and fuzzy merging, components, linkage, review decisions, slugs and back-filling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karwan.functions import similarity as S
from karwan.functions import text as T
from karwan.runtime import cut


def exact_merge(values: DataFrame, key: Column) -> DataFrame:
    """(value, n, key, representative, merged): values(value, n) by equal key; the most frequent value stands for the rest, ties by spelling."""
    w = Window.partitionBy("key")
    first = F.first("value").over(w.orderBy(F.desc("n"), "value"))
    return values.withColumn("key", key).withColumn("representative", first).withColumn("merged", F.count("*").over(w) > 1)


def similar_keys(keys: DataFrame, cutoff: float) -> DataFrame:
    """(a, b, score), a < b: keys(key) whose sorted words have an Indel ratio of at least cutoff."""
    sorted_ = keys.select("key").distinct().withColumn("s", S.sorted_words(F.col("key")))
    pairs = S.similar_pairs(sorted_.select(F.col("s").alias("l")), sorted_.select(F.col("s").alias("r")), cutoff)
    a, b = sorted_.select(F.col("key").alias("a"), F.col("s").alias("l")), sorted_.select(F.col("key").alias("b"), F.col("s").alias("r"))
    return pairs.join(a, "l").join(b, "r").where("a < b").select("a", "b", "score")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node is linked with, by alternating large and small stars.

    edges: (a, b), any direction, repeated edges and loops allowed. Each round is two joins-free aggregations; the number
    of rounds grows with the logarithm of the longest chain. Lineage is cut every round. Links that the last round still
    changed are an error.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small)
        if after.count() == links.count() and after.exceptAll(links).isEmpty():
            break
        links = after
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return nodes.join(links.groupBy("u").agg(F.min("v").alias("v")), nodes["node"] == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def complete_linkage(edges: DataFrame) -> DataFrame:
    """(node, cluster): greedy complete linkage inside each connected component; cluster is its smallest node.

    edges: (a, b, score) at or over the cutoff; pairs that are missing lie under it. The pair of clusters with the highest
    smallest cross score is merged first, ties by their smallest nodes. One task works on a component; chains of near values can make
    a component long, and the work grows with the square of its links at worst.
    """
    parts = components(edges.select("a", "b"))
    tagged = edges.join(parts.select(F.col("node").alias("a"), "component"), "a")

    def link(t: pd.DataFrame) -> pd.DataFrame:
        score = {}
        for a, b, s in zip(t["a"], t["b"], t["score"]):
            score[min(a, b), max(a, b)] = s
        groups = {x: [x] for x in sorted({*t["a"], *t["b"]})}
        cross = dict(score)
        while cross:
            (a, b), _ = min(cross.items(), key=lambda kv: (-kv[1], kv[0]))
            groups[a] += groups.pop(b)
            fresh = {}
            for x in groups:
                if x != a:
                    one, two = cross.get((min(x, a), max(x, a))), cross.get((min(x, b), max(x, b)))
                    if one is not None and two is not None:
                        fresh[min(x, a), max(x, a)] = min(one, two)
            cross = {k: v for k, v in cross.items() if a not in k and b not in k} | fresh
        return pd.DataFrame([(x, k) for k, g in groups.items() for x in g], columns=["node", "cluster"])

    kind = edges.schema["a"].dataType.simpleString()
    return tagged.groupBy("component").applyInPandas(link, f"node {kind}, cluster {kind}")


def review_gate(needs_review: Column, decision: Column) -> Column:
    """apply, reject or pending."""
    d = F.lower(F.btrim(F.coalesce(decision, F.lit(""))))
    return F.when(~needs_review, "apply").when(d == "approve", "apply").when(d == "reject", "reject").otherwise("pending")


def require_decided(rows: DataFrame, gate_col: str = "gate") -> DataFrame:
    """rows, or an error that counts the pending ones."""
    n = rows.where(F.col(gate_col) == "pending").count()
    if n:
        raise ValueError(f"{n} rows wait for a decision")
    return rows


def collapse_slugs(assigned: DataFrame) -> DataFrame:
    """(slug, display, n): assignments(slug, display, ord) with one slug become one; the last display name wins."""
    return assigned.groupBy("slug").agg(F.max_by("display", "ord").alias("display"), F.count("*").alias("n"))


def coalesce_alias(rows: DataFrame, aliases: DataFrame, first: str, second: str, out: str) -> DataFrame:
    """rows with `out`: what the first column's alias stands for, else the second's; aliases(raw_value, target). Unknown ones give null."""
    a = aliases.groupBy("raw_value").agg(F.min("target").alias("target"))
    one = a.select(F.col("raw_value").alias(first), F.col("target").alias("t1__"))
    two = a.select(F.col("raw_value").alias(second), F.col("target").alias("t2__"))
    return rows.join(one, first, "left").join(two, second, "left").withColumn(out, F.coalesce("t1__", "t2__")).drop("t1__", "t2__")


def upsert(existing: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """existing with the rows of new put in or over it; of several new rows with one key the last by `ord` counts."""
    last = new.groupBy(key).agg(F.max(F.struct("ord", *values)).alias("n"))
    both = existing.select(key, *values).join(last, key, "full")
    return both.select(key, *[F.when(F.col("n").isNotNull(), F.col(f"n.{v}")).otherwise(F.col(v)).alias(v) for v in values])


def brand_values(products: DataFrame, cols: list[str]) -> DataFrame:
    """(value, n): how many rows hold each value in any of the columns; blanks left out."""
    pairs = products.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("value")).where("trim(value) <> ''")
    return pairs.groupBy("value").agg(F.count("*").alias("n"))


def canonical_values(values: DataFrame, cutoff: float = 90.0, sure: float = 97.0) -> DataFrame:
    """(value, n, method, cluster, needs_review): junk, exact merges, then complete linkage of what is left within a script.

    method is junk_excluded, exact_auto_merge, fuzzy_candidate or singleton_unique.
    """
    junk = T.is_placeholder_brand(F.col("value"))
    live = exact_merge(values.where(~junk), T.normalize(F.col("value")))
    single = live.where(~F.col("merged")).withColumn("arabic", T.is_arabic(F.col("key")))
    edges = similar_keys(single.select("key"), cutoff)
    arab = lambda c: T.is_arabic(F.col(c))
    edges = edges.where(arab("a") == arab("b"))
    linked = complete_linkage(edges)
    sizes = linked.groupBy("cluster").agg(F.count("*").alias("size"))
    low = edges.join(linked.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a").join(linked.select(F.col("node").alias("b"), F.col("cluster").alias("cb")), "b").where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.min("score").alias("confidence"))
    fuzzy = linked.join(sizes, "cluster").where("size > 1").join(low, "cluster").select(F.col("node").alias("key"), "cluster", "confidence")
    out = live.join(fuzzy, "key", "left").select(
        "value", "n", F.when(F.col("merged"), "exact_auto_merge").when(F.col("cluster").isNotNull(), "fuzzy_candidate").otherwise("singleton_unique").alias("method"),
        F.coalesce("cluster", "key").alias("cluster"), F.coalesce(F.col("confidence") < sure, F.lit(False)).alias("needs_review"),
    )
    return out.unionByName(values.where(junk).select("value", "n", F.lit("junk_excluded").alias("method"), F.lit(None).cast("string").alias("cluster"), F.lit(True).alias("needs_review")))


def canonical_categories(categories: DataFrame, links: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """(id, norm, method, group_id, slug, display_en, display_ar, confidence, needs_review), one row a category.

    categories: (id, name_en, name_ar), one row an id; links: (category_id). Test entries are junk, equal normalised names are
    merged, and what is left is linked completely over the names' sorted words. Of a group the category with most links stands
    for it, ties by the smaller id; confidence is the least similarity to it. Junk and linked ones need a review. group_id is the
    group's smallest id, null without a group.
    """
    n = links.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n"))
    rows = categories.select("id", "name_en", "name_ar", T.normalize_latin(F.coalesce("name_en", F.lit(""))).alias("norm")).join(n, "id", "left").na.fill(0, ["n"])
    rows = cut(rows.withColumn("junk", T.is_test_category(F.col("norm"))))
    live = rows.where("not junk")
    lead = F.max(F.struct("n", (-F.col("id")).alias("m"), "name_en", "name_ar", "norm"))
    sizes = live.groupBy("norm").agg(F.count("*").alias("k"), F.min("id").alias("group_id"), lead.alias("lead"))
    merged = live.join(sizes.where("k > 1"), "norm").select("id", "norm", F.lit("exact_auto_merge").alias("method"), "group_id", "lead", F.lit(100.0).alias("confidence"))
    single = live.join(sizes.where("k = 1").select("norm"), "norm", "left_semi")
    linked = complete_linkage(cut(similar_keys(single.select(F.col("norm").alias("key")), cutoff)))
    many = linked.join(linked.groupBy("cluster").agg(F.count("*").alias("k")).where("k > 1"), "cluster").select(F.col("node").alias("norm"), "cluster")
    grouped = single.join(many, "norm")
    tops = grouped.groupBy("cluster").agg(F.min("id").alias("group_id"), lead.alias("lead"))
    scored = grouped.join(tops, "cluster").withColumn("s", S.token_sort_ratio(F.col("norm"), F.col("lead.norm")))
    least = scored.groupBy("cluster").agg(F.round(F.min("s"), 1).alias("confidence"))
    fuzzy = scored.join(least, "cluster").select("id", "norm", F.lit("fuzzy_candidate").alias("method"), "group_id", "lead", "confidence")
    alone = single.join(many.select("norm"), "norm", "left_anti").select("id", "norm", F.lit("singleton_unique").alias("method"), F.lit(None).cast("long").alias("group_id"), F.struct("n", (-F.col("id")).alias("m"), "name_en", "name_ar", "norm").alias("lead"), F.lit(100.0).alias("confidence"))
    named = merged.unionByName(fuzzy).unionByName(alone)
    out = named.select("id", "norm", "method", F.col("group_id").cast("long").alias("group_id"), T.slugify(F.col("lead.name_en")).alias("slug"), F.col("lead.name_en").alias("display_en"), F.col("lead.name_ar").alias("display_ar"), "confidence", (F.col("method") == "fuzzy_candidate").alias("needs_review"))
    junk = rows.where("junk").select("id", "norm", F.lit("junk_excluded").alias("method"), F.lit(None).cast("long").alias("group_id"), *[F.lit(None).cast("string").alias(c) for c in ("slug", "display_en", "display_ar")], F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("needs_review"))
    return out.unionByName(junk)


def apply_reviews(rows: DataFrame) -> DataFrame:
    """(id, outcome, slug, display_en, display_ar) of reviewed canonical_categories() with name_en, name_ar and decision.

    outcome is assigned, junk or pending. Junk follows its own decision: approved it is junk, rejected it stands alone. A linked
    group is merged if all its rows are approved, falls apart if any is rejected, and waits otherwise. What stands alone gets its
    slug with its id. pending rows make require_decided() raise before anything is written.
    """
    d = F.lower(F.btrim(F.coalesce("decision", F.lit(""))))
    group = rows.where("method = 'fuzzy_candidate' and needs_review").groupBy("group_id").agg(F.min(d == "approve").alias("all_yes"), F.max(d == "reject").alias("any_no"))
    j = rows.join(group, "group_id", "left")
    linked = (F.col("method") == "fuzzy_candidate") & F.col("needs_review")
    gate = F.when(F.col("method") == "junk_excluded", review_gate(F.col("needs_review"), F.col("decision"))).when(linked & F.col("all_yes"), "apply").when(linked & F.col("any_no"), "reject").when(linked, "pending").otherwise("apply")
    j = j.withColumn("gate", gate)
    junk = F.col("method") == "junk_excluded"
    alone = (F.col("gate") == "reject") | (F.col("method") == "singleton_unique")
    base = F.when(F.col("method") == "singleton_unique", F.col("slug")).otherwise(F.col("norm"))
    shown = lambda own, lead: F.when(F.col("outcome") == "assigned", F.when(alone, F.col(own)).otherwise(F.col(lead)))
    j = j.withColumn("outcome", F.when(F.col("gate") == "pending", "pending").when(junk & (F.col("gate") == "apply"), "junk").otherwise("assigned"))
    slug = F.when(F.col("outcome") == "assigned", F.when(alone, F.concat_ws("_", base, F.col("id").cast("string"))).otherwise(F.col("slug")))
    return j.select("id", "outcome", slug.alias("slug"), shown("name_en", "display_en").alias("display_en"), shown("name_ar", "display_ar").alias("display_ar"))


def survivors(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, survivor): keys(key, script) that pairs(a, b) of one record link, directly or over others, become one.

    The smallest Latin key of a component survives, the smallest of all if it has none; a key without a link is its own. (The
    first in order of arrival is not defined on a cluster.)
    """
    parts = components(pairs.select("a", "b")).withColumnRenamed("node", "key")
    tagged = keys.select("key", "script").distinct().join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    best = tagged.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("script") == "latin", F.col("key"))), F.min("key")).alias("survivor"))
    return tagged.join(best, "component").select("key", "survivor").distinct()

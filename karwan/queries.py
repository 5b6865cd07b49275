"""Queries of the core operators and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karwan.operators import hierarchy, references
from karwan.plans import catalogue, flows, texts
from karwan.runtime import table


def _category_links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.latest_links(table(spark, d, "category"), "id", "parent_category_id", ["updated_at"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    r = hierarchy.resolve(_category_links(spark, d))
    return r.select(F.col("id").alias("category_id"), "root_id", F.col("depth").alias("tree_depth"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    r = hierarchy.resolve(_category_links(spark, d), with_paths=True)
    return r.select(F.col("id").alias("category_id"), "root_id", F.col("depth").alias("tree_depth"), F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("id_path")).withColumn("id_path", F.when(F.col("tree_depth") >= 0, F.col("id_path")))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve(_category_links(spark, d), with_paths=True))


def p5_rings(spark: SparkSession, d: str) -> DataFrame:
    links = _category_links(spark, d)
    return hierarchy.rings(hierarchy.resolve(links), links)


def _orphan_inputs(spark: SparkSession, d: str) -> tuple:
    targets = [references.Target("product_id", table(spark, d, "product"), "product"), references.Target("category_id", table(spark, d, "category"), "category")]
    return table(spark, d, "product_category"), targets, table(spark, d, "deletion_log")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_links(*_orphan_inputs(spark, d)).distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(*_orphan_inputs(spark, d)).withColumn("month", F.date_format("month", "yyyy-MM"))


_TREE_SQL = """
WITH RECURSIVE v AS (SELECT id, parent_category_id AS parent, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, parent_category_id DESC NULLS LAST) AS rn FROM category WHERE id IS NOT NULL),
n AS (SELECT id, parent FROM v WHERE rn = 1),
down AS (
  SELECT id, id AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS id_path FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
  UNION ALL SELECT n.id, d.root_id, d.depth + 1, d.id_path || '/' || CAST(n.id AS VARCHAR) FROM n JOIN down d ON n.parent = d.id),
caught AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM down)),
walk AS (SELECT id, parent AS node FROM caught UNION SELECT w.id, c.parent FROM walk w JOIN caught c ON c.id = w.node),
on_ring AS (SELECT id FROM walk WHERE id = node),
ringed AS (SELECT w.id, min(w.node) AS root_id FROM walk w WHERE w.node IN (SELECT id FROM on_ring) GROUP BY w.id),
tree AS (SELECT id, root_id, depth, id_path FROM down UNION ALL SELECT id, root_id, -1, NULL FROM ringed)
"""

_ORPHAN_SQL = """
WITH refs AS (
  SELECT id AS link_id, 'product_id' AS f, product_id AS k, created_at AS seen FROM product_category WHERE product_id IS NOT NULL
  UNION ALL SELECT id, 'category_id', category_id, created_at FROM product_category WHERE category_id IS NOT NULL),
rows_ AS (
  SELECT 'product_id' AS f, id AS k, coalesce(max(updated_at), max(created_at)) AS fresh, min(created_at) AS born FROM product GROUP BY id
  UNION ALL SELECT 'category_id', id, coalesce(max(updated_at), max(created_at)), min(created_at) FROM category GROUP BY id),
gone AS (SELECT entity || '_id' AS f, record_id AS k, max(deleted_at) AS gone_at FROM deletion_log GROUP BY 1, 2),
judged AS (
  SELECT r.link_id, r.f AS ref_field, r.seen, CASE
    WHEN w.k IS NULL AND g.k IS NULL THEN 'missing'
    WHEN g.k IS NOT NULL AND (w.k IS NULL OR w.fresh IS NULL OR g.gone_at >= w.fresh) THEN 'deleted'
    WHEN w.born > r.seen THEN 'late' END AS ref_state
  FROM refs r LEFT JOIN rows_ w ON w.f = r.f AND w.k = r.k LEFT JOIN gone g ON g.f = r.f AND g.k = r.k)
"""

QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants, "p5_rings": p5_rings, "p6_found": p6_found, "p6_counts": p6_counts} | texts.QUERIES | catalogue.QUERIES | flows.QUERIES

SQL = {
    "p5_found": _TREE_SQL + "SELECT id AS category_id, root_id, CAST(depth AS BIGINT) AS tree_depth FROM tree",
    "p5_paths": _TREE_SQL + "SELECT id AS category_id, root_id, CAST(depth AS BIGINT) AS tree_depth, id_path FROM tree",
    "p5_rings": _TREE_SQL + "SELECT root_id AS ring_id, count(*) AS n_caught FROM tree WHERE depth = -1 GROUP BY root_id",
    "p5_descendants": _TREE_SQL + ", up AS (SELECT id AS descendant_id, parent AS ancestor_id, CAST(1 AS BIGINT) AS distance FROM n WHERE id IN (SELECT id FROM down WHERE depth > 0) UNION ALL SELECT u.descendant_id, n.parent, u.distance + 1 FROM up u JOIN n ON n.id = u.ancestor_id WHERE n.id IN (SELECT id FROM down WHERE depth > 0)) SELECT ancestor_id, descendant_id, distance FROM up",
    "p6_found": _ORPHAN_SQL + "SELECT DISTINCT link_id, ref_field, ref_state FROM judged WHERE ref_state IS NOT NULL",
    "p6_counts": _ORPHAN_SQL + "SELECT ref_field, strftime(seen, '%Y-%m') AS month, ref_state, count(*) AS n_refs FROM judged WHERE ref_state IS NOT NULL GROUP BY 1, 2, 3",
} | texts.SQL | catalogue.SQL | flows.SQL

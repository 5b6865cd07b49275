"""Recommendations from vectors with fixed centroids, and measures of a clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karwan.functions import similarity as S


def fit_centroids(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(cluster, centroid) by k-means over vectors(id, vector)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=20).fit(vectors.select(array_to_vector("vector").alias("features")))
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cluster, distance): the nearest centroid by Euclidean distance, ties by the smaller cluster; centroids are few and frozen."""
    near = F.broadcast(centroids.agg(F.collect_list(F.struct("cluster", "centroid")).alias("all")))
    d2 = lambda c: F.aggregate(F.zip_with("vector", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("all", lambda c: F.struct(d2(c["centroid"]).alias("d"), c["cluster"].alias("cluster"))))
    return vectors.join(near).select("id", best.alias("b")).select("id", "b.cluster", F.sqrt("b.d").alias("distance"))


def recommend(vectors: DataFrame, assigned: DataFrame, shown: DataFrame, allowed: DataFrame | None = None, queries: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """(qid, id, score, r): of the clusters of what was shown(qid, id), the allowed(id) rest nearest to its mean and to the query.

    score is the dot product with the normalised mean of the shown vectors, or half of it and half of that with the query's
    vector (qid, vector). Without usable shown vectors there is none. Ties by id.
    """
    seen = shown.join(vectors, "id")
    mean = S.mean_vector(seen, ["qid"], "vector").select("qid", F.transform("vector", lambda x: x / (S.norm(F.col("vector")) + 1e-9)).alias("profile"))
    clusters = shown.join(assigned, "id").select("qid", "cluster").distinct()
    pool = assigned.join(allowed, "id", "left_semi") if allowed is not None else assigned
    met = pool.select("id", "cluster").join(clusters, "cluster").join(shown, ["qid", "id"], "left_anti").join(vectors, "id").join(mean, "qid")
    score = S.dot(F.col("vector"), F.col("profile"))
    if queries is not None:
        met = met.join(queries.select("qid", F.col("vector").alias("qv")), "qid", "left")
        score = F.when(F.col("qv").isNull(), score).otherwise(0.5 * S.dot(F.col("vector"), F.col("qv")) + 0.5 * score)
    ranked = met.select("qid", "id", score.alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")))
    return ranked.where(F.col("r") <= limit)


def representatives(assigned: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("cluster").orderBy(F.round("distance", 9), "id")
    return assigned.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("cluster", "id", "r")


def sizes(assigned: DataFrame, k: int) -> DataFrame:
    """One row (smallest, middle, mean, largest, n_empty) over clusters 0 .. k - 1."""
    spark = assigned.sparkSession
    n = spark.range(k).select(F.col("id").cast("int").alias("cluster")).join(assigned.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", "left").na.fill(0, ["n"])
    return n.agg(F.min("n").alias("smallest"), F.percentile("n", 0.5).alias("middle"), F.avg("n").alias("mean"), F.max("n").alias("largest"), F.count_if(F.col("n") == 0).alias("n_empty"))


def purity(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, n, n_labels, share): the share of the most frequent label(id, label)."""
    n = assigned.join(labels, "id").groupBy("cluster", "label").agg(F.count("*").alias("k"))
    return n.groupBy("cluster").agg(F.sum("k").alias("n"), F.count("*").alias("n_labels"), (F.max("k") / F.sum("k")).alias("share"))

"""String and vector similarity as column expressions, and a lossless join of similar strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a fold over the rows of the dynamic programme."""
    chars = F.filter(F.split(b, ""), lambda x: x != "")
    zero = F.transform(F.array_append(chars, F.lit("")), lambda x: F.lit(0))

    def row(prev: Column, c: Column) -> Column:
        cells = F.zip_with(F.zip_with(chars, F.slice(prev, 1, F.size(chars)), lambda x, left: F.struct(x.alias("x"), left.alias("diag"))), F.slice(prev, 2, F.size(chars) + 1), lambda s, up: F.struct(s["x"].alias("x"), s["diag"].alias("diag"), up.alias("up")))
        return F.aggregate(cells, F.array(F.lit(0)), lambda done, s: F.array_append(done, F.when(s["x"] == c, s["diag"] + 1).otherwise(F.greatest(s["up"], F.element_at(done, -1)))))

    return F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda x: x != ""), zero, row), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (len a + len b): 100 for equal strings and for two empty ones; null if either is null."""
    n = F.char_length(a) + F.char_length(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(n == 0, 100.0).when(a == b, 100.0).otherwise(200.0 * lcs_length(a, b) / n)


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_words(a), sorted_words(b))


def similar_pairs(left: DataFrame, right: DataFrame, cutoff: float, few: bool = False) -> DataFrame:
    """(l, r, score) for all strings l of left(l) and r of right(r) with an Indel ratio of at least cutoff.

    Lossless and without a cross join: at a ratio of c, strings of n and m characters differ by at most
    D = (1 - c / 100) * (n + m) insertions and deletions. r is cut into more segments than that; reading from the left, there
    is one, the i-th, that is unharmed with exactly i edits before it, so its place in l is shifted by at most i, in i's
    parity, and by so much that D - i edits can make up the rest. An equality join on segments finds it; levenshtein() with
    that bound, which never exceeds the Indel distance, drops most of what is found before the exact score is computed.
    Null and empty strings match nothing; repeated strings count once. With few strings r, some thousands, their segments are
    broadcast, so that those of l aren't shuffled.
    """
    held = F.broadcast if few else lambda x: x
    if not 200 / 3 < cutoff <= 100:
        raise ValueError("cutoff must lie over two thirds and be at most 100")
    c = cutoff / 100
    most = lambda n: F.floor(F.lit(1 - c) * n + 1e-9).cast("int")
    r = right.where("r is not null and r <> ''").select("r").distinct().withColumn("n", F.char_length("r"))
    r = r.withColumn("d", most(F.col("n") + F.floor(F.col("n") * F.lit((2 - c) / c) + 1e-9)))
    segs = r.withColumn("i", F.explode(F.expr("sequence(0, d)"))).withColumn("p", F.expr("cast(i * n div (d + 1) as int)")).withColumn("len", F.expr("cast((i + 1) * n div (d + 1) as int) - p")).withColumn("seg", F.expr("substr(r, p + 1, len)"))
    shapes = segs.select("n", "i", "p", "len").distinct()
    l = left.where("l is not null and l <> ''").select("l").distinct().withColumn("m", F.char_length("l"))  # noqa: E741
    span = l.withColumn("n", F.explode(F.sequence(F.ceil(F.col("m") * F.lit(c / (2 - c)) - 1e-9).cast("int"), F.floor(F.col("m") * F.lit((2 - c) / c) + 1e-9).cast("int"))))
    places = span.withColumn("most", most(F.col("m") + F.col("n"))).join(held(shapes), "n").where("i <= most")
    places = places.withColumn("from", F.expr("greatest(-i, m - n - (most - i), -p)")).withColumn("to", F.expr("least(i, m - n + (most - i), m - len - p)")).where("`to` >= `from`")
    shift = F.explode(F.sequence("from", "to"))
    probes = places.withColumn("by", shift).where("pmod(by - i, 2) = 0").select("l", "m", "n", "most", "i", F.expr("substr(l, p + by + 1, len)").alias("seg"))
    found = probes.join(held(segs.select("r", "n", "i", "seg")), ["n", "i", "seg"]).select("l", "r", "most").distinct()
    near = found.where(F.expr("levenshtein(l, r, most) >= 0"))
    return near.withColumn("score", indel_ratio(F.col("l"), F.col("r"))).where(F.col("score") >= cutoff - 1e-9).select("l", "r", "score")


def deletes(word: Column, prefix: int = 7, distance: int = 2) -> Column:
    """All strings that up to `distance` deletions leave of the word's first `prefix` characters, the prefix itself included."""
    out = F.array(F.substring(word, 1, prefix))
    for _ in range(distance):
        less = F.flatten(F.transform(out, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1))), lambda i: F.concat(F.substring(x, 1, i - 1), x.substr(i + 1, F.greatest(F.char_length(x) - i, F.lit(0)))))))
        out = F.array_distinct(F.concat(out, less))
    return out


def neighbours_by_deletes(words: DataFrame, vocabulary: DataFrame, distance: int = 2, prefix: int = 7) -> DataFrame:
    """(word, candidate, edits, freq) with a Levenshtein distance of at most `distance`, by an equality join of what deletions leave.

    words: (word), vocabulary: (candidate, freq).
    """
    a = words.select("word").distinct().withColumn("key", F.explode(deletes(F.col("word"), prefix, distance)))
    b = vocabulary.select("candidate", "freq", F.explode(deletes(F.col("candidate"), prefix, distance)).alias("key"))
    met = a.join(b, "key").select("word", "candidate", "freq").distinct()
    return met.withColumn("edits", F.expr(f"levenshtein(word, candidate, {distance})")).where("edits >= 0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a norm is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_vector(vectors: DataFrame, keys: list[str], vector_col: str = "embedding") -> DataFrame:
    """(keys, vector): the element-wise mean of each group's vectors; null vectors don't count."""
    parts = vectors.select(*keys, F.posexplode(vector_col).alias("i", "x"))
    means = parts.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))

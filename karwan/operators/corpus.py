"""Corpus statistics: tokens of records, term and document frequencies, lengths, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karwan.functions import text as T
from karwan.runtime import cut, small

#: A word is hot if it makes up at least one in so many words of the corpus.
HOT = 1_000


def words(rows: DataFrame, text_cols: list[str], id_col: str = "id") -> DataFrame:
    """(id, pos, token): the words of the columns one after the other, order and repetitions kept."""
    parts = F.concat(*[T.raw_tokens(F.col(c)) for c in text_cols])
    return rows.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("pos", "token"))


def base_frequency(tokens: DataFrame) -> DataFrame:
    """(word, freq) of all tokens but Arabic ones and numbers."""
    kept = tokens.where(~T.is_arabic(F.col("token")) & ~F.col("token").rlike(r"^\p{Nd}+$"))
    return kept.groupBy(F.col("token").alias("word")).agg(F.count("*").alias("freq"))


def spelled_words(rows: DataFrame, text_cols: list[str], id_col: str = "id") -> DataFrame:
    """(id, pos, spelling): words() as they are spelled; what normalises to nothing (lines and stretching alone) is left out."""
    found = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"({T.WORD})"), F.lit(1))
    parts = F.filter(F.concat(*[found(c) for c in text_cols]), lambda x: ~x.rlike(r"^[_\x{640}]+$"))
    return rows.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("pos", "spelling"))


def vocabulary(spelled: DataFrame) -> DataFrame:
    """(spelling, token, freq) of all spelled_words(): one aggregation, cut, since all else about the corpus' words comes from it."""
    counts = cut(spelled.groupBy("spelling").agg(F.count("*").alias("freq")))
    return counts.select("spelling", T.normalize(F.col("spelling")).alias("token"), "freq")


def base_words(vocabulary: DataFrame) -> DataFrame:
    """(word, freq): base_frequency() from the vocabulary."""
    tokens = vocabulary.groupBy(F.col("token").alias("word")).agg(F.sum("freq").alias("freq"))
    return tokens.where(~T.is_arabic(F.col("word")) & ~F.col("word").rlike(r"^\p{Nd}+$"))


def in_singular(spelled: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, pos, token): spelled_words() normalised and in the singular that the corpus knows better.

    Texts meet the vocabulary by a broadcast if that is small, which is counted. Else only the words that make up at least
    one in HOT words, which are HOT at most, are broadcast, and what is joined by a shuffle has no hot key.
    """
    best = T.singulars(vocabulary.select(F.col("token").alias("word")).distinct(), base_words(vocabulary))
    best = cut(vocabulary.select("spelling", F.col("token").alias("word")).join(best, "word").select("spelling", F.col("singular").alias("token")))
    one = small(best)
    if one is not best:
        return spelled.join(one, "spelling").select("id", "pos", "token")
    total = vocabulary.agg(F.sum("freq").alias("total"))
    hot = vocabulary.join(F.broadcast(total)).where(F.col("freq") * HOT >= F.col("total")).select("spelling")
    marked = spelled.join(F.broadcast(best.join(F.broadcast(hot), "spelling", "left_semi").withColumnRenamed("token", "hot")), "spelling", "left")
    rest = marked.where("hot is null").join(best, "spelling").select("id", "pos", "token")
    return marked.where("hot is not null").select("id", "pos", F.col("hot").alias("token")).unionByName(rest)


def tokenize(rows: DataFrame, text_cols: list[str], id_col: str = "id") -> DataFrame:
    """words() in the singular that the corpus knows better."""
    spelled = spelled_words(rows, text_cols, id_col)
    return in_singular(spelled, vocabulary(spelled))


def term_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("id", "token").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def lengths(rows: DataFrame, tokens: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, length) for every row; one without words has 0."""
    n = tokens.groupBy("id").agg(F.count("*").alias("length"))
    return rows.select(F.col(id_col).alias("id")).distinct().join(n, "id", "left").na.fill(0, ["length"])


def statistics(doc_lengths: DataFrame) -> DataFrame:
    """One row (n_docs, total_length, avg_length)."""
    return doc_lengths.agg(F.count("*").alias("n_docs"), F.sum("length").alias("total_length"), F.avg("length").alias("avg_length"))


def ngrams(rows: DataFrame, text_col: str, sizes: tuple[int, ...] = (2, 3), support: int = 3, id_col: str = "id") -> DataFrame:
    """(ngram, n, support): runs of words of two letters or more that at least `support` records hold."""
    w = F.filter(T.raw_tokens(F.col(text_col)), lambda x: F.char_length(x) >= 2)

    def of(n: int):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("ngram")))

    runs = F.flatten(F.array(*[of(n) for n in sizes]))
    each = rows.select(F.col(id_col).alias("id"), w.alias("w")).select("id", F.explode(F.array_distinct(runs)).alias("r"))
    return each.groupBy("r.ngram", "r.n").agg(F.count_distinct("id").alias("support")).where(F.col("support") >= support)


def sample_with_forced(rows: DataFrame, size: int, forced: Column, seed: int = 42, id_col: str = "id") -> DataFrame:
    """At most `size` rows with a column forced: those that must be in it first, then others, both in the order of a digest of seed and id.

    rows: one row an id. Too many forced ones are sampled too. It is one top-k, without a sort of all rows; null counts as not forced.
    """
    place = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
    return rows.withColumn("forced", F.coalesce(forced, F.lit(False))).orderBy(F.desc("forced"), place, id_col).limit(size)

"""Filters, keyword ranking, spelling, vector ranking and their fusion; queries come as rows and run together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karwan.functions import similarity as S
from karwan.functions import text as T
from karwan.operators import corpus
from karwan.runtime import cut, small

# Saturation and length weight of BM25, boosts of an exact code and of a word in the address.
K1, B = 1.4, 0.75
CODE_BOOST, ADDRESS_BOOST = 100.0, 2.0
# Least similarity and least document frequency of a correction.
CORRECT_AT, CORRECT_DF = 80.0, 3
# Fixed value: rank constant of the reciprocal fusion.
FUSE = 60


def hard_filter(rows: DataFrame, equal: dict[str, object] | None = None, between: dict[str, tuple] | None = None, members: DataFrame | None = None, id_col: str = "id", lowered: dict[str, str] | None = None) -> DataFrame:
    """Rows that meet every condition: equality (also with a text in lower case), inclusive ranges (an open end is None; null fails) and membership by id."""
    for c, v in (equal or {}).items():
        if v is not None:
            rows = rows.where(F.col(c) == F.lit(v))
    for c, v in (lowered or {}).items():
        if v is not None:
            rows = rows.where(F.col(c) == F.lower(F.lit(v)))
    for c, (low, high) in (between or {}).items():
        if low is not None and high is not None and low > high:
            raise ValueError(f"{c}: the lower bound lies over the upper one")
        if low is not None:
            rows = rows.where(F.col(c) >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col(c) <= F.lit(high))
    return rows if members is None else rows.join(members.select(F.col("id").alias(id_col)), id_col, "left_semi")


def idf(n_docs: Column, df: Column) -> Column:
    return F.when(df > 0, F.log((n_docs - df + 0.5) / (df + 0.5) + 1)).otherwise(0.0)


@dataclass
class Index:
    """Corpus statistics as DataFrames: tf(id, token, tf, length), df(token, df), docs(id, length), stats(one row), base(word, freq)."""

    tf: DataFrame
    df: DataFrame
    docs: DataFrame
    stats: DataFrame
    base: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, text_cols: list[str], id_col: str = "id") -> Index:
        """Two passes over the texts: one for the vocabulary, one that writes the terms of each document in one shuffle by id."""
        spelled = corpus.spelled_words(rows, text_cols, id_col)
        words = corpus.vocabulary(spelled)
        tokens = corpus.in_singular(spelled, words).select("id", "token").repartition("id")
        length = F.sum("tf").over(Window.partitionBy("id"))
        tf = cut(corpus.term_frequency(tokens).withColumn("length", length))  # all else is computed from it
        n = tf.groupBy("id").agg(F.first("length").alias("length"))
        docs = rows.select(F.col(id_col).alias("id")).distinct().join(n, "id", "left").na.fill(0, ["length"])
        return cls(tf, cut(corpus.document_frequency(tf)), docs, cut(corpus.statistics(docs)), cut(corpus.base_words(words)))

    def terms(self, queries: DataFrame) -> DataFrame:
        """(qid, pos, token) of queries(qid, q)."""
        return T.trim_plurals(queries.select("qid", F.posexplode(T.raw_tokens(F.col("q"))).alias("pos", "token")), self.base)


def bm25(index: Index, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(qid, id, score) for every document with a word of the query, of within(id) if given; statistics are those of the whole corpus.

    The terms of a set of queries that is small, which is counted, are broadcast, so that only hits are shuffled.
    """
    q = small(cut(index.terms(queries).select("qid", "token").distinct().join(index.df, "token")))
    one = F.broadcast(index.stats)  # one row
    hits = index.tf.join(q, "token").join(one)
    if within is not None:
        hits = hits.join(within.select("id"), "id", "left_semi")
    part = idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return hits.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def rank(index: Index, queries: DataFrame, rows: DataFrame, code_col: str = "sku", address_col: str = "url_key", id_col: str = "id") -> DataFrame:
    """(qid, id, score) over the candidates `rows`: BM25, more for a code that the query's text holds and for words that the address holds too.

    A document is found by a word or by its code being the whole query. A query without words, or null, gives every candidate the
    score 0. Of several rows of an id any code and any address counts. Equal scores are ordered by id by what follows.
    """
    ids = rows.select(F.col(id_col).alias("id")).distinct()
    scores = bm25(index, queries, rows.select(F.col(id_col).alias("id")))
    codes = rows.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).where("code <> ''").distinct()
    # a code lies in a query where it equals one of the query's substrings of that length
    lengths = F.broadcast(codes.select(F.char_length("code").alias("n")).where("n <= 500").distinct())  # 500 rows at most
    parts = queries.select("qid", "q", F.btrim("q").alias("whole"), F.char_length("q").alias("m")).join(lengths, F.col("n") <= F.col("m"))
    parts = parts.select("qid", "whole", "n", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("n") + 1)).alias("at"), "q").select("qid", "whole", F.col("q").substr(F.col("at"), F.col("n")).alias("code")).distinct()
    coded = codes.join(small(parts), "code").groupBy("qid", "id").agg(F.max(F.col("code") == F.col("whole")).alias("whole"), F.lit(CODE_BOOST).alias("boost"))
    words = index.terms(queries).select("qid", "token").distinct()
    address = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(T.raw_tokens(F.replace(F.col(address_col), F.lit("-"), F.lit(" "))))).alias("token"))
    address = T.trim_plurals(address, index.base).join(small(words), "token").select("id", "qid", "token").distinct().groupBy("qid", "id").agg((F.count("*") * ADDRESS_BOOST).alias("extra"))
    base = scores.join(coded, ["qid", "id"], "full").where("score is not null or whole")
    found = base.join(address, ["qid", "id"], "left").select("qid", "id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).alias("score"))
    # queries without words have all candidates: the product is the result
    wordless = queries.join(words.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit(1).alias("all__"))
    everything = ids.withColumn("all__", F.lit(1)).join(wordless, "all__").select("qid", "id", F.lit(0.0).alias("score"))
    return found.join(wordless, "qid", "left_anti").unionByName(everything)


def evidence(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, n_tokens, n_known): how many of a query's words the corpus holds."""
    return index.terms(queries).join(index.df.select("token", F.lit(1).alias("known")), "token", "left").groupBy("qid").agg(F.count("*").alias("n_tokens"), F.count("known").alias("n_known"))


def candidates(index: Index, words: DataFrame, cutoff: float = CORRECT_AT) -> DataFrame:
    """(word, candidate, score, df, r) for words(word): vocabulary at or over the cutoff, best first; ties by frequency, then spelling."""
    pairs = S.similar_pairs(words.select(F.col("word").alias("l")), index.df.select(F.col("token").alias("r")), cutoff)
    scored = pairs.select(F.col("l").alias("word"), F.col("r").alias("candidate"), F.round("score", 9).alias("score")).join(index.df.withColumnRenamed("token", "candidate"), "candidate")
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), F.desc("df"), "candidate"))).select("word", "candidate", "score", "df", "r")


def correct(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, corrected): the query with each word that the corpus lacks replaced by the most similar one; null if nothing changes.

    Only the best candidate counts, and only with enough documents.
    """
    terms = index.terms(queries)
    missing = terms.join(index.df, "token", "left_anti").select(F.col("token").alias("word")).distinct()
    best = candidates(index, missing).where((F.col("r") == 1) & (F.col("df") >= CORRECT_DF)).select(F.col("word").alias("token"), "candidate")
    done = terms.join(best, "token", "left").groupBy("qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("candidate", "token").alias("t")))), lambda s: s["t"]), " ").alias("c"),
        F.count("candidate").alias("n"),
    )
    return queries.select("qid").join(done, "qid", "left").select("qid", F.when(F.col("n") > 0, F.col("c")).alias("corrected"))


def with_context(index: Index, words: DataFrame, found: DataFrame) -> DataFrame:
    """found(qid, candidate, ...) with the number of documents that hold the candidate beside the query's other words.

    words: (qid, token) are those other words; their documents are the ones that hold all of them, or any if none holds all.
    """
    asked = words.distinct().join(index.df.select("token"), "token").groupBy("qid").agg(F.array_sort(F.collect_set("token")).alias("key"))
    asked = cut(asked.join(found.select("qid").distinct(), "qid", "left_semi"))
    # equal words have equal documents: these are looked up once, however many queries ask for them
    keys = cut(asked.select("key").distinct().select(F.monotonically_increasing_id().alias("k_id"), "key"))
    known = keys.select("k_id", F.size("key").alias("n_words"), F.explode("key").alias("token"))
    docs = known.join(index.tf.select("token", "id"), "token").groupBy("k_id", "id").agg(F.count("*").alias("k"), F.first("n_words").alias("n_words"))
    docs = cut(docs)
    some = docs.groupBy("k_id").agg(F.max(F.col("k") == F.col("n_words")).alias("all_met"))
    context = docs.join(some, "k_id").where(~F.col("all_met") | (F.col("k") == F.col("n_words"))).select("k_id", "id")
    of = cut(asked.join(keys, "key").select("qid", "k_id"))
    wanted = cut(found.select("qid", "candidate").distinct().join(of, "qid").select("k_id", "candidate").distinct())
    support = wanted.join(index.tf.select(F.col("token").alias("candidate"), "id"), "candidate").join(context, ["k_id", "id"]).groupBy("k_id", "candidate").agg(F.count("*").alias("support"))
    # a query whose words the corpus knows has context: every word of the corpus has documents
    return found.join(of.withColumn("has_context", F.lit(True)), "qid", "left").na.fill(False, ["has_context"]).join(support, ["k_id", "candidate"], "left").na.fill(0, ["support"]).drop("k_id")


def select_best(found: DataFrame, margin: int = 0) -> DataFrame:
    """(qid, candidate): with context the best supported candidate, else the most frequent one; none where the runner-up is within the margin or nothing supports it."""
    key = F.when(F.col("has_context"), F.col("support")).otherwise(F.col("df"))
    w = Window.partitionBy("qid").orderBy(F.desc("key"), F.desc("df"), F.desc("score"), "candidate")
    ranked = found.withColumn("key", key).withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("key").over(w))
    return ranked.where((F.col("r") == 1) & (F.col("key") > 0) & (F.col("key") - F.coalesce("next", F.lit(0)) >= margin)).select("qid", "candidate")


def _blocks(vectors: DataFrame, key: str, rows: int, name: str) -> DataFrame:
    """Usable vectors(key, vector) packed into blocks of one width: (ids, x, width) with the name before each column."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.to_pandas() if b.num_rows else None
            if t is None:
                continue
            t = t[[v is not None and len(v) > 0 for v in t["vector"]]]
            for width, part in t.groupby(t["vector"].map(len)):
                x = np.stack(part["vector"].to_list()).astype(np.float64)
                length = np.sqrt((x * x).sum(1))
                fine = np.isfinite(length) & (length > 0)
                x, ids = x[fine] / length[fine, None], part["key"].to_numpy()[fine]
                for at in range(0, len(x), rows):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[at : at + rows].tolist()], pa.list_(pa.int64())), pa.array([x[at : at + rows].tobytes()], pa.binary()), pa.array([int(width)], pa.int32())], ["ids", "x", "width"])

    packed = vectors.select(F.col(key).cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector")).where("key is not null and vector is not null").mapInArrow(pack, "ids array<long>, x binary, width int")
    return cut(packed.select(*[F.col(c).alias(f"{name}_{c}") for c in packed.columns]))


def vector_rank(vectors: DataFrame, queries: DataFrame, top: int = 100, gate: float | None = None, members: DataFrame | None = None) -> DataFrame:
    """(qid, id, distance, r): the nearest of vectors(id, vector) to every one of queries(qid, vector), exactly; equal distances (to 9 digits) by id.

    Both sides are packed into blocks, each block of queries meets each block of vectors once and keeps its nearest `top`, so
    nothing is broadcast that grows with the queries. Several rows of an id count once, with the nearest. With a gate a query whose
    nearest vector is farther has no result at all. Null, zero, non-finite vectors and those of another width have no distance.
    """
    base = vectors if members is None else vectors.join(members, "id", "left_semi")
    pairs = _blocks(queries, "qid", 512, "q").join(_blocks(base, "id", 4096, "b"), F.col("q_width") == F.col("b_width"))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qx, bi, bx, w in zip(*(b.column(c).to_pylist() for c in range(5))):
                qi, bi = np.array(qi), np.array(bi)
                d = np.round(1 - np.frombuffer(qx).reshape(-1, w) @ np.frombuffer(bx).reshape(-1, w).T, 9)
                order = np.argsort(bi, kind="stable")
                bi, first = np.unique(bi[order], return_index=True)
                d = np.minimum.reduceat(d[:, order], first, axis=1)  # one row an id
                if d.shape[1] > top:  # all that ties with the last one stays, ids decide below
                    last = np.partition(d, top - 1, axis=1)[:, top - 1 : top]
                    r, c = np.nonzero(d <= last)
                else:
                    r, c = np.nonzero(np.ones(d.shape, bool))
                order = np.lexsort((bi[c], d[r, c], r))
                r, c = r[order], c[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                r, c = r[place < top], c[place < top]
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(bi[c]), pa.array(d[r, c])], ["qid", "id", "distance"])

    met = pairs.select("q_ids", "q_x", "b_ids", "b_x", "q_width").mapInArrow(meet, "qid long, id long, distance double")
    scored = met.groupBy("qid", "id").agg(F.min("distance").alias("distance"))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("r") <= top)
    if gate is None:
        return ranked
    near = F.first("distance").over(Window.partitionBy("qid").orderBy("r"))
    return ranked.withColumn("near", near).where(F.col("near") <= gate).drop("near")


def fuse(lists: list[DataFrame], k: int = FUSE) -> DataFrame:
    """(qid, id, score, first): reciprocal rank fusion of lists (qid, id, r), r from 1; `first` breaks ties by list and place."""
    parts = None
    for i, x in enumerate(lists):
        p = x.select("qid", "id", "r", F.lit(i).alias("list"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("r"))).alias("score"), F.min(F.struct("list", "r")).alias("first"))


def ranked(scores: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """scores with r and total: the place within each query (ties end with id) and the number of rows; a page of them."""
    w = Window.partitionBy("qid").orderBy(*order, "id")
    out = scores.withColumn("r", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy("qid")))
    return out.where((F.col("r") > offset) & (F.col("r") <= offset + limit)) if limit is not None else out


def hybrid(index: Index, rows: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, wide: int = 100, gate: float = 0.31, price_col: str | None = None) -> DataFrame:
    """(qid, id, score, plan, place) over the candidates `rows` (already filtered): what each query(qid, q) finds, by the first plan that holds.

    Every query is corrected first; a word that the corpus knows is never touched.
    * filter: a null or empty query; all candidates, by price if price_col is given (nulls last);
    * corrected: the query as typed finds nothing, the corrected one does: its keyword ranking;
    * keyword: it finds something, among `wide` candidates or fewer (the vectors would bring all of them back);
    * fused: it finds something among more candidates: keyword ranking and the `wide` nearest vectors by reciprocal ranks;
    * vector: nothing is found: the nearest vectors, if the nearest lies within the gate.
    place orders a query's rows; equal scores by list and rank for fused ones, by id otherwise.
    """
    texts = queries.where("q <> ''")
    fixed = correct(index, texts).where("corrected is not null")
    both = texts.select("qid", "q", F.lit(False).alias("fixed")).unionByName(fixed.select("qid", F.col("corrected").alias("q"), F.lit(True).alias("fixed")))
    tagged = both.select(F.struct("qid", "fixed").alias("qid"), "q")
    found = cut(rank(index, tagged, rows).select(F.col("qid.qid").alias("qid"), F.col("qid.fixed").alias("fixed"), "id", "score"))
    counts = found.groupBy("qid").agg(F.count_if(~F.col("fixed")).alias("typed"), F.count_if("fixed").alias("mended"))
    state = texts.select("qid").join(fixed.select("qid", F.lit(True).alias("has_fix")), "qid", "left").join(counts, "qid", "left").na.fill(0, ["typed", "mended"]).na.fill(False, ["has_fix"])
    pool = F.broadcast(rows.select("id").distinct().agg(F.count("*").alias("pool")))  # one row
    hits = F.when(F.col("has_fix"), F.col("mended")).otherwise(F.col("typed"))
    plan = F.when((F.col("typed") == 0) & (hits > 0), "corrected").when((hits > 0) & (F.col("pool") <= wide), "keyword").when(hits > 0, "fused").otherwise("vector")
    plans = small(cut(state.join(pool).select("qid", "has_fix", plan.alias("plan"))))
    near = cut(vector_rank(vectors, query_vectors.join(plans.where("plan in ('fused', 'vector')").select("qid"), "qid", "left_semi"), wide, None, rows.select("id")))
    keyword = found.join(plans, "qid").where(F.col("fixed") == F.col("has_fix"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    ranked_ = keyword.withColumn("r", F.row_number().over(order))
    direct = ranked_.where("plan in ('corrected', 'keyword')").select("qid", "id", "score", "plan", F.col("r").alias("place"))
    lists = [ranked_.where("plan = 'fused'").select("qid", "id", "r"), near.join(plans.where("plan = 'fused'").select("qid"), "qid", "left_semi").select("qid", "id", "r")]
    by_score = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "first")
    fused = fuse(lists).withColumn("place", F.row_number().over(by_score)).select("qid", "id", "score", F.lit("fused").alias("plan"), "place")
    alone = near.join(plans.where("plan = 'vector'").select("qid"), "qid", "left_semi")
    gated = alone.where(F.col("r") == 1).where(F.col("distance") <= gate).select("qid")
    vector = alone.join(gated, "qid", "left_semi").select("qid", "id", (1.0 / (FUSE + F.col("r"))).alias("score"), F.lit("vector").alias("plan"), F.col("r").alias("place"))
    price = rows.groupBy("id").agg((F.min(price_col) if price_col else F.lit(None)).alias("price")).withColumn("all__", F.lit(1))
    bare = price.join(queries.where("q is null or q = ''").select("qid", F.lit(1).alias("all__")), "all__")
    bare = bare.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.asc_nulls_last("price"), "id"))).select("qid", "id", F.lit(0.0).alias("score"), F.lit("filter").alias("plan"), "place")
    return direct.unionByName(fused).unionByName(vector).unionByName(bare)

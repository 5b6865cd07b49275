"""Queries of the filter, join, aggregate, ranking, vector, entity and recommendation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karwan.functions import similarity as S
from karwan.functions import text as T
from karwan.operators import corpus, entities, recommend, retrieval
from karwan.plans.texts import LATIN, NAMES, NORM, TOKENS, WORDS_SQL, ratio_sql
from karwan.runtime import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product")


# --- filters


@query("flt1_hard_filter", "SELECT p.id, name_en, CAST(price AS DOUBLE) AS price FROM product p WHERE price >= 10 AND price <= 40 AND brand_normalized = lower('MaQawal') AND EXISTS (SELECT 1 FROM product_category pc JOIN category c ON c.id = pc.category_id WHERE pc.product_id = p.id AND c.canonical_category_id BETWEEN 1 AND 40)")
def _(spark: SparkSession, d: str) -> DataFrame:
    cats = table(spark, d, "category").where("canonical_category_id between 1 and 40").select(F.col("id").alias("category_id"))
    members = table(spark, d, "product_category").join(cats, "category_id", "left_semi").select(F.col("product_id").alias("id"))
    return retrieval.hard_filter(_products(spark, d), None, {"price": (10, 40)}, members, lowered={"brand_normalized": "MaQawal"}).select("id", "name_en", F.col("price").cast("double").alias("price"))


@query("flt4_jn1_category_semijoin", "SELECT DISTINCT p.id FROM product p WHERE EXISTS (SELECT 1 FROM product_category pc JOIN category c ON c.id = pc.category_id JOIN canonical_category cc ON cc.id = c.canonical_category_id WHERE pc.product_id = p.id AND cc.slug LIKE '%milk%')")
def _(spark: SparkSession, d: str) -> DataFrame:
    canon = table(spark, d, "canonical_category").where("slug like '%milk%'").select(F.col("id").alias("canonical_category_id"))
    cats = table(spark, d, "category").join(canon, "canonical_category_id", "left_semi").select(F.col("id").alias("category_id"))
    links = table(spark, d, "product_category").join(cats, "category_id", "left_semi").select(F.col("product_id").alias("id"))
    return _products(spark, d).select("id").distinct().join(links, "id", "left_semi")


@query("flt8_jn2_referenced_categories", "SELECT DISTINCT cc.slug, cc.display_name_en FROM canonical_category cc JOIN category c ON c.canonical_category_id = cc.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "category").select(F.col("canonical_category_id").alias("id"))
    return table(spark, d, "canonical_category").join(used, "id", "left_semi").select("slug", "display_name_en").distinct()


@query("flt12_marker_filter", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'milk|حليب|milch|lait')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").rlike("milk|حليب|milch|lait")).select("doc_id")


# --- ranking

_QUERIES_SQL = "queries AS (SELECT id AS qid, display_name_en AS q FROM canonical_category),"
_TERMS_SQL = f"""{_QUERIES_SQL}
qraw AS (SELECT qid, unnest(l) AS token, unnest(range(len(l))) AS pos FROM (SELECT qid, {TOKENS('q')} AS l FROM queries)),
qforms AS (SELECT DISTINCT token, CASE WHEN length(token) <= 4 THEN token WHEN token LIKE '%ies' THEN left(token, -3) || 'y' WHEN token LIKE '%es' THEN left(token, -1) WHEN token LIKE '%s' AND token NOT LIKE '%ss' THEN left(token, -1) ELSE token END AS d, CASE WHEN length(token) <= 4 THEN token WHEN token LIKE '%ies' THEN left(token, -1) WHEN token LIKE '%es' THEN left(token, -2) WHEN token LIKE '%s' AND token NOT LIKE '%ss' THEN left(token, -1) ELSE token END AS a FROM qraw),
qterms AS (SELECT r.qid, r.pos, CASE WHEN coalesce(x.freq, 0) <= 1 AND coalesce(y.freq, 0) > coalesce(x.freq, 0) AND f.token NOT IN ('burnes', 'kisses', 'ashes', 'matches', 'patches') THEN a ELSE d END AS token FROM qraw r JOIN qforms f USING (token) LEFT JOIN base x ON x.word = d LEFT JOIN base y ON y.word = a),
bm AS (SELECT q.qid, t.id, sum(ln((s.n_docs - f.df + 0.5) / (f.df + 0.5) + 1) * t.tf * 2.4 / (t.tf + 1.4 * (0.25 + 0.75 * c.length / s.avg_length))) AS score FROM (SELECT DISTINCT qid, token FROM qterms) q JOIN dfreq f USING (token) JOIN tf t USING (token) JOIN docs c ON c.id = t.id, stats s GROUP BY 1, 2)
"""
_RANKED_SQL = WORDS_SQL.rstrip() + ",\n" + _TERMS_SQL


def _unique(spark: SparkSession, d: str) -> DataFrame:
    """Products, one row an id."""
    return _products(spark, d).select("id", *NAMES, "sku", "url_key")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_category").select(F.col("id").alias("qid"), F.col("display_name_en").alias("q"))


@query("rnk1_idf", WORDS_SQL + "SELECT token, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM dfreq, stats")
def _(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.Index.build(_products(spark, d), NAMES)
    return index.df.join(F.broadcast(index.stats)).select("token", F.round(retrieval.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query("rnk2_bm25", _RANKED_SQL + "SELECT qid, id, round(score, 6) AS score FROM bm")
def _(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.Index.build(_products(spark, d), NAMES)
    return retrieval.bm25(index, _queries(spark, d)).withColumn("score", F.round("score", 6))


#: Each canonical category's name with the smallest code among its products, so that codes count too.
_CODED_SQL = "queries AS (SELECT cc.id AS qid, cc.display_name_en || coalesce(' ' || min(p.sku), '') AS q FROM canonical_category cc LEFT JOIN category c ON c.canonical_category_id = cc.id LEFT JOIN product_category pc ON pc.category_id = c.id LEFT JOIN product p ON p.id = pc.product_id AND p.sku <> '' GROUP BY cc.id, cc.display_name_en),"


def _coded_queries(spark: SparkSession, d: str) -> DataFrame:
    cats = table(spark, d, "category").where("canonical_category_id is not null").select(F.col("id").alias("category_id"), F.col("canonical_category_id").alias("id"))
    codes = _products(spark, d).where("sku <> ''").select(F.col("id").alias("product_id"), "sku")
    least = table(spark, d, "product_category").select("product_id", "category_id").join(cats, "category_id").join(codes, "product_id").groupBy("id").agg(F.min("sku").alias("sku"))
    return table(spark, d, "canonical_category").join(least, "id", "left").select(F.col("id").alias("qid"), F.concat_ws(" ", "display_name_en", "sku").alias("q"))


@query("rnk3_srt1_top20", _RANKED_SQL.replace(_QUERIES_SQL, _CODED_SQL) + ", a AS (SELECT DISTINCT id, unnest(" + TOKENS("replace(url_key, '-', ' ')") + f""") AS token FROM product),
aforms AS (SELECT DISTINCT token, CASE WHEN length(token) <= 4 THEN token WHEN token LIKE '%ies' THEN left(token, -3) || 'y' WHEN token LIKE '%es' THEN left(token, -1) WHEN token LIKE '%s' AND token NOT LIKE '%ss' THEN left(token, -1) ELSE token END AS d, CASE WHEN length(token) <= 4 THEN token WHEN token LIKE '%ies' THEN left(token, -1) WHEN token LIKE '%es' THEN left(token, -2) WHEN token LIKE '%s' AND token NOT LIKE '%ss' THEN left(token, -1) ELSE token END AS a FROM a),
aterms AS (SELECT DISTINCT a.id, CASE WHEN coalesce(x.freq, 0) <= 1 AND coalesce(y.freq, 0) > coalesce(x.freq, 0) AND f.token NOT IN ('burnes', 'kisses', 'ashes', 'matches', 'patches') THEN f.a ELSE f.d END AS token FROM a JOIN aforms f USING (token) LEFT JOIN base x ON x.word = f.d LEFT JOIN base y ON y.word = f.a),
extra AS (SELECT q.qid, a.id, 2.0 * count(*) AS e FROM (SELECT DISTINCT qid, token FROM qterms) q JOIN aterms a USING (token) GROUP BY 1, 2),
codes AS (SELECT DISTINCT q.qid, p.id, p.sku = trim(q.q, ' ') AS whole FROM queries q JOIN (SELECT DISTINCT id, sku FROM product WHERE sku <> '') p ON contains(q.q, p.sku)),
coded AS (SELECT qid, id, bool_or(whole) AS whole, 100.0 AS boost FROM codes GROUP BY 1, 2),
sc AS (SELECT qid, id, round(coalesce(score, 0) + coalesce(e, 0) + coalesce(boost, 0), 6) AS score FROM (SELECT qid, id, score, whole, boost FROM bm FULL JOIN coded USING (qid, id)) LEFT JOIN extra USING (qid, id) WHERE score IS NOT NULL OR whole)
SELECT qid, id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 20""")  # fmt: skip
def _(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.Index.build(_products(spark, d), NAMES)
    scores = retrieval.rank(index, _coded_queries(spark, d), _unique(spark, d)).withColumn("score", F.round("score", 6))
    return retrieval.ranked(scores, [F.desc("score")], 20).select("qid", "id", "score", "r")


@query("flt10_catalogue_evidence", _RANKED_SQL + "SELECT qid, count(*) AS n_tokens, count(f.token) AS n_known FROM qterms q LEFT JOIN dfreq f ON f.token = q.token GROUP BY qid")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.evidence(retrieval.Index.build(_products(spark, d), NAMES), _queries(spark, d))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word of the brands as typed."""
    return corpus.words(_products(spark, d), ["brand_raw_en"]).select("token").distinct()


@query("sim4_jn11_rnk4_corrections")
def _(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.Index.build(_products(spark, d), NAMES)
    missed = _typed(spark, d).join(index.df, "token", "left_anti").select(F.col("token").alias("word"))
    return retrieval.candidates(index, missed).where("r <= 3")


@query("rnk4_corrected_queries")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = _products(spark, d)
    index = retrieval.Index.build(p, NAMES)
    typed = p.where("trim(brand_raw_en) <> ''").groupBy(F.col("brand_raw_en").alias("q")).agg(F.min("id").alias("qid")).select("qid", "q")
    return retrieval.correct(index, typed).where("corrected is not null")


@query("rnk5_rnk6_context_choice")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = _products(spark, d)
    index = retrieval.Index.build(p, NAMES)
    words = corpus.words(p, ["brand_raw_en"]).select(F.col("id").alias("qid"), "token").distinct()
    words = words.join(index.df.select("token", F.lit(1).alias("known")), "token", "left")
    missed = words.where("known is null").select("qid", F.col("token").alias("word"))
    others = words.where("known is not null").select("qid", "token")
    found = missed.join(retrieval.candidates(index, missed.select("word").distinct()).where("r <= 5"), "word").select("qid", "candidate", "score", "df")
    return retrieval.select_best(retrieval.with_context(index, others, found), margin=1)


# --- vectors


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("vec1_srt3_nearest", "SELECT qid, id, round(distance, 6) AS distance, r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS r FROM (SELECT q.vec_id AS qid, e.vec_id AS id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE r <= 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    # the stated query set: every row whose id is divisible by 20
    near = retrieval.vector_rank(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), 10)
    return near.select("qid", "id", F.round("distance", 6).alias("distance"), "r")


_USABLE_SQL = "u AS (SELECT DISTINCT product_id AS id, embedding::DOUBLE[] AS v FROM product_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"


@query("vec1_gated", f"WITH {_USABLE_SQL}, m AS (SELECT DISTINCT product_id AS id FROM product_category WHERE category_id <> 7), s AS (SELECT q.id AS qid, e.id, min(round(1 - list_cosine_similarity(q.v, e.v), 9)) AS distance FROM (SELECT * FROM u WHERE id % 20 = 0 AND id NOT IN (SELECT id FROM m WHERE id IS NOT NULL)) q, (SELECT * FROM u WHERE id IN (SELECT id FROM m)) e GROUP BY 1, 2) SELECT qid, id, round(distance, 6) AS distance, r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS r, min(distance) OVER (PARTITION BY qid) AS nearest FROM s) WHERE r <= 5 AND nearest <= 0.31")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "product_embeddings").where("size(embedding) = 64").select(F.col("product_id").alias("id"), F.col("embedding").alias("vector"))
    members = table(spark, d, "product_category").where("category_id <> 7 and product_id is not null").select(F.col("product_id").alias("id")).distinct()
    asked = v.where("id % 20 = 0").join(members, "id", "left_anti").select(F.col("id").alias("qid"), "vector")
    return retrieval.vector_rank(v, asked, 5, 0.31, members).select("qid", "id", F.round("distance", 6).alias("distance"), "r")


@query("vec2_rrf", "WITH a AS (SELECT c_nationkey AS qid, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer), b AS (SELECT c_nationkey AS qid, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) SELECT qid, id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("qid"), F.col("c_custkey").alias("id"), "c_acctbal")
    by = lambda *order: c.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).select("qid", "id", "r")
    return retrieval.fuse([by(F.desc("c_acctbal"), "id"), by("id")]).select("qid", "id", F.round("score", 6).alias("score"))


# each query's vector is the mean of the vectors of its category's products
@query("hyb1_hybrid_search")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _products(spark, d).select("id", *NAMES, "sku", "url_key", "price")
    index = retrieval.Index.build(rows, NAMES)
    vectors = table(spark, d, "product_embeddings").where("size(embedding) = 64").select(F.col("product_id").alias("id"), F.col("embedding").alias("vector"))
    cats = table(spark, d, "category").where("canonical_category_id is not null").select(F.col("id").alias("category_id"), F.col("canonical_category_id").alias("qid"))
    linked = table(spark, d, "product_category").select("product_id", "category_id").join(cats, "category_id").select(F.col("product_id").alias("id"), "qid").distinct()
    finite = vectors.where(F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    qv = S.mean_vector(linked.join(finite, "id"), ["qid"], "vector")
    found = retrieval.hybrid(index, rows, _queries(spark, d), vectors, qv, price_col="price")
    return found.where("place <= 20").select("qid", "id", F.round("score", 6).alias("score"), "plan", "place")


@query("hyb2_hyb3_price_order", "SELECT id, CAST(price AS DOUBLE) AS price, row_number() OVER (ORDER BY price ASC NULLS LAST, id) AS r, count(*) OVER () AS total FROM (SELECT id, min(price) AS price FROM product GROUP BY id) QUALIFY r > 20 AND r <= 40")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = _products(spark, d).groupBy("id").agg(F.min("price").alias("price"))
    page = p.orderBy(F.asc_nulls_last("price"), "id").offset(20).limit(20)  # a page is the feature: top-k with an offset, no full sort
    total = F.broadcast(p.agg(F.count("*").alias("total")))
    r = F.row_number().over(Window.orderBy(F.asc_nulls_last("price"), "id")) + 20
    return page.withColumn("r", r).join(total).select("id", F.col("price").cast("double").alias("price"), "r", "total")


# --- joins and aggregates


@query("jn4_left_count", "SELECT c.id, count(pc.product_id) AS n FROM (SELECT DISTINCT id FROM category) c LEFT JOIN product_category pc ON pc.category_id = c.id GROUP BY c.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "product_category").groupBy(F.col("category_id").alias("id")).agg(F.count("product_id").alias("n"))
    return table(spark, d, "category").select("id").distinct().join(n, "id", "left").na.fill(0, ["n"])


@query("jn3_ag8_members_per_slug", "SELECT cc.slug, count(DISTINCT pc.product_id) AS n_products FROM product_category pc JOIN category c ON c.id = pc.category_id JOIN canonical_category cc ON cc.id = c.canonical_category_id GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    canon = table(spark, d, "canonical_category").select(F.col("id").alias("canonical_category_id"), "slug")
    cats = table(spark, d, "category").join(canon, "canonical_category_id").select(F.col("id").alias("category_id"), "slug").distinct()
    return table(spark, d, "product_category").join(cats, "category_id").groupBy("slug").agg(F.count_distinct("product_id").alias("n_products"))


@query("jn5_products_with_vectors", "SELECT DISTINCT p.id, p.name_en, p.brand_normalized, len(e.embedding) AS width FROM product p JOIN product_embeddings e ON e.product_id = p.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    # deliveries of one id are folded on both sides before the join, so that none multiplies the other
    p = _products(spark, d).select("id", "name_en", "brand_normalized").distinct()
    widths = table(spark, d, "product_embeddings").where("product_id is not null").select(F.col("product_id").alias("id"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("width")).distinct()
    return p.join(widths, "id")


@query("emb2_forced_sample", "SELECT id, forced FROM (SELECT id, forced, row_number() OVER (ORDER BY forced DESC, md5(CAST(id AS VARCHAR) || '-42'), id) AS r FROM (SELECT id, coalesce(bool_or(contains(lower(name_en || ' ' || name_ar), 'milk') OR contains(name_ar, 'حليب') OR contains(name_ar, 'لبن')), false) AS forced FROM product GROUP BY id)) WHERE r <= 500")
def _(spark: SparkSession, d: str) -> DataFrame:
    # the size of the sample is the operator's own parameter
    has = F.bool_or(F.lower(F.concat_ws(" ", "name_en", "name_ar")).rlike("milk|حليب|لبن"))
    rows = _products(spark, d).groupBy("id").agg(has.alias("milk"))
    return corpus.sample_with_forced(rows, 500, F.col("milk")).select("id", "forced")


@query("jn6_win3_star_argmax", "WITH s AS (SELECT c.canonical_category_id AS cat, p.brand_normalized AS brand, count(*) AS n FROM product_category pc JOIN product p ON p.id = pc.product_id JOIN category c ON c.id = pc.category_id WHERE p.brand_normalized IS NOT NULL AND c.canonical_category_id IS NOT NULL GROUP BY 1, 2) SELECT cat, brand, n FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY n DESC, brand) AS r FROM s) WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    cats = table(spark, d, "category").where("canonical_category_id is not null").select(F.col("id").alias("category_id"), F.col("canonical_category_id").alias("cat"))
    brands = _products(spark, d).where("brand_normalized is not null").select(F.col("id").alias("product_id"), F.col("brand_normalized").alias("brand"))
    n = table(spark, d, "product_category").join(cats, "category_id").join(brands, "product_id").groupBy("cat", "brand").agg(F.count("*").alias("n"))
    return n.groupBy("cat").agg(F.min_by(F.struct("brand", "n"), F.struct(-F.col("n"), "brand")).alias("b")).select("cat", "b.brand", "b.n")


@query("jn7_bilingual_fold", "SELECT canonical_brand_id AS id, max(CASE WHEN script = 'latin' THEN raw_value END) AS latin, max(CASE WHEN script = 'arabic' THEN raw_value END) AS arabic FROM brand_alias GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "brand_alias")
    side = lambda s: F.max(F.when(F.col("script") == s, F.col("raw_value"))).alias(s)
    return a.groupBy(F.col("canonical_brand_id").alias("id")).agg(side("latin"), side("arabic"))


@query("jn8_set3_invalid_links", "SELECT id FROM product_category pc WHERE (product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM product)) OR (category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM category))")
def _(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "product_category")
    missing = lambda field, t: links.where(F.col(field).isNotNull()).join(table(spark, d, t).select(F.col("id").alias(field)), field, "left_anti").select("id")
    return missing("product_id", "product").union(missing("category_id", "category")).distinct()


@query("jn14_can8_coalesce_alias", "SELECT DISTINCT p.id, coalesce(a.canonical_brand_id, b.canonical_brand_id) AS brand_id FROM product p LEFT JOIN brand_alias a ON a.raw_value = p.brand_raw_en LEFT JOIN brand_alias b ON b.raw_value = p.brand_raw_ar")
def _(spark: SparkSession, d: str) -> DataFrame:
    alias = table(spark, d, "brand_alias").select("raw_value", F.col("canonical_brand_id").alias("target"))
    return entities.coalesce_alias(_products(spark, d), alias, "brand_raw_en", "brand_raw_ar", "brand_id").select("id", "brand_id").distinct()


@query("jn18_ag19_distinct_with_empty", "SELECT b.id, count(DISTINCT p.id) AS n, array_to_string(list_sort(list(DISTINCT a.raw_value)), '|') AS names FROM canonical_brand b LEFT JOIN product p ON p.brand_normalized = b.slug LEFT JOIN brand_alias a ON a.canonical_brand_id = b.id GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = _products(spark, d).groupBy(F.col("brand_normalized").alias("slug")).agg(F.count_distinct("id").alias("n"))
    names = table(spark, d, "brand_alias").groupBy(F.col("canonical_brand_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("raw_value")), "|").alias("names"))
    return table(spark, d, "canonical_brand").join(n, "slug", "left").join(names, "id", "left").na.fill(0, ["n"]).select("id", "n", "names")


@query("ag5_unpivot_count", "SELECT value, count(*) AS n FROM (SELECT brand_raw_en AS value FROM product UNION ALL SELECT brand_raw_ar FROM product) WHERE trim(value) <> '' GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return entities.brand_values(_products(spark, d), ["brand_raw_en", "brand_raw_ar"])


@query("ag6_can1_exact_merge", f"SELECT value, n, key, first(value) OVER (PARTITION BY key ORDER BY n DESC, value) AS representative, count(*) OVER (PARTITION BY key) > 1 AS merged FROM (SELECT *, {NORM('value')} AS key FROM (SELECT value, count(*) AS n FROM (SELECT brand_raw_en AS value FROM product UNION ALL SELECT brand_raw_ar FROM product) WHERE trim(value) <> '' GROUP BY 1))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return entities.exact_merge(entities.brand_values(_products(spark, d), ["brand_raw_en", "brand_raw_ar"]), T.normalize(F.col("value")))


@query("ag10_method_counts", "SELECT method, count(*) AS n, coalesce(count_if(confidence < 95), 0) AS n_review FROM canonical_brand GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_brand").groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 95).alias("n_review"))


@query("ag14_grouping_sets", "SELECT event_type, user_id % 7 AS bucket, count(*) AS n, count_if(value > 50) AS n_high FROM events GROUP BY GROUPING SETS ((), (event_type), (user_id % 7))")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 7).alias("bucket"), "value")
    return e.groupingSets([[], [F.col("event_type")], [F.col("bucket")]], F.col("event_type"), F.col("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high")).select("event_type", "bucket", "n", "n_high")


@query("ag15_rates", "SELECT round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 6) AS en_share, round(avg(CASE WHEN n_chars = length(text) THEN 1.0 ELSE 0.0 END) FILTER (WHERE text IS NOT NULL AND n_chars IS NOT NULL), 6) AS length_right FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    known = F.col("text").isNotNull() & F.col("n_chars").isNotNull()
    return table(spark, d, "documents").agg(F.round(F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)), 6).alias("en_share"), F.round(F.avg(F.when(known, F.when(F.col("n_chars") == F.char_length("text"), 1.0).otherwise(0.0))), 6).alias("length_right"))


@query("ag16_consistency", "SELECT user_id, count(DISTINCT event_type) = 1 AS consistent, count(*) AS n FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg((F.count_distinct("event_type") == 1).alias("consistent"), F.count("*").alias("n"))


@query("ag24_seeded_split", "SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '-7'), vec_id) <= 0.7 * count(*) OVER () AS dev FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    # the place in the digests' order: a range-partitioned count before, then places inside each two leading bytes
    e = table(spark, d, "embeddings").select("vec_id", F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("-7"))).alias("h")).withColumn("b", F.substring("h", 1, 4))
    n = e.groupBy("b").agg(F.count("*").alias("n"))
    before = n.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # at most 65,536 rows
    total = n.agg(F.sum("n").alias("total"))
    r = F.row_number().over(Window.partitionBy("b").orderBy("h", "vec_id"))
    return e.withColumn("r", r).join(F.broadcast(before), "b").join(F.broadcast(total)).select("vec_id", (F.col("before") + F.col("r") <= 0.7 * F.col("total")).alias("dev"))


# --- sets, order, windows


@query("set1_intersect", "SELECT DISTINCT doc_id FROM documents WHERE lower(text) LIKE '%milk%' INTERSECT SELECT doc_id FROM documents WHERE lower(text) LIKE '%fresh%'")
def _(spark: SparkSession, d: str) -> DataFrame:
    has = lambda w: table(spark, d, "documents").where(F.lower("text").contains(w)).select("doc_id")
    return has("milk").intersect(has("fresh"))


@query("set2_union", "SELECT id FROM product WHERE brand_normalized = 'klinaza' UNION SELECT product_id FROM product_category WHERE category_id = 7 AND product_id IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _products(spark, d).where("brand_normalized = 'klinaza'").select("id").union(table(spark, d, "product_category").where("category_id = 7 and product_id is not null").select("product_id")).distinct()


@query("set4_keep_first", "SELECT id, name_en, CAST(price AS DOUBLE) AS price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, price DESC NULLS LAST) AS r FROM product) WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    last = _products(spark, d).groupBy("id").agg(F.max(F.struct("updated_at", "price", "name_en")).alias("v"))
    return last.select("id", "v.name_en", F.col("v.price").cast("double").alias("price"))


@query("srt5_distinct_on", "SELECT product_id, slug FROM (SELECT pc.product_id, cc.slug, row_number() OVER (PARTITION BY pc.product_id ORDER BY cc.slug) AS r FROM product_category pc JOIN category c ON c.id = pc.category_id JOIN canonical_category cc ON cc.id = c.canonical_category_id WHERE pc.product_id IS NOT NULL) WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    canon = table(spark, d, "canonical_category").select(F.col("id").alias("canonical_category_id"), "slug")
    cats = table(spark, d, "category").join(canon, "canonical_category_id").groupBy(F.col("id").alias("category_id")).agg(F.min("slug").alias("slug"))
    return table(spark, d, "product_category").where("product_id is not null").join(cats, "category_id").groupBy("product_id").agg(F.min("slug").alias("slug"))


@query("srt6_multi_key_top", "SELECT brand_normalized AS value, count(*) AS n FROM product WHERE brand_normalized IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _products(spark, d).where("brand_normalized is not null").groupBy(F.col("brand_normalized").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(50)


@query("win2_runner_up_margin", "SELECT o_custkey, o_orderkey, round(o_totalprice - lead(o_totalprice) OVER w, 4) AS margin FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.lead("o_totalprice").over(w), 4).alias("margin"))


# --- entities


@query("jn12_similar_keys", ratio_sql("k AS (SELECT DISTINCT lower(display_name) AS x FROM canonical_brand), raw_pairs AS (SELECT a.x AS xa, b.x AS xb FROM k a JOIN k b ON a.x < b.x WHERE abs(length(a.x) - length(b.x)) * 100 <= 15 * (length(a.x) + length(b.x))), pairs AS (SELECT DISTINCT array_to_string(list_sort(string_split(xa, ' ')), ' ') AS a, array_to_string(list_sort(string_split(xb, ' ')), ' ') AS b FROM raw_pairs)") + "SELECT xa AS a, xb AS b, round(CAST(ratio AS DOUBLE), 6) AS score FROM raw_pairs JOIN ratio ON a = array_to_string(list_sort(string_split(xa, ' ')), ' ') AND b = array_to_string(list_sort(string_split(xb, ' ')), ' ') WHERE ratio >= 85")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "canonical_brand").select(F.lower("display_name").alias("key"))
    return entities.similar_keys(keys, 85.0).select("a", "b", F.round("score", 6).alias("score"))


_CO_SQL = "e AS (SELECT DISTINCT lower(trim(brand_raw_en)) AS a, trim(brand_raw_ar) AS b FROM product WHERE trim(brand_raw_en) <> '' AND trim(brand_raw_ar) <> '')"


@query("jn17_can5_components", f"WITH RECURSIVE {_CO_SQL}, dual AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e), reach AS (SELECT a AS node, min(b) AS low FROM dual GROUP BY 1), r USING KEY (node) AS (SELECT node, low FROM reach UNION SELECT x.node, min(x.low) FROM (SELECT dual.b AS node, r.low FROM r JOIN dual ON dual.a = r.node) x JOIN recurring.r o ON o.node = x.node WHERE x.low < o.low GROUP BY x.node) SELECT node, low AS component FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = _products(spark, d).where("trim(brand_raw_en) <> '' and trim(brand_raw_ar) <> ''").select(F.lower(F.trim("brand_raw_en")).alias("a"), F.trim("brand_raw_ar").alias("b"))
    return entities.components(e)


@query("can2_can3_canonical_values")
def _(spark: SparkSession, d: str) -> DataFrame:
    return entities.canonical_values(cut(entities.brand_values(_products(spark, d), ["brand_raw_en", "brand_raw_ar"])))


def _one_category(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "category").where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", "name_en", "name_ar")).alias("v"))
    return last.select("id", "v.name_en", "v.name_ar")


_CAN1_SQL = ratio_sql(f"""one AS (SELECT id, name_en, name_ar, {LATIN("coalesce(name_en, '')")} AS norm FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, name_en DESC NULLS LAST, name_ar DESC NULLS LAST) AS rn FROM category WHERE id IS NOT NULL) WHERE rn = 1),
n AS (SELECT category_id AS id, count(*) AS n FROM product_category GROUP BY 1), r AS (SELECT one.*, coalesce(n.n, 0) AS n, regexp_matches(norm, '^test[0-9]*$') AS junk FROM one LEFT JOIN n USING (id)),
s AS (SELECT norm FROM r WHERE NOT junk GROUP BY 1 HAVING count(*) = 1), pairs AS (SELECT DISTINCT x AS a, y AS b FROM (SELECT array_to_string(list_sort(string_split(norm, ' ')), ' ') AS x FROM s) JOIN (SELECT array_to_string(list_sort(string_split(norm, ' ')), ' ') AS y FROM s) ON x <= y AND abs(length(x) - length(y)) * 100 <= 15 * (length(x) + length(y)))""")


# the linkage itself is tested against a loop; here what is merged exactly, and whether a name that is left has any near one
@query("can1_category_methods", _CAN1_SQL + """SELECT r.id, CASE WHEN junk THEN 'junk_excluded' WHEN s.norm IS NULL THEN 'exact_auto_merge' WHEN EXISTS (SELECT 1 FROM ratio WHERE a <> b AND ratio >= 85 AND (a = array_to_string(list_sort(string_split(r.norm, ' ')), ' ') OR b = array_to_string(list_sort(string_split(r.norm, ' ')), ' '))) THEN 'near' ELSE 'singleton_unique' END AS method FROM r LEFT JOIN s ON s.norm = r.norm""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _one_category(spark, d)
    found = cut(entities.canonical_categories(rows, table(spark, d, "product_category")))
    single = found.where("method in ('fuzzy_candidate', 'singleton_unique')")
    near = entities.similar_keys(single.select(F.col("norm").alias("key")), 85.0)
    near = near.select(F.explode(F.array("a", "b")).alias("norm")).distinct().withColumn("near", F.lit(True))
    kind = F.when((F.col("method") == "fuzzy_candidate") | F.col("near"), "near").otherwise(F.col("method"))
    return found.join(near, "norm", "left").select("id", kind.alias("method"))


@query("can1_can6_apply_reviews")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _one_category(spark, d)
    found = entities.canonical_categories(rows, table(spark, d, "product_category"))
    # decisions as a reviewer would give them: groups by their smallest id
    decision = F.when(F.coalesce("group_id", "id") % 3 == 0, "reject").otherwise("approve")
    return entities.apply_reviews(found.join(rows, "id").withColumn("decision", decision))


@query("can5_survivors", f"WITH RECURSIVE {_CO_SQL}, dual AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e), reach AS (SELECT a AS node, min(b) AS low FROM dual GROUP BY 1), r USING KEY (node) AS (SELECT node, low FROM reach UNION SELECT x.node, min(x.low) FROM (SELECT dual.b AS node, r.low FROM r JOIN dual ON dual.a = r.node) x JOIN recurring.r o ON o.node = x.node WHERE x.low < o.low GROUP BY x.node), s AS (SELECT low, coalesce(min(CASE WHEN NOT regexp_matches(node, '[\\x{{600}}-\\x{{6FF}}\\x{{750}}-\\x{{77F}}]') THEN node END), min(node)) AS survivor FROM r GROUP BY 1) SELECT node AS key, survivor FROM r JOIN s USING (low)")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = cut(_products(spark, d).where("trim(brand_raw_en) <> '' and trim(brand_raw_ar) <> ''").select(F.lower(F.trim("brand_raw_en")).alias("a"), F.trim("brand_raw_ar").alias("b")).distinct())
    keys = e.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    return entities.survivors(e, keys.withColumn("script", F.when(T.is_arabic(F.col("key")), "arabic").otherwise("latin")))


@query("can4_review_gate", "SELECT id, CASE WHEN NOT coalesce(confidence < 95, false) THEN 'apply' WHEN slug LIKE 'a%' THEN 'apply' WHEN slug LIKE 'b%' THEN 'reject' ELSE 'pending' END AS gate FROM canonical_brand")
def _(spark: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("slug").startswith("a"), "Approve ").when(F.col("slug").startswith("b"), "reject")
    return table(spark, d, "canonical_brand").select("id", entities.review_gate(F.coalesce(F.col("confidence") < 95, F.lit(False)), decision).alias("gate"))


@query("can7_collapse_slugs", "SELECT slug, max_by(name_en, id) AS display, count(*) AS n FROM (SELECT DISTINCT id, name_en, trim(regexp_replace(lower(name_en), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM category) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "category").select(T.slugify(F.col("name_en")).alias("slug"), F.col("name_en").alias("display"), F.col("id").alias("ord")).distinct()
    return entities.collapse_slugs(rows)


@query("snk2_upsert", "SELECT coalesce(n.slug, o.slug) AS slug, coalesce(n.display, o.display_name_en) AS display FROM canonical_category o FULL JOIN (SELECT slug, max_by(display_name, id) AS display FROM canonical_brand GROUP BY 1) n ON n.slug = o.slug")
def _(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "canonical_category").select("slug", F.col("display_name_en").alias("display"))
    new = table(spark, d, "canonical_brand").select("slug", F.col("display_name").alias("display"), F.col("id").alias("ord"))
    return entities.upsert(old, new, "slug", ["display"])


# --- recommendation


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return S.mean_vector(e, ["label"]).select(F.col("label").cast("int").alias("cluster"), F.col("vector").alias("centroid"))


_CENTROID_SQL = "c AS (SELECT label AS cluster, list(x ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1), dist AS (SELECT vec_id AS id, cluster, list_distance(embedding::DOUBLE[], centroid) AS distance FROM embeddings, c), assigned AS (SELECT id, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, cluster) AS r FROM dist) WHERE r = 1)"


@query("rec2_assign", f"WITH {_CENTROID_SQL} SELECT id, CAST(cluster AS INT) AS cluster, round(distance, 6) AS distance FROM assigned")
def _(spark: SparkSession, d: str) -> DataFrame:
    return recommend.assign(_vectors(spark, d), _centroids(spark, d)).withColumn("distance", F.round("distance", 6))


@query("rec4_representatives", f"WITH {_CENTROID_SQL} SELECT CAST(cluster AS INT) AS cluster, id, r FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(distance, 9), id) AS r FROM assigned) WHERE r <= 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    return recommend.representatives(recommend.assign(_vectors(spark, d), _centroids(spark, d)))


@query("ag13_purity", f"WITH {_CENTROID_SQL}, n AS (SELECT cluster, label, count(*) AS k FROM assigned JOIN embeddings ON vec_id = id GROUP BY 1, 2) SELECT CAST(cluster AS INT) AS cluster, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_labels, round(max(k) / sum(k), 6) AS share FROM n GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return recommend.purity(recommend.assign(_vectors(spark, d), _centroids(spark, d)), labels).withColumn("share", F.round("share", 6))


@query("ag12_cluster_sizes", f"WITH {_CENTROID_SQL}, n AS (SELECT x.cluster, count(a.id) AS n FROM (SELECT unnest(range(10)) AS cluster) x LEFT JOIN assigned a ON a.cluster = x.cluster GROUP BY 1) SELECT min(n) AS smallest, median(n) AS middle, avg(n) AS mean, max(n) AS largest, count_if(n = 0) AS n_empty FROM n")
def _(spark: SparkSession, d: str) -> DataFrame:
    return recommend.sizes(recommend.assign(_vectors(spark, d), _centroids(spark, d)), 10)


@query("rec3_jn9_jn15_recommend", f"WITH {_CENTROID_SQL}, shown AS (SELECT label AS qid, min(vec_id) AS id FROM embeddings GROUP BY 1 UNION SELECT label, max(vec_id) FROM embeddings GROUP BY 1), m AS (SELECT qid, list(x ORDER BY i) AS v FROM (SELECT qid, i, avg(x) AS x FROM (SELECT s.qid, unnest(e.embedding)::DOUBLE AS x, unnest(range(len(e.embedding))) AS i FROM shown s JOIN embeddings e ON e.vec_id = s.id) GROUP BY 1, 2) GROUP BY 1), cl AS (SELECT DISTINCT s.qid, a.cluster FROM shown s JOIN assigned a USING (id)), sc AS (SELECT cl.qid, a.id, round(list_inner_product(e.embedding::DOUBLE[], m.v) / (sqrt(list_inner_product(m.v, m.v)) + 1e-9), 6) AS score FROM assigned a JOIN cl USING (cluster) JOIN m ON m.qid = cl.qid JOIN embeddings e ON e.vec_id = a.id WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.qid = cl.qid AND s.id = a.id)) SELECT qid, id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    ends = table(spark, d, "embeddings").groupBy(F.col("label").alias("qid")).agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("z"))
    shown = ends.select("qid", F.explode(F.array("a", "z")).alias("id")).distinct()
    return recommend.recommend(v, recommend.assign(v, _centroids(spark, d)), shown).withColumn("score", F.round("score", 6))


@query("rec1_fit_clusters")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return recommend.assign(v, recommend.fit_centroids(v, 16))

"""Queries of the text, similarity and corpus operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karwan.functions import similarity as S
from karwan.functions import text as T
from karwan.operators import corpus
from karwan.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_A, _B = T.compatibility_table()
COMPAT = lambda x: f"translate(regexp_replace({x}, '[\\x{{FEF5}}-\\x{{FEFC}}]', 'لا', 'g'), '{_A}', '{_B.replace(chr(39), chr(39) * 2)}')"
TIDY = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' .,-_')"
IS_AR = lambda x: f"regexp_matches({x}, '[\\x{{600}}-\\x{{6FF}}\\x{{750}}-\\x{{77F}}]')"
LATIN = lambda x: TIDY(f"lower({COMPAT(x)})")
ARAB = lambda x: TIDY(f"translate(regexp_replace({COMPAT(x)}, '[\\x{{64B}}-\\x{{652}}\\x{{670}}\\x{{640}}]', '', 'g'), 'أإآٱى', 'ااااي')")
NORM = lambda x: f"CASE WHEN {IS_AR(x)} THEN {ARAB(x)} ELSE {LATIN(x)} END"
TOKENS = lambda x: f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: {NORM('w')}), lambda w: w <> '')"
#: Words of the products' two names, and their singular by the corpus.
WORDS_SQL = f"""
WITH lists AS (SELECT id, list_concat({TOKENS('name_en')}, {TOKENS('name_ar')}) AS l FROM product),
raw AS (SELECT id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM lists),
base AS (SELECT token AS word, count(*) AS freq FROM raw WHERE NOT {IS_AR('token')} AND NOT regexp_matches(token, '^\\p{{Nd}}+$') GROUP BY 1),
forms AS (SELECT DISTINCT token, CASE WHEN length(token) <= 4 OR {IS_AR('token')} THEN token WHEN token LIKE '%ies' THEN left(token, -3) || 'y' WHEN token LIKE '%es' THEN left(token, -1) WHEN token LIKE '%s' AND token NOT LIKE '%ss' THEN left(token, -1) ELSE token END AS d,
  CASE WHEN length(token) <= 4 OR {IS_AR('token')} THEN token WHEN token LIKE '%ies' THEN left(token, -1) WHEN token LIKE '%es' THEN left(token, -2) WHEN token LIKE '%s' AND token NOT LIKE '%ss' THEN left(token, -1) ELSE token END AS a FROM raw),
best AS (SELECT token, CASE WHEN coalesce(x.freq, 0) <= 1 AND coalesce(y.freq, 0) > coalesce(x.freq, 0) AND token NOT IN ('burnes', 'kisses', 'ashes', 'matches', 'patches') THEN a ELSE d END AS b FROM forms LEFT JOIN base x ON x.word = d LEFT JOIN base y ON y.word = a),
toks AS (SELECT r.id, r.pos, b.b AS token FROM raw r JOIN best b USING (token)),
tf AS (SELECT id, token, count(*) AS tf FROM toks GROUP BY 1, 2),
dfreq AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
docs AS (SELECT p.id, coalesce(n, 0) AS length FROM (SELECT DISTINCT id FROM product) p LEFT JOIN (SELECT id, count(*) AS n FROM toks GROUP BY 1) USING (id)),
stats AS (SELECT count(*) AS n_docs, CAST(sum(length) AS BIGINT) AS total_length, avg(length) AS avg_length FROM docs)
"""
NAMES = ["name_en", "name_ar"]


@query("txt1_is_arabic", f"SELECT id, coalesce({IS_AR('brand_raw_ar')}, false) AS arabic FROM product")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product").select("id", F.coalesce(T.is_arabic(F.col("brand_raw_ar")), F.lit(False)).alias("arabic"))


@query("txt2_normalize_latin", f"SELECT id, {LATIN('name_en')} AS norm FROM product")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product").select("id", T.normalize_latin(F.col("name_en")).alias("norm"))


@query("txt3_normalize_arabic", f"SELECT id, {ARAB('name_ar')} AS norm FROM product")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product").select("id", T.normalize_arabic(F.col("name_ar")).alias("norm"))


@query("txt4_txt5_normalize", f"SELECT id, {NORM('name_ar')} AS norm_ar, {NORM('name_en')} AS norm_en FROM category")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "category").select("id", T.normalize(F.col("name_ar")).alias("norm_ar"), T.normalize(F.col("name_en")).alias("norm_en"))


@query("txt6_raw_tokens", WORDS_SQL + "SELECT id, CAST(pos AS INT) AS pos, token FROM raw")
def _(spark: SparkSession, d: str) -> DataFrame:
    return corpus.words(table(spark, d, "product"), NAMES)


@query("txt7_trim_plural", WORDS_SQL + "SELECT token AS word, b AS singular FROM best")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = corpus.words(table(spark, d, "product"), NAMES)
    words = raw.select(F.col("token").alias("word"), "token").distinct()
    return T.trim_plurals(words, corpus.base_frequency(raw)).select("word", F.col("token").alias("singular"))


@query("txt8_tokenize", WORDS_SQL + "SELECT id, CAST(pos AS INT) AS pos, token FROM toks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tokenize(table(spark, d, "product"), NAMES).select("id", "pos", "token")


@query("txt9_address_tokens", f"SELECT DISTINCT id, unnest({TOKENS(chr(39).join(['replace(url_key, ', '-', ', ', ' ', ')']))}) AS token FROM product")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "product")
    return p.select("id", F.explode(T.raw_tokens(F.replace(F.col("url_key"), F.lit("-"), F.lit(" ")))).alias("token")).distinct()


_SLUG = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


@query("txt10_slugify", f"SELECT id, {_SLUG.format(x='name_en')} AS slug FROM category")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "category").select("id", T.slugify(F.col("name_en")).alias("slug"))


@query("txt11_brand_slug", f"SELECT raw_value, CASE WHEN {_SLUG.format(x='raw_value')} <> '' THEN {_SLUG.format(x='raw_value')} WHEN {IS_AR('raw_value')} AND {ARAB('raw_value')} <> '' THEN {ARAB('raw_value')} ELSE 'brand_' || left(sha1(raw_value), 10) END AS slug FROM brand_alias")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "brand_alias").select("raw_value", T.brand_slug(F.col("raw_value")).alias("slug"))


@query("txt12_strip_article", "SELECT id, array_to_string(list_transform(string_split(name_ar, ' '), lambda w: CASE WHEN length(w) > 2 AND w LIKE 'ال%' THEN substr(w, 3) ELSE w END), ' ') AS bare FROM category")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "category").select("id", T.strip_article(F.col("name_ar")).alias("bare"))


@query("txt13_repeat_key", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '))) AS key FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.repeat_key(F.col("text"))).alias("key"))


_W = "(^|$|[^\\p{L}\\p{N}_])"
_JUNK_SQL = f"(regexp_matches(lower({{x}}), '{_W}(select|please|none|null|undefined|test|tbd|default|sample|placeholder|choose|unbranded|misc|n/?a|not specified|not applicable){_W}') OR regexp_matches({{x}}, 'اختر|يرجى|غير محدد|بدون'))"


def junk_sql(x: str) -> str:
    return _JUNK_SQL.replace("{x}", x)


@query("txt14_junk_flags", f"SELECT DISTINCT value, {junk_sql('value')} AS junk FROM (SELECT brand_raw_en AS value FROM product UNION ALL SELECT brand_raw_ar FROM product UNION ALL SELECT brand_normalized FROM product UNION ALL SELECT text FROM documents) WHERE value IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "product")
    values = p.select(F.explode(F.array("brand_raw_en", "brand_raw_ar", "brand_normalized")).alias("value")).unionByName(table(spark, d, "documents").select(F.col("text").alias("value")))
    return values.where("value is not null").distinct().select("value", T.is_placeholder_brand(F.col("value")).alias("junk"))


@query("txt14_test_categories", f"SELECT id, name_en, regexp_matches({LATIN('name_en')}, '^test[0-9]*$') AS junk FROM category UNION ALL SELECT id, 'Test' || id, true FROM category")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "category").select("id", "name_en")
    named = c.unionByName(c.select("id", F.concat(F.lit("Test"), F.col("id").cast("string")).alias("name_en")))
    return named.select("id", "name_en", T.is_test_category(T.normalize_latin(F.col("name_en"))).alias("junk"))


@query("txt15_embedding_text", """
WITH names AS (SELECT pc.product_id, array_to_string(list_sort(list(DISTINCT cc.display_name_en)), ', ') AS cats FROM product_category pc JOIN category c ON c.id = pc.category_id JOIN canonical_category cc ON cc.id = c.canonical_category_id GROUP BY 1)
SELECT DISTINCT p.id, concat_ws(' ', nullif(trim(p.name_en), ''), nullif(trim(p.name_ar), ''), n.cats) AS text FROM product p LEFT JOIN names n ON n.product_id = p.id""")  # fmt: skip
def _(spark: SparkSession, d: str) -> DataFrame:
    links, cat, canon = table(spark, d, "product_category"), table(spark, d, "category"), table(spark, d, "canonical_category")
    named = cat.join(canon.select(F.col("id").alias("canonical_category_id"), "display_name_en"), "canonical_category_id").select(F.col("id").alias("category_id"), "display_name_en").distinct()
    names = links.join(named, "category_id").groupBy(F.col("product_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("display_name_en")), ", ").alias("cats"))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    p = table(spark, d, "product").select("id", "name_en", "name_ar")
    return p.join(names, "id", "left").select("id", F.concat_ws(" ", blank("name_en"), blank("name_ar"), "cats").alias("text")).distinct()


@query("txt16_json_attribute", "SELECT id, CASE WHEN brand_raw_en IS NULL THEN NULL WHEN id % 3 = 0 THEN NULL WHEN trim(brand_raw_en, ' ') = '' THEN NULL ELSE brand_raw_en END AS brand FROM product")
def _(spark: SparkSession, d: str) -> DataFrame:
    # every third product gives its brand as a number first, so that nothing may be taken from what follows
    number = F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.lit("brand").alias("code"), F.lit(7).alias("value"))))
    brand = F.to_json(F.struct(F.lit("brand").alias("code"), F.col("brand_raw_en").alias("value")))
    other = F.to_json(F.struct(F.lit("size").alias("code"), F.col("name_ar").alias("value")))
    p = table(spark, d, "product").select("id", F.concat(F.lit("["), F.concat_ws(",", other, number, brand), F.lit("]")).alias("attributes"))
    return p.select("id", json_attribute(F.col("attributes"), "brand").alias("brand"))


def json_attribute(c, code: str):
    """The text value of the first object with that code in a JSON array; null for other kinds of value, blanks and bad JSON."""
    first = F.filter(F.try_parse_json(c).cast("array<variant>"), lambda v: F.try_variant_get(v, "$.code", "string") == code)
    value = F.try_variant_get(F.get(first, 0), "$.value", "variant")
    return F.when((F.schema_of_variant(value) == "STRING") & (F.trim(F.try_variant_get(value, "$", "string")) != ""), F.try_variant_get(value, "$", "string"))


_EDITS_SQL = """WITH w AS (SELECT DISTINCT slug AS word FROM canonical_brand), p AS (SELECT word, unnest(range(length(word) + 1)) AS i FROM w), l AS (SELECT chr(CAST(97 + unnest(range(26)) AS INT)) AS c),
e AS (SELECT word, 'deletion' AS kind, left(word, i) || substr(word, i + 2) AS v FROM p WHERE i < length(word)
UNION SELECT word, 'transposition', left(word, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3) FROM p WHERE i < length(word) - 1
UNION SELECT word, 'insertion', left(word, i) || c || substr(word, i + 1) FROM p, l
UNION SELECT word, 'substitution', left(word, i) || c || substr(word, i + 2) FROM p, l WHERE i < length(word))
SELECT word, kind, count(*) AS n, min(v) AS first_variant, max(v) AS last_variant FROM e WHERE v <> word GROUP BY 1, 2"""


@query("txt17_single_edits", _EDITS_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    made = T.single_edits(table(spark, d, "canonical_brand").select(F.col("slug").alias("word")).distinct())
    return made.groupBy("word", "kind").agg(F.count("*").alias("n"), F.min("variant").alias("first_variant"), F.max("variant").alias("last_variant"))


@query("ag1_base_frequency", WORDS_SQL + "SELECT word, freq FROM base")
def _(spark: SparkSession, d: str) -> DataFrame:
    return corpus.base_frequency(corpus.words(table(spark, d, "product"), NAMES))


@query("ag2_term_frequency", WORDS_SQL + "SELECT id, token, tf FROM tf")
def _(spark: SparkSession, d: str) -> DataFrame:
    return corpus.term_frequency(corpus.tokenize(table(spark, d, "product"), NAMES))


@query("ag3_document_frequency", WORDS_SQL + "SELECT token, df FROM dfreq")
def _(spark: SparkSession, d: str) -> DataFrame:
    return corpus.document_frequency(corpus.term_frequency(corpus.tokenize(table(spark, d, "product"), NAMES)))


@query("ag4_corpus_statistics", WORDS_SQL + "SELECT n_docs, total_length, round(avg_length, 6) AS avg_length FROM stats")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "product")
    return corpus.statistics(corpus.lengths(p, corpus.tokenize(p, NAMES))).withColumn("avg_length", F.round("avg_length", 6))


@query("ag18_ngram_support", f"""
WITH w AS (SELECT doc_id AS id, list_filter({TOKENS('text')}, lambda x: length(x) >= 2) AS w FROM documents),
g AS (SELECT DISTINCT id, 2 AS n, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS ngram FROM w UNION SELECT DISTINCT id, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w)
SELECT ngram, n, count(*) AS support FROM g GROUP BY 1, 2 HAVING count(*) >= 3""")  # fmt: skip
def _(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ngrams(table(spark, d, "documents"), "text", id_col="doc_id")


def _brand_pairs(spark: SparkSession, d: str) -> DataFrame:
    alias, brand = table(spark, d, "brand_alias"), table(spark, d, "canonical_brand")
    return alias.join(brand.select(F.col("id").alias("canonical_brand_id"), "display_name"), "canonical_brand_id").select(F.col("raw_value").alias("a"), F.col("display_name").alias("b")).distinct()


_PAIRS = "pairs AS (SELECT DISTINCT raw_value AS a, display_name AS b FROM brand_alias JOIN canonical_brand ON canonical_brand.id = canonical_brand_id)"


def ratio_sql(pairs: str, a: str = "a", b: str = "b") -> str:
    """SQL of the Indel ratio of every pair of the CTE `pairs`: the rows of the dynamic programme, recursively."""
    return f"""WITH RECURSIVE {pairs},
dp AS (SELECT a, b, 0 AS i, list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT)) AS row_ FROM pairs
 UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j, CASE WHEN substr({b}, j, 1) = substr({a}, i + 1, 1) THEN row_[j] + 1 ELSE -1 END, row_[j + 1]]), lambda acc, s: list_append(acc, CASE WHEN s[2] >= 0 THEN s[2] ELSE greatest(s[3], acc[len(acc)]) END), [CAST(0 AS BIGINT)]) FROM dp WHERE i < length({a})),
ratio AS (SELECT a, b, CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * row_[len(row_)] / (length({a}) + length({b})) END AS ratio FROM dp WHERE i = length({a}))
"""


@query("sim1_indel_ratio", ratio_sql(_PAIRS) + "SELECT a, b, round(CAST(ratio AS DOUBLE), 6) AS ratio FROM ratio")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _brand_pairs(spark, d).select("a", "b", F.round(S.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


_SORTED = lambda x: f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


@query("sim2_token_sort_ratio", ratio_sql(f"raw_pairs AS (SELECT DISTINCT raw_value AS x, display_name AS y FROM brand_alias JOIN canonical_brand ON canonical_brand.id = canonical_brand_id), pairs AS (SELECT DISTINCT {_SORTED('x')} AS a, {_SORTED('y')} AS b FROM raw_pairs)") + f"SELECT x AS a, y AS b, round(CAST(ratio AS DOUBLE), 6) AS ratio FROM raw_pairs JOIN ratio ON a = {_SORTED('x')} AND b = {_SORTED('y')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _brand_pairs(spark, d).select("a", "b", F.round(S.token_sort_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("sim3_extract_one", ratio_sql("l AS (SELECT DISTINCT replace(brand_normalized, '_', ' ') AS a FROM product WHERE brand_normalized <> ''), r AS (SELECT DISTINCT lower(display_name) AS b FROM canonical_brand), pairs AS (SELECT a, b FROM l, r WHERE abs(length(a) - length(b)) * 10 <= length(a) + length(b) AND levenshtein(a, b) * 10 <= length(a) + length(b))") + "SELECT a AS value, min_by(b, (-round(CAST(ratio AS DOUBLE), 6), b)) AS best, round(CAST(max(ratio) AS DOUBLE), 6) AS score FROM ratio WHERE ratio >= 90 GROUP BY a")
def _(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "product").select(F.replace(F.col("brand_normalized"), F.lit("_"), F.lit(" ")).alias("l"))
    right = table(spark, d, "canonical_brand").select(F.lower("display_name").alias("r"))
    pairs = S.similar_pairs(left, right, 90.0).withColumn("score", F.round("score", 6))
    return pairs.groupBy(F.col("l").alias("value")).agg(F.min_by("r", F.struct(-F.col("score"), "r")).alias("best"), F.max("score").alias("score"))


@query("sim5_delete_neighbourhood", "WITH w AS (SELECT DISTINCT regexp_replace(lower(brand_raw_en), '[^ -~]', '', 'g') AS word FROM product WHERE regexp_replace(lower(brand_raw_en), '[^ -~]', '', 'g') <> ''), v AS (SELECT regexp_replace(lower(display_name), '[^ -~]', '', 'g') AS candidate, count(*) AS freq FROM canonical_brand GROUP BY 1) SELECT word, candidate, freq, CAST(levenshtein(word, candidate) AS INT) AS edits FROM w, v WHERE levenshtein(word, candidate) <= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "product").select(F.regexp_replace(F.lower("brand_raw_en"), "[^ -~]", "").alias("word")).where("word <> ''")
    vocabulary = table(spark, d, "canonical_brand").groupBy(F.regexp_replace(F.lower("display_name"), "[^ -~]", "").alias("candidate")).agg(F.count("*").alias("freq"))
    return S.neighbours_by_deletes(words, vocabulary, prefix=64).select("word", "candidate", "freq", "edits")


@query("sim6_cosine_distance", "SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(S.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("sim7_ag11_mean_vector", "SELECT label, CAST(i AS INT) AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.mean_vector(table(spark, d, "embeddings"), ["label"]).select("label", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))

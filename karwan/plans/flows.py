"""Queries of the source, sink, phrase and session operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karwan.functions import text as T
from karwan.operators import retrieval
from karwan.plans import phrases
from karwan.plans.texts import IS_AR, NAMES, NORM, TOKENS, WORDS_SQL, ratio_sql
from karwan.runtime import checkpoint_folder, cut, table
from karwan.sources import dump
from karwan.streaming import sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _dump_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every product name as a line of a dump, with quotes and backslashes escaped."""
    quote = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")), F.lit("NULL"))
    p = table(spark, d, "product")
    return p.select(F.concat(F.lit("INSERT INTO `names` VALUES ("), F.col("id").cast("string"), F.lit(","), quote(F.col("name_ar")), F.lit(","), quote(F.col("brand_raw_en")), F.lit("),("), F.col("id").cast("string"), F.lit(",'a (b), \\'c\\'\\n',NULL);")).alias("value"))


@query("src1_src4_dump_rows", "SELECT CAST(id AS VARCHAR) AS id, name_ar AS name, brand_raw_en AS brand FROM product UNION ALL SELECT CAST(id AS VARCHAR), 'a (b), ''c''' || chr(10), NULL FROM product")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The dump is written to the checkpoint folder and read from there as any dump is."""
    path = f"{checkpoint_folder(spark)}/dump-{uuid.uuid4().hex}"
    _dump_lines(spark, d).write.text(path)
    return dump.read_table(spark, path, "names", ["id", "name", "brand"])


@query("src5_typed_projection", "SELECT CAST(id AS BIGINT) AS id, CAST(price AS DOUBLE) AS price, created_at FROM product WHERE price IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product").where("price is not null").select(F.col("id").cast("long").alias("id"), F.col("price").cast("double").alias("price"), "created_at")


@query("snk7_completeness", "SELECT 'product without name' AS problem, count(*) AS n FROM product WHERE trim(coalesce(name_en, '')) = '' UNION ALL SELECT 'negative price', count(*) FROM product WHERE price < 0 UNION ALL SELECT 'category without parent row', count(*) FROM category c WHERE parent_category_id IS NOT NULL AND parent_category_id NOT IN (SELECT id FROM category)")
def _(spark: SparkSession, d: str) -> DataFrame:
    p, c = table(spark, d, "product"), table(spark, d, "category")
    n = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    lost = c.where("parent_category_id is not null").join(c.select(F.col("id").alias("parent_category_id")).distinct(), "parent_category_id", "left_anti")
    return n(p.where("trim(coalesce(name_en, '')) = ''"), "product without name").union(n(p.where("price < 0"), "negative price")).union(n(lost, "category without parent row"))


def _category_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_category")
    return c.select("slug", F.col("display_name_en").alias("phrase")).union(c.select("slug", "display_name_ar"))


def _names(spark: SparkSession, d: str) -> phrases.Names:
    product, brand = table(spark, d, "product"), table(spark, d, "canonical_brand").select(F.col("id").alias("canonical_brand_id"), "slug")
    canon = table(spark, d, "canonical_category").select(F.col("id").alias("canonical_category_id"), "slug")
    cats = table(spark, d, "category").join(canon, "canonical_category_id").select(F.col("id").alias("category_id"), "slug").distinct()
    in_category = table(spark, d, "product_category").select("category_id", F.col("product_id").alias("id")).join(cats, "category_id").select("slug", "id").distinct()
    in_brand = product.where("brand_normalized is not null").select(F.col("brand_normalized").alias("slug"), "id").distinct()
    brands = table(spark, d, "brand_alias").join(brand, "canonical_brand_id").select("slug", F.col("raw_value").alias("phrase"))
    return phrases.Names(retrieval.Index.build(product, NAMES), _category_names(spark, d), cut(brands), cut(in_category), cut(in_brand))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "product")
    return p.groupBy(F.col("id").alias("qid")).agg(F.min("name_en").alias("q"))


def _typed_brands(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "product").where("trim(brand_raw_en) <> ''")
    return p.groupBy(F.col("brand_raw_en").alias("q")).agg(F.min("id").alias("qid"))


_EDGE = "[^\\p{L}\\p{N}_]"
_CATEGORY_SQL = "SELECT slug, display_name_en AS p FROM canonical_category UNION SELECT slug, display_name_ar FROM canonical_category"
#: The aliases, written out for the SQL alone.
_ALIAS_SQL = """SELECT * FROM (VALUES ('cheese', 'جبنة'), ('cheese', 'جبن'), ('meat', 'لحمة'), ('milk_29', 'لبن'), ('milk_29', 'حليب'), ('seafood', 'سمك'), ('seafood', 'سمكة'), ('vegetables_3286', 'خضار'),
('vegetables_3286', 'خضرة'), ('nuts_seeds_16871', 'مكسرة'), ('cereals_5700', 'حبة'), ('canned_vegetables_fruits_5697', 'خضار معلبة'), ('frozen_vegetables_11674', 'خضار مجمدة'),
('full_cream_milk_31', 'full fat milk'), ('skimmed_milk_39', 'low fat milk')) t(slug, p)"""
_PATTERN = "array_to_string(list_transform(w, lambda x: CASE WHEN x LIKE 'ال%' AND length(x) > 2 THEN '(?:ال)?' || regexp_escape(substr(x, 3)) ELSE regexp_escape(x) END), '\\s+')"


def _exact_sql(texts: str, names: str) -> str:
    pieces = "regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|\\s+|[^\\p{{L}}\\p{{N}}_\\s]+')"
    return f"""WITH q AS ({texts}), ph AS (SELECT DISTINCT slug, list_filter(string_split_regex(lower(p), '\\s+'), lambda x: x <> '') AS w FROM ({names})),
mask AS (SELECT slug, w, unnest(range(1 << len(w))) AS m FROM ph WHERE len(w) > 0),
var0 AS (SELECT DISTINCT slug, len(w) AS words, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] LIKE 'ال%' AND length(w[i]) > 2 AND (m >> CAST(i - 1 AS INT)) & 1 = 1 THEN substr(w[i], 3) ELSE w[i] END), ' ') AS key FROM mask),
var AS (SELECT *, len({pieces.format(x='key')}) AS n FROM var0), tp AS (SELECT qid, q, {pieces.format(x='q')} AS p FROM q), ti AS (SELECT qid, q, p, unnest(range(1, len(p) + 1)) AS i FROM tp),
run AS (SELECT qid, q, i, n, length(array_to_string(p[1:i - 1], '')) AS start, array_to_string(p[i:i + n - 1], '') AS txt FROM ti JOIN (SELECT DISTINCT n FROM var) v ON i + n - 1 <= len(p) WHERE regexp_matches(p[i], '^[\\p{{L}}\\p{{N}}_]') AND regexp_matches(p[i + n - 1], '^[\\p{{L}}\\p{{N}}_]')),
hit AS (SELECT qid, q, slug, words, min(start) AS start FROM run JOIN var ON var.n = run.n AND var.key = regexp_replace(lower(txt), '\\s+', ' ', 'g') GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY words DESC, CASE WHEN {IS_AR('q')} THEN start ELSE -start END, slug) AS r FROM hit)
"""


@query("prs2_prs3_phrase_match", _exact_sql("SELECT 2 * id AS qid, min(name_en) AS q FROM product GROUP BY id UNION ALL SELECT 2 * id + 1, min(name_ar) FROM product GROUP BY id", _CATEGORY_SQL) + "SELECT qid, slug, CAST(start AS INT) AS start, CAST(words AS INT) AS words FROM best WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "product")
    texts = p.groupBy("id").agg(F.min("name_en").alias("e"), F.min("name_ar").alias("a"))
    texts = texts.select((2 * F.col("id")).alias("qid"), F.col("e").alias("q")).union(texts.select(2 * F.col("id") + 1, "a"))
    return phrases.exact_phrases(texts, _category_names(spark, d)).select("qid", "slug", "start", "words")


_STRIP = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda v: CASE WHEN length(v) > 2 AND v LIKE 'ال%' THEN substr(v, 3) ELSE v END), ' ')"
_ASKED_SQL = "SELECT id AS qid, min(name_en) AS q FROM product GROUP BY id"
_IN_CATEGORY = "SELECT DISTINCT cc.slug, pc.product_id AS id FROM product_category pc JOIN category c ON c.id = pc.category_id JOIN canonical_category cc ON cc.id = c.canonical_category_id"
_IN_BRAND = "SELECT DISTINCT brand_normalized AS slug, id FROM product WHERE brand_normalized IS NOT NULL"
_BRAND_SQL = "SELECT b.slug, a.raw_value AS p FROM brand_alias a JOIN canonical_brand b ON b.id = a.canonical_brand_id"
_CATEGORY_BLOCKED_SQL = "['price', 'venus', 'cheesa', 'break', 'dream', 'farm cheese', 'delia', 'milka', 'astra', 'beast', 'chocodate', 'nucream', 'me', 'من', 'زي', 'اي']"
_BRAND_BLOCKED_SQL = """['wafer', 'wafers', 'fish', 'chip', 'chips', 'salt', 'flour', 'yeast', 'baking', 'wine', 'dairy', 'clean', 'spicy', 'مايونيز', 'حلوى', 'خميرة', 'زبادي', 'لين', 'شامبو', 'breast', 'براند', 'an', 'or', 'for', 'any', 'sure',
'fine', 'today', 'in', 'on', 'at', 'much', 'but', 'if', 'give', 'shall', 'down', 'off', 'over', 'again', 'one', 'في', 'إلى', 'الى', 'هل', 'لا', 'كام', 'لأ', 'انا', 'انتي', 'فيه', 'فين', 'اي', 'cookie', 'dish', 'fat']"""


def _windows_sql(texts: str, longest: int, blocked: str = "[]", excluded: str = "[]") -> str:
    """WORDS_SQL without its WITH, then the windows of the texts."""
    return f"""{WORDS_SQL.strip()[5:]}, q AS ({texts}), wq AS (SELECT qid, list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '') AS w FROM q), spots AS (SELECT qid, w, unnest(range(len(w))) AS start FROM wq),
win0 AS (SELECT qid, start, n AS words, w[start + 1:start + n] AS parts FROM (SELECT *, unnest(range(1, least({longest}, len(w) - start) + 1)) AS n FROM spots)),
win1 AS (SELECT *, array_to_string(parts, ' ') AS phrase0 FROM win0),
win AS (SELECT qid, start, words, parts, {NORM('phrase0')} AS phrase FROM win1 WHERE {NORM('phrase0')} <> '' AND NOT list_contains(list_transform({blocked}::VARCHAR[], lambda x: {NORM('x')}), {NORM('phrase0')}) AND NOT list_has_any(list_transform(parts, lambda x: {NORM('x')}), {excluded}::VARCHAR[]))"""


def _evidence_sql(found: str) -> str:
    return f"""hp AS (SELECT DISTINCT parts FROM {found}), ht0 AS (SELECT parts, ({TOKENS('v')})[1] AS token FROM (SELECT parts, unnest(parts) AS v FROM hp)),
ht AS (SELECT DISTINCT parts, coalesce(best.b, token) AS token FROM ht0 LEFT JOIN best USING (token) WHERE parts NOT IN (SELECT parts FROM ht0 WHERE token IS NULL)), hn AS (SELECT parts, count(*) AS k FROM ht GROUP BY 1),
hd AS (SELECT ht.parts, tf.id FROM ht JOIN tf USING (token) JOIN hn ON hn.parts = ht.parts GROUP BY ht.parts, tf.id, hn.k HAVING count(*) = hn.k), sup AS (SELECT parts, count(*) AS n FROM hd GROUP BY 1 HAVING count(*) >= 3)"""


def _fuzzy_sql(texts: str, names: str, members: str | None, longest: int, blocked: str = "[]", excluded: str = "[]", articles: bool = False) -> str:
    strip = lambda x: _STRIP(x) if articles else x
    ctes = f"""{_windows_sql(texts, longest, blocked, excluded)}, kn AS (SELECT DISTINCT slug, {NORM('p')} AS r FROM ({names}) WHERE {NORM('p')} <> ''),
wf AS (SELECT DISTINCT phrase, phrase AS l, 0 AS kind FROM win UNION SELECT DISTINCT phrase, {strip('phrase')}, 1 FROM win), kf AS (SELECT slug, r AS k, 0 AS kind FROM kn UNION SELECT slug, {strip('r')}, 1 FROM kn),
pairs AS (SELECT DISTINCT l AS a, k AS b FROM wf JOIN (SELECT DISTINCT k, kind FROM kf) USING (kind) WHERE l <> '' AND k <> '' AND abs(length(l) - length(k)) * 10 <= 2 * (length(l) + length(k)) AND levenshtein(l, k) * 10 <= CASE WHEN strlen(l) = length(l) AND strlen(k) = length(k) THEN 2 ELSE 4 END * (length(l) + length(k)))"""
    overlap = f"ov AS (SELECT hd.parts, m.slug, count(*) AS both FROM hd JOIN ({members}) m USING (id) GROUP BY 1, 2)" if members else "ov AS (SELECT NULL::VARCHAR[] AS parts, NULL::VARCHAR AS slug, 0 AS both)"
    return f"""{ratio_sql(ctes).rstrip()},
scored AS (SELECT wf.phrase, kf.slug, max(round(CAST(ratio AS DOUBLE), 9)) AS score FROM wf JOIN ratio ON a = wf.l JOIN kf ON kf.kind = wf.kind AND kf.k = ratio.b WHERE ratio >= 79.999999 GROUP BY 1, 2),
hits AS (SELECT qid, start, words, parts, slug, max(score) AS score FROM win JOIN scored USING (phrase) GROUP BY ALL), {_evidence_sql('hits')}, {overlap},
ok AS (SELECT h.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, words DESC, start, h.slug) AS rn FROM hits h LEFT JOIN sup ON sup.parts = h.parts LEFT JOIN ov ON ov.parts = h.parts AND ov.slug = h.slug
  WHERE score >= CASE WHEN sup.n IS NOT NULL AND coalesce(ov.both, 0) / sup.n < 0.1 THEN 95 ELSE 80 END - 1e-9)
SELECT ok.qid, slug, CAST(start AS INT) AS start, CAST(words AS INT) AS words, round(score, 6) AS score, array_to_string(list_concat(w[1:start], w[start + words + 1:]), ' ') AS rest FROM ok JOIN wq ON wq.qid = ok.qid WHERE rn = 1"""


@query("prs4_prs6_prs8_jn13_fuzzy_category", _fuzzy_sql(_ASKED_SQL, f"{_CATEGORY_SQL} UNION {_ALIAS_SQL}", _IN_CATEGORY, 6, _CATEGORY_BLOCKED_SQL, articles=True))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).fuzzy_category(_asked(spark, d))


@query("prs7_fuzzy_brand", _fuzzy_sql(_ASKED_SQL, _BRAND_SQL, _IN_BRAND, 3, _BRAND_BLOCKED_SQL, "['بدون']"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).fuzzy_brand(_asked(spark, d))


@query("prs17_brand_text", f"SELECT qid, slug FROM ({_fuzzy_sql(chr(83) + 'ELECT min(id) AS qid, brand_raw_en AS q FROM product WHERE trim(brand_raw_en) <> ' + chr(39) * 2 + ' GROUP BY brand_raw_en', _BRAND_SQL, None, 3)})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).brand_text(_typed_brands(spark, d))


@query("prs5_prs14_attested_window", f"WITH {_windows_sql(_ASKED_SQL, 4)}, w2 AS (SELECT * FROM win WHERE words >= 2), {_evidence_sql('w2')} SELECT qid, CAST(start AS INT) AS start, CAST(words AS INT) AS words, n AS support FROM (SELECT qid, start, words, n, row_number() OVER (PARTITION BY qid ORDER BY words DESC, start) AS r FROM w2 JOIN sup USING (parts)) WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return phrases.attested_window(retrieval.Index.build(table(spark, d, "product"), NAMES), _asked(spark, d))


@query("prs13_protected_words", f"""WITH q0 AS ({_ASKED_SQL}), w AS (SELECT DISTINCT qid, unnest(list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '')) AS v FROM q0),
ph AS (SELECT DISTINCT list_filter(string_split_regex(lower(p), '\\s+'), lambda x: x <> '') AS w FROM ({_CATEGORY_SQL} UNION {_ALIAS_SQL})), pt AS (SELECT {_PATTERN} AS pat FROM ph WHERE len(w) = 1),
hit AS (SELECT DISTINCT v FROM (SELECT DISTINCT v FROM w) JOIN pt ON regexp_matches(v, '(?is)(?:^|{_EDGE})' || pat || '(?:{_EDGE}|$)'))
SELECT DISTINCT qid, {NORM('v')} AS word FROM w JOIN hit USING (v)""")  # fmt: skip
def _(spark: SparkSession, d: str) -> DataFrame:
    names = phrases.Names(None, _category_names(spark, d), None, None, None)
    return names.protected_words(_asked(spark, d)).distinct()


# compositions of the steps above, tested on planted texts
@query("prs9_prs11_prs12_prs15_prs16_parse")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).parse(_asked(spark, d))


@query("prs18_category_hint")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).category_hint(_typed_brands(spark, d))


# every query's text goes through the parser; its category and brand are the candidates, what is left of it ranks them
@query("hyb4_search_text")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    brand = table(spark, d, "canonical_brand").select("id", F.col("display_name").alias("brand"))
    asked = table(spark, d, "canonical_category").join(brand, "id").select(F.col("id").alias("qid"), F.concat_ws(" ", "brand", "display_name_en").alias("q"))
    asked = asked.unionByName(table(spark, d, "canonical_category").select((F.col("id") + 1000).alias("qid"), F.concat_ws(" ", F.lit("family pack"), "display_name_en").alias("q")))
    parsed = cut(names.parse(asked))
    rows = table(spark, d, "product").select("id", *NAMES, "sku", "url_key")
    in_category = cut(parsed.join(names.category_members.withColumnRenamed("slug", "category"), "category").select("qid", "id"))
    in_brand = cut(parsed.join(names.brand_members.withColumnRenamed("slug", "brand"), "brand").select("qid", "id"))
    ranked = retrieval.rank(names.index, parsed.where("text is not null").select("qid", F.col("text").alias("q")), rows)
    bare = in_category.union(in_brand).distinct().join(parsed.where("text is null").select("qid"), "qid", "left_semi").withColumn("score", F.lit(0.0))
    found = cut(ranked.unionByName(bare))
    for known, held in (("category", in_category), ("brand", in_brand)):
        has = parsed.where(F.col(known).isNotNull()).select("qid")
        found = found.join(has, "qid", "left_anti").unionByName(found.join(has, "qid", "left_semi").join(held, ["qid", "id"], "left_semi"))
    return retrieval.ranked(found.withColumn("score", F.round("score", 6)), [F.desc("score")], 20).select("qid", "id", "score", "r", "total")


@query("st3_idle_sessions", "SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 2700000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "session_no")


@query("st3_session_windows", "WITH s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 2700000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start_us FROM s GROUP BY user_id, s")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = sessions.session_windows(table(spark, d, "events"), "user_id", "ts")
    return w.select("user_id", "n", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"))


@query("win4_win5_win6_history", "SELECT event_id, first_value(event_type) OVER w AS first_value, lag(event_type) OVER w AS previous, coalesce(array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ','), '') AS last_n, row_number() OVER w AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    h = sessions.history(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")
    return h.select("event_id", "first_value", "previous", F.array_join("last_n", ",").alias("last_n"), "turn")


# an ordered fold: tested against a loop
@query("st4_repeats")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sessions.repeats(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_id", "event_type").select("event_id", "blocked")


@query("txt1_script_counts", "SELECT lang, count(*) AS n, count_if(coalesce(regexp_matches(text, '[\\x{600}-\\x{6FF}\\x{750}-\\x{77F}]'), false)) AS n_arabic FROM documents GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.coalesce(T.is_arabic(F.col("text")), F.lit(False))).alias("n_arabic"))

"""Free text to known names: exact and fuzzy phrase matches, their evidence in the corpus, and a query's category and brand.

Queries are rows (qid, q) and run together. Every step gives at most one row a query: (qid, slug, ..., rest), where rest is the
text without what was matched; a query that matches nothing has no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karwan.functions import similarity as S
from karwan.functions import text as T
from karwan.operators.retrieval import Index
from karwan.runtime import cut, small

# Least similarity, that of words with evidence of their own, documents that make such evidence, and the share of
# them that a name must hold to be exempt from it.
CUTOFF, STRICT, ATTESTED, OVERLAP = 80.0, 95.0, 3, 0.1
# Fixed value: names at most whose pieces are broadcast.
FEW = 5_000
# Words of a window at most, for brands, categories and evidence.
BRAND_WORDS, CATEGORY_WORDS, EVIDENCE_WORDS = 3, 6, 4
# Windows that are never a brand.
BRAND_BLOCKED = (
    "wafer", "wafers", "fish", "chip", "chips", "salt", "flour", "yeast", "baking", "wine", "dairy", "clean", "spicy", "مايونيز", "حلوى", "خميرة", "زبادي",
    "لين", "شامبو", "breast", "براند", "an", "or", "for", "any", "sure", "fine", "today", "in", "on", "at", "much", "but", "if", "give", "shall", "down",
    "off", "over", "again", "one", "في", "إلى", "الى", "هل", "لا", "كام", "لأ", "انا", "انتي", "فيه", "فين", "اي", "cookie", "dish", "fat",
)
# Fixed value: a word that no brand holds.
BRAND_EXCLUDED = ("بدون",)
# Windows that are never a category.
CATEGORY_BLOCKED = ("price", "venus", "cheesa", "break", "dream", "farm cheese", "delia", "milka", "astra", "beast", "chocodate", "nucream", "me", "من", "زي", "اي")
# What people call a category in the singular, and compounds, by slug.
SINGULAR_ALIASES = {
    "cheese": ("جبنة", "جبن"), "meat": ("لحمة",), "milk_29": ("لبن", "حليب"), "seafood": ("سمك", "سمكة"), "vegetables_3286": ("خضار", "خضرة"), "nuts_seeds_16871": ("مكسرة",),
    "cereals_5700": ("حبة",), "canned_vegetables_fruits_5697": ("خضار معلبة",), "frozen_vegetables_11674": ("خضار مجمدة",),
}
COMPOUND_ALIASES = {"full_cream_milk_31": ("full fat milk",), "skimmed_milk_39": ("low fat milk",)}
# Negations in the order in which they are tried, words behind one that may name what is left out, marks of a free-from name.
NEGATIONS = (r"من\s+غير", "بدون", "without", "no", r"free\s+from")
NEGATED_WORDS = 3
FREE_MARKS = ("free", "خالي", "خال")

_EDGE = r"[^\p{L}\p{N}_]"


def _words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def _normal(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(T.normalized(v)) for v in values])


def _among(c: Column, values: tuple[str, ...]) -> Column:
    return F.array_contains(_normal(values), c) if values else F.lit(False)


def _forms(bare: Callable[[Column], Column]) -> Column:
    """The phrase with its leading articles and, if that differs, without."""
    p = F.col("phrase")
    return F.when(bare(p) == p, F.array(p)).otherwise(F.array(p, bare(p)))


def _spans(queries: DataFrame, longest: int, own: bool = False) -> DataFrame:
    """(qid, w, start, words, phrase): windows() with all words of the text; own: beside them its words as each normalises by itself.

    Words are normalised once a text and only put together for its windows: the script of a whole window decides which of
    a word's two forms counts.
    """
    q = F.coalesce("q", F.lit(""))
    text = queries.select("qid", q.alias("q"), _words(q).alias("w"), _words(T.fold_latin(q)).alias("latin"), T.is_arabic(q).alias("mixed"))
    text = text.withColumn("arabic", F.when(F.col("mixed"), F.transform("w", T.fold_arabic))).withColumn("which", F.when(F.col("mixed"), F.transform("w", T.is_arabic)))
    edges = F.lit(T.EDGES)
    kept = ["qid", "w", "latin", "arabic", "which"]
    if own:
        text = text.withColumn("own", F.when(F.col("mixed"), F.transform("w", T.normalize)).otherwise(F.transform("latin", lambda x: F.btrim(x, edges))))
        kept.append("own")
    each = text.where("size(w) > 0").select(*kept, F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("start"))
    each = each.select(*kept, "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("start")))).alias("words"))
    of = lambda c: F.slice(c, F.col("start") + 1, F.col("words"))
    arabic = F.array_join(F.filter(of("arabic"), lambda x: x != ""), " ")
    phrase = F.btrim(F.when(F.col("which").isNotNull() & F.array_contains(of("which"), True), arabic).otherwise(F.array_join(of("latin"), " ")), edges)
    return each.select("qid", "w", "start", "words", phrase.alias("phrase"), *(["own"] if own else [])).where("phrase <> ''")


def _parts() -> Column:
    return F.slice("w", F.col("start") + 1, F.col("words"))


def windows(queries: DataFrame, longest: int) -> DataFrame:
    """(qid, start, words, parts, phrase): every run of at most `longest` words of queries(qid, q), as typed and normalised as a whole."""
    return _spans(queries, longest).select("qid", "start", "words", _parts().alias("parts"), "phrase")


def exact_phrases(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """(qid, slug, start, words, rest): the known phrase(slug, phrase) with most words that the text holds; start counts characters.

    Case doesn't count, words may be any blanks apart, a leading article of a phrase's word may be missing, and a phrase must not
    start or end inside a word. Of each phrase the first place counts; of phrases with equally many words the first in a text
    with Arabic letters, the last otherwise, then the smallest slug. It is an equality join of the texts' runs of pieces (words,
    blanks and signs) with the phrases', of any length.
    """
    piece = F.lit(r"([\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]+)")
    pieces = lambda c: F.regexp_extract_all(c, piece, F.lit(1))
    # a word with an article stands for itself and for the word without it
    option = lambda w: F.when(w.startswith("ال") & (F.char_length(w) > 2), F.array(w, w.substr(F.lit(3), F.char_length(w)))).otherwise(F.array(w))
    spell = lambda done, w: F.flatten(F.transform(done, lambda d: F.transform(option(w), lambda o: F.when(d == "", o).otherwise(F.concat(d, F.lit(" "), o)))))
    known = phrases.select("slug", _words(F.lower("phrase")).alias("w")).where("size(w) > 0").distinct()
    known = known.select("slug", F.size("w").alias("words"), F.explode(F.aggregate("w", F.array(F.lit("")), spell)).alias("key"))
    known = cut(known.withColumn("n", F.size(pieces(F.col("key")))).distinct())
    sizes = F.array(*[F.lit(r.n) for r in known.select("n").distinct().collect()]).cast("array<int>")  # one number a length
    texts = queries.select("qid", F.coalesce("q", F.lit("")).alias("q")).withColumn("p", pieces(F.col("q")))
    # blanks are made one once a text, so that a run is only put together
    texts = texts.withColumn("even", F.transform("p", lambda x: F.when(F.btrim(x, F.lit(" \t\n\x0b\f\r")) == "", " ").otherwise(x)))
    at = texts.select("qid", "q", "p", "even", F.posexplode("p").alias("i", "x")).where(F.col("x").rlike(r"^[\p{L}\p{N}_]")).drop("x")
    runs = at.withColumn("n", F.explode(sizes)).where("i + n <= size(p)")
    hits = runs.withColumn("key", F.lower(F.array_join(F.slice("even", F.col("i") + 1, F.col("n")), ""))).join(small(known, 20_000), ["key", "n"])
    hits = hits.withColumn("start", F.char_length(F.array_join(F.slice("p", 1, F.col("i")), ""))).withColumn("text", F.array_join(F.slice("p", F.col("i") + 1, F.col("n")), ""))
    hits = hits.where(F.col("text").rlike(r"[\p{L}\p{N}_]$"))
    first = hits.groupBy("qid", "slug", "words", "q").agg(F.min(F.struct("start", "text")).alias("m")).select("qid", "slug", "words", "q", "m.*")
    side = F.when(T.is_arabic(F.col("q")), F.col("start")).otherwise(-F.col("start"))
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("words"), side, "slug"))).where("r = 1")
    rest = F.concat(F.substring("q", F.lit(1), F.col("start")), F.col("q").substr(F.col("start") + F.char_length("text") + 1, F.char_length("q")))
    return best.select("qid", "slug", F.col("start").cast("int").alias("start"), "words", rest.alias("rest"))


def _held_words(index: Index, found: DataFrame) -> DataFrame:
    """(parts, key): windows found(parts) with their distinct words as the corpus has them, rarest first; without those that hold a word it lacks."""
    distinct = found.select("parts").distinct().withColumn("window", F.array_join("parts", " "))
    each = distinct.select("parts", "window", F.explode("parts").alias("word"))
    words = each.select("word").distinct().withColumn("token", F.get(T.raw_tokens(F.col("word")), 0))
    known = cut(T.trim_plurals(words.where("token is not null"), index.base).join(index.df, "token").select("word", "token", "df"))
    met = each.join(small(known), "word").groupBy("window").agg(F.first("parts").alias("parts"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.struct("df", "token"))).alias("t"))
    return met.where("n = size(parts)").select("parts", F.transform("t", lambda x: x["token"]).alias("key"))


def holders(index: Index, keys: DataFrame) -> DataFrame:
    """(key, id): the documents that hold all words of each key(key), an array of words of the corpus in one order for all, rarest first.

    The beginnings of all keys are a trie. A document goes down it word by word of its own, so the work is the beginnings that
    documents hold, not the documents of every single word.
    """
    keys = cut(keys.select("key").distinct().withColumn("n", F.size("key")))
    longest = keys.agg(F.max("n")).first()[0] or 0  # one number: words of a window
    wanted = small(cut(keys.select(F.explode("key").alias("token")).distinct().join(index.df, "token").select("token", "df")))
    docs = index.tf.join(wanted, "token").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("t"))
    state = docs.select("id", F.lit("").alias("begun"), F.transform("t", lambda x: x["token"]).alias("rest"))
    done = None
    for n in range(1, longest + 1):
        nodes = keys.where(F.col("n") >= n).select(F.array_join(F.slice("key", 1, n), " ").alias("node"), (F.col("n") == n).alias("ends"), (F.col("n") > n).alias("goes"))
        nodes = cut(nodes.groupBy("node").agg(F.max("ends").alias("ends"), F.max("goes").alias("goes")))
        step = state.select("id", "begun", "rest", F.posexplode("rest").alias("at", "word"))
        step = step.select("id", F.concat_ws(" ", F.nullif("begun", F.lit("")), "word").alias("node"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))
        step = cut(step.join(small(nodes, 20_000), "node"))
        whole = step.where("ends").select(F.split("node", " ").alias("key"), "id")
        done = whole if done is None else done.unionByName(whole)
        state = step.where("goes and size(rest) > 0").select("id", F.col("node").alias("begun"), "rest")
    return keys.select("key", F.lit(None).cast(index.tf.schema["id"].dataType).alias("id")).limit(0) if done is None else done


def fuzzy_phrases(
    index: Index, queries: DataFrame, phrases: DataFrame, longest: int, blocked: tuple[str, ...] = (), excluded: tuple[str, ...] = (), protected: DataFrame | None = None,
    articles: bool = False, members: DataFrame | None = None, evidence: bool = True,
) -> DataFrame:
    """(qid, slug, start, words, score, rest): the window of words most similar to a known phrase(slug, phrase); start counts words.

    * a window in `blocked` matches nothing, nor does one with an `excluded` word;
    * a window with a protected(qid, word) word needs STRICT instead of CUTOFF;
    * so does, with evidence, a window that ATTESTED documents or more hold, but not against a name whose members(slug, id) are at
      least the share OVERLAP of those documents; without members no name is exempt;
    * with articles a window and a phrase are also compared without leading articles, and the better score counts.
    The best score wins, then the longer window, the earlier one and the slug. Queries with a true column `plain` meet only phrases
    with one.
    """
    w = _spans(queries, longest, bool(excluded)).where(~_among(F.col("phrase"), blocked))
    if excluded:
        w = w.where(~F.arrays_overlap(F.slice("own", F.col("start") + 1, F.col("words")), _normal(excluded))).drop("own")
    known = phrases.select("slug", T.normalize(F.col("phrase")).alias("r"), "plain" if "plain" in phrases.columns else F.lit(True).alias("plain"))
    known = cut(known.where("r <> ''").groupBy("slug", "r").agg(F.max("plain").alias("plain")))
    have = known.agg(F.count("*").alias("n"), F.max(F.char_length("r")).alias("m")).first()
    # texts give a row for every window, so windows are made twice instead of kept: for what may be similar to a name, and for what is
    bare = lambda c: F.when(F.contains(c, F.lit("ال")), T.strip_article(c)).otherwise(c)
    asked = w.select("phrase").where(F.char_length("phrase") <= (have.m or 0) * (200 - CUTOFF) / CUTOFF + 1 + 2 * longest * articles).distinct()
    names = known.select("slug", "plain", F.lit(0).alias("kind"), "r")
    if articles:
        asked = asked.select(F.explode(_forms(bare)).alias("phrase"))
        names = names.unionByName(known.select("slug", "plain", F.lit(1).alias("kind"), bare(F.col("r")).alias("r")))
    names = cut(names)
    scores = S.similar_pairs(asked.select(F.col("phrase").alias("l")), names.select("r"), CUTOFF, few=have.n <= FEW)
    scores = cut(scores.join(small(names, FEW), "r").groupBy("l", "kind", "slug", "plain").agg(F.max(F.round("score", 9)).alias("score")))
    spot = w.withColumn("l", F.explode(_forms(bare)) if articles else F.col("phrase")).join(small(scores, 100_000), "l")
    spot = spot.where(F.when(F.col("kind") == 0, F.col("l") == F.col("phrase")).otherwise(F.col("l") == bare(F.col("phrase"))))
    if "plain" in queries.columns:
        spot = spot.join(queries.where("plain").select("qid", F.lit(True).alias("only")), "qid", "left").where("plain or only is null")
    hits = cut(spot.groupBy("qid", "start", "words", _parts().alias("parts"), "slug").agg(F.max("score").alias("score")))
    need = F.lit(CUTOFF)
    if protected is not None:
        kept = protected.groupBy("qid").agg(F.collect_set("word").alias("own"))  # words of one query
        hits = hits.join(kept, "qid", "left").withColumn("strict", F.coalesce(F.exists("parts", lambda x: F.array_contains("own", T.normalize(x))), F.lit(False))).drop("own")
        need = F.when(F.col("strict"), STRICT).otherwise(CUTOFF)
    if evidence:
        keyed = cut(_held_words(index, hits))
        docs = cut(holders(index, keyed))
        n = cut(docs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= ATTESTED).join(keyed, "key"))
        hits = cut(hits.join(small(n, 50_000), "parts", "left"))
        share = F.lit(0.0)
        if members is not None:
            pairs = hits.where("n is not null").select("key", "slug").distinct().join(docs, "key")
            both = pairs.join(members.select("slug", "id").distinct(), ["slug", "id"]).groupBy("key", "slug").agg(F.count("*").alias("both"))
            hits = hits.join(both, ["key", "slug"], "left")
            share = F.coalesce("both", F.lit(0)) / F.col("n")
        need = F.when(F.col("n").isNotNull() & (share < OVERLAP), STRICT).otherwise(need)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("words"), "start", "slug")
    best = hits.where(F.col("score") >= need - 1e-9).withColumn("r_", F.row_number().over(order)).where("r_ = 1").select("qid", "slug", "start", "words", "score")
    left = F.concat(F.slice("w", 1, F.col("start")), F.slice("w", F.col("start") + F.col("words") + 1, F.size("w")))
    return best.join(queries.select("qid", _words(F.col("q")).alias("w")), "qid").select("qid", "slug", "start", "words", F.round("score", 6).alias("score"), F.array_join(left, " ").alias("rest"))


def attested_window(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, start, words, support): the longest run of two words or more whose words ATTESTED documents hold together; the earliest of equals."""
    w = cut(windows(queries, EVIDENCE_WORDS).where("words >= 2").select("qid", "start", "words", "parts"))
    keyed = cut(_held_words(index, w))
    support = holders(index, keyed).groupBy("key").agg(F.count("*").alias("support")).where(F.col("support") >= ATTESTED)
    held = w.join(keyed.join(support, "key").select("parts", "support"), "parts")
    return held.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("words"), "start"))).where("r = 1").select("qid", "start", "words", "support")


@dataclass
class Names:
    """What a query may name: categories(slug, phrase) with aliases(slug, phrase), brands(slug, phrase), and the members (slug, id) of each."""

    index: Index
    categories: DataFrame
    brands: DataFrame
    category_members: DataFrame
    brand_members: DataFrame

    def aliases(self) -> DataFrame:
        """Aliases of the categories that exist: (slug, phrase, singular)."""
        rows = [(s, p, one) for table, one in ((SINGULAR_ALIASES, True), (COMPOUND_ALIASES, False)) for s, ps in table.items() for p in ps]
        return self.categories.sparkSession.createDataFrame(rows, "slug string, phrase string, singular boolean")

    def phrases(self) -> DataFrame:
        return self.categories.select("slug", "phrase").unionByName(self.aliases().select("slug", "phrase"))

    def fuzzy_brand(self, queries: DataFrame, protected: DataFrame | None = None) -> DataFrame:
        return fuzzy_phrases(self.index, queries, self.brands, BRAND_WORDS, BRAND_BLOCKED, BRAND_EXCLUDED, protected, members=self.brand_members)

    def fuzzy_category(self, queries: DataFrame, phrases: DataFrame | None = None, blocked: tuple[str, ...] = CATEGORY_BLOCKED) -> DataFrame:
        return fuzzy_phrases(self.index, queries, self.phrases() if phrases is None else phrases, CATEGORY_WORDS, blocked, articles=True, members=self.category_members)

    def category(self, queries: DataFrame) -> DataFrame:
        """(qid, slug, words, rest): the exact category, else the fuzzy one. A singular alias yields to a fuzzy name with more words."""
        exact = cut(exact_phrases(queries, self.phrases()).select("qid", "slug", "words", "rest"))
        alias = exact.join(self.aliases().where("singular").select("slug").distinct(), "slug", "left_semi").select("qid", F.col("words").alias("had"))
        # both kinds of text are compared in one go: one with a singular alias meets no singular aliases again
        mine = self.categories.select("slug", "phrase", F.lit(True).alias("plain")).unionByName(self.aliases().select("slug", "phrase", (~F.col("singular")).alias("plain")))
        asked = queries.select("qid", "q").join(exact.select("qid", F.lit(True).alias("met")), "qid", "left").join(alias.select("qid", F.lit(True).alias("plain")), "qid", "left")
        asked = cut(asked.where("met is null or plain").select("qid", "q", F.coalesce("plain", F.lit(False)).alias("plain")))
        found = cut(self.fuzzy_category(asked, mine).select("qid", "slug", "words", "rest"))
        longer = found.join(alias, "qid").where("words > had").drop("had")
        other = found.join(exact.select("qid"), "qid", "left_anti")
        return exact.join(longer.select("qid"), "qid", "left_anti").unionByName(longer).unionByName(other)

    def free_from(self, concepts: DataFrame) -> DataFrame:
        """(concept, slug, score): of the categories whose name holds a mark of FREE_MARKS the one with the word most similar to concepts(concept)."""
        name = self.phrases().select("slug", F.split(T.normalize(F.col("phrase")), " ").alias("w"))
        marked = name.where(F.exists("w", lambda x: _among(x, FREE_MARKS)))
        words = marked.select("slug", F.explode("w").alias("word")).where(~_among(F.col("word"), FREE_MARKS))
        forms = words.select("slug", F.explode(F.array("word", T.strip_article(F.col("word")))).alias("r")).distinct()
        asked = concepts.select("concept", T.normalize(F.col("concept")).alias("c")).distinct().select("concept", F.explode(F.array("c", T.strip_article(F.col("c")))).alias("l")).distinct()
        pairs = S.similar_pairs(asked.select("l"), forms.select("r"), CUTOFF).join(asked, "l").join(forms, "r")
        best = pairs.groupBy("concept", "slug").agg(F.max(F.round("score", 9)).alias("score"))
        return best.withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("score"), "slug"))).where("r = 1").select("concept", "slug", "score")

    def negated(self, queries: DataFrame) -> DataFrame:
        """(qid, slug, rest): the free-from category that a negation names: of the NEGATIONS in order, at its first place, the first of
        the NEGATED_WORDS words behind it that names one; rest is the text without negation and words up to that one."""
        each = None
        for i, p in enumerate(NEGATIONS):
            pattern = rf"(?is)^((?:.*?{_EDGE})??)({p})(?={_EDGE}|$)(.*)$"
            part = queries.where(F.col("q").rlike(pattern)).select("qid", F.lit(i).alias("i"), F.regexp_extract("q", pattern, 1).alias("before"), F.regexp_extract("q", pattern, 3).alias("behind"))
            each = part if each is None else each.unionByName(part)
        words = each.select("qid", "i", "before", "behind", F.posexplode(F.slice(_words(F.col("behind")), 1, NEGATED_WORDS)).alias("at", "concept"))
        found = words.join(self.free_from(words.select("concept")), "concept")
        best = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("i", "at"))).where("r = 1")
        return best.select("qid", "slug", F.concat("before", F.expr(r"regexp_replace(behind, concat('^(?:\\s*\\S+){', at + 1, '}'), '')")).alias("rest"))

    def protected_words(self, queries: DataFrame) -> DataFrame:
        """(qid, word): normalised words that by themselves hold an exact category phrase."""
        words = queries.select("qid", F.explode(F.array_distinct(_words(F.col("q")))).alias("q"))
        exact = exact_phrases(words.select(F.col("q").alias("qid"), "q").distinct(), self.phrases()).select(F.col("qid").alias("q"))
        return words.join(exact, "q", "left_semi").select("qid", T.normalize(F.col("q")).alias("word"))

    def leftover_brand(self, queries: DataFrame) -> DataFrame:
        """(qid, slug, rest): the fuzzy brand of a text without its category; none if attested words run on longer than the brand's."""
        found = self.fuzzy_brand(queries, self.protected_words(queries))
        held = attested_window(self.index, queries.join(found.select("qid"), "qid", "left_semi")).select("qid", F.col("words").alias("held"))
        return found.join(held, "qid", "left").where("held is null or held <= words").select("qid", "slug", "rest")

    def parse(self, queries: DataFrame) -> DataFrame:
        """(qid, category, brand, text): what every query asks for; text is what is left, null if nothing is.

        A negation that names a free-from category settles the category. Else category and brand compete for the text: the brand
        wins only with more words; the loser is looked for again in what the winner leaves. Prices are no part of it.
        """
        queries = cut(queries.select("qid", F.coalesce("q", F.lit("")).alias("q")))
        no = cut(self.negated(queries))
        rest = queries.join(no.select("qid"), "qid", "left_anti")
        cat = cut(self.category(rest))
        brand = cut(self.fuzzy_brand(rest).select("qid", "slug", "words", "rest"))
        first = rest.join(cat.select("qid", F.col("words").alias("c")), "qid", "left").join(brand.select("qid", F.col("words").alias("b")), "qid", "left")
        wins = cut(first.where(F.coalesce("b", F.lit(0)) > F.coalesce("c", F.lit(0))).select("qid"))
        by_brand = brand.join(wins, "qid", "left_semi").select("qid", F.col("slug").alias("brand"), F.col("rest").alias("q"))
        again = self.category(by_brand.select("qid", "q")).select("qid", F.col("slug").alias("category"), "rest")
        one = by_brand.join(again, "qid", "left").select("qid", "category", "brand", F.coalesce("rest", "q").alias("text"))
        settled = no.select("qid", F.col("slug").alias("category"), F.col("rest").alias("q"))
        named = rest.join(wins, "qid", "left_anti").join(cat.select("qid", "slug", "rest"), "qid", "left")
        by_category = cut(settled.unionByName(named.select("qid", F.col("slug").alias("category"), F.coalesce("rest", "q").alias("q"))))
        more = self.leftover_brand(by_category.select("qid", "q")).select("qid", F.col("slug").alias("brand"), "rest")
        two = by_category.join(more, "qid", "left").select("qid", "category", "brand", F.coalesce("rest", "q").alias("text"))
        return one.unionByName(two).withColumn("text", F.nullif(F.btrim("text"), F.lit("")))

    def brand_text(self, queries: DataFrame) -> DataFrame:
        """(qid, slug): the brand that a text given as a brand means; attested words need STRICT against every name."""
        return fuzzy_phrases(self.index, queries, self.brands, BRAND_WORDS).select("qid", "slug")

    def category_hint(self, queries: DataFrame) -> DataFrame:
        """(qid, slug): the category that a text given as one means: exact, else fuzzy without blocked words."""
        exact = exact_phrases(queries, self.phrases()).select("qid", "slug")
        return exact.unionByName(self.fuzzy_category(queries.join(exact.select("qid"), "qid", "left_anti"), blocked=()).select("qid", "slug"))

"""Text normalisation and tokens as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: letters of the Arabic blocks.
ARABIC = r"[\x{600}-\x{6FF}\x{750}-\x{77F}]"
# Fixed value: vowel marks that are left out of Arabic words.
MARKS = r"[\x{64B}-\x{652}\x{670}\x{640}]"
# What a value is trimmed of besides blanks.
EDGES = " .,-_"
WORD = r"[\p{L}\p{N}_]+"
# Words that only ever take the default singular.
KEEP_S = ("burnes", "kisses", "ashes", "matches", "patches")
# Phrases that mark a brand as a placeholder, between word boundaries in Latin script, anywhere in Arabic.
PLACEHOLDERS = ("select", "please", "none", "null", "undefined", "test", "tbd", "default", "sample", "placeholder", "choose", "unbranded", "misc", "n/?a", "not specified", "not applicable")
PLACEHOLDERS_ARABIC = ("اختر", "يرجى", "غير محدد", "بدون")


def compatibility_table() -> tuple[str, str]:
    """Characters with a one-character compatibility form and that form, from the Unicode data."""
    pairs = [(chr(o), unicodedata.normalize("NFKC", chr(o))) for a, b in ((0xFE70, 0xFEFC), (0xFF01, 0xFF5E), (0xFFE0, 0xFFE6), (0x2000, 0x200A), (0x3000, 0x3000), (0xA0, 0xA0), (0x202F, 0x202F)) for o in range(a, b + 1)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def compatible(c: Column) -> Column:
    """Full-width letters, presentation forms and odd blanks as ordinary characters; lam-alef forms as two letters."""
    return F.translate(F.regexp_replace(c, r"[\x{FEF5}-\x{FEFC}]", "لا"), *compatibility_table())


def is_arabic(c: Column) -> Column:
    """Whether any letter is Arabic; null for null."""
    return c.rlike(ARABIC)


def _tidy(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(EDGES))


def fold_latin(c: Column) -> Column:
    """normalize_latin() but for blanks and edges."""
    return F.lower(compatible(c))


def fold_arabic(c: Column) -> Column:
    """normalize_arabic() but for blanks and edges."""
    return F.translate(F.regexp_replace(compatible(c), MARKS, ""), "أإآٱى", "ااااي")


def normalize_latin(c: Column) -> Column:
    return _tidy(fold_latin(c))


def normalize_arabic(c: Column) -> Column:
    """Without vowel marks and stretching, with one alef and one yeh; case is kept."""
    return _tidy(fold_arabic(c))


def normalize(c: Column) -> Column:
    return F.when(is_arabic(c), normalize_arabic(c)).otherwise(normalize_latin(c))


def normalized(value: str) -> str:
    """normalize() of one fixed value, so that a plan holds the result instead of the expression."""
    value = re.sub("[\uFEF5-\uFEFC]", "لا", value).translate(str.maketrans(*compatibility_table()))
    if re.search("[\u0600-\u06FF\u0750-\u077F]", value):
        value = re.sub("[\u064B-\u0652\u0670\u0640]", "", value).translate(str.maketrans("أإآٱى", "ااااي"))
    else:
        value = value.lower()
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", value).strip(EDGES)


def raw_tokens(c: Column) -> Column:
    """The words of a text in order, each normalised by its own script; empty ones are dropped."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({WORD})"), F.lit(1)), normalize), lambda x: x != "")


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def brand_slug(c: Column) -> Column:
    """The Latin slug, else the normalised Arabic text, else a digest."""
    words = normalize_arabic(c)
    return F.when(slugify(c) != "", slugify(c)).when(is_arabic(c) & (words != ""), words).otherwise(F.concat(F.lit("brand_"), F.substring(F.sha1(c), 1, 10)))


def strip_article(c: Column) -> Column:
    """Every word of more than two letters without a leading Arabic article."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when((F.char_length(w) > 2) & w.startswith("ال"), w.substr(F.lit(3), F.char_length(w))).otherwise(w)), " ")


def is_placeholder_brand(c: Column) -> Column:
    """Whether a brand as typed holds a placeholder phrase; null for null."""
    edge = r"(^|$|[^\p{L}\p{N}_])"
    return F.lower(c).rlike(f"{edge}({'|'.join(PLACEHOLDERS)}){edge}") | c.rlike("|".join(PLACEHOLDERS_ARABIC))


def is_test_category(c: Column) -> Column:
    """Whether a normalised category name is a test entry: test and digits, nothing else."""
    return c.rlike(r"^test[0-9]*$")


def repeat_key(c: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(c, r"\s+", " ")))


def plural_forms(t: Column) -> tuple[Column, Column]:
    """(default, alternative) singular of a Latin word; equal to the word where no rule holds."""
    n = F.char_length(t)
    cut = lambda k: t.substr(F.lit(1), n - k)
    plain = (n <= 4) | is_arabic(t)
    default = F.when(plain, t).when(t.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(t.endswith("es"), cut(1)).when(t.endswith("s") & ~t.endswith("ss"), cut(1)).otherwise(t)
    other = F.when(plain, t).when(t.endswith("ies"), cut(1)).when(t.endswith("es"), cut(2)).otherwise(default)
    return default, other


def trim_plurals(tokens: DataFrame, frequency: DataFrame | None = None, token_col: str = "token") -> DataFrame:
    """tokens with `token_col` in the singular that the corpus knows better.

    frequency: (word, freq); without it the default form is taken. The alternative wins only where the default occurs at
    most once and less often. Null tokens stay null.
    """
    default, other = plural_forms(F.col(token_col))
    if frequency is None:
        return tokens.withColumn(token_col, default)
    best = singulars(tokens.select(F.col(token_col).alias("word")).distinct(), frequency).withColumnRenamed("word", token_col)
    return tokens.join(best, token_col, "left").withColumn(token_col, F.col("singular")).drop("singular")


def singulars(words: DataFrame, frequency: DataFrame) -> DataFrame:
    """(word, singular) of distinct words(word) by the corpus' frequency(word, freq): joins of vocabularies, not of texts."""
    default, other = plural_forms(F.col("word"))
    forms = words.select("word").withColumns({"d__": default, "a__": other})
    for side in ("d", "a"):
        forms = forms.join(frequency.select(F.col("word").alias(f"{side}__"), F.col("freq").alias(f"{side}__n")), f"{side}__", "left")
    a, d = F.coalesce("a__n", F.lit(0)), F.coalesce("d__n", F.lit(0))
    return forms.select("word", F.when((d <= 1) & (a > d) & ~F.col("word").isin(*KEEP_S), F.col("a__")).otherwise(F.col("d__")).alias("singular"))


def single_edits(words: DataFrame, alphabet: str = "abcdefghijklmnopqrstuvwxyz", word_col: str = "word") -> DataFrame:
    """(word, kind, variant) for every deletion, insertion, substitution and transposition; variants equal to the word are left out."""
    w, n = F.col(word_col), F.char_length(word_col)
    letters = F.array(*[F.lit(c) for c in alphabet])
    part = lambda a, k: F.substring(w, a, k)
    at = words.select(word_col, F.explode(F.sequence(F.lit(0), n)).alias("i"))
    i = F.col("i")
    head, tail = part(F.lit(1), i), lambda k: w.substr(i + 1 + k, F.greatest(n - i - k, F.lit(0)))
    options = F.array(
        F.struct(F.lit("deletion").alias("kind"), F.when(i < n, F.array(F.concat(head, tail(1)))).otherwise(F.array().cast("array<string>")).alias("v")),
        F.struct(F.lit("insertion").alias("kind"), F.transform(letters, lambda c: F.concat(head, c, tail(0))).alias("v")),
        F.struct(F.lit("substitution").alias("kind"), F.when(i < n, F.transform(letters, lambda c: F.concat(head, c, tail(1)))).otherwise(F.array().cast("array<string>")).alias("v")),
        F.struct(F.lit("transposition").alias("kind"), F.when(i < n - 1, F.array(F.concat(head, w.substr(i + 2, F.lit(1)), w.substr(i + 1, F.lit(1)), tail(2)))).otherwise(F.array().cast("array<string>")).alias("v")),
    )
    made = at.select(word_col, F.explode(options).alias("o")).select(word_col, "o.kind", F.explode("o.v").alias("variant"))
    return made.where(F.col("variant") != w).distinct()

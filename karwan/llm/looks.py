"""Visually identical text in different characters: one plain form for every value.

The words of all values that hold only ordinary characters make the vocabulary. A word with other
characters is looked up by a weighted edit automaton over vocabulary tries: exchanging look-alikes, leaving out
ignorable characters and putting accents together with their letters cost nothing, every other edit costs 1. The cheapest,
then the most frequent spelling within the budget is the canonical one. Words that reach none are rewritten by table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karwan.runtime import cut, small, width

# Letters of other scripts and rare Latin letters that look like an ordinary Latin one, by script.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G", "Һ": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d", "ӏ": "l", "ү": "y", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï", "к": "k", "т": "t", "м": "m", "н": "h", "в": "b",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "ό": "ó", "ά": "á", "ί": "í",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲭ": "x",
}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "յ": "j", "Օ": "O", "Տ": "S", "Լ": "L"}
CHEROKEE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮞ": "4", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B"}
LISU = {"ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U"}
RARE_LATIN = {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʋ": "v", "ꜱ": "s"}
# Letters that look like an Arabic one in some place of a word.
ARABIC_DOUBLES = {"ی": "يى", "ې": "ي", "ک": "ك", "ڪ": "ك", "ھ": "ه", "ہ": "ه", "ە": "ه", "ۀ": "ه\u0654", "ۂ": "ه\u0654", "ۃ": "ة", "ٲ": "أ", "ٳ": "إ", "ٶ": "ؤ", "ٸ": "ئ", "ۍ": "ى"}
# Characters that can't be seen although their category doesn't say so; signs that can although it is Cf; a blank that is a sign.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
SEEN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2"
BLANK_SIGN = "\u2800"
#: Costs of an edit that changes the look, and what a look-up may spend.
EDIT, BUDGET = 1.0, 0.5
#: A value is hot if at least one in so many odd rows holds it.
HOT = 1_000


def _all_characters() -> Iterator[str]:
    """Every character of the planes in use but surrogates, private use and Hangul and Chinese blocks, which have no doubles here."""
    for a, b in ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xF900, 0x11000), (0x16000, 0x17000), (0x1B000, 0x1F000), (0x1F100, 0x1F200), (0x1FB00, 0x1FC00), (0xE0000, 0xE1000)):
        yield from map(chr, range(a, b))


def _plain_letters(s: str) -> bool:
    """Whether s consists of ASCII, Latin or Arabic characters."""
    return all(c < "\x7f" or unicodedata.name(c, "").startswith(("LATIN", "ARABIC")) or unicodedata.combining(c) for c in s)


@cache
def unicode_forms() -> dict[str, str]:
    """Characters that are another form of ordinary ones by the Unicode data, and those.

    Fonts, widths, places in a word and, for letters and number letters, other compatibility forms count; raised, lowered,
    circled and squared ones are signs that a reader sees. Small capitals count by their names.
    """
    out = {}
    for c in _all_characters():
        kind = unicodedata.decomposition(c)
        if kind.startswith("<"):
            tag = kind[1 : kind.index(">")]
            known = tag in ("font", "wide", "narrow", "initial", "medial", "final", "isolated") or tag == "compat" and unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Lm", "Nl")
            plain = unicodedata.normalize("NFKC", c)
            if known and plain != c and _plain_letters(plain):
                out[c] = plain
        else:
            name = unicodedata.name(c, "")
            if name.startswith("LATIN LETTER SMALL CAPITAL ") and len(name) == 28:
                out[c] = name[-1].lower()
    return out


@cache
def unseen() -> frozenset[str]:
    """Characters that can't be seen, by their category or as listed."""
    tags = {chr(o) for a, b in ((0xFE00, 0xFE0F), (0xE0000, 0xE0FFF)) for o in range(a, b + 1)}
    return frozenset({c for c in _all_characters() if unicodedata.category(c) == "Cf"} - set(SEEN) | set(UNSEEN) | tags)


def _blanks() -> str:
    return "".join(c for c in _all_characters() if unicodedata.category(c) in ("Zs", "Zl", "Zp") and c != " ") + BLANK_SIGN


BLANKS = _blanks()
SMALL_CAPITALS = {c: s for c, s in unicode_forms().items() if unicodedata.name(c, "").startswith("LATIN LETTER SMALL CAPITAL")}
LATIN_DOUBLES = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | LISU | RARE_LATIN | SMALL_CAPITALS
#: What isn't seen, of the characters that a class of a regular expression can list one by one.
IGNORABLE = "".join(sorted(c for c in unseen() if c <= "\uffff"))


def ranges(characters: Iterable[str]) -> str:
    """The inside of a character class for Java's regular expressions."""
    out: list[list[int]] = []
    for o in sorted({ord(c) for c in characters}):
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def _suspects() -> str:
    marks = {chr(o) for a, b in ((0x300, 0x36F), (0x653, 0x655), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20F0)) for o in range(a, b + 1)}
    digits = {chr(o) for o in range(0x6F0, 0x6FA)}
    greek_cyrillic = {chr(o) for a, b in ((0x370, 0x3FF), (0x400, 0x52F)) for o in range(a, b + 1)}
    return ranges({*unseen(), *BLANKS, *unicode_forms(), *ARABIC_DOUBLES, *LATIN_DOUBLES, *marks, *digits, *greek_cyrillic})


#: Characters that no look-alike, blank or unseen one is among: most values hold only these and are settled at a glance.
_ORDINARY = r"[^\x{20}-\x{7E}\x{A1}-\x{AC}\x{AE}-\x{130}\x{621}-\x{652}\x{660}-\x{66C}\x{670}\x{67E}\x{686}\x{6AF}\x{6A4}]"
_SUSPECT = "[" + _suspects() + "]"
_THIRD = re.compile("[" + "".join({*CYRILLIC, *GREEK, *ARMENIAN, *CHEROKEE, *LISU}) + "\u0370-\u03ff\u0400-\u052f]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_OTHER_LATIN = set(RARE_LATIN) | set(SMALL_CAPITALS)


def suspect(c: Column) -> Column:
    """Whether a value holds characters that may stand for ordinary ones."""
    return c.rlike(_ORDINARY) & c.rlike(_SUSPECT)


def expand(word: str) -> str:
    """The word without ignorable characters, compatibility forms and Persian digits, in composed letters."""
    forms, gone = unicode_forms(), unseen()
    out = []
    for c in word:
        if c in gone:
            continue
        if c in forms and c not in SMALL_CAPITALS:
            out.append(forms[c])
        elif "۰" <= c <= "۹":
            out.append(chr(ord(c) - 0x06F0 + 0x0660))
        else:
            out.append(c)
    s = "".join(out)
    s = re.sub("[یى](?=\u0654)", "ي", s)
    # an accent may stand behind a look-alike of its letter
    s = re.sub("(.)(?=[\u0300-\u036f])", lambda m: LATIN_DOUBLES.get(m[1], m[1]) if not unicodedata.normalize("NFC", m[0] + "\u0301").isalpha() else m[1], s)
    return unicodedata.normalize("NFC", s)


def by_table(word: str) -> str:
    """The plain form of a word that no vocabulary word looks like.

    Arabic doubles are always rewritten. Letters of a third script become Latin only next to Latin letters, and
    Latin ones become Cyrillic only next to Cyrillic letters without a Latin double; a word wholly in another script stays.
    """
    s = expand(word)
    out = []
    for i, c in enumerate(s):
        d = ARABIC_DOUBLES.get(c)
        if d and len(d) == 2 and c == "ی":
            last = i + 1 == len(s) or not ("ؠ" <= s[i + 1] <= "ۓ" or "\u064b" <= s[i + 1] <= "\u0655")
            out.append(d[1] if last else d[0])
        else:
            out.append(d or c)
    s = unicodedata.normalize("NFC", "".join(out))
    s = "".join(LATIN_DOUBLES[c] if c in _OTHER_LATIN else c for c in s)
    if _LATIN.search(s) and _THIRD.search(s):
        back = {v: k for k, v in reversed(list(LATIN_DOUBLES.items())) if "Ѐ" <= k <= "ԯ"}
        alien = [c for c in s if _THIRD.match(c) and c not in LATIN_DOUBLES]
        if alien and all("Ѐ" <= c <= "ԯ" for c in alien) and len(alien) > sum(bool(_LATIN.match(c)) for c in s):
            s = "".join(back.get(c, c) for c in s)
        else:
            s = "".join(LATIN_DOUBLES.get(c, c) for c in s)
    return unicodedata.normalize("NFC", s)


def _readings(c: str) -> list[str]:
    """What a character may stand for at no cost: itself, its ordinary forms and its doubles."""
    out = [c, unicode_forms().get(c, c), *ARABIC_DOUBLES.get(c, ()), LATIN_DOUBLES.get(c, c)]
    if "۰" <= c <= "۹":
        out.append(chr(ord(c) - 0x06F0 + 0x0660))
    if c in SMALL_CAPITALS:
        out.append(SMALL_CAPITALS[c].upper())
    if c in ARABIC_DOUBLES and len(ARABIC_DOUBLES[c]) > 1 and unicodedata.combining(ARABIC_DOUBLES[c][1]):
        out.append(unicodedata.normalize("NFC", ARABIC_DOUBLES[c]))
    # a double of a form, as in a styled Greek letter
    return list(dict.fromkeys([*out, *(LATIN_DOUBLES[x] for x in out if x in LATIN_DOUBLES), *(y for x in out for y in ARABIC_DOUBLES.get(x, ()))]))


class Trie:
    """Vocabulary words with their counts; look() runs the weighted edit automaton over it."""

    END = ""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[self.END] = (n, word)

    def look(self, word: str, budget: float = BUDGET) -> str | None:
        """The cheapest word within the budget, of equally cheap ones the most frequent, then the first in order; None if there is none.

        The automaton's states after a prefix of the word are nodes of the trie with the least cost to reach them. A character
        is read as itself or as what it may stand for, as nothing if it can't be seen, together with the accents behind it as one
        letter: all free. Exchanging, leaving out or putting in any other character costs EDIT.
        """
        gone = unseen()
        states: list[dict[int, tuple[float, dict]]] = [{} for _ in range(len(word) + 1)]

        def reach(at: int, node: dict, cost: float) -> None:
            known = states[at].get(id(node))
            if cost <= budget and (known is None or cost < known[0]):
                states[at][id(node)] = (cost, node)

        def along(node: dict | None, text: str) -> dict | None:
            for c in text:
                node = node.get(c) if node is not None else None
            return node

        reach(0, self.root, 0.0)
        for i in range(len(word) + 1):
            if not states[i]:
                continue
            if budget >= EDIT:  # a character that the word lacks
                todo = list(states[i].values())
                while todo:
                    cost, node = todo.pop()
                    for c, child in node.items():
                        if c != self.END and cost + EDIT <= budget and (id(child) not in states[i] or states[i][id(child)][0] > cost + EDIT):
                            reach(i, child, cost + EDIT)
                            todo.append((cost + EDIT, child))
            if i == len(word):
                break
            c = word[i]
            marks, j = "", i + 1
            composed = []  # (next place, letter with the accents up to there)
            while j < len(word) and (word[j] in gone or unicodedata.combining(word[j])):
                if word[j] not in gone:
                    marks += word[j]
                    composed += [(j + 1, x) for r in _readings(c) if len(r) == 1 and (x := unicodedata.normalize("NFC", r + marks)) != r + marks]
                j += 1
            free = _readings(c)
            for cost, node in states[i].values():
                if c in gone:
                    reach(i + 1, node, cost)
                for text in free:
                    if (to := along(node, text)) is not None:
                        reach(i + 1, to, cost)
                for place, text in composed:
                    if (to := along(node, text)) is not None:
                        reach(place, to, cost)
                if cost + EDIT <= budget:
                    reach(i + 1, node, cost + EDIT)
                    for x, child in node.items():
                        if x != self.END:
                            reach(i + 1, child, cost + EDIT)
            states[i] = {}
        ends = [(cost, *node[self.END]) for cost, node in states[len(word)].values() if self.END in node]
        return min(ends, key=lambda e: (e[0], -e[1], e[2]))[2] if ends else None


def _canonical(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, vocabulary first: one trie at a time is held, that of the key at hand."""
    key, trie = None, Trie()
    for b in batches:
        words, plain = [], []
        for k, word, n in zip(*(c.to_pylist() for c in b.columns)):
            if k != key:
                key, trie = k, Trie()
            if n > 0:
                trie.add(word, n)
            else:
                words.append(word)
                plain.append(trie.look(word) or by_table(word))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(plain, pa.string())], ["word", "plain"])


def _translation() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters and what stands for them in a skeleton; longer replacements apart."""
    pairs: dict[str, str] = {}
    long: list[tuple[str, str]] = []
    fold = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ٲ": "ا", "ٳ": "ا", "ؤ": "و", "ٶ": "و", "ئ": "ي", "ى": "ي", "ٸ": "ي", "ة": "ه", "ۃ": "ه"}

    def base(s: str) -> str:
        s = "".join(ARABIC_DOUBLES.get(c, c)[0] for c in s)
        s = "".join(fold.get(c, LATIN_DOUBLES.get(c, c)) for c in s)
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
        return "".join(LATIN_DOUBLES.get(c, c) for c in s)

    forms = unicode_forms()
    codes = [*range(0xC0, 0x250), *range(0x370, 0x590), *range(0x600, 0x700), *range(0x1E00, 0x1F00)]
    for c in dict.fromkeys([*map(chr, codes), *LATIN_DOUBLES, *forms]):
        s = base(forms[c] if c in forms else chr(ord(c) - 0x06F0 + 0x0660) if "۰" <= c <= "۹" else c)
        if s != c and len(s) == 1:
            pairs[c] = s
        elif len(s) > 1 and s != c:
            long.append((c, s))
    return "".join(pairs), "".join(pairs.values()), long


def skeleton(word: Column) -> Column:
    """A coarse form that words of the same look share."""
    a, b, long = _translation()
    by_text: dict[str, str] = {}
    for c, s in long:
        by_text[s] = by_text.get(s, "") + c
    lam_alef = by_text.get("لا", "")
    out = F.regexp_replace(word, f"[{ranges(unseen())}\\x{{300}}-\\x{{36F}}\\x{{653}}-\\x{{655}}]", "")
    out = F.regexp_replace(out, f"[{lam_alef}]", "لا")
    # other characters that stand for several are rare: they all share the empty place
    rest = "".join(c for s, cs in by_text.items() if s != "لا" for c in cs)
    out = F.translate(out, a + rest, b)
    return out


def trie_key(word: Column) -> Column:
    """What words of one trie share: the first letters of their skeleton and its length, so that tries stay of a bounded kind."""
    s = skeleton(word)
    return F.concat(F.lower(F.substring(s, 1, 3)), F.lit(" "), F.char_length(s).cast("string"))


def plain_values(values: DataFrame) -> DataFrame:
    """(value, plain, n) for the distinct values that are not in their plain form; n rows hold the value.

    values: (field, value, n), whole columns; the vocabulary is counted over all of them. Null values are left out,
    blank ones are plain unless they hold odd blanks. What can be seen stays: vowel marks, stretched letters, hamza, signs.
    """
    spark = values.sparkSession
    counted = values.where("value is not null").groupBy("value").agg(F.sum("n").alias("n"))
    odd = counted.where(suspect(F.col("value")))
    words = counted.select(F.explode(F.split(F.translate("value", BLANKS, " " * len(BLANKS)), " ")).alias("word"), "n").where("word <> ''")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("odd", suspect(F.col("word")))
    keyed = words.select("word", F.when(F.col("odd"), F.lit(0)).otherwise(F.col("n")).cast("long").alias("n"), trie_key(F.col("word")).alias("key"))
    wanted = keyed.where("n = 0").select("key").distinct()
    near = keyed.join(wanted, "key", "left_semi").repartition(width(spark), "key").sortWithinPartitions("key", F.desc("n"))
    found = near.select("key", "word", "n").mapInArrow(_canonical, "word string, plain string")
    pieces = odd.select("value", "n", F.posexplode(F.split(F.translate("value", BLANKS, " " * len(BLANKS)), " ")).alias("at", "word"))
    rebuilt = pieces.join(found, "word", "left").groupBy("value").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("plain", "word").alias("w")))), lambda x: x["w"])).alias("plain"), F.first("n").alias("n"))
    return rebuilt.where("plain <> value")


def unpivot(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(field_name, record_id, value) of (field name, table, id column, text column) entries; null values are left out."""
    parts = [t.select(F.lit(f).alias("field_name"), F.col(i).alias("record_id"), F.col(c).alias("value")).where("value is not null") for f, t, i, c in tables]
    return reduce(DataFrame.unionByName, parts)


def changed(rows: DataFrame) -> DataFrame:
    """(field_name, record_id, value, plain) for the rows (field_name, record_id, value) that differ from their plain form.

    Values held by at least one in HOT rows, of which there are HOT at most, are joined by a broadcast, all others by a shuffle.
    """
    counted = rows.groupBy(F.col("field_name").alias("field"), "value").agg(F.count("*").alias("n"))
    plain = cut(plain_values(counted))
    odd = rows.where(suspect(F.col("value")))
    one = small(plain.select("value", "plain"))
    total = odd.agg(F.count("*").alias("total"))
    hot = plain.join(F.broadcast(total)).where(F.col("n") * HOT >= F.col("total")).select("value", F.col("plain").alias("hot"))
    marked = odd.join(F.broadcast(hot), "value", "left")
    out = [F.col(c) for c in ("field_name", "record_id", "value")]
    cold = marked.where("hot is null").join(one, "value").select(*out, "plain")
    return marked.where("hot is not null").select(*out, F.col("hot").alias("plain")).unionByName(cold)

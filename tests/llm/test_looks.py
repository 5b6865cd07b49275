import itertools

import pytest

from karwan.llm import looks as L


def plain(spark, values):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "field_name string, record_id long, value string")
    return {r.value: r.plain for r in L.changed(df).collect()}


def test_forms(spark):
    same = ["مكسرات مشكلة", "خالِي من السكر", "سيتـيڤيل", "Жилка Ψωμί", "Crème 12×80", "a  b ", "Bay™", "", None, "مربى", "أ إ ا", "پاچه گ", "٣ ml 3"]
    changed = {
        "حفاضا‌ت": "حفاضات", "﻿ﺻﺎﻣﻮﻟﻲ": "صامولي", "ﻻ": "لا", "ＸＬ": "XL", "a b": "a b", "شیجوت": "شيجوت", "کلينازا": "كلينازا", "ھ": "ه",
        "Café": "Café", "أقل": "أقل", "70 сl": "70 cl", "РRО": "PRO", "۱۲": "١٢", "Bay С": "Bay C", "х́": "х́",
    }
    got = plain(spark, [*same, *changed, "vitamin C", "Bay C", "مكسرات"])
    changed.pop("х́")
    for v, p in changed.items():
        assert got.get(v) == p, (v, got.get(v))
    assert not set(same) & set(got)


def test_word_wholly_in_another_script_needs_the_vocabulary(spark):
    assert plain(spark, ["С", "D"]) == {}
    assert plain(spark, ["С", "C"]) == {"С": "C"}


def test_trie_against_all_spellings():
    trie = L.Trie()
    vocabulary = ["cab", "cob", "ab", "لا", "ى", "ي"]
    for i, w in enumerate(vocabulary):
        trie.add(w, 10 - i)
    double = {"a": "аａ", "b": "ｂ", "c": "сｃ", "o": "о"}
    for w in ("cab", "cob", "ab"):
        for letters in itertools.product(*[c + double.get(c, "") for c in w]):
            assert trie.look("​".join(letters)) == w
    assert trie.look("ﻻ") == "لا" and trie.look("ی") == "ى" and trie.look("cub") is None and trie.look("") is None


def test_empty_clashing_and_long(spark):
    empty = spark.createDataFrame([], "field_name string, record_id long, value string")
    assert L.changed(empty).collect() == []
    t = spark.createDataFrame([(1, "x​y", "p"), (1, "x​y", "p"), (2, "a" * 200_000 + "​", None)], "id long, name string, value string")
    rows = L.unpivot([("t.name", t, "id", "name"), ("t.value", t, "id", "value")])
    got = sorted((r.field_name, r.record_id, len(r.plain)) for r in L.changed(rows).distinct().collect())
    assert got == [("t.name", 1, 2), ("t.name", 2, 200_000)]


@pytest.mark.parametrize("word", ["abc", "شي", "Жилка"])
def test_table_is_stable(word):
    assert L.by_table(L.by_table(word)) == L.by_table(word) == word


def test_characters_by_unicode_data(spark):
    odd = {"ℳilk": "Milk", "ᴀpple": "apple", "Ꭺpple": "Apple", "a\u2028b": "a b", "a\u3164b": "ab", "a\U000e0061b": "ab", "ﬁsh": "fish", "𝓑ay": "Bay", "cafe\u200b\u0301": "café"}
    same = ["H₂O", "x²", "½", "①", "Bay™", "№ 5", "ªº", "ไทยคำ", "हिन्दी", "Ꭰᏺ", "ꓐꓑ"]
    got = plain(spark, [*odd, *same])
    assert {v: got.get(v) for v in odd} == odd
    assert not set(same) & set(got)
    assert plain(spark, ["ᴀpple", "Apple", "Apple pie"]) == {"ᴀpple": "Apple"}  # the vocabulary decides between letters


def test_automaton_costs():
    trie = L.Trie()
    for w, n in (("café", 3), ("cafe", 9), ("caff", 1), ("كلينازا", 2)):
        trie.add(w, n)
    assert trie.look("cafe\u0301") == "café" and trie.look("с\u200bafе\u2060\u0301") == "café"
    assert trie.look("cafx") is None and trie.look("caf") is None and trie.look("cafee") is None
    assert trie.look("cafx", 1.0) == "cafe" and trie.look("caf", 1.0) == "cafe" and trie.look("cafee", 1.0) == "cafe" and trie.look("cxfx", 1.0) is None and trie.look("cxfx", 2.0) == "cafe"
    assert trie.look("کلینازا") == "كلينازا" and trie.look("ﻛﻠﻴﻨﺎﺯﺍ") == "كلينازا"

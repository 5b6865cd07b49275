"""Mapping free-entered values to a canonical list, in SQL.

Known names are cut into k + 1 segments; a name within k edits of a value keeps one segment unharmed, so an
equality join of the segments with the value's substrings at the places that k edits allow finds every near name.
levenshtein() verifies what the join finds; what no name fits comes out of an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from karwan.llm import looks
from karwan.runtime import cut, small

# Digits that stand for a letter inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s"}
#: Brands that must share an addition before it counts as one.
LEARNT_FROM = 2
#: Names that must share a word before it tells brands apart and so is no addition.
TELLING = 3
#: Longest names by the edits allowed: names up to 5 characters none, up to 6 one, up to 8 two, longer ones three.
EDITS = ((5, 0), (6, 1), (8, 2))
MOST_EDITS = 3


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold_sql(column: str) -> str:
    """Letters and digits of a value in lower case without accents, vowel marks and look-alikes; all else is a blank."""
    a, b, long = looks._translation()
    lam_alef = "".join(c for c, s in long if s == "لا")
    shut = "".join(chr(0x0660 + i) for i in range(10))
    x = f"regexp_replace({column}, '<[^>]*>|&amp;', ' ')"
    x = f"regexp_replace({x}, '[{looks.IGNORABLE}\u0300-\u036f\u064b-\u0655\u0670ـ]', '')"
    x = f"regexp_replace({x}, '[{lam_alef}]', 'لا')"
    x = f"lower(translate({x}, {_quoted(a)}, {_quoted(b)}))"
    x = f"translate({x}, '{shut}ڤپگغچ', '0123456789فبججج')"
    for digit, letter in DIGITS.items():
        x = f"regexp_replace({x}, '(?<=\\\\p{{L}}){digit}(?=\\\\p{{L}})', '{letter}')"
    x = f"trim(regexp_replace({x}, '[^\\\\p{{L}}\\\\p{{Nd}}]+', ' '))"
    return x.replace("{", "{{").replace("}", "}}")  # sql() reads single ones as names of frames


_WORDS = "filter(split({f}, ' '), x -> x not in ('', 'and', 'و'))"


def edits_sql(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} <= {n} THEN {k}" for n, k in EDITS) + f" ELSE {MOST_EDITS} END"


class Matcher:
    """The steps from values and known names to candidates; every step is one SQL statement."""

    def __init__(self, values: DataFrame, names: DataFrame):
        """values: (value, n), names: (name, id); null and blank entries of either are left out, repeated ones count once."""
        self.sql = values.sparkSession.sql
        self.names = self.sql(
            f"""SELECT DISTINCT array_join(w, '') AS key, array_join(array_sort(w), '') AS sorted, w, cast(id AS bigint) AS id
            FROM (SELECT {_WORDS.format(f=fold_sql('name'))} AS w, id FROM {{n}} WHERE name IS NOT NULL AND id IS NOT NULL) WHERE size(w) > 0""",
            n=names,
        )
        words = self.sql(
            f"""SELECT value, n, CASE WHEN size(w) % 2 = 0 AND slice(w, 1, cast(size(w) / 2 AS int)) = slice(w, cast(size(w) / 2 AS int) + 1, size(w)) THEN slice(w, 1, cast(size(w) / 2 AS int)) ELSE w END AS w
            FROM (SELECT value, sum(n) AS n, {_WORDS.format(f=fold_sql('value'))} AS w FROM {{v}} WHERE value IS NOT NULL GROUP BY value) WHERE size(w) > 0""",
            v=values,
        )
        self.words = cut(words)
        # values that are a name as a whole are settled; only the others are taken apart
        self.whole = cut(self.sql(
            """SELECT DISTINCT v.value, v.n, n.id FROM (SELECT value, n, array_join(w, '') AS key FROM {w}) v JOIN {n} n ON v.key = n.key
            UNION SELECT v.value, v.n, n.id FROM (SELECT value, n, array_join(array_sort(w), '') AS sorted FROM {w}) v JOIN {n} n ON v.sorted = n.sorted""",
            w=self.words, n=self.names,
        ))
        # which words of a value tell brands apart: one flag a word
        flagged = self.sql(
            """SELECT value, n, any_value(w) AS w, transform(array_sort(collect_list(struct(at, told))), x -> x.told) AS told FROM (
              SELECT v.value, v.n, v.w, v.at, t.word IS NOT NULL AS told FROM (SELECT value, n, w, posexplode(w) AS (at, word) FROM {w} LEFT ANTI JOIN {d} d ON d.value = {w}.value) v LEFT JOIN {t} t ON t.word = v.word)
            GROUP BY value, n""",
            w=self.words, d=self.whole, t=small(cut(self.telling())),
        )
        longest = self.sql("SELECT coalesce(max(size(w)), 1) + 1 AS words FROM {n}", n=self.names)
        # windows of words: at most as many words as the longest name has, and one more; and the value as a whole
        self.windows = cut(self.sql(
            """SELECT value, n, array_join(slice(w, i + 1, m), '') AS key, array_join(slice(w, 1, i), ' ') AS pre, array_join(slice(w, i + m + 1, size(w)), ' ') AS suf,
                 exists(slice(told, 1, i), x -> x) AS pre_told, exists(slice(told, i + m + 1, size(w)), x -> x) AS suf_told
            FROM (SELECT *, explode(sequence(0, size(w) - m)) AS i FROM (SELECT *, explode(array_union(sequence(1, least(size(w), words)), array(size(w)))) AS m FROM {w} CROSS JOIN {l}))""",
            w=flagged, l=longest,
        ))

    def exact(self) -> DataFrame:
        """Windows, not whole values, that are a known name: (value, n, id, pre, suf, pre_told, suf_told)."""
        return self.sql("SELECT w.value, w.n, n.id, w.pre, w.suf, w.pre_told, w.suf_told FROM {w} w JOIN {n} n ON w.key = n.key", w=self.windows, n=self.names)

    def additions(self, exact: DataFrame) -> DataFrame:
        """(side, text) that stands before or after exact names of several brands, in all values; no telling words."""
        return self.sql(
            f"""SELECT side, text FROM (
                SELECT 'suf' AS side, suf AS text, id FROM {{e}} WHERE pre = '' AND suf <> '' AND NOT suf_told UNION ALL SELECT 'pre', pre, id FROM {{e}} WHERE suf = '' AND pre <> '' AND NOT pre_told)
              GROUP BY side, text HAVING count(DISTINCT id) >= {LEARNT_FROM}
            UNION SELECT 'pre', '' UNION SELECT 'suf', ''""",
            e=exact,
        )

    def telling(self) -> DataFrame:
        return self.sql(f"SELECT word FROM (SELECT explode(w) AS word, id FROM {{n}}) GROUP BY word HAVING count(DISTINCT id) >= {TELLING}", n=self.names)

    def near(self, windows: DataFrame) -> DataFrame:
        """(value, usual, pre, suf, id, edits) for windows within the allowed edits of a name: the pigeonhole join."""
        segments = cut(self.sql(
            f"""SELECT id, key, len, k, i, p, substr(key, p + 1, l) AS seg, l FROM (
              SELECT *, cast(i * len div (k + 1) AS int) AS p, cast((i + 1) * len div (k + 1) - i * len div (k + 1) AS int) AS l FROM (
                SELECT *, explode(sequence(0, k)) AS i FROM (SELECT DISTINCT id, key, length(key) AS len, {edits_sql('length(key)')} AS k FROM {{n}}) WHERE k > 0))""",
            n=self.names,
        ))
        shapes = self.sql("SELECT DISTINCT len, k, i, p, l FROM {s}", s=segments)
        keys = self.sql("SELECT DISTINCT key FROM {w}", w=windows)
        probes = self.sql(
            f"""SELECT DISTINCT key, len, i, substr(key, at + 1, l) AS seg FROM (
              SELECT q.key, s.len, s.i, s.l, explode(sequence(greatest(s.p - s.k, 0), least(s.p + s.k, length(q.key) - s.l))) AS at
              FROM (SELECT key, explode(sequence(length(key) - {MOST_EDITS}, length(key) + {MOST_EDITS})) AS len FROM {{q}}) q
              JOIN {{s}} s ON s.len = q.len AND abs(length(q.key) - s.len) <= s.k WHERE least(s.p + s.k, length(q.key) - s.l) >= greatest(s.p - s.k, 0))""",
            q=keys, s=shapes,
        )
        hits = self.sql(
            """SELECT key, id, min(edits) AS edits FROM (
              SELECT h.key, h.id, levenshtein(h.key, h.name, h.k) AS edits FROM (
                SELECT DISTINCT p.key, s.id, s.key AS name, s.k FROM {p} p JOIN {s} s ON p.len = s.len AND p.i = s.i AND p.seg = s.seg) h)
            WHERE edits >= 0 GROUP BY key, id""",
            p=probes, s=small(segments),
        )
        return self.sql("SELECT w.value, w.usual, w.pre, w.suf, h.id, h.edits FROM {w} w JOIN {h} h ON w.key = h.key", w=windows, h=hits)

    def candidates(self) -> DataFrame:
        """(value, id, score): the names that fit a value best; several with one score where they fit equally well.

        A name may be surrounded by additions or by itself in another script; other words round it count as two
        edits more, and only where none of them tells brands apart.
        """
        exact = cut(self.exact())
        additions = small(cut(self.additions(exact)))
        clean = cut(self.sql(
            """SELECT e.value, e.id, CASE WHEN (a.text IS NOT NULL AND b.text IS NOT NULL) OR n.key IS NOT NULL THEN 0.0 ELSE 2.0 END AS score, length(e.pre) + length(e.suf) AS rest
            FROM {e} e LEFT JOIN {a} a ON a.side = 'pre' AND a.text = e.pre LEFT JOIN {a} b ON b.side = 'suf' AND b.text = e.suf
              LEFT JOIN {n} n ON n.id = e.id AND n.key = replace(concat(e.pre, e.suf), ' ', '')
            WHERE (a.text IS NOT NULL AND b.text IS NOT NULL) OR n.key IS NOT NULL OR NOT (e.pre_told OR e.suf_told)""",
            e=exact, a=additions, n=self.names,
        ))
        open_ = self.sql(
            """SELECT w.value, w.key, w.pre, w.suf, a.text IS NOT NULL AND b.text IS NOT NULL AS usual
            FROM {w} w LEFT ANTI JOIN {c} done ON done.value = w.value LEFT JOIN {a} a ON a.side = 'pre' AND a.text = w.pre LEFT JOIN {a} b ON b.side = 'suf' AND b.text = w.suf
            WHERE (a.text IS NOT NULL AND b.text IS NOT NULL) OR NOT (w.pre_told OR w.suf_told)""",
            w=self.windows, a=additions, c=clean.where("score = 0"),
        )
        near = self.near(cut(open_))
        return self.sql(
            """SELECT value, id, score FROM (
              SELECT value, id, score, rank() OVER (PARTITION BY value ORDER BY score, rest) AS r FROM (
                SELECT value, id, min(score) AS score, min_by(rest, score) AS rest FROM (
                  SELECT value, id, score, rest FROM {c} UNION ALL SELECT value, id, edits + CASE WHEN pre = '' AND suf = '' THEN 0.0 WHEN usual THEN 0.5 ELSE 2.0 END, length(pre) + length(suf) FROM {n})
                GROUP BY value, id)) WHERE r = 1
            UNION ALL SELECT value, id, 0.0 FROM {d}""",
            c=clean, n=near, d=self.whole,
        )


def assign(records: DataFrame, fields: list[str], names: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(record_id, canonical_id) and (value, n): the listed name every record denotes, 0 if none, and the values on no list.

    The first of `fields` that denotes a listed name decides. Names that fit a value equally well are told apart by the
    record's other fields, then by how often they occur, then by id. Records without a non-blank value are left out;
    several rows of a record count once. Null ids are left out.
    """
    sql = records.sparkSession.sql
    parts = " UNION ALL ".join(f"SELECT `{id_col}` AS record_id, {i} AS place, `{f}` AS value FROM {{r}} WHERE `{id_col}` IS NOT NULL AND trim(coalesce(`{f}`, '')) <> ''" for i, f in enumerate(fields))
    entered = sql(f"SELECT DISTINCT record_id, place, value FROM ({parts})", r=records)
    values = sql("SELECT value, count(*) AS n FROM {e} GROUP BY value", e=entered)
    matcher = Matcher(values, names)
    fits = cut(matcher.candidates())
    denoted = cut(sql("SELECT e.record_id, e.place, f.id, f.score, count(*) OVER (PARTITION BY e.record_id, e.place) AS rivals FROM {e} e JOIN {f} f ON e.value = f.value", e=entered, f=fits))
    common = sql("SELECT id, count(*) AS n FROM {d} WHERE rivals = 1 GROUP BY id", d=denoted)
    best = sql(
        """SELECT record_id, min(struct(place, -support, -coalesce(n, 0), id)).id AS id FROM (
          SELECT a.record_id, a.place, a.id, c.n, a.support FROM (SELECT *, count(*) OVER (PARTITION BY record_id, id) AS support FROM {d}) a LEFT JOIN {c} c ON a.id = c.id)
        GROUP BY record_id""",
        d=denoted, c=common,
    )
    mapped = sql("SELECT e.record_id, coalesce(b.id, 0) AS canonical_id FROM (SELECT DISTINCT record_id FROM {e}) e LEFT JOIN {b} b ON e.record_id = b.record_id", e=entered, b=best)
    unmatched = sql("SELECT v.value, v.n FROM {v} v LEFT ANTI JOIN {f} f ON v.value = f.value", v=values, f=fits)
    return mapped, unmatched

"""Sentence units across languages and scripts, as code point spans.

A text is cut at blank lines, list items and speakers' turns; within what is left, semi-Markov dynamic
programming chooses among all segmentations into whole spans. A span scores by its length, by the word it opens
with, by the word and the mark it closes with, and by whether its quotations are balanced or stand alone. Opening words,
abbreviations and words with an own mark are learnt from all texts; the lists below are only where that starts from.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karwan.runtime import cut

# Abbreviations and titles that a sentence doesn't end with, as written before the full stop, in lower case.
NEVER = set("mr mrs ms sen gov rev capt col gen lt sgt maj cmdr adm hon rep pres supt messrs sra srta dott sig prof.ssa avv gral mgr eq eqs fig figs cap dr prof st sr e.g i.e eg ie vs approx incl excl bzw inkl exkl evtl ggf env mme mlle mm dipl ing hr fr frau herr z.b d.h u.a p.ex ex c.-à-d z u d cf viz al डॉ श्री श्रीमती ดร".split()) | set("د م أ أم ص ب ت ا".split())
# Abbreviations of which a number is a part.
NUMBERED = set("no nos nr mwst vol p pp s fig ch sec art ca min max about n° bd abb kap नं रु रू no ver rs ext tel dep art".split())
# Abbreviations that may also end a sentence.
MAYBE = set("etc usw u.s.w a.m p.m am pm pcs pc tsp tbsp oz lb lbs kg g mg l ml cl cm mm km h hr hrs min sec pkg inc ltd co corp jr est dept mwst stk std ff إلخ الخ น mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec".split())
# Months after an ordinal number with a full stop.
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
# Verbs that report speech, after a quotation and at most a name.
REPORTS = set("said says wrote writes asked asks replied added told thought shouted whispered answered sagte fragte schrieb meinte rief قال قالت كتب كتبت سأل سألت पूछा कहा लिखा बोला बोली".split())
# Openings with which a sentence goes on after a quotation.
GOES_ON = re.compile("と(?!ても)|って|という|[，、,؛;–—]|然后|就|ثم |แล้ว|फिर |[^\\s，。！？]{1,8}(?:说|問|问|写道|道|答)[。，！]")
# Particles that close a Thai sentence.
THAI_CLOSERS = ("ค่ะ", "คะ", "ครับ", "ครับผม", "นะ", "จ้ะ", "จ้า", "ค่า", "ฮะ", "ล่ะ", "เลย")

_BLANK_LINE = re.compile("(?>\r\n|[\n\r \x85])(?:[^\\S\n\r \x85]*(?>\r\n|[\n\r \x85]))+| ")
_LINE = re.compile(r"[^\n\r \x85]+")
_ITEM = re.compile(r"[^\S\n]*(?:[-*•‣◦▪–—·●○✓☐+]|\(?(?:\d{1,3}|[٠-٩]{1,3}|[०-९]{1,3})[.)、．]|\(?[a-zA-Z]\))[^\S\n]+\S")
_BULLET = re.compile(r"[^\S\n]*[-*•‣◦▪–—·●○✓☐+]")
_TURN = re.compile(r"[^\S\n]*[^\s:：.!?]{2,20}(?:[^\S\n][^\s:：.!?]{1,15})?[^\S\n]?[:：](?=\s|[　-鿿])")
_LABEL = re.compile(r"^" + _TURN.pattern, re.MULTILINE)
_END = re.compile("[.!?…。！？؟।॥۔｡]+")
_OPENING = re.compile("(?:[\"“„«‘'¿¡「『（(]\\s?)*")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]+(?:[’'.-][^\W_]+)*")
_EDGE = frozenset("\"“”„«»‚‘’「」『』（）()[]،,;:؛，、：؛/")
_THAI = re.compile("[฀-๿]")
_OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", "‹": "›", "《": "》", "〈": "〉", "‘": "’", "»": "«", "{": "}"}
_BRACKETS = set("(（[【{")
_QUOTES = re.compile("[" + re.escape("".join(sorted({'"', *_OPEN, *_OPEN.values()}))) + "]")
_REPORT = re.compile(r"(?:[^\s,.;:!?،。।]+[\s,.;:!?،。।]*){1,3}")
_REPORT_WORD = re.compile(r"[^\s,.;:!?،。।]+")
#: Where a length begins to speak against a span, and by how much a character; what is shorter than SHORT and has no letter is none.
LONG, WEIGHT, SHORT = 600, 0.002, 6
#: What a blank after Thai letters that close no sentence counts as an end.
THAI_BLANK = -2.0


def pairs(text: str) -> dict[int, int]:
    """Matched quotation marks and brackets, opening to closing position; what stays open is left out."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in _QUOTES.finditer(text):
        i, c = m.start(), m[0]
        if c == '"' or c == "”" and any(x == "„" for x, _ in stack):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == ('"' if c == '"' else "„"):
                    found[stack[k][1]] = i
                    del stack[k:]
                    break
            else:
                if c == '"':
                    stack.append((c, i))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if _OPEN.get(stack[k][0]) == c:
                if c == "’" and i + 1 < len(text) and text[i + 1].isalpha():
                    continue
                found[stack[k][1]] = i
                del stack[k:]
                break
        else:
            if c in _OPEN and not (c == "»" and text.count("«")):
                stack.append((c, i))
    return found


class Splitter:
    """split() gives the sentence spans of a text. openers: lower-case words that sentences often open
    with; inner: words with an own ! or ?, as in brands, behind which sentences go on; short: learnt abbreviations."""

    def __init__(self, openers: frozenset[str] = frozenset(), inner: frozenset[str] = frozenset(), short: frozenset[str] = frozenset()):
        self.openers, self.inner, self.never = openers, inner, frozenset(NEVER | short)

    def split(self, text: str) -> list[tuple[int, int]]:
        lower_typed = text == text.lower() or (":" in text or "：" in text) and (bare := _LABEL.sub("", text)) == bare.lower()
        out: list[tuple[int, int]] = []
        at = 0
        for m in _BLANK_LINE.finditer(text):
            self._block(text, at, m.start(), lower_typed, out)
            at = m.end()
        self._block(text, at, len(text), lower_typed, out)
        return out

    def _block(self, text: str, start: int, end: int, lower_typed: bool, out: list[tuple[int, int]]) -> None:
        """Cuts a block at list items and turns; joins the other lines."""
        piece = start
        last_item, last = False, ""
        for m in _LINE.finditer(text, start, end):
            line = m[0]
            if not line.strip():
                continue
            fresh = not last or last_item or last[-1:] in ".!?…。！？؟।:：" or last[-1:] in "\"”»」』）)“"
            is_item = bool(_ITEM.match(line)) and (bool(_BULLET.match(line)) or fresh)
            if is_item or last_item or (last and _TURN.match(line) and fresh):
                open_item = last_item and not is_item and len(pairs(text[piece : m.start()])) < sum(c in _BRACKETS for c in text[piece : m.start()])
                if not open_item:
                    self._piece(text, piece, m.start(), lower_typed, last_item, out)
                    piece = m.start()
                else:
                    is_item = True
            last_item, last = is_item, line.rstrip()
        self._piece(text, piece, end, lower_typed, last_item, out)

    def _piece(self, text: str, start: int, end: int, lower_typed: bool, whole: bool, out: list[tuple[int, int]]) -> None:
        part = text[start:end]
        stripped = part.strip()
        if not stripped:
            return
        start += len(part) - len(part.lstrip())
        spans = [(0, len(stripped))] if whole else self._segment(stripped, lower_typed)
        for a, b in spans:
            while a < b and stripped[a].isspace():
                a += 1
            while b > a and stripped[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((start + a, start + b))

    def _segment(self, s: str, lower_typed: bool) -> list[tuple[int, int]]:
        """The best segmentation: best[j] is the score of the best one that ends at the j-th possible end.

        A span's score is open(i) + close(j) + length(i, j) + quotation(i, j). Lengths from SHORT to LONG are free, longer ones cost
        evenly, so the best start is the best among the near ones, which a queue keeps, or the best of the far ones, which one
        number keeps; starts at an own quotation are looked at by themselves. All starts are compared, in linear time.
        """
        matched = pairs(s)
        closing = {b: a for a, b in matched.items()}
        marks = self._candidates(s, matched, closing, lower_typed)
        if not marks:
            return [(0, len(s))]
        ends = [m[0] for m in marks]
        ends.append(len(s))
        starts = [0]
        for e in ends[:-1]:
            starts.append(_SPACE.match(s, e).end() if s[e].isspace() else e)
        n = len(ends)
        at = {a: i for i, a in enumerate(starts)} if any(m[2] is not None for m in marks) else {}
        opens = [0.0, *(m[5] for m in marks)]  # what the opening word of the i-th span adds
        value, back = [0.0] * (n + 1), [0] * (n + 1)
        near: list[tuple[float, int]] = []  # (best score of a span that starts here, start), scores falling
        head, far, far_at, left, ready = 0, float("-inf"), 0, 0, 0
        for j in range(n):
            end = ends[j]
            while ready <= j and end - starts[ready] >= SHORT:
                score = value[ready] + opens[ready]
                while len(near) > head and near[-1][0] <= score:
                    near.pop()
                near.append((score, ready))
                ready += 1
            while left <= j and end - starts[left] > LONG:  # leaves the near ones
                v = value[left] + opens[left] + WEIGHT * starts[left]
                if v > far:
                    far, far_at = v, left
                left += 1
            while head < len(near) and near[head][1] < left:
                head += 1
            close, special, embedded = 0.0, -1, 0.0
            if j < n - 1:
                _, close, opener, alone, embedded, _ = marks[j]
                if opener is not None:
                    close = 0.0
                    k = opener
                    while k and s[k - 1].isspace():
                        k -= 1
                    if k and s[k - 1] in ":：":
                        embedded = alone
                    else:
                        special = at.get(opener, -1)
            best, where = near[head] if head < len(near) else (float("-inf"), j)
            for i in range(ready, j + 1):  # a few short ones
                v = value[i] + opens[i] - (0 if any(map(str.isalpha, s[starts[i] : end])) else 4)
                if v > best:
                    best, where = v, i
            if far - WEIGHT * (end - LONG) > best:
                best, where = far - WEIGHT * (end - LONG), far_at
            best += embedded
            if 0 <= special <= j:
                v = value[special] + opens[special] + alone - max(0.0, WEIGHT * (end - starts[special] - LONG))
                if where == special or v > best:
                    if where == special and v < best:  # alone counts for this start; the others are embedded
                        others = [(value[i] + opens[i] + embedded - max(0.0, WEIGHT * (end - starts[i] - LONG)), i) for i in range(j + 1) if i != special]
                        best, where = max([(v, special), *others], key=lambda x: (x[0], x[1]))
                    else:
                        best, where = v, special
            value[j + 1], back[j + 1] = best + close, where
        cuts, j = [], n
        while j:
            cuts.append((starts[back[j]], ends[j - 1]))
            j = back[j]
        return cuts[::-1]

    def _candidates(self, s: str, matched: dict[int, int], closing: dict[int, int], lower_typed: bool) -> list[tuple]:
        """(end, close, opening of a quotation that closes here or None, score if that stands alone, score if not, open).

        close is what the word and the mark before the end say for it, open what the word behind says.
        """
        outer: list[tuple[int, int]] = []
        for a, b in sorted(matched.items()):
            if not outer or a > outer[-1][1]:
                outer.append((a, b))
        outer_starts = [a for a, _ in outer]

        def inside(p: int) -> bool:
            k = bisect_left(outer_starts, p) - 1
            return k >= 0 and outer[k][0] < p <= outer[k][1]

        found: dict[int, tuple] = {}
        for m in _END.finditer(s):
            end, opener = m.end(), None
            while True:
                if end in closing:
                    opener, end = closing[end], end + 1
                elif end + 1 in closing and s[end] in "   " and s[end + 1] in "»”“\"":
                    opener, end = closing[end + 1], end + 2
                elif end < len(s) and s[end] in "’'" and end + 1 < len(s) and s[end + 1].isspace():
                    end += 1
                else:
                    break
            if opener is not None and not (opener < m.start()):
                opener = None
            if end >= len(s) or inside(end):
                continue
            t = self._terminal(s, m, end, opener, lower_typed)
            if t is not None:
                found[end] = t
        if _THAI.search(s):
            for m in _SPACE.finditer(s):
                e = m.start()
                if e and e not in found and "\u0e00" <= s[e - 1] <= "\u0e7f" and m.end() < len(s) and s[m.end()] not in "ฯๆ," and not inside(e):
                    found[e] = (e, 3.0 if s.endswith(THAI_CLOSERS, 0, e) else THAI_BLANK, None, 0.0, 0.0, 0.0)
        return [found[k] for k in sorted(found)]

    def _terminal(self, s: str, m: re.Match, end: int, opener: int | None, lower_typed: bool) -> tuple | None:
        mark, gap = m[0], end < len(s) and s[end].isspace()
        nxt = _SPACE.match(s, end).end() if gap else end
        if nxt >= len(s):
            return None
        c = s[nxt]
        word = _WORD.match(s, _OPENING.match(s, nxt).end())
        first = (word[0] if word else "").lower()
        letter = s[word.start()] if word else c
        cased = letter.lower() != letter.upper()
        lower = cased and letter.islower()
        opens = first in self.openers
        k = m.start()
        while k and s[k - 1] not in _EDGE and not s[k - 1].isspace():
            k -= 1
        prev = s[k : m.start()]
        hard = any(x in "。！？؟।॥۔｡" for x in mark)
        if set(mark) <= {".", "…"} and (len(mark) > 1 or "…" in mark):  # suspension points
            if not gap and not cased:
                score = -3.0
            elif lower_typed and cased:
                score = 1.0 if opens else -1.0
            else:
                # without capitals to go by, they end a sentence unless a connecting word follows
                score = 2.5 if cased and not lower else (-3.0 if cased or GOES_ON.match(s, nxt) else 1.0)
        elif hard or "!" in mark or "?" in mark:
            if not gap and not hard and (lower or c.isdigit() or c in "=&/"):
                return None
            score = 4.0 if hard else 3.0
            if lower and (not lower_typed or prev.lower() in self.inner):
                score = -5.0
        else:
            score = self._full_stop(c, letter, cased, lower, opens, first, prev, gap, opener, lower_typed)
            if score is None:
                return None
        if opener is None:
            # the opening word speaks for itself: a usual one for the cut, a small one in cased text against it
            opening = 0.5 if opens else 0.0
            return end, score - opening, None, 0.0, 0.0, opening
        on = bool(GOES_ON.match(s, nxt)) or self._reported(s, nxt) and not (opens and cased and not lower)
        if s[opener] in _BRACKETS:
            return end, 0.0, opener, -5.0 if lower and not lower_typed else 3.0, -6.0, 0.0
        alone = -5.0 if on or lower and not lower_typed else max(score, 3.0)
        if cased and not lower:
            embedded = 2.0
        elif cased:
            embedded = (1.5 if opens or mark == "." else -2.0) if lower_typed else -5.0  # a full stop inside the quotation closes both
        else:
            embedded = 1.5
        return end, 0.0, opener, alone, -5.0 if on else embedded, 0.0

    @staticmethod
    def _reported(s: str, at: int) -> bool:
        """Whether a quotation is followed by at most two words and a verb that reports speech."""
        m = _REPORT.match(s, at)
        words = [w.lower() for w in _REPORT_WORD.findall(m[0])] if m else []
        return any(w in REPORTS for w in words) and not (len(words) > 1 and words[1] in ("from", "von", "de", "aus", "من"))

    def _full_stop(self, c: str, letter: str, cased: bool, lower: bool, opens: bool, first: str, prev: str, gap: bool, opener: int | None, lower_typed: bool) -> float | None:
        """The score of an end at a single full stop behind the word prev and before c; None where none can be."""
        key = prev.lower().lstrip("-–—")
        if "." in key and not re.fullmatch(r"(?:[^\W\d_]{1,2}\.)+[^\W\d_]{1,2}", key) and not key[-1].isdigit():
            key = key.rpartition(".")[2]  # behind a missing blank
            prev = prev[-len(key) :]
        if not gap and opener is None:
            if c in "\"“„«(「（":
                pass
            elif c.isdigit() or not c.isalpha() or prev[-1:].isdigit() and cased and lower:
                return None
            elif cased:
                # a missing blank: two letters or more, small before and a capital after
                if not (len(key) >= 2 and prev[-1:].islower() and c.isupper() and "." not in key and key not in self.never):
                    return None
                return 2.0
            else:
                if len(key) < 2 or key in self.never or key in MAYBE or prev[-1:].isascii():
                    return None
                return 2.0
        if key in self.never or len(key) == 1 and key.isalpha() and (prev.isupper() or key.lower() == key.upper()):
            return -6.0
        if key in NUMBERED and (c.isdigit() or lower and key not in ("no", "s")):
            return -6.0
        if prev[-1:].isdigit() and first in MONTHS:
            return -6.0
        if key in MAYBE or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", key):
            if cased and not lower:
                return 2.0
            if cased and lower_typed or not cased and letter.isalpha():
                return 2.0 if opens else -2.0
            return -3.0 if not letter.isdigit() else 0.5
        if lower and not lower_typed:
            return -5.0
        if lower_typed and len(key) == 1 and key.isalpha():
            return -4.0
        return 3.0


_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x64B, 0x65F), (0x900, 0x903), (0x93A, 0x93C), (0x93E, 0x94F), (0x951, 0x957), (0x962, 0x963), (0xE31, 0xE31), (0xE34, 0xE3A), (0xE47, 0xE4E)))
#: A word with its mark; the blank behind it belongs to it only where a small letter follows.
_COUNTED = re.compile(f"(?:[^\\W\\d_]+[{_MARKS}’']*)+(?:[.!?]+(?:\\s(?=[a-zß-öø-ÿα-ωа-яё]))?)?")
_BLOCKS = re.compile("\n\\s*\n|(?<=[!?؟]) (?![a-zß-öø-ÿα-ωа-яё])")
#: Distinct words that a task counts before it passes them on.
HELD = 500_000


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cased, w, n, first): words with their marks, counted in each partition, and how many of them open a block."""

    def give() -> pa.RecordBatch:
        keys = [(c, w) for c in (False, True) for w in all_[c]]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in keys], pa.bool_()), pa.array([w for _, w in keys], pa.string()), pa.array([all_[c][w] for c, w in keys], pa.int64()), pa.array([first[c][w] for c, w in keys], pa.int64())], ["cased", "w", "n", "first"])

    all_, first = (Counter(), Counter()), (Counter(), Counter())
    for b in batches:
        for t in b.column(0).to_pylist():
            cased = t != t.lower()
            for block in _BLOCKS.split(t):
                words = _COUNTED.findall(block)
                if words:
                    all_[cased].update(words)
                    first[cased][words[0]] += 1
        if len(all_[0]) + len(all_[1]) > HELD:
            yield give()
            all_, first = (Counter(), Counter()), (Counter(), Counter())
    yield give()


def learnt(texts: DataFrame, text_col: str = "text", least: int = 5, share: float = 1e-5) -> Splitter:
    """A splitter with what one pass over all texts tells about their words.

    * openers open at least a fifth of the places where they stand: `least` blocks or more and the given share of all, which
      bounds them to 1 / share words;
    * inner words have a ! or ? of their own: a small letter follows it more often than not;
    * abbreviations have at most six letters, mostly a full stop behind them, and behind that a small letter in a third of the
      places or more. Texts without capitals don't count for these two, and both must be seen `least` times.
    """
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(_counted, "cased boolean, w string, n long, first long")
    seen = rows.groupBy("cased", "w").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    plain = F.lower(F.regexp_extract("w", r"^([\p{L}\p{M}’']+)", 1))
    stop, mark, small = F.col("w").rlike(r"^[^.!?]+\.\s?$"), F.col("w").rlike(r"[!?]\s?$"), F.col("w").rlike(r"\s$")
    of = lambda c: F.sum(F.when(c & F.col("cased"), F.col("n")).otherwise(0))
    counts = cut(seen.groupBy(plain.alias("word")).agg(F.sum("n").alias("n"), F.sum("first").alias("first"), of(stop).alias("stops"), of(stop & small).alias("stops_small"), of(mark).alias("marks"), of(mark & small).alias("marks_small"), of(F.lit(True)).alias("cased_n")))
    total = counts.agg(F.sum("first").alias("f"), F.sum("marks").alias("m"), F.sum("stops").alias("s")).first()
    many = lambda c, of_all: F.col(c) >= max(least, share * (of_all or 0))
    opens = many("first", total.f) & (F.col("first") * 5 >= F.col("n"))
    inner = many("marks_small", total.m) & (F.col("marks_small") * 2 > F.col("marks"))
    short = many("stops_small", total.s) & (F.char_length("word") <= 6) & (F.col("stops_small") * 3 >= F.col("stops")) & (F.col("stops") * 2 > F.col("cased_n"))
    rows = counts.select("word", opens.alias("o"), inner.alias("i"), short.alias("s")).where("o or i or s").collect()
    return Splitter(*(frozenset(r.word for r in rows if r[c]) for c in ("o", "i", "s")))


def sentences(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Splitter | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos): every sentence of every text, in code points, the end exclusive.

    Null and blank texts have none; repeated rows give repeated spans; texts may be of any length.
    """
    splitter = learnt(texts, text_col) if known is None else known

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, a, z = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = splitter.split(t)
                ids += [i] * len(spans)
                for x, y in spans:
                    a.append(x)
                    z.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.int64()), pa.array(z, pa.int64())], [id_col, "start_pos", "end_pos"])

    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut_up, f"`{id_col}` long, start_pos long, end_pos long")

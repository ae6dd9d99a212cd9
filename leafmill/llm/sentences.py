"""Problem 1: sentence boundaries across languages and scripts.

Method.  Candidate boundaries are runs of sentence marks with the closing
marks after them, paragraph breaks, lines that open a list item and, in
writing without marks (Thai), gaps beside its letters.  A maximum-entropy
classifier decides every candidate from its neighbourhood: the two tokens
before, the token after, their case, length, digits and script, the mark or
break, the closing marks, the gap, and where a closed quotation had been
opened.  It is trained on reliable places of the same texts: boundaries are
ends of blocks joined to starts of blocks, paragraph breaks, lines of a list
and unambiguous marks; non-boundaries are places before a lower-case word,
digit or comma, titles and reference words before what they introduce,
initials, and Thai gaps beside digits or Latin letters.  The rules that find
these places are used for training only; a few example texts train along.

Which words begin texts is counted over all texts, as a rate that does not
move with their number.  The sample that trains the weights is drawn by hash:
about ``SAMPLE_BLOCKS`` blocks and at most ``SAMPLE_CHARS`` characters; of a
longer text a stretch of ``STRETCH`` characters at a place drawn by hash
trains.  The classifier is applied to all texts, whole.

Cases: null and blank texts give no sentence; the last sentence ends at the
last non-blank character; repeated rows each get their sentences; an empty
table gives an empty result (a few example texts then train alone);
texts of any length are scanned once from left to right.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_BLOCKS = 8_000
SAMPLE_CHARS = 8_000_000
STRETCH = 8_000
#: How often each example counts.
EXAMPLE_TIMES = 4
DIMENSIONS = 1 << 16
#: A word begins texts if it does in this share of its texts, and is a word of the inside below that share.
BEGINS_RATE, INSIDE_RATE = 0.15, 0.002
#: Words whose places are kept in a task's memory, and words that are sent.
PLACES_KEPT, BEGINS_SENT = 200_000, 200_000
#: Decisions kept in a worker's memory; beyond this the memory is emptied.
DECISIONS_KEPT = 300_000

MARKS = ".!?…。！？؟।॥．｡"
CLOSERS = "\"'”’»›)）]】」』》〉"
OPENERS = "\"'“‘«‹„(（[【「『《〈¿¡"
PAIRS = {"”": "“„", "“": "„", "’": "‘‚", "»": "«", "›": "‹", "」": "「", "』": "『", '"': '"', ")": "(", "）": "（", "]": "[", "】": "【", "》": "《"}
QUOTES = "”“’»›」』\""

#: Words before a full stop that introduce what follows them (lower case).
INTRODUCE = frozenset(
    "dr prof mr mrs ms messrs m mme mlle dra dras sr sra sres srta hr fr st fig figs tab tabs sec secs no nos nr eq eqs vol vols p pp s abb bd kap "
    "vgl cf ca approx e.g i.e vs bzw z d.h z.b art arts núm pág págs cap véase р рис табл гл стр см т.е напр ред им ул г-н г-жа проф "
    "ص د م डॉ श्री std dev app rev ed eds resp ch n° p.ex p.ej ej ex jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic".split()
)
#: Words that go on after a quotation in writing without capitals.
GOES_ON = frozenset("ثم وقال ने と という 问道 说道".split())
#: Words that a single letter may follow as their own name (lower case).
LETTERED = frozenset("rev app appendix anhang annexe anexo type class part table plate".split())
#: Words that go on before a lower-case word or a bracket, and may also end a sentence.
EITHER = frozenset("etc jr sr al a.m p.m u.a ff inc ltd co corp kg т.д т.п г dept est usw usf".split())

#: Example texts that always train along, so that rare places have a few labels in a small collection.
EXAMPLES = (
    "1. The first step.\n2. The second step.\n- A point without a mark\n- Another point\n(a) A third one.",
    "Dr. Hill met Prof. A. Stone at 9 a.m. near No. 12. J. K. Marsh wrote Fig. 3. It rose by 4.5 kg! Was it cold? Yes. See Sec. 2 and App. C. They use pipes, tubes, etc. A test followed.",
    "“Is it cold?” asked R. Marsh. She wrote: “It is cold.” He slept. “Run!” cried Lee. (It had rained.) The U.S. Army left. At 5 p.m. 12 men came. pH fell. The value was 3.25. 14 tests ran.",
    "Am 4. Mai kam Dr. Berg, vgl. Abb. 2. „Es regnet“, sagte Prof. Wald. „Ist es kalt?“ fragte Jan. Der 3. Versuch ergab z. B. 2,5 kg. Laut Nr. 7 fiel er. Er schrieb: „Es ist kalt.“ Dann ging er.",
    "M. Dubois voit la fig. 2 et la p. 9. A. Petit note\u00a0: «\u00a0Il pleut.\u00a0» Pourquoi\u00a0? Il part, etc. L. Grand note\u00a0: «\u00a0Il dort.\u00a0» Mme Roy rit\u00a0! Le chat dort, cf. p. 3. N. Blanc arrive.",
    "El Sr. Ruiz llega, véase pág. 2 y fig. 5. ¡Qué frío! ¿Por qué llueve? La Dra. Vega escribe: «Llueve.» Vio mesas, sillas, etc. J. Luna sale. ¿Duerme? ¡Corre! Fue en la pág. 7. ¡Llueve otra vez!",
    "В 1999 г. A. B. Petrov видел рис. 2, т. е. лес. Почему идёт дождь? Идёт снег! «дождь кончился», — сказал И. Иванов. В 2001 г. C. D. Sidorov писал, см. стр. 4. Он видел лес, дом и т. д. Потом он ушёл.",
    "“下雨了吗？”Lee问道。他走了。王说：“下雨了。”我们看了第3节。（见第4节。）为什么？天冷！据Kim说：“停了。”他来了……然后走了。",
    "「雨が降った。」とLeeは言った。なぜ寒いのか？値は2.5から1.5へ下がった。「寒い。」とKimは述べた。彼は来た。",
    "क्या वर्षा हुई? “क्या ठंड है?” Lee ने पूछा। डॉ. Kim ने कहा, “वर्षा हुई।” वह गया। “क्या वह आया?” Roy ने पूछा। 1999 तक वह नहीं आया। कितना ठंडा है!",
    "قال د. Lee: «هل نزل المطر؟» ثم نام. لماذا ذهب؟ انظر ص. 4 والشكل 2. ذهب الرجل! قال م. Kim: «نزل المطر.» ثم ذهب.",
    "ฝนตกหนักมาก\nอากาศเย็นลง\n\nแม่น้ำไหลช้า",
    "เราพบหิน 12 ก้อนในแม่น้ำ", "ลมพัดแรงในตอนเช้า", "เครื่องรุ่น AB-7 ทำงานช้าๆ แล้วหยุด", "น้ำในบ่อแห้ง", "คนงานซ่อมสะพาน", "เขาเห็น 3.5 กิโลกรัมบนโต๊ะ", "อากาศเย็นลงมาก", "แม่น้ำไหลช้าในฤดูร้อน", "ปี ๒๕๖๐ ฝนตก",
)

_SPACE = r"\s\x1c-\x1f"
_CANDIDATE = (
    rf"""(?P<mark>[{MARKS}]+)(?P<close>(?:[  ]?[{regex.escape(CLOSERS)}]|“(?![\p{{L}}\p{{N}}]))*)"""
    rf"""|(?P<para>\n[ \t \r]*\n)"""
    rf"""|(?P<item>\n(?=[ \t]*(?:[-•*–·▪]|\(?\p{{L}}\)|\(?\d{{1,3}}[.)])[ \t]))"""
)
CANDIDATE = regex.compile(_CANDIDATE + r"|(?P<thai>(?!))")
CANDIDATE_THAI = regex.compile(_CANDIDATE + rf"|(?P<thai>(?<=[฀-๿])[{_SPACE}]+(?=[^{_SPACE}])|(?<=[^{_SPACE}])[{_SPACE}]+(?=[฀-๿]))")
THAI = regex.compile(r"[฀-๿]")
#: Signs of repetition and of abbreviation, after which a Thai statement goes on.
THAI_SIGNS = "ๆฯ"
NEXT = regex.compile(rf"""(?P<gap>[{_SPACE}]*)(?P<open>[{regex.escape(OPENERS)}—–\-]*[\u00a0\u202f ]?)(?P<word>[\p{{L}}\p{{M}}\p{{N}}]+(?:[.\-’'][\p{{L}}\p{{N}}]+)*\.?|.)?""", regex.S)
MARKED_LINE = regex.compile(r"(?:^|\n)[ \t]*(?:[-•*–·▪]|\(?\p{L}\)|\(?\d{1,3}[.)])[ \t][^\n]*$")
LINE_MARKER = regex.compile(r"(?:^|\n)[ \t\u00a0\u2000-\u200a]*\(?(?:\d{1,3}|\p{L})$")
NUMBER = regex.compile(r"^\d+(?:[.,–\-]\d+)+$")
ACRONYM = regex.compile(r"^\p{Lu}(?:\.\p{Lu})+$")
INITIAL = regex.compile(r"^\p{Lu}\.$")
MIXED = regex.compile(r"^\p{Ll}+\p{Lu}")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.\-’'][\p{L}\p{N}]+)*")
DIGITS = regex.compile(r"\d+")
DIGIT = regex.compile(r"\p{N}")
GLUED = regex.compile(r"(?<=\p{Ll}{3}[.!?])(\p{Lu}[^.]*)$")


def trimmed(text: str, at: int) -> int:
    """The place after the last character before ``at`` that isn't white space."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _shape(token: str) -> str:
    """Digits as nines up to four, so that numbers of one form are one token."""
    if token.isalpha():
        return token
    return DIGITS.sub(lambda m: "9" * min(4, len(m[0])), token)


def _plain(token: str, size: int) -> str:
    """Ordinary words and names stand for all of their kind; short ones and known abbreviations stay as they are."""
    if len(token) <= size or not token.isalpha() or token.lower() in INTRODUCE or token.lower() in EITHER:
        return token
    return "aaaa" if token.islower() else "Aaaa" if token[1:].islower() else token


def _kind(ch: str) -> str:
    if not ch:
        return "none"
    if ch.isdigit():
        return "digit"
    if ch.islower():
        return "lower"
    if ch.isupper():
        return "upper"
    if CJK.match(ch):
        return "cjk"
    if "฀" <= ch <= "๿":
        return "thai"
    if "ऀ" <= ch <= "ॿ":
        return "deva"
    if "؀" <= ch <= "ۿ":
        return "arab"
    return "other"


def candidates(text: str, *span: int):
    """Candidate boundaries from left to right."""
    return (CANDIDATE_THAI if THAI.search(text) else CANDIDATE).finditer(text, *span)


def _before(text: str, at: int) -> tuple[str, str]:
    """The two tokens that end at ``at``; in writing without word gaps the last two characters."""
    cut = text[max(0, at - 40) : at]
    if cut and (CJK.match(cut[-1]) or THAI.match(cut[-1])):
        return "", cut[-1] if cut[-1] in THAI_SIGNS or cut[-1].isdigit() else cut[-2:]
    tokens = cut.rsplit(None, 2)
    two = tokens[-1] if tokens else ""
    one = tokens[-2] if len(tokens) > 1 and not cut[-1].isspace() else ""
    if not two.isalpha():
        glued = GLUED.search(two)
        if glued:
            one, two = two[: glued.start(1)], glued[1]
        two = two.rpartition("’")[2] or two
    return _shape(one.strip(OPENERS + CLOSERS + "—–,;:")[-14:]), _shape(two.lstrip(OPENERS + CLOSERS + "—–")[-14:])


#: A mark of writing that uses it for nothing else; a lower-case word of six letters or more, a full stop, a blank and a capital.
FULL = {m: ("", "", m, "", "", "", "", "", "cjk", "", "", False) for m in "。！？।॥"}
ORDINARY = ("", "aaaa", ".", "", "", " ", "", "", "upper", "", "", False)


class Opened:
    """The last place of an opening mark before a place; asked from left to right it reads the text once."""

    def __init__(self, text: str):
        self.text, self.last = text, {}

    def before(self, marks: str, at: int) -> int:
        best = -1
        for o in marks:
            read, place = self.last.get(o, (0, -1))
            if at < read:
                read, place = 0, -1
            found = self.text.rfind(o, read, at)
            place = found if found >= 0 else place
            self.last[o] = at, place
            best = max(best, place)
        return best


def quote_from(text: str, at: int, close: str, opened: Opened | None = None) -> str:
    """Where the quotation or bracket closed at ``at`` had been opened: S at a sentence's start, C after a colon, M after a comma, W after a word."""
    last = close[-1:]
    if last not in PAIRS:
        return ""
    k = (opened or Opened(text)).before(PAIRS[last], at)
    if k < 0:
        return "?"
    end = trimmed(text, k)
    if not end or text[end - 1] in MARKS or text[end - 1] in CLOSERS + "“":
        return "S"
    head = ("x" if end > 40 else "") + text[max(0, end - 40) : end]  # enough for a list marker
    if LINE_MARKER.search(head.rstrip(".)")) and head[-1] in ".)" or head[-1] in "-•*–·▪" and (len(head) == 1 or head[-2] == "\n"):
        return "S"
    return {":": "C", "：": "C", ",": "M", "，": "M", "、": "M"}.get(head[-1], "W")


def context(text: str, m, begins: dict[str, str], opened: Opened | None = None, quick: bool = True) -> tuple:
    """The neighbourhood that the classifier sees, as a tuple of small strings.

    ``begins`` tells of the words of all texts whether they begin texts.  ``quick``: the most frequent neighbourhoods are told without looking closer; decisions are the same without it."""
    s, e = m.span()
    mark, close = m["mark"], m["close"] or ""
    if not mark:
        s = trimmed(text, s)
        mark = "¶" if m["para"] else "•" if m["item"] else "_"
    elif quick and not close:
        if mark in FULL:
            return FULL[mark]
        if text[e : e + 1] == " " and text[e + 1 : e + 2].isupper() and s > 7:
            if mark == "." and (tail := text[s - 6 : s]).isalpha() and tail.islower() and tail not in INTRODUCE:
                return ORDINARY
            if mark in "?!" and text[s - 3 : s].isalpha() and text[s - 3 : s].islower():
                return ("", "aaaa", mark, "", "", " ", "", "", "upper", "", "", False)
    one, two = _before(text, s)
    n = NEXT.match(text, e)
    gap = n["gap"] if m["mark"] else text[s : n.end("gap")]
    gap = "" if not gap else "2" if gap.count("\n") > 1 else "n" if "\n" in gap else " "
    opener, word = n["open"].strip(), n["word"] or ""
    first = _kind(word[:1])
    if first in ("cjk", "thai"):
        word = word[:2]
    mark = mark if len(mark) == 1 else "..." if "." in mark or "…" in mark else mark[:2]
    quote = quote_from(text, s, close, opened) if close else ""
    seen = begins.get(word.rstrip("."), "")
    mixed = "mixed" if MIXED.match(word) else ""
    one, two = _plain(one, 5), _plain(two, 4)
    if two == "aaaa" and mark == "." and not close and gap in (" ", "n") and not opener and first in ("upper", "deva", "arab"):
        one = word = ""
    if mark == "•":
        begun = MARKED_LINE.search(text, text.rfind("\n", 0, s) + 1 if s else 0, s)
        return "", "", mark, "listed" if begun else text[s - 1 : s] if text[s - 1 : s] in MARKS + CLOSERS + ":：," else "", "", gap, opener[:1], "", first, "", "", False
    marker = bool(not close and mark == "." and len(two) < 4 and LINE_MARKER.search(text, max(0, s - 24), s) and (s < 24 or "\n" in text[s - 24 : s] or s <= 4))
    return one, two, mark, close.strip("\u00a0\u202f"), quote, gap, opener[:1], _shape(word)[:12], first, mixed, seen, marker


def reliable(c: tuple) -> tuple[int | None, str]:
    """A label where the neighbourhood leaves no doubt, and the rule that gave it."""
    one, two, mark, close, quote, gap, opened, word, first, mixed, seen, marker = c
    low = two.lower()
    if mark == "•":
        return (1, "line of a list") if close and close != "," else (None, "")
    if mark == "_":
        if two in THAI_SIGNS or not THAI.search(two) or two[-1:].isdigit() or first != "thai":
            return 0, "within a statement"
        return None, ""
    if marker:
        return 0, "list marker"
    if gap == "2":
        return 1, "paragraph"
    if not word and not opened:
        return 1, "end"
    if close and close[-1] in QUOTES and word in GOES_ON and not opened:
        return 0, "report goes on"
    if close and close[-1] in QUOTES and quote == "S" and opened not in ("“", "„", "«", "「"):
        return 0, "reported remark"
    if first == "lower" and not mixed and not opened:
        return 0, "lower case follows"
    if first == "other" and word in ",;:，；、،؛)":
        return 0, "goes on"
    if close and first in ("upper", "cjk", "deva", "arab", "thai"):
        if close[-1] in ")）】]" and quote == "S":
            return 1, "own brackets"
        if close[-1] in QUOTES and quote in ("C", "M") and mark in ".。।":
            return 1, "quotation ends"
    if mark in "。！？।॥" and not close:
        return 1, "full mark"
    if mark in ".…..." and mark != "...":
        if gap == "" and not close:
            if first in ("digit", "lower"):
                return 0, "within a token"
            if first == "upper" and (len(two) < 3 or two[-1:].isdigit() or "." in two or two[-1:].isupper()):
                return 0, "within a token"
            return None, "no gap"
        single = len(two) == 1 and two.isupper() and two.isascii() and first == "upper"
        if low in INTRODUCE and not close and not single:
            return 0, "introduces"
        if NUMBER.match(two) and gap and (first != "lower" or mixed):
            return 1, "number ends"
        if one.rstrip(".").lower() in LETTERED and len(two) == 1 and two.isupper() and gap and not close and (first in ("upper", "digit") or mixed):
            return 1, "lettered"
        if gap and not close and (low in EITHER and mixed or low == "jr" and first == "upper" and len(word) > 2):
            return 1, "may end"
        if len(two) > 3 and two.isalpha() and two.islower() and low not in EITHER and opened and opened in "“«„「" and gap and not close:
            return 1, "word and quotation"
        if low in EITHER and opened and opened in "(（[":
            return 0, "goes on in brackets"
        if ACRONYM.match(two) and first == "upper" and seen != "begins" and gap:
            return 0, "acronym"
        if low in ("г", "sr", "st") and INITIAL.match(word):
            return 0, "initial follows"
        if first == "digit" and low[-1:].isalpha() and (low in INTRODUCE or low in EITHER):
            return 0, "number follows"
        if len(two) == 1 and two.isupper() and not close and first == "upper":
            if len(one) == 2 and one[0].isupper() and one[1] == "." or one.rstrip(".").lower() in ("dr", "prof", "г", "mme") or one == "" or one[-1:] in "!?”»":
                return 0, "initial"
            return (None, "letter") if seen == "begins" and not one[-1:].isdigit() and one[:1].isupper() else (0, "initial")
        if two[-1:].isdigit() and one.endswith(".") and one[:-1].lower() in INTRODUCE and (first == "upper" or mixed) and gap:
            return 1, "reference and capital"
        if two.isdigit() and len(two) < 3 and first == "upper" and one in ("Der", "Die", "Das", "Am", "Den", "Dem", "Vom", "Zum", "der", "die", "das", "am", "den", "dem", "vom", "zum"):
            return 0, "ordinal"
        if len(two) > 3 and two.isalpha() and two.islower() and low not in EITHER and first in ("upper", "cjk", "deva", "arab") and not close:
            return 1, "word and capital"
    if mark in "!?؟" and not close and first in ("upper", "deva", "arab", "cjk") and gap:
        return 1, "mark and capital"
    if mark == "..." and first in ("cjk",) and not close:
        return 0, "pause"
    return None, ""


def _forms(one: str, two: str) -> str:
    """What kind of token stands before the candidate."""
    if not two:
        return "none"
    if THAI.search(two) and not two[-1].isdigit():
        return "thai"
    if len(two) == 1 and two.isupper():
        low = one.rstrip(".").lower()
        before = "L" if low in LETTERED else "I" if len(one) == 2 and one[0].isupper() and one[1] == "." else "T" if low in INTRODUCE else "D" if one[-1:].isdigit() else "0" if not one else "!" if one[-1] in "!?”»" else "c" if one[:1].isupper() else "w"
        return "U" + before
    if ACRONYM.match(two):
        return "acronym"
    if NUMBER.match(two):
        return "number"
    if two[-1:].isdigit():
        return "9ref" if one.endswith(".") and one[:-1].lower() in INTRODUCE else "9"
    return "Ul" if two[:1].isupper() else "l" if two.islower() else "x"


def features(c: tuple) -> list[str]:
    one, two, mark, close, quote, gap, opened, word, first, mixed, seen, marker = c
    low = two.lower()
    size = min(len(two), 6)
    abbreviation = "i" if low in INTRODUCE else "e" if low in EITHER else "dots" if "." in two else ""
    quoted = f"{close[-1:]}{quote}"
    form = _forms(one, two)
    going = "g" if word in GOES_ON else "p" if first == "other" and word in ",;:，；、،؛)" else ""
    return [
        f"m{mark}", f"p{two}", f"o{one}", f"n{word}", f"f{first}{mixed}", f"g{gap}{mark}", f"q{quoted}", f"a{abbreviation}{mark}", f"l{marker}", f"s{form}{size}", f"w{opened}{mark}", f"ff{form}|{first}{mixed}{opened}|{mark}{gap}{close[-1:]}",
        f"pn{two}|{word}", f"op{one}|{two}", f"pf{two}|{first}{mixed}", f"fs{form}|{seen}{first}", f"qn{quoted}|{word}", f"qf{quoted}|{first}{opened}", f"go{going}{close[-1:]}", f"am{abbreviation}|{first}{mixed}{opened}{gap}{mark}",
        f"mf{mark}|{first}{mixed}{opened}{gap}|{close}", f"on{form}|{word}", f"b{seen}{mark}", f"bq{seen}|{quoted}", f"bf{seen}|{form}{abbreviation}", f"qm{quoted}|{mark}{first}",
    ]


def hashed(c: tuple) -> list[int]:
    return [zlib.crc32(f.encode()) % DIMENSIONS for f in features(c)]


class Splitter:
    """Weights of the classifier and the decisions already made."""

    def __init__(self, weights: np.ndarray, bias: float, begins: dict[str, str]):
        self.weights, self.bias, self.begins, self.known = weights, bias, begins, {}

    def __getstate__(self):
        return self.weights, self.bias, self.begins

    def __setstate__(self, state):
        self.weights, self.bias, self.begins = state
        self.known = {}

    def score(self, c: tuple) -> float:
        return float(self.weights[hashed(c)].sum() + self.bias)

    def decide(self, c: tuple) -> bool:
        got = self.known.get(c)
        if got is None:
            if len(self.known) > DECISIONS_KEPT:
                self.known.clear()
            got = self.known[c] = self.score(c) > 0
        return got

    def ends(self, text: str | None) -> list[int]:
        """Offsets just after each sentence of ``text``, in code points."""
        if not text:
            return []
        out: list[int] = []
        last = trimmed(text, len(text))
        if not last:
            return out
        first = len(text) - len(text.lstrip())
        opened = Opened(text)
        for m in candidates(text, first, last):
            e = m.end() if m["mark"] else trimmed(text, m.start())
            if first < e < last and (not out or e > out[-1]) and self.decide(context(text, m, self.begins, opened)):
                out.append(e)
        if not out or out[-1] < last:
            out.append(last)
        return out


def places(text: str) -> tuple[str, set[str]]:
    """The word that begins a text, and the words inside it."""
    first = WORDS.search(text)
    if not first:
        return "", set()
    inside = set()
    for token in set(text[first.end() :].split()):
        if token.isalpha():  # a word as it is
            inside.add(token[:2] if CJK.match(token) else token)
        else:
            inside.update(w[:2] if CJK.match(w) else w for w in WORDS.findall(token))
    return first[0][:2] if CJK.match(first[0]) else first[0], inside


def begins_of(counts) -> dict[str, str]:
    """``begins`` or ``inside`` by the share of a word's texts that it begins, from (word, texts it begins, texts it is inside of); words in few texts are shrunk towards neither."""
    out = {}
    for word, first, inside in counts:
        if first / (first + inside + 1) >= BEGINS_RATE:
            out[word] = "begins"
        elif (first + 0.01) / (first + inside + 0.01) < INSIDE_RATE:
            out[word] = "inside"
    return out


def beginners(texts: list[str]) -> dict[str, str]:
    """Words that begin texts, and words that hardly do; words with digits are neither."""
    first, inside = Counter(), Counter()
    for t in texts:
        head, others = places(t)
        if head:
            first[head] += 1
            inside.update(others)
    return begins_of((w, first[w], inside[w]) for w in first.keys() | inside.keys() if not DIGIT.search(w))


def _count_places(batches):
    """In how many texts words begin and stand inside; emptied at a fixed size."""
    first, inside = Counter(), Counter()

    def rows():
        words = [w for w in first.keys() | inside.keys() if not DIGIT.search(w)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([first[w] for w in words], pa.int64()), pa.array([inside[w] for w in words], pa.int64())], ["word", "first", "inside"])

    for batch in batches:
        for t in batch.column(0).to_pylist():
            head, others = places(t)
            if head:
                first[head] += 1
                inside.update(others)
        if len(first) + len(inside) > PLACES_KEPT:
            yield rows()
            first.clear()
            inside.clear()
    yield rows()


def all_beginners(texts: DataFrame) -> dict[str, str]:
    """``beginners`` over all texts, copies included; of more than ``BEGINS_SENT`` words that begin texts or hardly do those in most texts."""
    counts = texts.mapInArrow(_count_places, "word string, first bigint, inside bigint").groupBy("word").agg(F.sum("first").alias("first"), F.sum("inside").alias("inside"))
    begins = F.col("first") / (F.col("first") + F.col("inside") + 1) >= BEGINS_RATE
    hardly = (F.col("first") + 0.01) / (F.col("first") + F.col("inside") + 0.01) < INSIDE_RATE
    rows = counts.where(begins | hardly).orderBy(F.desc("first"), F.desc("inside"), "word").limit(BEGINS_SENT).collect()
    return begins_of((r.word, r["first"], r.inside) for r in rows)


def labelled(texts: list[str], begins: dict[str, str], seed: int = 7) -> Counter:
    """(context, label) counts from the reliable places of the texts."""
    rows: Counter = Counter()
    starts: dict[str, list[str]] = {}
    script = lambda t: _kind(next((ch for ch in t if ch.isalpha()), ""))
    for t in texts:
        word = WORDS.search(t[:60])
        if word and word[0][0].islower() and not MIXED.match(word[0]):
            continue  # a text that begins in lower case goes on from another
        starts.setdefault(script(t).replace("lower", "upper"), []).append(t[:60])
    draw = random.Random(seed)
    for t in texts:
        opened = Opened(t)
        for m in candidates(t):
            if m.end() < len(t) and m.start():
                c = context(t, m, begins, opened)
                label = reliable(c)[0]
                if label is not None:
                    rows[c, label] += 1
        tail = t[-120:]
        thai = THAI.match(tail[-1:])
        end = None if thai else next((m for m in candidates(tail) if m["mark"] and m.end() == len(tail)), None)
        others = starts.get(script(t).replace("lower", "upper"))
        if others and (end is not None or thai):
            for gap in (" ", " ", "\n"):
                joined = tail + gap + draw.choice(others)
                at = len(tail) if thai else end.start()
                m = next((m for m in candidates(joined, at) if thai or m["mark"]), None)
                if m is not None and (m["thai"] and m.start() == len(tail) or m["mark"] and m.end() == len(tail)):
                    c = context(joined, m, begins)
                    if not c[-1] and (m["mark"] or reliable(c)[0] is None):
                        rows[c, 1] += 2
    return rows


def train(texts: list[str], begins: dict[str, str] | None = None, rounds: int = 60, rate: float = 0.5, penalty: float = 1e-5) -> Splitter:
    """Maximum entropy (logistic regression) by AdaGrad on the labelled contexts."""
    texts = [t.strip() for t in texts if t and t.strip()]
    begins = beginners(texts) if begins is None else begins
    rows = labelled(texts, begins)
    for row, n in labelled(list(EXAMPLES), beginners(list(EXAMPLES))).items():
        rows[row] += EXAMPLE_TIMES * n
    weights, bias = np.zeros(DIMENSIONS), 0.0 if rows else -1.0
    if rows:
        keys = list(rows)
        x = np.array([hashed(c) for c, _ in keys])
        y = np.array([label for _, label in keys], dtype=float)
        n = np.sqrt(np.array([rows[k] for k in keys], dtype=float))
        n /= n.sum()
        seen, seen_bias = np.full(DIMENSIONS, 1e-8), 1e-8
        flat = x.ravel()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(weights[x].sum(axis=1) + bias, -30, 30)))
            g = (p - y) * n
            step = np.bincount(flat, weights=np.repeat(g, x.shape[1]), minlength=DIMENSIONS) + penalty * weights
            seen += step * step
            weights -= rate * step / np.sqrt(seen)
            seen_bias += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(seen_bias)
    return Splitter(weights.astype(np.float32), float(bias), begins)


def fit(df: DataFrame, key: str, text: str, rows: int = SAMPLE_BLOCKS, chars: int = SAMPLE_CHARS) -> Splitter:
    """Train the weights on a bounded sample in the order of a hash of ``key``; the words that begin texts are counted over all."""
    share = -(-df.count() // rows) or 1
    texts = df.select(F.xxhash64(key).alias("h"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    size = F.length("t")
    start = F.when(size > STRETCH, F.pmod(F.xxhash64("h", F.lit(1)), size - STRETCH)).otherwise(0).cast("int")
    sample = texts.where(F.pmod("h", F.lit(share)) == 0).select("h", F.substring(F.col("t"), start + 1, F.lit(STRETCH)).alias("t")).limit(2 * rows).collect()
    out, size = [], 0
    for r in sorted(sample):
        size += len(r.t)
        if size <= chars:
            out.append(r.t)
    return train(out, all_beginners(texts.select("t")))


def prose(df: DataFrame, kind: str) -> DataFrame:
    """Rows whose canonical type is text or list_item."""
    return df.where(canonical(kind).isin("text", "list_item"))


def canonical(kind: str):
    return F.lower(F.translate(F.trim(F.regexp_replace(kind, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), "- ", "__"))


def sentence_ends(df: DataFrame, key: str, text: str, splitter: Splitter) -> DataFrame:
    """One row per sentence: ``key`` and ``end_char``."""
    shared = df.sparkSession.sparkContext.broadcast(splitter)

    def run(batches):
        own = shared.value
        for batch in batches:
            ends = [own.ends(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ends), np.int64, len(ends))
            flat = pa.array([e for x in ends for e in x], pa.int32())
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(ends)), sizes)))
            yield pa.RecordBatch.from_arrays([keys, flat], [key, "end_char"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, end_char int")

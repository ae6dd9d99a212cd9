"""Problem 4: repairing text from scanned pages.

Method.  Pages of a document are read in order, in windows of ``PAGES`` pages
with ``MARGIN`` pages of context on both sides, so that no group grows with a
document.  Lines at the edges of pages that recur on other pages, up to
misread characters, are running headers; what recurs is counted over the
whole document first, so that the other page may be any number of windows
away.  Edge lines whose number keeps a constant distance from the page's
place are page numbers.  For every body word outside the vocabulary the
Levenshtein automaton of the word is intersected with a trie of the
vocabulary, which yields all words within the distance (2, or 1 for words of
under four letters).  They are ranked by how the eye confuses the differing
characters, less the evidence of the words beside: in how many documents each
reading stands after the word before and before the word after; then by how
often the same window of the document has it.  Readings that no confusion
explains are taken only where both neighbours speak for them.  All pairs count:
up to ``PAIRS_SENT`` of them are sent to every executor; of more, every window
first names those that its readings ask for and gets their counts by a join.
Words cut at a
line's end are joined where the joined form is a word (or a name seen whole)
and the hyphenated form isn't; a small word that stands after a hyphen within
lines of the corpus keeps its hyphen after a name.  Without furniture, the
lines are reflowed into paragraphs.

Cases: null and blank texts have no lines to repair; redelivered blocks count
once as evidence and each get their defects; pages may have any number, also
0 and below; blocks without a page number are read in windows of block order;
an empty vocabulary leaves all words as they are; a vocabulary of more than
``VOCABULARY_WORDS`` words is refused; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.tables import by_keys

PAGES, MARGIN = 128, 8
#: Lines from either edge of a page that may be furniture by themselves, and those that may be if they recur and all beyond them is furniture.
EDGE, DEEP = 2, 6
#: Lines of more characters are headers only if they recur letter by letter, on this many pages.
LONG, OFTEN = 90, 3
#: Most words of a vocabulary that is sent to every executor.
VOCABULARY_WORDS = 500_000
#: Pairs of neighbouring words (of 12 bytes each), and words after hyphens, up to which all of them are sent to every executor; of more, every window gets those that it asks for.
PAIRS_SENT, SUFFIXES_SENT = 1_000_000, 50_000
#: Readings up to this cost need no neighbours; what the logarithm of the documents with a pair takes off a cost.
FREE, EVIDENCE = 2.0, 0.05

#: Characters that recognition confuses (seen, meant).
CONFUSED = frozenset(
    {
        ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("5", "s"), ("ſ", "s"), ("ſ", "f"), ("9", "g"), ("6", "b"), ("8", "b"), ("+", "t"),
        ("c", "e"), ("e", "c"), ("h", "b"), ("b", "h"), ("i", "l"), ("l", "i"), ("l", "t"), ("t", "l"), ("u", "n"), ("n", "u"), ("o", "a"), ("a", "o"), ("f", "t"), ("t", "f"), ("q", "g"), ("y", "v"), ("v", "y"), ("2", "z"), ("4", "a"), ("$", "s"), ("€", "e"), ("@", "a"), ("(", "c"), ("£", "e"), ("r", "n"), ("í", "i"), ("à", "a"), ("u", "ü"), ("a", "ä"), ("o", "ö"), ("ß", "b"), ("b", "ß"),
    }
)
#: Strings that recognition puts for one character.
SPLIT_UP = (("ri", "n"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("lI", "u"), ("ni", "m"), ("ln", "m"), ("tl", "d"), ("nn", "m"), ("fi", "h"), ("ij", "y"), ("in", "m"), ("iii", "m"), ("m", "rn"), ("m", "nn"), ("d", "cl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"))
DIGIT_LOOKS = str.maketrans("lI|!iOoSsZzBgqDQ", "1111100552289900")
HYPHENS = "-­‐‑¬"
ROMAN = regex.compile(r"^m{0,4}(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})$")
NUMBER_LINE = regex.compile(r"^(?P<left>[\s\[\](){}<>·•|~*=—–\-.]*(?:(?:page|seite|pg|p|s|pag|folio|f)\b[.:]?)?\s*)(?P<n>[\dlI|!iOoSsZzBgqDQ]{1,6}|[ivxlcdmIVXLCDM1|!]{1,12})(?P<right>(?:\s*(?:/|of|von|de|sur)\s*[\dlI|!iOoSsZzBgqDQ]{1,6})?[\s\[\](){}<>·•|~*=—–\-.]*)$", regex.I)
WORD_END = regex.compile(r"(\p{L}[^\s" + HYPHENS + r"]*)[" + HYPHENS + r"]\s*$")
EDGE_PUNCTUATION = ".,;:?\"'“”„‘’«»()[]{}…!"
LEADING = EDGE_PUNCTUATION.replace("!", "")
NAME_LINE = regex.compile(r"^(?:(?:\p{L}[.,:·]|\p{L}) ?\p{Lu}[\p{L}\d.|!]{3,}|(?!\d+ )\p{Lu}\S{1,2} \p{Lu}[\p{L}\d|!]{3,})(?:\s{2,}\S{1,5})?$")
FILE_LIKE = regex.compile(r"^[\w\-]+(?:\.\w+)+$|^[\p{Lu}\d]+-\d+$|\d.*\d|^v\d|[@/\\_=]")


#: Transitions of the automata, which do not depend on the text: a state, the places in its row that the character stands at, and where the text begins and ends in it.
_STEPS: dict[tuple[tuple[int, ...], int, int, int], tuple[int, ...] | None] = {}


def _step(row: tuple[int, ...], equal: int, first: int, inside: int) -> tuple[int, ...] | None:
    """The row after one more character, or None where no distance is left within k; the row's places are those of the prefixes from ``first`` on, ``inside`` of them within the text."""
    width = len(row)
    k = width // 2
    far = left = k + 1
    new = []
    for t in range(width):
        if first + t > 0 and t < inside:
            v = row[t] + (not equal >> t & 1)
            if t + 1 < width and row[t + 1] < v:
                v = row[t + 1] + 1
            if left < v:
                v = left + 1
            left = v if v < far else far
        else:
            left = first + k if first + t == 0 and first <= 0 else far
        new.append(left)
    return tuple(new) if min(new) <= k else None


class Vocabulary:
    """Words as a trie, and all of them within a distance of a given string."""

    def __init__(self, words):
        self.words = frozenset(w for w in words if w)
        self.root: dict = {}
        for w in self.words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w
        #: Shortest and longest rest of a word below each node.
        self.depths: dict[int, tuple[int, int]] = {}
        self._measure(self.root)
        self.longest = max(map(len, self.words), default=0)
        self.memory: dict[tuple[str, bool], tuple[tuple[float, str], ...]] = {}

    def _measure(self, root: dict) -> None:
        order, at = [root], 0
        while at < len(order):
            order.extend(below for ch, below in order[at].items() if ch)
            at += 1
        for node in reversed(order):
            rests = [(0, 0) if not ch else tuple(d + 1 for d in self.depths[id(below)]) for ch, below in node.items()] or [(0, 0)]
            self.depths[id(node)] = min(lo for lo, _ in rests), max(hi for _, hi in rests)

    def goes_on(self, start: str) -> bool:
        """Whether some word begins so and goes on without a hyphen."""
        node = self.root
        for ch in start:
            node = node.get(ch)
            if node is None:
                return False
        return bool(start) and any(ch not in ("", "-") for ch in node)

    def within(self, text: str, k: int, slack: int | None = None) -> list[tuple[int, str]]:
        """(distance, word) for every word within ``k`` edits (and of a length within ``slack``): the automaton's state is the row of distances to the prefixes of ``text`` that are at most k shorter or longer than what was read, cut off at k + 1; the trie is walked as far as a state is alive and a word of fitting length lies below."""
        n, width, far = len(text), 2 * k + 1, k + 1
        least, most = n - (k if slack is None else slack), n + (k if slack is None else slack)
        places: dict[str, int] = {}
        for j, ch in enumerate(text):
            places[ch] = places.get(ch, 0) | 1 << j
        found: list[tuple[int, str]] = []
        stack = [(self.root, 0, tuple(t - k if k <= t <= n + k else far for t in range(width)))]
        full = (1 << width) - 1
        while stack:
            node, read, row = stack.pop()
            first = read + 1 - k  # the prefix that the new row begins with
            inside = min(width, n - first + 1)
            for ch, below in node.items():
                if ch == "":
                    t = n - read + k
                    if 0 <= t < width and row[t] <= k and least <= read <= most:
                        found.append((row[t], below))
                    continue
                shortest, longest = self.depths[id(below)]
                if read + 1 + longest < least or read + 1 + shortest > most:
                    continue
                at = places.get(ch, 0)
                equal = (at >> first - 1 if first > 0 else at << 1 - first) & full
                key = row, equal, first if first < 1 else 1, inside
                state = _STEPS.get(key, 0)
                if state == 0:
                    state = _STEPS[key] = _step(*key)
                if state is not None:
                    stack.append((below, read + 1, state))
        return found

    def folded(self, text: str) -> list[str]:
        """Words reached by undoing one or two strings put for single characters, with or without a confused character."""
        out, seen = [], {text}
        level = [text]
        for _ in range(2):
            after = []
            for t in level:
                for seen_as, meant in SPLIT_UP:
                    at = t.find(seen_as)
                    while at >= 0:
                        new = t[:at] + meant + t[at + len(seen_as) :]
                        if new not in seen:
                            seen.add(new)
                            after.append(new)
                            if new in self.words:
                                out.append(new)
                        at = t.find(seen_as, at + 1)
            level = after
        return out

    def candidates(self, text: str, name: bool) -> tuple[tuple[float, str], ...]:
        """All readings of a word outside the vocabulary with their cost, the least first, remembered.

        Up to ``FREE`` a confusion explains it, or one other edit of a longer word; beyond, nothing does.  ``name``: it may be a name (a capital within a sentence), so that only confusions explain it."""
        if len(text) > self.longest + 4:
            return ()
        key = (text, name)
        if key not in self.memory:
            if len(self.memory) > 200_000:
                self.memory.clear()
            out: dict[str, float] = dict.fromkeys(self.folded(text), 0.6)
            # confusions that explain a name keep its length, apart from those undone above
            for distance, w in self.within(text, 1 if len(text) < (6 if name else 4) else 2, 0 if name else None):
                cost = _cost(text, w)
                if cost is None or len(text) < 6 and distance > 1:
                    cost = FREE if not name and distance == 1 and len(text) > 4 else FREE + distance
                out[w] = min(cost, out.get(w, 9.0))
            self.memory[key] = tuple(sorted((c, w) for w, c in out.items()))
        return self.memory[key]

    def reading(self, text: str, name: bool, beside: Beside | None = None, before: str = "", after: str = "") -> str | None:
        """The best reading of a word outside the vocabulary beside its neighbours."""
        found = self.candidates(text, name)
        if beside is None or not found:
            return found[0][1] if found and found[0][0] <= FREE else None
        if found[0][0] <= FREE and (len(found) == 1 or found[1][0] > FREE + 1):
            return found[0][1]
        ranked = []
        both = not name and before in self.words and after in self.words
        for cost, w in found:
            if cost > FREE and not both:
                break
            left, right = beside.documents(w, before, after)
            if cost <= FREE or left and right:
                ranked.append((cost - EVIDENCE * math.log((1 + left) * (1 + right)), -beside.near[w], w))
        return min(ranked)[2] if ranked else None


class Pairs:
    """Documents by pair of words: the pairs as ascending numbers."""

    def __init__(self, words: list[str], numbers: array, documents: array):
        self.words, self.numbers, self.documents = words, numbers, documents

    @functools.cached_property
    def places(self) -> dict[str, int]:
        return {w: k for k, w in enumerate(self.words)}

    def __len__(self) -> int:
        return len(self.numbers)

    def get(self, pair: tuple[str, str], default: int = 0) -> int:
        a, b = map(self.places.get, pair)
        if a is None or b is None:
            return default
        number = a * len(self.words) + b
        at = bisect_left(self.numbers, number)
        return self.documents[at] if at < len(self.numbers) and self.numbers[at] == number else default


class Asked:
    """In the place of counts: notes the pairs that are asked for."""

    def __init__(self):
        self.pairs: set[tuple[str, str]] = set()

    def get(self, pair: tuple[str, str], default: int = 0) -> int:
        self.pairs.add(pair)
        return default


class Beside:
    """What is known of the words beside a word: documents by pair, and the words of the window."""

    def __init__(self, pairs: dict[tuple[str, str], int] | Pairs | Asked, near: Counter):
        self.pairs, self.near = pairs, near

    def documents(self, word: str, before: str, after: str) -> tuple[int, int]:
        """Documents in which the word stands after ``before``, and before ``after``."""
        return self.pairs.get((before, word), 0), self.pairs.get((word, after), 0)


def _cost(seen: str, meant: str) -> float | None:
    """Cost of confusions only, or None where another edit would be needed."""
    if len(seen) == len(meant):
        cost = 0.0
        for x, y in zip(seen, meant):
            if x != y:
                if (x, y) in CONFUSED:
                    cost += 0.5
                elif not x.isalpha() and y.isalpha():
                    cost += 0.7
                else:
                    return None
        return cost
    return None


LETTER_LIKE = regex.compile(r"[^\W\d]")
NO_LETTERS = regex.compile(r"[^\p{L}]+")
LOOKS = str.maketrans("01|!59", "olllsg")


def _key(line: str) -> str:
    """A line as it recurs: letters only, lower case, digits within words as the letters they look like."""
    words = [w for w in line.split() if w.isalpha() or LETTER_LIKE.search(w)]
    text = "".join(words).lower()
    return text if text.isalpha() else NO_LETTERS.sub("", text.translate(LOOKS))


@functools.lru_cache(maxsize=20_000)
def _letters(text: str) -> Counter:
    return Counter(text)


def _near(a: str, b: str) -> bool:
    """Within a quarter of the length in edits."""
    if a == b:
        return True
    most = max(1, max(len(a), len(b)) // 4)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = _letters(a), _letters(b)
    if max((x - y).total(), (y - x).total()) > most:  # a lower bound of the edits
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def _roman(text: str) -> int | None:
    t = text.lower()
    if not t or not ROMAN.match(t):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total = 0
    for ch, after in zip(t, t[1:] + " "):
        v = value[ch]
        total += -v if value.get(after, 0) > v else v
    return total


def _number(line: str) -> tuple[str, int | None, frozenset[int]] | None:
    """(form, arabic reading, roman readings) of a line that bears only a number."""
    m = NUMBER_LINE.match(line.strip())
    if not m:
        return None
    n = m["n"]
    looks = n.translate(DIGIT_LOOKS)
    arabic = int(looks) if looks.isdigit() and (n.isdigit() or any(c.isdigit() for c in n) or len(n) == 1 or m["left"].strip()) else None
    roman = frozenset(r for r in (_roman(n), _roman(regex.sub(r"[1|!]", "i", n)), _roman(regex.sub(r"[1|!l]", "i", n))) if r is not None)
    if arabic is None and not roman:
        return None
    form = regex.sub(r"\s+", " ", m["left"].strip().lower()) + "#" + regex.sub(r"[\dliosz|!]+", "9", regex.sub(r"\s+", " ", m["right"].strip().lower()))
    return form, arabic, roman


def _title(line: str) -> bool:
    """A line of four words or more, nearly all with capitals, without a closing mark."""
    words = [w for w in regex.findall(r"[\p{L}\d!|]+", line) if len(w) > 3 and regex.search(r"\p{L}", w)]
    return len(line) <= 90 and len(line.split()) > 3 and len(words) > 2 and line[-1:] not in ".!?,;:" and sum(w[0].isupper() or not w[0].isalpha() for w in words) >= 0.85 * len(words)


class Line:
    __slots__ = ("page", "block", "no", "text", "kind", "edge", "side", "outer")

    def __init__(self, page, block, no, text):
        self.page, self.block, self.no, self.text, self.kind, self.edge, self.side = page, block, no, text, "", 0, 0


def _edges(full: list) -> list[tuple[int, int, int]]:
    """(index, distance from the edge from 1, side) of the first and last ``DEEP`` of the lines of a page."""
    n = len(full)
    near = {*range(min(DEEP, n)), *range(max(0, n - DEEP), n)}
    return [(k, min(k, n - 1 - k) + 1, 0 if k < n - 1 - k else 1) for k in sorted(near)]


def _furniture(pages: dict[int, list[Line]], elsewhere: dict[str, int]) -> None:
    """Mark running headers and page numbers; ``elsewhere``: on how many pages of the document a key stands at an edge, where some are in other windows."""
    edges: list[Line] = []
    deeper: list[tuple[int, Line]] = []
    for lines in pages.values():
        full = [x for x in lines if x.text.strip()]
        for k, distance, side in _edges(full):
            x = full[k]
            if distance <= EDGE:
                x.edge, x.side = distance, side
                edges.append(x)
            else:
                deeper.append((distance, x))
                x.outer = full[:k] if side == 0 else full[k + 1 :]
    # page numbers: the distance from the page's place is constant
    numbers = [(x, _number(x.text)) for x in edges]
    numbers = [(x, n) for x, n in numbers if n]
    votes: dict = defaultdict(set)
    for x, (form, arabic, roman) in numbers:
        if arabic is not None:
            votes["a", arabic - x.page].add(x.page)
        for r in roman:
            votes["r", r - x.page].add(x.page)
    if votes:
        (kind, distance), voters = max(votes.items(), key=lambda v: (len(v[1]), -abs(v[0][1])))
        forms: Counter = Counter()
        taken = set()

        def fits(x, n):
            return n[1] is not None and n[1] - x.page == distance if kind == "a" else distance + x.page in n[2]

        for x, n in numbers:
            if fits(x, n):
                forms[n[0]] += 1
        form = forms.most_common(1)[0][0] if forms else None
        if len(voters) > 1 or len(pages) < 3 and (form != "#" or distance == 0):
            for x, n in sorted(numbers, key=lambda v: v[0].edge):
                if fits(x, n) and x.page not in taken and (n[0] == form or forms[n[0]] > 1 or x.edge == 1):
                    x.kind = "page_number"
                    taken.add(x.page)
            for x, n in sorted(numbers, key=lambda v: v[0].edge):
                if x.page not in taken and n[0] == form and form != "#" and x.edge == 1:
                    x.kind = "page_number"
                    taken.add(x.page)
    # running headers: edge lines that recur on other pages
    heads = [(x, _key(x.text)) for x in edges if not x.kind]
    heads = [(x, k) for x, k in heads if len(k) >= 5]
    exact: dict[str, set] = defaultdict(set)
    shown: dict[str, str] = {}
    for x, k in heads:
        exact[k].add(x.page)
        shown.setdefault(k, x.text.strip())
    recurring = lambda k, on: max(len(on), elsewhere.get(k, 0))
    long = {k for k in exact if len(shown[k]) > LONG}
    for x, k in heads:
        if k in long and recurring(k, exact[k]) >= OFTEN:
            x.kind = "header"
    heads = [(x, k) for x, k in heads if k not in long]
    for k in long:
        del exact[k]
    far = {k: {f"elsewhere {n}" for n in range(elsewhere.get(k, 0) - len(on))} for k, on in exact.items()}
    exact = {k: on | far[k] for k, on in exact.items()}
    leaders: list[tuple[str, set]] = []
    for k, on in sorted(exact.items(), key=lambda v: -len(v[1])):
        if not regex.match(r"^[\W\d]*\p{Lu}", shown[k]) and len(on) < 3:
            leader = None
        else:
            leader = k
        for known, seen in leaders:
            if _near(k, known):
                seen |= on
                break
        else:
            if leader and not (shown[k][-1] in ".!?" and len(on) < 3):
                leaders.append((k, set(on)))
    names = [k for k, seen in leaders if len(seen) > 1]
    for x, k in heads:
        if any(_near(k, n) for n in names):
            x.kind = "header"
    # further lines beside furniture that recur letter by letter
    again: dict[str, set] = defaultdict(set)
    for _, x in deeper:
        again[_key(x.text)].add(x.page)
    for _, x in sorted(deeper, key=lambda v: v[0]):
        k = _key(x.text)
        if len(k) >= 5 and recurring(k, again[k]) >= OFTEN and all(y.kind for y in x.outer):
            x.kind = "header"
    # a header that occurs on one page only: a name or a title at the very edge of a page that has none
    with_header = {x.page for x, _ in heads if x.kind}
    numbered = {(x.page, x.side) for x, _ in numbers if x.kind and x.edge == 1}
    for x, _ in heads:
        text = x.text.strip()
        if x.page not in with_header and x.edge <= 1 + ((x.page, x.side) in numbered) and (NAME_LINE.match(text) or len(pages) > 1 and _title(text)):
            x.kind = "header"
            with_header.add(x.page)


def _clean(token: str) -> str:
    return token.rstrip(EDGE_PUNCTUATION).lstrip(LEADING)


def _defects(body: list[Line], vocabulary: Vocabulary, whole: Counter, beside: Beside, suffixes: frozenset[str]) -> tuple[dict, dict]:
    """Hyphen and misread marks of body lines, and the repaired text of each line.

    Returns {index: kinds} and {index: repaired tokens}."""
    words = vocabulary.words
    asking = isinstance(beside.pairs, Asked)  # then no reading is settled, so that each further one that may be tried is asked for as well
    kinds: dict[int, set] = defaultdict(set)
    joined: dict[int, tuple[str, str, bool]] = {}
    for k, line in enumerate(body):
        tail = line.text.rstrip()
        m = WORD_END.search(tail.rsplit(None, 1)[-1]) if tail[-1:] in HYPHENS else None
        if not m:
            continue
        left = m[1]
        token = line.text.rstrip().rsplit(None, 1)[-1].rstrip(HYPHENS).lstrip(LEADING)
        after = body[k + 1].text.split(None, 1)[0] if k + 1 < len(body) and body[k + 1].text.strip() else ""
        right = after.rstrip(EDGE_PUNCTUATION)
        kinds_of = _joins(token or left, right, vocabulary, whole, suffixes)
        joined[k] = (right, after[len(right) :], kinds_of)
        if kinds_of:
            kinds[k].add("hyphen")
    repaired: dict[int, list[str]] = {}

    def neighbour(k: int, i: int, step: int) -> str:
        """The word before (-1) or after (1) token i of line k, beyond the line's edge that of the line beside."""
        tokens = body[k].text.split()
        if not 0 <= i + step < len(tokens):
            k += step
            if not 0 <= k < len(body):
                return ""
            tokens = body[k].text.split()
            i = len(tokens) if step < 0 else -1
        return _clean(tokens[i + step]).lower()

    def read(text: str, name: bool, k: int, i: int, cut_off: bool = False) -> str | None:
        if not vocabulary.candidates(text, name):
            return None
        after = neighbour(k + 1, 0, 1) if cut_off and k + 1 < len(body) else neighbour(k, i, 1)
        meant = vocabulary.reading(text, name, beside, neighbour(k, i, -1), after)
        return None if asking else meant

    for k, line in enumerate(body):
        tokens = line.text.split()
        out = []
        for i, token in enumerate(tokens):
            head = k - 1 in joined and i == 0
            tail = k in joined and i == len(tokens) - 1
            if head and joined[k - 1][0]:
                out.append("")
                continue  # judged with the line before
            core = _clean(token)
            if tail:
                right, rest, glue = joined[k]
                left = token.rstrip(HYPHENS).lstrip(LEADING)
                before = token[: len(token.rstrip(HYPHENS)) - len(left)]
                seam = "" if glue else "-"
                full = left + seam + right
                low = full.lower()
                fine = low in words or not glue and left.lower() in words and all(p in words for p in right.lower().split("-"))
                meant = None if fine or len(low) < 3 else read(low, _capital(full), k, i, bool(right))
                if meant:
                    n, m = len(left), len(low) - len(left) - len(seam)
                    if low[:n] != meant[:n]:
                        kinds[k].add("misread")
                    if low[n + len(seam) :] != meant[len(meant) - m :] and k + 1 < len(body):
                        kinds[k + 1].add("misread")
                out.append(before + (_cased(full, meant) if meant else full if right else token) + rest)
                continue
            low = core.lower()
            if len(low) < 2 or low in words or FILE_LIKE.search(core) or core.isdigit():
                out.append(token)
                continue
            meant = None
            if "-" in core and all(p.lower() in words or not p for p in core.split("-")):
                out.append(token)
                continue
            capital = _capital(core)
            meant = read(low, capital, k, i)
            if meant is None and token.lower().rstrip(".,;:?\"'“”‘’»)]}…") != low:
                trailing = token.lower().strip(".,;:?\"'“”„‘’«»()[]{}…")
                if trailing not in words and any(c in "!" for c in trailing[:-1]):
                    meant = read(trailing, capital, k, i)
            if meant is None and "-" in core and not core.startswith("-"):
                parts = core.split("-")
                reads = [p if p.lower() in words else read(p.lower(), True, k, i) if len(p) > 3 else None for p in parts]
                if all(reads) and not core[:1].isupper():
                    meant = "-".join(reads).lower()
            if meant is None or whole[core] > 3 and core[:1].isupper() and core[1:].islower() and core.isalpha():
                out.append(token)
            else:
                kinds[k].add("misread")
                out.append(token.replace(core, _cased(core, meant), 1))
        repaired[k] = out
    return kinds, repaired


def _capital(core: str) -> bool:
    """Whether the word may be a name: capitalised, but not in capitals throughout; also at a sentence's start, where names stand as well."""
    return core[:1].isupper() and not core.isupper()


def _cased(seen: str, meant: str) -> str:
    return meant[:1].upper() + meant[1:] if seen[:1].isupper() else meant


def _joins(left: str, right: str, vocabulary: Vocabulary, whole: Counter, suffixes: frozenset[str]) -> bool:
    """Whether the line ended within a word that has no hyphen there; ``suffixes``: small words that stand after a name and a hyphen within lines."""
    words = vocabulary.words
    a, b = left.lower(), right.lower()
    if not b:
        return vocabulary.goes_on(a)
    if not regex.match(r"\p{L}|[|!15+ſ]", b):
        return False
    if a + b in words:
        return True
    if a + "-" + b in words:
        return False
    plain, hyphened = whole[left + right], whole[left + "-" + right]
    if plain or hyphened:
        return plain >= hyphened
    if right[:1].isupper() and not left.isupper():
        return False
    known = lambda t: t in words
    if known(a) and known(b) and not vocabulary.reading(a + b, True):
        return False
    if vocabulary.reading(a + b, True):
        return True
    first = regex.split("-", b)[0]
    if vocabulary.reading(a + "-" + b, True) or (known(a) and known(first)):
        return False
    return not (left[:1].isupper() and b in suffixes)


def _read(pdf: pd.DataFrame) -> tuple[list[Line], dict]:
    """Lines in order; redelivered blocks once. Also the rows of each distinct block."""
    rows: dict = defaultdict(list)
    order = pdf.sort_values(["page", "block_order", "block_row"], kind="stable")
    blocks = []
    for r in order.itertuples(index=False):
        at = (r.page, r.block_order, r.text)
        if at not in rows:
            blocks.append(at)
        rows[at].append(r.block_row)
    lines = [Line(at[0], at, no, text) for at in blocks if at[2] for no, text in enumerate(at[2].split("\n"))]
    return lines, rows


def _repair(pdf: pd.DataFrame, elsewhere: dict[str, int], vocabulary: Vocabulary, pairs: dict[tuple[str, str], int] | Pairs | Asked, suffixes: frozenset[str]):
    lines, rows = _read(pdf)
    pages: dict[int, list[Line]] = defaultdict(list)
    for x in lines:
        pages[x.page].append(x)
    _furniture(pages, elsewhere)
    body = [x for x in lines if x.text.strip() and not x.kind]
    whole: Counter = Counter(t for x in body for t in map(_clean, x.text.split()) if len(t) > 3)
    near: Counter = Counter(_clean(t).lower() for x in body for t in x.text.split())
    kinds, repaired = _defects(body, vocabulary, whole, Beside(pairs, near), suffixes)
    return lines, rows, body, kinds, repaired


#: Windows of blocks without a page number count down from here.
PAGELESS = -(1 << 40)


def _window_of(page: Column, order: Column) -> Column:
    return F.when(page.isNull(), F.lit(PAGELESS) - F.floor(F.coalesce(order, F.lit(0)) / 512)).otherwise(F.floor(page / PAGES)).cast("long")


def _near_windows(page: Column, own: Column) -> Column:
    """The window of a page, and the one beside in whose margin it lies."""
    place = F.pmod(page, F.lit(PAGES))
    return F.when(page.isNull(), F.array(own)).otherwise(F.array_compact(F.array(own, F.when(place < MARGIN, own - 1), F.when(place >= PAGES - MARGIN, own + 1))))


def _windows(blocks: DataFrame) -> DataFrame:
    """Blocks with their window; those in a margin also as context of the window beside."""
    own = _window_of(F.col("page_number"), F.col("block_order"))
    rows = blocks.where("block_row is not null and text is not null").select("block_row", "document_id", F.coalesce("page_number", F.lit(0)).alias("page"), F.coalesce("block_order", F.lit(0)).alias("block_order"), "text", own.alias("own"), F.explode(_near_windows(F.col("page_number"), own)).alias("window"))
    return rows


def _recurring(blocks: DataFrame) -> DataFrame:
    """``document_id``, ``window``, ``key``, ``pages``: keys of lines at the edges of blocks that stand on several pages of a document, for every window that doesn't see all of these pages.

    Edges of blocks take in those of pages; only small keys are shuffled."""

    def run(batches):
        for batch in batches:
            out = []
            for document, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [t for t in text.split("\n") if t.strip()]
                out.extend((document, page, k) for k in {_key(lines[i]) for i, _, _ in _edges(lines)} if len(k) >= 5)
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], ["document_id", "page", "key"])

    paged = blocks.where("block_row is not null and text is not null and page_number is not null").select("document_id", F.col("page_number").cast("int").alias("page"), "text")
    keys = paged.mapInArrow(run, "document_id string, page int, key string").distinct()
    own = F.floor(F.col("page") / PAGES).cast("long")
    seen = keys.select("document_id", "key", "page", F.explode(_near_windows(F.col("page"), own)).alias("window"), own.alias("own"))
    by_window = seen.groupBy("document_id", "key", "window").agg(F.count("*").alias("here"), F.count_if(F.col("window") == F.col("own")).alias("inside"))
    whole = Window.partitionBy("document_id", "key")
    return by_window.withColumn("pages", F.sum("inside").over(whole)).where((F.col("pages") > F.col("here")) & (F.col("inside") > 0)).select("document_id", "window", "key", F.col("pages").cast("int").alias("pages"))


def read_vocabulary(words: DataFrame, column: str = "word") -> list[str]:
    """A vocabulary of proven size."""
    got = [r[0] for r in words.select(F.lower(column)).where(F.col(column).isNotNull()).distinct().limit(VOCABULARY_WORDS + 1).collect()]
    if len(got) > VOCABULARY_WORDS:
        raise ValueError(f"the vocabulary has more than {VOCABULARY_WORDS} words")
    return got


def _pairs(blocks: DataFrame, words: list[str]) -> DataFrame:
    """``a``, ``b``, ``n``: in how many documents two words of the vocabulary stand side by side; with their places ``i`` and ``j`` in ``words``, which are distinct."""
    edge = "[" + regex.escape(EDGE_PUNCTUATION) + "]+"
    tokens = F.split(F.regexp_replace(F.lower("text"), rf"(?U)(?<=\s|^){edge}|{edge}(?=\s|$)", ""), r"(?U)\s+")
    listed = blocks.where("text is not null").select("document_id", tokens.alias("w"))
    both = listed.select("document_id", F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))).alias("p")).select("document_id", "p.a", "p.b").distinct()
    known = blocks.sparkSession.createDataFrame(list(enumerate(words)), "place long, word string")
    counts = both.groupBy("a", "b").agg(F.count("*").cast("int").alias("n"))
    return counts.join(known.toDF("i", "a"), "a").join(known.toDF("j", "b"), "b")


def read_pairs(blocks: DataFrame, words: list[str]) -> Pairs | None:
    """In how many documents two words of the vocabulary stand side by side, or None if there are more than ``PAIRS_SENT`` such pairs."""
    words = sorted({w for w in words if w})
    got = _pairs(blocks, words).select((F.col("i") * len(words) + F.col("j")).alias("number"), "n").limit(PAIRS_SENT + 1).toArrow()
    if got.num_rows > PAIRS_SENT:
        return None
    got = got.sort_by("number")
    return Pairs(words, array("q", got["number"].to_numpy().tobytes()), array("i", got["n"].to_numpy().tobytes()))


def _suffixes(blocks: DataFrame) -> DataFrame:
    """``w``: small words that stand after a capitalised word and a hyphen within lines."""
    return blocks.where("text is not null").select(F.explode(F.array_distinct(F.expr(r"regexp_extract_all(text, '(?U)\\b\\p{Lu}[\\p{L}\\d]*-(\\p{Ll}{2,})\\b', 1)"))).alias("w")).distinct()


def read_suffixes(blocks: DataFrame) -> list[str] | None:
    """Small words that stand after a capitalised word and a hyphen within lines, or None if there are more than ``SUFFIXES_SENT``."""
    got = [r.w for r in _suffixes(blocks).limit(SUFFIXES_SENT + 1).collect()]
    return got if len(got) <= SUFFIXES_SENT else None


def _line_starts(rows: DataFrame) -> DataFrame:
    """``document_id``, ``window``, ``w``: the words that lines of a window begin with, as ``_joins`` looks them up."""

    def run(batches):
        for batch in batches:
            out = {(document, window, line.split(None, 1)[0].rstrip(EDGE_PUNCTUATION).lower()) for document, window, text in zip(*(c.to_pylist() for c in batch.columns)) for line in text.split("\n") if line.strip()}
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["document_id", "window", "w"])

    return rows.select("document_id", "window", "text").mapInArrow(run, "document_id string, window bigint, w string").distinct()


class _Repairer:
    """The vocabulary of a worker process, built once, and the counts of the corpus, as far as they are sent."""

    built: dict = {}

    def __init__(self, blocks: DataFrame, words: list[str]):
        pairs, suffixes = read_pairs(blocks, words), read_suffixes(blocks)
        self.pairs_sent, self.suffixes_sent = pairs is not None, suffixes is not None
        self.shared = blocks.sparkSession.sparkContext.broadcast((words, pairs, None if suffixes is None else frozenset(suffixes)))

    def repair(self, pdf: pd.DataFrame, about: pd.DataFrame, asked: Asked | None = None):
        """``about``: what is known of the window (``what`` key, pair or suffix); ``asked`` takes the pairs that its readings ask for."""
        _, pairs, suffixes = self.shared.value
        known: dict[str, list] = {"key": [], "pair": [], "suffix": []}
        for r in about.itertuples(index=False):
            known[r.what].append(r)
        if asked is not None:
            pairs = asked
        elif pairs is None:
            pairs = {(r.key, r.after): r.n for r in known["pair"]}
        if suffixes is None:
            suffixes = frozenset(r.key for r in known["suffix"])
        return _repair(pdf, {r.key: r.n for r in known["key"]}, self.vocabulary(), pairs, suffixes)

    def vocabulary(self) -> Vocabulary:
        words = self.shared.value[0]
        if id(words) not in self.built:
            self.built.clear()
            self.built[id(words)] = Vocabulary(words)
        return self.built[id(words)]


def _about(what: str, rows: DataFrame, key: str, after: Column, n: Column) -> DataFrame:
    return rows.select("document_id", "window", F.lit(what).alias("what"), F.col(key).alias("key"), after.alias("after"), n.alias("n"))


def _by_window(blocks: DataFrame, words: list[str], repairer: _Repairer, run, schema: str) -> DataFrame:
    """``run`` over the blocks of every window, with the keys that recur beyond it, and with its pairs and suffixes if those of all windows are too many to be sent."""
    rows = by_keys(_windows(blocks), "document_id", "window")
    windows = rows.groupBy("document_id", "window")
    nothing, none = F.lit(None).cast("string"), F.lit(0)
    about = _about("key", _recurring(blocks), "key", nothing, F.col("pages"))
    if not repairer.suffixes_sent:
        about = about.unionByName(_about("suffix", _line_starts(rows).join(_suffixes(blocks), "w", "left_semi"), "w", nothing, none))
    if not repairer.pairs_sent:

        def ask(pdf: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
            asked = Asked()
            if (pdf.own == pdf.window).any():
                repairer.repair(pdf, about, asked)
            known = repairer.vocabulary().words
            out = [(pdf.document_id.iloc[0], pdf.window.iloc[0], a, b) for a, b in asked.pairs if a in known and b in known]
            return pd.DataFrame(out, columns=["document_id", "window", "a", "b"])

        asked = windows.cogroup(about.groupBy("document_id", "window")).applyInPandas(ask, "document_id string, window bigint, a string, b string")
        counted = asked.join(_pairs(blocks, sorted({w for w in words if w})).select("a", "b", "n"), ["a", "b"])
        about = about.unionByName(_about("pair", counted, "a", F.col("b"), F.col("n")))
    return windows.cogroup(about.groupBy("document_id", "window")).applyInPandas(run, schema)


def defects(blocks: DataFrame, words: list[str]) -> DataFrame:
    """``block_row``, ``line_no``, ``kind`` of the distinct defects of the lines of scanned blocks."""
    repairer = _Repairer(blocks, words)

    def run(pdf: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        own = set(pdf.block_row[pdf.own == pdf.window])
        out: list[tuple] = []
        if own:
            lines, rows, body, kinds, _ = repairer.repair(pdf, about)
            out = [(r, x.no, x.kind) for x in lines if x.kind for r in rows[x.block] if r in own]
            for k, found in kinds.items():
                out.extend((r, body[k].no, kind) for kind in found for r in rows[body[k].block] if r in own)
        return pd.DataFrame(out, columns=["block_row", "line_no", "kind"])

    return _by_window(blocks, words, repairer, run, "block_row bigint, line_no int, kind string")


HEADING = regex.compile(r"^\d{1,2}(?:\.\d+)* \p{Lu}[^.!?]{1,60}$")
FIGURES = regex.compile(r"^[\d.,%\s|+\-]+$")


def paragraphs(blocks: DataFrame, words: list[str]) -> DataFrame:
    """``document_id``, ``paragraph_no`` (ascending, not dense), ``first_page``, ``text``: the repaired, reflowed paragraphs."""
    repairer = _Repairer(blocks, words)
    columns = ["document_id", "paragraph_no", "first_page", "text"]

    def run(pdf: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        if not (pdf.own == pdf.window).any():
            return pd.DataFrame([], columns=columns)
        lines, _, body, _, repaired = repairer.repair(pdf, about)
        place = {id(x): k for k, x in enumerate(body)}
        out: list[list] = []
        gap, last = True, None
        for x in lines:
            if x.kind:
                continue
            text = x.text.strip()
            if not text:
                gap = gap or last is None or last.page == x.page
                continue
            alone = bool(HEADING.match(text) or FIGURES.match(text))
            fresh = last is None or alone or gap and (last.page == x.page or regex.search(r"[.!?:“”»)]\s*$", last.text)) or x.text.startswith("  ") or HEADING.match(last.text.strip()) or FIGURES.match(last.text.strip())
            new = " ".join(t for t in repaired[place[id(x)]] if t)
            if fresh:
                out.append([x.page, x.block, new])
            elif new:
                out[-1][2] = f"{out[-1][2]} {new}".strip()
            gap, last = False, x
        own = {(r.page, r.block_order, r.text) for r in pdf.itertuples(index=False) if r.own == r.window}
        window = int(pdf.window.iloc[0])
        kept = [(pdf.document_id.iloc[0], (window - 2 * PAGELESS) * 100_000 + k, page, text) for k, (page, block, text) in enumerate(out) if block in own and text]
        return pd.DataFrame(kept, columns=columns)

    return _by_window(blocks, words, repairer, run, "document_id string, paragraph_no bigint, first_page int, text string")

"""Problem 8: texts that stop before their own end.

Method.  Per source, the lengths of all distinct texts are counted in
characters and in UTF-8 bytes.  A length that far more texts have than the
lengths around it, with hardly any beyond it in the same stretch, is the limit
of a field (byte limits are met to within the bytes of one character).  A text
at such a length that lacks terminal punctuation was cut there; ``unit``,
``limit``, ``at`` (texts at it) and ``expected`` (texts that the lengths
around it let expect) come with it.

Texts cut in transfer stop at any length.  A cutter's mark or a broken form (a
table row without its last cells, a record without its last fields, a code
block without its end) shows them; all others are judged by a classifier of
endings that the spikes teach: texts at a spike without terminal punctuation
are its examples of cut endings, texts at no spike those of the others (the
cut ones among these are told apart in turns, see ``learn``).  It
sees the form of the last line, open quotations and brackets, and how often
the last word ends something against how often it stands before another word,
counted over all distinct texts, as a rate that does not move with their
number.  No last line counts for itself.  The weights are fitted on at most
``TAUGHT`` kinds of endings of either sort; everything else covers all texts.

Cases: null, empty and blank texts are no cases; a null source is a source of
its own and is also held against the limits of all sources; repeated texts
are each reported, but count once in the histogram and for the classifier, so
that copies make no spike; where no source has a spike nothing teaches the
classifier, and only marks and broken forms are reported; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.sentences import INTRODUCE, QUOTES, quote_from
from leafmill.sources.tables import by_keys, cut

#: A spike holds this many distinct texts at least, and this many times the mean of the lengths around it.
SPIKE_TEXTS, SPIKE_TIMES, AROUND = 4, 6, 60
#: Short last lines of dots: texts taken as so many more when the share of one among them is computed.
DOTS_MORE = 8
#: Endings counted in a task's memory; beyond this they are sent on.
ENDINGS_KEPT = 200_000
#: Kinds of endings (equal features) of either label that the classifier is fitted on, and its size.
TAUGHT, DIMENSIONS = 30_000, 1 << 16

BLANK = " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u200e\u200f"
#: What a cutter leaves behind.
CUTTER = regex.compile(r"(?:\[(?:truncated|cut|\.\.\.|…|more)\]|(?:…|\.\.\.)\s*(?:\(more\)|\(continued\)|read (?:on|more)|more)|\(more\)|�+)$", regex.I)
DOTS = regex.compile(r"(?:…|\.\.\.)$")
TERMINAL = regex.compile(r"[.!?…。！？؟।॥][\"'”’»›)）\]】」』“]*$|[.!?。！？؟।॥][\u00a0\u202f ]?»$")
ITEM = regex.compile(r"^[ \t]*(?:[-*•–·▪+]|\(?\d{1,3}[.)]|\(\p{L}\)|\p{L}\))[ \t]+\S")
RECORD = regex.compile(r"^[^:|\n]{1,40}: [^|\n]*(?: \| [^:|\n]{1,40}: [^|\n]*)+$")
FIELDS = regex.compile(r"(?:^| \| )([^:|\n]{1,40}): ")
#: The word that a token ends with.
WORD_TAIL = regex.compile(r"(?<![\p{L}\p{M}\-’'])[\p{L}\p{M}][\p{L}\p{M}\-’']*+$")
THAI = regex.compile(r"[฀-๿]$")
THAI_RUN = regex.compile(r"[฀-๿]{7,}")
THAI_END = regex.compile(r"[฀-๿]{6}(?=[ \t\u00a0\n]+[฀-๿])")
PAIRED = (("(", ")"), ("（", "）"), ("“", "”"), ("«", "»"), ("「", "」"), ("《", "》"))
RUNS = regex.compile(r"(\p{Lu}+)|(\p{Ll}+)|([\p{Lo}\p{Lm}\p{M}]+)|(\p{N}+)")


def _open_pair(paragraph: str) -> bool:
    """A bracket or quotation opened last in the paragraph and not closed."""
    for a, b in PAIRED:
        if paragraph.rfind(a) > paragraph.rfind(b):
            if a != "“" or "„" not in paragraph:
                return True
    return paragraph.count("„") > paragraph.count("“") + paragraph.count("”")


def _shape(token: str) -> str:
    """Runs of capitals, small letters, other letters and digits as A, a, x and 9; everything else as it is."""
    return RUNS.sub(lambda m: "_Aax9"[m.lastindex] if m.lastindex > 1 or len(m[1]) == 1 else "AA", token)[:8]


def _last(text: str) -> str:
    return text.rsplit(None, 1)[-1]


def ending(text: str) -> tuple[str, str, str, list[str]]:
    """(state, kind, word, features) of a text's end.

    States: 'blank', 'mark' (a cutter's mark), 'broken' (a row, record or code block without its end), 'closed' (terminal punctuation) and 'open' (none that ends a sentence); ``word`` is what the counted endings are asked for."""
    body = text.rstrip(BLANK + INVISIBLE)
    if not body:
        return "blank", "", "", []
    above, _, line = body.rpartition("\n")
    raw, line = line, line.strip(BLANK + INVISIBLE)
    above = above.rpartition("\n")[2].strip()
    if CUTTER.search(body):
        return "mark", "mark", "", []
    if "```" in body:
        if body.count("```") % 2:
            return "broken", "code", "", []
        if line.endswith("```"):
            return "closed", "code", "", []
    if line.startswith("|"):
        fewer = line.count("|") < above.count("|") if above.startswith("|") and above.endswith("|") else not above.startswith("|") and regex.search(r"\p{L}", line)  # or a head without its table
        return ("broken", "row", "", []) if not line.endswith("|") or len(line) < 2 or fewer else ("closed", "row", "", [])
    tokens = line.split()
    kind, word, more = "line", _last(line), []
    first = body.lstrip(BLANK + INVISIBLE).partition("\n")[0].strip()
    if DOTS.search(line):
        own = body != line and len(tokens) < 6 and line[:1].isupper()
        kind, word, more = "dots", line if own else "", ["short" if own else "long"]
    elif RECORD.match(first) and (first == body.strip() or RECORD.match(above)):
        value = line.rsplit(": ", 1)[-1] if ": " in line else ""
        if first != body.strip() and FIELDS.findall(first) != FIELDS.findall(line) or not value.strip():
            return "broken", "record", "", []
        kind, word = "record", value.split(" ")[-1]
    elif TERMINAL.search(line):
        word = line.rstrip("\"'”’»›)）]】」』“ \u00a0")
        word = _last(word.rstrip(".")).lower().lstrip("(“„«\"'") if line.endswith(".") and word.rstrip(".").strip() else ""
        closers = len(body) - len(body.rstrip(QUOTES))
        if word in INTRODUCE and (len(word) > 1 or not word.isascii()):
            more.append("abbreviation")
        if closers and quote_from(body, len(body) - closers, body[-closers:]) == "S":
            more.append("remark")  # the report that a remark belongs to is missing
        if _open_pair(body.rpartition("\n\n")[2]):
            more.append("pair")
        # the mark of an abbreviation, of a remark or within brackets isn't the end of the sentence
        return ("open" if more else "closed"), "terminal", "", [f"c{x}" for x in more] or ["cnone"]
    elif ITEM.match(raw):
        kind = "item"
    elif THAI.search(line):
        kind, word = "thai", line[-6:]
    if kind != "dots" and _open_pair(body.rpartition("\n\n")[2]):
        more.append("pair")
    n = len(tokens)
    size = str(n) if n < 5 else "5" if n < 9 else "9"
    shapes = [_shape(t) for t in tokens[-3:]]
    head = tokens[0].lower() if len(tokens[0]) < 20 else ""
    out = [f"k{kind}", f"n{kind}{size}", f"s{kind}|{' '.join(shapes[-2:])}", f"t{kind}|{shapes[-1]}", f"h{head}|{size}", f"hs{head}|{shapes[-1]}", *(f"m{kind}{x}" for x in more)]
    if n < 7:
        out.append(f"w{' '.join(_shape(t) for t in tokens)}")
    if n < 3:
        out.append(f"a{above.lower()[:20]}|{size}")
    return "open", kind, word, out


def endings(text: str) -> set[tuple[str, str]]:
    """Where the words of a text stand: at the end of items, headings, record values and last lines of a paragraph without marks ('line'), the last line of the text left out; before a closing mark ('word'); before another word ('inside', Thai: 'thai inside'); short last lines of dots."""
    out = set()
    lines = text.rstrip(BLANK + INVISIBLE).split("\n")
    for k, line in enumerate(lines[:-1]):
        s = line.strip()
        if not s:
            continue
        if " | " in s and RECORD.match(s):
            out.update(("line", part.rsplit(" ", 1)[-1]) for part in s.split(" | "))
        elif ITEM.match(line) or s[0] == "#" or not lines[k + 1].strip():
            out.add(("line", _last(s)))
    last = lines[-1].strip()
    if DOTS.search(last) and len(last.split()) < 6:
        out.add(("dots", last))
    elif " | " in last and RECORD.match(last):
        out.update(("line", part.rsplit(" ", 1)[-1]) for part in last.split(" | ")[:-1])
    tokens, pairs = set(), set()
    for line in lines:
        found = line.split()
        tokens.update(found)
        pairs.update((x, y[0].isalnum()) for x, y in zip(found, found[1:]))
    for x, goes_on in pairs:
        if goes_on and (x.isalpha() or (m := WORD_TAIL.search(x)) and (x := m[0])):
            out.add(("inside", x))
    for x in tokens:
        x = x.rstrip("\"”’»)")
        if x and x[-1] in ".!?" and (m := WORD_TAIL.search(x[:-1])):
            out.add(("word", m[0]))
    if THAI_END.search(text):
        out.update(("line", e) for e in THAI_END.findall(text))
    for run in THAI_RUN.findall(text):
        out.update(("thai inside", run[k : k + 6]) for k in range(len(run) - 6))
    return out


def canonical_source(source):
    """Lower case, '_' for blank and '-', trimmed."""
    return F.regexp_replace(F.lower(F.trim(source)), "[ -]", "_")


_ROWS = "doc_id bigint, source string, chars int, bytes int, print bigint, state string, kind string, word string, features string, n bigint"


def _inspect(batches):
    """A row for each text."""
    names = [f.split()[0] for f in _ROWS.split(", ")]
    for batch in batches:
        ids, sources, prints, texts = (batch.column(k) for k in range(4))
        values = texts.to_pylist()
        found = [ending(t) if t else ("blank", "", "", []) for t in values]
        chars = [len(t) if t else 0 for t in values]
        sizes = [len(t.encode()) if t else 0 for t in values]
        states, kinds, words, features = ([f[k] for f in found] for k in range(4))
        columns = [ids, sources, pa.array(chars, pa.int32()), pa.array(sizes, pa.int32()), prints, *(pa.array(c, pa.string()) for c in (states, kinds, words, ["\x1f".join(f) for f in features])), pa.array([0] * len(values), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names)


def _count(batches):
    """In how many texts each of the endings occurs; emptied at a fixed size."""
    seen: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "word", "n"])

    for batch in batches:
        for t in batch.column(0).to_pylist():
            seen.update(endings(t))
            if len(seen) > ENDINGS_KEPT:
                yield rows()
                seen.clear()
    yield rows()


def inspect(docs: DataFrame) -> DataFrame:
    """One row a document, with the state of its end, and rows with state 'seen' that count the distinct texts with an ending; written once, used several times."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), canonical_source(F.col("source")).alias("source"), F.xxhash64("text").alias("print"), "text")
    # copies are put together before the shuffle, so that a text with many copies is no large partition
    distinct = by_keys(rows.where("text != ''").groupBy("print").agg(F.first("text").alias("text")), "print").select("text")
    seen = distinct.mapInArrow(_count, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    seen = seen.select(*(F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _ROWS.split(", ")[:5])), F.lit("seen").alias("state"), "kind", "word", F.lit(None).cast("string").alias("features"), "n")
    return cut(rows.mapInArrow(_inspect, _ROWS).unionByName(seen))


def spikes(rows: DataFrame) -> DataFrame:
    """(source, unit, limit, at, expected): lengths at which a source's texts pile up, the texts at it and those that the lengths around it let expect."""
    texts = rows.where(~F.col("state").isin("blank", "seen")).select(F.coalesce("source", F.lit("")).alias("source"), "chars", "bytes", "print").dropDuplicates(["source", "chars", "bytes", "print"])
    counts = texts.select("source", F.explode(F.map_from_arrays(F.array(F.lit("char"), F.lit("byte")), F.array("chars", "bytes"))).alias("unit", "size")).groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source", "unit").orderBy("size")
    near = by.rangeBetween(-AROUND, AROUND)
    beyond = by.rangeBetween(1, AROUND)
    tip = by.rangeBetween(-3, 0)
    stats = counts.select(
        "*", F.sum("n").over(near).alias("near"), F.coalesce(F.sum("n").over(beyond), F.lit(0)).alias("beyond"), F.sum("n").over(tip).alias("tip"), F.max("n").over(by.rangeBetween(-3, 3)).alias("best")
    )
    pile = F.when(F.col("unit") == "byte", F.col("tip")).otherwise(F.col("n"))
    rest = (F.col("near") - pile) / (2 * AROUND) * F.when(F.col("unit") == "byte", 4).otherwise(1)
    return stats.where((F.col("n") == F.col("best")) & (pile >= SPIKE_TEXTS) & (pile > SPIKE_TIMES * rest) & (F.col("beyond") < pile)).select("source", "unit", F.col("size").alias("limit"), pile.alias("at"), F.round(rest, 3).alias("expected"))


def _at_limits(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """``docs`` with the spike that each lies at, or null: that of its source before that of all, characters before bytes."""
    pooled = limits.groupBy("unit", "limit").agg(F.max("at").alias("at"), F.max("expected").alias("expected")).select(F.lit("").alias("source"), "unit", "limit", "at", "expected")
    named = limits.where("source <> ''").unionByName(pooled)
    reached = named.select("source", F.struct((F.col("unit") == "byte").alias("second"), "unit", "limit", "at", "expected").alias("spike"), F.explode(F.when(F.col("unit") == "byte", F.sequence(F.col("limit") - 3, F.col("limit"))).otherwise(F.array("limit"))).alias("size"))
    lengths = docs.select(F.coalesce("source", F.lit("")).alias("source"), "chars", "bytes").distinct()
    hit = lengths.join(reached, "source").where(F.col("size") == F.when(F.col("spike.unit") == "byte", F.col("bytes")).otherwise(F.col("chars")))
    hit = hit.groupBy(F.col("source").alias("s"), F.col("chars").alias("hc"), F.col("bytes").alias("hb")).agg(F.min("spike").alias("spike"))
    return docs.join(hit, (F.coalesce(docs.source, F.lit("")) == hit.s) & (docs.chars == hit.hc) & (docs.bytes == hit.hb), "left").drop("s", "hc", "hb")


def _with_words(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """``docs`` with what the counted endings say of their last word added to their features."""
    sums = [F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))).alias(name) for name, kinds in (("ends", ("line", "word")), ("inside", ("inside", "thai inside")), ("same", ("dots",)))]
    words = seen.groupBy("word").agg(*sums).withColumnRenamed("word", "w")
    dots = seen.where(F.col("kind") == "dots").agg(F.sum("n").alias("dots"))
    asked = docs.where("word <> ''").join(words, F.col("word") == F.col("w"), "left").crossJoin(F.broadcast(dots))  # one row
    ends, inside = F.coalesce("ends", F.lit(0)), F.coalesce("inside", F.lit(0))
    odds = F.least(F.lit(4), F.greatest(F.lit(-4), F.round(F.log2((ends + 0.5) / (inside + 0.5))))).cast("int")
    known = F.when(ends + inside == 0, "none").when(ends == 0, "inside").when(inside == 0, "end").otherwise("both")
    share = (F.col("same") - 1) / (F.col("dots") - 1 + DOTS_MORE)  # the text itself left out
    shared = F.when(share >= 0.15, "much").when(share >= 0.02, "some").otherwise("none")
    own = F.when(F.col("kind") == "dots", F.concat(F.lit("\x1fd"), shared)).otherwise(F.concat(F.lit("\x1fo"), "kind", odds.cast("string"), F.lit("\x1fu"), "kind", known, F.lit("\x1fv"), odds.cast("string")))
    return asked.withColumn("features", F.concat("features", own)).drop("w", "ends", "inside", "same", "dots").unionByName(docs.where("word = ''"))


def _hashed(features: str) -> np.ndarray:
    return np.array([zlib.crc32(f.encode()) % DIMENSIONS for f in features.split("\x1f")], dtype=np.int64)


def learn(rows: list[tuple[str, int, int]], turns: int = 4) -> tuple[np.ndarray, float] | None:
    """The classifier from endings at spikes (label 1) and away from them (0), or None where one label is missing.

    Endings away from spikes are partly cut as well.  With c the mean probability of those at spikes, an ending is taken for cut if its probability is above c / 2; those away from spikes that are so taken count as cut in the next turn."""
    if len({label for _, label, _ in rows}) < 2:
        return None
    taken = rows
    for _ in range(turns):
        weights, bias = fit(taken)
        p = [1 / (1 + np.exp(-float(weights[_hashed(f)].sum() + bias))) for f, _, _ in rows]
        spiked = [(x, n) for x, (_, label, n) in zip(p, rows) if label]
        c = sum(x * n for x, n in spiked) / sum(n for _, n in spiked)
        taken = [(f, int(label or x > c / 2), n) for x, (f, label, n) in zip(p, rows)]
    return weights, bias


def fit(rows: list[tuple[str, int, int]], rounds: int = 150, rate: float = 0.5, penalty: float = 5.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a maximum-entropy classifier from (features, label, count)."""
    hashed = [_hashed(f) for f, _, _ in rows]
    flat, sizes = np.concatenate(hashed), np.array([len(h) for h in hashed])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    y, n = np.array([label for _, label, _ in rows], dtype=float), np.array([count for _, _, count in rows], dtype=float)
    prior = penalty / n.sum()  # a weight that few texts ask for stays small
    n /= n.sum()
    weights, bias = np.zeros(DIMENSIONS), 0.0
    seen, seen_bias = np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[flat], starts) + bias, -30, 30)))
        g = (p - y) * n
        step = np.bincount(flat, weights=np.repeat(g, sizes), minlength=DIMENSIONS) + prior * weights
        seen += step * step
        weights -= rate * step / np.sqrt(seen)
        seen_bias += g.sum() ** 2
        bias -= rate * g.sum() / np.sqrt(seen_bias)
    return weights.astype(np.float32), float(bias)


def _taught(judged: DataFrame) -> list[tuple[str, int, int]]:
    """(features, label, distinct texts) of open and closed endings: 1 at a spike without terminal punctuation, 0 away from spikes; of more than ``TAUGHT`` kinds of a label those of the least hashes in an even share."""
    open_end = F.col("state") == "open"
    label = F.when(F.col("spike").isNull(), 0).when(open_end, 1)
    kinds = cut(judged.where((F.col("features") != "") & label.isNotNull()).select("features", label.alias("label"), "print").distinct().groupBy("features", "label").agg(F.count("*").alias("n")))
    shares = {r.label: -(-r["count"] // TAUGHT) for r in kinds.groupBy("label").count().collect()}
    out = []
    for which, share in shares.items():
        part = kinds.where((F.col("label") == which) & (F.pmod(F.xxhash64("features"), F.lit(share)) == 0)).limit(2 * TAUGHT)
        out += [(r.features, r.label, r.n) for r in part.collect()]
    return sorted(out)


def _scored(rows: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """``rows`` (doc_id, features) with ``cut``: whether the classifier takes the ending for cut."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: dict[str, bool] = {}
        for batch in batches:
            flags = []
            for f in batch.column(1).to_pylist():
                got = known.get(f)
                if got is None:
                    if len(known) > ENDINGS_KEPT:
                        known.clear()
                    got = known[f] = bool(shared.value is not None and f and shared.value[0][_hashed(f)].sum() + shared.value[1] > 0)
                flags.append(got)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, *range(2, batch.num_columns))), pa.array(flags, pa.bool_())], names)

    names = [c for c in rows.columns if c != "features"] + ["cut"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "features")
    return rows.mapInArrow(run, f"{schema}, cut boolean")


def truncated(rows: DataFrame) -> DataFrame:
    """The cut documents: ``doc_id``, ``source``, ``reason`` ('limit', 'mark', 'broken' or 'ending' with the kind of last line) and the spike (``unit``, ``limit``, ``at``, ``expected``) where there is one."""
    docs = rows.where(~F.col("state").isin("blank", "seen"))
    judged = cut(_at_limits(_with_words(docs, rows.where("state = 'seen'")), spikes(rows)).select("doc_id", "features", "source", "print", "state", "kind", "spike"))
    scored = _scored(judged.drop("print"), learn(_taught(judged)))
    at_limit = F.col("spike").isNotNull() & (F.col("state") == "open")
    reason = F.when(at_limit, F.lit("limit")).when(F.col("state").isin("mark", "broken"), F.col("state")).when(F.col("spike").isNull() | (F.col("state") == "closed"), F.when(F.col("cut"), F.lit("ending")))
    found = scored.withColumn("reason", reason).where("reason is not null")
    return found.select("doc_id", "source", F.concat_ws(" ", "reason", "kind").alias("reason"), F.col("spike").isNotNull().alias("at_limit"), *[F.col(f"spike.{c}").alias(c) for c in ("unit", "limit", "at", "expected")])


def rates(rows: DataFrame) -> DataFrame:
    """Per canonical source: documents, cut documents, those at a limit, and the rate."""
    cuts = truncated(rows).groupBy("source").agg(F.count("*").alias("cut"), F.count_if("at_limit").alias("cut_at_limit"))
    docs = rows.where(F.col("state") != "seen").groupBy("source").agg(F.count("*").alias("documents"))
    joined = docs.join(cuts, docs.source.eqNullSafe(cuts.source), "left").select(docs.source, "documents", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("cut_at_limit", F.lit(0)).alias("cut_at_limit"))
    return joined.withColumn("rate", F.round(F.col("cut") / F.col("documents"), 6))

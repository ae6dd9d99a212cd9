import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.operators import fixed, section

SLOW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def windows(spark, body, size=1000, overlap=200):
    df = spark.createDataFrame([("d", body)], "document_id string, text string")
    return fixed.fixed_chunks(df, size, overlap).orderBy("chunk_index").collect()


@pytest.mark.parametrize("bad", [(0, 0), (10, -1), (10, 10)])
def test_parameters(spark, bad):
    with pytest.raises(ValueError):
        windows(spark, "x", *bad)


@pytest.mark.parametrize("body", ["", "   \n", None])
def test_blank_gives_none(spark, body):
    assert windows(spark, body) == []


@SLOW
@given(st.text(alphabet="ab 中\U0001f600", min_size=1, max_size=60), st.integers(1, 12), st.integers(0, 11))
def test_windows_tile(spark, body, size, overlap):
    overlap = min(overlap, size - 1)
    got = windows(spark, body, size, overlap)
    step = size - overlap
    if not body.strip():
        assert got == []
        return
    assert [r.text for r in got] == [body[s : s + size] for s in range(0, len(body), step)]
    assert all(r.total_chunks == len(got) == math.ceil(len(body) / step) for r in got)


def packed(spark, counts, most):
    return spark.createDataFrame([(counts,)], "k array<int>").select(section.pack(F.col("k"), most).alias("g")).first()["g"]


def test_packing_example(spark):
    assert packed(spark, [30, 40, 10, 70, 5, 5], 60) == [0, 1, 1, 2, 3, 3]
    assert packed(spark, [], 60) == [] and packed(spark, [60], 60) == [0] and packed(spark, [61, 61, 1], 60) == [0, 1, 2]


BLOCK = "document_id string, page_number int, block_order int, block_type string, text string, section_path array<string>"


def chunk(spark, rows, most):
    df = spark.createDataFrame([("d", 1, k, *r) for k, r in enumerate(rows)], BLOCK)
    return section.section_chunks(df, most).orderBy("page_number", "chunk_index").collect()


def test_runs_and_atoms(spark):
    rows = [
        ("heading", "1 A", ["1 A"]), ("text", "one two", ["1 A"]), ("table", "a b c d e", ["1 A"]), ("text", "three", ["1 A"]), ("text", "  ", ["2 B"]), ("text", "four", ["1 A"]),
        ("table", " ", ["1 A"]), ("text", "five", ["1 A"]), ("title", "T", []), ("text", "six", ["1 A"]),
    ]
    got = chunk(spark, rows, 4)
    assert [(r.text, r.chunk_type, r.atomic) for r in got] == [
        ("1 A\n\none two", "text", None), ("a b c d", "table", False), ("e", "table", False), ("three", "text", None), ("four", "text", None), ("five", "text", None), ("T", "text", None), ("six", "text", None),
    ]
    assert [r.chunk_index for r in got] == list(range(len(got)))


def model(texts, most):
    """The three levels as plain loops."""
    import re

    def pack(parts):
        out, cur, used = [], [], 0
        for p in parts:
            n = len(p.split())
            if n > most:
                if cur:
                    out.append(cur)
                out.append([p])
                cur, used = [], 0
            elif cur and used + n > most:
                out.append(cur)
                cur, used = [p], n
            else:
                cur.append(p)
                used += n
        return out + ([cur] if cur else [])

    out = []
    for group in pack(texts):
        if len(group[0].split()) <= most:
            out.append("\n\n".join(group))
            continue
        sentences = [s.strip() for s in re.findall(r"(?s).*?[.!?]+(?:\s+|$)|.+$", group[0]) if s.strip()]
        for g in pack(sentences):
            words = g[0].split()
            out.extend([" ".join(g)] if len(words) <= most else [" ".join(words[i : i + most]) for i in range(0, len(words), most)])
    return out


@SLOW
@given(st.lists(st.lists(st.sampled_from(["a", "bb.", "c!", "dd", "e?"]), min_size=1, max_size=14).map(" ".join), min_size=1, max_size=6), st.integers(1, 8))
def test_section_chunks_equal_the_model(spark, texts, most):
    got = chunk(spark, [("text", t, ["s"]) for t in texts], most)
    assert [r.text for r in got] == model(texts, most)
    assert all(r.token_count <= most for r in got)


def test_max_tokens_guard(spark):
    with pytest.raises(ValueError):
        chunk(spark, [("text", "x", [])], 0)


def test_equal_texts_on_a_page_share_their_id(spark):
    got = chunk(spark, [("figure", "[Figure]", []), ("figure", "[Figure]", [])], 5)
    assert len(got) == 2 and got[0].chunk_id == got[1].chunk_id


def test_a_tokenizer_in_python(spark, tables):
    """Called over Arrow batches: words give the same chunks as the expressions; strings of three letters keep the budget and all text."""
    from leafmill.operators import blocks
    from leafmill.sources.tables import table

    made = blocks.extract_delivered(table(spark, tables, "blocks"))
    words = section.ArrowTokenizer(lambda texts: [t.split() for t in texts], " ")
    columns = ["chunk_id", "page_number", "chunk_index", "text", "token_count"]
    rows = lambda t: sorted(map(tuple, section.section_chunks(made, 30, t).select(*columns).collect()))
    assert rows(words) == rows(section.Tokenizer(lambda t: F.split(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), " "), lambda a: F.array_join(a, " ")))
    threes = section.ArrowTokenizer(lambda texts: [[t[i : i + 3] for i in range(0, len(t), 3)] for t in texts])
    got = section.section_chunks(made, 40, threes)
    # the budget holds for the sum of the parts; where these are joined some threes may be added
    assert got.where("token_count > 40 + size(split(text, '\\\\s+'))").count() == 0
    letters = lambda df: df.agg(F.sum(F.length(F.regexp_replace("text", r"(?U)\s+", "")))).first()[0]
    assert letters(got) == letters(made)

import hashlib
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import ids, text, vectors

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first()["y"]


@pytest.mark.parametrize("raw", [" a ", "\x85x\x1c\x1f", "​z​", "  ", "", "　中 文 ", "\t\n\v\f\r q \x1e"])
def test_strip_equals_python(spark, raw):
    assert one(spark, raw, text.py_strip("x")) == raw.strip()


@SLOW
@given(st.text(max_size=40))
def test_strip_of_any_text(spark, raw):
    assert one(spark, raw, text.py_strip("x")) == raw.strip()


LEVELS = [("1 Intro", 1), ("3.1 Self", 2), ("3. Intro", 1), ("3D Models", None), ("2024 results", 1), ("1.2.3x", 2), ("  4.5.6 Z", 3), ("A.1 App", None), ("1.", 1), ("1_a", None), (" 7 nb", 1), ("١.٢ x", 2), ("", None)]


@pytest.mark.parametrize("raw,level", LEVELS)
def test_number_level(spark, raw, level):
    assert one(spark, raw, text.number_level("x")) == level


def test_counts_and_previews(spark):
    assert one(spark, "a$$b$$c$$", text.count_of("x", "$$")) == 3
    assert one(spark, "ab\ncd", text.preview("x", 4)) == "ab c"
    assert one(spark, "a\r\nb\rc\n", text.unix_newlines("x")) == "a\nb\nc\n"
    assert one(spark, None, text.breadcrumb(F.lit(None).cast("array<string>"))) == ""


@pytest.mark.parametrize("name", ["", "abc", "ünï", "0" * 64])
def test_uuid5(spark, name):
    assert one(spark, name, ids.uuid5("x")) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_ids(spark):
    assert one(spark, "t", ids.chunk_id(F.lit("d"), F.lit(3), F.col("x"))) == hashlib.sha256(b"d:3:t").hexdigest()
    assert one(spark, "d", ids.window_id(F.col("x"), F.lit(7))) == "d_chunk_0007"
    assert one(spark, "d", ids.window_id(F.col("x"), F.lit(12345))) == "d_chunk_12345"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [6.0, 8.0])], "a array<double>, z array<double>, b array<double>")
    r = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("n"), vectors.normalise(F.col("a")).alias("u"), vectors.normalise(F.col("z")).alias("v")).first()
    assert abs(r.c - 1) < 1e-12 and r.n == 0.0 and r.u == [0.6, 0.8] and r.v == [0.0, 0.0]

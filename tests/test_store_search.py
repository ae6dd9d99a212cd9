import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.config import EmbeddingConfig
from leafmill.functions.ids import uuid5
from leafmill.operators import embed, qa, search, store, validate
from leafmill.streaming.ingest import ingest

CHUNK = "chunk_id string, document_id string, text string, page_number int"


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture
def shelf(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "shelf"))


def with_vectors(spark, rows, dimension=8):
    chunks = chunk_rows(spark, rows)
    model = embed.HashEmbedder(EmbeddingConfig(dimension=dimension))
    return validate.pair_vectors(chunks, embed.embed(chunks, "chunk_id", "text", model)), model


def test_round_trip_and_upsert(spark, shelf):
    rows, _ = with_vectors(spark, [("a", "d", "one", 1), ("b", "d", "two", 2)])
    shelf.create("c", 8)
    shelf.create("c", 99)  # an existing collection is kept
    assert shelf.meta("c")["size"] == 8
    shelf.upsert("c", store.points(rows, ["page_number"]))
    again, _ = with_vectors(spark, [("b", "d", "two new", 5), ("x", "d", "three", 3)])
    shelf.upsert("c", store.points(again, ["page_number"]))
    shelf.upsert("c", store.points(again, ["page_number"]))  # idempotent
    got = {r.payload["chunk_id"]: r.payload for r in shelf.read("c").collect()}
    assert set(got) == {"a", "b", "x"} and got["b"]["text"] == "two new" and got["b"]["page_number"] == "5" and got["a"]["text"] == "one"
    assert shelf.stats("c").first()["points"] == 3
    key = spark.createDataFrame([("a",)], "k string").select(uuid5("k")).first()[0]
    found = shelf.lookup("c", [key]).collect()
    assert len(found) == 1 and len(found[0].vector) == 8


def test_wrong_dimension_and_missing_vectors(spark, shelf):
    rows, _ = with_vectors(spark, [("a", "d", "one", 1)], 4)
    shelf.create("c", 8)
    with pytest.raises(ValueError):
        shelf.upsert("c", store.points(rows, []))
    with pytest.raises(ValueError):
        shelf.upsert("none", store.points(rows, []))
    for one, other in ((rows.select("chunk_id"), rows.select("chunk_id").where("false")), (rows.select("chunk_id").where("false"), rows.select("chunk_id"))):
        with pytest.raises(Exception, match="number of vectors"):
            validate.pair_vectors(one, other).collect()
    assert tuple(validate.pairing(rows.select("chunk_id"), rows.select("chunk_id").where("false")).first()) == (1, 0, 1, 0)


def test_last_wins_and_payload_override(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "x")], "id string, pos int, v string")
    assert {(r.id, r.v) for r in store.last_wins(df, "id", "pos").collect()} == {("k", "new"), ("j", "x")}
    p = df.select(store.payload({"text": F.lit("base"), "id": F.col("id")}, {"text": F.lit("meta"), "gone": F.lit(None)}).alias("p")).first()["p"]
    assert p["text"] == "meta" and "gone" not in p


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 6))
    vectors[7] = 0
    vectors[9] = vectors[8]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(5)
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)
    scores = unit @ unit.T
    queries = df.where("id % 10 = 8")
    got = search.top_k_set(df, queries, 4, "id", "id", "v").orderBy("query_id", "rank").collect()
    for q in (8, 18, 28, 38, 48, 58):
        want = sorted(range(60), key=lambda i: (-round(scores[q, i], 9), i))[:4]
        assert [r.id for r in got if r.query_id == q] == want
    one = search.top_k(df, [float(x) for x in vectors[8]], 2, "id", "v").orderBy("rank").collect()
    assert [r.id for r in one] == [8, 9]
    assert search.top_k(df, [0.0] * 6, 99, "id", "v").count() == 60
    assert search.top_k_set(df.where("false"), queries, 4, "id", "id", "v").count() == 0
    assert search.score_set(df, df.where("false"), "id", "id", "v").count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, v array<double>")
    whole = {(r.query_id, r.id, r["rank"]) for r in search.top_k_set(df, df, 2, "id", "id", "v").collect()}
    monkeypatch.setattr(search, "BLOCK", 4)
    assert {(r.query_id, r.id, r["rank"]) for r in search.top_k_set(df, df, 2, "id", "id", "v").collect()} == whole


def test_the_best_of_a_task_over_its_batches(spark, monkeypatch):
    """Ties across batches go by key; other lengths are left out; string keys work."""
    monkeypatch.setattr(search, "SCORES", 6)
    rows = [(f"k{i:02}", [float(i % 3), 1.0, 0.0]) for i in range(40)] + [("short", [1.0]), ("null", None), ("zero", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>").coalesce(1)
    queries = df.where("id in ('k02', 'k04', 'zero')")
    whole = search.score_set(df, queries, "id", "id", "v").collect()
    assert len(whole) == 3 * 41
    near = search.score_set(df, queries, "id", "id", "v", 5)
    assert near.count() == 15
    got = {}
    for r in search.top_k_set(df, queries, 5, "id", "id", "v").orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in got:
        best = sorted((r for r in whole if r.query_id == q), key=lambda r: (-r.score, r.id))[:5]
        assert got[q] == [r.id for r in best]
    with pytest.raises(ValueError):
        search.top_k_set(df, df.where("id in ('k02', 'short')"), 5, "id", "id", "v")


def test_an_interrupted_writer_loses_nothing(spark, shelf, monkeypatch):
    rows, _ = with_vectors(spark, [("a", "d", "one", 1)])
    shelf.create("c", 8, buckets=2)
    shelf.upsert("c", store.points(rows, []))
    # stopped before the metadata are written
    with monkeypatch.context() as m:
        m.setattr(shelf, "_write_meta", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            shelf.upsert("c", store.points(with_vectors(spark, [("b", "d", "two", 1)])[0], []))
    assert shelf.stats("c").first()["points"] == 1
    # stopped within the metadata file
    number = shelf.meta("c")["number"] + 1
    with open(f"{shelf.path}/c/meta-{number:012}.json", "w") as f:
        f.write('{"size": 8, "dist')
    assert shelf.stats("c").first()["points"] == 1 and shelf.meta("c")["size"] == 8
    shelf.create("c", 99)
    shelf.upsert("c", store.points(with_vectors(spark, [("b", "d", "two", 1)])[0], []))
    assert shelf.stats("c").first()["points"] == 2 and shelf.meta("c")["number"] == number + 1


def test_two_writers_lose_no_update(spark, shelf, monkeypatch):
    shelf.create("c", 8, buckets=3)
    other = store.Store(spark, shelf.path)
    write, done = shelf._write_meta, []

    def later(name, meta):
        if not done:
            done.append(1)
            other.upsert(name, store.points(with_vectors(spark, [(k, "d", k, 1) for k in "pqrst"])[0], []))
        write(name, meta)

    monkeypatch.setattr(shelf, "_write_meta", later)
    shelf.upsert("c", store.points(with_vectors(spark, [(k, "d", k, 1) for k in "abcde"])[0], []))
    assert {r.payload["chunk_id"] for r in shelf.read("c").collect()} == set("abcdepqrst")


def test_only_touched_buckets_are_written(spark, shelf):
    shelf.create("c", 8, buckets=64)
    shelf.upsert("c", store.points(with_vectors(spark, [(str(k), "d", str(k), 1) for k in range(200)])[0], []))
    before = shelf.meta("c")["folders"]
    shelf.upsert("c", store.points(with_vectors(spark, [("7", "e", "new", 1)])[0], []))
    after = shelf.meta("c")["folders"]
    assert len(before) > 50 and sum(before[b] != after[b] for b in before) == 1
    assert shelf.vacuum("c") > 0 and shelf.vacuum("c") == 0
    assert shelf.stats("c").first()["points"] == 200 and shelf.lookup("c", [r.point_id for r in shelf.read("c").limit(3).collect()]).count() == 3


def test_the_last_wins(spark, shelf, tmp_path):
    rows = with_vectors(spark, [("a", "d", "one", 1), ("b", "d", "two", 2)])[0]
    both = store.points(rows.withColumn("chunk_id", F.lit("same")), ["page_number"]).withColumn("pos", F.col("payload")["page_number"].cast("int"))
    shelf.create("c", 8)
    for order, want in (("pos", "two"), (None, "two")):
        shelf.upsert("c", both, order)
        assert [r.payload["text"] for r in shelf.read("c").collect()] == [want]
    shelf.upsert("c", both.withColumn("pos", -F.col("pos")), "pos")
    assert [r.payload["text"] for r in shelf.read("c").collect()] == ["one"]
    source = tmp_path / "in"
    chunk_rows(spark, [("a", "d", "first", 1), ("a", "d", "last", 9), ("a", "d", "middle", 5)]).write.parquet(str(source))
    model = embed.HashEmbedder(EmbeddingConfig(dimension=8))
    ingest(spark.readStream.schema(CHUNK).parquet(str(source)), shelf, "s", model, ["page_number"], str(tmp_path / "p"), order="page_number").awaitTermination()
    assert [r.payload["text"] for r in shelf.read("s").collect()] == ["last"]


def test_answers(spark, shelf):
    rows, model = with_vectors(spark, [("a", "d", "red fox", 1), ("b", "d", "blue whale", 2)], 64)
    shelf.create("c", 64)
    shelf.upsert("c", store.points(rows, ["page_number"]))
    got = qa.ask(shelf, "c", model, "blue whale", k=1)
    assert got["answer"] == "blue whale" and got["sources"] == ["d"] and got["scores"][0] > 0.99
    hits = spark.createDataFrame([(1, 2, "t2", "s2", 0.5), (1, 1, "t1", "s1", 0.75)], "query_id long, rank int, text string, source string, score double")
    context = qa.context(hits)
    assert context.first()["context"] == "t1\n\nt2"
    assert [r.citation for r in qa.citations(context).orderBy("position").collect()] == ["[1] s1 (similarity: 0.7500)", "[2] s2 (similarity: 0.5000)"]


def test_stream(spark, shelf, tmp_path):
    source = tmp_path / "chunks"
    chunk_rows(spark, [("a", "d", "one", 1), ("a", "d", "one", 1), ("b", "d", "two", 2)]).write.parquet(str(source))
    model = embed.HashEmbedder(EmbeddingConfig(dimension=8))
    for _ in range(2):
        stream = spark.readStream.schema(CHUNK).parquet(str(source))
        ingest(stream, shelf, "c", model, ["page_number"], str(tmp_path / "progress")).awaitTermination()
    assert shelf.stats("c").first()["points"] == 2
    chunk_rows(spark, [("z", "d", "late", 9)]).write.mode("append").parquet(str(source))
    ingest(spark.readStream.schema(CHUNK).parquet(str(source)), shelf, "c", model, ["page_number"], str(tmp_path / "progress")).awaitTermination()
    assert shelf.stats("c").first()["points"] == 3


def test_checks(spark):
    df = spark.createDataFrame([("p", 0, 3, True, None), ("p", 1, 9, None, []), ("q", 1, 2, False, ["s"])], "page string, chunk_index int, token_count int, atomic boolean, section_path array<string>")
    assert {(r.page, r.contiguous) for r in validate.index_check(df, ["page"]).collect()} == {("p", True), ("q", False)}
    assert validate.oversized(df, 3).count() == 1 and validate.sectionless(df).count() == 2 and validate.atomic(df).count() == 1
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "vector array<double>")
    assert validate.vector_check(vectors, 2).first()["wrong"] == 2

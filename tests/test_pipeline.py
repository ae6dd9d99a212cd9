import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.config import EmbeddingConfig
from leafmill.errors import LoaderError
from leafmill.operators import embed, qa, store, validate
from leafmill.plans import pipeline
from leafmill.sources import files

MODEL = embed.HashEmbedder(EmbeddingConfig(dimension=64))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "pump.md").write_text("# The pump\n\nThe pump held water.\n\n## Its valve\n\nThe valve opened at noon.")
    (tmp_path / "docs" / "rain.md").write_text("# Rain\n\nClouds and rain came late.")
    return tmp_path


def test_from_files_to_a_collection(spark, folder):
    pages = files.load_documents(spark, str(folder / "docs"), "md")
    shelf = store.Store(spark, str(folder / "shelf"))
    got = pipeline.ingest_documents(shelf, "c", pages, pipeline.items_of_pages(pages), MODEL, 20)
    assert got == {"collection": "c", "chunks": 3, "points": 3} == pipeline.ingest_documents(shelf, "c", pages, pipeline.items_of_pages(pages), MODEL, 20)
    points = {r.payload["text"]: r.payload for r in shelf.read("c").collect()}
    valve = next(p for t, p in points.items() if "valve opened" in t)
    assert valve["section_path"] == "The pump > Its valve" and valve["document_name"] == "pump.md" and valve["mime_type"] == "text/markdown" and valve["source_path"].endswith("/docs/pump.md") and valve["strategy"] == "section_aware"
    answer = qa.ask(shelf, "c", MODEL, "clouds and rain", k=1)
    assert answer["answer"] == "Rain" and answer["sources"][0].endswith("rain.md")


def test_the_contract_holds(spark, folder):
    pages = files.load_documents(spark, str(folder / "docs"), "md")
    chunks = pipeline.document_chunks(pipeline.items_of_pages(pages), pages)
    assert validate.missing_keys(chunks).count() == 0
    assert validate.missing_keys(pipeline.document_chunks(pipeline.items_of_pages(pages), pages.withColumn("mime_type", F.lit(None).cast("string")))).first()["missing"] == ["mime_type"]


def test_guards(spark, folder):
    pages = files.load_documents(spark, str(folder / "docs"), "md")
    shelf = store.Store(spark, str(folder / "shelf"))
    items = pipeline.items_of_pages(pages)
    with pytest.raises(LoaderError, match="no content"):
        pipeline.ingest_documents(shelf, "c", pages, items.where("false"), MODEL)
    with pytest.raises(LoaderError, match="no chunk"):
        pipeline.ingest_documents(shelf, "c", pages, items.withColumn("text", F.lit(" ")), MODEL)
    with pytest.raises(LoaderError, match="no file"):
        files.load_documents(spark, str(folder / "docs"), "md", single=True)
    with pytest.raises(LoaderError, match="no such file"):
        files.load_documents(spark, str(folder / "docs" / "x.md"), "md", single=True)
    assert files.load_documents(spark, str(folder / "docs" / "rain.md"), "md", single=True).count() == 1


def test_recognition_options(spark):
    pages = spark.createDataFrame([("d", bytearray(b"x"), 0)], "document_id string, content binary, page int")
    got = files.recognise_pages(pages, lambda content, page, o: f"{page} {o.dpi} {o.gray} {o.language}", files.Recognition(dpi=150, language="deu"))
    assert got.first()["text"] == "0 150 True deu"


class Counting(embed.HashEmbedder):
    """Tells by the first element how many texts came at once."""

    def embed_documents(self, texts):
        out = super().embed_documents(texts)
        out[:, 0] = len(texts)
        return out


def test_batches_follow_the_configuration(spark):
    texts = [{"k": k, "t": "x"} for k in range(7)]
    model = Counting(EmbeddingConfig(dimension=4, batch_size=3))
    sent = []
    shared = type("Shared", (), {"value": model})
    context = type("Context", (), {"broadcast": staticmethod(lambda m: shared)})
    frame = type("Frame", (), {"sparkSession": type("S", (), {"sparkContext": context}), "schema": spark.createDataFrame(texts, "k long, t string").schema, "select": lambda self, *c: self, "mapInArrow": lambda self, run, schema: sent.extend(run([pa.RecordBatch.from_pylist(texts)]))})()
    embed.embed(frame, "k", "t", model)
    assert [v[0] for b in sent for v in b.column(1).to_pylist()] == [3, 3, 3, 3, 3, 3, 1]

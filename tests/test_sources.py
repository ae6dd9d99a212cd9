import hashlib

import pytest

from leafmill.errors import LoaderError
from leafmill.sources import files
from leafmill.sources.tables import drop_keys, keep_keys


def test_text_and_markdown(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"one\r\ntwo\rthree")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.md").write_text("# h")
    got = {r.document_name: r for r in files.load_text(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.TXT", "b.txt"}
    assert got["a.TXT"].text == "one\ntwo\nthree" and got["a.TXT"].page_number == 1 and got["a.TXT"].mime_type == "text/plain"
    assert got["a.TXT"].document_id == hashlib.sha256(b"one\r\ntwo\rthree").hexdigest() and got["a.TXT"].source_path == str(tmp_path / "a.TXT")
    assert got["b.txt"].text is None and "utf-8" in got["b.txt"].error
    assert files.load_markdown(spark, str(tmp_path)).first()["text"] == "# h"
    by_path = files.load_text(spark, str(tmp_path), id_mode="path").where("document_name = 'a.TXT'").first()
    assert by_path.document_id == hashlib.sha256(str(tmp_path / "a.TXT").encode()).hexdigest()
    with pytest.raises(Exception, match="utf-8"):
        files.load_text(spark, str(tmp_path), mode="FAILFAST").collect()
    with pytest.raises(LoaderError):
        files.load_text(spark, str(tmp_path / "none")).collect()


def test_csv_records(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,a\n1,,3\n"",x\n\n1,2,3,4\n"q\nr",s,t\n')
    want = "a: 3 | b: \na: None | b: x\na: 3 | b: 2 | None: ['4']\na: t | b: s"
    assert files.load_csv(spark, str(tmp_path)).first()["text"] == want


def test_parser_and_models(spark):
    docs = spark.createDataFrame([("d", b"x"), ("e", b"boom")], "document_id string, content binary")

    def parser(content, options):
        if content == b"boom":
            raise ValueError("broken")
        if options["formulas"]:
            return []
        return [{"seq": 0, "kind": "text", "text": "hi", "page_no": 1}, {"seq": 1, "kind": "figure", "page_no": 1}]

    rows = files.parse_items(docs, parser).collect()
    assert [(r.document_id, r.kind) for r in rows if r.error is None] == [("d", "text"), ("d", "figure")]
    assert [r.error for r in rows if r.document_id == "e"] == ["broken"]
    assert [r.error for r in files.parse_items(docs.where("document_id = 'd'"), parser, profile="v1").collect()] == ["no content was extracted"]
    with pytest.raises(Exception, match="broken"):
        files.parse_items(docs, parser, "FAILFAST").collect()
    items = files.parse_items(docs.where("document_id = 'd'"), parser).drop("error")

    def failing(_):
        raise RuntimeError("offline")

    assert {r.caption for r in files.describe_figures(items, lambda t: " a cat ").collect() if r.kind == "figure"} == {"a cat"}
    assert {r.caption for r in files.describe_figures(items, failing).collect() if r.kind == "figure"} == {"[Figure description unavailable: offline]"}
    pages = spark.createDataFrame([("d", b"x", 0)], "document_id string, content binary, page int")
    assert files.recognise_pages(pages, lambda c, p: f"{len(c)}:{p}").first()["text"] == "1:0"


def test_key_joins(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("a",)], "k string")
    assert sorted(r.v for r in drop_keys(df, keys, "k").collect()) == [2, 3]
    assert [r.v for r in keep_keys(df, keys, "k").collect()] == [1]


def test_load_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.csv").write_text("k\nv\n")
    (tmp_path / "c.PDF").write_bytes(b"pdf")
    assert files.load_documents(spark, str(tmp_path), "txt").first()["text"] == "x"
    assert files.load_documents(spark, str(tmp_path), "csv").first()["text"] == "k: v"
    got = files.load_documents(spark, str(tmp_path), "pdf", lambda c, o: [{"seq": 0, "kind": "text", "text": c.decode(), "page_no": 1}]).first()
    assert got.text == "pdf" and got.document_id == hashlib.sha256(b"pdf").hexdigest()
    for bad in (lambda: files.load_documents(spark, str(tmp_path), "pdf"), lambda: files.load_documents(spark, str(tmp_path), "doc"), lambda: files.load_text(spark, str(tmp_path / "b.csv"))):
        with pytest.raises(LoaderError):
            bad()

"""Files to the relations ``documents``, ``pages`` and ``items``.

Text and Markdown files are one page, number 1, with the whole text; CSV
files render each record as ``key: value`` pairs.  PDF and scanned files go
through a parser that is put in: a function from bytes to items.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.errors import LoaderError
from leafmill.functions.ids import content_id
from leafmill.functions.text import unix_newlines

#: What a parser is asked to do: the structured profile, and the older one that describes figures.
PROFILES = {
    "v2": {"formulas": False, "picture_images": False, "recognition": False, "tables": True, "image_scale": 1.0},
    "v1": {"formulas": True, "picture_images": True, "recognition": False, "tables": True, "image_scale": 2.0},
}
MIME = {".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".pdf": "application/pdf"}
ITEMS = "seq int, kind string, text string, page_no int, item_level int, caption string, table_md string"


def read_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Files with the suffix, whatever its letter case: path, name, id and content."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except Exception as e:
        raise LoaderError(f"{path}: {e}") from e
    if "." in path.rsplit("/", 1)[-1] and path.rsplit(".", 1)[-1].lower() in {k[1:] for k in MIME} and not path.lower().endswith(suffix):
        raise LoaderError(f"{path}: expected a {suffix} file")
    rows = files.where(F.lower("path").endswith(suffix)).select(
        content_id("content").alias("document_id"), F.regexp_replace("path", "^file:/*", "/").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("document_name"),
        F.lit(MIME[suffix]).alias("mime_type"), "content",
    )
    return rows


def _decode(mode: str):
    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for content in batch.column(4).to_pylist():
                try:
                    texts.append(content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"))
                    errors.append(None)
                except UnicodeDecodeError as e:
                    if mode == "FAILFAST":
                        raise LoaderError(str(e)) from e
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["document_id", "source_path", "document_name", "mime_type", "text", "error"])

    return run


_PAGE = "document_id string, source_path string, document_name string, mime_type string, text string, error string"


def load_text(spark: SparkSession, path: str, suffix: str = ".txt", mode: str = "PERMISSIVE", id_mode: str = "content") -> DataFrame:
    """One page per UTF-8 file; bytes that aren't UTF-8 fill ``error`` or raise (FAILFAST)."""
    rows = read_files(spark, path, suffix).mapInArrow(_decode(mode), _PAGE)
    rows = rows if id_mode == "content" else rows.withColumn("document_id", content_id(F.encode("source_path", "UTF-8")))
    return rows.withColumn("page_number", F.lit(1))


def load_markdown(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return load_text(spark, path, ".md", mode)


def render_records(text: str) -> str:
    """Each record as ``key: value`` joined by `` | ``, one a line; of equal keys the last counts, missing cells are None, surplus cells a list under None."""
    lines = []
    for record in csv.DictReader(io.StringIO(text, newline="")):
        lines.append(" | ".join(f"{k}: {v}" for k, v in record.items()))
    return "\n".join(lines)


def _render(batches):
    for batch in batches:
        texts, errors = [], batch.column(5).to_pylist()
        for k, text in enumerate(batch.column(4).to_pylist()):
            try:
                texts.append(None if text is None else render_records(text))
            except csv.Error as e:
                texts.append(None)
                errors[k] = str(e)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["document_id", "source_path", "document_name", "mime_type", "text", "error"])


def load_csv(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """One page per CSV file with its records rendered."""
    return load_text(spark, path, ".csv", mode).drop("page_number").mapInArrow(_render, _PAGE).withColumn("page_number", F.lit(1))


def render_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rendering for rows of a table, natively: ``text`` with ``key: value`` pairs."""
    return df.withColumn("text", F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]))


#: Bytes and options to items.
Parser = Callable[[bytes, dict], Iterable[dict]]


def check_file(spark: SparkSession, path: str) -> None:
    """LoaderError unless the path is a file that exists."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        raise LoaderError(f"{path}: there is no such file")
    if not fs.getFileStatus(place).isFile():
        raise LoaderError(f"{path}: this is no file")


def load_documents(spark: SparkSession, path: str, kind: str, parser: Parser | None = None, mode: str = "PERMISSIVE", profile: str = "v2", single: bool = False) -> DataFrame:
    """Pages (txt, md, csv) or items (pdf, by ``parser``) of all files of a kind below a path; ``single``: of one file, which must be one."""
    if single:
        check_file(spark, path)
    if kind in ("txt", "md"):
        return load_text(spark, path, f".{kind}", mode)
    if kind == "csv":
        return load_csv(spark, path, mode)
    if kind == "pdf" and parser is not None:
        return parse_items(read_files(spark, path, ".pdf"), parser, mode, profile)
    raise LoaderError(f"no loader for {kind}" + (" without a parser" if kind == "pdf" else ""))


def parse_items(files: DataFrame, parser: Parser, mode: str = "PERMISSIVE", profile: str = "v2") -> DataFrame:
    """Items of each file by a parser that is put in; what it raises, and a file without items, fills ``error`` (or is raised)."""
    options = dict(PROFILES[profile])
    names = [f.split()[0] for f in ITEMS.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for document, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, error = [], None
                try:
                    rows = list(parser(content, options))
                    if not rows:
                        raise ValueError("no content was extracted")
                except Exception as e:
                    if mode == "FAILFAST":
                        raise LoaderError(str(e)) from e
                    error = str(e)
                n = max(1, len(rows)) if error else len(rows)
                columns = [pa.array([r.get(c) for r in rows] + [None] * (n - len(rows)), t) for c, t in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([document] * n, pa.string()), *columns, pa.array([error] * n, pa.string())], ["document_id", *names, "error"])

    return files.select("document_id", "content").mapInArrow(run, f"document_id string, {ITEMS}, error string")


def describe_figures(items: DataFrame, describer: Callable[[str], str]) -> DataFrame:
    """Captions of figures by a model that is put in (it gets the figure's text or image reference); a failure is named in the caption."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["kind"] == "figure":
                    try:
                        r["caption"] = (describer(r["text"] or "") or "").strip() or "[Figure could not be rendered]"
                    except Exception as e:
                        r["caption"] = f"[Figure description unavailable: {e}]"
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return items.mapInArrow(run, items.schema)


@dataclass(frozen=True)
class Recognition:
    """What a recogniser is asked to do: resolution, gray values instead of colours, and languages."""

    dpi: int = 300
    gray: bool = True
    language: str = "eng"


def recognise_pages(pages: DataFrame, recogniser: Callable[..., str], options: Recognition | None = None) -> DataFrame:
    """Text of page images by a recogniser that is put in: (content, page from 0) -> text, with the options as a third argument where they are given."""
    more = () if options is None else (options,)

    def run(batches):
        for batch in batches:
            texts = [recogniser(c, p, *more) for c, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], ["document_id", "page", "text"])

    return pages.select("document_id", "content", F.col("page").cast("int").alias("page")).mapInArrow(run, "document_id string, page int, text string")


def normalised_text(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Texts of a table as a loader gives them: one page with Unix newlines."""
    return documents.select(key, F.lit(1).alias("page_number"), unix_newlines(text).alias("text"))

"""Vector collections as folders of Parquet files.

A collection is a folder with numbered metadata files and folders of data.
Points lie in buckets by a hash of their id; the metadata name the folder of
each bucket.  An upsert reads and writes only the buckets that its points fall
into, in new folders, and then writes the metadata file of the next number,
which must not exist yet: of two writers one gets an error and tries again on
the other's result, so no update is lost.  Readers take the metadata file of
the highest number that is whole; nothing that an older one names is changed,
until ``vacuum`` deletes what the newest don't name.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.ids import uuid5
from leafmill.operators.search import top_k

POINT = "point_id string, vector array<float>, payload map<string,string>"


def last_wins(points: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest order."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return points.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that ``new`` doesn't replace."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def payload(base: dict[str, Column], metadata: dict[str, Column]) -> Column:
    """A map of strings in which metadata overrides equal base keys; null values are left out."""
    both = {**base, **metadata}
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in both.items()]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def points(chunks: DataFrame, metadata: list[str], vector: str = "vector") -> DataFrame:
    """Points of chunks that carry their vectors; ids are name-based UUIDs of the chunk ids."""
    base = {c: F.col(c) for c in ("chunk_id", "text", "document_id")}
    return chunks.select(uuid5("chunk_id").alias("point_id"), F.col(vector).alias("vector"), payload(base, {c: F.col(c) for c in metadata}).alias("payload"))


class Conflict(Exception):
    """Another writer was first."""


class Store:
    """Collections below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the metadata files, the newest first."""
        path, fs = self._fs()
        folder = path(f"{self.path}/{name}")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted((int(n[5:-5]) for n in names if n.startswith("meta-") and n.endswith(".json") and n[5:-5].isdigit()), reverse=True)

    def _read_meta(self, name: str, number: int) -> dict | None:
        path, fs = self._fs()
        stream = fs.open(path(f"{self.path}/{name}/meta-{number:012}.json"))
        try:
            return {**json.loads(bytes(stream.readAllBytes()).decode()), "number": number}
        except ValueError:
            return None  # a writer was stopped within it
        finally:
            stream.close()

    def meta(self, name: str) -> dict | None:
        return next((m for n in self._numbers(name) if (m := self._read_meta(name, n)) is not None), None)

    def _write_meta(self, name: str, meta: dict) -> None:
        """Write the metadata file of the next number; ``Conflict`` if there is one."""
        path, fs = self._fs()
        number = meta["number"] + 1
        taken = self._numbers(name)
        # a broken file of a stopped writer is passed over
        while number in taken and self._read_meta(name, number) is None:
            number += 1
        try:
            stream = fs.create(path(f"{self.path}/{name}/meta-{number:012}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                raise Conflict(name) from e
            raise
        stream.write(json.dumps({k: v for k, v in meta.items() if k != "number"}).encode())
        stream.close()

    def create(self, name: str, size: int, distance: str = "Cosine", buckets: int = 16) -> None:
        """Create a collection; an existing one is kept as it is."""
        if self.meta(name) is None:
            try:
                self._write_meta(name, {"number": -1, "size": size, "distance": distance, "buckets": buckets, "folders": {}})
            except Conflict:
                pass

    def _meta(self, name: str) -> dict:
        meta = self.meta(name)
        if meta is None:
            raise ValueError(f"no collection {name}")
        return meta

    def _folders(self, name: str, meta: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = [f for b, f in meta["folders"].items() if buckets is None or int(b) in buckets]
        if not wanted:
            return self.spark.createDataFrame([], POINT)
        return self.spark.read.schema(POINT).parquet(*[f"{self.path}/{name}/{f}" for f in wanted])

    def read(self, name: str) -> DataFrame:
        return self._folders(name, self._meta(name))

    def upsert(self, name: str, rows: DataFrame, order: str | None = None, tries: int = 5) -> None:
        """Insert new ids and replace existing points whole; of equal ids in ``rows`` the last by ``order`` wins, without it the greatest by content."""
        meta = self._meta(name)
        wrong = rows.where(~F.coalesce(F.size("vector") == meta["size"], F.lit(False))).limit(1).count()
        if wrong:
            raise ValueError(f"vectors of collection {name} have {meta['size']} dimensions")
        if order is None:
            rows, order = rows.withColumn("_order", F.struct(F.array_sort(F.map_entries("payload")), "vector")), "_order"
        bucket = F.pmod(F.xxhash64("point_id"), F.lit(meta["buckets"])).cast("int")
        new = last_wins(rows, "point_id", order).select("point_id", "vector", "payload").withColumn("bucket", bucket)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
        for last in range(tries - 1, -1, -1):
            folder = f"data-{uuid.uuid4().hex}"
            old = self._folders(name, meta, touched).withColumn("bucket", bucket)
            merged(old, new, "point_id").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/{folder}")
            try:
                self._write_meta(name, {**meta, "folders": {**meta["folders"], **{str(b): f"{folder}/bucket={b}" for b in touched}}})
                return
            except Conflict:
                if not last:
                    raise
                meta = self._meta(name)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Delete metadata files but the ``keep`` newest, and folders that these don't name; returns the number of deleted entries. Not to be run beside writers."""
        path, fs = self._fs()
        whole = [m for n in self._numbers(name) if (m := self._read_meta(name, n)) is not None][: max(1, keep)]
        files = {f"meta-{m['number']:012}.json" for m in whole}
        named = {f for m in whole for f in m["folders"].values()}
        used = {f.split("/")[0] for f in named}
        gone = 0
        for entry in fs.listStatus(path(f"{self.path}/{name}")):
            base = entry.getPath().getName()
            if base.startswith("meta-") and base not in files or base.startswith("data-") and base not in used:
                gone += bool(fs.delete(entry.getPath(), True))
            elif base.startswith("data-"):
                for part in fs.listStatus(entry.getPath()):
                    if part.getPath().getName().startswith("bucket=") and f"{base}/{part.getPath().getName()}" not in named:
                        gone += bool(fs.delete(part.getPath(), True))
        return gone

    def lookup(self, name: str, ids: list[str]) -> DataFrame:
        """Points by their ids; only their buckets are read."""
        meta = self._meta(name)
        rows = self.spark.createDataFrame([(i,) for i in ids], "point_id string")
        buckets = [r.b for r in rows.select(F.pmod(F.xxhash64("point_id"), F.lit(meta["buckets"])).alias("b")).distinct().collect()]
        return self._folders(name, meta, buckets).where(F.col("point_id").isin(ids))

    def search(self, name: str, query: list[float], k: int = 5) -> DataFrame:
        return top_k(self.read(name), query, k, "point_id")

    def stats(self, name: str) -> DataFrame:
        return self.read(name).agg(F.count("*").alias("points"))

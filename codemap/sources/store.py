"""Checkouts as a table whose file bytes are read once.

A store keeps what it has read of checked-out repositories in three Parquet tables under one folder:

  versions   (uri, length, modified, sha256)   which content a file had when it had this length and modification time
  objects    (sha256, content)                 every different content once: forks, vendored and copied files share theirs
  snapshots  (repo_id, path, tree_ord, size_bytes, content)   one folder for each call of ``files``

``paths`` lists the checkouts and opens no file. ``files`` reads the bytes of the listed signal and source files whose
(uri, length, modification time) the store has not seen, in tasks, and then joins contents to the listing once: the snapshot that it returns
is plain Parquet, of which every reader of an analysis scans its own columns. A second call opens only what has changed.

A job that dies leaves whole tables: objects are appended before the versions that name them, so what is missing is read again and what
is there already is not appended twice.
"""
from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as P

VERSIONS = "uri string, length bigint, modified timestamp, sha256 string"
OBJECTS = "sha256 string, content string"
FILES = "repo_id string, path string, tree_ord bigint, size_bytes bigint, content string"
KEY = ["uri", "length", "modified"]


def read_bytes(uri: str) -> bytes:
    """The bytes of a file by its URI, local or of any file system that Arrow knows."""
    import pyarrow.fs as pafs
    scheme, _, rest = uri.partition(":")
    if scheme == "file" or not rest:
        fs, path = pafs.LocalFileSystem(), "/" + (rest or uri).lstrip("/")
    else:
        authority, _, tail = rest.lstrip("/").partition("/")
        fs, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
        path = base.rstrip("/") + "/" + tail
    with fs.open_input_stream(path, compression=None) as source:
        return source.read()


def list_checkouts(spark: SparkSession, root: str, max_file_size: int | None = None) -> DataFrame:
    """(uri, length, modified, repo_id, path, wanted) of the kept files under ``root/<owner>/<repo>/...``; no file is opened.

    Skipped paths (and, if given, larger files) are left out; ``wanted`` marks signal and source files. Spark's listing leaves out files without bytes.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
              .select(F.col("path").alias("uri"), "length", F.col("modificationTime").alias("modified")))
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace(F.col("uri"), "^file:/+", "/"), "^" + re.escape(re.sub("^file:/+", "/", base)), "")
    parts = F.split(rel, "/")
    kept = listed.select(*KEY, F.concat_ws("/", F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))).alias("repo_id"),
                         F.array_join(F.slice(parts, 3, 1 << 20), "/").alias("path")).where(~P.should_skip("path"))
    if max_file_size is not None:
        kept = kept.where(F.col("length") <= F.lit(max_file_size))
    return kept.withColumn("wanted", P.is_signal("path") | P.extension("path").isin(K.SOURCE_EXTENSIONS))


class CheckoutStore:
    """The checkouts under ``root``, with what has been read of them in the folder ``path`` (shared storage on a cluster)."""

    def __init__(self, spark: SparkSession, root: str, path: str, max_file_size: int | None = None):
        self.spark, self.root, self.path, self.max_file_size = spark, root, path.rstrip("/"), max_file_size
        #: Files opened by this store's jobs so far (a task that runs twice counts twice).
        self.opened = spark.sparkContext.accumulator(0)

    def _table(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def versions(self) -> DataFrame:
        return self._table("versions", VERSIONS).groupBy(*KEY).agg(F.first("sha256").alias("sha256"))

    @property
    def objects(self) -> DataFrame:
        return self._table("objects", OBJECTS)

    def listing(self) -> DataFrame:
        return list_checkouts(self.spark, self.root, self.max_file_size)

    def paths(self) -> DataFrame:
        """The files of the checkouts with null contents, for analyses of paths."""
        return self._placed(self.listing().withColumn("content", F.lit(None).cast("string")))

    @staticmethod
    def _placed(listed: DataFrame) -> DataFrame:
        """In path order: a range shuffle of the rows, of which metadata alone decides the order."""
        return (listed.repartitionByRange("repo_id", "path").sortWithinPartitions("repo_id", "path").withColumn("tree_ord", F.monotonically_increasing_id())
                .select("repo_id", "path", "tree_ord", F.col("length").alias("size_bytes"), "content"))

    def fetch(self) -> None:
        """Read the wanted files of which the store has no version."""
        from ..session import stage
        missing = self.listing().where("wanted").select(*KEY).join(self.versions, KEY, "left_anti")
        opened = self.opened

        def read(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    part = batch.slice(i, 64)
                    contents = []
                    for uri in part.column(0).to_pylist():
                        opened.add(1)
                        contents.append(read_bytes(uri).decode("utf-8", "ignore"))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.string())], names=[*KEY, "content"])

        # few large files must not meet in one task: the listed files are dealt out evenly before they are opened
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        got = missing.repartition(parts, "uri").mapInArrow(read, "uri string, length bigint, modified timestamp, content string")
        got = stage(got.withColumn("sha256", F.sha2("content", 256)), "fetched")
        fresh = got.groupBy("sha256").agg(F.first("content").alias("content")).join(self.objects.select("sha256"), "sha256", "left_anti")
        fresh.write.mode("append").parquet(f"{self.path}/objects")
        got.select(*KEY, "sha256").write.mode("append").parquet(f"{self.path}/versions")

    def files(self) -> DataFrame:
        """files(repo_id, path, tree_ord, size_bytes, content) of the checkouts as they are now; files that are not wanted have a null content."""
        self.fetch()
        named = self.listing().join(self.versions, KEY, "left").withColumn("sha256", F.when(F.col("wanted"), F.col("sha256")))
        # a third of the files may have one content: the join is split by Spark where a content is that frequent
        full = self._placed(named.join(self.objects, "sha256", "left"))
        path = f"{self.path}/snapshots/{uuid.uuid4().hex}"
        full.write.parquet(path)
        return self.spark.read.schema(FILES).parquet(path)

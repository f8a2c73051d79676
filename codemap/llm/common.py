"""Helpers shared by the operators: scratch tables, Arrow batches, connected components."""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codemap.session import delete_on_exit, ensure_checkpoint_dir

#: Bytes that separate words: space and tab to carriage return. ``bytes.split()`` uses the same set.
SPACE_CODES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


class Scratch:
    """Tables of one operator run, in a folder of their own under ``spark.checkpoint.dir``.

    ``keep`` writes a DataFrame as Parquet and reads it back: lineage is cut, and after the loss of
    an executor the files are read again. ``drop`` deletes a table that no later step reads; what is left, the
    driver deletes when it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        delete_on_exit(self.spark, self.root)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Most bytes of a batch that a Python worker gets: long texts make batches of few rows.
BATCH_BYTES = 16 << 20


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_BYTES (or one row); lowers the session's limit if that is higher."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    names = df.columns
    if not any("." in n or "`" in n for n in names):
        return df.mapInArrow(function, schema)
    # mapInArrow looks its columns up by name and takes a dot for a field: the columns go under other names and get theirs back in the task
    return df.toDF(*fresh(names, *(f"column{i}" for i in range(len(names))))).mapInArrow(
        lambda batches: function(b.rename_columns(names) for b in batches), schema)


def named(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever its letters' case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def rows(batch: pa.RecordBatch, *names: str):
    """The named columns of a batch as Python lists, zipped."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def chunks(records, limit: int, size):
    """Lists of consecutive records whose sizes add up to ``limit`` at most (one record may exceed it)."""
    held, total = [], 0
    for record in records:
        n = size(record)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(record)
        total += n
    if held:
        yield held


def shingle_hashes(words: list[bytes], n: int, hasher) -> np.ndarray:
    """Hashes of the space-joined runs of n words; of the whole sequence if there are fewer; none for no word."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([hasher(joined)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends[n - 1:] - 1).tolist()
    return np.fromiter((hasher(joined[a:b]) for a, b in zip(starts, stops)), np.uint64, len(stops))


def _same(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) for every vertex u that is not the smallest of its connected component, v the smallest.

    Alternating large-star and small-star rounds over the edge table until it stops changing. Each
    round takes minima with partial aggregation and joins them back, so a vertex with very many
    edges is split like any skewed join; the number of rounds grows with the log of the size.
    """
    now = scratch.keep(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v"), "edges-0")
    seen, turn = None, 0
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = scratch.keep(large, f"large-{turn}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        turn += 1
        small = scratch.keep(small, f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}", f"large-{turn - 1}")
        now, was, seen = small, seen, _same(small)
        if was == seen:
            return now

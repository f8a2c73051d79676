"""Lookups by prefix in a sorted index: rows and what is looked up are sorted together, once, by a range shuffle.

A range shuffle and a sort in each partition put all rows in one order over the whole cluster, so no key, however many rows it has, must lie in
one task. What a row takes from the rows before it is found inside its partition; what reaches over a partition's edge is a number or a row for each
partition, which goes into the next ones by a join with that small table.

``endings`` counts and names the texts that end with a given text; ``longest_prefixes`` finds, for each text, the key before it in
the order: every key that a text begins with is that key itself or a prefix of it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Sorts after every character of a text.
LAST = "\U0010FFFF"


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """The rows in the order of the columns over all partitions; ``part`` numbers these."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("part", F.spark_partition_id())


def endings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo_id, suffix, n, first) of wanted(repo_id, suffix): how many of texts(repo_id, text) end with it, and the one that does if n is 1.

    Texts are read backwards, so those with an ending are a range of the order. Every text is one row, whatever the lengths of the suffixes; a suffix adds the
    two ends of its range. The number of texts before an end is the number before its partition and that inside of it.
    """
    back = F.reverse("suffix")
    rows = (texts.select("repo_id", F.reverse("text").alias("key"), F.lit(1).alias("kind"), "text")
            .unionByName(wanted.select("repo_id", back.alias("key"), F.lit(0).alias("kind"), F.col("suffix").alias("text")))
            .unionByName(wanted.select("repo_id", F.concat(back, F.lit(LAST)).alias("key"), F.lit(2).alias("kind"), F.col("suffix").alias("text"))))

    def count(batches):
        before = 0
        for batch in batches:
            is_text = np.asarray(batch.column(2)) == 1
            through = before + np.cumsum(is_text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(through - is_text, pa.int64())],
                                             names=["repo_id", "kind", "text", "part", "before"])
            before = int(through[-1]) if len(through) else before

    placed = in_order(rows, "repo_id", "key", "kind").mapInArrow(count, "repo_id string, kind int, text string, part int, before bigint")
    placed = stage(placed, "endings")
    sizes = placed.where("kind = 1").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    every = placed.select("part").distinct().join(sizes, "part", "left")  # a row for each partition
    offsets = every.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    numbered = placed.join(offsets, "part").select("repo_id", "kind", "text", (F.col("offset") + F.col("before")).alias("at"))
    end = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    ranges = (numbered.where("kind <> 1").groupBy("repo_id", F.col("text").alias("suffix")).agg(end(0).alias("at"), (end(2) - end(0)).alias("n")))
    only = numbered.where("kind = 1").select("at", F.col("text").alias("first"))
    # of a range with one text, that text is the one at its lower end
    return (ranges.withColumn("at", F.when(F.col("n") == 1, F.col("at"))).join(only, "at", "left").select("repo_id", "suffix", "n", "first"))


def longest_prefixes(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """texts(repo_id, id, text) with ``key`` and ``value`` of the greatest of keys(repo_id, key, value) that is not after the text; null if there is none."""
    id_type, value_type = dict(texts.dtypes)["id"], dict(keys.dtypes)["value"]
    rows = (keys.select("repo_id", F.col("key").alias("text"), F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), "value")
            .unionByName(texts.select("repo_id", "text", F.lit(1).alias("kind"), "id", F.lit(None).cast(value_type).alias("value"))))

    def carry(batches):
        """Each text with the key before it in the partition; at the end, a row without a text that has the partition's last key."""
        held = None  # the last key so far, as a batch of one row
        for batch in batches:
            source = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            is_key = np.asarray(source.column(2)) == 0
            last = np.maximum.accumulate(np.where(is_key, np.arange(len(is_key)), -1))
            yield pick(source, np.flatnonzero(~is_key), last[~is_key])
            if len(last) and last[-1] >= 0:
                held = source.slice(int(last[-1]), 1)
        if held is not None:
            end = pick(held, np.zeros(1, int), np.zeros(1, int))
            yield pa.RecordBatch.from_arrays([end.column(0), pa.nulls(1, end.column(1).type), pa.nulls(1, pa.string()), *end.columns[3:]], names=names)

    def pick(source, at, of):
        of = pa.array(of, mask=of < 0)
        return pa.RecordBatch.from_arrays([*(source.column(i).take(pa.array(at)) for i in (0, 3, 1, 5)), *(source.column(i).take(of) for i in (0, 1, 4))], names=names)

    names = ["repo_id", "id", "text", "part", "key_repo", "key", "value"]
    found = in_order(rows, "repo_id", "text", "kind").mapInArrow(
        carry, f"repo_id string, id {id_type}, text string, part int, key_repo string, key string, value {value_type}")
    found = stage(found, "prefixes")
    ends = found.where("text IS NULL").select("part", F.struct("key_repo", "key", "value").alias("end"))
    every = found.select("part").distinct().join(ends, "part", "left")  # a row for each partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("part", F.last("end", ignorenulls=True).over(earlier).alias("end"))
    got = found.where("text IS NOT NULL").join(every, "part", "left").withColumn(
        "k", F.when(F.col("key").isNotNull(), F.struct("key_repo", "key", "value")).otherwise(F.col("end")))
    same = F.col("k.key_repo") == F.col("repo_id")
    return got.select("repo_id", "id", "text", F.when(same, F.col("k.key")).alias("key"), F.when(same, F.col("k.value")).alias("value"))

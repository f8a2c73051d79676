"""A stored inverted index for BM25, and top-k by upper bounds.

``build`` counts the terms of every candidate once and writes, under one folder,

  docs      (repo_id, path, dl)
  repos     (repo_id, n_docs, avgdl, average_idf)
  terms     (bucket, repo_id, term, df, best)                                best: largest impact of the term in a file
  postings  (bucket, repo_id, term, level, part, n, best, worst, posts)      posts: array of (path, impact), at most BLOCK of them; worst: null if there is one

``terms`` and ``postings`` lie in BUCKETS folders by the hash of (repo_id, term), sorted by term: a query opens only the folders of its own terms, and inside
them only the row groups that can hold one. An idf comes from a term's df and its repository's numbers when it is asked for. A term's postings are ordered by impact: LEVELS quantised levels, each in blocks that carry their
bounds, so a block's header tells what its files can get without reading them.

Two shuffles make the index: the postings are dealt once, by bucket and a hash of (repo_id, term, level), and cut into blocks where they lie; the terms'
rows are summed up from the blocks' headers.

``scores`` gives every file's score (files without a query term: 0). ``top`` gives each repository's k best files that hold a query term, after skipping the blocks
that cannot hold one of them:

1. From the headers alone: with a term's blocks in order of impact, the k-th file of a term scores at least the term's weight times the impact of the level in
   which the k-th file lies. The largest of these over the query's terms is a score that k files reach.
2. A file of a block scores at most the block's bound and the best of every other term. If that is less, none of its files is among the k best. Terms whose bests
   together are less (from the smallest on) make no file one of the k best by themselves: they are not essential.
3. The posts of the other blocks are read; the files of the essential terms are the candidates, and the other terms' posts are met with these before anything is
   summed. A file whose score reaches the threshold has no post in a skipped block, so its sum is whole; that of any other file can only come out too small.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from . import lexical as LX

BUCKETS = 64
LEVELS = 32
BLOCK = 128
#: Bounds are compared with this slack, for sums of doubles depend on their order.
SLACK = 1e-9


SCHEMAS = {
    "docs": "repo_id string, path string, dl bigint",
    "repos": "repo_id string, n_docs bigint, avgdl double, average_idf double",
    "terms": "repo_id string, term string, df bigint, best double, bucket int",
    "postings": "repo_id string, term string, level int, part int, n bigint, best double, worst double, posts array<struct<path:string,impact:double>>, bucket int",
}


def _bucket():
    return F.pmod(F.xxhash64("repo_id", "term"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of df(bucket, ...) dealt in the order of their bucket and of ``place``, a hash of the keys: tasks share a bucket, and a task holds few of them."""
    places = -(-4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    return df.withColumn("place", F.pmod(F.xxhash64(*keys), F.lit(places)).cast("int")).repartitionByRange("bucket", "place")


def _cut(batches, block: int):
    """Blocks of the rows (bucket, repo_id, term, level, path, impact), in which equal (repo_id, term, level) are neighbours: at most ``block`` rows of equal (repo_id, term, level) each.

    A batch's last block is held back, for the next batch may go on with it.
    """
    held, part = None, 0  # the rows of the block held back, and its part
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
        if not rows:
            continue
        cut, held, part = _blocks(rows[0], block, part)
        yield from cut
    if held is not None:
        yield from _blocks(held, block, part, last=True)[0]


def _blocks(rows: pa.RecordBatch, block: int, part: int, last: bool = False) -> tuple[list, pa.RecordBatch | None, int]:
    """(blocks, rows of the last one unless it is the ``last`` of all, its part); ``part``: the part of the first row's block."""
    bucket, repo, term, level, path, impact = rows.columns
    n = rows.num_rows
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = reduce(np.logical_or, (pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in (repo, term, level)))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    inside = np.arange(n) - first
    starts = np.flatnonzero(inside % block == 0)
    parts = inside[starts] // block + np.where(first[starts] == 0, part, 0)
    done = len(starts) if last else len(starts) - 1
    end = n if last else int(starts[-1])
    left = None if last else rows.slice(end)
    if not done:
        return [], left, int(parts[-1])
    at, scores = starts[:done], impact.to_numpy()[:end]
    posts = pa.ListArray.from_arrays(pa.array(np.append(at, end), pa.int32()), pa.StructArray.from_arrays([path.slice(0, end), impact.slice(0, end)], names=["path", "impact"]))
    pick = lambda c: c.take(pa.array(at))
    made = [pick(bucket), pick(repo), pick(term), pick(level), pa.array(parts[:done], pa.int32()), pa.array(np.diff(np.append(at, end)), pa.int64()),
            pa.array(np.maximum.reduceat(scores, at)), pa.array(np.minimum.reduceat(scores, at), mask=np.diff(np.append(at, end)) == 1), posts]
    return [pa.RecordBatch.from_arrays(made, names=["bucket", "repo_id", "term", "level", "part", "n", "best", "worst", "posts"])], left, int(parts[-1])


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    k1: float = K.BM25_K1
    b: float = K.BM25_B
    epsilon: float = K.BM25_EPSILON

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    @property
    def docs(self) -> DataFrame:
        return self._read("docs")

    @property
    def repos(self) -> DataFrame:
        return self._read("repos")

    def of_terms(self, name: str, q: DataFrame) -> DataFrame:
        """The rows of ``terms`` or ``postings`` in the folders that hold the terms of q(bucket, repo_id, term, ...), at most BUCKETS numbers."""
        wanted = [r[0] for r in q.select("bucket").distinct().collect()]
        return self._read(name).where(F.col("bucket").isin(wanted)).join(q, ["bucket", "repo_id", "term"])

    def weighted(self, keywords: DataFrame) -> DataFrame:
        """(bucket, repo_id, term, weight, best) of the query's terms that the repository has."""
        from ..session import stage
        q = stage(LX.query_terms(keywords).select(_bucket(), "*"), "index_terms")
        known = self.of_terms("terms", q).join(self.repos, "repo_id")
        return known.select("bucket", "repo_id", "term", (F.col("qn") * LX.floored_idf(self.epsilon)).alias("weight"), F.col("best").alias("top"))

    def scores(self, keywords: DataFrame) -> DataFrame:
        """(repo_id, path, bm25_raw, bm25) for every file."""
        from ..session import stage
        q = stage(self.weighted(keywords), "index_query")
        hits = self.of_terms("postings", q.drop("top")).select("repo_id", "weight", F.inline("posts")).select("repo_id", "path", (F.col("weight") * F.col("impact")).alias("s"))
        none = self.docs.select("repo_id", "path", F.lit(0.0).alias("s"))
        return LX.normalised(hits.unionByName(none).groupBy("repo_id", "path").agg(F.sum("s").alias("bm25_raw")))

    def reachable(self, keywords: DataFrame, k: int) -> DataFrame:
        """(repo_id, term, weight, essential, n, posts) of the blocks that can hold a file of the k best."""
        from ..session import stage
        q = stage(self.weighted(keywords), "index_query")
        blocks = self.of_terms("postings", q.drop("top"))
        # per term and level, at most LEVELS rows: how many files have at least which impact
        levels = blocks.groupBy("repo_id", "term", "weight", "level").agg(F.sum("n").alias("n"), F.min(F.coalesce("worst", "best")).alias("worst"))
        w = Window.partitionBy("repo_id", "term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        below = q.groupBy("repo_id").agg(F.sum(F.when(F.col("weight") < 0, F.col("weight") * F.col("top")).otherwise(F.lit(0.0))).alias("below"),
                                         F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.col("top")).otherwise(F.lit(0.0))).alias("above"))
        sure = (levels.where(F.col("weight") > 0).withColumn("files", F.sum("n").over(w)).where(F.col("files") >= k)
                .groupBy("repo_id").agg(F.max(F.col("weight") * F.col("worst")).alias("sure")))
        bound = below.join(sure, "repo_id", "left").select("repo_id", "above", (F.col("sure") + F.col("below") - F.lit(SLACK)).alias("need"))
        at_most = F.when(F.col("weight") > 0, F.col("above") - F.col("weight") * (F.col("top") - F.col("best"))).otherwise(F.col("above"))
        alone = F.sum(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))).over(
            Window.partitionBy("repo_id").orderBy(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0)), "term"))  # over the terms of a query
        ranked = (q.select("bucket", "repo_id", "term", "top", alone.alias("alone")).join(bound, "repo_id")
                  .withColumn("essential", F.col("need").isNull() | (F.col("alone") >= F.col("need"))))
        met = blocks.join(ranked, ["bucket", "repo_id", "term"])
        return met.where(F.col("need").isNull() | (F.col("weight") < 0) | (at_most >= F.col("need"))).select("repo_id", "term", "weight", "essential", "n", "posts")

    def top(self, keywords: DataFrame, k: int) -> DataFrame:
        """(repo_id, rank, path, bm25_raw): the k best files that hold a query term; scores equal to 9 digits go by path."""
        hits = self.reachable(keywords, k).select("repo_id", "weight", "essential", F.inline("posts"))
        essential = hits.where("essential")
        others = hits.where("NOT essential").join(essential.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
        found = essential.unionByName(others).groupBy("repo_id", "path").agg(F.sum(F.col("weight") * F.col("impact")).alias("bm25_raw"))
        w = Window.partitionBy("repo_id").orderBy(F.round("bm25_raw", 9).desc(), "path")
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(k))
        return ranked.select("repo_id", F.col("rank").cast("int").alias("rank"), "path", "bm25_raw")


def build(cands: DataFrame, path: str, k1: float = K.BM25_K1, b: float = K.BM25_B, epsilon: float = K.BM25_EPSILON) -> TextIndex:
    """Index cands(repo_id, path, content) under ``path`` (a folder on the cluster's shared storage). Whole texts are read once."""
    from ..session import stage
    spark = cands.sparkSession
    counted = stage(LX.doc_terms(cands), "index_terms")

    index = TextIndex(spark, path, k1, b, epsilon)
    counted.where("first").select("repo_id", "path", "dl").write.mode("overwrite").parquet(f"{path}/docs")
    counts = stage(LX.file_counts(index.docs), "index_counts")
    impact = LX.impact(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    posts = counted.join(counts.select("repo_id", "avgdl"), "repo_id").select(_bucket(), "repo_id", "term", "path", impact.alias("impact"))
    level = F.floor(F.col("impact") * F.lit(LEVELS / (k1 + 1))).cast("int")
    posts = _dealt(posts.withColumn("level", level), "repo_id", "term", "level")
    # equal (repo_id, term, level) must lie side by side, in whatever order: one by their hash compares numbers, and texts only where these are equal
    posts = (posts.withColumn("h", F.xxhash64("repo_id", "term", "level")).sortWithinPartitions("h", "repo_id", "term", "level")
             .select("bucket", "repo_id", "term", "level", "path", "impact"))
    block, kinds = BLOCK, "bucket int, repo_id string, term string, level int, part int, n bigint, best double, worst double, posts array<struct<path:string,impact:double>>"
    blocks = posts.mapInArrow(lambda batches: _cut(batches, block), kinds)
    (blocks.sortWithinPartitions("bucket", "term", "repo_id", F.desc("level"), "part")
     .write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings"))
    heads = _dealt(index._read("postings").select("bucket", "repo_id", "term", "n", "best"), "repo_id", "term")
    terms = heads.groupBy("bucket", "place", "repo_id", "term").agg(F.sum("n").alias("df"), F.max("best").alias("best")).drop("place")
    terms.sortWithinPartitions("bucket", "term", "repo_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    counts.join(LX.average_idf(index._read("terms"), counts).drop("n_terms"), "repo_id", "left").write.mode("overwrite").parquet(f"{path}/repos")
    return index

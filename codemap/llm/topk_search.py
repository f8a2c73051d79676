"""Exact top-k inner products by columnar branch and bound.

Vectors become whole numbers. Candidates lie in blocks in vertical layout: for every dimension one column of the block's components, dimensions in the
order of their mass (sum of squares) over the whole table, and blocks in the order of the candidates' norms. A block of queries meets a block of candidates
in a task, which

1. accumulates scores DIMS dimensions at a time, from the heaviest on;
2. after each step bounds what the other dimensions can add, by Cauchy-Schwarz the product of the remaining masses (norms) of query and candidate;
3. drops candidates whose bound is below the query's threshold and compacts the survivors: first to the columns that any query still needs, and, once few
   pairs are left, to a list of pairs.

A threshold is a score that k candidates are known to reach: the k-th best in the block of the largest norms, which every query meets first. As blocks are
ordered by norm, the blocks that a query block still has to meet are a prefix of all, and no other pair of blocks is formed. Nothing is cut: a candidate whose bound
equals the threshold stays, and the order of all that remain decides.

Equal vectors are one candidate (the smallest ids stand for it: no more than k of them, and one for a query itself, can be among the best) and equal queries
one query, so the copies of a frequent vector multiply no work. Ranks are found once more over the members of the winning vectors.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codemap.llm.common import Scratch, map_batches

SCALE = 64
DIMS = 8
BLOCK = 4096
QUERIES = 512
#: Pairs are kept as a list once this share of a block's pairs, or less, survives.
SPARSE = 0.05
#: Rows for each partition that orders candidates by norm.
PART = 16 * BLOCK
LAST = 2 ** 63 - 1

BLOCK_SCHEMA = "part int, seq int, c array<long>, low array<long>, cols array<array<long>>"


def usable(entries: Column) -> Column:
    """Whether an array of doubles is not null, all entries are finite, and the vector's squared norm, so any score, fits a long."""
    whole = F.transform(entries, lambda c: F.floor(c * SCALE))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(2.0 ** 56)))
    norm = F.aggregate(whole, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return entries.isNotNull() & F.when(F.coalesce(bad, F.lit(True)), False).otherwise(norm < F.lit(2.0 ** 62))


def whole_numbers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(r, id, x array<long>): floor(64 c) for the components of usable vectors; r tells the rows."""
    source = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("e")).filter(usable(F.col("e")))
    return source.select(F.monotonically_increasing_id().alias("r"), "id", F.transform("e", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def dimension_order(vectors: DataFrame) -> list[int]:
    """All dimensions (of the longest vector), those of the greatest mass first."""
    mass = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.pow(F.col("v").cast("double"), 2)).alias("m")).collect()
    return [r["i"] for r in sorted(mass, key=lambda r: (-r["m"], r["i"]))]


def padded(batch: pa.RecordBatch, name: str, order: list[int]) -> np.ndarray:
    """A column of arrays of longs as a matrix with the columns in the given order; vectors that are too short end in zeros."""
    column = batch.column(batch.schema.get_field_index(name))
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes, d = np.diff(ends), len(order)
    out = np.zeros((len(sizes), d), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out[:, order]


def blocks(distinct: DataFrame, size: int, order: list[int], scratch: Scratch, name: str) -> tuple[DataFrame, list[int], list[float]]:
    """Numbered blocks of at most ``size`` vectors in vertical layout, by falling norm, and for each partition the number of
    blocks up to its end and its largest norm.

    ``distinct``: (c, low, x). A range shuffle orders the vectors; the numbers of blocks of its partitions (a row each) give the blocks' numbers.
    """
    parts = max(1, -(-distinct.count() // PART))
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v)
    placed = distinct.withColumn("norm", norm).repartitionByRange(parts, F.desc("norm"), "c").sortWithinPartitions(F.desc("norm"), "c")
    placed = placed.select(F.spark_partition_id().alias("part"), "c", "low", "x")

    def run(batches):
        seq, held, n = 0, [], 0

        def record(batch):
            cols = np.ascontiguousarray(padded(batch, "x", order).T)
            return pa.record_batch([batch.column(0).slice(0, 1), pa.array([seq], pa.int32()), pa.array([batch.column(1)], pa.list_(pa.int64())), pa.array([batch.column(2)], pa.list_(pa.int64())),
                                    pa.array([[pa.array(c) for c in cols]], pa.list_(pa.list_(pa.int64())))], names=["part", "seq", "c", "low", "cols"])

        for batch in batches:
            while batch.num_rows:
                take = min(size - n, batch.num_rows)
                held.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == size:
                    yield record(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    seq, held, n = seq + 1, [], 0
        if n:
            yield record(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    made = scratch.keep(map_batches(placed, run, BLOCK_SCHEMA), name)
    most = F.expr("aggregate(cols, 0L, (a, col) -> a + col[0] * col[0])")  # a block's first vector has its largest norm
    found = {r["part"]: (r["n"], float(r["norm"])) for r in made.groupBy("part").agg(F.count("*").alias("n"), F.max(most).alias("norm")).collect()}
    ends, norms = [], []
    for part in range(max(found, default=-1) + 1):  # an empty partition has the end and the norm of the one before it
        n, norm = found.get(part, (0, norms[-1] ** 2 if norms else LAST))
        ends.append((ends[-1] if ends else 0) + n)
        norms.append(math.sqrt(norm))
    return made.withColumn("block", (F.element_at(numbers([0, *ends]), F.col("part") + 1) + F.col("seq")).cast("int")), ends, norms


def numbers(values: list) -> Column:
    """A constant array of doubles: one literal however many values there are."""
    listed = F.split(F.lit(",".join(map(repr, values))), ",") if values else F.array()
    return listed.cast("array<double>")


def cell(queries: np.ndarray, columns: np.ndarray, low: np.ndarray, need: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, candidate, score) of the k best candidates of each query in a block, of those that reach its threshold.

    ``queries``: a row a query; ``columns``: a row a dimension, a column a candidate; ``low``: decides ties, the smaller first; ``need``: thresholds.
    """
    d = len(columns)
    largest = float(np.sqrt((queries.astype(float) ** 2).sum(axis=1).max(initial=0) * (columns.astype(float) ** 2).sum(axis=0).max(initial=0)))
    kind = float if largest < 2.0 ** 52 else np.int64  # whole numbers are exact as doubles up to there; scores fit a long
    q, c = queries.astype(kind), columns.astype(kind)
    q_left = np.sqrt(np.cumsum((queries.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1])
    c_left = np.sqrt(np.cumsum((columns.astype(float) ** 2)[::-1], axis=0)[::-1])
    # bounds may be too large, never too small; doubles round whole numbers beyond 2^53
    slack, margin = 1 + 1e-9, 0.0 if kind is float else 1e-12 * largest
    who, which = np.arange(len(q)), np.arange(c.shape[1])
    score, pairs = np.zeros((len(q), c.shape[1]), kind), None
    for at in range(0, d, DIMS):
        stop = min(d, at + DIMS)
        if pairs is None:
            score += q[np.ix_(who, range(at, stop))] @ c[at:stop][:, which]
            rest = np.outer(q_left[who, stop], c_left[stop, which]) if stop < d else 0.0
            alive = score + (rest * slack + (stop < d) + margin) >= need[who, None]
            rows_, cols_ = alive.any(axis=1), alive.any(axis=0)
            if alive.sum() <= SPARSE * alive.size:
                pairs = np.nonzero(alive)
                score = score[pairs]
                pairs = who[pairs[0]], which[pairs[1]]
            elif not (rows_.all() and cols_.all()):
                score, who, which = score[np.ix_(rows_, cols_)], who[rows_], which[cols_]
                alive = alive[np.ix_(rows_, cols_)]
        else:
            for i in range(at, stop):
                score = score + q[pairs[0], i] * c[i, pairs[1]]
            rest = q_left[pairs[0], stop] * c_left[stop, pairs[1]] if stop < d else 0.0
            keep = score + (rest * slack + (stop < d) + margin) >= need[pairs[0]]
            score, pairs = score[keep], (pairs[0][keep], pairs[1][keep])
    if pairs is None:
        if len(which) > k:
            alive &= score >= np.partition(score, -k, axis=1)[:, -k, None]
        chosen = np.nonzero(alive)
        score, pairs = score[chosen], (who[chosen[0]], which[chosen[1]])
    order = np.lexsort((low[pairs[1]], -score, pairs[0]))
    a, b, score = pairs[0][order], pairs[1][order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k], score[place < k].astype(np.int64)


def _matrix(nested) -> np.ndarray:
    """A block's columns as a matrix, a row a dimension."""
    flat = nested.values.flatten().to_numpy(zero_copy_only=False) if len(nested.values) else np.empty(0, np.int64)
    return flat.reshape(len(nested.values), -1)


def meet(pairs: DataFrame, k: int) -> DataFrame:
    """(q, c, low, score) of cells (qc, qlow, qcols, need, c, low, cols): see ``cell``."""
    def run(batches):
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("qc", "qcols", "need", "c", "low", "cols")}
            for i in range(batch.num_rows):
                one = {n: v[i] for n, v in columns.items()}
                ids, c, low = (one[n].values.to_numpy(zero_copy_only=False) for n in ("qc", "c", "low"))
                need = one["need"].values.to_numpy(zero_copy_only=False)
                a, b, score = cell(np.ascontiguousarray(_matrix(one["qcols"]).T), _matrix(one["cols"]), low, need, k)
                yield pa.record_batch([pa.array(ids[a]), pa.array(c[b]), pa.array(low[b]), pa.array(score)], names=["q", "c", "low", "score"])

    return map_batches(pairs, run, "q long, c long, low long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of every q, by score and then by the smaller low and c."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "low", "c")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def search(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): for each row whose id is divisible by ``every``, the k other rows of the greatest inner products.

    Components c count as floor(64 c). Ranks go from 1; equal scores go by the smaller id, null ids last. Rows without a usable vector (null, with null or
    non-finite components, or a squared norm of 2^62 and more) take no part; an empty vector has the score 0 with all others, and of vectors of different lengths the shorter one
    is filled up with zeros. Repeated rows are rows of their own, each other's candidates. A row with a null id is no query. Other columns are not read.
    """
    scratch, m = Scratch(table.sparkSession, "topk"), k + 1
    vectors = scratch.keep(whole_numbers(table, id_col, vector_col), "vectors")
    order = dimension_order(vectors) or [0]
    asks = F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False))
    # of each distinct vector the m smallest rows, and whether any row of it is a query
    w = Window.partitionBy("x").orderBy(F.asc_nulls_last("id"), "r")
    members = scratch.keep(vectors.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= m), "firsts")
    asked = vectors.filter(asks).select("x").distinct().withColumn("asked", F.lit(True))
    lead = members.filter("place = 1").select("x", F.coalesce("id", F.lit(LAST)).alias("low")).join(asked, "x", "left")
    distinct = scratch.keep(lead.select(F.monotonically_increasing_id().alias("c"), "low", "x", F.coalesce("asked", F.lit(False)).alias("asked")), "distinct")

    candidates, ends, norms = blocks(distinct, BLOCK, order, scratch, "candidates")
    questions, question_ends, _ = blocks(distinct.filter("asked"), QUERIES, order, scratch, "questions")
    candidates = candidates.select(F.col("block").alias("cb"), "c", "low", "cols")
    questions = questions.select(F.col("block").alias("qb"), F.col("c").alias("qc"), F.col("cols").alias("qcols"))

    # thresholds: the m-th best score in the candidates' first block, which has the largest norms and goes to every block of queries
    each = F.explode(F.sequence(F.lit(0), F.lit(max(1, *question_ends[-1:], 1) - 1)))
    first = questions.withColumn("need", F.transform("qc", lambda _: F.lit(-math.inf))).join(candidates.filter("cb = 0").withColumn("qb", each), "qb")
    seeds = scratch.keep(best(meet(first, m), m), "seeds")
    need = seeds.filter(F.col("place") == m).select("q", F.col("score").cast("double").alias("need"))
    need = questions.select("qb", F.posexplode("qc").alias("i", "q")).join(need, "q", "left").withColumn("need", F.coalesce("need", F.lit(-math.inf)))
    need = need.groupBy("qb").agg(F.array_sort(F.collect_list(F.struct("i", "need"))).alias("n")).select("qb", F.transform("n", lambda v: v["need"]).alias("need"))
    questions = scratch.keep(questions.join(need, "qb"), "thresholds")

    # a block of queries meets the blocks of the partitions whose largest norm lets a score reach one of its thresholds
    square = lambda i: F.aggregate("qcols", F.lit(0.0), lambda a, col: a + F.pow(col[i].cast("double"), 2))
    lengths = F.transform(F.sequence(F.lit(0), F.size("qc") - 1), lambda i: F.sqrt(square(i)))
    least = F.array_min(F.zip_with("need", lengths, lambda t, n: F.when(n > 0, t / n).otherwise(F.lit(-math.inf))))
    within = F.size(F.filter(numbers([n * (1 + 1e-9) + 1e-6 for n in norms]), lambda n: n >= F.col("least")))
    cells = questions.withColumn("least", least).withColumn("stop", F.element_at(numbers([0, *ends]), within + 1).cast("int")).filter("stop > 1")
    cells = cells.select("qb", "qc", "qcols", "need", F.explode(F.expr("sequence(1, stop - 1)")).alias("cb"))
    # blocks are small once compressed and take long to meet: they are neither broadcast nor their partitions merged by size
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(tasks, "cb").join(candidates.repartition(tasks, "cb").hint("merge"), "cb")
    found = scratch.keep(best(meet(cells, m).unionByName(seeds.drop("place")), m).select("q", "c", "score"), "found")

    # back to rows: the members of the winning vectors, ranked again, less the query itself
    named = distinct.select("c", "x")
    of_members = scratch.keep(members.join(named, "x").select("c", "r", "id"), "members")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "r")
    rows_of = (found.join(of_members, "c").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= m)
               .select("q", "r", "id", "score"))
    answers = rows_of.groupBy("q").agg(F.collect_list(F.struct(F.negative("score").alias("s"), F.col("id").isNull().alias("last"), "id", "r")).alias("answers"))
    queries = vectors.filter(asks).join(named, "x").select(F.col("c").alias("q"), F.col("id").alias("query_id"), F.col("r").alias("own"))
    mine = F.slice(F.array_sort(F.filter("answers", lambda a: a["r"] != F.col("own"))), 1, k)
    return (queries.join(scratch.keep(answers, "answers"), "q").select("query_id", F.posexplode(mine).alias("i", "a"))
            .select("query_id", (F.col("i") + 1).alias("rank"), F.col("a.id").alias(id_col), F.negative("a.s").alias("score")))

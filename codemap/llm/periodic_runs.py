"""Periodic runs of words: stretches that repeat with a period, found on tiles by octaves of the period.

A run of a sequence of words is a maximal stretch with smallest period q (words q apart are equal) of at least ``least``
words and three periods. Finding all of them in one piece costs a task the whole document for every scale, so:

1. Octaves. Periods are handled in octaves [S, 2S), the first one being all periods below 16. An octave has an anchor every
   S words. A run holds at least one anchor b with b + q in the run, too, such that the GRAM words from both places are equal.
   Which anchors recur at a distance of the octave is looked up in the sorted hashes of the document's word strings (a hash can only add
   anchors that the next step refutes), so text that does not repeat makes no tile.
2. Tiles. A document is exploded into overlapping tiles, TILE anchors long, for each octave with active anchors: rows of their own,
   dealt out over all tasks whatever document they come from.
3. Boundary Z-functions. At an active anchor, the Z-function of the words after it and that of the words before it tell, for each period of the
   octave, how far the words q apart are equal to the right and to the left. Both reach beyond the next anchor.
4. Stitching. Fragments are shuffled by document and period. Neighbouring anchors' fragments of one run overlap by a period or more,
   those of different runs by less, so merging gives the maximal stretches. Multiples of the period of a run give the
   same stretch, of which the smallest period is kept.

A period's row count is at most a fragment per tile, so no group grows faster than its document.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codemap.llm.common import Scratch, map_batches, rows

GRAM = 8
FIRST = 8
TILE = 16
LEAST = 24
PERIODS = 3
MIX = np.uint64(0x9E3779B97F4A7C15)

SCAN = "id long, n_words long, words string, words_sha256 string, tiles array<struct<step:int, start:int, anchors:array<int>, ids:array<int>>>"


def octaves(n: int):
    """(step, lowest period, highest period + 1) of the octaves that a sequence of n words can have runs in."""
    yield FIRST, 1, 2 * FIRST
    step = 2 * FIRST
    while PERIODS * step <= n:
        yield step, step, 2 * step
        step *= 2


def word_ids(words: list[bytes]) -> np.ndarray:
    """The words as numbers by first occurrence."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)


def tiles_of(ids: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(step, start, anchors, ids) of the tiles of a sequence; anchors count from the tile's start."""
    n = len(ids)
    if n < LEAST:
        return []
    hashes = np.zeros(n - GRAM + 1, np.uint64)
    spread = ids.astype(np.uint64) * MIX
    spread ^= spread >> np.uint64(31)
    for i in range(GRAM):
        hashes = (hashes ^ spread[i:i + len(hashes)]) * MIX
        hashes ^= hashes >> np.uint64(29)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    change = ranked[1:] != ranked[:-1]
    if change.all():
        return []
    rank = np.concatenate(([0], np.cumsum(change)))
    places = rank * n + order  # ascending: by string, then by place
    base = np.empty(len(hashes), np.int64)
    base[order] = rank * n
    out = []
    for step, low, high in octaves(n):
        anchors = np.arange(0, len(hashes), step)
        at = np.searchsorted(places, base[anchors] + anchors + low)
        after = places[np.minimum(at, len(places) - 1)]
        limit = base[anchors] + np.minimum(anchors + high, n)
        active = anchors[(at < len(places)) & (base[anchors] + anchors + low < limit) & (after >= base[anchors] + anchors + low) & (after < limit)]
        span = TILE * step
        for t in np.unique(active // span).tolist():
            start, stop = max(0, t * span - step), min(n, (t + 1) * span + 2 * step + GRAM)
            out.append((step, start, active[active // span == t] - start, ids[start:stop]))
    return out


def z_function(s: list, upto: int) -> list[int]:
    """For the first ``upto`` places of s, how many items from there equal the first ones of s (0 at the start itself)."""
    n, z = len(s), [0] * min(upto, len(s))
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def fragments(step: int, start: int, anchors: list[int], ids: list[int]) -> list[tuple[int, int, int]]:
    """(period, start, stop) of the stretches that the Z-functions at a tile's anchors find; merged within the tile."""
    low, high = (1, 2 * FIRST) if step == FIRST else (step, 2 * step)
    found: dict[int, list[list[int]]] = {}
    for b in anchors:
        ahead = z_function(ids[b:b + high + step + GRAM], high)
        periods = [q for q in range(low, len(ahead)) if ahead[q] >= GRAM]
        if not periods:
            continue
        edge = max(0, b - step)
        before, behind = ids[edge:b][::-1], ids[edge:b + high - 1][::-1]
        back = z_function([*before, -1, *behind], len(before) + 1 + high - low)
        # the place p = b + q - 1 is len(behind) - 1 - (p - edge) from the start of behind
        first = len(before) + 1 + len(behind) - (b - edge)
        for q in periods:
            lo, hi = start + b - back[first - q], start + b + q + ahead[q]
            merged = found.setdefault(q, [])
            if merged and lo <= merged[-1][1] - q:
                merged[-1] = [min(lo, merged[-1][0]), max(hi, merged[-1][1])]
            else:
                merged.append([lo, hi])
    return [(q, lo, hi) for q, merged in found.items() for lo, hi in merged]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's number of words, the SHA-256 of its words joined by spaces, and its tiles.

    ``words`` (the joined words) only stands where there are tiles: other documents cannot hold a run.
    """
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in rows(batch, "id", "text"):
                words = (text or "").encode("utf-8", "replace").split()
                joined = b" ".join(words)
                tiles = tiles_of(word_ids(words)) if len(words) >= LEAST else []
                for column, value in zip(out, (doc, len(words), joined.decode("utf-8", "replace") if tiles else None, hashlib.sha256(joined).hexdigest(),
                                               [{"step": s, "start": a, "anchors": b, "ids": i} for s, a, b, i in tiles])):
                    column.append(value)
            tile = pa.struct([("step", pa.int32()), ("start", pa.int32()), ("anchors", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(tile))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=["id", "n_words", "words", "words_sha256", "tiles"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_batches(source, run, SCAN).withColumn("k", F.monotonically_increasing_id())


def solve(tiles: DataFrame) -> DataFrame:
    """(k, period, start, stop) of the fragments in tiles (k, step, start, anchors, ids)."""
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for k, *tile in rows(batch, "k", "step", "start", "anchors", "ids"):
                out += [(k, *f) for f in fragments(*tile)]
            yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["k", "period", "start", "stop"])

    return map_batches(tiles, run, "k long, period long, start long, stop long")


def stitch(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(k, start, length, period) of the runs that fragments (k, period, start, stop) are parts of."""
    by = Window.partitionBy("k", "period").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = found.withColumn("cut", F.coalesce(F.col("start") > reach - F.col("period"), F.lit(True)).cast("int"))
    whole = (cut.withColumn("island", F.sum("cut").over(by)).groupBy("k", "period", "island")
             .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
             .filter(F.col("stop") - F.col("start") >= F.greatest(F.lit(least), PERIODS * F.col("period"))))
    return (whole.groupBy("k", "start", "stop").agg(F.min("period").alias("period"))
            .select("k", "start", (F.col("stop") - F.col("start")).alias("length"), "period"))


def kept_words(words: list[str], runs: list[dict]) -> list[str]:
    """The words without those that a run repeats: of each run the first period stays, unless another run drops it."""
    stays = np.ones(len(words), bool)
    for r in runs:
        stays[r["start"] + r["period"]:r["start"] + r["length"]] = False
    return [w for w, s in zip(words, stays.tolist()) if s]


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed, collapsed_sha256) for every row of docs.

    ``runs``: array of (start, period, length), by start, then period; empty if there is none. ``collapsed``: the words that stay, joined by
    one space; null for a document without runs, whose words all stay. ``collapsed_sha256`` is never null. A null text is empty; equal rows and
    rows with equal or null ids are handled each on its own; other columns of docs are not read. Words are told apart by their bytes.
    """
    scratch = Scratch(docs.sparkSession, "periodic-runs")
    seen = scratch.keep(scan(docs, id_col, text_col), "scan")
    tiles = seen.filter(F.size("tiles") > 0).select("k", F.explode("tiles").alias("t")).select("k", "t.*")
    # tiles take far more time for their bytes than other rows, so their partitions are not merged by size
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.keep(solve(tiles.repartition(parts, "k", "step", "start")), "fragments")
    runs = scratch.keep(stitch(found).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs")), "runs")
    scratch.drop("fragments")

    def shorten(batches):
        for batch in batches:
            keys, texts = [], []
            for k, words, of in rows(batch, "k", "words", "runs"):
                keys.append(k)
                texts.append(" ".join(kept_words(words.split(" "), of)))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["k", "collapsed"])

    short = map_batches(seen.filter("words is not null").select("k", "words").join(runs, "k"), shorten, "k long, collapsed string")
    short = scratch.keep(short.join(runs, "k"), "collapsed")
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    return (seen.select("k", "id", "n_words", "words_sha256").join(short, "k", "left")
            .select(F.col("id").alias(id_col), "n_words", F.coalesce("runs", none).alias("runs"), "collapsed",
                    F.coalesce(F.sha2(F.col("collapsed"), 256), F.col("words_sha256")).alias("collapsed_sha256")))

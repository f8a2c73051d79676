"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids, documents longer than a sequence are cut, and the pieces are packed.
Pieces are dealt to shards of a bounded size by a hash of their row number. A shard is packed by several
islands, each a Spark group of its own: a population of packings made by best fit in different orders, bred
by grouping crossover (whole well-filled bins of one parent are injected into the other, bins that
would hold a piece twice are dissolved, and displaced pieces go back by best fit, longest first).
Between epochs the elite of every island migrates to the next one as rows. The worst-filled bin of each
shard is then opened again and packed together with those of other shards, level by level, so that
sharding costs no sequence for each shard. Only lengths and row numbers take part, never ids or texts.
"""
from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codemap.llm.common import Scratch, chunks, map_batches, rows

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Entries of a worker's cache of parts; a full cache keeps what the next texts need.
CACHED = 1_000_000
#: The vocabulary's own rule for cutting normalised text into parts; fixed value.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Text without these is composed already, its lower case is by character, and the rule's classes are the ones below.
_BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
_LETTERS, _NUMBERS, _SPACES = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
_LATIN_PARTS = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


class WordIds:
    """Ids (little-endian uint32 bytes) of texts, part by part.

    The tokenizer cuts normalised text into parts (runs of letters, digits, runs of signs), drops white space and applies its
    merges within a part. Texts are cut by the same rule and the parts looked up; only new ones go through the merges, many in one call.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers
        whole = Tokenizer.from_file(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))
        self.normalizer = whole.normalizer
        self.merges = Tokenizer(whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.parts: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """The parts of a text after normalisation."""
        low = text.lower()
        if _BEYOND_LATIN.search(low) or _BEYOND_LATIN.search(text):
            return _PARTS.findall(self.normalizer.normalize_str(text))
        return _LATIN_PARTS.findall(low)

    def learn(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 512):
            some = parts[i:i + 512]
            found = self.merges.encode(" ".join(some), add_special_tokens=False)
            ids, ends = np.array(found.ids, "<u4").tobytes(), np.cumsum(4 * np.bincount(found.word_ids, minlength=len(some))).tolist()
            self.parts.update(zip(some, (ids[a:b] for a, b in zip([0, *ends], ends))))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.cut(t) if t else [] for t in texts]
        needed = set().union(*cut)
        if len(self.parts) + len(needed) > CACHED:
            self.parts = {p: ids for p, ids in self.parts.items() if p in needed}
        self.learn([p for p in needed if p not in self.parts])
        known = self.parts.__getitem__
        return [b"".join(map(known, parts)) for parts in cut]


_WORKER: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """The worker's WordIds of a vocabulary; tasks that a worker runs one after the other share its caches."""
    if vocabulary not in _WORKER:
        _WORKER[vocabulary] = WordIds(vocabulary)
    return _WORKER[vocabulary]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, vocabulary: str = VOCABULARY,
           end_id: int = END_ID) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): every document's ids and the end id, cut at capacity.

    A null text is empty, so it is the end id alone.
    """
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, end = word_ids(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for part in chunks(rows(batch, "id", "text"), 1_000_000, lambda r: len(r[1] or "")):
                for (doc, _), ids in zip(part, ids_of([t for _, t in part])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at:at + 4 * capacity]
                        out.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=[id_col, "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(source, run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """A packing of items (indexes into lengths) that best-fits further items."""

    def __init__(self, lengths: list[int], capacity: int, bins=()):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.open = 0
        for items in bins:
            self._add(list(items), capacity - sum(lengths[i] for i in items))

    def _add(self, items: list[int], free: int) -> None:
        self.bins.append(items)
        self.by_free[free].append(len(self.bins) - 1)
        self.open |= 1 << free

    def fit(self, items) -> "Bins":
        """Each item into the fullest bin that takes it, else into a new one."""
        for i in items:
            n = self.lengths[i]
            room = self.open >> n
            if not room:
                self._add([i], self.capacity - n)
                continue
            free = n + (room & -room).bit_length() - 1
            stack = self.by_free[free]
            b = stack.pop()
            if not stack:
                self.open &= ~(1 << free)
            self.bins[b].append(i)
            self.by_free[free - n].append(b)
            self.open |= 1 << (free - n)
        return self


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, unevenly filled bins (their squares' mean) leave more to gain."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(into: list[list[int]], giver: list[list[int]], lengths: list[int], capacity: int, rnd: random.Random) -> list[list[int]]:
    """Whole well-filled bins of giver, what they leave untouched of into, and the displaced pieces by best fit."""
    filled = sorted(giver, key=lambda b: -sum(lengths[i] for i in b))
    injected = [b for b in filled[: max(1, len(filled) // 2)] if rnd.random() < 0.5]
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in into:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    # also open the emptiest bins that are left, so that the displaced pieces can recombine
    kept.sort(key=lambda b: -sum(lengths[i] for i in b))
    for b in kept[len(kept) - max(1, len(kept) // 50):]:
        displaced += b
    kept = kept[: len(kept) - max(1, len(kept) // 50)] if kept else kept
    displaced.sort(key=lambda i: -lengths[i])
    return Bins(lengths, capacity, injected + kept).fit(displaced).bins


def evolve(lengths: list[int], capacity: int, seeds: list[list[list[int]]], seed: int, population: int = 10, patience: int = 30, generations: int = 1000) -> list[list[int]]:
    """The best packing of an island once ``patience`` generations on end have not bettered it (``generations`` at most); at once if a packing meets the lower bound."""
    rnd = random.Random(seed)
    bound = -(-sum(lengths) // capacity)
    falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    pool = [[list(b) for b in s] for s in seeds] or [Bins(lengths, capacity).fit(falling).bins]
    score = lambda bins: fitness(bins, lengths, capacity)
    if min(map(len, pool)) <= bound:
        return min(pool, key=len)
    while len(pool) < population:
        jitter = {i: lengths[i] * rnd.uniform(0.9, 1.0) for i in falling}
        pool.append(Bins(lengths, capacity).fit(sorted(falling, key=lambda i: -jitter[i])).bins)
    rated = sorted(((score(bins), i, bins) for i, bins in enumerate(pool)), reverse=True)
    idle = 0
    for i in range(generations):
        if len(rated[0][2]) <= bound or idle >= patience:
            break
        a, b = rnd.sample(range(len(rated)), 2)
        child = crossover(rated[a][2], rated[b][2], lengths, capacity, rnd)
        rating = score(child)
        idle = 0 if rating > rated[0][0] else idle + 1
        if rating > rated[-1][0]:
            rated[-1] = rating, population + i, child
            rated.sort(reverse=True)
    return rated[0][2]


def _epoch(frame: pd.DataFrame, capacity: int, epoch: int) -> pd.DataFrame:
    """One island: rows of one shard, each piece once per seed packing (seed -1: no packing yet)."""
    shard, island = int(frame["shard"].iloc[0]), int(frame["island"].iloc[0])
    one = frame[frame["seed"] == frame["seed"].iloc[0]].sort_values("rid")
    rids, lengths = one["rid"].tolist(), one["length"].tolist()
    at, seeds = {r: i for i, r in enumerate(rids)}, []
    for seed, packed in frame[frame["seed"] >= 0].sort_values(["seed", "rid"]).groupby("seed"):
        bins = defaultdict(list)
        for rid, b in zip(packed["rid"].tolist(), packed["bin"].tolist()):
            bins[b].append(at[rid])
        seeds.append(list(bins.values()))
    best = evolve(lengths, capacity, seeds, seed=1_000_003 * shard + 1009 * island + epoch)
    number = np.empty(len(rids), np.int64)
    for b, items in enumerate(sorted(best, key=lambda items: (-sum(lengths[i] for i in items), items[0]))):
        number[items] = b
    return pd.DataFrame({"shard": shard, "island": island, "rid": rids, "length": lengths, "bin": number})


def _packed(items: DataFrame, capacity: int, islands: int, epochs: int, scratch: Scratch, name: str) -> DataFrame:
    """(shard, rid, length, bin): the best island's packing of each shard of items (shard, rid, length)."""
    state = items.select("shard", "rid", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))).alias("island"),
                         F.lit(-1).cast("long").alias("seed"), F.lit(-1).cast("long").alias("bin"))
    schema = "shard long, island long, rid long, length long, bin long"
    for epoch in range(epochs):
        def island(frame: pd.DataFrame, *, epoch: int = epoch) -> pd.DataFrame:
            return _epoch(frame, capacity, epoch)

        done = scratch.keep(state.groupBy("shard", "island").applyInPandas(island, schema), f"{name}-epoch-{epoch}")
        state = (done.withColumn("seed", F.col("island")).unionByName(
            done.withColumn("seed", F.col("island")).withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))) if islands > 1
            else done.withColumn("seed", F.col("island")))
    best = (done.groupBy("shard", "island").agg((F.max("bin") + 1).alias("n")).groupBy("shard")
            .agg(F.min(F.struct("n", "island")).alias("best")).select("shard", F.col("best.island").alias("island")))
    return done.join(best, ["shard", "island"]).select("shard", "rid", "length", "bin")


def pack(found: DataFrame, capacity: int = 4096, shard_rows: int = 4096, islands: int = 2, epochs: int = 2) -> DataFrame:
    """``found`` (with a length of 1 to capacity) and, for each row, sequence_id and its offset in the sequence.

    Rows of a sequence add up to capacity at most and lie one after the other from 0. Equal and repeated
    rows are packed one by one; an empty table gives an empty result. Same input files, same packing.
    """
    scratch = Scratch(found.sparkSession, "packing")
    found = scratch.keep(found.withColumn("__rid", F.monotonically_increasing_id()), "pieces")
    whole = found.filter(F.col("length") >= capacity)
    small = found.filter(F.col("length") < capacity)
    shards, level, parts = max(1, math.ceil(small.count() / shard_rows)), 0, []
    items = small.select(F.pmod(F.xxhash64("__rid"), F.lit(shards)).alias("shard"), F.col("__rid").alias("rid"), "length")
    while True:
        packed = scratch.keep(_packed(items, capacity, islands, epochs, scratch, f"level-{level}"), f"packed-{level}")
        number = F.lit(level).cast("long") * (1 << 56) + F.col("shard") * (1 << 24) + F.col("bin")
        if shards == 1:
            parts.append(packed.select("rid", number.alias("sequence_id")))
            break
        last = packed.groupBy("shard").agg(F.max("bin").alias("last"))  # the bins are numbered from the fullest
        marked = packed.join(last, "shard")
        parts.append(marked.filter("bin < last").select("rid", number.alias("sequence_id")))
        shards = math.ceil(shards / 64)
        items = marked.filter("bin = last").select(F.pmod(F.xxhash64("shard"), F.lit(shards)).alias("shard"), "rid", "length")
        level += 1
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    numbered = (small.join(placed, F.col("__rid") == F.col("rid")).drop("rid")
                .unionByName(whole.withColumn("sequence_id", F.lit((1 << 62)) + F.col("__rid"))))
    order = Window.partitionBy("sequence_id").orderBy("__rid").rowsBetween(Window.unboundedPreceding, -1)
    return numbered.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).drop("__rid")

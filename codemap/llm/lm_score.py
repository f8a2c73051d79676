"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

A word's score is the relative frequency c(n-gram) / c(context) of the longest n-gram that ends in it and occurs, times
``alpha`` for every order given up; counts leave out the document's own occurrences, so nothing is scored by itself.

1. Documents are encoded into blocks (word numbers and word hashes) of a bounded number of words.
2. Every block posts its distinct n-grams with their counts, cut into the partitions of the count table by hash. A frequent n-gram
   is one entry of a block however many documents have it, so no partition is hot.
3. A partition of the count table adds up the counts and answers every block that asked, in the order of its n-grams.
4. Answers and blocks meet by block; n-grams of each document are joined to the counts by position, and scores are summed per document.

The tables grow with the corpus and are shuffled by hash; neither the driver nor any task holds one whole.
"""
from __future__ import annotations

import uuid
from itertools import count as counter
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemap.llm.common import Scratch, chunks, map_batches, rows

ALPHA = 0.4
BLOCK_BYTES = 8 << 20
PARTITION_ENTRIES = 1 << 22
#: Bits of an n-gram's key: with 10^12 different n-grams, one in 70,000 shares its key with another.
KEY_BITS = 56
_M = np.uint64(0x9E3779B97F4A7C15)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, word numbers in order, hashes by word number)."""
    numbers: dict[bytes, int] = defaultdict(counter().__next__)
    sizes, parts = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "replace").split()
        sizes[i] = len(words)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
    words = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    order = np.argsort(-np.bincount(words, minlength=len(hashes)), kind="stable")  # frequent words get small numbers
    number = np.empty(len(hashes), np.uint32)
    number[order] = np.arange(len(hashes), dtype=np.uint32)
    return sizes, number[words], hashes[order]


class Ngrams:
    """The n-grams of one order of a block: where they end, which distinct one each is, and its count in its document."""

    def __init__(self, n: int, sizes: np.ndarray, words: np.ndarray, hashes: np.ndarray):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.at = np.flatnonzero(place >= n - 1)
        key = np.zeros(len(self.at), np.uint64)
        for i in range(n):
            key = (key ^ hashes[words[self.at - (n - 1 - i)]]) * _M
            key ^= key >> np.uint64(31)
        key >>= np.uint64(64 - KEY_BITS)
        order = np.argsort(key, kind="stable")  # within an n-gram, documents stay in order
        key, doc = key[order], doc[self.at][order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        own = new.copy()
        own[1:] |= doc[1:] != doc[:-1]
        self.distinct = key[new]
        self.counts = np.diff(np.append(np.flatnonzero(new), len(key)))
        runs = np.diff(np.append(np.flatnonzero(own), len(key)))
        self.which, self.own = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.own[order] = np.repeat(runs, runs)


def planes(values: np.ndarray) -> bytes:
    """Integers as one plane for each of their bytes: the upper ones are almost all zero and compress."""
    size = values.dtype.itemsize
    return values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def from_planes(data, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in 4 + 1 bytes; in 8 if one is larger."""
    steps = np.diff(keys, prepend=np.uint64(0))
    if len(steps) and steps[1:].max(initial=0) < 1 << 40:
        return b"\5" + keys[:1].tobytes() + steps[1:].astype("<u4").tobytes() + (steps[1:] >> np.uint64(32)).astype("u1").tobytes()
    return b"\10" + keys.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[0] == 8:
        return np.frombuffer(data, np.uint64, offset=1)
    n = (len(data) - 9) // 5
    steps = np.empty(n + 1, np.uint64)
    steps[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    steps[1:] = np.frombuffer(data, "<u4", n, 9).astype(np.uint64) | np.frombuffer(data, "u1", n, 9 + 4 * n).astype(np.uint64) << np.uint64(32)
    return np.cumsum(steps, dtype=np.uint64)


def _small(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + planes(values.astype(kind))


def _wide(data: bytes) -> np.ndarray:
    return from_planes(memoryview(data)[1:], data[0]).astype(np.int64)


BLOCKS = "block long, ids binary, nulls binary, sizes binary, words binary, hashes binary, n long"


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        def records():
            for batch in batches:
                yield from rows(batch, "id", "text")

        for part in chunks(records(), BLOCK_BYTES, lambda r: len(r[1] or "") + 8):
            sizes, words, hashes = encode([t for _, t in part])
            ids = np.array([i or 0 for i, _ in part], np.int64)
            cols = [[uuid.uuid4().int >> 65], [ids.tobytes()], [np.array([i is None for i, _ in part]).tobytes()], [sizes.tobytes()], [planes(words)], [hashes.tobytes()], [len(words)]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.binary()] * 5, pa.int64()))], names=["block", "ids", "nulls", "sizes", "words", "hashes", "n"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(source, run, BLOCKS)


def _arrays(sizes: bytes, words: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(sizes, np.int64), from_planes(words, 4), np.frombuffer(hashes, np.uint64)


def _posted(blocks: DataFrame, order: int, partitions: int) -> DataFrame:
    """(part, block, n, keys, counts): the entries of a block in a partition of the count table."""
    edges = np.array([(i << KEY_BITS) // partitions for i in range(1, partitions)], np.uint64)

    def run(batches):
        for batch in batches:
            for block, *arrays in rows(batch, "block", "sizes", "words", "hashes"):
                out = []
                for n in range(1, order + 1):
                    grams = Ngrams(n, *_arrays(*arrays))
                    cut = [0, *np.searchsorted(grams.distinct, edges).tolist(), len(grams.distinct)]
                    out += [(p, block, n, packed(grams.distinct[a:b]), _small(grams.counts[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["part", "block", "n", "keys", "counts"])

    return map_batches(blocks.select("block", "sizes", "words", "hashes"), run, "part int, block long, n int, keys binary, counts binary")


def _answer(table: pa.Table) -> pa.Table:
    """One partition of the count table: the total counts of what each block asked, in its order."""
    out = []
    asked = table.to_pylist()
    for n in sorted({r["n"] for r in asked}):
        mine = [r for r in asked if r["n"] == n]
        keys = [unpacked(r["keys"]) for r in mine]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(which, weights=np.concatenate([_wide(r["counts"]) for r in mine])).astype(np.int64)
        at = 0
        for r, k in zip(mine, keys):
            out.append({"block": r["block"], "n": n, "part": r["part"], "totals": _small(totals[which[at:at + len(k)]])})
            at += len(k)
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("n", pa.int32()), ("part", pa.int32()), ("totals", pa.binary())]))


def block_scores(sizes: np.ndarray, words: np.ndarray, hashes: np.ndarray, totals: dict[int, np.ndarray], order: int, corpus_words: int, alpha: float) -> np.ndarray:
    """Sum of the log scores of each document of a block; totals: by order, the counts of the block's distinct n-grams."""
    rest = (corpus_words - np.repeat(sizes, sizes)).astype(np.float64)  # words of the other documents
    score = np.zeros(len(words))
    open_ = np.ones(len(words), bool)
    grams = {}
    for n in range(1, order + 1):
        g = Ngrams(n, sizes, words, hashes)
        others = np.zeros(len(words), np.int64)
        others[g.at] = totals[n][g.which] - g.own
        grams[n] = others, g.at
    longest = np.zeros(len(words), np.int64)  # order that a word starts from
    for n in range(1, order + 1):
        longest[grams[n][1]] = n
    for n in range(order, 0, -1):
        others = grams[n][0]
        hit = open_ & (others > 0)
        if n > 1:  # the context ends one word before
            at = np.flatnonzero(hit)
            score[at] = np.log(others[at] / grams[n - 1][0][at - 1])
        else:
            at = np.flatnonzero(hit)
            score[at] = np.log(others[at] / rest[at])
        score[at] += (longest[at] - n) * np.log(alpha)
        open_ &= ~hit
    at = np.flatnonzero(open_)  # in no other document
    score[at] = longest[at] * np.log(alpha) - np.log(np.maximum(rest[at], 1))
    return np.add.reduceat(np.append(score, 0), np.cumsum(sizes) - sizes) * (sizes > 0) if len(sizes) else np.empty(0)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, alpha: float = ALPHA) -> DataFrame:
    """(id_col, n_words, log_score, mean_log_score) of every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`. Counts are over all rows but the scored one (repeated rows count each other). A word in
    no other row scores alpha^(orders tried) / (their number of words, at least 1). A text without a word, or null, has
    log_score 0 and a null mean. Null ids stay; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = scratch.keep(blocks_of(docs, id_col, text_col), "blocks")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    partitions = max(1, -(-total * order // PARTITION_ENTRIES))
    posted = _posted(blocks, order, partitions)
    answers = posted.groupBy("part").applyInArrow(_answer, "block long, n int, part int, totals binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for b in left.to_pylist():
            arrays = _arrays(b["sizes"], b["words"], b["hashes"])
            got = sorted((r["n"], r["part"], r["totals"]) for r in right.to_pylist())
            totals = {n: np.concatenate([_wide(t) for m, _, t in got if m == n] or [np.empty(0, np.int64)]) for n in range(1, order + 1)}
            sums = block_scores(*arrays, totals, order, total, alpha)
            ids = pa.array(np.frombuffer(b["ids"], np.int64), mask=np.frombuffer(b["nulls"], bool))
            out.append(pa.table([ids, pa.array(arrays[0]), pa.array(sums)], names=[id_col, "n_words", "log_score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=[id_col, "n_words", "log_score"])

    done = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"`{id_col}` long, n_words long, log_score double")
    return done.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))

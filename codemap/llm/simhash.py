"""Near duplicates by SimHash: a byte-position inverted index with count filtering.

A document's fingerprint has 64 bits in 8 positional bytes. Fingerprints that differ in at most
``max_bits`` bits differ in at most ``max_bits`` bytes, so they share at least 8 - max_bits
positional bytes: that is the guaranteed minimum. Single bytes are useless as posting keys (256
values, so a posting holds a fixed share of the corpus); the index therefore posts every fingerprint
under each choice of that many positions together with their bytes. All members of such a posting
have reached the minimum count on those positions, and they can differ only in the ``max_bits`` free
bytes, so a posting of distinct fingerprints has a fixed bound (65,536 for two free bytes) however
large the corpus is. Inside a posting, members are looked up by their free bytes under every allowed
difference (137 masks for two bits) instead of pair by pair; the tally of shared positional bytes and
the bit distance are checked, and a pair is given by one posting only.

Skew: copies collapse to one fingerprint with partial aggregation before anything is posted, and the
way back from fingerprints to documents is a join that adaptive execution can split.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemap.llm.common import Scratch, components, fresh, map_batches, named, rows, shingle_hashes

SEED = 42


def fingerprint(text: str | None, ngram: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (repeats count), unsigned; 0 without a word."""
    hashes = shingle_hashes((text or "").encode("utf-8", "replace").lower().split(), ngram,
                            lambda b: xxhash.xxh64_intdigest(b, SEED))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i:i + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """(id, t, fp) of every row: its id, a hash that tells texts of one id apart, its fingerprint; a null text counts as empty."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, ngram) for (t,) in rows(batch, "text")]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "t", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return map_batches(source, run, "id long, t long, fp long")


def _masks(max_bits: int) -> np.ndarray:
    """Differences of 1 to max_bits bits within the free bytes."""
    bits = 8 * max_bits
    return np.array([sum(1 << b for b in pick) for n in range(1, max_bits + 1) for pick in combinations(range(bits), n)], np.int64)


def posting_links(members: np.ndarray, free: tuple[int, ...], masks: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct fingerprints of one posting within max_bits bits, that this posting has to give.

    ``free`` are the byte positions in which members may differ. A pair that differs in fewer bytes
    stands in several postings; the one whose free positions come first in order gives it.
    """
    octets = members.view(np.uint8).reshape(-1, 8)
    key = np.zeros(len(members), np.int64)
    for i, p in enumerate(free):
        key |= octets[:, p].astype(np.int64) << (8 * i)
    order = np.argsort(key)
    ordered = key[order]
    left, right = [], []
    for mask in masks:
        want = key ^ mask
        at = np.minimum(np.searchsorted(ordered, want), len(ordered) - 1)
        hit = np.flatnonzero((ordered[at] == want) & (key < want))
        left.append(hit)
        right.append(order[at[hit]])
    a, b = members[np.concatenate(left)], members[np.concatenate(right)]
    differs = (a ^ b).view(np.uint8).reshape(-1, 8) != 0
    tally = 8 - differs.sum(axis=1)
    distance = np.bitwise_count(a ^ b)
    first = np.zeros(len(a), bool)
    for choice in combinations(range(8), len(free)):
        inside = ~differs[:, [p for p in range(8) if p not in choice]].any(axis=1)
        if choice == free:
            first = inside & ~first
            break
        first |= inside
    good = first & (tally >= 8 - max_bits) & (distance <= max_bits)
    return a[good], b[good]


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v): every pair of distinct fingerprints (column fp) within max_bits bits, once."""
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    choices = list(combinations(range(8), max_bits))
    keep = [sum(0xFF << (8 * p) for p in range(8) if p not in c) for c in choices]
    signed = [k - (1 << 64) if k >> 63 else k for k in keep]
    posted = F.explode(F.array(*(F.struct(F.lit(i).cast("tinyint").alias("c"), F.col("fp").bitwiseAND(F.lit(k)).alias("bytes"))
                                 for i, k in enumerate(signed))))
    lists = (distinct.select("fp", posted.alias("k")).groupBy("k.c", "k.bytes")
             .agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1).select("c", "members"))

    def run(batches):
        masks = _masks(max_bits)
        for batch in batches:
            found = [posting_links(np.array(m, np.int64).view(np.uint64), choices[c], masks, max_bits) for c, m in rows(batch, "c", "members")]
            u, v = (np.concatenate([f[i] for f in found] or [np.empty(0, np.uint64)]).view(np.int64) for i in (0, 1))
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return map_batches(lists, run, "u long, v long")


def _labelled(docs: DataFrame, id_col: str, text_col: str, ngram: int, max_bits: int) -> DataFrame:
    """(id, t, fp, least): every row with the smallest (no_id, id, t) of its component; a null id comes last."""
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.keep(fingerprints(docs, id_col, text_col, ngram), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "t"))
    distinct = scratch.keep(each.groupBy("fp").agg(least.alias("least")), "distinct")
    roots = components(links(distinct, max_bits), scratch).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("least"))
    labels = scratch.keep(rooted.select("fp", "root").join(firsts, "root").select("fp", "least"), "labels")
    return each.join(labels, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, max_bits: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row; linked if within max_bits bits, transitively.

    component_id is the smallest id of the component. Null and empty texts have fingerprint 0 and are
    linked like any other; a null id is never a component's id unless all its ids are null. Repeated
    rows each give a row. An empty table gives an empty result; further columns are ignored.
    """
    return _labelled(docs, id_col, text_col, ngram, max_bits).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of docs, one for each component: that of its smallest id (of equal ids, any one of one text).

    Rows without an id cannot be named and stay. All columns stay as they are, whatever their names; an empty table stays empty.
    """
    with_id = docs.filter(named(id_col).isNotNull())
    key = fresh(docs.columns, "key_id", "key_text")
    stay = (_labelled(with_id, id_col, text_col, ngram, max_bits).filter((F.col("id") == F.col("least.id")) & (F.col("t") == F.col("least.t")))
            .select(F.col("id").alias(key[0]), F.col("t").alias(key[1])).distinct())
    keyed = with_id.withColumn(key[0], named(id_col).cast("long")).withColumn(key[1], F.xxhash64(named(text_col)))
    one = keyed.join(stay, key, "left_semi").dropDuplicates(key)
    return one.select([named(c) for c in docs.columns]).unionByName(docs.filter(named(id_col).isNull()))

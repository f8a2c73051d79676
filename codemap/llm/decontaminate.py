"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Containment asks how many of a short item's shingles a long document holds, so only the item is
sketched: a MinHash of the document would be diluted by its length. Items are partitioned by their
number of distinct shingles into classes [2^j, 2^(j+1)). A class with upper size U keeps of each item the
``floor((1 - threshold) * U) + 1`` smallest shingle hashes (its bottom-k MinHash). A document that holds
the threshold's share of an item misses fewer shingles than that, so it holds at least one sketch value: the
search has no false negatives. Every candidate is then verified on the shingles themselves.

Items are a table, one row per shingle, however many there are. Documents are read once: of their shingles only those leave a task that a
bitmap of the items' hashes lets pass. The bitmap has BITS bits whatever the benchmark's size, so what is broadcast is bounded; a fuller one lets more
shingles pass that the joins then drop. The passed shingles meet the sketches (candidates), and the candidates' shingles their items (containment), both by
hash and text.
"""
from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemap.llm.common import Scratch, fresh, map_batches, named, rows

_WORD = re.compile(r"\w+")
#: Bits of the items' bitmap (8 MB), a power of two.
BITS = 1 << 26
#: Bits of one of the bitmap's pieces, as Spark's bitmap functions have them.
PIECE = 1 << 15


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


class WordHashes(dict):
    """Hashes of words; forgets all of them when it has too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return found


def shingle_keys(tokens: list[str], n: int, hashes: WordHashes) -> np.ndarray:
    """A hash of the n words from every place that has as many."""
    each = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    keys = np.zeros(max(0, len(tokens) - n + 1), np.uint64)
    for i in range(n):
        keys = (keys ^ each[i:i + len(keys)]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def sketch_size(distinct: int, threshold: Fraction) -> int:
    """How many of an item's smallest hashes its class keeps."""
    upper = 2 ** distinct.bit_length() - 1
    return int((1 - threshold) * upper) + 1


def item_table(benchmark: DataFrame, item_col: str, text_col: str, ngram: int, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """(b, item, n, size, key, shingle, sketch): a row for every distinct shingle of an item; b tells the items."""
    kind = pa.struct([("key", pa.int64()), ("shingle", pa.string()), ("sketch", pa.bool_())])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for item, text in rows(batch, "item", "text"):
                tokens = words(text)
                n = min(ngram, len(tokens))
                if n:
                    own = {" ".join(tokens[i:i + n]): k for i, k in enumerate(shingle_keys(tokens, n, hashes).tolist())}
                    ranked = sorted((k, s) for s, k in own.items())
                    kept = sketch_size(len(own), threshold)
                    out.append((item, n, len(own), [{"key": k - (1 << 64) if k >> 63 else k, "shingle": s, "sketch": i < kept} for i, (k, s) in enumerate(ranked)]))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.list_(kind)))], names=["item", "n", "size", "own"])

    source = benchmark.select(named(item_col).cast("long").alias("item"), named(text_col).cast("string").alias("text"))
    found = map_batches(source, run, "item long, n int, size long, own array<struct<key:long,shingle:string,sketch:boolean>>")
    found = scratch.keep(found.withColumn("b", F.monotonically_increasing_id()), "items")
    return found.select("b", "item", "n", "size", F.inline("own"))


def _place(key: Column) -> Column:
    """The bit of a key: its highest bits."""
    return F.shiftrightunsigned(key, 64 - (BITS - 1).bit_length())


def bitmap(items: DataFrame) -> bytes:
    """The bits of the items' keys; at most BITS / PIECE pieces come to the driver."""
    place = _place(F.col("key")) + 1  # Spark numbers bits from 1
    pieces = items.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = bytearray(max(BITS, PIECE) // 8)
    for r in pieces:
        at = (r["piece"] - 1) * PIECE // 8
        out[at:at + PIECE // 8] = r["bits"]
    return bytes(out)


def passed(source: DataFrame, items: DataFrame, id_type: str) -> DataFrame:
    """(d, id, key, shingle) of the distinct shingles of source(id, text) whose bits are set; d tells the rows."""
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most as many as a shingle has words
    shared, shift = source.sparkSession.sparkContext.broadcast(bitmap(items)), np.uint64(64 - (BITS - 1).bit_length())

    def run(batches):
        bits, hashes = np.frombuffer(shared.value, np.uint8), WordHashes()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            docs, places, keys, texts = [], [], [], []
            for i, (d, text) in enumerate(rows(batch, "d", "text")):
                tokens = words(text)
                for n in lengths:
                    own = shingle_keys(tokens, n, hashes)
                    at = own >> shift
                    found = {}
                    for j in np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).tolist():
                        found.setdefault(" ".join(tokens[j:j + n]), int(own[j]))
                    docs += [d] * len(found)
                    places += [i] * len(found)
                    keys += found.values()
                    texts += found
            yield pa.record_batch([pa.array(docs, pa.int64()), ids.take(pa.array(places, pa.int64())), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(texts, pa.string())],
                                  names=["d", "id", "key", "shingle"])

    return map_batches(source.withColumn("d", F.monotonically_increasing_id()), run, f"d long, id {id_type}, key long, shingle string")


def search(source: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, ngram: int, threshold: float) -> DataFrame:
    """(id, item, size, found): the rows of source(id, text) that hold an item's share, a row for every such row and item."""
    share, scratch = Fraction(str(threshold)), Scratch(source.sparkSession, "decontaminate")
    items = item_table(benchmark, item_col, item_text, ngram, share, scratch)
    hits = scratch.keep(passed(source, items, dict(source.dtypes)["id"]), "hits")
    met = hits.join(items.filter("sketch").select("key", "shingle", "b"), ["key", "shingle"])
    candidates = scratch.keep(met.select("d", "b").distinct(), "candidates")
    held = candidates.join(hits.select("d", "key", "shingle"), "d").join(items.select("b", "key", "shingle"), ["b", "key", "shingle"])
    counts = held.groupBy("d", "b").agg(F.count("*").alias("found"))
    sizes = items.groupBy("b").agg(F.first("item").alias("item"), F.first("size").alias("size"))
    kept = counts.join(sizes, "b").filter(F.col("found") * share.denominator >= F.col("size") * share.numerator)
    return scratch.keep(kept.join(hits.select("d", "id").distinct(), "d").select("id", "item", "size", "found"), "contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", ngram: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_col, item_col, n_shingles, n_found, containment): the documents that contain an item.

    An item of fewer than ngram words is one shingle of all its words; one without a word, or null, matches
    nothing. Null and empty texts contain nothing. Repeated rows on either side repeat in the result. Other columns are not read.
    """
    source = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    found = search(source, benchmark, item_col, item_text, ngram, threshold)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("size").alias("n_shingles"), F.col("found").alias("n_found"),
                        (F.col("found") / F.col("size")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          ngram: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that contain no item, unchanged: null and empty texts, null ids, repeated rows and columns of any name stay.

    Equal texts contain the same, so rows are told by the SHA-256 of their text; the contaminated ones are a small table that Spark broadcasts after measuring it.
    """
    digest = F.unhex(F.sha2(named(text_col).cast("string"), 256))
    found = search(docs.select(digest.alias("id"), named(text_col).cast("string").alias("text")), benchmark, item_col, item_text, ngram, threshold)
    key, = fresh(docs.columns, "text_digest")
    left = docs.withColumn(key, digest).join(found.select(F.col("id").alias(key)).distinct(), key, "left_anti")
    return left.select([named(c) for c in docs.columns])

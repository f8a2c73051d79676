"""Exact substring deduplication with suffix arrays.

A byte is removed if a window of ``length`` bytes that covers it also starts anywhere else. Sorting every suffix
of a corpus would move length bytes for each byte of text, so the suffixes are first dealt to buckets in
which all their equals must be, and whatever equality alone can decide never becomes text again:

1. A window belongs to the smallest hash of the ``GRAM``-byte strings in it (its anchor). Equal windows have equal anchors, and
   consecutive windows with one anchor form a stretch, told by its place, the anchor's hash and a hash of all its bytes.
2. An anchor that occurs once in the corpus has no repeated window. An anchor whose stretches are all equal has only repeated ones.
   In the other buckets, a stretch that occurs twice is repeated throughout. Counts and extremes are aggregated before they are
   shuffled, and joined back, so a passage that very many documents share is split like any skewed join.
3. The distinct stretches of the remaining buckets are sorted: two-stage sorting orders directly only the suffixes that are
   smaller than their successors, a scan over the first-byte buckets induces all others, and adjacent common prefixes of the
   suffix array tell the repeated windows. A bucket with more than ``BUCKET`` distinct stretches is dealt on first, until none is larger, so that
   no task holds an unbounded bucket: a window has the anchor in its left or in its right half, so each stretch is cut into the windows of
   either kind, at most two parts, and these meet in buckets by the anchor with the bytes that all windows of the kind have around it. Parts that are
   equal are one, and their windows repeated; each further deal halves the places that the anchor can have.
4. Repeated stretches become intervals for each document, are merged there, and the rest of the text is kept.

Rows are told apart by a digest of id and text; rows that are equal in both have equal results.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemap.llm.common import Scratch, chunks, map_batches, rows

GRAM = 32
BUCKET = 2000
SALT_ROWS = 4096
SEGMENT = 1 << 18
SORT_BYTES = 1 << 18
_LOW = (1 << 20) - 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words8(data: bytes) -> np.ndarray:
    """The 8 bytes from every place, as integers whose order is that of the bytes; zeros after the end."""
    padded = data + b"\0" * 16
    out = np.empty(len(data) + 8, ">u8")
    for i in range(8):
        part = np.frombuffer(padded, ">u8", (len(padded) - i) // 8, offset=i)
        out[i::8] = part[: len(out[i::8])]
    return out.astype(np.uint64)[: len(data)]


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from every place that has as many."""
    words, n = words8(data), len(data) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for at in range(0, GRAM, 8):
        out = (out ^ words[at:at + n]) * _M1
        out ^= out >> np.uint64(32)
    out *= _M2
    return out ^ (out >> np.uint64(29))


def anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` hashes, the place of its smallest; the first of equals."""
    n = len(hashes)
    keys = (hashes & ~np.uint64(_LOW)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - span + 1
    return (np.minimum(behind[:m], ahead[span - 1:span - 1 + m]) & np.uint64(_LOW)).astype(np.int64)


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, anchor hash, hash of the bytes) of the stretches of some texts.

    Short texts are handled together; a long one is cut into segments, which only makes more stretches.
    """
    pieces = []
    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, SEGMENT):
            pieces.append((number, at, text[at:at + SEGMENT + length - 1]))
    columns: list[list] = [[], [], [], [], []]
    for group in chunks(iter(pieces), SEGMENT, lambda p: len(p[2])):
        data = b"".join(p[2] for p in group)
        hashes = gram_hashes(data)
        anchor = anchors(hashes, length - GRAM + 1)
        ends = np.cumsum([len(p[2]) for p in group])
        inside = np.zeros(len(anchor) + 1, bool)
        for p, end in zip(group, ends.tolist()):
            inside[end - len(p[2]):end - length + 1] = True
        change = np.empty(len(anchor), bool)
        change[0] = True
        np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
        first = np.flatnonzero(inside[:-1] & (change | ~np.concatenate(([False], inside[:-2]))))
        last = np.flatnonzero(inside[:-1] & np.concatenate((change[1:], [True])) | inside[:-1] & ~inside[1:])
        owner = np.searchsorted(ends, first, side="right")
        view = memoryview(data)
        columns[0].append(np.array([p[0] for p in group], np.int64)[owner])
        columns[1].append(first - (ends - [len(p[2]) for p in group])[owner] + np.array([p[1] for p in group], np.int64)[owner])
        columns[2].append(last - first + 1)
        columns[3].append(hashes[anchor[first]])
        columns[4].append(np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())), np.uint64, len(first)))
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in columns)


def suffix_array(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Suffixes of strings laid end to end, in order; ``ends`` are the strings' (exclusive) ends, and no suffix goes past its own.

    Two-stage sorting. Suffixes smaller than their successors are sorted directly. Each other one starts with a byte no smaller
    than its successor's, so a scan over the buckets of first bytes, in order, meets its successor before it and appends it to its bucket.
    The order of equal suffixes is that of their strings.
    """
    n = len(data)
    text = np.frombuffer(data, np.uint8).astype(np.int16)
    following = np.empty(n, np.int16)
    following[:-1] = text[1:]
    following[ends - 1] = -1  # the end of a string is smaller than any byte
    # of a run of equal bytes, all have the type of the last one
    run_end = np.flatnonzero(text != following)
    last = run_end[np.searchsorted(run_end, np.arange(n))]
    larger = text[last] > following[last]
    begins = np.zeros(n, bool)
    begins[0] = True
    begins[ends[:-1]] = True
    stop = ends[np.searchsorted(ends, np.arange(n), side="right")]
    direct = np.flatnonzero(~larger)
    cut = [data[a:b] for a, b in zip(direct.tolist(), stop[direct].tolist())]
    direct = direct[sorted(range(len(cut)), key=cut.__getitem__)]
    del cut
    small = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray, above: int) -> None:
        before = found[~begins[found]] - 1
        before = before[larger[before] & (text[before] > above)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        bounds = np.searchsorted(first[order], np.arange(257))
        for c in np.unique(first).tolist():
            waiting[c].append(before[order[bounds[c]:bounds[c + 1]]])

    tails = ends - 1  # induced by the ends of the strings, which come before every byte
    first = text[tails]
    order = np.argsort(first, kind="stable")
    for c in np.unique(first).tolist():
        waiting[c].append(tails[order[first[order] == c]])
    out = []
    for c in range(256):
        bucket = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        parts = [bucket]
        while len(bucket):  # runs of the bucket's own byte
            before = bucket[~begins[bucket]] - 1
            bucket = before[larger[before] & (text[before] == c)]
            parts.append(bucket)
        bucket = np.concatenate([*parts, small[c]])
        waiting[c] = []
        induce(bucket, c)
        out.append(bucket)
    return np.concatenate(out)


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, a flag for every place at which a window starts: whether it also starts elsewhere in the strings."""
    data, sizes = b"".join(strings), np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    order = suffix_array(data, ends)
    room = ends[np.searchsorted(ends, order, side="right")] - order >= length
    order = order[room]  # windows; equal ones stay neighbours, for a shorter suffix is none of their equals
    words = words8(data)
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    for at in range(0, length, 8):  # adjacent common prefixes, up to length
        step = min(8, length - at)
        mask = np.uint64((0xFFFFFFFFFFFFFFFF << (64 - 8 * step)) & 0xFFFFFFFFFFFFFFFF)
        same = ((words[left[alive] + at] ^ words[right[alive] + at]) & mask) == 0
        alive = alive[same]
    flags = np.zeros(len(data), bool)
    flags[left[alive]] = True
    flags[right[alive]] = True
    return [flags[e - s:e - length + 1] for e, s in zip(ends.tolist(), sizes.tolist())]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def union(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that intervals cover; touching ones are one."""
    if not len(lo):
        return []
    order = np.argsort(lo)
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1])))
    return list(zip(lo[first].tolist(), reach[np.append(first[1:], len(lo)) - 1].tolist()))


def structs(batch: pa.RecordBatch, name: str, n: int = 4):
    """For each row of a column of arrays of structs, the fields as numpy arrays; n empty ones for null."""
    column = batch.column(batch.schema.get_field_index(name))
    fields = [f.to_numpy(zero_copy_only=False) for f in column.values.flatten()] or [np.empty(0, np.int64)] * n
    ends = column.offsets.to_numpy().tolist()
    for a, b in zip(ends, ends[1:]):
        yield [f[a:b] for f in fields]


def _key(id_col: str, text_col: str) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))))


def _all_stretches(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(rows(batch, "k", "text"), 8 << 20, lambda r: len(r[1])):
                text, start, windows, anchor, content = stretches([t.encode("utf-8", "replace") for _, t in part], length)
                keys = pa.array([k for k, _ in part], pa.binary())
                yield pa.record_batch([keys.take(pa.array(text.astype(np.int64))), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)),
                                       pa.array(anchor.astype(np.uint64).view(np.int64)), pa.array(content.astype(np.uint64).view(np.int64))],
                                      names=["k", "start", "windows", "h", "c"])

    source = docs.select(_key(id_col, text_col).alias("k"), F.col(text_col).alias("text")).filter(F.octet_length("text") >= length)
    return map_batches(source, run, "k binary, start int, windows int, h long, c long")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(k, start, h, hot, data): the bytes of the wanted stretches (k, start, windows, h, hot)."""
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for (k, text), places in zip(rows(batch, "k", "text"), structs(batch, "places")):
                data = text.encode("utf-8", "replace")
                for start, windows, h, hot in zip(*(p.tolist() for p in places)):
                    cut = data[start:start + windows + length - 1]
                    out.append((k, start, h, hot, cut))
                    size += len(cut)
                if size > 4 << 20:
                    yield record(out)
                    out, size = [], 0
            yield record(out)

    def record(out):
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["k", "start", "h", "hot", "data"])

    places = wanted.groupBy("k").agg(F.collect_list(F.struct("start", "windows", "h", "hot")).alias("places"))
    source = docs.select(_key(id_col, text_col).alias("k"), F.col(text_col).alias("text")).filter(F.octet_length("text") >= length)
    return map_batches(source.join(places, "k"), run, "k binary, start int, h long, hot boolean, data binary")


def _sorted_runs(cut: DataFrame, length: int) -> DataFrame:
    """(k, lo, hi): byte intervals of the repeated windows of stretches that meet by h, by suffix arrays of whole buckets."""
    def run(batches):
        def stream():
            for batch in batches:
                yield from rows(batch, "h", "k", "start", "data")

        def found(group):
            out = []
            for (_, k, start, _), flags in zip(group, repeated_windows([g[3] for g in group], length)):
                out += [(k, start + a, start + b + length - 1) for a, b in runs(flags)]
            kinds = (pa.binary(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["k", "lo", "hi"])

        held, size, last = [], 0, None
        for r in stream():
            if size >= SORT_BYTES and r[0] != last:
                yield found(held)
                held, size = [], 0
            held.append(r)
            size += len(r[3])
            last = r[0]
        if held:
            yield found(held)

    return map_batches(cut.repartition("h").sortWithinPartitions("h"), run, "k binary, lo long, hi long")


def _halves(cut: DataFrame, length: int) -> DataFrame:
    """(k, start, h, a, low, high, data): stretches whose windows have low to high bytes before the anchor, cut in the middle of that range.

    ``a`` is the anchor's place in the data (null: the first place with the hash h); the new h is a hash of the bytes that all windows of a part have
    in common around the anchor.
    """
    def run(batches):
        for batch in batches:
            for part in chunks(rows(batch, "k", "start", "h", "a", "low", "high", "data"), 4 << 20, lambda r: len(r[6])):
                out = []
                for k, start, h, a, low, high, data in part:
                    if a is None:
                        a = int(np.argmax(gram_hashes(data).view(np.int64) == h))
                    middle = (low + high + 1) // 2
                    for x, y in ((low, middle - 1), (middle, high)):
                        first, last = max(0, a - y), min(len(data) - length, a - x)
                        if first <= last:
                            common = xxhash.xxh3_64_intdigest(data[a - x:a + length - y], seed=x << 32 | y) - (1 << 63)
                            out.append((k, start + first, common, a - first, x, y, data[first:last + length]))
                kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["k", "start", "h", "a", "low", "high", "data"])

    return map_batches(cut, run, "k binary, start int, h long, a int, low int, high int, data binary")


def _dealt_on(hot: DataFrame, length: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Hot buckets dealt on until none has more than BUCKET distinct parts: (the buckets to sort, the parts found to be repeated)."""
    hot = hot.select("k", "start", "h", F.lit(None).cast("int").alias("a"), F.lit(0).alias("low"), F.lit(length - GRAM).alias("high"), "data")
    ready, again, turn = [], [], 0
    while not hot.isEmpty():
        parts = scratch.keep(_halves(hot, length), f"halves-{turn}")
        kinds = scratch.keep(parts.groupBy("h", "data").agg(F.count("*").alias("n"), F.min(F.struct("k", "start", "a", "low", "high")).alias("one")), f"kinds-{turn}")
        again.append(parts.join(kinds.filter("n > 1").select("h", "data"), ["h", "data"]))
        large = kinds.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select("h", F.lit(True).alias("large"))
        rest = kinds.select("h", "data", "one.*").join(large, "h", "left").withColumn("hot", F.coalesce("large", F.lit(False)) & F.expr("low < high"))
        rest = scratch.keep(rest.drop("large"), f"dealt-{turn}")
        ready.append(rest.filter("not hot"))
        hot, turn = rest.filter("hot"), turn + 1
    return ready, again


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """(k, lo, hi): byte intervals (they may overlap) that cover every repeated window; k tells the rows."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    every = scratch.keep(_all_stretches(docs, id_col, text_col, length), "stretches")
    shared = (every.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).filter("n > 1")
              .select("h", (F.col("low") != F.col("high")).alias("mixed"), F.ceil(F.col("n") / F.lit(SALT_ROWS)).alias("parts")))
    shared = scratch.keep(shared, "shared")
    found = scratch.keep(every.join(shared, "h"), "found")
    scratch.drop("stretches")
    whole = lambda df: df.select("k", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("windows") + length - 1).cast("long").alias("hi"))
    mixed = found.filter("mixed")
    kinds = scratch.keep(mixed.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k", "start", "windows")).alias("one"),
                                                      F.max("parts").alias("parts")), "kinds")
    # the stretches of a frequent anchor meet their kinds in as many parts as it has SALT_ROWS rows
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    often = (mixed.withColumn("salt", F.pmod(F.xxhash64("k"), F.col("parts")))
             .join(kinds.filter("n > 1").select("h", "c", salts.alias("salt")), ["h", "c", "salt"]))
    hot = kinds.groupBy("h").agg((F.count("*") > BUCKET).alias("hot"))
    wanted = kinds.join(hot, "h").select("one.k", "one.start", "one.windows", "h", "hot")
    cut = scratch.keep(_texts(docs, wanted, id_col, text_col, length), "cut")
    columns = ("k", "start", "h", "data")
    ready, again = _dealt_on(cut.filter("hot"), length, scratch)
    same = [df.select("k", F.col("start").cast("long").alias("lo"), (F.col("start") + F.length("data")).cast("long").alias("hi")) for df in again]
    to_sort = reduce(DataFrame.unionByName, [df.select(*columns) for df in ready], cut.filter("not hot").select(*columns))
    return reduce(DataFrame.unionByName, same, whole(found.filter("not mixed")).unionByName(whole(often)).unionByName(_sorted_runs(to_sort, length)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id_col, kept binary, n_bytes, n_removed, n_spans) of every row: the bytes that no repeated window covers, and counts.

    Texts are UTF-8; a null text is empty. Repeated rows are occurrences of each other. Kept bytes need not be valid UTF-8.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    found = repeated(docs, id_col, text_col, length, scratch)
    spans = scratch.keep(found.groupBy("k").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")

    def run(batches):
        for batch in batches:
            out = []
            for (doc, text), (lo, hi) in zip(rows(batch, "id", "text"), structs(batch, "spans", 2)):
                data, at, kept, removed = (text or "").encode("utf-8", "replace"), 0, [], 0
                merged = union(lo, hi)
                for a, b in merged:
                    kept.append(data[at:a])
                    removed += b - a
                    at = b
                kept.append(data[at:])
                out.append((doc, b"".join(kept), len(data), removed, len(merged)))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[id_col, "kept", "n_bytes", "n_removed", "n_spans"])

    source = docs.select(_key(id_col, text_col).alias("k"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(source.join(spans, "k", "left"), run, f"`{id_col}` long, kept binary, n_bytes long, n_removed long, n_spans long")

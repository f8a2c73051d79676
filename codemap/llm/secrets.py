"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A run of key characters is suspicious if a byte-level BPE needs many tokens for it: text that the
vocabulary has seen gives four or more characters a token, random strings about two. Runs are first
stripped of what is random but no secret: UUIDs, digests that a word before them names (sha256:, md5,
commit, ...), data: URI bodies, file and code identifiers (letters with few digits, or parts joined by
``_ - . /`` that have the form of words or numbers, and whose letters, split into words, give at least ``WORD_RATIO``
characters a token: random letters give about 1.7). What is left and stays under ``max_ratio`` characters a token is a span.
"""
from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemap.llm.common import map_batches, named, rows

#: Fixed by the contract: kinds in order, their patterns, the group that is measured and its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
BASE = (("assign", ASSIGN, 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))
KINDS = ("assign", "access", "hex", "random")

#: Only for speed: a text without these holds no match of the kind.
_HEX_RUN = re.compile(r"[0-9a-f]{24}")
_ASSIGN_WORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST_WORD = re.compile(r"(sha-?(1|224|256|384|512)|md5|digest|checksum|integrity|commit|revision|etag|blake2b?|crc)[\"']?\s*[:=-]?\s*[\"']?$", re.IGNORECASE)
_DATA_URI = re.compile(r"base64,$")
_WORDLIKE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}")
_WORD = re.compile(r"[A-Z][a-z]{3,}|[a-z]{4,}|[A-Z]{4,}")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

MIN_RUN = 20
MAX_RATIO = 2.4
#: Least characters a token of an identifier's words, and the letters from which that is measured.
WORD_RATIO, MIN_LETTERS = 2.2, 12
VOCABULARY = "byte_bpe_50k.tiktoken"


def encoder(vocabulary: str = VOCABULARY):
    """A tiktoken encoding from a public vocabulary file (a name in public_tokenizers, or a path)."""
    import os

    import public_tokenizers
    import tiktoken
    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, code points, by start and kind."""
    found = []
    for kind, (name, pattern, group, least) in enumerate(BASE):
        if name == "assign" and not _ASSIGN_WORD.search(text) or name == "access" and "AKIA" not in text:
            continue
        if name == "hex":
            if _HEX_RUN.search(text):
                found += [(m.start(), m.end(), kind) for m in re.finditer(r"[0-9a-f]{24,}", text)]
            continue
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found)


def is_identifier(run: str) -> bool:
    """The form of words, numbers and camel or snake case parts: names in code, paths, slugs."""
    parts = [p for p in re.split(r"[_\-/=+]+", run) if p]
    if not any(c.isdigit() for c in run):
        return len(_WORDLIKE.findall(run)) <= max(1, len(run) // 4)
    return all(re.fullmatch(r"[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}", p) and len(_WORDLIKE.findall(p)) <= max(2, len(p) // 4) for p in parts)


def has_words(run: str, encode) -> bool:
    """Whether the parts of four letters or more read as words to the vocabulary, or there are too few letters to tell; alphabets in order count as read."""
    parts = [w for w in map(str.lower, _WORD.findall(run)) if 2 * sum(abs(ord(a) - ord(b)) == 1 for a, b in zip(w, w[1:])) < len(w)]
    n = sum(map(len, parts))
    return n < MIN_LETTERS or n / len(encode(" " + " ".join(parts))) >= WORD_RATIO


def known_digest(text: str, start: int, end: int) -> bool:
    """A hex run of a digest's length that a word before it names as a digest or revision."""
    return end - start in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-fA-F]+", text[start:end]) is not None and bool(_DIGEST_WORD.search(text[max(0, start - 24):start]))


def random_spans(text: str, encode, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, end, kind) of runs with few characters a token."""
    found = []
    for m in _RUN.finditer(text):
        run, (start, end) = m.group(), m.span()
        if len(set(run)) < 8 or _UUID.fullmatch(run) or known_digest(text, start, end) or _DATA_URI.search(text[max(0, start - 8):start]):
            continue
        if not (is_identifier(run) and has_words(run, encode)) and len(run) / len(encode(run)) < max_ratio:
            found.append((start, end, 3))
    return found


def scan_text(text: str | None, encode, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """All spans (start, end, kind index) of a text by start and kind; none for null or empty."""
    return sorted(base_spans(text) + random_spans(text, encode, max_ratio), key=lambda s: (s[0], s[2], s[1])) if text else []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """(id_col, spans array<struct<kind,start,end>>) of every row; null and empty texts give an empty list."""
    def run(batches):
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan_text(t, encode, max_ratio)] for (t,) in rows(batch, "text")]
            yield pa.record_batch([batch.column(0), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=[id_col, "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(source, run, f"`{id_col}` long, spans array<struct<kind:string,start:long,end:long>>")


def summarise(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans and all spans as text, from ``scan``."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, count("assign"), count("access"), count("hex"), count("random"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact_text(text: str | None, encode, mark: str = "[SECRET]", max_ratio: float = MAX_RATIO) -> str | None:
    """The text with every maximal run of covered characters replaced by the mark."""
    spans = scan_text(text, encode, max_ratio)
    if not spans:
        return text
    out, at, covered = [], 0, 0
    for start, end, _ in spans:
        if start >= covered:
            out += [text[at:start], mark]
        covered = max(covered, end)
        at = covered
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with the secrets of the text column replaced; a column n_chars, if there is one, follows the text.

    Null and empty texts, repeated rows, null ids and all other columns, whatever their names, stay as they are.
    """
    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches):
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            texts = pa.array([redact_text(t, encode, mark, max_ratio) for (t,) in rows(batch, text_col)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    done = map_batches(docs, run, schema)
    if "n_chars" in schema.names:
        kind = schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(named(text_col))).cast(kind))
    return done

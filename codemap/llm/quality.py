"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and evaluates every rule once: a row holds the measurements and
one failure bit per rule. A policy is a versioned set of rules, so applying another version, or asking
what a rule alone rejects, reads the ledger and never the texts. ``ablations`` first counts the
distinct bit patterns (partial aggregation; at most 2^rules rows leave a task) and works on these.
"""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from codemap.llm.common import SPACE_CODES, fresh, map_batches, named, rows

SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_SPACES = "".join(map(chr, SPACE_CODES))
_LETTER = re.compile(r"[^\W\d_]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_bullet_lines", "n_ellipsis_lines")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (over the measurements) holds; ``bit`` is its place in the mask, never reused."""
    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols_per_word", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_dup_lines >= 3 and 3 * n_dup_lines > n_lines"),
    Rule(4, "few_letter_words", "100 * n_alpha_words < 80 * n_words"),
    Rule(5, "short_words", "word_chars < 3 * n_words"),
    Rule(6, "long_words", "word_chars > 12 * n_words"),
    Rule(7, "bullet_lines", "n_lines >= 3 and 10 * n_bullet_lines > 9 * n_lines"),
    Rule(8, "ellipsis_lines", "n_lines >= 3 and 10 * n_ellipsis_lines > 3 * n_lines"),
)

#: Versioned policies: the rules that reject. "base" holds in every version.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols_per_word", "duplicate_lines"),
    "v2": tuple(r.name for r in RULES),
}


def mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a text; all 0 for null or empty."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    starts = [line.lstrip(_SPACES) for line in lines]
    return (
        len(words), len(text) - sum(text.count(c) for c in _SPACES), len(_SYMBOL.findall(text)),
        len(lines) - len(set(lines)), repeated, len(lines),
        sum(1 for w in words if w.isalpha() or _LETTER.search(w.decode("utf-8", "replace"))),
        sum(s[0] in "-*•" for s in starts), sum(s.rstrip(_SPACES).endswith(("...", "…")) for s in starts),
    )


def fail_bits(rules: tuple[Rule, ...] = RULES, names: dict[str, str] | None = None) -> Column:
    """One failure bit for each rule, over the MEASURES (``names``: the columns that hold them, if they are named otherwise)."""
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        fails = re.sub(r"\b(" + "|".join(MEASURES) + r")\b", lambda m: f"`{(names or {}).get(m[0], m[0])}`", rule.fails)
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of docs but the text, the MEASURES and ``fail_bits``, one row for each row of docs.

    A null text measures as empty. Columns of docs that have the name of a measurement or of
    ``fail_bits`` are left out; repeated rows and null ids stay.
    """
    passed = [f for f in docs.schema.fields if f.name not in (*MEASURES, "fail_bits", text_col)]

    def run(batches):
        for batch in batches:
            cols = list(zip(*(measure(t) for (t,) in rows(batch, "__text")))) or [()] * len(MEASURES)
            yield pa.record_batch([batch.column(i) for i in range(len(passed))] + [pa.array(c, pa.int64()) for c in cols],
                                  names=[f.name for f in passed] + list(MEASURES))

    schema = docs.select([f.name for f in passed]).schema
    for m in MEASURES:
        schema = schema.add(m, "long")
    measured = map_batches(docs.select(*[F.col(f"`{f.name}`") for f in passed], F.col(text_col).alias("__text")), run, schema)
    return measured.withColumn("fail_bits", fail_bits(rules))


def apply_policy(book: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p))) != 0
    return book.withColumn("base_failed", failed("base")).withColumn("kept", ~F.col("base_failed") & ~failed(policy))


def ablations(book: DataFrame, policies: tuple[str, ...] = tuple(POLICIES), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(policy, rule, failing, sole, kept, kept_without): what each rule of a policy rejects, alone, and the
    rows kept with and without it, from counts of bit patterns."""
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = F.explode(F.array(*(
        F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"), F.lit(mask(p)).cast("long").alias("mask"))
        for p in policies for r in rules if r.name in POLICIES[p])))
    hit = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (patterns.select("fail_bits", "n", cases.alias("c")).groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
            .agg(total(hit.bitwiseAND(F.col("c.bit")) != 0).alias("failing"), total(hit == F.col("c.bit")).alias("sole"),
                 total(hit == 0).alias("kept"), total((hit == 0) | (hit == F.col("c.bit"))).alias("kept_without")))


def counts_of(policy: str = "v2", bits: str = "fail_bits") -> list[Column]:
    """The counts of ``ablations`` for one policy as aggregates: kept, and failing_, sole_ and kept_without_ of every rule."""
    hit = F.col(bits).bitwiseAND(F.lit(mask(policy)))
    total = lambda cond: F.count(F.when(cond, 1))
    counts = [total(hit == 0).alias("kept")]
    for r in (r for r in RULES if r.name in POLICIES[policy]):
        bit = F.lit(1 << r.bit).cast("long")
        counts += [total(hit.bitwiseAND(bit) != 0).alias(f"failing_{r.name}"), total(hit == bit).alias(f"sole_{r.name}"),
                   total((hit == 0) | (hit == bit)).alias(f"kept_without_{r.name}")]
    return counts


def accepted(docs: DataFrame, policy: str = "v2", id_col: str = "doc_id", text_col: str = "text", counts: Observation | None = None) -> DataFrame:
    """The rows of docs that the policy's mask keeps, unchanged and in one pass over the texts; counts observes the policy's ``counts_of``."""
    names = docs.columns
    *measures, bits = fresh(names, *(f"measured_{m}" for m in MEASURES), "fail_bits")

    def run(batches):
        for batch in batches:
            cols = list(zip(*(measure(t) for (t,) in rows(batch, text_col)))) or [()] * len(MEASURES)
            yield pa.record_batch([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*names, *measures])

    schema = docs.limit(0).schema
    for m in measures:
        schema = schema.add(m, "long")
    book = map_batches(docs, run, schema).select(*map(named, names), fail_bits(names=dict(zip(MEASURES, measures))).alias(bits))
    if counts is not None:
        book = book.observe(counts, *counts_of(policy, bits))
    return book.filter(F.col(bits).bitwiseAND(F.lit(mask(policy) | mask("base"))) == 0).select([named(n) for n in names])

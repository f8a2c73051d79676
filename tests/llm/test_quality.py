import re

from pyspark.sql import Observation

from codemap.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


TEXTS = [None, "", " \t\n", "a b c a b c", "a b c d\na b c d\n\n\n", "x " * 120, "é ü # $ |\x1c\n- a\n- b\n* c", "w...\nv…\nq",
         " ".join(f"word{i}" for i in range(80)), " ".join(f"Word{i % 7}" for i in range(80)), "# " * 30 + " ".join(f"tok{i}" for i in range(60)),
         "line one two\n" * 5 + " ".join(f"t{i}" for i in range(90)), "long " * 3 + "x" * 200_000]


def test_measures_equal_brute_force():
    for t in TEXTS:
        assert quality.measure(t)[:5] == brute(t), t and t[:40]


def test_ledger_policies_and_ablations(spark):
    rows = [(i, t, "src") for i, t in enumerate(TEXTS)] + [(None, TEXTS[8], None), (8, TEXTS[8], "src")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 as n_words")
    book = quality.apply_policy(quality.ledger(df), "v2")
    got = book.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            n, _, _, _, rep = brute(TEXTS[r.doc_id])
            assert (r.n_words, r.n_repeat_words) == (n, rep)
            assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
            assert r.kept == (r.fail_bits == 0)
    kept = sorted(r.doc_id for r in got if r.kept and r.doc_id is not None)
    assert kept == [8, 8]
    out = quality.accepted(df, "v2")
    assert out.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 8), (False, 8), (True, 0)]
    ab = {(r.policy, r.rule): r for r in quality.ablations(book).collect()}
    for policy in quality.POLICIES:
        m = quality.mask(policy)
        for rule in quality.RULES:
            if rule.name not in quality.POLICIES[policy]:
                continue
            bit, r = 1 << rule.bit, ab[policy, rule.name]
            assert r.failing == sum(1 for g in got if g.fail_bits & m & bit)
            assert r.sole == sum(1 for g in got if g.fail_bits & m == bit)
            assert r.kept == sum(1 for g in got if not g.fail_bits & m)
            assert r.kept_without == sum(1 for g in got if not g.fail_bits & (m & ~bit))


def test_accepted_reads_the_ledger(spark):
    """accepted() keeps what the ledger's bits and the policy's mask keep, and observes the counts of ablations()."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string")
    book = quality.ledger(df)
    for policy in quality.POLICIES:
        seen = Observation(f"counts_{policy}")
        got = sorted(r.doc_id for r in quality.accepted(df, policy, counts=seen).collect())
        assert got == sorted(r.doc_id for r in quality.apply_policy(book, policy).collect() if r.kept)
        counts = dict(seen.get)
        ab = quality.ablations(book, (policy,)).collect()
        assert counts == {"kept": len(got)} | {f"{k}_{r.rule}": r[k] for r in ab for k in ("failing", "sole", "kept_without")}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.apply_policy(quality.ledger(df)).count() == 0
    assert quality.accepted(df).count() == 0

import re

import pytest
import xxhash

from codemap.llm import simhash


def brute(texts, ngram=3):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sh = [" ".join(w[i:i + ngram]) for i in range(len(w) - ngram + 1)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def brute_components(rows):
    fps = brute([t for _, t in rows])
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp):
        least[c] = min(least.get(c, d), d)
    return {(d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp)}


def test_equals_brute_force(spark):
    base = " ".join(f"w{i % 37}x{i}" for i in range(400))
    rows = [(i, base.replace(f"w{i}x{i}", "Other")) for i in range(40)] + [
        (50, ""), (51, None), (52, "  \t"), (53, "one two"), (54, "ONE\x0bTwo"), (55, "é É x y z"), (56, base), (56, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as u", "'x' as fp")
    got = simhash.near_duplicates(df)
    assert got.count() == len(rows)
    assert {tuple(r) for r in got.collect()} == brute_components(rows)
    kept = simhash.keep_one(df)
    want = {c for _, _, c in brute_components(rows)}
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_all_distances(spark):
    """Every fingerprint at one or two bits is linked, none at three."""
    import random
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64)}
    for _ in range(300):
        f = rnd.choice(sorted(fps))
        for _ in range(rnd.randint(1, 3)):
            f ^= 1 << rnd.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for bits in (1, 2):
        got = simhash.links(spark.createDataFrame(signed, "fp long"), bits).collect()
        pairs = [frozenset((r.u % (1 << 64), r.v % (1 << 64))) for r in got]
        want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "q")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.component_id is None) for r in simhash.near_duplicates(df).collect())
    assert got == [(False, False), (True, False), (True, False), (True, True)]
    assert simhash.keep_one(df).count() == 4
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_equal_ids_of_different_texts(spark):
    """Rows of one id are one document only if they are of one component."""
    rows = [(7, "alpha beta gamma delta"), (7, "quite another text here"), (7, "alpha beta gamma delta"), (8, "alpha beta gamma delta"), (7, "ALPHA beta gamma delta")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} == {7}
    assert sorted(r.text.lower() for r in kept) == ["alpha beta gamma delta", "quite another text here"]


@pytest.mark.parametrize("bad", [0, 9])
def test_bit_limit(spark, bad):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), bad)

import random

import pytest

from codemap.llm import decontaminate
from codemap.llm.decontaminate import words


def brute(docs, items, n=5):
    out = []
    for d, t in docs:
        dw = words(t)
        for i, it in items:
            iw = words(it)
            m = min(n, len(iw))
            if not m:
                continue
            own = {tuple(iw[k:k + m]) for k in range(len(iw) - m + 1)}
            held = {tuple(dw[k:k + m]) for k in range(len(dw) - m + 1)}
            if 10 * len(own & held) >= 8 * len(own):
                out.append((d, i, len(own), len(own & held)))
    return sorted(out, key=str)


def corpus(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ß", "x_1"]
    say = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    items = [(i, say(rnd.choice([1, 2, 3, 4, 5, 6, 12, 30, 45]))) for i in range(60)] + [(90, None), (91, " .,"), (92, ""), (3, say(9)), (None, say(20))]
    docs = []
    for d in range(150):
        text = say(rnd.randint(0, 300))
        if d % 3 == 0:
            item = (rnd.choice(items)[1] or "").split()
            for _ in range(d % 5):  # damage some words
                if item:
                    item[rnd.randrange(len(item))] = "zz"
            text += ",\n" + "\n".join(item).upper() + "! " + say(rnd.choice([0, 50, 3000]))
        docs.append((d, text))
    return docs + [(200, None), (201, ""), (5, docs[0][1]), (None, docs[0][1])], items


@pytest.mark.parametrize("bits", [decontaminate.BITS, 1 << 15])
def test_equals_brute_force(spark, monkeypatch, bits):
    """Also where the bitmap is full of the items' bits and lets nearly everything pass."""
    monkeypatch.setattr(decontaminate, "BITS", bits)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as n_found")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as doc_id")
    want = brute(docs, items)
    assert len(want) > 40
    got = decontaminate.contaminated(d, b)
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got.collect()), key=str) == want
    free = decontaminate.clean(d, b)
    bad = {t for _, t in docs if t and brute([(0, t)], items)}
    assert free.columns == d.columns
    assert sorted(str(r.doc_id) for r in free.collect()) == sorted(str(i) for i, t in docs if t not in bad)


def test_documents_are_read_once_whatever_the_benchmark(spark):
    """A benchmark of many items: one pass over the documents, and nothing but bits in a bounded broadcast."""
    docs, _ = corpus()
    rnd = random.Random(3)
    items = [(i, " ".join(f"v{rnd.randrange(5000)}" for _ in range(40))) for i in range(3000)] + [(9999, docs[30][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(decontaminate.bitmap(decontaminate.item_table(b, "item_id", "text", 5, decontaminate.Fraction("0.8"), decontaminate.Scratch(spark, "t")))) == decontaminate.BITS // 8
    assert (30, 9999) in {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}


def test_empty_tables(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs)

"""The corpus pipeline against plain versions of its stages."""
import random

import corpus_pipeline
import test_decontaminate
import test_packing
import test_quality
import test_secrets
import test_simhash
from codemap.llm import packing


def corpus():
    rnd = random.Random(11)
    say = lambda k: " ".join(f"{rnd.choice('bcdfgm')}{rnd.choice('aeiou')}{rnd.choice(['rn', 'st', 'l'])}{rnd.randrange(90)}" for _ in range(k))
    items = [(i, say(30)) for i in range(5)] + [(None, None), (9, "")]
    texts = [say(rnd.randint(60, 400)) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), texts[1] + " one more", texts[2] + "\n" + items[1][1] + "\n", say(60) + " " + items[2][1].title(), None, "", "short text",
              "spam words " * 60, "# " * 100 + say(60), ("same line here\n" * 9) + say(80), texts[3] + ' password = "hunter2hunter2" and AKIA' + "Q" * 16,
              say(70) + " token: 9f8e7d6c5b4a39281706f5e4", say(9000)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"src{i % 4}", len(t) if t else None) for i, t in enumerate(texts)]
    return rows + [(7, texts[7], "en", "src", 1), (None, texts[8], None, None, None), (None, say(80), "de", "x", None)], items


def expected_stages(rows, items):
    def good(text):
        n, chars, symbols, dup, repeated = test_quality.brute(text)
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        return not (n < 50 or 100 * repeated > 50 * n or 10 * symbols > n or (dup >= 3 and 3 * dup > len(lines)) or chars < 3 * n or chars > 12 * n)

    one = [r for r in rows if good(r[1])]
    yield one
    named = [r for r in one if r[0] is not None]
    least = {(d, c) for d, _, c in test_simhash.brute_components([(r[0], r[1]) for r in named])}
    seen, two = set(), []
    for r in named:
        if (r[0], r[0]) in least and r[0] not in seen:
            seen.add(r[0])
            two.append(r)
    two += [r for r in one if r[0] is None]
    yield two
    three = [r for r in two if not test_decontaminate.brute([(0, r[1])], items)]
    yield three

    yield [(r[0], t, r[2], r[3], None if r[4] is None else len(t)) for r in three for t in [plain_redact(r[1])]]


def plain_redact(text):
    """Characters under a fixed pattern's span, run by run."""
    covered = bytearray(len(text))
    for s in filter(None, test_secrets.brute(text).split(",")):
        a, b = map(int, s.split(":")[1:])
        covered[a:b] = b"\1" * (b - a)
    out, i = [], 0
    while i < len(text):
        if covered[i]:
            out.append("[SECRET]")
            while i < len(text) and covered[i]:
                i += 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_stages_and_run(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    for i, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, expected_stages(rows, items))):
        done = stage(spark, docs, str(tmp_path))
        assert done.columns == docs.columns and done.schema.simpleString() == docs.schema.simpleString()
        done.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        key = lambda r: str((r[0], r[1]))
        got = sorted(map(tuple, docs.collect()), key=key)
        if name == "simhash_near_dedup":  # of rows with one id, any may stay
            assert sorted((str(g[0]), g[1]) for g in got) == sorted((str(w[0]), w[1]) for w in want)
        elif name == "secret_scan":
            assert len(got) == len(want) and sorted((str(g[0]), g[1]) for g in got) == sorted((str(w[0]), w[1]) for w in want)
            assert all(g[4] is None or g[4] == len(g[1]) for g in got)
        else:
            assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=key)], name
        assert got, name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = sorted((str(r.doc_id), len(test_packing.direct_ids(r.text))) for r in docs.collect())
    total = {}
    for r in packed:
        total[str(r.doc_id)] = total.get(str(r.doc_id), 0) + r.length
    by_id = {}
    for d, n in lengths:
        by_id[d] = by_id.get(d, 0) + n
    assert total == by_id
    assert test_packing.check(packed, 4096) <= -(-sum(by_id.values()) // 4096) + 1


def test_columns_of_any_name_stay_as_they_are(spark, tmp_path):
    rows, items = corpus()
    extra = [(*r, i, f"l{i}", i + 0.5, -i) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id int, `meta.lang` string, __n_words double, `key_id` int"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(extra, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, str(tmp_path))
        assert done.schema.simpleString() == docs.schema.simpleString(), name
        before, after = {r[5]: r for r in docs.collect()}, done.collect()
        assert after and all(r[0] == before[r[5]][0] and r[5:] == before[r[5]][5:] for r in after), name
        docs = spark.createDataFrame(after, schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert packing.END_ID == 1

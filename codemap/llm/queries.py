"""The registered queries of the operators: ``fn(spark, sf_dir) -> DataFrame``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemap.llm import decontaminate, html_extract, licences, lm_score, packing, periodic_runs, quality, secrets, simhash, suffix_dedup, topk_search, warc, whitening
from codemap.llm.common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of documents: 3-word shingles, 2 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), ngram=3, max_bits=2)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff bigram scores of documents by the counts of all other documents; rounded to 6 digits."""
    done = lm_score.score(table(spark, sf_dir, "documents"), order=2)
    return done.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents are, and licence notices in them, by canonical digests."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by wrapper induction over the pages of its host."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed patterns and token-inefficient runs."""
    return secrets.summarise(secrets.scan(table(spark, sf_dir, "documents")))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 200-byte strings that occur more than once."""
    done = suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=200)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, capacity=4096), capacity=4096)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives in the shared folder and read back: responses with their payloads, and the records that revisit them."""
    path = Scratch(spark, "warc").path("archive")
    warc.archive(table(spark, sf_dir, "pages"), path)
    # record types are pushed into the reader, which passes over the blocks of the others
    return warc.catalogue(warc.read(spark, path).filter("warc_type = 'response'").unionByName(warc.read(spark, path).filter("warc_type = 'revisit'")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of documents under policy v2."""
    book = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.apply_policy(book, "v2")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of documents that contain a benchmark item: 5-word shingles, containment 0.8."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ngram=5, threshold=0.8)


def repeated_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32(doc_id) and g = h / 10, where h % 10 = 0 the words from a = g % n on repeat the first p of them."""
    words = F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> '')")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    source = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    source = source.withColumn("a", F.expr("cast(floor(h / 10) % n as int)"))
    source = source.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + floor(h / 10) % 8)) as int)"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)"
    text = F.expr(f"CASE WHEN h % 10 = 0 AND n > 0 THEN array_join(concat(slice(w, 1, a), {tail}), ' ') ELSE text END")
    return source.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words with at least 24 words and three periods in every document, the greatest one, and digests."""
    done = periodic_runs.collapse(repeated_documents(table(spark, sf_dir, "documents")))
    # runs are ordered by start, then period, so the first of equal exponents stays; a null length compares as no run yet
    best = F.expr("""aggregate(runs, cast(null as struct<start:bigint,period:bigint,length:bigint>),
        (b, r) -> CASE WHEN b IS NULL OR cast(r.length as decimal(19,0)) * b.period > cast(b.length as decimal(19,0)) * r.period THEN r ELSE b END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    done = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")
    return done.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings on their 16 leading principal components, whitened; deviations that no long holds are null."""
    done = whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)
    return done.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest integer inner products of every embedding whose vec_id is divisible by 20."""
    return topk_search.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_lm_score, op3_licences, op4_html, op5_secrets, op6_substrings, op7_packing, op8_warc, op9_quality, op10_decontamination,
                                   op11_periodic_runs, op12_whitening, op13_topk)}

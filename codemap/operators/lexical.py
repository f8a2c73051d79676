"""BM25 (Okapi) scoring of every candidate file of every repository against its keywords.

Per repository: documents are ``lower(path + ' ' + content)`` split on whitespace
(the path is one token); the query is the repository's keywords joined by spaces,
lower-cased and split, duplicates counting twice. With N documents, df(t) documents
containing t, idf(t) = ln(N - df + 0.5) - ln(df + 0.5); the average idf over the whole
vocabulary (before flooring) times epsilon replaces every negative idf; terms outside
the vocabulary score 0. score(d) = Σ_q idf(q)·tf(q,d)·(k1+1) / (tf + k1·(1 - b + b·dl/avgdl)).

Everything is grouped on (repo_id, term) or (repo_id, path) with partial aggregation;
per-repository scalars are joined back (small: AQE broadcasts them after measuring).
Terms of the same df in a repository have the same idf, so the average needs how many terms have which df, not
the terms; and only the query's terms need an idf of their own.
"""
from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import regex as R


def tokens(text) -> "F.Column":
    """Python-style whitespace split with empties dropped."""
    return F.array_remove(F.split(text, R.PY_WHITESPACE), "")


def searched_text() -> Column:
    """The text of a file that is searched: null without a path."""
    return F.lower(F.concat(F.col("path"), F.lit(" "), F.coalesce("content", F.lit(""))))


def doc_terms(cands: DataFrame) -> DataFrame:
    """(repo_id, path, dl, first, term, tf): one row per distinct term of a file's whole text; ``first`` marks one of a file's rows.

    A file's terms are counted where its text lies: its sorted tokens are cut where they change, so nothing is shuffled. (Tokens and cuts go
    through a generator, so that the lambdas see attributes and not the expressions that make them.)
    """
    sorted_ = cands.select("repo_id", "path", F.inline(F.array(F.struct(F.sort_array(tokens(searched_text())).alias("t")))))
    change = F.expr("filter(sequence(1, size(t)), i -> i = 1 OR t[i - 1] <> t[i - 2])")
    cut = sorted_.where(F.size("t") > 0).select("repo_id", "path", F.size("t").cast("bigint").alias("dl"), F.inline(F.array(F.struct("t", change.alias("at")))))
    each = F.expr("transform(at, (a, i) -> named_struct('first', i = 0, 'term', t[a - 1], 'tf', cast(coalesce(get(at, i + 1), size(t) + 1) - a as bigint)))")
    return cut.select("repo_id", "path", "dl", F.inline(each))


#: Characters of texts whose terms are counted together, at least; and those of a repository that one task counts, at most.
COUNTED_CHARS, IN_TASK_CHARS = 8_000_000, 16_000_000


def document_frequencies(cands: DataFrame) -> DataFrame:
    """(repo_id, term, df) of the whole vocabulary. A task adds up what its neighbouring files of a repository share before anything is shuffled.

    The words are those of ``tokens``: Python's own split has the same whitespace.
    """
    def counted(by: dict) -> pa.RecordBatch:
        of = pa.array(list(by), pa.string()).take(pa.array(np.repeat(np.arange(len(by)), [len(k) for k in by.values()])))
        terms, dfs = (list(chain.from_iterable(f(k) for k in by.values())) for f in (dict.keys, dict.values))
        return pa.RecordBatch.from_arrays([of, pa.array(terms, pa.string()), pa.array(dfs, pa.int64())], names=["repo_id", "term", "df"])

    def count(batches):
        by, chars = {}, 0
        for batch in batches:
            for repo, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").split()
                by.setdefault(repo, Counter()).update(set(words))
                chars += sum(map(len, words))
                if chars > COUNTED_CHARS:
                    yield counted(by)
                    by, chars = {}, 0
        if by:
            yield counted(by)

    partial = cands.select("repo_id", searched_text().alias("text")).mapInArrow(count, "repo_id string, term string, df bigint")
    return partial.groupBy("repo_id", "term").agg(F.sum("df").alias("df"))


def equal_frequencies(cands: DataFrame, sizes: DataFrame, in_task: int = IN_TASK_CHARS) -> DataFrame:
    """(repo_id, df, n): how many terms of a repository's vocabulary are in df of its files. sizes(repo_id, chars): the characters of its texts.

    A repository's texts are less than the rows of their terms, so they go to one task that counts them, if there are at most ``in_task`` characters;
    larger ones are counted in many tasks, by ``document_frequencies``.
    """
    from ..session import stage

    def count(files: pa.Table) -> pa.Table:
        dfs = Counter()
        for text in files.column("text"):
            dfs.update(set((text.as_py() or "").split()))
        equal = Counter(dfs.values())
        repo = files.column("repo_id").combine_chunks().take(pa.array([0] * len(equal), pa.int64()))
        return pa.Table.from_arrays([repo, pa.array(list(equal), pa.int64()), pa.array(list(equal.values()), pa.int64())], names=["repo_id", "df", "n"])

    def counted(part: DataFrame) -> DataFrame:
        return part.select("repo_id", searched_text().alias("text")).groupBy("repo_id").applyInArrow(count, "repo_id string, df bigint, n bigint")

    large = stage(sizes.where(F.col("chars") > in_task).select("repo_id"), "large")
    if large.isEmpty():
        return counted(cands)
    spread = document_frequencies(cands.join(large, "repo_id", "left_semi"))
    return counted(cands.join(large, "repo_id", "left_anti")).unionByName(numbers_of_terms(spread))


def query_counts(cands: DataFrame, queries: DataFrame) -> DataFrame:
    """``doc_terms`` of the terms of queries(repo_id, term) alone, with the characters of the text; a file that has none of them has one row, without a term.

    A repository's terms go to its files as a list, so that texts are split and counted where they lie.
    """
    def count(batches):
        for batch in batches:
            at, dls, chars, firsts, terms, tfs = [], [], [], [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                text = text.as_py() or ""
                words = text.split()
                found = list(Counter(filter(set(wanted or ()).__contains__, words)).items()) or [(None, None)] if words else []
                for n, (term, tf) in enumerate(found):
                    at.append(i)
                    dls.append(len(words))
                    chars.append(len(text))
                    firsts.append(n == 0)
                    terms.append(term)
                    tfs.append(tf)
            of = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(dls, pa.int64()), pa.array(chars, pa.int64()), pa.array(firsts, pa.bool_()),
                                              pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], names=["repo_id", "path", "dl", "chars", "first", "term", "tf"])

    from ..session import stage
    lists = stage(queries.groupBy("repo_id").agg(F.collect_set("term").alias("terms")), "query_lists")
    texts = cands.select("repo_id", "path", searched_text().alias("text")).join(lists, "repo_id", "left")
    return texts.mapInArrow(count, "repo_id string, path string, dl bigint, chars bigint, first boolean, term string, tf bigint")


def raw_idf(df: Column, n_docs: Column) -> Column:
    return F.log(n_docs - df + F.lit(0.5)) - F.log(df + F.lit(0.5))


def corpus_stats(cands: DataFrame, epsilon: float = K.BM25_EPSILON) -> dict:
    """Per-repository corpus statistics and floored idf.

    Returns dict of DataFrames: docs(repo_id, path, dl), repo(repo_id, n_docs, avgdl, average_idf, n_terms),
    tf(repo_id, path, term, tf), idf(repo_id, term, df, idf). The texts are read once: the counted terms are written,
    and lengths, document frequencies and the statistics come from them (a path is a token, so every
    candidate has a row).
    """
    from ..session import stage
    return statistics(stage(doc_terms(cands), "bm25_tf"), epsilon)


def file_counts(docs: DataFrame) -> DataFrame:
    """(repo_id, n_docs, avgdl) of docs(repo_id, path, dl)."""
    return docs.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def numbers_of_terms(dfs: DataFrame) -> DataFrame:
    """(repo_id, df, n) of dfs(repo_id, term, df)."""
    return dfs.groupBy("repo_id", "df").agg(F.count(F.lit(1)).alias("n"))


def average_idf(dfs: DataFrame, counts: DataFrame) -> DataFrame:
    """(repo_id, average_idf, n_terms) of dfs(repo_id, term, df): the vocabulary shrinks to a row for each df before it meets the repositories."""
    return average_of_equal(numbers_of_terms(dfs), counts)


def average_of_equal(equal: DataFrame, counts: DataFrame) -> DataFrame:
    """``average_idf`` of equal(repo_id, df, n)."""
    total = F.sum(F.col("n") * raw_idf(F.col("df"), F.col("n_docs")))
    return (equal.join(counts.select("repo_id", "n_docs"), "repo_id").groupBy("repo_id")
            .agg((total / F.sum("n")).alias("average_idf"), F.sum("n").alias("n_terms")))


def floored_idf(epsilon: float) -> Column:
    """A term's idf from df, n_docs and average_idf."""
    raw = raw_idf(F.col("df"), F.col("n_docs"))
    return F.when(raw < 0, F.lit(epsilon) * F.col("average_idf")).otherwise(raw)


def statistics(tf: DataFrame, epsilon: float = K.BM25_EPSILON) -> dict:
    """``corpus_stats`` of the rows of ``doc_terms``."""
    docs = tf.where("first").select("repo_id", "path", "dl")
    counts = file_counts(docs)
    dfs = tf.groupBy("repo_id", "term").agg(F.count(F.lit(1)).alias("df"))
    repo = counts.join(average_idf(dfs, counts), "repo_id", "left")
    idf = dfs.join(repo.where("n_terms IS NOT NULL"), "repo_id").select("repo_id", "term", "df", floored_idf(epsilon).alias("idf"))
    return {"docs": docs, "repo": repo, "tf": tf, "idf": idf}


def query_terms(keywords: DataFrame) -> DataFrame:
    """keywords(repo_id, kw_ord, keyword) -> (repo_id, term, qn): token multiplicity of the joined query."""
    return (keywords.select("repo_id", F.explode(tokens(F.lower("keyword"))).alias("term"))
            .groupBy("repo_id", "term").agg(F.count(F.lit(1)).alias("qn")))


def bm25_scores(cands: DataFrame, keywords: DataFrame, k1: float = K.BM25_K1, b: float = K.BM25_B,
                epsilon: float = K.BM25_EPSILON) -> DataFrame:
    """(repo_id, path, bm25_raw, bm25) for every candidate; bm25 = raw / max(raw) when max > 0."""
    from ..session import stage
    # the query's terms are few rows: written, their size is known, and what the files hold of them is counted where the texts lie
    q = stage(query_terms(keywords), "query_terms")
    counted = stage(query_counts(cands, q), "query_hits")
    docs = counted.where("first")
    counts = file_counts(docs)
    equal = equal_frequencies(cands, docs.groupBy("repo_id").agg(F.sum("chars").alias("chars")))
    repo = stage(counts.join(average_of_equal(equal, counts), "repo_id", "left"), "corpus_statistics")
    hits = counted.where("term IS NOT NULL")
    # a term's hits are all files that contain it
    dfs = hits.groupBy("repo_id", "term").agg(F.count(F.lit(1)).alias("df"))
    known = stage(dfs.join(q, ["repo_id", "term"]).join(repo, "repo_id").select("repo_id", "term", "qn", floored_idf(epsilon).alias("idf"), "avgdl"), "query_idf")
    scored = (hits.join(known, ["repo_id", "term"])
              .select("repo_id", "path", (F.col("qn") * F.col("idf") * impact(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("s")))
    none = docs.select("repo_id", "path", F.lit(0.0).alias("s"))
    raw = stage(scored.unionByName(none).groupBy("repo_id", "path").agg(F.sum("s").alias("bm25_raw")), "bm25_raw")
    return normalised(raw)


def impact(tf: Column, dl: Column, avgdl: Column, k1: float = K.BM25_K1, b: float = K.BM25_B) -> Column:
    """What a term's occurrences in a file count for, before its idf: between 0 and k1 + 1."""
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def normalised(raw: DataFrame) -> DataFrame:
    """Adds bm25 = bm25_raw / the repository's largest, where that is positive."""
    mx = raw.groupBy("repo_id").agg(F.max("bm25_raw").alias("mx"))
    return (raw.join(mx, "repo_id")
            .select("repo_id", "path", "bm25_raw",
                    (F.col("bm25_raw") / F.when(F.col("mx") > 0, F.col("mx")).otherwise(F.lit(1.0))).alias("bm25")))

"""Analysis requests as a stream.

The analysed service handled one request (a repository URL and a token budget) per HTTP
call. Here requests are files arriving in a folder, read with Structured Streaming; each
micro-batch is analysed as one batch job over all of its repositories:

  readStream.json(requests) -> foreachBatch:
      normalise repo ids (invalid ones are written with their error, not dropped)
      -> semi-join the corpus tables on the requested repo ids
      -> analyse(...) with each request's own token budget -> one report row per request
      -> written to <out>/reports/epoch=<id> (overwrite: a replayed epoch is idempotent)

The stream's progress lives in ``checkpointLocation`` (shared storage on a cluster).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..plans import report as RP
from ..session import stage
from ..sources.listing import normalise_repo_ids

REQUEST_SCHEMA = "request_id string, repo_url string, token_budget int, default_branch string"


def analyse_batch(requests: DataFrame, files: DataFrame, context_replies: DataFrame,
                  architecture_replies: DataFrame, file_vectors: DataFrame | None = None,
                  repo_vectors: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """One batch of requests -> (one report row per valid request, rejected requests).

    A report carries its request's id and budget. All repositories are analysed once, up to the ranking of their files; requests with equal repository
    and budget share a pick, and the k-th different budgets of all repositories are picked together. No valid request: no reports (None).
    """
    norm = normalise_repo_ids(requests)
    rejected = norm.where(F.col("error").isNotNull()).select("request_id", "repo_url", "error")
    ok = (norm.where(F.col("error").isNull())
          .withColumn("token_budget", F.coalesce(F.col("token_budget"), F.lit(K.API_TOKEN_BUDGET))))
    turns = (ok.select("repo_id", "token_budget").distinct()
             .withColumn("turn", F.row_number().over(Window.partitionBy("repo_id").orderBy("token_budget"))))
    turns = stage(turns, "budgets")
    done, a = None, None
    for turn in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
        budgets = turns.where(F.col("turn") == turn).select("repo_id", "token_budget")
        if a is None:  # the first turn has every repository
            keep = budgets.select("repo_id")
            repos = keep.select("repo_id", F.concat(F.lit("https://github.com/"), F.col("repo_id")).alias("repo_url"),
                                F.lit(None).cast("string").alias("default_branch"))
            a = RP.analyse(files.join(keep, "repo_id", "left_semi"),
                           context_replies.join(keep, "repo_id", "left_semi"),
                           architecture_replies.join(keep, "repo_id", "left_semi"),
                           repos, file_vectors, repo_vectors, K.API_TOKEN_BUDGET, budgets)
        else:
            a = RP.repick(a, budgets)
        part = RP.report(a).join(budgets, "repo_id")
        done = part if done is None else done.unionByName(part)
    if done is None:
        return None, rejected
    asked = ok.select("request_id", "repo_id", "token_budget", F.col("default_branch").alias("asked_branch"))
    named = F.coalesce(F.when(F.col("asked_branch") != "", F.col("asked_branch")), F.col("default_branch"))
    return (asked.join(done, ["repo_id", "token_budget"]).withColumn("default_branch", named).drop("asked_branch"), rejected)


def start_request_stream(spark: SparkSession, requests_path: str, out_path: str, checkpoint_location: str,
                         files: DataFrame, context_replies: DataFrame, architecture_replies: DataFrame,
                         file_vectors: DataFrame | None = None, repo_vectors: DataFrame | None = None,
                         available_now: bool = True):
    """Start the stream; returns the StreamingQuery (``available_now`` processes what is there and stops)."""
    stream = spark.readStream.schema(REQUEST_SCHEMA).json(requests_path)

    def run(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        rep, rejected = analyse_batch(batch, files, context_replies, architecture_replies, file_vectors, repo_vectors)
        if rep is not None:
            rep.write.mode("overwrite").parquet(f"{out_path}/reports/epoch={epoch_id}")
        rejected.write.mode("overwrite").parquet(f"{out_path}/rejected/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()

"""Embedding similarity between each repository's summary vector and its files' vectors.

Vectors arrive as columns (an embedding model is an input, not part of the job):
cosine = a·b / (|a||b|), 0 when a norm is 0 or a vector is missing, clamped at 0,
then divided by the repository's maximum when that maximum is > 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))


def cosine(a: Column, b: Column) -> Column:
    den = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def cosine_scores(files: DataFrame, file_vectors: DataFrame, repo_vectors: DataFrame) -> DataFrame:
    """files(repo_id, path) -> (repo_id, path, cos_raw, semantic) with max-normalisation per repository."""
    fv = file_vectors.select("repo_id", "path", F.col("embedding").cast("array<double>").alias("fv"))
    rv = repo_vectors.select("repo_id", F.col("embedding").cast("array<double>").alias("rv"))
    s = (files.select("repo_id", "path")
         .join(fv, ["repo_id", "path"], "left")
         .join(rv, "repo_id", "left")
         .select("repo_id", "path", F.greatest(F.lit(0.0), cosine(F.col("rv"), F.col("fv"))).alias("cos_raw")))
    mx = s.groupBy("repo_id").agg(F.max("cos_raw").alias("mx"))
    return (s.join(mx, "repo_id")
            .select("repo_id", "path", "cos_raw",
                    (F.col("cos_raw") / F.when(F.col("mx") > 0, F.col("mx")).otherwise(F.lit(1.0))).alias("semantic")))

"""Sources: repository identifiers, saved tree listings, checkouts on disk, content decoding.

The analysed service fetched listings and contents over HTTP; here they are tables:
* ``normalise_repo_ids`` turns request URLs / ``owner/repo`` strings into (owner, repo) columns,
  with an ``error`` column instead of an exception;
* ``read_tree_listings`` reads saved JSON listings (``{"tree": [{path, type, size, ...}]}``);
* ``read_checkouts`` reads checked-out repositories through a store that opens every analysed file once (``sources.store``);
* ``files_of_listing`` joins a listing with decoded contents; both give ``files(repo_id, path, tree_ord, size_bytes, content)``;
* ``decode_content`` decodes base64 contents as UTF-8, dropping undecodable bytes.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import regex as R

WS_EDGES = "^" + R.PY_WHITESPACE + "|" + R.PY_WHITESPACE + "$"
URL_RE = r"^https?://([^/?#]*)([^?#]*)"
PAGE_RE = r"^https?://github\.com/([^/]+)/([^/?#]+)"


def _nonempty_parts(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda p: p != "")


def normalise_repo_ids(df: DataFrame, url_col: str = "repo_url") -> DataFrame:
    """Adds owner, repo, repo_id, error (null when valid) and page_repo_url (a github page
    URL recognised the way the browser extension does)."""
    u = F.regexp_replace(F.regexp_replace(F.col(url_col), WS_EDGES, ""), "/+$", "")
    is_http = u.startswith("http://") | u.startswith("https://")
    host = F.regexp_extract(u, URL_RE, 1)
    url_parts = _nonempty_parts(F.regexp_extract(u, URL_RE, 2))
    id_parts = _nonempty_parts(u)
    parts = F.when(is_http, url_parts).otherwise(id_parts)
    error = (F.when(u == "", F.lit("empty repository url"))
             .when(is_http & ~host.isin(K.GITHUB_HOSTS), F.lit("not a github url"))
             .when(is_http & (F.size(url_parts) < 2), F.lit("invalid github url"))
             .when(~is_http & (F.size(id_parts) != 2), F.lit("invalid repository identifier")))
    owner = F.when(error.isNull(), F.try_element_at(parts, F.lit(1)))
    repo0 = F.try_element_at(parts, F.lit(2))
    repo = F.when(error.isNull(), F.when(repo0.endswith(".git"), repo0.substr(F.lit(1), F.length(repo0) - 4))
                  .otherwise(repo0))
    page_owner = F.regexp_extract(F.col(url_col), PAGE_RE, 1)
    page_repo = F.regexp_replace(F.regexp_extract(F.col(url_col), PAGE_RE, 2), r"\.git$", "")
    page_url = F.when(page_owner != "", F.concat(F.lit("https://github.com/"), page_owner, F.lit("/"), page_repo))
    return df.select("*", owner.alias("owner"), repo.alias("repo"),
                     F.when(error.isNull(), F.concat(owner, F.lit("/"), repo)).alias("repo_id"),
                     error.alias("error"), page_url.alias("page_repo_url"))


LISTING_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("default_branch", T.StringType()),
    T.StructField("tree", T.ArrayType(T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("size", T.LongType()),
    ]))),
])


def scan_listing(listing: DataFrame) -> DataFrame:
    """Tree items (repo_id, path, type, size[, tree_ord]) -> blobs only, missing size -> 0."""
    cols = ["repo_id", "path", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size_bytes")]
    if "tree_ord" in listing.columns:
        cols.insert(2, "tree_ord")
    return listing.where(F.col("type") == "blob").select(*cols)


def read_tree_listings(spark: SparkSession, path: str) -> DataFrame:
    """Saved listings, one JSON object per line: {repo_id, default_branch, tree: [...]}; a missing
    tree is an empty listing. -> (repo_id, path, tree_ord, type, size)."""
    raw = spark.read.schema(LISTING_SCHEMA).json(path)
    items = raw.select("repo_id", F.posexplode(F.coalesce("tree", F.array())).alias("tree_ord", "it"))
    return items.select("repo_id", F.col("it.path").alias("path"), F.col("tree_ord").cast("bigint"),
                        F.col("it.type").alias("type"), F.col("it.size").alias("size"))


def read_listing_repos(spark: SparkSession, path: str) -> DataFrame:
    """The repositories of saved listings: (repo_id, repo_url, default_branch)."""
    raw = spark.read.schema(LISTING_SCHEMA).json(path)
    return raw.select("repo_id", F.concat(F.lit("https://github.com/"), "repo_id").alias("repo_url"), "default_branch")


def files_of_listing(listing: DataFrame, contents: DataFrame) -> DataFrame:
    """listing (as of read_tree_listings) and contents(repo_id, path, encoding, content_b64) -> files; a file
    without contents has a null content."""
    texts = decode_content(contents).select("repo_id", "path", "content")
    return (scan_listing(listing).join(texts, ["repo_id", "path"], "left")
            .select("repo_id", "path", "tree_ord", "size_bytes", "content"))


def read_checkouts(spark: SparkSession, root: str, max_file_size: int | None = None, store: str | None = None) -> DataFrame:
    """Files under ``root/<owner>/<repo>/...`` as files(repo_id, path, tree_ord, size_bytes, content); see ``sources.store``.

    ``store``: the folder that keeps what was read, so that another call opens only changed files; without it, one that the driver deletes when it ends.
    """
    from ..session import delete_on_exit, ensure_checkpoint_dir
    from .store import CheckoutStore
    if store is None:
        store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/checkouts-{uuid.uuid4().hex}"
        delete_on_exit(spark, store)
    return CheckoutStore(spark, root, store, max_file_size).files()


def utf8_ignore(b: Column) -> Column:
    """UTF-8 decode dropping invalid bytes (a genuine U+FFFD in the input is dropped too)."""
    return F.regexp_replace(F.make_valid_utf8(b.cast("string")), "�", "")


def decode_content(df: DataFrame, encoding_col: str = "encoding", content_col: str = "content_b64") -> DataFrame:
    """Adds ``content``: base64-decoded UTF-8 when encoding is 'base64', else ''; failures -> ''."""
    dec = F.try_to_binary(F.regexp_replace(F.col(content_col), r"\s", ""), F.lit("base64"))
    text = F.when(F.col(encoding_col) == "base64", F.coalesce(utf8_ignore(dec), F.lit(""))).otherwise(F.lit(""))
    return df.withColumn("content", text)

"""Tables keyed by repository, with versions, replaceable repositories and reuse of what has not changed.

A ``VersionedTable`` is a folder of Parquet files in BUCKETS buckets by the hash of ``repo_id``:

  data/<version>-<run>/bucket=<b>      the rows of the buckets that the version replaced, with each row's fingerprint
  keys/<version>-<run>/bucket=<b>      (repo_id, fingerprint): also repositories without rows
  manifests/<version>                  for each bucket, the folder that holds it

``replace`` writes new folders for the buckets of the repositories it changes, and then the manifest: a file that is written under another name and renamed into
place, which fails if that version is there already. Readers take the highest manifest, so they see all of a version or nothing of it: a job that is killed
before the rename leaves the old version as it was, and folders that no manifest names.

``refresh`` is incremental recomputation: repositories whose fingerprint the table has keep their rows, the others (and only they) are computed.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def row_digest(*columns) -> Column:
    """The SHA-256 of a row's values, nulls told from empty ones."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def fingerprint(*parts: DataFrame, rules: str = "") -> DataFrame:
    """(repo_id, fingerprint) of the repositories of the first part: a digest of the multiset of rows that each part has for them, and of ``rules``,
    whatever else the result depends on (parameters, the version of the code).

    Each row's SHA-256 is added up in four numbers of 64 bits, with partial sums, so a repository of any size is a row of each task;
    the order of the rows has no part in it.
    """
    total = None
    for i, part in enumerate(parts):
        digests = part.select("repo_id", row_digest(*[F.col(f"`{c}`") for c in sorted(part.columns) if c != "repo_id"]).alias("d"))
        words = [F.sum(F.conv(F.substring("d", 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
        sums = digests.groupBy("repo_id").agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), *words).alias(f"f{i}"))
        total = sums if total is None else total.join(sums, "repo_id", "left")
    return total.select("repo_id", F.sha2(F.concat_ws("|", F.lit(rules), *[F.coalesce(f"f{i}", F.lit("-")) for i in range(len(parts))]), 256).alias("fingerprint"))


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions -----------------------------------------------------------
    def version(self) -> int:
        """The highest version; 0 before the first one."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version}", wholetext=True).first()[0])

    def _commit(self, version: int, manifest: dict) -> None:
        target, draft = self._path(f"{self.path}/manifests/{version}"), self._path(f"{self.path}/manifests/.{version}-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # the local file system's rename replaces a file, so its presence is checked as well
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another job")

    # -- reading ------------------------------------------------------------
    def _read(self, kind: str, schema: str, version: int | None) -> DataFrame:
        folders = self.manifest(version)["folders"]
        paths = [f"{self.path}/{kind}/{f}/bucket={b}" for b, f in sorted(folders.items())]
        paths = [p for p in paths if self._fs.exists(self._path(p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest one), without fingerprints."""
        schema = self.manifest(version)["schema"]
        if schema is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._read("data", schema, version).drop("fingerprint")

    def keys(self, version: int | None = None) -> DataFrame:
        """(repo_id, fingerprint) of the repositories that a version holds."""
        return self._read("keys", "repo_id string, fingerprint string", version)

    # -- writing ------------------------------------------------------------
    def replace(self, rows: DataFrame, keys: DataFrame, gone: DataFrame | None = None) -> int:
        """A new version in which the repositories of keys(repo_id, fingerprint) have just these rows(repo_id, ...), and those of gone(repo_id) none.

        Only the buckets of these repositories are written again (with what else they hold); returns the version.
        """
        old, bucket = self.manifest(), F.pmod(F.xxhash64("repo_id"), F.lit(self.buckets)).cast("int")
        version = self.version()
        changed = keys.select("repo_id") if gone is None else keys.select("repo_id").unionByName(gone.select("repo_id"))
        touched = [r[0] for r in changed.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS numbers
        folder = f"{version + 1}-{uuid.uuid4().hex}"

        def written(kind: str, new: DataFrame, schema: str) -> None:
            if version:
                held = {b: f for b, f in old["folders"].items() if int(b) in touched}
                paths = [p for p in (f"{self.path}/{kind}/{f}/bucket={b}" for b, f in held.items()) if self._fs.exists(self._path(p))]
                if paths:
                    new = new.unionByName(self.spark.read.schema(schema).parquet(*paths).join(changed, "repo_id", "left_anti"), allowMissingColumns=True)
            # a bucket with a very large repository is written by several tasks
            (new.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(*new.columns), F.lit(8)))
             .write.partitionBy("bucket").parquet(f"{self.path}/{kind}/{folder}"))

        labelled = rows.join(keys, "repo_id")
        schema = _ddl(labelled)
        written("data", labelled, old["schema"] or schema)
        written("keys", keys.select("repo_id", "fingerprint"), "repo_id string, fingerprint string")
        self._commit(version + 1, {"schema": schema, "folders": {**old["folders"], **{str(b): folder for b in touched}}})
        return version + 1

    def refresh(self, fingerprints: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The table's rows for the repositories of fingerprints(repo_id, fingerprint), after computing those that it has not.

        ``compute`` gets (repo_id) of the repositories that are new or have another fingerprint, and returns their rows. Repositories that the table has
        and fingerprints have not leave it. Nothing is written, and nothing computed, if all are as before.
        """
        from ..session import stage
        fingerprints = stage(fingerprints.select("repo_id", "fingerprint"), "fingerprints")
        known = self.keys()
        stale = stage(fingerprints.join(known, ["repo_id", "fingerprint"], "left_anti"), "stale")
        gone = stage(known.join(fingerprints, "repo_id", "left_anti").select("repo_id"), "gone")
        if not self.version() or not (stale.isEmpty() and gone.isEmpty()):
            self.replace(compute(stale.select("repo_id")), stale, gone)
        return self.read()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

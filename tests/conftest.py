import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from codemap.session import DEFAULT_CONF
    b = (SparkSession.builder.master("local[4]").appName("codemap-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="codemap-test-ckpt-", dir="/tmp")))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def files_df(spark, rows):
    """rows: (repo_id, path, content) or (repo_id, path, content, size) in tree order."""
    out = []
    for i, r in enumerate(rows):
        repo, path, content = r[:3]
        size = r[3] if len(r) > 3 else (len(content.encode()) if content is not None else 0)
        out.append((repo, path, i, i, size, content))
    return spark.createDataFrame(out, "repo_id string, path string, tree_ord bigint, doc_id bigint, size_bytes bigint, content string")

"""Stand-in inputs derived from the driver's test tables.

These builders only give rows in the schemas the jobs expect (see FIXTURES.md);
they do none of the analysis. Every builder reads whole tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# files(repo_id, path, tree_ord, doc_id, size_bytes, content) from documents: every third row is in one hot
# repository, the others in max(20, rows / 50) repositories. gap: ids between neighbours of a repository; j: place in its tree.
_FILES_EXPRS = [
    "concat('org/repo', CAST(r AS STRING)) AS repo_id",
    """CASE j WHEN 0 THEN 'README.md' WHEN 1 THEN 'Dockerfile' WHEN 2 THEN 'package.json' ELSE concat(
        CASE j % 6 WHEN 0 THEN 'src/app' WHEN 1 THEN 'src/core' WHEN 2 THEN 'tests'
                   WHEN 3 THEN 'pkg/api' WHEN 4 THEN 'src/db' ELSE 'node_modules/x' END,
        '/d', bs, '/',
        CASE j % 8 WHEN 3 THEN 'main' WHEN 5 THEN 'routing' WHEN 6 THEN concat('test_m', ds)
                   ELSE concat('m', ds) END, ext) END AS path""",
    "j AS tree_ord",
    "doc_id",
    "n_chars * 20 AS size_bytes",
    """concat(
        CASE ext
          WHEN '.py' THEN concat('import m', CAST(doc_id - gap AS STRING), CASE WHEN j % 4 = 0 THEN chr(13) ELSE '' END, chr(10),
            'from pkg.m', CAST(doc_id - 7 * gap AS STRING), ' import x', chr(10), 'import main', CASE WHEN j % 3 = 0 THEN '; y = 1' ELSE '' END, chr(10),
            'import routing as rt, ', CASE WHEN j % 5 = 0 THEN concat(chr(92), chr(10), '  ') ELSE '' END, 'm', CAST(doc_id + gap AS STRING), chr(10),
            'from .m import m', CAST(doc_id + 7 * gap AS STRING), chr(10),
            '# it''s a ', chr(39), chr(39), chr(39), ' in a comment', chr(10), 'try: import fast', ds, chr(10),
            's = ', chr(39), chr(39), chr(39), chr(10), 'import hidden', chr(10), chr(39), chr(39), chr(39), chr(10))
          WHEN '.js' THEN concat('import a from "./m', CAST(doc_id - 6 * gap AS STRING), '";', CASE WHEN j % 4 = 0 THEN chr(13) ELSE '' END, chr(10),
            'const u = "/*"; import "../main"; const w = "*/";', chr(10), 'f(); // import "commented"', chr(10),
            'const b = require("m', CAST(doc_id - 7 * gap AS STRING), '");', chr(10))
          ELSE '' END,
        CASE WHEN ext IN ('.py', '.js') THEN concat('@app.get("/r', ds, '")', chr(10), 'def h', ds, '(a):', chr(10),
            '    return db.query(a)', chr(10), 'class C', ds, ':', chr(10)) ELSE '' END,
        CASE WHEN j % 9 = 0 THEN concat('@bp.route("/f', ds, '")', chr(10), 'if __name__ == "__main__":', chr(10)) ELSE '' END,
        text) AS content""",
]


def n_repos(spark: SparkSession, sf_dir: str) -> int:
    """Repositories beside the hot one; grows with the documents table."""
    return max(20, table(spark, sf_dir, "documents").count() // 50)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = n_repos(spark, sf_dir)
    d = docs.selectExpr(
        "doc_id", "text", "n_chars", f"CASE WHEN doc_id % 3 = 0 THEN 3 ELSE {n} END AS gap",
        f"CAST(floor(doc_id / CASE WHEN doc_id % 3 = 0 THEN 3 ELSE {n} END) AS BIGINT) AS j",
        f"CASE WHEN doc_id % 3 = 0 THEN {n} ELSE doc_id % {n} END AS r")
    s = d.selectExpr(
        "*", "CAST(doc_id AS STRING) AS ds", "CAST(CAST(floor(j / 24) AS BIGINT) AS STRING) AS bs",
        """CASE WHEN j < 3 THEN '' WHEN j % 7 = 1 THEN '.js' WHEN j % 7 = 4 THEN '.ts'
                WHEN j % 7 = 5 THEN '.md' WHEN j % 7 = 6 THEN '.png' ELSE '.py' END AS ext""")
    # the stand-in columns go through a generator, so queries see attributes, as of a table, and not their long expressions
    head, content = _FILES_EXPRS[:-1], _FILES_EXPRS[-1]
    named = ", ".join(f"'{e.rsplit(' AS ', 1)[-1].strip()}', {e.rsplit(' AS ', 1)[0]}" for e in head)
    rows = s.selectExpr("text", f"inline(array(named_struct({named}, 'ext', ext, 'ds', ds, 'gap', gap, 'j', j)))")
    return rows.selectExpr("repo_id", "path", "tree_ord", "doc_id", "size_bytes", content)


_RESPONSE_RAW = """CASE turn % 4
    WHEN 0 THEN concat('```json', chr(10), '{"summary":"', md5(text), '","tech_stack":["spark","python","spark"],"main_modules":[1,"routing",true,{"k":1},null,"src/app.py","api.py"," routing ",""],"entry_points":["./main.py","routing.py","nope.py"],"flow_mermaid":" graph TD "}', chr(10), '```')
    WHEN 1 THEN concat('{"summary":"', md5(text), '","tech_stack":[],"main_modules":[],"entry_points":["main.py"],"keywords":["the",2,"import"],"flow_mermaid":["a","b"],"evidence_map":[{"node_id":"a","start_line":12.5},"loose",7]}')
    WHEN 2 THEN '{"summary":7,"tech_stack":"spark","main_modules":null,"flow_mermaid":{"k":1}}'
    ELSE concat('Sure! ', md5(text)) END AS raw"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies as a table: responses(repo_id, response_id, raw)."""
    return table(spark, sf_dir, "conversations").selectExpr(
        f"concat('org/repo', CAST(conv_id % {n_repos(spark, sf_dir) + 1} AS STRING)) AS repo_id",
        "conv_id * 100 + turn AS response_id",
        _RESPONSE_RAW)


KEYWORD_LIST = ["import", "main", "the", "de", "from", "class", "the"]


def keywords(files_df: DataFrame) -> DataFrame:
    """keywords(repo_id, kw_ord, keyword): the same query list for every repository."""
    kws = F.array(*[F.lit(k) for k in KEYWORD_LIST])
    return (files_df.select("repo_id").distinct()
            .select("repo_id", F.posexplode(kws).alias("kw_ord", "keyword"))
            .withColumn("kw_ord", F.col("kw_ord").cast("bigint")))


def file_vectors(spark: SparkSession, sf_dir: str, files_df: DataFrame) -> DataFrame:
    """file_vectors(repo_id, path, embedding array<double>)."""
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = table(spark, sf_dir, "embeddings").count()
    return (files_df.select("repo_id", "path", (F.col("doc_id") % n).alias("vec_id"))
            .join(emb, "vec_id").drop("vec_id"))


def repo_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_vectors(repo_id, embedding): the summary embedding of each repository."""
    emb = table(spark, sf_dir, "embeddings")
    return (emb.where(F.col("vec_id") <= n_repos(spark, sf_dir))
            .select(F.concat(F.lit("org/repo"), F.col("vec_id").cast("string")).alias("repo_id"),
                    F.col("embedding").cast("array<double>").alias("embedding")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests(page_id, repo_url, token_budget) in five identifier shapes."""
    pages = table(spark, sf_dir, "pages")
    return pages.selectExpr(
        "page_id",
        """CASE page_id % 5
             WHEN 0 THEN concat('https://github.com/org/repo', CAST(page_id % 20 AS STRING), '.git')
             WHEN 1 THEN concat('https://github.com/org/repo', CAST(page_id % 20 AS STRING), '.git/tree/main')
             WHEN 2 THEN concat('org/repo', CAST(page_id % 20 AS STRING), '/')
             WHEN 3 THEN url
             ELSE 'org' END AS repo_url""",
        "CAST(8000 AS INT) AS token_budget")


def tree_listing(files_df: DataFrame) -> DataFrame:
    """tree_listing(repo_id, path, type, size, encoding, content_b64): a saved listing with encoded contents."""
    return files_df.selectExpr(
        "repo_id", "path", "tree_ord", "CASE WHEN tree_ord % 11 = 5 THEN 'tree' WHEN tree_ord % 11 = 8 THEN 'commit' ELSE 'blob' END AS type",
        "CASE WHEN tree_ord % 10 = 9 THEN NULL ELSE size_bytes END AS size",
        "CASE WHEN tree_ord % 13 = 4 THEN 'utf-8' ELSE 'base64' END AS encoding",
        "CASE WHEN tree_ord % 17 = 3 THEN '!' ELSE base64(encode(content, 'UTF-8')) END AS content_b64")


def evidence_map(tree: DataFrame) -> DataFrame:
    """evidence_map(repo_id, ord, node_id, label, file, start_line, end_line): a model-style
    evidence list over the non-noise source files of each repository; every third
    node id is blank (forces the label fallback), every fifth file is 'missing.py'."""
    from pyspark.sql import Window
    from ..functions import paths as P
    from .. import constants as K
    w = Window.partitionBy("repo_id").orderBy("tree_ord")
    src = (tree.where(F.col("extension").isin(K.SOURCE_EXTENSIONS) & ~P.is_noise("path"))
           .withColumn("ord", F.row_number().over(w)))
    return src.selectExpr(
        "repo_id", "CAST(ord AS INT) AS ord",
        "CASE WHEN ord % 3 = 0 THEN '' ELSE concat('n', CAST(tree_ord AS STRING)) END AS node_id",
        "substring_index(path, '/', -1) AS label",
        "CASE WHEN ord % 5 = 0 THEN 'missing.py' ELSE path END AS file",
        "CAST(CASE WHEN ord % 4 = 0 THEN 0 ELSE ord * 3 END AS INT) AS start_line",
        "CAST(CASE WHEN ord % 6 = 0 THEN NULL ELSE ord * 3 + 4 END AS INT) AS end_line")


def diagram_nodes(tree: DataFrame) -> DataFrame:
    """diagram_nodes(repo_id, node_id, label): rendered diagram nodes for the same files."""
    from pyspark.sql import Window
    from ..functions import paths as P
    from .. import constants as K
    w = Window.partitionBy("repo_id").orderBy("tree_ord")
    src = (tree.where(F.col("extension").isin(K.SOURCE_EXTENSIONS) & ~P.is_noise("path"))
           .withColumn("ord", F.row_number().over(w)))
    return src.selectExpr("repo_id", "concat('n', CAST(tree_ord AS STRING)) AS node_id",
                          "concat(upper(substring_index(path, '/', -1)), ' handler') AS label")


def repos(files_df: DataFrame) -> DataFrame:
    """repos(repo_id, repo_url, default_branch): branch unknown (null) for some repositories."""
    return files_df.select("repo_id").distinct().selectExpr(
        "repo_id", "concat('https://github.com/', repo_id) AS repo_url",
        "CASE WHEN substring(repo_id, -1, 1) IN ('1', '3') THEN 'dev' END AS default_branch")

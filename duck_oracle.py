"""DuckDB oracle SQL for the correctness gate.

Each query's oracle is a chain of CTEs over the driver's pre-registered views,
written independently of the Spark plans (plain SQL, brute-force joins where that
is simpler). Fragments are composed per query; only the ones a query needs are
emitted.
"""
from __future__ import annotations

from codemap import constants as K
from codemap.functions import regex as R
from codemap.sources.fixtures import KEYWORD_LIST


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def inl(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def ext(p: str) -> str:
    return f"(CASE WHEN strpos({p}, '.') > 0 THEN '.' || regexp_extract({p}, '[^.]*$') ELSE '' END)"


def fname(p: str) -> str:
    return f"regexp_extract({p}, '[^/]*$')"


def dname(p: str) -> str:
    return f"(CASE WHEN strpos({p}, '/') > 0 THEN left({p}, length({p}) - length({fname(p)}) - 1) ELSE '' END)"


def depth(p: str) -> str:
    return f"(length({p}) - length(replace({p}, '/', '')))"


def noise(p: str) -> str:
    low = f"lower({p})"
    parts = f"string_split({low}, '/')"
    fn = fname(low)
    conds = [f"list_has_any({parts}[1:len({parts}) - 1], {lst(K.NOISE_DIRS)})"]
    conds += [f"starts_with({fn}, {q(x)})" for x in K.NOISE_FILE_PREFIXES]
    conds += [f"ends_with({fn}, {q(x)})" for x in K.NOISE_FILE_SUFFIXES]
    conds += [f"{fn} IN {inl(K.NOISE_FILES)}"]
    return "(" + " OR ".join(conds) + ")"


def penalty(p: str) -> str:
    low = f"lower({p})"
    strong = " OR ".join(f"contains({low}, {q(s)})" for s in K.PENALTY_SUBSTRINGS)
    weak = " OR ".join(f"ends_with({low}, {q(s)})" for s in K.PENALTY_SUFFIXES)
    return f"(CASE WHEN {strong} THEN 0.2::DOUBLE WHEN {weak} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)"


def has_content(c: str = "content") -> str:
    return f"({c} IS NOT NULL AND length({c}) > 0)"


# ---------------------------------------------------------------------------
# fixtures
# ---------------------------------------------------------------------------
FILES = """files AS (
  WITH d AS (
    SELECT doc_id, text, n_chars, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE n END AS gap,
      CAST(floor(doc_id / CASE WHEN doc_id % 3 = 0 THEN 3 ELSE n END) AS BIGINT) AS j,
      CASE WHEN doc_id % 3 = 0 THEN n ELSE doc_id % n END AS r
    FROM documents, (SELECT greatest(20, count(*) // 50) AS n FROM documents)
  ), s AS (
    SELECT d.*, CAST(doc_id AS STRING) AS ds, CAST(CAST(floor(j / 24) AS BIGINT) AS STRING) AS bs,
      CASE WHEN j < 3 THEN '' WHEN j % 7 = 1 THEN '.js' WHEN j % 7 = 4 THEN '.ts'
           WHEN j % 7 = 5 THEN '.md' WHEN j % 7 = 6 THEN '.png' ELSE '.py' END AS ext
    FROM d
  )
  SELECT concat('org/repo', CAST(r AS STRING)) AS repo_id,
    CASE j WHEN 0 THEN 'README.md' WHEN 1 THEN 'Dockerfile' WHEN 2 THEN 'package.json' ELSE concat(
      CASE j % 6 WHEN 0 THEN 'src/app' WHEN 1 THEN 'src/core' WHEN 2 THEN 'tests'
                 WHEN 3 THEN 'pkg/api' WHEN 4 THEN 'src/db' ELSE 'node_modules/x' END,
      '/d', bs, '/',
      CASE j % 8 WHEN 3 THEN 'main' WHEN 5 THEN 'routing' WHEN 6 THEN concat('test_m', ds)
                 ELSE concat('m', ds) END, ext) END AS path,
    j AS tree_ord, doc_id, n_chars * 20 AS size_bytes,
    concat(
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
      text) AS content
  FROM s
)"""

RESPONSES = """responses AS (
  SELECT concat('org/repo', CAST(conv_id % (SELECT greatest(20, count(*) // 50) + 1 FROM documents) AS STRING)) AS repo_id, conv_id * 100 + turn AS response_id,
    CASE turn % 4
      WHEN 0 THEN concat('```json', chr(10), '{"summary":"', md5(text), '","tech_stack":["spark","python","spark"],"main_modules":[1,"routing",true,{"k":1},null,"src/app.py","api.py"," routing ",""],"entry_points":["./main.py","routing.py","nope.py"],"flow_mermaid":" graph TD "}', chr(10), '```')
      WHEN 1 THEN concat('{"summary":"', md5(text), '","tech_stack":[],"main_modules":[],"entry_points":["main.py"],"keywords":["the",2,"import"],"flow_mermaid":["a","b"],"evidence_map":[{"node_id":"a","start_line":12.5},"loose",7]}')
      WHEN 2 THEN '{"summary":7,"tech_stack":"spark","main_modules":null,"flow_mermaid":{"k":1}}'
      ELSE concat('Sure! ', md5(text)) END AS raw
  FROM conversations
)"""


def keywords_cte() -> str:
    vals = ", ".join(f"({i}, {q(k)})" for i, k in enumerate(KEYWORD_LIST))
    return f"""keywords AS (
  SELECT r.repo_id, CAST(k.kw_ord AS BIGINT) AS kw_ord, k.keyword
  FROM (SELECT DISTINCT repo_id FROM files) r, (VALUES {vals}) k(kw_ord, keyword)
)"""


FILE_VECTORS = """file_vectors AS (
  SELECT f.repo_id, f.path, CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM files f JOIN embeddings e ON e.vec_id = f.doc_id % (SELECT count(*) FROM embeddings)
)"""

REPO_VECTORS = """repo_vectors AS (
  SELECT concat('org/repo', CAST(vec_id AS STRING)) AS repo_id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings WHERE vec_id <= (SELECT greatest(20, count(*) // 50) FROM documents)
)"""

REQUESTS = """requests AS (
  SELECT page_id,
    CASE page_id % 5
      WHEN 0 THEN concat('https://github.com/org/repo', CAST(page_id % 20 AS STRING), '.git')
      WHEN 1 THEN concat('https://github.com/org/repo', CAST(page_id % 20 AS STRING), '.git/tree/main')
      WHEN 2 THEN concat('org/repo', CAST(page_id % 20 AS STRING), '/')
      WHEN 3 THEN url
      ELSE 'org' END AS repo_url,
    CAST(8000 AS INTEGER) AS token_budget
  FROM pages
)"""


# ---------------------------------------------------------------------------
# ingestion
# ---------------------------------------------------------------------------
def tree_ctes(max_source_files: int | None = None, max_file_size: int | None = None) -> list[str]:
    skip = (f"list_has_any(string_split(path, '/'), {lst(K.SKIP_DIRS)}) "
            f"OR {ext('path')} IN {inl(K.SKIP_EXTENSIONS)}")
    size = f" AND coalesce(size_bytes, 0) <= {max_file_size}" if max_file_size is not None else ""
    quota = "true" if max_source_files is None else f"quota_rank <= {max_source_files}"
    return [
        f"""ft AS (
  SELECT repo_id, path, tree_ord, CAST(coalesce(size_bytes, 0) AS BIGINT) AS size_bytes, content, doc_id,
    {ext('path')} AS extension, {fname('path')} IN {inl(K.SIGNAL_FILENAMES)} AS is_signal
  FROM files WHERE NOT ({skip}){size}
)""",
        f"""qr AS (
  SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY
    lower({fname('path')}) IN {inl(K.ALWAYS_FETCH_FILENAMES)} DESC, {depth('path')}, size_bytes, tree_ord) AS quota_rank
  FROM ft WHERE extension IN {inl(K.SOURCE_EXTENSIONS)} AND NOT is_signal
)""",
        f"""tree AS (
  SELECT ft.repo_id, ft.path, ft.tree_ord, ft.extension, ft.size_bytes, ft.is_signal, ft.doc_id,
    (ft.is_signal OR coalesce(qr.quota_rank IS NOT NULL AND {quota}, false)) AS fetched,
    CASE WHEN ft.is_signal OR coalesce(qr.quota_rank IS NOT NULL AND {quota}, false) THEN ft.content END AS content
  FROM ft LEFT JOIN qr USING (repo_id, path)
)"""]


def import_ctes() -> list[str]:
    """What the generated headers import, stated from the row numbers: none of the engine's patterns is used.

    Names that would need a negative number are not identifiers, so Python statements with them import nothing.
    """
    def name(prefix: str, shift: str) -> str:
        return f"CASE WHEN doc_id {shift} >= 0 THEN '{prefix}' || CAST(doc_id {shift} AS VARCHAR) END"
    py = ", ".join([name("m", "- gap"), name("pkg.m", "- 7 * gap"), "'main'", name("m", "+ gap"), name("m", "+ 7 * gap"),
                    "'fast' || CAST(doc_id AS VARCHAR)"])
    js = ", ".join(["'./m' || CAST(doc_id - 6 * gap AS VARCHAR)", "'../main'", "'m' || CAST(doc_id - 7 * gap AS VARCHAR)"])
    return [
        """gaps AS (SELECT repo_id, path AS src, extension, doc_id,
    CASE WHEN doc_id % 3 = 0 THEN 3 ELSE (SELECT greatest(20, count(*) // 50) FROM documents) END AS gap
  FROM tree WHERE content IS NOT NULL)""",
        f"""py_imports AS (SELECT * FROM (SELECT repo_id, src, unnest([{py}]) AS module FROM gaps WHERE extension = '.py') WHERE module IS NOT NULL)""",
        f"""js_imports AS (SELECT repo_id, src, unnest([{js}]) AS module FROM gaps WHERE extension = '.js')""",
        """imports AS (SELECT * FROM py_imports UNION ALL SELECT * FROM js_imports)"""]


def resolve_ctes() -> list[str]:
    rel = ", ".join(f"({i}, {q(s)})" for i, s in enumerate(K.RELATIVE_CANDIDATE_SUFFIXES))
    ab = ", ".join(f"({i}, {q(s)})" for i, s in enumerate(K.ABSOLUTE_CANDIDATE_SUFFIXES))
    last = "regexp_extract(m.module, '[^.]*$')"
    return [
        """mods AS (SELECT DISTINCT repo_id, src, module FROM imports)""",
        f"""cands AS (
  SELECT repo_id, src, module, c.prio, {dname('src')} || '/' || regexp_replace(module, '^[./]+', '') || c.sfx AS cand
  FROM mods, (VALUES {rel}) c(prio, sfx) WHERE starts_with(module, '.')
  UNION ALL
  SELECT repo_id, src, module, c.prio, replace(module, '.', '/') || c.sfx AS cand
  FROM mods, (VALUES {ab}) c(prio, sfx) WHERE NOT starts_with(module, '.')
)""",
        f"""resolved AS (
  SELECT repo_id, src, module, dst, prio AS rule FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, src, module ORDER BY prio, dst) AS rn FROM (
      SELECT c.repo_id, c.src, c.module, c.prio, c.cand AS dst
      FROM cands c JOIN tree t ON t.repo_id = c.repo_id AND t.path = c.cand
      UNION ALL
      SELECT m.repo_id, m.src, m.module, {len(K.ABSOLUTE_CANDIDATE_SUFFIXES)} AS prio, min(t.path) AS dst
      FROM mods m JOIN tree t ON t.repo_id = m.repo_id
        AND (ends_with(t.path, '/' || {last} || '.py') OR ends_with(t.path, '/' || {last} || '.js'))
      WHERE NOT starts_with(m.module, '.')
      GROUP BY m.repo_id, m.src, m.module))
  WHERE rn = 1
)""",
        """edges AS (SELECT DISTINCT repo_id, src, dst FROM resolved WHERE src <> dst)"""]


def pagerank_ctes(max_iter: int = K.PAGERANK_MAX_ITER, tol: float = K.PAGERANK_TOL,
                  alpha: float = K.PAGERANK_ALPHA) -> list[str]:
    a = f"CAST({alpha!r} AS DOUBLE)"
    tl = f"CAST({tol!r} AS DOUBLE)"
    out = [
        """ew AS (SELECT repo_id, src AS id, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY repo_id, src) AS w FROM edges)""",
        """pr0 AS MATERIALIZED (
  SELECT t.repo_id, t.path AS id, CAST(count(*) OVER (PARTITION BY t.repo_id) AS DOUBLE) AS n,
    NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = t.repo_id AND e.src = t.path) AS dangling,
    1.0::DOUBLE / count(*) OVER (PARTITION BY t.repo_id) AS x, CAST(NULL AS DOUBLE) AS xp, false AS done, 0 AS it
  FROM tree t
)"""]
    for i in range(1, max_iter + 1):
        p = f"pr{i - 1}"
        fin = f"(s.done OR ({i} > 1 AND coalesce(r.err < s.n * {tl}, false)))"
        out.append(f"""pr{i} AS MATERIALIZED (
  SELECT s.repo_id, s.id, s.n, s.dangling,
    CASE WHEN {fin} THEN s.x ELSE {a} * (coalesce(c.c, 0.0::DOUBLE) + r.dmass / s.n) + (1.0::DOUBLE - {a}) / s.n END AS x,
    CASE WHEN {fin} THEN s.xp ELSE s.x END AS xp, {fin} AS done, CASE WHEN {fin} THEN s.it ELSE {i} END AS it
  FROM {p} s
  JOIN (SELECT repo_id, sum(CASE WHEN dangling THEN x ELSE 0.0::DOUBLE END) AS dmass, sum(abs(x - xp)) AS err
        FROM {p} GROUP BY repo_id) r ON r.repo_id = s.repo_id
  LEFT JOIN (SELECT s2.repo_id, e.dst AS id, sum(s2.x * e.w) AS c FROM {p} s2
             JOIN ew e ON e.repo_id = s2.repo_id AND e.id = s2.id WHERE NOT s2.done
             GROUP BY s2.repo_id, e.dst) c ON c.repo_id = s.repo_id AND c.id = s.id
)""")
    last = f"pr{max_iter}"
    out.append(f"""pagerank AS (
  SELECT s.repo_id, s.id, s.x AS pagerank, (s.done OR coalesce(r.err < s.n * {tl}, false)) AS converged, s.it AS iterations
  FROM {last} s JOIN (SELECT repo_id, sum(abs(x - xp)) AS err FROM {last} GROUP BY repo_id) r ON r.repo_id = s.repo_id
)""")
    return out


def central_cte(name: str, top_n: int) -> str:
    return f"""{name} AS (
  SELECT repo_id, rank, path, pagerank, tree_ord FROM (
    SELECT p.repo_id, p.id AS path, p.pagerank, t.tree_ord,
      CAST(row_number() OVER (PARTITION BY p.repo_id ORDER BY round(p.pagerank, 12) DESC, t.tree_ord) AS INTEGER) AS rank
    FROM pagerank p JOIN tree t ON t.repo_id = p.repo_id AND t.path = p.id
    WHERE NOT {noise('p.id')})
  WHERE rank <= {top_n}
)"""


def graph_ctes() -> list[str]:
    return [FILES] + tree_ctes() + import_ctes() + resolve_ctes()


def distinct_ordered(l: str) -> str:
    """Ordered dedupe of a list (first occurrence kept)."""
    return f"list_filter({l}, lambda dx, di: list_position({l}, dx) = di)"


def with_(ctes: list[str], select: str) -> str:
    if select.lstrip().upper().startswith("WITH "):
        select = select.lstrip()[5:]
        return "WITH " + ",\n".join(ctes) + ",\n" + select
    return "WITH " + ",\n".join(ctes) + "\n" + select


# ---------------------------------------------------------------------------
# per-query oracle SQL
# ---------------------------------------------------------------------------
def _lang_case(p: str) -> str:
    whens = " ".join(f"WHEN {q(e)} THEN {q(l)}" for e, l in K.EXTENSION_TO_LANGUAGE)
    return f"(CASE {ext(p)} {whens} END)"


def _ingestion_queries() -> dict[str, str]:
    T = [FILES] + tree_ctes()
    GR = graph_ctes()
    PRC = GR + pagerank_ctes()
    content_chars = "CAST(coalesce(length(content), 0) AS BIGINT) AS content_chars"
    out = {
        "ingest_filter": with_([FILES] + tree_ctes(K.MAX_SOURCE_FILES, K.MAX_FILE_SIZE),
                               f"SELECT repo_id, path, tree_ord, extension, size_bytes, is_signal, fetched, {content_chars} FROM tree"),
        "ingest_filter_quota10": with_([FILES] + tree_ctes(10, K.MAX_FILE_SIZE),
                                       f"SELECT repo_id, path, tree_ord, extension, size_bytes, is_signal, fetched, {content_chars} FROM tree"),
        "graph_links": with_(GR, "SELECT repo_id, src AS source, dst AS target FROM edges"),
        "signal_files": with_(T, f"SELECT repo_id, path, tree_ord, {content_chars} FROM tree WHERE is_signal"),
        "source_quota": with_([FILES] + tree_ctes(K.MAX_SOURCE_FILES, K.MAX_FILE_SIZE), f"""SELECT repo_id, path, CAST(quota_rank AS INTEGER) AS quota_rank,
  lower({fname('path')}) IN {inl(K.ALWAYS_FETCH_FILENAMES)} AS pinned, CAST({depth('path')} AS BIGINT) AS depth, size_bytes
FROM qr JOIN ft USING (repo_id, path) WHERE quota_rank <= {K.MAX_SOURCE_FILES}"""),
        "ext_profile": with_([FILES], f"""SELECT repo_id, {ext('path')} AS extension, count(*) AS n_files,
  CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM files GROUP BY ALL"""),
        "language_profile": with_(T, f"SELECT repo_id, {_lang_case('path')} AS language, count(*) AS n_files FROM tree GROUP BY ALL"),
        "noise_files": with_(T, f"SELECT repo_id, path, {noise('path')} AS is_noise FROM tree"),
        "path_penalty": with_(T, f"SELECT repo_id, path, {penalty('path')} AS penalty FROM tree"),
        "py_imports": with_(T + import_ctes(), "SELECT repo_id, src, module, count(*) AS n FROM py_imports GROUP BY ALL"),
        "js_imports": with_(T + import_ctes(), "SELECT repo_id, src, module, count(*) AS n FROM js_imports GROUP BY ALL"),
        "resolve_relative": with_(GR, "SELECT repo_id, src, module, dst, CAST(rule AS INTEGER) AS rule FROM resolved WHERE starts_with(module, '.')"),
        "resolve_absolute": with_(GR, "SELECT repo_id, src, module, dst, CAST(rule AS INTEGER) AS rule FROM resolved WHERE NOT starts_with(module, '.')"),
        "dependency_edges": with_(GR, "SELECT repo_id, src, dst FROM edges"),
        "pagerank": with_(PRC, """SELECT repo_id, id AS path, round(pagerank, 9) AS pagerank, converged,
  CAST(iterations AS INTEGER) AS iterations FROM pagerank"""),
        "pagerank_spread": with_(PRC, """SELECT repo_id, id AS path, round(pagerank, 9) AS pagerank, converged,
  CAST(iterations AS INTEGER) AS iterations FROM pagerank"""),
        "central_files": with_(PRC + [central_cte("central", K.REPORT_CENTRAL_TOP_N)],
                               "SELECT repo_id, rank, path, round(pagerank, 9) AS pagerank FROM central"),
        "repo_stats": with_(GR, """SELECT t.repo_id, t.total_files, t.signal_files, t.total_files AS graph_nodes,
  CAST(coalesce(e.graph_edges, 0) AS BIGINT) AS graph_edges
FROM (SELECT repo_id, count(*) AS total_files, count(*) FILTER (WHERE is_signal) AS signal_files FROM tree GROUP BY repo_id) t
LEFT JOIN (SELECT repo_id, count(*) AS graph_edges FROM edges GROUP BY repo_id) e USING (repo_id)"""),
        "degree_stats": with_(GR, """SELECT t.repo_id, t.path,
  (SELECT count(*) FROM edges e WHERE e.repo_id = t.repo_id AND e.src = t.path) AS imports,
  (SELECT count(*) FROM edges e WHERE e.repo_id = t.repo_id AND e.dst = t.path) AS imported_by
FROM tree t"""),
        "graph_payload": with_(PRC + [central_cte("central", K.REPORT_CENTRAL_TOP_N)], """SELECT n.repo_id, n.id,
  EXISTS (SELECT 1 FROM central c WHERE c.repo_id = n.repo_id AND c.path = n.id) AS central,
  (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.src = n.id) AS links_out
FROM (SELECT repo_id, src AS id FROM edges UNION SELECT repo_id, dst FROM edges UNION SELECT repo_id, path FROM central) n"""),
        "ingestion_report": with_(PRC + [central_cte("central", K.REPORT_CENTRAL_TOP_N)], """SELECT t.repo_id, t.total_files,
  coalesce(s.signal_files, '') AS signal_files, t.total_files AS graph_nodes,
  CAST(coalesce(e.graph_edges, 0) AS BIGINT) AS graph_edges, coalesce(c.top_central_files, '') AS top_central_files
FROM (SELECT repo_id, count(*) AS total_files FROM tree GROUP BY repo_id) t
LEFT JOIN (SELECT repo_id, string_agg(path, '|' ORDER BY tree_ord) AS signal_files FROM tree WHERE is_signal GROUP BY repo_id) s USING (repo_id)
LEFT JOIN (SELECT repo_id, count(*) AS graph_edges FROM edges GROUP BY repo_id) e USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(path, '|' ORDER BY rank) AS top_central_files FROM central GROUP BY repo_id) c USING (repo_id)"""),
    }
    return out


def trunc(c: str) -> str:
    cc = f"coalesce({c}, '')"
    return (f"(CASE WHEN length({cc}) > {K.MAX_CHARS_PER_FILE} THEN substring({cc}, 1, {K.MAX_CHARS_PER_FILE}) || "
            f"{q(K.TRUNCATION_MARKER).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))} ELSE {cc} END)")


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(R.PY_WHITESPACE)}), lambda t: t <> '')"


def tokest(x: str) -> str:
    return f"CAST(floor(length({x}) / {K.CHARS_PER_TOKEN}) AS BIGINT)"


def cosine_sql(a: str, b: str) -> str:
    den = f"(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0::DOUBLE WHEN {den} > 0 "
            f"THEN list_inner_product({a}, {b}) / {den} ELSE 0.0::DOUBLE END)")


def bm25_ctes() -> list[str]:
    k1, b, eps = K.BM25_K1, K.BM25_B, K.BM25_EPSILON
    return [
        f"cand AS (SELECT repo_id, path, tree_ord, content FROM tree WHERE {has_content()})",
        f"""dterm AS (SELECT repo_id, path, unnest({toks("lower(path || ' ' || coalesce(content, ''))")}) AS term FROM cand)""",
        "tf AS (SELECT repo_id, path, term, count(*) AS tf FROM dterm GROUP BY ALL)",
        """docs AS (SELECT c.repo_id, c.path, CAST(coalesce(d.dl, 0) AS BIGINT) AS dl FROM cand c
  LEFT JOIN (SELECT repo_id, path, count(*) AS dl FROM dterm GROUP BY ALL) d USING (repo_id, path))""",
        "nd AS (SELECT repo_id, count(*) AS n_docs, avg(dl) AS avgdl FROM docs GROUP BY repo_id)",
        """rawidf AS (SELECT d.repo_id, d.term, d.df, ln(n.n_docs - d.df + 0.5::DOUBLE) - ln(d.df + 0.5::DOUBLE) AS raw_idf
  FROM (SELECT repo_id, term, count(*) AS df FROM tf GROUP BY ALL) d JOIN nd n USING (repo_id))""",
        "avgidf AS (SELECT repo_id, avg(raw_idf) AS average_idf FROM rawidf GROUP BY repo_id)",
        f"""idf AS (SELECT r.repo_id, r.term, CASE WHEN raw_idf < 0 THEN {eps}::DOUBLE * a.average_idf ELSE raw_idf END AS idf
  FROM rawidf r JOIN avgidf a USING (repo_id))""",
        f"""qt AS (SELECT repo_id, term, count(*) AS qn FROM (SELECT repo_id, unnest({toks('lower(keyword)')}) AS term FROM keywords) GROUP BY ALL)""",
        f"""bm AS (SELECT d.repo_id, d.path, coalesce(s.s, 0.0::DOUBLE) AS bm25_raw FROM docs d LEFT JOIN (
  SELECT tf.repo_id, tf.path, sum(qt.qn * idf.idf * (tf.tf * {k1 + 1}::DOUBLE)
     / (tf.tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * docs.dl / nd.avgdl))) AS s
  FROM tf JOIN qt USING (repo_id, term) JOIN idf USING (repo_id, term) JOIN docs USING (repo_id, path) JOIN nd USING (repo_id)
  GROUP BY ALL) s USING (repo_id, path))""",
        """bm25 AS (SELECT b.repo_id, b.path, b.bm25_raw, b.bm25_raw / CASE WHEN m.mx > 0 THEN m.mx ELSE 1.0::DOUBLE END AS bm25
  FROM bm b JOIN (SELECT repo_id, max(bm25_raw) AS mx FROM bm GROUP BY repo_id) m USING (repo_id))"""]


def retrieval_ctes(budget: int, ep_sql: str | None = None) -> list[str]:
    """cand/bm25 + pagerank signal, shortlist, hybrid rank and budgeted selection (``sel``)."""
    ep_sql = ep_sql or f"SELECT DISTINCT repo_id, path FROM tree WHERE {fname('path')} = 'main.py'"
    return bm25_ctes() + [
        FILE_VECTORS, REPO_VECTORS,
        f"ep AS ({ep_sql})",
        """prs AS (SELECT c.repo_id, c.path, CASE WHEN coalesce(m.ok, false) THEN coalesce(p.pagerank, 0.0::DOUBLE) / m.mx ELSE 0.0::DOUBLE END AS pagerank
  FROM cand c LEFT JOIN pagerank p ON p.repo_id = c.repo_id AND p.id = c.path
  LEFT JOIN (SELECT repo_id, max(pagerank) AS mx, bool_and(converged) AS ok FROM pagerank GROUP BY repo_id) m ON m.repo_id = c.repo_id)""",
        f"""pre AS (SELECT * FROM (SELECT c.repo_id, c.path, c.tree_ord,
    CAST(row_number() OVER (PARTITION BY c.repo_id ORDER BY round({K.PRERANK_WEIGHT}::DOUBLE * p.pagerank + {K.PRERANK_WEIGHT}::DOUBLE * b.bm25, 9) DESC, c.tree_ord) AS INTEGER) AS pre_rank
  FROM cand c JOIN prs p USING (repo_id, path) JOIN bm25 b USING (repo_id, path)) WHERE pre_rank <= {K.SEMANTIC_SHORTLIST})""",
        f"""semraw AS (SELECT p.repo_id, p.path, p.pre_rank, greatest(0.0::DOUBLE, {cosine_sql('rv.embedding', 'fv.embedding')}) AS cos_raw
  FROM pre p LEFT JOIN file_vectors fv ON fv.repo_id = p.repo_id AND fv.path = p.path LEFT JOIN repo_vectors rv ON rv.repo_id = p.repo_id)""",
        """sem AS (SELECT s.repo_id, s.path, s.pre_rank, s.cos_raw / CASE WHEN m.mx > 0 THEN m.mx ELSE 1.0::DOUBLE END AS semantic
  FROM semraw s JOIN (SELECT repo_id, max(cos_raw) AS mx FROM semraw GROUP BY repo_id) m USING (repo_id))""",
        f"""ranked AS (SELECT c.repo_id, c.path, c.tree_ord, c.content, p.pagerank, b.bm25, coalesce(s.semantic, 0.0::DOUBLE) AS semantic,
    {penalty('c.path')} AS penalty, CASE WHEN e.path IS NOT NULL THEN {K.ENTRY_BONUS}::DOUBLE ELSE 1.0::DOUBLE END AS bonus,
    ({K.WEIGHT_PAGERANK}::DOUBLE * p.pagerank + {K.WEIGHT_BM25}::DOUBLE * b.bm25 + {K.WEIGHT_SEMANTIC}::DOUBLE * coalesce(s.semantic, 0.0::DOUBLE))
      * {penalty('c.path')} * CASE WHEN e.path IS NOT NULL THEN {K.ENTRY_BONUS}::DOUBLE ELSE 1.0::DOUBLE END AS score
  FROM cand c JOIN prs p USING (repo_id, path) JOIN bm25 b USING (repo_id, path)
  LEFT JOIN sem s USING (repo_id, path) LEFT JOIN ep e USING (repo_id, path))""",
        f"""top AS (SELECT repo_id, rank, path, tree_ord, score, {trunc('content')} AS content, content AS full_content, {tokest(trunc('content'))} AS tokens FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY round(score, 9) DESC, tree_ord) AS INTEGER) AS rank FROM ranked)
  WHERE rank <= {K.MAX_FILES})""",
        f"""sel AS (SELECT * FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY repo_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_tokens FROM top)
  WHERE rank <= {K.MIN_FILES} OR cum_tokens <= {budget})"""]


def _retrieval_queries() -> dict[str, str]:
    GP = graph_ctes() + pagerank_ctes()
    T = [FILES] + tree_ctes()
    BM = T + [keywords_cte()] + bm25_ctes()
    RT = lambda budget: GP + [keywords_cte()] + retrieval_ctes(budget)
    return {
        "truncate_tokens": with_(T, f"""SELECT repo_id, path, CAST(length(content) AS BIGINT) AS chars,
  CAST(length({trunc('content')}) AS BIGINT) AS truncated_chars, {tokest(trunc('content'))} AS tokens FROM tree WHERE {has_content()}"""),
        "repo_fits_budget": with_(T, f"""SELECT repo_id, CAST(sum({tokest(trunc('content'))}) AS BIGINT) AS total_tokens,
  sum({tokest(trunc('content'))}) <= {K.API_TOKEN_BUDGET} AS fits FROM tree WHERE {has_content()} GROUP BY repo_id"""),
        "bm25_corpus_stats": with_(BM, """SELECT n.repo_id, n.n_docs, round(n.avgdl, 9) AS avgdl, round(a.average_idf, 9) AS average_idf, t.n_terms
  FROM nd n JOIN avgidf a USING (repo_id) JOIN (SELECT repo_id, count(*) AS n_terms FROM idf GROUP BY repo_id) t USING (repo_id)"""),
        "bm25_rank": with_(BM, "SELECT repo_id, path, round(bm25_raw, 9) AS bm25_raw, round(bm25, 9) AS bm25 FROM bm25"),
        "bm25_index": with_(BM, "SELECT repo_id, path, round(bm25_raw, 9) AS bm25_raw, round(bm25, 9) AS bm25 FROM bm25"),
        "bm25_top": with_(BM, f"""SELECT repo_id, CAST(r AS INTEGER) AS rank, path, round(bm25_raw, 9) AS bm25_raw FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY round(bm25_raw, 9) DESC, path) AS r FROM bm
  WHERE (repo_id, path) IN (SELECT (repo_id, path) FROM tf JOIN qt USING (repo_id, term))) WHERE r <= {K.SEMANTIC_SHORTLIST}"""),
        "cosine_rank": with_(T + [FILE_VECTORS, REPO_VECTORS, f"""sr AS (SELECT c.repo_id, c.path, greatest(0.0::DOUBLE, {cosine_sql('rv.embedding', 'fv.embedding')}) AS cos_raw
  FROM tree c LEFT JOIN file_vectors fv ON fv.repo_id = c.repo_id AND fv.path = c.path LEFT JOIN repo_vectors rv ON rv.repo_id = c.repo_id
  WHERE {has_content('c.content')})"""], """SELECT s.repo_id, s.path, round(s.cos_raw, 9) AS cos_raw, round(s.cos_raw / CASE WHEN m.mx > 0 THEN m.mx ELSE 1.0::DOUBLE END, 9) AS semantic
FROM sr s JOIN (SELECT repo_id, max(cos_raw) AS mx FROM sr GROUP BY repo_id) m USING (repo_id)"""),
        "semantic_shortlist": with_(RT(K.TOKEN_BUDGET_DEFAULT), "SELECT repo_id, path, pre_rank, round(semantic, 9) AS semantic FROM sem"),
        "hybrid_rank": with_(RT(K.TOKEN_BUDGET_DEFAULT), """SELECT repo_id, path, round(pagerank, 9) AS pagerank, round(bm25, 9) AS bm25,
  round(semantic, 9) AS semantic, penalty, bonus, round(score, 9) AS score FROM ranked"""),
        "budget_select": with_(RT(K.API_TOKEN_BUDGET), "SELECT repo_id, rank, path, round(score, 9) AS score, tokens, cum_tokens FROM sel"),
        "select_top_k": with_(RT(K.TOKEN_BUDGET_DEFAULT), "SELECT repo_id, rank, path, CAST(length(content) AS BIGINT) AS content_chars, md5(content) AS content_md5 FROM sel"),
        "compress_folders": with_(RT(K.API_TOKEN_BUDGET), f"""SELECT repo_id, regexp_extract(path, '^[^/]*') AS folder, count(*) AS n_files,
  CAST(count(*) AS VARCHAR) || {q(K.COMPRESSED_FOLDER_TEXT)} AS summary
FROM tree t WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.repo_id = t.repo_id AND s.path = t.path) GROUP BY ALL"""),
    }


WORD = r"[\p{L}\p{N}_]"
EVIDENCE_PATTERNS = [
    ("route", 0, K.ROUTE_PATTERN, None, 1, False),
    ("route", 1, K.VERB_ROUTE_PATTERN, 1, 2, False),
    ("handler", 0, K.DEF_PATTERN, None, 1, True),
    ("handler", 1, K.CLASS_PATTERN, None, 1, True),
    ("db_call", 0, K.DB_CALL_PATTERN, None, 1, False),
]


def evidence_sql(src: str, rank_col: str = "NULL") -> str:
    """Union of all pattern extractions over relation ``src(repo_id, path, content[, rank])``."""
    if src == "sel":  # whole contents, not the cut ones
        src = "(SELECT * REPLACE (full_content AS content) FROM sel)"
    parts = []
    for kind, pord, pat, mg, vg, ml in EVIDENCE_PATTERNS:
        rp = q(("(?m)" if ml else "") + pat.replace(r"\w", WORD))
        meth = f"regexp_extract_all(content, {rp}, {mg})" if mg else f"list_transform(v, lambda x: NULL::VARCHAR)"
        parts.append(f"""SELECT repo_id, {q(kind)} AS kind, file, file_rank, {pord} AS pattern_ord,
    CAST(unnest(range(1, len(v) + 1)) AS INTEGER) AS match_ord, upper(unnest(m)) AS method, unnest(v) AS value
  FROM (SELECT repo_id, path AS file, {rank_col} AS file_rank, v, {meth.replace('content', 'c')} AS m
        FROM (SELECT *, content AS c, regexp_extract_all(content, {rp}, {vg}) AS v FROM {src} WHERE {has_content()}))""")
    return "\nUNION ALL\n".join(parts)


def evmap_ctes() -> list[str]:
    return [
        f"""evsrc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tree_ord) AS ord FROM tree
   WHERE extension IN {inl(K.SOURCE_EXTENSIONS)} AND NOT {noise('path')}))""",
        f"""evidence_map AS (SELECT repo_id, CAST(ord AS INTEGER) AS ord,
    CASE WHEN ord % 3 = 0 THEN '' ELSE 'n' || CAST(tree_ord AS VARCHAR) END AS node_id, {fname('path')} AS label,
    CASE WHEN ord % 5 = 0 THEN 'missing.py' ELSE path END AS file,
    CAST(CASE WHEN ord % 4 = 0 THEN 0 ELSE ord * 3 END AS INTEGER) AS start_line,
    CAST(CASE WHEN ord % 6 = 0 THEN NULL ELSE ord * 3 + 4 END AS INTEGER) AS end_line FROM evsrc)""",
        f"""diagram_nodes AS (SELECT repo_id, 'n' || CAST(tree_ord AS VARCHAR) AS node_id, upper({fname('path')}) || ' handler' AS label FROM evsrc)""",
        """repos AS (SELECT DISTINCT repo_id, 'https://github.com/' || repo_id AS repo_url,
    CASE WHEN right(repo_id, 1) IN ('1', '3') THEN 'dev' END AS default_branch FROM files)"""]


def _evidence_queries() -> dict[str, str]:
    T = [FILES] + tree_ctes()
    GP = graph_ctes() + pagerank_ctes()
    RT = GP + [keywords_cte()] + retrieval_ctes(K.API_TOKEN_BUDGET)
    stem = "lower(regexp_replace(" + fname("e.file") + ", '\\.[A-Za-z0-9_]+$', ''))"
    out = {}
    for kind, name in [("route", "evidence_routes"), ("handler", "evidence_handlers"), ("db_call", "evidence_db_calls")]:
        out[name] = with_(T + [f"ev AS ({evidence_sql('tree')})"],
                          f"SELECT repo_id, file, pattern_ord, match_ord, method, value FROM ev WHERE kind = {q(kind)}")
    out["evidence_capped"] = with_(RT + [f"ev AS ({evidence_sql('sel', 'rank')})"], """SELECT repo_id, kind, ev_rank, file, pattern_ord, match_ord, method, value
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, kind ORDER BY file_rank, file, pattern_ord, match_ord) AS INTEGER) AS ev_rank FROM ev)
WHERE ev_rank <= 20""")
    out["evidence_links"] = with_(T + evmap_ctes() + [
        f"""cand_m AS (
  SELECT n.repo_id, n.node_id, 0 AS rule, e.ord FROM diagram_nodes n JOIN evidence_map e
    ON e.repo_id = n.repo_id AND n.node_id <> '' AND e.node_id = n.node_id
  UNION ALL
  SELECT n.repo_id, n.node_id, 1 AS rule, e.ord FROM diagram_nodes n JOIN evidence_map e
    ON e.repo_id = n.repo_id AND contains(lower(n.label), {stem}) AND length(n.label) > 0
  UNION ALL
  SELECT n.repo_id, n.node_id, 2 AS rule, e.ord FROM diagram_nodes n JOIN evidence_map e
    ON e.repo_id = n.repo_id AND contains(lower(n.label), lower({fname('e.file')})) AND length(n.label) > 0)""",
        """best AS (SELECT repo_id, node_id, rule, ord FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, node_id ORDER BY rule, ord) AS rn FROM cand_m) WHERE rn = 1)"""],
        """SELECT n.repo_id, n.node_id, CAST(coalesce(b.rule, -1) AS INTEGER) AS rule, e.file,
  CASE WHEN e.file IS NOT NULL THEN r.repo_url || '/blob/' || coalesce(nullif(r.default_branch, ''), 'main') || '/' || e.file ||
    CASE WHEN coalesce(e.start_line, 0) <> 0 THEN '#L' || CAST(e.start_line AS VARCHAR) ||
      CASE WHEN coalesce(e.end_line, 0) <> 0 THEN '-L' || CAST(e.end_line AS VARCHAR) ELSE '' END ELSE '' END END AS url
FROM diagram_nodes n LEFT JOIN best b ON b.repo_id = n.repo_id AND b.node_id = n.node_id
LEFT JOIN evidence_map e ON e.repo_id = b.repo_id AND e.ord = b.ord LEFT JOIN repos r ON r.repo_id = n.repo_id""")
    out["evidence_validate"] = with_(RT + evmap_ctes(), """SELECT e.repo_id, e.ord, e.node_id, e.file, coalesce(e.node_id, '') <> '' AS has_node,
  EXISTS (SELECT 1 FROM sel s WHERE s.repo_id = e.repo_id AND s.path = e.file) AS file_available FROM evidence_map e""")
    return out


WS_EDGES = "^" + R.PY_WHITESPACE + "|" + R.PY_WHITESPACE + "$"


def pystrip(x: str) -> str:
    return f"regexp_replace({x}, {q(WS_EDGES)}, '', 'g')"


def clean_json(raw: str) -> str:
    t = pystrip(raw)
    return f"(CASE WHEN starts_with({t}, '```') THEN {pystrip(f'replace(replace({t}, {q(chr(96)*3 + 'json')}, {q(chr(39)*0)}), {q(chr(96)*3)}, {q(chr(39)*0)})')} ELSE {t} END)"


def ends_any(x: str, sfx) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {q(v)})" for v in sfx) + ")"


def ctx_score(p: str) -> str:
    low = f"lower({p})"
    fn = fname(low)
    terms = [f"CASE WHEN contains({low}, {q(h)}) THEN 2 ELSE 0 END" for h in K.IMPORTANT_HINTS]
    terms += [f"CASE WHEN {fn} IN {inl(K.ENTRY_FILE_NAMES)} THEN 4 ELSE 0 END",
              f"CASE WHEN {fn} IN {inl(K.FRAMEWORK_CORE_NAMES)} THEN 6 ELSE 0 END",
              f"CASE WHEN {fn} = '__init__.py' THEN 1 ELSE 0 END"]
    return f"CAST(CASE WHEN {noise(p)} THEN -100 ELSE {' + '.join(terms)} END AS INTEGER)"


def ep_score(p: str, c: str) -> str:
    low = f"lower({p})"
    fn = fname(low)
    text = f"lower(coalesce({c}, ''))"
    tok = " OR ".join(f"contains({fn}, {q(t)})" for t in K.ENTRY_NAME_TOKENS)
    terms = [f"CASE WHEN {fn} IN {inl(K.ENTRY_FILE_NAMES)} THEN 8 ELSE 0 END",
             f"CASE WHEN {fn} IN {inl(K.FRAMEWORK_CORE_NAMES)} THEN 6 ELSE 0 END",
             f"CASE WHEN {tok} THEN 3 ELSE 0 END",
             f"CASE WHEN {fn} = '__init__.py' THEN -3 ELSE 0 END"]
    terms += [f"CASE WHEN contains({text}, {q(sig)}) THEN 6 ELSE 0 END" for sig in K.STARTUP_SIGNALS]
    return (f"CAST(CASE WHEN {noise(p)} OR NOT {ends_any(low, K.VALID_EXTENSIONS)} THEN -100 "
            f"ELSE {' + '.join(terms)} END AS INTEGER)")


def ep_valid(p: str, c: str) -> str:
    low = f"lower({p})"
    return (f"(NOT {noise(p)} AND NOT {ends_any(low, K.DOC_CONFIG_SUFFIXES)} AND {ends_any(low, K.VALID_EXTENSIONS)} "
            f"AND (CASE WHEN {fname(low)} = '__init__.py' THEN {ep_score(p, c)} >= 6 ELSE true END))")


def parse_ctes() -> list[str]:
    def sf(f):
        return f"CASE WHEN ok AND json_type(cj, '$.{f}') = 'VARCHAR' THEN json_extract_string(cj, '$.{f}') ELSE '' END AS {f}"

    def lf(f):
        return (f"CASE WHEN ok AND json_type(cj, '$.{f}') = 'ARRAY' THEN list_transform(list_filter(json_extract(cj, '$.{f}[*]'), "
                f"lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') ELSE CAST([] AS VARCHAR[]) END AS {f}")
    return [RESPONSES,
            f"""parsed AS (SELECT repo_id, response_id, ok AS parse_ok, {sf('summary')}, {sf('domain')},
  {lf('tech_stack')}, {lf('main_modules')}, {lf('entry_points')}, {lf('keywords')}
  FROM (SELECT *, CASE WHEN ok THEN cl ELSE '{{}}' END AS cj FROM (
        SELECT *, coalesce(json_valid(cl) AND json_type(CASE WHEN json_valid(cl) THEN cl ELSE '{{}}' END) = 'OBJECT', false) AS ok
        FROM (SELECT repo_id, response_id, {clean_json('raw')} AS cl FROM responses))))""",
            """ctx AS (SELECT p.* FROM parsed p JOIN (SELECT repo_id, min(response_id) AS rid FROM parsed WHERE parse_ok GROUP BY repo_id) m
  ON m.repo_id = p.repo_id AND m.rid = p.response_id)"""]


def ctxfiles_ctes() -> list[str]:
    return [central_cte("central30", K.CONTEXT_CENTRAL_TOP_N),
            f"""ctxf AS (SELECT * FROM (SELECT c.repo_id, c.path, t.content, {ctx_score('c.path')} AS score,
    CAST(row_number() OVER (PARTITION BY c.repo_id ORDER BY {ctx_score('c.path')} DESC, c.path) AS INTEGER) AS ctx_rank
  FROM (SELECT repo_id, path FROM central30 UNION
        SELECT repo_id, path FROM tree WHERE NOT {noise('path')} AND {ctx_score('path')} >= 3) c
  JOIN tree t ON t.repo_id = c.repo_id AND t.path = c.path) WHERE ctx_rank <= {K.CONTEXT_FILES_TOP_N})"""]


def ep_ctes() -> list[str]:
    """LLM entry points (normalised, filtered), fallback tiers and the final top-5."""
    cand = "regexp_replace(" + pystrip("r.raw") + ", '^[./]+', '')"
    return [
        """rawep AS (SELECT repo_id, CAST(unnest(range(0, len(entry_points))) AS INTEGER) AS ep_ord, unnest(entry_points) AS raw FROM ctx)""",
        f"""epn AS (SELECT r.repo_id, r.ep_ord, r.raw, CASE WHEN {cand} = '' THEN NULL ELSE coalesce(
    (SELECT min(t.path) FROM tree t WHERE t.repo_id = r.repo_id AND t.path = {cand}),
    (SELECT min(t.path) FROM tree t WHERE t.repo_id = r.repo_id AND t.path = 'src/' || {cand}),
    (SELECT CASE WHEN count(*) = 1 THEN min(t.path) END FROM tree t WHERE t.repo_id = r.repo_id AND ends_with(t.path, {cand})),
    (SELECT CASE WHEN count(*) = 1 THEN min(t.path) END FROM tree t WHERE t.repo_id = r.repo_id AND {fname('t.path')} = {fname(cand)})) END AS path
  FROM rawep r)""",
        f"""llm_ep AS (SELECT e.repo_id, e.path, {ep_score('e.path', 't.content')} AS score FROM
  (SELECT repo_id, path FROM epn WHERE path IS NOT NULL GROUP BY repo_id, path) e JOIN tree t ON t.repo_id = e.repo_id AND t.path = e.path
  WHERE {ep_valid('e.path', 't.content')} AND {ep_score('e.path', 't.content')} >= 4)""",
        f"""fb_all AS (
  SELECT repo_id, path, {ep_score('path', 'content')} AS score, 1 AS tier FROM ctxf WHERE {ep_valid('path', 'content')} AND {ep_score('path', 'content')} >= 4
  UNION ALL
  SELECT repo_id, path, {ep_score('path', 'content')} AS score, 2 AS tier FROM tree WHERE {ep_valid('path', 'content')} AND {ep_score('path', 'content')} >= 5)""",
        """fb_ep AS (SELECT f.* FROM fb_all f JOIN (SELECT repo_id, min(tier) AS tier FROM fb_all GROUP BY repo_id) m USING (repo_id, tier))""",
        """ep_all AS (SELECT repo_id, path, score FROM llm_ep
  UNION ALL SELECT repo_id, path, score FROM fb_ep WHERE repo_id NOT IN (SELECT repo_id FROM llm_ep))""",
        f"""final_ep AS (SELECT * FROM (SELECT repo_id, path, score,
    CAST(row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path DESC) AS INTEGER) AS ep_rank FROM ep_all) WHERE ep_rank <= {K.MAX_ENTRY_POINTS})"""]


def fbkw_cte() -> str:
    terms = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(K.KEYWORD_TERMS))
    defs = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(K.DEFAULT_KEYWORDS))
    return f"""fbkw AS (SELECT repo_id, CAST(kw_ord AS INTEGER) AS kw_ord, keyword FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY kw_ord) AS r FROM (
    SELECT DISTINCT c.repo_id, k.i AS kw_ord, k.t AS keyword FROM ctxf c, (VALUES {terms}) k(i, t)
      WHERE contains(lower(coalesce(c.content, '')), k.t) OR contains(lower(c.path), k.t)
    UNION ALL
    SELECT r.repo_id, d.i, d.t FROM (SELECT DISTINCT repo_id FROM files) r, (VALUES {defs}) d(i, t)
      WHERE r.repo_id NOT IN (SELECT c.repo_id FROM ctxf c, (VALUES {terms}) k(i, t)
        WHERE contains(lower(coalesce(c.content, '')), k.t) OR contains(lower(c.path), k.t))))
  WHERE r <= {K.MAX_KEYWORDS})"""


def clean_mods(lst: str) -> str:
    keep = (f"list_filter(list_transform({lst}, lambda m: {pystrip('m')}), lambda m: m IS NOT NULL AND m <> '' "
            f"AND NOT contains(m, '/') AND NOT {ends_any('m', K.VALID_EXTENSIONS)})")
    return distinct_ordered(keep)


def _context_queries() -> dict[str, str]:
    T = [FILES] + tree_ctes()
    GP = graph_ctes() + pagerank_ctes()
    CF = GP + ctxfiles_ctes()
    CTX = CF + parse_ctes() + ep_ctes()
    return {
        "clean_llm_json": with_([RESPONSES], f"SELECT repo_id, response_id, {clean_json('raw')} AS cleaned FROM responses"),
        "parse_context": with_(parse_ctes(), """SELECT repo_id, response_id, parse_ok, summary, domain, array_to_string(tech_stack, '|') AS tech_stack,
  array_to_string(main_modules, '|') AS main_modules, array_to_string(entry_points, '|') AS entry_points,
  array_to_string(keywords, '|') AS keywords FROM parsed"""),
        "context_score": with_(T, f"SELECT repo_id, path, {ctx_score('path')} AS score FROM tree"),
        "entry_point_score": with_(T, f"SELECT repo_id, path, {ep_score('path', 'content')} AS score, {ep_valid('path', 'content')} AS valid FROM tree"),
        "context_files": with_(CF, "SELECT repo_id, ctx_rank, path, score FROM ctxf"),
        "entry_point_normalise": with_(CTX, "SELECT repo_id, ep_ord, raw, path FROM epn"),
        "entry_points": with_(CTX, f"""SELECT repo_id, ep_rank, path, score FROM (SELECT repo_id, path, score,
  CAST(row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path DESC) AS INTEGER) AS ep_rank FROM llm_ep) WHERE ep_rank <= {K.MAX_ENTRY_POINTS}"""),
        "fallback_entry_points": with_(CTX, f"""SELECT repo_id, ep_rank, path, score, tier FROM (SELECT repo_id, path, score, tier,
  CAST(row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path DESC) AS INTEGER) AS ep_rank FROM fb_ep) WHERE ep_rank <= {K.MAX_ENTRY_POINTS}"""),
        "fallback_keywords": with_(CF + [fbkw_cte()], "SELECT repo_id, kw_ord, keyword FROM fbkw"),
        "clean_modules": with_(parse_ctes(), f"SELECT repo_id, response_id, array_to_string({clean_mods('main_modules')}[1:{K.MAX_MODULES}], '|') AS main_modules FROM parsed WHERE parse_ok"),
        "context_finalise": with_(CTX + [fbkw_cte()], context_final_sql()),
    }


def context_final_cte() -> str:
    mods = f"{clean_mods('c.main_modules')}[1:{K.MAX_MODULES}]"
    defmods = lst(K.DEFAULT_MODULES)
    return f"""fin AS (SELECT r.repo_id, coalesce(c.summary, '') AS summary, coalesce(c.domain, '') AS domain,
  {distinct_ordered("coalesce(c.tech_stack, CAST([] AS VARCHAR[]))")} AS tech_stack,
  {distinct_ordered(f"(CASE WHEN len(coalesce({mods}, CAST([] AS VARCHAR[]))) = 0 THEN {defmods} ELSE {mods} END)")} AS main_modules,
  coalesce((SELECT list(path ORDER BY ep_rank) FROM final_ep e WHERE e.repo_id = r.repo_id), CAST([] AS VARCHAR[])) AS entry_points,
  CASE WHEN len(coalesce(c.keywords, CAST([] AS VARCHAR[]))) > 0 THEN {distinct_ordered("c.keywords")}[1:{K.MAX_KEYWORDS}]
       ELSE coalesce((SELECT list(keyword ORDER BY kw_ord) FROM fbkw k WHERE k.repo_id = r.repo_id), CAST([] AS VARCHAR[])) END AS keywords
FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN ctx c ON c.repo_id = r.repo_id)"""


def context_final_sql() -> str:
    return "WITH " + context_final_cte() + """
SELECT repo_id, summary, domain, array_to_string(tech_stack, '|') AS tech_stack, array_to_string(main_modules, '|') AS main_modules,
  array_to_string(entry_points, '|') AS entry_points, array_to_string(keywords, '|') AS keywords FROM fin"""


URL_RE = r"^https?://([^/?#]*)([^?#]*)"
PAGE_RE = r"^https?://github\.com/([^/]+)/([^/?#]+)"


def tree_listing_cte() -> str:
    return """tl AS (SELECT repo_id, path, tree_ord, CASE WHEN tree_ord % 11 = 5 THEN 'tree' WHEN tree_ord % 11 = 8 THEN 'commit' ELSE 'blob' END AS type, CASE WHEN tree_ord % 10 = 9 THEN NULL ELSE size_bytes END AS size,
  CASE WHEN tree_ord % 13 = 4 THEN 'utf-8' ELSE 'base64' END AS encoding,
  CASE WHEN tree_ord % 17 = 3 THEN '!' ELSE to_base64(encode(content)) END AS content_b64 FROM files)"""


def after_first(x: str, sep: str) -> str:
    return f"(CASE WHEN strpos({x}, {q(sep)}) > 0 THEN substring({x}, strpos({x}, {q(sep)}) + {len(sep)}) ELSE {x} END)"


def before_last(x: str, sep: str) -> str:
    r = f"strpos(reverse({x}), {q(sep[::-1])})"
    return f"(CASE WHEN {r} > 0 THEN left({x}, length({x}) - {r} - {len(sep) - 1}) ELSE {x} END)"


def arch_ctes(src: str = "responses") -> list[str]:
    fence = pystrip(before_last(after_first("raw", "```json"), "```"))

    def ftxt(f):
        t = f"json_type(cj, '$.{f}')"
        return (f"CASE WHEN {t} IS NULL THEN '' WHEN {t} = 'VARCHAR' THEN json_extract_string(cj, '$.{f}') "
                f"WHEN {t} = 'NULL' THEN NULL ELSE CAST(json_extract(cj, '$.{f}') AS VARCHAR) END")
    ft = "json_type(cj, '$.flow_mermaid')"
    fs = pystrip("coalesce(json_extract_string(cj, '$.flow_mermaid'), '')")
    flow = (f"CASE WHEN {ft} = 'ARRAY' THEN json_extract_string(cj, '$.flow_mermaid[*]') "
            f"WHEN {ft} = 'VARCHAR' AND {fs} <> '' THEN [{fs}] ELSE CAST([] AS VARCHAR[]) END")
    return [f"""arch AS (SELECT repo_id, response_id, ok AS parse_ok,
    CASE WHEN ok THEN {ftxt('narrative_summary')} ELSE '' END AS narrative_summary,
    CASE WHEN ok THEN {ftxt('architecture_mermaid')} ELSE {q(K.UNPARSEABLE_ARCHITECTURE).replace(chr(10), "' || chr(10) || '")} END AS architecture_mermaid,
    CASE WHEN ok THEN {flow} ELSE CAST([] AS VARCHAR[]) END AS flow_mermaid,
    CAST(CASE WHEN ok AND json_type(cj, '$.evidence_map') = 'ARRAY' THEN json_array_length(cj, '$.evidence_map') ELSE 0 END AS INTEGER) AS evidence_entries
  FROM (SELECT *, CASE WHEN ok THEN j ELSE '{{}}' END AS cj FROM (
    SELECT *, coalesce(json_valid(j), false) AND json_type(CASE WHEN json_valid(j) THEN j ELSE '{{}}' END) = 'OBJECT' AS ok FROM (
      SELECT repo_id, response_id, raw, CASE WHEN json_valid(raw) THEN raw ELSE {fence} END AS j FROM {src}))))"""]


def template_sql(template: list[str], parts: dict[str, str]) -> str:
    pieces = []
    for i, line in enumerate(template):
        if i:
            pieces.append("chr(10) || chr(10)")
        if line.startswith("{") and line.endswith("}") and line[1:-1] in parts:
            pieces.append(f"coalesce({parts[line[1:-1]]}, '')")
        else:
            pieces.append(q(line))
    return " || ".join(pieces)


def report_ctes(budget: int) -> list[str]:
    """Everything the end-to-end report needs: context, retrieval on the context, evidence, replies."""
    GP = graph_ctes() + pagerank_ctes()
    CTX = GP + ctxfiles_ctes() + parse_ctes() + ep_ctes() + [fbkw_cte(), context_final_cte()]
    kw = """keywords AS (SELECT repo_id, CAST(unnest(range(0, len(keywords))) AS BIGINT) AS kw_ord, unnest(keywords) AS keyword FROM fin)"""
    ret = retrieval_ctes(budget, "SELECT DISTINCT repo_id, unnest(entry_points) AS path FROM fin")
    ev = [f"ev AS ({evidence_sql('sel', 'rank')})",
          """evc AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, kind ORDER BY file_rank, file, pattern_ord, match_ord) AS INTEGER) AS ev_rank FROM ev) WHERE ev_rank <= 20)"""]
    return CTX + [kw] + ret + ev + [central_cte("central10", K.REPORT_CENTRAL_TOP_N)] + [
        c.replace("arch AS (", "arch_all AS (", 1) for c in arch_ctes()] + [
        """arch AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY parse_ok DESC, response_id DESC) AS rn FROM arch_all) WHERE rn = 1)"""]


def _final_queries() -> dict[str, str]:
    from codemap.plans.prompts import ARCH_TEMPLATE, CONTEXT_TEMPLATE
    T = [FILES] + tree_ctes()
    hosts = inl(K.GITHUB_HOSTS)
    norm = f"""WITH {REQUESTS},
n AS (SELECT *, regexp_replace({pystrip('repo_url')}, '/+$', '') AS u FROM requests),
m AS (SELECT *, starts_with(u, 'http://') OR starts_with(u, 'https://') AS is_http, regexp_extract(u, {q(URL_RE)}, 1) AS host,
  list_filter(string_split(regexp_extract(u, {q(URL_RE)}, 2), '/'), lambda p: p <> '') AS url_parts,
  list_filter(string_split(u, '/'), lambda p: p <> '') AS id_parts FROM n),
e AS (SELECT *, CASE WHEN u = '' THEN 'empty repository url' WHEN is_http AND host NOT IN {hosts} THEN 'not a github url'
    WHEN is_http AND len(url_parts) < 2 THEN 'invalid github url' WHEN NOT is_http AND len(id_parts) <> 2 THEN 'invalid repository identifier' END AS error,
  CASE WHEN is_http THEN url_parts ELSE id_parts END AS parts FROM m),
o AS (SELECT *, CASE WHEN error IS NULL THEN parts[1] END AS owner,
  CASE WHEN error IS NULL THEN CASE WHEN ends_with(parts[2], '.git') THEN left(parts[2], length(parts[2]) - 4) ELSE parts[2] END END AS repo FROM e)
SELECT page_id, repo_url, owner, repo, CASE WHEN error IS NULL THEN owner || '/' || repo END AS repo_id, error,
  CASE WHEN regexp_extract(repo_url, {q(PAGE_RE)}, 1) <> '' THEN 'https://github.com/' || regexp_extract(repo_url, {q(PAGE_RE)}, 1) || '/' ||
    regexp_replace(regexp_extract(repo_url, {q(PAGE_RE)}, 2), '\\.git$', '') END AS page_repo_url FROM o"""
    ctx_prompt = template_sql(CONTEXT_TEMPLATE, {"tree": "t.tr", "signals": "s.sg", "excerpts": "x.ex"})
    CPC = graph_ctes() + pagerank_ctes() + ctxfiles_ctes() + [
        """tree250 AS (SELECT repo_id, string_agg(path, chr(10) ORDER BY tree_ord) AS tr FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tree_ord) AS r FROM tree) WHERE r <= 250 GROUP BY repo_id)""",
        f"""sigs AS (SELECT repo_id, string_agg('### ' || path || chr(10) || substring(coalesce(content, ''), 1, {K.SIGNAL_EXCERPT_CHARS}), chr(10) || chr(10) ORDER BY tree_ord) AS sg
  FROM tree WHERE is_signal GROUP BY repo_id)""",
        f"""exc AS (SELECT repo_id, string_agg('### ' || path || chr(10) || substring(content, 1, {K.EXCERPT_CHARS}), chr(10) || chr(10) ORDER BY ctx_rank) AS ex FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ctx_rank) AS r FROM ctxf WHERE {has_content()}) WHERE r <= {K.PROMPT_EXCERPTS} GROUP BY repo_id)""",
        f"""cprompt AS (SELECT r.repo_id, {ctx_prompt} AS prompt FROM (SELECT DISTINCT repo_id FROM files) r
  LEFT JOIN tree250 t ON t.repo_id = r.repo_id LEFT JOIN sigs s ON s.repo_id = r.repo_id LEFT JOIN exc x ON x.repo_id = r.repo_id)"""]
    RPT = report_ctes(K.API_TOKEN_BUDGET)
    ev_line = "kind || ' ' || CASE WHEN method IS NOT NULL THEN method || ' ' ELSE '' END || value || ' (' || file || ')'"
    kord = "CASE kind WHEN 'route' THEN 0 WHEN 'handler' THEN 1 ELSE 2 END * 1000 + ev_rank"
    arch_prompt = template_sql(ARCH_TEMPLATE, {
        "summary": "f.summary", "domain": "f.domain", "stack": "array_to_string(f.tech_stack, ', ')",
        "modules": "array_to_string(f.main_modules, ', ')", "file_list": "fl.fl", "files": "fb.fb", "evidence": "el.el"})
    APC = RPT + [
        "fl AS (SELECT repo_id, string_agg('- ' || path, chr(10) ORDER BY rank) AS fl FROM sel GROUP BY repo_id)",
        "fb AS (SELECT repo_id, string_agg('### ' || path || chr(10) || '```' || chr(10) || coalesce(content, '') || chr(10) || '```', chr(10) || chr(10) ORDER BY rank) AS fb FROM sel GROUP BY repo_id)",
        f"el AS (SELECT repo_id, string_agg({ev_line}, chr(10) ORDER BY {kord}) AS el FROM evc GROUP BY repo_id)",
        f"""aprompt AS (SELECT f.repo_id, {arch_prompt} AS prompt FROM fin f LEFT JOIN fl ON fl.repo_id = f.repo_id
  LEFT JOIN fb ON fb.repo_id = f.repo_id LEFT JOIN el ON el.repo_id = f.repo_id)"""]
    rep = RPT + evmap_ctes()[-1:] + [
        """stats AS (SELECT repo_id, count(*) AS total_files FROM tree GROUP BY repo_id)""",
        """estats AS (SELECT repo_id, count(*) AS graph_edges FROM edges GROUP BY repo_id)""",
        """sigl AS (SELECT repo_id, string_agg(path, '|' ORDER BY tree_ord) AS signal_files FROM tree WHERE is_signal GROUP BY repo_id)""",
        """cenl AS (SELECT repo_id, string_agg(path, '|' ORDER BY rank) AS top_central_files FROM central10 GROUP BY repo_id)""",
        """sell AS (SELECT repo_id, string_agg(path, '|' ORDER BY rank) AS selected_files, count(*) AS total_selected,
  CAST(sum(tokens) AS BIGINT) AS estimated_tokens FROM sel GROUP BY repo_id)""",
        f"""comp AS (SELECT repo_id, string_agg(folder || ': ' || CAST(n AS VARCHAR) || {q(K.COMPRESSED_FOLDER_TEXT)}, '|' ORDER BY first_ord) AS compressed_folders
  FROM (SELECT repo_id, regexp_extract(path, '^[^/]*') AS folder, count(*) AS n, min(tree_ord) AS first_ord FROM tree t
        WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.repo_id = t.repo_id AND s.path = t.path) GROUP BY ALL) GROUP BY repo_id)"""]
    rep_sql = f"""SELECT f.repo_id, f.summary AS repo_summary, array_to_string(f.tech_stack, '|') AS tech_stack,
  array_to_string(f.main_modules, '|') AS main_modules, array_to_string(f.entry_points, '|') AS entry_points,
  array_to_string(f.keywords, '|') AS keywords, coalesce(a.narrative_summary, '') AS narrative_summary,
  coalesce(a.architecture_mermaid, {q(K.UNPARSEABLE_ARCHITECTURE).replace(chr(10), "' || chr(10) || '")}) AS architecture_mermaid,
  coalesce(array_to_string(a.flow_mermaid, '|'), '') AS flow_mermaid, a.evidence_entries,
  CAST(coalesce(st.total_files, 0) AS BIGINT) AS total_files, coalesce(sg.signal_files, '') AS signal_files,
  CAST(coalesce(st.total_files, 0) AS BIGINT) AS graph_nodes, CAST(coalesce(es.graph_edges, 0) AS BIGINT) AS graph_edges,
  coalesce(pc.ok, true) AS graph_converged, coalesce(ce.top_central_files, '') AS top_central_files, f.domain, coalesce(sl.selected_files, '') AS selected_files,
  CAST(coalesce(sl.total_selected, 0) AS BIGINT) AS total_selected, CAST(coalesce(sl.estimated_tokens, 0) AS BIGINT) AS estimated_tokens,
  coalesce(cp.compressed_folders, '') AS compressed_folders, split_part(f.repo_id, '/', 1) AS repo_owner,
  regexp_extract(f.repo_id, '[^/]*$') AS repo_name, coalesce(nullif(r.default_branch, ''), 'main') AS default_branch,
  coalesce(CASE WHEN coalesce(a.narrative_summary, '') <> '' THEN a.narrative_summary END, f.summary) AS headline
FROM fin f LEFT JOIN (SELECT repo_id, bool_and(converged) AS ok FROM pagerank GROUP BY repo_id) pc ON pc.repo_id = f.repo_id
LEFT JOIN stats st ON st.repo_id = f.repo_id LEFT JOIN estats es ON es.repo_id = f.repo_id
LEFT JOIN sigl sg ON sg.repo_id = f.repo_id LEFT JOIN cenl ce ON ce.repo_id = f.repo_id LEFT JOIN sell sl ON sl.repo_id = f.repo_id
LEFT JOIN comp cp ON cp.repo_id = f.repo_id LEFT JOIN arch a ON a.repo_id = f.repo_id LEFT JOIN repos r ON r.repo_id = f.repo_id"""
    return {
        "repo_id_normalise": norm,
        "scan_tree_listing": with_([FILES, tree_listing_cte()], "SELECT repo_id, path, tree_ord, CAST(coalesce(size, 0) AS BIGINT) AS size_bytes FROM tl WHERE type = 'blob'"),
        "decode_content": with_([FILES, tree_listing_cte()], """SELECT t.repo_id, t.path, CAST(length(d.c) AS BIGINT) AS chars, md5(d.c) AS content_md5, d.c = f.content AS roundtrip_ok
FROM tl t JOIN files f ON f.repo_id = t.repo_id AND f.path = t.path,
LATERAL (SELECT CASE WHEN t.encoding = 'base64' THEN CASE WHEN t.content_b64 = '!' THEN '' ELSE decode(from_base64(nullif(t.content_b64, '!'))) END ELSE '' END AS c) d"""),
        "parse_architecture": with_([RESPONSES] + arch_ctes(), """SELECT repo_id, response_id, parse_ok, narrative_summary, architecture_mermaid,
  array_to_string(flow_mermaid, '|') AS flow_mermaid, evidence_entries FROM arch"""),
        "normalise_flow": with_([RESPONSES] + arch_ctes(), """SELECT repo_id, response_id, CAST(len(flow_mermaid) AS INTEGER) AS n_flows,
  array_to_string(flow_mermaid, '|') AS flow_mermaid FROM arch WHERE parse_ok"""),
        "context_prompt": with_(CPC, "SELECT repo_id, CAST(length(prompt) AS BIGINT) AS chars, md5(prompt) AS prompt_md5, prompt FROM cprompt"),
        "context_prompt_parts": with_(CPC, """SELECT repo_id, CAST(2 + coalesce(n, 0) AS BIGINT) AS n_parts, CAST(length(prompt) AS BIGINT) AS chars FROM cprompt
  LEFT JOIN (SELECT repo_id, count(DISTINCT tree_ord // 256) AS n FROM tree WHERE is_signal GROUP BY repo_id) USING (repo_id)"""),
        "architecture_prompt": with_(APC, "SELECT repo_id, CAST(length(prompt) AS BIGINT) AS chars, md5(prompt) AS prompt_md5, prompt FROM aprompt"),
        "repo_report": with_(rep, rep_sql),
        "repo_report_stored": with_(rep, rep_sql),
        "repo_report_lists": with_(RPT, f"""SELECT repo_id, 'signal_files' AS list, tree_ord AS ord, path AS value FROM tree WHERE is_signal
UNION ALL SELECT repo_id, 'compressed_folders', min(tree_ord), regexp_extract(path, '^[^/]*') || ': ' || CAST(count(*) AS VARCHAR) || {q(K.COMPRESSED_FOLDER_TEXT)}
FROM tree t WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.repo_id = t.repo_id AND s.path = t.path) GROUP BY repo_id, regexp_extract(path, '^[^/]*')"""),
    }


def oracle() -> dict[str, str]:
    out = {}
    out.update(_ingestion_queries())
    out.update(_retrieval_queries())
    out.update(_evidence_queries())
    out.update(_context_queries())
    out.update(_final_queries())
    return out

"""DuckDB SQL of the operator queries that SQL can express over whole tables."""
from __future__ import annotations

from codemap.llm import licences
from codemap.llm.licence_texts import NOTICES, TEXTS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    """Canonical forms with string functions and unnested lines instead of arrays; the known texts stand in the statement."""
    def words(text: str) -> str:
        return f"trim(regexp_replace({text}, '{licences.NOT_WORD}', ' ', 'g'))"

    def spelled(text: str) -> str:
        for old, new in licences.SPELLINGS:
            text = f"replace({text}, '{old}', '{new}')"
        return text

    def forms(texts: dict) -> str:
        return ", ".join(f"({_quoted(name)}, {_quoted(f)})" for name, fs in texts.items() for f in fs)

    left = f"CASE WHEN l NOT LIKE '%licen%' AND regexp_matches(l, '{licences.COPYRIGHT_LINE}') THEN '' ELSE {words(f"regexp_replace(l, '{licences.COPYRIGHT_HEAD}', '')")} END"
    bare = f"trim(regexp_replace(regexp_replace(w, '{licences.COPYRIGHT_WORDS}', ' ', 'g'), ' +', ' ', 'g'))"
    return f"""
WITH given(kind, licence_id, t) AS (
  SELECT 'whole', * FROM (VALUES {forms(TEXTS)}) UNION ALL SELECT 'notice', * FROM (VALUES {forms(NOTICES)})),
src AS (SELECT row_number() OVER () AS r, 'doc' AS kind, doc_id, NULL AS licence_id, lower(coalesce(text, '')) AS t FROM documents
        UNION ALL SELECT -row_number() OVER (), kind, NULL, licence_id, lower(t) FROM given),
cut AS (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM src),
lines AS (SELECT r, i, {words("l")} AS w, {left} AS c FROM cut),
joined AS (SELECT src.r, any_value(kind) AS kind, any_value(doc_id) AS doc_id, any_value(licence_id) AS licence_id,
                  coalesce(string_agg(c, ' ' ORDER BY i) FILTER (c <> ''), '') AS c, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (w <> ''), '') AS w
           FROM src LEFT JOIN lines USING (r) GROUP BY src.r),
whole AS (SELECT r, kind, doc_id, licence_id, md5({spelled("c")}) AS digest, md5({spelled(bare)}) AS bare FROM joined),
known AS (SELECT kind, digest, min(licence_id) AS licence_id FROM whole WHERE kind <> 'doc' GROUP BY kind, digest),
worded AS (SELECT bare, min(licence_id) AS licence_id FROM whole WHERE kind = 'whole' GROUP BY bare),
hits AS (SELECT r, string_agg(DISTINCT licence_id, ',' ORDER BY licence_id) AS notices
         FROM lines JOIN known ON known.kind = 'notice' AND known.digest = md5({spelled("c")}) WHERE c <> '' GROUP BY r)
SELECT w.doc_id::BIGINT AS doc_id, w.digest, coalesce(k.licence_id, b.licence_id) AS licence_id, coalesce(notices, '') AS notices
FROM whole w LEFT JOIN known k ON k.kind = 'whole' AND k.digest = w.digest LEFT JOIN worded b ON b.bare = w.bare LEFT JOIN hits USING (r) WHERE w.kind = 'doc'
"""


OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tok AS (SELECT r, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, len(ws) AS n FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
total AS (SELECT count(*) AS t FROM tok),
c1 AS (SELECT w, count(*) AS c FROM tok GROUP BY w), o1 AS (SELECT r, w, count(*) AS c FROM tok GROUP BY r, w),
c2 AS (SELECT v, w, count(*) AS c FROM tok WHERE v IS NOT NULL GROUP BY v, w), o2 AS (SELECT r, v, w, count(*) AS c FROM tok WHERE v IS NOT NULL GROUP BY r, v, w),
j AS (SELECT tok.r, tok.v, tok.n, c1.c - o1.c AS uni, coalesce(c2.c - o2.c, 0) AS bi, cv.c - ov.c AS ctx
      FROM tok JOIN c1 USING (w) JOIN o1 ON o1.r = tok.r AND o1.w = tok.w
      LEFT JOIN c2 ON c2.v = tok.v AND c2.w = tok.w LEFT JOIN o2 ON o2.r = tok.r AND o2.v = tok.v AND o2.w = tok.w
      LEFT JOIN c1 cv ON cv.w = tok.v LEFT JOIN o1 ov ON ov.r = tok.r AND ov.w = tok.v),
s AS (SELECT r, sum(CASE WHEN bi > 0 THEN ln(bi / ctx)
                         ELSE CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END
                              + CASE WHEN uni > 0 THEN ln(uni / (t - n)) ELSE ln(0.4) - ln(greatest(t - n, 1)) END END) AS x FROM j, total GROUP BY r)
SELECT doc_id::BIGINT AS doc_id, len(ws)::BIGINT AS n_words, round(coalesce(x, 0), 6)::DOUBLE AS log_score,
       CASE WHEN len(ws) > 0 THEN round(x / len(ws), 6)::DOUBLE END AS mean_log_score
FROM d LEFT JOIN s USING (r)
"""

OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT r, i, list_aggregate(ws[i:i+2], 'string_agg', ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE n > 1) GROUP BY r),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_alpha_words,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN cov USING (r)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines >= 3 AND 3 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_alpha_words < 80 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 64 ELSE 0 END
    + CASE WHEN n_lines >= 3 AND 10 * n_bullet_lines > 9 * n_lines THEN 128 ELSE 0 END
    + CASE WHEN n_lines >= 3 AND 10 * n_ellipsis_lines > 3 * n_lines THEN 256 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM f
"""

OP10 = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
bw AS (SELECT row_number() OVER () AS b, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM benchmark),
bs AS (SELECT DISTINCT b, item_id, least(5, len(ws)) AS n, unnest(CASE WHEN len(ws) <= 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i+4], 'string_agg', ' ')) END) AS s FROM bw WHERE len(ws) > 0),
size AS (SELECT b, count(*) AS q FROM bs GROUP BY b),
ds AS (SELECT DISTINCT r, doc_id, k.n, list_aggregate(ws[i:i+k.n-1], 'string_agg', ' ') AS s
       FROM (SELECT DISTINCT n FROM bs) k, (SELECT r, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM dw WHERE len(ws) > 0) d WHERE i + k.n - 1 <= len(ws)),
hit AS (SELECT r, doc_id, b, item_id, count(*) AS found FROM ds JOIN bs USING (n, s) GROUP BY r, doc_id, b, item_id)
SELECT doc_id::BIGINT AS doc_id, item_id::BIGINT AS item_id, q::BIGINT AS n_shingles, found::BIGINT AS n_found, found / q AS containment
FROM hit JOIN size USING (b) WHERE 5 * found >= 4 * q
"""

OP13 = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score,
             row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id ASC NULLS LAST, c.r) AS rank
      FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM s WHERE rank <= 20
"""

SQL: dict[str, str] = {"op2_lm_score": OP2, "op3_licences": _licence_sql(), "op9_quality": OP9, "op10_decontamination": OP10, "op13_topk": OP13}

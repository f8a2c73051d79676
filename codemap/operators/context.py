"""Repository context: model-reply parsing, context files, entry points, keywords, modules.

Model replies arrive as a table; parsing is VARIANT-based (``try_parse_json`` +
``schema_of_variant`` type tests), so a bad reply is a row with ``parse_ok = false``
rather than a failed job. Scores are sums of Column conditions; every per-repository
list is an ordered ``collect_list`` over a bounded top-k.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as P
from ..functions import regex as R
from ..session import stage
from .sorted_lookup import endings

WS_EDGES = "^" + R.PY_WHITESPACE + "|" + R.PY_WHITESPACE + "$"


def py_strip(c: Column) -> Column:
    """Python str.strip(): drop leading/trailing (Unicode) whitespace."""
    return F.regexp_replace(c, WS_EDGES, "")


def clean_llm_json(raw: Column) -> Column:
    """Strip; when the text starts with a fence, remove every fence (with or without json tag)."""
    t = py_strip(raw)
    return F.when(t.startswith("```"),
                  py_strip(F.replace(F.replace(t, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))).otherwise(t)


def _typ(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def _str_field(v: Column, field: str) -> Column:
    return F.when(_typ(v, field) == "STRING", F.variant_get(v, f"$.{field}", "string")).otherwise(F.lit(""))


def allow_duplicate_keys(spark) -> None:
    """Of equal keys in a JSON object the last value counts, as JSON readers have it."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _list_field(v: Column, field: str) -> Column:
    """The strings of a JSON list; its other elements are left out."""
    empty = F.array().cast("array<string>")
    items = F.coalesce(F.try_variant_get(v, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))
    strings = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
    return F.when(_typ(v, field).startswith("ARRAY"), strings).otherwise(empty)


def parse_context(responses: DataFrame) -> DataFrame:
    """responses(repo_id, response_id, raw) -> one typed row per reply:
    (repo_id, response_id, parse_ok, summary, domain, tech_stack, main_modules, entry_points, keywords)."""
    allow_duplicate_keys(responses.sparkSession)
    v = F.try_parse_json(clean_llm_json(F.col("raw")))
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return (responses.select("repo_id", "response_id", v.alias("v"), ok.alias("parse_ok"))
            .select("repo_id", "response_id", "parse_ok",
                    _str_field(F.col("v"), "summary").alias("summary"),
                    _str_field(F.col("v"), "domain").alias("domain"),
                    _list_field(F.col("v"), "tech_stack").alias("tech_stack"),
                    _list_field(F.col("v"), "main_modules").alias("main_modules"),
                    _list_field(F.col("v"), "entry_points").alias("entry_points"),
                    _list_field(F.col("v"), "keywords").alias("keywords")))


def pick_context(parsed: DataFrame) -> DataFrame:
    """One reply per repository: the smallest response_id that parses."""
    ok = parsed.where(F.col("parse_ok"))
    first = ok.groupBy("repo_id").agg(F.min("response_id").alias("response_id"))
    return ok.join(first, ["repo_id", "response_id"])


# ---------------------------------------------------------------------------
# path / content scores
# ---------------------------------------------------------------------------
def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def terms_in(terms: list[str], *texts: Column) -> Column:
    """The terms that one of the texts contains, as an array in the terms' order.

    A loop over an array of constants: its generated code does not grow with the number of terms, and a text is looked at where it lies
    instead of being copied to a row for each term. (A single scan with one alternation for all terms took half as long again.)
    The texts are bound by an outer loop of one turn, so what makes them (a lowered text) is worked out once and not for each term.
    """
    bound = F.array(F.struct(*[x.alias(f"x{i}") for i, x in enumerate(texts)]))
    found = lambda s: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: P.any_of([s[f"x{i}"].contains(t) for i in range(len(texts))]))
    return F.transform(bound, found)[0]


def context_score(path) -> Column:
    """-100 for noise; +2 per hint in the lower-cased path; +4 entry name; +6 core name; +1 __init__.py."""
    low = F.lower(F.col(path) if isinstance(path, str) else path)
    fn = F.substring_index(low, "/", -1)
    s = _sum([F.when(low.contains(h), F.lit(2)).otherwise(F.lit(0)) for h in K.IMPORTANT_HINTS]
             + [F.when(fn.isin(K.ENTRY_FILE_NAMES), F.lit(4)).otherwise(F.lit(0)),
                F.when(fn.isin(K.FRAMEWORK_CORE_NAMES), F.lit(6)).otherwise(F.lit(0)),
                F.when(fn == "__init__.py", F.lit(1)).otherwise(F.lit(0))])
    return F.when(P.is_noise(path), F.lit(-100)).otherwise(s).cast("int")


def entry_score(path, content) -> Column:
    """-100 for noise or a non-code suffix; +8 entry name; +6 core name; +3 name token; -3 __init__.py;
    +6 per startup signal found in the lower-cased content."""
    p = F.col(path) if isinstance(path, str) else path
    low = F.lower(p)
    fn = F.substring_index(low, "/", -1)
    text = F.lower(F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit("")))
    s = _sum([F.when(fn.isin(K.ENTRY_FILE_NAMES), F.lit(8)).otherwise(F.lit(0)),
              F.when(fn.isin(K.FRAMEWORK_CORE_NAMES), F.lit(6)).otherwise(F.lit(0)),
              F.when(P.any_of([fn.contains(t) for t in K.ENTRY_NAME_TOKENS]), F.lit(3)).otherwise(F.lit(0)),
              F.when(fn == "__init__.py", F.lit(-3)).otherwise(F.lit(0)),
              F.lit(6) * F.size(terms_in(K.STARTUP_SIGNALS, text))])
    bad = P.is_noise(p) | ~P.ends_with_any(low, K.VALID_EXTENSIONS)
    return F.when(bad, F.lit(-100)).otherwise(s).cast("int")


def entry_valid(path, content) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    low = F.lower(p)
    fn = F.substring_index(low, "/", -1)
    base = ~P.is_noise(p) & ~P.ends_with_any(low, K.DOC_CONFIG_SUFFIXES) & P.ends_with_any(low, K.VALID_EXTENSIONS)
    return base & (F.when(fn == "__init__.py", entry_score(p, content) >= 6).otherwise(F.lit(True)))


def content_or_empty(c: str = "content") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


# ---------------------------------------------------------------------------
# context files, entry points, keywords, modules
# ---------------------------------------------------------------------------
def context_files(tree: DataFrame, central30: DataFrame, top_n: int = K.CONTEXT_FILES_TOP_N) -> DataFrame:
    """(top-30 central) ∪ (non-noise files with context score >= 3), best ``top_n`` by score (ties: path).
    -> (repo_id, ctx_rank, path, score, content)."""
    by_score = tree.where(~P.is_noise("path") & (context_score("path") >= 3)).select("repo_id", "path")
    cands = central30.select("repo_id", "path").unionByName(by_score).distinct()
    scored = (cands.join(tree.select("repo_id", "path", "content"), ["repo_id", "path"])
              .withColumn("score", context_score("path")))
    w = Window.partitionBy("repo_id").orderBy(F.col("score").desc(), F.col("path"))
    return (scored.withColumn("ctx_rank", F.row_number().over(w)).where(F.col("ctx_rank") <= F.lit(top_n))
            .select("repo_id", F.col("ctx_rank").cast("int").alias("ctx_rank"), "path", "score", "content"))


def normalise_entry_points(raw: DataFrame, tree: DataFrame) -> DataFrame:
    """raw(repo_id, ep_ord, raw) -> (repo_id, ep_ord, raw, path): repair cascade
    exact -> 'src/'+p -> unique path ending with p -> unique file name; else null.

    Three steps are equi-joins. The suffix step is not segment-aligned: it looks candidates up in the sorted order of the
    reversed paths, in which every path stands once (``sorted_lookup.endings``).
    """
    cand = (raw.select("repo_id", "ep_ord", "raw",
                       F.regexp_replace(py_strip(F.col("raw")), r"^[./]+", "").alias("cand"))
            .where(F.col("cand") != ""))
    paths = tree.select("repo_id", "path")
    exact = (cand.join(paths.withColumnRenamed("path", "cand"), ["repo_id", "cand"], "left_semi")
             .select("repo_id", "ep_ord", F.col("cand").alias("p1")))
    src = (cand.withColumn("sc", F.concat(F.lit("src/"), "cand"))
           .join(paths.withColumnRenamed("path", "sc"), ["repo_id", "sc"], "left_semi")
           .select("repo_id", "ep_ord", F.col("sc").alias("p2")))
    sfx = (endings(paths.withColumnRenamed("path", "text"), cand.select("repo_id", F.col("cand").alias("suffix")).distinct())
           .select("repo_id", F.col("suffix").alias("cand"), F.col("n").alias("n3"), F.col("first").alias("p3")))
    by_name = (paths.groupBy("repo_id", P.filename("path").alias("fname"))
               .agg(F.count(F.lit(1)).alias("n4"), F.min("path").alias("p4")))
    j = (cand.join(exact, ["repo_id", "ep_ord"], "left").join(src, ["repo_id", "ep_ord"], "left")
         .join(sfx, ["repo_id", "cand"], "left")
         .withColumn("fname", P.filename("cand"))
         .join(by_name, ["repo_id", "fname"], "left"))
    resolved = F.coalesce(F.col("p1"), F.col("p2"), F.when(F.col("n3") == 1, F.col("p3")),
                          F.when(F.col("n4") == 1, F.col("p4")))
    return (raw.select("repo_id", "ep_ord", "raw")
            .join(j.select("repo_id", "ep_ord", resolved.alias("path")), ["repo_id", "ep_ord"], "left"))


def _ordered_dedupe(df: DataFrame, key_cols: list[str], value: str, order: str) -> DataFrame:
    """First occurrence (by ``order``) of each value per key."""
    return df.groupBy(*key_cols, value).agg(F.min(order).alias(order))


def llm_entry_points(raw: DataFrame, tree: DataFrame) -> DataFrame:
    """Entry points named by the model: repaired, deduplicated, valid, score >= 4.
    -> (repo_id, path, score)."""
    norm = normalise_entry_points(raw, tree).where(F.col("path").isNotNull())
    uniq = _ordered_dedupe(norm, ["repo_id"], "path", "ep_ord")
    t = tree.select("repo_id", "path", "content")
    s = (uniq.join(t, ["repo_id", "path"], "left")
         .select("repo_id", "path", entry_valid("path", content_or_empty()).alias("ok"),
                 entry_score("path", content_or_empty()).alias("score")))
    return s.where(F.col("ok") & (F.col("score") >= 4)).select("repo_id", "path", "score")


def _valid_scores(files: DataFrame, least: int, tier: int) -> DataFrame:
    """(repo_id, path, score, tier) of the valid files that have at least a score; the score goes through a generator, so a text is looked through once for it."""
    scored = (files.select("repo_id", "path", content_or_empty().alias("c")).where(entry_valid("path", F.col("c")))
              .select("repo_id", "path", F.inline(F.array(F.struct(entry_score("path", F.col("c")).alias("score"))))))
    return scored.where(F.col("score") >= least).select("repo_id", "path", "score", F.lit(tier).alias("tier"))


def fallback_entry_points(ctx_files: DataFrame, tree: DataFrame) -> DataFrame:
    """Tier 1: context files with score >= 4; if a repository has none, tier 2: all files with
    score >= 5. -> (repo_id, path, score, tier)."""
    both = stage(_valid_scores(ctx_files, 4, 1).unionByName(_valid_scores(tree, 5, 2)), "fallback_entry_points")
    best_tier = both.groupBy("repo_id").agg(F.min("tier").alias("tier"))
    return both.join(best_tier, ["repo_id", "tier"])


def top_entry_points(scored: DataFrame, k: int = K.MAX_ENTRY_POINTS) -> DataFrame:
    """Sort (score, path) both descending, keep k. -> (repo_id, ep_rank, path, score)."""
    w = Window.partitionBy("repo_id").orderBy(F.col("score").desc(), F.col("path").desc())
    return (scored.withColumn("ep_rank", F.row_number().over(w)).where(F.col("ep_rank") <= F.lit(k))
            .select("repo_id", F.col("ep_rank").cast("int").alias("ep_rank"), "path", "score"))


def fallback_keywords(ctx_files: DataFrame, repos: DataFrame) -> DataFrame:
    """Which fixed terms occur in the context files' contents or paths, in term
    order; none -> the six defaults; at most 12. -> (repo_id, kw_ord, keyword)."""
    order = F.array(*[F.lit(t) for t in K.KEYWORD_TERMS])
    hits = (ctx_files.select("repo_id", F.explode(terms_in(K.KEYWORD_TERMS, F.lower(content_or_empty()), F.lower("path"))).alias("keyword")).distinct()
            .select("repo_id", (F.array_position(order, F.col("keyword")) - 1).cast("int").alias("kw_ord"), "keyword"))
    defaults = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(K.DEFAULT_KEYWORDS)])
    missing = (repos.select("repo_id").join(hits.select("repo_id").distinct(), "repo_id", "left_anti")
               .select("repo_id", F.explode(defaults).alias("term"))
               .select("repo_id", F.col("term.i").alias("kw_ord"), F.col("term.t").alias("keyword")))
    w = Window.partitionBy("repo_id").orderBy("kw_ord")
    return (hits.unionByName(missing).withColumn("r", F.row_number().over(w))
            .where(F.col("r") <= F.lit(K.MAX_KEYWORDS))
            .select("repo_id", F.col("kw_ord").cast("int").alias("kw_ord"), "keyword"))


def clean_modules(mods: Column) -> Column:
    """Strings trimmed, non-empty, no '/', not ending in a code extension; ordered dedupe; first 8."""
    t = F.transform(mods, lambda m: py_strip(m))
    keep = F.filter(t, lambda m: m.isNotNull() & (m != "") & ~m.contains("/")
                    & ~P.ends_with_any(m, K.VALID_EXTENSIONS))
    return F.slice(F.array_distinct(keep), 1, K.MAX_MODULES)


def finalise_context(ctx: DataFrame, repos: DataFrame, tree: DataFrame, ctx_files: DataFrame) -> DataFrame:
    """Per repository: summary, domain, tech_stack, main_modules, entry_points (<=5), keywords (<=12).

    ctx = pick_context(parse_context(responses)); repositories without a parsed reply get an
    empty context and all fallbacks.
    """
    base = repos.select("repo_id").join(ctx, "repo_id", "left")
    empty = F.array().cast("array<string>")
    mods = clean_modules(F.coalesce(F.col("main_modules"), empty))
    mods = F.when(F.size(mods) == 0, F.array(*[F.lit(m) for m in K.DEFAULT_MODULES])).otherwise(mods)
    raw_eps = base.select("repo_id", F.posexplode(F.coalesce(F.col("entry_points"), empty)).alias("ep_ord", "raw"))
    llm = stage(llm_entry_points(raw_eps, tree), "llm_entry_points").withColumn("tier", F.lit(0))
    have_llm = llm.select("repo_id").distinct()
    fb = fallback_entry_points(ctx_files, tree).join(have_llm, "repo_id", "left_anti")
    eps = top_entry_points(llm.unionByName(fb.select("repo_id", "path", "score", "tier")).drop("tier"))
    eps_list = (eps.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("ep_rank", "path"))).alias("a"))
                .select("repo_id", F.transform("a", lambda x: x["path"]).alias("entry_points")))
    kw_given = F.slice(F.array_distinct(F.coalesce(F.col("keywords"), empty)), 1, K.MAX_KEYWORDS)
    fbk = fallback_keywords(ctx_files, repos)
    fbk_list = (fbk.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("kw_ord", "keyword"))).alias("a"))
                .select("repo_id", F.transform("a", lambda x: x["keyword"]).alias("fb_keywords")))
    out = (base.select("repo_id", F.coalesce("summary", F.lit("")).alias("summary"),
                       F.coalesce("domain", F.lit("")).alias("domain"),
                       F.array_distinct(F.coalesce(F.col("tech_stack"), empty)).alias("tech_stack"),
                       F.array_distinct(mods).alias("main_modules"), kw_given.alias("kw_given"))
           .join(eps_list, "repo_id", "left").join(fbk_list, "repo_id", "left"))
    return out.select("repo_id", "summary", "domain", "tech_stack", "main_modules",
                      F.coalesce(F.col("entry_points"), empty).alias("entry_points"),
                      F.when(F.size("kw_given") > 0, F.col("kw_given"))
                      .otherwise(F.coalesce(F.col("fb_keywords"), empty)).alias("keywords"))

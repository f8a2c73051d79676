"""Import extraction as a distributed regex job (Python and JavaScript files).

One row per import occurrence: ``imports(repo_id, src, module)``. Only files with
content and extension ``.py`` / ``.js`` / ``.jsx`` are parsed. The extraction is
JVM regex + ``explode``; no Python worker is involved.

Python rules: ``import a, b.c`` yields each item that is not aliased; ``from m import
...`` yields ``m``; a relative ``from .x import y, z`` yields the first non-aliased
imported name (``y``); ``from . import *`` and ``from __future__ import ...`` yield
nothing. JavaScript rules: ``import ... from 'x'``, ``import 'x'`` and every string argument of ``require('x')``
yield ``x``, also within a template's ``${...}``; ``export ... from``, dynamic ``import()`` and template strings do not.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import js_lexer as JS
from ..functions import regex as R
from .ingest import has_content


def _items(lst):
    """The names of an import list that are plain dotted names (aliased ones are not)."""
    items = F.split(F.regexp_replace(lst, F.lit(R.PY_LIST_NOISE), F.lit("")), ",")
    items = F.transform(items, lambda x: F.regexp_replace(x, F.lit(R.EDGE_SPACE), F.lit("")))
    return F.filter(items, lambda x: x.rlike(R.DOTTED_FULL))


def _python_statement(s):
    """The modules of one import statement."""
    dots, module, names = (F.regexp_extract(s, R.PY_FROM_PARTS, i) for i in (1, 2, 3))
    first = F.try_element_at(_items(names), F.lit(1))
    from_ = F.when(dots == "", F.when(module != "__future__", module)).otherwise(first)
    return (F.when(s.rlike(R.PY_IS_FROM), F.filter(F.array(from_), lambda m: m.isNotNull() & (m != "")))
            .otherwise(_items(F.regexp_extract(s, R.PY_IMPORT_LIST, 1))))


def python_imports(tree: DataFrame) -> DataFrame:
    """tree -> (repo_id, src, module) for .py files, in one pass over the contents."""
    lines = F.when(F.col("content").contains("\r"), F.regexp_replace("content", F.lit(R.LINE_END), F.lit("\n"))).otherwise(F.col("content"))
    code = F.replace(F.regexp_replace(lines, F.lit(R.PY_STRING_OR_COMMENT), F.lit("")), F.lit(R.CONTINUATION), F.lit(" "))
    statements = F.regexp_extract_all(code, F.lit(R.PY_STATEMENT), F.lit(0))
    return (tree.where((F.col("extension") == ".py") & has_content())
            .select("repo_id", F.col("path").alias("src"), F.explode(statements).alias("s"))
            .select("repo_id", "src", F.explode(_python_statement(F.col("s"))).alias("module")))


def javascript_imports(tree: DataFrame) -> DataFrame:
    """tree -> (repo_id, src, module) for .js / .jsx files, in one pass over the contents that name an import at all.

    The beginning that holds all imports is looked through, or the whole text where that does not settle the last one (``js_lexer``). What each step
    makes goes through a generator, so that the next one sees an attribute and not the expression that makes it.
    """
    files = tree.where(F.col("extension").isin(".js", ".jsx") & has_content() & (F.col("content").contains("import") | F.col("content").contains("require")))
    named = files.select("repo_id", F.col("path").alias("src"), F.inline(F.array(F.struct("content", JS.beginning("content").alias("beginning"))))).where("beginning <> ''")
    cut = named.select("repo_id", "src", F.inline(F.array(F.struct("content", JS.lexemes(F.col("beginning")).alias("lexemes")))))
    first = cut.select("repo_id", "src", F.inline(F.array(F.struct("content", JS.settled_modules("lexemes").alias("modules")))))
    rest = F.when(F.col("modules").isNull(), JS.lexemes(F.col("content"))).otherwise(F.array().cast("array<struct<k:string,t:string>>"))
    full = first.select("repo_id", "src", F.inline(F.array(F.struct("modules", rest.alias("lexemes")))))
    return full.select("repo_id", "src", F.explode(F.coalesce("modules", JS.modules("lexemes"))).alias("module"))


def extract_imports(tree: DataFrame) -> DataFrame:
    """All import occurrences of parsed files: (repo_id, src, module)."""
    return python_imports(tree).unionByName(javascript_imports(tree))


def import_counts(imports: DataFrame) -> DataFrame:
    """(repo_id, src, module, n): occurrences per file and module (pre-aggregated before any join)."""
    return imports.groupBy("repo_id", "src", "module").agg(F.count(F.lit(1)).alias("n"))

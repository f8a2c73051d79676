"""Architecture replies (a table of model outputs) -> typed report fields.

Parse the raw text; if that fails, take the text after the first ```json fence and before
the last ``` fence, strip, parse again; if that fails too (or the reply is not a JSON
object) use the default object with an error diagram. Flow diagrams are normalised to a
list: a list is kept, a non-blank string becomes [stripped], anything else [].
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .context import allow_duplicate_keys, py_strip

#: Entries of the evidence map pass through as given: the JSON text of each.
EVIDENCE_TYPE = "array<string>"


def _after_first(c: Column, sep: str) -> Column:
    pos = F.instr(c, sep)
    return F.when(pos > 0, c.substr(pos + F.lit(len(sep)), F.lit(1 << 30))).otherwise(c)


def _before_last(c: Column, sep: str) -> Column:
    # position of the last occurrence = length - position in the reversed text - len(sep) + 2
    rpos = F.instr(F.reverse(c), sep[::-1])
    last = F.length(c) - rpos - F.lit(len(sep)) + 2
    return F.when(rpos > 0, c.substr(F.lit(1), last - 1)).otherwise(c)


def fence_cleaned(raw: Column) -> Column:
    return py_strip(_before_last(_after_first(raw, "```json"), "```"))


def _obj(v: Column) -> Column:
    return F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), v)


def _field_text(v: Column, field: str) -> Column:
    """String value as-is, JSON null -> null, missing -> '', other types -> JSON text."""
    fv = F.try_variant_get(v, f"$.{field}", "variant")
    t = F.schema_of_variant(fv)
    return (F.when(fv.isNull(), F.lit(""))
            .when(t == "STRING", F.try_variant_get(v, f"$.{field}", "string"))
            .when(t == "VOID", F.lit(None).cast("string"))
            .otherwise(F.to_json(fv)))


def normalise_flow(v: Column, field: str = "flow_mermaid") -> Column:
    fv = F.try_variant_get(v, f"$.{field}", "variant")
    t = F.schema_of_variant(fv)
    s = py_strip(F.coalesce(F.try_variant_get(v, f"$.{field}", "string"), F.lit("")))
    empty = F.array().cast("array<string>")
    return (F.when(t.startswith("ARRAY"), F.coalesce(F.try_variant_get(v, f"$.{field}", "array<string>"), empty))
            .when((t == "STRING") & (s != ""), F.array(s))
            .otherwise(empty))


def parse_architecture(replies: DataFrame) -> DataFrame:
    """replies(repo_id, response_id, raw) -> (repo_id, response_id, parse_ok, narrative_summary,
    architecture_mermaid, flow_mermaid array<string>, evidence_map array<JSON text of each entry>)."""
    allow_duplicate_keys(replies.sparkSession)
    first = _obj(F.try_parse_json(F.col("raw")))
    second = _obj(F.try_parse_json(fence_cleaned(F.col("raw"))))
    v = F.when(F.try_parse_json(F.col("raw")).isNotNull(), first).otherwise(second)
    p = replies.select("repo_id", "response_id", v.alias("v"))
    ev = F.transform(F.try_variant_get(F.col("v"), "$.evidence_map", "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))
    ok = F.col("v").isNotNull()
    return p.select(
        "repo_id", "response_id", ok.alias("parse_ok"),
        F.when(ok, _field_text(F.col("v"), "narrative_summary")).otherwise(F.lit("")).alias("narrative_summary"),
        F.when(ok, _field_text(F.col("v"), "architecture_mermaid"))
        .otherwise(F.lit(K.UNPARSEABLE_ARCHITECTURE)).alias("architecture_mermaid"),
        F.when(ok, normalise_flow(F.col("v"))).otherwise(F.array().cast("array<string>")).alias("flow_mermaid"),
        F.when(ok, F.coalesce(ev, F.array().cast(EVIDENCE_TYPE))).otherwise(F.array().cast(EVIDENCE_TYPE))
        .alias("evidence_map"))

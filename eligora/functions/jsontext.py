"""Model replies: JSON with prose around it, and evidence lists in any shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligora.functions.text import col

EVIDENCE_ITEM = ("struct<found:boolean,extracted_value:string,normalized_value:double,"
                 "source_text:string,source_document:string,notes:string>")


def _between(text: Column, opening: str, closing: str) -> Column:
    start = F.instr(text, opening)
    tail = F.instr(F.reverse(text), closing)
    end = F.length(text) - tail + 1
    return F.when((start > 0) & (tail > 0) & (end >= start),
                  F.substr(text, start, end - start + 1))


def json_body(reply: Column | str) -> Column:
    """The JSON part of a reply as a VARIANT: all of it, else the outermost
    ``{...}``, else the outermost ``[...]``; NULL when none parses."""
    text = col(reply)
    braces, brackets = _between(text, "{", "}"), _between(text, "[", "]")
    return F.coalesce(F.try_parse_json(text),
                      F.when(braces.isNotNull(), F.try_parse_json(braces))
                      .otherwise(F.try_parse_json(brackets)))


def evidence_items(reply: Column | str) -> Column:
    """Array of evidence structs from ``{"evidence": [...]}``, a single item in
    place of the list, or a bare list; items that are not objects, or are
    marked as not found, are left out."""
    body = json_body(reply)
    inner = F.coalesce(F.try_variant_get(body, "$.evidence", "variant"), F.when(
        F.schema_of_variant(body).startswith("ARRAY"), body))
    as_list = F.coalesce(F.try_variant_get(inner, "$", "array<variant>"),
                         F.when(F.schema_of_variant(inner).startswith("OBJECT"), F.array(inner)))
    objects = F.filter(as_list, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    found = F.filter(objects, lambda v: F.coalesce(F.try_variant_get(v, "$.found", "boolean"), F.lit(True)))

    def item(v: Column) -> Column:
        def text(name: str) -> Column:
            return F.try_variant_get(v, f"$.{name}", "string")
        return F.struct(
            F.lit(True).alias("found"),
            F.coalesce(text("extracted_value"), F.lit("")).alias("extracted_value"),
            F.try_variant_get(v, "$.normalized_value", "double").alias("normalized_value"),
            F.coalesce(text("source_text"), F.lit("")).alias("source_text"),
            text("source_document").alias("source_document"),
            F.coalesce(text("notes"), F.lit("")).alias("notes"))
    return F.coalesce(F.transform(found, item), F.array().cast(f"array<{EVIDENCE_ITEM}>"))

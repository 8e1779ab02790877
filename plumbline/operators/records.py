"""Flat fields of JSON records: scalars, lists, blocks that repeat, nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_field(record: Column, name: str, separator: str = ",") -> Column:
    """A field of a variant as text: a list joined by ``separator``, an object as JSON, null where it is missing."""
    value = F.try_variant_get(record, f"$.{name}", "variant")
    listed = F.transform(F.try_variant_get(value, "$", "array<string>"), lambda x: F.trim(x))
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY"), F.array_join(listed, separator)).when(kind.startswith("OBJECT"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))


def distinct_blocks(record: Column, name: str) -> Column:
    """The different objects of a field that holds a list of objects or an object of objects, as JSON texts in order.

    Objects that differ in the order of their keys only are the same.  Anything else gives an empty list.
    """
    value = F.try_variant_get(record, f"$.{name}", "variant")
    listed = F.try_variant_get(value, "$", "array<variant>")
    keyed = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    blocks = F.filter(F.coalesce(listed, keyed, F.array().cast("array<variant>")), lambda b: F.schema_of_variant(b).startswith("OBJECT"))
    return F.array_distinct(F.transform(blocks, lambda b: F.to_json(b)))


def first_and_last(blocks: Column, key: str) -> tuple[Column, Column]:
    """The blocks of least and of greatest ``key`` as text; a missing key comes first, and at a tie the one that stands first
    is the first and the one that stands last the last."""
    dated = F.transform(blocks, lambda b, i: F.named_struct(F.lit("at"), F.coalesce(F.get_json_object(b, f"$.{key}"), F.lit("")), F.lit("i"), i, F.lit("b"), b))
    ordered = F.array_sort(dated)
    return F.try_element_at(ordered, F.lit(1))["b"], F.try_element_at(ordered, F.lit(-1))["b"]


def joined_values(record: Column, name: str, separator: str = "; ") -> Column:
    """The values of a nested object, and of objects inside it, joined; null where there is none."""
    value = F.map_values(F.try_variant_get(record, f"$.{name}", "map<string,variant>"))
    inner = F.flatten(F.transform(value, lambda v: F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,string>")), F.array(F.try_variant_get(v, "$", "string")))))
    return F.nullif(F.array_join(F.filter(inner, lambda x: x.isNotNull() & (F.trim(x) != "")), separator), F.lit(""))


def flatten(rows: DataFrame, column: str, keep: list[str], scalars: list[str], blocks: dict[str, str], nested: list[str]) -> DataFrame:
    """``keep`` and flat columns of the JSON text in ``column``.

    scalars  fields as text; blocks  field -> key by which its first and last block are told: ``<field>_first``, ``<field>_last``,
    ``<field>_n`` (different blocks) and ``<field>_n_raw``; nested  fields whose values are joined.  A text that is no JSON
    object gives nulls and zeros.
    """
    parsed = rows.select(*keep, F.try_parse_json(column).alias("__v"))
    record = F.col("__v")
    out = [flat_field(record, f).alias(f) for f in scalars]
    for name, key in blocks.items():
        different = distinct_blocks(record, name)
        first, last = first_and_last(different, key)
        raw = F.size(F.coalesce(F.try_variant_get(record, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")))
        out += [first.alias(f"{name}_first"), last.alias(f"{name}_last"), F.size(different).alias(f"{name}_n"), raw.alias(f"{name}_n_raw")]
    out += [joined_values(record, f).alias(f) for f in nested]
    return parsed.select(*keep, *out)


def match_by_id_then_name(left: DataFrame, right: DataFrame, block: list[str], ident: str, name: str, keep: list[str]) -> DataFrame:
    """``left`` with ``matched_by`` (id, name or null) and the columns ``keep`` of its partner in ``right``, as ``right_<column>``.

    Within ``block``: rows with an identifier that ``right`` has go by it; the others by name, where a name stands for one row
    of ``right`` only.  ``right`` has one row per block and identifier (else the least counts).
    """
    partner = F.struct(*keep)
    by_id = right.where(F.col(ident).isNotNull()).groupBy(*block, F.col(ident).alias("__id")).agg(F.min(partner).alias("__i"))
    by_name = right.where(F.col(name).isNotNull()).groupBy(*block, F.col(name).alias("__name")).agg(F.count("*").alias("__n"), F.min(partner).alias("__m")).where("__n = 1").drop("__n")
    found = left.join(by_id, [*[left[b] == by_id[b] for b in block], left[ident] == by_id["__id"]], "left").select(left["*"], "__i")
    found = found.join(by_name, [*[found[b] == by_name[b] for b in block], found[name] == by_name["__name"]], "left").select(found["*"], "__m")
    best = F.coalesce("__i", "__m")
    kind = F.when(F.col("__i").isNotNull(), "id").when(F.col("__m").isNotNull(), "name")
    return found.select(*left.columns, kind.alias("matched_by"), *[best[c].alias(f"right_{c}") for c in keep])

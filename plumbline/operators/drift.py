"""Schemas that drift between files: tagged-union inference, one consistent table, a change report.

Every JSON value carries a tag (number, string, boolean, array, object).  The schema of a file is, per
canonical field and path below it, the union of the tags of its values, and the headers they stood under.  Comparing a
file's union with its predecessor's tells what was added, removed, renamed or retyped, and which alternative appeared at
which path; the union over all files gives the one table a typed branch per alternative and one canonical
conversion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import cell_parts, day_first_date, is_filler, unit_factor
from ..session import cut_lineage
from .ranks import same_keys

#: Which words of a header tell its field: the first rule that holds counts.  Each rule lists groups of
#: word beginnings, of which every group must be met.
FIELD_RULES = (
    ("evaluation_plan", (("evaluation",),)),
    ("benefits_baseline_gbp_m", (("benefit",),)),
    ("wlc_narrative", (("comment", "remark", "note", "narrative"), ("cost", "life", "lifetime", "wlc"))),
    ("wlc_baseline_gbp_m", (("wlc", "life", "lifetime", "full cost", "all years"),)),
    ("fy_forecast_gbp_m", (("forecast", "outturn", "expected spend"),)),
    ("end_date", (("finish", "end", "close", "completion"),)),
    ("start_date", (("start", "begun", "begin", "commence"),)),
    ("fy_baseline_gbp_m", (("plan", "planned", "budget", "baseline"), ("year", "spend"))),
    ("portfolio_id", (("identifier", "ref", "reference", "id"),)),
    ("dca_ipa", (("confidence", "rag", "rating", "dca"),)),
    ("department", (("department", "dept", "sponsor", "body", "ministry", "organisation"),)),
    ("description", (("aim", "about", "scope", "outline", "summary", "description", "purpose"),)),
    ("project_name", (("project", "scheme", "programme"),)),
)
MONEY_FIELDS = ("fy_baseline_gbp_m", "fy_forecast_gbp_m", "wlc_baseline_gbp_m", "benefits_baseline_gbp_m")


def header_stem(header: Column) -> Column:
    """A header without letter case, white space, punctuation, underscores, bracketed notes and financial year."""
    text = F.lower(F.regexp_replace(header, "_", " "))
    text = F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]", " ")
    text = F.regexp_replace(text, r"\b(fy\s*)?(\d{4}|\d{2})\s*[/\-–]\s*(\d{4}|\d{2})\b|\bfy\s*\d{2,4}\b|\b(19|20)\d{2}\b", " ")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def field_of(stem: Column) -> Column:
    """The canonical field that a header's stem stands for; null for columns that hold no project data."""
    out = F.lit(None).cast("string")
    for name, groups in reversed(FIELD_RULES):
        holds = F.lit(True)
        for words in groups:
            holds = holds & stem.rlike(r"\b(" + "|".join(words) + ")")
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def _tag(kind: Column) -> Column:
    """JSON type from a variant's schema; null for null."""
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.isin("VOID", "NULL"), None)
        .otherwise("number")
    )


def file_schemas(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """(publication_slug, field_name, stems, types): the tagged union of each file's fields that hold a value.

    Values are counted once per file, header and type before any shuffle, so a file with very many rows is no
    hot spot, and files that were delivered twice change nothing.  Records that are no JSON object
    (null, cut off, or with a key repeated) give nothing.
    """
    spark = rows.sparkSession
    seen = spark.sql(
        "select publication_slug, t.key as header, schema_of_variant(t.value) as kind "
        "from {rows}, lateral variant_explode(try_parse_json(record)) t where t.key is not null and publication_slug is not null",
        rows=rows.select("publication_slug", "record"),
    )
    seen = seen.select("publication_slug", "header", _tag(F.col("kind")).alias("type")).where("type is not null").distinct()
    published = (
        seen.withColumn("stem", header_stem(F.col("header")))
        .withColumn("field_name", field_of(F.col("stem")))
        .where("field_name is not null")
    )
    implied = F.trim("money_header_implies")
    fy = r"(?i)^(fy\s*)?(\d{4}|\d{2})\s*[/\-]\s*(\d{4}|\d{2})$"
    money = calendar.where(implied != "").select(
        "publication_slug",
        F.lit("money_header_implies").alias("field_name"),
        F.lit("").alias("stem"),
        F.when(implied.rlike(r"^\d{4,6}(\.0*)?$"), "serial").when(implied.rlike(fy), "financial year").otherwise("date").alias("type"),
    )
    return (
        published.select("publication_slug", "field_name", "stem", "type")
        .unionByName(money)
        .groupBy("publication_slug", "field_name")
        .agg(F.sort_array(F.collect_set("stem")).alias("stems"), F.sort_array(F.collect_set("type")).alias("types"))
    )


def file_pairs(calendar: DataFrame) -> DataFrame:
    """(publication_slug, before): each file and the one of its body with the next lower publication_year."""
    return (
        calendar.where("publishing_body is not null and publication_year is not null and publication_slug is not null")
        .select("publishing_body", "publication_year", "publication_slug")
        .distinct()
        .withColumn("before", F.lag("publication_slug").over(Window.partitionBy("publishing_body").orderBy("publication_year", "publication_slug")))
        .where("before is not null")
        .select("publication_slug", "before")
    )


def schema_changes(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """(publication_slug, field_name, change_kind) of each file against its body's file before it.

    The file before is the one of the next lower publication_year; a file without body or year, and a
    body's first file, have none.  Kinds: added, removed, renamed, type_changed.
    """
    schemas = file_schemas(rows, calendar)
    files = file_pairs(calendar)
    sides = files.select(
        "publication_slug",
        F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("publication_slug").alias("of")), F.struct(F.lit(0).alias("side"), F.col("before").alias("of")))).alias("s"),
    ).select("publication_slug", "s.side", "s.of")
    state = F.struct("stems", "types")
    both = (
        sides.join(schemas.withColumnRenamed("publication_slug", "of"), "of")
        .groupBy("publication_slug", "field_name")
        .agg(
            F.max_by(state, F.when(F.col("side") == 1, 1)).alias("new"),
            F.max_by(state, F.when(F.col("side") == 0, 1)).alias("old"),
        )
    )
    kinds = (
        F.when(F.col("old").isNull(), F.array(F.lit("added")))
        .when(F.col("new").isNull(), F.array(F.lit("removed")))
        .otherwise(
            F.array_compact(
                F.array(
                    F.when(F.col("new.stems") != F.col("old.stems"), "renamed"),
                    F.when(F.col("new.types") != F.col("old.types"), "type_changed"),
                )
            )
        )
    )
    return both.select("publication_slug", "field_name", F.explode(kinds).alias("change_kind"))


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header, type, body): every non-null value of every readable record, as JSON text with its tag."""
    spark = rows.sparkSession
    listed = ", ".join(keys)
    found = spark.sql(
        f"select {listed}, t.key as header, schema_of_variant(t.value) as kind, to_json(t.value) as body from {{rows}}, lateral variant_explode(try_parse_json(record)) t where t.key is not null",
        rows=rows.select(*keys, "record"),
    )
    return found.select(*keys, "header", _tag(F.col("kind")).alias("type"), "body").where("type is not null")


def _with_fields(cells: DataFrame) -> DataFrame:
    """Cells of project data with their field; the rules are applied to each distinct header once."""
    headers = cells.select("header").distinct().withColumn("field_name", field_of(header_stem(F.col("header")))).where("field_name is not null")
    return cells.join(headers, "header")


def path_unions(rows: DataFrame) -> DataFrame:
    """(publication_slug, field_name, path, types): the union of tags per path of each file; ``$`` is the value itself,
    ``.key`` goes into an object and ``[]`` into an array.

    Only values that hold others are opened, level by level, until none is left; what was seen is reduced to one row per file,
    path and tag before any shuffle.
    """
    level = cut_lineage(_with_fields(_cells(rows.where("publication_slug is not null"), ["publication_slug"])).withColumn("path", F.lit("$")))
    keys = ["publication_slug", "field_name", "path"]
    seen = level.select(*keys, "type").distinct()
    while True:
        held = level.where("type in ('array', 'object')").select(*keys, "body")
        if held.isEmpty():
            break
        opened = rows.sparkSession.sql(
            "select publication_slug, field_name, concat(path, coalesce(concat('.', t.key), '[]')) as path, schema_of_variant(t.value) as kind, to_json(t.value) as body "
            "from {held}, lateral variant_explode(try_parse_json(body)) t",
            held=held,
        )
        level = cut_lineage(opened.select(*keys, _tag(F.col("kind")).alias("type"), "body").where("type is not null"))
        seen = seen.unionByName(level.select(*keys, "type").distinct())
    return seen.groupBy(*keys).agg(F.sort_array(F.collect_set("type")).alias("types"))


def alternatives(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """(publication_slug, field_name, path, json_type, change_kind): tags that ``appeared`` or ``vanished`` at a path of a
    field from a body's file before, for fields that both files have."""
    unions = path_unions(rows).select("publication_slug", "field_name", "path", F.explode("types").alias("json_type"))
    pairs = file_pairs(calendar)
    fields = unions.select("publication_slug", "field_name").distinct()
    both = pairs.join(fields, "publication_slug").join(fields.withColumnRenamed("publication_slug", "before"), ["before", "field_name"]).select("publication_slug", "before", "field_name")
    new = both.join(unions, ["publication_slug", "field_name"]).select("publication_slug", "field_name", "path", "json_type", F.lit(1).alias("side"))
    old = both.join(unions.withColumnRenamed("publication_slug", "before"), ["before", "field_name"]).select("publication_slug", "field_name", "path", "json_type", F.lit(0).alias("side"))
    keys = ["publication_slug", "field_name", "path", "json_type"]
    sides = new.unionByName(old).groupBy(*keys).agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low = high")
    return sides.select(*keys, F.when(F.col("high") == 1, "appeared").otherwise("vanished").alias("change_kind"))


def branch_counts(cells: DataFrame) -> DataFrame:
    """(field_name, type, n): the union of all files, at most one row per field and tag."""
    return cells.groupBy("field_name", "type").agg(F.count("*").alias("n"))


def table_branches(table: DataFrame) -> DataFrame:
    """(field_name, type, n): the cells of a unified table's typed branches and of ``more``."""
    filled = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(c.rsplit("__", 1)[0]).alias("field_name"), F.lit(c.rsplit("__", 1)[1]).alias("type")))
        for c in table.columns if "__" in c
    ]
    others = F.transform("more", lambda x: F.struct(x["field_name"].alias("field_name"), x["type"].alias("type")))
    cells = table.select(F.explode(others).alias("x"))
    if filled:
        cells = cells.unionByName(table.select(F.explode(F.array_compact(F.array(*filled))).alias("x")))
    return branch_counts(cells.select("x.*"))


def _of_field(name: str):
    return lambda x: x["field_name"] == name


def newest_rows(rows: DataFrame) -> DataFrame:
    """Every row of every file once, as delivered last."""
    return rows.where("publication_slug is not null").groupBy("publication_slug", "row_no").agg(
        F.max_by("record", F.struct("delivered_at", "record_id")).alias("record")
    )


def _branch(value: Column, tag: str) -> Column:
    kind = {"number": "double", "string": "string", "boolean": "boolean", "array": "array<string>"}.get(tag)
    return F.try_variant_get(value, "$", kind) if kind else F.to_json(value)


def unified_table(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """All files as one table of canonical fields, one row per (publication_slug, row_no).

    Per field: its text, and ``<field>__<tag>`` for every alternative that the union of all files has.  Canonical conversions:
    for amounts ``<field>_value`` in millions of pounds, by the unit of the object, the text or the header; for dates
    ``<field>_date`` from text or serial number; for the evaluation plan a boolean.  A row that was delivered several
    times comes out once, as delivered last.  Where several headers of a row stand for one field the least
    counts, and ``more`` has the others.
    """
    newest = newest_rows(rows)
    cells = cut_lineage(_with_fields(_cells(newest, ["publication_slug", "row_no"])))
    tags: dict[str, list[str]] = {}
    for r in sorted(branch_counts(cells).collect()):
        tags.setdefault(r["field_name"], []).append(r["type"])
    # cells of one row only
    own = cells.groupBy("publication_slug", "row_no").agg(F.sort_array(F.collect_list(F.struct("header", "field_name", "type", "body"))).alias("held"))
    table = same_keys(newest.select("publication_slug", "row_no"), own, ["publication_slug", "row_no"], "left")
    repeated = F.filter("held", lambda x, i: F.exists(F.slice("held", F.lit(1), i), lambda y: y["field_name"] == x["field_name"]))
    table = table.withColumn("more", F.transform(repeated, lambda x: F.named_struct(F.lit("header"), x["header"], F.lit("field_name"), x["field_name"], F.lit("type"), x["type"], F.lit("body"), x["body"])))
    # each field's counted cell by itself, so that every conversion is there once and not once per field
    firsts = F.filter("held", lambda x, i: ~F.exists(F.slice("held", F.lit(1), i), lambda y: y["field_name"] == x["field_name"]))
    counted = table.select("publication_slug", "row_no", F.inline(firsts)).withColumn("v", F.try_parse_json("body"))
    kind, value, field = F.col("type"), F.col("v"), F.col("field_name")
    counted = counted.withColumn("plain", F.try_variant_get(value, "$", "string"))
    text = F.when(kind == "array", F.array_join(F.try_variant_get(value, "$", "array<string>"), " ")).when(kind == "object", F.col("body")).otherwise(F.col("plain"))
    counted = counted.withColumn("text", text).withColumn("parts", F.when(field.isin(*MONEY_FIELDS), cell_parts(F.col("plain"))))
    unit = F.when(kind == "object", F.try_variant_get(value, "$.unit", "string")).when(kind == "string", F.col("parts.unit"))
    noted = F.regexp_extract("header", r"[(\[]([^)\]]*)[)\]]", 1)
    counted = counted.withColumn("own", unit_factor(F.coalesce(unit, F.lit("")))).withColumn("noted", unit_factor(noted))
    number = (
        F.when(kind == "object", F.try_variant_get(value, "$.amount", "double"))
        .when(kind == "number", F.try_variant_get(value, "$", "double"))
        .when(kind == "string", F.col("parts.number").cast("double"))
    )
    amount = F.when(field.isin(*MONEY_FIELDS), number * F.coalesce("own", "noted", F.lit(1e6)) / 1e6)
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.try_variant_get(value, "$", "int"))
    dated = F.when(field.isin("start_date", "end_date"), F.when(kind == "number", serial).otherwise(day_first_date(F.col("text"))))
    planned = F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean")).when(~is_filler(F.col("text")), F.lower(F.trim("text")).rlike("^(y|true|1)"))
    branches = {tag: F.when(kind == tag, _branch(value, tag)) for tag in sorted({t for ts in tags.values() for t in ts})}
    read = counted.select("publication_slug", "row_no", "field_name", "text", amount.alias("amount"), dated.alias("dated"), planned.alias("planned"), *[c.alias(f"as_{tag}") for tag, c in branches.items()])
    columns = []
    for name, _ in FIELD_RULES:
        own_field = F.col("field_name") == name
        columns.append(F.max(F.when(own_field, F.col("text"))).alias(name))
        columns += [F.max(F.when(own_field, F.col(f"as_{tag}"))).alias(f"{name}__{tag}") for tag in tags.get(name, [])]
        if name in MONEY_FIELDS:
            columns.append(F.max(F.when(own_field, F.col("amount"))).alias(f"{name}_value"))
        elif name in ("start_date", "end_date"):
            columns.append(F.max(F.when(own_field, F.col("dated"))).alias(f"{name}_date"))
        elif name == "evaluation_plan":
            columns.append(F.max(F.when(own_field, F.col("planned"))).alias("evaluation_planned"))
    keys = ["publication_slug", "row_no"]
    table = same_keys(table.select(*keys, "more"), read.groupBy(*keys).agg(*columns), keys, "left")
    implied = calendar.groupBy("publication_slug").agg(F.max("money_header_implies").alias("money_header_implies"))
    return table.join(implied, "publication_slug", "left")

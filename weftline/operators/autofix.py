"""Deterministic fixes of missing imports, wrong import paths and invalid values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.kept import joined, kept

EDITS = "array<struct<at:int,old:string,new:string>>"
FIXED_RULES = ("missing-import", "wrong-import-path", "invalid-prop-value")


def fix_rows(found: DataFrame, components: DataFrame) -> DataFrame:
    """Fixes that violations call for: ``page_id, kind, line, component, old, new``.

    A missing import is inserted once a page; wrong paths and values are replaced, values only
    where the prop has a default.
    """
    paths = kept(components.select(F.col("name").alias("component"), "import_path"))
    rows = found.where(F.col("rule").isin(*FIXED_RULES) & ((F.col("rule") != "invalid-prop-value") | (F.col("suggestion") != ""))).join(paths, "component")
    kind = F.when(F.col("rule") == "missing-import", "import").when(F.col("rule") == "wrong-import-path", "path").otherwise("value")
    bad_value = F.regexp_extract("message", r'^invalid value "([\s\S]*)" for ', 1)
    value = F.col("kind") == "value"
    each = rows.withColumn("kind", kind).select("page_id", "kind", "line", "component", F.when(value, bad_value).otherwise("").alias("old"), F.when(value, F.col("suggestion")).otherwise(F.col("import_path")).alias("new"))
    insert = F.col("kind") == "import"
    # Dealt by page, so that a page's fixes stand together in all that follows.
    once = each.repartition("page_id").groupBy("page_id", "kind", "component", "old", "new", F.when(~insert, F.col("line")).alias("_line")).agg(F.min("line").alias("line"), F.count("*").cast("int").alias("_n"))
    times = F.when(insert, 1).otherwise(F.col("_n"))
    return once.select("page_id", "kind", "line", "component", "old", "new", F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def _quoted(line: Column, mark: str) -> Column:
    """What stands between the first two marks of a line; empty if nothing does."""
    return F.regexp_extract(line, f"{mark}([^{mark}]*){mark}", 1)


def _path_edit(importing: Column, fix: Column) -> Column:
    """Where a wrong import path is put right: the first line that names the component and an import from elsewhere."""
    other = lambda quoted: (quoted != "") & (quoted != fix["new"])
    place = F.get(F.filter(importing, lambda p: p["line"].contains(fix["component"]) & (other(p["double"]) | other(p["single"]))), F.lit(0))
    return F.struct(place["at"].alias("at"), F.when(other(place["double"]), place["double"]).otherwise(place["single"]).alias("old"), fix["new"].alias("new"))


def _replaced(line: Column, edit: Column) -> Column:
    """The line with the first occurrence of the edit's old text replaced."""
    at = F.instr(line, edit["old"])
    return F.when(at > 0, F.concat(F.substring(line, F.lit(1), at - 1), edit["new"], F.substring(line, at + F.length(edit["old"]), F.length(line)))).otherwise(line)


def with_edits(pages: DataFrame, code: str, fixes: str, name: str) -> DataFrame:
    """Add a page's text with its fixes: replacements line by line in the fixes' order, then insertions below the last line that starts an import.

    What an edit replaces is found in the text as it was; later insertions stand above earlier ones. Each step is a
    column of its own that the next reads more than once, so none is computed anew for every line.
    """
    of_kind = lambda kind: F.filter(fixes, lambda f: f["kind"] == kind)
    mark = F.lit('"')
    values = F.transform(of_kind("value"), lambda f: F.struct((f["line"] - 1).alias("at"), F.concat(mark, f["old"], mark).alias("old"), F.concat(mark, f["new"], mark).alias("new")))
    cut = pages.withColumn("_lines", F.split(F.coalesce(code, F.lit("")), "\n", -1))
    places = F.transform("_lines", lambda line, i: F.when(line.contains("import"), F.struct(i.alias("at"), line.alias("line"), _quoted(line, '"').alias("double"), _quoted(line, "'").alias("single"))))
    importing = cut.withColumn("_importing", F.filter(places, lambda p: p.isNotNull()))
    found = importing.withColumn("_paths", F.when(F.size("_importing") > 0, F.array_distinct(F.transform(of_kind("path"), lambda f: _path_edit(F.col("_importing"), f)))))
    edits = found.withColumn("_edits", F.filter(F.concat(F.coalesce("_paths", F.array().cast(EDITS)), values), lambda e: e["at"].isNotNull()))
    placed = edits.withColumn("_ats", F.transform("_edits", lambda e: e["at"]))
    changed = F.transform("_lines", lambda line, i: F.when(F.array_contains("_ats", i), F.aggregate(F.filter("_edits", lambda e: e["at"] == i), line, _replaced)).otherwise(line))
    lines = placed.withColumn("_changed", F.when(F.size("_ats") > 0, changed).otherwise(F.col("_lines")))
    starts = lambda line: line.contains("import") & line.rlike(r"^\s*import[ {]")
    last = lines.withColumn("_last", F.array_max(F.transform("_changed", lambda line, i: F.when(starts(line), i + 1).otherwise(0))))
    wanted = F.transform(of_kind("import"), lambda f: F.concat(F.lit("import { "), f["component"], F.lit(' } from "'), f["new"], mark))
    whole = F.concat(F.slice("_changed", F.lit(1), F.col("_last")), F.reverse(F.array_distinct(wanted)), F.slice("_changed", F.col("_last") + 1, F.size("_changed")))
    return last.withColumn(name, F.array_join(whole, "\n")).drop("_lines", "_importing", "_paths", "_edits", "_ats", "_changed", "_last")


def fixed_pages(pages: DataFrame, fixes: DataFrame) -> DataFrame:
    """Pages that have fixes: ``page_id, fixes, fixed_code``; a page's fixes go by kind, line and component."""
    ordered = F.sort_array(F.collect_list(F.struct("kind", "line", "component", "old", "new")))
    grouped = fixes.groupBy("page_id").agg(ordered.alias("fixes"))
    return with_edits(joined(pages, grouped, ["page_id"]), "code", "fixes", "fixed_code").select("page_id", "fixes", "fixed_code")

"""Rules that hold pages' usages and imports against a catalog: each rule is one column of violations.

The catalog side is small by nature, but its size is not assumed: it is written as tables, whose size Spark knows, and joins
are plain equi-joins, so Spark broadcasts a side when that allows. All violations have ``page_id, rule, severity,
component, prop, line, message, suggestion``.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lexical import with_elements
from weftline.sources.kept import kept

#: Attributes that no catalog needs to define.
FREE_PROPS = ("...spread", "key", "ref", "className", "children")


@dataclass(frozen=True)
class Rulebook:
    """The catalog as the rules need it; ``of`` derives it from component tables."""

    components: DataFrame  # name, import_path, deprecated, deprecated_msg
    props: DataFrame  # component, name, required, default, allowed_values, deprecated
    subs: DataFrame  # name, parent, allowed_parents, must_contain

    @staticmethod
    def of(components: DataFrame) -> Rulebook:
        last = lambda rows, key, order: rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
        top = last(components, "name", [F.desc("pos")])
        props = top.select(F.col("name").alias("component"), F.posexplode("props").alias("_at", "_p")).select("component", "_at", "_p.*")
        props = props.withColumn("_n", F.row_number().over(Window.partitionBy("component", "name").orderBy(F.desc("_at")))).where("_n = 1")
        subs = components.select(F.col("name").alias("parent"), "pos", F.posexplode("sub_components").alias("_at", "_s"))
        subs = last(subs.select("parent", "pos", "_at", "_s.name", "_s.allowed_parents", "_s.must_contain"), "name", [F.desc("pos"), F.desc("_at")])
        return Rulebook(
            top.select("name", "import_path", "deprecated", "deprecated_msg"),
            props.select("component", "name", "required", "default", "allowed_values", "deprecated"),
            subs.select("name", "parent", "allowed_parents", "must_contain"),
        )


VIOLATION = "array<struct<rule:string,severity:string,prop:string,message:string,suggestion:string>>"


def _violation(rule: str, severity: str, message: Column, prop: Column | None = None, suggestion: Column | None = None) -> Column:
    no = F.lit("")
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (no if prop is None else prop).alias("prop"), message.alias("message"),
        F.coalesce(no if suggestion is None else suggestion, no).alias("suggestion"),
    )


def _if(condition: Column, *found: Column) -> Column:
    """The violations found where the condition holds, else none."""
    return F.when(condition, F.array(*found)).otherwise(F.array().cast(VIOLATION)).cast(VIOLATION)


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def classified(usages: DataFrame, book: Rulebook) -> DataFrame:
    """Usages with what the catalog knows of their name: ``is_top``, ``is_sub`` and both definitions, ``defined`` props as an array."""
    props = book.props.groupBy(F.col("component").alias("name")).agg(F.collect_list(F.struct("name", "required", "default", "allowed_values", "deprecated")).alias("defined"))
    top = book.components.join(props, "name", "left").select(
        F.col("name").alias("component_name"), F.lit(True).alias("is_top"), "import_path", F.col("deprecated").alias("component_deprecated"), "deprecated_msg", "defined"
    )
    sub = book.subs.select(F.col("name").alias("component_name"), F.lit(True).alias("is_sub"), "allowed_parents", "must_contain")
    out = usages.join(kept(top), "component_name", "left").join(kept(sub), "component_name", "left")
    no_props = F.array().cast(dict(props.dtypes)["defined"])
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_top", "is_sub")}).withColumn("defined", F.coalesce("defined", no_props))


def unknown_component() -> Column:
    return _if(~F.col("is_top") & ~F.col("is_sub"), _violation("unknown-component", "warning", _text("unknown component ", F.col("component_name"))))


def deprecated_component() -> Column:
    more = F.when(F.col("deprecated_msg") != "", _text(": ", F.col("deprecated_msg"))).otherwise("")
    return _if(F.col("is_top") & F.col("component_deprecated"), _violation("deprecated-component", "warning", _text("deprecated component ", F.col("component_name"), more)))


def import_rules() -> Column:
    """Top-level components that a page doesn't import, or imports from elsewhere; ``source`` is the page's import."""
    name, path = F.col("component_name"), F.col("import_path")
    missing = _violation("missing-import", "error", _text(name, " is not imported"), suggestion=_text("Add: import { ", name, ' } from "', path, '"'))
    wrong = _violation("wrong-import-path", "error", _text(name, " is imported from ", F.col("source"), ", not from ", path), suggestion=_text("Use: ", path))
    return F.concat(_if(F.col("is_top") & F.col("source").isNull(), missing), _if(F.col("is_top") & (F.col("source") != path), wrong))


def required_props() -> Column:
    """Required props that a usage lacks; neither a spread nor a body stands in for them."""
    lacking = F.filter("defined", lambda p: p["required"] & ~F.map_contains_key(F.col("props"), p["name"]))
    suggestion = lambda p: F.when(p["default"] != "", _text("Default: ", p["default"]))
    return F.transform(lacking, lambda p: _violation("missing-required-prop", "error", _text(F.col("component_name"), " needs prop ", p["name"]), p["name"], suggestion(p)))


def prop_rules() -> Column:
    """Props of top-level components that are unknown, deprecated, or have a value that isn't allowed."""
    given = F.filter(F.map_entries("props"), lambda g: F.col("is_top") & ~g["key"].isin(*FREE_PROPS))
    name = lambda prop: _text(F.col("component_name"), ".", prop)
    unknown = F.transform(
        F.filter(given, lambda g: ~F.exists("defined", lambda p: p["name"] == g["key"])), lambda g: _violation("unknown-prop", "info", _text("unknown prop ", name(g["key"])), g["key"])
    )
    pairs = F.filter(F.transform("defined", lambda p: F.struct(p.alias("p"), F.element_at("props", p["name"]).alias("value"))), lambda x: x["value"].isNotNull() & ~x["p"]["name"].isin(*FREE_PROPS))
    deprecated = F.transform(F.filter(pairs, lambda x: x["p"]["deprecated"]), lambda x: _violation("deprecated-prop", "warning", _text("deprecated prop ", name(x["p"]["name"])), x["p"]["name"]))
    wrong = F.filter(pairs, lambda x: (F.size(x["p"]["allowed_values"]) > 0) & ~F.array_contains(x["p"]["allowed_values"], x["value"]) & ~x["value"].isin("", "true"))
    message = lambda x: _text('invalid value "', x["value"], '" for ', name(x["p"]["name"]), "; allowed: ", F.array_join(x["p"]["allowed_values"], ", "))
    suggestion = lambda x: F.when(x["p"]["default"] != "", x["p"]["default"])
    invalid = F.transform(wrong, lambda x: _violation("invalid-prop-value", "warning", message(x), x["p"]["name"], suggestion(x)))
    return F.concat(unknown, deprecated, invalid)


def composition_rule() -> Column:
    """Sub-components outside the parents that the catalog allows."""
    parents, parent = F.col("allowed_parents"), F.col("parent_component")
    place = F.when(parent == "", " has no parent; allowed: ").otherwise(_text(" stands in ", parent, "; allowed: "))
    advice = F.concat(F.when(parent == "", "Wrap in ").otherwise("Move inside "), F.get(parents, F.lit(0)))
    found = _violation("composition-violation", "error", _text(F.col("component_name"), place, F.array_join(parents, ", ")), suggestion=advice)
    return _if(F.col("is_sub") & (F.size(parents) > 0) & ~F.array_contains(parents, parent), found)


def children_rule() -> Column:
    """Children that a sub-component must contain and no usage of that name on the page does."""
    lacking = F.filter(F.when(F.col("is_sub"), F.col("must_contain")), lambda c: ~F.array_contains("children", c))
    return F.transform(lacking, lambda c: _violation("missing-child", "error", _text(F.col("component_name"), " must contain ", c), c, _text("Add: ", c)))


def judged(usages: DataFrame, book: Rulebook) -> DataFrame:
    """``component, places`` and ``found``, the violations of each of ``jsx.page_usages``' rows.

    Unknown names get no further checks; imports and props are checked for top-level names only,
    composition and children for sub-components only. A usage's row has its page's import of its name and what the page
    nests in that name and meets the catalog once; all rules read that one row, so pages are parsed once however many rules there are,
    no page meets another, and equal usages are judged together.
    """
    rows = classified(usages, book)
    rules = (unknown_component(), deprecated_component(), import_rules(), required_props(), prop_rules(), composition_rule(), children_rule())
    none = F.array().cast(VIOLATION)
    found = F.concat(*(F.coalesce(r.cast(VIOLATION), none) for r in rules))
    return rows.select(F.col("component_name").alias("component"), "places", F.when(F.col("component_name").isNull(), none).otherwise(found).alias("found"))


def violations(judged: DataFrame) -> DataFrame:
    """A row for each violation that ``judged`` found, at each place of the usage.

    ``explode_outer`` keeps Spark from testing the size of what was found before it is made, which would judge twice.
    """
    each = judged.select("component", "places", F.explode_outer("found").alias("_v")).where("_v is not null")
    return each.select("component", "_v", F.explode("places").alias("_p")).select("_p.page_id", "_v.rule", "_v.severity", "component", "_v.prop", "_p.line", "_v.message", "_v.suggestion")


def with_severity(found: DataFrame, severity: str) -> DataFrame:
    return found.where(F.col("severity") == severity)


def summary(errors: Column, warnings: Column, infos: Column) -> Column:
    """``N error(s), N warning(s), N info(s)`` without zeros, or ``no issues found``."""
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}(s)"))) for n, word in ((errors, "error"), (warnings, "warning"), (infos, "info"))]
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "no issues found").otherwise(text)


def page_results(judged: DataFrame) -> DataFrame:
    """A row for each page, clean ones too: ``page_id, valid, errors, warnings, infos, summary``."""
    of = lambda severity: F.size(F.filter("found", lambda v: v["severity"] == severity)).cast("long")
    each = judged.select("places", *(of(s).alias(f"_{s}") for s in ("error", "warning", "info"))).select("*", F.explode_outer("places").alias("_p"))
    rows = each.groupBy("_p.page_id", "_p.page").agg(*(F.sum(f"_{s}").alias(f"{s}s") for s in ("error", "warning", "info")))
    return rows.select("page_id", "errors", "warnings", "infos", (F.col("errors") == 0).alias("valid"), summary(F.col("errors"), F.col("warnings"), F.col("infos")).alias("summary"))


def analysis(pages: DataFrame) -> DataFrame:
    """Each usage with its prop names and its number of children: ``page_id, pos, component_name, line, props, children_count``.

    A child is credited to the first usage of its parent's name; usages of one name on one line share a count.
    """
    found = with_elements(pages, "code", "page_id")
    each = found.select("page_id", *(F.col(f"_elements.{c}").alias(f"_{c}s") for c in ("name", "parent", "line")), F.posexplode("_elements").alias("pos", "_e"))
    # Lines ascend with pos, so of a name's usages the first has the least line and owns every child.
    first = F.get("_lines", (F.array_position("_names", F.col("_e.name")) - 1).cast("int"))
    count = (F.size("_parents") - F.size(F.array_remove("_parents", F.col("_e.name")))).cast("long")
    return each.select("page_id", "pos", F.col("_e.name").alias("component_name"), "_e.line", F.sort_array(F.map_keys("_e.props")).alias("props"), F.when(F.col("_e.line") == first, count).otherwise(0).alias("children_count"))

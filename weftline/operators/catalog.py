"""Catalog queries and integrity checks over catalog tables."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import contains_folded
from weftline.sources.catalog import Catalog
from weftline.sources.kept import joined


def list_categories(categories: DataFrame) -> DataFrame:
    """Categories in catalog order with their number of components."""
    return categories.orderBy("pos").select("name", "description", "components", F.size("components").alias("component_count"))


def list_components(components: DataFrame, category: str = "", keyword: str = "") -> DataFrame:
    """Components of a category (exact) whose name or description has the keyword, any case; either may be empty."""
    rows = components.where(F.col("category") == category) if category else components
    if keyword:
        rows = rows.where(contains_folded(F.col("name"), keyword) | contains_folded(F.col("description"), keyword))
    return rows.orderBy("pos").select("pos", "name", "description", "category", "import_path")


def aliases(components: DataFrame) -> DataFrame:
    """Every name that finds a component: its own first, then its sub-components' names: ``alias, prio, pos``."""
    own = components.select(F.col("name").alias("alias"), F.lit(0).alias("prio"), "pos")
    subs = components.select(F.explode("sub_components.name").alias("alias"), F.lit(1).alias("prio"), "pos")
    ranked = own.unionByName(subs)
    # Of equal sub-component names the last definition counts, of equal component names the last too.
    return ranked.groupBy("alias", "prio").agg(F.max("pos").alias("pos"))


def get_component(components: DataFrame, name: str) -> DataFrame:
    """The component of that name, else the one that has it as a sub-component."""
    hit = aliases(components).where(F.col("alias") == name).agg(F.min_by("pos", "prio").alias("pos"))
    return components.join(F.broadcast(hit), "pos")  # one row


def get_components(components: DataFrame, names: DataFrame) -> DataFrame:
    """Components for requested ``names(name, at)``: once each, in request order, unknown names skipped."""
    wanted = names.groupBy("name").agg(F.min("at").alias("at"))
    return components.join(wanted, "name").orderBy("at")


def component_details(components: DataFrame, names: DataFrame) -> DataFrame:
    """Components by own name in request order, then those found through a sub-component, each once."""
    hits = aliases(components).join(names, F.col("alias") == F.col("name"))
    first = hits.groupBy("alias").agg(F.min("prio").alias("prio"), F.min_by("pos", "prio").alias("pos"), F.min("at").alias("at"))
    order = first.groupBy("pos").agg(F.min(F.struct("prio", "at")).alias("_order"))
    return components.join(order, "pos").orderBy("_order").drop("_order")


def component_examples(components: DataFrame, name: str) -> DataFrame:
    return get_component(components, name).select(F.posexplode("examples").alias("pos", "_e")).orderBy("pos").select("_e.*")


def inspect(components: DataFrame, name: str) -> DataFrame:
    """The component that ``name`` finds, whether it is asked for by a sub-component, and that one's own props, its name in any case."""
    own = F.filter("sub_components", lambda s: F.lower(s["name"]) == name.lower())
    none = F.slice("props", 1, 0)
    found = get_component(components, name).withColumn("is_sub_component", F.col("name") != name)
    return found.withColumn("sub_component_props", F.when(F.col("is_sub_component"), F.coalesce(F.get(own, F.lit(0))["props"], none)).otherwise(none))


def list_tokens(tokens: DataFrame, category: str = "") -> DataFrame:
    return (tokens.where(F.col("category") == category) if category else tokens).orderBy("pos")


def list_guidelines(catalog: Catalog, component: str = "") -> DataFrame:
    """Global guidelines, then those of a top-level component; other names add none."""
    shared = catalog.guidelines.select(F.lit(0).alias("scope"), "pos", "rule", "description", "severity", "component")
    own = catalog.components.where(F.col("name") == component).select(F.posexplode("guidelines").alias("pos", "_g"))
    own = own.select(F.lit(1).alias("scope"), "pos", "_g.rule", "_g.description", "_g.severity", "_g.component")
    return shared.unionByName(own).orderBy("scope", "pos")


def search_reason(keyword: Column) -> Column:
    """First tier of a component that has the keyword: name, description, a prop, a sub-component; null if none."""
    has = lambda text: contains_folded(text, keyword)
    props = F.filter("props", lambda p: has(p["name"]))
    subs = F.filter("sub_components", lambda s: has(s["name"]))
    tier = (
        F.when(has(F.col("name")), "name")
        .when(has(F.col("description")), "description")
        .when(F.size(props) > 0, F.concat(F.lit("prop:"), F.get(props, F.lit(0))["name"]))
        .when(F.size(subs) > 0, F.concat(F.lit("sub-component:"), F.get(subs, F.lit(0))["name"]))
    )
    return F.when(keyword != "", tier)


def search_components(components: DataFrame, keyword: str) -> DataFrame:
    """Components with the keyword and why, in catalog order, one row a name."""
    found = components.withColumn("reason", search_reason(F.lit(keyword))).where("reason is not null")
    first = found.groupBy("name").agg(F.min_by(F.struct("pos", "description", "category", "import_path", "reason"), "pos").alias("_f"))
    return first.select("name", "_f.*").orderBy("pos")


def components_by_category(components: DataFrame) -> DataFrame:
    """Sorted names of each category, in category order."""
    return components.groupBy("category").agg(F.sort_array(F.collect_list("name")).alias("components")).orderBy("category")


def integrity_errors(catalog: Catalog) -> DataFrame:
    """All errors of a catalog: ``error, subject``; no rows means valid.

    Checks that depend on what was seen before compare positions, so an order of rows is all that
    they need.
    """
    components, categories = catalog.components, catalog.categories
    subs, severities = catalog.sub_components, ("error", "warning", "info")
    named = components.where("name <> ''")

    def errors(rows: DataFrame, error: str, subject: Column | str) -> DataFrame:
        return rows.select(F.lit(error).alias("error"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"))

    def repeated(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("name").orderBy(*[c for c in ("parent_pos", "pos") if c in rows.columns])
        return rows.where("name <> ''").withColumn("_n", F.row_number().over(order)).where("_n > 1")

    top_props = catalog.props.select(F.col("component").alias("owner"), "name", "type")
    sub_props = subs.select(F.col("name").alias("owner"), F.explode("props").alias("_p")).select("owner", "_p.name", "_p.type")
    props = top_props.unionByName(sub_props)
    rules = catalog.guidelines.select(F.lit("").alias("owner"), "rule", "severity").unionByName(
        components.select(F.col("name").alias("owner"), F.explode("guidelines").alias("_g")).select("owner", "_g.rule", "_g.severity")
    )
    known, groups = named.select("name").distinct(), categories.select(F.col("name").alias("category")).distinct()
    listed = categories.select(F.explode("components").alias("name"), F.col("name").alias("category"))
    earlier = joined(subs, named.select("name", F.col("pos").alias("_seen")), ["name"]).where("_seen <= parent_pos")
    checks = [
        errors(catalog.meta.where("name = ''"), "catalog name is required", F.lit("")),
        errors(catalog.meta.where("version = ''"), "catalog version is required", F.lit("")),
        errors(categories.where("name = ''"), "category name is required", F.col("pos").cast("string")),
        errors(repeated(categories), "duplicate category", "name"),
        errors(components.where("name = ''"), "component name is required", F.col("pos").cast("string")),
        errors(named.where("import_path = ''"), "import_path is required", "name"),
        errors(named.where("size(imported_names) = 0"), "imported_names is required", "name"),
        errors(repeated(components), "duplicate component", "name"),
        errors(named.where("category <> ''").join(F.broadcast(groups), "category", "left_anti"), "unknown category", "name"),
        errors(props.where("name = ''"), "prop name is required", "owner"),
        errors(props.where("name <> '' and type = ''"), "prop type is required", F.concat_ws(".", "owner", "name")),
        errors(subs.where("name = ''"), "sub-component name is required", "parent"),
        errors(repeated(subs), "duplicate sub-component", "name"),
        errors(earlier, "sub-component collides with a component", "name"),
        errors(rules.where(~F.col("severity").isin(*severities)), "invalid severity", F.concat_ws(".", "owner", "rule")),
        errors(joined(listed, known, ["name"], "left_anti"), "category lists an unknown component", F.concat_ws(".", "category", "name")),
    ]
    return reduce(DataFrame.unionByName, checks)


def checked(catalog: Catalog) -> Catalog:
    """The same catalog, whose tables can only be read if it has no integrity error; all errors stand in one message.

    The errors are a one-row aggregate that stands beside every table, so reading any of them checks all.
    """
    found = integrity_errors(catalog).agg(F.sort_array(F.collect_list(F.concat_ws(": ", "error", F.when(F.col("subject") != "", F.col("subject"))))).alias("_e"))
    fails = F.raise_error(F.concat(F.lit("catalog validation failed: "), F.array_join("_e", "; "))).cast("boolean")
    valid = found.select(F.when(F.size("_e") == 0, F.lit(True)).otherwise(fails).alias("_valid"))
    guarded = lambda rows: rows.crossJoin(F.broadcast(valid)).where("_valid").drop("_valid")  # noqa: E731  one row
    return Catalog(*(guarded(getattr(catalog, f.name)) for f in fields(catalog)))

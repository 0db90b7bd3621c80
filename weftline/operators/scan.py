"""From module facts to a component catalog: detection, props, enrichment, grouping, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import modules as m
from weftline.functions.text import category_of_path, docgen_type, import_path, is_component_name
from weftline.operators.catalog import checked
from weftline.operators.order import numbered
from weftline.sources.catalog import CATEGORY, GUIDELINE, Catalog
from weftline.sources.kept import joined, kept


def detected(facts: DataFrame, symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """Components of all files: ``path, pos, name, kind, props_type, is_default_export``.

    Candidates are exported functions and classes with a component's name, and exported names that
    are a symbol of the file. Functions need JSX; variables a forwardRef or memo call, or JSX;
    classes a heritage with ``Component``.
    """
    own = F.expr("is_exported and kind in ('function', 'variable', 'class')")
    declared = symbols.select("path", "name", own.alias("_own"), F.lit(True).alias("_symbol"), F.lit(False).alias("_export"))
    both = declared.unionByName(exports.select("path", "name", F.lit(False).alias("_own"), F.lit(False).alias("_symbol"), F.lit(True).alias("_export"))).where(is_component_name(F.col("name")))
    candidates = both.groupBy("path", "name").agg(*(F.max(c).alias(c) for c in ("_own", "_symbol", "_export"))).where("_own or _symbol and _export").select("path", "name")
    last = facts.withColumn("_n", F.row_number().over(Window.partitionBy("path", "name").orderBy(F.desc("pos")))).where("_n = 1 and word in ('function', 'class', 'const', 'let', 'var')")
    kind = (
        F.when((F.col("word") == "function") & F.col("has_jsx"), "function").when((F.col("word") == "class") & F.col("heritage").contains("Component"), "class")
        .when((F.col("callee") != ""), F.col("callee")).when(F.col("word").isin("const", "let", "var") & F.col("has_jsx"), "function")
    )
    rows = joined(candidates, last, ["path", "name"]).withColumn("kind", kind).where("kind is not null")
    return rows.select("path", "pos", "name", "kind", "props_type", "body", F.lit(False).alias("is_default_export"))


def component_props(components: DataFrame, declared: DataFrame, variants: DataFrame, type_heads: DataFrame, inline: DataFrame | None = None) -> DataFrame:
    """Props of detected components: ``path, component, pos, name, type, required, default, description, allowed_values, deprecated``.

    The declaration that a component's props type names in its file gives the props, else the
    parameters it takes apart do, with the types of an object type written beside them (``inline``) or untyped. Defaults in the head overwrite. Variant sets add props and
    fill what is empty, for components that reference them in their text or in what their props type
    extends (``type_heads``), or where a file has one of each.
    """
    heads = components.select("path", F.col("name").alias("component"), "props_type", "kind", "body")
    by_type = joined(heads.where("props_type <> ''").select("path", "component", F.col("props_type").alias("owner")), declared, ["path", "owner"])
    defaults = m.destructured_defaults(components.where("kind <> 'class'"))
    base = kept(by_type.select("path", "component", "pos", "name", "type", "required", "description", "deprecated", "allowed_values"))
    loose = joined(defaults, base.select("path", "component").distinct(), ["path", "component"], "left_anti").select(
        "path", "component", "pos", "name", F.lit("unknown").alias("type"), F.lit(False).alias("required"), F.lit("").alias("description"), F.lit(False).alias("deprecated"), F.array().cast("array<string>").alias("allowed_values")
    )
    if inline is not None:
        own = joined(inline.withColumnRenamed("owner", "component"), base.select("path", "component").distinct(), ["path", "component"], "left_anti")
        typed = own.select("path", "component", "name", *(F.col(c).alias(f"_{c}") for c in ("pos", "type", "required", "description", "deprecated", "allowed_values")))
        known = components.where("kind <> 'class'").select("path", F.col("name").alias("component"))
        both = joined(loose, joined(typed, known, ["path", "component"], "left_semi"), ["path", "component", "name"], "full_outer")
        either = lambda c: F.coalesce(f"_{c}", c).alias(c)
        loose = both.select("path", "component", F.coalesce("pos", F.col("_pos") + 500).alias("pos"), "name", *(either(c) for c in ("type", "required", "description", "deprecated", "allowed_values")))
    with_default = joined(base.unionByName(loose), defaults.select("path", "component", "name", "default"), ["path", "component", "name"], "left").na.fill("", ["default"])

    counts = heads.groupBy("path").agg(F.count("*").alias("_components"))
    sets = joined(variants.withColumn("_sets", F.size(F.collect_set("variable").over(Window.partitionBy("path")))), counts, ["path"])
    of = lambda text: text.contains(F.concat(F.lit("typeof "), "variable"))
    named = of(F.col("body")) | F.coalesce(of(F.col("head")), F.lit(False))
    refer = joined(joined(heads, sets, ["path"]), type_heads.withColumnRenamed("owner", "props_type"), ["path", "props_type"], "left")
    extra = refer.where(named | ((F.col("_sets") == 1) & (F.col("_components") == 1))).select(
        "path", "component", (F.col("pos") + 1000).alias("_vpos"), "name", F.col("allowed_values").alias("_allowed"), F.col("default").alias("_default")
    )
    both = joined(with_default, extra, ["path", "component", "name"], "full_outer")
    return both.select(
        "path", "component", F.coalesce("pos", "_vpos").alias("pos"), "name", F.coalesce("type", F.lit("string")).alias("type"), F.coalesce("required", F.lit(False)).alias("required"),
        filled("default", F.col("_default")).alias("default"), F.coalesce("description", F.lit("")).alias("description"),
        F.when(F.size(F.coalesce("allowed_values", F.array().cast("array<string>"))) > 0, F.col("allowed_values")).otherwise(F.coalesce("_allowed", F.array().cast("array<string>"))).alias("allowed_values"),
        F.coalesce("deprecated", F.lit(False)).alias("deprecated"),
    )


def filled(base: str, other: Column) -> Column:
    """The base value, or the other where the base is null or empty."""
    return F.when(F.coalesce(F.col(base), F.lit("")) != "", F.col(base)).otherwise(F.coalesce(other, F.lit("")))


def enriched(props: DataFrame, docgen: DataFrame) -> DataFrame:
    """Merge what a documentation generator reports: ``docgen(component, pos, name, type, required, default, description, allowed_values, deprecated)``.

    Base values that are set stay; required is only upgraded; deprecated is either's; new props are
    appended. Of equal reported names the last counts. Where both have a ``path``, components of one
    name in different files are told apart by it.
    """
    keys = [c for c in ("path", "component", "name") if c in props.columns and c in docgen.columns]
    other = docgen.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pos")))).where("_n = 1")
    other = other.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("pos", "type", "required", "default", "description", "allowed_values", "deprecated")))
    both = joined(props, other, keys, "full_outer")
    no_values = F.array().cast("array<string>")
    return both.select(
        *keys, F.coalesce("pos", F.col("_pos") + 2000).alias("pos"), filled("type", docgen_type(F.col("_type"))).alias("type"),
        (F.coalesce("required", F.lit(False)) | F.coalesce("_required", F.lit(False))).alias("required"), filled("default", F.col("_default")).alias("default"),
        filled("description", F.col("_description")).alias("description"),
        F.when(F.size(F.coalesce("allowed_values", no_values)) > 0, F.col("allowed_values")).otherwise(F.coalesce("_allowed_values", no_values)).alias("allowed_values"),
        (F.coalesce("deprecated", F.lit(False)) | F.coalesce("_deprecated", F.lit(False))).alias("deprecated"),
    )


#: Intrinsic types whose props documentation generators inherit; so is every name that ends in HTMLAttributes.
INTRINSIC_PARENTS = (
    "Attributes",
    "RefAttributes",
    "ClassAttributes",
    "DOMAttributes",
    "AriaAttributes",
    "HTMLAttributes",
    "SVGAttributes",
    "SVGProps",
    "HTMLProps",
    "AllHTMLAttributes",
    "SVGLineElementAttributes",
    "SVGTextElementAttributes",
)


def docgen_rows(reports: DataFrame) -> DataFrame:
    """Clean reports of ``component, pos, name, parent, type, required, default, description, values, tags``.

    Props inherited from intrinsic elements go; of allowed values, true and false alone are none and
    quoted ones are kept bare.
    """
    own = reports.where(~(F.col("parent").isin(*INTRINSIC_PARENTS) | F.col("parent").endswith("HTMLAttributes")))
    bare = F.filter("values", lambda v: v.rlike("^\"[\\s\\S]*\"$"))
    flags = F.size(F.array_except("values", F.array(F.lit("true"), F.lit("false")))) == 0
    values = F.when(flags, F.array().cast("array<string>")).when((F.size("values") == 1) & (F.size(bare) == 0), F.col("values")).otherwise(F.transform(bare, lambda v: F.regexp_replace(v, '^"|"$', "")))
    return own.select("component", "pos", "name", "type", "required", F.regexp_replace(F.coalesce("default", F.lit("")), "^[\"']|[\"']$", "").alias("default"), "description", values.alias("allowed_values"), F.map_contains_key("tags", "deprecated").alias("deprecated"))


def compound_groups(components: DataFrame) -> DataFrame:
    """Components whose file's shortest name begins all the others: ``path, parent, name`` for each sub-component."""
    file = Window.partitionBy("path")
    shortest = F.min(F.struct(F.octet_length("name"), "pos", "name")).over(file)["name"]
    rows = components.select("path", "pos", "name", shortest.alias("parent"), F.count("*").over(file).alias("_k"))
    whole = rows.withColumn("_all", F.min(F.col("name").startswith(F.col("parent"))).over(file))
    return whole.where("_k >= 2 and _all and name <> parent").select("path", "parent", "name")


def built_catalog(components: DataFrame, props: DataFrame, tokens: DataFrame, name: str, prefix: str = "", check: bool = False) -> Catalog:
    """Assemble a catalog: sub-components under their parents, sorted by name, categories by folder.

    With ``check`` its tables fail to be read where it has integrity errors, such as two components of one name.
    """
    groups = compound_groups(components)
    fields = F.struct("name", "type", "required", "default", "description", "allowed_values", "deprecated")
    packed = props.groupBy("path", "component").agg(F.sort_array(F.collect_list(F.struct("pos", fields.alias("v")))).alias("_p"))
    packed = packed.select("path", F.col("component").alias("name"), F.transform("_p", lambda x: x["v"]).alias("props"))
    full = joined(components.select("path", "name"), packed, ["path", "name"], "left")
    no_props = F.array().cast(dict(packed.dtypes)["props"])
    full = kept(full.withColumn("props", F.coalesce("props", no_props)))
    subs = joined(groups, full, ["path", "name"]).select("path", "parent", F.struct(
        "name", F.lit("").alias("description"), "props", F.array().cast("array<string>").alias("must_contain"), F.array().cast("array<string>").alias("allowed_children"), F.array("parent").alias("allowed_parents")
    ).alias("_s"))
    subs = subs.groupBy("path", F.col("parent").alias("name")).agg(F.sort_array(F.collect_list("_s")).alias("sub_components"))
    top = joined(joined(full, groups.select("name").distinct(), ["name"], "left_anti"), subs, ["path", "name"], "left")
    top = top.withColumn("sub_components", F.coalesce("sub_components", F.array().cast(dict(subs.dtypes)["sub_components"])))
    rows = top.select(
        "name", F.lit("").alias("description"), category_of_path(F.col("path")).alias("category"), import_path(F.col("path"), prefix).alias("import_path"),
        F.concat(F.array("name"), F.transform("sub_components", lambda s: s["name"])).alias("imported_names"), "props", "sub_components",
        F.array().cast("array<struct<title:string,description:string,code:string>>").alias("examples"), F.array().cast(f"array<{GUIDELINE}>").alias("guidelines"), F.lit(False).alias("deprecated"), F.lit("").alias("deprecated_msg"), "path",
    )
    rows = numbered(rows, "name", "path").drop("path")
    rows = rows.select("pos", *(c for c in rows.columns if c != "pos"))
    spark = components.sparkSession
    listed = rows.groupBy("category").agg(F.sort_array(F.collect_list("name")).alias("components"))
    categories = numbered(listed, "category").select("pos", F.col("category").alias("name"), F.lit("").alias("description"), "components")
    meta = spark.createDataFrame([(name, "1.0", "react", "scan")], "name string, version string, framework string, source string")
    none = spark.createDataFrame([], f"pos int, {GUIDELINE.removeprefix('struct<').removesuffix('>').replace(':', ' ')}")
    assert CATEGORY.startswith("struct<name")
    ranked = numbered(tokens, "category", "name").select("pos", "name", "value", "category")
    built = Catalog(meta, rows, categories, ranked, none)
    return checked(built) if check else built


def scan_stats(files: DataFrame, components: DataFrame, props: DataFrame, milliseconds: float) -> DataFrame:
    """Counts of a scan and its rates, guarded against no files; failed files count as discovered only."""
    status = m.file_status(files)
    discovered = (F.count("*").alias("files"), F.count_if("indexed").alias("files_indexed"), F.count_if(~F.col("indexed")).alias("files_failed"), F.try_divide(F.count_if("indexed"), F.count("*")).alias("success_rate"))
    counts = status.agg(*discovered).crossJoin(components.agg(F.count("*").alias("components"))).crossJoin(props.agg(F.count("*").alias("props")))  # one row each
    return counts.withColumns({"ms_per_file": F.try_divide(F.lit(milliseconds), "files"), "files_per_second": F.try_divide(F.col("files") * 1000.0, F.lit(milliseconds))})


def scan(files: DataFrame, css: DataFrame | None = None, docgen: DataFrame | None = None, name: str = "catalog", prefix: str = "", check: bool = True) -> Catalog:
    """Derive a catalog from ``files(path, content)`` and, if given, style sheets and docgen reports.

    Files that can't be read are left out (``modules.file_status`` tells which and why). Unless ``check`` is off, the
    catalog fails to be read where it has integrity errors, such as two components of one name.
    """
    from weftline.operators.css import design_tokens

    rows = m.modules(files)
    tokens = m.siblings(rows)
    components = kept(detected(m.component_facts(rows), m.symbol_names(rows, tokens), m.module_exports(rows)))
    props = component_props(components, m.interface_props(rows, tokens), m.variant_sets(rows, tokens), m.props_heads(rows), m.inline_props(rows, tokens))
    if docgen is not None:
        paths = components.select("path", F.col("name").alias("component"))
        props = enriched(props, joined(docgen, paths, ["component"]))  # a report that names no file is of all its components
    spark = files.sparkSession
    tokens = design_tokens(css) if css is not None else spark.createDataFrame([], "name string, value string, category string")
    return built_catalog(components, props, tokens, name, prefix, check)

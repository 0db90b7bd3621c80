"""Catalog documents as DataFrames: read, decode, normalise nulls, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROP = "struct<name:string,type:string,required:boolean,default:string,description:string,allowed_values:array<string>,deprecated:boolean>"
SUB = f"struct<name:string,description:string,props:array<{PROP}>,must_contain:array<string>,allowed_children:array<string>,allowed_parents:array<string>>"
EXAMPLE = "struct<title:string,description:string,code:string>"
GUIDELINE = "struct<rule:string,description:string,severity:string,component:string>"
COMPONENT = (
    f"struct<name:string,description:string,category:string,import_path:string,imported_names:array<string>,props:array<{PROP}>,"
    f"sub_components:array<{SUB}>,examples:array<{EXAMPLE}>,guidelines:array<{GUIDELINE}>,deprecated:boolean,deprecated_msg:string>"
)
TOKEN = "struct<name:string,value:string,category:string>"
CATEGORY = "struct<name:string,description:string,components:array<string>>"
DOCUMENT = (
    f"name string, version string, framework string, source string, components array<{COMPONENT}>, tokens array<{TOKEN}>, "
    f"guidelines array<{GUIDELINE}>, categories array<{CATEGORY}>"
)


def without_nulls(value: Column, kind: T.DataType) -> Column:
    """Missing fields as empty strings, false and empty arrays, at every depth."""
    if isinstance(kind, T.StringType):
        return F.coalesce(value, F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(kind, T.ArrayType):
        filled = F.transform(value, lambda x: without_nulls(x, kind.elementType))
        return F.coalesce(filled, F.array().cast(kind))
    if isinstance(kind, T.StructType):
        return F.struct(*(without_nulls(value[f.name], f.dataType).alias(f.name) for f in kind))
    return value


@dataclass(frozen=True)
class Catalog:
    """One catalog as tables; ``pos`` keeps the document's order, which first-match rules depend on."""

    meta: DataFrame
    components: DataFrame
    categories: DataFrame
    tokens: DataFrame
    guidelines: DataFrame

    @property
    def sub_components(self) -> DataFrame:
        """``parent, parent_pos, pos`` and the fields of each sub-component."""
        subs = self.components.select(F.col("name").alias("parent"), F.col("pos").alias("parent_pos"), F.posexplode("sub_components").alias("pos", "_s"))
        return subs.select("parent", "parent_pos", "pos", "_s.*")

    @property
    def props(self) -> DataFrame:
        """``component, pos`` and the fields of each prop of top-level components."""
        return self.components.select(F.col("name").alias("component"), F.posexplode("props").alias("pos", "_p")).select("component", "pos", "_p.*")


def catalog_of(document: DataFrame) -> Catalog:
    """Tables of a one-row DataFrame of DOCUMENT's schema."""
    kinds = T.StructType.fromDDL(DOCUMENT)
    full = document.select(*(without_nulls(F.col(f.name), f.dataType).alias(f.name) for f in kinds))

    def rows(name: str) -> DataFrame:
        return full.select(F.posexplode(name).alias("pos", "_x")).select("pos", "_x.*")

    return Catalog(full.select("name", "version", "framework", "source"), rows("components"), rows("categories"), rows("tokens"), rows("guidelines"))


def _loaded(document: DataFrame, check: bool) -> Catalog:
    from weftline.operators.catalog import checked

    return checked(catalog_of(document)) if check else catalog_of(document)


def read_catalog(spark: SparkSession, path: str, check: bool = True) -> Catalog:
    """Load a catalog JSON document from a path; its tables fail to be read where it has integrity errors, unless ``check`` is off."""
    return _loaded(spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path, multiLine=True), check)


def parse_catalog(texts: DataFrame, col: str = "value", check: bool = True) -> Catalog:
    """Decode a catalog from a one-row DataFrame of JSON text; malformed text is an error, and so is an invalid catalog when it is read."""
    kind = T.StructType.fromDDL(DOCUMENT).simpleString()
    return _loaded(texts.select(F.from_json(col, kind, {"mode": "FAILFAST"}).alias("_d")).select("_d.*"), check)


def write_catalog(catalog: Catalog, path: str) -> None:
    """Write the catalog's JSON document to a new folder that ``read_catalog`` reads."""
    catalog_json(catalog).write.text(path)


def catalog_json(catalog: Catalog) -> DataFrame:
    """The catalog as one row of JSON text, arrays in catalog order."""

    def packed(rows: DataFrame, name: str) -> DataFrame:
        fields = [c for c in rows.columns if c != "pos"]
        in_order = F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("v"))))
        return rows.agg(F.transform(in_order, lambda x: x["v"]).alias(name))

    out = catalog.meta
    for name in ("components", "tokens", "guidelines", "categories"):
        out = out.crossJoin(packed(getattr(catalog, name), name))  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("value"))

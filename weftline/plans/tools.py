"""Whole jobs: validate pages against a catalog, and the tool answers as JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.jsx import imports, page_usages
from weftline.functions.text import line_count, response_bytes, token_estimate
from weftline.operators import autofix, validation
from weftline.operators import catalog as queries
from weftline.sources.catalog import Catalog
from weftline.sources.kept import kept


@dataclass(frozen=True)
class Validation:
    """Results of one validation: a row for each page, all violations, and fixed pages if asked for."""

    results: DataFrame
    violations: DataFrame
    fixed: DataFrame | None


def validate_pages(pages: DataFrame, components: DataFrame, auto_fix: bool = False) -> Validation:
    """Validate ``pages(page_id, code)``, any number of them, in one job."""
    book = validation.Rulebook.of(components)
    pages = kept(pages) if auto_fix else pages  # read for the violations and to be fixed
    judged = validation.judged(page_usages(pages), book)
    found = validation.violations(judged)
    fixed = autofix.fixed_pages(pages, autofix.fix_rows(found, book.components)) if auto_fix else None
    return Validation(validation.page_results(judged), found, fixed)


def analyze_pages(pages: DataFrame) -> DataFrame:
    """A row for each page: ``page_id, components, imports, line_count``."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "component_name", "line", "props", "children_count")))
    components = validation.analysis(pages).groupBy("page_id").agg(parts.alias("components"))
    sources = imports(pages).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("imports"))
    rows = pages.select("page_id", line_count(F.coalesce("code", F.lit(""))).alias("line_count"))
    return rows.join(components, "page_id", "left").join(sources, "page_id", "left")


class Tools:
    """The catalog's tools; every answer is a DataFrame, ``as_json`` makes it one row of text."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def list_categories(self) -> DataFrame:
        return queries.list_categories(self.catalog.categories)

    def list_components(self, category: str = "", keyword: str = "") -> DataFrame:
        return queries.list_components(self.catalog.components, category, keyword).drop("pos")

    def get_component_details(self, names: list[str]) -> DataFrame:
        if not names:
            raise ValueError("names are required")
        spark = self.catalog.components.sparkSession
        return queries.component_details(self.catalog.components, spark.createDataFrame(list(enumerate(names)), "at int, name string"))

    def get_component_examples(self, name: str) -> DataFrame:
        return queries.component_examples(self.catalog.components, name)

    def get_tokens(self, category: str = "") -> DataFrame:
        return queries.list_tokens(self.catalog.tokens, category)

    def get_guidelines(self, component: str = "") -> DataFrame:
        return queries.list_guidelines(self.catalog, component)

    def search_components(self, keyword: str) -> DataFrame:
        return queries.search_components(self.catalog.components, keyword)

    def validate_page(self, pages: DataFrame, auto_fix: bool = False) -> Validation:
        return validate_pages(pages, self.catalog.components, auto_fix)

    def analyze_page(self, pages: DataFrame) -> DataFrame:
        return analyze_pages(pages)


def as_json(rows: DataFrame) -> DataFrame:
    """An answer as JSON text with the size and the token estimate that the call log keeps."""
    answer = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("answer"))  # an answer is a tool's page of rows
    size = response_bytes(F.col("answer"))
    return answer.select(F.to_json("answer").alias("value"), size.alias("response_bytes"), token_estimate(size).alias("tokens_est"))

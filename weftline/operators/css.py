"""Design tokens of style sheets, by DataFrame operations over their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import NOISE, theme_category, token_category, var_reference

_RULE = r"([^{};]*)\{([^{}]*)\}"
_DECLARATION = r"(--[A-Za-z0-9_-]+)\s*:\s*([^;]+)"


def declarations(css: DataFrame) -> DataFrame:
    """Custom properties of innermost rules: ``path, pos, at, selector, variable, value``."""
    plain = F.regexp_replace(F.coalesce("content", F.lit("")), r"/\*(?:[^*]|\*(?!/))*+\*/", "")
    rules = css.select("path", F.posexplode(F.regexp_extract_all(plain, F.lit(_RULE), 0)).alias("pos", "_r"))
    body = rules.select("path", "pos", F.trim(F.regexp_replace(F.regexp_extract("_r", _RULE, 1), r"\s+", " ")).alias("selector"), F.regexp_extract("_r", _RULE, 2).alias("_b"))
    each = body.select("path", "pos", "selector", F.posexplode(F.regexp_extract_all("_b", F.lit(_DECLARATION), 0)).alias("at", "_d"))
    value = F.trim(F.regexp_replace(F.regexp_extract("_d", _DECLARATION, 2), r"\s+", " "))
    return each.select("path", "pos", "at", "selector", F.regexp_extract("_d", _DECLARATION, 1).alias("variable"), value.alias("value"))


def dark_mode(css: DataFrame) -> DataFrame:
    """One row: whether any selector has ``.dark`` or a media query prefers dark."""
    dark = F.col("content").rlike(r"\.dark\b[^{};]*\{|prefers-color-scheme:\s*dark")
    return css.agg(F.coalesce(F.max(dark), F.lit(False)).alias("dark_mode"))


def design_tokens(css: DataFrame) -> DataFrame:
    """``name, value, category`` by category and name.

    ``:root`` rules give tokens, the first value of all files counts. ``@theme`` variables with a
    known prefix hint a category: to the variable that they reference, or, with a value of their
    own, to a token named without the prefix's dashes. ``.dark`` rules give none.
    """
    found = declarations(css).where(~F.col("variable").rlike(NOISE))
    root = found.where("selector = ':root'").select("path", "pos", "at", "variable", "value", F.lit(None).cast("string").alias("hint"))
    theme = found.where("selector rlike '^@theme( |$)'").select("path", "pos", "at", "variable", "value", theme_category(F.col("variable")).alias("hint")).where("hint is not null")
    reference = var_reference(F.col("value"))
    hints = theme.withColumn("_to", reference).where("_to <> ''").groupBy(F.col("_to").alias("variable")).agg(F.max_by("hint", F.struct("path", "pos", "at")).alias("_theme"))
    direct = theme.where(reference == "")
    first = root.unionByName(direct).groupBy("variable").agg(F.min_by(F.struct("value", "hint"), F.struct("path", "pos", "at")).alias("_f"))
    rows = first.join(hints, "variable", "left").select("variable", "_f.value", F.coalesce("_theme", "_f.hint").alias("hint"))
    named = rows.select(F.regexp_replace("variable", "^--", "").alias("name"), "value", token_category(F.col("variable"), F.col("value"), F.col("hint")).alias("category"))
    return named.orderBy("category", "name")

"""Column functions over names, paths, code and log values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_folded(text: Column, part: Column | str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(text), F.lower(part if isinstance(part, Column) else F.lit(part)))


def is_component_name(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def line_count(code: Column) -> Column:
    return F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1


def import_path(path: Column, prefix: str = "") -> Column:
    """Module path of a file relative to the root: last extension and a final ``/index`` gone, prefixed."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "/index$", "")
    return F.concat(F.lit(prefix.rstrip("/") + "/" if prefix else "./"), bare)


def category_of_path(path: Column) -> Column:
    """First folder of a relative path, or ``components`` for files at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("components")


def is_external(source: Column) -> Column:
    return ~source.rlike("^[./]")


def resolved_import(path: Column, source: Column, ext: str) -> Column:
    """Target of a relative import: the folder and the source joined and cleaned, ``ext`` added if it has none."""
    joined = F.concat_ws("/", F.regexp_extract(path, "^(.*)/", 1), source)
    parts = F.filter(F.split(joined, "/"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", acc).otherwise(F.array_append(acc, x)),
    )
    clean = F.concat(F.when(joined.startswith("/"), "/").otherwise(""), F.array_join(up, "/"))
    return F.when(is_external(source), F.lit("")).otherwise(F.when(clean.rlike(r"\.[^./]+$"), clean).otherwise(F.concat(clean, F.lit(ext))))


def capture_name(name: Column) -> Column:
    """A capture's category and field, split at the first dot."""
    parts = F.split(name, r"\.", 2)
    return F.struct(parts[0].alias("category"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("field"))


def literal_type(value: Column) -> Column:
    quoted = value.rlike("^([\"'`])[\\s\\S]*\\1$")
    return F.when(quoted, "string").when(value.isin("true", "false"), "boolean").when(value.rlike("^[-0-9]"), "number").otherwise(value)


def unquoted(value: Column) -> Column:
    return F.when(value.rlike("^([\"'`])[\\s\\S]*\\1$") & (F.length(value) > 1), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)


def docgen_type(kind: Column) -> Column:
    """Plain names of types that documentation generators report."""
    function = kind.isin("() => void", "(...args: any[]) => any")
    react = kind.isin("React.ReactNode", "React.ReactElement")
    return F.when(kind == "enum", "string").when(function, "function").when(react, F.regexp_replace(kind, r"^React\.", "")).otherwise(kind)


def sanitized_params(params: Column, limit: int = 64) -> Column:
    """String parameters of more than ``limit`` bytes are logged as their length only."""
    long = F.map_filter(params, lambda _, v: F.octet_length(v) > limit)
    short = F.map_filter(params, lambda _, v: F.coalesce(F.octet_length(v) <= limit, F.lit(True)))
    lengths = F.transform_values(F.transform_keys(long, lambda k, _: F.concat(k, F.lit("_len"))), lambda _, v: F.octet_length(v).cast("string"))
    return F.map_concat(short, lengths)


def response_bytes(value: Column) -> Column:
    return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))


def token_estimate(size: Column) -> Column:
    return F.floor(size / 4).cast("long")


def symbol_cost(name: Column, params: Column, return_type: Column) -> Column:
    """A symbol's share of a file's token estimate, before the division by four."""
    return F.octet_length(name) * 10 + F.size(params) * 50 + F.when(return_type != "", 20).otherwise(0)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


#: Prefixes of generated custom properties, and the rules that name a token's category.
NOISE = r"^(?:--tw-|--_|--webkit-|--moz-)"
THEME_PREFIXES = {
    "--color-": "color",
    "--spacing-": "spacing",
    "--font-": "typography",
    "--text-": "typography",
    "--leading-": "typography",
    "--tracking-": "typography",
    "--radius-": "border",
    "--shadow-": "shadow",
    "--animate-": "animation",
    "--ease-": "animation",
    "--breakpoint-": "breakpoint",
    "--container-": "layout",
    "--inset-": "spacing",
}
NAME_RULES = [
    (r"^--(background|foreground|primary|secondary|accent|destructive|muted|popover|card|input|ring)($|-)", "color"),
    (r"^--chart-", "chart"),
    (r"^--sidebar-", "sidebar"),
    (r"^--(radius|border)($|-)", "border"),
    (r"^--(spacing|gap|padding|margin)-", "spacing"),
    (r"^--(font|text|line-height|letter-spacing|leading|tracking)-", "typography"),
    (r"^--shadow($|-)", "shadow"),
]
COLOR_VALUE = r"(?i)^\s*(?:(?:oklch|hsla?|rgba?)\(|#[0-9a-f]{3,8}\s*$)"


def theme_category(variable: Column) -> Column:
    """Category that a theme variable's prefix names; null for other variables."""
    out = F.lit(None).cast("string")
    for prefix, category in reversed(THEME_PREFIXES.items()):
        out = F.when(variable.startswith(prefix), category).otherwise(out)
    return out


def token_category(variable: Column, value: Column, hint: Column) -> Column:
    """Theme hint, else the name's rule, else colour by value, else ``other``."""
    by_name = F.lit(None).cast("string")
    for rule, category in reversed(NAME_RULES):
        by_name = F.when(variable.rlike(rule), category).otherwise(by_name)
    return F.coalesce(hint, by_name, F.when(value.rlike(COLOR_VALUE), "color"), F.lit("other"))


def var_reference(value: Column) -> Column:
    """The variable of a value that is one ``var(--x)``; empty otherwise."""
    return F.regexp_extract(value, r"^var\(\s*(--[A-Za-z0-9_-]+)\s*\)$", 1)

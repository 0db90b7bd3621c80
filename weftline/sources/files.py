"""Source files: discovery by globs, languages, byte ranges, the append-only call log."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which files a scan takes and leaves.
SCAN_INCLUDE = ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx")
SCAN_EXCLUDE = (
    "node_modules/**", ".git/**", "dist/**", "build/**", ".next/**", "coverage/**", "out/**", ".vscode/**",
    "**/*.test.*", "**/*.spec.*", "**/*.stories.*", "**/*.story.*", "__tests__/**", "**/__tests__/**", "**/__mocks__/**", "**/__snapshots__/**",
)
WORKSPACE_EXCLUDE = ("node_modules/**", ".git/**", "dist/**", "build/**", ".vscode/**", "coverage/**", "out/**", ".next/**")
LANGUAGES = {"ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript"}
WATCHED = ("ts", "tsx", "js", "jsx")


def glob_regex(glob: str) -> str:
    """Regular expression of a path glob: ``**/`` any folders, ``*`` and ``?`` within one name, ``{a,b}``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"invalid glob: {glob}")
    return f"^{out}$"


def globs_match(path: Column, globs: tuple[str, ...]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def discover(spark: SparkSession, root: str, include: tuple[str, ...] = SCAN_INCLUDE, exclude: tuple[str, ...] = SCAN_EXCLUDE) -> DataFrame:
    """Files under ``root``: ``path`` relative to it and binary ``content``, ascending by path.

    A file counts if an include glob matches (any file does when there are none) and no exclude
    glob does; files without a match are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^.*?" + re.escape(folder), "")
    rows = files.select(relative.alias("path"), "content")
    wanted = globs_match(F.col("path"), include) if include else F.lit(True)
    return rows.where(wanted & ~globs_match(F.col("path"), exclude)).orderBy("path")


def discover_workspace(spark: SparkSession, root: str) -> DataFrame:
    """Files that the symbol index takes: tests and stories count, unlike in a catalog scan."""
    return discover(spark, root, SCAN_INCLUDE, WORKSPACE_EXCLUDE)


def discover_css(spark: SparkSession, root: str, exclude: tuple[str, ...] = SCAN_EXCLUDE) -> DataFrame:
    return discover(spark, root, (), exclude).where(F.lower("path").endswith(".css"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """TypeScript or JavaScript by extension, any case; else Unknown."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(known[extension(path)], F.lit("Unknown"))


def watched_language(path: Column) -> Column:
    """The narrower, case-sensitive test of the change feed."""
    return F.when(F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*WATCHED), language(path)).otherwise("Unknown")


def byte_range(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a file as text; (0, 0) is the whole file; a range outside the file is an error."""
    size = F.octet_length(content)
    whole = (start == 0) & (end == 0)
    wrong = ~whole & ((end <= start) | (end > size) | (start < 0))
    part = F.substring(content, start.cast("int") + 1, (end - start).cast("int"))
    return F.when(wrong, F.raise_error(F.lit("byte range outside the file"))).otherwise(F.decode(F.when(whole, content).otherwise(part), "UTF-8"))


def append_calls(calls: DataFrame, path: str) -> None:
    """Append call records to a JSON-lines log."""
    calls.write.mode("append").json(path)

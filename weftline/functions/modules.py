"""Facts of TypeScript and JavaScript modules, by DataFrame operations over their text.

Imports, exports and what makes a component are read from statements at the start of a line; comments that stand
on lines of their own are no code. Symbols, props and variants come from tokens (``declarations``). Every
table carries ``path`` and ``pos``, the order in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.functions.declarations import inline_props, interface_props, siblings, symbol_names, symbols, variant_sets  # noqa: F401
from weftline.functions.text import is_external, literal_type, unquoted
from weftline.sources.files import language

def code_of(content: Column) -> Column:
    """Text without whole-line comments and plain block comments; documentation comments stay."""
    text = F.coalesce(content, F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]*//[^\n]*", ""), r"(?m)^[ \t]*/\*(?!\*)(?:[^*]|\*(?!/))*+\*/[ \t]*$", "")


def _all(rows: DataFrame, pattern: str, groups: dict[str, int], col: str = "code") -> DataFrame:
    """All matches of a pattern in order, its groups as columns."""
    found = rows.select("path", F.posexplode(F.regexp_extract_all(col, F.lit(pattern), 0)).alias("pos", "_m"))
    return found.select("path", "pos", *(F.regexp_extract("_m", pattern, n).alias(name) for name, n in groups.items()))


def file_status(files: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Whether each file can be indexed: ``path, language, indexed, failure``; the failure says why not, or is ``''``.

    A file fails where its language is unknown, it has no content, or its bytes are no UTF-8. ``seen`` observes the counts
    ``discovered`` and ``failed`` when the rows are read, without a job of its own.
    """
    kind = language(F.col("path"))
    broken = ~F.is_valid_utf8("content") if dict(files.dtypes)["content"] == "binary" else F.lit(False)
    failure = F.when(kind == "Unknown", "unknown language").when(F.col("content").isNull(), "no content").when(broken, "no UTF-8").otherwise("")
    rows = files.select("path", kind.alias("language"), failure.alias("failure")).select("path", "language", (F.col("failure") == "").alias("indexed"), "failure")
    return rows if seen is None else rows.observe(seen, F.count("*").alias("discovered"), F.count_if(~F.col("indexed")).alias("failed"))


def modules(files: DataFrame) -> DataFrame:
    """``path, language, raw, code, markup`` of files with a known language; ``content`` may be binary or text.

    ``code`` is the text without comment lines; ``markup`` says whether the language has elements.
    """
    text = F.coalesce(F.decode("content", "UTF-8") if dict(files.dtypes)["content"] == "binary" else F.col("content"), F.lit(""))
    markup = ~F.col("path").rlike(r"\.[mc]?ts$")
    return files.select("path", language(F.col("path")).alias("language"), text.alias("raw"), code_of(text).alias("code"), markup.alias("markup")).where("language <> 'Unknown'")


def module_imports(rows: DataFrame) -> DataFrame:
    """ES and CommonJS imports: ``path, pos, source, imported, type, is_external``.

    One row an ES statement, its names unread; ``imported`` maps local to exported names for
    CommonJS: the whole module as ``*``, destructured names each in a row, a member as itself.
    """
    es = _all(rows, r"(?m)^\s*import\b[^\"';]*[\"']([^\"']+)[\"']", {"source": 1})
    none = F.create_map().cast("map<string,string>")
    named = es.select("path", "pos", "source", none.alias("imported"), F.lit("named").alias("type"))
    required = _all(rows.where("language = 'JavaScript'"), r"(?m)^\s*(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\(\s*[\"']([^\"']+)[\"']\s*\)(\.[\w$]+)?", {"whole": 1, "parts": 2, "source": 3, "member": 4})
    at = F.col("pos") + 100_000
    whole = required.where("whole <> ''").select(
        "path", at.alias("pos"), "source", F.create_map("whole", F.when(F.col("member") != "", F.col("whole")).otherwise("*")).alias("imported"),
        F.when(F.col("member") != "", "named").otherwise("namespace").alias("type"),
    )
    parts = required.where("parts <> ''").select("path", at.alias("pos"), "source", F.explode(F.split("parts", ",")).alias("_p")).where("trim(_p) <> ''")
    local = F.trim("_p")
    each = parts.select("path", "pos", "source", F.when(F.contains("_p", F.lit(":")), none).otherwise(F.create_map(local, local)).alias("imported"), F.lit("named").alias("type"))
    return named.unionByName(whole).unionByName(each).withColumn("is_external", is_external(F.col("source")))


def module_exports(rows: DataFrame) -> DataFrame:
    """Exports: ``path, pos, name, type, kind``: declarations, lists, defaults and CommonJS assignments."""
    declared = _all(rows, r"(?m)^export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|const|let|var|interface|type|enum)\s+([\w$]+)", {"kind": 1, "name": 2})
    lists = _all(rows, r"(?m)^export\s*(?:type\s*)?\{([^}]*)\}", {"parts": 1}).select("path", "pos", F.explode(F.split("parts", ",")).alias("_p"))
    defaults = _all(rows, r"(?m)^export\s+default\s+(?!function|class|async|abstract|interface)([\w$]+)", {"_ident": 1})
    js = rows.where("language = 'JavaScript'")
    whole = _all(js, r"(?m)^module\.exports\s*=\s*([\w$]+)", {"_ident": 1})
    parts = _all(js, r"(?m)^module\.exports\s*=\s*\{([^}]*)\}", {"parts": 1}).select("path", "pos", F.explode(F.split("parts", ",")).alias("_p"))
    members = _all(js, r"(?m)^(?:module\.)?exports\.([\w$]+)\s*=", {"name": 1})

    def rows_of(found: DataFrame, name: Column, kind: str, base: int, of: Column | None = None) -> DataFrame:
        return found.select("path", (F.col("pos") + base).alias("pos"), name.alias("name"), F.lit(kind).alias("type"), (of if of is not None else F.lit("")).alias("kind"))

    listed = F.regexp_extract("_p", r"^\s*(?:type\s+)?([\w$]+)", 1)
    out = [
        rows_of(declared, F.col("name"), "named", 0, F.col("kind")), rows_of(lists, listed, "named", 100_000), rows_of(defaults, F.lit("default"), "default", 200_000),
        rows_of(whole, F.lit("default"), "default", 300_000), rows_of(parts, listed, "named", 400_000), rows_of(members, F.col("name"), "named", 500_000),
    ]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.where("name <> ''")


def type_annotations(rows: DataFrame) -> DataFrame:
    """Variables, parameters and fields with their type: ``path, name, type``; a generic gives its first argument.

    Of equal names in a file the last annotation counts.
    """
    pattern = r"([\w$]+)\??\s*:\s*([A-Za-z_$][\w$.]*)(?:<\s*([A-Za-z_$][\w$.]*))?|([\w$]+)\s*=\s*[^;=\n]*?\bas\s+([A-Za-z_$][\w$.]*)"
    found = _all(rows.where("language = 'TypeScript'"), rf"(?:const|let|var|[(,]|(?:(?:private|public|protected|readonly|static|override|declare)\s+)+)\s*{pattern}", {"a": 1, "base": 2, "arg": 3, "b": 4, "cast": 5})
    kind = F.when(F.col("cast") != "", F.col("cast")).when(F.col("arg") != "", F.col("arg")).otherwise(F.col("base"))
    named = found.select("path", "pos", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b")).alias("name"), kind.alias("type"))
    return named.groupBy("path", "name").agg(F.max_by("type", "pos").alias("type"))


def component_facts(rows: DataFrame) -> DataFrame:
    """What classifies a declaration as a component: ``path, pos, name, word, callee, has_jsx, heritage, props_type, body``.

    A declaration's text reaches to the next top-level statement.
    """
    start = r"(?m)^(?=(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum|export)\b)"
    statements = rows.select("path", F.posexplode(F.split("code", start)).alias("pos", "body"))
    head = r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|const|let|var|interface|type|enum)\s+([\w$]+)"
    part = lambda pattern, n: F.regexp_extract("body", pattern, n)
    jsx = F.col("body").rlike(r"<(?:[A-Za-z][\w.]*(?:\s[^<>]*)?/?>|>)") & F.col("body").rlike(r"</|/>")
    callee = part(r"=\s*((?:React\.)?(?:forwardRef|memo))\b", 1)
    forwarded = part(r"forwardRef\s*<[^,<>]+,\s*([\w$]+)", 1)
    param = part(r"(?:function\s*[\w$]*\s*|=\s*(?:async\s*)?|forwardRef\s*(?:<[^>]*>)?\(\s*(?:function\s*[\w$]*)?|memo\s*(?:<[^>]*>)?\(\s*(?:function\s*[\w$]*)?)\((?:\{[^}]*\}|[\w$]+)\s*:\s*([\w$]+)", 1)
    heritage = part(r"^[^{]*\bextends\s+([^{]*)\{", 1)
    facts = statements.select(
        "path", "pos", part(head, 2).alias("name"), part(head, 1).alias("word"), F.regexp_replace(callee, r"^React\.", "").alias("callee"), jsx.alias("has_jsx"), F.trim(heritage).alias("heritage"),
        F.when(forwarded != "", forwarded).when(F.regexp_extract("body", head, 1) == "class", part(r"extends\s+[\w$.]+<\s*([\w$]+)", 1)).otherwise(param).alias("props_type"), "body",
    )
    return facts.where("name <> ''")


def props_heads(rows: DataFrame) -> DataFrame:
    """What interfaces and types extend or join before their body: ``path, owner, head``, the first of equal names."""
    found = _all(rows, r"(?m)^(?:export\s+)?(?:interface|type)\s+([\w$]+)([^{;]*)", {"owner": 1, "head": 2})
    return found.groupBy("path", "owner").agg(F.min_by("head", "pos").alias("head"))


def destructured_defaults(facts: DataFrame) -> DataFrame:
    """Parameters taken apart in a component's head: ``path, component, pos, name, default``; rest parameters are skipped."""
    head = F.regexp_extract("body", r"\(\s*\{([^}]*)\}", 1)
    parts = facts.select("path", F.col("name").alias("component"), F.posexplode(F.split(head, ",")).alias("pos", "_p"))
    name = F.regexp_extract("_p", r"^\s*([\w$]+)", 1)
    default = F.trim(F.regexp_extract("_p", r"=\s*([\s\S]*)$", 1))
    return parts.select("path", "component", "pos", name.alias("name"), unquoted(default).alias("default"), literal_type(default).alias("default_type")).where("name <> ''")

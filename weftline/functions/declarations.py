"""Declarations of TypeScript and JavaScript modules: symbols with scopes, locations and signatures, props with types and comments.

All is derived from a module's tokens (``lexical``), which are linked to those beside them in the same bracket, to the next
brackets and to the end of their statement. A bracket's contents are no neighbours of what stands around it, so nothing here
depends on how deep it is nested. Only words that may declare something become rows; what stands inside parameter lists and
bodies is split at separators within the module's row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lexical import GOES_ON, with_tokens
from weftline.functions.text import literal_type, unquoted
from weftline.sources.kept import joined, kept

KINDS = {"function": "function", "class": "class", "const": "variable", "let": "variable", "var": "variable", "interface": "interface", "type": "type", "enum": "enum", "namespace": "namespace", "module": "namespace"}
#: Words that change what follows them.
SCOPES, MODIFIERS = ("public", "private", "protected"), ("static", "async", "readonly", "abstract", "override", "const")
_PREFIXES = (*SCOPES, *MODIFIERS, "get", "set", "declare", "export", "default", "*")


def siblings(rows: DataFrame) -> DataFrame:
    """``modules`` with ``_tokens``, ``_links``, ``_braces`` and their text, read once and kept."""
    return kept(with_tokens(rows, "raw", "markup", "path", "language", "raw"))


def linked_words(rows: DataFrame) -> DataFrame:
    """``siblings`` without ``_tokens``: the words that may declare something are far fewer."""
    return kept(with_tokens(rows, "raw", "markup", "path", "language", "raw", tokens=False))


def _at(place: Column) -> Column:
    """The module's token at a place, null if there is none."""
    return F.get("_tokens", place)


def _held(place: Column) -> Column:
    """Places of the tokens that stand in the bracket at a place; one that is never closed reaches to the end."""
    mate = _at(place)["mate"]
    last = F.when(mate >= 0, mate - 1).otherwise(F.size("_tokens") - 1)
    within = F.when(last > place, F.sequence(place + 1, last)).otherwise(F.array().cast("array<int>"))
    return F.filter(within, lambda i: _at(i)["up"] == place)


def _contents(place: Column) -> Column:
    """The tokens in the bracket at a place, with what splits and names signatures."""
    fields = ("seq", "kind", "text", "at", "to", "angle", "comment")
    starts = lambda t: t["begins"] | F.coalesce((_at(t["prev"])["text"] == ",") & (t["angle"] == 0), F.lit(False))
    return F.transform(_held(place), lambda i: F.struct(*(_at(i)[c].alias(c) for c in fields), starts(_at(i)).alias("starts")))


def _words(tokens: DataFrame) -> DataFrame:
    """A row for each word that may declare something, ``path, language, raw`` and ``lexical.LINK``'s fields."""
    return tokens.select("path", "language", "raw", F.explode_outer("_links").alias("_x")).where("_x is not null").select("path", "language", "raw", "_x.*")


def _with_blocks(tokens: DataFrame, words: Sequence[str], blocks: Callable[[Column], Column]) -> DataFrame:
    """``_words`` of a list, with ``blocks``, what the function makes of the word's token.

    ``explode_outer`` keeps Spark from making all of it a second time, to test the array's size.
    """
    found = F.transform(F.filter("_links", lambda x: x["text"].isin(*words)), lambda x: F.struct(x.alias("word"), blocks(_at(x["seq"])).alias("blocks")))
    return tokens.select("path", "language", "raw", F.explode_outer(found).alias("_x")).where("_x is not null").select("path", "language", "raw", "_x.word.*", "_x.blocks")


def _heads(tokens: DataFrame, words: Sequence[str] = tuple(KINDS), blocks: Callable[[Column], Column] | None = None) -> DataFrame:
    """Words that declare a name, with ``word``, ``name`` (a token), ``kind_of``, and the statement's ``body`` or null; ``blocks`` as in ``_with_blocks``."""
    text, after = F.col("text"), F.col("a2.text")
    star = (text == "function") & (F.col("a1.text") == "*")
    name = F.when(star, F.col("a2")).otherwise(F.col("a1"))
    fits = (
        F.when(text == "class", ~F.col("a1.text").isin("extends", "implements")).when(text == "interface", after.isin("{", "extends", "<")).when(text == "type", after.isin("=", "<"))
        .when(text == "enum", after == "{").when(text.isin("namespace", "module"), after.isin("{", ".")).when(text.isin("const", "let", "var"), F.col("a1.text") != "enum").otherwise(F.lit(True))
    )
    statement = F.col("b1").isNull() | ~F.col("b1.text").isin(*GOES_ON) | (F.col("begins") & (F.col("b1.text") != "."))
    found = _words(tokens).where(text.isin(*words)) if blocks is None else _with_blocks(tokens, words, blocks)
    found = found.withColumn("name", name).where((F.col("name.kind") == "w") & fits & statement)
    value = (after == "=") & ~star
    function = value & ((F.col("a3.text") == "function") | ((F.col("a3.text") == "async") & (F.col("a4.text") == "function")))
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    kind_of = F.when((kinds[text] == "variable") & function, "function").when((kinds[text] == "variable") & value & (F.col("a3.text") == "class") & (F.col("language") == "JavaScript"), "class").otherwise(kinds[text])
    own_body = F.when(~text.isin("const", "let", "var", "type") & (F.col("body.seq") < F.coalesce("stop.seq", F.lit(2**31 - 1))), F.col("body"))
    return found.select("*", text.alias("word"), kind_of.alias("kind_of"), own_body.alias("own_body"))


def _full_name() -> Column:
    """A head's name; a namespace's may have two parts."""
    dotted = F.col("word").isin("namespace", "module") & (F.col("a2.text") == ".")
    return F.when(dotted, F.concat("name.text", F.lit("."), "a3.text")).otherwise(F.col("name.text"))


def _further(tokens: DataFrame) -> DataFrame:
    """Names behind a comma in a statement of ``const``, ``let`` or ``var``."""
    found = _words(tokens).where("b1.text = ','").where("leads.text in ('const', 'let', 'var') and angle = 0").where(F.col("a1").isNull() | F.col("a1.text").isin("=", ":", ",", ";"))
    function = (F.col("a1.text") == "=") & ((F.col("a2.text") == "function") | ((F.col("a2.text") == "async") & (F.col("a3.text") == "function")))
    return found.select("*", F.when(function, "function").otherwise("variable").alias("kind_of"), F.lit(None).cast(dict(found.dtypes)["body"]).alias("own_body"))


def _members(tokens: DataFrame) -> DataFrame:
    """Methods and fields of classes, and of JavaScript's objects the methods and functions."""
    prefixed = F.col("b1").isNull() | F.col("begins") | F.col("b1.text").isin(";", "}", ",", *_PREFIXES)
    words = _words(tokens).where("up >= 0 and followed")
    method = F.col("a1.text").isin("(", "<") & F.col("paren").isNotNull()
    in_class = words.where("in_class").where(prefixed).where(F.col("a1").isNull() | F.col("a1.text").isin("(", "<", ":", "=", "?", "!", ";") | F.coalesce(F.col("a1.line") > F.col("line"), F.lit(False)))
    in_class = in_class.where(~F.col("text").isin("static", "readonly") | F.col("a1.text").isin("(", ":", "=")).where((F.col("b1").isNull()) | (F.col("b1.text") != ",")).withColumn(
        "kind_of", F.when(method, "method").when((F.col("a1.text") == "=") & (F.col("a2.text") == "class"), "class").otherwise("field")
    )
    key = (F.col("a1.text") == ":") & (F.col("a2.text").isin("function", "async") | ((F.col("a2.text") == "(") & (F.col("a4.text") == "=>")) | ((F.col("a2.kind") == "w") & (F.col("a3.text") == "=>")))
    in_object = words.where("language = 'JavaScript' and not in_class").where(prefixed).where((key | ((F.col("a1.text") == "(") & (F.col("a3.text") == "{"))) & (F.col("b1").isNull() | F.col("b1.text").isin(",", "async", "get", "set", "*")))
    in_object = in_object.where(~F.col("text").isin("if", "for", "while", "switch", "catch", "function", "return"))
    both = in_class.unionByName(in_object.withColumn("kind_of", F.when(F.col("a1.text") == ":", "function").otherwise("method")))
    has_body = F.col("kind_of").isin("method", "class") & (F.col("body.seq") < F.coalesce("stop.seq", F.lit(2**31 - 1)))
    return both.select("*", F.when(has_body, F.col("body")).alias("own_body"))


def _place(token: str | None = None) -> Column:
    """Where a token starts; without a name the row's own."""
    return F.struct(*(F.col(f"{token}.{c}" if token else c).alias(c) for c in ("at", "line", "column")))


def _modifiers() -> tuple[Column, Column]:
    """Words in front of a name without a break between, in order; and the first of them as a token, or null."""
    run = [F.coalesce(F.col("b1.text").isin(*_PREFIXES), F.lit(False))]
    for n in (2, 3, 4):
        run.append(run[-1] & F.coalesce(F.col(f"b{n}.text").isin(*_PREFIXES), F.lit(False)))
    words = F.filter(F.array(*(F.when(run[n - 1], F.col(f"b{n}.text")) for n in (4, 3, 2, 1))), lambda w: w.isNotNull())
    return words, F.coalesce(*(F.when(run[n - 1] & ~F.col(f"b{n}.text").isin("export", "default", "declare"), _place(f"b{n}")) for n in (4, 3, 2, 1)))


def _scope_names(tokens: DataFrame, heads: DataFrame) -> DataFrame:
    """Full names of scopes: ``path, scope`` (the brace) and ``outer``, the names of all that are open there."""
    names = heads.where("word in ('class', 'interface', 'namespace', 'module') and own_body is not null").select("path", F.col("own_body.seq").alias("_s"), _full_name().alias("_name"))
    braces = tokens.select("path", F.explode("_braces").alias("_t"))
    chains = braces.select("path", "_t.scope", F.explode("_t.scopes").alias("_s"))
    ordered = joined(chains, names, ["path", "_s"]).groupBy("path", "scope").agg(F.sort_array(F.collect_list(F.struct("_s", "_name"))).alias("_n"))
    return ordered.select("path", "scope", F.array_join(F.transform("_n", lambda x: x["_name"]), ".").alias("outer"))


def _cut(at: Column, to: Column) -> Column:
    """Text between two offsets in bytes of the module's text."""
    return F.trim(F.regexp_replace(F.decode(F.substring(F.encode("raw", "UTF-8"), at + 1, to - at), "UTF-8"), r"^\s+|\s+$", ""))


def _exported() -> Column:
    """Whether an export stands next to a declaration's name."""
    return F.array_contains("_words", "export") & (F.col("word") != "") & ~F.col("word").isin("const", "let", "var")


def symbol_names(rows: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """What ``symbols`` finds, by ``path, name, kind, is_exported`` alone, without a shuffle."""
    tokens = linked_words(rows) if tokens is None else tokens
    words, _ = _modifiers()
    heads = _heads(tokens).select("path", _full_name().alias("name"), F.col("kind_of").alias("kind"), words.alias("_words"), "word")
    plain = lambda found: found.select("path", F.col("text").alias("name"), F.col("kind_of").alias("kind"), F.lit(False).alias("is_exported"))
    return heads.select("path", "name", "kind", _exported().alias("is_exported")).unionByName(plain(_members(tokens))).unionByName(plain(_further(tokens)))


def symbols(rows: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Declarations at any depth and members of classes.

    ``path, pos, name, fqn, kind, scope, modifiers, is_exported, parameters, parameter_types, return_type, start_line,
    start_column, end_line, end_column, start_byte, end_byte``. ``fqn`` has the enclosing classes, interfaces and namespaces.
    Locations are those of the whole declaration: lines and columns from 1, bytes from 0, the end exclusive. Parameters
    and return types are those of TypeScript's functions and methods; untyped ones have ``''``. ``export const`` is
    no exported symbol, as its export statement is not next to the name; functions, classes and types are.
    """
    tokens = linked_words(rows) if tokens is None else tokens
    heads = _heads(tokens)
    words, start = _modifiers()
    shared = ("path", "language", "raw", "seq", "scope", "kind_of", "own_body", "stop", "last")
    lists = lambda has: (F.when(has, F.col("paren")).alias("paren"), F.when(has, F.col("parameters")).alias("_p"))
    declared = heads.select(*shared, _full_name().alias("name"), F.coalesce(start, _place()).alias("_start"), words.alias("_words"), *lists(F.col("word") == "function"), F.col("word"))
    further = _further(tokens).select(*shared, F.col("text").alias("name"), _place("leads").alias("_start"), F.array().cast("array<string>").alias("_words"), *lists(F.lit(False)), F.col("leads.text").alias("word"))
    members = _members(tokens).select(*shared, F.col("text").alias("name"), F.coalesce(start, _place()).alias("_start"), words.alias("_words"), *lists(F.col("kind_of") == "method"), F.lit("").alias("word"))
    end = F.struct(*(F.coalesce(F.col(f"own_body.{c}"), F.col(f"stop.{c}"), F.col(f"last.{c}")).alias(c) for c in ("to", "line", "column")))
    typescript = F.col("language") == "TypeScript"
    returns = F.when(typescript & (F.col("paren.next") == ":"), _cut(F.col("paren.next_to"), F.coalesce("own_body.at", "stop.at", "last.to")))
    none = F.array().cast("array<string>")
    bare = lambda p: F.regexp_replace(_cut(p["at"], p["to"]), r"^(?:(?:public|private|protected|readonly|override)\s+)+", "")
    modifiers = F.concat(F.filter("_words", lambda w: w.isin(*MODIFIERS)), F.when(F.col("word") == "const", F.array(F.lit("const"))).otherwise(none))
    parameters = F.when(typescript, F.col("_p"))
    # All texts are cut from the module within its row, so none of it is shuffled.
    found = declared.unionByName(members).unionByName(further).select(
        "path", F.col("scope").alias("_scope"), F.col("seq").alias("pos"), "name", F.col("kind_of").alias("kind"),
        F.coalesce(F.get(F.filter("_words", lambda w: w.isin(*SCOPES)), F.lit(0)), F.lit("")).alias("scope"), modifiers.alias("modifiers"), _exported().alias("is_exported"),
        F.coalesce(F.transform(parameters, bare), none).alias("parameters"), F.coalesce(F.transform(parameters, lambda p: F.coalesce(_cut(p["type_at"], p["type_to"]), F.lit(""))), none).alias("parameter_types"),
        F.coalesce(returns, F.lit("")).alias("return_type"), F.col("_start.line").alias("start_line"), F.col("_start.column").alias("start_column"), end["line"].alias("end_line"), end["column"].alias("end_column"),
        F.col("_start.at").alias("start_byte"), end["to"].alias("end_byte"),
    )
    named = joined(found, _scope_names(tokens, heads).withColumnRenamed("scope", "_scope"), ["path", "_scope"], "left")
    fields = found.columns
    return named.select("path", "pos", "name", F.concat_ws(".", "outer", "name").alias("fqn"), *(c for c in fields if c not in ("path", "_scope", "pos", "name")))


def _signatures(owners: DataFrame) -> DataFrame:
    """Property signatures in ``owners(path, raw, owner, blocks)``: ``path, raw, owner, first, name, required, comment`` and ``parts``, the type's tokens.

    Signatures are split within the owner's row, so that no token is shuffled. ``explode_outer`` keeps Spark from testing an array's
    size before it is made, which would make it twice, and once more for each of its elements.
    """
    blocks = owners.select("path", "raw", "owner", F.explode_outer("blocks").alias("_b"))
    places = F.when(F.size("_b") > 0, F.sequence(F.lit(0), F.size("_b") - 1)).otherwise(F.array().cast("array<int>"))
    begun = blocks.select("*", F.filter(places, lambda i: F.get("_b", i)["starts"]).alias("_starts"))
    to = lambda n: F.coalesce(F.get("_starts", n + 1), F.size("_b")) - 1
    separator = lambda t: t["text"].isin(";", ",") & (t["angle"] == 0)
    split = F.transform("_starts", lambda at, n: F.filter(F.transform(F.sequence(at, to(n)), lambda i: F.get("_b", i)), lambda t: ~separator(t)))
    each = begun.select("path", "raw", "owner", F.explode_outer(split).alias("_t")).where("size(_t) > 0")
    head = F.get("_t", F.lit(0))
    readonly = (head["text"] == "readonly") & F.coalesce(F.get("_t", F.lit(1))["kind"].isin("w", "s"), F.lit(False))
    bare = each.select("path", "raw", "owner", head["seq"].alias("first"), head["comment"].alias("comment"), F.when(readonly, F.slice("_t", 2, 1 << 30)).otherwise(F.col("_t")).alias("_t"))
    optional = F.coalesce(F.get("_t", F.lit(1))["text"] == "?", F.lit(False))
    colon = F.when(optional, F.get("_t", F.lit(2))["text"]).otherwise(F.get("_t", F.lit(1))["text"])
    named = bare.where(F.get("_t", F.lit(0))["kind"].isin("w", "s") & (colon == ":"))
    return named.select("path", "raw", "owner", "first", "comment", unquoted(F.get("_t", F.lit(0))["text"]).alias("name"), (~optional).alias("required"), F.slice("_t", F.when(optional, 4).otherwise(3), F.lit(1 << 30)).alias("parts"))


def described(comment: Column) -> tuple[Column, Column]:
    """Description and whether it is deprecated, of a documentation or line comment; plain block comments say nothing.

    Text behind ``@deprecated`` belongs to the description, lines of other tags do not.
    """
    line = comment.startswith("//")
    text = F.trim(F.substring(comment, 3, 1 << 30))
    lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(comment, r"^/\*\*", ""), r"\*/$", ""), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*", "")))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    told = F.filter(F.transform(lines, lambda x: F.when(x.startswith("@deprecated"), F.trim(F.substring(x, 12, 1 << 30))).when(x.startswith("@"), "").otherwise(x)), lambda x: x != "")
    block = F.array_join(told, " ")
    deprecated = F.when(line, text.contains("@deprecated")).when(comment.startswith("/**"), F.exists(lines, lambda x: x.startswith("@deprecated"))).otherwise(False)
    said = F.when(line, F.trim(F.regexp_replace(text, r"^([\s\S]*?)@deprecated", "$1"))).when(comment.startswith("/**"), block).otherwise("")
    return F.coalesce(said, F.lit("")), F.coalesce(deprecated, F.lit(False))


def resolved(parts: Column, text: Column) -> tuple[Column, Column]:
    """Name and allowed values of a type, from its tokens outside of inner brackets and its text.

    A union of string literals is ``string``, of other literals ``union``, both with values; functions, arrays,
    tuples and objects go by kind, generics by name, names of React without it; the rest stays as written.
    """
    no_values = F.array().cast("array<string>")
    bare = F.when(F.get(parts, F.lit(0))["text"] == "|", F.slice(parts, 2, 1 << 30)).otherwise(parts)
    texts = F.transform(bare, lambda t: t["text"])
    top = F.transform(bare, lambda t: F.when(t["angle"] == 0, t["text"]).otherwise(""))
    bar, arrow = F.array_position(top, "|"), F.array_position(top, "=>")
    is_union = (bar > 0) & ((arrow == 0) | (bar < arrow))
    glue = "\x01"
    members = F.split(F.array_join(F.transform(bare, lambda t: F.when((t["text"] == "|") & (t["angle"] == 0), F.lit(glue)).otherwise(t["text"])), ""), glue)
    quoted = lambda m: m.rlike("^([\"'])[^\"']*\\1$")
    literal = lambda m: quoted(m) | m.rlike(r"^-?\d[\w.]*$") | m.isin("true", "false", "null", "undefined")
    strings, literals = is_union & F.forall(members, quoted), is_union & F.forall(members, literal)
    values = F.when(literals, F.transform(members, lambda m: F.when(quoted(m), unquoted(m)).otherwise(m))).otherwise(no_values)
    inner = F.regexp_replace(text, r"^\(\s*|\s*\)$", "")
    inner_members = F.transform(F.split(inner, r"\s*\|\s*"), F.trim)
    alone = F.size(bare) == 1
    closing = F.element_at(bare, -1)
    is_array = (F.size(bare) > 2) & (closing["text"] == "]") & (F.element_at(bare, F.greatest(-F.size(bare), F.lit(-2)))["to"] == closing["at"])
    generic = F.array_position(texts, "<")
    name = F.array_join(F.slice(texts, 1, F.greatest(generic.cast("int") - 1, F.lit(1))), "")
    first = F.get(texts, F.lit(0))
    wrapped = (F.size(bare) == 2) & (first == "(")
    kind = (
        F.when(strings, "string").when(literals, "union").when(is_union, text).when(arrow > 0, "function").when(F.array_contains(top, "&"), text)
        .when(is_array, "array").when((F.size(bare) == 2) & (first == "["), "tuple").when((F.size(bare) == 2) & (first == "{"), "object")
        .when(wrapped & (F.size(inner_members) > 1) & F.forall(inner_members, quoted), "string").when(wrapped & inner.contains("=>"), "function").when(wrapped, inner)
        .when(alone & (F.get(bare, F.lit(0))["kind"] == "s") | alone & literal(first), literal_type(first))
        .when((generic > 1) & (closing["text"] == ">"), F.when(name.isin("React.ReactNode", "React.ReactElement"), F.regexp_replace(name, r"^React\.", "")).otherwise(name))
        .when(text.rlike(r"^React\.[\w.]+$"), F.regexp_replace(text, r"^React\.", "")).otherwise(text)
    )
    return kind, F.when(wrapped & (F.size(inner_members) > 1) & F.forall(inner_members, quoted), F.transform(inner_members, unquoted)).otherwise(values)


def _props(owners: DataFrame) -> DataFrame:
    """Props of ``owners(path, raw, owner, blocks)`` in order; a block that two heads of one name share counts once."""
    order = Window.partitionBy("path", "owner").orderBy("first")
    found = _signatures(owners).withColumn("_text", _cut(F.get("parts", F.lit(0))["at"], F.element_at("parts", -1)["to"])).drop("raw")
    placed = found.select("*", (F.dense_rank().over(order) - 1).alias("pos"), F.lag("first").over(order).alias("_before")).where("not first <=> _before and size(parts) > 0")
    description, deprecated = described(F.col("comment"))
    kind, values = resolved(F.col("parts"), F.col("_text"))
    return placed.select("path", "owner", "pos", "name", kind.alias("type"), "required", description.alias("description"), deprecated.alias("deprecated"), values.alias("allowed_values"))


def interface_props(rows: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Props of interfaces and object types: ``path, owner, pos, name, type, required, description, deprecated, allowed_values``.

    A prop's comment is the last one before it and behind the prop before. Methods and index signatures are no props.
    """
    tokens = siblings(rows) if tokens is None else tokens
    own = lambda t: F.when((t["block"] >= 0) & ((t["stop"] < 0) | (t["block"] < t["stop"])), F.array(_contents(t["block"])))
    return _props(_heads(tokens, ("interface", "type"), own).select("path", "raw", F.col("name.text").alias("owner"), "blocks"))


def inline_props(rows: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Props of object types written inside the parameters of functions and arrow functions, as in ``interface_props``; ``owner`` is the function."""
    tokens = siblings(rows) if tokens is None else tokens
    typed = lambda i: (_at(i)["text"] == "{") & _at(_at(i)["prev"])["text"].isin(":", "&", "|")
    own = lambda t: F.when(t["paren"] >= 0, F.transform(F.filter(_held(t["paren"]), typed), _contents))
    arrow = F.col("word").isin("const", "let", "var") & (F.col("a2.text") == "=") & F.col("a3.text").isin("(", "async")
    heads = _heads(tokens, ("function", "const", "let", "var"), own).where((F.col("word") == "function") | arrow)
    return _props(heads.select("path", "raw", F.col("name.text").alias("owner"), "blocks"))


def variant_sets(rows: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Variant calls: ``path, pos, variable, name, allowed_values, default``, a row for each variant.

    A key finds the objects around it, their keys and the call by the links of its own token, so keys alone become rows.
    """
    tokens = siblings(rows) if tokens is None else tokens
    before = lambda t: _at(t["prev"])
    is_key = lambda t: t["kind"].isin("w", "s") & (_at(t["next"])["text"] == ":") & F.coalesce(before(t)["text"] == ",", F.lit(True))
    around = lambda t: _at(t["up"])
    key_of = lambda brace: before(before(brace))
    has_key = lambda brace: (brace["text"] == "{") & (before(brace)["text"] == ":") & is_key(key_of(brace))

    def is_options(brace: Column) -> Column:
        """Whether an object is an argument behind the first of a variant call that a variable holds."""
        call = around(brace)
        name = before(before(before(call)))
        word = before(name)
        statement = F.coalesce(~before(word)["text"].isin(*GOES_ON), F.lit(True)) | (word["begins"] & (before(word)["text"] != "."))
        called = (call["text"] == "(") & (before(call)["text"] == "cva") & (before(before(call))["text"] == "=")
        return (brace["text"] == "{") & (before(brace)["text"] == ",") & called & (name["kind"] == "w") & (name["text"] != "enum") & (word["kind"] == "w") & word["text"].isin("const", "let", "var") & statement

    def in_section(t: Column, section: str) -> Column:
        """Whether a key stands in a section of a call's options."""
        return has_key(around(t)) & (unquoted(key_of(around(t))["text"]) == section) & is_options(around(key_of(around(t))))

    def row(t: Column, key: Column, values: list[Column]) -> Column:
        """A key of a section, with its call's variable."""
        call = around(around(key_of(around(key))))
        return F.struct(before(before(before(call)))["text"].alias("variable"), unquoted(key["text"]).alias("name"), *values)

    none = lambda kind: F.lit(None).cast(kind)
    value = lambda t: row(t, key_of(around(t)), [key_of(around(t))["seq"].alias("pos"), t["seq"].alias("at"), unquoted(t["text"]).alias("value"), none("string").alias("default")])
    default = lambda t: row(t, t, [none("int").alias("pos"), t["seq"].alias("at"), none("string").alias("value"), unquoted(_at(_at(t["next"])["next"])["text"]).alias("default")])
    values = F.transform(F.filter("_tokens", lambda t: is_key(t) & has_key(around(t)) & in_section(key_of(around(t)), "variants")), value)
    defaults = F.transform(F.filter("_tokens", lambda t: is_key(t) & in_section(t, "defaultVariants")), default)
    called = tokens.where(F.col("raw").contains("cva"))  # what has no such word has no such call
    each = called.select("path", F.explode_outer(F.concat(values, defaults)).alias("_v")).where("_v is not null").select("path", "_v.*")
    listed = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "at", "value"))))
    named = each.groupBy("path", "variable", "name").agg(listed.alias("_l"), F.max_by("default", F.when(F.col("pos").isNull(), F.col("at"))).alias("default"))
    sets = named.select("path", "variable", "name", "default", "_l", F.explode(F.array_distinct(F.transform("_l", lambda x: x["pos"]))).alias("_pos"))
    allowed = F.transform(F.filter("_l", lambda x: x["pos"] == F.col("_pos")), lambda x: x["value"])
    order = F.row_number().over(Window.partitionBy("path", "variable").orderBy("_pos")) - 1
    return sets.select("path", order.alias("pos"), "variable", "name", allowed.alias("allowed_values"), F.coalesce("default", F.lit("")).alias("default"))

"""Lexical state, scopes, signatures, types and comments."""

import pytest

from weftline.functions import declarations as d
from weftline.functions import jsx
from weftline.functions import modules as m
from weftline.functions.lexical import Scan

SCOPED = '''// class Fake { x() {} }
export namespace N.M {
  export class K<T> extends Base<T> {
    private static count: number = 0;
    static Logger = class { info(x: string): void {} };
    constructor(private readonly a: Map<string, number>, b?: string, ...rest: string[]) { super(); }
    async load<T>(
      { p, q = { z: 1 } }: { p: string; q?: object },
      cb: (x: number, y: string) => void = (x, y) => { run(x < y, y > x); },
    ): Promise<Map<string, T[]>> {
      function inner(z: number) { return `class Q { ${ function deep() {} } }`; }
      const local = 1
      return null;
    }
    get size(): number { return 1 }
  }
}
export async function top(a: number, b = "x"): { r: number } | null {
  class Nested { m() {} }
}
declare function sig(a: string): void;
let two = 2, three = function () {};
'''
SCRIPT = "const obj = { m() { return 1; }, f: function () {}, g: (a) => a, h: 3 };\nfunction* gen() {}\nclass C { go() {} }\nconst D = class {};\nconst E = function () {};\n"
TYPED = """export interface P {
  /** Size in mm.
   * @default 3
   */
  size: number; // trailing note
  brand?: "x" | "none"
  /** @deprecated use brand */
  readonly tone?: 1 | -2 | true;
  mixed: "a" | Foo | { deep: { er: string } };
  // plain @deprecated words
  cb?: (a: Map<string, number>, b: string | number) => void | string;
  list: Array<{ a: string }>; arr: string[]; idx: Foo["bar"]; tup: [a: string, b: number];
  /* ignored */
  node: React.ReactNode; el: React.ReactElement<any>; lit: "one"; paren: ("p" | "q");
  multi:
    | "m"
    | 'n';
  "quoted-name": string,
  method(a: string): void;
  [key: string]: unknown;
  inter: A & { b: string };
}
"""


def pages(spark, *codes):
    return spark.createDataFrame([(1, c) for c in codes], "page_id int, code string")


def modules(spark, **files):
    return m.modules(spark.createDataFrame([(path.replace("_", "."), text) for path, text in files.items()], "path string, content string"))


@pytest.mark.parametrize("depth", [1, 13, 50, 500])
def test_braces_of_any_depth(depth):
    found = Scan(f"return <A x={'{' * depth}1{'}' * depth} y='2'><B/></A>".encode()).elements
    assert [(e["name"], e["up"], e["props"]) for e in found] == [("A", -1, {"x": "", "y": "2"}), ("B", 0, {})]


def test_tags_in_strings_comments_and_values_are_none(spark):
    code = 'const s = "<A/>"; const t = `<B/> ${x ? <C a="1"/> : null}`; // <D/>\nreturn <E f={() => <F>it\'s</F>}>it\'s {"<G/>"} <H/> don\'t</E>'
    rows = jsx.usages(pages(spark, code)).orderBy("pos").collect()
    assert [(r.component_name, r.parent_component, r.line, r.has_children) for r in rows] == [("C", "", 1, False), ("E", "", 2, True), ("H", "E", 2, False)]


def test_pages_of_one_id_do_not_mix(spark):
    rows = jsx.usages(pages(spark, "<D><A/></D>", "<B/>", None)).collect()
    assert {(r.component_name, r.parent_component, r.pos) for r in rows} == {("D", "", 0), ("A", "D", 1), ("B", "", 0)}


@pytest.mark.parametrize("code", [b"<A x=" * 20_000, b"<a b " * 20_000, b"{" * 20_000, b"`${" * 20_000, b"<A>" * 20_000, b"'" * 20_000, b"</A>" * 20_000])
def test_broken_texts_end_soon(code):
    Scan(code)
    Scan(code, tokens=True)


def test_generics_and_comparisons_are_no_tags():
    code = b"function f<T>(x: Array<Foo>) { const g = <T,>(a: T) => a; const h = <T extends X>(a) => a; return a <B && c > d }"
    assert Scan(code).elements == []


def test_scopes_signatures_and_locations(spark):
    rows = {r.fqn: r for r in d.symbols(modules(spark, a_ts=SCOPED)).collect()}
    assert set(rows) == {
        "N.M", "N.M.K", "N.M.K.count", "N.M.K.Logger", "N.M.K.info", "N.M.K.constructor", "N.M.K.load", "N.M.K.inner", "N.M.K.deep", "N.M.K.local", "N.M.K.size", "top", "Nested", "Nested.m", "sig", "two", "three",
    }
    load, text = rows["N.M.K.load"], SCOPED.encode()
    assert load.parameters == ["{ p, q = { z: 1 } }", "cb"] and load.parameter_types == ["{ p: string; q?: object }", "(x: number, y: string) => void"]
    assert load.return_type == "Promise<Map<string, T[]>>" and (load.start_line, load.end_line) == (7, 14) and load.modifiers == ["async"]
    assert text[load.start_byte : load.end_byte].startswith(b"async load<T>(") and text[load.start_byte : load.end_byte].endswith(b"return null;\n    }")
    assert rows["N.M.K.constructor"].parameters == ["a", "b", "...rest"] and rows["N.M.K.count"].scope == "private"
    assert rows["top"].return_type == "{ r: number } | null" and rows["top"].is_exported and rows["top"].parameter_types == ["number", ""]
    assert rows["sig"].return_type == "void" and rows["three"].kind == "function" and rows["N.M.K.Logger"].kind == "class"


def test_symbols_of_scripts(spark):
    rows = {(r.fqn, r.kind) for r in d.symbols(modules(spark, b_js=SCRIPT)).collect()}
    assert rows == {("obj", "variable"), ("m", "method"), ("f", "function"), ("g", "function"), ("gen", "function"), ("C", "class"), ("C.go", "method"), ("D", "class"), ("E", "function")}


def test_types_and_comments(spark):
    rows = {r.name: (r.type, r.required, r.description, r.deprecated, r.allowed_values) for r in d.interface_props(modules(spark, p_tsx=TYPED)).collect()}
    assert rows == {
        "size": ("number", True, "Size in mm.", False, []), "brand": ("string", False, "trailing note", False, ["x", "none"]), "tone": ("union", False, "use brand", True, ["1", "-2", "true"]),
        "mixed": ('"a" | Foo | { deep: { er: string } }', True, "", False, []), "cb": ("function", False, "plain  words", True, []), "list": ("Array", True, "", False, []), "arr": ("array", True, "", False, []),
        "idx": ('Foo["bar"]', True, "", False, []), "tup": ("tuple", True, "", False, []), "node": ("ReactNode", True, "", False, []), "el": ("ReactElement", True, "", False, []), "lit": ("string", True, "", False, []),
        "paren": ("string", True, "", False, ["p", "q"]), "multi": ("string", True, "", False, ["m", "n"]), "quoted-name": ("string", True, "", False, []), "inter": ("A & { b: string }", True, "", False, []),
    }


def test_a_tag_inside_a_line_is_text(spark):
    code = "interface P {\n  /** Old. @deprecated no */\n  a: string;\n  /* @deprecated */\n  b: string;\n  // @deprecated\n  c: string;\n}"
    rows = {r.name: (r.description, r.deprecated) for r in d.interface_props(modules(spark, p_tsx=code)).collect()}
    assert rows == {"a": ("Old. @deprecated no", False), "b": ("", False), "c": ("", True)}


def test_variants_nested_deep(spark):
    code = 'const v = cva("base", { variants: { tone: { soft: ["a", { d: { e: { x: 1 } } }], "k-1": "b" }, size: { sm: "x" } }, compoundVariants: [{ tone: "soft" }], defaultVariants: { tone: "soft" } });'
    rows = [(r.variable, r.name, r.allowed_values, r.default) for r in d.variant_sets(modules(spark, v_tsx=code)).orderBy("pos").collect()]
    assert rows == [("v", "tone", ["soft", "k-1"], "soft"), ("v", "size", ["sm"], "")]


def test_no_modules(spark):
    none = m.modules(spark.createDataFrame([], "path string, content string"))
    assert d.symbols(none).collect() == [] and d.interface_props(none).collect() == []
    assert d.symbols(modules(spark, a_ts="", b_ts=None)).collect() == []


def test_texts_are_scanned_in_slices():
    import pyarrow as pa

    from weftline.functions import lexical

    batch = pa.record_batch([["let a = 1;" * 10_000] * 40 + [None, ""]], ["code"])
    slices = list(lexical._slices(batch))
    assert sum(s.num_rows for s in slices) == 42 and max(sum(len(t or "") for t in s.column(0).to_pylist()) for s in slices) <= lexical.SLICE_BYTES


def test_tokens_of_several_texts_are_those_of_each():
    from weftline.functions.lexical import token_rows

    texts = [SCOPED.encode(), b"", SCRIPT.encode(), TYPED.encode(), b"x\n=\n1"]
    assert token_rows([Scan(t, tokens=True) for t in texts]).to_pylist() == [token_rows([Scan(t, tokens=True)]).to_pylist()[0] for t in texts]


def test_symbols_are_never_broadcast(spark):
    """Their sizes are estimated at one element an array, so a broadcast gathers all modules in the driver."""
    assert "Broadcast" not in m.symbols(modules(spark, a_ts=SCOPED))._jdf.queryExecution().toString()


def test_props_are_found_without_a_join(spark):
    """A join of tokens with their owners made plans whose code filled the driver's memory."""
    rows = modules(spark, a_tsx=TYPED)
    assert all("Join" not in found(rows)._jdf.queryExecution().toString() for found in (d.interface_props, d.inline_props))


def test_a_parameter_list_that_two_heads_of_one_name_share(spark):
    code = "const f = async function f({ a, b }: { a: string; readonly b?: 1 | 2 }) {}\ninterface I { x: string }\nnamespace N { interface I { y: { z: 1 }, w: A<b, c> } }"
    rows = modules(spark, a_tsx=code)
    props = lambda found: sorted((r.owner, r.pos, r.name, r.type, r.required) for r in found(rows).collect())
    assert props(d.inline_props) == [("f", 0, "a", "string", True), ("f", 1, "b", "union", False)]
    assert props(d.interface_props) == [("I", 0, "x", "string", True), ("I", 1, "y", "object", True), ("I", 2, "w", "A", True)]


def test_variants_are_found_by_the_links_of_their_keys(spark):
    code = (
        'const a = cva("b", { variants: { x: { p: "1", "q-r": "2" }, y: { t: "3" } }, defaultVariants: { x: "p" } }, { variants: { z: { u: 1 } } }), b = cva("y", { other: { x: { p: 1 } }, variants: { k: { v: { variants: { n: { m: "" } } } } } });\n'
        'foo(const c = cva("z", { "variants": { t: { w: 1 } } })); const d = other("b", { variants: { x: { p: 1 } } })\nconst e = cva("z", { variants: { a: { b: "c"'
    )
    found = d.variant_sets(modules(spark, v_tsx=code))
    assert "Join" not in found._jdf.queryExecution().toString()
    assert sorted((r.variable, r.pos, r.name, r.allowed_values, r.default) for r in found.collect()) == [
        ("a", 0, "x", ["p", "q-r"], "p"), ("a", 1, "y", ["t"], ""), ("a", 2, "z", ["u"], ""), ("c", 0, "t", ["w"], ""), ("e", 0, "a", ["b"], ""),
    ]


def test_symbols_are_read_once_for_detection(spark):
    """Symbols that two sides of a join read made the plan twice as large, and the driver's memory with it."""
    from weftline.operators.scan import detected

    rows = modules(spark, a_tsx="export function A() { return <b/> }\nfunction B() { return <b/> }\nexport { B, C }\nexport const D = memo(() => <i/>)\nfunction E() { return <b/> }\nexport interface F { a: string }")
    tokens = m.siblings(rows)
    names = m.symbol_names(rows, tokens)
    found = detected(m.component_facts(rows), names, m.module_exports(rows))
    reads = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert reads(found) == reads(names) and sorted(r.name for r in found.collect()) == ["A", "B", "D"]


def test_symbols_read_declaring_words_alone(spark):
    """All tokens of a module, read five times, took most of the time; its text was shuffled to be cut."""
    plan = m.symbols(modules(spark, a_ts=SCOPED))._jdf.queryExecution().executedPlan().toString()
    assert "_tokens" not in plan and plan.count("Exchange hashpartitioning(path") <= 4


def test_parameters_between_commas(spark):
    code = "function f(a?, b: Map<x, y>, c = d ? 1 : 2, { e, g }: { e: string },) {}\nfunction h() {}\nfunction k(z?: number = 1, ...r) {}\nclass L { m(readonly s: string"
    rows = {r.name: (r.parameters, r.parameter_types) for r in d.symbols(modules(spark, a_ts=code)).collect() if r.kind in ("function", "method")}
    assert rows["f"] == (["a", "b", "c", "{ e, g }"], ["", "Map<x, y>", "", "{ e: string }"]) and rows["h"] == ([], []) and rows["k"] == (["z", "...r"], ["number", ""])
    assert rows["m"] == (["s"], ["string"])


def test_heads_with_blocks_are_found_among_linked_words(spark):
    """Links of every token that declares something were made anew from the token array."""
    plan = d.interface_props(modules(spark, a_tsx=TYPED))._jdf.queryExecution().analyzed().toString()
    assert "filter(_links" in plan and "filter(_tokens" not in plan

from datetime import datetime, timedelta

import pytest

from weftline.functions import modules as m
from weftline.functions import text
from weftline.operators import css, scan
from weftline.sources import files
from weftline.streaming import index

BUTTON = """import { cva, type VariantProps } from "class-variance-authority";
const buttonVariants = cva("base", { variants: { variant: { default: "a", "out-line": "b" }, size: { sm: "x", lg: "y" } }, defaultVariants: { variant: "default" } });
export interface ButtonProps extends VariantProps<typeof buttonVariants> {
  /**
   * Label text.
   * @deprecated
   */
  label: string;
  kind?: "a" | "b";
  onClick?: () => void;
}
export function Button({ label, kind = "a", ...rest }: ButtonProps) {
  return <button {...rest}>{label}</button>;
}
"""
DIALOG = """export function Dialog({ open }) { return <div>{open}</div>; }
const DialogTitle = React.forwardRef<HTMLDivElement, TitleProps>((props, ref) => <h1 ref={ref} />);
class DialogFoot extends React.Component<FootProps> {
  private count: number = 0;
}
const hidden = () => <p/>;
export { DialogTitle, DialogFoot };
"""


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("forms/button.tsx", BUTTON), ("dialog.tsx", DIALOG), ("readme.md", "# no")], "path string, content string")


def test_scan_builds_a_catalog(rows):
    built = scan.scan(rows, prefix="@/ui")
    got = {r["name"]: r for r in built.components.collect()}
    assert list(got) == ["Button", "Dialog"] and got["Button"]["import_path"] == "@/ui/forms/button" and got["Button"]["category"] == "forms"
    assert [s["name"] for s in got["Dialog"]["sub_components"]] == ["DialogFoot", "DialogTitle"]
    props = {p["name"]: p for p in got["Button"]["props"]}
    assert props["label"]["required"] and props["label"]["deprecated"] and props["label"]["description"] == "Label text."
    assert props["kind"]["allowed_values"] == ["a", "b"] and props["kind"]["default"] == "a" and props["onClick"]["type"] == "function"
    assert props["variant"]["allowed_values"] == ["default", "out-line"] and props["variant"]["default"] == "default"


def test_enrichment(spark, rows):
    props = spark.createDataFrame([("p", "B", 0, "a", "string", False, "", "", [], False)], "path string, component string, pos int, name string, type string, required boolean, default string, description string, allowed_values array<string>, deprecated boolean")
    report = spark.createDataFrame([("B", 0, "a", "enum", True, "x", "doc", ["x"], True), ("B", 1, "n", "React.ReactNode", False, "", "", [], False)], "component string, pos int, name string, type string, required boolean, default string, description string, allowed_values array<string>, deprecated boolean")
    got = {r["name"]: r for r in scan.enriched(props.drop("path"), report).collect()}
    assert (got["a"]["type"], got["a"]["required"], got["a"]["default"], got["a"]["allowed_values"], got["a"]["deprecated"]) == ("string", True, "x", ["x"], True)
    assert got["n"]["type"] == "ReactNode"


def test_enrichment_keeps_files_apart(spark):
    files_ = spark.createDataFrame([(f"{d}/b.tsx", f"interface P {{ {p}: string }}\nexport function B({{ {p} }}: P) {{ return <b/>; }}") for d, p in (("a", "x"), ("c", "y"))], "path string, content string")
    report = spark.createDataFrame([("B", 0, "x", "string", True, "", "doc", [], False)], "component string, pos int, name string, type string, required boolean, default string, description string, allowed_values array<string>, deprecated boolean")
    got = {r["import_path"]: {p["name"]: p["description"] for p in r["props"]} for r in scan.scan(files_, docgen=report, check=False).components.collect()}
    assert got == {"./a/b": {"x": "doc"}, "./c/b": {"x": "doc", "y": ""}}
    with pytest.raises(Exception, match="catalog validation failed: duplicate component: B"):
        scan.scan(files_, docgen=report).components.collect()


def test_members_of_nested_classes(spark):
    code = "class A {\n\tprivate n: number = 1; static go(\n\t\ta: string,\n\t) {\n\t\tif (a) { if (b) { if (c) { if (d) { run(a); } } } }\n\t}\n\tlast() {}\n}"
    rows = m.symbols(m.modules(spark.createDataFrame([("a.ts", code)], "path string, content string")))
    assert {(r["fqn"], r["kind"]) for r in rows.collect()} == {("A", "class"), ("A.n", "field"), ("A.go", "method"), ("A.last", "method")}


def test_variants_by_empty_props_type(spark):
    code = 'const v = cva("b", { variants: { size: { sm: "x" } } });\ninterface P extends VariantProps<typeof v> {}\nexport function B({ a }: P) { return <b/>; }\nexport function C() { return <i/>; }'
    got = {r["name"]: [p["name"] for p in r["props"]] for r in scan.scan(spark.createDataFrame([("b.tsx", code)], "path string, content string")).components.collect()}
    assert got == {"B": ["a", "size"], "C": []}


def test_commonjs(spark):
    js = "const a = require('x');\nconst {b, c: d} = require('./y');\nconst e = require('z').f;\nmodule.exports = a;\nexports.g = 1;"
    found = m.modules(spark.createDataFrame([("a.js", js)], "path string, content string"))
    got = {(r["source"], r["type"], r["is_external"]) for r in m.module_imports(found).collect()}
    assert got == {("x", "namespace", True), ("./y", "named", False), ("z", "named", True)}
    assert {(r["name"], r["type"]) for r in m.module_exports(found).collect()} == {("default", "default"), ("g", "named")}


def test_tokens(spark):
    sheet = ":root { --background: oklch(1 0 0); --radius: 0.625rem; --chart-1: red; --sidebar-background: x; --tw-x: 1; --border: var(--b) }\n.dark { --background: black }\n@theme { --color-border: var(--border); }"
    rows = spark.createDataFrame([("a.css", sheet), ("b.css", ":root { --radius: 9px }")], "path string, content string")
    got = {r["name"]: (r["value"], r["category"]) for r in css.design_tokens(rows).collect()}
    assert got == {"background": ("oklch(1 0 0)", "color"), "radius": ("0.625rem", "border"), "chart-1": ("red", "chart"), "sidebar-background": ("x", "sidebar"), "border": ("var(--b)", "color")}
    assert css.dark_mode(rows).first()["dark_mode"]


def test_files(spark, tmp_path):
    for name in ("b.tsx", "a/x.ts", "a/x.test.ts", "node_modules/y.ts", "s.CSS"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("é1")
    assert [r["path"] for r in files.discover(spark, str(tmp_path)).collect()] == ["a/x.ts", "b.tsx"]
    assert [r["path"] for r in files.discover_css(spark, str(tmp_path)).collect()] == ["s.CSS"]
    assert [r["path"] for r in files.discover_workspace(spark, str(tmp_path)).collect()] == ["a/x.test.ts", "a/x.ts", "b.tsx"]
    from pyspark.sql import functions as F

    part = files.discover(spark, str(tmp_path)).select(files.byte_range(F.col("content"), F.lit(0), F.lit(2)).alias("x"), files.language(F.col("path")).alias("l"))
    assert part.first()["x"] == "é" and part.first()["l"] == "TypeScript"
    with pytest.raises(ValueError):
        files.glob_regex("{a")


def test_text_functions(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        text.import_path(F.lit("ui/dialog/index.tsx"), "@").alias("a"), text.category_of_path(F.lit("x.tsx")).alias("b"), text.resolved_import(F.lit("a/b/c.ts"), F.lit("../d"), ".ts").alias("c"),
        text.capture_name(F.lit("a.b.c")).alias("d"), text.literal_type(F.lit("-1")).alias("e"), text.line_count(F.lit("a\nb")).alias("f"),
    ).first()
    assert tuple(row) == ("@/ui/dialog", "components", "a/d.ts", ("a", "b.c"), "number", 2)


def test_index(spark, tmp_path):
    rows = [("a.ts", 0, 0, "A.x"), ("b.ts", 1, 0, "A.x"), ("b.ts", 1, 1, "B.y")]
    table = spark.createDataFrame(rows, "path string, seq int, pos int, fqn string")
    assert {r["fqn"]: r["path"] for r in index.symbol_table(table).collect()} == {"A.x": "b.ts", "B.y": "b.ts"}
    changed = spark.createDataFrame([("b.ts", 2, 0, "B.z")], table.schema)
    assert {(r["path"], r["fqn"]) for r in index.upserted(table, changed).collect()} == {("a.ts", "A.x"), ("b.ts", "B.z")}


def test_debounce_streams(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda ms: start + timedelta(milliseconds=ms)
    rows = [("a.ts", "write", at(0)), ("a.ts", "write", at(150)), ("a.ts", "create", at(900)), ("a.md", "write", at(0)), ("a.ts", "remove", at(10)), ("z.ts", "write", at(60_000))]
    changes = spark.createDataFrame(rows, "path string, op string, ts timestamp")
    changes.coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "feed"))
    running = index.debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    running.processAllAvailable()
    running.stop()
    got = sorted((r["path"], r["op"], r["events"]) for r in spark.table("bursts").collect())
    assert got == [("a.ts", "create", 1), ("a.ts", "write", 2)]
    assert index.removals(changes).count() == 1
    seen = []
    follow = index.follow(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "state"))
    follow.processAllAvailable()
    follow.stop()
    assert sum(seen) == 6

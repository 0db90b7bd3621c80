import json

import pytest

from weftline.functions import jsx
from weftline.operators import autofix
from weftline.plans.tools import analyze_pages, validate_pages
from weftline.sources.catalog import parse_catalog

CATALOG = {
    "name": "t", "version": "1",
    "components": [
        {"name": "Button", "import_path": "@/components/ui/button", "imported_names": ["Button"], "props": [
            {"name": "variant", "type": "string", "allowed_values": ["default", "destructive", "outline"], "default": "default"},
            {"name": "size", "type": "string", "allowed_values": ["default", "sm", "lg"]}, {"name": "asChild", "type": "boolean"}]},
        {"name": "Dialog", "import_path": "@/components/ui/dialog", "imported_names": ["Dialog"], "sub_components": [
            {"name": "DialogTrigger", "allowed_parents": ["Dialog"]}, {"name": "DialogContent", "allowed_parents": ["Dialog"], "must_contain": ["DialogTitle"]},
            {"name": "DialogTitle", "allowed_parents": ["DialogContent"]}]},
        {"name": "Old", "import_path": "./old", "imported_names": ["Old"], "deprecated": True, "deprecated_msg": "use Button",
         "props": [{"name": "id", "type": "string", "required": True}, {"name": "was", "type": "string", "deprecated": True}]},
    ],
}
BUTTON = 'import { Button } from "@/components/ui/button"\n'
DIALOG = 'import { Dialog } from "@/components/ui/dialog"\n'
PAGES = {
    "valid": (BUTTON + '<Button variant="default">x</Button>', []),
    "unknown": ("<FancyWidget />", ["unknown-component"]),
    "no import": ("<Button>x</Button>", ["missing-import"]),
    "wrong path": ('import { Button } from "wrong/path"\n<Button />', ["wrong-import-path"]),
    "bad value": (BUTTON + '<Button variant="fancy">x</Button>', ["invalid-prop-value"]),
    "bare value": (BUTTON + "<Button variant size={x} />", []),
    "stray sub": (DIALOG + "<DialogTrigger>x</DialogTrigger>", ["composition-violation"]),
    "no title": (DIALOG + "<Dialog><DialogContent>x</DialogContent></Dialog>", ["missing-child"]),
    "compound": (BUTTON + DIALOG + "<Dialog><DialogTrigger><Button>o</Button></DialogTrigger><DialogContent><DialogTitle>t</DialogTitle></DialogContent></Dialog>", []),
    "old": ('import Old from "./old"\n<Old {...all} was="x" extra />', ["deprecated-component", "deprecated-prop", "missing-required-prop", "unknown-prop"]),
    "none": (None, []),
    "empty": ("", []),
}


@pytest.fixture(scope="module")
def components(spark):
    return parse_catalog(spark.createDataFrame([(json.dumps(CATALOG),)], "value string")).components


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "page_id string, code string")


def test_rules(pages, components):
    result = validate_pages(pages, components, auto_fix=True)
    found = {k: [] for k in PAGES}
    for row in result.violations.collect():
        found[row["page_id"]].append(row["rule"])
    assert {k: sorted(v) for k, v in found.items()} == {k: v[1] for k, v in PAGES.items()}
    summaries = {r["page_id"]: (r["valid"], r["summary"]) for r in result.results.collect()}
    assert summaries["valid"] == (True, "no issues found") and summaries["bad value"] == (True, "1 warning(s)")
    assert summaries["old"] == (False, "1 error(s), 2 warning(s), 1 info(s)")
    fixed = {r["page_id"]: r["fixed_code"] for r in result.fixed.collect()}
    assert fixed["no import"].startswith('import { Button } from "@/components/ui/button"\n')
    assert 'variant="default"' in fixed["bad value"] and '"@/components/ui/button"' in fixed["wrong path"]
    assert set(fixed) == {"no import", "bad value", "wrong path"}


def test_usages(spark):
    rows = [
        (1, '<Button variant="default">Click</Button>'), (2, '<Input placeholder="text" />'), (3, "<Dialog><DialogContent><DialogTitle>x</DialogTitle></DialogContent></Dialog>"),
        (4, "<div><Button>x</Button><span /></div>"), (5, "<Dialog><div><DialogContent /></div></Dialog>"), (6, "<B onClick={() => { go({a: 1}) }} disabled={x} a:b=\"1\" k=\"1\" k='2' />"),
        (7, "const x = useState<User>(null) // <Hidden />\n<A icon={<B/>}/>"), (8, "<A>\n  <B\n    x\n  />\n</A>"),
    ]
    got = {}
    for r in jsx.usages(spark.createDataFrame(rows, "page_id long, code string")).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append((r["component_name"], r["props"], r["has_children"], r["parent_component"], r["line"], r["column"]))
    assert got[1] == [("Button", {"variant": "default"}, True, "", 1, 1)]
    assert got[2] == [("Input", {"placeholder": "text"}, False, "", 1, 1)]
    assert [(u[0], u[3]) for u in got[3]] == [("Dialog", ""), ("DialogContent", "Dialog"), ("DialogTitle", "DialogContent")]
    assert [(u[0], u[3]) for u in got[4]] == [("Button", "")] and got[5][1][3] == "Dialog"
    assert got[6][0][1] == {"onClick": "", "disabled": "", "k": "2"}
    assert [(u[0], u[4]) for u in got[7]] == [("A", 2)] and got[8][1][:1] + got[8][1][3:] == ("B", "A", 2, 3)


def test_imports(spark):
    code = 'import React from "react"\nimport { A as B, C } from "./x"\nimport * as N from "n"\nimport "./s.css"\nimport D, { E } from "d"'
    got = [(r["source"], r["names"], r["default_name"]) for r in jsx.imports(spark.createDataFrame([(1, code)], "page_id long, code string")).orderBy("pos").collect()]
    assert got == [("react", [], "React"), ("./x", ["A", "C"], ""), ("n", [], ""), ("./s.css", [], ""), ("d", ["E"], "D")]


def test_analysis(spark):
    code = "<Card>\n<A/>\n</Card>\n<Card>\n<A/>\n</Card>"
    row = analyze_pages(spark.createDataFrame([(1, code)], "page_id long, code string")).first()
    assert row["line_count"] == 6 and [(c["component_name"], c["children_count"]) for c in row["components"]] == [("Card", 2), ("A", 0), ("Card", 0), ("A", 0)]


FIX = "array<struct<kind:string,line:int,component:string,old:string,new:string>>"


def fixed(spark, code, *fixes):
    return autofix.with_edits(spark.createDataFrame([(code, list(fixes))], f"code string, fixes {FIX}"), "code", "fixes", "out").first()["out"]


def test_edits(spark):
    fixes = [("import", 3, "A", "", "./a"), ("value", 3, "B", "x", "y")]
    assert fixed(spark, 'import { B } from "b"\n\n<B v="x" w="x" />', *fixes) == 'import { B } from "b"\nimport { A } from "./a"\n\n<B v="y" w="x" />'


def test_edits_of_paths_and_of_nothing(spark):
    code = "import { B1 } from './b1'\nimport { B } from \"./b1\"\nimport { B2 } from ''\n<B/>"
    assert fixed(spark, code, ("path", 4, "B", "", "./b"), ("path", 4, "B", "", "./b")) == code.replace("'./b1'", "'./b'")
    assert fixed(spark, code, ("path", 4, "B1", "", "./b1"), ("path", 4, "Z", "", "./z"), ("value", 99, "B", "x", "y"), ("value", 0, "B", "x", "y")) == code
    assert fixed(spark, "<A/>", ("import", 1, "A", "", "./a"), ("import", 1, "B", "", "./b")) == 'import { B } from "./b"\nimport { A } from "./a"\n<A/>'
    assert fixed(spark, None, ("import", 1, "A", "", "./a")) == 'import { A } from "./a"\n'


def test_deep_braces_and_long_expressions(spark):
    from weftline.functions.jsx import usages

    rows = [("deep", "<A style={{a:{b:{c:{d:{e:1}}}}}}/>"), ("long", "<A f={" + "x + " * 5000 + "1}/>")]
    got = usages(spark.createDataFrame(rows, "page_id string, code string")).collect()
    assert sorted(r["page_id"] for r in got) == ["deep", "long"] and all(r["component_name"] == "A" for r in got)


def test_pages_are_parsed_once_and_never_meet(pages, components):
    from weftline.operators.validation import analysis

    result = validate_pages(pages, components)
    for rows in (result.violations, result.results):
        assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert "Exchange" not in analysis(pages)._jdf.queryExecution().executedPlan().toString()


def test_pages_of_one_id_are_judged_apart(spark, components):
    twice = spark.createDataFrame([(1, BUTTON + "<Button>x</Button>"), (1, "<Button>x</Button>")], "page_id int, code string")
    result = validate_pages(twice, components)
    assert sorted(r["errors"] for r in result.results.collect()) == [0, 1] and [r["rule"] for r in result.violations.collect()] == ["missing-import"]


def test_fixes_of_equal_violations_stay_apart(spark, components):
    code = 'import { Button } from "wrong"\n<Button variant="a" /> <Button variant="a" />\n<Old id="1"/><Old id="1"/>'
    found = validate_pages(spark.createDataFrame([(1, code)], "page_id int, code string"), components).violations
    got = sorted((r["kind"], r["line"], r["old"], r["new"]) for r in autofix.fix_rows(found, components).collect())
    assert got == [("import", 3, "", "./old"), *[("path", 2, "", "@/components/ui/button")] * 2, *[("value", 2, "a", "default")] * 2]


def test_equal_usages_are_judged_once(spark, components):
    code = BUTTON + '<Button size="x">a</Button>\n<Button size="x">b</Button>'
    twice = spark.createDataFrame([(1, code), (2, code), (3, None), (1, code)], "page_id int, code string").coalesce(1)
    rows = {r["component_name"]: sorted((p["page_id"], p["line"]) for p in r["places"]) for r in jsx.page_usages(twice).collect()}
    assert rows == {"Button": [(1, 2), (1, 2), (1, 3), (1, 3), (2, 2), (2, 3)], None: [(3, None)]}
    result = validate_pages(twice, components)
    assert sorted((r["page_id"], r["line"], r["prop"]) for r in result.violations.collect()) == [(p, line, "size") for p, line in rows["Button"]]
    assert sorted((r["page_id"], r["warnings"]) for r in result.results.collect()) == [(1, 2), (1, 2), (2, 2), (3, 0)]


def test_what_a_page_says_of_a_usage(spark):
    code = 'import A, { B as C, type D } from "./x"\r  import { D } from \'./y\'\nconst s = "import { E } from \\"z\\"" // <A/>\n<A><B/><C><E/></C></A>\n<A>{ok && <D {...p} />}</A>'
    rows = jsx.page_usages(spark.createDataFrame([(1, code)], "page_id int, code string")).collect()
    found = {(r["component_name"], r["parent_component"], r["source"], tuple(r["children"]), tuple(p["line"] for p in r["places"])) for r in rows}
    assert found == {("A", "", "./x", ("B", "C", "D"), (3, 4)), ("B", "A", "./x", (), (3,)), ("C", "A", None, ("E",), (3,)), ("E", "C", None, (), (3,)), ("D", "A", "./y", (), (4,))}


def test_fixes_are_dealt_by_page_once(pages, components):
    plan = validate_pages(pages, components, auto_fix=True).fixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(page_id") == 2  # fixes, and the pages they meet

import json

import pytest

from weftline.operators import catalog as q
from weftline.plans.tools import Tools, as_json
from weftline.sources.catalog import catalog_json, parse_catalog, read_catalog

PROP = {"type": "string"}
DOCUMENT = {
    "name": "test", "version": "1.0",
    "categories": [{"name": "actions", "components": ["Button"]}, {"name": "overlay", "components": ["Dialog"]}],
    "components": [
        {"name": "Button", "category": "actions", "description": "A clickable button", "import_path": "@/components/ui/button", "imported_names": ["Button"],
         "props": [{"name": "variant", **PROP}, {"name": "size", **PROP}], "examples": [{"title": "Basic", "code": "<Button/>"}]},
        {"name": "Dialog", "category": "overlay", "description": "A modal dialog overlay", "import_path": "@/components/ui/dialog",
         "imported_names": ["Dialog", "DialogTrigger", "DialogContent", "DialogTitle"],
         "sub_components": [
             {"name": "DialogTrigger", "allowed_parents": ["Dialog"]},
             {"name": "DialogContent", "allowed_parents": ["Dialog"], "must_contain": ["DialogTitle"]},
             {"name": "DialogTitle", "allowed_parents": ["DialogContent"]}],
         "guidelines": [{"rule": "dialog-title", "severity": "error"}]},
    ],
    "tokens": [{"name": "background", "value": "white", "category": "color"}, {"name": "foreground", "value": "black", "category": "color"},
               {"name": "chart-1", "value": "red", "category": "chart"}, {"name": "radius", "value": "1px", "category": "border"}],
    "guidelines": [{"rule": "use-design-tokens", "severity": "warning"}, {"rule": "import-from-ui", "severity": "error"}],
}


def parsed(spark, document):
    return parse_catalog(spark.createDataFrame([(json.dumps(document),)], "value string"), check=False)


@pytest.fixture(scope="module")
def catalog(spark):
    return parsed(spark, DOCUMENT)


def names(rows, column="name"):
    return [r[column] for r in rows.collect()]


@pytest.mark.parametrize(
    ("category", "keyword", "expected"),
    [("", "", ["Button", "Dialog"]), ("actions", "", ["Button"]), ("", "modal", ["Dialog"]), ("actions", "modal", []), ("", "BUTTON", ["Button"]), ("nope", "", [])],
)
def test_list_components(catalog, category, keyword, expected):
    assert names(q.list_components(catalog.components, category, keyword)) == expected


@pytest.mark.parametrize(
    ("keyword", "expected"),
    [("button", [("Button", "name")]), ("modal", [("Dialog", "description")]), ("variant", [("Button", "prop:variant")]), ("trigger", [("Dialog", "sub-component:DialogTrigger")]), ("zzz", []), ("", [])],
)
def test_search(catalog, keyword, expected):
    assert [(r["name"], r["reason"]) for r in q.search_components(catalog.components, keyword).collect()] == expected


def test_lookups(spark, catalog):
    assert names(q.get_component(catalog.components, "DialogContent")) == ["Dialog"]
    assert names(q.get_component(catalog.components, "Nope")) == []
    asked = spark.createDataFrame([(0, "DialogTitle"), (1, "Button"), (2, "Nope"), (3, "Button")], "at int, name string")
    assert names(q.get_components(catalog.components, asked)) == ["Button"]
    assert names(q.component_details(catalog.components, asked)) == ["Button", "Dialog"]
    assert names(q.list_tokens(catalog.tokens, "color")) == ["background", "foreground"]
    assert names(q.list_guidelines(catalog, "Dialog"), "rule") == ["use-design-tokens", "import-from-ui", "dialog-title"]
    assert names(q.list_guidelines(catalog, "DialogTitle"), "rule") == ["use-design-tokens", "import-from-ui"]
    assert names(q.component_examples(catalog.components, "Button"), "title") == ["Basic"]
    assert [(r["name"], r["component_count"]) for r in q.list_categories(catalog.categories).collect()] == [("actions", 1), ("overlay", 1)]


def test_tools_answer_as_json(catalog):
    answer = as_json(Tools(catalog).search_components("button")).first()
    assert json.loads(answer["value"])[0]["name"] == "Button" and answer["tokens_est"] == answer["response_bytes"] // 4
    with pytest.raises(ValueError):
        Tools(catalog).get_component_details([])


def test_catalog_round_trip(spark, catalog, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(catalog_json(catalog).first()["value"])
    again = read_catalog(spark, str(path))
    assert again.components.collect() == catalog.components.collect()


def broken(change):
    document = json.loads(json.dumps(DOCUMENT))
    change(document)
    return document


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda d: None, None),
        (lambda d: d.update(name=""), "catalog name is required"),
        (lambda d: d["components"].append(d["components"][0]), "duplicate component"),
        (lambda d: d["components"][0].update(category="zzz"), "unknown category"),
        (lambda d: d["components"][0].update(import_path=""), "import_path is required"),
        (lambda d: d["components"][0].update(imported_names=[]), "imported_names is required"),
        (lambda d: d["components"][0]["props"].append({"name": "x"}), "prop type is required"),
        (lambda d: d["guidelines"][0].update(severity="fatal"), "invalid severity"),
        (lambda d: d["categories"][0]["components"].append("Nope"), "category lists an unknown component"),
        (lambda d: d["categories"].append(d["categories"][0]), "duplicate category"),
        (lambda d: d["components"][1]["sub_components"].append({"name": "Button"}), "sub-component collides with a component"),
        (lambda d: d["components"][1]["sub_components"].append({"name": "DialogTitle"}), "duplicate sub-component"),
    ],
)
def test_integrity(spark, change, error):
    found = names(q.integrity_errors(parsed(spark, broken(change))), "error")
    assert found == ([] if error is None else [error])


def test_integrity_broadcasts_categories_alone(spark, tmp_path):
    """Components and sub-components grow with the catalog, so no side made of them passes through the driver."""
    (tmp_path / "catalog.json").write_text(json.dumps(DOCUMENT))
    assert q.integrity_errors(read_catalog(spark, str(tmp_path / "catalog.json"), check=False))._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1

"""The pipeline's stages, each against a plain version on its own input."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from tests_plain import plain_components, plain_spans
from weftline.llm import pii, quality
from weftline.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(str(DATA / "documents.parquet"))
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        seen.append(docs)
    return [{r["doc_id"]: r for r in rows.collect()} for rows in seen]


def test_quality_stage(spark, steps):
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(spark.read.parquet(str(DATA / "documents.parquet")), spark.read.parquet(str(DATA / "labels.parquet"))).collect()}
    assert set(steps[1]) == {i for i in steps[0] if scores[i] >= 0.7} and all(steps[1][i] == steps[0][i] for i in steps[1])
    good = [r["doc_id"] for r in spark.read.parquet(str(DATA / "labels.parquet")).where("quality = 1").collect() if r["doc_id"] in steps[0]]
    assert sum(i in steps[1] for i in good) >= 0.95 * len(good)


def test_copies_stage(steps):
    groups = plain_components([(i, r["text"]) for i, r in steps[1].items()])
    assert set(steps[2]) == {i for i, (_, first) in groups.items() if i == first}


def test_benchmark_stage(spark, steps):
    plain = lambda text: " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()]
    leaks = {i for i, r in steps[2].items() if any(x in plain(r["text"]) for x in items)}
    assert not leaks & set(steps[3]) and len(set(steps[2]) - set(steps[3]) - leaks) <= 0.02 * len(steps[2])


def test_personal_data_stage(steps):
    assert set(steps[4]) == set(steps[3])
    for i, row in steps[4].items():
        text, at, out = steps[3][i]["text"], 0, ""
        for start, kind, end in plain_spans(text):
            if start >= at:
                out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, end)
        assert row["text"].replace("[TERM]", "") == out + text[at:] or "[TERM]" in row["text"]
        assert row["n_chars"] == len(row["text"]) and row["lang"] == steps[3][i]["lang"]


def test_tokens_stage(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, row in steps[5].items():
        assert row["ids"] == library.encode(steps[4][i]["text"], add_special_tokens=False).ids and row["round_trip"] and row["n_tokens"] == len(row["ids"])


def test_null_ids_and_repeated_rows(spark, tmp_path):
    """The first three stages decide row by row: rows without an id, or with a shared one, go and stay on their own."""
    given = spark.read.parquet(str(DATA / "documents.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(given, spark.read.parquet(str(DATA / "labels.parquet"))).collect()}
    text = {r["doc_id"]: r["text"] for r in given.collect()}
    good, bad = (sorted((i for i in scores if scores[i] == x and text[i]), key=lambda i: -len(text[i])) for x in (1, 0))
    item = max((r["text"] for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()), key=len)
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], given.schema)
    ids = lambda k, rows: sorted(map(str, [(r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[k][1](spark, frame(rows), str(DATA)).collect()]))
    same = lambda rows: sorted(map(str, rows))
    a, b = text[good[0]], text[bad[0]]
    more = given.unionByName(frame([(None, b), (10**6, a), (10**6, b), (None, a)]))  # the labels teach nothing without the given rows
    judged = corpus_pipeline.keep_good(spark, more, str(DATA)).where("doc_id is null or doc_id = 1000000").collect()
    assert same([(r["doc_id"], r["text"]) for r in judged]) == same([(10**6, a), (None, a)])
    words = ["one two three four five six seven", "other words that are not alike at all", "yet more of them to be told apart"]
    assert ids(1, [(1, words[0]), (None, words[0]), (2, words[1]), (2, words[1]), (-3, words[2]), (1, words[2]), (None, words[1] + " x y z"), (None, "")]) == same([(1, words[0]), (2, words[1]), (-3, words[2]), (None, words[1] + " x y z"), (None, "")])
    assert ids(2, [(None, item), (7, words[0]), (7, item), (None, words[1])]) == same([(7, words[0]), (None, words[1])])


def test_run_gives_the_last_stage(spark, steps):
    assert {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(DATA)).collect()} == steps[-1]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())

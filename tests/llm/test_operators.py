"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_plain import plain_chats, plain_components, plain_main_text, plain_spans, plain_terms, plain_verdicts
from weftline.llm import bpe, chat, decontam, html_text, jaccard, licenses, neardup, pii, quality, urls
from weftline.llm.common import connected_components, without_ids
from weftline.llm.words import SPACE_WORDS, shingle_sets, word_hashes

LONG = "word " * 30_000
#: Columns whose names clash with names that operators use inside.
ODD = "doc_id bigint, text string, label string, n int, key string, _id string, sig string"


def docs_of(spark, texts):
    rows = [(i, t, "x", 1, "k", "z", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(0, None), (1, ""), (2, "   \n\t"), (3, LONG), (4, "a b c"), (4, "a b c"), (5, "a b c"), (None, "a b c"), (6, "Z" * 50_000), (7, "<|endoftext|> naïve 🙂 \u0000 x")]
    return spark.createDataFrame([(i, t, "x", 1, "k", "z", "s") for i, t in rows], ODD)


def empty(frame):
    return frame.limit(0)


def prose(seed, words):
    r = random.Random(seed)
    return [r.choice("abcdefgh") + r.choice("aeiou") + r.choice("rstvwxyz") + r.choice("aeiou") for _ in range(words)]


def test_word_hashes():
    words, bounds = word_hashes(["a B  a", None, "x" * 3_000_000, "b"], SPACE_WORDS)
    assert bounds.tolist() == [0, 3, 3, 4, 5] and words[0] == words[2] != words[1]
    assert [len(s) for s in shingle_sets(["a b c d e f", "a", "", None, "a a a a a a a"])] == [2, 1, 0, 0, 1]


def test_components_and_anti_join(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (50, 51), (51, 50), (60, 60)] + [(200, i) for i in range(201, 260)]
    frame = spark.createDataFrame([*edges, (None, 3)], "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert all(got[i] == 0 for i in [*range(41), 100]) and got[51] == 50 and got[259] == 200 and 60 not in got
    assert connected_components(empty(frame)).count() == 0
    rows = spark.createDataFrame([(i,) for i in range(100)] + [(None,)], "doc_id bigint")
    assert without_ids(rows, rows.where("doc_id < 40")).count() == 61


def test_jaccard_families(spark, monkeypatch):
    """Families around a base, chains, copies and unrelated texts, with blocks small enough to need many cells."""
    monkeypatch.setattr(jaccard, "BITMAP_BLOCK", 5)
    monkeypatch.setattr(jaccard, "SET_BLOCK", 4)
    r, texts = random.Random(3), []
    for family in range(4):
        base = prose(family, 60 + 40 * family)
        for k in range(18):
            words = list(base)
            for _ in range(r.randint(0, 1 + len(words) // 40)):
                words[r.randrange(len(words))] = f"new{r.randint(0, 5)}"
            texts.append(" ".join(words[: len(words) - r.choice([0, 0, 1, 5, 12])]))
        chain = list(base)
        for k in range(8):
            chain = chain[2:] + [f"tail{k}", f"end{k}"]
            texts.append(" ".join(chain))
    texts += [" ".join(prose(100 + i, 50)) for i in range(10)] + ["one two", "one  two", "One two three", "", "x"]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == plain_components(rows)


def test_jaccard_odd_rows(odd_docs):
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(odd_docs).collect())
    assert got == [(False, 0, 0, 0), (False, 1, 0, 1), (False, 2, 0, 2), (False, 3, 1, 3), (False, 4, 1, 4), (False, 4, 1, 4), (False, 5, 1, 4), (False, 6, 1, 6), (False, 7, 1, 7), (True, 0, 1, 4)]
    assert jaccard.jaccard_components(empty(odd_docs)).count() == 0


def test_quality(spark, odd_docs):
    good, bad = [" ".join(prose(i, 80)) + ".\n" for i in range(160)], [" ".join(w.upper() + "!!" for w in prose(i, 8) * 9) for i in range(160)]
    docs = docs_of(spark, [t for pair in zip(good, bad) for t in pair])
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    got = quality.quality_scores(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in held]) > 0.97
    scored = quality.quality_scores(odd_docs, labels.unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id bigint, quality int"))).collect()
    assert len(scored) == 10 and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.quality_scores(empty(odd_docs), empty(labels)).count() == 0
    few = quality.quality_scores(docs, labels, train_rows=100)
    assert few.count() == docs.count()


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 0.0, 2.0]), np.array([1.0, 3.0, 1.0])).tolist() == [0.25, 0.25, 2.0]


def test_url_filter(spark):
    link = '<head><link href="https://a.example.org/es/1" rel="canonical"></head>'
    rows = [
        (0, "http://WWW.Example.org/en/1x?q", ""), (1, "https://x.net/p", link), (2, "http://y.net/a#f", '<meta http-equiv="refresh" content="0; url=/b">'), (3, "http://y.net/b/", '<link rel=canonical href="http://x.net/p">'),
        (4, None, None), (5, "no scheme", ""), (6, "http://s.com/fr/1", link), (7, "http://z.net/", ""), (7, "http://z.net/", ""),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, component int")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urls.url_filter(pages, aliases=urls.html_aliases(pages)).collect()}
    assert got[0] == ("www.example.org", "example.org/en/1", "block") and got[6] == ("s.com", "com/fr/", "allow")
    # One component: it has a blocked URL, and an allowed one (6), which takes precedence for those without a rule.
    assert got[1] == ("x.net", None, "allow") and got[4] == ("", None, "allow") and got[5][0] == ""
    some = pages.where("page_id <> 6")
    got = {r["page_id"]: r["verdict"] for r in urls.url_filter(some, aliases=urls.html_aliases(some)).collect()}
    assert [got[i] for i in (1, 2, 3, 7)] == ["block", "block", "block", "allow"]
    assert urls.url_filter(some, aliases=urls.html_aliases(some)).count() == 8
    assert urls.url_filter(empty(pages), aliases=urls.html_aliases(empty(pages))).count() == 0


def test_url_votes_as_written(spark):
    """Root URLs of rules vote though nodes ignore a last slash, relative and encoded links count, allowing goes first."""
    link = lambda to: f'<link rel=canonical href="{to}">'
    rows = [
        ("http://a.net/1", link("https://foo.org/")), ("http://a.net/1/", link("http://b.com/de/1")),  # allow by org/, block by com/de/
        ("http://c.net/x", link("http://c.com/de/")), ("http://c.net/y", link("x")), ("http://c.net/z", link("/y?")), ("http://d.net/d/e", link("../d/f?a=1&amp;b=2")),
        ("http://d.net/d/f?a=1&b=2", '<meta http-equiv=refresh content="0;url=//www.example.org/en/12">'), ("http://e.net", ""), ("http://f.com/de/", ""), ("http://g.net/", link("http://f.com/de")),
        ("HTTP://G.net#a", ""), (None, link("http://h.com/de/1")), ("no", link("http://h.com/de/1")), ("http:///de/", ""), ("http://c.net/x", link("http://c.com/de/")),
    ]
    r = random.Random(4)
    names = [f"http://{h}{p}" for h in ("a.org", "b.com", "c.net", "d.net", "www.example.org") for p in ("", "/", "/de/", "/de", "/fr/", "/es/", "/x")]
    for k in range(6):
        more = [(r.choice(names), link(r.choice(names)) if r.random() < 0.5 else "") for _ in range(12)] if k else rows
        pages = spark.createDataFrame([(i, *x) for i, x in enumerate(more)], "page_id bigint, url string, html string")
        edges = urls.html_aliases(pages)
        got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.url_filter(pages, aliases=edges).collect()}
        assert got == plain_verdicts(more, [tuple(e) for e in edges.collect()])
        if not k:
            assert got[0][3] == got[1][3] == "allow" and all(got[i][3] == "block" for i in (2, 3, 4, 5, 6, 8, 9, 10, 14)) and all(got[i][3] == "allow" for i in (7, 11, 12, 13))


def test_main_text_of_the_given_pages(spark):
    """The whole operator against a plain version, on given pages and on random pages of one host."""
    r = random.Random(8)
    line = lambda: "".join(r.choice(["<p>{}</p>", "<div class=ad>{}</div>", "<nav>{}</nav>", "<article>{}</article>"])).format(r.choice("abcdef"))
    made = [(i, f"http://h.net/{r.choice('xyz')}/{r.randint(0, 30)}", "".join(line() for _ in range(r.randint(0, 8)))) for i in range(60)]
    given = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    for pages in (made, given):
        frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
        got = {x["page_id"]: (x["text"], x["n_shared"]) for x in html_text.main_text(frame).collect()}
        assert got == plain_main_text(pages)


def test_html_text(spark):
    ad = '<div class="top ad">buy</div>'
    pages = [
        (0, "http://h.org/b/1", f"<title>t</title><nav>menu</nav><article><h1>H &amp; x</h1><p>one<b> two</b><br>three<p>four{ad}<form>f</form></article><footer>c</footer>"),
        (1, "http://h.org/a/2", "<div>shared head</div><p>own text 1</p><div>shared foot</div>"), (2, "http://h.org/a/3", "<div>shared head</div><p>own text 2</p><div>shared foot</div>"),
        (3, "http://other.org/", "<p>alone</p><!-- <p>no --><script>var a='</p>'</script><style>p{}</style>"), (4, None, None), (5, "http://h.org/z", "<p>cut <a hre"), (6, "http://h.org/z", "<p>cut <a hre"),
        (6, "http://h.org/z", "<p>cut <a hre"), (None, "x", "<p>&#233;&nbsp;&lt;</p>"),
    ]
    frame = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id bigint, url string, html string, pos int, lines string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(frame).collect()}
    assert got[0][0] == "H & x\none two three\nfour" and got[1][0] == "own text 1" and got[2] == ("own text 2", 10)
    assert got[3][0] == "alone" and got[4] == ("", 0) and got[5][0] == "cut" and got[6][0] == "cut" and got[None][0] == "é <"
    assert html_text.main_text(frame).count() == len(pages) and html_text.main_text(empty(frame)).count() == 0


def test_common_lines_is_longest():
    r = random.Random(5)
    for _ in range(200):
        a, b = [[r.randint(0, 4) for _ in range(r.randint(0, 9))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(html_text.common_lines(a, b)) == best[-1][-1]


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "<|im_end|>\\<|", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", None, None), (None, 1, None, None, LONG, 0.0), (2, 1, 9, "user", "orphan", 0.0), (3, 1, 2, "a", "cycle", 0.0), (3, 2, 1, "a", "cycle", 0.0)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "tree bigint, node bigint, parent bigint, role string, text string, score double, leaf string")
    got = chat.reply_tree_chats(frame)
    back = got.select("tree", "branch_rank", chat.turns_of(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    turns = {(r["tree"], r["branch_rank"]): [(t["role"], t["text"]) for t in r["turns"]] for r in back}
    assert turns[1, 1] == [("user", "q"), ("assistant", "b"), ("user", "")] and turns[1, 2] == [("user", "q"), ("assistant", "<|im_end|>\\<|")]
    assert turns[None, 1] == [("", LONG)] and turns[2, 1] == [("user", "orphan")] and len(turns) == 4
    assert {(r["tree"], r["branch_rank"]): r["loss"] for r in back}[1, 2] == "<|im_end|>\\<|"
    assert chat.reply_tree_chats(frame, best=1).count() == 3 and chat.reply_tree_chats(empty(frame)).count() == 0


def test_chat_graphs_against_brute_force(spark):
    """Random graphs with cycles of any length and branches above them: it ends, and gives all branches that have a root."""
    r = random.Random(6)
    rows = []
    for tree in range(40):
        size = r.randint(1, 14)
        rows += [(tree, i, r.choice([None, r.randint(0, size), r.randint(0, size), max(0, i - 1)]), r.choice(["user", "assistant"]), r.choice(["a", "<|im_end|>", "\\", None]), float(r.randint(0, 3))) for i in range(size)]
    rows += [(100, i, (i + 1) % 3, "user", "c3", 0.0) for i in range(3)] + [(101, i, (i + 1) % 5, "user", "c5", 0.0) for i in range(5)]
    rows += [(102, i, (i + 1) % 3, "user", "c3", 0.0) for i in range(3)] + [(102, 9, 1, "user", "above", 0.0), (102, 10, 9, "user", "above", 0.0)] + [(103, i, i - 1, "user", "line", 0.0) for i in range(40)]
    frame = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    for best in (None, 2):
        back = chat.reply_tree_chats(frame, best).select("tree", "leaf", "branch_rank", "score", chat.turns_of(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
        got = {(x["tree"], x["leaf"]): (x["branch_rank"], x["score"], [tuple(t) for t in x["turns"]], x["loss"]) for x in back.collect()}
        assert got == {k: v for k, v in plain_chats(rows).items() if best is None or v[0] <= best}


def test_chat_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(37)] + [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, node int")
    got = {r["tree"]: r for r in chat.reply_tree_chats(chat.replies_of_turns(frame)).collect()}
    assert got[1]["n_turns"] == 37 and got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert got[1]["formatted"].index("t9") < got[1]["formatted"].index("t10")


def test_licenses(spark, odd_docs):
    mit = licenses.KNOWN[-1][1]
    texts = ["Released under the mit licence", "x\n (c) \nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0", "Copyright 2020 A\n" + mit.upper(), "released under", "This MIT License"]
    got = {r["doc_id"]: (r["licenses"], r["n_matches"], r["whole_text"]) for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    assert got == {0: ("MIT", 1, True), 1: ("Apache-2.0,CC-BY-NC-4.0", 2, False), 2: ("MIT", 1, True), 3: ("", 0, False), 4: ("", 0, False)}
    assert licenses.license_scan(odd_docs).where("n_matches = 0").count() == 10 and licenses.license_scan(empty(odd_docs)).count() == 0


@pytest.mark.parametrize("limit", [0, 64])
def test_bpe_equals_the_library(limit, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "SCAN_LIMIT", limit)
    path = public_tokenizers.path(bpe.DEFAULT_VOCABULARY)
    own, library, r = bpe.Codec(path), Tokenizer.from_file(path), random.Random(1)
    texts = ["", " ", "a" * 3000, LONG[:5000], "<|endoftext|>x <|endoftext|>", "it's 'LL 12³ⅷ   　x\x1c\x85y"]
    texts += ["".join(r.choice("ab 's\n\t.,19é你🙂̀") for _ in range(r.randint(1, 60))) for _ in range(500)]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids and own.decode(ids) == text


def test_bpe_rows(odd_docs):
    rows = bpe.bpe(odd_docs).collect()
    assert len(rows) == 10 and all(r["decoded"] == (o["text"] or "") for r, o in zip(rows, odd_docs.collect()))
    digests = bpe.bpe_digests(odd_docs).collect()
    assert digests[1]["n_tokens"] == 0 and digests[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.bpe_digests(empty(odd_docs)).count() == 0 and bpe.bpe(empty(odd_docs)).count() == 0


def test_neardup_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 24)
    monkeypatch.setattr(neardup, "LEAF", 4)
    random_ = np.random.default_rng(2)
    vectors = []
    for _ in range(6):
        base = random_.normal(size=8)
        vectors += [base + random_.normal(size=8) * s for s in [0.05] * 15 + [0.3] * 15]
    vectors = [v.astype(np.float32).tolist() for v in vectors] + [[0.0] * 8, [float("nan")] * 8, [1.0], [], None, [None, 1.0], vectors[0].astype(np.float32).tolist()]
    rows = [(i, v, i % 2 if i % 7 else 0, "z") for i, v in enumerate(vectors)] + [(900, vectors[0], None, "z"), (None, vectors[0], 0, "z")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, cell string")
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), l) for i, v, l, _ in rows if i is not None and l is not None and ok(v)]
    links = {i: {j for j, w, m in good if j != i and m == l and len(w) == len(v) and v @ w >= 0.93} for i, v, l in good}
    label = {r[0]: r[0] for r in rows}
    for _ in rows:
        for i in links:
            label[i] = min([label[i], *(label[j] for j in links[i])])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.embedding_neardup(frame).collect()}
    assert got == {i: (len(links.get(i, ())), label[i], i is None or label[i] == i) for i in label}
    assert neardup.embedding_neardup(empty(frame)).count() == 0


def test_decontamination(spark, odd_docs):
    items = [" ".join(prose(500 + i, 12 + 3 * i)) for i in range(12)] + ["two words", "", None]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(None, "a b c", 1)], "item_id bigint, text string, doc_id int")
    filler = [" ".join(prose(700 + i, 90)) for i in range(14)]
    texts = [f"{f} {items[i].upper()}! {f}" if i < 12 else f for i, f in enumerate(filler)]
    changed = items[11].split()
    changed[0] = "other"
    texts += [" ".join(changed) + " " + filler[0], " ".join(items[5].split()[:8]), "Two, words"]
    docs = docs_of(spark, texts)
    got = decontam.contamination(docs, bench)
    assert {r["doc_id"]: r["item_ids"] for r in got.collect()} == {**{i: [i] for i in range(12)}, 12: [], 13: [], 14: [11], 15: [], 16: [12]}
    passes = decontam.contamination(docs, bench, items_a_pass=4)
    assert passes.orderBy("doc_id").collect() == got.orderBy("doc_id").collect()
    assert decontam.contamination(odd_docs, bench).where("contaminated").count() == 0
    assert decontam.contamination(odd_docs, empty(bench)).count() == 10 and decontam.contamination(empty(odd_docs), bench).count() == 0


def test_decontamination_of_cut_items(spark):
    """A text that is an item less some words, shorter than the item, is compared as a whole."""
    words = prose(800, 59)
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "one two three four five six seven")], "item_id bigint, text string")
    cuts = [words[:50], words[9:], words[4:54], words[:40], words, [*words[:48], "other"], "one two three four five six".split(), "one two three four".split()]
    got = {r["doc_id"]: r for r in decontam.contamination(docs_of(spark, [" ".join(c) for c in cuts]), bench).collect()}
    assert [got[i]["item_ids"] for i in range(8)] == [[1], [1], [1], [], [1], [], [], []]
    assert got[0]["similarity"] == pytest.approx(46 / 55) and got[4]["similarity"] == 1


def test_decontamination_equals_all_windows():
    """Every window against every item, exactly: nothing is lost beyond the Hamming radius here, and nothing found besides."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([6, 9, 14, 25, 40]))) for _ in range(60)]
    items += [f"{i} common words in every single item {i} {j}" for i in range(30) for j in (1, 2)]
    texts = []
    for _ in range(250):
        own = rng.choice(items).split()
        for _ in range(rng.choice([0, 0, 1])):
            own[rng.choice([0, -1, rng.randrange(len(own))])] = rng.choice(vocabulary)
        del own[: rng.choice([0, 0, 1, 3])]
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) + " " + " ".join(own) + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))))
    index, links = decontam.ItemIndex(list(range(len(items))), items), 0
    for text in texts:
        words, want = decontam.word_hashes([text], decontam.ALNUM_WORDS)[0], {}
        for item, own, own_weights in index.items:
            length = int(index.lengths[item])
            size = min(5, length)
            if len(words) >= size:
                hashes, weights = decontam.shingle_hashes(words, size), decontam.shingle_weights(words, size)
                k = min(length - size + 1, len(hashes))
                best = max(decontam.weighted_jaccard(hashes[p : p + k], weights[p : p + k], own, own_weights) for p in range(len(hashes) - k + 1))
                if best >= 0.8:
                    want[item] = best
        assert index.matches(words) == want
        links += len(want)
    assert links > 100


def test_a_phrase_that_all_items_share_costs_little():
    items = [" ".join(prose(9000 + i, 40)) + " one phrase that all share " + " ".join(prose(20_000 + i, 20)) for i in range(2000)]
    index = decontam.ItemIndex(list(range(2000)), items)
    text = " ".join(prose(5, 3500)) + " one phrase that all share " + " ".join(prose(6, 3500)) + " " + items[77]
    words = decontam.word_hashes([text], decontam.ALNUM_WORDS)[0]
    tracemalloc.start()
    began = time.process_time()
    assert index.matches(words) == {77: 1.0}
    assert time.process_time() - began < 5 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_links_in_scripts_and_comments_are_none(spark):
    link = '<link rel="canonical" href="http://bad.example.org/es/x">'
    hidden = [f"<!-- {link} -->", f"<script>var s = '{link}';</script>", f"<STYLE>{link}</style>", f"<textarea>{link}</textarea>", f"<!-- {link}", f"<script>{link}", "<link " * 30_000, '<link "' * 20_000 + "'<meta " * 20_000]
    shown = [f"<p>{link}</p>", f"<script>x</script>{link}", f"<link <link x {link}", link.replace('"', "")]
    pages = spark.createDataFrame([(n, f"http://p{n}.net/", h) for n, h in enumerate(hidden + shown)], "page_id int, url string, html string")
    began = time.time()
    assert {r.src for r in urls.html_aliases(pages).collect()} == {f"http://p{n}.net/" for n in range(len(hidden), len(hidden + shown))}
    assert time.time() - began < 60


def test_weighted_jaccard():
    a, b = np.array([1, 1, 2], np.uint64), np.array([1, 3], np.uint64)
    assert decontam.weighted_jaccard(a, np.array([5, 5, 4]), b, np.array([5, 2])) == 5 / 16


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("a@.-+ 0123456789(%é") for _ in range(r.randint(0, 40)))
        assert plain_spans(text) == pii.base_spans(text)
    assert [s[1] for s in pii.base_spans("4111 1111 1111 1111 " + "x" * 100_000 + "@")] == [2]


def test_pii_terms(spark, odd_docs):
    """A word that stands with one person's address in several texts, and hardly elsewhere, discloses it."""
    texts = [" ".join(prose(i, 30)) for i in range(400)]
    for i in range(5):
        texts[i] = f"{' '.join(prose(90 + i, 4))} quux boss@corp.example {' '.join(prose(95 + i, 5))}"
    texts[40] = "then quux and Quux came"
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in pii.pii(docs, keep=["label"]).collect()}
    assert got[40]["spans"] == "term:5:9,term:14:18" and got[40]["sanitised"] == "then [TERM] and [TERM] came" and got[40]["n_email"] == 0
    assert got[0]["sanitised"] == texts[0].replace("quux boss@corp.example", "[TERM] [EMAIL]") and got[0]["n_email"] == 1 and got[0]["label"] == "x"
    assert got[50]["spans"] == "" and got[50]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.pii(odd_docs).count() == 10 and pii.pii(empty(odd_docs)).count() == 0


def test_pii_terms_equal_the_formula(spark):
    """Entities of one text and of many, copies, repeated signatures, words far off, short ones and ones with digits."""
    filler = [" ".join(prose(i, 30)) for i in range(1500)]
    near = [f"{' '.join(prose(3000 + i % 3, 6))} quux boss@corp.example {' '.join(prose(3010 + i % 3, 6))} copy{i}" for i in range(60)]
    signed = [f"zz7 {' '.join(prose(4000 + i, 40))} My Name Isx Jorvik +44 20 7946 0018 bye 10.0.0.{i % 4}" for i in range(20)]
    exact = ["solo word one@once.example and two@once.example, Élan vital"] * 50
    docs = docs_of(spark, filler + near + signed + exact + ["the Élan vital", "quux too"])
    found = {r["term"]: r for r in pii.disclosing_terms(docs).collect()}
    plain = plain_terms([r["text"] for r in docs.collect()])
    assert found.keys() == plain.keys() and all(found[t]["share"] == pytest.approx(plain[t]) for t in plain)
    assert {"quux", "jorvik", "zz7", "my", "bye", "solo", "word"} <= found.keys() and not {"boss", "élan", "vital", "copy1"} & found.keys()
    assert found["quux"]["entity"].startswith("email:") and found["jorvik"]["entity"].startswith("phone:")
    got = pii.pii(docs).where("doc_id = 1560").first()["sanitised"]
    assert got.startswith("[TERM] ") and "[TERM] [PHONE] [TERM] [IP]" in got


def test_pii_terms_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = plain_terms([r["text"] for r in docs.collect()])
    found = {r["term"]: r["share"] for r in pii.disclosing_terms(docs, share=0.8).collect()}
    plain = plain_terms([r["text"] for r in docs.collect()], 0.8)
    assert found == pytest.approx(plain) and found
    for r in pii.pii(docs, share=0.8, keep=["text"]).collect():
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert [(int(s), pii.KINDS.index(k), int(e)) for k, s, e in spans if k != "term"] == plain_spans(r["text"] or "")
        base = [(int(s), int(e)) for k, s, e in spans if k != "term"]
        words = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", r["text"] or "") if m[0].lower() in plain]
        assert [(int(s), int(e)) for k, s, e in spans if k == "term"] == [(s, e) for s, e in words if all(e <= a or b <= s for a, b in base)]


def test_html_wrappers_are_not_furniture():
    main = "<article><p>text</p></article>"
    wrappers = ['style="overflow:hidden"', 'class="overflow-hidden"', 'aria-hidden="false"', 'class="layout with-sidebar"', 'class="post has-comments"', 'id=no-right-sidebar', 'class="sidebar"', 'data-hidden="1"']
    for attributes in wrappers:
        assert html_text.text_lines(f"<div {attributes}>{main}</div>") == (["text"], [html_text.KEPT]), attributes
    for attributes in ("hidden", 'aria-hidden="true"', 'role="navigation"', "x=1 hidden=''"):
        assert html_text.text_lines(f"<div {attributes}>{main}</div>")[1] == [html_text.DROPPED], attributes
    for page in ('<div class="sidebar"><p>x</p></div>', '<div class="comments"><article class="comment">x</article></div>', "<nav><article>x</article></nav>", '<article><div class="related">x</div></article>'):
        assert html_text.text_lines(page)[1] == [html_text.DROPPED], page


def test_html_aliases_of_all_forms(spark):
    pages = [
        ("http://h.net/a/b", '<link rel=canonical href="other.html">', ["h.net/a/other.html"]), ("http://h.net/a/b/c", '<link href="../x" rel="canonical">', ["h.net/a/x"]),
        ("http://h.net/a", "<link rel='canonical' href='?p=2'>", ["h.net/a?p=2"]), ("http://h.net/a", '<meta content="0;url=/r" http-equiv="refresh">', ["h.net/r"]),
        ("http://h.net/a", '<link rel="canonical" href="http://k.net/?a=1&amp;b=2">', ["k.net?a=1&b=2"]), ("http://h.net/a", '<link rel="nofollow canonical" href="/c">', ["h.net/c"]),
        ("http://h.net/a", '<link rel="icon" href="/i"><link rel=canonical href=/1><link rel=canonical href=/2><META HTTP-EQUIV=refresh CONTENT="5; URL=\'//m.net/3\'"><meta name=x content="1;url=/no">', ["h.net/1", "h.net/2", "m.net/3"]),
        ("http://h.net/a", '<base href="http://b.net/d/"><link rel=canonical href=e><link rel=canonical href="mailto:x"><link rel=canonical data-href="/f">', ["b.net/d/e"]), ("no scheme", "<link rel=canonical href=/x>", []), (None, None, []),
    ]
    for url, html, want in pages:
        got = urls.html_aliases(spark.createDataFrame([(url, html)], "url string, html string")).select(urls.alias_key(F.col("dst")).alias("dst")).collect()
        assert sorted(r["dst"] for r in got) == want, html


def test_license_texts_as_files_have_them(spark):
    """With a title, hard-wrapped, in comments, at the head of code; texts that are only alike are not found."""
    import textwrap

    wrap = lambda text, width, mark="": "\n".join(mark + x for line in text.split("\n") for x in [*textwrap.wrap(line, width), ""])
    isc = "ISC License\n\nCopyright (c) 2020 A B\n\n" + wrap(licenses._ISC, 72)
    wrapped = licenses._ISC.replace("that the above ", "that the above\n")  # a line begins with `copyright notice`
    bsd = {n: wrap(licenses._bsd(n)[k], 70, " * ") for n, k in ((2, 2), (3, 1))}
    texts = ["MIT License\n\nCopyright (c) 2020 A\n\n" + wrap(licenses._MIT, 78), isc, wrapped, f"/*\n * Copyright 2019, X\n{bsd[3]}\n */\nint x;", bsd[2]]
    texts += ["a\n" + wrap(licenses._MIT, 60) + "\n" + wrap(licenses._MIT, 70) + "\nend", licenses._MIT[:-9] + " and more", wrap(licenses._ZLIB, 80) + "\ncode"]
    got = {r["doc_id"]: (r["licenses"], r["n_matches"], r["whole_text"]) for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(3)] == [("MIT", 1, True), ("ISC", 1, True), ("ISC", 1, True)]
    assert [got[i] for i in range(3, 8)] == [("BSD-3-Clause", 1, False), ("BSD-2-Clause", 1, True), ("MIT", 2, False), ("", 0, False), ("Zlib", 1, False)]


def test_more_license_texts(spark):
    """Texts that are parts or variants of others are told apart; each line is normalised on its own."""
    whole = "The Unlicense\n\n" + licenses._UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>\n"
    texts = [licenses._ISC_0, licenses._MIT_0, whole, "x\n" + licenses._UNLICENSE + "\ny", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + licenses._BOOST, licenses._MIT]
    texts += ["Licensed under\nCC BY 4.0.", "a\n\n -- Licensed under Creative  Commons Attribution 4.0. --\n", "\nCopyright x\nReleased under CC0 1.0.\r\n", "\n\n", "Licensed under Creative\nCommons BY 4.0."]
    got = {r["doc_id"]: (r["licenses"], r["n_matches"], r["whole_text"]) for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(6)] == [("0BSD", 1, True), ("MIT-0", 1, True), ("Unlicense", 1, True), ("Unlicense", 1, False), ("BSL-1.0", 1, True), ("MIT", 1, True)]
    assert [got[i] for i in range(6, 11)] == [("CC-BY-4.0", 1, True), ("CC-BY-4.0", 1, False), ("CC0-1.0", 2, True), ("", 0, False), ("CC-BY-4.0", 1, True)]

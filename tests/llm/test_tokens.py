"""Operators 12 and 13 against plain versions over the installed libraries."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weftline.llm import alignment, merges, pieces

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, ids string, _id int"
ALPHABET = "ab cde  \n\t▁th in日本𝔘é<0x41>　\x00\r👍🏽ingthe12'sll"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    noise = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    fixed = [None, "", " ", "\n", "  a  b ", "a▁b", "<|endoftext|> x <s></s> <0x0A>", "x" * 30_000, " " * 4_000, "日本語" * 3_000, "the the the " * 2_000]
    return fixed + fixed + noise


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(n // 2 if n % 9 else None, t, "other", n) for n, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    model, tokenizer = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    return model, tokenizer


def test_pieces_equal_the_library(docs, texts, library):
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.sentence_pieces(docs).collect())
    want = Counter()
    for n, t in enumerate(texts):
        ids = library[0].encode(t or "")
        want[(n // 2 if n % 9 else None, tuple(ids), library[0].decode(ids))] += 1
    assert got == want


def test_one_text_and_a_table_of_words_agree(texts, library):
    own = pieces.pieces(MODEL)
    for t in texts[:200]:
        assert own.encode(t) == library[0].encode(t or "")
        assert own.decode(own.encode(t)) == library[0].decode(library[0].encode(t or ""))
    words = sorted({w for t in texts for w in own.words(t or "")})
    ids, sizes = own.table(words)
    assert ids.tolist() == [i for w in words for i in own.word(w)] and sizes.tolist() == [len(own.word(w)) for w in words]


def test_models_that_cannot_be_cut_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.pieces.add(piece="of▁the", score=-9.0)
    (tmp_path / "crossing.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "crossing.model"))


def test_merges_of_nothing():
    import numpy as np

    ids, sizes = pieces.pieces(MODEL).pairs.segment(np.zeros(0, np.int32), np.zeros(0, np.int64))
    assert len(ids) == len(sizes) == 0
    assert merges.in_word_order([], 0)[0].tolist() == []


def plain_alignment(text, library):
    """Counts, links and groups of one text, offset by offset."""
    if not text:
        return 0, 0, [], ""
    a, b = library[1].encode(" " + text, add_special_tokens=False).ids, library[0].encode(text)
    sides, whole = alignment.aligner(BYTES, MODEL), (" " + text).encode()
    raw_a, raw_b = [sides.a.raw[i] for i in a], [sides.b.raw[i] for i in b]
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return 0, 0, [], ""
    ends, at = {}, 0
    for i, x in enumerate(raw_a):
        at += len(x)
        ends[at] = i
    links, groups, at, from_a, from_b = [], [], 0, 0, 0
    for j, x in enumerate(raw_b):
        at += len(x)
        if at in ends:
            i = ends[at]
            links.append((a[i], b[j]))
            groups.append(",".join(map(str, a[from_a : i + 1])) + "|" + ",".join(map(str, b[from_b : j + 1])))
            from_a, from_b = i + 1, j + 1
    return len(a), len(b), links, ";".join(groups)


def test_alignment_equals_the_plain_one(docs, texts, library):
    plain = [plain_alignment(t, library) for t in texts]
    counts = Counter(link for _, _, links, _ in plain for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter()
    for n, (n_a, n_b, links, groups) in enumerate(plain):
        best = sum(counts[x] == most[x[1]] for x in links)
        want[(n // 2 if n % 9 else None, n_a, n_b, len(links), len(links), best, sum(counts[x] for x in links), groups)] += 1
    got = alignment.alignment(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert Counter(map(tuple, got.collect())) == want


def test_pairs_are_bounded_by_the_vocabularies(docs):
    """Of two linked tokens one is a suffix of the other, so the table that is broadcast can't outgrow the tokens' bytes."""
    sides = alignment.aligner(BYTES, MODEL)
    pairs = alignment.aligned(docs, BYTES, MODEL).selectExpr("inline(pairs)").select("a", "b").distinct().collect()
    assert pairs and all(sides.a.raw[a].endswith(sides.b.raw[b]) or sides.b.raw[b].endswith(sides.a.raw[a]) for a, b in pairs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pieces.sentence_pieces(none).collect() == [] and alignment.alignment(none).collect() == []
    blank = spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], SCHEMA)
    assert [tuple(r)[1:] for r in alignment.alignment(blank).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert [(r.ids, r.decoded) for r in pieces.sentence_pieces(blank).collect()] == [([], "")] * 2

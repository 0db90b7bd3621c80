"""Personal data and information-theoretic sanitisation (operator 10).

Patterns find the entities to protect. Terms of the texts that have an entity are counted over the whole
corpus, each distinct text once, and a term discloses an entity when what it tells about it (their
pointwise mutual information) reaches a share of the entity's information content. Disclosing terms are
spans of their own, to be removed as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Rounds, cut, in_filter, map_slices, maybe_in, packed_filter
from weftline.llm.words import ALNUM_WORDS, word_hashes

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: A term discloses an entity from this share of the entity's information.
DISCLOSURE = 0.9
#: Occurrences of every term that are taken as seen beforehand, with entities as frequent there as anywhere.
PRIOR = 1.0
#: Bits of the filter that finds texts with terms that may disclose.
TERM_BITS = 26
#: Most of the frequent terms that are broadcast, each of at most so many bytes, to leave them out before a shuffle.
HEAVY_TERMS, HEAVY_BYTES = 1 << 17, 64

_MAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is taken whole or not at all: what fails at its start fails inside it too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Words as in ALNUM_WORDS: ASCII letters and digits, and all other characters beyond ASCII.
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from their @ signs, so that long words without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _MAIL_LOCAL:
            start -= 1
        rest = _MAIL_REST.match(text, at) if start < at else None
        if rest:
            yield start, (end := rest.end())
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Entities of a text as (start, kind, end), by start, then kind as listed in KINDS."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def _bare(text: str, spans: list[tuple[int, int, int]]) -> str:
    """A text with its entities blanked out, as long as before."""
    parts, at = [], 0
    for start, _, end in spans:
        if end > at:
            parts += [text[at:start], " " * (end - max(at, start))]
            at = end
    return "".join([*parts, text[at:]])


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every text that has entities, with its distinct entities and terms."""
    for batch in batches:
        rows = []
        for text, digest in zip(batch["_text"], batch["_digest"]):
            spans = base_spans(text)
            if spans:
                entities = {KINDS[kind] + ":" + hashlib.blake2b(text[start:end].encode("utf-8", "surrogatepass"), digest_size=12).hexdigest() for start, kind, end in spans}
                rows.append((digest, sorted(entities), sorted(set(map(str.lower, _WORD.findall(_bare(text, spans)))))))
        yield pd.DataFrame(rows, columns=["digest", "entities", "terms"])


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _term_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words, _ = word_hashes(batch["term"].tolist(), ALNUM_WORDS)
        yield pd.DataFrame({"slot": _slots(words)})


def _having(terms: Broadcast):
    """Every text that may have some of the terms, with each place of those and few others; what an entity cuts off a word stands at -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, texts = [], batch["_text"].tolist()
            bare = [_bare(t, base_spans(t)) for t in texts]
            words, bounds = word_hashes([t.lower() for t in bare], ALNUM_WORDS)
            hits = np.flatnonzero(in_filter(terms.value, _slots(words)))
            cuts = np.searchsorted(hits, bounds)
            for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                wanted, found = set((hits[cuts[i] : cuts[i + 1]] - bounds[i]).tolist()), []
                for at, m in enumerate(_WORD.finditer(bare[i])):
                    if at in wanted:
                        start, end = m.span()
                        part = start and _WORD.match(texts[i], start - 1) or _WORD.match(texts[i], end)
                        found.append((m[0].lower(), -1 if part else start, end))
                rows.append((batch["_digest"].iloc[i], *map(list, zip(*found))))
            yield pd.DataFrame(rows, columns=["digest", "term", "start", "end"])

    return run


def _digested(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(text.alias("_text"), F.unhex(F.md5(text)).alias("_digest"))


def _disclosing(docs: DataFrame, text_col: str, share: float) -> tuple[DataFrame, DataFrame]:
    """Disclosing terms, and texts by digest with the places where these stand: ``digest, places``."""
    spark, texts = docs.sparkSession, _digested(docs, text_col)
    tables = Rounds(spark)
    total = max(1, texts.agg(F.count_distinct("_digest")).first()[0])
    seen = tables.put("seen", map_slices(texts, _seen, "digest binary, entities array<string>, terms array<string>").dropDuplicates(["digest"]))
    pairs = seen.select("digest", F.explode("entities").alias("entity"))
    entities = tables.put("entities", pairs.groupBy("entity").agg(F.count("*").alias("n_entity")))
    counted = tables.put("counted", pairs.join(entities, "entity").where(F.col("n_entity") < total))
    own = tables.put("own", seen.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))

    def shares(pairs: DataFrame) -> DataFrame:
        prior = F.col("n_entity") / total
        posterior = (F.col("n_both") + PRIOR * prior) / (F.col("n_term") + PRIOR)
        return pairs.withColumn("share", F.log(posterior / prior) / -F.log(prior)).where(F.col("share") >= share)

    # Entities of one text only share all their counts, so one stands for them, and a term's count says all.
    single = counted.where("n_entity = 1").groupBy("digest").agg(F.min("entity").alias("entity"))
    rare = F.col("n_term") + PRIOR <= (1 + PRIOR / total) * total ** (1 - share) * (1 + 1e-9)

    # Entities of several texts meet the terms of these.
    several = tables.put("several", counted.where("n_entity > 1"))
    most = tables.put("most", several.groupBy("digest").agg(F.max("n_entity").alias("most")))
    each = maybe_in(seen.select("digest", "terms"), "digest", most, "digest").where("_may").select("digest", "terms").join(most, "digest")
    each = each.select(F.xxhash64("digest").alias("_text"), "most", F.explode("terms").alias("term"))
    # More texts with a term than this, and it tells too little about any entity of the text.
    bound = (F.col("most") + 1) * F.pow(total / F.col("most"), F.lit(1 - share)) * (1 + 1e-9)
    # Fewer than HEAVY_TERMS terms can have a count above this share of all counts.
    floor = (own.agg(F.sum("n_term")).first()[0] or 0) / HEAVY_TERMS
    heavy = own.where((F.col("n_term") > floor) & (F.octet_length("term") <= HEAVY_BYTES)).withColumnRenamed("n_term", "_heavy")
    light = each.join(F.broadcast(heavy), "term", "left").where(F.col("_heavy").isNull() | (F.col("_heavy") + PRIOR <= bound))
    known = light.join(own, "term").where(F.col("n_term") + PRIOR <= bound).select("_text", "term", "n_term")
    both = known.join(several.select(F.xxhash64("digest").alias("_text"), "entity", "n_entity"), "_text")
    both = both.groupBy("term", "entity", "n_entity").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"))
    hopeful = tables.put("hopeful", shares(both).select("term", "entity", "n_both", "n_entity"))

    # All texts are read again for what these terms count there.
    terms = tables.put("terms", own.where(rare).select("term").unionByName(hopeful.select("term")).distinct())
    filter_ = spark.sparkContext.broadcast(packed_filter(map_slices(terms, _term_slots, "slot bigint"), TERM_BITS))
    having = tables.put("having", map_slices(texts, _having(filter_), "digest binary, term array<string>, start array<int>, end array<int>").dropDuplicates(["digest"]))
    counts = having.select(F.explode(F.array_distinct("term")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    counts = tables.put("counts", counts.join(terms, "term"))
    told = tables.put("told", shares(hopeful.join(counts, "term")).select("term", "entity", "share"))
    left = tables.put("left", counts.where(rare).select("term").unionByName(told.select("term")).distinct())
    each = having.select("digest", F.explode(F.arrays_zip("term", "start", "end")).alias("_z")).select("digest", "_z.*")
    placed = tables.put("placed", maybe_in(each, "term", left, "term").where("_may").select("digest", "term", "start", "end").join(left, "term"))
    alone = placed.select("digest", "term").join(single, "digest").groupBy("term").agg(F.max("entity").alias("entity")).join(counts, "term")
    alone = shares(alone.withColumns({"n_both": F.lit(1), "n_entity": F.lit(1)})) if total > 1 else told
    best = alone.select("term", "entity", "share").unionByName(told).groupBy("term").agg(F.max(F.struct("share", "entity")).alias("_b"))
    best = cut(best.select("term", "_b.entity", "_b.share"))
    whole = placed.where("start >= 0").join(best.select("term"), "term")
    hits = cut(whole.groupBy("digest").agg(F.collect_list(F.array("start", "end")).alias("places")))
    tables.drop()
    return best, hits


def disclosing_terms(docs: DataFrame, text_col: str = "text", share: float = DISCLOSURE) -> DataFrame:
    """Terms that disclose an entity, each with the entity that it tells most about: ``term, entity, share``.

    All counts are of distinct texts: of N, n(t) have the term outside entities, n(e) the entity and
    n(t, e) both, wherever in the text. P(e) = n(e) / N; P(e|t) = (n(t, e) + PRIOR P(e)) / (n(t) + PRIOR),
    so a term seen once tells less than one seen often. A term's share of the entity's information is
    log(P(e|t) / P(e)) / -log P(e); it discloses from ``share`` on. An entity of all texts has no information.

    Only texts with an entity are asked for terms; pairs are made where an entity stands in several texts,
    as the count of a term says all for the others. Terms whose share would be too low even if no other
    text had them are dropped before all texts are read again, once, through a filter of a fixed size;
    where that fills up more words are shuffled, none is lost.
    """
    return _disclosing(docs, text_col, share)[0]


def _judged(carry: list[str], sanitise: bool):
    """Base entities as [start, kind, end] and, where asked for, the sanitised text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, clean = [], []
            for text, places in zip(batch["_text"], batch["_places"]):
                text = text or ""
                base, out, at = base_spans(text), [], 0
                found.append([list(span) for span in base])
                if sanitise:
                    extra = [] if places is None else [(int(start), len(KINDS), int(end)) for start, end in places]
                    for start, kind, end in sorted(base + extra):
                        if start >= at:
                            out += [text[at:start], f"[{(*KINDS, TERM)[kind].upper()}]"]
                        at = max(at, end)
                    clean.append("".join(out) + text[at:])
            out = batch[carry].reset_index(drop=True).assign(_base=found)
            yield out.assign(sanitised=clean) if sanitise else out

    return run


def _written(spans: Column) -> Column:
    """``kind:start:end`` of [start, kind, end], comma-joined."""
    kinds = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x[1]), x[0].cast("string"), x[2].cast("string"))), ",")


def pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, share: float = DISCLOSURE, sanitise: bool = True
) -> DataFrame:
    """Find and remove personal data: ``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, sanitised``.

    ``spans`` are kind:start:end by start, then kind, comma-joined, in code points with exclusive
    ends; base entities come by pattern, ``term`` spans are words that disclose an entity anywhere
    in the corpus. ``sanitised`` is the text with each span, or run of overlapping spans,
    generalised to its kind in brackets; without ``sanitise`` it is left out. One row per input row,
    repeated rows included; null and empty texts have no spans; ``keep`` names further columns to carry.
    Rows with disclosing terms meet the places of these: with their texts if those are to be sanitised,
    else with what is carried and their spans only. All other rows pass once more through a fixed-size filter.
    """
    carry = [id_col, *(c for c in keep or [] if c != id_col)]
    named = {f"_c{i}": c for i, c in enumerate(carry)}
    fields = ", ".join(f"{a} {docs.schema[c].dataType.simpleString()}" for a, c in named.items())
    _, hits = _disclosing(docs, text_col, share)
    digest = F.unhex(F.md5(F.coalesce("_text", F.lit(""))))
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for a, c in named.items()), F.col(f"`{text_col}`").alias("_text")).withColumn("digest", digest)
    rows = maybe_in(rows, "digest", hits, "digest")
    columns = [*named, "_text", "digest", "_places"]
    schema = f"{fields}, digest binary, _places array<array<int>>, _base array<array<int>>{', sanitised string' if sanitise else ''}"
    judge = lambda part: map_slices(part.select(*columns), _judged([*named, "digest", "_places"], sanitise), schema)
    plain = rows.where("not _may").withColumn("_places", F.lit(None).cast("array<array<int>>"))
    may, places = rows.where("_may"), hits.withColumnRenamed("places", "_places")
    if sanitise:
        judged = judge(plain.select(*columns).unionByName(may.join(places, "digest", "left").select(*columns)))
    else:
        found = judge(may.withColumn("_places", F.lit(None).cast("array<array<int>>"))).drop("_places").join(places, "digest", "left")
        judged = judge(plain).unionByName(found)
    none = F.array().cast("array<array<int>>")
    extra = F.transform(F.coalesce("_places", none), lambda x: F.array(x[0], F.lit(len(KINDS)), x[1]))
    kinds = F.transform("_base", lambda x: x[1])
    counts = [(F.size("_base") - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    spans = [F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.sort_array(F.concat("_base", extra))).alias("spans")]
    return judged.select(*named, *counts, *spans, *(["sanitised"] if sanitise else [])).withColumnsRenamed(named)

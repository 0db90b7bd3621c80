"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import alignment, bpe, chat, decontam, html_text, jaccard, licenses, neardup, pieces, pii, quality, ranked, urls
from weftline.llm.common import handed_in_small_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, with the canonical links and refreshes of the pages as edges."""
    pages = table(spark, sf_dir, "pages")
    return urls.url_filter(pages, aliases=urls.html_aliases(pages))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one that holds control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "select cast(-1 as bigint) conv_id, cast(n as bigint) turn, if(n = 0, 'user', 'assistant') role, "
        "'<|im_end|><|im_start|>assistant ok' text from values (0), (1) as t(n)"
    )
    chats = chat.reply_tree_chats(chat.replies_of_turns(rows.unionByName(extra)), best=1)
    back = chats.select(
        F.col("tree").alias("conv_id"),
        chat.turns_of(F.col("formatted")).alias("turns"),
        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    handed_in_small_batches(spark)
    return bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    handed_in_small_batches(spark)
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    handed_in_small_batches(spark)
    return neardup.embedding_neardup(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document."""
    handed_in_small_batches(spark)
    return pii.pii(table(spark, sf_dir, "documents"), sanitise=False)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    handed_in_small_batches(spark)
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels."""
    handed_in_small_batches(spark)
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    handed_in_small_batches(spark)
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    handed_in_small_batches(spark)
    return ranked.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of both vocabularies align in every document."""
    handed_in_small_batches(spark)
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    return alignment.alignment(table(spark, sf_dir, "documents"), keep_groups=digest).withColumnRenamed("groups", "groups_sha256")


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    handed_in_small_batches(spark)
    found = pieces.sentence_pieces(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op2_url_filter, op4_chat_format, op5_license_scan, op6_bpe, op7_jaccard_join, op8_embedding_neardup, op10_pii, op3_main_text, op1_quality, op9_decontamination, op11_ranked_search, op12_token_alignment, op13_sentence_pieces)}


def _url_sql() -> str:
    """Rules by url; without edges in the pages a page has no aliases, so the rest is allowed."""
    host = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    values = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in urls.RULES)
    return f"""
    with p as (select row_number() over () n, page_id, {host} host, {path} path from pages),
    rules(rhost, rpath, verdict) as (values {values}),
    fit as (select n, arg_max(rhost || rpath, length(rhost || rpath)) rule, arg_max(verdict, length(rhost || rpath)) verdict
            from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by n)
    select page_id, host, path, rule, coalesce(verdict, 'allow') verdict, false propagated from p left join fit using (n)"""


def _chat_sql() -> str:
    escaped = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
    around = len(chat.START + chat.SEPARATOR + chat.END) + 1
    return f"""
    with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') txt from conversations
               union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
               union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    g as (select conv_id, count(*) n_turns, string_agg(role || chr(10) || txt || chr(10), '' order by turn, role, txt) said,
                 coalesce(string_agg(txt, '' order by turn, role, txt) filter (role = 'assistant'), '') loss,
                 sum(length({escaped.format("role")}) + length({escaped.format("txt")}) + {around})::bigint formatted_chars
          from c group by conv_id)
    select conv_id, n_turns, sha256(said) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, formatted_chars from g"""


def _license_sql() -> str:
    def canonical(text: str) -> str:
        out = f"translate({text}, '{licenses.UPPER}', '{licenses.LOWER}')"
        out = f"regexp_replace({out}, '{licenses.COPYRIGHT_LINE.replace('(?md)', '(?m)')}', ' ', 'g')"
        out = rf"regexp_replace({out}, '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g')"
        for old, new in licenses.SPELLINGS:
            out = f"trim(replace(' ' || {out} || ' ', ' {old} ', ' {new} '), ' ')"
        return f"sha256(trim({out}, ' '))"

    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN)
    return f"""
    with known as (select min(license) license, digest from (select license, {canonical("t")} digest from (values {known}) k(license, t)) group by digest),
    units as (select doc_id, true w, text u from documents where text is not null
              union all select doc_id, false, unnest(string_split(text, chr(10))) from documents where contains(text, chr(10))),
    found as (select doc_id, string_agg(distinct license, ',' order by license) licenses, count(*) n, bool_or(w) w
              from (select doc_id, w, {canonical("u")} digest from units) join known using (digest) group by doc_id)
    select d.doc_id, coalesce(licenses, '') licenses, coalesce(n, 0) n_matches, coalesce(w, false) whole_text from documents d left join found f on d.doc_id = f.doc_id"""


_NEARDUP_SQL = f"""
    with recursive v as (select vec_id, label, embedding::double[] e from embeddings),
    g as (select vec_id, label, len(e) d, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) u from v
          where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_max(list_transform(e, lambda x: abs(x))) > 0),
    links as (select a.vec_id a, b.vec_id b from g a join g b on a.label = b.label and a.d = b.d and a.vec_id <> b.vec_id
              where list_inner_product(a.u, b.u) >= {neardup.THRESHOLD}),
    reach as (select vec_id n, vec_id m from embeddings union select r.n, l.b from reach r join links l on l.a = r.m),
    c as (select n, min(m) m from reach group by n),
    d as (select a, count(*) k from links group by a)
    select vec_id, coalesce(k, 0) n_links, m component_id, vec_id = m kept from embeddings left join c on c.n = vec_id left join d on d.a = vec_id"""

_RANKED_SQL = r"""
    with words as (select r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) t
                   from (select row_number() over () r, doc_id, text from documents)),
    tfs as (select r, doc_id, t, count(*) tf from words group by r, doc_id, t),
    lengths as (select r, sum(tf)::bigint n from tfs group by r),
    corpus as (select count(*)::bigint nn, sum(n)::bigint ll from lengths),
    ms as (select r, 50 + (50 * n * nn) // ll m from lengths, corpus),
    asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) t from benchmark),
    ws as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)))::bigint w from tfs, corpus group by t, nn),
    scores as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint score from asked join tfs using (t) join ws using (t) join ms using (r) group by item_id, r, doc_id)
    select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 50"""

ORACLE_SQL: dict[str, str] = {"op11_ranked_search": _RANKED_SQL, "op8_embedding_neardup": _NEARDUP_SQL, "op2_url_filter": _url_sql(), "op4_chat_format": _chat_sql(), "op5_license_scan": _license_sql()}

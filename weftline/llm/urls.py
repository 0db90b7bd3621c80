"""URL filters with redirect equivalence (operator 2).

Redirects and canonical links are edges between URLs. Connected components over them are classes of
aliases; a block rule that hits one alias reaches the others, unless an allow rule does so too.
"""

from __future__ import annotations

import html
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.llm.common import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and all paths that start with ``path``."""

    host: str
    path: str
    verdict: str


RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; empty without ``://`` or url."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """A URL's node: scheme, fragment and a last slash do not tell pages apart. Null without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    key = F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), query)
    return F.when(host_of(url) != "", key)


#: Elements whose contents are no tags, or none that count.
_OPAQUE = "script|style|textarea|title|template|iframe|xmp|noembed|noframes"
_OPENS = r"(?i)^<(?:link|meta|base)\b"
#: Comments and opaque elements are taken whole, so that tags inside them are not seen; a tag without an end stops at the next one.
_TAG = rf"""(?is)<!--.*?(?:-->|\z)|<({_OPAQUE})\b[^>]*+>.*?(?:</\1\b|\z)|<(?:link|meta|base)\b(?:(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<>]*+>)"""


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, wherever it stands in the tag; empty without."""
    value = F.regexp_extract(tag, rf"""(?is)(?:\s|["'/]){name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return F.trim(F.regexp_replace(value, r"""^["']|["']$""", ""))


@F.pandas_udf(StringType())
def _resolved(url: pd.Series, base: pd.Series, target: pd.Series) -> pd.Series:
    """A link's whole URL: references decoded, relative to the page, or its base element, if it has no host."""

    def whole(url: str, base: str, target: str) -> str | None:
        try:
            page = "http://" + url.split("://", 1)[1]  # alias keys know no schemes
            return urljoin(urljoin(page, html.unescape(base).strip()), html.unescape(target).strip())
        except ValueError:
            return None

    return pd.Series([whole(*row) for row in zip(url, base, target)], dtype=object)


def html_aliases(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``src, dst`` between a page's URL and the URLs of all its canonical links and refresh redirects.

    Tags in comments, scripts, styles and other elements without markup of their own are none.
    """
    tags = F.filter(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_TAG), 0), lambda t: t.rlike(_OPENS))
    bases = F.filter(F.transform(F.filter("_tags", lambda t: t.rlike(r"(?i)^<base\b")), lambda t: _attribute(t, "href")), lambda x: x != "")

    def target(tag: Column) -> Column:
        canonical = tag.rlike(r"(?i)^<link\b") & _attribute(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
        refresh = tag.rlike(r"(?i)^<meta\b") & _attribute(tag, "http-equiv").rlike(r"(?i)^refresh$")
        to = F.regexp_extract(_attribute(tag, "content"), r"""(?is)^[\s0-9.]*[;,\s]\s*url\s*=\s*["']?([^"']+)""", 1)
        return F.when(canonical, _attribute(tag, "href")).when(refresh, to).otherwise("")

    rows = pages.select(F.col(url_col).alias("_url"), tags.alias("_tags")).where(F.col("_url").contains("://") & (F.size("_tags") > 0))
    targets = rows.select("_url", F.coalesce(F.get(bases, F.lit(0)), F.lit("")).alias("_base"), F.explode(F.transform("_tags", target)).alias("_to")).where("_to <> ''")
    whole = targets.select("_url", _resolved("_url", "_base", "_to").alias("_whole"))
    named = (alias_key(F.col("_url")).isNotNull()) & (alias_key(F.col("_whole")).isNotNull())
    return whole.where(named).select(F.col("_url").alias("src"), F.col("_whole").alias("dst"))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct ``rule, verdict``; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def url_filter(
    pages: DataFrame, rules: list[Rule] = RULES, aliases: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Judge every page: ``id_col, host, path, rule, verdict, propagated``, one row per input row.

    A page that a rule fits gets that rule's verdict (the longest rule wins; of equal ones the
    allowing). A page without a rule takes its aliases' decision: allow if a rule allows any URL
    of its component, else block if a rule blocks one, else allow; ``propagated`` says that an
    alias blocked it. ``aliases(src, dst)`` are edges between URLs; both ends may be URLs without
    a page. URLs of one ``alias_key`` are one node, but each of them votes as it is written, pages
    as well as ends of edges. Null URLs and URLs without ``://`` have empty host and path, fit no
    rule, have no aliases and are allowed.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("_key"))
    judged = rows.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    if aliases is None:
        decided = judged.withColumn("_class", F.lit(None).cast("string"))
    else:
        edges = aliases.select("src", "dst")
        classes = connected_components(edges.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst")))
        ends = edges.select(F.col("src").alias("_url")).union(edges.select("dst"))
        at_ends = ends.select(alias_key(F.col("_url")).alias("node"), fitting_rule(host_of(F.col("_url")), path_of(F.col("_url")), rules)["verdict"].alias("vote"))
        by_pages = judged.where("_key is not null and _rule is not null").select(F.col("_key").alias("node"), F.col("_rule.verdict").alias("vote"))
        votes = at_ends.unionByName(by_pages).where("vote is not null").distinct()
        summed = classes.join(votes, "node").groupBy("component").agg(F.max(F.col("vote") == "allow").alias("_a"))
        voted = summed.select("component", F.when(F.col("_a"), "allow").otherwise("block").alias("_class"))
        by_node = classes.join(voted, "component").select(F.col("node").alias("_key"), "_class")
        decided = judged.where("_key is not null").join(by_node, "_key", "left").unionByName(judged.where("_key is null").withColumn("_class", F.lit(None).cast("string")))
    verdict = F.coalesce(F.col("_rule.verdict"), "_class", F.lit("allow"))
    return decided.select(
        F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"),
        (F.col("_rule").isNull() & (verdict == "block")).alias("propagated"),
    )

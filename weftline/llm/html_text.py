"""Main text of HTML pages by nearest-URL page differencing (operator 3).

Pages are sorted by host and URL path, each is paired with its nearest neighbour of the same host,
and their text lines are aligned by a longest common subsequence: lines that both share are page
furniture and go, wherever they stand outside an article, or what is named as one. Furniture that differs
from page to page, which no comparison shows, is known by its markup: navigation, notices and the like.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, map_slices
from weftline.llm.urls import host_of, path_of

#: Elements that end a text block, elements and name parts of page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("aside button dialog footer form head header iframe menu nav noscript object select svg template title".split())
NAME_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored sponsor promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer cookie cookies consent gdpr notice notices popup modal overlay comment comments commentlist disqus replies reply respond related share sharing social "
    "newsletter subscribe signup login widget toolbar pagination pager".split()
)
MAIN_PARTS = frozenset("article articlebody post entry story content main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
CLOSED_BY_SELF = frozenset("p li dt dd tr td th option".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|xmp)\b[^>]*+(?:>.*?(?:</\1\s*+>|\Z)|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+(?:>|\Z)|<(?:/?[a-z][^<]*+)?\Z|</?[a-z][^>]*+>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
#: What follows one of these in a class name tells of the layout around main text: `with-sidebar`, `has-comments`.
LAYOUT = frozenset("has with no without".split())

DROPPED, OPEN, KEPT = 0, 1, 2


#: Main text inside an element that is furniture by its class or id only becomes main text again.
NAMED, DECLARED = 1, 2


@lru_cache(4096)
def _kind(name: str, text: str) -> tuple[int, bool, bool]:
    """Whether an element is furniture (0, NAMED or DECLARED), is main text, and ends NAMED furniture around it."""
    attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed([*_ATTRIBUTE.finditer(text)])}
    role = attributes.get("role", "").strip().lower()
    body = name in ("body", "html")
    words = _name_words(attributes)
    named = not body and not words.isdisjoint(NAME_PARTS)
    furniture = 0
    if name in FURNITURE:
        furniture = DECLARED
    elif not body and name not in MAIN:
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true"
        furniture = DECLARED if hidden or re.match("[a-z]*", role)[0] in ROLES else NAMED if named else 0
    declared = name in MAIN or not body and (role == "main" or "articlebody" in attributes.get("itemprop", "").lower().split())
    return furniture, declared or not body and not words.isdisjoint(MAIN_PARTS), declared and not named


def _name_words(attributes: dict[str, str]) -> set[str]:
    """Parts of class and id names, without those that follow a word of LAYOUT."""
    found: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        for part in re.split(r"[^a-z0-9]+", name):
            if part in LAYOUT:
                break
            found.add(part)
    return found


def text_lines(page: str | None) -> tuple[list[str], list[int]]:
    """Text blocks of a page in order, white space folded, and for each whether markup drops or keeps it."""
    lines, roles, buffer = [], [], []
    stack: list[tuple[str, int, bool]] = []  # name, is or is in furniture, is or is in main text

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            _, furniture, main = stack[-1] if stack else ("", 0, False)
            lines.append(text)
            roles.append(DROPPED if furniture else KEPT if main else OPEN)
        buffer.clear()

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return

    at, page = 0, page or ""
    for match in _TOKEN.finditer(page):
        buffer.append(page[at : match.start()])
        at = match.end()
        name = (match[3] or "").lower()
        if not name:
            continue
        if name == "br":
            buffer.append(" ")
        if name in BLOCKS:
            flush()
        if match[2]:
            close(name)
        elif name not in VOID:
            if name in BLOCKS and any(entry[0] == "p" for entry in stack):
                close("p")
            if name in CLOSED_BY_SELF and stack and stack[-1][0] == name:
                stack.pop()
            _, furniture, main = stack[-1] if stack else ("", 0, False)
            own, is_main, ends = _kind(name, match[4])
            around = 0 if ends and furniture == NAMED else furniture
            stack.append((name, max(around, own), main or is_main))
            if match[4].endswith("/") and name not in BLOCKS:
                stack.pop()
    buffer.append(page[at:])
    flush()
    return lines, roles


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, over matching pairs only."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends, tails = [], []  # smallest end in b of a common subsequence of each length, and how it came about
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(link)
            elif j < ends[k]:
                ends[k], tails[k] = j, link
    out, link = [], tails[-1] if tails else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _surveyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page in batch["html"]:
            lines, roles = text_lines(page)
            rows.append(([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines], roles))
        out = pd.DataFrame(rows, columns=["lines", "roles"])
        yield pd.concat([batch[["key", "host", "path"]].reset_index(drop=True), out], axis=1)


def _differenced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, path, lines, roles, *around in batch[["key", "path", "lines", "roles", "path_a", "lines_a", "path_b", "lines_b"]].itertuples(index=False):
            best, partner = -1, None
            for other, theirs in (around[:2], around[2:]):
                if theirs is not None:
                    alike = next((i for i, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))
                    if alike > best:
                        best, partner = alike, theirs
            if partner is None:
                continue
            shared = [i for i in common_lines(list(lines), list(partner)) if roles[i] != KEPT]
            plain = sum(roles[i] == OPEN for i in shared)
            if plain and plain == sum(r == OPEN for r in roles) and KEPT not in roles:
                shared = [i for i in shared if roles[i] == DROPPED]  # a copy of its partner
            if shared:
                rows.append((key, shared))
        yield pd.DataFrame(rows, columns=["key", "shared"])


def _rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, marked = [], []
        for page, shared in zip(batch["html"], batch["shared"]):
            lines, roles = text_lines(page)
            gone = frozenset(shared) if shared is not None else frozenset()
            texts.append("\n".join(x for i, (x, role) in enumerate(zip(lines, roles)) if role != DROPPED and i not in gone))
            marked.append(sum(role == DROPPED and i not in gone for i, role in enumerate(roles)))
        n_shared = [0 if x is None else len(x) for x in batch["shared"]]
        yield batch[["_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts], n_shared=n_shared, n_marked=marked)


#: Deleted lines of at most so many are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 200_000


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``id_col, url_col, text, n_chars, n_shared, n_marked``, one row per input row, repeated rows included.

    ``n_shared`` lines were deleted by differencing, ``n_marked`` others by their markup.

    Character references are decoded, white space inside a block is folded, blocks are joined by
    newlines. Null and empty pages give an empty text. A page's partner is the neighbour of the
    same host, by sorted path, whose path shares the longer prefix (ties: the one before); pages
    without a host, or alone on theirs, have none. If a page without an article would lose all its
    lines to its partner, it is a copy and keeps them. Ties in the order go by page id, URL and digest.

    Neighbours are found over line digests sorted by range, so a host of any size is spread over
    partitions; no page text is shuffled unless very many lines are deleted.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    own_key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.hex(F.xxhash64(F.col(url_col), F.col(html_col))))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), own_key.alias("key"))
    hosted = rows.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html").where("host <> ''")
    surveyed = map_slices(hosted, _surveyed, "key string, host string, path string, lines array<bigint>, roles array<int>")
    surveyed = cut(surveyed.dropDuplicates(["key"]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = surveyed.repartitionByRange(parts, "host", "path", "key").sortWithinPartitions("host", "path", "key")
    ordered = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.expr("_at & ((1L << 33) - 1)")
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row for each partition
    starts = spark.createDataFrame(list(zip([r["_part"] for r in sizes], np.cumsum([0, *(r["n"] for r in sizes)]).tolist())), "_part bigint, start bigint")
    placed = ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("pos", F.col("start") + within)
    placed = cut(placed.select("pos", "key", "host", "path", "lines", "roles"))
    before = placed.select((F.col("pos") + 1).alias("pos"), F.col("host").alias("_ha"), F.col("path").alias("path_a"), F.col("lines").alias("lines_a"))
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("host").alias("_hb"), F.col("path").alias("path_b"), F.col("lines").alias("lines_b"))
    around = placed.join(before, "pos", "left").join(after, "pos", "left")
    for side in "ab":
        for name in (f"path_{side}", f"lines_{side}"):
            around = around.withColumn(name, F.when(F.col("host") == F.col(f"_h{side}"), F.col(name)))
    around = around.select("key", "path", "lines", "roles", "path_a", "lines_a", "path_b", "lines_b")
    deleted = cut(map_slices(around, _differenced, "key string, shared array<int>"))
    size = deleted.agg(F.coalesce(F.sum(F.size("shared")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(deleted) if size <= BROADCAST_LINES else deleted, "key", "left").select("_id", "url", "html", "shared")
    out = map_slices(joined, _rendered, f"_id {kind}, url string, text string, n_chars bigint, n_shared bigint, n_marked bigint")
    return out.withColumnsRenamed({"_id": id_col, "url": url_col})

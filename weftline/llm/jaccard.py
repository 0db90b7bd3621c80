"""N-gram Jaccard join by set-relation skipping (operator 7).

Index lists map a rare shingle to the sets that have it in their prefix, with positions. Lists are
split into blocks of like set sizes, so blocks that can't match are skipped. Each list then elects
its most central set as leader. Every member is compared with the leader first; members that link with
it are done, as they are all in one component. What the others share with the leader bounds what they
can share with each member, so their answers derive from the leader's, and only pairs that the bounds
and the components found so far leave open are compared. Parity bitmaps, which bound an overlap
exactly, spare most sets from being shipped at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import connected_components, cut, in_filter, map_slices, maybe_in, packed_filter, packed_slots
from weftline.llm.words import shingle_sets

#: Sets link when SIM_OF * intersection >= SIM * union.
SIM, SIM_OF = 80, 100
SHINGLE = 5
#: Bits of the fixed-size sketch of frequent shingles, the local count that enters it, and the shingles counted at once.
SKETCH_BITS, SKETCH_MIN, SKETCH_CHUNK = 20, 8, 1_000_000
#: Bits of the filter of shingles that occur again; where it fills up more index entries are shuffled, none is lost.
TOKEN_BITS = 27
#: Members of a leader in one block when bitmaps, and when whole sets are compared, and shingles in a block.
BITMAP_BLOCK, SET_BLOCK, BLOCK_SHINGLES = 256, 128, 100_000
BLOCK_RATIO = 1.15


def least_shared(n: int) -> int:
    """Fewest shingles that a set of n shares with any set linked to it."""
    return -(-n * SIM // SIM_OF)


def _signature(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _bitmap(hashes: np.ndarray) -> bytes:
    """Parity of the shingles in each of n or more slots, a power of two: two bitmaps differ in no more slots than their sets in shingles."""
    width = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    counts = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(bitmap, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of two kinds: a document's set size, signature and bitmap, and slots of locally frequent shingles."""
    gathered, held = [], 0

    def frequent() -> pd.DataFrame:
        hashes, counts = np.unique(np.concatenate(gathered), return_counts=True) if gathered else (np.zeros(0, np.uint64), np.zeros(0, int))
        often = counts >= SKETCH_MIN
        slots = (hashes[often] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        levels = np.log2(counts[often]).astype(np.int64)
        return pd.DataFrame({"_id": None, "n": 0, "sig": None, "bits": None, "slot": slots, "level": levels})

    for batch in batches:
        rows = []
        for hashes in shingle_sets(batch["_text"].tolist(), SHINGLE):
            rows.append((len(hashes), _signature(hashes), _bitmap(hashes)))
            gathered.append(hashes)
            held += len(hashes)
            if held >= SKETCH_CHUNK:
                yield frequent()
                gathered, held = [], 0
        out = pd.DataFrame(rows, columns=["n", "sig", "bits"])
        out.insert(0, "_id", batch["_id"].to_numpy())
        yield out.assign(slot=-1, level=0)
    yield frequent()


def _prefix(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles of a set of which any set linked to it has at least one, in the order (level of frequency, hash)."""
    level = levels[hashes >> np.uint64(64 - SKETCH_BITS)]
    order = hashes if not level.any() else hashes[np.argsort(level, kind="stable")]
    return order[: len(hashes) - least_shared(len(hashes)) + 1]


def _tokens(levels: Broadcast):
    """All shingles of prefixes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_prefix(hashes, levels.value) for hashes in shingle_sets(batch["_text"].tolist(), SHINGLE) if len(hashes)]
            yield pd.DataFrame({"token": (np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64)})

    return run


def _token_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"slot": _slots(batch["token"].to_numpy(np.int64).view(np.uint64))})


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << TOKEN_BITS) - 1)).astype(np.int64)


def _prefixes(levels: Broadcast, repeated: Broadcast):
    """Per text: signature, size, centrality and what may be shared of its prefix, with positions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for hashes in shingle_sets(batch["_text"].tolist(), SHINGLE):
                if len(hashes):
                    prefix = _prefix(hashes, levels.value)
                    at = np.flatnonzero(in_filter(repeated.value, _slots(prefix)))
                    if len(at):
                        central = float(levels.value[hashes >> np.uint64(64 - SKETCH_BITS)].mean())
                        rows.append((_signature(hashes), len(hashes), central, at.astype(np.int32), prefix[at].view(np.int64)))
            yield pd.DataFrame(rows, columns=["sig", "n", "central", "at", "prefix"])

    return run


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for hashes in shingle_sets(batch["_text"].tolist(), SHINGLE):
            rows.append((_signature(hashes), hashes.tobytes()))
            if len(rows) == 1000:
                yield pd.DataFrame(rows, columns=["sig", "items"])
                rows = []
        yield pd.DataFrame(rows, columns=["sig", "items"])


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of sorted rows, put together across batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows = pd.concat(held) if len(held) > 1 else batch
        new = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new).tolist()
        for lo, hi in zip(starts[:-1], starts[1:]):
            yield rows.iloc[lo:hi]
        held = [rows.iloc[starts[-1] :]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _may_link(bits: np.ndarray, n: np.ndarray, i: int) -> np.ndarray:
    """Sets whose bitmap allows a link with set i."""
    differ = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64)
    return (SIM_OF + SIM) * ((n + n[i] - differ) // 2) >= SIM * (n + n[i])


def _stacked(bitmaps: pd.Series) -> np.ndarray:
    size = min(map(len, bitmaps))
    return np.stack([_folded(x, size) for x in bitmaps])


def _gathered(frames: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Small frames put together, so few batches go back to Spark."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= rows:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def _far_pairs(bits: np.ndarray, n: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Sets of which a bitmap allows a link with another, where one of the two is far from the leader."""
    kept = np.zeros(len(n), bool)
    for i in np.flatnonzero(far).tolist():
        others = _may_link(bits, n, i)
        others[i] = False
        if others.any():
            kept |= others
            kept[i] = True
    return kept


def _near_leader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of a block, whether their bitmap allows a link with the leader, and if not, with another of the block."""

    def each() -> Iterator[pd.DataFrame]:
        for cell in _groups(batches, ["leader", "_b1", "_b2"]):
            bits, n = _stacked(cell["bits"]), cell["n"].to_numpy(np.int64)
            near = _may_link(bits, n, 0)
            found = _far_pairs(bits[1:], n[1:], ~near[1:])
            yield pd.DataFrame({"leader": cell["leader"].to_numpy()[1:], "sid": cell["sid"].to_numpy()[1:], "near": near[1:], "kept": near[1:] | found})

    return _gathered(each())


def _near_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of a cell whose bitmap allows a link between one that can't link with the leader and another."""

    def each() -> Iterator[pd.DataFrame]:
        for cell in _groups(batches, ["leader", "_b1", "_b2"]):
            kept = _far_pairs(_stacked(cell["bits"]), cell["n"].to_numpy(np.int64), cell["_open"].to_numpy(bool))
            yield pd.DataFrame({"leader": cell["leader"].to_numpy()[kept], "sid": cell["sid"].to_numpy()[kept]})

    return _gathered(each())


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def _with_leader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of two kinds: members of a block with what they share with the leader and whether they link; links inside the block."""

    def each() -> Iterator[pd.DataFrame]:
        for cell in _groups(batches, ["leader", "_b1", "_b2"]):
            n, items = cell["n"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in cell["items"]]
            shared = np.array([_overlap(items[0], x) for x in items], np.int64)
            is_open = (SIM_OF + SIM) * shared < SIM * (n + n[0])
            sid = cell["sid"].to_numpy(np.int64)
            checked = pd.DataFrame({"leader": sid[0], "sid": sid[1:], "shared": shared[1:], "linked": ~is_open[1:]})
            links = _linked_among(sid, n, items, shared, is_open, is_open, np.ones(len(n), bool))
            yield checked.assign(dst=pd.array([None] * len(checked), "Int64"))
            yield pd.DataFrame({"leader": sid[0], "sid": [x for x, _ in links], "shared": 0, "linked": False, "dst": pd.array([y for _, y in links], "Int64")})

    return _gathered(each())


def _between_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between blocks, of members that don't link with their leader, as far as the leader's answers leave them open."""

    def each() -> Iterator[pd.DataFrame]:
        for cell in _groups(batches, ["leader", "_b1", "_b2"]):
            block, is_open, items = cell["_block"].to_numpy(), cell["_open"].to_numpy(bool), [np.frombuffer(x, np.uint64) for x in cell["items"]]
            asking = is_open & (block == cell["_b1"].iloc[0])
            links = _linked_among(cell["sid"].to_numpy(np.int64), cell["n"].to_numpy(np.int64), items, cell["shared"].to_numpy(np.int64), is_open, asking, block == cell["_b2"].iloc[0])
            yield pd.DataFrame(links, columns=["src", "dst"], dtype="int64")

    return _gathered(each())


def _linked_among(sid: np.ndarray, n: np.ndarray, items: list[np.ndarray], shared: np.ndarray, is_open: np.ndarray, asking: np.ndarray, asked: np.ndarray) -> list[tuple[int, int]]:
    """Links of ``asking`` sets with ``asked`` ones that the leader's answers leave open.

    For members q, m with i_q, i_m shingles in common with the leader, their overlap is at most
    min(i_q, i_m) + min(n_q - i_q, n_m - i_m). Pairs below the needed overlap and pairs already in
    one component are skipped; sets that link with the leader are in one component from the start.
    """
    linked = np.flatnonzero(~is_open)
    parent = np.arange(len(n))
    parent[linked] = linked[:1]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for q in np.flatnonzero(asking).tolist():
        most = np.minimum(shared, shared[q]) + np.minimum(n - shared, n[q] - shared[q])
        may = asked & ((SIM_OF + SIM) * most >= SIM * (n + n[q]))
        may[q] = False
        for j in np.flatnonzero(may).tolist():
            ours, theirs = root(q), root(j)
            if ours != theirs and (SIM_OF + SIM) * _overlap(items[q], items[j]) >= SIM * (n[q] + n[j]):
                found.append((int(sid[q]), int(sid[j])))
                parent[ours] = theirs
    return found


def _blocks_of(size: Column, shingles: Column, per_block: int) -> Column:
    return F.greatest(F.ceil(size / per_block), F.ceil(F.coalesce(shingles, F.lit(0)) / BLOCK_SHINGLES)).cast("int")


def _with_heads(members: DataFrame, nodes: DataFrame, per_block: int) -> tuple[DataFrame, DataFrame]:
    """Deal each leader's members to blocks by hash, one row a member; every block also gets its leader, as block -1.

    Also the leaders whose members don't fit in one block.
    """
    sized = members.join(nodes.select("sid", "n"), "sid")
    blocks = cut(sized.groupBy("leader").agg(_blocks_of(F.count("*"), F.sum("n"), per_block).alias("_blocks")))
    own = F.pmod(F.xxhash64("sid"), F.col("_blocks")).cast("int")
    rows = members.join(blocks, "leader").select("leader", "sid", own.alias("_b1"), own.alias("_b2"), own.alias("_block"))
    every = F.explode(F.expr("sequence(0, _blocks - 1)"))
    heads = blocks.select("leader", every.alias("_b1")).select("leader", F.col("leader").alias("sid"), "_b1", F.col("_b1").alias("_b2"), F.lit(-1).alias("_block"))
    return rows.unionByName(heads), blocks.where("_blocks > 1").select("leader")


def _small_families(near: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Families of pairs that may link and fit in one block, as cells that have each set once, its least first; and the other pairs.

    A family is what ``near(leader, sid)`` connects. In its cell all members meet, so whoever led them
    before, none of their pairs is lost.
    """
    of = connected_components(near.select(F.col("leader").alias("src"), F.col("sid").alias("dst"))).withColumnsRenamed({"node": "sid", "component": "family"})
    blocks = of.join(nodes.select("sid", "n"), "sid").groupBy("family").agg(_blocks_of(F.count("*"), F.sum("n"), SET_BLOCK).alias("_blocks"))
    fits = cut(blocks.where("_blocks = 1").select("family"))
    of = cut(of.join(fits.withColumn("_fits", F.lit(True)), "family", "left"))
    cell = of.where("_fits").select(F.col("family").alias("leader"), "sid", F.lit(0).alias("_b1"), F.lit(0).alias("_b2"), F.expr("if(sid = family, -1, 0)").alias("_block"))
    return cell, near.join(of.where("_fits is null").select("sid"), "sid").select("leader", "sid")


def _open_with_all(members: DataFrame, nodes: DataFrame, per_block: int) -> DataFrame:
    """Cells in which each open member meets every member of its leader: ``leader, sid, _open, ..., _b1, _b2, _block``.

    Open members fill blocks 0 to p - 1, the others blocks p to p + r - 1; a cell is a pair of blocks
    of which the first is open. Leaders without open members have no cells.
    """
    sized = members.join(nodes.select("sid", "n"), "sid").groupBy("leader")
    count = lambda flag: _blocks_of(F.count_if(flag), F.sum(F.when(flag, F.col("n"))), per_block)
    blocks = cut(sized.agg(count(F.col("_open")).alias("_p"), count(~F.col("_open")).alias("_r")).where("_p > 0"))
    rows = members.join(blocks, "leader")
    own = F.expr("cast(if(_open, pmod(xxhash64(sid), _p), _p + pmod(xxhash64(sid), _r)) as int)")
    against_open = "transform(sequence(0, _p - 1), b -> named_struct('_b1', least(b, _block), '_b2', greatest(b, _block)))"
    against_rest = "if(_open and _r > 0, transform(sequence(_p, _p + _r - 1), b -> named_struct('_b1', _block, '_b2', b)), array())"
    dealt = rows.withColumn("_block", own).withColumn("_c", F.explode(F.expr(f"concat({against_open}, {against_rest})")))
    return dealt.select(*members.columns, "_block", "_c.*")


def _in_cells(rows: DataFrame) -> DataFrame:
    """Rows of a cell one after another, the leader first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "leader", "_b1", "_b2").sortWithinPartitions("leader", "_b1", "_b2", "_block", "sid")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by shingle sets: ``id_col, n_shingles, component_id``, one row per input row.

    A set has the distinct 5-word shingles of the text, A-Z lower-cased, words parted by ASCII
    white space; fewer words make one shingle. Documents link at Jaccard similarity >= 0.8;
    ``component_id`` is the smallest id reachable. Null and empty texts have empty sets and stand
    alone. Equal sets are one node however many rows share them. Rows that share an id are judged
    row by row; a null id takes part and yields to any other id of its component.

    Shingles and sets are told apart by 64 and 128-bit hashes. Only fixed-size sketches pass
    through the driver; shuffles carry hashes of prefixes and of sets that have a partner, never texts.
    """
    context = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    survey = cut(map_slices(rows, _survey, f"_id {kind}, n int, sig binary, bits binary, slot int, level int"))
    levels = context.broadcast(packed_slots(survey.where("slot >= 0").select("slot", "level"), SKETCH_BITS))
    documents = survey.where("slot < 0").select("_id", "n", "sig", "bits")
    nodes = documents.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.min("_id").alias("_id"), F.first("bits").alias("bits"))
    # Numbers (sid) ascend with the least id of a set, so the least number of a component is that of its least id.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = nodes.repartitionByRange(parts, F.col("_id").asc_nulls_last(), "sig").sortWithinPartitions(F.col("_id").asc_nulls_last(), "sig")
    nodes = cut(in_order.withColumn("sid", F.monotonically_increasing_id()))

    tokens = map_slices(rows.select("_text"), _tokens(levels), "token bigint")
    repeated = tokens.groupBy("token").agg(F.count("*").alias("among")).where("among > 1").select("token")
    repeated = context.broadcast(packed_filter(map_slices(repeated, _token_slots, "slot bigint"), TOKEN_BITS))
    prefixes = (
        map_slices(rows.select("_text"), _prefixes(levels, repeated), "sig binary, n int, central float, at array<int>, prefix array<bigint>")
        .groupBy("sig").agg(*(F.first(c).alias(c) for c in ("n", "central", "at", "prefix")))
        .join(nodes.select("sig", "sid"), "sig")
    )
    entries = prefixes.select("sid", F.explode(F.arrays_zip("at", "prefix")).alias("_t"), _packed("central", "n").alias("_of"))
    lists = _block_lists(entries.select(F.col("_t.prefix").alias("token"), "sid", (F.col("_of") + F.col("_t.at")).alias("packed")))
    members = cut(lists.where("sid <> leader").select("leader", "sid").distinct())

    bitmaps = nodes.select("sid", "n", "bits")
    dealt, large = _with_heads(members, nodes, BITMAP_BLOCK)
    near = cut(map_slices(_in_cells(dealt.join(bitmaps, "sid")), _near_leader, "leader bigint, sid bigint, near boolean, kept boolean"))
    among = _open_with_all(near.join(large, "leader", "left_semi").select("leader", "sid", (~F.col("near")).alias("_open")), nodes, BITMAP_BLOCK).join(bitmaps, "sid")
    partners = map_slices(_in_cells(among), _near_members, "leader bigint, sid bigint")
    near = cut(near.where("kept").select("leader", "sid").union(partners).distinct())

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Whole sets of members and leaders, by signature; only texts that may have one are read into sets."""
        wanted = pairs.select("sid").distinct().join(nodes, "sid")
        texts = maybe_in(rows, "_id", wanted, "_id").where("_id is null or _may").select("_text")
        return map_slices(texts, _full_sets, "sig binary, items binary").groupBy("sig").agg(F.first("items").alias("items"))

    signed = nodes.select("sid", "sig", "n")
    small, near = _small_families(near, nodes)
    dealt, large = _with_heads(near, nodes, SET_BLOCK)
    in_blocks = _in_cells(small.unionByName(dealt).join(signed, "sid").join(sets_of(small.unionByName(dealt)), "sig").drop("sig"))
    checked = cut(map_slices(in_blocks, _with_leader, "leader bigint, sid bigint, shared bigint, linked boolean, dst bigint"))
    links = checked.where("linked").select(F.col("leader").alias("src"), F.col("sid").alias("dst")).union(checked.where("dst is not null").select("sid", "dst"))
    left = cut(checked.where("dst is null").join(large, "leader", "left_semi").select("leader", "sid", "shared", (~F.col("linked")).alias("_open")))
    if not left.where("_open").isEmpty():
        cells = _open_with_all(left, nodes, SET_BLOCK).join(signed, "sid").join(sets_of(left), "sig").drop("sig")
        links = links.union(map_slices(_in_cells(cells), _between_members, "src bigint, dst bigint"))
    links = cut(links)

    classes = connected_components(links).select(F.col("node").alias("sid"), "component")
    heads = nodes.select(F.col("sid").alias("component"), F.col("_id").alias("_first"))
    first = classes.join(heads, "component").select("sid", "_first")
    by_set = nodes.join(first, "sid", "left").select("sig", F.coalesce("_first", "_id").alias("_first"))
    placed = documents.where("n > 0").select("_id", "n", "sig").join(by_set, "sig", "left").select("_id", "n", "_first")
    out = placed.unionByName(documents.where("n = 0").select("_id", "n", F.col("_id").alias("_first")))
    return out.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("_first", "_id").alias("component_id"))


#: Bits of a position and of a size in one integer; above them stands the centrality.
_FIELD = 28


def _packed(central: str, n: str) -> Column:
    """Centrality, in 12 steps a level of frequency up to 127, and set size in one integer, with room for a position."""
    step = F.least(F.floor(F.col(central) * 12), F.lit(127)).cast("long")
    return F.shiftleft(step, 2 * _FIELD) + F.shiftleft(F.col(n).cast("long"), _FIELD)


def _block_lists(entries: DataFrame) -> DataFrame:
    """Index lists with a leader, from ``entries(token, sid, packed)``: ``token, block, sid, leader``.

    Lists of one set are dropped. A set of size block b is in list b and, as a guest, in the lists
    of the larger sizes that its position still lets it link with, so each pair that can link meets
    in the larger one's list at its first common shingle. Sets that can't reach the overlap with
    any of a list are skipped. The leader is the member, guests aside, whose shingles are the most
    frequent. Counts and leaders are aggregates combined before the shuffle and joined back, so a
    list of any length is no task's own.
    """
    field = F.lit((1 << _FIELD) - 1)
    n, pos = F.shiftright("packed", _FIELD).bitwiseAND(field), F.col("packed").bitwiseAND(field)
    sized = entries.select("token", "sid", F.shiftright("packed", _FIELD).alias("_rank"), n.alias("n"), (n - pos).alias("rest"))
    sized = cut(sized)
    home = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(BLOCK_RATIO)))).cast("int")
    # A set with `rest` shingles from here on links, at its first common shingle, with sets of at most this size.
    widest = F.least(F.col("n") * SIM_OF / SIM, F.col("rest") * (SIM_OF + SIM) / SIM - F.col("n"))
    last = F.floor(F.log(widest + 0.5) / F.lit(float(np.log(BLOCK_RATIO)))).cast("int")
    homed = sized.select("*", home.alias("_home"), F.explode(F.sequence(home, F.greatest(home, last))).alias("block"))
    own = F.when(F.col("block") == F.col("_home"), F.struct("_rank", (-F.col("sid")).alias("sid")))
    best = homed.groupBy("token", "block").agg(F.max(own).alias("_best"), F.count("*").alias("among"), F.min("n").alias("least_n"))
    best = cut(best.where("_best is not null and among > 1").select("token", "block", (-F.col("_best.sid")).alias("leader"), "least_n"))
    # A set that can reach the overlap with none of the list, not even with the smallest, is skipped.
    reach = (SIM_OF + SIM) * F.col("rest") >= SIM * (F.col("n") + F.col("least_n"))
    return homed.join(best, ["token", "block"]).where(reach).select("token", "block", "sid", "leader")

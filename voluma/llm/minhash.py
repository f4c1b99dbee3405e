"""Near-duplicate documents: bottom-k sketches, inverted lists of retained values, exact Jaccard, components.

One hash function orders the word shingles of a document; its ``k`` smallest values are the sketch.  Documents with equal
shingle sets become one node first, so exact copies cost one row.  Every retained value has an inverted list of nodes.  A
node enters only the lists of the rarest values of its sketch (as many as the overlap of similar sketches demands), so a
passage shared by many documents makes few candidates.  A linear sweep over the lists (each node with its neighbour by set
size and with the list's most central one) comes first; the union sketch of a pair estimates its similarity, and pairs that pass are
verified on their full shingle sets.  Then the lists are contracted by component, and only pairs across components remain,
so a group of near copies never expands into all its pairs.  A 128-bit signature (one bit of the smallest hash in each of
128 bins) travels with the list rows, so that a join over a long list puts out only pairs that look similar.  The join across
components carries 512 bits more.  Of sets up to ``PARITY_SET`` they are the parities of the hashes per bin: two of them differ in
no more bits than the sets have unshared members, so they refute a family of loosely related texts without error.  Long lists are
joined block by block, and the sets of a node with many pairs are dealt over parts, so no list and no node is one task.

With ``k`` = ``deviations`` = ``EXACT`` the sketch is the whole set and no estimate filters: then no link is missed by chance.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, measured, stored, text_chunks

#: Odd multipliers of the rolling word hash and the finaliser; any fixed odd numbers do.
BASE, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Part of their values that sketches of sets at the threshold share at least (at 0.8 and k = 48: all but 1e-6 of pairs).
SURE_SHARE = 0.5
#: Bins of the signature, and the deviations from the expected difference at the threshold that it allows.
BINS, DEVIATIONS = 128, 5
#: Bins of the wide marks, and the largest set whose wide marks are parities (in larger ones these would be half ones anyway).
WIDE, PARITY_SET = 512, 900
#: Rows of a list, or pairs of a node, that one task takes at a time; lists and nodes with more that may be broadcast.
BLOCK, BROADCAST_ROWS = 512, 200_000
EXACT = (1 << 31) - 1
MARKS, WIDE_MARKS = ("s0", "s1"), tuple(f"w{i}" for i in range(WIDE // 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class ShingleHasher:
    """64-bit hashes of the distinct word shingles of each text of a chunk; words end at ASCII white space, A-Z is lowered."""

    def __init__(self, width: int):
        self.width, self.up, self.down = width, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the index of the first word of each row."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(BASE, n + 1), _powers(pow(BASE, -1, 1 << 64), n + 1)
        low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
        begins, ends = inside.copy(), np.ones(n + 1, bool)
        begins[1:] &= ~inside[:-1]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] = inside[edges]
        ends[:n] = ~inside
        ends[edges] = True
        starts = np.flatnonzero(begins)
        stops = np.flatnonzero(ends[1:] & inside) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        hashes = (total[stops] - total[starts]) * self.down[starts]
        hashes = _mixed(hashes ^ ((stops - starts).astype(np.uint64) * np.uint64(MIX_A)))
        return hashes, np.searchsorted(starts, offsets)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of each row; a row of fewer words is one shingle, without words none."""
        words, first = self.words(data, offsets)
        width = self.width
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for i in range(width):
            rolled = _mixed(rolled * np.uint64(BASE) + words[i : i + len(rolled)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1].view(np.int64))
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    whole = _mixed(whole * np.uint64(BASE) + w)
                yield whole.view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def node_of(hashes: np.ndarray) -> int:
    """Fingerprint of a shingle set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(hashes: np.ndarray, bins: int = BINS, first_bit: int = 0) -> np.ndarray:
    """bins / 64 longs: of each bin of the hash range (by its bits from ``first_bit``) one bit of the smallest value."""
    bits = np.zeros(bins, np.uint8)
    falling = hashes[::-1]
    bits[(falling >> first_bit) & (bins - 1)] = (falling >> 20) & 1  # the smallest of a bin is written last
    return np.packbits(bits).view(np.int64)


def wide_marks(hashes: np.ndarray) -> np.ndarray:
    """WIDE / 64 longs: the parities of the counts per bin, or, of a large set, a second signature from other bits."""
    if len(hashes) > PARITY_SET:
        return signature(hashes, WIDE, 32)
    counts = np.bincount((hashes >> 32) & (WIDE - 1), minlength=WIDE)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _sketcher(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                n, node, sketch, marks = [], [], [], []
                for hashes in hasher.sets(data, offsets):
                    n.append(len(hashes))
                    node.append(node_of(hashes))
                    marks.append(np.concatenate([signature(hashes), wide_marks(hashes)]))
                    sketch.append(hashes[:k])
                ends = np.cumsum([0] + [len(s) for s in sketch])
                flat = np.concatenate(sketch) if sketch else np.zeros(0, np.int64)
                marks = np.array(marks, np.int64).reshape(-1, len(MARKS + WIDE_MARKS))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(n)),
                        batch.column(2).slice(first, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array(node, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
                        *[pa.array(column) for column in marks.T],
                    ],
                    ["doc_id", "mark", "n_shingles", "node", "sketch", *MARKS, *WIDE_MARKS],
                )

    return run


def _setter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                sets = list(hasher.sets(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["node", "members"],
                )

    return run


def _similar(threshold_percent: int):
    """Keeps the pairs whose full sets are similar enough: 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                at = np.searchsorted(y, x)
                common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                keep.append(100 * common >= threshold_percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def sketches(docs: DataFrame, width: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, node (fingerprint of the shingle set), sketch (its k smallest hashes), s0, s1 (signature), w0 to w7 (wide marks)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    marks = ", ".join(f"{c} long" for c in MARKS + WIDE_MARKS)
    return rows.mapInArrow(_sketcher(width, k), f"doc_id {kind}, mark long, n_shingles long, node long, sketch array<long>, {marks}")


def inverted_lists(nodes: DataFrame, k: int, threshold_percent: int) -> DataFrame:
    """value, node, n_shingles, centre, s0, s1: each node in the lists of the rarest values of its sketch.

    Two sketches of similar sets share at least ``sure`` values, so they share one among the first ``size - sure + 1`` in
    any common order.  The order is by rising list length: values of one node come first and make no list at all.  ``centre``
    grows with the lists of all values of the node: of a family of copies, the least edited have most.
    """
    t = threshold_percent / 100
    rows = nodes.select("node", "n_shingles", F.explode("sketch").alias("value"))
    lengths = rows.groupBy("value").agg(F.count("*").alias("list_length")).where("list_length > 1")
    shared = rows.join(lengths, "value")
    n = F.col("n_shingles")
    whole = F.least(F.ceil(t * n), F.lit(int(k - (1 - t) * k / t)))  # a sketch that is the whole set
    sure = F.greatest(F.lit(1), F.when(n <= k, whole).otherwise(int(SURE_SHARE * k)))
    size = F.least(n, F.lit(k))
    by_node = Window.partitionBy("node", "n_shingles")
    rank = F.row_number().over(by_node.orderBy("list_length", "value"))
    alone = size - F.count("*").over(by_node)
    centre = F.sum(F.log2("list_length")).over(by_node)
    first = shared.withColumn("rank", rank + alone).withColumn("centre", F.rint(centre * 16).cast("long")).where(F.col("rank") <= size - sure + 1)
    marks = nodes.select("node", "n_shingles", "s0", "s1")
    return first.join(marks, ["node", "n_shingles"]).select("value", "node", "n_shingles", "centre", "s0", "s1")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _differing(x: str, y: str, columns: tuple[str, ...]):
    return sum(F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in columns)


def _most_differing(bins: int, threshold_percent: int, deviations: int) -> int:
    """Bits in which signatures of sets at the threshold differ, and some deviations; no more than all."""
    off = (1 - threshold_percent / 100) / 2
    return min(bins, int(bins * off + deviations * (bins * off * (1 - off)) ** 0.5))


def _can_match(x: str, y: str, threshold_percent: int, deviations: int):
    """Sets whose sizes or signatures differ by more can't reach the threshold. x, y: prefixes of the columns of two nodes."""
    nx, ny = F.col(x + "n_shingles"), F.col(y + "n_shingles")
    sizes = 100 * F.least(nx, ny) >= threshold_percent * F.greatest(nx, ny)
    return sizes & (_differing(x, y, MARKS) <= _most_differing(BINS, threshold_percent, deviations))


def _can_match_widely(x: str, y: str, threshold_percent: int, deviations: int):
    """The same for the wide marks: unshared members <= (1 - t) / (1 + t) * (sum of sizes) at the threshold t."""
    nx, ny, differ = F.col(x + "n_shingles"), F.col(y + "n_shingles"), _differing(x, y, WIDE_MARKS)
    parities = differ * (100 + threshold_percent) <= (100 - threshold_percent) * (nx + ny)
    signatures = differ <= _most_differing(WIDE, threshold_percent, deviations)
    both_small, both_large = F.greatest(nx, ny) <= PARITY_SET, F.least(nx, ny) > PARITY_SET
    return F.when(both_small, parities).when(both_large, signatures).otherwise(True)


def sweep_pairs(lists: DataFrame, threshold_percent: int, deviations: int = DEVIATIONS) -> DataFrame:
    """Linear candidates of each list: every node with the next one by set size, and with the most central one."""
    node = F.struct("centre", "node", "n_shingles", "s0", "s1")
    lead = lists.groupBy("value").agg(F.max(node).alias("lead"))
    star = lists.join(lead, "value").where((F.col("node") != F.col("lead.node")) & _can_match("", "lead.", threshold_percent, deviations))
    #: Cut by set size, so that one long list is not one task: near sizes stay together.
    by_value = Window.partitionBy("value", F.floor(F.log2("n_shingles") * 8)).orderBy("n_shingles", "node")
    chain = lists.withColumn("after", F.lead(node).over(by_value)).where("after is not null")
    chain = chain.where(_can_match("", "after.", threshold_percent, deviations))
    return star.select(*_pair("node", "lead.node")).union(chain.select(*_pair("node", "after.node"))).distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame, k: int, threshold_percent: int, deviations: int) -> DataFrame:
    """Pairs whose union sketch doesn't rule them out: the part of its values that both sketches hold, less some deviations."""
    t = threshold_percent / 100
    a = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    size = F.size(union)
    common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    least = t * size - float(deviations) * F.sqrt(size * t * (1 - t))
    return pairs.join(a, "a").join(b, "b").where(common >= F.greatest(F.lit(1.0), least)).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, threshold_percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that reach the threshold on their full shingle sets."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    reps = nodes.join(used, "node", "left_semi").select(F.col("rep").alias("doc_id"))
    texts = docs.join(reps, docs["doc_id"].eqNullSafe(reps["doc_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(_setter(width), "node long, members binary").dropDuplicates(["node"])
    hubs = {side: _hubs(pairs, side) for side in ("a", "b")}  # of the bare pairs, before sets are joined to them
    both = _with_members(_with_members(pairs, sets, hubs["a"], "a", "b"), sets, hubs["b"], "b", "a").select("a", "b", "ma", "mb")
    return both.mapInArrow(_similar(threshold_percent), "a long, b long")


def _hubs(pairs: DataFrame, side: str) -> DataFrame:
    """side, parts: the nodes of many pairs on a side, and over how many parts they are dealt."""
    hubs = pairs.groupBy(side).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    return measured(hubs, "hubs", BROADCAST_ROWS)[0]


def _with_members(pairs: DataFrame, sets: DataFrame, hubs: DataFrame, side: str, other: str) -> DataFrame:
    """``pairs`` with the members of the set of one side; a node of many pairs is dealt over parts by the other side."""
    own = sets.select(F.col("node").alias(side), F.col("members").alias(f"m{side}"))
    if hubs.isEmpty():
        return pairs.join(own, side)
    marked = pairs.join(hubs, side, "left")
    dealt = marked.where("parts is not null").withColumn("part", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")).drop("parts")
    hot = own.join(hubs, side).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    rest = marked.where("parts is null").drop("parts").join(own, side)
    return rest.unionByName(dealt.join(hot, [side, "part"]).drop("part"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node that has an edge, by alternating large and small stars."""

    def star(links: DataFrame, large: bool) -> DataFrame:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            sides = sides.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            sides = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = sides.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return out.where("a <> b").distinct()

    def mark(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    links = stored(edges.where("a <> b").distinct(), "links")
    before = mark(links)
    for _ in range(rounds):
        links = stored(star(star(links, True), False), "links")
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return pairs.union(pairs.select(F.col("component"), F.col("component")).distinct())


def near_duplicates(docs: DataFrame, width: int = 5, threshold_percent: int = 80, k: int = 48, deviations: int = DEVIATIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, mark (hash of the text).

    Rows whose distinct ``width``-word shingle sets have a Jaccard similarity of ``threshold_percent`` or more are linked;
    component_id is the smallest doc_id reachable.  Text of fewer words: one shingle.  Null or wordless text: an empty set,
    linked with nothing, component_id = doc_id.  Rows with equal sets are one node, so repeated rows and ties are one
    component; a null doc_id never becomes a component_id unless all of its component have none.  Empty table: no rows.
    Other columns are not read.
    """
    return _named(docs, width, threshold_percent, k, deviations, id_col, text_col).drop("component")


def _named(docs: DataFrame, width: int, threshold_percent: int, k: int, deviations: int, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates and the component itself (its smallest node; null without shingles): ids may be null or stand twice."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(sketches(docs, width, k), "sketches")
    full = rows.where("n_shingles > 0")
    first = [F.first(c).alias(c) for c in ("sketch", *MARKS, *WIDE_MARKS)]
    nodes = stored(full.groupBy("node", "n_shingles").agg(F.min("doc_id").alias("rep"), *first), "nodes")
    lists = stored(inverted_lists(nodes, k, threshold_percent), "lists")

    def links(pairs: DataFrame) -> DataFrame:
        good = stored(_estimated(pairs, nodes, k, threshold_percent, deviations), "candidates")
        return stored(verified(good, nodes, docs, width, threshold_percent), "edges")

    edges = links(sweep_pairs(lists, threshold_percent, deviations))
    names = components(edges)
    rest = links(_across(stored(_contracted(lists, nodes, names), "open"), threshold_percent, deviations))
    if not rest.isEmpty():
        names = components(edges.union(rest))
    named = nodes.select("node", "n_shingles", "rep").join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("node", "n_shingles", "component", "component_id")
    linked = full.select("doc_id", "n_shingles", "node", "mark").join(named, ["node", "n_shingles"])
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    columns = ["doc_id", "n_shingles", "component_id", "mark", "component"]
    out = linked.select(*columns).union(alone.select(*columns))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "mark", "component")


def deduplicate(docs: DataFrame, width: int = 5, threshold_percent: int = 80, k: int = 48, deviations: int = DEVIATIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they were, of which one is kept for each group of near copies.

    It is the one with the smallest doc_id (and then the smallest hash of the text); of rows that repeat it, one.  Rows without
    shingles are no copies of each other; of those that repeat an id and a text one stays.  Null ids: each component keeps one of
    its own rows.  An empty table gives none; columns may have any names.
    """
    found = _named(docs, width, threshold_percent, k, deviations, id_col, text_col)
    empty = F.col("n_shingles") == 0
    chosen = found.where("kept and n_shingles > 0").groupBy("component", "doc_id", "mark").agg(F.count("*").alias("rows"))
    # Two texts of one doc_id (or of none) may be in one group: the smaller hash stays.
    chosen = chosen.groupBy("component").agg(F.min(F.struct("doc_id", "mark", "rows")).alias("row")).select("row.*")
    chosen = chosen.union(found.where(empty).select("doc_id", "mark", F.lit(1).cast("long")).distinct())
    own_id, own_mark, copies, key = (fresh(n, docs.columns) for n in ("_id", "_mark", "_rows", "_key"))
    chosen = stored(chosen.toDF(own_id, own_mark, copies), "chosen")
    keyed = docs.withColumn(key, F.xxhash64(text_col))

    def with_rows(condition) -> DataFrame:
        own = chosen.where(condition)
        return keyed.join(own, keyed[id_col].eqNullSafe(own[own_id]) & (keyed[key] == own[own_mark]), "left_semi")

    several = with_rows(F.col(copies) > 1).dropDuplicates([id_col, key])
    return with_rows(F.col(copies) == 1).union(several).select(*docs.columns)


def _contracted(lists: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The lists that still hold more than one component, with each node's component, wide marks and ``lower``, its smaller values."""
    own = nodes.select("node", *WIDE_MARKS).join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smaller = Window.partitionBy("node").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    named = lists.drop("centre").join(own, "node").withColumn("lower", F.collect_list("value").over(smaller))
    open_lists = named.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return named.join(open_lists, "value", "left_semi")


def _across(lists: DataFrame, threshold_percent: int, deviations: int) -> DataFrame:
    """All pairs of similar-looking nodes of a list that are in different components, each once; few are left after the sweep.

    In a long list sizes are cut into cells as wide as the threshold, so that a set meets those of its own and the next cell
    alone, and the two sides meet block by block.
    """
    first_of_pair = ~F.arrays_overlap("x.lower", "y.lower")  # a pair comes out of the list of its smallest common value alone
    looks_similar = (F.col("x.component") != F.col("y.component")) & _can_match("x.", "y.", threshold_percent, deviations)
    looks_similar &= _can_match_widely("x.", "y.", threshold_percent, deviations) & first_of_pair

    def met(x: DataFrame, y: DataFrame, keys: list[str], once) -> DataFrame:
        return x.alias("x").join(y.alias("y"), keys).where(once).where(looks_similar).select(*_pair("x.node", "y.node"))

    ordered = F.col("x.node") < F.col("y.node")
    long, _ = measured(lists.groupBy("value").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).select("value"), "long", BROADCAST_ROWS)
    if long.isEmpty():
        return met(lists, lists, ["value"], ordered)
    short = lists.join(long, "value", "left_anti")
    cell = F.floor(F.log("n_shingles") / -math.log(threshold_percent / 100)).cast("int") if threshold_percent < 100 else F.lit(0)
    x = lists.join(long, "value", "left_semi").withColumn("cell", cell)
    y = x.withColumn("own", F.col("cell")).withColumn("cell", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    keys = ["value", "cell"]
    blocks, _ = measured(y.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks", BROADCAST_ROWS)
    x = x.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    y = y.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    once = (F.col("y.own") > F.col("x.cell")) | ordered
    return met(short, short, ["value"], ordered).union(met(x, y, [*keys, "block"], once))

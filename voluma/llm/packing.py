"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous supersteps.

Pieces of more than half the capacity open sequences.  A superstep range-sorts the other pieces and the gaps of the open sequences
by size, both falling.  In each range a sweep gives every piece the smallest gap that holds it (its successor) and puts what is
left of the gap back.  Pieces without a gap in their range claim gaps that larger ranges have left, the nearest range first:
claims are settled by rank, the n-th piece gets the n-th gap, or several pieces share each gap where all of them fit for
certain.  Then the gaps are updated, as many new sequences are opened as the pieces left need at least, and the step repeats.
What fits one task (``rows_per_task``) is swept to the end there.  The driver sees counts per range and per size, never a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored
from .tokens import Vocabulary

#: Pieces and gaps that one task sweeps at a time.
ROWS_PER_TASK = 200_000
#: Pieces of one size that are chosen exactly to open sequences.
EXACT = 10_000
GAP, PIECE, PLACED, LATER = 0, 1, 2, 3


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only a longer one is cut, and its first piece takes the rest."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)]


def _piecer(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path, added_tokens=True)
        for batch in batches:
            row, piece, start, length, crc, ids_out = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(vocabulary.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for p, (a, n) in enumerate(cuts(len(ids), capacity)):
                    row.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a : a + n].tobytes()))
                    if keep_ids:
                        ids_out.append(ids[a : a + n].astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document; null text: empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_piecer(tokenizer_path, capacity, end_id, keep_ids), schema)


SWEPT = "kind int, part int, rank long, size long, id long, sequence_id long, offset long"


def _sweeper(capacity: int, final: bool):
    """Sweeps a sorted range (falling sizes, gaps first) of kind, size, id.

    Puts out PLACED pieces, PIECEs without a gap by rank, and the GAPs left that hold all smaller pieces by rank (smallest first);
    other gaps left are for LATER.  ``final``: a piece without a gap opens a sequence.
    """
    names = [c.split()[0] for c in SWEPT.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, open_, waiting = TaskContext.get().partitionId(), 0, [], []
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
            rows.clear()
            return out

        for batch in batches:
            for kind, size, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind == GAP:
                    heappush(open_, (size, key))
                    continue
                while waiting and -waiting[0][0] >= size:  # what is left of a gap holds pieces again
                    gap, sequence = heappop(waiting)
                    heappush(open_, (-gap, sequence))
                if open_:
                    gap, sequence = heappop(open_)
                elif final:
                    gap, sequence = capacity, key
                else:
                    rows.append((PIECE, part, rank, size, key, None, None))
                    rank += 1
                    continue
                rows.append((PLACED, part, 0, size, key, sequence, capacity - gap))
                if gap > size:
                    heappush(waiting, (size - gap, sequence))
            yield batch_of()
        if not final:
            rows += [(GAP, part, i, gap, key, None, None) for i, (gap, key) in enumerate(sorted(open_))]
            rows += [(LATER, part, 0, -gap, key, None, None) for gap, key in waiting]
            yield batch_of()

    return run


def claims(ranges: dict[int, dict[int, tuple[int, int, int]]]) -> tuple[list[tuple[int, int, int, int, int, int]], dict[int, int], dict[int, int]]:
    """Which pieces get which gaps of larger ranges: runs (part, first rank, pieces, gap's part, first gap rank, pieces a gap), the
    pieces settled of each range, and the gaps used of each.

    ``ranges``: of each range and kind the rows, the least and the largest size.
    """
    runs, settled, used, stack = [], {}, {}, []
    for part in sorted(ranges):
        n, _, largest = ranges[part].get(PIECE, (0, 0, 0))
        rank = 0
        while rank < n and stack:
            owner, first, gaps, least = stack.pop()
            each = max(1, least // largest)
            took = min(n - rank, gaps * each)
            filled = -(-took // each)
            runs.append((part, rank, took, owner, first, each))
            rank, used[owner] = rank + took, first + filled
            if filled < gaps:
                stack.append((owner, first + filled, gaps - filled, least))
        settled[part] = rank
        if GAP in ranges[part]:
            stack.append((part, 0, ranges[part][GAP][0], ranges[part][GAP][1]))
    return runs, settled, used


def _claimer(runs: list[tuple[int, int, int, int, int, int]]):
    """Pieces (part, rank, size, id) that claim a gap: id, size, the gap's part and rank, and the piece's place among those that share it."""
    width = 1 << 40
    runs = sorted(runs)
    part, rank, took, owner, first, each = (np.array(x, np.int64) for x in zip(*runs)) if runs else [np.zeros(0, np.int64)] * 6
    keys = part * width + rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_part, own_rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("part", "rank"))
            at = np.searchsorted(keys, own_part * width + own_rank, side="right") - 1
            ok = at >= 0
            at = np.maximum(at, 0)
            if len(keys):
                ok &= (part[at] == own_part) & (own_rank < rank[at] + took[at])
                step = own_rank - rank[at]
                columns = [owner[at], first[at] + step // each[at], step % each[at]]
            else:
                columns = [np.zeros(len(at), np.int64)] * 3
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), *map(pa.array, columns)], ["id", "size", "part", "rank", "slot"]).filter(keep)

    return run


def opened(state: DataFrame, counts: dict[int, int], need: int) -> DataFrame:
    """``state`` with the column opens: the ``need`` largest pieces open sequences.

    Of the smallest size among them, up to EXACT are taken by order of a hash; of more, a part by hash (rather too few: the next
    step opens the rest).
    """
    left, last = need, 0
    for last in sorted(counts, reverse=True):
        if counts[last] > left:
            break
        left -= counts[last]
    of_last = (F.col("kind") == PIECE) & (F.col("size") == last)
    larger = (F.col("kind") == PIECE) & (F.col("size") > last)
    if left >= counts[last]:
        return state.withColumn("opens", larger | of_last)
    if left > EXACT:
        span = 1 << 30
        share = int((left - 3 * left**0.5) / counts[last] * span)
        return state.withColumn("opens", larger | of_last & (F.pmod(F.xxhash64("id"), F.lit(span)) < share))
    chosen = stored(state.where(of_last).orderBy(F.xxhash64("id"), "id").limit(left).select("id", F.lit(True).alias("chosen")), "chosen")
    state = state.join(F.broadcast(chosen), "id", "left")  # EXACT rows at most
    return state.withColumn("opens", larger | of_last & F.coalesce("chosen", F.lit(False)))


def superstep(state: DataFrame, rows: int, capacity: int, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """The pieces placed by one superstep (id, sequence_id, offset), and the gaps and pieces left (kind, size, id)."""
    spark = state.sparkSession
    order = [F.col("size").desc(), F.col("kind"), F.xxhash64("id")]
    sorted_ = state.select("kind", "size", "id").repartitionByRange(-(-rows // rows_per_task), *order).sortWithinPartitions(*order)
    swept = stored(sorted_.mapInArrow(_sweeper(capacity, False), SWEPT), "swept")
    ranges: dict[int, dict[int, tuple[int, int, int]]] = {}
    for r in swept.where(F.col("kind").isin(PIECE, GAP)).groupBy("part", "kind").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high")).collect():
        ranges.setdefault(r["part"], {})[r["kind"]] = (r["n"], r["low"], r["high"])  # a row per range and kind
    runs, settled, used = claims(ranges)
    placed = swept.where(F.col("kind") == PLACED).select("id", "sequence_id", "offset")
    bounds = spark.createDataFrame([(p, settled.get(p, 0), used.get(p, 0)) for p in ranges] or [(0, 0, 0)], "part int, settled long, used long")
    left = swept.where(F.col("kind") != PLACED).join(F.broadcast(bounds), "part", "left")  # a row per range
    left = left.where((F.col("kind") == LATER) | (F.col("kind") == PIECE) & (F.col("rank") >= F.col("settled")) | (F.col("kind") == GAP) & (F.col("rank") >= F.col("used")))
    left = left.select(F.when(F.col("kind") == PIECE, PIECE).otherwise(GAP).alias("kind"), "size", "id")
    if not runs:
        return placed, left
    claimed = swept.where(F.col("kind") == PIECE).select("part", "rank", "size", "id").mapInArrow(_claimer(runs), "id long, size long, part long, rank long, slot long")
    gaps = swept.where(F.col("kind") == GAP).select(F.col("part").cast("long").alias("part"), "rank", F.col("size").alias("gap"), F.col("id").alias("sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # as many as fit a gap
    matched = claimed.join(gaps, ["part", "rank"]).withColumn("offset", capacity - F.col("gap") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    matched = stored(matched, "matched")
    rest = matched.groupBy("sequence_id").agg((F.max("gap") - F.sum("size")).alias("size")).where("size > 0")
    left = left.union(rest.select(F.lit(GAP).alias("kind"), "size", F.col("sequence_id").alias("id")))
    return placed.union(matched.select("id", "sequence_id", "offset")), left


def places(sizes: DataFrame, capacity: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """id, sequence_id, offset of every piece of ``sizes`` (id, size: 1 to ``capacity``); a sequence is named by its first piece."""
    alone = F.col("size") * 2 > capacity
    zero = F.lit(0).cast("long")
    parts = [sizes.where(alone).select("id", F.col("id").alias("sequence_id"), zero.alias("offset"))]
    state = sizes.where(F.col("size") < capacity).select(F.when(alone, GAP).otherwise(PIECE).alias("kind"), F.when(alone, capacity - F.col("size")).otherwise(F.col("size")).alias("size"), "id")
    while True:
        state = stored(state, "state")
        counts: dict[int, dict[int, int]] = {GAP: {}, PIECE: {}}
        for r in state.groupBy("kind", "size").agg(F.count("*").alias("n")).collect():  # no more rows than twice the capacity
            counts[r["kind"]][r["size"]] = r["n"]
        if not counts[PIECE]:
            break
        least = min(counts[PIECE])
        useful = {size: n for size, n in counts[GAP].items() if size >= least}
        state = state.where((F.col("kind") == PIECE) | (F.col("size") >= least))  # smaller gaps hold nothing any more
        rows = sum(counts[PIECE].values()) + sum(useful.values())
        if rows <= rows_per_task:
            order = [F.col("size").desc(), F.col("kind"), F.xxhash64("id")]
            done = state.select("kind", "size", "id").coalesce(1).sortWithinPartitions(*order).mapInArrow(_sweeper(capacity, True), SWEPT)
            parts.append(stored(done.where(F.col("kind") == PLACED).select("id", "sequence_id", "offset"), "placed"))
            break
        free, needed = (sum(size * n for size, n in c.items()) for c in (useful, counts[PIECE]))
        need = -(-(needed - free) // capacity)
        if need > 0:
            state = opened(state, counts[PIECE], need)
            parts.append(state.where("opens").select("id", F.col("id").alias("sequence_id"), zero.alias("offset")))
            opens = F.col("opens")
            state = state.select(F.when(opens, GAP).otherwise(F.col("kind")).alias("kind"), F.when(opens, capacity - F.col("size")).otherwise(F.col("size")).alias("size"), "id")
        placed, state = superstep(state, rows, capacity, rows_per_task)
        parts.append(placed)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, rows_per_task: int = ROWS_PER_TASK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Every row of ``docs`` is a document of its ids and ``end_id``; null or empty text: ``end_id`` alone.  Only documents of
    more than ``capacity`` ids are cut.  Repeated rows are packed as often as they stand; ties in size are placed by a hash of
    the row's number.  A null doc_id is kept.  Empty table: no rows.  Other columns are not read.
    """
    rows = pieces(docs, tokenizer_path, capacity, end_id, keep_ids, id_col, text_col)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    found = places(rows.select(F.col("_row").alias("id"), F.col("length").alias("size")), capacity, rows_per_task)
    return rows.join(found.withColumnRenamed("id", "_row"), "_row").drop("_row")

"""Periodic runs of words: every maximal stretch that repeats with a period at least a few times over, in texts of any length.

For each octave of periods, L to 2 L - 1, a text has a boundary every L words.  A run of that octave is so long that it holds a
boundary at which the words from there on equal those one period later, so a boundary is worth solving only where the hashes of
both windows agree; most texts have none such and are done at once.  The others are exploded into tiles, each with the words
around some boundaries of one octave, which are dealt over all tasks and solved by themselves: two Z-functions, forward and
backward from a boundary, give for each period how far the repetition goes, up to the next boundaries.  These are fragments of intervals;
shuffled by text and period, fragments that touch are stitched.  Fragments of periods that are multiples of a smaller one are
left out in the tile, so a text of one word only doesn't yield all its periods.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, shared_dir

#: Words between the first and last boundary of a tile, at least; words of a window whose hashes are compared, at most.
TILE, SEED = 1024, 8
#: Bytes of tiles and texts in a batch that is handed back to Spark.
BATCH_BYTES = 4 << 20
#: An odd multiplier of the rolling hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def words_of(text: str | None) -> list[bytes]:
    """Words end at ASCII white space (0x20 and 0x09 to 0x0D)."""
    return text.encode().split() if text else []


def numbered_words(words: Sequence[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    table: defaultdict[bytes, int] = defaultdict()
    table.default_factory = table.__len__
    return np.fromiter(map(table.__getitem__, words), np.int32, len(words))


def shortest_match(first: int, least: int, times: int) -> int:
    """Words that equal the word a period later, at least, in a run of an octave of periods."""
    return min(max((times - 1) * p, least - p) for p in range(first, 2 * first)) if first < least else (times - 1) * first


def octaves(n: int, least: int, times: int) -> Iterator[tuple[int, int]]:
    """First period and window length of each octave that may have runs in n words."""
    first = 1
    while n >= least and times * first <= n:
        yield first, max(1, min(SEED, shortest_match(first, least, times) - first + 1))
        first *= 2


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * BASE
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(max(0, len(ids) - width + 1), np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(31))) * BASE + mixed[i : i + len(out)]
    return out


def live_boundaries(ids: np.ndarray, first: int, hashes: np.ndarray) -> np.ndarray:
    """Positions (multiples of ``first``) whose window comes again ``first`` to 2 ``first`` - 1 words later."""
    rows = -(-len(hashes) // first)
    if rows < 2:
        return np.zeros(0, np.int64)
    grid = np.zeros(rows * first, np.uint64)
    grid[: len(hashes)] = hashes
    grid = grid.reshape(rows, first)
    equal = grid[1:] == grid[:-1, :1]
    equal.reshape(-1)[len(hashes) - first :] = False  # beyond the text
    return np.flatnonzero(equal.any(axis=1)) * first


def tiles_of(ids: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, start, boundaries, words of the tiles that have a live boundary; a tile's words begin at ``start``."""
    hashed: dict[int, np.ndarray] = {}
    for first, width in octaves(len(ids), least, times):
        if width not in hashed:
            hashed[width] = window_hashes(ids, width)
        live = live_boundaries(ids, first, hashed[width])
        core = max(first, TILE)
        for part in np.split(live, np.flatnonzero(np.diff(live // core)) + 1) if len(live) else ():
            start = max(0, int(part[0]) - first)
            yield first, start, part, ids[start : int(part[-1]) + 3 * first + SEED]


def z_function(s: np.ndarray) -> list[int]:
    """For each i, how far s[i:] agrees with s from its start."""
    s = s.tolist()
    n, out, left, right = len(s), [0] * len(s), 0, 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def z_values(words: np.ndarray, at: np.ndarray, periods: np.ndarray, most: int, back: bool = False) -> np.ndarray:
    """Values of Z-functions: how far the words from each boundary on agree with those a period later, up to ``most``; with ``back``
    the words before it with those before boundary + period.  Compared out for all pairs at once."""
    span = -1 - np.arange(most) if back else np.arange(most)
    padded = np.concatenate([np.full(most, -1, words.dtype), words, np.full(most + 1, -1, words.dtype)])
    first = padded[(at + most)[:, None] + span]
    later = padded[np.minimum((at + periods + most)[:, None] + span, len(padded) - 1)]
    unequal = (first != later) | (first == -1) | (later == -1)
    return np.where(unequal.any(axis=1), unequal.argmax(axis=1), most)


def z_values_of_one(words: np.ndarray, c: int, periods: np.ndarray, most: int, back: bool = False) -> np.ndarray:
    """The same of one boundary, from the linear Z-function."""
    reach = int(periods.max())
    if back:
        mine = words[max(0, c - most) : c][::-1]
        found = np.array(z_function(np.concatenate([mine, np.full(1, -1, words.dtype), words[max(0, c - most) : c + reach][::-1]])), np.int64)
        return np.minimum(found[len(mine) + 1 + reach - periods], most)
    found = np.array(z_function(words[c : c + reach + most]), np.int64)
    inside = periods < len(found)
    return np.where(inside, np.minimum(found[np.where(inside, periods, 0)], most), 0)


def is_primitive(words: np.ndarray) -> bool:
    """Whether a block is no repetition of a shorter one."""
    n, rest, f = len(words), len(words), 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            q = n // f
            if np.array_equal(words[q:], words[: n - q]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def repeated_windows(words: np.ndarray, boundaries: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The boundaries and periods (``first`` to 2 ``first`` - 1) of windows of ``width`` words that come again a period later."""
    at, periods = (x.ravel() for x in np.meshgrid(boundaries, np.arange(first, 2 * first), indexing="ij"))
    inside = at + periods + width <= len(words)
    at, periods = at[inside], periods[inside]
    for i in range(width):
        same = words[at + i] == words[at + periods + i]
        at, periods = at[same], periods[same]
    return at, periods


def fragments(words: np.ndarray, boundaries: np.ndarray, first: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(period, begin, end) in a tile: stretches whose words equal those a period later, cut ``first`` words before a boundary and
    ``first + SEED`` after it (past the last boundary whose window a stretch holds come fewer words than that).

    Pairs of boundaries and periods are compared at once if they are few or short, else by one linear Z-function each way.
    """
    width = max(1, min(SEED, shortest_match(first, least, times) - first + 1))
    at, periods = repeated_windows(words, boundaries, first, width)
    if not len(at):
        return []
    if len(at) * first <= 1 << 18:
        right, left = z_values(words, at, periods, first + SEED), z_values(words, at, periods, first, back=True)
    else:
        right, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for c in np.unique(at).tolist():
            own = at == c
            right[own] = z_values_of_one(words, c, periods[own], first + SEED)
            left[own] = z_values_of_one(words, c, periods[own], first, back=True)
    short = (left < first) & (right < first + SEED) & (left + right < np.maximum((times - 1) * periods, least - periods))
    at, periods, begin, end = at[~short], periods[~short], (at - left)[~short], (at + right)[~short]
    order = np.lexsort((at, periods))
    at, periods, begin, end = at[order], periods[order], begin[order], end[order]
    new = np.ones(len(at), bool)
    new[1:] = (periods[1:] != periods[:-1]) | (begin[1:] > end[:-1])
    heads, tails = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)) - 1
    spans = zip(periods[heads].tolist(), begin[heads].tolist(), end[tails[: len(heads)]].tolist(), at[heads].tolist())
    return [(p, a, b) for p, a, b, c in spans if is_primitive(words[c : c + p])]


def _tiled(docs: DataFrame, text: str, keep: Sequence[str], least: int, times: int, texts: bool) -> DataFrame:
    """A stored table: a row per document (kind 0; its words if a tile may hold a run, else its digest) and per tile (kind 1)."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "kind int, row bigint, n bigint, words string, digest string, first bigint, start bigint, boundaries binary, tile binary"])
    own = [*keep, "kind", "row", "n", "words", "digest", "first", "start", "boundaries", "tile"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, rows, size = TaskContext.get().partitionId() << 33, [], 0

        def packed(kept: pa.RecordBatch | None, at: list[int | None]) -> pa.RecordBatch:
            columns = [kept.column(i).take(pa.array(at, pa.int64())) for i in range(len(keep))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], own)

        for batch in batches:
            at: list[int | None] = []
            for i, value in enumerate(batch.column(len(keep))):
                words = words_of(value.as_py())
                ids = numbered_words(words)
                mine = [(1, row, None, None, None, first, start, (live - start).astype(np.int32).tobytes(), tile.tobytes()) for first, start, live, tile in tiles_of(ids, least, times)]
                joined = b" ".join(words)
                whole = joined.decode() if mine or texts else None
                rows += [(0, row, len(words), whole, None if mine else hashlib.sha256(joined).hexdigest(), None, None, None, None), *mine]
                at += [i, *[None] * len(mine)]
                size += len(joined) + sum(len(m[-1]) for m in mine)
                row += 1
                if size > BATCH_BYTES:
                    yield packed(batch, at)
                    rows, at, size = [], [], 0
            if rows:
                yield packed(batch, at)
                rows, size = [], 0

    path = f"{shared_dir(docs.sparkSession)}/run_tiles-{uuid.uuid4().hex}"
    out = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("string").alias(fresh("text", keep))).mapInArrow(run, schema)
    out.write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _solved(tiles: DataFrame, least: int, times: int) -> DataFrame:
    """row, period, begin, end: the fragments of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, first, start, live, tile in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.frombuffer(tile, np.int32)
                out += [(row, p, start + a, start + b) for p, a, b in fragments(words, np.frombuffer(live, np.int32), first, least, times)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["row", "period", "begin", "end"])

    return tiles.mapInArrow(run, "row bigint, period bigint, begin bigint, end bigint")


def _stitched(parts: DataFrame, least: int, times: int) -> DataFrame:
    """row, start, length, period: fragments of a text and period that touch are one; what is long enough is a run."""
    order = Window.partitionBy("row", "period").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("_new", F.when(F.col("begin") <= before, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    spans = marked.groupBy("row", "period", "_island").agg(F.min("begin").alias("start"), F.max("end").alias("end"))
    spans = spans.withColumn("length", F.col("end") - F.col("start") + F.col("period"))
    return spans.where(F.col("length") >= F.greatest(F.lit(least), times * F.col("period"))).select("row", "start", "length", "period")


def kept_words(n: int, found: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: all but those of a run past its first period, whatever other run holds them."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3, keep: Sequence[str] | None = None, texts: bool = False) -> DataFrame:
    """The columns ``keep`` (all but the text, unless given), n_words, runs (start, length, period, by start, then period) and
    collapsed_sha256, with ``texts`` also collapsed: the words that stay when every run keeps its first period only.

    A run is a stretch of words with smallest period q, of max(least, times * q) words at least (``times`` from 2 on), that no
    neighbouring word extends with that period.  A null or wordless text has no runs and collapses to the empty text; repeated
    rows give repeated results; ties don't arise, as all runs are given; an empty table gives no rows; ``keep`` may hold
    any names but those of the results.
    """
    if times < 2:
        raise ValueError("a run repeats its period twice at least")
    keep = [c for c in docs.columns if c != text] if keep is None else list(keep)
    internal = {c: f"_k{i}" for i, c in enumerate(keep)}
    docs = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in internal.items()], F.col(f"`{text}`").alias("text"))
    table = _tiled(docs, "text", list(internal.values()), least, times, texts)
    tiles = table.where("kind = 1").select("row", "first", "start", "boundaries", "tile").repartition("row", "first", "start")
    found = _stitched(_solved(tiles, least, times), least, times)
    grouped = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    own = [*internal.values(), "n"]
    rows = table.where("kind = 0")
    none = F.array().cast(RUNS).alias("runs")
    done = rows.where("digest is not null").select(*own, none, F.col("digest").alias("collapsed_sha256"), F.col("words").alias("collapsed"))
    open_rows = rows.where("digest is null").join(grouped, "row", "left").select(*own, F.coalesce("runs", none).alias("runs"), "words")
    spans = F.transform("runs", lambda r: F.array(r["start"], r["length"], r["period"]))

    @F.pandas_udf("string")
    def collapse(words, runs):
        out = []
        for line, found in zip(words, runs):
            parts = line.split(" ") if line else []
            keep_it = kept_words(len(parts), [tuple(int(x) for x in r) for r in found])
            out.append(" ".join(w for w, k in zip(parts, keep_it) if k))
        return type(words)(out)

    closed = open_rows.withColumn("collapsed", F.when(F.size("runs") > 0, collapse("words", spans)).otherwise(F.col("words")))
    closed = closed.select(*own, "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"), "collapsed")
    out = done.unionByName(closed)
    names = [F.col(k).alias(c) for c, k in internal.items()]
    return out.select(*names, F.col("n").alias("n_words"), "runs", "collapsed_sha256", *(["collapsed"] if texts else []))


def best_run(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: the smallest start, then the smallest period; null if there is none."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        first = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"]))
        return F.when((x > y) | ((x == y) & first), a).otherwise(b)

    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.try_element_at(runs, F.lit(1)), better)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a repetition in about a tenth of the texts, by the CRC-32 of the key: from some word on, a text goes on with the
    first few words from there, again and again.  Rows without a key or words stay as they are."""
    h = F.crc32(F.col(key).cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))

    @F.pandas_udf("string")
    def repeated(texts, hashes):
        out = []
        for value, number in zip(texts, hashes):
            words, g = words_of(value), int(number or 0) // 10 if value else 0
            if words:
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                words[a:] = [words[a + i % p] for i in range(len(words) - a)]
            out.append(b" ".join(words).decode() if words else value)
        return type(texts)(out)

    changed = repeated(F.when(chosen, F.col(text)), F.when(chosen, h).otherwise(0))
    return docs.withColumn(text, F.when(chosen, changed).otherwise(F.col(text)))

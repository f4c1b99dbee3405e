"""Benchmark decontamination with DataFrame functions alone.

Both sides are reduced to words.  The hashes of the test items' n-word windows are a hash set: a bit array of bounded size,
made by an aggregation and sent to all tasks with the plan.  A scan hashes every window of every
document and keeps those whose bit is set; these are verified by a join with the windows themselves, text by text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, measured

#: Words are runs of ASCII letters and digits and of any other characters past ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of items, or contaminated rows, that may be broadcast (a few hundred bytes each); more are joined by a shuffle, dealt
#: over so many parts.
BROADCAST_ROWS, SALTS = 200_000, 16
#: Bits of the hash set for each window, and the bounds of their number: 8 KB and 1 MB.  With still more windows it lets more
#: through to the join, with the same results.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 23


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lowered; null: none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _hash(hashes: str | Column, start: Column, size: int) -> Column:
    """Hash of a window of words from the words' hashes; ``start`` counts from 1."""
    return F.xxhash64(F.slice(hashes, start, size))


def _starts(column: str, size: int) -> Column:
    """The places (from 1) where windows of ``size`` words begin; none in a shorter text."""
    return F.when(F.size(column) >= size, F.sequence(F.lit(1), F.size(column) - (size - 1))).otherwise(F.expr("cast(array() as array<int>)"))


def item_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """size, gram, item_id: the distinct n-word windows of the items; an item of fewer words is one window."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - n + 1))
    grams = items.select("item_id", F.explode(F.transform(places, lambda i: F.slice("words", i, n))).alias("g")).distinct()
    return grams.select(F.size("g").alias("size"), F.transform("g", lambda w: F.xxhash64(w)).alias("h"), F.array_join("g", " ").alias("gram"), "item_id").select("size", F.xxhash64("h").alias("hash"), "gram", "item_id")


def hash_set(windows: DataFrame, bits: int) -> Column:
    """The windows' hashes as a literal array of ``bits`` / 64 longs, a bit for each; no more than that passes the driver."""
    mask = F.expr(f"shiftleft(1L, cast(pmod(hash, {bits}) % 64 as int))")
    words = windows.select((F.pmod("hash", F.lit(bits)) / 64).cast("long").alias("id"), mask.alias("mask")).groupBy("id").agg(F.bit_or("mask").alias("mask"))
    held = {r["id"]: r["mask"] for r in words.collect()}
    return F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")  # folded before the run


def _found(size: int, held: Column, bits: int) -> Column:
    """start (from 0), size, hash, gram of the windows of a document whose bit is set."""
    every = F.transform(_starts("hashes", size), lambda i: F.struct(i.alias("i"), _hash("hashes", i, size).alias("h")))

    def is_set(w: Column) -> Column:
        place = F.pmod(w["h"], F.lit(bits))
        return F.get(held, (place / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))) != 0

    def shown(w: Column) -> Column:
        return F.struct((w["i"] - 1).alias("start"), F.lit(size).alias("size"), w["h"].alias("hash"), F.array_join(F.slice("words", w["i"], size), " ").alias("gram"))

    return F.transform(F.filter(every, is_set), shown)


def _hits(rows: DataFrame, windows: DataFrame, n: int, broadcast_rows: int) -> DataFrame:
    """doc_id, mark, n_words, start, size, item_id of every verified window, and a row without start for each row of ``rows``."""
    windows, small = measured(windows, "windows", broadcast_rows)
    counted = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # no more than n sizes
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * sum(counted.values())):
        bits *= 2
    held = hash_set(windows, bits)
    found = F.concat(F.array(F.lit(None).cast("struct<start:int,size:int,hash:bigint,gram:string>")), *[_found(size, held, bits) for size in sorted(counted)])
    keys = ["doc_id", "mark", "n_words"]
    each = rows.select(*keys, F.explode(found).alias("w")).select(*keys, "w.*")
    on = ["hash", "size", "gram"]
    if not small:  # a passage may stand in a large part of all documents
        each = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
        windows = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on.append("salt")
    joined = each.join(windows.withColumn("verified", F.lit(True)), on, "left")
    return joined.where("start is null or verified").select(*keys, "start", "size", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark (hash of the text), n_words, n_hit, n_items, item_ids, spans, contaminated.

    A document word inside any occurrence of an item's n-word window is hit; spans are the (start, size) of the windows found,
    in words.  Null or wordless texts: 0 words, not contaminated; items without words make no window; an item without an id
    counts for the hits but not for n_items.  Items with one id are one item.  Repeated rows give repeated results.  Empty
    tables: no rows, or no hits.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumns({"n_words": F.size("words").cast("long"), "hashes": F.transform("words", lambda w: F.xxhash64(w))})
    found = _hits(rows, item_windows(benchmark, n, item_col, item_text_col), n, broadcast_rows)
    span = F.when(F.col("start").isNotNull(), F.struct(F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size")))
    out = found.groupBy("doc_id", "mark", "n_words").agg(
        F.count_if(F.col("start").isNull()).alias("copies"),
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))

    def cover(seen: Column, s: Column) -> Column:
        end = s["start"] + s["size"]
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(seen["end"], s["start"]))
        return F.struct((seen["hit"] + new).alias("hit"), F.greatest(seen["end"], end).alias("end"))

    out = out.withColumn("n_hit", F.aggregate("spans", zero, cover, lambda s: s["hit"]))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
    return out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def _contaminated(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, columns: dict, broadcast_rows: int, *kept: str) -> tuple[DataFrame, Column, list[str]]:
    """The contaminated rows' keys (and ``kept``), each once, under names that ``docs`` has not; how to join them; and the names."""
    found = contamination(docs, benchmark, n, id_col, text_col, broadcast_rows=broadcast_rows, **columns).where("contaminated")
    names = [fresh(f"_{c}", docs.columns) for c in ("id", "mark", *kept)]
    found = found.dropDuplicates(["doc_id", "mark"]).select(*[F.col(c).alias(a) for c, a in zip(("doc_id", "mark", *kept), names)])
    found, _ = measured(found, "contaminated", broadcast_rows)
    return found, docs[id_col].eqNullSafe(F.col(names[0])) & (F.xxhash64(docs[text_col]) == F.col(names[1])), names


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **columns: str) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose text holds no window of any item.

    Null, empty and wordless texts stay; repeated rows stay or go together; rows without an id, or of one id, are told apart by
    their texts; an empty table gives none, an empty benchmark all rows.  Columns may have any names.
    """
    found, on, _ = _contaminated(docs, benchmark, n, id_col, text_col, columns, broadcast_rows)
    return docs.join(found, on, "left_anti")


def clean_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **columns: str) -> DataFrame:
    """All rows of ``docs``; the hit words, each with what follows it up to the next word, are cut out of the text.

    Null texts stay null, texts without hits as they were; repeated rows, ids and empty tables: as of ``clean_documents``.
    """
    found, on, (*_, spans) = _contaminated(docs, benchmark, n, id_col, text_col, columns, broadcast_rows, "spans")
    joined = docs.join(found, on, "left")
    words, rest = fresh("_words", joined.columns), fresh("_rest", joined.columns)
    anyword = WORD.replace(r"\x60", r"\x40\x5B-\x60")  # before lowering
    own = F.regexp_extract_all(text_col, F.lit(anyword), F.lit(0))
    joined = joined.withColumn(words, F.when(F.col(spans).isNotNull(), own)).withColumn(rest, F.when(F.col(spans).isNotNull(), F.split(text_col, anyword, -1)))
    keep = F.transform(words, lambda w, i: F.when(F.exists(spans, lambda s: (s["start"] <= i) & (i < s["start"] + s["size"])), F.lit("")).otherwise(F.concat(w, F.element_at(rest, i + 2))))
    cut = F.concat(F.element_at(rest, 1), F.array_join(keep, ""))
    return joined.select(*[(F.when(F.col(spans).isNotNull(), cut).otherwise(F.col(c)) if c == text_col else F.col(c)).alias(c) for c in docs.columns])

"""Quality filter: an interpolated modified Kneser-Ney character n-gram model of trusted text.

One pass counts the n-grams of all documents and of the trusted ones.  The model's tables (counts, continuation counts, context
totals, discounts) are groupings and joins over n-gram shards.  Every n-gram that occurs in any document is resolved to its
interpolated log probability by joining it with the tables of all orders.  The resolved table is cut into shards of at most
``SHARD_ROWS`` rows; the documents' n-gram counts are joined with one broadcast shard after another and summed per document where
they stand, so that neither texts nor counts are shuffled and no join holds more than a shard.  A language's threshold is an exact
quantile of its trusted documents' perplexities, found by counts per range of values and then by rank within one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .langid import _mixed, text_runs
from .shared import measured, stored

#: Highest order; the character that stands before a text.
ORDER, BEFORE = 4, "\x02"
#: Resolved n-grams of a shard at most (about 60 bytes each when broadcast); languages that may be broadcast.
SHARD_ROWS, BROADCAST_ROWS = 2_000_000, 200_000
#: Trusted ids that may be broadcast, so that texts stay where they are; to more of them the texts are joined by a shuffle, an id
#: that stands often (or none) dealt over so many parts.
BROADCAST_IDS, SALTS = 500_000, 16
#: Characters of typical text that temper the perplexity of short documents.
PRIOR = 40
#: Log probabilities are summed as whole numbers of this part of a nat, so that sums don't depend on their order; ranges of
#: values that a quantile is looked up in, per nat.
UNIT, RANGES = 1e-6, 200


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, digits as 0, white space as one space, each text after ORDER - 1 marks; and where each begins."""
    pad = BEFORE * (ORDER - 1)
    joined = pad + pad.join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    begins = np.cumsum([0] + [len(t) + ORDER - 1 for t in texts])
    codes[(codes >= 48) & (codes <= 57)] = 48
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0)
    codes[space] = 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[begins]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, the key of the n-gram that begins at each place, and the first place of each text; a text's last ORDER - 1 places are no n-grams."""
    codes, begins = _codes(texts)
    size = max(0, len(codes) - ORDER + 1)
    key = np.full(size, ORDER, np.uint64)
    for i in range(ORDER):
        key = key * np.uint64(0x100000001B3) + codes[i : i + size]
    return codes, _mixed(key), begins


def _inside(size: int, begins: np.ndarray) -> np.ndarray:
    inside = np.ones(size, bool)
    for back in range(1, ORDER):
        at = begins[1:] - back
        inside[at[(at >= 0) & (at < size)]] = False
    return inside


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams with their counts in all and in trusted rows, merged over as many rows as fit."""
    held: dict[int, list] = {}

    def flush() -> pa.RecordBatch:
        keys = np.fromiter(held, np.uint64, len(held)).view(np.int64)
        grams, n, trusted = zip(*held.values())
        out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(grams, pa.string()), pa.array(n, pa.int64()), pa.array(trusted, pa.int64())], ["key", "gram", "n", "trusted"])
        held.clear()
        return out

    for batch in batches:
        texts, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for flag in (False, True):
            rows = [t for t, f in zip(texts, flags) if bool(f) == flag and t]
            for first, last in text_runs(rows):
                codes, keys, begins = _grams(rows[first:last])
                own = np.flatnonzero(_inside(len(keys), begins))
                found, at, counts = np.unique(keys[own], return_index=True, return_counts=True)
                for key, place, n in zip(found.tolist(), own[at].tolist(), counts.tolist()):
                    if (entry := held.get(key)) is None:
                        entry = held[key] = [codes[place : place + ORDER].astype("<u4").tobytes().decode("utf-32-le", "replace"), 0, 0]
                    entry[1] += n
                    entry[2] += n * flag
                if len(held) > 400_000:
                    yield flush()
    if held:
        yield flush()


def _ctx():
    return F.expr("left(gram, length(gram) - 1)")


def _suffix():
    return F.expr("substring(gram, 2)")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    row = counts.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n = [max(1, row[f"n{i}"]) for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max((i + 1) - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) for i in range(3))


def model_tables(top: DataFrame) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Of each order: (gram, own) the discounted part of its probability, and (ctx, back) the weight of the lower order; and the
    number of characters. ``top``: gram, c of the highest order."""
    orders = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many different grams of the next order does it end
        orders[n] = orders[n + 1].groupBy(_suffix().alias("gram")).agg(F.count("*").alias("c"))
        orders[n] = stored(orders[n], f"order{n}")
    own, back = [], []
    for n in range(1, ORDER + 1):
        d1, d2, d3 = discounts(orders[n])
        rows = orders[n].withColumn("ctx", _ctx())
        total = rows.groupBy("ctx").agg(
            F.sum("c").alias("total"),
            (d1 * F.count_if(F.col("c") == 1) + d2 * F.count_if(F.col("c") == 2) + d3 * F.count_if(F.col("c") > 2)).alias("mass"),
        )
        total = stored(total, f"contexts{n}")
        less = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        own.append(rows.join(total, "ctx").select("gram", ((F.col("c") - less) / F.col("total")).alias("own")))
        back.append(total.select("ctx", (F.col("mass") / F.col("total")).alias("back")))
    return own, back, orders[1].count()


def resolve(grams: DataFrame, own: list[DataFrame], back: list[DataFrame], characters: int) -> DataFrame:
    """key, logp: the interpolated log probability (in UNITs) of the last character of each n-gram after the others."""
    rows = grams.select("key", "gram").withColumn("p", F.lit(1.0 / (characters + 1)))
    for n in range(1, ORDER + 1):
        part = F.expr(f"right(gram, {n})")
        a = own[n - 1].select(F.col("gram").alias("part"), "own")
        b = back[n - 1].select(F.col("ctx").alias("head"), "back")
        rows = rows.withColumn("part", part).withColumn("head", F.expr(f"left(part, {n - 1})"))
        rows = rows.join(a, "part", "left").join(b, "head", "left").drop("part", "head")
        # A context never seen leaves all weight to the lower order.
        rows = rows.withColumn("p", F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")).drop("own", "back")
    return rows.select("key", F.round(F.log("p") / UNIT).cast("long").alias("logp"))


def _gram_counts(shards: int, shard: int):
    """Of every text the n-grams of a shard with their counts, and one row without an n-gram that has the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for first, last in text_runs(texts):
                _, keys, begins = _grams(texts[first:last])
                inside = _inside(len(keys), begins)
                row, key, k, n = [], [], [], []
                for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
                    own = keys[a:b][inside[a:b]].view(np.int64)
                    found, counts = np.unique(own, return_counts=True)
                    if shards > 1:
                        mine = found % shards == shard
                        found, counts = found[mine], counts[mine]
                    row.append(np.full(len(found) + 1, first + i))
                    key += [found, np.zeros(1, np.int64)]
                    k += [counts.astype(np.int64), np.zeros(1, np.int64)]
                    n += [np.zeros(len(found), np.int64), np.full(1, len(own) + 1)]  # 1 more: each text once
                row, key, k, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, key, k, n))
                for a in range(0, len(row), 200_000):
                    at = slice(a, a + 200_000)
                    columns = [batch.column(c).take(pa.array(row[at])) for c in ("doc_id", "lang", "mark")]
                    key_column = pa.array(key[at], mask=n[at] > 0)
                    yield pa.RecordBatch.from_arrays([*columns, key_column, pa.array(k[at]), pa.array(n[at])], ["doc_id", "lang", "mark", "key", "k", "n"])

    return run


def scored_documents(docs: DataFrame, table: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, total (log probability, in UNITs) and n (characters scored) of each row of ``docs`` (doc_id, lang, text).

    ``table``: key, logp of every n-gram of the rows.
    """
    shards = max(1, -(-table.count() // shard_rows))
    rows = docs.withColumn("mark", F.xxhash64("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, mark long, key long, k long, n long"
    keys, every = ["doc_id", "lang", "mark"], None
    for i in range(shards):
        part = table if shards == 1 else table.where(F.pmod(F.pmod("key", F.lit(shards)) + shards, F.lit(shards)) == i)
        counts = rows.select("doc_id", "lang", "mark", "text").mapInArrow(_gram_counts(shards, i), schema)
        joined = counts.join(F.broadcast(part), "key", "left")  # a shard
        copies = F.count_if(F.col("n") > 0)
        sums = joined.groupBy(*keys).agg(F.sum(F.col("k") * F.coalesce("logp", F.lit(0))).alias("total"), (F.sum("n") - copies).alias("n"), copies.alias("copies"))
        sums = stored(sums, "sums")
        every = sums if every is None else every.union(sums)
    if shards > 1:
        every = every.groupBy(*keys).agg(F.sum("total").alias("total"), F.max("n").alias("n"), F.max("copies").alias("copies"))
    one = every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return one.select("doc_id", "lang", (F.col("total") / F.col("copies")).alias("total"), (F.col("n") / F.col("copies")).cast("long").alias("n"))


def exact_quantile(rows: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """``by``, quantile: the smallest value (above 0) that a part ``q`` of the group's values doesn't exceed."""
    values = stored(rows.groupBy(by, value).agg(F.count("*").alias("n")).withColumn("range", F.floor(F.log(value) * RANGES)), "values")
    ranges = values.groupBy(by, "range").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(by).orderBy("range")  # some thousand ranges at most
    ranges = ranges.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    ranges = ranges.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("all") * q - 1e-9)))
    place = ranges.where("upto - n < rank and rank <= upto").select(F.col(by).alias("_by"), F.col("range").alias("_range"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    inside = values.join(place, values[by].eqNullSafe(F.col("_by")) & (F.col("range") == F.col("_range")))
    seen = F.sum("n").over(Window.partitionBy(by).orderBy(value))
    return inside.withColumn("seen", seen).where("seen >= rank").groupBy(by).agg(F.min(value).alias("quantile"))


def flagged_texts(rows: DataFrame, good: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """text, trusted of each of ``rows`` (doc_id, text): whether its id is in ``good`` (_good, distinct), however many those are."""
    good, small = measured(good, "trusted", broadcast_ids)
    if small:  # texts stay where they are
        found = rows.join(good, F.col("doc_id") == F.col("_good"), "left")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        dealt = good.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.join(dealt.hint("shuffle_hash"), (F.col("doc_id") == F.col("_good")) & (F.col("_salt") == F.col("_part")), "left")
    return found.select("text", F.col("_good").isNotNull().alias("trusted"))


def score_quality(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.995, margin: float = 1.1, broadcast_ids: int = BROADCAST_IDS, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, trusted, n_chars_scored, perplexity, tempered, threshold, kept.

    Rows whose doc_id is in ``trusted_ids`` (column doc_id) are trusted; all of them train the model and set the thresholds, and
    the n-grams of all rows are resolved.  perplexity is per character, null for a null or empty
    text; tempered is the same with PRIOR characters of the trusted mean added, so that a few letters decide nothing.  threshold
    is ``margin`` times the ``quantile`` of the trusted rows of the language (null lang: ``und``), of all trusted rows where it
    has none; kept: tempered is not above it.  Without trusted rows every row is kept.  Repeated rows and ties give equal
    results, an empty table none; texts of any length are read whole; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    good = trusted_ids.select(F.col("doc_id").alias("_good")).where("_good is not null").distinct()
    counted = flagged_texts(rows.select("doc_id", "text"), good, broadcast_ids).mapInArrow(_counter, "key long, gram string, n long, trusted long")
    grams = stored(counted.groupBy("key").agg(F.first("gram").alias("gram"), F.sum("n").alias("n"), F.sum("trusted").alias("c")), "grams")
    top = stored(grams.where("c > 0").groupBy("gram").agg(F.sum("c").alias("c")), "top")
    own, back, characters = model_tables(top)
    table = stored(resolve(grams, own, back, characters), "resolved")
    scored = scored_documents(rows, table, shard_rows).join(good, F.col("doc_id") == F.col("_good"), "left")
    scored = stored(scored.withColumn("trusted", F.col("_good").isNotNull()).drop("_good"), "scored")
    mean = scored.where("trusted").agg((F.sum("total") / F.sum("n")).alias("m")).first()["m"] or 0.0
    rate = -(F.col("total") + PRIOR * F.lit(float(mean))) / (F.col("n") + PRIOR) * UNIT
    plain = F.when(F.col("n") > 0, F.round(F.exp(-F.col("total") / F.col("n") * UNIT), 6))
    scored = scored.withColumns({"perplexity": plain, "tempered": F.round(F.exp(rate), 6)})
    trusted = scored.where("trusted").select("lang", "tempered")
    limits = exact_quantile(trusted.union(trusted.select(F.lit(None).cast("string"), "tempered")), "lang", "tempered", quantile)  # null: of all
    limits, _ = measured(limits.withColumn("own", margin * F.col("quantile")), "limits", BROADCAST_ROWS)
    overall = limits.where("lang is null").first()
    out = scored.join(limits.select("lang", "own"), "lang", "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(overall["own"] if overall else None).cast("double")))
    kept = F.coalesce(F.col("tempered") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "trusted", F.col("n").alias("n_chars_scored"), "perplexity", "tempered", "threshold", kept.alias("kept"))

"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, greedy search walks it.

Equal vectors are one node of the graph.  Nodes are numbered along a few random hyperplanes and cut into blocks of ``BLOCK``; a
block is one row of a table, its nodes' vectors and neighbour lists packed in arrays.  Each round joins neighbours of neighbours
by messages between blocks: edges go to the block of the neighbour, which so learns its reverse neighbours; every node sends its vector
once to each block that holds a neighbour; there all pairs around a node with at least one new edge are compared, and pairs better than
the worst entry of a list go back to that list's block.  Rounds end when few edges are new.  A search keeps a beam per query: the
best open entries are sent to their blocks, whose lists are sent on to the blocks of the candidates, which score them against
the query and send back what beats the beam.  A task holds a block and what is addressed to it, so none holds the vectors of all.

Lists are ordered by inner product as well, so with vectors of different norms they lead to the long ones, where the results lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import numbered, replaced, stored

#: Nodes of a block; hyperplanes that order the nodes; nodes compared at once.
BLOCK, PLANES, CHUNK = 8192, 16, 128
#: Candidate pairs that a block holds before it keeps the best per list.
PAIRS = 4_000_000
MESSAGE = "to bigint, kind int, a binary, b binary, c binary, d binary, e binary"
GRAPH = "block bigint, at binary, vector binary, near binary, sim binary, old binary, fresh bigint"
STATE = "block bigint, at binary, vector binary, ids binary, scores binary, done binary, open bigint"


@dataclass(frozen=True)
class Shape:
    """What all blocks have in common: nodes, blocks, components of a vector and their type, largest norm, length of a list."""

    nodes: int
    blocks: int
    width: int
    kind: str
    norm: float
    degree: int

    def owner(self, at: np.ndarray) -> np.ndarray:
        return at * self.blocks // self.nodes

    def linked(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors in single precision, scaled by the largest norm, so that inner products stay in range."""
        return (vectors.astype(np.float64) / self.norm).astype(np.float32)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vector: distinct rows with an id whose vector is not null or zero and has only finite components, as many as most have."""
    v = F.col(f"`{vector}`")
    ok = v.isNotNull() & F.col(f"`{key}`").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    whole = rows.where(ok).select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0).cast(rows.schema[vector].dataType.elementType)).alias("vector"))
    widths = whole.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()  # one row
    return whole.where(F.size("vector") == (widths[0].w if widths else 0)).distinct()


def _parts(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each owner with the places that are its own."""
    order = np.argsort(owner, kind="stable")
    sorted_owner = owner[order]
    for part in np.split(order, np.flatnonzero(np.diff(sorted_owner)) + 1) if len(order) else ():
        yield int(owner[part[0]]), part


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _message(to: int, kind: int = 0, **parts: np.ndarray) -> dict:
    return {"to": to, "kind": kind} | {k: np.ascontiguousarray(v).tobytes() for k, v in parts.items()}


def _lists(size: int, places: np.ndarray, keys: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """size x most values: those of each place with the smallest keys, padded by -1."""
    order = np.lexsort((keys, places))
    places, values = places[order], values[order]
    rank = np.arange(len(places)) - np.searchsorted(places, places)
    out = np.full((size, most), -1, values.dtype)
    out[places[rank < most], rank[rank < most]] = values[rank < most]
    return out


def _best(places: np.ndarray, ids: np.ndarray, scores: np.ndarray, done: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """places, ids, scores, done and rank of the ``most`` best different ids of each place; of equal ids a done one counts."""
    order = np.lexsort((~done, ids, places))
    places, ids, scores, done = places[order], ids[order], scores[order], done[order]
    first = np.ones(len(places), bool)
    first[1:] = (places[1:] != places[:-1]) | (ids[1:] != ids[:-1])
    places, ids, scores, done = places[first], ids[first], scores[first], done[first]
    order = np.lexsort((ids, -scores, places))
    places, ids, scores, done = places[order], ids[order], scores[order], done[order]
    rank = np.arange(len(places)) - np.searchsorted(places, places)
    ok = rank < most
    return places[ok], ids[ok], scores[ok], done[ok], rank[ok]


def _unpacked(row, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """at, vectors, near, sim, old of a block."""
    at, k = np.frombuffer(row["at"], np.int64), shape.degree
    vectors = np.frombuffer(row["vector"], shape.kind).reshape(len(at), shape.width)
    return at, vectors, np.frombuffer(row["near"], np.int64).reshape(-1, k), np.frombuffer(row["sim"], np.float32).reshape(-1, k), np.frombuffer(row["old"], bool).reshape(-1, k)


def _block_row(block: int, at, vectors, near, sim, old) -> dict:
    parts = {"at": at, "vector": vectors, "near": near, "sim": sim, "old": old}
    return {"block": block} | {k: np.ascontiguousarray(v).tobytes() for k, v in parts.items()} | {"fresh": int((~old & (near >= 0)).sum())}


def _within(linked: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores, falling, of the ``most`` best others of each vector among the same vectors."""
    near, sim = np.zeros((len(linked), most), np.int64), np.zeros((len(linked), most), np.float32)
    for a in range(0, len(linked) if most else 0, 1024):
        s = linked[a : a + 1024] @ linked.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, most - 1, axis=1)[:, :most]
        own = np.take_along_axis(s, top, axis=1)
        order = np.argsort(-own, axis=1)
        near[a : a + 1024], sim[a : a + 1024] = np.take_along_axis(top, order, axis=1), np.take_along_axis(own, order, axis=1)
    return near, sim


def _begun(nodes: DataFrame, shape: Shape) -> DataFrame:
    """The first lists: each node's best within its own block and, so that blocks are linked, within a random group."""

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        at, vectors = pdf["at"].to_numpy(np.int64), np.stack(pdf["vector"].to_numpy()).astype(shape.kind)
        most = min(shape.degree, len(at) - 1)
        near, sim = np.full((len(at), shape.degree), -1, np.int64), np.full((len(at), shape.degree), -np.inf, np.float32)
        places, sim[:, :most] = _within(shape.linked(vectors), most)
        near[:, :most] = at[places]
        return _frame([_block_row(int(pdf["block"].iloc[0]), at, vectors, near, sim, np.zeros(near.shape, bool))], GRAPH)

    def others(pdf: pd.DataFrame) -> pd.DataFrame:
        at, vectors = pdf["at"].to_numpy(np.int64), np.stack(pdf["vector"].to_numpy()).astype(shape.kind)
        places, sim = _within(shape.linked(vectors), min(shape.degree, len(at) - 1))
        a, b, c = np.repeat(at, places.shape[1]), at[places].ravel(), sim.ravel()
        return _frame([_message(to, a=a[p], b=b[p], c=c[p]) for to, p in _parts(shape.owner(a))], MESSAGE)

    group = F.pmod(F.xxhash64("at"), F.lit(4 * shape.blocks)).alias("group")  # a quarter of a block each
    found = nodes.select(group, "at", "vector").groupBy("group").applyInPandas(others, MESSAGE)
    return _improved(nodes.groupBy("block").applyInPandas(own, GRAPH), found, shape, compared=False)


def _edges(graph: DataFrame, shape: Shape) -> DataFrame:
    """Every edge as a message to the block of the neighbour: a neighbours, b nodes, c whether the edge is new."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                at, _, near, _, old = _unpacked(row, shape)
                target, source, new = near.ravel(), np.repeat(at, shape.degree), ~old.ravel()
                real = target >= 0
                target, source, new = target[real], source[real], new[real]
                yield _frame([_message(to, a=target[p], b=source[p], c=new[p]) for to, p in _parts(shape.owner(target))], MESSAGE)

    return graph.select("block", "at", "vector", "near", "sim", "old").mapInPandas(run, MESSAGE)


def _introduced(graph: DataFrame, edges: DataFrame, shape: Shape, seed: int) -> DataFrame:
    """For each block the lists around its nodes (kind 0: a members, b whether new) and the members' vectors (kind 1: a nodes,
    b vectors, c the score that beats their lists)."""

    def run(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        at, vectors, near, sim, old = _unpacked(own.iloc[0], shape)
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in sent[c]]) if len(sent) else np.zeros(0, t)
        mine, source, new = read("a", np.int64), read("b", np.int64), read("c", bool)
        mixed = (source * 2654435761 + mine * 40503 + seed * 97) % 1_000_003
        reverse = _lists(len(at), mine - at[0], mixed, source * 2 + new, shape.degree)
        members = np.concatenate([near, np.where(reverse < 0, -1, reverse >> 1)], axis=1)
        fresh = np.concatenate([~old & (near >= 0), (reverse >= 0) & (reverse & 1 == 1)], axis=1)
        block = int(own["block"].iloc[0])
        out = [_message(block, 0, a=members, b=fresh)]
        links = near.ravel() >= 0
        to = shape.owner(np.concatenate([near.ravel()[links], source, at]))  # its own block holds pairs of the node as well
        who = np.concatenate([np.repeat(np.arange(len(at)), shape.degree)[links], mine - at[0], np.arange(len(at))])
        pairs = np.unique(to * len(at) + who)
        linked = shape.linked(vectors)
        for target, part in _parts(pairs // len(at)):
            p = pairs[part] % len(at)
            out.append(_message(target, 1, a=at[p], b=linked[p], c=sim[p, -1]))
        return _frame(out, MESSAGE)

    return graph.groupBy("block").cogroup(edges.groupBy("to")).applyInPandas(run, MESSAGE)


def _compared(sent: DataFrame, shape: Shape) -> DataFrame:
    """Pairs around the nodes of a block, one of them at least by a new edge, that beat a list: messages to the list's block (a
    list's node, b the other, c score)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, others = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in others["a"]])
        vectors = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, shape.width) for x in others["b"]])
        worst = np.concatenate([np.frombuffer(x, np.float32) for x in others["c"]]).copy()
        order = np.argsort(ids)
        ids, vectors, worst = ids[order], vectors[order], worst[order]
        members = np.frombuffer(own["a"].iloc[0], np.int64).reshape(-1, 2 * shape.degree)
        fresh = np.frombuffer(own["b"].iloc[0], bool).reshape(members.shape)
        places = np.searchsorted(ids, np.maximum(members, ids[0]))
        active = np.flatnonzero(fresh.any(axis=1))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        kept, waiting, size = none, [], 0

        def settle():
            nonlocal kept, waiting, size
            a, b, s = (np.concatenate(x) for x in zip(kept, *waiting))
            a, b, s, _, rank = _best(a, b, s, np.zeros(len(a), bool), shape.degree)
            full = rank == shape.degree - 1
            worst[a[full]] = np.maximum(worst[a[full]], s[full])
            kept, waiting, size = (a, b, s), [], 0

        for c in range(0, len(active), CHUNK):
            rows = active[c : c + CHUNK]
            place, real, new = places[rows], members[rows] >= 0, fresh[rows]
            v = vectors[place]
            s = v @ v.transpose(0, 2, 1)
            ok = (s > worst[place][:, :, None]) & real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :]) & (place[:, :, None] != place[:, None, :])
            i, j, k = np.nonzero(ok)
            waiting.append((place[i, j], place[i, k], s[i, j, k]))
            size += len(i)
            if size > PAIRS:
                settle()
        settle()
        a, b, s = ids[kept[0]], ids[kept[1]], kept[2]
        return _frame([_message(to, a=a[p], b=b[p], c=s[p]) for to, p in _parts(shape.owner(a))], MESSAGE)

    return sent.groupBy("to").applyInPandas(run, MESSAGE)


def _improved(graph: DataFrame, found: DataFrame, shape: Shape, compared: bool = True) -> DataFrame:
    """The graph with the better edges; those that it had are old, if they were compared."""

    def run(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        at, vectors, near, sim, old = _unpacked(own.iloc[0], shape)
        real = near.ravel() >= 0
        places, ids, scores = [np.repeat(np.arange(len(at)), shape.degree)[real]], [near.ravel()[real]], [sim.ravel()[real]]
        for a, b, c in zip(sent["a"], sent["b"], sent["c"]):
            places.append(np.frombuffer(a, np.int64) - at[0])
            ids.append(np.frombuffer(b, np.int64))
            scores.append(np.frombuffer(c, np.float32))
        done = np.zeros(sum(map(len, ids)), bool)
        done[: len(ids[0])] = compared | old.ravel()[real]
        place, other, score, done, rank = _best(np.concatenate(places), np.concatenate(ids), np.concatenate(scores), done, shape.degree)
        near, sim, old = np.full(near.shape, -1, np.int64), np.full(near.shape, -np.inf, np.float32), np.ones(near.shape, bool)
        near[place, rank], sim[place, rank], old[place, rank] = other, score, done
        return _frame([_block_row(int(own["block"].iloc[0]), at, vectors, near, sim, old)], GRAPH)

    return graph.groupBy("block").cogroup(found.groupBy("to")).applyInPandas(run, GRAPH)


def neighbour_graph(nodes: DataFrame, shape: Shape, settled: float = 0.02, rounds: int = 30) -> DataFrame:
    """The stored graph (a row per block) once at most a part ``settled`` of its edges is new."""
    graph, last = replaced(_begun(nodes, shape), "neighbour_graph")
    for i in range(rounds):
        found = _compared(_introduced(graph, _edges(graph, shape), shape, i), shape)
        graph, last = replaced(_improved(graph, found, shape), "neighbour_graph", last)
        if graph.agg(F.sum("fresh")).first()[0] <= settled * shape.degree * shape.nodes:
            break
    return graph


def _open_entries(ids: np.ndarray, done: np.ndarray, step: int) -> np.ndarray:
    """Which entries of each beam (by falling score) are expanded next: the first ``step`` open ones."""
    is_open = ~done & (ids >= 0)
    return is_open & (np.cumsum(is_open, axis=1) <= step)


def search(graph: DataFrame, asked: DataFrame, shape: Shape, beam: int = 160, step: int = 40, rounds: int = 200) -> DataFrame:
    """The beams (a row per block of query nodes) of the nodes ``asked`` (block, at) when no entry is open.

    Each round expands up to ``step`` open entries of every beam.
    """

    def begin(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        at, vectors, *_ = _unpacked(own.iloc[0], shape)
        if not len(sent):
            return _frame([], STATE)
        q = np.unique(sent["at"].to_numpy(np.int64))
        v = vectors[q - at[0]]
        ids, scores, done = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf), np.zeros((len(q), beam), bool)
        ids[:, 0], scores[:, 0] = q, (v.astype(np.float64) ** 2).sum(axis=1)
        return _frame([_state_row(int(own["block"].iloc[0]), q, v, ids, scores, done)], STATE)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                q, v, ids, scores, done = _state(row, shape, beam)
                i, j = np.nonzero(_open_entries(ids, done, step))
                yield _frame([_query_message(to, ids[i, j][p], i[p], q, v, scores[:, -1], 0) for to, p in _parts(shape.owner(ids[i, j]))], MESSAGE)

    def pass_on(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        at, _, near, _, _ = _unpacked(own.iloc[0], shape)
        out = []
        for row in sent.itertuples():
            node, i, q, v, worst = _queries(row, shape)
            other, i = near[node - at[0]].ravel(), np.repeat(i, shape.degree)
            pairs = np.unique(np.column_stack([i, other])[other >= 0], axis=0)
            out += [_query_message(to, pairs[p, 1], pairs[p, 0], q, v, worst, 0) for to, p in _parts(shape.owner(pairs[:, 1]))]
        return _frame(out, MESSAGE)

    def score(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        at, vectors, *_ = _unpacked(own.iloc[0], shape)
        out = []
        for row in sent.itertuples():
            node, i, q, v, worst = _queries(row, shape)
            for a in range(0, len(node), 1 << 16):
                n, k = node[a : a + (1 << 16)], i[a : a + (1 << 16)]
                s = np.einsum("ij,ij->i", vectors[n - at[0]].astype(np.float64), v[k].astype(np.float64))
                good = s > worst[k]
                out += [_message(to, a=q[k[good]][p], b=n[good][p], c=s[good][p]) for to, p in _parts(shape.owner(q[k[good]]))]
        return _frame(out, MESSAGE)

    def take(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        q, v, ids, scores, done = _state(own.iloc[0], shape, beam)
        done = done | _open_entries(ids, done, step)
        real = ids.ravel() >= 0
        place, other, value, seen = [np.repeat(np.arange(len(q)), beam)[real]], [ids.ravel()[real]], [scores.ravel()[real]], [done.ravel()[real]]
        for a, b, c in zip(sent["a"], sent["b"], sent["c"]):
            place.append(np.searchsorted(q, np.frombuffer(a, np.int64)))
            other.append(np.frombuffer(b, np.int64))
            value.append(np.frombuffer(c, np.float64))
            seen.append(np.zeros(len(other[-1]), bool))
        p, o, s, d, rank = _best(np.concatenate(place), np.concatenate(other), np.concatenate(value), np.concatenate(seen), beam)
        ids, scores, done = np.full(ids.shape, -1, np.int64), np.full(ids.shape, -np.inf), np.zeros(ids.shape, bool)
        ids[p, rank], scores[p, rank], done[p, rank] = o, s, d
        return _frame([_state_row(int(own["block"].iloc[0]), q, v, ids, scores, done)], STATE)

    blocks = graph.groupBy("block")
    state, last = replaced(blocks.cogroup(asked.groupBy("block")).applyInPandas(begin, STATE), "neighbour_beams")
    for _ in range(rounds):
        if not (state.agg(F.sum("open")).first()[0] or 0):
            break
        questions = state.mapInPandas(ask, MESSAGE)
        candidates = blocks.cogroup(questions.groupBy("to")).applyInPandas(pass_on, MESSAGE)
        scored = blocks.cogroup(candidates.groupBy("to")).applyInPandas(score, MESSAGE)
        state, last = replaced(state.groupBy("block").cogroup(scored.groupBy("to")).applyInPandas(take, STATE), "neighbour_beams", last)
    return state


def _state_row(block: int, at, vectors, ids, scores, done) -> dict:
    parts = {"at": at, "vector": vectors, "ids": ids, "scores": scores, "done": done}
    return {"block": block} | {k: np.ascontiguousarray(v).tobytes() for k, v in parts.items()} | {"open": int((~done & (ids >= 0)).sum())}


def _state(row, shape: Shape, beam: int) -> tuple[np.ndarray, ...]:
    at = np.frombuffer(row["at"], np.int64)
    vectors = np.frombuffer(row["vector"], shape.kind).reshape(len(at), shape.width)
    return at, vectors, np.frombuffer(row["ids"], np.int64).reshape(-1, beam), np.frombuffer(row["scores"], np.float64).reshape(-1, beam), np.frombuffer(row["done"], bool).reshape(-1, beam)


def _query_message(to: int, node, i, q, v, worst, kind: int) -> dict:
    """Nodes with the queries that ask for them; i points into the queries, whose vectors and bounds come along once."""
    used, i = np.unique(i, return_inverse=True)
    return _message(to, kind, a=node, b=i.astype(np.int32), c=q[used], d=v[used], e=worst[used])


def _queries(row, shape: Shape) -> tuple[np.ndarray, ...]:
    q = np.frombuffer(row.c, np.int64)
    return np.frombuffer(row.a, np.int64), np.frombuffer(row.b, np.int32), q, np.frombuffer(row.d, shape.kind).reshape(len(q), -1), np.frombuffer(row.e, np.float64)


def nearest(rows: DataFrame, key: str, vector: str, asked: Column, top: int = 20, degree: int = 40, beam: int = 160, settled: float = 0.02, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``asked`` (a condition on ``id``) holds, the ``top`` rows of the largest
    inner product that the search finds, its own left out; ties go to the smaller id.  ``score`` is the inner product of the
    vectors as they are, in double precision.

    ``degree`` is the length of neighbour lists, ``beam`` the entries a search keeps (more than ``top``), ``block`` the nodes a task
    holds; the first two are the index's and the search's precision, not limits on rows: every row is indexed and found by its node, and rows of equal vectors
    are listed up to ``top`` of the smallest ids, which is all that a result can hold.

    Rows without an id, and vectors that are null, zero, hold null or non-finite components or are of another length than most,
    take no part; repeated rows count once; of rows that share an id each is a candidate of its own; an empty table, and a table
    without a query, give no rows; other columns are not read.
    """
    if not 0 < top < beam:
        raise ValueError("the beam must be longer than the result")
    spark = rows.sparkSession
    whole = stored(usable(rows.select(f"`{key}`", f"`{vector}`"), key, vector), "vectors")
    order = Window.partitionBy("vector").orderBy("id")
    first = whole.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top + 1)
    classes = first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # top + 1 rows each at most

    @F.pandas_udf("long")
    def cell(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int64")
        stack = np.stack(vectors.to_numpy())
        bits = stack @ np.random.default_rng(0).standard_normal((stack.shape[1], PLANES)) > 0
        return pd.Series((bits * (1 << np.arange(PLANES)[::-1])).sum(axis=1))

    placed = numbered(classes.select(F.lit("").alias("all"), cell("vector").alias("cell"), "ids", "vector"), "all", ["cell", "ids"], "vectors_sorted")
    placed = stored(placed.drop("all", "cell"), "vectors_placed")
    sizes = placed.agg(F.count("*"), F.max(F.size("vector")), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not sizes[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "f4" if "float" in dict(rows.dtypes)[vector] else "f8"
    shape = Shape(sizes[0], max(1, -(-sizes[0] // block)), sizes[1], kind, float(sizes[2]) * (1 + 1e-9), degree)
    nodes = placed.withColumn("block", F.expr(f"at * {shape.blocks} div {shape.nodes}"))
    graph = neighbour_graph(nodes.select("block", "at", "vector"), shape, settled)

    queries = stored(whole.where(asked).join(nodes.select("vector", "at", "block"), "vector").select("id", "at", "block"), "vector_queries")
    state = search(graph, queries.select("block", "at").distinct(), shape, beam)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                q, _, ids, scores, _ = _state(row, shape, beam)
                limit = np.sort(scores, axis=1)[:, -(top + 1)][:, None]  # nodes that tie with the last stay
                i, j = np.nonzero((ids >= 0) & (scores >= limit))
                yield pd.DataFrame({"query": q[i], "at": ids[i, j], "score": scores[i, j]})

    hits = state.select("block", "at", "vector", "ids", "scores", "done").mapInPandas(unpack, "query bigint, at bigint, score double")
    members = hits.join(placed.select("at", "ids"), "at").select("query", "score", F.explode("ids").alias("id"), "at")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id", "at")
    best = members.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= top + 1)
    found = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "at", "score"))).alias("found"))
    rest = F.slice(F.filter("found", lambda r: (r["id"] != F.col("own")) | (r["at"] != F.col("query"))), 1, top)
    answers = queries.select(F.col("at").alias("query"), F.col("id").alias("own")).join(found, "query").select("own", F.posexplode(rest).alias("rank", "r"))
    return answers.select(F.col("own").alias("query_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("r.id").alias("vec_id"), F.col("r.score").alias("score"))

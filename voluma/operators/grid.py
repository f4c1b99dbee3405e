"""Neighbourhoods, components and topology of sparse voxel tables.

A table of voxels has group columns (``by``; a volume, a method, a slab) and the coordinates z, y, x.  Absent voxels are
background.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AXES = ("z", "y", "x")
#: Voxels of a tile by axis: at most 2^18 runs, which a task joins at once.
TILE = {"z": 32, "y": 32, "x": 512}
#: So many links are joined at once, by one task a group; more of them by rounds over tables.
AT_ONCE = 500_000


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Offsets of the 6, 18 or 26 neighbours."""
    reach = {6: 1, 18: 2, 26: 3}.get(connectivity)
    if reach is None or isinstance(connectivity, bool):
        raise ValueError("connectivity must be 6, 18 or 26")
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    return [o for o in around if 0 < sum(map(abs, o)) <= reach]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, spark.checkpoint.dir; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to and read back from the shared checkpoint folder: no lineage, and no statistics that grow by rounds."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of sort-merge joins alone: sorted coordinates are so few bytes in Parquet that Spark would broadcast millions of them."""
    return df.hint("merge")


def shifted(voxels: DataFrame, by: Sequence[str], connectivity: int = 6) -> DataFrame:
    """by, z, y, x of every neighbour of the voxels, once for each voxel it is next to."""
    each = F.array(*[F.struct(*[F.lit(d).alias(a) for d, a in zip(o, AXES)]) for o in offsets(connectivity)])
    rows = voxels.select(*by, *AXES, F.explode(each).alias("o"))
    return rows.select(*by, *[(F.col(a) + F.col(f"o.{a}")).cast(dict(voxels.dtypes)[a]).alias(a) for a in AXES])


def touching(voxels: DataFrame, front: DataFrame, by: Sequence[str], connectivity: int = 6) -> DataFrame:
    """The voxels next to a voxel of ``front``."""
    return voxels.join(merged(shifted(front, by, connectivity)), [*by, *AXES], "left_semi")


def runs_of(voxels: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, z, y, start, x0, x1: the runs of voxels along x; ``start`` tells the runs of a line apart."""
    line = Window.partitionBy(*by, "z", "y").orderBy("x")
    rows = voxels.select(*by, *AXES).distinct().withColumn("start", F.col("x") - F.row_number().over(line))
    return rows.groupBy(*by, "z", "y", "start").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))


def background_runs(runs: DataFrame, by: Sequence[str], pad: int = 1) -> DataFrame:
    """The same of the voxels that are absent within the box of each group, grown by ``pad`` on all sides; no voxel is listed."""
    box = runs.groupBy(*by).agg(*[F.min(c).alias(f"{c}_low") for c in ("z", "y", "x0")], *[F.max(c).alias(f"{c}_high") for c in ("z", "y", "x1")])
    ends = box.select(*by, (F.col("x0_low") - pad - 1).alias("first"), (F.col("x1_high") + pad + 1).alias("last"))
    lines = box.withColumn("z", F.explode(F.sequence(F.col("z_low") - pad, F.col("z_high") + pad)))
    lines = lines.withColumn("y", F.explode(F.sequence(F.col("y_low") - pad, F.col("y_high") + pad)))
    before = lines.select(*by, "z", "y", (F.col("x0_low") - pad - 1).alias("x0"), (F.col("x0_low") - pad - 1).alias("x1"))
    every = runs.select(*by, "z", "y", "x0", "x1").union(before)
    after = F.lead("x0").over(Window.partitionBy(*by, "z", "y").orderBy("x0"))
    gaps = every.withColumn("after", after).join(F.broadcast(ends), list(by))  # a row per group
    gaps = gaps.select(*by, "z", "y", (F.col("x1") + 1).alias("x0"), (F.coalesce("after", "last") - 1).alias("x1")).where("x0 <= x1")
    return gaps.select(*by, "z", "y", F.col("x0").alias("start"), "x0", "x1")


def _tiled(at: str) -> Column:
    return F.floor(F.col(at) / TILE[at[-1]]).cast("int")


def _local_roots(runs: pa.Table, lines: dict[tuple[int, int], int]) -> np.ndarray:
    """For each run of a tile the place of the smallest run that it reaches within the tile; runs are in the order of z, y, p0."""
    z, y, first, last = (runs[c].to_numpy().astype(np.int64) for c in ("z", "y", "p0", "p1"))
    low, wide = first.min() - 2, last.max() - first.min() + 6
    high = y.max() - y.min() + 3
    line = (z - z.min()) * high + (y - y.min())
    begins, ends = line * wide + (first - low), line * wide + (last - low)
    u, v = [], []
    for (dz, dy), r in lines.items():
        there = line + dz * high + dy
        a, b = np.searchsorted(ends, there * wide + (first - low - r)), np.searchsorted(begins, there * wide + (last - low + r), side="right")
        n = np.maximum(b - a, 0)
        u.append(np.repeat(np.arange(len(z)), n))
        v.append(np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n))
    return joined_roots(len(z), np.concatenate(u), np.concatenate(v))


def joined_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that it reaches over the links u, v."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def run_components(runs: DataFrame, by: Sequence[str], connectivity: int) -> DataFrame:
    """``runs`` with component, the smallest run (z, y, x0) reachable over runs of neighbouring lines that touch.

    Runs are cut at the borders of tiles of TILE voxels and joined within each tile by one task, in arrays of a tile's size; only
    what touches across a border is left as a link of the tiles' components.
    """
    by = list(by)
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    lines = {(dz, dy): max(dx for dx in (0, 1) if abs(dz) + abs(dy) + dx <= most) for dz, dy, _ in offsets(connectivity) if (dz, dy) > (0, 0)}
    names = ["z", "y", "start", "x0", "x1"]
    wide = TILE["x"]
    cut = runs.select(*by, *names, _tiled("z").alias("_tz"), _tiled("y").alias("_ty"), F.explode(F.sequence(F.floor(F.col("x0") / wide).cast("int"), F.floor(F.col("x1") / wide).cast("int"))).alias("_tx"))
    p0, p1 = F.greatest("x0", F.col("_tx") * wide), F.least("x1", F.col("_tx") * wide + wide - 1)
    cut = cut.withColumns({"p0": p0.cast("int"), "p1": p1.cast("int"), "_rz": F.lit(0), "_ry": F.lit(0), "_rx": F.lit(0)})

    def solved(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([(c, "ascending") for c in ("z", "y", "p0")])
        root = _local_roots(tile, lines)
        for c, source in (("_rz", "z"), ("_ry", "y"), ("_rx", "p0")):
            tile = tile.set_column(tile.column_names.index(c), tile.schema.field(c), pa.array(tile[source].to_numpy()[root], tile.schema.field(c).type))
        return tile

    found = cut.groupBy(*by, "_tz", "_ty", "_tx").applyInArrow(solved, cut.schema)
    x0 = dict(runs.dtypes)
    root = F.struct(*[F.col(c).cast(x0[n]).alias(n) for c, n in (("_rz", "z"), ("_ry", "y"), ("_rx", "x0"))])
    found = saved(found.select(*by, *names, "p0", "p1", "_tz", "_ty", "_tx", root.alias("root")), "tiles")

    edge = {"z": F.pmod("z", F.lit(TILE["z"])), "y": F.pmod("y", F.lit(TILE["y"]))}
    rim = found.where(edge["z"].isin(0, TILE["z"] - 1) | edge["y"].isin(0, TILE["y"] - 1) | (F.col("p0") == F.col("_tx") * wide) | (F.col("p1") == F.col("_tx") * wide + wide - 1))
    steps = [(dz, dy, dx, r) for (dz, dy), r in sorted(lines.items()) for dx in (-1, 0, 1) if dx == 0 or r] + [(0, 0, 1, 1)]
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dz", "dy", "dx", "r"), step)]) for step in steps])
    left = rim.select(*by, "z", "y", "p0", "p1", "_tz", "_ty", "_tx", F.col("root").alias("_u"), F.explode(each).alias("o"))
    left = left.select(*by, "_tz", "_ty", (F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("_tx") + F.col("o.dx")).alias("_tx"), F.col("p0").alias("a0"), F.col("p1").alias("a1"), F.col("o.r").alias("r"), F.col("o.dx").alias("dx"), "_u")
    crossing = (F.col("dx") != 0) | (_tiled("z") != F.col("_tz")) | (_tiled("y") != F.col("_ty"))
    reaches = (F.col("a1") + F.col("r") >= F.col("_tx") * wide) & (F.col("a0") - F.col("r") < F.col("_tx") * wide + wide)
    left = left.where(crossing & reaches).drop("_tz", "_ty", "dx")
    right = rim.select(*by, "z", "y", "_tx", "p0", "p1", F.col("root").alias("_v"))
    links = left.join(merged(right), [*by, "z", "y", "_tx"]).where((F.col("a0") <= F.col("p1") + F.col("r")) & (F.col("p0") <= F.col("a1") + F.col("r")))
    named = _stars(links.select(*by, "_u", "_v"), by).withColumnRenamed("run", "root")
    whole = found.where("p0 = x0").select(*by, *names, "root")  # a run's first piece stands for it
    return whole.join(merged(named), [*by, "root"], "left").withColumn("component", F.coalesce("component", "root")).drop("root").select(*runs.columns, "component")


def components(voxels: DataFrame, by: Sequence[str], connectivity: int = 6) -> DataFrame:
    """by, z, y, x, component: the connected components, each named by the smallest run of its voxels.

    Rows of voxels along x are first collapsed to runs, runs are joined within tiles, and the graph of what touches across tiles
    is contracted by alternating large and small stars, so a volume may be larger than any executor.
    """
    offsets(connectivity)  # checks it
    return voxels_of(run_components(runs_of(voxels, by), by, connectivity), by)


def voxels_of(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The voxels of labelled runs."""
    return runs.select(*by, "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "component")


def _stars(links: DataFrame, by: list[str], rounds: int = 60) -> DataFrame:
    """by, run, component: the smallest node reachable over the links u, v; nodes are structs of whole numbers."""

    def step(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            sides = edges.union(edges.select(*by, F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        else:
            sides = edges.select(*by, F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v"))
        least = sides.groupBy(*by, "_u").agg(F.min("_v").alias("_m")).withColumn("_m", F.least("_u", "_m"))
        joined = sides.join(merged(least), [*by, "_u"])
        out = joined.where("_v > _u") if large else joined
        out = out.select(*by, F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        if not large:
            out = out.union(least.select(*by, "_u", F.col("_m").alias("_v")))
        return out.where("_u <> _v").distinct()

    def kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges as a table, and a mark of them that is taken while they are written."""
        seen = Observation()
        out = saved(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*by, "_u", "_v")).alias("x")), "links")
        return out, tuple(seen.get[k] for k in ("n", "x"))

    def solved(links: pa.Table) -> pa.Table:
        u, v = ([links[f"{side}{c}"].to_numpy() for c in coordinates] for side in "uv")
        nodes, at = np.unique(np.stack([np.concatenate(c) for c in zip(u, v)], axis=1), axis=0, return_inverse=True)
        at, n = at.ravel(), len(links)
        root = nodes[joined_roots(len(nodes), at[:n], at[n:])]
        own = links.select(by).take(np.zeros(len(nodes), dtype=np.int64))
        made = {f"{name}{c}": side[:, i] for name, side in (("u", nodes), ("v", root)) for i, c in enumerate(coordinates)}
        return pa.table({**{c: own[c] for c in by}, **{c: pa.array(x, links.schema.field(c).type) for c, x in made.items()}})

    edges, before = kept(links.where("_u <> _v").distinct())
    if before[0] <= AT_ONCE:
        coordinates = edges.schema["_u"].dataType.names
        flat = edges.select(*by, *[F.col(f"_{side}.{c}").alias(f"{side}{c}") for side in "uv" for c in coordinates])
        flat = flat.groupBy(*by).applyInArrow(solved, flat.schema)
        return flat.select(*by, *[F.struct(*[F.col(f"{side}{c}").alias(c) for c in coordinates]).alias(name) for side, name in (("u", "run"), ("v", "component"))])
    for _ in range(rounds):
        edges, now = kept(step(step(edges, True), False))
        if now == before:
            return edges.select(*by, F.greatest("_u", "_v").alias("run"), F.least("_u", "_v").alias("component")).distinct()
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def euler_cells(voxels: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, vertices, edges, faces, cubes, euler: cells of the voxel graph, all of whose corners are voxels.

    Every voxel marks its place in the eight 2x2x2 blocks that hold it; a cell is counted at its lowest corner.
    """
    corners = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    each = F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x"), F.lit(1 << i).alias("bit")) for i, (a, b, c) in enumerate(corners)])
    rows = voxels.select(*by, *AXES, F.explode(each).alias("o"))
    blocks = rows.groupBy(*by, *[(F.col(a) - F.col(f"o.{a}")).alias(a) for a in AXES]).agg(F.bit_or("o.bit").alias("mask"))
    bit = {c: 1 << i for i, c in enumerate(corners)}

    def cells(kinds: list[list[tuple]]) -> list:
        masks = [sum(bit[c] for c in cell) for cell in kinds]
        return sum(F.sum((F.col("mask").bitwiseAND(F.lit(m)) == m).cast("long")) for m in masks)

    o, z, y, x, zy, zx, yx = (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1)
    out = blocks.groupBy(*by).agg(
        cells([[o]]).alias("vertices"),
        cells([[o, z], [o, y], [o, x]]).alias("edges"),
        cells([[o, z, y, zy], [o, z, x, zx], [o, y, x, yx]]).alias("faces"),
        cells([corners]).alias("cubes"),
    )
    return out.withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces") - F.col("cubes"))


def bounding_box(voxels: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, z0, z1, y0, y1, x0, x1."""
    return voxels.groupBy(*by).agg(*[f(a).alias(f"{a}{i}") for a in AXES for i, f in ((0, F.min), (1, F.max))])


def complement(voxels: DataFrame, by: Sequence[str], pad: int = 1) -> DataFrame:
    """The voxels that are absent within the box of each group, grown by ``pad`` on all sides."""
    box = bounding_box(voxels, by)
    planes = box.select(*by, "y0", "y1", "x0", "x1", F.explode(F.sequence(F.col("z0") - pad, F.col("z1") + pad)).alias("z"))
    lines = planes.select(*by, "z", "x0", "x1", F.explode(F.sequence(F.col("y0") - pad, F.col("y1") + pad)).alias("y"))
    full = lines.select(*by, "z", "y", F.explode(F.sequence(F.col("x0") - pad, F.col("x1") + pad)).alias("x"))
    return full.join(merged(voxels.select(*by, *AXES)), [*by, *AXES], "left_anti")


def _counted(runs: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.countDistinct("component").alias(name))


def topology(voxels: DataFrame, groups: DataFrame, by: Sequence[str], connectivity: int = 6, valid: DataFrame | None = None, labelled_runs: DataFrame | None = None) -> DataFrame:
    """by, betti0, betti1, betti2, euler of every row of ``groups``; empty masks are all zero.

    With 6-neighbours the background is joined by 26, and the other way round.  ``valid`` limits the mask to its voxels.
    ``labelled_runs``: the mask's ``run_components`` of the same connectivity, where they are known already.
    """
    if connectivity not in (6, 26):
        raise ValueError("topology needs a connectivity of 6 or 26")
    by = list(by)
    if valid is not None:
        voxels = voxels.join(merged(valid.select(*by, *AXES)), [*by, *AXES], "left_semi")
    voxels = voxels.select(*by, *AXES).distinct()
    runs = runs_of(voxels, by) if labelled_runs is None else labelled_runs
    parts = _counted(run_components(runs, by, connectivity) if labelled_runs is None else labelled_runs, by, "betti0")
    outer = run_components(background_runs(runs, by), by, 32 - connectivity)
    holes = _counted(outer, by, "outer")
    if connectivity == 6:
        out = parts.join(holes, by).join(euler_cells(voxels, by).select(*by, "euler"), by).withColumn("betti2", F.col("outer") - 1)
        out = out.withColumn("betti1", F.col("betti0") + F.col("betti2") - F.col("euler"))
    else:  # by duality: the tunnels of the padded background with 6-neighbours, whose own cavities are the mask's components
        cells = euler_cells(voxels_of(outer, by), by).select(*by, F.col("euler").alias("cells"))
        out = parts.join(holes, by).join(cells, by).withColumn("betti1", F.col("outer") + F.col("betti0") - F.col("cells"))
        out = out.withColumn("betti2", F.col("outer") - 1).withColumn("euler", F.col("betti0") - F.col("betti1") + F.col("betti2"))
    names = ["betti0", "betti1", "betti2", "euler"]
    return groups.select(*by).distinct().join(out.select(*by, *names), by, "left").fillna(0, names)


def topology_comparison(prediction: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    """17 columns: both sides' values, signed differences and errors, and betti_error (sum of the Betti errors)."""
    names = ["betti0", "betti1", "betti2", "euler"]
    p = prediction.select(*by, *[F.col(n).alias(f"prediction_{n}") for n in names])
    t = target.select(*by, *[F.col(n).alias(f"target_{n}") for n in names])
    out = p.join(t, list(by))
    for n in names:
        out = out.withColumn(f"{n}_difference", F.col(f"prediction_{n}") - F.col(f"target_{n}"))
        out = out.withColumn(f"{n}_error", F.abs(f"{n}_difference"))
    return out.withColumn("betti_error", sum(F.col(f"{n}_error") for n in names[:3]))

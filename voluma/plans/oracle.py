"""DuckDB twins of the registered queries, over the same derived volumes."""

from __future__ import annotations

from .fixtures import METHODS

F1V = """
e1 AS (SELECT label AS volume_id, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z FROM embeddings),
f1v AS (SELECT CAST(volume_id AS INTEGER) AS volume_id, CAST(z AS INTEGER) AS z, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x, vec_id, pos,
  CAST(embedding[pos + 1] AS DOUBLE) AS v, CAST((vec_id * 7919 + pos * 104729) % 101 AS INTEGER) AS h FROM e1, (SELECT unnest(range(64)) AS pos))"""
F1 = F1V + """,
q1 AS (SELECT volume_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM f1v GROUP BY volume_id),
n1 AS (SELECT CAST(label AS INTEGER) AS volume_id, CAST(count(*) AS INTEGER) AS nz FROM embeddings GROUP BY label),
s1 AS (SELECT f1v.*, CASE WHEN hi <= lo THEN CAST(0 AS DOUBLE) ELSE (least(greatest(v, lo), hi) - lo) / (hi - lo) END AS s FROM f1v JOIN q1 USING (volume_id)),
f1 AS MATERIALIZED (SELECT s1.*, nz, s >= CAST(0.55 AS DOUBLE) AS prediction, s + (h - 50) / CAST(250 AS DOUBLE) >= CAST(0.55 AS DOUBLE) AS target FROM s1 JOIN n1 USING (volume_id))"""
F2C = """
f2c AS (SELECT CAST(l_partkey % 8 AS INTEGER) AS volume_id, CAST(((date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 32) + 32) % 32 AS INTEGER) AS z,
  CAST((CAST(l_quantity AS INTEGER) - 1) % 16 AS INTEGER) AS y, CAST(l_orderkey % 16 AS INTEGER) AS x, l_suppkey AS id, l_tax * CAST(20 AS DOUBLE) AS distance, l_discount * CAST(9 AS DOUBLE) AS p FROM lineitem)"""
F2 = F2C + """,
f2 AS MATERIALIZED (SELECT volume_id, z, y, x, min(distance) AS dist, max(CAST(floor(p * CAST(1e6 AS DOUBLE)) AS BIGINT) * 8796093022208 + id) % 8796093022208 AS label,
  CAST(1 AS DOUBLE) - exp(sum(ln(greatest(CAST(1 AS DOUBLE) - p, CAST(1e-7 AS DOUBLE))))) AS prob FROM f2c GROUP BY volume_id, z, y, x)"""
_METHODS = ", ".join(f"({k}, '{m}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, (m, a, b) in enumerate(METHODS))
F3 = F1 + f""",
m3(k, method, human, macaque) AS (VALUES {_METHODS}),
c3 AS (SELECT f1.* EXCLUDE (prediction), k, method, CASE WHEN volume_id < 5 THEN 'human' ELSE 'macaque' END AS domain,
  CASE WHEN volume_id IN (0, 9) THEN 'calibration' ELSE 'heldout' END AS split, CASE WHEN volume_id < 5 THEN human ELSE macaque END AS threshold,
  s + ((vec_id * 31 + pos * 17 + k * 13) % 101 - 50) / CAST(400 AS DOUBLE) AS score FROM f1, m3),
f3 AS (SELECT *, score >= threshold AS prediction FROM c3)"""
F4 = """
f4 AS (SELECT event_type AS volume_id, CAST(day(ts) - 1 AS INTEGER) AS z, CAST(hour(ts) AS INTEGER) AS y, CAST(user_id % 10 AS INTEGER) AS x, round(avg(value), 6) AS value
  FROM events GROUP BY ALL)"""
F5 = """
f5 AS (SELECT o_custkey AS curve_id, o_orderkey AS ord, CAST((13 * o_orderkey) % 32 AS DOUBLE) AS z, CAST((7 * o_orderkey + o_custkey) % 32 AS DOUBLE) AS y,
  CAST((3 * o_orderkey + 5 * o_custkey) % 32 AS DOUBLE) AS x, CAST(1 + (o_custkey % 3) / CAST(2 AS DOUBLE) AS DOUBLE) AS radius FROM orders)"""
FACES = "o6(dz, dy, dx) AS (VALUES (-1,0,0), (1,0,0), (0,-1,0), (0,1,0), (0,0,-1), (0,0,1))"
V, K = "volume_id", "volume_id, z, y, x"


def _hash(key: str, seed: int) -> str:
    return f"(((CAST({key} AS BIGINT) * 7919 + {seed * 104729 + 12345}) % 1000003) * 48271 % 1000003) / CAST(1000003 AS DOUBLE)"


def _offsets(connectivity: int) -> str:
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if 0 < abs(a) + abs(b) + abs(c) <= reach]
    return ", ".join(map(str, around))


def _metrics(rows: str, by: str, prefix: str = "", digits: int = 9) -> str:
    """The 21 metrics of a table with by, tp, fp, fn and tn."""

    def sd(n: str, d: str) -> str:
        return f"CASE WHEN {d} = 0 THEN CAST(0 AS DOUBLE) ELSE round(({n}) / CAST({d} AS DOUBLE), {digits}) END"

    n = "(tp + fp + fn + tn)"
    out = {
        "valid_voxels": n, "prediction_positive_voxels": "tp + fp", "target_positive_voxels": "tp + fn", "tp": "tp", "fp": "fp", "fn": "fn", "tn": "tn",
        "dice": f"CASE WHEN 2 * tp + fp + fn = 0 THEN CAST(1 AS DOUBLE) ELSE round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), {digits}) END",
        "iou": f"CASE WHEN tp + fp + fn = 0 THEN CAST(1 AS DOUBLE) ELSE round(tp / CAST(tp + fp + fn AS DOUBLE), {digits}) END",
        "precision": sd("tp", "(tp + fp)"), "recall": sd("tp", "(tp + fn)"), "specificity": sd("tn", "(tn + fp)"), "accuracy": sd("tp + tn", n),
        "fdr": sd("fp", "(tp + fp)"), "fpr": sd("fp", "(fp + tn)"), "tp_fraction": sd("tp", n), "fp_fraction": sd("fp", n), "fn_fraction": sd("fn", n),
        "tn_fraction": sd("tn", n), "prediction_foreground_fraction": sd("tp + fp", n), "target_foreground_fraction": sd("tp + fn", n),
    }
    cols = ", ".join(f"CAST({v} AS BIGINT) AS {prefix}{k}" if i < 7 else f"{v} AS {prefix}{k}" for i, (k, v) in enumerate(out.items()))
    return f"SELECT {by}, {cols} FROM {rows}"


def _confusion(rows: str, by: str, p: str = "prediction", t: str = "target", v: str = "TRUE") -> str:
    return (
        f"SELECT {by}, count(*) FILTER ({v} AND {p} AND {t}) AS tp, count(*) FILTER ({v} AND {p} AND NOT {t}) AS fp, "
        f"count(*) FILTER ({v} AND NOT {p} AND {t}) AS fn, count(*) FILTER ({v} AND NOT {p} AND NOT {t}) AS tn FROM {rows} GROUP BY {by}"
    )


def _correction(rounds: int, by: str = V, rows: str = "f1", p: str = "prediction") -> str:
    """CTEs b0.. and fixed (rows with changed_in and corrected)."""
    keys = f"{by}, z, y, x"
    on = " AND ".join(f"a.{c} = b.{c}" for c in by.split(", "))
    adjacent = "a.z = b.z + dz AND a.y = b.y + dy AND a.x = b.x + dx"
    cols = ", ".join(f"a.{c.strip()}" for c in keys.split(","))
    out = [FACES, f"st AS (SELECT {keys}, CASE WHEN {p} AND target THEN 0 WHEN target THEN 1 WHEN {p} THEN 2 END AS state FROM {rows})"]
    out.append(f"b0 AS (SELECT {keys}, unnest([1, 2]) AS state, 0 AS changed_in FROM st WHERE state = 0)")
    for i in range(1, rounds + 1):
        seen = "" if i == 1 else " AND NOT EXISTS (SELECT 1 FROM (" + " UNION ALL ".join(f"SELECT * FROM b{j}" for j in range(1, i)) + ") c WHERE " + " AND ".join(f"c.{k.strip()} = a.{k.strip()}" for k in keys.split(",")) + ")"
        out.append(f"b{i} AS (SELECT DISTINCT {cols}, a.state, {i} AS changed_in FROM st a, o6, b{i - 1} b WHERE a.state = b.state AND {on} AND {adjacent}{seen})")
    every = " UNION ALL ".join(f"SELECT {keys}, changed_in FROM b{i}" for i in range(1, rounds + 1))
    out.append(f"fixed AS (SELECT r.*, changed_in, CASE WHEN changed_in IS NOT NULL THEN NOT {p} ELSE {p} END AS corrected FROM {rows} r LEFT JOIN ({every}) USING ({keys}))")
    return ",\n".join(out)


def _rounds(name: str, n_rounds: int) -> str:
    """CTEs; {name}_{n_rounds} has id and c of the nodes of {name}_0, joined by the edges {name}_e.

    Every round each label takes the smallest label that its nodes touch, then that label's own, and so on 32 times.
    """
    steps = []
    for i in range(1, n_rounds + 1):
        steps.append(f"{name}_h{i}_0 AS MATERIALIZED (SELECT a.c, min(least(a.c, b.c)) AS m FROM {name}_{i - 1} a LEFT JOIN {name}_e e ON e.u = a.id LEFT JOIN {name}_{i - 1} b ON b.id = e.v GROUP BY a.c)")
        steps += [f"{name}_h{i}_{j} AS MATERIALIZED (SELECT a.c, b.m FROM {name}_h{i}_{j - 1} a JOIN {name}_h{i}_{j - 1} b ON b.c = a.m)" for j in range(1, 6)]
        steps.append(f"{name}_{i} AS MATERIALIZED (SELECT a.id, h.m AS c FROM {name}_{i - 1} a JOIN {name}_h{i}_5 h ON h.c = a.c)")
    return ",\n".join(steps)


_ID = "((CAST(volume_id AS BIGINT) * 10000 + z + 8) * 32 + y + 8) * 32 + {x} + 8"


def _components(name: str, rows: str, where: str, connectivity: int, n_rounds: int = 8) -> str:
    """CTEs; {name} has id, volume_id, z, y, x, component (smallest id). Volumes of at most 8 x 8 x n voxels with a margin."""
    return f"""
{name}_o(dz, dy, dx) AS (VALUES {_offsets(connectivity)}),
{name}_v AS MATERIALIZED (SELECT volume_id, z, y, x, {_ID.format(x='x')} AS id FROM {rows} WHERE {where}),
{name}_e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM {name}_v a, {name}_o JOIN {name}_v b ON b.id = a.id + (dz * 32 + dy) * 32 + dx),
{name}_0 AS MATERIALIZED (SELECT id, id AS c FROM {name}_v),
{_rounds(name, n_rounds)},
{name} AS (SELECT v.*, c AS component FROM {name}_v v JOIN {name}_{n_rounds} USING (id))"""


def _run_components(name: str, rows: str, connectivity: int, n_rounds: int = 6) -> str:
    """CTEs; {name} has volume_id and component of the runs of voxels along x, which are far fewer than the voxels."""
    lines = {6: [(a, b, 0) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))], 26: [(a, b, 1) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]}[connectivity]
    return f"""
{name}_o(dz, dy, r) AS (VALUES {", ".join(map(str, lines))}),
{name}_v AS MATERIALIZED (SELECT volume_id, z, y, min(x) AS x0, max(x) AS x1, {_ID.format(x='min(x)')} AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY volume_id, z, y ORDER BY x) AS s FROM {rows}) GROUP BY volume_id, z, y, s),
{name}_e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM {name}_v a CROSS JOIN {name}_o JOIN {name}_v b ON b.volume_id = a.volume_id AND b.z = a.z + dz AND b.y = a.y + dy WHERE b.x0 <= a.x1 + r AND a.x0 <= b.x1 + r),
{name}_0 AS MATERIALIZED (SELECT id, id AS c FROM {name}_v),
{_rounds(name, n_rounds)},
{name} AS (SELECT v.volume_id, c AS component FROM {name}_v v JOIN {name}_{n_rounds} USING (id))"""


def _decoded(c: str, names: tuple[str, str, str]) -> str:
    z, y, x = names
    return f"CAST(({c} // 1024) % 10000 - 8 AS INTEGER) AS {z}, CAST(({c} // 32) % 32 - 8 AS INTEGER) AS {y}, CAST({c} % 32 - 8 AS INTEGER) AS {x}"


O: dict[str, str] = {}
ORACLES = O

O["normalize_percentile"] = f"WITH {F1} SELECT {K}, round(s, 9) AS score FROM f1"
O["normalize_inference"] = f"WITH {F1} SELECT {K}, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 6) AS score FROM f1"
O["minmax_rescale"] = f"""WITH {F1V}, m AS (SELECT volume_id, min(v) AS lo, max(v) AS hi FROM f1v GROUP BY volume_id)
SELECT {K}, CASE WHEN hi <= lo THEN CAST(0.25 AS DOUBLE) ELSE round((v - lo) / (hi - lo) * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE), 9) END AS rescaled FROM f1v JOIN m USING (volume_id)"""
O["intensity_summary"] = f"""WITH {F4} SELECT volume_id, round(min(value), 9) AS minimum, round(quantile_cont(value, 0.005), 9) AS p0_5, round(quantile_cont(value, 0.5), 9) AS p50,
round(quantile_cont(value, 0.995), 9) AS p99_5, round(max(value), 9) AS maximum FROM f4 GROUP BY volume_id"""
O["threshold_mask"] = f"WITH {F1} SELECT {K}, CAST(s AS FLOAT) >= CAST(0.55 AS FLOAT) AS mask FROM f1"
O["multi_threshold_masks"] = f"""WITH {F1}, t(label, threshold) AS (VALUES ('low', CAST(0.4 AS DOUBLE)), ('mid', CAST(0.5 AS DOUBLE)), ('high', CAST(0.6 AS DOUBLE))),
r AS (SELECT volume_id, label, threshold, CAST(s AS FLOAT) >= CAST(threshold AS FLOAT) AS mask FROM f1, t)
SELECT volume_id, label, threshold, count(*) FILTER (mask) AS n_positive, round(avg(CAST(mask AS DOUBLE)), 9) AS fraction FROM r GROUP BY ALL"""
O["error_overlay_counts"] = f"""WITH {F1} SELECT volume_id, count(*) FILTER (NOT prediction AND NOT target) AS true_negative, count(*) FILTER (prediction AND target) AS true_positive,
count(*) FILTER (prediction AND NOT target) AS false_positive, count(*) FILTER (NOT prediction AND target) AS false_negative FROM f1 GROUP BY volume_id"""
O["mid_slice_planes"] = f"""WITH {F1} SELECT volume_id, 'z' AS axis, y AS "row", x AS "column", round(s, 9) AS s FROM f1 WHERE z = nz // 2
UNION ALL SELECT volume_id, 'y', z, x, round(s, 9) FROM f1 WHERE y = 4 UNION ALL SELECT volume_id, 'x', z, y, round(s, 9) FROM f1 WHERE x = 4"""
O["slice_overlay_rgb"] = f"""WITH {F1}, p AS (SELECT *, CASE WHEN prediction AND target THEN 1 WHEN prediction THEN 2 WHEN target THEN 3 ELSE 0 END AS code FROM f1 WHERE z = nz // 2),
m AS (SELECT volume_id, min(s) AS lo, max(s) AS hi FROM p GROUP BY volume_id),
g AS (SELECT p.*, CAST(floor(CASE WHEN hi <= lo THEN 0 ELSE (s - lo) / (hi - lo) * 255 END) AS INTEGER) AS grey FROM p JOIN m USING (volume_id))
SELECT {K}, CAST(CASE code WHEN 1 THEN 0 WHEN 2 THEN 230 WHEN 3 THEN 255 ELSE grey END AS INTEGER) AS r, CAST(CASE code WHEN 1 THEN 200 WHEN 2 THEN 210 WHEN 3 THEN 105 ELSE grey END AS INTEGER) AS g,
CAST(CASE code WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 180 ELSE grey END AS INTEGER) AS b FROM g"""
O["gaussian_smooth"] = f"""WITH {F1}, w AS (SELECT d, exp(CAST(-0.5 AS DOUBLE) * d * d) AS u FROM (SELECT unnest(range(-4, 5)) AS d)), t AS (SELECT sum(u) AS total FROM w)
SELECT a.volume_id, a.z, a.y, a.x, round(sum(b.s * u / total), 8) AS s FROM f1 a, w, t, f1 b
WHERE b.volume_id = a.volume_id AND b.y = a.y AND b.x = a.x AND b.z = least(greatest(a.z + d, 0), a.nz - 1) GROUP BY ALL"""


def _resampled(axis: str, size: str, ratio: str) -> str:
    """CTEs; {axis}w: of each size n of the axis, the weight w of its plane i in the new plane j."""
    m = f"CAST(round_even((n - 1) / {ratio}, 0) AS INTEGER) + 1"
    return f"""{axis}n AS (SELECT DISTINCT CAST({size} AS INTEGER) AS n FROM f1), {axis}m AS (SELECT n, {m} AS m FROM {axis}n),
{axis}p AS (SELECT n, j, least(greatest((n - 1) / CAST(2 AS DOUBLE) + (j - (m - 1) / CAST(2 AS DOUBLE)) * {ratio}, 0), n - 1) AS p FROM (SELECT n, m, unnest(range(m)) AS j FROM {axis}m)),
{axis}w AS (SELECT n, j, i, CASE WHEN i = lo THEN 1 - (p - lo) ELSE p - lo END AS w FROM (SELECT n, j, p, lo, unnest([lo, lo + 1]) AS i FROM (SELECT n, j, p, least(CAST(floor(p) AS INTEGER), greatest(n - 2, 0)) AS lo FROM {axis}p)))"""


O["trilinear_resample"] = f"""WITH {F1}, {_resampled('z', 'nz', "CAST(0.8 AS DOUBLE)")}, {_resampled('y', '8', "CAST(1.6 AS DOUBLE)")}, {_resampled('x', '8', "CAST(1.6 AS DOUBLE)")}
SELECT volume_id, CAST(zw.j AS INTEGER) AS z, CAST(yw.j AS INTEGER) AS y, CAST(xw.j AS INTEGER) AS x, round(sum(s * zw.w * yw.w * xw.w), 8) AS s
FROM f1 JOIN zw ON zw.i = z AND zw.n = nz JOIN yw ON yw.i = y JOIN xw ON xw.i = x GROUP BY ALL"""
O["resample_plan"] = f"""WITH n AS (SELECT CAST(label AS INTEGER) AS volume_id, count(*) AS nz, CAST(0.25 AS DOUBLE) + label * CAST(0.15 AS DOUBLE) AS spacing FROM embeddings GROUP BY label)
SELECT volume_id, CAST(round_even((nz - 1) * spacing / CAST(0.8 AS DOUBLE), 0) AS BIGINT) + 1 AS new_nz, round(greatest(CAST(0.8 AS DOUBLE) / spacing - 1, 0) / 2, 9) AS sigma FROM n"""
O["tile_blend"] = f"""WITH {F1}, tz AS (SELECT DISTINCT volume_id, least(tz, greatest(nz - 8, 0)) AS tz FROM (SELECT volume_id, nz, unnest(range(0, nz, 4)) AS tz FROM (SELECT DISTINCT volume_id, nz FROM f1))),
t AS (SELECT f1.*, tz, 0 AS ty, 0 AS tx FROM f1 JOIN tz ON f1.volume_id = tz.volume_id AND z >= tz AND z < tz + 8), m AS (SELECT volume_id, tz, avg(s) AS m FROM t GROUP BY ALL),
w AS (SELECT t.*, m, exp(-((z - tz - 3.5::DOUBLE) * (z - tz - 3.5::DOUBLE) + (y - 3.5::DOUBLE) * (y - 3.5::DOUBLE) + (x - 3.5::DOUBLE) * (x - 3.5::DOUBLE)) / 2) AS w FROM t JOIN m USING (volume_id, tz))
SELECT {K}, round(sum(w * (s - m)) / sum(w), 8) AS blended, count(*) AS tiles FROM w GROUP BY {K}"""
O["confusion_counts"] = f"WITH {F1} {_confusion('f1', V)}"
O["voxel_metrics"] = f"WITH {F1}, c AS ({_confusion('f1', V)}) {_metrics('c', V)}"
O["voxel_metrics_valid_mask"] = f"WITH {F1}, c AS ({_confusion('f1', V, v='(h % 3 <> 0)')}) {_metrics('c', V)}"
O["sparse_mask_metrics"] = O["voxel_metrics"]
_CASES = f"WITH {F3}, c AS ({_confusion('f3', 'method, domain, split, volume_id')}), cm AS ({_metrics('c', 'method, domain, split, volume_id', digits=15)})"
_NAMES = """valid_voxels prediction_positive_voxels target_positive_voxels tp fp fn tn dice iou precision recall specificity accuracy fdr fpr tp_fraction fp_fraction
fn_fraction tn_fraction prediction_foreground_fraction target_foreground_fraction""".split()
O["macro_metrics_cube"] = f"""{_CASES} SELECT method, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, CASE WHEN grouping(domain) = 1 THEN 'all' ELSE domain END AS domain,
count(*) AS n_patches, {", ".join(f"round(avg({n}), 9) AS mean_{n}" for n in _NAMES)} FROM cm GROUP BY method, CUBE (split, domain)"""
O["heldout_summary"] = f"""{_CASES} SELECT method, count(*) AS n_patches, {", ".join(f"round(avg({n}), 9) AS mean_{n}" for n in ("dice", "iou", "precision", "recall"))}
FROM cm WHERE split = 'heldout' GROUP BY method"""
for _r in (1, 2):
    O[f"neighbor_correction_round{_r}"] = f"WITH {F1}, {_correction(_r)} SELECT {K}, changed_in, corrected FROM fixed WHERE changed_in IS NOT NULL"
O["correction_counts"] = f"""WITH {F1}, {_correction(2)} SELECT volume_id, count(*) FILTER (changed_in IS NOT NULL AND target) AS fn_promoted_to_tp_voxels,
count(*) FILTER (changed_in IS NOT NULL AND NOT target) AS fp_removed_voxels FROM fixed GROUP BY volume_id"""
O["corrected_metrics"] = f"WITH {F1}, {_correction(2)}, c AS ({_confusion('fixed', V, 'corrected')}) {_metrics('c', V)}"
O["neighbor_stencil"] = f"""WITH {F1}, {FACES} SELECT a.volume_id, count(DISTINCT (a.z, a.y, a.x)) AS n_touching FROM f1 a, o6, f1 b WHERE a.target AND NOT a.prediction AND b.target AND b.prediction
AND a.volume_id = b.volume_id AND a.z = b.z + dz AND a.y = b.y + dy AND a.x = b.x + dx GROUP BY a.volume_id"""
_SLABS = "sl AS (SELECT *, CAST((8 * (z + 1) - 1) // nz AS INTEGER) AS slab FROM {rows})"
_EDGES = "ed AS (SELECT {by}, slab, min(z) AS z0, max(z) + 1 AS z1, max(nz) AS nz FROM sl GROUP BY {by}, slab)"
_DEPTH = "SELECT cm.*, CAST(z0 AS INTEGER) AS z0, CAST(z1 AS INTEGER) AS z1, round((z0 + z1) / CAST(2 AS DOUBLE) / nz, {d}) AS depth_fraction FROM cm JOIN ed USING ({by}, slab)"
O["depth_slab_metrics"] = f"""WITH {F1}, {_SLABS.format(rows='f1')}, {_EDGES.format(by=V)}, c AS ({_confusion('sl', V + ', slab')}), cm AS ({_metrics('c', V + ', slab')}) {_DEPTH.format(by=V, d=9)}"""
O["depth_slab_corrected"] = f"""WITH {F1}, {_SLABS.format(rows='f1')}, {_EDGES.format(by=V)}, {_correction(1, V + ', slab', 'sl')}, c AS ({_confusion('fixed', V + ', slab', 'corrected')}),
cm AS ({_metrics('c', V + ', slab')}) {_DEPTH.format(by=V, d=9)}"""
_TREND = {"dice": "prediction_positive_voxels + target_positive_voxels > 0", "precision": "prediction_positive_voxels > 0", "recall": "target_positive_voxels > 0"}
O["depth_trends"] = f"""WITH {F3}, {_SLABS.format(rows='f3')}, {_EDGES.format(by='method, volume_id')}, c AS ({_confusion('sl', 'method, volume_id, slab')}), cm AS ({_metrics('c', 'method, volume_id, slab', digits=15)}),
d AS ({_DEPTH.format(by='method, volume_id', d=15)}) SELECT method, volume_id, {", ".join(f"round(regr_slope(CASE WHEN {c} THEN {m} END, depth_fraction), 8) AS {m}_slope_per_depth_fraction, count(CASE WHEN {c} THEN {m} END) AS {m}_fit_slabs" for m, c in _TREND.items())}
FROM d GROUP BY method, volume_id"""


def _euler(name: str, rows: str, where: str) -> str:
    """CTEs; {name}: volume_id, vertices, edges, faces, cubes."""
    v = f"{name}_v AS (SELECT volume_id, z, y, x FROM {rows} WHERE {where})"
    corners = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1) if a + b + c]
    joins = " ".join(f"LEFT JOIN {name}_v c{a}{b}{c} ON c{a}{b}{c}.volume_id = o.volume_id AND c{a}{b}{c}.z = o.z + {a} AND c{a}{b}{c}.y = o.y + {b} AND c{a}{b}{c}.x = o.x + {c}" for a, b, c in corners)

    def has(*cs: str) -> str:
        return "CAST(" + " AND ".join(f"c{c}.z IS NOT NULL" for c in cs) + " AS BIGINT)"

    return f"""{v}, {name} AS (SELECT o.volume_id, CAST(count(*) AS BIGINT) AS vertices, CAST(sum({has('100')} + {has('010')} + {has('001')}) AS BIGINT) AS edges,
CAST(sum({has('100', '010', '110')} + {has('100', '001', '101')} + {has('010', '001', '011')}) AS BIGINT) AS faces,
CAST(sum({has('100', '010', '001', '110', '101', '011', '111')}) AS BIGINT) AS cubes FROM {name}_v o {joins} GROUP BY o.volume_id)"""


O["euler_cells"] = f"WITH {F1}, {_euler('eu', 'f1', 'prediction')} SELECT *, vertices - edges + faces - cubes AS euler FROM eu"
O["bbox_crop"] = f"""WITH {F1}, b AS (SELECT volume_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM f1 WHERE s >= CAST(0.9 AS DOUBLE) GROUP BY volume_id)
SELECT volume_id, z0, z1, y0, y1, x0, x1, count(*) AS n_inside FROM f1 JOIN b USING (volume_id) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY ALL"""
for _n in (6, 18, 26):
    O[f"components{_n}"] = f"WITH {F1}, {_components('cc', 'f1', 'prediction', _n)} SELECT {K}, {_decoded('component', ('cz', 'cy', 'cx'))} FROM cc"


def _component_ctes(out: str, pc: str, tc: str, groups: str, x: str, digits: int = 9) -> str:
    """CTEs; {out}: the 17 component metrics of two labelled masks, by volume_id. ``x``: prefix of the CTEs' names."""
    return f"""
{x}pr AS (SELECT {pc}.volume_id, {pc}.component AS p, {tc}.component AS t, count(*) AS overlap FROM {pc} JOIN {tc} ON {pc}.id = {tc}.id GROUP BY ALL),
{x}ps AS (SELECT volume_id, component AS p, count(*) AS n FROM {pc} GROUP BY ALL), {x}ts AS (SELECT volume_id, component AS t, count(*) AS n FROM {tc} GROUP BY ALL),
{x}io AS (SELECT r.*, overlap / CAST(a.n + b.n - overlap AS DOUBLE) AS iou FROM {x}pr r JOIN {x}ps a USING (volume_id, p) JOIN {x}ts b USING (volume_id, t)),
{x}g AS (SELECT DISTINCT volume_id FROM {groups}), {x}np AS (SELECT volume_id, count(*) AS n FROM {x}ps GROUP BY 1), {x}nt AS (SELECT volume_id, count(*) AS n FROM {x}ts GROUP BY 1),
{x}dp AS (SELECT volume_id, count(*) AS m, count(*) FILTER (d > 1) AS b FROM (SELECT volume_id, p, count(*) AS d FROM {x}io GROUP BY ALL) GROUP BY 1),
{x}dt AS (SELECT volume_id, count(*) AS m, count(*) FILTER (d > 1) AS b FROM (SELECT volume_id, t, count(*) AS d FROM {x}io GROUP BY ALL) GROUP BY 1),
{x}st AS (SELECT volume_id, count(*) AS n, avg(iou) AS a, median(iou) AS md, min(iou) AS mi, max(iou) AS ma FROM {x}io GROUP BY 1),
{x}a AS (SELECT g.volume_id, coalesce(np.n, 0) AS np, coalesce(nt.n, 0) AS nt, coalesce(dp.m, 0) AS mp, coalesce(dt.m, 0) AS mt, coalesce(dp.b, 0) AS bp, coalesce(dt.b, 0) AS bt, coalesce(st.n, 0) AS n,
  coalesce(a, 0) AS a, coalesce(md, 0) AS md, coalesce(mi, 0) AS mi, coalesce(ma, 0) AS ma
  FROM {x}g g LEFT JOIN {x}np np USING (volume_id) LEFT JOIN {x}nt nt USING (volume_id) LEFT JOIN {x}dp dp USING (volume_id) LEFT JOIN {x}dt dt USING (volume_id) LEFT JOIN {x}st st USING (volume_id)),
{out} AS (SELECT volume_id, np AS prediction_components, nt AS target_components, np - nt AS component_count_difference, abs(np - nt) AS component_count_error, mp AS matched_prediction_components,
  mt AS matched_target_components, CASE WHEN np = 0 THEN CAST(0 AS DOUBLE) ELSE round(mp / CAST(np AS DOUBLE), 9) END AS component_precision,
  CASE WHEN nt = 0 THEN CAST(0 AS DOUBLE) ELSE round(mt / CAST(nt AS DOUBLE), 9) END AS component_recall, np - mp AS false_components, nt - mt AS missed_components, bt AS split_count, bp AS merge_count,
  n AS matched_pair_count, round(a, {digits}) AS matched_iou_mean, round(md, {digits}) AS matched_iou_median, round(mi, {digits}) AS matched_iou_min, round(ma, {digits}) AS matched_iou_max FROM {x}a)"""


_BOTH = f"WITH {F1}, {_components('pc', 'f1', 'prediction', 6)}, {_components('tc', 'f1', 'target', 6)}"
O["component_overlap"] = f"{_BOTH}, pr AS (SELECT pc.volume_id, pc.component AS p, tc.component AS t, count(*) AS overlap FROM pc JOIN tc ON pc.id = tc.id GROUP BY ALL) SELECT volume_id, {_decoded('p', ('pz', 'py', 'px'))}, {_decoded('t', ('tz', 'ty', 'tx'))}, overlap FROM pr"
O["component_metrics"] = f"{_BOTH}, {_component_ctes('cmx', 'pc', 'tc', 'f1', 'k')} SELECT * FROM cmx"


def _background(name: str, rows: str, where: str, base: str = "f1") -> str:
    """CTE of the voxels that a mask leaves free in its volume's box, grown by one on all sides."""
    return f"""{name} AS MATERIALIZED (SELECT b.* FROM (SELECT volume_id, z, y, x FROM (SELECT volume_id, unnest(range(-1, nz + 1)) AS z FROM (SELECT DISTINCT volume_id, nz FROM {base})),
(SELECT unnest(range(-1, 9)) AS y), (SELECT unnest(range(-1, 9)) AS x)) b WHERE NOT EXISTS (SELECT 1 FROM {rows} m WHERE m.volume_id = b.volume_id AND m.z = b.z AND m.y = b.y AND m.x = b.x AND {where}))"""


def _topology(out: str, rows: str, where: str, connectivity: int = 6, labelled: str | None = None, base: str = "f1") -> str:
    """CTEs; {out}: volume_id, betti0, betti1, betti2, euler. ``labelled``: CTE that has the mask's components already."""
    fg = labelled or f"{out}_f"
    first = "" if labelled else _components(fg, rows, where, connectivity) + ",\n"
    counts = f"""{_background(f'{out}_b', rows, where, base)}, {_run_components(f'{out}_c', f'{out}_b', 32 - connectivity)},
{out}_n AS (SELECT volume_id, count(DISTINCT component) AS n FROM {fg} GROUP BY 1), {out}_h AS (SELECT volume_id, count(DISTINCT component) AS n FROM {out}_c GROUP BY 1),"""
    if connectivity == 6:
        own = f"{_euler(f'{out}_e', rows, where)}, {out}_t AS (SELECT n.volume_id, n.n AS b0, n.n + h.n - 1 - (vertices - edges + faces - cubes) AS b1, h.n - 1 AS b2 FROM {out}_n n JOIN {out}_h h USING (volume_id) JOIN {out}_e USING (volume_id))"
    else:
        own = f"{_euler(f'{out}_e', f'{out}_b', 'TRUE')}, {out}_t AS (SELECT n.volume_id, n.n AS b0, h.n + n.n - (vertices - edges + faces - cubes) AS b1, h.n - 1 AS b2 FROM {out}_n n JOIN {out}_h h USING (volume_id) JOIN {out}_e USING (volume_id))"
    names = ", ".join(f"CAST(coalesce({v}, 0) AS BIGINT) AS {n}" for v, n in (("b0", "betti0"), ("b1", "betti1"), ("b2", "betti2"), ("b0 - b1 + b2", "euler")))
    return f"{first}{counts} {own}, {out} AS (SELECT g.volume_id, {names} FROM (SELECT DISTINCT volume_id FROM {base}) g LEFT JOIN {out}_t USING (volume_id))"


def _compared(p: str, t: str) -> str:
    names = ("betti0", "betti1", "betti2", "euler")
    cols = [f"p.{n} AS prediction_{n}, t.{n} AS target_{n}, p.{n} - t.{n} AS {n}_difference, abs(p.{n} - t.{n}) AS {n}_error" for n in names]
    error = " + ".join(f"abs(p.{n} - t.{n})" for n in names[:3])
    return f"SELECT p.volume_id, {', '.join(cols)}, {error} AS betti_error FROM {p} p JOIN {t} t USING (volume_id)"


O["topology_betti"] = f"WITH {F1}, {_topology('tp', 'f1', 'prediction')} SELECT * FROM tp"
O["topology_betti26"] = f"WITH {F1}, {_topology('tp', 'f1', 'prediction', 26)} SELECT * FROM tp"
O["topology_comparison"] = f"WITH {F1}, {_topology('tp', 'f1', 'prediction')}, {_topology('tt', 'f1', 'target')} {_compared('tp', 'tt')}"
CORRECTED = "target_informed_neighbor_corrected"


def _evaluated(rows: str, base: str = "f1", digits: int = 9, named: str = "") -> str:
    """The composite of both masks of a table of valid voxels."""
    fixed = _correction(2, rows=rows)
    parts = {
        "er": _metrics("ec", V, "raw_", digits),
        "ek": _metrics("ed", V, f"{CORRECTED}_", digits),
        "en": "SELECT volume_id, 2 AS neighbor_correction_rounds, 6 AS neighbor_correction_connectivity, TRUE AS neighbor_correction_uses_target_to_modify_prediction, count(*) FILTER (changed_in IS NOT NULL AND target) AS neighbor_correction_fn_promoted_to_tp_voxels, count(*) FILTER (changed_in IS NOT NULL AND NOT target) AS neighbor_correction_fp_removed_voxels FROM fixed GROUP BY volume_id",
        "et": "SELECT volume_id, COLUMNS(* EXCLUDE (volume_id)) AS 'raw_topology_\\0' FROM (" + _compared("tp", "tt") + ")",
        "ex": "SELECT volume_id, COLUMNS(* EXCLUDE (volume_id)) AS 'raw_component_\\0' FROM (SELECT volume_id, component_count_difference AS count_difference, component_count_error AS count_error, component_precision AS precision, component_recall AS recall, * EXCLUDE (volume_id, component_count_difference, component_count_error, component_precision, component_recall) FROM cmx)",
    }
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in parts.items())
    every = f"""{fixed}, ec AS ({_confusion(rows, V)}), ed AS ({_confusion('fixed', V, 'corrected')}), {_components('pc', rows, 'prediction', 6)}, {_components('tc', rows, 'target', 6)},
{_topology('tp', rows, 'prediction', labelled='pc', base=base)}, {_topology('tt', rows, 'target', labelled='tc', base=base)}, {_component_ctes('cmx', 'pc', 'tc', rows, 'k', digits)}, {ctes}"""
    last = "SELECT * FROM er JOIN ek USING (volume_id) JOIN en USING (volume_id) JOIN et USING (volume_id) JOIN ex USING (volume_id)"
    return f"{every}, {named} AS ({last})" if named else f"{every}\n{last}"


O["evaluate_masks"] = f"WITH {F1}, {_evaluated('f1')}"
O["evaluate_masks_valid"] = f"WITH {F1}, fv AS MATERIALIZED (SELECT * FROM f1 WHERE h % 3 <> 0), {_evaluated('fv')}"
O["case_macro_cube"] = f"""WITH {F3}, fc AS MATERIALIZED (SELECT * REPLACE (volume_id * 4 + k AS volume_id) FROM f3), {_evaluated('fc', 'fc', 15, named='ev')},
cs AS (SELECT DISTINCT volume_id, method, split AS s, domain AS d FROM fc)
SELECT method, CASE WHEN grouping(s) = 1 THEN 'all' ELSE s END AS split, CASE WHEN grouping(d) = 1 THEN 'all' ELSE d END AS domain, count(*) AS n_patches,
round(avg(COLUMNS(* EXCLUDE (volume_id, method, s, d, neighbor_correction_uses_target_to_modify_prediction))), 8) AS 'mean_\\0' FROM ev JOIN cs USING (volume_id) GROUP BY method, CUBE (s, d)"""
_CASE_BY = "method, domain, split, volume_id"
_DEPTHS = f"""WITH {F3}, {_SLABS.format(rows='f3')}, ed AS (SELECT {_CASE_BY}, slab, min(z) AS slab_start, max(z) + 1 AS slab_stop, (min(z) + max(z) + 1) / CAST(2 AS DOUBLE) / max(nz) AS depth_fraction_midpoint FROM sl GROUP BY ALL),
{_correction(2, _CASE_BY + ', slab', 'sl')}, c AS ({_confusion('sl', _CASE_BY + ', slab')}), cc AS ({_confusion('fixed', _CASE_BY + ', slab', 'corrected')}),
cm AS ({_metrics('c', _CASE_BY + ', slab', 'raw_', 15)}), ck AS ({_metrics('cc', _CASE_BY + ', slab', CORRECTED + '_', 15)}),
dr AS (SELECT * FROM ed JOIN cm USING ({_CASE_BY}, slab) JOIN ck USING ({_CASE_BY}, slab))"""
O["depth_rows"] = f"""{_DEPTHS} SELECT * REPLACE (round(depth_fraction_midpoint, 9) AS depth_fraction_midpoint, {", ".join(f"round({p}{n}, 9) AS {p}{n}" for p in ("raw_", CORRECTED + "_") for n in _NAMES[7:])}) FROM dr"""
O["depth_trend_rows"] = f"""{_DEPTHS} SELECT {_CASE_BY}, {", ".join(f"round(regr_slope(CASE WHEN {c.replace('prediction_', p + 'prediction_').replace('target_positive', p + 'target_positive')} THEN {p}{m} END, depth_fraction_midpoint), 8) AS {p}{m}_slope_per_depth_fraction, count(CASE WHEN {c.replace('prediction_', p + 'prediction_').replace('target_positive', p + 'target_positive')} THEN {p}{m} END) AS {p}{m}_fit_slabs" for p in ("raw_", CORRECTED + "_") for m, c in _TREND.items())}
FROM dr GROUP BY {_CASE_BY}"""

_F2M = F2 + ", g2 AS (SELECT volume_id, z, y, x, CAST(CASE WHEN prob > 0 THEN label % 5 ELSE 0 END AS INTEGER) AS label FROM f2)"
_SHELL = f"""{_F2M}, {FACES}, nb AS (SELECT a.volume_id, a.z, a.y, a.x, count(*) AS n FROM g2 a, o6 JOIN g2 b ON a.volume_id = b.volume_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND a.label = b.label WHERE a.label > 0 GROUP BY ALL),
sh AS (SELECT {K}, label, CASE WHEN label = 0 THEN 0 WHEN coalesce(n, 0) = 6 THEN 2 ELSE 1 END AS class FROM g2 LEFT JOIN nb USING ({K}))"""
O["shell_interior"] = f"WITH {_SHELL} SELECT * FROM sh"
O["class_totals"] = f"WITH {_SHELL} SELECT volume_id, count(*) FILTER (class = 1) AS shell, count(*) FILTER (class = 2) AS interior FROM sh GROUP BY volume_id"
_FIELD = "(CAST(0.2 AS DOUBLE) + (CAST(0.8 AS DOUBLE) - CAST(0.2 AS DOUBLE)) * (z / CAST(31 AS DOUBLE)))"
_MEAN = f"fm AS (SELECT volume_id, CAST(label AS INTEGER) AS label, count(*) AS n_voxels, avg({_FIELD}) AS field_mean FROM f2 WHERE label > 0 GROUP BY ALL)"
O["label_field_mean"] = f"WITH {F2}, {_MEAN} SELECT volume_id, label, n_voxels, round(field_mean, 9) AS field_mean FROM fm"
O["subset_fixed_fraction"] = f"""WITH {F2}, l AS (SELECT volume_id, CAST(label AS INTEGER) AS label, count(*) AS n_voxels FROM f2 WHERE label > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY {_hash('label', 7)}, label) AS rk, count(*) OVER (PARTITION BY volume_id) AS n FROM l)
SELECT volume_id, label, n_voxels FROM r WHERE rk <= greatest(1, floor(n * CAST(0.3 AS DOUBLE)))"""
_BERNOULLI = f"{F2}, {_MEAN}, kp AS (SELECT * FROM fm WHERE {_hash('label', 3)} < field_mean)"
O["subset_bernoulli"] = f"WITH {_BERNOULLI} SELECT volume_id, label, n_voxels FROM kp"
O["subset_info"] = f"""WITH {_BERNOULLI} SELECT volume_id, n_total, coalesce(n_kept, 0) AS n_kept, round(coalesce(n_kept, 0) / CAST(n_total AS DOUBLE), 9) AS fraction
FROM (SELECT volume_id, count(*) AS n_total FROM fm GROUP BY 1) LEFT JOIN (SELECT volume_id, count(*) AS n_kept FROM kp GROUP BY 1) USING (volume_id)"""
O["collapse_labels"] = f"""WITH {F2}, g AS (SELECT volume_id, label, CASE WHEN label > 0 THEN 1 + CAST(floor({_hash('label', 5)} * 8) AS INTEGER) ELSE 0 END AS "group" FROM f2)
SELECT volume_id, "group", count(*) AS n_voxels, count(DISTINCT label) AS n_labels FROM g GROUP BY ALL"""
O["level_lookup"] = f"WITH {F2} SELECT volume_id, CAST(coalesce(s_nationkey, -1) AS INTEGER) AS level, count(*) AS n_voxels FROM f2 LEFT JOIN supplier ON s_suppkey = label GROUP BY ALL"
O["intensity_classes"] = f"""WITH {F2}, l AS (SELECT DISTINCT volume_id, label FROM f2 WHERE label > 0),
d AS (SELECT volume_id, label, row_number() OVER (PARTITION BY volume_id ORDER BY {_hash('label', 11)}, label) % 5 AS class FROM l),
i AS (SELECT f2.volume_id, coalesce(class, 0) AS class, prob, CASE WHEN class IS NULL THEN 0 ELSE {_hash('class + 1', 12)} END AS intensity FROM f2 LEFT JOIN d ON d.volume_id = f2.volume_id AND d.label = f2.label)
SELECT volume_id, CAST(class AS INTEGER) AS class, count(*) AS n_voxels, round(max(intensity), 9) AS intensity, round(avg(intensity * prob + CAST(0.1 AS DOUBLE) * (1 - prob)), 9) AS mean_blend FROM i GROUP BY volume_id, class"""
O["foreground_redraw"] = f"""WITH {F2}, l AS (SELECT volume_id, label, count(*) AS n FROM f2 WHERE label > 0 GROUP BY ALL), t AS (SELECT *, unnest(range(6)) AS draw FROM l),
d AS (SELECT volume_id, draw, CAST(coalesce(sum(n) FILTER ({_hash('label * 31 + draw', 13)} < CAST(0.15 AS DOUBLE)), 0) AS BIGINT) AS foreground FROM t GROUP BY ALL)
SELECT volume_id, CAST(arg_min(draw, k) AS INTEGER) AS draw, arg_min(foreground, k) AS foreground FROM (SELECT *, CASE WHEN foreground >= 700 THEN draw ELSE 12 - draw END AS k FROM d) GROUP BY volume_id"""
O["grow_labels"] = f"""WITH {F2}, s AS (SELECT {K}, CAST(label AS INTEGER) AS label FROM f2 WHERE label > 0),
o(dz) AS (SELECT unnest(range(-2, 3))), g AS (SELECT volume_id, z + a.dz AS z, y + b.dz AS y, x + c.dz AS x, label, min(abs(a.dz) + abs(b.dz) + abs(c.dz)) AS d FROM s, o a, o b, o c WHERE abs(a.dz) + abs(b.dz) + abs(c.dz) <= 2 GROUP BY ALL),
r AS (SELECT *, d - (CAST(0.5 AS DOUBLE) + label % 3) AS score FROM g), w AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY score, label) AS rk FROM r)
SELECT volume_id, label, count(*) AS n_voxels FROM w WHERE rk = 1 AND score <= 0 GROUP BY ALL"""
O["hollow_labels"] = f"""WITH {F2}, {FACES}, g AS (SELECT {K}, CASE WHEN prob > CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END AS label FROM f2),
nb AS (SELECT a.volume_id, a.z, a.y, a.x, count(*) AS n FROM g a, o6 JOIN g b ON a.volume_id = b.volume_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND b.label = 1 WHERE a.label = 1 GROUP BY ALL)
SELECT volume_id, CAST(CASE WHEN n = 6 THEN 0 ELSE label END AS INTEGER) AS label, count(*) AS n_voxels FROM g LEFT JOIN nb USING ({K}) GROUP BY 1, 2"""


def _corner() -> str:
    terms = []
    for dz in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                key = f"((CAST(volume_id AS BIGINT) * 4 + iz + {dz}) * 4 + iy + {dy}) * 4 + ix + {dx}"
                w = " * ".join(f"f{a}" if d else f"(1 - f{a})" for a, d in zip("zyx", (dz, dy, dx)))
                terms.append(f"{w} * {_hash(key, 17)}")
    return " + ".join(terms)


_AT = ", ".join(f"{a} * (CAST(3 AS DOUBLE) / greatest({n} - 1, 1)) AS p{a}" for a, n in (("z", "nz"), ("y", "8"), ("x", "8")))
_LOW = ", ".join(f"CAST(least(floor(p{a}), 2) AS BIGINT) AS i{a}, p{a} - least(floor(p{a}), 2) AS f{a}" for a in "zyx")
O["random_smooth_field"] = f"WITH {F1}, p AS (SELECT {K}, {_AT} FROM f1), c AS (SELECT {K}, {_LOW} FROM p) SELECT {K}, round({_corner()}, 9) AS field FROM c"
O["flip_and_reorder"] = f"WITH {F1} SELECT volume_id, y AS z, x AS y, nz - 1 - z AS x, round(s, 9) AS s FROM f1"
_T = "CASE WHEN nz <= 1 THEN 0 ELSE z / CAST(nz - 1 AS DOUBLE) END"
_LO, _SPAN = "CAST(0.1 AS DOUBLE)", "(CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE))"
O["density_linear"] = f"WITH {F1} SELECT {K}, round(CAST(0.2 AS DOUBLE) + (CAST(0.8 AS DOUBLE) - CAST(0.2 AS DOUBLE)) * (1 - {_T}), 9) AS density FROM f1"
O["density_sigmoid"] = f"WITH {F1} SELECT {K}, round({_LO} + {_SPAN} / (1 + exp(-12 * ({_T} - CAST(0.4 AS DOUBLE)))), 9) AS density FROM f1"
O["density_gaussian"] = f"WITH {F1} SELECT {K}, round({_LO} + {_SPAN} * exp(CAST(-0.5 AS DOUBLE) * (({_T} - 0.5) / CAST(0.25 AS DOUBLE)) * (({_T} - 0.5) / CAST(0.25 AS DOUBLE))), 9) AS density FROM f1"
O["density_radial"] = f"""WITH {F1}, d AS (SELECT {K}, sqrt((z - CAST(0.5 AS DOUBLE) * nz) * (z - CAST(0.5 AS DOUBLE) * nz) + (y - CAST(3.2 AS DOUBLE)) * (y - CAST(3.2 AS DOUBLE)) + (x - CAST(4.8 AS DOUBLE)) * (x - CAST(4.8 AS DOUBLE)))
/ sqrt(nz * nz / CAST(4 AS DOUBLE) + 32) AS t FROM f1) SELECT {K}, round({_LO} + {_SPAN} * (1 - least(greatest(t, 0), 1)), 9) AS density FROM d"""
O["density_uniform"] = f"WITH {F1V} SELECT {K}, CAST(0.35 AS DOUBLE) AS density FROM f1v"

O["raster_scatter"] = f"WITH {F2} SELECT {K}, round(dist, 9) AS dist, label, round(prob, 9) AS prob FROM f2"
_TESS = F5 + """,
lg AS (SELECT curve_id, z, y, x, radius, row_number() OVER w AS leg, lead(z) OVER w AS nz, lead(y) OVER w AS ny, lead(x) OVER w AS nx, lead(radius) OVER w AS nr FROM f5 WINDOW w AS (PARTITION BY curve_id ORDER BY ord)),
ln AS (SELECT *, sqrt((nz - z) * (nz - z) + (ny - y) * (ny - y) + (nx - x) * (nx - x)) AS length FROM lg WHERE nr IS NOT NULL),
np AS (SELECT *, CAST(greatest(1, ceil(length / CAST(1.5 AS DOUBLE))) AS INTEGER) AS n FROM ln), sg AS (SELECT *, unnest(range(n)) AS seg FROM np),
ts AS (SELECT curve_id, CAST(leg AS INTEGER) AS leg, CAST(seg AS INTEGER) AS seg, z + (nz - z) * (seg / CAST(n AS DOUBLE)) AS z0, y + (ny - y) * (seg / CAST(n AS DOUBLE)) AS y0, x + (nx - x) * (seg / CAST(n AS DOUBLE)) AS x0,
  z + (nz - z) * ((seg + 1) / CAST(n AS DOUBLE)) AS z1, y + (ny - y) * ((seg + 1) / CAST(n AS DOUBLE)) AS y1, x + (nx - x) * ((seg + 1) / CAST(n AS DOUBLE)) AS x1,
  radius + (nr - radius) * (seg / CAST(n AS DOUBLE) + (seg + 1) / CAST(n AS DOUBLE)) / 2 AS r, length FROM sg)"""
O["tessellate"] = f"WITH {_TESS} SELECT curve_id, leg, seg, {', '.join(f'round({c}, 9) AS {c}' for c in 'z0 y0 x0 z1 y1 x1 r length'.split())} FROM ts"
_RANGE = "unnest(range(CAST(greatest(round_even(({a}0 + {a}1) / 2, 0) - ceil(r) - 2, 0) AS INTEGER), CAST(least(round_even(({a}0 + {a}1) / 2, 0) + ceil(r) + 2, 31) AS INTEGER) + 1)) AS {a}"
_DOT = "((z - z0) * (z1 - z0) + (y - y0) * (y1 - y0) + (x - x0) * (x1 - x0)) / greatest((z1 - z0) * (z1 - z0) + (y1 - y0) * (y1 - y0) + (x1 - x0) * (x1 - x0), CAST(1e-12 AS DOUBLE))"
O["rasterize"] = f"""WITH {_TESS.replace("CAST(1.5 AS DOUBLE)", "CAST(6 AS DOUBLE)")}, vz AS (SELECT *, {_RANGE.format(a='z')} FROM ts), vy AS (SELECT *, {_RANGE.format(a='y')} FROM vz), vx AS (SELECT *, {_RANGE.format(a='x')} FROM vy),
t AS (SELECT *, least(greatest({_DOT}, 0), 1) AS t FROM vx),
d AS (SELECT curve_id, z, y, x, r, sqrt((z - (z0 + t * (z1 - z0))) * (z - (z0 + t * (z1 - z0))) + (y - (y0 + t * (y1 - y0))) * (y - (y0 + t * (y1 - y0))) + (x - (x0 + t * (x1 - x0))) * (x - (x0 + t * (x1 - x0)))) AS d FROM t),
p AS (SELECT *, CASE WHEN d <= r - 0.5 THEN 1 WHEN d >= r + 0.5 THEN 0 ELSE CAST(0.5 AS DOUBLE) * (1 + cos(pi() * (d - r + 0.5))) END AS p FROM d),
s AS (SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, min(d) AS dist, max(CAST(floor(p * CAST(1e6 AS DOUBLE)) AS BIGINT) * 8796093022208 + curve_id) % 8796093022208 AS label, 1 - exp(sum(ln(greatest(1 - p, CAST(1e-7 AS DOUBLE))))) AS prob FROM p GROUP BY ALL)
SELECT z, y, x, round(dist, 7) AS dist, CASE WHEN prob > 0 THEN label ELSE 0 END AS label, round(prob, 7) AS prob FROM s"""

O["logit_sigmoid"] = f"WITH {F1} SELECT {K}, round(1 / (1 + exp(-(4 * s - 2))), 9) AS probability, CAST(1 / (1 + exp(-(4 * s - 2))) AS FLOAT) >= CAST(0.5 AS FLOAT) AS mask FROM f1"
_LOGITS = F1 + """, lo AS (SELECT *, 2 - 4 * s AS l0, 4 * s - 2 + (h - 50) / CAST(50 AS DOUBLE) AS l1, 6 * s - 4 AS l2, CASE WHEN NOT target THEN 0 WHEN h % 2 = 0 THEN 1 ELSE 2 END AS ct FROM f1),
cl AS (SELECT *, (exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) AS fg,
  CAST(CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS INTEGER) AS class FROM lo)"""
O["logit_softmax_post"] = f"WITH {_LOGITS} SELECT {K}, round(least(greatest(fg, 0), 1), 9) AS probability, CAST(fg AS FLOAT) >= CAST(0.5 AS FLOAT) AS mask, class, class = 1 AS shell, class = 2 AS interior FROM cl"
_LSE = "(greatest(l1, l2) + ln(exp(l1 - greatest(l1, l2)) + exp(l2 - greatest(l1, l2))))"
O["hierarchical_logits"] = f"""WITH {_LOGITS}, f AS (SELECT {K}, {_LSE} - l0 AS f, l2 - l1 AS c, CASE WHEN target THEN CAST(1 AS DOUBLE) ELSE 0 END AS t FROM lo)
SELECT {K}, round(f, 9) AS foreground, round(c, 9) AS core, round(greatest(f, 0) - f * t + ln(1 + exp(-abs(f))), 9) AS bce FROM f"""


def _dice(p: str, t: str) -> str:
    return f"CASE WHEN count(*) FILTER ({p}) + count(*) FILTER ({t}) = 0 THEN 1 ELSE 2 * count(*) FILTER ({p} AND {t}) / CAST(count(*) FILTER ({p}) + count(*) FILTER ({t}) AS DOUBLE) END"


O["selection_score"] = f"""WITH {_LOGITS}, d AS (SELECT volume_id, {_dice('class > 0', 'ct > 0')} AS a, {_dice('class = 1', 'ct = 1')} AS b, {_dice('class = 2', 'ct = 2')} AS c FROM cl GROUP BY volume_id)
SELECT volume_id, round(a, 9) AS foreground_dice, round(b, 9) AS shell_dice, round(c, 9) AS interior_dice, round((a + b + c) / 3, 9) AS selection_score FROM d"""


def _loss(x: str, t: str, m: str) -> str:
    bce = f"(greatest({x}, 0) - {x} * {t} + ln(1 + exp(-abs({x}))))"
    p = f"(1 / (1 + exp(-{x})))"
    return f"sum({bce} * {m}) / greatest(sum({m}), CAST(1e-8 AS DOUBLE)) + 1 - (2 * sum({p} * {t} * {m}) + 1) / (sum({p} * {m}) + sum({t} * {m}) + 1)"


O["nested_loss"] = f"""WITH {_LOGITS}, f AS (SELECT volume_id, {_LSE} - l0 AS f, l2 - l1 AS c, CASE WHEN ct > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS fg, CASE WHEN ct = 2 THEN CAST(1 AS DOUBLE) ELSE 0 END AS co, CAST(1 AS DOUBLE) AS one FROM lo),
l AS (SELECT volume_id, {_loss('f', 'fg', 'one')} AS a, {_loss('c', 'co', 'fg')} AS b FROM f GROUP BY volume_id)
SELECT volume_id, round(a, 8) AS foreground_loss, round(b, 8) AS core_loss, round((a + CAST(0.5 AS DOUBLE) * b) / CAST(1.5 AS DOUBLE), 8) AS loss FROM l"""
_EPOCHS = "ep AS (SELECT o_custkey % 7 AS run, o_orderkey AS epoch, round((o_orderkey * 7919 % 1009) / CAST(1009 AS DOUBLE), 9) AS score FROM orders)"
O["running_best"] = f"""WITH {_EPOCHS}, b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch) AS best FROM ep)
SELECT b.*, (SELECT min(e.epoch) FROM ep e WHERE e.run = b.run AND e.score = b.best AND e.epoch <= b.epoch) AS best_epoch FROM b"""
O["resume_pick"] = f"""WITH {_EPOCHS}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch % 3 = 0 DESC, epoch DESC) AS rk FROM ep)
SELECT run, 'epoch_' || epoch AS path, epoch, epoch + CAST(epoch % 3 = 0 AS INTEGER) AS start_epoch FROM r WHERE rk = 1"""
O["argument_differences"] = "SELECT DISTINCT o_orderkey, 'batch,lr' AS changed FROM orders"
O["split_by_id"] = "SELECT DISTINCT CAST(p_partkey % 600 AS INTEGER) AS volume, CASE WHEN p_partkey % 600 < 510 THEN 'train' WHEN p_partkey % 600 < 570 THEN 'val' ELSE 'test' END AS split FROM part"
O["split_prefix"] = """WITH n AS (SELECT printf('%05d_label', s_suppkey) AS name FROM supplier), r AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS position, count(*) OVER () AS n FROM n)
SELECT name, position, CASE WHEN position < greatest(1, floor(n * CAST(0.2 AS DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM r"""
O["missing_extra_pairs"] = """WITH v AS (SELECT DISTINCT CAST(label AS INTEGER) AS volume_id FROM embeddings), m(method) AS (VALUES ('m0'), ('m1'), ('m2'), ('m3')), e AS (SELECT method, volume_id FROM m, v),
a AS (SELECT CASE WHEN method = 'm2' AND volume_id = 4 THEN 'm9' ELSE method END AS method, volume_id FROM e WHERE NOT (method = 'm1' AND volume_id = 3))
SELECT *, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)"""
O["mask_agreement"] = f"WITH {F3} SELECT method, volume_id, count(*) AS n_voxels, count(*) FILTER (h = 100) AS n_different FROM f3 GROUP BY ALL"
O["score_range"] = f"WITH {F3} SELECT method, volume_id, CAST(0 AS BIGINT) AS not_finite, count(*) FILTER (score < -pow(2, -23) OR score > 1 + pow(2, -23)) AS out_of_range FROM f3 GROUP BY ALL"
O["not_binary"] = f"WITH {F1V} SELECT volume_id, count(*) FILTER (h = 7) AS bad FROM f1v GROUP BY volume_id"
O["unpaired_voxels"] = f"WITH {F1V} SELECT volume_id, count(*) FILTER (h = 5) AS only_left, count(*) FILTER (h = 3) AS only_right FROM f1v GROUP BY volume_id"
O["repeated_keys"] = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"
O["wrong_counts"] = "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) <> 4"
O["settings_differ"] = """WITH o AS (SELECT DISTINCT o_orderkey AS job, o_custkey % 5 AS roi, o_custkey % 3 AS mode FROM orders)
SELECT job, 'roi' AS field, NULL::VARCHAR AS recorded, CAST(roi AS VARCHAR) AS expected FROM o WHERE job % 50 = 0 UNION ALL SELECT job, 'mode', '-1', CAST(mode AS VARCHAR) FROM o WHERE job % 70 = 0"""
O["outdated_jobs"] = "SELECT DISTINCT o_orderkey AS job, o_custkey % 5 AS setting FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 25 = 0"
O["affine_check"] = "SELECT vec_id, vec_id % 4 = 0 AS differs FROM embeddings"


def _random_density() -> str:
    def drawn(k: int, low: float = 0.0, high: float = 1.0) -> str:
        return f"(CAST({low} AS DOUBLE) + (CAST({high} AS DOUBLE) - CAST({low} AS DOUBLE)) * {_hash(f'(CAST(volume_id AS BIGINT) * 16 + {k})', 23)})"

    t = "CASE axis WHEN 0 THEN CASE WHEN nz <= 1 THEN 0 ELSE z / CAST(nz - 1 AS DOUBLE) END WHEN 1 THEN y / CAST(7 AS DOUBLE) ELSE x / CAST(7 AS DOUBLE) END"
    return f"""WITH {F1}, u AS (SELECT volume_id, CAST(floor({drawn(0)} * 5) AS INTEGER) AS kind, CAST(floor({drawn(1)} * 3) AS INTEGER) AS axis, {drawn(2, 0.05, 0.4)} AS low, {drawn(3, 0.6, 1.0)} AS high,
{drawn(4)} < 0.5 AS up, {drawn(5, 0.3, 0.7)} AS c5, {drawn(6, 0.3, 0.7)} AS c6, {drawn(7, 0.3, 0.7)} AS c7, {drawn(6, 5.0, 20.0)} AS steep, {drawn(5, 0.2, 0.8)} AS mid, {drawn(6, 0.1, 0.4)} AS wide, {drawn(5, 0.3, 1.0)} AS flat
FROM (SELECT DISTINCT volume_id FROM f1)), r AS (SELECT {K}, nz, u.* EXCLUDE (volume_id), {t} AS t FROM f1 JOIN u USING (volume_id)),
q AS (SELECT *, CASE WHEN up THEN t ELSE 1 - t END AS w, least(greatest(sqrt((z - c5 * nz) * (z - c5 * nz) + (y - c6 * 8) * (y - c6 * 8) + (x - c7 * 8) * (x - c7 * 8)) / sqrt(nz * nz / CAST(4 AS DOUBLE) + 32), 0), 1) AS far FROM r)
SELECT {K}, kind, round(CASE kind WHEN 0 THEN low + (high - low) * w WHEN 1 THEN low + (high - low) / (1 + exp(-steep * (w - c5))) WHEN 2 THEN low + (high - low) * exp(CAST(-0.5 AS DOUBLE) * ((t - mid) / wide) * ((t - mid) / wide))
WHEN 3 THEN low + (high - low) * CASE WHEN up THEN 1 - far ELSE far END ELSE flat END, 8) AS density FROM q"""


O["random_density"] = _random_density()
O["paired_files"] = """WITH s AS (SELECT printf('%05d', s_suppkey) AS stem, s_suppkey % 11 <> 3 AS l, s_suppkey % 13 <> 5 AS p FROM supplier)
SELECT stem, CASE WHEN l THEN 'data/' || stem || '_label.nii.gz' END AS left_path, CASE WHEN p THEN 'data/' || stem || '_prob.nii.gz' END AS right_path,
CASE WHEN NOT l THEN 'no _label' WHEN NOT p THEN 'no _prob' END AS problem FROM s WHERE l OR p"""
O["first_files"] = "SELECT 'data/' || printf('%05d', s_suppkey) || '_label.nii.gz' AS path FROM supplier WHERE s_suppkey % 11 <> 3 ORDER BY s_suppkey LIMIT 20"
_JOBS = """WITH v AS (SELECT DISTINCT CAST(label AS INTEGER) AS volume_id FROM embeddings), m(method) AS (VALUES ('m0'), ('m1'), ('m2'), ('m3')),
j AS (SELECT volume_id, method, CAST(row_number() OVER (ORDER BY method, volume_id) - 1 AS INTEGER) AS "index" FROM m, v) SELECT * FROM j"""
O["numbered_jobs"] = _JOBS
O["job_at"] = _JOBS + ' WHERE "index" = 17'
O["generation_plan"] = f"""WITH e AS (SELECT p_partkey, p_partkey + 42000 AS seed, CAST(6.1 AS DOUBLE) + (CAST(6.6 AS DOUBLE) - CAST(6.1 AS DOUBLE)) * {_hash('p_partkey', 42000)} AS exponent FROM part)
SELECT p_partkey, seed, round(exponent, 8) AS exponent, greatest(1, CAST(floor(pow(CAST(10 AS DOUBLE), exponent) * (CAST(2097152 AS DOUBLE) * pow(CAST(0.001 AS DOUBLE), 3))) AS BIGINT)) AS trees FROM e"""
O["merged_rows"] = "SELECT s_suppkey AS id, s_nationkey AS level, NULL AS score FROM supplier UNION ALL SELECT p_partkey, NULL, p_partkey % 7 FROM part"
O["percentiles_by_range"] = f"""WITH {F1V} SELECT volume_id, round(quantile_cont(v, 0.005), 9) AS p0_5, round(quantile_cont(v, 0.5), 9) AS p50, round(quantile_cont(v, 0.995), 9) AS p99_5 FROM f1v GROUP BY volume_id"""
O["nifti_round_trip"] = f"WITH {F1} SELECT CAST(volume_id AS VARCHAR) AS volume_id, z, y, x, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 6) AS value FROM f1"

_FILED = f"""{F3}, filed AS (SELECT method || '_' || volume_id AS "case", volume_id, z, target,
  CAST(least(greatest(score, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS FLOAT) >= CAST(threshold AS FLOAT) AS prediction FROM c3)"""
O["cases_from_files"] = f"WITH {_FILED}, c AS ({_confusion('filed', '"case"')}) {_metrics('c', '"case"')}"
O["scanned_planes"] = f"WITH {F1} SELECT CAST(volume_id AS VARCHAR) AS volume_id, z, count(*) AS n_voxels, count(*) FILTER (target) AS n_target FROM f1 WHERE z BETWEEN 20 AND 21 GROUP BY ALL"

_LUMPS = f"""{F2}, lumps AS MATERIALIZED (SELECT {K}, CASE WHEN prob > CAST(0.05 AS DOUBLE) THEN CAST(1 + z // 8 * 4 + y // 8 * 2 + x // 8 AS INTEGER) ELSE 0 END AS label FROM f2),
own AS MATERIALIZED (SELECT * FROM lumps WHERE label > 0)"""


def _ball(reach: int) -> str:
    return f"ball AS MATERIALIZED (SELECT a AS dz, b AS dy, c AS dx, abs(a) + abs(b) + abs(c) AS d FROM range({-reach}, {reach + 1}) r(a), range({-reach}, {reach + 1}) s(b), range({-reach}, {reach + 1}) t(c) WHERE abs(a) + abs(b) + abs(c) <= {reach})"


_INSIDE = "z BETWEEN 0 AND 31 AND y BETWEEN 0 AND 15 AND x BETWEEN 0 AND 15"
_REACHED = f"SELECT volume_id, label, z + dz AS z, y + dy AS y, x + dx AS x, min(d) AS d FROM own, ball GROUP BY ALL"
_DEPTHS_OF = "SELECT a.volume_id, a.z, a.y, a.x, a.label, CAST(min(d) AS INTEGER) AS depth FROM {own} a CROSS JOIN ball LEFT JOIN {own} b ON b.volume_id = a.volume_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND b.label = a.label WHERE b.label IS NULL GROUP BY ALL"
O["label_distances"] = f"""WITH {_LUMPS}, {_ball(3)}, g AS ({_REACHED}) SELECT volume_id, label, CAST(d AS INTEGER) AS d, count(*) AS n_voxels, CAST(sum(z * 10000 + y * 100 + x) AS BIGINT) AS places FROM g WHERE {_INSIDE} GROUP BY volume_id, label, d"""
O["label_depths"] = f"WITH {_LUMPS}, {_ball(5)} {_DEPTHS_OF.format(own='own')}"
O["nearest_labels"] = f"""WITH {_LUMPS}, s AS (SELECT * FROM own WHERE z % 8 = 3 AND y % 8 < 2), grid AS (SELECT DISTINCT volume_id, a AS z, b AS y, c AS x FROM s, range(32) r(a), range(16) t(b), range(16) u(c)),
m AS (SELECT g.volume_id, g.z, g.y, g.x, min((abs(g.z - s.z) + abs(g.y - s.y) + abs(g.x - s.x)) * 1000 + s.label) AS k FROM grid g JOIN s USING (volume_id) GROUP BY ALL)
SELECT volume_id, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(k % 1000 AS INTEGER) AS label, CAST(k // 1000 AS INTEGER) AS d FROM m"""


def _label_field(nodes: int, seed: int, sizes: dict[str, int]) -> str:
    """Tri-linear field of a row's label between hashed nodes, as a formula of z, y, x and label."""
    terms = []
    at = {a: f"({a} * (CAST({nodes - 1} AS DOUBLE) / {n - 1}))" for a, n in sizes.items()}
    low = {a: f"least(floor({p}), {nodes - 2})" for a, p in at.items()}
    for dz in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                key = "label"
                for a, d in zip("zyx", (dz, dy, dx)):
                    key = f"(({key}) * {nodes} + CAST({low[a]} AS BIGINT) + {d})"
                w = " * ".join(f"({at[a]} - {low[a]})" if d else f"(1 - ({at[a]} - {low[a]}))" for a, d in zip("zyx", (dz, dy, dx)))
                terms.append(f"{w} * {_hash(key, seed)}")
    return "(" + " + ".join(terms) + ")"


_BOTTOM, _TOP = f"({_hash('label', 32)} * CAST(-4 AS DOUBLE))", f"({_hash('label', 33)} * CAST(4 AS DOUBLE))"
_RADIUS = f"CASE WHEN {_hash('label', 34)} < CAST(0.7 AS DOUBLE) THEN {_BOTTOM} + (greatest({_TOP}, {_BOTTOM}) - {_BOTTOM}) * {_label_field(4, 31, {'z': 32, 'y': 16, 'x': 16})} ELSE CAST(0 AS DOUBLE) END"
O["morphed_labels"] = f"""WITH {_LUMPS}, {_ball(8)}, g AS ({_REACHED}), dep AS ({_DEPTHS_OF.format(own='own')}), one AS (SELECT volume_id, z, y, x, 0 AS label FROM own), gr AS ({_DEPTHS_OF.format(own='one')}),
s AS (SELECT g.*, CASE WHEN g.d = 0 THEN -coalesce(depth, 8) ELSE g.d END AS sd FROM g LEFT JOIN dep USING (volume_id, z, y, x, label) WHERE {_INSIDE}),
r AS (SELECT volume_id, z, y, x, label, d, sd - ({_RADIUS}) AS score FROM s),
b AS (SELECT volume_id, z, y, x, arg_min(label, (score, label)) AS label, min(score) AS score, min(d) AS near FROM r GROUP BY ALL)
SELECT b.volume_id, b.z, b.y, b.x, b.label FROM b LEFT JOIN gr ON gr.volume_id = b.volume_id AND gr.z = b.z AND gr.y = b.y AND gr.x = b.x
WHERE score < CASE WHEN near > 0 THEN -near ELSE coalesce(gr.depth, 8) END"""
O["hollow_and_refill"] = f"""WITH {_LUMPS}, {_ball(9)}, chosen AS MATERIALIZED (SELECT * FROM own WHERE label % 3 <> 0), dep AS ({_DEPTHS_OF.format(own='chosen')}),
core AS MATERIALIZED (SELECT * FROM dep WHERE depth >= CAST(1.25 AS DOUBLE) + z / CAST(32 AS DOUBLE)),
f AS (SELECT c.volume_id, c.z, c.y, c.x, min(d * 1000 + coalesce(l.label, 0)) % 1000 AS fill FROM core c CROSS JOIN ball LEFT JOIN own l ON l.volume_id = c.volume_id AND l.z = c.z + dz AND l.y = c.y + dy AND l.x = c.x + dx
  WHERE l.label IS NULL OR l.label % 3 = 0 GROUP BY ALL)
SELECT l.volume_id, l.z, l.y, l.x, CAST(coalesce(fill, l.label) AS INTEGER) AS label FROM lumps l LEFT JOIN f USING (volume_id, z, y, x)"""


def _arcs(step: str) -> str:
    """cut: points of the curves at equal steps along them."""
    return f"""w5 AS (SELECT *, row_number() OVER w AS leg, lead(z) OVER w AS z2, lead(y) OVER w AS y2, lead(x) OVER w AS x2, lead(radius) OVER w AS r2 FROM f5 WINDOW w AS (PARTITION BY curve_id ORDER BY ord)),
l5 AS (SELECT *, sum(sqrt((z2 - z) * (z2 - z) + (y2 - y) * (y2 - y) + (x2 - x) * (x2 - x))) OVER (PARTITION BY curve_id ORDER BY leg) AS til FROM w5 WHERE r2 IS NOT NULL),
g5 AS (SELECT *, coalesce(lag(til) OVER v, CAST(0 AS DOUBLE)) AS since, max(til) OVER (PARTITION BY curve_id) AS total, lead(leg) OVER v AS more FROM l5 WINDOW v AS (PARTITION BY curve_id ORDER BY leg)),
n5 AS (SELECT *, greatest(2, ceil(total / CAST({step} AS DOUBLE)) + 1) AS n, CASE WHEN total > 0 THEN total / (greatest(2, ceil(total / CAST({step} AS DOUBLE)) + 1) - 1) ELSE CAST(1 AS DOUBLE) END AS gap FROM g5),
k5 AS (SELECT *, unnest(range(CAST(CASE WHEN leg = 1 THEN 0 ELSE least(ceil(since / gap), n - 1) END AS BIGINT), CAST(CASE WHEN more IS NULL THEN n ELSE ceil(til / gap) END AS BIGINT))) AS point FROM n5),
t5 AS (SELECT *, CASE WHEN til > since THEN least(greatest((point * gap - since) / (til - since), 0), 1) ELSE CAST(0 AS DOUBLE) END AS t FROM k5),
cut AS (SELECT curve_id, point, z + (z2 - z) * t AS z, y + (y2 - y) * t AS y, x + (x2 - x) * t AS x, radius + (r2 - radius) * t AS radius FROM t5)"""


O["arc_point_counts"] = f"WITH {F5}, {_arcs('2.5')} SELECT curve_id, count(*) AS n_points, round(avg(radius), 9) AS radius FROM cut GROUP BY curve_id"
O["tessellate_arcs"] = f"""WITH {F5}, {_arcs('4')}, e AS (SELECT curve_id, CAST(point AS INTEGER) AS seg, z AS z0, y AS y0, x AS x0, lead(z) OVER w AS z1, lead(y) OVER w AS y1, lead(x) OVER w AS x1,
  (radius + lead(radius) OVER w) / 2 AS r FROM cut WINDOW w AS (PARTITION BY curve_id ORDER BY point))
SELECT curve_id, seg, {", ".join(f"round({c}, 7) AS {c}" for c in ("z0", "y0", "x0", "z1", "y1", "x1", "r"))} FROM e WHERE r IS NOT NULL"""

_D = "CAST({} AS DOUBLE)"
_PROXIES = f"""{F1}, heads AS (SELECT volume_id, nz, {_D.format('0.35')} + volume_id * {_D.format('0.07')} AS s0, {_D.format('0.9')} - volume_id * {_D.format('0.05')} AS s1, {_D.format('0.5')} AS s2 FROM (SELECT DISTINCT volume_id, nz FROM f1)),
h AS MATERIALIZED (SELECT volume_id, axis, n, s, CAST(round_even((n - 1) * s / {_D.format('0.8')}, 0) AS BIGINT) + 1 AS m, greatest({_D.format('0.8')} / s - 1, 0) / 2 AS sigma
  FROM (SELECT volume_id, 'z' AS axis, 8 AS n, s2 AS s FROM heads UNION ALL SELECT volume_id, 'y', nz, s0 FROM heads UNION ALL SELECT volume_id, 'x', 8, s1 FROM heads))"""
_WEIGHTS = """k AS MATERIALIZED (SELECT volume_id, axis, n, i, exp(CAST(-0.5 AS DOUBLE) * (i / sigma) * (i / sigma)) / sum(exp(CAST(-0.5 AS DOUBLE) * (i / sigma) * (i / sigma))) OVER (PARTITION BY volume_id, axis) AS w
  FROM (SELECT *, unnest(range(-CAST(floor(4 * sigma + 0.5) AS BIGINT), CAST(floor(4 * sigma + 0.5) AS BIGINT) + 1)) AS i FROM h WHERE sigma > 0)
  UNION ALL SELECT volume_id, axis, n, 0, CAST(1 AS DOUBLE) FROM h WHERE sigma = 0)"""
_CHAIN, _LAST = [], "v0"
for _a in "zyx":
    _o = ", ".join(f"v.{b}" for b in "zyx" if b != _a)
    _CHAIN.append(f"""smooth_{_a} AS MATERIALIZED (SELECT t.volume_id, {_o.replace('v.', 't.')}, t.{_a}, sum(k.w * v.value) AS value FROM {_LAST} t JOIN k ON k.volume_id = t.volume_id AND k.axis = '{_a}'
  JOIN {_LAST} v ON v.volume_id = t.volume_id AND {' AND '.join(f'v.{b} = t.{b}' for b in 'zyx' if b != _a)}
  AND v.{_a} = CASE WHEN (((t.{_a} + k.i) % (2 * k.n)) + 2 * k.n) % (2 * k.n) < k.n THEN (((t.{_a} + k.i) % (2 * k.n)) + 2 * k.n) % (2 * k.n) ELSE 2 * k.n - 1 - (((t.{_a} + k.i) % (2 * k.n)) + 2 * k.n) % (2 * k.n) END GROUP BY ALL)""")
    _CHAIN.append(f"""grid_{_a} AS (SELECT volume_id, n, j, p, least(floor(p), greatest(n - 2, 0)) AS low FROM (SELECT *, least(greatest((n - 1) / CAST(2 AS DOUBLE) + (j - (m - 1) / CAST(2 AS DOUBLE)) * (CAST(0.8 AS DOUBLE) / s), 0), n - 1) AS p
  FROM (SELECT *, unnest(range(m)) AS j FROM h WHERE axis = '{_a}'))),
new_{_a} AS MATERIALIZED (SELECT g.volume_id, {_o}, CAST(g.j AS INTEGER) AS {_a}, sum(v.value * CASE WHEN v.{_a} = g.low THEN 1 - (g.p - g.low) ELSE g.p - g.low END) AS value FROM grid_{_a} g JOIN smooth_{_a} v ON v.volume_id = g.volume_id AND (v.{_a} = g.low OR v.{_a} = g.low + 1) GROUP BY ALL)""")
    _LAST = f"new_{_a}"
O["prepared_volumes"] = f"WITH {_PROXIES}, {_WEIGHTS}, v0 AS (SELECT volume_id, x AS z, z AS y, y AS x, s AS value FROM f1), {', '.join(_CHAIN)} SELECT volume_id, z, y, x, round(value, 8) AS value FROM new_x"
_OLD = [["0", "0", "s1"], ["0", "-s0", "0"], ["s2", "0", "0"]]  # columns of the permuted affine: old axes 2, 0, 1
_NEW = [["0", "0", "0.8"], ["0", "-0.8", "0"], ["0.8", "0", "0"]]
_MOVED = [[f"({_OLD[r][c]})" for c in range(3)] for r in range(3)]
_N, _M = ("7", "(nz - 1)", "7"), ("(mz - 1)", "(my - 1)", "(mx - 1)")
_ROWS = []
for _r, _t in enumerate(("4", "5", "6")):
    _ROWS += [f"CAST({_NEW[_r][c]} AS DOUBLE)" for c in range(3)]
    _ROWS.append(f"{_t} + " + " + ".join(f"{_MOVED[_r][c]} * {_N[c]} / CAST(2 AS DOUBLE) - CAST({_NEW[_r][c]} AS DOUBLE) * {_M[c]} / CAST(2 AS DOUBLE)" for c in range(3)))
O["prepared_headers"] = f"""WITH {_PROXIES}, p AS (SELECT heads.*, max(CASE WHEN axis = 'z' THEN m END) AS mz, max(CASE WHEN axis = 'y' THEN m END) AS my, max(CASE WHEN axis = 'x' THEN m END) AS mx FROM heads JOIN h USING (volume_id) GROUP BY ALL)
SELECT 'volume' || volume_id AS volume_id, CAST(mz AS INTEGER) AS nz, CAST(my AS INTEGER) AS ny, CAST(mx AS INTEGER) AS nx, 'float32' AS dtype, 3 AS unit, 1 AS qform, 2 AS sform,
{", ".join(f"round({v}, 4) AS a{i}" for i, v in enumerate(_ROWS))} FROM p"""


def _ridges(name: str, where: str, sigmas: tuple, alpha: float, beta: float) -> str:
    """{name}: volume_id, z, y, x, ridge of some volumes of f1."""
    ctes, last = [], f"{name}_v"
    ctes.append(f"{name}_v AS (SELECT volume_id, z, y, x, nz, CAST(sg AS DOUBLE) AS sg, s AS value FROM f1, (SELECT unnest([{', '.join(map(str, sigmas))}]) AS sg) WHERE {where})")
    ctes.append(f"""{name}_k AS (SELECT sg, i, exp(CAST(-0.5 AS DOUBLE) * (i / sg) * (i / sg)) / sum(exp(CAST(-0.5 AS DOUBLE) * (i / sg) * (i / sg))) OVER (PARTITION BY sg) AS w
  FROM (SELECT sg, unnest(range(-CAST(floor(4 * sg + 0.5) AS BIGINT), CAST(floor(4 * sg + 0.5) AS BIGINT) + 1)) AS i FROM (SELECT unnest([{', '.join(f'CAST({s} AS DOUBLE)' for s in sigmas)}]) AS sg)))""")
    for a, n in (("z", "nz"), ("y", "8"), ("x", "8")):  # weights that reach the same voxel by reflection are summed first
        mirrored = f"CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END"
        ctes.append(f"""{name}_m{a} AS MATERIALIZED (SELECT sg, n, t, {mirrored} AS o, sum(w) AS w FROM (SELECT k.sg, n, t, w, (((t + i) % (2 * n)) + 2 * n) % (2 * n) AS q FROM {name}_k k, (SELECT n, unnest(range(n)) AS t FROM (SELECT DISTINCT CAST({n} AS BIGINT) AS n FROM {name}_v))) GROUP BY ALL)""")
        rest = ", ".join(f"v.{b}" for b in "zyx" if b != a)
        ctes.append(f"{name}_s{a} AS MATERIALIZED (SELECT v.volume_id, v.nz, v.sg, {rest}, m.t AS {a}, sum(m.w * v.value) AS value FROM {last} v JOIN {name}_m{a} m ON m.sg = v.sg AND m.n = {'v.nz' if a == 'z' else n} AND m.o = v.{a} GROUP BY ALL)")
        last = f"{name}_s{a}"

    def grad(column: str, a: str) -> str:
        w = f"OVER (PARTITION BY volume_id, sg, {', '.join(b for b in 'zyx' if b != a)} ORDER BY {a})"
        return f"CASE WHEN lag({column}) {w} IS NULL AND lead({column}) {w} IS NULL THEN 0 WHEN lag({column}) {w} IS NULL THEN lead({column}) {w} - {column} WHEN lead({column}) {w} IS NULL THEN {column} - lag({column}) {w} ELSE (lead({column}) {w} - lag({column}) {w}) / 2 END"

    ctes.append(f"{name}_g AS MATERIALIZED (SELECT *, {', '.join(f'{grad('value', a)} AS g{a}' for a in 'zyx')} FROM {last})")
    pairs = [("z", "z"), ("z", "y"), ("z", "x"), ("y", "y"), ("y", "x"), ("x", "x")]
    ctes.append(f"{name}_h AS MATERIALIZED (SELECT volume_id, sg, z, y, x, {', '.join(f'sg * sg * ({grad('g' + a, b)}) AS {a}{b}' for a, b in pairs)} FROM {name}_g)")
    ctes.append(f"{name}_q AS (SELECT *, (zz + yy + xx) / 3 AS mean, sqrt((pow(zz - (zz + yy + xx) / 3, 2) + pow(yy - (zz + yy + xx) / 3, 2) + pow(xx - (zz + yy + xx) / 3, 2) + 2 * (zy * zy + zx * zx + yx * yx)) / 6) AS sp FROM {name}_h)")
    ctes.append(f"{name}_d AS (SELECT *, (zz - mean) * ((yy - mean) * (xx - mean) - yx * yx) - zy * (zy * (xx - mean) - yx * zx) + zx * (zy * yx - (yy - mean) * zx) AS dt FROM {name}_q)")
    ctes.append(f"{name}_t AS (SELECT *, acos(least(greatest(CASE WHEN sp * sp * sp = 0 THEN CAST(0 AS DOUBLE) ELSE dt / (2 * sp * sp * sp) END, -1), 1)) / 3 AS tn FROM {name}_d)")
    ctes.append(f"{name}_e AS (SELECT *, mean + 2 * sp * cos(tn) AS hi, mean + 2 * sp * cos(tn + 2 * pi() / 3) AS lo FROM {name}_t)")
    ctes.append(f"{name}_l AS (SELECT volume_id, sg, z, y, x, list_sort([{{'a': abs(hi), 'v': hi}}, {{'a': abs(3 * mean - hi - lo), 'v': 3 * mean - hi - lo}}, {{'a': abs(lo), 'v': lo}}]) AS e FROM {name}_e)")
    ctes.append(f"{name}_p AS MATERIALIZED (SELECT volume_id, sg, z, y, x, e[2].a / greatest(e[3].a, CAST(1e-10 AS DOUBLE)) AS ra, e[1].a / sqrt(greatest(e[2].a * e[3].a, CAST(1e-10 AS DOUBLE))) AS rb, sqrt(e[1].a * e[1].a + e[2].a * e[2].a + e[3].a * e[3].a) AS s, e[2].v < 0 AND e[3].v < 0 AS bright FROM {name}_l)")
    ctes.append(f"{name}_c AS (SELECT volume_id, sg, CASE WHEN max(s) > 0 THEN max(s) / 2 ELSE CAST(1 AS DOUBLE) END AS c FROM {name}_p GROUP BY ALL)")
    ctes.append(f"""{name} AS (SELECT volume_id, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, max(CASE WHEN bright THEN (1 - exp(-(ra * ra) / CAST({2 * alpha**2} AS DOUBLE))) * exp(-(rb * rb) / CAST({2 * beta**2} AS DOUBLE)) * (1 - exp(-(s * s) / (2 * c * c))) ELSE CAST(0 AS DOUBLE) END) AS ridge
  FROM {name}_p JOIN {name}_c USING (volume_id, sg) GROUP BY ALL)""")
    return ", ".join(ctes)


O["ridge_score"] = f"WITH {F1}, {_ridges('r', 'TRUE', (1, 2), 0.5, 0.5)} SELECT {K}, round(ridge, 5) AS ridge FROM r"
_PART = "SELECT {k}, '{d}' AS domain, round(ridge, 5) AS ridge, CAST(ridge AS FLOAT) >= CAST({t} AS FLOAT) AS mask FROM {n}"
O["ridge_masks"] = f"""WITH {F1}, {_ridges('rh', 'volume_id < 5', (3, 4, 5, 6, 7), 0.25, 0.5)}, {_ridges('rm', 'volume_id >= 5', tuple(range(2, 11)), 0.25, 0.33)}
{_PART.format(k=K, d='human', t=0.05, n='rh')} UNION ALL {_PART.format(k=K, d='macaque', t=0.01, n='rm')}"""


def _draw(seed: int, name: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}:{name}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / CAST({1 << 52} AS DOUBLE))"


def _normal(seed: int, name: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln({_draw(seed, name + '.r', *keys)})) * cos(2 * pi() * {_draw(seed, name + '.t', *keys)}))"


def _gamma(seed: int, name: str, shape: int, *keys: str) -> str:
    return f"((0 - {' - '.join(f'ln({_draw(seed, f'{name}.{i}', *keys)})' for i in range(shape))}) / {shape})"


def _drawn_field(seed: int, name: str, nodes: int, sizes: dict[str, int]) -> str:
    at = {a: f"({a} * (CAST({nodes - 1} AS DOUBLE) / {n - 1}))" for a, n in sizes.items()}
    low = {a: f"CAST(least(floor({p}), {nodes - 2}) AS INTEGER)" for a, p in at.items()}
    terms = []
    for corner in [(z, y, x) for z in (0, 1) for y in (0, 1) for x in (0, 1)]:
        w = " * ".join(f"({at[a]} - {low[a]})" if d else f"(1 - ({at[a]} - {low[a]}))" for a, d in zip("zyx", corner))
        terms.append(f"{w} * {_draw(seed, name, 'volume_id', *[f'({low[a]} + {d})' for a, d in zip('zyx', corner)])}")
    return "(" + " + ".join(terms) + ")"


_AXES = ("z", "y", "x")
O["hashed_draws"] = f"WITH {F2} SELECT {K}, round({_normal(5, 'n', 'volume_id', *_AXES)}, 8) AS normal, round({_gamma(5, 'g', 3, 'volume_id', *_AXES)}, 8) AS gamma FROM f2"
O["retried_subsets"] = f"""WITH {_LUMPS}, l AS (SELECT DISTINCT volume_id, label FROM own), t AS (SELECT volume_id, label, attempt FROM l, (SELECT unnest(range(10)) AS attempt)),
kept AS (SELECT * FROM t WHERE {_draw(3, "keep' || attempt || '", 'volume_id', 'label')} < CAST(0.12 AS DOUBLE)),
f AS (SELECT volume_id, min(attempt) AS attempt FROM kept WHERE label BETWEEN 1 AND 2 GROUP BY volume_id),
a AS (SELECT volume_id, attempt FROM (SELECT DISTINCT volume_id FROM l) LEFT JOIN f USING (volume_id))
SELECT a.volume_id, CAST(a.attempt AS INTEGER) AS attempt, count(*) FILTER (a.attempt IS NULL OR k.label IS NOT NULL) AS n_voxels
FROM a JOIN own o ON o.volume_id = a.volume_id LEFT JOIN kept k ON k.volume_id = o.volume_id AND k.label = o.label AND k.attempt = a.attempt GROUP BY a.volume_id, a.attempt"""
_S = {"z": 32, "y": 16, "x": 16}
_MIX = "({m} + (CAST(0.25 AS DOUBLE) * {d}) * {n})"


def _mixed(name: str, group: str) -> str:
    return _MIX.format(m=_draw(7, f"{name}.mean", "volume_id", group), d=_draw(7, f"{name}.deviation", "volume_id", group), n=_normal(7, name, "volume_id", *_AXES))


O["synthetic_images"] = f"""WITH {_LUMPS}, dense AS MATERIALIZED (SELECT v.volume_id, CAST(a AS INTEGER) AS z, CAST(b AS INTEGER) AS y, CAST(c AS INTEGER) AS x, coalesce(l.label, 0) AS label, coalesce(f2.prob, CAST(0 AS DOUBLE)) AS prob
  FROM (SELECT DISTINCT volume_id FROM f2) v CROSS JOIN range(32) r(a) CROSS JOIN range(16) s(b) CROSS JOIN range(16) t(c)
  LEFT JOIN lumps l ON l.volume_id = v.volume_id AND l.z = a AND l.y = b AND l.x = c LEFT JOIN f2 ON f2.volume_id = v.volume_id AND f2.z = a AND f2.y = b AND f2.x = c),
o AS (SELECT volume_id, label, row_number() OVER (PARTITION BY volume_id ORDER BY {_draw(7, 'order', 'volume_id', 'label')}, label) - 1 AS rk, count(*) OVER (PARTITION BY volume_id) AS n,
  1 + CAST(floor({_draw(7, 'groups', 'volume_id')} * 5) AS INTEGER) AS gs FROM (SELECT DISTINCT volume_id, label FROM dense WHERE label > 0)),
g AS (SELECT volume_id, label, CAST(1 + floor(rk / ceil(n / CAST(gs AS DOUBLE))) AS INTEGER) AS grp FROM o),
i0 AS (SELECT d.*, coalesce(grp, 0) AS grp, CAST(floor({_drawn_field(7, 'patches', 8, _S)} * 16) AS INTEGER) AS patch FROM dense d LEFT JOIN g USING (volume_id, label)),
i1 AS MATERIALIZED (SELECT *, {_mixed('foreground', 'grp')} AS f, {_mixed('background', 'patch')} AS b FROM i0),
rg AS (SELECT volume_id, min(f) AS f0, max(f) AS f1, min(b) AS b0, max(b) AS b1 FROM i1 GROUP BY volume_id),
i2 AS (SELECT *, CAST(0.3 AS DOUBLE) + CAST(0.2 AS DOUBLE) * {_draw(7, 'lower', 'volume_id')} AS lo, CASE WHEN {_draw(7, 'has_background', 'volume_id')} < CAST(0.5 AS DOUBLE) THEN CAST(0.2 AS DOUBLE) + CAST(0.2 AS DOUBLE) * {_draw(7, 'upper', 'volume_id')} ELSE CAST(0 AS DOUBLE) END AS up FROM i1 JOIN rg USING (volume_id)),
i3 AS (SELECT *, (lo + (1 - lo) * ((f - f0) / (f1 - f0))) * prob + up * ((b - b0) / (b1 - b0)) * (1 - prob) + (CAST(-0.25 AS DOUBLE) + CAST(0.5 AS DOUBLE) * {_drawn_field(7, 'add', 4, _S)}) AS i FROM i2),
i4 AS (SELECT *, pow(greatest(i, 0) * (CAST(0.75 AS DOUBLE) + CAST(0.5 AS DOUBLE) * {_drawn_field(7, 'multiply', 4, _S)}), pow(2, CAST(-1 AS DOUBLE) + 2 * {_draw(7, 'gamma', 'volume_id')})) AS j FROM i3),
i5 AS MATERIALIZED (SELECT volume_id, z, grp, j * {_gamma(7, 'noise', 4, 'volume_id', *_AXES)} + CAST(0.02 AS DOUBLE) * {_normal(7, 'noise.add', 'volume_id', *_AXES)} AS i FROM i4),
q AS (SELECT volume_id, quantile_cont(i, 0.005) AS lo, quantile_cont(i, 0.995) AS hi FROM i5 GROUP BY volume_id),
im AS (SELECT volume_id, z, grp, least(greatest((least(greatest(i, lo), hi) - lo) / (hi - lo), 0), 1) AS image FROM i5 JOIN q USING (volume_id))
SELECT volume_id, z, round(avg(image), 6) AS mean, round(min(image), 6) AS low, round(max(image), 6) AS high, max(grp) AS groups FROM im GROUP BY volume_id, z"""

_RECORDS = """a AS (SELECT event_id, json_object('type', event_type, 'more', json_object('props', CAST(props AS JSON), 'sizes', json_array(user_id % 3, 2)), 'note', NULL) AS doc FROM events),
b AS (SELECT event_id, json_object('type', event_type, 'more', json_object('props', CAST(CASE WHEN event_id % 7 = 0 THEN '{}' ELSE props END AS JSON), 'sizes', json_array(CAST(user_id % 3 AS DOUBLE), CASE WHEN event_id % 5 = 0 THEN CAST(2.5 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END)),
  'note', CASE WHEN event_id % 11 = 0 THEN 'x' END, 'added', CASE WHEN event_id % 7 = 0 THEN 1 END) AS doc FROM events)"""


def _paths(rows: str) -> str:
    return f"""SELECT event_id, fullkey AS path, CASE WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'NUMBER' WHEN type = 'VARCHAR' THEN 'STRING' ELSE type END AS kind,
  CASE WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(CAST(value AS DOUBLE) AS VARCHAR) WHEN type = 'NULL' THEN 'null' ELSE CAST(value AS VARCHAR) END AS value
  FROM {rows}, json_tree({rows}.doc) t WHERE type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) IN ('{{}}', '[]')"""


O["record_paths"] = f"WITH {_RECORDS} {_paths('b')}"
O["record_differences"] = f"""WITH {_RECORDS}, l AS ({_paths('a')}), r AS ({_paths('b')})
SELECT * FROM (SELECT coalesce(l.event_id, r.event_id) AS event_id, coalesce(l.path, r.path) AS path, l.value AS recorded, r.value AS expected,
  CASE WHEN l.kind IS NULL THEN 'missing' WHEN r.kind IS NULL THEN 'extra' WHEN l.kind <> r.kind OR l.value <> r.value THEN 'value' END AS problem
  FROM l FULL JOIN r ON l.event_id = r.event_id AND l.path = r.path) WHERE problem IS NOT NULL AND path <> '$.added'"""
O["record_columns"] = f"""WITH {_RECORDS}, l AS ({_paths('a')}) SELECT event_id, replace(regexp_replace(substr(path, 3), '\\[.*$', ''), '.', '_') AS name,
string_agg(CASE WHEN contains(path, '[') THEN substr(path, instr(path, '[')) || '=' || value ELSE value END, ',' ORDER BY path) AS value FROM l GROUP BY 1, 2"""
O["prediction_paths"] = f"""WITH {F3}, r AS (SELECT DISTINCT method, domain, split, 'p' || volume_id AS patch_id FROM f3)
SELECT method, patch_id, '/data/out/' || split || '/' || domain || '/' || method || '/' || patch_id || '_' || kind || '.nii.gz' AS path, CAST(1 AS BIGINT) AS n FROM r, (VALUES ('score'), ('mask')) k(kind)"""
O["overlay_images"] = f"""SELECT volume_id, y AS "row", x AS "column", r, g, b FROM ({O['slice_overlay_rgb']})"""

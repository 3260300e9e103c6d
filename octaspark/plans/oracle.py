"""SQL for DuckDB that says what the point queries return, written from the definitions."""

from __future__ import annotations

from octaspark.functions.geometry import frustum_planes
from octaspark.operators.octree import SMALL, TreeSpec
from octaspark.operators.view import Camera
from octaspark.operators.voxelize import PRIORITY_SQL, TAPS
from octaspark.sources.tables import ORDER, PC_SQL, PCS_SQL

ORD = ", ".join(ORDER)
LINEAR = "floor(least(greatest(100 * (1 - sqrt(d2)), CAST(1 AS DOUBLE)), CAST(100 AS DOUBLE)))"
EXPONENTIAL = "floor(10000 * exp(-3.5 * d2))"


def num(v: float) -> str:
    return f"({v:.17e})"


def cell(a: str, bits: int) -> str:
    n = 1 << bits
    return f"CAST(least(greatest(floor({a} * {num(n)}), 0), {n - 1}) AS BIGINT)"


def morton_sql(x: str, y: str, z: str, bits: int, order: str = "xyz") -> str:
    by = dict(zip("xyz", (x, y, z)))
    return "(" + " | ".join(f"((({by[a]} >> {i}) & 1) << {3 * i + 2 - k})" for i in range(bits) for k, a in enumerate(order)) + ")"


def fine(cloud: str, s: TreeSpec = SMALL) -> str:
    ix = ", ".join(f"{cell(a, s.fine_bits)} AS i{a}" for a in "xyz")
    key = morton_sql(*[f"(i{a} >> {s.grid_bits})" for a in "xyz"], s.max_depth)
    return f"fx AS (SELECT *, {key} AS key FROM (SELECT *, {ix} FROM {cloud}))"


def tree(cloud: str = "pcs", s: TreeSpec = SMALL) -> str:
    """CTEs fx, lv (points with leaf_level and leaf_key) and tr (nodes)."""
    counts = ", ".join(f"count(*) OVER (PARTITION BY key >> {3 * (s.max_depth - k)}) AS n{k}" for k in range(s.max_depth))
    inner = [f"n{k} > {s.capacity}" if k == s.main_depth else f"n{k} >= {s.capacity}" for k in range(s.max_depth)]
    level = "CASE " + " ".join(f"WHEN NOT ({t}) THEN {k}" for k, t in enumerate(inner)) + f" ELSE {s.max_depth} END"
    base = PC_SQL if cloud == "pc" else PCS_SQL
    return f"""WITH {base},
{fine(cloud, s)},
lv AS (SELECT *, key >> (3 * ({s.max_depth} - leaf_level)) AS leaf_key FROM (SELECT *, CAST({level} AS INT) AS leaf_level FROM (SELECT *, {counts} FROM fx))),
tr AS (SELECT CAST(l.level AS INT) AS level, key >> (3 * ({s.max_depth} - l.level)) AS key, count(*) AS n, min(leaf_level) = l.level AS is_leaf
  FROM lv, (SELECT range AS level FROM range({s.max_depth + 1})) l WHERE leaf_level >= l.level GROUP BY l.level, key >> (3 * ({s.max_depth} - l.level)))"""


def gather(c: str, bits: int, offset: int, stride: int = 3) -> str:
    return "(" + " | ".join(f"((({c} >> {stride * i + offset}) & 1) << {i})" for i in range(bits)) + ")"


def described(s: TreeSpec = SMALL) -> str:
    """CTE ds: nodes with cells, boxes, names and child masks."""
    name = "'r' || " + " || ".join(f"(CASE WHEN level > {k} THEN CAST((key >> (3 * (level - {k + 1}))) & 7 AS VARCHAR) ELSE '' END)" for k in range(s.max_depth))
    box = ", ".join(f"{c} * size AS min_{a}, ({c} + 1) * size AS max_{a}" for a, c in zip("xyz", ("ix", "iy", "iz")))
    return f"""ch AS (SELECT level - 1 AS level, key >> 3 AS key, CAST(bit_or(1 << CAST(key & 7 AS INT)) AS INT) AS child_mask FROM tr WHERE level > 0 GROUP BY 1, 2),
ds AS (SELECT *, {box} FROM (SELECT tr.*, coalesce(ch.child_mask, 0) AS child_mask, {gather('tr.key', s.max_depth, 2)} AS ix, {gather('tr.key', s.max_depth, 1)} AS iy,
  {gather('tr.key', s.max_depth, 0)} AS iz, 1.0 / pow(CAST(2 AS DOUBLE), tr.level) AS size, {name.replace('level', 'tr.level').replace('key', 'tr.key')} AS name
  FROM tr LEFT JOIN ch ON tr.level = ch.level AND tr.key = ch.key))"""


def occupied(s: TreeSpec = SMALL) -> str:
    """CTE oc: voxels per inner node."""
    at = ", ".join(f"i{a} >> ({s.max_depth} - l.level) AS v{a}" for a in "xyz")
    node = ", ".join(f"v{a} >> {s.grid_bits} AS n{a}" for a in "xyz")
    return f"""oc AS (SELECT level, {node}, count(*) AS num_voxels FROM (SELECT DISTINCT CAST(l.level AS INT) AS level, {at} FROM lv, (SELECT range AS level FROM range({s.max_depth})) l
  WHERE leaf_level > l.level) GROUP BY ALL),
ok AS (SELECT level, {morton_sql('nx', 'ny', 'nz', s.max_depth)} AS key, num_voxels FROM oc)"""


def _weighted(source: str, mask: int, weight: str = LINEAR) -> str:
    """Rows of cx, cy, cz, r, g, b, w, own from samples with v*, g*."""
    taps = ", ".join(str(t) for t in TAPS)
    low = {a: f"(v{a} - (v{a} & {mask}))" for a in "xyz"}
    c = ", ".join(f"least(greatest(v{a} + d{a}, {low[a]}), {low[a]} + {mask}) AS c{a}" for a in "xyz")
    square = " + ".join(["CAST(0 AS DOUBLE)"] + [f"(g{a} - c{a} - {num(0.5)}) * (g{a} - c{a} - {num(0.5)})" for a in "xyz"])
    return f"""SELECT cx, cy, cz, r, g, b, own, {weight} AS w FROM (SELECT *, {square} AS d2 FROM
  (SELECT *, {c}, dx = 0 AND dy = 0 AND dz = 0 AS own FROM {source}, (VALUES {taps}) t(dx, dy, dz))) WHERE d2 < 1"""


def _resolve_cells(rows: str) -> str:
    mean = ", ".join(f"CAST(floor(sum(w * {c}) / sum(w)) AS INT) AS {c}" for c in "rgb")
    return f"SELECT cx AS vx, cy AS vy, cz AS vz, {mean}, count(*) FILTER (own) AS samples FROM ({rows}) GROUP BY 1, 2, 3 HAVING count(*) FILTER (own) > 0"


def _picked(source: str, order: str, keep: str) -> str:
    return f"""SELECT vx, vy, vz, r, g, b, {keep}, samples FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY {order}) AS rn,
  count(*) OVER (PARTITION BY vx, vy, vz) AS samples FROM {source}) WHERE rn = 1"""


def cells_by(strategy: str, source: str, mask: int = 31) -> str:
    if strategy == "average":
        mean = ", ".join(f"CAST(floor(sum({c}) / count(*)) AS INT) AS {c}" for c in "rgb")
        return f"SELECT vx, vy, vz, {mean}, count(*) AS samples FROM {source} GROUP BY 1, 2, 3"
    if strategy == "neighborhood":
        return _resolve_cells(_weighted(source, mask))
    if strategy == "smooth":
        return _resolve_cells(_weighted(source, mask, EXPONENTIAL))
    if strategy == "central":
        square = " + ".join(["CAST(0 AS DOUBLE)"] + [f"(g{a} - v{a} - {num(0.5)}) * (g{a} - v{a} - {num(0.5)})" for a in "xyz"])
        return _picked(f"(SELECT *, {square} AS d2 FROM {source})", f"d2, {ORD}", ORD)
    if strategy == "random":
        return _picked(source, f"priority DESC, {ORD}", f"priority, {ORD}")
    return _picked(source, ORD, ORD)


def voxel_ctes(strategy: str, s: TreeSpec = SMALL) -> str:
    """CTEs s<level> and v<level>, deepest first, then vo with all voxels."""
    carry = {"first": f", {ORD}", "central": f", {ORD}", "random": f", priority, {ORD}"}.get(strategy, "")
    own_carry = carry.replace("priority", f"{PRIORITY_SQL} AS priority")
    positions = strategy in ("central", "neighborhood")
    out = []
    for level in range(s.max_depth - 1, -1, -1):
        up = s.max_depth - level
        g = "".join(f", {a} * {num(1 << (level + s.grid_bits))} AS g{a}" for a in "xyz") if positions else ""
        rows = f"SELECT {', '.join(f'i{a} >> {up} AS v{a}' for a in 'xyz')}, r, g, b{own_carry}{g} FROM lv WHERE leaf_level = {level + 1}"
        if level < s.max_depth - 1:
            g = "".join(f", (v{a} + {num(0.5)}) * {num(0.5)} AS g{a}" for a in "xyz") if positions else ""
            rows += f" UNION ALL SELECT vx >> 1, vy >> 1, vz >> 1, r, g, b{carry}{g} FROM v{level + 1}"
        out += [f"s{level} AS MATERIALIZED ({rows})", f"v{level} AS MATERIALIZED ({cells_by(strategy, f's{level}', (1 << s.grid_bits) - 1)})"]
    both = " UNION ALL ".join(f"SELECT {k} AS level, vx, vy, vz, r, g, b, samples FROM v{k}" for k in range(s.max_depth))
    return ",\n".join([*out, f"vo AS ({both})"])


def cloud(method: str, bits: int) -> str:
    strategy = {"interpolated": "neighborhood"}.get(method, method)
    n = 1 << bits
    rows = f"(SELECT *, {', '.join(f'{cell(a, bits)} AS v{a}, {a} * {num(n)} AS g{a}' for a in 'xyz')} FROM pc)"
    return f"WITH {PC_SQL} SELECT vx, vy, vz, r, g, b, samples FROM ({cells_by(strategy, rows, n - 1)})"


def dot(row, x: str, y: str, z: str) -> str:
    return f"({num(row[0])} * {x} + {num(row[1])} * {y} + {num(row[2])} * {z} + {num(row[3])})"


def visible(c: Camera) -> str:
    """CTE vs: described nodes with ``visible``."""
    inside = " AND ".join(
        f"{num(nx)} * {'max' if nx >= 0 else 'min'}_x + {num(ny)} * {'max' if ny >= 0 else 'min'}_y + {num(nz)} * {'max' if nz >= 0 else 'min'}_z + {num(d)} >= 0"
        for nx, ny, nz, d in frustum_planes(c.matrix)
    )
    centre = [f"((min_{a} + max_{a}) * {num(0.5)})" for a in "xyz"]
    return f"vs AS (SELECT *, level = 0 OR ({inside} AND size / greatest({dot(c.matrix[3], *centre)}, {num(0.1)}) >= {num(c.threshold)}) AS visible FROM ds)"


def frags(c: Camera, source: str = "pc", keep: str = "r, g, b") -> str:
    """CTE fr: fragments on screen."""
    pixel = lambda n, size: f"CAST(least(greatest(floor(({n} * {num(0.5)} + {num(0.5)}) * {num(size)}), 0), {size - 1}) AS INT)"
    m = c.matrix
    return f"""cl AS (SELECT *, {dot(m[3], 'x', 'y', 'z')} AS depth, {dot(m[0], 'x', 'y', 'z')} / {dot(m[3], 'x', 'y', 'z')} AS nx, {dot(m[1], 'x', 'y', 'z')} / {dot(m[3], 'x', 'y', 'z')} AS ny FROM {source}),
fr AS (SELECT {pixel('nx', c.width)} AS px, {pixel('ny', c.height)} AS py, depth, {keep} FROM cl WHERE depth > 0 AND abs(nx) <= 1 AND abs(ny) <= 1)"""

"""SQL text for the checks: named fragments with dependencies, and lattice formulas as SQL."""

from __future__ import annotations

from skyhive.functions import geo
from skyhive.registry.adapters import DISTRICT_RING, HOLE_RING, RESENT, SHAPES, STATE_RING, _sql

FRAGMENTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def fragment(name: str, sql: str, *needs: str) -> None:
    FRAGMENTS[name] = (sql, needs)


def query(sql: str, *needs: str) -> str:
    """A full statement: the fragments it needs as common table expressions, then itself."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in FRAGMENTS[name][1]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return sql
    parts = ", ".join(f"{n} AS MATERIALIZED ({FRAGMENTS[n][0]})" for n in order)
    return f"WITH {parts} {sql}"


for _name in SHAPES:
    fragment(_name, _sql(_name))
fragment("raw_again", _sql("raw_again") + f" WHERE {RESENT}")


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * power(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"({d(2 * geo.EARTH_RADIUS_KM)} * asin(sqrt(least(1.0, greatest(0.0, {a})))))"


def fixed6(expr: str) -> str:
    return f"(CAST(floor(({expr}) * 1e6 + 0.5) AS DOUBLE) / 1e6)"


def pack(res: int, q: str, r: str) -> str:
    return (f"(CAST({res} AS BIGINT) * {1 << 56} + (CAST({q} AS BIGINT) + {geo.AXIS_OFFSET}) * {1 << 28}"
            f" + (CAST({r} AS BIGINT) + {geo.AXIS_OFFSET}))")


def cell_of(lat: str, lon: str, res: int) -> str:
    side = d(geo.SIDES[res])
    x = f"({d(geo.EARTH_RADIUS_KM * geo.C0)} * radians({lon}))"
    y = f"({d(geo.EARTH_RADIUS_KM / geo.C0)} * sin(radians({lat})))"
    fq = f"(({x} * {d(geo.SQRT3 / 3.0)} - {y} / 3.0) / {side})"
    fr = f"(({y} * {d(2.0 / 3.0)}) / {side})"
    q, r, s = f"floor({fq} + 0.5)", f"floor({fr} + 0.5)", f"floor(-{fq} - {fr} + 0.5)"
    dq, dr, ds = f"abs({q} - {fq})", f"abs({r} - {fr})", f"abs({s} + {fq} + {fr})"
    fix_q = f"({dq} > {dr} AND {dq} > {ds})"
    fix_r = f"(NOT {fix_q} AND {dr} > {ds})"
    return pack(res, f"CASE WHEN {fix_q} THEN -{r} - {s} ELSE {q} END", f"CASE WHEN {fix_r} THEN -{q} - {s} ELSE {r} END")


def cell_q(cell: str) -> str:
    return f"((({cell}) >> 28) & {geo.AXIS_MASK}) - {geo.AXIS_OFFSET}"


def cell_r(cell: str) -> str:
    return f"((({cell}) & {geo.AXIS_MASK}) - {geo.AXIS_OFFSET})"


def lat_of(cell: str, res: int) -> str:
    return f"degrees(asin(1.5 * {d(geo.SIDES[res])} * ({cell_r(cell)}) * {d(geo.C0)} / {d(geo.EARTH_RADIUS_KM)}))"


def lon_of(cell: str, res: int) -> str:
    return (f"degrees({d(geo.SIDES[res])} * {d(geo.SQRT3)} * (({cell_q(cell)}) + ({cell_r(cell)}) / 2.0)"
            f" / {d(geo.EARTH_RADIUS_KM * geo.C0)})")


def parent(cell: str, res: int, coarse: int) -> str:
    return cell_of(lat_of(cell, res), lon_of(cell, res), coarse)


def parent_exact(cell: str, res: int, coarse: int) -> str:
    """geo.parent_exact: borders of the coarser lattice are decided in integers, not by rounding."""
    times = 1 if (res - coarse) % 2 else 7 ** ((res - coarse) // 2)
    scale = f" * {d(geo.SIDES[res] / geo.SIDES[coarse])}" if (res - coarse) % 2 else ""
    fq, fr = f"(({cell_q(cell)}){scale})", f"(({cell_r(cell)}){scale})"
    near = lambda v: f"floor({v} + 0.5)" if scale else f"floor((2 * ({v}) + {times}) / {2 * times})"
    q, r, s = near(fq), near(fr), near(f"(-{fq} - {fr})")
    dq, dr, ds = f"abs({q} * {times} - {fq})", f"abs({r} * {times} - {fr})", f"abs({s} * {times} + {fq} + {fr})"
    fix_q = f"({dq} > {dr} AND {dq} > {ds})"
    fix_r = f"(NOT {fix_q} AND {dr} > {ds})"
    return pack(coarse, f"CASE WHEN {fix_q} THEN -{r} - {s} ELSE {q} END", f"CASE WHEN {fix_r} THEN -{q} - {s} ELSE {r} END")


def rings_sql(points: list[tuple[str, str]], table: str, ring_no: int, where: str = "TRUE") -> str:
    sides = [f"SELECT ord, name, {ring_no} AS ring, {i} AS edge, CAST({a[0]} AS DOUBLE) AS x1, CAST({a[1]} AS DOUBLE) AS y1,"
             f" CAST({b[0]} AS DOUBLE) AS x2, CAST({b[1]} AS DOUBLE) AS y2 FROM {table} WHERE {where}"
             for i, (a, b) in enumerate(zip(points, points[1:]))]
    return " UNION ALL ".join(sides)


fragment("state_edges", rings_sql(STATE_RING, "states_box", 0) + " UNION ALL "
         + rings_sql(HOLE_RING, "states_box", 1, "holed"), "states_box")
fragment("district_edges", rings_sql(DISTRICT_RING, "districts_box", 0), "districts_box")


def band(km: str) -> str:
    return (f"CASE WHEN {km} IS NULL THEN 'no remaining data' WHEN {km} < 20 THEN '0-20 km' WHEN {km} < 50 THEN '20-50 km'"
            f" WHEN {km} < 100 THEN '50-100 km' ELSE '100 km+' END")


def pm25_class(v: str) -> str:
    return (f"CASE WHEN {v} < 30 THEN 0 WHEN {v} < 60 THEN 1 WHEN {v} < 90 THEN 2 WHEN {v} < 120 THEN 3"
            f" WHEN {v} < 250 THEN 4 WHEN {v} IS NULL THEN NULL ELSE 5 END")


def pm25_label(v: str) -> str:
    return (f"CASE WHEN {v} <= 30 THEN 'Good' WHEN {v} <= 60 THEN 'Satisfactory' WHEN {v} <= 90 THEN 'Moderate'"
            f" WHEN {v} <= 120 THEN 'Poor' WHEN {v} <= 250 THEN 'Very poor' WHEN {v} IS NULL THEN NULL ELSE 'Severe' END")


def aqi_label(v: str) -> str:
    return (f"CASE WHEN {v} <= 50 THEN 'Good' WHEN {v} <= 100 THEN 'Satisfactory' WHEN {v} <= 200 THEN 'Moderate'"
            f" WHEN {v} <= 300 THEN 'Poor' WHEN {v} <= 400 THEN 'Very Poor' WHEN {v} IS NULL THEN NULL ELSE 'Severe' END")

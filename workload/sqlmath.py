"""SQL text for the geometry and sun formulas, written independently of the library's columns."""

from __future__ import annotations

import math

from workload.registry import PLACES, place


def quaternion_matrix(q: str) -> list[str]:
    """Nine SQL expressions of the rotation of list ``q`` (1-based w, x, y, z)."""
    w, x, y, z = (f"({q}[{i}])" for i in range(1, 5))
    n = f"({w}*{w}+{x}*{x}+{y}*{y}+{z}*{z})"
    cells = [
        f"{w}*{w}+{x}*{x}-{y}*{y}-{z}*{z}",
        f"2*({x}*{y}-{w}*{z})",
        f"2*({x}*{z}+{w}*{y})",
        f"2*({x}*{y}+{w}*{z})",
        f"{w}*{w}-{x}*{x}+{y}*{y}-{z}*{z}",
        f"2*({y}*{z}-{w}*{x})",
        f"2*({x}*{z}-{w}*{y})",
        f"2*({y}*{z}+{w}*{x})",
        f"{w}*{w}-{x}*{x}-{y}*{y}+{z}*{z}",
    ]
    return [f"(({c})/{n})" for c in cells]


def forward(q: str, t: str, p: list[str]) -> list[str]:
    """R p + t."""
    r = quaternion_matrix(q)
    return [f"({r[3*i]}*{p[0]}+{r[3*i+1]}*{p[1]}+{r[3*i+2]}*{p[2]}+{t}[{i+1}])" for i in range(3)]


def backward(q: str, t: str, p: list[str]) -> list[str]:
    """R' (p - t)."""
    r = quaternion_matrix(q)
    d = [f"({p[i]}-{t}[{i+1}])" for i in range(3)]
    return [f"({r[i]}*{d[0]}+{r[3+i]}*{d[1]}+{r[6+i]}*{d[2]})" for i in range(3)]


def sun_sql(source: str, key: str, at_us: str, where: str) -> str:
    """CTEs ending in ``sun``(key, now, rise, sets, dawn, dusk), NULL where the sun does not cross."""
    rad = repr(math.pi / 180)
    gps = " ".join(f"WHEN '{p}' THEN {lat!r}" for p, (lat, _) in PLACES.items())
    lng = " ".join(f"WHEN '{p}' THEN {lon!r}" for p, (_, lon) in PLACES.items())
    at = f"({place(where)})"

    def cross(degrees: float) -> str:
        return f"((sin({degrees!r}*{rad}) - sin(phi)*sin(dec)) / (cos(phi)*cos(dec)))"

    def angle(degrees: float) -> str:
        c = cross(degrees)
        return f"(CASE WHEN abs({c}) <= 1 THEN acos({c}) END)"

    def evening(degrees: float) -> str:
        return f"(0.0009 + ({angle(degrees)} + lw)/(2*pi()) + n + eq)"

    return f"""
    place AS (SELECT {key}, {at_us} AS us, CASE {at} {gps} END * {rad} AS phi,
                     -(CASE {at} {lng} END) * {rad} AS lw FROM {source}),
    days AS (SELECT *, us::DOUBLE / 86400000000.0 - 0.5 + 2440588.0 - 2451545.0 AS now FROM place),
    cyc AS (SELECT *, round(now - 0.0009 - lw/(2*pi())) AS n FROM days),
    guess AS (SELECT *, 0.0009 + lw/(2*pi()) + n AS ds FROM cyc),
    anom AS (SELECT *, {rad} * (357.5291 + 0.98560028*ds) AS m FROM guess),
    ecl AS (SELECT *, m + {rad}*(1.9148*sin(m) + 0.02*sin(2*m) + 0.0003*sin(3*m)) + {rad}*102.9372 + pi() AS l FROM anom),
    decl AS (SELECT *, asin(sin({rad}*23.4397)*sin(l)) AS dec, 0.0053*sin(m) - 0.0069*sin(2*l) AS eq FROM ecl),
    sets AS (SELECT *, ds + eq AS noon, {evening(-0.833)} AS sets, {evening(-12.0)} AS dusk FROM decl),
    sun AS (SELECT *, 2*noon - sets AS rise, 2*noon - dusk AS dawn FROM sets)
    """

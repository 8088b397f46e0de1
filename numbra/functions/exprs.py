"""Composite expressions as SQL text that reads the same in Spark and in other engines.

Constants are written CAST(x AS DOUBLE), since a bare decimal is a DECIMAL. Squares are products, which is
exact and cheaper than power(). Column operands are names or bracketed SQL text.
"""

from __future__ import annotations

import math

# Fixed values of the formulas.
RADIANS = 0.017453292519943295
EARTH_DIAMETER_KM = 12742.0
SECONDS_PER_DAY = 86400.0
RATE = 0.025
TAIL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
DENSITY = 0.3989422804014327
GOLDEN, ROTATION = 0.6180339887498949, 0.7548776662466927


def num(x: float) -> str:
    """A DOUBLE literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def square(x: str) -> str:
    return f"({x}) * ({x})"


def least(terms: list[str]) -> str:
    """LEAST of several terms, or the only one."""
    return terms[0] if len(terms) == 1 else f"LEAST({', '.join(terms)})"


def haversine(lat: str, lon: str, lat0: float, lon0: float) -> str:
    """Great-circle kilometres to a fixed place in degrees."""
    half = num(RADIANS / 2)
    dlat, dlon = f"SIN(({lat} - {num(lat0)}) * {half})", f"SIN(({lon} - {num(lon0)}) * {half})"
    cosines = f"COS({lat} * {num(RADIANS)}) * {num(math.cos(lat0 * RADIANS))}"
    return f"({num(EARTH_DIAMETER_KM)} * ASIN(SQRT({square(dlat)} + {cosines} * {square(dlon)})))"


def depots(n: int) -> list[tuple[float, float]]:
    """n places spread evenly over the globe."""
    return [(-60.0 + i * (120.0 / n), -180.0 + i * (360.0 / n)) for i in range(n)]


def nearest_depot(lat: str, lon: str, n: int) -> str:
    return least([haversine(lat, lon, *d) for d in depots(n)])


# The coefficients of the two deviations below are fixed values as well.


def sensor_deviation(mode: int) -> str:
    """Standardised distance of temp, vibration, pressure, amps from a mode whose baselines follow the phase."""
    w = f"(phase * {num(2 * math.pi / SECONDS_PER_DAY)})"
    temp = f"({num(18 + 2.0 * mode)} + {num(6 + 0.5 * mode)} * SIN({w}))"
    vib = f"({num(0.4 + 0.05 * mode)} + {num(0.15 + 0.02 * mode)} * COS({w}))"
    parts = [
        square(f"(temp - {temp}) / {num(2.5)}"),
        square(f"(vibration - {vib}) / {num(0.15)}"),
        square(f"(pressure - {num(100 + 0.8 * mode)}) / {num(1.8)}"),
        square(f"(amps - {num(3.6 + 0.3 * mode)}) / {num(0.35)}"),
    ]
    stress = f"{num(0.5)} * LN({num(1)} + vibration * vibration) + {num(0.01)} * ABS(temp - pressure * {num(0.2)})"
    return f"(SQRT({' + '.join(parts)}) + {stress})"


def sensor_score(modes: int) -> str:
    return least([sensor_deviation(m) for m in range(modes)])


def triage_deviation(mode: int) -> str:
    """The same idea in exactly rounded arithmetic: a quadratic duty cycle and a sum of five squares."""
    u = f"(phase * {num(1 / SECONDS_PER_DAY)})"
    cycle = f"({u} * ({num(1)} - {u}) * {num(4)})"
    temp = f"({num(18 + 2.0 * mode)} + {num(6 + 0.5 * mode)} * {cycle})"
    vib = f"({num(0.4 + 0.05 * mode)} + {num(0.15 + 0.02 * mode)} * {cycle})"
    parts = [
        square(f"(temp - {temp}) / {num(2.5)}"),
        square(f"(vibration - {vib}) / {num(0.15)}"),
        square(f"(pressure - {num(100 + 0.8 * mode)}) / {num(1.8)}"),
        square(f"(amps - {num(3.6 + 0.3 * mode)}) / {num(0.35)}"),
        square(f"(temp - pressure * {num(0.2)}) / {num(4)}"),
    ]
    return f"({' + '.join(parts)})"


def triage_score(modes: int) -> str:
    return least([triage_deviation(m) for m in range(modes)])


def probe(query: int, coordinate: int) -> float:
    """A point of the unit cube from a golden-ratio sequence and an irrational rotation."""
    x = (query + 1) * GOLDEN + (coordinate + 1) * ROTATION
    return x - math.floor(x)


def squared_distance(columns: list[str], point: list[float]) -> str:
    return "(" + " + ".join(square(f"{c} - {num(p)}") for c, p in zip(columns, point, strict=True)) + ")"


def vector_screen(columns: list[str], queries: int) -> str:
    """Squared distance to the nearest of some probes."""
    return least([squared_distance(columns, [probe(q, i) for i in range(len(columns))]) for q in range(queries)])


def normal_cdf(x: str) -> str:
    """Standard normal distribution by a five-term tail, folded with SIGN (exactly one half at zero)."""
    p, *b = TAIL
    u = f"ABS({x})"
    t = f"({num(1)} / ({num(1)} + {num(p)} * {u}))"
    poly = num(b[-1])
    for coefficient in reversed(b[:-1]):
        poly = f"({num(coefficient)} + {t} * {poly})"
    tail = f"({num(DENSITY)} * EXP({num(-0.5)} * {u} * {u}) * {t} * {poly})"
    sign = f"CAST(SIGN({x}) AS DOUBLE)"
    return f"({num(0.5)} * ({num(1)} + {sign}) * ({num(1)} - {tail}) + {num(0.5)} * ({num(1)} - {sign}) * {tail})"


def call_price(shock: float) -> str:
    """Price of a European call (spot, strike, tau, vol) with its volatility times a shock."""
    vol, root = f"(vol * {num(shock)})", "SQRT(tau)"
    d1 = f"((LN(spot / strike) + ({num(RATE)} + {num(0.5)} * {vol} * {vol}) * tau) / ({vol} * {root}))"
    d2 = f"({d1} - {vol} * {root})"
    return f"(spot * {normal_cdf(d1)} - strike * EXP({num(-RATE)} * tau) * {normal_cdf(d2)})"


def shocks(n: int) -> list[float]:
    """1, then n - 1 shocks from a half to double."""
    if n <= 2:
        return [1.0, 0.5][:n]
    return [1.0, *(0.5 + 1.5 * i / (n - 2) for i in range(n - 1))]


def signal_score() -> str:
    energy = "(a * a + b * b + c * c)"
    wave = f"({num(1)} + SIN({num(0.5)} * a) * COS({num(0.25)} * b))"
    return f"(SQRT{energy} * {wave} + EXP({num(-0.001)} * (a * a + b * b)) * LN({num(1)} + c * c))"


def heavy(x: str, y: str | None = None, z: str | None = None, w: str | None = None) -> str:
    """EXP, LN, SIN, COS and POWER over operands of any numeric width."""
    y, z, w = y or x, z or x, w or x
    return f"(EXP({x} / {num(100)}) * LN(ABS({y}) + {num(1)}) + SIN({z}) * COS({w}) + POWER({y} / {num(4)}, {num(3)}))"


def region_term(x: str) -> str:
    """The transcendental work of one column."""
    return f"(EXP({x} * {num(0.001)}) * LN(ABS({x}) + {num(1)}) + SIN({x}) * COS({x}) + SQRT(ABS({x})))"


def sigmoid(x: str) -> str:
    return f"({num(1)} / ({num(1)} + EXP(-({x}))))"


def dot(a: list[str], b: list[str]) -> str:
    """Left-to-right sum of products."""
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"

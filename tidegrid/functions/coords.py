"""Coordinates: degrees, minutes and seconds; UTM zones by the Krueger series; grid indices."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the UTM projection.
AXIS, FLATTENING, SCALE, EASTING_0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
# Krueger's series to the fourth order (Karney 2011, equations 35 and 36).
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
# Latitude from conformal latitude.
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)
ECC = 2 * sqrt(N) / (1 + N)
ZONES = {"UTM 31N (32631)": 31, "UTM 32N (32632)": 32}
GEOGRAPHIC = "WGS84 (4326)"
#: The analysis area: lower left corner, pixel, columns of cells.
CORNER, PIXEL, CELLS_ACROSS, CELL_PIXELS = (555652.0, 5910512.0), 100.0, 16, 50


def meridian(zone: int) -> float:
    return zone * 6 - 183


def utm_forward(lat: Column, lon: Column, zone: int = 31) -> tuple[Column, Column]:
    """Easting and northing of degrees."""
    phi, lam = F.radians(lat), F.radians(lon - F.lit(float(meridian(zone))))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(ECC) * F.atanh(F.lit(ECC) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        y = y + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    k = SCALE * RECTIFYING
    return F.lit(EASTING_0) + x * k, y * k


def utm_inverse(easting: Column, northing: Column, zone: int = 31) -> tuple[Column, Column]:
    """Latitude and longitude of UTM metres, northern half."""
    k = SCALE * RECTIFYING
    xi, eta = northing / k, (easting - EASTING_0) / k
    x, y = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        y = y - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + F.lit(d) * F.sin(chi * (2 * j))
    return F.degrees(phi), F.lit(float(meridian(zone))) + F.degrees(F.atan2(F.sinh(y), F.cos(x)))


def to_degrees(datum: Column, northing: Column, easting: Column) -> tuple[Column, Column]:
    """Latitude and longitude by the datum's name; degrees pass through; unknown datums raise an error."""
    known = F.when(datum == GEOGRAPHIC, F.lit(0))
    for name, zone in ZONES.items():
        known = known.when(datum == name, F.lit(zone))
    wrong = F.raise_error(F.concat(F.lit("unknown datum: "), F.coalesce(datum, F.lit("none")))).cast("double")
    out = []
    for i, plain in enumerate((northing, easting)):
        c = F.when(known == 0, plain)
        for zone in ZONES.values():
            c = c.when(known == zone, utm_inverse(easting, northing, zone)[i])
        out.append(c.otherwise(wrong))
    return out[0], out[1]


def dms(value: Column) -> Column:
    """Degrees of a text like 52-30-15.5N; negative for S and W; NULL for other texts."""
    m = r"^(\d+)-(\d+)-(\d+(?:\.\d+)?)([NSEW])$"
    part = lambda i: F.nullif(F.regexp_extract(value, m, i), F.lit("")).cast("double")
    size = part(1) + part(2) / 60 + part(3) / 3600
    return F.when(F.regexp_extract(value, m, 4).isin("S", "W"), -size).otherwise(size)


def grid_index(x: Column, y: Column, rows: int = 350, cols: int = 800) -> tuple[Column, Column]:
    """Row (0 south) and column on the cost map; NULL outside its closed bounds."""
    inside = x.between(CORNER[0], CORNER[0] + cols * PIXEL) & y.between(CORNER[1], CORNER[1] + rows * PIXEL)
    at = lambda v, c, n: F.when(inside, F.least(F.floor((v - c) / PIXEL), F.lit(n - 1)).cast("int"))
    return at(y, CORNER[1], rows), at(x, CORNER[0], cols)


def index_centre(row: Column, col: Column) -> tuple[Column, Column]:
    """Easting and northing of the centre of a cost-map pixel."""
    return F.lit(CORNER[0]) + (col + 0.5) * PIXEL, F.lit(CORNER[1]) + (row + 0.5) * PIXEL


def cell_window(cell: Column) -> tuple[Column, Column]:
    """First row and column of an analysis cell on the cost map."""
    return F.floor(cell / CELLS_ACROSS).cast("int") * CELL_PIXELS, (cell % CELLS_ACROSS) * CELL_PIXELS


def cell_corner(cell: Column, x0: float, y0: float, size: float = 5000.0) -> tuple[Column, Column]:
    return F.lit(x0) + (cell % CELLS_ACROSS) * size, F.lit(y0) + F.floor(cell / CELLS_ACROSS) * size


def pixel_centre(row: Column, col: Column, x0: Column, y0: Column, pixels: int, size: float) -> tuple[Column, Column]:
    """Centre of a tile's pixel, row 0 north, over the full grid."""
    return x0 + (col + 0.5) * size, y0 + pixels * size - (row + 0.5) * size


def heading_gap(a: Column, b: Column) -> Column:
    """Steps of 45 degrees between two headings."""
    d = F.abs(a - b) % 8
    return F.least(d, F.lit(8) - d)


def compass(angle: Column) -> Column:
    return F.pmod(F.lit(180) - angle - 45, F.lit(360))


def variance_score(v: Column) -> Column:
    return F.log10(F.sqrt(F.greatest(v, F.lit(0.0))) + 1)


def root_abs(v: Column) -> Column:
    return F.sqrt(F.abs(v))


def ring_area(ring: str) -> str:
    """SQL of the area of an array of (x, y) structs, by the shoelace rule; open or closed."""
    return f"abs(aggregate(transform({ring}, (p, i) -> p.x * {ring}[(i + 1) % size({ring})].y - {ring}[(i + 1) % size({ring})].x * p.y), 0D, (s, v) -> s + v)) / 2"


def bend_radius(momentum: Column, cell: float = 100.0) -> Column:
    """Radius of the circle with the area of the octagon that a route with this momentum turns in."""
    return F.sqrt(F.lit(7 / pi)) * momentum * cell

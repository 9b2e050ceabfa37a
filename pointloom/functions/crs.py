"""Dutch national grid and WGS84, by two-variable polynomials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Origin of the grid in metres and in degrees.
X0, Y0, PHI0, LAM0 = 155000, 463000, 52.15517440, 5.38720621
# Exponents of the first and second variable, and coefficients.
LATITUDE = [
    (0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.24750), (2, 1, -0.84978), (0, 3, -0.06550), (2, 2, -0.01709),
    (1, 0, -0.00738), (4, 0, 0.00530), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012),
]
LONGITUDE = [
    (1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594), (3, 1, -0.05607),
    (0, 1, 0.01199), (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026),
]
EAST = [
    (0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340),
    (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148),
]
NORTH = [
    (1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439),
    (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054),
]


def _polynomial(terms, a: Column, b: Column) -> Column:
    power = lambda v, n: F.lit(1.0) if n == 0 else v if n == 1 else F.pow(v, F.lit(float(n)))
    total = F.lit(0.0)
    for p, q, k in terms:
        total = total + F.lit(k) * power(a, p) * power(b, q)
    return total


def to_wgs84(x: Column, y: Column) -> Column:
    """``struct(latitude, longitude)`` of grid metres."""
    dx, dy = 1e-5 * (x.cast("double") - X0), 1e-5 * (y.cast("double") - Y0)
    return F.struct((PHI0 + _polynomial(LATITUDE, dx, dy) / 3600).alias("latitude"), (LAM0 + _polynomial(LONGITUDE, dx, dy) / 3600).alias("longitude"))


def from_wgs84(latitude: Column, longitude: Column) -> Column:
    """``struct(x, y)`` in grid metres."""
    dlat, dlon = 0.36 * (latitude - PHI0), 0.36 * (longitude - LAM0)
    return F.struct((X0 + _polynomial(EAST, dlat, dlon)).alias("x"), (Y0 + _polynomial(NORTH, dlat, dlon)).alias("y"))

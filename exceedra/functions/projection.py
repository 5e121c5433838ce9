"""Map projections as columns: conformal conic with two parallels and transverse Mercator, both ways.

The conic inverse and both directions of the transverse Mercator are series in the
eccentricity or the third flattening, to the fourth order: no iteration, no Python worker.
Angles are degrees, lengths metres.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semi-major axis and inverse flattening of the ellipsoids.
GRS80 = (6378137.0, 298.257222101)
WGS84 = (6378137.0, 298.257223563)


@dataclass(frozen=True)
class Conic:
    """Lambert's conformal conic projection with two standard parallels."""

    first: float
    second: float
    lat0: float
    lon0: float
    east0: float
    north0: float
    ellipsoid: tuple[float, float] = GRS80

    @property
    def e(self) -> float:
        f = 1 / self.ellipsoid[1]
        return math.sqrt(f * (2 - f))

    def _t(self, lat: float) -> float:
        s = self.e * math.sin(math.radians(lat))
        return math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    @property
    def cone(self) -> tuple[float, float, float]:
        """Cone constant, its radius factor and the radius of the origin."""
        m = [math.cos(math.radians(x)) / math.sqrt(1 - (self.e * math.sin(math.radians(x))) ** 2) for x in (self.first, self.second)]
        t = [self._t(x) for x in (self.first, self.second)]
        n = math.log(m[0] / m[1]) / math.log(t[0] / t[1])
        scale = self.ellipsoid[0] * m[0] / (n * t[0] ** n)
        return n, scale, scale * self._t(self.lat0) ** n

    @property
    def latitude_terms(self) -> list[float]:
        """Coefficients of sin 2x, 4x, 6x, 8x from the conformal to the geographic latitude."""
        q = self.e**2
        return [q / 2 + 5 * q**2 / 24 + q**3 / 12 + 13 * q**4 / 360, 7 * q**2 / 48 + 29 * q**3 / 240 + 811 * q**4 / 11520, 7 * q**3 / 120 + 81 * q**4 / 1120, 4279 * q**4 / 161280]

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Easting and northing."""
        n, scale, origin = self.cone
        s = self.e * F.sin(F.radians(lat))
        t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - s) / (1 + s), F.lit(self.e / 2))
        radius, turn = scale * F.pow(t, F.lit(n)), n * F.radians(lon - self.lon0)
        return self.east0 + radius * F.sin(turn), self.north0 + origin - radius * F.cos(turn)

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        """Latitude and longitude."""
        n, scale, origin = self.cone
        x, y = east - self.east0, origin - (north - self.north0)
        t = F.pow(F.sqrt(x * x + y * y) / scale, F.lit(1 / n))
        chi = math.pi / 2 - 2 * F.atan(t)
        lat = chi
        for j, c in enumerate(self.latitude_terms, 1):
            lat = lat + c * F.sin(2 * j * chi)
        return F.degrees(lat), self.lon0 + F.degrees(F.atan2(x, y)) / n


@dataclass(frozen=True)
class TransverseMercator:
    """Transverse Mercator projection by Krueger's series in the third flattening."""

    lon0: float
    east0: float = 500000.0
    north0: float = 0.0
    scale0: float = 0.9996
    ellipsoid: tuple[float, float] = WGS84

    @property
    def third(self) -> float:
        f = 1 / self.ellipsoid[1]
        return f / (2 - f)

    @property
    def radius(self) -> float:
        n = self.third
        return self.scale0 * self.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def series(self) -> tuple[list[float], list[float], list[float]]:
        """Coefficients of the forward series, of its inverse, and of the latitude."""
        n = self.third
        forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
        return forward, back, latitude

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Easting and northing."""
        k = 2 * math.sqrt(self.third) / (1 + self.third)
        s, turn = F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
        xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(self.series[0], 1):
            x, y = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return self.east0 + self.radius * x, self.north0 + self.radius * y

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        """Latitude and longitude."""
        xi, eta = (north - self.north0) / self.radius, (east - self.east0) / self.radius
        a, b = xi, eta
        for j, c in enumerate(self.series[1], 1):
            a, b = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta), b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(a) / F.cosh(b))
        lat = chi
        for j, c in enumerate(self.series[2], 1):
            lat = lat + c * F.sin(2 * j * chi)
        return F.degrees(lat), self.lon0 + F.degrees(F.atan2(F.sinh(b), F.cos(a)))


# Parameters of the Austrian conic projection and of zone 33.
AUSTRIA = Conic(46.0, 49.0, 47.5, 40 / 3, 400000.0, 400000.0)
ZONE33 = TransverseMercator(15.0)

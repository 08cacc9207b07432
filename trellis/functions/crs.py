"""WGS84 to UTM zone 37 N and back by the Krueger series, as numpy functions and as Column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _FLAT, _K0, _LON0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 39.0, 500000.0
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4, 1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)


def to_utm(lon, lat) -> np.ndarray:
    """Metres (x, y) of degrees, as an array of pairs."""
    lat, lon = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float) - _LON0)
    t = np.sinh(np.arctanh(np.sin(lat)) - _ECC * np.arctanh(_ECC * np.sin(lat)))
    xi, eta = np.arctan2(t, np.cos(lon)), np.arcsinh(np.sin(lon) / np.hypot(t, np.cos(lon)))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return np.stack([_E0 + _K0 * _RADIUS * x, _K0 * _RADIUS * y], -1)


def to_wgs(x, y) -> np.ndarray:
    """Degrees (lon, lat) of metres, as an array of pairs."""
    xi, eta = np.asarray(y, float) / (_K0 * _RADIUS), (np.asarray(x, float) - _E0) / (_K0 * _RADIUS)
    a, b = xi.copy(), eta.copy()
    for j, c in enumerate(_BETA, 1):
        a = a - c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        b = b - c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    tau0 = np.sin(a) / np.hypot(np.sinh(b), np.cos(a))
    tau = tau0.copy()
    for _ in range(6):
        root = np.sqrt(1 + tau**2)
        s = np.sinh(_ECC * np.arctanh(_ECC * tau / root))
        t = tau * np.sqrt(1 + s**2) - s * root
        tau = tau + (tau0 - t) / np.sqrt(1 + t**2) * (1 + (1 - _ECC**2) * tau**2) / ((1 - _ECC**2) * root)
    return np.stack([np.degrees(np.arctan2(np.sinh(b), np.cos(a))) + _LON0, np.degrees(np.arctan(tau))], -1)


def utm_columns(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y in metres as expressions."""
    phi, lam = F.radians(lat), F.radians(lon - _LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.hypot(t, F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _RADIUS * x, _K0 * _RADIUS * y

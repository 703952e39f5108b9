"""The two-harmonic daily cycle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

OMEGA = 2 * math.pi / 24


def basis(hour: Column) -> tuple[Column, ...]:
    """The four regressors; their signs make amplitude and phase those of A sin(wh - phi)."""
    w = hour * F.lit(OMEGA)
    return F.sin(w), -F.cos(w), F.sin(2 * w), -F.cos(2 * w)


def shape(hour: Column, a1: Column, phi1: Column, a2: Column, phi2: Column) -> Column:
    w = hour * F.lit(OMEGA)
    return a1 * F.sin(w - phi1) + a2 * F.sin(2 * w - phi2)


def amplitude_phase(c: Column, s: Column) -> tuple[Column, Column]:
    return F.hypot(c, s), F.atan2(s, c)

"""Radiance, enhancement and emission arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def scaled(c: Column, low: float = 0.0, high: float = 15.0) -> Column:
    """To 0 .. 1, clipped: radiance for display, or an enhancement between two thresholds."""
    return clip((c - low) / (high - low), 0, 1)


def standardised(c: Column, mean: Column | float, std: Column | float, low: float = 0.0, high: float = 4000.0) -> Column:
    """Clamped, then in units of a campaign's standard deviation."""
    return (clip(c, low, high) - mean) / std


def ime_kg(total_ppmm: Column, pixel_size_m: Column | float) -> Column:
    """Integrated mass enhancement of a sum of ppm m over square pixels."""
    return total_ppmm * pixel_size_m * pixel_size_m * F.lit(1e-6 * 1000 / 22.4 * 0.01604)


def aspect_flag(ratio: Column) -> Column:
    """1 where the aspect ratio is above 1 or below 0.02; null stays null."""
    return F.when(ratio.isNotNull(), ((ratio > 1) | (ratio < 0.02)).cast("int"))


def emission_kg_h(ime_per_fetch: Column, wind: Column) -> Column:
    return ime_per_fetch * wind * 3600


def emission_uncertainty(ime: Column, ime_std: Column, wind: Column, wind_std: Column) -> Column:
    """Relative errors added in quadrature; a term whose denominator is below 1e-7 is 0."""

    def term(std: Column, value: Column) -> Column:
        return F.when(value < 1e-7, F.lit(0.0)).otherwise(F.pow(std / F.when(value >= 1e-7, value), 2))

    return F.sqrt(term(ime_std, ime) + term(wind_std, wind)) * emission_kg_h(ime, wind)


def class_of_label(label: Column) -> Column:
    """1 for every label that ends in plume, else 0."""
    return F.lower(label).endswith("plume").cast("int")


def class_of_rgb(r: Column, g: Column, b: Column) -> Column:
    """Label colours: red 1, blue 2, cyan 3, white 4, others 0."""
    hi = [c > 127 for c in (r, g, b)]
    return F.when(hi[0] & hi[1] & hi[2], 4).when(hi[0] & ~hi[1] & ~hi[2], 1).when(~hi[0] & ~hi[1] & hi[2], 2).when(~hi[0] & hi[1] & hi[2], 3).otherwise(0)


def rgb_of_class(c: Column) -> Column:
    colours = {1: (255, 0, 0), 2: (0, 0, 255), 3: (0, 255, 255), 4: (255, 255, 255)}
    out = F.when(c == 0, F.array(*map(F.lit, (0, 0, 0))))
    for k, rgb in colours.items():
        out = out.when(c == k, F.array(*map(F.lit, rgb)))
    return out


def viewer_class(r: Column, g: Column, b: Column) -> Column:
    """From the viewer's shading r/255 - (g + b)/510: above 0 is 1, below 0 is 0 (false), 0 is background (null)."""
    v = r / 255 - (g + b) / 510
    return F.when(v > 0, 1).when(v < 0, 0)

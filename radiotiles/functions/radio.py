"""Path-loss expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_distance(d: Column, d0: float = 1.0) -> Column:
    """x = 10 log10(max(d, d0) / d0)."""
    return 10.0 * F.log10(F.greatest(d, F.lit(d0)) / d0)


def predict_db(d: Column, gamma: Column, pl0: Column, d0: float = 1.0) -> Column:
    return pl0 + gamma * log_distance(d, d0)


def power_sum_db(paths: Column) -> Column:
    """Path loss of an array of path powers in dB; null without a path.  NaN paths do not count."""
    total = F.aggregate(F.filter(paths, lambda p: p.isNotNull() & ~F.isnan(p)), F.lit(0.0), lambda s, p: s + F.pow(F.lit(10.0), p / 10.0))
    return -10.0 * F.log10(F.nullif(total, F.lit(0.0)))


def line_of_sight(interactions: Column) -> Column:
    """True if the first path has no interaction; false without a path."""
    return F.coalesce(F.try_element_at(interactions, F.lit(1)) == 0, F.lit(False))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def small_city_correction(f_mhz: Column, h_m: float) -> Column:
    return (1.1 * F.log10(f_mhz) - 0.7) * h_m - (1.56 * F.log10(f_mhz) - 0.8)


def _range_term(d_m: Column, h_b: float) -> Column:
    return (44.9 - 6.55 * F.log10(F.lit(h_b))) * F.log10(F.greatest(d_m / 1000.0, F.lit(1e-3)))


def hata_db(d_m: Column, f_mhz: Column, h_b: float = 30.0, h_m: float = 1.5, large_city: bool = True) -> Column:
    """Okumura and Hata's model; the large-city correction holds from 300 MHz."""
    small = small_city_correction(f_mhz, h_m)
    large = 3.2 * F.pow(F.log10(F.lit(11.75 * h_m)), F.lit(2)) - 4.97
    a = F.when(f_mhz >= 300, large).otherwise(small) if large_city else small
    return 69.55 + 26.16 * F.log10(f_mhz) - 13.82 * F.log10(F.lit(h_b)) - a + _range_term(d_m, h_b)


def cost231_db(d_m: Column, f_mhz: Column, h_b: float = 30.0, h_m: float = 1.5, metropolitan: bool = True) -> Column:
    return 46.3 + 33.9 * F.log10(f_mhz) - 13.82 * F.log10(F.lit(h_b)) - small_city_correction(f_mhz, h_m) + _range_term(d_m, h_b) + (3.0 if metropolitan else 0.0)


def uma_nlos_db(d3d_m: Column, f_ghz: Column, h_ut: float = 1.5) -> Column:
    return 13.54 + 39.08 * F.log10(F.greatest(d3d_m, F.lit(1.0))) + 20.0 * F.log10(f_ghz) - 0.6 * (h_ut - 1.5)


def squash(raw: Column, lo: float, hi: float) -> Column:
    return lo + (hi - lo) / (1.0 + F.exp(-raw))


def clamp_log_variance(raw: Column) -> Column:
    return F.least(F.greatest(raw, F.lit(-8.0)), F.lit(4.0))


def hash_rank_key(seed: int, *keys: Column) -> Column:
    """A portable random order: the hex digits of an MD5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))

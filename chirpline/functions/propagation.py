"""Attenuation of sound over distance: spreading, the atmosphere and the habitat."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.functions.decibel import dbspl_to_pressure, pressure_to_dbspl


def spreading_factor(r: Column, r0: Column) -> Column:
    return r0 / r


def spreading_db(r: Column, r0: Column) -> Column:
    return -20 * F.log10(r0 / r)


def atmosphere_db_per_m(f: Column, t: float = 20.0, rh: float = 60.0, pa: float = 101325.0) -> Column:
    """Absorption by air in dB per metre (relaxation of oxygen and nitrogen, after ISO 9613-1)."""
    # Reference pressure (Pa), triple point and reference temperature (K).
    pr, triple, t20 = 101325.0, 273.16, 293.15
    kelvin, bar = t + 273.15, pa / pr
    vapour = rh * pr * 10 ** (-6.8346 * (triple / kelvin) ** 1.261 + 4.6151) / pa
    f_oxygen = bar * (24 + 4.04e4 * vapour * (0.02 + vapour) / (0.391 + vapour))
    f_nitrogen = bar * math.sqrt(kelvin / t20) * (9 + 280 * vapour * math.exp(-4.17 * ((kelvin / t20) ** (-1 / 3) - 1)))
    classic = 1.84e-11 / bar * math.sqrt(kelvin / t20)
    shrink = (kelvin / t20) ** -2.5
    f2 = f * f
    oxygen = F.lit(shrink * 0.01275 * math.exp(-2239.1 / kelvin)) / (F.lit(f_oxygen) + f2 / F.lit(f_oxygen))
    nitrogen = F.lit(shrink * 0.1068 * math.exp(-3352 / kelvin)) / (F.lit(f_nitrogen) + f2 / F.lit(f_nitrogen))
    return F.lit(8.686) * f2 * (F.lit(classic) + oxygen + nitrogen)


def atmosphere_factor(f: Column, r: Column, r0: Column, t: float = 20.0, rh: float = 60.0, pa: float = 101325.0) -> Column:
    return F.exp(-atmosphere_db_per_m(f, t, rh, pa) / F.lit(20 * math.log10(math.e)) * (r - r0))


def atmosphere_db(f: Column, r: Column, r0: Column, t: float = 20.0, rh: float = 60.0, pa: float = 101325.0) -> Column:
    return atmosphere_db_per_m(f, t, rh, pa) * (r - r0)


def habitat_db(f: Column, r: Column, r0: Column, a0: float = 0.02) -> Column:
    return F.lit(a0) * f / 1000 * (r - r0)


def habitat_factor(f: Column, r: Column, r0: Column, a0: float = 0.02) -> Column:
    """The coefficient is multiplied by log10 e here, where the atmosphere's is divided by it."""
    return F.exp(-(F.lit(a0) * f / 1000) / 20 * F.lit(math.log10(math.e)) * (r - r0))


def total_factor(f: Column, r: Column, r0: Column, t: float = 20.0, rh: float = 60.0, pa: float = 101325.0, a0: float = 0.02) -> Column:
    return spreading_factor(r, r0) * atmosphere_factor(f, r, r0, t, rh, pa) * habitat_factor(f, r, r0, a0)


def total_db(f: Column, r: Column, r0: Column, t: float = 20.0, rh: float = 60.0, pa: float = 101325.0, a0: float = 0.02) -> Column:
    return spreading_db(r, r0) + atmosphere_db(f, r, r0, t, rh, pa) + habitat_db(f, r, r0, a0)


def pressure_at_r0(f: Column, r: Column, p: Column, r0: Column, **air: float) -> Column:
    return p / total_factor(f, r, r0, **air)


def dbspl_at_r0(f: Column, r: Column, level: Column, r0: Column, p_ref: float = 10e-6, **air: float) -> Column:
    """The default reference differs from the usual 20 uPa in the last step, which adds 6.02 dB."""
    return pressure_to_dbspl(pressure_at_r0(f, r, dbspl_to_pressure(level), r0, **air), p_ref)


def grid(spark: SparkSession, freqs: list[float], distances: list[float]) -> DataFrame:
    """All pairs (f, r) of two parameter lists, made by exploding literals."""
    f = F.explode(F.array(*[F.lit(float(x)) for x in freqs])).alias("f")
    return spark.range(1).select(f).select("f", F.explode(F.array(*[F.lit(float(x)) for x in distances])).alias("r"))


def detection_distance(levels: DataFrame, r0: float = 1.0, step: float = 1.0, r_max: float = 10000.0, **air: float) -> DataFrame:
    """Largest distance at which a source is still above the background: (f, distance).

    ``levels`` has f, level0 (at r0) and background. Of the distances 1, 1 + step, ... below r_max
    the one with the smallest positive margin counts; fewer than two positive margins give 0.
    """
    r = F.explode(F.sequence(F.lit(1.0).cast("decimal(18,6)"), F.lit(r_max - step).cast("decimal(18,6)"), F.lit(step).cast("decimal(18,6)"))) if step != int(step) else F.explode(F.sequence(F.lit(1), F.lit(int(r_max - step)), F.lit(int(step))))
    tried = levels.select("f", "level0", "background", r.alias("r")).withColumn("r", F.col("r").cast("double"))
    margin = F.col("level0") - total_db(F.col("f"), F.col("r"), F.lit(r0), **air) - F.col("background")
    hits = tried.withColumn("margin", margin)
    above = F.when(F.col("margin") > 0, F.col("margin"))
    best = F.min(F.when(F.col("margin") > 0, F.struct("margin", "r")))
    return hits.groupBy("f").agg(F.count(above).alias("n"), best.alias("best")).select("f", F.when(F.col("n") > 1, F.col("best.r")).otherwise(F.lit(0.0)).alias("distance"))


def attenuate(signals: DataFrame, fs: float, r: float, r0: float = 1.0, t: float = 20.0, rh: float = 60.0, pa: float = 101325.0, a0: float = 0.02) -> DataFrame:
    """Waveforms as heard at distance r: each Fourier coefficient k of n is damped as the frequency k / n * fs / 2: (rec_id, x)."""
    import numpy as np

    from chirpline.operators.images import map_arrays

    kelvin, bar = t + 273.15, pa / 101325.0
    vapour = rh * 101325.0 * 10 ** (-6.8346 * (273.16 / kelvin) ** 1.261 + 4.6151) / pa
    fo = bar * (24 + 4.04e4 * vapour * (0.02 + vapour) / (0.391 + vapour))
    fr = bar * math.sqrt(kelvin / 293.15) * (9 + 280 * vapour * math.exp(-4.17 * ((kelvin / 293.15) ** (-1 / 3) - 1)))

    def damp(x: np.ndarray) -> np.ndarray:
        f2 = (np.arange(len(x)) / len(x) * fs / 2) ** 2
        shrink = (kelvin / 293.15) ** -2.5
        air = 8.686 * f2 * (1.84e-11 / bar * math.sqrt(kelvin / 293.15) + shrink * (0.01275 * math.exp(-2239.1 / kelvin) / (fo + f2 / fo) + 0.1068 * math.exp(-3352 / kelvin) / (fr + f2 / fr)))
        habitat = a0 * np.sqrt(f2) / 1000 / 20 * math.log10(math.e)
        factor = r0 / r * np.exp(-air / (20 * math.log10(math.e)) * (r - r0)) * np.exp(-habitat * (r - r0))
        return np.fft.ifft(np.fft.fft(x) * factor).real

    return map_arrays(signals, damp)

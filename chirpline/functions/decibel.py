"""Decibel, calibration and sound-pressure algebra as Column expressions.

Zeros are floored at the smallest normal double before any logarithm, so no value becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN = 2.2250738585072014e-308


def floored(x: Column) -> Column:
    return F.greatest(F.abs(x), F.lit(MIN))


def _clip(db: Column, db_range: float | None) -> Column:
    return db if db_range is None else F.greatest(F.least(db, F.lit(0.0)), F.lit(-float(db_range)))


def amplitude_to_db(x: Column, db_range: float | None = None, db_gain: float = 0.0) -> Column:
    return _clip(20 * F.log10(floored(x)) + F.lit(float(db_gain)), db_range)


def power_to_db(x: Column, db_range: float | None = None, db_gain: float = 0.0) -> Column:
    return _clip(10 * F.log10(floored(x)) + F.lit(float(db_gain)), db_range)


def db_to_amplitude(x: Column, db_gain: float = 0.0) -> Column:
    return F.pow(F.lit(10.0), (x - F.lit(float(db_gain))) / 20)


def db_to_power(x: Column, db_gain: float = 0.0) -> Column:
    return F.pow(F.lit(10.0), (x - F.lit(float(db_gain))) / 10)


def sum_db(level: Column) -> Column:
    """Aggregate: the level of the added powers."""
    return 10 * F.log10(F.sum(db_to_power(level)))


def mean_db(level: Column) -> Column:
    """Aggregate: the level of the mean power."""
    return 10 * F.log10(F.avg(db_to_power(level)))


def gain(x: Column, gain_db: float) -> Column:
    return x * F.lit(10 ** (gain_db / 20))


def next_power_of_two(x: Column) -> Column:
    """The smallest power of two at least as large as a positive whole number."""
    bits = F.length(F.bin((x - 1).cast("long")))
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), bits).cast("long"))


def wave_to_volt(x: Column, vadc: float = 2.0) -> Column:
    return x * F.lit(vadc / 2)


def volt_to_pressure(v: Column, gain_db: float, sensitivity: float = -35.0) -> Column:
    return v * F.lit(1 / 10 ** (sensitivity / 20) / 10 ** (gain_db / 20))


def wave_to_pressure(x: Column, gain_db: float, vadc: float = 2.0, sensitivity: float = -35.0) -> Column:
    return volt_to_pressure(wave_to_volt(x, vadc), gain_db, sensitivity)


def pressure_to_dbspl(p: Column, p_ref: float = 20e-6) -> Column:
    return 20 * F.log10(floored(p) / F.lit(p_ref))


def dbspl_to_pressure(level: Column, p_ref: float = 20e-6) -> Column:
    return F.pow(F.lit(10.0), level / 20) * F.lit(p_ref)


def wave_to_dbspl(x: Column, gain_db: float, vadc: float = 2.0, sensitivity: float = -35.0, p_ref: float = 20e-6) -> Column:
    return pressure_to_dbspl(F.abs(wave_to_pressure(x, gain_db, vadc, sensitivity)), p_ref)


amplitude_to_dbspl = wave_to_dbspl


def power_to_dbspl(p: Column, gain_db: float, vadc: float = 2.0, sensitivity: float = -35.0, p_ref: float = 20e-6) -> Column:
    return wave_to_dbspl(F.sqrt(p), gain_db, vadc, sensitivity, p_ref)


def leq_of_rms(rms: Column, gain_db: float, vadc: float = 2.0, sensitivity: float = -35.0, db_ref: float = 94.0, p_ref: float = 20e-6) -> Column:
    """The level of an RMS amplitude: dB of the voltage, less sensitivity and gain, re the reference level."""
    volt = wave_to_volt(rms, vadc)
    return amplitude_to_db(volt) - F.lit(sensitivity + gain_db - db_ref) - F.lit(_ref_shift(p_ref))


def _ref_shift(p_ref: float) -> float:
    from math import log10

    return 20 * log10(p_ref / 20e-6)

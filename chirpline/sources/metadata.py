"""Names, dates and headers of audio files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_DATE = "1900-01-01 00:00:01"

# What a field of a date notation is for Spark, and the numbers that it can be, with leading zeros; None for any digits, a width of 0 for a word.
FIELDS: dict[str, tuple[str, int, range | None]] = {
    "Y": ("yyyy", 4, None), "y": ("yy", 2, None), "m": ("MM", 2, range(1, 13)), "d": ("dd", 2, range(1, 32)), "j": ("DDD", 3, None), "H": ("HH", 2, range(24)), "I": ("hh", 2, range(1, 13)),
    "M": ("mm", 2, range(60)), "S": ("ss", 2, range(60)), "f": ("SSSSSS", 6, None), "p": ("a", 0, None), "A": ("EEEE", 0, None), "a": ("E", 0, None), "B": ("MMMM", 0, None), "b": ("MMM", 0, None),
}


def _parts(notation: str) -> list[tuple[str, str]]:
    """(field or "", plain text) of a strptime notation; fields that name no part of a date that Spark reads are refused."""
    found = []
    for m in re.finditer(r"%(.)|[^%]+|%$", notation):
        if m[1] is None or m[1] == "%":
            found.append(("", "%" if m[1] else m[0]))
        elif m[1] in FIELDS:
            found.append((m[1], ""))
        else:
            raise ValueError(f"%{m[1]} is no field of a date in a file name")
    return found


def date_pattern(notation: str) -> str:
    """A regular expression for the dates of a strptime notation, from the ranges of its fields."""

    def of(field: str) -> str:
        _, width, numbers = FIELDS[field]
        if numbers is None:
            return f"[0-9]{{{width}}}" if width else "[A-Za-zÀ-ÿ]+"
        tens = {}
        for i in numbers:
            tens.setdefault(i // 10, []).append(i % 10)
        return "(?:" + "|".join(f"{ten}[{ones[0]}-{ones[-1]}]" for ten, ones in tens.items()) + ")"

    return "".join(of(field) if field else re.escape(text) for field, text in _parts(notation))


def java_pattern(notation: str) -> str:
    """The same notation for Spark; plain letters are quoted."""
    return "".join(FIELDS[field][0] if field else re.sub("[A-Za-z]+", lambda m: f"'{m[0]}'", text) for field, text in _parts(notation))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_check(name: Column, readable: Column) -> Column:
    """0 well named, 1 unreadable, 2 not SITE_YYYYMMDD_HHMMSS with an extension of four characters; null names are unreadable."""
    return F.when(name.isNull() | ~F.coalesce(readable, F.lit(False)), 1).when(name.rlike(r"^[^_]*_[0-9]{8}_[0-9]{6}.{4}$"), 0).otherwise(2)


def filename_info(name: Column) -> tuple[Column, Column, Column]:
    """Sensor, date and time of a well-named file; null otherwise."""
    ok = name.rlike(r"^[^_]*_[0-9]{8}_[0-9]{6}.{4}$")
    part = lambda i: F.when(ok, F.element_at(F.split(name, "_"), i))
    stamp = F.concat(part(2), F.substring(part(3), 1, 6))
    return part(1), F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")), F.substring(part(3), 1, 6)


def parsed_date(name: Column, notation: str = "%Y%m%d_%H%M%S") -> Column:
    """The date in a file name by a strptime notation, ``SM4`` (characters 9 to 24) or ``POSIX`` (hexadecimal stem); else 1900-01-01 00:00:01."""
    default = F.lit(DEFAULT_DATE).cast("timestamp")
    if notation == "SM4":
        text, java = F.substring(name, 10, 15), "yyyyMMdd_HHmmss"
        found = F.when(text.rlike(r"^\d{8}.\d{6}$"), F.try_to_timestamp(F.concat(F.substring(text, 1, 8), F.lit("_"), F.substring(text, 10, 6)), F.lit(java)))
    elif notation == "POSIX":
        stem = F.regexp_replace(name, r"\.[^.]*$", "")
        found = F.when(stem.rlike("^[0-9A-Fa-f]{1,12}$"), F.timestamp_seconds(F.conv(stem, 16, 10).cast("long")))
    else:
        text = F.regexp_extract(name, f"({date_pattern(notation)})", 1)
        found = F.when(text != "", F.try_to_timestamp(text, F.lit(java_pattern(notation))))
    return F.coalesce(found, default)


def listing(spark: SparkSession, folder: str, pattern: str = "*.[Ww][Aa][Vv]") -> DataFrame:
    """All files below a folder with size, without their content: (path, fname, fsize, modified)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", basename(F.col("path")).alias("fname"), F.col("length").alias("fsize"), F.col("modificationTime").alias("modified"))

"""Timestamps in mixed notations and zones, normalised to one UTC instant.

A stamp is read once by a small grammar (date notation, clock notation, zone designation). What it
says about its zone counts first; otherwise the offset history of its place does. That history is
chosen among candidates, a single one where the place declares its zone, by aligning its local
stamps with their loading times: the delays from recording to loading must be spread like those
of stamps whose instant is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date as Date
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.session import checkpoint

EPOCH = datetime(1970, 1, 1)
UTC_NAMES = ("Z", "UTC", "GMT", "UT")

# Names of the months in English, German, French, Spanish and Portuguese.
MONTH_NAMES = (
    "january januar janvier enero janeiro jan",
    "february februar février febrero fevereiro feb",
    "march märz mars marzo março mar mär",
    "april avril abril apr",
    "may mai mayo maio",
    "june juni juin junio junho jun",
    "july juli juillet julio julho jul",
    "august août agosto aug",
    "september septembre septiembre setembro sep sept",
    "october oktober octobre octubre outubro oct okt",
    "november novembre noviembre novembro nov",
    "december dezember décembre diciembre dezembro dec dez",
)
MONTHS = {name: i + 1 for i, names in enumerate(MONTH_NAMES) for name in names.split()}
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

_YMD = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)")
_NUMERIC = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?!\d)")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})(?!\d)")
_DAY_FIRST = re.compile(r"(\d{1,2})(?:\.|st|nd|rd|th)? +(?:de +)?([^\W\d_]+)\.?,? +(?:de +)?(\d{4})(?!\d)", re.I)
_MONTH_FIRST = re.compile(r"([^\W\d_]+)\.? +(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})(?!\d)", re.I)
_WEEKDAY = re.compile(r"([^\W\d_]{2,10})\.?, +")
_CLOCK = re.compile(r"(\d{1,2})(?:[:.h](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?)(?!\d)(?: *([ap]\.?m\.?)(?![^\W\d_]))?", re.I)
_DIGITS = re.compile(r"(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?(?!\d)")
_OFFSET = re.compile(r"(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?(?!\d)")
_NAMED = re.compile(r"\[([A-Za-z]+(?:[/_+-][A-Za-z0-9_+-]+)*)\]")
_ABBREVIATION = re.compile(r"\(?([A-Za-z]{1,5})\)?")
_FILE = re.compile(r"(?:[A-Za-z][A-Za-z0-9]*[_-])?(\d{8}[_-]?\d{6}Z?)$")
_EXTENSION = re.compile(r"\.(?:wav|flac|mp3|ogg)$", re.I)
_HEX = re.compile(r"(?:0x)?([0-9A-Fa-f]{8})")

SCHEMA_ADDED = "status string, epoch_us long, local_us long, other_us long"
SCHEMA_READ = "status string, epoch_us long, local_us long, local2_us long, kind string, designation string"


@lru_cache(maxsize=None)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - an unknown or unsafe key is no zone
        return None


@lru_cache(maxsize=None)
def _abbreviations(name: str) -> dict[str, set[timedelta]]:
    """The offsets that each abbreviation of a zone stands for, over the years of the data."""
    z, found = _zone(name), {}
    for year in range(2014, 2032):
        for month in range(1, 13):
            at = datetime(year, month, 15, tzinfo=z)
            found.setdefault(at.tzname().upper(), set()).add(at.utcoffset())
    return found


def _date(text: str, order: str | None) -> tuple[list[tuple[int, int, int]], int, str | None]:
    """Possible (year, month, day), where the date ends, and the weekday it names."""
    weekday = None
    at = 0
    if m := _WEEKDAY.match(text):
        if m[1][:3].lower() not in WEEKDAYS:
            return [], 0, None
        weekday, at = m[1][:3].lower(), m.end()
    if m := _YMD.match(text, at):
        return [(int(m[1]), int(m[3]), int(m[4]))], m.end(), weekday
    if m := _NUMERIC.match(text, at):
        a, b, y = int(m[1]), int(m[3]), int(m[4])
        return {"DMY": [(y, b, a)], "MDY": [(y, a, b)]}.get(order or "", [(y, b, a), (y, a, b)]), m.end(), weekday
    if m := _COMPACT.match(text, at):
        return [(int(m[1]), int(m[2]), int(m[3]))], m.end(), weekday
    if (m := _DAY_FIRST.match(text, at)) and (month := MONTHS.get(m[2].lower())):
        return [(int(m[3]), month, int(m[1]))], m.end(), weekday
    if (m := _MONTH_FIRST.match(text, at)) and (month := MONTHS.get(m[1].lower())):
        return [(int(m[3]), month, int(m[2]))], m.end(), weekday
    return [], 0, None


def _clock(text: str) -> tuple[timedelta | None, str]:
    """The time of day and what follows it; None if there is none or it is impossible."""
    m = _CLOCK.match(text)
    half = (m[5] or "").lower().replace(".", "") if m else ""
    if not m and not (m := _DIGITS.match(text)):
        return None, ""
    hour, minute, second = int(m[1]), int(m[2]), int(m[3] or 0)
    if half:
        if not 1 <= hour <= 12:
            return None, ""
        hour = hour % 12 + 12 * (half == "pm")
    if hour > 23 or minute > 59 or second > 59:
        return None, ""
    micros = int((m[4] or "0").ljust(6, "0")[:6])
    return timedelta(hours=hour, minutes=minute, seconds=second, microseconds=micros), text[m.end() :].strip()


def _designation(text: str) -> tuple[str, object] | None:
    """('none', None), ('offset', timedelta), ('zone', name) or ('abbreviation', name); None if unreadable."""
    if not text:
        return "none", None
    if m := _OFFSET.match(text):
        rest = text[m.end() :].strip()
        if rest and not _NAMED.fullmatch(rest) and not _ABBREVIATION.fullmatch(rest):
            return None
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 14 or minutes > 59:
            return None
        return "offset", (1 if m[1] == "+" else -1) * timedelta(hours=hours, minutes=minutes)
    if m := _NAMED.fullmatch(text):
        return ("zone", m[1]) if _zone(m[1]) else None
    if m := _ABBREVIATION.match(text):
        rest, name = text[m.end() :].strip(), m[1].upper()
        if rest and not _NAMED.fullmatch(rest):
            return None
        return ("offset", timedelta()) if name in UTC_NAMES else ("abbreviation", name)
    return None


def _unix(text: str) -> list[int] | None:
    """Microseconds that a bare number stands for; None if the text is no bare number."""
    if text.isascii() and text.isdigit():
        if len(text) in (12, 14):
            return None
        if len(text) == 8 and 1900 <= int(text[:4]) <= 2099:
            return []
        found = [int(text) * 1_000_000, int(text) * 1000, int(text)]
        if len(text) == 8:
            found.append(int(text, 16) * 1_000_000)
        return [x for x in found if in_range(x)]
    m = _HEX.fullmatch(text)
    return [x for x in [int(m[1], 16) * 1_000_000] if in_range(x)] if m else None


def in_range(us: int) -> bool:
    """From the start of 2015 to the end of 2030, in UTC."""
    return 1_420_070_400_000_000 <= us < 1_924_992_000_000_000


def _micros(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def _instants(local: datetime, kind: str, what: object, zone: str | None) -> tuple[str, list[int]]:
    """Status and the UTC microseconds that a local time denotes."""
    if kind == "offset":
        return "ok", [_micros(local - what)]
    name = what if kind == "zone" else zone
    z = _zone(name) if name else None
    if z is None:
        return "no zone", []
    both = [local.replace(tzinfo=z, fold=f) for f in (0, 1)]
    valid = [x for x in both if x.astimezone(timezone.utc).astimezone(z).replace(tzinfo=None, fold=0) == local]
    if kind == "abbreviation":
        named = {x.utcoffset() for x in valid if x.tzname().upper() == what} or _abbreviations(name).get(what, set())
        return ("ok", [_micros(local - next(iter(named)))]) if len(named) == 1 else ("unknown abbreviation", [])
    found = sorted({_micros(local - x.utcoffset()) for x in valid})
    return ("skipped" if not found else "ok" if len(found) == 1 else "repeated"), found


def read_stamp(date: str | None, time: str | None, order: str | None) -> tuple:
    """(status, epoch_us, local_us, local2_us, kind, designation) of a stamp as far as it doesn't depend on its place.

    status ``ok`` has an instant, ``local`` one or two readings of a local time, to be converted
    by the zone or abbreviation in designation (kind ``zone``, ``abbreviation``) or by the place's
    zone (kind ``none``); any other status is final.
    """
    failed = lambda why, local=None: (why, None, local, None, None, None)
    d = _EXTENSION.sub("", (date or "").strip())
    t = (time or "").strip()
    if not d:
        return failed("no date")
    if not t or not any(c.isdigit() for c in t):
        numbers = _unix(d)
        if numbers is not None:
            return ("ok", numbers[0], None, None, "number", None) if len(numbers) == 1 else failed("not a time")
    if m := _FILE.fullmatch(d):
        d = m[1][:8] + " " + m[1][8:].lstrip("_-")
    elif len(d) in (12, 14) and d.isascii() and d.isdigit():
        d = d[:8] + " " + d[8:]
    days, end, weekday = _date(d, order)
    if not days:
        return failed("no date")
    rest = d[end:]
    rest = rest[1:] if rest[:1] in ("T", "t", "_") and rest[1:2].isdigit() else rest.lstrip(" ,")
    if t and rest and any(c.isdigit() for c in t):
        return failed("two times")
    clock, tail = _clock(rest or t)
    if clock is None:
        return failed("no time")
    says = _designation(tail)
    if says is None:
        return failed("unreadable zone")
    kind, what = says
    readings, status = [], "impossible"
    for y, month, day in days:
        try:
            local = datetime(y, month, day) + clock
        except (ValueError, OverflowError):
            continue
        if weekday and WEEKDAYS[Date(y, month, day).weekday()] != weekday:
            continue
        if not 1971 <= y <= 2100:
            status = "out of range"
            continue
        readings.append(_micros(local))
    if not readings:
        return failed(status)
    if kind == "offset":
        found = {x - what // timedelta(microseconds=1) for x in readings}
        if len(found) > 1:
            return failed("ambiguous order")
        us = found.pop()
        return ("ok" if in_range(us) else "out of range"), us, readings[0], None, kind, None
    return "local", None, readings[0], readings[1] if len(readings) > 1 else None, kind, what


def convert(local_us: int, local2_us: int | None, kind: str, designation: str | None, zone: str | None) -> tuple[str, int | None, int | None, int | None]:
    """(status, epoch_us, local_us, other_us) of a stamp that was read as a local time, in the zone of its place."""
    found, status = set(), "impossible"
    for us in {local_us, local2_us if local2_us is not None else local_us}:
        status, instants = _instants(EPOCH + timedelta(microseconds=us), kind, designation, zone)
        found |= set(instants)
    if status == "repeated":
        first, *others = sorted(found)
        return status, first, local_us, others[-1] if others else None
    if len(found) > 1:
        return "ambiguous order", None, None, None
    if not found:
        return status, None, local_us, None
    us = found.pop()
    return ("ok" if in_range(us) else "out of range"), us, local_us, None


def parse_stamp(date: str | None, time: str | None, zone: str | None, order: str | None) -> tuple[str, int | None, int | None, int | None]:
    """(status, epoch_us, local_us, other_us) of one stamp; see ``normalise``."""
    status, us, local, local2, kind, what = read_stamp(date, time, order)
    return convert(local, local2, kind, what, zone) if status == "local" else (status, us, local, None)


def _mapped(df: DataFrame, inputs: list[str], kernel, added: str, drop: list[str] | tuple = ()) -> DataFrame:
    """Add the columns ``added`` that a function of the columns ``inputs`` gives for each row, in Arrow batches."""
    names = [x.split()[0] for x in added.split(", ")]
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in drop]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean = lambda x: x if isinstance(x, str) else None if x is None or x != x else int(x)
        for pdf in batches:
            rows = [kernel(*map(clean, x)) for x in zip(*(pdf[c] for c in inputs))]
            out = pdf[[f.name for f in kept]].copy()
            for i, x in enumerate(added.split(", ")):
                out[names[i]] = pd.Series([r[i] for r in rows], index=pdf.index, dtype="Int64" if x.endswith(" long") else "object")
            yield out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])
    return df.mapInPandas(run, schema)


def read_stamps(stamps: DataFrame, order: str = "date_order") -> DataFrame:
    """Add what ``read_stamp`` reads to rows with date, time and a date order; columns of the added names are replaced."""
    return _mapped(stamps.drop(*[x.split()[0] for x in SCHEMA_READ.split(", ")]), ["date", "time", order], read_stamp, SCHEMA_READ)


def convert_stamps(read: DataFrame, zone: str = "zone") -> DataFrame:
    """Turn what was read into status, epoch_us, local_us and other_us; only local times go to Python."""
    local = _mapped(read.where("status = 'local'"), ["local_us", "local2_us", "kind", "designation", zone], convert, SCHEMA_ADDED, ("local2_us", "kind", "designation"))
    final = read.where("status <> 'local'").drop("local2_us", "kind", "designation").withColumn("other_us", F.lit(None).cast("long"))
    return final.unionByName(local)


def normalise(stamps: DataFrame, zone: str = "zone", order: str = "date_order") -> DataFrame:
    """Add status, epoch_us, local_us and other_us to rows with date, time, a zone and a date order.

    status ``ok``: exactly one instant from 2015 to 2030, in epoch_us. ``repeated`` and
    ``skipped``: the zone has the local time twice (epoch_us, other_us) or never, and the stamp
    doesn't decide. ``no zone``: the stamp has none and its place neither. Everything else has no
    instant: no date or time of day, impossible values, an unreadable or unknown zone, more than
    one reading. A null order of day and month leaves both readings open, which is no instant
    unless they agree. Nulls and empty texts have no date. Columns of the added names are replaced.
    """
    read = read_stamps(stamps.drop(*[x.split()[0] for x in SCHEMA_ADDED.split(", ")]), order)
    return _mapped(read, ["status", "epoch_us", "local_us", "local2_us", "kind", "designation", zone], lambda s, us, a, b, k, w, z: convert(a, b, k, w, z) if s == "local" else (s, us, a, None), SCHEMA_ADDED, ("local2_us", "kind", "designation"))


# Delays in quarters of an hour: one bucket each up to a day, one for four hours beyond, the last for all that is longer; the same below zero from -1 on.
QUARTER_US, DAY_QUARTERS, LAST_BUCKET = 900_000_000, 96, 246
# Known delays of a source from which on they count as its spread.
MIN_KNOWN = 200


def _bucket(quarters: Column) -> Column:
    size = F.when(quarters < 0, -1 - quarters).otherwise(quarters)
    at = F.when(size < DAY_QUARTERS, size).otherwise(F.least(DAY_QUARTERS + F.floor((size - DAY_QUARTERS) / 16), F.lit(LAST_BUCKET)))
    return F.when(quarters < 0, -1 - at).otherwise(at).cast("int")


def _log_density(counts: dict[int, float]) -> list[float]:
    """Log share per quarter of an hour of the buckets from the lowest to the last, smoothed over neighbours but not over zero."""
    half = np.array([1.0] * DAY_QUARTERS + [16.0] * (LAST_BUCKET - DAY_QUARTERS + 1))
    n = np.array([counts.get(b, 0.0) for b in range(-1 - LAST_BUCKET, LAST_BUCKET + 1)])
    width = np.concatenate((half[::-1], half))
    sides = [np.convolve(np.pad(x, 1, mode="edge"), [0.25, 0.5, 0.25], "valid") for x in np.split((n + 0.02) / width, 2)]
    return np.log(np.concatenate(sides) / (n + 0.02).sum()).tolist()


def delay_histograms(stamps: DataFrame, zones: list[str], place: str = "place") -> DataFrame:
    """Delays to loading of each place's local stamps under each of its candidate zones: (place, src, zone, b, n).

    ``stamps`` has place, src, local_us, loaded_us and declared, the single candidate of a place
    or null for all of ``zones``. Stamps are counted per place, local hour and delay first, so
    the candidates multiply those counts and not the stamps, and a place with a third of all rows is no hot key.
    """
    hour = F.floor(F.col("local_us") / 3_600_000_000).cast("long")
    quarters = F.floor((F.col("loaded_us") - F.col("local_us")) / QUARTER_US).cast("long")
    votes = stamps.groupBy(F.col(place).alias("place"), "src", "declared", hour.alias("hour"), quarters.alias("q")).agg(F.count(F.lit(1)).alias("n"))
    candidates = F.when(F.col("declared").isNotNull(), F.array("declared")).otherwise(F.array(*[F.lit(z) for z in zones]).cast("array<string>"))
    local = F.timestamp_seconds(F.col("hour") * 3600)
    tried = votes.select("place", "src", "q", "n", local.alias("local"), F.explode(candidates).alias("zone"))
    offset = F.unix_micros("local") - F.unix_micros(F.to_utc_timestamp("local", F.col("zone")))
    return tried.groupBy("place", "src", "zone", _bucket(F.col("q") + F.floor(offset / QUARTER_US)).alias("b")).agg(F.sum("n").alias("n"))


def zone_estimates(stamps: DataFrame, candidates: list[str], place: str = "place", known: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """The offset history of each place whose local stamps align best with their loading times: (place, zone, violations, n, lag_h, score).

    ``stamps`` has place, local_us and loaded_us, optionally src and declared (see
    ``delay_histograms``); ``known`` has src, epoch_us and loaded_us of stamps whose instant is
    certain. Under the true history, with its clock changes, the delays from recording to loading
    are spread like those of the known stamps: an offset too far east leaves the shortest delays
    out and one too far west makes stamps lie after their loading. Each source has its own
    spread. The score is the log likelihood of all delays of a place; the best zone wins, then the
    fewest violations, the shortest mean delay and the first name. The spread is then taken anew
    from the known stamps and the winners, ``rounds`` times; a place with one candidate has that one, and a score of 0 if all have. Where no source has ``MIN_KNOWN``
    known stamps, each candidate of the place with the most stamps gives a spread, and the one
    that suits all places best is the first. What reaches the driver are these spreads, 494
    numbers each. Rows that lack a value don't vote; a place without votes gets no zone.
    """
    spark = stamps.sparkSession
    for name, default in (("src", F.lit("")), ("declared", F.lit(None).cast("string"))):
        if name not in stamps.columns:
            stamps = stamps.withColumn(name, default)
    votes = stamps.where(f"{place} is not null and local_us is not null and loaded_us is not null")
    hist = checkpoint(delay_histograms(votes, candidates, place))
    # where every place has a single candidate, no spread is needed to tell
    undecided = not hist.groupBy("place").agg((F.min("zone") < F.max("zone")).alias("many")).where("many").isEmpty()
    certain: dict[str, dict[int, float]] = {}
    if known is not None and undecided:
        b = _bucket(F.floor((F.col("loaded_us") - F.col("epoch_us")) / QUARTER_US))
        for r in known.where("epoch_us is not null and loaded_us is not null").groupBy("src", b.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            certain.setdefault(r.src, {})[r.b] = r.n
    spreads = {src: n for src, n in certain.items() if sum(n.values()) >= MIN_KNOWN}

    def scored(spreads: dict[str, dict[int, float]]) -> DataFrame:
        rows = [(src, list(_log_density(n))) for src, n in spreads.items()]
        of = spark.createDataFrame(rows, "src string, d array<double>")  # one row for each source
        lag = F.when(F.col("b") < DAY_QUARTERS, F.col("b") / 4).otherwise(24 + (F.col("b") - DAY_QUARTERS) * 4)
        g = hist.join(F.broadcast(of), "src", "left").groupBy("place", "zone").agg(
            F.sum(F.col("n") * F.coalesce(F.get("d", F.col("b") + LAST_BUCKET + 1), F.lit(0.0))).alias("score"), F.sum(F.when(F.col("b") < 0, F.col("n")).otherwise(0)).alias("violations"),
            F.sum("n").alias("n"), (F.sum(F.col("n") * F.greatest(lag, F.lit(0))) / F.sum("n")).alias("lag_h"),
        )
        # likelihoods that agree to a millionth of a stamp are ties
        order = F.struct(F.round(-F.col("score"), 6).alias("s"), "violations", F.round("lag_h", 3).alias("lag_h"), "zone", "n")
        return g.groupBy("place").agg(F.min(order).alias("x")).select("place", "x.zone", "x.violations", "x.n", "x.lag_h", (-F.col("x.s")).alias("score"))

    if undecided and not spreads:
        spreads = _first_spread(hist)
    for _ in range(rounds if spreads else 0):
        best = scored(spreads).select("place", "zone")
        spreads = {src: dict(n) for src, n in certain.items()}
        for r in hist.join(best, ["place", "zone"]).groupBy("src", "b").agg(F.sum("n").alias("n")).collect():
            spreads.setdefault(r.src, {})
            spreads[r.src][r.b] = spreads[r.src].get(r.b, 0) + r.n
    return scored(spreads)


def _first_spread(hist: DataFrame) -> dict[str, dict[int, float]]:
    """The spread of the source and place with the most stamps under that candidate which suits all places of the source best."""
    top = hist.groupBy("src", "place", "zone").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "src", "place").limit(1).collect()
    if not top:
        return {}
    src, place = top[0].src, top[0].place
    own: dict[str, dict[int, float]] = {}
    for r in hist.where((F.col("src") == src) & (F.col("place") == place)).select("zone", "b", "n").collect():
        own.setdefault(r.zone, {})[r.b] = r.n
    densities = hist.sparkSession.createDataFrame([(z, b, d) for z, n in own.items() for b, d in zip(range(-1 - LAST_BUCKET, LAST_BUCKET + 1), _log_density(n))], "anchor string, b int, d double")
    fits = hist.where(F.col("src") == src).join(densities, "b").groupBy("anchor", "place", "zone").agg(F.sum(F.col("n") * F.col("d")).alias("s"))
    totals = fits.groupBy("anchor", "place").agg(F.max("s").alias("s")).groupBy("anchor").agg(F.round(F.sum("s"), 6).alias("s")).collect()
    rank = lambda r: (-r.s, sum(n for b, n in own[r.anchor].items() if b < 0), sum(max(b, 0) * n for b, n in own[r.anchor].items()), r.anchor)
    return {src: own[min(totals, key=rank).anchor]}


def stamps_of(stamp_raw: DataFrame, catalogue: DataFrame, site: DataFrame) -> DataFrame:
    """Stamps of both tables with the zone and date order of their place: (src, row_id, place, date, time, loaded_us, zone, date_order).

    A place that the site table lacks, or lists with several zones, has none. The join to the site
    table is left to Catalyst, which broadcasts it below its size threshold.
    """
    places = site.groupBy("site", "loc").agg(F.min("tz").alias("tz"), F.max("tz").alias("tz2"), F.min("date_order").alias("o"), F.max("date_order").alias("o2"))
    places = places.select("site", "loc", F.when(F.col("tz") == F.col("tz2"), F.col("tz")).alias("zone"), F.when(F.col("o") == F.col("o2"), F.col("o")).alias("date_order"))
    raw = stamp_raw.select(F.lit("stamp_raw").alias("src"), F.col("stamp_id").cast("long").alias("row_id"), "site", "date", "time", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded_us"))
    raw = raw.join(places.select("site", "zone", "date_order").dropDuplicates(["site"]), "site", "left").withColumnRenamed("site", "place")
    uploaded = F.expr("try_to_timestamp(uploaded, 'yyyy-MM-dd')")
    cat = catalogue.select(F.lit("catalogue").alias("src"), F.expr("try_cast(trim(id) as bigint)").alias("row_id"), "loc", "date", "time", (F.unix_micros(uploaded) + 86_400_000_000).alias("loaded_us"))
    cat = cat.join(places.select("loc", "site", "zone", "date_order").dropDuplicates(["loc"]), "loc", "left").withColumn("place", F.coalesce("site", "loc")).drop("site", "loc")
    return raw.unionByName(cat)


def candidate_zones(site: DataFrame, max_zones: int = 1000) -> list[str]:
    """The distinct zones of the site table, read to the driver only up to ``max_zones``; the call fails beyond that."""
    zones = [r.tz for r in site.select("tz").where("tz is not null").distinct().limit(max_zones + 1).collect()]
    if len(zones) > max_zones:
        raise ValueError(f"more than {max_zones} candidate zones")
    return sorted(z for z in zones if _zone(z)) or ["UTC"]


def place_zones(read: DataFrame, zones: list[str]) -> DataFrame:
    """``zone_estimates`` of the places of stamps that were read; a declared zone is a place's only candidate."""
    declared = F.when(F.col("zone").isin(zones), F.col("zone"))
    local = read.where("status = 'local' and kind = 'none' and local2_us is null").withColumn("declared", declared)
    return zone_estimates(local, zones, known=read.where("status = 'ok' and kind in ('offset', 'number')"))


def normalised_stamps(stamp_raw: DataFrame, catalogue: DataFrame, site: DataFrame, max_zones: int = 1000) -> DataFrame:
    """``normalise`` of all stamps, with the zone of their place by ``place_zones``: its declared one, or the estimated one where it has none.

    Stamps are read once and written; the estimate and the conversion work on what was read.
    """
    zones = candidate_zones(site, max_zones)
    read = checkpoint(read_stamps(stamps_of(stamp_raw, catalogue, site)).drop("date", "time", "date_order"))
    # a place has one row; a zone that no loading time tells stays the declared one
    known = read.join(place_zones(read, zones).select("place", F.col("zone").alias("estimated")), "place", "left")
    return convert_stamps(known.withColumn("zone", F.coalesce("estimated", "zone")))


def instants(normalised: DataFrame) -> DataFrame:
    """The stamps that denote exactly one instant, each once: (src, row_id, epoch_us)."""
    return normalised.where("status = 'ok' and row_id is not null").select("src", "row_id", "epoch_us").distinct()

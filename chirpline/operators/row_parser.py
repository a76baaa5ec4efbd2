"""Label lines into typed records and located errors.

The grammar of a line, as a recursive descent over its characters:

    line    = field { TAB field } [ CR ]
    field   = quoted | plain
    quoted  = '"' { any character but '"' | '""' } '"'      followed by TAB or the end
    plain   = { any character but TAB }                     a later '"' is ordinary

A broken quote ends the descent at its place. The parser then looks for the next validated
record-start anchor, a place from which a whole record parses (two bounds and a label, or a
backslash and two bounds), and resumes there, so one bad quote or a lost line end costs no more
than the record it stands in. An anchor is any bound that is followed by a TAB, quoted or not, or
the backslash of a frequency record.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.session import checkpoint

NUMBER = re.compile(r"[ ]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[ ]*")
_NUM = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ ]*"
# A negative field is passed over. A number starts an anchor at its first digit, or where it stands
# directly behind another one of six decimals, as they are written.
ANCHOR = re.compile(rf'(?:^|(?<=\t))[ ]*-{_NUM}\t|(?P<at>"\\"\t|\\\t|"[ ]*\+?{_NUM}"\t|(?:(?<![0-9.+])(?<!^-)(?<!\t-)|(?<=\.[0-9]{{6}}))\+?{_NUM}\t)')
FREQUENCY = "\\"

PARSED = "reason string, error_at int, is_frequency boolean, lo double, hi double, label string, salvaged array<struct<at:int,is_frequency:boolean,lo:double,hi:double,label:string>>"


class BrokenQuote(ValueError):
    """``at`` is the place of the error, ``resume`` the first place at which another record may start."""

    def __init__(self, at: int, resume: int | None = None):
        self.at, self.resume = at, at if resume is None else resume


def _quoted(line: str, at: int) -> tuple[str, int]:
    start, parts = at, []
    at += 1
    while True:
        close = line.find('"', at)
        if close < 0:
            raise BrokenQuote(start)
        parts.append(line[at:close])
        if line.startswith('""', close):
            parts.append('"')
            at = close + 2
            continue
        if close + 1 < len(line) and line[close + 1] != "\t":
            raise BrokenQuote(close + 1)
        return "".join(parts), close + 1


def _plain(line: str, at: int) -> tuple[str, int]:
    tab = line.find("\t", at)
    end = len(line) if tab < 0 else tab
    return line[at:end], end


def _fields(line: str, at: int) -> tuple[list[str], list[int]]:
    values, places = [], []
    while True:
        places.append(at)
        try:
            value, at = _quoted(line, at) if line.startswith('"', at) else _plain(line, at)
        except BrokenQuote as broken:
            if broken.at > at and len(values) < 2:  # what follows a quoted bound up to the label is no record
                label = broken.at
                for _ in range(2 - len(values)):
                    label = line.find("\t", label) + 1 or len(line)
                raise BrokenQuote(broken.at, label) from None
            raise
        values.append(value)
        if at >= len(line):
            return values, places
        at += 1


def _bound(text: str) -> float | None:
    m = NUMBER.fullmatch(text)
    x = float(m[1]) if m else math.nan
    return x if math.isfinite(x) and x >= 0 else None


def _record(values: list[str], places: list[int]) -> tuple[str | None, int, tuple | None]:
    if len(values) != 3:
        return "columns", places[3] if len(places) > 3 else places[-1] + len(values[-1]), None
    frequency = values[0] == FREQUENCY
    first = 1 if frequency else 0
    bounds = []
    for i in (first, first + 1):
        x = _bound(values[i])
        if x is None:
            return "value", places[i], None
        bounds.append(x)
    if bounds[1] < bounds[0]:
        return "value", places[first + 1], None
    return None, -1, (frequency, bounds[0], bounds[1], None if frequency else values[2])


def _behind(values: list[str], places: list[int]) -> int:
    """The first place behind the bounds of the record that a line with a wrong number of fields starts with."""
    frequency = values[0] == FREQUENCY
    bounds = values[1:2] if frequency else values[:2]
    return places[2] + frequency if len(places) > 2 and all(_bound(x) is not None for x in bounds) else 1


def _resumed(line: str, at: int, anchors: list[int], found: dict[int, tuple]) -> tuple[int, tuple] | None:
    """(end, record) of the record at an anchor; ``found`` holds those of the later anchors."""
    start, values, places = at, [], []
    try:
        for k in range(3):
            if k and (at >= len(line) or line[at] != "\t"):
                return None
            at += k > 0
            places.append(at)
            if line.startswith('"', at):
                value, at = _quoted(line, at)
            elif k == 2 and at in found and values[0] != FREQUENCY:
                value = ""  # the label is empty: another record starts in its place
            else:
                value, end = _plain(line, at)
                if k == 2 and (i := bisect_right(anchors, at)) < len(anchors):
                    end = min(end, anchors[i])
                value, at = line[at:end], end
            values.append(value)
    except BrokenQuote:
        return None
    rest = at
    while rest < len(line) and line[rest] == "\t":
        rest += 1
    if rest < len(line) and (i := bisect_right(anchors, rest) - 1) >= 0 and anchors[i] != rest:
        return None
    reason, _, record = _record(values, places)
    return None if reason else (at, (start, *record))


def _salvage(line: str, after: int) -> list[tuple]:
    """Whole records that parse from anchors at ``after`` or behind; each ends at the line's end or where the next anchor starts."""
    anchors = [m.start() for m in ANCHOR.finditer(line) if m["at"] and m.start() > 0]
    found: dict[int, tuple] = {}
    for at in reversed(anchors):
        if at >= after and (x := _resumed(line, at, anchors, found)):
            found[at] = x
    out = []
    for at in anchors:
        if at >= after and at in found:
            after, record = found[at]
            out.append(record)
    return out


def parse_line(line: str | None) -> tuple:
    """(reason, error_at, is_frequency, lo, hi, label, salvaged) of one line; see ``parse_lines``."""
    text = "" if line is None else line[:-1] if line.endswith("\r") else line
    try:
        values, places = _fields(text, 0)
    except BrokenQuote as broken:
        return "quoting", broken.at, None, None, None, None, _salvage(text, broken.resume)
    reason, at, record = _record(values, places)
    if reason:
        return reason, at, None, None, None, None, _salvage(text, _behind(values, places)) if reason == "columns" else []
    return None, None, *record, []


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Every row with the outcome of its line: typed record, or reason and place of the error.

    Added columns: reason (null if valid; ``quoting``, ``columns`` or ``value``), error_at
    (characters from 0), is_frequency, lo, hi, label, and salvaged, the records that parse behind
    the error. Columns of the same names in the input are replaced. A null line has no fields and
    is faulty by ``columns``, as is an empty one. Lines are parsed one by one in Arrow batches,
    without a shuffle, so neither long files nor hot ones matter.
    """
    names = ["reason", "error_at", "is_frequency", "lo", "hi", "label", "salvaged"]
    kept = lines.drop(*[n for n in names if n != line])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [parse_line(x if isinstance(x, str) else None) for x in pdf[line]]
            out = pdf.copy()
            for name, column in zip(names, zip(*parsed) if parsed else [()] * len(names)):
                out[name] = pd.Series(column, index=pdf.index, dtype="object")
            out["salvaged"] = [[dict(zip(("at", "is_frequency", "lo", "hi", "label"), x)) for x in row] for row in out["salvaged"]]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, f"{schema}, {PARSED}")


# Lines that built-in functions can type: two short plain numbers and a plain label, as nearly all are.
_SHORT = r"[0-9]{1,9}(?:\.[0-9]{1,9})?"
PLAIN = rf'^(?:{_SHORT}\t{_SHORT}\t(?:[^"\t\r\n][^\t\r\n]*)?|\\\t{_SHORT}\t{_SHORT})\z'


def _split(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records of plain lines, typed by built-in functions, and all other lines: plain lines with reversed bounds are among these."""
    text = F.when(F.col("line").endswith("\r"), F.substr("line", F.lit(1), F.char_length("line") - 1)).otherwise(F.col("line"))
    frequency = text.startswith(FREQUENCY)
    parts = F.split(text, "\t")
    bound = lambda i: F.get(parts, F.when(frequency, i + 1).otherwise(i)).cast("double")
    plain = F.when(F.coalesce(text.rlike(PLAIN), F.lit(False)), bound(0) <= bound(1)).otherwise(False)
    keys = lines.select("rec_id", F.col("line_no").cast("long").alias("line_no"), "line")
    typed = keys.where(plain).select("rec_id", "line_no", frequency.alias("is_frequency"), bound(0).alias("lo"), bound(1).alias("hi"), F.when(~frequency, F.get(parts, F.lit(2))).alias("label"))
    return typed, keys.where(~plain)


def valid_records(lines: DataFrame) -> DataFrame:
    """The records of valid lines, each once: (rec_id, line_no, is_frequency, lo, hi, label). Two different deliveries of a line give both."""
    typed, others = _split(lines)
    return typed.unionByName(parse_lines(others).where("reason is null").select(*typed.columns)).distinct()


def faulty_lines(lines: DataFrame) -> DataFrame:
    """The faulty lines, each once: (rec_id, line_no, reason). A line delivered again counts once; of two different deliveries both do."""
    return parse_lines(_split(lines)[1]).where("reason is not null").select("rec_id", "line_no", "reason").distinct()


def located_faults(lines: DataFrame) -> DataFrame:
    """The faulty lines with the place of the error: (rec_id, line_no, reason, error_at), characters from 0."""
    return parse_lines(_split(lines)[1]).where("reason is not null").select("rec_id", "line_no", "reason", "error_at").distinct()


def salvaged_records(lines: DataFrame) -> DataFrame:
    """The records that parse behind an error: (rec_id, line_no, position, min_t, max_t, label, min_f, max_f).

    Position is the character of the line, from 0, at which the record starts. A time record takes
    the frequency record that follows it directly: the next one salvaged from its line or, behind
    the last, a valid next line. A salvaged frequency record without such a time record stands
    alone, with null min_t, max_t and label. Lines delivered again count once.
    """
    return _salvaged(parse_lines(_split(lines)[1]), valid_records(lines))


def _salvaged(parsed: DataFrame, valid: DataFrame) -> DataFrame:
    faulty = parsed.where("reason is not null and size(salvaged) > 0").select("rec_id", "line_no", "salvaged").distinct()
    each = faulty.select("rec_id", "line_no", "salvaged", F.posexplode("salvaged").alias("i", "r"))
    before = F.when(F.col("i") > 0, F.get("salvaged", F.col("i") - 1))
    each = each.select("rec_id", "line_no", "r", F.get("salvaged", F.col("i") + 1).alias("then"), before.alias("before"))
    each = each.where("not r.is_frequency or before is null or before.is_frequency")
    f = valid.where("is_frequency").select("rec_id", (F.col("line_no") - 1).alias("line_no"), F.col("lo").alias("next_lo"), F.col("hi").alias("next_hi"))
    time = ~F.col("r.is_frequency")
    bound = lambda c: F.when(~time, F.col(f"r.{c}")).when(F.col("then.is_frequency"), F.col(f"then.{c}")).when(F.col("then").isNull(), F.col(f"next_{c}"))
    return each.join(f, ["rec_id", "line_no"], "left").select(
        "rec_id", "line_no", F.col("r.at").alias("position"), F.when(time, F.col("r.lo")).alias("min_t"), F.when(time, F.col("r.hi")).alias("max_t"),
        F.when(time, F.col("r.label")).alias("label"), bound("lo").alias("min_f"), bound("hi").alias("max_f"),
    ).distinct()


def label_records(lines: DataFrame) -> DataFrame:
    """The valid annotations: (rec_id, line_no, min_t, max_t, label, min_f, max_f).

    A time line takes the frequency line that follows it directly in its file, by an equi-join on
    (rec_id, line_no + 1), so a very long file is no hot key; where none follows, or that one is
    faulty, min_f and max_f are null. Lines delivered again count once; of two different
    deliveries both do.
    """
    return _annotations(valid_records(lines))


def _annotations(good: DataFrame) -> DataFrame:
    t = good.where("not is_frequency").select("rec_id", "line_no", F.col("lo").alias("min_t"), F.col("hi").alias("max_t"), "label")
    f = good.where("is_frequency").select("rec_id", (F.col("line_no") - 1).alias("line_no"), F.col("lo").alias("min_f"), F.col("hi").alias("max_f"))
    return t.join(f, ["rec_id", "line_no"], "left")


def all_records(lines: DataFrame) -> DataFrame:
    """Valid and salvaged annotations: (rec_id, line_no, position, min_t, max_t, label, min_f, max_f); position is 0 for whole lines.

    The lines are parsed once and what they give is written for both.
    """
    typed, others = _split(lines)
    parsed = checkpoint(parse_lines(others).drop("line"))
    valid = checkpoint(typed.unionByName(parsed.where("reason is null").select(*typed.columns)).distinct())
    return _annotations(valid).withColumn("position", F.lit(0)).unionByName(_salvaged(parsed, valid))


def lines_of(text: str | None, most: int = 20) -> Iterator[tuple[int, str]]:
    """(number, line) of a file's raw text, from 1, in which a quoted field may hold line ends.

    Where a line's quote isn't closed, the lines behind it are joined to it up to the first one
    that closes the field, at most ``most``, if the whole is a valid record; so long labels over
    several lines are kept. Otherwise the quote is broken: its line stays alone and the next line
    is a record-start anchor, so that a lost quote doesn't swallow the file. A joined line
    has the number of its first. A final line end starts no line.
    """
    raw = (text or "").split("\n")
    if raw and raw[-1] == "":
        raw.pop()
    at = 0
    while at < len(raw):
        upto = at + 1
        if parse_line(raw[at])[0] == "quoting":
            for end in range(at + 2, min(at + 1 + most, len(raw)) + 1):
                reason = parse_line("\n".join(raw[at:end]))[0]
                if reason is None:
                    upto = end
                if reason != "quoting" or parse_line(raw[end - 1])[0] is None:
                    break
        yield at + 1, "\n".join(raw[at:upto])
        at = upto


def raw_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """The lines of files that come as whole texts: (rec_id, line_no, line), by ``lines_of``, in Arrow batches and without a shuffle. Null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec_id, x in zip(pdf["rec_id"], pdf[text]):
                rows = list(lines_of(x if isinstance(x, str) else None))
                if rows:
                    yield pd.DataFrame({"rec_id": pd.Series([rec_id] * len(rows), dtype=pdf["rec_id"].dtype), "line_no": [n for n, _ in rows], "line": pd.Series([v for _, v in rows], dtype="object")})

    return files.select("rec_id", text).mapInPandas(run, "rec_id long, line_no int, line string")

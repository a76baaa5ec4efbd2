"""The catalogue of published recordings: JSON pages, cleaning and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.operators.relational import top_k

# The fields of a catalogue record.
FIELDS = (
    "id gen sp ssp grp en rec cnt loc lat lng alt type sex stage method url file file_name sono osci lic q length time date uploaded also rmk bird_seen animal_seen playback_used temp regnr auto dvc mic smp"
).split()
# Keys of the JSON pages that a column name cannot have.
JSON_KEYS = {"grp": "group", "file_name": "file-name", "bird_seen": "bird-seen", "animal_seen": "animal-seen", "playback_used": "playback-used"}


def from_json(pages: DataFrame, column: str = "value") -> DataFrame:
    """Records of JSON pages ``{"recordings": [...]}``, one row each, all fields text; broken pages and missing fields give nulls or nothing."""
    page = "recordings array<struct<" + ", ".join(f"`{JSON_KEYS.get(f, f)}`: string" for f in FIELDS) + ">>"
    rows = pages.select(F.from_json(column, page).alias("p")).select(F.inline("p.recordings"))
    return rows.withColumnsRenamed({v: k for k, v in JSON_KEYS.items()})


def to_json(catalogue: DataFrame) -> DataFrame:
    """One page per record, the inverse of ``from_json``: (value)."""
    record = F.struct(*[F.col(f).alias(JSON_KEYS.get(f, f)) for f in FIELDS])
    return catalogue.select(F.to_json(F.struct(F.array(record).alias("recordings"))).alias("value"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return from_json(spark.read.text(path, wholetext=True))


def cleaned(catalogue: DataFrame) -> DataFrame:
    """Rows with a usable time and date: coordinates as numbers, length of five characters, week and datetime added.

    Times must be H:MM or HH:MM and dates yyyy-mm-dd; other rows are dropped. Lengths of four
    characters get a leading zero; nulls stay.
    """
    t, d = F.col("time"), F.col("date")
    ok = catalogue.where(t.rlike("^(?:[01]?[0-9]|2[0-3]):[0-5][0-9]$") & d.rlike("^(?:20|19)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0?[1-9]|[12][0-9]|3[01])$"))
    at = F.try_to_timestamp(F.concat_ws(" ", d, F.lpad(t, 5, "0")), F.lit("yyyy-MM-d HH:mm"))
    length = F.when(F.length("length") == 4, F.concat(F.lit("0"), "length")).otherwise(F.col("length"))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    c = ok.withColumn("lat", number("lat")).withColumn("lng", number("lng")).withColumn("length", length).withColumn("time", F.lpad(t, 5, "0")).withColumn("datetime", at)
    return c.where("datetime is not null").withColumn("week", F.weekofyear("datetime").cast("long"))


def selection(catalogue: DataFrame, max_files: int = 100, max_length: str = "01:00", min_length: str = "00:10", min_quality: str = "B") -> DataFrame:
    """Per species the best and longest records, at most ``max_files``; lengths are compared as text, ids break ties."""
    ok = catalogue.where(F.col("q").isin(list("ABCDE"[: "ABCDE".index(min_quality) + 1])) & F.col("length").between(min_length, max_length))
    return top_k(ok, ["gen", "sp"], [F.col("q"), F.desc("length"), F.col("id")], max_files)


def local_paths(catalogue: DataFrame, root: str, dataset: str) -> DataFrame:
    """Where the file of each record is kept: root/dataset/<gen sp_en>/XC<id>.<extension>."""
    ext = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    folder = F.concat_ws("", F.col("gen"), F.lit(" "), F.col("sp"), F.lit("_"), F.col("en"))
    return catalogue.withColumn("path", F.concat_ws("/", F.lit(root), F.lit(dataset), folder, F.concat(F.lit("XC"), "id", F.lit("."), ext)))


def search(catalogue: DataFrame, terms: dict[str, str]) -> DataFrame:
    """Records whose fields equal the terms; an empty dict finds all."""
    found = catalogue
    for field, value in terms.items():
        if field not in FIELDS:
            raise ValueError(f"no field {field}")
        found = found.where(F.col(field) == value)
    return found


def multi_search(catalogue: DataFrame, queries: list[dict[str, str]], fields: list[str]) -> DataFrame:
    """The records of several searches, a row for each search that finds one, with its terms as ``q_<field>``.

    The searches are a parameter list and are tried on each record in one scan; a field that a
    search doesn't name may have any value.
    """
    lit = F.array(*[F.struct(*[F.lit(x.get(f)).cast("string").alias(f"q_{f}") for f in fields]) for x in queries])

    def fits(s):
        ok = F.lit(True)
        for f in fields:
            ok = ok & (s[f"q_{f}"].isNull() | (s[f"q_{f}"] == F.col(f)))
        return ok

    return catalogue.select("*", F.inline(F.filter(lit, fits)))

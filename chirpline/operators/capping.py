"""A maximum number of records per contributor, by quality, for records with several contributors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chirpline.session import checkpoint


# Open edges that one task finishes in order; more go through another round.
FINISH_EDGES = 200_000


def suitor_b_matching(edges: DataFrame, capacity: int, order: list[str], finish_edges: int = FINISH_EDGES) -> DataFrame:
    """Records that every contributor they list keeps, when each keeps ``capacity`` records at most.

    ``edges`` has ``record``, ``contributor`` and the columns of ``order`` (best first when sorted
    ascending, the same on all edges of a record; record itself breaks ties). Every record
    proposes to all its contributors. A contributor holds its best proposals and displaces the
    weakest; a record that one of them is full of better ones for is out and withdraws the others,
    whose places go to the next best. The outcome is the stable one, in which a record is out only
    if a contributor is full of better ones.

    Records of a single contributor propose first: their best ``capacity`` stay its suitors unless
    better ones displace them, so nothing weaker than the last of them can be held there. That
    alone decides an input without shared records. Shared records that this bound leaves open go
    on in rounds, each of which decides at least the best open record and all that depend on
    decided ones alone; as soon as at most ``finish_edges`` edges are open, which is measured, one
    task decides them in order. A chain of records that share contributors in the order of their
    quality takes a round for each record beyond that bound.

    A contributor may hold a third of all rows: the filters on ranks let Spark keep only the best
    ``capacity`` rows of each contributor in every task before the shuffle. Rows without record or
    contributor don't take part; repeated edges count once. Returns (record, contributor).
    """
    by = [F.col(c) for c in order] + [F.col("record")]
    rank = F.row_number().over(Window.partitionBy("contributor").orderBy(*by))
    rows = edges.select("record", "contributor", *order).where("record is not null and contributor is not null").repartition("record").dropDuplicates(["record", "contributor"])
    # written once; a record's edges lie in one task, so counting them needs no other shuffle
    listed = checkpoint(rows.withColumn("lists", F.count(F.lit(1)).over(Window.partitionBy("record"))))
    suitors = listed.where("lists = 1").withColumn("rank", rank).where(F.col("rank") <= capacity).select("record", "contributor", *order, "lists", "rank")
    shared = listed.where("lists > 1")
    if shared.isEmpty():
        return suitors.select("record", "contributor")
    suitors = checkpoint(suitors)
    weakest = suitors.where(F.col("rank") == capacity).select("contributor", F.struct(*by).alias("weakest"))
    displaced = shared.join(weakest, "contributor").where(F.struct(*by) > F.col("weakest")).select("record").distinct()
    room = F.lit(capacity).alias("room")
    open_ = checkpoint(shared.join(displaced, "record", "left_anti").unionByName(suitors.drop("rank")).select("*", room))
    kept = []
    while (n := open_.count()) > finish_edges:
        # a proposal is held if it is among the best that its contributor still has room for
        held = open_.withColumn("rank", rank).where(F.col("rank") <= capacity).where("rank <= room")
        now_in = held.groupBy("record").agg((F.count(F.lit(1)) == F.first("lists")).alias("all")).where("all").select("record")
        got = checkpoint(held.join(now_in, "record", "left_semi").select("record", "contributor"))
        kept.append(got)
        taken = got.groupBy("contributor").agg(F.count(F.lit(1)).cast("int").alias("taken"))
        rest = open_.join(got.select("record").distinct(), "record", "left_anti").join(taken, "contributor", "left")
        rest = rest.withColumn("room", F.col("room") - F.coalesce("taken", F.lit(0))).drop("taken")
        out = rest.where("room <= 0").select("record").distinct()
        open_ = checkpoint(rest.join(out, "record", "left_anti"))
    if n:
        kept.append(_in_order(open_, by))
    return reduce(DataFrame.unionByName, kept)


def _in_order(open_: DataFrame, by: list[Column]) -> DataFrame:
    """A few open edges decided in one task, best record first: (record, contributor)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room: dict = {}
        record, lists, asked = None, 0, []
        for pdf in batches:
            kept = []
            for r, c, n, k in zip(pdf["record"], pdf["contributor"], pdf["lists"], pdf["room"]):
                if r != record:
                    record, lists, asked = r, n, []
                room.setdefault(c, k)
                asked.append(c)
                if len(asked) == lists and all(room[x] > 0 for x in asked):
                    kept += [(r, x) for x in asked]
                    for x in asked:
                        room[x] -= 1
            yield pd.DataFrame({name: pd.Series([row[i] for row in kept], dtype=pdf[name].dtype) for i, name in enumerate(("record", "contributor"))})

    types = dict(open_.dtypes)
    return open_.repartition(1).sortWithinPartitions(*by).mapInPandas(run, f"record {types['record']}, contributor {types['contributor']}")


def length_seconds(length: Column) -> Column:
    """Seconds of ``m:ss`` or ``h:mm:ss``; null if unreadable."""
    t = F.trim(length)
    ok = t.rlike("^(?:[0-9]+:[0-5]?[0-9]:[0-5][0-9]|[0-9]+:[0-5][0-9])$")
    parts = F.split(F.when(ok, t), ":")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 60 + x.cast("long"))


def quality_rank(q: Column) -> Column:
    """0 to 4 for the grades A to E in either case with outer blanks, 5 for anything else."""
    at = F.instr(F.lit("ABCDE"), F.upper(F.trim(q)))
    return F.when((F.length(F.trim(q)) == 1) & (at > 0), at - 1).otherwise(5)


def catalogue_edges(catalogue: DataFrame, others: dict[str, str] | None = None) -> DataFrame:
    """Edges of the catalogue: record = id as a number, contributor = recordist, order = q, longer, id.

    Recordists are compared without case and outer blanks; a missing recordist caps nobody and a
    missing or unreadable length is the shortest. Of an id that is listed again the best row
    counts. ``others`` names further columns whose values are contributors as well, each with a
    prefix that keeps them apart; all contributors then have the prefix of their column.
    """
    named = {"rec": ""} if others is None else {"rec": "rec:", **others}
    each = [F.when(F.trim(c) != "", F.concat(F.lit(prefix), F.lower(F.trim(c)))) for c, prefix in named.items()]
    rows = catalogue.select(
        F.expr("try_cast(trim(id) as bigint)").alias("record"),
        F.explode(F.array(*each)).alias("contributor"),
        quality_rank(F.col("q")).cast("int").alias("grade"),
        (-F.coalesce(length_seconds(F.col("length")), F.lit(-1))).cast("long").alias("shortness"),
    ).where("record is not null and contributor is not null")
    return rows.groupBy("record", "contributor").agg(F.min(F.struct("grade", "shortness")).alias("b")).select("record", "contributor", "b.grade", "b.shortness")


def shared_catalogue(catalogue: DataFrame, capacity: int = 12, others: dict[str, str] | None = None) -> DataFrame:
    """Ids kept when no recordist and no place, or other column of ``others``, keeps more than ``capacity``: (id, contributors).

    Each record lists several contributors and is kept only if all have room for it. A record's
    quality is its best row's, on all its edges.
    """
    edges = catalogue_edges(catalogue, {"loc": "loc:"} if others is None else others)
    best = edges.groupBy("record").agg(F.min(F.struct("grade", "shortness")).alias("b"))
    kept = suitor_b_matching(edges.select("record", "contributor").join(best.select("record", "b.grade", "b.shortness"), "record"), capacity, ["grade", "shortness"])
    # a record lists at most one contributor a column and delivery
    return kept.groupBy("record").agg(F.sort_array(F.collect_list("contributor")).alias("contributors")).select(F.col("record").cast("string").alias("id"), "contributors")


def capped_catalogue(catalogue: DataFrame, capacity: int = 12) -> DataFrame:
    """Ids kept from recordists that have more than ``capacity`` distinct ids: (id)."""
    edges = catalogue_edges(catalogue)
    kept = suitor_b_matching(edges, capacity, ["grade", "shortness"])
    dominant = edges.groupBy("contributor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > capacity)
    return kept.join(dominant, "contributor", "left_semi").select(F.col("record").cast("string").alias("id")).distinct()

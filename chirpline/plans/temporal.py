"""Queries on waveforms: decibels, calibration, propagation, framing and temporal indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.functions import decibel as db
from chirpline.functions import propagation as pg
from chirpline.operators import signal as sg
from chirpline.plans.registry import ENV, EV, FS, LEV, M, NT, SIG, SPEC, R, Registry, cells, event_series, rounded, signals

q = Registry()
QUERIES, ORACLES = q.queries, q.sql

FREQS, DISTS = [100.0, 1000.0, 2500.0, 8000.0], [1.0, 5.0, 10.0, 50.0, 200.0]
_VAP = "60 * 101325 * pow(10, -6.8346 * pow(273.16::DOUBLE / 293.15, 1.261) + 4.6151) / 101325"
AIR = f"""air AS (SELECT f, 8.686::DOUBLE * f * f * (1.84e-11 + 0.01275::DOUBLE * exp(-2239.1::DOUBLE / 293.15) / (fo + f * f / fo)
    + 0.1068::DOUBLE * exp(-3352::DOUBLE / 293.15) / (fr + f * f / fr)) AS c
  FROM (SELECT f, 24 + 4.04e4 * h * (0.02 + h) / (0.391 + h) AS fo, 9 + 280 * h AS fr
    FROM (SELECT unnest([100.0, 1000.0, 2500.0, 8000.0]::DOUBLE[]) AS f, ({_VAP})::DOUBLE AS h)))"""
GRID = AIR + ", grid AS (SELECT f, c, r FROM air, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 200.0]::DOUBLE[]) AS r))"
_C = "(20 * log10(exp(1)))"
_FACTOR = f"(1 / r) * exp(-c / {_C} * (r - 1)) * exp(-(0.02::DOUBLE * f / 1000) / 20 * log10(exp(1)) * (r - 1))"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return sg.samples(signals(spark, d)).select("rec_id", "i", "x")


@q(f"WITH {SIG} SELECT rec_id, i, {R(f'20 * log10(greatest(abs(x), {M}))', 'db')}, {R(f'greatest(least(20 * log10(greatest(abs(x), {M})), 0), -30)', 'clipped')} FROM sig")
def amplitude_to_db(spark, d):
    x = F.col("x")
    return rounded(_samples(spark, d).select("rec_id", "i", db.amplitude_to_db(x).alias("db"), db.amplitude_to_db(x, db_range=30).alias("clipped")))


@q(f"WITH {SPEC} SELECT rec_id, t_idx, f_idx, {R(f'10 * log10(greatest(p, {M}))', 'db')}, {R(f'greatest(least(10 * log10(greatest(p, {M})) + 3, 0), -40)', 'clipped')} FROM spec")
def power_to_db(spark, d):
    p = F.col("p")
    return rounded(cells(spark, d).select("rec_id", "t_idx", "f_idx", db.power_to_db(p).alias("db"), db.power_to_db(p, db_range=40, db_gain=3).alias("clipped")))


@q(f"WITH {SIG} SELECT rec_id, i, {R('abs(x)', 'amplitude')}, {R('x * x', 'power')} FROM sig")
def db_roundtrip(spark, d):
    x = F.col("x")
    return rounded(_samples(spark, d).select("rec_id", "i", db.db_to_amplitude(db.amplitude_to_db(x)).alias("amplitude"), db.db_to_power(db.power_to_db(x * x)).alias("power")))


@q(f"WITH {SPEC} SELECT rec_id, f_idx, {R('10 * log10(sum(p))', 'level')} FROM spec WHERE p > 0 GROUP BY 1, 2")
def db_sum(spark, d):
    return rounded(cells(spark, d).where("p > 0").groupBy("rec_id", "f_idx").agg(db.sum_db(db.power_to_db(F.col("p"))).alias("level")))


@q(f"WITH {SPEC} SELECT rec_id, f_idx, {R('10 * log10(avg(p))', 'level')} FROM spec WHERE p > 0 GROUP BY 1, 2")
def db_mean(spark, d):
    return rounded(cells(spark, d).where("p > 0").groupBy("rec_id", "f_idx").agg(db.mean_db(db.power_to_db(F.col("p"))).alias("level")))


@q(f"WITH {SIG} SELECT rec_id, i, {R('x / max(abs(x)) OVER (PARTITION BY rec_id) * 0.7', 'x')}, {R('x * pow(10::DOUBLE, 0.3)', 'louder')} FROM sig")
def gain_normalize(spark, d):
    n = sg.samples(sg.normalise(signals(spark, d))).select("rec_id", "i", "x")
    loud = sg.samples(signals(spark, d)).select("rec_id", "i", db.gain(F.col("x"), 6.0).alias("louder"))
    return rounded(n.join(loud, ["rec_id", "i"]))


@q(f"WITH {SIG} SELECT rec_id, i, {R('(x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w)', 'scaled')} FROM sig WINDOW w AS (PARTITION BY rec_id)")
def minmax_scale(spark, d):
    lo, hi = F.array_min("x"), F.array_max("x")
    ends = F.transform(F.array(F.struct(lo.alias("lo"), hi.alias("hi"))), lambda e: F.transform("x", lambda v: (v - e["lo"]) / F.nullif(e["hi"] - e["lo"], F.lit(0.0))))[0]
    return rounded(signals(spark, d).select("rec_id", F.posexplode(ends).alias("i", "scaled")).withColumn("i", F.col("i").cast("long")))


@q(f"WITH {SIG} SELECT rec_id, i, {R('x / pow(10::DOUBLE, -35 / 20.0::DOUBLE) / pow(10::DOUBLE, 42 / 20.0::DOUBLE)', 'pressure', 9)} FROM sig")
def wave_to_pressure(spark, d):
    return rounded(_samples(spark, d).select("rec_id", "i", db.wave_to_pressure(F.col("x"), 42).alias("pressure")), 9)


@q(f"WITH {SIG} SELECT rec_id, i, {R(f'20 * log10(greatest(abs(x) / pow(10::DOUBLE, -1.75) / pow(10::DOUBLE, 2.1), {M}) / 20e-6)', 'level')} FROM sig")
def wave_to_dbspl(spark, d):
    return rounded(_samples(spark, d).select("rec_id", "i", db.wave_to_dbspl(F.col("x"), 42).alias("level")))


@q(f"WITH {SPEC} SELECT rec_id, t_idx, f_idx, {R(f'20 * log10(greatest(sqrt(p) / pow(10::DOUBLE, -1.75) / pow(10::DOUBLE, 2.1), {M}) / 20e-6)', 'level')} FROM spec")
def power_to_dbspl(spark, d):
    return rounded(cells(spark, d).select("rec_id", "t_idx", "f_idx", db.power_to_dbspl(F.col("p"), 42).alias("level")))


@q(f"WITH {SPEC} SELECT rec_id, t_idx, f_idx, {R(f'10 * log10(greatest(p, {M})) - 10 * log10(count(*) OVER (PARTITION BY rec_id, t_idx))', 'level')} FROM spec")
def dbspl_per_bin(spark, d):
    from pyspark.sql.window import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("rec_id", "t_idx"))
    return rounded(cells(spark, d).select("rec_id", "t_idx", "f_idx", (db.power_to_db(F.col("p")) - 10 * F.log10(n)).alias("level")))


@q("SELECT p_partkey, CAST(pow(2, ceil(log2(p_partkey))) AS BIGINT) AS pow2 FROM part WHERE p_partkey > 0")
def next_power_of_two(spark, d):
    from chirpline.session import table

    return table(spark, d, "part").where("p_partkey > 0").select("p_partkey", db.next_power_of_two(F.col("p_partkey")).alias("pow2"))


@q(f"WITH {GRID} SELECT f, r, {R('1 / r', 'factor')}, {R('-20 * log10(1 / r)', 'db')} FROM grid")
def att_geometric(spark, d):
    one = F.lit(1.0)
    return rounded(pg.grid(spark, FREQS, DISTS).select("f", "r", pg.spreading_factor(F.col("r"), one).alias("factor"), pg.spreading_db(F.col("r"), one).alias("db")))


@q(f"WITH {GRID} SELECT f, r, {R(f'exp(-c / {_C} * (r - 1))', 'factor')}, {R('c * (r - 1)', 'db')} FROM grid")
def att_atmospheric(spark, d):
    f, r, one = F.col("f"), F.col("r"), F.lit(1.0)
    return rounded(pg.grid(spark, FREQS, DISTS).select("f", "r", pg.atmosphere_factor(f, r, one).alias("factor"), pg.atmosphere_db(f, r, one).alias("db")))


@q(f"WITH {GRID} SELECT f, r, {R('exp(-(0.02::DOUBLE * f / 1000) / 20 * log10(exp(1)) * (r - 1))', 'factor')}, {R('0.02::DOUBLE * f / 1000 * (r - 1)', 'db')} FROM grid")
def att_habitat(spark, d):
    f, r, one = F.col("f"), F.col("r"), F.lit(1.0)
    return rounded(pg.grid(spark, FREQS, DISTS).select("f", "r", pg.habitat_factor(f, r, one).alias("factor"), pg.habitat_db(f, r, one).alias("db")))


@q(f"WITH {GRID} SELECT f, r, {R('-20 * log10(1 / r)', 'ageo')}, {R('c * (r - 1)', 'aatm')}, {R('0.02::DOUBLE * f / 1000 * (r - 1)', 'ahab')}, {R('-20 * log10(1 / r) + c * (r - 1) + 0.02::DOUBLE * f / 1000 * (r - 1)', 'asum')} FROM grid")
def att_total_grid(spark, d):
    f, r, one = F.col("f"), F.col("r"), F.lit(1.0)
    return rounded(pg.grid(spark, FREQS, DISTS).select("f", "r", pg.spreading_db(r, one).alias("ageo"), pg.atmosphere_db(f, r, one).alias("aatm"), pg.habitat_db(f, r, one).alias("ahab"), pg.total_db(f, r, one).alias("asum")))


@q(f"WITH {GRID} SELECT f, r, {R(f'0.5::DOUBLE / ({_FACTOR})', 'p0', 4)} FROM grid WHERE r <= 50")
def pressure_at_r0(spark, d):
    g = pg.grid(spark, FREQS, DISTS).where("r <= 50")
    return rounded(g.select("f", "r", pg.pressure_at_r0(F.col("f"), F.col("r"), F.lit(0.5), F.lit(1.0)).alias("p0")), 4)


@q(f"WITH {GRID} SELECT f, r, {R(f'20 * log10(pow(10::DOUBLE, 2.5) * 20e-6 / ({_FACTOR}) / 10e-6)', 'level')} FROM grid")
def dbspl_at_r0(spark, d):
    return rounded(pg.grid(spark, FREQS, DISTS).select("f", "r", pg.dbspl_at_r0(F.col("f"), F.col("r"), F.lit(50.0), F.lit(1.0)).alias("level")))


@q(f"""WITH {AIR}, g AS (SELECT f, r, 80 - (-20 * log10(1 / r::DOUBLE) + c * (r - 1) + 0.02::DOUBLE * f / 1000 * (r - 1)) - 20 AS margin FROM air, (SELECT unnest(range(1, 3000)) AS r))
  SELECT f, CASE WHEN count(*) FILTER (WHERE margin > 0) > 1 THEN CAST(arg_min(r, margin) FILTER (WHERE margin > 0) AS DOUBLE) ELSE 0::DOUBLE END AS distance FROM g GROUP BY f""")
def detection_distance(spark, d):
    levels = pg.grid(spark, FREQS, [1.0]).select("f", F.lit(80.0).alias("level0"), F.lit(20.0).alias("background"))
    return rounded(pg.detection_distance(levels, r_max=3000.0))


@q(f"WITH {SIG} SELECT rec_id, i // 8 AS k, list(round(x, 6) ORDER BY i) AS frame FROM sig WHERE i // 8 < 8 GROUP BY 1, 2")
def frames_tumbling(spark, d):
    return sg.frames(signals(spark, d), NT).select("rec_id", "k", F.transform("frame", lambda v: F.round(v, 6)).alias("frame"))


@q(f"WITH {SIG}, {ENV} SELECT rec_id, k, {R('e', 'e')} FROM env")
def envelope_fast(spark, d):
    return rounded(sg.envelope(signals(spark, d), NT))


@q(f"""WITH {SIG}, pad AS (SELECT * FROM sig UNION ALL SELECT rec_id, 2 * 63 - i, x FROM sig WHERE i BETWEEN 55 AND 62)
  SELECT rec_id, i // 8 AS k, {R('(i // 8 + 0.5::DOUBLE) * 8 / 64', 't')}, {R('avg(x * x)', 'energy')} FROM pad GROUP BY rec_id, i // 8""")
def energy_windowed(spark, d):
    return rounded(sg.energy_windowed(signals(spark, d), FS, NT))


@q(f"WITH {SIG} SELECT rec_id, i - 8 AS i, {R('x', 'x')} FROM sig WHERE i >= 8 AND i < 40")
def trim(spark, d):
    return rounded(sg.samples(sg.trim(signals(spark, d), FS, 0.125, 0.625)).select("rec_id", "i", "x"))


@q(f"""WITH {SIG}, g AS (SELECT rec_id, unnest(range(-4, 80)) AS j FROM (SELECT DISTINCT rec_id FROM sig))
  SELECT g.rec_id, j + 4 AS i, {R('coalesce(x, 0)', 'x')} FROM g LEFT JOIN sig ON sig.rec_id = g.rec_id AND sig.i = j""")
def trim_pad(spark, d):
    return rounded(sg.samples(sg.trim(signals(spark, d), FS, -0.0625, 1.25, pad=True)).select("rec_id", "i", "x"))


@q(f"WITH {SIG}, c AS (SELECT *, lag(x) OVER (PARTITION BY rec_id ORDER BY i) AS before FROM sig) SELECT rec_id, {R('sum(CASE WHEN before IS NOT NULL AND (x > 0) <> (before > 0) THEN 1 ELSE 0 END) / (count(*) / 64::DOUBLE)', 'zcr')} FROM c GROUP BY rec_id")
def zcr(spark, d):
    return rounded(sg.zero_crossing_rate(signals(spark, d), FS))


MOM = "avg(v) AS mean, var_pop(v) AS var, sum(pow(v - m, 3)) / (count(*) - 1) / pow(any_value(s), 3) AS skew, sum(pow(v - m, 4)) / (count(*) - 1) / pow(any_value(s), 4) AS kurt"


def mom(source: str, by: str, v: str) -> str:
    cols = ", ".join(R(c, c, 5) for c in ("mean", "var", "skew", "kurt"))
    return f"SELECT {by}, {cols} FROM (SELECT {by}, {MOM} FROM (SELECT {by}, {v} AS v, avg({v}) OVER (PARTITION BY {by}) AS m, stddev_pop({v}) OVER (PARTITION BY {by}) AS s FROM {source}) GROUP BY {by})"


@q(f"WITH {SIG} " + mom("sig", "rec_id", "x"))
def temporal_moments(spark, d):
    s = _samples(spark, d)
    return rounded(s.groupBy("rec_id").agg(*sg.moments()), 5)


@q(f"WITH {SIG} SELECT rec_id, {R('sqrt(avg(x * x))', 'rms')} FROM sig GROUP BY rec_id")
def rms(spark, d):
    return rounded(_samples(spark, d).groupBy("rec_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")))


LEQ = f"leq AS (SELECT rec_id, i // 16 AS k, 20 * log10(greatest(sqrt(avg(x * x)), {M})) + 35 - 42 + 94 AS leq FROM sig GROUP BY 1, 2)"


@q(f"WITH {SIG}, {LEQ} SELECT rec_id, k, {R('leq', 'leq')} FROM leq")
def leq_periods(spark, d):
    return rounded(sg.leq_periods(signals(spark, d), 16))


@q(f"WITH {SIG}, {LEQ} SELECT rec_id, {R('10 * log10(avg(pow(10::DOUBLE, leq / 10)))', 'leq')} FROM leq GROUP BY rec_id")
def temporal_leq(spark, d):
    return rounded(sg.leq_periods(signals(spark, d), 16).groupBy("rec_id").agg(db.mean_db(F.col("leq")).alias("leq")))


@q(f"WITH {SIG}, p AS (SELECT rec_id, i // 16 AS k, sqrt(avg(x * x)) AS r FROM sig GROUP BY 1, 2) SELECT rec_id, k, {R(f'20 * log10(greatest(r, {M}) / 20e-6)', 'leq')} FROM p")
def pressure_leq(spark, d):
    square = F.aggregate(F.transform("frame", lambda v: v * v), F.lit(0.0), lambda a, v: a + v) / 16
    return rounded(sg.frames(signals(spark, d), 16).select("rec_id", "k", db.pressure_to_dbspl(F.sqrt(square)).alias("leq")))


SNR = f"snr AS (SELECT rec_id, 10 * log10(avg(pow(10::DOUBLE, level / 10))) AS enr, quantile_cont(level, 0.5) AS bgn FROM lev GROUP BY rec_id)"


@q(f"WITH {SIG}, {ENV}, {LEV}, {SNR} SELECT rec_id, {R('enr', 'enr')}, {R('bgn', 'bgn')}, {R('enr - bgn', 'snr')} FROM snr")
def temporal_snr(spark, d):
    return rounded(sg.temporal_snr(sg.envelope(signals(spark, d), NT)))


@q(f"WITH {SIG}, {ENV} SELECT rec_id, {R('quantile_cont(e, 0.5)', 'med')} FROM env GROUP BY rec_id")
def temporal_median(spark, d):
    return rounded(sg.envelope(signals(spark, d), NT).groupBy("rec_id").agg(sg.median("e").alias("med")))


ENT = f"SELECT rec_id, -sum(greatest(v / s, {M}) * ln(greatest(v / s, {M}))) / ln(count(*)) AS h FROM (SELECT rec_id, e * e AS v, sum(e * e) OVER (PARTITION BY rec_id) AS s FROM env) GROUP BY rec_id"


@q(f"WITH {SIG}, {ENV} SELECT rec_id, {R('h', 'h')} FROM ({ENT})")
def temporal_entropy(spark, d):
    env = sg.envelope(signals(spark, d), NT).withColumn("v", F.col("e") * F.col("e"))
    return rounded(env.groupBy("rec_id").agg(sg.entropy("v").alias("h")))


ACT = f"act AS (SELECT rec_id, avg(CASE WHEN above >= 3 THEN 1 ELSE 0 END) AS fraction, sum(CASE WHEN above >= 3 THEN 1 ELSE 0 END)::BIGINT AS n_active, coalesce(10 * log10(avg(pow(10::DOUBLE, above / 10)) FILTER (WHERE above > 3)), 0) AS mean_active FROM lev GROUP BY rec_id)"


@q(f"WITH {SIG}, {ENV}, {LEV}, {ACT} SELECT rec_id, {R('fraction', 'fraction')}, n_active, {R('mean_active', 'mean_active')} FROM act")
def temporal_activity(spark, d):
    return rounded(sg.temporal_activity(sg.envelope(signals(spark, d), NT)))


def evn(source: str, by: str, order: str, cond: str, dt: float, least: int) -> str:
    return f"""evn AS (SELECT {by}, sum(CASE WHEN value AND len >= {least} THEN len ELSE 0 END) / sum(len) AS fraction,
      coalesce(sum(CASE WHEN value AND len >= {least} THEN len ELSE 0 END) * {dt} / nullif(sum(CASE WHEN value AND len >= {least} THEN 1 ELSE 0 END), 0), 0) AS mean_s,
      coalesce(sum(CASE WHEN value AND len >= {least} THEN 1 ELSE 0 END) / nullif((sum(len) - 1) * {dt}, 0), 0) AS per_s,
      CAST(sum(CASE WHEN value AND len >= {least} THEN 1 ELSE 0 END) AS BIGINT) AS n_events
    FROM (SELECT {by}, run, any_value(value) AS value, count(*) AS len FROM (
      SELECT *, sum(edge) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN value <> lag(value) OVER (PARTITION BY {by} ORDER BY {order}) THEN 1 ELSE 0 END AS edge FROM (SELECT *, {cond} AS value FROM {source}))) GROUP BY {by}, run) GROUP BY {by})"""


@q(f"WITH {SIG}, {ENV}, {LEV}, {evn('lev', 'rec_id', 'k', 'above >= 3', 0.125, 1)} SELECT rec_id, {R('fraction', 'fraction')}, {R('mean_s', 'mean_s')}, {R('per_s', 'per_s')}, n_events FROM evn")
def temporal_events(spark, d):
    env = sg.background_levels(sg.envelope(signals(spark, d), NT))
    return rounded(sg.events(env, ["rec_id"], "k", F.col("above"), NT / FS, 3.0, 0.01))


@q(f"""WITH {SIG}, {ENV}, f AS (SELECT a.rec_id, round(h, 1) AS ht, m FROM ({ENT}) a JOIN (SELECT rec_id, round(quantile_cont(e, 0.5), 1) AS m FROM env GROUP BY rec_id) b USING (rec_id)),
  r AS (SELECT *, rank() OVER (ORDER BY ht) + (count(*) OVER (PARTITION BY ht) - 1) / 2::DOUBLE AS a, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2::DOUBLE AS b, count(*) OVER () AS n FROM f)
  SELECT rec_id, {R('a * b / (n::DOUBLE * n)', 'ari')} FROM r""")
def acoustic_richness(spark, d):
    env = sg.envelope(signals(spark, d), NT).withColumn("v", F.col("e") * F.col("e"))
    f = env.groupBy("rec_id").agg(F.round(sg.entropy("v"), 1).alias("ht"), F.round(sg.median("e"), 1).alias("m"))
    return rounded(sg.acoustic_richness(f))


QT = """qt AS (SELECT *, round(sum(e * e) OVER (PARTITION BY rec_id ORDER BY k ROWS UNBOUNDED PRECEDING) / sum(e * e) OVER (PARTITION BY rec_id), 12) AS share FROM env)"""


@q(f"WITH {SIG}, {ENV}, {QT} SELECT rec_id, " + ", ".join(f"min(k * 0.125::DOUBLE) FILTER (WHERE share >= {x}) AS q{i + 1}" for i, x in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))) + " FROM qt GROUP BY rec_id")
def temporal_quantile(spark, d):
    return _time_quantiles(spark, d)


def _time_quantiles(spark, d):
    env = sg.envelope(signals(spark, d), NT).withColumn("v", F.col("e") * F.col("e")).withColumn("t", F.col("k") * (NT / FS))
    return sg.quantile_positions(env, ["rec_id"], "k", "t", "v", [0.05, 0.25, 0.5, 0.75, 0.95])


@q(f"WITH {SIG}, {ENV}, {QT}, z AS (SELECT rec_id, " + ", ".join(f"min(k * 0.125::DOUBLE) FILTER (WHERE share >= {x}) AS q{i}" for i, x in enumerate((0.05, 0.25, 0.75, 0.95))) + f" FROM qt GROUP BY rec_id) SELECT rec_id, {R('q2 - q1', 'duration_50')}, {R('q3 - q0', 'duration_90')} FROM z")
def temporal_duration(spark, d):
    t = _time_quantiles(spark, d)
    return rounded(t.select("rec_id", (F.col("q4") - F.col("q2")).alias("duration_50"), (F.col("q5") - F.col("q1")).alias("duration_90")))


@q(f"""WITH {SIG}, {ENV}, {LEV}, {SNR}, {LEQ}, {ACT}, {evn('lev', 'rec_id', 'k', 'above >= 3', 0.125, 1)},
  z AS (SELECT rec_id, sum(CASE WHEN b IS NOT NULL AND (x > 0) <> (b > 0) THEN 1 ELSE 0 END) / (count(*) / 64::DOUBLE) AS zcr FROM (SELECT *, lag(x) OVER (PARTITION BY rec_id ORDER BY i) AS b FROM sig) GROUP BY rec_id),
  m AS ({mom("sig", "rec_id", "x")}), l AS (SELECT rec_id, 10 * log10(avg(pow(10::DOUBLE, leq / 10))) AS leq FROM leq GROUP BY rec_id),
  md AS (SELECT rec_id, quantile_cont(e, 0.5) AS med FROM env GROUP BY rec_id), h AS ({ENT})
  SELECT rec_id, {R('zcr', 'ZCR', 5)}, mean AS MEANt, var AS VARt, skew AS SKEWt, kurt AS KURTt, {R('leq', 'LEQt', 5)}, {R('bgn', 'BGNt', 5)}, {R('enr - bgn', 'SNRt', 5)}, {R('med', 'MED', 5)}, {R('h', 'Ht', 5)},
    {R('act.fraction', 'ACTtFraction', 5)}, n_active AS ACTtCount, {R('mean_active', 'ACTtMean', 5)}, {R('evn.fraction', 'EVNtFraction', 5)}, {R('mean_s', 'EVNtMean', 5)}, {R('per_s', 'EVNtCount', 5)}
  FROM z JOIN m USING (rec_id) JOIN l USING (rec_id) JOIN snr USING (rec_id) JOIN md USING (rec_id) JOIN h USING (rec_id) JOIN act USING (rec_id) JOIN evn USING (rec_id)""")
def all_temporal(spark, d):
    return rounded(sg.all_temporal(signals(spark, d), FS, NT, 16), 5)


@q(f"""WITH {EV}, o AS (SELECT unnest(range(-3, 4)) AS o), n AS (SELECT rec_id, max(i) AS m FROM ev GROUP BY rec_id)
  SELECT a.rec_id, a.i, {R('avg(b.x)', 'smooth', 4)} FROM ev a JOIN n USING (rec_id), o JOIN ev b ON b.rec_id = a.rec_id AND b.i = greatest(0, least(m, a.i + o)) GROUP BY 1, 2""")
def running_mean_edge(spark, d):
    return rounded(sg.running_mean(event_series(spark, d), ["rec_id"], "i", "x", 7).select("rec_id", "i", "smooth"), 4)


@q(f"""WITH {EV}, e AS (SELECT *, x >= 250 AS v, CASE WHEN (x >= 250) <> lag(x >= 250) OVER (PARTITION BY rec_id ORDER BY i) THEN 1 ELSE 0 END AS edge FROM ev),
  r AS (SELECT *, CAST(sum(edge) OVER (PARTITION BY rec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM e)
  SELECT rec_id, run, any_value(v) AS value, min(i) AS start, count(*) AS length FROM r GROUP BY 1, 2""")
def rle_runs(spark, d):
    return sg.islands(event_series(spark, d), ["rec_id"], "i", F.col("x") >= 250)


@q(f"WITH {EV}, {evn('ev', 'rec_id', 'i', 'x >= 250', 1.0, 3)} SELECT rec_id, {R('fraction', 'fraction')}, {R('mean_s', 'mean_s')}, {R('per_s', 'per_s')}, n_events FROM evn")
def events_islands(spark, d):
    return rounded(sg.events(event_series(spark, d), ["rec_id"], "i", F.col("x"), 1.0, 250.0, 2.0))


@q(f"""WITH {SIG}, s AS (SELECT rec_id % 10 AS grp, rec_id // 10 AS ord, i AS j, x AS v FROM sig),
  f AS (SELECT *, (ord - min(ord) OVER (PARTITION BY grp)) * 48 AS s, ord = min(ord) OVER (PARTITION BY grp) AS fst, ord = max(ord) OVER (PARTITION BY grp) AS lst FROM s),
  e AS (SELECT grp, s, lst, j AS p, v AS x FROM f WHERE fst UNION ALL SELECT grp, s, lst, s + j, v * sqrt(j / 16::DOUBLE) FROM f WHERE NOT fst AND j < 16
        UNION ALL SELECT grp, s, lst, s + j + 1, v FROM f WHERE NOT fst AND j BETWEEN 15 AND 62),
  o AS (SELECT grp, p, x FROM e WHERE lst OR p <= s + 47 UNION ALL SELECT grp, p + 1, x * sqrt((15 - (p - s - 47)) / 16::DOUBLE) FROM e WHERE NOT lst AND p BETWEEN s + 47 AND s + 62)
  SELECT grp, p AS i, {R('sum(x)', 'x')} FROM o GROUP BY 1, 2""")
def crossfade_chain(spark, d):
    s = signals(spark, d).select((F.col("rec_id") % 10).alias("grp"), F.floor(F.col("rec_id") / 10).alias("ord"), "x")
    return rounded(sg.crossfade_chain(s, FS, 0.25))

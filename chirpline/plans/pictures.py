"""Queries with kernels and windows on spectrograms as images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chirpline.functions import kernels as kn
from chirpline.functions import propagation as pg
from chirpline.operators import images as im
from chirpline.operators import signal as sg
from chirpline.operators import spectral as sp
from chirpline.plans.registry import DF, DT, EV, FS, M, SIG, SPEC, R, Registry, cells, event_series, rounded, signals
from chirpline.plans.spectral import G, S, _smooth
from chirpline.session import table

q = Registry()
QUERIES, ORACLES = q.queries, q.sql


def frames(spark, d):
    """The spectrogram as one row per frame: (rec_id, t_idx, v)."""
    e = table(spark, d, "embeddings").withColumn("t_idx", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")) * (1 + F.col("vec_id") % 7))
    return e.select(F.col("label").cast("long").alias("rec_id"), "t_idx", v.alias("v"))


def boxes(spark, d):
    """Three fixed boxes in each recording."""
    c = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("rec_id")).distinct()
    b = c.select("rec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("roi_id"))
    return b.select("rec_id", "roi_id", (F.col("roi_id") * 15 + 2).alias("min_y"), (F.col("roi_id") * 15 + 9 + F.col("rec_id") % 5).alias("max_y"), (F.col("roi_id") * 10 + F.col("rec_id") % 3).alias("min_x"), (F.col("roi_id") * 10 + 12).alias("max_x"))


BOX = "box AS (SELECT rec_id, k AS roi_id, k * 15 + 2 AS min_y, k * 15 + 9 + rec_id % 5 AS max_y, k * 10 + rec_id % 3 AS min_x, k * 10 + 12 AS max_x FROM (SELECT DISTINCT rec_id FROM spec), (SELECT unnest(range(0, 3)) AS k))"


@q(f"""WITH {SIG}, fr AS (SELECT rec_id, t, i - t * 8 AS n, x FROM sig, (SELECT unnest(range(0, 7)) AS t) WHERE i BETWEEN t * 8 AND t * 8 + 15),
  w AS (SELECT *, (x - avg(x) OVER (PARTITION BY rec_id, t)) * (0.5 - 0.5 * cos(2 * pi() * n / 16)) AS y FROM fr),
  dft AS (SELECT rec_id, t, k, sum(y * cos(2 * pi() * k * n / 16)) AS re, sum(y * sin(2 * pi() * k * n / 16)) AS im FROM w, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1, 2, 3)
  SELECT rec_id, t AS t_idx, k AS f_idx, {R('(re * re + im * im) * 2 / (16 * 6)', 'p')} FROM dft""")
def stft_dft_join(spark, d):
    return rounded(im.as_cells(im.stft(signals(spark, d), 16)))


@q(f"""WITH {SIG}, fr AS (SELECT rec_id, t, i - t * 8 AS n, x FROM sig, (SELECT unnest(range(0, 7)) AS t) WHERE i BETWEEN t * 8 AND t * 8 + 15),
  w AS (SELECT *, (x - avg(x) OVER (PARTITION BY rec_id, t)) * (0.5 - 0.5 * cos(2 * pi() * n / 16)) AS y FROM fr),
  dft AS (SELECT rec_id, t, k, sum(y * cos(2 * pi() * k * n / 16)) AS re, sum(y * sin(2 * pi() * k * n / 16)) AS im FROM w, (SELECT unnest(range(0, 9)) AS k) GROUP BY 1, 2, 3)
  SELECT rec_id, k AS f_idx, {R('avg(re * re + im * im) / 64 * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END', 'p', 8)} FROM dft GROUP BY 1, 2""")
def welch_dft_join(spark, d):
    w = im.map_arrays(signals(spark, d), lambda x: kn.welch(x, FS, 16)[0])
    return rounded(w.select("rec_id", F.posexplode("x").alias("f_idx", "p")).withColumn("f_idx", F.col("f_idx").cast("long")), 8)


@q(f"""WITH {SIG}, o AS (SELECT * FROM (VALUES (-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1)) AS v(o, w))
  SELECT a.rec_id, a.i, {R('sum(b.x * w) / 9', 'x')} FROM sig a, o JOIN sig b ON b.rec_id = a.rec_id AND b.i = CASE WHEN a.i + o < 0 THEN -1 - a.i - o WHEN a.i + o > 63 THEN 127 - a.i - o ELSE a.i + o END GROUP BY 1, 2""")
def fir_smooth(spark, d):
    y = im.map_arrays(signals(spark, d), lambda x: kn.mirrored_fir(x, np.array([1.0, 2, 3, 2, 1])))
    return rounded(sg.samples(y).select("rec_id", "i", "x"))


_K = kn.gaussian_kernel(1.0)


@q(f"""WITH {SPEC}, k AS (SELECT * FROM (VALUES {', '.join(f'({o - len(_K) // 2}, {w!r}::DOUBLE)' for o, w in enumerate(_K.tolist()))}) AS v(o, w)), n AS (SELECT rec_id, max(t_idx) AS m FROM spec GROUP BY 1),
  a AS (SELECT x.rec_id, x.t_idx, x.f_idx, sum(y.p * w) AS g FROM spec x JOIN n USING (rec_id), k JOIN spec y ON y.rec_id = x.rec_id AND y.f_idx = x.f_idx AND y.t_idx = greatest(0, least(m, x.t_idx + o)) GROUP BY 1, 2, 3)
  SELECT x.rec_id, x.t_idx, x.f_idx, {R('sum(y.g * w)', 'smooth')} FROM a x, k JOIN a y ON y.rec_id = x.rec_id AND y.t_idx = x.t_idx AND y.f_idx = greatest(0, least(63, x.f_idx + o)) GROUP BY 1, 2, 3""")
def gaussian_smooth_2d(spark, d):
    return rounded(im.gaussian_smooth(cells(spark, d)))


@q(f"""WITH {SPEC}, m AS (SELECT x.rec_id, x.f_idx, x.t_idx, any_value(x.p) AS p, sum(y.p * 0.025 * pow(0.975::DOUBLE, x.t_idx - y.t_idx)) AS m FROM spec x JOIN spec y ON y.rec_id = x.rec_id AND y.f_idx = x.f_idx AND y.t_idx <= x.t_idx GROUP BY 1, 2, 3)
  SELECT rec_id, f_idx, t_idx, {R('sqrt(p * pow(m + 1e-6::DOUBLE, -0.98::DOUBLE) + 2) - sqrt(2)', 'out')} FROM m""")
def pcen_fold(spark, d):
    power = frames(spark, d).withColumn("v", F.transform("v", lambda a: a * a))
    out = im.pcen(power).select("rec_id", "t_idx", F.posexplode("out").alias("f_idx", "out"))
    return rounded(out.withColumn("f_idx", F.col("f_idx").cast("long")))


@q(f"{S} SELECT rec_id, f_idx, {R('quantile_cont(p, 0.5)', 'raw')} FROM spec GROUP BY 1, 2")
def unimode_median(spark, d):
    return rounded(sp.unimode(cells(spark, d), ["rec_id", "f_idx"], "p"))


@q(f"""WITH {SPEC}, e AS (SELECT *, min(p) OVER w AS lo, max(p) OVER w AS hi FROM spec WINDOW w AS (PARTITION BY rec_id, f_idx)),
  h AS (SELECT rec_id, f_idx, lo, hi, least(CAST(floor((p - lo) / (hi - lo) * 20) AS INT), 19) AS b, count(*) AS c FROM e GROUP BY ALL),
  g AS (SELECT r.*, coalesce(c, 0) AS c FROM (SELECT *, unnest(range(0, 20)) AS b FROM (SELECT DISTINCT rec_id, f_idx, lo, hi FROM e)) r LEFT JOIN h USING (rec_id, f_idx, b)),
  s AS (SELECT x.rec_id, x.f_idx, x.lo, x.hi, x.b, round(avg(y.c), 9) AS s FROM g x, (SELECT unnest(range(-3, 4)) AS o) JOIN g y ON y.rec_id = x.rec_id AND y.f_idx = x.f_idx AND y.b = greatest(0, least(19, x.b + o)) GROUP BY ALL)
  SELECT rec_id, f_idx, {R('arg_max(lo + b * (hi - lo) / 20, (s, -b))', 'raw')} FROM s GROUP BY 1, 2""")
def unimode_hist(spark, d):
    return rounded(sp.unimode(cells(spark, d), ["rec_id", "f_idx"], "p", "ale", 20))


@q(f"WITH {SPEC}, n0 AS (SELECT rec_id, f_idx, quantile_cont(p, 0.5) AS raw FROM spec GROUP BY 1, 2), n1 AS {_smooth('n0', 'raw', 25, 'noise')} SELECT rec_id, t_idx, f_idx, {R('greatest(p - noise, 0)', 'out')} FROM spec JOIN n1 USING (rec_id, f_idx)")
def bg_subtract_axis(spark, d):
    return rounded(im.subtract_background(cells(spark, d)))


@q(f"""WITH {SPEC}, n0 AS (SELECT rec_id, t_idx, quantile_cont(p, 0.5) AS raw FROM spec GROUP BY 1, 2), m AS (SELECT rec_id, max(t_idx) AS m FROM spec GROUP BY 1),
  n1 AS (SELECT x.rec_id, x.t_idx, avg(y.raw) AS noise FROM n0 x JOIN m USING (rec_id), (SELECT unnest(range(-2, 3)) AS o) JOIN n0 y ON y.rec_id = x.rec_id AND y.t_idx = greatest(0, least(m, x.t_idx + o)) GROUP BY 1, 2)
  SELECT rec_id, t_idx, f_idx, {R('greatest(p - noise, 0)', 'out')} FROM spec JOIN n1 USING (rec_id, t_idx)""")
def rain_subtract(spark, d):
    return rounded(im.subtract_background(cells(spark, d), 5, axis="t_idx"))


@q(f"""WITH {SPEC}, m AS (SELECT *, max(t_idx) OVER (PARTITION BY rec_id) AS tm, max(p) OVER (PARTITION BY rec_id, f_idx ORDER BY t_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m1 FROM spec),
  n AS (SELECT *, max(m1) OVER (PARTITION BY rec_id, t_idx ORDER BY f_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m2 FROM m)
  SELECT rec_id, t_idx, f_idx, {R('p', 'p')} FROM n WHERE p = m2 AND p > 0.1 AND t_idx BETWEEN 1 AND tm - 1 AND f_idx BETWEEN 1 AND 62""")
def local_max_2d(spark, d):
    return rounded(im.local_max(cells(spark, d), 0.1, value="p"))


@q(f"WITH {SPEC}, {BOX} SELECT DISTINCT s.rec_id, t_idx, f_idx FROM spec s JOIN box b ON b.rec_id = s.rec_id AND t_idx BETWEEN min_x AND max_x AND f_idx BETWEEN min_y AND max_y")
def roi_paint_semi_join(spark, d):
    return im.paint(cells(spark, d), boxes(spark, d))


@q(f"WITH {SPEC}, {BOX} SELECT s.rec_id, roi_id, {R('sum(p * f_idx) / sum(p)', 'centroid_y')}, {R('sum(p * t_idx) / sum(p)', 'centroid_x')}, max_x - min_x AS duration_x, max_y - min_y AS bandwidth_y, (max_x - min_x) * (max_y - min_y) AS area_xy FROM spec s JOIN box b ON b.rec_id = s.rec_id AND t_idx BETWEEN min_x AND max_x AND f_idx BETWEEN min_y AND max_y GROUP BY s.rec_id, roi_id, min_x, max_x, min_y, max_y")
def roi_centroid(spark, d):
    return rounded(im.box_centroids(cells(spark, d), boxes(spark, d)))


@q("""WITH p AS (SELECT rec_id, roi_id, label, CAST(ceil(round(least(greatest(min_f, 0), 15750) / 250 - 0.5, 9)) AS BIGINT) AS min_y, CAST(ceil(round(greatest(min_t, 0) / 0.25 - 0.5, 9)) AS BIGINT) AS min_x,
    CAST(ceil(round(least(greatest(max_f, 0), 15750) / 250 - 0.5, 9)) AS BIGINT) AS max_y, CAST(ceil(round(greatest(max_t, 0) / 0.25 - 0.5, 9)) AS BIGINT) AS max_x FROM roi WHERE min_t IS NOT NULL AND max_t IS NOT NULL AND min_f IS NOT NULL AND max_f IS NOT NULL)
  SELECT *, min_y * CAST(250 AS DOUBLE) AS min_f, min_x * CAST(0.25 AS DOUBLE) AS min_t, max_y * CAST(250 AS DOUBLE) AS max_f, max_x * CAST(0.25 AS DOUBLE) AS max_t FROM p WHERE min_y <= max_y AND min_x <= max_x""")
def roi_unit_conversion(spark, d):
    """On axes as long as the recordings' ROIs."""
    return im.to_pixels(table(spark, d, "roi"), G, None)


def hysteresis_sql(source: str, high: float, low: float, name: str = "m", v: str = "v") -> str:
    """CTEs: {name} holds the cells of the components of v > low that hold one of v > high, with the smallest cell of the component as roi. Needs WITH RECURSIVE."""
    return f"""{name}0 AS (SELECT rec_id, t_idx, f_idx, {v} AS v, t_idx * 4096 + f_idx AS l FROM {source} WHERE {v} > {low}),
  {name}1 AS (SELECT rec_id, t_idx, f_idx, l FROM {name}0 UNION SELECT n.rec_id, n.t_idx, n.f_idx, c.l FROM {name}1 c JOIN {name}0 n ON n.rec_id = c.rec_id AND n.t_idx BETWEEN c.t_idx - 1 AND c.t_idx + 1 AND n.f_idx BETWEEN c.f_idx - 1 AND c.f_idx + 1),
  {name}2 AS (SELECT rec_id, t_idx, f_idx, min(l) AS roi FROM {name}1 GROUP BY 1, 2, 3),
  {name} AS (SELECT * FROM (SELECT *, max(v) OVER (PARTITION BY rec_id, roi) AS top FROM {name}2 JOIN {name}0 USING (rec_id, t_idx, f_idx)) WHERE top > {high})"""


BOXES = """bx AS (SELECT rec_id, roi, min(f_idx) AS min_y, min(t_idx) AS min_x, max(f_idx) AS max_y, max(t_idx) AS max_x, count(*) AS area, sum(v * f_idx) / sum(v) AS centroid_y, sum(v * t_idx) / sum(v) AS centroid_x FROM m GROUP BY 1, 2)"""
# ROIs at or below 50 Hz are erased with their cells; one cell is 250 Hz by 0.25 s
ROI_OK = """ok AS (SELECT *, min_y <= 1 AS erased, (max_x - min_x) * 0.25 >= 0.025 AND (max_y - min_y) * 250 >= 50 AS ok, (max_y - min_y) < 10 * (max_x - min_x) AS narrow FROM bx WHERE area >= 1.25),
  ex AS (SELECT rec_id, count(DISTINCT t_idx) AS nf FROM spec GROUP BY 1)"""
ROI_SELECT = f"SELECT ex.rec_id, {R('count(*) FILTER (WHERE ok AND NOT erased AND narrow) / ((any_value(nf) - 1) * 0.25 / 60)', 'n_roi', 6)}, {R('coalesce(sum(area) FILTER (WHERE NOT (ok AND erased)), 0) / (any_value(nf) * 64) * 100', 'a_roi', 6)} FROM ex LEFT JOIN ok USING (rec_id) GROUP BY 1"
ROI_INDEX = f"{ROI_OK} {ROI_SELECT}"


def _mask(spark, d):
    return im.hysteresis_cells(frames(spark, d), 2.0, 0.9)


@q(f"WITH RECURSIVE {SPEC}, {hysteresis_sql('spec', 2.0, 0.9, v='a')} SELECT rec_id, t_idx, f_idx FROM m")
def mask_hysteresis(spark, d):
    return _mask(spark, d).select("rec_id", "t_idx", "f_idx")


@q(f"WITH RECURSIVE {SPEC}, {hysteresis_sql('spec', 2.0, 0.9, v='a')}, {BOXES} SELECT rec_id, min_y, min_x, max_y, max_x, area, {R('centroid_y', 'centroid_y')}, {R('centroid_x', 'centroid_x')} FROM bx")
def components_bbox(spark, d):
    return rounded(im.roi_boxes(_mask(spark, d)).drop("roi"))


@q(f"WITH RECURSIVE {SPEC}, {hysteresis_sql('spec', 2.0, 0.9, v='a')}, {BOXES}, {ROI_INDEX.replace(' WHERE area >= 1.25', '')}")
def roi_index(spark, d):
    ext = frames(spark, d).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_frames"), F.max(F.size("v")).alias("n_bins"))
    return rounded(im.roi_index(im.roi_boxes(_mask(spark, d)), ext, DF, DT))


def _template() -> np.ndarray:
    y, x = np.mgrid[0:64, 0:5]
    return np.exp(-((y - 20) ** 2) / 50 - (x - 2) ** 2)


# frames beyond the ends repeat the edge; the score of a frame is the correlation of the five frames around it
@q(f"""WITH {SPEC}, e AS (SELECT rec_id, max(t_idx) AS last FROM spec GROUP BY 1), t AS (SELECT y, x, v - avg(v) OVER () AS v FROM (SELECT y, x, exp(-pow(y - 20, 2) / 50 - pow(x - 2, 2)) AS v FROM (SELECT unnest(range(0, 64)) AS y), (SELECT unnest(range(0, 5)) AS x))),
  n AS (SELECT sqrt(sum(v * v)) AS norm FROM t), w AS (SELECT c.rec_id, c.t_idx, sum(s.a * t.v) AS cross_, sum(s.a * s.a) - pow(sum(s.a), 2) / 320 AS variance
    FROM (SELECT DISTINCT rec_id, t_idx, last FROM spec JOIN e USING (rec_id)) c, t JOIN spec s ON s.rec_id = c.rec_id AND s.t_idx = greatest(0, least(c.last, c.t_idx + t.x - 2)) AND s.f_idx = t.y GROUP BY 1, 2),
  z AS (SELECT rec_id, t_idx, cross_ / (sqrt(variance) * norm) AS score FROM w, n), p AS (SELECT *, lag(score) OVER k AS l, lead(score) OVER k AS r FROM z WINDOW k AS (PARTITION BY rec_id ORDER BY t_idx))
  SELECT rec_id, t_idx * 0.25::DOUBLE AS peak_time, {R('score', 'xcorrcoef')}, greatest(t_idx * 0.25::DOUBLE - 0.625, 0) AS min_t, least(t_idx * 0.25::DOUBLE + 0.625, last * 0.25::DOUBLE) AS max_t FROM p JOIN e USING (rec_id) WHERE score > l AND score > r AND score >= 0.15""")
def template_ncc(spark, d):
    return rounded(im.template_matches(frames(spark, d), _template(), DT, 0.15))


# erosion and dilation of the mean spectrum with a window of 50 bins, mirrored at the ends
@q(f"""WITH {SPEC}, f AS (SELECT rec_id, f_idx AS i, avg(a) AS m FROM spec GROUP BY 1, 2), g AS (SELECT o, exp(-0.5 * pow((o - 24.5) / 25, 2)) AS g FROM (SELECT unnest(range(0, 50)) AS o)),
  e AS (SELECT f.rec_id, f.i, min(b.m - g) AS m FROM f, g JOIN f b ON b.rec_id = f.rec_id AND b.i = CASE WHEN f.i + o - 25 < 0 THEN 24 - f.i - o WHEN f.i + o - 25 > 63 THEN 152 - f.i - o ELSE f.i + o - 25 END GROUP BY 1, 2),
  n AS (SELECT e.rec_id, e.i, max(b.m + g) AS m FROM e, g JOIN e b ON b.rec_id = e.rec_id AND b.i = CASE WHEN e.i + 25 - o < 0 THEN o - 26 - e.i WHEN e.i + 25 - o > 63 THEN 102 - e.i + o ELSE e.i + 25 - o END GROUP BY 1, 2),
  z AS (SELECT n.rec_id, n.i AS f_idx, CASE WHEN n.i IN (0, 1, 62, 63) THEN f.m ELSE n.m END AS noise FROM n JOIN f USING (rec_id, i))
  SELECT rec_id, t_idx, f_idx, {R('(1 - 1 / (greatest(a / noise, 0) + 1)) * a', 'v')} FROM spec JOIN z USING (rec_id, f_idx)""")
def bg_opening(spark, d):
    return rounded(im.as_cells(im.remove_background(frames(spark, d))).withColumnRenamed("p", "v"))


# each step takes the largest neighbour, cut to the picture, until nothing changes
@q(f"""WITH RECURSIVE {SPEC}, s AS (SELECT rec_id, t_idx, f_idx, a, a - quantile_cont(a, 0.1) OVER (PARTITION BY rec_id) AS v FROM spec),
  r AS (SELECT 0 AS it, rec_id, t_idx, f_idx, a, v, true AS changed FROM s UNION ALL
    SELECT it + 1, rec_id, t_idx, f_idx, a, w, bool_or(w <> v) OVER () FROM (SELECT *, least(a, max(m) OVER (PARTITION BY rec_id, t_idx ORDER BY f_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS w
      FROM (SELECT *, max(v) OVER (PARTITION BY rec_id, f_idx ORDER BY t_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM r WHERE changed)))
  SELECT rec_id, t_idx, f_idx, {R('greatest(a - v, 0)', 'v')} FROM r WHERE it = (SELECT max(it) FROM r)""")
def bg_morpho(spark, d):
    return rounded(im.as_cells(im.remove_background_morpho(frames(spark, d))).withColumnRenamed("p", "v"))


@q("""SELECT 'shp_' || lpad(CAST(k * 4 + t * 2 + f + 1 AS VARCHAR), 3, '0') AS shp, t * pi() / 2 AS theta, CASE f WHEN 0 THEN 0.35 ELSE 0.5 END::DOUBLE AS freq, CAST(k + 1 AS INTEGER) AS pyr_level, pow(2::DOUBLE, k) / CASE f WHEN 0 THEN 0.35 ELSE 0.5 END::DOUBLE AS scale
  FROM (SELECT unnest(range(0, 4)) AS k), (SELECT unnest(range(0, 2)) AS t), (SELECT unnest(range(0, 2)) AS f)""")
def shape_parameters(spark, d):
    return im.shape_params(spark)


def _zoom_sql(source: str, out: str, rows: str, columns: str, keys: str = "") -> str:
    """A CTE with bilinear resizing of pictures (rec_id, y, x, v) of h by w to rows by columns, pixel centres aligned; first over y, then over x."""
    k = f"{keys}, " if keys else ""

    def axis(src: str, name: str, a: str, other: str, old: str, new: str) -> str:
        at = f"greatest(0, least({old} - 1, (g.i + 0.5) * {old} / {new} - 0.5))"
        return f"""{name} AS MATERIALIZED (SELECT s.rec_id, {k}g.i AS {a}, s.{other}, any_value(s.h) AS h, any_value(s.w) AS w, any_value(s.big) AS big, sum(s.v * CASE WHEN s.{a} = g.lo THEN 1 - g.p ELSE 0 END + s.v * CASE WHEN s.{a} = least(g.lo + 1, g.old - 1) THEN g.p ELSE 0 END) AS v
          FROM (SELECT rec_id, i, old, lo, at_ - lo AS p FROM (SELECT rec_id, i, old, at_, least(CAST(floor(at_) AS BIGINT), greatest(old - 2, 0)) AS lo FROM (SELECT g.rec_id, g.i, {old} AS old, {at} AS at_ FROM (SELECT rec_id, h, w, big, unnest(range(0, CAST({new} AS BIGINT))) AS i FROM (SELECT DISTINCT rec_id, h, w, big FROM {src})) g))) g
          JOIN {src} s ON s.rec_id = g.rec_id AND s.{a} BETWEEN g.lo AND least(g.lo + 1, g.old - 1) GROUP BY s.rec_id, {k}g.i, s.{other})"""

    return f"{axis(source, out + 'y', 'y', 'x', 'h', rows)}, {axis(out + 'y', out, 'x', 'y', 'w', columns)}"


def shape_sql(preset: str | dict) -> str:
    """CTEs that end with resp (rec_id, shp, y, x, v), the responses of all filters at every cell."""
    filters = kn.bank(preset)
    blur = kn.gaussian_kernel(2 / 3).tolist()
    sym = lambda j, n: f"CASE WHEN {j} < 0 THEN -1 - ({j}) WHEN {j} >= {n} THEN 2 * {n} - 1 - ({j}) ELSE {j} END"
    taps = "(VALUES " + ", ".join(f"({o - len(blur) // 2}, {b!r}::DOUBLE)" for o, b in enumerate(blur)) + ") AS b(o, g)"
    kernels = "(VALUES " + ", ".join(
        f"({f}, {h - 1 - r - h // 2}, {w - 1 - c - w // 2}, {k.real[r, c]!r}::DOUBLE, {k.imag[r, c]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for f, (_, _, k) in enumerate(filters) for h, w in [k.shape] for r in range(h) for c in range(w)
    ) + ") AS kr(f, dy, dx, re, im)"
    parts = ["im0 AS MATERIALIZED (SELECT rec_id, f_idx AS y, t_idx AS x, a AS v, 64 AS h, max(t_idx) OVER (PARTITION BY rec_id) + 1 AS w, max(t_idx) OVER (PARTITION BY rec_id) + 1 AS big FROM spec)", f"kr AS MATERIALIZED (SELECT * FROM {kernels})"]
    ends = []
    for k in range(kn.shape_options(preset)["npyr"]):
        if k:
            p = f"im{k - 1}"
            parts.append(f"ba{k} AS MATERIALIZED (SELECT s.rec_id, s.y, s.x, any_value(s.h) AS h, any_value(s.w) AS w, any_value(s.big) AS big, sum(n.v * g) AS v FROM {p} s, {taps} JOIN {p} n ON n.rec_id = s.rec_id AND n.x = s.x AND n.y = {sym('(s.y + o)', 's.h')} GROUP BY 1, 2, 3)")
            parts.append(f"bb{k} AS MATERIALIZED (SELECT s.rec_id, s.y, s.x, any_value(s.h) AS h, any_value(s.w) AS w, any_value(s.big) AS big, sum(n.v * g) AS v FROM ba{k} s, {taps} JOIN ba{k} n ON n.rec_id = s.rec_id AND n.y = s.y AND n.x = {sym('(s.x + o)', 's.w')} GROUP BY 1, 2, 3)")
            parts.append(_zoom_sql(f"bb{k}", f"zz{k}", "ceil(h / 2::DOUBLE)", "ceil(w / 2::DOUBLE)"))
            parts.append(f"im{k} AS MATERIALIZED (SELECT rec_id, y, x, v, CAST(ceil(h / 2::DOUBLE) AS BIGINT) AS h, CAST(ceil(w / 2::DOUBLE) AS BIGINT) AS w, big FROM zz{k})")
        parts.append(f"nz{k} AS MATERIALIZED (SELECT *, (v - avg(v) OVER r) / CASE WHEN stddev_pop(v) OVER r > 0 THEN stddev_pop(v) OVER r ELSE 1 END AS z FROM im{k} WINDOW r AS (PARTITION BY rec_id))")
        # the places of all products first, so that they are met by equality
        parts.append(f"pl{k} AS MATERIALIZED (SELECT rec_id, y, x, f, re, im, {sym('(y + dy)', 'h')} AS ny, {sym('(x + dx)', 'w')} AS nx FROM nz{k}, kr)")
        parts.append(f"""rs{k} AS MATERIALIZED (SELECT s.rec_id, f, s.y, s.x, any_value(n.h) AS h, any_value(n.w) AS w, any_value(n.big) AS big, sqrt(pow(sum(n.z * re), 2) + pow(sum(n.z * im), 2)) AS v FROM pl{k} s JOIN nz{k} n ON n.rec_id = s.rec_id AND n.y = ny AND n.x = nx GROUP BY 1, 2, 3, 4)""")
        if k:
            parts.append(_zoom_sql(f"rs{k}", f"up{k}", "64", "big", "s.f"))
        ends.append(f"SELECT rec_id, 'shp_' || lpad(CAST({k * len(filters)} + f + 1 AS VARCHAR), 3, '0') AS shp, y, x, v FROM {'up' if k else 'rs'}{k}")
    return ", ".join(parts) + f", resp AS ({' UNION ALL '.join(ends)})"


@q(f"WITH {SPEC}, {shape_sql('low')} SELECT rec_id, shp, {R('avg(v)', 'response')} FROM resp GROUP BY 1, 2")
def shape_features(spark, d):
    return rounded(im.shape_features(frames(spark, d)).drop("block"))


@q(f"WITH {SPEC}, {BOX}, {shape_sql('low')} SELECT r.rec_id, roi_id, shp, {R('avg(v)', 'response')} FROM resp r JOIN box b ON b.rec_id = r.rec_id AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y GROUP BY 1, 2, 3")
def shape_roi_mean(spark, d):
    return rounded(im.shape_roi_features(frames(spark, d), boxes(spark, d)))


N_PEAKS = f"""x AS (SELECT rec_id, f_idx AS i, 20 * log10(greatest(a, {M})) AS v FROM sa), n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM x WINDOW w AS (PARTITION BY rec_id ORDER BY i)),
  p AS (SELECT rec_id, i, v, (SELECT coalesce(max(b.i), -1) FROM x b WHERE b.rec_id = n.rec_id AND b.i < n.i AND b.v > n.v) AS lo, (SELECT coalesce(min(b.i), 64) FROM x b WHERE b.rec_id = n.rec_id AND b.i > n.i AND b.v > n.v) AS hi FROM n WHERE v > l AND v > r),
  q AS (SELECT p.rec_id, p.v - min(b.v) FILTER (WHERE b.i <= p.i) AS up, p.v - min(b.v) FILTER (WHERE b.i >= p.i) AS down FROM p JOIN x b ON b.rec_id = p.rec_id AND b.i > lo AND b.i < hi GROUP BY p.rec_id, p.i, p.v)"""
N_PEAKS_SELECT = "SELECT rec_id, count(q.up) FILTER (WHERE up >= 1 AND down > 1) AS n_peaks FROM (SELECT DISTINCT rec_id FROM x) LEFT JOIN q USING (rec_id) GROUP BY 1"


@q(f"{S}, {N_PEAKS} {N_PEAKS_SELECT}")
def n_peaks_full(spark, d):
    s = sp.avg_amplitude(cells(spark, d)).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("f_idx", "a"))).alias("s")).select("rec_id", F.col("s.a").alias("v"))
    return im.n_peaks(s, DF)


def _long(arrays):
    """Arrays of samples as rounded rows: (rec_id, i, x)."""
    return rounded(sg.samples(arrays).select("rec_id", "i", "x"))


def dft_sql(source: str, n: int, name: str = "d") -> str:
    """A CTE with the real and imaginary part of each coefficient k of a series (rec_id, i, x) of n values."""
    return f"{name} AS (SELECT rec_id, k, sum(x * cos(2 * pi() * (k * i % {n}) / {n})) AS re, -sum(x * sin(2 * pi() * (k * i % {n}) / {n})) AS im FROM {source}, (SELECT unnest(range(0, {n})) AS k) GROUP BY 1, 2)"


# the series is extended oddly at both ends by 63 values, to 190; the squared Butterworth gain comes from prewarped frequencies
@q(f"""WITH {SIG}, e AS (SELECT a.rec_id, a.i, CASE WHEN a.i < 63 THEN 2 * f.x - s.x WHEN a.i > 126 THEN 2 * l.x - s.x ELSE s.x END AS x FROM (SELECT rec_id, unnest(range(0, 190)) AS i FROM (SELECT DISTINCT rec_id FROM sig)) a
    JOIN sig s ON s.rec_id = a.rec_id AND s.i = CASE WHEN a.i < 63 THEN 63 - a.i WHEN a.i > 126 THEN 189 - a.i ELSE a.i - 63 END JOIN sig f ON f.rec_id = a.rec_id AND f.i = 0 JOIN sig l ON l.rec_id = a.rec_id AND l.i = 63),
  {dft_sql('e', 190)}, w AS (SELECT rec_id, k, re, im, tan(pi() * least(k, 190 - k) / 190) AS w, tan(pi() * 4 / 64) AS a, tan(pi() * 16 / 64) AS b FROM d),
  g AS (SELECT rec_id, k, re * h AS re, im * h AS im FROM (SELECT *, CASE WHEN k = 0 OR k = 95 THEN 0 ELSE 1 / (1 + pow(pow((w * w - a * b) / (w * (b - a)), 2), 3)) END AS h FROM w))
  SELECT rec_id, i - 63 AS i, {R('sum(re * cos(2 * pi() * (k * i % 190) / 190) - im * sin(2 * pi() * (k * i % 190) / 190)) / 190', 'x')} FROM g, (SELECT unnest(range(63, 127)) AS i) GROUP BY 1, 2""")
def butter_bandpass(spark, d):
    return _long(im.map_arrays(signals(spark, d), lambda x: kn.zero_phase_iir(x, FS, (4.0, 16.0), 3)))


# 64 samples meet the first 64 taps; the Bessel function of the Kaiser window is summed
_I0 = "list_sum(list_transform(range(0, 60), lambda j: pow(({x}) / 2, 2 * j) / pow(gamma(j + 1), 2)))"


@q(f"""WITH {SIG}, c AS (SELECT CAST(ceil((80 - 7.95) / 2.285 / (pi() * (16 - 4) * 0.05 / 32) + 1) AS BIGINT) AS n, 0.1102 * (80 - 8.7) AS beta),
  t AS (SELECT k, (k - (n - 1) / 2::DOUBLE) AS m, n, beta FROM c, (SELECT unnest(range(0, 64)) AS k)),
  h AS (SELECT k, CASE WHEN m = 0 THEN 0.5 - 0.125 ELSE (sin(pi() * 0.5 * m) - sin(pi() * 0.125 * m)) / (pi() * m) END * {_I0.format(x='beta * sqrt(greatest(1 - pow(2 * m / (n - 1), 2), 0))')} / {_I0.format(x='beta')} AS h FROM t)
  SELECT a.rec_id, a.i, {R('sum(b.x * h.h)', 'x')} FROM sig a JOIN sig b ON b.rec_id = a.rec_id AND b.i <= a.i JOIN h ON h.k = a.i - b.i GROUP BY 1, 2""")
def sinc_bandpass(spark, d):
    return _long(im.map_arrays(signals(spark, d), lambda x: kn.causal_fir(x, kn.kaiser_sinc_taps((4.0, 16.0), FS))))


@q(f"""WITH {SIG}, {dft_sql('sig', 64)}, h AS (SELECT rec_id, k, re * w AS re, im * w AS im FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 WHEN k < 32 THEN 2 ELSE 0 END AS w FROM d)),
  z AS (SELECT rec_id, i, sum(re * cos(2 * pi() * (k * i % 64) / 64) - im * sin(2 * pi() * (k * i % 64) / 64)) / 64 AS a, sum(re * sin(2 * pi() * (k * i % 64) / 64) + im * cos(2 * pi() * (k * i % 64) / 64)) / 64 AS b FROM h, (SELECT unnest(range(0, 64)) AS i) GROUP BY 1, 2)
  SELECT rec_id, i, {R('sqrt(a * a + b * b)', 'x')} FROM z""")
def envelope_hilbert(spark, d):
    return _long(im.map_arrays(signals(spark, d), kn.analytic_envelope))


# 48 of 64: coefficients up to 24, the last of them real and whole
@q(f"""WITH {SIG}, {dft_sql('sig', 64)} SELECT rec_id, i, {R('sum(CASE WHEN k = 0 THEN re WHEN k = 24 THEN 2 * re * cos(pi() * i) ELSE 2 * (re * cos(2 * pi() * (k * i % 48) / 48) - im * sin(2 * pi() * (k * i % 48) / 48)) END) / 64', 'x')}
  FROM d, (SELECT unnest(range(0, 48)) AS i) WHERE k <= 24 GROUP BY 1, 2""")
def resample_fft(spark, d):
    return _long(im.map_arrays(signals(spark, d), lambda x: kn.resample(x, FS, 48.0)))


@q(f"""WITH {SIG}, {dft_sql('sig', 64)}, c AS (SELECT 293.15 AS kel, 60 * 101325 * pow(10::DOUBLE, -6.8346 * pow(273.16 / 293.15::DOUBLE, 1.261) + 4.6151) / 101325 AS h),
  f AS (SELECT k, pow(k / 64::DOUBLE * 32, 2) AS f2, 24 + 4.04e4 * h * (0.02 + h) / (0.391 + h) AS fo, 9 + 280 * h AS fr FROM c, (SELECT unnest(range(0, 64)) AS k)),
  g AS (SELECT k, 1 / 50::DOUBLE * exp(-8.686 * f2 * (1.84e-11 + 0.01275 * exp(-2239.1 / 293.15) / (fo + f2 / fo) + 0.1068 * exp(-3352 / 293.15) / (fr + f2 / fr)) / (20 * log10(exp(1))) * 49) * exp(-0.02 * sqrt(f2) / 1000 / 20 * log10(exp(1)) * 49) AS g FROM f)
  SELECT rec_id, i, {R('sum(g * (re * cos(2 * pi() * (k * i % 64) / 64) - im * sin(2 * pi() * (k * i % 64) / 64))) / 64', 'x', 8)} FROM d JOIN g USING (k), (SELECT unnest(range(0, 64)) AS i) GROUP BY 1, 2""")
def apply_attenuation(spark, d):
    return rounded(sg.samples(pg.attenuate(signals(spark, d), FS, 50.0)).select("rec_id", "i", "x"), 8)


# windows of one reading and one more; energies are mirrored at the ends as far as 80 readings, the kernel is a Mexican hat of width 16
@q(f"""WITH {EV}, z AS (SELECT rec_id, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT CAST(ceil((80 - 7.95) / 2.285 / (pi() * (3 - 0.5) * 0.8 / 4) + 1) AS BIGINT) AS n, 0.1102 * (80 - 8.7) AS beta),
  t AS (SELECT k, k - (n - 1) / 2::DOUBLE AS m, n, beta FROM c, (SELECT unnest(range(0, 64)) AS k) WHERE k < n),
  h AS (SELECT k, CASE WHEN m = 0 THEN 0.75 - 0.125 ELSE (sin(pi() * 0.75 * m) - sin(pi() * 0.125 * m)) / (pi() * m) END * {_I0.format(x='beta * sqrt(greatest(1 - pow(2 * m / (n - 1), 2), 0))')} / {_I0.format(x='beta')} AS h FROM t),
  f AS (SELECT a.rec_id, a.i, sum(b.x * h.h) AS y FROM ev a JOIN ev b ON b.rec_id = a.rec_id AND b.i <= a.i JOIN h ON h.k = a.i - b.i GROUP BY 1, 2),
  e AS (SELECT rec_id, i, y * y AS e, n FROM f JOIN z USING (rec_id) UNION ALL SELECT z.rec_id, n, coalesce(y * y, 0), n FROM z LEFT JOIN f ON f.rec_id = z.rec_id AND f.i = n - 2),
  w AS (SELECT a.rec_id, a.i, any_value(a.n) AS n, CAST(sum(b.e * (1 - pow(o / 16::DOUBLE, 2)) * exp(-pow(o / 16::DOUBLE, 2) / 2)) > 0 AS INT) AS c
    FROM e a JOIN (SELECT unnest(range(-128, 129)) AS o) ON a.i + o BETWEEN -80 AND a.n + 80 JOIN e b ON b.rec_id = a.rec_id AND b.i = a.n - abs(a.n - ((a.i + o) % (2 * a.n) + 2 * a.n) % (2 * a.n)) GROUP BY 1, 2),
  s AS (SELECT rec_id, n, c - lag(c) OVER (PARTITION BY rec_id ORDER BY i) AS step, i / 8::DOUBLE AS at_ FROM w),
  l AS (SELECT rec_id, any_value(n) / 8::DOUBLE AS last, list(at_ ORDER BY at_) FILTER (WHERE step > 0) AS a, list(at_ ORDER BY at_) FILTER (WHERE step < 0) AS b FROM s GROUP BY 1),
  k AS (SELECT rec_id, CASE WHEN b[1] < a[1] THEN list_prepend(0::DOUBLE, a) ELSE a END AS a, CASE WHEN a[-1] > b[-1] THEN list_append(b, last) ELSE b END AS b FROM l WHERE a IS NOT NULL AND b IS NOT NULL)
  SELECT rec_id, 0.5::DOUBLE AS min_f, round(x[1], 5) AS min_t, 3::DOUBLE AS max_f, round(x[2], 5) AS max_t FROM (SELECT rec_id, unnest(list_zip(a, b)) AS x FROM k) WHERE x[1] IS NOT NULL AND x[2] IS NOT NULL""")
def cwt_rois(spark, d):
    s = event_series(spark, d).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).select("rec_id", F.col("s.x").alias("x"))
    return im.cwt_rois(s, 8.0, (0.5, 3.0), 4.0)

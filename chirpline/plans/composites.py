"""Queries of the composite feature rows and end-to-end pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.functions import decibel as db
from chirpline.functions import indices as ix
from chirpline.operators import features as ft
from chirpline.operators import images as im
from chirpline.operators import relational as rl
from chirpline.operators import signal as sg
from chirpline.operators import spectral as sp
from chirpline.operators import summaries as sm
from chirpline.plans.pictures import BOX, BOXES, N_PEAKS, N_PEAKS_SELECT, ROI_INDEX, ROI_OK, ROI_SELECT, boxes, frames, hysteresis_sql, shape_sql
from chirpline.plans.registry import DF, DT, ENV, FS, M, NT, SIG, SPEC, R, Registry, cells, rounded, signals
from chirpline.plans.spectral import ALL, EQ, G, LAGS, NOISE, S, SQ, _mom, _smooth, hn
from chirpline.plans.temporal import evn, mom
from chirpline.session import staging_path, table
from chirpline.sources import catalogue, wav

q = Registry()
QUERIES, ORACLES = q.queries, q.sql


@q(f"""{S}, {SQ}, m AS ({_mom('p', 'sa', 'rec_id', 6)}), z AS (SELECT rec_id, {', '.join(f"min(fn) FILTER (WHERE share >= {x}) AS freq_{round(x * 100):02d}" for x in ft.QS)} FROM cq GROUP BY 1), k AS (SELECT rec_id, arg_max(fn, (p, -f_idx)) AS peak_freq FROM sa GROUP BY 1)
  SELECT rec_id, mean AS sm, var AS sv, skew AS ss, kurt AS sk, freq_05, freq_25, freq_50, freq_75, freq_95, peak_freq, freq_75 - freq_25 AS bw_50, freq_95 - freq_05 AS bw_90 FROM m JOIN z USING (rec_id) JOIN k USING (rec_id)""")
def all_spectral_features(spark, d):
    return rounded(ft.spectral_features(cells(spark, d)))


@q(f"""WITH {SIG}, {ENV}, m AS ({mom('sig', 'rec_id', 'x')}),
  fr AS (SELECT rec_id, t, i - t * 8 AS n, x FROM sig, (SELECT unnest(range(0, 7)) AS t) WHERE i BETWEEN t * 8 AND t * 8 + 15), w AS (SELECT *, (x - avg(x) OVER (PARTITION BY rec_id, t)) * (0.5 - 0.5 * cos(2 * pi() * n / 16)) AS y FROM fr),
  dft AS (SELECT rec_id, t, k, sum(y * cos(2 * pi() * k * n / 16)) AS re, sum(y * sin(2 * pi() * k * n / 16)) AS im FROM w, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1, 2, 3),
  e AS (SELECT rec_id, t, sum(re * re + im * im) AS p FROM dft GROUP BY 1, 2), c AS (SELECT *, round(sum(p) OVER (PARTITION BY rec_id ORDER BY t ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY rec_id), 12) AS share FROM e),
  z AS (SELECT rec_id, {', '.join(f"min(t * 0.125::DOUBLE) FILTER (WHERE share >= {x}) AS time_{round(x * 100):02d}" for x in ft.QS)} FROM c GROUP BY 1),
  qt AS (SELECT *, round(sum(e * e) OVER (PARTITION BY rec_id ORDER BY k ROWS UNBOUNDED PRECEDING) / sum(e * e) OVER (PARTITION BY rec_id), 12) AS share FROM env),
  y AS (SELECT rec_id, min(k) FILTER (WHERE share >= 0.75) - min(k) FILTER (WHERE share >= 0.25) AS d50, min(k) FILTER (WHERE share >= 0.95) - min(k) FILTER (WHERE share >= 0.05) AS d90 FROM qt GROUP BY 1),
  x AS (SELECT rec_id, sum(CASE WHEN b IS NOT NULL AND (x > 0) <> (b > 0) THEN 1 ELSE 0 END) / (count(*) / 64::DOUBLE) AS zcr FROM (SELECT *, lag(x) OVER (PARTITION BY rec_id ORDER BY i) AS b FROM sig) GROUP BY 1)
  SELECT rec_id, mean AS sm, var AS sv, skew AS ss, kurt AS sk, time_05, time_25, time_50, time_75, time_95, {R('zcr', 'zcr', 5)}, {R('d50 * 0.125', 'duration_50', 5)}, {R('d90 * 0.125', 'duration_90', 5)} FROM m JOIN z USING (rec_id) JOIN y USING (rec_id) JOIN x USING (rec_id)""")
def all_temporal_features(spark, d):
    s = signals(spark, d)
    return rounded(ft.temporal_features(s, im.as_cells(im.stft(s, 16)), FS, NT, 8 / FS), 5)


_PER = ["fn", "LTS", "MEANt", "VARt", "SKEWt", "KURTt", "Ht", "ACI", "ROU", "AGI", "LEQf", "ENRf", "BGNf", "ACTspFract", "EVNspFract", "EVNspMean", "EVNspCount", "SNRf", "SNRf_db"]


@q(f"""{S}, {EQ}, {LAGS}, {NOISE}, n2 AS {_smooth('n1', 'noise', 5, 'n')}, mm AS ({_mom('a', 'spec', 'rec_id, f_idx', 15)}), hh AS {hn('p', 'spec', 'rec_id, f_idx', 'Ht')},
  st AS (SELECT rec_id, f_idx, sum(abs(d1)) / sum(a) AS ACI, sum(d2 * d2) AS ROU, avg(abs(d1)) / greatest(quantile_cont(abs(d1), 0.5), {M}) AS AGI FROM lg GROUP BY 1, 2),
  ac AS (SELECT rec_id, f_idx, avg(CASE WHEN level >= 3 THEN 1 ELSE 0 END) AS ACTspFract, CAST(sum(CASE WHEN level >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS ACTspCount FROM lev GROUP BY 1, 2),
  {evn('lev', 'rec_id, f_idx', 't_idx', 'level >= 3', 0.25, 4)},
  al AS (SELECT *, p AS LTS, mean AS MEANt, var AS VARt, skew AS SKEWt, kurt AS KURTt, 20 * log10(greatest(sqrt(p) / pow(10::DOUBLE, -1.75) / pow(10::DOUBLE, 2.1), {M}) / 20e-6) AS LEQf, p AS ENRf, 10 * log10(n) AS BGNf, fraction AS EVNspFract, mean_s AS EVNspMean, per_s AS EVNspCount, 0::DOUBLE AS SNRf, 10 * log10(p) - 10 * log10(n) AS SNRf_db
    FROM sa JOIN n2 USING (rec_id, f_idx) JOIN mm USING (rec_id, f_idx) JOIN hh USING (rec_id, f_idx) JOIN st USING (rec_id, f_idx) JOIN ac USING (rec_id, f_idx) JOIN evn USING (rec_id, f_idx))
  SELECT rec_id, f_idx, ACTspCount, {', '.join(R(x, x, 6) for x in _PER)} FROM al""")
def all_spectral_per_bin(spark, d):
    return rounded(ft.spectral_per_bin(cells(spark, d), G))


@q(f"""{S}, {LAGS}, hh AS {hn('p', 'spec', 'rec_id, f_idx', 'h')}, st AS (SELECT rec_id, f_idx, sum(abs(d1)) / sum(a) AS aci FROM lg GROUP BY 1, 2),
  al AS (SELECT rec_id, f_idx, fn, {R('p', 'LTS')}, {R('aci', 'ACI')}, {R('h', 'Ht')} FROM sa JOIN st USING (rec_id, f_idx) JOIN hh USING (rec_id, f_idx))
  SELECT rec_id, list(fn ORDER BY f_idx) AS fn, list(LTS ORDER BY f_idx) AS LTS, list(ACI ORDER BY f_idx) AS ACI, list(Ht ORDER BY f_idx) AS Ht FROM al GROUP BY 1""")
def per_bin_lists(spark, d):
    return ft.as_lists(rounded(ft.spectral_per_bin(cells(spark, d), G)), ["fn", "LTS", "ACI", "Ht"])


@q(f"WITH {SPEC}, t AS (SELECT rec_id, quantile_cont(p, 0.75) AS q3, quantile_cont(p, 0.25) AS q1 FROM spec WHERE p > 0 GROUP BY 1) SELECT rec_id, {R('q3 + (q3 - q1) * 6', 'high')}, {R('(q3 + (q3 - q1) * 6) * 0.5', 'low')} FROM t")
def mask_thresholds(spark, d):
    return rounded(ft.relative_thresholds(cells(spark, d)))


_RELATIVE = """t AS (SELECT rec_id, q3 + (q3 - q1) * 1.5 AS high, (q3 + (q3 - q1) * 1.5) * 0.5 AS low FROM (SELECT rec_id, quantile_cont(a, 0.75) AS q3, quantile_cont(a, 0.25) AS q1 FROM spec WHERE a > 0 GROUP BY 1)),
  sc AS (SELECT rec_id, t_idx, f_idx, (a - low) / (high - low) AS v FROM spec JOIN t USING (rec_id))"""


@q(f"WITH RECURSIVE {SPEC}, {_RELATIVE}, {hysteresis_sql('sc', 1, 0)} SELECT rec_id, t_idx, f_idx FROM m")
def mask_relative(spark, d):
    return ft.relative_hysteresis(frames(spark, d), 1.5).select("rec_id", "t_idx", "f_idx")


# closing with 3 x 3: cells whose neighbours inside the picture are all in the dilated mask; what lies outside counts as on
@q(f"""WITH RECURSIVE {SPEC}, {hysteresis_sql('spec', 2.0, 0.9, v='a')}, o AS (SELECT a, b FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)), e AS (SELECT rec_id, max(t_idx) AS last FROM spec GROUP BY 1),
  dl AS (SELECT DISTINCT rec_id, t_idx + a AS t_idx, f_idx + b AS f_idx FROM m JOIN e USING (rec_id), o WHERE t_idx + a BETWEEN 0 AND last AND f_idx + b BETWEEN 0 AND 63),
  cl AS (SELECT s.rec_id, s.t_idx, s.f_idx FROM dl s JOIN e USING (rec_id), o LEFT JOIN dl n ON n.rec_id = s.rec_id AND n.t_idx = s.t_idx + a AND n.f_idx = s.f_idx + b
    GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE n.rec_id IS NULL AND s.t_idx + a BETWEEN 0 AND last AND s.f_idx + b BETWEEN 0 AND 63) = 0)
  SELECT rec_id, t_idx, f_idx FROM cl""")
def mask_fused(spark, d):
    return ft.fused_boxes(frames(spark, d), 2.0, 0.9, 3, 3).select("rec_id", "t_idx", "f_idx")


_CLEAN = f"""lv AS (SELECT rec_id, t_idx, f_idx, greatest(least(10 * log10(greatest(a, {M})), 0), -96) + 96 AS p FROM spec), rn AS (SELECT rec_id, t_idx, f_idx, greatest(p - avg(p) OVER (PARTITION BY rec_id, t_idx), 0) AS p FROM lv),
  cn AS (SELECT rec_id, t_idx, f_idx, greatest(p - quantile_cont(p, 0.5) OVER (PARTITION BY rec_id, f_idx), 0) AS v FROM rn)"""


@q(f"WITH RECURSIVE {SPEC}, {_CLEAN}, {hysteresis_sql('cn', 3.0, 2.0)}, {BOXES}, {ROI_INDEX}")
def region_index(spark, d):
    return rounded(ft.region_index(frames(spark, d), DF, DT, seed=3.0, low=2.0, min_duration=0.025))


_INDICES = [f"CAST(NP.n_peaks AS DOUBLE) AS {x}" if x == "NBPEAKS" else f"ri.{'n_roi' if x == 'nROI' else 'a_roi'} AS {x}" if x in ("nROI", "aROI") else R(f"al.{x}", x, 6) for x in ix.NAMES]


@q(f"""{ALL.replace("WITH ", "WITH RECURSIVE ", 1)}, {N_PEAKS}, NP AS ({N_PEAKS_SELECT}), {_CLEAN.replace("greatest(a,", "greatest(p,")}, {hysteresis_sql('cn', 13.0, 6.0)}, {BOXES}, {ROI_OK}, ri AS ({ROI_SELECT})
  SELECT al.rec_id, {', '.join(_INDICES)} FROM al JOIN NP ON NP.rec_id = al.rec_id JOIN ri ON ri.rec_id = al.rec_id""")
def all_spectral(spark, d):
    return rounded(ft.all_spectral(frames(spark, d), G))


@q(f"""WITH RECURSIVE {SPEC}, {_RELATIVE}, {hysteresis_sql('sc', 1, 0)}, {BOXES}, ex AS (SELECT rec_id, count(DISTINCT t_idx) AS nf FROM spec GROUP BY 1)
  SELECT ex.rec_id, {R('count(roi) / (any_value(nf) * 0.25 / 60)', 'roi_total')}, {R('coalesce(sum(area), 0) / (any_value(nf) * 64) * 100', 'roi_cover')} FROM ex LEFT JOIN (SELECT * FROM bx WHERE area >= 2) USING (rec_id) GROUP BY 1""")
def roi_index_older(spark, d):
    return rounded(ft.roi_total_and_cover(frames(spark, d), DT, min_area=2, bin_std=1.5))


@q()
def roi_features(spark, d):
    return ft.shape_and_centroid(frames(spark, d), boxes(spark, d))


@q(f"WITH {SIG}, {ENV}, v AS (SELECT rec_id, e AS v, sum(e) OVER (PARTITION BY rec_id) AS s FROM env) SELECT rec_id, {R(f'-sum(greatest(v / s, {M}) * ln(greatest(v / s, {M}))) / ln(count(*))', 'h')} FROM v GROUP BY 1")
def temporal_entropy_amplitude(spark, d):
    return rounded(sg.envelope(signals(spark, d), NT).groupBy("rec_id").agg(sg.entropy("e").alias("h")))


@q(f"{S}, r AS (SELECT rec_id, sqrt(p) AS v FROM sa) SELECT rec_id, {R('h', 'hf')} FROM {hn('v', 'r', 'rec_id', 'h')}")
def freq_entropy_amplitude(spark, d):
    s = sp.avg_power(cells(spark, d)).withColumn("v", F.sqrt("p"))
    return rounded(s.groupBy("rec_id").agg(sg.entropy("v").alias("hf")))


@q(f"{S}, b AS (SELECT rec_id, floor(fn / 1000) AS b, avg(p) * 4 AS p FROM sa GROUP BY 1, 2), n AS (SELECT rec_id, sum(p) FILTER (WHERE b BETWEEN 1 AND 10) AS bio, sum(p) FILTER (WHERE b = 1) AS anthro FROM b WHERE b >= 1 GROUP BY 1) SELECT rec_id, {R('(bio - anthro) / (bio + anthro)', 'ndsi')}, {R('bio / anthro', 'ratio')}, {R('anthro', 'anthro')}, {R('bio', 'bio')} FROM n")
def ndsi_without_first_bin(spark, d):
    return rounded(sp.soundscape_index(cells(spark, d), G, compatible=False))


_MAIN = "(VALUES ('Velunia', 'sonoria'), ('Kidarra', 'minuscula'), ('Nobody', 'nowhere'), (NULL, 'vagans')) AS q(gen, sp)"


@q(f"SELECT q.gen AS q_gen, q.sp AS q_sp, c.id, c.loc FROM catalogue c JOIN {_MAIN} ON (q.gen IS NULL OR q.gen = c.gen) AND (q.sp IS NULL OR q.sp = c.sp)")
def catalogue_multi_query(spark, d):
    wanted = [{"gen": "Velunia", "sp": "sonoria"}, {"gen": "Kidarra", "sp": "minuscula"}, {"gen": "Nobody", "sp": "nowhere"}, {"sp": "vagans"}]
    return catalogue.multi_search(table(spark, d, "catalogue"), wanted, ["gen", "sp"]).select("q_gen", "q_sp", "id", "loc")


@q("SELECT id, gen, sp FROM (SELECT id, min(gen) AS gen, min(sp) AS sp FROM catalogue WHERE id IS NOT NULL GROUP BY 1) ORDER BY md5('1979:' || id), id LIMIT 50")
def catalogue_sample(spark, d):
    species = table(spark, d, "catalogue").where("id is not null").groupBy("id").agg(F.min("gen").alias("gen"), F.min("sp").alias("sp"))
    return rl.sample_rows(species, "id", 50, 1979)


@q(f"WITH {SPEC}, k AS (SELECT rec_id % 3 AS hour, f_idx, sum(p) AS s, count(*) AS n FROM spec GROUP BY 1, 2) SELECT hour, f_idx, {R('10 * log10(s / n)', 'level')} FROM k")
def spectrogram_by_hour(spark, d):
    c = cells(spark, d).groupBy((F.col("rec_id") % 3).alias("hour"), "f_idx").agg(db.power_to_db(F.avg("p")).alias("level"))
    return rounded(c)


@q("SELECT strftime(date, '%Y') AS y, strftime(date, '%a') AS wd, count(*) AS n FROM audio_metadata WHERE date IS NOT NULL GROUP BY 1, 2")
def count_by_weekday(spark, d):
    t = table(spark, d, "audio_metadata").where("date is not null").withColumn("ts", F.col("date").cast("timestamp"))
    return t.groupBy(sm.date_key(F.col("ts"), "%Y").alias("y"), sm.date_key(F.col("ts"), "%a").alias("wd")).agg(F.count(F.lit(1)).alias("n"))


def _archive(spark, d) -> str:
    """The signals as WAV files of 16 bits in the shared folder; the hour in a file's name is its number modulo 24."""
    folder = staging_path(spark, "archive")
    named = signals(spark, d).withColumn("rec_id", F.format_string("S%d_20200101_%02d0000", F.col("rec_id"), F.col("rec_id") % 24))
    wav.write(named, folder, int(FS))
    return folder


# samples come back from 16 bits: cut to [-1, 1], times 32767 without fraction, by 32768
QUANTISED = f"""{SIG}, qs AS (SELECT rec_id, i, trunc(greatest(least(x, 1), -1) * 32767) / 32768 AS x FROM sig), fr AS (SELECT rec_id, t, i - t * 8 AS n, x FROM qs, (SELECT unnest(range(0, 7)) AS t) WHERE i BETWEEN t * 8 AND t * 8 + 15),
  w AS (SELECT *, (x - avg(x) OVER (PARTITION BY rec_id, t)) * (0.5 - 0.5 * cos(2 * pi() * n / 16)) AS y FROM fr),
  dft AS (SELECT rec_id, t, k, sum(y * cos(2 * pi() * k * n / 16)) AS re, sum(y * sin(2 * pi() * k * n / 16)) AS im FROM w, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1, 2, 3),
  pw AS (SELECT rec_id, t AS t_idx, k AS f_idx, (re * re + im * im) * 2 / (16 * 6) AS p FROM dft)"""


@q(f"WITH {QUANTISED} SELECT rec_id, t_idx, f_idx, {R('p', 'p')} FROM pw")
def audio_frames(spark, d):
    """WAV files written, read by ranges and turned into block spectrograms."""
    found = wav.spectrogram(spark, _archive(spark, d), 16)
    return rounded(found.select(F.regexp_extract("path", r"/S(\d+)_[0-9_]+\.wav$", 1).cast("long").alias("rec_id"), "t_idx", F.posexplode("v").alias("f_idx", "p")).withColumn("f_idx", F.col("f_idx").cast("long")))


@q(f"""WITH {QUANTISED}, lv AS (SELECT rec_id, t_idx, f_idx, greatest(least(10 * log10(greatest(p, {M})), 0), -80) AS v FROM pw),
  m AS (SELECT *, max(v) OVER (PARTITION BY rec_id, f_idx ORDER BY t_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m1 FROM lv), n AS (SELECT *, max(m1) OVER (PARTITION BY rec_id, t_idx ORDER BY f_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m2 FROM m),
  k AS (SELECT rec_id, f_idx, sum(CASE WHEN v = m2 AND v > -40 AND t_idx BETWEEN 1 AND 5 AND f_idx BETWEEN 1 AND 6 THEN 1 ELSE 0 END) / 7::DOUBLE AS density FROM n GROUP BY 1, 2)
  SELECT rec_id % 24 AS hour, f_idx, f_idx * 4::DOUBLE AS frequency, {R('avg(density)', 'density')} FROM k GROUP BY 1, 2""")
def audio_soundscape(spark, d):
    """WAV files to the graphical soundscape of their hours."""
    return rounded(ft.audio_soundscape(spark, _archive(spark, d), 16, int(FS), threshold=-40.0))


@q()
def audio_indices(spark, d):
    """WAV files, resampled from 64 to 48 Hz, to the table of all spectral indices."""
    found = ft.audio_indices(spark, _archive(spark, d), 16, 48)
    return rounded(found.withColumn("path", F.substring_index("path", "/", -1)))


@q(f"WITH {SIG}, e AS (SELECT rec_id, CASE WHEN min(x) OVER w < 0 THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE x END AS v FROM sig WINDOW w AS (PARTITION BY rec_id)) SELECT rec_id, {R('h', 'h')} FROM {hn('v', 'e', 'rec_id', 'h')}")
def entropy_of_signed(spark, d):
    return rounded(sg.rescaled_entropy(sg.samples(signals(spark, d)), ["rec_id"], "x"))


@q(f"WITH {SPEC}, {LAGS}, r AS (SELECT rec_id, f_idx, sum(d2 * d2) AS r, max(a) AS m FROM lg GROUP BY 1, 2) SELECT rec_id, {R('sum(r / (m * m))', 'per_bin')}, {R('sum(r) / pow(max(m), 2)', 'global')} FROM r GROUP BY 1")
def roughness_norms(spark, d):
    c = cells(spark, d)
    return rounded(sp.roughness(c, "per_bin").withColumnRenamed("rou", "per_bin").join(sp.roughness(c, "global").withColumnRenamed("rou", "global"), "rec_id"))


@q(f"""WITH {SPEC}, {LAGS}, g AS (SELECT rec_id, f_idx, abs(d2) / 0.0625 AS g FROM lg WHERE d2 IS NOT NULL), m AS (SELECT rec_id, quantile_cont(g, 0.5) AS m FROM g GROUP BY 1), b AS (SELECT rec_id, f_idx, avg(g) AS g FROM g GROUP BY 1, 2)
  SELECT rec_id, {R('avg(b.g / m.m)', 'agi')}, {R('sum(b.g / m.m)', 'agi_sum', 5)} FROM b JOIN m USING (rec_id) GROUP BY 1""")
def agi_second_order(spark, d):
    return rounded(sp.acoustic_gradient(cells(spark, d), G, 2, "global").withColumn("agi_sum", F.round("agi_sum", 5)))


@q(f"""WITH {SIG}, fr AS (SELECT rec_id, t, i - t * 8 AS n, x FROM sig, (SELECT unnest(range(0, 7)) AS t) WHERE i BETWEEN t * 8 AND t * 8 + 15),
  w AS (SELECT *, (x - avg(x) OVER (PARTITION BY rec_id, t)) * (0.5 - 0.5 * cos(2 * pi() * n / 16)) AS y FROM fr WHERE t BETWEEN 1 AND 5),
  dft AS (SELECT rec_id, t, k, sum(y * cos(2 * pi() * k * n / 16)) AS re, sum(y * sin(2 * pi() * k * n / 16)) AS im FROM w, (SELECT unnest(range(2, 7)) AS k) GROUP BY 1, 2, 3)
  SELECT rec_id, t - 1 AS t_idx, k AS f_idx, {R('sqrt((re * re + im * im) * 2 / (16 * 6))', 'a')} FROM dft""")
def spectrogram_limits(spark, d):
    """Amplitudes from 8 to 24 Hz and from 0.125 to 0.6 seconds."""
    found = im.spectrogram(signals(spark, d), FS, 16, mode="amplitude", flims=(8.0, 24.0), tlims=(0.125, 0.6))
    return rounded(found.select("rec_id", "t_idx", "f_first", F.posexplode("v").alias("k", "a")).select("rec_id", "t_idx", (F.col("k") + F.col("f_first")).alias("f_idx"), "a"))


@q(f"""WITH {SPEC}, {BOX} SELECT s.rec_id, roi_id, min_y, max_y, min_x, max_x, min_y * 250::DOUBLE AS min_f, max_y * 250::DOUBLE AS max_f, min_x * 0.25::DOUBLE AS min_t, max_x * 0.25::DOUBLE AS max_t,
  round(sum(p * f_idx) / sum(p)) * 250::DOUBLE AS centroid_f, round(sum(p * t_idx) / sum(p)) * 0.25::DOUBLE AS centroid_t, (max_x - min_x) * 0.25::DOUBLE AS duration_t, (max_y - min_y) * 250::DOUBLE AS bandwidth_f, (max_x - min_x) * (max_y - min_y) * 62.5::DOUBLE AS area_tf
  FROM spec s JOIN box b ON b.rec_id = s.rec_id AND t_idx BETWEEN min_x AND max_x AND f_idx BETWEEN min_y AND max_y GROUP BY s.rec_id, roi_id, min_x, max_x, min_y, max_y""")
def roi_format_from_pixels(spark, d):
    b = boxes(spark, d)
    out = im.format_features(im.box_centroids(cells(spark, d), b).join(b, ["rec_id", "roi_id"]), G)
    return out.select("rec_id", "roi_id", "min_y", "max_y", "min_x", "max_x", "min_f", "max_f", "min_t", "max_t", "centroid_f", "centroid_t", "duration_t", "bandwidth_f", "area_tf")


@q("""WITH c AS (SELECT id, min(q) AS q, min(length) AS length, min(loc) AS loc FROM catalogue WHERE id IS NOT NULL GROUP BY 1), n AS (SELECT id, CASE WHEN q = 'B' THEN 'A' END AS q, '0:' || right(id, 2) AS length FROM c WHERE id LIKE '%7')
  SELECT c.id, coalesce(n.q, c.q) AS q, coalesce(n.length, c.length) AS length, loc FROM c LEFT JOIN n USING (id)""")
def update_join(spark, d):
    c = table(spark, d, "catalogue").where("id is not null").groupBy("id").agg(*[F.min(x).alias(x) for x in ("q", "length", "loc")])
    new = c.where("id like '%7'").select("id", F.when(F.col("q") == "B", "A").alias("q"), F.concat(F.lit("0:"), F.expr("right(id, 2)")).alias("length"), F.lit("x").alias("other"))
    return rl.update_join(c, new, ["id"])


@q("SELECT rec_id FROM audio_metadata INTERSECT SELECT rec_id FROM roi")
def intersect_ids(spark, d):
    return table(spark, d, "audio_metadata").select("rec_id").intersect(table(spark, d, "roi").select("rec_id"))


@q(f"WITH {SPEC}, {shape_sql('low')} SELECT rec_id, shp, x AS t_idx, y AS f_idx, {R('v', 'v')} FROM resp")
def shape_raw(spark, d):
    raw = im.shape_raw(frames(spark, d)).select("rec_id", "shp", "t_idx", F.posexplode("v").alias("f_idx", "v"))
    return rounded(raw.withColumn("f_idx", F.col("f_idx").cast("long")))


_OWN = {"ntheta": 3, "bandwidth": 0.8, "frequency": (0.35, 0.5), "gamma": 2, "npyr": 2}


@q(f"""WITH {SPEC}, {shape_sql(_OWN)}, m AS (SELECT rec_id, CAST(substr(shp, 5) AS INT) - 1 AS i, avg(v) AS v FROM resp GROUP BY 1, 2)
  SELECT rec_id, round(pow(2, i // 6) / CASE i % 2 WHEN 0 THEN 0.35 ELSE 0.5 END, 6) + CAST(0 AS DOUBLE) AS scale, {', '.join(R(f'max(v) FILTER (WHERE i % 6 // 2 = {t})', f'theta_{t + 1}') for t in range(3))} FROM m GROUP BY 1, 2""")
def shape_matrix(spark, d):
    """The shape features of each recording, scales down and angles across, with a preset of one's own."""
    return rounded(im.shape_matrix(im.shape_features(frames(spark, d), _OWN).drop("block"), im.shape_params(spark, _OWN), ["rec_id"]))

"""Queries on metadata, annotations and the catalogue: filters, joins, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.operators import features as ft
from chirpline.operators import relational as rl
from chirpline.operators import summaries as sm
from chirpline.plans.pictures import frames
from chirpline.plans.registry import SPEC, R, Registry, cells, rounded
from chirpline.plans.spectral import G
from chirpline.session import table
from chirpline.sources import annotations, catalogue, metadata

q = Registry()
QUERIES, ORACLES = q.queries, q.sql


def _meta(spark, d):
    return table(spark, d, "audio_metadata").withColumn("ts", F.col("date").cast("timestamp"))


META = "meta AS (SELECT *, date AS ts FROM audio_metadata)"
BANDS = [("low", 0.0, 1000.0), ("mid", 1000.0, 10000.0), ("high", 10000.0, 20000.0)]


@q(f"WITH {SPEC} SELECT rec_id, t_idx, f_idx, {R('p', 'p')} FROM spec WHERE f_idx BETWEEN 4 AND 21")
def band_select_snapped(spark, d):
    return rounded(cells(spark, d).where(G.band(1100, 5333)).select("rec_id", "t_idx", "f_idx", "p"))


@q("SELECT roi_id, rec_id, CAST(max(least(63, greatest(0, ceil(round((min_f + max_f) / 500 - 0.5, 9))))) AS BIGINT) AS bin FROM roi WHERE min_f IS NOT NULL AND max_f IS NOT NULL GROUP BY 1, 2")
def nearest_bin(spark, d):
    c = table(spark, d, "roi").where("min_f is not null and max_f is not null")
    near = F.least(F.lit(63), F.greatest(F.lit(0), F.ceil(F.round((F.col("min_f") + F.col("max_f")) / 500 - 0.5, 9))))
    return c.groupBy("roi_id", "rec_id").agg(F.max(near).cast("long").alias("bin"))


@q(f"WITH {SPEC} SELECT rec_id, t_idx, f_idx, {R('a', 'a')} FROM spec WHERE tn BETWEEN 1.0 AND 3.5 AND fn BETWEEN 1000 AND 4000")
def crop_tf(spark, d):
    return rounded(cells(spark, d).where("tn between 1.0 and 3.5 and fn between 1000 and 4000").select("rec_id", "t_idx", "f_idx", "a"))


@q(f"WITH {META} SELECT rec_id, strftime(ts, '%m-%d') AS k FROM meta WHERE strftime(ts, '%m-%d') BETWEEN '03-15' AND '06-30'")
def filter_by_datekey(spark, d):
    return sm.filter_by_key(_meta(spark, d), "ts", "%m-%d", ("03-15", "06-30")).select("rec_id", sm.date_key(F.col("ts"), "%m-%d").alias("k"))


@q(f"WITH {META} SELECT rec_id, strftime(ts, '%H:%M') AS k FROM meta WHERE strftime(ts, '%H:%M') >= '22:00' OR strftime(ts, '%H:%M') <= '04:30'")
def filter_hour_wrap(spark, d):
    return sm.filter_by_key(_meta(spark, d), "ts", "%H:%M", ("22:00", "04:30")).select("rec_id", sm.date_key(F.col("ts"), "%H:%M").alias("k"))


@q("SELECT r.rec_id, r.roi_id, r.label, m.sensor_name, m.sample_rate FROM (SELECT DISTINCT rec_id, roi_id, label FROM roi) r LEFT JOIN audio_metadata m USING (rec_id)")
def join_left_features(spark, d):
    r = table(spark, d, "roi").select("rec_id", "roi_id", "label").distinct()
    return r.join(table(spark, d, "audio_metadata").select("rec_id", "sensor_name", "sample_rate"), "rec_id", "left")


@q("SELECT rec_id, sensor_name FROM audio_metadata WHERE rec_id IN (SELECT rec_id FROM roi)")
def semi_join_labels(spark, d):
    return table(spark, d, "audio_metadata").join(table(spark, d, "roi"), "rec_id", "left_semi").select("rec_id", "sensor_name")


@q("SELECT rec_id, sensor_name FROM audio_metadata WHERE rec_id NOT IN (SELECT rec_id FROM roi WHERE rec_id IS NOT NULL)")
def anti_join_labels(spark, d):
    return table(spark, d, "audio_metadata").join(table(spark, d, "roi"), "rec_id", "left_anti").select("rec_id", "sensor_name")


@q("""WITH m AS (SELECT sensor_name, epoch_us(date) AS at, max(rec_id) AS rid FROM audio_metadata WHERE sensor_name IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2)
  SELECT s.sensor_name, s.at, s.stamp_id, m.at AS matched_at, m.rid AS matched FROM (SELECT DISTINCT stamp_id, sensor_name, epoch_us(loaded_at) AS at FROM stamp_raw) s ASOF LEFT JOIN m ON s.sensor_name = m.sensor_name AND s.at >= m.at""")
def asof_nearest(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    left = table(spark, d, "stamp_raw").select("stamp_id", "sensor_name", us("loaded_at").alias("at")).distinct()
    right = table(spark, d, "audio_metadata").select("sensor_name", us("date").alias("at"), F.col("rec_id").alias("rid"))
    return rl.asof_join(left, right, "sensor_name", "at", "rid", 30 * 86_400_000_000)


@q("SELECT rec_id, roi_id, band, count(*) AS n FROM roi JOIN (VALUES ('low', 0, 1000), ('mid', 1000, 10000), ('high', 10000, 20000)) AS b(band, lo, hi) ON (min_f + max_f) / 2 BETWEEN lo AND hi GROUP BY 1, 2, 3")
def range_join_bands(spark, d):
    joined = rl.range_join(table(spark, d, "roi"), BANDS, (F.col("min_f") + F.col("max_f")) / 2)
    return joined.groupBy("rec_id", "roi_id", "band").agg(F.count(F.lit(1)).alias("n"))


@q("WITH n AS (SELECT unnest(['aci', 'bi', 'hf', 'ndsi']) AS x) SELECT a.x AS red, b.x AS green, c.x AS blue FROM n a, n b, n c WHERE a.x <> b.x AND b.x <> c.x AND a.x <> c.x")
def cross_triplets(spark, d):
    return rl.triplets(spark, ["aci", "bi", "hf", "ndsi"])


@q("SELECT site AS place, 'stamp' AS kind, count(*) AS n FROM stamp_raw GROUP BY 1 UNION ALL SELECT loc, 'catalogue', count(*) FROM catalogue GROUP BY 1")
def union_recordings(spark, d):
    a = table(spark, d, "stamp_raw").groupBy(F.col("site").alias("place")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("stamp"))
    b = table(spark, d, "catalogue").groupBy(F.col("loc").alias("place")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("catalogue"))
    return a.unionByName(b).select("place", "kind", "n")


@q("SELECT DISTINCT gen, sp FROM catalogue")
def distinct_species(spark, d):
    return table(spark, d, "catalogue").select("gen", "sp").distinct()


@q("SELECT rec_id FROM audio_metadata EXCEPT SELECT rec_id FROM label_line")
def except_ids(spark, d):
    return table(spark, d, "audio_metadata").select("rec_id").exceptAll(table(spark, d, "label_line").select("rec_id").distinct()).distinct()


@q("""WITH c AS (SELECT DISTINCT id, gen, sp, q, CASE WHEN length(trim(length)) = 4 THEN '0' || trim(length) ELSE trim(length) END AS length FROM catalogue)
  SELECT id, gen, sp, q, length, rk AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY gen, sp ORDER BY q, length DESC, id) AS INTEGER) AS rk FROM c WHERE q IN ('A', 'B') AND length BETWEEN '00:10' AND '01:00') WHERE rk <= 5""")
def topk_selection(spark, d):
    t = F.trim("length")
    c = table(spark, d, "catalogue").select("id", "gen", "sp", "q", F.when(F.length(t) == 4, F.concat(F.lit("0"), t)).otherwise(t).alias("length")).distinct()
    return catalogue.selection(c, 5)


@q(f"WITH {META}, h AS (SELECT CAST(hour(ts) AS BIGINT) AS hour, 'sr_' || sample_rate AS rate FROM meta WHERE ts IS NOT NULL) FROM (PIVOT h ON rate USING count(*) GROUP BY hour)")
def pivot_hour(spark, d):
    """A column for every sample rate."""
    hours = _meta(spark, d).where("ts is not null").select(F.hour("ts").cast("long").alias("hour"), "sample_rate")
    return rl.counts_by_value(hours, "hour", "sample_rate", "sr_")


@q(f"WITH {META} SELECT time_bucket(INTERVAL '30 minutes', ts) AS bucket, {R('avg(length)', 'mean', 9)}, {R('stddev_samp(length)', 'std', 9)}, count(length) AS n FROM meta WHERE ts IS NOT NULL GROUP BY 1")
def resample_30min(spark, d):
    r = sm.resample(_meta(spark, d).where("ts is not null"), "ts", "length")
    return rounded(r.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")), 9)


@q("WITH n AS (SELECT unnest(['length', 'fsize', 'samples']) AS x), v AS (SELECT length, fsize::DOUBLE AS fsize, samples::DOUBLE AS samples FROM audio_metadata), c AS (SELECT corr(length, fsize) AS lf, corr(length, samples) AS ls, corr(fsize, samples) AS fs FROM v) SELECT a.x AS a, b.x AS b, round(CASE WHEN a.x = b.x THEN 1 WHEN least(a.x, b.x) = 'fsize' AND greatest(a.x, b.x) = 'length' THEN lf WHEN least(a.x, b.x) = 'length' THEN ls ELSE fs END, 6) + CAST(0 AS DOUBLE) AS r FROM n a, n b, c")
def corr_matrix(spark, d):
    m = table(spark, d, "audio_metadata").select("length", F.col("fsize").cast("double").alias("fsize"), F.col("samples").cast("double").alias("samples"))
    return rounded(rl.correlation(m, ["length", "fsize", "samples"]))


@q(f"WITH {META}, o AS (SELECT strftime(ts, '%V') AS date_key, strftime(ts, '%H:%M') AS hm, avg(length) AS m FROM meta WHERE ts IS NOT NULL GROUP BY 1, 2) SELECT date_key, CAST(floor((CAST(hm[1:2] AS INT) * 60 + CAST(hm[4:5] AS INT)) / 30) * 30 AS BIGINT) AS minute, {R('avg(m)', 'mean', 9)} FROM o GROUP BY 1, 2")
def heatmap_date_time(spark, d):
    return rounded(sm.heatmap(_meta(spark, d).where("ts is not null"), "ts", "length"), 9)


@q(f"WITH {META}, h AS (SELECT CAST(hour(ts) AS BIGINT) AS hour, avg(length) AS length, avg(fsize) AS fsize FROM meta WHERE ts IS NOT NULL GROUP BY 1) SELECT hour, {R('(length - min(length) OVER ()) / (max(length) OVER () - min(length) OVER ())', 'length')}, {R('(fsize - min(fsize) OVER ()) / (max(fsize) OVER () - min(fsize) OVER ())', 'fsize')} FROM h")
def hourly_mean_normalised(spark, d):
    return rounded(sm.hourly_normalised(_meta(spark, d).where("ts is not null"), "ts", ["length", "fsize"]))


@q(f"""WITH {SPEC}, m AS (SELECT *, max(t_idx) OVER (PARTITION BY rec_id) AS tm, max(p) OVER (PARTITION BY rec_id, f_idx ORDER BY t_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m1 FROM spec),
  n AS (SELECT *, max(m1) OVER (PARTITION BY rec_id, t_idx ORDER BY f_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m2 FROM m),
  k AS (SELECT rec_id, f_idx, count(*) AS n FROM n WHERE p = m2 AND p > 0.1 AND t_idx BETWEEN 1 AND tm - 1 AND f_idx BETWEEN 1 AND 62 GROUP BY 1, 2),
  e AS (SELECT rec_id, max(t_idx) + 1 AS nf, rec_id % 3 AS hour FROM spec GROUP BY 1), g AS (SELECT *, unnest(range(0, 64)) AS f_idx FROM e)
  SELECT hour, g.f_idx, {R('avg(coalesce(n, 0) / nf::DOUBLE)', 'density')} FROM g LEFT JOIN k ON k.rec_id = g.rec_id AND k.f_idx = g.f_idx GROUP BY 1, 2""")
def graphical_soundscape(spark, d):
    power = frames(spark, d).select("rec_id", "t_idx", F.transform("v", lambda a: a * a).alias("v"))
    # the hour comes with the recording's name here, so no join brings it
    dens = ft.peak_density(power, 0.1).withColumn("hour", F.col("rec_id") % 3)
    return rounded(dens.groupBy("hour", "f_idx").agg(F.avg("density").alias("density")))


@q(f"""WITH {SPEC}, f AS (SELECT rec_id, f_idx, avg(p) AS m, var_pop(p) AS v, max(p) AS x FROM spec GROUP BY 1, 2),
  l AS (SELECT quantile_cont(m, 0.01) AS ml, quantile_cont(m, 0.99) AS mh, quantile_cont(v, 0.01) AS vl, quantile_cont(v, 0.99) AS vh, quantile_cont(x, 0.01) AS xl, quantile_cont(x, 0.99) AS xh FROM f)
  SELECT rec_id, f_idx, CAST(round((least(greatest(m, ml), mh) - ml) / (mh - ml) * 255) AS BIGINT) AS r, CAST(round((least(greatest(v, vl), vh) - vl) / (vh - vl) * 255) AS BIGINT) AS g, CAST(round((least(greatest(x, xl), xh) - xl) / (xh - xl) * 255) AS BIGINT) AS b FROM f, l""")
def false_colour_rgb(spark, d):
    f = cells(spark, d).groupBy("rec_id", "f_idx").agg(F.avg("p").alias("m"), F.var_pop("p").alias("v"), F.max("p").alias("x"))
    return sm.false_colour(f, "m", "v", "x")


@q(f"WITH {SPEC} SELECT rec_id % 3 AS hour, CAST(floor(fn / 1000) AS BIGINT) AS khz, {R('10 * log10(sum(p) / count(DISTINCT (rec_id, t_idx)))', 'leq')} FROM spec GROUP BY 1, 2")
def leq_band_24h(spark, d):
    c = cells(spark, d).groupBy((F.col("rec_id") % 3).alias("hour"), F.floor(F.col("fn") / 1000).cast("long").alias("khz"), "rec_id", "t_idx").agg(F.sum("p").alias("p"))
    return rounded(c.groupBy("hour", "khz").agg((10 * F.log10(F.avg("p"))).alias("leq")))


@q(f"""WITH c AS (SELECT gen, sp, (CAST(split_part(time, ':', 1) AS BIGINT) * 60 + CAST(split_part(time, ':', 2) AS BIGINT)) // 30 * 30 AS minute, count(*) AS n FROM catalogue WHERE regexp_full_match(time, '([01]?[0-9]|2[0-3]):[0-5][0-9]') GROUP BY 1, 2, 3),
  u AS (SELECT *, CAST(sum(n) OVER (PARTITION BY gen, sp ORDER BY n DESC, minute ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto, sum(n) OVER (PARTITION BY gen, sp) AS total FROM c),
  l AS (SELECT *, min(n) FILTER (WHERE upto - n < 0.5 * total) OVER (PARTITION BY gen, sp) AS least FROM u)
  SELECT gen, sp, minute, n, {R('upto / total', 'cumulative')} FROM l WHERE n >= least""")
def activity_threshold_50(spark, d):
    """With H:MM times and all tied buckets."""
    t = table(spark, d, "catalogue").where(F.col("time").rlike("^(?:[01]?[0-9]|2[0-3]):[0-5][0-9]$")).withColumn("time", F.lpad("time", 5, "0"))
    minute = (F.floor((F.substring("time", 1, 2).cast("int") * 60 + F.substring("time", 4, 2).cast("int")) / 30) * 30).cast("long")
    return rounded(sm.threshold_buckets(t.groupBy("gen", "sp", minute.alias("minute")).agg(F.count(F.lit(1)).alias("n")), ["gen", "sp"], "minute", "n"))


_WELL = "regexp_full_match(fname, '[^_]*_[0-9]{8}_[0-9]{6}.{4}')"


@q(f"SELECT rec_id, CASE WHEN fname IS NULL OR sample_rate IS NULL THEN 1 WHEN {_WELL} THEN 0 ELSE 2 END AS flag, CASE WHEN {_WELL} THEN split_part(fname, '_', 1) END AS sensor, CASE WHEN {_WELL} THEN try_strptime(split_part(fname, '_', 2) || split_part(fname, '_', 3)[1:6], '%Y%m%d%H%M%S') END AS stamp, CASE WHEN {_WELL} THEN split_part(fname, '_', 3)[1:6] END AS hms FROM audio_metadata")
def filename_parse(spark, d):
    m = table(spark, d, "audio_metadata")
    sensor, stamp, hms = metadata.filename_info(F.col("fname"))
    flag = metadata.file_check(F.col("fname"), F.col("sample_rate").isNotNull())
    return m.select("rec_id", flag.alias("flag"), sensor.alias("sensor"), stamp.cast("timestamp_ntz").alias("stamp"), hms.alias("hms"))


_RX = metadata.date_pattern("%Y%m%d_%H%M%S")


@q(f"SELECT rec_id, coalesce(try_strptime(regexp_extract(n, '({_RX})', 1), '%Y%m%d_%H%M%S'), TIMESTAMP '1900-01-01 00:00:01') AS stamp FROM (SELECT rec_id, regexp_extract(path_audio, '([^/\\\\]*)$', 1) AS n FROM audio_metadata)")
def date_parse_fallback(spark, d):
    name = metadata.basename(F.col("path_audio"))
    return table(spark, d, "audio_metadata").select("rec_id", metadata.parsed_date(name).cast("timestamp_ntz").alias("stamp"))


ROI1 = "r AS (SELECT DISTINCT ON (rec_id, roi_id) * FROM roi WHERE min_t IS NOT NULL AND max_t IS NOT NULL AND min_f IS NOT NULL AND max_f IS NOT NULL ORDER BY rec_id, roi_id, min_t, max_t, label)"


def _rois(spark, d):
    return table(spark, d, "roi").where("min_t is not null and max_t is not null and min_f is not null and max_f is not null").dropDuplicates(["rec_id", "roi_id"])


@q(f"WITH {ROI1} SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY min_t, max_t, label NULLS FIRST, roi_id) * 2 - 1 AS line_no, coalesce(label, '') AS label, round(min_t, 6) AS min_t, round(min_f, 6) AS min_f, round(max_t, 6) AS max_t, round(max_f, 6) AS max_f FROM r")
def annotation_pairs_roundtrip(spark, d):
    return annotations.from_audacity(annotations.to_audacity(_rois(spark, d)))


@q(f"WITH {ROI1} SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY min_t, max_t, roi_id) AS \"Selection\", 'Spectrogram 1' AS \"View\", CAST(1 AS BIGINT) AS \"Channel\", min_t AS \"Begin Time (s)\", max_t AS \"End Time (s)\", min_f AS \"Low Freq (Hz)\", max_f AS \"High Freq (Hz)\", label FROM r")
def raven_export(spark, d):
    return annotations.to_raven(_rois(spark, d), extra=["label"])


_T, _D = "'([01]?[0-9]|2[0-3]):[0-5][0-9]'", "'(20|19)[0-9]{2}-(0[1-9]|1[0-2])-(0?[1-9]|[12][0-9]|3[01])'"


@q(f"""WITH c AS (SELECT id, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lng AS DOUBLE) AS lng, CASE WHEN length(length) = 4 THEN '0' || length ELSE length END AS length, lpad(time, 5, '0') AS time, try_strptime(date || ' ' || lpad(time, 5, '0'), '%Y-%m-%d %H:%M') AS datetime
    FROM catalogue WHERE regexp_full_match(time, {_T}) AND regexp_full_match(date, {_D}))
  SELECT id, lat, lng, length, time, datetime, CAST(weekofyear(datetime) AS BIGINT) AS week FROM c WHERE datetime IS NOT NULL""")
def catalogue_clean(spark, d):
    c = catalogue.cleaned(table(spark, d, "catalogue")).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    return c.select("id", "lat", "lng", "length", "time", "datetime", "week")


@q("SELECT " + ", ".join(catalogue.FIELDS) + " FROM catalogue")
def json_catalogue(spark, d):
    return catalogue.from_json(catalogue.to_json(table(spark, d, "catalogue")))


@q("SELECT id, 'audio/birds/' || coalesce(gen, '') || ' ' || coalesce(sp, '') || '_' || coalesce(en, '') || '/XC' || id || '.' || lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) AS path FROM catalogue WHERE file_name IS NOT NULL")
def download_paths(spark, d):
    return catalogue.local_paths(table(spark, d, "catalogue").where("file_name is not null"), "audio", "birds").select("id", "path")

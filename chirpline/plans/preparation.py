"""Queries of the data-preparation operators of the core: p1 to p6."""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.operators import capping, compaction, intervals, regular_grid, row_parser, timestamps
from chirpline.session import checkpoint, staging_path, table


def p1_plan(spark: SparkSession, d: str) -> DataFrame:
    """The written and verified plan that consolidates the archive's files."""
    return compaction.consolidation(compaction.combined_scan(spark, f"{d}/audio_metadata.parquet", ["path_audio", "fsize"]))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.small_file_folders(p1_plan(spark, d))


def p1_packs(spark: SparkSession, d: str) -> DataFrame:
    return p1_plan(spark, d)


def p1_compacted(spark: SparkSession, d: str, rows_per_file: int = 2000) -> DataFrame:
    """The listing stored as very many small files and consolidated again: rows, distinct recordings and bytes by sensor, from the verified copy."""
    folder = staging_path(spark, "scattered")
    compaction.scattered(table(spark, d, "audio_metadata").select("rec_id", "sensor_name", "path_audio", "fsize"), folder, rows_per_file)
    copy = compaction.compact(spark, folder)
    return copy.groupBy("sensor_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("rec_id").alias("n_ids"), F.sum("fsize").alias("n_bytes"))


def p2_series(spark: SparkSession, d: str) -> DataFrame:
    series = regular_grid.regular_series(table(spark, d, "audio_metadata"), table(spark, d, "deployment"))
    return series.withColumn("seconds", F.round("seconds", 3) + F.lit(0.0))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.empty_slots(regular_grid.slot_readings(table(spark, d, "audio_metadata"), table(spark, d, "deployment")))


def p3_stamps(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalised_stamps(table(spark, d, "stamp_raw"), table(spark, d, "catalogue"), table(spark, d, "site"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.instants(p3_stamps(spark, d))


def p3_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone of every place as estimated from its stamps alone, beside the declared one."""
    site = table(spark, d, "site")
    stamps = timestamps.stamps_of(table(spark, d, "stamp_raw"), table(spark, d, "catalogue"), site).withColumn("zone", F.lit(None).cast("string"))
    best = timestamps.place_zones(checkpoint(timestamps.read_stamps(stamps)), timestamps.candidate_zones(site))
    return best.join(site.select(F.col("site").alias("place"), F.col("tz").alias("declared")), "place", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return row_parser.faulty_lines(table(spark, d, "label_line"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return row_parser.label_records(table(spark, d, "label_line"))


def p4_all(spark: SparkSession, d: str) -> DataFrame:
    """Valid and salvaged records with their place in the line."""
    return row_parser.all_records(table(spark, d, "label_line"))


def p4_salvaged(spark: SparkSession, d: str) -> DataFrame:
    return row_parser.salvaged_records(table(spark, d, "label_line"))


def p4_faults(spark: SparkSession, d: str) -> DataFrame:
    return row_parser.located_faults(table(spark, d, "label_line"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return capping.capped_catalogue(table(spark, d, "catalogue"))


def p5_shared(spark: SparkSession, d: str) -> DataFrame:
    """Records capped by recordist and by place at once."""
    return capping.shared_catalogue(table(spark, d, "catalogue"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.roi_periods(table(spark, d, "roi"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_packs, p1_compacted, p2_found, p2_series, p3_found, p3_stamps, p3_zones, p4_found, p4_records, p4_all, p4_salvaged, p4_faults, p5_found, p5_shared, p6_found)
}

# Label lines by regular expressions: FIELD is a quoted or plain field, NUM a decimal number.
LINES = r"""
        WITH t AS (SELECT DISTINCT rec_id, CAST(line_no AS BIGINT) AS line_no, regexp_replace(coalesce(line, ''), '\r$', '') AS line FROM label_line),
        f AS (SELECT *, regexp_full_match(line, FIELD || '(\t' || FIELD || ')*') AS quotes, regexp_full_match(line, FIELD || '\t' || FIELD || '\t' || FIELD) AS three,
            regexp_extract(line, '^(' || FIELD || ')\t(' || FIELD || ')\t(' || FIELD || ')$', ['a', 'b', 'c']) AS x FROM t),
        u AS (SELECT *, list_transform([x['a'], x['b'], x['c']], lambda v: CASE WHEN starts_with(v, '"') THEN replace(v[2:-2], '""', '"') ELSE v END) AS v FROM f),
        b AS (SELECT *, CASE WHEN v[1] = '\' THEN v[2] ELSE v[1] END AS lo, CASE WHEN v[1] = '\' THEN v[3] ELSE v[2] END AS hi FROM u),
        n AS (SELECT *, CASE WHEN regexp_full_match(lo, NUM) THEN TRY_CAST(ltrim(trim(lo), '+') AS DOUBLE) END AS l, CASE WHEN regexp_full_match(hi, NUM) THEN TRY_CAST(ltrim(trim(hi), '+') AS DOUBLE) END AS h FROM b),
        r AS (SELECT *, CASE WHEN NOT quotes THEN 'quoting' WHEN NOT three THEN 'columns'
            WHEN l IS NULL OR h IS NULL OR isinf(l) OR isinf(h) OR l < 0 OR h < 0 OR h < l THEN 'value' END AS reason FROM n)""".replace(
    "FIELD", r"""'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'"""
).replace("NUM", "' *[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)? *'")

def _abbreviation_rows() -> str:
    """(zone, abbreviation, offset in seconds) of all zones, for SQL."""
    rows = [
        f"('{z}', '{name}', {int(o.total_seconds())})"
        for z in sorted(zoneinfo.available_timezones())
        for name, offsets in sorted(timestamps._abbreviations(z).items())
        if name.isalpha() and len(name) <= 5 and "/" in z and not z.startswith(("posix", "right", "Etc"))
        for o in sorted(offsets)
    ]
    return "(VALUES " + ", ".join(rows) + ") AS ab(zone, name, off)"


def stamps_sql() -> str:
    """The instants of stamps by regular expressions. One reading after the other takes its part of the text off."""
    months = "(VALUES " + ", ".join(f"('{name}', {m})" for name, m in timestamps.MONTHS.items()) + ") AS mo(name, m)"
    return rf"""
        WITH s AS (
          SELECT 'stamp_raw' AS src, CAST(stamp_id AS BIGINT) AS row_id, date, time, tz, date_order FROM stamp_raw LEFT JOIN site USING (site)
          UNION ALL SELECT 'catalogue', TRY_CAST(trim(id) AS BIGINT), date, time, tz, date_order FROM catalogue LEFT JOIN site USING (loc)),
        a AS (SELECT DISTINCT src, row_id, tz, date_order AS o, regexp_replace(regexp_replace(date, '^\s+|\s+$', '', 'g'), '(?i)\.(wav|flac|mp3|ogg)$', '') AS d, regexp_replace(coalesce(time, ''), '^\s+|\s+$', '', 'g') AS t
          FROM s WHERE row_id IS NOT NULL AND date IS NOT NULL),
        u AS (SELECT *, NOT regexp_matches(t, '[0-9]') AND (regexp_full_match(d, '[0-9]+') AND len(d) NOT IN (12, 14) OR regexp_full_match(d, '(0x)?[0-9A-Fa-f]{{8}}')) AS bare FROM a WHERE d <> ''),
        n AS (SELECT src, row_id, d, regexp_full_match(d, '[0-9]+') AS digits, list_reduce(list_transform(string_split(lower(right(d, 8)), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda x, y: x * 16 + y) AS hex FROM u WHERE bare AND len(d) <= 18),
        ux AS (SELECT src, row_id, list_filter(CASE WHEN NOT digits THEN [hex * 1000000] WHEN len(d) = 8 AND d[1:4] BETWEEN '1900' AND '2099' THEN [] ELSE list_concat([CAST(d AS HUGEINT) * 1000000, CAST(d AS HUGEINT) * 1000, CAST(d AS HUGEINT)], CASE WHEN len(d) = 8 THEN [CAST(hex AS HUGEINT) * 1000000] ELSE [] END) END,
          lambda x: x >= 1420070400000000 AND x < 1924992000000000) AS c FROM n),
        b AS (SELECT src, row_id, tz, o, t, CASE WHEN regexp_full_match(d, '([A-Za-z][A-Za-z0-9]*[_-])?[0-9]{{8}}[_-]?[0-9]{{6}}Z?') THEN regexp_replace(regexp_extract(d, '([0-9]{{8}}[_-]?[0-9]{{6}}Z?)$', 1), '^(.{{8}})[_-]*', '\1 ')
          WHEN regexp_full_match(d, '[0-9]{{12}}|[0-9]{{14}}') THEN d[1:8] || ' ' || d[9:] ELSE d END AS d FROM u WHERE NOT bare),
        w AS (SELECT *, lower(regexp_extract(d, '^(\pL{{2,10}})\.?, +', 1))[1:3] AS wd, regexp_replace(d, '^\pL{{2,10}}\.?, +', '') AS e FROM b),
        x AS (SELECT *, regexp_extract(e, '(?s)^([0-9]{{4}})([-/.])([0-9]{{1,2}})([-/.])([0-9]{{1,2}})((?:[^0-9].*)?)$', ['y', 's', 'm', 'z', 'd', 'r']) AS q1, regexp_extract(e, '(?s)^([0-9]{{1,2}})([-/.])([0-9]{{1,2}})([-/.])([0-9]{{4}})((?:[^0-9].*)?)$', ['a', 's', 'b', 'z', 'y', 'r']) AS q2,
            regexp_extract(e, '(?s)^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})((?:[^0-9].*)?)$', ['y', 'm', 'd', 'r']) AS q3, regexp_extract(e, '(?is)^([0-9]{{1,2}})(?:\.|st|nd|rd|th)? +(?:de +)?(\pL+)\.?,? +(?:de +)?([0-9]{{4}})((?:[^0-9].*)?)$', ['d', 'm', 'y', 'r']) AS q4,
            regexp_extract(e, '(?is)^(\pL+)\.? +([0-9]{{1,2}})(?:st|nd|rd|th)?,? +([0-9]{{4}})((?:[^0-9].*)?)$', ['m', 'd', 'y', 'r']) AS q5 FROM w WHERE wd IN ('', 'mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun')),
        y AS (
          SELECT src, row_id, tz, t, wd, q1['y'] AS y, q1['m'] AS m, q1['d'] AS d, q1['r'] AS r FROM x WHERE q1['y'] <> '' AND q1['s'] = q1['z']
          UNION ALL SELECT src, row_id, tz, t, wd, q2['y'], q2['b'], q2['a'], q2['r'] FROM x WHERE q2['y'] <> '' AND q2['s'] = q2['z'] AND coalesce(o, 'DMY') <> 'MDY'
          UNION ALL SELECT src, row_id, tz, t, wd, q2['y'], q2['a'], q2['b'], q2['r'] FROM x WHERE q2['y'] <> '' AND q2['s'] = q2['z'] AND coalesce(o, 'MDY') <> 'DMY'
          UNION ALL SELECT src, row_id, tz, t, wd, q3['y'], q3['m'], q3['d'], q3['r'] FROM x WHERE q3['y'] <> ''
          UNION ALL SELECT src, row_id, tz, t, wd, q4['y'], CAST(m AS VARCHAR), q4['d'], q4['r'] FROM x JOIN {months} ON name = lower(q4['m']) WHERE q4['y'] <> ''
          UNION ALL SELECT src, row_id, tz, t, wd, q5['y'], CAST(m AS VARCHAR), q5['d'], q5['r'] FROM x JOIN {months} ON name = lower(q5['m']) WHERE q5['y'] <> ''),
        k AS (SELECT *, CASE WHEN r <> '' THEN r ELSE t END AS k FROM (SELECT * REPLACE (CASE WHEN regexp_matches(r, '^[Tt_][0-9]') THEN r[2:] ELSE ltrim(r, ' ,') END AS r) FROM y) WHERE NOT (r <> '' AND regexp_matches(t, '[0-9]'))),
        c AS (SELECT *, regexp_extract(k, '(?is)^([0-9]{{1,2}})[:.h]([0-9]{{2}})(?:[:.]([0-9]{{2}})(?:[.,]([0-9]{{1,9}}))?)?((?:[^0-9].*)?)$', ['h', 'm', 's', 'f', 'r']) AS c1, regexp_extract(k, '(?s)^([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})?(?:[.,]([0-9]{{1,9}}))?((?:[^0-9].*)?)$', ['h', 'm', 's', 'f', 'r']) AS c2 FROM k),
        h AS (SELECT *, CASE WHEN c1['h'] <> '' THEN c1 ELSE c2 END AS c, CASE WHEN c1['h'] <> '' THEN regexp_extract(c1['r'], '(?is)^ *([ap]\.?m\.?)((?:[^\pL].*)?)$', ['p', 'r']) ELSE {{'p': '', 'r': ''}} END AS p FROM c WHERE c1['h'] <> '' OR c2['h'] <> ''),
        l AS (SELECT src, row_id, tz, wd, y, m, d, CAST(c['h'] AS INT) AS hh, CAST(c['m'] AS INT) AS mi, CAST(CASE WHEN c['s'] = '' THEN '0' ELSE c['s'] END AS INT) AS ss, CAST(rpad(c['f'], 6, '0')[1:6] AS BIGINT) AS us, lower(p['p'])[1:1] AS half,
          regexp_replace(CASE WHEN p['p'] <> '' THEN p['r'] ELSE c['r'] END, '^\s+|\s+$', '', 'g') AS tail FROM h),
        v AS (SELECT *, TRY_CAST(y || '-' || m || '-' || d AS DATE) AS day, CASE WHEN half = '' THEN hh WHEN hh BETWEEN 1 AND 12 THEN hh % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END ELSE 99 END AS hour,
          regexp_extract(tail, '(?s)^(?:UTC|GMT)?([+-])([0-9]{{2}}):?([0-9]{{2}})?((?:[^0-9].*)?)$', ['sign', 'h', 'm', 'r']) AS f, regexp_extract(tail, '^\[([A-Za-z]+(?:[/_+-][A-Za-z0-9_+-]+)*)\]$', 1) AS named, regexp_extract(tail, '(?s)^\(?([A-Za-z]{{1,5}})\)?(.*)$', ['n', 'r']) AS abb FROM l),
        g AS (SELECT src, row_id, tz, epoch_us(CAST(day AS TIMESTAMP)) + CAST((hour * 60 + mi) * 60 + ss AS BIGINT) * 1000000 + us AS local,
            CASE WHEN tail = '' THEN 'none' WHEN f['sign'] <> '' THEN CASE WHEN regexp_full_match(trim(f['r']), '|\[[A-Za-z]+(?:[/_+-][A-Za-z0-9_+-]+)*\]|\(?[A-Za-z]{{1,5}}\)?') AND CAST(f['h'] AS INT) <= 14 AND f['m'] <= '59' THEN 'offset' END
              WHEN named <> '' THEN 'zone' WHEN abb['n'] <> '' AND regexp_full_match(trim(abb['r']), '|\[[A-Za-z]+(?:[/_+-][A-Za-z0-9_+-]+)*\]') THEN CASE WHEN upper(abb['n']) IN ('Z', 'UTC', 'GMT', 'UT') THEN 'utc' ELSE 'abbreviation' END END AS kind,
            CASE WHEN f['sign'] = '-' THEN -1 ELSE 1 END * (TRY_CAST(f['h'] AS BIGINT) * 60 + coalesce(TRY_CAST(f['m'] AS BIGINT), 0)) * 60000000 AS off, named, upper(abb['n']) AS abb
          FROM v WHERE day IS NOT NULL AND year(day) BETWEEN 1971 AND 2100 AND hour <= 23 AND mi <= 59 AND ss <= 59 AND (wd = '' OR lower(strftime(day, '%a')) = wd)),
        z AS (SELECT src, row_id, local, kind, abb, CASE WHEN kind = 'zone' THEN named ELSE tz END AS zone FROM g WHERE kind IN ('none', 'zone', 'abbreviation')),
        zz AS (SELECT *, unnest([-86400000000, 86400000000]) AS away FROM z WHERE zone IN (SELECT name FROM pg_timezone_names())),
        zo AS (SELECT DISTINCT src, row_id, local, kind, abb, zone, epoch_us(timezone(zone, make_timestamptz(local + away))) - (local + away) AS off FROM zz),
        ok AS (SELECT * FROM zo WHERE epoch_us(timezone(zone, make_timestamptz(local - off))) = local),
        instant AS (
          SELECT src, row_id, CAST(c[1] AS BIGINT) AS us FROM ux WHERE len(c) = 1
          UNION ALL SELECT src, row_id, local - CASE WHEN kind = 'offset' THEN off ELSE 0 END FROM g WHERE kind IN ('offset', 'utc')
          UNION ALL SELECT src, row_id, local - off FROM ok WHERE kind <> 'abbreviation'
          UNION ALL SELECT z.src, z.row_id, z.local - coalesce(ok.off, CAST(ab.off AS BIGINT) * 1000000) FROM z JOIN {_abbreviation_rows()} ON ab.zone = z.zone AND ab.name = z.abb LEFT JOIN ok ON ok.src = z.src AND ok.row_id = z.row_id AND ok.local = z.local AND ok.zone = z.zone AND ok.kind = z.kind AND ok.off = CAST(ab.off AS BIGINT) * 1000000 WHERE z.kind = 'abbreviation'),
        once AS (SELECT src, row_id, min(us) AS us FROM instant GROUP BY 1, 2 HAVING count(DISTINCT us) = 1)
        SELECT src, row_id, us AS epoch_us FROM once WHERE us >= 1420070400000000 AND us < 1924992000000000"""


PLACES = r"""t AS (
          SELECT '/' || list_aggregate(list_filter(string_split(
                   regexp_replace(replace(path_audio, '\', '/'), '^[A-Za-z][A-Za-z0-9+.-]+:(//(localhost)?)?/', '/'), '/'),
                   lambda x: x <> '' AND x <> '.'), 'string_agg', '/') AS path, fsize
          FROM audio_metadata WHERE path_audio IS NOT NULL),
        f AS (SELECT path, max(fsize) AS n_bytes FROM t GROUP BY path)"""

# Catalogue rows with id as a number, grade and length in seconds.
GRADED = """c AS (
          SELECT TRY_CAST(trim(id) AS BIGINT) AS id, rec, loc,
            CASE WHEN upper(trim(q)) IN ('A', 'B', 'C', 'D', 'E') THEN ascii(upper(trim(q))) - 65 ELSE 5 END AS grade,
            CASE WHEN regexp_full_match(trim(length), '[0-9]+:[0-5]?[0-9]:[0-5][0-9]|[0-9]+:[0-5][0-9]') THEN
              list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(trim(length), ':'), lambda x: CAST(x AS BIGINT))), lambda a, b: a * 60 + b)
              ELSE -1 END AS len
          FROM catalogue)"""

ORACLES: dict[str, str] = {
    "p1_found": f"""
        WITH {PLACES} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes
        FROM f WHERE n_bytes < 1048576 GROUP BY 1 HAVING count(*) >= 2""",
    # next fit on shelves of 64 * 128 MiB, pack by pack: a pack takes the files up to the last one that fits
    "p1_packs": f"""
        WITH RECURSIVE {PLACES},
        w AS (SELECT path, coalesce(n_bytes, 0) AS n, n_bytes IS NULL AS unknown, coalesce(n_bytes, 0) + 4194304 AS w FROM f),
        s AS (SELECT *, CAST(coalesce(sum(w) OVER (ORDER BY unknown, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 8589934592 AS BIGINT) AS shelf FROM w),
        o AS (SELECT *, row_number() OVER (PARTITION BY shelf ORDER BY unknown, path) AS i, CAST(sum(w) OVER (PARTITION BY shelf ORDER BY unknown, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM s),
        p AS (
          SELECT shelf, CAST(0 AS BIGINT) AS pack, CAST(1 AS BIGINT) AS a FROM o GROUP BY shelf
          UNION ALL
          SELECT p.shelf, p.pack + 1, min(x.i) FROM p JOIN o b ON b.shelf = p.shelf AND b.i = p.a JOIN o x ON x.shelf = p.shelf AND x.i > p.a
          WHERE x.upto - x.w + x.n - (b.upto - b.w) > 134217728 OR x.unknown <> b.unknown GROUP BY 1, 2),
        e AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY shelf ORDER BY pack) - 1, 9223372036854775807) AS z FROM p)
        SELECT o.path, CASE WHEN NOT o.unknown THEN o.n END AS n_bytes, e.shelf * 4294967296 + e.pack AS pack_id, o.i - e.a AS seq,
          CASE WHEN NOT o.unknown THEN CAST(sum(o.n) OVER (PARTITION BY e.shelf, e.pack ORDER BY o.i ROWS UNBOUNDED PRECEDING) AS BIGINT) - o.n END AS "offset"
        FROM o JOIN e ON e.shelf = o.shelf AND o.i BETWEEN e.a AND e.z""",
    "p1_compacted": """
        SELECT sensor_name, count(*) AS n_rows, count(DISTINCT rec_id) AS n_ids, CAST(sum(fsize) AS BIGINT) AS n_bytes FROM audio_metadata GROUP BY 1""",
    "p2_found": """
        WITH d AS (
          SELECT DISTINCT deploy_id, sensor_name, epoch_us(start_at) AS s, epoch_us(end_at) AS e, CAST(step_s AS BIGINT) * 1000000 AS st
          FROM deployment WHERE step_s > 0 AND end_at > start_at AND sensor_name IS NOT NULL),
        g AS (
          SELECT sensor_name, s + k * st AS a, least(s + (k + 1) * st, e) AS b
          FROM (SELECT *, unnest(range(0, CAST(ceil((e - s) / st) AS BIGINT))) AS k FROM d)),
        r AS (
          SELECT DISTINCT sensor_name, epoch_us(date) AS a, epoch_us(date) + CAST(ceil(round(length * 1e6, 3)) AS BIGINT) AS b
          FROM audio_metadata WHERE sensor_name IS NOT NULL AND date IS NOT NULL AND length > 0 AND NOT isnan(length) AND NOT isinf(length))
        SELECT DISTINCT sensor_name, CAST(a // 1000000 AS BIGINT) AS slot_at FROM g
        WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.sensor_name = g.sensor_name AND r.a < g.b AND r.b > g.a)""",
    "p2_series": """
        WITH d AS (
          SELECT DISTINCT deploy_id, sensor_name, epoch_us(start_at) AS s, epoch_us(end_at) AS e, CAST(step_s AS BIGINT) * 1000000 AS st
          FROM deployment WHERE step_s > 0 AND end_at > start_at AND sensor_name IS NOT NULL),
        g AS (
          SELECT deploy_id, sensor_name, k, s + k * st AS a, least(s + (k + 1) * st, e) AS b
          FROM (SELECT *, unnest(range(0, CAST(ceil((e - s) / st) AS BIGINT))) AS k FROM d)),
        r AS (
          SELECT DISTINCT sensor_name, epoch_us(date) AS a, epoch_us(date) + CAST(ceil(round(least(length, 1e9) * 1e6, 3)) AS BIGINT) AS b, 1 AS n
          FROM audio_metadata WHERE sensor_name IS NOT NULL AND date IS NOT NULL AND length > 0 AND NOT isnan(length) AND NOT isinf(length)),
        o AS (
          SELECT deploy_id, k, sum(n) AS n, sum((least(r.b, g.b) - greatest(r.a, g.a)) / 1e6 * n) AS seconds, max(r.a) AS last_us
          FROM g JOIN r ON r.sensor_name = g.sensor_name AND r.a < g.b AND r.b > g.a GROUP BY 1, 2),
        c AS (
          SELECT g.*, o.n, o.seconds, max(CASE WHEN o.n IS NOT NULL THEN g.k END) OVER (PARTITION BY deploy_id ORDER BY g.k) AS lk FROM g LEFT JOIN o USING (deploy_id, k))
        SELECT c.deploy_id, sensor_name, c.k, a AS slot_us, CASE WHEN c.n IS NOT NULL THEN 'observed' WHEN c.k - lk <= 3 THEN 'carried' ELSE 'missing' END AS status,
          CAST(coalesce(c.n, 0) AS BIGINT) AS n_readings, round(coalesce(c.seconds, 0), 3) + CAST(0 AS DOUBLE) AS seconds, CASE WHEN c.k - lk <= 3 THEN l.last_us END AS carried_us
        FROM c LEFT JOIN o l ON l.deploy_id = c.deploy_id AND l.k = lk""",
    "p3_found": stamps_sql(),
    "p4_found": LINES + """
        SELECT DISTINCT rec_id, line_no, reason FROM r WHERE reason IS NOT NULL""",
    # the place of an error, from the lengths of the fields before it
    "p4_faults": LINES + r""", z AS (SELECT *, regexp_extract(line, '^(?:(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)\t)*') AS before, CASE WHEN v[1] = '\' THEN 1 ELSE 0 END AS first FROM r WHERE reason IS NOT NULL),
        y AS (SELECT *, substring(line, len(before) + 1) AS rest, [0, len(x['a']) + 1, len(x['a']) + len(x['b']) + 2] AS places FROM z),
        e AS (SELECT *, regexp_extract(rest, '^"(?:[^"]|"")*"') AS closed, regexp_extract(line, '^(?:(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)\t){3}') AS three_ FROM y)
        SELECT DISTINCT rec_id, line_no, reason, CAST(CASE reason
          WHEN 'quoting' THEN len(before) + CASE WHEN closed <> '' AND substring(rest, len(closed) + 1, 1) <> '"' THEN len(closed) ELSE 0 END
          WHEN 'columns' THEN CASE WHEN three_ <> '' THEN len(three_) ELSE len(before) + len(CASE WHEN starts_with(rest, '"') THEN replace(rest[2:-2], '""', '"') ELSE rest END) END
          ELSE places[first + CASE WHEN l IS NULL OR isinf(l) OR l < 0 THEN 1 ELSE 2 END] END AS INTEGER) AS error_at FROM e""",
    "p4_records": LINES + """, ok AS (SELECT DISTINCT rec_id, line_no, v, l, h FROM r WHERE reason IS NULL)
        SELECT t.rec_id, t.line_no, t.l AS min_t, t.h AS max_t, t.v[3] AS label, f.l AS min_f, f.h AS max_f
        FROM ok t LEFT JOIN ok f ON f.rec_id = t.rec_id AND f.line_no = t.line_no + 1 AND f.v[1] = '\\' WHERE t.v[1] <> '\\'""",
    "p5_found": f"""
        WITH {GRADED}, t AS (SELECT DISTINCT id, lower(trim(rec)) AS rec, grade, len FROM c WHERE rec IS NOT NULL AND trim(rec) <> ''),
        r AS (
          SELECT *, row_number() OVER (PARTITION BY rec ORDER BY grade, len DESC, id) AS rk, count(*) OVER (PARTITION BY rec) AS n FROM t)
        SELECT CAST(id AS VARCHAR) AS id FROM r WHERE n > 12 AND rk <= 12""",
    # records in the order of their quality, each kept if all its contributors still have room
    "p5_shared": f"""
        WITH RECURSIVE {GRADED}, e AS (
          SELECT id, grade, -len AS short, 'rec:' || lower(trim(rec)) AS who FROM c WHERE trim(rec) <> '' UNION ALL SELECT id, grade, -len, 'loc:' || lower(trim(loc)) FROM c WHERE trim(loc) <> ''),
        r AS (SELECT id, list(DISTINCT who) AS who, row_number() OVER (ORDER BY min((grade, short)), id) AS i FROM e WHERE id IS NOT NULL GROUP BY id),
        g AS (
          SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST([] AS VARCHAR[]) AS who, CAST([] AS VARCHAR[]) AS held, false AS kept
          UNION ALL
          SELECT i, id, who, CASE WHEN kept THEN list_concat(held, who) ELSE held END, kept
          FROM (SELECT r.i, r.id, r.who, g.held, len(list_filter(r.who, lambda c: len(list_filter(g.held, lambda h: h = c)) >= 12)) = 0 AS kept FROM g JOIN r ON r.i = g.i + 1))
        SELECT CAST(id AS VARCHAR) AS id, list_sort(who) AS contributors FROM g WHERE kept""",
    "p6_found": """
        WITH t AS (
          SELECT DISTINCT rec_id, CAST(round(min_f) AS BIGINT) AS min_f, CAST(round(max_f) AS BIGINT) AS max_f,
            CAST(round(min_t * 100000) AS BIGINT) AS s, CAST(round(max_t * 100000) AS BIGINT) AS e
          FROM roi WHERE min_t IS NOT NULL AND max_t > min_t),
        m AS (
          SELECT *, max(e) OVER (PARTITION BY rec_id, min_f, max_f ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
        i AS (
          SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, min_f, max_f ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
        p AS (SELECT rec_id, min_f, max_f, island, min(s) AS s, max(e) AS e FROM i GROUP BY ALL),
        g AS (SELECT *, lead(s) OVER (PARTITION BY rec_id, min_f, max_f ORDER BY island) AS nxt FROM p)
        SELECT 'period' AS kind, rec_id, min_f, max_f, s AS start_e5, e AS end_e5 FROM p
        UNION ALL SELECT 'gap', rec_id, min_f, max_f, e, nxt FROM g WHERE nxt IS NOT NULL""",
}

"""Queries on spectrograms: spectra, spectral indices, denoising, peaks and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.functions import decibel as db
from chirpline.operators import spectral as sp
from chirpline.plans.registry import DF, DT, M, SPEC, R, Registry, cells, rounded
from chirpline.plans.temporal import evn

q = Registry()
QUERIES, ORACLES = q.queries, q.sql
G = sp.Grid(64, DF, DT)
S = f"WITH {SPEC}, sa AS (SELECT rec_id, f_idx, any_value(fn) AS fn, avg(p) AS p, sqrt(avg(p)) AS a FROM spec GROUP BY 1, 2)"
EQ = f"""b AS (SELECT rec_id, f_idx, quantile_cont(p, 0.5) AS med, min(p) AS low, max(p) AS high FROM spec GROUP BY 1, 2),
 nb AS (SELECT *, CASE WHEN med > low THEN med - low ELSE max(high) OVER (PARTITION BY rec_id) END AS norm FROM b),
 lev AS (SELECT spec.*, greatest((p - med) / norm, 1) AS e, 10 * log10(greatest((p - med) / norm, 1)) AS level FROM spec JOIN nb USING (rec_id, f_idx))"""
LAGS = "lg AS (SELECT *, a - lag(a) OVER w AS d1, a - 2 * lag(a) OVER w + lag(a, 2) OVER w AS d2 FROM spec WINDOW w AS (PARTITION BY rec_id, f_idx ORDER BY t_idx))"


def hn(v: str, src: str, by: str, name: str) -> str:
    """Normalised entropy of positive values in SQL."""
    return f"(SELECT {by}, CASE WHEN count(*) = 1 THEN 0 WHEN any_value(s) = 0 THEN 1 ELSE -sum(greatest(v / s, {M}) * ln(greatest(v / s, {M}))) / ln(count(*)) END AS {name} FROM (SELECT {by}, {v} AS v, sum({v}) OVER (PARTITION BY {by}) AS s FROM {src}) GROUP BY {by})"


@q(f"{S} SELECT rec_id, f_idx, {R('fn', 'fn')}, {R('p', 'p')} FROM sa")
def avg_power_spectrum(spark, d):
    return rounded(sp.avg_power(cells(spark, d)))


@q(f"{S} SELECT rec_id, f_idx, {R('fn', 'fn')}, {R('a', 'a')} FROM sa")
def avg_amp_spectrum(spark, d):
    return rounded(sp.avg_amplitude(cells(spark, d)))


_THIRD = "(VALUES " + ", ".join(f"({i}, {float(c)}::DOUBLE)" for i, c in enumerate(sp.THIRD_OCTAVES[: sum(c <= 15750 for c in sp.THIRD_OCTAVES)])) + ") AS o(band, centre)"


@q(f"WITH {SPEC} SELECT rec_id, t_idx, CAST(band AS BIGINT) AS band, centre, {R('coalesce(sum(p) FILTER (WHERE fn BETWEEN centre / pow(2, 0.1666666::DOUBLE) AND centre * pow(2, 0.1666666::DOUBLE)), 0)', 'p')} FROM spec, {_THIRD} GROUP BY 1, 2, 3, 4")
def octave_bands(spark, d):
    return rounded(sp.octave_bands(cells(spark, d), G))


@q(f"{S}, b AS (SELECT rec_id, CAST(floor(fn / 1000) AS BIGINT) AS b, p FROM sa) SELECT rec_id, b, {R('avg(p) * 4', 'p')} FROM b WHERE b < 16 GROUP BY 1, 2")
def into_bins(spark, d):
    return rounded(sp.into_bins(sp.avg_power(cells(spark, d)), G, 1000.0))


def _mom(v: str, src: str, by: str, digits: int = 5) -> str:
    m = "avg(v) AS mean, var_pop(v) AS var, sum(pow(v - m, 3)) / (count(*) - 1) / pow(any_value(s), 3) AS skew, sum(pow(v - m, 4)) / (count(*) - 1) / pow(any_value(s), 4) AS kurt"
    return f"SELECT {by}, {', '.join(R(c, c, digits) for c in ("mean", "var", "skew", "kurt"))} FROM (SELECT {by}, {m} FROM (SELECT {by}, {v} AS v, avg({v}) OVER (PARTITION BY {by}) AS m, stddev_pop({v}) OVER (PARTITION BY {by}) AS s FROM {src}) GROUP BY {by})"


@q(f"{S} {_mom('a', 'sa', 'rec_id')}")
def spectral_moments(spark, d):
    return rounded(sp.spectral_moments(cells(spark, d)), 5)


@q(f"{S} {_mom('a', 'spec', 'rec_id, f_idx')}")
def moments_per_bin(spark, d):
    return rounded(sp.moments_per_bin(cells(spark, d)), 5)


@q(f"{S} SELECT rec_id, {R('h', 'hf')} FROM {hn('p', 'sa', 'rec_id', 'h')}")
def freq_entropy(spark, d):
    return rounded(sp.frequency_entropy(cells(spark, d)))


@q(f"{S} SELECT rec_id, f_idx, {R('h', 'ht')} FROM {hn('p', 'spec', 'rec_id, f_idx', 'h')}")
def entropy_per_bin(spark, d):
    return rounded(sp.entropy_per_bin(cells(spark, d)))


@q(f"WITH {SPEC}, {EQ} SELECT rec_id, t_idx, f_idx, {R('e', 'e', 4)} FROM lev")
def median_equalizer(spark, d):
    return rounded(sp.median_equalizer(cells(spark, d)).select("rec_id", "t_idx", "f_idx", "e"), 4)


EPS = f"""bb AS (SELECT * FROM lev WHERE f_idx BETWEEN 4 AND 63), bs AS (SELECT rec_id, f_idx, avg(e) AS m, var_pop(e) AS v, var_pop(e) / avg(e) AS c FROM bb GROUP BY 1, 2),
 pk AS (SELECT rec_id, t_idx, 250 * arg_max(f_idx, (e, -f_idx)) AS f FROM bb GROUP BY 1, 2),
 hs AS (SELECT rec_id, least(CAST(floor((f - 1000) / (19000::DOUBLE / 60)) AS INT), 59) AS k, count(*) AS n FROM pk GROUP BY 1, 2),
 hg AS (SELECT r.rec_id, k, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY r.rec_id) AS q FROM (SELECT rec_id, unnest(range(0, 60)) AS k FROM (SELECT DISTINCT rec_id FROM pk)) r LEFT JOIN hs USING (rec_id, k)),
 ep AS (SELECT rec_id, 1 + sum(q * ln(greatest(q, {M}))) / ln(60) AS EPS, sum(pow(q - 1 / 60::DOUBLE, 4)) / 59 / pow(stddev_pop(q), 4) AS EPS_KURT, sum(pow(q - 1 / 60::DOUBLE, 3)) / 59 / pow(stddev_pop(q), 3) AS EPS_SKEW FROM hg GROUP BY 1),
 sfam AS (SELECT rec_id, 1 - m AS EAS, 1 - v AS ECU, 1 - c AS ECV, EPS, EPS_KURT, EPS_SKEW FROM {hn('m', 'bs', 'rec_id', 'm')} JOIN {hn('v', 'bs', 'rec_id', 'v')} USING (rec_id) JOIN {hn('c', 'bs', 'rec_id', 'c')} USING (rec_id) JOIN ep USING (rec_id))"""


@q(f"WITH {SPEC}, {EQ}, {EPS} SELECT rec_id, {', '.join(R(x, x, 5) for x in ('EAS', 'ECU', 'ECV', 'EPS', 'EPS_KURT', 'EPS_SKEW'))} FROM sfam")
def spectral_entropy_family(spark, d):
    return rounded(sp.spectral_entropy(sp.equalised_levels(cells(spark, d)), G, 1000.0, 20000.0), 5)


ACI = "ac AS (SELECT rec_id, sum(v) AS aci FROM (SELECT rec_id, f_idx, sum(abs(d1)) / sum(a) AS v FROM lg GROUP BY 1, 2) GROUP BY 1)"


@q(f"WITH {SPEC}, {LAGS}, {ACI} SELECT rec_id, {R('aci', 'aci')} FROM ac")
def aci(spark, d):
    return rounded(sp.aci(cells(spark, d)))


NDSI = "nd AS (SELECT rec_id, sum(p) FILTER (WHERE b BETWEEN 1 AND 10) AS bio, sum(p) FILTER (WHERE b BETWEEN 0 AND 1) AS anthro FROM (SELECT rec_id, floor(fn / 1000) AS b, avg(p) * 4 AS p FROM sa GROUP BY 1, 2) GROUP BY 1)"


@q(f"{S}, {NDSI} SELECT rec_id, {R('(bio - anthro) / (bio + anthro)', 'ndsi')}, {R('bio / anthro', 'ratio')}, {R('anthro', 'anthro')}, {R('bio', 'bio')} FROM nd")
def ndsi(spark, d):
    return rounded(sp.soundscape_index(cells(spark, d), G))


BI = f"""bm AS (SELECT rec_id, f_idx, avg(a) AS m, avg(p) AS mp, max(a) AS top, max(p) AS ptop FROM spec GROUP BY 1, 2),
 bl AS (SELECT *, 20 * log10(greatest(m / max(top) OVER w, {M})) AS level, sqrt(sum(mp) OVER w / max(ptop) OVER w) AS z FROM bm WINDOW w AS (PARTITION BY rec_id))"""


@q(f"WITH {SPEC}, {BI} SELECT rec_id, {R('(sum(level) - count(*) * min(level)) / 250', 'bi')}, {R('any_value(z) * 250', 'bi_power', 5)} FROM bl WHERE f_idx BETWEEN 8 AND 60 GROUP BY 1")
def bioacoustics(spark, d):
    b = sp.bioacoustics_index(cells(spark, d), G)
    return rounded(b.withColumn("bi_power", F.round("bi_power", 5)))


@q(f"WITH {SPEC}, {LAGS} SELECT rec_id, {R('sum(d2 * d2)', 'rou', 5)} FROM lg GROUP BY 1")
def roughness(spark, d):
    return rounded(sp.roughness(cells(spark, d)), 5)


@q(f"WITH {SPEC}, m AS (SELECT *, a - avg(a) OVER (PARTITION BY rec_id) AS y FROM spec) SELECT rec_id, f_idx, {R('avg(abs(y))', 'ra')}, {R('sqrt(avg(y * y))', 'rq')} FROM m GROUP BY 1, 2")
def surface_roughness(spark, d):
    return rounded(sp.surface_roughness(cells(spark, d)))


def _scores(step: int, hi: int) -> str:
    pairs = ", ".join(f"({b}, {i})" for b in range(hi // step) for i in range(G.nearest(b * step), G.nearest((b + 1) * step) + 1))
    return f"sc AS (SELECT rec_id, band, avg(CASE WHEN 20 * log10(greatest(a / top, {M})) >= -20 THEN 1 ELSE 0 END) AS share FROM (SELECT *, max(a) OVER (PARTITION BY rec_id) AS top FROM spec) JOIN (VALUES {pairs}) AS v(band, fi) ON fi = f_idx GROUP BY 1, 2)"


@q(f"WITH {SPEC}, {_scores(1000, 20000)}, h AS {hn('share', 'sc', 'rec_id', 'h')}, z AS (SELECT rec_id, sum(share * share) / pow(sum(share), 2) AS s2 FROM sc GROUP BY 1) SELECT rec_id, {R('h * ln(20)', 'shannon')}, {R('1 - s2', 'simpson')}, {R('1 / s2', 'invsimpson')} FROM h JOIN z USING (rec_id)")
def adi(spark, d):
    return rounded(sp.acoustic_diversity(cells(spark, d), G, threshold=-20))


@q(f"WITH {SPEC}, {_scores(500, 20000)}, r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY share, band) AS k FROM sc) SELECT rec_id, {R('(2 * sum(share * k) / sum(share) - (count(*) + 1)) / count(*)', 'aei')} FROM r GROUP BY 1")
def aei_gini(spark, d):
    return rounded(sp.acoustic_evenness(cells(spark, d), G, threshold=-20))


@q(f"WITH {SPEC}, {EQ}, a AS (SELECT rec_id, f_idx, avg(CASE WHEN level >= 3 THEN 1 ELSE 0 END) AS v FROM lev GROUP BY 1, 2) SELECT rec_id, {R('avg(v) FILTER (WHERE f_idx BETWEEN 0 AND 4)', 'lfc')}, {R('avg(v) FILTER (WHERE f_idx BETWEEN 4 AND 40)', 'mfc')}, {R('avg(v) FILTER (WHERE f_idx BETWEEN 40 AND 63)', 'hfc')} FROM a GROUP BY 1")
def spectral_cover(spark, d):
    return rounded(sp.spectral_cover(sp.equalised_levels(cells(spark, d)), G, {"lfc": (0, 1000), "mfc": (1000, 10000), "hfc": (10000, 20000)}))


@q(f"WITH {SPEC}, {EQ} SELECT rec_id, f_idx, {R('avg(CASE WHEN level >= 6 THEN 1 ELSE 0 END)', 'fraction')}, CAST(sum(CASE WHEN level >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS n_active, CAST(sum(CASE WHEN level > 6 THEN 1 ELSE 0 END) AS BIGINT) AS n_strong, {R('coalesce(sum(pow(10::DOUBLE, level / 10)) FILTER (WHERE level > 6), 0)', 'power', 3)} FROM lev GROUP BY 1, 2")
def spectral_activity(spark, d):
    return rounded(sp.spectral_activity(sp.equalised_levels(cells(spark, d)), 6.0).withColumn("power", F.round("power", 3)))


@q(f"WITH {SPEC}, {EQ}, {evn('lev', 'rec_id, f_idx', 't_idx', 'level >= 3', 0.25, 3)} SELECT rec_id, f_idx, {R('fraction', 'fraction')}, {R('mean_s', 'mean_s')}, {R('per_s', 'per_s')}, n_events FROM evn")
def spectral_events(spark, d):
    return rounded(sp.spectral_events(sp.equalised_levels(cells(spark, d)), G, 3.0, 0.5))


def _tfsd(lo: int, hi: int) -> str:
    return f"""oc AS (SELECT rec_id, t_idx, band, coalesce(sum(log10(greatest(a, {M}))) FILTER (WHERE fn BETWEEN centre / pow(2, 0.1666666::DOUBLE) AND centre * pow(2, 0.1666666::DOUBLE)), 0) AS g FROM spec, {_THIRD} GROUP BY 1, 2, 3),
 ot AS (SELECT *, g - lag(g) OVER (PARTITION BY rec_id, band ORDER BY t_idx) AS dt FROM oc),
 tf AS (SELECT rec_id, sum(f) FILTER (WHERE band BETWEEN {lo} AND {hi}) / sum(f) AS tfsd FROM (SELECT *, abs(lead(dt) OVER (PARTITION BY rec_id, t_idx ORDER BY band) - dt) AS f FROM ot WHERE dt IS NOT NULL) GROUP BY 1)"""


@q(f"WITH {SPEC}, {_tfsd(21, 27)} SELECT rec_id, {R('tfsd', 'tfsd')} FROM tf")
def tfsd(spark, d):
    return rounded(sp.tfsd(cells(spark, d), G))


MORE = f"""mo AS (SELECT rec_id, (1 - sum(pow(m, 3))) / 3 AS H_Havrda, ln(sum(pow(m, 3))) / -2 AS H_Renyi, -sum(m * ln(m)) - sum((1 - m) * ln(1 - m)) AS H_pairedShannon,
   (1 - pow(sum(pow(m, 1 / 3::DOUBLE)), 3)) / -3 AS H_gamma, 1 - sum(m * m) AS H_GiniSimpson FROM (SELECT rec_id, greatest(p / sum(p) OVER (PARTITION BY rec_id), {M}) AS m FROM sa) GROUP BY 1)"""


@q(f"{S}, {MORE} SELECT rec_id, {', '.join(R(x, x, 4) for x in ('H_Havrda', 'H_Renyi', 'H_pairedShannon', 'H_gamma', 'H_GiniSimpson'))} FROM mo")
def more_entropy(spark, d):
    return rounded(sp.more_entropy(cells(spark, d)), 4)


RAO = """rb AS (SELECT rec_id, b, p / sum(p) OVER (PARTITION BY rec_id) AS m FROM (SELECT rec_id, floor(fn / 1000) AS b, avg(p) * 4 AS p FROM sa GROUP BY 1, 2)),
 ra AS (SELECT x.rec_id, sum(x.m * y.m * abs(x.b - y.b)) / 15 * 2 * sqrt(2) AS raoq FROM rb x JOIN rb y USING (rec_id) GROUP BY 1)"""


@q(f"{S}, {RAO} SELECT rec_id, {R('raoq', 'raoq')} FROM ra")
def raoq(spark, d):
    return rounded(sp.rao_q(cells(spark, d), G))


AGI = f"ag AS (SELECT rec_id, avg(v) AS agi, sum(v) AS agi_sum FROM (SELECT rec_id, f_idx, avg(abs(d1)) / greatest(quantile_cont(abs(d1), 0.5), {M}) AS v FROM lg WHERE d1 IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"


@q(f"WITH {SPEC}, {LAGS}, {AGI} SELECT rec_id, {R('agi', 'agi')}, {R('agi_sum', 'agi_sum', 5)} FROM ag")
def agi(spark, d):
    return rounded(sp.acoustic_gradient(cells(spark, d), G).withColumn("agi_sum", F.round("agi_sum", 5)))


@q(f"""WITH {SPEC}, g AS (SELECT rec_id, CASE WHEN lag(p) OVER t IS NULL THEN lead(p) OVER t - p WHEN lead(p) OVER t IS NULL THEN p - lag(p) OVER t ELSE (lead(p) OVER t - lag(p) OVER t) / 2 END AS gt,
  CASE WHEN lag(p) OVER f IS NULL THEN lead(p) OVER f - p WHEN lead(p) OVER f IS NULL THEN p - lag(p) OVER f ELSE (lead(p) OVER f - lag(p) OVER f) / 2 END AS gf
  FROM spec WINDOW t AS (PARTITION BY rec_id, f_idx ORDER BY t_idx), f AS (PARTITION BY rec_id, t_idx ORDER BY f_idx)) SELECT rec_id, {R('avg(sqrt(gt * gt + gf * gf))', 'sharpness')} FROM g GROUP BY 1""")
def sharpness(spark, d):
    return rounded(sp.sharpness(cells(spark, d)))


def _smooth(src: str, v: str, n: int, out: str) -> str:
    return f"(SELECT x.rec_id, x.f_idx, avg(y.{v}) AS {out} FROM {src} x, (SELECT unnest(range({-(n // 2)}, {n - n // 2})) AS o) JOIN {src} y ON y.rec_id = x.rec_id AND y.f_idx = greatest(0, least(63, x.f_idx + o)) GROUP BY 1, 2)"


NOISE = f"n0 AS (SELECT rec_id, f_idx, quantile_cont(p, 0.5) AS raw FROM spec GROUP BY 1, 2), n1 AS {_smooth('n0', 'raw', 25, 'noise')}"
SNR = f"n2 AS {_smooth('n1', 'noise', 5, 'n')}, sn AS (SELECT rec_id, 10 * log10(e) AS enr, 10 * log10(b) AS bgn FROM (SELECT rec_id, sum(p) AS e FROM sa GROUP BY 1) JOIN (SELECT rec_id, sum(n) AS b FROM n2 GROUP BY 1) USING (rec_id))"


@q(f"{S}, {NOISE}, {SNR} SELECT rec_id, {R('enr', 'enr')}, {R('bgn', 'bgn')}, {R('enr - bgn', 'snr')} FROM sn")
def spectral_snr(spark, d):
    return rounded(sp.spectral_snr(cells(spark, d)))


LEQF = "lq AS (SELECT rec_id, 10 * log10(sum(pow(sqrt(p) / pow(10::DOUBLE, -1.75) / pow(10::DOUBLE, 2.1), 2)) / 4e-10) AS leq FROM sa GROUP BY 1)"


@q(f"{S}, {LEQF} SELECT rec_id, {R('leq', 'leq')} FROM lq")
def leq_spectral(spark, d):
    return rounded(sp.spectral_leq(cells(spark, d)))


SQ = "cq AS (SELECT *, round(sum(p) OVER (PARTITION BY rec_id ORDER BY f_idx ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY rec_id), 12) AS share FROM sa)"


@q(f"{S}, {SQ} SELECT rec_id, " + ", ".join(f"min(fn) FILTER (WHERE share >= {x}) AS q{i + 1}" for i, x in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))) + " FROM cq GROUP BY 1")
def spectral_quantile(spark, d):
    return sp.spectral_quantiles(cells(spark, d), [0.05, 0.25, 0.5, 0.75, 0.95])


@q(f"{S}, {SQ}, z AS (SELECT rec_id, " + ", ".join(f"min(fn) FILTER (WHERE share >= {x}) AS q{i}" for i, x in enumerate((0.05, 0.25, 0.75, 0.95))) + " FROM cq GROUP BY 1) SELECT rec_id, q2 - q1 AS bw_50, q3 - q0 AS bw_90 FROM z")
def spectral_bandwidth(spark, d):
    s = sp.spectral_quantiles(cells(spark, d), [0.05, 0.25, 0.75, 0.95])
    return s.select("rec_id", (F.col("q3") - F.col("q2")).alias("bw_50"), (F.col("q4") - F.col("q1")).alias("bw_90"))


@q(f"""{S}, n AS (SELECT *, lag(p) OVER w AS y0, lead(p) OVER w AS y2 FROM sa WINDOW w AS (PARTITION BY rec_id ORDER BY f_idx)),
  t AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY p DESC, f_idx) AS rk FROM n QUALIFY rk = 1),
  s AS (SELECT *, fn - 250 + k AS x, round(y0 * (k - 250) * (k - 500) / 125000 - p * k * (k - 500) / 62500 + y2 * k * (k - 250) / 125000, 12) AS y FROM t, (SELECT unnest(range(0, 500))::DOUBLE AS k) WHERE y0 IS NOT NULL AND y2 IS NOT NULL),
  b AS (SELECT rec_id, arg_max(x, (y, -k)) AS bx, max(y) AS y FROM s GROUP BY 1)
  SELECT rec_id, fn AS peak, {R('p', 'amp')}, coalesce(bx, fn) AS best, {R('coalesce(y, p)', 'best_amp')} FROM t LEFT JOIN b USING (rec_id)""")
def peak_frequency(spark, d):
    return rounded(sp.peak_frequency(sp.avg_power(cells(spark, d))))


@q(f"""{S}, n AS (SELECT rec_id, v - lag(v) OVER w AS l, v - lead(v) OVER w AS r FROM (SELECT *, 20 * log10(a) AS v FROM sa) WINDOW w AS (PARTITION BY rec_id ORDER BY f_idx))
  SELECT rec_id, CAST(sum(CASE WHEN l >= 1 AND r > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_peaks FROM n GROUP BY 1""")
def n_peaks_simple(spark, d):
    s = sp.avg_amplitude(cells(spark, d)).withColumn("level", db.amplitude_to_db(F.col("a")))
    return sp.simple_peaks(s, slope=1.0)


def _scores50(step: int, hi: int, name: str) -> str:
    return _scores(step, hi).replace("sc AS", f"{name} AS").replace("-20 THEN", "-50 THEN")


# all spectral indices but the number of peaks and ROIs, as table al
ALL = f"""{S}, {EQ}, {EPS}, {LAGS}, {ACI}, {NDSI}, {BI}, {NOISE}, {SNR}, {LEQF}, {_tfsd(18, 28)}, {MORE}, {RAO}, {AGI}, {_scores50(1000, 10000, 's1')}, {_scores50(500, 10000, 's2')},
  {evn('lev', 'rec_id, f_idx', 't_idx', 'level >= 3', 0.25, 4)},
  mm AS ({_mom("a", "sa", "rec_id", 15)}), hh AS {hn('p', 'sa', 'rec_id', 'Hf')}, bi AS (SELECT rec_id, (sum(level) - count(*) * min(level)) / 250 AS BI FROM bl WHERE f_idx BETWEEN 4 AND 40 GROUP BY 1),
  ro AS (SELECT rec_id, sum(d2 * d2) AS ROU FROM lg GROUP BY 1), ad AS (SELECT rec_id, h * ln(10) AS ADI FROM {hn('share', 's1', 'rec_id', 'h')}),
  ae AS (SELECT rec_id, (2 * sum(share * k) / sum(share) - (count(*) + 1)) / count(*) AS AEI FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY share, band) AS k FROM s2) GROUP BY 1),
  pa AS (SELECT rec_id, f_idx, avg(CASE WHEN level >= 3 THEN 1 ELSE 0 END) AS v, sum(CASE WHEN level >= 3 THEN 1 ELSE 0 END) AS n FROM lev GROUP BY 1, 2),
  co AS (SELECT rec_id, avg(v) FILTER (WHERE f_idx BETWEEN 0 AND 4) AS LFC, avg(v) FILTER (WHERE f_idx BETWEEN 4 AND 40) AS MFC, avg(v) FILTER (WHERE f_idx BETWEEN 40 AND 63) AS HFC, avg(v) AS ACTspFract, avg(n) AS ACTspCount FROM pa GROUP BY 1),
  am AS (SELECT rec_id, coalesce(10 * log10(avg(pow(10::DOUBLE, level / 10)) FILTER (WHERE level > 3)), 0) AS ACTspMean FROM lev GROUP BY 1),
  ev AS (SELECT rec_id, avg(fraction) AS EVNspFract, avg(mean_s) AS EVNspMean, avg(per_s) AS EVNspCount FROM evn GROUP BY 1),
  al AS (SELECT *, mean AS MEANf, var AS VARf, skew AS SKEWf, kurt AS KURTf, leq AS LEQf, enr AS ENRf, bgn AS BGNf, enr - bgn AS SNRf, (bio - anthro) / (bio + anthro) AS NDSI, bio / anthro AS rBA, anthro AS AnthroEnergy, bio AS BioEnergy
    FROM mm JOIN lq USING (rec_id) JOIN sn USING (rec_id) JOIN hh USING (rec_id) JOIN sfam USING (rec_id) JOIN ac USING (rec_id) JOIN nd USING (rec_id) JOIN bi USING (rec_id) JOIN ro USING (rec_id) JOIN ad USING (rec_id) JOIN ae USING (rec_id)
    JOIN co USING (rec_id) JOIN am USING (rec_id) JOIN ev USING (rec_id) JOIN tf USING (rec_id) JOIN mo USING (rec_id) JOIN ra USING (rec_id) JOIN ag USING (rec_id))"""

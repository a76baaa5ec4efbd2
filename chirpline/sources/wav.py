"""WAV files as recordings, and recordings as WAV files."""

from __future__ import annotations

import math
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.functions import kernels as kn

HEADER = "sample_rate int, channels int, bits int, samples long, length double"


def parse(content: bytes | None) -> tuple[int, int, int, memoryview] | None:
    """(sample rate, channels, bits, data) of a PCM RIFF file; None if it is none. A cut-off data chunk gives what is there."""
    if content is None or len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form = 12, None
    view = memoryview(content)
    while at + 8 <= len(content):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", content, at + 4)[0]
        if kind == b"fmt " and at + 24 <= len(content):
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            form = (rate, channels, bits) if tag in (1, 0xFFFE) and channels and rate and bits in (8, 16, 24, 32) else None
        elif kind == b"data":
            return (*form, view[at + 8 : at + 8 + size]) if form else None
        at += 8 + size + size % 2
    return None


def samples(form: tuple[int, int, int, memoryview], channel: int = 0, detrend: bool = True) -> np.ndarray:
    """One channel as floats: signed values by 2^(bits - 1), 8-bit ones by 2^8 without centring; then less the mean."""
    _, channels, bits, data = form
    width = bits // 8
    n = len(data) // (width * channels)
    raw = data[: n * width * channels]
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(float)
    else:
        x = np.frombuffer(raw, {8: np.uint8, 16: "<i2", 32: "<i4"}[bits]).astype(float)
    x = x.reshape(-1, channels)[:, min(channel, channels - 1)] / (2**8 if bits == 8 else 2.0 ** (bits - 1))
    return x - x.mean() if detrend and n else x


def _listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The files below a folder, spread over the tasks, without their contents: (path, fsize)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("fsize"))


def _open(path: str):
    """A file of any store that the workers reach, for reading by ranges."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(re.sub("^([a-z0-9]+):/(?!/)", r"\1:///", path))
    return store.open_input_file(place)


def head(f, size: int) -> tuple[int, int, int, int, int] | None:
    """(sample rate, channels, bits, start of the data, its bytes) of an open PCM RIFF file of ``size`` bytes; only chunk heads are read. None if it is none; a cut-off data chunk counts what is there."""

    def at(place: int, n: int) -> bytes:
        f.seek(place)
        return f.read(n)

    start = at(0, 12)
    if len(start) < 12 or start[:4] != b"RIFF" or start[8:12] != b"WAVE":
        return None
    place, form = 12, None
    while place + 8 <= size:
        kind, n = struct.unpack("<4sI", at(place, 8))
        if kind == b"fmt " and place + 24 <= size:
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", at(place + 8, 16))
            form = (rate, channels, bits) if tag in (1, 0xFFFE) and channels and rate and bits in (8, 16, 24, 32) else None
        elif kind == b"data":
            return (*form, place + 8, min(n, size - place - 8)) if form else None
        place += 8 + n + n % 2
    return None


def read(spark: SparkSession, folder: str, channel: str = "left", detrend: bool = True, pattern: str = "*.[Ww][Aa][Vv]") -> DataFrame:
    """Recordings below a folder, for files that fit a row: (path, sample_rate, channels, bits, samples, length, x).

    Each file is read and leaves the worker by itself. Unreadable ones have nulls; an empty data
    chunk gives an empty array. ``spectrogram`` is for recordings of any length.
    """
    which = {"left": 0, "right": 1}[channel]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with _open(path) as f:
                    form = parse(f.read())
                if form is None:
                    row = (path, None, None, None, None, None, None)
                else:
                    x = samples(form, which, detrend)
                    row = (path, form[0], form[1], form[2], len(x), len(x) / form[0], x)
                yield pd.DataFrame([row], columns=["path", "sample_rate", "channels", "bits", "samples", "length", "x"], dtype="object")

    return _listing(spark, folder, pattern).select("path").mapInPandas(run, f"path string, {HEADER}, x array<double>")


def headers(spark: SparkSession, folder: str, pattern: str = "*.[Ww][Aa][Vv]") -> DataFrame:
    """The metadata of all files below a folder: (path_audio, fname, sample_rate, channels, bits, samples, fsize, length, flag, sensor_name, date, time).

    Only the heads of the chunks are read, by ranges, so an archive costs some reads of a few bytes
    a file. Unreadable files have nulls; flag is 0 for a readable file with a well-formed name, 1
    for an unreadable one and 2 for any other name, which gives no sensor, date and time.
    """
    from chirpline.sources.metadata import basename, file_check, filename_info

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, size in zip(pdf["path"], pdf["fsize"]):
                with _open(path) as f:
                    form = head(f, size)
                n = form[4] // (form[1] * form[2] // 8) if form else None
                rows.append((path, size, *((form[0], form[1], form[2], n, n / form[0]) if form else (None,) * 5)))
            yield pd.DataFrame(rows, columns=["path_audio", "fsize", "sample_rate", "channels", "bits", "samples", "length"], dtype="object")

    found = _listing(spark, folder, pattern).mapInPandas(run, f"path_audio string, fsize long, {HEADER}").withColumn("fname", basename(F.col("path_audio")))
    sensor, stamp, hms = filename_info(F.col("fname"))
    flag = file_check(F.col("fname"), F.col("sample_rate").isNotNull())
    return found.select("path_audio", "fname", "sample_rate", "channels", "bits", "samples", "fsize", "length", flag.alias("flag"), sensor.alias("sensor_name"), stamp.alias("date"), hms.alias("time"))


def spectrogram(spark: SparkSession, folder: str, nperseg: int, noverlap: int | None = None, target: int | None = None, channel: str = "left", pattern: str = "*.[Ww][Aa][Vv]", block: int = 1 << 20) -> DataFrame:
    """Power spectrograms of the recordings below a folder, of any length: (path, sample_rate, t_idx, v array of bins).

    A file is read by ranges of about ``block`` samples, resampled to ``target`` Hz by the polyphase
    filter and cut into frames, which leave the worker block by block, so no recording is ever a
    row. Resampled blocks overlap by the filter's reach and equal those of the whole recording.
    The signal's mean is not taken off: each frame loses its own. Unreadable files have no frames.
    """
    which = {"left": 0, "right": 1}[channel]
    hop = nperseg - (nperseg // 2 if noverlap is None else noverlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size in zip(pdf["path"], pdf["fsize"]):
                with _open(path) as f:
                    form = head(f, size)
                    if form is None:
                        continue
                    rate, channels, bits, begin, n_bytes = form
                    width, fs = channels * bits // 8, target or rate
                    n = n_bytes // width
                    g = math.gcd(rate, fs)
                    up, down = fs // g, rate // g
                    total = -(-n * up // down)
                    last = max(total // hop - 1, 0) if total >= nperseg else 0
                    last = min(last, (total - nperseg) // hop + 1) if total >= nperseg else 0
                    step = max(1, block * up // down // hop)
                    reach = 10 * max(up, down) // up + 2 if up != down else 0
                    for t in range(0, last, step):
                        m = min(step, last - t)
                        lo, hi = t * hop, (t + m - 1) * hop + nperseg  # samples after resampling
                        # input from a whole number of periods before, so that phases stay as they are
                        a = max(0, (lo * down // up - reach) // down * down)
                        b = min(n, hi * down // up + reach + 1)
                        f.seek(begin + a * width)
                        x = samples((rate, channels, bits, memoryview(f.read((b - a) * width))), which, False)
                        y = kn.resample_polyphase(x, rate, fs)
                        first = lo - a * up // down
                        power = kn.frame_power(kn.segments(y[first : first + hi - lo], nperseg, hop), nperseg).T
                        yield pd.DataFrame({"path": path, "sample_rate": fs, "t_idx": np.arange(t, t + m), "v": list(power)})

    return _listing(spark, folder, pattern).mapInPandas(run, "path string, sample_rate int, t_idx long, v array<double>")


def encode(x: np.ndarray, fs: int, bits: int = 16) -> bytes:
    """A mono WAV file: values cut to [-1, 1], then (x + 1) * 127 in 8 bits, x * 32767 in 16 and x * 2147483647 in 32."""
    x = np.clip(np.asarray(x, float), -1, 1)
    data = {8: lambda: ((x + 1) * 127).astype(np.uint8), 16: lambda: (x * 32767).astype("<i2"), 32: lambda: (x * 2147483647).astype("<i4")}[bits]().tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, fs, fs * bits // 8, bits // 8, bits, b"data", len(data))
    return head + data


def encoded(signals: DataFrame, fs: int, bits: int = 16) -> DataFrame:
    """Recordings as WAV files in memory: (rec_id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "content": [encode(np.asarray([] if x is None else x, float), fs, bits) for x in pdf["x"]]})

    kind = dict(signals.dtypes)["rec_id"]
    return signals.select("rec_id", "x").mapInPandas(run, f"rec_id {kind}, content binary")


def write(signals: DataFrame, folder: str, fs: int, bits: int = 16) -> None:
    """One file ``<rec_id>.wav`` per recording in a folder of any store that executors share; a retried task replaces its files whole."""

    def store(rows) -> None:
        from pyarrow import fs as stores

        to, place = stores.FileSystem.from_uri(folder if re.match("[a-z0-9]+:", folder) else "file://" + os.path.abspath(folder))
        to.create_dir(place, recursive=True)
        for r in rows:
            part = f"{place}/.{r.rec_id}.{uuid.uuid4().hex}.part"
            with to.open_output_stream(part) as f:
                f.write(r.content)
            to.move(part, f"{place}/{r.rec_id}.wav")

    encoded(signals, fs, bits).foreachPartition(store)


def read_spectrogram_images(spark: SparkSession, path: str, fs: float, duration: float, flims: tuple[float, float] | None = None, flipud: bool = True) -> DataFrame:
    """Grey or colour pictures as spectrograms scaled to 0..1: (path, t_idx, tn, fn array, v array), bins from the lowest.

    Colours become grey by the usual luma weights. A constant picture is 0 everywhere.
    """
    lo, hi = flims or (0.0, fs / 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path_, h, w, c, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                im = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float)
                grey = im[:, :, 0] if c == 1 else im[:, :, 0] * 0.0721 + im[:, :, 1] * 0.7154 + im[:, :, 2] * 0.2125
                grey = grey[::-1] if flipud else grey
                spread = grey.max() - grey.min()
                grey = (grey - grey.min()) / spread if spread else grey * 0
                fn = np.linspace(lo, hi, h)
                rows += [(path_, t, t * duration / max(w - 1, 1), fn, grey[:, t]) for t in range(w)]
            yield pd.DataFrame(rows, columns=["path", "t_idx", "tn", "fn", "v"])

    images = spark.read.format("image").load(path).select("image.*").where("height > 0")
    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "path string, t_idx long, tn double, fn array<double>, v array<double>")

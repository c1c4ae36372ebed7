"""Sampled sound: decoding WAV and raw PCM, peaks and spectrograms."""

from __future__ import annotations

import io
import math
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import Bytes, batched, listed, mapped

RAW_RATE = 16_000
PEAKS = 32_000
FFT, COLUMNS, MIN_HOP = 2048, 3500, 512
BANDS = 128


#: Frames of one range, of a row batch, and the schema of a table of ranges.
RANGE_FRAMES, BATCH_FRAMES = 4 << 20, 1 << 16
_FORM = "file string, format string, sample_rate int, channels int, bit_depth int, kind int, offset long, frames long"


class Form(NamedTuple):
    """Where a sound's samples are and how they are written."""

    format: str
    rate: int
    channels: int
    bits: int
    kind: int
    offset: int
    frames: int


def form_of(data: Bytes) -> Form:
    """From the headers; the samples aren't read. No RIFF header: 16-bit mono PCM."""
    if data.get(0, 4) != b"RIFF":
        return Form("pcm", RAW_RATE, 1, 16, 1, 0, data.length // 2)
    at, form = 12, None
    while len(head := data.get(at, 8)) == 8:
        name, n = head[:4], struct.unpack_from("<I", head, 4)[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", data.get(at + 8, 16))
            if form[0] == 0xFFFE:
                form = (struct.unpack("<H", data.get(at + 8 + 24, 2))[0], *form[1:])
        elif name == b"data" and form:
            kind, channels, rate, _, _, bits = form
            return Form("wav", rate, channels, bits, kind, at + 8, min(n, data.length - at - 8) // (channels * bits // 8))
        at += 8 + n + n % 2
    raise ValueError("no sound data")


def frames_of(data: Bytes, form: Form, low: int, high: int) -> np.ndarray:
    """Samples of frames [low, high) by frame and channel, in -1..1."""
    width = form.channels * form.bits // 8
    raw = data.get(form.offset + low * width, max(0, min(high, form.frames) - low) * width)
    if form.kind == 3:
        x = np.frombuffer(raw, "<f4" if form.bits == 32 else "<f8").astype(np.float32)
    elif form.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif form.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 8388608).astype(np.float32)
    else:
        x = (np.frombuffer(raw, "<i2" if form.bits == 16 else "<i4") / float(1 << form.bits - 1)).astype(np.float32)
    return x.reshape(-1, form.channels)


def forms(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sound that has a form, from its headers."""

    def of(row: dict) -> Iterator[tuple]:
        with Bytes(row["file"], 1 << 16) as data:
            yield (row["file"], *form_of(data))

    return mapped(listed(spark, path), of, _FORM)


def read_audio_info(spark: SparkSession, path: str) -> DataFrame:
    return forms(spark, path).select("file", "format", "sample_rate", "channels", "bit_depth", "frames", (F.col("frames") / F.col("sample_rate")).alias("duration"))


def frame_ranges(spark: SparkSession, path: str, size: int = RANGE_FRAMES, frames: tuple[int, int] | None = None) -> DataFrame:
    """Forms with frames [low, high) of each range; only those that meet ``frames``, if given.

    Frames have a fixed size, so a range starts where its number says. What a range
    needs beyond its end (a window of a transform) it reads itself.
    """
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(frames - 1) DIV {size}"), F.lit(0).cast("long")))
    out = forms(spark, path).select("*", F.explode(parts).alias("part")).withColumn("low", F.col("part") * size).withColumn("high", F.least(F.col("low") + size, "frames"))
    if frames is not None:
        out = out.withColumn("low", F.greatest("low", F.lit(frames[0]).cast("long"))).withColumn("high", F.least("high", F.lit(frames[1]).cast("long"))).filter("low < high")
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(many, "file", "part")


def _form(row: dict) -> Form:
    return Form(*(row[c] for c in ("format", "sample_rate", "channels", "bit_depth", "kind", "offset", "frames")))


def read_audio(spark: SparkSession, path: str, frames: tuple[int, int] | None = None, range_frames: int = RANGE_FRAMES) -> DataFrame:
    """(file, frame, channel, sample); only frames [a, b) if given, for which no others are read."""

    def samples(row: dict) -> Iterator[list]:
        form = _form(row)
        with Bytes(row["file"]) as data:
            for low in range(row["low"], row["high"], BATCH_FRAMES):
                x = frames_of(data, form, low, min(low + BATCH_FRAMES, row["high"]))
                n = len(x)
                yield [np.full(n * form.channels, row["file"], object), np.repeat(np.arange(low, low + n), form.channels), np.tile(np.arange(form.channels, dtype=np.int32), n), x.ravel()]

    return batched(frame_ranges(spark, path, range_frames, frames), samples, "file string, frame long, channel int, sample float")


def read_slice(spark: SparkSession, path: str, start: float, end: float) -> DataFrame:
    """Samples of [start, end) seconds, of each file: swapped if reversed, clamped, 0.1 s at least; only they are read."""
    from ..operators.grid import slice_bounds

    def of(row: dict) -> Iterator[list]:
        form = _form(row)
        low, high = slice_bounds(start, end, form.rate, form.frames)
        with Bytes(row["file"]) as data:
            for at in range(low, high, BATCH_FRAMES):
                x = frames_of(data, form, at, min(at + BATCH_FRAMES, high))
                n = len(x)
                yield [np.full(n * form.channels, row["file"], object), np.repeat(np.arange(at, at + n), form.channels), np.tile(np.arange(form.channels, dtype=np.int32), n), x.ravel()]

    return batched(forms(spark, path), of, "file string, frame long, channel int, sample float")


def decode(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(rate, channels, bits, samples) of a sound in memory."""
    held = Bytes.of(data)
    form = form_of(held)
    return form.rate, form.channels, form.bits, frames_of(held, form, 0, form.frames)


def read_peaks(spark: SparkSession, path: str, width: int = PEAKS, range_frames: int = RANGE_FRAMES) -> DataFrame:
    """As ``peaks``, from the files: each range gives the peaks of the buckets it touches, and those are merged."""

    def of(row: dict) -> Iterator[list]:
        form, found = _form(row), {}
        with Bytes(row["file"]) as data:
            for low in range(row["low"], row["high"], BATCH_FRAMES):
                x = np.abs(frames_of(data, form, low, min(low + BATCH_FRAMES, row["high"])).mean(axis=1, dtype=np.float64))
                frame = np.arange(low, low + len(x))
                bucket = (frame * width + width - 1) // form.frames if form.frames < width else ((frame + 1) * width - 1) // form.frames
                first = np.flatnonzero(np.r_[True, np.diff(bucket) > 0]) if len(x) else []
                for b, peak in zip(bucket[first], np.maximum.reduceat(x, first) if len(x) else ()):
                    found[int(b)] = max(found.get(int(b), 0.0), float(peak))
        yield [np.full(len(found), row["file"], object), list(found), list(found.values())]

    ranges = frame_ranges(spark, path, range_frames)
    found = batched(ranges, of, "file string, bucket long, peak double").groupBy("file", "bucket").agg(F.max("peak").alias("peak"))
    every = ranges.select("file").distinct().select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("bucket"))
    return every.join(found, ["file", "bucket"], "left").select("file", "bucket", F.coalesce("peak", F.lit(0.0)).alias("peak"))


def read_silence(spark: SparkSession, path: str, below: float, range_frames: int = RANGE_FRAMES) -> DataFrame:
    """(file, start, frames) of the runs of frames with a channel under a level; runs over the ends of ranges are stitched."""

    def of(row: dict) -> Iterator[list]:
        form, starts, ends = _form(row), [], []
        with Bytes(row["file"]) as data:
            for low in range(row["low"], row["high"], BATCH_FRAMES):
                quiet = (np.abs(frames_of(data, form, low, min(low + BATCH_FRAMES, row["high"]))) < below).any(axis=1)
                edge = np.flatnonzero(np.diff(np.r_[False, quiet, False]))
                for a, b in zip(edge[::2] + low, edge[1::2] + low):
                    if ends and ends[-1] == a:
                        ends[-1] = int(b)
                    else:
                        starts.append(int(a))
                        ends.append(int(b))
        inner = [a > row["low"] and b < row["high"] for a, b in zip(starts, ends)]
        yield [np.full(len(starts), row["file"], object), starts, ends, inner]

    runs = batched(frame_ranges(spark, path, range_frames), of, "file string, start long, end long, inner boolean")
    # at most two runs of a range touch its ends
    order = Window.partitionBy("file").orderBy("start")
    touching = runs.filter("NOT inner").withColumn("fresh", F.coalesce(F.lag("end").over(order) != F.col("start"), F.lit(True)).cast("int"))
    whole = touching.withColumn("run", F.sum("fresh").over(order)).groupBy("file", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.filter("inner").select("file", "start", "end").unionByName(whole.select("file", "start", "end")).select("file", "start", (F.col("end") - F.col("start")).alias("frames"))


def peaks(samples: DataFrame, width: int = PEAKS) -> DataFrame:
    """(file, bucket, peak): the largest magnitude of the channels' mean in each bucket, 0 where a bucket is empty."""
    mono = samples.groupBy("file", "frame").agg(F.avg("sample").alias("x"))
    total = samples.groupBy("file").agg((F.max("frame") + 1).alias("n"))
    bucket = F.expr(f"(frame * {width} + {width - 1}) DIV n")  # the only bucket of a frame if there are fewer frames than buckets
    wide = F.when(F.col("n") < width, bucket).otherwise(F.expr(f"((frame + 1) * {width} - 1) DIV n"))
    found = mono.join(total, "file").withColumn("bucket", wide).groupBy("file", "bucket").agg(F.max(F.abs("x")).alias("peak"))
    every = total.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("bucket"))
    return every.join(found, ["file", "bucket"], "left").select("file", "bucket", F.coalesce("peak", F.lit(0.0)).alias("peak"))


def mel(hz):
    return 2595 * np.log10(1 + np.asarray(hz) / 700)


def hop_of(frames: int, preview: bool) -> int:
    """Frames from one column to the next; a preview has ``COLUMNS`` at most, with gaps in long sounds."""
    return max(MIN_HOP, math.ceil(frames / COLUMNS)) if preview else MIN_HOP


def spectrogram(x: np.ndarray, rate: int, bands: int = BANDS, preview: bool = False) -> np.ndarray:
    """Columns of mel bands in 0..255 (-100 dB to -20 dB), one for each hop that has a whole window."""
    hop = hop_of(len(x), preview)
    return _columns(x, rate, hop, max(0, (len(x) - FFT) // hop + 1), bands)


def _columns(x: np.ndarray, rate: int, hop: int, count: int, bands: int = BANDS) -> np.ndarray:
    """The first ``count`` columns of x."""
    if not count:
        return np.zeros((0, bands), np.uint8)
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(FFT) / (FFT - 1)))
    out = np.zeros((count, bands), np.uint8)
    centres = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands) / 2595) - 1) * FFT / rate
    low = np.clip(centres.astype(int), 0, FFT // 2 - 1)
    share = centres - low
    for i in range(count):
        power = np.abs(np.fft.rfft(x[i * hop : i * hop + FFT] * window)) * 2 / FFT
        value = power[low] * (1 - share) + power[np.minimum(low + 1, FFT // 2)] * share
        level = 20 * np.log10(np.maximum(value, 1e-10))
        out[i] = np.clip((level + 100) / 80 * 255, 0, 255).astype(np.uint8)
    return out


def read_spectrogram(spark: SparkSession, path: str, preview: bool = False, range_frames: int = RANGE_FRAMES) -> DataFrame:
    """(file, column, bands).

    A range makes the columns that start in it and reads the window beyond its end.
    """

    def of(row: dict) -> Iterator[list]:
        form = _form(row)
        hop = hop_of(form.frames, preview)
        last = (form.frames - FFT) // hop + 1  # columns of the whole sound
        first, end = -(-row["low"] // hop), min(-(-row["high"] // hop), last)
        with Bytes(row["file"]) as data:
            for at in range(first, end, 256):
                many = min(256, end - at)
                x = frames_of(data, form, at * hop, (at + many - 1) * hop + FFT).mean(axis=1)
                yield [np.full(many, row["file"], object), np.arange(at, at + many), _columns(x, form.rate, hop, many).tolist()]

    return batched(frame_ranges(spark, path, range_frames), of, "file string, column long, bands array<int>")


def downsample_columns(columns: DataFrame, block: int) -> DataFrame:
    """Means of blocks of columns, rounded."""
    cells = columns.select("file", F.expr(f"column DIV {block}").alias("column"), F.posexplode("bands").alias("band", "value"))
    means = cells.groupBy("file", "column", "band").agg(F.round(F.avg("value")).cast("int").alias("value"))
    return means.groupBy("file", "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda x: x["value"]).alias("bands"))


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    """16-bit WAV: clamped; negatives scaled by 32768, others by 32767."""
    x = np.clip(np.atleast_2d(np.asarray(x, np.float64).T).T, -1, 1)
    pcm = np.where(x < 0, x * 0x8000, x * 0x7FFF).astype("<i2").tobytes()
    channels = x.shape[1]
    out = io.BytesIO()
    out.write(b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16))
    out.write(b"data" + struct.pack("<I", len(pcm)) + pcm)
    return out.getvalue()


def to_wav(samples: DataFrame, rate: int) -> DataFrame:
    """(file, content): each file's samples as a WAV, one file a task."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot(index="frame", columns="channel", values="sample").sort_index()
        return pd.DataFrame({"file": [group["file"].iloc[0]], "content": [wav_bytes(wide.to_numpy(), rate)]})

    return samples.groupBy("file").applyInPandas(build, "file string, content binary")


def silence_runs(samples: DataFrame, below: Column) -> DataFrame:
    """Runs of frames under a level: (file, start, frames)."""
    quiet = samples.filter(F.abs("sample") < below).select("file", "frame").distinct()
    run = F.col("frame") - F.row_number().over(Window.partitionBy("file").orderBy("frame"))
    return quiet.withColumn("run", run).groupBy("file", "run").agg(F.min("frame").alias("start"), F.count("*").alias("frames")).drop("run")

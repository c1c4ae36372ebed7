"""Sounds in ranges: peaks, spectrograms, silence and slices as from the whole, for every cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import grid
from millrace.sources import media
from millrace.sources.ranges import Bytes


@pytest.fixture(scope="module")
def sound(tmp_path_factory):
    """A stereo WAV with silent stretches, one over many ranges, and a raw file."""
    folder = tmp_path_factory.mktemp("sound")
    rng = np.random.default_rng(5)
    x = np.sin(np.arange(9700) / 7)[:, None] * rng.uniform(0.2, 0.9, (9700, 2))
    x[1000:4500] = 0
    x[5000:5003] = 0
    x[-40:] = 0
    (folder / "a.wav").write_bytes(media.wav_bytes(x, 8000))
    (folder / "b.pcm").write_bytes(rng.integers(-9000, 9000, 5000).astype("<i2").tobytes() + b"\1")
    return folder


SIZES = [511, 700, 2048, 3333, 9699, 9700, 1 << 20]


def by_file(df, *columns):
    return {f: sorted(tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in columns) for r in df.collect() if r["file"].endswith(f)) for f in ("a.wav", "b.pcm")}


def test_samples_and_forms(spark, sound):
    rate, channels, bits, x = media.decode((sound / "a.wav").read_bytes())
    assert (rate, channels, bits, x.shape) == (8000, 2, 16, (9700, 2))
    got = by_file(media.read_audio(spark, str(sound), range_frames=1234), "frame", "channel", "sample")
    assert got["a.wav"] == [(i, c, float(x[i, c])) for i in range(9700) for c in range(2)] and len(got["b.pcm"]) == 5000
    part = by_file(media.read_audio(spark, str(sound), frames=(4000, 6000), range_frames=1234), "frame", "channel", "sample")
    assert part["a.wav"] == [r for r in got["a.wav"] if 4000 <= r[0] < 6000] and len(part["b.pcm"]) == 1000


def test_a_slice_reads_its_bytes_only(spark, sound):
    got = media.read_slice(spark, str(sound / "a.wav"), 0.9, 0.5)
    assert sorted(r["frame"] for r in got.filter("channel = 0").collect()) == list(range(4000, 7200))
    assert grid.slice_bounds(5, 5, 8000, 9700) == (int((9700 / 8000 - 0.1) * 8000), 9700)
    with Bytes(str(sound / "a.wav"), 100) as data:
        form = media.form_of(data)
        media.frames_of(data, form, 100, 200)
        assert data.read < 100 * 4 + 400


@pytest.mark.parametrize("size", SIZES)
def test_equal_for_every_cut(spark, sound, size):
    samples = media.read_audio(spark, str(sound))
    for width in (10, 12_000):
        want = by_file(media.peaks(samples, width), "bucket", "peak")
        got = by_file(media.read_peaks(spark, str(sound), width, range_frames=size), "bucket", "peak")
        for f in want:
            assert [b for b, _ in got[f]] == [b for b, _ in want[f]] and np.allclose([p for _, p in got[f]], [p for _, p in want[f]], atol=1e-12)
    assert by_file(media.read_silence(spark, str(sound), 0.01, range_frames=size), "start", "frames") == by_file(media.silence_runs(samples, F.lit(0.01)), "start", "frames")
    for name in ("a.wav", "b.pcm"):
        rate, _, _, x = media.decode((sound / name).read_bytes())
        for preview in (False, True):
            want = media.spectrogram(x.mean(axis=1), rate, preview=preview)
            got = by_file(media.read_spectrogram(spark, str(sound), preview, range_frames=size), "column", "bands")[name]
            assert [c for c, _ in got] == list(range(len(want))) and (np.array([b for _, b in got]) == want).all()


def test_silence_over_many_ranges_is_one_run(spark, sound):
    runs = by_file(media.read_silence(spark, str(sound), 1e-6, range_frames=200), "start", "frames")["a.wav"]
    assert (1000, 3500) in runs and (5000, 3) in runs and (9660, 40) in runs

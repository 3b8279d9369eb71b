"""Files in and out: WAV, ROI tables, whole runs over synthetic recordings, streams."""

import io
import os
import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.functions import signal
from sonagrid.operators import rois
from sonagrid.plans.template_matching import template_matching
from sonagrid.schemas import ROIS
from sonagrid.sources import tables, wav, wav_format
from sonagrid.streaming import incremental

RATE = 8000


def cut_of(data, start, end):
    reader = wav.RangeReader(io.BytesIO(data), len(data))
    return wav.cut(reader, wav.read_header(reader), start, end)


def aligned(scores, n_frames, sw):
    """Scores of windows brought to frames, others at the lowest: the score of the window whose middle is frame c (from 1) stands at c - 1."""
    low = np.nanmin(scores) if len(scores) and not np.isnan(scores).all() else 0.0
    return np.concatenate([np.full(sw // 2 - 1, low), np.nan_to_num(scores, nan=low), np.full(sw - sw // 2, low)])[:n_frames]


def sliding_dtw(x, template):
    d = signal.warping_distances(x, template)
    return 1 - d / d.max() if len(d) and d.max() > 0 else np.ones(len(d))


def chirp(seconds, low, high):
    t = np.arange(int(seconds * RATE)) / RATE
    return 8000 * np.sin(2 * np.pi * (low * t + (high - low) * t * t / (2 * seconds)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("audio")
    (base / "soundscapes").mkdir()
    (base / "templates").mkdir()
    rng = np.random.default_rng(5)
    call = chirp(0.5, 1000, 2500)
    for name, start in (("a", 1.0), ("b", 2.25)):
        x = 50 * rng.standard_normal(4 * RATE)
        x[int(start * RATE) : int(start * RATE) + len(call)] += call
        (base / "soundscapes" / f"{name}.wav").write_bytes(wav.encode(x, RATE))
    (base / "soundscapes" / "broken.WAV").write_bytes(b"RIFF0000")
    (base / "soundscapes" / "note.txt").write_text("x")
    (base / "templates" / "a_001.000-001.500s_00.800-02.700kHz_256wl_50ovlp_call.wav").write_bytes(wav.encode(call, RATE))
    (base / "templates" / "other.wav").write_bytes(wav.encode(call, RATE))
    return base


def test_metadata(spark, folder):
    got = sorted((r["soundscape_file"], r["soundscape_duration"], r["soundscape_sample_rate"], r["soundscape_layout"]) for r in wav.soundscape_metadata(wav.listing(spark, str(folder / "soundscapes"))).collect())
    assert got == [("a.wav", 4.0, RATE, "mono"), ("b.wav", 4.0, RATE, "mono")]
    t = wav.template_metadata(wav.listing(spark, str(folder / "templates"), recursive=False)).collect()
    assert [(r["template_label"], r["template_min_freq"], r["template_max_freq"], r["template_wl"], r["template_ovlp"]) for r in t] == [("call", 0.8, 2.7, 256.0, 50.0)]


@pytest.mark.parametrize("method", ["cor", "dtw"])
def test_template_matching_finds_the_call(spark, folder, method):
    d = template_matching(spark, str(folder / "soundscapes"), str(folder / "templates"), score_method=method, top_n=1)
    got = {r["soundscape_file"]: r for r in d.collect()}
    assert set(got) == {"a.wav", "b.wav"}
    for name, start in (("a.wav", 1.0), ("b.wav", 2.25)):
        assert abs(got[name]["detection_start"] - start) < 0.06
        assert got[name]["detection_top_n"] in (1, None)
    if method == "cor":
        assert got["a.wav"]["peak_score"] > 0.8


def test_one_scoring_for_all_lengths(spark, folder):
    """Templates of several lengths are scored in one pass, with the rows that each alone gives."""
    import shutil

    more = folder / "more"
    shutil.copytree(folder / "templates", more)
    (more / "b_001.000-001.250s_00.800-02.000kHz_256wl_50ovlp_half.wav").write_bytes(wav.encode(chirp(0.25, 1000, 1750), RATE))
    from sonagrid.operators import grid
    from sonagrid.plans.template_matching import run_matching

    sounds, cuts = wav.listing(spark, str(folder / "soundscapes")), wav.listing(spark, str(more))
    files = sounds.select("path").union(cuts.select("path"))
    pairs = grid.match_grid(wav.soundscape_metadata(sounds), wav.template_metadata(cuts))
    both = run_matching(spark, pairs, files, min_quant=0.5)
    kernels = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInPandas")
    assert kernels(both) == kernels(run_matching(spark, pairs.filter("template_label = 'half'"), files, min_quant=0.5))
    key = lambda df: sorted(map(repr, df.collect()))
    alone = [r for label in ("call", "half") for r in key(run_matching(spark, pairs.filter(f"template_label = '{label}'"), files, min_quant=0.5))]
    assert key(both) == sorted(alone) and {r["detection_buffer"] for r in both.collect()} == {int((n - 256) / 128) + 1 for n in (RATE // 2, RATE // 4)}


@pytest.mark.parametrize("method", ["cor", "dtw"])
def test_blocks_give_the_scores_of_whole_recordings(spark, method):
    from sonagrid.operators import matching

    rng = np.random.default_rng(2)
    amp = {f: rng.random((n, 6)) for f, n in (("a", 50), ("b", 23), ("c", 4))}
    amp["a"][30:40] = 0.5  # windows without variance
    models = {"t3": (rng.random((3, 4)), 2, 5), "t9": (rng.random((9, 6)), 1, 6), "flat": (np.ones((4, 6)), 1, 6)}
    frames = spark.createDataFrame([(f, i + 1, i / 10, row.tolist()) for f, x in amp.items() for i, row in enumerate(x)], "file string, frame_idx int, time_vec double, amp array<double>")
    pairs = spark.createDataFrame([(f, t, m.tolist(), lo, hi) for f in amp for t, (m, lo, hi) in models.items()], "file string, template_id string, frames array<array<double>>, lo int, hi int")
    got = {}
    for r in matching.match_scores(frames, pairs, method, block=10).collect():
        got.setdefault((r["file"], r["template_id"]), []).append((r["frame_idx"], r["score"]))
    kernel = signal.sliding_pearson if method == "cor" else sliding_dtw
    for f, x in amp.items():
        for t, (m, lo, hi) in models.items():
            scores = kernel(x[:, lo - 1 : hi], m)
            if not len(scores):
                assert (f, t) not in got
                continue
            found = sorted(got[f, t])
            assert [i for i, _ in found] == list(range(1, len(x) + 1))
            assert np.allclose([s for _, s in found], aligned(scores, len(x), len(m)), atol=1e-9)


def test_headers_of_odd_files(spark, tmp_path):
    x = np.arange(1000)
    plain = wav.encode(x, RATE)
    chunk = lambda kind, size: kind + size.to_bytes(4, "little") + b"data" * (size // 4) + bytes(size % 4 + size % 2)
    files = {
        "plain": plain, "list": plain[:36] + chunk(b"LIST", 100_001) + plain[36:], "first": plain[:12] + chunk(b"bext", 70_000) + plain[12:],
        "many": plain[:36] + chunk(b"junk", 8) * 100 + plain[36:], "stereo": wav.encode(np.stack([x, -x], 1), RATE, 24), "eight": wav.encode(x % 128, RATE, 8),
        "short": plain[:30], "mp3": b"ID3" + bytes(100), "no_data": plain[:36] + chunk(b"LIST", 400), "empty": b"",
    }
    for name, data in files.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    got = {r["soundscape_file"]: (round(r["soundscape_duration"] * RATE), r["soundscape_bitrate"], r["soundscape_layout"]) for r in wav.soundscape_metadata(wav.listing(spark, str(tmp_path))).collect()}
    mono = (1000, 16, "mono")
    assert got == {"plain.wav": mono, "list.wav": mono, "first.wav": mono, "many.wav": mono, "stereo.wav": (1000, 24, "stereo"), "eight.wav": (1000, 8, "mono")}


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_cuts_keep_channels_and_depth(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(-(1 << (bits - 1)), 1 << (bits - 1), (800, 2))
    data = wav.encode(x, RATE, bits)
    back, h = wav.decode(data, channel=None)
    assert (back == x).all() and (h["bits"], h["channels"]) == (bits, 2)
    part, h = wav.decode(cut_of(data, 0.01, 0.05), channel=None)
    assert (part == x[80:400]).all() and (h["bits"], h["channels"], h["rate"]) == (bits, 2, RATE)
    assert (wav.decode(data, channel=1)[0] == x[:, 1]).all() and len(wav.decode(cut_of(data, 5, 6))[0]) == 0


def test_round_trips_and_ranges():
    x = np.arange(-500, 500) * 30
    back, h = wav.decode(wav.encode(x, RATE))
    assert (back == x).all() and h["rate"] == RATE
    part, _ = wav.decode(wav.encode(x, RATE), 0.01, 0.02)
    assert (part == x[80:160]).all()
    with pytest.raises(ValueError):
        wav.decode(b"nothing")
    t, f, amp = signal.spectrogram(np.sin(2 * np.pi * 1000 * np.arange(RATE) / RATE), RATE, 256, 50)
    assert abs(f[amp.mean(axis=0).argmax()] - 1.0) < 0.04 and len(t) == len(amp)
    assert len(signal.spectrogram(np.zeros(10), RATE, 256, 50)[0]) == 0


def test_cuts(spark, folder, tmp_path):
    files = wav.listing(spark, str(folder / "soundscapes"))
    path = [r["path"] for r in files.select("path").collect() if r["path"].endswith("a.wav")][0]
    roi = spark.createDataFrame([(path, "a.wav", 1.0, 1.5, 0.8, 2.7, 256, 50, "call")], "soundscape_path string, soundscape_file string, roi_start double, roi_end double, roi_min_freq double, roi_max_freq double, roi_wl int, roi_ovlp int, roi_label string")
    named = rois.roi_cut_names(roi)
    out = f"file://{tmp_path}/cuts"
    status = lambda o=False: [r["status"] for r in wav.write_files(wav.cuts(files, named), out, o).collect()]
    assert status() == ["written"] and status() == ["exists"] and status(True) == ["written"]
    data = (tmp_path / "cuts" / "a_001.000-001.500s_00.800-02.700kHz_256wl_50ovlp_call.wav").read_bytes()
    assert len(wav.decode(data)[0]) == RATE // 2


def rf64(samples):
    """A file whose sizes stand in a ds64 chunk."""
    body = np.asarray(samples).astype("<i2").tobytes()
    return b"RF64\xff\xff\xff\xffWAVEds64" + struct.pack("<IQQQI", 28, 72 + len(body), len(body), len(samples), 0) + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE * 2, 2, 16) + b"data\xff\xff\xff\xff" + body


def extensible(code, data, bits):
    fmt = struct.pack("<HHIIHHHHIH", 0xFFFE, 1, RATE, RATE * bits // 8, bits // 8, bits, 22, bits, 4, code) + bytes.fromhex("000000001000800000aa00389b71")
    return b"RIFF" + struct.pack("<I", 60 + len(data)) + b"WAVEfmt " + struct.pack("<I", 40) + fmt + b"data" + struct.pack("<I", len(data)) + data


def test_formats(spark, tmp_path):
    x = np.arange(-400, 400) / 500
    whole = np.arange(-400, 400)
    files = {
        "float32": wav.encode_float(x, RATE), "float64": wav.encode_float(x, RATE, 64), "ext_float": extensible(3, x.astype("<f4").tobytes(), 32), "ext_pcm": extensible(1, whole.astype("<i2").tobytes(), 16),
        "rf64": rf64(whole), "stream": wav.encode(whole, RATE)[:40] + b"\xff\xff\xff\xff" + whole.astype("<i2").tobytes(), "bad_ext": extensible(7, bytes(800), 16), "mu_law": wav.encode(whole, RATE).replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 7, 1), 1),
    }
    for name, data in files.items():
        (tmp_path / f"{name} å.wav").write_bytes(data)
        if name in ("bad_ext", "mu_law"):
            with pytest.raises(ValueError):
                wav.decode(data)
            continue
        got, h = wav.decode(data)
        assert np.allclose(got, whole if h["bits"] == 16 else x, atol=1e-7) and h["n"] == 800
        back, g = wav.decode(cut_of(data, 0.01, 0.05))
        assert (back == got[80:400]).all() and g["float"] == h["float"] and g["bits"] == h["bits"]
    listed = wav.listing(spark, str(tmp_path))
    assert sorted(r["soundscape_file"].split()[0] for r in wav.soundscape_metadata(listed).collect()) == sorted(set(files) - {"bad_ext", "mu_law"})
    assert sorted(r["path"].split("/")[-1].split()[0] for r in wav.unreadable(listed).collect()) == ["bad_ext", "mu_law"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        wav.listing(spark, str(tmp_path / "none"), needed=True)


def test_source_reads_ranges_only(spark, tmp_path):
    x = np.arange(-30_000, 30_000)
    (tmp_path / "a.wav").write_bytes(wav.encode(x, RATE))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.WAV").write_bytes(wav.encode_float(x[:9000] / 70_000, RATE))
    (tmp_path / "c.wav").write_bytes(b"RIFF0000")
    wav_format.register(spark)
    heads = {r["path"].rpartition("/")[2]: tuple(r)[2:] for r in spark.read.format("wav").load(str(tmp_path)).collect()}
    assert heads == {"a.wav": (60_000, RATE, 16, 1, False), "b.WAV": (9000, RATE, 32, 1, True)}
    assert {r["path"] for r in spark.read.format("wav").load(str(tmp_path)).collect()} <= {r["path"] for r in wav.listing(spark, str(tmp_path)).collect()}
    for size in (5_000, 64 << 20):  # byte ranges that cut blocks, and one for all
        blocks = spark.read.format("wav").options(read="samples", block=1000, range=size).load(str(tmp_path)).filter("path like '%a.wav'").orderBy("first").collect()
        assert np.array_equal(np.concatenate([r["samples"] for r in blocks]), x) and [r["first"] for r in blocks] == list(range(0, 60_000, 1000))
    some = spark.read.format("wav").options(read="samples", block=1000).load(str(tmp_path)).filter("start_time < 1.0 and end_time > 0.5 and path like '%a.wav'")
    assert sorted(r["first"] for r in some.select("first").collect()) == [4000, 5000, 6000, 7000]
    # what is read: a page for a header, a window of time for its blocks
    big = tmp_path / "big.wav"
    with open(big, "wb") as f:
        f.write(wav.encode(np.zeros(0), RATE)[:40] + struct.pack("<I", 3 << 30))
        f.truncate(44 + (3 << 30))  # over 2 GB, sparse
    reader = wav_format.WavReader({"path": str(big.parent)})
    list(reader.pushFilters([wav_format.EqualTo(("path",), f"file:{big}")]))
    part, = reader.partitions()
    assert [r[2] for r in reader.read(part)] == [3 << 29] and reader.n_bytes <= 4096
    reader = wav_format.WavReader({"path": str(big.parent), "read": "samples", "block": "8000"})
    list(reader.pushFilters([wav_format.EqualTo(("path",), f"file:{big}"), wav_format.GreaterThan(("end_time",), 100_000.5), wav_format.LessThan(("start_time",), 100_001.5)]))
    found = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[2] for r in found] == [100_000 * RATE, 100_001 * RATE] and reader.n_bytes < 300_000  # 48 ranges' headers and two seconds
    metadata = wav.soundscape_metadata(wav.listing(spark, str(tmp_path))).filter("soundscape_file = 'big.wav'").collect()
    assert metadata[0]["soundscape_duration"] == (3 << 29) / RATE


@pytest.mark.parametrize("method", ["cor", "dtw"])
def test_blocks_of_files_give_whole_scores(spark, folder, tmp_path, monkeypatch, method):
    """Small blocks of a recording score as the whole one, also in the transform domain."""
    from sonagrid.operators import grid, matching
    from sonagrid.plans.template_matching import run_matching

    sounds, cuts = wav.listing(spark, str(folder / "soundscapes")), wav.listing(spark, str(folder / "templates"))
    pairs = grid.match_grid(wav.soundscape_metadata(sounds), wav.template_metadata(cuts))
    files = sounds.select("path").union(cuts.select("path"))
    got = {}
    for r in run_matching(spark, pairs, files, method, output="scores").collect():
        got.setdefault(r["file"].split("|")[0], []).append((r["frame_idx"], r["time_vec"], r["score"]))
    t = (folder / "templates" / "a_001.000-001.500s_00.800-02.700kHz_256wl_50ovlp_call.wav").read_bytes()
    db = lambda data: (lambda a: signal.levels(a, a.max()))(signal.spectrogram(wav.decode(data)[0], RATE, 256, 50)[2])
    lo, hi = int(np.ceil(0.8 / (RATE / 256 / 1000))), int(np.floor(2.7 / (RATE / 256 / 1000))) + 1
    model = db(t)[:, lo:hi]
    for path, rows in got.items():
        amp = db(open(path.removeprefix("file:"), "rb").read())[:, lo:hi]
        scores = aligned((signal.sliding_pearson if method == "cor" else sliding_dtw)(amp, model), len(amp), len(model))
        assert np.allclose([s for *_, s in sorted(rows)], scores, atol=1e-9) and len(rows) == len(amp)
    blocks = wav.frame_blocks(sounds.select("path", F.lit(256).alias("wl"), F.lit(50.0).alias("ovlp"), F.col("path").alias("file"), F.array(F.lit("t")).alias("template_ids")), 40)
    if method == "dtw":
        blocks = blocks.join(wav.tops(blocks, 40), ["path", "wl", "ovlp"])
    small = {}
    for r in matching.finished(matching.score_blocks(blocks, {"t": (model, lo + 1, hi)}, method, 40), method).collect():
        small.setdefault(r["file"], []).append((r["frame_idx"], r["time_vec"], r["score"]))
    assert set(small) == set(got)
    for path, rows in small.items():
        assert np.allclose(sorted(rows), sorted(got[path]), atol=1e-9)


def test_transform_domain_equals_sums():
    rng = np.random.default_rng(3)
    x = -60 + 10 * rng.standard_normal((700, 40))
    x[300:420] = -80.0  # windows without variance
    for sw in (2, 63, 64, 65, 100, 128, 333, 700):
        model = rng.random((sw, 11)) * 30 - 50
        block, direct = signal.Windows(x), signal.Windows(x)
        want = np.array([np.corrcoef(x[i : i + sw, 7:18].ravel(), model.ravel())[0, 1] if x[i : i + sw, 7:18].std() > 1e-9 else np.nan for i in range(700 - sw + 1)])
        signal_frames, signal.FFT_FRAMES = signal.FFT_FRAMES, 2
        try:
            found = block.pearson(model, 7, 18)
        finally:
            signal.FFT_FRAMES = 10**9
        try:
            summed = direct.pearson(model, 7, 18)
        finally:
            signal.FFT_FRAMES = signal_frames
        assert np.allclose(found, want, atol=1e-9, equal_nan=True) and np.allclose(summed, want, atol=1e-9, equal_nan=True)


def test_an_hour_takes_little_memory(tmp_path):
    """A worker that scores all blocks of an hour at 24 kHz against a template stays under 500 MB."""
    path = tmp_path / "hour.wav"
    with open(path, "wb") as f:
        f.write(wav.encode(np.zeros(0), 24_000)[:40] + struct.pack("<I", 2 * 24_000 * 3600))
        f.truncate(44 + 2 * 24_000 * 3600)
    code = f"""
import resource, numpy as np
from sonagrid.sources import wav
from sonagrid.functions import signal
reader = wav.opened({str(path)!r}); h = wav.read_header(reader)
n = signal.frame_count(h["n"], 1024, 70.0)
for at in range(0, n, wav.BLOCK * 8):
    t, amp = wav.block_amplitudes(reader, h, at, min(at + wav.BLOCK + 200, n), 1024, 70.0)
    signal.Windows(signal.levels(amp, 1.0)).pearson(np.random.default_rng(1).random((100, 200)), 20, 220)
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(__file__))).stdout.split()[-2:])
    assert n > 280_000 and mb < 500


def test_sink_commits_once(spark, tmp_path):
    """Two attempts of a task, and one that fails: one whole file a name, none of the failed."""
    path = str(tmp_path / "out")
    w = wav_format.WavWriter(path, overwrite=False)
    rows = [{"cut_name": "a.wav", "content": b"abc"}, {"cut_name": "b.wav", "content": b"def"}]
    w.write(iter(rows))  # an attempt whose executor was lost after writing

    def breaks():
        yield {"cut_name": "a.wav", "content": b"a"}
        raise RuntimeError

    with pytest.raises(RuntimeError):
        w.write(breaks())
    assert [f for f in os.listdir(path) if f.endswith(".wav")] == []
    w.commit([w.write(iter(rows)), None])
    assert sorted(os.listdir(path)) == ["a.wav", "b.wav"] and (tmp_path / "out" / "a.wav").read_bytes() == b"abc"
    again = wav_format.WavWriter(path, overwrite=False)
    again.commit([again.write(iter([{"cut_name": "a.wav", "content": b"new"}]))])
    assert (tmp_path / "out" / "a.wav").read_bytes() == b"abc" and sorted(os.listdir(path)) == ["a.wav", "b.wav"]
    failed = wav_format.WavWriter(path, overwrite=True)
    failed.write(iter([{"cut_name": "c.wav", "content": b"new"}]))
    failed.abort([])
    assert sorted(os.listdir(path)) == ["a.wav", "b.wav"]


def test_roi_tables(spark, tmp_path):
    (tmp_path / "x_roi_u_20250101.csv").write_text('"roi_label","roi_start","roi_end","roi_comment"\n"sp a",1.5,2,"NA"\n"b, c",NA,3,"say ""hi"""\n')
    (tmp_path / "y_roi_u_20250101.csv").write_text('"","roi_end","roi_label"\n"1",9.5,"d"\n')
    (tmp_path / "z.csv").write_text("roi_label\nno\n")
    df = tables.read_rois(spark, str(tmp_path))
    assert df.schema == ROIS
    got = sorted((r["roi_file"], r["roi_label"], r["roi_start"], r["roi_end"], r["roi_comment"]) for r in df.collect())
    assert got == [("x_roi_u_20250101.csv", "b, c", None, 3.0, 'say "hi"'), ("x_roi_u_20250101.csv", "sp a", 1.5, 2.0, None), ("y_roi_u_20250101.csv", "d", None, 9.5, None)]


def test_roi_tables_with_quoted_line_ends(spark, tmp_path):
    (tmp_path / "q_roi_u.csv").write_bytes(b'"soundscape_file","roi_label","roi_comment","roi_start","roi_end"\r\n"a.wav","x","two\r\nlines",1.5,2.5\r\n"b.wav","y, z","say ""hi""\n\nthere",3,4\r\n')
    long = "word, ""\n" * 20_000
    (tmp_path / "r_roi_u.csv").write_text('roi_comment,roi_label,roi_start\n"' + long.replace('"', '""') + '",l,1\n5" wide,m,2\n,,\n"",n,3')
    (tmp_path / "e_roi_u.csv").write_text("")
    got = sorted(((r["roi_file"][0], r["soundscape_file"], r["roi_label"], r["roi_comment"], r["roi_start"]) for r in tables.read_rois(spark, str(tmp_path)).collect()), key=repr)
    want = [("q", "a.wav", "x", "two\nlines", 1.5), ("q", "b.wav", "y, z", 'say "hi"\n\nthere', 3.0), ("r", None, "l", long, 1.0), ("r", None, "m", '5" wide', 2.0), ("r", None, None, None, None), ("r", None, "n", None, 3.0)]
    assert got == sorted(want, key=repr)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        tables.read_rois(spark, str(tmp_path / "none"))


def test_a_stopped_save_loses_no_rois(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/a_roi_u.csv"
    make = lambda *labels: rois.coerced(spark.createDataFrame([("a", x, "u", "2025-01-01 00:00:00", "1.5") for x in labels], "soundscape_file string, roi_label string, roi_user string, roi_input_timestamp string, roi_start string"))
    read = lambda: sorted(r["roi_label"] for r in spark.read.option("header", True).csv(path).collect())
    assert tables.save_rois(make("x", "y"), "a", path)
    os.rename(path, path + tables.BEFORE)  # stopped after the old table was put away
    assert tables.recovered(spark, path) and read() == ["x", "y"]
    os.rename(path, path + tables.BEFORE)
    assert not tables.save_rois(make("x", "y"), "a", path) and read() == ["x", "y"]
    assert tables.save_rois(make("z"), "a", path) and read() == ["z"] and os.listdir(tmp_path) == ["a_roi_u.csv"]


def test_saving_of_changed_rois_only(spark, tmp_path):
    import os

    path = f"{tmp_path}/a_roi_u.csv"
    make = lambda *labels: rois.coerced(spark.createDataFrame([(f, x, "u", "2025-01-01 00:00:00", "1.5") for f, x in labels], "soundscape_file string, roi_label string, roi_user string, roi_input_timestamp string, roi_start string"))
    one = make(("a", "x"), ("a", "y"), ("b", "z"))
    assert tables.save_rois(one, "a", path) and not tables.save_rois(one, "a", path)
    assert tables.save_rois(make(("a", "x")), "a", path) and not tables.save_rois(make(("a", "x"), ("b", "q")), "a", path)
    assert [r["roi_label"] for r in spark.read.option("header", True).csv(path).collect()] == ["x"]
    assert tables.save_rois(make(("b", "q")), "a", path) and spark.read.option("header", True).csv(path).count() == 0
    assert os.listdir(tmp_path) == ["a_roi_u.csv"]


def test_log_of_missing_files(spark, tmp_path):
    meta = spark.createDataFrame([("a", 1), ("b", 2)], "soundscape_path string, n int")
    files = spark.createDataFrame([("a",)], "path string")
    assert [tuple(r) for r in tables.write_missing_log(meta, files, "soundscape_path", f"{tmp_path}/m.csv", "20250101_000000").collect()] == [("a", 1)]
    log = f"{tmp_path}/m_missing_recordings_log_20250101_000000.csv"
    assert [r["missing_files"] for r in spark.read.option("header", True).csv(log).collect()] == ["b"]


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    tables.write_csv(df.filter("k = 'a'"), path)
    done = tables.read_csv(spark, path, df.schema)
    tables.append_new(df, done.cache(), path, ["k"])
    assert sorted(map(tuple, tables.read_csv(spark, path, df.schema).collect())) == [("a", 1), ("b", 2)]


def rows_of(df):
    return sorted(map(repr, df.collect()))


def matched(spark, folder):
    from sonagrid.operators import grid

    sounds, cuts = wav.listing(spark, str(folder / "soundscapes")), wav.listing(spark, str(folder / "templates"))
    return grid.match_grid(wav.soundscape_metadata(sounds), wav.template_metadata(cuts)), sounds.select("path").union(cuts.select("path"))


def test_project_run(spark, folder, tmp_path):
    """A project from its folders to cuts, twice: the second run scores nothing and leaves the same tables."""
    import shutil

    from sonagrid.plans.workspace import Workspace, run_project

    w = Workspace(f"file://{tmp_path}")
    for name in ("soundscapes", "templates"):
        shutil.copytree(folder / name, tmp_path / name)
    assert run_project(spark, w, "me", min_quant=0.98) == 2
    assert not (tmp_path / "validation_outputs").exists()
    (tmp_path / "roi_tables").mkdir()
    (tmp_path / "roi_tables" / "a_roi_u.csv").write_text("soundscape_file,roi_user,roi_label,roi_start,roi_end,roi_min_freq,roi_max_freq,roi_wl,roi_ovlp\na.wav,u,call,1.0,1.5,0.8,2.7,256,50\nb.wav,u,call,3.5,3.9,0.8,2.7,256,50\n")
    for _ in range(2):
        assert run_project(spark, w, "me", min_quant=0.98) == 0
        checked = spark.read.option("header", True).csv(str(tmp_path / "validation_outputs")).collect()
        kinds = [r["validation"] for r in checked]
        assert kinds.count("FN") == 1 and "TP" in kinds and "FP" in kinds and {r["validation_user"] for r in checked} == {"me"}
        assert spark.read.option("header", True).csv(str(tmp_path / "validation_diagnostics")).filter("tp > 0").count() > 0
        assert sorted(os.listdir(tmp_path / "roi_cuts")) == ["a_001.000-001.500s_00.800-02.700kHz_256wl_50ovlp_call.wav", "b_003.500-003.900s_00.800-02.700kHz_256wl_50ovlp_call.wav"]
    with pytest.raises(ValueError):
        w.path("nowhere")


def test_stopped_matching_goes_on(spark, folder, tmp_path, monkeypatch):
    """Stopped in its second batch, then run again: the same rows, and scored pairs aren't scored again."""
    from sonagrid.plans import resumable
    from sonagrid.plans.template_matching import run_matching

    pairs, files = matched(spark, folder)
    out, scored = f"file://{tmp_path}/out", []

    def once_stopped(spark, batch, files, **k):
        paths = [r["soundscape_path"] for r in batch.collect()]
        if len(scored) == 1 and not (tmp_path / "stopped").exists():
            (tmp_path / "stopped").touch()
            raise KeyboardInterrupt
        scored.append(paths)
        return run_matching(spark, batch, files, **k)

    monkeypatch.setattr(resumable, "run_matching", once_stopped)
    with pytest.raises(KeyboardInterrupt):
        resumable.resume_matching(spark, pairs, files, out, pairs_a_batch=1, min_quant=0.9)
    first = rows_of(resumable.detections_of(spark, out))
    assert 0 < len(first) and resumable.scored_pairs(spark, out).count() == 1
    assert resumable.resume_matching(spark, pairs, files, out, pairs_a_batch=1, min_quant=0.9) == 1
    assert resumable.resume_matching(spark, pairs, files, out, pairs_a_batch=1, min_quant=0.9) == 0
    whole = rows_of(run_matching(spark, pairs, files, min_quant=0.9))
    assert rows_of(resumable.detections_of(spark, out)) == whole and len(whole) > len(first)
    assert sorted(p for ps in scored for p in ps) == sorted(r["soundscape_path"] for r in pairs.collect())
    with pytest.raises(ValueError):
        resumable.resume_matching(spark, pairs, files, out, min_quant=0.5)


def test_streamed_detections_are_there_once(spark, folder, tmp_path):
    """A file's detections once, also when the stream lost its checkpoint of the last batch."""
    from sonagrid.plans import resumable
    from sonagrid.plans.template_matching import run_matching

    source, out, check = tmp_path / "in", f"file://{tmp_path}/out", tmp_path / "check"
    source.mkdir()
    run = lambda: incremental.append_detections(spark, str(source), str(folder / "templates"), out, str(check), min_quant=0.9).awaitTermination()
    for name in ("a", "b"):
        (source / f"{name}.wav").write_bytes((folder / "soundscapes" / f"{name}.wav").read_bytes())
        run()
    pairs, files = matched(spark, folder)
    plain = lambda df: sorted((r["soundscape_file"], r["peak_index"], round(r["peak_score"], 9)) for r in df.collect())
    want = plain(run_matching(spark, pairs, files, min_quant=0.9))
    assert plain(resumable.detections_of(spark, out)) == want and sorted(os.listdir(tmp_path / "out")) == ["batch-00000000", "batch-00000001"]
    commits = check / "commits"
    for f in commits.iterdir():
        if f.name.strip(".").startswith("1"):
            f.unlink()  # stopped between the batch's commit and the stream's
    run()
    assert plain(resumable.detections_of(spark, out)) == want


def test_review_journal(spark, tmp_path):
    from sonagrid.plans.review_journal import ReviewJournal

    path = f"file://{tmp_path}/log"
    table = spark.createDataFrame([(i, "NV" if i % 2 else "FP", None) for i in range(6)], "detection_id long, validation string, validation_user string")
    j = ReviewJournal(spark, path)
    state = lambda **k: {r["detection_id"]: (r["validation"], r["validation_user"], r["validation_note"]) for r in j.merged(table, **k).collect()}
    assert state()[1] == ("NV", None, None)
    j.compact()
    j.save_one(1, validation="TP", validation_user="u", validation_time="2025-01-01 10:00:00")
    assert spark.read.parquet(path).count() == 1  # one review, one row
    j.save_one(1, validation="FP", validation_user="u", validation_time="2025-01-01 11:00:00", validation_note="again")
    j.save_one(1, validation="UN", validation_user="late", validation_time="2025-01-01 09:00:00")
    j.save(spark.createDataFrame([(2, "TP", "w"), (3, "TP", "w")], "detection_id long, validation string, validation_user string"))
    j.save_one(3, validation="UN", validation_user="v")
    want = {0: ("FP", None, None), 1: ("FP", "u", "again"), 2: ("TP", "w", None), 3: ("UN", "v", None), 4: ("FP", None, None), 5: ("NV", None, None)}
    assert state() == want
    assert state(allowed=F.col("validation_user") != "v")[3] == ("TP", "w", None) and state(only_empty=True)[2] == ("FP", "w", None)
    j.compact()
    assert state() == want and spark.read.parquet(path).count() == 3 and not [f for f in os.listdir(tmp_path / "log") if f.startswith("_compact")]
    j.save_one(2, validation="FP", validation_user="x")
    assert state()[2] == ("FP", "x", None)


def test_stream_sees_each_file_once(spark, folder, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    for name in ("a", "b"):
        (source / f"{name}.wav").write_bytes((folder / "soundscapes" / f"{name}.wav").read_bytes())
        incremental.append_metadata(spark, str(source), out, check).awaitTermination()
    assert sorted(r["soundscape_file"] for r in spark.read.parquet(out).collect()) == ["a.wav", "b.wav"]

"""Registered queries: each operator over the stand-in tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as fm
from ..functions import names
from ..operators import diagnostics as dg
from ..operators import acoustics, grid, matching, peaks, prefix, review, rois, validation, views
from ..schemas import DETECTIONS
from ..shared import written
from . import standins as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- names and projections ----

@query(f"""WITH {st.TEMPLATES} SELECT template_name, regexp_matches(template_name, '^.+_[0-9]{{3}}\\.[0-9]{{3}}-[0-9]{{3}}\\.[0-9]{{3}}s_[0-9]{{2}}\\.[0-9]{{3}}-[0-9]{{2}}\\.[0-9]{{3}}kHz_[0-9]+wl_[0-9]+ovlp_.+\\.[wW][aA][vV]$') AS valid FROM templates""")
def template_name_valid(spark, d):
    return st.templates(spark, d).select("template_name", names.is_template_name(F.col("template_name")).alias("valid"))


@query(f"""WITH {st.TEMPLATES} SELECT template_name, template_min_freq AS min_freq, template_max_freq AS max_freq, template_wl AS wl, template_ovlp AS ovlp, template_label AS label FROM templates WHERE p_partkey % 50 <> 7""")
def template_name_parse(spark, d):
    n = F.col("template_name")
    return st.templates(spark, d).filter(names.is_template_name(n)).select(n, *(c.alias(k) for k, c in names.parsed(n).items()))


@query(f"""WITH {st.ROIS} SELECT roi_id, soundscape_file || '_' || lpad(printf('%.3f', roi_start - 1704067200), greatest(7, length(printf('%.3f', roi_start - 1704067200)))::INTEGER, '0') || '-' ||
  lpad(printf('%.3f', roi_end - 1704067200), greatest(7, length(printf('%.3f', roi_end - 1704067200)))::INTEGER, '0') || 's_' || lpad(printf('%.3f', roi_min_freq), 6, '0') || '-' || lpad(printf('%.3f', roi_max_freq), 6, '0') || 'kHz_512wl_60ovlp_' || roi_label || '.wav' AS cut_name FROM rois""")
def roi_cut_name(spark, d):
    r = st.rois(spark, d).withColumn("roi_start", F.col("roi_start") - 1704067200).withColumn("roi_end", F.col("roi_end") - 1704067200)
    return rois.roi_cut_names(r).select("roi_id", "cut_name")


@query("""SELECT o_orderkey, o_orderstatus AS roi_label, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS roi_start,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_custkey::INTEGER END AS roi_wl, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS roi_type FROM orders""")
def roi_schema_coerce(spark, d):
    o = st.table(spark, d, "orders")
    text = o.select(
        F.col("o_orderkey").cast("string").alias("roi_comment"), F.col("o_orderstatus").alias("roi_label"), F.when(F.col("o_orderkey") % 7 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("roi_start"),
        F.when(F.col("o_orderkey") % 7 == 0, "NULL").when(F.col("o_orderkey") % 11 == 0, "x1").otherwise(F.col("o_custkey").cast("string")).alias("ROI_WL"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("roi_type"), F.lit("1").alias("_c0"),
    )
    return rois.coerced(text).select(F.col("roi_comment").cast("long").alias("o_orderkey"), "roi_label", "roi_start", "roi_wl", "roi_type")


@query(f"""WITH {st.REVIEWED} SELECT detection_id, soundscape_file, species AS roi_label, detection_start AS roi_start, detection_end AS roi_end, 'detection' AS roi_type, CASE WHEN validation = 'TP' THEN 'certain' ELSE 'uncertain' END AS roi_label_confidence,
  'template_name=' || template_name || '|detection_id=' || detection_id || '|validation=' || validation AS roi_comment, 'A B1' AS roi_user FROM reviewed""")
def detections_to_rois(spark, d):
    found = st.reviewed(spark, d)
    found = found.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in DETECTIONS.fields if f.name not in found.columns))
    out = rois.detections_to_rois(found, "A B_1!", "2024-01-01 00:00:00")
    part = lambda k: F.regexp_extract("roi_comment", rf"(?:^|\|)({k}=[^|]*)", 1)
    comment = F.concat_ws("|", part("template_name"), part("detection_id"), part("validation"))
    return out.select(F.regexp_extract("roi_comment", r"detection_id=(\d+)", 1).cast("long").alias("detection_id"), "soundscape_file", "roi_label", "roi_start", "roi_end", "roi_type", "roi_label_confidence", comment.alias("roi_comment"), "roi_user")


@query(f"""WITH {st.REVIEWED} SELECT detection_id, soundscape_file, template_name, round(template_min_freq, 1) AS template_min_freq, round(template_max_freq, 1) AS template_max_freq, round(detection_start, 3) AS detection_start, round(detection_end, 3) AS detection_end, round(peak_score, 3) AS peak_score, validation_user, NULL::VARCHAR AS validation_time, validation, NULL::VARCHAR AS validation_note FROM reviewed""")
def review_table(spark, d):
    return rois.review_view(st.reviewed(spark, d))


@query(f"""WITH {st.ROIS} SELECT roi_label, roi_start, roi_end, roi_min_freq, roi_max_freq, NULL::VARCHAR AS roi_type, NULL::VARCHAR AS roi_label_confidence, NULL::VARCHAR AS roi_is_complete, NULL::VARCHAR AS roi_comment FROM rois""")
def roi_table_view(spark, d):
    return rois.roi_view(st.rois(spark, d))


@query(f"""WITH {st.REVIEWED} SELECT template_name, min(detection_id) AS detection_id, arg_min(peak_score, detection_id) AS peak_score FROM reviewed GROUP BY 1""")
def first_per_template(spark, d):
    return rois.first_per(st.reviewed(spark, d), "template_name", "detection_id").select("template_name", "detection_id", "peak_score")


@query(f"""WITH {st.ROIS} SELECT roi_id, greatest(round(roi_min_freq - 1), 0.0::DOUBLE) AS low, least(round(roi_max_freq + 1), 23.0::DOUBLE) AS high FROM rois""")
def freq_view_limits(spark, d):
    low, high = fm.frequency_view(F.col("roi_min_freq"), F.col("roi_max_freq"))
    return st.rois(spark, d).select("roi_id", low.alias("low"), high.alias("high"))


@query("""SELECT o_orderkey, 'rec' || o_custkey || '_roi_A1 ' || o_orderstatus || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '.csv' AS roi_file FROM orders""")
def roi_table_name(spark, d):
    file, user = F.concat(F.lit("rec"), "o_custkey", F.lit(".WAV")), F.concat(F.lit("A_1 "), "o_orderstatus", F.lit("#"))
    return st.table(spark, d, "orders").select("o_orderkey", names.roi_table_name(file, user, F.col("o_orderdate").cast("timestamp")).alias("roi_file"))


@query(f"""WITH {st.ROIS} SELECT roi_id, roi_end - roi_start AS roi_duration, roi_max_freq - roi_min_freq AS roi_bandwidth FROM rois""")
def roi_ruler(spark, d):
    return rois.roi_ruler(st.rois(spark, d)).select("roi_id", "roi_duration", "roi_bandwidth")


@query(f"""WITH {st.DETECTIONS} SELECT detection_id, greatest(detection_start - 1704067200 - 600.0::DOUBLE, 0.0::DOUBLE) AS clip_start, least(detection_end - 1704067200 + 600.0::DOUBLE, 2592000.0::DOUBLE) AS clip_end FROM detections""")
def clip_padding(spark, d):
    a, b = fm.padded_clip(F.col("detection_start") - 1704067200, F.col("detection_end") - 1704067200, F.lit(2592000.0), 600.0)
    return st.detections(spark, d).select("detection_id", a.alias("clip_start"), b.alias("clip_end"))


@query("""SELECT event_id, round(44100 / s, 6) AS rate, round(value / s, 6) AS time, round((event_id % 20) * s, 6) AS freq FROM (SELECT *, (CASE event_id % 5 WHEN 0 THEN 8 WHEN 1 THEN 6 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 1 END)::DOUBLE AS s FROM events)""")
def pitch_shift_axes(spark, d):
    shift = F.element_at(F.array(*map(F.lit, (-8, -6, -4, -2, 1))), (F.col("event_id") % 5 + 1).cast("int"))
    cols = fm.pitch_shifted(F.lit(44100.0), F.col("value"), (F.col("event_id") % 20).cast("double"), shift)
    return st.table(spark, d, "events").select("event_id", *(F.round(c, 6).alias(n) for c, n in zip(cols, ("rate", "time", "freq"), strict=True)))


@query(f"""WITH {st.FRAMES}, cells AS (SELECT file, frame_idx, unnest(range(1, 65))::INTEGER AS bin, unnest(amp)::DOUBLE AS a FROM frames),
  db AS (SELECT *, CASE WHEN abs(a) > 0 THEN 20 * log10(abs(a)) ELSE '-infinity'::DOUBLE END AS db FROM cells)
  SELECT file, frame_idx, bin, least(floor((least(greatest(db, -80.0::DOUBLE), 0.0::DOUBLE) + 80) / (80.0::DOUBLE / 124)) + 1, 124)::INTEGER AS color FROM db""")
def dynamic_range_quantise(spark, d):
    cells = st.frames(spark, d).select("file", "frame_idx", F.posexplode("amp").alias("i", "a"))
    return cells.select("file", "frame_idx", (F.col("i") + 1).alias("bin"), fm.quantised(fm.decibels(F.abs(F.col("a").cast("double"))), -80.0, 0.0, 124).alias("color"))


@query(f"""WITH {st.FRAMES}, cells AS (SELECT file, frame_idx, unnest(range(1, 65))::INTEGER AS bin, abs(unnest(amp)::DOUBLE) * 20000 AS a FROM frames), tops AS (SELECT file, max(a) AS top FROM cells GROUP BY 1)
  SELECT file, frame_idx, bin, round(20 * log10(a / 32768), 6) AS full_scale, round(20 * log10(a / top), 6) AS relative FROM cells JOIN tops USING (file)""")
def spectrogram_decibels(spark, d):
    """Levels of raw amplitudes, below full scale and below each recording's largest."""
    raw = st.frames(spark, d).select("file", "frame_idx", F.transform("amp", lambda v: F.abs(v.cast("double")) * 20000).alias("amp"))
    both = views.spectro_levels(raw.withColumn("raw", F.col("amp"))).withColumnRenamed("amp", "relative")
    both = views.spectro_levels(both.withColumnRenamed("raw", "amp"), norm=False)
    cells = both.select("file", "frame_idx", F.posexplode(F.arrays_zip("amp", "relative")).alias("i", "x"))
    return cells.select("file", "frame_idx", (F.col("i") + 1).alias("bin"), F.round("x.amp", 6).alias("full_scale"), F.round("x.relative", 6).alias("relative"))


# ---- grid ----

@query(f"""WITH {st.SOUNDSCAPES}, {st.TEMPLATES} SELECT soundscape_file, template_name, soundscape_sample_rate AS sample_rate, soundscape_duration, template_end FROM soundscapes JOIN templates ON soundscape_sample_rate = template_sample_rate
  WHERE template_min_freq * 1000 < soundscape_sample_rate / 2 AND template_max_freq * 1000 < soundscape_sample_rate / 2 AND template_end - template_start < soundscape_duration""")
def match_grid(spark, d):
    return grid.match_grid(st.soundscapes(spark, d), st.templates(spark, d)).select("soundscape_file", "template_name", F.col("soundscape_sample_rate").alias("sample_rate"), "soundscape_duration", "template_end")


@query(f"""WITH {st.SOUNDSCAPES}, {st.TEMPLATES}, p AS (SELECT CASE WHEN soundscape_sample_rate <> template_sample_rate THEN 'sample_rate' WHEN template_min_freq * 1000 >= soundscape_sample_rate / 2 THEN 'min_freq'
  WHEN template_max_freq * 1000 >= soundscape_sample_rate / 2 THEN 'max_freq' WHEN template_end - template_start >= soundscape_duration THEN 'duration' END AS reason FROM soundscapes, templates) SELECT reason, count(*) AS n FROM p WHERE reason IS NOT NULL GROUP BY 1""")
def match_grid_rejections(spark, d):
    return grid.grid_rejections(st.soundscapes(spark, d), st.templates(spark, d))


@query("""SELECT count(*) FILTER (WHERE n_chars / 24000.0 < 0.01) AS short, count(*) AS total FROM documents""")
def short_recordings(spark, d):
    seconds = F.col("n_chars") / 24000.0
    return st.table(spark, d, "documents").agg(F.count_if(seconds < 0.01).alias("short"), F.count("*").alias("total"))


# ---- matching ----

_CELLS = f"""{st.FRAMES}, cells AS (SELECT file, frame_idx, b, amp[b]::DOUBLE AS x FROM frames, range(8, 40) t(b)), tm AS (SELECT frame_idx - 50 AS k, b, x AS y FROM cells WHERE file = 'f0' AND frame_idx BETWEEN 50 AND 69),
  win AS (SELECT c.file, c.frame_idx - k AS start, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y) AS sy, sum(y * y) AS syy FROM cells c JOIN tm ON c.b = tm.b GROUP BY 1, 2 HAVING count(*) = 640),
  cor AS (SELECT file, start::INTEGER AS start, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 9) AS score FROM win),
  padded AS (SELECT f.file, f.frame_idx, f.time_vec, coalesce(score, min(score) OVER (PARTITION BY f.file)) AS score FROM frames f LEFT JOIN cor ON cor.file = f.file AND cor.start + 9 = f.frame_idx)"""


def _correlation(spark, d):
    t, frames = st.TEMPLATE, st.frames(spark, d)
    model = matching.template_frames(frames, **t)
    return frames, matching.sliding_correlation(frames, model, t["lo"], t["hi"]).select("file", "start", F.round("score", 9).alias("score"))


@query(f"WITH {_CELLS} SELECT file, start, round(score, 6) AS score FROM cor")
def sliding_correlation(spark, d):
    return _correlation(spark, d)[1].select("file", "start", F.round("score", 6).alias("score"))


@query(f"WITH {_CELLS} SELECT file, frame_idx, time_vec, round(score, 6) AS score FROM padded")
def score_padding(spark, d):
    return matching.padded(*_correlation(spark, d), st.TEMPLATE["n"]).select("file", "frame_idx", "time_vec", F.round("score", 6).alias("score"))


def _templates_of(spark, d, frames):
    t = st.TEMPLATE
    model = matching.template_frames(frames, t["file"], t["first"], t["n"], 1, 64)
    return frames.select("file").distinct().select("file", F.lit("t0").alias("template_id"), F.array(*(F.array(*map(F.lit, r)) for r in model)).alias("frames"), F.lit(1).alias("lo"), F.lit(64).alias("hi"))


def _kernel(spark, d, method):
    frames = st.frames(spark, d)
    t = st.TEMPLATE
    pairs = _templates_of(spark, d, frames).withColumn("frames", F.transform("frames", lambda r: F.slice(r, t["lo"], t["hi"] - t["lo"] + 1))).withColumn("lo", F.lit(t["lo"])).withColumn("hi", F.lit(t["hi"]))
    return matching.match_scores(frames, pairs, method)


@query(f"""WITH {st.FRAMES}, s AS (SELECT file, (frame_idx - 1) * 64 + u.i AS n, amp[u.i + 1]::DOUBLE AS x FROM frames, range(0, 64) u(i)), t AS (SELECT file, max(n) + 1 AS total FROM s GROUP BY 1),
  w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 255) AS w FROM range(0, 256) r(i)), f AS (SELECT file, unnest(range(0, (total - 256) // 128 + 1)) AS f FROM t),
  x AS (SELECT f.file, f.f, w.i, s.x * w.w AS x FROM f JOIN w ON true JOIN s ON s.file = f.file AND s.n = f.f * 128 + w.i),
  dft AS (SELECT file, f, b, sum(x * cos(2 * pi() * ((b * i) % 256) / 256)) AS re, sum(x * sin(2 * pi() * ((b * i) % 256) / 256)) AS im FROM x, range(0, 128) r(b) GROUP BY 1, 2, 3)
  SELECT file, (f + 1)::INTEGER AS frame_idx, f * 128 / 8000.0::DOUBLE AS time_vec, (b + 1)::INTEGER AS bin, round(sqrt(re * re + im * im) * 2 / (SELECT sum(w) FROM w), 6) AS amp FROM dft""")
def spectrogram(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("frame_idx", "amp")))
    recordings = st.frames(spark, d).groupBy("file").agg(F.flatten(F.transform(rows, lambda x: x["amp"])).alias("samples")).withColumn("rate", F.lit(8000))
    out = matching.series_spectrograms(recordings, 256, 50.0)
    cells = out.select("file", "frame_idx", "time_vec", F.posexplode("amp").alias("i", "a"))
    return cells.select("file", "frame_idx", "time_vec", (F.col("i") + 1).alias("bin"), F.round("a", 6).alias("amp"))


@query(f"WITH {_CELLS} SELECT file, frame_idx, time_vec, round(score, 6) AS score FROM padded")
def correlation_matching(spark, d):
    return _kernel(spark, d, "cor").select("file", "frame_idx", "time_vec", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {st.FRAMES}, cells AS (SELECT file, frame_idx, b, amp[b]::DOUBLE AS x FROM frames, range(8, 40) t(b)), tm AS (SELECT frame_idx - 50 AS j, b, x AS y FROM cells WHERE file = 'f0' AND frame_idx BETWEEN 50 AND 69),
  cost AS (SELECT file, frame_idx AS f, j, sum(abs(x - y)) AS c FROM cells JOIN tm USING (b) GROUP BY 1, 2, 3), last AS (SELECT file, max(f) AS last FROM cost GROUP BY 1),
  dp AS (SELECT file, f AS start, 0 AS i, j, sum(c) OVER (PARTITION BY file, f ORDER BY j) AS d FROM cost JOIN last USING (file) WHERE f <= last - 19
    UNION ALL SELECT file, start, i, j, s + min(m - s + c) OVER (PARTITION BY file, start ORDER BY j) AS d FROM (
      SELECT p.file, p.start, p.i + 1 AS i, p.j, c, least(p.d, coalesce(lag(p.d) OVER (PARTITION BY p.file, p.start ORDER BY p.j), p.d)) AS m, sum(c) OVER (PARTITION BY p.file, p.start ORDER BY p.j) AS s
      FROM dp p JOIN cost ON cost.file = p.file AND cost.f = p.start + p.i + 1 AND cost.j = p.j WHERE p.i < 19)),
  found AS (SELECT file, start, 1 - d / max(d) OVER (PARTITION BY file) AS score FROM dp WHERE i = 19 AND j = 19)
  SELECT f.file, f.frame_idx, f.time_vec, round(coalesce(score, min(score) OVER (PARTITION BY f.file)), 6) AS score FROM frames f LEFT JOIN found ON found.file = f.file AND found.start + 9 = f.frame_idx""")
def dtw_matching(spark, d):
    return _kernel(spark, d, "dtw").select("file", "frame_idx", "time_vec", F.round("score", 6).alias("score"))


def _peaks_sql(source: str, key: str, sw: int, b: int, h: int) -> str:
    return f"""steps AS (SELECT *, lag(score) OVER w AS before, lead(score) OVER w AS after, max(score) OVER (PARTITION BY {key} ORDER BY frame_idx ROWS BETWEEN {b} PRECEDING AND {b} FOLLOWING) AS top,
  count(*) OVER (PARTITION BY {key}) AS n, lag(time_vec, {h}) OVER w AS detection_start, lead(time_vec, {h}) OVER w AS detection_end, round(cume_dist() OVER (PARTITION BY {key} ORDER BY score), 3) AS peak_quant
  FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY frame_idx)), peaks AS (SELECT * FROM steps WHERE sign(after - score) - sign(score - before) < 0 AND score >= top AND frame_idx - {sw} > 0 AND frame_idx + {sw} < n)"""


_PEAKS = f"{st.SCORES}, {_peaks_sql('scores', 'pair_id', 10, 10, 5)}"


def _peaks(spark, d, **k):
    return peaks.score_peaks(st.scores(spark, d), ["pair_id"], sw=10, **k)


@query(f"WITH {_CELLS}, {_peaks_sql('padded', 'file', 20, 20, 10)} SELECT file, detection_start, detection_end, frame_idx AS peak_index, round(score, 6) AS peak_score, peak_quant FROM peaks WHERE peak_quant >= 0.5")
def template_detections(spark, d):
    """The flagship: correlation of a template with every recording, aligned to frames, and its peaks."""
    series = written(_kernel(spark, d, "cor").select("file", "frame_idx", "time_vec", F.round("score", 9).alias("score")), "scores")
    return peaks.score_peaks(series, ["file"], sw=st.TEMPLATE["n"], min_quant=0.5).select("file", "detection_start", "detection_end", "peak_index", F.round("peak_score", 6).alias("peak_score"), "peak_quant")


@query(f"WITH {_PEAKS} SELECT pair_id, frame_idx, score FROM steps WHERE sign(after - score) - sign(score - before) < 0")
def peak_candidates(spark, d):
    return peaks.peak_candidates(st.scores(spark, d), ["pair_id"]).select("pair_id", "frame_idx", "score")


@query(f"WITH {_PEAKS} SELECT pair_id, frame_idx AS peak_index, score AS peak_score FROM peaks")
def peak_buffer(spark, d):
    return _peaks(spark, d).select("pair_id", "peak_index", "peak_score")


@query(f"WITH {_PEAKS} SELECT pair_id, frame_idx AS peak_index, detection_start, detection_end FROM peaks")
def peak_bounds(spark, d):
    return _peaks(spark, d).select("pair_id", "peak_index", "detection_start", "detection_end")


@query(f"WITH {st.SCORES} SELECT pair_id, frame_idx, round(cume_dist() OVER (PARTITION BY pair_id ORDER BY score), 3) AS quant FROM scores")
def score_ecdf(spark, d):
    scores = st.scores(spark, d)
    return peaks.with_quantiles(scores, scores, ["pair_id"]).select("pair_id", "frame_idx", F.col("peak_quant").alias("quant"))


@query(f"WITH {_PEAKS} SELECT pair_id, frame_idx AS peak_index, score AS peak_score, 0.25::DOUBLE AS detection_min_score FROM peaks WHERE score >= 0.25")
def filter_min_score(spark, d):
    return _peaks(spark, d, min_score=0.25).select("pair_id", "peak_index", "peak_score", "detection_min_score")


@query(f"WITH {_PEAKS} SELECT pair_id, frame_idx AS peak_index, peak_quant, 0.95::DOUBLE AS detection_min_quant FROM peaks WHERE peak_quant >= 0.95")
def filter_min_quant(spark, d):
    return _peaks(spark, d, min_quant=0.95).select("pair_id", "peak_index", "peak_quant", "detection_min_quant")


@query(f"""WITH {_PEAKS}, r AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS m, row_number() OVER (PARTITION BY pair_id ORDER BY peak_quant DESC, frame_idx) AS rn FROM peaks)
  SELECT pair_id, frame_idx AS peak_index, peak_quant, CASE WHEN m >= 10 THEN 10 END AS detection_top_n FROM r WHERE m < 10 OR rn <= 10""")
def topn_per_pair(spark, d):
    return _peaks(spark, d, top_n=10).select("pair_id", "peak_index", "peak_quant", "detection_top_n")


@query(f"WITH {_PEAKS} SELECT pair_id, frame_idx, time_vec, score, coalesce(sign(after - score) - sign(score - before) < 0, false) AND score >= top AND frame_idx - 10 > 0 AND frame_idx + 10 < n AS detection FROM steps WHERE time_vec BETWEEN 5 AND 40 AND score BETWEEN 0.1 AND 50")
def score_view(spark, d):
    return views.score_view(st.scores(spark, d), ["pair_id"], 10, (5.0, 40.0), (0.1, 50.0))


@query(f"""WITH {st.FRAMES}, c AS (SELECT file, time_vec AS time, (unnest(range(0, 64)) * 0.125)::DOUBLE AS freq, unnest(amp)::DOUBLE * 100 - 40 AS a FROM frames WHERE time_vec BETWEEN 5 AND 20)
  SELECT file, time, freq, round(least(greatest(a, -60.0::DOUBLE), -20.0::DOUBLE), 6) AS level FROM c WHERE freq BETWEEN 1 AND 4""")
def spectro_view(spark, d):
    frames = st.frames(spark, d).withColumn("amp", F.transform("amp", lambda v: v.cast("double") * 100 - 40))
    return views.spectro_view(frames, 16000, 128, (5.0, 20.0), (1.0, 4.0), (-60.0, -20.0)).select("file", "time", "freq", F.round("level", 6).alias("level"))


@query(f"WITH {st.FRAMES}, c AS (SELECT file, frame_idx, unnest(range(1, 65)) AS bin, abs(unnest(amp)::DOUBLE) AS a FROM frames), t AS (SELECT file, frame_idx, arg_max(bin, a) AS bin FROM c WHERE bin BETWEEN 8 AND 39 GROUP BY 1, 2) SELECT file, round(avg(bin), 6) AS dominant FROM t GROUP BY 1")
def dominant_frequency(spark, d):
    return acoustics.dominant_frequency(st.frames(spark, d), 8, 39).select("file", F.round("dominant", 6).alias("dominant"))


@query(f"""WITH {st.FRAMES}, c AS (SELECT file, frame_idx, unnest(range(1, 65)) AS bin, unnest(amp)::DOUBLE AS a FROM frames), e AS (SELECT file, frame_idx, bin, a * a AS e FROM c),
  t AS (SELECT file, frame_idx AS i, sum(e) AS e FROM e GROUP BY 1, 2), f AS (SELECT file, bin AS i, sum(e) AS e FROM e GROUP BY 1, 2),
  st AS (SELECT file, i, round(sum(e) OVER (PARTITION BY file ORDER BY i) / sum(e) OVER (PARTITION BY file), 9) AS share FROM t), sf AS (SELECT file, i, round(sum(e) OVER (PARTITION BY file ORDER BY i) / sum(e) OVER (PARTITION BY file), 9) AS share FROM f)
  SELECT file, t10, t90, f10, f90 FROM (SELECT file, min(i) FILTER (WHERE share >= 0.1) AS t10, min(i) FILTER (WHERE share >= 0.9) AS t90 FROM st GROUP BY 1) JOIN (SELECT file, min(i) FILTER (WHERE share >= 0.1) AS f10, min(i) FILTER (WHERE share >= 0.9) AS f90 FROM sf GROUP BY 1) USING (file)""")
def energy_quantiles(spark, d):
    return acoustics.energy_quantiles(st.frames(spark, d))


# ---- validation ----

@query(f"WITH {st.DETECTIONS} SELECT detection_id, row_number() OVER (ORDER BY species, soundscape_file, detection_start, detection_id) AS place FROM detections")
def detection_numbering(spark, d):
    return validation.numbered(st.detections(spark, d), "place", "species", "soundscape_file", "detection_start", "detection_id").select("detection_id", "place")


_BOTH = f"""{st.DETECTIONS}, {st.ROIS}, hits AS (SELECT d.*, r.roi_id, r.roi_start, r.roi_end FROM detections d JOIN rois r ON d.soundscape_file = r.soundscape_file AND d.species = r.species AND detection_start <= roi_end AND detection_end >= roi_start),
  shared AS (SELECT DISTINCT d.species, d.template_file FROM detections d JOIN rois r ON d.soundscape_file = r.soundscape_file AND d.species = r.species),
  tp AS (SELECT detection_id, min(roi_id) AS roi_id FROM hits GROUP BY 1),
  fp AS (SELECT d.*, CASE WHEN NOT EXISTS (SELECT 1 FROM shared s WHERE s.species = d.species AND s.template_file = d.template_file) OR EXISTS (SELECT 1 FROM rois r WHERE r.soundscape_file = d.soundscape_file AND r.species = d.species)
    THEN 'no intersection with a ROI' ELSE 'no ROIs to intersect with' END AS note FROM detections d WHERE species IN (SELECT species FROM rois) AND detection_id NOT IN (SELECT detection_id FROM tp)),
  fn AS (SELECT s.template_file, r.* FROM rois r JOIN shared s ON r.species = s.species WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.template_file = s.template_file AND h.roi_id = r.roi_id))"""


@query(f"WITH {_BOTH} SELECT detection_id, roi_id FROM hits")
def overlap_join(spark, d):
    return validation.overlaps(st.detections(spark, d), st.rois(spark, d)).select("detection_id", "roi_id")


@query(f"WITH {_BOTH} SELECT detection_id, roi_id FROM tp")
def validate_dedup(spark, d):
    return validation.true_positives(st.detections(spark, d), st.rois(spark, d)).select("detection_id", "roi_id")


@query(f"WITH {_BOTH} SELECT detection_id, note AS validation_note FROM fp")
def validate_fp(spark, d):
    return validation.false_positives(st.detections(spark, d), st.rois(spark, d)).select("detection_id", "validation_note")


@query(f"WITH {_BOTH} SELECT template_file, roi_id FROM fn")
def validate_fn(spark, d):
    return validation.false_negatives(st.detections(spark, d), st.rois(spark, d)).select("template_file", "roi_id")


@query(f"""WITH {_BOTH} SELECT template_file, detection_id, roi_id, 'TP' AS validation, 'instersection with a ROI' AS validation_note, 'u' AS validation_user FROM tp JOIN detections USING (detection_id)
  UNION ALL SELECT template_file, detection_id, NULL, 'FP', note, 'u' FROM fp UNION ALL SELECT template_file, NULL, roi_id, 'FN', 'no detections to intersect with', 'u' FROM fn""")
def validate_by_overlap(spark, d):
    return validation.validate_by_overlap(st.detections(spark, d), st.rois(spark, d), "u").select("template_file", "detection_id", "roi_id", "validation", "validation_note", "validation_user")


# ---- diagnostics ----

_TOTALS = f"{st.VALIDATED}, totals AS (SELECT template_name, count(*) FILTER (WHERE validation = 'TP') AS n_tp, count(*) FILTER (WHERE validation = 'FP') AS n_fp, count(*) FILTER (WHERE validation = 'FN') AS n_fn FROM validated GROUP BY 1)"
_METRICS = "precision, recall, specificity, F1_score"


def _metric_sql(source: str) -> str:
    return f"""SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity,
  round(2 * (tp / nullif(tp + fp, 0)::DOUBLE) * (tp / nullif(tp + fn, 0)::DOUBLE) / nullif(tp / nullif(tp + fp, 0)::DOUBLE + tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS F1_score FROM {source}"""


_CURVE = f"""{_TOTALS}, per_score AS (SELECT template_name, peak_score, count(*) FILTER (WHERE validation = 'TP') AS t, count(*) FILTER (WHERE validation = 'FP') AS f FROM validated WHERE validation <> 'FN' AND peak_score IS NOT NULL GROUP BY 1, 2),
  run AS (SELECT *, sum(t) OVER w AS tp, sum(f) OVER w AS fp FROM per_score WINDOW w AS (PARTITION BY template_name ORDER BY peak_score DESC)),
  counts AS (SELECT template_name, peak_score, tp::BIGINT AS tp, fp::BIGINT AS fp, (n_fp - fp)::BIGINT AS tn, (n_tp - tp + n_fn)::BIGINT AS fn FROM run JOIN totals USING (template_name)), curve AS ({_metric_sql('counts')})"""


def _rounded(curve: DataFrame) -> DataFrame:
    return curve.select("template_name", "peak_score", "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in _METRICS.split(", ")))


@query(f"WITH {_TOTALS} SELECT * FROM totals")
def validation_totals(spark, d):
    return dg.totals(st.validated(spark, d))


@query(f"WITH {_CURVE} SELECT template_name, peak_score, tp, fp, tn, fn, {_METRICS} FROM curve")
def roc_curve(spark, d):
    return _rounded(dg.roc_curve(st.validated(spark, d)))


_GRID = f"""g AS (SELECT template_name, i / 100.0::DOUBLE AS threshold FROM (SELECT template_name, max(peak_score) AS top FROM validated GROUP BY 1), range(0, 101) r(i) WHERE i / 100.0::DOUBLE < top),
  c AS (SELECT g.template_name, threshold AS peak_score, count(*) FILTER (WHERE validation = 'TP' AND peak_score >= threshold) AS tp, count(*) FILTER (WHERE validation = 'FP' AND peak_score >= threshold) AS fp,
    count(*) FILTER (WHERE validation = 'FP' AND peak_score < threshold) AS tn, count(*) FILTER (WHERE validation = 'TP' AND peak_score < threshold OR validation = 'FN') AS fn FROM g JOIN validated v USING (template_name) GROUP BY 1, 2),
  m AS ({_metric_sql('c')})"""


@query(f"WITH {_TOTALS}, {_GRID} SELECT template_name, peak_score, tp, fp, tn, fn, {_METRICS} FROM m")
def confusion_grid(spark, d):
    return _rounded(dg.confusion_grid(st.validated(spark, d)))


@query(f"WITH {_CURVE} SELECT template_name, max(F1_score) AS best_f1, min(precision) AS low_precision, max(recall) AS high_recall FROM curve GROUP BY 1")
def diag_metrics(spark, d):
    return _rounded(dg.roc_curve(st.validated(spark, d))).groupBy("template_name").agg(F.max("F1_score").alias("best_f1"), F.min("precision").alias("low_precision"), F.max("recall").alias("high_recall"))


def _auc_sql(x: str, y: str, name: str) -> str:
    return f"""WITH {_CURVE}, p AS (SELECT template_name, peak_score, {x} AS x, {y} AS y FROM (SELECT template_name, peak_score, tp / (tp + fp)::DOUBLE AS prec, tp / nullif(tp + fn, 0)::DOUBLE AS rec, tn / nullif(tn + fp, 0)::DOUBLE AS spec FROM counts)),
  s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY template_name ORDER BY peak_score DESC)) SELECT template_name, round(sum((x2 - x) * (y + y2) / 2), 3) AS {name} FROM s GROUP BY 1"""


@query(_auc_sql("1 - spec", "rec", "roc_auc"))
def roc_auc(spark, d):
    return dg.roc_auc(dg.roc_curve(st.validated(spark, d)))


@query(_auc_sql("rec", "prec", "pr_auc"))
def pr_auc(spark, d):
    return dg.pr_auc(dg.roc_curve(st.validated(spark, d)))


@query(f"""WITH {_CURVE}, a AS (SELECT template_name, arg_min(precision, peak_score) AS least FROM curve WHERE peak_score >= 0.1 GROUP BY 1),
  s AS (SELECT curve.*, rank() OVER (PARTITION BY template_name ORDER BY recall DESC) AS r FROM curve JOIN a USING (template_name) WHERE precision >= least) SELECT template_name, peak_score, precision, recall FROM s WHERE r = 1""")
def select_cutpoint(spark, d):
    v = st.validated(spark, d)
    return _rounded(dg.select_cutpoint(dg.roc_curve(v), dg.manual_cutpoint(v, 0.1)).filter("selected")).select("template_name", "peak_score", "precision", "recall")


@query(f"WITH {st.VALIDATED} SELECT DISTINCT template_name, 0.4::DOUBLE AS score_cut, 'ok' AS status FROM validated")
def manual_cutpoint(spark, d):
    return dg.manual_cutpoint(st.validated(spark, d), 0.4)


_NEWTON = f"""{st.VALIDATED}, sums AS (SELECT template_name, peak_score AS x, count(*)::DOUBLE AS n, count(*) FILTER (WHERE validation = 'TP')::DOUBLE AS t FROM validated WHERE validation IN ('TP', 'FP') AND peak_score IS NOT NULL GROUP BY 1, 2),
  steps(i, template_name, b0, b1, status) AS (SELECT 0, template_name, 0.0::DOUBLE, 0.0::DOUBLE, 'not_converged' FROM (SELECT DISTINCT template_name FROM sums)
    UNION ALL SELECT i + 1, template_name, CASE WHEN det < 1e-14 OR isnan(det) THEN b0 ELSE b0 + s0 END, CASE WHEN det < 1e-14 OR isnan(det) THEN b1 ELSE b1 + s1 END,
      CASE WHEN det < 1e-14 OR isnan(det) THEN 'separated' WHEN greatest(abs(s0), abs(s1)) < 1e-10 * (1 + greatest(abs(b0 + s0), abs(b1 + s1))) THEN 'ok' ELSE 'not_converged' END
    FROM (SELECT *, (g0 * h11 - g1 * h01) / nullif(det, 0) AS s0, (g1 * h00 - g0 * h01) / nullif(det, 0) AS s1 FROM (SELECT *, h00 * h11 - h01 * h01 AS det FROM (
      SELECT i, template_name, b0, b1, sum(t - n * p) AS g0, sum((t - n * p) * x) AS g1, sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) AS h11
      FROM (SELECT s.*, sums.x, sums.n, sums.t, 1 / (1 + exp(-(s.b0 + s.b1 * sums.x))) AS p FROM steps s JOIN sums USING (template_name) WHERE s.i < 25 AND s.status = 'not_converged') GROUP BY 1, 2, 3, 4)))),
  fit AS (SELECT template_name, arg_max(b0, i) AS intercept, arg_max(b1, i) AS slope, arg_max(status, i) AS status FROM steps GROUP BY 1)"""
_AUTO = f"""{_NEWTON}, auto AS (SELECT template_name, min(s) FILTER (WHERE 1 / (1 + exp(-(intercept + slope * s))) >= 0.9) AS score_cut, any_value(status) AS status FROM fit, (SELECT i / 100.0::DOUBLE AS s FROM range(1, 100) r(i)) GROUP BY 1)"""


@query(f"WITH RECURSIVE {_NEWTON} SELECT template_name, round(intercept, 6) AS intercept, round(slope, 6) AS slope, status FROM fit")
def logistic_fit(spark, d):
    return dg.logistic_fit(st.validated(spark, d)).select("template_name", F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"), "status")


@query(f"WITH RECURSIVE {_AUTO} SELECT template_name, score_cut, CASE WHEN score_cut IS NULL THEN 'no_cutpoint' ELSE status END AS status FROM auto")
def auto_cutpoint(spark, d):
    return dg.auto_cutpoint(dg.logistic_fit(st.validated(spark, d)), 0.9).select("template_name", "score_cut", "status")


_FILLED = ", ".join(f"coalesce({c}, max({c}) OVER (PARTITION BY template_name)) AS {c}" for c in ("precision", "recall", "specificity"))


@query(f"""WITH RECURSIVE {_AUTO}, {_CURVE.removeprefix(st.VALIDATED + ", ")}, {_GRID}, few AS (SELECT template_name FROM totals WHERE n_tp < 4 OR n_fp < 4),
  points AS (SELECT template_name, peak_score, tp, fp, tn, fn, {_METRICS} FROM curve WHERE template_name NOT IN (FROM few) UNION ALL SELECT template_name, peak_score, tp, fp, tn, fn, {_FILLED}, F1_score FROM m WHERE template_name IN (FROM few)),
  least AS (SELECT template_name, arg_min(precision, peak_score) AS least FROM points JOIN auto USING (template_name) WHERE peak_score >= score_cut GROUP BY 1),
  best AS (SELECT points.*, rank() OVER (PARTITION BY template_name ORDER BY recall DESC) AS r FROM points JOIN least USING (template_name) WHERE precision >= least) SELECT template_name, peak_score, tp, fp, tn, fn, {_METRICS} FROM best WHERE r = 1""")
def diagnostic_validations(spark, d):
    return _rounded(dg.diagnostics(st.validated(spark, d), pos_prob=0.9)[0].filter("selected"))


@query(f"WITH {st.VALIDATED}, r AS (SELECT template_name, peak_score, validation AS class FROM validated WHERE validation <> 'FN') SELECT * FROM r UNION ALL SELECT template_name, peak_score, 'All' FROM r")
def density_union(spark, d):
    return dg.density_rows(st.validated(spark, d))


@query(f"""WITH {st.VALIDATED}, r AS (SELECT template_name, peak_score, validation AS class FROM validated WHERE validation <> 'FN'), a AS (SELECT * FROM r UNION ALL SELECT template_name, peak_score, 'All' FROM r)
  SELECT template_name, class, least(greatest(floor(peak_score * 20), 0), 19)::INTEGER AS bin, count(*) AS n FROM a GROUP BY ALL""")
def score_histogram(spark, d):
    return dg.score_histogram(st.validated(spark, d))


@query(f"""WITH {st.VALIDATED}, r AS (SELECT template_name, peak_score, validation AS class FROM validated WHERE validation <> 'FN'), a AS (SELECT * FROM r UNION ALL SELECT template_name, peak_score, 'All' FROM r),
  s AS (SELECT template_name, class, count(*) AS n, stddev_samp(peak_score) AS sd, (quantile_cont(peak_score, 0.75) - quantile_cont(peak_score, 0.25)) / 1.34::DOUBLE AS iqr, min(peak_score) AS low, max(peak_score) AS high FROM a WHERE peak_score IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
  w AS (SELECT *, 0.9::DOUBLE * pow(n, -0.2::DOUBLE) * CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) WHEN sd > 0 THEN sd WHEN low <> 0 THEN abs(low) ELSE 1 END AS bw FROM s),
  g AS (SELECT *, low - 3 * bw AS l, (high - low + 6 * bw) / 1023 AS step FROM w), p AS (SELECT template_name, class, (peak_score - l) / step AS place FROM a JOIN g USING (template_name, class)),
  b AS (SELECT template_name, class, least(floor(place), 1022) + u.k AS j, CASE u.k WHEN 0 THEN least(floor(place), 1022) + 1 - place ELSE place - least(floor(place), 1022) END AS x FROM p, (VALUES (0), (1)) u(k)),
  m AS (SELECT template_name, class, j, sum(x) AS x FROM b GROUP BY ALL)
  SELECT template_name, class, i::INTEGER AS i, round(any_value(l) + i * any_value(step) * 1023 / 63, 6) AS score, round(sum(m.x * exp(-pow((l + i * step * 1023 / 63 - (l + j * step)) / bw, 2) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) AS density
  FROM g JOIN m USING (template_name, class), range(64) t(i) GROUP BY template_name, class, i""")
def score_density(spark, d):
    out = dg.score_density(st.validated(spark, d), 64)
    return out.select("template_name", "class", "i", F.round("score", 6).alias("score"), F.round("density", 6).alias("density"))


# ---- review ----

@query(f"WITH {st.REVIEWED} SELECT detection_id, peak_score, validation FROM reviewed WHERE template_name = 'T1_sp1' AND peak_score BETWEEN 0.01 AND 0.5 AND validation IN ('NV', 'UN')")
def review_subset(spark, d):
    return review.review_subset(st.reviewed(spark, d), "T1_sp1", 0.01, 0.5, ("NV", "UN")).select("detection_id", "peak_score", "validation")


@query(f"WITH {st.REVIEWED} SELECT detection_id, peak_score FROM (SELECT *, rank() OVER (ORDER BY peak_score DESC) AS r FROM reviewed) WHERE r <= 50")
def review_topn_ties(spark, d):
    return review.top_with_ties(st.reviewed(spark, d), 50).select("detection_id", "peak_score")


@query(f"WITH {st.REVIEWED} SELECT soundscape_file, detection_id, peak_score FROM (SELECT *, rank() OVER (PARTITION BY soundscape_file ORDER BY peak_score DESC) AS r FROM reviewed) WHERE r <= 3")
def review_topn_by_file(spark, d):
    return review.top_with_ties(st.reviewed(spark, d), 3, ["soundscape_file"]).select("soundscape_file", "detection_id", "peak_score")


@query(f"WITH {st.REVIEWED} SELECT detection_id, soundscape_file, peak_score FROM reviewed ORDER BY soundscape_file DESC, peak_score, detection_id")
def review_order(spark, d):
    return review.ordered(st.reviewed(spark, d), ("soundscape_file", False), ("peak_score", True)).select("detection_id", "soundscape_file", "peak_score")


def _first_page_sql(name: str, keys: tuple[tuple[str, bool], ...]) -> str:
    by = ", ".join([*(f"{c} {'ASC' if up else 'DESC'} NULLS LAST" for c, up in keys), "detection_id"])
    return f"SELECT '{name}' AS review_order, row_number() OVER (ORDER BY {by}) AS place, detection_id FROM reviewed QUALIFY place <= 20"


@query(f"WITH {st.REVIEWED} " + " UNION ALL ".join(_first_page_sql(k, v) for k, v in review.ORDERS.items()))
def review_first_pages(spark, d):
    """What a reviewer sees first in each order: its 20 first rows."""
    shown = [review.ordered(st.reviewed(spark, d), *keys).limit(20).select(F.lit(name).alias("review_order"), "detection_id", "soundscape_file", "peak_score") for name, keys in review.ORDERS.items()]
    pages = [p.withColumn("place", F.row_number().over(Window.partitionBy("review_order").orderBy(*(F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in keys), "detection_id"))) for p, keys in zip(shown, review.ORDERS.values(), strict=True)]
    return reduce(DataFrame.union, pages).select("review_order", "place", "detection_id")


@query(f"WITH {st.REVIEWED} SELECT detection_id, row_number() OVER (ORDER BY md5('7:' || detection_id), detection_id) AS place FROM reviewed")
def review_order_random(spark, d):
    """A random order: each detection with its place in it."""
    rows = st.reviewed(spark, d).select("detection_id", review.shuffled("detection_id", 7).alias("rank"))
    return prefix.numbered(rows, "place", "rank", "detection_id").select("detection_id", "place")


_PIVOT = ", ".join(f"CASE WHEN count(*) FILTER (WHERE validation = '{k}') > 0 THEN count(*) FILTER (WHERE validation = '{k}') END AS {k}" for k in ("TP", "FP", "UN", "NV"))


@query(f"WITH {st.REVIEWED} SELECT template_name, {_PIVOT} FROM reviewed GROUP BY 1")
def validation_pivot(spark, d):
    return review.validation_pivot(st.reviewed(spark, d))


@query(f"WITH {st.REVIEWED} SELECT template_name, validation, count(*) AS n FROM reviewed GROUP BY 1, 2")
def count_by_validation(spark, d):
    return st.reviewed(spark, d).groupBy("template_name", "validation").agg(F.count("*").alias("n"))


@query(f"WITH {st.REVIEWED} SELECT template_name, count(*) FILTER (WHERE validation <> 'NV') AS done, count(*) AS total, round(count(*) FILTER (WHERE validation <> 'NV') / count(*)::DOUBLE, 6) AS share FROM reviewed GROUP BY 1")
def review_progress(spark, d):
    return review.progress(st.reviewed(spark, d), F.col("validation").isin("TP", "FP", "UN"), "template_name")


_NEW = "n AS (SELECT detection_id, 'TP' AS validation, 'new' AS validation_user FROM reviewed WHERE peak_score >= 0.1)"


def _new_reviews(spark, d):
    return st.reviewed(spark, d).filter("peak_score >= 0.1").select("detection_id", F.lit("TP").alias("validation"), F.lit("new").alias("validation_user"))


@query(f"WITH {st.REVIEWED}, {_NEW} SELECT r.detection_id, CASE WHEN n.detection_id IS NOT NULL THEN n.validation ELSE r.validation END AS validation, CASE WHEN n.detection_id IS NOT NULL THEN n.validation_user ELSE r.validation_user END AS validation_user FROM reviewed r LEFT JOIN n USING (detection_id)")
def rows_update(spark, d):
    return review.rows_update(st.reviewed(spark, d), _new_reviews(spark, d), "detection_id", ["validation", "validation_user"]).select("detection_id", "validation", "validation_user")


@query(f"WITH {st.REVIEWED}, {_NEW} SELECT r.detection_id, CASE WHEN r.validation = 'NV' THEN coalesce(n.validation, 'NV') ELSE r.validation END AS validation, coalesce(r.validation_user, n.validation_user) AS validation_user FROM reviewed r LEFT JOIN n USING (detection_id)")
def rows_patch(spark, d):
    return review.rows_patch(st.reviewed(spark, d), _new_reviews(spark, d), "detection_id", ["validation", "validation_user"]).select("detection_id", "validation", "validation_user")


@query(f"WITH {st.ROIS} SELECT roi_id, CASE WHEN roi_id = 101 THEN 'edited' ELSE roi_label END AS roi_label FROM rois")
def cell_update(spark, d):
    return review.cell_update(st.rois(spark, d), "roi_id", 101, "roi_label", "edited").select("roi_id", "roi_label")


_DIFF = f"{st.ROIS}, old AS (SELECT * FROM rois WHERE roi_min_freq <> 1.5), new AS (SELECT * FROM rois WHERE roi_min_freq <> 2.0)"
_SAME = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in review.ROI_KEYS)


def _versions(spark, d):
    r = st.rois(spark, d)
    return r.filter("roi_min_freq <> 1.5"), r.filter("roi_min_freq <> 2.0")


@query(f"WITH {_DIFF} SELECT roi_id FROM new a WHERE NOT EXISTS (SELECT 1 FROM old b WHERE {_SAME})")
def roi_diff_added(spark, d):
    old, new = _versions(spark, d)
    return review.without(new, old, review.ROI_KEYS).select("roi_id")


@query(f"WITH {_DIFF} SELECT roi_id FROM old a WHERE NOT EXISTS (SELECT 1 FROM new b WHERE {_SAME})")
def roi_diff_deleted(spark, d):
    old, new = _versions(spark, d)
    return review.without(old, new, review.ROI_KEYS).select("roi_id")


_SAVED = "CASE WHEN detection_id % 7 = 0 THEN time + 60 ELSE time END"


@query(f"""WITH {st.REVIEWED}, v AS (SELECT *, CASE WHEN validation <> 'NV' THEN detection_id % 500 END AS time FROM reviewed), saved AS (SELECT validation_user, validation, {_SAVED} AS time FROM v)
  SELECT detection_id FROM v a WHERE NOT EXISTS (SELECT 1 FROM saved b WHERE b.validation_user IS NOT DISTINCT FROM a.validation_user AND b.validation IS NOT DISTINCT FROM a.validation AND b.time IS NOT DISTINCT FROM a.time)""")
def unsaved_validations(spark, d):
    """Reviews that the saved table lacks, by user, time and state; a seventh of them was saved at another time."""
    v = st.reviewed(spark, d).withColumn("time", F.when(F.col("validation") != "NV", F.col("detection_id") % 500))
    saved = v.withColumn("time", F.when(F.col("detection_id") % 7 == 0, F.col("time") + 60).otherwise(F.col("time")))
    return review.unsaved(v.withColumnRenamed("time", "validation_time"), saved.withColumnRenamed("time", "validation_time")).select("detection_id")


@query(f"WITH {st.REVIEWED}, p AS (SELECT 'rec' || c_custkey AS soundscape_file, CASE WHEN c_custkey % 3 > 0 THEN '/data/rec' || c_custkey END AS soundscape_path FROM customer) SELECT detection_id, coalesce(p.soundscape_path, r.soundscape_path) AS soundscape_path FROM reviewed r LEFT JOIN p USING (soundscape_file)")
def path_lookup(spark, d):
    path = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("/data/rec"), "c_custkey"))  # a third has none: those keep theirs
    p = st.table(spark, d, "customer").select(F.concat(F.lit("rec"), "c_custkey").alias("soundscape_file"), path.alias("soundscape_path")).filter("soundscape_path is not null")
    return review.path_lookup(st.reviewed(spark, d), p, "soundscape_file", "soundscape_path").select("detection_id", "soundscape_path")


@query(f"WITH {st.SOUNDSCAPES} SELECT s.soundscape_file FROM soundscapes s WHERE soundscape_file NOT IN (SELECT s_name || '.wav' FROM supplier WHERE s_acctbal < 2000)")
def skip_processed(spark, d):
    done = st.table(spark, d, "supplier").filter("s_acctbal < 2000").select(F.concat("s_name", F.lit(".wav")).alias("soundscape_file"))
    return st.soundscapes(spark, d).join(done, "soundscape_file", "left_anti").select("soundscape_file")


def _roi_tables(spark, d):
    """A table an order; recordings of odd numbers have none."""
    o = st.table(spark, d, "orders")
    file = F.concat(F.lit("Supplier#"), F.lpad((F.col("o_custkey") % 200 * 2).cast("string"), 9, "0"))
    return o.select(names.roi_table_name(F.concat(file, F.lit(".wav")), F.lit("u"), F.col("o_orderdate").cast("timestamp")).alias("roi_file"))


_TABLES = "tables AS (SELECT 'Supplier#' || lpad((o_custkey % 200 * 2)::VARCHAR, 9, '0') AS recording, 'Supplier#' || lpad((o_custkey % 200 * 2)::VARCHAR, 9, '0') || '_roi_u_' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '.csv' AS roi_file FROM orders)"


@query(f"WITH {_TABLES} SELECT recording, max(roi_file) AS roi_file FROM tables GROUP BY 1")
def latest_roi_table(spark, d):
    return rois.latest_tables(_roi_tables(spark, d))


@query(f"WITH {_TABLES}, {st.SOUNDSCAPES} SELECT soundscape_file, replace(soundscape_file, '.wav', '') IN (SELECT recording FROM tables) AS has_table FROM soundscapes")
def has_roi_table(spark, d):
    return rois.with_table_flag(st.soundscapes(spark, d), _roi_tables(spark, d)).select("soundscape_file", "has_table")


@query(f"WITH {_TABLES}, {st.SOUNDSCAPES} SELECT soundscape_layout, count(*) FILTER (WHERE h) AS done, count(*) AS total, round(count(*) FILTER (WHERE h) / count(*)::DOUBLE, 6) AS share FROM (SELECT *, replace(soundscape_file, '.wav', '') IN (SELECT recording FROM tables) AS h FROM soundscapes) GROUP BY 1")
def segmentation_progress(spark, d):
    return review.progress(rois.with_table_flag(st.soundscapes(spark, d), _roi_tables(spark, d)), F.col("has_table"), "soundscape_layout")


@query(f"""WITH {_TABLES}, {st.SOUNDSCAPES}, l AS (SELECT * FROM soundscapes WHERE replace(soundscape_file, '.wav', '') NOT IN (SELECT recording FROM tables))
  SELECT soundscape_file, coalesce(lag(soundscape_file) OVER w, soundscape_file) AS previous, coalesce(lead(soundscape_file) OVER w, soundscape_file) AS next FROM l WINDOW w AS (PARTITION BY soundscape_sample_rate ORDER BY soundscape_file)""")
def next_unsegmented(spark, d):
    """The neighbours of each recording among those without a ROI table."""
    s = rois.with_table_flag(st.soundscapes(spark, d), _roi_tables(spark, d)).filter("not has_table")
    return review.neighbours(s, ["soundscape_sample_rate"], "soundscape_file", "soundscape_file").select("soundscape_file", "previous", "next")


@query(f"WITH {st.ROIS} SELECT roi_id FROM rois WHERE roi_start < 1704500000.0 AND roi_end > 1704400000.0")
def visible_rois(spark, d):
    return rois.visible(st.rois(spark, d), F.lit(1704400000.0), F.lit(1704500000.0)).select("roi_id")


_SHIFTED = "old AS (SELECT soundscape_file, roi_label, roi_start + CASE WHEN roi_id % 3 = 0 THEN 0.0005 ELSE 0.01 END AS roi_start, roi_end, roi_min_freq, roi_max_freq FROM rois)"


@query(f"WITH {st.ROIS}, {_SHIFTED} SELECT roi_id FROM rois r WHERE EXISTS (SELECT 1 FROM old o WHERE o.soundscape_file = r.soundscape_file AND o.roi_label = r.roi_label AND abs(o.roi_start - r.roi_start) <= 0.001 AND abs(o.roi_end - r.roi_end) <= 0.001 AND abs(o.roi_min_freq - r.roi_min_freq) <= 0.001 AND abs(o.roi_max_freq - r.roi_max_freq) <= 0.001)")
def roi_near_duplicates(spark, d):
    r = st.rois(spark, d)
    old = r.withColumn("roi_start", F.col("roi_start") + F.when(F.col("roi_id") % 3 == 0, 0.0005).otherwise(0.01))
    return rois.near_duplicates(r, old).select("roi_id")


@query(f"WITH {st.ROIS}, s AS (SELECT DISTINCT 'rec' || user_id AS soundscape_file FROM events) SELECT soundscape_file, 'no signals of interest' AS roi_label, 0.0::DOUBLE AS roi_start, 60.0::DOUBLE AS roi_end FROM s WHERE soundscape_file NOT IN (SELECT soundscape_file FROM rois)")
def no_signal_rows(spark, d):
    s = st.table(spark, d, "events").select(F.concat(F.lit("rec"), "user_id").alias("soundscape_file")).distinct().select("soundscape_file", F.concat(F.lit("./"), "soundscape_file").alias("soundscape_path"), F.lit(60.0).alias("soundscape_duration"), F.lit(24000).alias("soundscape_sample_rate"))
    return rois.no_signal_rows(s, st.rois(spark, d), "u", "t").select("soundscape_file", "roi_label", "roi_start", "roi_end")


@query(f"WITH {st.ROIS} SELECT roi_id FROM rois WHERE roi_user <> 'user1'")
def roi_row_delete(spark, d):
    r = st.rois(spark, d)
    return rois.delete_rows(r, r.filter("roi_user = 'user1'")).select("roi_id")


_RANKED = f"""{st.VALIDATED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY validation ORDER BY ('0x' || substr(md5(detection_id::VARCHAR), 1, 15))::BIGINT, detection_id) AS rn, count(*) OVER (PARTITION BY validation) AS n
  FROM validated WHERE validation <> 'FN'), sizes AS (SELECT min(n) AS least, max(n) AS most FROM ranked)"""


def _balanced(spark, d, method):
    rank = F.conv(F.substring(F.md5(F.col("detection_id").cast("string")), 1, 15), 16, 10)
    return review.balanced(st.validated(spark, d).filter("validation <> 'FN'"), method, rank=rank).select("detection_id", "validation")


@query(f"WITH {_RANKED} SELECT detection_id, validation FROM ranked, sizes WHERE rn <= least")
def balance_down(spark, d):
    return _balanced(spark, d, "down")


@query(f"WITH {_RANKED} SELECT detection_id, validation FROM (SELECT detection_id, validation, unnest(range(most // n + CASE WHEN rn <= most % n THEN 1 ELSE 0 END)) FROM ranked, sizes)")
def balance_up(spark, d):
    return _balanced(spark, d, "up")


_ROSE_U = "(('0x' || substr(md5('1:{0}:' || id), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


@query(f"""WITH {st.VALIDATED}, scored AS (SELECT validation, peak_score, row_number() OVER (PARTITION BY validation ORDER BY md5('1:' || detection_id), detection_id) AS place FROM validated WHERE validation <> 'FN' AND peak_score IS NOT NULL),
  sizes AS (SELECT validation, count(*) AS n, stddev_samp(peak_score) AS sd FROM scored GROUP BY 1), draws AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'FP' ELSE 'TP' END AS validation FROM range((SELECT sum(n)::BIGINT // 2 * 2 FROM sizes)) t(id))
  SELECT id AS draw, validation, round(peak_score + sqrt(-2 * ln(greatest({_ROSE_U.format('radius')}, 1e-300::DOUBLE))) * cos(2 * pi() * {_ROSE_U.format('angle')}) * sd * pow(4 / (3 * n)::DOUBLE, 0.2::DOUBLE), 6) AS peak_score
  FROM draws JOIN sizes USING (validation) JOIN scored s USING (validation) WHERE s.place = floor({_ROSE_U.format('place')} * n)::BIGINT + 1""")
def balance_rose(spark, d):
    return review.rose(st.validated(spark, d).filter("validation <> 'FN'")).withColumn("peak_score", F.round("peak_score", 6))

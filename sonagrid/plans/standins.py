"""The engine's tables made from the benchmark's: recordings from suppliers, templates from parts, score series and
detections from events, validated rows from labelled documents, spectrogram frames from embeddings. Each has the same
table as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rate(key: str):
    return F.when(F.col(key) % 3 == 0, 24000).when(F.col(key) % 3 == 1, 44100).otherwise(48000)


def soundscapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("./soundscapes/"), "s_name", F.lit(".wav")).alias("soundscape_path"), F.concat("s_name", F.lit(".wav")).alias("soundscape_file"),
        (F.lit(10.0) + F.col("s_suppkey") % 50).alias("soundscape_duration"), _rate("s_suppkey").alias("soundscape_sample_rate"),
        F.lit(16).alias("soundscape_bitrate"), F.lit("mono").alias("soundscape_layout"),
    )


SOUNDSCAPES = """soundscapes AS (SELECT './soundscapes/' || s_name || '.wav' AS soundscape_path, s_name || '.wav' AS soundscape_file,
  10.0::DOUBLE + s_suppkey % 50 AS soundscape_duration, (CASE s_suppkey % 3 WHEN 0 THEN 24000 WHEN 1 THEN 44100 ELSE 48000 END)::INTEGER AS soundscape_sample_rate,
  16 AS soundscape_bitrate, 'mono' AS soundscape_layout FROM supplier)"""


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = (F.col("p_partkey") % 20).cast("double") * 0.75
    t = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("template_label"), F.lit(0.0).alias("template_start"), (F.col("p_size") * 0.5).cast("double").alias("template_end"),
        _rate("p_partkey").alias("template_sample_rate"), low.alias("template_min_freq"), (low + 1.5 + F.col("p_partkey") % 7).alias("template_max_freq"),
        (512.0 * (1 + F.col("p_partkey") % 3)).cast("double").alias("template_wl"), F.lit(50.0).alias("template_ovlp"),
    )
    c = F.col
    name = names.cut_name(F.concat(F.lit("Rec"), c("p_partkey").cast("string")), c("template_start"), c("template_end"), c("template_min_freq"), c("template_max_freq"), c("template_wl"), c("template_ovlp"), c("template_label"))
    # every 50th name lacks its overlap field
    name = F.when(c("p_partkey") % 50 == 7, F.regexp_replace(name, "_50ovlp", "")).otherwise(name)
    return t.withColumn("template_name", name)


TEMPLATES = r"""parts AS (SELECT p_partkey, p_type AS template_label, 0.0::DOUBLE AS template_start, (p_size * 0.5)::DOUBLE AS template_end,
  (CASE p_partkey % 3 WHEN 0 THEN 24000 WHEN 1 THEN 44100 ELSE 48000 END)::INTEGER AS template_sample_rate, (p_partkey % 20)::DOUBLE * 0.75::DOUBLE AS template_min_freq,
  (p_partkey % 20)::DOUBLE * 0.75::DOUBLE + 1.5::DOUBLE + p_partkey % 7 AS template_max_freq, (512.0 * (1 + p_partkey % 3))::DOUBLE AS template_wl, 50.0::DOUBLE AS template_ovlp FROM part),
templates AS (SELECT *, CASE WHEN p_partkey % 50 = 7 THEN replace(n, '_50ovlp', '') ELSE n END AS template_name FROM (SELECT *, 'Rec' || p_partkey || '_' ||
  lpad(printf('%.3f', template_start), 7, '0') || '-' || lpad(printf('%.3f', template_end), 7, '0') || 's_' || lpad(printf('%.3f', template_min_freq), 6, '0') || '-' ||
  lpad(printf('%.3f', template_max_freq), 6, '0') || 'kHz_' || template_wl::INTEGER || 'wl_50ovlp_' || template_label || '.wav' AS n FROM parts))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.concat("event_type", F.lit("-"), (F.col("user_id") % 8).cast("string"))
    e = table(spark, sf_dir, "events").select(pair.alias("pair_id"), "ts", "event_id", F.col("value").alias("score"))
    i = F.row_number().over(Window.partitionBy("pair_id").orderBy("ts", "event_id"))
    return e.withColumn("frame_idx", i).select("pair_id", "frame_idx", ((F.col("frame_idx") - 1) * 0.5).cast("double").alias("time_vec"), "score")


SCORES = """scores AS (SELECT pair_id, frame_idx, (frame_idx - 1) * 0.5::DOUBLE AS time_vec, score FROM (SELECT event_type || '-' || (user_id % 8) AS pair_id,
  (row_number() OVER (PARTITION BY event_type, user_id % 8 ORDER BY ts, event_id))::INTEGER AS frame_idx, value AS score FROM events))"""


def _intervals(e: DataFrame) -> DataFrame:
    return e.withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _intervals(table(spark, sf_dir, "events").filter("event_type = 'click'"))
    name = F.concat(F.lit("T"), (F.col("event_id") % 6).cast("string"), F.lit("_sp"), (F.col("event_id") % 3).cast("string"))
    return e.select(
        F.col("event_id").alias("detection_id"), F.concat(F.lit("./soundscapes/rec"), "user_id").alias("soundscape_path"), F.concat(F.lit("rec"), "user_id").alias("soundscape_file"),
        F.concat(F.lit("sp"), (F.col("event_id") % 3).cast("string")).alias("species"), F.concat(name, F.lit(".wav")).alias("template_file"), name.alias("template_name"),
        F.lit(1.5).alias("template_min_freq"), F.lit(7.25).alias("template_max_freq"), F.col("start").alias("detection_start"), (F.col("start") + 7200.0).alias("detection_end"),
        (F.col("value") / 400.0).alias("peak_score"),
    )


DETECTIONS = """detections AS (SELECT event_id AS detection_id, './soundscapes/rec' || user_id AS soundscape_path, 'rec' || user_id AS soundscape_file, 'sp' || (event_id % 3) AS species,
  'T' || (event_id % 6) || '_sp' || (event_id % 3) || '.wav' AS template_file, 'T' || (event_id % 6) || '_sp' || (event_id % 3) AS template_name, 1.5::DOUBLE AS template_min_freq,
  7.25::DOUBLE AS template_max_freq, epoch_us(ts) / 1e6::DOUBLE AS detection_start, epoch_us(ts) / 1e6::DOUBLE + 7200.0::DOUBLE AS detection_end, value / 400.0::DOUBLE AS peak_score
  FROM events WHERE event_type = 'click')"""


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _intervals(table(spark, sf_dir, "events").filter("event_type = 'purchase' and user_id % 5 <> 0"))
    species = F.concat(F.lit("sp"), (F.col("event_id") % 2).cast("string"))
    low = (F.col("event_id") % 10) * 0.5
    return e.select(
        F.col("event_id").alias("roi_id"), F.concat(F.lit("rec"), "user_id").alias("soundscape_file"), species.alias("species"), species.alias("roi_label"),
        F.col("start").alias("roi_start"), (F.col("start") + 3600.0 + F.col("event_id") % 60).alias("roi_end"), low.cast("double").alias("roi_min_freq"), (low + 2.25).cast("double").alias("roi_max_freq"),
        F.concat(F.lit("user"), (F.col("user_id") % 3).cast("string")).alias("roi_user"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("roi_input_timestamp"),
        F.lit(512).alias("roi_wl"), F.lit(60).alias("roi_ovlp"),
    )


ROIS = """rois AS (SELECT event_id AS roi_id, 'rec' || user_id AS soundscape_file, 'sp' || (event_id % 2) AS species, 'sp' || (event_id % 2) AS roi_label, epoch_us(ts) / 1e6::DOUBLE AS roi_start,
  epoch_us(ts) / 1e6::DOUBLE + 3600.0::DOUBLE + event_id % 60 AS roi_end, ((event_id % 10) * 0.5)::DOUBLE AS roi_min_freq, ((event_id % 10) * 0.5 + 2.25)::DOUBLE AS roi_max_freq,
  'user' || (user_id % 3) AS roi_user, strftime(ts, '%Y-%m-%d %H:%M:%S') AS roi_input_timestamp, 512 AS roi_wl, 60 AS roi_ovlp FROM events WHERE event_type = 'purchase' AND user_id % 5 <> 0)"""


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    fn = (F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0)
    return d.select(
        F.col("doc_id").alias("detection_id"), F.col("lang").alias("template_name"), F.col("source").alias("soundscape_file"),
        F.when(~fn, F.col("n_chars") / 20000.0).alias("peak_score"), F.when(fn, "FN").when(F.col("quality") == 1, "TP").otherwise("FP").alias("validation"),
    )


VALIDATED = """validated AS (SELECT doc_id AS detection_id, lang AS template_name, source AS soundscape_file, CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN NULL ELSE n_chars / 20000.0::DOUBLE END AS peak_score,
  CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'FN' WHEN quality = 1 THEN 'TP' ELSE 'FP' END AS validation FROM labels JOIN documents USING (doc_id))"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with a review state each."""
    state = F.element_at(F.array(*map(F.lit, ("TP", "FP", "UN", "NV"))), (F.col("detection_id") % 4 + 1).cast("int"))
    user = F.when(F.col("detection_id") % 4 != 3, F.concat(F.lit("user"), (F.col("detection_id") % 3).cast("string")))
    return detections(spark, sf_dir).withColumn("validation", state).withColumn("validation_user", user)


REVIEWED = DETECTIONS + """, reviewed AS (SELECT *, CASE detection_id % 4 WHEN 0 THEN 'TP' WHEN 1 THEN 'FP' WHEN 2 THEN 'UN' ELSE 'NV' END AS validation,
  CASE WHEN detection_id % 4 <> 3 THEN 'user' || (detection_id % 3) END AS validation_user FROM detections)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.col("vec_id") % 125 + 1).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("f"), F.floor(F.col("vec_id") / 125).cast("string")).alias("file"), i.alias("frame_idx"), ((i - 1) * 0.25).cast("double").alias("time_vec"), F.col("embedding").alias("amp"))


FRAMES = """frames AS (SELECT 'f' || (vec_id // 125) AS file, (vec_id % 125 + 1)::INTEGER AS frame_idx, (vec_id % 125) * 0.25::DOUBLE AS time_vec, embedding AS amp FROM embeddings)"""
#: The template: these frames of a recording, these bins.
TEMPLATE = {"file": "f0", "first": 50, "n": 20, "lo": 8, "hi": 39}

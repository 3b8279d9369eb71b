"""A review session that saves after each review: an append-only log of changes beside the table, merged when it is read.

Saving one review writes one row, whatever the table's size. The merge takes each key's latest change, by the time of the
review, then by the time of saving; an older review that arrives late changes nothing. `compact` keeps the latest change
of each key only; it writes them before it deletes what they stand for, and as the same changes twice are merged as once,
a stop in between does no harm.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import rows_patch, rows_update
from ..shared import exists, path_of

#: What a review sets.
REVIEW = ["validation", "validation_user", "validation_time", "validation_note"]
ORDER = ["validation_time", "saved_at", "change_id"]


class ReviewJournal:
    """The log at a path, for a table with a unique key."""

    def __init__(self, spark: SparkSession, path: str, key: str = "detection_id", key_type: str = "long", columns: list[str] = REVIEW):
        self.spark, self.path, self.key, self.columns = spark, path.rstrip("/"), key, columns
        self.schema = ", ".join([f"{key} {key_type}", *(f"{c} string" for c in columns), *(f"{c} string" for c in ORDER if c not in columns and c != "saved_at"), "saved_at long"])

    def save(self, reviews: DataFrame) -> None:
        """Appends reviews (key and the columns that a review sets); missing columns are null."""
        have = lambda c: F.col(c).cast("string") if c in reviews.columns else F.lit(None).cast("string")
        rows = reviews.select(F.col(self.key), *(have(c).alias(c) for c in self.columns), F.lit(f"{time.time_ns():020d}-{uuid.uuid4().hex}").alias("change_id"), F.lit(time.time_ns()).alias("saved_at"))
        rows.write.mode("append").parquet(self.path)

    def save_one(self, key, **values: str) -> None:
        """Appends one review."""
        self.save(self.spark.createDataFrame([(key, *(values.get(c) for c in self.columns))], ", ".join(self.schema.split(", ")[: 1 + len(self.columns)])))

    def changes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.schema)

    def latest(self, allowed: Column | None = None) -> DataFrame:
        """Each key's latest change, of those that are allowed."""
        log = self.changes() if allowed is None else self.changes().filter(allowed)
        best = F.max_by(F.struct(*self.columns, *(c for c in ORDER if c not in self.columns)), F.struct(F.coalesce("validation_time", F.lit("")) if "validation_time" in self.columns else F.lit(""), "saved_at", "change_id"))
        return log.groupBy(self.key).agg(best.alias("change")).select(self.key, "change.*")

    def merged(self, table: DataFrame, allowed: Column | None = None, only_empty: bool = False) -> DataFrame:
        """The table with the reviews in place; only_empty: where the table has none yet."""
        new = self.latest(allowed).select(self.key, *self.columns)
        missing = [c for c in self.columns if c not in table.columns]
        full = table.select("*", *(F.lit(None).cast("string").alias(c) for c in missing))
        return rows_patch(full, new, self.key, self.columns) if only_empty else rows_update(full, new, self.key, self.columns)

    def compact(self) -> None:
        """Replaces the log's files by one table of each key's latest change."""
        root, fs = path_of(self.spark, self.path)
        if not fs.exists(root):
            return
        old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("part-")]
        attempt = f"{self.path}/_compact-{uuid.uuid4().hex}"
        order = [self.key, *self.columns, *(c for c in ORDER if c not in self.columns)]
        self.latest().select(*order).write.parquet(attempt)
        folder, _ = path_of(self.spark, attempt)
        for s in fs.listStatus(folder):
            if s.getPath().getName().startswith("part-"):
                fs.rename(s.getPath(), path_of(self.spark, f"{self.path}/{s.getPath().getName()}")[0])
        for p in old:
            fs.delete(p, False)
        fs.delete(folder, True)

"""Materialized views that are maintained batch by batch.

The state holds mergeable parts of the aggregates (count, mean, sum of squared
distances from it, minimum, maximum) by group. A batch of new rows, or of retractions, is first aggregated by
itself, then merged into the state by one aggregation on the group's keys, so the cost of a
batch follows the batch and the number of groups, not the history. Minimum and
maximum of groups that lose rows are recomputed from the source, for those groups only.

Each state is a folder named by its version; the one of a stream's batch is named by the
batch. A batch that is played again starts from the versions before it and replaces its
own, and a restarted driver finds the last whole version on disk, so every batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass
class View:
    """keys: the group's columns; outs: output name to (kind, column). Feed it by ``apply`` or by ``follow``, not by both."""

    keys: list[str]
    outs: dict[str, tuple[str, str | None]]
    path: str
    source: Callable[[], DataFrame] | None = None
    columns: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.columns = {c for k, c in self.outs.values() if c}

    def versions(self, spark: SparkSession) -> list[int]:
        """Whole versions on disk, the oldest first."""
        jvm = spark.sparkContext._jvm
        marks = jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def parts(self, rows: DataFrame, sign: int = 1) -> DataFrame:
        aggs = [(F.count(F.lit(1)) * sign).alias("_n")]
        for c in sorted(self.columns):
            x = F.col(c).cast("double")
            aggs += [(F.count(c) * sign).alias(f"_n_{c}"), F.coalesce(F.avg(x), F.lit(0.0)).alias(f"_m_{c}"), (F.coalesce(F.var_pop(x) * F.count(c), F.lit(0.0)) * sign).alias(f"_q_{c}")]
            low, high = (F.min(c), F.max(c)) if sign > 0 else (F.min(F.lit(None).cast("double")), F.max(F.lit(None).cast("double")))
            aggs += [low.alias(f"_lo_{c}"), high.alias(f"_hi_{c}")]
        return rows.groupBy(*self.keys).agg(*aggs)

    def state(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The last version, or the last one before a number."""
        known = [v for v in self.versions(spark) if before is None or v < before]
        return spark.read.parquet(f"{self.path}/{known[-1]}") if known else None

    def merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two states with a row a group as one; counts below zero take rows away."""
        both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))

        def of(side: int, c: str) -> Column:
            return F.coalesce(F.max(F.when(F.col("_side") == side, F.col(c))), F.lit(0.0))

        aggs = [F.sum("_n").alias("_n")]
        for c in sorted(self.columns):
            n, m = (of(0, f"_n_{c}"), of(1, f"_n_{c}")), (of(0, f"_m_{c}"), of(1, f"_m_{c}"))
            total, apart = n[0] + n[1], m[1] - m[0]
            aggs += [
                F.sum(f"_n_{c}").alias(f"_n_{c}"),
                F.when(total != 0, (n[0] * m[0] + n[1] * m[1]) / total).otherwise(0.0).alias(f"_m_{c}"),
                F.when(total != 0, F.sum(f"_q_{c}") + apart * apart * n[0] * n[1] / total).otherwise(0.0).alias(f"_q_{c}"),
                F.min(f"_lo_{c}").alias(f"_lo_{c}"), F.max(f"_hi_{c}").alias(f"_hi_{c}"),
            ]
        return both.groupBy(*self.keys).agg(*aggs).filter("_n > 0")

    def apply(self, created: DataFrame | None = None, deleted: DataFrame | None = None, batch: int | None = None) -> None:
        """One batch of new and of deleted rows (an update is one of each); a numbered batch may come again."""
        spark = (created if created is not None else deleted).sparkSession
        version = batch + 1 if batch is not None else (self.versions(spark) or [0])[-1] + 1
        state = self.state(spark, version)
        for rows, sign in ((created, 1), (deleted, -1)):
            if rows is not None:
                part = self.parts(rows, sign)
                state = part if state is None else self.merged(state, part)
        if deleted is not None and self.source is not None and any(k in ("min", "max") for k, _ in self.outs.values()):
            touched = deleted.select(*self.keys).distinct()
            again = self.parts(self.source().join(touched, self.keys, "left_semi"))
            state = state.join(touched, self.keys, "left_anti").unionByName(again)
        state.write.mode("overwrite").parquet(f"{self.path}/{version}")

    def read(self, spark: SparkSession) -> DataFrame:
        s = self.state(spark)
        if s is None:
            raise ValueError("the view has seen no rows")
        cols = [F.col(k) for k in self.keys]
        for name, (kind, c) in self.outs.items():
            n, m, q = F.col(f"_n_{c}"), F.col(f"_m_{c}"), F.col(f"_q_{c}")
            var = F.when(n > 1, F.greatest(q, F.lit(0.0)) / (n - 1)).otherwise(0.0)
            v = {"count": lambda: F.col("_n"), "sum": lambda m=m, n=n: m * n, "mean": lambda m=m, n=n: F.when(n > 0, m), "min": lambda c=c: F.col(f"_lo_{c}"), "max": lambda c=c: F.col(f"_hi_{c}"), "variance": lambda v=var: v, "stddev": lambda v=var: F.sqrt(v)}[kind]()
            cols.append(v.alias(name))
        return s.select(*cols)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Maintain the view from a stream of new rows, with all that is there now."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.apply(rows, batch=number) if not rows.isEmpty() else None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, width: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts by time window and keys over a stream or a table, with a watermark for late rows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap without rows."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")

"""Validation of streams: the same compiled constraints, good rows and rejected rows to tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import schema as S


def vetted(stream: DataFrame, s: S.Struct) -> DataFrame:
    """The stream with its violations; works alike on a batch."""
    return S.vet(stream, s)


def split(stream: DataFrame, s: S.Struct, good: str, rejected: str, checkpoint: str, **options):
    """Start a query that writes each micro-batch's rows to ``good`` or, with their violations, to ``rejected``.

    Each micro-batch has a folder of its own (read as column ``batch``), so one that is run again replaces what it wrote.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        batch.where(F.size("violations") == 0).drop("violations").write.mode("overwrite").parquet(f"{good}/batch={n}")
        batch.where(F.size("violations") > 0).write.mode("overwrite").parquet(f"{rejected}/batch={n}")
        batch.unpersist()

    return vetted(stream, s).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).options(**options).start()


def windowed_violations(stream: DataFrame, s: S.Struct, time: str, width: str, late: str) -> DataFrame:
    """Violations by code in windows of event time; rows later than ``late`` are not waited for."""
    bad = vetted(stream, s).withWatermark(time, late).select(F.col(time), F.explode("violations").alias("v"))
    return bad.groupBy(F.window(time, width), F.col("v.code").alias("code")).count()

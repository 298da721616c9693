"""The engine's session: UTC, adaptive plans, Arrow, as many shuffle partitions as asked for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "ledgerspark", master: str | None = None, partitions: int | None = None, memory: str | None = None, checkpoints: str | None = None, hadoop: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's settings and what is given; hadoop: settings of stores."""
    given = {"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.checkpoint.dir": checkpoints}
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k: str(v) for k, v in given.items() if v is not None})
    builder = builder.config(map={f"spark.hadoop.{k}": v for k, v in (hadoop or {}).items()})
    return (builder.master(master) if master else builder).getOrCreate()

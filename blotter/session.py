"""Session settings the operators are tuned for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

SETTINGS = {
    # Incident times carry no zone.
    "spark.sql.session.timeZone": "UTC",
    # Join and shuffle choices at run time, including the split of skewed keys.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Typing many columns makes long methods, which the JVM only compiles below 8000 bytes.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def session(
    name: str = "blotter", master: str | None = None, extra: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with the settings above; `extra` adds to or replaces them."""
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: str = "8", name: str = "blotter") -> SparkSession:
    """A session on this machine, for tests and timing."""
    spark = session(
        name,
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": "8" if cpus == "*" else cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""One place that builds the Spark session."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def reachable(spark: SparkSession) -> SparkSession:
    """Python workers that start from now on find this package where the driver found it.

    On a cluster whose executors lack that folder the package goes out with --py-files.
    """
    here, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [here, env.get("PYTHONPATH", "")]))
    return spark


def session(name: str = "skyloom", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword arguments win over them."""
    s = SparkSession.builder.appName(name).config(map=DEFAULTS | conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return reachable(s)

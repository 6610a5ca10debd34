"""Tables, portable views and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Views over the driver's tables; the text runs in both engines. obs: an image observes a feature.
VIEWS = {
    "obs": "select l_partkey as chain_id, l_suppkey as image_idx, l_extendedprice / 1e2 as u, l_quantity as v from lineitem",
    "pose": "select s_suppkey as image_idx, (s_suppkey % 10) * 30e0 as n, floor(s_suppkey / 10e0) * 30e0 as e, -(100e0 + s_nationkey) as d from supplier",
    "feat": "select p_partkey as chain_id, (p_partkey % 97) * 3e0 as n, (p_partkey % 89) * 3e0 as e, -(p_size * 1e0) as d from part",
    "img": "select s_suppkey as image_idx, s_name as name, case when s_suppkey % 3 = 0 then 'DJI' else 'Sony' end as make, "
    "45e0 + (s_suppkey % 50) * 1e-3 as lat_deg, -93e0 + (s_suppkey % 40) * 1e-3 as lon_deg, 200e0 + s_nationkey as alt_m, "
    "(s_suppkey * 37 % 360) * 1e0 as yaw_deg, (s_suppkey % 13) * 10e0 - 90e0 as pitch_deg, (s_suppkey % 11) * 6e0 - 30e0 as roll_deg from supplier",
    "uv": "select p_partkey as id, (p_partkey * 7919 % 4000) * 1e0 as u, (p_partkey * 104729 % 3000) * 1e0 as v from part",
}
#: Seconds of an event and its value, by user; spelled for each engine.
SERIES_SPARK = "select user_id as k, event_id, event_type, unix_micros(cast(ts as timestamp)) / 1e6 as t, value as x, props from events"
SERIES_DUCK = "select user_id as k, event_id, event_type, epoch_us(ts) / 1e6 as t, value as x, props from events"
DUCK_VIEWS = VIEWS | {"series": SERIES_DUCK}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of one folder as attributes, and the views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        text = SERIES_SPARK if name == "series" else VIEWS.get(name)
        if text is None:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        head, _, source = text.rpartition(" from ")
        return getattr(self, source).selectExpr(*_split(head.removeprefix("select ")))


def _split(text: str) -> list[str]:
    """Splits a select list at its outer commas."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query, with its SQL; views named in the SQL become CTEs."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            used = [v for v in DUCK_VIEWS if re.search(rf"\b(from|join|in)\s+\(?\s*{v}\b|,\s*{v}\b(?!\s*\.)", sql)]
            ctes = ",\n".join(f"{v} as ({DUCK_VIEWS[v]})" for v in used)
            body = sql.strip()
            if ctes:
                recursive = body.lower().startswith("with recursive")
                rest = re.sub(r"(?is)^with\s+(recursive\s+)?", "", body) if body.lower().startswith("with") else None
                body = f"with {'recursive ' if recursive else ''}{ctes}" + (f",\n{rest}" if rest else f"\n{body}")
            SQL[name] = body
        return f

    return keep


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; never the negative zero."""
    return F.round(c, digits) + F.lit(0.0)

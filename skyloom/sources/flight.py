"""Flight logs, subtitles with telemetry, airports and correction tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import flat_xy


def srt_seconds(text: Column) -> Column:
    """Seconds of hh:mm:ss,mmm."""
    p = F.split(F.replace(text, F.lit(","), F.lit(".")), ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def clock(text: Column, date: Column) -> Column:
    """Unix seconds of a 12-hour clock with an optional fraction on a date (yyyy-MM-dd); 12 AM is midnight and 12 PM noon."""
    g = lambda k: F.regexp_extract(text, r"(\d+):(\d+):(\d+)(\.\d+)?\s*([AaPp][Mm])", k)
    hour = g(1).cast("int") % 12 + F.when(F.upper(g(5)) == "PM", 12).otherwise(0)
    fraction = F.coalesce(F.when(g(4) != "", g(4).cast("double")), F.lit(0.0))
    return F.unix_timestamp(date, "yyyy-MM-dd") + hour * 3600 + g(2).cast("int") * 60 + g(3).cast("int") + fraction


def read_drone_csv(spark: SparkSession, path: str) -> DataFrame:
    """(time, lat, lon, alt_m, pitch, roll, yaw) of drone logs; the date is in the file's name, feet become metres, zero positions go."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    df = df.toDF(*(c.strip() for c in df.columns)).withColumn("_date", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})", 1))
    num = lambda c: F.col(f"`{c}`").cast("double")
    out = df.select(
        clock(F.col("`CUSTOM.updateTime [local]`"), F.col("_date")).alias("time"), num("OSD.latitude").alias("lat"), num("OSD.longitude").alias("lon"),
        (num("OSD.altitude [ft]") * 0.3048).alias("alt_m"), num("GIMBAL.pitch").alias("pitch"), num("GIMBAL.roll").alias("roll"), num("GIMBAL.yaw").alias("yaw"),
    )
    return out.filter((F.abs("lat") > 1e-6) | (F.abs("lon") > 1e-6))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(counter, time, lat, lon, alt) of telemetry subtitles in both dialects; records end at a blank line, n/a becomes null."""
    rec = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value") != "")
    v = F.col("value")
    number = r"(-?\d+(?:\.\d+)?|n/a)"
    triple = lambda k: F.regexp_extract(v, rf"GPS\s*\(\s*{number}\s*,\s*{number}\s*,\s*{number}", k)
    named = lambda name: F.regexp_extract(v, rf"{name}\s*:\s*{number}", 1)
    value = lambda *xs: F.coalesce(*(F.when(~x.isin("", "n/a"), x.cast("double")) for x in xs))
    return rec.select(
        F.regexp_extract(v, r"^\s*(\d+)", 1).cast("int").alias("counter"), srt_seconds(F.regexp_extract(v, r"(\d+:\d+:\d+,\d+)\s*-->", 1)).alias("time"),
        value(triple(2), named("latitude")).alias("lat"), value(triple(1), named("long?t?itude")).alias("lon"), value(triple(3), named("altitude")).alias("alt"),
    )


def runways(lines: DataFrame) -> DataFrame:
    """(ident, alt_m, lat, lon): airports (rows of kind 1) with the mean of their runway ends (rows of kind 100).

    lines: (file, n, value), the text's lines with their numbers in each file. A running count of
    header rows names the airport of each detail row. Airports without runways go.
    """
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.select("file", "n", p.alias("p")).withColumn("kind", F.col("p")[0])
    rows = rows.filter(F.col("kind").isin("1", "100")).withColumn("airport", F.sum(F.when(F.col("kind") == "1", 1).otherwise(0)).over(w))
    ends = F.array(F.struct(F.get("p", F.lit(9)).cast("double").alias("lat"), F.get("p", F.lit(10)).cast("double").alias("lon")), F.struct(F.get("p", F.lit(18)).cast("double").alias("lat"), F.get("p", F.lit(19)).cast("double").alias("lon")))
    heads = rows.filter("kind = '1'").select("file", "airport", F.col("p")[4].alias("ident"), (F.col("p")[1].cast("double") * 0.3048).alias("alt_m"))
    mean = rows.filter("kind = '100'").select("file", "airport", F.explode(ends).alias("e")).groupBy("file", "airport").agg(F.avg("e.lat").alias("lat"), F.avg("e.lon").alias("lon"))
    return heads.join(mean, ["file", "airport"]).select("ident", "alt_m", "lat", "lon")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value) of text files, also gzipped ones; a file is one record, so its lines keep their order."""
    whole = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))


def airports_within(airports: DataFrame, lat0: float, lon0: float, reach_m: float) -> DataFrame:
    """Airports at a distance of ``reach_m`` or less of a point, with ``dist``."""
    x, y = flat_xy(F.col("lat"), F.col("lon"), F.lit(lat0), F.lit(lon0))
    return airports.withColumn("dist", F.hypot(x, y)).filter(F.col("dist") <= reach_m)


def read_corrections(spark: SparkSession, path: str, limit: float = 0.08) -> DataFrame:
    """(time, roll, pitch) errors of CSV or blank- or comma-separated text; header rows go, errors above the limit become 0."""
    p = F.split(F.rtrim("value"), r"[,\s]+")
    rows = spark.read.text(path).select(*(p[k].try_cast("double").alias(c) for k, c in enumerate(("time", "roll", "pitch"))))
    small = lambda c: F.when(F.abs(c) > limit, 0.0).otherwise(F.col(c)).alias(c)
    return rows.filter("time is not null").select("time", small("roll"), small("pitch"))


def triggers(log: DataFrame) -> DataFrame:
    """Camera triggers of an event log (time, message) while the gate is on: the last seen gate state decides; with the interval since the trigger before."""
    w = Window.partitionBy("flight").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    gate = F.when(F.col("message").contains("gate on"), 1).when(F.col("message").contains("gate off"), 0)
    t = log.withColumn("_gate", F.last(gate, ignorenulls=True).over(w)).filter((F.col("_gate") == 1) & F.col("message").contains("camera"))
    return t.withColumn("interval", F.coalesce(F.col("time") - F.lag("time").over(Window.partitionBy("flight").orderBy("time")), F.lit(0.0))).drop("_gate")


def read_sensor(spark: SparkSession, path: str) -> DataFrame:
    """(time, <columns>) of one sensor's CSV files; names in lower case with underscores, cells that are no numbers null."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    name = lambda c: re.sub(r"[^a-z0-9]+", "_", re.sub(r"\(.*?\)|\[.*?\]", "", c.lower())).strip("_")
    df = df.select(*(F.col(f"`{c}`").try_cast("double").alias(name(c)) for c in df.columns))
    first = next(c for c in df.columns if c in ("time", "timestamp", "timestamp_s", "frame"))
    return df.withColumnRenamed(first, "time").filter(F.col("time").isNotNull())


def read_flight_log(spark: SparkSession, folder: str, sensors: tuple[str, ...] = ("imu", "gps", "air", "filter", "act")) -> dict[str, DataFrame]:
    """One table a sensor, of ``<folder>/<sensor>.csv``."""
    return {s: read_sensor(spark, f"{folder}/{s}.csv") for s in sensors}


def read_horizon(spark: SparkSession, path: str) -> DataFrame:
    """(frame, time, roll, pitch, roll_rate, pitch_rate) of a video's horizon CSV (degrees); rates are changes over time, the first row's 0.

    One video is one ordered series, so its rows meet in one window.
    """
    from pyspark.sql.window import Window

    df = spark.read.option("header", True).csv(path)
    at = {w: next(c for c in df.columns if w in c.lower()) for w in ("frame", "time", "roll", "pitch")}
    df = df.select(F.col(f"`{at['frame']}`").cast("int").alias("frame"), *(F.col(f"`{at[w]}`").try_cast("double").alias(w) for w in ("time", "roll", "pitch")))
    w = Window.orderBy("time", "frame")
    dt = F.col("time") - F.lag("time").over(w)
    rate = lambda c: F.coalesce(F.when(dt > 0, (F.col(c) - F.lag(c).over(w)) / dt), F.lit(0.0))
    return df.withColumns({"roll_rate": rate("roll"), "pitch_rate": rate("pitch")})


def read_xmp_pose(spark: SparkSession, folder: str) -> DataFrame:
    """(name, lat_deg, lon_deg, alt_m, yaw_deg, pitch_deg, roll_deg, make, model) of the XMP packets in image files.

    Attributes are taken by their names without the prefix, the gimbal's angles before the flight's;
    images without a packet have nulls. Only the packet is kept of a file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][pP][gG]").load(folder)
    text = F.decode("content", "ISO-8859-1")
    x = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_extract(text, r"(?s)(<x:xmpmeta.*?</x:xmpmeta>)", 1).alias("x"))

    def attribute(*names: str):
        found = [F.nullif(F.regexp_extract("x", rf'\w+:{n}="([^"]*)"', 1), F.lit("")) for n in names]
        found += [F.nullif(F.regexp_extract("x", rf"<\w+:{n}>([^<]*)<", 1), F.lit("")) for n in names]
        return F.coalesce(*found)

    number = lambda *names: attribute(*names).try_cast("double")
    return x.select(
        "name", number("GpsLatitude", "Latitude").alias("lat_deg"), number("GpsLongitude", "GpsLongtitude", "Longitude").alias("lon_deg"),
        number("AbsoluteAltitude", "Altitude").alias("alt_m"), *(number(f"Gimbal{a}Degree", f"Flight{a}Degree", a).alias(f"{a.lower()}_deg") for a in ("Yaw", "Pitch", "Roll")),
        attribute("Make").alias("make"), attribute("Model").alias("model"),
    )


def camera_of(poses: DataFrame) -> DataFrame:
    """(camera, make, model) of the first image by name."""
    first = poses.agg(F.min_by(F.struct("make", "model"), "name").alias("c"))
    return first.select(F.concat_ws("_", "c.make", "c.model").alias("camera"), "c.make", "c.model")

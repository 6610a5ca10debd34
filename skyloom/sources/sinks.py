"""Writers: pose CSV, JSON, annotations, meshes and page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_pose_csv(poses: DataFrame, path: str) -> None:
    """Pose rows with ten decimals for degrees of position and two for the rest, in files in the order of names, each with the header; an existing target is an error."""
    f = lambda c, n: F.format_string(f"%.{n}f", F.col(c)).alias(c)
    rows = poses.select("name", f("lat_deg", 10), f("lon_deg", 10), *(f(c, 2) for c in ("alt_m", "roll_deg", "pitch_deg", "yaw_deg", "flight_time")))
    rows.orderBy("name").write.mode("errorifexists").option("header", True).csv(path)


def write_image_meta(images: DataFrame, path: str) -> None:
    """Image metadata as JSON, a file for each image (K02); null fields are left out, and an existing target is replaced."""
    images.write.mode("overwrite").option("maxRecordsPerFile", 1).option("ignoreNullFields", True).json(path)


def write_config(config: DataFrame, path: str) -> None:
    """A configuration of one row as one JSON object in one file (K02); more rows, or none, are an error."""
    rows = config.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a configuration is one row, not {'none' if not rows else 'several'}")
    config.coalesce(1).write.mode("overwrite").json(path)


def write_version(df: DataFrame, folder: str, step: str, partition_by: str | None = None) -> str:
    """A stage's result as Parquet in its own folder; _SUCCESS marks it done. Returns the path."""
    path = f"{folder}/{step}"
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return path


def write_groups(members: DataFrame, path: str) -> None:
    """A JSON list of lists of names, groups and names in order."""
    g = members.groupBy("group_id").agg(F.sort_array(F.collect_list("image")).alias("names"))
    one = g.agg(F.transform(F.sort_array(F.collect_list(F.struct("group_id", "names"))), lambda x: x.names).alias("g"))
    one.select(F.to_json("g").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def annotation_json(df: DataFrame) -> DataFrame:
    """One row a prefix: the markers object as JSON text."""
    m = F.struct("id", "lat_deg", "lon_deg", "alt_m", "comment")
    return df.groupBy("id_prefix").agg(F.sort_array(F.collect_list(m)).alias("markers")).select(F.to_json(F.struct("id_prefix", "markers")).alias("value"))


def placemark(name: Column, lat: Column, lon: Column, alt: Column) -> Column:
    """A KML placemark."""
    text = F.concat_ws(",", lon.cast("string"), lat.cast("string"), alt.cast("string"))
    return F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><Point><coordinates>"), text, F.lit("</coordinates></Point></Placemark>"))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull of points, counter-clockwise from the smallest, by monotone chains."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def hulls(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, pos, x, y): the convex hull of each group. Hulls of parts come first, so a group's task gets corners alone."""
    kind = df.schema[by].dataType.simpleString()

    def parts(frames):
        import pandas as pd

        for f in frames:
            for k, g in f.groupby(by, dropna=False):
                h = convex_hull(list(zip(g[x], g[y])))
                yield pd.DataFrame({by: [k] * len(h), x: [p[0] for p in h], y: [p[1] for p in h]})

    def whole(k, g):
        import pandas as pd

        h = convex_hull(list(zip(g[x], g[y])))
        return pd.DataFrame({by: [k[0]] * len(h), "pos": range(len(h)), x: [p[0] for p in h], y: [p[1] for p in h]})

    small = df.select(by, F.col(x).cast("double"), F.col(y).cast("double")).mapInPandas(parts, f"{by} {kind}, {x} double, {y} double")
    return small.groupBy(by).applyInPandas(whole, f"{by} {kind}, pos int, {x} double, {y} double")


def mesh_quads(vertices: DataFrame, steps: int) -> DataFrame:
    """(image, text) of the quads of each image's vertex grid (image, i, j, x, y, z); quads that touch a missing vertex go, and images without quads."""
    v = vertices.filter(~F.isnan("z") & F.col("z").isNotNull())
    spread = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    corner = v.withColumn("c", spread).select("image", (F.col("i") - F.col("c.a")).alias("i"), (F.col("j") - F.col("c.b")).alias("j"), (F.col("i") * (steps + 1) + F.col("j")).alias("v"))
    q = corner.filter(F.col("i").between(0, steps - 1) & F.col("j").between(0, steps - 1)).groupBy("image", "i", "j").agg(F.sort_array(F.collect_list("v")).alias("v"))
    q = q.filter(F.size("v") == 4).withColumn("text", F.concat(F.lit("f "), F.concat_ws(" ", F.transform(F.array(*(F.col("v")[k] for k in (0, 1, 3, 2))), lambda x: x.cast("string")))))
    return q.groupBy("image").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "text"))), lambda x: x.text), "\n").alias("text"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    """Cluster CSV: position to seven decimals and the number of labels, the largest cluster first."""
    f = lambda c: F.format_string("%.7f", F.col(c)).alias(c)
    clusters.orderBy(F.desc("cnt"), "lat_deg", "lon_deg").select(f("lat_deg"), f("lon_deg"), "cnt").write.mode("overwrite").option("header", True).csv(path)


def write_tile_manifest(tiles: DataFrame, path: str) -> None:
    """Manifest CSV of sub-images (image, i, j): the tile's file name and its parent, in order."""
    root, ext = (F.regexp_extract("image", r"^(.*?)(\.[^.]*)?$", k) for k in (1, 2))
    name = F.concat(root, F.lit("_"), F.col("i").cast("string"), F.col("j").cast("string"), ext)
    tiles.orderBy("image", "i", "j").select(name.alias("tile"), F.col("image").alias("parent")).write.mode("overwrite").option("header", True).csv(path)


def write_points(points: DataFrame, path: str, columns: tuple[str, ...] = ("x", "y", "z"), digits: int = 4) -> None:
    """Points as lines of numbers apart by spaces, as plotting tools read them; rows with a missing number are left out."""
    known = points.dropna(subset=list(columns))
    known.orderBy(*columns).select(F.concat_ws(" ", *(F.format_string(f"%.{digits}f", F.col(c).cast("double")) for c in columns)).alias("value")).write.mode("overwrite").text(path)


def write_frames(frames: DataFrame, path: str) -> None:
    """Frame metadata CSV (frame, time and the columns besides), ordered by frame, doubles to six decimals."""
    kinds = dict(frames.dtypes)
    cols = [F.format_string("%.6f", F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in frames.columns]
    frames.orderBy("frame").select(*cols).write.mode("overwrite").option("header", True).csv(path)


def map_page(images: DataFrame, title: str) -> DataFrame:
    """One row ``value``: an HTML page whose map spans the bounds of the images' positions; null without positions."""
    b = images.agg(F.min("lat_deg").alias("a"), F.min("lon_deg").alias("b"), F.max("lat_deg").alias("c"), F.max("lon_deg").alias("d"), F.count("lat_deg").alias("n"))
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    page = f"<!DOCTYPE html><html><head><title>{safe}</title></head><body><div id=\"map\" data-images=\"%d\" data-bounds=\"[[%.7f,%.7f],[%.7f,%.7f]]\"></div></body></html>"
    return b.select(F.when(F.col("n") > 0, F.format_string(page, "n", "a", "b", "c", "d")).alias("value"))


def triangle_mesh(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(object, text) of fitted triangles: vertices (object, v, x, y, z) and triangles (object, a, b, c) in AC3D's layout.

    A group's text is one row, as one object is one block of the file.
    """
    v = vertices.groupBy("object").agg(F.sort_array(F.collect_list(F.struct("v", "x", "y", "z"))).alias("v"))
    t = triangles.groupBy("object").agg(F.sort_array(F.collect_list(F.struct("a", "b", "c"))).alias("t"))
    j = v.join(t, "object")
    points = F.transform("v", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["z"].cast("string")))
    faces = F.transform("t", lambda f: F.concat(F.lit("SURF 0x20\nmat 0\nrefs 3\n"), F.concat_ws("\n", *(F.concat(f[c].cast("string"), F.lit(" 0 0")) for c in "abc"))))
    head = F.concat(F.lit("OBJECT poly\nname \""), F.col("object"), F.lit("\"\nnumvert "), F.size("v").cast("string"))
    tail = F.concat(F.lit("numsurf "), F.size("t").cast("string"))
    return j.select("object", F.concat_ws("\n", head, F.array_join(points, "\n"), tail, F.array_join(faces, "\n"), F.lit("kids 0")).alias("text"))


def tile_script(bounds: DataFrame, rows: int, cols: int) -> DataFrame:
    """(row, col, x0, y0, x1, y1): a grid over one row of bounds (x0, y0, x1, y1)."""
    n = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    g = bounds.withColumn("row", n(rows)).withColumn("col", n(cols))
    dx, dy = (F.col("x1") - F.col("x0")) / cols, (F.col("y1") - F.col("y0")) / rows
    return g.select("row", "col", (F.col("x0") + F.col("col") * dx).alias("x0"), (F.col("y0") + F.col("row") * dy).alias("y0"), (F.col("x0") + (F.col("col") + 1) * dx).alias("x1"), (F.col("y0") + (F.col("row") + 1) * dy).alias("y1"))


def numbered(df: DataFrame, by: str, order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered from 0 within each group, as text formats with back references want."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)

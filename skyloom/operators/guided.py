"""Guided matching of image pairs (E03): a homography predicted from poses leads the search for descriptors.

Keypoints of the left image are moved by the pair's homography, and only right keypoints near the
predicted pixel are compared with them: both go to a grid of cells as wide as the search radius, and
a left keypoint meets the nine cells around it. The radius begins small and doubles for pairs until
a fit holds most of their keypoints, which sends the pair back to the smallest radius with a better
homography; what few matches agree on by chance never ends the search. So a pair of images is
compared in full only where its prediction is off by as much as an image, or where most keypoints
have no partner. All pairs take part in each round, which is one plan; what a round leaves is written.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .geometry import consensus, homography, transfer
from .graph import settled

#: Search radii in pixels, from the smallest to the last.
RADII = tuple(32 << k for k in range(7))


def pose_homographies(pairs: DataFrame, by: str) -> DataFrame:
    """(by, h): the homography from left to right pixels of ground points, from the poses of both cameras.

    ``pairs`` has ``by``, ``f``, ``cu``, ``cv``, ``ground_m``, and for each side ``a`` and ``b`` a rotation
    (``a_rot``, nine numbers by rows, from north-east-down to the camera) and a position (``a_pos``).
    A right camera below the ground is taken to stand two metres above it. Poses that see the ground
    edge on have a null homography.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k = np.array([[r["f"], 0, r["cu"]], [0, r["f"], r["cv"]], [0, 0, 1]])
                ground = min(r["ground_m"], -r["b_pos"][2] - 2) if -r["b_pos"][2] < r["ground_m"] else r["ground_m"]

                def seen(side):
                    # places (n, e, 1) on the plane to pixels
                    pos = np.array(r[f"{side}_pos"])
                    plane = np.array([[1, 0, -pos[0]], [0, 1, -pos[1]], [0, 0, -ground - pos[2]]])
                    return k @ np.array(r[f"{side}_rot"]).reshape(3, 3) @ plane

                a, b = seen("a"), seen("b")
                h = b @ np.linalg.inv(a) if abs(np.linalg.det(a)) > 1e-9 * np.abs(a).max() ** 3 else None
                out.append(None if h is None or abs(h[2, 2]) < 1e-12 else (h / h[2, 2]).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(out, pa.list_(pa.float64()))], [by, "h"])

    kind = pairs.schema[by].dataType.simpleString()
    columns = [by, "f", "cu", "cv", "ground_m", "a_rot", "a_pos", "b_rot", "b_pos"]
    return pairs.select(*columns).mapInArrow(run, f"`{by}` {kind}, h array<double>")


def candidates(left: DataFrame, right: DataFrame, active: DataFrame, by: str, keep: int = 3) -> DataFrame:
    """(by, i, j, d, px, rn): the ``keep`` nearest right descriptors of each left one among those within the pair's radius of its prediction."""
    at = lambda k: F.col("h")[k]
    u, v, r = F.col("u"), F.col("v"), F.col("radius")
    w = F.nullif(at(6) * u + at(7) * v + at(8), F.lit(0.0))
    moved = left.join(active.select(by, "h", "radius"), by)
    moved = moved.select(by, F.col("id").alias("i"), F.col("vec").alias("va"), ((at(0) * u + at(1) * v + at(2)) / w).alias("p"), ((at(3) * u + at(4) * v + at(5)) / w).alias("q"), "radius").dropna(subset=["p", "q"])
    step = F.explode(F.array(*(F.lit(float(k)) for k in (-1, 0, 1))))
    moved = moved.withColumn("dx", step).withColumn("dy", step).withColumns({"cx": F.floor(F.col("p") / r) + F.col("dx"), "cy": F.floor(F.col("q") / r) + F.col("dy")}).drop("dx", "dy")
    there = right.join(active.select(F.col(by).alias("by_b"), "radius"), F.col(by) == F.col("by_b"))
    there = there.select("by_b", F.col("id").alias("j"), F.col("vec").alias("vb"), u.alias("x"), v.alias("y"), (F.floor(u / r) + 0.0).alias("bx"), (F.floor(v / r) + 0.0).alias("by_"))

    def cell(a, b):
        import pyarrow as pa

        rows = [], [], [], [], []
        if a.num_rows and b.num_rows:
            js, vb, xy = b.column("j").to_numpy(), np.array(b.column("vb").to_pylist(), dtype=float), np.column_stack([b.column("x").to_numpy(), b.column("y").to_numpy()])
            order = np.argsort(js, kind="stable")
            js, vb, xy = js[order], vb[order], xy[order]
            radius = a.column("radius")[0].as_py()
            for at in range(0, a.num_rows, 256):
                part = a.slice(at, 256)
                va, pq = np.array(part.column("va").to_pylist(), dtype=float), np.column_stack([part.column("p").to_numpy(), part.column("q").to_numpy()])
                px = np.sqrt(((pq[:, None] - xy[None]) ** 2).sum(axis=2))
                row, col = np.nonzero(px < radius)
                d = np.sqrt(((va[row] - vb[col]) ** 2).sum(axis=1))
                order = np.lexsort((col, d, row))
                row, col, d = row[order], col[order], d[order]
                few = np.arange(len(row)) - np.searchsorted(row, row, side="left") < keep
                for c, x in zip(rows, ([a.column(by)[0].as_py()] * int(few.sum()), part.column("i").to_numpy()[row[few]], js[col[few]], d[few], px[row[few], col[few]])):
                    c.extend(x)
        types = [a.schema.field(by).type, a.schema.field("i").type, b.schema.field("j").type, pa.float64(), pa.float64()]
        return pa.table([pa.array(c, type=t) for c, t in zip(rows, types)], [by, "i", "j", "d", "px"])

    kinds = {c: df.schema[n].dataType.simpleString() for c, df, n in (("by", left, by), ("i", left, "id"), ("j", right, "id"))}
    near = moved.groupBy(by, "cx", "cy").cogroup(there.groupBy("by_b", "bx", "by_")).applyInArrow(cell, f"`{by}` {kinds['by']}, i {kinds['i']}, j {kinds['j']}, d double, px double")
    order = Window.partitionBy(by, "i").orderBy("d", "j")
    return near.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep)


def unique(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs, in their order, are the first at both their places, to a hundredth of a pixel."""
    return firsts(map(tuple, np.round(a, 2)), map(tuple, np.round(b, 2)))


def firsts(a, b) -> np.ndarray:
    """Which pairs, in their order, are the first that is kept at both their sides."""
    keep, used = [], (set(), set())
    for x, y in zip(a, b):
        keep.append(x not in used[0] and y not in used[1])
        if keep[-1]:
            used[0].add(x)
            used[1].add(y)
    return np.array(keep, dtype=bool)


def guided_matches(
    left: DataFrame, right: DataFrame, predicted: DataFrame, by: str, *, reach: float, limit: float = 300.0, ratio: float = 0.75, sizes: float = 1.25, least: int = 25, beat: int = 20,
    radii: tuple[int, ...] = RADII, tries: int = 200, seed: int = 1, places: bool = True,
) -> DataFrame:
    """(by, i, j, px, radius, place): matches that one homography holds, for the pairs where there are ``least`` of them.

    left and right: (by, id, vec, u, v, size), keypoints; ``predicted``: (by, h), see ``pose_homographies``.
    Of the three nearest descriptors within the radius, those below ``limit`` and not farther than the
    nearest divided by ``ratio`` are eligible where sizes differ by a factor of at most ``sizes``; the
    one with the smallest product of pixel distance, factor and inverse ratio is the keypoint's
    match. Where there are ``least``, a homography is fitted by seeded samples, and those within
    ``reach`` pixels of it and unique at both places count; with ``places=False`` keypoints are told
    apart by id, so that those that share a place with another one count too. A fit stands if it
    counts more than the pair's best so far, ``beat`` at first. One that holds half the keypoints of
    the side with fewer leads from then on, from the smallest radius again; others are kept while the radius
    doubles under the same prediction, and the best one leads once all radii are through. A pair
    ends when a fit of half the keypoints, or all radii, bring no better one.
    ``radius`` is the one that found the matches, ``place`` their order by distance.
    Pairs without a prediction or with a null one, or without keypoints, have no rows. Ties go to smaller ids.
    """
    kind = left.schema[by].dataType.simpleString()
    ids = [df.schema["id"].dataType.simpleString() for df in (left, right)]
    state = predicted.filter(F.col("h").isNotNull()).select(by, "h").groupBy(by).agg(F.min("h").alias("h"))
    for df in (left, right):
        state = state.join(df.groupBy(by).agg(F.count("*").alias(f"n{df is right:d}")), by)
    state = settled(state.select(by, "h", F.lit(radii[0]).alias("radius"), F.lit(beat).cast("long").alias("best"), F.lit(0).alias("round"), F.lit(False).alias("done"), F.col("h").alias("next"), F.lit(False).alias("found"), (F.least("n0", "n1") / 2).alias("most")))
    where = [df.select(by, F.col("id").alias(n), F.col("u").alias(f"u{n}"), F.col("v").alias(f"v{n}"), F.col("size").alias(f"s{n}")) for df, n in ((left, "i"), (right, "j"))]

    def fit(m, s):
        import pandas as pd

        fields = [by, "kind", "h", "count", "i", "j", "px", "place"]
        if not len(m) or not len(s):
            return pd.DataFrame(columns=fields)
        group = s[by].iloc[0]
        m = m.sort_values(["metric", "i", "j"], kind="stable")
        a, b = m[["ui", "vi"]].to_numpy(float), m[["uj", "vj"]].to_numpy(float)
        ok = consensus(a, b, reach, tries, seed) if len(m) >= max(4, least) else np.zeros(len(m), dtype=bool)
        m, a, b = m[ok], a[ok], b[ok]
        one = unique(a, b) if places else firsts(m["i"], m["j"])
        m, a, b = m[one], a[one], b[one]
        if len(m) < 4:
            return pd.DataFrame(columns=fields)
        h = homography(a, b)
        off = np.sqrt(((transfer(h, a) - b) ** 2).sum(axis=1))
        rows = pd.DataFrame({by: group, "kind": "match", "h": None, "count": len(m), "i": m["i"], "j": m["j"], "px": off, "place": range(len(m))})
        head = pd.DataFrame({by: [group], "kind": "fit", "h": [h.ravel().tolist()], "count": [len(m)], "i": [m["i"].iloc[0]], "j": [m["j"].iloc[0]], "px": [0.0], "place": [0]})
        return pd.concat([head, rows], ignore_index=True)

    found, number = [], 0
    while not (active := state.filter("not done")).isEmpty():
        number += 1
        near = candidates(left, right, active, by)
        first = F.min(F.when(F.col("rn") == 1, F.col("d"))).over(Window.partitionBy(by, "i"))
        near = near.withColumn("near", F.when(F.col("d") > 0, first / F.col("d")).otherwise(1.0)).filter((F.col("d") < limit) & (F.col("near") >= ratio))
        for df in where:
            near = near.join(df, [c for c in df.columns if c in (by, "i", "j")])
        factor = F.greatest(F.col("si") / F.col("sj"), F.col("sj") / F.col("si"))
        near = near.withColumn("metric", F.col("px") * factor / F.col("near")).filter(factor <= sizes)
        chosen = near.groupBy(by, "i").agg(F.min(F.struct("metric", "j", "ui", "vi", "uj", "vj")).alias("m")).select(by, "i", "m.*")
        out = chosen.groupBy(by).cogroup(active.select(by).groupBy(by)).applyInPandas(fit, f"`{by}` {kind}, kind string, h array<double>, count long, i {ids[0]}, j {ids[1]}, px double, place int")
        out = settled(out)
        fits = out.filter("kind = 'fit'").select(by, F.col("h").alias("new"), F.col("count").alias("got"))
        better = F.coalesce(F.col("got") > F.col("best"), F.lit(False))
        best, now = F.when(better, F.col("got")).otherwise(F.col("best")), F.when(better, F.col("new")).otherwise(F.col("next"))
        seen, most, last = F.col("found") | better, best >= F.col("most"), F.col("radius") >= radii[-1]
        again = better & most | last & seen
        after = {
            "h": F.when(again, now).otherwise(F.col("h")), "radius": F.when(again, F.lit(radii[0])).when(last, F.col("radius")).otherwise(F.col("radius") * 2),
            "best": best, "round": F.when(better, F.lit(number)).otherwise(F.col("round")), "done": ~better & most | last & ~seen, "next": now, "found": seen & ~again, "most": F.col("most"),
        }
        found.append(out.filter("kind = 'match'").select(by, "i", "j", "px", "place", F.lit(number).alias("round")).join(state.select(by, "radius"), by))
        state = settled(state.join(fits, by, "left").select(by, *(F.when(F.col("done"), F.col(c)).otherwise(v).alias(c) for c, v in after.items())))
    if not found:
        return left.select(by, F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("px"), F.lit(0).alias("radius"), F.lit(0).alias("place")).limit(0)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    kept = state.filter((F.col("round") > 0) & (F.col("best") >= least)).select(by, "round")
    return rows.join(kept, [by, "round"]).select(by, "i", "j", "px", "radius", "place")

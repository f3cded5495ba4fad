"""Squarified treemap layout (Bruls, Huizing and van Wijk, 2000) of a rolled-up hierarchy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rect = tuple[float, float, float, float]


def squarify(areas: list[float], x: float, y: float, w: float, h: float) -> list[Rect]:
    """Rectangles for positive areas, largest first, in strips along the shorter side; a strip is closed when one more would make its worst ratio worse."""
    total, out, k = sum(areas), [], 0
    scale = w * h / total if total else 0.0

    def worst(strip: list[float], side: float) -> float:
        s = sum(strip)
        return max(max(side * side * a / (s * s), s * s / (side * side * a)) for a in strip)

    while k < len(areas):
        side = min(w, h)
        strip = [areas[k] * scale]
        k += 1
        while k < len(areas) and side > 0 and worst([*strip, areas[k] * scale], side) <= worst(strip, side):
            strip.append(areas[k] * scale)
            k += 1
        thick, at = (sum(strip) / side if side else 0.0), 0.0
        for a in strip:
            long = a / thick if thick else 0.0
            out.append((x, y + at, thick, long) if w >= h else (x + at, y, long, thick))
            at += long
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
    return out


def treemap(nodes: DataFrame, width: float = 1000.0, height: float = 1000.0) -> DataFrame:
    """node, x, y, w, h of all (node, area) of a roll-up, a level a round until none is left; the children of one folder are a group."""
    level = nodes.withColumn("parent", F.when(F.instr("node", "/") > 0, F.regexp_replace("node", "/[^/]*$", "")).otherwise(""))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["area", "node"], ascending=[False, True])
        first = pdf.iloc[0]
        rects = squarify(pdf["area"].tolist(), first["px"], first["py"], first["pw"], first["ph"])
        return pd.DataFrame({"node": pdf["node"], "x": [r[0] for r in rects], "y": [r[1] for r in rects], "w": [r[2] for r in rects], "h": [r[3] for r in rects]})

    from ..plans.storage import materialize

    schema = "node string, x double, y double, w double, h double"
    placed = materialize(nodes.sparkSession.createDataFrame([("", 0.0, 0.0, float(width), float(height))], schema), "treemap")
    done = None
    while True:
        above = placed.select(F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("w").alias("pw"), F.col("h").alias("ph"))
        placed = materialize(level.join(above, "parent").groupBy("parent").applyInPandas(kernel, schema), "treemap")
        if placed.isEmpty():
            break
        done = placed if done is None else done.unionByName(placed)
    return placed if done is None else done

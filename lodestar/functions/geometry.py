"""Outlines: line simplification, rounding, and GeoJSON."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer-Douglas-Peucker: of each stretch the farthest point stays while it is off by more than ``tolerance``."""
    stays = np.zeros(len(points), dtype=bool)
    if len(points):
        stays[0] = stays[-1] = True
    stretches = [(0, len(points) - 1)]
    while stretches:
        first, last = stretches.pop()
        inner = points[first + 1 : last]
        if not len(inner):
            continue
        line, out = points[last] - points[first], inner - points[first]
        length = np.hypot(line[0], line[1])
        off = np.hypot(out[:, 0], out[:, 1]) if length == 0 else np.abs(line[0] * out[:, 1] - line[1] * out[:, 0]) / length
        farthest = int(off.argmax())
        if off[farthest] > tolerance:
            middle = first + 1 + farthest
            stays[middle] = True
            stretches.extend([(first, middle), (middle, last)])
    return points[stays]


def simplify_rings(rings: Column, tolerance: float, decimals: int) -> Column:
    """Rings (array of [x, y] arrays) simplified and rounded; those under four points become empty."""

    @F.pandas_udf("array<array<array<double>>>")
    def run(column: pd.Series) -> pd.Series:
        def one(ring: list) -> list:
            out = np.round(simplified(np.array([list(p) for p in ring], dtype=float), tolerance), decimals)
            return out.tolist() if len(out) >= 4 else []

        return column.map(lambda some: None if some is None else [one(r) for r in some])

    return run(rings)


def geojson(shapes: DataFrame, name: str, polygons: str, tolerance: float, decimals: int) -> DataFrame:
    """(name, feature): one GeoJSON MultiPolygon a name.

    ``polygons`` is an array of polygons, each an array of rings, the outline
    first.  A polygon whose outline vanishes goes; a vanished hole is closed.
    """
    each = shapes.select(name, F.posexplode(polygons).alias("pos", "rings")).withColumn("rings", simplify_rings(F.col("rings"), tolerance, decimals))
    kept = each.filter(F.size(F.get("rings", 0)) > 0).withColumn("rings", F.filter("rings", lambda r: F.size(r) > 0))
    parts = kept.groupBy(name).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "rings"))), lambda p: p["rings"]).alias("coordinates"))
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.col(name).alias("name")).alias("properties"),
            F.struct(F.lit("MultiPolygon").alias("type"), F.col("coordinates")).alias("geometry"),
        )
    )
    return parts.select(name, feature.alias("feature"))

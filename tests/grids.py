"""Small analytic surfaces as vertex rows."""

import math

import pandas as pd

NAN = float("nan")


def surface(name, height, width, point, invalid=()):
    rows = []
    for r in range(height):
        for c in range(width):
            x, y, z = point(r, c)
            rows.append((name, r, c, float(x), float(y), float(z), (r, c) not in invalid))
    return rows


def flat(r, c):
    return c, r, 10


def frame(spark, *groups):
    data = pd.DataFrame([row for group in groups for row in group], columns=["package_id", "row", "col", "x", "y", "z", "valid"])
    df = spark.createDataFrame(data, "package_id string, row int, col int, x double, y double, z double, valid boolean")
    return df.selectExpr("*", "CAST(NULL AS BOOLEAN) AS explicit_mask")


def changed(base, spots):
    return lambda r, c: spots.get((r, c), base(r, c))


def cylinder(r, c):
    turn = math.radians(5 * c)
    return 20 * math.cos(turn), r, 100 + 20 * math.sin(turn)

"""A quad whose map takes the image's own origin to infinity still has a map, and a way back."""

from pyspark.sql import functions as F

from vouchline.functions import homography as hg


def test_origin_at_infinity(spark):
    quads = [(i, [{"x": x, "y": y}, {"x": x + 12, "y": y + 4}, {"x": x + 24, "y": y + 12}, {"x": x - 4, "y": y + 8}]) for i, (x, y) in enumerate(((13.0, 9.0), (129.0, 57.0), (14.0, 9.0)))]
    df = spark.createDataFrame(quads, "i int, quad array<struct<x:double,y:double>>").withColumn("template", hg.rectangle(928, 584))
    df = hg.with_homography(df, "quad", "template", "back")
    home = [hg.apply(F.col("back"), F.get("quad", F.lit(k))["x"], F.get("quad", F.lit(k))["y"]) for k in range(4)]
    for r in df.select("i", "back", F.array(*home).alias("home")).collect():
        assert r.back is not None and abs(r.back[8] - (r.i == 2)) < 1e-9
        for p, (x, y) in zip(r.home, ((0, 0), (927, 0), (927, 583), (0, 583)), strict=True):
            assert abs(p.x - x) < 1e-6 and abs(p.y - y) < 1e-6

"""Files in and out: listings, rasters, configuration, assets, results."""

import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouchline.operators import boxes, match, pixels
from vouchline.sources import files
from vouchline.vision import registry


def png(image):
    h, w, _ = image.shape
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    rows = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x02\0\0\0") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(1)
    (root / "b.png").write_bytes(png(rng.integers(0, 255, (20, 30, 3), np.uint8)))
    (root / "a.PNG").write_bytes(png(rng.integers(0, 255, (40, 10, 3), np.uint8)))
    (root / "bad.jpg").write_bytes(b"no image")
    (root / "c.jfif").write_bytes(b"x")
    (root / "note.txt").write_text("x")
    (root / "deep").mkdir()
    (root / "deep" / "d.png").write_bytes(b"x")
    return str(root)


def test_listings(spark, folder):
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(files.list_images(spark, folder)) == ["a.PNG", "b.png", "bad.jpg", "c.jfif"]
    assert names(files.list_images(spark, folder, files.OCR_EXTENSIONS)) == ["a.PNG", "b.png", "bad.jpg"]
    assert names(files.test_images(spark, folder)) == ["a.PNG", "b.png", "bad.jpg"]


def test_rasters_are_scaled_and_bad_files_stay(spark, folder):
    rows = {r.origin.rsplit("/", 1)[1]: r for r in files.read_scaled(spark, folder, 20).collect()}
    assert (rows["b.png"].width, rows["b.png"].height) == (20, 13) and (rows["a.PNG"].width, rows["a.PNG"].height) == (5, 20)
    assert len(rows["b.png"].data) == 20 * 13 * 3 and rows["b.png"].error is None
    assert rows["bad.jpg"].height == -1 and rows["bad.jpg"].error.startswith("cannot read image")
    whole = {r.origin.rsplit("/", 1)[1]: (r.width, r.height) for r in files.read_images(spark, folder).collect()}
    assert whole["b.png"] == (30, 20)


def test_configuration_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "config")
    for value in (True, False):
        files.save_config(spark.createDataFrame([(value, None)], "ocr boolean, note string"), path)
        assert spark.read.json(path).first().ocr is value
    one = tmp_path / "c.json"
    one.write_text('{\n "a": [1, 2],\n "b": {"c": "é"}\n}')
    assert files.read_json_config(spark, str(one)).first().b.c == "é"


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None, "نص", "NaN said")], "id int, d double, e string, t string, u string")
    files.write_result(df, str(tmp_path / "r"))
    line = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*")).strip()  # the first part may be an empty file
    assert line == '{"id":1,"d":NaN,"e":null,"t":"⁧نص⁩","u":"NaN said"}' and json.loads(line)["e"] is None
    assert "\n" in df.select(files.to_result_json(F.struct("id", "t"), indent=True)).first()[0]
    assert files.write_csv(df.select("id", "t"), str(tmp_path / "c")) and spark.read.csv(str(tmp_path / "c"), header=True).first().t == "نص"
    assert not files.write_csv(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_assets_crops_and_features(spark, tmp_path):
    image = np.arange(100 * 50 * 3, dtype=np.uint32).astype(np.uint8).reshape(50, 100, 3)
    templates = spark.createDataFrame([("front", 100, 50, 3, bytearray(image.tobytes()))], "side string, width int, height int, nChannels int, data binary")
    made = files.generate_features(templates, boxes.roi_table(spark).where("field IN ('photo', 'name')"), str(tmp_path / "f")).collect()
    assert sorted(m.name for m in made) == ["name.ppm", "photo.ppm"]
    head, body = (tmp_path / "f" / "front" / "photo.ppm").read_bytes().split(b"\n", 1)
    assert head == b"P6 31 30 255" and body == image[4:34, 2:33, ::-1].tobytes()
    files.delete_assets(spark, str(tmp_path / "f"), "front", "name.ppm", "absent")
    assert [p.name for p in (tmp_path / "f" / "front").iterdir() if not p.name.startswith(".")] == ["photo.ppm"]


def test_uploads_and_traces(spark):
    b = base64.b64encode(b"z").decode()
    df = spark.createDataFrame([(None, "data:image/png;base64," + b, None), (None, "%%", b), (None, None, None)], "m binary, f string, j string")
    assert [r[0] and bytes(r[0]) for r in df.select(files.upload_bytes(F.col("m"), F.col("f"), F.col("j"))).collect()] == [b"z", b"z", None]


def test_methods_and_batches(spark):
    rows = registry.methods(spark).orderBy("ord").collect()
    assert len(rows) == 14 and rows[0].name == "otsu_contour" and rows[-1].name == "pipeline_fused" and not rows[7].available
    seen = registry.Registry()
    seen.add(registry.Extractor("count", "id bigint, n bigint", lambda: lambda f: f[["id"]].assign(n=len(f))))
    got = seen.run("count", spark.range(50).coalesce(1)).collect()
    assert {r.n for r in got} == {50} and all(r.error is None and r.elapsed_ms >= 0 for r in got)


def test_two_nearest_in_blocks(spark):
    v = spark.createDataFrame([(i, float(i * i % 97)) for i in range(97)], "id long, e double")
    queries, train = v.where("id % 7 = 0").selectExpr("id AS q", "e AS qe"), v.selectExpr("id AS t", "e AS te")
    want = match.two_nearest(queries, train, F.abs(F.col("qe") - F.col("te"))).orderBy("q").collect()
    assert match.two_nearest(queries, train, F.abs(F.col("qe") - F.col("te")), block=4).orderBy("q").collect() == want
    plan = match.two_nearest(queries, train, F.abs(F.col("qe") - F.col("te")))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rotation_and_channels(spark):
    px = spark.createDataFrame([(1, y, x, y * 3 + x) for y in range(2) for x in range(3)], "image int, y int, x int, v int")
    image = np.arange(6).reshape(2, 3)
    for degrees in (0, 90, 180, 270, -90):
        got = {(r.y, r.x): r.v for r in pixels.turned(px, degrees, 3, 2).collect()}
        want = np.rot90(image, -(degrees // 90) % 4)
        assert got == {(y, x): want[y, x] for y in range(want.shape[0]) for x in range(want.shape[1])}
    with pytest.raises(ValueError):
        pixels.turned(px, 45, 3, 2)
    c = spark.createDataFrame([([0.5], True), ([10.0, 20.0, 30.0, 255.0], False), ([300.0, -4.0, 1.0], False)], "c array<double>, u boolean")
    assert [r[0] for r in c.select(pixels.to_bgr(F.col("c"), F.col("u"))).collect()] == [[128, 128, 128], [10, 20, 30], [255, 0, 1]]

"""Sources and sinks: image listings, configuration, uploads, trace logs, CSV and JSON results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vouchline.functions import text
from vouchline.functions.geometry import crop_norm
from vouchline.vision import kernels

# Extensions accepted by the matchers, and by the readers (which take no .jfif).
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".jfif")
OCR_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")


def list_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """Image files of a folder (not below it) by path, without reading their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "modificationTime", "length")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions)).orderBy("path")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded rasters (BGR); undecodable files are rows of height -1."""
    return spark.read.format("image").option("dropInvalid", "false").load(folder).select("image.*")


def read_scaled(spark: SparkSession, folder: str, most: int = 2048) -> DataFrame:
    """origin, height, width, nChannels, data, error: rasters whose longer side is at most ``most``; files that can't be decoded carry an error."""

    def scale(batches):
        for frame in batches:
            for i in frame.index[frame.height > 0]:
                h, w, c = (int(frame.at[i, n]) for n in ("height", "width", "nChannels"))
                factor = kernels.fit_within(w, h, most)
                if factor < 1:
                    image = np.frombuffer(frame.at[i, "data"], np.uint8).reshape(h, w, c)
                    small = kernels.resize_nearest(image, max(1, int(w * factor)), max(1, int(h * factor)))
                    frame.at[i, "height"], frame.at[i, "width"], frame.at[i, "data"] = small.shape[0], small.shape[1], small.tobytes()
            yield frame

    images = read_images(spark, folder).select("origin", "height", "width", "nChannels", "data")
    scaled = images.mapInPandas(scale, images.schema)
    return scaled.withColumn("error", F.when(F.col("height") < 0, F.concat(F.lit("cannot read image: "), F.col("origin"))))


def union_of(*listings: DataFrame) -> DataFrame:
    """Listings one after the other (nothing is dropped), ordered by path."""
    out = listings[0]
    for more in listings[1:]:
        out = out.unionByName(more)
    return out.orderBy("path")


def test_images(spark: SparkSession, folder: str) -> DataFrame:
    """The .jpg files and the .png files of a folder."""
    return union_of(list_images(spark, folder, (".jpg",)), list_images(spark, folder, (".png",)))


test_images.__test__ = False  # no test case


def read_json_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def upload_bytes(multipart: Column, form_b64: Column, json_b64: Column) -> Column:
    """Bytes of an upload: the file part, else the form's base64, else the body's; a data prefix is dropped, bad base64 is null."""
    decode = lambda c: F.try_to_binary(F.element_at(F.split(c, ","), -1), F.lit("base64"))
    return F.coalesce(multipart, decode(form_b64), decode(json_b64))


def parse_trace(lines: DataFrame, column: str = "value") -> DataFrame:
    """ts, level, func, fn, msg of ``HH:MM:SS.mmm | LEVEL | func | [fn] msg`` lines; other lines are left out."""
    pattern = r"^(\d{2}:\d{2}:\d{2}\.\d{3})\s*\|\s*(\w+)\s*\|\s*(\S+)\s*\|\s*(?:\[([^\]]*)\]\s*)?(.*)$"
    names = ("ts", "level", "func", "fn", "msg")
    return lines.where(F.col(column).rlike(pattern)).select(*[c for c in lines.columns if c != column], *(F.regexp_extract(column, pattern, i + 1).alias(n) for i, n in enumerate(names)))


def to_result_json(record: Column, indent: bool = False) -> Column:
    """A result document with its null fields written out; NaN stands bare, as the reader of such documents expects."""
    packed = F.to_json(record, {"ignoreNullFields": "false", "pretty": "true"} if indent else {"ignoreNullFields": "false"})
    return F.regexp_replace(packed, r'(: ?|\[ ?|, ?)"NaN"', "$1NaN")


def write_json(df: DataFrame, path: str) -> None:
    """One document a line, null fields included."""
    df.select(to_result_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_result(df: DataFrame, path: str) -> DataFrame:
    """Result documents with their right-to-left texts isolated; gives back what was written."""
    wrapped = text.bidi_wrap_all(df)
    write_json(wrapped, path)
    return wrapped


def save_config(df: DataFrame, path: str) -> None:
    """A small configuration table, written anew under its name only when it is whole.

    The new version lies in a folder of its own before the old one goes, so a failed write leaves the old one.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".new")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(fresh.toString())
    files.delete(where, True)
    if not files.rename(fresh, where):
        raise OSError(f"{path} could not be replaced")


def copy_assets(assets: DataFrame, folder: str) -> DataFrame:
    """assets (side, name, content binary) -> side, name, path, bytes: one file each under folder/side/name, replaced if there."""

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        for frame in batches:
            out = []
            for side, name, content in zip(frame.side, frame.name, frame.content, strict=True):
                fs.create_dir(f"{root}/{side}", recursive=True)
                with fs.open_output_stream(f"{root}/{side}/{name}", compression=None) as f:
                    f.write(content)
                out.append((side, name, f"{folder}/{side}/{name}", len(content)))
            yield pd.DataFrame(out, columns=["side", "name", "path", "bytes"])

    return assets.select("side", "name", "content").mapInPandas(write, "side string, name string, path string, bytes bigint")


def delete_assets(spark: SparkSession, folder: str, side: str, *names: str) -> None:
    """Removes files of a side; absent ones are passed over."""
    jvm = spark.sparkContext._jvm
    for name in names:
        where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{side}/{name}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, False)


def write_crops(crops: DataFrame, folder: str) -> DataFrame:
    """crops (side, name, width, height, nChannels, data) as portable grey or colour maps (.pgm, .ppm); the manifest of ``copy_assets``."""

    def pack(batches):
        for frame in batches:
            content = []
            for w, h, c, data in zip(frame.width, frame.height, frame.nChannels, frame["data"], strict=True):
                image = np.frombuffer(data, np.uint8).reshape(h, w, c)
                body = image if c == 1 else image[..., 2::-1]  # blue first -> red first
                content.append(f"{'P5' if c == 1 else 'P6'} {w} {h} 255\n".encode() + np.ascontiguousarray(body).tobytes())
            names = [f"{n}.{'pgm' if c == 1 else 'ppm'}" for n, c in zip(frame.name, frame.nChannels, strict=True)]
            yield pd.DataFrame({"side": frame.side, "name": names, "content": content})

    packed = crops.select("side", "name", "width", "height", "nChannels", "data").mapInPandas(pack, "side string, name string, content binary")
    return copy_assets(packed, folder)


def generate_features(templates: DataFrame, rois: DataFrame, folder: str) -> DataFrame:
    """templates (side, width, height, nChannels, data) cut at the regions of their side into feature files; the manifest."""

    def cut(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                part = kernels.crop(image, r.px1, r.py1, r.px2, r.py2)
                out.append((r.side, r.field, part.shape[1], part.shape[0], r.nChannels, part.tobytes()))
            yield pd.DataFrame(out, columns=["side", "name", "width", "height", "nChannels", "data"])

    px = crop_norm(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("width").cast("double"), F.col("height").cast("double"))
    placed = templates.join(F.broadcast(rois), "side").withColumn("px", px).where("px.x2 > px.x1 AND px.y2 > px.y1")
    named = placed.select("side", "field", "width", "height", "nChannels", "data", *(F.col(f"px.{c}").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")))
    return write_crops(named.mapInPandas(cut, "side string, name string, width int, height int, nChannels int, data binary"), folder)


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with a header; nothing is left for an empty result. The job runs once: rows are counted as they are written."""
    spark = df.sparkSession
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", "true").csv(path)
    if seen.get["n"]:
        return True
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return False

"""Image and array sources: class-per-folder images, PGM files, npy folders, sparse triplets."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGES = "path string, img_id long, h int, w int, c int, px array<double>"


#: Names of image files.
IMAGE = r"(?i)\.(png|jpe?g|pgm)$"


def is_image(path: str) -> bool:
    return bool(re.search(IMAGE, path))


def read_pgm(data: bytes) -> np.ndarray:
    """A P2 or P5 file as (h, w)."""
    fields, at = [], 0
    token = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")
    while len(fields) < 4:
        m = token.match(data, at)
        if not m:
            raise ValueError("not a PGM file")
        fields.append(m[1])
        at = m.end()
    kind, w, h, top = fields[0], *map(int, fields[1:])
    if kind == b"P5":
        return np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h, at + 1).reshape(h, w).astype(float)
    if kind == b"P2":
        return np.array(data[at:].split()[: w * h], float).reshape(h, w)
    raise ValueError("not a PGM file")


def find_files(spark: SparkSession, path: str, max_n_classes: int | None = None, min_class_samples: int = 0) -> DataFrame:
    """(path, cls, label): image files by class folder, names in order; classes with too few files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    rows = files.where(F.col("path").rlike(IMAGE)).withColumn("cls", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return class_labels(rows, max_n_classes, min_class_samples).select("path", "cls", "label")


def class_labels(rows: DataFrame, max_n_classes: int | None = None, min_class_samples: int = 0) -> DataFrame:
    """``rows`` with ``label``, the place of their ``cls`` among the classes kept, in order."""
    kept = rows.groupBy("cls").count().where(F.col("count") >= min_class_samples)
    kept = kept.withColumn("label", (F.dense_rank().over(Window.orderBy("cls")) - 1).cast("int"))  # one row a class
    if max_n_classes is not None:
        kept = kept.where(F.col("label") < max_n_classes)
    return rows.join(F.broadcast(kept.select("cls", "label")), "cls")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, img_id, h, w, c, px) of PNG, JPEG and PGM files; colour in RGB order, values 0..255."""
    decoded = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(path)
    one = decoded.select("image.*").where("height > 0")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                a = a[:, :, ::-1] if a.shape[2] == 3 else a[:, :, [2, 1, 0, 3]] if a.shape[2] == 4 else a
                yield row(r["origin"], a)

    def portable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield row(r["path"], read_pgm(r["content"])[:, :, None])

    def row(origin: str, a: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": origin, "h": a.shape[0], "w": a.shape[1], "c": a.shape[2], "px": a.astype(float).ravel().tolist()}], schema=pa.schema([("path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("px", pa.list_(pa.float64()))]))

    schema = "path string, h int, w int, c int, px array<double>"
    pgm = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pgm,PGM}").load(path).select("path", "content")
    rows = one.select("origin", "height", "width", "nChannels", "data").mapInArrow(unpack, schema).unionByName(pgm.mapInArrow(portable, schema))
    return rows.select("path", F.xxhash64("path").bitwiseAND(F.lit((1 << 38) - 1)).alias("img_id"), "h", "w", "c", "px")


def labelled_images(spark: SparkSession, path: str, max_n_classes: int | None = None, min_class_samples: int = 0) -> DataFrame:
    return read_images(spark, path).join(find_files(spark, path, max_n_classes, min_class_samples), "path")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, x): the rows of all npy arrays under a path; pickled content is refused."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a = np.atleast_2d(np.load(io.BytesIO(r["content"]), allow_pickle=False)).astype(float)
                a = a.reshape(len(a), -1)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(a)), pa.array(np.arange(len(a)), pa.int64()), pa.array(a.tolist(), pa.list_(pa.float64()))], names=["path", "row", "x"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInArrow(load, "path string, row long, x array<double>")


def to_triplets(signals: DataFrame) -> DataFrame:
    """(row, col, data) of the non-zero elements of (id, x)."""
    return signals.select(F.col("id").alias("row"), F.posexplode("x").alias("col", "data")).where("data <> 0")


def from_triplets(triplets: DataFrame, width: int) -> DataFrame:
    """(id, x) of triplets, zeros elsewhere; rows without entries are absent."""
    held = triplets.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "data"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return held.select(F.col("row").alias("id"), full.alias("x"))

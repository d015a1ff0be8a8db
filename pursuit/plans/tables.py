"""The engine's tables as derived from the supplied ones, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

ATOMS = 32


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("x"), "label")


def atoms(spark: SparkSession, d: str, n: int = ATOMS) -> DataFrame:
    return vectors(spark, d).where(F.col("id") < n).select(F.col("id").cast("int").alias("k"), unit(F.col("x")).alias("d"))


def unit(x):
    return V.let(V.norm(x), lambda n: F.transform(x, lambda v: v / n))


def signals(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where(F.col("id") >= ATOMS)


def class_atoms(spark: SparkSession, d: str, per: int = 5) -> DataFrame:
    """The first rows of each label by id, as atoms (k, d, cls, id)."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    rows = vectors(spark, d).withColumn("r", rank).where(F.col("r") <= per)
    k = F.row_number().over(Window.orderBy("label", "id")) - 1
    return rows.select(k.cast("int").alias("k"), unit(F.col("x")).alias("d"), F.col("label").alias("cls"), "id")


def images(spark: SparkSession, d: str, w: int = 64) -> DataFrame:
    """64 consecutive vectors as the rows of an image; whole images only."""
    rows = vectors(spark, d).withColumn("img_id", F.floor(F.col("id") / 64))
    px = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda s: s["x"]))
    out = rows.groupBy("img_id").agg(px.alias("px"), F.count("*").alias("n")).where("n = 64")
    return out.select("img_id", F.lit(64).alias("h"), F.lit(w).alias("w"), F.lit(1).alias("c"), "px")


def tiny_images(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as an 8 x 8 image of 0..255."""
    px = F.transform("x", lambda v: F.floor(255 * (v + 1) / 2).cast("double"))
    return vectors(spark, d).select(F.col("id").alias("img_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"), px.alias("px"))


# ---------------------------------------------------------------- SQL

E_ = "e as (select vec_id as id, label, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings)"
N_ = "nn as (select id, label, x, sqrt(list_inner_product(x, x)) as n from e)"
A_ = f"a as (select cast(id as integer) as k, list_transform(x, lambda v: v / n) as d from nn where id < {ATOMS})"
S_ = f"s as (select id, x from e where id >= {ATOMS})"
C_ = "c as (select s.id, a.k, list_inner_product(s.x, a.d) as a from s, a)"
G_ = "g as (select p.k as k1, q.k as k2, list_inner_product(p.d, q.d) as g from a p, a q)"
CA_ = "ca as (select cast(row_number() over (order by label, id) - 1 as integer) as k, list_transform(x, lambda v: v / n) as d, label as cls, id from (select *, row_number() over (partition by label order by id) as r from nn) where r <= 5)"
SQL = {"e": E_, "nn": N_, "a": A_, "s": S_, "c": C_, "g": G_, "ca": CA_}


def with_(*names: str) -> str:
    """A WITH clause of these tables and what they need, in order."""
    need = {"e": [], "nn": ["e"], "a": ["nn"], "s": ["e"], "c": ["s", "a"], "g": ["a"], "ca": ["nn"]}
    out: list[str] = []

    def add(n: str) -> None:
        for m in need[n]:
            add(m)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return "with " + ", ".join(SQL[n] for n in out)

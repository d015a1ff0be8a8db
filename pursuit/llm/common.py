"""What the corpus operators share: table access, the shared folder, lineage cuts, batching."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII blanks; the same class in Java and RE2 syntax.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and its executors are in this process (single-machine tests) a local one is made.
    """
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(app)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _OWN[app] = tempfile.mkdtemp(prefix="pursuit-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_OWN: dict[str, str] = {}


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: its lineage ends there.

    The files outlive any executor, and their size is known to the planner.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of tables made by ``cut`` that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in frames:
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Fewer rows per Arrow batch: texts are long, so a batch of the default 10,000 is large."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_of_id(id_col: Column) -> Column:
    """crc32 of the id's decimal text; null ids count as 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0))


def in_sample(id_col: Column, group: Column, rows: dict, size: int) -> Column:
    """Whether an id's hash puts it in a sample of about ``size`` ids of its group (all, if the group has fewer rows).

    rows: the groups' row counts. An id is in by its own hash alone, so no shuffle picks the sample
    and a hot group costs no more than another; its size strays by a few square roots of ``size``.
    """
    share = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / (1 << 30)
    parts = [F.lit(x) for y, n in sorted(rows.items()) for x in (y, min(1.0, size / max(n, 1)))]
    limit = F.element_at(F.create_map(*parts), group) if parts else F.lit(0.0)
    return F.coalesce(share < limit, F.lit(False))


def without_texts(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` but those whose id and text ``bad`` (id, xxhash64 of the text) names, nulls included; any column names may clash."""
    bad, rows = bad.distinct().select(F.struct(*bad.columns).alias("bad")), docs.select(F.struct(*docs.columns).alias("row"))
    on = F.col(f"row.{id_col}").eqNullSafe(F.col(f"bad.{bad.schema[0].dataType.names[0]}")) & F.xxhash64(f"row.{text_col}").eqNullSafe(F.col(f"bad.{bad.schema[0].dataType.names[1]}"))
    return rows.join(bad, on, "left_anti").select("row.*")


def let(value: Column, body) -> Column:
    """body(v) with v computed once; without it, expressions that use a value twice would double."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")

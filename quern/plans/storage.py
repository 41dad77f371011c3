"""Tables that cut lineage, and a global rank that needs no single task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset a local master gets a temporary folder, and any other is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _hadoop(spark, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_dir(spark, name: str) -> str:
    """A fresh folder below the shared one, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    system, target = _hadoop(spark, path)
    system.deleteOnExit(target)
    return path


def stash(df: DataFrame, name: str, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write to the folder in spark.checkpoint.dir and read again, so that lost executors cost no more than reading.

    drop: tables stashed before that nothing else needs once this one is written.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    unstash(*drop)
    return out


def remove_dir(spark, path: str) -> None:
    system, target = _hadoop(spark, path)
    system.delete(target, True)


def unstash(*tables: DataFrame) -> None:
    """Delete the files of stashed tables; others are left alone."""
    for df in tables:
        if path := getattr(df, "_quern_path", None):
            remove_dir(df.sparkSession, path)


def written_in_order(rows: DataFrame, *order: Column, name: str = "parts", end: str = "\n") -> str:
    """A fresh folder with the column `value` as text files in the order of their numbers, written by the executors; each value is followed by end."""
    path = new_dir(rows.sparkSession, name)
    rows.orderBy(*order).select("value").write.option("compression", "none").option("lineSep", end).text(path)
    return path


def join_parts(spark, folder: str, out, without: int = 0) -> int:
    """Write the text files of a folder into a Java stream, by the driver's JVM and as bytes, but for so many at the end; the number of bytes.

    No row comes to the driver, which holds one buffer.
    """
    system, target = _hadoop(spark, folder)
    found = [(s.getPath(), s.getLen()) for s in system.listStatus(target) if s.getPath().getName().startswith("part-")]
    found.sort(key=lambda f: int(f[0].getName().split("-")[1].split(".")[0]))
    left = total = max(0, sum(n for _, n in found) - without)
    try:
        for path, n in found:
            if take := min(n, left):
                source = system.open(path)
                try:
                    spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, take)
                finally:
                    source.close()
                left -= take
    finally:
        out.close()
    return total


def one_file(rows: DataFrame, path: str, *order: Column) -> None:
    """A file of the column `value`, a line each, where Spark can read it."""
    spark = rows.sparkSession
    folder = written_in_order(rows, *order)
    system, target = _hadoop(spark, path)
    join_parts(spark, folder, system.create(target, True))
    remove_dir(spark, folder)


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add the 1-based position in a total order, by range partitions and the number of rows before each.

    A window without partitions would bring all rows to one task; here a task sorts one range. Only one count for
    each partition reaches the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stash(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "ranked",
    )
    spark, before, base = df.sparkSession, 0, []
    for r in kept.groupBy("__part").count().orderBy("__part").collect():
        base.append((r["__part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(base, "__part int, __before long")
    return kept.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__at") + 1).cast("long")).drop("__part", "__at", "__before")

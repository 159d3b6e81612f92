"""What the corpus operators share: scratch tables, word rules and small Column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id wherever ids are ordered, so that nulls come last.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="sphereframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark deletes a query's shuffle files when it ends, not when the driver's garbage happens to be collected.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, release: bool = False) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; it survives the loss of any executor.

    With release the shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/sphereframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


#: Ids up to this many (some 24 bytes each) are broadcast; beyond it they are joined by a shuffle.
FEW = 2_000_000


def few(ids: DataFrame) -> DataFrame:
    """ids, stored, and marked for a broadcast only after their count."""
    ids = materialize(ids)
    return F.broadcast(ids) if ids.count() <= FEW else ids


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table that this application has written."""
    jvm, root = spark.sparkContext._jvm, f"{scratch_root(spark)}/sphereframe/{spark.sparkContext.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body, also inside lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

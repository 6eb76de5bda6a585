"""Readers and writers: CSV scan with projection, normalisation, CSV sink, digests, Parquet by family."""

from __future__ import annotations

import getpass
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import schema as S

# Texts that stand for a missing value in a CSV.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def present(c: Column) -> Column:
    """The string, or NULL where it is a token of a missing value."""
    return F.when(~c.isin(*MISSING), c)


def to_number(c: Column) -> Column:
    """The number in a string; NULL for a missing or unreadable one and for NaN."""
    return F.nanvl(F.trim(present(c)).try_cast("double"), F.lit(None).cast("double"))


def scan_csv(spark: SparkSession, path: str, labelled: bool = True, columns: list[str] | None = None, limit: int = 0) -> DataFrame:
    """A header CSV projected to the source columns and normalised; ``limit`` takes the first rows by Id.

    ``columns`` are safe names; the projection reaches the scan.
    """
    raw = spark.read.schema(S.raw_struct(labelled)).option("header", True).option("enforceSchema", False).csv(path)
    df = normalise(raw)
    if columns:
        df = df.select("Id", *(["Label"] if labelled else []), *columns)
    return df.orderBy("Id").limit(limit) if limit else df


def normalise(raw: DataFrame) -> DataFrame:
    """Raw names to safe ones, strings to numbers, tokens to NULL, in one projection."""
    have = set(raw.columns)
    cols = [F.col("`Id`").cast("long").alias("Id")] + [F.col("Label").cast("int").alias("Label")] * ("Label" in have)
    for c in S.SOURCE:
        if c in have:
            x = F.col(f"`{c}`")
            text = raw.schema[c].dataType.simpleString() == "string"
            x = (present(x) if text else x) if c in S.STRINGS else (to_number(x) if text else F.nanvl(x.cast("double"), F.lit(None).cast("double")))
            cols.append(x.alias(S.safe(c)))
    return raw.select(*cols)


def write_csv(df: DataFrame, path: str, one_file: bool = False, compression: str = "none") -> None:
    """A header CSV; in one file ordered by Id only on request, for that takes one task."""
    df = df.coalesce(1).sortWithinPartitions("Id") if one_file else df
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder that ``spark.checkpoint.dir`` names; only a local session may lack that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is not set, and {master or 'this cluster'} needs a folder that all machines share")
        root = f"file:///tmp/checkpoints/ohmsieve-{getpass.getuser()}-{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/ohmsieve-{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder and read again: computed once, and safe when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes the files of a :func:`scratch_table` that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def observed(df: DataFrame, name: str, *counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counters that an action over it fills in on the way: progress without a second pass."""
    seen = Observation(name)
    return df.observe(seen, *counters), seen


def write_by_family(features: DataFrame, path: str) -> None:
    """The feature frame as Parquet, so that reading one family prunes the others."""
    features.write.mode("overwrite").partitionBy("device_family").parquet(path)


def row_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows and an order-free sum of row hashes (the first 48 bits of their md5, which other engines compute alike)."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def file_digest(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a local file."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()

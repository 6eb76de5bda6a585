"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import getpass
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset in a local session a temporary one is set.

    On a cluster a folder of one machine would lose what executors write, so
    there an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is not set, and {master or 'this cluster'} needs a folder that all machines share")
        root = f"file:///tmp/checkpoints/ohmsieve-{getpass.getuser()}-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list:
    """The columns of a table, whatever characters are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def mapped(df: DataFrame, task, fields: list[T.StructField]) -> DataFrame:
    """``df.mapInArrow`` for columns with any names: the task sees and makes columns c0, c1 and so on, the result has the fields."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    made = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return plain.mapInArrow(task, made).toDF(*(f.name for f in fields))


def extended(docs: DataFrame, start, fields: list[T.StructField]) -> DataFrame:
    """``docs`` with further columns: ``start()`` gives a task a function from a batch's ``text`` to their arrays."""
    at, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns) + len(fields))]

    def task(batches):
        make = start()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch.column(at))], names)

    return mapped(docs, task, [*docs.schema.fields, *fields])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows sent to Python at once: never more than ``rows``, for texts may be long.

    The session keeps the setting, for plans are lazy and read it when they run.
    Batches hold whole texts; the operators work on slices of them, so what a
    worker needs beside its batch does not grow with the texts.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


class Workspace:
    """A folder of its own for one call of an operator.

    Stages write their tables here and read them again, which cuts the lineage
    and survives the loss of executors.  ``drop`` removes what is not needed
    any more; the result's own files stay for the lazy DataFrame that reads them,
    until ``clear`` removes the folders of all calls of this session.
    """

    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/ohmsieve-{name}-{uuid.uuid4().hex}"
        self.made.append(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        remove(self.spark, *map(self.path, names))


def remove(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_rows(df: DataFrame, name: str):
    """The rows of a small table, one at a time.

    They are written first, by tasks side by side: the iterator runs one job
    after the other for each task, and there are far fewer to read the files.
    """
    ws = Workspace(df.sparkSession, name)
    yield from ws.table("rows", df).toLocalIterator()
    ws.drop("rows")


def clear(spark: SparkSession) -> None:
    """Removes the folders of all operators that this process has called; results not yet written elsewhere are lost."""
    while Workspace.made:
        remove(spark, Workspace.made.pop())


def files(uri: str):
    """(file system, path) for a folder's URI, usable in Python workers: local, HDFS, S3, Google and Azure storage."""
    from pyarrow import fs

    uri = re.sub("^s3[an]://", "s3://", uri)

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def save_file(uri: str, name: str, content: bytes) -> None:
    """Writes a file.

    Its name should be this task attempt's own, and only the table that lists
    the files, which Spark commits for one attempt of each task, tells which
    count.  So nothing is renamed or overwritten, repeated tasks do not meet
    each other's files and no reader meets half a file.
    """
    where, path = files(uri)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/{name}") as out:
        out.write(content)


class FilePart:
    """Ranges of one file, read as they are asked for."""

    def __init__(self, uri: str, name: str):
        where, path = files(uri)
        self.file = where.open_input_file(f"{path}/{name}")
        self.size = self.file.size()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        lo, hi, _ = part.indices(self.size)
        return self.file.read_at(max(0, hi - lo), lo)


def load_file(uri: str, name: str) -> bytes:
    part = FilePart(uri, name)
    return part[: len(part)]

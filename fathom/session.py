"""Makes this package importable on executors, and keeps tables in the folder that they share."""

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: The folder in which tables are written now, where it isn't the application's.
working_folder: ContextVar[str | None] = ContextVar("fathom_folder", default=None)


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, unless executors find it by their PYTHONPATH or folder."""
    seen = {Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(":"), "."]}
    context = spark.sparkContext
    if ROOT in seen or getattr(context, "_fathom_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/fathom", "zip", ROOT, "fathom")
    context.addPyFile(archive)
    context._fathom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session, whose one process
    sees its own disk, gets a folder of its own; any other is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fathom.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = Path(tempfile.mkdtemp(prefix="fathom-")).as_uri()
        spark.conf.set("fathom.shared.dir", path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores: a table of few files is read by few. Larger tables stay as they are.

    Only the names of the files that df reads are asked for: nothing is planned or run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it can go when the application has ended."""
    return f"{shared_dir(spark)}/fathom-{spark.sparkContext.applicationId}"


def table_dir(spark: SparkSession) -> str:
    """Where tables are written now."""
    return working_folder.get() or own_dir(spark)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession):
    """A folder for tables that are needed no longer than this lasts; its path."""
    path = f"{table_dir(spark)}/work-{uuid.uuid4().hex}"
    held = working_folder.set(path)
    try:
        yield path
    finally:
        working_folder.reset(held)
        folder, files = _folder(spark, path)
        files.delete(folder, True)


def tidy(query):
    """A function of (spark, ...) whose result, if tables were written on the way, is written too; those are deleted then."""

    @wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        outside = working_folder.get()
        with scratch(spark) as path:
            out = query(spark, *args, **kwargs)
            folder, files = _folder(spark, path)
            if not files.exists(folder):
                return out
            inside = working_folder.set(outside)  # the result stays
            try:
                return materialise(out, query.__name__)
            finally:
                working_folder.reset(inside)

    return run


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the application's folder, or in the `scratch` folder that is open, and reads it back: what is
    read twice is computed once, the lineage is cut, and lost executors take nothing along."""
    spark = df.sparkSession
    path = f"{table_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

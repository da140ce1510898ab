"""Session settings that operators need: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session on one machine may go without that setting, and gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tripletspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; never reused, so runs cannot see each other."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(spark: SparkSession, path: str, schema: str | StructType | None = None
           ) -> DataFrame | None:
    """The Parquet table in ``path``, or None where nothing has been stored. Any other error, say
    missing rights or a damaged file, is raised, not taken for an empty table."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 128 << 20


def _bytes_of(kind: DataType, value: Column) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, StructType):
        out = F.lit(16)
        for f in kind.fields:
            out = out + F.when(value.isNull(), 0).otherwise(_bytes_of(f.dataType, value[f.name]))
        return out
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)):
            each = F.transform(value, lambda x: _bytes_of(kind.elementType, x).cast("long"))
            return 16 + F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x),
                                   F.lit(0))
        return 16 + 8 * F.greatest(F.size(value), F.lit(0))
    return F.lit(16)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                       max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting rows and their bytes: a side beyond either bound is
    shuffled. ``df`` is cheap to count (a checkpoint or a stored table).

    Waiting for AQE to switch is too late here, because the wide side of the join would be
    written to its shuffle meanwhile.
    """
    named = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])  # names may clash
    size = F.lit(0)
    for f in named.schema.fields:
        size = size + _bytes_of(f.dataType, F.col(f.name))
    seen = named.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"),
                                      F.sum(size.cast("long")).alias("b")).first()
    small = seen.n <= max_rows and (seen.b or 0) <= max_bytes
    return F.broadcast(df) if small else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application. Not needed
    where it is installed on the executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="tripletspark-"), "tripletspark")
    archive = shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)

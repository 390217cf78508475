"""Tables written between stages, in the folder that all executors share.

A long plan is cut by writing Parquet below ``spark.checkpoint.dir`` and reading
it back: the files outlive any executor, unlike cached or locally checkpointed
blocks, and the plan after it starts from a scan with known size.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only for local masters without the setting."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="spindrift-")
        root = "file://" + _LOCAL[sc.applicationId]
    return f"{root.rstrip('/')}/spindrift-{sc.applicationId}"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name of theirs can meet a name of an operator."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


_SCOPES: list[list[str]] = []
_INNERMOST: list[str] = []


def materialize(df: DataFrame, label: str, *, scope: list[str] | None = _INNERMOST) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    The table goes when ``scope`` ends, by default the innermost ``scratch`` block; with None it stays until ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if scope is _INNERMOST:
        scope = _SCOPES[-1] if _SCOPES else None
    if scope is not None:
        scope.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are materialised inside go when the block ends; a result that is still to be read is written outside of it."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop()
        for path in made:
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete every table this application has materialised; call it when no result is in use."""
    _delete(spark, shared_folder(spark))


def one_of_repeats(rows: DataFrame, id_name: str, keys: list[str], ids: DataFrame) -> DataFrame:
    """Of ``rows`` that agree on ``keys``, one, where ``ids`` (the table's id column) holds an id more than once or null.

    Only ids are grouped to find the repeated ones; in a table without any, the rows pass unchanged.
    """
    repeated = materialize(ids.toDF("_repeated").groupBy("_repeated").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select("_repeated"), "repeated-ids")
    if repeated.isEmpty():
        return rows
    again = F.col(id_name).eqNullSafe(F.col("_repeated"))
    return rows.join(repeated, again, "left_anti").unionByName(rows.join(repeated, again, "left_semi").dropDuplicates(keys))

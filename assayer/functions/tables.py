"""Reading the star-schema tables and writing intermediate ones where every executor can see them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that ``spark.checkpoint.dir`` names. Without one, a temporary folder, but
    only if driver and executors are one process: elsewhere each executor would write to its own disk."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/assayer-{context.applicationId}"
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    made = getattr(context, "_assayer_dir", None)
    if made is None:
        made = context._assayer_dir = "file://" + tempfile.mkdtemp(prefix="assayer-")
    return made


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as the JVM knows them."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_written(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that were read from them are void afterwards."""
    own, fs = hadoop_path(spark, shared_dir(spark))
    fs.delete(own, True)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage is cut, lost executors cost nothing.
    ``remove_written`` clears the folder once results are stored."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Columns by name from columns by name.
Step = Callable[[dict[str, Column]], dict[str, Column]]


def composed(given: dict[str, Column], steps: Sequence[Step]) -> dict[str, Column]:
    """What ``steps`` make of ``given``, each from all that came before it, as one expression a name."""
    for step in steps:
        given = given | step(given)
    return given


def in_steps(df: DataFrame, given: dict[str, Column], steps: Sequence[Step], name: str) -> DataFrame:
    """``df`` and the column ``name`` of ``composed(given, steps)``. What a step makes is a column for the next ones, so that
    Spark evaluates it once a row, however often they use it."""
    known, out = dict(given), df
    for i, step in enumerate(steps):
        made = {k: c.alias(f"_{i}_{k}") for k, c in step(known).items()}
        out = out.select("*", *made.values())
        known |= {k: F.col(f"_{i}_{k}") for k in made}
    return out.select(*df.columns, known[name].alias(name))


def one_row_per_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with one row per non-null ``key``. Only if some key repeats (counted on the keys alone) are the rows
    collapsed, to the smallest non-null ``value``; rows without a key have no identity and are left out."""
    df = df.select(key, value).where(F.col(key).isNotNull())
    repeated = df.groupBy(key).count().where("count > 1").limit(1).count()
    return df.groupBy(key).agg(F.min(value).alias(value)) if repeated else df


def apart(*keys: str) -> list[Column]:
    """The keys as columns that the planner takes for new ones. A table that was aggregated by the keys gets an exchange
    of its own when it is joined by them, and only then can adaptive execution split the other side's skewed keys."""
    return [F.greatest(k, k).alias(k) for k in keys]

"""Stage boundaries that survive lost executors."""

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where ``cut`` notes its tables while something is being settled.
_made_here: ContextVar[list[str] | None] = ContextVar("tables cut by what is being settled", default=None)

#: With it Spark drops the shuffle files of a query when that ends, else when the driver collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, else its warehouse.

    One rule for every master: both are folders that driver and executors share.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a stage result as a table in the shared folder and go on from there.

    Later steps read only the columns they need, a lost executor costs no more
    than its own tasks, and the planner knows the true size of the result. The
    tables stay until the folder is emptied, or until ``settled`` drops them.
    What was shuffled for a table goes once it is written: nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/firmlens-{uuid.uuid4().hex}"
    made = _made_here.get()
    if made is not None:
        made.append(path)
    with _without_shuffle_files(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``cut`` of what ``make`` gives; the tables that were cut for it are dropped.

    ``make`` must hand out nothing else that reads those tables.
    """
    made: list[str] = []
    token = _made_here.set(made)
    try:
        df = make()
        _made_here.reset(token)
        token = None
        return cut(df)
    finally:
        if token is not None:
            _made_here.reset(token)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

"""What the corpus operators share: the shared folder, size-checked joins, word rules."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table keyed by long or short string is broadcast.
BROADCAST_ROWS = 50_000
#: And bytes, where its rows have no fixed size.
BROADCAST_BYTES = 32 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITING: list = []
_MADE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, may do without it; then it is a folder below the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def steps(spark: SparkSession):
    """Delete, at the end, the tables that were cut inside, but for those given to the function this yields.

    What is kept must not be read from the others any more: it has to be a table that was cut itself.
    """
    outer, own, kept = getattr(_MADE, "paths", None), [], []
    _MADE.paths = own

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._cut_path)
        return df

    try:
        yield keep
    finally:
        _MADE.paths = outer
        if outer is not None:
            outer += kept
        for path in own:
            if path not in kept:
                _delete(spark, path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that were cut and are needed no more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            _delete(df.sparkSession, path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, so a lost executor costs one step.

    The step's shuffle files are dropped once the table is written. See steps() and forget() for the table itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamarack-{uuid.uuid4().hex}/{label}"
    with _LOCK:  # the first of several writers sets it, the last puts it back
        if not _WRITING:
            _WRITING.append(spark.conf.get(_CLEANUP, None))
            spark.conf.set(_CLEANUP, "true")
        _WRITING.append(path)
    try:
        df.write.parquet(path)
    finally:
        with _LOCK:
            _WRITING.remove(path)
            if len(_WRITING) == 1:
                before = _WRITING.pop()
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if getattr(_MADE, "paths", None) is not None:
        _MADE.paths.append(path)
    return out


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS, size=None) -> DataFrame:
    """Join with small broadcast if it is within its bounds, else by a shuffle that AQE may split.

    The bounds are so many rows and, where size gives the bytes of a row, BROADCAST_BYTES.
    small should be a table that was cut, as it is read here to be measured.
    """
    total = F.count(F.lit(1)), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0))
    n, n_bytes = small.agg(total[0].alias("n"), total[1].alias("b")).first()
    if n <= rows and n_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column, for sizing what follows."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text) -> F.Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value, use) -> F.Column:
    """use(value) with value evaluated once a row, also where use refers to it inside a lambda.

    Spark puts an expression in place of each reference to it; a lambda's variable it does not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed(seed: int, *cols) -> F.Column:
    """A repeatable 64-bit hash of columns under a seed."""
    return F.xxhash64(F.lit(seed), *cols)

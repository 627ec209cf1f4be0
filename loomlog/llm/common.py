"""What the training-data operators share: shared folders, row ids, small checks.

State between calls: the folder used when the session names none, which is removed
when the process ends, and the names of the folders written, for ``clear_shared``.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The column that numbers rows of tables whose own columns pass through.
RID = "__loomlog_rid"

#: Bytes of texts that a Python worker is given at once.
BATCH_BYTES = "4194304b"

#: Bytes up to which a table may be broadcast; larger ones take the other way.
BROADCAST_BYTES = 32 << 20

_own: list[str] = []
_made: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when they share the driver's code path.

    On a cluster without one, ship the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    # Python workers hold a batch or two at once
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or (None if _own else spark.sparkContext.getCheckpointDir())
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="loomlog-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
            spark.sparkContext.setCheckpointDir(f"file://{_own[0]}/checkpoints")
        base = f"file://{_own[0]}"
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many folders this process has written so far, for ``clear_shared``."""
    return len(_made)


def clear_shared(spark: SparkSession, since: int = 0, but_last: bool = False) -> int:
    """Remove what this process has written to the shared folder since ``made()`` was so
    many (but for the last folder), and count it.

    For the end of a job or stage: results that aren't written down yet read from there."""
    jvm, gone = spark.sparkContext._jvm, _made[since : len(_made) - but_last]
    del _made[since : len(_made) - but_last]
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: Bits of a row id that hold the row's place in its file.
PLACE_BITS = 36


def with_row_id(df: DataFrame, name: str = RID) -> DataFrame:
    """Number the rows, alike in every job and whatever the number of cores then.

    A row of Parquet files has the number of its file (in the order of names) and its
    place in it. Other tables, and those of so many files that their names aren't
    few, are written down once with the numbers they got."""
    files = _files(df)
    if files is None or sum(map(len, files)) > BROADCAST_BYTES:
        return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    meta = df.metadataColumn("_metadata")
    place = meta.getField("row_index")
    if len(files) < 2:
        return df.withColumn(name, place)
    spark = df.sparkSession
    known = spark.range(1).select(F.posexplode(F.split(F.lit("\n".join(files)), "\n")).alias("__loomlog_number", "__loomlog_known"))
    number = F.coalesce(F.col("__loomlog_number"), F.raise_error(F.concat(F.lit("a file that wasn't listed: "), F.col("__loomlog_file")))).cast("long")
    placed = df.withColumn("__loomlog_file", _plain_path(meta.getField("file_path"))).withColumn("__loomlog_place", place)
    placed = placed.join(F.broadcast(known), F.col("__loomlog_file") == F.col("__loomlog_known"), "left")
    return placed.withColumn(name, F.shiftleft(number, PLACE_BITS).bitwiseOR(F.col("__loomlog_place"))).drop("__loomlog_number", "__loomlog_known", "__loomlog_file", "__loomlog_place")


def _plain_path(path: Column) -> Column:
    """Paths come with one slash or three after the scheme."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1")


def _files(df: DataFrame) -> list[str] | None:
    """The files that df reads, if it is a plain read of Parquet files, each row once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return None
    try:
        df.select(df.metadataColumn("_metadata").getField("row_index"))
    except AnalysisException:
        return None
    return sorted({re.sub("^([A-Za-z][A-Za-z0-9+.-]*:)/+", r"\1", x) for x in df.inputFiles()})


def hot_limit(n_rows: int, tables: int = 4096, least: int = 1_000) -> int:
    """A key with more rows than this is hot. At most ``tables`` keys can be, so
    a table with one row for each hot key is small by proof."""
    return max(least, -(-n_rows // tables))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of rows with one-row-a-key ``groups`` that holds up under hot keys.

    Groups with over hot_limit(n_rows) rows number at most 4096 and are broadcast;
    the others are joined by a shuffle, where no key has more rows than that.
    """
    limit = hot_limit(n_rows)
    hot = groups.where(F.col(size) > limit)
    if not hot.take(1):
        return rows.join(groups, key)
    names = F.broadcast(hot.select(key))
    return (
        rows.join(F.broadcast(hot), key)
        .unionByName(rows.join(names, key, "left_anti").join(groups.where(F.col(size) <= limit), key))
    )


def renamed(docs: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f of docs, which must keep the columns, while names that functions in Python
    can't be given (with dots and the like) are others."""
    plain = [c if re.fullmatch(r"\w+", c) else f"__c{k}" for k, c in enumerate(docs.columns)]
    return f(docs.toDF(*plain)).toDF(*docs.columns)


def but_for(numbered: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of with_row_id(df) whose number isn't in ids (one column, RID), with df's columns.

    Few numbers are broadcast, and no row is shuffled then."""
    ids = F.broadcast(ids) if 16 * ids.count() <= BROADCAST_BYTES else ids
    return numbered.join(ids, RID, "left_anti").drop(RID)


def quoted(columns: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def extended(schema: T.StructType, **more: T.DataType) -> T.StructType:
    """schema, without promises on nulls, and further fields."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [T.StructField(k, v) for k, v in more.items()])

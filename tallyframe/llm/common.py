"""Helpers shared by the operators."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLEANUP, ARROW_BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one beside the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def short_batches(spark: SparkSession) -> None:
    """Let Python have at most ARROW_ROWS rows at once in this session: whole texts and sets are long rows."""
    if not 0 < int(spark.conf.get(ARROW_BATCH)) <= ARROW_ROWS:
        spark.conf.set(ARROW_BATCH, str(ARROW_ROWS))


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor costs no recomputation of it.

    Nothing else reads the shuffle files of the write, so Spark may delete them when it is over.
    """
    spark = df.sparkSession
    short_batches(spark)
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table; Spark deletes the files itself where its cleaner is told to."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the same with underscores where the table has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_names(function):
    """Let an operator that carries all columns of its table work on any names.

    Columns whose names begin with an underscore, as the helper columns of operators do, or hold other characters than
    letters, digits and underscores, are renamed before and get their names back in the result.
    """

    @functools.wraps(function)
    def run(docs: DataFrame, *args, **options):
        odd = [c for c in docs.columns if not re.fullmatch(r"[A-Za-z]\w*", c, re.ASCII)]
        if not odd:
            return function(docs, *args, **options)
        taken, names = {c.lower() for c in docs.columns}, {}
        for c in odd:
            i = len(names)
            while f"column{i}" in taken:
                i += 1
            names[c] = f"column{i}"
            taken.add(names[c])
        options = {k: names.get(v, v) if isinstance(v, str) else v for k, v in options.items()}
        got = function(docs.toDF(*[names.get(c, c) for c in docs.columns]), *args, **options)
        table, rest = (got[0], got[1:]) if isinstance(got, tuple) else (got, None)
        given = {v: k for k, v in names.items()}
        table = table.toDF(*[given.get(c, c) for c in table.columns])
        return table if rest is None else (table, *rest)

    return run


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    return T.StructField(name or column, df.schema[column].dataType, True)


def map_rows(df: DataFrame, function: Callable[[dict], dict], schema: T.StructType) -> DataFrame:
    """Apply ``function`` to columns of an Arrow batch as Python lists; it returns columns (lists or arrays)."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = function(dict(zip(batch.schema.names, batch.columns, strict=True)))
            if got is not None:
                yield from pa.table([got[n] for n in names], names=names).to_batches()

    return df.mapInArrow(run, schema)

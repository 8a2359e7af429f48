"""Reading annotation files. Line-based files are numbered without being read whole by one task."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.binding import strip
from tallyframe.functions.messages import MESSAGES, read_messages
from tallyframe.plans.tasks import TASKS, parse_source_name

TRUTH = f"task string, split string, row_idx long, messages {MESSAGES}"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file and position: ``file, block, place, value``.

    Within one block of a file the row ids rise in reading order, so (block,
    place) orders the lines of a file.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


def number_lines(lines: DataFrame, out: str = "line_no") -> DataFrame:
    """Number lines per file from 0: place inside the block plus the lines of earlier blocks."""
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))
    before = F.coalesce(
        F.sum("n").over(
            Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("before", before)
    return (
        lines.withColumn("inside", inside)
        .join(blocks.select("file", "block", "before"), ["file", "block"])
        .withColumn(out, (F.col("before") + F.col("inside") - 1).cast("long"))
        .drop("before", "inside")
    )


def drop_header(lines: DataFrame) -> DataFrame:
    """Drop the first line of every file, whatever it holds: it opens the block that starts at 0."""
    opening = F.min("place").over(Window.partitionBy("file", "block"))
    return lines.withColumn("opening", opening).where("block > 0 OR place > opening").drop("opening")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def scan_messages(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """The ``messages`` column of a Parquet table with its row number per file.

    ``pattern`` picks files by name, such as ``*_test.parquet``.
    """
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    table = reader.parquet(*([path] if isinstance(path, str) else path))
    is_text = isinstance(table.schema["messages"].dataType, T.StringType)
    return table.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("file_row"),
        read_messages(F.col("messages"), is_text).alias("messages"),
    )


def number_across_files(rows: DataFrame, by: list[str] = (), out: str = "row_idx") -> DataFrame:
    """Continue row numbers over the files of a table in name order."""
    sizes = rows.groupBy(*by, "file").agg((F.max("file_row") + 1).alias("n"))
    before = F.coalesce(
        F.sum("n").over(
            Window.partitionBy(*by).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    offsets = sizes.select(*by, "file", before.alias("before"))
    return rows.join(offsets, [*by, "file"]).withColumn(out, F.col("before") + F.col("file_row")).drop("before")


def load_truth(spark: SparkSession, root: str, task: str, split: str) -> DataFrame:
    """Ground truth of one task: the file of its prefix, or all files of the split in name order."""
    spec = TASKS[task]
    stored = spec.split_alias.get(split, split)
    pattern = f"{spec.prefix}_{stored}.parquet" if spec.prefix else f"*_{stored}.parquet"
    rows = number_across_files(scan_messages(spark, f"{root}/{spec.folder}", pattern))
    return rows.select(F.lit(task).alias("task"), F.lit(stored).alias("split"), "row_idx", "messages")


def load_truths(spark: SparkSession, root: str, wanted: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Ground truth of several (task, split) and what is missing: ``task, split, error`` of those without a table.

    Splits are the stored ones in both results; ``evaluate`` takes both.
    """
    truth, missing = spark.createDataFrame([], TRUTH), []
    for task, split in dict.fromkeys(wanted):
        stored = TASKS[task].split_alias.get(split, split) if task in TASKS else split
        try:
            if task not in TASKS:
                raise KeyError(task)
            turn = lambda m: F.struct(*[m[c].cast("string").alias(c) for c in ("role", "content")])
            # Tables of different builders may carry further fields in a message.
            truth = truth.unionByName(load_truth(spark, root, task, split).withColumn("messages", F.transform("messages", turn)))
        except KeyError:
            missing.append((task, stored, f"unknown dataset key: {task}"))
        except AnalysisException as error:
            if error.getCondition() not in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}:
                raise
            missing.append((task, stored, f"no truth table of split {stored} under {TASKS[task].folder}"))
    return truth, spark.createDataFrame(missing, "task string, split string, error string")


def scan_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines numbered after blank and undecodable lines are dropped: ``file, row_idx, value``."""
    return parse_jsonl(read_lines(spark, path))


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """The same of a table of lines ``file, block, place, value``. Usual lines are decided in the JVM."""

    def valid(texts: pd.Series) -> pd.Series:
        import json

        def ok(text):
            try:
                json.loads(text)
                return True
            except (ValueError, RecursionError):
                return False

        return texts.map(ok, na_action="ignore")

    lines = lines.where(strip(F.col("value")) != "")
    flat = F.regexp_like("value", F.lit(r"^\s*\{[^{}]*\}\s*$")) & F.try_parse_json("value").isNotNull()
    decoded = F.pandas_udf(valid, T.BooleanType())(F.when(~flat, F.col("value")))
    return number_lines(lines.where(flat | F.coalesce(decoded, F.lit(False))), "row_idx").select("file", "row_idx", "value")


def scan_predictions(spark: SparkSession, path: str | list[str], model: Column | None = None) -> DataFrame:
    """Prediction files ``PRED_{task}_{split}.jsonl`` of one or many models.

    The model is the name of the folder unless given.
    """
    rows = scan_jsonl(spark, path)
    task, split = parse_source_name(F.col("file"))
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    schema = "response string, messages array<struct<role:string,content:string>>"
    body = F.from_json("value", schema)
    return rows.select(
        (model if model is not None else folder).alias("model"),
        task.alias("task"),
        split.alias("split"),
        "row_idx",
        body["response"].alias("response"),
        body["messages"].alias("messages"),
    )


def scan_keyed_json(spark: SparkSession, path: str, value_type: str, keyed: bool = True) -> DataFrame:
    """One JSON document per file: an object keyed by id (``key, value``) or an array (``value``)."""
    return parse_keyed_json(spark.read.text(path, wholetext=True), value_type, keyed)


def parse_keyed_json(documents: DataFrame, value_type: str, keyed: bool = True) -> DataFrame:
    """The same of a table with one document per row in ``value``, whose other columns are dropped.

    A document is one cell (at most 2 GB); larger collections belong into JSON lines.
    """
    if keyed:
        return documents.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias("key", "value"))
    return documents.select(F.posexplode(F.from_json("value", f"array<{value_type}>")).alias("position", "value"))


def scan_csv(spark: SparkSession, path: str | list[str], schema: dict[str, str]) -> DataFrame:
    """CSV with a header; names are trimmed, columns are picked and cast by ``schema``."""
    table = spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    trimmed = table.toDF(*[c.strip() for c in table.columns])
    return trimmed.select(*[F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in schema.items() if c in trimmed.columns])


def scan_delimited(
    spark: SparkSession, path: str | list[str], fields: dict[str, tuple[int, str]], sep: str = ",", min_fields: int = 1
) -> DataFrame:
    """Headerless lines; short lines and lines with unreadable numbers are skipped.

    ``fields`` maps a name to (position, type). Line numbers count all lines.
    """
    return parse_delimited(number_lines(read_lines(spark, path)), fields, sep, min_fields)


def parse_delimited(lines: DataFrame, fields: dict[str, tuple[int, str]], sep: str = ",", min_fields: int = 1) -> DataFrame:
    """The same of a table of numbered lines ``file, line_no, value``."""
    parts = lines.select("file", "line_no", F.split(strip(F.col("value")), sep).alias("p")).where(F.size("p") >= min_fields)
    read = {n: strip(F.col("p")[i]).try_cast(kind) for n, (i, kind) in fields.items()}
    given = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in fields])
    return parts.select("file", "line_no", *[c.alias(n) for n, c in read.items()]).where(given)


def scan_variable_arity(spark: SparkSession, path: str | list[str], fixed: int = 6, group: int = 4) -> DataFrame:
    """White-space separated integers: fixed fields, then as many whole groups as follow (at least one)."""
    return parse_variable_arity(number_lines(read_lines(spark, path)), fixed, group)


def parse_variable_arity(lines: DataFrame, fixed: int = 6, group: int = 4) -> DataFrame:
    """The same of a table of numbered lines ``file, line_no, value``."""
    numbers = F.transform(F.split(strip(F.col("value")), r"\s+"), lambda p: p.try_cast("int"))
    rows = lines.select("file", "line_no", numbers.alias("p")).where(F.size("p") >= fixed + group)
    count = F.floor((F.size("p") - fixed) / group).cast("int")
    starts = F.sequence(F.lit(0), count - 1)
    groups = F.transform(starts, lambda i: F.slice("p", i * group + fixed + 1, F.lit(group)))
    return rows.select("file", "line_no", F.slice("p", 1, fixed).alias("head"), groups.alias("groups"))


def scan_frame_annotations(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """One annotation per line below a header: ``clip, frame, value``.

    Kinds: ``int``, ``pair`` (two numbers), ``vector`` (integers). Blank and
    unreadable lines are dropped before numbering, so later frames move up.
    """
    return parse_frame_annotations(read_lines(spark, path), kind)


def parse_frame_annotations(lines: DataFrame, kind: str) -> DataFrame:
    """The same of a table of lines ``file, block, place, value``."""
    text = strip(F.col("value"))
    parts = F.transform(F.split(text, ","), lambda p: strip(p))
    value = {
        "int": text.try_cast("int"),
        "pair": F.when(
            (F.size(parts) >= 2) & parts[0].try_cast("double").isNotNull() & parts[1].try_cast("double").isNotNull(),
            F.array(parts[0].try_cast("double"), parts[1].try_cast("double")),
        ),
        "vector": F.when(
            ~F.exists(parts, lambda p: p.try_cast("int").isNull()), F.transform(parts, lambda p: p.try_cast("int"))
        ),
    }[kind]
    rows = drop_header(lines).withColumn("value", value).where("value IS NOT NULL")
    return number_lines(rows, "frame").select(stem(F.col("file")).alias("clip"), "frame", "value")


def scan_rttm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Speech segments ``clip, seq, start, end, speaker`` from lines that begin with SPEAKER."""
    return parse_rttm(number_lines(read_lines(spark, path), "seq"))


def parse_rttm(lines: DataFrame) -> DataFrame:
    """The same of a table of numbered lines ``file, seq, value``."""
    lines = lines.where(strip(F.col("value")).startswith("SPEAKER"))
    p = F.split(strip(F.col("value")), r"\s+")
    start = p[3].cast("double")
    return lines.select(
        stem(F.col("file")).alias("clip"),
        "seq",
        start.alias("start"),
        (start + p[4].cast("double")).alias("end"),
        p[7].alias("speaker"),
    )


def list_media(spark: SparkSession, path: str | list[str], extensions: list[str], recursive: bool = True) -> DataFrame:
    """Files by stem ``stem, path, length``; of several the earlier extension in the list wins.

    The file contents are not read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length")
    )
    return prefer_extension(files, extensions)


def prefer_extension(files: DataFrame, extensions: list[str]) -> DataFrame:
    """One file per stem, by the order of the extensions, then by path."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(e.lower()) for e in extensions]), extension)
    ranked = files.select(stem(F.col("path")).alias("stem"), "path", "length", rank.alias("rank")).where("rank > 0")
    best = ranked.groupBy("stem").agg(F.min(F.struct("rank", "path", "length")).alias("b"))
    return best.select("stem", F.col("b.path").alias("path"), F.col("b.length").alias("length"))


def media_bytes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """File contents ``path, content``."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    )


def attach_media(df: DataFrame, media: DataFrame, key: str, out: str = "content") -> tuple[DataFrame, DataFrame]:
    """Bytes of the file each row points to, and the number of rows whose file is missing.

    Attach media last: contents then cross the network once, next to nothing
    else. The counter reads only paths.
    """
    listed = media.select(F.col("path").alias(key)).distinct()
    missing = df.select(key).join(listed, key, "left_anti").agg(F.count("*").alias("n_skipped"))
    return df.join(media.select(F.col("path").alias(key), F.col("content").alias(out)), key), missing

"""Parsers of annotation lines over lines made from events: one file per event type, in two blocks, in the order of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.queries.base import Tables, query, r6
from tallyframe.sources import readers

HALF = 2000


def _lines(spark, folder: str, text: Column) -> DataFrame:
    return Tables(spark, folder).events.select(
        F.concat(F.lit("notes/"), "event_type", F.lit(".txt")).alias("file"),
        F.when(F.col("event_id") < HALF, 0).otherwise(1).cast("long").alias("block"),
        F.col("event_id").cast("long").alias("place"),
        text.alias("value"),
    )


def _id() -> Column:
    return F.col("event_id")


NUMBERED = "n AS (SELECT *, 'notes/' || event_type || '.txt' AS file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS line_no FROM events)"


@query(
    "parse_delimited",
    f"WITH {NUMBERED} SELECT file, line_no, event_id AS a, round(value, 6) AS b, CASE WHEN event_id % 11 = 2 THEN '' ELSE event_type END AS c "
    "FROM n WHERE event_id % 11 NOT IN (0, 1)",
)
def parse_delimited(spark, sf_dir):
    short, unread = F.lit("7, 8"), F.concat(F.lit("x, "), F.col("value"), F.lit(", y"))
    usual = F.concat_ws(" , ", _id(), F.col("value").cast("decimal(20,6)"), F.when(_id() % 11 == 2, "").otherwise(F.col("event_type")))
    text = F.when(_id() % 11 == 0, short).when(_id() % 11 == 1, unread).otherwise(F.concat(F.lit(" "), usual, F.lit(" ")))
    lines = readers.number_lines(_lines(spark, sf_dir, text))
    rows = readers.parse_delimited(lines, {"a": (0, "bigint"), "b": (1, "double"), "c": (2, "string")}, min_fields=3)
    return rows.withColumn("b", r6(F.col("b")))


@query(
    "parse_variable_arity",
    f"WITH {NUMBERED} SELECT file, line_no, event_id AS first, CAST(event_id % 4 AS BIGINT) AS n_groups, event_id % 7 + event_id % 4 - 1 AS last_group "
    "FROM n WHERE event_id % 4 > 0",
)
def parse_variable_arity(spark, sf_dir):
    head = F.concat_ws("  ", _id(), *[F.lit(i) for i in range(5)])
    one = lambda i: F.concat_ws("\t", _id() % 7 + i, F.lit(1), F.lit(2), F.lit(3))
    groups = F.array_join(F.transform(F.sequence(F.lit(0), (_id() % 4).cast("int")), lambda i: F.when(i < _id() % 4, one(i)).otherwise("9")), " ")
    rows = readers.parse_variable_arity(readers.number_lines(_lines(spark, sf_dir, F.concat_ws(" ", head, groups))))
    last = F.element_at("groups", -1)[0]
    return rows.select("file", "line_no", F.col("head")[0].cast("long").alias("first"), F.size("groups").cast("long").alias("n_groups"), last.cast("long").alias("last_group"))


@query(
    "parse_frame_annotations",
    "WITH h AS (SELECT *, min(event_id) FILTER (WHERE event_id < 2000) OVER (PARTITION BY event_type) AS top FROM events), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame FROM h WHERE (top IS NULL OR event_id > top) AND event_id % 11 NOT IN (0, 1)) "
    "SELECT event_type AS clip, frame, round(value, 6) AS x, CAST(event_id AS DOUBLE) AS y FROM k",
)
def parse_frame_annotations(spark, sf_dir):
    usual = F.concat_ws(", ", F.col("value").cast("decimal(20,6)"), _id())
    text = F.when(_id() % 11 == 0, "  ").when(_id() % 11 == 1, "1, none").otherwise(usual)
    rows = readers.parse_frame_annotations(_lines(spark, sf_dir, text), "pair")
    return rows.select("clip", "frame", r6(F.col("value")[0]).alias("x"), F.col("value")[1].alias("y"))


@query(
    "parse_rttm",
    f"WITH {NUMBERED} SELECT event_type AS clip, line_no AS seq, CAST(event_id % 100 AS DOUBLE) AS start, event_id % 100 + (event_id % 8) / 4.0 AS end_s, "
    "'s' || event_id % 3 AS speaker FROM n WHERE event_id % 11 <> 0",
)
def parse_rttm(spark, sf_dir):
    parts = [F.lit("SPEAKER"), F.col("event_type"), F.lit("1"), (_id() % 100).cast("string"), ((_id() % 8) / 4).cast("string"), F.lit("<NA>"), F.lit("<NA>"), F.concat(F.lit("s"), _id() % 3)]
    text = F.when(_id() % 11 == 0, ";; note").otherwise(F.concat_ws("  ", *parts))
    rows = readers.parse_rttm(readers.number_lines(_lines(spark, sf_dir, text), "seq"))
    return rows.select("clip", "seq", "start", F.col("end").alias("end_s"), "speaker")


@query(
    "parse_jsonl",
    "WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_idx FROM events WHERE event_id % 11 NOT IN (0, 1, 2)) "
    "SELECT 'notes/' || event_type || '.txt' AS file, row_idx, "
    "CASE event_id % 11 WHEN 3 THEN '[1, {\"a\": 2}]' WHEN 4 THEN 'NaN' ELSE '{\"id\": ' || event_id || '}' END AS value FROM k",
)
def parse_jsonl(spark, sf_dir):
    usual = F.concat(F.lit('{"id": '), _id(), F.lit("}"))
    text = (
        F.when(_id() % 11 == 0, " ").when(_id() % 11 == 1, '{"id": ').when(_id() % 11 == 2, '{"a": {"b": 1}')
        .when(_id() % 11 == 3, '[1, {"a": 2}]').when(_id() % 11 == 4, "NaN").otherwise(usual)
    )
    return readers.parse_jsonl(_lines(spark, sf_dir, text))


@query("parse_keyed_json", "SELECT CAST(event_id AS VARCHAR) AS key, round(value, 6) AS value, event_type FROM events")
def parse_keyed_json(spark, sf_dir):
    item = F.struct(F.col("value").alias("v"), F.col("event_type").alias("t"))
    entries = F.map_from_entries(F.collect_list(F.struct(_id().cast("string"), item)))
    documents = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.to_json(entries).alias("value"))
    rows = readers.parse_keyed_json(documents, "struct<v:double,t:string>")
    return rows.select("key", r6(F.col("value.v")).alias("value"), F.col("value.t").alias("event_type"))

"""Frame windows, row selection, splits and joins over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import joins, select, split, windows
from tallyframe.operators.ordered import hash_order, row_index
from tallyframe.queries.base import FRAMES, TYPES, Tables, frames, query, r6

WINDOWS = (
    "lens AS (SELECT clip, count(*) AS len FROM frames GROUP BY clip), "
    "win AS (SELECT f.*, frame - 8 AS start FROM frames f JOIN lens USING (clip) "
    "WHERE frame >= 8 AND (frame - 8) % {stride} = 0 AND frame - 8 + 16 <= len)"
)


@query(
    "sliding_frames",
    f"WITH {FRAMES}, {WINDOWS.format(stride=16)} SELECT clip, CAST(start AS BIGINT) AS start, event_id, event_type FROM win",
)
def sliding_frames(spark, sf_dir):
    return windows.sliding_frames(frames(Tables(spark, sf_dir)), ["clip"]).select(
        "clip", "start", "event_id", "event_type"
    )


@query(
    "sliding_seconds",
    "SELECT o_orderkey, CAST(w AS INTEGER) AS win_start FROM (SELECT o_orderkey, unnest(range(0, CAST(floor(o_totalprice / 2000) AS INTEGER) - 30 + 1, 15)) AS w FROM orders)",
)
def sliding_seconds(spark, sf_dir):
    clips = Tables(spark, sf_dir).orders.select("o_orderkey", (F.col("o_totalprice") / 2000).alias("duration"))
    return windows.sliding_seconds(clips).select("o_orderkey", "win_start")


RANGE = (
    "r AS (SELECT o_orderkey, o_orderkey % 40 + 1 AS onset, o_orderkey % 40 + 1 + o_custkey % 60 AS offs, "
    "o_orderkey % 40 + 1 + least(o_custkey % 60, o_orderkey % 23) AS apex FROM orders)"
)


def _ranges(t: Tables):
    onset, length = F.col("o_orderkey") % 40 + 1, F.col("o_custkey") % 60
    return t.orders.select(
        "o_orderkey",
        onset.alias("onset"),
        (onset + length).alias("offset"),
        (onset + F.least(length, F.col("o_orderkey") % 23)).alias("apex"),
    )


@query(
    "window_bounds",
    f"WITH {RANGE} SELECT o_orderkey, greatest(1, onset - 5) AS start_frame, least(70, offs + 5) AS end_frame, "
    "round((greatest(1, onset - 5) - 1) / 30, 6) AS start_sec, round(least(70, offs + 5) / 30, 6) AS end_sec FROM r",
)
def window_bounds(spark, sf_dir):
    rows = _ranges(Tables(spark, sf_dir))
    bounds = windows.window_bounds(F.col("onset"), F.col("offset"), F.lit(70))
    return rows.select(
        "o_orderkey",
        bounds["start_frame"].cast("long").alias("start_frame"),
        bounds["end_frame"].cast("long").alias("end_frame"),
        r6(bounds["start_sec"]).alias("start_sec"),
        r6(bounds["end_sec"]).alias("end_sec"),
    )


@query(
    "anchor_frames",
    f"WITH {RANGE}, e AS (SELECT *, offs - onset + 1 AS total, "
    "list_transform(range(16), lambda k: onset + CAST(round_even(k * (offs - onset) / 15, 0) AS BIGINT)) AS ev FROM r), "
    "g AS (SELECT *, list_transform(ev, lambda i: abs(i - apex)) AS gap FROM e), "
    "p AS (SELECT *, list_position(gap, list_min(gap)) AS pos FROM g), "
    "s AS (SELECT o_orderkey, CASE WHEN total <= 16 THEN range(onset, offs + 1) WHEN list_contains(ev, apex) THEN ev "
    "ELSE list_sort(ev[:pos - 1] || [apex] || ev[pos + 1:]) END AS f FROM p) "
    "SELECT o_orderkey, array_to_string(f, ',') AS frames FROM s",
)
def anchor_frames(spark, sf_dir):
    chosen = windows.sample_frames_with_anchor(F.col("onset"), F.col("apex"), F.col("offset"))
    return _ranges(Tables(spark, sf_dir)).select(
        "o_orderkey", F.array_join(chosen.cast("array<string>"), ",").alias("frames")
    )


@query(
    "cap_per_label",
    f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY clip, event_type ORDER BY frame) AS k FROM frames) "
    "SELECT clip, event_type, event_id FROM r WHERE k <= 5",
)
def cap_per_label(spark, sf_dir):
    return select.cap_per_label(frames(Tables(spark, sf_dir)), ["clip"], "event_type", ["frame"]).select(
        "clip", "event_type", "event_id"
    )


@query(
    "dedupe_exact",
    f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY clip, props ORDER BY frame) AS k FROM frames) "
    "SELECT clip, props, event_id FROM r WHERE k = 1",
)
def dedupe_exact(spark, sf_dir):
    return select.dedupe_exact(frames(Tables(spark, sf_dir)), ["clip"], "props", ["frame"]).select(
        "clip", "props", "event_id"
    )


GREEDY = (
    "fold AS (SELECT clip, list_reduce(list([CAST(frame AS DOUBLE), value, CAST(event_id % 100 AS DOUBLE)] ORDER BY frame), "
    "lambda acc, x: acc || CASE WHEN len(list_filter(acc, lambda y: sqrt((y[2] - x[2]) * (y[2] - x[2]) + (y[3] - x[3]) * (y[3] - x[3])) < {t})) > 0 THEN [] ELSE [x] END, "
    "CAST([] AS DOUBLE[][])) AS kept FROM {source} GROUP BY clip)"
)


@query(
    "greedy_min_distance",
    f"WITH {FRAMES}, {GREEDY.format(t=25, source='frames')}, u AS (SELECT clip, unnest(kept) AS k FROM fold) "
    "SELECT clip, CAST(k[1] AS BIGINT) AS frame FROM u",
)
def greedy_min_distance(spark, sf_dir):
    rows = frames(Tables(spark, sf_dir)).withColumn("other", F.col("event_id") % 100)
    return select.greedy_min_distance(rows, ["clip"], ["frame"], ["value", "other"], 25).select("clip", "frame")


STRIDES = [4, 8, 16, 32, 64]


@query(
    "stride_sweep",
    f"WITH {FRAMES}, s AS (SELECT unnest([4, 8, 16, 32, 64]) AS stride), lens AS (SELECT clip, count(*) AS len FROM frames GROUP BY clip), "
    "w AS (SELECT stride, f.* FROM frames f JOIN lens USING (clip) CROSS JOIN s WHERE frame >= 8 AND (frame - 8) % stride = 0 AND frame + 8 <= len), "
    "capped AS (SELECT *, row_number() OVER (PARTITION BY stride, clip, event_type ORDER BY frame) AS k, "
    "row_number() OVER (PARTITION BY stride, clip, props ORDER BY frame) AS d FROM w), n AS (SELECT count(DISTINCT user_id) AS c FROM events) "
    "SELECT stride, count(*) AS raw_windows, count(*) FILTER (WHERE k <= 2) AS kept_capped, count(*) FILTER (WHERE d = 1) AS kept_distinct, "
    "round(count(*) FILTER (WHERE k <= 2) / max(c), 6) AS kept_per_clip FROM capped CROSS JOIN n GROUP BY stride",
)
def stride_sweep(spark, sf_dir):
    rows = frames(Tables(spark, sf_dir))
    swept = windows.sweep_windows(rows, ["clip"], STRIDES)
    counts = windows.sweep_statistics(swept, rows, ["clip"], "event_type", "props", k=2)
    return counts.withColumn("kept_per_clip", r6(F.col("kept_per_clip")))


@query(
    "sweep_totals",
    f"WITH {FRAMES}, s AS (SELECT unnest([4, 8, 16, 32, 64]) AS stride), lens AS (SELECT clip, count(*) AS len FROM frames GROUP BY clip), "
    "w AS (SELECT stride, CASE WHEN clip % 5 = 0 THEN 'val' ELSE 'train' END AS split, f.* FROM frames f JOIN lens USING (clip) CROSS JOIN s WHERE frame >= 8 AND (frame - 8) % stride = 0 AND frame + 8 <= len), "
    "r AS (SELECT stride, split, row_number() OVER (PARTITION BY stride, clip, event_type ORDER BY frame) <= 2 AS c, "
    "row_number() OVER (PARTITION BY stride, clip, props ORDER BY frame) = 1 AS d FROM w), "
    "t AS (SELECT stride, split, 'capped' AS task, c AS kept FROM r UNION ALL SELECT stride, split, 'distinct', d FROM r) "
    "SELECT stride, split, task, count(*) AS raw_windows, count(*) FILTER (WHERE kept) AS kept, grouping(stride, split, task) AS level FROM t GROUP BY CUBE (stride, split, task)",
)
def sweep_totals(spark, sf_dir):
    rows = frames(Tables(spark, sf_dir)).withColumn("split", F.when(F.col("clip") % 5 == 0, "val").otherwise("train"))
    return windows.sweep_totals(windows.sweep_windows(rows, ["clip"], STRIDES), ["clip"], "event_type", "props", k=2)


@query(
    "sample_n",
    "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('42|' || event_id), event_id) AS k FROM events) "
    "SELECT user_id, event_id FROM r WHERE k <= 5",
)
def sample_n(spark, sf_dir):
    return select.sample_n(Tables(spark, sf_dir).events, ["user_id"], ["event_id"], 5).select("user_id", "event_id")


BALANCED = (
    "pos AS (SELECT user_id, count(*) AS want FROM events WHERE event_type = 'purchase' GROUP BY user_id), "
    "neg AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42|' || event_id), event_id) AS k FROM events WHERE event_type <> 'purchase'), "
    "chosen AS (SELECT neg.* FROM neg JOIN pos USING (user_id) WHERE k <= want)"
)


@query("balanced_negatives", f"WITH {BALANCED} SELECT user_id, event_id FROM chosen")
def balanced_negatives(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    positive = F.col("event_type") == "purchase"
    return select.balance_negatives(
        events.where(positive), events.where(~positive), ["user_id"], ["event_id"]
    ).select("user_id", "event_id")


@query(
    "random_rows",
    "SELECT event_id, event_type FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 10",
)
def random_rows(spark, sf_dir):
    return select.random_rows(Tables(spark, sf_dir).events, ["event_id"], 10).select("event_id", "event_type")


@query(
    "random_rows_of_block",
    # Which block is drawn hangs on the files; that its rows are rows of the table, each once and of one file, does not.
    "SELECT CAST(10 AS BIGINT) AS n_rows, CAST(10 AS BIGINT) AS n_distinct, count(*) AS n_found, CAST(1 AS BIGINT) AS n_files "
    "FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 10)",
)
def random_rows_of_block(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    drawn = select.random_rows_of_block(events, ["event_id"], 10).select("event_id", "event_type", F.input_file_name().alias("file"))
    known = events.select("event_id", F.col("event_type").alias("known"))
    both = drawn.join(known, "event_id", "left")
    return both.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("event_id").alias("n_distinct"),
        F.count_if(F.col("event_type") == F.col("known")).alias("n_found"),
        F.countDistinct("file").alias("n_files"),
    )


@query(
    "consecutive_rows",
    f"WITH {FRAMES}, s AS (SELECT clip, min(frame) AS lo, max(frame) AS hi FROM frames GROUP BY clip HAVING max(frame) - min(frame) + 1 >= 5), "
    "c AS (SELECT clip, lo + CAST(floor(CAST('0x' || substr(md5('42|start|' || clip), 1, 13) AS BIGINT) / 4503599627370496.0 * (hi - lo - 3)) AS BIGINT) AS f "
    "FROM s ORDER BY md5('42|' || clip), clip LIMIT 1) "
    "SELECT clip, CAST(frame AS BIGINT) AS frame, event_id FROM frames JOIN c USING (clip) WHERE frame >= f AND frame < f + 5",
)
def consecutive_rows(spark, sf_dir):
    return select.consecutive_rows(frames(Tables(spark, sf_dir)), ["clip"], "frame", 5).select(
        "clip", "frame", "event_id"
    )


@query(
    "shuffle_order",
    "SELECT event_id, md5('42|' || event_id) AS shuffle_key FROM events",
)
def shuffle_order(spark, sf_dir):
    return select.shuffle_key(Tables(spark, sf_dir).events, ["event_id"]).select("event_id", "shuffle_key")


@query(
    "top_k",
    "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10",
)
def top_k(spark, sf_dir):
    return select.top_k(Tables(spark, sf_dir).part, "p_brand", 10)


@query(
    "hash_split",
    "WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents)) "
    "SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM k",
)
def hash_split(spark, sf_dir):
    return split.hash_split(Tables(spark, sf_dir).documents, "doc_id").select("doc_id", "split")


SETS = (
    "a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 30), "
    "c AS (SELECT DISTINCT user_id FROM events WHERE props LIKE '%9%'), "
    "tr AS (SELECT user_id FROM a INTERSECT SELECT user_id FROM b INTERSECT SELECT user_id FROM c), "
    "va AS (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM tr)), "
    "r AS (SELECT user_id, row_number() OVER (ORDER BY user_id DESC) AS k FROM tr)"
)


@query(
    "borrow_split",
    f"WITH {SETS} SELECT user_id, CASE WHEN k <= 20 THEN 'val' ELSE 'train' END AS split FROM r UNION ALL SELECT user_id, 'val' FROM va",
)
def borrow_split(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    train = split.common_keys(
        [
            events.where("event_type = 'view'"),
            events.where("value > 30"),
            events.where(F.contains("props", F.lit("9"))),
        ],
        "user_id",
    )
    val = joins.absent_from(events, train, ["user_id"])
    return split.borrow_last(train, val, "user_id")


@query(
    "split_filter",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test' END AS split FROM orders WHERE o_orderstatus IN ('F', 'O')",
)
def split_filter(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    return split.split_filter(orders, F.col("o_orderstatus"), {"F": "train", "O": "test"}).select("o_orderkey", "split")


@query(
    "subject_split",
    "SELECT c_custkey, CASE WHEN c_nationkey <= 19 THEN 'train' ELSE 'val' END AS split FROM customer WHERE c_nationkey BETWEEN 1 AND 23",
)
def subject_split(spark, sf_dir):
    rows = Tables(spark, sf_dir).customer
    return split.subject_split(rows, "c_nationkey", {"train": (1, 19), "val": (20, 23)}).select("c_custkey", "split")


@query(
    "anti_negatives",
    f"WITH {FRAMES}, ann AS (SELECT DISTINCT clip, frame FROM frames WHERE event_type IN ('click', 'error')) "
    "SELECT f.clip, CAST(f.frame AS BIGINT) AS frame FROM frames f WHERE NOT EXISTS (SELECT 1 FROM ann WHERE ann.clip = f.clip AND ann.frame = f.frame)",
)
def anti_negatives(spark, sf_dir):
    rows = frames(Tables(spark, sf_dir))
    annotated = rows.where(F.col("event_type").isin("click", "error"))
    return joins.absent_from(rows, annotated, ["clip", "frame"]).select("clip", "frame")


@query(
    "asof_next",
    f"WITH {FRAMES}, ann AS (SELECT clip, frame, props FROM frames WHERE event_type = 'purchase'), "
    "ends AS (SELECT clip, max(frame) AS last FROM ann GROUP BY clip), "
    "hit AS (SELECT f.clip, f.frame, a.frame AS nxt, last FROM (SELECT * FROM frames JOIN ends USING (clip)) f "
    "ASOF LEFT JOIN ann a ON f.clip = a.clip AND f.frame <= a.frame) "
    "SELECT hit.clip, CAST(hit.frame AS BIGINT) AS frame, CAST(coalesce(nxt, last) AS BIGINT) AS matched, ann.props AS props "
    "FROM hit JOIN ann ON ann.clip = hit.clip AND ann.frame = coalesce(nxt, last)",
)
def asof_next(spark, sf_dir):
    rows = frames(Tables(spark, sf_dir))
    annotated = rows.where("event_type = 'purchase'").select("clip", "frame", "props", "event_id")
    return joins.asof_next(
        rows.select("clip", "frame"), annotated, ["clip"], "frame", ["props"], ["event_id"]
    )


@query(
    "first_match",
    "WITH r AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) "
    "SELECT c_custkey, o_orderpriority FROM customer LEFT JOIN r ON o_custkey = c_custkey AND k = 1",
)
def first_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lookup = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return joins.first_match(t.customer.select("c_custkey"), lookup, ["c_custkey"], ["o_orderkey"]).select(
        "c_custkey", "o_orderpriority"
    )


@query(
    "present_in",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def present_in(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return joins.present_in(t.documents, t.labels.where("quality = 1"), ["doc_id"]).select("doc_id", "source")


@query(
    "three_way_frames",
    f"WITH {FRAMES}, streams AS (SELECT clip, event_type, value, props, row_number() OVER (PARTITION BY clip, event_type ORDER BY frame) - 1 AS i FROM frames) "
    "SELECT a.clip, CAST(a.i AS BIGINT) AS frame, round(a.value, 6) AS valence, b.props AS units, round(c.value, 6) AS label FROM streams a "
    "JOIN streams b ON a.clip = b.clip AND a.i = b.i AND b.event_type = 'error' JOIN streams c ON a.clip = c.clip AND a.i = c.i AND c.event_type = 'view' "
    "WHERE a.event_type = 'click' AND a.value >= 1 AND c.value >= 1",
)
def three_way_frames(spark, sf_dir):
    events = Tables(spark, sf_dir).events.withColumnRenamed("user_id", "clip")
    streams = row_index(events, ["clip", "event_type"], ["ts", "event_id"], "i")
    stream = lambda kind, column, name: streams.where(F.col("event_type") == kind).select(
        "clip", F.col("i").alias("frame"), F.col(column).alias(name)
    )
    return (
        stream("click", "value", "valence")
        .where("valence >= 1")
        .join(stream("error", "props", "units"), ["clip", "frame"])
        .join(stream("view", "value", "label").where("label >= 1"), ["clip", "frame"])
        .select("clip", "frame", r6(F.col("valence")).alias("valence"), "units", r6(F.col("label")).alias("label"))
    )


@query(
    "explode_entities",
    "WITH o AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem), "
    "p AS (SELECT o_orderkey, o_custkey % 5 + 1 AS a, o_orderkey % 4 + 1 AS b FROM orders) "
    "SELECT o_orderkey, x.l_partkey AS first_part, y.l_partkey AS second_part FROM p JOIN o x ON x.l_orderkey = o_orderkey AND x.i = a JOIN o y ON y.l_orderkey = o_orderkey AND y.i = b",
)
def explode_entities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    pairs = t.orders.select("o_orderkey", F.concat_ws(" ", F.col("o_custkey") % 5 + 1, F.col("o_orderkey") % 4 + 1).alias("pair"))
    # Only two items of a list are used: they are joined by their numbers.
    items = row_index(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], order, "i").select("o_orderkey", (F.col("i") + 1).alias("i"), "l_partkey")
    for n, name in enumerate(("first_part", "second_part")):
        pairs = pairs.withColumn("i", F.split("pair", " ")[n].cast("long")).join(items, ["o_orderkey", "i"]).drop("i")
        pairs = pairs.withColumnRenamed("l_partkey", name)
    return pairs.drop("pair")


@query(
    "sentinel_filter",
    "SELECT event_id FROM events WHERE value <> 0.5 AND value BETWEEN 1 AND 60 AND NOT (event_id % 11 = 0 OR event_id % 13 = 0)",
)
def sentinel_filter(spark, sf_dir):
    eid = F.col("event_id")
    flags = F.array(F.when(eid % 11 == 0, -1).otherwise(1), F.when(eid % 13 == 0, -1).otherwise(0))
    rows = Tables(spark, sf_dir).events.withColumn("flags", flags)
    return rows.where(
        select.no_sentinel(F.col("value"), 0.5) & F.col("value").between(1, 60) & select.no_sentinel_in(F.col("flags"), -1)
    ).select("event_id")


@query(
    "minimum_evidence",
    f"WITH {FRAMES} SELECT clip, count(*) AS n FROM frames WHERE event_type = 'view' GROUP BY clip HAVING count(*) >= 16",
)
def minimum_evidence(spark, sf_dir):
    views = frames(Tables(spark, sf_dir)).where("event_type = 'view'")
    return views.groupBy("clip").agg(F.count("*").alias("n")).where("n >= 16")


@query(
    "answer_mode",
    "WITH v AS (SELECT doc_id, md5('42|' || doc_id) < '8' AS tr, [lang, source] AS a FROM documents) "
    "SELECT doc_id, CASE WHEN tr THEN '{\"emotions\": \"' || a[1] || '\"}' ELSE '{\"emotions_per_annotator\": [\"' || a[1] || '\", \"' || a[2] || '\"]}' END AS answer FROM v",
)
def answer_mode(spark, sf_dir):
    from tallyframe.functions.messages import answer_by_split, json_object, quoted, quoted_list

    rows = Tables(spark, sf_dir).documents.select(
        "doc_id",
        F.when(hash_order(42, "doc_id") < "8", "train").otherwise("val").alias("split"),
        F.array("lang", "source").alias("votes"),
    )
    answer = answer_by_split(
        F.col("split"),
        json_object(emotions=quoted(F.col("votes")[0])),
        json_object(emotions_per_annotator=quoted_list(F.col("votes"))),
    )
    return rows.select("doc_id", answer.alias("answer"))

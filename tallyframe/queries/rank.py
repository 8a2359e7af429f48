"""Ranking, regression and annotator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import labels as lb
from tallyframe.metrics.ranking import average_precision, roc_auc
from tallyframe.metrics.regression import aae, ccc, count_mae
from tallyframe.operators.joins import gather
from tallyframe.operators.ordered import row_index
from tallyframe.operators.select import majority_label
from tallyframe.queries.base import Tables, query, r6, scores, unpivot

SCORED = (
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS gt, "
    "round(value) AS score FROM events"
)


def _scored(t: Tables):
    return t.events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.col("event_type") == "purchase").cast("int").alias("gt"),
        F.round("value").alias("score"),
    )


AP_SQL = (
    "WITH pairs AS ({pairs}), s AS (SELECT {by}, score, sum(gt) AS pos, count(*) AS c FROM pairs GROUP BY {by}, score), "
    "r AS (SELECT *, sum(pos) OVER w AS cp, sum(c) OVER w AS cn FROM s WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)), "
    "wide AS (SELECT {by}, CASE WHEN sum(pos) > 0 THEN sum(pos * cp / cn) / sum(pos) END AS v, sum(c) AS n FROM r GROUP BY {by}) "
)
AUC_SQL = (
    "WITH pairs AS ({pairs}), s AS (SELECT {by}, score, sum(gt) AS pos, count(*) - sum(gt) AS neg, count(*) AS c FROM pairs GROUP BY {by}, score), "
    "r AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score) AS cn FROM s), "
    "wide AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) END AS v, sum(c) AS n FROM r GROUP BY {by}) "
)


@query("ap_scored", AP_SQL.format(pairs=SCORED, by="day") + unpivot("wide", ["day"], {"ap": "v"}))
def ap_scored(spark, sf_dir):
    return scores(average_precision(_scored(Tables(spark, sf_dir)), ["day"]))


@query("auc_scored", AUC_SQL.format(pairs=SCORED, by="day") + unpivot("wide", ["day"], {"auc": "v"}))
def auc_scored(spark, sf_dir):
    return scores(roc_auc(_scored(Tables(spark, sf_dir)), ["day"]))


HARD = (
    "SELECT lang, quality AS gt, CASE WHEN n_chars > 400 THEN 1.0 ELSE 0.0 END AS score "
    "FROM labels JOIN documents USING (doc_id)"
)


@query(
    "auc_hard",
    # With hard labels the area is the mean of both recalls.
    f"WITH pairs AS ({HARD}), wide AS (SELECT lang, count(*) AS n, "
    "(avg(CASE WHEN gt = 1 THEN score END) + avg(CASE WHEN gt = 0 THEN 1 - score END)) / 2 AS v FROM pairs GROUP BY lang) "
    "SELECT lang, 'auc' AS metric, round(v, 6) AS value, CAST(n AS BIGINT) AS n_used FROM wide",
)
def auc_hard(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pairs = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang", F.col("quality").alias("gt"), F.when(F.col("n_chars") > 400, 1.0).otherwise(0.0).alias("score")
    )
    return scores(roc_auc(pairs, ["lang"]))


OOF = (
    "SELECT event_type AS grp, CASE WHEN value < 5 THEN 1 ELSE 0 END AS gt, "
    "CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) / 100 AS score FROM events"
)


@query("oof_ap", AP_SQL.format(pairs=OOF, by="grp") + unpivot("wide", ["grp"], {"out_of_frame_ap": "v"}))
def oof_ap(spark, sf_dir):
    pairs = Tables(spark, sf_dir).events.select(
        F.col("event_type").alias("grp"),
        (F.col("value") < 5).cast("int").alias("gt"),
        (F.regexp_extract("props", r"(\d+)", 1).cast("double") / 100).alias("score"),
    )
    return scores(average_precision(pairs, ["grp"], "out_of_frame_ap"))


LINES = (
    "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem)"
)
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
DIMS = {"valence": "l_quantity", "arousal": "l_discount", "dominance": "l_tax"}


def _lines(t: Tables):
    return row_index(t.lineitem, ["l_orderkey"], LINE_ORDER, "i")


def _ccc(d: str) -> str:
    x, y = f"CAST(CAST(p_{d} AS FLOAT) AS DOUBLE)", f"CAST(CAST(g_{d} AS FLOAT) AS DOUBLE)"
    spread = f"(var_pop({x}) + var_pop({y}) + (avg({x}) - avg({y})) * (avg({x}) - avg({y})))"
    return f"CASE WHEN {spread} < 1e-10 THEN 0 ELSE 2 * covar_pop({x}, {y}) / {spread} END"


@query(
    "ccc",
    f"WITH {LINES}, pairs AS (SELECT a.l_returnflag AS grp, "
    + ", ".join(f"a.{c} AS g_{d}, b.{c} AS p_{d}" for d, c in DIMS.items())
    + " FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.i = b.i + 1), "
    + "wide AS (SELECT grp, count(*) AS n, "
    + ", ".join(f"{_ccc(d)} AS c_{d}" for d in DIMS)
    + " FROM pairs GROUP BY grp) "
    + unpivot(
        "wide", ["grp"], {**{f"ccc_{d}": f"c_{d}" for d in DIMS}, "ccc_mean": "(c_valence + c_arousal + c_dominance) / 3"}
    ),
)
def ccc_query(spark, sf_dir):
    rows = _lines(Tables(spark, sf_dir))
    before = rows.select(
        "l_orderkey", (F.col("i") + 1).alias("i"), *[F.col(c).alias(f"pred_{d}") for d, c in DIMS.items()]
    )
    pairs = rows.select(
        "l_orderkey", "i", F.col("l_returnflag").alias("grp"), *[F.col(c).alias(f"gt_{d}") for d, c in DIMS.items()]
    ).join(before, ["l_orderkey", "i"])
    return scores(ccc(pairs, ["grp"], list(DIMS)))


@query(
    "aae_annotators",
    "WITH gt AS (SELECT l_orderkey, avg(l_quantity) AS v, avg(l_discount) AS a, avg(l_tax) AS d FROM lineitem GROUP BY l_orderkey), "
    "e AS (SELECT o_orderpriority AS grp, abs(o_totalprice / 10000 - v) AS ev, "
    "abs(CASE WHEN o_orderstatus <> 'P' THEN 0.05 END - a) AS ea, abs(0.04 - d) AS ed "
    "FROM orders JOIN gt ON l_orderkey = o_orderkey), "
    "wide AS (SELECT grp, count(ev) AS n, avg(ev) AS v, avg(ea) AS a, avg(ed) AS d, "
    "(sum(ev) + coalesce(sum(ea), 0) + sum(ed)) / (count(ev) + count(ea) + count(ed)) AS m FROM e GROUP BY grp) "
    + unpivot("wide", ["grp"], {"aae_valence": "v", "aae_arousal": "a", "aae_dominance": "d", "aae_mean": "m"}),
)
def aae_annotators(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gt = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        *[F.avg(c).alias(f"gt_{d}") for d, c in DIMS.items()]
    )
    pairs = t.orders.join(gt, "o_orderkey").select(
        F.col("o_orderpriority").alias("grp"),
        (F.col("o_totalprice") / 10000).alias("pred_valence"),
        F.when(F.col("o_orderstatus") != "P", 0.05).alias("pred_arousal"),
        F.lit(0.04).alias("pred_dominance"),
        *[f"gt_{d}" for d in DIMS],
    )
    return scores(aae(pairs, ["grp"], list(DIMS)))


@query(
    "count_mae",
    "WITH gt AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey), "
    "wide AS (SELECT o_orderpriority AS grp, count(*) AS n, avg(abs(c - CAST(trunc(o_totalprice / 75000) AS BIGINT))) AS mae, "
    "avg(CASE WHEN c = CAST(trunc(o_totalprice / 75000) AS BIGINT) THEN 1.0 ELSE 0.0 END) AS ex "
    "FROM orders JOIN gt ON l_orderkey = o_orderkey GROUP BY 1) "
    + unpivot("wide", ["grp"], {"mae": "mae", "exact_accuracy": "ex"}),
)
def count_mae_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gt = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("gt"))
    pairs = t.orders.join(gt, "o_orderkey").select(
        F.col("o_orderpriority").alias("grp"), "gt", (F.col("o_totalprice") / 75000).cast("long").alias("pred")
    )
    return scores(count_mae(pairs, ["grp"]))


@query(
    "vote_label",
    "WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, "
    "CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 WHEN 'R' THEN 3 ELSE 99 END) AS k FROM v) "
    "SELECT l_orderkey, l_returnflag, CAST(n AS BIGINT) AS votes FROM r WHERE k = 1",
)
def vote_label(spark, sf_dir):
    return majority_label(Tables(spark, sf_dir).lineitem, ["l_orderkey"], "l_returnflag", order=["N", "A", "R"])


@query(
    "vote_first_seen",
    f"WITH {LINES}, v AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(i) AS f FROM lines GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f) AS k FROM v) "
    "SELECT l_orderkey, l_returnflag, CAST(n AS BIGINT) AS votes FROM r WHERE k = 1",
)
def vote_first_seen(spark, sf_dir):
    return majority_label(_lines(Tables(spark, sf_dir)), ["l_orderkey"], "l_returnflag", seen="i")


@query(
    "annotator_reduce",
    "WITH a AS (SELECT event_id, [event_type, CASE WHEN value < 10 THEN 'view' ELSE 'click' END, "
    "CASE WHEN value < 20 THEN 'click' ELSE event_type END] AS votes, [value, value / 2, NULL] AS nums FROM events), "
    "u AS (SELECT event_id, unnest(votes) AS v, unnest([1, 2, 3]) AS i FROM a), "
    "c AS (SELECT event_id, v, count(*) AS n, min(i) AS f FROM u GROUP BY 1, 2), "
    "s AS (SELECT event_id, arg_min(v, f - 10 * n) AS seen, string_agg(v, ',' ORDER BY v) AS labels, "
    "arg_min(v, CASE v WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 99 END * 10 + f - 10000 * n) AS listed FROM c GROUP BY 1) "
    "SELECT a.event_id, seen AS vote_seen, listed AS vote_listed, labels AS union_labels, "
    "round(list_avg(nums), 6) AS mean_value FROM a JOIN s USING (event_id)",
)
def annotator_reduce(spark, sf_dir):
    value, kind = F.col("value"), F.col("event_type")
    votes = F.array(
        kind,
        F.when(value < 10, "view").otherwise("click"),
        F.when(value < 20, F.lit("click")).otherwise(kind),
    )
    rows = Tables(spark, sf_dir).events.select("event_id", votes.alias("votes"), "value")
    return rows.select(
        "event_id",
        lb.annotator_vote(F.col("votes")).alias("vote_seen"),
        lb.annotator_vote(F.col("votes"), ["view", "click"]).alias("vote_listed"),
        F.array_join(F.array_sort(lb.annotator_union(F.transform("votes", lambda v: F.array(v)))), ",").alias(
            "union_labels"
        ),
        r6(lb.annotator_mean(F.array(F.col("value"), F.col("value") / 2, F.lit(None).cast("double")))).alias(
            "mean_value"
        ),
    )


@query(
    "collect_annotators",
    f"WITH {LINES} SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY i) AS points, "
    "arg_min(l_suppkey, i) AS head FROM lines GROUP BY l_orderkey",
)
def collect_annotators(spark, sf_dir):
    t = Tables(spark, sf_dir)
    order = F.struct(*LINE_ORDER)
    heads = t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_suppkey", order).alias("head"))
    listed = gather(t.lineitem, ["l_orderkey"], LINE_ORDER, F.col("l_partkey").cast("string"), "points")
    return listed.join(heads, "l_orderkey").select(
        "l_orderkey", F.array_join("points", ",").alias("points"), "head"
    )

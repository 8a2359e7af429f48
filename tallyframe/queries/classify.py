"""Classification and label-set metrics over events, labels and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.metrics.classification import classification_report
from tallyframe.metrics.multilabel import exact_match, mean_jaccard, multilabel_report
from tallyframe.queries.base import FRAMES, TYPES, Tables, frames, previous, query, scores, unpivot


def label_sql(pairs: str, by: list[str], values: dict[str, str], ctes: str = "") -> str:
    """Per-label counts of ``pairs`` (gt, pred), then one wide row per group."""
    k = "".join(f"{b}, " for b in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return (
        f"WITH {ctes + ', ' if ctes else ''}pairs AS ({pairs}), "
        f"sides AS (SELECT {k}gt AS label, CASE WHEN gt = pred THEN 1 ELSE 0 END AS tp, 1 AS sup, 0 AS pr FROM pairs "
        f"UNION ALL SELECT {k}pred, 0, 0, 1 FROM pairs), "
        f"counts AS (SELECT {k}label, sum(tp) AS tp, sum(sup) AS sup, sum(pr) AS pr FROM sides GROUP BY {k}label), "
        f"lab AS (SELECT *, CASE WHEN pr > 0 THEN tp / pr ELSE 0 END AS prec, "
        f"CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec, "
        f"CASE WHEN sup + pr > 0 THEN 2 * tp / (sup + pr) ELSE 0 END AS f1 FROM counts), "
        f"wide AS (SELECT {k}sum(sup) AS n, {', '.join(f'{v} AS m{i}' for i, v in enumerate(values.values()))} "
        f"FROM lab {group}) "
        + unpivot("wide", by, {m: f"m{i}" for i, m in enumerate(values)})
    )


def _in(classes: list[str]) -> str:
    return "label IN (" + ", ".join(f"'{c}'" for c in classes) + ")"


def _one(label: str, score: str) -> str:
    return f"coalesce(max(CASE WHEN label = '{label}' THEN {score} END), 0)"


BINARY = (
    "SELECT lang, CAST(quality AS VARCHAR) AS gt, CASE WHEN n_chars > 400 THEN '1' ELSE '0' END AS pred "
    "FROM labels JOIN documents USING (doc_id)"
)


@query(
    "clf_report_by_lang",
    label_sql(
        BINARY,
        ["lang"],
        {
            "accuracy": "sum(tp) / sum(sup)",
            "macro_f1": "avg(f1)",
            "weighted_f1": "sum(f1 * sup) / sum(sup)",
            "precision": _one("1", "prec"),
            "recall": _one("1", "rec"),
            "f1": _one("1", "f1"),
        },
    ),
)
def clf_report_by_lang(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pairs = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang",
        F.col("quality").cast("string").alias("gt"),
        F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("pred"),
    )
    return scores(
        classification_report(
            pairs, ["lang"], ["accuracy", "macro_f1", "weighted_f1", "precision", "recall", "f1"]
        )
    )


EIGHT = [*TYPES, "refund", "share", "other"]
FOUR = TYPES[:4]
LAGGED = (
    "SELECT CAST(CAST(a.ts AS DATE) AS VARCHAR) AS day, a.event_type AS gt, b.event_type AS pred "
    "FROM frames a JOIN frames b ON a.clip = b.clip AND a.frame = b.frame + 1"
)


def _lagged(t: Tables):
    return previous(frames(t), {"event_type": "pred"}).select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("gt"), "pred"
    )


@query(
    "clf_macro_fixed",
    label_sql(
        LAGGED,
        ["day"],
        {
            "macro_f1": f"sum(CASE WHEN {_in(EIGHT)} THEN f1 ELSE 0 END) / 8",
            **{f"f1_{c}": _one(c, "f1") for c in EIGHT},
        },
        FRAMES,
    ),
)
def clf_macro_fixed(spark, sf_dir):
    return scores(
        classification_report(_lagged(Tables(spark, sf_dir)), ["day"], ["macro_f1"], EIGHT, per_class=["f1"])
    )


@query(
    "clf_macro_observed",
    label_sql(
        "SELECT o_orderpriority AS grp, o_orderstatus AS gt, "
        "CASE WHEN o_totalprice < 100000 THEN 'O' WHEN o_totalprice < 250000 THEN 'F' "
        "WHEN o_totalprice < 450000 THEN 'P' ELSE '' END AS pred FROM orders",
        ["grp"],
        {"accuracy": "sum(tp) / sum(sup)", "macro_f1": "avg(f1)", "weighted_f1": "sum(f1 * sup) / sum(sup)"},
    ),
)
def clf_macro_observed(spark, sf_dir):
    price = F.col("o_totalprice")
    pred = F.when(price < 100000, "O").when(price < 250000, "F").when(price < 450000, "P").otherwise("")
    pairs = Tables(spark, sf_dir).orders.select(
        F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("gt"), pred.alias("pred")
    )
    return scores(classification_report(pairs, ["grp"], ["accuracy", "macro_f1", "weighted_f1"]))


@query(
    "clf_weighted",
    label_sql(
        LAGGED,
        ["day"],
        {
            "weighted_f1": f"sum(CASE WHEN {_in(FOUR)} THEN f1 * sup ELSE 0 END) / sum(CASE WHEN {_in(FOUR)} THEN sup ELSE 0 END)",
            "macro_f1": f"sum(CASE WHEN {_in(FOUR)} THEN f1 ELSE 0 END) / 4",
        },
        FRAMES,
    ),
)
def clf_weighted(spark, sf_dir):
    return scores(
        classification_report(_lagged(Tables(spark, sf_dir)), ["day"], ["weighted_f1", "macro_f1"], FOUR)
    )


SIX = [*TYPES, "refund"]


@query(
    "uar",
    label_sql(
        LAGGED,
        ["day"],
        {
            "accuracy": "sum(tp) / sum(sup)",
            "uar": f"sum(CASE WHEN {_in(SIX)} THEN rec ELSE 0 END) / 6",
            "ua": "avg(CASE WHEN sup > 0 THEN rec END)",
            "wa": "sum(tp) / sum(sup)",
        },
        FRAMES,
    ),
)
def uar(spark, sf_dir):
    return scores(
        classification_report(_lagged(Tables(spark, sf_dir)), ["day"], ["accuracy", "uar", "ua", "wa"], SIX)
    )


@query(
    "one_vs_rest_map",
    label_sql(
        "SELECT CAST(CAST(a.ts AS DATE) AS VARCHAR) AS day, a.event_type AS gt, "
        "CASE WHEN a.value >= 10 THEN b.event_type END AS pred "
        "FROM frames a JOIN frames b ON a.clip = b.clip AND a.frame = b.frame + 1",
        ["day"],
        {
            "mAP": f"sum(CASE WHEN {_in(SIX)} AND sup > 0 THEN prec * rec + (1 - rec) * sup / total END) "
            f"/ sum(CASE WHEN {_in(SIX)} AND sup > 0 THEN 1 END)",
            **{
                f"{m}_{c}": f"CASE WHEN max(CASE WHEN label = '{c}' THEN sup END) > 0 THEN max(CASE WHEN label = '{c}' THEN {s} END) END"
                for c in SIX
                for m, s in (("ap", "prec * rec + (1 - rec) * sup / total"), ("recall", "rec"), ("f1", "f1"))
            },
        },
        FRAMES,
    ).replace("FROM lab GROUP BY", "FROM (SELECT *, sum(sup) OVER (PARTITION BY day) AS total FROM lab) GROUP BY"),
)
def one_vs_rest_map(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pairs = previous(frames(t), {"event_type": "before"}).select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("event_type").alias("gt"),
        F.when(F.col("value") >= 10, F.col("before")).alias("pred"),
    )
    return scores(
        classification_report(
            pairs, ["day"], ["mAP"], SIX, per_class=["ap", "recall", "f1"], skip_absent=True
        )
    )


def _halves(t: Tables):
    """Per user: event types of the first and of the second half of the month."""
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return (
        t.events.groupBy("user_id", "event_type")
        .agg(F.max(early).alias("first"), F.max(~early).alias("second"))
        .groupBy("user_id")
        .agg(
            F.collect_list(F.when(F.col("first"), F.col("event_type"))).alias("gt"),
            F.collect_list(F.when(F.col("second"), F.col("event_type"))).alias("pred"),
        )
    )


def _set_sql(values: dict[str, str]) -> str:
    flags = ", ".join(
        f"max(CASE WHEN event_type = '{c}' AND ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END) AS g{i}, "
        f"max(CASE WHEN event_type = '{c}' AND ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END) AS p{i}"
        for i, c in enumerate(SIX)
    )
    sums = ", ".join(
        f"sum(g{i} * p{i}) AS tp{i}, sum(g{i}) AS s{i}, sum(p{i}) AS r{i}" for i in range(len(SIX))
    )
    return (
        f"WITH users AS (SELECT user_id, {flags} FROM events GROUP BY user_id), "
        f"wide AS (SELECT count(*) AS n, {sums} FROM users) " + unpivot("wide", [], values)
    )


def _f1(i: int) -> str:
    return f"CASE WHEN s{i} > 0 THEN 2 * tp{i} / (s{i} + r{i}) END"


def _ap(i: int) -> str:
    p = f"CASE WHEN r{i} > 0 THEN tp{i} / r{i} ELSE 0 END"
    return f"CASE WHEN s{i} > 0 THEN ({p}) * tp{i} / s{i} + (1 - tp{i} / s{i}) * s{i} / n END"


def _mean(terms: list[str]) -> str:
    return f"list_avg(list_filter([{', '.join(terms)}], lambda x: x IS NOT NULL))"


@query(
    "multilabel_f1",
    _set_sql({**{f"f1_{c}": _f1(i) for i, c in enumerate(SIX)}, "macro_f1": _mean([_f1(i) for i in range(6)])}),
)
def multilabel_f1(spark, sf_dir):
    return scores(multilabel_report(_halves(Tables(spark, sf_dir)), [], SIX, ["f1"], {"f1": "macro_f1"}))


@query(
    "multilabel_map",
    _set_sql({**{f"ap_{c}": _ap(i) for i, c in enumerate(SIX)}, "mAP": _mean([_ap(i) for i in range(6)])}),
)
def multilabel_map(spark, sf_dir):
    return scores(multilabel_report(_halves(Tables(spark, sf_dir)), [], SIX, ["ap"], {"ap": "mAP"}))


@query(
    "exact_match",
    _set_sql({f"acc_{c}": f"(n - s{i} - r{i} + 2 * tp{i}) / n" for i, c in enumerate(SIX)}).replace(
        "AS n, ", "AS n, avg(CASE WHEN " + " AND ".join(f"g{i} = p{i}" for i in range(6)) + " THEN 1.0 ELSE 0.0 END) AS ex, ", 1
    )
    + " UNION ALL SELECT 'exact_match_accuracy', round(ex, 6), CAST(n AS BIGINT) FROM wide",
)
def exact_match_query(spark, sf_dir):
    pairs = _halves(Tables(spark, sf_dir))
    return scores(multilabel_report(pairs, [], SIX, ["acc"]).unionByName(exact_match(pairs, [], SIX)))


@query(
    "jaccard",
    "WITH users AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE ts < TIMESTAMP '2024-01-16'), []) AS g, "
    "coalesce(list(DISTINCT event_type) FILTER (WHERE ts >= TIMESTAMP '2024-01-16'), []) AS p FROM events GROUP BY user_id) "
    "SELECT 'mean_jaccard' AS metric, round(avg(CASE WHEN len(g) + len(p) = 0 THEN 1.0 ELSE "
    "len(list_intersect(g, p)) / (len(g) + len(p) - len(list_intersect(g, p))) END), 6) AS value, "
    "CAST(count(*) AS BIGINT) AS n_used FROM users",
)
def jaccard_query(spark, sf_dir):
    return scores(mean_jaccard(_halves(Tables(spark, sf_dir)), []))

"""Whole scoring runs, naive baselines, corrected metrics and scorecards."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tallyframe.functions import messages as ms
from tallyframe.metrics.classification import classification_report
from tallyframe.metrics.registry import METRICS, Metric, register_metric
from tallyframe.metrics.regression import aae
from tallyframe.operators.joins import align
from tallyframe.operators.ordered import row_index
from tallyframe.operators.split import hash_split
from tallyframe.plans import baselines as bl
from tallyframe.plans import score as sc
from tallyframe.plans import documents as dc
from tallyframe.plans.evaluate import RUN, Evaluation, evaluate, results_document
from tallyframe.plans.tasks import TASKS
from tallyframe.queries.base import FRAMES, TYPES, Tables, frames, query, r6, scores, unpivot
from tallyframe.queries.chat import RESPONSES, responses
from tallyframe.session import checkpoint

TASK = "CASE WHEN event_type IN ('view', 'click', 'error') THEN 'mustard-omni_video-context' ELSE 'urfunny-omni_video-audio' END"


def _runs(t: Tables):
    """Two models that answer every event in seven ways, some of them unusable."""
    sarcasm = F.col("event_type").isin("view", "click", "error")
    events = t.events.withColumn(
        "task", F.when(sarcasm, "mustard-omni_video-context").otherwise("urfunny-omni_video-audio")
    )
    key = F.when(sarcasm, "sarcasm").otherwise("funny")
    truth_value = F.regexp_extract("props", r"(\d+)", 1).cast("int") > 60

    def answer(flag):
        shown = F.when(sarcasm, flag.cast("string")).otherwise(flag.cast("int").cast("string"))
        return F.concat(F.lit('{"'), key, F.lit('": '), shown, F.lit("}"))

    truth = events.select(
        "task",
        F.lit("test").alias("split"),
        F.col("event_id").alias("row_idx"),
        ms.build_messages(
            "judge", "now", F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(answer(truth_value))
        ).alias("messages"),
    )
    models = F.inline(
        F.array(
            *[F.struct(F.lit(n).alias("model"), F.lit(v).alias("bound")) for n, v in (("bold", 15.0), ("shy", 30.0))]
        )
    )
    asked = events.select("*", models)
    given = answer(F.col("value") > F.col("bound"))
    text = {
        0: F.concat(F.lit('<think>{"sarcasm": true}</think>\n'), given),
        1: F.concat(F.lit("```json\n"), given, F.lit("\n```")),
        2: F.concat(F.lit("I say "), given, F.lit(" ok")),
        3: F.lit("[1, 2]"),
        4: F.lit('{"other": 1}'),
        5: F.lit("none {"),
    }
    response = given
    for i, form in text.items():
        response = F.when(F.col("event_id") % 7 == i, form).otherwise(response)
    predictions = asked.select(
        "model", "task", F.lit("test").alias("split"), F.col("event_id").alias("row_idx"), response.alias("response")
    )
    return predictions, truth


RUNS = (
    f"runs AS (SELECT model, {TASK} AS task, 'test' AS split, event_id % 7 AS form, event_id % 11 = 0 AS lost, "
    "CASE WHEN value > bound THEN '1' ELSE '0' END AS pred, CASE WHEN CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) > 60 THEN '1' ELSE '0' END AS gt "
    "FROM events, (VALUES ('bold', 15.0), ('shy', 30.0)) AS m(model, bound)), "
    "used AS (SELECT * FROM runs WHERE form IN (0, 1, 2, 6) AND NOT lost)"
)


def _runs_sql() -> str:
    lab = (
        f"WITH {RUNS}, sides AS (SELECT model, task, split, gt AS label, CASE WHEN gt = pred THEN 1 ELSE 0 END AS tp, 1 AS sup, 0 AS pr FROM used "
        "UNION ALL SELECT model, task, split, pred, 0, 0, 1 FROM used), "
        "lab AS (SELECT model, task, split, label, sum(tp) AS tp, sum(sup) AS sup, sum(pr) AS pr FROM sides GROUP BY ALL), "
        "s AS (SELECT *, CASE WHEN pr > 0 THEN tp / pr ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS r, 2 * tp / (sup + pr) AS f FROM lab), "
        "wide AS (SELECT model, task, split, sum(sup) AS n, sum(tp) / sum(sup) AS acc, avg(f) AS macro, sum(f * sup) / sum(sup) AS wf, "
        "coalesce(max(CASE WHEN label = '1' THEN p END), 0) AS prec, coalesce(max(CASE WHEN label = '1' THEN r END), 0) AS rec, "
        "coalesce(max(CASE WHEN label = '1' THEN f END), 0) AS f1, coalesce(max(CASE WHEN label = '0' THEN f END), 0) AS f0 FROM s GROUP BY ALL), "
        "a AS (SELECT * FROM wide WHERE task LIKE 'must%'), b AS (SELECT * FROM wide WHERE task LIKE 'urf%') "
    )
    by = ["model", "task", "split"]
    first = unpivot("a", by, {"accuracy": "acc", "weighted_f1": "wf", "macro_f1": "macro", "precision": "prec", "recall": "rec"})
    second = unpivot("b", by, {"accuracy": "acc", "macro_f1": "macro", "f1_funny": "f1", "f1_not_funny": "f0"})
    return f"{lab} {first} UNION ALL {second}"


@query("score_runs", _runs_sql())
def score_runs(spark, sf_dir):
    return scores(evaluate(*_runs(Tables(spark, sf_dir))).metrics).drop("source")


@query(
    "format_compliance",
    f"WITH {RUNS}, c AS (SELECT model, task, split, count(*) AS n_samples, count(*) FILTER (WHERE form NOT IN (3, 5) AND NOT lost) AS n_valid, "
    "count(*) FILTER (WHERE form IN (3, 5)) AS n_parse_failures, count(*) FILTER (WHERE form IN (0, 1, 2, 6) AND NOT lost) AS n_used FROM runs GROUP BY ALL), "
    "d AS (SELECT *, CASE WHEN task LIKE 'urf%' THEN n_used ELSE n_valid END AS n_metric_valid FROM c) "
    "SELECT model, task, split, n_samples, n_valid, n_parse_failures, n_metric_valid, round(n_metric_valid / n_samples, 4) AS format_compliance_rate, "
    "round(100.0 * n_parse_failures / n_samples, 1) AS parse_failure_pct, round(n_metric_valid / n_samples, 4) < 0.8 AS below_floor, NULL AS error FROM d "
    "UNION ALL SELECT model, 'rldd-omni', 'test', 0, 0, 0, 0, NULL, NULL, NULL, 'no answers to compare with the truth' FROM (VALUES ('bold'), ('shy')) AS m(model) "
    "UNION ALL SELECT model, 'nothing known', 'test', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unknown dataset key: nothing known' FROM (VALUES ('bold'), ('shy')) AS m(model) "
    "UNION ALL SELECT 'mute', 'mustard-omni_video-context', 'test', 0, 0, 0, 0, NULL, NULL, NULL, 'no answers to compare with the truth'",
)
def format_compliance(spark, sf_dir):
    predictions, truth = _runs(Tables(spark, sf_dir))
    # A known task without truth, an unknown task, and a run without a readable line.
    lost = predictions.withColumn("task", F.when(F.col("row_idx") % 2 == 0, "rldd-omni").otherwise("nothing known"))
    empty = spark.range(1).select(F.lit("mute").alias("model"), F.lit("mustard-omni_video-context").alias("task"), F.lit("test").alias("split"))
    return evaluate(predictions.unionByName(lost), truth, runs=empty).summary


@query(
    "align_positional",
    f"WITH {RESPONSES}, p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_idx FROM resp WHERE event_id % 7 <> 5), "
    "g AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_idx FROM events) "
    "SELECT event_type, CAST(row_idx AS BIGINT) AS row_idx, p.event_id AS predicted_id, g.event_id AS truth_id FROM p JOIN g USING (event_type, row_idx)",
)
def align_positional(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kept = responses(t).where("event_id % 7 <> 5").select("event_type", F.col("event_id").alias("predicted_id"))
    truth = t.events.select("event_type", F.col("event_id").alias("truth_id"))
    return align(
        row_index(kept, ["event_type"], ["predicted_id"], "row_idx"),
        row_index(truth, ["event_type"], ["truth_id"], "row_idx"),
        ["event_type"],
    )


SPOKEN = RUNS.replace("SELECT * FROM runs WHERE form IN (0, 1, 2, 6) AND NOT lost", "SELECT model, task, split, form, lost, CASE WHEN form = 5 THEN '0' ELSE pred END AS pred, gt FROM runs WHERE (form IN (0, 1, 2, 6) OR (form = 5 AND task LIKE 'must%')) AND NOT lost")


@query("text_parser_hook", _runs_sql().replace(RUNS, SPOKEN))
def text_parser_hook(spark, sf_dir):
    """One task reads answers without JSON through a function of the session."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION spoken_sarcasm(answer STRING) RETURNS STRING "
        "RETURN CASE WHEN answer LIKE 'none%' THEN '{\"sarcasm\": false}' END"
    )
    key = "mustard-omni_video-context"
    tasks = TASKS | {key: replace(TASKS[key], text_parser="spoken_sarcasm")}
    return scores(evaluate(*_runs(Tables(spark, sf_dir)), tasks=tasks).metrics).drop("source")


def _fragile(rows, by):
    """The share of rows with an answer of one member; it fails on the runs of one model."""
    given = F.when(F.col("model") == "shy", F.raise_error(F.lit("no score for shy"))).otherwise(1.0)
    shares = rows.groupBy(*by).agg(F.avg(given).alias("value"), F.count("*").alias("n_used"))
    return shares.select(*by, F.lit("answered").alias("metric"), "value", "n_used")


@query(
    "metric_containment",
    f"WITH all_values AS ({_runs_sql()}) SELECT *, NULL AS error FROM all_values UNION ALL "
    f"(WITH {RUNS} SELECT model, task, split, CASE model WHEN 'shy' THEN 'fragile_error' ELSE 'answered' END, CASE model WHEN 'shy' THEN NULL ELSE 1.0 END, "
    "CASE model WHEN 'shy' THEN 0 ELSE count(*) END, CASE model WHEN 'shy' THEN 'no score for shy' END FROM runs WHERE task LIKE 'must%' AND form NOT IN (3, 5) AND NOT lost GROUP BY model, task, split)",
)
def metric_containment(spark, sf_dir):
    """A metric that fails for one model leaves the other model's value and all other metrics."""
    if "fragile" not in METRICS:
        register_metric("fragile", Metric(_fragile))
    key = "mustard-omni_video-context"
    tasks = TASKS | {key: replace(TASKS[key], metrics=(*TASKS[key].metrics, "fragile"))}
    run = evaluate(*_runs(Tables(spark, sf_dir)), tasks=tasks)
    told = run.errors.withColumn("error", F.regexp_extract("error", "no score for [a-z]+", 0))
    return scores(run.metrics.drop("source")).join(told, [*RUN, "metric"], "left")


TRAIN = "md5('42|' || doc_id) < 'c'"


def _labelled(t: Tables):
    """(model, task, gt, pred, valid) rows: one task per label column, one model per language."""
    docs = t.documents.select("doc_id", "lang", "n_chars")
    tasks = F.inline(
        F.array(
            *[F.struct(F.lit(c).alias("task"), F.col(c).cast("string").alias("gt")) for c in ("quality", "toxic")]
        )
    )
    return t.labels.join(docs, "doc_id").select(
        "doc_id",
        F.col("lang").alias("model"),
        F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("pred"),
        (F.col("n_chars") > 150).alias("valid"),
        tasks,
    )


LABELLED = (
    "base AS (SELECT doc_id, lang AS model, CASE WHEN n_chars > 400 THEN '1' ELSE '0' END AS pred, n_chars > 150 AS valid, quality, toxic FROM labels JOIN documents USING (doc_id)), "
    "rows AS (SELECT doc_id, model, pred, valid, 'quality' AS task, CAST(quality AS VARCHAR) AS gt FROM base UNION ALL "
    "SELECT doc_id, model, pred, valid, 'toxic', CAST(toxic AS VARCHAR) FROM base), "
    "cut AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id)) <= floor(count(*) OVER () * 0.8) AS tr FROM (SELECT DISTINCT doc_id FROM rows)), "
    "votes AS (SELECT task, gt, count(*) AS n FROM rows JOIN cut USING (doc_id) WHERE tr GROUP BY ALL), "
    "best AS (SELECT task, gt AS pred FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, gt) AS k FROM votes) WHERE k = 1), "
    "tested AS (SELECT r.task AS grp, r.gt, b.pred FROM rows r JOIN cut USING (doc_id) JOIN best b ON b.task = r.task WHERE NOT tr)"
)


def _label_ctes(source: str, by: str, name: str) -> str:
    return (
        f"{name}_side AS (SELECT {by}, gt AS label, CASE WHEN gt = pred THEN 1 ELSE 0 END AS tp, 1 AS sup, 0 AS pr FROM {source} UNION ALL SELECT {by}, pred, 0, 0, 1 FROM {source}), "
        f"{name}_lab AS (SELECT {by}, label, sum(tp) AS tp, sum(sup) AS sup, sum(pr) AS pr FROM {name}_side GROUP BY ALL), "
        f"{name} AS (SELECT {by}, sum(sup) AS n, sum(tp) / sum(sup) AS acc, avg(2 * tp / (sup + pr)) AS macro FROM {name}_lab GROUP BY ALL)"
    )


def _naive(rows):
    marked = hash_split(rows, "doc_id")
    learnt = bl.majority(marked.where("split = 'train'"), ["task"])
    tested = bl.attach(marked.where("split = 'test'").drop("pred"), learnt, ["task"])
    report = classification_report(tested, ["task"], ["accuracy", "macro_f1"])
    return report.withColumnRenamed("task", "baseline_key")


@query(
    "majority_baseline",
    f"WITH {LABELLED}, {_label_ctes('tested', 'grp', 'w')}, x AS (SELECT grp AS baseline_key, n, acc, macro FROM w) "
    + unpivot("x", ["baseline_key"], {"accuracy": "acc", "macro_f1": "macro"}),
)
def majority_baseline(spark, sf_dir):
    return scores(_naive(_labelled(Tables(spark, sf_dir))))


@query(
    "mean_baseline",
    "WITH s AS (SELECT event_type AS grp, value, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k, "
    "md5('42|' || event_id) < 'c' AS tr FROM events), m AS (SELECT grp, avg(value) AS mv, avg(k) AS mk FROM s WHERE tr GROUP BY grp), "
    "wide AS (SELECT grp, count(*) AS n, avg(abs(mv - value)) AS ev, avg(abs(mk - k)) AS ek, "
    "(sum(abs(mv - value)) + sum(abs(mk - k))) / (2 * count(*)) AS em FROM s JOIN m USING (grp) WHERE NOT tr GROUP BY grp) "
    + unpivot("wide", ["grp"], {"aae_value": "ev", "aae_k": "ek", "aae_mean": "em"}),
)
def mean_baseline(spark, sf_dir):
    from tallyframe.operators.ordered import hash_order

    rows = Tables(spark, sf_dir).events.select(
        F.col("event_type").alias("grp"),
        F.col("value").alias("gt_value"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("gt_k"),
        (hash_order(42, "event_id") < "c").alias("train"),
    )
    learnt = bl.train_mean(rows.where("train"), ["grp"], ["value", "k"])
    tested = bl.attach(rows.where("NOT train"), learnt, ["grp"])
    return scores(aae(tested, ["grp"], ["value", "k"]))


@query(
    "label_freq_baseline",
    "WITH s AS (SELECT user_id, list(DISTINCT event_type) AS l FROM events WHERE value > 30 GROUP BY user_id), "
    "f AS (SELECT t, avg(CASE WHEN list_contains(l, t) THEN 1.0 ELSE 0.0 END) AS share FROM s, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS t) GROUP BY t) "
    "SELECT string_agg(t, ',' ORDER BY t) AS labels, CAST(count(*) AS BIGINT) AS n FROM f WHERE share > 0.9",
)
def label_freq_baseline(spark, sf_dir):
    events = Tables(spark, sf_dir).events.where("value > 30")
    sets = events.groupBy("user_id").agg(F.collect_set("event_type").alias("gt"))
    often = bl.frequent_labels(sets, [], TYPES, threshold=0.9)
    return often.select(F.array_join("pred", ",").alias("labels"), F.size("pred").cast("long").alias("n"))


@query(
    "constant_baselines",
    "WITH p AS (SELECT event_type AS grp, (event_id * 41 % 1001) / 1000.0 AS x, (event_id * 97 % 1001) / 1000.0 AS y FROM events), "
    "wide AS (SELECT grp, count(*) AS n, avg(sqrt((0.5 - x) ** 2 + (0.5 - y) ** 2)) AS d FROM p GROUP BY grp) "
    + unpivot("wide", ["grp"], {"min_dist": "d", "avg_dist": "d"}),
)
def constant_baselines(spark, sf_dir):
    from tallyframe.metrics.localization import gaze_distance

    point = F.array(*[(F.col("event_id") * f % 1001).cast("double") for f in (41, 97)])
    rows = Tables(spark, sf_dir).events.select(
        F.col("event_type").alias("grp"), F.array(point).alias("gt"), bl.constant_point().alias("pred")
    )
    return scores(gaze_distance(rows, ["grp"]))


def _adjusted(t: Tables):
    rows = _labelled(t)
    counts = rows.groupBy("model", "task").agg(
        F.count("*").alias("n_samples"), F.count_if("valid").alias("n_valid")
    )
    raw = classification_report(rows.where("valid"), ["model", "task"], ["accuracy", "macro_f1"])
    raw = raw.drop("n_used").join(counts, ["model", "task"]).withColumn("baseline_key", F.col("task"))
    naive = _naive(rows).where(~((F.col("baseline_key") == "toxic") & (F.col("metric") == "macro_f1")))
    # A few rows per model and task, used several times by the scorecards.
    naive = checkpoint(naive)
    return checkpoint(sc.adjust(raw, naive)), naive


ADJUSTED = (
    f"{LABELLED}, {_label_ctes('tested', 'grp', 'nb')}, vr AS (SELECT * FROM rows WHERE valid), {_label_ctes('vr', 'model, task', 'rw')}, "
    "cnt AS (SELECT model, task, count(*) AS n_samples, count(*) FILTER (WHERE valid) AS n_valid FROM rows GROUP BY ALL), "
    "rawl AS (SELECT model, task, 'accuracy' AS metric, acc AS value FROM rw UNION ALL SELECT model, task, 'macro_f1', macro FROM rw), "
    "nbl AS (SELECT grp AS task, 'accuracy' AS metric, acc AS naive FROM nb UNION ALL SELECT grp, 'macro_f1', macro FROM nb WHERE grp <> 'toxic'), "
    "adj AS (SELECT model, task, metric, value, n_samples, n_valid, naive IS NOT NULL AS adjusted, "
    "CASE WHEN naive IS NULL THEN value ELSE (value * n_valid + naive * (n_samples - n_valid)) / n_samples END AS score "
    "FROM rawl JOIN cnt USING (model, task) LEFT JOIN nbl USING (task, metric))"
)


@query(
    "adjust_metrics",
    f"WITH {ADJUSTED} SELECT model, task, metric, round(value, 6) AS value, adjusted, round(score, 6) AS score, n_samples, n_valid FROM adj",
)
def adjust_metrics(spark, sf_dir):
    return _adjusted(Tables(spark, sf_dir))[0].select(
        "model", "task", "metric", r6(F.col("value")).alias("value"), "adjusted", r6(F.col("score")).alias("score"),
        "n_samples", "n_valid",
    )


AXES = [
    ("Text", "quality", "quality", "accuracy", "up", 0.9, 1.0, 1.0),
    ("Text", "toxic", "toxic", "macro_f1", "up", None, 1.0, 0.8),
    ("Both", "error", "quality", "accuracy", "down", 0.1, 1.0, 1.0),
    ("Both", "error", "toxic", "accuracy", "down", 0.2, 3.0, 1.5),
    ("Both", "absent", "nothing", "accuracy", "up", 0.5, 1.0, 1.0),
]
AXES_SQL = (
    "axes AS (SELECT * FROM (VALUES "
    + ", ".join(
        "(" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v)) for v in a) + ")"
        for a in AXES
    )
    + ") AS v(level, axis, task, metric, direction, sota, weight, ceiling))"
)


def _norm(value: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL THEN 0 WHEN direction = 'up' THEN greatest(0, least(1, {value} / ceiling)) ELSE greatest(0, 1 - {value} / ceiling) END"
    )


# A corrected value of exactly 0 counts as missing.
SCORES = (
    f"{ADJUSTED}, {AXES_SQL}, models AS (SELECT DISTINCT model FROM adj), "
    f"axs AS (SELECT m.model, level, axis, sum(weight * {_norm('(CASE WHEN adjusted AND score = 0 THEN NULL ELSE score END)')}) / sum(weight) AS score FROM models m CROSS JOIN axes a "
    "LEFT JOIN adj USING (model, task, metric) GROUP BY m.model, level, axis)"
)


@query(
    "normalised_scores",
    f"WITH {SCORES} SELECT model, level, axis, round(score, 6) AS score FROM axs UNION ALL "
    f"SELECT 'naive', level, axis, round(sum(weight * {_norm('naive')}) / sum(weight), 6) FROM axes LEFT JOIN nbl USING (task, metric) GROUP BY level, axis UNION ALL "
    f"SELECT 'published', level, axis, CASE WHEN count(sota) < count(*) THEN NULL ELSE round(sum(weight * {_norm('sota')}) / sum(weight), 6) END FROM axes GROUP BY level, axis UNION ALL "
    f"SELECT 'raw ' || model, level, axis, round(sum(weight * {_norm('value')}) / sum(weight), 6) FROM models CROSS JOIN axes LEFT JOIN rawl USING (model, task, metric) GROUP BY model, level, axis",
)
def normalised_scores(spark, sf_dir):
    adjusted, naive = _adjusted(Tables(spark, sf_dir))
    own = sc.axis_scores(adjusted, AXES)
    weak = sc.naive_axis_scores(naive, AXES, key=lambda task: task).withColumn("model", F.lit("naive"))
    best = sc.published_axis_scores(spark, AXES).withColumn("model", F.lit("published"))
    raw = sc.raw_axis_scores(adjusted, AXES).withColumn("model", F.concat(F.lit("raw "), F.col("model")))
    rows = own.unionByName(weak).unionByName(best).unionByName(raw)
    return rows.select("model", "level", "axis", r6(F.col("score")).alias("score"))


@query(
    "level_scorecard",
    f"WITH {SCORES} SELECT level, axis, "
    + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN score END), 6) AS {m}" for m in ("en", "fr", "de"))
    + " FROM axs GROUP BY level, axis",
)
def level_scorecard(spark, sf_dir):
    adjusted, _ = _adjusted(Tables(spark, sf_dir))
    shown = sc.choose_models(sc.axis_scores(adjusted, AXES), {"es": False})
    card = sc.level_scorecard(shown, ["en", "fr", "de"])
    return card.select("level", "axis", *[r6(F.col(m)).alias(m) for m in ("en", "fr", "de")])


# The two label columns as two of the scored tasks.
STORED = {"quality": "mustard-omni_video-context", "toxic": "urfunny-omni_video-audio"}


def _documents(t: Tables):
    """Raw result documents of four models and the document of the naive baselines."""
    adjusted, naive = _adjusted(t)
    names = F.create_map(*[F.lit(x) for pair in STORED.items() for x in pair])
    runs = adjusted.withColumns({"task": names[F.col("task")], "split": F.lit("test")})
    missing = F.col("n_samples") - F.col("n_valid")
    summary = runs.select(*RUN, "n_samples", "n_valid", F.col("n_valid").alias("n_metric_valid"), missing.alias("n_parse_failures")).distinct()
    summary = summary.withColumns(
        {
            "format_compliance_rate": F.round(F.col("n_valid") / F.col("n_samples"), 4),
            "parse_failure_pct": F.round(100 * F.col("n_parse_failures") / F.col("n_samples"), 1),
            "error": F.lit(None).cast("string"),
        }
    )
    failed = summary.select("model", F.lit("nothing known").alias("task"), "split", F.lit("unknown dataset key").alias("error")).distinct()
    metrics = runs.select(*RUN, "metric", "value")
    none = metrics.select(*RUN, "metric", F.lit("").alias("error")).limit(0)
    raw = results_document(Evaluation(summary.unionByName(failed, allowMissingColumns=True), metrics, none))
    keys = F.create_map(*[F.lit(x) for k, v in STORED.items() for x in (k, TASKS[v].baseline)])
    baselines = dc.baselines_document(naive.withColumn("baseline_key", keys[F.col("baseline_key")]))
    return raw.withColumn("path", F.concat("model", F.lit("/metrics.json"))), baselines


STORED_SQL = "CASE task WHEN 'quality' THEN 'mustard-omni_video-context_test' ELSE 'urfunny-omni_video-audio_test' END"


@query(
    "adjusted_documents",
    f"WITH {ADJUSTED} SELECT model, {STORED_SQL} AS task, metric, adjusted, round(score, 6) AS score, n_samples, n_valid, n_samples - n_valid AS n_invalid, "
    "round(n_valid / n_samples, 4) AS rate FROM adj UNION ALL SELECT DISTINCT model, 'nothing known_test', NULL, NULL, NULL, 0, 0, NULL, NULL FROM adj",
)
def adjusted_documents(spark, sf_dir):
    """Raw documents, corrected and read again from their text."""
    raw, baselines = _documents(Tables(spark, sf_dir))
    stored = checkpoint(dc.adjusted_documents(raw, dc.baseline_values(baselines)))
    rows = dc.entries(stored.withColumn("path", F.lit(""))).withColumnRenamed("result", "task")
    values = dc.adjusted_values(stored)
    n_invalid = F.try_variant_get("entry", "$.n_invalid", "long")
    facts = rows.select("model", "task", "n_samples", "n_valid", n_invalid.alias("n_invalid"), F.col("format_compliance_rate").alias("rate"))
    return facts.join(values, ["model", "task"], "left").withColumn("score", r6(F.col("score")))


STORED_AXES = [(*a[:2], f"{STORED.get(a[2], a[2])}_test", *a[3:]) for a in AXES]


@query("document_scorecard", f"WITH {SCORES} SELECT model, level, axis, round(score, 6) AS score FROM axs")
def document_scorecard(spark, sf_dir):
    """Raw documents to corrected ones to the scores of a card."""
    raw, baselines = _documents(Tables(spark, sf_dir))
    stored = checkpoint(dc.adjusted_documents(raw, dc.baseline_values(baselines)))
    return dc.scorecard(stored, STORED_AXES).withColumn("score", r6(F.col("score")))

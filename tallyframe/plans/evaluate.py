"""Score many prediction files of many models in one job.

predictions
    ``model, task, split, row_idx, response`` and optionally ``messages``.
truth
    ``task, split, row_idx, messages``; the split is the stored one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallyframe.functions import messages as ms
from tallyframe.functions import parse as ps
from tallyframe.metrics.registry import COUNTS_ROWS, run_metric
from tallyframe.plans.tasks import TASKS, Task, ensure_text_parsers, resolve_split
from tallyframe.session import checkpoint, staged

RUN = ["model", "task", "split"]
COMPLIANCE_FLOOR = 0.80


@dataclass(frozen=True)
class Evaluation:
    """Counters per run, metric values in long form, and why a metric of a run failed (``<name>_error`` rows)."""

    summary: DataFrame
    metrics: DataFrame
    errors: DataFrame


def pair_answers(
    predictions: DataFrame,
    truth: DataFrame,
    tasks: dict[str, Task] = TASKS,
    max_samples: int | None = None,
    align: str = "row_idx",
) -> DataFrame:
    """Join predictions to the truth and parse both sides.

    ``align`` names the key: ``row_idx`` pairs by position, a stored sample id
    pairs by identity. Adds ``pred`` and ``gt`` as JSON text, ``head`` and the
    flags ``parsed`` and ``valid``.
    """
    if "messages" not in predictions.columns:
        predictions = predictions.withColumn("messages", F.lit(None).cast(ms.MESSAGES))
    if max_samples is not None:
        predictions = predictions.where(F.col("row_idx") < max_samples)
    asked = predictions.withColumnRenamed("messages", "asked").withColumn(
        "stored", resolve_split(F.col("task"), F.col("split"))
    )
    stored = truth.select("task", F.col("split").alias("stored"), align, "messages")
    paired = asked.join(stored, ["task", "stored", align]).drop("stored")
    response = F.coalesce("response", F.lit(""))
    ensure_text_parsers(predictions.sparkSession, tasks)
    fallback = F.lit(None).cast("string")
    for name, task in tasks.items():
        if task.text_parser:
            # The function is called on texts of its own task without an answer only.
            unread = F.when(F.col("task") == name, response)
            fallback = F.when(F.col("task") == name, F.call_function(task.text_parser, unread)).otherwise(fallback)
    needs_head = F.col("task").isin(*[n for n, t in tasks.items() if t.needs_head] or [""])
    answer = ms.answer_text(F.col("messages"), "last")
    parsed = paired.select(
        *RUN,
        align,
        ps.parse_response(response).alias("found"),
        fallback.alias("spoken"),
        ps.parse_response(answer).alias("gt"),
        F.when(needs_head, ms.extract_box(F.coalesce("asked", "messages"))).alias("head"),
    )
    return parsed.select(
        *RUN, align, F.coalesce("found", "spoken").alias("pred"), "gt", "head"
    ).withColumns(
        {
            "parsed": ps.is_object(F.col("pred")),
            "valid": ps.is_object(F.col("pred")) & F.col("gt").isNotNull(),
        }
    )


def format_compliance(paired: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Rows, usable rows and parse failures per run; rows without truth are neither."""
    return paired.groupBy(*by).agg(
        F.count("*").alias("n_samples"),
        F.count_if("valid").alias("n_valid"),
        F.count_if(~F.col("parsed")).alias("n_parse_failures"),
    )


def _known(names) -> Column:
    return F.col("task").isin(*names)


def _first_line(error: Exception) -> str:
    text = str(error).strip() or type(error).__name__
    return text.splitlines()[0][:300]


def _contained(scored: dict[str, Callable[[DataFrame], DataFrame]], rows: dict[str, DataFrame]) -> DataFrame:
    """All metrics of all runs as (RUN, metric, value, n_used, source, error), whatever fails.

    One job computes everything. Only if that fails, each metric is computed by itself, and one that fails again by halves
    of its runs, until the failing runs stand alone; those get one ``<name>_error`` row with the first line of the message.
    """

    def attempt(parts: list[tuple[str, DataFrame]]) -> DataFrame | Exception:
        made = None
        try:
            for name, part in parts:
                one = scored[name](part).select(*RUN, "metric", "value", "n_used", F.lit(name).alias("source"), F.lit(None).cast("string").alias("error"))
                made = one if made is None else made.unionByName(one)
            # A few rows per run: computed once for the metrics and for the summary.
            return checkpoint(made)
        except Exception as error:  # noqa: BLE001 - any failure of a metric is its result
            if rows[parts[0][0]].sparkSession.sparkContext._jsc.sc().isStopped():
                raise
            return error

    def by_halves(name: str, runs: list[Row], error: Exception) -> list[DataFrame]:
        spark = rows[name].sparkSession
        if len(runs) == 1:
            message = F.lit(_first_line(error)).alias("error")
            given = [F.lit(runs[0][c]).cast("string").alias(c) for c in RUN]
            none = [F.lit(f"{name}_error").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("n_used")]
            return [spark.range(1).select(*given, *none, F.lit(name).alias("source"), message)]
        out = []
        for half in (runs[: len(runs) // 2], runs[len(runs) // 2 :]):
            wanted = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in RUN]) for r in half])
            got = attempt([(name, rows[name].where(wanted))])
            out += by_halves(name, half, got) if isinstance(got, Exception) else [got]
        return out

    whole = attempt(list(rows.items()))
    if not isinstance(whole, Exception):
        return whole
    parts = []
    for name, part in rows.items():
        got = attempt([(name, part)])
        # At most one row per run.
        parts += by_halves(name, part.select(*RUN).distinct().orderBy(*RUN).collect(), got) if isinstance(got, Exception) else [got]
    return checkpoint(reduce(DataFrame.unionByName, parts))


def evaluate(
    predictions: DataFrame,
    truth: DataFrame,
    tasks: dict[str, Task] = TASKS,
    max_samples: int | None = None,
    align: str = "row_idx",
    strict: bool = False,
    runs: DataFrame | None = None,
    missing: DataFrame | None = None,
) -> Evaluation:
    """Parse once, keep the parsed rows by task, then one aggregation per metric over all runs.

    Every run among the predictions, and in ``runs`` (model, task, split; for files without a readable line), has a
    row in the summary; those that cannot be scored say why in ``error``. ``missing`` (task, split, error) names the
    truth tables that could not be read, with the stored split.
    """
    listed = predictions.select(*RUN)
    listed = (listed if runs is None else listed.unionByName(runs.select(*RUN))).distinct()
    unknown = listed.where(~_known(tasks))
    paired = pair_answers(predictions.where(_known(tasks)), truth, tasks, max_samples, align)
    parsed = staged(paired, ["task"])
    rows = parsed.where("valid").select(
        *RUN, F.try_parse_json("gt").alias("gt"), F.try_parse_json("pred").alias("pred"), "head"
    )
    # At most one row per registered task.
    present = {r["task"] for r in parsed.select("task").distinct().collect()}
    scored_tasks = {k: t for k, t in tasks.items() if k in present} or tasks
    names = sorted({m for t in scored_tasks.values() for m in t.metrics})
    users = {name: rows.where(_known([k for k, t in scored_tasks.items() if name in t.metrics])) for name in names}
    results = _contained({name: lambda part, name=name: run_metric(name, part, RUN, strict) for name in names}, users)
    counting = F.col("source").isin(*COUNTS_ROWS) & F.col("error").isNull()
    used = results.where(counting).groupBy(*RUN).agg(F.min("n_used").alias("used"))
    counted = (
        listed.where(_known(tasks))
        .join(format_compliance(parsed), RUN, "left")
        .fillna(0, ["n_samples", "n_valid", "n_parse_failures"])
        .join(used, RUN, "left")
        .withColumn("n_metric_valid", F.coalesce("used", "n_valid"))
        .withColumns(
            {
                "format_compliance_rate": F.round(F.try_divide("n_metric_valid", "n_samples"), 4),
                "parse_failure_pct": F.round(F.try_divide(100 * F.col("n_parse_failures"), F.col("n_samples")), 1),
                "error": F.when(F.col("n_samples") == 0, "no answers to compare with the truth").when(
                    F.col("n_valid") == 0, "no valid samples after parsing"
                ),
            }
        )
        .withColumn("below_floor", F.col("format_compliance_rate") < COMPLIANCE_FLOOR)
        .drop("used")
    )
    if missing is not None:
        # At most one row per registered task and split.
        absent = missing.select("task", F.col("split").alias("stored"), F.col("error").alias("absent"))
        told = counted.withColumn("stored", resolve_split(F.col("task"), F.col("split"))).join(F.broadcast(absent), ["task", "stored"], "left")
        counted = told.withColumn("error", F.coalesce("absent", "error")).select(*counted.columns)
    failed = unknown.withColumn("error", F.concat(F.lit("unknown dataset key: "), F.col("task")))
    errors = results.where("error IS NOT NULL").select(*RUN, "metric", "error")
    return Evaluation(counted.unionByName(failed, allowMissingColumns=True), results.drop("error"), errors)


def results_document(evaluation: Evaluation) -> DataFrame:
    """One JSON document per model: metadata and ``results[task_split]``."""
    cell = F.coalesce(F.col("error").cast("variant"), F.col("value").cast("variant"))
    by_name = lambda a, b: F.when(a["metric"] < b["metric"], -1).when(a["metric"] > b["metric"], 1).otherwise(0)
    told = evaluation.metrics.join(evaluation.errors, [*RUN, "metric"], "left").select(*RUN, F.struct("metric", cell.alias("value")).alias("c"))
    values = told.groupBy(*RUN).agg(F.map_from_entries(F.array_sort(F.collect_list("c"), by_name)).alias("metrics"))
    entry = F.struct(
        "n_samples",
        "n_valid",
        "n_metric_valid",
        "n_parse_failures",
        "format_compliance_rate",
        "metrics",
        "parse_failure_pct",
        "error",
    )
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    pair = F.struct(F.concat_ws("_", "task", "split").alias("k"), entry.alias("v"))
    tasks = (
        evaluation.summary.join(values, RUN, "left")
        .groupBy("model")
        .agg(F.array_sort(F.collect_list(pair), by_key).alias("e"))
    )
    document = F.struct(
        F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp")).alias("metadata"),
        F.map_from_entries("e").alias("results"),
    )
    return tasks.select("model", F.to_json(document).alias("document"))

"""Stored result documents: read, corrected by the naive baselines, written again and turned into scorecards.

A result document is JSON: ``{"metadata": ..., "results": {"<task>_<split>": entry}}`` with one document per model; an
entry holds counters and ``metrics``, or only an ``error``. Documents are walked as VARIANT, one row per entry and metric,
so a folder of any number of documents is one job. Numbers that are not finite may be written bare, as some writers do.

Defined cases: a text that is no JSON object has no entries. A metric counts when its value is a number (true and false
are 1 and 0). An entry without samples keeps its metrics uncorrected by division: their corrected value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans import score as sc

BARE = r"(?<=[\[:,\s])(NaN|-?Infinity)(?=\s*[,}\]])"
NUMBERS = ["BIGINT", "DOUBLE", "FLOAT", "BOOLEAN"]


def parsed(text: Column) -> Column:
    """The document as VARIANT; bare NaN and Infinity become text, NULL where it is no JSON."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_replace(text, BARE, '"$1"')))


def scan_documents(spark: SparkSession, folder: str, name: str = "metrics.json") -> DataFrame:
    """``model, path, document`` of a results folder.

    JSON files in the folder itself count, named by their model; only if there are none, the files ``name`` in its
    sub-folders do, named by the folder. Corrected documents below ``adjusted`` are left out.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    parts = F.split(F.col("_metadata.file_path"), "/")
    at = lambda i: F.url_decode(F.replace(F.element_at("parts", F.lit(i)), F.lit("+"), F.lit("%2B")))
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"), parts.alias("parts"))
    flat = at(-2) == root
    model = F.when(flat, F.regexp_replace(at(-1), r"\.json$", "")).otherwise(at(-2))
    nested = (at(-1) == name) & (at(-2) != "adjusted") & (at(-3) == root)
    rows = rows.where(flat | nested).select(model.alias("model"), "path", "document", flat.alias("flat"))
    return sc.prefer_flat(rows).drop("flat")


def _exploded(rows: DataFrame, value: str, key: str, out: str, keep: list[str]) -> DataFrame:
    """One row per member of an object column; rows without members are gone."""
    members = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(value).outer()).select("key", F.col("value").alias("__member")))
    return members.where("key IS NOT NULL").select(*keep, F.col("key").alias(key), F.col("__member").alias(out))


def _number(value: Column) -> Column:
    """A finite or infinite number, or NULL for anything else."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    special = F.when((kind == "STRING") & text.isin("NaN", "Infinity", "-Infinity"), text.try_cast("double"))
    plain = F.when(kind.isin(*NUMBERS) | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))
    return F.coalesce(F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")), plain, special)


def entries(documents: DataFrame) -> DataFrame:
    """``model, path, result, entry, n_samples, n_valid, format_compliance_rate, failed`` of every entry.

    ``result`` is ``<task>_<split>``; ``failed`` marks entries that hold an error and no counters.
    """
    whole = documents.withColumn("__results", F.try_variant_get(parsed(F.col("document")), "$.results", "variant"))
    rows = _exploded(whole, "__results", "result", "entry", ["model", "path"])
    get = lambda name, kind: F.try_variant_get("entry", f"$.{name}", kind)
    counted = F.try_variant_get("entry", "$.n_samples", "variant").isNotNull()
    error = F.try_variant_get("entry", "$.error", "variant").isNotNull()
    return rows.withColumns(
        {
            "n_samples": F.coalesce(get("n_samples", "long"), F.lit(0)),
            "n_valid": F.coalesce(get("n_valid", "long"), F.lit(0)),
            "format_compliance_rate": get("format_compliance_rate", "double"),
            "failed": error & ~counted,
        }
    )


def metric_values(rows: DataFrame, field: str = "metrics") -> DataFrame:
    """``model, result, n_samples, n_valid, metric, value`` of the numbers in an object of each entry."""
    whole = rows.withColumn("__metrics", F.try_variant_get("entry", f"$.{field}", "variant"))
    values = _exploded(whole, "__metrics", "metric", "__value", ["model", "result", "n_samples", "n_valid"])
    return values.withColumn("value", _number(F.col("__value"))).where("value IS NOT NULL").drop("__value")


def baseline_values(documents: DataFrame) -> DataFrame:
    """``baseline_key, metric, value`` of baseline documents (``document``): ``{key: {metric: number}}``."""
    whole = documents.select(parsed(F.col("document")).alias("__keys"))
    rows = _exploded(whole, "__keys", "baseline_key", "__metrics", [])
    values = _exploded(rows, "__metrics", "metric", "__value", ["baseline_key"])
    return values.withColumn("value", _number(F.col("__value"))).where("value IS NOT NULL").drop("__value")


def baselines_document(baseline: DataFrame) -> DataFrame:
    """One JSON document of all ``baseline_key, metric, value`` rows: a few numbers per key."""
    inner = baseline.groupBy("baseline_key").agg(F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("m"))
    entry = F.struct("baseline_key", F.map_from_entries("m").alias("metrics"))
    by_key = lambda a, b: F.when(a["baseline_key"] < b["baseline_key"], -1).otherwise(1)
    return inner.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry), by_key))).alias("document"))


def corrected_values(documents: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every metric of raw documents with ``adjusted`` and ``score``; see ``score.adjust``."""
    rows = entries(documents).where("NOT failed")
    raw = metric_values(rows).withColumn("baseline_key", sc.baseline_of(F.col("result")))
    # An entry without samples has nothing to weigh by.
    return sc.adjust(raw.withColumn("n_samples", F.nullif("n_samples", F.lit(0))), baseline)


def adjusted_documents(documents: DataFrame, baseline: DataFrame) -> DataFrame:
    """``model, document``: the corrected document of every raw one, with its entries in the order of their names.

    Entries that only hold an error are taken over as they are.
    """
    rows = entries(documents)
    values = corrected_values(documents, baseline)
    pairs = lambda wanted: F.map_from_entries(
        F.array_sort(F.collect_list(F.when(wanted, F.struct("metric", F.col("score").alias("value")))))
    )
    split = values.groupBy("model", "result").agg(
        pairs(F.col("adjusted")).alias("metrics_adjusted"), pairs(~F.col("adjusted")).alias("metrics_no_baseline")
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    entry = F.struct(
        "n_samples", "n_valid", (F.col("n_samples") - F.col("n_valid")).alias("n_invalid"), "format_compliance_rate", "baseline_key",
        F.coalesce("metrics_adjusted", none).alias("metrics_adjusted"), F.coalesce("metrics_no_baseline", none).alias("metrics_no_baseline"),
    )
    options = {"ignoreNullFields": "false"}
    text = F.when(F.col("failed"), F.to_json("entry")).otherwise(F.to_json(entry, options))
    joined = rows.join(split, ["model", "result"], "left").withColumn("baseline_key", sc.baseline_of(F.col("result")))
    quoted = lambda c: F.to_json(F.array(c))
    name = lambda c: F.substring(quoted(c), F.lit(2), F.char_length(quoted(c)) - 2)
    lines = joined.select("model", "path", F.struct("result", F.concat(name(F.col("result")), F.lit(": "), text).alias("line")).alias("e"))
    listed = documents.select("model", "path").join(
        lines.groupBy("model", "path").agg(F.array_sort(F.collect_list("e")).alias("es")), ["model", "path"], "left"
    )
    results = F.coalesce(F.array_join(F.transform("es", lambda e: e["line"]), ", "), F.lit(""))
    head = F.concat(F.lit('{"model": '), name(F.col("model")), F.lit(', "source": '), name(F.col("path")))
    return listed.select("model", F.concat(head, F.lit(', "results": {'), results, F.lit("}}")).alias("document"))


def adjusted_values(documents: DataFrame) -> DataFrame:
    """``model, task, metric, adjusted, score`` of corrected documents, the input of ``score.axis_scores``."""
    rows = entries(documents.withColumn("path", F.lit(None).cast("string")) if "path" not in documents.columns else documents)
    rows = rows.where("NOT failed")
    parts = [metric_values(rows, f).withColumn("adjusted", F.lit(f == "metrics_adjusted")) for f in ("metrics_adjusted", "metrics_no_baseline")]
    both = parts[0].unionByName(parts[1])
    return both.select("model", F.col("result").alias("task"), "metric", "adjusted", F.col("value").alias("score"))


def scorecard(documents: DataFrame, axes: list[tuple] | None = None) -> DataFrame:
    """``model, level, axis, score`` of corrected documents; every document has its row per axis."""
    return sc.axis_scores(adjusted_values(documents), axes or sc.axis_rows(), documents.select("model").distinct())

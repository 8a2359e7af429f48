"""Expectations, distributions, merges, media and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.parse import field
from tallyframe.operators import expect as ex
from tallyframe.operators.joins import union_tagged
from tallyframe.plans.tasks import parse_source_name, resolve_split
from tallyframe.queries.base import Tables, query, r6
from tallyframe.queries.chat import BUILT, _built
from tallyframe.session import shared_path
from tallyframe.sources.catalogue import read_catalogue
from tallyframe.sources.media_store import append_blobs, stored_blobs
from tallyframe.sources.readers import attach_media, prefer_extension
from tallyframe.sources.writers import blob_table, write_samples

CHECKS = {
    "columns": "true",
    "roles": "true",
    "user_text": "contains(usr, '<text>') AND contains(usr, 'Box: [')",
    "answer_decodes": "true",
    "quality_is_number": "true",
    "quality_is_text": "false",
    "quality_positive": "quality BETWEEN 1 AND 5",
    "language_known": "lang IN ('en', 'fr')",
    "reasoned": "toxic = 1",
    "one_large_item": "strlen(text) > 1000",
}


@query(
    "expectations",
    f"WITH {BUILT.replace('toxic, source FROM', 'toxic, source, text FROM')}, c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS rule, doc_id, {c} AS ok FROM built" for n, c in CHECKS.items())
    + ") SELECT rule, count(*) AS n_rows, count(*) FILTER (WHERE NOT ok) AS n_failed, min(doc_id) FILTER (WHERE NOT ok) AS first_failing_id FROM c GROUP BY rule",
)
def expectations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    media = t.documents.select("doc_id", F.array(F.encode("text", "UTF-8")).alias("images"))
    rows = _built(t).join(media, "doc_id").withColumn("answer", ex.answer_of("messages"))
    answer = F.col("answer")
    complete = not ex.missing_columns(rows, ["messages", "images"])
    rules = {
        "columns": F.lit(complete),
        "roles": ex.roles_are("messages"),
        "user_text": ex.user_mentions("messages", "<text>", "Box: ["),
        "answer_decodes": answer.isNotNull(),
        "quality_is_number": ex.answer_has(answer, "quality", "BIGINT"),
        "quality_is_text": ex.answer_has(answer, "quality", "STRING"),
        "quality_positive": ex.number_between(field(answer, "quality"), 1, 5),
        "language_known": ex.label_in(field(answer, "lang"), ["en", "fr"]),
        "reasoned": ex.think_block("messages"),
        "one_large_item": ex.media_is("images", 1, 1000),
    }
    return ex.expect(rows, "doc_id", rules)


@query(
    "label_distribution",
    "SELECT lang, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
)
def label_distribution(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return ex.label_distribution(rows, F.when(F.col("quality") == 1, "good").otherwise("poor"), ["lang"])


@query(
    "number_stats",
    "SELECT l_returnflag, c AS \"column\", round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean FROM "
    "(SELECT l_returnflag, 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem) GROUP BY ALL",
)
def number_stats(spark, sf_dir):
    stats = ex.number_stats(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_discount"], ["l_returnflag"])
    return stats.select("l_returnflag", "column", *[r6(F.col(c)).alias(c) for c in ("min", "max", "mean")])


@query(
    "speaker_histogram",
    "WITH u AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS label FROM orders GROUP BY o_custkey) SELECT label, count(*) AS n FROM u GROUP BY label",
)
def speaker_histogram(spark, sf_dir):
    unique = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("u"))
    return ex.label_distribution(unique, F.col("u"))


@query(
    "merge_union",
    "SELECT doc_id AS id, lang, NULL AS url, 'documents' AS dataset FROM documents UNION ALL SELECT page_id, NULL, url, 'pages' FROM pages "
    "UNION ALL SELECT item_id, NULL, NULL, 'benchmark' FROM benchmark",
)
def merge_union(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return union_tagged(
        {
            "documents": t.documents.select(F.col("doc_id").alias("id"), "lang"),
            "pages": t.pages.select(F.col("page_id").alias("id"), "url"),
            "benchmark": t.benchmark.select(F.col("item_id").alias("id")),
        }
    )


@query(
    "build_status",
    "WITH expected AS (SELECT DISTINCT source AS dataset, lang AS path FROM documents), "
    "inputs AS (SELECT DISTINCT lang AS path FROM documents WHERE lang <> 'es'), "
    "built AS (SELECT source AS dataset, count(*) AS n_rows, count(*) FILTER (WHERE n_chars < 120) AS n_failed FROM documents GROUP BY source), "
    "m AS (SELECT dataset, count(*) FILTER (WHERE i.path IS NULL) AS n_missing FROM expected LEFT JOIN inputs i USING (path) GROUP BY dataset) "
    "SELECT dataset, CASE WHEN n_missing > 0 THEN 'skipped' WHEN n_failed > 0 THEN 'failed' ELSE 'ok' END AS status, n_missing, n_rows FROM m LEFT JOIN built USING (dataset)",
)
def build_status(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    expected = docs.select(F.col("source").alias("dataset"), F.col("lang").alias("path")).distinct()
    inputs = docs.where("lang <> 'es'").select(F.col("lang").alias("path"))
    built = docs.groupBy(F.col("source").alias("dataset")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("n_chars") < 120).alias("n_failed")
    )
    return ex.build_status(expected, inputs, built)


@query(
    "blob_dedupe",
    "SELECT md5(text) AS digest, count(*) AS n_rows, CAST(max(strlen(text)) AS BIGINT) AS bytes, min(doc_id) AS first_id FROM documents GROUP BY md5(text)",
)
def blob_dedupe(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    rows, blobs = blob_table(docs)
    uses = rows.groupBy("digest").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_id"))
    sizes = blobs.select("digest", F.octet_length("content").cast("long").alias("bytes"))
    return uses.join(sizes, "digest")


@query(
    "media_store",
    "WITH d AS (SELECT md5(text) AS digest, strlen(text) AS bytes, lang FROM documents), "
    "runs AS (SELECT 1 AS delivery, * FROM d WHERE lang = 'en' UNION ALL SELECT 2, * FROM d UNION ALL SELECT 3, * FROM d), "
    "first AS (SELECT digest, min(delivery) AS delivery, max(bytes) AS bytes FROM runs WHERE digest IS NOT NULL GROUP BY digest), "
    "new AS (SELECT delivery, count(*) AS n_stored, sum(bytes) AS bytes FROM first GROUP BY delivery) "
    "SELECT CAST(delivery AS INTEGER) AS delivery, n_rows, coalesce(n_stored, 0) AS n_stored, CAST(coalesce(bytes, 0) AS BIGINT) AS stored_bytes "
    "FROM (SELECT delivery, count(*) AS n_rows FROM runs GROUP BY delivery) LEFT JOIN new USING (delivery)",
)
def media_store(spark, sf_dir):
    """Three deliveries to one store: the documents of one language, all documents, and all of them again."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "lang", F.encode("text", "UTF-8").alias("content"))
    root, told = shared_path(spark, "media"), None
    for number, part in enumerate([docs.where("lang = 'en'"), docs, docs], 1):
        done = append_blobs(part, root, "doc_id")
        sizes = stored_blobs(spark, root).select("digest", F.octet_length("content").cast("long").alias("bytes"))
        stored = done.new.select("digest").join(sizes, "digest").agg(F.count("*").alias("n_stored"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("stored_bytes"))
        row = done.rows.agg(F.count("*").alias("n_rows")).crossJoin(stored).select(F.lit(number).alias("delivery"), "*")
        told = row if told is None else told.unionByName(row)
    return told


@query(
    "catalogue_merge",
    "WITH s AS (SELECT doc_id, source AS dataset, CASE WHEN n_chars < 500 THEN 'short' ELSE 'long' END AS task, "
    "CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, lang, n_chars FROM documents), "
    "status AS (SELECT dataset FROM s GROUP BY dataset HAVING count(*) FILTER (WHERE lang = 'de') > 0), "
    "chosen AS (SELECT dataset, task FROM (SELECT dataset, task, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, task) AS k FROM s GROUP BY dataset, task) WHERE k = 1) "
    "SELECT doc_id, dataset, task, split, CASE WHEN task = 'short' THEN lang END AS lang, CASE WHEN task = 'long' THEN n_chars END AS n_chars "
    "FROM s SEMI JOIN status USING (dataset) SEMI JOIN chosen USING (dataset, task)",
)
def catalogue_merge(spark, sf_dir):
    """Samples written by dataset, task and split; one task of each dataset that is ok, as one table."""
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    task = F.when(F.col("n_chars") < 500, "short").otherwise("long")
    docs = Tables(spark, sf_dir).documents.withColumns({"dataset": F.col("source"), "task": task, "split": split})
    root = shared_path(spark, "catalogue")
    write_samples(docs.where("task = 'short'").select("doc_id", "lang", "dataset", "task", "split"), root)
    write_samples(docs.where("task = 'long'").select("doc_id", "n_chars", "dataset", "task", "split"), root, mode="append")
    good = F.count_if(F.col("lang") == "de") > 0
    status = docs.groupBy("dataset").agg(F.when(good, "ok").otherwise("skipped").alias("status"))
    counts = docs.groupBy("dataset", "task").agg(F.count("*").alias("n"))
    chosen = counts.groupBy("dataset").agg(F.min_by("task", F.struct(-F.col("n"), "task")).alias("task"))
    return read_catalogue(spark, root, status, chosen)


@query(
    "attach_media",
    "SELECT event_id, md5(html) AS digest, skipped FROM events JOIN pages ON page_id = event_id % 300, "
    "(SELECT count(*) AS skipped FROM events WHERE event_id % 300 NOT IN (SELECT page_id FROM pages))",
)
def attach_media_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    media = t.pages.select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    rows = t.events.select("event_id", (F.col("event_id") % 300).cast("string").alias("image"))
    found, missing = attach_media(rows, media, "image")
    return found.select("event_id", F.md5("content").alias("digest"), missing.scalar().alias("skipped"))


FILES = (
    "files AS (SELECT 'media/' || (event_id % 700) || CASE event_id % 3 WHEN 0 THEN '.avi' WHEN 1 THEN '.MP4' ELSE '.txt' END AS path, "
    "event_id % 700 AS stem, event_id % 3 AS kind, max(event_id) AS length FROM events GROUP BY ALL)"
)


@query(
    "list_media",
    f"WITH {FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY CASE kind WHEN 1 THEN 1 ELSE 2 END, path) AS k FROM files WHERE kind < 2) "
    "SELECT CAST(stem AS VARCHAR) AS stem, path, length FROM r WHERE k = 1",
)
def list_media(spark, sf_dir):
    eid = F.col("event_id")
    ending = F.when(eid % 3 == 0, ".avi").when(eid % 3 == 1, ".MP4").otherwise(".txt")
    files = (
        Tables(spark, sf_dir)
        .events.groupBy(F.concat(F.lit("media/"), eid % 700, ending).alias("path"))
        .agg(F.max("event_id").alias("length"))
    )
    return prefer_extension(files, ["mp4", "avi"])


@query(
    "parse_source_name",
    "WITH n AS (SELECT event_id, 'out/PRED_' || CASE WHEN event_id % 2 = 0 THEN 'mmew_apex-au' ELSE 'gazefollow-vlm' END || "
    "CASE event_id % 4 WHEN 0 THEN '_test' WHEN 1 THEN '_val' WHEN 2 THEN '_extra' ELSE '' END || '.jsonl' AS path, event_id % 4 AS c FROM events) "
    "SELECT event_id, CASE c WHEN 0 THEN 'mmew_apex-au' WHEN 1 THEN 'gazefollow-vlm' WHEN 2 THEN 'mmew_apex-au_extra' ELSE 'gazefollow-vlm' END AS task, "
    "CASE c WHEN 1 THEN 'val' ELSE 'test' END AS split, CASE c WHEN 0 THEN 'val' WHEN 2 THEN 'test' ELSE 'validation' END AS stored FROM n",
)
def parse_source_name_query(spark, sf_dir):
    eid = F.col("event_id")
    key = F.when(eid % 2 == 0, "mmew_apex-au").otherwise("gazefollow-vlm")
    ending = F.when(eid % 4 == 0, "_test").when(eid % 4 == 1, "_val").when(eid % 4 == 2, "_extra").otherwise("")
    path = F.concat(F.lit("out/PRED_"), key, ending, F.lit(".jsonl"))
    task, split = parse_source_name(path)
    rows = Tables(spark, sf_dir).events.select("event_id", task.alias("task"), split.alias("split"))
    return rows.withColumn("stored", resolve_split(F.col("task"), F.col("split")))

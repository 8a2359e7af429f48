"""Speaker timelines and diarisation error over events read as speech segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import timeline as tl
from tallyframe.metrics.diarization import diarization_error
from tallyframe.operators.intervals import bin_timeline, segments_in_windows, speaker_letters
from tallyframe.queries.base import FRAMES, Tables, frames, query, scores, unpivot


def _segments(rows, shift: float = 0.0, merge: bool = False):
    """A month squeezed to eleven minutes: each event is a segment of value/5 seconds."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    start = F.floor(micros / 4_000_000).cast("double") / 1000 + shift
    who = F.col("event_type")
    who = F.when(who == "error", "view").otherwise(who) if merge else who
    return rows.select(
        "clip",
        F.col("frame").alias("seq"),
        start.alias("start"),
        (start + F.col("value") / 5).alias("end"),
        who.alias("speaker"),
    )


def _clips(t: Tables):
    return t.events.groupBy(F.col("user_id").alias("clip")).agg(F.lit(645.5).alias("duration"))


def _seg_sql(name: str, shift: str = "0.0", merge: bool = False) -> str:
    who = "CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END" if merge else "event_type"
    start = f"CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS BIGINT) // 4000000 / 1000.0 + {shift}"
    return (
        f"{name}_seg AS (SELECT clip, frame AS seq, CAST({start} AS DOUBLE) AS s, CAST({start} AS DOUBLE) + value / 5 AS e, {who} AS who FROM frames), "
        f"{name}_in AS (SELECT clip, w, seq, s, who, greatest(s, w) - w AS cs, least(e, w + 30) - w AS ce FROM {name}_seg, wins WHERE least(e, w + 30) > greatest(s, w)), "
        f"{name}_act AS (SELECT DISTINCT clip, w, b, who FROM {name}_in, bins WHERE least(ce, (b + 1) * 0.5::DOUBLE) - greatest(cs, b * 0.5::DOUBLE) > 0.25::DOUBLE), "
        f"{name}_ok AS (SELECT clip, w FROM {name}_act GROUP BY clip, w HAVING count(DISTINCT b) >= 6)"
    )


BASE = (
    f"WITH RECURSIVE {FRAMES}, wins AS (SELECT unnest(range(0, 645 - 30 + 1, 15)) AS w), "
    "bins AS (SELECT unnest(range(0, 60)) AS b)"
)
LETTERS = (
    "first AS (SELECT clip, w, who, min(struct_pack(a := cs, b := s, c := seq)) AS f FROM gt_in GROUP BY clip, w, who), "
    "letters AS (SELECT clip, w, who, chr(CAST(64 + row_number() OVER (PARTITION BY clip, w ORDER BY f) AS INTEGER)) AS letter FROM first)"
)


@query(
    "speaker_rank",
    f"{BASE}, {_seg_sql('gt')}, {LETTERS} SELECT clip, CAST(w AS INTEGER) AS win_start, who AS speaker, letter FROM letters",
)
def speaker_rank(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return speaker_letters(segments_in_windows(_segments(frames(t)), _clips(t)))


@query(
    "bin_timeline",
    f"{BASE}, {_seg_sql('gt')}, {LETTERS}, lab AS (SELECT clip, w, b, string_agg(letter, '' ORDER BY letter) AS l FROM gt_act JOIN letters USING (clip, w, who) GROUP BY clip, w, b), "
    "n AS (SELECT clip, w, count(*) AS num FROM letters GROUP BY clip, w), "
    "allb AS (SELECT clip, w, b, coalesce(l, '-') AS l FROM gt_ok CROSS JOIN bins LEFT JOIN lab USING (clip, w, b)) "
    "SELECT clip, CAST(w AS INTEGER) AS win_start, string_agg(l, ',' ORDER BY b) AS timeline, max(num) AS num_speakers, "
    "count(*) FILTER (WHERE l <> '-') AS active_bins FROM allb JOIN n USING (clip, w) GROUP BY clip, w",
)
def bin_timeline_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return bin_timeline(_segments(frames(t)), _clips(t)).select(
        "clip",
        "win_start",
        F.array_join("timeline", ",").alias("timeline"),
        "num_speakers",
        F.col("active_bins").cast("long").alias("active_bins"),
    )


def _islands(name: str) -> str:
    return (
        f"{name}_isl AS (SELECT clip, w, who, min(b) AS s, max(b) + 1 AS e FROM (SELECT *, b - row_number() OVER (PARTITION BY clip, w, who ORDER BY b) AS g "
        f"FROM {name}_act SEMI JOIN pairs USING (clip, w)) GROUP BY clip, w, who, g)"
    )


DER = (
    f"{BASE}, {_seg_sql('gt')}, {_seg_sql('pr', '0.35', True)}, pairs AS (SELECT clip, w FROM gt_ok JOIN pr_ok USING (clip, w)), "
    f"{_islands('gt')}, {_islands('pr')}, "
    "ov AS (SELECT a.clip, a.w, a.who AS gw, a.s AS gs, a.e AS ge, p.who AS pw, p.s AS ps, p.e AS pe, greatest(0, least(a.e, p.e) - greatest(a.s, p.s)) AS o "
    "FROM gt_isl a JOIN pr_isl p ON a.clip = p.clip AND a.w = p.w), "
    "ms AS (SELECT clip, w, sum(m) AS ms FROM (SELECT clip, w, greatest(0, ge - gs - sum(o)) AS m FROM ov GROUP BY clip, w, gw, gs, ge) GROUP BY clip, w), "
    "fa AS (SELECT clip, w, sum(m) AS fa FROM (SELECT clip, w, greatest(0, pe - ps - sum(o)) AS m FROM ov GROUP BY clip, w, pw, ps, pe) GROUP BY clip, w), "
    "ref AS (SELECT clip, w, sum(e - s) AS ref FROM gt_isl GROUP BY clip, w), hyp AS (SELECT clip, w, sum(e - s) AS hyp FROM pr_isl GROUP BY clip, w), "
    "mat AS (SELECT clip, w, dense_rank() OVER (PARTITION BY clip, w ORDER BY gw) AS i, dense_rank() OVER (PARTITION BY clip, w ORDER BY pw) AS j, sum(o) AS o FROM ov GROUP BY clip, w, gw, pw), "
    "dp AS (SELECT clip, w, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS total FROM pairs "
    "UNION SELECT d.clip, d.w, d.i + 1, d.mask | (CASE WHEN c.j = 0 THEN 0 ELSE 1 << CAST(c.j AS INTEGER) END), CAST(d.total + c.o AS BIGINT) FROM dp d "
    "JOIN (SELECT clip, w, i, j, o FROM mat UNION ALL SELECT DISTINCT clip, w, i, 0, 0 FROM mat) c ON c.clip = d.clip AND c.w = d.w AND c.i = d.i + 1 "
    "WHERE c.j = 0 OR (d.mask & (1 << CAST(c.j AS INTEGER))) = 0), "
    "ok AS (SELECT clip, w, max(total) AS ok FROM dp GROUP BY clip, w), "
    "parts AS (SELECT clip, ms / ref AS missed, fa / ref AS fa, greatest(0, hyp - fa - ok) / ref AS conf, (ms + fa + greatest(0, hyp - fa - ok)) / ref AS der "
    "FROM ref JOIN hyp USING (clip, w) JOIN ms USING (clip, w) JOIN fa USING (clip, w) JOIN ok USING (clip, w)), "
    "wide AS (SELECT clip, count(*) AS n, avg(missed) AS missed, avg(fa) AS fa, avg(conf) AS conf, avg(der) AS der FROM parts GROUP BY clip) "
)


def _timelines(t: Tables):
    rows = frames(t)
    gt = bin_timeline(_segments(rows), _clips(t)).select("clip", "win_start", F.col("timeline").alias("gt"))
    pred = bin_timeline(_segments(rows, 0.35, True), _clips(t)).select(
        "clip", "win_start", F.col("timeline").alias("pred")
    )
    return gt.join(pred, ["clip", "win_start"])


@query(
    "der",
    DER + unpivot("wide", ["clip"], {"der": "der", "missed_speech": "missed", "false_alarm": "fa", "speaker_confusion": "conf"}),
)
def der(spark, sf_dir):
    return scores(diarization_error(_timelines(Tables(spark, sf_dir)), ["clip"]))


@query(
    "single_speaker_baseline",
    f"{BASE}, {_seg_sql('gt')}, lone AS (SELECT clip, w, (count(DISTINCT b) + 0.0) AS speech_bins, count(*) AS ref, "
    "max(share) AS best FROM (SELECT *, count(*) OVER (PARTITION BY clip, w, who) AS share FROM gt_act SEMI JOIN gt_ok USING (clip, w)) GROUP BY clip, w) "
    "SELECT clip, CAST(w AS INTEGER) AS win_start, CAST(ref AS BIGINT) AS reference_bins, CAST(best AS BIGINT) AS matched_bins FROM lone",
)
def single_speaker_baseline(spark, sf_dir):
    from tallyframe.plans.baselines import single_speaker

    t = Tables(spark, sf_dir)
    rows = bin_timeline(_segments(frames(t)), _clips(t)).withColumn("pred", single_speaker(F.col("timeline")))
    rows = rows.withColumns({"gt_seg": tl.segments(F.col("timeline")), "pred_seg": tl.segments(F.col("pred"))})
    return rows.select(
        "clip",
        "win_start",
        tl.total_length(F.flatten("gt_seg")).cast("long").alias("reference_bins"),
        tl.best_assignment(tl.overlap_matrix(F.col("gt_seg"), F.col("pred_seg"))).cast("long").alias("matched_bins"),
    )

"""Every dataset recipe on inputs of its shape derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators.ordered import row_index
from tallyframe.queries.base import FRAMES, Tables, frames, query
from tallyframe.queries.clips import WINDOWS
from tallyframe.queries.speech import BASE, LETTERS, _clips, _seg_sql, _segments
from tallyframe.recipes import faces, gaze, scenes, speech
from tallyframe.recipes.common import counting_skips



def eid():
    return F.col("event_id")


def shown(df, *extra: str):
    """Sample id, split, the user turn and the answer."""
    turn = lambda i: F.col("messages")[i]["content"]
    return df.select("sample_id", "split", turn(1).alias("user_text"), turn(2).alias("answer"), *extra)


def _unit(factor: int, size: int = 1000):
    return (eid() * factor % size) / 1000


def _u(factor: int, size: int = 1000) -> str:
    return f"(event_id * {factor} % {size}) / 1000.0"


def _r(expr: str) -> str:
    return f"CAST(round_even(CAST(({expr}) * 1000 AS DOUBLE), 0) AS INTEGER)"


GAZE_SQL = (
    "pics AS (SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 40), "
    "l AS (SELECT 'img/' || user_id || '.jpg' AS path, CAST(event_id % 4 AS VARCHAR) AS person, event_id, "
    f"'[' || {_r(_u(13, 500))} || ', ' || {_r(_u(17, 500))} || ', ' || {_r(_u(13, 500) + ' + ' + _u(29, 400))} || ', ' || {_r(_u(17, 500) + ' + ' + _u(31, 400))} || ']' AS box, "
    f"'[' || {_r(_u(37, 1001))} || ', ' || {_r(_u(91, 1001))} || ']' AS point FROM events JOIN pics USING (user_id))"
)
GAZE_USER = "'<image>' || chr(10) || 'Person''s head bounding box: ' || box || chr(10) || 'Where is this person looking?'"


def _gaze(t: Tables, split: str):
    lines = t.events.select(
        F.format_string("img/%d.jpg", "user_id").alias("path"),
        F.concat_ws("-", eid() % 4, eid() % 10).alias("idx"),
        eid().alias("line_no"),
        _unit(13, 500).alias("x"),
        _unit(17, 500).alias("y"),
        _unit(29, 400).alias("w"),
        _unit(31, 400).alias("h"),
        _unit(37, 1001).alias("gaze_x"),
        _unit(91, 1001).alias("gaze_y"),
    )
    listing = t.events.groupBy("user_id").agg(F.max("value").alias("v")).where("v > 40")
    return shown(gaze.gazefollow(lines, split, listing.select(F.format_string("img/%d.jpg", "user_id").alias("path"))))


@query(
    "recipe_gazefollow_train",
    f"WITH {GAZE_SQL} SELECT path || '|' || event_id AS sample_id, 'train' AS split, {GAZE_USER} AS user_text, '{{\"gaze_point\": ' || point || '}}' AS answer FROM l",
)
def recipe_gazefollow_train(spark, sf_dir):
    return _gaze(Tables(spark, sf_dir), "train")


@query(
    "recipe_gazefollow_validation",
    f"WITH {GAZE_SQL}, g AS (SELECT path, person, arg_min(box, event_id) AS box, string_agg(point, ', ' ORDER BY event_id) AS points FROM l GROUP BY path, person) "
    f"SELECT path || '|' || person AS sample_id, 'validation' AS split, {GAZE_USER} AS user_text, '{{\"gaze_points\": [' || points || ']}}' AS answer FROM g",
)
def recipe_gazefollow_validation(spark, sf_dir):
    return _gaze(Tables(spark, sf_dir), "validation")


def _n(expr: str, size: int, clamp: bool = True) -> str:
    whole = f"CAST(round_even(CAST({expr} AS DOUBLE) / {size} * 1000, 0) AS INTEGER)"
    return f"greatest(0, least(1000, {whole}))" if clamp else whole


TARGET_SQL = (
    f"{FRAMES}, e AS (SELECT 's' || (clip % 7) AS show_name, clip, frame, event_id, "
    f"'[' || {_n('event_id * 13 % 640', 640)} || ', ' || {_n('event_id * 17 % 480', 480)} || ', ' || {_n('event_id * 29 % 640', 640)} || ', ' || {_n('event_id * 31 % 480', 480)} || ']' AS box, "
    f"value < 5 AS outside, {_n('event_id * 37 % 640', 640)} AS px, {_n('event_id * 91 % 480', 480)} AS py FROM frames), "
    "fold AS (SELECT clip, list_reduce(list([CAST(frame AS DOUBLE), CAST(px AS DOUBLE), CAST(py AS DOUBLE)] ORDER BY frame), "
    "lambda acc, x: acc || CASE WHEN len(list_filter(acc, lambda y: sqrt((y[2] - x[2]) * (y[2] - x[2]) + (y[3] - x[3]) * (y[3] - x[3])) < 25)) > 0 THEN [] ELSE [x] END, "
    "CAST([] AS DOUBLE[][])) AS kept FROM e WHERE NOT outside GROUP BY clip), "
    "apart AS (SELECT clip, CAST(unnest(kept)[1] AS BIGINT) AS frame FROM fold UNION ALL SELECT clip, min(frame) FROM e WHERE outside GROUP BY clip), "
    "five AS (SELECT clip, frame FROM (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY md5('42|' || show_name || '|' || clip || '|q|' || frame), frame) AS k FROM e) WHERE k <= 5), "
    "out AS (SELECT *, show_name || '|' || clip || '|q|' || frame AS sample_id, CASE WHEN outside THEN '{\"out_of_frame\": true}' ELSE '{\"gaze_point\": [' || px || ', ' || py || '], \"label\": \"gaze target\"}' END AS answer FROM e)"
)


def _target(t: Tables, variant: str):
    size = lambda f, s: (eid() * f % s).cast("int")
    outside = F.col("value") < 5
    rows = frames(t)
    entries = rows.select(
        F.concat(F.lit("s"), F.col("clip") % 7).alias("show"),
        "clip",
        F.lit("q").alias("seq"),
        F.col("frame").alias("line_no"),
        eid().cast("string").alias("frame"),
        size(13, 640).alias("x1"),
        size(17, 480).alias("y1"),
        size(29, 640).alias("x2"),
        size(31, 480).alias("y2"),
        F.when(outside, -1).otherwise(size(37, 640)).alias("gx"),
        F.when(outside, -1).otherwise(size(91, 480)).alias("gy"),
    )
    sizes = entries.select("show", "clip").distinct().withColumns({"width": F.lit(640), "height": F.lit(480)})
    return shown(gaze.videoattentiontarget(entries, sizes, variant, "test"))


@query(
    "recipe_vat_frame",
    f"WITH {TARGET_SQL} SELECT sample_id, 'test' AS split, '<image>' || chr(10) || 'Person head bounding box: ' || box || chr(10) || 'Where is this person looking?' AS user_text, answer FROM out JOIN apart USING (clip, frame)",
)
def recipe_vat_frame(spark, sf_dir):
    return _target(Tables(spark, sf_dir), "frame")


@query(
    "recipe_vat_video",
    f"WITH {TARGET_SQL} SELECT sample_id, 'test' AS split, '<video>' || chr(10) || 'Person head bounding box: ' || box || chr(10) || 'At t=' || printf('%.2f', CAST(frame AS DOUBLE) / 30) || 's, where is this person looking?' AS user_text, answer FROM out JOIN five USING (clip, frame)",
)
def recipe_vat_video(spark, sf_dir):
    return _target(Tables(spark, sf_dir), "video")


def _face_sql(factors: tuple[int, ...]) -> str:
    sizes = (480, 320, 480, 320)
    return "'[' || " + " || ', ' || ".join(_n(f"event_id * {f} % {s}", s, False) for f, s in zip(factors, sizes)) + " || ']'"


SHARED_SQL = (
    f"{FRAMES}, ann AS (SELECT clip, frame, event_id, {_face_sql((13, 17, 29, 31))} AS target, "
    f"'Person 1: ' || {_face_sql((37, 41, 43, 47))} || CASE WHEN value > 20 THEN chr(10) || 'Person 2: ' || {_face_sql((53, 59, 61, 67))} ELSE '' END AS people "
    "FROM frames WHERE event_type IN ('click', 'error')), "
    "npos AS (SELECT clip, count(*) AS n, max(frame) AS last FROM ann GROUP BY clip), "
    "bare AS (SELECT f.clip, f.frame, row_number() OVER (PARTITION BY f.clip ORDER BY md5('42|' || f.clip || '|' || f.frame), f.clip, f.frame) AS k FROM frames f WHERE event_type NOT IN ('click', 'error')), "
    "neg AS (SELECT b.clip, b.frame, (SELECT min(a.frame) FROM ann a WHERE a.clip = b.clip AND a.frame >= b.frame) AS nxt, last FROM bare b JOIN npos USING (clip) WHERE k <= n), "
    "both_ AS (SELECT clip, frame, people, 'true' AS shared FROM ann UNION ALL SELECT neg.clip, neg.frame, a.people, 'false' FROM neg JOIN ann a ON a.clip = neg.clip AND a.frame = coalesce(nxt, last))"
)
PRESENT = "'<image>' || chr(10) || 'The following people are present in the image:' || chr(10) || people || chr(10) || "


def _shared(t: Tables, task: str):
    def box(factors):
        return F.array(*[eid() * f % s for f, s in zip(factors, (480, 320, 480, 320))])

    rows = frames(t)
    two = F.array(box((37, 41, 43, 47)), box((53, 59, 61, 67)))
    events = rows.where(F.col("event_type").isin("click", "error")).select(
        F.col("clip").alias("video"),
        "frame",
        eid().alias("line_no"),
        box((13, 17, 29, 31)).alias("target"),
        F.when(F.col("value") > 20, two).otherwise(F.slice(two, 1, 1)).alias("faces"),
    )
    stored = rows.select(F.col("clip").alias("video"), "frame", F.concat_ws("/", "clip", "frame").alias("path"))
    return shown(gaze.videocoattention(events, stored, task, "test"))


@query(
    "recipe_coattention_detection",
    f"WITH {SHARED_SQL} SELECT clip || '|' || frame AS sample_id, 'test' AS split, {PRESENT} 'Are these people sharing a common visual attention target?' AS user_text, '{{\"co_attention\": ' || shared || '}}' AS answer FROM both_",
)
def recipe_coattention_detection(spark, sf_dir):
    return _shared(Tables(spark, sf_dir), "detection")


@query(
    "recipe_coattention_localization",
    f"WITH {SHARED_SQL} SELECT clip || '|' || frame || '|' || event_id AS sample_id, 'test' AS split, {PRESENT} 'Where is the shared visual attention target?' AS user_text, '{{\"bbox\": ' || target || '}}' AS answer FROM ann",
)
def recipe_coattention_localization(spark, sf_dir):
    return _shared(Tables(spark, sf_dir), "localization")


LABEL8 = "['Neutral', 'Anger', 'Disgust', 'Fear', 'Happiness', 'Sadness', 'Surprise', 'Other']"
UNITS12 = "['AU1', 'AU2', 'AU4', 'AU6', 'AU7', 'AU10', 'AU12', 'AU15', 'AU23', 'AU24', 'AU25', 'AU26']"
VAL_SQL = "(event_id * 37 % 221 - 110) / 100.0"
ARO_SQL = "(event_id * 91 % 221 - 110) / 100.0"
AU_SQL = (
    "(SELECT string_agg('\"' || u || '\"', ', ' ORDER BY i) FROM (SELECT unnest(" + UNITS12 + ") AS u, unnest(range(0, 12)) AS i) WHERE (event_id >> CAST(i AS INTEGER)) % 2 = 1)"
)
FACE_SQL = (
    f"{FRAMES}, {WINDOWS.format(stride=16)}, vids AS (SELECT clip FROM frames GROUP BY clip HAVING max(value) > 40), "
    "w AS (SELECT win.*, clip || '_' || start AS sample_id, event_id % 9 - 1 AS expr FROM win SEMI JOIN vids USING (clip))"
)


def _face_frames(t: Tables, kind: str):
    rows = frames(t)
    bits = F.array(*[F.shiftright(eid(), i) % 2 for i in range(12)]).cast("array<int>")
    value = {
        "expr": (eid() % 9 - 1).cast("int"),
        "va": F.array((eid() * 37 % 221 - 110) / 100, (eid() * 91 % 221 - 110) / 100),
        "au": F.when(eid() % 5 == 0, F.transform(bits, lambda _: F.lit(-1))).otherwise(bits),
    }[kind]
    return rows.select("clip", "frame", value.alias("value"))


def _videos(t: Tables):
    return t.events.groupBy(F.col("user_id").alias("clip")).agg(F.max("value").alias("v")).where("v > 40").select("clip")


def _face(t: Tables, kind: str):
    return shown(faces.affwild2(_face_frames(t, kind), kind, "val", _videos(t)))


def _face_user(kind: str) -> str:
    return "'" + faces.FRAME_USER[kind].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    "recipe_affwild2_expr",
    f"WITH {FACE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY clip, expr ORDER BY frame) AS k FROM w WHERE expr <> -1) "
    f"SELECT sample_id, 'val' AS split, {_face_user('expr')} AS user_text, '{{\"label\": \"' || {LABEL8}[expr + 1] || '\"}}' AS answer FROM r WHERE k <= 5",
)
def recipe_affwild2_expr(spark, sf_dir):
    return _face(Tables(spark, sf_dir), "expr")


@query(
    "recipe_affwild2_va",
    f"WITH {FACE_SQL}, p AS (SELECT *, {VAL_SQL} AS v, {ARO_SQL} AS a FROM w), "
    "fold AS (SELECT clip, list_reduce(list([CAST(frame AS DOUBLE), CAST(v AS DOUBLE), CAST(a AS DOUBLE)] ORDER BY frame), "
    "lambda acc, x: acc || CASE WHEN len(list_filter(acc, lambda y: sqrt((y[2] - x[2]) * (y[2] - x[2]) + (y[3] - x[3]) * (y[3] - x[3])) < 0.05)) > 0 THEN [] ELSE [x] END, "
    "CAST([] AS DOUBLE[][])) AS kept FROM p WHERE abs(v) <= 1 AND abs(a) <= 1 GROUP BY clip), k AS (SELECT clip, CAST(unnest(kept)[1] AS BIGINT) AS frame FROM fold) "
    f"SELECT sample_id, 'val' AS split, {_face_user('va')} AS user_text, '{{\"valence\": ' || CAST(v AS DOUBLE) || ', \"arousal\": ' || CAST(a AS DOUBLE) || '}}' AS answer FROM p JOIN k USING (clip, frame)",
)
def recipe_affwild2_va(spark, sf_dir):
    return _face(Tables(spark, sf_dir), "va")


@query(
    "recipe_affwild2_au",
    f"WITH {FACE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY clip, event_id % 4096 ORDER BY frame) AS k FROM w WHERE event_id % 5 <> 0) "
    f"SELECT sample_id, 'val' AS split, {_face_user('au')} AS user_text, '{{\"action_units\": [' || coalesce({AU_SQL}, '') || ']}}' AS answer FROM r WHERE k = 1",
)
def recipe_affwild2_au(spark, sf_dir):
    return _face(Tables(spark, sf_dir), "au")


@query(
    "recipe_affwild2_think",
    f"WITH {FACE_SQL}, tr AS (SELECT DISTINCT clip FROM frames WHERE clip < (SELECT (min(clip) + max(clip)) / 2 FROM frames)), "
    "lastt AS (SELECT clip FROM tr ORDER BY clip DESC LIMIT 20), "
    "sp AS (SELECT clip, CASE WHEN clip IN (SELECT clip FROM tr) AND clip NOT IN (SELECT clip FROM lastt) THEN 'train' ELSE 'val' END AS split FROM (SELECT DISTINCT clip FROM frames)), "
    f"p AS (SELECT *, CAST({VAL_SQL} AS DOUBLE) AS v, CAST({ARO_SQL} AS DOUBLE) AS a FROM w), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY clip, expr ORDER BY frame) AS k FROM p WHERE expr <> -1 AND abs(v) <= 1 AND abs(a) <= 1 AND event_id % 5 <> 0) "
    f"SELECT sample_id, split, {_face_user('expr_think')} AS user_text, '<think>' || chr(10) || '{{\"valence\": ' || v || ', \"arousal\": ' || a || '}}' || chr(10) || "
    f"'{{\"action_units\": [' || coalesce({AU_SQL}, '') || ']}}' || chr(10) || '</think>' || chr(10) || '{{\"label\": \"' || {LABEL8}[expr + 1] || '\"}}' AS answer FROM r JOIN sp USING (clip) WHERE k <= 5",
)
def recipe_affwild2_think(spark, sf_dir):
    t = Tables(spark, sf_dir)
    middle = t.events.agg((F.min("user_id") + F.max("user_id")) / 2).scalar()
    kinds = {
        k: {
            "train": _face_frames(t, k).where(F.col("clip") < middle),
            "val": _face_frames(t, k).where(F.col("clip") >= middle),
        }
        for k in ("expr", "va", "au")
    }
    return shown(faces.affwild2_think(kinds, _videos(t)))


MICRO = "['happiness', 'surprise', 'disgust', 'fear', 'sadness', 'anger', 'others']"
SHEET = (
    f"sheet AS (SELECT o_orderkey AS filename, o_custkey % 33 AS subject, o_orderkey % 7 + 1 AS apex, {MICRO}[CAST(floor(o_totalprice) AS INTEGER) % 7 + 1] AS emotion, "
    "CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 20) || '+' || (o_orderkey % 9) END AS au FROM orders), "
    "good AS (SELECT *, CASE WHEN subject <= 24 THEN 'train' ELSE 'val' END AS split FROM sheet WHERE subject BETWEEN 1 AND 30), "
    "fr AS (SELECT DISTINCT l_orderkey AS filename, l_linenumber AS number FROM lineitem)"
)


def _micro(t: Tables, task: str):
    key = F.col("o_orderkey")
    emotion = F.array(*[F.lit(e) for e in faces.MICRO_EMOTIONS])
    sheet = t.orders.select(
        key.alias("filename"),
        (F.col("o_custkey") % 33).alias("subject"),
        F.lit(1).cast("long").alias("onset"),
        (key % 7 + 1).alias("apex"),
        F.lit(7).cast("long").alias("offset"),
        F.when(key % 3 > 0, F.concat_ws("+", key % 20, key % 9)).alias("au_raw"),
        F.get(emotion, (F.floor("o_totalprice").cast("int") % 7)).alias("emotion"),
    )
    stored = t.lineitem.select(
        F.col("l_orderkey").alias("filename"), F.col("l_linenumber").cast("long").alias("number")
    ).distinct()
    stored = stored.withColumn("path", F.concat_ws("/", "filename", "number"))
    stills = t.customer.select(
        (F.col("c_custkey") % 33).alias("subject"),
        F.get(F.array(*[F.lit(e) for e in faces.MACRO_EMOTIONS]), (F.col("c_nationkey") % 6)).alias("emotion"),
        F.col("c_name").alias("path"),
    )
    return shown(faces.mmew(sheet, task, stored, stills))


@query(
    "recipe_mmew_apex_emotion",
    f"WITH {SHEET} SELECT filename || '/' || apex AS sample_id, split, '<image>' || chr(10) || 'What emotion is expressed in this face image?' AS user_text, '{{\"emotion\": \"' || emotion || '\"}}' AS answer "
    "FROM good JOIN fr ON fr.filename = good.filename AND number = apex UNION ALL "
    "SELECT c_name, CASE WHEN c_custkey % 33 <= 24 THEN 'train' ELSE 'val' END, '<image>' || chr(10) || 'What emotion is expressed in this face image?', "
    "'{\"emotion\": \"' || ['anger', 'disgust', 'fear', 'happiness', 'sadness', 'surprise'][c_nationkey % 6 + 1] || '\"}' FROM customer WHERE c_custkey % 33 BETWEEN 1 AND 30".replace("SELECT filename || '/'", "SELECT good.filename || '/'"),
)
def recipe_mmew_apex_emotion(spark, sf_dir):
    return _micro(Tables(spark, sf_dir), "apex_emotion")


@query(
    "recipe_mmew_apex_au",
    f"WITH {SHEET} SELECT good.filename || '/' || apex AS sample_id, split, '<image>' || chr(10) || 'Which facial action units are active in this apex frame?' AS user_text, "
    "'{\"action_units\": [' || CASE WHEN au IS NULL THEN '' ELSE '\"AU' || replace(au, '+', '\", \"AU') || '\"' END || ']}' AS answer FROM good JOIN fr ON fr.filename = good.filename AND number = apex",
)
def recipe_mmew_apex_au(spark, sf_dir):
    return _micro(Tables(spark, sf_dir), "apex_au")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    "recipe_mmew_clip_think",
    f"WITH {SHEET}, n AS (SELECT filename FROM fr WHERE number BETWEEN 1 AND 7 GROUP BY filename HAVING count(*) >= 4) "
    "SELECT CAST(filename AS VARCHAR) AS sample_id, split, '<video>' || chr(10) || 'What micro-expression emotion is shown in this clip?' AS user_text, "
    f"'<think>' || chr(10) || {_sql_text(faces.SPOTTING + faces.UNITS_LINE)} || coalesce('AU' || au, 'none') || '.' || chr(10) || {_sql_text(faces.DEDUCTION)} || emotion || '.' || chr(10) || '</think>' || chr(10) || '{{\"emotion\": \"' || emotion || '\"}}' AS answer FROM good SEMI JOIN n USING (filename)",
)
def recipe_mmew_clip_think(spark, sf_dir):
    return _micro(Tables(spark, sf_dir), "clip_emotion_think")


@query(
    "recipe_mmew_clip_emotion",
    f"WITH {SHEET}, n AS (SELECT filename FROM fr WHERE number BETWEEN 1 AND 7 GROUP BY filename HAVING count(*) >= 4) "
    "SELECT CAST(filename AS VARCHAR) AS sample_id, split, '<video>' || chr(10) || 'What micro-expression emotion is shown in this clip?' AS user_text, "
    "'{\"emotion\": \"' || emotion || '\"}' AS answer FROM good SEMI JOIN n USING (filename)",
)
def recipe_mmew_clip_emotion(spark, sf_dir):
    return _micro(Tables(spark, sf_dir), "clip_emotion")


@query(
    "recipe_meview",
    "WITH s AS (SELECT o_orderkey, o_custkey % 30 AS subject, o_orderkey % 40 AS clip_id, o_orderkey % 50 + 1 AS onset, o_orderkey % 50 + 1 + o_custkey % 20 AS offs, "
    "CASE o_orderstatus WHEN 'F' THEN 'contempt/disgust' WHEN 'O' THEN 'happiness' ELSE 'bored' END AS raw FROM orders), "
    "k AS (SELECT *, 'sub' || printf('%02d', subject) || '-' || clip_id || '.mp4' AS path FROM s WHERE raw <> 'bored'), "
    "c AS (SELECT DISTINCT 'sub' || printf('%02d', c_custkey % 30) || '-' || (c_custkey % 40) || '.mp4' AS path FROM customer) "
    "SELECT path || '|' || onset AS sample_id, 'test' AS split, '<video>' || chr(10) || 'What concealed emotion is shown in this micro-expression clip?' AS user_text, "
    "'{\"emotion\": \"' || CASE raw WHEN 'happiness' THEN 'happy' ELSE 'disgust' END || '\"}' AS answer, "
    "round((greatest(1, onset - 5) - 1) / 30, 6) AS start_sec, round(least(60, offs + 5) / 30, 6) AS end_sec FROM k JOIN c USING (path)",
)
def recipe_meview(spark, sf_dir):
    t = Tables(spark, sf_dir)
    key = F.col("o_orderkey")
    raw = F.when(F.col("o_orderstatus") == "F", " Contempt/Disgust").when(F.col("o_orderstatus") == "O", "happiness")
    sheet = t.orders.select(
        (F.col("o_custkey") % 30).alias("subject"),
        (key % 40).alias("clip_id"),
        (key % 50 + 1).alias("onset"),
        (key % 50 + 1 + F.col("o_custkey") % 20).alias("offset"),
        raw.otherwise("bored").alias("emotion"),
    )
    name = F.format_string("sub%02d-%d.mp4", F.col("c_custkey") % 30, F.col("c_custkey") % 40)
    clips = t.customer.select(name.alias("path")).distinct().withColumn("total_frames", F.lit(60))
    made = shown(faces.meview(sheet, clips), "start_sec", "end_sec")
    return made.withColumns({c: F.round(c, 6) for c in ("start_sec", "end_sec")})


EMOTIC_SQL = (
    "p AS (SELECT event_id, user_id, unnest([0, 1]) AS j, value, event_type FROM events), "
    f"q AS (SELECT *, 'mscoco/' || event_id || '.jpg' AS path, '[' || {_n('event_id * 13 % 640', 640)} || ', ' || {_n('event_id * 17 % 480', 480)} || ', ' || {_n('(event_id * 29 + j) % 640', 640)} || ', ' || {_n('event_id * 31 % 480', 480)} || ']' AS box, "
    "CASE WHEN j = 0 THEN 'male teenager' ELSE 'female person' END AS who FROM p)"
)
EMOTIC_USER = "'<image>' || chr(10) || 'Bounding box: ' || box || chr(10) || '{}' || who || ' in this bounding box?'"


def _emotic(t: Tables, task: str, split: str):
    def person(j: int):
        box = F.array(eid() * 13 % 640, eid() * 17 % 480, (eid() * 29 + j) % 640, eid() * 31 % 480).cast("array<int>")
        words = F.array(F.initcap("event_type"), F.lit("Peace"))
        first = F.when(F.col("value") > 10, words).otherwise(F.array().cast("array<string>"))
        categories = F.array(first, F.array(F.lit("Doubt/Confusion")))
        number = F.when(F.col("value") < 3, F.lit(float("nan"))).otherwise(F.floor(F.col("value") % 9 + 1).cast("double"))
        vad = F.struct(number.alias("valence"), F.lit(4.0).alias("arousal"), (eid() % 9 + 1).cast("double").alias("dominance"))
        fixed = F.struct(F.lit(5.0).alias("valence"), F.lit(5.0).alias("arousal"), F.lit(6.0).alias("dominance"))
        return F.struct(
            box.alias("body_bbox"),
            F.lit("Male" if j == 0 else "Female").alias("gender"),
            F.lit("Teenager" if j == 0 else "Unknown").alias("age"),
            categories.alias("categories"),
            F.array(vad, fixed).alias("continuous"),
        )

    images = t.events.select(
        F.lit("mscoco").alias("folder"),
        F.concat(eid(), F.lit(".jpg")).alias("filename"),
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
        F.array(person(0), person(1)).cast(scenes.PERSON).alias("person"),
    )
    return shown(scenes.emotic(images, task, split))


@query(
    "recipe_emotic_discrete",
    f"WITH {EMOTIC_SQL} SELECT path || '|' || j AS sample_id, 'val' AS split, {EMOTIC_USER.format('What are the emotions of the ')} AS user_text, "
    "'{\"emotions_per_annotator\": [' || CASE WHEN value > 10 THEN '[\"' || upper(event_type[1]) || event_type[2:] || '\", \"Peace\"], ' ELSE '' END || '[\"Doubt/Confusion\"]]}' AS answer FROM q",
)
def recipe_emotic_discrete(spark, sf_dir):
    return _emotic(Tables(spark, sf_dir), "discrete", "val")


@query(
    "recipe_emotic_vad",
    f"WITH {EMOTIC_SQL} SELECT path || '|' || j AS sample_id, 'train' AS split, {EMOTIC_USER.format('What are the valence, arousal, and dominance scores of the ')} AS user_text, "
    "'{\"valence\": ' || CAST(floor(value % 9 + 1) AS INTEGER) || ', \"arousal\": 4, \"dominance\": ' || (event_id % 9 + 1) || '}' AS answer FROM q WHERE value >= 3",
)
def recipe_emotic_vad(spark, sf_dir):
    return _emotic(Tables(spark, sf_dir), "vad", "train")


def _pisc_box(factors: tuple[int, ...]) -> str:
    sizes = (640, 480, 640, 480)
    return "'[' || " + " || ', ' || ".join(_n(f"o_orderkey * {f} % {s}", s, False) for f, s in zip(factors, sizes)) + " || ']'"


@query(
    "recipe_pisc",
    f"WITH i AS (SELECT o_orderkey, o_custkey, [{_pisc_box((13, 17, 29, 31))}, {_pisc_box((37, 41, 43, 47))}, {_pisc_box((53, 59, 61, 67))}] AS b FROM orders WHERE o_orderstatus = 'F'), "
    "p AS (SELECT o_orderkey, b, 1 AS x, 2 AS y, o_custkey % 6 + 1 AS l FROM i UNION ALL SELECT o_orderkey, b, 3, o_orderkey % 5 + 1, (o_custkey + 1) % 6 + 1 FROM i) "
    "SELECT o_orderkey || '|' || x || ' ' || y AS sample_id, 'test' AS split, '<image>' || chr(10) || 'Two individuals are visible in this image.' || chr(10) || 'Person 1 bounding box: ' || b[x] || chr(10) || "
    "'Person 2 bounding box: ' || b[y] || chr(10) || 'What is the social relationship between Person 1 and Person 2?' AS user_text, "
    "'{\"relationship\": \"' || ['Friends', 'Family', 'Couple', 'Professional', 'Commercial', 'No relation'][l] || '\"}' AS answer FROM p WHERE y <= 3",
)
def recipe_pisc(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def box(factors):
        return F.array(*[key * f % s for f, s in zip(factors, (640, 480, 640, 480))])

    images = orders.select(
        key.alias("id"),
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
        F.array(box((13, 17, 29, 31)), box((37, 41, 43, 47)), box((53, 59, 61, 67))).alias("boxes"),
    )
    pairs = F.create_map(F.lit("1 2"), (cust % 6 + 1).cast("int"), F.concat(F.lit("3 "), key % 5 + 1), ((cust + 1) % 6 + 1).cast("int"))
    ids = orders.where("o_orderstatus = 'F'").select(key.alias("id"))
    return shown(scenes.pisc(images, orders.select(key.alias("id"), pairs.alias("pairs")), ids, "test"))


def _grid224(expr: str) -> str:
    return _n(expr, 224, False)


POINTS_SQL = "list_transform(range(0, 10), lambda i: '  - ' || {names}[CAST(i AS INTEGER) + 1] || ': [' || CAST(round_even(CAST((event_id * {f} + i) % 224 AS DOUBLE) / 224 * 1000, 0) AS INTEGER) || ', ' || CAST(round_even(CAST((event_id + i * 7) % 224 AS DOUBLE) / 224 * 1000, 0) AS INTEGER) || ']')"
KEYPOINTS_SQL = "[" + ", ".join(f"'{k}'" for k in scenes.KEYPOINTS) + "]"


def _contact_box(a: int, b: int, c: int, d: int) -> str:
    # Stored as ymin, ymax, xmin, xmax; written as x1, y1, x2, y2.
    return "'[' || " + " || ', ' || ".join(_grid224(f"event_id * {f} % 224") for f in (c, a, d, b)) + " || ']'"


PROXEMICS_SQL = (
    "WITH both_ AS (SELECT event_id, 'p/' || event_id || '.jpg' AS path FROM events WHERE value > 5), "
    "cut AS (SELECT event_id, path, row_number() OVER (ORDER BY md5('42|' || path)) <= floor(count(*) OVER () * 0.8) AS tr FROM both_) "
    f"SELECT path AS sample_id, CASE WHEN tr THEN 'train' ELSE 'test' END AS split, '<image>' || chr(10) || 'Here are the bounding boxes of the 2 persons:' || chr(10) || 'Person 1 bounding box: ' || {_contact_box(13, 17, 29, 31)} || chr(10) || "
    f"'Person 2 bounding box: ' || {_contact_box(37, 41, 43, 47)} || chr(10) || chr(10) || @skeleton || 'Evaluate which body parts are touching between Person 1 and Person 2.' AS user_text, "
    "'{\"touching\": [' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '\"Hand touch hand\"' ELSE '\"Hand touch shoulder\", \"Hand touch torso\"' END || ']}' AS answer FROM cut"
)
SKELETON_SQL = (
    f"'Person 1 skeleton:' || chr(10) || array_to_string({POINTS_SQL.format(names=KEYPOINTS_SQL, f=3)}, chr(10)) || chr(10) || chr(10) || "
    f"'Person 2 skeleton:' || chr(10) || array_to_string({POINTS_SQL.format(names=KEYPOINTS_SQL, f=5)}, chr(10)) || chr(10) || chr(10)"
)


def _proxemics(t: Tables, skeleton: bool):
    path = F.concat(F.lit("p/"), eid(), F.lit(".jpg"))
    points = lambda f: F.array(*[F.array((eid() * f + i) % 224, (eid() + i * 7) % 224) for i in range(10)])
    vector = F.array((eid() % 3 == 1).cast("int"), (eid() % 3 == 2).cast("int"), *[F.lit(0)] * 3, (eid() % 3 == 2).cast("int"))
    labels = t.events.select(path.alias("path"), vector.alias("contacts"), points(3).alias("points0"), points(5).alias("points1"))
    box = lambda *f: F.array(*[eid() * x % 224 for x in f])
    boxes = t.events.where("value > 5").select(path.alias("path"), box(13, 17, 29, 31).alias("p0"), box(37, 41, 43, 47).alias("p1"))
    return shown(scenes.proxemics(labels, boxes, skeleton))


@query("recipe_proxemics_skeleton", PROXEMICS_SQL.replace("@skeleton", SKELETON_SQL))
def recipe_proxemics_skeleton(spark, sf_dir):
    return _proxemics(Tables(spark, sf_dir), True)


@query("recipe_proxemics_no_skeleton", PROXEMICS_SQL.replace("@skeleton", "''"))
def recipe_proxemics_no_skeleton(spark, sf_dir):
    return _proxemics(Tables(spark, sf_dir), False)


def _trunc(expr: str, size: int) -> str:
    return f"greatest(0, least(1000, CAST(trunc(CAST({expr} AS DOUBLE) / {size} * 1000) AS INTEGER)))"


MELD_SQL = (
    "WITH u AS (SELECT l_orderkey AS d, l_linenumber AS n, l_returnflag AS e, l_partkey FROM lineitem), "
    "v AS (SELECT o_orderkey AS d, CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS n, o_custkey AS c FROM orders), "
    "f AS (SELECT event_id % 15000 AS d, CAST(event_id % 4 + 1 AS INTEGER) AS n, event_id % 7 AS frame, event_id FROM events), "
    "ff AS (SELECT d, n, frame, min(event_id) AS event_id FROM f GROUP BY ALL), "
    f"j AS (SELECT u.*, CASE WHEN ff.event_id IS NULL THEN '' ELSE 'Speaker face bounding box: [' || {_trunc('ff.event_id * 13 % 700', 640)} || ', ' || {_trunc('ff.event_id * 17 % 500', 480)} || ', ' || {_trunc('ff.event_id * 29 % 700', 640)} || ', ' || {_trunc('ff.event_id * 31 % 500', 480)} || ']' || chr(10) END AS box "
    "FROM u JOIN v USING (d, n) LEFT JOIN ff ON ff.d = u.d AND ff.n = u.n AND c % 14 > 0 AND ff.frame = (c % 14) // 2) "
    "SELECT d || '|' || n AS sample_id, 'test' AS split, @user || 'What is the emotion of the speaker?' AS user_text, '{\"emotion\": \"' || e || '\"}' AS answer FROM j"
)


def _meld(t: Tables, modality: str):
    utterances = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("Corrected Dialogue_ID"),
        F.lit("0").alias("Dialogue_ID"),
        F.col("l_linenumber").cast("string").alias("Utterance_ID"),
        F.col("l_returnflag").alias("Emotion"),
        F.concat(F.lit("part "), F.col("l_partkey")).alias("Utterance"),
    )
    videos = t.orders.select(
        F.col("o_orderkey").cast("int").alias("dialogue"),
        F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("utterance"),
        F.col("o_orderkey").cast("string").alias("path"),
        (F.col("o_custkey") % 14).cast("int").alias("total_frames"),
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
    )
    corner = lambda f, s: (eid() * f % s).cast("double")
    found = t.events.select(
        (eid() % 15000).cast("int").alias("dialogue"),
        (eid() % 4 + 1).cast("int").alias("utterance"),
        (eid() % 7).cast("int").alias("frame"),
        eid().alias("line_no"),
        corner(13, 700).alias("x1"),
        corner(17, 500).alias("y1"),
        corner(29, 700).alias("x2"),
        corner(31, 500).alias("y2"),
    )
    return shown(speech.meld(utterances, modality, "test", videos, videos, found))


@query("recipe_meld", MELD_SQL.replace("@user", "'<video>' || chr(10) || box || 'Transcript: \"part ' || l_partkey || '\"' || chr(10)"))
def recipe_meld(spark, sf_dir):
    return _meld(Tables(spark, sf_dir), "video_transcript")


@query("recipe_meld_video_audio", MELD_SQL.replace("@user", "'<video>' || chr(10) || box || '<audio>' || chr(10)"))
def recipe_meld_video_audio(spark, sf_dir):
    return _meld(Tables(spark, sf_dir), "video_audio")


@query("recipe_meld_audio_only", MELD_SQL.replace("@user", "'<audio>' || chr(10)"))
def recipe_meld_audio_only(spark, sf_dir):
    return _meld(Tables(spark, sf_dir), "audio_only")


SPLIT_DOC = "row_number() OVER (ORDER BY md5('42|' || doc_id)) <= floor(count(*) OVER () * 0.8)"


MUSTARD_SQL = (
    f"WITH s AS (SELECT *, {SPLIT_DOC} AS tr FROM documents) SELECT CAST(doc_id AS VARCHAR) AS sample_id, CASE WHEN tr THEN 'train' ELSE 'test' END AS split, "
    "'<video>' || chr(10) || @context || 'Is the speaker being sarcastic?' AS user_text, "
    "'{\"sarcasm\": ' || CASE WHEN n_chars > 500 THEN 'true' ELSE 'false' END || '}' AS answer FROM s"
)
MUSTARD_CONTEXT = (
    "'Dialogue context:' || chr(10) || '  - ' || lang || ': \"' || text || '\"' || chr(10) || '  - ' || source || ': \"' || n_chars || '\"' || chr(10)"
)


def _mustard(t: Tables, modality: str):
    entries = t.documents.select(
        F.col("doc_id").alias("key"),
        (F.col("n_chars") > 500).alias("sarcasm"),
        F.array("text", F.col("n_chars").cast("string"), F.lit("unused")).alias("context"),
        F.array("lang", "source").alias("context_speakers"),
    )
    return shown(speech.mustard(entries, modality))


@query("recipe_mustard", MUSTARD_SQL.replace("@context", MUSTARD_CONTEXT))
def recipe_mustard(spark, sf_dir):
    return _mustard(Tables(spark, sf_dir), "video_context")


@query("recipe_mustard_no_context", MUSTARD_SQL.replace("@context", "''"))
def recipe_mustard_no_context(spark, sf_dir):
    return _mustard(Tables(spark, sf_dir), "video_no_context")


FUNNY_SQL = (
    "SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, lang AS split, '<video>' || chr(10) || @context || 'Is the punchline funny?' AS user_text, "
    "'{\"funny\": ' || quality || '}' AS answer FROM documents d JOIN labels USING (doc_id)"
)
FUNNY_CONTEXT = "'Context:' || chr(10) || CASE WHEN n_chars > 200 THEN '  - \"' || source || '\"' || chr(10) || '  - \"' || n_chars || '\"' ELSE '' END || chr(10)"


def _urfunny(t: Tables, modality: str):
    folds = t.documents.select(F.col("lang").alias("split"), F.col("doc_id").alias("id"))
    labels = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("funny"))
    language = t.documents.where("n_chars > 200").select(
        F.col("doc_id").alias("id"), F.array("source", F.col("n_chars").cast("string")).alias("context_sentences")
    )
    return shown(speech.urfunny(folds, labels, language, modality))


@query("recipe_urfunny", FUNNY_SQL.replace("@context", FUNNY_CONTEXT))
def recipe_urfunny(spark, sf_dir):
    return _urfunny(Tables(spark, sf_dir), "video_context")


@query("recipe_urfunny_video_audio", FUNNY_SQL.replace("@context", "''"))
def recipe_urfunny_video_audio(spark, sf_dir):
    return _urfunny(Tables(spark, sf_dir), "video_audio")


@query(
    "recipe_rldd",
    "WITH f AS (SELECT 'Clips/' || CASE o_orderstatus WHEN 'F' THEN 'Deceptive' WHEN 'O' THEN 'Truthful' ELSE 'Other' END || '/' || o_orderkey || CASE WHEN o_orderpriority = '5-LOW' THEN '.txt' ELSE '.mp4' END AS path, o_orderstatus AS s, o_orderpriority AS p FROM orders), "
    "k AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || path)) <= floor(count(*) OVER () * 0.8) AS tr FROM f WHERE s <> 'P' AND p <> '5-LOW') "
    "SELECT path AS sample_id, CASE WHEN tr THEN 'train' ELSE 'test' END AS split, '<video>' || chr(10) || 'Is this person being deceptive or truthful?' AS user_text, "
    "'{\"label\": \"' || CASE s WHEN 'F' THEN 'deceptive' ELSE 'truthful' END || '\"}' AS answer FROM k",
)
def recipe_rldd(spark, sf_dir):
    status = F.col("o_orderstatus")
    folder = F.when(status == "F", "Deceptive").when(status == "O", "Truthful").otherwise("Other")
    ending = F.when(F.col("o_orderpriority") == "5-LOW", ".txt").otherwise(".mp4")
    name = F.concat(F.col("o_orderkey").cast("string"), ending)
    listing = Tables(spark, sf_dir).orders.select(F.concat_ws("/", F.lit("Clips"), folder, name).alias("path"))
    return shown(speech.rldd(listing))


@query(
    "recipe_vocalsound",
    "SELECT p_partkey || '.wav' AS sample_id, 'test' AS split, " + _sql_text(speech.VOCAL_USER) + " AS user_text, "
    "'{\"vocal_sound\": \"' || CASE p_type WHEN 'ECONOMY' THEN 'Laughter' WHEN 'SMALL' THEN 'Sneeze' ELSE 'Throat clearing' END || '\"}' AS answer FROM part WHERE p_type <> 'PROMO' AND p_size > 10",
)
def recipe_vocalsound(spark, sf_dir):
    parts = Tables(spark, sf_dir).part
    kind = F.col("p_type")
    code = (
        F.when(kind == "ECONOMY", "/m/01j3sz").when(kind == "SMALL", "/m/01hsr_").when(kind == "PROMO", "/m/other").otherwise("/m/0dl9sf8")
    )
    name = F.concat(F.col("p_partkey"), F.lit(".wav"))
    entries = parts.select(F.concat(F.lit("/data/x/"), name).alias("wav"), code.alias("labels"))
    return shown(speech.vocalsound(entries, "test", parts.where("p_size > 10").select(name.alias("path"))))


PODCAST_SQL = (
    "c AS (SELECT o_orderkey AS f, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test' END AS split, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'Neutral' ELSE 'Contempt' END AS agreed, "
    "floor(o_totalprice / 100) / 1000 AS act FROM orders WHERE o_orderstatus <> 'P'), "
    "d AS (SELECT l_orderkey AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, CASE l_returnflag WHEN 'R' THEN 'Other' ELSE l_returnflag END AS e, l_quantity AS a, l_discount AS v, l_tax AS t "
    "FROM lineitem WHERE l_quantity > 5)"
)


def _podcast(t: Tables, task: str):
    status, cust = F.col("o_orderstatus"), F.col("o_custkey")
    consensus = t.orders.select(
        F.col("o_orderkey").alias("file"),
        F.when(cust % 5 == 0, "X").when(cust % 2 == 0, "N").otherwise("C").alias("emotion"),
        (F.floor(F.col("o_totalprice") / 100) / 1000).alias("arousal"),
        F.lit(4.0).alias("valence"),
        F.lit(2.5).alias("dominance"),
        F.when(status == "F", "Train").when(status == "O", "Test2").otherwise("Test3").alias("split_set"),
    )
    lines = row_index(
        t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "line_no"
    )
    detailed = lines.select(
        F.col("l_orderkey").alias("file"),
        "line_no",
        F.when(F.col("l_returnflag") == "R", "Other-Raging").otherwise(F.col("l_returnflag")).alias("emotion"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("arousal"),
        F.col("l_discount").alias("valence"),
        F.col("l_tax").alias("dominance"),
    )
    return shown(speech.msppodcast(consensus, detailed, task))


@query(
    "recipe_msppodcast_labels",
    f"WITH {PODCAST_SQL} SELECT CAST(f AS VARCHAR) AS sample_id, split, {_sql_text(speech.PODCAST_USER['labels'])} AS user_text, '{{\"emotion\": \"' || agreed || '\"}}' AS answer FROM c WHERE split = 'train' AND agreed IS NOT NULL UNION ALL "
    f"SELECT CAST(f AS VARCHAR), split, {_sql_text(speech.PODCAST_USER['labels'])}, '{{\"emotions_per_annotator\": [' || string_agg('\"' || e || '\"', ', ' ORDER BY i) || ']}}' FROM c JOIN d USING (f) WHERE split = 'test' GROUP BY f, split",
)
def recipe_msppodcast_labels(spark, sf_dir):
    return _podcast(Tables(spark, sf_dir), "labels")


@query(
    "recipe_msppodcast_vad",
    f"WITH {PODCAST_SQL} SELECT CAST(f AS VARCHAR) AS sample_id, split, {_sql_text(speech.PODCAST_USER['vad'])} AS user_text, '{{\"arousal\": ' || round(act, 3) || ', \"valence\": 4.0, \"dominance\": 2.5}}' AS answer FROM c WHERE split = 'train' UNION ALL "
    f"SELECT CAST(f AS VARCHAR), split, {_sql_text(speech.PODCAST_USER['vad'])}, '{{\"vad_per_annotator\": [' || string_agg('{{\"arousal\": ' || a || ', \"valence\": ' || v || ', \"dominance\": ' || t || '}}', ', ' ORDER BY i) || ']}}' FROM c JOIN d USING (f) WHERE split = 'test' GROUP BY f, split",
)
def recipe_msppodcast_vad(spark, sf_dir):
    return _podcast(Tables(spark, sf_dir), "vad")


@query(
    "recipe_voxconverse",
    f"{BASE}, {_seg_sql('gt')}, {LETTERS}, lab AS (SELECT clip, w, b, string_agg(letter, '' ORDER BY letter) AS l FROM gt_act JOIN letters USING (clip, w, who) GROUP BY clip, w, b), "
    "allb AS (SELECT clip, w, b, coalesce(l, '-') AS l FROM gt_ok CROSS JOIN bins LEFT JOIN lab USING (clip, w, b)) "
    f"SELECT clip || '_' || w || '_' || (w + 30) AS sample_id, 'train' AS split, {_sql_text(speech.DIARIZATION_USER['diarization'])} AS user_text, '{{\"timeline\": [' || string_agg('\"' || l || '\"', ', ' ORDER BY b) || ']}}' AS answer, "
    "CAST(clip AS VARCHAR) AS clip_id, CAST(w AS DOUBLE) AS win_start FROM allb GROUP BY clip, w",
)
def recipe_voxconverse(spark, sf_dir):
    t = Tables(spark, sf_dir)
    made = speech.voxconverse(_segments(frames(t)), _clips(t), "diarization", "train")
    return shown(made, "clip_id", F.col("win_start").cast("double").alias("win_start"))


@query(
    "recipe_voxconverse_count",
    f"{BASE}, {_seg_sql('gt')}, {LETTERS} SELECT clip || '_' || w || '_' || (w + 30) AS sample_id, 'train' AS split, {_sql_text(speech.DIARIZATION_USER['speaker_count'])} AS user_text, "
    "'{\"num_speakers\": ' || count(*) || '}' AS answer FROM letters SEMI JOIN gt_ok USING (clip, w) GROUP BY clip, w",
)
def recipe_voxconverse_count(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return shown(speech.voxconverse(_segments(frames(t)), _clips(t), "speaker_count", "train"))


COUNTED = [
    recipe_gazefollow_train, recipe_meld, recipe_meview, recipe_mmew_clip_emotion, recipe_msppodcast_labels, recipe_proxemics_no_skeleton,
    recipe_rldd, recipe_urfunny, recipe_vocalsound,
]


@query(
    "skip_counters",
    f"WITH {GAZE_SQL}, {SHEET}, n AS (SELECT filename FROM fr WHERE number BETWEEN 1 AND 7 GROUP BY filename HAVING count(*) >= 4), "
    "v AS (SELECT o_orderkey AS d, unnest([1, 2, 3, 4]) AS i FROM orders), "
    "s AS (SELECT 'sub' || printf('%02d', o_custkey % 30) || '-' || (o_orderkey % 40) || '.mp4' AS path FROM orders WHERE o_orderstatus IN ('F', 'O')), "
    "c AS (SELECT DISTINCT 'sub' || printf('%02d', c_custkey % 30) || '-' || (c_custkey % 40) || '.mp4' AS path FROM customer) "
    "SELECT 'recipe_gazefollow_train' AS recipe, 'missing file' AS reason, count(*) AS n_rows FROM events ANTI JOIN pics USING (user_id) "
    "UNION ALL SELECT 'recipe_meld', 'bad id', 0 UNION ALL SELECT 'recipe_meld', 'missing video', count(*) FROM lineitem l ANTI JOIN v ON v.d = l_orderkey AND v.i = l_linenumber "
    "UNION ALL SELECT 'recipe_meview', 'incomplete row', 0 UNION ALL SELECT 'recipe_meview', 'unknown emotion', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') "
    "UNION ALL SELECT 'recipe_meview', 'missing file', count(*) FROM s ANTI JOIN c USING (path) "
    "UNION ALL SELECT 'recipe_mmew_clip_emotion', 'incomplete row', 0 UNION ALL SELECT 'recipe_mmew_clip_emotion', 'too few frames', count(*) FROM good ANTI JOIN n USING (filename) "
    "UNION ALL SELECT 'recipe_msppodcast_labels', 'hidden split', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') "
    "UNION ALL SELECT 'recipe_msppodcast_labels', 'no agreement', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 = 0 "
    "UNION ALL SELECT 'recipe_msppodcast_labels', 'no annotator', count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 5) "
    "UNION ALL SELECT 'recipe_proxemics_no_skeleton', 'no boxes', count(*) FROM events WHERE NOT coalesce(value > 5, FALSE) "
    "UNION ALL SELECT 'recipe_rldd', 'no video', count(*) FROM orders WHERE o_orderpriority = '5-LOW' "
    "UNION ALL SELECT 'recipe_rldd', 'unknown folder', count(*) FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus NOT IN ('F', 'O') "
    "UNION ALL SELECT 'recipe_urfunny', 'no label', count(*) FROM documents ANTI JOIN labels USING (doc_id) "
    "UNION ALL SELECT 'recipe_vocalsound', 'unknown label', count(*) FROM part WHERE p_type = 'PROMO' "
    "UNION ALL SELECT 'recipe_vocalsound', 'missing file', count(*) FROM part WHERE p_type <> 'PROMO' AND p_size <= 10",
)
def skip_counters(spark, sf_dir):
    """What the recipes leave out, counted by the jobs that make their samples."""
    found = []
    for recipe in COUNTED:
        with counting_skips() as skips:
            made = recipe(spark, sf_dir)
        made.write.format("noop").mode("overwrite").save()
        found += [(recipe.__name__, reason, n) for reason, n in skips.counts().items()]
    return spark.createDataFrame(found, "recipe string, reason string, n_rows long")

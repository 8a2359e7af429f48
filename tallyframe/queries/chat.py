"""Chat rows, model responses and their typed fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import labels as lb
from tallyframe.functions import messages as ms
from tallyframe.functions import parse as ps
from tallyframe.operators.joins import gather
from tallyframe.queries.base import Tables, query, r6

SYSTEM = "Rate the text."
BOX = "[' || (doc_id * 13 % 500) || ', ' || (doc_id * 17 % 500) || ', ' || (doc_id * 29 % 500) || ',  ' || (doc_id * 31 % 500) || ']"
USER_SQL = f"'<text>' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Box: {BOX}' || chr(10) ELSE '' END || text"
ANSWER_SQL = "'{\"quality\": ' || quality || ', \"lang\": \"' || lang || '\"}'"
THINK_SQL = f"CASE WHEN toxic = 1 THEN '<think>' || chr(10) || source || chr(10) || '</think>' || chr(10) ELSE '' END || {ANSWER_SQL}"


def _built(t: Tables):
    """Three-turn rows from documents and their labels; some answers carry reasoning."""
    rows = t.documents.join(t.labels, "doc_id")
    box = F.concat_ws(", ", *[F.col("doc_id") * f % 500 for f in (13, 17, 29)])
    box_line = F.concat(F.lit("Box: ["), box, F.lit(",  "), F.col("doc_id") * 31 % 500, F.lit("]\n"))
    user = F.concat(
        F.lit("<text>\n"), F.when(F.col("doc_id") % 3 == 0, box_line).otherwise(""), F.col("text")
    )
    answer = ms.json_object(quality=F.col("quality").cast("string"), lang=ms.quoted(F.col("lang")))
    final = F.when(F.col("toxic") == 1, ms.reasoning_block(F.col("source"), answer)).otherwise(answer)
    return rows.select("doc_id", ms.build_messages(SYSTEM, user, final).alias("messages"))


BUILT = (
    f"built AS (SELECT doc_id, '{SYSTEM}' AS sys, {USER_SQL} AS usr, {THINK_SQL} AS ans, quality, lang, toxic, source "
    "FROM documents JOIN labels USING (doc_id))"
)


def _content(i: int):
    return F.col("messages")[i]["content"]


@query(
    "build_messages",
    f"WITH {BUILT} SELECT doc_id, 3 AS turns, 'system,user,assistant' AS roles, sys AS system_text, md5(usr) AS user_md5, "
    "length(usr) AS user_chars, ans AS answer FROM built",
)
def build_messages(spark, sf_dir):
    return _built(Tables(spark, sf_dir)).select(
        "doc_id",
        F.size("messages").alias("turns"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        _content(0).alias("system_text"),
        F.md5(_content(1)).alias("user_md5"),
        F.char_length(_content(1)).cast("long").alias("user_chars"),
        _content(2).alias("answer"),
    )


@query(
    "inject_think",
    f"WITH {BUILT} SELECT doc_id, CASE WHEN starts_with(ans, '<think>') THEN ans ELSE '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || ans END AS answer, "
    "md5(usr) AS user_md5 FROM built",
)
def inject_think(spark, sf_dir):
    rows = _built(Tables(spark, sf_dir)).withColumn("messages", ms.inject_empty_think(F.col("messages")))
    return rows.select("doc_id", _content(2).alias("answer"), F.md5(_content(1)).alias("user_md5"))


CHAT = "chat AS (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"


def _chat(t: Tables):
    return gather(
        t.conversations,
        ["conv_id"],
        ["turn"],
        F.struct(F.col("role").alias("role"), F.col("text").alias("content")),
        "messages",
    )


@query(
    "strip_gt",
    f"WITH {CHAT}, s AS (SELECT conv_id, CASE WHEN m[-1].role = 'assistant' THEN m[:-2] ELSE m END AS k FROM chat) "
    "SELECT conv_id, len(k) AS turns, coalesce(md5(array_to_string(list_transform(k, lambda x: x.role || ':' || x.content), '|')), md5('')) AS digest FROM s",
)
def strip_gt(spark, sf_dir):
    rows = _chat(Tables(spark, sf_dir)).withColumn("messages", ms.strip_ground_truth(F.col("messages")))
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return rows.select("conv_id", F.size("messages").cast("long").alias("turns"), F.md5(joined).alias("digest"))


@query(
    "extract_gt",
    f"WITH {CHAT}, a AS (SELECT conv_id, list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: x.content) AS t FROM chat) "
    "SELECT conv_id, md5(t[-1]) AS last_md5, md5(t[1]) AS first_md5 FROM a",
)
def extract_gt(spark, sf_dir):
    messages = F.col("messages")
    return _chat(Tables(spark, sf_dir)).select(
        "conv_id",
        F.md5(ms.answer_text(messages, "last")).alias("last_md5"),
        F.md5(ms.answer_text(messages, "first")).alias("first_md5"),
    )


@query(
    "extract_answer",
    f"WITH {BUILT} SELECT doc_id, lang AS last_lang, CAST(quality AS BIGINT) AS first_quality FROM built",
)
def extract_answer(spark, sf_dir):
    messages = F.col("messages")
    last = F.try_parse_json(ps.parse_response(ms.answer_text(messages, "last")))
    first = F.try_parse_json(ms.answer_text(messages, "first"))
    return _built(Tables(spark, sf_dir)).select(
        "doc_id",
        ps.as_text(ps.field(last, "lang")).alias("last_lang"),
        ps.coerce_int(ps.field(first, "quality")).alias("first_quality"),
    )


@query(
    "extract_bbox",
    f"WITH {BUILT}, x AS (SELECT doc_id, regexp_extract(usr, '\\[(\\d+),\\s*(\\d+),\\s*(\\d+),\\s*(\\d+)\\]', ['a', 'b', 'c', 'd']) AS r FROM built) "
    "SELECT doc_id, try_cast(r.a AS DOUBLE) AS x1, try_cast(r.b AS DOUBLE) AS y1, try_cast(r.c AS DOUBLE) AS x2, try_cast(r.d AS DOUBLE) AS y2 FROM x",
)
def extract_bbox(spark, sf_dir):
    box = ms.extract_box(F.col("messages"))
    rows = _built(Tables(spark, sf_dir)).select("doc_id", box.alias("box"))
    return rows.select("doc_id", *[F.col("box")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def responses(t: Tables):
    """Seven ways a model may answer, chosen by the event id."""
    props, kind = F.col("props"), F.col("event_type")
    line = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    forms = [
        line("<think>maybe {\"k\": 0}</think>\n", props),
        line("Sure:\n```json\n", props, "\n```\ndone"),
        line('The answer is {"outer": ', props, "} I think"),
        line('{"k": 1} or rather {"k": 2, "type": "', kind, '"} yes'),
        line("the type is '", kind, "' I guess"),
        line("no answer {broken"),
        line('  {"type": "', kind, '", "k": ', F.regexp_extract("props", r"(\d+)", 1), "}  "),
    ]
    choice = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        choice = F.when(F.col("event_id") % 7 == i, form).otherwise(choice)
    return t.events.select("event_id", "event_type", "value", choice.alias("response"))


RESPONSES = (
    "resp AS (SELECT event_id, event_type, value, CASE event_id % 7 "
    "WHEN 0 THEN '<think>maybe {\"k\": 0}</think>' || chr(10) || props "
    "WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'done' "
    "WHEN 2 THEN 'The answer is {\"outer\": ' || props || '} I think' "
    "WHEN 3 THEN '{\"k\": 1} or rather {\"k\": 2, \"type\": \"' || event_type || '\"} yes' "
    "WHEN 4 THEN 'the type is ''' || event_type || ''' I guess' "
    "WHEN 5 THEN 'no answer {broken' "
    "ELSE '  {\"type\": \"' || event_type || '\", \"k\": ' || regexp_extract(props, '(\\d+)', 1) || '}  ' END AS response FROM events), "
    "body AS (SELECT *, trim(regexp_replace(response, '<think>.*?</think>', '', 'gs'), ' ' || chr(10)) AS b FROM resp), "
    "cand AS (SELECT *, regexp_extract(b, '```(?:json)?\\s*(\\{.*?\\})\\s*```', 1, 's') AS c2, regexp_extract(b, '\\{.*\\}', 0, 's') AS c3, "
    "list_filter(regexp_extract_all(b, '\\{[^{}]*\\}'), lambda x: json_valid(x)) AS c4 FROM body), "
    "parsed AS (SELECT event_id, event_type, value, response, CASE WHEN json_valid(b) THEN b WHEN json_valid(c2) THEN c2 WHEN json_valid(c3) THEN c3 ELSE c4[-1] END AS j FROM cand)"
)


@query(
    "parse_response",
    f"WITH {RESPONSES} SELECT event_id, j IS NOT NULL AS parsed, CAST(json_extract(j, '$.k') AS BIGINT) AS k, "
    "json_extract_string(j, '$.type') AS kind, CAST(json_extract(j, '$.outer.k') AS BIGINT) AS inner_k FROM parsed",
)
def parse_response(spark, sf_dir):
    rows = responses(Tables(spark, sf_dir)).withColumn("v", F.try_parse_json(ps.parse_response(F.col("response"))))
    return rows.select(
        "event_id",
        F.col("v").isNotNull().alias("parsed"),
        ps.coerce_int(ps.field(F.col("v"), "k")).alias("k"),
        ps.as_text(ps.field(F.col("v"), "type")).alias("kind"),
        F.try_variant_get("v", "$.outer.k", "long").alias("inner_k"),
    )


@query(
    "parse_free_text",
    f"WITH {RESPONSES}, w AS (SELECT event_id, regexp_extract_all(response, '(?i)[\"''](click|error|view|signup)[\"'']', 1) AS q, "
    "regexp_extract_all(response, '(?i)\\b(click|error|view|signup|answer)\\b', 1) AS p FROM resp) "
    "SELECT event_id, lower(coalesce(q[-1], p[-1])) AS word FROM w".replace("view|signup)[", "view|signup|answer)["),
)
def parse_free_text(spark, sf_dir):
    parsed = ps.parse_free_text(F.col("response"), ["click", "error", "view", "signup", "answer"], "w")
    return responses(Tables(spark, sf_dir)).select(
        "event_id", F.get_json_object(parsed, "$.w").alias("word")
    )




@query(
    "coerce_number",
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN round(value, 6) WHEN 1 THEN round(value, 6) WHEN 3 THEN 1.0 WHEN 4 THEN CAST(event_id % 100 AS DOUBLE) END AS number, "
    "CAST(CASE event_id % 6 WHEN 0 THEN trunc(value) WHEN 3 THEN 1 WHEN 4 THEN event_id % 100 END AS BIGINT) AS whole, "
    "CASE event_id % 6 WHEN 0 THEN CAST(trunc(value) AS INTEGER) WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN CASE event_id % 100 WHEN 0 THEN 0 WHEN 1 THEN 1 END END AS flag FROM events",
)
def coerce_number(spark, sf_dir):
    value, eid = F.col("value").cast("string"), F.col("event_id")
    text = (
        F.when(eid % 6 == 0, value)
        .when(eid % 6 == 1, F.concat(F.lit("["), value, F.lit(", 1]")))
        .when(eid % 6 == 2, '" Yes "')
        .when(eid % 6 == 3, "true")
        .when(eid % 6 == 4, F.concat(F.lit('"'), eid % 100, F.lit('"')))
        .otherwise("null")
    )
    rows = Tables(spark, sf_dir).events.select(
        "event_id", F.try_parse_json(F.concat(F.lit('{"x": '), text, F.lit("}"))).alias("d")
    )
    x = ps.field(F.col("d"), "x")
    return rows.select(
        "event_id",
        r6(ps.coerce_number(x)).alias("number"),
        ps.coerce_int(x).alias("whole"),
        ps.coerce_binary(x).alias("flag"),
    )


@query(
    "coerce_label",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN upper(event_type[1]) || event_type[2:] WHEN 1 THEN upper(event_type[1]) || event_type[2:] WHEN 2 THEN 'Neutral' ELSE 'Neutral' END AS label, "
    "CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'fallback' WHEN 2 THEN 'fallback' ELSE 'fallback' END AS first_alias, "
    "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN event_type || ',x,y' WHEN 2 THEN '' ELSE '' END AS flat FROM events",
)
def coerce_label(spark, sf_dir):
    kind, eid = F.col("event_type"), F.col("event_id")
    text = (
        F.when(eid % 4 == 0, F.concat(F.lit('{"a": "'), kind, F.lit('", "b": "fallback"}')))
        .when(eid % 4 == 1, F.concat(F.lit('{"a": ["'), kind, F.lit('", ["x", "y"], 7], "b": "fallback"}')))
        .when(eid % 4 == 2, '{"a": [], "b": "fallback"}')
        .otherwise('{"a": null, "b": "fallback"}')
    )
    rows = Tables(spark, sf_dir).events.select("event_id", F.try_parse_json(text).alias("d"))
    a = ps.field(F.col("d"), "a")
    first = ps.as_text(F.when(ps.is_text(ps.alias_get(F.col("d"), "a", "b")), ps.alias_get(F.col("d"), "a", "b")))
    return rows.select(
        "event_id",
        ps.coerce_label(a, "Neutral").alias("label"),
        F.coalesce(first, F.lit("fallback")).alias("first_alias"),
        F.array_join(ps.flatten_labels(a), ",").alias("flat"),
    )


@query(
    "decode_label",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'N' THEN 'None' WHEN 'A' THEN 'Accepted' END AS decoded, "
    "CASE WHEN l_linenumber < 4 THEN ['zero', 'one', 'two', 'three'][l_linenumber + 1] END AS by_index, "
    "CASE WHEN lower(l_linestatus) LIKE 'o%' THEN 'Other' ELSE l_linestatus END AS folded, "
    "concat_ws(',', CASE WHEN l_returnflag = 'A' THEN 'a' END, CASE WHEN l_linestatus = 'F' THEN 'f' END) AS hot FROM lineitem",
)
def decode_label(spark, sf_dir):
    vector = F.array((F.col("l_returnflag") == "A").cast("int"), (F.col("l_linestatus") == "F").cast("int"))
    return Tables(spark, sf_dir).lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        lb.decode_label(F.col("l_returnflag"), {"N": "None", "A": "Accepted"}).alias("decoded"),
        lb.decode_index(F.col("l_linenumber"), ["zero", "one", "two", "three"]).alias("by_index"),
        lb.fold_prefix(F.col("l_linestatus"), "o", "Other").alias("folded"),
        F.array_join(lb.onehot_to_labels(vector, ["a", "f"]), ",").alias("hot"),
    )


@query(
    "parse_au",
    "WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 20) || '+' || (event_id % 7) WHEN 1 THEN (event_id % 9) || ' + x+2.0' WHEN 2 THEN '' END AS u FROM events) "
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'AU' || (event_id % 20) || ',AU' || (event_id % 7) WHEN 1 THEN 'AU' || (event_id % 9) || ',AU2' ELSE '' END AS units, "
    "CASE WHEN u IS NULL OR trim(u) = '' THEN 'none' ELSE 'AU' || trim(u) END AS phrase, "
    "printf('%.2f', CAST(event_id AS DOUBLE) / 30) AS at_time FROM s",
)
def parse_au(spark, sf_dir):
    eid = F.col("event_id")
    text = (
        F.when(eid % 4 == 0, F.concat(eid % 20, F.lit("+"), eid % 7))
        .when(eid % 4 == 1, F.concat(eid % 9, F.lit(" + x+2.0")))
        .when(eid % 4 == 2, "")
    )
    return Tables(spark, sf_dir).events.select(
        "event_id",
        F.array_join(lb.parse_units(text), ",").alias("units"),
        lb.units_phrase(text).alias("phrase"),
        lb.index_to_time(eid).alias("at_time"),
    )


@query(
    "person_phrase",
    "SELECT c_custkey, CASE WHEN g IS NOT NULL AND a IS NOT NULL THEN g || ' ' || a WHEN g IS NOT NULL THEN g || ' person' WHEN a IS NOT NULL THEN a ELSE 'person' END AS phrase "
    "FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS g, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE lower(c_mktsegment) END AS a FROM customer)",
)
def person_phrase(spark, sf_dir):
    key = F.col("c_custkey")
    gender = F.when(key % 3 == 0, "Female").when(key % 3 == 1, "Male").otherwise("Unknown")
    age = F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment"))
    return Tables(spark, sf_dir).customer.select("c_custkey", lb.person_phrase(gender, age).alias("phrase"))

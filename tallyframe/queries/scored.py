"""Every metric file over JSON answers made from events, with missing keys, nulls, aliases, lists and odd spellings.

Each query goes through ``run_metric``, so the rules of the metric about rows it cannot read are part of the comparison.
The SQL states what those rules leave: a truth, a prediction and a condition per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.metrics import registry as rg
from tallyframe.metrics.common import key_of
from tallyframe.queries.base import ORACLES, Tables, query, scores, unpivot
from tallyframe.queries.classify import _in, _one, label_sql
from tallyframe.queries.places import _points
from tallyframe.queries.rank import AP_SQL
from tallyframe.queries.speech import _timelines
from tallyframe.session import staged


def _scored(spark, folder: str, name: str, gt, pred) -> DataFrame:
    """Run one metric over the events; ``gt`` and ``pred`` build JSON text."""
    rows = Tables(spark, folder).events.select(
        F.col("event_type").alias("grp"), F.try_parse_json(gt()).alias("gt"), F.try_parse_json(pred()).alias("pred")
    )
    return scores(rg.run_metric(name, rows, ["grp"]))


def _id() -> Column:
    return F.col("event_id")


def _cases(cases: dict[int, Column], other: Column, modulus: int = 11) -> Column:
    """One of several texts by the remainder of the event id."""
    out = other
    for remainder, text in cases.items():
        out = F.when(_id() % modulus == remainder, text).otherwise(out)
    return out


def _text(key: str, label: Column) -> Column:
    return F.concat(F.lit(f'{{"{key}": "'), label, F.lit('"}'))


def _pick(classes: list[str], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, classes)), place.cast("int"))


def _pick_sql(classes: list[str], place: str) -> str:
    return "(['" + "', '".join(classes) + f"'])[({place}) + 1]"


def _truth(classes: list[str], shift: int = 0) -> Column:
    return _pick(classes, (_id() + shift) % len(classes))


def _truth_sql(classes: list[str], shift: int = 0) -> str:
    return _pick_sql(classes, f"(event_id + {shift}) % {len(classes)}")


def _guess(classes: list[str]) -> Column:
    return F.when(F.col("value") > 30, _truth(classes)).otherwise(_pick(classes, F.floor(_id() / 7) % len(classes)))


def _guess_sql(classes: list[str]) -> str:
    return f"CASE WHEN value > 30 THEN {_truth_sql(classes)} ELSE {_pick_sql(classes, f'(event_id // 7) % {len(classes)}')} END"


def _label_query(gt: str, pred: str, values: dict[str, str], where: str = "true") -> str:
    return label_sql(f"SELECT event_type AS grp, {gt} AS gt, {pred} AS pred FROM events WHERE {where}", ["grp"], values)


def _each(classes: list[str], score: str = "f1", kind: str = "f1") -> dict[str, str]:
    return {f"{kind}_{key_of(c)}": _one(c, score) for c in classes}


def _over(classes: list[str], score: str) -> str:
    return f"sum(CASE WHEN {_in(classes)} THEN {score} ELSE 0 END) / {len(classes)}"


def _weighted(classes: list[str]) -> str:
    inside = _in(classes)
    return f"sum(CASE WHEN {inside} THEN f1 * sup ELSE 0 END) / sum(CASE WHEN {inside} THEN sup ELSE 0 END)"


ACCURACY = "sum(tp) / sum(sup)"
NO_ANSWER = "event_id % 11 IN (0, 1)"


def _usual(key: str, classes: list[str], listed: bool = False, spelling=F.lower) -> Column:
    """Empty object, null, perhaps a list, another spelling, else the label."""
    label = _guess(classes)
    cases = {0: F.lit("{}"), 1: F.lit(f'{{"{key}": null}}'), 3: _text(key, spelling(label))}
    if listed:
        cases[2] = F.concat(F.lit(f'{{"{key}": ["'), label, F.lit('", "x"]}'))
    return _cases(cases, _text(key, label))


def _spelled(classes: list[str], case: str, missing: str) -> str:
    """The label after the rules: missing answers, and the other spelling where it counts as another label."""
    return f"CASE WHEN {NO_ANSWER} THEN {missing} WHEN event_id % 11 = 3 THEN {case}({_guess_sql(classes)}) ELSE {_guess_sql(classes)} END"


EXPR = rg.EXPRESSIONS


@query(
    "metric_affwild2_expr_f1",
    _label_query(
        _truth_sql(EXPR), _spelled(EXPR, "lower", "''"), {"macro_f1": _over(EXPR, "f1"), **_each(EXPR)}, "event_id % 13 <> 0"
    ),
)
def metric_affwild2_expr_f1(spark, sf_dir):
    gt = lambda: F.when(_id() % 13 == 0, "{}").otherwise(_text("label", _truth(EXPR)))
    return _scored(spark, sf_dir, "affwild2_expr_f1", gt, lambda: _usual("label", EXPR))


TALK = rg.DIALOGUE_EMOTIONS


@query(
    "metric_meld_weighted_f1",
    _label_query(
        f"CASE WHEN event_id % 13 = 0 THEN 'Neutral' ELSE {_truth_sql(TALK)} END",
        f"CASE WHEN {NO_ANSWER} THEN 'Neutral' ELSE {_guess_sql(TALK)} END",
        {"weighted_f1": _weighted(TALK), "macro_f1": _over(TALK, "f1"), **_each(TALK)},
    ),
)
def metric_meld_weighted_f1(spark, sf_dir):
    gt = lambda: F.when(_id() % 13 == 0, "{}").otherwise(_text("emotion", F.lower(_truth(TALK))))
    return _scored(spark, sf_dir, "meld_weighted_f1", gt, lambda: _usual("emotion", TALK, listed=True))


HIDDEN = rg.CONCEALED_EMOTIONS


@query(
    "metric_meview_uar",
    _label_query(
        f"CASE WHEN event_id % 13 = 0 THEN '' ELSE {_truth_sql(HIDDEN)} END",
        f"CASE WHEN {NO_ANSWER} THEN '' ELSE {_guess_sql(HIDDEN)} END",
        {"accuracy": ACCURACY, "macro_f1": _over(HIDDEN, "f1"), "uar": _over(HIDDEN, "rec"), **_each(HIDDEN)},
    ),
)
def metric_meview_uar(spark, sf_dir):
    gt = lambda: F.when(_id() % 13 == 0, "{}").otherwise(_text("emotion", F.initcap(_truth(HIDDEN))))
    return _scored(spark, sf_dir, "meview_uar", gt, lambda: _usual("emotion", HIDDEN, spelling=F.upper))


MICRO, MACRO = rg.MICRO_EMOTIONS, rg.MACRO_EMOTIONS


def _micro_sql(classes: list[str], inside: str) -> str:
    values = {"accuracy": ACCURACY, "macro_f1": _over(classes, "f1"), "uar": _over(classes, "rec"), **_each(classes)}
    where = f"event_type {inside} ('view', 'click') AND NOT {NO_ANSWER} AND event_id % 13 <> 0"
    return f"SELECT * FROM ({_label_query(_truth_sql(classes), _spelled(classes, 'upper', 'NULL'), values, where)})"


@query("metric_mmew_emotion_accuracy", f"{_micro_sql(MICRO, 'IN')} UNION ALL {_micro_sql(MACRO, 'NOT IN')}")
def metric_mmew_emotion_accuracy(spark, sf_dir):
    wide = F.col("event_type").isin("view", "click")

    def gt():
        label = F.when(wide, _truth(MICRO)).otherwise(_truth(MACRO))
        return F.when(_id() % 13 == 0, "{}").otherwise(_text("emotion", label))

    def pred():
        return F.when(wide, _usual("emotion", MICRO, spelling=F.upper)).otherwise(_usual("emotion", MACRO, spelling=F.upper))

    return _scored(spark, sf_dir, "mmew_emotion_accuracy", gt, pred)


SPEECH = rg.SPEECH_EMOTIONS


def _votes(spelling=F.lower) -> Column:
    """Two annotators that disagree for every fifth event, else three of whom two agree."""
    a, b = spelling(_truth(SPEECH)), spelling(_truth(SPEECH, 1))
    listed = F.when(_id() % 5 == 0, F.array(a, b)).otherwise(F.array(b, a, a))
    return F.concat(F.lit('{"emotions_per_annotator": ["'), F.array_join(listed, '", "'), F.lit('"]}'))


K = len(SPEECH)
FIRST_IN_LIST = _pick_sql(SPEECH, f"CASE WHEN event_id % 5 = 0 THEN least(event_id % {K}, (event_id + 1) % {K}) ELSE event_id % {K} END")


@query(
    "metric_msppodcast_labels_f1",
    _label_query(
        FIRST_IN_LIST, _guess_sql(SPEECH), {"weighted_f1": _weighted(SPEECH), "macro_f1": _over(SPEECH, "f1"), **_each(SPEECH)}, f"NOT {NO_ANSWER}"
    ),
)
def metric_msppodcast_labels_f1(spark, sf_dir):
    return _scored(spark, sf_dir, "msppodcast_labels_f1", _votes, lambda: _usual("emotion", SPEECH, listed=True))


def _single_or_votes() -> Column:
    return F.when(_id() % 13 == 0, _text("emotion", _truth(SPEECH, 2))).otherwise(_votes(lambda c: c))


SPOKEN = f"CASE WHEN event_id % 13 = 0 THEN {_truth_sql(SPEECH, 2)} ELSE {_truth_sql(SPEECH)} END"


@query(
    "metric_msppodcast_labels_accuracy",
    _label_query(SPOKEN, _spelled(SPEECH, "lower", "NULL"), {"ua": "avg(CASE WHEN sup > 0 THEN rec END)", "wa": ACCURACY}, f"NOT {NO_ANSWER}"),
)
def metric_msppodcast_labels_accuracy(spark, sf_dir):
    return _scored(spark, sf_dir, "msppodcast_labels_accuracy", _single_or_votes, lambda: _usual("emotion", SPEECH))


@query(
    "metric_msppodcast_labels_weighted_f1",
    _label_query(SPOKEN, _spelled(SPEECH, "lower", "NULL"), {"weighted_f1": "sum(f1 * sup) / sum(sup)"}, f"NOT {NO_ANSWER}"),
)
def metric_msppodcast_labels_weighted_f1(spark, sf_dir):
    return _scored(spark, sf_dir, "msppodcast_labels_weighted_f1", _single_or_votes, lambda: _usual("emotion", SPEECH))


TIES = rg.RELATIONS


def _relation() -> Column:
    label = _guess(TIES)
    cases = {
        0: F.lit("{}"), 1: F.lit('{"relationship": null}'), 2: _text("social_relationship", label),
        3: F.concat(F.lit('{"relationship": "", "social_relationship": "'), label, F.lit('"}')),
    }
    return _cases(cases, _text("relationship", label))


@query(
    "metric_pisc_accuracy",
    _label_query(_truth_sql(TIES), _guess_sql(TIES), {"accuracy": ACCURACY, "macro_f1": _over(TIES, "f1")}, f"NOT {NO_ANSWER}"),
)
def metric_pisc_accuracy(spark, sf_dir):
    return _scored(spark, sf_dir, "pisc_accuracy", lambda: _text("relationship", _truth(TIES)), _relation)


def _present(label: str, score: str) -> str:
    return f"CASE WHEN max(CASE WHEN label = '{label}' THEN sup END) > 0 THEN max(CASE WHEN label = '{label}' THEN {score} END) END"


ONE_AP = "prec * rec + (1 - rec) * sup / total"


@query(
    "metric_pisc_map",
    _label_query(
        _truth_sql(TIES), f"CASE WHEN {NO_ANSWER} THEN NULL ELSE {_guess_sql(TIES)} END",
        {
            "mAP": f"sum(CASE WHEN {_in(TIES)} AND sup > 0 THEN {ONE_AP} END) / sum(CASE WHEN {_in(TIES)} AND sup > 0 THEN 1 END)",
            **{f"{m}_{key_of(c)}": _present(c, s) for c in TIES for m, s in (("ap", ONE_AP), ("recall", "rec"), ("f1", "f1"))},
        },
    ).replace("FROM lab GROUP BY", "FROM (SELECT *, sum(sup) OVER (PARTITION BY grp) AS total FROM lab) GROUP BY"),
)
def metric_pisc_map(spark, sf_dir):
    return _scored(spark, sf_dir, "pisc_map", lambda: _text("relationship", _truth(TIES)), _relation)


TRUTHFUL = rg.HONESTY


@query(
    "metric_rldd_accuracy",
    _label_query(
        _truth_sql(TRUTHFUL), _spelled(TRUTHFUL, "upper", "NULL"),
        {"accuracy": ACCURACY, "macro_f1": _over(TRUTHFUL, "f1"), **_each(TRUTHFUL)}, f"NOT {NO_ANSWER} AND event_id % 13 <> 0",
    ),
)
def metric_rldd_accuracy(spark, sf_dir):
    gt = lambda: F.when(_id() % 13 == 0, '{"label": null}').otherwise(_text("label", _truth(TRUTHFUL)))
    return _scored(spark, sf_dir, "rldd_accuracy", gt, lambda: _usual("label", TRUTHFUL, spelling=F.upper))


SOUNDS = rg.VOCAL_SOUNDS


@query(
    "metric_vocalsound_accuracy",
    _label_query(
        f"CASE WHEN event_id % 13 = 0 THEN '' ELSE {_truth_sql(SOUNDS)} END",
        f"CASE WHEN {NO_ANSWER} THEN '' ELSE {_guess_sql(SOUNDS)} END",
        {"accuracy": ACCURACY, "macro_f1": "avg(f1)", **_each(SOUNDS)},
    ),
)
def metric_vocalsound_accuracy(spark, sf_dir):
    def pred():
        label = _guess(SOUNDS)
        cases = {0: F.lit("{}"), 1: F.lit('{"class": null}'), 2: _text("sound", label), 3: _text("Vocal Sound", label), 4: _text("class", label)}
        cases[5] = F.concat(F.lit('{"vocal_sound": [], "sound": "'), label, F.lit('"}'))
        return _cases(cases, _text("vocal_sound", label))

    gt = lambda: F.when(_id() % 13 == 0, "{}").otherwise(_text("vocal_sound", _truth(SOUNDS)))
    return _scored(spark, sf_dir, "vocalsound_accuracy", gt, pred)


BINARY = {"accuracy": ACCURACY, "f1": _one("1", "f1"), "precision": _one("1", "prec"), "recall": _one("1", "rec")}


@query(
    "metric_videocoattention_detection_f1",
    _label_query("CAST(event_id % 2 AS VARCHAR)", "CASE WHEN value > 30 THEN '1' ELSE '0' END", BINARY, f"NOT {NO_ANSWER} AND event_id % 13 <> 0"),
)
def metric_videocoattention_detection_f1(spark, sf_dir):
    def pred():
        flag = F.col("value") > 30
        number = flag.cast("int").cast("string")
        wrap = lambda text: F.concat(F.lit('{"co_attention": '), text, F.lit("}"))
        cases = {
            0: F.lit("{}"), 1: wrap(F.lit('"maybe"')), 2: wrap(flag.cast("string")),
            3: wrap(F.concat(F.lit('" '), number, F.lit(' "'))), 4: wrap(F.concat(number, F.lit(".7"))),
        }
        return _cases(cases, wrap(number))

    gt = lambda: F.when(_id() % 13 == 0, '{"co_attention": "?"}').otherwise(F.concat(F.lit('{"co_attention": '), (_id() % 2).cast("string"), F.lit("}")))
    return _scored(spark, sf_dir, "videocoattention_detection_f1", gt, pred)


# The two that whole scoring runs use are here once more by themselves.


@query(
    "metric_mustard_f1",
    _label_query(
        "CAST(event_id % 2 AS VARCHAR)", "CASE WHEN value > 30 THEN '1' ELSE '0' END",
        {"accuracy": ACCURACY, "weighted_f1": "sum(f1 * sup) / sum(sup)", "macro_f1": "avg(f1)", "precision": _one("1", "prec"), "recall": _one("1", "rec")},
        f"NOT {NO_ANSWER}",
    ),
)
def metric_mustard_f1(spark, sf_dir):
    def pred():
        flag = (F.col("value") > 30).cast("string")
        return _cases({0: F.lit("{}"), 1: F.lit('{"sarcasm": "yes"}')}, F.concat(F.lit('{"sarcasm": '), flag, F.lit("}")))

    return _scored(spark, sf_dir, "mustard_f1", lambda: F.concat(F.lit('{"sarcasm": "'), (_id() % 2).cast("string"), F.lit('"}')), pred)


@query(
    "metric_urfunny_f1",
    _label_query(
        "CAST(event_id % 2 AS VARCHAR)", "CASE WHEN value > 30 THEN '1' ELSE '0' END",
        {"accuracy": ACCURACY, "macro_f1": "avg(f1)", "f1_funny": _one("1", "f1"), "f1_not_funny": _one("0", "f1")}, "event_id % 11 <> 0",
    ),
)
def metric_urfunny_f1(spark, sf_dir):
    def pred():
        word = F.when(F.col("value") > 30, " Funny").otherwise("not FUNNY ")
        flag = (F.col("value") > 30).cast("string")
        return _cases({0: F.lit('{"funny": "maybe"}'), 1: _text("funny", word)}, F.concat(F.lit('{"funny": '), flag, F.lit("}")))

    return _scored(spark, sf_dir, "urfunny_f1", lambda: F.concat(F.lit('{"funny": '), (_id() % 2).cast("string"), F.lit("}")), pred)


# Label sets -------------------------------------------------------------------


def _member(i: int, shift: int) -> Column:
    return F.floor(_id() / (i + shift)) % 3 == 0


def _member_sql(i: int, shift: int) -> str:
    return f"(event_id // {i + shift}) % 3 = 0"


def _names(classes: list[str], shift: int) -> Column:
    return F.array_compact(F.array(*[F.when(_member(i, shift), c) for i, c in enumerate(classes)]))


def _list_text(items: Column) -> Column:
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), F.array_join(items, '", "'), F.lit('"]')))


def _set_sql(classes: list[str], kinds: list[str], macro: dict[str, str], where: str, gt=None, pred=None, lower: bool = True, extra: str = "") -> str:
    gt = gt or (lambda i: _member_sql(i, 1))
    pred = pred or (lambda i: _member_sql(i, 2))
    flags = ", ".join(f"CASE WHEN {gt(i)} THEN 1 ELSE 0 END AS g{i}, CASE WHEN {pred(i)} THEN 1 ELSE 0 END AS p{i}" for i in range(len(classes)))
    sums = ", ".join(f"sum(g{i} * p{i}) AS t{i}, sum(g{i}) AS s{i}, sum(p{i}) AS r{i}" for i in range(len(classes)))
    term = {
        "f1": "CASE WHEN s{0} > 0 THEN 2 * t{0} / (s{0} + r{0}) END",
        "ap": "CASE WHEN s{0} > 0 THEN (CASE WHEN r{0} > 0 THEN t{0} / r{0} ELSE 0 END) * t{0} / s{0} + (1 - t{0} / s{0}) * s{0} / n END",
        "acc": "(n - s{0} - r{0} + 2 * t{0}) / n",
    }
    values = {f"{k}_{key_of(c) if lower else c}": term[k].format(i) for k in kinds for i, c in enumerate(classes)}
    for kind, name in macro.items():
        every = ", ".join(term[kind].format(i) for i in range(len(classes)))
        values[name] = f"list_avg(list_filter([{every}], lambda x: x IS NOT NULL))"
    if extra:
        values["exact_match_accuracy"] = "ex"
    same = f", avg(CASE WHEN {' AND '.join(f'g{i} = p{i}' for i in range(len(classes)))} THEN 1.0 ELSE 0.0 END) AS ex" if extra else ""
    return (
        f"WITH f AS (SELECT event_type AS grp, {flags} FROM events WHERE {where}), "
        f"wide AS (SELECT grp, count(*) AS n, {sums}{same} FROM f GROUP BY grp) " + unpivot("wide", ["grp"], values)
    )


def _units(classes: list[str]):
    gt = lambda: F.concat(F.lit('{"action_units": '), _list_text(_names(classes, 1)), F.lit("}"))
    pred = lambda: _cases({0: F.lit("{}")}, F.concat(F.lit('{"action_units": '), _list_text(_names(classes, 2)), F.lit("}")))
    return gt, pred


@query(
    "metric_affwild2_au_f1",
    _set_sql(rg.AU12, ["f1"], {"f1": "macro_au_f1"}, "true", pred=lambda i: f"event_id % 11 <> 0 AND {_member_sql(i, 2)}", lower=False),
)
def metric_affwild2_au_f1(spark, sf_dir):
    return _scored(spark, sf_dir, "affwild2_au_f1", *_units(rg.AU12))


@query("metric_mmew_au_f1", _set_sql(rg.AU17, ["f1"], {"f1": "macro_au_f1"}, "event_id % 11 <> 0", lower=False))
def metric_mmew_au_f1(spark, sf_dir):
    return _scored(spark, sf_dir, "mmew_au_f1", *_units(rg.AU17))


FEELINGS = rg.EMOTION_CATEGORIES
BY_ANNOTATOR = lambda i: f"CASE WHEN event_id % 13 = 0 THEN {_member_sql(i, 1)} ELSE {_member_sql(i, 1)} OR {_member_sql(i, 3)} END"


def _felt() -> Column:
    one, two = _list_text(_names(FEELINGS, 1)), _list_text(_names(FEELINGS, 3))
    several = F.concat(F.lit('{"emotions_per_annotator": ['), one, F.lit(", "), two, F.lit("]}"))
    return F.when(_id() % 13 == 0, F.concat(F.lit('{"emotions": '), one, F.lit("}"))).otherwise(several)


def _felt_guess() -> Column:
    twice = F.concat(_names(FEELINGS, 2), _names(FEELINGS, 2))
    return _cases({0: F.lit("{}")}, F.concat(F.lit('{"emotions": '), _list_text(twice), F.lit("}")))


@query(
    "metric_emotic_discrete_ap",
    _set_sql(FEELINGS, ["ap", "f1"], {"ap": "mAP"}, "true", gt=BY_ANNOTATOR, pred=lambda i: f"event_id % 11 <> 0 AND {_member_sql(i, 2)}"),
)
def metric_emotic_discrete_ap(spark, sf_dir):
    return _scored(spark, sf_dir, "emotic_discrete_ap", _felt, _felt_guess)


def _count_sql(test) -> str:
    return " + ".join(f"CASE WHEN {test(i)} THEN 1 ELSE 0 END" for i in range(len(FEELINGS)))


@query(
    "metric_emotic_discrete_jaccard",
    f"WITH c AS (SELECT event_type AS grp, {_count_sql(lambda i: f'({BY_ANNOTATOR(i)}) AND {_member_sql(i, 2)}')} AS both_n, "
    f"{_count_sql(lambda i: f'({BY_ANNOTATOR(i)}) OR {_member_sql(i, 2)}')} AS any_n FROM events WHERE event_id % 11 <> 0), "
    "wide AS (SELECT grp, count(*) AS n, avg(CASE WHEN any_n = 0 THEN 1.0 ELSE both_n / any_n END) AS j FROM c GROUP BY grp) "
    + unpivot("wide", ["grp"], {"mean_jaccard": "j"}),
)
def metric_emotic_discrete_jaccard(spark, sf_dir):
    return _scored(spark, sf_dir, "emotic_discrete_jaccard", _felt, _felt_guess)


TOUCH = rg.CONTACTS


def _touching() -> Column:
    return F.concat(F.lit('{"touching": '), _list_text(_names(TOUCH, 1)), F.lit("}"))


def _touching_guess() -> Column:
    items = _names(TOUCH, 2)
    nested = F.concat(F.lit("["), F.array_join(F.transform(items, lambda c: F.concat(F.lit('["'), c, F.lit('"]'))), ", "), F.lit("]"))
    cases = {
        0: F.lit('{"touching": "yes"}'), 1: F.lit("{}"),
        2: F.concat(F.lit('{"touching": [], "touching_body_parts": '), _list_text(items), F.lit("}")),
        3: F.concat(F.lit('{"touching": '), nested, F.lit("}")),
    }
    return _cases(cases, F.concat(F.lit('{"touching": '), _list_text(items), F.lit("}")))


GUESSED_TOUCH = lambda i: f"event_id % 11 <> 1 AND {_member_sql(i, 2)}"


@query("metric_proxemics_accuracy", _set_sql(TOUCH, ["acc"], {}, "event_id % 11 <> 0", pred=GUESSED_TOUCH, extra="exact"))
def metric_proxemics_accuracy(spark, sf_dir):
    return _scored(spark, sf_dir, "proxemics_accuracy", _touching, _touching_guess)


@query("metric_proxemics_map", _set_sql(TOUCH, ["ap", "f1"], {"ap": "mAP"}, "event_id % 11 <> 0", pred=GUESSED_TOUCH))
def metric_proxemics_map(spark, sf_dir):
    return _scored(spark, sf_dir, "proxemics_map", _touching, _touching_guess)


# Numbers ----------------------------------------------------------------------


def _number(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), value.cast("string"))


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def _near(a: int) -> Column:
    """A number with three decimals between 0 and 1."""
    return (_id() * a % 1001).cast("decimal(10,3)") / F.lit(1000).cast("decimal(4,0)")


def _near_sql(a: int) -> str:
    return f"(event_id * {a} % 1001) / 1000.0"


def _ccc_sql(x: str, y: str) -> str:
    x, y = (f"CAST(CAST({v} AS FLOAT) AS DOUBLE)" for v in (x, y))
    spread = f"(var_pop({x}) + var_pop({y}) + (avg({x}) - avg({y})) * (avg({x}) - avg({y})))"
    return f"CASE WHEN {spread} < 1e-10 THEN 0 ELSE 2 * covar_pop({x}, {y}) / {spread} END"


@query(
    "metric_affwild2_va_ccc",
    f"WITH wide AS (SELECT event_type AS grp, count(*) AS n, {_ccc_sql(_near_sql(41), _near_sql(43))} AS v, {_ccc_sql(_near_sql(53), _near_sql(59))} AS a "
    f"FROM events WHERE event_id % 11 NOT IN (0, 1) GROUP BY grp) " + unpivot("wide", ["grp"], {"ccc_valence": "v", "ccc_arousal": "a", "ccc_mean": "(v + a) / 2"}),
)
def metric_affwild2_va_ccc(spark, sf_dir):
    def pred():
        valence, arousal = _near(41), _near(53)
        quoted = F.concat(F.lit('"valence": " '), valence.cast("string"), F.lit('"'))
        cases = {0: _object(_number("arousal", arousal)), 1: F.lit('{"valence": "high", "arousal": 1}'), 2: _object(quoted, _number("arousal", arousal))}
        return _cases(cases, _object(_number("valence", valence), _number("arousal", arousal)))

    return _scored(spark, sf_dir, "affwild2_va_ccc", lambda: _object(_number("valence", _near(43)), _number("arousal", _near(59))), pred)


DIMS = ["arousal", "valence", "dominance"]
GIVEN = dict(zip(DIMS, (41, 43, 47)))
ASKED = dict(zip(DIMS, (53, 59, 61)))


def _two_annotators() -> Column:
    one = _object(*[_number(d, _near(GIVEN[d])) for d in DIMS])
    two = _object(*[_number(d, _near(ASKED[d])) for d in DIMS[:2]])
    return F.concat(F.lit('{"vad_per_annotator": ['), one, F.lit(", "), two, F.lit("]}"))


# The second annotator gives no dominance.
MEAN = {d: f"(({_near_sql(GIVEN[d])}) + ({_near_sql(ASKED[d])})) / 2" for d in DIMS[:2]} | {"dominance": _near_sql(GIVEN["dominance"])}
PREDICTED = dict(zip(DIMS, (67, 71, 73)))


def _vad_guess(cases: dict[int, Column]) -> Column:
    return _cases(cases, _object(*[_number(d, _near(PREDICTED[d])) for d in DIMS]))


@query(
    "metric_msppodcast_vad_ccc",
    "WITH wide AS (SELECT event_type AS grp, count(*) AS n, "
    + ", ".join(f"{_ccc_sql(_near_sql(PREDICTED[d]), MEAN[d])} AS {d[0]}" for d in DIMS)
    + " FROM events WHERE event_id % 11 <> 0 GROUP BY grp) "
    + unpivot("wide", ["grp"], {**{f"ccc_{d}": d[0] for d in DIMS}, "ccc_mean": "(a + v + d) / 3"}),
)
def metric_msppodcast_vad_ccc(spark, sf_dir):
    def pred():
        first = F.concat(F.lit('"arousal": ['), _near(PREDICTED["arousal"]).cast("string"), F.lit(", 0]"))
        rest = [_number(d, _near(PREDICTED[d])) for d in DIMS[1:]]
        return _vad_guess({0: _object(*rest), 2: _object(first, *rest)})

    return _scored(spark, sf_dir, "msppodcast_vad_ccc", _two_annotators, pred)


def _aae_sql(order: list[str], truth: dict[str, str], missing: dict[str, str], where: str) -> str:
    """``missing``: when a dimension, and all after it, is not counted."""
    errors = ", ".join(f"CASE WHEN NOT ({missing[d]}) THEN abs({_near_sql(PREDICTED[d])} - {truth[d]}) END AS e{i}" for i, d in enumerate(order))
    values = {f"aae_{d}": f"m{i}" for i, d in enumerate(order)}
    values["aae_mean"] = "CASE WHEN n > 0 THEN (s0 + s1 + s2) / (n + n1 + n2) END"
    return (
        f"WITH e AS (SELECT event_type AS grp, {errors} FROM events WHERE {where}), "
        "wide AS (SELECT grp, count(e0) AS n, count(e1) AS n1, count(e2) AS n2, avg(e0) AS m0, avg(e1) AS m1, avg(e2) AS m2, "
        "coalesce(sum(e0), 0) AS s0, coalesce(sum(e1), 0) AS s1, coalesce(sum(e2), 0) AS s2 FROM e GROUP BY grp) " + unpivot("wide", ["grp"], values)
    )


ORDER = ["valence", "arousal", "dominance"]


@query(
    "metric_emotic_vad_aae",
    _aae_sql(ORDER, MEAN, {"valence": "event_id % 11 = 0", "arousal": "event_id % 11 IN (0, 1)", "dominance": "event_id % 11 IN (0, 1, 2)"}, "true"),
)
def metric_emotic_vad_aae(spark, sf_dir):
    def pred():
        member = {d: _number(d, _near(PREDICTED[d])) for d in ORDER}
        return _vad_guess({0: _object(member["arousal"], member["dominance"]), 1: _object(member["valence"], member["dominance"]), 2: _object(member["valence"], member["arousal"])})

    return _scored(spark, sf_dir, "emotic_vad_aae", _two_annotators, pred)


@query("metric_msppodcast_vad_aae", _aae_sql(DIMS, MEAN, {d: "false" for d in DIMS}, "event_id % 11 <> 0"))
def metric_msppodcast_vad_aae(spark, sf_dir):
    return _scored(spark, sf_dir, "msppodcast_vad_aae", _two_annotators, lambda: _vad_guess({0: _object(_number("arousal", _near(67)))}))


@query(
    "metric_voxconverse_speaker_count_mae",
    "WITH wide AS (SELECT event_type AS grp, count(*) AS n, avg(abs(event_id % 5 - CAST(floor(value) AS BIGINT) % 5)) AS m, "
    "avg(CASE WHEN event_id % 5 = CAST(floor(value) AS BIGINT) % 5 THEN 1.0 ELSE 0.0 END) AS x FROM events WHERE event_id % 11 <> 0 GROUP BY grp) "
    + unpivot("wide", ["grp"], {"mae": "m", "exact_accuracy": "x"}),
)
def metric_voxconverse_speaker_count_mae(spark, sf_dir):
    def pred():
        count = (F.floor("value").cast("long") % 5).cast("string")
        return _cases({0: F.lit('{"num_speakers": "two"}'), 1: _text("num_speakers", count)}, F.concat(F.lit('{"num_speakers": '), count, F.lit("}")))

    return _scored(spark, sf_dir, "voxconverse_speaker_count_mae", lambda: F.concat(F.lit('{"num_speakers": '), (_id() % 5).cast("string"), F.lit("}")), pred)


AUC = (
    "r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS place FROM p), "
    "wide AS (SELECT grp, count(*) AS n, (sum(CASE WHEN gt = 1 THEN place END) - sum(gt) * (sum(gt) + 1) / 2) / (sum(gt) * (count(*) - sum(gt))) AS auc FROM r GROUP BY grp) "
)


@query(
    "metric_rldd_auc",
    "WITH p AS (SELECT event_type AS grp, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS gt, "
    f"CASE WHEN event_id % 11 = 1 THEN CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END ELSE {_near_sql(41)} END AS score FROM events WHERE event_id % 11 <> 0), "
    + AUC + unpivot("wide", ["grp"], {"auc": "auc"}),
)
def metric_rldd_auc(spark, sf_dir):
    def pred():
        word = F.when(F.col("value") > 30, "deceptive").otherwise("truthful")
        return _cases({0: F.lit("{}"), 1: _text("label", word)}, _object(_number("confidence", _near(41))))

    return _scored(spark, sf_dir, "rldd_auc", lambda: _text("label", F.when(_id() % 2 == 0, "deceptive").otherwise("truthful")), pred)


def _point_text(a: int, b: int) -> Column:
    return F.concat(F.lit("["), (_id() * a % 1001).cast("string"), F.lit(", "), (_id() * b % 1001).cast("string"), F.lit("]"))


def _gap(a: int, b: int) -> str:
    xs = f"(event_id * {a} % 1001 - event_id * 67 % 1001) / 1000.0"
    ys = f"(event_id * {b} % 1001 - event_id * 71 % 1001) / 1000.0"
    return f"sqrt(({xs}) * ({xs}) + ({ys}) * ({ys}))"


@query(
    "metric_gazefollow_distance",
    f"WITH wide AS (SELECT event_type AS grp, count(*) AS n, avg(CASE WHEN event_id % 13 = 0 THEN {_gap(41, 43)} ELSE least({_gap(41, 43)}, {_gap(53, 59)}) END) AS lo, "
    f"avg(CASE WHEN event_id % 13 = 0 THEN {_gap(41, 43)} ELSE ({_gap(41, 43)} + {_gap(53, 59)}) / 2 END) AS mid FROM events WHERE event_id % 11 NOT IN (0, 1) GROUP BY grp) "
    + unpivot("wide", ["grp"], {"min_dist": "lo", "avg_dist": "mid"}),
)
def metric_gazefollow_distance(spark, sf_dir):
    def gt():
        several = F.concat(F.lit('{"gaze_points": ['), _point_text(41, 43), F.lit(", "), _point_text(53, 59), F.lit("]}"))
        return F.when(_id() % 13 == 0, F.concat(F.lit('{"gaze_point": '), _point_text(41, 43), F.lit("}"))).otherwise(several)

    pred = lambda: _cases({0: F.lit("{}"), 1: F.lit('{"gaze_point": [5]}')}, F.concat(F.lit('{"gaze_point": '), _point_text(67, 71), F.lit("}")))
    return _scored(spark, sf_dir, "gazefollow_distance", gt, pred)


# Naive baselines of several tasks in one report ---------------------------------

TRAINING = "md5('42|' || event_id) < 'c'"
UNIT = lambda i: f"(event_id // {i + 1}) % 3 {'< 2' if i % 2 == 0 else '= 0'}"


def _mode_sql(value: str) -> str:
    return f"(SELECT v FROM (SELECT {value} AS v, count(*) AS n, min(event_id) AS f FROM events WHERE {TRAINING} GROUP BY 1) ORDER BY n DESC, f LIMIT 1)"


def _report_sql() -> str:
    test = f"NOT {TRAINING}"
    flag = "CASE WHEN event_id % 3 = 0 THEN '1' ELSE '0' END"
    outputs = {
        "accuracy": ACCURACY, "weighted_f1": "sum(f1 * sup) / sum(sup)", "macro_f1": "avg(f1)", "precision": _one("1", "prec"), "recall": _one("1", "rec"),
    }
    parts = [label_sql(f"SELECT 'mustard_context' AS baseline_key, {flag} AS gt, {_mode_sql(flag)} AS pred FROM events WHERE {test}", ["baseline_key"], outputs)]
    count = _mode_sql("event_id % 5")
    parts.append(
        f"WITH wide AS (SELECT 'voxconverse_speaker' AS baseline_key, count(*) AS n, avg(abs(event_id % 5 - {count})) AS m, avg(CASE WHEN event_id % 5 = {count} THEN 1.0 ELSE 0.0 END) AS x "
        f"FROM events WHERE {test}) " + unpivot("wide", ["baseline_key"], {"mae": "m", "exact_accuracy": "x"})
    )
    gap = "sqrt((0.5 - event_id * 41 % 1001 / 1000.0) ** 2 + (0.5 - event_id * 43 % 1001 / 1000.0) ** 2)"
    parts.append(
        f"WITH wide AS (SELECT 'gazefollow' AS baseline_key, count(*) AS n, avg({gap}) AS d FROM events WHERE {test}) " + unpivot("wide", ["baseline_key"], {"min_dist": "d", "avg_dist": "d"})
    )
    touch = ", ".join(f"sum(CASE WHEN {_member_sql(i, 1)} THEN 1 ELSE 0 END) AS s{i}" for i in range(len(TOUCH)))
    ap, f1 = "CASE WHEN s{0} > 0 THEN s{0} / n END", "CASE WHEN s{0} > 0 THEN 2 * s{0} / (s{0} + n) END"
    values = {f"ap_{key_of(c)}": ap.format(i) for i, c in enumerate(TOUCH)} | {f"f1_{key_of(c)}": f1.format(i) for i, c in enumerate(TOUCH)}
    values["mAP"] = f"list_avg(list_filter([{', '.join(ap.format(i) for i in range(len(TOUCH)))}], lambda x: x IS NOT NULL))"
    parts.append(f"WITH wide AS (SELECT 'proxemics_skel' AS baseline_key, count(*) AS n, {touch} FROM events WHERE {test}) " + unpivot("wide", ["baseline_key"], values))
    error = {d: f"abs({_near_sql(GIVEN[d])} - (SELECT avg({_near_sql(GIVEN[d])}) FROM events WHERE {TRAINING}))" for d in ORDER}
    sums = ", ".join(f"avg({error[d]}) AS m{i}" for i, d in enumerate(ORDER))
    values = {f"aae_{d}": f"m{i}" for i, d in enumerate(ORDER)} | {"aae_mean": "(m0 + m1 + m2) / 3"}
    parts.append(f"WITH wide AS (SELECT 'emotic_vad' AS baseline_key, count(*) AS n, {sums} FROM events WHERE {test}) " + unpivot("wide", ["baseline_key"], values))
    often = ", ".join(
        f"(SELECT avg(CASE WHEN {UNIT(i)} THEN 1.0 ELSE 0.0 END) > 0.5 FROM events WHERE {TRAINING}) AS o{i}, sum(CASE WHEN {UNIT(i)} THEN 1 ELSE 0 END) AS s{i}" for i in range(len(rg.AU12))
    )
    score = "CASE WHEN s{0} > 0 THEN CASE WHEN o{0} THEN 2 * s{0} / (s{0} + n) ELSE 0 END END"
    values = {f"f1_{c}": score.format(i) for i, c in enumerate(rg.AU12)}
    values["macro_au_f1"] = f"list_avg(list_filter([{', '.join(score.format(i) for i in range(len(rg.AU12)))}], lambda x: x IS NOT NULL))"
    parts.append(f"WITH wide AS (SELECT 'affwild2_au' AS baseline_key, count(*) AS n, {often} FROM events WHERE {test}) " + unpivot("wide", ["baseline_key"], values))
    parts.append("SELECT 'meview' AS baseline_key, 'uar' AS metric, round(1 / 6, 6) AS value, CAST(0 AS BIGINT) AS n_used")
    return " UNION ALL ".join(f"SELECT baseline_key, metric, value, n_used FROM ({p})" for p in parts)


@query("baseline_report", _report_sql())
def baseline_report(spark, sf_dir):
    from tallyframe.functions import messages as ms
    from tallyframe.operators.ordered import hash_order
    from tallyframe.plans import baselines as bl

    units = F.array_compact(F.array(*[F.when((F.floor(_id() / (i + 1)) % 3 < 2) if i % 2 == 0 else (F.floor(_id() / (i + 1)) % 3 == 0), c) for i, c in enumerate(rg.AU12)]))
    answers = {
        "mustard-omni_video-context": F.concat(F.lit('{"sarcasm": '), (_id() % 3 == 0).cast("string"), F.lit("}")),
        "voxconverse-omni_speaker-count": _object(_number("num_speakers", _id() % 5)),
        "gazefollow-vlm": F.concat(F.lit('{"gaze_point": '), _point_text(41, 43), F.lit("}")),
        "proxemics-vlm_skeleton": _touching(),
        "emotic-vlm_vad": _object(*[_number(d, _near(GIVEN[d])) for d in ORDER]),
        "affwild2-omni_au": F.concat(F.lit('{"action_units": '), _list_text(units), F.lit("}")),
        "nothing known": F.lit("{}"),
    }
    events = Tables(spark, sf_dir).events
    split = F.when(hash_order(42, "event_id") < "c", "train").otherwise("test")
    tasks = F.inline(F.array(*[F.struct(F.lit(t).alias("task"), a.alias("answer")) for t, a in answers.items()]))
    rows = events.select(split.alias("split"), _id().alias("row_idx"), tasks)
    truth = rows.select("task", "split", "row_idx", ms.build_messages("judge", "now", F.col("answer")).alias("messages"))
    return scores(bl.baseline_report(truth))


# Points and boxes that other queries compare without JSON: the same rows as answers.


def _points_scored(spark, folder: str, name: str) -> DataFrame:
    rows = _points(Tables(spark, folder)).select(
        "grp",
        F.try_parse_json(F.to_json(F.struct(F.col("gt").alias("gaze_points")))).alias("gt"),
        F.try_parse_json(F.to_json(F.struct(F.col("pred").alias("gaze_point")))).alias("pred"),
        "head",
    )
    return scores(rg.run_metric(name, rows, ["grp"]))


@query("metric_gazefollow_angular_error", ORACLES["gaze_angle"])
def metric_gazefollow_angular_error(spark, sf_dir):
    return _points_scored(spark, sf_dir, "gazefollow_angular_error")


@query("metric_gazefollow_auc", ORACLES["heatmap_auc"])
def metric_gazefollow_auc(spark, sf_dir):
    return _points_scored(spark, sf_dir, "gazefollow_auc")


@query("metric_videocoattention_localization_iou", ORACLES["bbox_iou"].replace("AS g3 FROM events)", "AS g3 FROM events WHERE event_id % 11 <> 0)"))
def metric_videocoattention_localization_iou(spark, sf_dir):
    at = lambda a: (_id() * a % 1001).cast("string")
    low, high = (lambda a, b, f=f: f(_id() * a % 1001, _id() * b % 1001).cast("string") for f in (F.least, F.greatest))
    box = lambda *v: F.concat(F.lit('{"bbox": ['), F.concat_ws(", ", *v), F.lit("]}"))
    gt = lambda: box(low(41, 97), low(43, 89), high(41, 97), high(43, 89))
    pred = lambda: _cases({0: box(at(13), at(17), at(29))}, box(at(13), at(17), at(29), at(31)))
    return _scored(spark, sf_dir, "videocoattention_localization_iou", gt, pred)


@query(
    "metric_videoattentiontarget_distance",
    f"WITH wide AS (SELECT event_type AS grp, count(*) AS n, avg({_gap(41, 43)}) AS d FROM events WHERE event_id % 5 <> 0 AND event_id % 11 NOT IN (0, 1, 2) GROUP BY grp) "
    + unpivot("wide", ["grp"], {"dist": "d"}),
)
def metric_videoattentiontarget_distance(spark, sf_dir):
    out = F.when(_id() % 5 == 0, '"out_of_frame": true, ').otherwise("")
    point = F.concat(F.lit('"gaze_point": '), _point_text(67, 71), F.lit("}"))
    cases = {
        0: F.concat(F.lit('{"out_of_frame": 1, '), point), 1: F.lit('{"gaze_point": [1, 2, 3]}'), 2: F.lit("{}"),
        3: F.concat(F.lit('{"out_of_frame": false, '), point),
    }
    gt = lambda: F.concat(F.lit("{"), out, F.lit('"gaze_point": '), _point_text(41, 43), F.lit("}"))
    return _scored(spark, sf_dir, "videoattentiontarget_distance", gt, lambda: _cases(cases, F.concat(F.lit("{"), point)))


OUTSIDE = (
    "SELECT event_type AS grp, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS gt, CASE WHEN value > 30 THEN 1 ELSE 0 END AS flag, "
    f"CASE WHEN event_id % 11 IN (0, 1) THEN CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END ELSE {_near_sql(41)} END AS score FROM events"
)


@query(
    "metric_videoattentiontarget_out_of_frame_ap",
    AP_SQL.format(pairs=OUTSIDE, by="grp") + unpivot("wide", ["grp"], {"out_of_frame_ap": "v"})
    + f" UNION ALL SELECT grp, 'out_of_frame_f1' AS metric, round(2.0 * sum(gt * flag) / (sum(gt) + sum(flag)), 6) AS value, CAST(count(*) AS BIGINT) AS n_used FROM ({OUTSIDE}) GROUP BY grp HAVING sum(gt) > 0",
)
def metric_videoattentiontarget_out_of_frame_ap(spark, sf_dir):
    flag = (F.col("value") > 30).cast("string")
    bare = F.concat(F.lit('{"out_of_frame": '), flag, F.lit("}"))
    given = F.concat(F.lit('{"out_of_frame": '), flag, F.lit(', "out_of_frame_score": '), _near(41).cast("string"), F.lit("}"))
    unset = F.when(F.col("value") > 30, '{"out_of_frame": "yes"}').otherwise('{"out_of_frame": ""}')
    gt = lambda: F.when(_id() % 5 == 0, '{"out_of_frame": true}').otherwise("{}")
    return _scored(spark, sf_dir, "videoattentiontarget_out_of_frame_ap", gt, lambda: _cases({0: bare, 1: unset}, given))


@query("metric_voxconverse_der", ORACLES["der"])
def metric_voxconverse_der(spark, sf_dir):
    # Read for the groups and for the scores: written once.
    rows = staged(_timelines(Tables(spark, sf_dir)), [])
    sides = {s: F.try_parse_json(F.to_json(F.struct(F.col(s).alias("timeline")))) for s in ("gt", "pred")}
    return scores(rg.run_metric("voxconverse_der", rows.select("clip", *[c.alias(s) for s, c in sides.items()]), ["clip"]))

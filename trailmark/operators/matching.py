"""Match events to funnel steps: the first step, in order, any of whose rules holds.

Expressions are SQL texts: matching stands below most reports, and its plan is made anew for each of them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.params import SCOPE
from trailmark.sources.definitions import Definitions

FUNNEL_COLUMNS = ["funnel_id", "funnel_version_id", "window_days", "total_steps"]
STEP = [*FUNNEL_COLUMNS, "order_index", "step_type"]
NAMED = ("event_name", "page_url", "page_title", "utm_source", "custom_property")
STORED = ("page", "event")
OPERATORS = ("eq", "equals", "contains", "starts_with", "in", "greater_than", "less_than")
# Fixed value: characters of a pattern that stand for themselves.
SPECIAL = r"([\\\.\[\]\{\}\(\)\+\-\^\$\|&#~])"
KEPT = r"\\$1"
# An event's properties as texts, and as JSON texts that keep the type.
PROPERTIES = {"_texts": "from_json(props, 'map<string, string>')",
              "_values": "transform_values(from_json(props, 'map<string, variant>'), (k, v) -> to_json(v))"}


def parsed_rules(definitions: DataFrame) -> DataFrame:
    """Rule rows with the fields of their JSON; what is missing or malformed is null. Values keep their JSON type:
    `"1"` is a text, `1` a number."""
    fields = ("event_name string, pattern string, source string, property string, value variant, "
              "url_match struct<type: string, value: string>, prop_filters array<struct<key: string, operator: string, value: variant>>")
    wild = f"replace(replace(regexp_replace(_r.pattern, r'{SPECIAL}', r'{KEPT}'), '*', '.*'), '?', '.')"
    rule = f"""struct(kind, _r.event_name as event, _r.pattern as pattern,
        case when contains(_r.pattern, '*') then concat('(?is)^', {wild}, '$') end as regex,
        _r.source as source, _r.property as property, to_json(_r.value) as value, _r.url_match.type as how, _r.url_match.value as url,
        transform(_r.prop_filters, f -> struct(f.key as key, coalesce(f.operator, 'eq') as operator, to_json(f.value) as value,
            from_json(to_json(f.value), 'array<variant>') as list)) as filters) as _rule"""
    return definitions.selectExpr("*", f"from_json(rules, '{fields}') as _r").selectExpr(*definitions.columns, rule)


def bad_rules(definitions: DataFrame) -> DataFrame:
    """funnel_version_id, order_index, violation of rules that can never match: malformed, incomplete or unknown."""
    r = F.col("_rule")
    lacks = (
        F.when(F.col("kind") == "event_name", r["event"].isNull())
        .when(F.col("kind").isin("page_url", "page_title"), r["pattern"].isNull())
        .when(F.col("kind") == "utm_source", r["source"].isNull())
        .when(F.col("kind") == "custom_property", r["property"].isNull() | r["value"].isNull())
        .when(F.col("kind").isin(*STORED), r["event"].isNull() & r["how"].isNull() & r["filters"].isNull()))
    operator = F.exists(r["filters"], lambda f: ~f["operator"].isin(*OPERATORS))
    violation = (
        F.when(~F.col("kind").isin(*NAMED, *STORED), "unknown_kind").when(F.try_parse_json("rules").isNull(), "malformed_rule")
        .when(lacks, "incomplete_rule").when(operator, "unknown_operator"))
    rows = parsed_rules(definitions.where("kind is not null")).withColumn("violation", violation)
    return rows.where("violation is not null").select("funnel_version_id", "order_index", "violation")


# ---------------------------------------------------------------- the index
PATTERNS = "w:"
ALTERNATIONS = ("_url_lower", "_url_regex", "_url_part", "_title_lower", "_title_regex")


def _json_key(value: str) -> str:
    """One text for all JSON texts that are the same value: numbers by value, everything else by type and text."""
    return f"coalesce(concat('d', cast(try_cast({value} as double) + 0D as string)), concat('j', {value}))"


def _property_key(name: str, value: str) -> str:
    return f"concat('p:', {name}, '\\u0001', {_json_key(value)})"


def rule_index(definitions: DataFrame) -> DataFrame:
    """The rules of each workspace by what an event must have to meet them: one row per (workspace, key).

    Keys are an event name (`n:`), a page address (`u:`) or a source (`s:`) that a rule asks for as it is. The row `w:` of
    the workspace itself holds, in a map, the rules that ask for a property's value (`p:`) or a property (`k:`), and
    those with patterns, with one alternation of all their patterns for lower-case addresses and titles and for those
    as they are, which tells whether any of them can hold. Rules that can match nothing have no key and are left out.
    """
    stored = f"kind in {STORED}"
    literal = lambda c: f"concat('(?:', replace(replace(regexp_replace({c}, r'{SPECIAL}', r'{KEPT}'), '?', r'\\?'), '*', r'\\*'), ')')"
    key = f"""case when kind = 'event_name' then concat('n:', _rule.event) when kind = 'utm_source' then concat('s:', _rule.source)
        when kind = 'custom_property' then {_property_key('_rule.property', '_rule.value')}
        when kind in ('page_url', 'page_title') then if(_rule.pattern is not null, '{PATTERNS}', null)
        when not {stored} then null when _rule.event is not null then concat('n:', _rule.event)
        when _rule.how = 'exact' then concat('u:', _rule.url) when _rule.how is not null then if(_rule.url is not null, '{PATTERNS}', null)
        when size(_rule.filters) > 0 then concat('k:', _rule.filters[0].key) when _rule.filters is not null then '{PATTERNS}' end"""
    whole = f"""kind in ('event_name', 'utm_source', 'custom_property')
        or {stored} and _rule.how is null and _rule.filters is null"""
    entry = f"struct({', '.join(STEP)}, if({whole}, null, _rule) as test)"
    lowered = lambda subject: f"case when kind = '{subject}' and _rule.regex is null then {literal('lower(_rule.pattern)')} end"
    regex = lambda subject: f"case when kind = '{subject}' then concat('(?:', _rule.regex, ')') end"
    keyed = parsed_rules(definitions).selectExpr(
        *SCOPE, f"{key} as _key", f"{entry} as _entry", f"{lowered('page_url')} as _url_lower", f"{regex('page_url')} as _url_regex",
        f"case when {stored} then {literal('_rule.url')} end as _url_part", f"{lowered('page_title')} as _title_lower",
        f"{regex('page_title')} as _title_regex", f"{stored} and _rule.how is null as _always",
        "_rule.filters is not null as _filters").where("_key is not null")
    grouped = keyed.groupBy(*SCOPE, "_key").agg(
        F.collect_list("_entry").alias("_rules"), F.expr("bool_or(_always)").alias("_always"), F.expr("bool_or(_filters)").alias("_filters"),
        *(F.expr(f"array_join(collect_list({c}), '|')").alias(c) for c in ALTERNATIONS))
    named = "left(_key, 2) in ('p:', 'k:')"
    return grouped.groupBy(*SCOPE, F.expr(f"if({named}, '{PATTERNS}', _key)").alias("_key")).agg(
        F.expr(f"flatten(collect_list(_rules) filter (where not {named}))").alias("_rules"),
        F.expr(f"map_from_entries(collect_list(struct(_key, _rules)) filter (where {named}))").alias("_named"),
        F.expr("bool_or(_filters)").alias("_filters"), F.expr("bool_or(_always)").alias("_always"),
        *(F.expr(f"max({c})").alias(c) for c in ALTERNATIONS))


def match_funnel_events(events: DataFrame, definitions: Definitions) -> DataFrame:
    """One row per (event, funnel) with the matched step, for every published funnel of its workspace.

    An event meets only rules that it has the key of: equi-joins on its name, address and source, and lookups of its
    properties, bring their rules (see `rule_index`); what else such a rule asks is looked at then. Properties are parsed
    only where rules need them. Batch and stream alike; a rule that cannot be read matches nothing.

    The index is as large as the definitions, a small dimension, and is broadcast: Spark cannot tell its size before it
    runs, and a shuffle by the keys of rules brings all events of a workspace into one task, which later steps then inherit.
    """
    columns, index = events.columns, rule_index(definitions.load().where("kind is not null"))
    none = f"cast(array() as {index.schema['_rules'].dataType.simpleString()})"
    rows = events
    for slot, key in (("n", "concat('n:', event_name)"), ("u", "concat('u:', page.url)"), ("s", "concat('s:', utm.source)"), ("w", f"'{PATTERNS}'")):
        more = ["_named", "_always", *ALTERNATIONS] if slot == "w" else []
        side = index.selectExpr(*(f"{c} as _{slot}_{c}" for c in (*SCOPE, "_key")), f"_rules as _{slot}", f"_filters as _{slot}_filters", *more)
        rows = rows.join(F.broadcast(side), F.expr(f"_{slot}__key = {key} and " + " and ".join(f"_{slot}_{c} = {c}" for c in SCOPE)), "left")
    has = lambda text, regex: f"coalesce({regex} <> '' and regexp_instr({text}, {regex}) > 0, false)"
    can_hold = " or ".join(["coalesce(_always, false)", has("lower(page.url)", "_url_lower"), has("page.url", "_url_regex"),
                            has("page.url", "_url_part"), has("lower(page.title)", "_title_lower"), has("page.title", "_title_regex")])
    by_property = "coalesce(size(_named) > 0, false)"
    met = ", ".join(f"coalesce({rules}, {none})" for rules in ("_n", "_u", "_s", f"if({can_hold}, _w, null)"))
    of_property = f"flatten(transform(map_entries(_values), e -> array({_property_key('e.key', 'e.value')}, concat('k:', e.key))))"
    looked_up = f"flatten(filter(transform({of_property}, k -> try_element_at(_named, k)), x -> x is not null))"
    parsed = f"{by_property} or " + " or ".join(f"coalesce(_{slot}_filters, false)" for slot in "nusw")
    steps = f"array_sort(transform(filter(_met, c -> c.test is null or coalesce({_holds('c.test')}, false)), c -> struct({', '.join('c.' + c for c in STEP)})))"
    first = "k = 0 or h.funnel_id <> _hits[k - 1].funnel_id or h.funnel_version_id <> _hits[k - 1].funnel_version_id"
    firsts = f"if(size(_hits) < 2, _hits, filter(_hits, (h, k) -> {first}))"
    rows = rows.selectExpr(*columns, f"if({by_property}, _named, null) as _named", f"concat({met}) as _met",
                           *(f"if({parsed}, {value}, null) as {name}" for name, value in PROPERTIES.items()))
    rows = rows.selectExpr(*columns, "_texts", "_values", f"if(_named is not null and _values is not null, concat(_met, {looked_up}), _met) as _met")
    # an outer explode: before a plain one, Spark would filter on the whole expression a second time
    rows = rows.selectExpr(*columns, f"{steps} as _hits").selectExpr(*columns, f"explode_outer({firsts}) as _hit").where("_hit is not null")
    return rows.selectExpr(*columns, *(f"_hit.{c} as {c}" for c in FUNNEL_COLUMNS), "_hit.order_index as step_order", "_hit.step_type as step_type")


def property_predicate(key: str, operator: str, value: object) -> Column:
    """One condition on an event property, as in a rule."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    wanted = text(json.dumps(value))
    wish = f"named_struct('key', {text(key)}, 'operator', '{operator}', 'value', {wanted}, 'list', from_json({wanted}, 'array<variant>'))"
    return F.expr(_condition(wish, **PROPERTIES))


def _same(actual: str, wanted: str) -> str:
    """Equal as JSON values: numbers by value, everything else by type and text."""
    return f"({actual} = {wanted} or coalesce(try_cast({actual} as double) = try_cast({wanted} as double), false))"


def _holds(r: str) -> str:
    """What a rule asks besides its key."""
    def like(value: str) -> str:
        return f"if({r}.regex is not null, rlike({value}, {r}.regex), contains(lower({value}), lower({r}.pattern)))"

    return f"""case {r}.kind when 'page_url' then {like('page.url')} when 'page_title' then {like('page.title')} else
        ({r}.event is null or event_name = {r}.event)
        and ({r}.how is null or if({r}.how = 'exact', page.url = {r}.url, contains(page.url, {r}.url)))
        and ({r}.filters is null or forall({r}.filters, f -> {_condition('f')})) end"""


def _condition(f: str, _texts: str = "_texts", _values: str = "_values") -> str:
    """One condition on an event property; an unknown operator never holds."""
    actual, value = f"try_element_at({_texts}, {f}.key)", f"try_element_at({_values}, {f}.key)"
    wanted = f"regexp_replace({f}.value, '^\"|\"$', '')"
    number = lambda x: f"try_cast({x} as double)"
    return f"""coalesce(case when {f}.operator in ('eq', 'equals') then {_same(value, f + '.value')}
        when {f}.operator = 'contains' then contains({actual}, {wanted}) when {f}.operator = 'starts_with' then startswith({actual}, {wanted})
        when {f}.operator = 'in' then exists({f}.list, x -> {_same(value, 'to_json(x)')})
        when {f}.operator = 'greater_than' then {number(actual)} > {number(wanted)}
        when {f}.operator = 'less_than' then {number(actual)} < {number(wanted)} end, false)"""

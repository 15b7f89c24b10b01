"""Chat formatting with tool-call linking. DataFrame functions only.

Messages are rows (conv_id, turn, role, text). A text that is a JSON object with one of the keys ``content``, ``tool_calls``,
``tool_call_id`` and ``tools`` is a message body; any other text is plain content. ``tool_calls`` lists objects with id, name
and arguments, or with id and a ``function`` of name and arguments (also as a JSON string); ``tool_call_id`` marks the result of a
call; ``tools`` lists objects (or their ``function``) with name and parameters, a JSON schema.

Calls and results are hash-joined by (conv_id, identifier). A result comes after the message that holds its call, which may be
a result itself: a message's anchor is the turn of the first message of its chain, its depth the number of calls between, and
(anchor_turn, depth, turn) is a topological order. Chains are followed by doubling, in joins. Arguments are checked against the
schema that the conversation declares, a join and a level of it per round: KEYWORDS lists what is checked. Messages stay one row
each, so that a conversation of any length is never gathered into one task.

Defined cases: a null text is empty content; a null role is ``unknown``; invalid JSON is plain content; very long texts are read
whole; a body keeps all its keys, its own role and turn as ``_role`` and ``_turn``; of repeated call identifiers the one of the
earliest turn is linked to, then the smaller hash; a result without a call is ``orphan`` and stays where it was; so does a
result whose chain of calls runs in a circle (``cyclic``); a call without a result is ``pending``; a tool without a schema validates
as null, and so does one whose schema holds other keywords, or a pattern beyond PLAIN_PATTERN, if all else fits; repeated messages stay repeated and link alike; of several schemas for a tool the earliest turn's holds; null conv_id
or turn link to nothing; an empty table gives no row; further columns of any name don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Keywords of a schema that are checked, or say nothing of values; with any other one validity is left open.
KEYWORDS = (
    "type", "enum", "const", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength",
    "minItems", "maxItems", "minProperties", "maxProperties", "pattern", "title", "description", "default", "examples", "format", "deprecated", "$schema", "$id", "$comment",
)
#: Patterns that are tried: parts with one repetition each, of letters, signs, escapes and classes that every dialect reads alike.
PLAIN_PATTERN = r"^\^?(?:(?:[A-Za-z0-9_@ :,/#%&=~!<>;'\"-]|\.|\\[dwsDWS./+*?()\[\]{}|^$-]|\[\^?(?:a-z|A-Z|0-9|a-f|A-F|[A-Za-z0-9_.@ +*/:,])+-?\])(?:[*+?]|\{\d{1,3},?\})?)*\$?$"
#: The variant type names that satisfy a schema type.
TYPES = {
    "string": "^STRING$", "integer": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\(\\d+,0\\))$", "boolean": "^BOOLEAN$", "null": "^VOID$",
    "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$", "array": "^ARRAY.*", "object": "^OBJECT.*",
}
BODY_KEYS = ("content", "tool_calls", "tool_call_id", "tools")
_FIELDS, _LIST = "map<string,variant>", "array<variant>"
_CALLS = "array<struct<id:string,name:string,arguments:string>>"
_TOOLS = "array<struct<name:string,schema:string>>"


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _or_empty(value: Column, kind: str) -> Column:
    return F.coalesce(value, (F.create_map() if kind.startswith("map") else F.array()).cast(kind))


def _checked(value: Column, schema: Column) -> tuple[Column, Column]:
    """Whether a variant satisfies what a JSON schema says of it alone, without its members, and whether that leaves anything open."""
    pattern = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    kind, members, entries = F.schema_of_variant(value), value.try_cast(_FIELDS), value.try_cast(_LIST)
    wanted = F.coalesce(_get(schema, "$.type", "array<string>"), F.array(_get(schema, "$.type", "string")))
    ok = F.exists(wanted, lambda t: t.isNull() | F.coalesce(F.regexp_like(kind, F.try_element_at(pattern, t)), F.lit(True)))
    allowed, single = _get(schema, "$.enum", _LIST), _get(schema, "$.const", "variant")
    ok &= allowed.isNull() | F.array_contains(F.transform(allowed, lambda x: F.to_json(x)), F.to_json(value))
    ok &= single.isNull() | (F.to_json(single) == F.to_json(value))
    limit = lambda key: _get(schema, f"$.{key}", "double")
    number = F.when(F.regexp_like(kind, F.lit(TYPES["number"])), _get(value, "$", "double"))
    text = F.when(kind == "STRING", value.try_cast("string"))
    bounds = [number >= limit("minimum"), number <= limit("maximum"), number > limit("exclusiveMinimum"), number < limit("exclusiveMaximum"), F.length(text) >= limit("minLength"), F.length(text) <= limit("maxLength")]
    bounds += [F.size(x) >= limit(least) for x, least in ((entries, "minItems"), (members, "minProperties"))] + [F.size(x) <= limit(most) for x, most in ((entries, "maxItems"), (members, "maxProperties"))]
    for bound, of in zip(bounds, [number] * 4 + [text] * 2 + [entries, members] * 2, strict=True):
        ok &= of.isNull() | F.coalesce(bound, F.lit(True))
    has = lambda k: F.coalesce(F.map_contains_key(members, k), F.lit(False))
    ok &= members.isNull() | F.forall(_or_empty(_get(schema, "$.required", "array<string>"), "array<string>"), has)
    regex = _get(schema, "$.pattern", "string")
    plain = regex.rlike(PLAIN_PATTERN)
    ok &= F.when(text.isNotNull() & plain, F.regexp_like(text, regex)).otherwise(True)
    said = F.map_keys(_or_empty(schema.try_cast(_FIELDS), _FIELDS))
    tuples = _get(schema, "$.items", _LIST).isNotNull() & entries.isNotNull()
    ok &= F.coalesce(F.to_json(schema) != "false", F.lit(True))
    return ok, F.exists(said, lambda k: ~k.isin(*KEYWORDS)) | tuples | text.isNotNull() & F.coalesce(~plain, F.lit(False))


def valid(pairs: DataFrame) -> DataFrame:
    """(pid, value, schema), JSON each, to (pid, valid): false if a value fails, null if none fails but a schema holds what is not
    checked. Members and entries are checked in rounds, a level each, so schemas may be of any depth."""
    parsed = lambda rows: rows.select("pid", F.try_parse_json("value").alias("v"), F.try_parse_json("schema").alias("s"))
    level, told = materialise(pairs.select("pid", "value", "schema"), "chat-level"), []
    while not level.isEmpty():
        rows = parsed(level)
        ok, open_ = _checked(F.col("v"), F.col("s"))
        told.append(rows.select("pid", ok.alias("ok"), open_.alias("open")).groupBy("pid").agg(F.bool_and("ok").alias("ok"), F.bool_or("open").alias("open")))
        json = lambda x: F.coalesce(F.to_json(x), F.lit("null"))
        members, properties = F.col("v").try_cast(_FIELDS), _or_empty(_get(F.col("s"), "$.properties", _FIELDS), _FIELDS)
        named = rows.where(members.isNotNull()).select("pid", "s", members.alias("m"), properties.alias("p")).select("pid", "s", "p", F.explode("m").alias("k", "x"))
        named = named.select("pid", json(F.col("x")).alias("value"), F.to_json(F.coalesce(F.try_element_at("p", F.col("k")), _get(F.col("s"), "$.additionalProperties", "variant"))).alias("schema"))
        entries = F.col("v").try_cast(_LIST)
        listed = rows.where(entries.isNotNull()).select("pid", F.to_json(_get(F.col("s"), "$.items", "variant")).alias("schema"), F.explode(entries).alias("x")).select("pid", json(F.col("x")).alias("value"), "schema")
        level = materialise(named.unionAll(listed).where("schema is not null"), "chat-level")
    if not told:
        return pairs.select("pid", F.lit(None).cast("boolean").alias("valid"))
    return reduce(DataFrame.unionAll, told).groupBy("pid").agg(F.bool_and("ok").alias("ok"), F.bool_or("open").alias("open")).select("pid", F.when(~F.col("ok"), False).when(~F.col("open"), True).alias("valid"))


def _arguments(call: Column) -> Column:
    """The arguments of a call as a variant: a string that holds JSON is read."""
    given = F.coalesce(_get(call, "$.arguments", "variant"), _get(call, "$.function.arguments", "variant"))
    return F.when(F.schema_of_variant(given) == "STRING", F.coalesce(F.try_parse_json(given.try_cast("string")), given)).otherwise(given)


def _named(value: Column) -> Column:
    return F.coalesce(_get(value, "$.name", "string"), _get(value, "$.function.name", "string"))


def _quoted(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def _object(keys: Column, json_of) -> Column:
    """A canonical JSON object: sorted keys, no white space."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.array_distinct(keys)), lambda k: F.concat(_quoted(k), F.lit(":"), json_of(k))), ","), F.lit("}"))


def _call_json(call: Column) -> Column:
    """A call with the keys of its function beside its own, and its arguments read."""
    own, inner = _or_empty(call.try_cast(_FIELDS), _FIELDS), _or_empty(_get(call, "$.function", _FIELDS), _FIELDS)
    keys = F.filter(F.concat(F.map_keys(own), F.map_keys(inner)), lambda k: (k != "function") | (F.size(inner) == 0))
    value = lambda k: F.when(k == "arguments", _arguments(call)).otherwise(F.coalesce(F.try_element_at(own, k), F.try_element_at(inner, k)))
    return F.when(call.try_cast(_FIELDS).isNull(), F.to_json(call)).otherwise(_object(keys, lambda k: F.to_json(value(k))))


def _body_json(body: Column, calls: Column) -> Column:
    """The canonical message of a body: all its keys, and the row's role and turn."""
    fields = _or_empty(body.try_cast(_FIELDS), _FIELDS)
    renamed = F.transform(F.map_keys(fields), lambda k: F.when(k.isin("role", "turn"), F.concat(F.lit("_"), k)).otherwise(k))
    keys = F.concat(renamed, F.array(F.lit("content"), F.lit("role")), F.when(F.col("turn").isNotNull(), F.array(F.lit("turn"))).otherwise(F.array().cast("array<string>")))
    kept = lambda k: F.coalesce(F.try_element_at(fields, k), F.when(k.isin("_role", "_turn"), F.try_element_at(fields, F.substring(k, 2, 9))))
    listed = F.concat(F.lit("["), F.array_join(F.transform(calls, _call_json), ","), F.lit("]"))
    return _object(keys, lambda k: F.when(k == "role", _quoted(F.col("role"))).when(k == "turn", F.col("turn").cast("string"))
                   .when((k == "tool_calls") & calls.isNotNull(), listed).otherwise(F.coalesce(F.to_json(kept(k)), F.lit('""'))))


def parse(messages: DataFrame) -> DataFrame:
    """Each message with ``body`` (null: plain content); ``mid`` is a hash of its content, so that repeated messages link alike."""
    rows = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    read = F.when(F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text"))
    known = F.arrays_overlap(F.map_keys(F.col("read").try_cast(_FIELDS)), F.array(*map(F.lit, BODY_KEYS)))
    return rows.withColumn("read", read).select("conv_id", "turn", "role", "text", F.when(known, F.col("read")).alias("body"), F.xxhash64("conv_id", "turn", "role", "text").alias("mid"))


def bodies(parsed: DataFrame) -> DataFrame:
    """The messages with a body: their calls, the identifier that they answer, the tools that they declare and their canonical
    message, which hangs on nothing else."""
    body, listed = F.col("body"), _get(F.col("body"), "$.tool_calls", _LIST)
    objects = F.filter(_or_empty(listed, _LIST), lambda c: c.try_cast(_FIELDS).isNotNull())
    calls = F.transform(objects, lambda c: F.struct(_get(c, "$.id", "string").alias("id"), _named(c).alias("name"), F.to_json(_arguments(c)).alias("arguments")))
    offered = F.transform(_or_empty(_get(body, "$.tools", _LIST), _LIST), lambda t: F.struct(
        _named(t).alias("name"), F.to_json(F.coalesce(_get(t, "$.parameters", "variant"), _get(t, "$.function.parameters", "variant"))).alias("schema")))
    return parsed.where("body is not null").select(
        "conv_id", "turn", "role", "mid", calls.cast(_CALLS).alias("calls"), _get(body, "$.tool_call_id", "string").alias("answers"),
        offered.cast(_TOOLS).alias("tools"), _body_json(body, listed).alias("message"),
    )


def anchors(edges: DataFrame) -> DataFrame:
    """Edges (conv_id, mid, parent, parent_turn), one per result, to (conv_id, mid, anchor_turn, depth, cyclic): each chain
    is followed to its first message, twice as far in each round. A chain longer than the number of edges is a circle."""
    state = materialise(edges.select("conv_id", "mid", F.col("parent").alias("top"), F.col("parent_turn").alias("anchor_turn"), F.lit(1).cast("bigint").alias("depth")), "chat-edges")
    total, reach = state.count(), 1
    further = state.select("conv_id", F.col("mid").alias("top"), F.lit(True).alias("cyclic"))
    while reach <= 2 * total and not state.join(further, ["conv_id", "top"], "left_semi").isEmpty():
        up = state.select("conv_id", F.col("mid").alias("top"), F.col("top").alias("above"), F.col("anchor_turn").alias("turn_above"), F.col("depth").alias("more"))
        step = state.join(up, ["conv_id", "top"], "left")
        moved = step.select(
            "conv_id", "mid", F.coalesce("above", "top").alias("top"), F.coalesce("turn_above", "anchor_turn").alias("anchor_turn"),
            F.least(F.col("depth") + F.coalesce("more", F.lit(0)), F.lit(4 * total + 4)).alias("depth"),
        )
        state, reach = materialise(moved, "chat-edges"), 2 * reach
    # the first message of a chain has no parent; in a circle every message has one
    ends = state.join(further, ["conv_id", "top"], "left")
    return ends.select("conv_id", "mid", "anchor_turn", "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def _shown(anchor: Column, depth: Column, is_result: Column, n_calls: Column, n_answered: Column, valid: Column, status: Column, message: Column) -> list[Column]:
    return [
        F.col("conv_id"), F.col("turn"), F.col("role"), anchor.cast("bigint").alias("anchor_turn"), depth.cast("bigint").alias("depth"), is_result.alias("is_result"),
        n_calls.cast("bigint").alias("n_calls"), n_answered.cast("bigint").alias("n_answered"), valid.cast("boolean").alias("args_valid"), status.alias("status"), message.alias("message"),
    ]


def link(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, anchor_turn, depth, is_result, n_calls, n_answered, args_valid (all of its calls'
    arguments fit; null if none has a schema), status and message (canonical JSON: sorted keys, no white space).
    Order by (conv_id, anchor_turn, depth, turn) to read a conversation. Only messages of tools are joined."""
    parsed = parse(messages)
    said = F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"))
    none, no = F.lit(None), F.lit(False)
    plain = parsed.where("body is null").select(*_shown(F.col("turn"), F.lit(0), no, F.lit(0), F.lit(0), none, F.lit("plain"), said))
    held = materialise(bodies(parsed), "chat-bodies")
    tool = held.where((F.size("calls") > 0) | F.col("answers").isNotNull())
    other = held.where((F.size("calls") == 0) & F.col("answers").isNull())
    other = other.select(*_shown(F.col("turn"), F.lit(0), no, F.lit(0), F.lit(0), none, F.lit("plain"), F.col("message")))

    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    made = tool.where(F.size("calls") > 0).dropDuplicates(["conv_id", "mid"]).select("conv_id", "mid", "turn", F.explode("calls").alias("call"))
    origin = made.where(placed & F.col("call.id").isNotNull()).groupBy("conv_id", F.col("call.id").alias("answers")).agg(F.min(F.struct("turn", "mid")).alias("at"))
    results = tool.where(placed & F.col("answers").isNotNull()).select("conv_id", "mid", "answers").distinct()
    edges = results.join(origin, ["conv_id", "answers"]).select("conv_id", "mid", F.col("at.mid").alias("parent"), F.col("at.turn").alias("parent_turn"))
    answered = results.select("conv_id", "answers").distinct().withColumn("done", F.lit(True))

    offered = held.where(F.size("tools") > 0).select("conv_id", "turn", F.explode("tools").alias("tool")).where("tool.name is not null and tool.schema is not null")
    schemas = offered.groupBy("conv_id", F.col("tool.name").alias("name")).agg(F.min(F.struct("turn", "tool.schema")).getField("schema").alias("schema"))
    checked = made.select("conv_id", "mid", F.col("call.id").alias("answers"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    checked = checked.join(answered, ["conv_id", "answers"], "left").join(schemas, ["conv_id", "name"], "left")
    given, wanted = F.coalesce("arguments", F.lit("{}")), F.try_parse_json("schema")
    checked = materialise(checked.select("conv_id", "mid", "done", given.alias("value"), F.when(wanted.isNotNull(), F.col("schema")).alias("schema"), F.monotonically_increasing_id().alias("pid")), "chat-checked")
    fits = valid(checked.where("schema is not null"))
    whole = F.when(F.col("schema").isNotNull(), F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), no))
    checked = checked.join(fits, "pid", "left").withColumn("valid", F.when(~whole, False).otherwise(F.col("valid")))
    verdict = checked.select(F.col("conv_id").alias("c"), F.col("mid").alias("m"), F.coalesce("done", no).alias("done"), "valid")
    verdict = verdict.groupBy("c", "m").agg(F.count_if("done").alias("n_answered"), F.bool_and("valid").alias("args_valid"))

    chained = anchors(edges)
    linked = tool.join(verdict, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mid") == F.col("m")), "left").join(chained, ["conv_id", "mid"], "left")
    whole = F.col("cyclic").isNotNull() & ~F.col("cyclic")
    status = F.when(F.col("cyclic"), "cyclic").when(whole, "linked").when(F.col("answers").isNotNull(), "orphan")
    status = status.when(F.col("n_answered") < F.size("calls"), "pending").otherwise("answered")
    linked = linked.select(*_shown(
        F.when(whole, F.col("anchor_turn")).otherwise(F.col("turn")), F.when(whole, F.col("depth")).otherwise(0), F.col("answers").isNotNull(), F.size("calls"),
        F.coalesce("n_answered", F.lit(0)), F.col("args_valid"), status, F.col("message"),
    ))
    return plain.unionAll(other).unionAll(linked)

"""Tool-call linking in conversations, with DataFrame functions only.

* Calls and results are hash-joined by conversation and identifier.
* Calls are ordered topologically: a call that names a predecessor comes after
  it.  The level of a call, the length of its chain, is found by pointer
  doubling, in as many joins as the logarithm of the longest chain; calls that
  have their level take no further part on the pointing side.
* Arguments are parsed as variants and validated against the tool's schema, a
  subset of JSON Schema: ``type``, ``enum``, ``properties``, ``required``,
  ``additionalProperties`` (false) and ``items``, nested as deep as it goes.
* A row is written as canonical JSON: fields in code-point order, no spaces, and
  each number in one form, whichever way it was written.

No group is gathered: a row is one call, and its place in the conversation is
its ``level`` and ``turn``, so a conversation of any size is spread over tasks.

Cases: equal rows are one; calls that share conversation and identifier but
differ are all kept, with the error ``duplicate id``, and that of the first turn,
then of the smallest predecessor, decides the level; of several results the smallest is linked, with the error ``several
results``; a call without a result has ``linked`` false and a null result; a
result without a call is a row of the kind ``result``, with the error ``no
call``; calls in or after a cycle have a null level; arguments that aren't
JSON, or null, have the error ``json``; a call without an identifier is kept,
unlinked, at level 0, and a result without one has no call; a null conversation
is one of its own; numbers beyond the range of 64-bit floats are written as the
parser has them, ``"Infinity"``; empty tables give empty ones; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util

# The types of values by the type that a schema asks for.
TYPES = {"string": ("STRING",), "integer": ("BIGINT", "DOUBLE", "DECIMAL"), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}
#: Numbers of up to so many digits before or after the point are written in full.
PLAIN_DIGITS = 21
# A string, a number or what stands between them.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|[^"0-9-]++'
#: A JSON text in which some number may not be in its one form.
LOOSE = r"(?:^|[:,\[])-?[0-9]+(?:[.eE]|[0-9]{21})"


def number(text: Column) -> Column:
    """The one form of a JSON number: no exponent up to ``PLAIN_DIGITS`` places, no zeros that say nothing."""
    whole, part = F.regexp_extract(text, r"^-?([0-9]+)", 1), F.regexp_extract(text, r"\.([0-9]+)", 1)
    power = F.coalesce(F.try_to_number(F.regexp_extract(text, r"[eE][+]?(-?[0-9]{1,9})$", 1), F.lit("S999999999")).cast("int"), F.lit(0))
    digits = F.ltrim(F.concat(whole, part), F.lit("0"))
    short = F.rtrim(digits, F.lit("0"))
    # The value is ``short`` shifted by ``scale`` places to the right.
    scale = F.length(part) - power - (F.length(digits) - F.length(short))
    size = F.length(short)
    full = F.concat(short, F.repeat(F.lit("0"), -scale))
    point = F.when(size > scale, F.concat(F.substring(short, F.lit(1), size - scale), F.lit("."), F.substring(short, size - scale + 1, scale))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), scale - size), short))
    rest = F.when(size > 1, F.concat(F.lit("."), F.substring(short, F.lit(2), size))).otherwise("")
    written = (
        F.when((scale <= 0) & (size - scale <= PLAIN_DIGITS), full)
        .when((scale > 0) & (scale <= PLAIN_DIGITS), point)
        .otherwise(F.concat(F.substring(short, 1, 1), rest, F.lit("e"), (size - scale - 1).cast("string")))
    )
    return F.when(size == 0, "0").otherwise(F.concat(F.when(text.startswith("-"), "-").otherwise(""), written))


def canonical(value: Column) -> Column:
    """Canonical text of a variant, which keeps its fields sorted."""
    text = F.to_json(value)
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    fixed = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), number(t)).otherwise(t)), "")
    return F.when(text.rlike(LOOSE), fixed).otherwise(text)


def _parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def problems(value: Column, schema: dict, path: str = "") -> Column:
    """The errors of a variant against a schema, an array of ``path: kind``; a null variant has none."""
    kind = F.schema_of_variant(value)
    say = lambda what, failed: F.when(F.coalesce(value.isNotNull() & failed, F.lit(False)), F.lit(f"{path or '$'}: {what}"))
    found, deeper = [], []
    if "type" in schema:
        fits = F.lit(False)
        for prefix in TYPES[schema["type"]]:
            fits = fits | kind.startswith(prefix)
        if schema["type"] == "integer":
            # A decimal or a power of ten may be whole: its one form tells.
            fits = fits & canonical(value).rlike(r"^-?[0-9]+(?:\.[0-9]+)?e[0-9]+$|^-?[0-9]+$")
        found.append(say("type", ~fits))
    if "enum" in schema:
        found.append(say("enum", ~canonical(value).isin(*[canonical(_parsed(F.lit(json.dumps(x)))) for x in schema["enum"]])))
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    field = lambda name: F.when(is_object, F.try_variant_get(value, f"$['{name}']", "variant"))
    for name in schema.get("required", ()):
        found.append(F.when(is_object & field(name).isNull(), F.lit(f"{path + '.' if path else ''}{name}: missing")))
    for name, inner in schema.get("properties", {}).items():
        deeper.append(problems(field(name), inner, f"{path + '.' if path else ''}{name}"))
    if schema.get("additionalProperties") is False:
        keys = F.json_object_keys(F.to_json(value))
        found.append(say("unknown field", is_object & (F.size(F.array_except(keys, F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>"))) > 0)))
    if "items" in schema:
        elements = F.when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), F.try_variant_get(value, "$", "array<variant>"))
        found.append(say("items", F.exists(elements, lambda e: F.size(problems(e, schema["items"], path)) > 0)))
    flat = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return F.concat(flat, *deeper) if deeper else flat


def check(arguments: Column, schema: dict) -> Column:
    """The errors of one JSON text against an object's schema, comma-joined."""
    value = _parsed(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, "json").otherwise(F.array_join(problems(value, schema), ","))


def levels(calls: DataFrame) -> DataFrame:
    """``key, level`` of ``key, to``: the calls before one in its chain; null in or after a cycle."""
    known = calls.select(F.col("key").alias("_known"))
    state = calls.select("key", F.col("to")).where("to is not null").join(known, F.col("to") == F.col("_known"), "left_semi")
    open_ = _util.materialize(state.select("key", "to", F.lit(1).cast("long").alias("level")), "open")
    done = [calls.join(open_.select(F.col("key").alias("_open")), F.col("key") == F.col("_open"), "left_anti").select("key", F.lit(0).cast("long").alias("level"))]
    done = [_util.materialize(done[0], "done")]
    left = open_.count()
    while left:
        # A pointer that meets one that has ended takes its level and ends; the others go twice as far.
        ended = done[0]
        for more in done[1:]:
            ended = ended.unionByName(more)
        state = ended.select(F.col("key").alias("_key"), F.lit(None).cast(calls.schema["key"].dataType).alias("_to"), F.col("level").alias("_level"))
        state = state.unionByName(open_.select(F.col("key").alias("_key"), F.col("to").alias("_to"), F.col("level").alias("_level")))
        moved = open_.join(state, F.col("to") == F.col("_key")).select("key", F.col("_to").alias("to"), (F.col("level") + F.col("_level")).alias("level"))
        moved = _util.materialize(moved, "moved")
        done.append(moved.where("to is null").select("key", "level"))
        open_, before = moved.where("to is not null"), left
        left = open_.count()
        if left == before:
            break  # on each chain that ends some call ends in each round, so what is left never does
    out = open_.select("key", F.lit(None).cast("long").alias("level"))
    for more in done:
        out = out.unionByName(more)
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each different call, and for each different result that has no call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), after (a call_id of
    the conversation, or null).  ``results``: conv_id, call_id, result.
    ``schemas``: by tool name.
    """
    columns = ["conv_id", "call_id", "turn", "name", "arguments", "after"]
    key = F.when(F.col("call_id").isNotNull(), F.struct("conv_id", "call_id")).alias("key")
    each = calls.select(*columns, key).distinct()
    named = each.where("key is not null")
    # Written, so that the joins by key can split a hot one.
    to = F.when(F.col("first.after").isNotNull(), F.struct(F.col("key.conv_id").alias("conv_id"), F.col("first.after").alias("call_id")))
    nodes = named.groupBy("key").agg(F.min(F.struct("turn", "after", F.xxhash64("name", "arguments").alias("rest"))).alias("first"), F.count(F.lit(1)).alias("same")).select("key", to.alias("to"), "same")
    nodes = _util.materialize(nodes, "nodes")
    level = levels(nodes.select("key", "to"))
    answers = results.select(key, F.struct("result").alias("r")).where("key is not null").groupBy("key").agg(F.min("r").alias("r"), (F.min("r") != F.max("r")).alias("several"))
    facts = nodes.join(level, "key").join(answers, "key", "left")
    facts = facts.select(F.col("key").alias("_key"), "level", "same", F.col("r").isNotNull().alias("linked"), F.col("r.result").alias("result"), "several")
    facts = _util.materialize(facts, "facts")
    linked = named.join(facts, F.col("key") == F.col("_key")).select(*columns, "level", "same", "linked", "result", "several")
    none = lambda kind: F.lit(None).cast(kind)
    loose = each.where("key is null").select(*columns, F.lit(0).cast("long").alias("level"), F.lit(1).cast("long").alias("same"), F.lit(False).alias("linked"), none("string").alias("result"), none("boolean").alias("several"))
    rows = linked.unionByName(loose)
    errors = F.lit("tool")
    for name, schema in schemas.items():
        errors = F.when(F.col("name") == name, check(F.col("arguments"), schema)).otherwise(errors)
    errors = F.array_join(F.filter(F.array(errors, F.when(F.col("same") > 1, "duplicate id"), F.when(F.col("several"), "several results")), lambda e: e != ""), ",")
    rows = rows.withColumn("errors", errors).withColumn("kind", F.lit("call")).drop("same", "several")
    orphans = orphan_results(nodes, results).select(
        "conv_id", "call_id", none("long").alias("turn"), none("string").alias("name"), none("string").alias("arguments"), none("string").alias("after"),
        none("long").alias("level"), F.lit(False).alias("linked"), "result", F.lit("no call").alias("errors"), F.lit("result").alias("kind"),
    )
    rows = rows.unionByName(orphans).withColumn("valid", F.col("errors") == "")
    return rows.withColumn("message", message(after=_text("after"), arguments=F.coalesce(canonical(_parsed(F.col("arguments"))), _text("arguments")), call_id=_text("call_id"), name=_text("name"), result=_text("result")))


def message(**members: Column) -> Column:
    """A JSON object of written members, in code-point order of their names."""
    pairs = [F.concat(F.lit(f'"{name}":'), F.coalesce(members[name], F.lit("null"))) for name in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def _text(name: str) -> Column:
    """A text as a JSON string."""
    return F.when(F.col(name).isNotNull(), F.regexp_replace(F.to_json(F.struct(F.col(name).alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1"))


def orphan_results(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """The different results whose conversation and identifier no call of ``key`` has."""
    key = F.when(F.col("call_id").isNotNull(), F.struct("conv_id", "call_id"))
    known = nodes.select(F.col("key").alias("_key"))
    return results.select("conv_id", "call_id", "result").distinct().withColumn("key", key).join(known, F.col("key") == F.col("_key"), "left_anti").drop("key")


# The schema that calls read from plain conversations have.
ASK = {"ask": {"type": "object", "required": ["role", "text", "turn"], "additionalProperties": False, "properties": {"role": {"type": "string", "enum": ["user"]}, "text": {"type": "string"}, "turn": {"type": "integer"}}}}


def read_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages of plain conversations.

    Each message of a user is a call of the tool ``ask``, named by conversation
    and turn, and comes after that of two turns before; a message of an
    assistant is the result of the call one turn before.  Messages without
    conversation or turn are calls or results without an identifier.
    """
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    name = lambda by: F.when(whole, F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - by).cast("string")))
    arguments = F.to_json(F.struct("role", "text", "turn"))
    conv = F.col("conv_id").cast("long").alias("conv_id")
    calls = conversations.where("role = 'user'").select(conv, name(0).alias("call_id"), F.col("turn").cast("long"), F.lit("ask").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, name(2)).alias("after"))
    results = conversations.where("role = 'assistant'").select(conv, name(1).alias("call_id"), F.col("text").alias("result"))
    others = conversations.where("role is null or role not in ('user', 'assistant')").select(conv, F.col("turn").cast("long").alias("turn"), "role", "text")
    return calls, results, others


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Every message: calls with their results, results without a call, and other messages as they are."""
    calls, results, others = read_calls(conversations)
    columns = ["conv_id", "call_id", "turn", "kind", "level", "linked", "valid", "errors", "message"]
    written = message(role=_text("role"), text=_text("text"), turn=F.col("turn").cast("string"))
    rest = others.select("conv_id", F.lit(None).cast("string").alias("call_id"), "turn", F.lit("message").alias("kind"), F.lit(None).cast("long").alias("level"), F.lit(False).alias("linked"), F.lit(True).alias("valid"), F.lit("").alias("errors"), written.alias("message"))
    return link(calls, results, ASK).select(columns).unionByName(rest)

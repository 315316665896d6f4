"""Chat formatting with linked tool calls, by DataFrame functions only.

A message may hold calls, ``<tool_call>{"id", "name", "arguments", "after"}</tool_call>``,
and results, ``<tool_result>{"id", "content"}</tool_result>``; a message of role ``tool``
whose whole text is such an object is a result, too. Calls and results are hash-joined
by conversation and identifier, arguments are checked against the tools' schemas, and
messages are put in an order in which no result stands before its call and no call
before the results that it names in ``after``. Each message becomes one line of
canonical JSON: keys sorted, no white space, numbers and nested objects as parsed.

A conversation is never gathered into one row or task: what a message needs from others
comes by joins on (conversation, identifier) and (conversation, turn).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import strict_json
from .common import or_empty, shared_folder, written

#: JSON type names, and the variant schemas that satisfy them.
TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|DECIMAL)",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "array": "^ARRAY<",
}
#: Schemas of the arguments by tool, as JSON Schema has them: type, enum, properties, required, items.
#: Properties that are not listed are unexpected, unless additionalProperties is true.
TOOLS: dict[str, dict] = {
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "timeout": {"type": "number"}, "method": {"enum": ["GET", "HEAD", "POST"]}}, "required": ["url"]},
    "search": {
        "type": "object",
        "properties": {
            "query": {"type": "string"},
            "limit": {"type": "integer"},
            "filters": {"type": "object", "additionalProperties": True, "properties": {"lang": {"type": "string"}, "sites": {"type": "array", "items": {"type": "string"}}}},
        },
        "required": ["query"],
    },
}

_CALL = r"(?s)<tool_call>(.*?)</tool_call>"
_RESULT = r"(?s)<tool_result>(.*?)</tool_result>"
#: Both with the white space before them, which goes with them; all other white space of a message stays.
_TAGGED = r"(?s)\s*<tool_(call|result)>.*?</tool_\1>"


def _member(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def faults(value: Column, schema: dict, path: str) -> Column:
    """Messages on where ``value`` departs from ``schema``; ``path`` names it, empty for the arguments themselves."""
    none = F.array().cast("array<string>")
    under = lambda name: f"{path}.{name}" if path else name
    inner = [none]
    if "properties" in schema or "required" in schema:
        known = schema.get("properties", {})
        present = F.coalesce(F.json_object_keys(F.to_json(value)), none)
        if not schema.get("additionalProperties", False):
            inner.append(F.transform(F.array_except(present, F.array(*(F.lit(k) for k in known)).cast("array<string>")), lambda k: F.concat(F.lit("unexpected " + under("")), k)))
        for name in schema.get("required", []):
            inner.append(F.when(F.array_contains(present, name), none).otherwise(F.array(F.lit(f"missing {under(name)}"))))
        for name, part in known.items():
            inner.append(F.when(F.array_contains(present, name), faults(F.try_variant_get(value, f"$.{name}", "variant"), part, under(name))).otherwise(none))
    if "items" in schema:
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        inner.append(F.flatten(F.transform(items, lambda v: faults(v, schema["items"], path + "[]"))))
    if "enum" in schema:
        fits = F.coalesce(F.to_json(value).isin(*(json.dumps(v) for v in schema["enum"])), F.lit(False))
        inner.append(F.when(fits, none).otherwise(F.array(F.lit(f"{path} is none of its values"))))
    found = F.concat(*inner)
    if "type" in schema:
        kind = schema["type"]
        fits = F.coalesce(F.schema_of_variant(value).rlike(TYPES[kind]), F.lit(False))
        found = F.when(fits, found).otherwise(F.array(F.lit(f"{path} is not of type {kind}" if path else "arguments are no object")))
    return found


def problems(name: Column, arguments: Column, tools: dict[str, dict]) -> Column:
    """Sorted messages on what is wrong with a call's arguments; empty if they are valid."""
    out = F.array(F.lit("unknown tool"))
    for tool, schema in tools.items():
        out = F.when(name == tool, F.array_sort(F.array_distinct(faults(arguments, schema, "")))).otherwise(out)
    return out


def _calls(text: Column, tools: dict[str, dict]) -> Column:
    parsed = F.transform(F.regexp_extract_all(text, F.lit(_CALL), F.lit(1)), strict_json)

    def one(v: Column) -> Column:
        name, arguments = _member(v, "$.name", "string"), F.variant_get(v, "$.arguments", "variant")
        faults = F.when(v.isNull(), F.array(F.lit("no valid JSON"))).when(_member(v, "$.id", "string").isNull(), F.array(F.lit("no id"))).otherwise(problems(name, arguments, tools))
        after = F.coalesce(_member(v, "$.after", "array<string>"), F.array().cast("array<string>"))
        return F.struct(F.array_sort(after).alias("after"), arguments.alias("arguments"), _member(v, "$.id", "string").alias("id"), name.alias("name"), faults.alias("problems"))

    return F.transform(parsed, one)


def _results(text: Column, role: Column) -> Column:
    bodies = F.regexp_extract_all(text, F.lit(_RESULT), F.lit(1))
    whole = F.when((role == "tool") & (F.size(bodies) == 0), F.array(text)).otherwise(bodies)

    def one(v: Column) -> Column:
        return F.struct(F.variant_get(v, "$.content", "variant").alias("content"), _member(v, "$.id", "string").alias("id"))

    return F.transform(F.filter(F.transform(whole, strict_json), lambda v: _member(v, "$.id", "string").isNotNull()), one)


_KEY = ["conv_id", "turn"]


def _chains(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, anchor, dist, most, endless) of every message that depends on exactly one other.

    Such messages form chains, which pointers that double in each round follow back to the
    first message that depends on none or on several: the anchor. ``dist`` counts the steps
    to it and ``most`` is the latest turn among them, the anchor left out. A chain that runs
    in a circle has none; it is endless, and ``most`` is the latest turn of its circle too.
    """
    alone = edges.groupBy(_KEY).agg(F.count("*").alias("n"), F.max("before").alias("anchor")).where("n = 1")
    now = written(alone.select(*_KEY, "anchor", F.lit(1).cast("long").alias("dist"), F.col("turn").alias("most"), F.lit(True).alias("endless")))
    # written, not checkpointed: a checkpoint keeps the optimizer's estimates, which each join would square;
    # after these rounds a pointer has gone as many steps as there are messages; one that still goes on in the last is in a circle
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select("conv_id", F.col("turn").alias("anchor"), F.col("anchor").alias("_anchor"), F.col("dist").alias("_dist"), F.col("most").alias("_most"))
        joined = now.join(ahead, ["conv_id", "anchor"], "left")
        now = written(
            joined.select(
                *_KEY,
                F.coalesce("_anchor", "anchor").alias("anchor"),
                (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
                F.greatest("most", "_most").alias("most"),
                F.col("_anchor").isNotNull().alias("endless"),
            )
        )
        if not now.where("endless").head(1):
            break
    return now


def _contracted(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv_id, source, turn, dist, most) of the messages that depend on several others, each chain one long step.

    ``source`` is null where the step comes from an endless chain.
    """
    several = edges.groupBy(_KEY).agg(F.count("*").alias("n")).where("n > 1").select(_KEY)
    steps = edges.join(several, _KEY, "left_semi")
    passed = chains.select("conv_id", F.col("turn").alias("before"), F.when(~F.col("endless"), F.col("anchor")).alias("anchor"), "dist", "most", F.lit(True).alias("chained"))
    joined = steps.join(passed, ["conv_id", "before"], "left")
    source = F.when(F.col("chained"), F.col("anchor")).otherwise(F.col("before"))
    return written(joined.select("conv_id", source.alias("source"), "turn", (F.coalesce("dist", F.lit(0)) + 1).alias("dist"), F.greatest("before", F.coalesce("most", "before")).alias("most")))


def _latest(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, order_turn): the latest turn among a message and all that it depends on."""
    chains = _chains(edges)
    steps = _contracted(edges, chains)
    nodes = edges.select("conv_id", F.col("before").alias("turn")).unionByName(edges.select(_KEY)).distinct()
    own = steps.groupBy(_KEY).agg(F.max("most").alias("t"))
    anchors = nodes.join(chains, _KEY, "left_anti").join(own, _KEY, "left").select(*_KEY, F.greatest("turn", "t").alias("order_turn"))
    now = moved = written(anchors)
    while True:
        sources = moved.select("conv_id", F.col("turn").alias("source"), F.col("order_turn").alias("t"))
        later = steps.join(sources, ["conv_id", "source"]).groupBy(_KEY).agg(F.max("t").alias("t"))
        moved = written(now.join(later, _KEY).where("t > order_turn").select(*_KEY, F.col("t").alias("order_turn")))
        if moved.isEmpty():
            break
        now = written(now.join(moved.withColumnRenamed("order_turn", "t"), _KEY, "left").select(*_KEY, F.coalesce("t", "order_turn").alias("order_turn")))
    anchored = now.select("conv_id", F.col("turn").alias("anchor"), F.col("order_turn").alias("t"))
    along = chains.join(anchored, ["conv_id", "anchor"], "left").select(*_KEY, F.greatest("most", F.when(~F.col("endless"), F.col("t"))).alias("order_turn"))
    return written(now.unionByName(along))


def _levels(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, order_level): the longest path to each message of ``edges``; cycles and what stands behind them are left out.

    Each waiting message keeps how many of its steps are open and the longest path so far.
    A round takes the steps from the messages that the last one has settled, and writes one
    table: those that are settled by it and those that still wait.
    """
    chains = _chains(edges)
    steps = _contracted(edges, chains)
    nodes = edges.select("conv_id", F.col("before").alias("turn")).unionByName(edges.select(_KEY)).distinct()
    first = nodes.join(edges.select(_KEY).distinct(), _KEY, "left_anti").select(*_KEY, F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("order_level"))
    waiting = steps.groupBy(_KEY).agg(F.count("*").alias("open")).withColumn("order_level", F.lit(None).cast("long"))
    spark, folder = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/levels-{uuid.uuid4().hex}"
    state, n = first.unionByName(waiting), 0
    while True:
        state.write.parquet(f"{folder}/round={n}")
        state = spark.read.parquet(f"{folder}/round={n}")
        settled, left = state.agg(F.count_if(F.col("open") == 0), F.count_if(F.col("open") > 0)).first()
        if not settled or not left:
            break  # all are settled, or what is left is on a cycle or behind one
        sources = state.where("open = 0").select("conv_id", F.col("turn").alias("source"), "order_level")
        gained = steps.join(sources, ["conv_id", "source"]).groupBy(_KEY).agg(F.count("*").alias("n"), F.max(F.col("order_level") + F.col("dist")).alias("longest"))
        still = state.where("open > 0").join(gained, _KEY, "left")
        state = still.select(*_KEY, (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("order_level", "longest").alias("order_level"))
        n += 1
    done = spark.read.parquet(folder).where("open = 0").select(*_KEY, "order_level")
    anchored = done.select("conv_id", F.col("turn").alias("anchor"), "order_level")
    along = chains.where("not endless").join(anchored, ["conv_id", "anchor"]).select(*_KEY, (F.col("order_level") + F.col("dist")).alias("order_level"))
    return done.unionByName(along)


def _ordered(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, order_turn, order_level) of the messages of conversations with a dependency on a later turn.

    ``edges`` has (conv_id, before, turn). A message's order_turn is the latest turn among
    itself and all that it depends on, and its level is the longest path to it among messages
    of one order_turn. Messages on a cycle, and those behind one, get level -1 and their own
    turn. Chains of any length take a logarithmic number of rounds, and only messages that
    depend on several others take one for each such message before them. Conversations in the
    order of their turns take none: every message stays where it is.
    """
    backward = edges.where("before > turn").select("conv_id").distinct()
    turned = written(edges.join(backward, "conv_id", "left_semi"))
    if turned.isEmpty():
        return turned.select(*_KEY, F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_level"))
    now = _latest(turned)
    # only dependencies within one order_turn are left to settle
    sources = now.select("conv_id", F.col("turn").alias("before"), F.col("order_turn").alias("t"))
    tight = written(turned.join(sources, ["conv_id", "before"]).join(now, _KEY).where("t = order_turn").select("conv_id", "before", "turn"))
    if tight.isEmpty():
        return now.withColumn("order_level", F.lit(0).cast("long"))
    within = tight.select("conv_id", F.col("before").alias("turn")).unionByName(tight.select(_KEY)).distinct().withColumn("_tight", F.lit(True))
    placed = now.join(within, _KEY, "left").join(_levels(tight), _KEY, "left")
    level = F.when(F.col("_tight"), F.coalesce("order_level", F.lit(-1))).otherwise(0).cast("long")
    return placed.select(*_KEY, F.when(level < 0, F.col("turn")).otherwise(F.col("order_turn")).alias("order_turn"), level.alias("order_level"))


def format_chats(conversations: DataFrame, tools: dict[str, dict] = TOOLS) -> DataFrame:
    """One row for every row of ``conversations`` (conv_id, turn, role, text).

    Returns conv_id, turn, role, order_turn, order_level, n_calls, n_results, n_linked (its
    results whose call exists and its calls that have a result), n_invalid (its calls
    with problems) and json, the canonical line. Reading a conversation by (order_turn,
    order_level, turn) is the topological order, however long a chain is; messages on a cycle,
    and those moved behind one, have order_level -1.

    Null text is empty content, null role stays null, rows with a null conv_id or turn
    link to nothing. Of calls that share an id the first by turn owns it, and of its results
    the first by turn is the one that later calls wait for; rows that repeat are formatted as
    often as they occur. White space stays, but for that before a call or result that is taken
    out of its message. A message of any length is parsed as a whole. Broken JSON, or JSON with anything behind it, is a call with a
    problem, or no result. An empty table gives no rows. Other columns are not read.
    """
    text = or_empty(F.col("text").cast("string"))
    role = F.col("role").cast("string")
    none = lambda array: F.slice(array, 1, 0)
    calls, results = _calls(text, tools), _results(text, role)
    messages = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.when(F.contains(text, F.lit("<tool_")), F.regexp_replace(text, _TAGGED, "")).otherwise(text).alias("content"),
        F.when(F.contains(text, F.lit("<tool_call>")), calls).otherwise(none(calls)).alias("calls"),
        F.when(F.contains(text, F.lit("<tool_result>")) | (role == "tool"), results).otherwise(none(results)).alias("results"),
    )
    speaking = messages.where("conv_id is not null and turn is not null and (size(calls) > 0 or size(results) > 0)")
    own = speaking.select("conv_id", "turn", F.explode("calls").alias("c")).where("c.id is not null").select("conv_id", "turn", F.col("c.id").alias("id"), F.col("c.after").alias("after"))
    got = speaking.select("conv_id", "turn", F.explode("results").alias("r")).select("conv_id", "turn", F.col("r.id").alias("id"))
    owner = own.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"))
    linked = written(got.join(owner, ["conv_id", "id"]).select("conv_id", "id", "turn", "call_turn"))
    # a call waits for the first result of an id; all results wait for its call, so links grow with messages only
    first = linked.groupBy("conv_id", "id").agg(F.min("turn").alias("before"))
    waits = own.select("conv_id", "turn", F.explode(F.array_distinct("after")).alias("id")).join(first, ["conv_id", "id"])
    edges = linked.select("conv_id", F.col("call_turn").alias("before"), "turn").unionByName(waits.select("conv_id", "before", "turn"))
    edges = written(edges.where("before <> turn").distinct())
    ordered = _ordered(edges) if not edges.isEmpty() else edges.select("conv_id", "turn", F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_level"))
    answered = linked.select("conv_id", F.col("call_turn").alias("turn"), "id").distinct()
    ends = linked.select("conv_id", "turn", "id").distinct().unionByName(answered).groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    joined = messages.join(ordered, ["conv_id", "turn"], "left").join(ends, ["conv_id", "turn"], "left")
    line = F.to_json(F.struct("calls", "content", "conv_id", "results", "role", "turn"), {"ignoreNullFields": "false"})
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("order_turn", "turn").alias("order_turn"),
        F.coalesce("order_level", F.lit(0)).cast("long").alias("order_level"),
        F.size("calls").cast("long").alias("n_calls"),
        F.size("results").cast("long").alias("n_results"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.size(F.filter("calls", lambda c: F.size(c["problems"]) > 0)).cast("long").alias("n_invalid"),
        line.alias("json"),
    )

"""Chat formatting: tool calls linked to their results. DataFrame operations only.

Calls and results of a conversation meet by identifier in a hash join; calls are ordered
topologically over what they depend on, arguments are validated against the tool's schema, and
every message becomes one line of canonical JSON (keys sorted, no spaces, nulls left out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.staging import Staged

#: Tool -> argument -> (types of JSON it may have, whether it must be there).
Schemas = dict[str, dict[str, tuple[tuple[str, ...], bool]]]
_TYPES = {"integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def canonical_json(text: Column) -> Column:
    """The same value with sorted keys and without spaces; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def violations(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call: array of `unknown tool`, `not an object`, `missing x`, `type of x`, `unexpected x`."""
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(canonical_json(arguments)), F.array().cast("array<string>"))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    cases = F.when(~is_object, F.array(F.lit("not an object")))
    for tool, fields in sorted(schemas.items()):
        found = []
        for field, (kinds, required) in sorted(fields.items()):
            kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            allowed = [prefix for k in kinds for prefix in _TYPES[k]]
            right = F.lit(False)
            for prefix in allowed:
                right = right | kind.startswith(prefix)
            there = F.array_contains(keys, field)
            found.append(F.when(there & ~F.coalesce(right, F.lit(False)), F.lit(f"type of {field}")))
            if required:
                found.append(F.when(~there, F.lit(f"missing {field}")))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in sorted(fields)]).cast("array<string>")), lambda k: F.concat(F.lit("unexpected "), k))
        cases = cases.when(name == tool, F.sort_array(F.concat(F.array_compact(F.array(*found)), extra)))
    return cases.otherwise(F.array(F.lit("unknown tool")))


def _chains(calls: DataFrame, edges: DataFrame) -> Staged:
    """(conv_id, call_id, at, steps): the first call without, or with several, dependencies that a call leads to, and how far.

    Calls of one dependency point to it; every round each points to where its target points, so
    a chain of n calls takes log2(n) rounds. `at` is null on or behind a cycle of such calls.
    """
    one = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("needs"))
    joined = calls.select("conv_id", "call_id").join(one, ["conv_id", "call_id"], "left")
    live = F.coalesce(F.col("n") == 1, F.lit(False))
    state = Staged(joined.select("conv_id", "call_id", F.when(live, F.col("needs")).otherwise(F.col("call_id")).alias("at"), live.cast("long").alias("steps"), live.alias("live")))
    for _ in range(state.rows().bit_length() + 1):
        if state.df.filter("live").isEmpty():
            break
        target = state.df.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("at").alias("then"), F.col("steps").alias("more"), F.col("live").alias("still"))
        moved = state.df.filter("live").join(target, (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("k")))
        moved = moved.select("conv_id", "call_id", F.col("then").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("live"))
        after = Staged(state.df.filter("not live").unionByName(moved))
        state.drop()
        state = after
    found = Staged(state.df.withColumn("at", F.when(~F.col("live"), F.col("at"))).drop("live"))
    state.drop()
    return found


def levels(calls: DataFrame) -> Staged:
    """(conv_id, call_id, level): 0 without known dependencies, else one more than the greatest of them; null on or behind a cycle.

    Chains of calls with one dependency are shortened first. Then each round settles the calls
    of several dependencies whose chains all end at settled calls; there are as many rounds as
    the longest path has such calls, and the first round without progress ends it.
    """
    known = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"))
    asked = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needs"))
    edges = Staged(asked.join(known, (F.col("conv_id") == F.col("c")) & (F.col("needs") == F.col("k")), "left_semi").distinct())
    chains = _chains(calls, edges.df)
    own = chains.df.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), "at", "steps")
    several = edges.df.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv_id", "call_id")
    to_chain = (F.col("conv_id") == F.col("c")) & (F.col("needs") == F.col("k"))
    waiting = Staged(edges.df.join(several, ["conv_id", "call_id"], "left_semi").join(own, to_chain).select("conv_id", "call_id", F.col("at").alias("needs"), "steps"))
    settled = Staged(calls.select("conv_id", "call_id").join(edges.df, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")))
    while not waiting.df.isEmpty():
        done = settled.df.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), "level")
        met = waiting.df.join(done, to_chain, "left").groupBy("conv_id", "call_id")
        newly = Staged(met.agg(F.max(F.col("level") + F.col("steps") + 1).alias("level"), F.bool_or(F.col("level").isNull()).alias("waits")).filter("not waits").drop("waits"))
        if newly.rows() == 0:
            break
        rest, more = Staged(waiting.df.join(newly.df, ["conv_id", "call_id"], "left_anti")), Staged(settled.df.unionByName(newly.df))
        for old in (waiting, settled, newly):
            old.drop()
        waiting, settled = rest, more
    ends = settled.df.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), "level")
    joined = chains.df.join(ends, (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("k")), "left")
    return Staged(joined.select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level")))


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """messages(conv_id, turn, role, content, call_id, name, arguments, depends_on) as linked, ordered, serialised lines.

    Columns conv_id, turn, role, call_id, status, level, violations, json. A row with role `call`
    is a call, with role `tool` a result; other rows are `message`. Statuses of calls: `linked`,
    `unanswered`, `duplicate` (another row of the same identifier has a smaller turn or, at the
    same turn, smaller arguments), `cycle` (it waits for itself); of results: `linked`,
    `orphan`, `duplicate`. Identifiers count within their conversation; a call or result without
    conv_id or call_id is `unanswered` or `orphan`. `level` is a call's place in the topological
    order; its result and a conversation's other messages carry the same or null. Lines come
    range-sorted by conversation, level and turn. Repeated rows are duplicates of one another
    and exactly equal ones share a status. Other columns are ignored; an empty table gives an
    empty result.
    """
    held = Staged(messages.select("conv_id", "turn", "role", "content", "call_id", "name", "arguments", "depends_on"))
    is_call, is_result = F.col("role") == "call", F.col("role") == "tool"
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    least = lambda when, *columns: F.min(F.when(when, F.struct(*columns)))
    by_id = held.df.filter((is_call | is_result) & named).groupBy("conv_id", "call_id").agg(
        least(is_call, "turn", F.coalesce("arguments", F.lit("")).alias("arguments")).alias("first_call"), least(is_result, "turn", F.coalesce("content", F.lit("")).alias("content")).alias("first_result")
    )
    ids = Staged(by_id)
    first = F.col("turn").eqNullSafe(F.col("first_call.turn")) & F.coalesce("arguments", F.lit("")).eqNullSafe(F.col("first_call.arguments"))
    calls = held.df.filter(is_call & named).join(ids.df, ["conv_id", "call_id"]).filter(first).select("conv_id", "call_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    ordered = levels(calls.groupBy("conv_id", "call_id").agg(F.min("depends_on").alias("depends_on")))
    known = Staged(ids.df.join(ordered.df.withColumn("ordered", F.lit(True)), ["conv_id", "call_id"], "left").select(F.col("conv_id").alias("of_conv"), F.col("call_id").alias("of_call"), "first_call", "first_result", "level", "ordered"))
    rows = held.df.join(known.df, (F.col("conv_id") == F.col("of_conv")) & (F.col("call_id") == F.col("of_call")), "left")
    first_result = F.col("turn").eqNullSafe(F.col("first_result.turn")) & F.coalesce("content", F.lit("")).eqNullSafe(F.col("first_result.content"))
    status = (
        F.when(is_call & F.col("first_call").isNotNull() & ~first, "duplicate")
        .when(is_call & F.col("ordered") & F.col("level").isNull(), "cycle")
        .when(is_call & F.col("first_result").isNotNull(), "linked")
        .when(is_call, "unanswered")
        .when(is_result & F.col("first_call").isNull(), "orphan")
        .when(is_result & ~first_result, "duplicate")
        .when(is_result & F.col("first_call").isNotNull(), "linked")
        .when(is_result, "orphan")
        .otherwise("message")
    )
    wrong = F.when(is_call, violations(F.col("name"), F.col("arguments"), schemas))
    arguments = F.try_parse_json("arguments")
    line = F.to_json(
        F.struct(
            F.when(is_call, arguments).alias("arguments"), F.when(is_call | is_result, F.col("call_id")).alias("call_id"), F.when(~is_call, F.col("content")).alias("content"),
            F.when(is_call, F.col("name")).alias("name"), "role", "turn",
        )
    )
    done = rows.select("conv_id", "turn", "role", "call_id", status.alias("status"), F.when(is_call | is_result, F.col("level")).alias("level"), wrong.alias("violations"), line.alias("json"))
    order = ["conv_id", "level", "turn", "role"]
    return done.repartitionByRange(*order).sortWithinPartitions(*order)


#: The tool that conversations() makes user turns call.
SCHEMAS: Schemas = {"answer": {"question": (("string",), True), "words": (("integer",), True), "follows": (("string",), False)}}


def conversations(turns: DataFrame) -> DataFrame:
    """The messages that turns(conv_id, turn, role, text) stand for: user turns call a tool, the assistant's next turn is its result.

    A call depends on the one two turns before it, where there is one. Other turns stay as they are.
    """
    own = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    asked = F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string"))
    earlier = F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 2).cast("string"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    arguments = F.to_json(F.struct(words.alias("words"), F.col("text").alias("question"), F.when(F.col("turn") >= 2, earlier).alias("follows")))
    return turns.select(
        "conv_id", "turn",
        F.when(user, "call").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(~F.coalesce(user, F.lit(False)), F.col("text")).alias("content"),
        F.when(user, own).when(assistant, asked).alias("call_id"),
        F.when(user, F.lit("answer")).alias("name"),
        F.when(user, arguments).alias("arguments"),
        F.when(user, F.array(earlier)).alias("depends_on"),
    )

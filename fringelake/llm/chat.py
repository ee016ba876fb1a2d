"""Chat formatting: tool-call linking, in DataFrame functions only.

An assistant turn whose text is a JSON object with `tool_calls` (a list of
objects with id, name and arguments) makes calls; a `tool` turn whose text is a
JSON object with `tool_call_id` and `content` answers one. Calls and results
meet in a hash join on (conversation, identifier); calls are ordered so that
one comes after every call whose result its arguments refer to ("$id" in a field
that the schema has for references: text that looks like one is text); their
arguments are checked against schemas; each message, call and result becomes
one row with canonical JSON (sorted keys, no blanks). A conversation is never
gathered into one row: (turn, level, seq) is its order.

Plain conversations can be read as tool traffic: each user turn calls the tool
`reply` with its text, after the exchange before, and the assistant's next turn
is the result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .session import checkpointed

#: Tool -> argument -> (type, required); types are string, integer, number, boolean, array, object, and for
#: results of other calls reference ("$id"), string|reference (text, or "$id" of a call that there is) and references (a list).
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
TOOLS: Schemas = {
    "search": {"query": ("string|reference", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string|reference", True), "given": ("references", False)},
    "weather": {"city": ("string|reference", True), "days": ("integer", False), "metric": ("boolean", False)},
}
#: The tool that a plain conversation calls.
REPLY: Schemas = {"reply": {"prompt": ("string", True), "after": ("reference", False)}}
_TYPES = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT", "reference": "^STRING$", "string|reference": "^STRING$", "references": "^ARRAY<(STRING|VOID)>$"}


def _problems(schemas: Schemas) -> Column:
    """Sorted complaints about a call's `name` and `args`."""
    out = F.when(F.col("name").isNull(), F.array(F.lit("no name")))
    for tool, fields in sorted(schemas.items()):
        checks = []
        for arg, (kind, required) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(F.col("args"), f"$.{arg}", "variant"))
            absent = got.isNull()
            fits = got.rlike(_TYPES[kind])
            if kind == "reference":
                fits = fits & F.coalesce(F.try_variant_get(F.col("args"), f"$.{arg}", "string").startswith("$"), F.lit(False))
            if kind == "integer":  # 1e0 is one too
                number = F.try_variant_get(F.col("args"), f"$.{arg}", "double")
                fits = fits | (got.rlike("^(DOUBLE|DECIMAL)") & F.coalesce(number == F.floor(number), F.lit(False)))
            checks.append(F.when(absent, F.lit(f"missing {arg}") if required else F.lit(None)).when(~fits, F.lit(f"type {arg}")))
        keys = F.coalesce(F.json_object_keys(F.to_json("args")), F.array().cast("array<string>"))
        unknown = F.transform(F.array_except(keys, F.array(*[F.lit(a) for a in sorted(fields)])), lambda k: F.concat(F.lit("unknown "), k))
        out = out.when(F.col("name") == tool, F.sort_array(F.concat(F.array_compact(F.array(*checks)), unknown)))
    return out.otherwise(F.array(F.lit("unknown tool")))


def _references(schemas: Schemas) -> Column:
    """The identifiers that the fields for references of a call's `args` name."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for tool, fields in sorted(schemas.items()):
        one = [F.try_variant_get(F.col("args"), f"$.{arg}", "string") for arg, (kind, _) in sorted(fields.items()) if kind in ("reference", "string|reference")]
        many = [F.coalesce(F.try_variant_get(F.col("args"), f"$.{arg}", "array<string>"), F.array().cast("array<string>")) for arg, (kind, _) in sorted(fields.items()) if kind == "references"]
        every = F.concat(F.array(*one).cast("array<string>"), *many)
        out = out.when(F.col("name") == tool, F.transform(F.filter(every, lambda x: x.startswith("$") & (F.length(x) > 1)), lambda x: F.substring(x, 2, 1 << 30)))
    return out


NODE = ["conv_id", "call_id"]


def _levels(ids: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest chain of others before a call; calls in or behind a cycle have none.

    ids: distinct calls; needs (conv_id, call_id, needs): distinct, among them.
    Chains of calls that each need one other are jumped along, twice as far
    each round; the calls that need several are freed in order after that.
    """
    of = checkpointed(needs.groupBy(NODE).agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("to")))
    one = of.where("n = 1").select("conv_id", "call_id", "to", F.lit(1).alias("far"), F.lit(False).alias("on"))
    rounds = one.count().bit_length() + 1
    for _ in range(rounds):
        further = one.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        one = checkpointed(one.join(further, ["conv_id", "to"], "left").select("conv_id", "call_id", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("on")))
        if one.where("on").isEmpty():
            break
    # who still goes on runs in a circle
    several = of.where("n > 1").select(NODE)
    levels = ids.join(of.select(NODE), NODE, "left_anti").withColumn("level", F.lit(0))
    if not several.isEmpty():
        levels = _freed(levels, needs, checkpointed(several), one)
    chained = one.where("not on").join(levels.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("base")), ["conv_id", "to"])
    return levels.unionByName(chained.select("conv_id", "call_id", (F.col("base") + F.col("far")).alias("level")))


def _freed(levels: DataFrame, needs: DataFrame, several: DataFrame, one: DataFrame) -> DataFrame:
    """`levels` with those of the calls that need several others, each once all that it needs have theirs."""
    ends = one.select("conv_id", F.col("call_id").alias("needs"), F.col("to").alias("end"), "far", "on")
    held = needs.join(several, NODE, "left_semi").join(ends, ["conv_id", "needs"], "left").select("conv_id", "call_id", F.coalesce("end", "needs").alias("to"), (1 + F.coalesce("far", F.lit(0))).alias("far"), F.coalesce("on", F.lit(False)).alias("stuck"))
    held = checkpointed(held.join(levels.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("base")), ["conv_id", "to"], "left"))
    while True:
        ready = held.groupBy(NODE).agg(F.max(F.col("base") + F.col("far")).alias("level"), F.max(F.col("base").isNull() | F.col("stuck")).alias("waits")).where("not waits").select("conv_id", "call_id", "level")
        ready = checkpointed(ready)
        if ready.isEmpty():
            return levels
        levels = checkpointed(levels.unionByName(ready))  # plans stay short however long the chains
        left = held.join(ready.select(NODE), NODE, "left_anti")
        known = ready.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("now"))
        held = checkpointed(left.join(known, ["conv_id", "to"], "left").select("conv_id", "call_id", "to", "far", "stuck", F.coalesce("base", "now").alias("base")))


def _ordered(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, turns): level is null in a cycle and behind one; `turns` tells the two apart: in one."""
    mention = F.explode("refers").alias("needs")
    ids = checkpointed(calls.select(NODE).where("conv_id is not null and call_id is not null").distinct())
    needs = calls.select("conv_id", "call_id", mention).distinct().join(ids.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"])
    needs = checkpointed(needs.select("conv_id", "call_id", "needs"))
    levels = checkpointed(_levels(ids, needs))
    stuck = checkpointed(ids.join(levels, NODE, "left_anti"))
    if stuck.isEmpty():
        return levels.withColumn("turns", F.lit(False))
    # of those, who is needed by no one that is in a cycle only waits: the order of the other direction tells
    back = needs.join(stuck, NODE, "left_semi").join(stuck.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi")
    waiting = _levels(stuck, back.select("conv_id", F.col("needs").alias("call_id"), F.col("call_id").alias("needs")))
    turning = stuck.join(waiting, NODE, "left_anti").withColumn("turns", F.lit(True))
    none = F.lit(None).cast("int")
    return levels.withColumn("turns", F.lit(False)).unionByName(turning.withColumn("level", none)).unionByName(stuck.join(waiting, NODE, "left_semi").withColumn("level", none).withColumn("turns", F.lit(False)))


def as_tool_traffic(conversations: DataFrame) -> DataFrame:
    """Plain turns as calls of `reply` and their results.

    A user turn t is the call `t<t>` with its text as prompt, after `$t<t - 2>`
    (the exchange before, if there is one); an assistant turn t is the result
    of call `t<t - 1>`. Other roles keep their text.
    """
    turn = F.col("turn").cast("long")
    name = lambda t: F.concat(F.lit("t"), t.cast("string"))
    arguments = F.struct(F.col("text").cast("string").alias("prompt"), F.when(turn >= 2, F.concat(F.lit("$"), name(turn - 2))).alias("after"))
    call = F.to_json(F.struct(F.array(F.struct(name(turn).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").cast("string").alias("content")), {"ignoreNullFields": "false"})
    role = F.col("role").cast("string")
    return conversations.select(
        "conv_id", "turn", F.when(role == "user", F.lit("assistant")).when(role == "assistant", F.lit("tool")).otherwise(role).alias("role"),
        F.when(role == "user", call).when(role == "assistant", result).otherwise(F.col("text").cast("string")).alias("text"),
    )


def linked_chats(conversations: DataFrame, schemas: Schemas = TOOLS) -> DataFrame:
    """conv_id, turn, level, seq, kind, role, call_id, status, json.

    kind is message, call or result. status is ok for messages; for calls ok,
    unanswered, duplicate (a later use of an identifier), cycle, behind a cycle
    (it waits for one), or invalid with the complaints; for results ok, or orphan, duplicate. A null text is a message
    with null content; JSON that does not parse, or lacks these fields, is an
    ordinary message. Repeated rows give repeated messages; equal calls count
    as duplicates; of equal results the one of the earliest turn counts. A long
    text is one row like any other. A null conv_id or turn keeps its row, but links nothing.
    Extra columns are not read; an empty table gives no rows.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    like_object = F.col("text").rlike(r"^\s*\{") & F.col("role").isin("assistant", "tool")
    turns = turns.withColumn("v", F.when(like_object, F.try_parse_json("text")))
    calling = F.coalesce((F.col("role") == "assistant") & F.schema_of_variant(F.try_variant_get("v", "$.tool_calls", "variant")).startswith("ARRAY"), F.lit(False))
    answer = F.try_variant_get("v", "$.tool_call_id", "string")
    answering = F.coalesce((F.col("role") == "tool") & answer.isNotNull(), F.lit(False))
    turns = turns.withColumn("calling", calling).withColumn("answering", answering)

    content = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    messages = turns.where(~F.col("calling") & ~F.col("answering")).select(
        "conv_id", "turn", F.lit(0).alias("level"), F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", none.alias("call_id"), F.lit("ok").alias("status"), content.alias("json")
    )

    items = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    calls = turns.where("calling").select("conv_id", "turn", "role", F.posexplode(items).alias("seq", "call")).select(
        "conv_id", "turn", "role", "seq", F.try_variant_get("call", "$.id", "string").alias("call_id"), F.try_variant_get("call", "$.name", "string").alias("name"), F.try_variant_get("call", "$.arguments", "variant").alias("args")
    )
    calls = calls.withColumn("problems", _problems(schemas)).withColumn("refers", _references(schemas))
    results = turns.where("answering").select("conv_id", "turn", "role", answer.alias("call_id"), F.try_variant_get("v", "$.content", "variant").alias("content"))
    key = ["conv_id", "call_id"]
    first_call = calls.groupBy(key).agg(F.min(F.struct("turn", "seq")).alias("first"))
    first_result = results.groupBy(key).agg(F.min("turn").alias("answered"))
    levels = _ordered(calls.join(first_call, key).where((F.col("turn") == F.col("first.turn")) & (F.col("seq") == F.col("first.seq"))))

    linked = calls.join(first_call, key, "left").join(first_result, key, "left").join(levels, key, "left")
    own = (F.col("turn") == F.col("first.turn")) & (F.col("seq") == F.col("first.seq"))
    status = (
        F.when(F.coalesce(~own, F.lit(False)), F.lit("duplicate"))
        .when(F.size("problems") > 0, F.concat(F.lit("invalid: "), F.array_join("problems", "; ")))
        .when(F.col("call_id").isNotNull() & F.col("level").isNull() & F.col("first").isNotNull(), F.when(F.col("turns"), F.lit("cycle")).otherwise(F.lit("behind a cycle")))
        .when(F.col("answered").isNull(), F.lit("unanswered"))
        .otherwise(F.lit("ok"))
    )
    call_json = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name")), {"ignoreNullFields": "false"})
    call_rows = linked.select("conv_id", "turn", F.coalesce("level", F.lit(0)).alias("level"), F.col("seq").alias("seq"), F.lit("call").alias("kind"), "role", "call_id", status.alias("status"), call_json.alias("json"))

    met = results.join(first_call, key, "left").join(first_result, key, "left")
    result_status = F.when(F.col("first").isNull(), F.lit("orphan")).when(F.col("turn") > F.col("answered"), F.lit("duplicate")).otherwise(F.lit("ok"))
    result_json = F.to_json(F.struct(F.col("content").alias("content"), F.col("role").alias("role"), F.col("call_id").alias("tool_call_id")), {"ignoreNullFields": "false"})
    result_rows = met.select("conv_id", "turn", F.lit(0).alias("level"), F.lit(0).alias("seq"), F.lit("result").alias("kind"), "role", "call_id", result_status.alias("status"), result_json.alias("json"))
    return messages.unionByName(call_rows).unionByName(result_rows)

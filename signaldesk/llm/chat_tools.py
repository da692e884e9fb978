"""Tool calls and results of conversations, linked and written as canonical JSON; built-in functions only.

A call is an assistant message of the form ``{"tool_calls": [{"id", "name", "arguments", "after"}]}``; a result is a
``tool`` message ``{"tool_call_id", "content"}``.  Calls and results are hash-joined by (conversation, identifier); calls
are ordered so that each stands after those its ``after`` list names; arguments keep their JSON types and are checked
against the tool's schema; every message is written as JSON with sorted keys at every depth.  Messages of other roles or forms pass through as plain messages.

Defined results: a null text is written as empty content; null ids never link; of repeated ids the earliest call and the
earliest result link and the others are marked ``repeated``; a result without a call is ``orphan``, a call without a
result ``open``; missing arguments are written as ``{}``; calls on a cycle keep level -1; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from signaldesk.llm.common import staged, table

CALL = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant,after:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"

#: Argument schemas: name of the tool, then argument, type and whether it is required.
SCHEMAS = {"reply": {"chars": ("integer", True), "words": ("integer", True), "lines": ("integer", False)},
           "search": {"query": ("string", True), "limit": ("integer", False)},
           "calculate": {"expression": ("string", True)}}
#: A JSON value's type, as the schema of a variant names it.
TYPES = {"integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "string": "^STRING$",
         "object": "^OBJECT.*$", "array": "^ARRAY.*$"}


def quoted(text: Column) -> Column:
    """A JSON string; to_json does the escaping."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("s"))), '(?s)^\\{"s":(.*)\\}$', 1)


def schema_fault(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> Column:
    """Null if the arguments (a variant) fit the tool's schema, else the first fault."""
    fields_of = F.try_variant_get(arguments, "$", "map<string,variant>")
    fault = F.lit("unknown tool")
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_element_at(fields_of, F.lit(field))
            if required:
                checks.append(F.when(value.isNull(), F.lit(f"missing {field}")))
            checks.append(F.when(~F.schema_of_variant(value).rlike(TYPES[kind]), F.lit(f"{field} is no {kind}")))
        extra = F.array_except(F.map_keys(fields_of), F.array(*(F.lit(f) for f in sorted(fields))))
        checks.append(F.when(F.size(extra) > 0, F.concat(F.lit("unexpected "), F.array_min(extra))))
        fault = F.when(name == tool, F.coalesce(*checks)).otherwise(fault)
    return F.when(name.isNull(), F.lit("no name")).when(arguments.isNull(), F.lit("no arguments")).when(fields_of.isNull(), F.lit("arguments are no object")).otherwise(fault)


def canonical_arguments(arguments: Column) -> Column:
    """JSON with sorted keys: a variant holds the fields of its objects in order."""
    return F.coalesce(F.to_json(arguments), F.lit("{}"))


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and plain messages of (conv_id, turn, role, text)."""
    parsed = messages.select("conv_id", "turn", "role", "text",
                             F.when(F.col("role") == "assistant", F.from_json("text", CALL)).alias("call"),
                             F.when(F.col("role") == "tool", F.from_json("text", RESULT)).alias("result"))
    is_call = F.coalesce(F.size("call.tool_calls") > 0, F.lit(False))
    is_result = F.coalesce(F.col("result.tool_call_id").isNotNull(), F.lit(False))
    calls = parsed.where(is_call).select("conv_id", "turn", F.posexplode("call.tool_calls").alias("place", "c")).select("conv_id", "turn", "place", "c.*")
    results = parsed.where(is_result).select("conv_id", "turn", F.col("result.tool_call_id").alias("id"), F.col("result.content").alias("content"))
    return calls, results, parsed.where(~is_call & ~is_result).select("conv_id", "turn", "role", "text")


def levels(calls: DataFrame) -> DataFrame:
    """calls with ``level``: 0 without known predecessors, else one more than the highest of them; -1 on or after a cycle.

    A call's level is the highest of its ``floor`` and, for each of its links, the level of the link's target plus ``d``.
    In each round a link to a settled call goes into the floor, and a link to a call with one link itself jumps to that
    call's target, so chains take a round for each doubling of their length; only where calls with several open links
    follow one another does a round settle no more than the next of them.  Ids are unique within a conversation.
    """
    far = F.lit(1 << 40)  # only jumps round a cycle get there
    known = calls.select("conv_id", F.col("id").alias("to"))
    links = calls.select("conv_id", "id", F.explode(F.array_distinct("after")).alias("to")).join(known, ["conv_id", "to"], "left_semi")
    links = staged(links.select("conv_id", "id", F.lit(0).cast("long").alias("floor"), "to", F.lit(1).cast("long").alias("d")), "links")
    settled = staged(calls.select("conv_id", "id").join(links, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    while not links.isEmpty():
        heads = links.groupBy("conv_id", F.col("id").alias("to")).agg(F.max("floor").alias("low"), F.count("*").alias("n"), F.max(F.struct("to", "d")).alias("one"))
        heads = staged(heads.unionByName(settled.select("conv_id", F.col("id").alias("to"), F.col("level").alias("low"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("struct<to:string,d:long>").alias("one"))), "heads")
        met = links.join(heads, ["conv_id", "to"]).select(
            "conv_id", "id", F.greatest("floor", F.least(F.col("low") + F.col("d"), far)).alias("floor"),
            F.when(F.col("n") == 1, F.col("one.to")).when(F.col("n") > 1, F.col("to")).alias("to"),
            F.when(F.col("n") == 1, F.least(F.col("d") + F.col("one.d"), far)).otherwise(F.col("d")).alias("d"))
        met = staged(met.groupBy("conv_id", "id", "to").agg(F.max("floor").alias("floor"), F.max("d").alias("d")), "met")
        floors = staged(met.groupBy("conv_id", "id").agg(F.max("floor").alias("low"), F.count("to").alias("n")), "floors")
        ready = floors.where("n = 0").select("conv_id", "id", F.col("low").alias("level"))
        if ready.isEmpty():
            break
        settled = settled.unionByName(ready)
        links = staged(met.where("to IS NOT NULL").join(floors.where("n > 0"), ["conv_id", "id"]).select("conv_id", "id", F.col("low").alias("floor"), "to", "d"), "links")
    return calls.join(settled, ["conv_id", "id"], "left").withColumn("level", F.coalesce(F.col("level").cast("int"), F.lit(-1)))


def link_tools(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """conv_id, turn, place, kind, id, level, status, fault and canonical JSON of every message, call and result."""
    calls, results, plain = extract(messages)
    first_call = F.row_number().over(W.partitionBy("conv_id", "id").orderBy("turn", "place"))
    first_result = F.row_number().over(W.partitionBy("conv_id", "id").orderBy("turn", "content"))
    usable = F.col("id").isNotNull() & F.col("conv_id").isNotNull()
    calls = calls.withColumns({"fault": schema_fault(F.col("name"), F.col("arguments"), schemas), "arguments": canonical_arguments(F.col("arguments"))})
    calls = staged(calls.withColumn("nth", F.when(usable, first_call)), "calls")
    results = staged(results.withColumn("nth", F.when(usable, first_result)), "results")
    linked = levels(calls.where("nth = 1").drop("nth")).join(
        results.where("nth = 1").select("conv_id", "id", F.col("turn").alias("result_turn"), F.lit(True).alias("answered")), ["conv_id", "id"], "left")
    others = calls.where("nth IS NULL OR nth > 1").drop("nth").withColumns({"level": F.lit(-1), "result_turn": F.lit(None).cast(dict(messages.dtypes)["turn"]), "answered": F.lit(None).cast("boolean")})
    status = F.when(F.col("level").isNull(), "repeated").when(F.col("answered") & (F.col("result_turn") < F.col("turn")), "answered early").when(F.col("answered"), "linked").otherwise("open")
    body = F.concat(F.lit('{"arguments":'), F.col("arguments"), F.lit(',"id":'), quoted(F.col("id")), F.lit(',"name":'), quoted(F.col("name")), F.lit("}"))
    made = linked.withColumn("status", status).unionByName(others.withColumn("status", F.when(usable, "repeated").otherwise("open"))).select(
        "conv_id", "turn", "place", F.lit("call").alias("kind"), "id", "level", "status", "fault", body.alias("json"))
    named = calls.where("nth = 1").select("conv_id", "id", F.lit(True).alias("called"))
    answers = results.join(named, ["conv_id", "id"], "left").select(
        "conv_id", "turn", F.lit(0).alias("place"), F.lit("result").alias("kind"), "id", F.lit(None).cast("int").alias("level"),
        F.when(F.col("called").isNull(), "orphan").when(F.col("nth") > 1, "repeated").otherwise("linked").alias("status"), F.lit(None).cast("string").alias("fault"),
        F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"role":"tool","tool_call_id":'), quoted(F.col("id")), F.lit("}")).alias("json"))
    said = plain.select(
        "conv_id", "turn", F.lit(0).alias("place"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("level"),
        F.lit("plain").alias("status"), F.lit(None).cast("string").alias("fault"),
        F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")).alias("json"))
    return made.unionByName(answers).unionByName(said)


def as_tool_traffic(conversations: DataFrame) -> DataFrame:
    """The given conversations, with each assistant turn preceded by two tool calls that would yield it and their results.

    The table holds no tool calls of its own, so they are derived from it: turn t first calls ``calculate`` on the size of
    its text, after the ``reply`` of the assistant turn two before, and then ``reply`` with the counts; the results are the
    size and the text.  So a conversation of alternating turns is one chain.  A hash of conversation and turn gives five of eight turns a flaw:
    the reply is called again, has a faulty argument, no result or two, or a result without a call and two calls that
    wait for each other come along.
    """
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("string")
    case = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8))
    size, reply, p, q = (F.concat(F.lit(k), turn) for k in "srpq")
    words, chars = F.size(F.split(text, " ")), F.char_length(text)
    last = F.concat(F.lit("r"), (F.col("turn") - 2).cast("string"))

    def json(**arguments: Column) -> Column:
        return F.to_json(F.struct(*(v.alias(k) for k, v in arguments.items())))

    def made(id: Column, name: str, arguments: Column, after: Column) -> Column:
        return F.struct(id.alias("id"), F.lit(name).alias("name"), F.parse_json(arguments).alias("arguments"), F.array(after).alias("after"))

    def call(*calls: Column) -> Column:
        return F.struct(F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(*calls).alias("tool_calls"))).alias("text"))

    def result(of: Column, content: Column) -> Column:
        return F.struct(F.lit("tool").alias("role"), F.to_json(F.struct(of.alias("tool_call_id"), content.alias("content"))).alias("text"))

    replied = made(reply, "reply", F.when(case == 1, json(words=F.lit("many"), chars=chars)).otherwise(json(words=words, chars=chars)), size)
    sized = made(size, "calculate", json(expression=F.concat_ws("+", words.cast("string"), chars.cast("string"))), last)
    said = F.array(
        call(replied, sized), result(size, chars.cast("string")), F.when(case != 2, result(reply, text)), F.when(case == 0, call(replied)), F.when(case == 3, result(reply, text)),
        F.when(case == 4, call(made(p, "search", json(query=chars.cast("string")), q), made(q, "search", json(query=words.cast("string")), p))), F.when(case == 4, result(F.concat(F.lit("x"), turn), chars.cast("string"))))
    replies = conversations.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(said).alias("k", "m")).where("m IS NOT NULL")
    return conversations.select("conv_id", (F.col("turn") * 8 + 7).alias("turn"), "role", "text").unionByName(
        replies.select("conv_id", (F.col("turn") * 8 + F.col("k")).alias("turn"), "m.role", "m.text"))


def tool_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link_tools(as_tool_traffic(talk))

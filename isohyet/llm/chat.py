"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

DataFrame functions only.  Messages are rows (conv_id, turn, role, text) with
optional link columns:

* ``call_id`` on a call: its identifier, unique in its conversation,
* ``answers`` on a result: the identifier that it answers,
* ``name`` and ``arguments`` (map of string to string) on a call,
* ``needs`` (array of string) on a call: identifiers whose results it uses.

Calls and results are hash-joined by (conv_id, identifier).  A message's place
is (level, turn): a call is one level above the results that it needs, a result
directly after its call, and all else keeps its turn; levels come from rounds
that each settle the calls whose needs are settled (Kahn's algorithm), so a
cycle leaves its calls without a level, and they are flagged and come last.
Where no call has two needs, a round looks twice as far up the chains as the
one before, so long conversations take few rounds.
Arguments are checked against the schema of the tool.  Every message becomes
one line of canonical JSON: keys sorted, no spaces, characters beyond U+001F
as they are except the quote and the backslash.

Cases: null texts are the JSON null; an empty text is ""; very long texts are
kept whole; a result without a call, a call without a result and a repeated
identifier (the first by turn is the call) are flagged; rows without conv_id or
turn come with that value null and take no part in links; an empty table gives
an empty result; repeated rows give repeated lines; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: The escapes of JSON strings that have a short form.
SHORT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
CONTROL = r"[\x00-\x07\x0B\x0E-\x1F]"


@dataclass(frozen=True)
class Parameter:
    """What an argument must be: a pattern that its whole text matches, and the least and most code points."""

    pattern: str = r"(?s).*"
    least: int = 0
    most: int | None = None
    required: bool = True


@dataclass(frozen=True)
class Tool:
    name: str
    parameters: dict[str, Parameter] = field(default_factory=dict)
    additional: bool = False


def json_string(text: Column) -> Column:
    """A JSON string literal; null becomes null."""
    out = text
    for raw, escaped in SHORT_ESCAPES.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    # The other control characters are rare: only texts that have one go through them letter by letter.
    code = lambda c: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))
    slow = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(c.rlike(f"^{CONTROL}$"), code(c)).otherwise(c)), "")
    out = F.when(out.rlike(CONTROL), slow).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def json_object(pairs: dict[str, Column]) -> Column:
    """A JSON object with sorted keys from columns that hold JSON values; a null column leaves its key out."""
    parts = [F.concat(json_string(F.lit(k)), F.lit(":"), v) for k, v in sorted(pairs.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_map(arguments: Column) -> Column:
    """A JSON object of a map of strings, keys in the order of their code points."""
    entries = F.sort_array(F.map_entries(arguments))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_string(e["value"]))), ","), F.lit("}"))


def valid(name: Column, arguments: Column, tools: list[Tool]) -> Column:
    """True if the tool exists and its arguments fit its schema."""
    out = F.lit(False)
    for tool in tools:
        fits = F.lit(True)
        for key, p in tool.parameters.items():
            v = F.try_element_at(arguments, F.lit(key))
            ok = v.rlike(f"^(?:{p.pattern})$") & (F.length(v) >= p.least)
            if p.most is not None:
                ok = ok & (F.length(v) <= p.most)
            fits = fits & F.coalesce(ok, F.lit(not p.required))
        if not tool.additional:
            fits = fits & (F.size(F.array_except(F.map_keys(arguments), F.array(*[F.lit(k) for k in tool.parameters]).cast("array<string>"))) == 0)
        out = F.when(name == tool.name, F.coalesce(fits, F.lit(False))).otherwise(out)
    return out


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level) of calls: 0 without needs, else one more than the highest of the needed calls.

    A need without such a call doesn't hold a call back.  Calls on a cycle are not in the result.
    """
    edges = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("need"))
    edges = scratch.write(edges.join(known, ["conv_id", "need"], "left_semi"), "needs")
    if not edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return _chain_levels(calls, edges, scratch)
    waiting = scratch.write(edges.select("conv_id", "call_id").distinct(), "waiting-0")
    settled = scratch.write(calls.select("conv_id", "call_id").join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "settled-0")
    step, every = 0, settled
    while waiting.limit(1).count():
        step += 1
        at = edges.join(waiting, ["conv_id", "call_id"], "left_semi").join(every.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left")
        ready = at.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("done"), F.max("level").alias("top")).where("n = done")
        new = scratch.write(ready.select("conv_id", "call_id", (F.col("top") + 1).alias("level")), f"settled-{step}")
        if not new.limit(1).count():
            break
        every = every.unionByName(new)
        waiting = scratch.write(waiting.join(new, ["conv_id", "call_id"], "left_anti"), f"waiting-{step}")
    return every


def _chain_levels(calls: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """What ``levels`` returns if a call has one need at most: the calls' distances from the ends of their chains."""
    every = scratch.write(calls.select("conv_id", "call_id").join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "ends")
    waiting = scratch.write(edges.select("conv_id", "call_id", F.col("need").alias("up"), F.lit(1).alias("far")), "chains-0")
    step = 0
    while waiting.limit(1).count():
        step += 1
        known = every.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("above"))
        new = scratch.write(waiting.join(known, ["conv_id", "up"]).select("conv_id", "call_id", (F.col("far") + F.col("above")).alias("level")), f"settled-{step}")
        if not new.limit(1).count():
            break  # what is left runs into cycles
        every = every.unionByName(new)
        left = waiting.join(new.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        # A call that looks up to one that is settled waits for it; the others look as far again.
        ahead = left.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        waiting = left.join(ahead, ["conv_id", "up"], "left").select("conv_id", "call_id", F.coalesce("next", "up").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        waiting = scratch.write(waiting, f"chains-{step}")
    return every


def format_chat(messages: DataFrame, tools: list[Tool]) -> DataFrame:
    """One row per message: conv_id, turn, role, level, place_turn, after_call, status, args_valid, json.

    Within a conversation the messages in the order (level null last,
    place_turn, after_call, turn) are the formatted conversation; no group is
    gathered in one task for that, since the order is in the rows.  status is
    one of message, linked, unanswered, orphan, repeated, cyclic.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    rows = messages.select("conv_id", "turn", "role", "text", "call_id", "answers", "name", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    calls = rows.where("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", F.array_sort("needs").alias("needs"))).alias("c"))
    calls = scratch.write(calls.select("conv_id", "call_id", F.col("c.turn").alias("call_turn"), F.col("c.needs").alias("needs")), "calls")
    if calls.where(F.size("needs") > 0).limit(1).count():
        level = levels(calls, scratch)
    else:
        level = calls.select("conv_id", "call_id", F.lit(0).alias("level"))
    results = rows.where("answers IS NOT NULL").select("conv_id", F.col("answers").alias("call_id")).distinct().withColumn("answered", F.lit(True))
    links = calls.drop("needs").join(level, ["conv_id", "call_id"], "left").join(results, ["conv_id", "call_id"], "left")
    links = scratch.write(links.withColumnsRenamed({"conv_id": "link_conv", "call_id": "link_id"}), "links")
    key = F.coalesce("call_id", "answers")
    out = rows.withColumn("key", key).join(links, (F.col("conv_id") == F.col("link_conv")) & (F.col("key") == F.col("link_id")), "left")
    is_call, is_result = F.col("call_id").isNotNull(), F.col("call_id").isNull() & F.col("answers").isNotNull()
    status = (
        F.when(~is_call & ~is_result, "message")
        .when(is_result & F.col("link_id").isNull(), "orphan")
        .when(is_call & (F.col("turn") != F.col("call_turn")), "repeated")
        .when(F.col("link_id").isNotNull() & F.col("level").isNull(), "cyclic")
        .when(is_call & F.col("answered").isNull(), "unanswered")
        .otherwise("linked")
    )
    linked = F.col("status").isin("linked", "unanswered", "cyclic")
    out = out.withColumn("status", status).withColumn("args_valid", F.when(is_call, valid(F.col("name"), F.col("arguments"), tools)))
    body = {
        "role": json_string(F.col("role")),
        "content": json_string(F.col("text")),
        "tool_call_id": F.when(is_result, json_string(F.col("answers"))),
        "tool_call": F.when(is_call, json_object({"id": json_string(F.col("call_id")), "name": json_string(F.col("name")), "arguments": F.coalesce(json_map(F.col("arguments")), F.lit("null"))})),
    }
    level_of = F.when(F.col("status") == "cyclic", None).when(linked, F.col("level")).otherwise(0)
    return out.select(
        "conv_id", "turn", "role", level_of.cast("int").alias("level"), F.when(linked, F.col("call_turn")).otherwise(F.col("turn")).alias("place_turn"),
        (linked & is_result).alias("after_call"), "status", "args_valid", json_object(body).alias("json"),
    )


def render(formatted: DataFrame) -> DataFrame:
    """(conv_id, json): each conversation as one JSON array in its order; a training example is one row."""
    place = F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("level"), "place_turn", "after_call", "turn", "json")
    lines = F.transform(F.sort_array(F.collect_list(place)), lambda m: m["json"])
    return formatted.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")).alias("json"))


def exchanges(conversations: DataFrame) -> DataFrame:
    """The messages of plain conversations as calls and results: every user turn calls the tool ``reply`` with its
    text, under the identifier ``c<turn>``, and the assistant's next turn, if it is the following one, answers it.
    A call needs the result of the one two turns before it, if there is such a call."""
    by_user, by_assistant = F.col("role") == "user", F.col("role") == "assistant"
    text = F.col("text")
    return conversations.select(
        "conv_id", "turn", "role", F.when(~by_user, text).alias("text"),
        F.when(by_user, F.concat(F.lit("c"), F.col("turn").cast("string"))).alias("call_id"),
        F.when(by_assistant, F.concat(F.lit("c"), (F.col("turn") - 1).cast("string"))).alias("answers"),
        F.when(by_user, F.lit("reply")).alias("name"),
        F.when(by_user, F.create_map(F.lit("to"), F.coalesce(text, F.lit("")), F.lit("turn"), F.coalesce(F.col("turn").cast("string"), F.lit("")))).alias("arguments"),
        F.when(by_user & (F.col("turn") >= 2), F.array(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string")))).alias("needs"),
    )


REPLY = Tool("reply", {"to": Parameter(least=1, most=350), "turn": Parameter(r"[0-9]+")})

"""Chat formatting: tool calls meet their results by identifier, in topological order, as canonical JSON."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from passagework.llm.base import written


@dataclass(frozen=True)
class Argument:
    """One argument in the schema of a tool. `kind` is string, long, double or boolean; `most` bounds length or value."""

    name: str
    kind: str
    required: bool = True
    most: int | None = None
    one_of: tuple[str, ...] = ()


Schemas = dict[str, tuple[Argument, ...]]

_KINDS = {"string": "STRING", "long": "BIGINT", "double": "DECIMAL|DOUBLE|FLOAT|BIGINT", "boolean": "BOOLEAN"}


def _problems(arguments: Column, schema: tuple[Argument, ...]) -> Column:
    """What a schema finds wrong with parsed arguments, as names of problems; all of it is one expression."""
    known = F.array(*[F.lit(a.name) for a in schema]) if schema else F.array().cast("array<string>")
    names = F.json_object_keys(F.to_json(arguments))
    tests = [F.when(F.size(F.array_except(names, known)) > 0, F.lit("unknown argument"))]
    for a in schema:
        value = F.try_variant_get(arguments, f"$.{a.name}", "variant")
        kind = F.schema_of_variant(value)
        missing = F.coalesce(kind, F.lit("VOID")) == "VOID"
        tests.append(F.when(missing, F.lit(f"{a.name}: missing") if a.required else F.lit(None)).when(
            ~kind.rlike(f"^({_KINDS[a.kind]})"), F.lit(f"{a.name}: not {a.kind}")))
        if a.most is not None:
            plain = F.try_variant_get(arguments, f"$.{a.name}", "string" if a.kind == "string" else "double")
            tests.append(F.when((F.length(plain) if a.kind == "string" else plain) > a.most, F.lit(f"{a.name}: above {a.most}")))
        if a.one_of:
            plain = F.try_variant_get(arguments, f"$.{a.name}", "string")
            tests.append(F.when(~plain.isin(*a.one_of), F.lit(f"{a.name}: not allowed")))
    return F.array_compact(F.array(*tests))


def problems(tool: Column, arguments: Column, raw: Column, schemas: Schemas) -> Column:
    """Problems of a call: of its tool's schema, of its JSON, or of its name."""
    chosen = reduce(
        lambda out, name: out.when(tool == name, _problems(arguments, schemas[name])),
        schemas, F.when(F.schema_of_variant(arguments).startswith("OBJECT") != F.lit(True), F.array(F.lit("not an object"))),
    )
    bad = F.when(arguments.isNull(), F.array(F.when(raw.isNull(), F.lit("no arguments")).otherwise(F.lit("not JSON"))))
    return F.coalesce(bad, chosen, F.array(F.lit("unknown tool")))


def ordered(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, root, depth): how many calls come before each one over `after`, in `calls` (conv_id, call_id, after).

    Every round doubles the distance that a call has looked back, so that chains of n calls take log2(n) rounds of
    one join each, and no conversation is gathered in one place. A call after one that is not there starts a chain.
    Calls on a cycle have a null depth. Each round is written before the next reads it.
    """
    keys = ["conv_id", "call_id"]
    known = calls.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"))
    now = calls.join(known, (F.col("conv_id") == F.col("_c")) & (F.col("after") == F.col("_p")), "left")
    now = written(now.select(*keys, F.col("_p").alias("at"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("depth")), "order")
    waiting, most = now.filter("at is not null").count(), now.count()
    reach = 1
    while waiting and reach <= 2 * most:
        seen = now.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"), F.col("at").alias("_at"), F.col("depth").alias("_depth"))
        step = now.join(seen, (F.col("conv_id") == F.col("_c")) & (F.col("at") == F.col("_p")), "left")
        now = written(step.select(
            *keys, F.col("_at").alias("at"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        ), "order")
        before, waiting = waiting, now.filter("at is not null").count()
        reach *= 2
    return now.select(*keys, F.when(F.col("at").isNull(), F.col("depth")).alias("depth"))


def every_call(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for every call and every result that no call is linked with: conv_id, call_id, tool, depth, state, problems and json.

    `calls` has conv_id, call_id, turn, tool, arguments (JSON text) and after (the call it builds on, or null), `results`
    has conv_id, call_id, turn and content. `state` is linked, unanswered (a call without a result), orphan (a
    result without a call), early (its only results come before it) or repeated (a further call or result of an identifier,
    each a row of its own). Linked are the earliest call and the earliest result that does not come before it, or the
    earliest result if all do. `n_calls` and `n_results` count those of the identifier. `json` has sorted keys and no
    blanks. (conv_id, depth, turn, call_id) is a topological order: a call comes after the one it builds on, a result
    with its call.

    Identifiers are joined by hash; a null identifier meets nothing. No row is dropped, and a conversation of any
    length stays spread over its calls.
    """
    key = ["conv_id", "call_id"]

    asked = calls.select(*key, F.struct("turn", "tool", "arguments", "after").alias("call"))
    answered = results.select(*key, F.struct("turn", "content").alias("result"))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = asked.filter(known).groupBy(*key).agg(F.min("call").alias("call"), F.count(F.lit(1)).alias("n_calls"))
    depth = ordered(first.select(*key, F.col("call.after").alias("after")))
    # The earliest result from the call on, or else the earliest of all.
    late = F.when(F.col("result.turn") < F.col("call.turn"), 1).otherwise(0).alias("late")
    told = answered.filter(known).join(first.drop("n_calls"), key, "left").groupBy(*key).agg(
        F.min(F.struct(late, F.col("result"))).getField("result").alias("result"), F.count(F.lit(1)).alias("n_results"))
    both = first.join(told, key, "full_outer").join(depth, key, "left")

    def others(rows: DataFrame, column: str, chosen: DataFrame) -> DataFrame:
        """The rows beside the chosen one of each identifier, of equal rows all but one; and those without identifier."""
        again = rows.filter(known).groupBy(*key, column).agg(F.count(F.lit(1)).alias("_n"))
        again = again.join(chosen.withColumnRenamed(column, "_first"), key)
        left = F.col("_n") - F.when(F.col(column).eqNullSafe(F.col("_first")), 1).otherwise(0)
        again = again.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(left, F.lit(1).cast("long"))))).filter(left > 0)
        counts = both.select(*key, "n_calls", "n_results", "depth")
        again = again.join(counts, key).select(*key, column, "n_calls", "n_results", "depth", F.lit(True).alias("again"))
        one, null = F.lit(1).cast("long"), F.lit(None).cast("long")
        own = (one, null) if column == "call" else (null, one)
        lone = rows.filter(~known).select(
            *key, column, own[0].alias("n_calls"), own[1].alias("n_results"), null.alias("depth"), F.lit(False).alias("again"))
        return again.unionByName(lone)

    more_calls = others(asked, "call", first.select(*key, "call"))
    more_results = others(answered, "result", told.select(*key, "result"))
    rows = both.withColumn("again", F.lit(False)).unionByName(more_calls, allowMissingColumns=True).unionByName(more_results, allowMissingColumns=True)
    rows = rows.withColumn("_parsed", F.try_parse_json("call.arguments"))
    state = (
        F.when(F.col("again"), "repeated").when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "unanswered")
        .when(F.col("result.turn") < F.col("call.turn"), "early").otherwise("linked")
    )
    found = F.when(F.col("call").isNotNull(), problems(F.col("call.tool"), F.col("_parsed"), F.col("call.arguments"), schemas))
    listed = lambda c: F.to_json(F.array(F.col(c)))
    bare = lambda c: F.substr(listed(c), F.lit(2), F.length(listed(c)) - 2)
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("_parsed"), F.lit("null")), F.lit(',"id":'), bare("call_id"),
        F.lit(',"result":'), bare("result.content"), F.lit(',"tool":'), bare("call.tool"), F.lit("}"),
    )
    return rows.select(
        *key, F.col("call.tool").alias("tool"), F.coalesce("call.turn", "result.turn").alias("turn"), "depth", state.alias("state"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.array_join(F.coalesce(found, F.array().cast("array<string>")), "; ").alias("problems"), json.alias("json"),
    )


def linked_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """`every_call` without the repeated ones: one row for every identifier, and for every call and result without one."""
    return every_call(calls, results, schemas).filter("state <> 'repeated'")


# The conversations table ------------------------------------------------------------

#: Tools that a user's turn calls in turn, and what their schemas ask for.
SCHEMAS: Schemas = {
    "search": (Argument("limit", "long", most=8), Argument("query", "string", most=400)),
    "summarise": (Argument("style", "string", one_of=("short", "long")), Argument("text", "string")),
    "translate": (Argument("text", "string"), Argument("to", "string", required=False)),
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from conversations (conv_id, turn, role, text).

    Every user turn calls a tool, chosen by its number, with arguments made of its text; it builds on the user turn two
    before it. Every assistant turn is the result of the call one turn before it. System turns are neither.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    kind = F.pmod(F.col("turn"), F.lit(3))
    arguments = (
        F.when(kind == 0, F.to_json(F.struct(text.alias("query"), F.pmod(F.length(text), F.lit(10)).alias("limit"))))
        .when(kind == 1, F.to_json(F.struct(text.alias("text"), F.when(F.length(text) < 200, "short").otherwise("full").alias("style"))))
        .otherwise(F.to_json(F.struct(F.lit("en").alias("to"), text.alias("text"))))
    )
    tool = F.when(kind == 0, "search").when(kind == 1, "summarise").otherwise("translate")
    calls = turns.filter("role = 'user'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", tool.alias("tool"), arguments.alias("arguments"), name(F.col("turn") - 2).alias("after"))
    results = turns.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results

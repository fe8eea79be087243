"""Types of call receivers, followed along whole chains such as `a.load().items().first()`.

A chain is cut into steps; all calls take their next step together, round by round: the type found so far and the step's name meet the table
of what each type offers, its own members and those of its supertypes, with the type arguments put in. The nearest
level that knows a name decides; where it holds several types, as for overloads that return different ones, the call stays open, and so does a
chain through a type that isn't known, an argument that is missing, or an index into what is no array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusgraf.functions.text import split_parameters
from korpusgraf.operators.lineage import stored

STEP = "struct<name:string,arity:int,index:int>"


def raw(t: Column) -> Column:
    """A type without its arguments and array brackets."""
    return F.regexp_extract(t, r"^\s*([\w$.]+)", 1)


def arguments(t: Column) -> Column:
    """The type arguments of t; `? extends X` is X."""
    inner = F.regexp_extract(t, r"<(.*)>", 1)
    parts = F.when(inner == "", F.array().cast("array<string>")).otherwise(split_parameters(inner))
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^\?\s*(extends|super)\s+", ""))


def put_in(t: Column, names: Column, values: Column) -> Column:
    """t with each of the names, as a word of its own, replaced by the value at its place; null if t needs one that is missing."""
    tokens = F.regexp_extract_all(t, F.lit(r"[\w$.]+|[^\w$.]+"), F.lit(0))

    def one(token: Column) -> Column:
        at = F.array_position(names, token)
        return F.when(at > 0, F.get(values, (at - 1).cast("int"))).otherwise(token)

    done = F.transform(tokens, one)
    return F.when(F.size(names) == 0, t).when(~F.exists(done, lambda x: x.isNull()), F.array_join(done, ""))


def steps(receiver: Column) -> Column:
    """array<struct<name, arity, index>> of a receiver: arity is null for a plain name, index the number of [..] behind it. `new X(..)` keeps its `new`. Arguments
    may nest; of a chain in brackets only the outermost calls count."""
    depth = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(receiver) - F.char_length(F.replace(receiver, F.lit("("), F.lit("")))))
    flat = F.aggregate(depth, F.regexp_replace(receiver, r"\[[^\[\]]*\]", "[]"), lambda s, _: F.regexp_replace(s, r"(\([^()]*)\([^()]*\)", "$1~"))
    parts = F.regexp_extract_all(flat, F.lit(r"(?:new\s+[\w$]+(?:\.[\w$]+)*(?:<[^()]*>)?|[\w$]+)(?:\([^()]*\))?(?:\[\])*"), F.lit(0))

    def one(p: Column) -> Column:
        inside = F.regexp_extract(p, r"\(([^()]*)\)", 1)
        commas = F.char_length(inside) - F.char_length(F.replace(inside, F.lit(","), F.lit("")))
        arity = F.when(F.contains(p, F.lit("(")), F.when(F.trim(inside) == "", 0).otherwise(commas + 1))
        brackets = F.char_length(p) - F.char_length(F.replace(p, F.lit("["), F.lit("")))
        return F.struct(F.trim(F.regexp_replace(p, r"[(\[].*$", "")).alias("name"), arity.cast("int").alias("arity"), brackets.cast("int").alias("index"))

    return F.transform(parts, one)


def supertypes(types: DataFrame, supers: DataFrame) -> DataFrame:
    """type, parent, given, level: each type's supertypes by the nearest level, given being the parent with arguments in terms of the type's own parameters. Level by level
    until no pair is new, so cycles end. types: type, params (array); supers: type, parent (with arguments)."""
    known = types.select(F.col("type").alias("parent"), F.col("params").alias("p_params"))
    direct = supers.select("type", F.col("parent").alias("given")).distinct().withColumn("parent", raw(F.col("given"))).where("type <> parent")
    direct = stored(direct.join(known, "parent").select("type", "parent", "given", "p_params"))
    seen = now = direct.withColumn("level", F.lit(1))
    while True:
        above = direct.select(F.col("type").alias("parent"), F.col("parent").alias("next"), F.col("given").alias("next_given"), F.col("p_params").alias("next_params"))
        new = now.join(above, "parent").select("type", F.col("next").alias("parent"), put_in(F.col("next_given"), F.col("p_params"), arguments(F.col("given"))).alias("given"), F.col("next_params").alias("p_params"), (F.col("level") + 1).alias("level"))
        new = new.where("type <> parent").join(seen.select("type", "parent").distinct(), ["type", "parent"], "left_anti").distinct()
        now = stored(new)
        if now.isEmpty():
            return seen.select("type", "parent", "given", "level")
        seen = seen.unionByName(now)


def offered(types: DataFrame, supers: DataFrame, members: DataFrame) -> DataFrame:
    """type, name, arity (-1 for a field), result (null: several): what a name of each type gives, in terms of the type's parameters. members: type, name, arity (null for a
    field), result."""
    own = members.select("type", "name", F.coalesce("arity", F.lit(-1)).alias("arity"), "result")
    params = types.select(F.col("type").alias("parent"), "params")
    held = own.select(F.col("type").alias("parent"), "name", "arity", "result")
    up = supertypes(types, supers).join(params, "parent").join(held, "parent")
    inherited = up.select("type", "name", "arity", put_in(F.col("result"), F.col("params"), arguments(F.col("given"))).alias("result"), "level")
    every = own.withColumn("level", F.lit(0)).unionByName(inherited)
    by_level = every.groupBy("type", "name", "arity", "level").agg(F.min("result").alias("lo"), F.max("result").alias("hi"), F.count_if(F.col("result").isNull()).alias("open"))
    nearest = F.min_by(F.struct("lo", "hi", "open"), "level").alias("x")
    met = by_level.groupBy("type", "name", "arity").agg(nearest)
    return met.select("type", "name", "arity", F.when((F.col("x.lo") == F.col("x.hi")) & (F.col("x.open") == 0), F.col("x.lo")).alias("result"))


def _indexed(t: Column, index: Column) -> Column:
    """What is left of array type t behind `index` brackets; null if it has fewer."""
    brackets = (F.char_length(t) - F.char_length(F.replace(t, F.lit("[]"), F.lit("")))) / 2
    return F.when(index == 0, t).when(brackets >= index, F.substring(t, F.lit(1), F.char_length(t) - 2 * index))


def chain_types(calls: DataFrame, variables: DataFrame, types: DataFrame, supers: DataFrame, members: DataFrame) -> DataFrame:
    """call_id, type (with arguments; null: open) of each call's receiver. calls: call_id, unit, owner, receiver; variables: unit, name, type.

    The first step is `this`, `super` (if the owner has one direct supertype), `new X(..)`, a call of the owner's own methods, a variable of the unit, a field of the owner or its
    supertypes, or a type's name; the first of these that knows it decides."""
    offers = stored(offered(types, supers, members))
    own_type = F.when(F.size("params") > 0, F.concat(F.col("type"), F.lit("<"), F.array_join("params", ","), F.lit(">"))).otherwise(F.col("type"))
    owners = types.select(F.col("type").alias("owner"), own_type.alias("self"))
    parents = supers.groupBy(F.col("type").alias("owner")).agg(F.min("parent").alias("parent"), F.max("parent").alias("other")).select("owner", F.when(F.col("parent") == F.col("other"), F.col("parent")).alias("parent"))
    # calls of one unit and owner with the same receiver have one type
    key = ["unit", "owner", "receiver"]
    asked = stored(calls.select(*key).distinct().select(F.struct(*key).alias("call"), "unit", "owner", steps(F.col("receiver")).alias("steps"))).where(F.size("steps") > 0)
    first = asked.withColumn("s", F.get("steps", F.lit(0))).withColumn("name", F.col("s.name")).withColumn("arity", F.coalesce("s.arity", F.lit(-1)))
    of_unit = variables.groupBy("unit", "name").agg(F.min("type").alias("v_lo"), F.max("type").alias("v_hi")).withColumn("arity", F.lit(-1))
    of_owner = offers.select(F.col("type").alias("owner"), "name", "arity", F.col("result").alias("m"), F.lit(True).alias("m_known"))
    of_types = types.select(F.col("type").alias("name"), F.lit(-1).alias("arity"), F.col("type").alias("static"))
    met = first.join(of_unit, ["unit", "name", "arity"], "left").join(of_owner, ["owner", "name", "arity"], "left").join(of_types, ["name", "arity"], "left").join(owners, "owner", "left").join(parents, "owner", "left")
    made = F.trim(F.regexp_extract("name", r"^new\s+(.*)$", 1))
    found = (
        F.when((F.col("name") == "this") & (F.col("arity") < 0), F.col("self")).when((F.col("name") == "super") & (F.col("arity") < 0), F.col("parent")).when(made != "", made)
        .when(F.col("v_lo").isNotNull(), F.when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo"))).when(F.col("m_known"), F.col("m")).otherwise(F.col("static"))
    )
    params = types.select(F.col("type").alias("_raw"), "params")
    now = met.select("call", "steps", F.lit(1).alias("at"), _indexed(found, F.col("s.index")).alias("type"))
    out = None
    while True:
        # a type that isn't known ends its chain; types are written first, or each use of one would work it out again
        now = stored(stored(now).withColumn("_raw", raw(F.col("type"))).join(params, "_raw").where(F.size(arguments(F.col("type"))).isin(0) | (F.size(arguments(F.col("type"))) == F.size("params"))))
        ended = now.where(F.col("at") >= F.size("steps")).select("call", "type")
        out = ended if out is None else out.union(ended)
        going = now.where(F.col("at") < F.size("steps"))
        if going.isEmpty():
            break
        step = going.withColumn("s", F.get("steps", F.col("at"))).select("*", F.col("s.name").alias("name"), F.coalesce("s.arity", F.lit(-1)).alias("arity")).where(~F.contains("type", F.lit("[]")))
        offer = offers.select(F.col("type").alias("_raw"), "name", "arity", "result")
        met = step.join(offer, ["_raw", "name", "arity"])
        now = met.select("call", "steps", (F.col("at") + 1).alias("at"), _indexed(put_in(F.col("result"), F.col("params"), arguments(F.col("type"))), F.col("s.index")).alias("type"))
    return calls.select("call_id", F.struct(*key).alias("call")).join(out, "call", "left").select("call_id", "type")

"""Queries of receiver types, over classes written from the parts: class C<n> derives from Box<C<n div 2>>, and offers links to other classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusgraf.operators import receivers
from korpusgraf.sources.adapter import table

TEXTS = ["v.up().boxed().get()", "this.peer.get().up()", "up().pair().second().get()", "new Box<C{0}>(x(1, 2), y).get().up()", "super.get()", "v.up().either()", "many[{0}].get()", "v.missing().up()", "up(a(b, c)).up()"]


def _classes(s, d):
    """n, m: each part and half of its number."""
    return table(s, d, "part").select(F.col("p_partkey").alias("n"), F.expr("p_partkey div 2").alias("m"), (F.col("p_size") % 3 == 0).alias("root"))


def chains(s, d):
    c = _classes(s, d)
    none = F.array().cast("array<string>")
    names = s.createDataFrame([("Base", ["X"]), ("Box", ["E"]), ("Pair", ["A", "B"])], "type string, params array<string>")
    types = c.select(F.concat(F.lit("C"), "n").alias("type"), none.alias("params")).union(names)
    # a root class has no supertype
    supers = c.where("not root").selectExpr("concat('C', n) as type", "concat('Box<C', m, '>') as parent").union(s.createDataFrame([("Box", "Base<E>")], "type string, parent string"))
    shared = s.createDataFrame([("Base", "get", 0, "X"), ("Box", "boxed", 0, "Base<E>"), ("Pair", "first", 0, "A"), ("Pair", "second", 0, "B")], "type string, name string, arity int, result string")
    own = c.select(F.concat(F.lit("C"), "n").alias("type"), F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(arity).cast("int").alias("arity"), F.expr(result).alias("result"))
        for name, arity, result in (("up", 0, "concat('C', m)"), ("boxed", 0, "concat('Box<C', m div 2, '>')"), ("peer", None, "concat('Box<C', n, '>')"), ("pair", 0, "concat('Pair<C', n, ', Box<C', m, '>>')"), ("either", 0, "concat('C', n)"), ("either", 0, "concat('C', m)"), ("many", None, "concat('Box<C', m, '>[]')"))
    ])))
    calls = table(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct().selectExpr("concat(l_orderkey, ':', l_partkey) as call_id", "concat('u', l_partkey) as unit", "concat('C', l_partkey) as owner", f"replace(get(array({', '.join(repr(t) for t in TEXTS)}), cast(l_orderkey % {len(TEXTS)} as int)), '{{0}}', cast(l_partkey as string)) as receiver")
    variables = c.selectExpr("concat('u', n) as unit", "'v' as name", "concat('C', n) as type")
    return receivers.chain_types(calls, variables, types, supers, shared.unionByName(own))


QUERIES = {"chain_types": chains}
SQL = {
    "chain_types": f"""WITH l AS (SELECT DISTINCT l_orderkey || ':' || l_partkey AS call_id, l_orderkey % {len(TEXTS)} AS k, l_partkey AS n, l_partkey // 2 AS m, p_size % 3 = 0 AS root, p_partkey IS NOT NULL AS known FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
t AS (SELECT call_id, CASE WHEN known THEN CASE k WHEN 0 THEN m // 4 WHEN 1 THEN m WHEN 2 THEN m // 2 WHEN 3 THEN m WHEN 4 THEN CASE WHEN NOT root THEN m END WHEN 5 THEN CASE WHEN m = 0 THEN 0 END WHEN 6 THEN m END END AS c FROM l)
SELECT call_id, 'C' || c AS type FROM t""",
}

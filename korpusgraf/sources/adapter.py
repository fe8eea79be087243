"""Projects the star-schema tables onto entities, edges, chunks and vectors, so that graph operators run on any of them.

Each relation is a DataFrame built from its tables and, under the same name, a common table expression of CTES for SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIER, CUSTOMER, PART, ORDER = 1_000_000, 2_000_000, 3_000_000, 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """id, parent_id, source_id, file_path, name, qualified_name, type, start_line, end_line."""
    cols = "id long, parent_id long, source_id int, file_path string, name string, qualified_name string, type string, start_line int, end_line int"
    kinds = [f"cast({{}} as {c.split()[1]}) as {c.split()[0]}" for c in cols.split(", ")]
    pick = lambda df, *e: df.selectExpr(*[k.format(x) for k, x in zip(kinds, e)])
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = "concat(r_name, '/', n_name)"
    parts = [
        pick(table(spark, d, "region"), "r_regionkey", "null", "0", "r_name", "r_name", "r_name", "'region'", "1", "1000"),
        pick(nation, "100 + n_nationkey", "n_regionkey", "0", place, "n_name", "concat(r_name, '.', n_name)", "'nation'", "1", "500"),
        pick(table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), f"{SUPPLIER} + s_suppkey", "100 + s_nationkey", "1", place, "s_name", "concat(n_name, '.', s_name)", "'supplier'", "s_suppkey % 400", "s_suppkey % 400 + 20"),
        pick(table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), f"{CUSTOMER} + c_custkey", "100 + c_nationkey", "2", place, "c_name", "concat(n_name, '.', c_name)", "'customer'", "c_custkey % 450", "c_custkey % 450 + 5"),
        pick(table(spark, d, "part"), f"{PART} + p_partkey", "null", "p_size % 5", "concat(p_brand, '/', p_type)", "p_name", "concat(p_name, '#', p_partkey)", "'part'", "p_partkey % 500", "p_partkey % 500 + p_size"),
        pick(table(spark, d, "orders"), f"{ORDER} + o_orderkey", f"{CUSTOMER} + o_custkey", "3", "concat('orders/', o_custkey)", "concat('ORDER-', o_orderkey)", "concat('ORDER-', o_orderkey)", "'order'", "o_orderkey % 300", "o_orderkey % 300 + 9"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, src_id (an order), dst_id (a part, or null), dst_name, type, resolution, line; the id is built from the row's own columns."""
    e = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return _edge_columns(e, f"case when l_partkey % 17 <> 0 then {PART} + l_partkey end as dst_id")


def targeted_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges whose dst_id is not null. It is what lines and parts are joined by, so a join on it that comes next moves only its other side."""
    lines = table(spark, d, "lineitem").where("l_partkey % 17 <> 0").withColumn("dst_id", F.expr(f"{PART} + l_partkey"))
    return _edge_columns(lines.join(table(spark, d, "part").selectExpr(f"{PART} + p_partkey as dst_id", "p_name"), "dst_id"), "dst_id")


def _edge_columns(lines: DataFrame, dst_id: str) -> DataFrame:
    return lines.selectExpr(
        "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int), cast(round(l_extendedprice * 100) as bigint), cast(unix_timestamp(l_shipdate) as bigint)) as edge_id",
        f"{ORDER} + l_orderkey as src_id",
        dst_id,
        "p_name as dst_name",
        "case when l_linestatus = 'O' and l_linenumber = 1 then 'IMPORTS' when l_returnflag = 'R' then 'CALL' when l_returnflag = 'A' then 'READS' else 'COPY' end as type",
        "case when l_partkey % 17 = 0 then 'unresolved' when l_partkey % 23 = 0 then 'dynamic' else 'resolved' end as resolution",
        "l_linenumber as line",
    )


def writes(spark: SparkSession, d: str) -> DataFrame:
    """supplier -> part edges of type WRITES, one for each pair."""
    return table(spark, d, "lineitem").selectExpr(f"{SUPPLIER} + l_suppkey as src_id", f"{PART} + l_partkey as dst_id", "'WRITES' as type").distinct()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, source, file_path, lang, content of the documents."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.concat_ws("/", "source", "doc_id").alias("file_path"), "lang", F.col("text").alias("content"))


CTES = {
    "entities": f"""entities AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 0 AS source_id, r_name AS file_path, r_name AS name, r_name AS qualified_name, 'region' AS type, 1 AS start_line, 1000 AS end_line FROM region
  UNION ALL SELECT 100 + n_nationkey, n_regionkey, 0, r_name || '/' || n_name, n_name, r_name || '.' || n_name, 'nation', 1, 500 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {SUPPLIER} + s_suppkey, 100 + s_nationkey, 1, r_name || '/' || n_name, s_name, n_name || '.' || s_name, 'supplier', CAST(s_suppkey % 400 AS INT), CAST(s_suppkey % 400 + 20 AS INT) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {CUSTOMER} + c_custkey, 100 + c_nationkey, 2, r_name || '/' || n_name, c_name, n_name || '.' || c_name, 'customer', CAST(c_custkey % 450 AS INT), CAST(c_custkey % 450 + 5 AS INT) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {PART} + p_partkey, NULL, p_size % 5, p_brand || '/' || p_type, p_name, p_name || '#' || p_partkey, 'part', CAST(p_partkey % 500 AS INT), CAST(p_partkey % 500 + p_size AS INT) FROM part
  UNION ALL SELECT {ORDER} + o_orderkey, {CUSTOMER} + o_custkey, 3, 'orders/' || o_custkey, 'ORDER-' || o_orderkey, 'ORDER-' || o_orderkey, 'order', CAST(o_orderkey % 300 AS INT), CAST(o_orderkey % 300 + 9 AS INT) FROM orders)""",
    "edges": f"""edges AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(round(l_extendedprice * 100) AS BIGINT), CAST(epoch(l_shipdate) AS BIGINT)) AS edge_id,
         {ORDER} + l_orderkey AS src_id, CASE WHEN l_partkey % 17 <> 0 THEN {PART} + l_partkey END AS dst_id, p_name AS dst_name,
         CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'IMPORTS' WHEN l_returnflag = 'R' THEN 'CALL' WHEN l_returnflag = 'A' THEN 'READS' ELSE 'COPY' END AS type,
         CASE WHEN l_partkey % 17 = 0 THEN 'unresolved' WHEN l_partkey % 23 = 0 THEN 'dynamic' ELSE 'resolved' END AS resolution, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "writes": f"writes AS (SELECT DISTINCT {SUPPLIER} + l_suppkey AS src_id, {PART} + l_partkey AS dst_id, 'WRITES' AS type FROM lineitem)",
    "chunks": "chunks AS (SELECT doc_id AS chunk_id, source, source || '/' || doc_id AS file_path, lang, text AS content FROM documents)",
}


def with_relations(names: str, body: str) -> str:
    """body with the relations named, and its own CTEs after them (body starts with `name AS (...)` or SELECT)."""
    head = ",\n".join(CTES[n] for n in names.split())
    return f"WITH {head}\n{body}" if body.lstrip().upper().startswith("SELECT") else f"WITH RECURSIVE {head},\n{body}"

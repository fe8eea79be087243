"""Exact top-k inner products by pivot-table elimination.

Each vector x becomes integers floor(1024 * x). With M the greatest norm, the added component sqrt(M^2 - |v|^2) of a candidate (0
for a query) turns the inner product into a distance: |q' - v'|^2 = |q|^2 + M^2 - 2 q.v. Every candidate's distances to the pivots are
computed once and stored beside it; |d(q, p) - d(v, p)| bounds d(q, v) from below for each pivot p, and the greatest of these bounds counts.

Candidates lie in blocks, by their nearest pivot and a hash, and of a block the least and greatest distance to each pivot are known, so a
query's bound for a whole block needs no vector. A query first meets the blocks of least bound that hold k candidates, which gives it a
k-th best distance, and then only those other blocks whose bound does not exceed it. Within a block candidates are evaluated in the order of their
own bounds until these exceed the k-th best distance. Pivots are chosen farthest-first from a sample of at most PIVOT_SAMPLE vectors,
which has no influence on the results.

Cases: vectors that are null, empty, or hold null or non-finite components take no part. Vectors of different lengths never
meet. Ties go to the smaller vec_id. Rows with the same vec_id as the query are the query's own and are left out; a candidate repeated
under one vec_id counts once for each row; a query repeated under one vec_id asks once, and if its rows hold several vectors the best of
all are returned. Null vec_ids take no part. Empty table: no rows. Components and scores beyond the range of a long are its least or
greatest number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.llm.common import stored

SCALE, PIVOTS, STEP = 1024, 24, 256
PIVOT_SAMPLE, MOST_BLOCKS = 2_048, 1 << 14
SCHEMA = "query_id long, ask long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where((F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("double")).alias("v"), F.size(v).alias("dim"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats where every sum stays below 2^53, by longs below 2^62, else by Python's integers, cut
    at the range of a long."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    if most < 2.0**53:
        return np.rint(a @ b).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def farthest_first(lifted: np.ndarray, n: int) -> np.ndarray:
    """Up to n pivots among the rows, each the farthest from those chosen before; the first has the least added component."""
    at, far, chosen = int(lifted[:, -1].argmin()), np.full(len(lifted), np.inf), []
    for _ in range(min(n, len(lifted))):
        chosen.append(at)
        far = np.minimum(far, ((lifted - lifted[at]) ** 2).sum(axis=1))
        at = int(far.argmax())
    return lifted[chosen]


def lift(v: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(top - (v**2).sum(axis=1), 0))])


def to_pivots(lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The table: distances of each row to each pivot."""
    return np.sqrt(np.array([((lifted - p) ** 2).sum(axis=1) for p in pivots]).reshape(len(pivots), len(lifted))).T


class PivotTable:
    """Candidates with their precomputed distances to the pivots (made here where they aren't given)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray | int = PIVOTS, top: float | None = None, table: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], vectors[order]
        self.top = float((self.v**2).sum(axis=1).max()) if top is None else top
        self.pivots = farthest_first(lift(self.v, self.top), pivots) if isinstance(pivots, int) else pivots
        self.table = to_pivots(lift(self.v, self.top), self.pivots) if table is None else table[order]

    def search(self, query_id: int, q: np.ndarray, k: int, within: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best, best first, and how many candidates were evaluated; candidates farther than `within` may be
        left out."""
        norm = float((q**2).sum())
        whole = norm * self.top >= 2.0**120  # scores may be cut at a long's range, where bounds don't tell ties
        to = to_pivots(np.append(q, 0.0)[None], self.pivots)[0]
        bound = np.abs(self.table - to).max(axis=1, initial=0.0)
        order = np.argsort(bound, kind="stable")
        slack = slack_of(norm, self.top)
        ids, scores, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for at in range(0, len(order), STEP):
            if len(ids) == k:
                within = min(within, distance(norm, self.top, scores[-1]))
            if not whole and bound[order[at]] > within + slack:
                break
            part = order[at : at + STEP]
            seen += len(part)
            part = part[self.ids[part] != query_id]
            ids, scores = np.append(ids, self.ids[part]), np.append(scores, products(self.v[part], q))
            best = np.lexsort((ids, -scores.astype(object) if whole else -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores, seen


def distance(norm: float, top: float, score: int) -> float:
    return float(np.sqrt(max(0.0, norm + top - 2.0 * float(score))))


def slack_of(norm: float, top: float) -> float:
    return 1e-6 * (1 + top**0.5 + norm**0.5)  # bounds are floats, scores are exact


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in column])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4_096, query_block: int = 16_384, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row of queries with the rows of vectors."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    v = stored(quantised(vectors, id_col, vector_col))
    q = stored(quantised(queries, id_col, vector_col).dropDuplicates(["vec_id", "v"]).withColumn("ask", F.monotonically_increasing_id()))
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    tops = {r["dim"]: float(r["top"]) for r in v.groupBy("dim").agg(F.max(norm).alias("top")).collect()}  # a row for each length
    sample = v.select("dim", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).toPandas()
    chosen = {int(dim): farthest_first(lift(_matrix(part), tops[dim]), pivots) for dim, part in sample.groupby("dim")["v"]}
    model = sc.broadcast((tops, chosen))  # vectors of a length that the sample lacks have no pivots, and no bounds

    def measured(batches):
        tops, chosen = model.value
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                p = chosen.get(int(dim), np.zeros((0, dim + 1)))
                table = to_pivots(lift(_matrix(part["v"]), tops[dim]), p)
                home = table.argmin(axis=1) if len(p) else np.zeros(len(part), int)
                yield part.assign(home=home.astype("int32"), to=list(table))

    table = stored(v.mapInPandas(measured, "vec_id long, v array<double>, dim int, home int, to array<double>"))
    homes = {(r["dim"], r["home"]): r["n"] for r in table.groupBy("dim", "home").agg(F.count("*").alias("n")).collect()}  # pivots x lengths
    size = max(block, -(-sum(homes.values()) // MOST_BLOCKS))
    cells, first = [], {}
    for (dim, home), n in sorted(homes.items()):
        first[dim, home] = len(cells)
        cells += [(dim, home)] * -(-n // size)
    starts = spark.createDataFrame([(d, h, at, -(-homes[d, h] // size)) for (d, h), at in first.items()], "dim int, home int, at int, parts int")
    dealt = table.join(F.broadcast(starts), ["dim", "home"]).withColumn("cell", F.col("at") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    ends = [f(F.get("to", F.lit(i))).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(pivots)]
    found = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()}  # at most MOST_BLOCKS and a row for each home
    blocks = {}
    for dim in tops:
        mine = [c for c, (d, _) in enumerate(cells) if d == dim and c in found]
        width = len(chosen.get(dim, ()))
        lo, hi = (np.array([[found[c][f"{n}{i}"] for i in range(width)] for c in mine], float).reshape(len(mine), width) for n in ("lo", "hi"))
        blocks[dim] = np.array(mine, int), np.array([found[c]["n"] for c in mine], int), lo, hi
    held = sc.broadcast(blocks)

    def asked(second: bool):
        """The cells that each query asks: those of least bound that hold k candidates besides its own, or the others within its distance."""

        def ask(batches):
            tops, chosen = model.value
            for pdf in batches:
                out = []
                for ask_id, query_id, x, dim, kth in zip(pdf["ask"], pdf["vec_id"], pdf["v"], pdf["dim"], pdf["kth"]):
                    if dim not in held.value:
                        continue
                    q, (number, n, lo, hi) = np.asarray(x, float), held.value[dim]
                    to = to_pivots(np.append(q, 0.0)[None], chosen.get(dim, np.zeros((0, dim + 1))))[0]
                    bound = np.maximum(lo - to, to - hi).max(axis=1, initial=0.0)
                    order = np.argsort(bound, kind="stable")
                    near = int(np.searchsorted(n[order].cumsum(), k + 1)) + 1
                    norm = float((q**2).sum())
                    within = np.inf if kth is None or np.isnan(kth) else distance(norm, tops[dim], kth)
                    far = bound[order[near:]] <= within + slack_of(norm, tops[dim]) if norm * tops[dim] < 2.0**120 else slice(None)
                    out += [(ask_id, query_id, x, within, c) for c in number[order[near:][far] if second else order[:near]].tolist()]
                yield pd.DataFrame(out, columns=["ask", "vec_id", "v", "within", "cell"]).astype({"ask": "int64", "vec_id": "int64", "within": float, "cell": int})

        return ask

    def meet(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "ask": [], "vec_id": [], "score": []}).astype("int64")
        tops, chosen = model.value
        dim = int(candidates["dim"].iloc[0])
        block = PivotTable(candidates["vec_id"].to_numpy(np.int64), _matrix(candidates["v"]), chosen.get(dim, np.zeros((0, dim + 1))), tops[dim], _matrix(candidates["to"]).reshape(len(candidates), -1))
        out = []
        for ask_id, query_id, x, within in zip(queries["ask"], queries["vec_id"], queries["v"], queries["within"]):
            ids, scores, _ = block.search(int(query_id), np.asarray(x, float), k, within)
            out.append(pd.DataFrame({"query_id": np.int64(query_id), "ask": np.int64(ask_id), "vec_id": ids, "score": scores}))
        return pd.concat(out, ignore_index=True)

    def met(second: bool, queries: DataFrame) -> DataFrame:
        asks = stored(queries.mapInPandas(asked(second), "ask long, vec_id long, v array<double>, within double, cell int"))
        wanted = {r["cell"]: -(-r["n"] // query_block) for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
        if not wanted:
            return spark.createDataFrame([], SCHEMA)
        copies = spark.createDataFrame([(int(c), int(n)) for c, n in wanted.items()], "cell int, copies int")
        left = dealt.join(F.broadcast(copies), "cell").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        right = asks.join(F.broadcast(copies), "cell").withColumn("a", F.pmod(F.xxhash64("vec_id", "v"), F.col("copies")).cast("int"))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(sum(wanted.values()), 100_000))
        sides = (left.select("cell", "a", "dim", "vec_id", "v", "to"), right.select("cell", "a", "ask", "vec_id", "v", "within"))
        a, b = (side.repartition(tasks, "cell", "a").groupBy("cell", "a") for side in sides)
        return stored(a.cogroup(b).applyInPandas(meet, SCHEMA))

    near = met(False, q.withColumn("kth", F.lit(None).cast("double")))
    last = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("r", F.row_number().over(last)).where(F.col("r") == k).select("ask", F.col("score").cast("double").alias("kth"))
    both = near.union(met(True, q.join(kth, "ask", "left")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def search_embeddings(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The rows whose vec_id is divisible by `every` ask; all rows answer."""
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

"""Exact vector search, rank fusion and neighbour joins, blocked so that no task meets all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import stored

BEST = "query_id long, id long, score double"


def unit(v: Column) -> Column:
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(d, lambda x: x / norm)


def in_space(vectors: DataFrame, vector_col: str, dimension: int, model: str | None = None, default: str = "default") -> DataFrame:
    """The vectors of one dimension and model; a null model is the default."""
    kept = vectors.where(F.size(vector_col) == dimension)
    return kept.where(F.coalesce("model", F.lit(default)) == model) if model is not None else kept


#: Most cells of the candidates, and vectors from which their centres are chosen; neither has an influence on results.
MOST_CELLS, SAMPLE = 256, 2_048
SLACK = 1e-6


#: Scores of single precision are that near to the exact ones of unit vectors, and to their rounding.
NEAR = 2e-4


def _meet(k: int, same_source: bool):
    """The k best of each query. Where a query knows its k-th score so far (kth), all candidates are compared with that at single precision, and only those near it or above are scored
    exactly; else the k-th best is found by partition. No query sorts all candidates."""

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})]
        if q.empty or c.empty:
            return out[0]
        c = c.sort_values("id")
        ids, cv, cs = c["id"].to_numpy(), np.stack(c["v"].to_numpy()), c["source"].to_numpy()
        single = cv.astype(np.float32)
        known = q["kth"].notna().to_numpy()
        for part_known, rows in ((True, q[known]), (False, q[~known])):
            for at in range(0, len(rows), 256):
                part = rows.iloc[at : at + 256]
                qv, query_ids, sources = np.stack(part["v"].to_numpy()), part["id"].to_numpy(), part["source"].to_numpy()
                if part_known:
                    least = part["kth"].to_numpy()
                    r, x = np.nonzero(~(qv.astype(np.float32) @ single.T < (least - NEAR).astype(np.float32)[:, None]))
                    score = np.round(np.einsum("ij,ij->i", qv[r], cv[x]), 4)
                    ok = ~(score < least[r])
                else:
                    scores = np.round(qv @ cv.T, 4)
                    out_of = query_ids[:, None] == ids
                    if not same_source:
                        out_of |= sources[:, None] == cs
                    scores[out_of] = -np.inf
                    best = -np.partition(-scores, k - 1, axis=1)[:, [k - 1]] if k < len(ids) else -np.inf
                    r, x = np.nonzero(~(scores < best))
                    score = scores[r, x]
                    ok = score != -np.inf
                ok &= (ids[x] != query_ids[r]) & (same_source | (cs[x] != sources[r]))
                r, x, score = r[ok], x[ok], score[ok]
                order = np.lexsort((ids[x], -score, r))
                r, x, score = r[order], x[order], score[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append(pd.DataFrame({"query_id": query_ids[r[first]], "id": ids[x[first]], "score": score[first]}))
        return pd.concat(out, ignore_index=True)

    return meet


def _centres(candidates: DataFrame, cells: int) -> np.ndarray:
    """Centres of cells from a bounded sample by hash: each the vector farthest from those before."""
    rows = candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    x = np.array([r["v"] for r in rows])
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(cells, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def nearest(queries: DataFrame, candidates: DataFrame, k: int, block: int = 8_192, same_source: bool = True) -> DataFrame:
    """query_id, id, score (cosine, four decimals), rank: the k best candidates of each query, ties to the smaller id; its own row is left out, and
    with same_source False every row of its source. Both sides: id, source, v (unit vectors).

    Candidates lie in cells around centres, cells in blocks. A query meets the cell of its nearest centre first; of the others only those whose angle to the centre, less the
    cell's radius, still allows a score as good as its k-th, and in these only candidates with such a score. Queries, too, meet in blocks, each task keeping k a query, so the shuffle holds k rows for each query and block."""
    n, m = candidates.count(), queries.count()
    q_parts = max(1, -(-m // (4 * block)))  # candidates move once for each block of queries
    centres = _centres(candidates, max(1, min(MOST_CELLS, -(-n // block)))) if n else np.zeros((0, 0))
    held = candidates.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS vectors

    @F.pandas_udf("cell int, angle double")
    def place(v: pd.Series) -> pd.DataFrame:
        cos = np.stack(v.to_numpy()) @ held.value.T
        return pd.DataFrame({"cell": cos.argmax(axis=1).astype(np.int32), "angle": np.arccos(np.clip(cos.max(axis=1), -1, 1))})

    @F.pandas_udf("array<double>")
    def angles(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.arccos(np.clip(np.stack(v.to_numpy()) @ held.value.T, -1, 1))))

    if not n:
        return queries.select(F.col("id").alias("query_id"), F.col("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    placed = stored(candidates.select("id", "source", "v", place("v").alias("p")).select("id", "source", "v", "p.*"))
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row a cell
    blocks = F.array(*[F.lit(-(-cells[c]["n"] // block) if c in cells else 0) for c in range(len(centres))])
    radius = F.array(*[F.lit(float(cells[c]["radius"]) if c in cells else 0.0) for c in range(len(centres))])
    right = stored(placed.select("cell", F.pmod(F.xxhash64("id"), F.get(blocks, F.col("cell"))).alias("b"), "id", "source", "v"))
    asking = stored(queries.select("id", "source", "v", F.pmod(F.xxhash64("id"), F.lit(q_parts)).alias("a"), angles("v").alias("angles")))
    # the k-th score that a cell still allows; cells without rows allow none
    bound = F.transform("angles", lambda x, c: F.when(F.get(blocks, c) > 0, F.round(F.cos(F.greatest(F.lit(0.0), x - F.get(radius, c))) + SLACK, 4)).otherwise(-2.0))
    asking = asking.withColumn("bounds", bound).withColumn("first", (F.array_position("angles", F.array_min(F.transform("angles", lambda x, c: F.when(F.get(blocks, c) > 0, x)))) - 1).cast("int"))

    def found(asks: DataFrame) -> DataFrame:
        """The k best of each query within the cells it asks (cells)."""
        each = F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("cell")) - 1).cast("array<long>")).alias("b")
        of_cells = asks.select("a", "id", "source", "v", "kth", F.explode("cells").alias("cell")).where(F.get(blocks, F.col("cell")) > 0)
        left = of_cells.select("a", "cell", each, "id", "source", "v", "kth")  # made where it moves, so that vectors aren't written for each block
        wanted = of_cells.select("a", "cell").distinct().select(F.col("a").alias("_a"), "cell", each)
        met = right.join(wanted, ["cell", "b"]).select(F.col("_a").alias("a"), "cell", "b", "id", "source", "v")
        return left.groupBy("a", "cell", "b").cogroup(met.groupBy("a", "cell", "b")).applyInPandas(_meet(k, same_source), BEST)

    best = stored(found(asking.withColumn("kth", F.lit(None).cast("double")).withColumn("cells", F.array("first"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kth = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    open_ = asking.join(kth, "id", "left")
    more = F.filter(F.sequence(F.lit(0), F.lit(len(centres) - 1)), lambda c: (c != F.col("first")) & (F.col("kth").isNull() | (F.get(F.col("bounds"), c) >= F.col("kth"))))
    if len(centres) > 1:
        best = best.union(found(stored(open_.select("a", "id", "source", "v", "kth", more.alias("cells")))))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_distances(vectors: DataFrame, query: list[float], most: float | None = None) -> DataFrame:
    """id, distance (1 - cosine, four decimals) of all vectors to one query vector, in codegen; with `most` those that aren't farther."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    dot = F.aggregate(F.zip_with(F.col("v"), q, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    out = vectors.select("id", F.round(1 - dot / norm, 4).alias("distance"))
    return out if most is None else out.where(F.col("distance") <= most)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, most: float | None = None) -> DataFrame:
    """id, distance of the k nearest to one query vector, none farther than `most`; a top-k keeps k rows a task."""
    return cosine_distances(vectors, query, most).orderBy("distance", "id").limit(k)


def rank_fusion(channels: list[DataFrame], per_channel: int = 40, k: int = 20, limit: int = 20) -> DataFrame:
    """id, score: sum of 1 / (20 + rank) over channels (id, score; best first), ranks from 0, ties to the larger id."""
    parts = []
    for c in channels:
        best = c.orderBy(F.desc("score"), F.desc("id")).limit(per_channel)
        w = Window.orderBy(F.desc("score"), F.desc("id"))  # over per_channel rows
        parts.append(best.select("id", (1.0 / (F.lit(k) + F.row_number().over(w) - 1)).alias("s")))
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("id").agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(limit)


def ordered_union(channels: list[DataFrame], limit: int) -> DataFrame:
    """id, channel, pos: earlier channels first (id, pos each), every id at its first place only."""
    tagged = [c.select("id", F.lit(i).alias("channel"), "pos") for i, c in enumerate(channels)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.union(t)
    first = both.groupBy("id").agg(F.min(F.struct("channel", "pos")).alias("at")).select("id", "at.channel", "at.pos")
    return first.orderBy("channel", "pos", "id").limit(limit)


def undirected(links: DataFrame, least: float) -> DataFrame:
    """a, b, score: links of a score of at least `least`, each unordered pair once with its best score."""
    return links.where(F.col("score") >= least).groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("score").alias("score"))


def quota_rerank(hits: DataFrame, quotas: dict[str, int], limit: int) -> DataFrame:
    """hits (id, file, kind, score): one hit a file, at most quotas[kind] of a kind (others without bound), best first."""
    per_file = Window.partitionBy("file").orderBy(F.desc("score"), "id")
    per_kind = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    most = F.lit(limit)
    for kind, n in quotas.items():
        most = F.when(F.col("kind") == kind, n).otherwise(most)
    best = hits.withColumn("f", F.row_number().over(per_file)).where("f = 1").withColumn("n", F.row_number().over(per_kind)).where(F.col("n") <= limit).where(F.col("n") <= most)  # the limit is applied before the shuffle
    return best.orderBy(F.desc("score"), "id").limit(limit).drop("f", "n")

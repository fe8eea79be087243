"""SimHash near-dedup: fingerprints of four-word shingles, linked by tiled exact comparison.

Each document's words are lower-cased (A-Z), cut into four-word shingles (repeats included) and hashed by XXH64 with seed 42;
a bit of the 64-bit fingerprint is 1 if it is set in over half of the hashes. Equal fingerprints are one node. Nodes are dealt
into blocks of one population count each, and every pair of blocks whose counts differ by at most the radius meets in one
task, which compares tiles by exclusive-or and bit counts; tiles whose halves' population counts differ beyond the radius
are skipped. A task returns a spanning forest of the links it found, at most one row a node, never all pairs of a group, so no
link between different fingerprints is lost to the components.

Cases: null text or text without words: fingerprint zero, linked like any other. Fewer than four words: the whole sequence
is the only shingle. Repeated rows: each is returned. Null doc_id: returned with its group's smallest id, null if the group has
none. Empty table: no rows. Further columns of docs are not read.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.llm.common import sealed, small_batches, stored, unsealed
from korpusgraf.llm.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
TILE = 1024
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters only
    if not words:
        return 0
    whole = b" ".join(words)
    starts = np.cumsum(np.fromiter((0, *map(len, words)), np.int64, len(words) + 1) + 1) - 1
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    del words
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        hashes = b"".join([digest(whole[a : b - 1], SEED) for a, b in zip(starts[at:to].tolist(), starts[at + k : to + k].tolist())])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprint_of(text: str) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i[k] and j[k] in place; labels[x] is x's root, the least index of its component."""
    while i.size:
        a, b = labels[i], labels[j]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (new := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = new
        open_ = labels[i] != labels[j]
        i, j = i[open_], j[open_]


def _boxes(x: np.ndarray) -> np.ndarray:
    """Least and greatest population counts of the low and high halves of each tile."""
    low, high = np.bitwise_count(x & np.uint64(0xFFFFFFFF)).astype(int), np.bitwise_count(x >> np.uint64(32)).astype(int)
    return np.array([(low[i : i + TILE].min(), low[i : i + TILE].max(), high[i : i + TILE].min(), high[i : i + TILE].max()) for i in range(0, len(x), TILE)])


def _sorted(x: np.ndarray) -> np.ndarray:
    return x[np.lexsort((x, np.bitwise_count(x & np.uint64(0xFFFFFFFF))))]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within left (right None) or between left and right, as a spanning forest of (node, root)."""
    left = _sorted(left)
    right = left if right is None else _sorted(right)
    same = right is left
    nodes = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    labels = np.arange(len(nodes))
    a_box, b_box = _boxes(left), _boxes(right)
    for p, (l0, l1, h0, h1) in enumerate(a_box):
        a = left[p * TILE : (p + 1) * TILE]
        for q in range(p if same else 0, len(b_box)):
            m0, m1, g0, g1 = b_box[q]
            if max(0, m0 - l1, l0 - m1) + max(0, g0 - h1, h0 - g1) > radius:
                continue
            b = right[q * TILE : (q + 1) * TILE]
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            if same and p == q:
                np.fill_diagonal(near, False)
            if near.any():
                near &= labels[p * TILE : p * TILE + len(a), None] != labels[None, shift + q * TILE : shift + q * TILE + len(b)]
                i, j = np.nonzero(near)
                merge_labels(labels, i + p * TILE, j + shift + q * TILE)
    moved = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[moved], nodes[labels[moved]]


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = 32, least_rows: int = 256, most_rows: int = 1 << 20) -> DataFrame:
    """(src, dst) links whose components are those of all pairs of nodes.fp within the radius. Fingerprints of one population count
    are dealt into blocks, and each block meets every block whose count differs by at most the radius, in one group for each pair. How often
    a fingerprint is sent follows the number of blocks, so that number follows the cluster's partitions and not the rows, until a
    block would hold over most_rows. The pairs of blocks are expressions on the row: the plan knows the 65 numbers of blocks only."""
    spark = nodes.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ones = nodes.select("fp", F.bit_count("fp").alias("ones"))
    held = {r["ones"]: r["n"] for r in ones.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    total = sum(held.values())
    size = max(least_rows, min(most_rows, -(-total // max(blocks, isqrt(4 * partitions)))))
    parts = [-(-held.get(c, 0) // size) for c in range(65)]
    n_pairs = sum(parts[c] * (parts[c] + 1) // 2 + parts[c] * sum(parts[c + 1 : c + 1 + radius]) for c in range(65))
    number = F.array(*[F.lit(p) for p in parts])
    own = F.struct(F.col("ones"), F.pmod(F.xxhash64("fp"), number[F.col("ones")]).cast("int").alias("part"))
    near = F.sequence(F.greatest(F.lit(0), F.col("ones") - radius), F.least(F.lit(64), F.col("ones") + radius))
    met = F.flatten(F.transform(near, lambda c: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(1), number[c]) - 1), lambda k: number[c] > 0), lambda k: F.struct(c.alias("ones"), k.alias("part")))))
    dealt = ones.select("fp", own.alias("own"), F.explode(met).alias("other"))
    ends = F.least("own", "other"), F.greatest("own", "other")
    pair = F.concat_ws(":", *[e[x].cast("string") for e in ends for x in ("ones", "part")])
    tasks = max(partitions, min(n_pairs, 1 << 17) // 2)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, side = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["side"].to_numpy()
        a, b = forest(fps[side == 0], fps[side == 1] if (side == 1).any() else None, radius)
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    dealt = dealt.select(pair.alias("pair"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    return dealt.repartition(tasks, "pair").groupBy("pair").applyInPandas(meet, "src long, dst long")


def groups(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, digest) for each row, digest being a hash of the text, and for each fingerprint (fp, component_id, keeper): the
    group's smallest doc_id and the digest of that document, the least one if several have its id."""
    with small_batches(docs):
        fps = stored(docs.select("doc_id", fingerprint_of("text").alias("fp"), _digest("text").alias("digest")))
    first_of = lambda id_, digest: F.min(F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(digest).alias("digest")))
    nodes = stored(fps.groupBy("fp").agg(first_of("doc_id", "digest").alias("k")).select("fp", F.col("k.id").alias("rep"), "k.digest"))
    roots = connected_components(links(nodes, radius))
    of = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", "digest", F.coalesce("root", "fp").alias("root"))
    first = of.groupBy("root").agg(first_of("rep", "digest").alias("k"))
    return fps, of.join(first, "root").select("fp", F.col("k.id").alias("component_id"), F.col("k.digest").alias("keeper"))


def _digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each row of docs."""
    fps, classes = groups(docs, radius)
    return fps.join(classes, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one document of each group: that with the smallest doc_id. Of several rows with that id, the one whose
    text has the least hash stays, and of those with one text the first by its other columns, in their order (nulls first; columns
    that can't be ordered don't count)."""
    held = sealed(docs, "doc_id", "text")
    _, classes = groups(held, radius)
    keep = stored(classes.select(F.col("component_id").alias("_id"), F.col("keeper").alias("_keep")).distinct())
    marked = held.withColumn("_digest", _digest("text"))
    kept = marked.join(keep, marked["doc_id"].eqNullSafe(keep["_id"]) & (marked["_digest"] == keep["_keep"]), "left_semi")
    order = [F.col(c) for c, t in kept.dtypes if not any(x in t for x in ("map<", "variant", "interval"))]
    first = Window.partitionBy("doc_id", "_digest").orderBy(*order)
    return unsealed(kept.withColumn("_n", F.row_number().over(first)).where("_n = 1"), docs.columns, "doc_id", "text")

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are laid on a line of words in an order given by a hash, and the line is cut into blocks. A target of m times the
source's size and a rest takes every block m times (three at most), an epoch each, and of one more epoch as many blocks, in the order of a seeded
permutation, as give the rest; the last of them is cut, so that the words taken are the target, rounded. The numbers of blocks of all
sources are split among the output shards by a binary tree: a node draws its left child's share of each source by the
multivariate hypergeometric law, so that every block has one shard and every source its exact quota. A shard draws its quota of a source
from the epochs' permutations, disjoint from what others draw, and shuffles its rows locally by a hash. What no shard draws is not taken.

Positions on the lines come from prefix sums over hash buckets, so a hot source is spread over many tasks. The driver holds one row a
source, and one number for each source and shard.

Cases: null source is a source of its own, after all others. Null or empty text: size 0, nothing is taken. Rows of one doc_id (null ones
too) and size are ordered by their texts' hashes, so that reruns agree however the rows are dealt. Empty table: no rows.
Further columns pass through mix() and resample(); those named like a column that mix() adds are replaced there and kept by resample().
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from korpusgraf.llm.common import WORD, buckets_for, prefix_sums, sealed, stored, unsealed

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = 20_240_601
#: A word with the white space before it; the last one also with what follows.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]++\z)?"
ADDED = ("source_size", "target", "pieces")
PIECES = "array<struct<shard:int,epoch:int,block:bigint,start:bigint,length:bigint>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often `then` uses it."""
    return F.transform(F.array(value), then)[0]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(sources: Iterable[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Shares of the sum of all sizes by weight, in code point order with null last; what lies above `most` times a source's size is
    shared anew among the others until none is above."""
    names = in_order(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), list(names), {}
    while free:
        each = left / sum(weight[s] for s in free)
        above = [s for s in free if each * weight[s] > most * sizes[s]]
        for s in above or free:
            out[s] = float(most * sizes[s]) if above else each * weight[s]
        left -= sum(out[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def split_blocks(blocks: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): columns sum to `blocks`, rows are as equal as can be."""
    out = np.zeros((shards, len(blocks)), np.int64)

    def node(quota: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = quota
            return
        middle = (first + last) // 2
        take = int(quota.sum()) * (middle - first) // (last - first)
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(quota, take, method="marginals") if quota.sum() else quota
        node(left, first, middle)
        node(quota - left, middle, last)

    node(np.asarray(blocks, np.int64), 0, shards)
    return out


def permuted(x: Column, n: Column, salt: Column, rounds: int = 24) -> Column:
    """Place of x among 0..n-1 in the order that salt draws: in each round x and its mirror at a drawn centre are swapped or not, by
    one drawn bit for the two, so that any n has an exact permutation and no table of it is held."""

    def swap(v: Column, i: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(salt, i), n) - v, n)
        return _let(mirror, lambda m: F.when(F.xxhash64(salt, i, F.greatest(v, m)) % 2 == 0, v).otherwise(m))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


def mix(docs: DataFrame, shards: int = 16, size_col: str = "size", block_words: int = 4_096, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, source, size_col and whatever else) with source_size, target and pieces: array<struct<shard, epoch, block, start,
    length>>, the words of the document that each shard draws, by epoch (from 0) and block (counted on over the epochs). Columns of
    docs that have one of these names are replaced. `ties` order rows of one doc_id and size."""
    known = docs.groupBy("source").agg(F.sum(size_col).alias("words"), F.count("*").alias("rows")).collect()  # one row a source
    sizes = {r["source"]: int(r["words"]) for r in known}
    goal = targets(sizes, weights, most)
    block = max(block_words, -(-sum(sizes.values()) // (1 << 26)))  # the law's draws stay below 1e9 blocks
    spark = docs.sparkSession
    names = in_order(sizes)
    whole = [int(round(goal[s])) for s in names]
    rows = [(i, s is None, s or "", sizes[s], float(goal[s]), w // max(1, sizes[s]), w % max(1, sizes[s]), -(-sizes[s] // block)) for i, (s, w) in enumerate(zip(names, whole))]
    plan = spark.createDataFrame(rows, "_i int, _none boolean, _source string, source_size long, target double, _full long, _rest long, _n long")
    salt = lambda epoch: F.xxhash64(F.lit(seed), "_none", "_source", epoch)
    # In the epoch that is drawn in part, blocks go by their drawn place; the last block of a line is the only shorter one.
    short = F.col("_n") * block - F.col("source_size")
    at_short = F.when(F.col("_n") > 0, permuted(F.col("_n") - 1, F.col("_n"), salt(F.col("_full"))))
    plan = plan.withColumn("_at_short", at_short).withColumn("_short", short)
    ask = {r["_i"]: r for r in plan.collect()}  # one row a source
    blocks = np.array([_drawn_blocks(ask[i], block) for i in range(len(names))], np.int64)
    held = split_blocks(blocks, shards, seed)
    ends = spark.createDataFrame([(i, [int(x) for x in held[:, i].cumsum()]) for i in range(len(names))], "_i int, _ends array<long>")
    plan = plan.join(F.broadcast(ends), "_i")
    needed = ("doc_id", "source", size_col, *ties)
    key = F.xxhash64(F.lit(seed), "doc_id", size_col)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), size_col, *ties)).otherwise(key)  # null ids may be many
    n = sum(r["rows"] for r in known)
    keyed = sealed(docs, *needed).select("*", F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), key.alias("_key"))
    keyed = keyed.withColumn("_bucket", F.floor(F.shiftright("_key", 40) * F.lit(buckets_for(n)) / F.lit(float(1 << 24))))
    placed = prefix_sums(keyed, ["_none", "_source"], "_bucket", [F.col("_key"), F.col("doc_id"), *[F.col(t) for t in ties]], [size_col])
    placed = placed.withColumnRenamed(f"before_{size_col}", "_before").join(F.broadcast(plan), ["_none", "_source"])
    first, last = F.col("_before"), F.col("_before") + F.col(size_col) - 1

    def piece(epoch: Column, b: Column) -> Column:
        """The document's words of block b that the epoch draws. A block's place gives the words drawn before it, and its shard."""

        def drawn_at(place: Column) -> Column:
            before = place * block - F.when(place > F.col("_at_short"), F.col("_short")).otherwise(0)
            given = F.when(epoch < F.col("_full"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("_rest") - before))
            start, to = F.greatest(first, b * block), F.least(last + 1, b * block + given, (b + 1) * block)
            number = epoch * F.col("_n") + place
            shard = F.size(F.filter("_ends", lambda e: e <= number))
            return F.struct(shard.alias("shard"), epoch.cast("int").alias("epoch"), (epoch * F.col("_n") + b).alias("block"), (start - first).alias("start"), (to - start).alias("length"))

        return _let(permuted(b, F.col("_n"), salt(epoch)), drawn_at)

    epochs = F.sequence(F.lit(0).cast("long"), F.least(F.lit(most - 1).cast("long"), F.col("_full")))
    units = F.sequence(F.floor(first / block), F.floor(last / block))
    every = F.flatten(F.transform(epochs, lambda e: F.transform(units, lambda b: piece(e, b))))
    pieces = F.when(F.col(size_col) > 0, F.filter(every, lambda p: (p["length"] > 0) & (p["shard"] < shards)))
    out = placed.withColumn("_pieces", F.coalesce(pieces, F.array().cast(PIECES)))
    own = [F.col(x).alias(c) for x, c in zip(sealed(docs, *needed).columns, docs.columns) if c not in ADDED]
    return out.select(*own, "source_size", "target", F.col("_pieces").alias("pieces"))


def _drawn_blocks(row: Row, block: int) -> int:
    """Blocks that a source gives: all of its full epochs, and of the next one those whose words before them are below the rest."""
    if row["_at_short"] is None:
        return 0
    to_short = min(row["_at_short"] + 1, -(-row["_rest"] // block))
    beyond = -(-(row["_rest"] + row["_short"]) // block)
    return row["_full"] * row["_n"] + (beyond if beyond > row["_at_short"] + 1 else to_short)


def place_in_shard(shard: Column, block: Column, start: Column, doc_id: Column) -> Column:
    """The local shuffle: rows of a shard by this hash."""
    return F.xxhash64(F.lit(SEED), shard, block, start, doc_id)


def drawn(mixed: DataFrame) -> DataFrame:
    """One row for each piece of mix(), with its shard and place there; order rows by (shard, place) to write the shards. Columns named
    like a part of a piece, or `place`, are replaced."""
    parts = mixed.schema["pieces"].dataType.elementType.names
    own = [F.col(f"`{c}`") for c in mixed.columns if c not in (*parts, "place", "pieces")]
    flat = mixed.select(*own, F.explode("pieces").alias("_p")).select(*own, "_p.*")
    return flat.withColumn("place", place_in_shard(F.col("shard"), F.col("block"), F.col("start"), F.col("doc_id")))


def mixture(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of documents, and draws: shard:place:epoch:block:start:length of each
    piece that a shard draws, comma-joined. taken is the sum of these lengths."""
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["length"])
    place = lambda p: place_in_shard(p["shard"], p["block"], p["start"], F.col("doc_id"))
    draw = lambda p: F.concat_ws(":", *[x.cast("string") for x in (p["shard"], place(p), p["epoch"], p["block"], p["start"], p["length"])])
    return mix(sized, shards, ties=("tie",)).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join(F.transform("pieces", draw), ",").alias("draws"))


def resample(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The mixed documents: a row for each piece that a shard draws, in order of shard and place. A document that lies in one block
    comes whole; of others each piece is the text from the white space before its first word to its last word (the text's last piece, to the end), so the
    pieces of a document in order are its text. Documents without words are left out: the mix takes none of
    their words. Partitions hold one shard each, or a range of places of one."""
    needed = ("doc_id", "source", "text", "n_chars")
    sized = sealed(docs, *needed).withColumn("_size", n_words(F.col("text"))).withColumn("_tie", F.xxhash64("text"))
    mixed = mix(sized, shards, "_size", ties=("_tie",))
    cut = F.exists("pieces", lambda p: p["length"] < F.col("_size"))
    words = F.when(cut, F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    texts = _let(words, lambda w: F.transform("pieces", lambda p: F.when(p["length"] == F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(w, p["start"].cast("int") + 1, p["length"].cast("int")), ""))))
    out = drawn(mixed.withColumn("pieces", F.transform(F.arrays_zip(F.col("pieces").alias("p"), texts.alias("t")), lambda x: F.struct(x["p"]["shard"].alias("shard"), x["p"]["block"].alias("block"), x["p"]["start"].alias("start"), x["t"].alias("_text")))))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    part = F.col("shard") * parts + F.floor((F.shiftright("place", 32) / float(1 << 32) + 0.5) * parts).cast("int")
    out = out.withColumn("text", F.col("_text")).repartitionById(shards * parts, part).sortWithinPartitions("shard", "place", "_tie")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return unsealed(out, docs.columns, *needed)

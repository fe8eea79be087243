"""Token search with tiered ranks over entities and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.functions.text import contains_ci, path_tail, starts_with_ci


def all_in(text: Column, tokens: list[str]) -> Column:
    out = F.lit(True)
    for t in tokens:
        out = out & contains_ci(text, F.lit(t))
    return out


def tier_of(name: Column, qualified: Column, query: str, tokens: list[str]) -> Column:
    """0 exact name, 1 prefix, 2 all tokens in the name, 3 in the qualified name's tail, 4 elsewhere."""
    return (
        F.when(F.lower(name) == query.lower(), 0).when(starts_with_ci(name, F.lit(query)), 1).when(all_in(name, tokens), 2).when(all_in(path_tail(qualified), tokens), 3).otherwise(4)
    )


def search_entities(entities: DataFrame, query: str, tokens: list[str], limit: int = 50, type_tiers: dict[str, int] | None = None) -> DataFrame:
    """id, name, tier: the best entities in whose name, qualified name or path all tokens occur."""
    where = F.concat_ws(" ", "name", "qualified_name", "file_path")
    kind = F.lit(2)
    for t, tier in (type_tiers or {}).items():
        kind = F.when(F.col("type") == t, tier).otherwise(kind)
    hit = entities.where(all_in(where, tokens)).withColumn("tier", tier_of(F.col("name"), F.col("qualified_name"), query, tokens))
    return hit.orderBy("tier", kind, F.length("name"), "name", "id").limit(limit).select("id", "name", "tier")


def search_documents(chunks: DataFrame, tokens: list[str]) -> DataFrame:
    """file_path, chunk_id (least), chunks: documents with all tokens in path or content, one row a file."""
    return chunks.where(all_in(F.concat_ws(" ", "file_path", "content"), tokens)).groupBy("file_path").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("chunks"))


def name_hits(entities: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """id, hits: by the number of terms in the name without separators; two are needed if there are more than two."""
    squashed = F.regexp_replace(F.lower("name"), r"[-_. ]", "")
    hits = sum((F.contains(squashed, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return entities.withColumn("hits", hits).where(F.col("hits") >= (2 if len(terms) > 2 else 1)).orderBy(F.desc("hits"), F.length("name"), "id").limit(limit).select("id", "hits")


def lexical_fallback(chunks: DataFrame, words: list[str], limit: int = 10) -> DataFrame:
    """chunk_id, hits: how many of the words a chunk holds, over all chunks."""
    hits = sum((contains_ci(F.col("content"), F.lit(w)).cast("int") for w in words), F.lit(0))
    return chunks.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), "chunk_id").limit(limit).select("chunk_id", "hits")


def symbol_matches(entities: DataFrame, symbols: DataFrame) -> DataFrame:
    """query, id of entities whose name or qualified name equals one of the query's variants. symbols: query, variants."""
    v = symbols.select("query", F.explode("variants").alias("v"))
    by_name = entities.select("id", F.col("name").alias("v"))
    by_qualified = entities.select("id", F.col("qualified_name").alias("v"))
    return v.join(by_name.union(by_qualified), "v").select("query", "id").distinct()


def first_per_file(hits: DataFrame, limit: int = 20) -> DataFrame:
    """One chunk a file: that with the least id."""
    w = Window.partitionBy("file_path").orderBy("chunk_id")
    return hits.withColumn("nr", F.row_number().over(w)).where("nr = 1").drop("nr").orderBy("file_path").limit(limit)


def term_score(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """chunk_id, score: occurrences of the terms, lower-cased, over one plus the logarithm of the length; chunks without one are left out."""
    low = F.translate(F.col("content"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = sum(((F.char_length(low) - F.char_length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in terms), F.lit(0.0))
    return chunks.select("chunk_id", F.round(n / (1 + F.log(F.char_length("content").cast("double") + 1)), 4).alias("score")).where("score > 0")


def bounded(candidates: DataFrame, tokens: list[str], order: list, most: int = 2_000) -> DataFrame:
    """The candidates of a search; where every token is shorter than three characters, so that no index helps, only the first `most` in a unique order."""
    return candidates.orderBy(*order).limit(most) if all(len(t) < 3 for t in tokens) else candidates

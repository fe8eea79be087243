"""Filter interaction audit: what each of five filters removes, in every order of them, by SQL CUBE over the failure flags.

One pass over the texts gives a row its flags A to D and the digest of its text; flag E (identical to a smaller doc_id's text) follows
from the least id of each digest, which is found from counts, so that the rows of a copied text never meet. Documents are then counted
by part, flags and labels, and the counts go through a cube of the five flags and the part: its row with some flags selected, all false,
holds the survivors of these filters. A step of an order is the pair of subsets before and after it.

Cases: null text: the empty text. Null lang: part ''. Null doc_id: E never holds, and no label belongs to it. Repeated rows: each is a
document, and copies of one id are not E of each other. Several labels of one id: a document is good or toxic if any says so. No words:
A holds, B does not; no characters: C does not hold. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusgraf.llm.common import SPACE, UPPER, stored

FLAGS = "ABCDE"
ALL = (1 << len(FLAGS)) - 1
#: 0-based bit of a filter in the number of a subset.
BIT = {f: 1 << i for i, f in enumerate(FLAGS)}
SIGNS = r"[#$%&*|]"
TALLIES = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """Conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, capitals = F.size(words), F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {"A": n < 100, "B": F.size(F.array_distinct(words)) * 100 < n * 80, "C": capitals * 100 > F.char_length(text) * 10, "D": text.rlike(SIGNS)}


def flag_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of the failing filters), good, toxic, n: documents of these. No text is shuffled, and rows that share a text are summed
    before they meet."""
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(c, BIT[f]).otherwise(0) for f, c in text_flags(text).items()), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = rows.groupBy("digest", "mask", "part", "doc_id").agg(F.count("*").alias("c"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    marks = marks.withColumnRenamed("doc_id", "key")
    # rows without an id are dealt by their digest, not gathered under the null
    met = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest"))).join(marks.withColumn("has", F.lit(True)), "key", "left").withColumn("own", F.col("has") & F.col("doc_id").isNotNull())
    marked = met.select("digest", "mask", "part", "doc_id", "c", *[F.when(F.col("own"), F.col(x)).otherwise(0).alias(x) for x in ("good", "toxic")])
    same = marked.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("c").alias("c"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("c_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))), F.lit(0)).alias("c_null")
    )
    same = stored(same)
    first = same.groupBy("digest").agg(F.min("least").alias("first"))
    firsts = F.col("c_null") + F.when(F.col("least") == F.col("first"), F.col("c_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), firsts.alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), (F.col("c") - firsts).alias("n")))
    split = same.join(first, "digest").select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    return split.groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def survivors(counts: DataFrame) -> DataFrame:
    """part, subset, n, good, toxic: documents of the part that pass every filter of the subset, for all subsets, zeros included."""
    flags = [(F.col("mask").bitwiseAND(BIT[f]) != 0).alias(f) for f in FLAGS]
    cubed = counts.select("part", *flags, "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic")).cube(*FLAGS, "part").agg(
        *[F.sum(x).alias(x) for x in TALLIES], F.grouping("part").alias("over_parts"), sum(((1 - F.grouping(f)) * BIT[f] for f in FLAGS), F.lit(0)).alias("subset")
    )
    passed = ~F.greatest(*[F.coalesce(f, F.lit(False)) for f in FLAGS])
    kept = cubed.where("over_parts = 0").groupBy("part", F.col("subset").cast("int").alias("subset"))
    return kept.agg(*[F.sum(F.when(passed, F.col(x)).otherwise(0)).alias(x) for x in TALLIES])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    alive = stored(survivors(flag_counts(docs, labels)))
    named = lambda name: alive.select("part", F.col("subset").alias(f"{name}_set"), *[F.col(x).alias(f"{name}_{x}") for x in TALLIES])
    filters = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("bit")) for f, b in BIT.items()])).alias("x")
    pairs = named("before").select("*", filters).select("*", "x.*").drop("x").where("before_set & bit = 0").withColumn("after_set", F.expr("before_set | bit")).join(named("after"), ["part", "after_set"])
    # orders in which exactly the earlier filters come first
    factorial = F.array(*[F.lit(n) for n in (1, 1, 2, 6, 24)])
    earlier = F.bit_count("before_set")
    pairs = pairs.withColumn("removed", F.col("before_n") - F.col("after_n")).withColumn("orders", F.get(factorial, earlier) * F.get(factorial, 4 - earlier))
    ends = lambda subset, n, by: alive.where(subset).select("part", F.col("n").alias(n), F.expr(by).alias("bit"))
    alone = ends("bit_count(subset) = 1", "n_alone", "subset")
    others = ends("bit_count(subset) = 4", "n_others", f"{ALL} - subset")
    whole = alive.groupBy("part").agg(F.sum(F.when(F.col("subset") == 0, F.col("n"))).alias("n_none"), F.sum(F.when(F.col("subset") == ALL, F.col("n"))).alias("n_every"))
    shares = pairs.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    per_filter = shares.join(alone, ["part", "bit"]).join(others, ["part", "bit"]).join(whole, "part")
    steps = [("".join(p), i + 1, sum(BIT[f] for f in p[:i]), BIT[f]) for p in permutations(FLAGS) for i, f in enumerate(p)]
    order = spark.createDataFrame(steps, "filter_order string, step int, before_set int, bit int")  # 600 rows
    out = pairs.join(per_filter, ["part", "bit"]).join(F.broadcast(order), ["before_set", "bit"])
    return out.select(
        "part", "filter_order", "step", F.col("after_n").alias("kept"), "removed", (F.col("n_none") - F.col("n_alone") - F.col("removed")).alias("redundant"),
        (F.col("n_others") - F.col("n_every")).alias("unique_fails"), (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley",
    )


SQL = r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT t.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x),
  regexp_matches(x, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false)] AS fails FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS p FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT p, k AS step, list_transform(string_split(p[:k - 1], ''), lambda y: ascii(y) - 64) AS earlier, ascii(p[k]) - 64 AS own FROM o, range(1, 6) r(k)),
g AS (SELECT part, good, toxic, n, p, step, fails[own] AS hit, len(list_filter(earlier, lambda y: coalesce(fails[y], false))) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS n_fails, own FROM c, s),
r AS (SELECT part, p AS filter_order, CAST(step AS INT) AS step, own, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (hit AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0) AS BIGINT) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

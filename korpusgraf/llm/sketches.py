"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A text's words (lower-cased A-Z) give five-word shingles; a shingle's hash chains its words' XXH64. The sketch keeps every hash in the
lowest 1/SCALE of the range, and always the FLOOR lowest, so that short texts are compared whole. Sketches of parts merge into the sketch
of the union (keep what is below the threshold or among the FLOOR lowest). Two sketches are compared below the lower of the bounds up
to which both are complete: shared hashes over all give the Jaccard estimate, shared over one's own the containment.

Cases: null text is empty: fingerprint ''. Fewer than five words: the whole sequence is the only shingle. Two empty fingerprints:
likeness 1. One empty: 0. Repeated rows and equal ids: ordered by id, then text. Null doc_id: after all ids. A table of one row: its next document is
itself. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.llm.common import SPACE, ascii_lower

SHINGLE, SCALE, FLOOR = 5, 8, 16
LEAST = -(1 << 63)
THRESHOLD = LEAST + (1 << 64) // SCALE
TOP = (1 << 63) - 1


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often `then` uses it."""
    return F.transform(F.array(value), then)[0]


def _shingles(words: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    out = F.when(F.size(words) >= SHINGLE, F.transform(at, lambda i: F.xxhash64(*[words[i + k] for k in range(SHINGLE)])))
    for n in range(1, SHINGLE):
        out = out.when(F.size(words) == n, F.array(F.xxhash64(*[words[k] for k in range(n)])))
    return out.otherwise(F.array().cast("array<long>"))


def sketch(text: Column) -> Column:
    """Ascending array<long> of the kept hashes, as signed numbers."""
    words = F.transform(F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    return _let(words, lambda w: kept(F.array_sort(F.array_distinct(_shingles(w)))))


def kept(hashes: Column) -> Column:
    """Of ascending distinct hashes, those below the threshold and at least the FLOOR lowest."""
    return _let(hashes, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(F.filter(h, lambda x: x < THRESHOLD)), F.lit(FLOOR))))


def merged(a: Column, b: Column) -> Column:
    return kept(F.array_sort(F.array_union(a, b)))


def complete_to(s: Column) -> Column:
    """The bound up to which a sketch holds every hash of its text."""
    return F.when(F.size(s) < FLOOR, F.lit(TOP)).otherwise(F.greatest(F.lit(THRESHOLD - 1), F.element_at(s, -1)))


def _below(a: Column, b: Column) -> Column:
    """Both sketches up to the lower of their bounds, and what they share there: array<array<long>>."""
    cut = _let(F.least(complete_to(a), complete_to(b)), lambda to: F.array(F.filter(a, lambda h: h <= to), F.filter(b, lambda h: h <= to)))
    return _let(cut, lambda c: F.array(c[0], c[1], F.array_intersect(c[0], c[1])))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts' shingles."""
    n = lambda s, k: F.size(s[k])
    return _let(_below(a, b), lambda s: F.when(n(s, 0) + n(s, 1) == 0, (a == b).cast("double")).otherwise(n(s, 2) / (n(s, 0) + n(s, 1) - n(s, 2))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; null if a has none below the common bound."""
    return _let(_below(a, b), lambda s: F.when(F.size(s[0]) > 0, F.size(s[2]) / F.size(s[0])))


def digits(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _place(ends: list[int], x: Column) -> tuple[Column, Column]:
    """The part of x among descending ends, and whether x is an end; searched in two levels, so that many parts cost little a row."""
    step = max(1, round(len(ends) ** 0.5))
    literal = lambda xs: F.array(*[F.lit(e).cast("long") for e in xs])
    rows = F.array(*[literal(ends[i : i + step]) for i in range(0, len(ends), step)])
    group = F.size(F.filter(literal(ends[::step]), lambda e: e >= x)) - 1
    row = F.get(rows, group)
    return group * step + F.size(F.filter(row, lambda e: e >= x)) - 1, F.array_contains(row, x)


def with_next(docs: DataFrame, id_col: str, cols: list[str], parts: int | None = None) -> DataFrame:
    """Adds next_<c> for each c of cols: its value in the next row by descending id, nulls last, ties by text; after the last row comes
    the first.

    Ids are cut at quantiles, which are ids of the table; the row that begins a part is also given to the part before it, so that each
    part finds every next row by its own window, and no part but one row depends on another."""
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    at = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n + 1)], 20 * n).alias("q"), F.max(id_col).alias("top")).first()
    ends = sorted({*(at["q"] or []), at["top"]} - {None}, reverse=True)  # the greatest id of each part
    last = F.lit(max(0, len(ends) - 1))
    if ends:
        number, begins = _place(ends, F.col(id_col))
        part = F.when(F.col(id_col).isNull(), last).otherwise(number)
        also = F.when(F.col(id_col) == F.lit(ends[0]), last).when(begins, number - 1)
    else:
        part, also = F.lit(0), F.when(F.col(id_col).isNull(), F.lit(0))
    at = F.filter(F.array(F.struct(part.cast("int").alias("p"), F.lit(False).alias("guest")), F.struct(also.cast("int").alias("p"), F.lit(True).alias("guest"))), lambda x: x["p"].isNotNull())
    rows = docs.select("*", F.explode(at).alias("_at"))
    w = Window.partitionBy("_at.p").orderBy("_at.guest", F.desc_nulls_last(id_col), *cols)
    out = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])
    return out.where(~F.col("_at.guest")).drop("_at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("a", sketch(F.col("text")))
    paired = with_next(own, "doc_id", ["text", "a"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    made = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "a", F.col("next_a").alias("x"))
    made = made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", "x", sketch(F.col("edited")).alias("e"))
    return made.select("doc_id", "n_chars", "edited_sha256", digits(F.col("a")).alias("fingerprint"), digits(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("x")).alias("near_next"))

"""Evidence packs shrunk by priority until they fit: what is redundant goes first, what answers the question last.

A pack is one row with its items (entry, block, nr, text). Steps are tried in order, each on the entries from the last to the first and up to eight times on each, and nothing
more is taken away once the pack fits. The whole plan is one expression on the row, so packs need no other row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIES = 8
#: What an item costs besides its text.
ITEM_COST = 10


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _of(block: str, entry: Column) -> Callable[[Column], Column]:
    return lambda x: (x["entry"] == entry) & (x["block"] == block)


def _count(items: Column, block: str, entry: Column) -> Column:
    return F.size(F.filter(items, _of(block, entry)))


@dataclass(frozen=True)
class Drop:
    """Takes a block away; if `beside` is given, only where the entry has that block too."""

    block: str
    beside: str | None = None

    def on(self, items: Column, entry: Column) -> Column:
        gone = F.filter(items, lambda x: ~_of(self.block, entry)(x))
        return gone if self.beside is None else F.when(_count(items, self.beside, entry) > 0, gone).otherwise(items)


@dataclass(frozen=True)
class Keep:
    """Keeps the first n items of a block."""

    block: str
    n: int

    def on(self, items: Column, entry: Column) -> Column:
        first = lambda own: F.get(F.array_sort(F.transform(own, lambda x: x["nr"])), F.lit(self.n - 1))
        return _let(first(F.filter(items, _of(self.block, entry))), lambda last: F.filter(items, lambda x: ~(_of(self.block, entry)(x) & F.coalesce(x["nr"] > last, F.lit(False)))))


@dataclass(frozen=True)
class Pop:
    """Takes the last item of a block while it has more than n."""

    block: str
    n: int

    def on(self, items: Column, entry: Column) -> Column:
        last = F.array_max(F.transform(F.filter(items, _of(self.block, entry)), lambda x: x["nr"]))
        return F.when(_count(items, self.block, entry) > self.n, _let(last, lambda m: F.filter(items, lambda x: ~(_of(self.block, entry)(x) & (x["nr"] == m))))).otherwise(items)


@dataclass(frozen=True)
class Cut:
    """Cuts the texts of a block to so many characters."""

    block: str
    chars: int

    def on(self, items: Column, entry: Column) -> Column:
        return F.transform(items, lambda x: F.when(_of(self.block, entry)(x), x.withField("text", F.substring(x["text"], 1, self.chars))).otherwise(x))


@dataclass(frozen=True)
class Shrink:
    """Takes the last fifth of the lines of the longest text of some blocks, the earlier block and item among equals, and leaves four lines at least."""

    blocks: tuple[str, ...]
    lines: int = 4

    def on(self, items: Column, entry: Column) -> Column:
        place = F.lit(len(self.blocks))
        mine = lambda x: (x["entry"] == entry) & x["block"].isin(list(self.blocks))

        def rank(x: Column) -> Column:
            at = place
            for i, b in enumerate(self.blocks):
                at = F.when(x["block"] == b, i).otherwise(at)
            return F.struct((-F.char_length(x["text"])).alias("size"), at.alias("block"), x["nr"].alias("nr"))

        longest = F.array_min(F.transform(F.filter(items, mine), rank))

        def less(text: Column) -> Column:
            return _let(F.split(text, "\n"), lambda l: F.when(F.size(l) > self.lines, F.array_join(F.slice(l, F.lit(1), F.greatest(F.lit(self.lines), F.floor(F.size(l) * 0.8).cast("int"))), "\n")).otherwise(text))

        return _let(longest, lambda best: F.transform(items, lambda x: F.when(F.coalesce(mine(x) & (rank(x) == best), F.lit(False)), x.withField("text", less(x["text"]))).otherwise(x)))


#: The order of an answer's evidence: redundant blocks, the largest sources, lists, and last the blocks that answer directly.
ANSWER = (
    Drop("other_matches"), Shrink(("expanded", "helper_methods", "callee_chain")), Drop("callees", "control_flow"), Drop("callee_chain", "control_flow"), Cut("call_sites", 700), Keep("data_access", 6), Keep("used_by", 8), Keep("callers", 3), Keep("callees", 6),
    Pop("call_sites", 1), Drop("call_sites"), Drop("data_access"), Pop("expanded", 1), Pop("helper_methods", 1), Drop("helper_methods"), Drop("callees"), Drop("callee_chain"), Pop("data_origin", 5), Pop("control_flow", 6),
)


def pack_size(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda acc, x: acc + F.char_length(x["text"]) + ITEM_COST)


def _while_over(limit: int, step) -> Callable[[Column, Column], Column]:
    return lambda items, entry: F.when(pack_size(items) <= limit, items).otherwise(step.on(items, entry))


def fitted(packs: DataFrame, limit: int, steps: tuple = ANSWER) -> DataFrame:
    """packs (id, items: array<struct<entry int, block string, nr int, text string>>, no nulls) with items shrunk by the steps until the pack's size is at most `limit`, or nothing is left to
    take; and size, fits. (entry, block, nr) names one item."""
    entries = F.reverse(F.array_sort(F.array_distinct(F.transform("items", lambda x: x["entry"]))))
    turns = F.flatten(F.transform(entries, lambda e: F.array_repeat(e, TRIES)))
    out = packs.withColumn("_turns", turns)
    kept = F.col("items")
    for s in steps:
        kept = F.aggregate("_turns", kept, _while_over(limit, s))
    size = pack_size(F.col("items"))
    return out.withColumn("items", kept).select("id", "items", size.alias("size"), (size <= limit).alias("fits"))

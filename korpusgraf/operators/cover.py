"""Full-text search with a rank by cover density: how many short passages hold the whole query.

A query is written as for a web search: words must all occur, "quoted words" follow each other, `or` begins another alternative, and `-` excludes a
word or a quote. The words of a text that the query knows are its posting list, in order of position. One sweep over the list keeps the
latest start of every operand; whenever the start of the last window moves on, a minimal window ends. A window counts
a tenth, over one more than the words in it that the query doesn't know."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
WEIGHT = 0.1
Phrase = tuple[str, ...]


@dataclass(frozen=True)
class Alternative:
    needs: tuple[Phrase, ...]
    excludes: tuple[Phrase, ...]


def parsed(query: str) -> list[Alternative]:
    """The alternatives of a query; those that need and exclude nothing are left out. A word with signs inside is a phrase of its parts."""
    out: list[tuple[list, list]] = [([], [])]
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        words = tuple(re.findall(r"[^\W_]+", (quoted or bare).lower()))
        if bare.lower() == "or" and not minus:
            out.append(([], []))
        elif words:
            out[-1][bool(minus)].append(words)
    return [Alternative(tuple(dict.fromkeys(a)), tuple(dict.fromkeys(b))) for a, b in out if a or b]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def postings(text: Column, words: set[str]) -> Column:
    """array<struct<pos, word>>: where the words stand in the lower-cased text, counted in words."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    return F.filter(found, lambda h: h["word"].isin(sorted(words)))


def _ends_at(hits: Column, r: Column, phrase: Phrase) -> Column:
    """Whether the phrase ends at hit r. All its words are hits, so it is a run of hits at following positions."""
    k = len(phrase)
    at = lambda m: F.get(hits, r - (k - 1 - m))
    same = at(k - 1)["word"] == phrase[-1]
    for m in range(k - 1):
        same = same & (at(m)["word"] == phrase[m])
    return F.coalesce(same & (at(k - 1)["pos"] - at(0)["pos"] == k - 1), F.lit(False))


def _sweep(hits: Column, phrases: list[Phrase], needs: list[list[int]]) -> Column:
    """struct<last: latest start of each phrase or -1, start: of the last minimal window, covers, rank> after all hits."""
    zero = F.struct(F.array(*[F.lit(-1)] * len(phrases)).alias("last"), F.lit(-1).alias("start"), F.lit(0).alias("covers"), F.lit(0.0).alias("rank"))

    def window_start(last: Column) -> Column:
        starts = [F.array_min(F.array(*[F.get(last, F.lit(j)) for j in group])) for group in needs if group]
        return F.array_max(F.array(*starts)) if starts else F.lit(-1)

    def step(acc: Column, r: Column) -> Column:
        last = F.array(*[F.when(_ends_at(hits, r, p), r - (len(p) - 1)).otherwise(F.get(acc["last"], F.lit(j))) for j, p in enumerate(phrases)])

        def moved(last: Column) -> Column:
            def ended(start: Column) -> Column:
                new = start > acc["start"]
                noise = F.get(hits, r)["pos"] - F.get(hits, start)["pos"] - (r - start)
                return F.struct(last.alias("last"), F.greatest(start, acc["start"]).alias("start"), (acc["covers"] + new.cast("int")).alias("covers"), (acc["rank"] + F.when(new, WEIGHT / (1 + noise)).otherwise(0.0)).alias("rank"))

            return _let(window_start(last), ended)

        return _let(last, moved)

    ranks = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ranks, zero, step)


def cover_rank(docs: DataFrame, query: str, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """id_col, covers, rank of the texts that an alternative of the query fits: all it needs occurs, nothing it excludes. A text that fits only by what it lacks has no
    covers. Null texts are empty. A row needs no other row, so nothing is shuffled."""
    alternatives = parsed(query)
    phrases = list(dict.fromkeys(p for a in alternatives for p in (*a.needs, *a.excludes)))
    if not phrases:
        return docs.select(id_col, F.lit(0).alias("covers"), F.lit(0.0).alias("rank")).where(F.lit(False))
    words = {w for p in phrases for w in p}
    hits = docs.select(id_col, postings(F.coalesce(text_col, F.lit("")), words).alias("hits"))
    sweep = _sweep(F.col("hits"), phrases, [[phrases.index(p) for p in a.needs] for a in alternatives])
    swept = hits.select(id_col, F.inline(F.array(sweep)))  # a generator, so that the filter below doesn't bring the sweep into its own condition
    has = lambda p: F.get(F.col("last"), F.lit(phrases.index(p))) >= 0
    fits = F.lit(False)
    for a in alternatives:
        one = F.lit(True)
        for p in a.needs:
            one = one & has(p)
        for p in a.excludes:
            one = one & ~has(p)
        fits = fits | one
    return swept.where(fits).select(id_col, "covers", "rank")

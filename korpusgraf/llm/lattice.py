"""Language-model scoring by the likelihood of subword lattices.

The pieces are those of an existing subword vocabulary. Its own segmentations of the training words, weighted by the words' counts,
give each piece its unigram score, and, if rounds are asked for, expected counts over all segmentations a better one (each round reads all words);
bytes stand in for characters that no piece covers, and one end piece closes a text. A word's
probability is the sum over all its segmentations into pieces, by forward recursion in log space; a text's probability is the product
over its words and the end, so that the result is the marginal over all segmentations of the document.

Words are counted over the whole corpus. Every distinct word is scored once, in parallel; words that make up at least one in HOT of all
tokens (HOT words at most, by that bound, and only short ones) are broadcast and summed where the texts are read, and the others are
joined by shuffle, so that no frequent word gathers its documents in one task.

Cases: null or empty text: no words, only the end token. Nothing to learn from: all counts 0, scores by the smoothed uniform piece
weights. Repeated rows and null doc_ids: each row is scored. Very long texts and words are read whole. Further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusgraf.llm.common import crc_of_id, small_batches, stored

HOT, HOT_BYTES = 1 << 18, 64
BASE, SPREAD, BITS, MASK = 0x100000001B3, 0x9E3779B97F4A7C15, 18, (1 << 64) - 1
FLUSH = 200_000
ROUNDS = 0
SMOOTH = 0.1
MARK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes split at the six ASCII white-space characters only."""
    return (text or "").encode().lower().split()


def piece_ids(path: str, words: list[str]) -> list[list[int]]:
    """The vocabulary's own segmentation of each word."""
    return _processor(path).encode(words, out_type=int, num_threads=1)


class Lattice:
    """Piece scores (natural logs) and the forward recursion over a word's segmentations."""

    def __init__(self, path: str, counts: dict[int, float], ends: int):
        sp = _processor(path)
        size = sp.get_piece_size()
        usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i))]
        total = sum(counts.get(i, 0) for i in usable) + ends + SMOOTH * (len(usable) + 1)
        log = lambda n: math.log((n + SMOOTH) / total)
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): log(counts.get(i, 0)) for i in usable if sp.is_byte(i)}
        self.pieces = {sp.id_to_piece(i): log(counts.get(i, 0)) for i in usable if not sp.is_byte(i)}
        self.longest = max(map(len, self.pieces))
        self.end = log(ends)
        self._index()

    def _index(self) -> None:
        """Open-addressed table from the hashes of pieces to their scores, for lookups of whole arrays."""
        self.power = np.array([pow(BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.keys, self.numbers, self.probes = np.zeros(1 << BITS, np.uint64), np.full(1 << BITS, len(self.pieces), np.int32), 1
        self.values = np.array([*self.pieces.values(), -np.inf])  # the last stands for no piece
        self.number = {piece: number for number, piece in enumerate(self.pieces)}
        for piece, number in self.number.items():
            key = 0
            for c in piece:
                key = (key * BASE + ord(c) + 1) & MASK
            slot, tries = ((key * SPREAD) & MASK) >> (64 - BITS), 1
            while self.keys[slot]:
                slot, tries = (slot + 1) & ((1 << BITS) - 1), tries + 1
            self.keys[slot], self.numbers[slot] = key, number
            self.probes = max(self.probes, tries)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of hashed substrings, len(pieces) where there is no such piece."""
        slot = ((keys * np.uint64(SPREAD)) >> np.uint64(64 - BITS)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == keys, self.numbers[slot], len(self.pieces))
        rest = np.flatnonzero((found != keys) & (found != 0))
        for _ in range(self.probes - 1):
            if not rest.size:
                break
            slot[rest] = (slot[rest] + 1) & ((1 << BITS) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.numbers[slot[rest[hit]]]
            rest = rest[~hit & (found != 0)]
        return out

    def _scores(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self._numbers(keys)]

    def expected(self, words: list[str], weights: np.ndarray, longest: int = 48, batch: int = 2048) -> tuple[np.ndarray, dict[int, float]]:
        """How often each piece (by its number) and each byte is expected in the words, times their weights, over all segmentations by their probability: forward
        and backward recursions, words of equal length together, those longer than `longest` one by one."""
        size = np.array([len(w) for w in words], np.int64)
        total, of_bytes = np.zeros(len(self.pieces) + 1), dict.fromkeys(self.bytes, 0.0)
        for n in np.unique(size[(size > 0) & (size <= longest)]).tolist():
            at = np.flatnonzero(size == n)
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                self._expect([words[i] for i in part], n, weights[part], total, of_bytes)
        for i in np.flatnonzero(size > longest).tolist():
            self._expect_one(words[i], float(weights[i]), total, of_bytes)
        return total[:-1], of_bytes

    def _expect_one(self, word: str, weight: float, total: np.ndarray, of_bytes: dict[int, float]) -> None:
        w = MARK + word
        n, get, longest = len(w), self.pieces.get, self.longest
        bare = [sum(self.bytes[b] for b in c.encode()) if get(c) is None else None for c in w]

        def joined(terms: list[float]) -> float:
            top = max(terms)
            return top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms]))

        forward, backward = [0.0], [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = [forward[i] + s for i in range(max(0, j - longest), j) if (s := get(w[i:j])) is not None]
            forward.append(joined(terms + [forward[j - 1] + bare[j - 1]] if bare[j - 1] is not None else terms))
        for i in range(n - 1, -1, -1):
            arcs = [(w[i:j], s + backward[j]) for j in range(i + 1, min(n, i + longest) + 1) if (s := get(w[i:j])) is not None]
            lone = bare[i] + backward[i + 1] if bare[i] is not None else None
            backward[i] = joined([s for _, s in arcs] + ([lone] if lone is not None else []))
            for piece, s in arcs:
                total[self.number[piece]] += weight * math.exp(forward[i] + s - forward[n])
            if lone is not None:
                for b in w[i].encode():
                    of_bytes[b] += weight * math.exp(forward[i] + lone - forward[n])

    def _expect(self, words: list[str], n: int, weights: np.ndarray, total: np.ndarray, of_bytes: dict[int, float]) -> None:
        points, prefix = self._prefixes(words, n)
        numbers: dict[tuple[int, int], np.ndarray] = {}
        scores: dict[tuple[int, int], np.ndarray] = {}
        bare: dict[int, np.ndarray] = {}
        forward = [np.zeros(len(words))]
        for j in range(1, n + 2):
            for i in range(max(0, j - self.longest), j):
                numbers[i, j] = self._numbers(prefix[j] - prefix[i] * self.power[j - i])
                scores[i, j] = self.values[numbers[i, j]]
            if (lone := np.isneginf(self._scores(points[j - 1].astype(np.uint64) + np.uint64(1)))).any():
                bare[j] = lone
                for c in np.unique(points[j - 1][lone]).tolist():
                    scores[j - 1, j][points[j - 1] == c] = sum(self.bytes[b] for b in chr(c).encode())
            forward.append(_log_sum([forward[i] + scores[i, j] for i in range(max(0, j - self.longest), j)]))
        backward = {n + 1: np.zeros(len(words))}
        for i in range(n, -1, -1):
            backward[i] = _log_sum([scores[i, j] + backward[j] for j in range(i + 1, min(n + 1, i + self.longest) + 1)])
        ids, shares = [], []
        for (i, j), s in scores.items():
            p = np.exp(forward[i] + s + backward[j] - forward[-1]) * weights
            if i == j - 1 and j in bare:
                for c in np.unique(points[i][bare[j]]).tolist():
                    share = float(p[points[i] == c].sum())
                    for b in chr(c).encode():
                        of_bytes[b] += share
                p = np.where(bare[j], 0.0, p)
            ids.append(numbers[i, j])
            shares.append(p)
        total += np.bincount(np.concatenate(ids), np.concatenate(shares), len(total))

    def _prefixes(self, words: list[str], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Code points of the marked words by place, and hashes of their beginnings."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).T
        points = np.vstack([np.full((1, len(words)), ord(MARK), np.uint32), points])
        prefix = [np.zeros(len(words), np.uint64)]
        for row in points:
            prefix.append(prefix[-1] * np.uint64(BASE) + row.astype(np.uint64) + np.uint64(1))
        return points, prefix

    def _of_length(self, words: list[str], n: int) -> np.ndarray:
        points, prefix = self._prefixes(words, n)
        forward = [np.zeros(len(words))]
        for j in range(1, n + 2):
            first = max(0, j - self.longest)
            terms = np.stack([forward[i] + self._scores(prefix[j] - prefix[i] * self.power[j - i]) for i in range(first, j)])
            if (bare := np.isneginf(self._scores(points[j - 1].astype(np.uint64) + np.uint64(1)))).any():
                for c in np.unique(points[j - 1][bare]).tolist():
                    at = points[j - 1] == c
                    terms[-1, at] = forward[j - 1][at] + sum(self.bytes[b] for b in chr(c).encode())
            top = terms.max(axis=0)
            forward.append(top + np.log(np.exp(terms - top).sum(axis=0)))
        return forward[-1] / math.log(10)

    def log10_all(self, words: list[str], longest: int = 48, batch: int = 4096) -> np.ndarray:
        """log10() of each word; words of equal length go through the recursion together."""
        size = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words))
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                out[part] = self._of_length([words[i] for i in part], n) if 0 < n <= longest else [self.log10(words[i]) for i in part]
        return out

    def log10(self, word: str) -> float:
        """log10 of the sum over all segmentations of the marked word."""
        w = MARK + word
        get, longest, exp, log = self.pieces.get, self.longest, math.exp, math.log
        forward = [0.0]
        for j in range(1, len(w) + 1):
            c = w[j - 1]
            terms = []
            for i in range(max(0, j - longest), j):
                if (s := get(w[i:j])) is not None:
                    terms.append(forward[i] + s)
            if len(terms) == 0 or get(c) is None:
                terms.append(forward[j - 1] + sum(self.bytes[b] for b in c.encode()))
            top = max(terms)
            forward.append(top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms])))
        return forward[-1] / math.log(10)


def word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """(word, n, c): occurrences in all rows and in training rows. Counted in each task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, train = Counter(), Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode() for w in every], "n": list(every.values()), "c": [train[w] for w in every]})
            every.clear()
            train.clear()
            return out

        for pdf in batches:
            for text, learn in zip(pdf["text"], pdf["learn"]):
                words = words_of(text)
                every.update(words)
                if learn:
                    train.update(words)
                if len(every) >= FLUSH:
                    yield flush()
        if every:
            yield flush()

    seen = docs.select("text", training.alias("learn")).mapInPandas(count, "word string, n long, c long")
    return seen.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(terms)
    top = stacked.max(axis=0)
    return top + np.log(np.exp(stacked - top).sum(axis=0))


def learnt_lattice(counts: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> Lattice:
    """Piece scores from the training words: first by the vocabulary's own segmentation, then in each round by the expected counts over all segmentations. What
    comes to the driver is a row for each piece of the vocabulary."""
    train = counts.where("c > 0").select("word", "c")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[int] = Counter()
        for pdf in batches:
            for ids, c in zip(piece_ids(path, pdf["word"].tolist()), pdf["c"].tolist()):
                for i in ids:
                    total[i] += c
        yield pd.DataFrame({"i": list(total), "n": [float(n) for n in total.values()]}).astype({"i": "int64", "n": float})

    def summed(found: DataFrame) -> dict[int, float]:
        return {r["i"]: r["n"] for r in found.groupBy("i").agg(F.round(F.sum("n"), 3).alias("n")).collect()}

    lattice = Lattice(path, summed(train.mapInPandas(best, "i long, n double")), ends)
    for _ in range(rounds):
        held = counts.sparkSession.sparkContext.broadcast(lattice)  # the vocabulary's pieces

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sp, model = _processor(path), held.value
            ids = [sp.piece_to_id(p) for p in model.pieces]
            byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
            total, of_bytes = np.zeros(len(ids)), Counter()
            for pdf in batches:
                n, b = model.expected(pdf["word"].tolist(), pdf["c"].to_numpy(float))
                total += n
                of_bytes.update(b)
            rows = {i: n for i, n in zip(ids, total.tolist()) if n > 0} | {byte_ids[b]: n for b, n in of_bytes.items() if n > 0}
            yield pd.DataFrame({"i": list(rows), "n": list(rows.values())}).astype({"i": "int64", "n": float})

        lattice = Lattice(path, summed(train.mapInPandas(expect, "i long, n double")), ends)
    return lattice


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 10 == 0


def score(docs: DataFrame, vocabulary: str | None = None, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    path = vocabulary or default_vocabulary()
    sc = docs.sparkSession.sparkContext
    out = held_out(F.col("doc_id"))
    rows = docs.select("doc_id", "text")
    with small_batches(docs):
        counts = stored(word_counts(rows, ~out))
    ends = rows.where(~out).count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    train_tokens, distinct = sums["c"] + ends, sums["v"] + (ends > 0)
    whole = train_tokens + SMOOTH * (distinct + 1)
    lattice = sc.broadcast(learnt_lattice(counts, ends, path, rounds))  # the vocabulary's pieces
    base_of = lambda c: math.log10((c + SMOOTH) / whole) if whole else 0.0

    @F.pandas_udf("double")
    def marginal(words: pd.Series) -> pd.Series:
        return pd.Series(lattice.value.log10_all(words.tolist()))

    scored = stored(counts.select("word", "n", "c", marginal("word").alias("lm")))
    frequent = scored.where((F.col("n") >= F.lit(max(1, -(-sums["n"] // hot)))) & (F.octet_length("word") <= HOT_BYTES)).select("word", "c", "lm")
    table = sc.broadcast({r["word"].encode(): (base_of(r["c"]), r["lm"], int(r["c"] > 0)) for r in frequent.toLocalIterator()})
    end = (base_of(ends), lattice.value.end / math.log(10), int(ends > 0))

    def sums_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each row one sum over its end and frequent words, and a row for each of its other words."""
        known = table.value
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                out = {k: [] for k in ("row", "id", "word", "tf", "tokens", "known", "base", "lm")}
                for row, doc_id, text in zip(*[pdf[c].iloc[at : at + 256] for c in ("row", "id", "text")]):
                    words = words_of(text)
                    base, lm, seen = end
                    rest = []
                    for w, tf in Counter(words).items():
                        if (got := known.get(w)) is not None:
                            base += tf * got[0]
                            lm += tf * got[1]
                            seen += tf * got[2]
                        else:
                            rest.append((w.decode(), tf))
                    for k, v in (("row", [row] * (len(rest) + 1)), ("id", [doc_id, *[None] * len(rest)]), ("word", [None, *[w for w, _ in rest]]), ("tf", [0, *[tf for _, tf in rest]]), ("tokens", [len(words) + 1, *[0] * len(rest)]), ("known", [seen, *[0] * len(rest)]), ("base", [base, *[0.0] * len(rest)]), ("lm", [lm, *[0.0] * len(rest)])):
                        out[k] += v
                yield pd.DataFrame(out)

    # The row's number and id are made in the one pass that is stored, so that no later job numbers the rows anew.
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("id"), "text")
    with small_batches(docs):
        parts = stored(numbered.mapInPandas(sums_of, "row long, id string, word string, tf long, tokens long, known long, base double, lm double"))
    rare = parts.where("word is not null").select("row", "word", "tf").join(scored.select("word", "c", "lm"), "word")
    rare = rare.select("row", F.lit(None).cast("string").alias("id"), F.lit(0).cast("long").alias("tokens"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("known"), (F.col("tf") * F.log10((F.col("c") + SMOOTH) / F.lit(float(whole)))).alias("base"), (F.col("tf") * F.col("lm")).alias("lm"))
    both = parts.where("word is null").select("row", "id", "tokens", "known", "base", "lm").union(rare)
    by_row = both.groupBy("row").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("tokens", "known", "base", "lm")])
    doc_id = F.col("id").cast(docs.schema["doc_id"].dataType)
    return by_row.select(doc_id.alias("doc_id"), held_out(F.col("id")).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lm").alias("score"))

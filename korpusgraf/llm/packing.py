"""Best-fit packing by minimum bin slack.

A document's tokens, closed by END, are cut into pieces of at most `capacity`. The packer sees only how many pieces there are of each
length: per bin it takes the longest piece left and, by subset sums in a bitset over the lengths available, the fullest combination beside it;
the same combination is used as often as the counts allow, and removed. So its work is bounded by the number of lengths, whatever the
corpus holds. The pieces of a length are then numbered, over hash buckets, and each number finds its bin and offset in the plan.

Cases: null text is empty: one piece with END alone. Repeated rows and null doc_ids: each row is packed. Very long texts are tokenised
whole. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from struct import pack as packed

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusgraf.llm.common import buckets_for, prefix_sums, small_batches, stored

CAPACITY, END = 4096, 1
CACHE = 1 << 17
PLAIN = re.compile("[a-zß-öø-ÿ]+")
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as themselves, the others as letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


#: The parts of a tokenizer file under which runs between white space can be encoded apart (Encoder).
BY_RUNS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Encoder:
    """Ids of whole texts, little-endian. A tokenizer that drops white space, lower-cases and never joins a letter to a mark after it
    (its file has the parts in BY_RUNS) meets each distinct run of the lower-cased text once, its closing marks apart, and the ids are
    kept; any other one is given whole texts. Plain lower-case words are one pre-token and go to the merges at once. Of kept runs there are two generations of at most CACHE each: a full one becomes the old one,
    and old runs that are met again move to the new."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges = self.tokenizer.model
        spec = json.loads(Path(path).read_text())
        self.by_runs = all(spec.get(k) == v for k, v in BY_RUNS.items())
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def run(self, w: bytes) -> bytes:
        """The ids of a lower-cased run, kept."""
        if (ids := self.known.get(w) or self.old.get(w)) is None:
            core = w.rstrip(MARKS)
            if core and core != w and 97 <= core[-1] <= 122:
                ids = self.run(core) + self.run(w[len(core) :])
            elif PLAIN.fullmatch(text := w.decode()):
                found = [t.id for t in self.merges.tokenize(w.decode("latin-1").translate(self.letters))]
                ids = packed(f"<{len(found)}I", *found)
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
                ids = packed(f"<{len(found)}I", *found)
        self.known[w] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not self.by_runs:
            return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        words = (text or "").encode().lower().split()
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        known = self.known
        for w in set(words).difference(known):
            self.run(w)
        return b"".join([known[w] for w in words])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row."""
    path = tokenizer or default_tokenizer()
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
        held = encoder(path)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = held.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, PIECES)  # as text: a null makes a batch's ids doubles
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def fullest(left: np.ndarray, room: int, first: int) -> list[tuple[int, int]]:
    """(length, number) of the fullest combination within room, `first` having been taken once already; longest lengths first."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for n in np.flatnonzero(left[: room + 1])[::-1].tolist():
        have, at = min(int(left[n]) - (n == first), room // n), 1
        while have > 0:
            k = min(at, have)
            new = reach | (reach << (n * k)) & mask
            if new != reach:
                steps.append((n, k, reach))
                reach = new
            have -= k
            at *= 2
        if reach >> room & 1:
            break
    s, taken = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> s & 1:
            taken[n] = taken.get(n, 0) + k
            s -= n * k
    return sorted(taken.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first number, numbers a bin, first bin, offset) by length and number, and how many bins there are."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    used, bins, rows = np.zeros(capacity + 1, np.int64), 0, []
    top = capacity
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if not top:
            break
        combination = {n: k for n, k in fullest(left, capacity - top, top)} if top < capacity else {}
        combination[top] = combination.get(top, 0) + 1
        times = min(int(left[n]) // k for n, k in combination.items())
        offset = 0
        for n, k in sorted(combination.items(), reverse=True):
            rows.append((n, int(used[n]), k, bins, offset))
            used[n] += k * times
            left[n] -= k * times
            offset += n * k
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    with small_batches(docs):
        cut = stored(pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()))
    counted = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length, at most `capacity`
    counts = {int(r["length"]): int(r["n"]) for r in counted}
    rows, _ = plan(counts, capacity)
    held = docs.sparkSession.sparkContext.broadcast((rows, (rows[:, 0] << 44) | rows[:, 1]))  # bounded by the lengths
    bucket = F.pmod(F.xxhash64("row"), F.lit(buckets_for(sum(counts.values()))))  # not by doc_id, which may repeat or be null
    order = [F.col("doc_id"), F.col("piece"), F.col("row")]
    numbered = prefix_sums(cut.withColumn("bucket", bucket).withColumn("one", F.lit(1).cast("long")), ["length"], "bucket", order, ["one"])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        table, keys = held.value
        n, r = length.to_numpy(np.int64), number.to_numpy(np.int64)
        _, first, each, bin_, offset = table[np.searchsorted(keys, (n << 44) | r, side="right") - 1].T
        return pd.DataFrame({"sequence_id": bin_ + (r - first) // each, "offset": offset + (r - first) % each * n})

    return numbered.withColumn("at", placed("length", "before_one")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")

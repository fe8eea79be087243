"""Spelling variants: words one edit apart, by two-dimensional range reporting over a wavelet tree.

A word x is near a word y of length m (x as long, or one shorter) if for some i they share the first i and the last m - 1 - i code points. In a
block of words of length m, each point is a word: its place in the forward order and its place in the order of reversed words. The prefix is an
interval of the one, the suffix an interval of the other, and the points in both are the words that x can become by replacing or inserting at i;
a wavelet tree reports them. A pair that several i would find is taken at the last one. Deletions are insertions seen from the other word.

Words meet in blocks: i in the second half of m needs the same first half, i in the first half the same second half, so words are dealt by
(side, m, half), with many halves in a block of bounded bytes. A half that outweighs a block is split into parts, and each part of its
words meets each part of the asking words in a block of its own. A block gives one row a word: how many are near, and the one of largest n.

Forms are followed to their roots by self-joins that double the steps; n at least doubles with each step, so there are no cycles.

Cases: null text: no words. Null doc_id: the empty text before the colon. Repeated rows are counted as often as they occur. Words of any length
take part. Empty table, or no word often enough: no rows. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusgraf.llm.common import ascii_lower, stored

RUN = r"[A-Za-zÀ-ÿ]"
DAMAGE = 97
#: Bytes of words in a block, and a block's share of all bytes at most: so no more than SHARES lengths or halves are heavier than a block.
BLOCK, SHARES = 1 << 20, 1 << 14
#: Range queries that are answered together.
ASKED = 1 << 18


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """word, n: the damaged lower-cased runs of letters of all texts, and how often they occur."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run")).withColumn("run", ascii_lower(F.col("run")))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


class WaveletTree:
    """A permutation of 0..n-1, level by level from the highest bit; reports the values of a range of places that lie in a range of values."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(max(0, int(len(values) - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries over the places lo..hi-1 and the values least..end-1: numbers of the queries, and values found, one for each."""
        q = np.flatnonzero((lo < hi) & (least < end))
        a, b, value = lo[q], hi[q], np.zeros(len(q), np.int64)
        for bit, zeros in self.levels:
            za, zb, ones = zeros[a], zeros[b], zeros[-1]
            left, right = (zb > za) & (value + (1 << bit) > least[q]), (b - a > zb - za)
            up = value + (1 << bit)
            right &= (up < end[q]) & (up + (1 << bit) > least[q])
            left &= value < end[q]
            a, b = np.concatenate([za[left], (ones + a - za)[right]]), np.concatenate([zb[left], (ones + b - zb)[right]])
            value, q = np.concatenate([value[left], up[right]]), np.concatenate([q[left], q[right]])
        return q, value


class Order:
    """The rows of a block in one order: for a number of leading code points, the interval of index words that share a row's."""

    def __init__(self, letters: np.ndarray, index: np.ndarray):
        n, width = letters.shape
        self.order = np.argsort(np.ascontiguousarray(letters).view(f"S{width}").ravel(), kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        inside = index[self.order]
        self.before = np.concatenate([[0], np.cumsum(inside)])
        self.words = self.order[inside]
        self.shared = np.zeros(n, np.int64)  # leading code points shared with the row before
        for at in range(1, n, step := max(1, (1 << 24) // width)):
            rows = letters[self.order[at - 1 : at + step]]
            differ = rows[1:] != rows[:-1]
            self.shared[at : at + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        self.most = int(self.shared.max(initial=0))

    def interval(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        first = self.shared < length
        first[:1] = True
        starts = np.flatnonzero(first)
        group = (np.cumsum(first) - 1)[self.rank]
        return self.before[starts][group], self.before[np.append(starts[1:], len(self.rank))][group]


def near_in_block(words: list[bytes], n: np.ndarray, index: np.ndarray, asks: np.ndarray, m: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of length m or m - 1, of which `index` (length m) are points and `asks` ask: for each row the number of near words, the largest n of them and
    the row of the least word with that n (-1 if none), edits at the places first..last of the longer word."""
    size = len(words)
    letters = np.array(words, f"S{m}").view(np.uint8).reshape(size, m)
    short = letters[:, m - 1] == 0
    turned = letters[:, ::-1].copy()
    turned[short] = np.roll(turned[short], -1, axis=1)
    forward, backward = Order(letters, index), Order(turned, index)
    rank = np.empty(len(forward.words), np.int64)
    place = np.full(size, -1)
    place[backward.words] = np.arange(len(backward.words))
    rank[:] = place[forward.words]
    tree = WaveletTree(rank)
    count, top, best = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1)

    def take(row: np.ndarray, near: np.ndarray) -> None:
        np.add.at(count, row, 1)
        by = np.lexsort((forward.rank[near], -n[near], row))
        lead = by[np.flatnonzero(np.diff(row[by], prepend=-1))]
        r, x = row[lead], near[lead]
        better = (n[x] > top[r]) | ((n[x] == top[r]) & ((best[r] < 0) | (forward.rank[x] < forward.rank[best[r]])))
        top[r[better]], best[r[better]] = n[x[better]], x[better]

    def answer(asked: list) -> None:
        row, at, *ranges = (np.concatenate(c) for c in zip(*asked))
        q, value = tree.report(*ranges)
        row, at, near = row[q], at[q], backward.words[value]
        kept = letters[row, at] != letters[near, at]  # neither the word itself nor a pair that a later place finds
        row, near = row[kept], near[kept]
        take(row, near)
        longer = short[row]
        take(near[longer], row[longer])

    asked, waiting = [], 0
    own = index.astype(np.int64)
    for i in range(max(first, m - 1 - backward.most), min(last, forward.most) + 1):
        lo, hi = forward.interval(i)
        least, end = backward.interval(m - 1 - i)
        rows = np.flatnonzero(asks & (hi - lo > own) & (end - least > own))
        if len(rows):
            asked.append((rows, np.full(len(rows), i), lo[rows], hi[rows], least[rows], end[rows]))
            waiting += len(rows)
        if waiting > ASKED:
            answer(asked)
            asked, waiting = [], 0
    if asked:
        answer(asked)
    return count, top, best


def dealt(vocab: DataFrame) -> DataFrame:
    """word (in one byte a code point), n, side, m, index, asks and block of each meeting of a word; vocab is a stored table."""
    size = F.char_length("word")
    one = vocab.select(F.encode("word", "ISO-8859-1").alias("word"), "n", size.alias("size"))
    role = lambda m, index: F.struct(m.cast("int").alias("m"), F.lit(index).alias("index"))
    roles = one.select("word", "n", "size", F.explode(F.array(role(F.col("size"), True), role(F.col("size") + 1, False))).alias("r")).select("word", "n", "size", "r.*")
    h = F.floor(F.col("m") / 2).cast("int")
    first = F.struct(F.lit("p").alias("side"), F.substring("word", F.lit(1), h).alias("half"))
    second = F.struct(F.lit("s").alias("side"), F.substring("word", F.col("size") - F.col("m") + h + 1, F.col("m") - h).alias("half"))
    rows = roles.select("word", "n", "m", "index", F.explode(F.array(first, second)).alias("k")).select("word", "n", "m", "index", "k.*")
    total = rows.agg(F.sum("m").alias("b")).first()["b"] or 0
    room = max(BLOCK, -(-total // SHARES))
    weight = lambda *by: rows.groupBy(*by).agg(F.sum("m").alias("b")).where(F.col("b") > room)
    # at most SHARES rows of a side each, by the choice of room
    lengths = weight("side", "m").select("side", "m", F.ceil(F.col("b") / room).cast("int").alias("blocks"))
    heavy = weight("side", "m", "half").select("side", "m", "half", F.ceil(2 * F.col("b") / room).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(lengths), ["side", "m"], "left").join(F.broadcast(heavy), ["side", "m", "half"], "left")
    light = F.pmod(F.xxhash64("half"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("string")
    mine = F.pmod(F.xxhash64("word"), F.col("parts").cast("long"))
    meeting = lambda index, asks, block: F.struct(index.alias("index"), asks.alias("asks"), block.alias("block"))
    across = F.sequence(F.lit(0), F.col("parts") - 1)
    name = lambda point, asking: F.concat_ws("-", F.hex("half"), point.cast("string"), asking.cast("string"))
    points = F.when(F.col("index"), F.transform(across, lambda b: meeting(F.lit(True), F.lit(False), name(mine, b)))).otherwise(F.array().cast("array<struct<index:boolean,asks:boolean,block:string>>"))
    asking = F.transform(across, lambda a: meeting(F.lit(False), F.lit(True), name(a, mine)))
    at = F.when(F.col("parts").isNull(), F.array(meeting(F.col("index"), F.lit(True), light))).otherwise(F.concat(points, asking))
    return rows.select("word", "n", "side", "m", F.explode(at).alias("at")).select("word", "n", "side", "m", "at.*")


def near_counts(vocab: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of each word with a near one how many are near, and the one of largest n, the least of ties."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        m, side = int(rows["m"].iloc[0]), rows["side"].iloc[0]
        words, index = [bytes(w) for w in rows["word"]], rows["index"].to_numpy(bool)
        span = (m // 2, m - 1) if side == "p" else (0, m // 2 - 1)
        if not index.any() or len(words) < 2:
            return pd.DataFrame({"word": pd.Series([], dtype=object), "n_near": np.zeros(0, np.int64), "best_n": np.zeros(0, np.int64), "best": pd.Series([], dtype=object)})
        count, top, best = near_in_block(words, rows["n"].to_numpy(np.int64), index, rows["asks"].to_numpy(bool), m, *span)
        at = np.flatnonzero(count)
        named = lambda which: pd.Series([words[i].decode("latin-1") for i in which], dtype=object)
        return pd.DataFrame({"word": named(at), "n_near": count[at], "best_n": top[at], "best": named(best[at])})

    found = dealt(vocab).groupBy("side", "m", "block").applyInPandas(block, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", (-F.col("top.n")).alias("best_n"), "top.best")


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) without cycles: word, root, the last form from it."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.where("moved").limit(1).count():
        above = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        now = stored(now.drop("moved").join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
    return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word."""
    vocab = stored(vocabulary(docs))
    near = near_counts(vocab)
    is_form = F.col("best_n") >= 2 * F.col("n")
    formed = stored(vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    return formed.join(roots(formed.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""WITH RECURSIVE crc AS (SELECT list(c ORDER BY b) AS x FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) t(b))),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 5),
g AS (SELECT run, hex(concat(doc_id, ':', run)) AS x, count(*) AS n FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(g.x), 2), lambda i: 16 * (instr('0123456789ABCDEF', g.x[i + 1]) - 1) + instr('0123456789ABCDEF', g.x[i + 2]) - 1)), lambda a, b: xor(a >> 8, crc.x[xor(a & 255, b) + 1]))) AS h FROM g, crc),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
c AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less, word[:i - 1] || '*' || word[i + 1:] AS pattern FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
d AS (SELECT DISTINCT w.word AS short, w.n AS short_n, c.word AS long, c.n AS long_n FROM c JOIN w ON w.word = c.less),
p AS (SELECT a.word, b.word AS near, b.n FROM c a JOIN c b ON a.pattern = b.pattern AND a.word <> b.word UNION ALL SELECT short, long, long_n FROM d UNION ALL SELECT long, short, short_n FROM d),
t AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word), b AS (SELECT p.word, min(near) AS best FROM p JOIN t ON t.word = p.word AND t.top = p.n GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN best END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM w LEFT JOIN t ON t.word = w.word LEFT JOIN b ON b.word = w.word),
s AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.at AND f.form IS NOT NULL),
e AS (SELECT s.word, s.at AS root FROM s JOIN f ON f.word = s.at AND f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e ON e.word = f.word"""

"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Character one- to three-grams of the lower-cased whole text are hashed into FEATURES dimensions. Document frequencies are
counted over all training rows. The weights are fitted by follow-the-regularised-leader (proximal, per coordinate, with L1
and L2 penalties) on a sample of at most `sample_rows` labelled rows with at most `entries` distinct n-grams together, taken by a hash
of the row; rows are taken from the languages in turn, so a bound cuts them evenly. Every fifth sampled row is kept back to fit the temperature that calibrates the
probabilities.

Cases: null text or text without a letter: `und` with score 0. No labelled training rows: every row is `und` with score 0. Repeated
rows and null doc_ids: predicted like any other. Very long texts are read whole, in chunks. Further columns of docs are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.llm.common import crc_of_id, sealed, small_batches, stored, unsealed

FEATURES = 1 << 14
SAMPLE_ROWS, SAMPLE_ENTRIES = 3_000, 1 << 23
STEP = 1 << 18
#: Letters and some numerals; `has_letter` tells them apart.
ALNUM = re.compile(r"[^\W\d_]")
NONE = "und"


def counts(text: str) -> np.ndarray:
    """Counts of the hashed character n-grams of a text."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    total = np.zeros(FEATURES, np.int64)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    for at in range(0, len(points), STEP):
        x = points[at : at + STEP + 2]
        one, two, three = x * np.uint32(2654435761), x * np.uint32(2246822519), x * np.uint32(3266489917)
        pair = (one[:-1] ^ (two[1:] >> np.uint32(3))) * np.uint32(668265263)
        triple = (one[:-2] ^ (two[1:-1] >> np.uint32(5)) ^ (three[2:] >> np.uint32(7))) * np.uint32(374761393)
        for h, n in ((one, 0), (pair, 1), (triple, 2)):
            total += np.bincount(h[: min(STEP, len(h))] >> shift, minlength=FEATURES) if len(h) else 0
    return total


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in ALNUM.finditer(text or ""))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # FEATURES
    weights: np.ndarray  # FEATURES + 1, languages
    temperature: float

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = (weighed(rows, self.idf) @ self.weights[:-1] + self.weights[-1]) / self.temperature
        return softmax(z)


def weighed(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(rows).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_langs: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4) -> np.ndarray:
    """Sparse weights by the per-coordinate proximal update; the last row is the bias, which isn't penalised."""
    z, n = np.zeros((FEATURES + 1, n_langs)), np.zeros((FEATURES + 1, n_langs))

    def solved(i: np.ndarray) -> np.ndarray:
        free = (i < FEATURES)[:, None]
        zi = z[i]
        w = -(zi - np.sign(zi) * l1 * free) / ((beta + np.sqrt(n[i])) / alpha + l2 * free)
        return np.where(np.abs(zi) <= l1 * free, 0.0, w)

    for _ in range(epochs):
        for (i, v), label in zip(x, y):
            i, v = np.append(i, FEATURES), np.append(v, 1.0)
            w = solved(i)
            p = softmax(v @ w)
            p[label] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return solved(np.arange(FEATURES + 1))


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on the rows kept back, on a fixed grid."""
    grid = np.geomspace(0.05, 20, 241)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS, entries: int = SAMPLE_ENTRIES) -> Model | None:
    """train: text and lang of the rows to learn from (doc_id only spreads the sample)."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not rows:
        return None
    langs = sorted(rows)
    each = sample_rows / len(langs)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(FEATURES, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                df += counts(t) > 0
        yield pd.DataFrame({"i": np.arange(FEATURES), "n": df})

    with small_batches(train):
        found = train.select("text").mapInPandas(frequencies, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # FEATURES rows
    df = np.zeros(FEATURES)
    df[found["i"]] = found["n"]
    idf = (np.log((1 + sum(rows.values())) / (1 + df)) + 1).astype(np.float32)

    share = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, each / rows[lang]))])
    key = F.xxhash64("doc_id", "text", F.lit("langid"))
    chosen = train.where(F.pmod(key, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text", key.alias("key"))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = [(i, x[i]) for x in map(counts, pdf["text"]) for i in [np.flatnonzero(x)]]  # one text's full counts at a time
            yield pd.DataFrame({"lang": pdf["lang"], "key": pdf["key"], "size": [len(i) for i, _ in c], "i": [i.astype(np.int32) for i, _ in c], "n": [n.astype(np.int32) for _, n in c]})

    with small_batches(train):
        held = stored(chosen.mapInPandas(sparse, "lang string, key long, size long, i array<int>, n array<int>"))
    # the first row of each language, then the second of each, and so on, until a bound is met
    order = ["turn", "key", "lang", "size"]
    dealt = held.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("key", "size")))
    sizes = [r["size"] for r in dealt.select(*order).orderBy(*order).limit(sample_rows).collect()]
    take = int((np.cumsum(sizes) <= entries).sum()) if sizes else 0
    got = dealt.orderBy(*order).limit(max(1, take)).toPandas().sort_values(order[1:])  # at most sample_rows rows and, but for a single one, `entries` n-grams
    if got.empty:
        return None
    x = []
    for i, n in zip(got["i"], got["n"]):
        i = np.asarray(i, np.int64)
        v = np.log1p(np.asarray(n, float)) * idf[i]
        x.append((i, v / max(np.linalg.norm(v), 1e-9)))
    y = got["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy()
    back = np.arange(len(y)) % 5 == 4
    w = ftrl([x[k] for k in np.flatnonzero(~back)], y[~back], len(langs))
    z = np.array([v @ w[i] + w[-1] for k, (i, v) in enumerate(x) if back[k]])
    return Model(langs, idf, w.astype(np.float32), calibrated(z, y[back]) if back.any() else 1.0)


def predict(texts: pd.Series, model: Model | None) -> tuple[list[str], np.ndarray]:
    langs, scores = [NONE] * len(texts), np.zeros(len(texts))
    good = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
    for at in range(0, len(good), 64):
        part = good[at : at + 64]
        p = model.probabilities(np.array([counts(texts.iloc[k]) for k in part]))
        for k, row in zip(part, p):
            langs[k], scores[k] = model.langs[int(row.argmax())], float(min(1.0, row.max()))
    return langs, scores


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score; lang, source and doc_id play no part."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        langs, scores = predict(texts, held.value)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn("_guess", guess("text"))


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 4 == 2


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learnt from the rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample_rows)
    with small_batches(docs):
        return stored(with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_guess.lang_pred", "_guess.score"))


def accepted(docs: DataFrame, least: float = 0.0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows whose language is one of those learnt, with a score of at least `least`: unless it is given, only `und` goes."""
    held = sealed(docs, "doc_id", "text", "lang")
    model = fit(held.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample_rows)
    keep = with_language(held, model).where((F.col("_guess.lang_pred") != NONE) & (F.col("_guess.score") >= least))
    return unsealed(keep, docs.columns, "doc_id", "text", "lang")

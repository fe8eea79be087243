"""Secret scans: known shapes, and a battery of randomness tests on other long tokens.

Shapes (leftmost, non-overlapping per kind): assignments to a secret's name, access keys, long runs of hex digits. Further tokens of
[A-Za-z0-9+/_-], with '=' as closing padding only, that are long enough for their inferred encoding (hex, base32, base64) and hold letters
as well as digits go through the battery: chi-squared uniformity over the encoding's alphabet, a runs test about its middle and a lag-one serial correlation, joined by
Bonferroni. Which of them are reported is decided within each stratum of encoding and length, where p-values are counted on a fixed
grid over all documents, so that the cut of a stratum needs a row for each grid cell only: Benjamini-Hochberg rejects tokens as not random, and the
share of tokens among the reported that are not random, estimated from the p-values, is held at FALSE_SHARE (cut_of). Where text tokens
reach p above 1/2 they can't be told from random ones by p-values, so short strata can hold more false spans than that. Tokens that stay
are spans of kind `random`, unless they overlap a span of a known shape. A span is the whole match in code points, end exclusive.

Cases: null text is empty: no spans, digest of the empty string. Repeated rows and null doc_ids: each row is returned. Very long
texts are read whole. Further columns of docs are kept out of scan() and untouched by redact().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusgraf.llm.common import sealed, small_batches, stored, unsealed

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: '=' only as closing padding, so that what follows NAME= is a token of its own.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
KINDS = ("assign", "access", "hex", "random")
#: Alphabets in symbol order, and the length from which the battery can tell text from random symbols.
ENCODINGS = [
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef", 24),
    ("base32", re.compile(r"[A-Z2-7]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 26),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
]
GRID = 400  # cells of -log10(p), 0.05 wide
HALF = 6  # cells before it have p above 1/2
LEVEL, FALSE_SHARE = 0.01, 0.05


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[int, float] | None:
    """(encoding, p) of a token, p small where its symbols are not random; None if no encoding fits at that length."""
    body = token.rstrip("=")
    if not (re.search("[0-9]", body) and re.search("[A-Za-z]", body)):
        return None
    for k, (_, shape, alphabet, least) in enumerate(ENCODINGS):
        if shape.fullmatch(token):
            break
    else:
        return None
    n = len(body)
    if n < least:
        return None
    body = body.replace("-", "+").replace("_", "/") if k == 2 else body.lower() if k == 0 else body
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in body], float)
    size = len(alphabet)
    if k == 2 and n < 5 * size:  # too few symbols for 64 cells: classes of letters and digits instead
        p = np.array([26, 26, 10, 2]) / 64
        seen = np.bincount(np.searchsorted([26, 52, 62], x, side="right"), minlength=4)
        uniform = _chi2_tail(float(((seen - n * p) ** 2 / (n * p)).sum()), 3)
        # and of the digits and letters themselves: distinct symbols against those expected
        mean = size * (1 - (1 - 1 / size) ** n)
        var = size * ((1 - 1 / size) ** n - (1 - 1 / size) ** (2 * n)) + size * (size - 1) * ((1 - 2 / size) ** n - (1 - 1 / size) ** (2 * n))
        uniform = min(1.0, 2 * min(uniform, _normal_tail(min(0.0, (len(set(body)) - mean) / math.sqrt(max(var, 0.25))))))
    else:
        seen = np.bincount(x.astype(int), minlength=size)
        uniform = _chi2_tail(float(((seen - n / size) ** 2 / (n / size)).sum()), size - 1)
    high = x >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        runs = _normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(max(var, 1e-9)))
    else:
        runs = 2.0 ** (1 - n)
    d = x - x.mean()
    r = float((d[1:] * d[:-1]).sum() / max(float((d * d).sum()), 1e-9))
    serial = _normal_tail((r + 1 / n) * math.sqrt(n))
    return k, min(1.0, 3 * min(uniform, runs, serial))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, grid cell) of the tokens that go through the battery: those that no span of `taken`, which comes by start,
    overlaps. Both lists are read once, side by side."""
    out, at, until = [], 0, 0
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            until = max(until, taken[at][2])
            at += 1
        if until <= m.start() and (got := battery(m.group())):
            stratum = got[0] * 16 + min(15, (m.end() - m.start()).bit_length())
            out.append((m.start(), m.end(), stratum, min(GRID - 1, int(-math.log10(max(got[1], 1e-300)) / 0.05))))
    return out


FOUND = "base array<struct<start:int,kind:int,end:int>>, more array<struct<start:int,end:int,stratum:int,cell:int>>"


def _found(texts: pd.Series) -> pd.DataFrame:
    base, more = [], []
    for t in texts:
        spans = base_spans(t or "")
        base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
        more.append([{"start": a, "end": b, "stratum": s, "cell": c} for a, b, s, c in candidates(t or "", spans)])
    return pd.DataFrame({"base": base, "more": more})


def cut_of(n: np.ndarray, level: float = LEVEL, false_share: float = FALSE_SHARE) -> int:
    """The grid cell from which on a stratum's tokens are not reported; n: its tokens by cell.

    Random tokens have uniform p-values, others small ones, so the tokens with p above 1/2 give the number of random ones
    (one added, doubled, all at most). A cut is allowed while the tokens reported beyond those expected of that number are at most
    `false_share` of the reported, or within one standard error of it. Within that, Benjamini-Hochberg at `level` rejects tokens as not random."""
    p = 10.0 ** (-0.05 * np.arange(GRID + 1))
    m, kept = n.sum(), np.append(0, n.cumsum())  # kept[c]: tokens in the cells before c
    at_least = m - kept[:-1]
    rejected = np.flatnonzero((p[:-1] * m <= level * np.maximum(at_least, 1)) & (at_least > 0))
    random = min(float(m), (kept[HALF] + 1) / (1 - p[HALF]))
    false = np.maximum(0.0, kept - random * (1 - p))
    allowed = np.flatnonzero(false <= false_share * kept + np.sqrt(kept))
    return min(int(rejected[0]) if len(rejected) else GRID, int(allowed[-1]))


def cuts(cells: DataFrame, level: float = LEVEL, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """cut_of() each stratum. cells: (stratum, cell) of all candidates."""
    counted = cells.groupBy("stratum", "cell").count().collect()  # at most 48 strata x GRID rows
    by_stratum: dict[int, np.ndarray] = {}
    for r in counted:
        by_stratum.setdefault(r["stratum"], np.zeros(GRID, np.int64))[r["cell"]] = r["count"]
    return {s: cut_of(n, level, false_share) for s, n in by_stratum.items()}


def find(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id and spans array<struct<start, kind, end>> (kind by place in KINDS) of each row."""
    with small_batches(docs):
        seen = stored(docs.select("doc_id", F.pandas_udf(_found, FOUND)("text").alias("f")).select("doc_id", "f.base", "f.more"))
    cut = cuts(seen.select(F.explode("more").alias("m")).select("m.stratum", "m.cell"), level)
    return seen.select("doc_id", "base", _kept("base", "more", cut).alias("spans"))


def _kept(base: str, more: str, cut: dict[int, int]) -> Column:
    limit = F.create_map(*[F.lit(v) for kv in cut.items() for v in kv]) if cut else None
    kept = F.filter(more, (lambda m: m["cell"] < limit[m["stratum"]]) if cut else (lambda m: F.lit(False)))
    new = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    return F.array_sort(F.concat(F.col(base), new))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined) of each row."""
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return find(docs, level).select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """docs with every span of its texts replaced by a mark and n_chars counted anew; no row goes, texts without spans stay as they
    are. Two passes: the first counts the p-values, the second finds the spans again and applies the strata's cuts, so that
    no text is shuffled."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [c[2:] for t in pdf["text"] for c in candidates(t or "", base_spans(t or ""))]
            yield pd.DataFrame(got, columns=["stratum", "cell"], dtype="int32")

    with small_batches(docs):
        cut = cuts(docs.select("text").mapInPandas(cells, "stratum int, cell int"), level)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            base = base_spans(t or "")
            spans = [(a, b) for a, _, b in base] + [(a, b) for a, b, s, c in candidates(t or "", base) if c < cut.get(s, 0)]
            out.append(redacted(t, spans) if spans else t)
        return pd.Series(out, dtype=object)

    out = sealed(docs, "text", "n_chars").withColumn("text", cleaned("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return unsealed(out, docs.columns, "text", "n_chars")

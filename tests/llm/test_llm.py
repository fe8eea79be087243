"""The ten operators and the pipeline against brute force, on odd rows and on the smallest tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from korpusgraf.llm import components, langid, lattice, licences, mixing, packing, queries, secrets, sharding, simhash, sketches, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# 1
def brute_fingerprint(t):
    w = WORD.findall(low(t))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def brute_components(rows):
    fps = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(rows))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    least = defaultdict(list)
    for (i, _), k in zip(rows, label):
        least[k] += [] if i is None else [i]
    return sorted(((i, f"{int(f):016x}", min(least[k], default=None)) for (i, _), f, k in zip(rows, fps, label)), key=repr)


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == brute_components(rows_of(df))


def test_simhash_tiles_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    x = np.array([b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(12)], np.uint64)
    for left, right in ((x, None), (x[:100], x[100:])):
        every = left if right is None else np.concatenate([left, right])
        a, b = simhash.forest(left, right, 4)
        label = {int(v): int(v) for v in every}
        find = lambda v: v if label[v] == v else find(label[v])
        for p, q in zip(a.tolist(), b.tolist()):
            assert simhash is not None
            label[find(p)] = find(q)
        cross = [(int(p), int(q)) for p in left for q in (left if right is None else right) if (int(p) ^ int(q)).bit_count() <= 4]
        assert all(find(p) == find(q) for p, q in cross)
        assert len(a) < len(every)


def test_keep_one(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got[1] == 1 and got[2] == 0 and got[3] == 1 and got[4] == 0 and got[7] == 1 and got[None] == 1
    assert simhash.keep_one(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0


def test_keep_one_of_tied_rows(spark):
    rows = [(1, "same text here now", k, {"a": k}) for k in (5, 3, None, 4)] + [(2, "same text here now", 0, {}), (9, "first other words stand", 1, {}), (9, "second and quite unlike the other", 1, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int, m map<string,int>")
    for n in (1, 3, 7):
        got = sorted((r["doc_id"], r["extra"]) for r in simhash.keep_one(docs.repartition(n).orderBy(F.rand(n))).collect())
        assert got == [(1, None), (9, 1), (9, 1)]


def test_every_pair_of_blocks_meets(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(150)]
    x = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(4)})
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in x], "fp long")
    pairs = simhash.links(nodes, least_rows=4, most_rows=9)
    roots = {r["node"]: r["root"] for r in components.connected_components(pairs).collect()}
    near = np.array(x, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(near ^ near[i]) <= 4):
            a, b = (int(near[k].astype(np.int64)) for k in (i, j))
            assert a == b or roots[a] == roots[b]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {found[i] for i in range(51)} == {0} and {found[i] for i in range(100, 140)} == {100}


# 2
def test_language_id(docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_language_id_of_odd_rows(odd_docs, no_docs):
    got = langid.identify(odd_docs).collect()
    of = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == odd_docs.count() and of[3] == of[4] == of[8] == of[9] == "und" and of[7] in ("en", "de")
    assert langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.accepted(odd_docs)
    assert kept.columns == odd_docs.columns and not {3, 4, 8, 9} & {r["doc_id"] for r in kept.collect()}


def brute_ftrl(x, y, n_langs, alpha=1.0, beta=1.0, l1=0.02, l2=0.01, epochs=4):
    """The per-coordinate update with plain numbers; x: one dict a row, the bias under None."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        if i is not None and abs(z[i, c]) <= l1:
            return 0.0
        free = i is not None
        return -(z[i, c] - math.copysign(l1, z[i, c]) * free) / ((beta + math.sqrt(n[i, c])) / alpha + l2 * free)

    for _ in range(epochs):
        for row, label in zip(x, y):
            row = row | {None: 1.0}
            w = {(i, c): weight(i, c) for i in row for c in range(n_langs)}
            s = [sum(v * w[i, c] for i, v in row.items()) for c in range(n_langs)]
            e = [math.exp(v - max(s)) for v in s]
            for c in range(n_langs):
                for i, v in row.items():
                    g = v * (e[c] / sum(e) - (c == label))
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha * w[i, c]
                    n[i, c] += g * g
    return lambda i, c: weight(i, c)


def test_language_model_against_plain_numbers(spark, docs):
    """TF-IDF, the fitted weights, the temperature and the predictions of a small table, by dictionaries and loops."""
    few = docs.where("doc_id % 4 = 1")
    train = few.where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(train.select("doc_id", "text", "lang"), 60)
    rows = [r for r in train.select("text", "lang", F.xxhash64("doc_id", "text", F.lit("langid")).alias("key")).collect() if r["lang"] is not None and r["text"] is not None]
    langs = sorted({r["lang"] for r in rows})
    df = Counter(int(i) for r in rows for i in np.flatnonzero(langid.counts(r["text"])))
    idf = lambda i: math.log((1 + len(rows)) / (1 + df[i])) + 1
    of_lang = Counter(r["lang"] for r in rows)
    chosen = sorted((r for r in rows if r["key"] % (1 << 20) < min(1.0, 60 / len(langs) / of_lang[r["lang"]]) * (1 << 20)), key=lambda r: r["key"])[:60]

    def vector(t):
        c = langid.counts(t)
        v = {int(i): math.log1p(int(c[i])) * idf(int(i)) for i in np.flatnonzero(c)}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {i: x / size for i, x in v.items()}

    x, y = [vector(r["text"]) for r in chosen], [langs.index(r["lang"]) for r in chosen]
    w = brute_ftrl([v for k, v in enumerate(x) if k % 5 != 4], [c for k, c in enumerate(y) if k % 5 != 4], len(langs))
    logits = lambda v: np.array([sum(a * w(i, c) for i, a in v.items()) + w(None, c) for c in range(len(langs))])
    back = [(logits(x[k]), y[k]) for k in range(4, len(x), 5)]
    loss = lambda t: -sum(math.log(max(1e-12, np.exp(z / t - (z / t).max())[c] / np.exp(z / t - (z / t).max()).sum())) for z, c in back)
    assert model.langs == langs and model.temperature == pytest.approx(min(np.geomspace(0.05, 20, 241), key=loss), rel=0.08)
    for r in few.limit(40).collect():
        z = logits(vector(r["text"])) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        got, score = langid.predict(pd.Series([r["text"]]), model)
        assert not langid.has_letter(r["text"]) or (got[0] == langs[int(p.argmax())] and score[0] == pytest.approx(p.max(), abs=1e-3))


def test_numerals_are_no_letters(spark):
    texts = ["\u00bd \u00b2 \u2460 \u2167 12 _", "\u00bd a", "\u4e2d", "\u0301"]
    assert [langid.has_letter(t) for t in texts] == [False, True, True, False]


def test_each_language_keeps_rows_under_a_bound(spark):
    """Long texts of one language don't push another out of the sample."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "".join(chr(rng.randrange(97, 5000)) for _ in range(4000)), "long") for i in range(60)] + [(100 + i, f"kurz und klein {i}", "kurz") for i in range(60)], "doc_id long, text string, lang string")
    model = langid.fit(docs, 120, entries=40_000)
    assert model.langs == ["kurz", "long"] and langid.predict(pd.Series(["kurz und klein"]), model)[0] == ["kurz"]


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, f"text {i % 3 and i} of language {i % 7}", f"l{i % 200}") for i in range(1200)], "doc_id long, text string, lang string")
    seen = []
    plain = langid.ftrl
    langid.ftrl = lambda x, y, n: seen.append((len(x), sum(len(i) for i, _ in x))) or plain(x, y, n)
    try:
        langid.fit(docs, 100)
        langid.fit(docs, 100, entries=900)
    finally:
        langid.ftrl = plain
    assert seen[0][0] <= 100 and seen[1][1] <= 900


def test_session_settings_stay(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for made in (simhash.near_duplicates(docs), langid.identify(docs), secrets.scan(docs), secrets.redact(docs), packing.pack(docs)):
        made.count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_long_texts_count_like_short_ones(monkeypatch):
    t = "abc äöü xyz " * 40
    whole = langid.counts(t)
    monkeypatch.setattr(langid, "STEP", 7)
    assert (langid.counts(t) == whole).all()


# 3
def brute_top(rows, asked, k=10):
    q = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i in sorted(q):
        if asked(i):
            s = sorted(((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i and len(v) == len(q[i])))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return out


def test_top_k(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    want = brute_top([(r["vec_id"], list(r["embedding"])) for r in v.collect()], lambda i: i % 100 == 0)
    assert sorted(tuple(r) for r in topk.search_embeddings(v).collect()) == want
    small = topk.top_k(v, v.where("vec_id % 100 = 0"), block=64, query_block=2, pivots=3)
    assert sorted(tuple(r) for r in small.collect()) == want
    got = duckdb.sql(queries.SQL["op3_exact_top_k"].replace("FROM embeddings", f"FROM '{data}/embeddings.parquet'")).fetchall()
    assert sorted(got) == want


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (9, [-0.0001, 0.0]), (100, [0.1, 0.1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.search_embeddings(v).collect()) == brute_top(rows, lambda i: i % 100 == 0)
    assert topk.search_embeddings(v.limit(0)).count() == 0


def test_top_k_of_large_components_and_repeats(spark):
    big = float(np.float32(3e30))
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [-big, 0.5]), (3, [1.0, 1.0]), (4, [2e5, 3e5]), (4, [2e5, 3e5]), (100, [4e5, -1e5]), (100, [4e5, -1e5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    limit = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    whole = lambda x: [int(float(limit(math.floor(1024 * float(np.float32(c)))))) for c in x]
    want = []
    for i in (0, 100):
        s = sorted((-limit(sum(a * b for a, b in zip(whole(dict(rows)[i]), whole(x)))), j) for j, x in rows if j != i)[:10]
        want += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s)]
    assert sorted(tuple(r) for r in topk.search_embeddings(v).collect()) == want


def test_blocks_beyond_the_kth_distance_are_not_asked(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=8) * 0.02)]) for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    written, plain = [], topk.stored
    monkeypatch.setattr(topk, "stored", lambda df: written.append(plain(df)) or written[-1])
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), block=50, query_block=4).collect())
    assert got == brute_top(rows, lambda i: i % 50 == 0)
    asks = [df for df in written if "cell" in df.columns]
    assert len(asks) == 2 and sum(df.count() for df in asks) < 0.5 * 12 * 12  # of 12 queries and at least 12 blocks


def test_pivots_leave_candidates_out():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 900
    v = np.floor(np.concatenate([c + rng.normal(size=(400, 6)) * 9 for c in centres]))
    held = topk.PivotTable(np.arange(len(v)), v)
    ids, scores, seen = held.search(-1, v[5], 10)
    every = v @ v[5]
    assert scores.tolist() == sorted(every.astype(int).tolist(), reverse=True)[:10] and seen < len(v)


# 4
def test_licences(spark, docs, data, odd_docs, no_docs):
    got = licences.scan(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duckdb.sql(queries.SQL["op4_license_scan"].replace("FROM documents)", f"FROM '{data}/documents.parquet')")).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)
    assert licences.scan(odd_docs).count() == odd_docs.count() and licences.scan(no_docs).count() == 0


def test_licence_forms(spark):
    texts = [licences.MIT, "Copyright (c) 2020 A. Person\n\n" + licences.MIT.upper(), licences.MIT.replace('"', "“").replace(" ", "\n", 9), licences.MIT + " more", "x\nlicensed under the APACHE Licence version 2.0\ny", "Released under the MIT License!"]
    got = [tuple(r) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select("text_license", "line_licenses").collect()]
    assert [g[0] for g in got] == ["MIT", "MIT", "MIT", None, None, "MIT"]
    assert got[4][1] == "Apache-2.0" and got[5][1] == "MIT"


@pytest.mark.parametrize("name", ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"])
def test_entire_licences(spark, name):
    """An entire text is known as it is, with curly quotes, dashes and a byte order mark, and after its title and a notice; not with a word more."""
    text = next(t for k, t in licences.entire() if k == name)
    curly = "\ufeff" + re.sub(r'"([^"]*)"', "“\\1”", text).replace("'", "’").replace("-", "–").replace(", ", ",\u00a0")
    titled = f"{licences.TITLES.get(name, [''])[0]}\n\nCopyright (c) 2020 A. Person\n\n{text}"
    wrapped = [re.sub(r"(?<=\w) (?=copyright (?:notice|holder|license|law|interest)|COPYRIGHT HOLDER)", "\n", t) for t in (text, titled)]
    rows = list(enumerate([text, curly, titled, *wrapped, text + " more"]))
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text_license"] for r in got] == [name] * 5 + [None]


def test_licences_within_longer_texts(spark):
    gpl = next(t for k, t in licences.entire() if k == "GPL-3.0")
    header = "\n".join(f" * {line}" for line in licences.MIT.split("\n"))
    texts = ["A head.\n\n" + licences.MIT + "\n\nA tail.", f"/*\n * Copyright (c) 2020 A. Person\n *\n{header}\n */\nint main() {{}}\n", f"first\n\n{gpl}\n\n{licences.ISC}\n\nlast", licences.MIT.replace("free of charge", "not free"), "Released under the MIT License.\n\nx", licences.MIT.split("\n\n")[2]]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    got = [tuple(r) for r in licences.scan(docs).select("doc_id", "text_license", "n_license_lines", "block_licenses").orderBy("doc_id").collect()]
    assert [g[3] for g in got] == ["MIT", "MIT", "MIT", "GPL-3.0,ISC", "", "MIT", ""] and got[0] == got[1]
    assert [g[2] for g in got] == [0, 0, 0, 0, 0, 1, 0] and {g[1] for g in got} == {None}
    own = licences.scan(docs, [("own", "A head.")])
    assert {r["doc_id"] for r in own.where("line_licenses = 'own' AND block_licenses = 'own'").collect()} == {0}


# 5
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(t):
    t = t or ""
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    return sorted(s + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24])


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_secrets(request, which):
    df = request.getfixturevalue(which)
    want = Counter()
    for i, t in rows_of(df):
        s = brute_spans(t)
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s)
        want[(i, *[sum(x[1] == k for x in s) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest())] += 1
    got = secrets.scan(df).collect()
    assert Counter(tuple(r)[:5] for r in got) == want


def test_battery_tells_random_from_text():
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    p = [secrets.battery("".join(rng.choices(alphabet, k=40)) + "a1")[1] for _ in range(200)]
    assert sum(x < 0.001 for x in p) <= 6
    assert secrets.battery("a1" * 20)[1] < 1e-6 and secrets.battery("configuration2configuration2configuration2")[1] < 1e-3
    assert secrets.battery("internationalisation") is None


def brute_random_spans(rows, level=0.01, share=0.05):
    """Spans of kind random by the rule of secrets.cut_of, token by token and without its cells' sums."""
    found = defaultdict(list)
    for i, t in rows:
        base = brute_spans(t)
        for m in secrets.TOKEN.finditer(t or ""):
            if all(b <= m.start() or a >= m.end() for a, _, b in base) and (got := secrets.battery(m.group())):
                cell = min(secrets.GRID - 1, int(-math.log10(max(got[1], 1e-300)) / 0.05))
                found[got[0], min(15, len(m.group()).bit_length())].append((cell, i, m.start(), m.end()))
    out = set()
    for tokens in found.values():
        cells = [x[0] for x in tokens]
        m = len(cells)
        random_ = min(m, (sum(c < 6 for c in cells) + 1) / (1 - 10**-0.3))
        best = 0
        for c in range(secrets.GRID + 1):
            kept, p = sum(x < c for x in cells), 10 ** (-0.05 * c)
            if max(0.0, kept - random_ * (1 - p)) <= share * kept + math.sqrt(kept):
                best = c
        rejected = next((c for c in range(secrets.GRID) if 10 ** (-0.05 * c) * m <= level * max(1, m - sum(x < c for x in cells)) and m > sum(x < c for x in cells)), secrets.GRID)
        out |= {x[1:] for x in tokens if x[0] < min(best, rejected)}
    return out


def test_random_spans(spark):
    """The method's own spans against the plain rule, and recall and precision on random tokens planted among names."""
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["get", "Element", "By", "Name", "internal", "Config", "value", "handler", "Index", "request", "Buffer", "test"]
    rows, planted = [], set()
    for i in range(600):
        name = "".join(rng.choices(words, k=6)) + str(rng.randrange(100))
        key = "".join(rng.choices(alphabet, k=rng.choice([32, 40, 64])))
        head = f"see {name} and " if i % 2 else f"path {name}/{name} or key "
        rows.append((i, head + (key if i % 3 == 0 else "nothing") + " end"))
        if i % 3 == 0 and re.search("[0-9]", key):
            planted.add((i, len(head), len(head) + len(key)))
    got = set()
    for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got |= {(r["doc_id"], int(a), int(b)) for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s) if kind == "random"}
    assert got == brute_random_spans(rows)
    assert len(got & planted) >= 0.97 * len(planted) and len(got & planted) >= 0.9 * len(got)


def test_candidates_by_two_lists():
    text = " ".join(f"{'a1b2' * 8} secret=abcdef{i} Zk3v9QpX7wLr2TyB8nMd5HsGcJf4UaEo" for i in range(50))
    base = secrets.base_spans(text)
    want = [(m.start(), m.end()) for m in secrets.TOKEN.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in base) and secrets.battery(m.group())]
    assert [c[:2] for c in secrets.candidates(text, base)] == want and len(want) == 50


def test_redaction(spark, odd_docs):
    key = "Zk3v9QpX7wLr2TyB8nMd5HsGcJf4UaEo"
    rows = [(1, 'a token = "abcdef123" b', 1), (2, f"see {key} there", 2), (3, None, None), (4, "plain words stay", 3)]
    out = {r["doc_id"]: r for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert out[1]["text"] == 'a [SECRET]" b' and out[2]["text"] == "see [SECRET] there" and out[3]["text"] is None and out[4]["text"] == "plain words stay"
    assert out[1]["n_chars"] == len(out[1]["text"])
    assert secrets.redact(odd_docs).columns == odd_docs.columns


KEY = "Zk3v9QpX7wLr2TyB8nMd5HsGcJf4UaEo"


@pytest.mark.parametrize(
    "text, want",
    [
        (f"AUTH={KEY} x", "AUTH=[SECRET] x"),
        (f"http://h.example/p?sig={KEY}&n=1", "http://h.example/p?sig=[SECRET]&n=1"),
        (f"aws_secret_access_key={KEY}\n", "aws_secret_access_key=[SECRET]\n"),
        (f"AUTH=={KEY}== x", "AUTH==[SECRET] x"),
        (f"see {KEY}= x", "see [SECRET] x"),
        ("SEED=MZXW6YTBOI7Q2KDFJ5XGU4TPLR3VAH====== x", "SEED=[SECRET] x"),
    ],
)
def test_keys_after_a_name(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact(docs).first()["text"] == want
    kind, a, b = secrets.scan(docs).first()["spans"].split(":")
    assert kind == "random" and text[: int(a)] + "[SECRET]" + text[int(b) :] == want


# 6
def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_mixture(request, which):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in df.select("doc_id", "source", "text").collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    goal = brute_targets(dict(sizes))
    source = {i: s for i, s, _ in rows}
    got = mixing.mixture(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, n) for i, _, n in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert abs(r["target"] - goal[source[r["doc_id"]]]) < 1e-6
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixture(df).collect()), key=repr)


def test_shards_draw_disjoint_blocks_in_exact_quotas(docs):
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    p = mixing.drawn(mixing.mix(sized, shards=5, block_words=64)).toPandas()
    assert (p.groupby(["source", "block"])["shard"].nunique() == 1).all() and set(p["shard"]) <= set(range(5))
    words = p.groupby("shard")["length"].sum()
    assert words.max() - words.min() < 0.1 * words.mean() + 20 * 64
    held = mixing.split_blocks(np.array([100, 0, 37]), 6)
    assert held.sum(axis=0).tolist() == [100, 0, 37] and held.sum(axis=1).max() - held.sum(axis=1).min() <= 1


def test_the_tree_decides_what_is_taken(spark, docs, monkeypatch):
    """taken is what the shards draw: the draws' lengths, in blocks of the tree's quotas, by a permutation that depends on the seed."""
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(sized, shards=5, block_words=64)
    p = mixing.drawn(mixed).toPandas()
    sizes, goal = {}, {}
    for r in mixed.collect():
        sizes[r["source"]], goal[r["source"]] = r["source_size"], round(r["target"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    quota = {s: p[p["source"] == s]["block"].nunique() for s in names}
    assert p.groupby("source")["length"].sum().to_dict() == goal
    for s in names:  # whole epochs give every block, the last one as few blocks as hold the rest
        n, full = -(-sizes[s] // 64), goal[s] // sizes[s]
        last = p[(p["source"] == s) & (p["epoch"] == full)].groupby("block")["length"].sum()
        assert quota[s] == full * n + len(last) and last.sum() == goal[s] - full * sizes[s] and (last < 64).sum() <= 2
    seen = {s: p[p["source"] == s].groupby("shard")["block"].nunique().to_dict() for s in names}
    held = mixing.split_blocks(np.array([quota[s] for s in names]), 5)
    assert {s: {k: int(v) for k, v in enumerate(held[:, i]) if v} for i, s in enumerate(names)} == seen
    other = mixing.drawn(mixing.mix(sized, shards=5, block_words=64, seed=7)).toPandas()
    assert set(zip(p["source"], p["block"])) != set(zip(other["source"], other["block"]))
    row = mixing.mixture(docs).where("taken > 0").first()
    assert row["taken"] == sum(int(d.split(":")[5]) for d in row["draws"].split(","))
    monkeypatch.setattr(mixing, "split_blocks", lambda blocks, shards, seed=0: np.zeros((shards, len(blocks)), np.int64))
    assert {r["taken"] for r in mixing.mixture(docs).collect()} == {0} and mixing.resample(docs).count() == 0


def test_mixing_agrees_however_rows_are_dealt(odd_docs):
    rows = odd_docs.union(odd_docs.where("doc_id is null").withColumn("text", F.lit("four other words here")))
    want = Counter(map(tuple, mixing.mixture(rows).collect()))
    assert all(Counter(map(tuple, mixing.mixture(rows.repartition(n).orderBy(F.rand(n))).collect())) == want for n in (2, 5))
    words = Counter()
    for r in mixing.resample(rows).collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    taken = Counter()
    for r in mixing.mixture(rows).collect():
        taken[r["doc_id"]] += r["taken"]
    assert words == +taken


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("a"), mixing.permuted(F.col("id"), F.lit(n), F.lit(6)).alias("b")).collect()
        assert sorted(r["a"] for r in rows) == list(range(n)) == sorted(r["b"] for r in rows)
        assert n < 50 or [r["a"] for r in rows] != [r["b"] for r in rows]


def test_resample_writes_shards_in_order(docs):
    """Each partition holds rows of one shard, by place; pieces of a document are its words."""
    sized = docs.withColumn("size", mixing.n_words(F.col("text"))).withColumn("tie", F.xxhash64("text"))
    want = defaultdict(list)
    for r in mixing.drawn(mixing.mix(sized, 3, ties=("tie",))).collect():
        want[r["shard"]].append((r["place"], " ".join(WORD.findall(r["text"])[r["start"] : r["start"] + r["length"]])))
    parts = mixing.resample(docs, 3).rdd.glom().collect()
    got = [[" ".join(WORD.findall(r["text"])) for r in part] for part in parts]
    assert [t for part in got for t in part] == [t for s in sorted(want) for _, t in sorted(want[s])]


def test_mix_with_clashing_names(odd_docs, no_docs):
    clash = odd_docs.drop("size").withColumn("size", mixing.n_words(F.col("text")))
    for name in ("target", "source_size", "pieces", "shard", "place", "block", "_key", "_n"):
        clash = clash.withColumn(name, F.lit("mine"))
    got = mixing.drawn(mixing.mix(clash, 4))
    assert {r["_key"] for r in got.collect()} == {"mine"} and got.count() > 0
    assert {r["target"] for r in mixing.resample(clash, 4).collect()} == {"mine"} and mixing.resample(clash, 4).columns == clash.columns


def test_pieces_give_back_their_text(spark):
    """Line breaks, tabs and indentation survive where a document is cut."""
    code = "\n".join(f"{' ' * (4 * (i % 3))}line{i}\t=  {i}\x0b" for i in range(900)) + "\n\n"
    rows = spark.createDataFrame([(i, f"  {i}\n{code}", "s", i) for i in range(30)], "doc_id long, text string, source string, extra int")
    sized = rows.withColumn("size", mixing.n_words(F.col("text"))).withColumn("tie", F.xxhash64("text"))
    order = {(r["doc_id"], r["epoch"], r["start"]): r["place"] for r in mixing.drawn(mixing.mix(sized, 3, ties=("tie",))).collect()}
    texts = defaultdict(list)
    for r in mixing.resample(rows, 3).collect():
        texts[r["doc_id"]].append(r["text"])
    whole = Counter()
    for i, parts in texts.items():
        starts = sorted(s for d, _, s in order if d == i)
        assert len(parts) == len(starts) and set(r for r in parts) <= {p for p in parts if p in f"  {i}\n{code}"}
        words = [len(WORD.findall(p)) for p in parts]
        by_start = sorted(parts, key=lambda p: f"  {i}\n{code}".index(p))
        if sum(words) == len(WORD.findall(f"  {i}\n{code}")):
            assert "".join(by_start) == f"  {i}\n{code}"
            whole[len(parts)] += 1
    assert whole and max(whole) > 1


def test_resample(odd_docs, no_docs):
    out = mixing.resample(odd_docs)
    assert out.columns == odd_docs.columns
    want = sum(r["taken"] for r in mixing.mixture(odd_docs).collect())
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == want
    assert mixing.resample(no_docs).count() == 0 and mixing.mixture(no_docs).count() == 0


# 7
def brute_sketch(t):
    w = [xxhash.xxh64_intdigest(x, 42) for x in (t or "").encode().lower().split()]

    def chain(ws):
        h = 42
        for x in ws:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
        return h - (1 << 64) if h >> 63 else h

    s = sorted({chain(w[i : i + 5]) for i in range(len(w) - 4)} or ({chain(w)} if w else set()))
    return s[: max(sum(x < sketches.THRESHOLD for x in s), sketches.FLOOR)]


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    to = min(sketches.TOP if len(s) < sketches.FLOOR else max(sketches.THRESHOLD - 1, s[-1]) for s in (a, b))
    x, y = {h for h in a if h <= to}, {h for h in b if h <= to}
    return len(x & y) / len(x | y) if x | y else float(a == b)


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints(request, which, parts, monkeypatch):
    df = request.getfixturevalue(which)
    rows = sorted(rows_of(df), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    digits = lambda s: "".join(f"{x & (2**64 - 1):016x}" for x in s)
    want = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        n = len(t) // 3
        e = t[: len(t) - n] + u[:n]
        a, b, x = brute_sketch(t), brute_sketch(e), brute_sketch(u)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), digits(a), digits(b), round(brute_likeness(a, b), 9), round(brute_likeness(a, x), 9)))
    whole = sketches.with_next
    monkeypatch.setattr(sketches, "with_next", lambda d, i, c: whole(d, i, c, parts))
    got = [(*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in sketches.fingerprints(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fingerprints_of_nothing(no_docs):
    assert sketches.fingerprints(no_docs).count() == 0


def test_sketches_merge_and_contain(spark):
    rng = random.Random(2)
    w = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    parts = spark.createDataFrame([(" ".join(w), " ".join(w[:400]), " ".join(w[396:]))], "whole string, a string, b string")
    s = parts.select(*[sketches.sketch(F.col(c)).alias(c) for c in parts.columns])
    r = s.select("whole", sketches.merged(F.col("a"), F.col("b")).alias("m"), sketches.containment(F.col("a"), F.col("whole")).alias("in"), sketches.containment(F.col("whole"), F.col("a")).alias("of")).first()
    assert r["whole"] == r["m"] and r["in"] == 1.0 and 0.02 < r["of"] < 0.25


# 8
@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    got = sharding.shard(df).toPandas()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows_of(df))
    ints = [(None if pd.isna(i) else int(i), s, c) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"])]
    assert Counter(ints) == want
    order = got.assign(none=got["doc_id"].notna(), d=got["doc_id"].fillna(-1)).sort_values(["none", "d", "shard", "slot"])
    assert order["shard"].is_monotonic_increasing and got["shard"].between(0, 39).all()
    for _, x in got.groupby("shard"):
        assert sorted(x["slot"]) == list(range(len(x)))
    total, before = got["size"].sum(), order["size"].cumsum() - order["size"]
    assert (order["shard"] == np.minimum(39, (2 * before + order["size"]) * 40 // (2 * total))).all()


def test_sharding_of_nothing(no_docs):
    assert sharding.shard(no_docs).count() == 0


# 9
def brute_expected(model, word, weight, out):
    """Adds a word's expected pieces, by plain forward and backward sums of probabilities; a byte counts as (b,)."""
    s = lattice.MARK + word

    def arcs(i):
        found = [(j, model.pieces[s[i:j]], [s[i:j]]) for j in range(i + 1, min(len(s), i + model.longest) + 1) if s[i:j] in model.pieces]
        if s[i] not in model.pieces:
            found.append((i + 1, sum(model.bytes[b] for b in s[i].encode()), [(b,) for b in s[i].encode()]))
        return found

    forward, backward = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
    for i in range(len(s)):
        for j, p, _ in arcs(i):
            forward[j] += forward[i] * math.exp(p)
    for i in reversed(range(len(s))):
        backward[i] = sum(math.exp(p) * backward[j] for j, p, _ in arcs(i))
    for i in range(len(s)):
        for j, p, used in arcs(i):
            for piece in used:
                out[piece] += weight * forward[i] * math.exp(p) * backward[j] / forward[-1]


def brute_lattice(path, counts, ends, rounds):
    sp = lattice._processor(path)
    of = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not sp.is_byte(i)}
    of |= {(int(sp.id_to_piece(i)[1:-1], 16),): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    ids = Counter()
    for w, pieces in zip(counts, lattice.piece_ids(path, list(counts))):
        for p in pieces:
            ids[p] += counts[w]
    for _ in range(rounds):
        model, found = lattice.Lattice(path, ids, ends), Counter()
        for w, c in counts.items():
            brute_expected(model, w, c, found)
        ids = {of[p]: n for p, n in found.items()}
    return lattice.Lattice(path, ids, ends)


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
@pytest.mark.parametrize("hot, order, rounds", [(1, "as is", 0), (1 << 18, "as is", 1), (1, "dealt", 2), (1 << 18, "random", 0)])
def test_lm_scoring(request, which, hot, order, rounds):
    df = request.getfixturevalue(which)
    df = {"as is": df, "dealt": df.repartition(7), "random": df.orderBy(F.rand())}[order]
    rows = [(i, (t or "").encode().lower().split()) for i, t in rows_of(df)]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, ws in rows if not out(i) for w in ws)
    ends = sum(not out(i) for i, _ in rows)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    model = brute_lattice(lattice.default_vocabulary(), {w.decode(): k for w, k in c.items()}, ends, rounds)
    base = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted(((i, out(i), len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, round(sum(base(c[w]) for w in ws) + base(ends), 5), round(sum(model.log10(w.decode()) for w in ws) + model.end / math.log(10), 5)) for i, ws in rows), key=repr)
    got = sorted(((*tuple(r)[:5], round(r["base_score"], 5), round(r["score"], 5)) for r in lattice.score(df, hot=hot, rounds=rounds).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-3)


def test_expected_pieces_of_all_segmentations():
    model = lattice.Lattice(lattice.default_vocabulary(), {i: i % 97 for i in range(32000)}, 3)
    words, weights = ["there", "x\U00012000q\U00012000", "é", "日本", "a" * 60, "hello", "\U0001f600\U00012000" + "ab" * 40], np.array([1.0, 2, 3, 4, 5, 6, 7])
    total, of_bytes = model.expected(words, weights)
    want = Counter()
    for w, c in zip(words, weights):
        brute_expected(model, w, c, want)
    assert np.allclose(total, [want[p] for p in model.pieces]) and of_bytes == pytest.approx({b: want[(b,)] for b in of_bytes}) and max(of_bytes.values()) >= 4


def test_lattice_sums_all_segmentations():
    model = lattice.Lattice(lattice.default_vocabulary(), {i: i % 97 for i in range(32000)}, 3)

    def total(w):
        if not w:
            return 1.0
        out = sum(math.exp(model.pieces[w[:k]]) * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in model.pieces)
        return out if w[0] in model.pieces else out + math.exp(sum(model.bytes[b] for b in w[0].encode())) * total(w[1:])

    words = ["there", "xqz", "é", "日本", "a" * 60, "\U0001f600x"]
    assert np.allclose([10 ** model.log10(w) for w in words[:4]], [total(lattice.MARK + w) for w in words[:4]])
    assert np.allclose(model.log10_all(words), [model.log10(w) for w in words])


def test_lm_scoring_of_nothing(no_docs):
    assert lattice.score(no_docs).count() == 0


# 10
@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_packing(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t in rows_of(df):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], "<u4")
            want[(i, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.pack(df).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 4096 + 1


def test_packing_keeps_large_ids_beside_nulls(spark):
    docs = spark.createDataFrame([(9007199254740993, "a"), (None, "b"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert sorted((str(r["doc_id"]) for r in packing.pack(docs).collect())) == ["9007199254740993", "None", "None"]
    named = spark.createDataFrame([("x-1", "a b")], "doc_id string, text string")
    assert packing.pack(named).first()["doc_id"] == "x-1"


def test_other_tokenizers_get_whole_texts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows_of(docs)}
    got = Counter()
    for r in packing.pack(docs, path).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(4)
    for _ in range(60):
        items, room = [rng.randrange(1, 30) for _ in range(9)], rng.randrange(5, 80)
        left = np.zeros(200, np.int64)
        for n in items:
            left[n] += 1
        got = packing.fullest(left, room, 150)
        best = max(s for s in (sum(n for k, n in enumerate(items) if m >> k & 1) for m in range(512)) if s <= room)
        assert sum(n * k for n, k in got) == best and all(k <= left[n] for n, k in got)


# pipeline
def test_language_stage_removes_what_has_no_likely_language(spark, data):
    words = {"en": "the quick brown fox", "de": "über straße und schön", "fr": "après déjà être là", "es": "niño mañana señor así"}
    rows = [(20 * k + i, f"{text} {text} {i}", lang) for k, (lang, text) in enumerate(words.items()) for i in range(20)]
    docs = spark.createDataFrame([*rows, (900, "\u0436\u0436\u0436 \u0449\u0449\u0449", None)], "doc_id long, text string, lang string")
    scores = {r["doc_id"]: r["score"] for r in langid.identify(docs).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, data).collect()}
    assert scores[900] < 0.5 and kept == {r[0] for r in rows}


def test_pipeline(spark, docs, data):
    rows = {r["doc_id"]: r for r in docs.collect()}
    step = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        step = simhash.stored(stage(spark, step, data))
        seen.append(step)
    kept = {r["doc_id"] for r in seen[0].collect()}
    guess = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert kept == {i for i in rows if guess[i] != "und"}
    groups = {i: c for i, _, c in brute_components([(i, rows[i]["text"]) for i in kept])}
    assert Counter(r["doc_id"] for r in seen[1].collect()) == Counter(set(groups.values()))
    for r in seen[2].collect():
        assert not brute_spans(r["text"]) and (r["text"] == rows[r["doc_id"]]["text"]) == ("[SECRET]" not in r["text"])
    mixed = {r["doc_id"]: r["taken"] for r in mixing.mixture(seen[2]).collect()}
    words = Counter()
    for r in seen[3].collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert all(words[i] == n for i, n in mixed.items())
    assert sum(r["length"] for r in seen[4].collect()) > 0 and seen[4].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [s.columns for s in seen[:4]] == [docs.columns] * 4
    assert corpus_pipeline.run(spark, data).count() == seen[4].count()


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_pipeline_of_odd_rows(request, spark, tmp_path, which):
    """Every stage takes the rows its predecessor kept, whatever they hold; the end is the sum of the parts."""
    df = request.getfixturevalue(which)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step, simhash.stored(stage(spark, step, str(tmp_path)))
        assert step.columns == df.columns
        if name == "secret_scan":
            assert step.count() == before.count()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["piece"] == 0 for r in got) == step.count() and (step.count() == 0) == (which == "no_docs")


def test_nothing_to_scan(no_docs):
    assert secrets.scan(no_docs).count() == secrets.redact(no_docs).count() == langid.accepted(no_docs).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and len(queries.QUERIES) == 13

"""Packs shrunk by priority against the same steps one after the other in plain Python."""

import random

import pytest

from korpusgraf.operators import fitting
from korpusgraf.operators.fitting import Cut, Drop, Keep, Pop, Shrink


def plain(items, limit):
    items = [dict(zip(("entry", "block", "nr", "text"), i)) for i in items]
    entries = sorted({i["entry"] for i in items}, reverse=True)
    size = lambda: sum(len(i["text"]) + fitting.ITEM_COST for i in items)
    for s in fitting.ANSWER:
        for e in entries:
            for _ in range(fitting.TRIES):
                if size() <= limit:
                    return sorted(tuple(i.values()) for i in items)
                own = sorted((i for i in items if i["entry"] == e and i["block"] == getattr(s, "block", None)), key=lambda i: i["nr"])
                gone = []
                if isinstance(s, Drop):
                    gone = own if s.beside is None or any(i["entry"] == e and i["block"] == s.beside for i in items) else []
                elif isinstance(s, Keep):
                    gone = own[s.n :]
                elif isinstance(s, Pop):
                    gone = own[-1:] if len(own) > s.n else []
                elif isinstance(s, Cut):
                    for i in own:
                        i["text"] = i["text"][: s.chars]
                elif isinstance(s, Shrink):
                    mine = [i for i in items if i["entry"] == e and i["block"] in s.blocks]
                    if mine:
                        best = min(mine, key=lambda i: (-len(i["text"]), s.blocks.index(i["block"]), i["nr"]))
                        lines = best["text"].split("\n")
                        if len(lines) > s.lines:
                            best["text"] = "\n".join(lines[: max(s.lines, int(len(lines) * 0.8))])
                items = [i for i in items if i not in gone]
    return sorted(tuple(i.values()) for i in items)


@pytest.mark.parametrize("limit", [100, 900, 2_500, 100_000])
def test_packs_are_shrunk_in_order(spark, limit):
    rng = random.Random(limit)
    blocks = sorted({b for s in fitting.ANSWER for b in (getattr(s, "blocks", None) or (s.block,))} | {"source", "control_flow"})
    rows = []
    for k in range(12):
        items = [(e, b, n, "\n".join("x" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 14)))) for e in range(rng.randrange(1, 4)) for b in blocks if rng.random() < 0.6 for n in range(rng.randrange(1, 9))]
        rng.shuffle(items)
        rows.append((k, items))
    packs = spark.createDataFrame([*rows, (99, [])], "id int, items array<struct<entry:int,block:string,nr:int,text:string>>")
    for r in fitting.fitted(packs, limit).collect():
        want = plain(dict([*rows, (99, [])])[r["id"]], limit)
        assert sorted(tuple(i) for i in r["items"]) == want
        assert r["size"] == sum(len(i[3]) + fitting.ITEM_COST for i in want) and r["fits"] == (r["size"] <= limit)

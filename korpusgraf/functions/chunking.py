"""Texts cut into chunks of whole lines, as a table function over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, SMALL = 1000, 150, 200
SCHEMA = "chunk_id long, nr int, start_line int, end_line int, content string"
SENTENCE = re.compile(r"[.!?](?=\s)")


def split_line(line: str, size: int = SIZE) -> list[str]:
    """Parts of at most `size` characters: cut after the last sentence end, else at the last blank, else hard. Joined they are the line."""
    out = []
    while len(line) > size:
        ends = [m.end() for m in SENTENCE.finditer(line, 0, size)]
        at = ends[-1] if ends else line.rfind(" ", 1, size) + 1 or size
        out.append(line[:at])
        line = line[at:]
    return [*out, line]


def chunk_lines(text: str, size: int = SIZE, overlap: int = OVERLAP, boundary: re.Pattern[str] | None = None) -> list[tuple[int, int, str]]:
    """(first line, last line, content), lines from 1. A chunk holds lines up to `size` characters; the next repeats the last whole lines
    of up to `overlap` characters, but nothing before a boundary line, which always begins a chunk."""
    parts = [(n, p) for n, line in enumerate(text.split("\n"), 1) for p in split_line(line, size)]
    out: list[tuple[int, int, str]] = []
    held: list[tuple[int, str]] = []
    kept = 0  # parts of held that only repeat the chunk before

    def close() -> None:
        if len(held) > kept and any(p.strip() for _, p in held):
            out.append((held[0][0], held[-1][0], "\n".join(p for _, p in held)))

    for n, p in parts:
        starts = boundary is not None and boundary.search(p) is not None
        if held and (starts or sum(len(x) + 1 for _, x in held) + len(p) > size):
            close()
            tail: list[tuple[int, str]] = []
            while not starts and held and sum(len(x) + 1 for _, x in tail) + len(held[-1][1]) <= overlap:
                tail.insert(0, held.pop())
            held, kept = (tail, len(tail)) if sum(len(x) + 1 for _, x in tail) + len(p) <= size else ([], 0)
        held.append((n, p))
    close()
    return out


def merge_small(chunks: list[tuple[int, int, str]], small: int = SMALL, boundary: re.Pattern[str] | None = None) -> list[tuple[int, int, str]]:
    """Gathers neighbouring chunks below `small` characters into one until it holds that much; a chunk that begins with a boundary begins a new one."""
    out: list[tuple[int, int, str]] = []
    held: list[tuple[int, int, str]] = []

    def close() -> None:
        if held:
            out.append((held[0][0], held[-1][1], "\n".join(t for *_, t in held)))
            held.clear()

    for chunk in chunks:
        if len(chunk[2]) >= small:
            close()
            out.append(chunk)
            continue
        if boundary is not None and boundary.search(chunk[2].split("\n", 1)[0]):
            close()
        held.append(chunk)
        if sum(len(t) for *_, t in held) >= small:
            close()
    close()
    return out


def fit_bytes(text: str, budget: int) -> list[str]:
    """Parts of at most `budget` UTF-8 bytes, never cut within a character. Joined they are the text."""
    data, out, at = text.encode(), [], 0
    while at < len(data):
        end = min(len(data), at + max(4, budget))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end].decode())
        at = end
    return out


def chunked(texts: DataFrame, id_col: str, text_col: str, boundary: str | None = None) -> DataFrame:
    """chunk_id, nr, start_line, end_line, content of each chunk of each text; null and blank texts give none."""
    pattern = re.compile(boundary) if boundary else None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, *c) for i, t in zip(pdf[id_col], pdf[text_col]) for n, c in enumerate(merge_small(chunk_lines(t or "", boundary=pattern), boundary=pattern))]
            yield pd.DataFrame(rows, columns=["chunk_id", "nr", "start_line", "end_line", "content"])

    return texts.select(id_col, text_col).mapInPandas(cut, SCHEMA)


def outline(text: Column) -> Column:
    """array<struct<line, level, title>> of the markdown headings outside code fences."""
    lines = F.split(text, "\n")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    zero = F.struct(F.lit(False).alias("fence"), F.array().cast("array<struct<line:int,level:int,title:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        fence = x["text"].rlike(r"^\s*(```|~~~)")
        head = F.regexp_extract(x["text"], r"^(#{1,6}) +", 1)
        new = F.array(F.struct(x["line"].cast("int").alias("line"), F.length(head).cast("int").alias("level"), F.trim(F.regexp_replace(x["text"], r"^#+ +| +#*$", "")).alias("title")))
        return F.struct((acc["fence"] != fence).alias("fence"), F.when(~acc["fence"] & ~fence & (head != ""), F.concat(acc["found"], new)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(numbered, zero, step, lambda acc: acc["found"])

"""Texts of files and pages as rows: decoding, HTML, properties files and journals of folders."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that end a line, and elements whose text isn't shown.
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "article", "pre", "blockquote", "header", "footer", "nav", "title"}
HIDDEN = {"script", "style", "noscript", "template"}


class _Lines(HTMLParser):
    """Lines of a page with the heading above each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str]] = []
        self.now: list[str] = []
        self.heading, self.in_heading, self.hidden = "", False, 0

    def flush(self) -> None:
        if line := " ".join("".join(self.now).split()):
            self.heading = line if self.in_heading else self.heading
            self.lines.append((self.heading, line))
        self.now = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in HIDDEN
        if tag in BLOCKS:
            self.flush()
            self.in_heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        if tag in BLOCKS:
            self.flush()
            self.in_heading = False

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.now.append(data)


def html_lines(html: str | None) -> list[tuple[str, str]]:
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.lines


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, nr, section, line: visible lines of each page, with the last heading above."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, s, x) for i, h in zip(pdf["page_id"], pdf["html"]) for n, (s, x) in enumerate(html_lines(h))]
            yield pd.DataFrame(rows, columns=["page_id", "nr", "section", "line"])

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, nr int, section string, line string")


def decode_text(data: bytes) -> str:
    """By byte-order mark, else UTF-8, else cp1252, else Latin-1."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(codec, "replace")
    for codec in ("utf-8", "cp1252"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def read_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modified, size, hash, content of the files under a folder; the hash is that of the bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def decode(col: pd.Series) -> pd.Series:
        return col.map(lambda b: decode_text(bytes(b)))

    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.pandas_udf(decode, "string")("content").alias("content"))


def property_rows(files: DataFrame) -> DataFrame:
    """path, line, key, value of properties files (path, content): comments and blank lines are left out, a closing backslash joins lines."""
    joined = F.regexp_replace("content", r"\\\r?\n[ \t]*", "")
    rows = files.select("path", F.posexplode(F.split(joined, r"\r?\n")).alias("pos", "raw")).where(~F.col("raw").rlike(r"^\s*([#!].*)?$"))
    return rows.select("path", (F.col("pos") + 1).alias("line"), F.trim(F.regexp_extract("raw", r"^\s*([^=: \t]+)", 1)).alias("key"), F.regexp_extract("raw", r"^\s*[^=: \t]+[ \t]*[=: \t][ \t]*(.*)$", 1).alias("value"))


def repo_statistics(files: DataFrame) -> DataFrame:
    """language, files, lines."""
    lines = F.size(F.split("content", "\n"))
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum(lines).alias("lines"))


#: EBCDIC code pages that are told apart, and the characters that stand for text in them.
EBCDIC = ("cp037", "cp273", "cp1140")


def ebcdic_page(data: bytes) -> str | None:
    """The EBCDIC page of which most bytes are letters, digits, blanks or line ends, if at least nine of ten are and fewer would be as ASCII; the first of equals. Else null."""
    if not data or data.isascii():
        return None
    good = lambda text: sum(c.isalnum() or c in " \n\r\x85.,;:()-*/'\"=+" for c in text) / len(text)
    best = max(EBCDIC, key=lambda page: good(data.decode(page)))
    plain = good(data.decode("latin-1"))
    try:
        data.decode("utf-8")
        return None
    except UnicodeDecodeError:
        return best if good(data.decode(best)) >= 0.9 and good(data.decode(best)) > plain else None


def strictly_decoded(files: DataFrame, charset: str | None = None) -> DataFrame:
    """path, charset, text, error_at of files (path, content in bytes): decoded as `charset`, else as EBCDIC where that shows, else as UTF-8; text is null and error_at the
    offset of the first byte that can't be decoded, or null."""

    def decode(col: pd.Series) -> pd.DataFrame:
        out = []
        for raw in col:
            data = bytes(raw or b"")
            page = charset or ebcdic_page(data) or "utf-8"
            try:
                out.append((page, data.decode(page), None))
            except UnicodeDecodeError as e:
                out.append((page, None, e.start))
        return pd.DataFrame(out, columns=["charset", "text", "error_at"]).astype({"error_at": "Int32"})

    made = F.pandas_udf(decode, "charset string, text string, error_at int")("content")
    return files.select("path", made.alias("d")).select("path", "d.charset", "d.text", "d.error_at")


def byte_parts(texts: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """id, nr, part: texts in parts of at most `budget` UTF-8 bytes (fit_bytes); null and empty texts have none."""
    from korpusgraf.functions.chunking import fit_bytes

    cut = F.pandas_udf(lambda col: col.map(lambda t: fit_bytes(t or "", budget)), "array<string>")
    return texts.select(F.col(id_col).alias("id"), F.posexplode(cut(text_col)).alias("nr", "part"))

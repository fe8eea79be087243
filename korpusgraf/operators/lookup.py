"""Tolerant lookup of the symbols that a question names: spellings, then the most telling word with the rest as a score, then suggestions.

Every spelling, anchor and head of all terms is a probe; all probes are tested in one scan of the entities, without a join, and each keeps its best few rows. What follows
works on those rows only, at most a few hundred for each term."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.functions.text import path_tail, split_parameters
from korpusgraf.operators.lineage import stored

#: Words of a question that name nothing; entities that stand for a file; how types rank in a search and in the result (others come last).
STOP_WORDS = ["wie", "was", "der", "die", "das", "und", "oder", "the", "and", "how", "does", "what", "for", "with", "von", "mit"]
FILE_TYPES = [
    "program", "copybook", "compilation_unit", "jcl_file", "jcl_job", "xml_document", "xslt_stylesheet", "html_document", "jsp_page", "shell_script", "properties_file", "groovy_file",
    "javascript_file", "sql_script", "maven_project", "asciidoc_document",
]
SEARCH_RANK = {
    "program": 0, "class": 0, "interface": 0, "copybook": 0, "compilation_unit": 0, "shell_script": 0, "maven_project": 0, "maven_module": 0, "package": 0,
    "section": 1, "paragraph": 1, "method": 1, "constructor": 1, "sql_block": 1, "sql_table": 1,
}
RESULT_RANK = {
    "method": 0, "paragraph": 0, "constructor": 1, "program": 0, "cobol_program": 0, "section": 1, "class": 1, "interface": 1, "enum": 1, "record": 1, "field": 2, "data_item": 2, "compilation_unit": 3,
}
MOST_TERMS, POOL, SUGGESTIONS = 16, 80, 5


class Probe(NamedTuple):
    term: int
    role: str  # name, anchor or head
    nr: int
    phrase: str
    size: int


def spellings(term: str) -> list[str]:
    """A dotted name's members are also known as `Class#member`, with or without what stands before the class."""
    out = [term]
    base = term.split("(", 1)[0]
    if re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+", base):
        *head, owner, member = ["", *base.split(".")]
        head = [h for h in head if h]
        out.append(".".join([*head, owner]) + "#" + member)
        if head:
            out += [f"{owner}#{member}", f"{owner}.{member}"]
    return [s for i, s in enumerate(out) if s.lower() not in {o.lower() for o in out[:i]}]


def words(term: str) -> list[str]:
    return [w for w in re.split(r"[\s,;|]+", term) if len(w) >= 3 and w.lower() not in STOP_WORDS]


def anchor_of(tokens: list[str]) -> str:
    """The word most like a symbol, the longest of several, the first of equals."""
    symbol = lambda t: bool(re.search(r"[.#:()_$]|[a-z][A-Z]", t) or re.fullmatch(r"[A-Z0-9]+(?:-[A-Z0-9]+)+", t))
    return max(tokens, key=lambda t: (symbol(t), len(t)))


def probes(terms: list[str], limit: int) -> list[Probe]:
    out = []
    for i, term in enumerate(terms):
        out += [Probe(i, "name", n, s, limit + 1) for n, s in enumerate(spellings(term))]
        if len(words(term)) > 1:
            out += [Probe(i, "anchor", n, s, POOL) for n, s in enumerate(spellings(anchor_of(words(term))))]
        heads = [h for h in re.split(r"[.#\s(|]+", term) if len(h) >= 3][:2]
        out += [Probe(i, "head", n, h, SUGGESTIONS) for n, h in enumerate(heads)]
    return out


def search_parts(phrase: str) -> list[str]:
    """Six parts of a phrase at most, of a single word the last ones."""
    parts = [p[:80] for p in re.split(r"[\s.#]+|::", phrase) if p]
    return parts[:6] if len(phrase.split()) > 1 else parts[-6:]


def symbol_key(c: Column) -> Column:
    plain = F.replace(F.substring_index(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/")), "(", 1), F.lit("#"), F.lit("."))
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", ""), r"^\.+|\.+$", "")


def signature(listed: Column) -> Column:
    """Types of a parameter list, without `final`, names and white space, in lower case."""

    def type_of(p: Column) -> Column:
        bare = F.trim(F.regexp_replace(p, r"\bfinal\b", " "))
        return F.lower(F.regexp_replace(F.regexp_replace(bare, r"^(.*[>\]\w])\s+[\w$]+$", "$1"), r"\s+", ""))

    return F.transform(split_parameters(listed), type_of)


def matches(term: str) -> Column:
    """The entity (name, qualified_name, file_path) is the term: equal keys, or the term is the end of its qualified name or path; and, if the term has parameters, the same types."""
    needle = symbol_key(F.lit(term))
    name, full, path = symbol_key(F.col("name")), symbol_key(F.col("qualified_name")), symbol_key(F.col("file_path"))
    by_name = (needle == name) | (needle == full) | (needle == path) | ((needle != "") & (F.endswith(full, F.concat(F.lit("."), needle)) | F.endswith(path, F.concat(F.lit("/"), needle))))
    asked = re.search(r"\((.*)\)\s*$", term)
    if not asked:
        return by_name
    listed = r"#[^#@()]*\((.*)\)$"
    own = F.coalesce("qualified_name", F.lit(""))
    return by_name & own.rlike(listed) & (signature(F.regexp_extract(own, listed, 1)) == signature(F.lit(asked.group(1))))


def ranked(by: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for t, rank in by.items():
        out = F.when(F.col("type") == t, rank).otherwise(out)
    return out


def find_symbols(entities: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """term, mode, pos, id: entities (id, name, qualified_name, file_path, type, start_line) for each asked term.

    exact: what a search for the term's spellings finds, up to the first spelling that is a found entity's own name; tokens: the same for a term of several words that is no entity's
    name, or, where a search finds nothing, entities with the most telling word by how many of the other words they hold (all of them, or else some), `limit` + 1 at most;
    none: up to five suggestions by the first two parts of the term, or one row without an id. Entities that are the term come first, then by type, path, line and id; suggestions
    in the order of the search. Blank terms are passed over; more than MOST_TERMS are an error. Null names and paths count as empty."""
    terms = list(dict.fromkeys(t.strip() for t in terms if t and t.strip()))
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    spark = entities.sparkSession
    asked = spark.createDataFrame([(i, t, len(t.split()) > 1) for i, t in enumerate(terms)], "nr_term int, term string, several boolean")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    searched = entities.select("id", "name", "qualified_name", "file_path", "type", "start_line", low("name").alias("low_name"), path_tail(low("qualified_name")).alias("low_tail"), F.when(F.col("type").isin(FILE_TYPES), path_tail(low("file_path"))).otherwise("").alias("low_file"))
    name = F.coalesce("name", F.lit(""))

    def hit(p: Probe) -> Column:
        phrase, parts = p.phrase.lower(), [t.lower() for t in search_parts(p.phrase)]
        in_all = lambda c: reduce(and_, [F.contains(F.col(c), F.lit(t)) for t in parts])
        found = reduce(and_, [reduce(or_, [F.contains(F.col(c), F.lit(t)) for c in ("low_name", "low_tail", "low_file")]) for t in parts])
        tier = F.when(F.col("low_name") == phrase, 0).when(F.startswith("low_name", F.lit(phrase)), 1).when(in_all("low_name"), 2).when(in_all("low_tail"), 3).otherwise(4)
        fields = [F.lit(p.term).alias("nr_term"), F.lit(p.role).alias("role"), F.lit(p.nr).alias("nr"), F.lit(p.size).alias("size"), tier.alias("tier")]
        return F.when(found, F.struct(*fields))

    tried = [hit(p) for p in probes(terms, limit) if search_parts(p.phrase)] or [F.lit(None).cast("struct<nr_term:int,role:string,nr:int,size:int,tier:int>")]
    hits = searched.select("id", "name", "qualified_name", "file_path", "type", "start_line", F.inline(F.array_compact(F.array(*tried))))
    order = Window.partitionBy("nr_term", "role", "nr").orderBy("tier", ranked(SEARCH_RANK, 2), F.length(name), name, "id")
    few = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(POOL, limit + 1)).where(F.col("place") <= F.col("size"))

    # of the kept rows: which spelling is theirs, and how many of the other words they hold
    is_spelling, score, rest_size = F.lit(None).cast("array<boolean>"), F.lit(0), F.lit(0)
    haystack = F.lower(F.concat_ws(" ", name, F.replace(F.coalesce("qualified_name", F.lit("")), F.lit("#"), F.lit(".")), F.coalesce("file_path", F.lit(""))))
    for i, t in enumerate(terms):
        mine = F.col("nr_term") == i
        is_spelling = F.when(mine, F.array(*[matches(s) for s in spellings(t)])).otherwise(is_spelling)
        if len(words(t)) > 1:
            rest = [w.lower() for w in words(t) if w != anchor_of(words(t))]
            score = F.when(mine, sum((F.contains(haystack, F.lit(w)).cast("int") for w in rest), F.lit(0))).otherwise(score)
            rest_size = F.when(mine, len(rest)).otherwise(rest_size)
    few = stored(few.select("nr_term", "role", "nr", "place", "id", "file_path", "start_line", ranked(RESULT_RANK, 4).alias("rank"), is_spelling.alias("is_spelling"), score.alias("score"), rest_size.alias("rest")))

    by_name = few.where("role = 'name'")
    stop = by_name.select("nr_term", "nr", F.posexplode("is_spelling").alias("n", "same")).where("same and n >= nr").groupBy("nr_term").agg(F.min("n").alias("stop"))
    held = by_name.join(stop, "nr_term", "left").where("stop is null or nr <= stop")
    named = held.groupBy("nr_term").agg(F.bool_or(F.exists("is_spelling", lambda x: x)).alias("own"))
    one = lambda df: df.groupBy("nr_term", "id").agg(*[F.first(c).alias(c) for c in ("file_path", "start_line", "rank", "score", "rest")], F.first(F.element_at("is_spelling", 1)).alias("is_term"), F.min(F.struct("nr", "place")).alias("at"))  # noqa: E731 - an entity once
    exact = one(held).join(named, "nr_term").join(asked.select("nr_term", "several"), "nr_term").withColumn("mode", F.when(F.col("several") & ~F.col("own"), "tokens").otherwise("exact"))
    pool = one(few.where("role = 'anchor'")).join(named, "nr_term", "left_anti")
    whole = F.max((F.col("score") == F.col("rest")).cast("int")).over(Window.partitionBy("nr_term")) == 1  # over a pool of at most POOL rows for each spelling
    best = pool.withColumn("whole", whole).where(F.when(F.col("whole"), F.col("score") == F.col("rest")).otherwise(F.col("score") > 0))
    best = best.withColumn("nr", F.row_number().over(Window.partitionBy("nr_term").orderBy(F.desc("score"), "at"))).where(F.col("nr") <= limit + 1).withColumn("mode", F.lit("tokens"))
    found = exact.select("nr_term", "mode", "id", "is_term", "rank", "file_path", "start_line").union(best.select("nr_term", "mode", "id", "is_term", "rank", "file_path", "start_line"))
    by_rank = Window.partitionBy("nr_term").orderBy(F.desc("is_term"), "rank", F.coalesce("file_path", F.lit("")), F.coalesce("start_line", F.lit(0)), "id")
    found = stored(found.withColumn("pos", F.row_number().over(by_rank)).select("nr_term", "mode", "pos", "id"))

    heads = few.where("role = 'head'").join(found, "nr_term", "left_anti")
    first_head = heads.groupBy("nr_term").agg(F.min("nr").alias("nr"))
    suggested = heads.join(first_head, ["nr_term", "nr"]).select("nr_term", F.lit("none").alias("mode"), F.col("place").alias("pos"), "id")
    return asked.join(found.union(suggested), "nr_term", "left").select("term", F.coalesce("mode", F.lit("none")).alias("mode"), "pos", "id")

"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: paths of test code.
TEST_PATH = r"(^|/)(src/test|tests?)/|(Test|Tests|IT|ITCase)\.java$"


def content_fingerprint(text: Column) -> Column:
    """sha256 of the text with every run of white space made one blank and none at the ends."""
    return F.sha2(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")).cast("binary"), 256)


def path_tail(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def search_tokens(query: Column) -> Column:
    """Tokens between white space, `.`, `#` and `::`: the last six of a single word, the first six of several; 80 characters at most each."""
    trimmed = F.trim(query)
    parts = F.filter(F.split(F.lower(trimmed), r"[ \t\n\r.#]+|::"), lambda t: t != "")
    few = F.when(trimmed.rlike(r"[ \t\n\r]"), F.slice(parts, 1, 6)).otherwise(F.when(F.size(parts) > 6, F.slice(parts, -6, 6)).otherwise(parts))
    return F.transform(few, lambda t: F.substring(t, 1, 80))


def contains_ci(text: Column, part: Column) -> Column:
    """Literal, case-blind substring test: nothing in `part` is a wildcard."""
    return F.contains(F.lower(text), F.lower(part))


def starts_with_ci(text: Column, part: Column) -> Column:
    return F.startswith(F.lower(text), F.lower(part))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def concept_terms(question: Column, stopwords: list[str], most: int = 8) -> Column:
    """The first unique words of four letters or more that aren't stopwords."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"([a-z0-9_]{4,})"), F.lit(1))
    return F.slice(F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in stopwords])), 1, most)


def symbol_mentions(text: Column) -> Column:
    """Symbol-like words of prose: with an inner capital, a dot, `#` or an underscore between word characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9]*(?:[._#][A-Za-z0-9]+)+|[a-z]+[A-Z][A-Za-z0-9]*)"), F.lit(1)))


def question_stems(question: Column, generic: list[str] = (), glossary: dict[str, str] | None = None) -> Column:
    """First five letters of each word of four letters or digits and more, distinct, in order; words of `generic` don't count. For each term of the glossary that occurs
    in the question, the words that it stands for count too, after the question's own."""
    low = F.lower(question)
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-zäöüß0-9]{4,})"), F.lit(1)), lambda w: ~w.isin(list(generic)) if generic else F.lit(True))
    added = [F.when(F.contains(low, F.lit(term)), F.array(*[F.lit(w) for w in meant.split()])).otherwise(F.array().cast("array<string>")) for term, meant in (glossary or {}).items()]
    return F.array_distinct(F.transform(F.concat(words, *added), lambda w: F.substring(w, 1, 5)))


def query_variants(symbol: Column) -> Column:
    """Spellings of a.b.c: itself, a.b#c, b#c, b.c; of a.b: itself and a#b. Parameters don't count for the others."""
    p = F.split(F.regexp_replace(F.substring_index(symbol, "(", 1), r"#|::", "."), r"\.")
    n = F.size(p)
    last, before = F.element_at(p, -1), F.when(n > 2, F.element_at(p, -2))
    head = F.array_join(F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0))), ".")
    made = F.array(symbol, F.when(n > 1, F.concat(head, F.lit("#"), last)), F.concat(before, F.lit("#"), last), F.concat(before, F.lit("."), last))
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull()))


def question_symbols(question: Column, most: int = 8) -> Column:
    """Code-like names of a question in order: with a dot, `#`, `::` or `_` inside, an inner capital, a hyphen between capitals, or behind a capital word a digit; of four characters
    or more, `()` and closing marks cut. A name that another one holds, in any case, is dropped."""
    shape = r"([A-Za-z_][A-Za-z0-9_]*(?:(?:\.|#|::)[A-Za-z_][A-Za-z0-9_]*)+|[A-Za-z0-9]+_[A-Za-z0-9_]+|[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+|[A-Za-z]*[a-z0-9][A-Z][A-Za-z0-9]*|[A-Z]{2,}[0-9]+)"
    found = F.array_distinct(F.filter(F.regexp_extract_all(question, F.lit(shape), F.lit(1)), lambda t: F.length(t) >= 4))
    held = lambda ts, t, i: F.exists(ts, lambda o: (F.lower(o) != F.lower(t)) & F.contains(F.lower(o), F.lower(t))) | (F.array_position(F.transform(ts, lambda o: F.lower(o)), F.lower(t)) <= i)
    alone = F.transform(F.array(found), lambda ts: F.filter(ts, lambda t, i: ~held(ts, t, i)))[0]
    return F.slice(alone, 1, most)


def section_path(outline: Column, line: Column) -> Column:
    """`Chapter > Section` at a line of an outline (array of line, level, title, by line): the headings up to it that no later one of the same or a higher level ends; null
    before the first."""
    above = F.filter(outline, lambda h: h["line"] <= line)
    open_ = F.transform(F.array(above), lambda hs: F.filter(hs, lambda h: ~F.exists(hs, lambda o: (o["line"] > h["line"]) & (o["level"] <= h["level"]))))[0]
    return F.nullif(F.array_join(F.transform(open_, lambda h: h["title"]), " > "), F.lit(""))


def explicit_files(message: Column) -> Column:
    """File names and paths that a message quotes, each once whatever its case, with `/` between folders and no leading `./`."""
    found = F.regexp_extract_all(F.replace(message, F.lit("\\"), F.lit("/")), F.lit(r"((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_-]+\.(?:java|cbl|cob|cpy|jcl|xml|xsd|wsdl|sql|sh|properties|jsp|xsl|md|adoc))\b"), F.lit(1))
    clean = F.transform(found, lambda p: F.regexp_replace(p, r"^[./]+", ""))
    first = F.transform(clean, lambda p, i: F.when(F.array_position(F.transform(clean, F.lower), F.lower(p)) == i + 1, p))
    return F.filter(first, lambda p: p.isNotNull())


def identifiers(sentence: Column) -> Column:
    """Name parts of a sentence, lower-cased and sorted: the words in backticks and those with inner capitals, dots or underscores, split at `.#:/()`, of four characters or more."""
    quoted = F.flatten(F.transform(F.regexp_extract_all(sentence, F.lit("`([^`]+)`"), F.lit(1)), lambda q: F.regexp_extract_all(q, F.lit(r"([A-Za-z_][\w.#:/()-]*)"), F.lit(1))))
    bare = F.regexp_extract_all(F.regexp_replace(sentence, "`[^`]*`", " "), F.lit(r"\b((?:[A-Za-z_]\w*[.#])+\w+|[A-Za-z]+[a-z0-9][A-Z]\w*|[A-Za-z]\w*_\w+)"), F.lit(1))
    parts = F.flatten(F.transform(F.concat(quoted, bare), lambda n: F.split(F.lower(n), r"[.#:/()]+")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 4)))


def split_parameters(text: Column) -> Column:
    """Parts of a parameter list between its top-level commas; `<`, `(` nest. Trimmed, empty ones left out."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c.isin("<", "("), 1).when(c.isin(">", ")"), -1).otherwise(0)
        cut = (c == ",") & (acc["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(acc["now"], c)).alias("now"), F.when(cut, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]).alias("out"))

    parts = F.aggregate(F.split(text, ""), start, step, lambda acc: F.concat(acc["out"], F.array(acc["now"])))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def is_documentation(kind: Column, language: Column) -> Column:
    """Chunks of the documentation side: of any source but a repository, or of a language for texts."""
    return (kind != "git") | F.coalesce(language.isin("markdown", "asciidoc", "text", "html"), F.lit(False))


def analysis_fingerprint(inputs: dict[str, Column]) -> Column:
    """sha256 of all that a parse depends on, as JSON in order of the names; a null is part of it."""
    return F.sha2(F.to_json(F.struct(*[inputs[k].alias(k) for k in sorted(inputs)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def entity_keywords(name: Column, path: Column) -> Column:
    """Lower-case parts of a name and of its file's stem between `-`, `_`, `#` and blanks, of three characters or more, distinct."""
    stem = F.regexp_replace(path_tail(path), r"\.[^.]*$", "")
    parts = F.split(F.lower(F.concat_ws("-", name, stem)), r"[-_# ]+")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) >= 3))


def repo_fingerprint(url: Column) -> Column:
    """sha1 of a repository's address without scheme, user, `.git` and closing slashes, in lower case."""
    return F.sha1(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z+]+://([^/@]*@)?", ""), r"(\.git)?/*$", ""))


def redacted(text: Column, secrets: list[str]) -> Column:
    """Literal secrets made `***`, the longest first."""
    for s in sorted(secrets, key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("***"))
    return text


def bundle_stem(path: Column) -> Column:
    """messages_de_CH.properties -> messages."""
    return F.regexp_replace(path_tail(path), r"(_[a-z]{2}(_[A-Z]{2})?)?\.properties$", "")


def bundle_locale(path: Column) -> Column:
    return F.regexp_extract(path_tail(path), r"_([a-z]{2}(_[A-Z]{2})?)\.properties$", 1)


def language_by_content(path: Column, text: Column) -> Column:
    """Language by extension or name, else by the first line's interpreter, else by what the first lines hold."""
    head = F.substring(text, 1, 4000)
    sniffed = F.when(head.rlike(r"^#!\s*\S*/(env\s+)?(ba|k|z)?sh\b"), "shell").when(head.rlike(r"^\s*<\?xml"), "xml").when(head.rlike(r"(?i)^\s*<(!doctype html|html)\b"), "html")
    sniffed = sniffed.when(head.rlike(r"(?im)^(.{6} |\s*)\s*(IDENTIFICATION|ID|PROCEDURE)\s+DIVISION\s*\."), "cobol").when(head.rlike(r"(?m)^//[A-Z0-9@#$]+\s+(JOB|EXEC|PROC)\b"), "jcl")
    return F.coalesce(language_of(path), sniffed)


#: Fixed values in language_of: extensions and names of languages.
def language_of(path: Column) -> Column:
    """Language by extension or name."""
    tail = F.lower(path_tail(path))
    by = {"java": r"\.java$", "cobol": r"\.(cbl|cob|cpy)$", "jcl": r"\.jcl$", "xml": r"\.(xml|xsd|wsdl)$", "shell": r"\.(sh|bash)$", "sql": r"\.sql$", "properties": r"\.properties$", "html": r"\.(html?|jsp)$", "maven": r"^pom\.xml$"}
    out = F.when(tail.rlike(by.pop("maven")), "maven")
    for lang, pattern in by.items():
        out = out.when(tail.rlike(pattern), lang)
    return out


def codeowners_pattern(rule: str) -> str:
    """A CODEOWNERS glob as a regular expression for rlike: `**` crosses directories, `*` and `?` don't, a leading or inner slash anchors. Negations and
    character classes, which such files don't know, match nothing."""
    if rule.startswith("!") or "[" in rule:
        return r"(?!)"
    anchored, folder = "/" in rule.rstrip("/"), rule.endswith("/")
    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x) or "".join("\\" + c if c in r".+()[]{}^$|\\" else c for c in x) for x in _globs(rule.strip("/")))
    return ("^" if anchored else "(^|/)") + out.replace(".*/", "(.*/)?") + ("/" if folder else "(/|$)")


def _globs(s: str) -> list[str]:
    out, i = [], 0
    while i < len(s):
        n = 2 if s[i : i + 2] == "**" else 1
        out.append(s[i : i + n])
        i += n
    return out

"""Passes over lines of host programs, screens and configuration files: formats, continued lines, regions, data items, data access and keys.

Files are (path, content). What a line means depends on lines above it, so a file's lines meet in one task: one file must fit in it, and
files spread over all. Names compare in upper case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.operators.lineage import stored
from korpusgraf.operators.structure import in_file, lines, logical_lines, part, so_far

NAME = r"[A-Z0-9]+(?:-[A-Z0-9]+)*"


def source_format(files: DataFrame) -> DataFrame:
    """path, format (fixed, free): by the first >>SOURCE directive, also behind a numbered sequence area, else by counting lines: comments after code and text in columns 1 to 6 speak for free,
    indicators in column 7 for fixed; fixed if there are as many."""
    l = lines(files).where(F.trim("text") != "")
    directive = F.lower(part(r"(?i)^(?:[0-9 ]{6} |\s*)\s*>>\s*SOURCE\s+(?:FORMAT\s+)?(?:IS\s+)?(FREE|FIXED)\b"))
    area = F.trim(F.substring("text", 1, 6))
    inline = F.col("text").rlike(r"\S.*\*>")
    free = inline | ((area != "") & ~area.rlike("^[0-9]+$"))
    fixed = ~free & F.substring("text", 7, 1).isin("*", "/", "-", "D", "d", "$")
    first = F.min_by(directive, "line")
    out = l.groupBy("path").agg(first.alias("directive"), F.count_if(free).alias("free"), F.count_if(fixed).alias("fixed"))
    return files.select("path").join(out, "path", "left").select("path", F.coalesce("directive", F.when(F.col("free") > F.col("fixed"), "free").otherwise("fixed")).alias("format"))


def active_lines(code: DataFrame, defines: dict[str, str]) -> DataFrame:
    """Lines (path, line, text) that no >>IF, >>ELSE, >>END-IF region makes inactive for certain: `n = m` of numbers and DEFINED(name) of known names are
    decided, any other condition leaves both branches. Directive lines stay out."""
    kind = F.upper(part(r"(?i)^\s*>>\s*(IF|ELSE|END-IF)\b"))
    l = code.withColumn("kind", kind).withColumn("condition", F.upper(F.trim(F.regexp_extract("text", r"(?i)^\s*>>\s*IF\s+(.*)$", 1))))
    opened = F.sum(F.when(F.col("kind") == "IF", 1).otherwise(0)).over(so_far())
    closed = F.coalesce(F.sum(F.when(F.col("kind") == "END-IF", 1).otherwise(0)).over(in_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    l = l.withColumn("depth", opened - closed)
    l = l.withColumn("head", F.col("kind").isNotNull() & (F.col("depth") > 0))
    level = Window.partitionBy("path", "depth", "head").orderBy("line")
    left, right = F.regexp_extract("condition", r"^(\d+)\s*=\s*(\d+)$", 1), F.regexp_extract("condition", r"^(\d+)\s*=\s*(\d+)$", 2)
    known = F.upper(F.regexp_extract("condition", r"^DEFINED\s*\(\s*([A-Z0-9-]+)\s*\)$", 1))
    value = F.when(left != "", left == right).when(known.isin([d.upper() for d in defines]), F.lit(True))
    l = l.withColumn("value", F.last(F.when(F.col("kind") == "IF", F.struct(value.alias("v"))), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0))["v"])
    # a head that takes lines away does so up to the next head of its level; all windows are along files, so lines meet theirs without a join
    takes = F.coalesce(F.col("head") & (((F.col("kind") == "IF") & ~F.col("value")) | ((F.col("kind") == "ELSE") & F.col("value"))), F.lit(False)).cast("int")
    change = F.when(F.col("head"), F.col("takes") - F.coalesce(F.lag("takes").over(level), F.lit(0))).otherwise(0)
    met = l.withColumn("takes", takes).withColumn("d", change).withColumn("off", F.sum("d").over(so_far()))
    return met.where("kind is null and off = 0").select(*code.columns)


def replaced(code: DataFrame) -> DataFrame:
    """Lines (path, line, text) with the last REPLACE statement above applied to whole words, until REPLACE OFF; the statements themselves stay out.
    Pairs are ==old== BY ==new==, applied in their order."""
    low = F.upper("text")
    pairs = F.regexp_extract_all("text", F.lit(r"==\s*([^=]+?)\s*==\s+[Bb][Yy]\s+==\s*([^=]*?)\s*=="), F.lit(0))
    given = F.when(low.rlike(r"^\s*REPLACE\s+OFF\b"), F.array().cast("array<string>")).when(low.rlike(r"^\s*REPLACE\s+=="), pairs)
    l = code.withColumn("_given", given).withColumn("_pairs", F.last("_given", ignorenulls=True).over(so_far()))
    one = lambda p, i: F.regexp_extract(p, r"==\s*([^=]+?)\s*==\s+[Bb][Yy]\s+==\s*([^=]*?)\s*==", i)
    shape = lambda p: F.concat(F.lit(r"(?<![A-Za-z0-9-])\Q"), one(p, 1), F.lit(r"\E(?![A-Za-z0-9-])"))
    made = F.aggregate(F.coalesce("_pairs", F.array().cast("array<string>")), F.col("text"), lambda acc, p: F.regexp_replace(acc, shape(p), one(p, 2)))
    return l.where("_given is null").select(*[made.alias("text") if c == "text" else F.col(c) for c in code.columns])


def data_items(code: DataFrame) -> DataFrame:
    """path, line, level, name, pic, occurs, value, redefines of data descriptions on logical lines (path, line, text)."""
    up = code.withColumn("text", F.upper("text"))
    rows = up.select(
        "path", "line", part(r"^\s*(\d{1,2})\s").cast("int").alias("level"), part(rf"^\s*\d{{1,2}}\s+({NAME})").alias("name"), part(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S*[A-Z0-9()])").alias("pic"),
        part(r"\bOCCURS\s+(?:\d+\s+TO\s+)?(\d+)").cast("int").alias("occurs"), part(r"""\bVALUES?\s+(?:ARE\s+|IS\s+)?(-?[0-9.]*[0-9]|'[^']*'|"[^"]*"|[A-Z-]+)""").alias("value"), part(rf"\bREDEFINES\s+({NAME})").alias("redefines"),
    )
    return rows.where("level is not null and name is not null")


def inherited_fields(copies: DataFrame, fields: DataFrame) -> DataFrame:
    """program, name, level: the fields of copybooks that programs copy (program, copybook, old, new: text replaced in names, or null), where the copybook
    is a single file. fields: copybook, path, name, level."""
    one = fields.groupBy("copybook").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a = b").select("copybook")
    # equal copies and equal fields meet once
    copies = copies.select("program", "copybook", "old", "new").distinct()
    met = copies.join(fields.join(one, "copybook", "left_semi").select("copybook", "name", "level").distinct(), "copybook")
    return met.select("program", F.when(F.col("old").isNotNull(), F.replace("name", F.col("old"), F.coalesce("new", F.lit("")))).otherwise(F.col("name")).alias("name"), "level").distinct()


#: Statement shapes by operand position: (access, pattern of one group with the operands).
OPERANDS = [
    ("READS", rf"\bMOVE\s+({NAME})\s+TO\b"),
    ("WRITES", rf"\bMOVE\s+\S+\s+TO\s+({NAME}(?:[\s,]+{NAME})*)"),
    ("READS", rf"\b(?:ADD|SUBTRACT)\s+({NAME}(?:[\s,]+{NAME})*?)\s+(?:TO|FROM)\b"),
    ("WRITES", rf"\b(?:ADD|SUBTRACT)\s+.*?\s(?:TO|FROM)\s+({NAME})"),
    ("WRITES", rf"\bCOMPUTE\s+({NAME})\s*="),
    ("READS", r"\bCOMPUTE\s+\S+\s*=\s*([^.]*)"),
    ("READS", r"\b(?:IF|UNTIL|EVALUATE)\s+([^.]*?)(?:\s+THEN\b|\.|$)"),
    ("WRITES", rf"\b(?:INITIALIZE|ACCEPT)\s+({NAME})"),
    ("READS", rf"\bDISPLAY\s+({NAME})"),
]


def _tagged(values: Column, tag: Column, name: str) -> Column:
    """An array of structs of a tag and each value."""
    return F.transform(values, lambda v: F.struct(tag, v.alias(name)))


def data_references(code: DataFrame, fields: DataFrame) -> DataFrame:
    """path, line, access (READS, WRITES), name: fields (path, name) of the same program by their place in statements on logical lines."""
    names = lambda p: F.flatten(F.transform(F.regexp_extract_all("up", F.lit(p), F.lit(1)), lambda g: F.regexp_extract_all(g, F.lit(f"({NAME})"), F.lit(1))))
    found = F.concat(*[_tagged(names(p), F.lit(a).alias("access"), "name") for a, p in OPERANDS])
    bare = code.withColumn("up", F.regexp_replace(F.upper("text"), r"'[^']*'|\"[^\"]*\"", "''"))
    one = bare.select("path", "line", F.explode(F.array_distinct(found)).alias("f")).select("path", "line", "f.access", "f.name")
    return one.join(fields.select("path", F.upper("name").alias("name")).distinct(), ["path", "name"], "left_semi").select("path", "line", "access", "name")


def file_access(code: DataFrame) -> DataFrame:
    """path, line, operation (ASSIGN, OPEN-mode, READ, WRITE, REWRITE, DELETE, START, CLOSE), file, target (of ASSIGN): statements on logical lines."""
    up = code.withColumn("up", F.upper("text"))
    assign = F.transform(F.regexp_extract_all("up", F.lit(rf"\bSELECT\s+({NAME})\s+ASSIGN"), F.lit(1)), lambda f: F.struct(F.lit("ASSIGN").alias("operation"), f.alias("file"), F.regexp_extract("up", rf"\bASSIGN\s+(?:TO\s+)?['\"]?({NAME})", 1).alias("target")))
    use = lambda operation, files: F.transform(files, lambda f: F.struct(F.lit(operation).alias("operation"), f.alias("file"), F.lit(None).cast("string").alias("target")))
    modes = ["INPUT", "OUTPUT", "I-O", "EXTEND"]
    listed = lambda m: F.flatten(F.transform(F.regexp_extract_all("up", F.lit(rf"\b{m}\s+({NAME}(?:\s+{NAME})*)"), F.lit(1)), lambda g: F.split(F.regexp_replace(g, rf"\s(?:{'|'.join(modes)})\b.*", ""), r"\s+")))
    opened = F.when(F.col("up").rlike(r"\bOPEN\s"), F.concat(*[use(f"OPEN-{m}", listed(m)) for m in modes]))
    plain = F.concat(*[use(v, F.regexp_extract_all("up", F.lit(rf"(?<![A-Z0-9-]){v}\s+({NAME})"), F.lit(1))) for v in ("READ", "WRITE", "REWRITE", "DELETE", "START", "CLOSE")])
    none = F.array().cast("array<struct<operation:string,file:string,target:string>>")
    return up.select("path", "line", F.explode(F.concat(assign, F.coalesce(opened, none), plain)).alias("f")).select("path", "line", "f.operation", "f.file", "f.target")


def exec_blocks(files: DataFrame) -> DataFrame:
    """path, nr, line, kind (CICS, SQL, DLI, ...), operation, options (map of name to value), tables, variables of EXEC ... END-EXEC blocks, over as many lines as
    they take. tables and variables (:name) of SQL only."""
    shape = r"(?is)\bEXEC\s+(?:CICS|SQL|DLI|MQ)\b.*?\bEND-EXEC\b"
    held = files.withColumn("blocks", F.regexp_extract_all("content", F.lit(shape), F.lit(0))).withColumn("gaps", F.split("content", shape))
    breaks = lambda t: F.regexp_count(t, F.lit("\n"))
    before = lambda i: F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.lit(0), lambda acc, g: acc + breaks(g)) + F.aggregate(F.slice("blocks", F.lit(1), i), F.lit(0), lambda acc, g: acc + breaks(g))
    rows = held.select("path", F.posexplode(F.transform("blocks", lambda b, i: F.struct(b.alias("text"), (before(i) + 1).alias("line")))).alias("nr", "b")).select("path", "nr", "b.line", F.upper(F.regexp_replace("b.text", r"\s+", " ")).alias("text"))
    body = rows.withColumn("kind", part(r"^EXEC (\w+)")).withColumn("body", F.regexp_extract("text", r"^EXEC \w+ (.*?) ?END-EXEC$", 1))
    names = F.regexp_extract_all("body", F.lit(r"\b([A-Z0-9]+) ?\(([^()]*)\)"), F.lit(1))
    values = F.transform(F.regexp_extract_all("body", F.lit(r"\b([A-Z0-9]+) ?\(([^()]*)\)"), F.lit(2)), lambda v: F.trim(F.regexp_replace(v, "['\"]", "")))
    options = F.when(F.col("kind") != "SQL", F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, F.element_at(values, F.array_position(names, n).cast("int"))))))
    sql = F.col("kind") == "SQL"
    tables = F.when(sql, F.array_join(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(?:FROM|JOIN|INTO|UPDATE) ([A-Z_][A-Z0-9_.]*)"), F.lit(1))), ","))
    variables = F.when(sql, F.array_join(F.array_distinct(F.regexp_extract_all("body", F.lit(r":([A-Z0-9-]+)"), F.lit(1))), ","))
    verb = F.when(F.col("kind") == "CICS", part(r"^([A-Z]+(?: (?:MAP|TD|TS|TEXT|CONTROL))?)(?=[ (]|$)", text="body")).otherwise(part(r"^([A-Z]+)", text="body"))
    return body.select("path", "nr", "line", "kind", verb.alias("operation"), options.alias("options"), tables.alias("tables"), variables.alias("variables"))


def dynamic_candidates(code: DataFrame) -> DataFrame:
    """path, line, field, candidates: for each CALL of a data name the literals that its program gives that field, by MOVE or VALUE, sorted."""
    up = code.withColumn("up", F.upper("text"))
    none = F.lit(None).cast("string")
    given = lambda field, literal: F.struct(F.lit(None).cast("int").alias("line"), part(field, text="up").alias("field"), F.trim(part(literal, text="up")).alias("literal"))
    called = F.struct("line", part(rf"\bCALL\s+({NAME})(?![A-Z0-9-])", text="up").alias("field"), none.alias("literal"))
    moved = given(rf"\bMOVE\s+['\"][^'\"]+['\"]\s+TO\s+({NAME})", rf"\bMOVE\s+['\"]([^'\"]+)['\"]\s+TO\s+{NAME}")
    valued = given(rf"^\s*\d{{1,2}}\s+({NAME})\s.*\bVALUE\s+(?:IS\s+)?['\"]", r"\bVALUE\s+(?:IS\s+)?['\"]([^'\"]+)['\"]")
    # lines are read once; calls and what is given meet where they are grouped, and a literal of a program's field moves once
    rows = up.select("path", F.inline(F.array(called, moved, valued))).where("field is not null and (line is not null or literal is not null)")
    one = rows.groupBy("path", "field").agg(F.collect_list("line").alias("lines"), F.array_join(F.sort_array(F.collect_set("literal")), ",").alias("candidates"))
    return one.select("path", F.explode("lines").alias("line"), "field", "candidates")


def paragraph_chunks(units: DataFrame, code: DataFrame, size: int = 4_000, least: int = 400) -> DataFrame:
    """path, nr, start_line, end_line, chars: chunks of a program along its paragraphs (units: path, section, start_line, end_line). Neighbours of one section
    shorter than `least` are gathered until they hold that much, one longer than `size` is cut after the line that fills it."""
    held = code.join(units, "path").where("line between start_line and end_line").select("path", "section", "start_line", "end_line", "line", (F.char_length("text") + 1).alias("chars"))
    sizes = held.groupBy("path", "section", "start_line", "end_line").agg(F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("line", "chars"))).alias("ls"))
    files = sizes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "section", "chars", "ls"))).alias("us"))
    chunk = "array<struct<start_line:int,end_line:int,chars:bigint,section:string,open:boolean>>"

    def join(acc: Column, u: Column) -> Column:
        last = F.element_at(acc, -1)
        goes_on = (F.size(acc) > 0) & last["open"] & last["section"].eqNullSafe(u["section"]) & (u["chars"] < least)
        grown = F.struct(last["start_line"].alias("start_line"), u["end_line"].cast("int").alias("end_line"), (last["chars"] + u["chars"]).alias("chars"), u["section"].alias("section"), (last["chars"] + u["chars"] < least).alias("open"))
        own = F.struct(u["start_line"].cast("int").alias("start_line"), u["end_line"].cast("int").alias("end_line"), u["chars"].alias("chars"), u["section"].alias("section"), (u["chars"] < least).alias("open"))
        return F.when(u["chars"] > size, F.concat(acc, _cut(u, size).cast(chunk))).when(goes_on, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown).cast(chunk))).otherwise(F.concat(acc, F.array(own).cast(chunk)))

    made = files.select("path", F.posexplode(F.aggregate("us", F.array().cast(chunk), join)).alias("nr", "c"))
    return made.select("path", "nr", "c.start_line", "c.end_line", "c.chars")


def _cut(u: Column, size: int) -> Column:
    """A long paragraph's lines in pieces of at most `size` characters, a longer line alone."""
    piece = "array<struct<start_line:int,end_line:int,chars:bigint,section:string,open:boolean>>"

    def take(acc: Column, l: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (last["chars"] + l["chars"] <= size)
        grown = F.struct(last["start_line"].alias("start_line"), l["line"].cast("int").alias("end_line"), (last["chars"] + l["chars"]).alias("chars"), u["section"].alias("section"), F.lit(False).alias("open"))
        own = F.struct(l["line"].cast("int").alias("start_line"), l["line"].cast("int").alias("end_line"), l["chars"].cast("long").alias("chars"), u["section"].alias("section"), F.lit(False).alias("open"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown).cast(piece))).otherwise(F.concat(acc, F.array(own).cast(piece)))

    return F.aggregate(u["ls"], F.array().cast(piece), take)


def range_chunks(code: DataFrame, ranges: DataFrame, grain: int = 64) -> DataFrame:
    """id, text: the lines (path, line, text) of each range (id, path, start_line, end_line), such as one chunk for each routine. Ranges and lines meet by cells
    of `grain` lines, so a long file is spread."""
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_line") / grain), F.floor(F.col("end_line") / grain))))
    met = code.withColumn("cell", F.floor(F.col("line") / grain)).join(cells, ["path", "cell"]).where("line between start_line and end_line")
    return met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def screen_fields(files: DataFrame) -> DataFrame:
    """path, line, mapset, map, name, row, col, length, label: named fields of screen definitions with the constant to their left in the same row, the nearest.
    Each macro on one line."""
    l = lines(files).withColumn("macro", part(r"\b(DFHMSD|DFHMDI|DFHMDF)\b")).where("macro is not null").withColumn("name", part(r"^([A-Z0-9@#$]+)\s"))
    for col, macro in (("mapset", "DFHMSD"), ("map", "DFHMDI")):
        l = l.withColumn(col, F.last(F.when(F.col("macro") == macro, F.col("name")), ignorenulls=True).over(so_far()))
    at = r"POS=\((\d+),(\d+)\)"
    f = l.where("macro = 'DFHMDF'").select("path", "line", "mapset", "map", "name", part(at, 1).cast("int").alias("row"), part(at, 2).cast("int").alias("col"), part(r"LENGTH=(\d+)").cast("int").alias("length"), part(r"INITIAL='([^']*)'").alias("initial"))
    left = Window.partitionBy("path", "mapset", "map", "row").orderBy("col", "line").rowsBetween(Window.unboundedPreceding, -1)
    return f.withColumn("label", F.last(F.when(F.col("name").isNull(), F.col("initial")), ignorenulls=True).over(left)).where("name is not null").drop("initial")


def yaml_keys(files: DataFrame) -> DataFrame:
    """path, line, key (from the root, joined by dots), value: `key: value` lines by indentation; list items and block texts aren't keys."""
    l = lines(files).withColumn("indent", F.length(F.regexp_extract("text", r"^( *)", 1))).withColumn("name", part(r"""^ *["']?([A-Za-z0-9_.-]+)["']?\s*:(?:\s|$)""")).where("name is not null")
    one = l.select("path", "line", "indent", "name", F.trim(F.regexp_replace(F.regexp_extract("text", r"^[^:]*:\s*(.*)$", 1), r"""^["']|["']$""", "")).alias("value"))
    whole = one.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "indent", "name", "value"))).alias("ls"))
    start = F.struct(F.array().cast("array<struct<indent:int,name:string>>").alias("stack"), F.array().cast("array<struct<line:int,key:string,value:string>>").alias("out"))

    def push(acc: Column, l: Column) -> Column:
        stack = F.concat(F.filter(acc["stack"], lambda s: s["indent"] < l["indent"]), F.array(F.struct(l["indent"].cast("int").alias("indent"), l["name"].alias("name"))))
        key = F.array_join(F.transform(stack, lambda s: s["name"]), ".")
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(l["line"].cast("int").alias("line"), key.alias("key"), l["value"].alias("value")))).alias("out"))

    return whole.select("path", F.explode(F.aggregate("ls", start, push, lambda acc: acc["out"])).alias("k")).select("path", "k.line", "k.key", "k.value")


def ini_keys(files: DataFrame) -> DataFrame:
    """path, line, key (section and key joined by a dot), value of INI files; `;` and `#` begin comments."""
    l = lines(files).where(~F.col("text").rlike(r"^\s*[;#]")).withColumn("section", F.last(part(r"^\s*\[([^\]]+)\]"), ignorenulls=True).over(so_far()))
    key = part(r"^\s*([^=\[\s][^=]*?)\s*=")
    return l.withColumn("k", key).where("k is not null").select("path", "line", F.concat_ws(".", "section", "k").alias("key"), F.trim(F.regexp_extract("text", r"^[^=]*=(.*)$", 1)).alias("value"))


def well_formed(content: Column) -> Column:
    """The text if it is well-formed XML, else null: one malformed file doesn't end a job."""
    parsed = F.from_xml(content, "_value string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(parsed["_corrupt_record"].isNull(), content)


def xml_elements(files: DataFrame) -> DataFrame:
    """path, nr, element (names from the root, joined by `/`), attributes (map) of the elements of XML files in document order, without namespace prefixes; malformed files have
    none. An element's place comes from the tags before it, so a file's tags meet in one fold."""
    clean = F.regexp_replace(F.col("x"), r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    tags = F.regexp_extract_all(clean, F.lit(r"""(</?[A-Za-z_](?:[^>"']|"[^"]*"|'[^']*')*>)"""), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<element:string,tag:string>>").alias("out"))

    def push(acc: Column, tag: Column) -> Column:
        closes, alone = F.startswith(tag, F.lit("</")), F.endswith(tag, F.lit("/>"))
        stack = F.concat(acc["stack"], F.array(F.regexp_extract(tag, r"^<(?:[\w.-]+:)?([\w.-]+)", 1)))
        shorter = F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))
        out = F.concat(acc["out"], F.array(F.struct(F.array_join(stack, "/").alias("element"), tag.alias("tag"))))
        return F.struct(F.when(closes, shorter).when(alone, acc["stack"]).otherwise(stack).alias("stack"), F.when(closes, acc["out"]).otherwise(out).alias("out"))

    shape = r"""([\w:.-]+)\s*=\s*["']([^"']*)["']"""
    names, values = (F.regexp_extract_all("e.tag", F.lit(shape), F.lit(i)) for i in (1, 2))
    rows = files.select("path", well_formed(F.col("content")).alias("x")).where("x is not null").select("path", F.posexplode(F.aggregate(tags, start, push, lambda acc: acc["out"])).alias("nr", "e"))
    return rows.select("path", "nr", "e.element", F.map_from_arrays(names, values).alias("attributes"))


def schema_names(files: DataFrame) -> DataFrame:
    """path, namespace, kind (element, complexType, simpleType, message, portType), name: what WSDL and XSD files declare at their top level; malformed files
    declare nothing."""
    f = files.select("path", well_formed(F.col("content")).alias("x"))
    space = F.xpath_string("x", F.lit("/*/@targetNamespace"))
    kinds = ["element", "complexType", "simpleType", "message", "portType"]
    found = F.concat(*[_tagged(F.xpath("x", F.lit(f"/*/*[local-name()='{k}']/@name")), F.lit(k).alias("kind"), "name") for k in kinds])
    return f.where("x is not null").select("path", space.alias("namespace"), F.explode(found).alias("d")).select("path", "namespace", "d.kind", "d.name")


def spring_beans(files: DataFrame) -> DataFrame:
    """path, nr, id, class of the beans of Spring files that have both; malformed files have none."""
    f = files.select("path", well_formed(F.col("content")).alias("x")).where("x is not null")
    n = F.xpath_int("x", F.lit("count(//*[local-name()='bean'])"))
    at = lambda a: F.xpath("x", F.lit(f"//*[local-name()='bean'][@class and @id]/@{a}")).alias(a)
    both = F.arrays_zip(at("id"), at("class"))
    return f.where(n > 0).select("path", F.posexplode(both).alias("nr", "b")).select("path", "nr", "b.id", "b.class")


def endpoints(files: DataFrame) -> DataFrame:
    """path, line, verb, route: HTTP endpoints of Java files, a method's mapping joined to that of its class."""
    shape = r"@(Path|RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping)\(\s*(?:value\s*=\s*)?\"([^\"]*)\""
    l = lines(files).withColumn("kind", part(shape, 1)).withColumn("route", F.regexp_extract("text", shape, 2)).withColumn("is_class", F.col("text").rlike(r"\b(class|interface)\s+[A-Z]"))
    ahead = in_file().rowsBetween(0, Window.unboundedFollowing)
    head = F.first(F.when(F.col("is_class"), F.col("line")), ignorenulls=True).over(ahead)
    l = l.withColumn("of_class", head.isNotNull() & F.col("kind").isin("Path", "RequestMapping"))
    base = F.last(F.when(F.col("of_class") & F.col("kind").isNotNull(), F.col("route")), ignorenulls=True).over(so_far())
    clean = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    route = F.concat(F.lit("/"), F.concat_ws("/", F.nullif(clean(F.coalesce(F.col("base"), F.lit(""))), F.lit("")), F.nullif(clean(F.col("route")), F.lit(""))))
    verb = F.when(F.col("kind").isin("Path", "RequestMapping"), "ANY").otherwise(F.upper(F.regexp_replace("kind", "Mapping", "")))
    return l.withColumn("base", base).where("kind is not null and not of_class").select("path", "line", verb.alias("verb"), route.alias("route"))


def asciidoc_facts(files: DataFrame) -> DataFrame:
    """path, line, type (heading, include, mention), level (of headings), name: outline, includes and quoted code names of AsciiDoc files."""
    l = lines(files)
    heading, include = part(r"^={1,6}\s+(\S.*?)\s*$"), part(r"^include::([^\[]+)\[")
    level = F.length(F.regexp_extract("text", r"^(=+)\s", 1))
    row = lambda t, n, level: F.struct(F.lit(t).alias("type"), level.cast("int").alias("level"), n.alias("name"))
    quoted = F.transform(F.regexp_extract_all("text", F.lit("`([^`]+)`"), F.lit(1)), lambda n: row("mention", n, F.lit(None)))
    found = F.filter(F.concat(F.array(row("heading", heading, level), row("include", include, F.lit(None))), quoted), lambda x: x["name"].isNotNull())
    return l.select("path", "line", F.explode(found).alias("f")).select("path", "line", "f.type", "f.level", "f.name")


def composed_lines(files: DataFrame) -> DataFrame:
    """path, position, source, line, text: the lines of each AsciiDoc file with its includes in their place. An include of a file that is being included already, or of
    none, stays a line; so a level holds fewer files than the one before, and includes nest until no level has any. position: line numbers from the file inwards."""
    l = lines(files).withColumn("target", part(r"^include::([^\[]+)\["))
    now = l.select("path", F.array("line").alias("position"), F.col("path").alias("source"), "line", "text", "target", F.array("path").alias("open"))
    body = l.select(F.col("path").alias("target"), F.col("line").alias("l"), F.col("text").alias("t"), F.col("target").alias("n"))
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("known"))
    out = None
    while True:
        met = now.join(known, "target", "left").withColumn("goes", F.coalesce("known", F.lit(False)) & ~F.array_contains("open", F.coalesce("target", F.lit(""))))
        done = met.where("not goes").select("path", "position", "source", "line", "text")
        out = done if out is None else out.union(done)
        now = met.where("goes").join(body, "target").select("path", F.concat("position", F.array("l")).alias("position"), F.col("target").alias("source"), F.col("l").alias("line"), F.col("t").alias("text"), F.col("n").alias("target"), F.concat("open", F.array("target")).alias("open"))
        now = stored(now)
        if now.isEmpty():
            break
    return out


def completeness(results: DataFrame) -> DataFrame:
    """path, state: complete, partial or fallback of parse results (path, errors, fallback: the parser gave up structure, covered: share of lines that it
    explained): fallback first, then partial for errors or less than everything covered."""
    state = F.when(F.coalesce("fallback", F.lit(False)), "fallback").when((F.coalesce("errors", F.lit(0)) > 0) | (F.coalesce("covered", F.lit(1.0)) < 1.0), "partial").otherwise("complete")
    return results.select("path", state.alias("state"))


def build_profile(files: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """path and each key of keys: settings of a file (path, source, variant) from profile fragments (source, prefix, variant; null counts for all), each setting from the most
    special fragment that has it: longest prefix of the path, then one for the variant, then one for the source."""
    met = files.withColumnsRenamed({"source": "_s", "variant": "_v"}).join(F.broadcast(fragments), F.col("path").startswith(F.coalesce("prefix", F.lit(""))) & (F.col("source").isNull() | (F.col("source") == F.col("_s"))) & (F.col("variant").isNull() | (F.col("variant") == F.col("_v"))), "left")
    rank = F.struct(F.length(F.coalesce("prefix", F.lit(""))), F.col("variant").isNotNull(), F.col("source").isNotNull())
    return met.groupBy("path").agg(*[F.max_by(F.col(k), F.when(F.col(k).isNotNull(), rank)).alias(k) for k in keys])

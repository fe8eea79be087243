"""Structure of source files as rows: each line is a row, its shape gives entities and edges, and windows along a file give ranges and owners.

Files are (path, content). A file's lines meet in one task, so one file must fit in it; files spread over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_file() -> WindowSpec:
    return Window.partitionBy("path").orderBy("line")


def so_far() -> WindowSpec:
    return in_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)


#: Files that meet in one task, where lines of a file do.
FILES_A_TASK = 2_000


def dealt(files: DataFrame) -> DataFrame:
    """files dealt by path to as many tasks as their number asks for: what a task holds doesn't grow with the input, and windows along a file's lines move none of them again."""
    least = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(least, -(-files.count() // FILES_A_TASK)), "path")


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text."""
    return files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def part(pattern: str, group: int = 1, text: str = "text") -> Column:
    """The group of a match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def owner(col: str) -> Column:
    """The last value above, in the same file."""
    return F.last(col, ignorenulls=True).over(so_far())


def ranged(heads: DataFrame, all_lines: DataFrame) -> DataFrame:
    """heads (path, line, ...) with end_line: the line before the next head, or the file's last."""
    last = all_lines.groupBy("path").agg(F.max("line").alias("_last"))
    return heads.withColumn("_next", F.lead("line").over(in_file())).join(last, "path").withColumn("end_line", F.coalesce(F.col("_next") - 1, F.col("_last"))).drop("_next", "_last")


def jcl_entities(files: DataFrame) -> DataFrame:
    """path, line, type (job, step, dataset), name, owner, target of job control: EXEC gives steps with their program or procedure, DD gives
    dataset uses of the step above."""
    l = lines(files).where(~F.col("text").startswith("//*") & F.col("text").startswith("//"))
    l = l.withColumn("name", part(r"^//([A-Z0-9@#$]+) ")).withColumn("op", part(r"^//[A-Z0-9@#$]* +(JOB|EXEC|DD|PROC)\b")).where("op is not null")
    l = l.withColumn("job", owner_when("op = 'JOB'")).withColumn("step", owner_when("op = 'EXEC'"))
    kind = F.when(F.col("op") == "EXEC", "step").when(F.col("op") == "DD", "dataset").otherwise(F.lower("op"))
    target = F.when(F.col("op") == "EXEC", F.coalesce(part(r"PGM=([A-Z0-9@#$]+)"), part(r"EXEC +(?:PROC=)?([A-Z0-9@#$]+)"))).when(F.col("op") == "DD", part(r"DSN=([A-Z0-9.@#$&]+)"))
    return l.select("path", "line", kind.alias("type"), "name", F.when(F.col("op") == "DD", F.col("step")).when(F.col("op") == "EXEC", F.col("job")).alias("owner"), target.alias("target"))


def owner_when(condition: str) -> Column:
    return F.last(F.when(F.expr(condition), F.col("name")), ignorenulls=True).over(so_far())


def logical_lines(files: DataFrame) -> DataFrame:
    """path, line, end_line, text of fixed-format programs: comments left out, lines continued by `-` in column 7 joined to the line above; a continued
    literal goes on after its opening quote. Text is columns 8 to 72."""
    code = lines(dealt(files)).withColumn("mark", F.substring("text", 7, 1)).where(F.col("mark").isin("", " ", "-", "D", "d"))
    code = code.withColumn("nr", F.sum(F.when(F.col("mark") == "-", 0).otherwise(1)).over(so_far()))
    body = F.substring("text", 8, 65)
    piece = F.when(F.col("mark") == "-", F.regexp_replace(body, r"""^\s+['"]?""", "")).otherwise(body)
    whole = code.withColumn("piece", piece).groupBy("path", "nr").agg(F.min("line").alias("line"), F.max("line").alias("end_line"), F.array_sort(F.collect_list(F.struct("line", "piece"))).alias("ps"))
    return whole.select("path", "line", "end_line", F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("text"))


def cobol_code(files: DataFrame) -> DataFrame:
    """Lines of fixed-format programs without sequence numbers and comments: path, line, text in upper case."""
    return lines(files).where(F.substring("text", 7, 1).isin("", " ", "-")).withColumn("text", F.upper(F.substring("text", 8, 65)))


def cobol_units(files: DataFrame) -> DataFrame:
    """path, line, end_line, type (division, section, paragraph), name; paragraphs only in the procedure division."""
    code = cobol_code(files)
    code = code.withColumn("division", part(r"^([A-Z]+) +DIVISION")).withColumn("section", part(r"^([A-Z0-9-]+) +SECTION *\."))
    code = code.withColumn("inside", F.last("division", ignorenulls=True).over(so_far())).withColumn("paragraph", F.when((F.col("inside") == "PROCEDURE") & F.col("division").isNull(), part(r"^([A-Z0-9-]+) *\. *$")))
    heads = code.select("path", "line", F.when(F.col("division").isNotNull(), "division").when(F.col("section").isNotNull(), "section").when(F.col("paragraph").isNotNull(), "paragraph").alias("type"), F.coalesce("division", "section", "paragraph").alias("name"))
    return ranged(heads.where("type is not null"), lines(files))


def cobol_edges(files: DataFrame) -> DataFrame:
    """path, line, src (paragraph, or null above the first), type (PERFORM, CALL, GOTO, COPY), dst_name, resolution: all such statements of each logical line; calls by a
    data name are dynamic."""
    code = logical_lines(files).withColumn("text", F.regexp_replace(F.upper("text"), r"(?<!['A-Z])\*>.*$", ""))
    para = F.when(F.col("text").rlike(r"^[A-Z0-9-]+ *\. *$"), part(r"^([A-Z0-9-]+) *\."))
    code = code.withColumn("src", F.last(para, ignorenulls=True).over(so_far()))
    shapes = [("PERFORM", r"\bPERFORM +([A-Z0-9]+(?:-[A-Z0-9]+)+|[A-Z0-9-]+)(?= *(?:\.|THRU|UNTIL|$))"), ("CALL", r"\bCALL +('[^']+'|\"[^\"]+\"|[A-Z0-9-]+)"), ("GOTO", r"\bGO +TO +([A-Z0-9-]+)"), ("COPY", r"\bCOPY +([A-Z0-9-]+)")]
    tagged = lambda t, names: F.transform(names, lambda n: F.struct(F.lit(t).alias("type"), n.alias("name")))
    found = F.concat(*[tagged(t, F.regexp_extract_all("text", F.lit(p), F.lit(1))) for t, p in shapes])  # every match of a line
    hits = code.select("path", "line", "src", F.explode(found).alias("f"))
    name = F.regexp_replace("f.name", "['\"]", "")
    dynamic = (F.col("f.type") == "CALL") & ~F.col("f.name").rlike("^['\"]")
    return hits.select("path", "line", "src", F.col("f.type").alias("type"), name.alias("dst_name"), F.when(dynamic, "dynamic").otherwise("unresolved").alias("resolution"))


def local_targets(edges: DataFrame, units: DataFrame) -> DataFrame:
    """edges with dst_line: PERFORM and GO TO find the only paragraph or section of that name in the same file."""
    held = units.where("type <> 'division'").groupBy("path", F.col("name").alias("dst_name")).agg(F.min("line").alias("dst_line"), F.count("*").alias("n")).where("n = 1").drop("n")
    local = F.col("type").isin("PERFORM", "GOTO")
    met = edges.join(held, ["path", "dst_name"], "left").withColumn("dst_line", F.when(local, F.col("dst_line")))
    return met.withColumn("resolution", F.when(F.col("dst_line").isNotNull(), "resolved").otherwise(F.col("resolution")))


def sql_statements(files: DataFrame) -> DataFrame:
    """path, nr, verb, object, tables of the statements between semicolons. Comments are left out and literals emptied first, in one pass
    from the left, so that what stands in either is no statement's end."""
    clean = F.regexp_replace(F.regexp_replace("content", r"(?s)('(?:[^']|'')*')|/\*.*?\*/|--[^\n]*", "$1 "), r"'(?:[^']|'')*'", "''")
    s = files.select("path", F.posexplode(F.filter(F.split(clean, ";"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")).alias("nr", "raw"))
    s = s.withColumn("text", F.upper(F.trim(F.regexp_replace("raw", r"\s+", " "))))
    tables = F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:FROM|JOIN|INTO|UPDATE|TABLE) ([A-Z_][A-Z0-9_.]*)"), F.lit(1))), ",")
    return s.select("path", "nr", part(r"^([A-Z]+)").alias("verb"), part(r"^CREATE (?:OR REPLACE )?(?:TABLE|VIEW|INDEX|PROCEDURE) ([A-Z_][A-Z0-9_.]*)").alias("object"), tables.alias("tables"))


def shell_facts(files: DataFrame) -> DataFrame:
    """path, line, type (function, sources, starts_java), name of shell scripts."""
    shapes = [("function", r"^\s*(?:function +)?([A-Za-z_][A-Za-z0-9_]*) *\(\) *\{?"), ("sources", r"^\s*(?:\.|source) +([A-Za-z0-9_./-]+)"), ("starts_java", r"\bjava +(?:-(?:cp|classpath) +[^ ]+ +|-[^ ]+ +)*([A-Za-z_][A-Za-z0-9_.]*)")]
    found = F.filter(F.array(*[F.struct(F.lit(t).alias("type"), part(p).alias("name")) for t, p in shapes]), lambda x: x["name"].isNotNull())
    return lines(files).where(~F.col("text").rlike(r"^\s*#")).select("path", "line", F.explode(found).alias("f")).select("path", "line", "f.type", "f.name")


def csd_files(files: DataFrame) -> DataFrame:
    """path, name, dataset of DEFINE FILE entries; an entry runs to the next DEFINE."""
    entry = files.select("path", F.explode(F.split("content", r"(?=\bDEFINE )")).alias("text"))
    return entry.select("path", part(r"DEFINE +FILE\(([A-Z0-9@#$]+)\)").alias("name"), part(r"DSNAME\(([A-Z0-9.@#$]+)\)").alias("dataset")).where("name is not null")


def poms(files: DataFrame) -> DataFrame:
    """path, artifact, group, dependency: one row for each dependency of a project file, by XPath."""
    one = lambda q: F.xpath_string("content", F.lit(q))
    deps = F.arrays_zip(F.xpath("content", F.lit("/project/dependencies/dependency/groupId/text()")).alias("g"), F.xpath("content", F.lit("/project/dependencies/dependency/artifactId/text()")).alias("a"))
    group = F.coalesce(F.nullif(one("/project/groupId"), F.lit("")), one("/project/parent/groupId"))
    # a file is parsed before its rows are made, not again for each of them
    parsed = files.select("path", one("/project/artifactId").alias("artifact"), group.alias("group"), deps.alias("ds"))
    return parsed.select("path", "artifact", "group", F.explode_outer("ds").alias("d")).select("path", "artifact", "group", F.concat_ws(":", "d.g", "d.a").alias("dependency"))


def dataset_assignments(steps: DataFrame, dds: DataFrame, fds: DataFrame) -> DataFrame:
    """program, file, dataset: a program's file has a dataset if every step that runs it gives its DD name the same one.
    steps: path, step, program; dds: path, step, dd, dataset; fds: program, file, dd."""
    met = fds.join(steps, "program").join(dds, ["path", "step", "dd"])
    return met.groupBy("program", "file").agg(F.min("dataset").alias("dataset"), F.max("dataset").alias("_most")).where("dataset = _most").drop("_most")

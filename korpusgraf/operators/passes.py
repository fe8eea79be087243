"""Resolution passes of single languages: each is an order of stages, and the first stage with any candidate decides.

A stage is a table of candidates and the columns on which references and candidates meet. One target there resolves the reference;
several leave it open, and no later stage narrows them down. References whose key is null pass on to the next stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = tuple[DataFrame, list[str]]


def resolve_staged(refs: DataFrame, stages: list[Stage]) -> DataFrame:
    """refs with target_id (null: open) and stage (that which decided; null: none had a candidate). Candidates: their keys and target_id; they are counted
    before the shuffle, so a frequent name costs one row a task."""
    out, decided = refs, F.lit(None)
    for i, (candidates, keys) in enumerate(stages):
        per = candidates.groupBy(*keys).agg(F.min("target_id").alias(f"_a{i}"), F.max("target_id").alias(f"_b{i}"))
        out = out.join(per, keys, "left")
    for i in reversed(range(len(stages))):
        decided = F.when(F.col(f"_a{i}").isNotNull(), F.lit(i)).otherwise(decided)
    target = F.lit(None)
    for i in reversed(range(len(stages))):
        target = F.when(F.col(f"_a{i}").isNotNull(), F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}"))).otherwise(target)
    return out.select(*refs.columns, target.alias("target_id"), decided.cast("int").alias("stage"))


def normal_path(base: Column, link: Column) -> Column:
    """A link's path: from the root if it begins with `/`, else from the folder of `base`; `.` and `..` are walked. Null where it leaves the root
    or holds an expression."""
    folder = F.slice(F.split(base, "/"), F.lit(1), F.size(F.split(base, "/")) - 1)
    parts = F.when(link.startswith("/"), F.split(F.substring(link, F.lit(2), F.length(link)), "/")).otherwise(F.concat(folder, F.split(link, "/")))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))

    def step(acc: Column, p: Column) -> Column:
        up, n = p == "..", F.size(acc["at"])
        at = F.when(up, F.slice(acc["at"], F.lit(1), F.greatest(n - 1, F.lit(0)))).when((p == ".") | (p == ""), acc["at"]).otherwise(F.concat(acc["at"], F.array(p)))
        return F.struct(at.alias("at"), (acc["inside"] & ~(up & (n == 0))).alias("inside"))

    walked = F.aggregate(parts, start, step, lambda acc: F.when(acc["inside"], F.array_join(acc["at"], "/")))
    return F.when(~link.rlike(r"[$#]\{|<%|^[a-z]+:"), walked)


def markup_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links of JSP and HTML files (ref_id, source_id, path, link) to the file of that path in the same source (files: source_id, path, target_id)."""
    return resolve_staged(links.withColumn("path", normal_path(F.col("path"), F.col("link"))), [(files, ["source_id", "path"])])


def shell_targets(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """ref_id, target_id (null: open) of references in shell scripts (ref_id, source_id, variant, path, name, kind, type): within the same source and variant the only entity of that
    type (any, if null) in the file that the script's link names, or for a started Java class (kind starts_java) of that qualified name. Class names and links that leave the source or hold
    expressions stay open. entities: source_id, variant, path, qualified_name, type, target_id."""
    java = F.col("kind") == "starts_java"
    asked = refs.select("ref_id", "source_id", "variant", F.col("type").alias("wanted"), F.when(~java, normal_path(F.col("path"), F.col("name"))).alias("path"), F.when(java, F.col("name")).alias("qualified_name"))
    found = None
    for key in ("path", "qualified_name"):
        per = entities.groupBy("source_id", "variant", key, "type").agg(F.min("target_id").alias("a"), F.max("target_id").alias("b"))
        met = asked.where(F.col(key).isNotNull()).join(per, ["source_id", "variant", key]).where("wanted is null or type = wanted").select("ref_id", "a", "b")
        found = met if found is None else found.union(met)
    one = found.groupBy("ref_id").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a = b").select("ref_id", F.col("a").alias("target_id"))
    return refs.select("ref_id").join(one, "ref_id", "left")


#: Endings of files that hold one catalogued procedure.
PROC_FILE = r"(?i)\.(prc|proc)$"


def job_targets(steps: DataFrame, programs: DataFrame, procs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target_id (null: open) and by (program, label, own_file, member, member_file: what decided) of EXEC steps (ref_id, source_id, variant, path, kind: PGM or PROC, name).

    Names count in upper case, within the step's source and variant. A program needs one of its name. A procedure's label decides; of several, those in the step's own file if any (a
    procedure file has no in-stream procedures), else those in a file of the procedure's name; without a label the procedure file of that name. programs: source_id, variant, name,
    target_id; procs: the same and path, name being the label; files: source_id, variant, path, target_id."""
    scope = ["source_id", "variant", "name"]
    stem = lambda path: F.upper(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))
    ends = lambda df, keys, name: df.groupBy(*keys).agg(F.min("target_id").alias(f"{name}_a"), F.max("target_id").alias(f"{name}_b"))
    asked = steps.withColumn("name", F.upper("name"))
    label = procs.withColumn("name", F.upper("name"))
    member = files.where(F.col("path").rlike(PROC_FILE)).withColumn("name", stem("path"))
    met = asked.join(ends(programs.withColumn("name", F.upper("name")), scope, "program"), scope, "left").join(ends(label, scope, "label"), scope, "left").join(ends(label, [*scope, "path"], "own"), [*scope, "path"], "left")
    met = met.join(ends(label.where(F.col("name") == stem("path")), scope, "member"), scope, "left").join(ends(member, scope, "file"), scope, "left")
    proc, one = F.col("kind") == "PROC", lambda n: F.when(F.col(f"{n}_a") == F.col(f"{n}_b"), F.col(f"{n}_a"))
    by = (
        F.when(~proc, F.when(F.col("program_a").isNotNull(), "program")).when(F.col("label_a") == F.col("label_b"), "label").when(F.col("label_a").isNull(), F.when(F.col("file_a").isNotNull(), "member_file"))
        .when(F.col("own_a").isNotNull() & ~F.col("path").rlike(PROC_FILE), "own_file").when(F.col("member_a").isNotNull(), "member")
    )
    met = met.withColumn("by", by)
    target = F.when(F.col("by") == "program", one("program")).when(F.col("by") == "label", one("label")).when(F.col("by") == "own_file", one("own")).when(F.col("by") == "member", one("member")).when(F.col("by") == "member_file", one("file"))
    return met.select("ref_id", target.alias("target_id"), "by")


def project_targets(refs: DataFrame, declared: DataFrame, projects: DataFrame) -> DataFrame:
    """Dependencies of project files (ref_id, path, coordinates, module_path): the declaration of that name in the same file; and
    internal_project, the project that alone has these coordinates or this path. declared: path, coordinates, target_id; projects: project, coordinates, path."""
    own = resolve_staged(refs.select("ref_id", "path", "coordinates", "module_path"), [(declared, ["path", "coordinates"])]).drop("stage")
    at = projects.select("coordinates", F.col("project").alias("target_id"))
    by_path = projects.select(F.col("path").alias("module_path"), F.col("project").alias("target_id"))
    found = resolve_staged(own.withColumnRenamed("target_id", "declaration"), [(at, ["coordinates"]), (by_path, ["module_path"])])
    return found.select("ref_id", F.col("declaration").alias("target_id"), F.col("target_id").alias("internal_project"))


def documentation_targets(mentions: DataFrame, objects: DataFrame, files: DataFrame) -> DataFrame:
    """Mentions in documents (ref_id, token): the code object of that qualified name, else the only one of that name, else the file of that path or name.
    objects: qualified_name, name, target_id; files: path, target_id."""
    keyed = mentions.select("ref_id", F.col("token").alias("qualified_name"), F.col("token").alias("name"), F.col("token").alias("path"), F.when(~F.contains("token", F.lit("/")), F.col("token")).alias("tail"))
    tails = files.select(F.substring_index("path", "/", -1).alias("tail"), "target_id")
    stages = [(objects.select("qualified_name", "target_id"), ["qualified_name"]), (objects.select("name", "target_id"), ["name"]), (files, ["path"]), (tails, ["tail"])]
    return resolve_staged(keyed, stages).select("ref_id", "target_id", "stage")


def schema_targets(refs: DataFrame, declarations: DataFrame) -> DataFrame:
    """QName references (ref_id, variant, kind, prefix, local, namespaces: map of the file's prefixes) to the declaration of that kind, namespace and local name in
    the same variant. A prefix without a namespace stays open. declarations: variant, kind, namespace, local, target_id."""
    keyed = refs.withColumn("namespace", F.try_element_at("namespaces", F.coalesce("prefix", F.lit("")))).drop("namespaces", "prefix")
    return resolve_staged(keyed, [(declarations, ["variant", "kind", "namespace", "local"])]).select("ref_id", "target_id", "stage")


def map_targets(refs: DataFrame, maps: DataFrame) -> DataFrame:
    """Screen maps (ref_id, variant, map, mapset or null) by name, and mapset where one is given, in the variant, else in the default one (''). maps: variant, mapset,
    map, target_id."""
    up = lambda df: df.withColumn("map", F.upper("map")).withColumn("mapset", F.upper("mapset"))
    r, m = up(refs), up(maps)
    r = r.select("ref_id", "variant", "map", "mapset", F.lit("").alias("fallback"), F.when(F.col("mapset").isNull(), F.col("map")).alias("bare"))
    bare, default = m.select("variant", F.col("map").alias("bare"), "target_id"), m.where("variant = ''").withColumnRenamed("variant", "fallback")
    stages = [(m, ["variant", "map", "mapset"]), (bare, ["variant", "bare"]), (default, ["fallback", "map", "mapset"]), (default.select("fallback", F.col("map").alias("bare"), "target_id"), ["fallback", "bare"])]
    return resolve_staged(r, stages).select("ref_id", "target_id", "stage")


def stylesheet_targets(refs: DataFrame, templates: DataFrame, files: DataFrame) -> DataFrame:
    """Stylesheet references (ref_id, variant, qualified_name, path, name, match, mode; null where not given) in the same variant: by qualified name, else file
    path, else template name, else match and mode. templates: the same columns but path, and target_id; files: variant, path, target_id."""
    by = lambda *keys: (templates.select("variant", *keys, "target_id"), ["variant", *keys])
    return resolve_staged(refs, [by("qualified_name"), (files, ["variant", "path"]), by("name"), by("match", "mode")]).select("ref_id", "target_id", "stage")


def program_targets(refs: DataFrame, units: DataFrame) -> DataFrame:
    """CALL and COPY references (ref_id, variant, type, name, path or null) by variant, kind and upper name, a COPY without its extension; where a COPY names a
    path, the candidates on that path come first. units: variant, kind (program, copybook), name, path, target_id."""
    copy = F.col("type") == "COPY"
    name = F.upper(F.when(copy, F.regexp_replace("name", r"\.[A-Za-z]+$", "")).otherwise(F.col("name")))
    keyed = refs.select("ref_id", "variant", F.when(copy, "copybook").otherwise("program").alias("kind"), name.alias("key"), F.when(copy, F.col("path")).alias("path"))
    held = units.select("variant", "kind", F.upper("name").alias("key"), "path", "target_id")
    return resolve_staged(keyed, [(held, ["variant", "kind", "key", "path"]), (held, ["variant", "kind", "key"])]).select("ref_id", "target_id", "stage")


def resource_targets(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, target_id, reason of resource names (ref_id, module, name or null for an expression), looked up below the class path root of the own module. files:
    module, path (from that root), target_id."""
    path = F.when(F.col("name").startswith("/"), F.expr("substring(name, 2)")).otherwise(F.col("name"))
    met = resolve_staged(refs.withColumn("path", path), [(files, ["module", "path"])])
    reason = F.when(F.col("name").isNull(), "dynamic_resource_expression").when(F.col("target_id").isNotNull(), "exact_resource_target").when(F.col("stage").isNotNull(), "ambiguous_resource_target").otherwise("resource_target_not_found")
    return met.select("ref_id", "target_id", reason.alias("reason"))


def property_targets(refs: DataFrame, keys: DataFrame, active: list[str]) -> DataFrame:
    """ref_id, target_id of property keys (ref_id, module, component, key). Only keys of no profile or an active one count. Those of the own module
    come before the project's, of these those of a profile before the plain ones, and then those of the reference's component; still several stay open.
    keys: module, component, profile or null, key, target_id."""
    held = keys.where(F.col("profile").isNull() | F.col("profile").isin(active)).withColumn("special", F.col("profile").isNotNull())
    r = refs.select("ref_id", F.col("module").alias("m"), F.col("component").alias("c"), "key")
    # One row for each key and scope with how many candidates it has, by profile and component.
    scope = held.groupBy("key", F.col("module").alias("m"), "special", F.col("component").alias("c")).agg(F.min("target_id").alias("a"), F.max("target_id").alias("b"))
    own, every = _widened(r, scope, ["key", "m"]), _widened(r, scope.drop("m"), ["key"])
    best = F.coalesce("own", "every")
    met = r.join(own.withColumnRenamed("found", "own"), "ref_id", "left").join(every.withColumnRenamed("found", "every"), "ref_id", "left")
    return met.select("ref_id", best["t"].alias("target_id"))


def _widened(refs: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """ref_id, found (struct of t): the choice among a scope's candidates; t is null where several are left. Refs without a candidate are missing."""
    by = scope.groupBy(*keys).agg(F.max("special").alias("special"))
    level = scope.join(by, [*keys, "special"])
    whole = level.groupBy(*keys).agg(F.min("a").alias("wa"), F.max("b").alias("wb"))
    part = level.groupBy(*keys, "c").agg(F.min("a").alias("pa"), F.max("b").alias("pb"))
    met = refs.join(whole, keys).join(part, [*keys, "c"], "left")
    t = F.when(F.col("wa") == F.col("wb"), F.col("wa")).when(F.col("pa") == F.col("pb"), F.col("pa"))
    return met.select("ref_id", F.struct(t.alias("t")).alias("found"))


def injection_targets(points: DataFrame, beans: DataFrame, realises: DataFrame) -> DataFrame:
    """ref_id, target_id of injection points (ref_id, type, qualifier or null, name or null): the only bean of that type, or of a type that realises it, with the
    qualifier if one is given; without one the only bean, else that of the point's name. beans: type, qualifier or null, name, target_id; realises: sub, super."""
    of = beans.select(F.col("type").alias("sub"), "qualifier", "name", "target_id").join(realises, "sub").select(F.col("super").alias("type"), "qualifier", "name", "target_id")
    held = beans.select("type", "qualifier", "name", "target_id").union(of).distinct()
    keyed = points.select("ref_id", F.when(F.col("qualifier").isNotNull(), F.col("type")).alias("qualified"), "qualifier", F.when(F.col("qualifier").isNull(), F.col("type")).alias("type"), "name")
    first = resolve_staged(keyed, [(held.withColumnRenamed("type", "qualified").select("qualified", "qualifier", "target_id"), ["qualified", "qualifier"]), (held.select("type", "target_id"), ["type"])])
    named = resolve_staged(keyed.select("ref_id", "type", "name"), [(held.select("type", "name", "target_id"), ["type", "name"])]).select("ref_id", F.col("target_id").alias("by_name"))
    return first.join(named, "ref_id").select("ref_id", F.coalesce("target_id", "by_name").alias("target_id"))


def receiver_types(calls: DataFrame, variables: DataFrame, fields: DataFrame, returns: DataFrame) -> DataFrame:
    """call_id, type (null: open) of a call's receiver (call_id, method, class, receiver): a variable of the method, else a field of the class, else, for a
    receiver `name()`, what the class's method of that name returns; generics are cut. The first of these that knows the name decides. variables: method, name, type;
    fields: class, name, type; returns: class, name, type."""
    simple = lambda df, key, on: df.select(F.col(key), F.col("name").alias(on), F.regexp_replace("type", r"<.*", "").alias("target_id"))
    called = F.regexp_extract("receiver", r"^(\w+)\(\)$", 1)
    keyed = calls.select(F.col("call_id").alias("ref_id"), "method", "class", F.col("receiver").alias("name"), F.nullif(called, F.lit("")).alias("called"))
    stages = [(simple(variables, "method", "name"), ["method", "name"]), (simple(fields, "class", "name"), ["class", "name"]), (simple(returns, "class", "called"), ["class", "called"])]
    return resolve_staged(keyed, stages).select(F.col("ref_id").alias("call_id"), F.col("target_id").alias("type"))


def binding_targets(classes: DataFrame, declarations: DataFrame) -> DataFrame:
    """ref_id, target_id of bound classes (ref_id, namespace, name, is_root): an element of that namespace and name for a root class, else, and where there is no such
    element, the type. declarations: namespace, name, kind (element, type), target_id."""
    keyed = classes.select("ref_id", "namespace", F.when(F.col("is_root"), F.col("name")).alias("element"), F.col("name").alias("type"))
    of = lambda kind: declarations.where(F.col("kind") == kind).select("namespace", F.col("name").alias(kind), "target_id")
    return resolve_staged(keyed, [(of("element"), ["namespace", "element"]), (of("type"), ["namespace", "type"])]).select("ref_id", "target_id", "stage")


def rederived(edges: DataFrame, derived: DataFrame, kinds: list[str]) -> DataFrame:
    """src_id, dst_id, type: edges with those of the derived kinds replaced by what holds now (derived: src_id, dst_id, type), so that a second run changes nothing."""
    kept = edges.where(~F.col("type").isin(kinds)).select("src_id", "dst_id", "type")
    return kept.union(derived.where(F.col("type").isin(kinds)).select("src_id", "dst_id", "type").distinct())


def lambda_targets(calls: DataFrame, assignments: DataFrame) -> DataFrame:
    """call_id, target_id: calls of a local variable (call_id, method, name, line) that has been given one lambda before and nothing else anywhere in its
    method. assignments: method, name, line, lambda_id (null: another value)."""
    one = assignments.groupBy("method", "name").agg(F.count("*").alias("n"), F.min("lambda_id").alias("target_id"), F.min("line").alias("at")).where("n = 1 and target_id is not null")
    return calls.join(one, ["method", "name"]).where("line > at").select("call_id", "target_id")


def upserted(old: DataFrame, parsed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """key, id, action: what a parse of files makes of their stored entities. A qualified name keeps its id (update), a new one gets its digest (insert), one that is no
    longer parsed goes (delete); files that weren't parsed don't change. Of repeated names the first by line counts. old: path, key, id; parsed: path, key, line; files: path of all that were parsed, also those that
    hold no entity now; unless given, the paths in parsed."""
    one = parsed.groupBy("path", "key").agg(F.min("line").alias("line"))
    touched = (parsed if files is None else files).select("path").distinct()
    met = old.join(touched, "path", "left_semi").join(one, ["path", "key"], "full")
    action = F.when(F.col("id").isNull(), "insert").when(F.col("line").isNull(), "delete").otherwise("update")
    return met.select("path", "key", F.coalesce("id", F.sha1(F.concat_ws("\n", "path", "key"))).alias("id"), action.alias("action"))

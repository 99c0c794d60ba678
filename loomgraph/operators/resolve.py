"""Reference resolution as joins: a pure function of (files, nodes, imports, refs).

Imports become ordered candidate paths that meet the file list in one equi join (the first that exists wins). References
then pass five left joins, each against a side already reduced to one row for each key, and coalesce takes the first hit: proven (EXACT) through an
imported receiver, an imported name or the same file, else a guess (INFERRED) by the best definition of that name anywhere, else a runtime built-in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import dirname, normalize_relative
from loomgraph.operators.shared import written
from loomgraph.packs import builtins as B

SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs"]
PYTHON_ROOTS = ["", "src/", "lib/", "app/"]
JAVA_ROOTS = ["src/main/java/", "src/test/java/", "src/main/kotlin/", "src/", ""]


def walk_order(path: Column) -> Column:
    """Sort key of a path in walk order: in each directory, directories first, then files, by bytes."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.array_join(F.transform(parts, lambda s, i: F.concat(F.when(i < n - 1, "0").otherwise("1"), s)), "\x01")


def _with(bases: Column, endings: Sequence[str]) -> Column:
    """Every base with every ending, base by base."""
    return F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(e)) for e in endings])))


def _arr(*items) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in items])


def _parent(base: Column) -> Column:
    return F.when(F.contains(base, F.lit("/")), F.regexp_replace(base, "/[^/]*$", ""))


def script_candidates(spec: Column, from_path: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Relative specifiers, then path aliases (longest prefix first, all targets)."""
    bases = F.when(F.startswith(spec, F.lit(".")), _arr(normalize_relative(from_path, spec)))
    mapped = [F.when(F.startswith(spec, F.lit(p)), _arr(*[F.concat(F.lit(t), F.substring(spec, len(p) + 1, 1 << 20)) for t in aliases[p]])).otherwise(F.array().cast("array<string>")) for p in sorted(aliases, key=lambda p: (-len(p), p))]
    bases = bases.otherwise(F.flatten(F.array(*mapped)) if mapped else F.array().cast("array<string>"))
    return F.flatten(F.transform(bases, lambda b: F.concat(_with(F.array(b), SCRIPT_ENDINGS), _with(F.array(F.concat(b, F.lit("/index"))), SCRIPT_ENDINGS))))


def python_candidates(spec: Column, from_path: Column) -> Column:
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    rest = F.filter(F.split(F.regexp_replace(spec, r"^\.+", ""), r"\."), lambda s: s != "")
    dirs = F.filter(F.split(dirname(from_path), "/"), lambda s: s != "")
    up = F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - dots + 1, F.lit(0)))
    near = F.array(F.array_join(F.concat(up, rest), "/"))
    flat = F.array_join(rest, "/")
    bases = F.when(dots > 0, near).otherwise(F.array(*[F.concat(F.lit(r), flat) for r in PYTHON_ROOTS]))

    def shapes(b):
        p = _parent(b)
        return F.filter(F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")), F.concat(b, F.lit(".pyi")), F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py"))), lambda x: x.isNotNull())

    return F.flatten(F.transform(bases, shapes))


def rust_candidates(spec: Column, from_path: Column) -> Column:
    segs = F.filter(F.transform(F.split(spec, "::"), F.trim), lambda s: s != "")
    head, rest = F.get(segs, F.lit(0)), F.array_join(F.slice(segs, F.lit(2), F.greatest(F.size(segs) - 1, F.lit(0))), "/")
    root = F.when(F.startswith(from_path, F.lit("src/")) | (head == "crate"), "src").otherwise(dirname(from_path))
    inside = F.array(F.concat_ws("/", root, F.when(rest != "", rest)))
    around = F.array(F.concat_ws("/", F.when(dirname(from_path) != "", dirname(from_path)), head), F.concat(F.lit("src/"), head))
    bases = F.when(head.isin("crate", "self", "super"), inside).otherwise(around)

    def shapes(b):
        p = _parent(b)
        return F.filter(F.array(F.concat(b, F.lit(".rs")), F.concat(b, F.lit("/mod.rs")), F.concat(b, F.lit("/lib.rs")), F.concat(p, F.lit(".rs")), F.concat(p, F.lit("/mod.rs"))), lambda x: x.isNotNull())

    return F.flatten(F.transform(bases, shapes))


def java_candidates(spec: Column) -> Column:
    flat = F.replace(spec, F.lit("."), F.lit("/"))
    outer = _parent(flat)
    return F.filter(F.array(*[F.concat(F.lit(r), x, F.lit(".java")) for x in (flat, outer) for r in JAVA_ROOTS]), lambda x: x.isNotNull())


def csharp_candidates(spec: Column) -> Column:
    """Declared namespaces: the whole name, then ever shorter dotted prefixes. Keys carry an 'ns:' mark."""
    segs = F.split(F.trim(spec), r"\.")
    n = F.size(segs)
    return F.transform(F.sequence(n, F.lit(1)), lambda k: F.concat(F.lit("ns:"), F.array_join(F.slice(segs, F.lit(1), k), ".")))


def go_candidates(spec: Column, module: str | None) -> Column:
    """The package's directory below the module; keys carry a 'dir:' mark."""
    if not module:
        return F.array().cast("array<string>")
    rel = F.regexp_replace(F.substring(spec, len(module) + 1, 1 << 20), "^/", "")
    return F.when(F.startswith(spec, F.lit(module)), F.array(F.concat(F.lit("dir:"), rel))).otherwise(F.array().cast("array<string>"))


def import_candidates(lang: Column, spec: Column, from_path: Column, aliases: Mapping[str, Sequence[str]] | None = None, go_module: str | None = None) -> Column:
    """Ordered keys of the file list that a specifier may mean; none for languages without imports."""
    std = F.split_part(spec, F.lit("."), F.lit(1)).isin(*B.PYTHON_STDLIB)
    return (
        F.when(lang.isin("typescript", "tsx", "javascript"), script_candidates(spec, from_path, aliases or {}))
        .when((lang == "python") & std, F.array().cast("array<string>"))
        .when(lang == "python", python_candidates(spec, from_path))
        .when(lang == "rust", rust_candidates(spec, from_path))
        .when(lang == "java", java_candidates(spec))
        .when(lang == "csharp", csharp_candidates(spec))
        .when(lang == "go", go_candidates(spec, go_module))
        .otherwise(F.array().cast("array<string>"))
    )


def external_of(lang: Column, spec: Column) -> Column:
    """struct(ecosystem, package) of a specifier that names no file; null where it can't be external."""
    seg = lambda d, n: F.array_join(F.slice(F.split(spec, d), 1, n), d.replace("\\", ""))
    pair = lambda e, p: F.struct((F.lit(e) if isinstance(e, str) else e).alias("ecosystem"), p.alias("package"))
    node = F.startswith(spec, F.lit("node:"))
    first = F.split_part(spec, F.lit("."), F.lit(1))
    crate = F.trim(F.split_part(spec, F.lit("::"), F.lit(1)))
    return (
        F.when(lang.isin("typescript", "tsx", "javascript"), F.when(F.startswith(spec, F.lit(".")), None).when(node, pair("node", F.regexp_replace(spec, "^node:", ""))).otherwise(pair("npm", F.when(F.startswith(spec, F.lit("@")), seg("/", 2)).otherwise(seg("/", 1)))))
        .when(lang == "python", F.when(F.startswith(spec, F.lit(".")), None).otherwise(pair(F.when(first.isin(*B.PYTHON_STDLIB), "python-stdlib").otherwise("pypi"), first)))
        .when(lang == "rust", F.when(crate.isin("crate", "self", "super", ""), None).otherwise(pair(F.when(crate.isin("std", "core", "alloc"), "rust-std").otherwise("cargo"), crate)))
        .when(lang == "java", F.when(F.rlike(spec, F.lit(r"^javax?\.")), pair("jdk", seg(r"\.", 2))).otherwise(pair("maven", seg(r"\.", 3))))
        .when(lang == "csharp", pair(F.when(first.isin("System", "Microsoft"), "dotnet").otherwise("nuget"), seg(r"\.", 2)))
        .when(lang == "go", F.when(F.contains(F.split_part(spec, F.lit("/"), F.lit(1)), F.lit(".")), pair("go", seg("/", 3))).otherwise(pair("go-stdlib", spec)))
    )


def file_keys(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(key, file_id): paths, 'dir:' keys of Go packages and 'ns:' keys of declared namespaces; the first in walk order has the key."""
    order = walk_order(F.col("path"))
    out = files.select(F.col("path").alias("key"), F.col("id").alias("file_id"))
    go = files.where(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go")))
    out = out.unionByName(go.groupBy(F.concat(F.lit("dir:"), dirname(F.col("path"))).alias("key")).agg(F.min_by("id", order).alias("file_id")))
    if nodes is not None:
        spaces = nodes.where("kind = 'module' and parent_id is not null").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
        out = out.unionByName(spaces.groupBy(F.concat(F.lit("ns:"), "name").alias("key")).agg(F.min_by("file_id", F.struct(order, F.col("ordinal"))).alias("file_id")))
    return out


def resolve_imports(imports: DataFrame, files: DataFrame, nodes: DataFrame | None = None, aliases=None, go_module: str | None = None) -> DataFrame:
    """Imports with resolved_file_id, or ecosystem and package of what is outside; neither where a specifier fits nothing."""
    base = imports.drop("resolved_file_id", "external_id").join(files.select(F.col("id").alias("file_id"), F.col("path").alias("_path"), F.col("lang").alias("_lang")), "file_id")
    want = base.select("id", F.posexplode(import_candidates(F.col("_lang"), F.col("spec"), F.col("_path"), aliases, go_module)).alias("ord", "key"))
    hit = want.join(file_keys(files, nodes).withColumnRenamed("file_id", "_target"), "key").groupBy("id").agg(F.min_by("_target", "ord").alias("resolved_file_id"))
    ext = F.when(F.col("resolved_file_id").isNull(), external_of(F.col("_lang"), F.col("spec")))
    return base.join(hit, "id", "left").withColumn("_ext", ext).withColumns({"ecosystem": F.col("_ext.ecosystem"), "package": F.col("_ext.package")}).drop("_ext", "_path", "_lang")


def external_id(ecosystem: Column, package: Column, symbol: Column) -> Column:
    return F.xxhash64(F.lit("external"), ecosystem, package, F.coalesce(symbol, F.lit("")))


def first_definitions(nodes: DataFrame) -> DataFrame:
    """(file_id, name, node_id): the first definition of a name in a file."""
    return nodes.where("kind != 'module'").groupBy("file_id", "name").agg(F.min_by("id", "ordinal").alias("node_id"))


def best_definitions(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(name, any_id, call_id): the definition a name most likely means, for references and for calls.

    Exported ones first; for calls, callables first; then by rank, then in walk order."""
    n = nodes.where("kind != 'module'").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    tail = [-F.coalesce("rank", F.lit(0.0)), walk_order(F.col("path")), F.col("ordinal")]
    hidden = ~F.coalesce("is_exported", F.lit(False))
    return n.groupBy("name").agg(F.min_by("id", F.struct(hidden, *tail)).alias("any_id"), F.min_by("id", F.struct(hidden, ~F.col("kind").isin("function", "method"), *tail)).alias("call_id"))


def bindings(imports: DataFrame) -> DataFrame:
    """(file_id, binding, b): what a name bound by an import stands for; the last import of a name counts."""
    named = imports.where("coalesce(alias, symbol, '') != ''")
    return named.groupBy("file_id", F.coalesce("alias", "symbol").alias("binding")).agg(F.max_by(F.struct("resolved_file_id", "external_id", "symbol"), "ordinal").alias("b"))


def resolve(files: DataFrame, nodes: DataFrame, imports: DataFrame, refs: DataFrame, aliases=None, go_module: str | None = None) -> dict[str, DataFrame]:
    """edges, unresolved, externals, imports. A node's reference to itself gives no edge."""
    spark = files.sparkSession
    imp = resolve_imports(imports, files, nodes, aliases, go_module)
    imp = imp.withColumn("external_id", F.when(F.col("ecosystem").isNotNull(), external_id(F.col("ecosystem"), F.col("package"), F.col("symbol"))))
    imp = written(imp, "imports")
    bound = bindings(imp)
    first = first_definitions(nodes)
    r = refs.join(files.select(F.col("id").alias("file_id"), "lang"), "file_id").withColumn("root", F.trim(F.get(F.split("receiver", r"[.\[]"), F.lit(0))))
    r = r.join(bound.select("file_id", F.col("binding").alias("root"), F.col("b").alias("rb")), ["file_id", "root"], "left")
    r = r.join(bound.select("file_id", F.col("binding").alias("name"), F.col("b").alias("nb")), ["file_id", "name"], "left")
    for alias, file, name in (("via_receiver", F.col("rb.resolved_file_id"), F.col("name")), ("via_name", F.col("nb.resolved_file_id"), F.coalesce("nb.symbol", "name")), ("local", F.col("file_id"), F.col("name"))):
        side = first.select(F.col("file_id").alias("_file"), F.col("name").alias("_name"), F.col("node_id").alias(alias))
        r = r.withColumns({"_f": file, "_n": name}).join(side, (F.col("_f") == F.col("_file")) & (F.col("_n") == F.col("_name")), "left").drop("_file", "_name", "_f", "_n")
    r = r.join(best_definitions(nodes, files), "name", "left").join(F.broadcast(B.table(spark)), ["lang", "name"], "left")
    none, exact, inferred = F.lit(None).cast("bigint"), F.lit("EXACT"), F.lit("INFERRED")
    hit = lambda dst, ext, conf: F.struct(dst.alias("dst_id"), ext.alias("ext_id"), conf.alias("confidence"))
    rx, nx = F.col("rb.external_id"), F.col("nb.external_id")
    guess = F.when(F.col("kind") == "call", F.col("call_id")).otherwise(F.col("any_id"))
    native = F.col("builtin").isNotNull() & ((F.col("builtin") == "global") | F.col("receiver").isNotNull())
    native_id = external_id(F.lit("builtin"), F.col("runtime"), F.col("name"))
    target = F.coalesce(
        F.when(rx.isNotNull(), hit(none, rx, exact)),
        F.when(F.col("via_receiver").isNotNull(), hit(F.col("via_receiver"), none, exact)),
        F.when(nx.isNotNull(), hit(none, nx, exact)),
        F.when(F.col("via_name").isNotNull(), hit(F.col("via_name"), none, exact)),
        F.when(F.col("local").isNotNull(), hit(F.col("local"), none, exact)),
        F.when(guess.isNotNull(), hit(guess, none, inferred)),
        F.when(native, hit(none, native_id, exact)),
    )
    r = written(r.withColumns({"t": target, "is_native": F.coalesce(target["ext_id"] == native_id, F.lit(False))}).select("id", "file_id", "src_id", "name", "kind", "line", "t", "is_native", "runtime"), "resolved")
    edges = r.where("t is not null and not (t.dst_id <=> src_id)").select("id", "src_id", "t.dst_id", "t.ext_id", "file_id", "kind", "t.confidence", "line")
    unresolved = r.where("t is null").select("id", "file_id", "line", "name", "kind", F.lit("no-match").alias("reason"))
    known = imp.where("external_id is not null").select(F.col("external_id").alias("id"), "ecosystem", "package", F.coalesce("symbol", F.lit("")).alias("symbol"), F.lit("import").alias("source"))
    native_rows = r.where("t.ext_id is not null and is_native").select(F.col("t.ext_id").alias("id"), F.lit("builtin").alias("ecosystem"), F.col("runtime").alias("package"), F.col("name").alias("symbol"), F.lit("builtin").alias("source"))
    uses = edges.where("ext_id is not null").groupBy(F.col("ext_id").alias("id")).agg(F.count(F.lit(1)).alias("use_count"))
    externals = known.unionByName(native_rows).groupBy("id", "ecosystem", "package", "symbol").agg(F.min("source").alias("source")).join(uses, "id", "left").withColumn("use_count", F.coalesce("use_count", F.lit(0)))
    return {"edges": edges, "unresolved": unresolved, "externals": externals, "imports": imp.drop("ecosystem", "package")}


def stats(edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: edges, exact and inferred (inside the index), external, unresolved."""
    inside = F.col("dst_id").isNotNull()
    a = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(inside & (F.col("confidence") == "EXACT")).alias("exact"), F.count_if(inside & (F.col("confidence") == "INFERRED")).alias("inferred"), F.count_if(~inside).alias("external"))
    return a.crossJoin(unresolved.agg(F.count(F.lit(1)).alias("unresolved")))


def unresolved_by_reason(unresolved: DataFrame) -> DataFrame:
    return unresolved.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")

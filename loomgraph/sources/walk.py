"""Repository source: listing, ignore rules, stubs for what isn't parsed, change detection before contents are read.

One pass lists the tree, reads ignore files where it meets them and never enters ignored directories; everything else is Column expressions."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import content_hash, estimate, extension, is_binary, line_count, text_skip_reason
from loomgraph.operators.shared import written
from loomgraph.packs.languages import WITH_SYMBOLS, detect_language

IMAGES = ("avif", "bmp", "cur", "gif", "heic", "heif", "icns", "ico", "jpeg", "jpg", "png", "tif", "tiff", "webp")
IGNORED_DIRS = ("__pycache__", "build", "dist", "node_modules", "out", "target", "vendor", "venv", ".git", ".loomgraph", ".venv")
IGNORED_FILES = ("*.map", "*.min.css", "*.min.js", "Cargo.lock", "go.sum", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock")
DEFAULT_IGNORE = tuple(f"**/{d}/**" for d in IGNORED_DIRS) + tuple(f"**/{f}" for f in IGNORED_FILES)
TOOL_IGNORE = ".loomgraphignore"


@dataclass(frozen=True)
class WalkConfig:
    max_file_bytes: int = 1 << 20
    max_mean_line: int = 500
    ignore: tuple[str, ...] = DEFAULT_IGNORE
    detect_subprojects: bool = True
    disable: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


def _glob(pattern: str) -> str:
    """Body of a regular expression for a gitignore glob."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def compile_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(expression, negated, directories only) of an ignore line; None for blanks and comments."""
    text = line.rstrip("\r\n")
    if not text.strip() or text.startswith("#"):
        return None
    text = re.sub(r"(?<!\\) +$", "", text)
    negated = text.startswith("!")
    text = text[1:] if negated else text
    only_dirs = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    return re.compile(("^" if anchored else "^(?:.*/)?") + _glob(text.lstrip("/")) + "$"), negated, only_dirs


class IgnoreRules:
    """Frames of rules by directory; deeper frames and later rules override, and nothing below an ignored directory comes back."""

    def __init__(self, frames: dict[str, list[str]]):
        self.frames = [(d, [r for x in lines if (r := compile_rule(x))]) for d, lines in sorted(frames.items(), key=lambda f: (f[0].count("/") + bool(f[0]), f[0]))]
        self.known: dict[str, bool] = {}

    def hides(self, path: str, is_dir: bool) -> bool:
        """Whether the rules hide an entry of a directory that isn't ignored itself."""
        out = False
        for base, rules in self.frames:
            if base and not path.startswith(base + "/"):
                continue
            rel = path[len(base) + 1 :] if base else path
            for rx, negated, only_dirs in rules:
                if (is_dir or not only_dirs) and (rx.match(rel) or is_dir and rx.match(rel + "/")):
                    out = not negated
        return out

    def ignores(self, path: str) -> bool:
        """Whether a file is ignored, itself or by one of its directories."""
        parts = path.split("/")
        for i in range(1, len(parts)):
            d = "/".join(parts[:i])
            if d not in self.known:
                self.known[d] = self.hides(d, True)
            if self.known[d]:
                return True
        return self.hides(path, False)


def global_rules(root: str) -> list[str]:
    """Rules of .git/info/exclude and of the user's global excludes file."""
    out = []
    excludes = os.environ.get("GIT_GLOBAL_EXCLUDES")
    config = os.path.expanduser("~/.gitconfig")
    if not excludes and os.path.exists(config):
        with open(config, errors="replace") as f:
            m = re.search(r"(?im)^\s*excludesfile\s*=\s*(.+)$", f.read())
        excludes = m[1].strip() if m else None
    for at in (os.path.join(root, ".git", "info", "exclude"), os.path.expanduser(excludes) if excludes else None):
        if at and os.path.exists(at):
            with open(at, errors="replace") as f:
                out += f.read().splitlines()
    return out


FOUND = "kind string, path string, mtime bigint, size bigint"


def listing(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """FOUND: a 'file' row for every file that isn't ignored, and a 'marker' row for every directory with a ``.git`` of its own. Paths are relative with forward slashes; contents
    are not read. Symbolic links and unreadable files are left out. ``rules`` are the root's; None asks no ignore rules at all.

    One pass: ignore files are read where they are met, and ignored directories are never entered. Spark's own file index hides names that begin with a
    dot or an underscore, which repositories are full of. So the driver lists two levels, and tasks walk the directories below; ``root`` is on a file system that all executors share."""
    base = os.path.realpath(root)
    frames = {"": rules} if rules is not None else None
    top, todo = [], [("", frames)]
    for _ in range(2):
        below = []
        for d, f in todo:
            rows, dirs = _visit(base, d, f)
            top += rows
            below += dirs
        todo = below

    def run(it):
        for b in it:
            for d, f in zip(b.column("dir").to_pylist(), b.column("frames").to_pylist()):
                todo, rows = [(d, json.loads(f))], []
                while todo:
                    more, dirs = _visit(base, *todo.pop())
                    rows += more
                    todo += dirs
                    if len(rows) > 10_000 or rows and not todo:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "path", "mtime", "size"])
                        rows = []

    here = spark.createDataFrame(top, FOUND)
    if not todo:
        return here
    starts = spark.createDataFrame([(d, json.dumps(f)) for d, f in todo], "dir string, frames string")
    return here.unionByName(starts.repartition(min(len(todo), 512), "dir").mapInArrow(run, FOUND))


def _visit(base: str, directory: str, frames: dict[str, list[str]] | None) -> tuple[list[tuple], list[tuple[str, dict | None]]]:
    """FOUND rows of one directory, and its directories that aren't ignored with the rules that hold in them."""
    files, dirs, marked = _scan(base, directory)
    rows: list[tuple] = [("marker", directory, None, None)] if marked and directory else []
    if frames is not None:
        own = []
        for name in (".gitignore", TOOL_IGNORE):
            try:
                if any(p.rsplit("/", 1)[-1] == name for p, _, _ in files):
                    with open(os.path.join(base, directory, name), encoding="utf-8", errors="replace") as f:
                        own += f.read().splitlines()
            except OSError:
                pass
        if own:
            frames = {**frames, directory: [*frames.get(directory, []), *own]}
        rules = IgnoreRules(frames)
        files = [f for f in files if not rules.hides(f[0], False)]
        dirs = [d for d in dirs if not rules.hides(d, True)]
    return rows + [("file", *f) for f in files], [(d, frames) for d in dirs]


def _scan(base: str, directory: str) -> tuple[list[tuple[str, int, int]], list[str], bool]:
    """Files (path, mtime, size) and directories of one directory, relative to ``base``, and whether it has a .git, which is left out."""
    files, dirs, marked = [], [], False
    try:
        entries = sorted(os.scandir(os.path.join(base, directory)), key=lambda e: e.name)
    except OSError:
        return files, dirs, marked
    for e in entries:
        marked = marked or e.name == ".git"
        rel = f"{directory}/{e.name}" if directory else e.name
        try:
            if e.is_symlink():
                continue
            if e.is_dir():
                if e.name != ".git":
                    dirs.append(rel)
            elif e.is_file() and e.name != ".git":
                st = e.stat()
                files.append((rel, st.st_mtime_ns // 1_000_000, st.st_size))
        except OSError:
            continue
    return files, dirs, marked


def read_contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, content) of the listed paths; what can't be read any more is left out."""
    base = os.path.realpath(root)

    def run(it):
        for b in it:
            for path in b.column("path").to_pylist():
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])
                except OSError:
                    continue

    return paths.select("path").distinct().mapInArrow(run, "path string, content binary")


def subproject_of(files: DataFrame, markers: DataFrame) -> DataFrame:
    """``files`` with ``subproject``: the nearest directory above that ``markers`` (dir) lists, the root aside. Ancestors are exploded, so this is an equi join."""
    dirs = F.split("path", "/")
    up = files.select("path", F.explode(F.when(F.size(dirs) > 1, F.transform(F.sequence(F.lit(1), F.size(dirs) - 1), lambda k: F.array_join(F.slice(dirs, F.lit(1), k), "/")))).alias("dir"))
    best = up.join(markers.where("dir != ''").select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("subproject"))
    return files.join(best, "path", "left")


def stub_reason(path: Column, size: Column, config: WalkConfig = WalkConfig()) -> Column:
    """Why a file isn't even read: 'too-large' first, then 'image'; else null."""
    return F.when(size > config.max_file_bytes, "too-large").when(extension(path).isin(*[f".{e}" for e in IMAGES]), "image")


def stub_hash(reason: Column, size: Column, mtime: Column) -> Column:
    return F.when(reason == "too-large", F.concat_ws(":", F.lit("size"), size, mtime)).otherwise(F.concat_ws(":", F.lit("stat"), size, mtime))


def changed_by_stat(found: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files whose (path, mtime, size) the index doesn't have: only these need reading."""
    return found.join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def status_of(found: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status): added, changed, touched (same hash, new time), unchanged or deleted, by hash."""
    k = known.select("path", F.col("hash").alias("_h"), F.col("mtime").alias("_m"))
    both = found.select("path", "hash", "mtime").join(k, "path", "full")
    s = F.when(F.col("_h").isNull(), "added").when(F.col("hash").isNull(), "deleted").when(F.col("hash") != F.col("_h"), "changed").when(F.col("mtime") != F.col("_m"), "touched").otherwise("unchanged")
    return both.select("path", s.alias("status"))


def describe(contents: DataFrame, config: WalkConfig = WalkConfig()) -> DataFrame:
    """Files rows of read contents (path, mtime, size, content, subproject): hash, language, skip reason, lines and tokens, and the text where it is parsed."""
    text = F.when(~is_binary(F.col("content")), F.decode("content", "utf-8"))
    c = contents.withColumn("text", text)
    lang = detect_language(F.col("path"), F.col("text"))
    c = c.withColumns({"lang": lang, "hash": content_hash(F.col("content"))})
    reason = F.when(F.col("text").isNull(), "binary").otherwise(F.coalesce(text_skip_reason(F.col("text"), config.max_mean_line), F.when(F.col("lang").isNull(), "no-language").when(~F.col("lang").isin(*WITH_SYMBOLS) | F.col("lang").isin(*config.disable), "no-queries")))
    c = c.withColumn("skip_reason", reason)
    ok = F.col("skip_reason").isNull()
    return c.select(file_id(F.col("path")).alias("id"), "path", "lang", F.when(ok, F.col("lang")).alias("pack"), "hash", "mtime", "size", F.when(ok, line_count(F.col("text"))).otherwise(F.lit(0)).cast("bigint").alias("loc"), F.when(ok, estimate(F.col("text"))).otherwise(F.lit(0)).cast("bigint").alias("tok"), ok.alias("parsed"), "skip_reason", F.unix_millis(F.current_timestamp()).alias("indexed_at"), "subproject", F.when(ok, F.col("text")).alias("text"))


def stub_rows(stubs: DataFrame, config: WalkConfig = WalkConfig()) -> DataFrame:
    """Files rows of what isn't read (path, mtime, size, subproject)."""
    reason = stub_reason(F.col("path"), F.col("size"), config)
    return stubs.select(file_id(F.col("path")).alias("id"), "path", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("pack"), stub_hash(reason, F.col("size"), F.col("mtime")).alias("hash"), "mtime", "size", F.lit(0).cast("bigint").alias("loc"), F.lit(0).cast("bigint").alias("tok"), F.lit(False).alias("parsed"), reason.alias("skip_reason"), F.unix_millis(F.current_timestamp()).alias("indexed_at"), "subproject", F.lit(None).cast("string").alias("text"))


def file_id(path: Column) -> Column:
    """Deterministic id: adding a file renumbers nothing."""
    return F.xxhash64(path)


def walk(spark: SparkSession, root: str, config: WalkConfig = WalkConfig()) -> DataFrame:
    """(path, mtime, size, subproject) of every file that no rule ignores."""
    base = os.path.realpath(root)
    found = written(listing(spark, root, [*config.ignore, *global_rules(base)]), "listing")
    kept = found.where("kind = 'file'").select("path", "mtime", "size")
    if not config.detect_subprojects:
        return kept.withColumn("subproject", F.lit(None).cast("string"))
    return subproject_of(kept, found.where("kind = 'marker'").select(F.col("path").alias("dir")))

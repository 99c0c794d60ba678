"""A code index as a set of DataFrames, built from a directory, stored as Parquet snapshots, and queried.

A snapshot is written to a directory of its own; a pointer file names the current one and is replaced at the end, so readers always see a whole index."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.operators import extract, graph, health, resolve, retrieve, search, similar
from loomgraph.operators.shared import written
from loomgraph.sources import walk
from loomgraph.streaming import incremental


class Project:
    """``Project(spark, root, store)``: ``index()``, then ``find``, ``map``, ``read``, ``callers`` ..."""

    def __init__(self, spark: SparkSession, root: str, store: str, config: walk.WalkConfig | None = None):
        self.spark, self.root, self.store = spark, os.path.realpath(root), store
        self.config = config or walk.WalkConfig()
        inside = os.path.relpath(os.path.realpath(store), self.root)
        if not inside.startswith(".."):
            self.config = replace(self.config, ignore=(*self.config.ignore, f"/{inside}/"))

    # -- storage

    def _pointer(self) -> str:
        return os.path.join(self.store, "CURRENT")

    def exists(self) -> bool:
        return os.path.exists(self._pointer())

    def meta(self) -> dict:
        with open(self._pointer()) as f:
            return json.load(f)

    def table(self, name: str) -> DataFrame:
        """A table of the current snapshot; a snapshot of another schema version is refused."""
        meta = self.meta()
        if meta["schema_version"] != S.VERSION:
            raise ValueError(f"the index has schema version {meta['schema_version']}, this engine {S.VERSION}: build it again")
        return self.spark.read.parquet(os.path.join(self.store, meta["snapshot"], name))

    def _save(self, tables: dict[str, DataFrame]) -> None:
        name = uuid.uuid4().hex
        for k, df in tables.items():
            df.write.parquet(os.path.join(self.store, name, k))
        meta = {"schema_version": S.VERSION, "snapshot": name, "indexed_at": int(time.time() * 1000), "root": self.root}
        tmp = self._pointer() + ".new"
        with open(tmp, "w") as f:
            json.dump(meta, f)
        os.replace(tmp, self._pointer())

    # -- building

    def index(self, full: bool = False) -> dict[str, int]:
        """Bring the index up to date; returns files by status. Only files whose time or size changed are read; if none differ by content, nothing is written."""
        os.makedirs(self.store, exist_ok=True)
        seen = written(walk.walk(self.spark, self.root, self.config), "walk")
        known = self.table("files") if self.exists() and not full else None
        fresh = walk.changed_by_stat(seen, known) if known is not None else seen
        fresh = written(fresh, "fresh")
        reason = walk.stub_reason(F.col("path"), F.col("size"), self.config)
        stubs = walk.stub_rows(fresh.where(reason.isNotNull()), self.config)
        to_read = fresh.where(reason.isNull())
        contents = walk.read_contents(self.spark, self.root, to_read).join(to_read, "path")
        rows = written(walk.describe(contents, self.config).unionByName(stubs), "described")
        if known is None:
            changed, gone = rows, None
            counts = {"added": rows.count()}
        else:
            gone = written(incremental.evicted(known, seen), "gone")
            same = rows.join(known.select("path", F.col("hash").alias("_h")), "path").where("hash = _h").select("path")
            changed = rows.join(same, "path", "left_anti")
            added = changed.join(known.select("path"), "path", "left_anti").count()
            counts = {"added": added, "changed": changed.count() - added, "touched": same.count(), "deleted": gone.count()}
            if not any(counts.values()):
                return counts
        ex = extract.extract(changed)
        bad = ex["errors"].select("path", F.col("reason").alias("_e"))
        files = changed.join(bad, "path", "left").withColumns({"skip_reason": F.coalesce("_e", "skip_reason"), "parsed": F.col("parsed") & F.col("_e").isNull()}).select([f.name for f in S.FILES])
        tables = {"files": files, "nodes": ex["nodes"], "refs": ex["refs"], "imports": ex["imports"]}
        if known is not None:
            old = {k: self.table(k) for k in tables}
            dropped = gone.select("id").unionByName(changed.select("id"))
            old = incremental.without_files(old, dropped)
            touched = rows.join(same, "path", "left_semi").select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
            old["files"] = old["files"].join(touched, "path", "left").withColumns({"mtime": F.coalesce("_m", "mtime"), "size": F.coalesce("_s", "size")}).drop("_m", "_s")
            tables = {k: old[k].select(tables[k].columns).unionByName(tables[k]) for k in tables}
        tables = {k: written(t, k) for k, t in tables.items()}
        module = self._go_module()
        done = resolve.resolve(tables["files"], tables["nodes"], tables["imports"].select("id", "file_id", "spec", "symbol", "alias", "line", "ordinal"), tables["refs"], self._aliases(), module)
        tables |= {k: written(done[k], k) for k in ("edges", "unresolved", "externals", "imports")}
        rank = graph.pagerank(tables["nodes"], tables["edges"])
        tables["nodes"] = tables["nodes"].drop("rank").join(rank, "id")
        tables["trigrams"] = search.trigram_index(tables["nodes"])
        self._save(tables)
        return counts

    def _go_module(self) -> str | None:
        at = os.path.join(self.root, "go.mod")
        if os.path.exists(at):
            with open(at) as f:
                return next((x.split()[1] for x in f if x.strip().startswith("module ")), None)
        return None

    def _aliases(self) -> dict[str, list[str]]:
        """Path aliases of the root's tsconfig."""
        at = os.path.join(self.root, "tsconfig.json")
        if not os.path.exists(at):
            return {}
        from loomgraph.functions.text import strip_json_comments

        with open(at) as f:
            text = f.read()
        plain = self.spark.range(1).select(strip_json_comments(F.lit(text))).first()[0]
        try:
            options = json.loads(plain).get("compilerOptions", {})
        except ValueError:
            return {}
        base = options.get("baseUrl", ".").strip("./")
        out = {}
        for k, targets in options.get("paths", {}).items():
            out[k.removesuffix("*")] = ["/".join(x for x in (base, t.removesuffix("*").removeprefix("./")) if x) for t in targets]
        return out

    # -- queries

    def find(self, query: str, **options) -> DataFrame:
        return search.search(self.table("nodes"), self.table("files"), query, index=self.table("trigrams"), **options)

    def symbol(self, query: str, limit: int = 10) -> DataFrame:
        return search.find_symbol(self.table("nodes"), query, limit)

    def _id(self, query: str) -> int:
        row = self.symbol(query, 1).select("id").first()
        if row is None:
            raise KeyError(query)
        return row[0]

    def map(self, path: str = "", depth: int = 1, budget: int | None = None) -> DataFrame:
        files = self.table("files")
        if path and not files.where(F.col("path") == path).isEmpty():
            return retrieve.outline_file(files, self.table("nodes"), path, budget)
        return retrieve.outline_dir(files, path, depth, budget)

    def read(self, query: str, mode: str = "body") -> DataFrame:
        contents = walk.read_contents(self.spark, self.root, self.table("files").where("parsed")).select("path", F.decode("content", "utf-8").alias("text"))
        return retrieve.read_symbol(contents, self.table("files"), self.table("nodes"), self._id(query), mode)

    def callers(self, query: str, **options) -> DataFrame:
        return graph.callers(self.table("edges"), self.table("nodes"), self.table("files"), self._id(query), **options)

    def callees(self, query: str, limit: int = 50) -> DataFrame:
        return graph.callees(self.table("edges"), self.table("nodes"), self.table("files"), self.table("externals"), self._id(query), limit)

    def importers(self, path: str) -> DataFrame:
        return graph.importers(self.table("imports"), self.table("files"), self.table("files").where(F.col("path") == path).first()["id"])

    def impact(self, query: str, **options) -> DataFrame:
        return graph.impact(self.table("edges"), self.table("nodes"), self._id(query), **options)

    def path(self, a: str, b: str) -> list[int] | None:
        return graph.shortest_path(self.table("edges"), self._id(a), self._id(b))

    def similar(self, chunks: DataFrame, query: list[float], k: int = 10) -> DataFrame:
        return similar.semantic_search(chunks, query, k).join(self.table("nodes").select(F.col("id").alias("node_id"), "qname"), "node_id")

    def stats(self) -> DataFrame:
        return health.index_stats(*(self.table(t) for t in ("files", "nodes", "edges", "imports", "externals", "unresolved")))

    def doctor(self) -> DataFrame:
        return health.by_language(self.table("files"), self.table("edges"), self.table("unresolved"))

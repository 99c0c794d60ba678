"""Index, update and query a small repository; scalar vectors; graph invariants; streaming debounce."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import extract, graph
from loomgraph.project import Project
from loomgraph.streaming import incremental

FILES = {
    "src/util.py": '"""Helpers."""\n\n\ndef area(w, h):\n    """Width times height."""\n    return w * h\n\n\ndef _hidden():\n    return area(1, 2)\n',
    "src/app.py": "from src.util import area\nimport os\n\n\nclass Shop:\n    def total(self):\n        return area(3, 4)\n",
    "web/a.js": "import { helper } from './b.js';\nexport function run() { return helper(); }\n",
    "web/b.js": "export function helper() { return 1; }\n",
    "web/wide.js": "x" * 3000,
    ".gitignore": "ignored/\n*.log\n!keep.log\n",
    "ignored/z.py": "def never(): pass\n",
    "a.log": "no\n",
    "keep.log": "yes\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for k, v in FILES.items():
        (root / k).parent.mkdir(parents=True, exist_ok=True)
        (root / k).write_text(v)
    p = Project(spark, str(root), str(tmp_path_factory.mktemp("store")))
    p.index()
    return p


def test_walk_and_skip(project):
    files = {r["path"]: r for r in project.table("files").collect()}
    assert "ignored/z.py" not in files and "a.log" not in files and "keep.log" in files
    assert files["web/wide.js"]["skip_reason"] == "minified"
    assert files["src/util.py"]["lang"] == "python" and files["src/util.py"]["parsed"]


def test_resolution(project):
    names = {r["id"]: r["name"] for r in project.table("nodes").collect()}
    edges = {(names[r["src_id"]], names[r["dst_id"]], r["confidence"]) for r in project.table("edges").where("dst_id is not null").collect()}
    assert ("total", "area", "EXACT") in edges  # imported by name
    assert ("_hidden", "area", "EXACT") in edges  # same file
    assert ("run", "helper", "EXACT") in edges
    assert not any(a == b for a, b, _ in edges)


def test_queries(project):
    assert project.find("area").first()["qname"].endswith("area")
    assert {r["name"] for r in project.callers("area").collect()} == {"total", "_hidden"}
    ranks = [r["rank"] for r in project.table("nodes").collect()]
    assert 0 <= min(ranks) and max(ranks) == pytest.approx(1)
    assert project.map("src/util.py").count() >= 2 and project.map().count() >= 2


def test_update_is_idempotent_and_finds_changes(project, tmp_path):
    import os

    assert not any(project.index().values())
    with open(os.path.join(project.root, "web/b.js"), "a") as f:
        f.write("export function extra() { return 2; }\n")
    assert project.index()["changed"] == 1
    assert project.table("nodes").where("name = 'extra'").count() == 1


def test_split_identifier(spark):
    cases = {"getUserName": "get user name", "HTTPServer": "http server", "snake_case2": "snake case 2", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", F.array_join(T.split_identifier(F.col("s")), " ").alias("w")).collect()
    for r in rows:
        assert r["w"] == cases[r["s"]], r


def test_walk_prunes_and_marks(spark, tmp_path):
    """Ignored trees are never entered, ignore files hold where they are, nested repositories are marked, at any depth."""
    from loomgraph.sources import walk

    for f in ("a/b/c/d/e.py", "a/b/c/x.tmp", "a/b/c/skip/y.py", "node_modules/p/q.js", "a/b/sub/.git/HEAD", "a/b/sub/z.py", "_under/.dot/u.py"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x = 1\n")
    (tmp_path / "a/b/c/.gitignore").write_text("skip/\n*.tmp\n")
    entered = []
    real = walk._scan
    try:
        walk._scan = lambda base, d: entered.append(d) or real(base, d)
        got = {r["path"]: r["subproject"] for r in walk.walk(spark, str(tmp_path)).collect()}
    finally:
        walk._scan = real
    assert got == {"a/b/c/.gitignore": None, "a/b/c/d/e.py": None, "a/b/sub/z.py": "a/b/sub", "_under/.dot/u.py": None}
    assert "node_modules" not in entered


def test_no_caps_in_extraction():
    """Signatures, doc comments and visibility are found however long what stands before them is."""
    params = ", ".join(f"parameter_number_{i}" for i in range(400))
    comment = "\n".join(f"# {i}" for i in range(200))
    rows = extract.records("x.py", "python", f"def f({params}):\n    return 1\n", 1)
    f = next(r for r in rows if r.get("name") == "f")
    assert f["signature"].startswith("def f(parameter_number_0") and "return" not in f["signature"]
    js = extract.records("x.js", "javascript", comment.replace("# ", "// ") + "\nfunction g() {}\n", 1)
    assert next(r for r in js if r.get("name") == "g")["doc"].startswith("0 1 2")
    java = "class A {\n" + "@Mark " * 60 + "public int get() { return 1; }\n}\n"
    get = next(r for r in extract.records("A.java", "java", java, 1) if r.get("name") == "get")
    assert get["name"] == "get"


def test_script_blanking():
    from loomgraph.packs.scan import blank_script

    text = "a = b / c / d; r = /x[/{]`'/g; s = `t ${f(`${g()}`)} }`; // {\n'{' + \"}\" /* { */"
    out = blank_script(text)
    assert len(out) == len(text) and "f(" in out and "g()" in out and "b / c / d" in out
    assert "{" not in out and "}" not in out and "x[" not in out


def test_one_task_and_distributed_graphs_agree(spark):
    import random

    rng = random.Random(5)
    e = spark.createDataFrame([(rng.randrange(60), rng.randrange(60), "EXACT") for _ in range(150)], "src_id bigint, dst_id bigint, confidence string")
    n = spark.range(60).select("id")
    big = (1 << 62) + 1  # ids beyond what floats hold
    e, n = e.select((F.col("src_id") + big).alias("src_id"), (F.col("dst_id") + big).alias("dst_id"), "confidence"), n.select((F.col("id") + big).alias("id"))
    a, b = ({r["id"]: r["rank"] for r in graph.pagerank(n, e, one_task_links=k).collect()} for k in (0, 10_000))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    for src, dst in ((big, big + 7), (big + 3, big + 59), (big + 12, big + 12), (big + 1, 999)):
        assert graph.shortest_path(e, src, dst, one_task_links=0) == graph.shortest_path(e, src, dst)


def test_directions_and_embedding_configuration():
    from loomgraph.operators import similar

    assert graph.check_direction("impact") == "impact"
    with pytest.raises(ValueError, match="callers"):
        graph.check_direction("sideways")
    with pytest.raises(ValueError, match="provider.*model.*dim"):
        similar.check_embedding_config("none", None, -1)
    similar.check_embedding_config("local", "m", 3, "http://x")


def test_usage_ledger_appends(spark, tmp_path):
    from loomgraph.operators import health

    rows = spark.createDataFrame([("find", 10, 100)], "tool string, tokens_returned int, tokens_source int")
    for _ in range(2):
        health.write_ledger(rows, str(tmp_path / "ledger"))
    got = health.usage_ledger(spark.read.parquet(str(tmp_path / "ledger"))).first()
    assert (got["calls"], got["tokens_returned"], got["saved_percent"]) == (2, 20, 90)


def test_broken_file_is_a_row():
    rows = extract.records("x.py", "python", "def broken(:\n  class", 1)
    assert rows and rows[0]["record"] in ("node", "error")


def test_pagerank_against_plain_iteration(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 1), (4, 1)]
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id bigint")
    got = {r["id"]: r["rank"] for r in graph.pagerank(nodes, spark.createDataFrame(edges, "src_id bigint, dst_id bigint")).collect()}
    r = dict.fromkeys((1, 2, 3, 4, 5), 0.2)
    for _ in range(20):
        lost = r[5]
        new = {k: 0.15 / 5 + 0.85 * lost / 5 for k in r}
        for a, b in edges:
            new[b] += 0.85 * r[a] / sum(x == a for x, _ in edges)
        r = new
    for k, v in r.items():
        assert got[k] == pytest.approx(v / max(r.values()))


def test_debounce_and_throttle(spark):
    ev = spark.createDataFrame([("a", t) for t in (0, 100, 300, 1000, 5000)] + [("b", 7), ("b", None)], "k string, ts bigint")
    runs = sorted((r["k"], r["started"], r["events"]) for r in incremental.debounce(ev, "k", "ts", 250).collect())
    assert runs == [("a", 0, 3), ("a", 1000, 1), ("a", 5000, 1), ("b", 7, 1)]
    fires = {r["k"]: r["fires"] for r in incremental.throttle(ev, "k", "ts", 3000).collect()}
    assert fires == {"a": 2, "b": 1}


def test_shortest_path_and_impact(spark):
    e = spark.createDataFrame([(1, 2, "EXACT"), (2, 3, "INFERRED"), (3, 4, "EXACT"), (1, 4, "EXACT")], "src_id bigint, dst_id bigint, confidence string")
    assert graph.shortest_path(e, 1, 3) == [1, 2, 3] and graph.shortest_path(e, 4, 1) is None
    n = spark.createDataFrame([(i, 0.1) for i in range(1, 5)], "id bigint, rank double")
    got = {r["id"]: r["distance"] for r in graph.impact(e, n, 4, 3).collect()}
    assert got == {3: 1, 1: 1, 2: 2}


def test_proofs_find_the_innermost_range(spark):
    """Against all pairs, with odd ranges; and one large file is no product of its lines and ranges."""
    import random

    rng = random.Random(3)
    nodes = [(i, rng.randrange(3), rng.choice(["function", "class", "module"]), a, a + rng.choice([-2, 0, 1, 2, 7, 40, 1000])) for i, a in ((i, rng.randrange(-5, 130)) for i in range(300))] + [(300, 0, "class", None, 5), (301, 1, "class", -(1 << 31), (1 << 31) - 1)]
    proofs = [(i % 350, rng.randrange(4), rng.choice([rng.randrange(-9, 200), (1 << 31) - 1])) for i in range(400)] + [(7, 0, None), (8, None, 3)]
    n = spark.createDataFrame(nodes, "id bigint, file_id bigint, kind string, start_line int, end_line int")
    edges = spark.createDataFrame([(i, -1, "EXACT" if i % 9 == 0 else "INFERRED") for i in range(360)], "id bigint, dst_id bigint, confidence string")
    want = {}
    for i in range(360):
        hits = [(e - a, k) for p, f, line in proofs if p == i and None not in (f, line) for k, g, kind, a, e in nodes if g == f and kind != "module" and a is not None and a <= line <= e]
        want[i] = (-1, "EXACT") if i % 9 == 0 else (min(hits)[1], "EXACT") if hits else (-1, "INFERRED")
    got = graph.upgrade_by_proof(edges, spark.createDataFrame(proofs, "edge_id bigint, file_id bigint, line int"), n)
    assert {r["id"]: (r["dst_id"], r["confidence"]) for r in got.collect()} == want
    many = spark.range(20_000)
    wide = many.select("id", F.lit(1).alias("file_id"), F.lit("class").alias("kind"), F.lit(1).alias("start_line"), (F.col("id").cast("int") + 20_000).alias("end_line"))
    got = graph.upgrade_by_proof(many.select("id", F.lit(-1).alias("dst_id"), F.lit("INFERRED").alias("confidence")), many.select(F.col("id").alias("edge_id"), F.lit(1).alias("file_id"), (F.col("id").cast("int") + 1).alias("line")), wide)
    assert got.where("dst_id != 0 or confidence != 'EXACT'").isEmpty()
    assert not any(x in got._jdf.queryExecution().optimizedPlan().toString() for x in ("<=", ">="))  # joined on equal keys alone


def test_pagerank_by_blocks(spark):
    """A hub, loops, parallel edges, strangers and lone nodes, as one task ranks them; an iteration is one job without a shuffle."""
    from loomgraph.operators import rank

    n = spark.range(3_000).select((F.col("id") * 7).alias("id"))
    e = spark.range(20_000).select((F.col("id") * 7 % 14_000).alias("src_id"), F.when(F.col("id") % 3 == 0, 21).when(F.col("id") % 11 == 0, 5).when(F.col("id") % 13 != 0, F.col("id") * F.col("id") % 3_500 * 7).alias("dst_id"))
    sc, stages = spark.sparkContext, {}
    got = {}
    for k in (2, 6):
        sc.setJobGroup(f"rank-{k}", "")
        got[k] = {r["id"]: r["rank"] for r in graph.pagerank(n, e, iterations=k, one_task_links=0).collect()}
        stages[k] = sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in sc.statusTracker().getJobIdsForGroup(f"rank-{k}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert stages[6] - stages[2] == 4
    one = {r["id"]: r["rank"] for r in graph.pagerank(n, e, iterations=6).collect()}
    assert one.keys() == got[6].keys() and all(one[i] == pytest.approx(got[6][i]) for i in one)
    runs = list(rank._runs(rank.np.array([3] * (rank.ROW_LINKS + 1) + [4])))
    assert runs == [(0, rank.ROW_LINKS), (rank.ROW_LINKS, rank.ROW_LINKS + 1), (rank.ROW_LINKS + 1, rank.ROW_LINKS + 2)]


def test_full_text_spreads_and_scores(spark):
    """Scores against their formula; nodes of one partition are indexed by many tasks."""
    import math
    import re

    from loomgraph.operators import search

    names = ["red widget", "reWidget", "blue thing", "widgets red re", "", "Réd", None]
    rows = [(i, "function", names[i % 7], f"Brand::{i % 3}", f"red sig {i % 5}" if i % 2 else None, "re" if i % 4 == 0 else None) for i in range(300)]
    n = spark.createDataFrame(rows, "id bigint, kind string, name string, qname string, signature string, doc string").coalesce(1)
    index = search.postings(n)
    per = [r["count"] for r in index.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(per) < sum(per) / 3
    terms = {}
    for i, _, name, qname, sig, doc in rows:
        words = re.sub(r"([a-z])([A-Z])", r"\1 \2", name or "")
        body = [name, words if words != (name or "") or " " in words else "", qname, sig, doc]
        terms[i] = [t for x in body for t in re.split(r"[^\w]+", (x or "").lower().replace("é", "e")) if t]
    have = {}
    for r in index.collect():
        have[r["node_id"]] = have.get(r["node_id"], 0) + r["tf"]
    terms = {i: t for i, t in terms.items() if t}
    assert have.keys() == terms.keys()
    avg, want = sum(have.values()) / len(have), {}
    for w in ("re", "red", "widget"):
        tf = {i: c for i, t in terms.items() if (c := sum(x.startswith(w) for x in t))}
        for i, c in tf.items():
            want[i] = want.get(i, 0) + math.log((len(have) - len(tf) + 0.5) / (len(tf) + 0.5) + 1) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * have[i] / avg))
    got = {r["id"]: r["bm25"] for r in search.full_text(n, index, "re red widget", 1000).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert search.full_text(n, index, "absent").isEmpty() and search.full_text(n, index, " ").isEmpty()


def test_files_of_one_partition_are_scanned_by_many_tasks(spark):
    f = spark.range(200).select("id", F.concat(F.lit("f"), "id", F.lit(".ts")).alias("path"), F.lit("typescript").alias("lang"), F.concat(F.lit("function g"), "id", F.lit("() { return 1; }")).alias("text")).coalesce(1)
    nodes = extract.extract(f)["nodes"]
    assert nodes.where("kind = 'function'").count() == 200
    per = [r["count"] for r in nodes.groupBy(F.input_file_name().alias("by")).count().collect()]
    assert max(per) < sum(per) / 3

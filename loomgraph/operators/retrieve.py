"""Outlines, reading and rendering under a token budget. Lines are rows (ord, line); budgets are running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import compact_tokens, dirname, estimate

MARKS = {"class": "C", "interface": "I", "enum": "E", "function": "f", "method": "m", "field": ".", "const": "k", "var": "v", "type": "t", "module": "M", "key": "-", "rule": "r", "element": "e"}


def fit_to_budget(lines: DataFrame, budget: int | None, keys: list[str] | None = None) -> DataFrame:
    """``lines`` (keys..., ord, line) with cost and kept: the longest prefix whose costs (tokens and one for the line end) sum up to the budget.

    None keeps all, zero or less nothing. With ``keys`` each group has the budget, and groups are independent partitions."""
    cost = (estimate(F.col("line")) + 1).alias("cost")
    w = W.partitionBy(*(keys or [])).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    out = lines.select("*", cost)
    return out.withColumn("kept", F.lit(True) if budget is None else F.sum("cost").over(w) <= budget)


def outline_lines(nodes: DataFrame, kinds: list[str] | None = None, max_depth: int = 99) -> DataFrame:
    """(file_id, ord, line) of the symbols of files in source order."""
    n = nodes.where((F.col("kind") != "module") | F.col("parent_id").isNotNull()).where(F.col("depth") <= max_depth)
    if kinds:
        n = n.where(F.col("kind").isin(*kinds))
    mark = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), F.col("kind")), F.lit("?"))
    vis = F.when(F.col("visibility") == "private", "-").when(F.col("visibility") == "protected", "#").otherwise("")
    text = F.concat(F.lpad(F.col("start_line").cast("string"), 4, " "), F.lit(" "), mark, F.lit(" "), F.expr("repeat('  ', depth)"), vis, F.coalesce("signature", "name"))
    return n.select("file_id", F.col("ordinal").alias("ord"), text.alias("line"))


def outline_file(files: DataFrame, nodes: DataFrame, path: str, budget: int | None = None, kinds: list[str] | None = None, max_depth: int = 99) -> DataFrame:
    """(ord, line): header, symbols within the budget, and a note of what was left out."""
    file = files.where(F.col("path") == path)
    head = file.select(F.lit(-1).alias("ord"), F.concat("path", F.lit("  L"), F.col("loc"), F.lit(" ~"), compact_tokens(F.col("tok"))).alias("line"))
    lines = outline_lines(nodes.join(file.select(F.col("id").alias("file_id")), "file_id"), kinds, max_depth)
    left = None
    if budget is not None:
        first = head.select(estimate(F.col("line"))).first()
        left = budget - (first[0] if first else 0)
    fit = fit_to_budget(lines, left).select("ord", "line", "kept")
    kept = fit.where("kept").select("ord", "line")
    total = fit.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("kept")).alias("gone"))
    note = total.select(F.lit((1 << 31) - 1).alias("ord"), F.when(F.col("n") == 0, "  (no symbols extracted)").when(F.col("gone") > 0, F.concat(F.lit("  ... "), F.col("gone"), F.lit(" more symbols (raise the budget to see them)"))).alias("line")).where("line is not null")
    return head.unionByName(kept).unionByName(note).orderBy("ord")


def dir_rollup(files: DataFrame, prefix: str = "", depth: int = 1) -> DataFrame:
    """(dir, files, tok, loc, langs, subprojects): totals by the first ``depth`` directories below a prefix; files directly in it aren't counted."""
    base = files if not prefix else files.where(F.startswith("path", F.lit(prefix.rstrip("/") + "/")))
    skip = len([p for p in prefix.split("/") if p])
    dirs = F.split(dirname(F.col("path")), "/")
    below = base.where((dirname(F.col("path")) != "") & (F.size(dirs) > skip))
    return below.groupBy(F.array_join(F.slice(dirs, 1, skip + depth), "/").alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.sum("tok").alias("tok"), F.sum("loc").alias("loc"), F.sort_array(F.collect_set("lang")).alias("langs"), F.sort_array(F.collect_set("subproject")).alias("subprojects"))


def outline_dir(files: DataFrame, prefix: str = "", depth: int = 1, budget: int | None = None) -> DataFrame:
    """(ord, line): directories by tokens, then the files right below, within the budget."""
    rolled = dir_rollup(files, prefix, depth)
    direct = files.where(dirname(F.col("path")) == prefix.rstrip("/"))
    d = rolled.select(F.lit(0).alias("section"), "tok", F.col("dir").alias("path"), F.concat("dir", F.lit("/  "), F.col("files"), F.lit(" files ~"), compact_tokens(F.col("tok")), F.lit(" "), F.array_join("langs", ",")).alias("line"))
    f = direct.select(F.lit(1).alias("section"), "tok", "path", F.concat("path", F.lit("  L"), F.col("loc"), F.lit(" ~"), compact_tokens(F.col("tok"))).alias("line"))
    # one row for each directory and direct file of a single outline: small by nature
    lines = d.unionByName(f).select(F.row_number().over(W.orderBy("section", F.desc("tok"), "path")).alias("ord"), "line")
    return fit_to_budget(lines, budget).where("kept").select("ord", "line").orderBy("ord")


def read_range(contents: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """(line_no, line) of a file's lines first..last, from 1."""
    lines = contents.where(F.col("path") == path).select(F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.col("n").between(first - 1, last - 1)).select((F.col("n") + 1).alias("line_no"), "line").orderBy("line_no")


def read_symbol(contents: DataFrame, files: DataFrame, nodes: DataFrame, node_id: int, mode: str = "body") -> DataFrame:
    """(line_no, line) of a symbol: its signature, or the whole lines it spans."""
    n = nodes.where(F.col("id") == node_id).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    if mode == "signature":
        return n.select(F.col("start_line").alias("line_no"), F.coalesce("signature", "name").alias("line"))
    lines = n.join(contents.select("path", "text"), "path").select("start_line", "end_line", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where("n + 1 between start_line and end_line").select((F.col("n") + 1).alias("line_no"), "line").orderBy("line_no")


def staleness_minutes(indexed_at_ms, now_ms=None):
    """Minutes since the index was written, null below ten."""
    age = (now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())) - indexed_at_ms
    return F.when(age >= 600_000, F.floor(age / 60_000))


def render_graph(rows: DataFrame, order: list) -> DataFrame:
    """(ord, line) of callers or callees: '!' marks guesses."""
    mark = F.when(F.col("confidence") == "INFERRED", "!").otherwise(" ")
    return rows.select(F.row_number().over(W.orderBy(*order)).alias("ord"), F.concat(mark, F.col("name"), F.lit(" :"), F.col("line"), F.lit(" ["), F.col("kind"), F.lit("]")).alias("line"))


def level_breaks(rows: DataFrame) -> DataFrame:
    """Impact rows (id, distance) with ``is_first``: whether a row opens a new distance."""
    w = W.orderBy("distance", F.desc("rank"), "id")
    return rows.withColumn("is_first", ~F.coalesce(F.lag("distance").over(w) == F.col("distance"), F.lit(False)))

"""Extraction: parsed files to nodes, references and imports, in one pass per file inside an Arrow function; one file is one unit of work.

The sweep that finds parents needs each file's definitions in order, which is sequential inside a file and independent across files.
Ids are hashes of (path, ordinal), so pointers need no counter and adding a file renumbers nothing."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.functions.text import estimate
from loomgraph.operators.shared import bounded_batches, spread, written
from loomgraph.packs.scan import Captures, Def, scan

#: About what a batch of finished rows holds before it is sent on.
OUT_BYTES = 4 << 20

RECORD = "record string, path string, file_id bigint, ordinal int, parent int, kind string, name string, qname string, start_line int, end_line int, start_offset int, end_offset int, signature string, doc string, visibility string, is_exported boolean, body string, depth int, receiver string, symbol string, alias string"


def dedupe(defs: list[Def]) -> list[Def]:
    """Outer definitions first; of equal range and name the kind of the highest rank stays, the earlier of equals."""
    best: dict[tuple, Def] = {}
    for d in defs:
        d.kind = S.KIND_ALIASES.get(d.kind, d.kind)
        k = (d.start, d.end, d.name)
        if k not in best or S.KIND_RANK.get(d.kind, 0) > S.KIND_RANK.get(best[k].kind, 0):
            best[k] = d
    return sorted(best.values(), key=lambda d: (d.start, -d.end))


def parents(defs: list[Def]) -> list[int]:
    """Index of the innermost definition around each (outer first order), -1 at the top; definitions of the same range are siblings."""
    out, stack = [], []
    for i, d in enumerate(defs):
        while stack and (defs[stack[-1]].end <= d.start or (defs[stack[-1]].start, defs[stack[-1]].end) == (d.start, d.end)):
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


def signature(text: str, lang: str) -> str | None:
    """Head of a definition up to its body, spaces squeezed."""
    if lang in ("json", "css", "html", "bash"):
        head = text.split("\n", 1)[0][:400]
        out = re.sub(r"\s+", " ", re.sub(r"\s*[{:]\s*$", "", head)).strip()[:200]
        return out or None
    if lang == "python":
        end = _until(text, ":", "([{")
        if text.lstrip().startswith("@"):
            at = re.search(r"(?m)^\s*(?:async\s+def|def|class)\b", text)
            text, end = (text[at.start() :], _until(text[at.start() :], ":", "([{")) if at else (text, end)
        if not re.match(r"\s*(?:async\s+)?(?:def|class)\b", text):
            end = text.find("\n") if "\n" in text else len(text)
    else:
        end = _until(text, "{", "([")
        arrow = _until(text, "=>", "([")
        end = min([e for e in (end, arrow) if e >= 0], default=-1)
    head = text if end < 0 else text[:end]
    head = re.sub(r"(?s)^/\*\*.*?\*/\s*", "", head)
    head = re.sub(r"\s+", " ", head)
    for a, b in ((r"\( ", "("), (r" \)", ")"), (r",\s*\)", ")"), (r" ,", ","), (r"\s*[={;:]\s*$", "")):
        head = re.sub(a, b, head)
    return head.strip()[:300] or None


def _until(text: str, stop: str, opens: str) -> int:
    """Offset of ``stop`` outside of brackets, -1 without one."""
    depth, close = 0, {"(": ")", "[": "]", "{": "}"}
    for m in re.finditer("|".join(re.escape(x) for x in (stop, *opens, *(close[o] for o in opens))), text):
        if m[0] == stop:
            if not depth:
                return m.start()
        elif m[0] in opens:
            depth += 1
        else:
            depth = max(0, depth - 1)
    return -1


_COMMENT = re.compile(r"^\s*(?:///?|//!|#(?!\[|!)|--|;|\*|/\*)")


def doc_comment(source: str, d: Def, lang: str) -> str | None:
    """Documentation of a definition: its docstring in Python, else the comment lines right above, at most 500 characters."""
    if lang == "python" and d.kind in ("class", "function"):
        at = _until(source[d.start : d.end], ":", "([{")
        m = re.match(r"\s*(?:#[^\n]*\s*)*[rRuUbB]*(\"\"\"|'''|\"|')(.*?)\1", source[d.start + at + 1 : d.end], re.S) if at >= 0 else None
        return re.sub(r"\s+", " ", m[2]).strip()[:500] or None if m else None
    lines = []
    for line in _lines_above(source, d.start):
        if re.match(r"^\s*(?:@\w|\[|#\[)", line) and not lines:
            continue  # decorators and attributes between comment and definition
        if not _COMMENT.match(line):
            break
        lines.append(re.sub(r"\s*\*+/\s*$", "", re.sub(r"^\s*(?:///?|//!|#+|--|;+|/\*+!?|\*+(?!/))\s?", "", line)).strip())
    out = []
    for line in reversed(lines):
        if line.startswith("@"):
            break
        if line:
            out.append(line)
    text = " ".join(out)
    if lang == "csharp":
        m = re.search(r"(?s)<summary>(.*?)</summary>", text)
        text = re.sub(r"<(?:see|seealso|paramref|typeparamref)\s+\w+=\"(?:\w:)?(?:[^\"]*\.)?([^\".(]+)[^\"]*\"\s*/>", r"\1", m[1] if m else text)
        text = re.sub(r"<[^>]*>", " ", text)
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            text = text.replace(a, b)
    return re.sub(r"\s+", " ", text).strip()[:500] or None


def _lines_above(source: str, at: int):
    """Lines before the one that ``at`` is in, the nearest first."""
    end = source.rfind("\n", 0, at)
    while end >= 0:
        start = source.rfind("\n", 0, end) + 1
        yield source[start:end]
        end = start - 1


def _head(source: str, d: Def) -> str:
    """A definition up to its first bracket, however far that is."""
    m = re.compile(r"[({]").search(source, d.start, d.end)
    return source[d.start : m.start() if m else d.end]


def visibility(source: str, d: Def, lang: str) -> str | None:
    head = _head(source, d)
    mark = re.search(r"\b(private|protected|public|internal)\b", head)
    if lang in ("typescript", "tsx", "java", "csharp") and mark:
        return mark[1]
    if lang in ("typescript", "tsx", "javascript"):
        return "private" if d.name.startswith("#") else None
    if lang == "java":
        return None
    if lang == "csharp":
        return "private" if d.kind in ("method", "field") else None
    if lang == "go":
        return "public" if d.name[:1].isupper() else "private"
    if lang == "rust":
        return "public" if re.match(r"\s*pub\b(?!\s*\()", head) else "internal" if re.match(r"\s*pub\s*\(", head) else "private"
    if lang == "python":
        return None if re.fullmatch(r"__\w+__", d.name) else "private" if d.name.startswith("_") else "public"
    return "private" if d.name.startswith("_") else None


def is_exported(source: str, d: Def, lang: str) -> bool:
    head = source[d.start : d.end]
    if lang in ("typescript", "tsx", "javascript"):
        return bool(re.match(r"\s*export\b|\s*(?:module\.)?exports\.", head))
    if lang == "go":
        return d.name[:1].isupper()
    if lang == "rust":
        return bool(re.match(r"\s*pub\b", head))
    if lang in ("java", "csharp"):
        return bool(re.search(r"\bpublic\b", _head(source, d)))
    if lang == "python":
        return not d.name.startswith("_")
    return True


def module_doc(source: str, lang: str) -> str | None:
    m = re.match(r"\s*(?:#![^\n]*\n)?\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')" if lang == "python" else r"\s*/\*\*(.*?)\*/", source, re.S)
    if not m:
        return None
    lines = [re.sub(r"^\s*\*\s?", "", x).strip() for x in next(g for g in m.groups() if g is not None).split("\n")]
    return re.sub(r"\s+", " ", " ".join(x for x in lines if x and not x.startswith("@"))).strip()[:500] or None


def qualified(kind: str, name: str, parent_kind: str, parent_qname: str) -> str:
    return parent_qname + ("::" if parent_kind == "module" and "::" not in parent_qname else "#" if kind in ("method", "field") else ".") + name


def records(path: str, lang: str, source: str, file_id: int) -> list[dict]:
    """Rows of one file; a failing scanner gives a single 'error' row."""
    try:
        cap: Captures = scan(source, lang)
    except Exception as e:  # a broken file must not stop the batch: the error is a row of the result
        return [{"record": "error", "path": path, "file_id": file_id, "ordinal": 0, "name": f"parse-error: {e}"[:200]}]
    breaks = [m.start() for m in re.finditer("\n", source)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    defs = dedupe(cap.defs)
    up = parents(defs)
    rows = [{"record": "node", "path": path, "file_id": file_id, "ordinal": 0, "parent": None, "kind": "module", "name": path, "qname": path, "start_line": 1, "end_line": len(breaks) + 1, "start_offset": 0, "end_offset": len(source), "signature": None, "doc": module_doc(source, lang), "visibility": None, "is_exported": True, "body": source, "depth": -1}]
    for i, d in enumerate(defs):
        p = rows[up[i] + 1]
        # a method's own class, or the file, gives its name; declarations share their file's module
        q = path + "::" + d.name if p["ordinal"] == 0 else qualified(d.kind, d.name, p["kind"], p["qname"])
        rows.append({"record": "node", "path": path, "file_id": file_id, "ordinal": i + 1, "parent": up[i] + 1, "kind": d.kind, "name": d.name, "qname": q, "start_line": line(d.start), "end_line": line(max(d.start, d.end - 1)), "start_offset": d.start, "end_offset": d.end, "signature": signature(source[d.start : d.end], lang), "doc": doc_comment(source, d, lang), "visibility": visibility(source, d, lang), "is_exported": is_exported(source, d, lang), "body": source[d.start : d.end], "depth": p["depth"] + 1})
    stack: list[int] = []
    nxt = 0
    for n, r in enumerate(sorted({(r.at, r.kind, r.name, r.receiver or "") for r in cap.refs})):
        while nxt < len(defs) and defs[nxt].start <= r[0]:
            while stack and defs[stack[-1]].end <= defs[nxt].start:
                stack.pop()
            stack.append(nxt)
            nxt += 1
        while stack and defs[stack[-1]].end <= r[0]:
            stack.pop()
        rows.append({"record": "ref", "path": path, "file_id": file_id, "ordinal": n, "parent": stack[-1] + 1 if stack else 0, "kind": r[1], "name": r[2], "receiver": r[3] or None, "start_line": line(r[0])})
    for n, (spec, symbol, alias, at) in enumerate(import_rows([(i.spec, i.symbol, i.alias, line(i.at)) for i in cap.imports])):
        rows.append({"record": "import", "path": path, "file_id": file_id, "ordinal": n, "name": spec, "symbol": symbol, "alias": alias, "start_line": at})
    return rows


def import_rows(found: list[tuple]) -> list[tuple]:
    """Without repeats, and without a bare row where the same specifier and line has specific ones."""
    specific = {(s, at) for s, sym, al, at in found if sym or al}
    return list(dict.fromkeys(x for x in found if x[1] or x[2] or (x[0], x[3]) not in specific))


def node_id(path: Column, ordinal: Column) -> Column:
    return F.xxhash64(path, ordinal.cast("int"))


def extract(files: DataFrame) -> dict[str, DataFrame]:
    """nodes, refs, imports and errors of files rows with ``text`` (rows without text have none). Files are spread first: few stored bytes may be many files."""
    arrow = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]]) for c in RECORD.split(", ")])

    def run(it):
        out: list[dict] = []
        held = 0
        for b in it:
            for path, lang, text, fid in zip(*(b.column(c).to_pylist() for c in ("path", "lang", "text", "id"))):
                if text is None or lang is None:
                    continue
                found = records(path, lang, text, fid)
                out += found
                held += 200 * len(found) + sum(len(r["body"]) for r in found if r["record"] == "node")
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    rows = written(bounded_batches(spread(files.select("path", "lang", "text", "id"), "path", "id")).mapInArrow(run, RECORD).withColumn("tok", estimate(F.col("body"))).drop("body"), "extraction")
    nid = node_id(F.col("path"), F.col("ordinal"))
    nodes = rows.where("record = 'node'").select(nid.alias("id"), "file_id", node_id(F.col("path"), F.col("parent")).alias("_p"), "parent", "kind", "name", "qname", "start_line", "end_line", "start_offset", "end_offset", "signature", "doc", "visibility", "is_exported", "tok", "ordinal", "depth")
    nodes = nodes.withColumn("parent_id", F.when(F.col("parent").isNotNull(), F.col("_p"))).withColumn("rank", F.lit(0.0)).select([f.name for f in S.NODES])
    refs = rows.where("record = 'ref'").select(F.xxhash64("path", F.lit("ref"), "ordinal").alias("id"), "file_id", node_id(F.col("path"), F.col("parent")).alias("src_id"), "name", "kind", "receiver", F.col("start_line").alias("line"), "ordinal")
    imports = rows.where("record = 'import'").select(F.xxhash64("path", F.lit("import"), "ordinal").alias("id"), "file_id", F.col("name").alias("spec"), "symbol", "alias", F.col("start_line").alias("line"), "ordinal")
    errors = rows.where("record = 'error'").select("file_id", "path", F.col("name").alias("reason"))
    return {"nodes": nodes, "refs": refs, "imports": imports, "errors": errors}

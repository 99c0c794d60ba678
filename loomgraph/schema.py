"""Tables of the code index and the domains of their values."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "array<float>": T.ArrayType(T.FloatType())}


def _s(text: str) -> T.StructType:
    """Schema of "name type, ..."; read here, as workers import this module and have no session to parse with."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split(" ", 1) for x in text.split(", "))])


FILES = _s("id bigint, path string, lang string, pack string, hash string, mtime bigint, size bigint, loc bigint, tok bigint, parsed boolean, skip_reason string, indexed_at bigint, subproject string")
NODES = _s("id bigint, file_id bigint, parent_id bigint, kind string, name string, qname string, start_line int, end_line int, start_offset int, end_offset int, signature string, doc string, visibility string, is_exported boolean, tok bigint, ordinal int, depth int, rank double")
EDGES = _s("id bigint, src_id bigint, dst_id bigint, ext_id bigint, file_id bigint, kind string, confidence string, line int")
IMPORTS = _s("id bigint, file_id bigint, spec string, symbol string, alias string, line int, ordinal int, resolved_file_id bigint, external_id bigint")
REFS = _s("id bigint, file_id bigint, src_id bigint, name string, kind string, receiver string, line int, ordinal int")
EXTERNALS = _s("id bigint, ecosystem string, package string, symbol string, source string, use_count bigint")
UNRESOLVED = _s("id bigint, file_id bigint, line int, name string, kind string, reason string")
TRIGRAMS = _s("tri string, node_id bigint")
CHUNKS = _s("node_id bigint, dim int, vector array<float>")
META = _s("key string, value string")

TABLES = {"files": FILES, "nodes": NODES, "edges": EDGES, "imports": IMPORTS, "refs": REFS, "externals": EXTERNALS, "unresolved": UNRESOLVED, "trigrams": TRIGRAMS, "chunks": CHUNKS, "meta": META}

#: Written with every snapshot; a snapshot of another version is refused and rebuilt from its sources.
VERSION = 3

EXACT, INFERRED = "EXACT", "INFERRED"
EDGE_KINDS = ("call", "decorates", "extends", "implements", "instantiates", "type")
SKIP_REASONS = ("binary", "generated", "image", "minified", "no-language", "no-queries", "too-large")
KIND_ALIASES = {"cls": "class", "constant": "const", "def": "function", "fn": "function", "func": "function", "iface": "interface", "meth": "method", "struct": "class", "variable": "var"}
#: Which of several definitions of the same range and name stays: the highest.
KIND_RANK = {"class": 10, "enum": 10, "interface": 10, "function": 9, "method": 9, "field": 5, "const": 4, "var": 3, "module": 2, "type": 1}

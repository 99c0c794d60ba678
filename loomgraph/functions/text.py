"""Scalar text functions as Column expressions; all of them stay inside whole-stage code generation. Lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r]"
PUNCT = r"[!-/:-@\[-^`{-~]"


def estimate(text: Column) -> Column:
    """Tokens of a text by its make-up: 3.6 word characters, one punctuation mark or 2.5 runs of white space each; 0 if empty or null."""
    ws, runs, punct = F.regexp_count(text, F.lit(WS)), F.regexp_count(text, F.lit(WS + "+")), F.regexp_count(text, F.lit(PUNCT))
    cost = F.ceil((F.length(text) - ws - punct) / F.lit(3.6) + punct + runs * F.lit(0.4))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), cost)).cast("bigint")


def line_count(text: Column) -> Column:
    """Lines of a text; an empty or null one has none."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("bigint")


def content_hash(content: Column) -> Column:
    """First half of the SHA-256, in hexadecimal."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 32)


def is_binary(content: Column) -> Column:
    """Whether one of the first 8000 bytes is NUL."""
    return F.contains(F.substring(content, 1, 8000), F.lit(b"\x00"))


GENERATED = r"(?i)@generated|code generated by|do not edit|auto-generated by"


def text_skip_reason(text: Column, max_mean_line: int = 500) -> Column:
    """'generated' by a marker in the first 2000 characters, 'minified' by the mean line length, else null."""
    mean = F.length(text) / (F.regexp_count(text, F.lit("\n")) + 1)
    return F.when(F.rlike(F.substring(text, 1, 2000), F.lit(GENERATED)), "generated").when(mean > max_mean_line, "minified")


def split_identifier(name: Column) -> Column:
    """Lower-case words of an identifier, cut at separators, case changes, acronym ends and digit edges."""
    edge = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|[^A-Za-z0-9]+"
    return F.filter(F.transform(F.split(name, edge), F.lower), lambda w: w != "")


def identifier_parts(name: Column) -> Column:
    """The words of an identifier joined by spaces where there are several, else ''."""
    words = split_identifier(name)
    return F.when(F.size(words) > 1, F.array_join(words, " ")).otherwise(F.lit(""))


def trigrams(name: Column) -> Column:
    """Distinct three-letter pieces of the lower-cased name; a shorter name is its only piece, an empty one has none."""
    low = F.lower(name)
    n = F.length(low)
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(low)).otherwise(pieces)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; '' without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; '' without one or where the name begins with its only dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def to_posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalize_path(path: Column) -> Column:
    """Forward slashes, without a leading ./ and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(to_posix(path), r"^(\./)+", ""), "/+$", "")


def dir_prefix(path: Column, depth: int) -> Column:
    """The first ``depth`` directories of a path; '.' for a file at the root."""
    dirs = F.split(dirname(path), "/")
    return F.when(dirname(path) == "", F.lit(".")).otherwise(F.array_join(F.slice(dirs, 1, depth), "/"))


def normalize_relative(base_file: Column, spec: Column) -> Column:
    """A relative specifier folded onto the directory of ``base_file``: '.', '..' and empty segments vanish."""
    start = F.filter(F.split(dirname(base_file), "/"), lambda s: s != "")

    def step(acc, seg):
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(seg.isin("", "."), acc).when(seg == "..", up).otherwise(F.concat(acc, F.array(seg)))

    return F.array_join(F.aggregate(F.split(spec, "/"), start, step), "/")


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"'`<]+|[\"'`>]+$", "")


def strip_comment(line: Column) -> Column:
    """A comment line without its markers."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"^\s*(///?|//!|#+|--|;+|/\*+!?|\*+(?!/))\s?", ""), r"\s*\*+/\s*$", ""))


def strip_json_comments(text: Column) -> Column:
    """JSON text without comments and trailing commas; strings stay as they are."""
    plain = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")
    return F.regexp_replace(plain, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")


def flatten_xml_doc(text: Column) -> Column:
    """The words of an XML documentation comment: references give their last name, other tags vanish."""
    named = F.regexp_replace(text, r'<(?:see|seealso|paramref|typeparamref)\s+(?:cref|name|langword)="(?:\w:)?(?:[^"]*\.)?([^".(]+)[^"]*"\s*/>', "$1")
    bare = F.regexp_replace(named, r"<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def xml_summary(text: Column) -> Column:
    """The flattened <summary> of a documentation comment, else the flattened whole."""
    inner = F.regexp_extract(text, r"(?s)<summary>(.*?)</summary>", 1)
    return flatten_xml_doc(F.when(inner != "", inner).otherwise(text))


def signature_line(text: Column) -> Column:
    """First line of a definition without its opening brace or colon, spaces squeezed, at most 200 characters."""
    first = F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, 400)
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(first, r"\s*[{:]\s*$", ""), r"\s+", " ")), 1, 200)


def visibility_by_name(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("_")), "private")


def escape_like(text: str) -> str:
    """Literal text for a LIKE pattern with a backslash as escape."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def symbol_text(kind: Column, qname: Column, signature: Column, name: Column, doc: Column) -> Column:
    """What an embedding sees of a symbol: kind, qualified name, signature or name, doc; at most 1000 characters."""
    parts = F.filter(F.array(kind, qname, F.coalesce(signature, name), doc), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.substring(F.array_join(parts, " — "), 1, 1000)


def qualified_name(kind: Column, name: Column, parent_kind: Column, parent_qname: Column) -> Column:
    """path::name below the module, parent#name for methods and fields, else parent.name."""
    sep = F.when(parent_kind == "module", "::").when(kind.isin("method", "field"), "#").otherwise(".")
    return F.concat(parent_qname, sep, name)


def percent(part: Column, whole: Column) -> Column:
    """Rounded share in percent, halves up; null of nothing."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).cast("bigint")


def compact_tokens(n: Column) -> Column:
    """950, 1.4k, 23k, 1.2M."""
    k, m = n / 1000.0, n / 1_000_000.0
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 10_000, F.concat(F.format_number(F.floor(k * 10 + 0.5) / 10, 1), F.lit("k")))
        .when(n < 1_000_000, F.concat(F.floor(k + 0.5).cast("string"), F.lit("k")))
        .otherwise(F.concat(F.format_number(F.floor(m * 10 + 0.5) / 10, 1), F.lit("M")))
    )


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_number(n / 1024.0, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / float(1 << 20), 1), F.lit(" MB")))


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(F.format_number(ms / 1000.0, 1), F.lit("s"))).otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m"), F.floor(ms % 60_000 / 1000).cast("string"), F.lit("s")))


def parse_location(text: Column) -> Column:
    """'path:a-b' or 'path:a' as (path, first, last); numbers null without a range."""
    first = F.when(F.regexp_extract(text, r":(\d+)(?:-(\d+))?$", 1) != "", F.regexp_extract(text, r":(\d+)(?:-(\d+))?$", 1).cast("int"))
    last = F.when(F.regexp_extract(text, r":(\d+)(?:-(\d+))?$", 2) != "", F.regexp_extract(text, r":(\d+)(?:-(\d+))?$", 2).cast("int"))
    return F.struct(F.regexp_replace(text, r":(\d+)(?:-(\d+))?$", "").alias("path"), first.alias("first"), F.coalesce(last, first).alias("last"))


def line_start(text: Column, offset: Column) -> Column:
    """Offset (from 0) of the first character of the line that holds ``offset``."""
    head = F.substring(text, F.lit(1), offset)
    at = F.instr(F.reverse(head), "\n")
    return F.when(at == 0, F.lit(0)).otherwise(F.length(head) - at + 1)


def embeddings_url(base: Column) -> Column:
    """The endpoint of an embedding server named by a base address."""
    bare = F.regexp_replace(base, "/+$", "")
    return F.when(F.endswith(bare, F.lit("/embeddings")), bare).when(F.rlike(bare, F.lit(r"/v\d+$")), F.concat(bare, F.lit("/embeddings"))).otherwise(F.concat(bare, F.lit("/v1/embeddings")))

"""Language detection by file name, extension or shebang, as broadcastable tables and Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import basename, extension

#: language: extensions. The first language that names an extension has it.
EXTENSIONS = {
    "bash": "sh bash zsh", "c": "c h", "cpp": "cpp cc cxx c++ hpp hh hxx", "csharp": "cs", "css": "css less sass scss", "dart": "dart", "elisp": "el",
    "elixir": "ex exs", "elm": "elm", "erb": "ejs erb", "go": "go", "html": "htm html", "java": "java", "javascript": "cjs js jsx mjs", "json": "json jsonc",
    "kotlin": "kt kts", "lua": "lua", "objc": "m mm", "ocaml": "ml mli", "php": "php", "python": "py pyi pyw", "ql": "ql qll", "rescript": "res resi",
    "ruby": "gemspec rake rb", "rust": "rs", "scala": "sc scala", "solidity": "sol", "swift": "swift", "systemrdl": "rdl", "tlaplus": "tla", "toml": "toml",
    "tsx": "tsx", "typescript": "cts mts ts", "vue": "vue", "yaml": "yaml yml", "zig": "zig",
}
BY_EXTENSION = {f".{e}": lang for lang, es in EXTENSIONS.items() for e in es.split()}
BY_NAME = {"Gemfile": "ruby", "Rakefile": "ruby"}
BY_SHEBANG = {**{lang: lang for lang in EXTENSIONS}, "sh": "bash", "zsh": "bash"}

#: Languages whose symbols are extracted; files of others are listed without symbols.
WITH_SYMBOLS = ("bash", "csharp", "css", "go", "html", "java", "javascript", "json", "python", "rust", "tsx", "typescript")


def _lookup(table: dict[str, str], key: Column) -> Column:
    flat = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.try_element_at(F.create_map(*flat), key)


def detect_language(path: Column, content: Column | None = None) -> Column:
    """Language of a file: by its exact name, its extension, or the interpreter its first line names; null if unknown."""
    found = F.coalesce(_lookup(BY_NAME, basename(path)), _lookup(BY_EXTENSION, extension(path)))
    if content is None:
        return found
    first = F.split_part(F.substring(content, 1, 200), F.lit("\n"), F.lit(1))
    last = F.regexp_extract(F.rtrim(first), r"([^\s/]+)[\s/]*$", 1)
    shebang = F.when(F.startswith(content, F.lit("#!")), _lookup(BY_SHEBANG, F.regexp_replace(F.regexp_replace(last, "^#!", ""), r"[0-9.]+$", "")))
    return F.coalesce(found, shebang)


def enabled(lang: Column, enable: list[str] | None = None, disable: list[str] | None = None) -> Column:
    """Whether a language takes part under the configured lists; an empty ``enable`` means all."""
    ok = F.lit(True) if not enable else lang.isin(*enable)
    return ok & ~lang.isin(*disable) if disable else ok

"""Scanners: from source text to captures of definitions, references and imports. No grammar engine is needed.

Languages with braces share one scanner: strings and comments are blanked out (offsets stay), brackets are matched once, and
expressions for each language find declarations, whose range ends at the matching brace or the end of the statement. Python is parsed by
its own ``ast``; a file with syntax errors falls back to expressions by indentation. HTML, CSS, JSON and shell have small scanners of their own.
Offsets are characters."""

from __future__ import annotations

import ast
import bisect
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser


@dataclass
class Def:
    kind: str
    name: str
    start: int
    end: int
    head: int = -1  # where the name's declaration proper begins, for export and visibility marks before it
    parent_hint: str | None = None


@dataclass
class Ref:
    kind: str
    name: str
    at: int
    receiver: str | None = None


@dataclass
class Import:
    spec: str
    symbol: str | None
    alias: str | None
    at: int


@dataclass
class Captures:
    defs: list[Def] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)


_TOKENS = {
    "c": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
    "js": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "cs": re.compile(r"//[^\n]*|/\*.*?\*/|@\"(?:\"\"|[^\"])*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.S),
    "rs": re.compile(r"//[^\n]*|/\*.*?\*/|r#*\"(?:[^\"])*\"#*|\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n]{1,8}?|[^'\\\n])'", re.S),
    "sh": re.compile(r"(?:(?<=\s)|^)#[^\n]*|\"(?:\\.|[^\"\\])*\"|'[^']*'", re.S | re.M),
}


def blank(text: str, tokens: re.Pattern) -> str:
    """The text with comments and string contents as spaces; quotes and line ends stay."""

    def gap(m: re.Match) -> str:
        s = m[0]
        q = s[-1] if s[-1] in "\"'`" and len(s) > 1 and not s.startswith(("//", "/*", "#")) else ""
        body = re.sub(r"[^\n]", " ", s)
        return body[:-1] + q if q else body

    return tokens.sub(gap, text)


def match_brackets(text: str) -> dict[int, int]:
    """Position of the closing bracket for each opening one; stray ones are passed over."""
    pairs, stack, close = {}, [], {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m[0]
        if c in "([{":
            stack.append((c, m.start()))
        else:
            for k in range(len(stack) - 1, max(-1, len(stack) - 8), -1):
                if stack[k][0] == close[c]:
                    pairs[stack[k][1]] = m.start()
                    del stack[k:]
                    break
    return pairs


_SCRIPT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`|/|[{}]", re.S)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: What a division can't follow: there a slash begins a regular expression.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield))\s*$")


def blank_script(text: str) -> str:
    """As ``blank``, for JavaScript and TypeScript: regular expressions are blanked out too, what template literals
    substitute stays, in round brackets."""
    out: list[str] = []
    stack: list[str] = []  # open braces: of code, or of a substitution
    gap = lambda s: re.sub(r"[^\n]", " ", s)
    at = 0

    def template(i: int) -> int:
        """Blank a template from ``i`` on, up to its end or its next substitution; where to go on."""
        m = _TEMPLATE.match(text, i)
        out.append(gap(m[0]))
        i = m.end()
        if text.startswith("${", i):
            stack.append("$")
            out.append(" (")
            return i + 2
        if i < len(text):
            out.append("`")
        return i + 1

    while m := _SCRIPT.search(text, at):
        out.append(text[at : m.start()])
        s, at = m[0], m.end()
        if s == "`":
            out.append("`")
            at = template(at)
        elif s == "{":
            stack.append("{")
            out.append(s)
        elif s == "}":
            if stack and stack.pop() == "$":
                out.append(")")
                at = template(at)
            else:
                out.append(s)
        elif s == "/":
            before = "".join(out[-8:])[-64:]
            r = _REGEX.match(text, m.start()) if _BEFORE_REGEX.search(before) else None
            out.append(gap(r[0]) if r else s)
            at = r.end() if r else at
        elif s[0] == "/":
            out.append(gap(s))
        else:
            out.append(gap(s[:-1]) + (s[-1] if len(s) > 1 and s[-1] == s[0] else " "))
    return "".join(out) + text[at:]


ID = r"[A-Za-z_$][\w$]*"
_TS_MOD = r"(?:(?:export|default|declare|abstract|async|public|private|protected|static|readonly|override|accessor|get|set)\s+)*"
_J_MOD = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|sealed|non-sealed|strictfp|transient|volatile)\s+)*"
_C_MOD = r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|virtual|override|async|extern|unsafe|new|required|ref|file|const|volatile)\s+)*"
_R_VIS = r"(?:pub(?:\s*\([^)]*\))?\s+)?"

#: language: [(kind, expression, where)], where is "any" or "class" (directly in a class-like body)
DECLARATIONS: dict[str, list[tuple[str, re.Pattern, str]]] = {}


def _decl(langs: str, rows: list[tuple[str, str, str]]) -> None:
    for lang in langs.split():
        DECLARATIONS.setdefault(lang, []).extend((k, re.compile(p, re.M), w) for k, p, w in rows)


_decl("javascript typescript tsx", [
    ("class", rf"(?<![\w$.]){_TS_MOD}class\s+(?P<name>{ID})", "any"),
    ("function", rf"(?<![\w$.]){_TS_MOD}function\s*\*?\s*(?P<name>{ID})\s*(?=[(<])", "any"),
    ("function", rf"(?<![\w$.])(?:export\s+)?(?:const|let|var)\s+(?P<name>{ID})\s*(?::[^=\n]*)?=\s*(?:async\s+)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{ID})\s*(?::[^=\n]*)?=>)", "any"),
    ("class", rf"(?<![\w$.])(?:export\s+)?(?:const|let|var)\s+(?P<name>{ID})\s*=\s*class\b", "any"),
    ("const", rf"^(?:export\s+)?(?:const|let)\s+(?P<name>{ID})\b", "top"),
    ("var", rf"^(?:export\s+)?var\s+(?P<name>{ID})\b", "top"),
    ("method", rf"(?:^|(?<=[{{;}}]))[ \t]*{_TS_MOD}\*?\s*(?P<name>#?{ID})\s*(?:<[^>\n]*>)?\s*\((?=[^;{{}}]*\)\s*(?::[^{{;=]*)?[{{;])", "class"),
    ("field", rf"(?:^|(?<=[{{;}}]))[ \t]*{_TS_MOD}(?P<name>#?{ID})\s*[?!]?\s*(?::[^=;\n(}}]*)?(?=[=;}}]|$)", "class"),
    ("method", rf"(?<=[{{,])\s*(?P<name>{ID})\s*:\s*(?:async\s+)?(?:function\b|(?:\([^()]*\)|{ID})\s*=>)", "any"),
    ("function", rf"^(?:module\.)?exports\.(?P<name>{ID})\s*=(?!=)", "any"),
])
_decl("typescript tsx", [
    ("interface", rf"(?<![\w$.]){_TS_MOD}interface\s+(?P<name>{ID})", "any"),
    ("type", rf"(?<![\w$.]){_TS_MOD}type\s+(?P<name>{ID})\s*(?:<[^=]*>)?\s*=", "any"),
    ("enum", rf"(?<![\w$.]){_TS_MOD}(?:const\s+)?enum\s+(?P<name>{ID})", "any"),
])
_decl("go", [
    ("function", r"^func\s+(?P<name>\w+)\s*(?=[(\[])", "any"),
    ("method", r"^func\s*\([^)]*\)\s*(?P<name>\w+)\s*\(", "any"),
    ("class", r"(?:^type\s+|^\s+)(?P<name>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+struct\s*(?=\{)", "any"),
    ("interface", r"(?:^type\s+|^\s+)(?P<name>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+interface\s*(?=\{)", "any"),
    ("type", r"^type\s+(?P<name>\w+)\b\s*=?\s*(?!struct\b|interface\b)[\w\[\]*.(]", "any"),
    ("const", r"^const\s+(?P<name>\w+)", "any"),
    ("var", r"^var\s+(?P<name>\w+)", "any"),
    ("field", r"(?:^[ \t]+|(?<=[{;])[ \t]*)(?P<name>[A-Za-z_]\w*)(?:\s*,\s*\w+)*[ \t]+[\w\[\]*.]+[^\n(:=;}]*(?=$|[;}])", "class"),
    ("field", r"(?<=,)[ \t]*(?P<name>[A-Za-z_]\w*)(?=(?:\s*,\s*\w+)*[ \t]+[\w\[\]*.]+[^\n(:=;}]*(?:$|[;}]))", "class"),
])
_decl("rust", [
    ("function", rf"(?<!\w){_R_VIS}(?:(?:const|async|unsafe|extern(?:\s*\"\s*\")?)\s+)*fn\s+(?P<name>\w+)", "any"),
    ("class", rf"(?<!\w){_R_VIS}(?:struct|union)\s+(?P<name>\w+)", "any"),
    ("enum", rf"(?<!\w){_R_VIS}enum\s+(?P<name>\w+)", "any"),
    ("interface", rf"(?<!\w){_R_VIS}(?:unsafe\s+)?trait\s+(?P<name>\w+)", "any"),
    ("type", rf"(?<!\w){_R_VIS}type\s+(?P<name>\w+)\s*(?:<[^=;]*>)?\s*=", "any"),
    ("module", rf"(?<!\w){_R_VIS}mod\s+(?P<name>\w+)\s*(?=\{{)", "any"),
    ("const", rf"(?<!\w){_R_VIS}const\s+(?P<name>[A-Z_]\w*)\s*:", "any"),
    ("var", rf"(?<!\w){_R_VIS}static\s+(?:mut\s+)?(?P<name>\w+)\s*:", "any"),
    ("class", r"^\s*(?:unsafe\s+)?impl(?:\s*<[^{]*?>)?\s+(?:[\w:<>, ']+\s+for\s+)?(?P<name>\w+)", "any"),
    ("function", r"(?<!\w)macro_rules!\s*(?P<name>\w+)", "any"),
    ("field", rf"(?:^[ \t]+|(?<=[{{,])[ \t]*){_R_VIS}(?P<name>[a-z_]\w*)\s*:(?!:)", "class"),
])
_decl("java", [
    ("class", rf"(?<![\w.]){_J_MOD}(?:class|record)\s+(?P<name>{ID})", "any"),
    ("interface", rf"(?<![\w.]){_J_MOD}@?interface\s+(?P<name>{ID})", "any"),
    ("enum", rf"(?<![\w.]){_J_MOD}enum\s+(?P<name>{ID})", "any"),
    ("method", rf"(?:^|(?<=[{{;}}]))[ \t]*{_J_MOD}(?:<[^>]*>\s*)?(?:[\w.]+(?:<[^;(){{}}]*>)?(?:\[\])*\s+)?(?P<name>{ID})\s*\((?=[^;{{}}]*\)\s*(?:throws[^{{;]*)?[{{;])", "class"),
    ("field", rf"(?:^|(?<=[{{;}}]))[ \t]*{_J_MOD}[\w.]+(?:<[^;(){{}}]*>)?(?:\[\])*\s+(?P<name>{ID})\s*(?=[=;,])", "class"),
])
_decl("csharp", [
    ("module", r"^\s*namespace\s+(?P<name>[\w.]+)", "any"),
    ("class", rf"(?<![\w.]){_C_MOD}(?:class|struct|record(?:\s+(?:class|struct))?)\s+(?P<name>{ID})", "any"),
    ("interface", rf"(?<![\w.]){_C_MOD}interface\s+(?P<name>{ID})", "any"),
    ("enum", rf"(?<![\w.]){_C_MOD}enum\s+(?P<name>{ID})", "any"),
    ("method", rf"(?:^|(?<=[{{;}}]))[ \t]*{_C_MOD}(?:[\w.]+(?:<[^;(){{}}]*>)?[\[\]?,]*\s+)?(?P<name>{ID})\s*(?:<[^>()]*>)?\s*\((?=[^;{{}}]*\)\s*(?:where[^{{;]*|:\s*(?:base|this)[^{{]*)?(?:[{{;]|=>))", "class"),
    ("field", rf"(?:^|(?<=[{{;}}]))[ \t]*{_C_MOD}[\w.]+(?:<[^;(){{}}]*>)?[\[\]?,]*\s+(?P<name>{ID})\s*(?=\{{|=[^=>]|;|=>)", "class"),
    ("const", rf"^[ \t]*(?P<name>{ID})\s*(?:=\s*[^,\n]+)?(?=,|\s*$|\s*\}})", "enum"),
])

#: Words before an opening bracket that are no call, and no name of a definition outside of a class body.
KEYWORDS = {
    "js": "if for while switch catch function return new typeof await yield super import delete void in of instanceof throw case else do with async",
    "go": "if for switch select func return go defer range case interface struct map chan var const type import package else",
    "rs": "if for while loop match return fn in as mut ref move where impl dyn let else unsafe use mod pub crate",
    "c": "if for while switch catch return new super this synchronized assert throw else do try instanceof case",
    "cs": "if for foreach while switch catch return new base this lock using fixed sizeof typeof nameof when checked unchecked default stackalloc is not and or in out throw await yield else do case where",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}
CLASSLIKE = ("class", "interface", "enum")
FAMILY = {"javascript": "js", "typescript": "js", "tsx": "js", "go": "go", "rust": "rs", "java": "c", "csharp": "cs"}


def scan_braces(text: str, lang: str) -> Captures:
    family = FAMILY[lang]
    clean, words = blank_script(text) if family == "js" else blank(text, _TOKENS[family]), KEYWORDS[family]
    pairs = match_brackets(clean)
    bodies = {}  # opening brace of a body -> kind of its owner
    out = Captures()

    def end_of(at: int) -> tuple[int, int]:
        """(end, opening brace or -1) of the declaration whose head is before ``at``."""
        i = at
        while i < len(clean):
            c = clean[i]
            if c == "{":
                z = pairs.get(i, len(clean) - 1)
                return z + 1, i
            if c in "([":
                i = pairs.get(i, i)
            elif c == ";" or (c == "\n" and lang in ("go", "javascript", "typescript", "tsx") and not re.match(r"\s*[{.=?:&|,]", clean[i:]) and clean[:i].rstrip()[-1:] not in list("=,+-*/&|?:(<")):
                return (i + 1 if c == ";" else i), -1
            elif c == "}":
                return i, -1
            i += 1
        return len(clean), -1

    depth_at = sorted((a, z) for a, z in pairs.items() if clean[a] == "{")
    opens = [a for a, _ in depth_at]

    def owner(at: int) -> int:
        """Opening brace of the innermost braces around a position, -1 at the top."""
        k = bisect.bisect_right(opens, at) - 1
        while k >= 0 and depth_at[k][1] < at:
            k -= 1
        return opens[k] if k >= 0 else -1

    rows = DECLARATIONS[lang]
    for phase in ("any", "top", "class", "enum"):
        for kind, rx, where in rows:
            if where != phase:
                continue
            for m in rx.finditer(clean):
                name, at = m["name"], m.start("name")
                if name in words and where not in ("enum", "class"):
                    continue  # directly in a class body every name is a member's
                own = bodies.get(owner(at))
                if where == "class" and own not in CLASSLIKE or where == "enum" and own != "enum" or where == "top" and owner(at) != -1:
                    continue
                if where == "class" and lang in ("java", "csharp") and own == "enum" and kind == "field":
                    continue
                start = m.start() + len(m[0]) - len(m[0].lstrip(" \t\r\n,{"))
                if re.match(r"(?:return|throw|else|await|yield|new)\b", clean[start:]):
                    continue
                end, brace = end_of(m.end())
                if brace >= 0 and kind in (*CLASSLIKE, "module"):
                    bodies[brace] = kind
                if lang == "csharp" and kind == "module" and brace < 0:
                    end = len(text)
                out.defs.append(Def(kind, name, start, end, start))
    named = {d.start for d in out.defs} | {m for d in out.defs for m in [clean.find(d.name, d.start, d.end)]}
    for m in re.finditer(rf"(?<![\w$])(?P<new>new\s+)?(?:(?P<recv>(?:[\w$]+|\)|\]|\?)(?:\s*(?:\.|::|\?\.|->)\s*[\w$]+)*)\s*(?:\.|::|\?\.)\s*)?(?P<name>#?{ID}!?)\s*(?:<[\w, .<>\[\]?]*>)?\s*(?=\()", clean):
        name, at = m["name"], m.start("name")
        if name in words and not (m["recv"] and family == "js") or at in named or (name.endswith("!") and lang != "rust"):
            continue
        if lang == "go" and bodies.get(owner(at)) == "interface":
            continue  # a method that an interface asks for
        if m["new"]:
            out.refs.append(Ref("instantiates", name, at))
        else:
            out.refs.append(Ref("call", name.rstrip("!"), at, None if m["recv"] in words else m["recv"]))
    if lang == "rust":
        for m in re.finditer(r"(?<!\w)(?P<name>[a-z_]\w*)!\s*[\[{]", clean):
            out.refs.append(Ref("call", m["name"], m.start("name")))
        for m in re.finditer(r"(?m)^\s*(?:unsafe\s+)?impl(?:\s*<[^{]*?>)?\s+(?:\w+::)*(?P<name>\w+)(?:<[^{]*?>)?\s+for\s", clean):
            out.refs.append(Ref("implements", m["name"], m.start("name")))
    if lang in ("go", "rust"):
        for m in re.finditer(r"(?<![\w.])&?(?:\w+(?:\.|::))?(?P<name>[A-Z]\w*)\s*(?=\{)", clean):
            if m.start("name") not in named and not re.search(r"(?:struct|enum|trait|impl|interface|for|->|mod|union)\s*$", clean[max(0, m.start() - 12) : m.start()]):
                out.refs.append(Ref("instantiates", m["name"], m.start("name")))
    for d in out.defs:
        if d.kind not in CLASSLIKE:
            continue
        head = clean[d.start : clean.find("{", d.start, d.end) if clean.find("{", d.start, d.end) >= 0 else d.end]
        for word, kind in (("extends", "extends"), ("implements", "implements")):
            for m in re.finditer(rf"\b{word}\s+((?:[\w$.]+(?:<[^{{]*?>)?\s*,?\s*)+)", head):
                for n in re.finditer(rf"(?:^|,)\s*(?:[\w$]+\.)*(?P<name>(?!implements\b|extends\b){ID})", re.sub(r"<[^<>]*>", lambda g: " " * len(g[0]), m[1])):
                    out.refs.append(Ref(kind, n["name"], d.start + m.start(1) + n.start("name")))
        if lang == "csharp" and (m := re.search(r":\s*([^{]+?)(?:\bwhere\b|$)", head)):
            for n in re.finditer(rf"(?:^|,)\s*(?:\w+\.)*(?P<name>{ID})", re.sub(r"<[^<>]*>|\([^()]*\)", lambda g: " " * len(g[0]), m[1])):
                out.refs.append(Ref("extends", n["name"], d.start + m.start(1) + n.start("name")))
    marks = r"(?m)^\s*\[(?P<name>\w+)|(?<=,)\s*(?P<more>\w+)(?=\s*[(\]])" if lang == "csharp" else rf"(?<![\w$])@(?!interface\b)(?:\w+\.)*(?P<name>{ID})" if lang in ("java", "javascript", "typescript", "tsx") else None
    if marks:
        for m in re.finditer(marks if lang != "csharp" else r"(?m)^\s*\[(?P<name>\w+)", clean):
            out.refs.append(Ref("decorates", m["name"], m.start("name")))
    types = {"typescript": rf":\s*(?P<name>[A-Z][\w$]*)", "tsx": rf":\s*(?P<name>[A-Z][\w$]*)", "java": rf"(?<![\w@.])(?P<name>[A-Z]\w*)(?=(?:<[^;(){{}}]*>)?(?:\[\])*\s+{ID}\s*[=;,)(])", "csharp": rf"(?<=[(,])\s*(?P<name>[A-Z]\w*)(?=(?:<[^;(){{}}]*>)?[\[\]?]*\s+{ID}\s*[,)=])", "go": r"(?<=[\w*\])])\s+\*?(?:\w+\.)?(?P<name>[A-Z]\w*)(?=\s*[,)\n`])", "rust": r"(?<![\w:])(?:\w+::)*(?P<name>[A-Z]\w*)(?=\s*[<,>;)=&\n{])"}.get(lang)
    if types:
        for m in re.finditer(types, clean):
            if lang == "rust" and bodies.get(owner(m.start("name"))) == "enum":
                continue  # a variant
            if m.start("name") not in named:
                out.refs.append(Ref("type", m["name"], m.start("name")))
    out.imports = _IMPORTS[lang](text, clean)
    inside = [(i.at, text.find("\n", i.at)) for i in out.imports]
    if lang == "go":
        fields = sorted((d for d in out.defs if d.kind == "field"), key=lambda d: d.start)
        for a, b in zip(fields, fields[1:]):
            if b.start < a.end:  # several names of one declaration share its range
                b.start, b.end = a.start, a.end
        out.defs = [d for d in out.defs if not any(a <= d.start < z for a, z in inside)]
    return out


def _script_imports(text: str, clean: str) -> list[Import]:
    out = []
    for m in re.finditer(r"(?m)(?<![\w$.])(?:import|export)\s+(?P<what>[^;'\"()]*?)\s*(?:from\s*)?(?P<q>['\"])(?P<spec>[^'\"\n]+)(?P=q)", text):
        if not clean[m.start() : m.start() + 6].strip():
            continue
        what, at, spec = re.sub(r"^type\s+", "", m["what"].strip()), m.start("spec"), m["spec"]
        if not what or what == "*":
            out.append(Import(spec, None, None, at))
            continue
        for n in re.finditer(r"\*\s+as\s+([\w$]+)", what):
            out.append(Import(spec, None, n[1], at))
        if braces := re.search(r"\{([^}]*)\}", what):
            for part in filter(None, (x.strip() for x in braces[1].split(","))):
                s, _, a = re.sub(r"^type\s+", "", part).partition(" as ")
                out.append(Import(spec, s.strip(), (a or s).strip(), at))
        if first := re.match(r"([\w$]+)\s*(?:,|$)", what):
            out.append(Import(spec, "default", first[1], at))
    for m in re.finditer(r"(?:(?:const|let|var)\s+(?P<to>[\w$]+|\{[^}]*\})\s*=\s*)?(?:await\s+)?(?<![\w$.])(?:require|import)\s*\(\s*(?P<q>['\"`])(?P<spec>[^'\"`\n]+)(?P=q)\s*\)", text):
        if not clean[m.start() : m.start() + 3].strip():
            continue
        to, at = m["to"], m.start("spec")
        if to and to.startswith("{"):
            for part in filter(None, (x.strip() for x in to[1:-1].split(","))):
                s, _, a = part.partition(":")
                out.append(Import(m["spec"], s.strip(), (a or s).strip(), at))
        else:
            out.append(Import(m["spec"], None, to, at))
    return out


def _go_imports(text: str, clean: str) -> list[Import]:
    out = []
    for m in re.finditer(r"(?m)^import\s*(?:\((?P<many>.*?)\)|(?P<one>[^\n]*))", text, re.S):
        part, base = (m["many"], m.start("many")) if m["many"] is not None else (m["one"].split("\n")[0], m.start("one"))
        for n in re.finditer(r"(?P<alias>[\w.]+\s+)?\"(?P<spec>[^\"\n]+)\"", part):
            out.append(Import(n["spec"], None, (n["alias"] or n["spec"].rsplit("/", 1)[-1]).strip(), base + n.start("spec")))
    return out


def _rust_imports(text: str, clean: str) -> list[Import]:
    out = []

    def tree(prefix: str, body: str, at: int) -> None:
        depth, part, parts = 0, "", []
        for c in body:
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(part)
                part = ""
            else:
                part += c
        for p in filter(None, (x.strip() for x in [*parts, part])):
            if "{" in p:
                head, _, rest = p.partition("{")
                tree(prefix + head.strip(), rest.rsplit("}", 1)[0], at)
                continue
            path, _, alias = p.partition(" as ")
            full = (prefix + path.strip()).strip()
            spec, _, symbol = full.rpartition("::")
            if symbol == "*":
                out.append(Import(spec, None, None, at))
            elif symbol == "self":
                out.append(Import(spec, None, alias.strip() or spec.rsplit("::", 1)[-1], at))
            elif spec:
                out.append(Import(spec, symbol, alias.strip() or symbol, at))
            else:
                out.append(Import(full, None, alias.strip() or full, at))

    for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<body>[^;]+);", clean):
        tree("", re.sub(r"\s+", " ", m["body"]), m.start("body"))
    for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)\s*;", clean):
        out.append(Import(m["name"], None, m["name"], m.start("name")))
    return out


def _java_imports(text: str, clean: str) -> list[Import]:
    return [Import(m["spec"], None if m["all"] else (last := m["spec"].rsplit(".", 1)[-1]), None if m["all"] else last, m.start("spec")) for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?(?P<spec>[\w.]+?)(?P<all>\.\*)?\s*;", clean)]


def _csharp_imports(text: str, clean: str) -> list[Import]:
    return [Import(m["spec"], None, m["alias"] or m["spec"].rsplit(".", 1)[-1], m.start("spec")) for m in re.finditer(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<spec>[\w.]+)\s*;", clean)]


_IMPORTS = {"javascript": _script_imports, "typescript": _script_imports, "tsx": _script_imports, "go": _go_imports, "rust": _rust_imports, "java": _java_imports, "csharp": _csharp_imports}


def scan_python(text: str) -> Captures:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_lines(text)
    raw = text.splitlines(keepends=True)
    begin = [0]
    for line in raw:
        begin.append(begin[-1] + len(line))
    ascii_only = text.isascii()

    def pos(line: int, col: int) -> int:
        own = raw[line - 1] if line <= len(raw) else ""
        return begin[line - 1] + (col if ascii_only else len(own.encode()[:col].decode(errors="ignore")))

    out = Captures()

    def name_of(e) -> tuple[str | None, str | None]:
        if isinstance(e, ast.Name):
            return e.id, None
        if isinstance(e, ast.Attribute):
            return e.attr, ast.get_source_segment(text, e.value) or ""
        if isinstance(e, ast.Subscript):
            return name_of(e.value)
        return None, None

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            head = pos(node.lineno, node.col_offset)
            first = min([head, *(pos(d.lineno, d.col_offset) - 1 for d in node.decorator_list)])
            out.defs.append(Def(kind, node.name, first, pos(node.end_lineno, node.end_col_offset), head))
            for d in node.decorator_list:
                n, _ = name_of(d.func if isinstance(d, ast.Call) else d)
                if n:
                    out.refs.append(Ref("decorates", n, pos(d.lineno, d.col_offset)))
            for b in getattr(node, "bases", []):
                n, _ = name_of(b)
                if n:
                    out.refs.append(Ref("extends", n, pos(b.lineno, b.col_offset)))
            args = getattr(node, "args", None)
            notes = [a.annotation for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg] if a and a.annotation] + [node.returns] if args else []
            for n in filter(None, notes):
                out.refs += [Ref("type", t.id, pos(t.lineno, t.col_offset)) for t in ast.walk(n) if isinstance(t, ast.Name)]
            if kind == "class":
                for s in node.body:
                    if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                        out.defs.append(Def("field", s.target.id, pos(s.lineno, s.col_offset), pos(s.end_lineno, s.end_col_offset)))
                        out.refs += [Ref("type", t.id, pos(t.lineno, t.col_offset)) for t in ast.walk(s.annotation) if isinstance(t, ast.Name)]
        elif isinstance(node, ast.Call):
            n, recv = name_of(node.func)
            if n:
                out.refs.append(Ref("call", n, pos(node.lineno, node.col_offset), recv))
        elif isinstance(node, ast.Import):
            for a in node.names:
                out.imports.append(Import(a.name, None, a.asname or a.name.split(".")[0], pos(node.lineno, node.col_offset)))
        elif isinstance(node, ast.ImportFrom):
            spec = "." * node.level + (node.module or "")
            for a in node.names:
                star = a.name == "*"
                out.imports.append(Import(spec, None if star else a.name, spec.split(".")[0] or None if star else a.asname or a.name, pos(node.lineno, node.col_offset)))
    for s in tree.body:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
        for t in targets:
            for e in t.elts if isinstance(t, ast.Tuple) else [t]:
                if isinstance(e, ast.Name):
                    out.defs.append(Def("const", e.id, pos(s.lineno, s.col_offset), pos(s.end_lineno, s.end_col_offset)))
    return out


def _python_by_lines(text: str) -> Captures:
    """A broken file: definitions by indentation, imports and calls by expressions."""
    out = Captures()
    lines = text.split("\n")
    begin = [0]
    for line in lines:
        begin.append(begin[-1] + len(line) + 1)
    for i, line in enumerate(lines):
        if m := re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line):
            z = i + 1
            while z < len(lines) and (not lines[z].strip() or len(lines[z]) - len(lines[z].lstrip()) > len(m[1])):
                z += 1
            out.defs.append(Def("class" if m[2] == "class" else "function", m[3], begin[i] + len(m[1]), min(begin[z] - 1, len(text))))
        elif m := re.match(r"\s*from\s+([\w.]+)\s+import\s+([\w, ]+)", line):
            out.imports += [Import(m[1], s.split(" as ")[0].strip(), s.split(" as ")[-1].strip(), begin[i]) for s in m[2].split(",") if s.strip()]
        elif m := re.match(r"\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?", line):
            out.imports.append(Import(m[1], None, m[2] or m[1].split(".")[0], begin[i]))
        else:
            out.refs += [Ref("call", c[2], begin[i] + c.start(2), c[1].rstrip(".") if c[1] else None) for c in re.finditer(r"((?:\w+\.)+)?(\w+)\(", line)]
    return out


LANDMARKS = ("article", "body", "footer", "form", "head", "header", "html", "main", "nav", "section", "script", "style")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Html(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.out, self.open = text, Captures(), []
        self.begin = [0]
        for line in text.split("\n"):
            self.begin.append(self.begin[-1] + len(line) + 1)
        self.feed(text)
        self.close()
        for _, start, defs in self.open:
            for d in defs:
                d.end = len(text)

    def _at(self) -> int:
        line, col = self.getpos()
        return self.begin[line - 1] + col

    def handle_starttag(self, tag, attrs):
        at, raw = self._at(), self.get_starttag_text() or ""
        names = ([tag] if tag in LANDMARKS else []) + [v for k, v in attrs if k == "id" and v]
        defs = [Def("element", n, at, at + len(raw)) for n in names]
        self.out.defs += defs
        for k, v in attrs:
            if k in ("href", "src") and v and tag in ("a", "link", "script", "img", "iframe"):
                self.out.imports.append(Import(v, None, None, at))
        if tag not in VOID and not raw.endswith("/>"):
            self.open.append((tag, at, defs))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                end = self.text.find(">", self._at()) + 1 or len(self.text)
                for _, _, defs in self.open[k:]:
                    for d in defs:
                        d.end = end
                del self.open[k:]
                return


def scan_html(text: str) -> Captures:
    return _Html(text).out


def scan_json(text: str) -> Captures:
    """Every object key, with the range of its pair."""
    out, clean = Captures(), blank(text, _TOKENS["c"])
    pairs = match_brackets(clean)
    for m in re.finditer(r"\"((?:\\.|[^\"\\\n])*)\"\s*:", text):
        end = m.end() + len(text[m.end() :]) - len(text[m.end() :].lstrip())
        if end < len(clean) and clean[end] in "{[":
            end = pairs.get(end, len(text) - 1) + 1
        else:
            z = re.compile(r"[,}\]\n]").search(clean, end)
            end = z.start() if z else len(text)
        out.defs.append(Def("key", m[1], m.start(), end))
    return out


def scan_css(text: str) -> Captures:
    out, clean = Captures(), blank(text, _TOKENS["c"])
    pairs = match_brackets(clean)
    for m in re.finditer(r"(?P<sel>[^{};]+)\{", clean):
        sel = m["sel"].strip()
        start = m.start("sel") + len(m["sel"]) - len(m["sel"].lstrip())
        if k := re.match(r"@(?:-\w+-)?keyframes\s+([\w-]+)", sel):
            sel = k[1]
        elif sel.startswith("@") or not sel or re.fullmatch(r"from|to|[\d.]+%", sel):
            continue
        out.defs.append(Def("rule", re.sub(r"\s+", " ", sel), start, pairs.get(m.end() - 1, len(text) - 1) + 1))
    return out


def scan_bash(text: str) -> Captures:
    out, clean = Captures(), blank(text, _TOKENS["sh"])
    pairs = match_brackets(clean)
    for m in re.finditer(r"(?m)^[ \t]*(?:function\s+(?P<a>[\w:.-]+)\s*(?:\(\s*\))?|(?P<b>[\w:.-]+)\s*\(\s*\))\s*(?=\{)", clean):
        at = clean.index("{", m.end())
        out.defs.append(Def("function", m["a"] or m["b"], m.start() + len(m[0]) - len(m[0].lstrip()), pairs.get(at, len(text) - 1) + 1))
    for m in re.finditer(r"(?m)^[ \t]*(?:export\s+|local\s+|readonly\s+|declare\s+(?:-\w+\s+)*)?(?P<name>[A-Za-z_]\w*)=", clean):
        z = clean.find("\n", m.end())
        out.defs.append(Def("var", m["name"], m.start("name"), z if z >= 0 else len(text)))
    words = set("if then else elif fi for while until do done case esac in function select time export local readonly declare return".split())
    for m in re.finditer(r"(?m)(?:^|[;|&(`]|\$\(|\bthen|\bdo|\belse)[ \t]*(?P<name>[A-Za-z_][\w.-]*)(?=\s|;|$|\))(?!\s*\()", clean):
        if m["name"] not in words:
            out.refs.append(Ref("call", m["name"], m.start("name")))
    return out


def scan(text: str, lang: str) -> Captures:
    """Captures of a text; languages without a scanner have none."""
    if lang in DECLARATIONS:
        return scan_braces(text, lang)
    own = {"python": scan_python, "html": scan_html, "json": scan_json, "css": scan_css, "bash": scan_bash}.get(lang)
    return own(text) if own else Captures()

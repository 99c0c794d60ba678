"""Sources of seven languages with what must be found in them, specifiers with what they may mean, ignore rules with what they hide."""

from __future__ import annotations

#: language: (ending, source, rows (record, kind or symbol, name or specifier, owner or alias, line)); {k} is a number.
SOURCES: dict[str, tuple[str, str, list[tuple]]] = {
    "javascript": (
        ".js",
        "import { q{k} } from './q{k}.js';\nconst { a: b{k} } = require('pkg{k}');\nclass Box{k} extends Base{k} { match(x) { return go{k}(x); } select() { return `v ${f{k}(1)} ${`${g{k}({ a: 2 })}`}`; } get size() { return 1; } }\nfunction range(n) { return /a{b(/.test(n) / 2; }\nconst use{k} = (a) => a.delete{k}(1);\nif (use{k}) { new Box{k}(); }\n",
        [
            ("def", "class", "Box{k}", "", 3), ("def", "method", "match", "Box{k}", 3), ("def", "method", "select", "Box{k}", 3), ("def", "method", "size", "Box{k}", 3),
            ("def", "function", "range", "", 4), ("def", "function", "use{k}", "", 5),
            ("ref", "call", "require", "", 2), ("ref", "extends", "Base{k}", "Box{k}", 3), ("ref", "call", "go{k}", "match", 3), ("ref", "call", "f{k}", "select", 3), ("ref", "call", "g{k}", "select", 3),
            ("ref", "call", "test", "range", 4), ("ref", "call", "delete{k}", "use{k}", 5), ("ref", "instantiates", "Box{k}", "", 6),
            ("import", "q{k}", "./q{k}.js", "q{k}", 1), ("import", "a", "pkg{k}", "b{k}", 2),
        ],
    ),
    "typescript": (
        ".ts",
        "import type { T{k} } from './t{k}';\nexport interface Shape{k} { area: number; scale(by: number): void }\nexport class Box{k} implements Shape{k} {\n  private n = 1;\n  move(a) { this.go{k}(a); }\n  where(x: T{k}) { return `${f{k}(x)}`; }\n}\nexport enum Kind{k} { A, B }\ntype Alias{k} = string;\nexport const run{k} = (x) => helper{k}(x);\n",
        [
            ("def", "interface", "Shape{k}", "", 2), ("def", "field", "area", "Shape{k}", 2), ("def", "method", "scale", "Shape{k}", 2),
            ("def", "class", "Box{k}", "", 3), ("def", "field", "n", "Box{k}", 4), ("def", "method", "move", "Box{k}", 5), ("def", "method", "where", "Box{k}", 6),
            ("def", "enum", "Kind{k}", "", 8), ("def", "type", "Alias{k}", "", 9), ("def", "function", "run{k}", "", 10),
            ("ref", "implements", "Shape{k}", "Box{k}", 3), ("ref", "call", "go{k}", "move", 5), ("ref", "type", "T{k}", "where", 6), ("ref", "call", "f{k}", "where", 6), ("ref", "call", "helper{k}", "run{k}", 10),
            ("import", "T{k}", "./t{k}", "T{k}", 1),
        ],
    ),
    "python": (
        ".py",
        "import os\nfrom .m{k} import a as b{k}\n\n\n@mark{k}\nclass Shop{k}(Base{k}):\n    size: Money{k} = 0\n\n    def get(self, x: Unit{k}):\n        return area{k}(x).sum()\n\n\ndef match(n):\n    return os.getcwd()\n\n\nLIMIT{k} = 3\n",
        [
            ("def", "class", "Shop{k}", "", 5), ("def", "field", "size", "Shop{k}", 7), ("def", "function", "get", "Shop{k}", 9), ("def", "function", "match", "", 13), ("def", "const", "LIMIT{k}", "", 17),
            ("ref", "decorates", "mark{k}", "Shop{k}", 5), ("ref", "extends", "Base{k}", "Shop{k}", 6), ("ref", "type", "Money{k}", "size", 7), ("ref", "type", "Unit{k}", "get", 9),
            ("ref", "call", "area{k}", "get", 10), ("ref", "call", "sum", "get", 10), ("ref", "call", "getcwd", "match", 14),
            ("import", "", "os", "os", 1), ("import", "a", ".m{k}", "b{k}", 2),
        ],
    ),
    "go": (
        ".go",
        "package p\n\nimport \"fmt\"\n\ntype Point{k} struct { X, Z int; Y string }\n\nfunc in(a int) int { return use{k}(a) }\n\nfunc (p *Point{k}) Match() {\n\tfmt.Println(p.X)\n}\n\ntype Shape{k} interface {\n\tArea() float64\n}\n\nvar Zero{k} = Point{k}{}\n",
        [
            ("def", "class", "Point{k}", "", 5), ("def", "field", "X", "Point{k}", 5), ("def", "field", "Z", "Point{k}", 5), ("def", "field", "Y", "Point{k}", 5),
            ("def", "function", "in", "", 7), ("def", "method", "Match", "", 9), ("def", "interface", "Shape{k}", "", 13), ("def", "var", "Zero{k}", "", 17),
            ("ref", "call", "use{k}", "in", 7), ("ref", "call", "Println", "Match", 10), ("ref", "instantiates", "Point{k}", "Zero{k}", 17), ("ref", "type", "Point{k}", "Match", 9),
            ("import", "", "fmt", "fmt", 3),
        ],
    ),
    "rust": (
        ".rs",
        "use std::fmt::{self, Display};\n\npub struct Point{k} { x: i32 }\n\nimpl Draw{k} for Point{k} {\n    fn is(&self) -> i32 { set{k}(self.x) }\n}\n\npub enum Kind{k} { A, B }\n\nfn range(n: i32) { println!(\"{}\", n); }\n",
        [
            ("def", "class", "Point{k}", "", 3), ("def", "field", "x", "Point{k}", 3), ("def", "class", "Point{k}", "", 5), ("def", "function", "is", "Point{k}", 6), ("def", "enum", "Kind{k}", "", 9), ("def", "function", "range", "", 11),
            ("ref", "implements", "Draw{k}", "Point{k}", 5), ("ref", "call", "set{k}", "is", 6), ("ref", "call", "println", "range", 11),
            ("import", "", "std::fmt", "fmt", 1), ("import", "Display", "std::fmt", "Display", 1),
        ],
    ),
    "java": (
        ".java",
        "package a.b;\n\nimport java.util.List;\nimport java.io.*;\n\npublic class Shop{k} extends Base{k} { private int n; public int get() { return helper{k}(n); } void is(Unit{k} s) { new Box{k}(); } }\n\ninterface Shape{k} { void run(); }\n",
        [
            ("def", "class", "Shop{k}", "", 6), ("def", "field", "n", "Shop{k}", 6), ("def", "method", "get", "Shop{k}", 6), ("def", "method", "is", "Shop{k}", 6), ("def", "interface", "Shape{k}", "", 8), ("def", "method", "run", "Shape{k}", 8),
            ("ref", "extends", "Base{k}", "Shop{k}", 6), ("ref", "call", "helper{k}", "get", 6), ("ref", "type", "Unit{k}", "is", 6), ("ref", "instantiates", "Box{k}", "is", 6),
            ("import", "List", "java.util.List", "List", 3), ("import", "", "java.io", "", 4),
        ],
    ),
    "csharp": (
        ".cs",
        "using System;\nusing IO = System.IO;\n\nnamespace N{k} { public class Shop{k} : Base{k} { public int Get() { return Helper{k}(1); } public string Name { get; set; } private int y; } }\n",
        [
            ("def", "module", "N{k}", "", 4), ("def", "class", "Shop{k}", "N{k}", 4), ("def", "method", "Get", "Shop{k}", 4), ("def", "field", "Name", "Shop{k}", 4), ("def", "field", "y", "Shop{k}", 4),
            ("ref", "extends", "Base{k}", "Shop{k}", 4), ("ref", "call", "Helper{k}", "Get", 4),
            ("import", "", "System", "System", 1), ("import", "", "System.IO", "IO", 2),
        ],
    ),
}

_ENDINGS = ("", ".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs")
#: (language, specifier, importing file, keys in order)
IMPORTS = [
    ("typescript", "./b", "web/a.ts", [f"web/b{e}" for e in _ENDINGS] + [f"web/b/index{e}" for e in _ENDINGS]),
    ("javascript", "@/x", "web/a.js", [f"src/x{e}" for e in _ENDINGS] + [f"src/x/index{e}" for e in _ENDINGS]),
    ("javascript", "react", "web/a.js", []),
    ("python", "..m", "a/b/c.py", ["a/m.py", "a/m/__init__.py", "a/m.pyi", "a.py", "a/__init__.py"]),
    ("python", "os.path", "a.py", []),
    ("java", "a.b.C", "x/Y.java", [f"{r}a/b/C.java" for r in ("src/main/java/", "src/test/java/", "src/main/kotlin/", "src/", "")] + [f"{r}a/b.java" for r in ("src/main/java/", "src/test/java/", "src/main/kotlin/", "src/", "")]),
    ("csharp", "A.B.C", "x.cs", ["ns:A.B.C", "ns:A.B", "ns:A"]),
    ("go", "example.com/mod/pkg/u", "m.go", ["dir:pkg/u"]),
    ("go", "fmt", "m.go", []),
    ("rust", "crate::net::tcp", "src/main.rs", ["src/net/tcp.rs", "src/net/tcp/mod.rs", "src/net/tcp/lib.rs", "src/net.rs", "src/net/mod.rs"]),
]

IGNORE_FRAMES = {"": ["*.log", "!keep.log", "/build/", "docs/**/tmp", "# note", "a?c.txt", "[xy].md", "deep/"], "pkg": ["!loud.log", "*.bin"], "pkg/in": ["/only"]}
IGNORED = [
    ("a.log", True), ("keep.log", False), ("pkg/loud.log", False), ("pkg/other.log", True), ("build/x", True), ("src/build/x", False), ("docs/tmp", True), ("docs/a/b/tmp", True), ("tmp", False),
    ("abc.txt", True), ("abbc.txt", False), ("x.md", True), ("z.md", False), ("s/deep/keep.log", True), ("deep", False), ("pkg/a.bin", True), ("a.bin", False), ("pkg/in/only", True), ("pkg/in/x/only", False), ("# note", False),
]

"""Technologies of a repository by its manifests: stacks, ecosystems, languages, frameworks, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import basename, dirname

#: stack: (ecosystem, languages, expression of manifest names)
STACKS = {
    "dotnet": ("nuget", ["csharp"], r"(?i)^(.*\.(csproj|fsproj|vbproj|sln)|global\.json|directory\.build\.props|nuget\.config)$"),
    "go": ("go", ["go"], r"^go\.mod$"),
    "java": ("maven", ["java"], r"^(pom\.xml|build\.gradle(\.kts)?|settings\.gradle)$"),
    "node": ("npm", ["javascript", "tsx", "typescript"], r"^package\.json$"),
    "php": ("composer", ["php"], r"^composer\.json$"),
    "python": ("pypi", ["python"], r"^(setup\.(py|cfg)|requirements\.txt|pyproject\.toml|Pipfile)$"),
    "ruby": ("rubygems", ["ruby"], r"^(Rakefile|Gemfile)$"),
    "rust": ("cargo", ["rust"], r"^Cargo\.toml$"),
}
#: (stack, framework, expression over the manifest's text)
FRAMEWORKS = [
    ("dotnet", "aspnet", r"(?i)microsoft\.net\.sdk\.web"), ("dotnet", "blazor", r"(?i)microsoft\.net\.sdk\.blazorwebassembly"), ("dotnet", "dotnet-tests", r"(?i)xunit|nunit|mstest"), ("dotnet", "entity-framework", r"(?i)microsoft\.entityframeworkcore"),
    ("java", "junit", r"(?i)junit"), ("java", "quarkus", r"(?i)quarkus"), ("java", "spring", r"(?i)spring-boot|springframework"),
    ("node", "angular", r'"@angular/core"\s*:'), ("node", "js-tests", r'"(jest|mocha|vitest)"\s*:'), ("node", "nextjs", r'"next"\s*:'), ("node", "node-server", r'"(express|fastify|@nestjs/core)"\s*:'), ("node", "react", r'"react(-dom)?"\s*:'), ("node", "svelte", r'"svelte"\s*:'), ("node", "vue", r'"vue"\s*:'),
    ("python", "django", r"(?i)\bdjango\b"), ("python", "fastapi", r"(?i)\bfastapi\b"), ("python", "flask", r"(?i)\bflask\b"), ("python", "ml", r"(?i)\b(jax|tensorflow|torch)\b"), ("python", "pytest", r"(?i)\bpytest\b"),
]
SKIP_DIRS = ("node_modules", "vendor", "dist", "build", "out", "target", ".git", "bin", "obj")


def stack_of(path: Column) -> Column:
    """Stack that a manifest belongs to; null for other files, files more than three directories down and those below skipped directories."""
    dirs = F.split(dirname(path), "/")
    deep = (dirname(path) != "") & (F.size(dirs) > 3)
    skipped = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS]))
    hit = F.coalesce(*[F.when(F.rlike(basename(path), F.lit(rx)), F.lit(s)) for s, (_, _, rx) in STACKS.items()])
    return F.when(~deep & ~skipped, hit)


def technologies(contents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., stack, ecosystem, languages, frameworks, evidence): from (path, text[, subproject]) rows; evidence has at most four manifests, by path."""
    keys = by or []
    m = contents.withColumn("stack", stack_of(F.col("path"))).where("stack is not null")
    fw = F.array_compact(F.array(*[F.when((F.col("stack") == s) & F.rlike(F.coalesce("text", F.lit("")), F.lit(rx)), F.lit(n)) for s, n, rx in FRAMEWORKS]))
    out = m.withColumn("fw", fw).groupBy(*keys, "stack").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("fw")))).alias("frameworks"), F.slice(F.sort_array(F.collect_set("path")), 1, 4).alias("evidence"))
    pick = lambda i, make: F.element_at(F.create_map(*[x for s, v in STACKS.items() for x in (F.lit(s), make(v[i]))]), F.col("stack"))
    return out.withColumns({"ecosystem": pick(0, F.lit), "languages": pick(1, lambda v: F.array(*[F.lit(x) for x in v]))})


def languages_present(files: DataFrame, tech: DataFrame) -> DataFrame:
    """Distinct languages that manifests or files show."""
    return tech.select(F.explode("languages").alias("lang")).unionByName(files.where("lang is not null").select("lang")).distinct()

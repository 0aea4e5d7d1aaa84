"""Structure of a source tree: resolved imports, languages, frameworks, entry points, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T

#: Keyword in the first 2,000 characters of a file, and the framework's label. Fixed values.
FRAMEWORK_HINTS = {
    "fastapi": "FastAPI", "flask": "Flask", "django": "Django", "express": "Express", "next": "Next.js", "react": "React", "spring": "Spring",
}
#: File names that start programs. Fixed values.
ENTRYPOINTS = ["main.py", "app.py", "server.py", "manage.py", "index.ts", "index.js"]
#: Tried in this order on a relative import. Fixed values.
SUFFIXES = ["", ".py", ".js", ".ts", ".jsx", ".tsx", "/__init__.py", "/index.js", "/index.ts", "/index.jsx", "/index.tsx"]


def module_index(files: DataFrame) -> DataFrame:
    """``module, target``: names under which files can be imported; of files that share a name the last one counts."""
    dotted = F.regexp_replace(F.replace("path", F.lit("/"), F.lit(".")), r"\.py$", "")
    python = F.array_compact(F.array(dotted, F.when(F.endswith(dotted, F.lit(".__init__")), F.regexp_replace(dotted, r"\.__init__$", ""))))
    clean = F.col("path")
    for ending in (".js", ".ts", ".jsx", ".tsx"):
        clean = F.replace(clean, F.lit(ending), F.lit(""))
    script = F.array(clean, F.concat(F.lit("./"), clean))
    names = F.when(F.col("lang") == "python", python).when(F.col("lang").isin("javascript", "typescript"), script)
    rows = files.select("path", "pos", F.explode(names).alias("module"))
    return rows.groupBy("module").agg(F.max_by("path", "pos").alias("target"))


def _relative_base(source: Column, name: Column) -> Column:
    """Where a relative import starts to look: the source's folder, or its parent for ``../``."""
    parts = F.split(source, "/")
    up = lambda n: F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(0))), "/")
    join = lambda folder, rest: F.when(folder == "", rest).when(rest == "", folder).otherwise(F.concat(folder, F.lit("/"), rest))
    return (
        F.when(F.startswith(name, F.lit("./")), join(up(1), F.substring(name, 3, 10_000)))
        .when(F.startswith(name, F.lit("../")), join(up(2), F.substring(name, 4, 10_000)))
        .otherwise(join(up(1), F.substring(name, 2, 10_000)))
    )


def resolve_imports(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The import graph ``src, dep, is_internal, ord``: each source's distinct targets in the order first seen.

    A name is looked up among modules, then, if relative, among paths with the suffixes above, the first hit
    counting; what is not found stays as it is. Imports come with symbols, so a file without symbols has none.
    """
    raw = symbols.select(F.col("path").alias("src"), "start_line", "ord", F.posexplode("imports").alias("k", "name"))
    raw = raw.where("name <> ''").groupBy("src", "name").agg(F.min(F.struct("ord", "k")).alias("at"))
    known = raw.join(module_index(files).withColumnRenamed("module", "name"), "name", "left")
    tried = known.where(F.col("target").isNull() & F.startswith("name", F.lit("."))).select(
        "src", "name", F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(_relative_base(F.col("src"), F.col("name")), s))).alias("rank", "candidate")
    )
    paths = files.select(F.col("path").alias("candidate"))
    found = tried.join(paths, "candidate").groupBy("src", "name").agg(F.min_by("candidate", "rank").alias("file"))
    placed = known.join(found, ["src", "name"], "left").withColumn("dep", F.coalesce("target", "file", "name"))
    internal = F.coalesce("target", "file").isNotNull()
    first = placed.groupBy("src", "dep").agg(F.min("at").alias("at"), F.bool_or(internal).alias("is_internal"))
    order = F.row_number().over(_by_source())
    return first.withColumn("ord", order.cast("long")).select("src", "dep", "is_internal", "ord")


def _by_source():
    from pyspark.sql import Window

    return Window.partitionBy("src").orderBy("at", "dep")


def language_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("lang").agg(F.count("*").alias("n"))


def top_components(files: DataFrame, most: int = 12) -> DataFrame:
    """``component, n``: the components with most files; of equals the one first seen."""
    counted = files.groupBy(T.component("path").alias("component")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(most).select("component", "n")


def framework_hints(files: DataFrame, hints: dict[str, str] = FRAMEWORK_HINTS, chars: int = 2000) -> DataFrame:
    """``label`` of each keyword that any file holds in its first ``chars`` characters, case ignored; one scan."""
    head = F.lower(F.left("text", F.lit(chars)))
    flags = files.agg(*[F.coalesce(F.bool_or(F.contains(head, F.lit(k))), F.lit(False)).alias(k) for k in hints])
    pairs = F.array(*[F.when(F.col(k), F.lit(v)) for k, v in hints.items()])
    return flags.select(F.explode(F.array_distinct(F.array_compact(pairs))).alias("label"))


def entrypoints(files: DataFrame) -> DataFrame:
    """``path`` of files that start programs, by name or by a Python main guard."""
    name = F.element_at(F.split("path", "/"), -1)
    guard = (F.col("lang") == "python") & F.contains("text", F.lit('if __name__ == "__main__"'))
    return files.where(name.isin(ENTRYPOINTS) | guard).select("path")

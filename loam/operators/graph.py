"""The code graph as two tables, and reachability over it by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.lineage import release, settle, stage


def file_id(path: Column | str) -> Column:
    return F.concat(F.lit("file:"), T.c(path))


def build_nodes(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``id, kind, label, meta``: files, symbols, and the external modules that imports name."""
    own = files.select(file_id("path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("label"), F.create_map(F.lit("lang"), "lang").alias("meta"))
    named = symbols.select("id", "kind", F.col("name").alias("label"), F.create_map(F.lit("path"), "path").alias("meta"))
    external = imports.where("not is_internal").select("dep").distinct()
    none = F.create_map().cast("map<string,string>")
    outside = external.select(F.concat(F.lit("external:"), "dep").alias("id"), F.lit("external").alias("kind"), F.col("dep").alias("label"), none.alias("meta"))
    return own.unionByName(named.dropDuplicates(["id"])).unionByName(outside)


def resolve_calls(symbols: DataFrame) -> DataFrame:
    """``src, dst, ord``: calls to the one symbol of that name in the same file, else to the one of that name anywhere.

    Names that several symbols share stay unresolved, and calls to oneself are dropped.
    """
    local = symbols.groupBy("path", "name").agg(F.min("id").alias("local"), F.countDistinct("id").alias("n")).where("n = 1").drop("n")
    wide = symbols.groupBy("name").agg(F.min("id").alias("wide"), F.countDistinct("id").alias("n")).where("n = 1").drop("n")
    calls = symbols.select(F.col("id").alias("src"), "path", F.posexplode("calls").alias("ord", "name"))
    ids = symbols.select(F.col("id").alias("exact")).distinct()
    found = calls.join(local, ["path", "name"], "left").join(wide, "name", "left").join(ids, F.col("name") == F.col("exact"), "left")
    return found.select("src", F.coalesce("exact", "local", "wide").alias("dst"), "ord").where("dst is not null and dst <> src")


def build_edges(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``src, dst, edge_type, ord``: defines, imports and calls. A multigraph: repeated calls stay."""
    defines = symbols.select(file_id("path").alias("src"), F.col("id").alias("dst"), F.lit("defines").alias("edge_type"), F.col("ord").cast("long").alias("ord"))
    target = F.when(F.col("is_internal"), file_id("dep")).otherwise(F.concat(F.lit("external:"), "dep"))
    imported = imports.select(file_id("src").alias("src"), target.alias("dst"), F.lit("imports").alias("edge_type"), "ord")
    called = resolve_calls(symbols).select("src", "dst", F.lit("calls").alias("edge_type"), F.col("ord").cast("long").alias("ord"))
    return defines.unionByName(imported).unionByName(called)


def referential(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def successors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst``, each once, of the given nodes (``id``)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct()


def reach(edges: DataFrame, seeds: DataFrame, forward: bool = True, hops: int = 8) -> DataFrame:
    """``seed, node``: all nodes that each seed (``id``) reaches, or is reached from, itself left out.

    The first ``hops`` rounds follow edges from the seeds, which is all that shallow graphs need. If there is more,
    nodes on a cycle are taken together, and from then on each round also composes the ways of m steps to ways of 2m: the
    distance covered doubles, and rounds grow with the logarithm of the depth. Rounds are tables in the folder that
    spark.checkpoint.dir names, deleted as soon as no later one reads them; the only thing that comes back is whether a
    round found anything.
    """
    ways = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if forward else edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    ways = stage(ways.where("a <> b").distinct())
    found = [stage(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node")).distinct())]
    for _ in range(hops):
        if not _further(found, found[-1], ways):
            break
    else:
        deep = settle(_doubled(edges, ways, found))
        release(ways, *found)
        return deep
    pairs = settle(reduce(DataFrame.unionAll, found))
    release(ways, *found)
    return pairs.where(F.col("node") != F.col("seed"))


def _further(found: list[DataFrame], front: DataFrame, ways: DataFrame) -> bool:
    """Append what ``ways`` lead to from ``front`` and none of ``found`` holds; whether there is any.

    Both joins shuffle: a round's tables are small enough to broadcast for long, and each broadcast passes the driver.
    """
    step = front.join(ways.hint("shuffle_merge"), F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
    found.append(stage(step.join(reduce(DataFrame.unionAll, found).hint("shuffle_merge"), ["seed", "node"], "left_anti")))
    return not found[-1].isEmpty()


def _doubled(edges: DataFrame, ways: DataFrame, near: list[DataFrame]) -> DataFrame:
    """``seed, node``: what :func:`reach` returns, from the pairs that its first rounds found."""
    parts = strong_components(edges)

    def of(df: DataFrame, c: str) -> DataFrame:
        """The column's nodes replaced by what stands for their component."""
        known = df.join(parts.select(F.col("node").alias(c), F.col("scc").alias("_scc")), c, "left")
        return known.withColumn(c, F.coalesce("_scc", c)).select(*df.columns)

    begun = stage(of(near[0].select("seed", F.col("node").alias("start")), "start"))
    jump = stage(of(of(ways, "a"), "b").where("a <> b").distinct())
    firsts = of(of(reduce(DataFrame.unionAll, near), "seed"), "node").distinct()
    found = [stage(firsts)]
    while _further(found, reduce(DataFrame.unionAll, found), jump):
        ends = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jump, before = stage(jump.join(ends, "b").select("a", F.col("c").alias("b")).distinct()), jump
        release(before)
    inside = parts.select(F.col("scc").alias("node"), F.col("node").alias("member"))
    pairs = reduce(DataFrame.unionAll, found).withColumnRenamed("seed", "start")
    whole = begun.join(pairs, "start").join(inside, "node", "left").select("seed", F.coalesce("member", "node").alias("node"))
    out = stage(whole.where(F.col("node") != F.col("seed")))
    release(jump, begun, *found)
    return out


def ancestors(edges: DataFrame, seeds: DataFrame, hops: int = 8) -> DataFrame:
    return reach(edges, seeds, False, hops)


def descendants(edges: DataFrame, seeds: DataFrame, hops: int = 8) -> DataFrame:
    return reach(edges, seeds, True, hops)


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, scc``: nodes on a cycle, with the smallest node of their strongly connected component.

    The graph is reduced first: nodes without a way in or out leave, and runs of nodes with one way in and one way out
    become single edges, found by doubling pointers. Then each pass gives every node the smallest node that reaches it
    as its colour; a node of its own colour is the smallest of its component, which is what reaches it inside that
    colour. Found components leave, edges between colours too, and the rest is reduced again. At the end runs are laid
    out in reverse: a run lies in a component if both its ends do. Tables hold one row a node or edge, never pairs of
    nodes.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("scc")).distinct()
    runs: list[DataFrame] = []
    core, found = _reduced(edges.where("src <> dst").select("src", "dst").distinct(), runs)
    while not core.isEmpty():
        colour = stage(core.select(F.col("src").alias("node"), F.col("src").alias("scc")).distinct())
        moved = colour
        while not moved.isEmpty():
            got = moved.join(core, moved["node"] == core["src"]).groupBy("dst").agg(F.min("scc").alias("got"))
            better = F.coalesce(F.col("got") < F.col("scc"), F.lit(False)).alias("new")
            colour, before = stage(colour.join(got, colour["node"] == got["dst"], "left").select("node", F.least("scc", "got").alias("scc"), better)), colour
            release(before)
            moved = colour.where("new").select("node", "scc")
        ends = colour.select(F.col("node").alias("dst"), F.col("scc").alias("to"))
        inside = stage(core.join(colour.select(F.col("node").alias("src"), "scc"), "src").join(ends, "dst").where("scc = to").select("src", "dst", "scc"))
        seen = front = stage(colour.where("node = scc").select("node", "scc"))
        while not front.isEmpty():
            step = inside.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "scc").distinct()
            front, old = stage(step.join(seen, "node", "left_anti")), (front, seen)
            seen = stage(seen.unionByName(front))
            release(*old)
        large = seen.where("node <> scc").select("scc").distinct()
        found = settle(found.unionByName(seen.join(large, "scc", "left_semi").select("node", "scc")))
        gone = seen.select(F.col("node").alias("src"))
        rest = inside.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")
        (core, whole), old = _reduced(rest, runs), (core, colour, inside, seen, front)
        found = settle(found.unionByName(whole))
        release(*old)
    release(core)
    for run in reversed(runs):
        a, b = (found.select(F.col("node").alias(c), F.col("scc").alias(f"{c}_scc")) for c in ("a", "b"))
        ends = run.where("not closed").drop("scc").join(a, "a", "left").join(b, "b", "left")
        own = ends.where("a = b or a_scc = b_scc").select("node", "a", F.coalesce("a_scc", "a").alias("scc"))
        found, old = stage(found.unionByName(own.select("node", "scc")).unionByName(own.select(F.col("a").alias("node"), "scc")).distinct()), found
        release(old, run)
    least = found.groupBy("scc").agg(F.min("node").alias("least"))
    named = found.join(least, "scc").select("node", F.col("least").alias("scc"))
    return named.unionByName(loops).groupBy("node").agg(F.min("scc").alias("scc"))


def _reduced(edges: DataFrame, runs: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The edges without what cannot lie on a cycle and with runs as single edges; and ``node, scc`` of cycles that are one run.

    Appends to ``runs`` what :func:`_runs` found; of those cycles the result still reads them.
    """
    core, before, found = stage(edges), -1, []
    while (n := core.count()) and n != before:
        into = core.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("a"))
        out = core.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("b"))
        nodes = stage(into.join(out, "node").select("node", F.when((F.col("n_in") == 1) & (F.col("n_out") == 1), F.struct("a", "b")).alias("thin")))
        end = lambda c: nodes.select(F.col("node").alias(c))
        inner = stage(nodes.where("thin is not null").select("node", "thin.*").join(end("a"), "a", "left_semi").join(end("b"), "b", "left_semi"))
        kept = core.join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi").select("src", "dst")
        thin, before = inner.count(), n
        if thin:
            ended = _runs(inner, thin)
            run = ended.where("not closed")
            held = inner.select("node")
            kept = kept.join(held.select(F.col("node").alias("src")), "src", "left_anti").join(held.select(F.col("node").alias("dst")), "dst", "left_anti")
            kept = kept.select("src", "dst").unionByName(run.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()
            runs.append(ended)
            found.append(ended.where("closed").select("node", "scc"))
            before = -1
        core, old = stage(kept), core
        release(old, nodes, inner)
    none = core.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)
    return core, reduce(DataFrame.unionByName, found, none)


def _runs(thin: DataFrame, n: int) -> DataFrame:
    """``node, a, b, scc, closed`` of ``n`` nodes with one way in (``a``) and one out (``b``), at first to their neighbours.

    Pointers are doubled, twice a round, until they lead out of the run, to the nodes before and behind it; those of a
    ``closed`` run never do, and after enough steps for all nodes have met its smallest one (``scc``).
    """
    at, covered = thin.select("node", "a", "b", F.col("node").alias("scc")), 1
    while covered <= 2 * n:
        before = at
        for _ in range(2):
            back = at.select(F.col("node").alias("a"), F.col("a").alias("aa"))
            ahead = at.select(F.col("node").alias("b"), F.col("b").alias("bb"), F.col("scc").alias("least"))
            both = at.join(back, "a", "left").join(ahead, "b", "left")
            more = F.col("aa").isNotNull() | F.col("bb").isNotNull()
            at = both.select("node", F.coalesce("aa", "a").alias("a"), F.coalesce("bb", "b").alias("b"), F.least("scc", F.coalesce("least", "scc")).alias("scc"), more.alias("closed"))
        at, covered = stage(at), covered * 4
        release(before)
        if at.where("closed").isEmpty():
            break
    return at


def simple_cycles(edges: DataFrame) -> DataFrame:
    """``cycle``: all simple cycles, each from its smallest node on.

    Paths grow by joins inside their strongly connected component, over nodes larger than their first one, until no
    open path is left. Their number is exponential by nature: a dense component has as many rows as it has paths.
    """
    parts = settle(strong_components(edges))
    inner = edges.select("src", "dst").distinct().join(parts.select(F.col("node").alias("src"), "scc"), "src")
    inner = inner.join(parts.select(F.col("node").alias("dst"), F.col("scc").alias("to")), "dst").where("scc = to")
    ways = settle(inner.select("src", "dst"))
    paths = settle(ways.where("dst >= src").select(F.array("src").alias("path"), F.col("dst").alias("next")))
    found = paths.where("next = path[0]").select(F.col("path").alias("cycle"))
    rounds = 0
    while not paths.isEmpty():
        longer = paths.where("next <> path[0]").select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("src"))
        grown = longer.join(ways, "src").select("path", F.col("dst").alias("next"))
        paths = settle(grown.where("next = path[0] or next > path[0] and not array_contains(path, next)"))
        found, rounds = found.union(paths.where("next = path[0]").select("path")), rounds + 1
        if rounds % 32 == 0:
            found = settle(found)  # a plan of hundreds of unions would outgrow the driver
    return found


def subgraph(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges inside the kept ids (``id``)."""
    own = nodes.join(keep.select("id"), "id", "left_semi")
    return own, referential(edges, own)


def incident_nodes(nodes: DataFrame, edges: DataFrame, external: bool) -> DataFrame:
    """Nodes at an edge, internal or external ones; a node without edges is in neither."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.join(ends, "id", "left_semi").where((F.col("kind") == "external") == F.lit(external))


def file_dependencies(edges: DataFrame) -> DataFrame:
    """``path, dep``: the files that each file points to."""
    own = edges.where(F.startswith("src", F.lit("file:")) & F.startswith("dst", F.lit("file:")))
    return own.select(F.substring("src", 6, 10_000).alias("path"), F.substring("dst", 6, 10_000).alias("dep")).distinct()


def file_dependents(edges: DataFrame) -> DataFrame:
    """``path, dependent``: the files that import each file directly."""
    return file_dependencies(edges.where("edge_type = 'imports'")).select(F.col("dep").alias("path"), F.col("path").alias("dependent"))


def impact_target(target: str) -> str:
    """Node id of a target: ids stay, anything else is a path."""
    return target if target.startswith("file:") or "::" in target else f"file:{target}"


def impact(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``seed, path``: files that a change of each target (``id``) can reach, against the direction of edges."""
    found = ancestors(edges, targets).where(F.startswith("node", F.lit("file:")))
    return found.select("seed", F.substring("node", 6, 10_000).alias("path"))


def impacted_pages(impacted: DataFrame, pagemap: DataFrame) -> DataFrame:
    """``seed, page``: pages made from an impacted file."""
    used = pagemap.select("page", F.explode("source_files").alias("path"))
    return impacted.join(used, "path").select("seed", "page").distinct()


def neighbor_context(edges: DataFrame, symbols: DataFrame, most: int = 8) -> DataFrame:
    """``path, imports, dependents, calls``: the files that a file imports and that import it, and its calls.

    ``calls`` are the ``most`` symbols it calls most often, as ``name (count)``, the one called first before equals.
    """
    between = file_dependencies(edges.where("edge_type = 'imports'"))
    imports = between.groupBy("path").agg(F.array_sort(F.collect_set("dep")).alias("imports"))
    dependents = between.groupBy(F.col("dep").alias("path")).agg(F.array_sort(F.collect_set("path")).alias("dependents"))
    callers = symbols.select(F.col("id").alias("src"), "path", F.col("ord").alias("at"))
    callees = symbols.select(F.col("id").alias("dst"), "name").dropDuplicates(["dst"])
    called = edges.where("edge_type = 'calls'").join(callers, "src").join(callees, "dst", "left").withColumn("callee", F.coalesce("name", "dst"))
    counted = called.groupBy("path", "callee").agg(F.count("*").alias("n"), F.min(F.struct("at", "ord")).alias("first"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "first", "callee"))).where(F.col("r") <= most)
    listed = F.array_sort(F.collect_list(F.struct("r", F.format_string("%s (%d)", "callee", "n").alias("v"))))
    calls = ranked.groupBy("path").agg(F.transform(listed, lambda x: x["v"]).alias("calls"))
    return imports.join(dependents, "path", "full").join(calls, "path", "full")

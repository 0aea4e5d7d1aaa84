"""Source trees made of the relational tables, so that expected rows are plain joins over the tables.

``code``: one Python file a supplier, ``nation_<n>/supp_<s>.py``. Line 1 imports another supplier's file, line 2 ``os``,
line 3 decorates the first function with a route; then each part of the supplier is a function of two lines that
calls another part's; a class of two lines ends the file. ``notes``: one text a customer with a line for each order,
its words chosen by the order's priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Common table expressions for the oracles: suppliers with paths and imports, parts with lines and calls.
CODE_SQL = """
n as (select count(*) as n from supplier), m as (select count(*) as m from part),
supp as (select s_suppkey as s, s_nationkey as k, 'nation_' || s_nationkey || '/supp_' || s_suppkey || '.py' as path,
  (s_suppkey * 7 + 3) % n as dep from supplier, n),
deps as (select a.s, a.path, b.path as dep, b.k as dk, b.s as ds from supp a join supp b on a.dep = b.s),
parts as (select p_partkey as p, p_partkey % n as s, (p_partkey * 3) % m as callee,
  row_number() over (partition by p_partkey % n order by p_partkey) - 1 as k from part, n, m),
funcs as (select p, callee, parts.s, path, 4 + 2 * parts.k as line, path || '::part_' || p || ':' || (4 + 2 * parts.k) as id from parts join supp using (s)),
sizes as (select path, supp.s, count(p) as parts from supp left join parts using (s) group by path, supp.s)
"""
#: Words of an order's line by the first character of its priority. Fixed values.
WORDS = {"1": "email kafka", "2": "token queue", "3": "payment audit", "4": "manual review", "5": "batch ledger"}
NOTES_SQL = """
lines as (select c_custkey as c, 'notes/' || lower(c_mktsegment) || '/cust_' || c_custkey || '.txt' as path, o_orderkey as o, left(o_orderpriority, 1) as w,
  row_number() over (partition by c_custkey order by o_orderkey) as line from orders join customer on o_custkey = c_custkey)
"""


def spread(rows: DataFrame, key: str, most: int = 20_000, least: int = 500) -> DataFrame:
    """Rows dealt by ``key`` over tasks of at most about ``most`` rows, and over all cores unless they have under ``least``.

    A table may be a single row group, which one task would read, and then make and parse every file alone. What is
    moved are the table's rows, not the texts made of them.
    """
    return rows.repartition(_tasks(rows, most, least), key)


def _tasks(rows: DataFrame, most: int = 20_000, least: int = 500) -> int:
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, n // least), n // most)


def _as_files(rows: DataFrame, lang: str) -> DataFrame:
    return rows.select("path", F.lit(lang).alias("lang"), F.octet_length("text").cast("long").alias("size"), T.content_hash("text").alias("hash"), "text", "pos")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    n, m = supplier.agg(F.count("*")).scalar(), part.agg(F.count("*")).scalar()
    s = supplier.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("k"))
    to = s.select(F.col("s").alias("j"), F.col("k").alias("jk"))
    heads = s.withColumn("dep", (F.col("s") * 7 + 3) % n).join(to, F.col("dep") == F.col("j"))
    head = F.format_string('import nation_%d.supp_%d\nimport os\n@app.get("/area_%d/%d")\n', "jk", "j", "k", "s")
    body = F.format_string("def part_%d():\n    return part_%d()\n", F.col("p_partkey"), F.col("p_partkey") * 3 % m)
    tasks = _tasks(part)
    funcs = part.select((F.col("p_partkey") % n).alias("s"), "p_partkey", body.alias("body")).repartition(tasks, "s")
    bodies = funcs.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "body"))).alias("b"))
    text = F.concat(head, F.array_join(F.transform("b", lambda x: x["body"]), ""), F.format_string("class Model_%d(Base):\n    pass\n", "s"))
    rows = heads.repartition(tasks, "s").join(bodies.hint("shuffle_merge"), "s").select(F.format_string("nation_%d/supp_%d.py", "k", "s").alias("path"), text.alias("text"), F.col("s").cast("int").alias("pos"))
    return _as_files(rows, "python")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    line = F.concat(F.lit("order "), "o_orderkey", F.lit(" "), words[F.left("o_orderpriority", F.lit(1))])
    path = F.format_string("notes/%s/cust_%d.txt", F.lower("c_mktsegment"), "c_custkey")
    grouped = rows.groupBy("c_custkey", path.alias("path")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    return _as_files(grouped.select("path", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"), F.col("c_custkey").cast("int").alias("pos")), "text")


def java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Spring controller for each part: a mapped class, a mapped method, an entity, a listener, a schedule."""
    text = F.format_string(
        'import org.springframework.web;\n@RequestMapping("/brand_%s")\npublic class Part%d {\n    @GetMapping(\n        value = "/part/%d")\n'
        '    public Part find(long id) {\n        return load(id);\n    }\n    @Scheduled(cron = "0")\n    @KafkaListener(topics = "t%d")\n}\n@Entity\nclass Item%d {\n}\n',
        F.regexp_replace("p_brand", "[^0-9]", ""), "p_partkey", "p_partkey", "p_size", "p_partkey",
    )
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select(F.format_string("src/Part%d.java", "p_partkey").alias("path"), text.alias("text"), F.col("p_partkey").cast("int").alias("pos"))
    return _as_files(rows, "java")


def go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Go file for each supplier: a generic type, and a method with brackets in strings and a function called where it stands."""
    text = F.format_string(
        'package n%d\n\nimport (\n\t"fmt"\n\tb "corp/base"\n)\n\n/* func no() { */\ntype Supp%d[T any] struct {\n\tnote string\n}\n\n'
        'func (s *Supp%d[T]) Load%d(x int) interface{} {\n\tfmt.Println("} func no() {", `{`)\n\treturn func(y int) int { return b.Step(y) }(x)\n}\n',
        "s_nationkey", "s_suppkey", "s_suppkey", "s_suppkey",
    )
    rows = spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").select(F.format_string("go/n%d/supp_%d.go", "s_nationkey", "s_suppkey").alias("path"), text.alias("text"), F.col("s_suppkey").cast("int").alias("pos"))
    return _as_files(rows, "go")


def csharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A C# file for each part: a generic class with a class in it, brackets in strings, a lambda, a generic call."""
    text = F.format_string(
        'using System;\nusing static System.Math;\nnamespace Parts {\n  [Serializable]\n  public sealed class Part%d<T> : Base where T : class, new() {\n    string s = $"{F("}")} class No {{";\n'
        '    class Inner { public int Size() => Calc(%d); }\n    public Part%d(int x) : base(x) { Init(); }\n    public List<(int a, T b)> Sum<U>(List<U> xs) where U : class {\n'
        '      // }\n      xs.Where(x => { return Keep%d(x); }).ToList();\n      return new Box<T>(Get<T>(@"""}")).Open();\n    }\n  }\n}\n',
        "p_partkey", "p_size", "p_partkey", "p_partkey",
    )
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.format_string("cs/Part%d.cs", "p_partkey").alias("path"), text.alias("text"), F.col("p_partkey").cast("int").alias("pos"))
    return _as_files(rows, "csharp")


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TypeScript file for each customer: an import of a sibling by ``./``, one by ``../``, a function and a class."""
    text = F.format_string(
        "import { a } from './cust_%d'\nimport b from '../shared/base'\nexport function handle_%d(x) {\n}\nclass Cust%d {}\n",
        F.col("c_custkey") % 10 + 1, "c_custkey", "c_custkey",
    )
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.format_string("web/app/cust_%d.ts", "c_custkey").alias("path"), text.alias("text"), F.col("c_custkey").cast("int").alias("pos"))
    base = spark.createDataFrame([("web/shared/base.ts", "export function base() {}\n", 0)], "path string, text string, pos int")
    return _as_files(rows.unionByName(base), "typescript")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, edge_type, ord``: file nodes of suppliers and parts, joined by line items: sparse but deep."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_partkey").alias("p"))
    n = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    to = F.col("p") % n
    return li.select(F.concat(F.lit("file:"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("file:"), to).alias("dst"), F.lit("imports").alias("edge_type"), F.col("l_suppkey").alias("ord"))


EDGES_SQL = """
n as (select count(*) as n from supplier),
e as (select 'file:' || l_suppkey as src, 'file:' || max(l_partkey) % any_value(n) as dst from lineitem, n group by l_suppkey)
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page, text``: a Markdown page for each page row, with links, citations and sometimes a list of sources.

    Pages link to another page by root path, to one by ``../``, and cite a supplier's file; every seventh citation
    points behind the file's end, every eleventh to a missing file, every thirteenth to line 1 alone. Links lead to
    even pages and to multiples of five, so that others have none.
    """
    p = table(spark, sf_dir, "pages").select("page_id")
    n = p.agg(F.count("*")).scalar()
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.format_string("nation_%d/supp_%d.py", "s_nationkey", "s_suppkey").alias("file"))
    size = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    rows = p.withColumn("k", F.col("page_id") % size).join(names, "k")
    i = F.col("page_id")
    file = F.when(i % 11 == 0, F.lit("gone/nowhere.py")).otherwise(F.col("file"))
    start, end = F.when(i % 13 == 0, 1).otherwise(2), F.when(i % 13 == 0, 1).when(i % 7 == 0, 999_999).otherwise(6)
    text = F.concat(
        F.lit("---\ntitle: Page "), i, F.lit("\n---\n\n## Summary\nPage "), i % 5, F.lit("\n\n[a](area_"), (i * 6 % n) % 4, F.lit("/p"), i * 6 % n, F.lit(".md) and [b](../area_"),
        (i * 5 % (n + 20)) % 4, F.lit("/p"), i * 5 % (n + 20), F.lit(".md)\n"), F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("see "), file, F.lit(":L"), start, F.lit("-L"), end, F.lit("\n"))),
        F.when(i % 2 == 0, F.lit("\n## Sources\n")).otherwise(""),
    )
    return rows.select(F.format_string("area_%d/p%d.md", i % 4, i).alias("page"), text.alias("text"))


PAGES_SQL = """
ns as (select count(*) as n from supplier), np as (select count(*) as n from pages),
f as (select s_suppkey, 'nation_' || s_nationkey || '/supp_' || s_suppkey || '.py' as file, 3 + 2 * (select count(*) from part where p_partkey % (select n from ns) = s_suppkey) + 2 + 1 as lines from supplier),
pg as (select page_id as i, 'area_' || page_id % 4 || '/p' || page_id || '.md' as page,
  case when page_id % 11 = 0 then 'gone/nowhere.py' else file end as file, lines, case when page_id % 13 = 0 then 1 else 2 end as first,
  case when page_id % 13 = 0 then 1 when page_id % 7 = 0 then 999999 else 6 end as last, page_id % 3 <> 0 as cites, page_id % 2 = 0 as has_sources,
  'area_' || (page_id * 6 % np.n) % 4 || '/p' || page_id * 6 % np.n || '.md' as a, 'area_' || (page_id * 5 % (np.n + 20)) % 4 || '/p' || page_id * 5 % (np.n + 20) || '.md' as b
  from pages, ns, np, f where s_suppkey = page_id % ns.n),
status as (select page, file || ':L' || first || '-L' || last as cite, file, last, case when first = 1 and last = 1 then 'placeholder' when i % 11 = 0 then 'unresolved' when last > lines then 'stale' else 'ok' end as status from pg where cites),
link as (select page, a as link, a as target from pg union all select page, '../' || b, b from pg),
known as (select l.page, l.link, t.page as target from link l left join pg t on l.target = t.page)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two manifests of documents: the old one lacks some, in the new one some are gone and some have changed."""
    d = table(spark, sf_dir, "documents")
    path = F.format_string("%s/%s/doc_%d.txt", "source", "lang", "doc_id")
    old = d.where("doc_id % 19 <> 0").select(path.alias("path"), T.content_hash("text").alias("hash"))
    text = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return old, d.where("doc_id % 17 <> 0").select(path.alias("path"), T.content_hash(text).alias("hash"))


DIFF_SQL = """
diff as (select source || '/' || lang || '/doc_' || doc_id || '.txt' as path, doc_id, case when doc_id % 19 = 0 then 'added' when doc_id % 17 = 0 then 'removed' else 'changed' end as change
  from documents where (doc_id % 19 = 0 and doc_id % 17 <> 0) or (doc_id % 19 <> 0 and doc_id % 17 = 0) or (doc_id % 19 <> 0 and doc_id % 17 <> 0 and doc_id % 13 = 0))
"""


def pagemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of three documents of each group of three ids, every fifth page locked."""
    path = F.format_string("%s/%s/doc_%d.txt", "source", "lang", "doc_id")
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") / 3).cast("long").alias("g"), "doc_id", path.alias("path"))
    none, no_map = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    rows = d.groupBy("g").agg(F.array_sort(F.collect_list("path")).alias("source_files"))
    return rows.select(F.format_string("components/g%d.md", "g").alias("page"), "source_files", none.alias("source_symbols"), no_map.alias("file_hashes"), (F.col("g") % 5 == 0).alias("human_edited"))



"""Declarations by tokens and brackets: ends, nesting and calls in texts that patterns on lines get wrong."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_operators import files

from loam.operators import parse
from loam.operators.declarations import Source, declared
from loam.plans import synth

JAVA = '''package p;
import java.util.*;
import static a.b.C.of;
// class Fake { void no() {} }
@Entity
public class Outer<T extends Comparable<T>> extends Base {
  private static final String S = "} class X { void y() {}";
  private int x = compute(1);
  enum Color { RED(1) { int w() { return one(); } }, BLUE(2); Color(int i) { set(i); } }
  public <R> Map<String, List<R>> find(
      int a, String b) throws E {
    if (a > 0) { return load(b).stream().map(q -> conv(q)).collect(toList()); }
    Runnable r = new Thread(new Helper<>(a)) { public void run() { go('}'); } };
    return this.<T>other(new Foo(1));
  }
  @Override public String toString() { return """
     } void z() { }
     """; }
  abstract void nothing(int q);
  interface Inner { default void d() { class Loc {} this.e(); super.f(); } }
  Outer() { super(); init(); }
}
@interface Ann { String value() default ""; }
record Rec(int a) { int twice() { return a() * 2; } }
'''
CSHARP = '''using System;
using static System.Math;
using L = System.List;
namespace N {
  #region foo {
  [Serializable]
  public sealed class A : B, IC<int> where T : class, new() {
    string s = $"{f("x")} }}", v = @"a""} class Q {";
    public int P { get; set; } = Make(3);
    public int Q => Calc(1);
    public A(int x) : base(x) { Init(); }
    public async Task<(int a, string b)> Run<T>(T t) where T : class {
      using var z = Open();
      int Local(int k) => Deep(k);
      var y = await this.Fetch<int>(new Foo(t));
      foreach (var q in List(y)) { Console.WriteLine(nameof(q)); }
      return a.b().c(d(1));
    }
    public static int Add(int a) => Sum(a, () => { return Inner2(); });
    public static A operator +(A a, A b) { return a; }
    delegate void D(int x);
    ~A() { Close(); }
    enum E { One, Two }
  }
  record struct Pt(int X, int Y);
  interface I { void M(); }
}
'''
GO = '''package m
import (
  "fmt"
  x "a/b"
)
import _ `raw`
type T struct {
  F func(a int) (b int)
}
type (
  A = int
  B interface { M(x int) (y int) }
)
func (t *T) Run(x int) (n int, err error) {
  fmt.Println("}", `func no() {`)
  func() { inner() }()
  y := Map[int](xs)
  go t.work(f(x)(z))
  b := []byte(s)
  type Loc struct{ a int }
  return t.a().b(), nil
}
func Gen[K comparable, V any](m map[K]V) interface{} {
  return m
}
func ext(a int) int
'''
WANT = {
    "java": {
        ("class", "Outer", 6, 22, ""), ("class", "Color", 9, 9, ""), ("function", "w", 9, 9, "one"), ("function", "run", 13, 13, "go"),
        ("function", "find", 10, 15, "collect map stream load conv toList go other"), ("function", "toString", 16, 18, ""), ("function", "nothing", 19, 19, ""),
        ("class", "Inner", 20, 20, ""), ("function", "d", 20, 20, "e f"), ("class", "Loc", 20, 20, ""), ("function", "Outer", 21, 21, "init"), ("function", "twice", 24, 24, "a"),
    },
    "csharp": {
        ("class", "A", 7, 24, ""), ("function", "A", 11, 11, "Init"), ("function", "Run", 12, 18, "Open Deep int List WriteLine nameof c b d"),
        ("function", "Add", 19, 19, "Sum Inner2"), ("class", "Pt", 25, 25, ""), ("class", "I", 26, 26, ""), ("function", "M", 26, 26, ""),
    },
    "go": {
        ("class", "T", 7, 9, ""), ("class", "B", 12, 12, ""), ("function", "Run", 14, 22, "Println inner Map work x f b a"), ("class", "Loc", 20, 20, ""),
        ("function", "Gen", 23, 25, ""), ("function", "ext", 26, 26, ""),
    },
}


def test_declarations(spark):
    f = files(spark, {"A.java": JAVA, "A.cs": CSHARP, "a.go": GO})
    for lang, want in WANT.items():
        got = parse.PARSERS[lang](f).collect()
        assert {(r.kind, r.name, r.start_line, r.end_line, " ".join(r.calls)) for r in got} == want
        assert sorted(r.ord for r in got) == list(range(len(got))) and len({r.id for r in got}) == len(got)
    by = {r.path: r.imports for r in parse.parse_symbols(f).collect()}
    assert by == {"A.java": ["java.util.*", "a.b.C.of"], "A.cs": ["System", "System.Math", "L = System.List"], "a.go": ["fmt", "a/b", "raw"]}


def test_broken_texts():
    """Null, empty and broken texts end; what pairs up to the break is read; pieces in any order never fail."""
    assert not list(declared("e", None, "java")) and not list(declared("e", "", "go"))
    assert [r[2] for r in declared("e", "class A { void f( { } ] ) }}} class B {", "java")] == ["A", "B"]
    rng = random.Random(5)
    pieces = [c for text in (JAVA, CSHARP, GO) for c in text.split(" ")] + list("(){}[]<>;@\"'`/*#$=\n")
    for _ in range(400):
        text = " ".join(rng.choice(pieces) for _ in range(rng.choice([3, 40])))
        for lang in WANT:
            rows = list(declared("p", text, lang))
            assert all(1 <= r[4] <= r[5] <= text.count("\n") + 1 and r[6] for r in rows), text


def test_brackets_pair_like_a_stack():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("()[]{}a;") for _ in range(30))
        src, open_, want = Source(text, "java"), [], {}
        for i, c in enumerate(src.words):
            if c in "([{":
                open_.append(i)
            elif c in ")]}" and any(src.words[j] == {")": "(", "]": "[", "}": "{"}[c] for j in open_[-8:]):
                while src.words[open_[-1]] != {")": "(", "]": "[", "}": "{"}[c]:
                    open_.pop()
                want[i] = open_.pop()
        assert all(src.pair[j] == i and src.pair[i] == j for i, j in want.items())


def test_long_files_take_time_by_their_length():
    def seconds(text):
        began = time.perf_counter()
        rows = len(list(declared("p", text, "java")))
        return rows, time.perf_counter() - began

    def made(n):
        return "class A {\n" + "".join(f"  public int f{i}(int a) {{ return g{i}(a, h(b.c(1)).d()); }}\n" for i in range(n)) + "}\n"

    (few, short), (many, long) = seconds(made(1000)), seconds(made(8000))
    assert (few, many) == (1001, 8001) and long < 30 * short + 1
    for prose in ("class a b " * 60_000, "{ class a ( " * 20_000, "a . b ( " * 5_000):
        assert seconds(prose)[1] < 20


def test_parsers_hold_few_files_at_once(spark):
    """One large batch comes back in pieces, whole and in order."""
    import pandas as pd

    from loam.operators import parse

    class Files:
        where = select = lambda self, *_: self

        def mapInPandas(self, run, ddl):
            n = 3 * parse.FILES_HELD + 7
            return n, list(run(iter([pd.DataFrame({"path": [f"{i}.x" for i in range(n)], "text": ["x"] * n})])))

    n, found = parse._parsed(Files(), "python", lambda path, text: [(path, *[""] * 10)])
    assert max(map(len, found)) == parse.FILES_HELD and [p for f in found for p in f["id"]] == [f"{i}.x" for i in range(n)]
    n, found = parse._parsed(Files(), "python", lambda path, text: [(path, *[""] * 10)] * 3000)
    assert max(map(len, found)) < parse.ROWS_HELD + 3000 and sum(map(len, found)) == 3000 * n


@pytest.mark.parametrize("name", ["java", "csharp", "go", "script"])
def test_files_of_one_row_group_are_parsed_by_all_cores(spark, name):
    """The tables are one file of one row group, which one task alone would read and parse."""
    files = getattr(synth, name)(spark, "/root/testdata/sf0.1").select("path", F.spark_partition_id().alias("p"))
    used = files.groupBy("p").count()
    cores = spark.sparkContext.defaultParallelism
    assert used.count() >= min(cores, 2) and used.agg(F.max("count")).first()[0] < 0.7 * files.count()

"""Exact duplicates, source divergence and vector codes, against plain loops on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loam.llm import compress, divergence, exact


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gämma", "δelta", "x1y", "日本", "and", "the"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de"]), f"s{rng.randrange(5)}") for i in range(150)]
    rows += [(200 + i, "Same  text\there", "en", "s0") for i in range(60)] + [(300, "Sametexthere", "en", "s1"), (301, "\x0bSame\r\ntext here  ", None, "s1")]
    rows += [(310, None, None, None), (311, "", "en", None), (312, " \n", "fr", "only"), (313, " ", "fr", "only"), (314, " ", "fr", "only")]
    rows += [(320, "alpha " * 60_000, "de", "s2"), (320, "alpha " * 60_000, "de", "s2"), (None, "alpha " * 60_000, "de", "s9"), (5, "other text of id five", "en", "s3")]
    # One length and one prefix, other ends.
    rows += [(400 + i, "p" * 100 + chr(97 + i % 3), "en", "s4") for i in range(9)]
    rng.shuffle(rows)
    return rows


def documents(spark, rows):
    named = [(*r, i, "clash") for i, r in enumerate(rows)]
    return spark.createDataFrame(named, "doc_id long, text string, lang string, source string, row long, text_sha256 string").repartition(5)


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("digests,buckets", [(True, 1 << 18), (False, 1 << 18), (False, 1)])
def test_exact_groups_equal_a_plain_loop(spark, texts, digests, buckets):
    groups = defaultdict(list)
    for doc, text, *_ in texts:
        groups[bare(text)].append((-len(text or ""), doc is None, doc or 0, doc))
    best = {t: min(g)[3] for t, g in groups.items()}
    sizes = {t: len(g) for t, g in groups.items()}
    got = exact.exact_groups(documents(spark, texts), digests=digests, buckets=buckets).collect()
    want = Counter((d, best[bare(t)], sizes[bare(t)]) for d, t, *_ in texts)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert Counter(r["keep_id"] for r in got if r["kept"]) == Counter(best.values())  # one row of each group
    hashes = Counter(hashlib.sha256(bare(t).encode()).hexdigest() for _, t, *_ in texts)
    found = Counter(r["text_sha256"] for r in got)
    if digests or buckets == 1:
        assert found == hashes
    else:  # rows that are alone by length and prefix were never hashed
        assert all(found[h] == n for h, n in hashes.items() if n > 1) and found[None] > 0


def test_exact_groups_of_nothing(spark):
    none = documents(spark, [])
    assert exact.exact_groups(none).collect() == [] and exact.exact_groups(none).columns[0] == "doc_id"


def plain_divergence(rows, least, top):
    docs = [(t or "", g or "", s or "") for _, t, g, s in rows]
    terms = [Counter(x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)) for t, *_ in docs]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, lang, source), c in zip(docs, terms):
        groups[lang].add(source)
        held[lang].update(c.keys())
        counts[lang, source].update(c)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def p(c, kept=kept):
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}

        of, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o) for o in sources - {s}]
            own = [((of[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("group_block,term_block,held", [(64, 4096, 200_000), (2, 3, 4), (1, 1, 0)])
def test_divergence_equals_a_plain_loop(spark, texts, group_block, term_block, held):
    got = divergence.source_divergence(documents(spark, texts), top=4, group_block=group_block, term_block=term_block, held=held, slices=3)
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_divergence(texts, 3, 4)


def test_divergence_of_little(spark):
    assert divergence.source_divergence(documents(spark, [])).collect() == []
    got = divergence.source_divergence(documents(spark, [(1, "one", "en", "a"), (2, None, "en", "b"), (3, "x", "de", "c")])).collect()
    assert {tuple(r)[:5] for r in got} == {("en", "a", "pair", "b", 0), ("en", "b", "pair", "a", 0)}


def test_probabilities_are_exact_beyond_doubles(spark):
    n, total, kept = 7_000_000_000_000_003, 9_000_000_000_000_000_011, 123_456_789
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(divergence.probability(*map(divergence.F.col, ("n", "total", "kept")))).first()
    assert row[0] == 1 + 1_000_000_000 * (n + 1) // (total + kept)


def test_pieces_cut_between_terms():
    text = "Ab céD9ef日本x " * 50
    whole = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
    for size in (1, 7, 64, 1 << 20):
        assert [t.decode() for terms in divergence.pieces(text, size) for t in terms] == [t.translate({c: c + 32 for c in range(65, 91)}) for t in whole]


def brute_nearest(x, entries):
    d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in entries] for r in x], object)
    return [min(range(len(entries)), key=lambda e: (row[e], e)) for row in d], [min(row) for row in d]


@pytest.mark.parametrize("scale", [3, 400, 1 << 26])
def test_gnat_equals_brute_force(scale):
    rng = np.random.default_rng(5)
    entries = rng.integers(-scale, scale, (90, 4))
    entries[40:60] = entries[:20]  # repeated entries: ties
    entries[60:90] = entries[60]
    x = np.concatenate([rng.integers(-scale, scale, (150, 4)), entries, (entries[:30] + entries[30:60]) // 2])
    tree = compress.Gnat(entries, degree=4)
    got = tree.nearest(x)
    want = brute_nearest(x, entries)
    assert list(got[0]) == want[0] and list(got[1]) == want[1]


def test_gnat_rules_out_whole_subtrees():
    rng = np.random.default_rng(6)
    centres = rng.integers(-100_000, 100_000, (16, 8))
    entries = np.concatenate([c + rng.integers(-50, 50, (16, 8)) for c in centres])
    x = entries[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 8))
    tree = compress.Gnat(entries)
    entry, _ = tree.nearest(x)
    assert tree.measured < 0.2 * len(x) * len(entries)
    assert list(entry[:100]) == brute_nearest(x[:100], entries)[0]


def plain_codes(rows, entries, rounds=4):
    """``rows``: (vec_id, vector, label) that count, as Python numbers all the way."""
    width = -(-max(len(v) for _, v, _ in rows) // 4) * 4
    most = compress.limit(width)
    whole = [[max(-most, min(most, math.floor(1024 * c))) for c in v] + [0] * (width - len(v)) for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    cut = lambda v, p: v[p * width // 4 : (p + 1) * width // 4]
    books = [[cut(whole[i], p) for i in first] for p in range(4)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            mine = defaultdict(list)
            for v in whole:
                mine[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    found = [[near(cut(v, p), books[p]) for p in range(4)] for v in whole]
    errors = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for (_, _, label), e in zip(rows, errors):
        total[label] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, total[label], sha) for (i, _, label), f, e in zip(rows, found, errors))


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(4)


@pytest.mark.parametrize("width,entries", [(8, 16), (6, 256), (1, 3)])
def test_codes_equal_plain_numbers(spark, width, entries):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(i % 7, 0.3) for _ in range(width)], i % 4 or None) for i in range(120)]
    rows += [(500 + i, [1.0] * width, 9) for i in range(20)] + [(7, rows[7][1], 1), (7, [0.5] * width, 1), (None, [0.25] * width, 2), (None, [0.0] * width, 2)]
    rows += [(600, [], 1), (601, [2.5], 3), (602, [1e200] + [0.0] * (width - 1), 5), (603, [-1e300] * width, 5)]
    bad = [(700, None, 1), (701, [None] * width, 1), (702, [float("nan")] * width, 1), (703, [float("-inf")] * width, 1)]
    got = compress.compress_vectors(vector_table(spark, rows + bad), entries=entries).collect()
    assert Counter(tuple(r) for r in got) == plain_codes(rows, entries)


def test_codes_of_nothing(spark):
    assert compress.compress_vectors(vector_table(spark, [])).collect() == []
    assert compress.compress_vectors(vector_table(spark, [(1, None, 1)])).collect() == []
    only = compress.compress_vectors(vector_table(spark, [(1, [], None), (2, [], None)])).collect()
    assert {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in only} == {(1, "00000000", 0, 0), (2, "00000000", 0, 0)}


def test_vectors_of_floats_and_whole_numbers(spark):
    from pyspark.sql import functions as F

    rows = vector_table(spark, [(i, [float(i % 5)] * 4, 0) for i in range(30)])
    want = sorted(tuple(r) for r in compress.compress_vectors(rows).collect())
    for kind in ("array<float>", "array<int>"):
        assert sorted(tuple(r) for r in compress.compress_vectors(rows.withColumn("embedding", F.col("embedding").cast(kind))).collect()) == want

"""Operators over documents, against brute force on small tables with nulls, blanks, ties, repeats and odd columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loam.llm import mixing, packing, quality, rollups, simhash, tokens, toxicity
from loam.llm.common import Store, stage
from loam.llm.components import connected_components
from loam.llm.tokens import default_path, word_tokenizer
from loam.llm.training import labelled_sample

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, size int"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, len(t or ""), "x", 7, 9) for i, t, s in rows]
    return spark.createDataFrame(full, DDL).repartition(3)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, words(rng, rng.choice([3, 30, 300])), f"s{i % 4}") for i in range(60)]
    base = out[5][1] if len(out[5][1]) > 200 else words(rng, 400)
    out += [(100 + i, base.replace("alpha", "Alpha", i) + f" tail{i}", "s0") for i in range(25)]
    out += [(200, None, None), (201, "", "s1"), (202, " \t\n ", None), (203, "one two", "s2"), (None, base, "s3"), (7, out[7][1], "s3"), (300, words(rng, 60_000), "s1")]
    return out


def brute_fingerprint(text):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_groups(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(fps)):
        least[find(i)] += [ids[i]] if ids[i] is not None else []
    return [min(least[find(i)], default=None) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, rows):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(table(spark, rows)).collect())
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    groups = brute_groups(fps, [i for i, _, _ in rows])
    assert got == Counter((i, f"{f:016x}", g) for (i, _, _), f, g in zip(rows, fps, groups))


def test_simhash_chunks_lose_no_link(spark):
    rng = random.Random(2)
    near = [0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(4))) for _ in range(150)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in near + [rng.getrandbits(64) for _ in range(50)]})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    small = {(r.node, r.root) for r in connected_components(simhash.near_edges(frame, chunk=8)).collect()}
    large = {(r.node, r.root) for r in connected_components(simhash.near_edges(frame)).collect()}
    unsigned = [f % (1 << 64) for f in fps]
    brute = dict(zip(fps, brute_groups(unsigned, fps)))
    assert small == large == {(f, r) for f, r in brute.items() if list(brute.values()).count(r) > 1}


def test_keep_first_leaves_one_of_each_group(spark, rows):
    docs = table(spark, rows)
    kept = simhash.keep_first(docs)
    groups = {r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(groups)


def shingle_set(text, k=5):
    ws = text.lower().split()
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))}


def test_similar_groups_against_jaccard(spark):
    """Edited copies of all degrees: pairs of 0.85 or more share a group, with a recall stated here; others do not."""
    rng = random.Random(11)
    rows, truth = [], []
    for i in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 900]))]
        edited = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8, 20])):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(5000)}"
        a, b = " ".join(base), " ".join(edited)
        rows += [(2 * i, a, "s"), (2 * i + 1, b, "s")]
        truth.append(len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)))
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(table(spark, rows)).collect()}
    met = [group[2 * i] == group[2 * i + 1] == 2 * i for i in range(120)]
    assert all(m for m, j in zip(met, truth) if j > 0.95) and not any(m for m, j in zip(met, truth) if j < 0.65)
    assert np.mean([m for m, j in zip(met, truth) if j >= 0.85]) > 0.9
    assert len({group[2 * i] for i in range(120)}) == 120  # unrelated texts never meet


def test_similar_groups_edge_cases(spark, rows):
    got = Counter((r.doc_id, r.component_id) for r in simhash.similar_groups(table(spark, rows)).collect())
    group = dict(got.keys())
    assert sum(got.values()) == len(rows) and {got[i, 200] for i in (200, 201, 202)} == {1} and group[203] == 203 and got[7, 7] == 2
    assert all(group[100 + i] == group[100] for i in range(25)) and group[300] == 300
    docs = table(spark, rows)
    kept = simhash.keep_first_similar(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(set(group.values()))


def test_connected_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def test_similar_groups_hold_all_pairs_of_the_similarity(spark):
    """Copies of several lengths with words changed, cut off and added, down to a Jaccard similarity of 0.8 exactly."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(f"a{i}" for i in range(13)), " ".join(f"a{i}" for i in range(12)) + " b"]  # 8 shingles of 10
    texts += [" ".join(f"c{i}" for i in range(12)), " ".join(f"c{i}" for i in range(14))]  # 8 of 10, sizes 8 and 10
    common = [word() for _ in range(12)]
    for k in range(60):
        base = [word() for _ in range(rng.choice([30, 90, 300]))] + common
        for _ in range(2):
            copy = base[: len(base) - rng.randrange(len(base) // 12)]
            for _ in range(len(base) // rng.choice([60, 90, 120])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(i, j) for i, a in enumerate(sets) for j in range(i) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])]
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert len(near) > 20 and (3, 2) in near and all(group[i] == group[j] for i, j in near)


def test_a_shared_passage_makes_no_pairs(spark):
    """All of 150 texts hold one passage, in their prefixes too: pairs as similar as asked come out, and hardly others."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(9000)}"
    passage, texts = [f"p{i}" for i in range(12)], []
    for k in range(150):
        texts.append(" ".join(passage + [word() for _ in range(rng.choice([20, 40, 70, 200, 500]))]))
        if k % 5 == 0:
            near = texts[-1].split()
            near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near[: len(near) - rng.randrange(2 + len(near) // 14)]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = {(j, i) for i, a in enumerate(sets) for j in range(i) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])}
    wide = simhash._wide_fingerprints(0.8, np.empty(0, np.uint64))
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumnRenamed("doc_id", "rid")
    rows = docs.select("rid", wide("text").alias("w")).select("rid", "w.*").localCheckpoint()
    assert rows.select(F.explode("prefix").alias("key")).groupBy("key").count().agg(F.max("count")).first()[0] > 30
    own = rows.select("rid", F.col("rid").alias("root"), "size", "sketch")
    for chunk in (1024, 7):
        got = {(min(r), max(r)) for r in simhash._shared_prefixes(rows, own, 0.8, chunk).collect()}
        assert len(near) > 15 and near <= got and len(got) < 2 * len(near)
    assert not simhash._shared_prefixes(rows, own.withColumn("root", F.lit(0).cast("long")), 0.8).count()


def test_partners_over_batches(spark):
    """Rows whose key and size leave them a partner, against all pairs, wherever batches end."""
    rng = random.Random(14)
    rows = [(rng.randrange(40), i, 2 * rng.choice([10, 11, rng.randrange(5, 40)]) + rng.randrange(2)) for i in range(300)]
    want = set()
    for key, i, a in rows:
        small = lambda b: (min(a, b), max(a, b))
        if any(k == key and i != j and not small(b)[0] & 1 and 5 * (small(b)[0] >> 1) >= 4 * (small(b)[1] >> 1) for k, j, b in rows):
            want.add(i)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 2, 3, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = [r.rid for r in simhash._partners(spark.createDataFrame(rows, "key long, rid long, at long"), 0.8).collect()]
            assert sorted(got) == sorted(want) and 50 < len(want) < 300
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


@pytest.mark.parametrize("operator", [simhash.simhash_groups, simhash.keep_first, simhash.similar_groups, simhash.keep_first_similar, mixing.mix_documents, mixing.take_whole, packing.pack_documents, rollups.rollup_documents])
def test_empty_tables(spark, operator):
    assert operator(table(spark, [(1, "a", "b")]).limit(0)).count() == 0


def test_mixing(spark, rows):
    docs = table(spark, rows)
    got = mixing.mix_documents(docs).collect()
    again = mixing.mix_documents(docs.repartition(2)).collect()
    assert Counter(got) == Counter(again) and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, left = sum(sizes.values()), {}, set(order)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= set(over)
    assert sorted({round(r.target, 6) for r in got}) == pytest.approx(sorted({round(t, 6) for t in target.values()}))
    assert sorted(r.size for r in got) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert all(r.taken <= 3 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[round(r.target, 3)] += r.taken
    for s in order:
        same = [x for x in order if round(target[x], 3) == round(target[s], 3)]
        assert abs(taken[round(target[s], 3)] - sum(target[x] for x in same)) <= 20 * len(same)


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(3)
    for seats in (0, 1, 7, 100, 1001):
        votes = [rng.choice([0, 1, 5, 300, 10_000]) + rng.random() for _ in range(12)]
        frame = spark.createDataFrame([(i, v, seats, 10**9) for i, v in enumerate(votes)], "i int, v double, seats long, most long")
        got = {r.i: r.quota for r in mixing.apportion(frame, [], "i", "v", "seats", "most").collect()}
        won = Counter()
        for _ in range(seats):
            won[max(range(12), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        assert got == {i: won[i] for i in range(12)}


def brute_quotas(votes, seats):
    """Seats by highest quotients votes / (2k + 1), ties to the earlier party."""
    won = Counter()
    for _ in range(seats):
        won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return [won[i] for i in range(len(votes))]


def test_taken_words_equal_a_plain_loop(spark, rows):
    """What the mix takes of each document: seats of sources, seats of shards, and a run of words around each ring."""
    block, shard_words, seed = 16, 3000, 5
    keyed = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    sizes = table(spark, keyed).select("doc_id", "source", mixing.word_count("text").alias("size"))
    docs = stage(sizes, "sizes")
    got = {r.doc_id: r.taken for r in mixing.mix(docs, ["doc_id"], block=block, shard_words=shard_words, seed=seed).collect()}
    hashed = docs.select("doc_id", "source", "size", F.xxhash64(F.lit(seed), "doc_id").alias("order"), F.xxhash64(F.lit(seed), F.lit("shard"), "doc_id").alias("deal")).collect()
    target = {r.source: r.target for r in mixing.targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), [1, 2, 3]).collect()}
    order = sorted([s for s in target if s is not None]) + [None]
    held = {s: sum(r["size"] for r in hashed if r.source == s) for s in order}
    quota = dict(zip(order, brute_quotas([target[s] for s in order], sum(held.values()) // block)))
    want = {}
    for s in order:
        own = [r for r in hashed if r.source == s]
        shards = max(1, -(-held[s] // shard_words))
        numbers = sorted({r.deal % shards for r in own})
        size = {n: sum(r["size"] for r in own if r.deal % shards == n) for n in numbers}
        seats = brute_quotas([size[n] for n in numbers], min(quota[s], 3 * held[s] // block)) if held[s] else [0] * len(numbers)
        begins = {r.n: r.b for r in spark.createDataFrame([(s, n) for n in numbers], "s string, n long").select("n", F.xxhash64(F.lit(seed), "s", "n").alias("b")).collect()}
        for n, q in zip(numbers, seats):
            ring, at = sorted((r for r in own if r.deal % shards == n), key=lambda r: (r.order, r.doc_id)), 0
            words = min(q, 3 * size[n] // block) * block
            whole, run = divmod(words, size[n]) if size[n] else (0, 0)
            begin = begins[n] % size[n] if size[n] else 0
            for r in ring:
                want[r.doc_id] = whole * r["size"] + sum(1 for w in range(at, at + r["size"]) if begin <= w < begin + run or w < begin + run - size[n])
                at += r["size"]
    assert got == want and max(got.values()) > 0


def test_mix_keeps_blank_texts_out_of_the_rings(spark):
    """A source of very many documents without words: all come back with nothing taken, and no window holds them."""
    many = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("blank").alias("source"))
    some = spark.range(200_000, 200_050).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"), F.lit("told").alias("source"))
    mixed = mixing.mix_documents(many.unionAll(some))
    assert mixed.where("source_size = 0").agg(F.count("*"), F.sum("taken")).first()[:] == (200_000, 0)
    assert mixed.where("source_size > 0").agg(F.count("*"), F.sum("size")).first()[:] == (50, 100)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter \(.*size#\d+L? > 0", plan)


def test_take_whole_keeps_rows(spark, rows):
    docs = table(spark, rows)
    got = mixing.take_whole(docs)
    assert got.columns == docs.columns and all(r.text and r.row == 7 for r in got.collect())
    assert Counter(got.collect()) == Counter(mixing.take_whole(docs.orderBy(F.desc("text")).coalesce(2)).collect())


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 100)
    known, whole = tokens.WordTokenizer(default_path()), Tokenizer.from_file(default_path())
    texts = [" ".join(f"w{i * k}" for i in range(70)) + " " + "Zeta9-" * 5_000 for k in range(1, 9)]
    assert [known.ids(t).tolist() for t in texts] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    held = [w for cache in (known.known, known.known.before) for w in cache]
    assert len(held) <= 200 and max(map(len, held)) <= 64


def test_word_tokenizer_is_exact():
    texts = ["Don't stop, l'été! ÀÉ Straße  x.y,z 123.45", "a\u0301 b\u00a0c\u2003d\x1ce", "<|startoftext|>hi<|endoftext|> <|x", "İstanbul ŉ ſ Ǆ ΣΑΣ", "日本語 テキスト", "", "'s 't"]
    texts += [" ".join(chr(c) + "a" + chr(c) for c in range(33, 0x260))]
    whole = Tokenizer.from_file(default_path())
    assert [word_tokenizer(default_path()).ids(t).tolist() for t in texts] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_whole_and_tight(spark, rows):
    packed = stage(packing.pack_documents(table(spark, rows), keep_ids=True), "packed")
    got = packed.collect()
    whole = Tokenizer.from_file(default_path())
    lengths = Counter(-(-(len(whole.encode(t or "", add_special_tokens=False).ids) + 1) // 2048) for _, t, _ in rows)
    assert sum(k * n for k, n in lengths.items()) == len(got)
    by = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by[r.sequence_id].append(r)
    for s in by.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))] and sum(r.length for r in s) <= 2048
    assert len(by) <= len(packing.best_fit(np.array([r.length for r in got]))[2]) + 2
    text = dict((i, t) for i, t, _ in rows if i == 300)[300]
    own = sorted((r for r in got if r.doc_id == 300), key=lambda r: r.piece)
    assert [x for r in own for x in r.ids] == whole.encode(text, add_special_tokens=False).ids + [0] and [r.start for r in own] == [2048 * i for i in range(len(own))]
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(joined[k] == [x for r in s for x in r.ids] for k, s in by.items())


def test_packing_tree_merges_underfull_bins(spark):
    rng = random.Random(4)
    lengths = [rng.randrange(1, 700) for _ in range(400)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id int, length long").repartition(40)
    got = packing.pack_pieces(stage(pieces, "pieces"), fan_in=4).collect()
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert len(got) == 400 and max(fill.values()) <= 2048 and len(fill) <= -(-sum(lengths) // 2048) + 4


def test_best_fit_matches_a_plain_loop():
    rng = random.Random(5)
    for _ in range(20):
        lengths = np.array([rng.randrange(1, 101) for _ in range(60)])
        rooms, want = [], {}
        for i in sorted(range(60), key=lambda i: -lengths[i]):
            fit = [(r, b) for b, r in enumerate(rooms) if r >= lengths[i]]
            b = min(fit)[0] if fit else None
            if b is None:
                rooms.append(100 - lengths[i])
            else:
                rooms[[k for k, r in enumerate(rooms) if r == b][0]] -= lengths[i]
        bins, offsets, fills = packing.best_fit(lengths, 100)
        assert sorted(100 - f for f in fills) == sorted(rooms) and np.bincount(bins, lengths).max() <= 100 and want == {}


def test_rollup_deltas(spark, tmp_path, rows):
    root = f"file://{tmp_path}/rollup"
    docs = table(spark, rows)
    counts = stage(rollups.token_counts(docs, {"words-1": None}), "counts")
    half, rest = counts.where("doc_id % 2 = 0"), counts.where("doc_id % 2 <> 0 or doc_id is null")
    assert rollups.commit(spark, root, "a/1", rollups.inserts(half)) and rollups.commit(spark, root, "b", rollups.inserts(rest))
    assert not rollups.commit(spark, root, "a/1", rollups.inserts(half))
    want = Counter()
    for _, t, s in rows:
        want[s] += len((t or "").split())
    now = lambda: {r.source: r.tokens for r in rollups.totals(spark, root).collect()}
    assert now() == dict(want)
    rollups.compact(spark, root)
    assert now() == dict(want) and not rollups.commit(spark, root, "b", rollups.inserts(rest))
    moved = half.withColumn("source", F.lit("moved")).withColumn("tokens", F.col("tokens") + 1)
    rollups.commit(spark, root, "c", rollups.revisions(half, moved))
    rollups.commit(spark, root, "d", rollups.deletes(rest))
    assert now() == {"moved": moved.agg(F.sum("tokens")).first()[0]}
    for _ in range(3):  # folders of absorbed batches go, their ids and totals stay
        rollups.compact(spark, root)
        assert now() == {"moved": moved.agg(F.sum("tokens")).first()[0]}
    assert not list((tmp_path / "rollup" / "batches").glob("key=*")) and len(list((tmp_path / "rollup" / "snapshots").iterdir())) == 4
    assert not any(rollups.commit(spark, root, b, rollups.inserts(rest)) for b in ("a/1", "b", "c", "d"))
    assert rollups.commit(spark, root, "e", rollups.inserts(rest)) and len(now()) > 1


def test_rollup_commits_that_meet(spark, tmp_path):
    """Of two runs that publish one batch at once, the later one leaves nothing that is read."""
    store, root = Store(spark, f"file://{tmp_path}"), f"file://{tmp_path}"
    one = spark.createDataFrame([("s", "en", "t", 1, 5, "x")], "source string, lang string, tokenizer string, docs long, tokens long, batch string")
    one.write.parquet(f"{root}/temporary/_a")
    one.write.parquet(f"{root}/temporary/_b")
    assert store.publish(f"{root}/temporary/_a", f"{root}/batches/key=x")
    store.exists = lambda path: False
    real, store._fs = store._fs, None

    class Blind:
        """Says that the final folder is not there yet, as it was when the other run looked."""

        def __getattr__(self, name):
            return getattr(real, name)

        def exists(self, path):
            return real.exists(path) and not path.toString().endswith("key=x")

    store._fs = Blind()
    assert not store.publish(f"{root}/temporary/_b", f"{root}/batches/key=x")
    assert [r.tokens for r in rollups.totals(spark, root).collect()] == [5] and not list((tmp_path / "temporary").iterdir())


def test_rollup_batch_ids_of_any_letters(spark, tmp_path):
    """Ids that readers of folder names take apart differently, and batches without a change, through two compactions."""
    root = f"file://{tmp_path}"
    ids = ["täg", "日本", "%41", "A", "%", "", " ", "a/b", "x=y", "__HIVE_DEFAULT_PARTITION__", "1e5", "2026-01-01", "\u0000", "🙂"]
    change = lambda n: spark.createDataFrame([("s", None, "t", 1, n)], rollups._DDL)
    for n, batch in enumerate(ids):
        assert rollups.commit(spark, root, batch, change(10**n))
    assert rollups.commit(spark, root, "none", change(1).limit(0)) and not rollups.commit(spark, root, "none", change(1))
    want = [("s", None, "t", len(ids), sum(10**n for n in range(len(ids))))]
    for _ in range(3):
        assert [tuple(r) for r in rollups.totals(spark, root).collect()] == want
        rollups.compact(spark, root)
    assert not any(rollups.commit(spark, root, batch, change(1)) for batch in [*ids, "none"])
    assert [tuple(r) for r in rollups.totals(spark, root).collect()] == want
    assert {r["batch"] for r in rollups._absorbed(spark, root).collect()} == {*ids, "none"}


def test_rollup_query_equals_brute_force(spark, rows):
    whole = Tokenizer.from_file(default_path())
    docs, tokens = Counter(), Counter()
    for _, t, s in rows:
        for name, n in (("words-1", len((t or "").split())), ("word_bpe_49k-1", len(whole.encode(t or "", add_special_tokens=False).ids))):
            docs[s, "en", name] += 1
            tokens[s, "en", name] += n
    got = rollups.rollup_documents(table(spark, rows)).collect()
    assert len(got) == len(docs) and {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in got} == {k: (docs[k], tokens[k]) for k in docs}


def labelled(rng, n, bad):
    clean = lambda: words(rng, 60)
    rows = [(i, clean() + (" " + bad(rng) if i % 4 == 0 else ""), f"s{i % 3}") for i in range(n)]
    return rows, {i: int(i % 4 == 0) for i in range(n)}


def check_fold(rows, got, n, held):
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % n == held for i, _, _ in rows if i is not None}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(6)
    rows, toxic = labelled(rng, 400, lambda r: " ".join(r.choice(["idiotish", "scumbag", "moronic"]) + r.choice("xyz") for _ in range(6)))
    rows += [(1000, None, None), (1001, "", None), (None, "hello", None)]
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] + [(1, 1, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(table(spark, rows), labels).collect()
    check_fold(rows, got, 5, 0)
    judged = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    assert np.mean([a == b for a, b in judged]) > 0.95
    assert {r.predicted for r in got if r.doc_id in (1000, 1001)} == {0}


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(7)
    rows, junk = labelled(rng, 400, lambda r: " ".join([r.choice(["zap", "zip"])] * 60))
    rows += [(1000, None, None), (1001, "", None)]
    labels = spark.createDataFrame([(i, 1 - j, 0) for i, j in junk.items()], "doc_id long, quality int, toxic int")
    got = quality.classify(table(spark, rows), labels).collect()
    check_fold(rows, got, 3, 1)
    judged = [(r.predicted, 1 - junk[r.doc_id]) for r in got if r.held_out and r.doc_id in junk]
    assert np.mean([a == b for a, b in judged]) > 0.95


@pytest.mark.parametrize("operator", [toxicity.classify, quality.classify])
def test_classifiers_without_labels_or_rows(spark, operator):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, [(1, "a b", "s"), (2, None, None)])
    assert len({r.score for r in operator(docs, none).collect()}) == 1
    assert operator(docs.limit(0), none).count() == 0


def test_toxicity_margin_is_a_plain_sum():
    """N-gram by n-gram over distinct folded words, against the scorer's per-word sums."""
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(1, 30)).title() for _ in range(60)] + ["", "One", "so SO so", None]
    model = toxicity.train(texts, np.array([i % 2 for i in range(len(texts))]))
    for text, margin in zip(texts, model.margins(texts)):
        distinct = {w.lower() for w in (text or "").split()}
        total = sum(model.weights[b] for w in distinct for b in toxicity.ngrams([w], toxicity.SHORTEST, toxicity.LONGEST, toxicity.BITS)[0])
        assert margin == pytest.approx(model.bias + total / max(1, len(distinct)) ** 0.5)


def test_log_count_ratios_are_plain_counts():
    texts, labels = ["bad bad idiot", "good day", "fine good sun", "idiot"], np.array([1, 0, 0, 1])
    counts = np.ones((2, 1 << toxicity.BITS))
    for t, y in zip(texts, labels):
        for w in set(t.split()):
            for b in toxicity.ngrams([w], toxicity.SHORTEST, toxicity.LONGEST, toxicity.BITS)[0]:
                counts[y, b] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    model = toxicity.fit(texts, labels, updates=1)
    moved = np.flatnonzero(model.weights)
    assert len(moved) and set(moved) <= set(np.flatnonzero(ratio)) and (np.sign(model.weights[moved]) != 0).all()


@pytest.mark.parametrize("keep,train", [(toxicity.drop_toxic, toxicity.train), (quality.keep_good, quality.train)])
def test_filters_keep_columns_and_repeats(spark, rows, keep, train):
    rng = random.Random(9)
    texts = [words(rng, 30) + (" zap idiotish" * 9 if i % 2 else "") for i in range(80)]
    bad = np.array([i % 2 for i in range(80)])
    model = train(texts, bad if keep is toxicity.drop_toxic else 1 - bad)
    docs = table(spark, [*rows, (900, texts[1], None), (900, texts[1], None), (901, texts[0] * 400, "s")])
    got = keep(docs, model)
    ids = Counter(r.doc_id for r in got.collect())
    assert got.columns == docs.columns and 900 not in ids and ids[901] == 1 and ids[7] == 2 and ids[None] == 1
    assert keep(docs.limit(0), model).count() == 0


def test_scores_do_not_depend_on_batches():
    model = toxicity.train(["good day", "bad idiot", "fine sun", "idiot scum"] * 10, np.array([0, 1, 0, 1] * 10))
    texts = ["good idiot", "", None, "sun"]
    assert model.scores(texts).tolist() == [model.scores([t])[0] for t in texts]


def test_quality_is_the_mean_of_its_rows():
    """Character n-grams, whole words and word pairs, row by row, against the scorer's per-word sums."""
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(1, 30)) for _ in range(60)] + ["", "one", "so so so", None]
    model = quality.fit(texts, np.array([i % 2 for i in range(len(texts))]))
    scorer = model.scorer()
    for text, score in zip(texts, scorer.scores(texts)):
        found, last = [], None
        for word in (text or "").split():
            code = zlib.crc32(word.encode())
            found += [*quality.ngrams([word], quality.SHORTEST, quality.LONGEST, quality.BITS)[0], quality.WORDS + (code >> 16)]
            if last is not None:
                mixed = (last * 0x9E3779B97F4A7C15 + code * 0xBF58476D1CE4E5B9) % 2**64
                found.append(quality.REPEAT if code == last else quality.PAIRS + (mixed >> 48))
            last = code
        mean = model.rows[found].mean(0) if found else np.zeros(quality.DIM)
        z = model.weights @ mean + model.bias
        assert score == pytest.approx(np.exp(z[1]) / np.exp(z).sum())
    assert scorer.scores(texts).tolist() == [scorer.scores([t])[0] for t in texts]


def test_sample_takes_usable_documents_only(spark):
    rows = [(i, "long " * 50 if i % 10 else "short", "s") for i in range(100)]
    labels = spark.createDataFrame([(i, i % 20 // 10) for i in range(1000)], "doc_id long, toxic int")
    sample = labelled_sample(table(spark, rows), labels, "toxic", F.lit(True), 10, 100)
    assert len(sample) == 10 and set(sample["text"]) == {"short"} and set(sample["label"]) == {0, 1}


def test_packing_does_not_depend_on_layout(spark):
    long, short = (table(spark, [(at + i, "the " * n, "s") for i in range(40)]).coalesce(1) for at, n in ((0, 1100), (100, 900)))
    got = packing.pack_documents(long.union(short)).collect()
    assert len(got) == 80 and len(packing.best_fit(np.array([r.length for r in got]))[2]) == 40
    assert len({r.sequence_id for r in got}) <= 50

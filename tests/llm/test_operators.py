"""Operators 2 to 8 and 10: contracts against SQL, brute force, round trips or held-out
accuracy, and edge cases."""

import json
import os
import subprocess
import sys
import time
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orograph.llm import catalog, decontaminate, language, packing, secrets, simhash, toxicity, vptree, warc
from orograph.llm import text as X
from orograph.llm.components import components
from tests.compare import duck, same
from tests.conftest import SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, SMALL), con, catalog.ORACLES[name])


def documents(spark, texts, more="doc_id long, text string, row string, score string"):
    """Documents with extra columns whose names clash with what operators add."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], more)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c"), (4, "a b c"), (4, "a b c"), (5, "x" * 100_000), (6, "é ß 日本 \U0001f600 " * 500)]


# --- 2 --------------------------------------------------------------------------------


def pieces_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def check_packing(texts, rows, window):
    """Pieces hold each document's ids once; sequences are gapless and not too long."""
    slow = Tokenizer.from_file(TOKENIZER)
    ids = {i: np.array(slow.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(ids[i][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[i])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / sum(len(v) for v in ids.values())


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(2, "doc_id")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check_packing(texts, packing.pack(docs).collect(), 2048) < 0.05


def test_packing_edges(spark):
    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "x" * 30_000), (5, "<|endoftext|> a<|endoftext|>b Σας İ ² ½ 日本 don't we'll\x1c\x85\xa0é")]
    check_packing(texts, packing.pack(documents(spark, texts), window=64).collect(), 64)
    assert packing.pack(documents(spark, []), window=64).count() == 0


def test_fast_ids_are_the_tokenizers(spark):
    ranks = packing.ranks_of(TOKENIZER)
    assert ranks is not None and packing.ranks_of(public_tokenizers.path("byte_bpe_50k.json")) is None
    rng = np.random.default_rng(3)
    letters = list("abcdefghij XYZ'sSt ll're-_.,!0123 éàÜßñŐőøÆ²½İΣσ́ẞ日本\x1c\x85\xa0\t\nªº×÷ſK")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    for table in (ranks, None):
        got = packing.Ids(TOKENIZER, table).of([t.encode() for t in texts])
        want = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
        assert all(np.array(w.ids, "<u4").tobytes() == g for w, g in zip(want, got))


def test_the_cache_is_bounded_by_bytes(monkeypatch):
    """Long chunks aren't kept, short ones until they take so much."""
    monkeypatch.setattr(packing, "CACHE", 1 << 20)
    rng = np.random.default_rng(8)
    ids = packing.Ids(TOKENIZER, packing.ranks_of(TOKENIZER))
    most = 0
    tracemalloc.start()
    for _ in range(25):
        long = ["".join(rng.choice(list("abcdefgh日本"), 4000)) for _ in range(20)]
        text = " ".join([*long, *(f"w{k}" for k in rng.integers(0, 1 << 30, 500)), long[0]])
        got = ids.of([text.encode()])[0]
        most = max(most, sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in ids.chunks.items()))
        assert all(len(k) <= packing.KEEP for k in ids.chunks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert np.array(want, "<u4").tobytes() == got and most < 2 << 20 and peak < 64 << 20


def test_long_texts_part_by_part(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["Don't", "stop-", "x" * 50, "é\u0130", "日本"], n)).encode() for n in (0, 1, 2, 3, 4, 300)]
    prints = simhash.fingerprints(texts)
    ids = packing.Ids(TOKENIZER, None)
    whole = ids.of(texts)
    for part in (1, 7, 60, 400):
        monkeypatch.setattr(simhash, "PART", part)
        monkeypatch.setattr(packing, "PART", part)
        assert [int(x) for t in texts for x in simhash.fingerprints([t])] == [int(x) for x in prints]
        assert [packing._whole_ids(ids, [t])[0] for t in texts] == whole


def brute_pack(sizes, window, most):
    """(document, start, length, sequence, offset) by trying every level for each piece."""
    opened, out, number = [], [], 0  # [sequence, fill, pieces], the last used at the end

    def lay(box):
        at = 0
        for d, s, n in box[2]:
            out.append((d, s, n, box[0], at))
            at += n

    def place(d, s, n, opening):
        nonlocal number
        while n:
            opens = opening or not opened
            cutting = len(opened) > most or not opens
            costs = {}
            for fill in {f for _, f, _ in opened} | ({0} if opens else set()):
                if fill + n > window and not (cutting and fill):
                    continue
                after = [f for _, f, _ in opened]
                if fill:
                    after.remove(fill)
                if fill + n < window:
                    after.append(fill + n)
                costs[fill] = sum(after.count(f) ** 2 for f in set(after))
            fill = max(f for f in costs if costs[f] == min(costs.values()))
            if fill:
                box = [b for b in opened if b[1] == fill][-1]
                opened.remove(box)
            else:
                box, number = [number, 0, []], number + 1
            part = min(n, window - fill)
            box[2].append((d, s, part))
            box[1] += part
            s, n = s + part, n - part
            if box[1] == window:
                lay(box)
            else:
                opened.append(box)

    for d, total in enumerate(sizes):
        for s in range(0, total - total % window, window):
            out.append((d, s, window, number, 0))
            number += 1
        place(d, total - total % window, total % window, True)
    while opened:
        least = min(f for _, f, _ in opened)
        box = [b for b in opened if b[1] == least][-1]
        opened.remove(box)
        if not opened:
            lay(box)
            break
        for d, s, n in box[2]:
            place(d, s, n, False)
    return sorted(out)


@pytest.mark.parametrize("most", [64, 3])
def test_packing_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(packing.Level.__init__, "__defaults__", (most,))
    rng = np.random.default_rng(most)
    sizes = np.concatenate((rng.integers(1, 90, 250), rng.integers(1, 9, 100))).tolist()
    rng.shuffle(sizes)
    docs = documents(spark, [(i, "a " * (n - 1)) for i, n in enumerate(sizes)]).coalesce(1)  # "a" is one token
    got = sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in packing.pack(docs, window=32).collect())
    assert got == brute_pack(sizes, 32, most)


# --- 3 --------------------------------------------------------------------------------


def brute_simhash(texts, shingle=3, distance=2):
    prints = {}
    for i, t in texts:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = regex.findall(r"[^\x20\x09-\x0D]+", lower)
        grams = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] if len(words) >= shingle else ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return prints, brute_components(list(prints.items()), distance)


def brute_components(prints, distance=2):
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array([p for _, p in prints], np.uint64)
    for k, (i, p) in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(f ^ np.uint64(p)) <= distance):
            a, b = find(i), find(prints[j][0])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in prints}


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10_000, None), (10_001, " "), (10_002, "One two"), (10_003, "one\ttwo")]
    prints, groups = brute_simhash(texts)
    got = simhash.component_rows(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


@pytest.mark.parametrize(("crowd", "bits"), [(12, None), (2, None), (0, None), (12, 2), (12, 1)])
def test_links_find_all_components(spark, crowd, bits):
    """Dense groups, chains and lone fingerprints; where few may meet, through finer segments."""
    rng = np.random.default_rng(crowd)
    prints = {int(x) for x in rng.integers(0, 1 << 64, 150, np.uint64)} | {0, (1 << 64) - 1, 1 << 63}
    for base in list(prints)[:6]:
        for _ in range(40):
            flips = rng.integers(0, 64, rng.integers(1, 4))
            base2 = base
            for b in flips:
                base2 ^= 1 << int(b)
            prints.add(base2)
            if rng.random() < 0.2:
                base = base2
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    fps = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(fps, crowd, bits)).collect()}
    wanted = brute_components(sorted((s, p) for p, s in signed.items()))
    mine = {s: roots.get(s, s) for s in signed.values()}
    assert len({(mine[s], wanted[s]) for s in mine}) == len(set(mine.values())) == len(set(wanted.values()))


def test_segments_by_size():
    assert [simhash.first_segment(n) for n in (0, 10**6, 10**9, 10**11, 10**14)] == [4, 4, 2, 2, 1]


@pytest.mark.parametrize("bits", [4, 2, 1])
def test_fingerprints_two_bits_apart_meet(spark, bits):
    rng = np.random.default_rng(bits)
    rows = []
    for x in [0, (1 << 64) - 1, *map(int, rng.integers(0, 1 << 64, 60, np.uint64))]:
        a, b = rng.choice(64, 2, replace=False).tolist()
        rows.append((x, x ^ (1 << a) ^ (1 << b)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    pairs = spark.createDataFrame([tuple(map(signed, r)) for r in rows], "a long, b long")
    own = pairs.select(simhash.segment_counts("a", bits).alias("a"), simhash.segment_counts("b", bits).alias("b"))
    assert own.where(F.arrays_overlap(simhash.grid_points("a", bits), simhash.grid_points("b", bits))).count() == len(rows)


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 1001), (1001, 1000), (5, 5)], "a long, b long"))
    roots = {r.node: r.root for r in components(edges).collect()}
    assert len(roots) == n + 3 and len({roots[i] for i in range(n + 1)}) == 1 and roots[1000] == roots[1001] != roots[0]
    assert components(edges.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, EDGES)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_first(docs).collect())
    # 1 to 3 have no words; a null id goes with the group of 4, whose two rows are one document
    assert kept == [(False, 1), (False, 4), (False, 5), (False, 6)]
    assert simhash.keep_first(docs).columns == docs.columns and simhash.keep_first(docs.limit(0)).count() == 0


def test_one_row_stays_of_a_group_without_ids(spark):
    same = [(None, "one two three four")] * 30
    kept = simhash.keep_first(documents(spark, same + [(None, "five six seven"), (7, "eight nine ten")]).repartition(4)).collect()
    assert sorted(r.text for r in kept) == ["eight nine ten", "five six seven", "one two three four"]


# --- 4 --------------------------------------------------------------------------------


def brute_neighbours(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            s = [(-float(vptree.cosine(a[None], b[None])[0]), i) for i, b in ok if i != q and len(b) == len(a)]
            out[q] = [(i, -c) for c, i in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("shard", [64, 10_000])
def test_neighbours_against_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 480)]  # a vector that many rows hold
    rows += [(500, None), (550, [0.0] * 8), (600, [float("nan")] * 8), (650, [None] * 8), (700, []), (750, [1.0, 2.0]), (751, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(vptree.nearest(df, df.where("vec_id % 50 = 0"), shard=shard).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == {q: v for q, v in brute_neighbours(rows, 5, 50).items() if v}
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_parallel_and_extreme_vectors(spark):
    """Ties by id among parallel vectors, tiny and huge components, repeated and clashing rows."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=6)
    rows = [(i, (base * 2.0 ** (i % 9)).tolist()) for i in range(300)]
    rows += [(i, (rng.normal(size=6) * scale).tolist()) for i, scale in zip(range(300, 420), [1e-200, 1e200, 1.0] * 40)]
    rows += [(i, [1e-200, 1e200, 0.0, 1.0, 1e-300, 5e-324]) for i in (420, 421, 450)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + rows[:50] + [(None, rows[0][1])]], "vec_id long, embedding array<double>, ids string, cell int")
    for shard in (50, 10_000):
        got = {}
        for r in vptree.nearest(df, df.where("vec_id % 50 = 0"), shard=shard).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        want = brute_neighbours(rows, 5, 50)
        assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == want
    tree = vptree.Tree(vptree.unit(np.array([v for _, v in rows[:300]])))
    found = vptree._answers(tree, np.array([v for _, v in rows[:300]]), np.ones(300, int), np.arange(300), np.array([rows[0][1]] * 3), 6, 1.0)
    assert [len(h) for h in found.column("hits").to_pylist()] == [6, 6, 6]


def test_cells_far_from_a_query_are_skipped(spark):
    """Clustered vectors: most queries see their own cell only."""
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(20, 8)) * 10
    rows = [(i, (centres[i % 20] + rng.normal(size=8) * 0.01).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    searched = vptree._searched
    try:
        vptree._searched = lambda c, p, routed, *a: (seen.append(routed.count()), searched(c, p, routed, *a))[1]
        got = vptree.nearest(df, df.where("vec_id % 50 = 0"), shard=100)
        want = brute_neighbours(rows, 5, 50)
        assert {(r.query_id, r["rank"]): r.vec_id for r in got.collect()} == {(q, n + 1): i for q, v in want.items() for n, (i, _) in enumerate(v)}
    finally:
        vptree._searched = searched
    assert seen[0] == 40 and seen[1] < 40 * 19 / 3


def test_pairs_of_queries_and_cells_leave_in_steps():
    """10,000 queries that must see all of 4,096 cells: 41 million pairs, never all at once."""
    rng = np.random.default_rng(14)
    pivots = vptree.unit(rng.normal(size=(4096, 4)))
    held = SimpleNamespace(value={4: (pivots, np.zeros(4096), np.full(4096, 2.0))})
    n = 10_000
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=4 * n)), 4).cast(pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, 4, np.int32)), pa.array(np.zeros(n, np.int32)), vectors, pa.array(np.full(n, np.inf))], ["size", "cell", "v", "bound"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in vptree._far(held, 1.0, [batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n * 4095 and peak < 400 << 20


def test_shards_and_pivots_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_BYTES", 40 * 8 * 64)
    monkeypatch.setattr(vptree, "PIVOT_BYTES", 3 * 8 * 64)
    rng = np.random.default_rng(15)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(df, df.where("vec_id % 50 = 0"), shard=100)
    want = brute_neighbours(rows, 5, 50)
    assert {(r.query_id, r["rank"]): r.vec_id for r in got.collect()} == {(q, n + 1): i for q, v in want.items() for n, (i, _) in enumerate(v)}


def test_relaxed_search_still_finds_most():
    rng = np.random.default_rng(5)
    points = vptree.unit(rng.normal(size=(3000, 6)))
    tree, one = vptree.Tree(points), np.ones(3000, int)
    exact = [set(at[:5].tolist()) for _, at in tree.search(points[:60], one, 5)]
    near = [set(at[:5].tolist()) for _, at in tree.search(points[:60], one, 5, factor=0.7)]
    brute = [set(np.argsort(vptree.distances(points[i : i + 1], points)[0])[:5].tolist()) for i in range(60)]
    assert exact == brute
    assert sum(len(a & b) for a, b in zip(near, brute)) >= 0.9 * 300


# --- 5 --------------------------------------------------------------------------------


def test_decontamination_in_blocks(spark):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, r.n_hit, r.n_items, r.items_sha256) for r in df.collect())
    some = decontaminate.judge(decontaminate.find_hits(docs.select("doc_id", "text"), bench, set_bytes=3000)).select("row.doc_id", "n_hit", "n_items", "items_sha256")
    assert key(some) == key(decontaminate.digest_rows(docs, bench))


def test_decontamination_of_long_texts_and_colliding_hashes(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, item), (3, "short one")], "item_id long, text string")
    long = "x y z " * 300 + item + " u v " * 300 + "Short; one " + "t " * 400
    texts = [(1, long), (2, "short one"), (3, "x " * 5000)]
    want = {r.doc_id: r for r in decontaminate.digest_rows(documents(spark, texts), bench).collect()}
    assert (want[1].n_hit, want[1].n_items, want[2].n_hit, want[3].n_hit) == (32, 3, 2, 0)
    mix = X.mix
    monkeypatch.setattr(decontaminate, "BLOCK", 97)
    monkeypatch.setattr(X, "mix", lambda x: mix(x) & np.uint64(0xF))
    assert {r.doc_id: r for r in decontaminate.digest_rows(documents(spark, texts), bench).collect()} == want
    several = decontaminate.find_hits(documents(spark, texts), bench, set_bytes=80)
    assert {(r.doc_id, r.n_hit, r.n_items) for r in decontaminate.judge(several).select("row.doc_id", "n_hit", "n_items").collect()} == {(i, w.n_hit, w.n_items) for i, w in want.items()}


@pytest.mark.parametrize("window", [1, 2])
def test_short_windows_and_long_texts(spark, monkeypatch, window):
    monkeypatch.setattr(decontaminate, "BLOCK", 50)
    docs = documents(spark, [(1, "a b c d e f g h " * 40), (2, "x y " * 30), (3, "a")])
    rows = {r.doc_id: r for r in decontaminate.judge(decontaminate.find_hits(docs, spark.createDataFrame([(1, "c d")], "item_id long, text string"), window)).select("row.doc_id", "n_words", "n_hit").collect()}
    assert [(rows[i].n_words, rows[i].n_hit) for i in (1, 2, 3)] == [(320, 80), (60, 0), (1, 0)]


def test_decontamination_edges(spark):
    item = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "..."), (4, "short one"), (None, "a b c")], "item_id long, text string")
    texts = EDGES + [(20, f"x {item.upper()} y"), (21, "a Short, ONE b"), (22, "short " + "z " * 50 + "one")]
    found = {r.doc_id: r for r in decontaminate.digest_rows(documents(spark, texts), bench).collect()}
    assert (found[20].n_words, found[20].n_hit, found[20].n_items, found[20].contaminated) == (17, 15, 1, True)
    assert found[21].n_hit == 2 and found[22].n_hit == 0 and found[1].n_words == 0 and not found[1].contaminated
    kept = decontaminate.drop_contaminated(documents(spark, texts), bench)
    assert kept.count() == len(texts) - 2 and kept.columns == ["doc_id", "text", "row", "score"]
    cleaned = {r.doc_id: r.text for r in decontaminate.cut_spans(documents(spark, texts), bench).collect()}
    assert cleaned[20] == "x y" and cleaned[4] == "a b c"
    assert decontaminate.digest_rows(documents(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.digest_rows(documents(spark, []), bench).count() == 0


# --- 6 --------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(20).union(spark.createDataFrame([(900, None, None), (None, "u", "<p>x</p>")], "page_id long, url string, html string"))
    records = warc.derive(warc.responses(pages))
    warc.write_warc(records, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out"))
    key = lambda df: sorted((r.record_type, r.record_id, r.refers_to, r.linked_to, r.target_uri or "", r.block_digest, r.source_digest, bytes(r.block)) for r in df.collect())
    assert key(back) == key(records.withColumn("block", F.col("block").cast("binary")))
    ids = {r.record_id for r in records.collect()}
    assert len(ids) == 44 and all(r.linked_to in ids for r in records.collect())
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_files_cut_off_and_gzipped(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<title>T{i}</title><p>é {i}</p>", "x") for i in (1, 2, 2)], "page_id long, url string, html string, block string")
    records = warc.derive(warc.responses(pages))
    assert records.count() == 6 and records.distinct().count() == 4
    one = b"".join(r.value.encode() + b"\r\n\r\n" for r in warc.serialised(records.where("key = 1")).collect())
    assert one.count(b"WARC-Source-HTTP-Headers: HTTP/1.1 200 OK | Content-Type") == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(one[:-30])
    (tmp_path / "in" / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (one, one)) + gzip.compress(one)[:40])
    (tmp_path / "in" / "c.warc").write_bytes(b"")
    (tmp_path / "in" / "d.warc").write_bytes(b"WARC/1.1\r\nContent-Le")
    read = warc.read_warc(spark, str(tmp_path / "in"))
    assert read.where("problem is null").count() == 1 + 4
    assert read.where("problem = 'cut off'").count() == 2 and read.where("problem is not null and block is not null").count() == 0


def test_damaged_records_and_headers_in_any_case(spark, tmp_path):
    """A wrong length costs its record only; digests of the source stay; what isn't text has
    no conversion."""
    record = lambda i, length, block, more=b"": b"WARC/1.1\r\nwarc-type: response\r\nWARC-record-ID:<urn:%d>\r\n%sCONTENT-LENGTH: %s\r\n\r\n%s\r\n\r\n" % (i, more, length, block)
    ok = lambda kind: b"HTTP/1.1 200 OK\r\ncontent-type: %s\r\n\r\n<p>x</p>" % kind
    texts = [ok(b"text/html; charset=utf-8"), ok(b"image/png"), ok(b"text/html\r\ncontent-encoding: gzip"), ok(b"TEXT/plain\r\nTransfer-Encoding: chunked"), b"HTTP/1.1 200 OK\r\n\r\ny"]
    rows = [record(i, b"%d" % len(t), t, b"warc-payload-digest: sha1:ABC\r\n") for i, t in enumerate(texts)]
    rows.insert(2, record(90, b"3", texts[0])), rows.insert(1, record(91, b"x1", texts[0])), rows.insert(0, record(92, b"", texts[0]))
    (tmp_path / "r.warc").write_bytes(b"".join(rows) + record(93, b"999", b"tail"))
    read = warc.read_warc(spark, str(tmp_path / "r.warc"))
    assert sorted((r.record_id, r.problem) for r in read.where("problem is not null").collect()) == [("<urn:90>", "length"), ("<urn:91>", "length"), ("<urn:92>", "length"), ("<urn:93>", "cut off")]
    made = warc.derive(warc.split_responses(read)).collect()
    assert sorted((r.refers_to, r.record_type) for r in made) == sorted([(f"<urn:{i}>", "metadata") for i in range(5)] + [("<urn:0>", "conversion"), ("<urn:4>", "conversion")])
    assert all(r.source_digest == "sha1:ABC" and (r.linked_to is None) == (r.refers_to in ("<urn:1>", "<urn:2>", "<urn:3>")) for r in made)


@pytest.mark.parametrize("part", ["<!--", "<script>", "<script ", "<p ", "<a ", "<title>", "<title ", "<x <p>"])
def test_unclosed_pages_take_linear_time(spark, part):
    pages = spark.createDataFrame([(i, "u", part * (1_000_000 // len(part)) + end, "b") for i, end in enumerate(["", "</script>", "-->", ">", "</title>"])], "page_id long, url string, html string, block string")
    began = time.perf_counter()
    assert warc.derivative_rows(pages).count() == 10
    assert warc.derivative_rows(pages).agg(F.sum("content_length")).first()[0] > 0
    assert time.perf_counter() - began < 60


def test_guarded_steps_are_the_plain_ones(spark):
    """On pages put together from openings and closings at random."""
    rng = np.random.default_rng(6)
    parts = ["<!--", "-->", "<script>", "<script x", "</script>", "</SCRIPT >", "<style>", "</style>", "<svg ", "</svg>", "<noscript>", "</noscript>", ">", "<p ", "<p>", "</p>", " a ", "<", "&amp;", "<title>", "</title>", "<title x", "<a href=", "<a ", "href = 'x'", "<template>", "</template\n>"]
    rows = spark.createDataFrame([("".join(rng.choice(parts, rng.integers(0, 40))),) for _ in range(3000)], "h string")
    h, plain = F.col("h"), F.col("h")
    for pattern, to in warc.STEPS:
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(to))
    same = (warc.plain_text(h) == warc._tidy(plain)) & (warc.title_of(h) == F.regexp_extract(h, warc.TITLE, 1)) & (warc.links_of(h) == F.regexp_count(h, F.lit(warc.LINK)))
    assert rows.where(~same).count() == 0


def test_warc_pages_as_their_sql_has_them(spark, tmp_path):
    """Pages put together at random, whole and broken, with odd spaces and entities; each
    kind of piece also more often than texts are split. Blanks in front of a last U+2028
    stay, as in SQL."""
    rng = np.random.default_rng(7)
    whole = ["<!-- x -->", "<!--<p>-->", "<script>a<b</script>", "<SCRIPT src='x'>\n</script >", "<style>p{}</style>", "<svg><title>s</title></svg>", "<noscript><p>n</p></noscript>", "<template></template>", "<title>T &amp; U\t</title>", "<p>", "</p>", "<br/>", "<b>", "</b>", "<a href='x'>", "<pre>", "<!doctype html>"]
    broken = ["<!--", "-->", "<!-->", "<script", "<scripty>", "<script </script>", "</script", "</script <!-- -->>", "<style>", "</style>", "<svg", "<p ", "<b ", "<title", "<a ", "<", ">", "</", "2 < 3 > 1", "<<b>p>", "<pé>", "<svgé", "</style\x0b>", "<a\x0bhref=''>", "<a href\x0b=>", "<p_>", "<hr1>"]
    texts = [" ", "  ", "\n", " \n ", "\t", "\r\n", "\f", "\x0b", "\u2028", "\u00a0", "é", "x", "word", "&", "&amp;", "&#38;", "&amp;#38;", "&amp;amp;", "&amp;lt;", "&#38;#38;", "&lt;", "&#60;p&#62;", "&nbsp;", "&#160;", "&quot;", "&#39;", "&copy;", "&am", "p;", "#38;", "lt;"]
    pages = ["".join(rng.choice(whole * 3 + texts + broken * (k % 2), rng.integers(0, 30))) for k in range(4000)]
    pages += ["x \u2028", " \n\u2028\n ", "", "a\n" * 5000, "a & b &lt; " * 5000, "<p>a  <b>b</b>" * 5000 + "<b", "<script>x</script> y<!-- z -->" * 5000, "\n" * 5000 + " x\n" + " " * 5000]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u")).write.parquet(str(tmp_path / "pages.parquet"))
    same(warc.derivative_rows(spark.read.parquet(str(tmp_path / "pages.parquet"))), duck(tmp_path), warc.ORACLE)


def test_pages_take_few_passes(spark):
    """All derived records cost less than the steps of plain text alone would one by one."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    pages = pages.union(pages).union(pages).union(pages).repartition(4).cache()
    steps = F.col("html")
    for pattern, to in (*warc.STEPS, *warc.SPACES):
        steps = F.regexp_replace(steps, F.lit(pattern), F.lit(to))

    def least(df):
        taken = []
        for _ in range(6):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        return min(taken)

    pages.count()
    one_by_one, all_records = least(pages.select(steps.alias("t"))), least(warc.derivative_rows(pages))
    pages.unpersist()
    assert all_records < one_by_one, (all_records, one_by_one)


def test_responses_of_files(spark, tmp_path):
    block = b"HTTP/1.1 404 Not Found\r\nServer: x\r\n\r\n<title>Gone</title><p>nothing\r\n\r\nhere</p>"
    (tmp_path / "r.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://a\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block))
    made = {r.record_type: r for r in warc.derive(warc.split_responses(warc.read_warc(spark, str(tmp_path / "r.warc")))).collect()}
    assert made["conversion"].block == "Gone\nnothing\nhere" and made["conversion"].refers_to == "<urn:x>"
    assert made["metadata"].source_headers == "HTTP/1.1 404 Not Found\r\nServer: x" and "title: Gone" in made["metadata"].block


def test_plain_text(spark):
    html = "<html><head><title>T &amp; U</title><script>var a='<p>';</script></head><body><!-- no --><p>One<b>two</b>&nbsp;&lt;3</p><div> a  b <br>c</div>2 < 3</body></html>"
    page = spark.createDataFrame([(html,)], "h string").select(warc.plain_text(F.col("h")).alias("t")).first().t
    assert page == "T & U\nOnetwo <3\na b\nc\n2 < 3"


# --- 7 and 10 -------------------------------------------------------------------------


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(4000)
    got = language.predict_rows(docs).join(docs.select("doc_id", "lang"), "doc_id")
    n, right = got.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 1000 and right / n > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    texts = [(i, t) for i, t in [(1, None), (2, ""), (3, "123 !?"), (None, "der und die"), (4, "日本"), (5, "a\0b")]]
    model = language.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {r.doc_id: r for r in language.predict(documents(spark, texts), model).select("row.doc_id", "lang_pred", "score").collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and got[4].lang_pred in model.languages and got[5].lang_pred in model.languages
    none = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in language.predict(documents(spark, [(1, "text")]), none).collect()] == ["und"]


def test_repeated_ids_leave_no_language_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    one, twice = language.train(docs, 60), language.train(docs.union(docs), 60)
    assert len(one.languages) == 4 and twice.languages == one.languages and np.array_equal(twice.table, one.table)
    # an id, not held out, of a third of the rows; its documents differ
    shared = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 3).otherwise(F.col("doc_id")))
    assert language.train(shared, 60).languages == one.languages


def brute_language(model, text):
    """Prediction word by word and gram by gram."""
    raw = text.lower().encode()
    words = regex.findall(rb"[A-Za-z\x80-\xff]+", raw)
    total, n = np.zeros(len(model.languages)), 0
    for w in words:
        for size in language.SIZES:
            for i in range(len(w) + 3 - size):
                gram = (b" " + w + b" ")[i : i + size]
                h = X.window_hash(X.byte_values()[np.frombuffer(gram, np.uint8)], size)[0]
                total += model.table[:, int(h % np.uint64(language.BUCKETS))]
                n += 1
    p = language.softmax((total / max(1, n) + model.bias)[None] / model.temperature)[0]
    return model.languages[int(p.argmax())], float(p.max())


def test_language_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs)
    texts = [(r.doc_id, r.text[:400]) for r in docs.collect() if r.text][:60] + [(9000, "Ünder ﬁ 1x2 ÀB"), (9001, "a")]
    monkeypatch.setattr(language, "PART", 100)  # texts in several parts
    got = {r.doc_id: r for r in language.predict(documents(spark, texts), model).select("row.doc_id", "lang_pred", "score").collect()}
    for i, t in texts:
        lang, score = brute_language(model, t)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-5


def test_held_out_column(spark):
    from orograph.llm.common import held_out

    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_toxicity_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score_rows(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out")
    toxic, caught = got.where("toxic = 1").agg(F.count("*"), F.sum("predicted")).first()
    clean, blamed = got.where("toxic = 0").agg(F.count("*"), F.sum("predicted")).first()
    # some labels are noise: documents without a toxic word
    assert caught >= 0.9 * toxic and blamed <= 0.01 * clean


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T! ехсеllеnt, ｆｏｏ $tupid".encode()) == " idiot excellent foo stupid "
    model = toxicity.Model({" idiot": 3.0, " idiotic ": 4.0, " clown ": 2.0}, [" no idiot "])
    a = model.automaton()
    assert [(e, w) for _, e, w in toxicity.matches(a, toxicity.fold(b"Idiotic clown, no idiot; an ID10T"))] == [(" idiotic ", 4.0), (" clown ", 2.0), (" idiot", 3.0)]
    assert toxicity.signals(a, toxicity.fold(b"")) == (0.0, 0.0, 0)


def brute_score(model, text):
    """The score by looking for every entry at every place."""
    t = toxicity.fold(text.encode())
    gone = {i for p in model.exceptions for k in range(len(t)) if t.startswith(p, k) for i in range(k, k + len(p) - 1)}
    total = 0.0
    for k in range(len(t)):
        total += max((w for e, w in model.weights.items() if k not in gone and t.startswith(e, k)), default=0.0)
    z = np.log1p(total) * model.curve[0] + np.log1p(100 * total / max(1, len(t.split()))) * model.curve[1] + model.curve[2]
    return 1 / (1 + np.exp(-z))


def test_toxicity_against_brute_force(spark):
    rng = np.random.default_rng(6)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choice(plain, 25).tolist()
        kind = i % 3
        if kind == 0:  # toxic
            words[int(rng.integers(25))] = str(rng.choice(["k1ller", "vermin", "Killers"]))
        elif kind == 1:  # clean, though with the word
            words[int(rng.integers(24))] = "killer whale"
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " killer whale " in model.exceptions and any(e.startswith(" kill") for e in model.weights)
    more = [(2000, "killer whale killer whale"), (2001, "A killer! whale"), (2002, ""), (2003, "vermin killer whale vermin " * 40)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows + more, "doc_id long, text string"), model).select("row.doc_id", "score", "predicted").collect()}
    for i, t in rows[:120] + more:
        assert abs(got[i].score - brute_score(model, t)) < 1e-9
    wrong = sum(got[i].predicted != toxic for i, toxic in labels)
    assert wrong == 0


def test_a_shared_id_takes_no_more_of_the_sample(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 3).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert toxicity._sampled(docs, labels, 100).count() == 100


def test_workers_need_no_package():
    """With the repository on the driver's path only, op7 and op10 run."""
    code = f"""
import sys
import time
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from orograph.llm import catalog
for name in ("op7_language", "op10_toxicity"):
    assert catalog.QUERIES[name](spark, {SMALL!r}).count() == 200
print("both ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.path.dirname(public_tokenizers.__file__) + "/.."}
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, capture_output=True, text=True, timeout=300)
    assert "both ran" in out.stdout, out.stderr[-2000:]


def test_toxicity_edges(spark):
    docs = documents(spark, EDGES)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, none).collect()
    assert len(got) == len(EDGES) and all(r.score == 0 and r.predicted == 0 for r in got)
    learned = toxicity.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, learned).collect())
    assert toxicity.drop_toxic(docs, learned).columns == docs.columns


# --- 8 --------------------------------------------------------------------------------


def test_secrets(spark):
    key, aws, hx = "Zx9Kq2Lm8Vb4Tn6Rw1Yp", "AKIA" + "Q1W2E3R4T5Y6", "0123456789abcdef" * 2
    texts = [
        (1, f"é password = 'hunter2hunter' {aws} {hx}"), (2, f"token: short {key} tail"), (3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa Internationalization_of_everything 12345678901234567890123"),
        (4, "550e8400-e29b-41d4-a716-446655440000 EXAMPLE" + key), (5, "AKIA123 " + "a1" * 15), (6, None), (7, ""), (8, f"API_KEY={key}{key}"),
    ]
    got = {r.doc_id: r for r in secrets.scan_rows(documents(spark, texts)).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 1) and got[1].spans == "assign:2:27,access:29:45,hex:46:78"
    assert got[2].spans == "entropy:13:33" and got[3].spans == got[4].spans == got[6].spans == got[7].spans == ""
    assert got[8].spans == "assign:0:48"
    clean = {r.doc_id: r.text for r in secrets.redact(documents(spark, texts)).collect()}
    assert clean[1] == "é [secret]' [secret] [secret]" and clean[2] == "token: short [secret] tail" and clean[3] == texts[2][1] and clean[6] is None
    with_size = spark.createDataFrame([(1, f"x {aws}", 18)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redact(with_size).collect()] == [(1, "x [secret]", 10)]


def test_redaction_goes_beyond_base_matches_and_excused_pieces(spark):
    aws, key = "AKIA" + "Q1W2E3R4T5Y6U7I8", "wJalrXUtnFEMIK7MDENGbPxRfiCYzKq2Lm8Vb4Tn"
    uuid = "550e8400-e29b-41d4-a716-446655440000"
    texts = [f"{aws}/{key} x", f"Zx9Kq2Lm8V{'9f3b7c1de04a8256' * 2}Tn6Rw1Yp x", f"example/{key} x", f"{key}_{uuid} x", f"{uuid}/example-words_only x", f"example{key} x", "x" * 50_000]
    clean = {r.doc_id: r.text for r in secrets.redact(documents(spark, list(enumerate(texts)))).collect()}
    assert [clean[i] for i in range(4)] == ["[secret] x"] * 4 and [clean[i] for i in (4, 5, 6)] == texts[4:]


def test_many_secrets_in_one_text(spark):
    """Spans in blocks, by start; candidates apart from base matches; pieces put together."""
    parts = [f"AKIA{i:016d} k{i} Zx9Kq2Lm8Vb4Tn6Rw{i % 10}Yp" if i % 3 else f"secret={i:08d}x" for i in range(3000)]
    text = "é".join(parts)
    rows = documents(spark, [(1, text), (1, text), (2, None)])
    got = sorted(secrets.scan_rows(rows).collect(), key=lambda r: r.doc_id)
    assert [r.n_access for r in got] == [2000, 2000, 0] and [r.n_assign for r in got] == [1000, 1000, 0]
    spans = [tuple(map(int, s.split(":")[1:])) for s in got[0].spans.split(",")]
    assert len(spans) == 5000 and spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert all(text[a:b] in p or text[a:b] == p for (a, b), p in zip([s for s in spans if text[s[0]] == "s"], parts[::3]))
    clean = secrets.redact(rows.where("doc_id = 1")).first().text
    assert clean == "é".join(f"[secret] k{i} [secret]" if i % 3 else "[secret]" for i in range(3000))
    assert secrets.scan_rows(rows.limit(0)).count() == secrets.redact(rows.limit(0)).count() == 0


def brute_best_sum(s, n=20):
    return min(sum(secrets._SUMS[s[i : i + n].count(c)] for c in set(s[i : i + n])) for i in range(len(s) - n + 1))


def test_sliding_entropy_is_that_of_each_window(spark):
    rng = np.random.default_rng(2)
    strings = ["".join(rng.choice(list(secrets.ALPHABET[:k]), rng.integers(20, 70))) for k in (2, 5, 16, 66) for _ in range(8)]
    rows = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets._most_entropy(F.col("s")).alias("least")).collect()
    assert all(r.least == brute_best_sum(r.s) for r in rows)


def test_base_positions_against_regex(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    kinds = [("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    wanted = {}
    for i, t in texts:
        spans = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in regex.finditer(p, t, flags=regex.I | regex.A if name == "assign" else 0) if ok(m)]
        wanted[i] = ",".join(s for *_, s in sorted(spans))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs).select("row.doc_id", secrets._named("base").alias("spans")).collect()}
    assert got == wanted and json.dumps(got)


def test_one_very_long_candidate(spark):
    """A megabyte of base64, of words and of separators: time and stack go with the length."""
    rng = np.random.default_rng(4)
    key = "".join(rng.choice(list(secrets.ALPHABET[:64]), 1_000_000))
    texts = [(1, key), (2, "Ab-" * 350_000), (3, "AB_" * 350_000), (4, "aB-" * 350_000), (5, "x " + "Ab-" * 20_000 + "9f3B7c1De04a8256Qz9K")]
    began = time.perf_counter()
    got = {r.doc_id: r.spans for r in secrets.scan_rows(documents(spark, texts)).collect()}
    assert got[1] == f"entropy:0:{len(key)}" and got[2] == got[3] == got[4] == "" and got[5] == "entropy:2:60022"
    clean = {r.doc_id: r.text for r in secrets.redact(documents(spark, texts)).collect()}
    assert clean[1] == "[secret]" and clean[2] == texts[1][1] and clean[5] == "x [secret]"
    assert time.perf_counter() - began < 40

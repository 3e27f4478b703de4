"""Operators 1 and 9 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from orograph.llm import recurring, substring_dedup, suffix_dedup, text
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, n_words string"


def brute_words(docs, window=20):
    first, out = {}, {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), (i, p))
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(docs, depth=200):
    count, out = {}, {}
    raw = {i: (t or "").encode() for i, t in docs}
    for b in raw.values():
        for p in range(len(b) - depth + 1):
            k = b[p : p + depth]
            count[k] = count.get(k, 0) + 1
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if count[b[p : p + depth]] > 1:
                gone[p : p + depth] = b"\1" * depth
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def words_of(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def bytes_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def shared_passages(n, seed):
    """Texts that share passages in different surroundings, copies and periodic texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(3)]
    docs = [(0, None), (1, ""), (2, "a"), (3, "x y " * 300), (4, "x y " * 300), (5, "z" * 900)]
    for i in range(6, n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            cut = rng.randint(0, 200)
            parts += [p[cut : cut + rng.randint(100, 360)], " ".join(word() for _ in range(rng.randint(0, 30)))]
        docs.append((i, "\n".join(parts)))
    return docs + [(n, docs[-1][1])]


def test_words_match_brute_force_on_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert words_of(substring_dedup.remove_repeated_passages(docs)) == brute_words(rows)


def test_bytes_match_brute_force_on_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(80)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bytes_of(suffix_dedup.remove_repeated_bytes(docs)) == brute_bytes(rows)


@pytest.mark.parametrize("crowd", [2000, 5])
def test_shared_passages(spark, crowd, monkeypatch):
    """With a small CROWD, anchors are refined down to single windows."""
    monkeypatch.setattr(recurring, "CROWD", crowd)
    rows = shared_passages(90, crowd)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    assert words_of(substring_dedup.remove_repeated_passages(docs)) == brute_words(rows)
    assert bytes_of(suffix_dedup.remove_repeated_bytes(docs)) == brute_bytes(rows)


def test_edge_cases(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(7, same), (7, same), (None, same), (8, same), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeated_passages(docs).collect())
    # a null id sorts first and keeps its text; repeated rows count as one document
    assert out == [(False, 0, 40, 0), (True, 7, 40, 40), (True, 7, 40, 40), (True, 8, 40, 40), (True, 9, 0, 0)]
    twice = spark.createDataFrame([(1, "é" * 150), (1, "é" * 150)], "doc_id long, text string")
    # 300 equal bytes in one document: strings of 200 bytes start at several places
    assert [r.n_removed for r in suffix_dedup.remove_repeated_bytes(twice).collect()] == [300, 300]
    empty = docs.limit(0)
    assert substring_dedup.remove_repeated_passages(empty).count() == 0
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_kept_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(5))
    docs = spark.createDataFrame([(1, a), (2, f"{b} {a} {b}")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substring_dedup.remove_repeated_passages(docs).collect()} == {1: a, 2: f"{b} {b}"}


def test_rows_without_ids_and_repeated_rows(spark):
    """A thousand of each: places of one key stay as few as those of one document."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    passage = words(60)
    alone = [(None, f"{words(40)} {i} {passage if i % 2 else ''} {words(20)}") for i in range(1000)]
    docs = spark.createDataFrame(alone + [(3, passage + " end")] * 1000 + [(5, words(80))] * 1000, "doc_id long, text string")
    by_words = substring_dedup.remove_repeated_passages(docs).collect()
    assert len(by_words) == 3000
    assert all(r.n_removed == 0 for r in by_words if r.doc_id == 5) and all(r.n_removed == 60 for r in by_words if r.doc_id == 3)
    # of those without an id, all but the first in order lose the passage
    assert sum(r.n_removed >= 60 for r in by_words if r.doc_id is None) == 499
    by_bytes = suffix_dedup.remove_repeated_bytes(docs).collect()
    assert all(r.n_removed == 0 for r in by_bytes if r.doc_id == 5)
    size = len(passage)
    if size >= 200:
        assert all(r.n_removed >= size for r in by_bytes if r.doc_id == 3) and sum(r.n_removed >= size for r in by_bytes if r.doc_id is None) == 500


@pytest.mark.parametrize("crowd", [2000, 2])
def test_hashes_that_collide(spark, crowd, monkeypatch):
    """With hashes of 8 bits, all decisions fall to the texts themselves."""
    mix = text.mix
    monkeypatch.setattr(text, "mix", lambda x: mix(x) & np.uint64(0xFF))
    monkeypatch.setattr(recurring, "CROWD", crowd)
    rows = shared_passages(60, 5)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    assert words_of(substring_dedup.remove_repeated_passages(docs)) == brute_words(rows)
    assert bytes_of(suffix_dedup.remove_repeated_bytes(docs)) == brute_bytes(rows)


def test_pieces_of_long_texts(spark, monkeypatch):
    """Texts of many blocks give what whole ones do."""
    monkeypatch.setattr(recurring, "BLOCK", 700)
    rows = shared_passages(40, 6) + [(100, "w" * 5000 + " a b " * 200 + "v" * 3000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    assert words_of(substring_dedup.remove_repeated_passages(docs)) == brute_words(rows)
    assert bytes_of(suffix_dedup.remove_repeated_bytes(docs)) == brute_bytes(rows)


def test_a_very_long_text(spark):
    """20 MB in one text, with a passage that another document has, too."""
    rng = np.random.default_rng(8)
    words = rng.integers(10**6, 10**7, 2_500_000).astype("S7").tolist()
    long = b" ".join(words).decode()
    passage = long[10_000_000:10_000_800]
    docs = spark.createDataFrame([(1, long), (2, "x " + passage + " y")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeated_passages(docs, with_text=False).collect()}
    assert got[1].n_words == 2_500_000 and got[1].n_removed == 0 and 95 <= got[2].n_removed <= 101
    got = {r.doc_id: r for r in suffix_dedup.remove_repeated_bytes(docs, with_text=False).collect()}
    assert got[1].n_bytes == len(long) and got[1].n_removed == 800 + (long[9_999_999] == " ") + (long[10_000_800] == " ") and got[1].n_spans == 1


def test_radix_passes_against_whole_windows():
    rng = np.random.default_rng(9)
    for depth in (5, 8, 19):
        data = bytes(rng.integers(0, 2, 900, np.uint8))
        place = rng.permutation(900 - depth)[:600]
        group = rng.integers(0, 3, 600)
        twice = rng.random(600) < 0.05
        got = suffix_dedup.repeated(data, place, group, np.where(twice, 2, 1), depth)
        keys = [(g, data[p : p + depth]) for g, p in zip(group.tolist(), place.tolist())]
        assert got.tolist() == [t or keys.count(k) > 1 for k, t in zip(keys, twice.tolist())]


def test_buckets_sort():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 70_000, 5000).astype(np.uint64), rng.integers(0, 1 << 64, 5000, np.uint64) >> rng.integers(0, 64, 5000).astype(np.uint64)
    assert suffix_dedup._bucketed(a, b).tolist() == np.lexsort((b, a)).tolist()
    assert suffix_dedup._bucketed(a[:0]).tolist() == []


def test_every_removed_byte_comes_through_the_digits(spark, monkeypatch):
    """Groups are judged after the last digit only: without what the passes leave nothing is
    removed, copies of segments included."""
    monkeypatch.setattr(suffix_dedup, "repeated", lambda data, place, *a: np.zeros(len(place), bool))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert suffix_dedup.remove_repeated_bytes(docs, with_text=False).where("n_removed > 0").isEmpty()


def test_every_removed_word_comes_from_an_automaton(spark, monkeypatch):
    """Without passages for the automata nothing is removed, copies included."""
    monkeypatch.setattr(substring_dedup, "_passages", lambda *a: set())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert substring_dedup.remove_repeated_passages(docs, with_text=False).where("n_removed > 0").isEmpty()

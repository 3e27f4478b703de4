"""Operator 12: CRCs, weights and draws against plain Python; edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orograph.llm import resampling

WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def documents(spark, texts):
    """Documents with extra columns whose names clash with what the operator adds."""
    return spark.createDataFrame([(i, t, "x", "y", 5) for i, t in texts], "doc_id long, text string, row string, t string, weight int")


def grams(text, most):
    words = WORDS.findall((text or "").encode().lower())
    return words, [b" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, most=2, buckets=10_000, least=20, percent=25, seed=7):
    """(doc_id, n_features, weight, score, rank) of each document."""
    bucket = lambda f: zlib.crc32(f) % buckets
    s, t = (Counter(bucket(f) for _, x in rows for f in grams(x, most)[1]) for rows in (docs, target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, x in docs:
        words, f = grams(x, most)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {id(r): n + 1 for n, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def made_up(n, seed=1):
    draw = random.Random(seed)
    vocabulary = ["a", "Bc", "dé", "日本", "x9", "w" * 63, "v" * 64, "u" * 65, "t" * 700, "B2B", "it's"]
    return [(i, draw.choice(["", " ", "-"]).join(draw.choice(vocabulary) + draw.choice([" ", "; ", "\n"]) for _ in range(draw.randint(0, 60)))) for i in range(n)]


def test_shifts_are_those_of_zlib():
    draw = np.random.default_rng(5)
    a, b = draw.bytes(70), draw.bytes(3 << 16)
    for n in (0, 1, 2, 63, 64, 65, 128, 1000, 65_535, 3 << 16):
        shifted = resampling.SHIFT(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]
        assert shifted ^ zlib.crc32(b[:n]) == zlib.crc32(a + b[:n])


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_crcs_of_runs(monkeypatch, block):
    """Also of texts in blocks: no run across texts, none twice, none lost."""
    monkeypatch.setattr(resampling, "BLOCK", block)
    raw = [(t or "").encode() for _, t in made_up(40)]
    got = [Counter() for _ in raw]
    words = np.zeros(len(raw), int)
    for first, new, runs in resampling.features(raw, 4):
        words[first : first + len(new)] += new
        for crc, text in runs:
            for c, t in zip(crc.tolist(), text.tolist()):
                got[first + t][c] += 1
    for i, t in enumerate(raw):
        w, f = grams(t.decode(), 4)
        assert words[i] == len(w) and got[i] == Counter(map(zlib.crc32, f))


def test_against_brute_force(spark):
    docs, target = made_up(300), made_up(30, 2) + [(0, None), (None, "")]
    docs += [(1000, None), (1001, ""), (1002, "one"), (None, "a b " * 30)]
    assert found(resampling.sample_rows(documents(spark, docs).repartition(7), documents(spark, target))) == brute(docs, target)


def test_other_parameters(spark, monkeypatch):
    docs, target = made_up(80), made_up(10, 2)
    gain = resampling.gains(documents(spark, docs), documents(spark, target), 3, 100)
    rows = resampling.ranked(resampling.weigh(documents(spark, docs), gain, 3, 1), 5, 50)
    assert found(rows) == brute(docs, target, 3, 100, 5, 50, 1)
    assert rows.where("row.t = 'y'").count() == 80


def test_drawn_rows_keep_their_columns(spark):
    docs, target = made_up(120), made_up(10, 2)
    drawn = resampling.resampled(documents(spark, docs), documents(spark, target))
    assert drawn.columns == ["doc_id", "text", "row", "t", "weight"]
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r[0] for r in brute(docs, target) if r[4])


def test_repeated_rows_and_ties(spark):
    """A third of the rows are one document: ranks have no gaps and go on through it."""
    one = (7, "same text " * 15)
    docs = made_up(200) + [one] * 100
    rows = resampling.sample_rows(documents(spark, docs).repartition(5), documents(spark, made_up(5, 2))).collect()
    ranks = sorted(r["rank"] for r in rows if r["rank"])
    fit = sum(len(grams(t, 1)[0]) >= 20 for _, t in docs)
    assert len(rows) == 300 and ranks == list(range(1, 25 * fit // 100 + 1))
    drawn = sorted((r["rank"], r.score, r.doc_id) for r in rows if r["rank"])
    assert all((-a[1], a[2]) <= (-b[1], b[2]) for a, b in zip(drawn, drawn[1:]))
    assert max(r.score for r in rows if r["rank"] is None and r.n_features >= 39) <= drawn[-1][1]


def test_empty_tables(spark):
    docs, none = made_up(30), documents(spark, [])
    assert found(resampling.sample_rows(documents(spark, docs), none)) == brute(docs, [])
    assert resampling.sample_rows(none, documents(spark, docs)).count() == 0
    assert resampling.resampled(none, none).count() == 0


def test_a_very_long_text(spark):
    docs = [(1, "ab cde " * 400_000), (2, "x" * 1_000_000), (3, "a")]
    rows = {r.doc_id: r for r in resampling.sample_rows(documents(spark, docs), documents(spark, [(1, "ab cde")])).collect()}
    assert rows[1].n_features == 1_599_999 and rows[2].n_features == 1
    assert found(resampling.sample_rows(documents(spark, docs), documents(spark, [(1, "ab cde")]))) == brute(docs, [(1, "ab cde")])

"""Operator 11: places of phrases against a search word by word, notices, edge cases."""

import random
import re
import time

import pytest

from orograph.llm import licenses
from tests.conftest import SMALL

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def documents(spark, texts):
    """Documents with extra columns whose names clash with what the operator adds."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], "doc_id long, text string, row string, labels string, base string")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text):
    """Words, base places and labels of all phrases, compared at every word."""
    words, known = words_of(text), licenses.templates()
    found = [(t, i) for t in known if not t.keys and t.label for i in range(len(words)) if tuple(words[i : i + len(t.words)]) == t.words]
    base = sorted(i for t, i in found if t.base)
    return len(words), base, sorted({t.label for t, _ in found if t.base}), {t.label for t, _ in found}


def check(rows, texts):
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for i, t in texts:
        n, base, base_labels, labels = brute(t)
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), base[0] if base else None, base[-1] if base else None), i
        assert r.base_labels == ",".join(base_labels) and labels <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_places_against_brute_force(spark):
    draw = random.Random(3)
    parts = ["gnu", "general", "public", "license", "GNU General Public License", "Apache", "License,", "version 2.0", "MIT License", "mit", "cc", "by", "CC-BY-NC", "by sa", "the", "ÉCOLE", "K", "rights reserved", "all", "3"]
    texts = [(i, " ".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))) for i in range(150)]
    texts += [(1000, None), (1001, ""), (1002, " ;;\n"), (1003, "cc by"), (1004, "cc\0by cc by by"), (1005, "xmit license mit licenses"), (1006, "é CC_BY é")]
    check(licenses.scan_rows(documents(spark, texts)).collect(), texts)


def test_real_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(licenses.scan_rows(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def notice(label):
    return next(t for t, name, _ in licenses.NOTICES if name == label)


def test_notices_are_found_with_edits(spark):
    mit, gpl, bsd = notice("mit-notice").split(), notice("gpl-notice").split(), notice("bsd-notice")
    edited = mit[:20] + ["really"] + mit[20:30] + mit[32:]
    apart = gpl[:26] + ["filler"] * 100 + gpl[26:]
    texts = [
        (1, "Some code. " + notice("mit-notice").capitalize()),
        (2, " ".join(["word"] * 500 + edited)),
        (3, notice("mit-notice").replace("without restriction", "with restriction")),
        (4, " ".join(apart)),
        (5, " ".join(sorted(mit))),
        (6, " ".join([*gpl, "and", bsd, "and", *gpl])),
        (7, "the software is free to use and copy"),
        (None, bsd.replace(" ", "\n * ").upper()),
    ]
    rows = {r.doc_id: r for r in licenses.scan_rows(documents(spark, texts)).collect()}
    assert rows[1].labels == "mit-notice" and rows[1].score == 1 and rows[1].n_base == 0
    assert rows[2].labels == "mit-notice" and rows[2].score > 0.9
    assert rows[3].labels == "" and rows[3].score == 0  # a mandatory phrase is missing
    assert rows[4].labels == "gpl" and rows[4].score == 0.5  # its phrases stand too far apart
    assert rows[5].labels == "" and rows[7].labels == ""
    assert rows[6].labels == "bsd-notice,gpl,gpl-notice" and rows[6].n_base == 2 and rows[6].last_word == len(gpl) + len(bsd.split()) + 2 + gpl.index("gnu")
    assert rows[None].labels == "bsd-notice"
    found = {r.row.doc_id: r for r in licenses.find_licenses(documents(spark, texts)).collect()}
    known = licenses.templates()
    assert all(abs(n.near - 500) <= licenses.SLIP for n in found[2].notices) and {known[n.notice].label for n in found[2].notices} == {"mit-notice"}
    assert found[1].row.base == "z"


@pytest.mark.parametrize("text", ["mit license ", "cc by ", licenses.NOTICES[0][0] + " ", "gnu "])
def test_a_long_text_takes_linear_time(spark, text):
    n = 400_000 // len(text)
    began = time.perf_counter()
    row = licenses.scan_rows(documents(spark, [(1, text * n)])).first()
    assert time.perf_counter() - began < 30
    assert row.n_words == n * len(text.split()) and row.n_base == n * text.startswith(("mit", "cc"))


def test_empty_and_repeated(spark):
    assert licenses.scan_rows(documents(spark, [])).count() == 0
    rows = licenses.scan_rows(documents(spark, [(1, "MIT License"), (1, "MIT License"), (1, None)])).collect()
    assert sorted((r.n_words, r.n_base, r.labels) for r in rows) == [(0, 0, ""), (2, 1, "mit"), (2, 1, "mit")]


def test_main_path_has_no_python(spark):
    plan = licenses.scan_rows(documents(spark, [(1, "MIT License")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))

"""Operator 7: language identification by averaged hashed subword embeddings.

A text's subwords are the byte n-grams of its lower-cased words (a space on each side),
hashed into buckets. Its vector is the mean of their embeddings; a linear softmax on it
gives the language. Embeddings and softmax are trained together by stochastic gradient
descent in numpy. A temperature calibrates the probabilities on documents kept back from
training; texts whose best probability lies under a threshold, set there too, are
rejected (column ``rejected``).

Only bucket counts of at most SAMPLE training documents reach the driver, chosen by a
hash of id, text and language: at most SAMPLE * BUCKETS numbers, whatever the input. Rows
that repeat a document are learned from once, and an id that many documents share takes
no more of the sample than of the table. In tasks, embedding
and softmax are one table of a row per bucket, since the mean is linear.

Defined results: null texts and texts without a letter are ``und`` with score 0; without
training rows all are ``und``; a null doc_id isn't held out; texts of equal probability
go to the first language in alphabetical order; repeated rows are predicted one by one;
other columns ride along and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm import text as X
from orograph.llm.common import annotate, held_out, raw_texts, spans

#: Most documents that a model is trained on.
SAMPLE = 4_000
BUCKETS = 1 << 13
DIMENSIONS = 16
SIZES = (2, 3, 4)
UNKNOWN = "und"
#: Bytes and texts of a block that numpy works on.
PART, ROWS = 1 << 20, 256


def _lowered(raw: list[bytes]) -> bytes:
    """Texts in lower case, a zero byte before each and after the last."""
    return b"\0" + b"\0".join((t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode()) for t in raw) + b"\0"


def _letters() -> np.ndarray:
    """What each byte counts as: itself in a word, else a space; 0 between texts."""
    table = np.full(256, 0x20, np.uint8)
    table[0] = 0
    for b in range(256):
        if b >= 0x80 or chr(b).isalpha():
            table[b] = b
    return table


def subwords(raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the buckets of all texts, and where each text's begin (one
    more than texts). Subwords don't cross words, but hold the spaces beside them."""
    data = _letters()[np.frombuffer(_lowered(raw), np.uint8)]
    cuts = np.flatnonzero(data == 0)
    if len(cuts) != len(raw) + 1:  # zero bytes inside texts
        return subwords([t.replace(b"\0", b" ") for t in raw])
    space = (data == 0x20) | (data == 0)
    values = X.byte_values()[np.where(space, 0x20, data)]
    before = np.concatenate(([0], np.cumsum(space)))  # spaces before each place
    out = []
    for n in SIZES:
        size = len(values) - n + 1
        if size > 0:
            h = X.window_hash(values, n)
            # no space inside, and no two spaces only
            keep = (before[n - 1 : n - 1 + size] == before[1 : 1 + size]) & ~(space[:size] & space[n - 1 :] & (n == 2))
            at = np.flatnonzero(keep)
            out.append(((h[at] % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(at, cuts)))
    return out


def in_parts(raw: list[bytes]):
    """Blocks of about PART bytes and ROWS texts at most, as (number of each part's text,
    parts). Long texts are cut at white space, which no subword crosses."""
    parts = [(i, p) for i, t in enumerate(raw) for p in (X.pieces(t, PART) if len(t) > PART else (t,))]
    for a, b in spans([len(p) for _, p in parts], PART):
        for c in range(a, b, ROWS):
            yield np.array([i for i, _ in parts[c : min(b, c + ROWS)]]), [p for _, p in parts[c : min(b, c + ROWS)]]


@dataclass
class Model:
    """table: bucket x language, the softmax's input for a text of that one subword."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, raw: list[bytes]) -> np.ndarray:
        total, count = np.zeros((len(raw), len(self.languages))), np.zeros(len(raw))
        for owner, parts in in_parts(raw):
            for buckets, bounds in subwords(parts):
                n = np.diff(bounds)
                np.add.at(count, owner, n)
                some = np.flatnonzero(n)
                if len(some):
                    for k in range(len(self.languages)):  # a column at a time: less memory
                        np.add.at(total[:, k], owner[some], np.add.reduceat(self.table[k][buckets], bounds[:-1][some], dtype=np.float64))
        return total / np.maximum(count, 1)[:, None] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _counts(batches):
    """Bucket counts of each text, sparse."""
    for batch in batches:
        raw, lang = raw_texts(batch), batch.column("lang")
        for i in range(0, len(raw), ROWS):
            dense = np.zeros((len(raw[i : i + ROWS]), BUCKETS), np.int32)
            for owner, parts in in_parts(raw[i : i + ROWS]):
                for buckets, bounds in subwords(parts):
                    np.add.at(dense, (np.repeat(owner, np.diff(bounds)), buckets[bounds[0] : bounds[-1]]), 1)
            rows = [np.flatnonzero(d) for d in dense]
            yield pa.RecordBatch.from_arrays(
                [lang.slice(i, len(rows)), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([d[r] for d, r in zip(dense, rows)], pa.list_(pa.int32()))],
                ["lang", "bucket", "n"],
            )


def fit(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 30, batch: int = 32, rate: float = 0.5, seed: int = 7):
    """Embeddings and softmax by stochastic gradient descent. x: share of each bucket."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (x.shape[1], DIMENSIONS)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIMENSIONS, classes)).astype(np.float32), np.zeros(classes, np.float32)
    scale = np.float32(np.sqrt(x.shape[1]))  # means of many embeddings are small
    for epoch in range(epochs):
        step = np.float32(rate / (1 + epoch / 10))
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            xb = x[part] * scale
            hidden = xb @ emb
            g = softmax(hidden @ out + bias).astype(np.float32)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            back = g @ out.T
            out -= step * (hidden.T @ g)
            bias -= step * g.sum(0)
            emb -= step * (xb.T @ back)
    return (emb @ out) * scale, bias


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from texts and languages of ``docs`` (doc_id, text, lang) that aren't held
    out, of at most ``sample`` of them."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null").where(~held_out("doc_id"))
    keyed = usable.where("doc_id is not null").withColumn("key", F.xxhash64("doc_id", "text", "lang"))
    first = keyed.select("doc_id", "key").distinct().orderBy("key", "doc_id").limit(sample)
    chosen = keyed.join(F.broadcast(first), ["doc_id", "key"]).select("doc_id", "text", "lang").distinct().select("text", "lang")
    counted = chosen.mapInArrow(_counts, "lang string, bucket array<int>, n array<int>").toArrow()
    # as bytes, high ones first, which sort like the lists and take no more room
    packed = lambda c: (np.asarray(v.values).astype(">i4").tobytes() for v in counted.column(c))
    rows = sorted(zip(counted.column("lang").to_pylist(), packed("bucket"), packed("n")))
    names = [lang for lang, _, _ in rows]
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    x = np.zeros((len(names), BUCKETS), np.float32)
    for i, (_, b, n) in enumerate(rows):
        counts = np.frombuffer(n, ">i4")
        x[i, np.frombuffer(b, ">i4")] = counts / max(1, counts.sum())
    y = np.array([languages.index(v) for v in names])
    back = np.arange(len(y)) % 5 == 4  # kept back to calibrate; rows are in order of language
    if len(y) < 10:
        back[:] = False
    table, bias = fit(x[~back], y[~back], len(languages))
    model = Model(languages, np.ascontiguousarray(table.T, np.float32), bias.astype(float))
    check = back if back.any() else ~back
    z = x[check] @ table + bias
    temps = np.geomspace(0.05, 5, 40)
    loss = [-np.log(softmax(z / t)[np.arange(check.sum()), y[check]] + 1e-12).mean() for t in temps]
    model.temperature = float(temps[int(np.argmin(loss))])
    best = softmax(z / model.temperature).max(1)
    model.reject_below = float(np.quantile(best, 0.005))  # rejects one text of its kind in 200
    return model


def has_letter(raw: bytes) -> bool:
    """Whether a text holds a letter of any alphabet."""
    ascii_only = raw.isascii()
    if raw.translate(None, _NO_LETTERS if ascii_only else _NO_LETTERS + bytes(range(0x80, 0x100))):
        return True
    return not ascii_only and any(c.isalpha() for c in raw.decode("utf-8", "replace"))


_NO_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalpha())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` (struct row) with lang_pred, score and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values, which need no package to read

    def fn(raw):
        m = Model(**held.value)
        langs, scores, rejected = [UNKNOWN] * len(raw), np.zeros(len(raw)), [True] * len(raw)
        some = [i for i, t in enumerate(raw) if m.languages and has_letter(t)]
        for a, b in spans([len(raw[i]) for i in some], 1 << 20):
            p = softmax(m.logits([raw[i] for i in some[a:b]]) / m.temperature)
            for i, q in zip(some[a:b], p):
                k = int(q.argmax())
                langs[i], scores[i], rejected[i] = m.languages[k], q[k], bool(q[k] < m.reject_below)
        return [pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)]

    return annotate(docs, fn, "lang_pred string, score double, rejected boolean")


def predict_rows(docs: DataFrame) -> DataFrame:
    """The rows of the contract."""
    predicted = predict(docs.select("doc_id", "text"), train(docs))
    return predicted.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "rejected")

"""Operator 10: toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other alphabets and digit
substitutions become Latin letters, and all that isn't a letter becomes a space. The
lexicon holds words and word beginnings with weights (log odds of being in a toxic
document), learned from labelled documents; its entries and the exception phrases are
found in one pass of an automaton over the folded text. A match inside an exception
phrase doesn't count. The sum of weights, also per word of the text, goes through a
logistic curve to a score.

Exception phrases are learned before weights: candidates are entries that toxic documents
have more often, if not by much. A candidate with the word before or after it is an
exception where such phrases are in clean documents nearly alone; then candidates are
counted anew outside exceptions, and those that now tell toxic documents apart get in.

Learning takes at most SAMPLE labelled documents, the first by a hash of id and text, so it
costs the same at any size. Features and phrases are counted in tasks and added up by
Spark; all with enough support go on, none is cut off.

Defined results: null and empty texts have no words and get the score of a text without
matches; a null doc_id isn't held out; without labels of both kinds the lexicon is empty
and the score 0; documents with several labels are learned from once for each; repeated
rows are scored one by one; other columns ride along and may have any name.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import annotate, cut, held_out, raw_texts

#: Most labelled documents that a model is learned from.
SAMPLE = 20_000
#: Texts whose entries are counted at once.
FEW = 128
THRESHOLD = 0.7
#: Least log odds of a lexicon's entries, and of candidates before exceptions are known.
ODDS, CANDIDATE_ODDS = 3.0, 0.5
#: Clean documents that an exception needs, and how many times the toxic ones they must be.
EXCEPTION_DOCS, EXCEPTION_TIMES = 5, 5
SHORTEST, LONGEST = 4, 8
# Letters that look like Latin ones (Cyrillic, Greek, full-width signs).
LOOKALIKES = str.maketrans(
    "аеорсухіјѕвкмнтԁһԛԝαεορτυνικχ",
    "aeopcyxijsbkmhtdhqwaeoptuvikx",
)
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


def _byte_table() -> bytes:
    table = bytearray(b" " * 256)
    for b in range(256):
        if b >= 0x80 or chr(b).isalpha():
            table[b] = b
    for k, v in SUBSTITUTES.items():
        table[ord(k)] = ord(v)
    return bytes(table)


_TABLE, _END_SIGNS = _byte_table(), (b"! ", b"!\n")
_FOREIGN = (b"\xd0", b"\xd1", b"\xd2", b"\xd4", b"\xce", b"\xcf", b"\xef\xbc", b"\xef\xbd")


def fold(raw: bytes) -> str:
    """The folded text, with a space before the first word and after the last."""
    for sign in _END_SIGNS:  # an exclamation mark that ends a word is none of its letters
        raw = raw.replace(sign, b" ")
    text = raw.rstrip(b"!")
    if text.isascii():
        folded = text.lower().translate(_TABLE).decode()
    else:
        s = text.decode("utf-8", "replace")
        if any(f in text for f in _FOREIGN):
            if "＀" < max(s):
                s = s.translate({0xFF01 + i: 0x21 + i for i in range(94)})
            s = s.lower().translate(LOOKALIKES)
        folded = s.lower().encode().translate(_TABLE).decode("utf-8", "replace")
    return f" {' '.join(folded.split())} "


@dataclass
class Model:
    """weights: entry (" word" or " beginning") to weight; exceptions: phrases (folded, a
    space around each word) in which matches don't count; curve: of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        made = ahocorasick.Automaton()
        for e, w in self.weights.items():
            made.add_word(e, (e, w))
        for e in self.exceptions:
            if e not in self.weights:
                made.add_word(e, (e, None))
        if len(made):
            made.make_automaton()
        return made


def matches(automaton, text: str, every: bool = False) -> list[tuple[int, str, float]]:
    """(start, entry, weight) of lexicon matches outside exception phrases; of those that
    start at one place, the heaviest, or ``every`` one."""
    if not len(automaton):
        return []
    all_of: list[tuple[int, str, float]] = []
    found: dict[int, tuple[float, str]] = {}
    begins: list[int] = []  # of covered stretches, apart and in order, as matches end in order
    ends: list[int] = []
    for end, (entry, weight) in automaton.iter(text):
        start = end - len(entry) + 1
        if weight is None:
            while begins and start <= ends[-1]:
                start = min(start, begins.pop())
                ends.pop()
            begins.append(start), ends.append(end)
        elif every:
            all_of.append((start, entry, weight))
        elif (weight, entry) > found.get(start, (-math.inf, "")):
            found[start] = (weight, entry)

    def excused(at: int) -> bool:
        k = bisect_right(begins, at) - 1
        return k >= 0 and at < ends[k]

    return [m for m in all_of or ((s, e, w) for s, (w, e) in sorted(found.items())) if not excused(m[0])]


def signals(automaton, text: str) -> tuple[float, float, int]:
    """log(1 + weight), log(1 + weight per hundred words) and the number of matches."""
    found = matches(automaton, text)
    total = sum(w for _, _, w in found)
    return math.log1p(total), math.log1p(100 * total / max(1, text.count(" ") - 1)), len(found)


def _starts(text: str) -> set[str]:
    """Each word of a text with a space on both sides, and its beginnings with one before."""
    out = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1):
            out.add(f" {w[:n]}")
    return out


def _few(batches):
    """Batches of few texts, whose entries make no large dictionary."""
    for batch in batches:
        for i in range(0, batch.num_rows, FEW):
            yield batch.slice(i, FEW)


def _counted(seen: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e for e, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()), pa.array(seen.values(), pa.int64())], ["entry", "toxic", "docs"])


def _entry_rows(held, batches):
    """(entry, toxic, documents) of each batch: all entries, or those of the model in
    ``held`` that match outside its exceptions."""
    automaton = Model(**held.value).automaton() if held else None
    for batch in _few(batches):
        seen: dict[tuple, int] = {}
        for raw, toxic in zip(raw_texts(batch), batch.column("toxic").to_pylist()):
            text = fold(raw)
            for e in {e for _, e, _ in matches(automaton, text, every=True)} if held else _starts(text):
                seen[e, toxic] = seen.get((e, toxic), 0) + 1
        yield _counted(seen)


def _phrase_rows(held, good, batches):
    """The same of phrases: each match of the model's entries with the word before it, and
    with the word after it. With ``good`` (phrase to clean documents), a match counts for
    the phrase with the most of them only."""
    automaton = Model(**held.value).automaton()
    for batch in _few(batches):
        seen: dict[tuple, int] = {}
        for raw, toxic in zip(raw_texts(batch), batch.column("toxic").to_pylist()):
            text, phrases = fold(raw), set()
            for start, _, _ in matches(automaton, text):
                stop = text.index(" ", start + 1)
                both = text[text.rfind(" ", 0, start) if start else 0 : stop + 1], text[start : text.find(" ", stop + 1) + 1 or stop + 1]
                fit = [p for p in both if p.count(" ") > 2 and (good is None or p in good.value)]
                phrases.update(fit if good is None else [max(fit, key=lambda p: (good.value[p], p))] if fit else [])
            for p in phrases:
                seen[p, toxic] = seen.get((p, toxic), 0) + 1
        yield _counted(seen)


def _document_counts(texts: DataFrame, rows) -> DataFrame:
    """(entry, bad, good): toxic and clean documents with each entry that ``rows`` counts."""
    counted = texts.select("text", "toxic").mapInArrow(rows, "entry string, toxic int, docs long").groupBy("entry", "toxic").agg(F.sum("docs").alias("docs"))
    return counted.groupBy("entry").agg(F.sum(F.expr("if(toxic = 1, docs, 0)")).alias("bad"), F.sum(F.expr("if(toxic = 0, docs, 0)")).alias("good"))


def _fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return tuple(w)


def _signal_rows(held, batches):
    automaton = Model(**held.value).automaton()
    for batch in batches:
        rows = [signals(automaton, fold(raw))[:2] for raw in raw_texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1))], ["toxic", "total", "density"])


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic): ``sample`` labelled documents that aren't held out, at most. Documents
    are told apart by id and text, so an id that many share takes no more than its share."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(~held_out("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    first = texts.select("doc_id", "key").join(usable, "doc_id").distinct().orderBy("key", "doc_id", "toxic").limit(sample)
    return texts.join(F.broadcast(first), ["doc_id", "key"]).select("doc_id", "text", "toxic").distinct().select("text", "toxic")


def _odds(bad: int, good: int, toxic: int, clean: int) -> float:
    return math.log((bad + 0.5) / (toxic + 1)) - math.log((good + 0.5) / (clean + 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labels (doc_id, toxic 0 or 1) of ``docs`` (doc_id, text) that aren't
    held out; ``sample`` bounds the labelled documents it looks at."""
    send = lambda m: docs.sparkSession.sparkContext.broadcast(vars(m))  # noqa: E731  plain values, which need no package to read
    texts = cut(_sampled(docs, labels, sample))
    n = dict(texts.groupBy("toxic").count().collect())
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model()
    support = max(3, math.ceil(toxic / 200))
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    candidates = _document_counts(texts, partial(_entry_rows, None)).where((F.col("bad") >= support) & (odds >= CANDIDATE_ODDS)).select("entry").collect()
    model = Model({r.entry: 1.0 for r in candidates})
    held, good = send(model), None
    for _ in range(2):  # all phrases; then those that explain clean documents on their own
        phrases = _document_counts(texts, partial(_phrase_rows, held, good))
        found = phrases.where((F.col("good") >= EXCEPTION_DOCS) & (F.col("good") > F.col("bad") * EXCEPTION_TIMES)).collect()
        good = docs.sparkSession.sparkContext.broadcast({r.entry: r.good for r in found})
    model.exceptions = sorted(r.entry for r in found)
    counted = _document_counts(texts, partial(_entry_rows, send(model))).where(F.col("bad") >= support).collect()
    weights, docs_of = {r.entry: _odds(r.bad, r.good, toxic, clean) for r in counted}, {r.entry: r.bad for r in counted}
    model.weights = {}
    # the best supported first, the shortest of equals; what an entry already matches at
    # its place, at no less weight, needs no entry of its own
    for e in sorted((e for e, o in weights.items() if o >= ODDS), key=lambda e: (-docs_of[e] * weights[e], len(e), e)):
        if not any(model.weights.get(e[:k], -math.inf) >= weights[e] - 1 for k in range(SHORTEST + 1, len(e))):
            model.weights[e] = weights[e]
    # only exceptions that hold a match of the lexicon are of use
    lexicon = Model(model.weights).automaton()
    model.exceptions = [p for p in model.exceptions if matches(lexicon, p)]
    rows = np.array(texts.mapInArrow(partial(_signal_rows, send(model)), "toxic int, total double, density double").collect(), float).reshape(-1, 3)
    model.curve = _fit_curve(rows[:, 1:], rows[:, 0])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (struct row) with score, predicted and n_matches."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def fn(raw):
        automaton, curve = Model(**held.value).automaton(), held.value["curve"]
        found = [signals(automaton, fold(t)) for t in raw]
        if curve is None:
            scores = np.zeros(len(raw))
        else:
            scores = 1 / (1 + np.exp(-np.clip(np.array([f[:2] for f in found]).reshape(-1, 2) @ np.array(curve[:2]) + curve[2], -700, 700)))
        return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array([f[2] for f in found], pa.int64())]

    return annotate(docs, fn, "score double, predicted int, n_matches long")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the model finds toxic."""
    return score(docs, model, threshold).where("predicted = 0").select("row.*")


def score_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the contract."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted", "n_matches")

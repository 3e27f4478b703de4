"""Operator 8: secret scans, with DataFrame functions only.

Base patterns (``assign``, ``access``, ``hex``) are found left to right without overlap;
splitting a text at its matches gives their places. Candidate strings beyond them are
runs of 20 or more characters of base64. Over each candidate a window of WINDOW
characters slides; counts per character are kept up to date by one character in and one
out, and with them the sum of c * log2(c), hence the Shannon entropy of the window. A
candidate whose highest window reaches the threshold of its character class (hex digits,
one case and digits, all of base64) is a span of kind ``entropy``, unless the allow-list
names it or it overlaps a base match.

That is what the query's SQL lists. ``redact`` takes more: a candidate that overlaps a
base match gives way as a whole, and what the allow-list names inside a candidate excuses
only the piece, up to the next of / = _ -, that holds it; the rest is tested.

The sum is kept in whole millionths of a bit, so results don't depend on rounding.

Defined results: null and empty texts have no matches; repeated rows are scanned one by
one; an empty table gives no rows; other columns ride along in a struct and may have any
name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import let

# The patterns of the contract. Kinds in the order of listing.
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in _KEYWORDS)
ASSIGN = rf"""({_EITHER_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
SHORTEST = {"assign": 8, "access": 16, "hex": 32}

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least entropy of the best window, in bits, by character class.
THRESHOLDS = {"hex": 3.0, "one case": 3.6, "mixed": 3.9}
#: Candidates that are no secrets: words only, one character throughout, UUIDs,
#: placeholders, the alphabet or digits in order, paths.
ALLOWED = [
    r"^[A-Z]?[a-z]+([_/=-]+[A-Z]?[a-z]*)*$",
    r"^[A-Z]+([_/=-]+[A-Z]*)*$",
    r"^[0-9_/=+-]+$",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]",
    r"[Aa][Bb][Cc][Dd][Ee][Ff]|0123456789|1234567890",
]
#: The same as the first two, as (match, no match): Java's regular expressions take a frame
#: of their stack for each repetition of a group, so a long candidate would end the task.
_WITHOUT_GROUPS = [("^[A-Z]?[a-z][A-Za-z_/=-]*$", "[A-Za-z][A-Z]"), ("^[A-Z][A-Z_/=-]*$", "[a-z]")]
#: Those that match inside a candidate, and pieces of candidates that hold one.
_INSIDE = "|".join(f"(?:{p})" for p in ALLOWED if not p.startswith("^"))
_EXCUSED = f"(?<![A-Za-z0-9+])[A-Za-z0-9+]*?(?:{_INSIDE})[A-Za-z0-9+]*"
REPLACEMENT = "[secret]"

_SPAN = "struct<start:long,order:int,stop:long>"
_MICRO = 1_000_000
#: c * log2(c) in millionths.
_SUMS = [round(_MICRO * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
#: From a threshold in bits to the largest sum that reaches it: entropy = log2(n) - sum/n.
_MOST = {k: math.floor(_MICRO * WINDOW * (math.log2(WINDOW) - t)) for k, t in THRESHOLDS.items()}


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


#: Items of an array that are gone through at once: state that grows by an item a step is
#: copied a block at most, so long texts with many matches don't take their square.
BLOCK = 256


def _blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK items."""

    def cut(v):
        last = F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0))
        return F.filter(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK))), lambda b: F.size(b) > 0)

    return let(items, cut)


def _scan(items: Column, value, combine) -> Column:
    """Each item with what ``value`` (a whole number of 0 or more) of all before it combines to."""
    none = F.array().cast("array<long>")

    def befores(values, start, of):
        step = lambda a, x: F.struct(combine(a["now"], of(x)).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out"))
        return F.aggregate(values, F.struct(start.alias("now"), none.alias("out")), step, lambda a: a["out"])

    def within(b, start):
        return F.zip_with(b, befores(b, start, value), lambda x, n: F.struct(x.alias("item"), n.alias("before")))

    def whole(v):
        def many(blocks):
            totals = F.transform(blocks, lambda b: F.aggregate(b, _long(0), lambda a, x: combine(a, value(x))))
            return F.flatten(F.zip_with(blocks, befores(totals, _long(0), lambda t: t), within))

        return F.when(F.size(v) <= BLOCK, within(v, _long(0))).otherwise(let(_blocks(v), many))

    return let(items, whole)


def _places(text: Column, pattern: str, keep, kind: int) -> Column:
    """Spans of the matches of a pattern that ``keep`` (a condition on the match) keeps."""
    gaps = F.transform(F.split(text, pattern, -1), lambda b: F.length(b).cast("long"))
    paired = lambda found: F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    items = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)
    placed = _scan(items, lambda x: x["gap"] + F.length(x["m"]), lambda a, n: a + n)
    start = lambda x: x["before"] + x["item"]["gap"]
    spans = F.transform(
        F.filter(placed, lambda x: keep(x["item"]["m"])), lambda x: F.struct(start(x).alias("start"), F.lit(kind).alias("order"), (start(x) + F.length(x["item"]["m"])).alias("stop"))
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base`` (by start); whole blocks of it are passed over."""
    hit = lambda m, b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])
    ranges = F.transform(_blocks(base), lambda b: F.struct(F.element_at(b, 1)["start"].alias("start"), F.array_max(F.transform(b, lambda x: x["stop"])).alias("stop"), b.alias("b")))
    apart = lambda rs: F.filter(spans, lambda m: ~F.exists(rs, lambda r: F.when(hit(m, r), F.exists(r["b"], lambda b: hit(m, b))).otherwise(False)))
    return let(ranges, apart)


#: Counts are at most WINDOW, so _BITS hold one and a long holds _COUNTS of them.
_BITS = WINDOW.bit_length()
_COUNTS = 62 // _BITS


def _most_entropy(s: Column) -> Column:
    """The least sum of c * log2(c) over the windows of a candidate, in millionths. Its
    characters are taken once, so that a step finds its own at once."""
    return let(F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c)), _least_sum)


def _least_sum(codes: Column) -> Column:
    table = lambda of: F.array(*[F.lit(of(k)).cast("long") for k in range(len(ALPHABET))])
    at = F.array(*[F.lit(k // _COUNTS) for k in range(len(ALPHABET))])
    bits = F.array(*[F.lit(k % _COUNTS * _BITS) for k in range(len(ALPHABET))])
    one = table(lambda k: 1 << k % _COUNTS * _BITS)
    #: what one more of c of a kind adds to the sum
    more = F.array(*[_long(b - a) for a, b in zip(_SUMS, _SUMS[1:])])

    def count(a, c):
        packed = F.get(a["counts"], F.element_at(at, c))
        return F.call_function("shiftright", packed, F.element_at(bits, c)).bitwiseAND(_long((1 << _BITS) - 1)).cast("int")

    def step(a, i):
        # one character in, and once the window is full, one out; equal ones change nothing
        new, old = F.element_at(codes, i), F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))
        full, same = i > WINDOW, (i > WINDOW) & (new == old)
        put = lambda w, k: w + F.when(F.element_at(at, new) == k, F.element_at(one, new)).otherwise(_long(0)) - F.when(full & (F.element_at(at, old) == k), F.element_at(one, old)).otherwise(_long(0))
        gain = F.element_at(more, count(a, new) + 1) - F.when(full, F.element_at(more, F.greatest(count(a, old), F.lit(1)))).otherwise(_long(0))
        return F.struct(
            F.when(same, a["counts"]).otherwise(F.transform(a["counts"], put)).alias("counts"),
            (a["sum"] + F.when(same, _long(0)).otherwise(gain)).alias("sum"),
            F.when(full, F.least(a["best"], a["sum"])).otherwise(a["best"]).alias("best"),  # of the windows before
        )

    start = F.struct(F.array_repeat(_long(0), -(-len(ALPHABET) // _COUNTS)).alias("counts"), _long(0).alias("sum"), _long(1 << 40).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda a: F.least(a["best"], a["sum"]))


def _secret(s: Column) -> Column:
    """Whether a candidate string is no allowed one and reaches its class's threshold."""
    most = (
        F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), _long(_MOST["hex"]))
        .when(s.rlike("^([^A-Z]*|[^a-z]*)$"), _long(_MOST["one case"]))
        .otherwise(_long(_MOST["mixed"]))
    )
    allowed = F.lit(False)
    for pattern, never in _WITHOUT_GROUPS:
        allowed = allowed | (s.rlike(pattern) & ~s.rlike(never))
    for pattern in ALLOWED[2:]:
        allowed = allowed | s.rlike(pattern)
    return F.when((F.length(s) < WINDOW) | allowed, False).otherwise(_most_entropy(s) <= most)


def _holds_secret(s: Column) -> Column:
    """Whether a candidate string without its excused pieces still holds a secret."""
    rest = F.regexp_extract_all(F.regexp_replace(s, F.lit(_EXCUSED), F.lit(" ")), F.lit(CANDIDATE), F.lit(0))
    return F.exists(F.when(s.rlike(_INSIDE), rest).otherwise(F.array(s)), _secret)


def find_secrets(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Rows of ``docs`` (struct row) with base and found (arrays of spans: start, order in
    KINDS, stop; code points, end exclusive, by start, then kind). ``whole``: found also
    has candidates that overlap base matches or are excused in part."""
    text = F.coalesce(F.col("t"), F.lit(""))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("t"))
    base = d.select(
        "row", "t",
        F.array_sort(F.concat(
            _places(text, ASSIGN, lambda m: F.length(value(m)) >= SHORTEST["assign"], 0),
            _places(text, ACCESS, lambda m: F.length(m) >= SHORTEST["access"], 1),
            # runs of hex digits are many: a pattern that takes long ones only has the
            # same long matches, since a run ends where the shorter pattern's would
            _places(text, f"[0-9a-f]{{{SHORTEST['hex']},}}", lambda m: m.isNotNull(), 2),
        )).alias("base"),
    )
    secret = _holds_secret if whole else _secret
    more = base.select("row", "base", _places(text, CANDIDATE, lambda m: m.isNotNull() & secret(m), 3).alias("more"))
    if whole:
        return more.select("row", "base", F.array_sort(F.concat("base", "more")).alias("found"))
    apart = F.when(F.size("base") == 0, F.col("more")).otherwise(_apart(F.col("more"), F.col("base")))
    return more.select("row", "base", F.array_sort(F.concat("base", apart)).alias("found"))


def _named(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_rows(docs: DataFrame) -> DataFrame:
    """The rows of the contract."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["order"] == k)).cast("long")
    return found.select("row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_named("base"), 256).alias("base_sha256"), _named("found").alias("spans"))


def redact(docs: DataFrame, replacement: str = REPLACEMENT) -> DataFrame:
    """``docs`` with each run of overlapping spans replaced; n_chars, where there is such
    a column, follows. Texts without secrets stay as they are."""
    found = find_secrets(docs, whole=True)
    text = F.col("row.text").cast("string")
    piece = lambda a, to: F.substring(text, (a + 1).cast("int"), F.greatest(to - a, _long(0)).cast("int"))
    # a span that begins inside those before it adds nothing of its own
    placed = F.filter(_scan(F.col("found"), lambda x: x["stop"], F.greatest), lambda x: (x["item"]["start"] >= x["before"]))
    parts = F.transform(placed, lambda x: F.concat(piece(x["before"], x["item"]["start"]), F.lit(replacement)))
    last = F.array_max(F.transform("found", lambda x: x["stop"]))
    cleaned = F.concat(F.array_join(parts, ""), piece(last, F.length(text).cast("long")))
    changed = found.withColumn("new", F.when(F.size("found") > 0, cleaned).otherwise(text))
    size = {"n_chars": F.when(F.size("found") > 0, F.length("new")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {}
    kinds = dict(docs.dtypes)
    return changed.select(*[F.col("new").alias(c) if c == "text" else size[c].cast(kinds[c]).alias(c) if c in size else F.col(f"row.`{c}`") for c in docs.columns])


def _duck_places(pattern: str, kind: int) -> str:
    """Spans of a pattern in DuckDB: matches and what lies between them."""
    return f"""(SELECT doc_id, {kind} AS k, m, start_ - len(m) AS s, start_ AS e FROM (
      SELECT doc_id, m, sum(len(gap) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS start_ FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
          SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d))))"""


_SQL_ASSIGN = ASSIGN.replace("'", "''")
_ALLOWED_SQL = " OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOWED)
_NAMED_SQL = "coalesce(string_agg(['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k), '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT * FROM {_duck_places(_SQL_ASSIGN, 0)} WHERE len(regexp_extract(m, '{_SQL_ASSIGN}', 2)) >= {SHORTEST['assign']}
  UNION ALL SELECT * FROM {_duck_places(ACCESS, 1)} WHERE len(m) >= {SHORTEST['access']}
  UNION ALL SELECT * FROM {_duck_places(HEX, 2)} WHERE len(m) >= {SHORTEST['hex']}),
cand AS (SELECT * FROM {_duck_places(CANDIDATE, 3)} WHERE NOT ({_ALLOWED_SQL})),
chars AS (SELECT doc_id, s, e, m, w, substr(m, w + p, 1) AS c FROM (
  SELECT *, unnest(range({WINDOW})) AS p FROM (SELECT *, unnest(range(1, len(m) - {WINDOW} + 2)) AS w FROM cand))),
sums AS (SELECT doc_id, s, e, m, w, sum({_SUMS}[n + 1]) AS total FROM (
  SELECT doc_id, s, e, m, w, c, count(*) AS n FROM chars GROUP BY ALL) GROUP BY ALL),
high AS (SELECT doc_id, 3 AS k, m, s, e FROM (SELECT doc_id, s, e, m, min(total) AS least_ FROM sums GROUP BY ALL)
  WHERE least_ <= CASE WHEN regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') THEN {_MOST['hex']}
    WHEN regexp_matches(m, '^([^A-Z]*|[^a-z]*)$') THEN {_MOST['one case']} ELSE {_MOST['mixed']} END),
found AS (SELECT * FROM base UNION ALL SELECT * FROM high
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = high.doc_id AND b.s < high.e AND high.s < b.e)),
basehash AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {_NAMED_SQL} AS b FROM base GROUP BY doc_id),
names AS (SELECT doc_id, {_NAMED_SQL} AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN basehash USING (doc_id) LEFT JOIN names USING (doc_id)
"""

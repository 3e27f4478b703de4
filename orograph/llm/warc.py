"""Operator 6: WARC derivatives. Each response gives two linked records:

* ``metadata`` (application/warc-fields): the source's HTTP status and headers, its
  digest, the page's title and the number of links;
* ``conversion`` (text/plain): the page's text.

Both refer to the response by its record id, keep its URI and date, carry its payload
digest and a digest of their own block, and name each other. Record ids are name-based,
so a repeated run gives the same records. DataFrame functions do all the work; serialised
records are written as text files whose line separator is the end of a record.

Defined results: null html gives an empty block; null urls and ids count as empty strings
in record ids and the URI header is left out; comments, elements and tags that are never
closed stay as they are, and take no more time than others; repeated rows give repeated records with
the same ids; an empty table gives no rows; other columns are ignored. Entities other
than the named and numeric ones of ENTITIES stay as they are.
"""

from __future__ import annotations

import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm.common import let

DATE = "2024-01-01T00:00:00Z"
# Tags whose content isn't text, tags that break lines, entities.
HIDDEN = ("script", "style", "noscript", "template", "svg")
BREAKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&#60;", "<"), ("&gt;", ">"), ("&#62;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"), ("&#38;", "&")]
STEPS = [
    (r"<!--[\s\S]*?-->", " "),
    *((rf"(?i)<{t}\b[^>]*>[\s\S]*?</{t}\s*>", " ") for t in HIDDEN),
    (rf"(?i)</?({BREAKS})\b[^>]*>", "\n"),
    (r"<[/!?]?[A-Za-z][^>]*>", ""),
]
SPACES = [(r"[ \t\r\f\x0B]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]
# \b and \s as SQL has them, of ASCII only and without \x0B, in the steps that Spark takes.
_EDGE, _SPACE = "(?![0-9A-Za-z_])", "[ \\t\\n\\f\\r]"
_STEPS = [(p.replace(r"\b", _EDGE).replace(r"\s*", f"{_SPACE}*"), to) for p, to in STEPS]
TITLE = r"(?i)<title[^>]*>([\s\S]*?)</title"
LINK = r"(?i)<a\s[^>]*href\s*="
_END = "\r\n"


def _upto(text: Column, last: str) -> tuple[Column, Column]:
    """A text up to its last ``last`` (all of it, if there is none: nothing), and the rest."""
    rest = F.substring_index(text, last, -1)
    found = F.char_length(text) - F.char_length(rest)
    return F.substring(text, F.lit(1), found), rest


def _without_comments(text: Column) -> Column:
    def cut(t):
        head, rest = _upto(t, "-->")
        return F.concat(F.regexp_replace(head, F.lit(_STEPS[0][0]), F.lit(_STEPS[0][1])), rest)

    return let(text, cut)


def _without_hidden(text: Column, tag: str, pattern: str, to: str) -> Column:
    """Elements of a tag taken out. An opening counts that is complete in front of the last
    closing: up to the last > before that (head) each one has its closing, and what follows
    it (tail) can only go with an element that the last closing ends."""

    def cut(m):
        before, close = m["before"], m["close"]
        tail = F.substring_index(before, ">", -1)
        head = F.substring(before, F.lit(1), F.char_length(before) - F.char_length(tail))

        def put(x):
            done, tail, close = x["done"], x["tail"], x["close"]
            left = F.concat(F.substring(done, F.lit(1), F.char_length(done) - F.char_length(close)), tail, close)
            return F.concat(F.when(F.endswith(done, close), left).otherwise(done), m["rest"])

        return let(F.struct(F.regexp_replace(F.concat(head, close), F.lit(pattern), F.lit(to)).alias("done"), tail.alias("tail"), close.alias("close")), put)

    last = rf"(?is)^(.*)(</{tag}{_SPACE}*>)"
    parts = lambda t: let(F.struct(F.regexp_extract(t, last, 1).alias("before"), F.regexp_extract(t, last, 2).alias("close"), t.alias("t")), lambda x: F.struct(x["before"].alias("before"), x["close"].alias("close"), F.substring(x["t"], F.char_length(x["before"]) + F.char_length(x["close"]) + 1, F.char_length(x["t"])).alias("rest")))
    return let(text, lambda t: F.when(t.rlike(rf"(?i)</{tag}{_SPACE}*>"), let(parts(t), cut)).otherwise(t))


def _without_tags(text: Column, pattern: str, to: str) -> Column:
    """Tags taken out. Those behind the last > are never closed."""
    whole = lambda t: F.regexp_replace(t, F.lit(pattern), F.lit(to))

    def cut(t):
        head, rest = _upto(t, ">")
        return F.concat(whole(head), rest)

    return let(text, lambda t: F.when(F.octet_length(F.substring_index(t, ">", -1)) <= _SHORT, whole(t)).otherwise(cut(t)))


#: Openings that a step may look for a closing of in vain, from which on it is kept from it,
#: and bytes behind the last > likewise. So many cost no more than so many times the page.
_FEW, _SHORT = 64, 2048
#: Pieces that a text is split into at most, so that no array grows with a page; texts of
#: more take the plain steps.
_PIECES = 4096
#: Openings of titles, openings and closings of hidden elements, and comments; what isn't
#: whole in front of the next < is a mark by itself.
_MARKS = rf"(?i)<(?:!--(?:[^<]*?-->)?|title|(?:{'|'.join(HIDDEN)})(?:{_EDGE}[^<>]*+>)?|/(?:{'|'.join(HIDDEN)})(?:{_SPACE}*+>)?)"
#: Marks, each behind <>, of which every comment is whole and every opening is followed by its own closing.
_PAIRED = rf"(?i)^(?:<><title|<><!--[^<]*-->|{'|'.join(rf'<><{t}{_EDGE}[^<>]*+><></{t}{_SPACE}*+>' for t in HIDDEN)})*+$"
#: Comments and hidden elements of such a page at once.
_UNSEEN = rf"(?i)<(?:!--[\s\S]*?-->|{'|'.join(rf'{t}{_EDGE}[^>]*>[\s\S]*?</{t}{_SPACE}*>' for t in HIDDEN)})"


def marks_of(html: Column) -> Column:
    """The _MARKS of a page in order."""
    return F.regexp_extract_all(html, F.lit(_MARKS), F.lit(0))


def _hostile(marks: Column) -> Column:
    openings = F.filter(marks, lambda m: ~m.startswith("</"))
    return (F.size(marks) > _FEW) & (F.size(openings) > _FEW)


def _behind_tag(piece: Column, i: Column) -> Column:
    """What breaks and tags leave of a piece of text between two <; null where a tag isn't
    closed in front of the next one."""
    rest = F.get(F.split(piece, ">", 2), F.lit(1))
    shown = F.when(piece.rlike(rf"(?i)^/?(?:{BREAKS}){_EDGE}"), F.concat(F.lit("\n"), rest)).otherwise(rest)
    return F.when(i == 0, piece).when(piece.rlike("^[/!?]?[A-Za-z]"), shown).otherwise(F.concat(F.lit("<"), piece))


def plain_text(html: Column, marks: Column | None = None) -> Column:
    """The text of a page, a line for each block: what STEPS and SPACES say, in time that
    goes with its length. Where each comment and hidden element is closed before the next
    one begins, the order of their steps doesn't matter, and all go in one. Elsewhere steps
    without an opening in the page are left out; an opening without a closing would be
    looked for to the end of the page, so where openings are many, each step sees the part
    only in which all are closed. ``marks`` are those of marks_of, where they are at hand."""
    comments, *hidden, breaks, tags = _STEPS

    def step(t, has, pattern, to):
        return let(t, lambda t: F.when(has, F.regexp_replace(t, F.lit(pattern), F.lit(to))).otherwise(t))

    def usual(t, m):
        for opening, (pattern, to) in zip(("!--", *HIDDEN), (comments, *hidden)):
            t = step(t, F.exists(m, lambda x: F.lower(x).startswith(f"<{opening}")), pattern, to)
        return t

    def guarded(t):
        t = _without_comments(t)
        for tag, (pattern, to) in zip(HIDDEN, hidden):
            t = _without_hidden(t, tag, pattern, to)
        return t

    def cut(x):
        t, m = x["t"], x["m"]
        paired = F.concat(F.lit("<>"), F.array_join(m, "<>")).rlike(_PAIRED)
        return F.when(F.size(m) == 0, t).when(paired, F.regexp_replace(t, F.lit(_UNSEEN), F.lit(" "))).when(_hostile(m), guarded(t)).otherwise(usual(t, m))

    def untagged(x):
        t, pieces = x["t"], x["p"]
        plain = (F.size(pieces) == _PIECES) | F.exists(pieces, F.isnull)
        return F.when(plain, _without_tags(_without_tags(t, *breaks), *tags)).otherwise(F.array_join(pieces, ""))

    shown = let(F.struct(html.alias("t"), (marks_of(html) if marks is None else marks).alias("m")), cut)
    return _tidy(let(let(shown, lambda t: F.struct(t.alias("t"), F.transform(F.split(t, "<", _PIECES), _behind_tag).alias("p"))), untagged))


def title_of(html: Column, marks: Column | None = None) -> Column:
    """What TITLE finds first; of many openings, only those in front of the last closing are
    looked at."""

    def find(before):
        head, _ = _upto(before, ">")
        return F.when(head.rlike("(?i)<title[^>]*>"), F.regexp_extract(F.concat(before, F.lit("</title")), TITLE, 1)).otherwise("")

    guarded = F.when(html.rlike("(?i)</title"), let(F.regexp_extract(html, "(?is)^(.*)</title", 1), find)).otherwise("")
    return F.when(_hostile(marks_of(html) if marks is None else marks), guarded).otherwise(F.regexp_extract(html, TITLE, 1))


def links_of(html: Column) -> Column:
    """How often LINK matches: once at most from an opening to the next >, so all between
    them is taken at once."""
    return F.size(F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)<a{_SPACE}[^>]*"), F.lit(0)), lambda s: s.rlike(rf"(?i)href{_SPACE}*=")))


#: Spaces other than blanks and ends of lines.
_ODD_SPACES = "\t\r\f\x0b"
#: What follows & in an entity, and what both become: an & may make up another entity with
#: what follows, which is looked for later.
_NAMES = [(e[1:] + f[1:], to) for i, (e, to) in enumerate(ENTITIES) for f, _ in ENTITIES[i + 1 :] if to == "&"] + [(e[1:], to) for e, to in ENTITIES]


def _decoded(text: Column) -> Column:
    """What ENTITIES, one after the other, leave of a text. Each is looked for behind an & only."""

    def named(piece, i):
        out = F.when(i == 0, piece)
        for name, to in _NAMES:
            out = out.when(piece.startswith(name), F.concat(F.lit(to), F.substring(piece, len(name) + 1, 2**31 - 1)))
        return out.otherwise(F.concat(F.lit("&"), piece))

    def put(x):
        plain = x["t"]
        for entity, to in ENTITIES:
            plain = F.replace(plain, F.lit(entity), F.lit(to))
        return F.when(F.size(x["p"]) == 1, x["t"]).when(F.size(x["p"]) == _PIECES, plain).otherwise(F.array_join(F.transform(x["p"], named), ""))

    return let(let(text, lambda t: F.struct(t.alias("t"), F.split(t, "&", _PIECES).alias("p"))), put)


def _tidy(text: Column) -> Column:
    """What ENTITIES and SPACES say: lines without the blanks at their ends, none empty, and
    no two blanks side by side."""

    def blank(t):
        odd = reduce(Column.__or__, [t.contains(c) for c in _ODD_SPACES])
        return F.when(odd, F.regexp_replace(t, F.lit(f"[{_ODD_SPACES}]+"), F.lit(" "))).otherwise(t)

    def lines(x):
        kept = F.array_join(F.filter(F.transform(x["p"], lambda line: F.trim(line)), lambda line: line != ""), "\n")
        plain = F.regexp_replace(F.regexp_replace(x["t"], " +", " "), F.lit(SPACES[1][0]), F.lit(SPACES[1][1]))
        return F.when(F.size(x["p"]) < _PIECES, kept).otherwise(F.btrim(plain, F.lit(" \n")))

    split = let(let(_decoded(text), blank), lambda t: F.struct(t.alias("t"), F.split(t, "\n", _PIECES).alias("p")))
    return let(let(split, lines), lambda t: F.when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t))


def urn(*parts: Column) -> Column:
    """A record id made from names."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages (page_id, url, html) as response records: key, record_id, target_uri,
    warc_date, http_headers (status line and headers), payload, payload_digest."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    return pages.select(
        F.col("page_id").cast("long").alias("key"),
        urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).alias("record_id"),
        url.alias("target_uri"), F.lit(date).alias("warc_date"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.octet_length(html).cast("string")).alias("http_headers"),
        html.alias("payload"), digest(html).alias("payload_digest"),
    )


def split_responses(records: DataFrame) -> DataFrame:
    """Whole response records of ``read_warc`` as ``derive`` takes them: a block is its HTTP
    head up to the first empty line, and the payload (UTF-8). The digest is the source's own
    where it has one, else of the payload. ``is_text``: the head names a kind of text (or
    none), neither compressed nor in chunks; others have no conversion record."""
    block = F.col("block").cast("string")
    end = F.instr(block, F.lit(_END * 2))
    payload = F.when(end > 0, F.substring(block, end + 4, F.char_length(block))).otherwise("")
    head = F.when(end > 0, F.substring(block, F.lit(1), end - 1)).otherwise(block)
    field = lambda name: F.lower(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1))
    is_text = field("Content-Type").rlike("^$|^text/|html|xml|json") & field("Content-Encoding").rlike("^(identity)?$") & ~field("Transfer-Encoding").contains("chunked")
    return records.where("record_type = 'response' and problem is null").select(
        F.lit(None).cast("long").alias("key"), "record_id", "target_uri", "warc_date",
        head.alias("http_headers"), payload.alias("payload"), F.coalesce("payload_digest", digest(payload)).alias("payload_digest"), is_text.alias("is_text"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response (one, where a column is_text says false): key, record_type, record_id, refers_to, linked_to,
    target_uri, warc_date, content_type, source_headers, source_digest, block,
    block_digest, content_length (octets)."""
    marked = source.withColumn("marks", marks_of(F.col("payload")))
    s = marked.select(
        "*", urn(F.lit("metadata"), F.col("record_id")).alias("meta_id"), urn(F.lit("conversion"), F.col("record_id")).alias("text_id"),
        F.regexp_replace(_tidy(title_of(F.col("payload"), F.col("marks"))), "\n", " ").alias("title"),
        links_of(F.col("payload")).alias("links"),
    )
    fields = F.concat(
        F.lit("sourcePayloadDigest: "), F.col("payload_digest"), F.lit(_END), F.lit("title: "), F.col("title"), F.lit(_END),
        F.lit("outlinks: "), F.col("links").cast("string"), F.lit(_END), F.lit("httpHeaders: "), F.regexp_replace("http_headers", "\r\n", " | "), F.lit(_END),
    )
    made = lambda kind, own, other, content, block: F.struct(
        F.lit(kind).alias("record_type"), F.col(own).alias("record_id"), F.col(other).alias("linked_to"), F.lit(content).alias("content_type"), block.alias("block")
    )
    pair = F.array(
        made("metadata", "meta_id", "text_id", "application/warc-fields", fields),
        made("conversion", "text_id", "meta_id", "text/plain", plain_text(F.col("payload"), F.col("marks"))),
    )
    if "is_text" in source.columns:
        alone = F.array(made("metadata", "meta_id", "meta_id", "application/warc-fields", fields).withField("linked_to", F.lit(None).cast("string")))
        pair = F.when(F.col("is_text"), pair).otherwise(alone)
    both = s.select(
        "key", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"),
        F.explode(pair).alias("r"),
    )
    return both.select(
        "key", "r.record_type", "r.record_id", "refers_to", "r.linked_to", "target_uri", "warc_date", "r.content_type",
        "source_headers", "source_digest", "r.block", digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """Records (of ``derive``) as WARC/1.1 text, without the two line ends that follow."""
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_END))).otherwise("")
    named = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "linked_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "warc_date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Source-HTTP-Headers", "one_line"),
    ]
    return records.withColumn("one_line", F.regexp_replace("source_headers", "[\r\n]+", " | ")).select(F.concat(F.lit(f"WARC/1.1{_END}"), *[header(n, F.col(c)) for n, c in named], header("Content-Length", F.col("content_length").cast("string")), F.lit(_END), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Records to WARC files, one for each partition, in any file system Spark writes."""
    serialised(records).write.option("lineSep", _END + _END).text(path)


def _inflated(data: bytes) -> bytes:
    """The members of a gzip file, up to where it is cut off."""
    out = []
    while data[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        try:
            out.append(stream.decompress(data))
        except zlib.error:
            break
        data = stream.unused_data
    return b"".join(out)


#: Columns of records and the headers they come from.
_HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "linked_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest", "source_digest": "WARC-Source-Payload-Digest",
}
READ = ", ".join(f"{c} string" for c in _HEADERS) + ", problem string, block binary"
#: Bytes of blocks that leave a task in one batch.
_BATCH = 32 << 20


def _records(data: bytes):
    """(headers by lower-case name, problem, block) of each record of a file. A record whose
    head or length is damaged has no block; the next one is looked for behind its head."""
    at = data.find(b"WARC/1.")
    while at >= 0:
        head_end = data.find(b"\r\n\r\n", at)
        lines = data[at : head_end if head_end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")[1:]
        head = {name.strip().lower(): value.strip() for name, colon, value in (line.partition(":") for line in lines) if colon}
        length = head.get("content-length", "")
        begin = head_end + 4
        end = begin + int(length) if length.isascii() and length.isdigit() else -1
        if head_end < 0:
            yield head, "cut off", None
            return
        if begin <= end <= len(data) and (end == len(data) or data[end : end + 2] == b"\r\n"):
            yield head, None, data[begin:end]
        else:
            yield head, "cut off" if end > len(data) else "length", None
            end = begin
        at = data.find(b"WARC/1.", end)


def _parsed(batches):
    for batch in batches:
        for data in batch.column("content").to_pylist():
            rows, size = [], 0
            for row in _records(_inflated(data) if data[:2] == b"\x1f\x8b" else data):
                rows.append(row)
                size += len(row[2] or b"")
                if size > _BATCH:
                    yield _record_batch(rows)
                    rows, size = [], 0
            yield _record_batch(rows)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    named = [pa.array([h.get(n.lower()) for h, _, _ in rows], pa.string()) for n in _HEADERS.values()]
    return pa.RecordBatch.from_arrays([*named, pa.array([p for _, p, _ in rows], pa.string()), pa.array([b for *_, b in rows], pa.binary())], [*_HEADERS, "problem", "block"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, gzipped (by record or whole) or not. A file is read by one
    task. ``problem`` is null for whole records; a damaged one ('cut off' by the end of the
    file, or of a wrong 'length') is a row without a block, so that it can be counted, and
    the records behind it are read."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, READ)


def derivative_rows(pages: DataFrame) -> DataFrame:
    """A row for each derived record of each page."""
    return derive(responses(pages)).withColumnRenamed("key", "page_id")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if not any(c in text for c in "\n\r") else "replace('" + text.replace("'", "''").replace("\n", "~") + "', '~', chr(10))"


def _sql_steps(column: str, steps, entities=()) -> str:
    for e, to in entities:
        column = f"replace({column}, {_sql(e)}, {_sql(to)})"
    for pattern, to in steps:
        column = f"regexp_replace({column}, {_sql(pattern)}, {_sql(to)}, 'g')"
    return column


def _sql_urn(*parts: str) -> str:
    h = "md5(" + " || chr(10) || ".join(parts) + ")"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_CRLF = "chr(13) || chr(10)"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, url AS target_uri, {_sql_urn("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "coalesce(url, '')")} AS refers_to FROM pages),
s AS (SELECT *, 'sha256:' || sha256(payload) AS source_digest, {_sql_urn("'metadata'", "refers_to")} AS meta_id, {_sql_urn("'conversion'", "refers_to")} AS text_id,
  'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(payload) AS source_headers,
  replace({_sql_steps(f"regexp_extract(payload, {_sql(TITLE)}, 1)", SPACES, ENTITIES)}, chr(10), ' ') AS title,
  len(regexp_extract_all(payload, {_sql(LINK)})) AS links FROM p),
r AS (SELECT *, 'metadata' AS record_type, meta_id AS record_id, text_id AS linked_to, 'application/warc-fields' AS content_type,
    'sourcePayloadDigest: ' || source_digest || {_CRLF} || 'title: ' || title || {_CRLF} || 'outlinks: ' || links || {_CRLF} || 'httpHeaders: ' || replace(source_headers, {_CRLF}, ' | ') || {_CRLF} AS block FROM s
  UNION ALL SELECT *, 'conversion', text_id, meta_id, 'text/plain', {_sql_steps(_sql_steps("payload", STEPS), SPACES, ENTITIES)} FROM s)
SELECT page_id, record_type, record_id, refers_to, linked_to, target_uri, '{DATE}' AS warc_date, content_type, source_headers, source_digest, block,
  'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM r
"""

"""Secret scans with corpus-wide ownership frequency.

Method. Each text is scanned for three base kinds, which are always
reported, and for further shapes of credentials. The hash of every
candidate's value is then counted over the whole corpus by distinct
repositories and distinct owners. A value that ``COPIED`` owners hold, or two
owners in ``SPREAD`` repositories, is a widely copied example; one of a single
owner is live-looking, however many of its repositories hold it, and its
further spans are added to the base ones.

Counts are aggregated before each exchange. The verdict goes back to the spans
by a join; values with a thousandth of all spans or more, of which there are a
thousand at most, are broadcast, so no value makes a large task.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .blocks import utf8
from .scratch import free_names, written

#: Owners from which on a value counts as a copied example.
COPIED = 3
#: Repositories from which on a value of two owners counts as one.
SPREAD = 6
#: Values with this share of all spans are broadcast.
HOT = 1000
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Further kinds: a string that a text must hold for the pattern to be tried, and the pattern.
MORE = {
    "forge": (b"gh", re.compile(rb"\bgh[pousr]_[A-Za-z0-9]{30,}")),
    "chat": (b"xox", re.compile(rb"\bxox[abprs]-[A-Za-z0-9-]{20,}")),
    "pay": (b"_live_", re.compile(rb"\b[sr]k_live_[A-Za-z0-9]{16,}")),
    "cloud": (b"AIza", re.compile(rb"\bAIza[A-Za-z0-9_-]{35}")),
    "jwt": (b"eyJ", re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "bearer": (b"earer ", re.compile(rb"\b[Bb]earer ([A-Za-z0-9._~+/-]{20,}=*)")),
    "key_block": (b"PRIVATE KEY", re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")),
    "url": (b"://", re.compile(rb"\b[a-z][a-z0-9+.-]{0,31}://[^\s/:@]+:([^\s/:@]{8,})@")),
}
_SPANS = "array<struct<start:long,kind:string,end:long,value:string>>"
_SPANS_TYPE = ArrayType(StructType([StructField("start", LongType()), StructField("kind", StringType()), StructField("end", LongType()), StructField("value", StringType())]))
_NO_OWNER = "\0"


def find(text: bytes) -> tuple[list, list]:
    """Base spans and further ones: (start, kind, end, hash of the value), in code points."""
    base, more = [], []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        base += [(m.start(), "assign", m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in text:
        base += [(m.start(), "access", m.end(), m[0]) for m in _ACCESS.finditer(text)]
    base += [(m.start(), "hex", m.end(), m[0]) for m in _HEX.finditer(text)]
    begins, reach = _reach(base)
    for kind, (need, pattern) in MORE.items():
        if need in text:
            for m in pattern.finditer(text):
                at = bisect_right(begins, m.start())
                if not at or reach[at - 1] < m.end():
                    more.append((m.start(), kind, m.end(), m[m.lastindex or 0]))
    return _in_code_points(text, base), _in_code_points(text, more)


def _reach(spans: list) -> tuple[list[int], list[int]]:
    """The begins in order, and for each the furthest end of the spans that begin so far."""
    pairs = sorted((s, e) for s, _, e, _ in spans)
    return [s for s, _ in pairs], list(accumulate((e for _, e in pairs), max))


def _in_code_points(text: bytes, spans: list) -> list:
    if not spans:
        return spans
    place, at, code = {}, 0, 0
    for x in sorted({p for s in spans for p in (s[0], s[2])}):
        code += len(text[at:x].decode())
        at, place[x] = x, code
    return [{"start": place[s], "kind": kind, "end": place[e], "value": hashlib.sha256(v).hexdigest()} for s, kind, e, v in spans]


def _scan(keep: int, at: int):
    """The first ``keep`` columns as they are, then the base spans and the further ones of the texts in column ``at``."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("value", pa.string())]))

    def scan(batches):
        for batch in batches:
            data, starts = utf8(batch.column(at))
            data = data.tobytes()
            found = [find(data[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            spans = [pa.array([f[k] for f in found], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *spans], names=[str(i) for i in range(keep + 2)])

    return scan


def ownership(candidates: DataFrame, copied: int = COPIED, spread: int = SPREAD) -> DataFrame:
    """value, n (rows), owners and repositories (distinct ones over the whole corpus), and copied.

    candidates: value, owner, repository. Null owners count as one owner, null repositories as none.
    """
    owner = F.coalesce("owner", F.lit(_NO_OWNER))
    counts = candidates.groupBy("value").agg(F.count("*").alias("n"), F.count_distinct(owner).alias("owners"), F.count_distinct("repository").alias("repositories"))
    return counts.withColumn("copied", (F.col("owners") >= copied) | (F.col("owners") > 1) & (F.col("repositories") >= spread))


def _judged(spans: DataFrame, copied: int, spread: int) -> DataFrame:
    """``spans`` with copied: whether its value is a widely copied example."""
    counts = written(ownership(spans, copied, spread), "owners").select(F.col("value").alias("v"), "n", "copied")
    least = -(-(counts.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = counts.where(F.col("n") >= least).select("v", F.col("copied").alias("hot"))  # HOT rows at most
    marked = spans.join(F.broadcast(hot), F.col("value") == F.col("v"), "left").drop("v")
    rest = marked.where("hot is null").drop("hot").join(counts.where(F.col("n") < least), F.col("value") == F.col("v")).drop("v", "n")
    return marked.where("hot is not null").withColumnRenamed("hot", "copied").unionByName(rest)


def _ordered(spans: str) -> F.Column:
    """The spans by start, then by kind as listed."""
    kinds = ", ".join(f"'{k}'" for k in (*BASE, *MORE))
    return F.expr(f"transform(array_sort(transform({spans}, s -> named_struct('start', s.start, 'rank', array_position(array({kinds}), s.kind), 'end', s.end, 'kind', s.kind, 'copied', s.copied))), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'copied', s.copied))")


def _unfolded(found: DataFrame) -> DataFrame:
    """A row for each span: row, owner, repository, is_base, start, kind, end, value."""
    marked = (F.expr(f"transform({c}, s -> named_struct('base', {c == 'base'}, 's', s))") for c in ("base", "more"))
    spans = found.select("row", "owner", "repository", F.explode(F.concat(*marked)).alias("x"))
    return spans.select("row", "owner", "repository", F.col("x.base").alias("is_base"), *(F.col(f"x.s.{c}").alias(c) for c in ("start", "kind", "end", "value")))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", copied: int = COPIED, spread: int = SPREAD) -> DataFrame:
    """The secrets of each row: doc_id, base and spans.

    base and spans are arrays of (start, end, kind, copied) in order; spans
    has the base ones and those that ownership adds; ``copied`` is true for
    the values of widely copied examples.

    Defined cases: a null text counts as empty and has no spans; null owners
    count as one owner, null repositories as none; rows that repeat a doc_id
    have their own spans each; spans that begin together go by kind as
    listed; very long texts are scanned whole; an empty table gives none; other columns are ignored.
    """
    columns = {"doc_id": F.col(id_col).cast("long"), "owner": F.col(owner_col).cast("string"), "repository": F.col(repository_col).cast("string"), "text": F.col(text_col).cast("string")}
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *(c.alias(name) for name, c in columns.items()))
    found = written(numbered.mapInArrow(_scan(4, 4), f"row long, doc_id long, owner string, repository string, base {_SPANS}, more {_SPANS}"), "found")
    judged = _judged(_unfolded(found), copied, spread).where("is_base or not copied")
    of_row = judged.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "kind", "end", "copied", "is_base")).alias("all"))
    out = found.select("row", "doc_id").join(of_row, F.col("row") == F.col("r"), "left").withColumn("all", F.coalesce("all", F.expr("array()")))
    return out.select("doc_id", _ordered("filter(all, s -> s.is_base)").alias("base"), _ordered("all").alias("spans"))


def described(spans: str) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]", copied: int = COPIED, spread: int = SPREAD) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``, and n_chars counted anew where there is one.

    Values of widely copied examples are replaced only where a base kind
    reports them. Only rows with further candidates wait for the corpus's
    verdict and go through an exchange.

    Defined cases: a null text stays null; overlapping spans become one mark;
    rows that repeat a doc_id are redacted each; an empty table gives none;
    other columns stay as they are, whatever their names.
    """
    row, base, more, r, extra = free_names(docs, "_row", "_base", "_more", "_r", "_extra")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    fields = StructType([*numbered.schema, *(StructField(c, _SPANS_TYPE) for c in (base, more))])
    held = written(numbered.mapInArrow(_scan(len(numbered.columns), numbered.columns.index("text")), fields), "texts")
    found = held.select(F.col(row).alias("row"), F.col("source").cast("string").alias("owner"), F.col("doc_id").cast("string").alias("repository"), F.col(base).alias("base"), F.col(more).alias("more"))
    live = _judged(_unfolded(found), copied, spread).where("not is_base and not copied")
    live = live.groupBy(F.col("row").alias(r)).agg(F.collect_list(F.struct("start", "kind", "end", "value")).alias(extra))
    plain = held.where(F.size(more) == 0).withColumn(extra, F.expr(f"cast(array() as {_SPANS})"))
    waiting = held.where(F.size(more) > 0).join(live, F.col(row) == F.col(r), "left").drop(r)
    df = plain.unionByName(waiting)
    spans = f"array_sort(transform(concat({base}, coalesce({extra}, array())), s -> named_struct('start', s.start, 'end', s.end)))"
    # Spans in order; one that begins within the part already copied adds only what lies beyond it.
    text = F.expr(f"""aggregate({spans}, named_struct('at', 0L, 'out', ''), (a, s) -> named_struct(
        'at', greatest(a.at, s.end), 'out', if(s.start < a.at, a.out, concat(a.out, substring(text, cast(a.at + 1 as int), cast(s.start - a.at as int)), '{mark}'))),
        a -> concat(a.out, substring(text, cast(a.at + 1 as int))))""")
    hit = (F.size(base) > 0) | (F.size(extra) > 0)
    df = df.withColumn("text", F.when(hit, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        df = df.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return df.select(docs.columns)

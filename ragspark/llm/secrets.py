"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds one row per blob and
rule version, with what was found. A scan reads the texts of those blobs only that some rule version
has not seen, once for each blob, however many paths hold it; findings of old and new blobs are then
joined back to all paths. ``scan`` returns the grown ledger, so the next scan pays for new content or rules; ``scan_instalment`` keeps it in a
lasting table.

Null texts are the blob of the empty text. Repeated rows share a blob and each get its findings. Spans count
code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import text_slices, written
from ragspark.operators.hotkeys import salted_join
from ragspark.streaming.batches import BatchLog

#: Kinds of finding, in the order that ties at one start take.
KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE_KINDS = KINDS[:3]
#: Rule versions: bump a name when its rules change, and only that version is scanned again.
RULES = {"base-1": BASE_KINDS, "blocks-4": KINDS[3:]}

LEDGER = "blob string, rules string, spans array<struct<start: int, rank: int, kind: string, end: int>>"

# Fixed patterns of the base kinds; letters of names in either case, ASCII only.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGNED = 6
# Further kinds: private keys from the header to the end of the key, and signed web tokens.
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]{2,12} ){0,3}PRIVATE KEY(?: BLOCK)?)-----")
# Inside a key without an END line; line ends may be written as \\n.
_GAP = re.compile(r"(?:\s|\\[nr])*")
_FIELD = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*")
_BASE64 = re.compile(r"[A-Za-z0-9+/=]+")
_LINE_ENDS = re.compile(r"[^\S\r\n]*(?:[\r\n]|\\[nr]|[\"'`]|\Z)")
_FULL_LINE = 16
# Up to an END line: fields, full base64 lines (or words of that length), and shorter ones that stand alone on their line.
_KEY = re.compile(
    rf"(?:(?:\s|\\[nr])*+(?:{_FIELD.pattern}|[A-Za-z0-9+/=]{{{_FULL_LINE},}}+|[A-Za-z0-9+/=]++(?=[^\S\r\n]*(?:[\r\n]|\\[nr]|-----END))))*+(?:\s|\\[nr])*+"
)
# Web tokens: maximal runs first, their parts are tested afterwards.
_RUN = re.compile(r"[A-Za-z0-9_.-]+")
_SEGMENT, _SIGNATURE = 11, 16


def _key_end(text: str, at: int, label: str) -> int:
    """End of the private key whose header ends at ``at``: its END line where only fields and base64 stand between, or else the end of its base64 block.

    A header that is only named in prose ends where it ends.
    """
    last = f"-----END {label}-----"
    body = _KEY.match(text, at)
    if text.startswith(last, body.end()):
        return body.end() + len(last)
    end = at
    while field := _FIELD.match(text, _GAP.match(text, end).end()):
        end = field.end()
    # a short word belongs to the key only as its last line, or as the check sum after that
    while block := _BASE64.match(text, _GAP.match(text, end).end()):
        short = len(block[0]) < _FULL_LINE
        if short and (end == at or not _LINE_ENDS.match(text, block.end())):
            break
        end = block.end()
        if short and not text.startswith("=", _GAP.match(text, end).end()):
            break
    return end


def _keys(text: str) -> Iterator[tuple[int, int]]:
    for m in _PEM.finditer(text):
        yield m.start(), _key_end(text, m.end(), m[1])


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of three parts joined by dots, of which the first two hold JSON objects; in one pass over the text."""
    for run in _RUN.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, starts, at = run[0].split("."), [], run.start()
        for part in parts:
            starts.append(at)
            at += len(part) + 1
        i = 0
        while i + 2 < len(parts):
            head, body, signed = parts[i : i + 3]
            begin = head.find("eyJ")
            if begin >= 0 and len(head) - begin >= _SEGMENT and body.startswith("eyJ") and len(body) >= _SEGMENT and len(signed) >= _SIGNATURE:
                yield starts[i] + begin, starts[i + 2] + len(signed)
                i += 3
            else:
                i += 1


def find(text: str, kinds: tuple[str, ...]) -> list[tuple[int, int, str, int]]:
    """Sorted ``(start, rank of the kind, kind, end)`` of a whole text.

    A greedy run holds every shorter one, so asking for its least length in the pattern drops the same
    matches as testing the length afterwards. That does not hold for ``assign``, whose short matches use
    up text that a later one could start in; these are tested afterwards.
    """
    out = []
    for rank, kind in enumerate(KINDS):
        if kind not in kinds:
            continue
        if kind == "assign":
            low = text.lower() if ":" in text or "=" in text else ""
            if any(name in low for name in _NAMES):
                out += [(m.start(), rank, kind, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGNED]
            continue
        if kind == "jwt" and "eyJ" not in text or kind == "pem" and "-----BEGIN " not in text:
            continue
        if kind in ("pem", "jwt"):
            out += [(start, rank, kind, end) for start, end in (_keys if kind == "pem" else _tokens)(text)]
            continue
        pattern = {"access": _ACCESS, "hex": _HEX}[kind]
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text)]
    return sorted(out)


def empty_ledger(frame: DataFrame) -> DataFrame:
    return frame.sparkSession.createDataFrame([], LEDGER)


def addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text"))


def _scanned(todo: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """Ledger rows for rows of ``blob, todo, text``."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    names = ("start", "rank", "kind", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                blobs, versions, found = [], [], []
                for blob, wanted, text in zip(*(part.column(c).to_pylist() for c in ("blob", "todo", "text"))):
                    for name in wanted:
                        blobs.append(blob)
                        versions.append(name)
                        found.append([dict(zip(names, s)) for s in find(text, rules[name])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blobs, pa.string()), pa.array(versions, pa.string()), pa.array(found, spans)],
                    ["blob", "rules", "spans"],
                )

    return todo.select("blob", "todo", "text").mapInArrow(run, LEDGER)


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    path: str = "path",
    text: str = "text",
    rules: dict[str, tuple[str, ...]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(findings, ledger)``: ``path, blob, spans`` for each row of ``versions``, and the ledger with what is new.

    ``spans`` is sorted and empty where nothing was found.
    """
    return _scan(versions, empty_ledger(versions) if ledger is None else ledger, path, text, rules)[:2]


def _scan(
    versions: DataFrame, ledger: DataFrame, path: str, text: str, rules: dict[str, tuple[str, ...]] | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The findings, the grown ledger, and what is new in it."""
    rules = RULES if rules is None else rules
    bodies = addressed(versions, path, text)
    paths = written(bodies.select("path", "blob"), "paths")
    seen = ledger.filter(F.col("rules").isin(list(rules))).groupBy("blob").agg(F.collect_set("rules").alias("seen"))
    everything = F.array(*[F.lit(r) for r in rules])
    todo = (
        paths.groupBy("blob")
        .agg(F.min(F.struct("path")).alias("at"))
        .join(seen, "blob", "left")
        .select("blob", F.col("at.path").alias("path"), F.array_except(everything, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        .filter(F.size("todo") > 0)
    )
    # the small side is built into a table, so whole texts are neither sorted nor spilled
    b, t = bodies.alias("b"), todo.hint("shuffle_hash").alias("t")
    texts = b.join(t, (F.col("b.blob") == F.col("t.blob")) & F.col("b.path").eqNullSafe(F.col("t.path"))).select("b.blob", "t.todo", "b.text")
    fresh = written(_scanned(texts, rules).dropDuplicates(["blob", "rules"]), "ledger")
    grown = ledger.unionByName(fresh)
    found = (
        grown.filter(F.col("rules").isin(list(rules)) & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    nothing = F.array().cast("array<struct<start: int, rank: int, kind: string, end: int>>")
    # a blob may be at a third of all paths
    told = salted_join(paths, found, ["blob"], "left", F.xxhash64("path"))
    joined = told.select("path", "blob", F.coalesce("spans", nothing).alias("spans"))
    return joined, grown, fresh


def scan_instalment(
    versions: DataFrame, home: str, number: int, path: str = "path", text: str = "text", rules: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """Findings of one instalment of versions, against the ledger that lives at ``home`` and grows by what is new.

    ``home`` outlives the run: it is a table of committed batches, one for each instalment by ``number``, kept where the caller keeps tables. An
    instalment that is scanned again, after a failure or on purpose, finds its own commit and appends nothing, so a blob is in the ledger once a rule version.
    """
    spark = versions.sparkSession
    book = BatchLog(spark, home)
    known = spark.read.schema(LEDGER).parquet(*[book.folder("data", n) for n in book.committed()]) if book.committed() else empty_ledger(versions)
    findings, grown, fresh = _scan(versions, known, path, text, rules)
    book.put(fresh, number)
    return findings


def joined_spans(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of a column of sorted spans, comma-joined."""
    chosen = spans if kinds == KINDS else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Put ``[kind]`` in place of each span; spans that overlap are one, named after the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, findings: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what ``findings`` has for their path masked; texts that change are cut by code points."""
    names = docs.columns
    hit = findings.filter(F.size("spans") > 0).select(F.col("path").alias("__path"), F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    own = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    hit = hit.dropDuplicates(["__path", "__blob"]).hint("shuffle_hash")
    both = docs.withColumn("__own", own).join(hit, F.col(path).eqNullSafe(F.col("__path")) & (F.col("__own") == F.col("__blob")), "left")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                spans = part.column("__spans").to_pylist()
                texts = part.column(text).to_pylist()
                done = [mask(t, [(s["start"], s["end"], s["kind"]) for s in found]) if found else t for t, found in zip(texts, spans)]
                columns = [pa.array(done, pa.string()) if n == text else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return both.select(*names, "__spans").mapInArrow(run, schema)

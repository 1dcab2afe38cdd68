"""WARC archives: written by Spark, normalised from monolithic gzip to a member a record, read back by offset.

Spark's text writer gives whole-file gzip streams, in which no record can be reached without
inflating all before it. The normaliser inflates such a stream once, in pieces, writes every record
as a gzip member of its own and notes its place in a sidecar index beside the archive. Readers then
deal the index's rows among tasks, and each task opens an archive at an offset.

Python reaches archives through ``pyarrow.fs``, so they may lie in any store it knows. A normalised
archive has a name of its task's own making, and only archives in the manifest, which Spark commits,
exist for readers: what a lost task left behind is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm.common import Scratch, partitions_for, shuffles_dropped, table

#: Payloads of fewer bytes are always stored, since a revisit record would be no shorter.
LEAST_BYTES = 100
#: Parts into which the records of one payload are dealt when they meet the record that they revisit.
SALTS = 32
#: Bytes inflated, hashed or copied at once.
CHUNK = 1 << 20
#: Bytes of an archive that one row of dealing stands for, and index rows of one batch.
SLICE, INDEX_ROWS = 1 << 20, 4096
#: Bytes of archives that a task reads, about.
TASK_BYTES = 64 << 20
# Lines of the format.
VERSION, CRLF = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The tables name no time of capture, so that records have this one.
DATE = "1970-01-01T00:00:00Z"


# Writing


def with_roles(pages: DataFrame, key: str, url: str, payload: str, least: int = LEAST_BYTES) -> DataFrame:
    """(key, url, payload, digest, n_bytes, row, first): ``first`` (key, row) of records that repeat another's payload.

    Of rows with equal payloads of ``least`` bytes or more, that of the smallest key comes first (null
    keys last; of rows that repeat a key, the first read), the others revisit it. A null payload
    is an empty one. Only digests and keys are grouped; a payload's rows are salted when they
    meet its first record, so that one payload may hold any share of the rows.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    firsts = rows.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    salted = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.withColumn("salt", (F.col("row") % SALTS).cast("int")).join(salted, ["digest", "salt"], "left")
    return met.withColumn("first", F.when(F.col("first.row") != F.col("row"), F.col("first"))).drop("salt")


def _line(name: str, value: Column) -> Column:
    """A header line; null without a value, and without what would end the line."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "), F.lit(CRLF))


def record_id(key: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def record_text() -> Column:
    """The whole record of a row of ``with_roles`` but its last line break, which the text writer adds."""
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    optional = lambda name, value: F.coalesce(_line(name, value), F.lit(""))
    return F.concat(
        F.lit(VERSION + CRLF), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", record_id(F.col("key"), F.col("row"))),
        optional("WARC-Target-URI", F.col("url")), _line("WARC-Date", F.lit(DATE)), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", record_id(F.col("first.key"), F.col("first.row"))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block, F.lit(CRLF),
    )


def write_monolithic(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES) -> None:
    """A record per row of ``pages`` into whole-file gzip archives in ``folder``, one for each partition."""
    records = with_roles(pages, key, url, payload, least).select(record_text().alias("value"))
    with shuffles_dropped(pages.sparkSession):
        records.write.option("lineSep", CRLF).option("compression", "gzip").text(folder)


# Streams of records


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark writes it, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def read_head(stream: BinaryIO, version: bool = True) -> tuple[bytes, dict[str, str]] | None:
    """The header block at the stream's place with its fields by lower-cased name; None at the end. Blank lines before a record don't count."""
    line = stream.readline(CHUNK)
    while version and line in (b"\r\n", b"\n"):
        line = stream.readline(CHUNK)
    if not line:
        return None
    if version and not line.startswith(b"WARC/"):
        raise ValueError(f"no record where one should start: {line[:20]!r}")
    lines = [line]
    while line not in (b"\r\n", b"\n"):
        line = stream.readline(CHUNK)
        if not line:
            raise EOFError("the stream ends within a header")
        lines.append(line)
    fields: dict[str, str] = {}
    last = ""
    for text in (x.decode("utf-8", "replace").rstrip("\r\n") for x in lines[1:-1]):
        if text[:1] in (" ", "\t") and last:  # a folded line
            fields[last] += " " + text.strip()
        elif ":" in text:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            fields[last] = value.strip()
    return b"".join(lines), fields


def pieces(stream: BinaryIO, size: int) -> Iterator[bytes]:
    """The next ``size`` bytes in pieces; an error if the stream ends before."""
    while size:
        piece = stream.read(min(size, CHUNK))
        if not piece:
            raise EOFError(f"the stream ends {size} bytes before its record")
        yield piece
        size -= len(piece)


def _length(fields: dict[str, str]) -> int:
    text = fields.get("content-length", "")
    if not text.isdigit():
        raise ValueError(f"a record's length is {text!r}")
    return int(text)


def rewrite(stream: BinaryIO, out: BinaryIO, sidecar: BinaryIO, level: int = 6) -> Iterator[int]:
    """Copy the records of an inflated stream into members of ``out``, with an index line each; yields the members' sizes.

    A record goes through in pieces, and only its deflated bytes are held, until it is whole: a
    stream that breaks off leaves no part of a record behind.
    """
    offset = 0
    while (head := read_head(stream)) is not None:
        raw, fields = head
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = [packer.compress(raw)]
        member += [packer.compress(piece) for piece in pieces(stream, _length(fields))]
        member += [packer.compress(b"\r\n\r\n"), packer.flush()]
        size = sum(map(len, member))
        for part in member:
            out.write(part)
        line = {"offset": offset, "length": size, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
        sidecar.write(json.dumps(line).encode() + b"\n")
        offset += size
        yield size


MANIFEST = "source string, archive string, sidecar string, n_records long, n_bytes long, error string"


def normalise(spark: SparkSession, folder: str, target: str, pattern: str = "*.gz") -> DataFrame:
    """Rewrite every archive of ``folder`` that fits ``pattern`` into ``target``, a member a record; the manifest.

    Manifest: source, archive, sidecar, n_records, n_bytes, error. A source may hold one gzip stream
    or several members. Of one that is broken or no archive, the whole records up to the break
    are kept and ``error`` says what was wrong. An empty source gives an archive of no records; so do
    no sources give no rows. Tasks hold a piece of a stream and one record's deflated bytes.
    """
    sources = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(target)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = f"{path.rstrip('/').rsplit('/', 1)[-1].split('.')[0]}-{uuid.uuid4().hex[:12]}.warc.gz"
                store.create_dir(root, recursive=True)
                there, at = filesystem(path)
                n, size, error = 0, 0, None
                with there.open_input_stream(at, compression=None) as raw, store.open_output_stream(f"{root}/{name}", compression=None) as out, store.open_output_stream(f"{root}/{name}.idx", compression=None) as sidecar:
                    try:
                        for member in rewrite(gzip.GzipFile(fileobj=raw), out, sidecar):
                            n, size = n + 1, size + member
                    except (EOFError, ValueError, gzip.BadGzipFile, zlib.error) as e:
                        error = str(e)
                whole = f"{target.rstrip('/')}/{name}"
                yield pa.RecordBatch.from_pylist([{"source": path, "archive": whole, "sidecar": whole + ".idx", "n_records": n, "n_bytes": size, "error": error}], schema)

    schema = pa.schema([("source", pa.string()), ("archive", pa.string()), ("sidecar", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("error", pa.string())])
    return Scratch(spark, "manifest").write(sources.mapInArrow(run, MANIFEST))


# Reading

INDEX = "archive string, offset long, length long, type string, id string, uri string, digest string"


def read_index(manifest: DataFrame) -> DataFrame:
    """The sidecars' rows: archive, offset, length, type, id, uri, digest."""
    names = ("offset", "length", "type", "id", "uri", "digest")
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *((n, pa.string()) for n in names[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist()):
                store, at = filesystem(sidecar)
                with store.open_input_stream(at, compression=None) as raw:
                    rows = []
                    for line in io.BufferedReader(raw, CHUNK):
                        rows.append(json.loads(line) | {"archive": archive})
                        if len(rows) == INDEX_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("archive", "sidecar").mapInArrow(run, INDEX)


RECORDS = "archive string, offset long, type string, id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_record(member: bytes, payloads: bool) -> dict:
    """A record off its gzip member: the payload's size and digest, measured on a stored payload and else as stated, and the payload if asked for."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(member))
    _, fields = read_head(stream)
    found = {"type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    left, stated = _length(fields), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    http: dict[str, str] = {}
    if fields.get("content-type", "").startswith("application/http"):
        raw, http = read_head(stream, version=False) or (b"", {})
        left -= len(raw)
    if found["type"] == "revisit":
        return found | {"payload_bytes": _length(http), "payload_digest": stated, "payload": None}
    digest, kept, size = hashlib.sha256(), [], left
    for piece in pieces(stream, left):
        digest.update(piece)
        if payloads:
            kept.append(piece)
    if stated not in (None, digest.hexdigest()):
        raise ValueError(f"the payload of {found['id']} is not the one it was written with")
    return found | {"payload_bytes": size, "payload_digest": digest.hexdigest(), "payload": b"".join(kept) if payloads else None}


def read_records(index: DataFrame, payloads: bool = False, tasks: int | None = None) -> DataFrame:
    """The records at the index's places: archive, offset, type, id, uri, refers_to, payload_bytes, payload_digest, payload.

    Index rows are dealt by stretches of archives, so that a large one is read by many tasks, ``tasks``
    of them if given: index rows are small, and Spark would put very many into one. A revisit has the size and digest of the payload that it stands for. ``payload`` is null unless
    asked for. A payload that doesn't fit its stated digest is an error.
    """
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != opened:
                    if source is not None:
                        source.close()
                    store, at = filesystem(archive)
                    source, opened = store.open_input_file(at), archive
                record = read_record(source.read_at(length, offset), payloads)
                rows.append(record | {"archive": archive, "offset": offset})
                held += len(record["payload"] or b"")
                if held > 16 * CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        if source is not None:
            source.close()

    by = ([tasks] if tasks else []) + ["archive", "slice"]
    dealt = index.select("archive", "offset", "length").withColumn("slice", F.floor(F.col("offset") / SLICE)).repartition(*by).sortWithinPartitions("archive", "offset")
    return dealt.drop("slice").mapInArrow(run, RECORDS)


def page_of(record: str) -> Column:
    """The key in the record id of a column; null for none."""
    return F.expr(f"try_cast(regexp_extract({record}, '^<urn:page:(-?[0-9]*):', 1) AS bigint)")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record, normalised and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Rows that repeat a page are records of their own. A null html or url is an empty payload or no
    target; a null page_id comes back as null. An empty table gives no rows.
    """
    scratch = Scratch(spark, "warc")
    write_monolithic(table(spark, sf_dir, "pages"), f"{scratch.root}/monolithic")
    manifest = normalise(spark, f"{scratch.root}/monolithic", f"{scratch.root}/archives")
    scratch.remove(f"{scratch.root}/monolithic")
    size, error = manifest.agg(F.sum("n_bytes"), F.max("error")).first()
    if error:
        raise OSError(error)
    found = read_records(read_index(manifest), tasks=partitions_for(spark, size or 0, TASK_BYTES))
    return found.select(page_of("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"))


OP11_SQL = f"""WITH stored AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS place, first(page_id) OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS least FROM stored)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= {LEAST_BYTES} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= {LEAST_BYTES} AND place > 1 THEN least END AS refers_to FROM ranked"""

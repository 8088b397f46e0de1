"""WARC archives with an index first.

Tasks write gzip-per-record archives into the shared folder and return where every record lies. The index is
a table of its own; readers take it, sort its byte ranges by file and offset, join neighbouring ones into one
read, and parse and verify the records they were asked for.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numbra.llm.common import cut, shared_path

#: Payloads of this size or more are stored once.
LEAST_REVISIT = 1000
#: Ranges with up to GAP bytes between them are read at once, up to about READ bytes; a reading task gets about SPAN bytes.
GAP, READ, SPAN = 64 << 10, 4 << 20, 8 << 20
_END = b"\r\n"
INDEX = "id long, url string, record_type string, refers_to long, payload_bytes long, digest string, file string, offset long, length long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _urn(number: int | None) -> str:
    return f"urn:page:{'none' if number is None else number}"


def _clean(url: str | None) -> str:
    """A URL in one header line: controls, spaces and percent-free line breaks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "urn:none"


def record(number: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One gzip member with a response or revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_urn(number)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{_urn(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + _END + _END + block + _END + _END) + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record in its gzip member; a broken one raises ValueError."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(_END + _END)
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != _END + _END:
        raise ValueError("not a WARC record")
    payload = block.partition(_END + _END)[2]
    if fields["warc-type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["warc-payload-digest"] != f"sha1:{digest}" or int(fields["x-payload-length"]) != len(payload):
            raise ValueError("payload and digest differ")
    return fields, payload


def _number(urn: str) -> int | None:
    text = urn.strip("<>").rsplit(":", 1)[1]
    return None if text == "none" else int(text)


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        context = TaskContext.get()
        # an attempt has a file of its own; the index names the files of attempts that ended well
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number, url, payload, digest, owner, revisit = row
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = record(number, url, payload, digest, owner, revisit, date)
                out.write(member)
                kind = "revisit" if revisit else "response"
                rows.append((number, url, kind, owner if revisit else None, len(payload), digest, name, at, len(member)))
                at += len(member)
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    return run


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_revisit: int = LEAST_REVISIT, date: str | None = None,
) -> DataFrame:
    """Writes a record per row and returns the index (columns of INDEX), cut from its lineage.

    Of records with equal payloads of `least_revisit` bytes or more the one with the largest id is the
    response and the others revisit it; rows that repeat its id and payload are responses too. Null payloads
    are empty, null ids revisit any owner with an id, groups of null ids are responses, null URLs are
    written as urn:none. An empty table writes nothing and gives an empty index.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"key": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload")})
    # small payloads, the empty ones among them, meet nobody
    large, small = rows.filter(F.col("size") >= least_revisit), rows.filter(F.col("size") < least_revisit)
    owners = large.groupBy("key", "size").agg(F.max("id").alias("owner"), F.count("*").alias("rows")).filter("rows > 1")
    # cut, so that the join is between two plain exchanges: Spark splits the rows of a hot payload over many tasks
    owners = cut(owners.drop("rows"))
    rows = large.join(owners, ["key", "size"], "left").unionByName(small, allowMissingColumns=True)
    revisit = F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))
    chosen = rows.select("id", "url", "payload", F.sha1("payload").alias("digest"), "owner", revisit.alias("revisit"))
    return cut(chosen.mapInArrow(_writer(folder, date), INDEX))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        name, source = None, None

        def spans(rows: list[dict]) -> Iterator[tuple[str, int, int, list[dict]]]:
            held: list[dict] = []
            for r in rows:
                if held and (r["file"] != held[0]["file"] or r["offset"] > held[-1]["offset"] + held[-1]["length"] + GAP or r["offset"] + r["length"] - held[0]["offset"] > READ):
                    yield held[0]["file"], held[0]["offset"], held[-1]["offset"] + held[-1]["length"], held
                    held = []
                held.append(r)
            if held:
                yield held[0]["file"], held[0]["offset"], held[-1]["offset"] + held[-1]["length"], held

        for batch in batches:
            for file, first, last, rows in spans(batch.to_pylist()):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{path}/{file}")
                source.seek(first)
                data = source.read(last - first)
                out = []
                for r in rows:
                    fields, payload = parse(data[r["offset"] - first : r["offset"] - first + r["length"]])
                    refers = fields.get("warc-refers-to")
                    digest = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
                    out.append((_number(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], refers and _number(refers), int(fields["x-payload-length"]), digest, payload if fields["warc-type"] == "response" else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = ["id", "url", "record_type", "refers_to", "payload_bytes", "digest", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if source is not None:
            source.close()

    return run


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of an index select, from sorted and joined byte ranges: id, url, record_type,
    refers_to, payload_bytes, digest and payload (null for revisits, and for all if payloads=False).

    The number of reading tasks follows the bytes to read, not the size of the index."""
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // SPAN))
    ranges = index.select("file", "offset", "length").withColumn("span", F.floor(F.col("offset") / (SPAN // 4)))
    ranges = ranges.repartition(tasks, "file", "span").sortWithinPartitions("file", "offset").drop("span")
    shape = "id long, url string, record_type string, refers_to long, payload_bytes long, digest string, payload binary"
    found = ranges.mapInArrow(_reader(folder), shape)
    return found if payloads else found.withColumn("payload", F.lit(None).cast("binary"))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives of all rows into the shared folder and reads every record back through the index:
    id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, id_col, url_col, html_col)
    back = read_archives(index, folder, payloads=False)
    return back.select(F.col("id").alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")

"""WARC archives: written with an index, read back through it.

Each task writes its pages as one-record gzip members to archives of its own in the shared folder, and gives an index row
(archive, offset, length, url, digest, ...) for each record. Reading starts from the index: selected rows are dealt by
(archive, offset) ranges, neighbouring byte ranges are coalesced, and each read is cut into its records again. An archive's
name holds a fresh token, so a task that runs twice leaves an archive that no index row names, and nothing is half read.
Readers are as many as the selected records' bytes ask for.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import folder as new_folder, written

#: An archive is closed beyond this size; ranges with smaller gaps are read at once, up to READ bytes.
ARCHIVE, GAP, READ = 512 << 20, 64 << 10, 8 << 20
#: Bytes of records that one task reads; where that makes few tasks, as little as LEAST bytes each.
TASK, LEAST = 128 << 20, 256 << 10
EOL = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, record_type string"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, uncompressed. A revisit has the response's HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + EOL + EOL + block + EOL + EOL


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers with lower-case names, HTTP head, payload) of one record."""
    head, _, rest = raw.partition(EOL + EOL)
    lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(EOL + EOL)
    return headers, http, payload


def _types(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, html, first): ``first`` is the smallest id with an equal payload, null for the response itself, for a
    record without an equal or with one shorter than ``least`` bytes. Of rows that share the smallest id one is the response."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    key: list[Column] = [F.sha1(F.encode("html", "UTF-8")).alias("_sha"), F.octet_length("html").alias("_len")]
    rows = p.select("page_id", *key).where(F.col("_len") >= least).groupBy("_sha", "_len", "page_id").agg(F.count("*").alias("_n"))
    firsts = rows.groupBy("_sha", "_len").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "_n"))).alias("_of"), F.sum("_n").alias("_n"))
    # written first, so that the join below is between two plain tables and a payload of very many pages can be split
    firsts = written(firsts.where("_n > 1 and _of is not null").select("_sha", "_len", F.col("_of.page_id").alias("_first"), (F.col("_of._n") > 1).alias("_twice")), "payloads")
    joined = p.select("*", *key).join(firsts, ["_sha", "_len"], "left")
    tied = F.coalesce((F.col("page_id") == F.col("_first")) & F.col("_twice"), F.lit(False))
    out = joined.where(~tied).select("page_id", "url", "html", F.expr("case when page_id is null or page_id <> _first then _first end").alias("first"))
    if not firsts.where("_twice").limit(1).count():
        return out
    place = F.row_number().over(Window.partitionBy("_sha", "_len").orderBy("url"))
    again = joined.where(tied).select("page_id", "url", "html", place.alias("_place"), "_first")
    return out.unionByName(again.select("page_id", "url", "html", F.expr("case when _place > 1 then _first end").alias("first")))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per page below ``folder`` (a new one in the shared folder if None) and returns the index, itself a
    written table.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is the response and the
    others revisit it; of rows that share that id the one with the least url is the response. A null page_id comes after all
    others; pages that all lack an id are all responses, for there is no id to refer to. Null html is an empty payload; a null
    url leaves its header out. Other columns are not archived, whatever their names; an empty table gives an empty index.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= ARCHIVE:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = r["html"].encode("utf-8", "surrogatepass")
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(r["page_id"], r["url"], payload, r["first"], r["first"] is not None, date)) + packer.flush()
                out.write(member)
                rows.append((name, at, len(member), r["page_id"], r["url"], digest(payload), "response" if r["first"] is None else "revisit"))
                at += len(member)
            names = ["archive", "offset", "length", "page_id", "url", "payload_digest", "record_type"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)
        if out is not None:
            out.close()

    index = written(_types(pages, least).mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("folder", F.lit(folder))


def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Sorted index rows in runs that are read at once."""
    run: list[dict] = []
    for r in rows:
        if run and (r["archive"] != run[0]["archive"] or r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > GAP or r["offset"] + r["length"] - run[0]["offset"] > READ):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_archives(index: DataFrame, folder: str | None = None) -> DataFrame:
    """The records that ``index`` rows select: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response's payload is hashed again and must agree with its header, a revisit's payload is null and its length and
    digest are those of the full payload. An empty index reads nothing; a row that stands twice in it is read twice.
    """
    selected = index.select("archive", "offset", "length", F.lit(folder).alias("folder") if folder else F.col("folder"))
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK), min(total // LEAST, 4 * index.sparkSession.sparkContext.defaultParallelism))
    # slices of an archive go to tasks; a number keeps adaptive execution from merging them, for a row stands for many bytes
    piece = F.floor(F.col("offset") / F.lit(max(LEAST, min(READ, total // tasks // 2))))
    selected = selected.repartition(tasks, "archive", piece).sortWithinPartitions("archive", "offset")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(uri: str | None) -> int | None:
        return int(m[1]) if uri and (m := re.match(r"<urn:x-page:(-?\d+)>", uri)) else None

    def read(run: list[dict]) -> list[tuple]:
        fs, root = pafs.FileSystem.from_uri(run[0]["folder"])
        start = run[0]["offset"]
        with fs.open_input_file(f"{root}/{run[0]['archive']}") as f:
            f.seek(start)
            blob = f.read(max(r["offset"] + r["length"] for r in run) - start)
        out = []
        for r in run:
            member = io.BytesIO(blob[r["offset"] - start : r["offset"] - start + r["length"]]).read()
            headers, http, payload = parse(zlib.decompress(member, 31))
            said = headers["warc-payload-digest"].removeprefix("sha1:")
            kind = headers["warc-type"]
            if kind == "response" and digest(payload) != said:
                raise ValueError(f"{r['archive']} at {r['offset']}: the payload does not agree with its digest")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            out.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), size, said, kind, number(headers.get("warc-refers-to")), payload if kind == "response" else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _ranges(batch.to_pylist()):
                columns = zip(*read(part), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return selected.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")

"""WARC archives with an index written first.

Tasks write pages as WARC records, one gzip member each, into archive files in
the shared folder and hand back one index row a record: file, offset, length,
URL and digest. The index is a table written by Spark; a file of a failed
attempt is in no index row and is never read. Readers select rows of the
index, deal them out by file and range, and read each run of neighbouring
records with one byte-range request.

Equal payloads of at least ``min_bytes`` bytes are stored once: the record of
the smallest page id is a response, the others are revisits of it, which hold
the HTTP header (with the payload's length) and the digest only.

Defined cases: a null html is an empty payload; a null URL is an empty one;
control characters of a URL are percent-encoded; rows that repeat the smallest
page id are all responses; a row without page id revisits the smallest id
there is, or is a response; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_slices, salted_join, stage, text_column

FILE_BYTES = 64 << 20        # an archive file is closed beyond this size
RANGE_BYTES = 4 << 20        # one read covers at most this much, or one record
TASK_BYTES = 32 << 20        # archive bytes that a task reads at most, about
GAP_BYTES = 64 << 10         # records this near are read together
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, digest string, record_type string, refers_to bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    own = urn[len("<urn:page:"):-1]
    return int(own) if own else None


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, not compressed."""
    digest = _digest(payload)
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record, from its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size,
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"],
            "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


def with_duplicates(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, text (the payload) and first: the smallest page id of an equal payload, null for the only one."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("text")).withColumn("sha", F.unhex(F.sha1("text")))
    big = F.octet_length("text") >= min_bytes
    first = (rows.where(big).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"))
    return salted_join(rows, first, ["sha"], [F.col("page_id")]).withColumn("first", F.when(big, F.col("first")))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archives under ``path``/archive and the index under ``path``/index; path: a URI that all executors share."""
    rows = with_duplicates(pages, min_bytes).select("page_id", "url", "text", "first")

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(f"{root}/archive", recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for i, j in row_slices(text_column(batch)):
                index = []
                for r in batch.slice(i, j - i).to_pylist():
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/archive/{name}", compression=None)
                    payload = r["text"].encode()
                    revisit = r["first"] is not None and (r["page_id"] is None or r["page_id"] > r["first"])
                    to = r["first"] if revisit else None
                    member = gzip.compress(record_bytes(r["page_id"], r["url"], payload, to, revisit), 6, mtime=0)
                    out.write(member)
                    index.append({"page_id": r["page_id"], "file": name, "offset": at, "length": len(member), "url": r["url"],
                                  "digest": _digest(payload), "record_type": "revisit" if revisit else "response", "refers_to": to})
                    at += len(member)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pylist(index, schema=_schema(INDEX))
        if out is not None:
            out.close()

    rows.mapInArrow(run, INDEX).write.mode("errorifexists").parquet(f"{path}/index")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_records(selected: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """The records of selected index rows; neighbouring byte ranges are read together."""
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # by the bytes to read, as the index rows themselves are small; ranges of one task are read one after the other
    few = min(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    tasks = max(1, few, -(-total // TASK_BYTES))
    dealt = (selected.select("file", "offset", "length").withColumn("range", F.floor(F.col("offset") / RANGE_BYTES))
             .repartition(int(tasks), "file", "range").sortWithinPartitions("file", "offset"))
    schema = _schema(RECORDS)

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            files, offset, length = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            i = 0
            while i < len(files):
                j, end = i + 1, offset[i] + length[i]
                while (j < len(files) and files[j] == files[i] and offset[j] <= end + GAP_BYTES
                       and offset[j] + length[j] - offset[i] <= RANGE_BYTES):
                    end = max(end, offset[j] + length[j])
                    j += 1
                with store.open_input_file(f"{root}/archive/{files[i]}") as f:
                    raw = f.read_at(int(end - offset[i]), int(offset[i]))
                out = []
                for k in range(i, j):
                    a = int(offset[k] - offset[i])
                    rec = parse_record(zlib.decompress(raw[a:a + int(length[k])], 31))
                    if rec["payload"] is not None and _digest(rec["payload"]) != rec["payload_digest"]:
                        raise ValueError(f"damaged record at {files[i]}:{offset[k]}")
                    out.append(rec if payloads else rec | {"payload": None})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                i = j

    return dealt.mapInArrow(run, RECORDS)

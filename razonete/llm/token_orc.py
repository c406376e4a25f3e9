"""Token ids in ORC: range-ordered files, integer run-length encoding, row indexes and Bloom filters on the id.

Documents are range-partitioned and sorted by id, encoded by the tokenizers
library, and written by Spark's ORC writer: the ids column is a list of
integers (run-length encoding inside each stripe), every stripe carries row
indexes with minimum and maximum id, and a Bloom filter on the id. A reader
that asks for some ids skips stripes by these; stripes are read in parallel.
Each row also has its part number and its offset inside the part, so the
corpus-wide offset of a document needs only one total a part.

Defined cases: a null text is empty and has only the end id; a null id sorts
first; rows that share an id follow each other in the order of their texts;
an empty table gives an empty result; other columns of the input are ignored.
The strings of the tokenizer's special tokens become those tokens' ids, as the
library does by default.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bound_arrow_batches
from .common import doc_columns, row_slices, text_column
from .segments import SegmentEncoder

END_ID = 0
STRIPE_BYTES = 16 << 20
SLICE_BYTES = 1 << 20  # text that is encoded at once: its arrays are many times as large
ROW_INDEX_STRIDE = 1_000
ORC_SCHEMA = "doc_id bigint, part int, local_start bigint, n_tokens int, ids array<int>"
ODD_SPACE = regex.compile(r"\s")
_encoders: dict[str, MarkedEncoder] = {}


class MarkedEncoder:
    """Segments for ordinary texts; a text that holds a marker (an added token's string) is encoded in one piece."""

    def __init__(self, ids: Callable[[list[str]], list[bytes]], encode_new: Callable[[list[str]], list[bytes]], markers: list[str]):
        self.ids, self.markers, self.segments = ids, markers, SegmentEncoder(encode_new)

    def encode(self, text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        marked = np.zeros(len(text), bool)
        for m in self.markers:
            marked |= pc.match_substring(text, m).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self.segments.encode(text)
        flat, lengths = self.segments.encode(pc.if_else(pa.array(marked), pa.scalar("", pa.large_string()), text))
        parts = np.split(flat, np.cumsum(lengths)[:-1])
        at = np.flatnonzero(marked).tolist()
        for i, raw in zip(at, self.ids([text[i].as_py() for i in at])):
            parts[i] = np.frombuffer(raw, "<u4")
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


def _encoder(tokenizer_file: str) -> MarkedEncoder:
    """One encoder a worker process."""
    if tokenizer_file not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_file)
        newline = tok.encode("\n", add_special_tokens=False).ids

        def ids(texts: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        def encode_new(new: list[str]) -> list[bytes]:
            """Segments of a space and no other white space are encoded as lines of one text, which spares the
            library's cost a call; a line break is a piece (and an id) of its own there."""
            if len(newline) != 1:
                return ids(new)
            out = dict.fromkeys(new, b"")
            plain = [s for s in new if s[0] == " " and ODD_SPACE.search(s, 1) is None]
            for a in range(0, len(plain), 20_000):
                own = plain[a:a + 20_000]
                row = np.array(tok.encode_batch_fast(["\n".join(own)], add_special_tokens=False)[0].ids, "<u4")
                cut = np.flatnonzero(row == newline[0])
                if len(cut) != len(own) - 1:  # a tokenizer of another kind; the plain way then
                    out.update(zip(own, ids(own)))
                    continue
                raw = row.tobytes()
                begin, stop = [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(raw)]
                out.update(zip(own, [raw[s:e] for s, e in zip(begin, stop)]))
            rest = list(set(new).difference(plain))
            out.update(zip(rest, ids(rest)))
            return [out[s] for s in new]

        markers = [t.content for t in tok.get_added_tokens_decoder().values() if t.content]
        _encoders[tokenizer_file] = MarkedEncoder(ids, encode_new, markers)
    return _encoders[tokenizer_file]


def write_token_ids(docs: DataFrame, path: str, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text",
                    end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode every whole text, append ``end_id`` and write ORC files under ``path`` in ascending id order."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (doc_columns(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
            .withColumn("part", F.spark_partition_id()))

    def encode(batches: Iterable[pa.RecordBatch]):
        done = 0
        enc = _encoder(tokenizer_file)
        for batch in batches:
            text = text_column(batch)
            for i, j in row_slices(text, SLICE_BYTES):
                b = batch.slice(i, j - i)
                flat, lengths = enc.encode(text.slice(i, j - i))
                flat = np.insert(flat, np.cumsum(lengths), end_id)
                lengths = lengths + 1
                starts = done + np.concatenate([[0], np.cumsum(lengths)])
                done = int(starts[-1])
                values = pa.array(flat.astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(starts[:-1], pa.int64()), pa.array(lengths.astype(np.int32)), lists],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"])

    bound_arrow_batches(spark)
    (rows.mapInArrow(encode, ORC_SCHEMA).write.option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", "0.01").option("orc.stripe.size", str(STRIPE_BYTES))
     .option("orc.row.index.stride", str(ROW_INDEX_STRIDE)).option("compression", "zstd").mode("errorifexists").orc(path))


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; a filter on doc_id is pushed down to stripes and row groups."""
    return spark.read.schema(ORC_SCHEMA).orc(path)


def part_offsets(rows: DataFrame) -> DataFrame:
    """(part, part_start): ids in all earlier parts; one row a part, from the part totals."""
    totals = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    rows = read_token_ids(spark, path)

    def digest(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            lists = b.column(3)
            off = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:e]) for a, e in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    own = rows.select("doc_id", "part", "local_start", "ids").mapInArrow(
        digest, "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return own.join(part_offsets(rows.select("part", "n_tokens")), "part").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")

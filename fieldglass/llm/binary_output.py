"""Token-id output: length-delimited binary records with masked checksums, and an offset index beside each shard."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, work_path
from .pieces import UnitCodec, chunks

#: Fixed values of the format. A record is: length (8 bytes), masked CRC-32 of those 8 (4), payload, its masked CRC-32 (4).
#: A payload is: 1 if the id is null else 0 (1 byte), id (8), bytes of an id of a token (1), the token ids; all little-endian.
#: An index entry is: id null (1), id (8), offset of the record in its shard (8), tokens (8).
LENGTH, CRC, HEAD, ENTRY = "<Q", "<I", "<?qB", "<?qQQ"
MASK_DELTA = 0xA282EAD8
END_ID = 2


def masked(data: bytes) -> int:
    """CRC-32 turned right by 15 bits plus a constant, so that checksums of data that holds checksums stay sound."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack(LENGTH, len(payload))
    return b"".join((length, struct.pack(CRC, masked(length)), payload, struct.pack(CRC, masked(payload))))


def frames(read) -> Iterator[bytes]:
    """Payloads of a stream, each verified; read(n) gives up to n bytes."""
    while length := read(8):
        if len(length) < 8 or struct.unpack(CRC, read(4))[0] != masked(length):
            raise OSError("a record's length is damaged")
        payload = read(struct.unpack(LENGTH, length)[0])
        if struct.unpack(CRC, read(4))[0] != masked(payload):
            raise OSError("a record's payload is damaged")
        yield payload


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, doc, width = struct.unpack_from(HEAD, payload)
    return None if null else doc, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD))


def _opened(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def read_index(uri: str) -> list[tuple]:
    """(null, id, offset, n_tokens) of each record of the shard, for reads in any order."""
    fs, path = _opened(uri)
    with fs.open_input_stream(path + ".idx") as f:
        return list(struct.iter_unpack(ENTRY, f.read()))


def read_record(uri: str, offset: int) -> tuple[int | None, np.ndarray]:
    """The record at an offset from the index."""
    fs, path = _opened(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return unpack(next(frames(f.read)))


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[UnitCodec, int]:
    """Units of a byte-level BPE: single white space always starts a new word."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    width = 2 if max(tok.get_vocab_size(), END_ID + 1) <= 1 << 16 else 4
    pack = lambda texts: [array("H" if width == 2 else "I", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    starts = np.zeros(tok.get_vocab_size(), bool)
    starts[[i for t, i in tok.get_vocab().items() if t[0] == "\u0120"]] = True

    def rest(units: list[str]) -> list[bytes]:
        """Units after a space, in one text: a token that holds the space starts the next unit."""
        ids = np.array(tok.encode_batch_fast([" " + " ".join(units)], add_special_tokens=False)[0].ids, f"<u{width}")
        at = np.flatnonzero(starts[ids])
        if len(at) != len(units):
            return pack([" " + u for u in units])
        data, at = ids.tobytes(), [*(at * width).tolist(), len(ids) * width]
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    # texts that hold a token of the tokenizer's own list (such as an end mark) are encoded whole
    added = tuple(t.content for t in tok.get_added_tokens_decoder().values())
    return UnitCodec(f"<u{width}", pack, rest, pack, remember=400_000, avoid=added), width


def write_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes `docs` in ascending id order and returns the shards: uri, n_records, n_tokens, first id (null first).

    Texts are dealt by ranges of ids and sorted, so shards follow one another; each task encodes its texts chunk by chunk and
    streams records to one file. A task that is run again writes a new file; only the files in the returned table count.
    """
    folder = work_path(docs.sparkSession, "token-shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks fill the cores
        codec, width = encoder(tokenizer_path)
        end = int(end_id).to_bytes(width, "little")
        fs, base = _opened(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.rec"
        offset = n_records = n_tokens = 0
        first: list = []
        data = index = None
        try:
            for batch in batches:
                docs, at = batch.column(0).to_pylist(), 0
                for texts in chunks(batch.column(1)):
                    records, entries = [], []
                    ids, bounds = codec.encode(texts)
                    packed, bounds = ids.tobytes(), (bounds * width).tolist()
                    for doc, a, b in zip(docs[at : at + len(texts)], bounds[:-1], bounds[1:], strict=True):
                        n = (b - a) // width + 1
                        records.append(frame(b"".join((struct.pack(HEAD, doc is None, doc or 0, width), packed[a:b], end))))
                        entries.append(struct.pack(ENTRY, doc is None, doc or 0, offset, n))
                        offset, n_records, n_tokens = offset + len(records[-1]), n_records + 1, n_tokens + n
                        first = first or [doc]
                    if data is None:
                        data, index = fs.open_output_stream(f"{base}/{name}"), fs.open_output_stream(f"{base}/{name}.idx")
                    data.write(b"".join(records))
                    index.write(b"".join(entries))
                    at += len(texts)
        finally:
            for f in (data, index):
                if f is not None:
                    f.close()
        if n_records:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n_records]), pa.array([n_tokens]), pa.array(first, pa.int64())], names=["uri", "n_records", "n_tokens", "first"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return stored(ranged.mapInArrow(run, "uri string, n_records bigint, n_tokens bigint, first bigint"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record: `start` counts the ids of all records before, the checksum is that
    of the ids as unsigned 32-bit numbers. The shards' own totals give where each starts: a table of one row per file."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy(F.col("first").asc_nulls_first(), "uri").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.withColumn("start", before).select("uri", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, path = _opened(uri)
                rows: list[tuple] = []
                with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                    for payload in frames(f.read):
                        doc, ids = unpack(payload)
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return placed.repartition(max(1, shards.count()), "uri").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def tokens_on_disk(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, writes and reads back all of `docs`: a row per row.

    Null texts count as empty and are the end id alone. Null ids come first; rows that repeat an id are ordered by text.
    No rows give no files and no rows. Other columns are not read. Any damage to a record raises an error.
    """
    return read_shards(write_shards(docs, tokenizer_path, id_col, text_col))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens_on_disk(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

"""SentencePiece models run by the tokenizers library: read the model file, rebuild it, encode, decode and verify parity."""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import UnitCodec, chunks
from .shingles import give_back

MARKER = "▁"
#: Fixed values of the model format: piece types, and the model types of the trainer specification.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Units that a worker remembers in each of two generations, and bytes of text that it encodes at a time: a worker stays near 100 MB.
CACHED_UNITS, CHUNK_BYTES = 100_000, 1_000_000


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    model_type: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool
    escape_whitespaces: bool

    @property
    def splits_at_spaces(self) -> bool:
        """No piece joins a marker to what stands before it or holds a line feed, and no normaliser looks past white space."""
        return not self.charsmap and self.add_dummy_prefix and self.escape_whitespaces and not self.remove_extra_whitespaces and not any(MARKER in p.lstrip(MARKER) or " " in p or "\n" in p for p in self.pieces)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width and nested values stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 2, 5):
            n = 8 if kind == 1 else 4
            if kind == 2:
                n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} is not known")
        yield key >> 3, value


def parse(data: bytes) -> Model:
    pieces, scores, types = [], [], []
    trainer: dict = {}
    norm: dict = {}
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            pieces.append(p.get(1, b"").decode())
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            types.append(p.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            norm = dict(_fields(value))
    return Model(
        pieces, scores, types, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0),
        norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)),
    )


def build(model: Model):
    """A tokenizers.Tokenizer that does what the model says."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    if model.model_type == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), model.unk_id, model.byte_fallback)
    elif model.model_type == BPE:
        vocab = {p: i for i, p in enumerate(model.pieces)}
        merges = []
        for i, p in enumerate(model.pieces):
            if model.types[i] in (NORMAL, USER_DEFINED) and len(p) > 1:
                merges += [(-model.scores[i], i, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab]
        core = models.BPE(vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=model.pieces[model.unk_id], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type} has no counterpart")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    mark = MARKER if model.escape_whitespaces else " "
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(mark))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARKER))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoder(model)
    return out


def decoder(model: Model):
    from tokenizers import decoders

    tail = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    return decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])


class Codec:
    """Encoder and decoder of one model file, with the sentencepiece library beside it to verify parity."""

    def __init__(self, path: str, verify: bool = True):
        with open(path, "rb") as f:
            data = f.read()
        self.model = parse(data)
        # where units are cut at spaces the caller sets the dummy prefix, so that one tokenizer serves units with and without it
        self.own_prefix = not self.model.splits_at_spaces
        self.tokenizer = build(self.model if self.own_prefix else replace(self.model, add_dummy_prefix=False))
        if not self.own_prefix:
            self.tokenizer.decoder = decoder(self.model)
        self.sp = None
        if verify:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.differ: set[str] = set()
        self.units = UnitCodec("<i4", self._bare, self._packed, self._packed, marked=True, splits=self.model.splits_at_spaces, remember=CACHED_UNITS, avoid=(MARKER,))
        self.table = []
        for p, kind in zip(self.model.pieces, self.model.types, strict=True):
            self.table.append(bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARKER, " ").encode())

    def _packed(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with the dummy prefix; the same units come after spaces."""
        asked = texts if self.own_prefix else [MARKER + t if t else t for t in texts]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)]
        if self.sp is not None:
            self.differ.update(t for t, a, b in zip(texts, got, self.sp.encode(texts, num_threads=2), strict=True) if a != b)
        return [array("i", ids).tobytes() for ids in got]

    def _bare(self, units: list[str]) -> list[bytes]:
        """Ids of units at the start of a later line, which have no marker; parity is seen behind a line feed."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        if self.sp is not None:
            before = len(self.sp.encode("\n"))
            self.differ.update(u for u, a, b in zip(units, got, self.sp.encode(["\n" + u for u in units], num_threads=2), strict=True) if a != b[before:])
        return [array("i", ids).tobytes() for ids in got]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts."""
        return self.units.encode(texts)

    def parity(self, text: str) -> bool:
        """Whether sentencepiece gave the same ids for all that `text` was encoded from."""
        return not self.differ or (text not in self.differ and self.differ.isdisjoint(text.replace("\n", " ").split(" ")))

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.table.__getitem__, ids.tolist()))
        if self.model.add_dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode(errors="replace")


@lru_cache(maxsize=2)
def codec(path: str, verify: bool = True) -> Codec:
    """One codec a worker process: a model is read and rebuilt once."""
    return Codec(path, verify)


SCHEMA = "n_tokens bigint, ids array<int>, round_trip boolean, parity boolean"


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids, round_trip, parity.

    Each whole text (null: empty, which has no ids) is encoded by the rebuilt tokenizer, batches on all threads of the task's
    library, and decoded again; round_trip says whether the decoded text is the text (a text that holds the marker character
    itself comes back with a space instead), parity whether the sentencepiece library agrees on every unit. Rows and their
    order within a file stay, repeated rows and null ids too; other columns are not read. No rows give no rows. Narrow: there
    is no shuffle, and a lost executor costs its tasks only. Memory is bounded by chunks of texts, one whole text at least.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        own = codec(model_path, verify)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1), CHUNK_BYTES):
                ids, offsets = own.encode(texts)
                whole = texts.to_pylist()
                decoded = [own.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(np.diff(offsets).astype("i8")),
                        pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(ids, pa.int32())),
                        pa.array([a == b for a, b in zip(decoded, whole, strict=True)]),
                        pa.array([own.parity(t) for t in whole]),
                    ],
                    names=[id_col, "n_tokens", "ids", "round_trip", "parity"],
                )
                at += len(texts)
                give_back()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {SCHEMA}")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

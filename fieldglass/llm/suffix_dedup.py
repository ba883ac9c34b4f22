"""Removal of byte strings that an earlier document holds, by suffix arrays that a difference-cover algorithm sorts.

Any string of LEAST bytes holds an anchor: the smallest hash among its GRAM-byte strings. Equal strings have equal anchors, so
anchors deal the corpus out: a stretch of neighbouring start positions with one anchor is a segment, and all segments of an
anchor meet at one owner, which sorts the suffixes of its segments with the difference-cover algorithm. Anchors that only one
document has can't start a repeat and are left where they are; what travels is anchors once per block, then segments once per
block, so a passage of any frequency costs an owner one segment per block. Anchors that very many documents have, each in
other surroundings, are split: their segments are cut to single start positions, which are dealt by their 50 bytes.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored, text_or_empty, work_path
from .shingles import _power, mix

LEAST, GRAM = 50, 24
WINDOW = LEAST - GRAM + 1
#: Bytes of text in a block file, hashed at a time, and for each bucket of anchors and each owner of segments.
BLOCK_BYTES, CHUNK_BYTES, BUCKET_BYTES, OWNER_BYTES = 24 << 20, 1 << 20, 32 << 20, 2 << 20
#: Documents (counted block by block) from which an anchor's start positions are dealt one by one: their segments, 76 bytes mostly, could
#: take some times OWNER_BYTES. Single positions take many times the bytes of segments, so fewer documents don't split an anchor.
HOT_DOCS = 1 << 16
#: Bytes that are compared at a time.
COMPARED = 1 << 22
NO_DOC = np.iinfo("i8").max


# The difference-cover algorithm, on arrays.


def order3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of triples of non-negative numbers, and whether each, in that order, differs from the one before."""
    bits = [int(x.max(initial=0)).bit_length() for x in (a, b, c)]
    new = np.ones(len(a), bool)
    if sum(bits) < 64:
        key = a.astype("u8")
        for more, width in ((b, bits[1]), (c, bits[2])):
            key <<= np.uint64(width)
            key |= more.astype("u8")
        by = np.argsort(key, kind="stable")
        key = key[by]
        np.not_equal(key[1:], key[:-1], out=new[1:])
        return by, new
    by = np.lexsort((c, b, a))
    new[1:] = False
    for x in (a, b, c):
        x = x[by]
        new[1:] |= x[1:] != x[:-1]
    return by, new


def suffix_order(s: np.ndarray, depth: int, width: int = 1) -> np.ndarray:
    """Start positions of s in the order of its suffixes, at least by their first `depth` bytes; a symbol stands for `width` bytes.

    Suffixes at positions 1 and 2 modulo 3 are named by the order of their triples; where names repeat and triples don't reach
    `depth` yet, the string of names is sorted first by the same algorithm. The other suffixes are sorted by a symbol and the
    rank that follows, and merged in by counting the sampled suffixes below each. Numbers take four bytes where they fit, and
    nothing but the symbols and their names is held while the names are sorted.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), "i8")
    kind = "i4" if max(n, int(s.max())) < 2**31 - 8 else "i8"
    t = np.zeros(n + 3, kind)  # below every symbol: the end
    t[:n] = s
    t[:n] += 1
    places = lambda: np.concatenate((np.arange(1, n + (n % 3 == 1), 3, dtype=kind), np.arange(2, n, 3, dtype=kind)))
    sample = places()
    by, new = order3(t[sample], t[sample + 1], t[sample + 2])
    del sample
    names = np.empty(len(by), kind)
    names[by] = np.cumsum(new, dtype=kind)
    if not new.all() and 3 * width < depth:
        del by, new
        by = suffix_order(names, depth, 3 * width)
        names[by] = np.arange(1, len(by) + 1, dtype=kind)
    sample = places()
    rank = np.zeros(n + 3, kind)
    rank[sample] = names
    sampled = sample[by]
    del by, names, sample
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3, dtype=kind)
    zeros = zeros[order3(t[zeros], rank[zeros + 1], np.zeros(len(zeros), "u1"))[0]]
    shift = np.int64(int(rank.max()) + 1)
    below = np.zeros(len(zeros), kind)
    for r in (1, 2):
        other = sampled[sampled % 3 == r]
        if r == 1:
            keys, asked = t[other] * shift + rank[other + 1], t[zeros] * shift + rank[zeros + 1]
        else:
            top = np.int64(int(t.max()) + 1)
            keys, asked = (t[i] * top + t[i + 1] for i in (other, zeros))
            if int(top) ** 2 * int(shift) >= 1 << 63:
                both = np.unique(np.concatenate((keys, asked)), return_inverse=True)[1]
                keys, asked = both[: len(other)], both[len(other) :]
                del both
            keys, asked = keys * shift + rank[other + 2], asked * shift + rank[zeros + 2]
        keys.sort()
        below += np.searchsorted(keys, asked, "left").astype(kind)
        del keys, asked, other
    # suffixes equal up to `depth` may be ranked in any order, and so may be counted in any: only among them can this move one
    below = np.maximum.accumulate(below)
    out = np.empty(n, kind)
    at = below + np.arange(len(zeros), dtype=kind)
    out[at] = zeros
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sampled
    return out


def first_holders(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For segments data[starts[i]:starts[i] + lengths[i]], each with a 0 after it: per start position of a whole string of
    LEAST bytes, in order, the smallest document whose segment holds that string."""
    sa = suffix_order(data, LEAST)
    text = np.concatenate((data, np.zeros(LEAST + 8, data.dtype)))
    counts = lengths - LEAST + 1
    kind = sa.dtype
    segment = np.repeat(np.arange(len(starts), dtype=kind), counts)
    position = np.arange(len(segment), dtype=kind) + np.repeat((starts - np.cumsum(counts) + counts).astype(kind), counts)
    holder = np.full(len(data), -1, kind)
    holder[position] = np.arange(len(position), dtype=kind)
    order = holder[sa]
    del sa, holder
    order = order[order >= 0]
    at = position[order]
    # adjacent prefixes: seven 8-byte words cover the 50 bytes
    raw = (text - (text > 0)).astype("u1")
    del text
    word = np.zeros(len(raw) - 7, "u8")
    for low in range(0, len(word), COMPARED):
        part = word[low : low + COMPARED]
        for k in range(8):
            part |= raw[low + k : low + k + len(part)].astype("u8") << np.uint64(8 * k)
    same = np.ones(max(0, len(at) - 1), bool)
    for k in (0, 8, 16, 24, 32, 40, LEAST - 8):
        w = word[at + k]
        same &= w[1:] == w[:-1]
    heads = np.flatnonzero(np.concatenate(([True], ~same))) if len(at) else np.empty(0, "i8")
    least = np.minimum.reduceat(docs[segment[order]], heads) if len(at) else np.empty(0, "i8")
    out = np.empty(len(position), "i8")
    out[order] = np.repeat(least, np.diff(np.concatenate((heads, [len(at)]))))
    return out


# Anchors and segments of texts.


def chunked(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= CHUNK_BYTES:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of texts: (data, totals, text, start, stop, anchor) of the segments: maximal ranges start..stop of start
    positions in the chunk's data with one anchor, and the text each is in. totals: prefix sums for hashes of strings."""
    for at, to in chunked(texts):
        part = texts[at:to]
        data = np.frombuffer(b"".join(part), "u1")
        n = len(data)
        power, inverse = _power(n + 1)
        total = np.concatenate((np.zeros(1, "u8"), np.cumsum((data.astype("u8") + np.uint64(1)) * power[:n], dtype="u8")))
        if n < LEAST:
            continue
        low = (total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1]
        low = (low ^ (low >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        have = 1
        while have * 2 <= WINDOW:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < WINDOW:
            low = np.minimum(low[: len(low) - (WINDOW - have)], low[WINDOW - have :])
        text = np.repeat(np.arange(len(part)), [len(t) for t in part])
        whole = text[: len(low)] == text[LEAST - 1 :]
        edge = whole.copy()
        edge[1:] &= (low[1:] != low[:-1]) | ~whole[:-1]
        start = np.flatnonzero(edge)
        last = whole.copy()
        last[:-1] &= (low[1:] != low[:-1]) | ~whole[1:]
        stop = np.flatnonzero(last)
        yield data, total, text[start] + at, start, stop, low[start]


def segment_keys(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the segments' bytes."""
    _, inverse = _power(len(total))
    end = stop + LEAST
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype("u8") * np.uint64(0xD6E8FEB86659FD93))


def equal_ranges(raw: np.ndarray, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether raw[a[i]:a[i] + size_a[i]] and raw[b[i]:b[i] + size_b[i]] are the same bytes."""
    out = size_a == size_b
    asked = np.flatnonzero(out & (a != b))
    ends = np.cumsum(size_a[asked])
    at = 0
    while at < len(asked):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right")))
        own = asked[at:to]
        size = size_a[own]
        first = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(first, size)
        out[own] = ~np.logical_or.reduceat(raw[np.repeat(a[own], size) + inner] != raw[np.repeat(b[own], size) + inner], first)
        at = to
    return out


class Names:
    """Names of byte strings of `raw`: their hashes, but where two different strings share one, the later gets another name. So
    equal names mean equal bytes; the same calls give the same names again."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.seen, self.at, self.size = np.empty(0, "u8"), np.empty(0, "i8"), np.empty(0, "i8")

    def of(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(names, whether a string is the first with its name) of raw[begin[i]:begin[i] + size[i]] with hashes `keys`."""
        names, new, todo = keys.copy(), np.zeros(len(keys), bool), np.arange(len(keys))
        while len(todo):
            found, first, which = np.unique(names[todo], return_index=True, return_inverse=True)
            j = np.searchsorted(self.seen, found)
            known = np.zeros(len(found), bool)
            if len(self.seen):
                known = (j < len(self.seen)) & (self.seen[np.minimum(j, len(self.seen) - 1)] == found)
            at, length = begin[todo[first]], size[todo[first]]
            at[known], length[known] = self.at[j[known]], self.size[j[known]]
            new[todo[first[~known]]] = True
            self.seen, self.at, self.size = (np.insert(old, j[~known], more[~known]) for old, more in ((self.seen, found), (self.at, at), (self.size, length)))
            todo = todo[~equal_ranges(self.raw, begin[todo], size[todo], at[which], length[which])]
            names[todo] = mix(names[todo] + np.uint64(0x9E3779B97F4A7C15))
        return names, new


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def named_segments(texts: list[bytes], common: np.ndarray, hot: np.ndarray) -> Iterator[tuple]:
    """For chunks of texts: (first text, text after the last, data, text, start, stop, names, new, dealing) of the segments at the
    sorted anchors `common`. Segments at `hot` anchors are cut to single start positions. dealing: the hash that deals them out,
    the anchor's or, of single positions, that of their bytes."""
    offset = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype("i8")
    names = Names(np.frombuffer(b"".join(texts), "u1"))
    parts = [(lo, hi) for lo, hi in chunked(texts) if offset[hi] - offset[lo] >= LEAST]
    for (lo, hi), (data, total, text, start, stop, anchor) in zip(parts, runs(texts), strict=True):
        ok = _among(anchor, common)
        text, start, stop, anchor = text[ok], start[ok], stop[ok], anchor[ok]
        single = _among(anchor, hot)
        if single.any():
            count = np.where(single, stop - start + 1, 1)
            row = np.repeat(np.arange(len(start)), count)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            text, anchor, single = text[row], anchor[row], single[row]
            start, stop = start[row] + inner, np.where(single, start[row] + inner, stop[row])
        keys = segment_keys(total, start, stop)
        own, new = names.of(keys, offset[lo] + start, stop + LEAST - start)
        yield lo, hi, data, text, start, stop, own, new, np.where(single, keys, anchor)


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _read_block(uri: str) -> tuple[list[bytes], np.ndarray]:
    fs, path = _fs(uri)
    with fs.open_input_file(path) as f:
        table = pa.ipc.open_file(f).read_all()
    return table.column("text").to_pylist(), table.column("id").to_numpy()


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int64()), ("uri", pa.string()), ("once", pa.binary()), ("more", pa.binary()), ("docs", pa.binary())])
_COMMON = pa.schema([("uri", pa.string()), ("anchors", pa.binary()), ("hot", pa.binary())])
_SEGMENTS = pa.schema([("owner", pa.int64()), ("uri", pa.string()), ("keys", pa.binary()), ("docs", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])
_HOLDERS = pa.schema([("uri", pa.string()), ("keys", pa.binary()), ("n_runs", pa.binary()), ("runs", pa.binary()), ("holders", pa.binary())])
_FOUND = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_DDL = {
    "anchors": "bucket bigint, uri string, once binary, more binary, docs binary",
    "common": "uri string, anchors binary, hot binary",
    "segments": "owner bigint, uri string, keys binary, docs binary, lengths binary, data binary",
    "holders": "uri string, keys binary, n_runs binary, runs binary, holders binary",
    "found": "id bigint, sha string, n_removed bigint, n_spans bigint, kept_sha256 string",
}


def _u8(x) -> np.ndarray:
    return np.frombuffer(x, "u8")


def _cat(table: pa.Table, name: str, kind: str) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def block_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors that one document of the block has, those that more have, and how many have each of these."""
    found = []
    for _, _, text, _, _, anchor in runs(texts):
        order = np.lexsort((anchor, text))
        anchor, text = anchor[order], text[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        found.append(anchor[new])
    values, counts = np.unique(np.concatenate(found) if found else np.empty(0, "u8"), return_counts=True)
    return values[counts == 1], values[counts > 1], counts[counts > 1].astype("u4")


def by_bucket(buckets: int, once: np.ndarray, more: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """The anchors of a block by bucket, for the buckets that get any."""
    parts = []
    for values, *others in ((once,), (more, docs)):
        of = values % np.uint64(buckets)
        order = np.argsort(of, kind="stable")
        parts.append((of[order], [x[order] for x in (values, *others)]))
    for k in np.unique(np.concatenate([of for of, _ in parts])):
        cut = lambda of, x: x[np.searchsorted(of, k) : np.searchsorted(of, k, "right")].tobytes()  # noqa: B023, E731
        yield int(k), cut(parts[0][0], parts[0][1][0]), cut(parts[1][0], parts[1][1][0]), cut(parts[1][0], parts[1][1][1])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_docs: int = HOT_DOCS) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes (null: empty). A byte goes if a string of LEAST bytes that covers it also starts in a document with a
    smaller id. Exact copies of an earlier text are settled by their hash: all of their bytes go if there are LEAST. Of the
    other texts,
    1. a pass writes block files of texts to the shared folder and deals their anchors out by value;
    2. buckets of anchors tell each block which of its anchors other documents share;
    3. blocks deal the segments at those anchors to owners, equal segments of a block once with their smallest document;
    4. owners sort suffixes, compare adjacent prefixes, and answer each block with the first holder of every string;
    5. blocks mark covered bytes and digest what is left.

    Rows that share an id are documents of one number, none smaller than the other. A null id is larger than any. Texts below
    LEAST bytes stay whole. No rows give no rows. Other columns are not read. Tasks that run again write new block files; only
    files named in the stored table of anchors count.
    """
    spark = docs.sparkSession
    folder = work_path(spark, "text-blocks")
    text = text_or_empty(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_DOC))).alias("id"), F.col(id_col).alias("own_id"), text.alias("text"))
    entries = stored(rows.select("id", "own_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("h")), "texts")
    first = stored(entries.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("sha", "first"), "first")
    placed = stored(entries.join(sized(first), "sha", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("id"), F.lit(False))).drop("first"), "placed")
    copies = stored(placed.where("copy").select(F.col("id").alias("copy_id"), F.col("h").alias("copy_h")), "copies")
    bytes_all = placed.where("NOT copy").agg(F.sum("n_bytes")).head()[0] or 0
    buckets, owners = max(1, math.ceil(bytes_all / BUCKET_BYTES)), max(1, math.ceil(bytes_all / OWNER_BYTES))

    def write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        ids: list[int] = []
        size = 0

        def done() -> pa.RecordBatch:
            fs, base = _fs(folder)
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.arrow"
            table = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
            with fs.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table, max_chunksize=1000)
            return _packed([(k, f"{folder}/{name}", *rest) for k, *rest in by_bucket(buckets, *block_anchors(texts))], _ANCHORS)

        for batch in batches:
            for doc, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                texts.append(t)
                ids.append(doc)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield done()
                    texts, ids, size = [], [], 0
        if texts:
            yield done()

    def shared(table: pa.Table) -> pa.Table:
        own = [(u, _u8(a), _u8(b)) for u, a, b in zip(table.column("uri").to_pylist(), table.column("once").to_pylist(), table.column("more").to_pylist(), strict=True)]
        every = np.concatenate([x for _, a, b in own for x in (a, b)])
        docs_of = np.concatenate([x for (_, a, _), d in zip(own, table.column("docs").to_pylist(), strict=True) for x in (np.ones(len(a), "i8"), np.frombuffer(d, "u4").astype("i8"))])
        order = np.argsort(every, kind="stable")
        every = every[order]
        heads = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        sums = np.add.reduceat(docs_of[order], heads)
        values, hot = every[heads][sums > 1], every[heads][sums >= hot_docs]
        rows = [(u, x[_among(x, values)].tobytes(), x[_among(x, hot)].tobytes()) for u, x in ((u, np.concatenate((a, b))) for u, a, b in own)]
        return pa.Table.from_batches([_packed([r for r in rows if r[1]], _COMMON)])

    def deal(key: tuple, table: pa.Table) -> pa.Table:
        uri = key[0].as_py()
        texts, ids = _read_block(uri)
        rising = np.argsort(ids, kind="stable")  # so that the first of equal segments has the smallest document
        texts, ids = [texts[i] for i in rising], ids[rising]
        rows = []
        for lo, _, data, text, start, stop, names, new, dealing in named_segments(texts, np.sort(_cat(table, "anchors", "u8")), np.sort(_cat(table, "hot", "u8"))):
            keys, ok, owner = names[new], np.flatnonzero(new), (dealing[new] >> np.uint64(20)) % np.uint64(owners)
            by = np.argsort(owner, kind="stable")
            keys, ok, owner = keys[by], ok[by], owner[by]
            lengths = stop[ok] + LEAST - start[ok]
            ends = np.cumsum(lengths)
            piled = data[np.repeat(start[ok] - (ends - lengths), lengths) + np.arange(lengths.sum())].tobytes()
            doc = ids[text[ok]]
            edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))).tolist() if len(owner) else []
            for i, j in zip(edges, [*edges[1:], len(owner)], strict=True):
                low = int(ends[i] - lengths[i])
                rows.append((int(owner[i]), uri, keys[i:j].tobytes(), doc[i:j].tobytes(), lengths[i:j].astype("u4").tobytes(), piled[low : int(ends[j - 1])]))
        return pa.Table.from_batches([_packed(rows, _SEGMENTS)])

    def sort_owner(table: pa.Table) -> pa.Table:
        uris = table.column("uri").to_pylist()
        per_uri = [_u8(x) for x in table.column("keys").to_pylist()]
        doc, lengths, data = _cat(table, "docs", "i8"), _cat(table, "lengths", "u4").astype("i8"), _cat(table, "data", "u1")
        begin = np.cumsum(lengths) - lengths
        keys, _ = Names(data).of(np.concatenate(per_uri), begin, lengths)  # blocks may have named different segments alike
        by = np.lexsort((doc, keys))
        one = by[np.concatenate(([True], keys[by][1:] != keys[by][:-1]))]  # different segments, the smallest document of each
        names, size, docs_of = keys[one], lengths[one], doc[one]
        starts = np.cumsum(size + 1) - size - 1
        joined = np.zeros(int((size + 1).sum()), "u2")
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(starts, size) + inner] = data[np.repeat(begin[one], size) + inner].astype("u2") + 1
        holders = first_holders(joined, starts, size, docs_of)
        counts = size - LEAST + 1
        offset = np.cumsum(counts) - counts
        # neighbouring strings mostly have one holder: runs of holders travel
        head = np.ones(len(holders), bool)
        head[1:] = holders[1:] != holders[:-1]
        head[offset] = True
        run_at = np.flatnonzero(head)
        run_len = np.diff(np.concatenate((run_at, [len(holders)]))).astype("u4")
        first_run = np.searchsorted(run_at, offset)
        n_runs = np.diff(np.concatenate((first_run, [len(run_at)])))
        rows, at = [], 0
        for uri, own in zip(uris, per_uri, strict=True):
            k = np.searchsorted(names, keys[at : at + len(own)])
            at += len(own)
            pick = np.repeat(first_run[k] - (np.cumsum(n_runs[k]) - n_runs[k]), n_runs[k]) + np.arange(n_runs[k].sum())
            rows.append((uri, own.tobytes(), n_runs[k].astype("u4").tobytes(), run_len[pick].tobytes(), holders[run_at[pick]].tobytes()))
        return pa.Table.from_batches([_packed(rows, _HOLDERS)])

    def mark(key: tuple, table: pa.Table, at: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([_packed([], _FOUND)])
        texts, ids = _read_block(key[0].as_py())
        rising = np.argsort(ids, kind="stable")  # the order in which deal() named segments
        texts, ids = [texts[i] for i in rising], ids[rising]
        keys, n_runs, run_len, holder = _cat(table, "keys", "u8"), _cat(table, "n_runs", "u4").astype("i8"), _cat(table, "runs", "u4").astype("i8"), _cat(table, "holders", "i8")
        first_run = np.cumsum(n_runs) - n_runs
        by = np.argsort(keys)
        keys = keys[by]
        rows = []
        for lo, hi, data, text, start, _, k, _, _ in named_segments(texts, np.sort(_cat(at, "anchors", "u8")), np.sort(_cat(at, "hot", "u8"))):
            j = np.searchsorted(keys, k)
            ok = np.flatnonzero((j < len(keys)) & (keys[np.minimum(j, len(keys) - 1)] == k)) if len(keys) else np.empty(0, "i8")
            own = by[j[ok]]
            n = n_runs[own]
            pick = np.repeat(first_run[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            segment = np.repeat(ok, n)
            size = run_len[pick]
            # where each run of holders starts within its segment
            before = np.cumsum(size) - size
            begin = start[segment] + before - np.repeat(before[np.cumsum(n) - n], n) if len(size) else before
            gone = holder[pick] < ids[text[segment]]
            delta = np.zeros(len(data) + 2, "i8")
            np.add.at(delta, begin[gone], 1)
            np.add.at(delta, (begin + size + LEAST - 1)[gone], -1)
            covered = np.cumsum(delta)[: len(data)] > 0
            ends = np.cumsum([len(t) for t in texts[lo:hi]])
            for i in np.unique(text[segment[gone]]):
                b, e = int(ends[i - lo] - len(texts[i])), int(ends[i - lo])
                c = covered[b:e]
                spans = int(c[0]) + int(np.count_nonzero(c[1:] & ~c[:-1]))
                kept = np.frombuffer(texts[i], "u1")[~c].tobytes()
                rows.append((int(ids[i]), hashlib.sha256(texts[i]).hexdigest(), int(c.sum()), spans, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_batches([_packed(rows, _FOUND)])

    lone = rows.join(sized(copies), (F.col("id") == F.col("copy_id")) & (F.xxhash64("text") == F.col("copy_h")), "left_anti").where(F.octet_length("text") >= LEAST)
    anchors = stored(lone.select("id", "text").mapInArrow(write_blocks, _DDL["anchors"]), "anchors")
    common = stored(anchors.groupBy("bucket").applyInArrow(shared, _DDL["common"]), "common-anchors")
    segments = common.groupBy("uri").applyInArrow(deal, _DDL["segments"])
    holders = segments.groupBy("owner").applyInArrow(sort_owner, _DDL["holders"])
    found = stored(holders.groupBy("uri").cogroup(common.groupBy("uri")).applyInArrow(mark, _DDL["found"]).distinct(), "removed")
    found = found.withColumnRenamed("id", "found_id").withColumnRenamed("sha", "found_sha")
    out = placed.join(sized(found), (F.col("id") == F.col("found_id")) & (F.col("sha") == F.col("found_sha")), "left")
    whole = F.col("copy") & (F.col("n_bytes") >= LEAST)
    return out.select(
        F.col("own_id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

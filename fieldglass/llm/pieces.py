"""Encoding of texts unit by unit, for tokenizers that never join characters across the start of a spaced word or a line."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a worker remembers in each of two generations, if not told otherwise, and bytes of text that it splits at a time.
CACHED_UNITS = 150_000
CHUNK_BYTES = 2_000_000
#: Units that the tokenizer gets at a time: its records of a unit are far larger than the ids.
UNITS_AT_A_TIME = 5_000

#: White space of Unicode. Where two such characters meet, or at an end of a text, units can't be told apart.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_SPACE}{_SPACE}|\A{_SPACE}|{_SPACE}\z|\A\z"


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Runs of whole texts of about `most` bytes, null as empty; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="i8")
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield pc.fill_null(texts.slice(at, to - at), "").cast(pa.large_string())
        at = to


class UnitCodec:
    """Encodes whole texts unit by unit, each different unit once as long as it is remembered.

    Units end at single spaces and line feeds. A unit after a space takes the space along; one that starts a line doesn't.
    Texts with other runs of white space go to the tokenizer whole, and so does every text if `splits` is false. `rest` encodes
    units after a space, `first` units at a line's start, `whole` texts: lists of strings to lists of packed ids of `kind`. A
    text's very first unit is taken as one after a space if `marked`. Texts that hold a string of `avoid` go whole too.
    """

    def __init__(self, kind: str, first: Callable, rest: Callable, whole: Callable, marked: bool = False, splits: bool = True, remember: int = CACHED_UNITS, avoid: tuple[str, ...] = ()):
        self.kind, self.first, self.rest, self.whole, self.marked, self.splits = np.dtype(kind), first, rest, whole, marked, splits
        self.remember, self.avoid = remember, avoid
        self.line_feed = whole(["x\n"])[0][len(whole(["x"])[0]) :] if splits else b""
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _look_up(self, units: list[str]) -> list[bytes]:
        """Packed ids of units; those that start a line have the line feed in front."""
        if len(self.known) > self.remember:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        found = list(map(known.get, units))
        new = []
        for u in [u for u, v in zip(units, found, strict=True) if v is None]:
            if (v := old.get(u)) is None:
                new.append(u)
            else:
                known[u] = v
        spaced = [u for u in new if u[:1] != "\n"]
        lines = [u for u in new if u[:1] == "\n"]
        for at in range(0, len(spaced), UNITS_AT_A_TIME):
            part = spaced[at : at + UNITS_AT_A_TIME]
            known.update(zip(part, self.rest(part), strict=True))
        for at in range(0, len(lines), UNITS_AT_A_TIME):
            part = lines[at : at + UNITS_AT_A_TIME]
            known.update((u, self.line_feed + v) for u, v in zip(part, self.first([u[1:] for u in part]), strict=True))
        return list(map(known.__getitem__, units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.splits else np.ones(len(texts), bool)
        for what in self.avoid if self.splits else ():
            odd = odd | pc.match_substring(texts, what).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        # a line's start is a unit that begins with its line feed
        cut = pc.replace_substring(plain, "\n", " \n")
        if not self.marked:
            cut = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), cut, pa.scalar("", pa.large_string()))
        listed = pc.split_pattern(cut, " ")
        words = listed.flatten().dictionary_encode()
        packed = self._look_up(words.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(packed), self.kind)
        sizes = np.fromiter(map(len, packed), "i8", len(packed)) // self.kind.itemsize
        starts = np.cumsum(sizes) - sizes
        index = words.indices.to_numpy()
        size = sizes[index]
        ends = np.cumsum(size)
        ids = flat[np.repeat(starts[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        first_word = listed.offsets.to_numpy() - listed.offsets[0].as_py()
        bounds = np.concatenate(([0], ends))[first_word]
        if not self.marked:  # the text's own first unit has no line feed
            feed = len(self.line_feed) // self.kind.itemsize
            keep = np.ones(len(ids), bool)
            for k in range(feed):
                keep[bounds[:-1] + k] = False
            ids = ids[keep]
            bounds = bounds - feed * np.arange(len(bounds))
        if not odd.any():
            return ids, bounds
        whole = iter(self.whole(texts.filter(pa.array(odd)).to_pylist()))
        parts, at = [], 0
        for is_odd in odd:
            if is_odd:
                parts.append(np.frombuffer(next(whole), self.kind))
            else:
                parts.append(ids[bounds[at] : bounds[at + 1]])
                at += 1
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

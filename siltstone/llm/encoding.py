"""Encoding with a public byte-level vocabulary.

Two neighbouring bytes that occur side by side inside no vocabulary token can
never be merged, so a cut between them is certain as far as merges go. The
pre-token pattern must read both sides the same way, too: a text may be cut
before any character, also within a run of letters, of digits or of other
signs, unless the character before the cut is white space (it may belong to
what follows) or the cut stands at an apostrophe that might begin or join a
contraction. The fragments are encoded independently, each distinct one once
per worker, and their ids are concatenated.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..runtime import tokenizer_dir

#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A worker forgets its encoded fragments beyond so many bytes of text and ids; longer fragments than LONG aren't kept.
MEMO_BYTES = 96 << 20
LONG = 256


class FragmentEncoder:
    """Encodes texts fragment by fragment; fragments seen before are looked up."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), bool)
        for t in ranks:
            b = np.frombuffer(t, np.uint8)
            inside[b[:-1], b[1:]] = True
        self.certain = ~inside
        self.cut = self.certain & _readable()
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.size, self.held = array("i"), array("q"), 0

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Positions of bytes before which a text is cut."""
        at = np.flatnonzero(self.cut[b[:-1], b[1:]])
        if len(at) and (b[at] >= 0x80).any():  # white space of several bytes stays with what follows
            p, q, r = b[np.maximum(at - 2, 0)], b[np.maximum(at - 1, 0)], b[at]
            wide = (p == 0xE2) & (((q == 0x80) & ((r <= 0x8A) | (r == 0xA8) | (r == 0xA9) | (r == 0xAF))) | ((q == 0x81) & (r == 0x9F)))
            wide |= ((p == 0xE3) & (q == 0x80) & (r == 0x80)) | ((p == 0xE1) & (q == 0x9A) & (r == 0x80)) | ((q == 0xC2) & ((r == 0x85) | (r == 0xA0)))
            at = at[~(wide & (r >= 0x80))]
        return at + 1

    def fragments(self, raw: bytes) -> list[bytes]:
        if len(raw) < 2:
            return [raw] if raw else []
        at = self.cuts(np.frombuffer(raw, np.uint8)).tolist()
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])]

    def _add(self, fragment: bytes) -> int:
        ids = self.plain.encode_ordinary(fragment.decode("utf-8", "surrogatepass"))
        k = len(self.size)
        self.flat.extend(ids)
        self.size.append(len(ids))
        self.held += len(fragment) + 4 * len(ids) + 100
        if len(fragment) <= LONG:
            self.index[fragment] = k
        return k

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has); null and empty texts have none."""
        if self.held > MEMO_BYTES:
            self._reset()
        known = self.index.get
        which: list[int] = []
        per_text: list[int] = []
        for t in texts:
            frags = self.fragments(t.encode("utf-8", "surrogatepass")) if t else []
            for f in frags:
                k = known(f)
                which.append(self._add(f) if k is None else k)
            per_text.append(len(frags))
        size = np.array(self.size, np.int64)
        flat = np.array(self.flat, np.int32)
        start = np.cumsum(size) - size
        w = np.asarray(which, np.int64)
        n = size[w]
        out = flat[np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(np.asarray(per_text, np.int64)))]
        return out, np.diff(ends)


def _readable() -> np.ndarray:
    """Pairs of bytes between which the pre-token pattern reads both sides as it reads the whole."""
    code = np.arange(256)
    blank = np.isin(code, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
    inside = (code >= 0x80) & (code < 0xC0)  # a byte within a character
    letter = ((code | 32) >= 97) & ((code | 32) <= 122)
    digit = (code >= 48) & (code <= 57)
    quote = code == 39
    ok = ~blank[:, None] & ~inside[None, :]
    ok &= ~(quote[None, :] & ~(letter | digit)[:, None])  # whether it begins a contraction depends on what is before
    ok &= ~(quote[:, None] & (letter | (code >= 0x80))[None, :])
    return ok


_encoders: dict[str, FragmentEncoder] = {}


def encoder(path: str) -> FragmentEncoder:
    """The encoder of a vocabulary file, one per worker process."""
    if path not in _encoders:
        _encoders[path] = FragmentEncoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """Parts of a batch with bounded text, so long texts don't pile up."""
    size = np.cumsum(np.asarray(pc.binary_length(batch.column(1)).fill_null(0)))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, ids: the token ids of every text, without special tokens.

    Empty and null texts give the empty list. One row per input row; other
    columns are dropped.
    """
    path = f"{tokenizer_dir(docs.sparkSession)}/{VOCABULARY}"

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for b in _slices(batch):
                ids, n = enc.encode(b.column(1).to_pylist())
                ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(ids))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def text_sizes(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys`, n_tokens: the size of every text in tokens."""
    path = f"{tokenizer_dir(docs.sparkSession)}/{VOCABULARY}"

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for b in _slices(batch):
                _, n = enc.encode(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), pa.array(n)], [*keys, "n_tokens"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(F.struct(*keys).alias("k"), F.col(text).cast("string")).mapInArrow(run, f"{kinds}, n_tokens bigint")

"""Token ids by a public tokenizer, packed in Simple-8b words of 64 bits.

Ids are cut into blocks of ``BLOCK``.  The top 4 bits of a word select how many values it packs
in its other 60 bits, from the most to the fewest, the first value lowest (120 zeros take no
bits).  A value of over 60 bits is an escape: a word of selector 0, then the value as it is.
Each block starts a word of its own, and the last word of a block is padded with zeros; the
blocks' offsets, in words, are kept, so that blocks decode side by side.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import long_id
from .textkit import list_array, pieces, ragged, strings

BLOCK = 128
#: By selector: values in a word, and bits of each.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_SMALL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Characters from which on ``regex`` splits a text: the engine of ``tiktoken`` keeps a state for each character of a
#: run of white space, and panics at a million.
LONG = 500_000


class Encoder:
    """The byte-pair encoder of a rank file's content, for texts of any length."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.pairs = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(pattern).finditer

    def encode_ordinary(self, text: str) -> list[int]:
        if len(text) < LONG:
            return self.pairs.encode_ordinary(text)
        return [x for piece in self.split(text) for x in self.pairs._encode_single_piece(piece[0])]


def encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


def encode(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all segments of ``values``, the segments' offsets in them; block offsets (within a
    segment, in words), and the segments' offsets in those."""
    values = np.ascontiguousarray(values, np.uint64)
    size = np.diff(off)
    blocks = -(-size // BLOCK)
    block_off = np.concatenate([[0], np.cumsum(blocks)])
    n = int(block_off[-1])
    nth = ragged(blocks)
    seg = np.repeat(np.arange(len(size)), blocks)
    length = np.minimum(size[seg] - nth * BLOCK, BLOCK)
    v = np.zeros((n, BLOCK), np.uint64)
    v[np.repeat(np.arange(n), length), ragged(length)] = values[off[0] : off[-1]]
    # Position by position (rows), all blocks side by side (columns).
    width = np.ascontiguousarray(_widths(v).T)
    most = int(width.max(initial=0))
    fits = int(np.flatnonzero(BITS[1:] >= most)[0]) + 1 if most <= 60 else 0
    best = np.full((BLOCK, n), fits or 255, np.uint8)
    for s in range(15 if most > 60 else fits - 1, 0, -1):
        ok = width <= BITS[s]
        if not ok.any():
            break
        one = ok.view(np.uint8)
        run, tag, full, here = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.ones(n, bool), np.zeros(n, bool)
        for i in range(BLOCK - 1, -1, -1):  # run: fitting values from here on; full: up to the end
            np.add(run, 1, out=run)
            np.multiply(run, one[i], out=run)
            np.logical_and(full, ok[i], out=full)
            np.greater_equal(run, int(COUNT[s]), out=here)
            np.logical_or(here, full, out=here)
            np.subtract(here.view(np.uint8), 1, out=tag)  # 0 where it may be s, else 255
            np.bitwise_or(tag, s, out=tag)
            np.minimum(best[i], tag, out=best[i])
    best[best == 255] = 0
    at, used, live, taken = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), []
    while len(live):
        s = best[at[live], live]
        taken.append((live, at[live], s, used[live]))
        at[live] += COUNT[s]
        used[live] += 1 + (s == 0)
        live = live[at[live] < length[live]]
    first = np.concatenate([[0], np.cumsum(used)])
    words = np.zeros(int(first[-1]), np.uint64)
    b, p, s, nth = (np.concatenate([t[i] for t in taken] or [np.zeros(0, np.int64)]) for i in range(4))
    place = first[b] + nth
    flat = np.concatenate([v.ravel(), np.zeros(int(COUNT.max()), np.uint64)])
    for k in np.unique(s):
        i = np.flatnonzero(s == k)
        start, w = b[i] * BLOCK + p[i], place[i]
        if k == 0:
            words[w + 1] = flat[start]
            continue
        left = BLOCK - p[i]
        word = np.full(len(i), int(k) << 60, np.uint64)
        for c in range(COUNT[k] if BITS[k] else 0):
            x = flat[start + c] << np.uint64(c * BITS[k])
            word |= x * (c < left) if c + 1 > left.min(initial=BLOCK) else x
        words[w] = word
    seg_words = first[block_off]
    return words, seg_words, first[:-1] - seg_words[seg], block_off


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    if v.max(initial=0) < 1 << 16:
        return _SMALL[v]
    high = (v >> np.uint64(32)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp((v & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of one segment; all blocks at once."""
    out = np.zeros((len(offsets), BLOCK + int(COUNT.max())), np.uint64)
    length = np.minimum(n - np.arange(len(offsets)) * BLOCK, BLOCK)
    word, at, live = np.array(offsets, np.int64), np.zeros(len(offsets), np.int64), np.arange(len(offsets))
    while len(live):
        w = words[word[live]]
        s = (w >> np.uint64(60)).astype(np.int64)
        for k in np.unique(s):
            i = live[s == k]
            if k == 0:
                out[i, at[i]] = words[word[i] + 1]
            else:
                shift = np.arange(COUNT[k], dtype=np.uint64) * np.uint64(BITS[k])
                mask = np.uint64((1 << int(BITS[k])) - 1)
                out[i[:, None], at[i][:, None] + np.arange(COUNT[k])] = (w[s == k][:, None] >> shift) & mask
        word[live] += 1 + (s == 0)
        at[live] += COUNT[s]
        live = live[at[live] < length[live]]
    return out[np.repeat(np.arange(len(offsets)), length), ragged(length)]


def _pack(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for b in pieces(batches):
            ids = [enc.encode_ordinary(t) for t in strings(b.column("text"))]
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            words, seg, blocks, block_off = encode(np.fromiter(chain.from_iterable(ids), np.uint64, int(off[-1])), off)
            data = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(seg * 8), pa.py_buffer(words.astype("<u8"))])
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(np.diff(off)), data.cast(pa.binary()), list_array(blocks, block_off, pa.int32())], ["doc_id", "n_tokens", "words", "block_offsets"])

    return run


def packed(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, words (Simple-8b, little-endian), block_offsets (in words); a row per row.

    Null and empty texts have no tokens, words or blocks; bytes that aren't UTF-8 are read as U+FFFD; null
    doc_ids and repeated rows stay as they are.  Other columns are ignored; empty tables give no rows.  ``ranks`` is a file that the
    driver can read.
    """
    with open(ranks, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # the size of the vocabulary, whatever the data
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text"))
    return d.mapInArrow(_pack(content, pattern), "doc_id long, n_tokens long, words binary, block_offsets array<int>")

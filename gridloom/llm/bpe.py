"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

The text is cut by the vocabulary's pattern. Distinct pieces of a slice of rows that the bounded cache does not hold
are put, by byte length, into padded matrices of token ids (one row a piece). Each round, every row merges its leftmost
pair of minimum rank; ranks of pairs come from an open-addressing hash table held in numpy arrays; the merged row is
compacted in place; rows without a mergeable pair leave the matrix. A matrix row costs its length for each merge, so
a piece of more than ``ROW`` bytes (one run of letters without a break) is a matrix of its own, of rows of ROW columns:
each round merges the leftmost pair of minimum rank of all rows, found by the rows' minima, and compacts its row alone.

Defined cases: null text is the empty text and has no ids; ids of repeated rows are equal; any length of text is taken
whole; an empty table gives an empty table. Ids decode to the text's exact UTF-8 bytes.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import own_cache, slices, text_bytes, text_of, tokenizer_path

NONE = np.int32(2**31 - 1)
#: Columns of a matrix row at most.
ROW = 512
CACHE_MAX = 300_000
SLICE_BYTES = 3_000_000


class PairTable:
    """Hash table (left id, right id) -> rank of the merged token, with linear probing, in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._home(key)
        todo = np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] == -1
            cand = todo[free]
            slot, first = np.unique(at[cand], return_index=True)
            placed = cand[first]
            self.keys[slot] = key[placed]
            self.values[slot] = rank[placed]
            rest = np.ones(len(key), dtype=bool)
            rest[placed] = False
            todo = todo[rest[todo]]
            at[todo] = (at[todo] + (self.keys[at[todo]] != -1)) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no such merge (or one of them is the padding -1)."""
        shape = left.shape
        left, right = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        key = (left << 32) | (right & 0xFFFFFFFF)
        at = self._home(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder for a rank file."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        pairs = [
            (self.ranks[token[:k]], self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        left, right, rank = (np.array(x, dtype=np.int32) for x in zip(*pairs, strict=True))
        self.pairs = PairTable(left, right, rank)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.name = f"bpe {path}"

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        cut = [self.split(t) for t in texts]
        pieces = set(chain.from_iterable(cut))
        self.cache = own_cache(self.name, CACHE_MAX)
        self.cache = own_cache(self.name, CACHE_MAX, len(pieces.difference(self.cache)))
        self._learn(pieces.difference(self.cache))
        of = self.cache.__getitem__
        return [list(chain.from_iterable(map(of, pieces))) for pieces in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _learn(self, pieces: set[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = (whole,)
            elif len(raw) > ROW:
                self.cache[piece] = tuple(self._rows(raw))
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, rows in buckets.items():
            step = max(1, (1 << 20) >> bits)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for (piece, _), ids in zip(part, self._matrix([raw for _, raw in part], 1 << bits), strict=True):
                    self.cache[piece] = ids

    def _matrix(self, raws: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Rows of one length bucket, padded with -1 to ``width``."""
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), dtype=np.uint8).reshape(-1, width)
        length = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        col = np.arange(width)
        ids = np.where(col < length[:, None], self.single[flat], np.int32(-1))
        rank = np.full(ids.shape, NONE, dtype=np.int32)
        rank[:, :-1] = self.pairs.get(ids[:, :-1], ids[:, 1:])
        out: list = [None] * len(raws)
        row_of = np.arange(len(raws))
        while len(row_of):
            at = rank.argmin(axis=1)
            row = np.arange(len(row_of))
            best = rank[row, at]
            done = best == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[row_of[r]] = tuple(ids[r, : length[r]].tolist())
                keep = ~done
                longest = int(length[keep].max(initial=0))
                ids, rank, length, row_of = ids[keep, :longest], rank[keep, :longest], length[keep], row_of[keep]
                if not len(row_of):
                    break
                at, best, row = at[keep], best[keep], np.arange(len(row_of))
            width = ids.shape[1]
            source = np.minimum(col[:width] + (col[:width] > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            rank = np.take_along_axis(rank, source, axis=1)
            ids[row, at] = best
            length = length - 1
            ids[row, length] = -1
            rank[row, length - 1] = NONE
            nxt = np.where(at + 1 < width, ids[row, np.minimum(at + 1, width - 1)], -1)
            rank[row, at] = self.pairs.get(best, nxt)
            prev = np.flatnonzero(at > 0)
            rank[prev, at[prev] - 1] = self.pairs.get(ids[prev, at[prev] - 1], best[prev])
        return out

    def _rows(self, raw: bytes, width: int = ROW) -> list[int]:
        """One piece over several rows, each padded with -1; a row's last pair is with the next row's first id."""
        flat = self.single[np.frombuffer(raw, dtype=np.uint8)]
        n, rows = len(flat), -(-len(flat) // width)
        ids = np.full((rows, width), -1, dtype=np.int32)
        rank = np.full((rows, width), NONE, dtype=np.int32)
        ids.ravel()[:n] = flat
        rank.ravel()[: n - 1] = self.pairs.get(flat[:-1], flat[1:])
        length = [width] * (rows - 1) + [n - width * (rows - 1)]
        before, after = list(range(-1, rows - 1)), list(range(1, rows + 1))  # rows that are not empty
        low = rank.min(axis=1)
        known: dict[tuple[int, int], int] = {}

        def of_pair(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pairs.get(np.array([a]), np.array([b]))[0])
            return known[a, b]

        def drop(r: int, at: int) -> None:
            """Take column ``at`` out of row r."""
            end = length[r]
            ids[r, at : end - 1] = ids[r, at + 1 : end]
            rank[r, at : end - 1] = rank[r, at + 1 : end]
            ids[r, end - 1], rank[r, end - 1] = -1, NONE
            length[r] = end - 1
            if end == 1:
                if before[r] >= 0:
                    after[before[r]] = after[r]
                if after[r] < rows:
                    before[after[r]] = before[r]

        while True:
            r = int(low.argmin())
            best = int(low[r])
            if best == NONE:
                return ids[ids >= 0].tolist()
            at = int(rank[r].argmin())
            if at + 1 < length[r]:
                drop(r, at + 1)
            else:
                s = after[r]
                drop(s, 0)
                low[s] = rank[s].min()
            ids[r, at] = best
            if at + 1 < length[r]:
                rank[r, at] = of_pair(best, int(ids[r, at + 1]))
            else:
                rank[r, at] = of_pair(best, int(ids[after[r], 0])) if after[r] < rows else NONE
            if at > 0:
                rank[r, at - 1] = of_pair(int(ids[r, at - 1]), best)
            elif before[r] >= 0:
                p = before[r]
                rank[p, length[p] - 1] = of_pair(int(ids[p, length[p] - 1]), best)
                low[p] = rank[p].min()
            low[r] = rank[r].min()


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str | None) -> ByteBPE:
    """One codec a worker process. vocabulary: a name in the tokenizer package, or a path."""
    import public_tokenizers

    return ByteBPE(vocabulary if "/" in vocabulary else tokenizer_path(vocabulary), pattern or public_tokenizers.PATTERN)


def bpe_roundtrip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every whole text: the ids, and the bytes that these ids decode to."""

    def run(batches):
        bpe = codec(vocabulary, pattern)
        for batch in slices(batches, text_bytes("text"), SLICE_BYTES):
            each = bpe.ids(batch.column(1).to_pylist())
            ends = np.zeros(len(each) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in each], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(each), dtype=np.int32, count=int(ends[-1]))
            decoded = [bpe.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op8_bpe(docs: DataFrame) -> DataFrame:
    """The contract's digests, from the operator's ids and decoded bytes."""
    coded = bpe_roundtrip(docs)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

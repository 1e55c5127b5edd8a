"""Token-id files of directly addressable codes.

``write_shards`` range-partitions documents by id, encodes them and writes files; ``read_shards`` reads them back.
A file holds the ids of consecutive documents. Each id is cut into 8-bit chunks, the lowest in level 0. Level k has the
k-th chunk of every id that has one, one continuation bit for each (is there a chunk in level k + 1?) and a rank
directory: the number of set bits before each 512-bit block. Id i is chunk i of level 0; where its bit is set, its next
chunk is number rank(i) of level 1, and so on: no block is decoded, and ``Shard.token`` reads a few bytes a level.

Layout, little-endian: magic ``DAC1``; uint64 number of documents, of ids, of levels; per level its uint64 length; int64
document ids; uint8 null flags of the document ids; uint64 starts of the documents (one more than documents); then per
level the chunks, the bitmap (padded to whole 64-byte blocks) and the uint64 directory.

Files are written under a temporary name and renamed, and a task's rows are in a fixed order, so a repeated task writes
the same files again. A file closes at ``SHARD_IDS`` ids; a longer document has a file for itself.

Defined cases: null text is empty, its ids are the end id alone; rows with equal doc_id stay separate and are ordered by
text; rows with null doc_id come first; an empty table writes no files and reads as an empty table.
"""

from __future__ import annotations

import gc
import os
import struct
import uuid
import zlib
from array import array
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import own_cache, remote, saved, slices, text_bytes, text_of, tokenizer_path, work_dir

MAGIC = b"DAC1"
BLOCK = 512
SHARD_IDS = 2_000_000
CACHE_MAX = 700_000
WORDS_MAX = 500_000
SLICE_BYTES = 5_000_000
#: Files that a task reads, one after the other.
FILES_A_TASK = 3
MANIFEST = "shard long, part long, n_docs long, n_ids long, path string"


class ByteLetters(dict):
    """Code point -> the characters that stand for its UTF-8 bytes: a printable Latin-1 character for itself, the other
    bytes, in order, for the code points from 256 on."""

    def __init__(self):
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in printable]
        self.letter = [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]

    def __missing__(self, point: int) -> str:
        self[point] = out = "".join(self.letter[b] for b in chr(point).encode())
        return out


class WordEncoder:
    """The tokenizers library on whole texts, by way of distinct words.

    The vocabulary's normalizer and pre-tokenizer drop white space and never look across it, so a text's ids are the ids
    of its parts between spaces, tabs and line ends, one after the other. It composes characters (NFC) and then lower-cases
    them one by one, so texts are first composed and lower-cased likewise. They are left in capitals, for the library to
    lower-case, where that is not the same: at two letters, where a special token may stand, and where lower-case letters
    compose with a mark that their capitals do not compose with (the library would compose them). Its pattern ends a token between a letter and the punctuation after it, so a part's closing punctuation is coded apart.
    Each distinct part that results is encoded once by the library and kept, as bytes of 32-bit ids, in a bounded cache.
    Parts of normalized lower-case letters are one pre-token, so they go straight to the library's model, their UTF-8 bytes
    written as the characters that the byte-level pre-tokenizer gives them.
    """

    TAIL = ".,;:!?%*#$&|"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.name = f"dac {path}"
        self.bytes_of = ByteLetters()
        #: Parts' ids, kept from task to task (at most CACHE_MAX, some 150 MB); whole words' only within a task.
        self.known: dict[str, bytes] = {"": b""}

    def parts(self, word: str) -> tuple[str, str]:
        """(the word without its closing punctuation, that), as far as these are coded apart."""
        core = word.rstrip(self.TAIL)
        if len(core) < len(word) and core and core[-1].isalpha() and core[-1] != "İ" and is_normalized("NFC", core[-1]):
            return core, word[len(core) :]
        return word, ""

    def words(self, text: str) -> list[str]:
        if not is_normalized("NFC", text):
            text = normalize("NFC", text)
        if "<|" not in text and "Σ" not in text and "İ" not in text:
            lower = text.lower()
            text = lower if is_normalized("NFC", lower) else text
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.words(t) for t in texts]
        words = set(chain.from_iterable(cut))
        of_word = own_cache(self.name, WORDS_MAX)
        of_word = own_cache(self.name, WORDS_MAX, len(words.difference(of_word)))
        split = [(w, *self.parts(w)) for w in words.difference(of_word)]
        parts = {core for _, core, _ in split}
        parts.update(tail for *_, tail in split)
        todo = list(parts.difference(self.known))
        if len(self.known) + len(todo) > CACHE_MAX:
            self.known = {"": b""}
            todo = list(parts)
        known = self.known
        single = [w for w in todo if w.isalpha() and w.lower() == w and (w.isascii() or is_normalized("NFC", w))]
        tokenize = self.library.model.tokenize
        for w in single:
            known[w] = array("I", [t.id for t in tokenize(w if w.isascii() else w.translate(self.bytes_of))]).tobytes()
        todo = [w for w in todo if w not in known]
        for k in range(0, len(todo), 20_000):
            part = todo[k : k + 20_000]
            coded = self.library.encode_batch_fast(part, add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, coded, strict=True))
        of_word.update((w, known[core] + known[tail] if tail else known[core]) for w, core, tail in split)
        of = of_word.__getitem__
        return [np.frombuffer(b"".join(map(of, words)), dtype=np.uint32) for words in cut]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary if "/" in vocabulary else tokenizer_path(vocabulary))


def to_bytes(doc_ids: list, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of these documents."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        blocks = -(-len(rest) // BLOCK)
        bitmap = np.zeros(blocks * BLOCK // 8, dtype=np.uint8)
        packed = np.packbits(more, bitorder="little")
        bitmap[: len(packed)] = packed
        counts = np.bitwise_count(bitmap).reshape(blocks, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])[:-1]
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8), bitmap, directory))
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = struct.pack("<4sQQQ", MAGIC, len(doc_ids), len(ids), len(levels))
    parts = [head, struct.pack(f"<{len(levels)}Q", *(n for n, *_ in levels))]
    parts.append(np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes())
    parts.append(np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes())
    parts.append(starts.astype("<u8").tobytes())
    for _, chunks, bitmap, directory in levels:
        parts += [chunks.tobytes(), bitmap.tobytes(), directory.astype("<u8").tobytes()]
    return b"".join(parts)


class Shard:
    """A file opened for reading by random access."""

    def __init__(self, uri: str):
        system, path = remote(uri)
        self.file = system.open_input_file(path)
        magic, self.n_docs, self.n_ids, n_levels = struct.unpack("<4sQQQ", self._at(0, 28))
        if magic != MAGIC:
            raise ValueError(f"not a token-id file: {uri}")
        lengths = struct.unpack(f"<{n_levels}Q", self._at(28, 8 * n_levels))
        at = 28 + 8 * n_levels
        self.docs_at = at
        self.levels = []
        at += self.n_docs * 9 + 8 * (self.n_docs + 1)
        for n in lengths:
            blocks = -(-n // BLOCK)
            self.levels.append((n, at, at + n, at + n + blocks * (BLOCK // 8)))
            at += n + blocks * (BLOCK // 8) + blocks * 8

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def documents(self) -> tuple[list, np.ndarray]:
        """(document ids, starts)."""
        n, at = self.n_docs, self.docs_at
        ids = np.frombuffer(self._at(at, 8 * n), dtype="<i8").tolist()
        null = self._at(at + 8 * n, n)
        starts = np.frombuffer(self._at(at + 9 * n, 8 * (n + 1)), dtype="<u8").astype(np.int64)
        return [None if z else x for x, z in zip(ids, null, strict=True)], starts

    def token(self, i: int) -> int:
        """Id number i, from one chunk, one bitmap block and one directory entry a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bitmap, directory) in enumerate(self.levels):
            value |= self._at(chunks + i, 1)[0] << (8 * k)
            block, bit = divmod(i, BLOCK)
            bits = int.from_bytes(self._at(bitmap + block * (BLOCK // 8), BLOCK // 8), "little")
            if not bits >> bit & 1:
                break
            before = struct.unpack("<Q", self._at(directory + 8 * block, 8))[0]
            i = before + (bits & ((1 << bit) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id."""
        out, at = np.zeros(self.n_ids, dtype=np.uint32), np.arange(self.n_ids)
        for k, (n, chunks, bitmap, directory) in enumerate(self.levels):
            out[at] |= np.frombuffer(self._at(chunks, n), dtype=np.uint8).astype(np.uint32) << np.uint32(8 * k)
            bits = np.frombuffer(self._at(bitmap, directory - bitmap), dtype=np.uint8)
            at = at[np.unpackbits(bits, count=n, bitorder="little").astype(bool)]
        return out


def write_shards(
    docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Encode documents (doc_id, text), end each with ``end_id`` and write them to ``folder`` in ascending doc_id order.

    Returns the manifest (shard, part, n_docs, n_ids, path), one row a file; (shard, part) ascends with doc_id.
    """

    def run(batches):
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        system, root = remote(folder)
        system.create_dir(root, recursive=True)
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        end, total = np.array([end_id], dtype=np.uint32), 0

        def close():
            starts = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
            ids = np.concatenate(held)
            name = f"{shard:06d}-{part:05d}.dac"
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(to_bytes(names, starts, ids))
            system.move(draft, f"{root}/{name}")
            row = [[shard], [part], [len(names)], [len(ids)], [f"{folder}/{name}"]]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, [pa.int64()] * 4 + [pa.string()], strict=True)],
                ["shard", "part", "n_docs", "n_ids", "path"],
            )

        gc.disable()  # the caches hold no cycles, and walking them takes a fifth of the time
        try:
            for batch in slices(batches, text_bytes("text"), SLICE_BYTES):
                each = encoder(vocabulary).ids(batch.column(1).to_pylist())
                for name, ids in zip(batch.column(0).to_pylist(), each, strict=True):
                    names.append(name)
                    held += [ids, end]
                    sizes.append(len(ids) + 1)
                    total += len(ids) + 1
                    if total >= shard_ids:
                        yield close()
                        names, held, sizes, part, total = [], [], [], part + 1, 0
            if names:
                yield close()
        finally:
            gc.enable()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, MANIFEST)


def read_shards(manifest: DataFrame, checksums: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every document of the manifest's files, one file at a time.

    With ``checksums``, ids_crc32 instead of ids: the CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file: the running sum needs their order alone.
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0).cast("long")))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                names, starts = shard.documents()
                ids = shard.all().astype("<u4")
                step = 2_000
                for k in range(0, len(names), step):
                    s = starts[k : k + step + 1]
                    if checksums:
                        last = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(s[:-1], s[1:], strict=True)], pa.int64())
                    else:
                        flat = ids[s[0] : s[-1]].astype(np.int32)
                        last = pa.ListArray.from_arrays(pa.array((s - s[0]).astype(np.int32)), pa.array(flat))
                    columns = [pa.array(names[k : k + step], pa.int64()), pa.array(s[:-1] + base), pa.array(np.diff(s)), last]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32" if checksums else "ids"])

    # A fixed number of partitions: adaptive execution would put the short rows of this table into one task.
    files = based.select("path", "base").repartition(-(-manifest.count() // FILES_A_TASK) or 1, "path")
    last = "ids_crc32 long" if checksums else "ids array<int>"
    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def op10_token_files(docs: DataFrame, spark: SparkSession) -> DataFrame:
    manifest = saved(write_shards(docs, work_dir(spark, "token-files")), "token-manifest")
    return read_shards(manifest, checksums=True)

"""Token counts from a compiled finite-state transducer.

A sentencepiece BPE vocabulary is compiled, state by state as texts need them, into a deterministic transducer over
classes of code points. Every transition is annotated with the tokens it adds to the count of the text read so far (it
may take tokens back: "th" is one token where "t", "h" would be two).

State. Encoding by merges has the property that a sequence of tokens is an encoding just when each two neighbours are
the encoding of what they spell. So the last token of the encoding of a prefix is the longest piece t that ends there,
such that (last token of the prefix without t, t) is such a pair. A later token can only start where the text from there
on is the start of some piece. A state is therefore the longest suffix that starts a piece, and, for each place in it from
which the text starts a piece, the last token of the encoding up to there and how many tokens have followed since. That
is finite. A worker that has met ``MAX_STATES`` states forgets them and starts anew.

Run. Texts are cut into chunks; all chunks step together, one code point at a time, through a hash table of transitions
in numpy arrays. A chunk's state map sends an entry state to an exit state and a count. It is filled for the entries that
can occur: the start state, the exits of the chunk before, the exits for those, until nothing new comes; as the state
hardly ever depends on what stands before the chunk, that takes two or three rounds. The maps of each text's chunks are
then composed by a parallel prefix scan (doubling).

Defined cases: null text is the empty text with 0 bytes and 0 tokens; any length of text is taken whole; repeated rows
get equal counts; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import slices, text_bytes, text_of, tokenizer_path

SPACE = "▁"
CHUNK = 256
SLICE_BYTES = 3_000_000
MAX_STATES = 600_000


class Transitions:
    """Open-addressing table (state * classes + class) -> (next state, tokens added)."""

    def __init__(self, bits: int = 18):
        self._alloc(bits)
        self.used = 0

    def _alloc(self, bits: int) -> None:
        self.bits, self.shift, self.mask = bits, np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.next = np.zeros(1 << bits, dtype=np.int32)
        self.add = np.zeros(1 << bits, dtype=np.int16)

    def home(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def put(self, key: int, nxt: int, add: int) -> None:
        if self.used * 2 > self.mask:
            old = self.keys >= 0
            rows = list(zip(self.keys[old].tolist(), self.next[old].tolist(), self.add[old].tolist(), strict=True))
            self._alloc(self.bits + 1)
            self.used = 0
            for row in rows:
                self.put(*row)
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[at] != -1:
            if self.keys[at] == key:
                return
            at = (at + 1) & self.mask
        self.keys[at], self.next[at], self.add[at] = key, nxt, add
        self.used += 1

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 where there is none."""
        at = self.home(key)
        found = self.keys[at]
        miss = found != key
        if miss.any():
            todo = np.flatnonzero(miss)
            while len(todo):
                empty = self.keys[at[todo]] == -1
                at[todo[empty]] = -1
                todo = todo[~empty]
                at[todo] = (at[todo] + 1) & self.mask
                todo = todo[self.keys[at[todo]] != key[todo]]
        return at


class Transducer:
    """The compiled vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        self.tokens = ["", *self.score]
        self.token_no = {t: k for k, t in enumerate(self.tokens)}
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        letters = sorted({c for p in self.score for c in p})
        #: Class of each code point: 1-4 are code points outside the vocabulary, by UTF-8 length (the byte tokens they
        #: make), 0 is the end of the text.
        self.cls = np.full(0x110000, 4, dtype=np.int32)
        self.cls[:0x10000], self.cls[:0x800], self.cls[:0x80] = 3, 2, 1
        self.cls[[ord(c) for c in letters]] = np.arange(5, 5 + len(letters))
        self.cls[ord(" ")] = self.cls[ord(SPACE)]
        self.letters = ["", "", "", "", "", *letters]
        self.n_classes = len(self.letters)
        self.reset()

    def reset(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        #: A state, packed into a string to be small: the suffix, a NUL, then for each live place in it three
        #: characters: where it starts, the tokens since then, the last token before it.
        self.states: list[str] = [self.pack("", [(0, "", 0)])]
        self.number = {self.states[0]: 0}
        self.table = Transitions()

    def pack(self, suffix: str, places: list[tuple[int, str, int]]) -> str:
        return suffix + "\0" + "".join(chr(k) + chr(s + 64) + chr(self.token_no[t]) for k, t, s in places)

    def unpack(self, state: str) -> tuple[str, list[tuple[int, str, int]]]:
        end = state.index("\0")
        rest = state[end + 1 :]
        return state[:end], [(ord(rest[i]), self.tokens[ord(rest[i + 2])], ord(rest[i + 1]) - 64) for i in range(0, len(rest), 3)]

    def merge(self, text: str) -> list[str]:
        """Encoding by the highest-scored merge, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def neighbours(self, a: str, b: str) -> bool:
        """Whether (a, b) is the encoding of what it spells; a is '' after something that can't merge."""
        if not a:
            return True
        key = (a, b)
        if key not in self.pairs:
            self.pairs[key] = a + b not in self.score and self.merge(a + b) == [a, b]
        return self.pairs[key]

    def step(self, state: int, cls: int) -> tuple[int, int]:
        """Next state and tokens added."""
        if cls < 5:
            return 0, cls
        suffix, places = self.unpack(self.states[state])
        text = suffix + self.letters[cls]
        for k, before, since in places:  # the longest piece that ends here and follows on
            piece = text[k:]
            if piece in self.score and self.neighbours(before, piece):
                break
        else:
            raise AssertionError(f"no piece ends {text!r}")
        added = 1 - since
        live = [p for p in places if text[p[0] :] in self.prefixes]
        cut = live[0][0] if live else len(text)
        nxt = self.pack(text[cut:], [*((k - cut, t, s + added) for k, t, s in live), (len(text) - cut, piece, 0)])
        if nxt not in self.number:
            self.number[nxt] = len(self.states)
            self.states.append(nxt)
        return self.number[nxt], added

    def run(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray):
        """Exit state and count of each chunk from its entry state; all chunks step together."""
        order = np.argsort(-length, kind="stable")
        state, count = entry[order].astype(np.int64), np.zeros(len(order), dtype=np.int64)
        at, size = start[order], length[order]
        live = len(order)
        for k in range(int(size[0]) if live else 0):
            live = int(np.searchsorted(-size, -k, side="left"))  # chunks longer than k
            key = state[:live] * self.n_classes + symbols[at[:live] + k]
            slot = self.table.find(key)
            if (slot < 0).any():
                for x in np.unique(key[slot < 0]).tolist():
                    self.table.put(x, *self.step(*divmod(x, self.n_classes)))
                slot = self.table.find(key)
            state[:live] = self.table.next[slot]
            count[:live] += self.table.add[slot]
        out, total = np.empty_like(state), np.empty_like(count)
        out[order], total[order] = state, count
        return out, total

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > MAX_STATES or len(self.pairs) > 2 * MAX_STATES:
            self.reset()
        codes = np.frombuffer("".join(SPACE + t if t else "" for t in texts).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.cls[codes]
        size = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        chunks = -(-size // CHUNK)
        doc = np.repeat(np.arange(len(texts)), chunks)
        first = np.cumsum(chunks) - chunks
        index = np.arange(len(doc)) - first[doc]
        start = (np.cumsum(size) - size)[doc] + index * CHUNK
        length = np.minimum(CHUNK, size[doc] - index * CHUNK)
        # The state maps: row r says that chunk chunk[r], entered in state key[r] % top, has count[r] and exit[r].
        top = 1 << 32
        key, exit_, count = [], [], []
        new = np.arange(len(doc)) * top
        while len(new):
            c = new // top
            x, n = self.run(symbols, start[c], length[c], new % top)
            key, exit_, count = [*key, new], [*exit_, x], [*count, n]
            onward = c + 1 < len(doc)
            onward[onward] = index[c[onward] + 1] > 0
            new = np.setdiff1d((c[onward] + 1) * top + x[onward], np.concatenate(key))
        key, exit_, count = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (key, exit_, count))
        order = np.argsort(key)
        key, exit_, count = key[order], exit_[order], count[order]
        # Compose them by doubling: after k rounds a row's count spans 2**k chunks and then[r] is the row after these.
        c = key // top
        onward = c + 1 < len(doc)
        onward[onward] = index[c[onward] + 1] > 0
        then = np.full(len(key) + 1, len(key))
        then[:-1][onward] = np.searchsorted(key, (c[onward] + 1) * top + exit_[onward])
        count = np.append(count, 0)
        while (then[:-1] < len(key)).any():
            count, then = count + count[then], then[then]
        total = np.zeros(len(texts), dtype=np.int64)
        roots = np.flatnonzero(index == 0)
        total[doc[roots]] = count[np.searchsorted(key, roots * top)]
        return total


@lru_cache(maxsize=2)
def transducer(vocabulary: str) -> Transducer:
    return Transducer(vocabulary if "/" in vocabulary else tokenizer_path(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text."""

    def run(batches):
        machine = transducer(vocabulary)
        for batch in slices(batches, text_bytes("text"), SLICE_BYTES):
            n = machine.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
        F.octet_length(text_of()).cast("long").alias("n_bytes"),
    )
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op2_token_counts(docs: DataFrame, limit: int = 4096) -> DataFrame:
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > limit)

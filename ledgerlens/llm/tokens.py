"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer with the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
is compiled into a deterministic transducer over bytes. A text is cut into
words by the pattern (one look at the next character suffices); at a word's
first byte the transducer starts anew.

A state stands for all that the word so far can still matter for: each place
from which a token could yet reach beyond the last byte, with the last token
of the encoding up to there and how many tokens fewer it has than the encoding
up to the last byte. A byte's transition looks for the token that ends the
longer word: it begins at one of these places and forms a valid pair with the
last token there, and there is exactly one such token (a token sequence is the
tokenizer's own encoding if and only if all its neighbours are). Transitions
carry the change in the number of tokens and are compiled when first met; a
worker keeps its table, up to ``MAX_STATES``.

Counting runs over chunks of ``CHUNK`` bytes side by side. From its first word
start on, a chunk's map from start state to (tokens, end state) is constant;
only the bytes before depend on the start state. The maps are composed by a
scan: each chunk takes its neighbour's end state as soon as it is known, and
all chunks whose neighbour is known run their first bytes together.

Special strings in a text count as one token each and separate what stands
around them, as the library does by default. Null text is empty (0 tokens).
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import row_slices, ship_by_value, text_buffer, worker_cache

LIMIT = 512
CHUNK = 512
MAX_STATES = 250_000
OTHER, LETTER, NUMBER, BLANK, BREAK = range(5)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def character_classes() -> np.ndarray:
    """Class of each code point under the pattern."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[[ord(c) for c in m[0]]] = kind
    return table


def byte_alphabet() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write a byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Transducer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        alphabet = byte_alphabet()
        text = lambda token: bytes(alphabet[c] for c in token)
        self.specials = [t["content"].encode() for t in spec["added_tokens"] if t["special"]]
        self.merges: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[text(a), text(b)] = rank
        special = {t["content"] for t in spec["added_tokens"]}
        self.vocabulary = {text(t) for t in spec["model"]["vocab"] if t not in special}
        self.beginnings = {t[:k] for t in self.vocabulary for k in range(1, len(t))}
        self.classes = character_classes()
        self.fits = lru_cache(1 << 18)(self._fits)
        self.reset()

    def reset(self) -> None:
        #: (bytes since the place, last token before it, tokens less than at the end), places in order
        self.names: list[tuple] = [((b"", b"", 0),)]
        self.numbers: dict[tuple, int] = {self.names[0]: 0}
        self.columns = np.full(256, -1, np.int32)
        self.used = 0
        self.table = np.full((1024, 64), -1, np.int32)

    def encode(self, text: bytes) -> list[bytes]:
        """Merges of the least rank first, the leftmost of these."""
        parts = [text[k:k + 1] for k in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.merges.get(pair, 1 << 30), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether ``right`` may follow ``left`` (b"": the word begins) in an encoding."""
        return self.encode(left + right) == ([left, right] if left else [right])

    def compile(self, state: int, byte: int) -> int:
        """Table entry: next state * 64 + change in tokens + 32."""
        places, new = self.names[state], bytes([byte])
        for since, last, less in places:
            token = since + new
            if token in self.vocabulary and self.fits(last, token):
                break
        else:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        change = 1 - less
        kept = [(since + new, last, less + change) for since, last, less in places if since + new in self.beginnings]
        name = (*kept, (b"", token, 0))
        number = self.numbers.setdefault(name, len(self.names))
        if number == len(self.names):
            self.names.append(name)
            if number >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        if not -32 <= change < 32:
            raise ValueError("a byte changes the number of tokens by more than 32")
        return number * 64 + change + 32

    def entries(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        column = self.columns[byte]
        if (column < 0).any():
            for b in np.unique(byte[column < 0]).tolist():
                self.columns[b] = self.used
                self.used += 1
                if self.used > self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            column = self.columns[byte]
        out = self.table[state, column]
        unknown = out < 0
        if unknown.any():
            for key in np.unique(state[unknown].astype(np.int64) << 8 | byte[unknown]).tolist():
                entry = self.compile(key >> 8, key & 255)
                self.table[key >> 8, self.columns[key & 255]] = entry
            out = self.table[state, column]
        return out

    def word_starts(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Mark of the bytes that begin a word; places of special strings.
        ``first``: offsets at which texts begin."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        head = data[lead].astype(np.uint32)
        byte = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.uint32) & 0x3F
        point = head.copy()
        if (head >= 0x80).any():
            point = np.where(head >= 0xC0, (head & 0x1F) << 6 | byte(1), point)
            point = np.where(head >= 0xE0, (head & 0x0F) << 12 | byte(1) << 6 | byte(2), point)
            point = np.where(head >= 0xF0, (head & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3), point)
        kind = self.classes[point]
        special = []
        if self.specials:
            begins = set(first.tolist())
            for m in re.finditer(b"|".join(map(re.escape, self.specials)), data.tobytes()):
                if not any(m.start() < x < m.end() for x in range(m.start() + 1, m.end()) if x in begins):
                    special.append(m.span())
                    kind[(lead >= m.start()) & (lead < m.end())] = BREAK
        opening = np.zeros(len(lead) + 1, bool)  # a text begins here; the end counts as well
        opening[np.searchsorted(lead, first)] = True
        opening[-1] = True
        n = len(lead)
        before = np.r_[np.uint8(BREAK), kind[:-1]]
        before[opening[:n]] = BREAK
        after = np.r_[kind[1:], np.uint8(BREAK)]
        after[opening[1:]] = BREAK
        space = np.r_[False, point[:-1] == 32] & (before == BLANK)
        solid = kind < BLANK
        start = np.where(solid, (before != kind) & ~space, (before != BLANK) | (after < BLANK))
        start |= kind == BREAK
        quotes = np.flatnonzero(start & (point == 39) & solid)
        if len(quotes):
            at = lambda k: np.where(quotes + k < n, point[np.minimum(quotes + k, n - 1)], 0)
            text = np.cumsum(opening[:n])
            inside = lambda k: (quotes + k < n) & (text[np.minimum(quotes + k, n - 1)] == text[quotes]) & (kind[np.minimum(quotes + k, n - 1)] != BREAK)
            one = inside(1) & np.isin(at(1), [ord(c) for c in "stmd"])
            two = inside(1) & inside(2) & np.isin(at(1) << 8 | at(2), [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
            start[quotes[one | two] + 1] = False
            for hit, size in ((one, 2), (two & ~one, 3)):
                end = quotes[hit] + size
                start[end[end < n]] |= kind[end[end < n]] < BLANK
        mark = np.zeros(len(data), bool)
        mark[lead[start]] = True
        return mark, special

    def changes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Change in the number of tokens at each byte."""
        n = len(data)
        out = np.zeros(n, np.int8)
        begin = np.arange(0, n, CHUNK)
        end = np.minimum(begin + CHUNK, n)
        first = np.flatnonzero(starts)
        sure = np.searchsorted(first, begin)
        sync = np.where(sure < len(first), first[np.minimum(sure, len(first) - 1)], n)
        sync = np.minimum(sync, end)  # a chunk without word start is all head
        tail = np.full(len(begin), -1, np.int64)  # end state, -1: not known yet
        self.run(data, starts, sync, end, np.zeros(len(begin), np.int64), out, tail, np.flatnonzero(sync < end))
        todo = np.flatnonzero(sync > begin)
        while len(todo):
            ready = todo[tail[todo - 1] >= 0]
            self.run(data, starts, begin, sync, tail[ready - 1], out, tail, ready, only_open=True)
            todo = todo[tail[todo - 1] < 0] if len(ready) == 0 else np.setdiff1d(todo, ready, assume_unique=True)
        return out

    def run(self, data: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, state: np.ndarray, out: np.ndarray,
            tail: np.ndarray, rows: np.ndarray, only_open: bool = False) -> None:
        """Run ``rows`` from lo to hi, longest first, one byte a step; the end
        states go to ``tail`` (with ``only_open``: of rows that have none)."""
        state = state if only_open else state[rows]
        size = hi[rows] - lo[rows]
        by = np.argsort(-size, kind="stable")
        rows, state, size = rows[by], state[by], size[by]
        at, step, active = lo[rows], 0, len(rows)
        final = state.copy()
        while active:
            place = at[:active] + step
            byte = data[place]
            now = np.where(starts[place], 0, final[:active])
            entry = self.entries(now, byte)
            out[place] = (entry & 63) - 32
            final[:active] = entry >> 6
            step += 1
            active = int(np.searchsorted(-size, -step))
        if only_open:
            keep = tail[rows] < 0
            tail[rows[keep]] = final[keep]
        else:
            tail[rows] = final

    def count(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each text of a buffer."""
        data = raw[at[0]:at[-1]]
        if not len(data):
            return np.zeros(len(at) - 1, np.int64)
        if len(self.names) > MAX_STATES:
            self.reset()
        first = (at[:-1] - at[0])[np.diff(at) > 0]
        starts, special = self.word_starts(data, first)
        change = self.changes(data, starts)
        for a, b in special:
            change[a:b] = 0
            change[a] = 1
        sums = np.r_[0, np.cumsum(change, dtype=np.int64)]
        return sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]


def transducer(path: str) -> Transducer:
    cache = worker_cache()
    key = f"transducer of {path}"
    if key not in cache:
        cache[key] = Transducer(path)
    return cache[key]


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of ``docs``."""
    ship_by_value()
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            raw, at = text_buffer(b.column(1))
            parts = [machine.count(raw, at[lo:hi + 1]) for lo, hi in row_slices(at)]
            n = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))

"""Operator 8, best-fit packing by large-item matching.

Documents become token pieces of at most `capacity`. Only lengths matter for a packing, so it is
planned on the histogram of lengths, at most `capacity` numbers however large the corpus: pieces
above one third of the capacity pair at most twice per sequence by greedy matching, longest first,
each with the longest partner that fits; smaller pieces, longest first, go into the tightest gap.
The plan says where the pieces of each length go by their rank, as runs over consecutive sequences;
ranks come from slices of each length, so no task holds a length.

Defined results: a null or empty text is the end id alone; rows that are repeated are packed each;
an empty table gives no rows. Text that spells a special token is tokenized as the tokenizer does.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_ranks

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY, END = 2048, 0
#: Words, and pieces of words, whose ids a worker remembers: some 150 MB.
REMEMBERED = 1_000_000
#: The tokenizer's own rule for the pieces of a word.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words that the rule splits as the tokenizer does: Latin-1 without its white space and controls.
PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xff]+")

#: Marks that begin no special token and no contraction.
MARKS = b".,;:!?%&*#$()-"


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Remembered:
    """Ids by word, of the words that came lately: once as many are new as half of what is to be kept,
    those that did not come again since the last time go."""

    def __init__(self, most: int) -> None:
        self.half, self.new, self.old = most // 2, {}, {}

    def get(self, word: bytes) -> bytes | None:
        found = self.new.get(word)
        if found is None and (found := self.old.get(word)) is not None:
            self.put(word, found)
        return found

    def put(self, word: bytes, ids: bytes) -> None:
        if len(self.new) >= self.half:
            self.new, self.old = {}, self.new
        self.new[word] = ids


class WordTokenizer:
    """A tokenizer that never joins across ASCII white space, with the ids of words remembered.

    Unknown words of Latin-1 are lower-cased and split by the tokenizer's rule, and only pieces that
    are new go through its merges; all others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.words, self.pieces = Remembered(REMEMBERED), Remembered(REMEMBERED)

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            spelled = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = b"".join([x.id.to_bytes(4, "little") for x in self.merge(spelled)])
            self.pieces.put(piece, ids)
        return ids

    def word(self, word: bytes) -> bytes:
        if word.isalpha():  # of ASCII letters
            return self.piece(word.lower().decode())
        letters = word.rstrip(MARKS)
        if letters.isalpha():  # with marks after them, which are one piece
            return self.piece(letters.lower().decode()) + self.piece(word[len(letters) :].decode())
        text = word.decode()
        if not PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.piece, PIECES.findall(text.lower())))

    def ids(self, text: str) -> np.ndarray:
        parts = text.encode().split()
        found = list(map(self.words.new.get, parts))
        if None in found:
            for at, (word, ids) in enumerate(zip(parts, found)):
                if ids is None:
                    ids = self.words.get(word)
                    if ids is None:
                        ids = self.word(word)
                        self.words.put(word, ids)
                    found[at] = ids
        return np.frombuffer(b"".join(found), dtype="<u4")


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks that a worker runs: loading it takes a quarter of a second, and the words of one task come again in the next."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            rows, numbers, lengths, sums = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(tokenizer.ids(text.as_py() or ""), np.array([END], dtype="<u4"))
                for number, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(row)
                    numbers.append(number)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
            numbers = np.array(numbers, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers), pa.array(numbers.astype(np.int64) * capacity), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces per sequence, first sequence, offset in it) from pieces by length.

    Pieces of a length from the first rank on, until the next run of that length, fill consecutive
    sequences with so many pieces each.
    """
    left, done = dict(histogram), defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by free room, intervals (first sequence, number)
    rooms: list[int] = []
    sequences = 0

    def put(length: int, bins: int, each: int, first: int, offset: int) -> None:
        runs.append((length, done[length], each, first, offset))
        done[length] += bins * each
        left[length] -= bins * each

    def free(room: int, first: int, bins: int) -> None:
        if room > 0 and bins > 0:
            if not gaps[room]:
                insort(rooms, room)
            gaps[room].append((first, bins))

    large = sorted(x for x in left if 3 * x > capacity)
    for a in reversed(large):
        while left[a] > 0:
            at = bisect_left(large, min(a, capacity - a) + 1) - 1
            while at >= 0 and (left[large[at]] == 0 or (large[at] == a and left[a] < 2)):
                at -= 1
            b = large[at] if at >= 0 else None
            bins = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            if b == a:
                put(a, bins, 2, sequences, 0)
            else:
                put(a, bins, 1, sequences, 0)
                if b is not None:
                    put(b, bins, 1, sequences, a)
            free(capacity - a - (b or 0), sequences, bins)
            sequences += bins

    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[s] > 0:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                bins = -(-left[s] // (capacity // s))
                free(capacity, sequences, bins)
                sequences += bins
                continue
            room = rooms[at]
            first, bins = gaps[room].pop()
            if not gaps[room]:
                rooms.pop(at)
            each = min(room // s, left[s])
            used = min(bins, left[s] // each)
            put(s, used, each, first, capacity - room)
            free(room, first + used, bins - used)
            free(room - each * s, first, used)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (from token_pieces) with sequence_id and offset."""
    own = materialize(pieces.withColumn("__mix", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4294967296))), "pack-pieces")
    ranked, counts = salted_ranks(own, ["length"], "__mix", ["doc_id", "piece", "ids_crc32"], "pack")
    # At most `capacity` rows.
    runs = sorted(plan({r["length"]: r["n"] for r in counts.collect()}, capacity))
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    shared = own.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, each, sequence, offset = shared.value.T
        keys = length * 2**44 + first
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(keys, n * 2**44 + rank, side="right") - 1
            bins, slot = np.divmod(rank - first[run], each[run])
            columns = [batch.column(c) for c in names] + [pa.array(sequence[run] + bins), pa.array(offset[run] + slot * n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, kinds)


def best_fit_packing(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Every document of docs (doc_id, text) in token pieces, each with its sequence and place there."""
    return pack(token_pieces(docs, path, capacity), capacity)

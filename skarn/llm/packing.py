"""Packing token sequences with minimum bin slack."""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import text_slices

CAPACITY, END_ID = 2048, 1
#: Pieces that wait for a window at most; their ids are held (4 bytes each).
POOL = 2048


def fill(counts: dict[int, int], target: int) -> list[int]:
    """Lengths of a sub-multiset of counts with the greatest sum up to target.

    Subset sums are the bits of an integer. Each length enters with its count
    split into powers of two, longest first; the states before each step are
    kept, and the best sum is traced back through them to counts.
    """
    mask = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, size = counts[length], 1
        while left and length * size <= target:
            take = min(size, left)
            grown = (reach | reach << (length * take)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            size *= 2
        if reach >> target & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


class Packer:
    """Packs pieces of at most CAPACITY ids; only lengths and ids of waiting pieces are held."""

    def __init__(self, capacity: int, pool: int) -> None:
        self.capacity, self.pool = capacity, pool
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.n = self.total = self.sequence = 0

    def add(self, row: tuple, start: int, ids: np.ndarray) -> Iterator[tuple]:
        """row: what is given back with the piece."""
        for at in range(0, len(ids), self.capacity):
            piece = ids[at : at + self.capacity]
            if len(piece) == self.capacity:
                yield from self._emit([(row, start + at, piece)])
            else:
                self.waiting[len(piece)].append((row, start + at, piece))
                self.n += 1
                self.total += len(piece)
        while self.n > self.pool and self.total >= self.capacity:
            yield from self._window()

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for row, start, ids in pieces:
            yield row, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def _take(self, length: int) -> tuple:
        own = self.waiting[length]
        piece = own.pop()
        if not own:
            del self.waiting[length]
        self.n -= 1
        self.total -= length
        return piece

    def _window(self) -> Iterator[tuple]:
        """The longest piece, and of the others the lengths that fill its window closest; a gap that is left takes the start of another piece."""
        pieces = [self._take(max(self.waiting))]
        room = self.capacity - len(pieces[0][2])
        for length in fill({k: len(v) for k, v in self.waiting.items()}, room):
            pieces.append(self._take(length))
            room -= length
        if room and self.waiting:
            row, start, ids = self._take(max(self.waiting))
            pieces.append((row, start, ids[:room]))
            rest = ids[room:]
            if len(rest):
                self.waiting[len(rest)].append((row, start + room, rest))
                self.n += 1
                self.total += len(rest)
        yield from self._emit(pieces)

    def finish(self) -> Iterator[tuple]:
        while self.n:
            yield from self._window()


def byte_encoder(path: str, tokens: str):
    """Byte-level BPE from a file of ranks, with the added tokens of the `tokenizers` file: the ids that the latter gives, at four times its speed."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    added = {t["content"]: t["id"] for t in json.loads(Path(tokens).read_text())["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def byte_reader(path: str, tokens: str):
    """byte_encoder's ids of a text; where its pattern gives up on a very long run of white space, those of the `tokenizers` file itself."""
    from tokenizers import Tokenizer

    fast, whole = byte_encoder(path, tokens), Tokenizer.from_file(tokens)

    def read(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return read


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.tiktoken", tokens: str = "byte_bpe_50k.json", pool: int = POOL) -> DataFrame:
    """Pieces of token sequences of at most ``capacity`` ids, one row per piece.

    A document is its text's ids and then ``end_id``. Whole windows are cut
    from long documents; what remains of each waits in a pool. A window starts
    with the longest piece that waits; a bitset subset-sum over the lengths of
    the others picks the multiset that comes closest to its capacity, and the
    start of one more piece closes a gap that is left. Each task packs what it
    reads as it reads it, so nothing is shuffled or gathered, and memory holds
    ``pool`` pieces and one document; only a task's last sequence is short.

    Rows: id, start (ids of the document before the piece), length, ids_crc32
    (of the piece's ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id (task << 33 | number within it), offset (within the sequence,
    gapless from 0). Null and empty texts are the end id alone. Added tokens' strings
    in a text get their ids, as the `tokenizers` file has it; bytes that are not UTF-8 count as U+FFFD. Rows with equal ids are packed
    apart; an empty table gives no rows; further columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        read = byte_reader(public_tokenizers.path(vocabulary), public_tokenizers.path(tokens))
        packer = Packer(capacity, pool)
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        id_type = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*((doc, start, n, crc, total, base + seq, off) for (doc, total), start, n, crc, seq, off in rows), strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids = batch.column(0).to_pylist()
            for first, _, data, offs in text_slices(batch, "text"):
                raw = data.tobytes()
                for j in range(len(offs) - 1):
                    own = np.append(read(raw[offs[j] : offs[j + 1]].decode(errors="replace")), np.uint32(end_id))
                    rows.extend(packer.add((ids[first + j], len(own)), 0, own))
                if len(rows) >= 20_000:
                    yield flush()
        rows.extend(packer.finish())
        if rows:
            yield flush()

    out = docs.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)

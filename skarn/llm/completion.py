"""Packing of whole documents into sequences by bin completion."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import stored

CAPACITY, END_ID = 2048, 0
#: Nodes of the search for one sequence fewer, fillings tried at a node, and steps that looking for those may take.
#: They bound the planner's effort, not what is packed: the plan at hand is always whole.
NODES, FILLINGS, STEPS = 20_000, 6, 400
#: Bytes of a document that are cut into words at once, and different words whose ids a task remembers.
SEGMENT, REMEMBERED = 1 << 20, 400_000

Filling = tuple[tuple[int, int], ...]
#: Sequences of the same lengths: how many of them, and (length, copies in each).
Plan = list[tuple[int, Filling]]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit by decreasing length, all bins of equal content at once.

    Each length makes at most two new kinds of bins and splits at most two, so
    the plan's size depends on the number of lengths, not on their counts.
    """
    open_: dict[int, list[tuple[int, Filling]]] = {}
    rooms = 0  # a bit for each room that some bin has
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                times, held = open_[room].pop()
                if not open_[room]:
                    rooms ^= 1 << room
            else:
                room, times, held = capacity, left, ()
            each = room // length
            full = min(times, left // each)
            rest = min(left - full * each, each) if full < times else 0
            made = [(full, each), (1, rest)] if rest else [(full, each)]
            if held:
                made.append((times - full - bool(rest), 0))
            for number, copies in made:
                if number:
                    at = room - copies * length
                    open_.setdefault(at, []).append((number, (*held, (length, copies)) if copies else held))
                    rooms |= 1 << at
            left -= full * each + rest
    return [kind for kinds in open_.values() for kind in kinds]


def fewest(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A number of sequences below which no packing goes: the waste bound.

    For each limit k: lengths over capacity - k can share with nothing of at
    least k; what of lengths from k to half the capacity finds no room beside
    the lengths in between needs further sequences.
    """
    number, volume = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        number[length] += n
        volume[length] += n * length
    n_to, v_to = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(volume)])
    half = capacity // 2
    most = int(-(-v_to[-1] // capacity))
    for k in range(half + 1):
        alone = n_to[-1] - n_to[capacity - k + 1]
        large = n_to[capacity - k + 1] - n_to[half + 1]
        free = large * capacity - (v_to[capacity - k + 1] - v_to[half + 1])
        over = (v_to[half + 1] - v_to[k]) - free
        most = max(most, int(alone + large + max(0, -(-over // capacity))))
    return most


def _covers(few: list[int], many: list[int]) -> bool:
    """Whether the items of many can be put into those of few as bins."""
    if not many:
        return True
    for j, room in enumerate(few):
        if room >= many[0] and room not in few[:j] and _covers([*few[:j], room - many[0], *few[j + 1 :]], many[1:]):
            return True
    return False


def fillings(counts: dict[int, int], room: int, slack: int, most: int = FILLINGS, steps: int = STEPS) -> list[Filling]:
    """Undominated ways to fill a room up to a waste of slack, least waste first and of those the fewest, longest items first.

    A filling is dominated if its items could stand in for those of another
    one, cut apart: the other then leaves the easier rest. One item that
    fits exactly dominates all.
    """
    if counts.get(room):
        return [((room, 1),)]
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    if not lengths:
        return [()] if room <= slack else []
    found: list[tuple[int, Filling]] = []
    # depth first, longest items and most copies first; a frame: next length, room left, chosen
    stack: list[tuple[int, int, Filling]] = [(0, room, ())]
    while stack and steps and len(found) < 4 * most:
        steps -= 1
        at, left, chosen = stack.pop()
        while at < len(lengths) and lengths[at] > left:
            at += 1
        if at == len(lengths):
            if left <= slack:
                found.append((left, chosen))
            continue
        length = lengths[at]
        copies = min(counts[length], left // length)
        if left <= slack + length or at + 1 < len(lengths):
            for n in range(max(copies - 2, 0), copies + 1):
                stack.append((at + 1, left - n * length, (*chosen, (length, n)) if n else chosen))
        else:
            stack.append((at + 1, left - copies * length, (*chosen, (length, copies))))
    found.sort(key=lambda x: (x[0], sum(n for _, n in x[1])))
    kept: list[tuple[Filling, list[int]]] = []
    for _, one in found:
        items = [x for x, n in one for _ in range(n)]
        if len(items) <= 6 and any(len(other) <= 6 and _covers(other, items) for _, other in kept):
            continue
        kept.append((one, items))
        if len(kept) == most:
            break
    return [one for one, _ in kept]


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """The fewest sequences that the search finds for so many pieces of each length.

    Best fit gives the first incumbent. While it is above the waste bound, the
    longest length that is left is completed by each of its undominated
    fillings in turn, as often at once as the counts allow; a branch ends as
    soon as its waste rules out one sequence fewer than the incumbent has, and
    every 32nd node finishes its rest by best fit. The search is depth
    first and ends at the bound or after so many nodes.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    size = lambda p: sum(times for times, _ in p)
    bound, total = fewest(counts, capacity), sum(x * n for x, n in counts.items())
    left = dict(counts)
    path: list[tuple[int, Filling, int]] = []  # times, filling, waste of one
    waste = 0
    tries: list[list[Filling]] = []
    top = size(best)
    spent = 0

    def undo() -> None:
        nonlocal waste
        times, filling, lost = path.pop()
        waste -= times * lost
        for x, n in filling:
            left[x] = left.get(x, 0) + times * n

    down = True
    while top > bound:
        slack = (top - 1) * capacity - total - waste  # what may still be wasted
        if down:
            spent += 1
            if spent > nodes:
                break
            if not left:
                best = [(times, filling) for times, filling, _ in path]
                top = size(best)
                down = False
                continue
            if spent % 32 == 0:
                rest = best_fit(left, capacity)
                if (here := size(rest) + sum(times for times, _, _ in path)) < top:
                    best, top = [(times, filling) for times, filling, _ in path] + rest, here
                    continue
            longest = max(left)
            others = dict(left)
            others[longest] -= 1
            tries.append(fillings(others, capacity - longest, slack)[::-1] if slack >= 0 else [])
        elif path and len(path) == len(tries):
            undo()
        down = False
        if not tries:
            break
        if not tries[-1]:
            tries.pop()
            continue
        filling = dict(tries[-1].pop())
        longest = max(left)
        filling[longest] = filling.get(longest, 0) + 1
        lost = capacity - sum(x * n for x, n in filling.items())
        slack = (top - 1) * capacity - total - waste
        times = min(left[x] // n for x, n in filling.items())
        if lost:
            times = min(times, slack // lost)
        if times <= 0:
            continue
        whole = tuple(sorted(filling.items(), reverse=True))
        path.append((times, whole, lost))
        waste += times * lost
        for x, n in whole:
            left[x] -= times * n
            if not left[x]:
                del left[x]
        down = True
    return best


#: Words of these characters are read here: composed as they are, without white space, and their lower case depends on no neighbour.
_PLAIN = re.compile(r"[!-~\u00a1-\u024f]*")


class _Words:
    """Ids of a text, by its words between ASCII white space, which no token crosses; ids of words are remembered up to a number.

    A new word of plain characters is lower-cased and split as the file says,
    and the file's own BPE model reads the parts, without the bookkeeping of
    places in the text that the whole tokenizer has (half of its time). Other words go
    through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole, spec = Tokenizer.from_file(path), json.loads(Path(path).read_text())
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"] + "|\n").findall
        self.added = tuple(t["content"] for t in spec["added_tokens"])
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []})).model
        # the byte-level alphabet: visible bytes are themselves, the others come from U+0100 on
        others = iter(range(256, 512))
        self.alphabet = {b: b if b in range(0x21, 0x7F) or b in range(0xA1, 0x100) and b != 0xAD else next(others) for b in range(256)}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.alphabet))
        got = self.parts[part] = array("I", [t.id for t in tokens]).tobytes()
        return got

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode(errors="replace") for w in new]
        if not (_PLAIN.fullmatch("".join(texts)) and not any(x in t for t in texts for x in self.added)):
            plain = [bool(_PLAIN.fullmatch(t)) and not any(x in t for x in self.added) for t in texts]
            for w, t in ((w, t) for w, t, p in zip(new, texts, plain, strict=True) if not p):
                self.words[w] = np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            new, texts = ([x for x, p in zip(of, plain, strict=True) if p] for of in (new, texts))
        known, part = self.parts.get, self._part
        # all at once, a line each
        ids, order = [], iter(new)
        for p in self.split("\n".join([*texts, ""]).lower()):
            if p == "\n":
                self.words[next(order)] = b"".join(ids)
                ids = []
            else:
                ids.append(known(p) or part(p))

    def ids(self, text: bytes) -> Iterator[bytes]:
        """The ids, as little-endian 32-bit numbers, in parts."""
        at = 0
        while at < len(text):
            end = at + SEGMENT
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            words = text[at:end].split()
            if len(self.words) > REMEMBERED:
                self.words.clear()
            self._learn(list(set(words).difference(self.words)))
            yield b"".join(map(self.words.__getitem__, words))
            at = end


def _pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; part, the task, and at, the number of the task's earlier pieces of that length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = _Words(public_tokenizers.path(vocabulary)), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        last, size = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            text = batch.column(1).cast(pa.large_binary())
            for row in range(len(batch)):
                held, piece = b"", 0
                for more in chain(words.ids(text[row].as_py() or b""), (last,)):
                    held += more
                    while len(held) > size:  # at least one id more, so the piece is whole
                        rows.append((piece, piece * capacity, capacity, zlib.crc32(held[:size]), part, seen[capacity]))
                        owner.append(row)
                        seen[capacity] += 1
                        held, piece = held[size:], piece + 1
                length = len(held) // 4
                rows.append((piece, piece * capacity, length, zlib.crc32(held), part, seen[length]))
                owner.append(row)
                seen[length] += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, at long")


def _ranges(made: Plan) -> tuple[np.ndarray, ...]:
    """The plan as ranges of pieces' ranks within their length, sorted by length and first rank: (length << 44 | first rank, times, first sequence, first offset)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, filling in made:
        offset = 0
        for length, copies in filling:
            rows.append((length << 44 | used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def complete_bins(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "word_bpe_49k.json", nodes: int = NODES) -> DataFrame:
    """Documents in as few sequences of at most ``capacity`` ids as the search finds; only longer ones are cut.

    A document is its text's ids and then ``end_id``; of one longer than
    ``capacity`` whole sequences are cut, the last piece may be shorter. Tasks
    read the ids once and write the pieces' lengths and checksums. How many
    pieces have each length (at most ``capacity`` numbers, however many
    documents there are) goes to the planner: bin completion, branch and bound
    over the undominated fillings around the longest piece, with best-fit
    solutions as incumbents (see plan). Equal lengths are interchangeable, so
    the plan is a table of ranges of ranks within a length, of at most some ten
    thousand rows, and each piece finds its place by its rank: its number in
    its task plus those of that length in earlier tasks. No piece meets another one, so no
    group is gathered, whatever length a third of them has.

    Rows: id, piece, start, length, ids_crc32 (of little-endian unsigned
    32-bit ids), sequence_id (from 0), offset (in the sequence, gapless from
    0). Null and empty texts are the end id alone; rows with equal ids are
    packed apart; bytes that are not UTF-8 count as U+FFFD; an empty table
    gives no rows; further columns are ignored. Strings of added tokens in a
    text get their ids, as the `tokenizers` file has it.
    """
    spark = docs.sparkSession
    pieces = stored(_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), capacity, end_id, vocabulary))
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranges = spark.sparkContext.broadcast(_ranges(plan(counts, capacity, nodes)))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    before = per_part.select("length", "part", earlier.alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, times, sequence, offset = ranges.value
        for batch in batches:
            if not len(batch):
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(first, length << 44 | rank, "right") - 1
            nth = (length << 44 | rank) - first[at]
            copy, which = np.divmod(nth, times[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + which), pa.array(offset[at] + copy * length)], names)

    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("before")).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)

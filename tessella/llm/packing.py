"""Packing token pieces into sequences: best fit, then swap-based local search."""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.byte_bpe import byte_letters
from tessella.llm.frames import small_batches
from tessella.plans.lineage import cut

CAPACITY = 2048
#: Pieces packed together. A group leaves less than one sequence unfilled, one in some thousands.
GROUP = 16_384


@functools.lru_cache(2)
def tokenizer(path: str) -> tuple[tiktoken.Encoding, set[str]]:
    """The vocabulary of a byte-level tokenizer file as a faster encoder of the same ids, and its special tokens.

    In such a file the id of a token is its rank among the merges. The tokenizers library takes special tokens found
    in a text for what they are, whatever ``add_special_tokens``; so does the encoder if it is given them.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ahead = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or ahead["type"] != "ByteLevel" or ahead["add_prefix_space"] or not ahead["use_regex"] or spec["normalizer"]:
        raise ValueError(f"{path} is no byte-level BPE without normaliser")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), set(special)


def encode(path: str, text: str) -> bytes:
    """Ids of a whole text, as little-endian 32-bit numbers."""
    encoding, special = tokenizer(path)
    allowed = special if any(s in text for s in special) else set()
    return encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4").tobytes()


def best_fit(lengths: list[int], capacity: int, longest_first: bool = False) -> list[list[int]]:
    """Bins of positions in ``lengths``: in the order given or longest first, each into the fullest bin that has room for it.

    Bins are kept by their room; the bits of one number tell which rooms exist.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    order = range(len(lengths))
    for i in sorted(order, key=lambda i: (-lengths[i], i)) if longest_first else order:
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(at)
        rooms |= 1 << room - n
    return bins


class _Search:
    """Bins while they exchange pieces. Those that may still take some are listed by their room and by the lengths they hold.

    Pieces of one length are alike. ``reach[b]`` is ``b`` and the room of the roomiest listed bin that holds a piece of length
    ``b``: the largest sum such a bin could take for it.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.capacity = capacity
        self.held: list[dict[int, list[int]]] = []
        for items in bins:
            by: dict[int, list[int]] = {}
            for i in items:
                by.setdefault(lengths[i], []).append(i)
            self.held.append(by)
        self.room = [capacity - sum(lengths[i] for i in items) for items in bins]

    def list_all(self) -> None:
        self.listed = [False] * len(self.room)
        self.by_room: list[dict[int, None]] = [{} for _ in range(self.capacity + 1)]
        self.rooms = 0  # bit r: a listed bin has room r
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]
        self.reach = np.zeros(self.capacity + 1, "i8")
        for b, room in enumerate(self.room):
            if 0 < room < self.capacity:
                self.enter(b)

    def enter(self, b: int) -> None:
        room = self.room[b]
        self.listed[b] = True
        self.by_room[room][b] = None
        self.rooms |= 1 << room
        for length in self.held[b]:
            heapq.heappush(self.heaps[length], (-room, b))
            self.look(length)

    def leave(self, b: int) -> None:
        room = self.room[b]
        self.listed[b] = False
        del self.by_room[room][b]
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        for length in self.held[b]:
            self.look(length)

    def look(self, length: int) -> None:
        heap = self.heaps[length]
        while heap and not (self.listed[b := heap[0][1]] and self.room[b] == -heap[0][0] and length in self.held[b]):
            heapq.heappop(heap)
        self.reach[length] = length - heap[0][0] if heap else 0

    def give(self, length: int, a: int, b: int) -> None:
        pieces = self.held[a][length]
        self.held[b].setdefault(length, []).append(pieces.pop())
        if not pieces:
            del self.held[a][length]
        self.room[a] += length
        self.room[b] -= length

    def exchange(self, s: int) -> bool:
        """The exchange that moves most tokens from bin ``s`` to a listed bin; False if there is none.

        For a piece of length ``b`` a bin with room ``r`` takes a sum ``g`` if ``b < g <= b + r``. So of each length only the
        roomiest bin counts, and of the lengths the smallest whose reach is at least ``g`` moves most.
        """
        most = self.rooms.bit_length() - 1
        own = sorted(self.held[s])
        moved = given = max((n for n in own if n <= most), default=0)
        taken, sets = 0, [(n,) for n in own] + [(n, m) for k, n in enumerate(own) for m in own[k if len(self.held[s][n]) > 1 else k + 1 :]]
        sums = np.fromiter(map(sum, sets), "i8", len(sets))
        least = np.searchsorted(np.maximum.accumulate(self.reach), sums)
        gain = sums - least
        top = int(np.argmax(np.where(least <= self.capacity, gain, 0)))
        if least[top] <= self.capacity and gain[top] > moved:
            moved, given, taken = int(gain[top]), sets[top], int(least[top])
            other = self.heaps[taken][0][1]
        elif moved:
            fitting = self.rooms >> moved
            other, given = next(reversed(self.by_room[moved + (fitting & -fitting).bit_length() - 1])), (moved,)
        else:
            return False
        self.leave(other)
        if taken:
            self.give(taken, other, s)
        for length in given:
            self.give(length, s, other)
        if self.room[other]:
            self.enter(other)
        return True


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Fewer bins, by exchanges that each raise the sum of squared fills.

    Bins that are not full have a turn each, the emptiest first, and give to those whose turn is still to come, which are as
    full or fuller: a piece into the tightest room, one of its pieces for a shorter one, or two for one shorter than both
    together, always the exchange that moves most. An emptied bin goes; one that no exchange can lower is left. Rounds go on
    while anything moves, or until the lower bound on the number of bins is met. As every exchange raises the sum of squares,
    they end.
    """
    state, alive, least = _Search(bins, lengths, capacity), len(bins), -(-sum(lengths) // capacity)
    moving = True
    while moving and alive > least:
        moving = False
        state.list_all()
        while alive > least and state.rooms:
            s = next(reversed(state.by_room[state.rooms.bit_length() - 1]))
            state.leave(s)
            while state.held[s] and state.exchange(s):
                moving = True
            alive -= not state.held[s]
    return [sorted(i for pieces in x.values() for i in pieces) for x in state.held if x]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``, each of at most ``capacity``, as few as the search finds.

    Pieces go by best fit in the order given, and local search empties what bins it can. Where that stays above the lower
    bound, it also starts from best fit with the longest first, and the fewer bins count.
    """
    packed = local_search(best_fit(lengths, capacity), lengths, capacity)
    if len(packed) > -(-sum(lengths) // capacity):
        packed = min(packed, local_search(best_fit(lengths, capacity, longest_first=True), lengths, capacity), key=len)
    return packed


def cut_pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32``.

    Rows come straight from the task that encodes. An array of pieces from a function, spread by a generator, would have every
    text encoded twice: Spark infers a filter on the array and evaluates the function for it once more.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(path, text or "") + bytes(4)  # id 0 ends a document
                n = len(ids) // 4
                count = -(-n // capacity)
                first = n - capacity * (count - 1)
                starts = [0, *(first + capacity * k for k in range(count - 1))]
                ends = [*starts[1:], n]
                owner += [at] * count
                found += [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
            numbers = np.array(found, "i8").reshape(-1, 4).T
            columns = [pa.array(x, kind) for x, kind in zip(numbers, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), *columns], names=names)

    return rows.mapInArrow(pieces, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with ``sequence_id`` and ``offset``.

    A document is its ids by the tokenizer file and id 0. Only one longer than ``capacity`` is cut, from its end, into
    pieces of ``capacity`` tokens; what is left comes first. Pieces are dealt by a hash into groups of about ``group``
    rows, whatever the corpus, and each group is packed by best fit and local search in one task; only lengths travel,
    no text. Groups are alike, so a hot source or length is spread over all of them. Their number follows the input.

    Null text counts as empty: one piece of id 0. Repeated rows are packed each for itself. Columns other than id and
    text are not used. An empty table gives an empty result.
    """
    pieces = cut(cut_pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), capacity, id_col, text_col))
    groups = max(1, round(pieces.count() / group))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    keys = ["doc_id", "piece", "ids_crc32"]

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(keys, kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        sequence, offset = np.empty(len(rows), "i8"), np.empty(len(rows), "i8")
        for k, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = (key[0] << 32) + k, at
                at += lengths[i]
        return rows.drop(columns="group").assign(sequence_id=sequence, offset=offset)

    return pieces.withColumn("group", F.pmod(F.xxhash64(*keys), F.lit(groups))).groupBy("group").applyInPandas(packed, schema)

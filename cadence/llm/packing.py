"""Best-fit packing of token sequences: length patterns fitted to the histogram by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.llm.shared import byte_slices, give_back, joinable, keep, returning_memory
from cadence.llm.token_counts import forget_tokenizers, load_tokenizer

CAPACITY = 4096
#: Bytes of text whose words are looked up at once.
SLICE = 1 << 20
#: Lengths are fitted in this many steps of the capacity, by patterns of so many documents at most.
STEPS, PARTS = 64, 3


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by an active set that takes in the column of the steepest gain."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= slack:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            solved = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if solved.min(initial=1) > 0:
                x[:] = 0
                x[at] = solved
                break
            low = solved <= 0
            step = (x[at][low] / np.maximum(x[at][low] - solved[low], 1e-300)).min()
            moved = x[at] + step * (solved - x[at])
            x[:] = 0
            x[at] = np.maximum(moved, 0)
            drop = at[(moved <= 1e-12) & low]
            drop = drop if len(drop) else at[low][:1]
            x[drop] = 0
            active[drop] = False
    return x


@cache
def patterns(steps: int = STEPS, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Every way to fill ``steps`` with ``parts`` lengths at most, each the longest first."""

    def fill(left: int, most: int, n: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif n:
            for k in range(min(left, most), (left - 1) // n, -1):
                for rest in fill(left - k, k, n - 1):
                    yield (k, *rest)

    return list(fill(steps, steps, parts))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold each length of the histogram as often as it says, lengths from 1 to ``capacity``.

    What it handles is the histogram, so its time and memory depend on the
    capacity and not on the number of documents.
    """
    steps = min(steps, capacity)
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    step_of = -(-np.arange(capacity + 1) * steps // capacity)
    binned = np.bincount(step_of, left, minlength=steps + 1)
    ways = patterns(steps, parts)
    matrix = np.zeros((steps + 1, len(ways)))
    for j, way in enumerate(ways):
        np.add.at(matrix[:, j], list(way), 1)
    fitted = nnls(matrix, binned)
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(capacity + 1, np.int64)

    def add(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        open_.setdefault(gap, []).append((lengths, n))
        gaps[gap] += n

    members = [np.flatnonzero(step_of == k)[::-1] for k in range(steps + 1)]
    for j in np.argsort(-fitted, kind="stable").tolist():
        way = ways[j]
        repeats = int(round(fitted[j]))
        while repeats > 0:  # runs of equal lengths, the longest of each step first; the last is the one that fits best
            taken: list[int] = []
            for k in way[:-1]:
                taken.append(next((int(x) for x in members[k] if left[x] > taken.count(x)), 0))
            if 0 in taken:
                break
            room = capacity - sum(taken)
            fits = np.flatnonzero(left[: room + 1])
            last = next((x for x in fits[::-1].tolist() if left[x] > taken.count(x)), 0)
            if not last:
                break
            taken.append(last)
            n = min([repeats, *(int(left[x]) // taken.count(x) for x in set(taken))])
            for x in taken:
                left[x] -= n
            add(tuple(taken), n)
            repeats -= n
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = int(fits[0]) + length
                lengths, m = open_[gap].pop()
                used = min(m, n)
                gaps[gap] -= m
                if m > used:
                    add(lengths, m - used)
                add((*lengths, length), used)
                n -= used
            else:
                most = capacity // length
                if n >= most:
                    add((length,) * most, n // most)
                if n % most:
                    add((length,) * (n % most), 1)
                n = 0
    return [x for same in open_.values() for x in same]


class Slots:
    """Where the piece of a given length and rank among those of its length goes."""

    _FAR = 1 << 42

    def __init__(self, planned: list[tuple[tuple[int, ...], int]]):
        runs, sequence, used = [], 0, {}
        for lengths, n in planned:
            at = 0
            for length in lengths:
                first = used.get(length, 0)
                runs.append((length * self._FAR + first, sequence, at))
                used[length] = first + n
                at += length
            sequence += n
        table = np.array(sorted(runs), np.int64).reshape(-1, 3)
        self.keys, self.sequence, self.offset = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length.astype(np.int64) * self._FAR + rank
        run = np.searchsorted(self.keys, key, side="right") - 1
        return self.sequence[run] + key - self.keys[run], self.offset[run]


def encode_words(tokenizer, words: list[str], together: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids; words are encoded ``together`` with spaces between, where no token reaches across, and told apart by offsets."""
    sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for at in range(0, len(words), together * 64):
        some = words[at : at + together * 64]
        groups = [some[k : k + together] for k in range(0, len(some), together)]
        for group, e in zip(groups, tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            starts = np.cumsum([0, *(len(w) + 1 for w in group)])[:-1]
            own = np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
            sizes.append(np.bincount(np.searchsorted(starts, own, side="right") - 1, minlength=len(group)))
            flat.append(np.array(e.ids, np.uint32))
    return np.concatenate(sizes), np.concatenate(flat)


class WordIds:
    """The ids of words. The first ``most`` words that a worker meets, the frequent ones among them, stay known; others are encoded anew for each slice.

    Known words are found by 64 bits of their hash and then compared, so that
    two words of one hash are never taken for each other.
    """

    def __init__(self, tokenizer, most: int = 400_000):
        self.tokenizer, self.most = tokenizer, most
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.words = pa.array([], pa.string())
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each of the distinct words' ids begin in a table, how many they are, and the table."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        place = np.full(len(words), -1, np.int64)
        if len(self.hashes):
            hit = np.flatnonzero(self.hashes[at] == hashes)
            same = pc.equal(words.take(pa.array(hit)), self.words.take(pa.array(self.place[at[hit]]))).to_numpy(zero_copy_only=False)
            place[hit[same]] = self.place[at[hit[same]]]
        new = np.flatnonzero(place < 0)
        added = words.take(pa.array(new))
        sizes, ids = encode_words(self.tokenizer, added.to_pylist())
        starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        every, table = np.concatenate([self.sizes, sizes.astype(np.int32)]), np.concatenate([self.ids, ids])
        known = len(self.words)
        place[new] = known + np.arange(len(new))
        stay = max(0, min(len(new), self.most - known))
        if stay:
            self.words = pa.concat_arrays([self.words, added[:stay]])
            joined, owner = np.concatenate([self.hashes, hashes[new[:stay]]]), np.concatenate([self.place, place[new[:stay]]])
            order = np.argsort(joined, kind="stable")
            self.hashes, self.place = joined[order], owner[order]
            self.starts, self.sizes = starts[: known + stay], every[: known + stay]
            self.ids = table[: len(self.ids) + int(sizes[:stay].sum())]
        return starts[place], every[place].astype(np.int64), table


_known: dict[str, WordIds] = {}


def known_words(source: str) -> WordIds:
    """Of a tokenizer, kept for the life of the worker."""
    if source not in _known:
        _known.clear()
        _known[source] = WordIds(load_tokenizer(source))
    return _known[source]


def forget_words() -> None:
    """Lets a worker's words and tokenizer go: it lives on beside the heap after its pieces are encoded."""
    _known.clear()
    forget_tokenizers()


def token_ids(known: WordIds, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in order and how many each has, for tokenizers that drop white space.

    No token of theirs spans white space, so each distinct run of other
    characters is encoded once.
    """
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    starts, sizes, table = known.find(coded.dictionary)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    by_word = sizes[codes]
    upto = np.concatenate([[0], np.cumsum(by_word)])
    at = np.repeat((starts[codes] - upto[:-1]).astype(np.int32), by_word)  # a slice's table is far below 2 ** 31
    at += np.arange(len(at), dtype=np.int32)
    return table[at], np.diff(upto[ends])


def cut_pieces(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each piece of documents of so many ids (one at least): the document, the piece's number there, the ids before it, and its length."""
    pieces = -(-counts // capacity)
    owner = np.repeat(np.arange(len(counts)), pieces)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    return owner, piece, start, np.minimum(capacity, counts[owner] - start)


def ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The rank of each length among its equals, after the ``seen`` ones of each length, which are brought up to date."""
    order = np.argsort(lengths, kind="stable")
    of = lengths[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    rank = np.empty(len(of), np.int64)
    rank[order] = np.arange(len(of)) - np.repeat(first, np.diff(np.concatenate([first, [len(of)]]))) + seen[of]
    seen += np.bincount(lengths, minlength=len(seen))
    return rank


def encode_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and the place of the piece among those of its length in its task."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = known_words(source.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                ids, counts = token_ids(known, part.column("text"))
                ends = np.cumsum(counts + 1)
                every = np.full(int(ends[-1]), end_id, "<u4")
                every[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                owner, piece, start, length = cut_pieces(counts + 1, capacity)
                at = (ends - counts - 1)[owner] + start
                data = memoryview(every).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                columns = [part.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.full(len(owner), task, np.int32)), pa.array(ranks(length, seen))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(every)).astype(np.int32)), pa.array(every.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                del ids, every, columns, data
                give_back(collect=False)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(returning_memory(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of ``capacity`` tokens at most: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only documents longer than the
    capacity are cut. The driver gets the histogram of lengths (``capacity``
    rows at most) and plans on it; a piece finds its slot by its length and its
    rank among those of its length. A null or empty text is ``end_id`` alone;
    repeated rows are each packed; other columns are ignored; no rows give no
    rows. ``with_ids`` adds the ids.
    """
    pieces = keep(encode_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counted = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = keep(counted.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    histogram = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(Slots(plan(histogram, capacity)))
    give_back()  # on the driver
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch in batches:
            rank = batch.column("place").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = slots.value.find(batch.column("length").to_numpy(), rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    placed = pieces.join(joinable(bases.select("task", "length", "base"), 200_000), ["task", "length"]).select(*names, "place", "base")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(returning_memory(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")

"""Byte-level BPE over a table of distinct words: each word is encoded and decoded once, and both go back to texts by position.

Texts are cut into blocks of bounded size. A block has a table of its distinct
words, most frequent first, and its texts as positions in that table. Words of
all blocks meet in shards by their hash, where each distinct word gets a number
and is encoded once. The ids of the distinct words are joined to their pieces,
which gives each word's decoded bytes. Numbers lead ids and bytes back to the
blocks, in the order of a block's table, where positions are joined to them.
What is moved is a block's words, their ids and bytes, and the positions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.shared import byte_blocks, discard, keep, partitions, returning_memory
from cadence.llm.token_counts import load_tokenizer

BLOCK_BYTES = 28 << 20
#: Positions of so many words at least are sent in one row.
ROW_WORDS = 1 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words in order, and where each text's begin: a word runs to the next white space that follows other characters.

    No token of a byte-level tokenizer goes over such a place, as white space
    only begins tokens, so words can be encoded on their own.
    """
    texts = texts.fill_null("").combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.fill_null("")
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_buffer()
    data = np.frombuffer(joined, np.uint8)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.zeros(len(data) + 1, bool)
    starts[1 : len(data)] = space[1:] & ~space[:-1]
    wide = np.flatnonzero(starts[: len(data)] & (np.concatenate([[0], data[:-1]]) >= 128)) if len(data) else np.zeros(0, np.int64)
    one, two, three = (np.where(wide >= k, data[np.maximum(wide - k, 0)], 0) for k in (1, 2, 3))
    # white space beyond ASCII: U+0085 and U+00A0, or three bytes that begin like U+1680, U+2000-205F and U+3000
    starts[wide[((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81)))]] = False
    starts[edges[:-1][sizes > 0]] = True
    at = np.flatnonzero(starts[: len(data)])
    offsets = np.concatenate([at, [len(data)]]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), joined)
    return words, np.searchsorted(at, edges)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by planes of their bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _pack_ranks(x: np.ndarray) -> bytes:
    """Numbers that are mostly small, 7 bits to a byte with a mark on all but a number's last, compressed."""
    x = x.astype(np.uint32)
    sizes = 1 + sum((x >= np.uint32(1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(5):
        more = sizes > k
        out[(ends - sizes)[more] + k] = ((x[more] >> np.uint32(7 * k)) & np.uint32(127)) | ((sizes[more] > k + 1) * np.uint32(128))
    return zstandard.ZstdCompressor(level=3).compress(out.tobytes())


def _unpack_ranks(x: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    last = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    sizes, out = last - starts + 1, np.zeros(len(last), np.uint32)
    for k in range(5):
        more = sizes > k
        out[more] |= (data[starts[more] + k] & np.uint8(127)).astype(np.uint32) << np.uint32(7 * k)
    return out


def _unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(part: pa.RecordBatch) -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
    """A name for the block, its distinct words with the most frequent first, all words' positions among them, and where each text's begin."""
    words, edges = split_words(part.column("text"))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    name = xxhash.xxh3_64(repr((part.column("doc_id").to_pylist(), edges.tolist())).encode())
    if len(words):
        name.update(words.buffers()[2])
    return name.intdigest() - (1 << 63), coded.dictionary.take(pa.array(order)), rank[codes], edges


_ROWS = "block long, kind int, shard int, no long, numbers binary, strings binary, docs array<long>, words array<array<int>>"
_NAMES = ["block", "kind", "shard", "no", "numbers", "strings", "docs", "words"]


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, kinds)], _NAMES)


def word_lists(docs: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each block and shard the block's distinct words in it, and their places in the block's table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_blocks(batches, "text", block_bytes):
            name, table, _, _ = _blocks(part)
            own = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) % shards for w in table), np.int64, len(table))
            by_shard = np.argsort(own, kind="stable")
            ends = np.searchsorted(own[by_shard], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(ends)).tolist():
                at = by_shard[ends[s] : ends[s + 1]]
                words = table.take(pa.array(at))
                flat = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer()
                numbers = np.concatenate([np.diff(at, prepend=0), pc.binary_length(words).to_numpy()])
                yield _rows([{"block": name, "shard": s, "numbers": _pack(numbers), "strings": zstandard.ZstdCompressor(level=1).compress(flat)}])

    return docs.mapInArrow(returning_memory(run), _ROWS)


def encode_lists(lists: DataFrame, source) -> DataFrame:
    """Of a shard, kind 0: the ids of its distinct words, each encoded once, from number ``no`` on; kind 2: for each block the places of its words and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(source.value)
        shard, known = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("shard")[i].as_py() != shard:
                    shard, known = batch.column("shard")[i].as_py(), {}
                places, lengths = np.split(_unpack(batch.column("numbers")[i].as_py()), 2)
                flat = zstandard.ZstdDecompressor().decompress(batch.column("strings")[i].as_py())
                ends = np.cumsum(lengths, dtype=np.int64).tolist()
                words = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]
                new = [w for w in words if w not in known]
                first = len(known)
                known.update(zip(new, range(first, first + len(new))))
                out = [{"block": batch.column("block")[i].as_py(), "kind": 2, "shard": shard, "numbers": _pack(np.concatenate([places, [known[w] for w in words]]))}]
                if new:
                    ids = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
                    out.append({"kind": 0, "shard": shard, "no": first, "words": ids})
                yield _rows(out)

    return lists.repartition(partitions(lists.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(returning_memory(run), _ROWS)


def joined_pieces(each: DataFrame, pieces: DataFrame) -> DataFrame:
    """``each`` (id and others) with the piece of each id; the pieces are as many as the vocabulary has ids, whatever the data."""
    return each.join(F.broadcast(pieces), "id", "left")


def decoded_words(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """Of a shard, kind 1: the bytes that its distinct words' ids decode to, in the order of the words' numbers.

    The ids become rows that are joined to their pieces. The join streams them
    past the broadcast pieces, so that those of a word stay together in order;
    rows out of order would fail the run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, lengths, parts, last = None, 0, [], [], -1

        def done() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
            return _rows([{"kind": 1, "shard": shard, "no": first, "numbers": _pack_ranks(np.concatenate(lengths)), "strings": blob}])

        for batch in batches:
            if not batch.num_rows:
                continue
            own, no, at = (batch.column(c).to_numpy() for c in ("shard", "no", "at"))
            sizes = pc.binary_length(batch.column("piece")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            blob = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(no)], pa.int32()), batch.column("piece").fill_null(b"")), b"")[0].as_py()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(no)]
            for a, b in zip(edges, edges[1:]):
                if own[a] != shard:
                    if shard is not None:
                        yield done()
                    shard, first, lengths, parts, last = own[a], int(no[a]), [], [], int(no[a]) - 1
                step = np.diff(no[a:b], prepend=last)
                if ((step < 0) | (step > 1) | ((step == 1) & (at[a:b] != 0))).any():
                    raise RuntimeError("the ids of words came out of order")
                starts = np.flatnonzero(step == 1)
                by_word = np.add.reduceat(sizes[a:b], starts) if len(starts) else np.zeros(0, np.int64)
                if not len(starts) or starts[0]:  # the batch begins within a word
                    lengths[-1][-1] += sizes[a : a + (starts[0] if len(starts) else b - a)].sum()
                if len(by_word):
                    lengths.append(by_word)
                parts.append(blob[ends[a] : ends[b]])
                last = int(no[b - 1])
        if shard is not None:
            yield done()

    words = encoded.where("kind = 0").select("shard", "no", "words").repartition(partitions(encoded.sparkSession), "shard").sortWithinPartitions("shard", "no")
    each = words.select("shard", "no", F.posexplode("words").alias("i", "ids")).select("shard", (F.col("no") + F.col("i")).alias("no"), F.posexplode("ids").alias("at", "id"))
    return joined_pieces(each, pieces).select("shard", "no", "at", "piece").mapInArrow(returning_memory(run), _ROWS)


def block_tables(encoded: DataFrame, decoded: DataFrame) -> DataFrame:
    """For each block and shard the places of its words, their ids and their decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "kind", "shard", "no", "numbers", "strings", "words")]
            for block, kind, own, no, numbers, strings, words in zip(*columns):
                if own != shard:
                    shard, ids, texts = own, [], []
                if kind == 0:
                    ids.extend(words)
                elif kind == 1:
                    flat, ends = zstandard.ZstdDecompressor().decompress(strings), np.cumsum(_unpack_ranks(numbers), dtype=np.int64).tolist()
                    texts = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]
                else:
                    places, nos = np.split(_unpack(numbers), 2)
                    held, blobs = [ids[k] for k in nos.tolist()], [texts[k] for k in nos.tolist()]
                    sizes, lengths = [len(x) for x in held], [len(x) for x in blobs]
                    packed = _pack(np.concatenate([[len(held)], places, sizes, lengths, *held]))
                    yield _rows([{"block": block, "kind": 0, "numbers": packed, "strings": zstandard.ZstdCompressor(level=6).compress(b"".join(blobs))}])

    rows = encoded.union(decoded)
    # of a shard the ids come first, in the order of the words' numbers, then the bytes, then the blocks
    return rows.repartition(partitions(encoded.sparkSession), "shard").sortWithinPartitions("shard", "kind", "no").mapInArrow(returning_memory(run), _ROWS)


def positions(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The texts of each block as places in its table of words, many texts to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_blocks(batches, "text", block_bytes):
            name, _, codes, edges = _blocks(part)
            ids = part.column("doc_id").to_pylist()
            first = 0
            while first < len(ids):
                end = max(first + 1, int(np.searchsorted(edges, edges[first] + ROW_WORDS, side="right")) - 1)
                end = min(end, len(ids))
                yield _rows([{"block": name, "kind": 1, "numbers": _pack_ranks(np.concatenate([np.diff(edges[first : end + 1]), codes[edges[first] : edges[end]]])), "docs": ids[first:end]}])
                first = end

    return docs.mapInArrow(returning_memory(run), _ROWS)


def piece_bytes(source: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    # Fixed values of the byte-level format: printable Latin-1 bytes stand for themselves, the others for U+0100 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    spec = json.loads(source)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    to_bytes = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
    return [to_bytes(names.get(i, "")) for i in range(max(names) + 1)]


def piece_table(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """(id, piece), as many rows as the vocabulary has ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return spark.createDataFrame(list(enumerate(piece_bytes(f.read()))), "id int, piece binary")


def decode_ids(rows: DataFrame, tokenizer_path: str, key_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(key, text): joins each id to its piece and the pieces of a row in order; null ids give null, bytes that are no UTF-8 are replaced."""
    named = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key_col).alias("key"), F.col(ids_col).alias("ids"))
    each = named.select("row", "key", F.col("ids").isNull().alias("none"), F.posexplode_outer("ids").alias("at", "id"))
    inorder = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: F.hex(x["piece"]))
    joined = joined_pieces(each, piece_table(rows.sparkSession, tokenizer_path)).groupBy("row", "key", "none").agg(F.unhex(F.array_join(inorder, "")).alias("bytes"))
    return joined.select(F.col("key").alias(key_col), F.when(~F.col("none"), F.decode("bytes", "UTF-8")).alias("text"))


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row; ``with_ids`` and ``with_text`` add the ids and the decoded text.

    ids_sha256 is that of the decimal ids joined by commas, decoded_sha256 that
    of the text the ids decode to, in UTF-8. A null text counts as empty;
    repeated rows are each returned; other columns are ignored; no rows give no
    rows. Ids of documents must be integers. The text is read twice and must
    come in the same order both times, as from files; if not, the run fails.
    """
    with open(tokenizer_path, encoding="utf-8") as f:  # the vocabulary's size is fixed, whatever the data
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    pieces = piece_table(docs.sparkSession, tokenizer_path)
    n_ids = len(piece_bytes(source.value))
    shards = partitions(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers_of = [b"%d" % i for i in range(n_ids)]
        block, decimals, decoded, counts, raw = None, {}, {}, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("block")[i].as_py() != block:
                    block, decimals, decoded, counts, raw = batch.column("block")[i].as_py(), {}, {}, {}, {}
                packed = batch.column("numbers")[i].as_py()
                if batch.column("kind")[i].as_py() == 0:
                    numbers = _unpack(packed)
                    n = int(numbers[0])
                    places = np.cumsum(numbers[1 : n + 1], dtype=np.int64).tolist()
                    sizes, lengths = (numbers[1 + k * n : 1 + (k + 1) * n].tolist() for k in (1, 2))
                    ids = numbers[1 + 3 * n :].tolist()
                    flat = zstandard.ZstdDecompressor().decompress(batch.column("strings")[i].as_py())
                    at = place_in_flat = 0
                    for place, size, length in zip(places, sizes, lengths):
                        own = ids[at : at + size]
                        at += size
                        decimals[place] = b",".join([numbers_of[x] for x in own])
                        decoded[place] = flat[place_in_flat : place_in_flat + length]
                        place_in_flat += length
                        counts[place] = size
                        if with_ids:
                            raw[place] = own
                    continue
                numbers = _unpack_ranks(packed)
                docs_here = batch.column("docs")[i].as_py()
                words = numbers[: len(docs_here)].tolist()
                codes = numbers[len(docs_here) :].tolist()
                out, at = [], 0
                for doc, n in zip(docs_here, words):
                    own = codes[at : at + n]
                    at += n
                    text = b"".join([decoded[c] for c in own]).decode("utf-8", "replace")
                    row = [doc, sum([counts[c] for c in own]), hashlib.sha256(b",".join([decimals[c] for c in own])).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                    row += [[x for c in own for x in raw[c]]] if with_ids else []
                    out.append(row + [text] * with_text)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * with_ids, *[pa.string()] * with_text]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    encoded = keep(encode_lists(word_lists(plain, shards, block_bytes), source), "words")
    tables = keep(block_tables(encoded, decoded_words(encoded, pieces)), "tables")
    discard(encoded)
    joined = tables.union(positions(plain, block_bytes)).repartition(shards, "block").sortWithinPartitions("block", "kind")
    return joined.mapInArrow(returning_memory(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", text string" * with_text)

"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.circulant import CirculantMinHash
from cadence.llm.components import components
from cadence.llm.shared import byte_slices, joinable, keep, partitions, returning_memory
from cadence.llm.shingles import shingle_sets

BANDS, ROWS = 32, 4
#: Documents in a block of a large group of candidates; a verifying task holds two blocks.
BLOCK = 256
#: Bytes of text whose shingles are made at once.
SLICE = 3 << 20
_hashers: dict[tuple[int, int], CirculantMinHash] = {}


def _hasher(coordinates: int, seed: int) -> CirculantMinHash:
    if (coordinates, seed) not in _hashers:
        _hashers[coordinates, seed] = CirculantMinHash(coordinates, seed=seed)
    return _hashers[coordinates, seed]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """(doc_id, text_hash, n_shingles, print_a, print_b, bands): the size and 128-bit fingerprint of each row's set and a hash for each band of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                sizes, prints, keys, counts = [], [], [], []
                for held in shingle_sets(part.column("text"), words):
                    sizes.append(len(held))
                    prints.append(xxhash.xxh3_128_digest(held.view(np.uint8)))
                    counts.append(bands if len(held) else 0)
                    if len(held):
                        signature = _hasher(bands * rows, seed).signature(held)
                        keys += [xxhash.xxh3_64_intdigest(signature[b * rows : (b + 1) * rows].view(np.uint8), b) for b in range(bands)]
                pair = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(keys, np.uint64).view(np.int64)))],
                    ["doc_id", "text_hash", "n_shingles", "print_a", "print_b", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text")).mapInArrow(returning_memory(run), "doc_id long, text_hash long, n_shingles long, print_a long, print_b long, bands array<long>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share; elements of one set only are dropped first."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([starts, [len(values)]]))
    found = np.zeros(m * m)
    for k in range(2, 9):  # elements of a few sets, pair by pair
        at = starts[lengths == k]
        for i in range(k if len(at) else 0):
            for j in range(i + 1, k):
                found += np.bincount(owner[at + i] * m + owner[at + j], minlength=m * m)
    found = found.reshape(m, m)
    found += found.T
    at, many = starts[lengths > 8], lengths[lengths > 8]
    for c in range(0, len(at), 2048):  # elements of many sets, as products of incidence matrices
        spans = many[c : c + 2048]
        rows = np.concatenate([owner[a : a + n] for a, n in zip(at[c : c + 2048], spans)])
        dense = np.zeros((m, len(spans)), np.float32)
        dense[rows, np.repeat(np.arange(len(spans)), spans)] = 1
        found += dense @ dense.T
    return found.astype(np.int64)


def _linked(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that join what the cell's exact links connect, one less than the members of each connected part."""
    sizes = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    left, edges = np.ones(len(ids), bool), []
    for i in range(len(ids)):
        if left[i]:
            reached = front = np.arange(len(ids)) == i
            while front.any():
                front = near[front].any(axis=0) & ~reached
                reached = reached | front
            left &= ~reached
            members = sorted({ids[k] for k in np.flatnonzero(reached)})
            edges += [(members[0], x) for x in members[1:]]
    return edges


def _star_cells(stars: DataFrame, block: int) -> DataFrame:
    """(id, grp, lo, hi): the members of each star (rep, head) in cells of about ``block``, with the head in each."""
    stars = keep(stars, "stars")
    sizes = stars.groupBy("head").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    members = stars.join(sizes, "head").select(F.col("rep").alias("id"), F.col("head").alias("grp"), own.alias("lo"), own.alias("hi"))
    centres = sizes.select(F.col("head").alias("id"), F.col("head").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("lo"))
    return members.union(centres.select("*", F.col("lo").alias("hi")))


def _rest_cells(groups: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """(id, grp, lo, hi) for the groups (node, component) that lie in several ``parts``: blocks of the classes outside the largest part meet all blocks.

    A group of two has been verified by its star.
    """
    own = parts.select("node", F.col("component").alias("part"))
    placed = groups.select("node", F.col("component").alias("grp")).join(own, "node", "left").withColumn("part", F.coalesce("part", "node"))
    largest = placed.groupBy("grp", "part").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("total"))
    open_ = placed.join(largest.where("total > most and total > 2"), "grp").withColumns({"few": F.ceil((F.col("total") - F.col("most")) / block).cast("int"), "many": F.ceil(F.col("most") / block).cast("int")})
    minor, spot = F.col("part") != F.col("major"), F.xxhash64("node")
    own_block = F.when(minor, F.pmod(spot, "few")).otherwise(F.col("few") + F.pmod(spot, "many")).cast("int")
    meets = F.when(minor, F.sequence(F.lit(0), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))
    cells = open_.select(F.col("node").alias("id"), "grp", own_block.alias("own"), F.explode(meets).alias("other"))
    return cells.select("id", "grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, seed: int = 1, with_text_hash: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept; ``with_text_hash`` adds the xxhash64 of its text.

    Rows with equal sets form a class, and one of each class goes on. Classes
    that share a band of the signature are candidates; connected candidates form
    groups. Each class is first verified with the least class that it shares a
    band with, in cells of about ``block`` classes. Where that leaves a group in
    several parts, the classes outside its largest part are verified with all
    others of the group, in cells of two blocks; pairs within the largest part
    are connected already. A cell compares full sets and hands on a spanning
    forest of the links, never the pairs. component_id is the least id reachable
    over links with Jaccard >= ``percent`` / 100. A pair at exactly 0.75 goes
    unseen by all of 32 bands of 4 with a chance of 5e-6.

    A null, empty or blank text has no shingles and is its own component; a row
    without id has component null and is kept; ids that are no whole numbers
    raise; repeated rows are each returned; other columns are ignored; no rows
    give no rows.
    """
    spark = docs.sparkSession
    signed = keep(signatures(docs, id_col, text_col, words, bands, rows, seed), "signed")
    classes = keep(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("print_a", "print_b").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("print_a", "print_b", F.col("r.doc_id").alias("rep"), "r.bands"),
        "classes",
    )
    spread = classes.select("rep", F.explode("bands").alias("key"))
    heads = spread.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).where("head <> tail").drop("tail")
    groups = components(spread.join(heads, "key").select(F.col("rep").alias("a"), F.col("head").alias("b")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, sets = None, [], []

        def done() -> pa.RecordBatch:
            edges = _linked(ids, sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                keys = zip(*(part.column(c).to_pylist() for c in ("grp", "lo", "hi")))
                for key, i, held in zip(keys, part.column("id").to_pylist(), shingle_sets(part.column("text"), words)):
                    if key != cell:
                        if len(ids) > 1:
                            yield done()
                        cell, ids, sets = key, [], []
                    ids.append(i)
                    sets.append(held)
        if len(ids) > 1:
            yield done()

    def links(cells: DataFrame) -> DataFrame:
        """(a, b) of the cells (id, grp, lo, hi); only texts of classes in cells are moved."""
        cells = keep(cells, "cells")
        wanted = texts.join(joinable(keep(cells.select("id").distinct(), "wanted")), "id", "left_semi")
        held = cells.hint("merge").join(wanted, "id").repartition(partitions(spark), "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "id")
        return keep(held.mapInArrow(returning_memory(verify), "a long, b long"), "links")

    near = links(_star_cells(spread.join(heads, "key").groupBy("rep").agg(F.min("head").alias("head")).where("rep <> head"), block))
    parts = components(near)
    linked = components(near.union(links(_rest_cells(groups, parts, block))))
    names = ["doc_id", "n_shingles", "component_id", *["text_hash"] * with_text_hash]
    ends = classes.join(linked, classes.rep == linked.node, "left").select("print_a", "print_b", F.coalesce("component", "rep").alias("component_id"))
    placed = signed.where("n_shingles > 0 and doc_id is not null").join(ends, ["print_a", "print_b"]).select(*names)
    alone = signed.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id")).select(*names)
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

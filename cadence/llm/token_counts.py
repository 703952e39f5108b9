"""Token counts of whole texts by batch encoding in Arrow functions."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.shared import byte_slices, returning_memory

#: After any of these and before a space, no tokenizer of the public files joins what stands on either side.
_SAFE = re.compile(r"[!-~](?= )")
#: Bytes of text encoded at once, and characters from which a text is cut at safe boundaries.
BATCH_BYTES, PIECE_CHARS = 1 << 20, 1 << 16
_loaded: dict[str, object] = {}


def forget_tokenizers() -> None:
    """Lets a worker's tokenizer go, for stages that need the memory."""
    _loaded.clear()


def load_tokenizer(source: str):
    """A tokenizer of the tokenizers library from its JSON text, kept for the life of the worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if source not in _loaded:
        _loaded.clear()
        tokenizer = Tokenizer.from_str(source)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[source] = tokenizer
    return _loaded[source]


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Cuts a long text before spaces that follow a visible ASCII character, where words end for certain; without such a place it stays whole."""
    pieces, start = [], 0
    while len(text) - start > limit:
        found = _SAFE.search(text, start + limit - 1)
        if not found:
            break
        pieces.append(text[start : found.end()])
        start = found.end()
    return [*pieces, text[start:]]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of ``docs``.

    ``tokenizer_path`` names a .json file of the tokenizers library or a .model
    file of sentencepiece. No tokens are added at the ends; special strings in a
    text count as the library counts them. A null text counts as empty (0 bytes,
    0 tokens); repeated rows are each returned; other columns are ignored; no rows
    give no rows.
    """
    sc = docs.sparkSession.sparkContext
    model = tokenizer_path.endswith(".model")
    with open(tokenizer_path, "rb") as f:  # the vocabulary's size is fixed, whatever the data
        source = sc.broadcast(f.read())

    def lengths(texts: list[str]) -> list[int]:
        if model:
            import sentencepiece

            if source.value not in _loaded:
                _loaded.clear()
                _loaded[source.value] = sentencepiece.SentencePieceProcessor(model_proto=source.value)
            return [len(x) for x in _loaded[source.value].encode(texts, num_threads=1)]
        return [len(x) for x in load_tokenizer(source.value.decode()).encode_batch_fast(texts, add_special_tokens=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", BATCH_BYTES):
                texts = part.column("text").fill_null("")
                pieces, owner = [], []
                for i, text in enumerate(texts.to_pylist()):
                    cut = [text] if model else safe_pieces(text)
                    pieces += cut
                    owner += [i] * len(cut)
                n = np.zeros(part.num_rows, np.int64)
                np.add.at(n, np.array(owner, np.int64), np.array(lengths(pieces), np.int64))
                sizes = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(returning_memory(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")

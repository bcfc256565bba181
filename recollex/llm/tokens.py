"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: How the vocabulary's byte-level tokenizer splits a text before merging.  A fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(vocabulary: bytes, texts: list[str | None]) -> list[int]:
    """Tokens of each text; none of a null or empty one."""
    encode = _encoder(vocabulary).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def _counting(vocabulary, names: list[str], at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names)) if i != at), sizes], [*(n for n in names if n != "text"), "n_tokens"])

    return run


def with_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with `n_tokens` in place of `text` (and of an `n_tokens` they had).  The
    vocabulary file, whose size is fixed, is read by the driver and broadcast; whole
    texts are tokenized, nulls and empty ones have no token."""
    documents = documents.drop("n_tokens")
    shared = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    names = documents.columns
    kept = [f for f in documents.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint"
    return documents.mapInArrow(_counting(shared, names, names.index("text")), schema)

"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import ship_package

#: Where the vocabulary files lie; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_READY: dict[int, object] = {}


def _encoding(raw: bytes):
    """The encoder of a vocabulary, built once per worker process."""
    key = hash(raw)
    if key not in _READY:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
        _READY[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _READY[key]


def count_tokens(documents: DataFrame, keep: dict[str, Column], text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns of ``keep`` and ``n_tokens`` of each whole text; NULL texts have 0 tokens.

    The vocabulary file is read once on the driver (about a megabyte) and sent to
    the executors, which need no copy of it. No shuffle.
    """
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    source = documents.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if (t := v.as_py()) else 0 for v in batch.column(batch.num_columns - 1)]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in source.dtypes[:-1])
    return source.mapInArrow(run, f"{fields}, n_tokens long")

"""Text lengths in tokens of a public tokenizer, and ranks within classes without a sort."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Vocabulary file (ranks); a parameter everywhere, this is the default.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-splitting pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(df: DataFrame, id_col: str, text_col: str, *keep: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, *keep, n_tokens BIGINT) of whole texts; null and empty texts have 0. Special tokens' strings are ordinary text."""
    slim = df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", *keep)] + [pa.array(n, pa.int64())], names=["id", *keep, "n_tokens"])

    types = dict(slim.dtypes)
    return slim.mapInArrow(run, ", ".join([f"`id` {types['id']}", *(f"`{c}` {types[c]}" for c in keep), "n_tokens bigint"]))


def ranked(df: DataFrame, class_col: str, name: str) -> DataFrame:
    """``df``, written to the shared folder, with ``rank`` BIGINT from 0 within each ``class_col`` (STRING or BIGINT, not null).

    Each task numbers its own rows per class; a class's offset in a task is the sum of its counts in the tasks
    before it. Nothing is sorted and no class is gathered; the offsets are one row per class and task.
    """
    types = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = TaskContext.get().partitionId(), {}
        for batch in batches:
            codes = batch.column(class_col).dictionary_encode()
            names, at = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            counts = np.bincount(at, minlength=len(names))
            nth = np.empty(len(at), np.int64)
            nth[order] = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            nth += np.array([used.get(n, 0) for n in names], np.int64)[at] if len(names) else 0
            for n, c in zip(names, counts.tolist()):
                used[n] = used.get(n, 0) + c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part), pa.int64()), pa.array(nth)], names=[*batch.schema.names, "_part", "_nth"])

    rows = materialize(df.mapInArrow(number, f"{types}, _part bigint, _nth bigint"), name)
    counts = rows.groupBy(class_col, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(class_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(class_col, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(offsets, [class_col, "_part"]).select(*df.columns, (F.col("_before") + F.col("_nth")).alias("rank"))

"""Suffix-array dedup over bytes: of a repeated string of 100 bytes, the first place stays.

Method (depth-limited radix sort): suffixes are ordered through their first 100 bytes only, by passes from the most significant
digit on; groups that are still equal after the last pass are exactly the repeated windows. The first digit is the minimiser of
the suffix's first 100 bytes and its offset, which equal windows share: it deals suffixes to buckets in packed runs (see
windows.py), and a minimiser met once drops all its suffixes before anything is sent. The other digits are eight bytes each. All
suffixes that travel are sorted this way; a run that a chunk of documents holds several times travels once and counts as often.

Defined cases: a null or empty text has no bytes; a text shorter than a window keeps all; a very long text is cut into pieces only
to find minimisers, and judged whole; of repeated rows one stays; ids are integers (another type is a TypeError), and rows without
one stand after all others; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import read
from tessera.llm.windows import Chunk, mark_repeats

WINDOW, GRAM = 100, 32


def remove_later(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_bytes: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans, kept_sha256): without the bytes that windows cover which also start earlier."""

    def finish(own: Chunk, covered: np.ndarray) -> pa.Table:
        raw, edge = np.frombuffer(own.raw, np.uint8), np.concatenate((own.first, [own.units]))
        sums = lambda x: np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(x)))[edge])
        begins = covered & ~np.concatenate(([False], covered[:-1])) if len(covered) else covered
        begins[edge[:-1][own.size > 0]] = covered[edge[:-1][own.size > 0]]
        gone, spans = sums(covered), sums(begins)
        kept = [(raw[a : a + n][~covered[a : a + n]].tobytes() if g else own.raw[a : a + n]) for a, n, g in zip(own.first.tolist(), own.size.tolist(), gone.tolist(), strict=True)]
        columns = {"doc_id": own.table["doc_id"]}
        if with_bytes:
            columns["kept"] = pa.array(kept, pa.binary())
        columns |= {"n_bytes": pa.array(own.size), "n_removed": pa.array(gone), "n_spans": pa.array(spans), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())}
        return pa.table(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    return mark_repeats(docs, "byte", window, gram, True, finish, f"doc_id {kind}, {'kept binary, ' * with_bytes}n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: bytes, bytes and spans removed, digest of the kept bytes."""
    return remove_later(read(spark, sf_dir, "documents"), with_bytes=False)

"""Substring dedup over words: every place of a passage that repeats goes.

Method (super-k-mer partitioning): see windows.py. A window is 35 words; its minimiser is one of its 5-word grams; a bucket
counts the windows of its runs exactly by sorting them.

Defined cases: a null or empty text has no words; a text shorter than a window keeps all; a very long text is cut into pieces only
to find minimisers, and judged whole; repeated rows repeat each other, so their windows go in both; ids may be of any type; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import read
from tessera.llm.windows import Chunk, mark_repeats

WINDOW, GRAM = 35, 5


def _kept(own: Chunk, covered: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each document's kept words joined by one space, and how many words went."""
    gone = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(covered)))[np.concatenate((own.first, [own.units]))])
    out = []
    for d, (a, n) in enumerate(zip(own.first.tolist(), own.size.tolist(), strict=True)):
        text = own.raw[own.begin[a] : own.end[a + n - 1]] if n else b""
        if gone[d]:
            text = b" ".join([w for w, c in zip(text.split(b" "), covered[a : a + n].tolist(), strict=True) if not c])
        out.append(text)
    return out, gone


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_sha256): without the words that repeated windows cover."""

    def finish(own: Chunk, covered: np.ndarray) -> pa.Table:
        kept, gone = _kept(own, covered)
        columns = {"doc_id": own.table["doc_id"]}
        if with_text:
            columns["text"] = pa.array([t.decode() for t in kept], pa.string())
        columns |= {"n_words": pa.array(own.size), "n_removed": pa.array(gone), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())}
        return pa.table(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    return mark_repeats(docs, "word", window, gram, False, finish, f"doc_id {kind}, {'text string, ' * with_text}n_words long, n_removed long, kept_sha256 string", id_col, text_col)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, words removed, digest of the kept words."""
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)

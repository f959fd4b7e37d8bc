"""Spelling variants: words one edit apart, and for each word the common form it stands for.

Method (full neighbourhood generation): for every word of the vocabulary all distinct deletions, replacements and insertions over
the vocabulary's own alphabet are generated, and those that are joined to a word of the vocabulary by equality are its near words.
The join is the proof; no distance is computed. A candidate is first its hash, made from sums over the word's two ends; hashes are
looked up in a bit map of the vocabulary, and only candidates found in it become strings and travel to the join. The bit map lets
through what is no word now and then, and never holds back a word.

The bit map has 32 bits a word and at most MAP_BITS (32 MB) whatever the vocabulary: beyond eight million words it lets more
candidates through, up to all of them, and the join still decides. A string is a candidate of at most one word for each of its own
neighbours, so no key of the join is hot. Counts are made in each task before the exchange, so a frequent word costs it one row.

Defined cases: a null or empty text has no words; a very long text is read whole; a row without an id counts under the empty id;
repeated rows count each; of near words with equal counts the smallest in code-point order is the form; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, mix, powers, prefixed, read

LETTERS = r"A-Za-zÀ-ÿ"
#: Largest bit map of the vocabulary.
MAP_BITS = 1 << 28
#: Candidates that a task turns into hashes at a time.
CANDIDATES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = np.uint64(pow(_BASE, -1, 1 << 64))


def words(docs: DataFrame, least_length: int = 6, least: int = 5, noise: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, A to Z in lower case, that stand at least `least` times in all texts. With noise, a run whose
    checksum with its document's id is divisible by it loses one letter, as misspelt words do."""
    slim = prefixed(docs, doc_id=id_col, text=text_col)
    # a run that is too short stays so, with or without noise
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{max(least_length, 1)},}}"), F.lit(0))
    each = slim.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    if noise:
        each = each.withColumn("sum", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("sum") % F.length("run")).cast("int")
        short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        each = each.withColumn("run", F.when(F.col("sum") % noise == 0, short).otherwise(F.col("run")))
    found = each.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= least)


def _codes(items: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Items of equal length: their places, and their code points as a matrix."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(items):
        by_length.setdefault(len(w), []).append(k)
    for n, at in by_length.items():
        if n:
            yield at, np.frombuffer("".join(items[k] for k in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)


def _letters(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(_BASE))


def hashes(items: list[str]) -> np.ndarray:
    """A 64-bit hash of each word: a sum over its letters and their places, mixed."""
    out = np.zeros(len(items), np.uint64)
    for at, codes in _codes(items):
        out[at] = mix((_letters(codes) * powers(_BASE, codes.shape[1])).sum(1, dtype=np.uint64))
    return out


def _bits(hash_: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a map of that many bits, a power of two."""
    return (hash_ & np.uint64(bits - 1)).astype(np.int64), (hash_ >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def _in(bit_map: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bit_map[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def candidates(items: list[str], alphabet: str, bit_map: np.ndarray) -> tuple[list[int], list[str]]:
    """All distinct strings one deletion, replacement or insertion over the alphabet away from each item that the map may hold:
    places of the items, and the strings. Of equal letters in a row the first is deleted, and a letter is inserted before its
    like, never behind it, so that no string is generated twice for an item."""
    sign = np.frombuffer(alphabet.encode("utf-32-le"), np.uint32)
    t_sign = _letters(sign)
    bits = len(bit_map) * 8
    of, out = [], []

    def known(h: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        h = mix(h)
        one, two = _bits(h, bits)
        hit = np.nonzero(_in(bit_map, one) & valid)
        keep = _in(bit_map, two[hit])
        return tuple(x[keep] for x in hit)

    for places, all_codes in _codes(items):
        n = all_codes.shape[1]
        p = powers(_BASE, n + 1)[: n + 1]
        step = max(CANDIDATES // ((n + 1) * max(len(sign), 1)), 1)
        for start in range(0, len(places), step):
            codes = all_codes[start : start + step]
            part = _letters(codes) * p[:n]
            before = np.concatenate((np.zeros((len(codes), 1), np.uint64), np.cumsum(part, 1, dtype=np.uint64)), 1)
            after = before[:, -1:] - before
            same = codes[:, 1:] == codes[:, :-1]
            fresh = np.concatenate((np.ones((len(codes), 1), bool), ~same), 1)
            w, i = known(before[:, :n] + after[:, 1:] * _BASE_INV, fresh)
            for a, k in zip(w.tolist(), i.tolist(), strict=True):
                x = items[places[start + a]]
                of.append(places[start + a])
                out.append(x[:k] + x[k + 1 :])
            other = codes[:, :, None] != sign
            w, i, s = known((before[:, -1:] - part)[:, :, None] + t_sign * p[:n, None], other)
            for a, k, c in zip(w.tolist(), i.tolist(), s.tolist(), strict=True):
                x = items[places[start + a]]
                of.append(places[start + a])
                out.append(x[:k] + alphabet[c] + x[k + 1 :])
            behind = np.concatenate((np.ones((len(codes), 1, len(sign)), bool), other), 1)
            w, i, s = known((before + after * np.uint64(_BASE))[:, :, None] + t_sign * p[:, None], behind)
            for a, k, c in zip(w.tolist(), i.tolist(), s.tolist(), strict=True):
                x = items[places[start + a]]
                of.append(places[start + a])
                out.append(x[:k] + alphabet[c] + x[k:])
    return of, out


def _map_of(vocabulary: DataFrame, size: int) -> np.ndarray:
    """The bit map of the vocabulary's hashes, built by Spark in blocks of 4 kB."""
    bits = min(max(1 << (32 * size - 1).bit_length(), 1 << 16), MAP_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _bits(hashes(batch["word"].to_pylist()), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((one, two)))], ["place"])

    found = vocabulary.select("word").mapInArrow(places, "place long")
    blocks = found.groupBy(F.expr("place div 32768").alias("block")).agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        block = np.frombuffer(r["bits"], np.uint8)
        out[r["block"] * 4096 :][: len(block)] = block
    return out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n) of all pairs of the vocabulary (word, n) that differ by one letter inserted, deleted or replaced."""
    sc = vocabulary.sparkSession.sparkContext
    alphabet = "".join(sorted(r[0] for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))
    bit_map = sc.broadcast(_map_of(vocabulary, vocabulary.count()))

    def generated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                items = batch["word"].slice(start, 4096).to_pylist()
                of, out = candidates(items, alphabet, bit_map.value)
                yield pa.RecordBatch.from_arrays([pa.array([items[k] for k in of], pa.string()), pa.array(out, pa.string())], ["word", "near"])

    found = vocabulary.select("word").mapInArrow(generated, "word string, near string")
    return found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def roots(links: DataFrame, most_steps: int) -> DataFrame:
    """(word, root) from (word, form): each form is followed to the last, in rounds that double the way."""
    out = checkpointed(links.select("word", F.col("form").alias("root")))
    for _ in range((max(most_steps, 1) - 1).bit_length()):
        further = out.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        out = checkpointed(out.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return out


def grouped(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary (word, n): its near word of largest count is its form if
    that is `ratio` (2 at least) times its own. Counts grow along forms, so forms don't run in circles and end after few steps."""
    if ratio < 2:
        raise ValueError("ratio is 2 at least")
    vocabulary = checkpointed(vocabulary.select("word", "n"))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = vocabulary.join(near, "word", "left").withColumn("best", F.when(F.col("best.near_n") >= ratio * F.col("n"), F.col("best")))
    told = checkpointed(told.select("word", F.col("best.near").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near_n").alias("form_n")))
    top, steps = told.agg(F.max("n")).first()[0] or 0, 0
    while top >= ratio:
        top, steps = top // ratio, steps + 1
    ends = roots(told.where("form is not null"), steps)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word of documents, after noise of one in 199."""
    return grouped(words(read(spark, sf_dir, "documents"), noise=199))

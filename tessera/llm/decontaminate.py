"""Benchmark decontamination: documents that hold a passage of a benchmark item, also with some words replaced.

Method (spaced-seed hashing): a mask looks at some of its words and ignores the others, so a replaced word under an ignored
place doesn't hide a match. Hashes of all masked windows of the benchmark form an index; masked windows of the documents that
hit it name a document, an item and an offset between them; there, the words are compared one by one. A stretch counts if it
holds `min_words` equal words, at least as many as the lightest mask has, and at least four in five of its words are equal.

The index is broadcast only while the benchmark's texts are within INDEX_BYTES, which is checked; a larger benchmark is dealt
into so many parts within it, each compared with all documents in a pass of its own.

Defined cases: null and empty texts and items hold nothing; items without an id are not compared; an item of fewer words than a
mask is found where all its words stand in a row, and one of fewer than WHOLE words only in a text that has no others; repeated
documents each give rows; repeated items give one; other columns are not read; an empty table gives an empty result. Words are
compared in lower case. Very long and repetitive texts are compared in pieces of PRODUCT hits; a hit that only continues one at
the words before is the same offset and left out, so that a text of one repeated word has as many hits as words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, mapped, mix, prefixed, read, slices

#: 1: the word counts, 0: it is ignored.
MASKS = ("11111111", "1110110111", "110101101011", "1011100111011")
MIN_WORDS, INDEX_BYTES = 8, 16 << 20
#: Fewest words of an item that is looked for inside of texts.
WHOLE = 5
#: Hits, and word comparisons, that are held at a time.
PRODUCT = 1 << 20
_FILTER_BITS = 22
_LIGHTEST = min(m.count("1") for m in MASKS)


def seeds(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the masked window at each word that has room for it in its row, and the word's index."""
    count = np.maximum(np.diff(words.first) - len(mask) + 1, 0)
    at = np.repeat(words.first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    out = np.zeros(len(at), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(0xD6E8FEB86659FD93) + words.hash[at + j]
    return mix(out), at


class Seeds:
    """Seeds of one mask, and the words where they stand, in order of seed and of the seed at the word before."""

    def __init__(self, h: np.ndarray, at: np.ndarray, follow: bool = True):
        self.values, rank = np.unique(h, return_inverse=True)
        self.width, self.follow = len(self.values) + 1, follow
        before = np.zeros(len(at), np.int64)
        if follow and len(at):
            before[1:] = np.where(at[1:] == at[:-1] + 1, rank[:-1] + 1, 0)  # rows are further apart
        key = rank * self.width + before
        order = np.argsort(key, kind="stable")
        self.key, self.places = key[order], at[order]
        self.near = np.zeros(1 << _FILTER_BITS, bool)
        self.near[h >> np.uint64(64 - _FILTER_BITS)] = True

    def met(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of the text, first of places, number of places) of the seeds that are known here, without those places where the
        word before and the place before are such a pair too."""
        maybe = self.near[h >> np.uint64(64 - _FILTER_BITS)]
        h, at = h[maybe], at[maybe]
        rank = np.searchsorted(self.values, h)
        there = rank < len(self.values)
        there[there] = self.values[rank[there]] == h[there]
        rank, at = rank[there], at[there]
        base = rank * self.width
        low, high = np.searchsorted(self.key, base), np.searchsorted(self.key, base + self.width)
        gap, end = high.copy(), high.copy()
        if self.follow:
            k = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
            gap[k], end[k] = (np.searchsorted(self.key, base[k] + rank[k - 1] + 1 + one) for one in (0, 1))
        at, low, n = np.concatenate((at, at)), np.concatenate((low, end)), np.concatenate((gap - low, high - end))
        return at[n > 0], low[n > 0], n[n > 0]


class Index:
    """Seeds of the items, and their words' hashes."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(pc.utf8_lower(pa.chunked_array([texts], pa.string())))
        self.ids, self.first, self.hash = np.array(ids, np.int64), words.first, words.hash
        self.size = np.diff(self.first)
        self.seeds = [Seeds(*seeds(words, mask)) for mask in MASKS]
        self.short = {}
        for n in range(1, _LIGHTEST):
            h, at = seeds(words, "1" * n)
            mine = self.size[np.searchsorted(self.first, at, side="right") - 1] == n
            if mine.any():
                self.short[n] = Seeds(h[mine], at[mine], False)

    def overlaps(self, words: Words, min_words: int) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word in the row, words, equal words) of the best stretch for each row and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for mask, known in zip(MASKS, self.seeds, strict=True):
            at, low, n = known.met(*seeds(words, mask))
            total = np.cumsum(n)
            done = 0
            while done < len(at):
                end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PRODUCT, side="right")))
                m = n[done:end]
                hit = np.repeat(low[done:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                self._compare(words, np.repeat(at[done:end], m), known.places[hit], min_words, best)
                done = end
        out = [(r, int(self.ids[i]), *x) for (r, i), x in best.items() if x[2]]
        return out + self._short(words)

    def _compare(self, words: Words, at: np.ndarray, place: np.ndarray, min_words: int, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Puts into best what the words around hits (word of the text, word of the items) hold."""
        row, item = (np.searchsorted(first, x, side="right") - 1 for first, x in ((words.first, at), (self.first, place)))
        shift = at - words.first[row] - (place - self.first[item])
        order = np.lexsort((shift, item, row))
        row, item, shift = row[order], item[order], shift[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        fresh = new.copy()
        fresh[1:] |= shift[1:] != shift[:-1]
        starts = np.append(np.flatnonzero(new), len(row))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            r, i = int(row[a]), int(item[a])
            had = best.get((r, i), (0, 0, 0))
            if had[2] < self.size[i]:
                text, own = words.hash[words.first[r] : words.first[r + 1]], self.hash[self.first[i] : self.first[i + 1]]
                best[r, i] = best_stretch(text, own, shift[a:b][fresh[a:b]], min_words, had)

    def _short(self, words: Words) -> list[tuple[int, int, int, int, int]]:
        out = []
        for n, known in self.short.items():
            at, low, many = known.met(*seeds(words, "1" * n))
            row = np.searchsorted(words.first, at, side="right") - 1
            if n < WHOLE:
                alone = np.diff(words.first)[row] == n
                at, low, many, row = at[alone], low[alone], many[alone], row[alone]
            _, lead = np.unique(np.column_stack((row, low)), axis=0, return_index=True)
            for k in lead.tolist():
                items = np.searchsorted(self.first, known.places[low[k] : low[k] + many[k]], side="right") - 1
                out += [(int(row[k]), int(self.ids[i]), int(at[k] - words.first[row[k]]), n, n) for i in items.tolist()]
        return out


def best_stretch(text: np.ndarray, own: np.ndarray, shifts: np.ndarray, min_words: int, best: tuple[int, int, int]) -> tuple[int, int, int]:
    """(start in text, length, equal words) of the best stretch of own laid on text at each shift, if it beats best."""
    step = max(1, PRODUCT // len(own))
    for k in range(0, len(shifts), step):
        some = shifts[k : k + step]
        at = some[:, None] + np.arange(len(own))
        inside = (at >= 0) & (at < len(text))
        equal = (text[np.where(inside, at, 0)] == own) & inside
        count = equal.sum(1)
        for j in np.argsort(-count, kind="stable").tolist():
            if count[j] < max(min_words, best[2] + 1):
                break
            a, b = max(0, -int(some[j])), min(len(own), len(text) - int(some[j]))
            start, size, n = stretch(equal[j, a:b])
            if n >= min_words and n > best[2]:
                best = (int(some[j]) + a + start, size, n)
    return best


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal words) of the stretch with the most equal words of those of which at least four in five words are
    equal: the longest whose sum of 1 for each equal word and -4 for each other isn't negative, without other words at its ends.
    A stretch with more equal words and no longer would have a sum of 5 at least, and with the next word still be one."""
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -4))))
    later = np.maximum.accumulate(total[::-1])  # largest sum of the last 1, 2 ...
    ends = len(equal) - np.searchsorted(later, total)
    start = int((ends - np.arange(len(total))).argmax())
    met = np.flatnonzero(equal[start : ends[start]])
    return (start + int(met[0]), int(met[-1] - met[0]) + 1, len(met)) if len(met) else (0, 0, 0)


def _checked(min_words: int) -> None:
    if min_words < _LIGHTEST:
        raise ValueError(f"masks find stretches of {_LIGHTEST} equal words and more")


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    items = prefixed(benchmark, item_id=item_col, text=text_col).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // INDEX_BYTES + 1
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield Index([r["item_id"] for r in mine], [r["text"] for r in mine])


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, n_equal) for each document and item that overlap; start counts words of the document."""
    slim = prefixed(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, item_id long, start long, n_words long, n_equal long"
    _checked(min_words)
    out = None
    for index in _indexes(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    if found := sent.value.overlaps(Words(pc.utf8_lower(part["text"])), min_words):
                        row, *rest = (list(x) for x in zip(*found, strict=True))
                        ids = part["doc_id"].combine_chunks().take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in rest]], ["doc_id", "item_id", "start", "n_words", "n_equal"])

        one = slim.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a passage of an item; all columns stay, nothing is shuffled."""
    _checked(min_words)
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text_col):
        docs = mapped(docs, _filter(docs.sparkSession.sparkContext.broadcast(index), at, min_words))
    return docs


def _filter(sent: object, at: int, min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            done = 0
            texts = pa.table({"text": batch.column(at)})
            for part in slices(texts, "text"):
                for row, *_ in sent.value.overlaps(Words(pc.utf8_lower(part["text"])), min_words):
                    keep[done + row] = False
                done += part.num_rows
            yield batch.filter(pa.array(keep))

    return run


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item: one row for each such pair."""
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

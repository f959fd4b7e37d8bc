"""Repeated windows of a corpus: every window of `length` units (words or bytes) that stands in more than one place.

Windows travel as super-k-mers. The minimiser of a window is its gram of `gram` units with the smallest hash, the leftmost of
equal ones; consecutive windows with the same minimiser occurrence form one run, packed as one string. Equal windows have equal
minimisers at equal offsets, so they can only meet between runs of one minimiser, and never inside one run.

1. Documents are dealt by hash into chunks of bounded size. Each chunk names its distinct minimisers and how many windows they
   have; a sum over all chunks tells which occur more than once. Only their runs can hold a repeated window, so only these travel
   on. A minimiser with over HOT_WINDOWS windows is hot: each of its windows counts as a run of its own, whose minimiser is the
   hash of the whole window, and these are named and counted once more, so that only windows that may repeat travel on, spread
   over all buckets. Within a chunk, such windows are told apart by 128 bits.
2. Each chunk packs its distinct runs, one string for all copies in it, and sends them to the bucket of their minimiser.
3. In a bucket, windows are sorted by digits: first by minimiser and its offset in the window, then by radix passes from the most
   significant units on, where groups of one window leave at once. What is left after the last pass, with the copies that a string
   stands for, are the repeated windows, exactly.
4. Verdicts return to the chunks, which mark what repeated windows cover.

A hot passage costs a bucket one row for each chunk that holds it, and the text itself is shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.common import _BASE, _BASE_INV, _BYTE, Words, mix, parts_for, powers, prefixed, slices, utf8

CHUNK_MB = 8
#: Windows of one minimiser beyond which each is judged under its own hash.
HOT_WINDOWS = 1_000_000
#: Windows that are sorted at a time.
BATCH = 200_000
_POS_BITS = 28
#: Grams whose minimisers are found at a time.
_PIECE = 1 << 22
_BYTE2 = np.random.default_rng(20240201).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, have = v, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def minimiser_runs(grams: np.ndarray, first: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser's hash, minimiser's place in the first window) of the runs; a window is named by
    its first gram."""
    none = np.zeros(0, np.int64)
    if len(grams) < w:
        return none, none, np.zeros(0, np.uint64), none
    high = np.uint64((1 << 64) - (1 << _POS_BITS))
    pieces = []
    for k in range(0, len(grams) - w + 1, _PIECE):
        piece = grams[k : k + _PIECE + w - 1]
        least = sliding_min((piece & high) | np.arange(len(piece), dtype=np.uint64), w)
        pieces.append((least & ~high).astype(np.int64) + k)
    at = np.concatenate(pieces)
    count = np.maximum(np.diff(first) - w + 1, 0)
    valid = np.zeros(len(grams) + 1, np.int8)
    has = count > 0
    np.add.at(valid, first[:-1][has], 1)
    np.add.at(valid, (first[:-1] + count)[has], -1)
    window = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    if not len(window):
        return none, none, np.zeros(0, np.uint64), none
    p = at[window]
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (window[1:] != window[:-1] + 1)))
    start = np.flatnonzero(new)
    return window[start], np.diff(np.append(start, len(window))), grams[p[start]], p[start] - window[start]


def equal_groups(units: np.ndarray, start: np.ndarray, length: int, per: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, group) of the windows units[start : start + length] that equal another one with the same label, by radix passes of
    `per` units from the most significant on, through the last of the length units and no further."""
    left = np.arange(len(start))
    bits = np.uint64(64 // per)
    for depth in [-1, *range(0, length, per)]:
        if depth < 0:
            order = np.argsort(label, kind="stable")
            key = label[order]
            new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        else:
            at = start[left] + min(depth, length - per)
            digit = np.zeros(len(left), np.uint64)
            for j in range(per):
                digit = (digit << bits) | units[at + j].astype(np.uint64)
            uneven = np.unique(group[digit != digit[head[group]]])  # groups that this digit splits
            order = np.arange(len(left))
            if len(uneven):
                mine = np.flatnonzero(np.isin(group, uneven))
                order[mine] = mine[np.lexsort((digit[mine], group[mine]))]
            g, d = group[order], digit[order]
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        group = np.cumsum(new) - 1
        kept = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        left = left[order][kept]
        if not len(left):
            return left, left
        group = np.unique(group[kept], return_inverse=True)[1]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return left, group


class Chunk:
    """The documents of one chunk in order (of id, if that tells which place is first), their units, and their runs."""

    def __init__(self, table: pa.Table, unit: str, length: int, gram: int, by_id: bool):
        order = pc.sort_indices(table, [("doc_id", "ascending"), ("tie", "ascending")] * by_id + [("text", "ascending")])
        self.table = table.select(["doc_id", "text", *["tie"] * by_id]).take(order)
        raws, starts, counts, hashes, docs, offsets, sizes, places = [], [], [], [], [], [], [], []
        unit_at = doc_at = byte_at = 0
        edges = []  # byte starts and ends of words
        for part in slices(self.table, "text", 1 << 20):
            column = part["text"]
            if unit == "word":
                column = pa.chunked_array([[b" ".join((t.as_py() or "").encode().split()).decode() for t in column]], pa.string())
                words = Words(column)
                first, raw = words.first, words.raw
                grams, gram_first = words.grams(gram)
                edges.append((words.start + byte_at, words.end + byte_at))
            else:
                raw, first = utf8(column)
                count = np.maximum(np.diff(first) - gram + 1, 0)
                gram_first = np.concatenate(([0], np.cumsum(count)))
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers(_BASE, max(1, len(raw)))[: len(raw)], dtype=np.uint64)))
                grams = mix((total[gram:] - total[:-gram]) * powers(_BASE_INV, max(1, len(raw)))[: max(0, len(total) - gram)]) if len(raw) >= gram else np.zeros(0, np.uint64)
                keep = np.repeat(first[:-1] - gram_first[:-1], count) + np.arange(gram_first[-1])
                grams = grams[keep] if len(keep) != len(grams) else grams
            window, n, anchor, place = minimiser_runs(grams, gram_first, length - gram + 1)
            doc = np.searchsorted(gram_first, window, side="right") - 1
            starts.append(window - gram_first[doc] + first[doc] + unit_at)
            docs.append(doc + doc_at)
            counts.append(n)
            hashes.append(anchor)
            places.append(place)
            offsets.append(first[:-1] + unit_at)
            raws.append(raw)
            sizes.append(np.diff(first))
            unit_at, doc_at, byte_at = unit_at + int(first[-1]), doc_at + part.num_rows, byte_at + len(raw)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.raw = join(raws, np.uint8).tobytes()
        self.start, self.n, self.doc = join(starts, np.int64), join(counts, np.int64), join(docs, np.int64)
        self.anchor, self.place, self.length, self.units = join(hashes, np.uint64), join(places, np.int64), length, unit_at
        self.first, self.size = join(offsets, np.int64), join(sizes, np.int64)
        if unit == "word":
            self.begin, self.end = join([a for a, _ in edges], np.int64), join([b for _, b in edges], np.int64)
        else:
            self.begin = self.end = None

    def packed(self, run: np.ndarray) -> list[bytes]:
        """The runs as strings; -1 - s is the run of only the window that starts at unit s."""
        one = run < 0
        a = np.where(one, -1 - run, self.start[np.where(one, 0, run)] if len(self.start) else 0)
        b = a + self.length - 1 + np.where(one, 1, self.n[np.where(one, 0, run)] if len(self.n) else 1)
        if self.begin is not None:
            a, b = self.begin[a], self.end[b - 1]
        raw = self.raw
        return [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]

    def windows(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first unit, two hashes of the whole window) of all windows of these minimisers, in order."""
        runs = np.flatnonzero(np.isin(self.anchor, anchors))
        raw = np.frombuffer(self.raw, np.uint8)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        cut = np.cumsum(self.n[runs] + self.length) // (1 << 17)
        for some in np.split(runs, np.flatnonzero(np.diff(cut)) + 1):
            if not len(some):
                continue
            n = self.n[some]
            at = np.repeat(self.start[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a, b = (at, at + self.length) if self.begin is None else (self.begin[at], self.end[at + self.length - 1])
            low, high = a[np.cumsum(n) - n], b[np.cumsum(n) - 1]  # bytes of each run
            size = high - low
            own = raw[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            moved = np.repeat((np.cumsum(size) - size) - low, n)
            hashes = []
            for table in (_BYTE, _BYTE2):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[own] * powers(_BASE, len(own)), dtype=np.uint64)))
                hashes.append(mix((total[b + moved] - total[a + moved]) * powers(_BASE_INV, len(own))[a + moved] + (b - a).astype(np.uint64)))
            out.append((at, *hashes))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _rows(kind: pa.Schema, **columns: list) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in kind}, schema=kind)


_NAMED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("anchors", pa.binary()), ("times", pa.binary()), ("windows", pa.binary())])
_BACK = pa.schema([("chunk", pa.int64()), ("anchors", pa.binary()), ("hot", pa.binary()), ("single", pa.binary())])
_PACKED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("run", pa.binary()), ("n", pa.binary()), ("doc", pa.binary()), ("tie", pa.binary()), ("at", pa.binary()), ("anchor", pa.binary()), ("place", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())])
_VERDICT = pa.schema([("chunk", pa.int64()), ("run", pa.binary()), ("n", pa.binary()), ("flags", pa.binary())])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int32': 'int', 'int64': 'long'}).get(str(f.type), 'binary')}" for f in schema)


def _split(key: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, indices) of the parts that have any."""
    part = (mix(key) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[x[0]]), x) for x in np.split(order, cut) if len(x)]


def _numbers(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in column]


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *_numbers(column, kind)])


def _named(chunk: int, keys: np.ndarray, windows: np.ndarray, parts: int) -> pa.Table:
    """The distinct keys of a chunk with how often it holds them and how many windows they have, by part."""
    values, of = np.unique(keys, return_inverse=True)
    times, total = np.bincount(of, minlength=len(values)), np.bincount(of, windows, len(values)).astype(np.int64)
    split = _split(values, parts)
    return _rows(_NAMED, part=[p for p, _ in split], chunk=[chunk] * len(split), anchors=[values[x].tobytes() for _, x in split], times=[times[x].tobytes() for _, x in split], windows=[total[x].tobytes() for _, x in split])


def _repeated(table: pa.Table, limit: int | None) -> pa.Table:
    """Of the minimisers of one part, those that occur more than once, told to the chunks that named them; they are hot if they have
    more windows than limit. Without a limit they are hashes of windows."""
    named = _numbers(table["anchors"], "<u8")
    values, of = np.unique(np.concatenate(named), return_inverse=True)
    times, windows = (np.bincount(of, _joined(table[c], "<i8"), len(values)) for c in ("times", "windows"))
    single = limit is None
    # by each named key's place among the values: a search in them for each chunk would grow with the square of the chunks
    repeats, is_large = times > 1, np.zeros(len(values), bool) if single else windows > limit
    rows: dict[str, list] = {f.name: [] for f in _BACK}
    for chunk, own, at in zip(table["chunk"].to_pylist(), named, np.split(of, np.cumsum([len(x) for x in named])[:-1]), strict=True):
        met = repeats[at]
        mine, is_hot = own[met], is_large[at][met]
        if len(mine):
            for field, value in (("chunk", chunk), ("anchors", b"" if single else mine[~is_hot].tobytes()), ("hot", mine[is_hot].tobytes()), ("single", mine.tobytes() if single else b"")):
                rows[field].append(value)
    return _rows(_BACK, **rows)


def _verdicts(table: pa.Table, unit: str, length: int, keep_first: bool) -> pa.Table:
    """For each packed run of one bucket, a flag for each of its windows: 0 stands once; 1 every place of it is repeated; 2 so is
    every place but the first in its chunk, which is the first of all (only with keep_first)."""
    chunk = np.repeat(np.arange(table.num_rows), [len(x.as_py()) // 8 for x in table["anchor"]])
    run, n, doc, tie, at, place, size = (_joined(table[c], "<i8") for c in ("run", "n", "doc", "tie", "at", "place", "size"))
    strings: list[bytes] = []
    for raw, sizes in zip(table["bytes"], _numbers(table["size"], "<i8"), strict=True):
        raw, ends = raw.as_py(), np.cumsum(sizes).tolist()
        strings += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    copied = n < 0  # stands more than once in its chunk
    n = np.abs(n)
    ids = np.array(table["chunk"].to_pylist(), np.int64)[chunk]
    family = np.unique(_joined(table["anchor"], "<u8"), return_inverse=True)[1]
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(n)
    # equal strings of several chunks are sorted once and count as often; the first place of all is their owner's
    seen: dict[bytes, int] = {}
    text = np.array([seen.setdefault(s, k) for k, s in enumerate(strings)], np.int64)
    copied |= np.bincount(text, minlength=len(n))[text] > 1
    alike = np.lexsort((ids, at, tie, doc, text))
    bounds = np.append(np.flatnonzero(np.concatenate((np.ones(min(1, len(n)), bool), np.diff(text[alike]) != 0))), len(n))
    owner = np.zeros(len(n), np.int64)
    owner[text[alike[bounds[:-1]]]] = alike[bounds[:-1]]
    members = {int(text[alike[a]]): alike[a:b].tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)}
    del seen
    alone = np.array(sorted(members), np.int64)
    copied[alone] |= np.maximum.reduceat(copied[alike].astype(np.int8), bounds[:-1])[np.argsort(text[alike[bounds[:-1]]])] > 0 if len(alone) else False
    for batch in _batches(alone[np.argsort(family[alone], kind="stable")], family, n):
        words = [strings[k] for k in batch.tolist()]
        if unit == "word":
            parts = [w.split(b" ") for w in words]
            names: dict[bytes, int] = {}
            units = np.array([names.setdefault(x, len(names)) for p in parts for x in p], np.int64)
            sizes, per = np.array([len(p) for p in parts]), 2
        else:
            units = np.frombuffer(b"".join(words), np.uint8)
            sizes, per = np.array([len(w) for w in words]), 8
        first = np.cumsum(sizes) - sizes
        count = n[batch]
        of = np.repeat(np.arange(len(batch)), count)
        j = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        offset = place[batch][of] - j
        label = family[batch][of] * length + offset
        flag = copied[batch][of].astype(np.uint8)
        lead = np.ones(len(of), bool)
        step = -(-length // (1 + len(of) // BATCH))
        for low in range(0, length, step):  # a large family by its windows' offsets, which equal windows share
            some = np.flatnonzero((offset >= low) & (offset < low + step)) if step < length else np.arange(len(of))
            index, group = equal_groups(units, first[of[some]] + j[some], length, per, label[some])
            index = some[index]
            flag[index] = 1
            lead[index] = False
            if keep_first and len(index):
                k = owner[batch[of[index]]]
                order = np.lexsort((ids[k], at[k] + j[index], tie[k], doc[k], group))
                lead[index[order[np.concatenate(([True], np.diff(group[order]) != 0))]]] = True
        if keep_first:
            flag[lead & (flag > 0)] = 2
        for k, own in zip(batch.tolist(), np.split(flag, np.cumsum(count)[:-1]), strict=True):
            rest = np.minimum(own, 1)
            for x in members[k]:
                out[x] = own if x == owner[k] else rest
    told = np.array([f.any() for f in out], bool) if len(out) else np.zeros(0, bool)
    chunks, runs, sizes, flags = [], [], [], []
    for k, name in enumerate(table["chunk"].to_pylist()):
        a, b = np.searchsorted(chunk, [k, k + 1])
        mine = np.flatnonzero(told[a:b]) + a
        if len(mine):
            chunks.append(name)
            runs.append(run[mine].tobytes())
            sizes.append(n[mine].tobytes())
            flags.append(b"".join([out[x].tobytes() for x in mine.tolist()]))
    return _rows(_VERDICT, chunk=chunks, run=runs, n=sizes, flags=flags)


def _batches(strings: np.ndarray, family: np.ndarray, n: np.ndarray, limit: int = BATCH) -> list[np.ndarray]:
    """Strings in order of family, cut between families so that a batch has about `limit` windows."""
    if not len(strings):
        return []
    edge = np.flatnonzero(np.diff(family[strings])) + 1
    total = np.cumsum(n[strings])
    cuts, last = [], 0
    for e in edge.tolist():
        if total[e - 1] - last >= limit:
            cuts.append(e)
            last = int(total[e - 1])
    return np.split(strings, cuts)


def mark_repeats(docs: DataFrame, unit: str, length: int, gram: int, keep_first: bool, finish: Callable[[Chunk, np.ndarray], pa.Table], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """finish(chunk, covered) for each chunk of documents, where covered tells for each unit whether a repeated window covers it;
    with keep_first, a window's first place (by document id, then the text's hash, then position) doesn't count as repeated; then ids
    must be integers."""
    spark = docs.sparkSession
    slim = prefixed(docs, doc_id=id_col, text=text_col)
    if keep_first and not isinstance(slim.schema["doc_id"].dataType, IntegralType):
        raise TypeError("the first place is told by an integer id")
    mb = (slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 1e6
    chunks = int(mb / CHUNK_MB) + 1
    parts = parts_for(spark, mb, 4 * CHUNK_MB)
    # rows that share an id, or have none, are dealt by where they are read; their order is that of their texts' hashes
    place = F.xxhash64(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.spark_partition_id())
    dealt = slim.select("doc_id", "text", *[F.xxhash64("text").alias("tie")] * keep_first, F.pmod(place, F.lit(chunks)).alias("chunk")).repartition(max(chunks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunk").groupBy("chunk")
    limit = HOT_WINDOWS
    chunk_of = lambda table: Chunk(table, unit, length, gram, keep_first)

    def name(key: tuple, table: pa.Table) -> pa.Table:
        own = chunk_of(table)
        return _named(key[0].as_py(), own.anchor, own.n, parts)

    def name_hot(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        hot = _joined(back["hot"], "<u8")
        if not table.num_rows or not len(hot):
            return _NAMED.empty_table()
        keys = chunk_of(table).windows(hot)[1]
        return _named(key[0].as_py(), keys, np.ones(len(keys), np.int64), parts)

    def pack(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows or not back.num_rows:
            return _PACKED.empty_table()
        own = chunk_of(table)
        run = np.flatnonzero(np.isin(own.anchor, _joined(back["anchors"], "<u8")))
        strings: dict[bytes, int] = {}
        many = np.array([strings.setdefault(s, k) for k, s in enumerate(own.packed(run))], np.int64)  # index of the first with the string
        lead = np.array(list(strings.values()), np.int64)
        copies, run = np.bincount(many, minlength=len(run))[lead], run[lead]
        del strings
        start, anchor, n, at = own.start[run], own.anchor[run], own.n[run], own.place[run]
        if len(hot := _joined(back["hot"], "<u8")):
            one, hashed, check = own.windows(hot)
            met = np.isin(hashed, _joined(back["single"], "<u8"))
            one, hashed, check = one[met], hashed[met], check[met]
            order = np.lexsort((one, check, hashed))
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(one)), bool), (hashed[order][1:] != hashed[order][:-1]) | (check[order][1:] != check[order][:-1]))))
            copies = np.concatenate((copies, np.diff(np.append(first, len(one)))))
            one, hashed = one[order[first]], hashed[order[first]]
            run, start, anchor = np.concatenate((run, -1 - one)), np.concatenate((start, one)), np.concatenate((anchor, hashed))
            n, at = np.concatenate((n, np.ones(len(one), np.int64))), np.concatenate((at, np.zeros(len(one), np.int64)))
        packed = own.packed(run)
        doc = np.searchsorted(own.first, start, side="right") - 1
        if keep_first:
            ids = np.array([(1 << 62) if x is None else x for x in own.table["doc_id"].to_pylist()], np.int64)[doc]
            ties = own.table["tie"].to_numpy()[doc]
        else:
            ids = ties = np.zeros(len(doc), np.int64)
        n = np.where(copies > 1, -n, n)
        size = np.array([len(x) for x in packed], np.int64)
        columns = {"run": run, "n": n, "doc": ids, "tie": ties, "at": start - own.first[doc], "anchor": anchor, "place": at, "size": size}
        rows = {f.name: [] for f in _PACKED}
        for part, x in _split(anchor, parts):
            for field, value in columns.items():
                rows[field].append(value[x].tobytes())
            rows["part"].append(part)
            rows["chunk"].append(key[0].as_py())
            rows["bytes"].append(b"".join([packed[k] for k in x.tolist()]))
        return _rows(_PACKED, **rows)

    def mark(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        own = chunk_of(table)
        edge = np.zeros(own.units + 1, np.int32)
        if told.num_rows and table.num_rows:
            lead, n = _joined(told["run"], "<i8"), _joined(told["n"], "<i8")
            flags = b"".join(x.as_py() for x in told["flags"])
            ends = np.cumsum(n).tolist()
            whole = np.flatnonzero(lead >= 0)
            verdict = {s: np.frombuffer(flags[ends[k] - n[k] : ends[k]], np.uint8) for s, k in zip(own.packed(lead[whole]), whole.tolist(), strict=True)}
            run = np.flatnonzero(np.isin(own.anchor, np.unique(own.anchor[lead[whole]])))
            seen: set[bytes] = set()
            for s, begin in zip(own.packed(run), own.start[run].tolist(), strict=True):
                flag = verdict.get(s)
                if flag is None:
                    continue
                if keep_first and s not in seen:  # runs stand in order of id and position
                    seen.add(s)
                    at = np.flatnonzero(flag == 1) + begin
                else:
                    at = np.flatnonzero(flag) + begin
                edge[at] += 1  # the windows of one run start at different places
                edge[at + length] -= 1
            if len(whole) < len(lead):
                single = lead < 0
                one, told_of = -1 - lead[single], np.frombuffer(flags, np.uint8)[(np.cumsum(n) - 1)[single]]
                every, *hashes = own.windows(np.unique(own.anchor[np.searchsorted(own.start, one, side="right") - 1]))
                group = np.unique(np.column_stack(hashes), axis=0, return_inverse=True)[1].ravel()
                value = np.zeros(len(every), np.uint8)
                value[group[np.searchsorted(every, one)]] = told_of
                flag = value[group]
                flag[np.searchsorted(every, one[told_of == 2])] = 0  # the first of all stays
                np.add.at(edge, every[flag > 0], 1)
                np.add.at(edge, every[flag > 0] + length, -1)
        return finish(own, np.cumsum(edge[:-1]) > 0)

    # one query, in which the dealt texts are one exchange that all steps read
    named = dealt.applyInArrow(name, _sql(_NAMED))
    back = named.groupBy("part").applyInArrow(lambda table: _repeated(table, limit), _sql(_BACK))
    hot = dealt.cogroup(back.groupBy("chunk")).applyInArrow(name_hot, _sql(_NAMED))
    single = hot.groupBy("part").applyInArrow(lambda table: _repeated(table, None), _sql(_BACK))
    packed = dealt.cogroup(back.union(single).groupBy("chunk")).applyInArrow(pack, _sql(_PACKED))
    told = packed.groupBy("part").applyInArrow(lambda table: _verdicts(table, unit, length, keep_first), _sql(_VERDICT))
    return dealt.cogroup(told.groupBy("chunk")).applyInArrow(mark, schema)

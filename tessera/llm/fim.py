"""Fill-in-the-middle: each text is cut at two seeded places and its parts are put in another order, between marks.

Method (distinct-text index): identical texts form one group under their SHA-256 digest, and each copy is compared with the group's
text, code by code, before it is dropped. The places where code points begin are stored once for each distinct text, as an
Elias-Fano list (low bits in planes, high parts as a unary bit vector with a directory of ranks): select(i) gives the byte at which
code point i begins, at two to three bits a code point. Documents travel without their texts, meet the index by digest and select
the two cuts that their seed draws.

Texts are exchanged once, one of each slice of a task's rows, with the slim rows of all documents; the index and its documents are
met in one sorted pass, so a task holds one text at a time. A text of more than a thousandth of the rows is spread: each batch
sends its documents, and one copy of the text, to one of several places.

Defined cases: a null text counts as empty, and an empty one stays plain; so does a text that holds a mark; a very long text is
indexed whole, in memory in proportion to it; a row without an id draws from the empty id; repeated rows each give a row, cut
alike; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_BYTES, frequent_keys, prefixed, read, slices

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text among which a task drops copies before the exchange.
COPY_BYTES = 16 << 20
#: Rows of one text that are left in one place.
TOGETHER = 1000
_BLOCK = 64  # bytes of the bit vector for each rank of the directory


class Boundaries:
    """Elias-Fano list of the bytes at which the code points of a UTF-8 text begin, and of its end."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        self.n = len(at) - 1
        self.width = max((len(data) // max(self.n, 1)).bit_length() - 1, 0)
        self.low = [np.packbits((at >> k) & 1, bitorder="little") for k in range(self.width)]
        places = (at >> self.width) + np.arange(len(at))
        bits = np.zeros(places[-1] + 1, np.uint8)
        bits[places] = 1
        self.high = np.packbits(bits, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(self.high), np.arange(0, len(self.high), _BLOCK), dtype=np.int64)
        self.rank = np.concatenate(([0], np.cumsum(ones)))

    def select(self, i: int) -> int:
        """The byte at which code point i begins."""
        block = int(np.searchsorted(self.rank, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * _BLOCK : (block + 1) * _BLOCK], bitorder="little")
        place = int(np.flatnonzero(bits)[i - self.rank[block]]) + block * _BLOCK * 8
        low = sum(int(plane[i >> 3] >> (i & 7) & 1) << k for k, plane in enumerate(self.low))
        return (place - i) << self.width | low


def _spread(rows: DataFrame) -> dict[bytes, int]:
    """For each text of more than a thousandth of the rows, so at most a thousand, the number of its places."""
    hot, limit = frequent_keys(rows, "key", least=TOGETHER)
    return {bytes(r["key"]): -(-r["n"] // limit) for r in hot.collect()} if hot is not None else {}


def cut(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row. Of texts that can be cut, `percent` in a hundred are, and
    of these `spm_percent` in a hundred have the suffix first."""
    slim = prefixed(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    draw = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 32)
    rows = slim.select("doc_id", draw.alias("draw"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    spread = _spread(rows.select("key"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct texts of each slice, without draw, and its documents, without text."""
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text", COPY_BYTES):
                turn += 1
                part = part.combine_chunks()
                keys, texts = part["key"].to_pylist(), part["text"]
                place: dict[bytes, int] = {}
                first = [place.setdefault(k, j) for j, k in enumerate(keys)]
                copies = [j for j, f in enumerate(first) if f != j]
                if copies and not pc.all(pc.equal(texts.take(copies), texts.take([first[j] for j in copies]))).as_py():
                    raise ValueError("different texts share a digest")
                ones = list(place.values())
                salt = pa.array([turn % spread.get(k, 1) for k in keys], pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "key": part["key"].take(ones).combine_chunks(), "salt": salt.take(pa.array(ones)), "draw": pa.nulls(len(ones), pa.string()),
                    "doc_id": pa.nulls(len(ones), part["doc_id"].type), "text": texts.take(ones).combine_chunks().cast(pa.string()),
                })
                yield pa.RecordBatch.from_pydict({
                    "key": part["key"].combine_chunks(), "salt": salt, "draw": part["draw"].combine_chunks().cast(pa.string()), "doc_id": part["doc_id"].combine_chunks(), "text": pa.nulls(len(keys), pa.string()),
                })

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        key, raw, index, whole = None, b"", None, True
        for batch in batches:
            taken, out, size = [], [], 0
            draws, texts = batch["draw"].to_pylist(), batch["text"]
            for j, k in enumerate(batch["key"].to_pylist()):
                if draws[j] is None:
                    own = texts[j].as_py().encode()
                    if k != key:
                        key, raw, index = k, own, Boundaries(own)
                        whole = not own or any(m.encode() in own for m in MARKS)
                    elif own != raw:
                        raise ValueError("different texts share a digest")
                    continue
                taken.append(j)
                out.append(_cut(raw, index, whole, draws[j], percent, spm_percent))
                size += len(raw)
                if size > SLICE_BYTES:
                    yield _batch(names, batch, taken, out)
                    taken, out, size = [], [], 0
            if out:
                yield _batch(names, batch, taken, out)

    met = rows.mapInArrow(dealt, f"key binary, salt int, draw string, doc_id {kind}, text string").repartition("key", "salt").sortWithinPartitions("key", "salt", F.asc_nulls_first("draw"))
    return met.mapInArrow(selected, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _cut(raw: bytes, index: Boundaries, whole: bool, draw: str, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    one, two, three, four = (int(draw[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = index.n
    if whole or three % 100 >= percent:
        return n, "plain", None, None, raw.decode()
    a, b = sorted((one % (n + 1), two % (n + 1)))
    p, q = index.select(a), index.select(b)
    prefix, middle, suffix = raw[:p].decode(), raw[p:q].decode(), raw[q:].decode()
    if four % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _batch(names: list[str], batch: pa.RecordBatch, taken: list[int], out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(taken)), *columns], names)


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of. No part holds a mark, and marks don't overlap, so that the first one of each kind is it."""
    part = F.split(output, "|".join(MARKS), -1)
    joined = F.when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.concat(part[1], part[3], part[2]))
    return F.when(form == "plain", output).otherwise(joined)


OP11_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, x, CAST(length(x) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM p"""


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how it was cut, and digests of the output and of the text restored from it."""
    out = cut(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

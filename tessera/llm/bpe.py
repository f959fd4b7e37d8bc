"""Byte-level BPE with a public vocabulary: encoding by a traversal of the words' trie, and decoding.

Method (prefix-sharing trie traversal): the distinct words of a slice of texts form a trie, kept as their sorted list, in which
neighbours share the path of their common prefix. Going down it depth first, each node gets one state: the last token of the
encoding of its prefix. That token is the only suffix of the prefix in the vocabulary whose pair with the state before it is
stable, so a state is found from the states above it, and a shared prefix is encoded once. A word's ids are read back along
its states. Words already met by the worker are not traversed again; what it keeps is bounded.

Defined cases: a null or empty text has no ids and decodes to the empty text; the special token's own string is one id, as the
public library does by default; repeated rows each give a row; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import prefixed, read, slices

#: How the vocabulary's pre-tokenizer cuts a text into words (a fixed value of the vocabulary).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words whose ids a worker keeps, and pairs whose verdict it keeps; then it starts anew. Workers stay alive between stages, so
#: what they keep takes memory from whatever runs next.
KEPT_WORDS, KEPT_PAIRS = 150_000, 300_000
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 512 << 10


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(extra)] = b
            extra += 1
    return out


class Vocabulary:
    def __init__(self, data: bytes):
        content = json.loads(data)
        model, of = content["model"], _printable()
        raw = lambda token: bytes(of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes = {i: raw(t) for t, i in model["vocab"].items() if t not in self.special}
        self.id = {b: i for i, b in self.bytes.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.size = {i: len(b) for i, b in self.bytes.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank, self.parts = {}, {}
        for r, (a, b) in enumerate(merges):
            a, b = self.id[raw(a)], self.id[raw(b)]
            whole = self.id[self.bytes[a] + self.bytes[b]]
            self.rank.setdefault((a, b), (r, whole))
            self.parts.setdefault(whole, (r, a, b))
        self.stable: dict[int, bool] = {}
        self.table = [self.bytes[i] for i in range(len(self.bytes))]
        self.begins: set[bytes] = set()
        self.states, self.numbers, self.ends, self.step = [b""], {b"": 0}, [[]], {}
        self.kept: dict[str, bytes] = {}
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """Merging pair by pair, lowest rank first: for single tokens."""
        ids = [self.id[word[k : k + 1]] for k in range(len(word))]
        while len(ids) > 1:
            r, k = min((self.rank.get(p, (1 << 60, 0))[0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if r == 1 << 60:
                break
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def is_stable(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when both are merged side by side: undoing their merges, latest first, no pair
        across the border may have been merged before the later of the two undone."""
        a, b, before, out = left, right, 1 << 60, True
        # `before`: merges of this rank or later come after the border's chance; an equal rank goes to the leftmost pair
        side = 0
        while True:
            met = self.rank.get((a, b))
            if met and (met[0] < before or (met[0] == before and side == 2)):
                out = False
                break
            ra, rb = self.parts.get(a, (-1,))[0], self.parts.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                break
            # the merge undone next is the later one; of equal ranks the right one, as the left one came first
            if ra > rb:
                before, side, a = ra, 1, self.parts[a][2]
            else:
                before, side, b = rb, 2, self.parts[b][1]
        self.stable[left << 32 | right] = out
        return out

    def traverse(self, words: list[str]) -> None:
        """Ids of the distinct words, kept as little-endian 32-bit numbers.

        Beside the last token, a node holds the longest end of its prefix that begins a token: that end lists the tokens which
        are suffixes of the prefix, the longest first."""
        step, ends, stable, size, kept = self.step, self.ends, self.stable, self.size, self.kept
        last, at, above = [0], [0], b""
        for coded, word in sorted([(w.encode(), w) for w in words]):
            shared = 0
            for x, y in zip(above, coded):  # noqa: B905  the shorter one ends it
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], at[shared + 1 :]
            here, k = at[shared], shared
            for byte in coded[shared:]:
                key, k = here << 8 | byte, k + 1
                here = step.get(key)
                if here is None:
                    here = self.grow(key)
                at.append(here)
                for length, token in ends[here]:
                    if length == k:
                        break
                    fits = stable.get(last[k - length] << 32 | token)
                    if fits or fits is None and self.is_stable(last[k - length], token):
                        break
                last.append(token)
            above, out = coded, []
            while k:
                token = last[k]
                out.append(token)
                k -= size[token]
            out.reverse()
            kept[word] = array("I", out).tobytes()

    def grow(self, key: int) -> int:
        """The step by one byte from a state; states are made as they are met, at most one for each beginning of a token."""
        if not self.begins:
            self.begins = {b[:k] for b in self.id for k in range(len(b) + 1)}
        end = self.states[key >> 8] + bytes([key & 255])
        while end not in self.begins:
            end = end[1:]
        if end not in self.numbers:
            self.numbers[end] = len(self.states)
            self.states.append(end)
            tokens = [(len(end) - k, self.id[end[k:]]) for k in range(len(end)) if end[k:] in self.id]
            # a token that merging its own bytes doesn't give stands in no encoding
            self.ends.append([(n, t) for n, t in tokens if n == 1 or self.merged(self.bytes[t]) == [t]])
        out = self.step[key] = self.numbers[end]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        if len(self.stable) > KEPT_PAIRS:
            self.stable.clear()
        out, open_, new, get = [], [], set(), self.kept.get
        for text in texts:
            words: list[str] = []
            at = 0
            for m in self.splitter.finditer(text or "") if self.splitter and "<" in (text or "") else ():
                words += [*WORD.findall(text[at : m.start()]), m[0]]
                at = m.end()
            words += WORD.findall(text[at:] if at else text or "")
            ids = list(map(get, words))
            if None in ids:
                new.update([w for w, x in zip(words, ids, strict=True) if x is None])
                open_.append((len(out), words, ids))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if new:
            for word in new & self.special.keys():  # words never hold a special token: the splitter took it
                self.kept[word] = array("I", [self.special[word]]).tobytes()
            self.traverse([*(new - self.special.keys())])
        for k, words, ids in open_:
            out[k] = b"".join([self.kept[w] if x is None else x for w, x in zip(words, ids, strict=True)])
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, array("I", ids))).decode("utf-8", "replace")


_loaded: dict[bytes, Vocabulary] = {}


def loaded(data: bytes) -> Vocabulary:
    """One vocabulary for each worker process."""
    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(data)
    return _loaded[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, ids_sha256, decoded_sha256) of every row; without ids if with_ids is False."""
    slim = prefixed(docs, doc_id=id_col, text=text_col)
    with open(vocabulary or default_vocabulary(), "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(data.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids = own.encode(part["text"].to_pylist())
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                columns = {"doc_id": part["doc_id"].combine_chunks()}
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                columns["n_tokens"] = pa.array(sizes)
                columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                columns["decoded_sha256"] = pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, {'ids array<int>, ' * with_ids}n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) from arrays of ids."""
    slim = prefixed(encoded, doc_id=id_col, ids=ids_col)
    with open(vocabulary or default_vocabulary(), "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(data.value)
        for batch in batches:
            texts = [own.decode(array("I", x.as_py() or []).tobytes()) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: number and digest of its ids, and the digest of the text they decode to."""
    return encode(read(spark, sf_dir, "documents"), with_ids=False)

"""Toxicity by weak supervision: many voters, a model of how far to trust them, and a linear classifier of what they agree on.

Method. Voters are lexicons (fixed lists of insults, and words and word beginnings that the labelled rows' statistics point at) and
patterns (address, threats, masked words, shouting, no hit at all). Each votes toxic, clean, or abstains; the given label is one
noisy voter more. A generative label model is fitted by expectation and maximisation: it estimates what each voter says of toxic
and of clean texts, and the correlations that voters keep once the class is known; a voter that repeats others counts for less,
divided by its summed correlations. Logistic regression with an L2 penalty is then fitted to the posterior labels, over counts of
terms and patterns, and scores every whole text of all documents in one pass of an automaton over its terms.

Only the fit works on a bounded sample: `sample` labelled rows (20,000 unless told otherwise) with the smallest hash of their id,
of texts with the same sketch the one with the smallest hash. Labels, language, source and id are never inputs of a score.

Defined cases: a null text counts as empty and is scored like one; a very long text is read whole; a null label is no label; of
labels that repeat for one id each counts; without labels of both kinds the fixed voters and their prior decide; repeated rows each
give a row; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prefixed, read, slices
from tessera.llm.quality import held_out

SAMPLE, TERMS, STEM = 20_000, 64, (3, 8)
#: Share of the given labels that is taken to be wrong.
LABEL_ERROR = 0.05
#: A telling term stands in so many toxic rows at least, and in this share of them.
LEAST, LEAST_SHARE = 5, 0.02
TOXIC_FROM = 0.5

#: Fixed lists of insults, one voter each.
INSULTS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash garbage clown worthless pathetic disgusting retard bastard asshole bitch fuck fucking shit",
    "de": "idiot idioten trottel dummkopf arschloch abschaum versager wertlos ekelhaft widerlich scheiße hurensohn schwachkopf",
    "fr": "idiot idiote imbécile crétin connard salaud ordure minable pathétique dégoûtant débile merde abruti",
    "es": "idiota imbécil estúpido basura escoria payaso patético asqueroso inútil mierda cabrón pendejo",
}
#: Patterns, one voter each, over lower-case texts but for shouting.
PATTERNS = {
    "address": re.compile(r"\b(?:you(?:'re| are)?|du(?: bist)?|tu(?: es)?|eres) (?:an? |ein |un |una )?(?:" + "|".join(sorted({w for x in INSULTS.values() for w in x.split()})) + r")\b"),
    "threat": re.compile(r"\b(?:kill|hurt|hang|shoot|destroy) (?:you|yourself|them|him|her)\b|\bgo die\b|\bdrop dead\b"),
    "masked": re.compile(r"\b[a-z]{1,2}[*@#$]{2,}[a-z]*\b"),
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b[^a-z\n]{0,3}){4,}!"),
}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Terms and what scoring multiplies. A term that ends in a space is a whole word, another one a word's beginning."""

    terms: tuple[str, ...]
    bias: float
    weights: tuple[float, ...]


class Reader:
    """Counts of terms and patterns of texts, with one automaton."""

    def __init__(self, terms: tuple[str, ...]):
        groups: dict[str, list[int]] = {}
        for k, t in enumerate(terms):
            groups.setdefault(t, []).append(k)
        for j, x in enumerate(INSULTS.values()):
            for w in x.split():
                groups.setdefault(w + " ", []).append(len(terms) + j)
        self.width = len(terms) + len(INSULTS) + len(PATTERNS) + 1
        self.patterns = len(terms) + len(INSULTS)
        self.automaton = ahocorasick.Automaton()
        by_key: dict[str, list[tuple[bool, list[int]]]] = {}
        for t, at in groups.items():
            by_key.setdefault(t.rstrip(" "), []).append((t.endswith(" "), at))
        for key, what in by_key.items():
            self.automaton.add_word(key, (len(key), what))
        self.automaton.make_automaton()

    def counts(self, text: str | None) -> np.ndarray:
        """How often each term, list and pattern is met, and the number of words last."""
        out = np.zeros(self.width, np.float32)
        text = text or ""
        low = text.lower()
        end_of_text = len(low)
        for end, (n, what) in self.automaton.iter(low):
            start = end - n + 1
            if start and low[start - 1].isalpha():
                continue
            closed = end + 1 == end_of_text or not low[end + 1].isalpha()
            for whole, at in what:
                if closed or not whole:
                    out[at] += 1
        for j, (name, p) in enumerate(PATTERNS.items()):
            out[self.patterns + j] = sum(1 for _ in p.finditer(text if name == "shouting" else low))
        out[-1] = sum(1 for _ in _WORD.finditer(low))
        return out


def features(counts: np.ndarray) -> np.ndarray:
    """For each term, list and pattern: whether it is met, how often (up to four) and how densely; then all terms together."""
    words = np.maximum(counts[:, -1:], 1)
    c = counts[:, :-1]
    each = [c > 0, np.minimum(c, 4) / 4, np.minimum(20 * c / words, 1)]
    every = c.sum(1, keepdims=True)
    return np.concatenate([*each, every > 0, np.minimum(every, 4) / 4, np.minimum(20 * every / words, 1)], 1, dtype=np.float64)


def votes(counts: np.ndarray) -> np.ndarray:
    """1 for toxic, -1 for clean, 0 to abstain: each term, list and pattern where it is met; each term and list again where it is
    met often or densely; and for clean where none is, and where hits are rare."""
    words = np.maximum(counts[:, -1], 1)
    c = counts[:, :-1]
    every = c[:, :-1].sum(1)
    met = (c > 0).astype(np.int8)
    again = ((c[:, : -len(PATTERNS)] >= 3) | ((c[:, : -len(PATTERNS)] >= 1) & (50 * c[:, : -len(PATTERNS)] >= words[:, None]))).astype(np.int8)
    none = -(every == 0).astype(np.int8)
    rare = -(200 * every < words).astype(np.int8)
    return np.column_stack([met, again, none, rare])


def label_model(ballots: np.ndarray, prior: float, given: np.ndarray | None = None, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, trust of each voter, log ratios (vote, voter)) of ballots of 1, 0 and -1. Voters that never vote count
    for nothing. given holds a vote of known accuracy, LABEL_ERROR of it wrong; the first guess follows it where it isn't 0. It stays
    in full force, so that the classes keep their meaning while the voters' accuracies are estimated."""
    n, m = ballots.shape
    is_ = np.stack([ballots == v for v in (-1, 0, 1)]).astype(np.float64)
    share = ballots.mean(1) if m else np.zeros(n)
    said = (ballots == 1).any(1)
    q = np.clip(np.where(said, 0.5 + share, prior / 2), 0.02, 0.98)
    odds = np.full(n, np.log(prior / (1 - prior)))
    if given is not None:
        q = np.where(given == 0, q, np.where(given > 0, 1 - LABEL_ERROR, LABEL_ERROR))
        odds += given * np.log((1 - LABEL_ERROR) / LABEL_ERROR)
    trust, ratio = np.ones(m), np.zeros((3, m))
    for _ in range(rounds):
        one = np.stack([x.T @ q for x in is_]) + 1
        all_ = is_.sum(1) + 2
        toxic = one / one.sum(0)
        clean = (all_ - one) / (all_ - one).sum(0)
        ratio = np.log(toxic / clean)
        # a voter may be useless, but is not believed to mean the opposite of what it says
        ratio[2], ratio[0] = np.maximum(ratio[2], 0), np.minimum(ratio[0], 0)
        values = np.array([-1.0, 0.0, 1.0])
        mean = q[:, None] * (values @ toxic) + (1 - q)[:, None] * (values @ clean)
        rest = ballots - mean
        size = np.sqrt((rest**2).mean(0))
        corr = np.divide(rest.T @ rest / max(n, 1), np.outer(size, size), out=np.zeros((m, m)), where=np.outer(size, size) > 1e-9)
        np.fill_diagonal(corr, 0)
        trust = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(0))
        q = 1 / (1 + np.exp(-np.clip(odds + sum(is_[v] @ (trust * ratio[v]) for v in range(3)), -30, 30)))
    return q, trust, ratio


def logistic(x: np.ndarray, q: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> tuple[float, np.ndarray]:
    """Bias and weights of an L2 logistic regression on soft labels, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.full(a.shape[1], penalty * max(len(x), 1))
    ridge[0] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - q) + ridge * w
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:]


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic, order) of labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    return docs.join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", F.xxhash64("doc_id").alias("order"))


def telling_terms(rows: DataFrame, most: int = TERMS) -> tuple[str, ...]:
    """Words and word beginnings that stand more in toxic rows (order, text, toxic) than chance allows, one of each set of rows with
    the same sketch (the smallest hash of a word) counted: near copies prove a term once."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    told = rows.select("order", "doc_id", "toxic", words.alias("words")).withColumn("sketch", F.array_min(F.transform("words", lambda w: F.xxhash64(w))))
    ones = told.groupBy("sketch").agg(F.min_by(F.struct("toxic", "words"), F.struct("order", "doc_id", "toxic")).alias("r")).select("r.*")
    by_word = ones.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    low, high = STEM
    parts = F.concat(F.array(F.concat("word", F.lit(" "))), F.transform(F.sequence(F.lit(low), F.greatest(F.least(F.length("word"), F.lit(high)), F.lit(low))), lambda n: F.substring(F.col("word"), F.lit(1), n)))
    by_term = by_word.select(F.explode(F.array_distinct(parts)).alias("term"), "bad", "good").where(F.length("term") >= low).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = ones.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("rows_bad"), *[F.coalesce(F.sum(c * F.size("words")), F.lit(0)).alias(n) for n, c in (("all_bad", F.col("toxic")), ("all_good", 1 - F.col("toxic")))])
    lift = F.log((F.col("bad") + 0.5) / (F.col("all_bad") + 1)) - F.log((F.col("good") + 0.5) / (F.col("all_good") + 1))
    told = by_term.join(F.broadcast(total)).where(F.col("bad") >= F.greatest(F.lit(LEAST), F.lit(LEAST_SHARE) * F.col("rows_bad"))).withColumn("lift", lift)
    told = told.where(F.col("lift") > 1.5).withColumn("weight", F.col("lift") * (F.col("bad") + 0.5) - F.col("good"))
    best = told.orderBy(F.desc(F.round("weight", 6)), F.desc(F.length("term")), "term").limit(most * 40).select("term").collect()
    out: list[str] = []
    for r in best:
        bare = r["term"].rstrip(" ")
        if len(out) < most and not any(bare.startswith(o.rstrip(" ")) or o.startswith(bare) for o in out):
            out.append(r["term"])
    return tuple(sorted(out))


def counted(docs: DataFrame, terms: tuple[str, ...], keep: list[str]) -> DataFrame:
    """The columns to keep, and counts: what the reader counts in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [reader.counts(t) for t in part["text"].to_pylist()]
                flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32), pa.float32())
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * reader.width)
                yield pa.RecordBatch.from_arrays([*[part[c].combine_chunks() for c in keep], pa.ListArray.from_arrays(offsets, flat)], [*keep, "counts"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, counts array<float>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model, from at most `sample` labelled rows outside the held-out fold. docs: (doc_id, text)."""
    rows = _labelled(docs, labels, sample)
    terms = telling_terms(rows)
    known = counted(rows, terms, ["order", "doc_id", "toxic"]).orderBy("order", "doc_id", "toxic", "counts").limit(sample).collect()
    width = Reader(terms).width
    counts = np.array([r["counts"] for r in known], np.float32).reshape(len(known), width)
    gold = np.array([1 if r["toxic"] else -1 for r in known], np.int8)
    share = float((gold > 0).mean()) if len(gold) else 0.0
    prior = min(max(share, 0.01), 0.99) if 0 < share < 1 else 0.1
    if not 0 < share < 1:
        gold[:] = 0
    # the fixed voters on one made-up row each, so that without labels they still count
    examples = _examples(width, len(terms))
    counts = np.concatenate([counts, examples])
    given = np.concatenate([gold, np.where(examples[:, :-1].any(1), 1, -1).astype(np.int8)])
    q, _, _ = label_model(votes(counts), prior, given)
    bias, weights = logistic(features(counts), q)
    return Model(terms, bias, tuple(map(float, weights)))


def _examples(width: int, terms: int) -> np.ndarray:
    """Counts of texts of ten words: an empty one, one without a hit, and one with two hits of each fixed voter."""
    out = np.zeros((2 + len(INSULTS) + len(PATTERNS), width), np.float32)
    out[1:, -1] = 10
    for j in range(len(INSULTS) + len(PATTERNS)):
        out[2 + j, terms + j] = 2
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights = Reader(model.terms), np.array(model.weights)
        for batch in batches:
            for part in slices(batch, "text"):
                counts = np.array([reader.counts(t) for t in part["text"].to_pylist()], np.float32).reshape(part.num_rows, reader.width)
                score = 1 / (1 + np.exp(-np.clip(features(counts) @ weights + model.bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it is held out, its score, and the prediction."""
    docs = prefixed(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))

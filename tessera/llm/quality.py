"""Quality classifier: a sparse ensemble of rules over document statistics, compiled into column expressions.

Method (rule ensemble): boosted trees of small depth are fitted to the labels; every path from a root to a node becomes a
conjunctive rule over the statistics; logistic regression with an L1 penalty weighs the rules and drops most of them; the rest
become one Spark expression. Statistics and scores are computed by Spark's own functions over whole texts of all documents.

Only the fit works on a bounded sample: `sample` labelled rows (20,000 unless told otherwise) with the smallest hash of their
id, as statistics, not texts. Labels, language, source and id are never inputs of a score.

Defined cases: a null text counts as empty and is scored like one; a very long text is counted whole; a null label is no label; of labels that repeat for one id
each counts; without labels of both kinds every score is the share of label 1, or 0.5; repeated rows each give a row; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prefixed, read

SAMPLE, TREES, DEPTH, CUTS, RATE = 20_000, 40, 3, 32, 0.3
KEEP_FROM = 0.3

_Rule = tuple[tuple[int, float, bool], ...]  # (statistic, threshold, above) of each condition


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text that is not null."""
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    distinct = lambda items: F.size(F.array_distinct(items)) / F.greatest(F.size(items), F.lit(1))
    return {
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": chars / F.greatest(F.size(words), F.lit(1)),
        "distinct_words": distinct(words),
        "distinct_lines": distinct(lines),
        "line_words": F.log1p(F.size(words) / F.greatest(F.size(lines), F.lit(1))),
        "upper": share(r"\p{Lu}+"),
        "digits": share("[0-9]+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:!?'\"()-]+"),
        "stops": share("[.,;:]+"),
        "calls": share("[!?]+"),
    }


NAMES = ("words", "word_length", "distinct_words", "distinct_lines", "line_words", "upper", "digits", "symbols", "stops", "calls")


def _tree(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[_Rule], np.ndarray]:
    """Paths to all nodes of one tree on gradients and curvatures, and its step for each row."""
    rules: list[_Rule] = []
    step = np.zeros(len(x))
    least = max(5.0, 0.002 * len(x))

    def grow(rows: np.ndarray, path: _Rule, depth: int) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        best, at = 1e-6, None
        if depth:
            for f in range(x.shape[1]):
                n = len(cuts[f]) + 1
                count = np.bincount(binned[rows, f], minlength=n).cumsum()[:-1]
                gl, hl = (np.bincount(binned[rows, f], v[rows], n).cumsum()[:-1] for v in (g, h))
                fits = (count >= least) & (len(rows) - count >= least)
                gain = np.where(fits, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                if len(gain) and gain.max() > best:
                    best, at = gain.max(), (f, int(gain.argmax()))
        if at is None:
            step[rows] = gs / (hs + 1)
            return
        f, k = at
        for above in (False, True):
            mine = rows[(binned[rows, f] > k) == above]
            rule = (*path, (f, float(cuts[f][k]), above))
            rules.append(rule)
            grow(mine, rule, depth - 1)

    grow(np.arange(len(x)), (), DEPTH)
    return rules, step


def _holds(rule: _Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, t, above in rule:
        out &= (x[:, f] > t) == above
    return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.001, rounds: int = 300) -> tuple[float, list[tuple[_Rule, float]]]:
    """Intercept and weighted rules."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return math.log(share / (1 - share)), []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    score, rules = np.full(len(y), math.log(share / (1 - share))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        paths, step = _tree(x, cuts, binned, y - p, p * (1 - p))
        rules += paths
        score += RATE * step
    held: dict[bytes, tuple[_Rule, np.ndarray]] = {}
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):  # the shortest of rules that hold alike
        v = _holds(rule, x)
        if 0 < v.sum() < len(v):
            held.setdefault(np.packbits(v if not v[0] else ~v).tobytes(), (rule, v))
    kept = [rule for rule, _ in held.values()]
    a = np.column_stack([v for _, v in held.values()]).astype(np.float64)
    centre = a.mean(0)
    scale = np.maximum(a.std(0), 1e-3)
    a = (a - centre) / scale
    w, z, t, bias = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0, math.log(share / (1 - share))
    v = np.ones(a.shape[1])
    for _ in range(20):  # largest eigenvalue, for the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(y) / max(float(v @ (a.T @ (a @ v))), 1e-9)
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ z + bias))) - y
        bias -= 2 * r.mean()
        new = z - rate * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        u = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / u * (new - w), new, u
    for _ in range(50):
        bias -= 2 * (1 / (1 + np.exp(-(a @ w + bias))) - y).mean()
    used = np.flatnonzero(np.abs(w) > 1e-4)
    weight = w / scale
    return float(bias - (weight[used] * centre[used]).sum()), [(kept[k], float(weight[k])) for k in used]


def compiled(intercept: float, rules: list[tuple[_Rule, float]], column: dict[int, Column]) -> Column:
    """The score as one expression over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        parts = [(column[f] > t) if above else (column[f] <= t) for f, t, above in rule]
        both = parts[0]
        for p in parts[1:]:
            both = both & p
        total = total + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[_Rule, float]]]:
    """The model, from at most `sample` labelled rows outside the held-out fold. docs: (doc_id, text)."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "quality", *[c.alias(n) for n, c in statistics(text).items()])
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *NAMES).limit(sample).toPandas()
    return fit(rows[list(NAMES)].to_numpy(np.float64), rows["quality"].to_numpy(np.float64))


def scored(docs: DataFrame, model: tuple[float, list[tuple[_Rule, float]]], text_col: str = "text") -> DataFrame:
    """(row, score): each row of docs as a struct, so that no column of it can clash."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in statistics(text).items()])
    return told.select("row", compiled(*model, {k: F.col(n) for k, n in enumerate(NAMES)}).alias("score"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it is held out, its score, and the prediction."""
    docs = prefixed(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))

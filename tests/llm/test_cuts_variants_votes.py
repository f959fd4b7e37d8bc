"""Fill-in-the-middle and spelling variants against brute force, toxicity by held-out accuracy and by its label model."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fim, toxicity, variants
from tests.llm.test_ops import bag, sha


def brute_cut(i, t, seed=1):
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_boundaries():
    r = random.Random(4)
    for n in (0, 1, 2, 63, 64, 700, 5000):
        for letters in ("a", "aé", "漢字", "a漢😀é", "😀"):
            text = "".join(r.choice(letters) for _ in range(n))
            raw = text.encode()
            index = fim.Boundaries(raw)
            assert index.n == n
            for i in {0, n, *(r.randint(0, n) for _ in range(40))}:
                assert raw[: index.select(i)] == text[:i].encode()
    index = fim.Boundaries(("é" * 100_000).encode())
    assert len(index.high) + sum(map(len, index.low)) < 3 * 100_000 / 8 + 64


def test_op11(spark, corpus):
    root, rows = corpus
    got = fim.op11_fim(spark, root).collect()
    want = [brute_cut(i, t) for i, t in rows]
    assert bag((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got) == bag((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows, strict=True))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet/*.parquet'")
    told = con.sql(f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 FROM ({fim.OP11_SQL})").fetchall()
    assert bag(told) == bag((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got)


def test_cut_of_a_text_that_very_many_documents_share(spark):
    texts = ["shared <text> é" * 3, "half a mark <P", "<M> whole", "<S", "P>", "<", "<P><S><M>", "one" * 3000]
    rows = [(k, texts[0] if k % 3 else texts[k % len(texts)]) for k in range(6000)] + [(None, texts[1]), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fim.cut(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert bag((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == bag(brute_cut(i, t) for i, t in rows)
    assert bag((r.doc_id, r.back) for r in got) == bag(rows)
    assert fim._spread(docs.select(F.unhex(F.sha2("text", 256)).alias("key"))) != {}
    other = fim.cut(docs.limit(200), seed=9, percent=100, spm_percent=100).where("form <> 'plain'")
    assert {r.form for r in other.collect()} == {"spm"}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows, noise=199):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_groups(vocabulary):
    near = {w: [x for x in vocabulary if one_edit(w, x)] for w in vocabulary}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 5 * n else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocabulary.get(form[w])))
    return out


def test_candidates_are_all_words_one_edit_away():
    everything = np.full(1 << 13, 255, np.uint8)
    for word in ("abc", "aab", "aaaa", "a", "éaé"):
        alphabet = "abé"
        _, out = variants.candidates([word], alphabet, everything)
        wanted = {word[:k] + word[k + 1 :] for k in range(len(word))}
        wanted |= {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in alphabet if c != word[k]}
        wanted |= {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in alphabet}
        assert collections.Counter(out) == collections.Counter(wanted)
        assert set(out) == {x for x in wanted if one_edit(word, x)}
    # the hash of each is that of the string itself, so a map of only one word lets that word through
    for target in ("abcdef", "abdef", "abccdef", "abxdef"):
        bits = 1 << 16
        one, two = variants._bits(variants.hashes([target]), bits)
        own = np.zeros(bits // 8, np.uint8)
        for p in (*one, *two):
            own[p >> 3] |= 1 << (p & 7)
        assert (target in variants.candidates(["abcdef"], "abcdefx", own)[1]) == (target != "abcdef")


def test_op12(spark, corpus):
    root, rows = corpus
    got = bag(tuple(r) for r in variants.op12_spelling(spark, root).collect())
    assert got == bag(brute_groups(brute_words(rows)))


def test_forms_are_followed_to_their_roots(spark):
    r = random.Random(12)
    count = {"abcdef": 4000, "abcdeg": 800, "abcdgg": 160, "abcggg": 30, "abgggg": 6, "abcdefg": 700, "abcdf": 900, "ABCDEÉ".lower(): 5, "zzzzzz": 7, "zzzzzy": 7, "zzzzzx": 35, "zzzzzw": 35}
    tokens = [w.upper() if r.random() < 0.2 else w for w, n in count.items() for _ in range(n)]
    r.shuffle(tokens)
    rows = [(k, " ".join(tokens[k::97])) for k in range(97)] + [(None, None), (500, ""), (501, "x1y2 abcdef7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = variants.grouped(variants.words(docs))
    told = {w.word: w for w in plain.collect()}
    assert (told["abgggg"].form, told["abgggg"].root) == ("abcggg", "abcdef")
    assert (told["zzzzzz"].form, told["zzzzzx"].form, told["zzzzzx"].n_near) == ("zzzzzw", None, 3)
    assert bag(tuple(w) for w in told.values()) == bag(brute_groups(brute_words(rows, 0)))
    noisy = variants.grouped(variants.words(docs, noise=3))
    assert bag(tuple(w) for w in noisy.collect()) == bag(brute_groups(brute_words(rows, 3)))
    with pytest.raises(ValueError):
        variants.grouped(docs.selectExpr("text as word", "doc_id as n"), ratio=1)


def test_voters_that_repeat_others_count_for_less():
    r = np.random.default_rng(3)
    y = r.random(4000) < 0.3
    vote = lambda good, votes_: np.where(r.random(4000) < votes_, np.where(r.random(4000) < good, y, ~y) * 2 - 1, 0)
    alone, weak, copied = vote(0.9, 0.7), vote(0.65, 0.7), vote(0.75, 0.7)
    ballots = np.column_stack([alone, weak, copied, copied, copied]).astype(np.int8)
    q, trust, ratio = toxicity.label_model(ballots, 0.3)
    assert trust[0] > 0.8 and all(t < 0.5 for t in trust[2:])
    assert ratio[2, 0] > ratio[2, 1] > 0 > ratio[0, 1] > ratio[0, 0]
    naive = ballots.sum(1) > 0
    assert ((q > 0.5) == y).mean() > max((naive == y).mean(), 0.85)


def test_logistic_meets_its_optimum():
    r = np.random.default_rng(5)
    x, q = r.random((300, 4)), r.random(300)
    bias, w = toxicity.logistic(x, q)
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.abs(x.T @ (p - q) + 1e-3 * 300 * w).max() < 1e-4 and abs((p - q).sum()) < 1e-3


def test_op13(spark, corpus):
    root, rows = corpus
    got = toxicity.op13_toxicity(spark, root).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert not [r for r in got if r.predicted]  # nothing here is toxic


def test_without_labels_the_fixed_voters_decide(spark):
    rows = [(1, "a calm text about nothing"), (2, "you idiot, you are a moron"), (3, "DU VERSAGER"), (4, None), (5, ""), (6, "quel crétin minable"), (None, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.doc_id for r in toxicity.scored(docs, model).where("score >= 0.5").collect()} == {2, 3, 6}


def test_terms_are_learnt_in_any_language(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeo") for _ in range(r.randint(2, 6)))
    rows, labels = [], []
    for k in range(1500):
        bad = k % 8 == 0
        body = [word() for _ in range(r.randint(20, 80))]
        if bad:
            for _ in range(3):
                body.insert(r.randrange(len(body)), r.choice(["zhuk", "zhukoo", "gruxal", "gruxalen"]) if k % 2 == 0 else "x")
        rows.append((k, " ".join(body)))
        labels.append((k, int(bad) if r.random() > 0.02 else int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(t.startswith("zhuk") for t in model.terms) and any(t.startswith("gruxa") for t in model.terms)
    got = {x.doc_id: x.score >= 0.5 for x in toxicity.scored(docs, model).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k] == (k % 8 == 0) for k in held]) >= 0.98


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_op13_on_held_out_labels(spark):
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet").where("toxic is not null")
    rows = toxicity.op13_toxicity(spark, root).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.95 * sum(r.predicted for r in rows) and hit >= 0.85 * sum(r.toxic for r in rows)

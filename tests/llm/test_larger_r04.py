"""What shows only on larger corpora, on small cases."""

import time

import numpy as np

import corpus_pipeline
from tessera.llm import minhash, windows


def test_growing_tables_of_near_dedup_do_not_go_through_the_driver(spark, corpus, monkeypatch):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    plans, kept = [], minhash.checkpointed

    def noted(df):
        out = kept(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(minhash, "checkpointed", noted)
    monkeypatch.setattr(minhash, "COLD", 0)
    monkeypatch.setattr(minhash, "FEW", -1)  # what is bounded by it is not of interest here
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # all tables are taken to be small
    try:
        out = corpus_pipeline.drop_near_duplicates(spark, docs, corpus[0])
        assert out.count() > 0
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        assert len(plans) > 10 and not [p for p in plans if "BroadcastExchange" in p]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_minimisers_take_time_in_proportion_to_their_chunks():
    r = np.random.default_rng(1)
    keys = [np.unique(windows.mix(r.integers(0, 400_000, 2000).astype(np.uint64))) for _ in range(300)]  # wide, as hashes are
    keys[7] = keys[7][:0]
    size = [np.full(len(k), 3, np.int64) for k in keys]
    table = windows._rows(windows._NAMED, part=[0] * 300, chunk=list(range(300)), anchors=[k.tobytes() for k in keys], times=[np.ones(len(k), np.int64).tobytes() for k in keys], windows=[n.tobytes() for n in size])
    began = time.process_time()
    many, one = windows._repeated(table, 8), windows._repeated(table, None)
    assert time.process_time() - began < 5
    values, times = np.unique(np.concatenate(keys), return_counts=True)
    more, hot = set(values[times > 1].tolist()), set(values[3 * times > 8].tolist())
    cold = more - hot
    told = lambda row, field: np.frombuffer(row[field], np.uint64).tolist()
    for row in many.to_pylist():
        own = keys[row["chunk"]].tolist()
        assert told(row, "anchors") == [k for k in own if k in cold] and told(row, "hot") == [k for k in own if k in hot] and not row["single"]
    for row in one.to_pylist():
        assert told(row, "single") == [k for k in keys[row["chunk"]].tolist() if k in more] and not row["anchors"] and not row["hot"]
    assert many.num_rows == one.num_rows == 299

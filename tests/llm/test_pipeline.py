"""The corpus pipeline against a plain driver-side version of its stages."""

import numpy as np

import corpus_pipeline
from loadshape.llm import decontaminate, quality, simhash
from loadshape.llm.shared import local_components

from .conftest import SF


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = decontaminate.Windows(benchmark, decontaminate.WINDOW_WORDS)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_classifier":
            model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            score = quality.log_odds(list(before.values()), *model)
            assert after == {d: t for (d, t), z in zip(before.items(), score) if z >= 0}
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            u = np.array([simhash.fingerprint(before[d]) for d in ids], np.uint64)
            i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None]) <= 3)
            label = local_components(i, j, len(u))
            assert sorted(after) == [d for k, d in enumerate(ids) if label[k] == k]
        elif name == "benchmark_decontamination":
            sizes, hits = decontaminate.batch_hits([before[d] for d in before], windows, 10 ** 6)
            bad = {d for d, n, (spans, _) in zip(before, sizes, hits)
                   if (m := int((spans[:, 1] - spans[:, 0]).sum())) and 20 * m >= n}
            assert set(after) == set(before) - bad
        if name != "sentencepiece_encoding":
            assert out.columns == docs.columns
            docs = out
        else:
            assert after == before and out.where("not parity or not round_trip").count() == 0


def test_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "x" * 50_000, "en", "s", 50_000)],
                                 docs.schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = quality.fit(rows, labels, "quality", folds=3, fold=1)   # no labelled text: the prior decides alike for all
    passes = quality.log_odds([""], *known)[0] >= 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
        left = sorted(str(r.doc_id) for r in stage(spark, rows, SF).collect())
        want = {"quality_classifier": ["1", "2", "None"] if passes else [], "simhash_near_dedup": ["1", "2"]}
        assert left == want.get(name, ["1", "2", "None"]), name

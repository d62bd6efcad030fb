"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times, its result consumed by a no-op sink; the
median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ["embed_bert", "embed_qwen3", "embed_int8_full", "wordpiece_ids", "gpt2_pretokens", "basic_tokens", "bpe_ids", "l2_normalize", "layer_norm", "linear_relational", "attn_causal", "mean_pool", "quant_a8", "bench_stats"]


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", str(2 * int(CPUS))).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from textvec.operators import nn, pipeline
    from textvec.plans import catalog
    from textvec.plans.texts import spread

    times = {}
    for name in HEADLINE:
        own = []
        for _ in range(RUNS + 1):
            start = time.time()
            catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            own.append(time.time() - start)
        times[name] = round(sorted(own[1:])[RUNS // 2], 3)
    # a model of the width and depth of a common small one, on one in ten texts
    small = pipeline.Embedder.tiny("bert", hidden=384, layers=6, heads=12, inter=1536, max_len=93)
    some = spread(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 10 = 0").select("text")).cache()
    many = some.count()
    own = []
    for _ in range(2):
        start = time.time()
        pipeline.embed(some, small).select("embedding").write.format("noop").mode("overwrite").save()
        own.append(time.time() - start)
    macs_of = lambda s: sum(x[0] * x[1] for t, x in nn.tensors(s).items() if t.startswith("layer") and len(x) == 2) * s.max_len
    wide = {"texts_per_s_per_core": round(many / min(own) / int(CPUS), 2), "layers": 6, "hidden": 384, "tokens": 93, "gmacs_per_s_per_core": round(macs_of(small.spec) * many / min(own) / int(CPUS) / 1e9, 2)}
    spec = pipeline.Embedder.tiny("bert").spec
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    macs = sum(s[0] * s[1] for t, s in nn.tensors(spec).items() if t.startswith("layer") and len(s) == 2) * spec.max_len
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF, "cpus": int(CPUS), "embed": {"texts_per_s_per_core": round(n / times["embed_bert"] / int(CPUS), 1), "layers": spec.layers, "hidden": spec.hidden, "tokens": spec.max_len, "mmacs_per_text": round(macs / 1e6, 3)}, "embed_small": wide}))


if __name__ == "__main__":
    main()

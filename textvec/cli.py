"""Command line: textvec {embed,validate,bench,serve} --model FOLDER."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import checkpoint, nn, pipeline, serving
from .sources import golden
from .streaming.endpoint import endpoint


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("textvec").getOrCreate()


def _model(spark: SparkSession, args) -> pipeline.Embedder:
    mode = nn.FULL if args.int8act else nn.WEIGHTS if args.int8 else nn.FP32
    own = checkpoint.load(spark, args.model, mode, args.dim, args.pack)
    if own.mode_active != mode:
        raise ValueError(f"{mode} was asked for, but {own.mode_active} would run")
    return own


def embed(args) -> int:
    spark = _spark()
    texts = args.texts or [line.rstrip("\n") for line in sys.stdin]
    if not texts:
        raise ValueError("no texts given")
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for r in pipeline.embed(rows, _model(spark, args)).orderBy("k").toLocalIterator():
        v = list(r["embedding"])
        print(json.dumps(v) if args.full else f"{r['text']!r} -> dim={len(v)} {[round(x, 6) for x in v[:8]]}...")
    return 0


def validate(args) -> int:
    spark = _spark()
    own = _model(spark, args)
    want = golden.read(spark, args.golden)
    got = pipeline.tokenize_with(pipeline.embed(want.select("case", "text"), own), own, out="input_ids")
    rows = pipeline.validate(want, got, "case", args.tolerance).orderBy("case").collect()
    for r in rows:
        print(f"{'ok  ' if r['passed'] else 'FAIL'} case {r['case']}: ids {'equal' if r['ids_equal'] else 'differ'}, largest difference {r['max_abs']}, cosine {r['cosine']}")
    return 0 if all(r["passed"] for r in rows) else 1


def bench(args) -> int:
    import time

    spark = _spark()
    own = _model(spark, args)
    tok, enc = own.ready()
    ids = tok.encode(args.text, own.spec.max_len)
    runs = []
    for k in range(args.warmup + args.runs):
        start = time.perf_counter()
        enc.pooled(ids)
        if k >= args.warmup:
            runs.append(("own", time.perf_counter() - start))
    r = pipeline.bench_stats(spark.createDataFrame(runs, "engine string, sec double"), ["engine"]).first()
    print(f"seq={len(ids)} median={1000 * r['median']:.3f}ms p10={1000 * r['p10']:.3f}ms p90={1000 * r['p90']:.3f}ms spread={r['spread']:.1f}%")
    return 0


def serve(args) -> int:
    """Answers to a file of request rows (request_id, body), as JSON lines; or to HTTP requests, until stopped."""
    spark = _spark()
    own = _model(spark, args)
    if args.listen:
        host, _, port = args.listen.rpartition(":")
        with endpoint(spark, own, own.name or args.model, host or "127.0.0.1", int(port), args.max_batch) as server:
            server.serve_forever()
        return 0
    requests = spark.read.schema("request_id string, body string").json(args.requests)
    for r in serving.serve(requests, own, own.name or args.model, max_batch=args.max_batch).orderBy("request_id").toLocalIterator():
        print(json.dumps({"request_id": r["request_id"], "status": r["status"], "response": json.loads(r["response"])}))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textvec", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, run in (("embed", embed), ("validate", validate), ("bench", bench), ("serve", serve)):
        own = verbs.add_parser(verb)
        own.set_defaults(run=run)
        own.add_argument("--model", required=True, help="model folder")
        own.add_argument("--int8", action="store_true", help="int8 weights")
        own.add_argument("--int8act", action="store_true", help="int8 weights and activations")
        own.add_argument("--dim", type=int, default=0, help="Matryoshka width, 0 for all")
        own.add_argument("--pack", help="keep the tensors as a pack here")
        if verb == "embed":
            own.add_argument("--full", action="store_true", help="whole vectors as JSON")
            own.add_argument("texts", nargs="*", help="texts; else lines of standard input")
        elif verb == "validate":
            own.add_argument("--golden", required=True)
            own.add_argument("--tolerance", type=float, default=1e-4)
        elif verb == "bench":
            own.add_argument("--text", default="The quick brown fox jumps over the lazy dog.")
            own.add_argument("--runs", type=int, default=30)
            own.add_argument("--warmup", type=int, default=5)
        else:
            where = own.add_mutually_exclusive_group(required=True)
            where.add_argument("--requests", help="JSON lines of request_id and body")
            where.add_argument("--listen", help="[host:]port to answer HTTP requests at")
            own.add_argument("--max-batch", type=int, default=serving.MAX_BATCH)
    args = parser.parse_args(argv)
    if args.verb == "bench" and (args.runs <= 0 or args.warmup < 0):
        parser.error("--runs must be over 0 and --warmup 0 at least")
    try:
        return args.run(args)
    except (ValueError, OSError) as e:
        print(f"textvec: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

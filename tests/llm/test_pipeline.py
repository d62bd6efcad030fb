"""The pipeline keeps clean documents, drops copies and leaks, and ends in an exact round trip."""

import hashlib


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    out = {r["doc_id"]: r for r in cp.run(spark, src).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(out) <= set(texts) and len(out) > 0.7 * len(texts)
    exact = {}
    for i, t in sorted(texts.items()):
        exact.setdefault(" ".join(t.split()), []).append(i)
    assert all(len(set(ids) & set(out)) <= 1 for ids in exact.values())
    same = sum(r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in out.items())
    assert same > 0.5 * len(out)  # the others lost boilerplate lines


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123 !!", "en", "s", 6), (4, "one two three four five six", "en", None, 27), (4, "one two three four five six", "en", None, 27), (None, "one two three", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == cp.COLUMNS
    kept = [r["doc_id"] for r in docs.collect()]
    assert kept.count(4) <= 1 and 1 not in kept and 3 not in kept


def plain_near_duplicates(rows, n=5, per_cent=80):
    """Ids that a stage for near copies drops, by all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            same = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * same >= per_cent * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) != i}


def test_stages_against_brute_force(spark):
    """Lines, near copies, leaks and tokens of sf0.001, each stage against plain Python on its own input."""
    import base64

    import corpus_pipeline as cp
    import pytest
    from textvec.llm import byte_bpe
    from textvec.llm.common import stored, tokenizer_path
    from textvec.llm.line_dedup import LEAST

    tiktoken = pytest.importorskip("tiktoken")
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet").select(*cp.COLUMNS)
    first = stored(cp.language(spark, docs, src))
    rows = {r["doc_id"]: r for r in first.collect()}
    # lines: distinct pages of a host count once, above a tenth of them and on LEAST at least
    blank = lambda x: not x.strip(" \t\r\f\x0b")
    pages = {}
    for r in rows.values():
        pages.setdefault(r["source"], set()).add(frozenset(x for x in r["text"].split("\n") if not blank(x)))
    bad = {(h, x) for h, own in pages.items() if len(own) >= 10 for x in {x for p in own for x in p} if (n := sum(x in p for p in own)) > len(own) * 0.1 and n >= LEAST}
    want = {}
    for i, r in rows.items():
        kept = [x for x in r["text"].split("\n") if (r["source"], x) not in bad]
        t = "\n".join(kept)
        if len(kept) == len(r["text"].split("\n")) or t.strip(" "):
            want[i] = t
    second = stored(cp.lines(spark, first, src))
    assert {r["doc_id"]: r["text"] for r in second.collect()} == want
    third = stored(cp.near_duplicates(spark, second, src))
    left = {r["doc_id"]: r["text"] for r in third.collect()}
    assert set(left) == set(want) - plain_near_duplicates(sorted(want.items()))
    fourth = stored(cp.decontaminated(spark, third, src))
    clean = {r["doc_id"]: r["text"] for r in fourth.collect()}
    norm = lambda t: " " + " ".join((t or "").lower().split()) + " "
    items = [norm(r["text"]) for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()]
    assert set(clean) <= set(left) and not {i for i, t in clean.items() if any(x in norm(t) for x in items)}
    assert len(left) - len(clean) <= 2 * sum(any(x in norm(t) for x in items) for t in left.values())
    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=byte_bpe.public_pattern(), mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    out = {r["doc_id"]: r for r in cp.tokens(spark, fourth, src).collect()}
    assert set(out) == set(clean)
    for i, t in clean.items():
        ids = enc.encode_ordinary(t)
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_stages_on_an_empty_table(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0

"""The opN_ queries over whole given tables, against plain Python over the same."""

import base64
import hashlib
import os
import zlib

import numpy as np
import pytest

from textvec.llm import byte_bpe, queries, token_counts
from textvec.llm.common import tokenizer_path

from .test_pipeline import plain_near_duplicates

MIDDLE, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
CHECK = "/root/testdata/check_s"


def documents(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op1(spark):
    docs = documents(spark, MIDDLE)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = sorted((i, (r["text"] or "").translate(lower)) for i, r in docs.items())
    got = {r["doc_id"]: r for r in queries.op1_jaccard_join(spark, MIDDLE).collect()}
    assert {i for i, r in got.items() if r["component_id"] != i} == plain_near_duplicates(rows, 3, 90)
    for i, t in rows:
        w = t.encode().split()
        assert got[i]["n_shingles"] == (len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) if len(w) >= 3 else min(1, len(w)))


@pytest.mark.parametrize("sf_dir", [LARGE, CHECK])
def test_op3_recall(spark, sf_dir):
    """64 dimensions, all rows: at least 0.99 of the links of brute force, none below the threshold."""
    if not os.path.isdir(sf_dir):
        pytest.skip(f"no {sf_dir}")
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = sorted(i for i, v in rows.items() if v and None not in v and np.isfinite(v).all() and any(v))
    x = np.array([rows[i] for i in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = np.concatenate([(x[k : k + 500] @ x.T >= 0.9).sum(axis=1) for k in range(0, len(x), 500)]) - 1
    got = {r["vec_id"]: r for r in queries.op3_embedding_dedup(spark, sf_dir).collect()}
    found = sum(r["n_links"] for r in got.values())
    print("links found", found, "of", int(links.sum()))
    assert set(got) == set(rows) and 0.99 * links.sum() <= found and all(got[i]["n_links"] <= links[k] for k, i in enumerate(ids))


def test_op4(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=byte_bpe.public_pattern(), mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    docs = documents(spark, MIDDLE)
    for r in queries.op4_byte_bpe(spark, MIDDLE).collect():
        text = docs[r["doc_id"]]["text"] or ""
        ids = enc.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op7_held_out_accuracy(spark):
    docs = documents(spark, LARGE)
    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, LARGE).collect()}
    assert set(got) == set(docs) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    told = [(docs[i]["lang"], r["lang_pred"]) for i, r in got.items() if r["held_out"] and docs[i]["lang"] is not None]
    right = sum(a == b for a, b in told)
    print("held-out rows predicted right", right, "of", len(told))
    assert right >= 0.97 * len(told)


def test_op8(spark):
    docs = documents(spark, MIDDLE)
    words = {i: (r["text"] or "").encode().split() for i, r in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for r in queries.op8_substring_dedup(spark, MIDDLE).collect():
        w = words[r["doc_id"]]
        gone = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < r["doc_id"]:
                gone[k : k + 50] = True
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)).hexdigest())


def test_op9(spark):
    own = token_counts.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    docs = documents(spark, MIDDLE)
    for r in queries.op9_token_counts(spark, MIDDLE).collect():
        text = docs[r["doc_id"]]["text"] or ""
        n = len(own.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)

"""The ten operators: brute force on small tables, and nulls, empties, ties, repeats, clashing columns."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textvec.llm import byte_bpe, decontamination, language_id, licenses, line_dedup, pii, token_counts
from textvec.llm.common import tokenizer_path
from textvec.llm.embedding_dedup import embedding_dedup
from textvec.llm.jaccard_join import jaccard_join, overlaps
from textvec.llm.substring_dedup import substring_dedup
from textvec.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, token string"


def words(rng, n, size=400):
    return " ".join("w%d" % min(int(rng.paretovariate(0.6)), size) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    base = [words(rng, rng.choice([5, 12, 30, 80, 200])) for _ in range(30)]
    texts = [None, "", " \n\t ", "one", "one two", "One TWO", "ONE two"]
    for t in base:
        texts.append(t)
        for _ in range(rng.choice([0, 1, 3])):
            own = t.split()
            for _ in range(rng.choice([0, 1, 2])):
                own[rng.randrange(len(own))] = "x%d" % rng.randrange(999)
            texts.append(" ".join(own))
    shared = words(rng, 70)
    texts += [words(rng, 20) + " " + shared + " " + words(rng, 20) for _ in range(8)]
    family = words(rng, 150).split()
    for _ in range(60):
        own = list(family)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(150)] = "y%d" % rng.randrange(9999)
        texts.append(" ".join(own))
    return list(enumerate(texts)) + [(None, "one two three"), (3, "one")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in rows], SCHEMA)


def split(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3).cache()


@pytest.mark.parametrize("n,per_cent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, docs, n, per_cent):
    sets = {}
    for i, t in corpus():
        w = [x.lower() for x in split(t)]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            same = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * same >= per_cent * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(docs, n=n, per_cent=per_cent).collect()}
    assert got == {i: (len(s), None if i is None else find(i)) for i, s in sets.items()}
    assert jaccard_join(docs.limit(0), n=n, per_cent=per_cent).count() == 0


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(12)]
    x, rows = np.concatenate(sets), np.repeat(np.arange(12), [len(s) for s in sets])
    got = overlaps(x, rows, x, rows, 12, 12, cells=200)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}


def test_substring_dedup(spark, docs):
    rows = corpus()
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - 49):
            if i is not None:
                s = tuple(w[k : k + 50])
                first[s] = min(first.get(s, i), i)
    want = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in substring_dedup(docs).collect())
    assert substring_dedup(docs.limit(0)).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 16))
    x = np.concatenate([base, base[:40] + 0.05 * rng.normal(size=(40, 16)), np.repeat(base[:1], 50, axis=0), base[3] + 0.3 * rng.normal(size=(60, 16))]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (None, x[0].tolist()), (904, [1.0])]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, class string").repartition(3)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r for r in embedding_dedup(df, block=32).collect()}
    found, true = sum(got[k]["n_links"] for k in range(len(x))), int(links.sum())
    assert len(got) == len(rows) and all(got[k]["n_links"] <= links[k].sum() for k in range(len(x))) and found >= 0.9 * true
    for k in (900, 901, 902, 903, 904):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert got[160]["component_id"] == 0 and not got[160]["kept"]
    assert embedding_dedup(df.limit(0)).count() == 0


def test_embedding_dedup_of_lengths_and_repeated_ids(spark):
    """Each length links among itself; a row that repeats an id has the result of its own vector."""
    rows = [(k, [1.0, 0.1 * k, 0.0, 1.0]) for k in range(6)] + [(10, [1.0, 0.0]), (11, [1.0, 0.01]), (12, [1.0, 0.0]), (20, [3.0]), (21, [-1.0]), (22, [0.5]), (30, [1.0, 2.0, 3.0]), (40, []), (12, [0.0, 1.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=2).collect())
    want = []
    for k, (i, v) in enumerate(rows):
        near = {k}
        while True:
            more = {b for a in near for b, (_, w) in enumerate(rows) if w and len(w) == len(rows[a][1]) and np.dot(rows[a][1], w) >= 0.9 * np.linalg.norm(rows[a][1]) * np.linalg.norm(w)}
            if more <= near:
                break
            near |= more
        direct = sum(1 for b, (_, w) in enumerate(rows) if b != k and w and len(w) == len(v) and np.dot(v, w) >= 0.9 * np.linalg.norm(v) * np.linalg.norm(w)) if v else 0
        least = min(rows[b][0] for b in near)
        want.append((i, direct, least, i == least))
    assert got == sorted(want)


def test_byte_bpe(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=byte_bpe.public_pattern(), mergeable_ranks=ranks, special_tokens={})
    more = ["x" * 2000, "it's  we'll\n\n \t a", "日本語🎉 é", " a", "a ", "\x1c b", "1234567 89"]
    rows = corpus() + [(1000 + k, t) for k, t in enumerate(more)]
    got = byte_bpe.encode_decode(frame(spark, rows), digests=False).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r["doc_id"] not in (None, 3):
            t = texts[r["doc_id"]] or ""
            assert list(r["ids"]) == enc.encode_ordinary(t) and r["decoded"] == t


def test_byte_bpe_decodes_its_ids():
    """One wrong id, one other text: decoding knows nothing but the ids."""
    own = byte_bpe._codec(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    texts = ["some words, and others", "", "more of them"]
    ids, counts = own.encode_texts(texts)
    assert own.decode(ids, counts) == [t.encode() for t in texts]
    wrong = ids.copy()
    wrong[3] = 77
    got = own.decode(wrong, counts)
    assert got[0] == b"".join(own.tokens[i] for i in wrong[: counts[0]].tolist()) != texts[0].encode() and got[2] == texts[2].encode()


def test_byte_bpe_long_words():
    """Recursive query and heap give the same ids for words of a letter, of many letters, and around LONG bytes."""
    own = byte_bpe._codec(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(8)
    words = [("x" * n).encode() for n in (2, 3, 127, 128, 129, 700, byte_bpe.LONG)] + ["".join(rng.choice("etaoinshr") for _ in range(n)).encode() for n in (50, 200, 900)]
    ids, starts, sizes = own.encode(words + [b"the"])
    assert [ids[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == [own.by_heap(w) if w not in own.ranks else [own.ranks[w]] for w in words + [b"the"]]
    assert own.decode(*[own.encode([b"ab" * 200_000])[k] for k in (0, 2)]) == [b"ab" * 200_000]


def test_token_counts(spark, docs):
    own = token_counts.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    encode = lambda t: own.encode(t, add_special_tokens=False)
    more = ["a <|endoftext|> b", "<|endoftext|>" * 40, "x" * 900, "ab cd  \n" * 300, " " * 700 + "a", "é " * 400, "a  b"]
    rows = corpus() + [(1000 + k, t) for k, t in enumerate(more)]
    got = token_counts.token_counts(frame(spark, rows), huge=200).collect()
    want = sorted((len((t or "").encode()), len(encode(t or "").ids)) for _, t in rows)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    for t in more:
        for chunk, overlap in ((50, 40), (120, 64)):
            assert token_counts.resynchronised(encode, t, chunk, overlap) == encode(t).ids


def test_token_counts_of_huge_texts():
    """Texts over the default size: overlapping chunks count what the library counts, long runs without a boundary, too."""
    own = token_counts.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    encode = lambda t: own.encode(t, add_special_tokens=False)
    rng = random.Random(10)
    prose = words(rng, 20_000)
    texts = [prose, prose[:50_000] + "x" * 30_000 + prose[:50_000], "ab" * 25_000, "é\n\n  " * 12_000, prose[:40_000] + "<|endoftext|>" + prose[:40_000], " " * 60_000]
    for t in texts:
        assert len(t) > token_counts.HUGE and token_counts.resynchronised(encode, t) == encode(t).ids


def test_pii(spark):
    text = "mail a.b+c@x-y.example.com now 4111 1111 1111 1111 or +1 (555) 123-4567 at 10.0.0.255 not 10.0.0.256"
    assert [k for k, _, _ in pii.base_spans(text)] == ["email", "card", "phone", "ip"]
    rows = [(k, f"please write to user{k}@mail.example.com today") for k in range(20)] + [(99, "please write to user99 at mail today"), (98, None), (97, "")]
    got = {r["doc_id"]: r for r in pii.pii(frame(spark, rows)).collect()}
    assert len(got) == 23 and all(len(got[k]["base"]) == 1 for k in range(20))
    assert [(s["kind"], rows[20][1][s["start"] : s["end"]]) for s in got[99]["added"]] == [("email_like", "user99")]
    assert not got[98]["base"] and not got[97]["added"]
    assert pii.pii(frame(spark, rows).limit(0)).count() == 0


def plain_spans(text):
    """The base spans by the contract's own patterns."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for place, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
            fits = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and double % 10 == 0, "phone": lambda: 9 <= len(digits) <= 15}  # noqa: B023
            if fits[kind]():
                out.append((m.start(), place, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_pii_base_columns(spark, sf_dir):
    """Every base column of the query against the contract's patterns on whole texts."""
    from textvec.llm.queries import op2_pii

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op2_pii(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        want = plain_spans(t or "")
        assert [got[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(w[0] == kind for w in want) for kind in pii.KINDS]
        said = ["%s:%d:%d" % w for w in want]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(got[k]["spans"].split(",")) | {""}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@-+ (%é29", max_size=40))
def test_pii_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_discovers_unseen_identifiers(spark):
    """Names, handles, odd numbers, keys and secrets in contexts that seeds have taught; longer than any window, too."""
    long, key = "k" * 400, "0123456789abcdef" * 3
    rows = [(k, f"é please write to user{k}@mail.example.com today") for k in range(20)] + [(20 + k, f"call us at +1 (555) 200-{1000 + k} now") for k in range(20)]
    rows += [(40 + k, f'api_token = "{key}{k}" set') for k in range(8)] + [(60, f"é please write to {long} today, please write to Jane"), (61, "call us at 1-800-FLOWERS now"), (62, 'api_token = "hunter2hunter2" set'), (63, "write the paper to end it"), (64, f"a {key} alone"), (60, "another text")]
    rows += [(70 + k, f"w{k} went to v{k} soon") for k in range(50)]
    found = {(r["doc_id"], s["kind"], t[s["start"] : s["end"]]) for r, t in ((r, dict(rows[:-53])[r["doc_id"]] if r["doc_id"] < 60 else [t for i, t in rows if i == r["doc_id"]][0]) for r in pii.pii(frame(spark, rows)).collect()) for s in r["added"]}
    planted = {(60, "email_like", long), (61, "phone_like", "1-800-FLOWERS"), (62, "secret_like", "hunter2hunter2"), *((40 + k, "secret_like", f"{key}{k}") for k in range(8))}
    assert len(found & planted) >= 0.9 * len(planted) and not {f for f in found if f[0] in (63, 64) or f[0] >= 70}


def test_pii_of_long_texts():
    """Long runs with and without an at sign, long numbers: no step back over them."""
    start = time.time()
    for text in ("x" * 1_000_000 + "@", "9" * 1_000_000, "@" * 300_000, "1." * 400_000, "+" * 300_000, "a@b" * 200_000):
        pii.base_spans(text)
    assert time.time() - start < 20 and pii.base_spans("x" * 100_000 + "@y.z") == [("email", 0, 100_004)]


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, "relesed undr the MIT\nlicense"), (3, None), (4, "general public license general public license"), (5, "mitlicense"), (6, "")]
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["score"], got[1]["labels"]) == (1, 3, 1.0, ["mit"])
    assert got[2]["spans"][0]["edits"] == 2 and got[2]["n_base"] == 1
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (2, 0, 3)
    assert got[3]["first_word"] is None and got[5]["n_base"] == 0 and got[6]["n_words"] == 0


def test_licenses_hide_nothing(spark):
    """An edited notice beside an exact one, a word that goes on where a window ends, repeated rows, clashing names."""
    rows = [(1, "relesed under the mit license released under the mit license"), (2, "all rigts reserved all rights reserved"), (3, "all rights reservedxyz"), (4, "all rights reserve"), (1, "x")]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, spans string, score int")
    got = sorted((r["doc_id"], [(s["label"], s["start"], s["end"], s["edits"]) for s in r["spans"]]) for r in licenses.license_scan(df).collect())
    assert got == [(1, []), (1, [("mit", 0, 29, 1), ("mit", 30, 60, 0)]), (2, [("all-rights-reserved", 0, 18, 1), ("all-rights-reserved", 19, 38, 0)]), (3, []), (4, [("all-rights-reserved", 0, 18, 1)])]
    assert licenses.license_scan(df.limit(0)).count() == 0


def edits_of(notice, text):
    """The least edit distance of the notice to any run of whole words."""
    words, best = text.split(), len(notice)
    for a in range(len(words)):
        row = list(range(len(notice) + 1))
        said = ""
        for b in range(a, min(len(words), a + 30)):
            for c in ("" if b == a else " ") + words[b]:
                new = [row[0] + 1]
                for k, x in enumerate(notice):
                    new.append(min(new[-1] + 1, row[k + 1] + 1, row[k] + (x != c)))
                row = new
                said += c
            best = min(best, row[-1])
            if len(said) > len(notice) + 12:
                break
    return best


def test_licenses_against_all_edit_distances(spark):
    """Labels of edited notices in prose: those that plain dynamic programming finds."""
    rng = random.Random(9)
    notices = [("a", "released under the mit license"), ("b", "subject to the terms of the mozilla public license"), ("c", "all rights reserved")]
    rows = []
    for k in range(60):
        parts = [words(rng, 6)]
        for label, t in notices:
            if rng.random() < 0.6:
                own = list(t)
                for _ in range(rng.randrange(6)):
                    at = rng.randrange(len(own))
                    own[at : at + rng.randrange(2)] = rng.choice(["", "q", "zz"])
                parts += ["".join(own), words(rng, 5)]
        rows.append((k, " ".join(parts)))
    got = {r["doc_id"]: set(r["labels"]) for r in licenses.license_scan(frame(spark, rows), notices=notices, base={}).collect()}
    for k, t in rows:
        assert got[k] == {label for label, notice in notices if edits_of(notice, " ".join(t.split())) <= len(notice) // licenses.PER_EDIT}, (k, t)


def test_licenses_base_columns(spark, sf_dir):
    """Every base column of the query, by the contract's words, on whole texts."""
    from textvec.llm.queries import op10_license_scan

    got = {r["doc_id"]: r for r in op10_license_scan(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        own = got[r["doc_id"]]
        assert (own["n_words"], own["n_base"], own["first_word"], own["last_word"], own["base_labels"]) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})))


def test_line_dedup_keeps_clashing_columns(spark):
    rows = [(k, "menu\nbody %d" % k, "h", "kept", 7) for k in range(12)] + [(20, "", "h", "x", 1), (20, "", "h", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string, bad int").withColumnRenamed("bad", "host")
    got = line_dedup.line_dedup(df).collect()
    assert len(got) == 14 and {(r["n_lines"], r["n_lines_in"], r["host"]) for r in got if r["doc_id"] < 12} == {(2, "kept", 7)}
    assert all(r["text"] == f"body {r['doc_id']}" for r in got if r["doc_id"] < 12) and [r["text"] for r in got if r["doc_id"] == 20] == ["", ""]


def test_line_dedup(spark):
    rows = [(k, f"menu\nbody {k}\n\nmenu" if k < 12 else None if k == 12 else f"other {k}", "h" if k < 13 else None) for k in range(16)]
    df = spark.createDataFrame([(i, t, s, "q") for i, t, s in rows], "doc_id long, text string, source string, line string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert got[0]["text"] == "body 0\n" and (got[0]["n_lines"], got[0]["n_dropped"]) == (3, 2)
    assert got[12]["text"] is None and got[12]["n_lines"] == 0 and got[14]["text"] == "other 14" and got[0]["line"] == "q"
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, broadcast_rows=0).collect()} == {k: r["text"] for k, r in got.items()}
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = language_id.fitted(language_id.training_rows(docs.filter("doc_id % 2 = 0"), 40))
    rows = language_id.language_id(docs.filter("doc_id % 2 = 1"), own, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    odd = language_id.language_id(frame(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "the")]), own).collect()
    assert [r["lang_pred"] for r in sorted(odd, key=lambda r: r["doc_id"])][:3] == ["und"] * 3
    nothing = language_id.fitted(language_id.training_rows(docs.limit(0)))
    assert {r["lang_pred"] for r in language_id.language_id(docs, nothing).collect()} == {"und"}


def test_decontamination(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    norm = lambda t: " " + " ".join((t or "").lower().split()) + " "
    items = [(r["item_id"], norm(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], k) for r in docs.collect() for k, t in items if t in norm(r["text"])}
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.decontamination(docs, bench).collect()}
    assert want <= set(got) and all(r["lcs"] >= 0.6 for r in got.values())
    assert decontamination.decontamination(docs.limit(0), bench).count() == 0
    assert decontamination.decontamination(docs, bench.limit(0)).count() == 0


def test_lcs():
    assert decontamination.lcs_length([1, 2, 3, 4, 5], [9, 1, 3, 2, 4, 9]) == 3
    assert decontamination.lcs_length([], [1]) == 0

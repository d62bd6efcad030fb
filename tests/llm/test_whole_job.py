"""Inputs on which an operator once did less than its whole job."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from textvec.llm import decontamination, language_id
from textvec.llm.embedding_dedup import embedding_dedup
from textvec.llm.jaccard_join import jaccard_join
from textvec.llm.shingles import ngrams, word_hashes
from textvec.llm.substring_dedup import substring_dedup

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def prose(rng, n, common=60):
    """Mostly frequent words, and a name in three that stands nowhere else."""
    return ["c%d" % rng.randrange(common) if rng.random() < 0.67 else "n%d" % rng.randrange(10**9) for _ in range(n)]


def matches(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    return {(r["doc_id"], r["item_id"]) for r in decontamination.decontamination(docs, spark.createDataFrame(items, ITEMS)).collect()}


def test_decontamination_long_items(spark):
    rng = random.Random(1)
    items = [(k, prose(rng, n)) for k, n in enumerate((100, 150, 200, 500, 1000))]
    texts = [" ".join(prose(rng, 150)) for _ in range(300)]
    planted = [" ".join(prose(rng, 40 + k) + w + prose(rng, 60)) for k, w in items]
    got = matches(spark, texts + planted, [(k, " ".join(w)) for k, w in items])
    assert got == {(300 + k, k) for k, _ in items}


def test_decontamination_replaced_names(spark):
    """Copies whose names are mostly replaced still hold over 0.75 of the item in order."""
    rng = random.Random(2)
    items, planted = [], []
    for k in range(20):
        w = ["c%d" % rng.randrange(60) for _ in range(40)]
        names = rng.sample(range(40), 10)
        for at in names:
            w[at] = "n%d" % rng.randrange(10**9)
        near = list(w)
        for at in names[:6]:
            near[at] = "m%d" % rng.randrange(10**9)
        items.append((k, " ".join(w)))
        planted += [" ".join(prose(rng, 30 + k) + own + prose(rng, 50)) for own in (w, near)]
    got = matches(spark, [" ".join(prose(rng, 150)) for _ in range(300)] + planted, items)
    assert got == {(300 + k, k // 2) for k in range(40)}


def test_decontamination_space_of_all_documents(spark, monkeypatch):
    """The sums behind the space take in the passages of all documents, however many these are."""
    sums, added = [], decontamination._added

    def kept(df, real, *args):
        sums.append((real, *added(df, real, *args)))
        return sums[-1][1:]

    monkeypatch.setattr(decontamination, "_added", kept)
    assert len(matches(spark, ["alpha beta gamma delta w%d" % k if k % 3 == 0 else "w%d w%d" % (k, k + 1) for k in range(9000)], [(1, "alpha beta gamma delta epsilon")])) == 3000
    assert [n for real, n, _ in sums if real] == [3000]


def test_pipeline_keeps_one_of_many_copies(spark):
    """A third of a host's pages are copies: the line stage leaves them, and still drops its menu."""
    rng = random.Random(3)
    copy = "\n".join(" ".join(prose(rng, 12)) for _ in range(8))
    texts = [copy] * 20 + [copy + "\n\n"] * 5 + ["menu home about\n" + "\n".join(" ".join(prose(rng, 12)) for _ in range(4)) for _ in range(40)]
    two = " ".join(prose(rng, 30))
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(100 + k, two if k < 2 else " ".join(prose(rng, 30)), "en", "small", 1) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert len(out) == len(rows) and all(out[k] == texts[k] for k in range(25)) and out[100] == out[101] == two
    assert not any("menu" in out[k] for k in range(25, 65))
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, docs, ""), "").collect()}
    assert 0 in left and not left & set(range(1, 25)) and 100 in left and 101 not in left


def test_language_id_trains_on_distinct_texts(spark):
    """A group of copies takes one place of the sample, wherever its hash stands."""
    texts = ["text %d of few" % k for k in range(30)]
    docs = spark.createDataFrame([("xx", t) for t in texts for _ in range(50)] + [(None, "none"), ("xx", None)], "lang string, text string").repartition(3)
    for most, want in ((20, 20), (100, 30)):
        got = [r["text"] for r in language_id.training_rows(docs, most).collect()]
        assert len(got) == len(set(got)) == want


def test_language_id_of_70_languages(spark):
    """Each language has letters of its own; all are predicted."""
    rng = random.Random(4)
    texts = lambda k: [" ".join("".join(chr(0x4E00 + 10 * k + rng.randrange(10)) for _ in range(4)) for _ in range(60)) for _ in range(6)]
    rows = [("l%02d" % k, t) for k in range(70) for t in texts(k)]
    filters = language_id.fit(rows)
    assert [filters.predict(t)[0] for _, t in rows] == [lang for lang, _ in rows]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], DOCS)
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(docs, filters).collect()} == {k: lang for k, (lang, _) in enumerate(rows)}


def test_embedding_dedup_far_links_of_a_large_table(spark):
    """Pairs just within the threshold, of which a small sample holds next to none."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6000, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = rng.normal(size=base.shape)
    turn -= (turn * base).sum(1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    x = np.concatenate([base, 0.902 * base + (1 - 0.902**2) ** 0.5 * turn])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    links = sum(int((x[k : k + 1000] @ x.T >= 0.9).sum()) for k in range(0, len(x), 1000)) - len(x)
    found = sum(r["n_links"] for r in embedding_dedup(df, sample=400).collect())
    print("links found", found, "of", links)
    assert 0.985 * links <= found <= links


def test_unigram_ids_of_whole_texts(spark, tmp_path):
    """Two texts that differ after their first 20,000 words have different ids, and all of them."""
    from textvec.plans import texts

    same = "one two three " * 7000
    spark.createDataFrame([(1, same + "four"), (2, same + "five six")], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in texts.QUERIES["unigram_ids"](spark, str(tmp_path)).collect()}
    assert got[1]["digest"] != got[2]["digest"] and min(r["n"] for r in got.values()) > 21_000


def thue_morse(a, b, n):
    """n letters in which a and b alternate so that polynomial hashes modulo a power of two collide with their complement."""
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_long_words_do_not_collide(spark):
    """Two different words of 1,024 letters are two words for all operators that hash words."""
    one, two = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)
    docs = spark.createDataFrame([(1, one), (2, two)], DOCS)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join(docs).collect()} == {1: 1, 2: 2}
    rest = ["w%d" % k for k in range(63)]
    docs = spark.createDataFrame([(1, " ".join([*rest[:32], one, *rest[32:]])), (2, " ".join([*rest[:32], two, *rest[32:]]))], DOCS)
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup(docs).collect()} == {1: 0, 2: 0}
    got = matches(spark, [one + " alpha beta", two + " gamma delta"], [(7, one)])
    assert got == {(0, 7)}


def test_word_sequences_do_not_collide():
    """Windows of two words in the order of Thue and Morse, and of their complement, differ."""
    text = " ".join(thue_morse("a", "b", 4096))
    h, counts = word_hashes(pa.array([text]))
    w = text.split()
    for n in (2, 3, 5, 8, 50):
        assert len(np.unique(ngrams(h, n))) == len({tuple(w[k : k + n]) for k in range(len(w) - n + 1)})


def paraphrase(rng, words, share):
    """The words with some of them replaced, inserted or dropped."""
    out = []
    for w in words:
        x = rng.random()
        if x < share / 2:
            out.append("c%d" % rng.randrange(60))
        elif x < 0.75 * share:
            continue
        else:
            out.append(w)
            if x > 1 - share / 4:
                out.append("c%d" % rng.randrange(60))
    return out


def test_decontamination_finds_paraphrases(spark):
    """Items of a question and an answer; questions reworded by a fourth, answers kept: nine in ten are found, and no others."""
    rng = random.Random(11)
    items, texts = [], []
    for k in range(60):
        question, answer = prose(rng, rng.randrange(25, 60)), prose(rng, 7)
        items.append((k, " ".join(question) + "? " + " ".join(answer)))
        own = paraphrase(rng, question, 0.25)
        texts.append(" ".join([*prose(rng, rng.randrange(80)), *own]) + "? " + " ".join([*answer, *prose(rng, rng.randrange(120))]))
    got = matches(spark, texts + [" ".join(prose(rng, 150)) for _ in range(300)], items)
    print("paraphrases found", len(got), "of", len(items))
    assert len(got & {(k, k) for k in range(60)}) >= 54 and got <= {(k, k) for k in range(60)}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k], row[k + 1])
    return row[-1]


def some_areas(rng, n_words, n_areas, width):
    """Items of 30 of 500 terms each, a text with a third of such words, and areas of it."""
    items = decontamination.Items([(k, " ".join("w%d" % rng.integers(500) for _ in range(30))) for k in range(20)])
    numbers = np.where(rng.random(n_words) < 0.33, rng.integers(0, len(items.terms), n_words), -1).astype(np.int32)
    sizes, n = np.array([len(w) for w in items.words]), len(items.terms)
    holds = np.zeros((len(sizes), n + 1), dtype=bool)
    holds[np.repeat(np.arange(len(sizes)), sizes), items.every] = True
    heavy = holds & np.append(rng.random(n) < 0.2, False)
    begin = rng.integers(0, n_words - width, n_areas)
    return items, (holds, heavy, sizes, numbers, rng.integers(0, len(sizes), n_areas), begin, begin + rng.integers(1, width, n_areas))


def test_decontamination_bounds_equal_loops(monkeypatch):
    """The tests before the subsequence keep what counts word by word keep, however many words are looked up at once."""
    rng = np.random.default_rng(2)
    items, (holds, heavy, sizes, numbers, item, begin, end) = some_areas(rng, 5000, 400, 600)
    for least in (0.1, 0.25, 0.4):
        want = []
        for k, a, b in zip(item, begin, end, strict=True):
            own, lacks = [w for w in numbers[a:b] if holds[k, w]], (1 - least) * sizes[k] + 1e-9
            rare = [w for w in own if heavy[k, w]]
            want.append(min(len(own) - sizes[k], len(set(own)) - holds[k].sum(), len(set(rare)) - heavy[k].sum()) >= -lacks)
        assert 0 < sum(want) < len(want)
        for at_once in (1, 50, 1 << 22):
            monkeypatch.setattr(decontamination, "LOOKED_UP", at_once)
            assert decontamination._possible(items, holds, heavy, sizes, numbers, item, begin, end, least).tolist() == want


def test_decontamination_looks_up_words_of_items():
    """Areas that lack an item's rare words take no array of all their words."""
    items, rest = some_areas(np.random.default_rng(3), 100_000, 40, 90_000)
    rest[1][:, :] = False
    rest[1][np.arange(20), [w[0] for w in np.split(items.every, 20)]] = True
    rest[3][np.isin(rest[3], np.flatnonzero(rest[1].any(axis=0)))] = -1
    tracemalloc.start()
    try:
        assert not decontamination._possible(items, *rest, 1.0).any()
        assert tracemalloc.get_traced_memory()[1] < 8e6
    finally:
        tracemalloc.stop()


def test_decontamination_sums_and_numbers():
    """Words' numbers and blocks' sums equal plain ones, with blocks of one to all words."""
    rng = np.random.default_rng(4)
    items = decontamination.Items([(0, " ".join("t%d" % k for k in range(3000)))])
    h = np.concatenate([rng.permutation(items.terms), rng.integers(0, 1 << 63, 3000).astype(np.uint64), items.terms ^ np.uint64(1)])
    at = {x: k for k, x in enumerate(items.terms.tolist())}
    assert items.numbers(h).tolist() == [at.get(x, -1) for x in h.tolist()]
    block = np.repeat(np.arange(0, 900, 3), rng.integers(1, decontamination.STRIDE + 1, 300))
    terms, rows = rng.integers(0, 50, len(block)), rng.normal(size=(50, 7))
    for at_once in (1, 64, 2048):
        sums, blocks = decontamination._block_sums(terms, block, rows, at_once)
        assert blocks.tolist() == list(range(0, 900, 3)) and np.allclose(sums, [rows[terms[block == b]].sum(axis=0) for b in blocks])
    assert [len(x) for x in decontamination._block_sums(terms[:0], block[:0], rows)] == [0, 0]


def test_decontamination_of_odd_rows(spark):
    """Nulls, empties, one very long text, repeated rows, ties of two items, clashing columns, and what is found is right."""
    rng = random.Random(12)
    one, two = " ".join(prose(rng, 40)), " ".join(prose(rng, 30))
    long = " ".join(prose(rng, 60_000) + two.split() + prose(rng, 60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, one), (5, one), (6, one.upper() + " x " + two), (None, one), (7, "short")]
    docs = spark.createDataFrame([(i, t, 0.5, 9) for i, t in rows], "doc_id long, text string, lcs double, item_id int").repartition(3)
    items = spark.createDataFrame([(1, one), (2, two), (3, one), (4, None), (5, ""), (None, two)], ITEMS)
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in decontamination.decontamination(docs, items).collect()}
    assert set(got) == {(4, 2), (4, None), (5, 1), (5, 3), (6, 1), (6, 2), (6, 3), (6, None), (None, 1), (None, 3)} and set(got.values()) == {1.0}
    for text, item in ((paraphrase(rng, one.split(), 0.1), one), (paraphrase(rng, one.split(), 0.6), one)):
        found = list(matches(spark, [" ".join(text)], [(0, item)]))
        assert bool(found) == (plain_lcs(item.split(), text) >= 0.75 * 40)


def test_language_id_of_odd_rows(spark):
    """Repeated rows, a null label, kept columns of clashing names, one very long text, an empty table."""
    rows = [(k, "der hund und die katze sind im haus " * 3, "de", 1.5) for k in range(6)] + [(10 + k, "the dog and the cat are in the house " * 3, "en", 2.5) for k in range(6)] + [(20, "und the", None, 0.0), (20, "und the", None, 0.0), (21, "the cat and the dog are here " * 40_000, "en", 3.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    own = language_id.fitted(language_id.training_rows(docs))
    got = language_id.language_id(docs, own, keep=("score", "lang")).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == r["lang"] for r in got if r["lang"]) and {r["doc_id"]: r["score_in"] for r in got}[10] == 2.5
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 20}) == 1
    assert language_id.language_id(docs.limit(0), own).count() == 0 and language_id.training_rows(docs.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    """Ties, a very long text and its near copy, extra columns of clashing names, an empty table."""
    rng = random.Random(13)
    long = prose(rng, 30_000)
    near = list(long)
    near[5] = "changed"
    rows = [(9, " ".join(long)), (8, " ".join(near)), (7, "a b c"), (6, "a b c"), (5, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, component_id string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join(docs).collect()} == {9: 8, 8: 8, 7: 6, 6: 6, 5: 5}
    assert jaccard_join(docs.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_removed"] > 29_000 for r in substring_dedup(docs).collect()} == {9: True, 8: False, 7: False, 6: False, 5: False}


def test_substring_dedup_in_parts_and_by_shuffle(spark):
    """Tiny shards and packs, nothing broadcast, repeated ids with other texts: the same as in one piece."""
    rng = random.Random(14)
    shared = [prose(rng, 80) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [prose(rng, rng.randrange(40))]
        for s in rng.sample(shared, rng.randrange(4)):
            a = rng.randrange(25)
            parts += [s[a : a + rng.randrange(45, 80)], prose(rng, rng.randrange(30))]
        rows.append((k % 55, " ".join(w for p in parts for w in p)))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    want = []
    for i, t in rows:
        w = t.split()
        gone = [any(first[tuple(w[a : a + 50])] < i for a in range(max(0, k - 49), min(k, len(w) - 50) + 1)) for k in range(len(w))]
        want.append((i, len(w), sum(gone)))
    for more in ({}, {"broadcast_bytes": -1, "shard": 900, "pack": 150}):
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup(docs, **more).collect()) == sorted(want)

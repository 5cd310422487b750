import random

import numpy as np
import pytest

from vicinal.llm import decontaminate as d


def words(rng, n, vocabulary=4000):
    common = ["the", "of", "and", "to", "in"]
    return [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def items_of(rows):
    """The rows of a table of passages as the index takes them."""
    return [(i, words, answer, np.array(cols, int), np.array(vals, float)) for i, words, answer, cols, vals in zip(*[c.to_pylist() for c in rows.toArrow().columns], strict=True)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, rng.choice([15, 25, 40, 55, 150]))) + ".") for i in range(30)]
    docs, want = [], set()
    for doc in range(400):
        w = words(rng, rng.randint(5, 600))
        if doc % 5 == 0:
            item, text = rng.choice(items)
            own = text.rstrip(".").split()
            if doc % 10 == 0:  # a paraphrase: some words go, some come
                own = [x for x in own if rng.random() > 0.1]
                for _ in range(len(own) // 12):
                    own.insert(rng.randrange(len(own)), rng.choice(["indeed", "rather"]))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," if rng.random() < 0.1 else x for x in own]
            want.add((doc, item))
        docs.append((doc, " ".join(w)))
    return spark.createDataFrame([(*x, "y") for x in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string"), want


def test_planted_passages_are_found_and_clean_documents_left_alone(planted):
    docs, benchmark, want = planted
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, benchmark).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_blocks_of_passages_give_the_same(planted, monkeypatch):
    docs, benchmark, _ = planted
    whole = sorted(d.find_leaks(docs, benchmark).select("doc_id", "item_id").collect())
    monkeypatch.setattr(d, "BLOCK_ITEMS", 11)
    assert sorted(d.find_leaks(docs, benchmark).select("doc_id", "item_id").collect()) == whole


def test_candidates_recall_against_exact_cosines(spark, planted):
    """Retrieval over the latent index finds the windows whose TF-IDF cosine is well above the limit."""
    docs, benchmark, _ = planted
    idf = d.inverse_frequencies(docs)
    rows = d.passages(benchmark, spark.sparkContext.broadcast(idf))
    used, basis = d.latent_basis(rows)
    items = items_of(rows)
    index, found, wanted = d.Index(idf, used, basis, items), 0, 0
    dense = np.zeros((len(items), d.BUCKETS), np.float32)
    for n, x in enumerate(items):
        dense[n, x[3]] = x[4]
    for r in docs.limit(150).collect():
        w = d.word_buckets(r["text"])
        near = set()
        for scale in index.scales:
            for at in range(0, max(len(w) - scale, 0) + scale // 4, scale // 4):
                part = w[at : at + scale]
                if len(part):
                    cosine = dense[:, part] @ idf[part] / np.sqrt((idf[part] ** 2).sum())
                    near |= set(np.flatnonzero(cosine >= d.LEAST_COSINE + 0.02).tolist())
        got = set(index.candidates(w))
        wanted, found = wanted + len(near), found + len(near & got)
    assert wanted > 20 and found >= 0.9 * wanted


def test_basis_is_the_svd(spark, planted):
    _, benchmark, _ = planted
    rows = d.passages(benchmark, spark.sparkContext.broadcast(np.ones(d.BUCKETS, np.float32)))
    used, basis = d.latent_basis(rows, rank=8, iterations=6)
    a = np.zeros((rows.count(), len(used)))
    for n, r in enumerate(rows.collect()):
        a[n, np.searchsorted(used, r["cols"])] = r["vals"]
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(basis.T @ basis, np.eye(8), atol=1e-4)
    assert np.linalg.norm(a @ basis, axis=0) == pytest.approx(s[:8], rel=0.05)


def test_weighted_lcs():
    rng = random.Random(12)
    weights = np.array([rng.random() for _ in range(6)])
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i, j] = max(table[i - 1, j], table[i, j - 1], table[i - 1, j - 1] + weights[x] if x == y else 0)
        assert d.weighted_lcs(np.array(a, int), np.array(b, int), weights) == pytest.approx(table[-1, -1])


def test_sf_leaks_are_all_exact_copies(spark, sf_docs):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    texts = {r["doc_id"]: r["text"] for r in sf_docs.collect()}
    flat = lambda t: " ".join(t.lower().split())
    want = {(doc, i) for doc, t in texts.items() for i, x in items.items() if flat(x) in flat(t)}
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(sf_docs, benchmark).collect()}
    assert want <= got


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the same words in the same order make a copy"), (2, None), (3, ""), (4, "...") , (None, "x y z a b c"), (5, "the same words in the same order make a copy")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(odd_docs, items).collect()}
    assert {(3, 1), (4, 1), (3, 5), (4, 5)} <= got
    assert d.find_leaks(odd_docs, items.limit(0)).count() == 0 and d.find_leaks(no_docs, items).count() == 0
    answers = items.limit(1).selectExpr("item_id", "text", "'no such answer' as answer")
    assert d.find_leaks(odd_docs, answers).count() == 2  # whole copies need no answer


def zipf(rng, n, vocabulary=20000):
    return [f"w{int(vocabulary ** rng.random())}" for _ in range(n)]


def leaks_of(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}


def test_more_passages_than_the_rank_lose_no_copy(spark):
    rng = random.Random(21)
    items = [(i, " ".join(zipf(rng, 40))) for i in range(2000)]
    docs = [(i, " ".join(zipf(rng, 60) + items[i][1].split() + zipf(rng, 60))) for i in range(0, 2000, 4)]
    got = leaks_of(spark, docs + [(10_000 + i, " ".join(zipf(rng, 200))) for i in range(200)], items)
    assert got == {(i, i) for i, _ in docs}


def test_paraphrases_of_the_likely_range_are_found(spark):
    """Words of a passage are replaced, its last sentence stays; every share from LIKELY on is a leak."""
    rng = random.Random(22)
    items, docs = [], []
    for i in range(200):
        body, answer = zipf(rng, rng.randint(12, 56)), zipf(rng, 3)
        items.append((i, " ".join(body) + ". " + " ".join(answer)))
        rate = rng.uniform(0.2, 0.5)
        own = [f"x{rng.randrange(20000)}" if rng.random() < rate else x for x in body] + answer
        docs.append((i, " ".join(zipf(rng, 200) + own + zipf(rng, 250)), " ".join(own)))
    table = spark.createDataFrame([x[:2] for x in docs], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    idf = d.inverse_frequencies(table)
    cut = d.word_buckets
    share = {i: d.weighted_lcs(cut(text), cut(own), idf) / idf[cut(text)].sum() for (i, text), (_, _, own) in zip(items, docs, strict=True)}
    want = {(i, i) for i, x in share.items() if x >= d.LIKELY}
    assert sum(x < d.SURE for i, x in share.items() if (i, i) in want) > 100
    assert want <= {(r["doc_id"], r["item_id"]) for r in d.find_leaks(table, benchmark).collect()}
    rows = d.passages(benchmark, spark.sparkContext.broadcast(idf))
    index = d.Index(idf, *d.latent_basis(rows), items_of(rows))
    near = {index.ids[n] for i, text, _ in docs for n in index.latent_windows(cut(text)) if index.ids[n] == i}
    assert len(near) >= 0.4 * len(want)  # by cosine alone; 0.22 at a limit of 0.6 and windows of ratio 3


def test_a_copy_behind_closer_looking_words_is_found(spark):
    """Before an exact copy stands a run of one of its words, or a part of it: every window is checked."""
    rng = random.Random(23)
    items = [(i, " ".join(zipf(rng, 40))) for i in range(60)]
    docs = []
    for i, text in items:
        own = text.split()
        lead = [max(own, key=lambda x: int(x[1:]))] * 24 if i % 2 else own[:16]
        docs.append((i, " ".join(lead + zipf(rng, 200) + own + zipf(rng, 30))))
    assert leaks_of(spark, docs, items) == {(i, i) for i, _ in items}


def test_cosines_are_of_unit_rows(spark):
    """A run of one word is no nearer to a passage than the word's share of it; two near parts are two windows."""
    rng = random.Random(24)
    items = [(i, " ".join(zipf(rng, 30))) for i in range(20)]
    docs = [(i, " ".join(zipf(rng, 300))) for i in range(200)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    idf = d.inverse_frequencies(table)
    rows = d.passages(spark.createDataFrame(items, "item_id bigint, text string"), spark.sparkContext.broadcast(idf))
    index = d.Index(idf, *d.latent_basis(rows), items_of(rows))
    at = index.ids.index(7)
    own = items[7][1].split()
    run = d.word_buckets(" ".join([max(own, key=lambda x: int(x[1:]))] * 24 + zipf(rng, 60)))
    assert at not in index.latent_windows(run)
    twice = d.word_buckets(" ".join(own + zipf(rng, 300) + own))
    starts = sorted(first for _, first, _ in index.latent_windows(twice)[at])
    assert starts[0] < 30 and starts[-1] > 300


@pytest.mark.parametrize("length", [5, 100, 140])
def test_short_and_long_passages(spark, length):
    """Copies with none, 10 and 20 per cent of the words replaced, and by cosine alone, too."""
    rng = random.Random(25)
    items = [(i, " ".join(zipf(rng, length))) for i in range(90)]
    docs = []
    for i, text in items:
        rate = (0, 0.1, 0.2)[i % 3] if length > 5 else 0
        own = [f"x{rng.randrange(20000)}" if rng.random() < rate else x for x in text.split()]
        docs.append((i, " ".join(zipf(rng, 150) + own + zipf(rng, 150)), " ".join(own)))
    table, benchmark = spark.createDataFrame([x[:2] for x in docs], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(table, benchmark).collect()}
    idf = d.inverse_frequencies(table)
    rows = d.passages(benchmark, spark.sparkContext.broadcast(idf))
    index = d.Index(idf, *d.latent_basis(rows), items_of(rows))
    cut = d.word_buckets
    sure = {i for i, _, own in docs if d.weighted_lcs(cut(items[i][1]), cut(own), idf) >= d.SURE * idf[cut(items[i][1])].sum()}
    near = {i for i, text, _ in docs for n in index.latent_windows(cut(text)) if index.ids[n] == i}
    assert {(i, i) for i in sure} <= got and len(sure) >= 60 and len(near & sure) >= 0.9 * len(sure)


def test_passages_of_few_words_are_found_in_a_row_only(spark):
    items = [(1, "Quux"), (2, "alpha beta"), (3, "Alpha, beta gamma."), (4, "one two three four"), (5, "..."), (6, "alpha beta")]
    docs = [(1, "so, QUUX!"), (2, "an alpha beta gamma"), (3, "alpha then beta"), (4, "one two three four"), (5, "four three two one"), (6, None), (7, "one two"), (8, "quuxes")]
    want = {(1, 1), (2, 2), (2, 3), (2, 6), (4, 4)}
    assert leaks_of(spark, docs, items) == want
    long = (7, "a passage of more than a few words is beside them")
    assert leaks_of(spark, [*docs, (9, "here " + long[1])], [*items, long]) == want | {(9, 7)}


def test_words_that_share_a_bucket_do_not_confirm_each_other(spark):
    """Candidates come from buckets of words, a leak needs the words themselves."""
    seen, pairs, n = {}, [], 0
    while len(pairs) < 8:
        word = f"q{n}"
        other = seen.setdefault(int(d.word_buckets(word)[0]), word)
        if other != word:
            pairs.append((other, word))
        n += 1
    docs = [(1, " ".join(b for _, b in pairs)), (2, " ".join(a for a, _ in pairs)), (3, "some other text of no account at all")]
    assert leaks_of(spark, docs, [(7, " ".join(a for a, _ in pairs))]) == {(2, 7)}

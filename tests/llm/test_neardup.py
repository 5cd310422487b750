import random

import numpy as np
import pytest

from vicinal.llm import components, neardup


def plain_set(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}


def slow(docs, words=4, percent=80):
    """Component of each document, by comparing all pairs of sets."""
    sets = [plain_set(t, words) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[a] = b
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs)}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, component string")


def variants(rng, base, n, most):
    """Copies of a list of words with up to ``most`` words changed."""
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("block", [4, 512])
def test_components_of_near_copies(spark, monkeypatch, block):
    """Groups whose pairs lie on both sides of the threshold, in one bucket and cut into blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(8)
    texts = []
    for g in range(6):
        base = [f"g{g}x{rng.randrange(10**6)}" for _ in range(rng.randint(60, 140))]
        texts += variants(rng, base, 25, len(base) // 14)
    for _ in range(5):  # chains: each a little further from the first
        w = [f"c{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(8):
            w = w[2:] + [f"c{rng.randrange(10**6)}" for _ in range(2)]
            texts.append(" ".join(w))
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    want = slow(docs)
    assert len({c for _, c in want.values()}) > 11  # not simply one component a group
    assert got(neardup.near_duplicates(frame(spark, docs), 4)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    found = neardup.near_duplicates(odd_docs, 4).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[7]["n_shingles"] == 0 and by[1]["component_id"] == 1
    assert by[4]["component_id"] == 3 and by[6]["component_id"] == 5 and by[None]["component_id"] is None
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, None, 3, 5, 7, 8, 9, 10]))


def test_of_a_repeated_id_one_text_speaks(spark):
    """The text with the smallest digest links the id; the order of rows does not matter."""
    texts = ["a b c d e f g h", "q r s t u v w x"]
    h = neardup._WordHash()
    first = min(texts, key=lambda t: neardup.xxhash.xxh3_128_digest(neardup.shingle_set(t, 4, h).tobytes()))
    docs = [(1, texts[0]), (1, texts[1]), (1, ""), (2, texts[1]), (3, texts[0]), (1, texts[0])]
    with_first = 3 if first == texts[0] else 2
    for rows in (docs, docs[::-1]):
        found = neardup.near_duplicates(frame(spark, rows), 4).collect()
        assert len(found) == 6
        assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (with_first, 1), (5 - with_first, 5 - with_first)}
        kept = neardup.one_of_each(frame(spark, rows), 4).collect()
        assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, texts[0]), (1, texts[1]), (1, ""), (5 - with_first, texts[1] if with_first == 3 else texts[0])])


def test_copies_with_other_columns_are_chosen_by_hash(spark):
    rows = [(1, "a b c d e f", str(i)) for i in range(20)]
    pick = lambda x: [tuple(r) for r in neardup.one_of_each(spark.createDataFrame(x, "doc_id bigint, text string, component string").repartition(3)).collect()]
    assert len(pick(rows)) == 1 and pick(rows) == pick(rows[::-1])


def test_case_and_white_space():
    h = neardup._WordHash()
    one = neardup.shingle_set("A\tb\x0bC  d\r\nÉ", 4, h)
    assert (one == neardup.shingle_set("a b c D É", 4, h)).all() and not (one == neardup.shingle_set("a b c d é", 4, h)).all()
    assert len(neardup.shingle_set("a b c", 4, h)) == 1 and len(neardup.shingle_set("a b a b a b a b", 4, h)) == 2


def test_prune_table_is_the_posterior():
    for n, least in zip((42, 252), neardup.prune_table([42, 252], 0.8, 1e-7), strict=True):
        s = np.linspace(0, 1, 200_001)[1:-1]

        def tail(m, n=n, s=s):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            d = np.exp(log - log.max())
            return d[s >= 0.8].sum() / d.sum()

        assert tail(least) > 1e-7 >= tail(least - 1)


def test_signatures_estimate_similarity():
    rng, h, f = np.random.default_rng(9), neardup._WordHash(), neardup._multipliers(252)
    for share in (0.3, 0.8, 0.95):
        a = rng.integers(0, 2**63, 600).astype(np.uint64)
        b = np.concatenate([a[: int(600 * 2 * share / (1 + share))], rng.integers(0, 2**63, 600 - int(600 * 2 * share / (1 + share))).astype(np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((neardup.minhashes(a, f) == neardup.minhashes(b, f)).mean() - true) < 0.1
    assert h is not None


def test_connected_components(spark):
    rng = random.Random(10)
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(90)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = components.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in df.collect()} == {x: root(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

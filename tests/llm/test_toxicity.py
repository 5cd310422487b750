import random

import numpy as np
import pytest

from vicinal.llm import toxicity as t


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_counts_edits():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(0, 7)))
    for _ in range(2000):
        a, b = word(), word()
        machine = t.Automaton(a, 2)
        state = machine.start()
        for c in b:
            state = machine.step(state, c)
        d = edits(a, b)
        assert machine.errors(state) == (d if d <= 2 else None)
        least = min(edits(a[:i], b) for i in range(len(a) + 1))
        assert machine.prefix_errors(state) == (least if least <= 2 else None)


def test_lexicon_match_is_brute_force():
    rng = random.Random(6)
    word = lambda a, b: "".join(rng.choices("abcd", k=rng.randint(a, b)))
    words, stems = {word(4, 10): rng.random() for _ in range(40)}, {word(4, 6): rng.random() for _ in range(8)}
    lexicon = t.Lexicon(words, stems)
    for _ in range(500):
        w = word(3, 11)
        options = [(edits(w, x), -v) for x, v in words.items() if edits(w, x) <= lexicon.allowed(x)]
        options += [(d, -v) for x, v in stems.items() if (d := min(edits(w[:i], x) for i in range(len(w) + 1))) <= lexicon.allowed(x)]
        best = min(options, default=None)
        got = lexicon.match(w)
        assert (got is None) == (best is None) and (best is None or (got[1], -got[0]) == best)


def test_search_finds_what_matching_every_word_finds():
    lexicon = t.Lexicon({"idiot": 5.0, "worthless": 4.0, "scum": 3.0}, {"chlla": 2.0})
    searcher = lexicon.searcher()
    text = "an idiot, an idi0t, an idoit worthles wrthlss scum scam chllaido chlaido xidiot! " * 2
    want = [(m.start(), m.end(), *lexicon.match(m[0])) for m in t._WORD.finditer(text) if lexicon.match(m[0])]
    assert t.hits(text, lexicon, searcher) == want and len(want) > 10


@pytest.mark.parametrize(("text", "want"), [('he said "you idiot" to me', True), ("you idiot", False), ("«l’idiot»", True), ('"well" idiot "so"', False), ('a "line\nidiot" or so', False)])
def test_quotation_marks(text, want):
    at = text.index("idiot")
    assert (t.QUOTED in t.context(text, at, at + 5)) is want


def test_context_takes_whole_words_of_the_line():
    text = "other line\n" + "w" * 70 + " edge near idiot close " + "v" * 90 + " out"
    at = text.index("idiot")
    assert t.context(text, at, at + 5) == {"edge", "near", "close"}
    assert t.context("one idiot two", 4, 9) == {"one", "two"}


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(len(scores))
    for v in np.unique(scores):
        ranks[scores == v] = ranks[scores == v].mean()
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in t.score(docs, t.fit(docs, labels)).collect() if r["held_out"] and r["doc_id"] in truth]
    scores, y = np.array([r["score"] for r in rows]), np.array([truth[r["doc_id"]] for r in rows])
    assert auc(scores, y) > 0.96
    hit = np.array([r["predicted"] for r in rows])
    assert hit[y == 1].mean() > 0.85 and hit[y == 0].mean() < 0.02


def test_misspelt_and_quoted_terms():
    lexicon = t.Lexicon({"worthless": 6.0}, {})
    scorer = t.Scorer(lexicon, {t.QUOTED: -1.5}, t.PRIOR)
    clean, plain, misspelt, quoted = scorer.scores(["a fine day", "you worthless thing", "you worthles thing", 'he said "worthless" once'], lexicon.searcher())
    assert clean < quoted < plain and clean < misspelt < plain


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, None), (None, 0, 1), (5, 0, 0), (5, 0, 1), (77, 1, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = t.score(odd_docs, t.fit(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in t.score(odd_docs, t.fit(odd_docs, labels.limit(0))).collect()} == {0.0}
    assert t.score(no_docs, t.fit(no_docs, labels)).count() == 0


def test_near_copies_count_once_and_others_all(spark):
    """A group of near copies leaves few rows; texts that share words, or a passage, all stay, and the order does not matter."""
    rng = random.Random(12)
    text = lambda n: [f"w{int(5000 ** rng.random())}" for _ in range(n)]
    base, passage, common = text(120), text(25), ["the", "common", "words"]
    near = [[w if rng.random() > 0.1 else f"x{rng.randrange(10**6)}" for w in base] for _ in range(400)]
    apart = [text(60) + passage + common + text(60) for _ in range(400)]
    rows = [(i, " ".join(w), i % 2) for i, w in enumerate(near + apart)] + [(5000, " ".join(base), 1), (5000, " ".join(base), 1), (5001, None, 0), (5002, "", 0), (None, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    kept = sorted((r["text"] or "", r["toxic"]) for r in t.one_of_near_copies(docs).collect())
    assert sum(x in {" ".join(w) for w in near} for x, _ in kept) <= 50
    assert sum(x in {" ".join(w) for w in apart} for x, _ in kept) >= 0.98 * len(apart)
    assert sum(x == "" for x, _ in kept) == 1 and ("a b", 1) in kept
    assert kept == sorted((r["text"] or "", r["toxic"]) for r in t.one_of_near_copies(docs.repartition(7)).collect())


def test_rows_learnt_from_are_those_of_brute_force(spark):
    """The first of all their bands, compared with every row of smaller id and the same label."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    both = docs.join(labels, "doc_id").select("doc_id", "text", "toxic")
    hashes, factors, seen, want = t._WordHash(), t._multipliers(t.BANDS * t.ROWS), {}, []
    for r in both.orderBy("doc_id").collect():
        keys = t.band_keys(t.minhashes(t.shingle_set(r["text"], t.SHINGLE, hashes), factors), t.BANDS, t.ROWS).tolist()
        if all(seen.setdefault((k, r["toxic"]), r["doc_id"]) == r["doc_id"] for k in keys):
            want.append((r["text"] or "", r["toxic"]))
    assert sorted(want) == sorted((r["text"] or "", r["toxic"]) for r in t.one_of_near_copies(both).collect())
    assert len(want) > 2500


def test_the_most_significant_terms_stay(spark):
    """Cuts go by significance, whatever the length or the alphabet says."""
    rows = [(0, f"a{i}aa", 3 + i, 3 + i) for i in range(6)] + [(0, "zzz", 40, 40), (4, "zzyy", 30, 30), (5, "zzyyx", 30, 30), (4, "aayy", 9, 9), (0, "clean", 500, 20)]
    counts = spark.createDataFrame(rows, "kind int, term string, n bigint, toxic bigint")
    whole, cut = t.learn_lexicon(counts, 1000, 100), t.learn_lexicon(counts, 1000, 100, most=1)
    assert set(whole.words) == {f"a{i}aa" for i in range(6) if 3 + i >= 4} | {"zzz"} and set(whole.stems) == {"zzyy", "aayy"}
    assert set(cut.words) == {"zzz"} and set(cut.stems) == {"zzyy"}


def test_contexts_are_learnt(spark):
    """Words that go with terms in clean texts speak for quotation; others do not."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(300)}"
    docs, labels = [], []
    for i in range(600):
        toxic, about = i % 3 == 0, i % 3 == 1 and i % 2
        filler = [word() for _ in range(30)]
        filler[15:15] = ["you", "scumbag"] if toxic else ["minutes", "record", "scumbag", "as", "reported"] if about else []
        docs.append((i, " ".join(filler)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    rows = docs.join(labels, "doc_id")
    tokens = t.learn_context(rows, t.Lexicon({"scumbag": 4.0}, {}))
    assert tokens["minutes"] < -1 and tokens["reported"] < -1 and tokens["you"] > 0 and set(tokens) == {t.QUOTED, "you", "minutes", "record", "as", "reported"}
    abuse = t.features("oh you scumbag there", t.Lexicon({"scumbag": 4.0}, {}), tokens, t.Lexicon({"scumbag": 4.0}, {}).searcher())
    aside = t.features("the record minutes scumbag as reported", t.Lexicon({"scumbag": 4.0}, {}), tokens, t.Lexicon({"scumbag": 4.0}, {}).searcher())
    assert abuse[0] > 4 * aside[0] and aside[2] > 1 > abuse[2]


def test_scores_against_brute_force(spark, odd_docs):
    """Every score from the edit distances of all words and all entries, without trie, automaton or search."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    scorer = t.fit(docs, labels)
    lexicon, seen = scorer.lexicon, {}

    def best(word):
        if word not in seen:
            options = [(d, -w) for x, w in lexicon.words.items() if abs(len(x) - len(word)) <= 2 and (d := edits(word, x)) <= lexicon.allowed(x)]
            options += [(d, -w) for x, w in lexicon.stems.items() if (d := min(edits(word[:i], x) for i in range(max(0, len(x) - 2), min(len(word), len(x) + 2) + 1)) if len(word) >= len(x) - 2 else 9) <= lexicon.allowed(x)]
            seen[word] = min(options, default=None)
        return seen[word]

    def score(text):
        low, sums = (text or "").lower(), [0.0, 0.0, 0.0]
        for m in t.re.finditer(r"[^\W_]+", low):
            if found := best(m[0]):
                said = sum(scorer.tokens.get(x, 0.0) for x in t.context(low, m.start(), m.end()))
                abuse = min(1.0, 2 / (1 + np.exp(-np.clip(said, -t.MOST_SAID, t.MOST_SAID))))
                sums[bool(found[0])] -= found[1] * abuse
                sums[2] -= found[1] * (1 - abuse)
        x = [*np.log1p(sums), 100 * sum(sums) / (len(low) + 100), 1.0]
        return 1 / (1 + np.exp(-np.clip(np.dot(x, scorer.weights), -30, 30)))

    assert lexicon.words or lexicon.stems
    few = docs.select("doc_id", "text").filter("doc_id < 120").union(odd_docs.select("doc_id", "text"))
    got = [(r["doc_id"], r["score"]) for r in t.score(few, scorer).collect()]
    want = [(r["doc_id"], pytest.approx(score(r["text"]), abs=1e-9)) for r in few.collect()]
    assert got == want

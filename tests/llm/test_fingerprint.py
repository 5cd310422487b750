import hashlib
import struct

import pytest
import xxhash

from vicinal.llm import fingerprint as fp


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def string_hash(s):
    return signed(xxhash.xxh64_intdigest(s.encode(), seed=42))


def pair_hash(a, b):
    first = xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42)
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", b), seed=first))


def slow_anchors(text):
    if len(text) < fp.K:
        return [(0, string_hash(text))] if text else []
    inner = [string_hash(text[i : i + fp.S]) for i in range(len(text) - fp.S + 1)]
    out = []
    for i in range(len(text) - fp.K + 1):
        window = inner[i : i + fp.LAST + 1]
        if min(window) in (window[0], window[-1]):
            out.append((i, pair_hash(window[0], window[-1])))
    return out


def slow_sketch(text):
    return sorted({h for _, h in slow_anchors(text)})[: fp.SIZE]


def slow_likeness(a, b):
    union = sorted({*a, *b})[: fp.SIZE]
    return 1.0 if not union else len([h for h in union if h in a and h in b]) / len(union)


def hexed(sketch):
    return "".join(f"{h % 2**64:016x}" for h in sketch)


def check(rows, docs):
    """docs: (doc_id, text) in descending order of ids."""
    texts = [t or "" for _, t in docs]
    for i, (doc, _) in enumerate(docs):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row, own, changed = rows[doc], slow_sketch(text), slow_sketch(edited)
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == hexed(own) and row["edited_fingerprint"] == hexed(changed), doc
        places = set(slow_anchors(edited))
        assert (row["edited_anchors"], row["aligned_anchors"]) == (len(places), len(places & set(slow_anchors(text)))), doc
        assert row["near_edited"] == pytest.approx(slow_likeness(own, changed)) and row["near_next"] == pytest.approx(slow_likeness(own, slow_sketch(after)))


def test_anchors_of_odd_texts(spark, odd_docs):
    rows = {}
    for r in fp.anchors(odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect():
        rows.setdefault(r["doc_id"], []).append((r["place"], r["hash"]))
    for r in odd_docs.filter("doc_id is not null").collect():
        assert sorted(rows.get(r["doc_id"], [])) == slow_anchors(r["text"] or "")


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_edited_texts_over_any_ranges(spark, monkeypatch, bucket):
    monkeypatch.setattr(fp, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(fp, "QUANTILES", 4)
    text = "Wie öfter gesagt: the quick brown fox jumps over the lazy dog, again and again; näher als je zuvor. "
    docs = [(i * i * 1000 - 5, (text * 3)[i * 7 : i * 23 + (i % 3) * 40] if i % 5 else ("" if i % 2 else None)) for i in range(24)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, range int").repartition(3)
    check({r["doc_id"]: r for r in fp.compare_edited(frame).collect()}, sorted(docs, reverse=True))


def test_whole_table(spark, sf_docs):
    docs = sorted(((r["doc_id"], r["text"]) for r in sf_docs.collect()), reverse=True)
    check({r["doc_id"]: r for r in fp.compare_edited(sf_docs).collect()}, docs)


def test_native_plan(spark, sf_docs):
    plan = fp.compare_edited(sf_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_few_and_repeated_rows(spark, odd_docs, no_docs):
    assert fp.compare_edited(no_docs).count() == 0
    one = fp.compare_edited(odd_docs.filter("doc_id = 3")).first()
    assert one["near_next"] == 1.0
    rows = fp.compare_edited(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(r["doc_id"] == 9 for r in rows) == 2
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (3, 4)} == {hexed(slow_sketch("the same words in the same order make a copy"))}


@pytest.mark.parametrize("bucket", [2, 1000])
def test_many_rows_without_an_id(spark, monkeypatch, bucket):
    """They come last, in the order of their texts' hashes, over any number of ranges."""
    monkeypatch.setattr(fp, "BUCKET_ROWS", bucket)
    docs = [(None, f"{i} words of a text that has no number of its own {i * i}") for i in range(30)] + [(i, f"text {i} with a number and some words") for i in range(5)]
    rows = fp.compare_edited(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), string_hash(d[1]) if d[0] is None else 0))
    want = {}
    for i, (_, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[hashlib.sha256(edited.encode()).hexdigest()] = hexed(slow_sketch(edited))
    assert {r["edited_sha256"]: r["edited_fingerprint"] for r in rows} == want and len(rows) == 35


@pytest.mark.parametrize("n", [fp.CHUNK - 1, fp.CHUNK, fp.CHUNK + 1, fp.CHUNK + fp.S - 1, fp.CHUNK + fp.S, 2 * fp.CHUNK, 2 * fp.CHUNK + fp.S - 2, 3 * fp.CHUNK + 5])
def test_chunks_leave_no_seam(spark, n):
    """Texts of the lengths around a chunk's end, with line ends and characters of four bytes."""
    letters = "abcdefgh é漢\n\r\U0001f600"
    text = "".join(letters[(i * i * 7 + i // 5) % len(letters)] for i in range(n))
    rows = fp.anchors(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert sorted((r["place"], r["hash"]) for r in rows) == slow_anchors(text)


def test_inner_substrings_are_compiled(spark, sf_docs):
    """The time went to functions of array elements, which Spark interprets: none may hash what every place of a text has."""
    plan = fp.with_anchors(sf_docs.select("doc_id", "text"), "text", "at", "hash")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "lambda" not in plan


def test_edited_texts_around_chunks(spark):
    """Texts of the lengths around a chunk's end, and such as share their later half, so anchors repeat at their places."""
    letters = "abcdefgh é漢\n\r\U0001f600"
    make = lambda k, m: "".join(letters[(i * i * m + i // 5) % len(letters)] for i in range(k))
    lengths = [0, 1, fp.K - 1, fp.K, fp.CHUNK + fp.K - 2, fp.CHUNK + fp.K - 1, 4095, 4096, 4097, 12293]
    texts = [t for n in lengths for t in (make(n, 7), make(300, 7), make(150, 3) * 2, make(150, 3) + make(150, 11), make(n, 7), make(n, 7))]
    docs = [(len(texts) - i, text) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    check({r["doc_id"]: r for r in fp.compare_edited(frame).collect()}, docs)

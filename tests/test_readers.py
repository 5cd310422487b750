"""Files that Spark cuts into small blocks give the same elements and numbers as reading them from end to end."""

import gzip
import json
import random

import numpy as np
import pytest

from vicinal.sources import arrays, blocks, payloads, references


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


ODD = ["}", "{", "]", "[", '"', "\\", '\\"', "}}}{", '"}', "\\\\", "é漢", "\n", "\r\n", ",", "a\tb", "", " ", "{\"x\":[}"]


def element(rng, depth=0):
    kind = rng.randint(0, 5 if depth < 4 else 3)
    if kind <= 2:
        return "".join(rng.choices(ODD, k=rng.randint(0, 6)))
    if kind == 3:
        return rng.choice([1, -2.5, None, True])
    if kind == 4:
        return [element(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(ODD) + str(i): element(rng, depth + 1) for i in range(rng.randint(0, 3))}


def test_elements_and_places_are_exact_across_blocks(spark, small_blocks, tmp_path):
    rng = random.Random(1)
    want = {}
    for name, n, indent, ascii_ in (("a.json", 150, None, True), ("b.json", 80, 2, False), ("c.json", 0, None, True), ("d.json", 1, None, False), ("sub/e.json", 60, None, False)):
        rows = [{"id": i, "x": element(rng), "long": "z}" * rng.choice([0, 0, 400])} for i in range(n)]
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(rng.choice(["", " \n"]) + json.dumps(rows, indent=indent, ensure_ascii=ascii_) + rng.choice(["", "\n"]), newline="")
        want[name.rpartition("/")[2]] = rows
    (tmp_path / "in" / "empty.json").write_text("")
    found = arrays.read_objects(spark, str(tmp_path / "in"))
    assert blocks.read_blocks(spark, str(tmp_path / "in"), "}").rdd.getNumPartitions() > 20
    got = {}
    for r in found.collect():
        got.setdefault(r["file"].rpartition("/")[2], {})[r["pos"]] = json.loads(r["value"], strict=False)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_shuffled_states_keep_the_order(spark, small_blocks, tmp_path, monkeypatch):
    rows = [{"id": i, "s": "}" * (i % 9), "n": {"a": [i]}} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    monkeypatch.setattr(arrays, "FEW_BLOCKS", 0)
    got = {r["pos"]: json.loads(r["value"]) for r in arrays.read_objects(spark, str(tmp_path / "a.json")).collect()}
    assert [got[i] for i in range(200)] == rows


def test_what_is_no_object_is_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('[1, "{", {"a": 1}, [2, {"b": 2}], null, {"c": {}}]')
    assert [(r["pos"], r["value"]) for r in arrays.read_objects(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == [(0, '{"a": 1}'), (1, '{"c": {}}')]


def test_escapes_are_seen_in_runs():
    text = rb'"a\\" "b\"c" "\\\"}" "\\\\"'
    quotes, _ = arrays.structure(np.frombuffer(text, np.uint8))
    assert quotes[-1] == 8
    quotes, step = arrays.structure(np.frombuffer(b"\\", np.uint8))
    assert quotes.tolist() == [0] and step.tolist() == [0]


def test_a_corpus_in_one_file_is_read_in_blocks(spark, small_blocks, tmp_path):
    entries = [{"request": {"id": str(i), "k": ["}", {"z": i}]}, "expected_approved": i % 3 == 0, "expected_fraud_score": i / 100} for i in range(90)]
    (tmp_path / "c.json").write_text(json.dumps({"references_checksum_sha256": "x", "stats": {"a": {"b": 1}}, "entries": entries}, indent=1))
    got = payloads.read_corpus(spark, str(tmp_path / "c.json")).collect()
    assert sorted((json.loads(r["value"])["id"], r["expected_approved"], r["expected_fraud_score"]) for r in got) == sorted((e["request"]["id"], e["expected_approved"], e["expected_fraud_score"]) for e in entries)
    assert all(json.loads(r["value"])["k"][1] == {"z": int(json.loads(r["value"])["id"])} for r in got)


def test_numbers_are_places_in_the_order_of_files(spark, small_blocks, tmp_path):
    rng = np.random.default_rng(3)
    want = []
    for file, n in enumerate((70, 0, 200, 1, 33)):
        rows = [{"vector": [round(float(x), 3) for x in rng.random(3)], "label": "fraud" if i % 2 else "legit"} for i in range(n)]
        if n == 200:
            rows[5] = {"vector": [1.0], "label": "fraud"}
        text = json.dumps(rows) if file % 2 == 0 else "\n".join(map(json.dumps, rows))
        (tmp_path / f"part-{file}.json{'.gz' if file == 4 else ''}").write_bytes(gzip.compress(text.encode()) if file == 4 else text.encode())
        want += rows
    found = references.read_references(spark, str(tmp_path), 3, keep_bad=True).collect()
    assert sorted(r["ref_id"] for r in found) == list(range(len(want)))
    for r in found:
        own = want[r["ref_id"]]
        assert r["v"] == [pytest.approx(x, abs=1e-6) for x in own["vector"]] and r["is_fraud"] == (own["label"] == "fraud") and r["good"] == (len(own["vector"]) == 3)
    assert references.read_references(spark, str(tmp_path), 3).count() == len(want) - 1


def test_lines_of_many_files_have_their_numbers(spark, small_blocks, tmp_path):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(500)]
    for file, (a, b) in enumerate(((0, 13), (13, 300), (300, 301), (301, 500))):
        (tmp_path / f"{file}.txt").write_text("\n".join(lines[a:b]) + "\n")
    got = blocks.numbered(blocks.read_blocks(spark, str(tmp_path)), "n").collect()
    assert sorted((r["n"], r["value"]) for r in got) == list(enumerate(lines))

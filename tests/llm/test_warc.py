import hashlib

import zstandard

from vicinal.llm import warc

ROWS = [
    (1, "http://a/ x\ny", "<p>" + "é" * 80), (2, None, "<p>" + "é" * 80), (3, "http://c", None), (None, "http://d", "<p>" + "é" * 80), (5, "http://e", ""),
    (6, "http://f", "tiny"), (7, "http://g", "tiny"), (8, "http://h", "z" * 3_000_000), (9, "http://i", "\r\n\r\nWARC/1.1\r\n" * 20), (9, "http://i", "\r\n\r\nWARC/1.1\r\n" * 20),
    (4, "http://j", "<p>" + "é" * 80), (10, "http://k", "x" * 99), (11, "http://l", "x" * 99), (12, "http://m", "y" * 100), (13, "http://n", "y" * 100),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, payload string, bundle string")


def test_round_trip(spark, tmp_path):
    index = warc.write_bundles(frame(spark), str(tmp_path), frame_bytes=500)
    back = warc.read_bundles(spark, index, str(tmp_path)).collect()
    assert len(back) == len(ROWS)
    want = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        ids = [p for p, _, h in ROWS if (h or "").encode() == data and p is not None]
        revisit = len(data) >= 100 and ids and page != min(ids)
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(ids) if revisit else None))
    assert sorted(map(repr, want)) == sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in back)
    for r in back:
        assert bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else dict((p, (h or "").encode()) for p, _, h in ROWS)[r["page_id"]])


def test_other_decoders_read_the_bundles(spark, tmp_path):
    index = warc.write_bundles(frame(spark), str(tmp_path), frame_bytes=500).collect()
    for name in {r["bundle"] for r in index}:
        with (tmp_path / name).open("rb") as file:
            data = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
        assert sum(1 for _ in warc.parse_records(data)) == sum(r["bundle"] == name for r in index)


def test_one_record_is_read_from_its_frame(spark, tmp_path):
    index = warc.write_bundles(frame(spark), str(tmp_path), frame_bytes=500)
    entry = index.filter("page_id = 8").first()
    with (tmp_path / entry["bundle"]).open("rb") as file:
        file.seek(entry["frame_at"])
        data = zstandard.ZstdDecompressor().decompress(file.read(entry["frame_bytes"]))
    own = data[entry["record_at"] : entry["record_at"] + entry["record_bytes"]]
    assert f"<{entry['record_id']}>".encode() in own and own.endswith(b"z\r\n\r\n")
    wanted = index.filter("page_id in (3, 8)").select("record_id")
    assert sorted(r["page_id"] for r in warc.fetch(spark, index, str(tmp_path), wanted).collect()) == [3, 8]


def test_empty_table(spark, tmp_path):
    index = warc.write_bundles(frame(spark).limit(0), str(tmp_path))
    assert index.count() == 0 and warc.read_bundles(spark, index, str(tmp_path)).count() == 0


def test_repeated_rows_have_identifiers_of_their_own(spark, tmp_path):
    page = (7, "http://x.example/", "<p>" + "again " * 40)
    pages = spark.createDataFrame([page] * 4 + [(8, None, page[2]), (9, "u", "short"), (9, "u", "short"), (None, None, None), (None, None, None)], "page_id bigint, url string, html string")
    index = warc.write_bundles(pages, str(tmp_path))
    ids = [r["record_id"] for r in index.collect()]
    assert len(set(ids)) == len(ids) == 9
    back = warc.read_bundles(spark, index, str(tmp_path)).collect()
    assert sorted(r["record_id"] for r in back) == sorted(ids)
    for wanted in ids[:3]:
        found = warc.fetch(spark, index, str(tmp_path), index.filter(index["record_id"] == wanted)).collect()
        assert [r["record_id"] for r in found] == [wanted]
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in back)[2:7] == [(7, "response")] * 4 + [(8, "revisit")]
    heads = []
    for name in {r["bundle"] for r in index.collect()}:
        with (tmp_path / name).open("rb") as file:
            heads += [h for _, _, h, _ in warc.parse_records(zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read())]
    assert [h.get("warc-refers-to") for h in heads if h["warc-type"] == "revisit"] == [None]


def test_references_name_records(spark, tmp_path):
    """Whatever a revisit refers to is a record of the bundles."""
    html = {1: "a" * 200, 2: "b" * 200}
    pages = spark.createDataFrame([(i, None, html[1 + i % 2]) for i in range(8)] + [(1, None, html[2])] * 2, "page_id bigint, url string, html string")
    index = warc.write_bundles(pages, str(tmp_path)).collect()
    found = []
    for name in {r["bundle"] for r in index}:
        with (tmp_path / name).open("rb") as file:
            found += [h for _, _, h, _ in warc.parse_records(zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read())]
    ids = {h["warc-record-id"] for h in found}
    named = [h["warc-refers-to"] for h in found if "warc-refers-to" in h]
    assert set(named) <= ids and len(named) == 3
    assert sum(h["warc-type"] == "revisit" and "warc-refers-to" not in h for h in found) == 3

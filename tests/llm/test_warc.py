import hashlib
import io
import random
import zlib

import pytest
from crashgrid.llm.warc import MAGIC, archive_roundtrip, open_store, qualified, read_warc, record_bytes, records_in, write_warc
from crashgrid.session import scratch_path

draw = random.Random(9)
LONG = "é" + "x" * 200
ROWS = ([(i, f"http://h/{i}", "p" * draw.randint(0, 500) + str(i)) for i in range(40)]
        + [(200, "u", LONG), (150, "u\r\nX-Page-Id: 7", LONG), (300, None, LONG), (None, "n", LONG), (150, "u", LONG)]
        + [(400, "s", "short"), (401, "s", "short"), (402, "e", None), (403, "e", ""), (404, "big", "b" * 3_000_000),
           (405, "magic", "".join(chr(x) for x in MAGIC) * 200), (None, "only", "o" * 150), (None, "only", "o" * 150)])


def expected():
    first = {}
    for i, _, h in ROWS:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in ROWS:
        body = (h or "").encode()
        refers = first.get(h) if first.get(h) != i else None
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("split_bytes", [8 << 20, 257])
def test_roundtrip_whatever_the_split(pages, spark, split_bytes):
    got = archive_roundtrip(pages, scratch_path(spark, "t"), split_bytes=split_bytes).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got),
                  key=str) == expected()


def test_payloads_and_urls_come_back(pages, spark):
    path = scratch_path(spark, "t")
    back = read_warc(spark, write_warc(pages, path), with_payload=True).collect()
    got = {(r["page_id"], r["url"]): r["payload"] for r in back if r["record_type"] == "response"}
    assert bytes(got[404, "big"]) == b"b" * 3_000_000 and bytes(got[402, "e"]) == b""
    assert (150, "u\r\nX-Page-Id: 7") in got


def test_archives_are_plain_gzip(pages, spark):
    files = [r["file"] for r in write_warc(pages, scratch_path(spark, "t")).collect()]
    store, name = open_store(files[0])
    with store.open_input_file(name) as source:
        data = source.read()
    members = 0
    while data:
        packer = zlib.decompressobj(31)
        assert packer.decompress(data).startswith(b"WARC/1.1\r\n")
        data, members = packer.unused_data, members + 1
    assert members > 0


def test_false_magic_between_and_inside_records():
    members = [record_bytes(i, "u", bytes(draw.randrange(256) for _ in range(300)) + MAGIC * 3, "d", None) for i in range(20)]
    noise = MAGIC + b"\x08" + b"noise" * 3
    data = noise + noise.join(members) + MAGIC
    for step in (1, 50, 333, 10**6):
        found = [h["x-page-id"] for lo in range(0, len(data), step) for h, _ in records_in(io.BytesIO(data), lo, lo + step)]
        assert found == [str(i) for i in range(20)]


def test_empty_table(pages, spark):
    assert archive_roundtrip(pages.limit(0), scratch_path(spark, "t")).count() == 0


@pytest.mark.parametrize("split_bytes", [8 << 20, 400])
def test_a_damaged_record_raises_wherever_it_lies(pages, spark, split_bytes):
    manifest = write_warc(pages.where("page_id < 40").coalesce(1), scratch_path(spark, "t"))
    (row,) = manifest.collect()
    assert row["n_records"] == 40
    store, name = open_store(row["file"])
    with store.open_input_file(name) as source:
        data = source.read()
    starts = [0]
    while starts[-1] < len(data):
        packer = zlib.decompressobj(31)
        packer.decompress(data[starts[-1]:])
        starts.append(len(data) - len(packer.unused_data))
    for place in (starts[0] + 1, starts[7] + 25, starts[-2] + 40):
        with store.open_output_stream(name, compression=None) as out:
            out.write(data[:place] + bytes([data[place] ^ 0xFF]) + data[place + 1:])
        with pytest.raises(Exception, match="damaged|no record"):
            read_warc(spark, manifest, split_bytes).collect()
    with store.open_output_stream(name, compression=None) as out:
        out.write(data[:starts[30]])  # cut off
    with pytest.raises(Exception, match="damaged"):
        read_warc(spark, manifest, split_bytes).collect()
    with store.open_output_stream(name, compression=None) as out:
        out.write(data)
    assert read_warc(spark, manifest, split_bytes).count() == 40


def test_paths_get_the_scheme_of_the_default_file_system(spark, tmp_path):
    assert qualified(spark, str(tmp_path)).startswith("file:/")
    with pytest.raises(ValueError, match="no scheme"):
        open_store(str(tmp_path))
    manifest = write_warc(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert manifest.first()["file"].startswith("file:/")


def test_revisits_name_the_record_that_they_refer_to(pages, spark):
    manifest = write_warc(pages, scratch_path(spark, "t"))
    headers = []
    for r in manifest.collect():
        store, name = open_store(r["file"])
        with store.open_input_file(name) as source:
            headers += [h for h, _ in records_in(source, 0, r["n_bytes"], strict=True)]
    by_id = {h["warc-record-id"]: h for h in headers if h["warc-type"] == "response"}
    revisits = [h for h in headers if h["warc-type"] == "revisit"]
    assert revisits and all(h["content-type"] == "text/html" for h in headers)
    for h in revisits:
        response = by_id[h["warc-refers-to"]]
        assert response["x-page-id"] == h["x-refers-to-page-id"]
        assert response["warc-payload-digest"] == h["warc-payload-digest"]
        assert "warc-refers-to-target-uri" in h

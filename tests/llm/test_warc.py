import gzip
import hashlib
import io

import pytest

from scenelake.llm import warc

PAGES = [
    (1, "http://a/%41\r\nX: y", "<p>" + "x" * 200, "z"),
    (2, "http://b", "<p>" + "x" * 200, "z"),
    (2, "http://b", "<p>" + "x" * 200, "z"),
    (0, None, "<p>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\n", "z"),
    (5, "u", None, "z"),
    (6, "u", "", "z"),
    (7, "u", "short", "z"),
    (8, "u", "short", "z"),
    (None, "u", "<p>" + "x" * 200, "z"),
    (9, "big", "0123456789" * 300_000, "z"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(3)


@pytest.fixture(scope="module")
def archive(pages, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    warc.archive_pages(pages, folder)
    return folder


def test_round_trip(spark, archive):
    key = lambda r: tuple(str(x) for x in r)
    first = {}
    for page, _, html, _ in PAGES:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    want = []
    for page, _, html, _ in PAGES:
        body = (html or "").encode()
        source = first.get(html)
        revisit = source is not None and page != source
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", source if revisit else None))
    assert sorted(map(tuple, warc.read_pages(spark, archive).collect()), key=key) == sorted(want, key=key)


def test_records_keep_urls_and_payloads(spark, archive):
    rows = {r.record_id: r for r in spark.read.format("warc").load(archive).collect()}
    assert rows["urn:page:1"].target_uri == "http://a/%41%0D%0AX: y" and rows["urn:page:0"].target_uri is None
    assert bytes(rows["urn:page:9"].payload).decode() == PAGES[-1][2] and rows["urn:page:2"].payload is None


def test_pushed_predicates_skip_payloads(spark, archive):
    records = spark.read.format("warc").load(archive)
    assert records.where("record_type = 'revisit'").count() == 3
    assert [r.record_id for r in records.where("target_uri = 'big'").collect()] == ["urn:page:9"]
    assert records.where("payload_length > 1000 and record_type = 'response'").count() == 1
    bare = spark.read.format("warc").option("payload", "false").load(archive)
    assert bare.where("payload is not null").count() == 0 and bare.count() == len(PAGES)


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got

    def size(self):
        return len(self.getvalue())


def records():
    import random

    noise = [bytes(random.Random(i).randbytes(400_000)) for i in range(5)]
    return [warc.record_bytes(f"r{i}", "response", "u", None, "d", len(x), x) for i, x in enumerate(noise)], noise


def test_unwanted_payloads_are_not_read():
    made, noise = records()
    for gzipped, data in ((True, b"".join(map(warc.member, made))), (False, b"".join(made))):
        raw = Counting(data)
        got = list(warc.read_file(raw, gzipped, lambda v: v["record_id"] == "r3"))
        assert [r[0] for r in got] == ["r3"] and got[0][-1] == noise[3]
        assert raw.taken < len(data) / 2


def test_foreign_archives():
    made, noise = records()
    data = b"".join(gzip.compress(x) for x in made)
    got = list(warc.read_file(Counting(data), True, lambda v: v["record_id"] != "r1"))
    assert [r[-1] for r in got] == [noise[i] for i in (0, 2, 3, 4)]
    with pytest.raises(ValueError):
        list(warc.read_file(Counting(b"no archive\r\n\r\n"), False, lambda v: True))


def test_file_sizes_and_empty(spark, pages, tmp_path):
    import os

    warc.register(spark)
    many = str(tmp_path / "many")
    warc.page_records(pages).coalesce(1).write.format("warc").option("maxFileBytes", "1").mode("append").save(many)
    assert len(os.listdir(many)) == len(PAGES) and warc.read_pages(spark, many).count() == len(PAGES)
    warc.page_records(pages.limit(1)).write.format("warc").mode("overwrite").save(many)
    assert warc.read_pages(spark, many).count() == 1
    none = str(tmp_path / "none")
    warc.archive_pages(pages.limit(0), none)
    assert warc.read_pages(spark, none).count() == 0


def test_lengths_without_payloads(spark, archive):
    whole = spark.read.format("warc").load(archive)
    bare = spark.read.format("warc").option("payload", "false").load(archive)
    lengths = lambda df: sorted((r.record_id or "", r.payload_length) for r in df.collect())
    assert lengths(bare) == lengths(whole)
    for test in ("payload_length >= 100", "payload_length < 100", "payload_length > 1000 and record_type = 'response'"):
        assert lengths(bare.where(test)) == lengths(whole.where(test)) != []


def test_lengths_of_foreign_blocks():
    made, noise = records()

    def other(block, kind="application/http; msgtype=response"):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: " + b"x" * 5000
    made += [other(http + b"\r\n\r\nbody"), other(http), other(b"a\r\n\r\nb", "text/plain"), other(b"")]
    for gzipped, pack in ((True, warc.member), (True, gzip.compress), (False, bytes)):
        raw, full = Counting(b"".join(map(pack, made))), Counting(b"".join(map(pack, made)))
        got = [r[5:] for r in warc.read_file(raw, gzipped, lambda v: True, with_payload=False)]
        assert got == [(n, None) for n in [*map(len, noise), 4, 0, 6, 0]]
        assert [r[5] for r in warc.read_file(full, gzipped, lambda v: True)] == [n for n, _ in got]
        if pack is not gzip.compress:
            assert raw.taken < full.taken


def test_small_unwanted_payloads_are_not_inflated(monkeypatch):
    import random

    inflated = 0
    need = warc._Inflated.need

    def counted(self, n):
        nonlocal inflated
        before = len(self.out)
        need(self, n)
        inflated += len(self.out) - before

    monkeypatch.setattr(warc._Inflated, "need", counted)
    texts = [("".join(random.Random(i).choices("abcdefgh ", k=5000))).encode() for i in range(50)]
    data = b"".join(warc.member(warc.record_bytes(f"r{i}", "response", "u", None, "d", len(x), x)) for i, x in enumerate(texts))
    raw = Counting(data)
    got = list(warc.read_file(raw, True, lambda v: v["record_id"] == "r7"))
    assert [r[-1] for r in got] == [texts[7]]
    assert inflated < 50 * 1100 + 6000
    inflated = 0
    assert len(list(warc.read_file(Counting(data), True, lambda v: True))) == 50 and inflated > 50 * 5000


def test_uris_and_names_as_archives_write_them():
    uri = "http://a/b%20c?100%25&q=%0A \u00a0"
    data = warc.record_bytes("urn:x:1", "revisit", uri, "urn:x:0", "d", 0, b"")
    assert b"WARC-Record-ID: <urn:x:1>\r\n" in data and b"WARC-Refers-To: <urn:x:0>\r\n" in data
    assert f"WARC-Target-URI: {uri}\r\n".encode() in data
    for gzipped, pack in ((True, warc.member), (True, gzip.compress), (False, bytes)):
        ((name, _, target, refers, *_),) = warc.read_file(Counting(pack(data)), gzipped, lambda v: True)
        assert (name, target, refers) == ("urn:x:1", uri, "urn:x:0")
    foreign = data.replace(b"<urn:x:1>", b"urn:x:1")
    assert next(warc.read_file(Counting(foreign), False, lambda v: True))[0] == "urn:x:1"


def test_record_of_nothing():
    data = warc.record_bytes(None, None, None, None, "d", 2, b"ab")
    assert next(warc.read_file(Counting(warc.member(data)), True, lambda v: True)) == (None, None, None, None, "d", 2, b"ab")

"""WARC records: written, read back, and read where they are damaged."""

import base64
import gzip
import hashlib
import io
import random
import uuid

import pytest

from cairnledger.llm import queries, warc
from cairnledger.llm.common import own_folder

ROWS = [
    (1, "http://a.example/x y?ü=1\r\nEvil: 1", "<p>héllo 漢字</p>", 1), (2, "http://b.example", "<p>same</p>", 1), (3, None, "<p>same</p>", 1), (4, "http://c.example", None, 1), (5, "http://c.example", "", 1),
    (None, "http://d.example", "<p>same</p>", 1), (2, "http://e.example", "<p>same</p>", 1), (None, None, "alone", 1), (6, "u", "long " * 700_000, 1), (7, "u", "a\r\n\r\nb\r\n\r\n", 1), (8, "", "WARC/1.1\r\n\r\n", 1),
]


@pytest.fixture(scope="module")
def odd_pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, payload_bytes int").withColumnRenamed("payload_bytes", "first")


def by_hand(rows):
    first = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        data, other = (html or "").encode(), first.get(html or "")
        revisit = other is not None and other != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=str)


def result(df):
    rows = df.collect()
    assert not [r for r in rows if r["problem"]]
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


def test_round_trip(spark, odd_pages, pages):
    assert result(warc.archived(odd_pages)) == by_hand(ROWS)
    assert result(warc.archived(odd_pages.limit(0))) == []
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    rows += [(k + 1_000_000, u, h) for k, u, h in rows[::3]]
    many = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert result(warc.archived(many)) == by_hand(rows)
    assert result(queries.op11_warc(spark, "/root/testdata/sf0.001")) == by_hand(rows[: pages.count()])


def test_least(odd_pages):
    kinds = {r["page_id"]: r["record_type"] for r in warc.archived(odd_pages.where("page_id IN (2, 3, 4, 5)"), least=5).collect()}
    assert kinds == {2: "response", 3: "revisit", 4: "response", 5: "response"}


def test_join_beyond_broadcast(odd_pages, monkeypatch):
    monkeypatch.setattr(warc, "small", lambda df, n: df)
    assert result(warc.archived(odd_pages)) == by_hand(ROWS)


def test_files_payloads_and_missing_response(spark, odd_pages):
    files = warc.write_archives(odd_pages.repartition(2), f"{own_folder(spark)}/{uuid.uuid4().hex}", file_bytes=600)
    assert files.agg({"n_records": "sum"}).first()[0] == len(ROWS) and files.count() > 3
    records = warc.read_archives(files, payload=True)
    got = sorted(((r["page_id"], bytes(r["payload"]).decode()) for r in records.where("record_type = 'response'").collect()), key=str)
    want = sorted(((None if k is None else str(k), h or "") for (k, _, h, *_), (*_, kind, _) in zip(sorted(ROWS, key=lambda r: str((r[0], len((r[2] or "").encode())))), by_hand(ROWS), strict=True) if kind == "response"), key=str)
    assert got == want
    urls = {r["url"] for r in records.collect()}
    assert "http://a.example/x%20y?%C3%BC=1%0D%0AEvil:%201" in urls and None in urls
    orphans = warc.resolved(records.where("record_type = 'revisit' OR page_id <> '2'")).where("record_type = 'revisit' AND refers_to = '2'").collect()
    assert orphans and all(r["problem"] for r in orphans)


def read(data, payload=True):
    return list(warc.records_of(io.BytesIO(data), payload))


def test_each_member_is_a_gzip_file_and_pieces_join(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choices(range(256), k=rng.choice((0, 1, 50, 5000)))) for _ in range(40)]
    members = [warc.member(str(i), "u", t, None) for i, t in enumerate(texts)]
    assert all(gzip.decompress(m).endswith(t + b"\r\n\r\n") for m, t in zip(members, texts, strict=True))
    for size in (1, 7, 1 << 18):
        monkeypatch.setattr(warc, "READ_BYTES", size)
        monkeypatch.setattr(warc, "INFLATE_BYTES", max(1, size // 2))
        found = read(b"".join(members))
        assert [r["payload"] for r in found] == texts and not any(r.get("problem") for r in found)
        assert [r["at"] for r in found] == [sum(map(len, members[:i])) for i in range(len(members))]


@pytest.mark.parametrize("size", [3, 1 << 18])
def test_damage(monkeypatch, size):
    monkeypatch.setattr(warc, "READ_BYTES", size)
    good = [warc.member(str(i), None, b"payload %d " % i * 40, None) for i in range(3)]
    bad = bytearray(good[1])
    bad[len(bad) // 2] ^= 0x55
    cases = {
        "flipped": bytes(bad), "no gzip": b"garbage" * 5, "short": gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc\r\n\r\n"), "no header": gzip.compress(b"hello"), "no length": gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"),
        "digest": gzip.compress(gzip.decompress(good[1]).replace(b"payload 1", b"payload 2")), "long": gzip.compress(gzip.decompress(good[1]) + b"more"),
    }
    for name, between in cases.items():
        found = read(good[0] + between + good[2])
        assert [r.get("page_id") for r in found if not r.get("problem")] == ["0", "2"], name
        assert [r for r in found if r.get("problem")], name
    cut = read(good[0] + good[1][:-9])
    assert cut[0]["page_id"] == "0" and cut[1]["problem"] == "the file ends inside a member" and len(cut) == 2
    assert read(b"") == []


def test_other_records():
    info = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 8\r\n\r\na: b\r\n\r\n\r\n\r\n")
    (r,) = read(info)
    assert r["payload"] == b"a: b\r\n\r\n" and r["record_type"] == "warcinfo" and not r.get("problem")

"""WARC writing, salvage reading and revisits."""

import base64
import gzip
import hashlib
import random

import oracle
import pytest

from corpusq.llm import queries, warc
from corpusq.plans.workspace import Workspace


def sample(n=6, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = rng.randbytes(rng.randrange(0, 400)) + b"\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\x1f\x8b\x08"
        out.append((i, body, warc.build(i, f"http://x/{i} a", body, len(body), hashlib.sha256(body).hexdigest(), None)))
    return out


def test_plain_and_gzip_members_read_back():
    rows = sample()
    gz = b"".join(warc.member(r) for _, _, r in rows)
    for data, padding in ((b"".join(r for _, _, r in rows), 0), (gz + b"\0", 1), (rows[0][2] + warc.member(rows[1][2]) + rows[2][2], 0)):
        got = list(warc.salvage(data))
        assert all(isinstance(x, warc.Record) for x in got)
        assert [x.payload for x in got] == [b for _, b, _ in rows][: len(got)] and len(got) >= 3
        assert sum(x.length for x in got) == len(data) - padding


def test_salvage_after_damage():
    rng = random.Random(9)
    rows = sample(12)
    for gz in (False, True):
        parts = [warc.member(r) if gz else r for _, _, r in rows]
        for _ in range(60):
            broken = sorted(rng.sample(range(12), 3))
            cut = []
            for i, p in enumerate(parts):
                if i in broken:
                    kind, j = rng.randrange(3), rng.randrange(len(p) // 4, len(p) - 8)
                    p = p[:j] if kind == 0 else p[:j] + bytes([p[j] ^ 0x55]) + p[j + 1 :] if kind == 1 else rng.randbytes(30) + p[j:]
                cut.append(p)
            data = b"".join(cut)
            got = list(warc.salvage(data))
            names = {x.record_id for x in got if isinstance(x, warc.Record)}
            assert {f"urn:page:{i}" for i in range(12) if i not in broken} <= names
            assert len(data) - data.count(0) <= sum(x.length for x in got) <= len(data)
            for x in got:
                if isinstance(x, warc.Record) and x.record_id.startswith("urn:page:"):
                    assert x.payload == rows[warc.page_of(x.record_id)][1]


def test_gap_is_logged():
    rows = sample(3)
    got = list(warc.salvage(rows[0][2] + b"garbage" + rows[1][2] + rows[2][2][:50]))
    assert [(type(x).__name__, x.length) for x in got if isinstance(x, warc.Gap)] == [("Gap", 7), ("Gap", 50)]


def test_table_round_trip(spark):
    big, shared = "<p>" + "é" * 3_000_000, "<html>" + "same " * 50
    rows = [(5, "http://a", shared), (2, None, shared), (9, "u", shared), (9, "u", shared), (2, None, shared), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", big), (None, "u", shared), (8, "u\nv", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS refers_to")
    got = [tuple(r) for r in warc.round_trip(pages, Workspace(spark, "warc")).collect()]
    digest = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    want = []
    for page, _, html in rows:
        refers = 2 if html == shared and page in (5, 9) else 7 if page == 8 else None
        want.append((page, len((html or "").encode()), digest(html), "revisit" if refers else "response", refers))
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0), Workspace(spark, "warc")).count() == 0


def test_read_reports_gaps(spark, tmp_path):
    rows = sample(4)
    (tmp_path / "a.warc").write_bytes(rows[0][2] + b"xx" + rows[1][2])
    (tmp_path / "b.warc.gz").write_bytes(warc.member(rows[2][2])[:-9] + warc.member(rows[3][2]))
    got = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted(r.page_id for r in got if r.kind == "response") == [0, 1, 3]
    assert len([r for r in got if r.kind == "gap" and r.reason]) == 2


def test_records_of_one_member():
    parts = [warc.build(i, f"http://x/{i}", b"page %d" % i, 6, hashlib.sha256(b"page %d" % i).hexdigest(), None) for i in range(4)]
    parts[1] = parts[1].replace(b"page 1", b"page x")
    whole = warc.member(b"".join(parts))
    got = list(warc.salvage(whole + warc.member(parts[0])))
    assert [x.payload if isinstance(x, warc.Record) else "gap" for x in got] == [b"page 0", "gap", b"page 2", b"page 3", b"page 0"]
    assert {(x.offset, x.length) for x in got[:4]} == {(0, len(whole))} and got[4].offset == len(whole)


def foreign(kind, block, fields=(), mime="text/plain", version="1.0"):
    """A record as other writers make it: SHA-1 in base 32, own order of headers."""
    b32 = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", *fields, f"WARC-Block-Digest: sha1:{b32(block)}", f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return f"WARC/{version}\r\n".encode() + "".join(x + "\r\n" for x in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def payload_digest(x, name="sha1", form="b32"):
    raw = hashlib.new(name, x).digest()
    return f"WARC-Payload-Digest: {name}:{base64.b32encode(raw).decode() if form == 'b32' else raw.hex().upper()}"


HTTP = "application/http; msgtype=response"


def foreign_records():
    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    body = b"a body\r\n\r\nwith a blank line"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nwiki\r\n5;x=y\r\npedia\r\n0\r\n\r\n"
    return [
        (foreign("warcinfo", b"software: x\r\n\r\nformat: y", mime="application/warc-fields"), b"software: x\r\n\r\nformat: y"),
        (foreign("response", page + body, [payload_digest(body)], HTTP), body),
        (foreign("response", page + body, [payload_digest(body, "sha256", "hex")], "application/http;msgtype=response", "1.1"), body),
        (foreign("response", page + body, [payload_digest(body, "md5", "hex"), "WARC-Target-URI: http://x/\r\n  folded\r\n\tagain"], HTTP, "0.18"), body),
        (foreign("response", chunked, [payload_digest(b"wikipedia")], HTTP), chunked.partition(b"\r\n\r\n")[2]),
        (foreign("resource", b"raw \r\n\r\n bytes", [payload_digest(b"raw \r\n\r\n bytes")], "image/gif"), b"raw \r\n\r\n bytes"),
        (foreign("response", page + body, ["WARC-Payload-Digest: blake3:abc"], HTTP), body),
        (foreign("response", page + body[:4], [payload_digest(body), "WARC-Truncated: length"], HTTP), body[:4]),
        (foreign("revisit", b"", [payload_digest(body), "WARC-Refers-To: <urn:uuid:response-1>"], HTTP), b""),
        (foreign("metadata", b"", mime="application/warc-fields"), b""),
    ]


@pytest.mark.parametrize("pack", [lambda r: r, warc.member])
def test_foreign_records(pack):
    rows = foreign_records()
    data = b"".join(pack(r) for r, _ in rows)
    got = list(warc.salvage(data))
    assert [getattr(x, "payload", x) for x in got] == [p for _, p in rows]
    assert sum(x.length for x in got) == len(data) and got[3].uri == "http://x/ folded again"
    assert [x.unchecked is None for x in got] == [True] * 6 + [False, False] + [True] * 2
    assert "blake3:abc" in got[6].unchecked and (got[8].payload_bytes, got[8].payload_digest[:5]) == (None, "sha1:")


def test_damaged_foreign_records():
    rows = foreign_records()
    for i in (1, 2, 3, 5):
        record = rows[i][0]
        j = record.index(b"body") if b"body" in record else record.index(b"raw ")
        bad = record[:j] + b"X" + record[j + 1 :]
        got = list(warc.salvage(rows[0][0] + bad + rows[-1][0]))
        assert [type(x).__name__ for x in got] == ["Record", "Gap", "Record"] and "digest" in got[1].reason and got[1].length == len(bad)


def test_pieces_give_the_same_as_the_whole():
    rng = random.Random(21)
    rows = [r for _, _, r in sample(10)] + [r for r, _ in foreign_records()]
    for _ in range(25):
        parts = []
        for r in rng.sample(rows, 12):
            r = warc.member(r) if rng.random() < 0.6 else r
            if rng.random() < 0.3:
                j = rng.randrange(1, len(r))
                r = r[:j] + rng.choice([b"", b"\x1f\x8b\x08", b"WARC/1.0\r\n", b"\0\0"]) + r[j + rng.randrange(3) :]
            parts.append(r)
        data = b"".join(parts)
        whole = list(warc.salvage(data))
        for piece in (1, 7, 100, 5000):
            at = 0

            def read(n, piece=piece):
                nonlocal at
                out = data[at : at + min(n, 2 * piece)]
                at += len(out)
                return out

            assert list(warc.salvage_stream(read, piece)) == whole


def test_large_archives_are_read_in_pieces(spark, tmp_path):
    rows = sample(40)
    (tmp_path / "big.warc.gz").write_bytes(b"".join(warc.member(r) for _, _, r in rows) + b"junk")
    (tmp_path / "small.warc").write_bytes(rows[0][2])
    both = [warc.read(spark, f"file://{tmp_path}", whole_bytes=n).drop("archive").collect() for n in (1 << 30, 5000)]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1])) and len(both[0]) == 42


def test_files_are_gzip(spark, docs):
    ws = Workspace(spark, "warc")
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}" * 400) for i in range(30)], "page_id long, url string, html string")
    warc.write(pages, ws.path, archive_bytes=2000)
    files = spark.read.format("binaryFile").load(f"{ws.path}/*.warc.gz").collect()
    assert len(files) > 3 and sum(gzip.decompress(bytes(f.content)).count(b"WARC/1.1\r\n") for f in files) == 30
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(ws.path).count() == len(files)


def test_sql(spark):
    assert oracle.compare(spark, "/root/testdata/sf0.01", queries.QUERIES["op7_warc"], warc.ORACLE) > 100

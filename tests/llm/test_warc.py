import gzip
import random
import time

import duckdb
import pytest

from vertexloom.llm import oracles, queries, warc

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, None, None),
    (4, "http://a/4", ""),
    (5, "http://a/\r\nx", "é\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n" * 3),
    (6, "http://a/6", "\x1f\x8b\x08" + "z" * 70000),
    (0, "http://a/0", "<p>one</p>"),
    (6, "http://a/6", "\x1f\x8b\x08" + "z" * 70000),
    (None, "http://a/n", "<p>one</p>"),
]


def plain(records):
    records = list(records)
    return [x for x in records if isinstance(x, warc.Record)], [x for x in records if isinstance(x, warc.Gap)]


def records(n, seed=0):
    rng = random.Random(seed)
    return [warc.build_record(i, f"http://x/{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(400)))) for i in range(n)]


@pytest.mark.parametrize("wrap", [lambda r: r, warc.member])
def test_sound_archives_have_no_gap(wrap):
    good, gaps = plain(warc.salvage(b"".join(map(wrap, records(30)))))
    assert len(good) == 30 and not gaps
    assert [r.fields["warc-target-uri"] for r in good] == [f"http://x/{i}" for i in range(30)]


def test_members_are_ordinary_gzip():
    raw = records(5)
    assert gzip.decompress(b"".join(map(warc.member, raw))) == b"".join(raw)
    assert gzip.decompress(b"\0".join(map(warc.member, raw))) == b"".join(raw)
    good, gaps = plain(warc.salvage(b"\0".join(map(warc.member, raw))))
    assert len(good) == 5 and not gaps


@pytest.mark.parametrize("wrap", [lambda r: r, warc.member])
@pytest.mark.parametrize("damage", ["flip", "cut", "insert", "drop"])
def test_later_records_are_recovered_and_gaps_logged(wrap, damage):
    rng = random.Random(3)
    parts = [wrap(r) for r in records(40, 2)]
    whole = {i: p for i, p in enumerate(parts)}
    hurt = {5, 6, 20, 39}
    for i in hurt:
        p = bytearray(parts[i])
        at = len(p) // 2
        if damage == "flip":
            p[at] ^= 0x55
        elif damage == "cut":
            del p[at:]
        elif damage == "insert":
            p[at:at] = bytes(rng.randrange(256) for _ in range(9))
        else:
            del p[at : at + 3]
        whole[i] = bytes(p)
    data = b"".join(whole.values())
    good, gaps = plain(warc.salvage(data))
    found = {int(r.fields["warc-record-id"][len("<urn:page:") : -1]) for r in good}
    assert found >= set(range(40)) - hurt
    covered = sorted([(r.offset, r.length) for r in good] + [(g.offset, g.length) for g in gaps])
    at = 0
    for start, length in covered:
        assert data[at:start].strip(b"\0") == b"" and start >= at
        at = start + length
    assert at == len(data) and all(g.reason for g in gaps)


def test_garbage_and_nothing():
    assert list(warc.salvage(b"")) == []
    good, gaps = plain(warc.salvage(b"garbage" * 100))
    assert not good and [(g.offset, g.length) for g in gaps] == [(0, 700)]


def test_a_wrong_digest_is_quarantined():
    r = warc.build_record(1, None, b"payload").replace(b"payload", b"pAyload")
    _, gaps = plain(warc.salvage(r))
    assert [g.reason for g in gaps] == ["payload digest differs"]


def expected(pages, min_bytes=0):
    firsts = {}
    for i, _, h in pages:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    out = []
    for i, _, h in pages:
        payload = (h or "").encode()
        first = firsts.get(h or "") if len(payload) >= min_bytes else None
        revisit = first is not None and first != i
        out.append((i, len(payload), warc.digest(payload), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 1, 11])
def test_round_trip_through_files(spark, min_bytes):
    read = warc.archived(spark.createDataFrame(PAGES, SCHEMA).repartition(3), min_bytes)
    rows = read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "gap", "payload").collect()
    assert not [r for r in rows if r["gap"]]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == expected(PAGES, min_bytes)
    assert all(warc.digest(bytes(r["payload"])) == r["payload_digest"] for r in rows if r["record_type"] == "response")


def test_query_against_oracle_and_empty_table(spark, tmp_path):
    distinct = [p for p in PAGES if p[0] is not None][:-1]
    spark.createDataFrame(distinct, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(con.execute(oracles.OP6).fetchall(), key=str) == sorted((tuple(r) for r in queries.op6_warc(spark, str(tmp_path)).collect()), key=str)
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_headers_of_any_length(spark, tmp_path):
    pages = [(i, "http://x/" + "u" * n, f"<p>{i}</p>") for i, n in enumerate((10, 1 << 20, 3 << 20, 20))]
    spark.createDataFrame(pages, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["page_id"] for r in queries.op6_warc(spark, str(tmp_path)).collect()} == {0, 1, 2, 3}
    read = {r["page_id"]: r["url"] for r in warc.archived(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert read == {i: u for i, u, _ in pages}


def test_long_records_and_packs(spark):
    rng = random.Random(5)
    noise = "".join(chr(rng.randrange(0x100, 0x2000)) for _ in range(1 << 20))
    pages = [(i, None, noise[i : i + 3000] * (1 if i else 3000)) for i in range(40)]
    shared = warc.work_folder(spark) + "/packs"
    warc.write_archives(spark.createDataFrame(pages, SCHEMA).coalesce(1), shared, pack_bytes=9000, packs=3)
    read = warc.read_archives(spark, shared)
    assert read.select("file").distinct().count() > 3
    assert sorted((r["page_id"], r["payload_digest"], r["gap"]) for r in read.collect()) == [(i, warc.digest(h.encode()), None) for i, _, h in pages]


def test_a_long_members_last_byte_is_padding():
    record = warc.build_record(1, None, b"0" * (17 << 20))
    data = warc.member(record) + b"\0" + warc.member(warc.build_record(2, None, b"x"))
    good, gaps = plain(warc.salvage(data))
    assert [r.payload_bytes for r in good] == [17 << 20, 1] and not gaps


def test_files_damaged_on_disk_are_salvaged(spark, tmp_path):
    path = tmp_path / "archive"
    path.mkdir()
    parts = [warc.member(r) for r in records(30, 7)]
    parts[3] = parts[3][:-20]
    parts[9] = b"\x00\xff" * 40
    (path / "a.warc.gz.bin").write_bytes(b"".join(parts[:15]))
    (path / "b.warc.gz.bin").write_bytes(b"".join(parts[15:])[:-5])
    read = warc.read_archives(spark, str(path)).collect()
    assert {r["page_id"] for r in read if r["gap"] is None} >= set(range(30)) - {3, 9, 29}
    assert len([r for r in read if r["gap"]]) >= 3


def test_sound_records_of_a_damaged_member_are_recovered():
    whole = warc.member(b"".join(records(60, 8)), level=1)
    hurt = bytearray(whole)
    hurt[len(whole) // 2] ^= 0x10
    good, gaps = plain(warc.salvage(bytes(hurt) + warc.member(warc.build_record(99, None, b"z"))))
    assert len(good) > 25 and gaps and all(r.length == 0 for r in good[:-1])
    assert good[-1].fields["warc-record-id"] == "<urn:page:99>"
    stored = warc.member(b"".join(records(10, 9)), level=0)
    good, _ = plain(warc.salvage(stored[:-4]))
    assert sorted(r.fields["warc-record-id"] for r in good) == sorted(f"<urn:page:{i}>" for i in range(10))


def test_an_unsound_record_inside_a_sound_member():
    raw = records(12, 10)
    raw[4] = raw[4].replace(b"WARC-Type", b"WARC_Type")
    good, gaps = plain(warc.salvage(warc.member(b"".join(raw))))
    assert len(good) == 11 and len(gaps) == 1 and "of the member" in gaps[0].reason


def test_salvage_takes_linear_time():
    raw = records(4000, 11)
    for data in (
        b"".join(r.replace(b"Content-Length: ", b"Content-Length: 1", 2) for r in raw) * 8,
        b"".join(warc.member(r)[:-9] for r in raw) * 4,
        b"a:WARC/1.0\r\n" * 300000,
        b"WARC/1.0\r\n" * 300000,
    ):
        began = time.perf_counter()
        list(warc.salvage(data))
        assert time.perf_counter() - began < 20

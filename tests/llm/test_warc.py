import zlib

import pytest

from quern.llm import warc
from quern.llm.blocks import new_dir

BIG = "é" * 600


def rows(spark):
    pages = [(1, "http://a", BIG), (2, None, BIG), (3, "http://c\r\nWARC/1.1\r\n", "WARC/1.1\r\n\r\n" + BIG), (4, "http://d", None), (5, "http://e", ""), (6, "http://f", BIG), (6, "http://f", BIG), (None, "x", BIG), (8, "y", "short"), (9, "y", "short")]
    return spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("gz", [True, False])
def test_round_trip(spark, gz):
    path = new_dir(spark, "t")
    warc.write_archives(warc.plan_records(rows(spark)), path, gz)
    raw = warc.read_archives(spark, path)
    assert {r["payload_bytes"] for r in raw.filter("record_type = 'revisit'").collect()} == {None}
    found = warc.resolve_revisits(raw).collect()
    assert {r["kind"] for r in found} == {"record"} and len(found) == 10
    told = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in found)
    revisit = "<urn:page:6>"
    assert told == sorted(
        [("<urn:page:1>", "revisit", revisit, 1200), ("<urn:page:2>", "revisit", revisit, 1200), ("<urn:page:>", "revisit", revisit, 1200), ("<urn:page:3>", "response", "", 1212)]
        + [("<urn:page:4>", "response", "", 0), ("<urn:page:5>", "response", "", 0), ("<urn:page:8>", "response", "", 5), ("<urn:page:9>", "response", "", 5)]
        + [("<urn:page:6>", "response", "", 1200)] * 2
    )
    assert warc.read_archives(spark, path).filter("record_id = '<urn:page:3>'").first()["payload"] == ("WARC/1.1\r\n\r\n" + BIG).encode()


def archive(gz, n=6):
    out, places = b"", []
    for i in range(n):
        payload = f"payload {i} ".encode() * 20
        import hashlib

        raw = warc.record_bytes(i, f"http://{i}", payload, hashlib.sha1(payload).hexdigest(), None) + b"\r\n\r\n"
        if gz:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = z.compress(raw) + z.flush()
        places.append(len(out))
        out += raw
    return out, places


def ids(found):
    return [f["warc-record-id"] for kind, _, _, f, _ in found if kind == "record"]


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "insert"])
def test_salvage(gz, damage):
    data, at = archive(gz)
    bad = bytearray(data)
    lost = 2
    if damage == "flip":
        for k in range(at[2] + 40, at[3] - 10, 7):
            bad[k] ^= 0x55
    elif damage == "cut":
        bad[at[2] + 30 : at[3] - 5] = b""
    elif damage == "junk":
        bad[at[2] : at[3]] = b"WARC/1.1\r\nbroken \x1f\x8b\x08 line\r\n" * 3
    else:
        bad[at[2] : at[2]] = b"noise WARC/1.1 noise\x1f\x8b\x08"
        lost = None
    found = list(warc.salvage(bytes(bad)))
    assert ids(found) == [f"<urn:page:{i}>" for i in range(6) if i != lost]
    gaps = [(o, n) for kind, o, n, _, _ in found if kind == "gap"]
    assert len(gaps) == 1 and gaps[0][0] == at[2]
    spans = sorted((o, o + n) for _, o, n, _, _ in found)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_empty_and_truncated():
    assert list(warc.salvage(b"")) == []
    data, at = archive(False)
    found = list(warc.salvage(data[:-30]))
    assert len(ids(found)) == 5 and found[-1][0] == "gap" and found[-1][1] == at[5]


def test_no_pages(spark):
    path = new_dir(spark, "none")
    warc.write_archives(warc.plan_records(rows(spark).limit(0)), path)
    assert warc.read_archives(spark, path).count() == 0


def test_files_are_gzip_by_the_standard_and_bounded(spark):
    import gzip
    import random

    path = new_dir(spark, "std")
    rnd = random.Random(2)
    pages = [(i, "u" * (1 << 20 if i == 3 else 5), rnd.randbytes(30_000).hex() + (" " * (17 << 20) if i == 39 else "")) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.plan_records(df).coalesce(1).sortWithinPartitions("page_id"), path, file_bytes=200_000, suffix=".warc.gz")
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path + "/*.warc.gz").collect()]
    assert len(files) > 4 and all(len(f) < 300_000 for f in files)
    assert sum(gzip.decompress(f).count(b"WARC/1.1\r\n") for f in files) == 40
    got = warc.resolve_revisits(warc.read_archives(spark, path))
    assert sorted((r["record_id"], r["payload_bytes"]) for r in got.collect()) == sorted((f"<urn:page:{i}>", len(h)) for i, _, h in pages)


def foreign(i, digest, gap=b"\r\n"):
    block = b"HTTP/1.1 200 OK\r\n\r\nbody %d" % i
    head = [b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:page:%d>" % i, b"WARC-Target-URI: http://x/" + gap + b" folded", digest(block), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives():
    """Digests in base32 or of algorithms that are not known, folded header lines, several records in a member."""
    import base64
    import hashlib

    b32 = lambda b: b"WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(b).digest())
    wrong = lambda b: b"WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(b + b"x").digest())
    other = lambda b: b"WARC-Block-Digest: xxh3:abcdef"
    data = foreign(0, b32) + foreign(1, wrong) + foreign(2, other)
    found = list(warc.salvage(data))
    assert ids(found) == ["<urn:page:0>", "<urn:page:2>"] and [k for k, *_ in found] == ["record", "gap", "record"]
    assert found[0][3]["warc-target-uri"] == "http://x/ folded"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    both = z.compress(foreign(0, b32) + foreign(1, other)) + z.flush()
    found = list(warc.salvage(both + warc._member(b"") + b"\0\0" + both))
    assert ids(found) == ["<urn:page:0>", "<urn:page:1>"] * 2 and {k for k, *_ in found} == {"record"}


def test_a_revisit_of_nothing_has_no_size(spark):
    path = new_dir(spark, "lone")
    lone = spark.createDataFrame([(1, "u", bytearray(b"x"), "0" * 40, 77)], "page_id long, url string, payload binary, payload_digest string, refers_to long")
    warc.write_archives(lone, path)
    assert warc.resolve_revisits(warc.read_archives(spark, path)).first()["payload_bytes"] is None


def test_time_grows_with_the_archive():
    import random
    import time

    rnd = random.Random(1)
    payload = rnd.randbytes(20_000)

    def seconds(n):
        data = b"".join(warc._member(warc.record_bytes(i, "u", payload, "", None) + b"\r\n\r\n") for i in range(n))
        best = 1e9
        for _ in range(2):
            began = time.process_time()
            assert sum(k == "record" for k, *_ in warc.salvage(data)) == n
            best = min(best, time.process_time() - began)
        return best

    assert seconds(1600) < 9 * seconds(400)


def test_gap_log(spark, tmp_path):
    data, at = archive(True)
    (tmp_path / "a.warc.gz").write_bytes(data[: at[2]] + b"junk" * 9 + data[at[3] :])
    found = warc.read_archives(spark, f"file://{tmp_path}/a.warc.gz")
    log = new_dir(spark, "gaps")
    warc.log_gaps(found, log)
    warc.log_gaps(found.filter("false"), log)
    assert [(r["offset"], r["length"]) for r in spark.read.parquet(log).collect()] == [(at[2], 36)]

"""The WARC archive: exact round trips, one payload per content, digests with collisions, revisits."""

import base64
import hashlib

import pytest
from llm_fixtures import scratch  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm import warc as W


@pytest.fixture
def pages_of(spark, tmp_path):
    made = []

    def make(rows, files=2):
        # clashing extra columns
        df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id bigint, url string, html string, address string, id string, `a.b` string")
        path = str(tmp_path / f"pages{len(made)}")
        df.coalesce(files).write.parquet(path)
        made.append(path)
        return spark.read.parquet(path)

    return make


ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two é</p>"), (7, "http://a/7", "<p>one</p>"), (5, "http://a/5\r\nWARC-Type: fake", "<p>one</p>"),
    (8, None, None), (9, "http://e", ""), (None, "http://n", "<p>one</p>"), (2, "http://a/2", "<p>two é</p>"), (11, "http://long", "x\r\n" * 200_000),
]


def want_of(rows, least=0):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == payload]
        top = max((i for i in same if i is not None), default=None)
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), top if len(same) > 1 and len(payload) >= least else page_id))
    return out


@pytest.mark.parametrize("digest", [W.sha256, lambda p: F.unhex(F.lit("00"))], ids=["sha256", "colliding"])
@pytest.mark.parametrize("hot", [W.HOT_RECORDS, 1])
def test_records_come_back_exactly(spark, pages_of, scratch, digest, hot):  # noqa: F811
    archive = W.write_archive(pages_of(ROWS), scratch, digest=digest)
    stored = [bytes(r["payload"]) for r in archive.payloads.collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h in ROWS})  # each content once
    got = W.read_archive(archive, hot, digest).withColumn("record", W.record_bytes()).collect()
    assert sorted((repr(r["id"]), r["bytes"], r["sha1"]) for r in got) == sorted((repr(w[0]), *w[1:3]) for w in want_of(ROWS))
    for r in got:
        head, http, payload, record = (bytes(r[c]) for c in ("head", "http", "payload", "record"))
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:-2])
        block = record[len(head):-4]
        assert record.startswith(b"WARC/1.1\r\n") and head.endswith(b"\r\n\r\n") and record.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(block) and fields["WARC-Type"] == r["type"]
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert block == http + (b"" if r["type"] == "revisit" else payload)
        assert ("WARC-Refers-To" in fields) == (r["type"] == "revisit")
    names = {bytes(r["head"]).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for r in got if r["type"] == "response"}
    assert len(names) == 4  # one response per content
    refers = [bytes(r["head"]).split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] for r in got if r["type"] == "revisit"]
    assert len(refers) == 5 and set(refers) <= names
    assert sorted((r["id"] or 0, r["refers_to"]) for r in got if r["type"] == "revisit") == [(0, 7), (1, 7), (2, 2), (5, 7), (8, 9)]


def test_small_payloads_are_responses(spark, pages_of, scratch):  # noqa: F811
    got = W.read_archive(W.write_archive(pages_of(ROWS), scratch, least=11)).collect()
    assert {r["type"] for r in got if r["bytes"] < 11} == {"response"}
    assert [r["refers_to"] for r in got if r["type"] == "revisit"] == [2]  # the two of 12 bytes


def test_a_hot_payload_and_no_pages(spark, pages_of, scratch):  # noqa: F811
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(300)]
    got = W.read_archive(W.write_archive(pages_of(rows, 8), scratch), hot_records=20)
    assert got.count() == 300 and got.where("type = 'revisit'").select("refers_to").distinct().collect()[0][0] == 299
    none = pages_of([(1, "u", "h")]).where("page_id < 0")
    assert W.read_archive(W.write_archive(none, scratch)).count() == 0


def test_a_changed_or_lost_payload_fails(spark, pages_of, scratch):  # noqa: F811
    archive = W.write_archive(pages_of(ROWS[:3]), scratch)
    changed = archive.payloads.withColumn("payload", F.concat("payload", F.lit(b" ")))
    for payloads in (changed, archive.payloads.limit(0)):
        with pytest.raises(Exception, match="doesn't fit"):
            W.read_archive(W.Archive(archive.heads, payloads)).select("sha1").collect()


def test_two_runs_on_one_scratch_folder_and_rows_from_memory(spark, scratch):  # noqa: F811
    df = spark.createDataFrame([(1, "u", "h"), (2, "u", "h")], "page_id bigint, url string, html string")
    for _ in range(2):
        got = W.read_archive(W.write_archive(df, scratch)).select("id", "type", "refers_to").collect()
        assert sorted(tuple(r) for r in got) == [(1, "revisit", 2), (2, "response", None)]

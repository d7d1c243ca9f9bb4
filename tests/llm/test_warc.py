"""Archives: what is in the files, revisits on odd rows, and the whole round trip against a plain version."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from rillspark.llm import warc

SCHEMA = "extra string, page_id long, url string, html string, digest string, part int"


def plain(rows):
    """(payload_bytes, digest, type, refers_to) of each row, in order."""
    last = {}
    for r in rows:
        body = (r[3] or "").encode()
        if len(body) >= 1000 and r[1] is not None:
            last[body] = max(last.get(body, r[1]), r[1])
    out = []
    for r in rows:
        body = (r[3] or "").encode()
        first = last.get(body)
        revisit = first is not None and first != r[1]
        out.append((r[1], len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def odd_rows():
    long, other = "<p>é \r\n\r\n WARC/1.1\r\n" * 60, "x" * 999 + "y"
    texts = [(1, "http://a/ b\r\nX: y", long), (5, "http://a/5", long), (3, None, long), (5, "http://a/5", long), (None, "  ", long), (7, "http://ü/", ""), (8, "u", None), (9, "u", "x" * 999), (10, "u", "x" * 999)]
    texts += [(11, "u", other), (12, "u", other), (-4, "u", other), (None, None, "z" * 2000), (None, "v", "z" * 2000), (20, "w", "0" * 3_000_000), (21, "w", "0" * 3_000_000), (22, "w", "\x00a\n\n" * 300)]
    return [("e", i, url, html, "d", 3) for i, url, html in texts]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/archives"


def test_round_trip_on_odd_rows(spark):
    rows = odd_rows()
    found = [tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(found, key=order) == sorted(plain(rows), key=order)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files(spark, folder):
    """Every record is a gzip member; heads name what they should; payloads stand once."""
    rows = odd_rows()
    n = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(2), folder, most_bytes=2000)
    names = [f for f in os.listdir(folder[7:]) if f.endswith(".warc.gz")]
    assert len(names) == n > 2
    seen, kinds = {}, []
    for name in names:
        with open(f"{folder[7:]}/{name}", "rb") as f:
            found = list(warc.records(io.BufferedReader(gzip.GzipFile(fileobj=f))))
        assert found[0][0]["warc-type"] == "warcinfo" and found[0][0]["warc-filename"] == name
        for fields, block in found[1:]:
            kinds.append(fields["warc-type"])
            seen[fields["warc-record-id"]] = (fields, block)
            assert "\n" not in fields["warc-target-uri"] and " " not in fields["warc-target-uri"]
    assert sorted(kinds) == sorted(r[3] for r in plain(rows))
    for fields, block in seen.values():
        if fields["warc-type"] == "revisit":
            first, body = seen[fields["warc-refers-to"]]
            assert fields["warc-profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n") and warc.payload(fields, block) == b""
            assert first["warc-payload-digest"] == fields["warc-payload-digest"] and first["warc-type"] == "response"
            assert first["warc-target-uri"] == fields["warc-refers-to-target-uri"] and first["warc-date"] == fields["warc-refers-to-date"]
            assert base64.b32decode(first["warc-payload-digest"][5:]) == hashlib.sha1(warc.payload(first, body)).digest()
    with_text = warc.read(spark, folder, with_payload=True).where("record_type = 'response'").select("id", F.decode("payload", "UTF-8").alias("html")).collect()
    assert {(r.id, r.html) for r in with_text} <= {(None if r[1] is None else str(r[1]), r[3] or "") for r in rows}


def test_broken_archives(spark, folder):
    warc.write(spark.createDataFrame(odd_rows(), SCHEMA).coalesce(1), folder)
    (name,) = [f for f in os.listdir(folder[7:]) if f.endswith(".warc.gz")]
    plain_bytes = gzip.decompress(open(f"{folder[7:]}/{name}", "rb").read())
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records(io.BytesIO(plain_bytes[:-500])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n")))
    os.makedirs(f"{folder[7:]}/changed")
    with open(f"{folder[7:]}/changed/a.warc", "wb") as f:
        f.write(plain_bytes.replace(b"zzzz", b"zzzy", 1))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark, f"{folder}/changed").collect()


def test_lost_attempts_do_not_count(spark, folder):
    """A file that no task's result names is gone after the write."""
    warc._opened(folder)
    with open(f"{folder[7:]}/lost.warc.gz", "wb") as f:
        f.write(b"half")
    n = warc.write(spark.createDataFrame(odd_rows(), SCHEMA), folder)
    assert len([f for f in os.listdir(folder[7:]) if f.endswith(".gz")]) == n


def test_only_headers_are_shuffled(spark, sf_dir):
    """No exchange below the copying of payloads holds a body."""
    index = spark.createDataFrame([], warc.INDEX)
    plan = warc.resolved(index)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(digest" in plan and "SortMergeJoin" in plan and "body" not in plan

import hashlib
import random

import pytest

from ledgercheck.llm import archive

SCHEMA = "page_id long, url string, html string, record_no string, payload_key string, sha1 string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def expected(rows, least=1000):
    """page_id, bytes, digest, type, refers_to of every row, by hand."""
    out = []
    best = {}
    for i, (page, url, html) in enumerate(rows):
        key = (page is not None, page or 0, url is not None, url or "", -i)
        best[html or ""] = max(best.get(html or "", key), key)
    for i, (page, url, html) in enumerate(rows):
        data = (html or "").encode()
        top = best[html or ""]
        revisit = len(data) >= least and -top[-1] != i
        out.append((page, len(data), hashlib.sha1(data).hexdigest(),
                    "revisit" if revisit else "response",
                    rows[-top[-1]][0] if revisit else None))
    return out


def some_rows(seed=1, n=300):
    rng = random.Random(seed)
    pool = ["é" * 500, "a" * 999, "b" * 1000, None, "", "日本" * 400, "x\r\n\r\nWARC/1.1\r\n" * 90]
    return [(rng.choice((i, i, i // 3, None)), rng.choice((None, "", f"http://h/{i}", "http://a b\r\n%")),
             rng.choice(pool) if i % 3 else f"<p>{i}</p>" * 200) for i in range(n)]


def test_equals_plain_python(spark):
    rows = some_rows()
    store = archive.store(frame(spark, rows).coalesce(1))
    got = archive.read(store).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                     "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(rows), key=repr)


def test_payloads_once_and_exact_records(spark):
    rows = some_rows(2)
    store = archive.store(frame(spark, rows))
    payloads = {r["payload_key"]: bytes(r["payload"]) for r in store.payloads.collect()}
    assert set(payloads.values()) == {(r[2] or "").encode() for r in rows}
    assert all(hashlib.sha256(v).hexdigest() == k for k, v in payloads.items())
    records = archive.restore(store).collect()
    headers = {r["record_no"]: (bytes(r["header"]), r["payload_key"])
               for r in store.headers.collect()}
    assert len(records) == len(rows) == len(headers)
    for r in records:
        header, key = headers[r["record_no"]]
        data = bytes(r["record"])
        lines = dict(x.split(": ", 1) for x in header.decode().split("\r\n")[1:] if x)
        assert data.startswith(header) and header.endswith(b"\r\n\r\n")
        assert header.count(b"\r\n\r\n") == 1 and header.startswith(b"WARC/1.1\r\n")
        block = data[len(header):-4]
        assert len(block) == int(lines["Content-Length"])
        assert data.endswith(b"\r\n\r\n")
        assert block == (b"" if lines["WARC-Type"] == "revisit" else payloads[key])


def test_damage_is_found(spark):
    from pyspark.sql import functions as F

    store = archive.store(frame(spark, some_rows(3, 40)))
    bent = archive.Archive(store.headers, store.payloads.withColumn(
        "payload", F.concat("payload", F.lit(b"!"))))
    with pytest.raises(Exception, match="damaged record"):
        archive.read(bent).collect()


@pytest.mark.parametrize("rows", [
    [], [(None, None, None)] * 3, [(1, "u", "z" * 2_000_000)] * 2 + [(None, "u", "z" * 2_000_000)]])
def test_awkward_rows(spark, rows):
    got = archive.read(archive.store(frame(spark, rows).coalesce(1))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(rows), key=repr)

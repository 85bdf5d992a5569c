import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from triagelens.llm import warc_archive as W
from triagelens.session import scratch_path

LONG, HOT = "ü" * 700, "<p>hot</p>" * 120
SCHEMA = "page_id long, url string, html string, id string, header string, digest string, copies string, payload string"


def rows():
    html = {0: None, 1: "", 2: "x" * 999, 3: "x" * 999, 4: "y" * 1000, 5: "y" * 1000, 6: "y" * 1000, 7: LONG, 8: LONG,
            9: "é" * 200_000, 10: "a\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n", 11: "\u0000  z" * 400}
    out = [(i, f"http://h/{i}", h) for i, h in html.items()]
    out += [(12, "http://h/a\r\nWARC-Type: fake\r\n", "q" * 1200), (13, None, "q" * 1200), (-4, "u", "q" * 1200)]
    out += [(100 + i, f"u{i}", HOT) for i in range(90)]
    out += [(None, "no id", HOT), out[-1], (6, "again", "y" * 1000)]
    return [(*r, "i", "h", "d", "c", "p") for r in out]


def brute(table):
    data = [(i, (h or "").encode()) for i, _, h, *_ in table]
    top = {}
    for i, b in data:
        if i is not None:
            top[b] = max(top.get(b, i), i)
    out = []
    for i, b in data:
        again = i is not None and len(b) >= 1000 and i < top[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None))
    return sorted(out, key=str)


def shown(df):
    got = df.select("id", F.octet_length("payload").alias("n"), F.sha1("payload").alias("s"), "record_type", "refers_to")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.fixture(scope="module")
def archive(llm):
    path = scratch_path(llm, "warc")
    W.write(llm.createDataFrame(rows(), SCHEMA).repartition(5), path)
    return path


def test_records_come_back_whole(llm, archive):
    back = W.read_back(llm, archive)
    assert shown(back) == brute(rows())
    stored = llm.read.parquet(f"{archive}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == len({r[2] or "" for r in rows()})
    uris = {r.id: r.target_uri for r in back.collect()}
    assert uris[12] == "http://h/a%0D%0AWARC-Type: fake%0D%0A" and uris[13] is None


def test_hot_payload_is_salted(llm, monkeypatch):
    monkeypatch.setattr(W, "PER_SALT", 7)
    path = scratch_path(llm, "warc")
    W.write(llm.createDataFrame(rows(), SCHEMA).repartition(5), path)
    assert shown(W.read_back(llm, path)) == brute(rows())


def test_warc_files_round_trip(llm, archive):
    back = W.read_back(llm, archive)
    out = scratch_path(llm, "warc-files")
    W.export(back, out, per_file=20)
    files = W.read_warc(llm, out)
    assert files.count() == len(rows())
    want = {(r.id, r.record_type, r.refers_to, bytes(r.record)) for r in back.collect()}
    assert {(r.id, r.record_type, r.refers_to, r.header.encode() + bytes(r.block)) for r in files.collect()} == want


def test_damage_is_found(llm, archive):
    path = scratch_path(llm, "warc")
    bad = F.when(F.col("n_bytes") == 1000, F.lit(b"other")).otherwise(F.col("payload"))
    llm.read.parquet(f"{archive}/payloads").withColumn("payload", bad).write.parquet(f"{path}/payloads")
    llm.read.parquet(f"{archive}/headers").write.parquet(f"{path}/headers")
    with pytest.raises(PySparkException, match="differs from its digest"):
        W.read_back(llm, path).collect()
    path = scratch_path(llm, "warc")
    llm.read.parquet(f"{archive}/payloads").write.parquet(f"{path}/payloads")
    cut = F.replace("header", F.lit("Content-Length: "), F.lit("Content-Length: 1"))
    llm.read.parquet(f"{archive}/headers").withColumn("header", cut).write.parquet(f"{path}/headers")
    with pytest.raises(PySparkException, match="differs from its header"):
        W.read_back(llm, path).collect()


def test_empty_table(llm):
    path = scratch_path(llm, "warc")
    W.write(llm.createDataFrame([], SCHEMA), path)
    assert W.read_back(llm, path).count() == 0

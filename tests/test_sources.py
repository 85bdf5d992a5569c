"""CSV by column name, id sets over unlike files, stored pool and events, JSON summary, long threads."""

import csv
import gzip
import io
import json
import os
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from triagelens.functions.difficulty import score_frame
from triagelens.functions.lexicon import REFERENCE
from triagelens.operators import threads as T
from triagelens.session import scratch_path
from triagelens.sources import sinks as K
from triagelens.sources.adapters import messages_from_conversations
from triagelens.sources import csv_records as CR
from triagelens.sources.readers import cast_failures, read_csv, read_id_sets, read_stage_table, scan_ledger
from triagelens.sources.schemas import MESSAGES

IDS_X = StructType([StructField("message_id", LongType()), StructField("x", StringType())])
IDS = StructType([StructField("message_id", LongType())])


def test_columns_by_name_extra_and_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('created_at,text,tweet_id,inbound\nnow,"x, ""y""\nz",7,True\n,,8,maybe\n')
    (tmp_path / "b.csv").write_text("tweet_id,author_id,inbound,text,in_response_to_tweet_id\n9,me,False,hi,7\n")
    rows = {r.tweet_id: r for r in read_csv(spark, f"{tmp_path}/*.csv", MESSAGES).collect()}
    assert rows[7].text == 'x, "y"\nz' and rows[7].inbound is True and rows[7].in_response_to_tweet_id is None
    assert rows[8].text is None and rows[8].inbound is None
    assert (rows[9].author_id, rows[9].in_response_to_tweet_id) == ("me", 7)
    assert read_csv(spark, f"{tmp_path}/*.csv", MESSAGES, ["text"]).columns == ["text"]


def test_id_sets_skip_unreadable_files(spark, tmp_path):
    (tmp_path / "golden_set_1.csv").write_text("message_id,x\n1,a\n2,b\n")
    (tmp_path / "golden_set_2.csv").write_text("x,message_id\na,2\nb,3\nc,oops\n")
    (tmp_path / "golden_set_3.csv").write_text("nothing,here\n5,5\n")
    (tmp_path / "golden_set_4.csv").write_bytes(b"")
    assert {r.message_id for r in read_id_sets(spark, f"{tmp_path}/golden_set*.csv", IDS).collect()} == {1, 2, 3}
    ledger = {r.path[-5]: (r.status, r.n_records, r.n_failed)
              for r in scan_ledger(spark, f"{tmp_path}/golden_set*.csv", IDS, ("message_id",)).collect()}
    assert ledger == {"1": ("read", 2, 0), "2": ("read", 3, 1), "3": ("columns missing", 0, 0)}
    assert read_id_sets(spark, f"{tmp_path}/none*.csv", IDS).count() == 0


def test_damaged_files_fail_unless_told_otherwise(spark, tmp_path):
    whole = gzip.compress(("message_id,x\n" + "".join(f"{i},{i * 7919 % 1000003}\n" for i in range(50_000))).encode())
    (tmp_path / "golden_set_1.csv").write_text("message_id,x\n-1,a\n")
    (tmp_path / "golden_set_2.csv.gz").write_bytes(whole[:len(whole) // 2])
    with pytest.raises(Exception, match="(?i)failed_read_file|unexpected end|EOF"):
        read_csv(spark, f"{tmp_path}/golden_set_2*", IDS_X).count()
    got = {r.message_id for r in read_id_sets(spark, f"{tmp_path}/golden_set*", IDS).collect()}
    assert -1 in got and len(got) < 50_001
    ledger = {r.path.split("golden_set_")[1]: r for r in scan_ledger(spark, f"{tmp_path}/golden_set*", IDS).collect()}
    assert ledger["1.csv"].status == "read" and ledger["2.csv.gz"].status == "damaged"
    assert ledger["2.csv.gz"].n_records == len(got) - 1


def test_records_at_every_cut(spark, tmp_path):
    """Ranges of every size from a few bytes on give the rows of Python's csv module, however long a record."""
    rnd = random.Random(5)
    cell = lambda: "".join(rnd.choice(['a', 'é', ' ', ',', '"', '\n', '\r\n', '""', 'long cell ' * 4]) for _ in range(rnd.randint(0, 6)))
    rows = [(str(i), cell() + "x", cell() + "y") for i in range(60)] + [("60", "line\n" * 300 + "end", "z")]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\r\n")
        w.writerow(["message_id", "x", "y"])
        w.writerows(rows)
        f.write('61,"five"" tape",a 5" pipe\n\n62,b,5" by 6"\n')  # stray quotes, a blank line
    want = {int(i): (x, y) for i, x, y in rows} | {61: ('five" tape', 'a 5" pipe'), 62: ("b", '5" by 6"')}
    schema = StructType([StructField("message_id", LongType()), StructField("x", StringType()), StructField("y", StringType())])
    size = os.path.getsize(tmp_path / "a.csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for cut in (size + 1, 977, 251, 64):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
            for bound, rows_broadcast in ((1 << 20, 1 << 20), (40, 0)):
                recs, layouts, _ = CR.records(spark, str(tmp_path), bound=bound, broadcast_rows=rows_broadcast)
                got = [next(csv.reader(io.StringIO(r.value, newline=""))) for r in recs.collect()]
                assert layouts == [("message_id", "x", "y")]
                assert {int(i): (x, y) for i, x, y in got} == want and len(got) == len(want), (cut, bound)
            read = {r.message_id: (r.x, r.y) for r in read_csv(spark, f"{tmp_path}/a.csv", schema).collect()}
            flat = lambda t: tuple(c.replace("\r\n", "\n") for c in t)
            assert {k: flat(v) for k, v in read.items()} == {k: flat(v) for k, v in want.items()}, cut
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@given(st.text(alphabet='ab",', max_size=14), st.booleans())
def test_a_lines_function(line, inside):
    """The state after a line equals a walk over its characters, cell by cell."""
    state, begin, i = ("in" if inside else "begin"), True, 0
    while i < len(line):
        c = line[i]
        if state == "in":
            if c == '"' and line[i + 1:i + 2] == '"':
                i += 1
            elif c == '"':
                state = "out"
        elif c == ",":
            state = "begin"
        elif state == "begin":
            state = "in" if c == '"' else "out"
        i += 1
    assert CR.ends_inside(line, inside) == (state == "in")


def test_cast_failures_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("message_id,x\n1,7\noops,8\n,nine\n")
    schema = StructType([StructField("message_id", LongType()), StructField("x", LongType()), StructField("gone", LongType())])
    rows = {r.column_name: (r.n_rows, r.n_filled, r.n_failed) for r in cast_failures(spark, f"{tmp_path}/*.csv", schema).collect()}
    assert rows == {"message_id": (3, 2, 1), "x": (3, 3, 1), "gone": (3, 0, 0)}


def test_json_summary_and_missing_stage_table(spark):
    path = scratch_path(spark, "summary")
    got = K.write_json_summary(spark.createDataFrame([(0.5, 3)], "accuracy double, n long"), path)
    back = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert back == [got] == [{"accuracy": 0.5, "n": 3}]
    assert read_stage_table(spark, f"{path}-none", IDS).count() == 0


def test_long_conversations_keep_apart(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c}/{t}") for c in (1, 2) for t in range(1503)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = T.thread_pairs(messages_from_conversations(conv), "assistant").collect()
    assert len(pairs) == 2 * 751
    for p in pairs:
        c, t = p.brand_reply.split("/")
        assert p.cust_text == f"{c}/{int(t) - 1}"


def test_links_one_to_many_null_dangling(spark):
    rows = [("m", "cust", True, "help", None), ("r1", "brand", False, "a", "m"), ("r2", "brand", False, "b", "m"),
            ("r3", "brand", False, "c", "gone"), ("r4", "brand", False, "d", None), ("r5", "brand", False, "e", "r1"),
            ("n", "cust", None, "hm", None), ("r6", "brand", False, "f", "n"), ("r7", "brand", None, "g", "m")]
    df = spark.createDataFrame(rows, "tweet_id string, author_id string, inbound boolean, text string, in_response_to_tweet_id string")
    pairs = {(p.reply_tweet_id, p.cust_tweet_id) for p in T.thread_pairs(df, "brand").collect()}
    assert pairs == {("r1", "m"), ("r2", "m"), ("r5", "r1"), ("r6", "n")}
    flagged = {p.reply_tweet_id: p.mis_threaded for p in T.mis_threaded(T.thread_pairs(df, "brand")).collect()}
    assert flagged == {"r1": False, "r2": False, "r5": True, "r6": True}


def test_null_text_has_no_bucket(spark):
    df = spark.createDataFrame([(None,), ("help",)], StructType([StructField("text", StringType())]))
    rows = score_frame(df, "text", REFERENCE).collect()
    assert rows[0].difficulty_score is None and rows[0].difficulty_bucket is None and rows[1].difficulty_bucket
    assert df.select(F.col("text")).where("text is null").count() == 1

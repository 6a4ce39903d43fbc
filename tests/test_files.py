"""Readers, writers, streams, trees and codecs on small inputs."""

import gzip
import json
import struct

from pyspark.sql import functions as F

from sievecraft.functions import codecs as C
from sievecraft.operators import trees
from sievecraft.operators import windows as O
from sievecraft.sources import files, sinks
from sievecraft.streaming import live


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json_forms(spark, tmp_path):
    data = [{"id": "a", "n": 1}, {"id": "b", "n": 2}, {"id": "a", "n": 3}]
    (tmp_path / "x.json").write_text(json.dumps(data))
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, data)))
    with gzip.open(tmp_path / "e7.json.gz", "wt") as f:
        json.dump(data[:1], f)
    schema = "id string, n long"
    want = [("a", 1), ("a", 3), ("b", 2)]
    assert rows(files.json_array(spark, str(tmp_path / "x.json"), schema)) == want
    lines = files.json_lines(spark, str(tmp_path / "x.jsonl"), schema)
    assert rows(lines) == want
    assert rows(files.keyed(lines, "id", F.col("n"))) == [("a", 3), ("b", 2)]
    assert rows(files.episodes(spark, str(tmp_path / "e7.json.gz"), schema)) == [("a", 1, "e7")]
    assert rows(files.union_of([lines, spark.range(1).select(F.lit("z").alias("id"))]).where("id = 'z'")) == [("z", None)]
    assert rows(files.of_split(lines, spark.createDataFrame([("b",), ("b",)], "id string"), "id")) == [("b", 2)]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"1\n2",b\n')
    (tmp_path / "a.tsv").write_text("x\ty\n1\tb c\n")
    assert rows(files.delimited(spark, str(tmp_path / "a.csv"), ["p", "q"])) == [("1\n2", "b")]
    assert rows(files.delimited(spark, str(tmp_path / "a.tsv"), ["p"], tab=True)) == [("1",)]


def test_sidecar_xml_and_texts(spark, tmp_path):
    spark.createDataFrame([(1, "p"), (2, "q")], "id long, v string").write.parquet(str(tmp_path / "t"))
    (tmp_path / "s.jsonl").write_text('{"id": 2, "w": "x"}\n')
    assert rows(files.with_sidecar(spark, str(tmp_path / "t"), str(tmp_path / "s.jsonl"), "id", "id long, w string")) == [(2, "q", "x")]
    (tmp_path / "u.xml").write_text('<hierarchy><node class="Button" text="Save"/><node class="Text" text="a"/></hierarchy>')
    found = files.xml_nodes(spark, str(tmp_path / "u.xml"), "node", "_class string, _text string")
    assert rows(found) == [("Button", "Save"), ("Text", "a")]
    assert files.whole_texts(spark, str(tmp_path / "u.xml")).first().text.startswith("<hierarchy>")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(files.repaired_xml(F.lit("a & b &amp; \x01c"))) == "a &amp; b &amp; c"
    assert one(files.string_list(F.lit("(1, 2.5)"))) == [1.0, 2.5]
    assert one(files.string_list(F.lit("['a', 'b']"), "array<string>")) == ["a", "b"]
    assert one(files.string_list(F.lit("__import__"))) is None


def test_image_sizes_and_records(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480))
    (tmp_path / "img/b.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 300, 7))
    (tmp_path / "img/c.txt").write_bytes(b"no")
    found = files.image_sizes(spark, str(tmp_path / "img")).select("width", "height").collect()
    assert {tuple(r) for r in found} == {(640, 480), (300, 7), (None, None)}
    (tmp_path / "rec").mkdir()
    body = b"".join(struct.pack("<Q", len(p)) + b"crc_" + p + b"crc_" for p in (b"one", b"", b"three"))
    (tmp_path / "rec/a").write_bytes(gzip.compress(body + b"\x09cut"))
    (tmp_path / "rec/b").write_bytes(body)
    assert [tuple(r) for r in files.records(spark, str(tmp_path / "rec/*")).orderBy("path", "position").select("position", "payload").collect()] == [(0, b"one"), (1, b""), (2, b"three")] * 2


def test_sinks(spark, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([(i, "bad" if i % 3 == 0 else None, i % 2) for i in range(12)], "id long, reject_reason string, chunk int")
    sinks.sample_set(df, at + "/set", "id", [F.count("*").alias("n")], 5)
    assert spark.read.json(at + "/set/info").first().n == 12 and spark.read.json(at + "/set/sample").count() == 5
    sinks.chunks(df, at + "/chunks", "chunk")
    sinks.chunks(df.where("chunk = 1 and id < 4"), at + "/chunks", "chunk")
    assert rows(sinks.chunk_totals(spark, at + "/chunks", ["chunk"], ["id"])) == [(0, 30), (1, 4)]
    sinks.split_by_status(df, at + "/split")
    assert rows(spark.read.parquet(at + "/split").groupBy("part").count()) == [("kept", 8), ("rejected", 4)]
    for _ in range(2):
        sinks.append_rejects(df, at + "/rejects", "id")
    assert sinks.without_known(df, spark.read.parquet(at + "/rejects"), "id").count() == 8
    sinks.report(df.agg(F.count("*").alias("n")), df, {"model": "m"}, at + "/report")
    assert spark.read.json(at + "/report/metrics").first().model == "m"
    sinks.json_lines(df, at + "/lines", gzip=True)
    assert spark.read.json(at + "/lines").count() == 12


def test_ingestion_takes_each_file_once(spark, tmp_path):
    at = str(tmp_path)
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"id": i}))
        live.ingest_new(spark, at + "/in", "id long", at + "/out", at + "/mark", lambda d: d.where("id <> 1")).awaitTermination()
    assert rows(spark.read.parquet(at + "/out")) == [(0,), (2,)]
    assert rows(live.remaining(spark.range(4), spark.range(2), "id")) == [(2,), (3,)]


def test_silence_and_sessions(spark):
    beats = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:20"), ("b", "2024-01-01 00:01:00")], "worker string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.worker, r.expired) for r in live.silent(live.last_beats(beats)).collect()} == {("a", True), ("b", False)}
    events = beats.select(F.col("worker").alias("user_id"), "ts", F.lit("x").alias("event_type"))
    assert rows(live.episode_sessions(events, "10 seconds").select("user_id", "steps")) == [("a", 1), ("a", 1), ("b", 1)]


def test_trees(spark):
    t = [("p", 1, None, "N"), ("p", 2, 1, "N"), ("p", 3, 2, "R"), ("p", 4, 2, "A"), ("p", 5, 3, "A"), ("q", 9, 8, None), ("q", 7, 9, "R"), ("c", 1, 2, "A"), ("c", 2, 1, "A")]
    df = spark.createDataFrame(t, "t string, n long, up long, x string")
    assert [(r.t, r.line) for r in trees.outline(df, "t", "n", "up", "x").orderBy("t", "position").collect()] == [("p", "N"), ("p", "\tN"), ("p", "\t\tR"), ("p", "\t\t\tA"), ("p", "\t\tA"), ("q", ""), ("q", "\tR")]
    flat = {(r.t, r.node): r.up for r in trees.without_wrappers(df, "t", "n", "up", "x", "N").collect()}
    assert flat == {("p", 2): None, ("p", 3): 2, ("p", 4): 2, ("p", 5): 3, ("q", 9): None, ("q", 7): 9}
    near = {(r.t, r.node): r.why for r in trees.with_relatives(df, "t", "n", "up", "x", "R").collect()}
    assert near == {("p", 3): "candidate", ("p", 2): "ancestor", ("p", 1): "ancestor", ("p", 5): "child", ("p", 4): "sibling", ("q", 7): "candidate", ("q", 9): "ancestor"}
    assert trees.outline(df.limit(0), "t", "n", "up", "x").count() == 0


def test_codecs(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    act = lambda s: tuple(one(C.script_action(F.lit(s))))
    assert act("pyautogui.rightClick(3, 4)") == ("right_click", 3, 4, None, None)
    assert act("pyautogui.hscroll(-5)") == ("scroll", None, None, None, "left")
    assert act('pyautogui.write("a (1)")') == ("input_text", None, None, "a (1)", None)
    assert act("import os") == (None, None, None, None, None)
    assert one(C.last_steps(F.lit("Step 1. a Step 2. b c Step 3. d"), 2)) == "Step 2. b c Step 3. d"
    assert one(C.last_steps(F.lit(""), 2)) == ""
    assert one(C.hotkey(F.lit("Shift + Ctrl+c"))) == "c+ctrl+shift"
    words = lambda s: F.filter(F.split(F.lit(s), " "), lambda w: w != "")
    assert one(C.bag_f1(words("a a b"), words("a b b"))) == 2 / 3
    assert one(C.bag_f1(words(""), words(""))) == 1.0


def test_ranks_by_blocks_equal_a_sort(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    found = {r.id: r.rank for r in O.ranked(df, ["g"], O.hash_rank("s", "id")).collect()}
    for g in range(3):
        ids = [r.id for r in df.where(f"g = {g}").orderBy(O.hash_rank("s", "id")).collect()]
        assert [found[i] for i in ids] == list(range(1, len(ids) + 1))

"""Readers, writers and the stream."""

import json

import pandas as pd
from pyspark.sql import functions as F

from corpuslens.sources import files, sinks
from corpuslens.streaming import rate


def test_xml_and_json_texts(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<q><sura index="1" name="A"><aya index="1" text="aa bb"/><aya index="2" text="cc"/></sura></q>')
    p = files.read_xml(spark, str(tmp_path / "t.xml"))
    assert [(r.pid, r.text, r.grp_name) for r in p.orderBy("pid").collect()] == [("1:1", "aa bb", "A"), ("1:2", "cc", "A")]
    assert files.check_counts(p, 1, 2).first().ok and not files.check_counts(p, 1, 3).first().ok
    (tmp_path / "t.json").write_text(json.dumps([{"id": 1, "name": "A", "total_verses": 1, "verses": [{"id": 1, "text": "aa"}]}]))
    assert files.read_json_text(spark, str(tmp_path / "t.json")).first().pid == "1:1"
    assert files.read_optional_json(spark, str(tmp_path / "none.json"), "a string").count() == 0


def test_segments(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# note\nLOCATION\tFORM\tTAG\tFEATURES\n(1:1:1:1)\tbi\tP\tPREF\n1:1:1:2\tsm\tN\tROOT:smw\n")
    rows = files.read_segments(spark, str(tmp_path / "m.tsv")).orderBy("seg").collect()
    assert [(r.pid, r.word, r.seg, r.form, r.features) for r in rows] == [("1:1", 1, 1, "bi", "PREF"), ("1:1", 1, 2, "sm", "ROOT:smw")]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "d.txt").write_text("#META# 010.BookTITLE :: Lex\n#META# 020.AuthorNAME :: NODATA\nPageV01P002\n# كتب\n# first words here.\n~~ more PageV01P003\n# درس\n# second entry text\n# كتب\n# again again\n")
    lines = files.read_lines(spark, str(tmp_path / "d.txt"))
    got = {r.root: r for r in files.dictionary_entries(lines, "bare").collect()}
    assert got["كتب"].full == "first words here. more" and (got["كتب"].cite.vol, got["كتب"].cite.page) == (1, 3)
    assert got["درس"].full == "second entry text" and len(got) == 2
    m = files.dictionary_meta(lines).first()
    assert m.title == "Lex" and m.author is None
    g = spark.createDataFrame([("to write a thing. more",), ("short; then much",), ("a b c",)], "x string").select(files.concise_gloss(F.col("x")), files.capped(F.col("x"), 5)).collect()
    assert [r[0] for r in g] == ["to write a thing", "short; then much", "a b c"] and g[2][1] == "a b c"
    assert files.provenance(spark, str(tmp_path / "d.txt")).first().bytes == (tmp_path / "d.txt").stat().st_size


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 'q"x')], "id long, ws array<string>, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().asDict() == {"id": "1", "ws": "a b", "t": 'q"x'}
    sinks.write_csv(df.coalesce(1), str(tmp_path / "s"), spreadsheet=True)
    assert next((tmp_path / "s").glob("*.csv")).read_bytes() == '\ufeffid,ws,t\r\n1,a b,"q""x"\r\n'.encode()
    roots = spark.createDataFrame([(r, i) for i, r in enumerate(["كتب", "قول", "نور"])], "root string, n int")
    sinks.write_shards(roots, str(tmp_path / "shards"), "root")
    read = sinks.read_shard(spark, str(tmp_path / "shards"), "root", "قول")
    assert [tuple(r) for r in read.collect()] == [("قول", 1)] and "shard" not in read.columns
    sinks.write_bundle(df, str(tmp_path / "b"), "m", {"k": "v"})
    assert spark.read.json(str(tmp_path / "b")).first().data.id == 1
    t = spark.createDataFrame([("1:1", 1, 1, i, w) for i, w in enumerate("a b c d".split())], "pid string, grp long, ord long, pos int, orig string")
    assert [(r.left, r.hit, r.right) for r in sinks.concordance(t, F.col("orig") == "c", 1).collect()] == [("b", "c", "d")]
    b = spark.range(1).select(sinks.bibtex(F.lit("T"), F.lit("A"), F.lit("1"), F.lit("k")), sinks.ris(F.lit("T"), F.lit("A"), F.lit("1"))).first()
    assert b[0].startswith("@book{k,") and b[1].endswith("ER  - ")


def brute(events, seconds, budget):
    out, start, n = {}, {}, {}
    for user, event, ts in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        if user not in start or ts >= start[user] + pd.Timedelta(seconds=seconds):
            start[user], n[user] = ts, 0
        n[user] += 1
        out[event] = (start[user], n[user], n[user] <= budget)
    return out


def test_rate_windows(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    events = [(u, 100 * u + i, base + pd.Timedelta(seconds=s)) for u in (1, 2) for i, s in enumerate([0, 5, 9, 10, 10, 21, 40, 41, 42])]
    want = brute(events, 10, 2)
    df = spark.createDataFrame([(u, e, t.to_pydatetime()) for u, e, t in events], "user_id long, event_id long, ts timestamp_ntz")
    assert {r.event_id: (pd.Timestamp(r.window_start), r.nth, r.allowed) for r in rate.rate_windows(df, 10, 2).collect()} == want
    later = spark.createDataFrame([(None, None, (base + pd.Timedelta(hours=2)).to_pydatetime())], df.schema)  # moves time past the others
    df.unionByName(later).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "e"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(str(tmp_path / "e"))
    q = rate.rate_stream(stream, 10, 2, "1 hour").writeStream.format("memory").queryName("rated").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: (r.nth, r.allowed) for r in spark.table("rated").collect()}
    assert got == {e: (n, a) for e, (_, n, a) in want.items()}


def test_lines_stay_where_they_are_read(spark, tmp_path):
    """Even where Spark broadcasts nothing by itself, no line is dealt out to be numbered or to meet its entry."""
    text = [f"#{i}" if i % 700 == 5 else f"line {i}" for i in range(3000)]
    (tmp_path / "t.txt").write_text("\n".join(text))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.open_entries(files.read_lines(spark, str(tmp_path / "t.txt")), F.col("value").startswith("#"))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan
        got = [(r.value, r.entry) for r in lines.orderBy("line").collect()]
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)
    assert got == [(w, None if i < 5 else (i - 5) // 700 * 700 + 5) for i, w in enumerate(text)]

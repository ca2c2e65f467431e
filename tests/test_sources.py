import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files as f
from tidemark.streaming import events as st


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a"
    p.mkdir()
    (p / "x.jsonl").write_text('{"chunk_id": "1", "speaker": null}\nbroken {\n{"chunk_id": "2", "extra": 5, "speaker": {"role": "ceo"}}\n')
    got = {r["chunk_id"]: r["speaker"] for r in f.read_jsonl(spark, str(p), f.CHUNK).collect()}
    assert set(got) == {"1", "2"} and got["2"]["role"] == "ceo"
    out = str(tmp_path / "b")
    f.write_jsonl(spark.createDataFrame([("1", None), ("2", "2024-01-01T00:00:00Z")], "k string, created_at string"), out)
    f.append_jsonl(spark.createDataFrame([("3", None)], "k string, created_at string"), out)
    rows = {r["k"]: r["created_at"] for r in spark.read.json(out).collect()}
    assert set(rows) == {"1", "2", "3"} and rows["3"] is not None


def test_lenient_json_column(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k"'), (3, None), (4, "{}")], "id int, j string")
    assert {r["id"]: r["parsed"]["k"] for r in f.parse_json(df, "j", "k int").collect()} == {1: 5, 4: None}


def test_texts_manifest_and_documents(spark, tmp_path):
    p = tmp_path / "t"
    p.mkdir()
    (p / "one.txt").write_text("line\n\nnext")
    (p / "two.txt").write_text("")
    assert "line\n\nnext" in {r["text"] for r in f.read_texts(spark, str(p)).collect()}
    m = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in f.manifest(spark, str(p), "s", "text").collect()}
    assert m == {"one.txt": hashlib.sha256(b"line\n\nnext").hexdigest()}
    log = str(tmp_path / "log")
    for _ in range(2):
        f.append_manifest(f.manifest(spark, str(p), "s", "text"), log)
    assert spark.read.option("header", True).csv(log).count() == 2
    f.write_document(spark, str(tmp_path / "d"), {"params": {"depth": 3}, "names": ["a"]})
    assert f.read_document(spark, str(tmp_path / "d")) == {"params": {"depth": 3}, "names": ["a"]}


def test_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, s string")
    f.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, f.read_csv(spark, str(tmp_path / "c"), "n int, s string").collect())) == [(1, "a,b"), (2, None)]
    f.write_parquet(df, str(tmp_path / "p"), ["n"])
    assert spark.read.parquet(str(tmp_path / "p")).where("n = 1").first()["s"] == "a,b"


def test_new_union_latest_require(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (None,)], "k int")
    assert sorted(str(r["k"]) for r in f.new_only(a, b, "k").collect()) == ["1", "None"]
    u = f.union_tagged({"x": a, "y": b.withColumn("z", F.lit(1))})
    assert u.count() == 5 and u.where("_src = 'x' and z is null").count() == 3
    names = spark.createDataFrame([("m_2024-01.json",), ("m_2024-03.json",)], "n string")
    assert f.latest(names, "n").first()["n"] == "m_2024-03.json"
    with pytest.raises(ValueError, match="z"):
        f.require_columns(a, ["k", "z"])


def test_observations_and_bars(spark):
    page = '{"observations": [{"d": "2024-01-02", "S": {"v": "1.5"}}, {"d": "2024-01-03", "S": {"v": "n/a"}}, {"d": "2024-01-04"}, {"d": "x", "S": {"v": "2"}}]}'
    df = spark.createDataFrame([(page,), (None,), ("{}",)], "p string")
    assert [(str(r["date"]), r["series"], r["value"]) for r in f.observations(df, "p", "S").collect()] == [("2024-01-02", "S", 1.5)]
    raw = spark.createDataFrame([("2024-01-02", 1.0, 2.0, 0.5, 1.5, 1.4, 7)], "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume long")
    assert f.bars_from(raw, F.lit("T")).columns == ["date", "ticker", "open", "high", "low", "close", "adj_close", "volume"]


EVENTS = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 23:00:00", "a", 2.0), (3, "2024-01-02 01:00:00", "a", None), (4, "2024-01-02 00:30:00", "b", 9.0), (1, "2024-01-01 00:10:00", "a", 1.0), (5, None, "b", 1.0)]


@pytest.fixture
def folder(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "event_id long, ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    (tmp_path / "flat").mkdir()
    part = next((tmp_path / "events.parquet").glob("part-*.parquet"))
    part.rename(tmp_path / "flat" / "events.parquet")
    return str(tmp_path / "flat")


def test_streams(spark, folder):
    s = lambda: st.stream_of(spark, folder, "events")
    daily = {(str(r["start"])[:10], r["kind"]): (r["n"], r["total"]) for r in st.run(st.windowed(s(), "ts", "kind", "value", "1 day"), "complete").collect()}
    assert daily == {("2024-01-01", "a"): (3, 4.0), ("2024-01-02", "a"): (1, None), ("2024-01-02", "b"): (1, 9.0)}
    runs = {(r["kind"], r["n"]) for r in st.run(st.sessions(s(), "ts", "kind", "3 hours"), "complete").collect()}
    assert runs == {("a", 2), ("b", 1)}
    assert st.run(st.first_of(s(), "ts", ["event_id"])).count() == 4


def test_alerts_cool_down(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:00:00", "a", v) for h, v in enumerate([0, 9, 9, 0, 0, 9, 9, 0, 0])] + [("2024-01-03 00:00:00", "a", 9.0), ("2024-01-03 01:00:00", "a", 9.0)]
    df = spark.createDataFrame([(t, k, float(v)) for t, k, v in rows], "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "x"))
    (tmp_path / "flat").mkdir()
    next((tmp_path / "x").glob("part-*.parquet")).rename(tmp_path / "flat" / "events.parquet")
    got = st.run(st.alerts(st.stream_of(spark, str(tmp_path / "flat"), "events"), "kind", "ts", "value", rows=2, above=5.0, cooldown="1 day"))
    assert [str(r["ts"]) for r in got.orderBy("ts").collect()] == ["2024-01-01 02:00:00", "2024-01-03 01:00:00"]

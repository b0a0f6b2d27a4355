"""Sources, sinks and the streaming extension."""
from decimal import Decimal

from pyspark.sql import functions as F

from tests.tables import SF_SMALL
from haggle.operators import dialogue as D
from haggle.sources import fixtures as X
from haggle.sources import io
from haggle.streaming import stream as ST

SCHEMA = ("conv_id long, turn_no int, speaker int, utterance string, intent string, price decimal(12,2), "
          "items string, background_data string")


def test_dialogue_csv_roundtrip(spark):
    rows = [(1, 1, 0, 'multi\nline, "quoted"', "Greet-Ask", None, "a, b", "desc"),
            (1, 2, 1, "plain", "Tell_Price", Decimal("12.50"), "a", "desc")]
    df = spark.createDataFrame(rows, SCHEMA)
    path = io.scratch_path(spark, "test_csv")
    io.write_dialogues_csv(df, path)
    back = sorted(io.read_dialogues(spark, path).collect(), key=lambda r: r.turn_no)
    assert [tuple(r) for r in back] == rows


def test_catalog_roundtrip(spark):
    path = io.scratch_path(spark, "test_catalog")
    io.write_catalog_json(X.catalog_products(spark, SF_SMALL), X.accessory_variants(spark, SF_SMALL),
                          X.product_variants(spark, SF_SMALL), path)
    back = io.read_catalog(spark, path)
    assert back.count() == X.accessory_variants(spark, SF_SMALL).count()


def test_dialogue_csv_escaped_roundtrip(spark):
    rows = [(1, 1, 0, 'multi\nline, "quoted" \\n', "Greet-Ask", None, "a, b", "de\r\nsc"),
            (1, 2, 1, "plain", "Tell_Price", Decimal("12.50"), "a", "desc")]
    path = io.scratch_path(spark, "test_csv_escaped")
    io.write_dialogues_csv(spark.createDataFrame(rows, SCHEMA), path, escaped=True)
    back = sorted(io.read_dialogues(spark, path, "csv_escaped").collect(), key=lambda r: r.turn_no)
    assert [tuple(r) for r in back] == rows


def test_transcript(spark):
    import pytest
    rows = [(2, 2, "b2"), (1, 1, "a1\nsecond \\ line\t\\n"), (2, 1, "b1\r"), (1, 2, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn_no int, text string")
    path = io.scratch_path(spark, "test_transcript")
    io.write_transcript(df, path)
    lines = [r.value.split("\t")[:2] for r in spark.read.text(path).collect()]
    assert lines == [["1", "0"], ["1", "1"], ["1", "2"], ["2", "0"], ["2", "1"], ["2", "2"]]
    back = {(r.conv_id, r.line_no): r.text for r in io.read_transcript(spark, path).collect()}
    assert {k: v for k, v in back.items() if k[1]} == {(c, t): x for c, t, x in rows}
    assert back[(1, 0)] == "######conversation 1###############"
    with pytest.raises(Exception, match="already exists"):   # a re-run doesn't double the lines
        io.write_transcript(df, path)


def test_scratch_is_removed(spark):
    path = io.scratch_path(spark, "test_scratch")
    spark.range(3).write.parquet(path)
    assert io.clear_scratch(spark) > 0 and io.clear_scratch(spark) == 0
    import os
    assert not os.path.exists(path.replace("file:", ""))


def split_events(tmp_path, parts=3):
    """The events of the smallest table in several files, read one after another."""
    import os
    import pyarrow as pa
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF_SMALL}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    cut = [0, t.num_rows // parts, t.num_rows // 2, t.num_rows]
    for i, (a, b) in enumerate(zip(cut, cut[1:])):
        pq.write_table(pa.table(t.slice(a, b - a)), folder / f"part-{i}.parquet")
        os.utime(folder / f"part-{i}.parquet", (1_000_000 + 100 * i, 1_000_000 + 100 * i))
    return t.to_pylist()


def test_every_session_of_a_finite_stream(spark, tmp_path):
    """Row by row against a loop over the events, over several micro-batches, with each conversation's last session."""
    import datetime as dt
    sessions = {}
    for e in split_events(tmp_path):
        own = sessions.setdefault(e["user_id"], [])
        if not own or e["ts"] - own[-1][-1]["ts"] >= dt.timedelta(hours=6):
            own.append([])
        own[-1].append(e)
    events = lambda: ST.event_stream(spark, str(tmp_path))
    got = {(r.conv_id, r.session_start): (r.n, round(r.mean_reward, 9)) for r in
           ST.run_to_end(events(), ST.stream_mean_reward, "test_reward").collect()}
    assert got == {(c, s[0]["ts"]): (len(s), round(sum(e["value"] for e in s) / len(s), 9)) for c, own in sessions.items() for s in own}
    out = ST.run_to_end(events(), ST.stream_final_outcome, "test_outcome").collect()
    assert {(r.conv_id, r.session_start): (r.n, r.outcome) for r in out} == {
        (c, s[0]["ts"]): (len(s), "Accept" if s[-1]["event_id"] % 2 else "Reject") for c, own in sessions.items() for s in own}
    whole = ST.run_to_end(events(), ST.stream_window_stats, "test_windows").agg({"n": "sum"}).first()[0]
    assert whole == sum(len(s) for own in sessions.values() for s in own)


def test_stream_locf_over_several_files(spark, tmp_path):
    """State is carried from one micro-batch to the next."""
    split_events(tmp_path)
    got = ST.run_available_now(ST.stream_price_locf(ST.event_stream(spark, str(tmp_path))), "test_stream_files")
    batch = D.price_locf(X.nego(spark, SF_SMALL)).select("conv_id", "event_id", "price_filled")
    assert sorted(map(str, got.select("conv_id", "event_id", "price_filled").collect())) == sorted(map(str, batch.collect()))


def test_stream_locf_equals_batch(spark):
    got = ST.run_available_now(ST.stream_price_locf(ST.event_stream(spark, SF_SMALL)), "test_stream")
    batch = D.price_locf(X.nego(spark, SF_SMALL)).select("conv_id", "event_id", "price_filled")
    g = {(r.conv_id, r.event_id): r.price_filled for r in got.collect()}
    b = {(r.conv_id, r.event_id): r.price_filled for r in batch.collect()}
    assert g == b

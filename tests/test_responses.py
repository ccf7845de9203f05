"""Guarded paths of JSON, against plain Python."""

from pyspark.sql import functions as F

from tessera.operators import responses

ODD = {
    '{"candidates": [{"content": {"parts": [{"text": "a"}, {"text": 1}, {"text": null}, 3, {"text": "b\\u00e9"}]}}, {"content": 4}, 5, {"content": {"parts": {"text": "x"}}}, {"content": {"parts": [{"text": ""}, {"text": "c"}]}}]}': "abéc",
    '{"candidates": {"content": 1}}': "", '{"candidates": []}': "", "[]": "", "{bad": "", "5": "", '{"candidates": null}': "",
}


def test_texts_of_responses(spark):
    rows = spark.createDataFrame([*((b,) for b in ODD), (None,)], "b string")
    assert {r["b"]: r["t"] for r in rows.select("b", responses.response_text(F.col("b")).alias("t")).collect()} == ODD | {None: ""}
    frames = "".join(f"data: {b}\r\n\r\n" for b in ODD) + "event: x\ndata:{}\n"
    assert spark.createDataFrame([(frames,)], "f string").select(responses.stream_text(F.col("f")).alias("t")).first()["t"] == "abéc"


def test_records_by_path(spark):
    raw = ['[{"path": "a", "v": 1}, {"path": "b"}, {"path": "a", "v": 2}, {"path": ""}, {"path": 3}, 4]', "{}", "{bad", None, "[]"]
    found = [r["m"] for r in spark.createDataFrame([(n, x) for n, x in enumerate(raw)], "n int, x string").select("n", responses.records_by_path(F.col("x")).alias("m")).orderBy("n").collect()]
    assert found == [{"a": '{"path":"a","v":2}', "b": '{"path":"b"}'}, {}, {}, {}, {}]


def test_a_given_null_overwrites(spark):
    log = [(1, 1, '{"a": 1, "b": "x", "c": {"d": 2}}'), (1, 2, '{"a": null, "c": [1]}'), (1, 4, '{"b": "y"}'), (1, 3, '{"b": "z"}'), (1, 5, "[1]"), (2, 6, None), (2, 7, "{}")]
    rows = spark.createDataFrame(log, "k int, event_id long, body string").withColumn("ts", F.timestamp_seconds("event_id"))
    found = sorted((r["k"], r["field"], r["value"], r["updated_at"].second) for r in responses.merged_fields(rows, "k").collect())
    assert found == [(1, "a", "null", 5), (1, "b", '"y"', 5), (1, "c", "[1]", 5)]

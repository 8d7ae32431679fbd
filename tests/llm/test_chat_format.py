import json

from sigseg.llm.chat_format import chat_calls, link_tool_calls

SCHEMA = [("add", "x", "BIGINT", True), ("add", "y", "BIGINT", True), ("add", "note", "STRING", False), ("ping", "host", "STRING", True)]
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string, status string"
RESULTS = "conv_id long, call_id string, turn long, content string"


def test_links_orders_validates_and_serialises(spark):
    calls = [
        (1, "a", 5, "add", '{"y": 2, "x": 1}', None, ""),
        (1, "b", 2, "add", '{"x": "1", "z": 3}', "a", ""),
        (1, "c", 1, "ping", '{"host": "é\\n"}', "b", ""),
        (1, "d", 7, "nope", "{}", "gone", ""),
        (1, "e", 8, "add", "{broken", "f", ""),
        (1, "f", 9, "ping", None, "e", ""),
        (1, "a", 6, "ping", '{"host": "again"}', None, ""),
        (None, "a", 1, "ping", '{"host": "x"}', None, ""),
        (2, None, 1, "ping", '{"host": null}', None, ""),
    ]
    results = [(1, "a", 6, "3"), (1, "c", 3, None), (1, "zz", 4, "lost"), (None, "a", 2, "x")]
    got = {}
    for r in link_tool_calls(spark.createDataFrame(calls, CALLS).repartition(3), spark.createDataFrame(results, RESULTS), SCHEMA).collect():
        got.setdefault((r.conv_id, r.call_id, r.turn), []).append(r)
    assert sum(map(len, got.values())) == 11
    one = {k[1:]: v[0] for k, v in got.items() if k[0] == 1}
    assert {k: v.status for k, v in one.items()} == {("a", 5): "linked", ("a", 6): "duplicate", ("b", 2): "no_result", ("c", 1): "linked", ("d", 7): "no_result", ("e", 8): "no_result", ("f", 9): "no_result", ("zz", 4): "no_call"}
    assert {k[0]: v.depth for k, v in one.items() if v.status != "duplicate"} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "zz": None}
    assert one["b", 2].errors == ["x is not BIGINT", "y is missing", "z is unknown"]
    assert one["d", 7].errors == ["unknown function"]
    assert one["e", 8].errors == one["f", 9].errors == ["arguments are not JSON"]
    assert one["a", 5].valid
    assert one["a", 5].json == '{"arguments":{"x":1,"y":2},"call_id":"a","content":"3","depth":0,"errors":[],"name":"add","status":"linked","valid":true}'
    assert json.loads(one["c", 1].json)["arguments"] == {"host": "é\n"}
    assert {v.status for k, vs in got.items() if None in k[:2] for v in vs} == {"no_result", "no_call"}
    assert [v.errors for v in got[2, None, 1]] == [["host is missing"]]


def test_long_chain_and_empty(spark):
    n = 300
    calls = [(1, f"k{i}", n - i, "ping", '{"host": "h"}', f"k{i - 1}" if i else None, "") for i in range(n)]
    got = link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMA)
    assert {r.call_id: r.depth for r in got.collect()} == {f"k{i}": i for i in range(n)}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, call_id int")
    assert link_tool_calls(*chat_calls(empty), SCHEMA).count() == 0

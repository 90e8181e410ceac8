import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators.nested import StructuralIndex, _Flattener, bundle_table, choice_table, flatten_bundles, metric_table, prediction_table, span_table, valid_json, whole_id

import numpy as np


def brute(bundle, payload):
    """The same rows from a parsed tree."""

    def refuse(name):
        raise ValueError(name)

    def as_list(x, member=None):
        while isinstance(x, str):
            try:
                x = json.loads(x, parse_constant=refuse)
            except (ValueError, RecursionError):
                return []
        return [x] if isinstance(x, dict) else x if isinstance(x, list) else []

    try:
        root = json.loads(payload, parse_constant=refuse)
    except (TypeError, ValueError):
        return []
    out = []
    for p in as_list(root.get("predictions")) if isinstance(root, dict) else []:
        if not isinstance(p, dict):
            continue
        doc = whole_id(json.dumps(p["doc_id"]).encode()) if "doc_id" in p else None
        out.append((bundle, doc, -1, -1))
        for j, c in enumerate(as_list(p.get("model_output"))):
            if isinstance(c, dict):
                out.append((bundle, doc, j, -1))
                out += [(bundle, doc, j, k) for k, s in enumerate(as_list(c.get("spans"))) if isinstance(s, dict)]
    return out


def flat(payloads):
    some = [(k, p) for k, p in enumerate(payloads) if p is not None]
    f = _Flattener()
    f.bundles(np.array([k for k, _ in some]), [p.encode() for _, p in some])
    b = f.batch()
    return sorted(zip(*[b.column(n).to_pylist() for n in ("bundle_id", "doc_id", "choice_index", "span_index")], strict=True), key=repr)


PAYLOADS = [
    '{"predictions": [{"doc_id": 1, "model_output": [{"spans": [{"start": 0}, null, {"start": 2}]}, null, {"spans": {}}]}]}',
    '{"predictions": {"model_output": {"spans": "[{},{}]"}, "doc_id": "7"}}',
    '{"a": "\\"predictions\\": [{", "predictions": "[{\\"doc_id\\": 2.0, \\"model_output\\": \\"{}\\"}]"}',
    '{"predictions": [1, "x", [], {"doc_id": null}, {"doc_id": "b"}, {"doc_id": 1.5}, {"doc_id": true}]}',
    '{"predictions": [], "x": {"predictions": [{"doc_id": 3}]}}',
    '{"predictions": [{"doc_id": 1}], "predictions": [{"doc_id": 2}, {"doc_id": 3}]}',
    '{"pred\\u0069ctions": [{"doc\\u005fid": 4}]}',
    '[{"predictions": [{"doc_id": 1}]}]', '{"predictions": "not json"}', '{"predictions": null}', '"text"', "3", "{}", "[]", "",
    '{"predictions": [{"doc_id": 1}]} x', '{"predictions": [{"doc_id": NaN}]}', '{"predictions": [{"doc_id": 1}', None,
    '  {\n"predictions"\t:\r[ { "doc_id" : 5 , "model_output" : [ { } , { } ] } ]\n}  ',
    '{"predictions": [{"doc_id": 9223372036854775807}, {"doc_id": 9223372036854775808}, {"doc_id": "ü\\\\"}], "k\\\\": "\\\\\\""}',
]


def test_shapes_against_a_tree():
    want = sorted((r for k, p in enumerate(PAYLOADS) for r in brute(k, p)), key=repr)
    assert flat(PAYLOADS) == want and len(want) == 25


JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text(alphabet='ab"\\{}[],: é', max_size=5),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["predictions", "model_output", "spans", "doc_id", 'a"b', "x\\"]), inner, max_size=4),
    max_leaves=25,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(JSON, min_size=1, max_size=4), st.sampled_from([None, 1]))
def test_any_json_against_a_tree(values, indent):
    payloads = [json.dumps(v, indent=indent, ensure_ascii=False) for v in values]
    assert flat(payloads) == sorted((r for k, p in enumerate(payloads) for r in brute(k, p)), key=repr)


def accepted(text):
    def refuse(name):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=refuse)
    except ValueError:
        return False
    return True


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(JSON, st.lists(st.tuples(st.integers(0, 60), st.sampled_from(list('{}[],:"\\ 0-1.eE+tn/u\t\n\x01') + ["null", "true", "NaN", '"a"', "\\u00e9", ""]), st.booleans()), max_size=3)), min_size=1, max_size=5))
def test_grammar_against_a_strict_reader(cases):
    """Damaged texts are told from sound ones, whatever stands beside them in the buffer."""
    texts = []
    for value, edits in cases:
        text = json.dumps(value, ensure_ascii=False)
        for at, piece, instead in edits:
            text = text[:at] + piece + text[at + instead :]
        texts.append(text)
    assert StructuralIndex([t.encode() for t in texts]).valid.tolist() == [accepted(t) for t in texts]


@pytest.mark.parametrize("text", ["0", "-0", "01", "-", "1.", ".5", "1.5e", "1e+5", "1E-05", "+1", "tru", "true", "truefalse", "nul", "Infinity", '"\\u12g4"', '"\\u1234"', '"\\x"', '"\t"', "\ufeff1", "1 2", "[1,]", "[,1]", '{"a"}', '{"a":1,}', '{1:2}', '{"a":1 "b":2}', "[1:2]", "[}", "{]", "", " ", '"a" "b"', '1"a"', "\\", '"\\\\"', '"\\"', "1" * 5000])
def test_grammar_cases(text):
    import sys

    sys.set_int_max_str_digits(0)
    assert valid_json(text) is accepted(text)


def test_index_of_long_nesting():
    deep = "[" * 50_000 + "]" * 50_000
    index = StructuralIndex([deep.encode(), b'{"a": 1}', ("[" * 9).encode(), b"{}"])
    assert index.valid.tolist() == [True, True, False, True]
    row, start, end = index.members(index.token_at(index.first(index.starts[1:2])), b"a")
    assert index.text(start[0], end[0]) == b"1" and len(row) == 1
    inner = json.dumps({"doc_id": 2, "model_output": "[{}]"})
    assert flat(['{"x": ' + deep + ', "predictions": [' + inner + ', {"doc_id": ' + deep + "}]}"]) == [(0, 2, -1, -1), (0, 2, 0, -1), (0, None, -1, -1)]


def test_spark_tables(spark):
    body = json.dumps({"task_name": "boolq", "num_instances": 1.0, "task_config": {"x": [1]}, "predictions": [{"doc_id": 5, "native_id": "n\u00fc\"", "label": "2.0", "metrics": {"acc": 1, "scores": {"f1": 0.5, "no": None}, "s": "x"}, "model_output": [{"sum_logits": -1.5, "num_tokens": 12.0, "num_chars": "7.0", "is_greedy": True, "spans": [{"start": 3.0, "end": 2, "logit": 0.5}]}]}]})
    df = spark.createDataFrame([(1, body), (1, body), (2, None), (None, body), (3, "x" * 100_000)], "bundle_id bigint, payload string").withColumn("doc_id", F.lit(0)).withColumn("m_label", F.lit(0))
    assert flatten_bundles(df).count() == 6
    predictions = prediction_table(df)
    assert [tuple(r) for r in predictions.drop("metrics").distinct().collect()] == [(1, 0, 5, 'n\u00fc"', None, None, 2)]
    assert sorted((r.metric, r.value) for r in metric_table(predictions).distinct().collect()) == [("acc", 1.0), ("f1", 0.5), ("no", None), ("s", None)]
    c = choice_table(df).first()
    assert (c.choice_index, c.sum_logits, c.num_tokens, c.is_greedy, c.num_chars, c.logits_per_byte) == (0, -1.5, 12, True, 7, None)
    s = span_table(df).first()
    assert (s.span_index, s.start, s.end, s.logit) == (0, 3, 2, 0.5)
    b = bundle_table(df).first()
    assert (b.bundle_id, b.task_name, b.num_instances, b.task_config, b.model_hash) == (1, "boolq", 1, '{"x": [1]}', None)
    for level in (None, "bundles", "predictions", "choices", "spans"):
        assert flatten_bundles(df.limit(0), level, ["a"] if level else []).count() == 0


@pytest.mark.parametrize(("raw", "value"), [(b"12", 12), (b'"12"', 12), (b'" 012 "', 12), (b"12.0", 12), (b"1.2e1", 12), (b"-3", -3), (b"1.5", None), (b"null", None), (b"true", None), (b'"x"', None), (b"{}", None), (b"1e400", None), (b'"NaN"', None)])
def test_whole_id(raw, value):
    assert whole_id(raw) == value

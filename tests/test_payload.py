"""JSON inside free text, by hand, at random and in adverse texts; values made safe."""

from __future__ import annotations

import hashlib
import json
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.functions import payload

JSON = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text('a{}[]"\\é', max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('k{"', max_size=3), x, max_size=3), max_leaves=8)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{"a": 1}', {"a": 1}), (' [1, 2] ', [1, 2]), ('"x"', "x"), ("7", 7), ("```json\n{\"a\": 1}\n```", {"a": 1}), ("```JSON [1]```", [1]),
        ('Sure: {"a": {"b": 2}}. Done', {"a": {"b": 2}}), ('{"x":1} and {"y":2}', {"x": 1}), ("see [1] and {\"a\": 2}", {"a": 2}), ("see [1] only", [1]),
        ('{not json} {"a": "}"}', {"a": "}"}), ('broken {"a": {"b": 1} ', {"b": 1}), ('an {open brace, then {"a": 3}', {"a": 3}), ('{"a": "\\"{"} x', {"a": '"{'}), ('it\'s "quoted {" then {"k": 69} }', {"k": 69}),
    ],
)
def test_values_in_texts(text, value):
    assert payload.find_value(text) == value


@pytest.mark.parametrize("text", ["", None, "no json", "{", "}{", "[", "{a}", "```", '"'])
def test_no_value(text):
    with pytest.raises(ValueError):
        payload.find_value(text)


def test_an_object_is_needed():
    for text in ("[1]", "7", "a [1] b"):
        with pytest.raises(ValueError):
            payload.find_value(text, need_object=True)
    assert payload.find_value('[1] {"a": 1}', need_object=True) == {"a": 1}


@settings(max_examples=200, deadline=None)
@given(st.text("ab .,\n", max_size=12), st.dictionaries(st.text('k{"', max_size=3), JSON, max_size=3), st.text("xy .,\n", max_size=12))
def test_objects_amid_words(before, value, after):
    assert payload.find_value(before + json.dumps(value) + after, need_object=True) == value


@pytest.mark.parametrize("text", ["{" * 100_000, '{"a":' * 50_000, "[" * 100_000, '{"' * 50_000, "{a}" * 50_000, '{"a":[' * 30_000 + "]}" * 1000, "}" * 100_000, '{"a":1' * 40_000])
def test_adverse_texts_take_linear_time(text):
    began = time.process_time()
    try:
        assert isinstance(payload.find_value(text, need_object=True), dict) and text.endswith("]}")
    except ValueError:
        assert not text.endswith("]}")
    assert time.process_time() - began < 10


def test_safe_values(spark):
    big = np.arange(40, dtype=np.float32)
    got = payload.safe({2: math.inf, "b": {1, }, "a": (np.int64(3), np.float32(0.5), None, True), "c": big, "d": big[:2], "e": np.float32(math.nan)})
    assert got == {
        "2": None, "a": [3, 0.5, None, True], "b": [1], "d": [0.0, 1.0], "e": None,
        "c": {"array_type": "ndarray", "dtype": "float32", "shape": [40], "sha256": hashlib.sha256(big.tobytes()).hexdigest()},
    }
    assert list(got) == ["2", "a", "b", "c", "d", "e"]
    rows = spark.createDataFrame([([1.0, None], ), (None,), (big.tolist(),), ([],)], "v array<float>").select(payload.array_payload(payload.F.col("v")).alias("p")).collect()
    assert [r["p"] and json.loads(r["p"]) for r in rows] == [[1.0, None], None, got["c"], []]

import pytest
from pyspark.sql import functions as F

from rankloom.functions import numbers as N
from rankloom.functions import text as T


def values(rows, schema, data, column):
    return [r[0] for r in rows([(x,) for x in data], f"x {schema}").select(column(F.col("x"))).collect()]


def test_numbers_out_of_texts(rows):
    data = ["0.000002", "-1000000", "nan", "", "abc", None, "0", "1d", "1.0f", " 7 ", "1e3", "inf"]
    assert values(rows, "string", data, T.to_number) == [2e-6, -1e6, None, None, None, None, 0.0, None, None, 7.0, 1000.0, float("inf")]
    assert values(rows, "string", data, T.to_price)[:7] == [2e-6, None, None, None, None, None, 0.0]


def test_squashed(rows):
    assert values(rows, "string", ["Qwen2.5-7B/é", None, "A b_C"], T.squashed) == ["qwen257b", "", "abc"]


SIZES = [("X-235B-A22B", 235.0), ("Mix-8x22B", 176.0), ("m-1.5b", 1.5), ("a-70B_v2", None), ("q-bnb-4bit", None), ("v-1.2.5b", None), ("m 7 B", 7.0), ("m-0B", 0.0), ("GPT-4 b-org/x", 4.0), ("l4-17B-128E", 17.0), ("none", None), ("m-1.5x22b", 110.0)]
NOISE = [("Stable Diffusion", True), ("org/x-base", True), ("org/x-base_v2", False), ("T5 small", True), ("flan-t5-xl", True), ("mt5", False), ("Auto Router", True), ("x-bnb4bit", True), ("TTS", True), ("xttsx", False), ("Llama-Guard", True), ("chat-7b", False)]


def test_sizes(rows):
    assert values(rows, "string", [t for t, _ in SIZES], T.billions) == [v for _, v in SIZES]


def test_noise(rows):
    assert values(rows, "string", [t for t, _ in NOISE], T.sidelined) == [v for _, v in NOISE]


def test_rounding_is_of_the_binary_value(rows):
    data = [0.05, 0.15, 0.25, 0.35, 71.25, None, float("inf")] + [i / 997 for i in range(2000)]
    assert values(rows, "double", data, N.round1) == [None if x is None else x if x == float("inf") else round(x, 1) for x in data]


def test_texts_of_numbers(rows):
    assert values(rows, "double", [None, 999.0, 999.5, 1000.0, 2.5e6, 1.2e9, 0.0], N.short) == ["—", "999", "999.5", "1.0K", "2.5M", "1.2B", "0"]
    assert values(rows, "double", [None, 4e-6, 0.0], N.dollars_per_million) == ["—", "$4.00", "$0.00"]
    assert values(rows, "bigint", [None, 59, 90, 3599, 5400], N.ago) == ["—", "59s", "2m", "60m", "2h"]
    assert values(rows, "int", [1, 12, 123], N.padded) == ["01", "12", "123"]
    assert values(rows, "double", [None, 0.0, 2.0], N.or_dash) == ["—", "0.0", "2.0"]
    assert values(rows, "double", [None, 0.0, 2.0], lambda x: N.or_dash(x, zero_too=True)) == ["—", "—", "2.0"]


@pytest.mark.parametrize("query,hit", [("50%", True), ("A_B", True), ("axb", False), ("", True)])
def test_search_is_literal(rows, query, hit):
    assert values(rows, "string", ["a_b 50%"], lambda c: T.contains_text(query, c, F.lit(None).cast("string"))) == [hit]

"""Text expressions on edge cases."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import (
    ACTIONS, DATASET_TYPE, chain_root, log_field, matching_tokens, split_space, split_whitespace, whole_token,
)
from millrace.plans.text_jobs import log_rollup, rollup_text, word_count


@pytest.mark.parametrize(
    "line, tokens",
    [
        ("a b", ["a", "b"]),
        (" a  b  ", ["", "a", "", "b"]),
        ("", [""]),
        ("   ", []),
        ("a\tb", ["a\tb"]),
    ],
)
def test_split_space(spark, line, tokens):
    df = spark.createDataFrame([(line,)], "value string")
    assert df.select(split_space(F.col("value"))).first()[0] == tokens


def test_split_whitespace(spark):
    df = spark.createDataFrame([("a \t b  c",)], "value string")
    assert df.select(split_whitespace(F.col("value"))).first()[0] == ["a", "b", "c"]


def test_word_count_is_case_sensitive(spark):
    df = spark.createDataFrame([("a A a",), ("a",)], "value string")
    assert {r.word: r.n for r in word_count(df).collect()} == {"a": 3, "A": 1}


def log_line(user, size):
    return f'10.1.2.3 - {user} [18/Jan/2013:17:56:07 +1100] "GET /x HTTP/1.1" 304 {size} "http://r/" "agent"; rest'


def test_log_rollup_keys(spark):
    lines = [log_line("fred", 10), log_line("fred", 5), log_line("-", 7), log_line("ann", "-"), "nonsense"]
    rollup = log_rollup(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {(r.ip, r.user, r.query): (r.n, r.bytes) for r in rollup.collect()}
    assert got == {
        ("10.1.2.3", "fred", "GET /x HTTP/1.1"): (2, 15),
        ("10.1.2.3", "ann", "GET /x HTTP/1.1"): (1, 0),
        (None, None, None): (2, 7),
    }
    assert "bytes=15\tn=2" in {r.stats for r in rollup_text(rollup).collect()}


def test_log_fields(spark):
    df = spark.createDataFrame([(log_line('"FRED"', 315),)], "value string")
    line = F.col("value")
    got = df.select(*[log_field(line, f) for f in ("user", "status", "bytes", "agent")]).first()
    assert tuple(got) == ('"FRED"', "304", "315", "agent")


def test_action_names_match_whole_tokens(spark):
    text = "count counts recount takeSample map saveAsTextFile"
    df = spark.createDataFrame([(text,)], "value string")
    assert df.select(matching_tokens(F.col("value"), whole_token(ACTIONS))).first()[0] == [
        "count", "takeSample", "saveAsTextFile",
    ]


def test_dataset_types(spark):
    text = "JavaRDD JavaPairRDD<String,Integer> JavaDoubleRDD RDD JavaRDDs"
    df = spark.createDataFrame([(text,)], "value string")
    assert df.select(matching_tokens(F.col("value"), f"^{DATASET_TYPE}$")).first()[0] == [
        "JavaRDD", "JavaPairRDD<String,Integer>", "JavaDoubleRDD",
    ]


def test_chain_root(spark):
    df = spark.createDataFrame([("a.b().c()",), ("a",)], "value string")
    assert [r[0] for r in df.select(chain_root(F.col("value"))).collect()] == ["a", "a"]

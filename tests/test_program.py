"""Program text: types with nested arguments, calls that are calls, and the roots of their chains."""

import pytest

from millrace.functions.program import scan
from millrace.plans import patch
from tests.conftest import rows


@pytest.mark.parametrize(
    "line, found",
    [
        ("JavaPairRDD<String, Integer> x", [("type", "JavaPairRDD<String,Integer>", None)]),
        ("JavaPairRDD < Tuple2< Long,Map<A , B[]>>, ? super C > x = y;", [("type", "JavaPairRDD<Tuple2<Long,Map<A,B[]>>,?superC>", None)]),
        ("JavaRDD x = JavaRDD<Y", [("type", "JavaRDD", None), ("type", "JavaRDD", None)]),
        ("MyJavaRDD a; JavaRDDs b; JavaSetRDD c;", []),
        ("int count = top; first = max;", []),
        ("a.count();", [("action", "count", "a")]),
        ("return a.b.c.reduce(x).toString();", [("action", "reduce", "a")]),
        ("links.join(ranks.collect()).values().first()", [("action", "collect", "ranks"), ("action", "first", "links")]),
        ('System.out.println("x.count()" + lines.count()); // lines.first()', [("action", "count", "lines")]),
        ("public long count() { return data.take(1).size(); }", [("action", "take", "data")]),
        ("List<Long> max() { }", []),
        ("x = a > count();", [("action", "count", "count")]),
        ("rdd.<Long>fold(0, f)", [("action", "fold", "rdd")]),
        ("new first(a).go()", []),
        ("(a.union(b)).min()", [("action", "min", "a")]),
        ("((a)).cache().count()", [("cover", "cache", "a"), ("action", "count", "a")]),
        ("rdds[i + 1].persist(LEVEL)", [("cover", "persist", "rdds")]),
        ("this.lines.count()", [("action", "count", "lines")]),
        ("load(path).foreach(f)", [("action", "foreach", "load")]),
        ("  .count();", [("action", "count", "count")]),
        ("/* a.count() */ b.top(3) /* c.first()", [("action", "top", "b")]),
        ("'\\'' + c.countByKey()", [("action", "countByKey", "c")]),
        ("a.counts(); a.recount(); a.saveAsTextFiles()", []),
        ("", []),
        (None, []),
        (")]>.count() < ( [", [("action", "count", None)]),
    ],
)
def test_scan(line, found):
    assert scan(line) == found


def test_mentions_of_lines(spark):
    lines = spark.createDataFrame(
        [("p", 1, "JavaRDD<A, B> a = b.map(count);"), ("p", 2, "a.count(); a.first();"), ("p", 3, None), ("q", 1, "persist = 1;"), ("q", 2, "b.top(2)")],
        "path string, line_no long, text string",
    )
    assert rows(patch.program_mentions(lines).select("path", "line_no", "what", "token", "root")) == rows(
        spark.createDataFrame(
            [("p", 1, "type", "JavaRDD<A,B>", None), ("p", 2, "action", "count", "a"), ("p", 2, "action", "first", "a"), ("q", 2, "action", "top", "b")],
            "path string, line_no long, what string, token string, root string",
        )
    )
    assert rows(patch.actions_per_root(lines)) == [(1, "q", "b"), (2, "p", "a")]

"""Advice and patches on small programs whose right answers are known."""

from pyspark.sql import functions as F

from millrace.plans import advice, patch
from tests.conftest import rows

SCHEMA = (
    "job string, pos long, line long, kind string, name string, inputs array<string>, "
    "call string, covered boolean, scope long, depth long"
)


def program_rows(job, statements):
    """Statements ``(line, kind, name, inputs, depth)``; a new scope starts when the depth changes."""
    data, scope, last = [], 0, None
    for pos, (line, kind, name, inputs, depth) in enumerate(statements):
        if last is not None and depth != last:
            scope += 1
        last = depth
        covered = kind == "covered def"
        call = "count" if kind == "action" else None
        data.append((job, pos, line, kind.removeprefix("covered "), name, inputs, call, covered, scope, depth))
    return data


def program(spark, *statements):
    return spark.createDataFrame(program_rows("j", statements), SCHEMA)


def advise(statements):
    loops = advice.loop_scopes(statements)
    kept = advice.uncovered_invariants(advice.loop_invariant_inputs(statements, loops), statements)
    state = advice.cover_state(statements)
    every = advice.all_advice(
        advice.earliest_advice(kept), advice.multi_use_datasets(statements, state), state
    )
    return advice.last_advice_per_line(every)


def advised(statements):
    return {(r.line, r.name, r.kind) for r in advise(statements).collect()}


# Programs shaped like the known pairs of input and patched output: loop over
# points, over vectors, grouping, closure, rank and library clustering.
LOGISTIC = [
    (130, "def", "points", ["lines"], 0),
    (147, "def", "gradient", ["points"], 1),
    (149, "action", "points", [], 1),
]
CLUSTERING = [
    (105, "def", "digts", ["lines"], 0),
    (119, "action", "digts", [], 0),
    (189, "def", "closest", ["digts"], 1),
    (191, "action", "closest", [], 1),
    (203, "def", "stats", ["closest"], 1),
    (205, "action", "stats", [], 1),
]
GROUPING = [
    (90, "def", "pairs1", [], 0),
    (92, "action", "pairs1", [], 0),
    (93, "action", "pairs1", [], 0),
]
CLOSURE = [
    (75, "def", "tc", [], 0),
    (83, "def", "edges", ["tc"], 0),
    (86, "action", "tc", [], 0),
    (91, "write", "tc", ["tc", "tc", "edges"], 1),
    (92, "write", "nextCount", ["tc"], 1),
    (92, "action", "tc", [], 1),
    (95, "action", "tc", [], 0),
]
RANK = [
    (92, "def", "links", ["lines"], 0),
    (95, "def", "ranks", ["links"], 0),
    (98, "def", "contribs", ["links", "ranks"], 1),
    (113, "write", "ranks", ["contribs"], 1),
    (118, "use", "i", [], 0),
    (120, "def", "contribs", ["links", "ranks"], 1),
    (136, "write", "ranks", ["contribs"], 1),
    (147, "action", "ranks", [], 0),
]
LIBRARY = [(40, "def", "data", [], 0), (41, "def", "parsed", ["data"], 0), (55, "use", "parsed", [], 0)]


KNOWN = {
    "logistic": (LOGISTIC, {(130, "points", "Iteration")}),
    "clustering": (CLUSTERING, {(105, "digts", "Iteration")}),
    "grouping": (GROUPING, {(92, "pairs1", "MultiAction")}),
    "closure": (CLOSURE, {(83, "edges", "Iteration"), (86, "tc", "MultiAction")}),
    "rank": (RANK, {(92, "links", "Iteration")}),
    "library": (LIBRARY, set()),
}


def advised_by_job(spark, programs):
    """Advice for several programs in one table, one job each."""
    data = [row for job, statements in programs.items() for row in program_rows(job, statements)]
    got = {job: set() for job in programs}
    for r in advise(spark.createDataFrame(data, SCHEMA)).collect():
        got[r.job].add((r.line, r.name, r.kind))
    return got


def test_known_advice(spark):
    got = advised_by_job(spark, {job: statements for job, (statements, _) in KNOWN.items()})
    assert got == {job: expected for job, (_, expected) in KNOWN.items()}


def test_known_patches(spark):
    text = [
        ("lr", 130, "  points = a.map(); // b;", "  points = a.map().cache(); // b;"),
        ("groups", 92, " \t pairs1.count();", " \t pairs1.cache();\n \t pairs1.count();"),
        ("closure", 83, "edges = tc.map();", "edges = tc.map().cache();"),
        ("closure", 86, "    n = tc.count();", "    tc.cache();\n    n = tc.count();"),
        ("library", 41, "parsed = data.map();", "parsed = data.map();"),
    ]
    lines = [(path, n, f"line {n};") for path in ("lr", "groups", "closure", "library") for n in range(1, 151)]
    special = {(path, n): before for path, n, before, _ in text}
    lines = [(p, n, special.get((p, n), t)) for p, n, t in lines]
    tips = [
        ("lr", 130, "points", "Iteration"), ("groups", 92, "pairs1", "MultiAction"),
        ("closure", 83, "edges", "Iteration"), ("closure", 86, "tc", "MultiAction"),
    ]
    frame = spark.createDataFrame(lines, "path string, line_no long, text string")
    advice_frame = spark.createDataFrame(tips, "path string, line_no long, name string, kind string")
    after = {(p, n): a for p, n, _, a in text}
    expected = {
        path: "\n".join(after.get((p, n), t) for p, n, t in lines if p == path).split("\n")
        for path in ("lr", "groups", "closure", "library")
    }
    for pieces in (1, 40):
        got = {path: {} for path in expected}
        for r in patch.patch_lines(frame, advice_frame, pieces).collect():
            got[r.path][r.line_no] = r.text
            assert not r.unpatched
        for path in expected:
            assert [got[path][n] for n in sorted(got[path])] == expected[path]
            assert sorted(got[path]) == list(range(1, len(expected[path]) + 1))


def test_loop_advice_without_semicolon_is_flagged(spark):
    lines = spark.createDataFrame([("p", 1, "x = a")], "path string, line_no long, text string")
    tip = spark.createDataFrame([("p", 1, "x", "Iteration")], "path string, line_no long, name string, kind string")
    assert rows(patch.patch_lines(lines, tip)) == [(1, "p", "x = a", True)]


LOOP = [(9, "def", "out", ["a"], 1), (10, "cover", "a", [], 0)]


BEFORE = {
    "declared": ([(1, "def", "a", [], 0)], True),
    "declared covered": ([(1, "covered def", "a", [], 0)], False),
    "covered": ([(1, "def", "a", [], 0), (2, "cover", "a", [], 0)], False),
    "declared again": ([(1, "def", "a", [], 0), (2, "cover", "a", [], 0), (3, "def", "a", [], 0)], True),
    "covered too early": ([(1, "cover", "a", [], 0), (2, "def", "a", [], 0)], True),
}


def test_covers_before_the_loop_count_and_later_ones_do_not(spark):
    got = advised_by_job(spark, {job: before + LOOP for job, (before, _) in BEFORE.items()})
    assert {job: "a" in {name for _, name, _ in found} for job, found in got.items()} == {
        job: loop_advice for job, (_, loop_advice) in BEFORE.items()
    }


def test_late_second_cover_hides_an_early_one(spark):
    used = [(1, "def", "a", [], 0), (2, "cover", "a", [], 0), (3, "action", "a", [], 0), (4, "action", "a", [], 0)]
    late = [*used, (5, "cover", "a", [], 0)]
    got = advised_by_job(spark, {"early": used, "late": late})
    assert got == {"early": set(), "late": {(3, "a", "MultiAction")}}


def test_action_on_an_undeclared_name_gives_no_advice(spark):
    assert advised(program(spark, (1, "action", "a", [], 0), (2, "action", "a", [], 0))) == set()


def test_inner_loop_has_its_own_reads_and_ends_with_the_loops_inside(spark):
    nested = program(
        spark,
        (1, "def", "a", [], 0),
        (2, "def", "b", [], 0),
        (3, "use", "b", [], 1),
        (4, "def", "t", ["a"], 2),
        (5, "use", "a", [], 3),
        (6, "write", "a", ["t"], 1),
        (7, "use", "b", [], 0),
    )
    loops = {r.scope: (r.depth, r.end_pos, r.outer_start, r.opens) for r in advice.loop_scopes(nested).collect()}
    assert loops == {1: (1, 4, 2, True), 2: (2, 4, 2, True), 3: (3, 4, 2, False), 4: (1, 5, 5, True)}
    found = {(r.scope, r.name) for r in advice.loop_invariant_inputs(nested, advice.loop_scopes(nested)).collect()}
    assert found == {(1, "b"), (2, "a")}
    kept = advice.uncovered_invariants(advice.loop_invariant_inputs(nested, advice.loop_scopes(nested)), nested)
    assert rows(advice.earliest_advice(kept)) == [(2, "j", "a", 3), (2, "j", "b", 2)]


def test_last_advice_wins_on_a_line(spark):
    every = spark.createDataFrame(
        [("j", 4, "MultiAction", 9, "b"), ("j", 4, "Iteration", 20, "a"), ("j", 5, "Iteration", 1, "c"), ("j", 5, "Iteration", 2, "a")],
        "job string, line long, kind string, pos long, name string",
    )
    got = advice.last_advice_per_line(every).select("line", F.col("name")).collect()
    assert {tuple(r) for r in got} == {(4, "b"), (5, "a")}

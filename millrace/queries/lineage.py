"""Lineage and advice over the statement table read out of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import chain_root, whole_token
from millrace.plans import advice, lineage, patch, statements
from millrace.queries.basics import document_lines
from millrace.queries.registry import query, table
from millrace.session import cut

_KINDS = " ".join(f"WHEN '{event}' THEN '{kind}'" for event, kind in statements.KIND_OF_EVENT.items())
_CALLS = ", ".join(f"'{call}'" for call in statements.CALLS)

STATEMENTS = f"""base AS (
    SELECT user_id AS job, event_id AS pos, CASE event_type {_KINDS} END AS kind,
        CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
    FROM events
), statements AS (
    SELECT job, pos, (rn - 1) // 2 + 1 AS line, kind, 'd' || (k % 5) AS name,
        CASE WHEN kind = 'write' AND k % 4 = 0 THEN ['d' || (k % 5)]
             WHEN k % 3 = 0 THEN ['d' || ((k + 1) % 5), 'd' || ((k + 2) % 5)]
             WHEN k % 11 = 0 THEN ['d' || ((k + 1) % 5), 'd' || ((k + 1) % 5)]
             ELSE ['d' || ((k + 1) % 5)] END AS inputs,
        CASE WHEN kind = 'action' THEN list_extract([{_CALLS}], k % 5 + 1) END AS call,
        kind = 'def' AND k % 7 = 0 AS covered, (rn - 1) // 8 AS scope, ((rn - 1) // 8) % 3 AS depth
    FROM base
)"""

BOUND = f"""{STATEMENTS}, declared AS (
    SELECT job, name, min(pos) AS first_pos FROM statements WHERE kind = 'def' GROUP BY job, name
), nodes AS (
    SELECT s.job, s.pos AS node_id, s.name, s.line FROM statements s JOIN declared d USING (job, name)
    WHERE s.kind = 'def' OR (s.kind = 'write' AND s.pos > d.first_pos)
), mentions AS (
    SELECT job, pos, line, call, 'input' AS role, unnest(inputs) AS name FROM statements WHERE kind IN ('def', 'write')
    UNION ALL SELECT job, pos, line, call, 'read', name FROM statements WHERE kind = 'use'
    UNION ALL SELECT job, pos, line, call, 'receiver', name FROM statements WHERE kind = 'action'
    UNION ALL SELECT job, pos, line, call, 'argument', unnest(inputs) FROM statements WHERE kind = 'action'
), bound AS (
    SELECT m.job, m.pos, m.line, m.call, m.role, m.name, n.node_id AS def_pos
    FROM mentions m ASOF JOIN nodes n ON m.job = n.job AND m.name = n.name AND m.pos > n.node_id
), inner_edges AS (
    SELECT b.job, b.def_pos AS src, b.pos AS dst FROM bound b JOIN nodes n ON b.job = n.job AND b.pos = n.node_id
    WHERE b.role = 'input'
), sinks AS (
    SELECT job, def_pos AS src, pos AS dst, call, line FROM bound WHERE role IN ('receiver', 'argument')
), edges AS (SELECT job, src, dst FROM inner_edges UNION ALL SELECT job, src, dst FROM sinks
), candidates AS (
    SELECT job, src AS node_id, count(*) AS fanout FROM edges GROUP BY job, src HAVING count(*) >= 2
)"""

REACHED = f"""{BOUND}, reach AS (
    SELECT job, node_id AS root, node_id AS node FROM candidates
    UNION SELECT r.job, r.root, e.dst FROM reach r JOIN inner_edges e ON r.job = e.job AND r.node = e.src
), reached AS (
    SELECT r.job, r.root, s.dst AS sink, s.call, s.line FROM reach r JOIN sinks s ON r.job = s.job AND r.node = s.src
)"""


def trace(spark, sf_dir):
    return statements.from_events(table(spark, sf_dir, "events"))


def bound(spark, sf_dir):
    return lineage.bindings(trace(spark, sf_dir))


def graph_parts(spark, sf_dir):
    """Versions, edges between them, edges into sinks, and candidates, each written once."""
    binding = cut(bound(spark, sf_dir), "bindings")
    made = lineage.nodes(binding)
    inner = cut(lineage.lineage_edges(binding), "edges")
    sinks = lineage.sink_edges(binding)
    edges = inner.unionByName(sinks.select("job", "src", "dst"))
    return made, inner, sinks, lineage.fanout_candidates(edges)


@query("asof_definition", f"WITH {BOUND} SELECT job, pos, role, name, def_pos FROM bound")
def asof_definition(spark, sf_dir):
    return lineage.asof_definition(bound(spark, sf_dir))


@query(
    "version_runs",
    f"""WITH {STATEMENTS}, walked AS (
        SELECT job, name, kind, scope, pos, line, unnest(range(1, CAST(2 ** depth AS BIGINT) + 1)) AS pass
        FROM statements WHERE kind IN ('def', 'write')
    ), known AS (
        SELECT *, max(CASE WHEN kind = 'def' THEN 1 ELSE 0 END) OVER w AS seen FROM walked
        WINDOW w AS (PARTITION BY job, name ORDER BY scope, pass, pos)
    ), marked AS (
        SELECT *, CASE WHEN lag(line) OVER w = line THEN 0 ELSE 1 END AS change FROM known WHERE seen = 1
        WINDOW w AS (PARTITION BY job, name ORDER BY scope, pass, pos)
    ), runs AS (
        SELECT *, sum(change) OVER (PARTITION BY job, name ORDER BY scope, pass, pos) AS run FROM marked
    )
    SELECT job, name, scope, CAST(pass AS INTEGER) AS pass, pos, line,
        row_number() OVER (PARTITION BY job, name, run ORDER BY scope, pass, pos) - 2 AS version FROM runs""",
)
def version_runs(spark, sf_dir):
    return lineage.version_runs(trace(spark, sf_dir))


@query("lineage_nodes", f"WITH {BOUND} SELECT job, node_id, name, line FROM nodes")
def lineage_nodes(spark, sf_dir):
    return lineage.nodes(bound(spark, sf_dir))


@query("lineage_edges", f"WITH {BOUND} SELECT job, src, dst FROM inner_edges")
def lineage_edges(spark, sf_dir):
    return lineage.lineage_edges(cut(bound(spark, sf_dir), "bindings"))


@query("sink_edges", f"WITH {BOUND} SELECT job, src, dst, call, line FROM sinks")
def sink_edges(spark, sf_dir):
    return lineage.sink_edges(bound(spark, sf_dir))


@query(
    "action_timeline",
    f"""WITH {STATEMENTS} SELECT job, row_number() OVER (PARTITION BY job ORDER BY pos) AS seq, call, line
    FROM statements WHERE kind = 'action'""",
)
def action_timeline(spark, sf_dir):
    return lineage.action_timeline(trace(spark, sf_dir))


@query("fanout_candidates", f"WITH {BOUND} SELECT job, node_id, fanout FROM candidates")
def fanout_candidates(spark, sf_dir):
    return graph_parts(spark, sf_dir)[3]


@query("reachable_sinks", f"WITH RECURSIVE {REACHED} SELECT job, root, sink, call, line FROM reached")
def reachable_sinks(spark, sf_dir):
    _, inner, sinks, roots = graph_parts(spark, sf_dir)
    return lineage.reachable_sinks(inner, sinks, roots)


#: Items of one list, so few that some versions have several.
SUMMARY_PIECE = 4


@query(
    "node_summary",
    f"""WITH RECURSIVE {REACHED}, items AS (
        SELECT e.job, e.src AS node_id, 'children' AS list, e.dst AS place, n.name || '_' || n.line AS item
        FROM inner_edges e JOIN nodes n ON e.job = n.job AND e.dst = n.node_id
        UNION ALL SELECT job, src, 'children', dst, '0' || call || '_' || line FROM sinks
        UNION ALL SELECT job, root, 'actions', sink, call || '_' || line FROM reached
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY job, node_id, list ORDER BY place, item) AS number FROM items
    ), lists AS (
        SELECT job, node_id, list, CAST((number - 1) // {SUMMARY_PIECE} AS BIGINT) AS chunk,
            '[' || string_agg(item, ',' ORDER BY number) || ']' AS items FROM numbered GROUP BY ALL
    ), wanted AS (SELECT *, unnest(['children', 'actions']) AS list FROM nodes)
    SELECT b.job, b.node_id, b.name, b.line, b.list, coalesce(l.chunk, 0) AS chunk, coalesce(l.items, ']') AS items
    FROM wanted b LEFT JOIN lists l ON b.job = l.job AND b.node_id = l.node_id AND b.list = l.list""",
)
def node_summary(spark, sf_dir):
    made, inner, sinks, roots = graph_parts(spark, sf_dir)
    return lineage.node_summary(made, inner, sinks, lineage.reachable_sinks(inner, sinks, roots), SUMMARY_PIECE)


@query(
    "repeat_expand",
    f"""WITH {STATEMENTS} SELECT job, pos, scope, CAST(unnest(range(1, CAST(2 ** depth AS BIGINT) + 1)) AS INTEGER) AS pass
    FROM statements""",
)
def repeat_expand(spark, sf_dir):
    return lineage.repeat_expand(trace(spark, sf_dir)).select("job", "pos", "scope", "pass")


LOOPS = f"""{STATEMENTS}, scopes AS (
    SELECT job, scope, depth, min(pos) AS start_pos, max(pos) AS own_end,
        max(CASE WHEN kind IN ('def', 'write') THEN 1 ELSE 0 END) AS own_assigns
    FROM statements WHERE depth > 0 GROUP BY job, scope, depth
), loops AS (
    SELECT a.job, a.scope, a.depth, a.start_pos,
        CASE WHEN a.depth = 1 THEN a.start_pos ELSE o.start_pos END AS outer_start,
        CASE WHEN a.depth = 1 THEN greatest(a.own_end, coalesce(i.own_end, 0)) ELSE a.own_end END AS end_pos,
        (CASE WHEN a.depth = 1 THEN greatest(a.own_assigns, coalesce(i.own_assigns, 0)) ELSE a.own_assigns END) = 1 AS opens
    FROM scopes a LEFT JOIN scopes o ON o.job = a.job AND o.scope = a.scope - 1 AND o.depth = 1
    LEFT JOIN scopes i ON i.job = a.job AND i.scope = a.scope + 1 AND i.depth = 2
)"""

COVERS = """outer_defs AS (
    SELECT job, name, min(pos) AS first_decl, max(pos) AS decl_pos, arg_max(line, pos) AS decl_line
    FROM statements WHERE kind = 'def' AND depth = 0 GROUP BY job, name
), cover_events AS (
    SELECT job, name, pos, kind = 'cover' OR covered AS covered FROM statements
    WHERE kind = 'cover' OR (kind = 'def' AND depth = 0)
), state AS (
    SELECT o.job, o.name, any_value(decl_pos) AS decl_pos, any_value(decl_line) AS decl_line,
        arg_max(covered, pos) AS covered, CASE WHEN arg_max(covered, pos) THEN max(pos) END AS cover_pos
    FROM outer_defs o JOIN cover_events c ON o.job = c.job AND o.name = c.name GROUP BY o.job, o.name
)"""

INVARIANTS = f"""{LOOPS}, {COVERS}, reads AS (
    SELECT job, scope, depth, pos, kind, unnest(CASE WHEN kind = 'use' THEN [name] ELSE inputs END) AS name
    FROM statements WHERE kind IN ('def', 'write', 'use')
), writes AS (SELECT job, scope, name FROM statements WHERE kind IN ('def', 'write')
), invariants AS (
    SELECT r.job, r.scope, any_value(l.depth) AS depth, r.name, min(r.pos) AS read_pos,
        any_value(l.end_pos) AS end_pos, any_value(l.outer_start) AS outer_start
    FROM reads r JOIN loops l ON r.job = l.job AND r.scope = l.scope AND l.opens
    JOIN outer_defs o ON r.job = o.job AND r.name = o.name AND o.first_decl < r.pos
    WHERE NOT EXISTS (SELECT 1 FROM writes w WHERE w.job = r.job AND w.scope = r.scope AND w.name = r.name)
    GROUP BY r.job, r.scope, r.name
)"""

UNCOVERED = f"""{INVARIANTS}, uncovered AS (
    SELECT i.* FROM invariants i ASOF LEFT JOIN cover_events c
        ON i.job = c.job AND i.name = c.name AND i.end_pos >= c.pos
    WHERE NOT (coalesce(c.covered, false) AND c.pos < i.outer_start)
)"""

ADVICE = f"""{UNCOVERED}, earliest AS (
    SELECT job, name, min(outer_start) AS advise_pos,
        arg_min(read_pos, (outer_start, end_pos, -depth)) AS reason_pos FROM uncovered GROUP BY job, name
), used AS (
    SELECT job, name, count(*) AS actions, min(pos) AS first_pos, arg_min(line, pos) AS first_line
    FROM statements WHERE kind = 'action' GROUP BY job, name HAVING count(*) >= 2
), multi AS (
    SELECT u.* FROM used u JOIN state s ON u.job = s.job AND u.name = s.name
    WHERE NOT s.covered OR s.cover_pos > u.first_pos
), advice AS (
    SELECT e.job, s.decl_line AS line, 'Iteration' AS kind, e.advise_pos AS pos, e.name
    FROM earliest e JOIN state s ON e.job = s.job AND e.name = s.name
    UNION ALL SELECT job, first_line, 'MultiAction', first_pos, name FROM multi
), last_advice AS (
    SELECT * FROM advice QUALIFY row_number() OVER (PARTITION BY job, line ORDER BY kind DESC, pos DESC, name DESC) = 1
)"""


def uncovered(spark, sf_dir):
    program = trace(spark, sf_dir)
    invariants = advice.loop_invariant_inputs(program, advice.loop_scopes(program))
    return program, advice.uncovered_invariants(cut(invariants, "invariants"), program)


def merged_advice(spark, sf_dir):
    program, kept = uncovered(spark, sf_dir)
    state = advice.cover_state(program)
    every = advice.all_advice(
        advice.earliest_advice(kept), advice.multi_use_datasets(program, state), state
    )
    return program, advice.last_advice_per_line(every)


@query("loop_scopes", f"WITH {LOOPS} SELECT job, scope, depth, start_pos, end_pos, outer_start, opens FROM loops")
def loop_scopes(spark, sf_dir):
    return advice.loop_scopes(trace(spark, sf_dir))


@query(
    "loop_invariant_inputs",
    f"WITH {INVARIANTS} SELECT job, scope, depth, name, read_pos, end_pos, outer_start FROM invariants",
)
def loop_invariant_inputs(spark, sf_dir):
    program = trace(spark, sf_dir)
    return advice.loop_invariant_inputs(program, advice.loop_scopes(program))


@query(
    "first_in_scope",
    f"""WITH {INVARIANTS} SELECT job, scope, name, pos, kind FROM reads
    QUALIFY row_number() OVER (PARTITION BY job, scope, name ORDER BY pos) = 1""",
)
def first_in_scope(spark, sf_dir):
    return advice.first_in_scope(advice.scope_reads(trace(spark, sf_dir)))


@query(
    "uncovered_invariants",
    f"WITH {UNCOVERED} SELECT job, scope, depth, name, read_pos, end_pos, outer_start FROM uncovered",
)
def uncovered_invariants(spark, sf_dir):
    return uncovered(spark, sf_dir)[1]


@query("earliest_advice", f"WITH {ADVICE} SELECT job, name, advise_pos, reason_pos FROM earliest")
def earliest_advice(spark, sf_dir):
    return advice.earliest_advice(uncovered(spark, sf_dir)[1])


@query("multi_use_datasets", f"WITH {ADVICE} SELECT job, name, actions, first_pos, first_line FROM multi")
def multi_use_datasets(spark, sf_dir):
    program = trace(spark, sf_dir)
    return advice.multi_use_datasets(program, advice.cover_state(program))


@query(
    "cover_state",
    f"WITH {STATEMENTS}, {COVERS} SELECT job, name, decl_pos, decl_line, covered, cover_pos FROM state",
)
def cover_state(spark, sf_dir):
    return advice.cover_state(trace(spark, sf_dir))


@query("last_advice_per_line", f"WITH {ADVICE} SELECT job, line, kind, pos, name FROM last_advice")
def last_advice_per_line(spark, sf_dir):
    return merged_advice(spark, sf_dir)[1]


PATCHED = """advised AS (
    SELECT l.path, l.line_no, l.text, a.kind, a.name,
        coalesce(sum(CASE WHEN a.kind = 'MultiAction' THEN 1 ELSE 0 END) OVER (
            PARTITION BY l.path ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS added
    FROM lines l LEFT JOIN advice_lines a ON l.path = a.path AND l.line_no = a.line_no
), pieces AS (
    SELECT path, line_no + added AS place, coalesce(kind, '') = 'Iteration' AND NOT contains(text, ';') AS unpatched,
        CASE WHEN kind = 'MultiAction' THEN [regexp_extract(text, '^[\t ]*') || name || '.cache();', text]
             WHEN kind = 'Iteration' AND contains(text, ';')
             THEN [substr(text, 1, instr(text, ';') - 1) || '.cache()' || substr(text, instr(text, ';'))]
             ELSE [text] END AS texts
    FROM advised
)
SELECT path, CAST(place + unnest(range(len(texts))) AS BIGINT) AS line_no, unnest(texts) AS text, unpatched FROM pieces"""

DOCUMENT_PROGRAM = """doc_lines AS (
    SELECT doc_id AS path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no,
        unnest(string_split(text, chr(10))) AS raw FROM documents
), lines AS (
    SELECT path, line_no, repeat(chr(9), CAST(line_no % 3 AS INTEGER)) || replace(raw, ', ', '; ') AS text FROM doc_lines
), advice_lines AS (
    SELECT path, line_no, CASE WHEN length(raw) % 3 = 1 THEN 'Iteration' ELSE 'MultiAction' END AS kind, 'v' || line_no AS name
    FROM doc_lines WHERE length(raw) % 3 > 0
)"""


def document_program(spark, sf_dir):
    """Numbered, indented document lines with ``;`` in them, and advice on some."""
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "raw")
    ).select("path", (F.col("i") + 1).cast("long").alias("line_no"), "raw")
    rest = F.length("raw") % 3
    lines = raw.select(
        "path", "line_no",
        F.concat(F.repeat(F.lit("\t"), (F.col("line_no") % 3).cast("int")), F.replace("raw", F.lit(", "), F.lit("; "))).alias("text"),
    )
    tips = raw.where(rest > 0).select(
        "path", "line_no", F.when(rest == 1, advice.ITERATION).otherwise(advice.MULTI_ACTION).alias("kind"),
        F.concat(F.lit("v"), "line_no").alias("name"),
    )
    return lines, tips


@query("patch_lines", f"WITH {DOCUMENT_PROGRAM}, {PATCHED}")
def patch_lines(spark, sf_dir):
    return patch.patch_lines(*document_program(spark, sf_dir))


PROGRAM_LINES = """parts AS (
    SELECT job AS path, line AS line_no, pos, depth, CASE
        WHEN kind = 'def' THEN 'JavaRDD ' || name || ' = map(' || array_to_string(inputs, ', ') || ')'
            || CASE WHEN covered THEN '.persist();' ELSE ';' END
        WHEN kind = 'write' THEN name || ' = map(' || array_to_string(inputs, ', ') || ');'
        WHEN kind = 'use' THEN 'show(' || name || ');'
        WHEN kind = 'action' THEN name || '.union(' || array_to_string(inputs, ', ') || ').' || call || '();'
        ELSE name || '.cache();' END AS part FROM statements
), lines AS (
    SELECT path, line_no, repeat(chr(9), CAST(min(depth) AS INTEGER)) || string_agg(part, ' ' ORDER BY pos) AS text
    FROM parts GROUP BY path, line_no
)"""


@query(
    "patch_jobs",
    f"""WITH {ADVICE}, {PROGRAM_LINES}, advice_lines AS (
        SELECT job AS path, line AS line_no, kind, name FROM last_advice), {PATCHED}""",
)
def patch_jobs(spark, sf_dir):
    program, last = merged_advice(spark, sf_dir)
    lines = statements.as_lines(program)
    return patch.patch_lines(lines, last.withColumnsRenamed({"job": "path", "line": "line_no"}))


WORDS = ("the", "and", "of", "les", "der", "und")


@query(
    "pattern_mentions",
    f"""WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]+')) AS token FROM documents)
    SELECT doc_id, token, count(*) AS n FROM words
    WHERE regexp_full_match(token, '({"|".join(WORDS)})') GROUP BY doc_id, token""",
)
def pattern_mentions(spark, sf_dir):
    lines = document_lines(spark, sf_dir).select(
        F.col("doc_id").alias("path"), F.lit(1).alias("line_no"), F.col("value").alias("text")
    )
    found = patch.mentions(lines, "word", whole_token(WORDS), " ")
    return found.groupBy(F.col("path").alias("doc_id"), "token").agg(F.count(F.lit(1)).alias("n"))


def spaced_program(spark, sf_dir):
    """A line for each statement, with blanks in type arguments and names of actions where nothing is called."""
    first = F.col("inputs")[0]
    part = (
        F.when(
            (F.col("kind") == "def") & (F.col("pos") % 2 == 0),
            F.format_string("JavaPairRDD<String, Map<Long, List< ? extends Integer >>> %s = %s.mapValues(count);", "name", first),
        )
        .when(F.col("kind") == "def", F.format_string("JavaDoubleRDD %s = new first(%s).top;", "name", first))
        .when(F.col("kind") == "write", F.format_string('%s = %s.filter(x -> x.first > 0 && "take()" != x); // count()', "name", first))
        .when(F.col("kind") == "use", F.format_string('show(%s.max, "%s.count()");', "name", "name"))
        .when(
            F.col("kind") == "action",
            F.format_string("long n = %s.union( %s.map(f) ).<Long> keyBy(g)\t. %s ( x[0], min );", "name", first, "call"),
        )
        .otherwise(F.format_string("((%s)).repartition(4).cache();", "name"))
    )
    return trace(spark, sf_dir).select(
        F.col("job").alias("path"), F.col("pos").alias("line_no"),
        F.concat(F.repeat(F.lit("\t"), F.col("depth").cast("int")), part).alias("text"),
    )


@query(
    "program_mentions",
    f"""WITH {STATEMENTS}
    SELECT job AS path, pos AS line_no, 'type' AS what,
        CASE WHEN pos % 2 = 0 THEN 'JavaPairRDD<String,Map<Long,List<?extendsInteger>>>' ELSE 'JavaDoubleRDD' END AS token,
        CAST(NULL AS VARCHAR) AS root FROM statements WHERE kind = 'def'
    UNION ALL SELECT job, pos, 'action', call, name FROM statements WHERE kind = 'action'
    UNION ALL SELECT job, pos, 'cover', 'cache', name FROM statements WHERE kind = 'cover'""",
)
def program_mentions(spark, sf_dir):
    """The SQL says from the statements what the scan must find in their text."""
    return patch.program_mentions(spaced_program(spark, sf_dir))


@query(
    "actions_per_root",
    f"WITH {STATEMENTS} SELECT job AS path, name AS root, count(*) AS actions FROM statements WHERE kind = 'action' GROUP BY job, name",
)
def actions_per_root(spark, sf_dir):
    return patch.actions_per_root(spaced_program(spark, sf_dir))


@query(
    "chain_root_counts",
    """SELECT split_part(regexp_extract(url, '://([^/]+)', 1), '.', 1) AS root, count(*) AS n
       FROM pages GROUP BY 1""",
)
def chain_root_counts(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/]+)", 1)
    return table(spark, sf_dir, "pages").groupBy(chain_root(host).alias("root")).agg(
        F.count(F.lit(1)).alias("n")
    )

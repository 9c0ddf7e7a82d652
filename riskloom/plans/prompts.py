"""Registered queries: prompt contexts of candidates, chains in discovery order, notes on sinks that no entry reaches.

The fixture: documents are files, a line a sentence; spans of lines are methods, some lines call a method by name and arity, and the rule
hits on those lines are the candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import cut
from ..operators import candidates as C
from ..operators import discovery as D
from ..operators import graph as G
from ..operators import prompt as P
from ..operators.notes import overriding, unreachable_notes
from ..sources import bridge as B
from .queries import LINES, SCOPED

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_SENTENCES = LINES.replace("string_split(text, chr(10))", "string_split(replace(text, '. ', '.' || chr(10)), chr(10))")
_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_FILES = rf"""{SCOPED.replace(LINES, _SENTENCES)},
fl AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.txt' AS file, replace(text, '. ', '.' || chr(10)) AS text FROM documents),
fs AS (SELECT doc_id, file, CASE WHEN text <> '' THEN string_split_regex(regexp_replace(text, '(?:{_BREAK})\z', ''), '{_BREAK}') ELSE [] END AS ls, CASE WHEN doc_id % 4 = 0 THEN 150 ELSE 25 END AS l FROM fl),
ln AS MATERIALIZED (SELECT doc_id, file, l, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM fs),
m AS MATERIALIZED (SELECT *, concat_ws('|', file, owner, name, arity) AS node, concat_ws('|', owner, name, arity) AS kin FROM (
  SELECT doc_id * 100000 + i AS method_seq, doc_id, file, i * l + 1 AS start, least(n, i * l + l - 1) AS "end", 'C' || doc_id AS owner, CASE WHEN doc_id % 10 = 1 AND i % 3 = 1 THEN 'main' ELSE 'm' || doc_id // 3 || '_' || i % 3 END AS name,
    i // 3 % 2 AS arity, CASE WHEN (doc_id + i % 3) % 4 = 0 THEN 'boolean' ELSE 'int' END AS return_type,
    CASE WHEN doc_id % 7 = 0 AND i % 3 = 0 AND i // 3 % 2 = 0 THEN 'GET /' || doc_id WHEN doc_id % 11 = 3 AND i % 3 = 1 THEN 'a request as parameter' END AS entry_reason, doc_id % 7 = 0 AND i % 3 = 0 AND i // 3 % 2 = 0 AS definitive,
    CASE WHEN doc_id % 3 = 2 THEN ['C' || doc_id - 1] WHEN doc_id % 13 = 5 THEN ['Runnable'] ELSE [] END AS supertypes, doc_id % 13 = 5 AND i % 3 = 2 AS marked, doc_id % 17 = 4 AS anonymous
  FROM (SELECT doc_id, file, l, len(ls) AS n, unnest(range(0, CASE WHEN len(ls) > 0 THEN (len(ls) - 1) // l + 1 ELSE 0 END)) AS i FROM fs))),
c AS MATERIALIZED (SELECT doc_id * 100000 + i AS call_seq, doc_id * 100000 + (i - 1) // l AS caller_seq, file, i AS line, 'm' || CASE WHEN i % 12 = 2 THEN doc_id // 3 ELSE doc_id // 6 END || '_' || i // 4 % 3 AS callee, i // 12 % 2 AS arity
  FROM ln WHERE i % 4 = 2 AND i % l <> 0),
ed AS MATERIALIZED (SELECT f.node AS caller, f.kin AS caller_kin, m.node AS callee, m.kin AS callee_kin, min(c.call_seq) AS seq FROM c JOIN m ON m.name = c.callee AND m.arity = c.arity JOIN m f ON f.method_seq = c.caller_seq GROUP BY ALL),
ent AS (SELECT node, bool_or(definitive) AS definitive FROM m WHERE entry_reason IS NOT NULL GROUP BY node),
cd AS (SELECT DISTINCT doc_id * 100000 + line_no AS sink, sink_file, line_no AS sink_line, CASE WHEN doc_id % 10 = 9 THEN 'lost.txt' ELSE sink_file END AS source_file, CASE WHEN doc_id % 3 = 0 THEN greatest(1, line_no - 30) ELSE line_no END AS source_line FROM scoped),
sk AS MATERIALIZED (SELECT k.sink, k.sink_file AS file, k.sink_line AS line, m.method_seq, m.node, m.kin, m.start, m."end" FROM cd k LEFT JOIN m ON m.file = k.sink_file AND k.sink_line BETWEEN m.start AND m."end"),
st AS (SELECT DISTINCT sk.sink, sk.node, ent.definitive FROM sk LEFT JOIN ent ON ent.node = sk.node WHERE sk.node IS NOT NULL),
r(sink, node, depth, chain) USING KEY (sink, node) AS (SELECT sink, node, 0, []::BIGINT[] FROM st WHERE definitive IS NOT TRUE
  UNION SELECT r.sink, ed.caller, min(r.depth) + 1, min(list_append(r.chain, ed.seq)) FROM r JOIN ed ON ed.callee = r.node LEFT JOIN ent ON ent.node = r.node
  WHERE r.depth < 20 AND (r.depth = 0 OR ent.node IS NULL) AND NOT EXISTS (SELECT 1 FROM recurring.r v WHERE v.sink = r.sink AND v.node = ed.caller) GROUP BY r.sink, ed.caller),
hit AS (SELECT r.sink, r.node AS entry, r.depth, r.chain FROM r JOIN ent ON ent.node = r.node WHERE r.depth > 0),
ch AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY depth, chain) AS place FROM (SELECT * FROM hit UNION ALL SELECT sink, node, 0, []::BIGINT[] FROM st WHERE definitive OR (NOT definitive AND sink NOT IN (SELECT sink FROM hit))))"""

#: How far callers are followed: only while a start has seen fewer than 200, as prompt contexts do, or as far as they go (unreachable_notes).
_SEEN = (" JOIN (SELECT start, count(*) AS n FROM recurring.w GROUP BY start) q ON q.start = w.start", "q.n < 200 AND ", "w.seen < 200 AND ")
_ALL = ("", "", "")


def _notes(join: str, few: str, counted: str) -> str:
    return f"""{_FILES},
al AS (SELECT sk.sink, sk.kin FROM sk WHERE sk.sink NOT IN (SELECT sink FROM ch)),
an(type, ancestor) AS (SELECT owner, unnest(supertypes) FROM m UNION SELECT a.type, b.up FROM an a JOIN (SELECT DISTINCT owner, unnest(supertypes) AS up FROM m) b ON b.owner = a.ancestor),
mm AS (SELECT kin, arg_min(file, method_seq) AS file, arg_min(owner, method_seq) AS owner, arg_min(name, method_seq) AS name, arg_min(supertypes, method_seq) AS supertypes, arg_min(anonymous, method_seq) AS anonymous, arg_min(ov, method_seq) AS overrides
  FROM (SELECT m.*, m.marked OR EXISTS (SELECT 1 FROM an JOIN m u ON u.owner = an.ancestor WHERE an.type = m.owner AND u.name = m.name AND u.arity = m.arity) AS ov FROM m) GROUP BY kin),
ke AS MATERIALIZED (SELECT caller_kin AS caller, callee_kin AS callee, min(seq) AS seq FROM ed WHERE caller_kin <> callee_kin GROUP BY ALL),
w(start, node, depth, chain) USING KEY (start, node) AS (SELECT DISTINCT kin, kin, 0, []::BIGINT[] FROM al WHERE kin IS NOT NULL
  UNION SELECT w.start, ke.caller, min(w.depth) + 1, min(list_append(w.chain, ke.seq)) FROM w JOIN ke ON ke.callee = w.node{join}
  WHERE {few}NOT EXISTS (SELECT 1 FROM recurring.w v WHERE v.start = w.start AND v.node = ke.caller) GROUP BY w.start, ke.caller),
lv AS (SELECT w.start, w.depth, w.chain, mm.*, row_number() OVER (PARTITION BY w.start ORDER BY w.depth, w.chain) AS nth, mm.overrides AND len(mm.supertypes) > 0 AS wide,
         mm.owner || '.' || mm.name || '() in ' || mm.file AS label
       FROM (SELECT *, sum(1) OVER (PARTITION BY start ORDER BY depth RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM w) w JOIN mm ON mm.kin = w.node
       WHERE {counted}w.node NOT IN (SELECT callee FROM ke)),
ev AS (SELECT start, count(*) AS n, bool_and(name = 'main') AS mains, bool_or(wide) AS some, arg_min(name, (depth, chain)) FILTER (WHERE wide) AS over_name, list_sort(list_distinct(flatten(list(supertypes) FILTER (WHERE wide)))) AS types,
         list(label ORDER BY nth) FILTER (WHERE nth <= 4) AS named FROM lv GROUP BY start),
oc AS (SELECT al.sink, al.kin, mm.name, ev.*, CASE WHEN al.kin IS NULL THEN 'no method' WHEN al.kin NOT IN (SELECT callee FROM ke) THEN CASE WHEN mm.overrides OR mm.anonymous THEN 'callback' ELSE 'unused' END
         WHEN ev.n IS NULL THEN 'internal' WHEN ev.mains THEN 'startup' WHEN ev.some THEN 'overrides' ELSE 'ends' END AS outcome FROM al LEFT JOIN mm ON mm.kin = al.kin LEFT JOIN ev ON ev.start = al.kin),
lt AS (SELECT literal, list_sort(list(DISTINCT file)) AS files FROM (SELECT 'm' || doc_id // 6 || '_2' AS literal, file FROM fl WHERE doc_id % 2 = 0 UNION SELECT 'm' || doc_id // 3 || '_0', file FROM fl WHERE doc_id % 5 = 0) GROUP BY literal),
nt AS MATERIALIZED (SELECT o.sink, o.outcome, CASE o.outcome WHEN 'no method' THEN 'No method is around this line.' WHEN 'startup' THEN 'Runs at startup only; all callers begin at ' || array_to_string(o.named, ', ') || '.'
    WHEN 'internal' THEN 'Only called by internal code that no entry reaches.' WHEN 'callback' THEN 'Nothing calls ' || o.name || '(); its type''s users may, as a callback.' WHEN 'unused' THEN 'Nothing calls ' || o.name || '(); unused, or called by name.'
    ELSE 'No entry within reach; callers begin at ' || array_to_string(o.named, '; ') || CASE WHEN o.n > 4 THEN ' (+' || o.n - 4 || ' more)' ELSE '' END || '.' END
  || CASE WHEN o.outcome = 'overrides' THEN ' Overridden types: ' || array_to_string(o.types, ', ') || '.' ELSE '' END
  || coalesce(' Named as text in ' || array_to_string(lt.files[1:2], ', ') || CASE WHEN len(lt.files) > 2 THEN ' (+' || len(lt.files) - 2 || ' more)' ELSE '' END || '.', '') AS note
  FROM oc o LEFT JOIN lt ON lt.literal = CASE WHEN o.outcome = 'overrides' THEN o.over_name WHEN o.outcome IN ('callback', 'unused') THEN o.name END)"""


def _window(places: str, block: int) -> str:
    """Pieces of a window in SQL: said in place of a missing file, else the method, its head and tail, or the lines around."""
    long = '"end" - start + 1 > 120'
    return f"""SELECT sink, [{block}, 1] AS at, '(no such file: ' || file || ')' AS t, NULL AS file, NULL AS lo, NULL AS hi FROM {places} WHERE NOT there
UNION ALL SELECT sink, [{block}, 1], NULL, file, CASE WHEN start IS NULL THEN line - 15 ELSE start END, CASE WHEN start IS NULL THEN line + 15 WHEN {long} THEN start + 11 ELSE "end" END FROM {places} WHERE there
UNION ALL SELECT sink, [{block}, 2], chr(10) || '      | ... ' || greatest(line - 15, start + 12) - start - 12 || ' lines omitted ...' || chr(10), NULL, NULL, NULL FROM {places} WHERE there AND {long} AND greatest(line - 15, start + 12) <= least(line + 15, "end")
UNION ALL SELECT sink, [{block}, 3], NULL, file, greatest(line - 15, start + 12), least(line + 15, "end") FROM {places} WHERE there AND {long} AND greatest(line - 15, start + 12) <= least(line + 15, "end")"""


_CONTEXT = f"""{_notes(*_SEEN)},
so AS (SELECT k.sink, k.source_file AS file, k.source_line AS line, m.start, m."end", EXISTS (SELECT 1 FROM fl WHERE fl.file = k.source_file) AS there FROM cd k LEFT JOIN m ON m.file = k.source_file AND k.source_line BETWEEN m.start AND m."end"
       WHERE k.source_file <> k.sink_file OR k.source_line <> k.sink_line),
si AS (SELECT sink, file, line, start, "end", true AS there FROM sk),
hp AS MATERIALIZED (SELECT x.sink, x.place, x.depth, x.hop, c.file, c.line, f.name, f.start, f."end", f.entry_reason, greatest(10, least(40, 240 // x.depth)) AS room
  FROM (SELECT sink, place, depth, unnest(chain) AS call_seq, generate_subscripts(chain, 1) - 1 AS hop FROM ch WHERE place <= 4 AND depth > 0) x JOIN c ON c.call_seq = x.call_seq JOIN m f ON f.method_seq = c.caller_seq),
pt AS (SELECT sink, place, string_agg(name || '() at ' || file || ':' || line, ' <- ' ORDER BY hop) AS hops, arg_max(name, hop) AS name, arg_max(file, hop) AS file, arg_max(start, hop) AS start, arg_max(entry_reason, hop) AS reason FROM hp GROUP BY sink, place),
cn AS (SELECT k.sink, k.line - c.line AS far, c.call_seq, CASE WHEN a.n = 1 THEN a.only WHEN o.n = 1 THEN o.only END AS to_seq, k.method_seq AS own FROM sk k JOIN c ON c.caller_seq = k.method_seq AND c.line <= k.line
  JOIN (SELECT name, arity, count(*) AS n, min(method_seq) AS only FROM m GROUP BY ALL) a ON a.name = c.callee AND a.arity = c.arity
  LEFT JOIN (SELECT file, name, arity, count(*) AS n, min(method_seq) AS only FROM m GROUP BY ALL) o ON o.name = c.callee AND o.arity = c.arity AND o.file = k.file),
ce AS (SELECT n.sink, m.file, m.name, m.start, m."end", least(m."end", m.start + 39) AS stop, row_number() OVER (PARTITION BY n.sink ORDER BY n.near) AS rank, count(*) OVER (PARTITION BY n.sink) AS n
  FROM (SELECT sink, to_seq, min((far, call_seq)) AS near FROM cn WHERE to_seq IS NOT NULL AND to_seq <> own GROUP BY sink, to_seq) n JOIN m ON m.method_seq = n.to_seq WHERE m.return_type <> 'boolean'),
pc AS MATERIALIZED (SELECT sink, [0] AS at, '## Source: ' || source_file || chr(10) AS t, NULL AS file, NULL AS lo, NULL AS hi FROM cd WHERE source_file <> sink_file OR source_line <> sink_line
UNION ALL SELECT sink, [10], CASE WHEN source_file = sink_file AND source_line = sink_line THEN '## Source and sink: ' ELSE chr(10) || chr(10) || '## Sink: ' END || sink_file || chr(10), NULL, NULL, NULL FROM cd
UNION ALL {_window("so", 1)}
UNION ALL {_window("si", 11)}
UNION ALL SELECT sink, [20, place, 1], CASE WHEN place = 1 THEN chr(10) || chr(10) || '## Calls from entries' ELSE '' END || chr(10) || hops || chr(10) || 'Entry: ' || name || '() in ' || file || ', ' || reason || chr(10), NULL, NULL, NULL FROM pt
UNION ALL SELECT sink, [20, place, 2], NULL, file, start - 8, start + 8 FROM pt
UNION ALL SELECT sink, [20, place, 9], chr(10), NULL, NULL, NULL FROM pt
UNION ALL SELECT sink, [20, 1, 3, depth - hop, 1], chr(10) || chr(10) || '-- ' || name || '() in ' || file || ', calls on at line ' || line || chr(10), NULL, NULL, NULL FROM hp WHERE place = 1 AND depth > 1
UNION ALL SELECT sink, [20, 1, 3, depth - hop, 2], NULL, file, start, CASE WHEN "end" - start + 1 <= room THEN "end" ELSE start END FROM hp WHERE place = 1 AND depth > 1
UNION ALL SELECT sink, [20, 1, 3, depth - hop, 3], CASE WHEN line - room + 3 > start + 1 THEN chr(10) || '      | ...' || chr(10) ELSE chr(10) END, NULL, NULL, NULL FROM hp WHERE place = 1 AND depth > 1 AND "end" - start + 1 > room
UNION ALL SELECT sink, [20, 1, 3, depth - hop, 4], NULL, file, greatest(start + 1, line - room + 3), least("end", line + 2) FROM hp WHERE place = 1 AND depth > 1 AND "end" - start + 1 > room
UNION ALL SELECT sink, [20, 5], chr(10) || '(+' || count(*) - 4 || ' more call paths)' || chr(10), NULL, NULL, NULL FROM ch WHERE depth > 0 GROUP BY sink HAVING count(*) > 4
UNION ALL SELECT sink, [20], chr(10) || chr(10) || '## Calls from entries' || chr(10) || 'The sink is inside an entry.', NULL, NULL, NULL FROM ch WHERE depth = 0
UNION ALL SELECT sink, [20], chr(10) || chr(10) || '## Calls from entries' || chr(10) || note, NULL, NULL, NULL FROM nt
UNION ALL SELECT sink, [30, rank, 1], CASE WHEN rank = 1 THEN chr(10) || chr(10) || '## Called on the way' || chr(10) ELSE chr(10) END || chr(10) || name || '() in ' || file || chr(10), NULL, NULL, NULL FROM ce WHERE rank <= 3
UNION ALL SELECT sink, [30, rank, 2], NULL, file, start, stop FROM ce WHERE rank <= 3
UNION ALL SELECT sink, [30, rank, 3], chr(10) || '      | ... ' || "end" - stop || ' more lines ...', NULL, NULL, NULL FROM ce WHERE rank <= 3 AND "end" > stop
UNION ALL SELECT sink, [30, 4], chr(10) || chr(10) || '(+' || n - 3 || ' more called methods)', NULL, NULL, NULL FROM ce WHERE rank = 1 AND n > 3),
sw AS (SELECT s.file, s.lo, s.hi, string_agg(repeat(' ', greatest(0, 5 - length(CAST(ln.i AS VARCHAR)))) || ln.i || ' | ' || ln.line, chr(10) ORDER BY ln.i) AS shown
  FROM (SELECT DISTINCT file, lo, hi FROM pc WHERE file IS NOT NULL) s JOIN ln ON ln.file = s.file AND ln.i BETWEEN s.lo AND s.hi GROUP BY ALL)"""


def _code(spark, sf_dir) -> dict:
    """files, methods, calls, edges, literals, candidates of the fixture."""
    docs = B.table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n")))
    d = F.col("doc_id")
    files = cut(docs.select("doc_id", B.file_name().alias("file"), "text"), "files")
    step = F.when(d % 4 == 0, 150).otherwise(25)
    # texts are split once here: methods, their types and calls only ask how many lines a file has
    lines = cut(P.blocks(files).groupBy("file").agg(F.max(F.col("first") + F.size("lines") - 1).alias("n")), "counts")
    spans = files.select("doc_id", "file").join(lines, "file").withColumn("l", step)
    spans = spans.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("l")).cast("int"))).alias("i"))
    i = F.col("i")
    named = lambda x, k: F.concat(F.lit("m"), F.floor(x).cast("string"), F.lit("_"), k.cast("string"))
    proven = (d % 7 == 0) & (i % 3 == 0) & (F.floor(i / 3) % 2 == 0)
    none = F.array().cast("array<string>")
    methods = spans.select(
        (d * 100000 + i).alias("method_seq"), "file", (i * F.col("l") + 1).alias("start"), F.least("n", i * F.col("l") + F.col("l") - 1).alias("end"), F.concat(F.lit("C"), d).alias("owner"),
        F.when((d % 10 == 1) & (i % 3 == 1), "main").otherwise(named(d / 3, i % 3)).alias("name"), (F.floor(i / 3) % 2).cast("int").alias("arity"), F.when((d + i % 3) % 4 == 0, "boolean").otherwise("int").alias("return_type"),
        F.when(proven, F.concat(F.lit("GET /"), d)).when((d % 11 == 3) & (i % 3 == 1), "a request as parameter").alias("entry_reason"), proven.alias("definitive"),
        F.when(d % 3 == 2, F.array(F.concat(F.lit("C"), d - 1))).when(d % 13 == 5, F.array(F.lit("Runnable"))).otherwise(none).alias("supertypes"), ((d % 13 == 5) & (i % 3 == 2)).alias("marked"), (d % 17 == 4).alias("anonymous"),
    ).withColumn("node", F.concat_ws("|", "file", "owner", "name", F.col("arity").cast("string")))
    up = G.ancestors(methods.select(F.col("owner").alias("type"), F.explode("supertypes").alias("parent")).distinct())
    methods = cut(overriding(methods, up), "methods")
    at = files.select("doc_id", "file").join(lines, "file").withColumn("l", step).select("doc_id", "file", "l", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    n = F.col("line")
    calls = at.where((n % 4 == 2) & (n % F.col("l") != 0)).select(
        (d * 100000 + n).alias("call_seq"), (d * 100000 + F.floor((n - 1) / F.col("l"))).alias("caller_seq"), "file", "line", named(F.when(n % 12 == 2, d / 3).otherwise(d / 6), F.floor(n / 4) % 3).alias("callee"), (F.floor(n / 12) % 2).cast("int").alias("arity")
    )
    calls = cut(calls, "calls")
    nodes = methods.select("method_seq", "node")
    met = G.callers(methods, calls).join(nodes.withColumnRenamed("node", "callee"), "method_seq").join(nodes.select(F.col("method_seq").alias("caller_seq"), F.col("node").alias("caller")), "caller_seq")
    edges = cut(met.groupBy("caller", "callee").agg(F.min("call_seq").alias("seq")), "edges")
    literals = files.where(d % 2 == 0).select(named(d / 6, F.lit(2)).alias("literal"), "file").unionAll(files.where(d % 5 == 0).select(named(d / 3, F.lit(0)), "file"))
    hits = C.drop_out_of_scope(B.candidates_of(B.hits_of(B.lines_of(docs))), B.OUT_OF_SCOPE).select("doc_id", "sink_file", "sink_line").distinct()
    k = F.col("sink_line")
    found = hits.select((d * 100000 + k).alias("sink"), "sink_file", "sink_line", F.when(d % 10 == 9, "lost.txt").otherwise(F.col("sink_file")).alias("source_file"), F.when(d % 3 == 0, F.greatest(F.lit(1), k - 30)).otherwise(k).alias("source_line"))
    return {"candidates": cut(found, "candidates"), "files": files.select("file", "text"), "methods": methods, "calls": calls, "edges": edges, "literals": literals}


def _sinks(x: dict):
    points = x["candidates"].select(F.col("sink").alias("point"), F.col("sink_file").alias("file"), F.col("sink_line").alias("line"))
    around = G.enclosing(points, x["methods"].select("file", "start", "end", F.col("method_seq").alias("name"), F.col("method_seq").alias("seq")))
    return cut(around.select(F.col("point").alias("sink"), F.col("name").alias("method_seq")).join(x["methods"].select("method_seq", "node", F.concat_ws("|", "owner", "name", F.col("arity").cast("string")).alias("kin")), "method_seq", "left"), "sinks")


@query(f"WITH RECURSIVE {_FILES} SELECT sink, entry, depth, place, array_to_string(chain, ',') AS chain FROM ch")
def trace_ordered(spark, sf_dir):
    """Chains from entries to candidates, shortest first, equally long ones in discovery order."""
    x = _code(spark, sf_dir)
    found = D.chains(_sinks(x).where("node IS NOT NULL").select("sink", "node"), x["edges"], x["methods"].where("entry_reason IS NOT NULL").select("node", "definitive"))
    return found.select("sink", "entry", "depth", "place", F.array_join("chain", ",").alias("chain"))


@query(f"WITH RECURSIVE {_notes(*_ALL)} SELECT sink, outcome, note FROM nt")
def unreachable_notes_query(spark, sf_dir):
    x = _code(spark, sf_dir)
    sinks = _sinks(x)
    found = D.chains(sinks.where("node IS NOT NULL").select("sink", "node"), x["edges"], x["methods"].where("entry_reason IS NOT NULL").select("node", "definitive"))
    alone = sinks.join(found.select("sink").distinct(), "sink", "left_anti")
    return unreachable_notes(*P.by_kin(alone.select("sink", "node"), x["methods"], x["edges"]), x["literals"])


@query(f"WITH RECURSIVE {_CONTEXT} SELECT pc.sink, string_agg(coalesce(pc.t, sw.shown, ''), '' ORDER BY pc.at) AS context FROM pc LEFT JOIN sw ON sw.file = pc.file AND sw.lo = pc.lo AND sw.hi = pc.hi GROUP BY pc.sink")
def prompt_context(spark, sf_dir):
    return P.prompt_context(**_code(spark, sf_dir))


QUERIES["unreachable_notes"], ORACLES["unreachable_notes"] = QUERIES.pop("unreachable_notes_query"), ORACLES.pop("unreachable_notes_query")

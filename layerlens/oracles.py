"""Independent DuckDB SQL for the registered queries, over the same order tables."""

from __future__ import annotations

VIEWS = """
levels AS (SELECT CAST(p_partkey AS BIGINT) AS root_id, CAST(p_size AS DOUBLE) + CAST(p_partkey AS DOUBLE) / 1000000 AS score, CAST(5 - FLOOR((p_size - 1) / 10.0) AS INT) AS y_level FROM part),
classification AS (SELECT CAST(p_partkey AS BIGINT) AS root_id, CASE p_type WHEN 'ECONOMY' THEN 'sensory' WHEN 'LARGE' THEN 'optic' WHEN 'MEDIUM' THEN 'central' WHEN 'PROMO' THEN 'visual_projection' WHEN 'SMALL' THEN 'motor' ELSE 'descending' END AS super_class FROM part),
codes(i, code) AS (VALUES (0,'ME'),(1,'LO'),(2,'AL'),(3,'MB_CA'),(4,'LH')),
neurons AS (SELECT CAST(p.p_partkey AS BIGINT) AS root_id,
    CASE WHEN p.b = 25 THEN 'NO_CONS' WHEN p.b = 24 THEN NULL WHEN x.code = y.code THEN x.code WHEN x.code < y.code THEN x.code || '.' || y.code ELSE y.code || '.' || x.code END AS grp,
    CASE p.p_partkey % 7 WHEN 0 THEN 'ACH' WHEN 1 THEN 'GABA' WHEN 2 THEN 'GLUT' WHEN 3 THEN 'DA' WHEN 4 THEN 'SER' WHEN 5 THEN 'OCT' END AS nt_type, CAST(p.p_partkey % 100 AS DOUBLE) / 100 AS nt_type_score
  FROM (SELECT p_partkey, CAST(substring(p_brand, 7) AS INT) AS b FROM part) p JOIN codes x ON x.i = p.b % 5 JOIN codes y ON y.i = CAST(FLOOR(p.b / 5.0) AS INT) % 5),
connections AS (SELECT CAST(a.l_partkey AS BIGINT) AS pre_root_id, CAST(b.l_partkey AS BIGINT) AS post_root_id, a.l_returnflag AS neuropil, CAST(SUM(a.l_quantity) AS BIGINT) AS syn_count
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY ALL),
ebin AS (SELECT DISTINCT pre_root_id AS pre, post_root_id AS post FROM connections WHERE syn_count > 0),
esyn AS (SELECT pre_root_id AS pre, post_root_id AS post, CAST(SUM(syn_count) AS BIGINT) AS syn FROM connections GROUP BY ALL),
region AS (SELECT root_id, grp, list_sort(list_distinct(list_transform(string_split(grp, '.'), lambda t: CASE WHEN t IN ('ME','LO') THEN 'OL' WHEN t = 'MB_CA' THEN 'MB' ELSE t END))) AS r FROM neurons WHERE grp IS NOT NULL AND grp <> 'NO_CONS')
"""


def work(grouping: str = "group", window: str = "(1,2,3)") -> str:
    """CTEs work, e (annotated edges between metanodes), sizes, meta."""
    nodes = {"group": "SELECT root_id, grp AS area FROM neurons WHERE grp IS NOT NULL AND grp <> 'NO_CONS'", "superregion": "SELECT root_id, array_to_string(r, '.') AS area FROM region", "superclass": "SELECT root_id, super_class AS area FROM classification WHERE super_class IS NOT NULL"}[grouping]
    return f"""{VIEWS},
work AS (SELECT n.root_id, n.area, l.y_level AS lvl FROM ({nodes}) n JOIN levels l USING (root_id) WHERE l.y_level IN {window}),
e AS (SELECT g.pre, g.post, a.area AS sa, a.lvl AS sl, b.area AS da, b.lvl AS dl FROM ebin g JOIN work a ON a.root_id = g.pre JOIN work b ON b.root_id = g.post WHERE abs(a.lvl - b.lvl) <= 1 AND NOT (a.area = b.area AND a.lvl = b.lvl)),
sizes AS (SELECT area, lvl, COUNT(*) AS n FROM work GROUP BY ALL),
meta AS (SELECT sa, sl, da, dl, COUNT(*) AS n FROM e GROUP BY ALL),
fin AS (SELECT post AS i, sa AS area, sl AS lvl, COUNT(*) AS v FROM e GROUP BY ALL),
fout AS (SELECT pre AS i, da AS area, dl AS lvl, COUNT(*) AS v FROM e GROUP BY ALL)"""


def side(flow: str, name: str, k: int, area: str, level: str) -> str:
    tables = f"{flow} f0" + "".join(f" JOIN {flow} f{n} ON f{n}.i = f0.i AND (f{n - 1}.area, f{n - 1}.lvl) < (f{n}.area, f{n}.lvl)" for n in range(1, k))
    columns = ", ".join(f"f{n}.area AS {area}{n}, f{n}.lvl AS {level}{n}" for n in range(k))
    return f"{name} AS (SELECT f0.i, {columns}, {' * '.join(f'f{n}.v' for n in range(k))} AS p FROM {tables})"


def arrow(a: str, b: str) -> str:
    return f"CASE WHEN {a} < {b} THEN 'FWD' WHEN {a} > {b} THEN 'BWD' ELSE 'LAT' END"


def bowtie(k_in: int = 2, k_out: int = 2, min_count: int = 1, grouping: str = "group", window: str = "(1,2,3)") -> str:
    """CTEs up to mot: full motif rows."""
    keys = [f"{c}{n}" for n in range(k_in) for c in "al"] + [f"{c}{n}" for n in range(k_out) for c in "dm"]
    apart = " AND ".join(f"NOT (a{x} = d{y} AND l{x} = m{y})" for x in range(k_in) for y in range(k_out))
    ins, outs = [arrow(f"l{n}", "bl") for n in range(k_in)], [arrow("bl", f"m{n}") for n in range(k_out)]
    both = lambda d: "[" + ", ".join(d) + "]"
    one = lambda d: f"CASE WHEN len(list_distinct({both(d)})) = 1 THEN {d[0]} ELSE 'mix' END"
    ends = [(f"a{n}", f"l{n}", f"fan_in_{n}") for n in range(k_in)] + [(f"d{n}", f"m{n}", f"fan_out_{n}") for n in range(k_out)]
    text = lambda some: " || ', ' || ".join(f"{a} || 'L' || {b}" for a, b, _ in some)
    size = lambda a, b: f"(SELECT s.n FROM sizes s WHERE s.area = {a} AND s.lvl = {b})"
    joins = "".join(f" JOIN sizes s{i} ON s{i}.area = {a} AND s{i}.lvl = {b}" for i, (a, b, _) in enumerate(ends))
    periphery = " + ".join(f"s{i}.n" for i in range(len(ends)))
    return f"""{work(grouping, window)},
{side("fin", "pin", k_in, "a", "l")},
{side("fout", "pout", k_out, "d", "m")},
m AS (SELECT w.area AS ba, w.lvl AS bl, {", ".join(keys)}, CAST(SUM(x.p * y.p) AS BIGINT) AS c, COUNT(*) AS act, SUM(CAST(x.p * y.p AS DOUBLE) * CAST(x.p * y.p AS DOUBLE)) AS ssq
  FROM pin x JOIN pout y USING (i) JOIN work w ON w.root_id = x.i WHERE {apart} GROUP BY ALL HAVING SUM(x.p * y.p) >= {min_count}),
signed AS (SELECT *, {one(ins)} AS fis, {one(outs)} AS fos, {both(ins + outs)} AS dirs FROM m),
mot AS (SELECT c AS motif_count, CASE WHEN len(list_distinct(dirs)) = 1 THEN 'pure_' || dirs[1] ELSE 'mixed' END AS hourglass_type, fis || '->' || fos AS signature, fis AS fanin_sig, fos AS fanout_sig,
    {", ".join(f"CAST(len(list_filter(dirs, lambda x: x = '{d}')) AS INT) AS n_{d}" for d in ("FWD", "BWD", "LAT"))},
    sb.n AS n_waist, act AS n_waist_active, round(CAST(c AS DOUBLE) * CAST(c AS DOUBLE) / ssq, 3) AS n_waist_eff, {periphery} AS n_periphery, round(CAST({periphery} AS DOUBLE) / sb.n, 3) AS compression,
    ba AS bottleneck_area, bl AS bottleneck_level, {k_in} AS k_in, {k_out} AS k_out, '[' || {text(ends[:k_in])} || '] -> ' || ba || 'L' || bl || ' -> [' || {text(ends[k_in:])} || ']' AS structure_str,
    {", ".join(f"{a} AS {n}_area, {b} AS {n}_level" for a, b, n in ends)}
  FROM signed JOIN sizes sb ON sb.area = ba AND sb.lvl = bl{joins})"""


def q(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{body.strip()}"


def motif(body: str, **kw) -> str:
    return q(bowtie(**kw), body)


NT = """,
nt AS (SELECT root_id, grp, CASE WHEN coalesce(nt_type_score, -1) < 0.5 THEN 'U' WHEN nt_type = 'ACH' THEN 'E' WHEN nt_type IN ('GABA','GLUT') THEN 'I' WHEN nt_type IN ('DA','SER','OCT') THEN 'M' ELSE 'U' END AS nt FROM neurons),
de AS (SELECT g.pre, n.grp, CASE WHEN a.y_level < b.y_level THEN 'FWD' WHEN a.y_level > b.y_level THEN 'BWD' ELSE 'LAT' END AS direction, n.nt, g.syn FROM esyn g JOIN levels a ON a.root_id = g.pre JOIN levels b ON b.root_id = g.post JOIN nt n ON n.root_id = g.pre),
dg AS (SELECT * FROM de WHERE nt IN ('E','I') AND grp IS NOT NULL AND grp <> 'NO_CONS')"""

DECOMPOSED = """,
ntc AS (SELECT root_id, CASE WHEN coalesce(nt_type_score, -1) < 0.5 THEN 'U' WHEN nt_type = 'ACH' THEN 'E' WHEN nt_type IN ('GABA','GLUT') THEN 'I' WHEN nt_type IN ('DA','SER','OCT') THEN 'M' ELSE 'U' END AS nt FROM neurons),
fnt AS (SELECT post AS i, sa AS area, sl AS lvl, nt, COUNT(*) AS v FROM e JOIN ntc ON ntc.root_id = e.pre GROUP BY ALL),
parts AS (SELECT w.area, w.lvl, x.area AS a0, x.lvl AS l0, y.area AS a1, y.lvl AS l1, d0, m0, d1, m1, x.nt AS nt0, y.nt AS nt1, CAST(SUM(x.v * y.v * z.p) AS BIGINT) AS motif_count
  FROM fnt x JOIN fnt y ON x.i = y.i AND (x.area, x.lvl) < (y.area, y.lvl) JOIN pout z ON z.i = x.i JOIN work w ON w.root_id = x.i
  WHERE NOT (x.area = d0 AND x.lvl = m0) AND NOT (x.area = d1 AND x.lvl = m1) AND NOT (y.area = d0 AND y.lvl = m0) AND NOT (y.area = d1 AND y.lvl = m1) GROUP BY ALL)"""

AREA = """,
mem AS (SELECT unnest(list_distinct(string_split(n.grp, '.'))) AS area, n.root_id, l.y_level AS lvl FROM neurons n JOIN levels l USING (root_id) WHERE n.grp IS NOT NULL AND n.grp <> 'NO_CONS'),
ae AS (SELECT a.area, g.pre, g.post, a.lvl AS l_pre, b.lvl AS l_post FROM ebin g JOIN mem a ON a.root_id = g.pre JOIN mem b ON b.root_id = g.post AND b.area = a.area WHERE g.pre <> g.post)"""

#: Bow-ties of five distinct nodes by enumeration of neighbour pairs, not by the closed form.
WITHIN = AREA + """,
inp AS (SELECT x.area, x.post AS i, x.pre AS u, y.pre AS v, CASE WHEN x.l_pre < x.l_post THEN 'FWD' WHEN x.l_pre = x.l_post THEN 'LAT' ELSE 'BWD' END AS du, CASE WHEN y.l_pre < y.l_post THEN 'FWD' WHEN y.l_pre = y.l_post THEN 'LAT' ELSE 'BWD' END AS dv FROM ae x JOIN ae y ON x.area = y.area AND x.post = y.post AND x.pre < y.pre),
outp AS (SELECT x.area, x.pre AS i, x.post AS s, y.post AS t, CASE WHEN x.l_pre < x.l_post THEN 'FWD' WHEN x.l_pre = x.l_post THEN 'LAT' ELSE 'BWD' END AS ds, CASE WHEN y.l_pre < y.l_post THEN 'FWD' WHEN y.l_pre = y.l_post THEN 'LAT' ELSE 'BWD' END AS dt FROM ae x JOIN ae y ON x.area = y.area AND x.pre = y.pre AND x.post < y.post),
w AS (SELECT p.area, p.i, CASE WHEN du = dv THEN du ELSE 'mix' END || '->' || CASE WHEN ds = dt THEN ds ELSE 'mix' END AS signature FROM inp p JOIN outp o ON p.area = o.area AND p.i = o.i AND u <> s AND u <> t AND v <> s AND v <> t),
areas AS (SELECT DISTINCT area FROM ae),
sigs AS (SELECT x.b || '->' || y.b AS signature FROM (VALUES ('FWD'),('LAT'),('BWD'),('mix')) x(b), (VALUES ('FWD'),('LAT'),('BWD'),('mix')) y(b)),
prof AS (SELECT a.area, s.signature, CAST(COUNT(w.i) AS DOUBLE) AS n FROM areas a CROSS JOIN sigs s LEFT JOIN w ON w.area = a.area AND w.signature = s.signature GROUP BY ALL),
shares AS (SELECT area, signature, n, n / nullif(SUM(n) OVER (PARTITION BY area), 0) AS share FROM prof)"""

HOPS = 5


def paths(routing: str = "levels") -> str:
    """CTEs for paths of at most ``HOPS`` hops: fe (edges), src, tgt, a and b (counts from sources and to targets), cen (centrality)."""
    forward = {"levels": "a.y_level < b.y_level", "score": "a.score > b.score"}[routing]
    steps = range(1, HOPS + 1)
    return f""",
fe AS (SELECT g.pre, g.post FROM esyn g JOIN levels a ON a.root_id = g.pre JOIN levels b ON b.root_id = g.post WHERE g.syn >= 5 AND {forward}),
src AS (SELECT root_id AS v FROM classification WHERE super_class = 'sensory'),
tgt AS (SELECT root_id AS v FROM classification WHERE super_class IN ('motor', 'descending')),
a0 AS (SELECT v, CAST(1 AS DOUBLE) AS n FROM src),
""" + ",\n".join(f"a{h} AS (SELECT post AS v, SUM(n) AS n FROM a{h - 1} JOIN fe ON pre = v GROUP BY post)" for h in steps) + """,
b0 AS (SELECT v, CAST(1 AS DOUBLE) AS n FROM tgt),
""" + ",\n".join(f"b{h} AS (SELECT pre AS v, SUM(n) AS n FROM b{h - 1} JOIN fe ON post = v GROUP BY pre)" for h in steps) + """,
a AS (""" + " UNION ALL ".join(f"SELECT v, {h} AS h, n FROM a{h}" for h in range(HOPS + 1)) + """),
b AS (""" + " UNION ALL ".join(f"SELECT v, {h} AS h, n FROM b{h}" for h in range(HOPS + 1)) + f"""),
cen AS (SELECT a.v, SUM(a.n * b.n) AS p FROM a JOIN b ON a.v = b.v AND a.h + b.h <= {HOPS} GROUP BY a.v)"""


PATHS = paths()

#: Longest paths and counts of paths of any length, hop by hop until none goes on.
UNBOUNDED = """,
deep AS (SELECT v, 0 AS h FROM (SELECT pre AS v FROM fe UNION SELECT post FROM fe) UNION SELECT post, h + 1 FROM deep JOIN fe ON pre = v),
fro AS (SELECT v, 0 AS h, CAST(1 AS DOUBLE) AS n FROM src UNION ALL SELECT post, h + 1, SUM(n) FROM fro JOIN fe ON pre = v GROUP BY post, h + 1),
bac AS (SELECT v, 0 AS h, CAST(1 AS DOUBLE) AS n FROM tgt UNION ALL SELECT pre, h + 1, SUM(n) FROM bac JOIN fe ON post = v GROUP BY pre, h + 1),
fros AS (SELECT v, SUM(n) AS n FROM fro GROUP BY v),
bacs AS (SELECT v, SUM(n) AS n FROM bac GROUP BY v)"""

BOTH = """,
micro AS (SELECT bottleneck_area AS area, bottleneck_level AS lvl, CAST(SUM(motif_count) AS BIGINT) AS micro FROM mot GROUP BY ALL),
macro AS (SELECT w.area, w.lvl, SUM(p) AS macro FROM cen JOIN work w ON w.root_id = cen.v GROUP BY ALL),
two AS (SELECT coalesce(x.area, y.area) AS area, coalesce(x.lvl, y.lvl) AS lvl, CAST(coalesce(micro, 0) AS DOUBLE) AS micro, coalesce(macro, 0) AS macro FROM micro x FULL JOIN macro y ON x.area = y.area AND x.lvl = y.lvl)"""


def coherence(column: str, name: str = "") -> str:
    """CTEs for one granularity, with names ending in ``name``."""
    rows = {"super_class": "SELECT c.super_class AS category, l.y_level AS lvl FROM classification c JOIN levels l USING (root_id)", "superregion": "SELECT array_to_string(r, '.') AS category, l.y_level AS lvl FROM region JOIN levels l USING (root_id)", "group": "SELECT n.grp AS category, l.y_level AS lvl FROM neurons n JOIN levels l USING (root_id) WHERE n.grp IS NOT NULL AND n.grp <> 'NO_CONS'"}[column]
    return f""",
cat{name} AS ({rows}),
cc{name} AS (SELECT category, lvl, COUNT(*) AS c FROM cat{name} GROUP BY ALL),
cp{name} AS (SELECT *, c / SUM(c) OVER (PARTITION BY category) AS p FROM cc{name}),
coh{name} AS (SELECT category, CAST(SUM(c) AS BIGINT) AS n, arg_max(lvl, c * 100 - lvl) AS mode_level, MAX(p) AS purity, -SUM(p * log2(p)) AS entropy, COUNT(*) AS n_levels, COUNT(*) FILTER (p >= 0.05) AS n_levels_5pct,
   COUNT(*) FILTER (p >= 0.05) <= 1 OR MAX(lvl) FILTER (p >= 0.05) - MIN(lvl) FILTER (p >= 0.05) + 1 = COUNT(*) FILTER (p >= 0.05) AS contiguous, sqrt(greatest(SUM(p * lvl * lvl) - SUM(p * lvl) * SUM(p * lvl), 0)) AS spread FROM cp{name} GROUP BY category),
mi{name} AS (SELECT SUM(c / n * log2(c * CAST(n AS DOUBLE) / (cx * cy))) AS mi FROM (SELECT c, SUM(c) OVER () AS n, CAST(SUM(c) OVER (PARTITION BY category) AS DOUBLE) AS cx, CAST(SUM(c) OVER (PARTITION BY lvl) AS DOUBLE) AS cy FROM cc{name})),
hl{name} AS (SELECT -SUM(cy / n * log2(cy / n)) AS h FROM (SELECT SUM(c) AS cy, SUM(SUM(c)) OVER () AS n FROM cc{name} GROUP BY lvl))"""


def rounded(body: str, *columns: str, digits: int = 6) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM ({body.strip()})"

#: Connected patterns of 3 and 4 nodes: all sets of arcs, each under its least relabelling.
CATALOGUE = """WITH ks(k) AS (VALUES (3), (4)),
arcs AS (SELECT k, a, b, row_number() OVER (PARTITION BY k ORDER BY a, b) - 1 AS i FROM ks, range(4) x(a), range(4) y(b) WHERE a <> b AND a < k AND b < k),
masks AS (SELECT k, m FROM ks, range(1, 4096) t(m) WHERE m < (1 << (k * (k - 1)))),
es AS (SELECT k, m, a, b FROM masks JOIN arcs USING (k) WHERE (m >> i) & 1 = 1),
perms AS (SELECT k, [x.v, y.v, z.v, w.v] AS p FROM ks, range(4) x(v), range(4) y(v), range(4) z(v), range(4) w(v) WHERE x.v < k AND y.v < k AND z.v < k AND len(list_distinct([x.v, y.v, z.v, w.v])) = 4),
texts AS (SELECT k, m, p, string_agg(p[a + 1] || '>' || p[b + 1], ';' ORDER BY p[a + 1], p[b + 1]) AS t FROM es JOIN perms USING (k) GROUP BY k, m, p),
kinds AS (SELECT k, pattern, MIN(m) AS m FROM (SELECT k, m, MIN(t) AS pattern FROM texts GROUP BY k, m) GROUP BY ALL),
arc AS (SELECT k, pattern, a, b FROM kinds JOIN es USING (k, m)),
lines AS (SELECT k, pattern, a, b FROM arc UNION SELECT k, pattern, b, a FROM arc),
near AS (SELECT * FROM lines UNION SELECT k, pattern, x, x FROM kinds, range(4) r(x)),
whole AS (SELECT k, pattern FROM near o JOIN near p USING (k, pattern) JOIN near q USING (k, pattern) WHERE o.a = 0 AND p.a = o.b AND q.a = p.b GROUP BY ALL HAVING COUNT(DISTINCT q.b) = k),
degrees AS (SELECT k, pattern, SUM(d) / 2 AS n, MAX(d) AS top FROM (SELECT k, pattern, a, COUNT(*) AS d FROM lines GROUP BY ALL) GROUP BY ALL)
SELECT pattern, k AS nodes, bit_count(m)::INT AS edges, CASE WHEN n <> k - 1 THEN 'cyclic' WHEN top <= 2 THEN 'path' WHEN top = k - 1 THEN 'star' ELSE 'tree' END AS shape,
  CASE WHEN n = k - 1 THEN 1 WHEN n = 6 THEN 3 ELSE 2 END AS treewidth, n = k - 1 AS factorises FROM kinds JOIN whole USING (k, pattern) JOIN degrees USING (k, pattern)"""

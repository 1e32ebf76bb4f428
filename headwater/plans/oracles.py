"""The registered queries once more as DuckDB SQL over the sample tables.

For the script and DDL collections the expected facts are stated per text shape, so nothing
here analyses SQL text the way the library does.
"""

from __future__ import annotations

from ..sources import corpus


def _sql_text(shapes: list[str], key: str, parts: dict[str, str]) -> str:
    whens = []
    for m, shape in enumerate(shapes):
        expr = "'" + shape.replace("'", "''") + "'"
        for name, value in parts.items():
            expr = f"replace({expr}, '{{{name}}}', {value})"
        whens.append(f"WHEN {m} THEN {expr}")
    return f"CASE {key} " + " ".join(whens) + " END"


_BODY = _sql_text(corpus._SHAPES, "p_partkey % 10", {
    "target": "'[DW].[dbo].[FACT_' || p_partkey || ']'",
    "feed": "CASE WHEN p_partkey > 0 THEN '[ODS].[dbo].[FACT_' || (p_partkey // 2) || ']' ELSE '[ODS].[dbo].[SRC_0]' END",
    "dim": "'[DW].[dbo].[DIM_' || (p_partkey % 40) || ']'",
    "words": "p_name", "name": "'sp_load_' || p_partkey", "size": "cast(p_size AS varchar)",
})

# Scripts: k the part, m its text shape, tgt/feed/dim the tables, txt the text.
S = f"""s AS (SELECT p_partkey AS k, p_partkey % 10 AS m, upper(p_name) AS w, p_name, p_size,
  'sp_' || p_partkey || '.sql' AS source_file, 'FACT_' || p_partkey AS tgt,
  CASE WHEN p_partkey > 0 THEN 'FACT_' || (p_partkey // 2) ELSE 'SRC_0' END AS feed,
  'DIM_' || (p_partkey % 40) AS dim,
  CASE WHEN p_partkey % 10 = 4 THEN 'USE [DW];' || chr(10) || 'GO' || chr(10) ELSE '' END ||
  'CREATE PROCEDURE [dbo].[sp_load_' || p_partkey || ']' || chr(10) || 'AS' || chr(10) || 'BEGIN' || chr(10) ||
  {_BODY} || chr(10) || 'END' || chr(10) AS txt FROM part)"""

_WIDE = "('9',4,'ENDDATE','f','ENDDATE','direct_copy','s.EndDate','{f}.EndDate')," + ",".join(
    f"('9',{i - 1},'C{i}','f','C{i}','direct_copy','s.c{i}','{{f}}.c{i}')" for i in range(6, 17))

# Per shape: item, target column, side ('f' feed, 'd' dim, '' none), source column, class, text, resolved text.
MAP = f"""mp(m, item, tcol, side, scol, typ, txt, res) AS (SELECT cast(c0 AS bigint), * EXCLUDE (c0) FROM (VALUES
  ('0',0,'A','f','A','direct_copy','s.a','{{f}}.a'), ('0',1,'TOTAL QTY','f','B','direct_copy','s.b','{{f}}.b'),
  ('1',0,'REGION','d','REGION','direct_copy','d.region','{{d}}.region'), ('1',1,'TOTAL','f','AMT','aggregation','SUM(s.amt)','SUM({{f}}.amt)'),
  ('2',0,'{{W}} START','f','{{W}} DATE','direct_copy','s.[{{w}} Date]','{{f}}.{{w}} Date'),
  ('3',0,'C1','f','C1','direct_copy','a.c1','{{f}}.c1'), ('3',1,'C2','f','C2','direct_copy','a.c2','{{f}}.c2'),
  ('4',0,'NOTE','','''-- not a comment''','constant','''-- not a comment''','''-- not a comment'''),
  ('4',1,'QTY','f','QTY','direct_copy','s.qty','{{f}}.qty'),
  ('5',0,'AMT','f','AMT','direct_copy','s.amt','{{f}}.amt'), ('5',1,'ID','f','ID','direct_copy','s.id','{{f}}.id'),
  ('6',0,'A','f','A','direct_copy','c.a','{{f}}.a'), ('6',1,'NAME','d','NAME','direct_copy','d.name','{{d}}.name'),
  ('7',0,'A','f','A','direct_copy','q.a','{{f}}.a'),
  ('9',0,'F1','f','C1','conditional','CASE WHEN s.c1 > {{p}} THEN ''x,y'' ELSE ''z'' END','CASE WHEN {{f}}.c1 > {{p}} THEN ''x,y'' ELSE ''z'' END'),
  ('9',1,'F2','f','C2','calculation','FLOOR(s.c2/2)','FLOOR({{f}}.c2/2)'),
  ('9',2,'F3','','1','constant','1','1'), ('9',3,'F4','','''k''','constant','''k''','''k'''),
  {_WIDE}) t(c0, item, tcol, side, scol, typ, txt, res))"""

_put = lambda c: f"replace(replace(replace(replace(replace({c}, '{{f}}', feed), '{{d}}', dim), '{{W}}', w), '{{w}}', p_name), '{{p}}', cast(p_size AS varchar))"

# Mappings of every script; '' as side means no source table.
MAPPED = f"""mapped AS (SELECT source_file, k, s.m, item, tgt, feed, dim, {_put('tcol')} AS tcol,
  CASE side WHEN 'f' THEN feed WHEN 'd' THEN dim ELSE '' END AS stab, {_put('scol')} AS scol, typ,
  {_put('mp.txt')} AS item_txt, {_put('res')} AS res FROM s JOIN mp ON s.m = mp.m)"""

PRED = """pr(m, item, conn, txt, res) AS (VALUES
  (1,0,'','s.x = 1','{f}.x = 1'), (1,1,'AND','s.y BETWEEN 1 AND 5','{f}.y BETWEEN 1 AND 5'),
  (2,0,'','s.[{w} Date] >= ''2020-01-01''','{f}.{w} Date >= ''2020-01-01'''), (4,0,'','s.qty > @d','{f}.qty > @d'),
  (7,0,'','q.a > 0','{f}.a > 0'), (7,1,'OR','q.a IS NULL','{f}.a IS NULL'),
  (9,0,'','s.BRAND = 1','{f}.BRAND = 1'), (9,1,'AND','s.EndDate > ''2020-01-01''','{f}.EndDate > ''2020-01-01'''))"""

# DML statements: from `a` (skipping its first `skip` characters) up to `b` without its last character.
STATEMENTS = """t(m, stmt_no, type, has_select, a, skip, b) AS (VALUES (0,1,'INSERT',true,'INSERT',0,'s;'), (1,1,'INSERT',true,'INSERT',0,'d.region;'),
  (2,1,'INSERT',true,'INSERT',0,'01'';'), (3,1,'DELETE',false,'DELETE',0,'id = 1;'), (3,2,'DELETE',false,'id = 1;' || chr(10) || 'DELETE',8,'id = 2;'),
  (3,3,'INSERT',true,'INSERT',0,'] a;'), (4,1,'INSERT',true,'INSERT INTO [',0,'@d;'), (5,1,'MERGE',true,'MERGE',0,'amt);'),
  (6,1,'INSERT',true,'WITH',0,'d.id;'), (7,1,'INSERT',true,'INSERT',0,'NULL;'), (9,1,'INSERT',true,'INSERT',0,'c6;')),
  st AS (SELECT source_file, stmt_no, type, has_select,
    substring(txt, strpos(txt, a) + skip, strpos(txt, b) + length(b) - 1 - strpos(txt, a) - skip) AS txt FROM s JOIN t USING (m))"""

# Clauses of the primary statement; table names are shortened to one form with as many tokens.
CLAUSES = """cl(m, clause, txt) AS (VALUES (0,'INSERT','INSERT'), (0,'INTO','INTO [a].[b].[c] (a, [Total Qty])'), (0,'SELECT','SELECT s.a, s.b AS [Total Qty]'),
  (0,'FROM','FROM [a].[b].[c] s'), (1,'INSERT','INSERT'), (1,'INTO','INTO [a].[b].[c] (region, total)'), (1,'SELECT','SELECT d.region, SUM(s.amt) AS total'),
  (1,'FROM','FROM [a].[b].[c] s'), (1,'SIDE','LEFT'), (1,'JOIN','JOIN [a].[b].[c] AS d'), (1,'ON','ON s.id = d.id'), (1,'WHERE','WHERE s.x = 1 AND s.y BETWEEN 1 AND 5'),
  (1,'GROUP','GROUP BY d.region'), (2,'INSERT','INSERT'), (2,'INTO','INTO [a].[b].[c] ([x Start])'), (2,'SELECT','SELECT s.[x Date] AS [x Start]'),
  (2,'FROM','FROM [a].[b].[c] s'), (2,'WHERE','WHERE s.[x Date] >= ''2020'''), (3,'INSERT','INSERT'), (3,'INTO','INTO [a].[b].[c] (c1, c2)'),
  (3,'SELECT','SELECT a.c1, a.c2'), (3,'FROM','FROM [a].[b].[c] a'), (4,'INSERT','INSERT'), (4,'INTO','INTO [a].[b].[c] (note, qty)'),
  (4,'SELECT','SELECT ''--'' AS note, s.qty'), (4,'FROM','FROM [a].[b].[c] s'), (4,'WHERE','WHERE s.qty > @d'), (5,'MERGE','MERGE [a].[b].[c] AS t'),
  (5,'USING','USING [a].[b].[c] AS s'), (5,'ON','ON t.id = s.id'), (5,'WHEN','WHEN MATCHED THEN WHEN NOT MATCHED THEN'), (5,'UPDATE','UPDATE'),
  (5,'SET','SET t.amt = s.amt'), (5,'INSERT','INSERT (id, amt)'), (5,'VALUES','VALUES (s.id, s.amt)'), (6,'WITH','WITH c AS (SELECT f.a, f.id FROM [a].[b].[c] f)'),
  (6,'INSERT','INSERT'), (6,'INTO','INTO [a].[b].[c] (a, name)'), (6,'SELECT','SELECT c.a, d.name'), (6,'FROM','FROM c'), (6,'JOIN','JOIN [a].[b].[c] d'),
  (6,'ON','ON c.id = d.id'), (7,'INSERT','INSERT'), (7,'INTO','INTO [a].[b].[c] (a)'), (7,'SELECT','SELECT q.a'),
  (7,'FROM','FROM (SELECT x.a FROM [a].[b].[c] x WHERE x.b IN (1,2)) q'), (7,'WHERE','WHERE q.a > 0 OR q.a IS NULL'), (9,'INSERT','INSERT'), (9,'INTO','INTO [a].[b].[c]'),
  (9,'SELECT','SELECT CASE WHEN s.c1 > 1 THEN ''x'' ELSE ''z'' END AS f1, FLOOR(s.c2/2) AS f2, 1 AS f3, ''k'' AS f4, s.EndDate, s.c6, s.c7, s.c8, s.c9, s.c10, s.c11, s.c12, s.c13, s.c14, s.c15, s.c16'),
  (9,'FROM','FROM [a].[b].[c] s'), (9,'WHERE','WHERE s.BRAND = 1 AND s.EndDate > ''2020'''), (9,'ORDER','ORDER BY s.c6'))"""

EDGES = """edge AS (SELECT feed AS src, tgt AS dst, s.* FROM s WHERE m <> 8 UNION ALL
  SELECT dim AS src, tgt AS dst, s.* FROM s WHERE m = 1 OR m = 6)"""
NODES = "node AS (SELECT DISTINCT unnest([src, dst]) AS id FROM edge)"
COUNTS = """cnt(m, n_map, n_join, n_filter, n_group) AS (VALUES (0,2,0,0,0), (1,2,1,2,1), (2,1,0,1,0), (3,2,0,0,0),
  (4,2,0,1,0), (5,2,0,0,0), (6,2,1,0,0), (7,1,0,2,0), (9,16,0,2,0))"""

_DDL_TXT = _sql_text(corpus._DDL_SHAPES, "s_suppkey % 4", {
    "key": "cast(s_suppkey AS varchar)", "prev": "cast(s_suppkey - 1 AS varchar)"})
DDL = f"""d AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m, 'ddl_' || s_suppkey || '.sql' AS source_file, {_DDL_TXT} AS txt,
  CASE s_suppkey % 4 WHEN 0 THEN 'SUP ' || s_suppkey WHEN 1 THEN 'FACT_' || s_suppkey WHEN 2 THEN 'SUP_' || s_suppkey
    ELSE 'SUP_' || (s_suppkey - 1) END AS table_name,
  CASE s_suppkey % 4 WHEN 0 THEN 'DW.dbo.SUP ' || s_suppkey WHEN 1 THEN 'dbo.FACT_' || s_suppkey WHEN 2 THEN 'SUP_' || s_suppkey
    ELSE 'SUP_' || (s_suppkey - 1) END AS qualified_name,
  CASE s_suppkey % 4 WHEN 0 THEN 'DW' ELSE '' END AS database, CASE WHEN s_suppkey % 4 <= 1 THEN 'DBO' ELSE '' END AS schema,
  CASE s_suppkey % 4 WHEN 0 THEN 3 ELSE 2 END AS n_columns FROM supplier)"""
COLS = """col(m, column_no, name, type, nullable, primary_key) AS (VALUES (0,0,'Id','INT',false,true), (0,1,'Code','varchar(20)',false,true),
  (0,2,'Balance','decimal(18, 2)',true,false), (1,0,'id','INT',false,true), (1,1,'name','VARCHAR(50)',false,false),
  (2,0,'KeyCode','nvarchar(max)',true,false), (2,1,'OnSet','date',false,false), (3,0,'Id','BIGINT',false,true),
  (3,1,'Note','dbo.Text Type',true,false))"""
CAT = "cat AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY source_file DESC) = 1)"

_segment = " ".join(f"WHEN '{k}' THEN '{v.lower()}'" for k, v in corpus.SEGMENT_METHOD.items())
OVER = f"""o AS (SELECT 'SP_' || c_custkey || '.sql' AS source_file, CASE c_mktsegment {_segment} END AS method, 0 AS priority FROM customer
  UNION ALL SELECT 'SP_' || s_suppkey || '.sql', CASE WHEN s_acctbal < 0 THEN 'gemini' ELSE 'none' END, 1 FROM supplier),
  ov AS (SELECT * FROM o WHERE method IN ('regex','claude','gemini','nvidia')),
  om AS (SELECT lower(source_file) AS file_key, arg_max(method, priority) AS method FROM ov GROUP BY 1)"""
ROUTED = """routed AS (SELECT source_file, s.m, coalesce(om.method, CASE WHEN m = 8 THEN 'claude' ELSE 'regex' END) AS method,
  om.method IS NOT NULL AS is_override FROM s LEFT JOIN om ON om.file_key = s.source_file)"""
PLAN = """step(is_override, method, rank, next) AS (VALUES (false,'regex',0,'regex'), (false,'regex',1,'claude'), (false,'regex',2,'gemini'),
  (false,'claude',0,'claude'), (false,'claude',1,'gemini'),
  (true,'regex',0,'regex'), (true,'regex',1,'claude'), (true,'regex',2,'gemini'),
  (true,'claude',0,'claude'), (true,'claude',1,'regex'), (true,'claude',2,'gemini'),
  (true,'gemini',0,'gemini'), (true,'gemini',1,'regex'), (true,'gemini',2,'claude'),
  (true,'nvidia',0,'nvidia'), (true,'nvidia',1,'regex'), (true,'nvidia',2,'claude'), (true,'nvidia',3,'gemini')),
  plan AS (SELECT source_file, m, rank, next AS method, next <> 'nvidia' AS available FROM routed JOIN step USING (is_override, method))"""
ANSWERS = """ans AS (SELECT 'sp_' || conv_id || '.sql' AS source_file, CASE WHEN turn % 2 = 0 THEN 'claude' ELSE 'gemini' END AS method,
  bool_or(length(text) % 5 <> 0) AS ok FROM conversations GROUP BY 1, 2)"""
TRIED = """tried AS (SELECT plan.*, ans.ok AS answered, CASE WHEN plan.method = 'regex' THEN m <> 8 ELSE available AND coalesce(ans.ok, false) END AS ok
  FROM plan LEFT JOIN ans USING (source_file, method)),
  won AS (SELECT source_file, arg_min(method, rank) FILTER (WHERE ok) AS method FROM tried GROUP BY 1)"""
FLOW = """f AS (SELECT DISTINCT 'PART_' || l_partkey AS src, 'ORDER_' || l_orderkey AS dst FROM lineitem UNION ALL
  SELECT DISTINCT 'ORDER_' || o_orderkey, 'CUST_' || o_custkey FROM orders UNION ALL
  SELECT DISTINCT 'CUST_' || c_custkey, 'NATION_' || c_nationkey FROM customer UNION ALL
  SELECT DISTINCT 'NATION_' || n_nationkey, 'REGION_' || n_regionkey FROM nation)"""
CYCLES = """e AS (SELECT DISTINCT 'S_' || s_suppkey AS src, 'S_' || unnest([(3 * s_suppkey + 1) % n, (s_suppkey + 5) % n]) AS dst
  FROM supplier, (SELECT count(*) AS n FROM supplier))"""
_pairs = lambda rows: f"""c AS (SELECT src_t, 'C_' || j AS src_c, dst_t, 'C_' || ((j + 1) % 4) AS dst_c FROM ({rows}), (SELECT unnest(range(4)) AS j))"""
TREE_COLS = _pairs("SELECT 'P_' || (p_partkey // 2) AS src_t, 'P_' || p_partkey AS dst_t FROM part WHERE p_partkey > 0")
CYCLE_COLS = _pairs("SELECT 'S_' || s_suppkey AS src_t, 'S_' || ((3 * s_suppkey + 1) % n) AS dst_t FROM supplier, (SELECT count(*) AS n FROM supplier)")
TRACK = """done AS (SELECT 'sp' AS kind, 'sp_' || (o_orderkey % n) || '.sql' AS source_file, o_orderstatus, o_orderdate FROM orders, (SELECT count(*) AS n FROM part)
  UNION ALL SELECT 'schemas', 'ddl_' || (o_orderkey % n) || '.sql', o_orderstatus, o_orderdate FROM orders, (SELECT count(*) AS n FROM supplier)),
  tr AS (SELECT kind, source_file, CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'failed' END AS status,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS processed_at FROM done WHERE o_orderstatus IN ('F', 'O')
    QUALIFY row_number() OVER (PARTITION BY kind, source_file ORDER BY o_orderdate DESC, o_orderstatus DESC) = 1)"""


# The same by path, each file name in two folders.
FOLDER_TRACK = """fs AS (SELECT s.*, folder || source_file AS path FROM s, (VALUES ('a/'), ('b/')) f(folder)),
  ftr AS (SELECT path, o_orderstatus FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'a/' ELSE 'b/' END || 'sp_' || (o_orderkey % n) || '.sql' AS path,
      o_orderstatus, o_orderdate FROM orders, (SELECT count(*) AS n FROM part)) WHERE o_orderstatus IN ('F', 'O')
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY o_orderdate DESC, o_orderstatus DESC) = 1)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def _hops(edge: str, seeds: str, depth: int, up: bool, name: str = "r") -> str:
    near, far = ("dst", "src") if up else ("src", "dst")
    return f"""{name} AS (SELECT DISTINCT seed, seed AS node, 0 AS hop FROM ({seeds}) UNION
  SELECT {name}.seed, {edge}.{far}, hop + 1 FROM {name} JOIN {edge} ON {edge}.{near} = {name}.node WHERE hop < {depth})"""


_ALL = lambda e: f"SELECT unnest([src, dst]) AS seed FROM {e}"
_MIN = "SELECT seed, node, cast(min(hop) AS bigint) AS hop FROM r GROUP BY 1, 2"


def _out_chains(seeds: str) -> str:
    """Outbound chains over c(src_t, src_c, dst_t, dst_c): open paths, then their ends."""
    return f"""p AS (SELECT DISTINCT src_t AS st, src_c AS sc, src_t AS t, src_c AS col, [src_t || '.' || src_c] AS path, 0 AS depth FROM ({seeds})
  UNION ALL SELECT st, sc, dst_t, dst_c, list_append(path, dst_t || '.' || dst_c), depth + 1 FROM p JOIN c ON p.t = c.src_t AND p.col = c.src_c
  WHERE depth < 20 AND NOT list_contains(path, dst_t || '.' || dst_c)),
  nxt AS (SELECT p.*, dst_t || '.' || dst_c AS nk FROM p LEFT JOIN c ON p.t = c.src_t AND p.col = c.src_c),
  fin AS (SELECT st, sc, path, 'Not consumed by any other table' AS note, true AS leaf FROM nxt WHERE nk IS NULL
    UNION ALL SELECT st, sc, list_append(path, nk), CASE WHEN depth = 20 THEN 'cycle detected (max depth exceeded)' ELSE 'cycle detected' END, false
    FROM nxt WHERE nk IS NOT NULL AND (depth = 20 OR list_contains(path, nk)))"""


_CHAIN = "SELECT st AS seed_table, sc AS seed_column, array_to_string(path, '|') AS chain, cast(len(path) AS bigint) AS n_steps, note, leaf FROM fin"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_scripts"] = _with(S) + "SELECT source_file, length(txt) AS n_chars FROM s"
    q["scan_ddl"] = _with(DDL) + "SELECT source_file, length(txt) AS n_chars FROM d"
    q["store_roundtrip"] = _with(S, DDL, CAT, COUNTS) + """SELECT 'record' AS part, source_file AS id, cast(n_map AS bigint) AS n FROM s JOIN cnt USING (m)
      UNION ALL SELECT 'table', table_name, cast(n_columns AS bigint) FROM cat"""
    q["norm_table"] = """SELECT raw, result FROM (SELECT unnest([
      {'raw': ' [Db].[dbo].[' || c_name || ']', 'result': upper(c_name)}, {'raw': '"Db"."' || c_name || '"', 'result': upper(c_name)},
      {'raw': 'dbo.' || c_name, 'result': upper(c_name)}, {'raw': '[' || c_mktsegment || ' ' || c_name || ']', 'result': upper(c_mktsegment || ' ' || c_name)}], recursive := true) FROM customer)"""
    q["strip_brackets"] = "SELECT '[a].[' || url || ']' AS raw, 'a.' || replace(replace(url, '[', ''), ']', '') AS result FROM pages"
    q["split_qualified"] = """SELECT raw, db, schema, table_name FROM (SELECT unnest([
      {'raw': '[S.rv].[Db].[x y].[' || c_name || ']', 'db': 'Db', 'schema': 'x y', 'table_name': c_name},
      {'raw': 'dbo."' || c_name || '"', 'db': '', 'schema': 'dbo', 'table_name': c_name},
      {'raw': c_name, 'db': '', 'schema': '', 'table_name': c_name},
      {'raw': '`Db`.dbo.[' || c_mktsegment || '.x]', 'db': 'Db', 'schema': 'dbo', 'table_name': c_mktsegment || '.x'}], recursive := true) FROM customer)"""
    items = _with(S, MAP, MAPPED)
    q["classify_expr"] = items + "SELECT source_file, cast(item AS bigint) AS item_no, typ AS transformation_type, typ = 'constant' AS is_constant FROM mapped WHERE m <> 5"
    q["resolve_alias"] = items + "SELECT source_file, cast(item AS bigint) AS item_no, res AS resolved FROM mapped WHERE m <> 5"
    q["split_commas"] = items + "SELECT source_file, cast(item AS bigint) AS item_no, item_txt AS item FROM mapped WHERE m <> 5"
    n_tokens = r"cast(sum(len(regexp_extract_all(txt, $$'[^']*'|\[[^\]]*\]|[A-Za-z_@][A-Za-z0-9_@]*|[0-9]+|[^ \n]$$))) AS bigint) AS n_tokens"
    q["clean_scripts"] = _with(S, STATEMENTS) + f"SELECT source_file, {n_tokens} FROM st GROUP BY 1"
    preds = _with(S, PRED)
    q["split_predicates"] = preds + f"SELECT source_file, cast(item AS bigint) AS item_no, {_put('pr.txt')} AS item, conn AS connective FROM s JOIN pr ON s.m = pr.m"
    q["filter_facts"] = preds + f"SELECT source_file, cast(item AS bigint) AS seq, 'WHERE' AS clause, conn AS connective, {_put('res')} AS condition FROM s JOIN pr ON s.m = pr.m"
    q["statements"] = _with(S, STATEMENTS) + """SELECT source_file, cast(stmt_no AS bigint) AS stmt_no, type, has_select,
      cast(length(txt) AS bigint) AS n_chars FROM st"""
    q["primary_stmt"] = _with(S) + """SELECT source_file, cast(CASE WHEN m = 3 THEN 3 ELSE 1 END AS bigint) AS stmt_no,
      CASE WHEN m = 5 THEN 'MERGE' ELSE 'INSERT' END AS type FROM s WHERE m <> 8"""
    q["clause_bounds"] = _with(S, CLAUSES) + f"SELECT source_file, clause, {n_tokens} FROM (SELECT source_file, clause, cl.txt FROM s JOIN cl ON s.m = cl.m) GROUP BY 1, 2"
    q["procedure_names"] = _with(S) + "SELECT source_file, 'SP_LOAD_' || k AS procedure_name FROM s"
    q["target_tables"] = _with(S) + "SELECT source_file, tgt AS target_table FROM s WHERE m <> 8"
    q["source_tables"] = _with(S, EDGES) + "SELECT source_file, dst AS target_table, src AS source_table FROM edge"
    q["alias_map"] = _with(S, """t(m, alias, side) AS (VALUES (0,'s','f'), (1,'s','f'), (1,'d','d'), (2,'s','f'), (3,'a','f'), (4,'s','f'), (5,'s','f'),
      (5,'t','t'), (6,'f','f'), (6,'c','f'), (6,'d','d'), (7,'x','f'), (7,'q','f'), (9,'s','f'))""") + """
      SELECT source_file, alias, CASE side WHEN 'f' THEN feed WHEN 'd' THEN dim ELSE tgt END AS table_name FROM s JOIN t USING (m)
      UNION ALL SELECT source_file, lower(feed), feed FROM s WHERE m <> 8 UNION ALL SELECT source_file, lower(dim), dim FROM s WHERE m = 1 OR m = 6"""
    q["column_mappings"] = items + """SELECT source_file, cast(item AS bigint) AS seq, tcol AS target_column, stab AS source_table, scol AS source_column,
      typ AS transformation_type, CASE WHEN typ = 'constant' THEN 'Constant value: ' || item_txt ELSE replace(replace(item_txt, '[', ''), ']', '') END AS transformation_logic FROM mapped"""
    q["column_origins"] = """SELECT 'nest_' || p_partkey || '.sql' AS source_file, target_column,
        CASE side WHEN 'f' THEN 'SRC_' || p_partkey % 50 WHEN 'd' THEN 'DIM_' || p_partkey % 40 ELSE '' END AS source_table, source_column, transformation_type
      FROM part JOIN (VALUES (0, 'X', 'f', 'A', 'calculation'), (0, 'X', 'f', 'B', 'calculation'), (1, 'X', 'f', 'A', 'calculation'),
        (1, 'X', 'f', 'B', 'calculation'), (2, 'Z', 'f', 'U', 'calculation'), (2, 'KK', 'f', 'K', 'direct_copy'), (3, 'V', 'f', 'A', 'direct_copy'),
        (3, 'V', 'd', 'B', 'direct_copy'), (4, 'N', 'f', 'M', 'direct_copy'), (4, 'ONE', '', '1', 'constant'), (4, 'P', 'd', 'G', 'direct_copy'),
        (5, 'W', 'f', 'A', 'calculation'), (5, 'TOTAL', 'f', 'T', 'aggregation')) t(m, target_column, side, source_column, transformation_type)
      ON p_partkey % 6 = m"""
    q["join_facts"] = _with(S) + """SELECT source_file, cast(0 AS bigint) AS seq, feed AS left_table, dim AS right_table,
      CASE m WHEN 1 THEN 'LEFT' ELSE 'INNER' END AS join_type, feed || '.id = ' || dim || '.id' AS condition FROM s WHERE m = 1 OR m = 6"""
    q["grouping_facts"] = _with(S) + "SELECT source_file, cast(0 AS bigint) AS seq, dim || '.region' AS item FROM s WHERE m = 1"
    summary = """source_file, 'SP_LOAD_' || k AS procedure_name, {t} AS target_table, {s} AS sources_csv, cast(coalesce(n_map, 0) AS bigint) AS n_column_mappings,
      cast(coalesce(n_join, 0) AS bigint) AS n_joins, cast(coalesce(n_filter, 0) AS bigint) AS n_filters, cast(coalesce(n_group, 0) AS bigint) AS n_grouping"""
    csv = "CASE WHEN m = 1 OR m = 6 THEN dim || ',' || feed ELSE feed END"
    q["lineage_records"] = _with(S, COUNTS) + "SELECT " + summary.format(
        t="CASE WHEN m = 8 THEN '' ELSE tgt END", s=f"CASE WHEN m = 8 THEN '' ELSE {csv} END") + \
        ", CASE WHEN m = 8 THEN 'no_primary' ELSE '' END AS failure FROM s LEFT JOIN cnt USING (m)"
    q["lineage_normalised"] = _with(S, COUNTS) + "SELECT " + summary.format(t="tgt", s=csv) + " FROM s JOIN cnt USING (m)"
    q["lineage_qualified"] = _with(S) + """SELECT source_file, tgt AS target_table, 'DW.DBO.' || tgt AS target_table_qualified,
      CASE WHEN m = 1 OR m = 6 THEN 'DW.DBO.' || dim || ',' ELSE '' END || 'ODS.DBO.' || feed AS sources_csv FROM s WHERE m <> 8"""
    q["statement_records"] = _with(S) + f"SELECT source_file, tgt AS target_table, {csv} AS sources_csv FROM s WHERE m <> 8"

    count = lambda rx: f"len(regexp_extract_all(txt, '{rx}'))"
    flag = lambda rx: f"regexp_matches(txt, '{rx}')"
    signals = f"""sig AS (SELECT source_file, m, length(txt) - length(replace(txt, chr(10), '')) AS line_count,
      {count('(?i)INSERT[ ]+INTO|UPDATE|DELETE[ ]|MERGE')} AS statement_count, {count('(?i)(LEFT|INNER|RIGHT|FULL|CROSS) +JOIN')} AS join_count,
      {count('(?i)CASE WHEN')} AS case_when_count, {count('[(]SELECT')} AS nested_subquery_count, {flag('BEGIN TRY')} AS has_try_catch,
      {flag('sp_executesql')} AS has_dynamic_sql, {flag('CURSOR')} AS has_cursor, {flag('PIVOT')} AS has_pivot_unpivot, {flag('MERGE')} AS has_merge,
      {flag('WITH c AS [(]')} AS has_cte,
      cast(CASE m WHEN 2 THEN 1 WHEN 5 THEN 0 WHEN 7 THEN 1 WHEN 8 THEN 0 WHEN 9 THEN 16 ELSE 2 END AS bigint) AS max_select_column_count,
      {count('[[][A-Za-z]+ [A-Za-z ]+[]]')} AS bracketed_multiword_identifier_count FROM s)"""
    q["complexity_signals"] = _with(S, signals) + "SELECT * EXCLUDE (m) FROM sig"
    points = """t(m, score, reasons) AS (VALUES (0,0,''), (1,0,''), (2,0,''), (3,1,'multiple DML statements (3)'), (4,1,'multiple DML statements (3)'),
      (5,2,'multiple DML statements (2); MERGE statement detected'), (6,3,'nested subqueries (1); common table expression (WITH) detected'),
      (7,2,'nested subqueries (1)'), (8,3,'dynamic SQL detected'), (9,1,'wide SELECT list (16 columns)'))"""
    q["complexity_score"] = _with(S, points) + "SELECT source_file, cast(score AS bigint) AS score FROM s JOIN t USING (m)"
    q["complexity_reasons"] = _with(S, points) + "SELECT source_file, reasons FROM s JOIN t USING (m)"
    q["overrides_valid"] = _with(OVER) + "SELECT source_file, method, cast(priority AS bigint) AS priority FROM ov"
    q["overrides_merged"] = _with(OVER) + "SELECT file_key, method FROM om"
    q["route_methods"] = _with(S, OVER, ROUTED) + "SELECT source_file, method, is_override FROM routed"
    q["route_counts"] = _with(S, OVER, ROUTED) + "SELECT method, count(*) AS n FROM routed GROUP BY 1"
    q["attempt_plan"] = _with(S, OVER, ROUTED, PLAN) + "SELECT source_file, cast(rank AS bigint) AS rank, method, available FROM plan"
    tried = _with(S, OVER, ROUTED, PLAN, ANSWERS, TRIED)
    q["waterfall"] = tried + "SELECT source_file, method FROM won WHERE method IS NOT NULL"
    q["run_summary"] = tried + "SELECT coalesce(method, 'failed') AS method, count(*) AS n FROM won GROUP BY 1"
    err = lambda m: f"""coalesce(max(CASE WHEN method <> '{m}' THEN NULL WHEN NOT available THEN 'method forced by override is not available'
      WHEN method = 'regex' THEN 'no_primary' WHEN NOT answered THEN 'no valid answer' ELSE 'Returned None' END), 'Skipped (not attempted, started at later step)')"""
    q["failures_log"] = tried + f"""SELECT '2024-06-01T00:00:00Z' AS "timestamp", source_file, 'All attempted extraction steps failed' AS failure_reason,
      {err('regex')} AS step1_error, {err('claude')} AS step2_error, {err('gemini')} AS step3_error, {err('nvidia')} AS step4_error,
      substring(any_value(txt), 1, 300) AS sp_snippet FROM tried JOIN s USING (source_file) WHERE source_file IN (SELECT source_file FROM won WHERE method IS NULL) GROUP BY source_file"""
    ok = "length(text) % 5 <> 0"
    q["responses_parse"] = f"""SELECT conv_id, turn, {ok} AS is_valid, CASE WHEN {ok} THEN 'DW.dbo.ANS_' || conv_id ELSE '' END AS target_table,
      CASE WHEN {ok} THEN 'ODS.SRC_' || turn || ',B_' || conv_id ELSE '' END AS sources_csv, CASE WHEN {ok} THEN 'x = ''{{''' ELSE '' END AS first_filter,
      CASE WHEN {ok} THEN 'c d' ELSE '' END AS first_source_column FROM conversations"""

    q["ddl_tables"] = _with(DDL) + "SELECT source_file, table_name, qualified_name, database, schema, cast(n_columns AS bigint) AS n_columns FROM d"
    q["ddl_columns"] = _with(DDL, COLS) + "SELECT source_file, table_name, cast(column_no AS bigint) AS column_no, name, type, nullable, primary_key FROM d JOIN col USING (m)"
    q["ddl_primary_keys"] = _with(DDL, COLS) + "SELECT source_file, table_name, name FROM d JOIN col USING (m) WHERE primary_key"
    q["catalogue_latest"] = _with(DDL, CAT) + "SELECT table_name, source_file, cast(n_columns AS bigint) AS n_columns FROM cat"
    q["ddl_tables_found"] = _with(DDL) + """SELECT source_file, cast(count(*) FILTER (WHERE f) AS bigint) AS tables_found FROM (
      SELECT source_file, source_file = min(source_file) OVER (PARTITION BY table_name) AS f FROM d) GROUP BY 1"""
    q["catalogue_digest"] = _with(DDL, CAT) + "SELECT table_name, qualified_name AS name, cast(n_columns AS bigint) AS n_columns FROM cat"

    graph = _with(S, EDGES, NODES)
    q["edges"] = graph + "SELECT src, dst, count(*) AS n_scripts FROM edge GROUP BY 1, 2"
    q["nodes"] = graph + "SELECT id, id AS display_name FROM node"
    q["all_tables"] = graph + "SELECT id FROM node"
    q["nodes_enriched"] = _with(S, EDGES, NODES, DDL, CAT, COLS) + """SELECT id, id AS display_name, CASE WHEN table_name IS NULL THEN 'dbo' ELSE schema END AS schema,
      coalesce(database, '') AS database, coalesce(qualified_name, '') AS qualified_name,
      coalesce((SELECT string_agg(name, ',' ORDER BY column_no) FROM col WHERE col.m = cat.m), '') AS columns_csv, table_name IS NOT NULL AS in_catalogue
      FROM node LEFT JOIN cat ON cat.table_name = node.id"""
    q["edge_merge"] = _with(S, EDGES, COUNTS) + """SELECT src, dst, cast(n_map AS bigint) AS n_mappings, cast(n_join AS bigint) AS n_joins, cast(n_filter AS bigint) AS n_filters,
      cast(n_group AS bigint) AS n_grouping, cast(1 AS bigint) AS n_procedures, cast(2 AS bigint) AS n_methods FROM edge JOIN cnt USING (m)"""
    q["column_edges"] = items + "SELECT DISTINCT CASE WHEN stab = '' THEN '(constant)' ELSE stab END AS src_table, scol AS src_col, tgt AS dst_table, tcol AS dst_col, typ AS type FROM mapped"
    q["graph_degrees"] = _with(FLOW) + """SELECT id, cast(sum(i) AS bigint) AS in_degree, cast(sum(o) AS bigint) AS out_degree FROM (
      SELECT src AS id, 0 AS i, 1 AS o FROM f UNION ALL SELECT dst, 1, 0 FROM f) GROUP BY 1"""
    deg = """deg AS (SELECT id, (SELECT count(*) FROM edge WHERE dst = id) AS i, (SELECT count(*) FROM edge WHERE src = id) AS o FROM node)"""
    q["node_kinds"] = _with(S, EDGES, NODES, deg) + """SELECT id, i AS in_degree, o AS out_degree,
      CASE WHEN i = 0 AND o > 0 THEN 'source' WHEN i > 0 AND o = 0 THEN 'target' ELSE 'neither' END AS kind FROM deg"""
    q["graph_stats"] = _with(S, EDGES, NODES, deg) + """SELECT 'total_tables' AS metric, count(*) AS value FROM node
      UNION ALL SELECT 'source_tables', count(*) FROM deg WHERE i = 0 AND o > 0 UNION ALL SELECT 'target_tables', count(*) FROM deg WHERE i > 0 AND o = 0
      UNION ALL SELECT 'total_edges', count(*) FROM edge UNION ALL SELECT 'edges_regex', count(*) FROM edge
      UNION ALL SELECT 'edges_claude', 0 UNION ALL SELECT 'edges_gemini', 0 UNION ALL SELECT 'edges_nvidia', 0
      UNION ALL SELECT 'procedures', count(*) FROM s WHERE m <> 8 UNION ALL SELECT 'failed', count(*) FROM s WHERE m = 8"""
    q["graph_export"] = _with(S, EDGES, NODES, DDL, CAT, COUNTS) + """SELECT 'node' AS kind, id AS key, coalesce(qualified_name, id) AS label, cast(1 AS bigint) AS n
      FROM node LEFT JOIN cat ON cat.table_name = node.id UNION ALL SELECT 'edge', src || '>' || dst, '', 1 FROM edge
      UNION ALL SELECT 'edge_fact', src || '>' || dst, kind, n FROM (SELECT src, dst, unnest([{'kind': 'mapping', 'n': n_map}, {'kind': 'join', 'n': n_join},
        {'kind': 'filter', 'n': n_filter}, {'kind': 'grouping', 'n': n_group}, {'kind': 'procedure', 'n': 1}, {'kind': 'method', 'n': 1}], recursive := true)
        FROM edge JOIN cnt USING (m)) WHERE n > 0"""
    q["raw_tables"] = graph + "SELECT id FROM node WHERE id NOT IN (SELECT dst FROM edge)"
    q["upstream"] = _with(S, EDGES, _hops("edge", _ALL("edge"), 5, True), recursive=True) + _MIN
    q["downstream"] = _with(S, EDGES, _hops("edge", _ALL("edge"), 5, False), recursive=True) + _MIN
    q["upstream_flow"] = _with(FLOW, _hops("f", "SELECT 'REGION_' || r_regionkey AS seed FROM region", 4, True), recursive=True) + _MIN
    q["downstream_cycles"] = _with(CYCLES, _hops("e", _ALL("e"), 3, False), recursive=True) + _MIN
    both = _with(S, EDGES, _hops("edge", _ALL("edge"), 2, True, "u"), _hops("edge", _ALL("edge"), 2, False, "dn"), recursive=True)
    q["lineage_both"] = both + """SELECT DISTINCT a.seed, src, dst FROM u a JOIN edge ON src = a.node JOIN u b ON b.seed = a.seed AND b.node = dst
      UNION SELECT DISTINCT a.seed, src, dst FROM dn a JOIN edge ON src = a.node JOIN dn b ON b.seed = a.seed AND b.node = dst"""
    q["lineage_facts"] = _with(S, EDGES, COUNTS, _hops("edge", _ALL("edge"), 2, True, "u"), _hops("edge", _ALL("edge"), 2, False, "dn"), recursive=True) + """
      SELECT seed, src, dst, cast(n_map AS bigint) AS n_mappings, cast(n_join AS bigint) AS n_joins, cast(n_filter AS bigint) AS n_filters,
      cast(n_group AS bigint) AS n_grouping FROM (
        SELECT a.seed, src, dst, m FROM u a JOIN edge ON src = a.node JOIN u b ON b.seed = a.seed AND b.node = dst
        UNION SELECT a.seed, src, dst, m FROM dn a JOIN edge ON src = a.node JOIN dn b ON b.seed = a.seed AND b.node = dst) JOIN cnt USING (m)"""
    q["lineage_tree"] = _with(CYCLES, _hops("e", _ALL("e"), 3, False), f"h AS ({_MIN})", recursive=True) + """
      SELECT c.seed, min(src) AS src, dst FROM h c JOIN e ON e.dst = c.node JOIN h p ON p.seed = c.seed AND p.node = e.src AND p.hop = c.hop - 1
      WHERE c.hop > 0 AND src <> dst GROUP BY c.seed, dst"""
    q["lineage_attributes"] = _with(S, EDGES, _hops("edge", _ALL("edge"), 2, True, "u"), _hops("edge", _ALL("edge"), 2, False, "dn"), DDL, recursive=True) + """
      SELECT seed, node, cast(arg_min(hop, abs(hop)) AS bigint) AS hop, node IN (SELECT table_name FROM d) AS in_catalogue
      FROM (SELECT seed, node, -hop AS hop FROM u UNION ALL SELECT seed, node, hop FROM dn) GROUP BY 1, 2"""
    q["column_incoming"] = items + """SELECT DISTINCT tgt AS dst_table, CASE WHEN stab = '' THEN '(constant)' ELSE stab END AS src_table, scol AS src_col,
      tcol AS dst_col, typ AS type FROM mapped"""
    q["column_outgoing"] = _with(S, MAP, MAPPED, EDGES) + """SELECT DISTINCT src AS id, dst AS dst_table, stab AS src_table, scol AS src_col, tcol AS dst_col, typ AS type,
      stab = src OR stab = '' AS is_own FROM edge JOIN mapped USING (source_file)"""
    q["trace_outbound"] = _with(TREE_COLS, _out_chains("SELECT * FROM c"), recursive=True) + _CHAIN
    q["trace_cycles"] = _with(CYCLE_COLS, _out_chains("SELECT * FROM c"), recursive=True) + _CHAIN
    q["trace_tables"] = _with(TREE_COLS, _out_chains("SELECT * FROM c"), recursive=True) + """
      SELECT DISTINCT seed_table, seed_column, split_part(x, '.', 1) AS table_name FROM (SELECT st AS seed_table, sc AS seed_column, unnest(path) AS x FROM fin)"""
    q["trace_graph"] = _with(CYCLE_COLS, """p AS (SELECT DISTINCT src_t AS st, src_c AS sc, src_t AS t, src_c AS col, 0 AS hop FROM c
      UNION ALL SELECT st, sc, dst_t, dst_c, hop + 1 FROM p JOIN c ON p.t = c.src_t AND p.col = c.src_c WHERE hop <= 20)""", recursive=True) + """
      SELECT st AS seed_table, sc AS seed_column, count(DISTINCT t || '.' || col) AS n_columns,
        count(DISTINCT CASE WHEN hop <= 20 THEN t || '.' || col END) AS n_steps FROM p GROUP BY st, sc"""
    q["trace_inbound"] = _with(TREE_COLS, """p AS (SELECT DISTINCT dst_t AS st, dst_c AS sc, dst_t AS t, dst_c AS col, [dst_t || '.' || dst_c] AS path FROM c
      UNION ALL SELECT st, sc, src_t, src_c, list_append(path, src_t || '.' || src_c) FROM p JOIN c ON p.t = c.dst_t AND p.col = c.dst_c)""", recursive=True) + """
      SELECT st AS seed_table, sc AS seed_column, array_to_string(path, '|') AS chain, cast(len(path) AS bigint) AS n_steps, 'raw origin' AS note, true AS leaf FROM p WHERE t = 'P_0'"""
    q["trace_inbound_scripts"] = _with(S, MAP, MAPPED, EDGES, """ce AS (SELECT DISTINCT CASE WHEN stab = '' THEN '(constant)' ELSE stab END AS src_t, scol AS src_c, tgt AS dst_t, tcol AS dst_c FROM mapped)""",
        """p AS (SELECT DISTINCT dst_t AS st, dst_c AS sc, dst_t AS t, dst_c AS col, [dst_t || '.' || dst_c] AS path, cast('' AS varchar) AS note FROM ce
      UNION ALL SELECT st, sc, src_t, src_c, list_append(path, src_t || '.' || src_c),
        CASE WHEN src_t = '(constant)' THEN 'constant' WHEN src_t NOT IN (SELECT dst FROM edge) THEN 'raw origin' ELSE '' END
      FROM p JOIN ce ON p.t = ce.dst_t AND p.col = ce.dst_c WHERE note = '')""", recursive=True) + """
      SELECT st AS seed_table, sc AS seed_column, array_to_string(path, '|') AS chain, cast(len(path) AS bigint) AS n_steps,
        CASE WHEN note = '' THEN 'no incoming mappings' ELSE note END AS note, true AS leaf
      FROM p WHERE note <> '' OR NOT EXISTS (SELECT 1 FROM ce WHERE p.t = ce.dst_t AND p.col = ce.dst_c)"""

    q["tracker_upsert"] = _with(TRACK) + "SELECT kind, source_file, status, '' AS method, processed_at FROM tr"
    q["tracker_roundtrip"] = _with(TRACK) + "SELECT kind, source_file, status, processed_at FROM tr"
    n = lambda name, cond: f"SELECT '{name}' AS metric, count(*) AS value FROM tr WHERE {cond}"
    q["tracker_counts"] = _with(TRACK) + " UNION ALL ".join([
        n("sp_processed", "kind = 'sp' AND status = 'success'"), n("sp_failed", "kind = 'sp' AND status = 'failed'"), n("sp_tracked", "kind = 'sp'"),
        n("schemas_processed", "kind = 'schemas' AND status = 'success'"), n("schemas_tracked", "kind = 'schemas'"),
        "SELECT 'sp_on_disk', count(*) FROM part", "SELECT 'schemas_on_disk', count(*) FROM supplier"])
    q["pending_scripts"] = _with(S, TRACK) + "SELECT source_file FROM s WHERE source_file NOT IN (SELECT source_file FROM tr WHERE kind = 'sp' AND status = 'success')"
    q["pending_ddl"] = _with(DDL, TRACK) + "SELECT source_file FROM d WHERE source_file NOT IN (SELECT source_file FROM tr WHERE kind = 'schemas' AND status = 'success')"
    q["merge_results"] = _with(S, TRACK) + """SELECT source_file, tgt AS target_table, CASE WHEN source_file IN (SELECT source_file FROM tr WHERE kind = 'sp' AND status = 'success')
      THEN 'gemini' ELSE 'regex' END AS extraction_method FROM s WHERE m <> 8"""
    q["stream_ingest"] = _with(S) + "SELECT source_file, CASE WHEN m = 8 THEN '' ELSE tgt END AS target_table, CASE WHEN m = 8 THEN 'no_primary' ELSE '' END AS failure FROM s"
    stored = "path IN (SELECT path FROM ftr WHERE o_orderstatus = 'F')"
    q["pending_by_path"] = _with(S, FOLDER_TRACK) + f"SELECT path FROM fs WHERE NOT {stored}"
    q["merge_by_path"] = _with(S, FOLDER_TRACK) + f"""SELECT path, tgt AS target_table,
      CASE WHEN {stored} THEN 'gemini' ELSE 'regex' END AS extraction_method FROM fs WHERE m <> 8"""
    q["store_upserts"] = _with(S) + """SELECT r.read, source_file, tgt AS target_table, CASE WHEN k % 3 = 0 THEN 'regex' ELSE 'gemini' END AS extraction_method
      FROM s, (VALUES ('parts'), ('compact')) r(read) WHERE m <> 8 AND k % 7 <> 0"""
    q["store_refresh"] = _with(S) + """SELECT source_file, CASE WHEN m = 8 AND k % 6 <> 0 THEN 'failed' ELSE 'success' END AS status,
      CASE WHEN k % 6 = 0 THEN 'EDIT_' || k WHEN m = 8 THEN '' ELSE tgt END AS target_table FROM s"""
    q["responses_file"] = f"""SELECT 'sp_' || conv_id || '.sql' AS source_file, CASE WHEN turn % 2 = 0 THEN 'claude' ELSE 'gemini' END AS method,
      count(*) AS n, count(*) FILTER (WHERE is_valid) AS n_valid FROM ({q["responses_parse"]}) GROUP BY ALL"""
    q["user_extractor"] = _with(S) + """SELECT source_file, CASE WHEN txt LIKE '%UNION%' THEN 0 ELSE (length(txt) - length(replace(txt, ' JOIN ', ''))) // 6 END AS n_joins,
      CASE WHEN txt LIKE '%UNION%' THEN 'Exception: set operation' WHEN txt NOT LIKE '% JOIN %' THEN 'Returned None' ELSE '' END AS error FROM s"""
    return q

"""Script, DDL, graph and tracker collections derived from the sample tables.

The sample tables hold no SQL text, so texts are built from their rows: one load procedure
per part, one table definition per supplier. Sizes follow the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHAPES = [
    # plain load
    """INSERT INTO {target} (a, [Total Qty])
SELECT s.a, s.b AS [Total Qty]
FROM {feed} s;""",
    # join, aggregate, BETWEEN
    """INSERT INTO {target} (region, total)
SELECT d.region, SUM(s.amt) AS total
FROM {feed} s
LEFT JOIN {dim} AS d ON s.id = d.id
WHERE s.x = 1 AND s.y BETWEEN 1 AND 5
GROUP BY d.region;""",
    # names with blanks
    """INSERT INTO {target} ([{words} Start])
SELECT s.[{words} Date] AS [{words} Start]
FROM {feed} s
WHERE s.[{words} Date] >= '2020-01-01';""",
    # several statements
    """DELETE FROM {target} WHERE id = 1;
DELETE FROM {target} WHERE id = 2;
INSERT INTO {target} (c1, c2)
SELECT a.c1, a.c2 FROM {feed} a;""",
    # session noise, wrappers, comments
    """SET NOCOUNT ON;
DECLARE @d INT = 5;
BEGIN TRY
  EXEC dbo.log_start '{name}';
  -- INSERT INTO FAKE SELECT z.q FROM FAKE2 z
  /* INSERT INTO FAKE SELECT z.q FROM FAKE2 z */
  INSERT INTO {target} (note, qty)
  SELECT '-- not a comment' AS note, s.qty
  FROM {feed} s
  WHERE s.qty > @d;
END TRY
BEGIN CATCH
  EXEC dbo.log_error;
END CATCH
GO""",
    # merge
    """MERGE {target} AS t
USING {feed} AS s
ON t.id = s.id
WHEN MATCHED THEN UPDATE SET t.amt = s.amt
WHEN NOT MATCHED THEN INSERT (id, amt) VALUES (s.id, s.amt);""",
    # common table expression
    """WITH c AS (SELECT f.a, f.id FROM {feed} f)
INSERT INTO {target} (a, name)
SELECT c.a, d.name
FROM c
JOIN {dim} d ON c.id = d.id;""",
    # derived table
    """INSERT INTO {target} (a)
SELECT q.a FROM (SELECT x.a FROM {feed} x WHERE x.b IN (1,2)) q
WHERE q.a > 0 OR q.a IS NULL;""",
    # dynamic statement only
    """DECLARE @sql NVARCHAR(MAX);
SET @sql = N'SELECT 1';
EXEC sp_executesql @sql;""",
    # wide select list
    """INSERT INTO {target}
SELECT CASE WHEN s.c1 > {size} THEN 'x,y' ELSE 'z' END AS f1, FLOOR(s.c2/2) AS f2, 1 AS f3, 'k' AS f4,
  s.EndDate, s.c6, s.c7, s.c8, s.c9, s.c10, s.c11, s.c12, s.c13, s.c14, s.c15, s.c16
FROM {feed} s
WHERE s.BRAND = 1 AND s.EndDate > '2020-01-01'
ORDER BY s.c6;""",
]


def _fill(template: str, **parts) -> F.Column:
    """Column of the template with {names} replaced by columns."""
    out, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(text), parts[name]]
    return F.concat(*out, F.lit(rest))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One load procedure per part: FACT_k is fed by FACT_(k/2), a tree of depth log2(n)."""
    k = F.col("p_partkey").cast("string")
    half = F.floor(F.col("p_partkey") / 2).cast("string")
    feed = F.when(F.col("p_partkey") > 0, F.concat(F.lit("[ODS].[dbo].[FACT_"), half, F.lit("]"))).otherwise(
        "[ODS].[dbo].[SRC_0]")
    parts = {
        "target": F.concat(F.lit("[DW].[dbo].[FACT_"), k, F.lit("]")),
        "feed": feed,
        "dim": F.concat(F.lit("[DW].[dbo].[DIM_"), (F.col("p_partkey") % 40).cast("string"), F.lit("]")),
        "words": F.col("p_name"),
        "name": F.concat(F.lit("sp_load_"), k),
        "size": F.col("p_size").cast("string"),
    }
    body = F.lit("")
    for m, shape in enumerate(_SHAPES):
        body = F.when(F.col("p_partkey") % 10 == m, _fill(shape, **parts)).otherwise(body)
    txt = F.concat(
        F.when(F.col("p_partkey") % 10 == 4, "USE [DW];\nGO\n").otherwise(""),
        F.lit("CREATE PROCEDURE [dbo].["), parts["name"], F.lit("]\nAS\nBEGIN\n"), body, F.lit("\nEND\n"),
    )
    name = F.concat(F.lit("sp_"), k, F.lit(".sql"))
    return table(spark, sf_dir, "part").select(
        name.alias("path"), name.alias("source_file"),
        F.lit("2024-01-01").cast("timestamp").alias("modified"),
        F.length(txt).cast("bigint").alias("length"), txt.alias("txt"),
    )


_NESTED_SHAPES = [
    # a calculation inside a derived table
    "INSERT INTO {target} (x) SELECT d.x FROM (SELECT s.a + s.b AS x FROM {feed} s) d",
    # the same in a common table expression
    "WITH c AS (SELECT s.a + s.b AS x FROM {feed} s) INSERT INTO {target} (x) SELECT c.x FROM c",
    # a chain of three, the last with a column list
    """WITH a AS (SELECT s.u AS x, s.k FROM {feed} s), b AS (SELECT a.x * 2 AS y, a.k FROM a), c (z, kk) AS (SELECT b.y, b.k FROM b)
INSERT INTO {target} (z, k) SELECT c.z, c.kk FROM c""",
    # branches of a set operation inside a derived table
    "INSERT INTO {target} (v) SELECT q.v FROM (SELECT p.a AS v FROM {feed} p UNION ALL SELECT r.b FROM {dim} r) q",
    # a star over a derived table, a constant in it, a column list behind another
    """INSERT INTO {target} (n, one, p)
SELECT e.*, d.p FROM (SELECT s.m AS n, 1 AS one FROM {feed} s) e JOIN (SELECT r.g, r.id FROM {dim} r) AS d (p, q) ON e.n = d.q""",
    # derived tables in derived tables, aggregated outside
    """INSERT INTO {target} (w, total)
SELECT o.w, SUM(o.t) AS total FROM (SELECT i.v AS w, i.t FROM (SELECT s.a - 1 AS v, s.t FROM {feed} s) i) o GROUP BY o.w""",
]


def nested_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One load procedure per part whose columns come through derived tables and common table expressions."""
    key = F.col("p_partkey")
    k = key.cast("string")
    parts = {
        "target": F.concat(F.lit("[DW].[dbo].[NEST_"), k, F.lit("]")),
        "feed": F.concat(F.lit("[ODS].[dbo].[SRC_"), (key % 50).cast("string"), F.lit("]")),
        "dim": F.concat(F.lit("[DW].[dbo].[DIM_"), (key % 40).cast("string"), F.lit("]")),
    }
    body = F.lit("")
    for m, shape in enumerate(_NESTED_SHAPES):
        body = F.when(key % 6 == m, _fill(shape, **parts)).otherwise(body)
    name = F.concat(F.lit("nest_"), k, F.lit(".sql"))
    return table(spark, sf_dir, "part").select(name.alias("path"), name.alias("source_file"), F.concat(
        F.lit("CREATE PROCEDURE dbo.nest_"), k, F.lit(" AS BEGIN\n"), body, F.lit("\nEND")).alias("txt"))


_DDL_SHAPES = [
    """CREATE TABLE [DW].[dbo].[SUP {key}] (
  [Id] INT IDENTITY(1,1) NOT NULL,
  [Code] varchar(20) NOT NULL, -- PRIMARY KEY in a comment
  [Balance] decimal(18, 2) NULL,
  CONSTRAINT [PK_{key}] PRIMARY KEY CLUSTERED ([Id] ASC, [Code] DESC) WITH (PAD_INDEX = OFF) ON [PRIMARY]
) ON [PRIMARY];
""",
    "CREATE TABLE dbo.FACT_{key} (id INT PRIMARY KEY, name VARCHAR(50) NOT NULL);\n",
    """CREATE TABLE IF NOT EXISTS SUP_{key} (
  KeyCode nvarchar(max) NULL, OnSet date NOT NULL,
  Total AS (a*b),
  CHECK (KeyCode <> '(')
);
""",
    "CREATE TABLE SUP_{prev} (Id BIGINT, Note [dbo].[Text Type], PRIMARY KEY(Id));\n",
]


def ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table definition per supplier; every fourth one redefines its neighbour's table."""
    key = F.col("s_suppkey")
    parts = {"key": key.cast("string"), "prev": (key - 1).cast("string")}
    txt = F.lit("")
    for m, shape in enumerate(_DDL_SHAPES):
        txt = F.when(key % 4 == m, _fill(shape, **parts)).otherwise(txt)
    name = F.concat(F.lit("ddl_"), parts["key"], F.lit(".sql"))
    return table(spark, sf_dir, "supplier").select(
        name.alias("path"), name.alias("source_file"),
        F.lit("2024-01-01").cast("timestamp").alias("modified"),
        F.length(txt).cast("bigint").alias("length"), txt.alias("txt"))


def write_files(rows: DataFrame, root: str) -> None:
    """One file per row under `root` (a folder every executor reaches), spread over sub-folders."""
    def write(part):
        import zlib

        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)
        for row in part:
            folder = f"{base}/d{zlib.crc32(row.source_file.encode()) % 16}"
            target.create_dir(folder, recursive=True)
            with target.open_output_stream(f"{folder}/{row.source_file}") as f:
                f.write(row.txt.replace("\n", "\r\n").encode() + b"\xff")

    rows.select("source_file", "txt").foreachPartition(write)


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PART -> ORDER -> CUST -> NATION -> REGION, one edge per pair that occurs."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    pair = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    t = lambda n: table(spark, sf_dir, n)
    return (
        pair(t("lineitem"), name("PART_", "l_partkey"), name("ORDER_", "l_orderkey"))
        .unionByName(pair(t("orders"), name("ORDER_", "o_orderkey"), name("CUST_", "o_custkey")))
        .unionByName(pair(t("customer"), name("CUST_", "c_custkey"), name("NATION_", "c_nationkey")))
        .unionByName(pair(t("nation"), name("NATION_", "n_nationkey"), name("REGION_", "n_regionkey")))
        .distinct()
    )


def cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier i feeds (3i+1) mod n and (i+5) mod n: sparse, with many cycles."""
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    i = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("S_"), c.cast("string"))
    return s.select(name(i).alias("src"), F.explode(F.array(name((i * 3 + 1) % n), name((i + 5) % n))).alias("dst")).distinct()


_TYPES = ["direct_copy", "aggregation", "calculation", "constant"]


def _columns(df: DataFrame, src: F.Column, dst: F.Column) -> DataFrame:
    """Four columns per table; column j of src feeds column (j+1) mod 4 of dst."""
    rows = df.select(src.alias("src_table"), dst.alias("dst_table"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    col = lambda c: F.concat(F.lit("C_"), c.cast("string"))
    return rows.select("src_table", col(F.col("j")).alias("src_col"), "dst_table", col((F.col("j") + 1) % 4).alias("dst_col"),
                       F.element_at(F.array(*[F.lit(t) for t in _TYPES[:3]]), F.col("j") % 3 + 1).alias("type"))


def tree_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column edges of the part tree: P_(k/2) feeds P_k for k > 0."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("P_"), c.cast("string"))
    return _columns(table(spark, sf_dir, "part").filter(k > 0), name(F.floor(k / 2)), name(k))


def cycle_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column edges S_i -> S_((3i+1) mod n) over suppliers."""
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    i = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("S_"), c.cast("string"))
    return _columns(s, name(i), name((i * 3 + 1) % n))


def in_folders(rows: DataFrame) -> DataFrame:
    """Each file once below a/ and once below b/, under the same name."""
    both = F.explode(F.array(F.lit("a/"), F.lit("b/")))
    return rows.withColumn("folder", both).withColumn("path", F.concat("folder", "source_file")).select(*rows.columns)


def edited_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New texts for the scripts of every sixth part, which load EDIT_k from then on."""
    k = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("sp_"), k, F.lit(".sql"))
    return table(spark, sf_dir, "part").filter("p_partkey % 6 = 0").select(
        name.alias("source_file"), F.concat(F.lit("INSERT INTO EDIT_"), k, F.lit(" SELECT s.a FROM SRC_"), k, F.lit(" s")).alias("txt"))


def folder_outcomes(spark: SparkSession, sf_dir: str, base: str, prefix: str, kind: str) -> DataFrame:
    """`order_outcomes` with the path: customers of even number stand for folder a/, others for b/."""
    folder = F.when(F.col("o_custkey") % 2 == 0, "a/").otherwise("b/")
    rows = order_outcomes(spark, sf_dir, base, prefix, kind, folder.alias("folder"))
    return rows.withColumn("path", F.concat("folder", "source_file")).drop("folder")


def order_outcomes(spark: SparkSession, sf_dir: str, base: str, prefix: str, kind: str, *more: Column) -> DataFrame:
    """Tracker rows from orders: status F is a success, O a failure, P nothing."""
    n = table(spark, sf_dir, base).count()
    name = F.concat(F.lit(prefix), (F.col("o_orderkey") % n).cast("string"), F.lit(".sql"))
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed")
    return table(spark, sf_dir, "orders").select(
        F.lit(kind).alias("kind"), name.alias("source_file"), status.alias("status"),
        F.lit("").alias("method"), F.lit("").alias("target_table"), F.lit(None).cast("bigint").alias("tables_found"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("processed_at"), *more,
    ).filter("status is not null")


# Override method per market segment; one value is not a method.
SEGMENT_METHOD = {"BUILDING": "Gemini", "MACHINERY": "nvidia", "HOUSEHOLD": "bogus", "AUTOMOBILE": "CLAUDE", "FURNITURE": "regex"}


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of two priorities: by customer segment, and by suppliers in debt."""
    method = F.lit("bogus")
    for segment, m in SEGMENT_METHOD.items():
        method = F.when(F.col("c_mktsegment") == segment, m).otherwise(method)
    name = lambda c: F.concat(F.lit("SP_"), F.col(c).cast("string"), F.lit(".sql"))
    by_customer = table(spark, sf_dir, "customer").select(
        name("c_custkey").alias("source_file"), method.alias("method"), F.lit(0).alias("priority"))
    by_supplier = table(spark, sf_dir, "supplier").select(
        name("s_suppkey").alias("source_file"), F.when(F.col("s_acctbal") < 0, "GEMINI").otherwise("none").alias("method"),
        F.lit(1).alias("priority"))
    return by_customer.unionByName(by_supplier)


_ANSWER = (
    '{"target_table": "[DW].[dbo].[ANS_{conv}]", "source_tables": ["[ODS].[SRC_{turn}]", null, "B_{conv}"], '
    '"column_mappings": [{"target_column": "[A]", "source_table": "[S]", "source_column": "[c d]", '
    '"transformation_type": "direct_copy", "transformation_logic": "[c d]"}], "joins": [], '
    '"filters": ["[x] = \'{\'"], "grouping": []}'
)
_ANSWER_SHAPES = ["@", "```json\n@\n```", "Here it is: @ (end of {answer})", "{not json} then @"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model answers, one per conversation turn; some hold no JSON at all."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    body = F.replace(F.replace(F.lit(_ANSWER), F.lit("{conv}"), conv), F.lit("{turn}"), turn)
    shaped = F.lit("")
    for i, shape in enumerate(_ANSWER_SHAPES):
        shaped = F.when(F.col("turn") % 4 == i, F.replace(F.lit(shape), F.lit("@"), body)).otherwise(shaped)
    response = F.when(F.length("text") % 5 == 0, F.col("text")).otherwise(shaped)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("sp_"), conv, F.lit(".sql")).alias("source_file"),
        F.when(F.col("turn") % 2 == 0, "claude").otherwise("gemini").alias("method"), response.alias("response"))

"""Lineage facts of statements: clause items, table references, aliases and joins.

Each token is repeated once per parenthesis level around it. A window per level then knows
the clause the token stands in at that level, so the condition of a join inside a derived
table and the select item around it both get their whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import table_key, unquote
from ..functions.shared import kept
from .statements import lineage_tokens
from .tokens import IDENT_RX, before, last_seen, running

KEY = ["path", "stmt_no"]

# Words that are never an alias or a column.
RESERVED = [
    "ALL", "AND", "ANY", "APPLY", "AS", "ASC", "BEGIN", "BETWEEN", "BY", "CASE", "CROSS",
    "CURRENT_TIMESTAMP", "DELETE", "DESC", "DISTINCT", "ELSE", "END", "ESCAPE", "EXCEPT", "EXISTS",
    "FETCH", "FOR", "FROM", "FULL", "GROUP", "HAVING", "IN", "INNER", "INSERT", "INTERSECT", "INTO",
    "IS", "JOIN", "LEFT", "LIKE", "LIMIT", "MATCHED", "MERGE", "NOT", "NULL", "OFFSET", "ON",
    "OPTION", "OR", "ORDER", "OUTER", "OUTPUT", "OVER", "PARTITION", "PERCENT", "PIVOT", "RIGHT",
    "ROWS", "SELECT", "SET", "SOME", "TABLESAMPLE", "THEN", "TOP", "UNION", "UNPIVOT", "UPDATE",
    "USING", "VALUES", "WHEN", "WHERE", "WITH",
]
# Functions whose first argument names a date part or a type, not a column.
KEYWORD_ARGUMENT = ["DATEADD", "DATEDIFF", "DATEPART", "DATENAME", "CONVERT", "TRY_CONVERT", "EXTRACT"]

_SIDES = ["INNER", "LEFT", "RIGHT", "FULL", "CROSS"]
_TABLE_WORDS = ["FROM", "JOIN", "USING", "APPLY"]

# Clause word -> letter of the items found in it.
SELECT, WHERE, HAVING, GROUP, SET, INSERT_COLUMN, VALUE, ON = "S", "W", "H", "G", "U", "I", "V", "J"
# Items of select lists inside parentheses, and names in a column list in front of or behind a query in parentheses.
INNER_SELECT, NAME_LIST = "Q", "L"
_TOP_CLAUSES = {"SELECT": SELECT, "WHERE": WHERE, "HAVING": HAVING, "GROUP": GROUP, "SET": SET}
_PAREN_CLAUSES = {"INSCOLS": INSERT_COLUMN, "VALS": VALUE}

DEFINITION = (
    "STRUCT<what: STRING, pos: INT, table: STRING, alias: STRING, open_pos: INT, "
    "use: STRING, join_pos: INT, side: STRING, list_pos: INT, full: STRING>"
)


def _letter(c: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for word, letter in names.items():
        out = F.when(c == word, letter).otherwise(out)
    return out


@kept
def _clause_start() -> Column:
    """Clause that starts at this token on its own level, else null."""
    u, a1u, a2u, b1 = F.col("utok"), F.upper("a1"), F.upper("a2"), F.col("b1")
    before_paren = F.col("lead_in_before")
    paren = (
        F.when(b1 == "VALUES", "VALS")
        .when((b1 == "INSERT") | ((F.col("level") == 1) & (
            ((before_paren["b1"] == "INTO") & (before_paren["b2"].isin("INSERT", ")") | before_paren["b3"].isin("TOP")))
            | ((before_paren["b1"] == "INSERT") & ~b1.isin("TOP", "INTO")))), "INSCOLS")
        .otherwise("OPEN")
    )
    word = (
        F.when(u.isin("SELECT", "WHERE", "HAVING", "ON", "INTO", "UNION", "EXCEPT", "INTERSECT",
                      "OPTION", "USING", "OUTPUT", "VALUES", "JOIN", "LIMIT", "OFFSET", "INSERT",
                      "UPDATE", "MERGE", "SET", "PIVOT", "UNPIVOT"), u)
        .when((u == "FROM") & (b1 != "DISTINCT"), u)
        .when(u.isin("GROUP", "ORDER") & (a1u == "BY"), u)
        .when(u.isin(*_SIDES, "OUTER")
              & a1u.isin("JOIN", "OUTER", "APPLY", "HASH", "LOOP", "MERGE", "REMOTE"), "SIDE")
        .when((u == "WHEN") & ((a1u == "MATCHED") | (a2u == "MATCHED")), u)
        .when((u == "FOR") & a1u.isin("XML", "JSON", "BROWSE"), u)
        .when((u == "WITH") & ~a1u.isin("(", "TIES"), u)
    )
    return F.when(F.col("own") & (u == "("), paren).when(
        F.col("own") & F.col("in_query") & (b1 != "."), word)


def level_rows(scripts: DataFrame, primary_only: bool = True) -> DataFrame:
    """Token rows per level with the clause (`ev`) and the item number inside it."""
    by = [*KEY, "level"]
    rows = lineage_tokens(scripts, primary_only).withColumn(
        "level", F.explode_outer(F.sequence(F.lit(0), F.greatest("depth", F.lit(0)))))
    u, b1, b2 = F.col("utok"), F.col("b1"), F.col("b2")
    rows = rows.withColumns({"own": F.col("depth") == F.col("level"), "reserved": u.isin(*RESERVED)})
    opening = F.col("own") & (u == "(")
    conn = F.col("own") & u.isin("BETWEEN", "AND", "OR") & (F.col("case_depth") <= 0)
    side = F.when(b1.isin(*_SIDES), b1).when(b2.isin(*_SIDES), b2).otherwise("INNER")
    rows = rows.select(
        "*", conn.alias("conn"),
        last_seen(F.when(opening, F.struct("b1", "pos"))).over(before(by)).alias("prev_opener"),
        last_seen(F.when(F.col("own") & (u == "JOIN"), F.struct("pos", side.alias("side")))
                  ).over(running(by)).alias("jn"),
        last_seen(F.when(conn, u)).over(before(by)).alias("prev_conn"),
        F.sum((F.col("own") & (u == ",")).cast("int")).over(running(by)).cast("int").alias("commas"),
    )
    rows = rows.select(
        "*",
        last_seen(F.when(opening, F.struct(
            "pos", "b1", "b2", "bpos", F.upper("a1").isin("SELECT", "WITH").alias("is_query"),
            F.col("lead_in_before.b1").alias("intro"), F.col("lead_in_before.bpos").alias("intro_pos"),
            F.col("prev_opener.b1").alias("prev_name"), F.col("prev_opener.pos").alias("prev_pos"),
        ))).over(running(by)).alias("op"),
        (F.col("conn") & (u != "BETWEEN")
         & ~((u == "AND") & F.coalesce(F.col("prev_conn") == "BETWEEN", F.lit(False)))).alias("is_conn"),
    )
    rows = rows.withColumn(
        "in_query",
        (F.col("level") == 0)
        | F.coalesce(F.col("op.is_query") | F.col("op.b1").isin(*_TABLE_WORDS), F.lit(False)),
    )
    rows = rows.select(
        "*", _clause_start().alias("starts"),
        F.sum(F.col("is_conn").cast("int")).over(running(by)).cast("int").alias("conns"),
    )
    rows = rows.withColumn(
        "ev",
        last_seen(F.when(F.col("starts").isNotNull(), F.struct(
            F.col("starts").alias("word"), "pos", "commas", "conns"))).over(running(by)))
    item = F.when(F.col("ev.word").isin("WHERE", "HAVING"), F.col("conns") - F.col("ev.conns")).otherwise(
        F.col("commas") - F.col("ev.commas"))
    return rows.withColumn("item_no", item)


@kept
def _defines() -> Column:
    """What this token completes: T table reference, D derived table, C CTE, F table function, N join."""
    u, own, op = F.col("utok"), F.col("own"), F.col("op")
    intro, intro2 = F.col("lead_in.b1"), F.col("lead_in.b2")
    source = F.col("in_query") & (
        (intro.isin("FROM", "JOIN") & (intro2 != "DISTINCT"))
        | ((intro == "USING") & (F.col("kind") == "MERGE"))
        | ((intro == ",") & F.col("ev.word").isin("FROM", "ON"))
        | ((intro == "(") & intro2.isin("FROM", "JOIN", "USING"))
    )
    target = (F.col("level") == 0) & (
        (intro == "INTO") | ((intro == "MERGE") & (u != "INTO")) | ((intro == "UPDATE") & (F.col("kind") == "UPDATE"))
        | ((intro == "INSERT") & (F.col("kind") == "INSERT")))
    named = F.col("ident") & ~F.col("reserved") & (F.col("a1") != ".")
    name_before = op["b1"].rlike(r'^[\p{L}_\["]') & ~op["b1"].isin(*RESERVED)
    return F.when(own & named & source, "T").when(own & named & target, "T").when(
        own & (u == ")"),
        F.when(op["is_query"], F.when(op["b1"].isin(*_TABLE_WORDS, ","), "D").when(op["b1"] == "AS", "C"))
        .when(op["intro"].isin("FROM", "JOIN", "APPLY") & name_before, "F"),
    ).when(own & (F.col("starts") == "JOIN"), "N")


@kept
def _definition() -> Column:
    """Details of what a defining token completes."""
    what, op = F.col("what"), F.col("op")
    intro = F.col("lead_in.b1")
    word = F.when(F.upper("a1") == "AS", F.col("a2")).otherwise(F.col("a1"))
    named = what.isin("T", "D", "F") & word.rlike(r'^(?s:[\p{L}_#][\p{L}\p{N}_#@$]*|\[.*\]|".*")$') & ~F.upper(word).isin(*RESERVED)
    name = F.when(what == "T", F.col("tok")).when(what == "F", op["b1"]).when(
        what == "C", F.when(op["b2"] == ")", op["prev_name"]).otherwise(op["b2"]))
    join_pos = (
        F.when((what == "T") & (intro == "JOIN"), F.col("lead_in.bpos"))
        .when((what == "D") & (op["b1"] == "JOIN"), op["bpos"])
        .when((what == "F") & (op["intro"] == "JOIN"), op["intro_pos"])
        .when(what == "N", F.col("jn.pos")))
    # Up to three parts of a table's name, the last of which this token is; `DB..T` keeps its empty schema.
    b1, b2, b3, b4 = (F.col(f"b{i}") for i in range(1, 5))
    part = lambda c: F.when(c == ".", "").otherwise(F.upper(unquote(c)))
    schema = F.when(b1 == ".", part(b2))
    database = F.when(b1 == ".", F.when(b2 == ".", part(b3)).when(b3 == ".", part(b4)))
    full = F.when(what == "T", F.concat_ws(".", database, schema, table_key(F.col("tok"))))
    use = F.when(what == "T", F.when(intro.isin("INTO", "MERGE", "UPDATE", "INSERT"), "target").otherwise("source"))
    return F.when(what.isNotNull(), F.struct(
        what.alias("what"), F.col("pos").alias("pos"), F.when(name.isNotNull(), table_key(name)).alias("table"),
        F.when(named, F.lower(unquote(word))).alias("alias"),
        F.when(what.isin("D", "C", "F"), op["pos"]).alias("open_pos"), use.alias("use"),
        join_pos.alias("join_pos"), F.when(what == "N", F.col("jn.side")).alias("side"),
        F.when((what == "C") & (op["b2"] == ")"), op["prev_pos"]).alias("list_pos"), full.alias("full"))).cast(DEFINITION)


@kept
def _piece() -> Column:
    """Token of an item with the column it refers to and the prefix that may be an alias."""
    u, tok, a1, b1, b2 = F.col("utok"), F.col("tok"), F.col("a1"), F.col("b1"), F.col("b2")
    ident = F.col("ident") & ~F.col("reserved") & ~tok.startswith("@")
    qualified = b1 == "."
    after_name = (b1.rlike(r'^(?s:[\p{L}_#\["\'].*|\))$') & ~b1.isin(*RESERVED)) | (b1 == "AS")
    typed = (b1 == "(") & b2.isin(*KEYWORD_ARGUMENT)
    intro, intro2, intro3 = (F.col(f"lead_in.{b}") for b in ("b1", "b2", "b3"))
    function_from = (intro == "FROM") & (intro2 != ")") & intro3.isin("(", "LEADING", "TRAILING", "BOTH")
    in_from = intro.isin("FROM", "JOIN", "INTO", "USING") & ~function_from
    is_column = (ident & ~a1.isin(".", "(") & ~in_from & (qualified | (~after_name & ~typed))) | (
        qualified & (u == "*"))
    name = unquote(tok)
    return F.struct(
        F.col("pos").cast("int").alias("pos"), "raw", F.col("utok").alias("u"), F.col("own"),
        F.when(is_column & qualified, F.lower(unquote(b2))).alias("q"),
        F.when(is_column, F.when(qualified, F.upper(name)).otherwise(name)).alias("c"),
        F.when(ident & F.col("name_start") & (a1 == "."), F.lower(name)).alias("key"),
    )


def fact_rows(scripts: DataFrame, primary_only: bool = True) -> DataFrame:
    """One row per clause item (`pieces`) and one per definition (`def`).

    Rows of one statement stay on one task and an item never exceeds its script.
    """
    rows = level_rows(scripts, primary_only)
    u, own, ev = F.col("utok"), F.col("own"), F.col("ev")
    level, word = F.col("level"), ev["word"]
    after_join = (word == "ON") & (F.col("jn.pos") > F.coalesce(F.col("op.pos"), F.lit(-1)))
    fact = F.coalesce(
        F.when(level == 0, _letter(word, _TOP_CLAUSES)),
        F.when(level == 1, _letter(word, _PAREN_CLAUSES)),
        F.when(after_join & (F.col("item_no") == 0), ON),
        F.when((word == "SELECT") & F.col("op.is_query"), INNER_SELECT),
        F.when((word == "OPEN") & F.col("op.b2").isin("WITH", ",", ")", "AS") & F.col("op.b1").rlike(IDENT_RX)
               & ~F.col("op.is_query"), NAME_LIST),
    )
    separator = own & F.when(word.isin("WHERE", "HAVING"), F.col("is_conn")).otherwise(u == ",")
    skipped = (F.col("pos") == ev["pos"]) | (own & (u == ")") & (level > 0)) | (
        own & (u == "BY") & (F.col("b1") == "GROUP"))
    rows = rows.select("*", fact.alias("fact"), separator.alias("sep"), _defines().alias("what"))
    rows = rows.filter(F.col("what").isNotNull() | (F.col("fact").isNotNull() & ~skipped))
    rows = rows.select(
        *KEY, "kind", "pos", "fact", "item_no", F.col("ev.pos").alias("ev_pos"), F.col("jn.pos").alias("jn_pos"), "sep", F.col("op.pos").alias("scope"), F.lower(unquote(F.col("op.b1"))).alias("opener"),
        F.col("utok").alias("u"), _definition().alias("def"),
        F.when(F.col("what").isNull() & ~F.col("sep"), _piece()).alias("piece"),
    )
    is_def = F.col("def").isNotNull()
    grouped = rows.groupBy(
        *KEY, "kind",
        F.when(is_def, F.col("def.what")).otherwise(F.col("fact")).alias("fact"),
        F.when(is_def, F.col("pos")).when(F.col("fact") == ON, F.col("jn_pos")).otherwise(F.col("ev_pos")).alias("at"),
        F.when(is_def, 0).otherwise(F.col("item_no")).alias("item_no"),
    )
    return grouped.agg(
        F.max("def").alias("def"),
        F.max("scope").cast("int").alias("scope"),
        F.max("opener").alias("opener"),
        F.max(F.when(F.col("sep"), F.col("u"))).alias("connective"),
        F.array_sort(F.collect_list("piece")).alias("pieces"),
    )

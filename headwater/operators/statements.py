"""Cut scripts into statements and pick the one that drives lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import table_key
from .tokens import IDENT_RX, before, last_seen, running, tokens, with_depth

DML = ["INSERT", "UPDATE", "DELETE", "MERGE"]
PREFERRED = ["INSERT", "MERGE", "SELECT_INTO"]

# Words that start a statement carrying no lineage of its own.
NOISE_STARTS = [
    "DECLARE", "EXEC", "EXECUTE", "USE", "PRINT", "RETURN", "IF", "WHILE", "RAISERROR", "THROW",
    "TRUNCATE", "CREATE", "ALTER", "DROP", "OPEN", "CLOSE", "FETCH", "DEALLOCATE", "COMMIT",
    "ROLLBACK", "GRANT", "GOTO", "WAITFOR",
]

def _text_order() -> Window:
    return Window.partitionBy("path").orderBy("pos")


def _event(u: Column, b1: Column, a1: Column, a2: Column, a3: Column) -> Column:
    """What the token starts when it stands outside all parentheses, else null."""
    a1u, a2u = F.upper(a1), F.upper(a2)
    word = a1.rlike(IDENT_RX)
    in_list = b1.isin(",", ".", "SELECT", "BY", "AND", "OR", "AS", "=", "+", "-", "*", "/", "<", ">")
    return (
        F.when((u == ";") | F.col("is_go"), "END")
        .when((u == "BEGIN"), "BLOCK")
        .when(
            (u == "INSERT") & word & ~a1u.isin("ON", "AS", "TO")
            & ~b1.isin("THEN", "FOR", "ON", "AFTER", "OF", ",", ".", "BULK", "GRANT", "DENY", "REVOKE"), "INSERT")
        .when(
            (u == "UPDATE") & ~b1.isin("THEN", "FOR", "ON", "AFTER", ",")
            & (a1 != "(") & (a1u != "STATISTICS"), "UPDATE")
        .when((u == "DELETE") & ~b1.isin("THEN", "FOR", "ON", "AFTER", ","), "DELETE")
        .when((u == "MERGE") & word & (a1u != "JOIN"), "MERGE")
        .when((u == "SELECT") & ~b1.isin("UNION", "ALL", "EXCEPT", "INTERSECT", "FOR"), "SELECT")
        .when(
            (u == "WITH") & word & (((a2u == "AS") & (a3 == "(")) | (a2 == "(")), "WITH")
        .when((u == "SET") & (a1.startswith("@") | a2.rlike(r"^[\p{L}\p{N}_@#;]")), "NOISE")
        .when(u.isin(*NOISE_STARTS) & ~in_list & (word | (a1 == "(") | a1.startswith("'")), "NOISE")
    )


def statement_tokens(scripts: DataFrame) -> DataFrame:
    """Tokens with `stmt_no`, the statement `kind` seen so far and running counters.

    Every step is a window in text order over one script: one sort, no exchange beyond
    the one that brought the script here.
    """
    rows = with_depth(tokens(scripts))
    at = lambda n, c="utok": F.coalesce(F.lag(c, n).over(_text_order()), F.lit(""))
    to = lambda n: F.coalesce(F.lead("tok", n).over(_text_order()), F.lit(""))
    next_raw = F.lead("raw", 1).over(_text_order())
    rows = rows.select(
        "*", at(1).alias("b1"), at(2).alias("b2"), at(3).alias("b3"), at(4).alias("b4"), to(1).alias("a1"), to(2).alias("a2"),
        to(3).alias("a3"), F.lag("pos", 1).over(_text_order()).alias("bpos"),
        (
            (F.col("utok") == "GO")
            & (F.col("raw").contains("\n") | (F.col("pos") == 0))
            & (next_raw.isNull() | next_raw.rlike(r"^[^\S\n]*\n"))
        ).alias("is_go"),
    )
    u, top = F.col("utok"), F.col("depth") <= 0
    rows = rows.select(
        "*",
        F.when(top, _event(u, F.col("b1"), F.col("a1"), F.col("a2"), F.col("a3"))).alias("event"),
        u.rlike(IDENT_RX).alias("ident"),
        F.when(u == "CASE", 1).when(u == "END", -1).otherwise(0).alias("case_step"),
        F.when(top & u.isin("SELECT", "FROM", "INSERT", "MERGE"), u).alias("clause_word"),
        ((F.col("tok") != ".") & (F.col("b1") != ".")).alias("name_start"),
    )
    e, prev = F.col("event"), F.col("prev_event")
    rows = rows.select(
        "*",
        last_seen("event").over(before(["path"])).alias("prev_event"),
        last_seen("clause_word").over(before(["path"])).alias("prev_clause"),
        F.sum("case_step").over(running(["path"])).alias("case_cum"),
        last_seen(F.when(F.col("name_start"), F.struct("b1", "b2", "b3", "bpos"))).over(running(["path"])).alias("lead_in"),
    ).withColumn(
        "opens",
        e.isNotNull()
        & ~F.coalesce(
            (e.isin(*DML) & (prev == "WITH")) | (e.isin("SELECT", "WITH") & prev.isin("INSERT", "WITH")),
            F.lit(False)),
    )
    # A block END or ELSE closes the statement; CASE ... ELSE ... END does not.
    rows = rows.withColumn(
        "case_base",
        last_seen(F.when(F.col("opens"), F.col("case_cum") - F.col("case_step"))).over(running(["path"])),
    ).withColumn("case_depth", F.col("case_cum") - F.coalesce("case_base", F.lit(0)))
    cut = ((u == "END") & (F.col("case_depth") < 0)) | ((u == "ELSE") & top & (F.col("case_depth") <= 0))
    rows = rows.withColumn("cut", cut & ~F.col("opens")).withColumn("opens", F.col("opens") | F.col("cut"))

    top_word = lambda w: (top & (u == w)).cast("int")
    into = (top & (u == "INTO") & F.coalesce(F.col("prev_clause") == "SELECT", F.lit(False))).cast("int")
    from_ = (top & (u == "FROM") & (F.col("b1") != "DISTINCT")).cast("int")
    rows = rows.select(
        "*", top_word("SELECT").alias("n_sel"), into.alias("n_into"), from_.alias("n_from"),
        F.length(F.when(F.col("opens"), F.col("tok")).otherwise(F.col("raw"))).alias("n_chr"),
    )
    counters = ["n_sel", "n_into", "n_from", "n_chr"]
    return rows.select(
        "*",
        F.sum(F.col("opens").cast("int")).over(running(["path"])).cast("int").alias("stmt_no"),
        last_seen(
            F.when(F.col("cut"), "CUT").when(F.col("opens") | e.isin(*DML), e)
        ).over(running(["path"])).alias("word"),
        *[F.sum(c).over(running(["path"])).alias(f"{c}_cum") for c in counters],
        F.lag("lead_in", 1).over(_text_order()).alias("lead_in_before"),
    )


def _with_totals(rows: DataFrame) -> DataFrame:
    """On the last token of each statement, the totals since its first token; noise is dropped."""
    rows = rows.filter(F.col("word").isin(*DML, "SELECT", "WITH"))
    counters = ["n_sel", "n_into", "n_from", "n_chr"]
    start = F.struct(*[(F.col(f"{c}_cum") - F.col(c)).alias(c) for c in counters], "pos")
    rows = rows.select(
        "*",
        last_seen(F.when(F.col("opens"), start)).over(running(["path"])).alias("start"),
        F.coalesce(F.lead("opens", 1).over(_text_order()), F.lit(True)).alias("is_end"),
    )
    since = lambda c: F.col(f"{c}_cum") - F.col(f"start.{c}")
    kind = F.when((since("n_into") > 0) & F.col("word").isin("SELECT", "WITH"), "SELECT_INTO").when(
        F.col("word").isin(*DML), F.col("word"))
    return rows.select(
        "*", kind.alias("kind"), since("n_chr").alias("n_chars"), F.col("start.pos").alias("start_pos"),
        (
            (since("n_sel") > 0) | (kind == "MERGE") | ((kind == "UPDATE") & (since("n_from") > 0))
        ).alias("has_select"),
    )


def statements(scripts: DataFrame) -> DataFrame:
    """One row per DML statement: number among DML statements, type, size, has_select, text."""
    rows = _with_totals(statement_tokens(scripts))
    whole = (
        rows.groupBy("path", "stmt_no")
        .agg(
            F.max(F.when(F.col("is_end"), F.struct("kind", "has_select", "n_chars", "start_pos"))).alias("t"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), ""
            ).alias("text"),
        )
    )
    numbered = whole.filter("t.kind is not null").select(
        "path",
        F.row_number().over(Window.partitionBy("path").orderBy("stmt_no")).alias("stmt_no"),
        F.col("t.kind").alias("type"), F.col("t.has_select").alias("has_select"),
        F.trim(F.regexp_replace("text", r"^\s+", "")).alias("text"), F.col("t.start_pos").alias("start_pos"),
    )
    return numbered


def primary_statement(stmts: DataFrame) -> DataFrame:
    """The statement of each script that drives lineage: preferred kinds, then length, then order."""
    order = F.struct(F.col("type").isin(*PREFERRED), F.length("text"), -F.col("stmt_no"))
    return (
        stmts.filter("has_select")
        .groupBy("path")
        .agg(F.max_by(F.struct("stmt_no", "type", "has_select", "text", "start_pos"), order).alias("s"))
        .select("path", "s.*")
    )


def lineage_tokens(scripts: DataFrame, primary_only: bool = True) -> DataFrame:
    """Tokens of the statements that drive lineage, with the final `kind`."""
    rows = _with_totals(statement_tokens(scripts))
    usable = F.col("is_end") & F.col("has_select") & F.col("kind").isNotNull()
    whole = Window.partitionBy("path")
    if primary_only:
        rank = F.struct(F.col("kind").isin(*PREFERRED).alias("pref"), "n_chars", (-F.col("stmt_no")).alias("no"),
                        F.col("kind").alias("kind"))
        rows = rows.withColumn("best", F.max(F.when(usable, rank)).over(whole))
        rows = rows.filter(F.col("stmt_no") == -F.col("best.no")).withColumn("kind", F.col("best.kind"))
    else:
        each = Window.partitionBy("path", "stmt_no")
        rows = rows.withColumn("kind", F.max(F.when(usable, F.col("kind"))).over(each))
        rows = rows.filter("kind is not null")
    return rows.select(
        "path", "stmt_no", "kind", "pos", "raw", "tok", "utok", "ident", "depth", "case_depth",
        "b1", "b2", "b3", "b4", "bpos", "a1", "a2", "name_start", "lead_in", "lead_in_before",
    )


def procedure_name(txt: Column) -> Column:
    """Bare name after CREATE/ALTER PROC[EDURE]; empty when there is none."""
    part = r'(?:\[[^\]]+\]|"[^"]+"|[\p{L}\p{N}_#@$]+)'
    rx = rf"(?i)\b(?:CREATE(?:\s+OR\s+ALTER)?|ALTER)\s+PROC(?:EDURE)?\s+({part}(?:\s*\.\s*{part})*)"
    return table_key(F.regexp_extract(txt, rx, 1))

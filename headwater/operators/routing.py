"""Complexity of scripts, the extraction method to try first, and the waterfall of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import utc_iso
from ..sources.schemas import METHODS, MODEL_METHODS

# Patterns that measure a script, thresholds and weights.
COUNTS = {
    "statement_count": r"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+(?:FROM\s+)?|MERGE(?:\s+INTO)?)\b",
    "join_count": r"(?i)\b(?:INNER|LEFT|RIGHT|FULL|CROSS)\s+(?:OUTER\s+)?JOIN\b",
    "case_when_count": r"(?i)\bCASE\b",
    "nested_subquery_count": r"(?i)\(\s*SELECT\b",
}
FLAGS = {
    "has_try_catch": r"(?i)\bBEGIN\s+TRY\b",
    "has_dynamic_sql": r"(?i)\bsp_executesql\b|\bEXEC\s*\(\s*@",
    "has_cursor": r"(?i)\bDECLARE\s+\w+\s+CURSOR\b",
    "has_pivot_unpivot": r"(?i)\b(?:PIVOT|UNPIVOT)\b",
    "has_merge": r"(?i)\bMERGE\b",
    "has_cte": r"(?i)\bWITH\s+\w+\s+AS\s*\(",
}
SELECT_LIST = r"(?is)\bSELECT\b(.*?)\bFROM\b"
MULTIWORD = r"\[[^\]]*\s[^\]]*\]"
THRESHOLDS = {"lines": 80, "statements": 1, "joins": 4, "cases": 6, "subqueries": 0, "columns": 15, "multiword": 10, "score": 5}


def top_level_commas(c: Column) -> Column:
    """Commas of one text outside parentheses and literals."""
    marks = F.regexp_replace(F.regexp_replace(c, "'[^']*'|\"[^\"]*\"", ""), r"[^(),]", "")
    step = lambda acc, m: F.struct(
        (acc["depth"] + F.when(m == "(", 1).when(m == ")", -1).otherwise(0)).alias("depth"),
        (acc["n"] + F.when((m == ",") & (acc["depth"] == 0), 1).otherwise(0)).alias("n"))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))
    return F.aggregate(F.split(marks, ""), zero, step, lambda acc: acc["n"])


def signals(scripts: DataFrame, *more: Column) -> DataFrame:
    """Thirteen measures of the raw text, comments included, and whatever else one scan should yield."""
    txt = F.col("txt")
    n = lambda rx: F.regexp_count(txt, F.lit(rx)).cast("bigint")
    lists = F.regexp_extract_all(txt, F.lit(SELECT_LIST), F.lit(1))
    widest = F.array_max(F.transform(lists, lambda s: top_level_commas(s) + 1))
    body = F.regexp_replace(txt, r"\n$", "")
    return scripts.select(
        "path", "source_file",
        F.when(txt == "", F.lit(0)).otherwise(F.size(F.split(body, "\n"))).cast("bigint").alias("line_count"),
        *[n(rx).alias(name) for name, rx in COUNTS.items()],
        *[txt.rlike(rx).alias(name) for name, rx in FLAGS.items()],
        F.coalesce(widest, F.lit(0)).cast("bigint").alias("max_select_column_count"),
        n(MULTIWORD).alias("bracketed_multiword_identifier_count"), *more)


def _rules() -> list[tuple[Column, int, Column]]:
    c, t = F.col, THRESHOLDS
    over = lambda name, key, weight, text: (c(name) > t[key], weight, F.format_string(text, c(name)))
    flag = lambda name, weight, text: (c(name), weight, F.lit(text))
    return [
        over("line_count", "lines", 1, "long procedure (%d lines)"),
        over("statement_count", "statements", 1, "multiple DML statements (%d)"),
        over("join_count", "joins", 1, "many joins (%d)"),
        over("case_when_count", "cases", 1, "many CASE expressions (%d)"),
        over("nested_subquery_count", "subqueries", 2, "nested subqueries (%d)"),
        over("max_select_column_count", "columns", 1, "wide SELECT list (%d columns)"),
        flag("has_dynamic_sql", 3, "dynamic SQL detected"),
        flag("has_cursor", 3, "cursor detected"),
        flag("has_pivot_unpivot", 2, "PIVOT/UNPIVOT detected"),
        flag("has_cte", 1, "common table expression (WITH) detected"),
        flag("has_merge", 1, "MERGE statement detected"),
        over("bracketed_multiword_identifier_count", "multiword", 1, "heavy use of bracketed multi-word identifiers (%d)"),
    ]


def score(signal_rows: DataFrame) -> DataFrame:
    """Add `score` and the list of `reasons`."""
    rules = _rules()
    total = sum((F.when(cond, w).otherwise(0) for cond, w, _ in rules), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(cond, text) for cond, _, text in rules]))
    return signal_rows.withColumns({"score": total.cast("bigint"), "reasons": reasons})


def recommend(scored: DataFrame, prefer_model: str) -> DataFrame:
    """Add `recommended`: the model for dynamic SQL, cursors and high scores, else regex."""
    if prefer_model not in MODEL_METHODS:
        raise ValueError(f"prefer_model must be one of {MODEL_METHODS}")
    to_model = F.col("has_dynamic_sql") | F.col("has_cursor") | (F.col("score") >= THRESHOLDS["score"])
    return scored.withColumn("recommended", F.when(to_model, prefer_model).otherwise("regex"))


def valid_overrides(overrides: DataFrame) -> DataFrame:
    """Lower-case the method, drop unknown methods."""
    return overrides.withColumn("method", F.lower("method")).filter(F.col("method").isin(*METHODS))


def merge_overrides(overrides: DataFrame) -> DataFrame:
    """One override per file: the highest priority wins. File names match in any case."""
    return valid_overrides(overrides).groupBy(F.lower("source_file").alias("file_key")).agg(
        F.max_by("method", F.struct("priority", "method")).alias("method"))


def route(recommended: DataFrame, overrides: DataFrame) -> DataFrame:
    """(path, source_file, method, is_override): override, then recommendation."""
    over = merge_overrides(overrides).withColumnRenamed("method", "forced")
    return recommended.withColumn("file_key", F.lower("source_file")).join(over, "file_key", "left").select(
        "path", "source_file", F.coalesce("forced", "recommended", F.lit("regex")).alias("method"),
        F.col("forced").isNotNull().alias("is_override"))


def attempts(routed: DataFrame, available: list[str]) -> DataFrame:
    """(path, source_file, rank, method, available): methods in the order they are tried.

    A recommendation starts at its method and goes forward; an override comes first and is
    followed by every other method, also when it is not available itself.
    """
    order = [m for m in METHODS if m in available]
    if not order:
        raise ValueError("no extraction method is available")
    arr = F.array(*[F.lit(m) for m in order])
    at = F.array_position(arr, F.col("method")).cast("int")
    plan = F.when(F.col("is_override"), F.array_prepend(F.array_remove(arr, F.col("method")), F.col("method"))).when(
        at > 0, F.slice(arr, F.greatest(at, F.lit(1)), len(order))).otherwise(arr)
    return routed.select("path", "source_file", F.posexplode(plan).alias("rank", "method")).withColumn(
        "available", F.col("method").isin(*order))


def waterfall(plan: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(winners, failures): the first attempt that has a candidate record wins.

    `candidates` has (path, method, error) and any record columns; error null means success.
    Attempts are combined per script before the shuffle, so repeats of a script do no harm.
    """
    found = candidates.select("path", "method", F.col("error").isNull().alias("ok"), F.col("error").alias("message"))
    tried = plan.join(found.groupBy("path", "method").agg(
        F.max("ok").alias("ok"), F.min("message").alias("message")), ["path", "method"], "left")
    message = F.when(~F.col("available"), F.lit("method forced by override is not available")).otherwise(
        F.coalesce("message", F.lit("Returned None")))
    tried = tried.withColumn("ok", F.coalesce("ok", F.lit(False)) & F.col("available")).withColumn("message", message)
    each = tried.groupBy("path", "source_file").agg(
        F.min_by("method", F.when(F.col("ok"), F.col("rank"))).alias("winner"),
        *[F.max(F.when(F.col("method") == m, F.col("message"))).alias(f"e_{m}") for m in METHODS])
    winners = each.filter("winner is not null").select("path", "source_file", F.col("winner").alias("method"))
    skipped = F.lit("Skipped (not attempted, started at later step)")
    failed = each.filter("winner is null").select(
        "path", "source_file", F.lit("All attempted extraction steps failed").alias("failure_reason"),
        *[F.coalesce(f"e_{m}", skipped).alias(f"step{i}_error") for i, m in enumerate(METHODS, 1)])
    return winners, failed


def failure_records(failed: DataFrame, snippets: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Failure log rows with the time and the start of the script, from `snippets(path, sp_snippet)`."""
    stamp = utc_iso() if timestamp is None else timestamp
    return failed.join(snippets.select("path", "sp_snippet"), "path").select(
        stamp.alias("timestamp"), "source_file", "failure_reason", "step1_error", "step2_error", "step3_error",
        "step4_error", "sp_snippet")


def user_stage(scripts: DataFrame, fn, schema: str) -> DataFrame:
    """Run a user extractor over Arrow batches: `fn(txt) -> dict | None`, errors become a column.

    `schema` is the record schema; the result adds path, source_file and error.
    """
    import pandas as pd

    fields = scripts.sparkSession.createDataFrame([], schema).columns

    def run(batches):
        for batch in batches:
            out = []
            for path, name, txt in zip(batch["path"], batch["source_file"], batch["txt"]):
                row = {"path": path, "source_file": name, "error": None}
                try:
                    record = fn(txt)
                    row.update(record or {})
                    row["error"] = None if record is not None else "Returned None"
                except Exception as e:  # the error is data here
                    row["error"] = f"Exception: {e}"
                out.append(row)
            yield pd.DataFrame(out, columns=["path", "source_file", *fields, "error"], dtype=object)

    return scripts.select("path", "source_file", "txt").mapInPandas(
        run, f"path STRING, source_file STRING, {schema}, error STRING")

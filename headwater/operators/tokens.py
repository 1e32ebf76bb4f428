"""Token table: one row per lexical token of each script, in text order.

The script text is shuffled once, by `path`. Explode and windows keep that partitioning,
so every operator built on this table runs without another exchange, and one task never
holds more than one script of a key at a time (a path is one file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMMENT = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+\*/"
_LEVELS = 16  # of nested block comments that the pattern takes; texts that may nest deeper are scanned first
for _ in range(_LEVELS - 1):
    _COMMENT = rf"/\*(?:[^*/]++|\*(?!/)|{_COMMENT}|/(?!\*))*+\*/"

TOKEN_RX = "|".join([
    r"\s*(?:[Nn]?'(?:[^']++|'')*+'",      # literal, quotes doubled inside
    r'"[^"]*+"',
    r"\[[^\]]*+\]",
    r"--[^\n]*+",
    _COMMENT,
    r"[\p{L}_#@$][\p{L}\p{N}_#@$]*+",
    r"\d++(?:\.\d*+)?(?:[eE][-+]?\d+)?",
    r"\S)",
])

IDENT_RX = r'^(?s:[\p{L}_#@$][\p{L}\p{N}_#@$]*+|\[.*\]|".*")$'


def running(by: list[str], order: str = "pos") -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def before(by: list[str], order: str = "pos") -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def last_seen(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def by_script(scripts: DataFrame, key: str = "path") -> DataFrame:
    """Shuffle whole scripts by key, once.

    The partition count is given so that AQE does not merge partitions by the size of the
    compressed text: the token rows made from it are many times larger.
    """
    # The filter is one Spark infers for joins on the key; stated here, both sides share a shuffle.
    return scripts.filter(scripts[key].isNotNull()).repartition(int(scripts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Cuts a text into characters that open or close something, and what lies between them.
_MARKS = r"""[/*\-'"\[\]\n]|[^/*\-'"\[\]\n]++"""
_SCAN = "STRUCT<at: INT, last: STRING, mode: STRING, depth: INT, since: INT, kept: ARRAY<STRUCT<at: INT, to: INT>>>"


def without_block_comments(txt: Column) -> Column:
    """The text with each block comment, nested to any depth, replaced by a blank; one without an end reaches to the end.

    One scan over the marks of a text keeps what is open (a literal, a quoted name, a line or block comment) and how
    deep; marks inside literals and names open nothing, and quotes inside comments neither.
    """
    def step(s: Column, mark: Column) -> Column:
        mode, depth = s["mode"], s["depth"]
        pair = F.concat(s["last"], mark)  # `last` is a mark that may be the first half of a pair
        deeper = mode.isin("", "/*") & (pair == "/*")
        less = (mode == "/*") & (pair == "*/")
        line = (mode == "") & (pair == "--")
        opens = (mode == "") & mark.isin("'", '"', "[")
        closes = F.when(mode == "[", mark == "]").when(mode == "--", mark == "\n").otherwise(mark == mode) & ~mode.isin("", "/*")
        end = s["at"] + F.length(mark)
        return F.struct(
            end.alias("at"),
            F.when(mark.isin("/", "*", "-") & ~deeper & ~less & ~line, mark).otherwise("").alias("last"),
            F.when(deeper | line, pair).when(opens, mark).when(closes | (less & (depth == 1)), "").otherwise(mode).alias("mode"),
            F.when(deeper, depth + 1).when(less, depth - 1).otherwise(depth).alias("depth"),
            F.when(less & (depth == 1), end).otherwise(s["since"]).alias("since"),
            F.when(deeper & (depth == 0), F.concat(s["kept"], F.array(F.struct(s["since"].alias("at"), (end - 2).alias("to"))))).otherwise(s["kept"]).alias("kept"),
        ).cast(_SCAN)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.lit("").alias("mode"), F.lit(0).alias("depth"), F.lit(0).alias("since"),
                     F.array().cast("ARRAY<STRUCT<at: INT, to: INT>>").alias("kept")).cast(_SCAN)
    last = lambda s: F.when(s["depth"] > 0, s["kept"]).otherwise(
        F.concat(s["kept"], F.array(F.struct(s["since"].alias("at"), s["at"].alias("to")))))
    spans = F.aggregate(F.regexp_extract_all(txt, F.lit(_MARKS), F.lit(0)), start, step, last)
    return F.array_join(F.transform(spans, lambda k: F.substring(txt, k["at"] + 1, k["to"] - k["at"])), " ")


def _scannable(txt: Column) -> Column:
    """The text, scanned first if it may hold comments deeper than the token pattern takes, or one without an end."""
    opened, closed = F.regexp_count(txt, F.lit(r"/\*")), F.regexp_count(txt, F.lit(r"\*/"))
    return F.when((opened >= _LEVELS) | (opened != closed), without_block_comments(txt)).otherwise(txt)


def tokens(scripts: DataFrame, key: str = "path", keep_comments: bool = False) -> DataFrame:
    """(key, pos, raw, tok, utok): `raw` keeps the white space in front of the token."""
    # An inner explode would make Spark tokenise each text a second time, in a filter on the
    # size of the array below the shuffle.
    rows = by_script(scripts, key).select(
        key, F.posexplode_outer(F.regexp_extract_all(
            F.col("txt") if keep_comments else _scannable(F.col("txt")), F.lit(TOKEN_RX), F.lit(0))).alias("pos", "raw")
    )
    rows = rows.filter("raw is not null").withColumn("tok", F.regexp_replace("raw", r"^\s+", ""))
    if not keep_comments:
        rows = rows.filter(~(F.col("tok").startswith("--") | F.col("tok").rlike(r"^/\*.")))
    return rows.withColumn("utok", F.upper("tok"))


def with_depth(rows: DataFrame, key: str = "path") -> DataFrame:
    """Add `depth`: parentheses around the token; both parentheses count as inside."""
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
    closing = F.when(F.col("tok") == ")", 1).otherwise(0)
    return rows.withColumn("depth", F.sum(step).over(running([key])).cast("int") + closing)

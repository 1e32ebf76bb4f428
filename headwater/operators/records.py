"""Assemble lineage records from statement facts and open them up as fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import classify
from ..functions.names import drop_brackets, file_name, table_key
from ..functions.shared import kept
from ..sources.schemas import MAPPING
from . import facts as X
from . import scopes
from .facts import KEY, RESERVED
from .statements import procedure_name
from .tokens import by_script

_NAMED = "ARRAY<STRUCT<name: STRING, tables: ARRAY<STRING>>>"


def _lookup(entries: Column, name: Column) -> Column:
    """Tables of the last entry called `name`, or null."""
    return F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(-1))["tables"]


def _inside(tables: Column, d: Column) -> Column:
    return F.filter(tables, lambda t: (t["pos"] > d["open_pos"]) & (t["pos"] < d["pos"]))


def _base_tables(tables: Column, ctes: Column) -> Column:
    """Distinct tables with every CTE name replaced by the tables it reads."""
    return F.array_distinct(F.flatten(F.transform(
        tables, lambda t: F.coalesce(_lookup(ctes, t["table"]), F.array(t["table"])))))


def _differ(a: Column, b: Column) -> Column:
    """Whether two names of up to three parts cannot be one table; a shorter one may be the end of a longer one."""
    ends = lambda x, y: F.concat(F.lit("."), x).endswith(F.concat(F.lit("."), y))
    return ~(ends(a, b) | ends(b, a) | a.contains("..") | b.contains(".."))


def _statement_scope(rows: DataFrame) -> DataFrame:
    """Per statement: target, source tables, alias entries, joins and the items to resolve."""
    is_def = F.col("def").isNotNull()
    rows = rows.groupBy(*KEY, "kind").agg(
        F.transform(F.array_sort(F.collect_list(F.when(is_def, F.struct("at", "def")))), lambda x: x["def"]).alias("defs"),
        F.collect_list(F.when(~is_def, F.struct("fact", "at", "item_no", "connective", "scope", "opener", "pieces"))).alias("items"),
    )
    defs = F.col("defs")
    rows = rows.select(
        "*",
        F.filter(defs, lambda d: (d["what"] == "T") & (d["use"] == "source")).alias("tabs"),
        F.filter(defs, lambda d: d["what"] == "C").alias("cte_defs"),
        F.try_element_at(F.filter(defs, lambda d: (d["what"] == "T") & (d["use"] == "target")), F.lit(1)).alias("target_def"),
    ).withColumn("target_name", F.col("target_def.table"))
    # A CTE sees those defined before it, so one pass in text order expands chains of them.
    ctes = F.aggregate(
        "cte_defs", F.array().cast(_NAMED),
        lambda acc, c: F.concat(acc, F.array(F.struct(
            c["table"].alias("name"),
            F.filter(_base_tables(_inside(F.col("tabs"), c), acc), lambda n: n != c["table"]).alias("tables"),
        ))),
    )
    rows = rows.withColumn("ctes", ctes)
    alias_entry = lambda d: F.struct(
        d["alias"].alias("name"),
        F.when(d["what"] == "D", _base_tables(_inside(F.col("tabs"), d), F.col("ctes")))
        .otherwise(F.coalesce(_lookup(F.col("ctes"), d["table"]), F.array(d["table"]))).alias("tables"))
    own_entry = lambda d: F.struct(
        F.lower(d["table"]).alias("name"),
        F.coalesce(_lookup(F.col("ctes"), d["table"]), F.array(d["table"])).alias("tables"))
    rows = rows.withColumn("aliases", F.concat(
        F.transform("tabs", own_entry),
        F.transform(F.filter(defs, lambda d: d["alias"].isNotNull()), alias_entry)).cast(_NAMED))
    first = lambda a: F.try_element_at(a, F.lit(1))
    target = F.when(F.col("kind") == "UPDATE", F.coalesce(
        first(_lookup(F.col("aliases"), F.lower("target_name"))), F.col("target_name"))).otherwise(F.col("target_name"))
    rows = rows.withColumn("target_table", target)
    # The target itself is no source of its own, but a table of its name in another schema or database is.
    names_other = F.exists("tabs", lambda t: (t["table"] == F.col("target_table")) & _differ(t["full"], F.col("target_def.full")))
    rows = rows.withColumn("other_target", F.coalesce((F.col("target_table") == F.col("target_name")) & names_other, F.lit(False)))
    real = lambda n: (n != "") & ~n.rlike("^[#@]") & (F.col("other_target") | ~n.eqNullSafe(F.col("target_table")))
    right = lambda n: F.try_element_at(
        F.filter(F.col("defs"), lambda d: (d["what"] != "N") & (d["join_pos"] == n["join_pos"])), F.lit(1))
    resolved = lambda d: F.coalesce(
        F.when(d["what"] == "D", first(_base_tables(_inside(F.col("tabs"), d), F.col("ctes"))))
        .otherwise(first(F.coalesce(_lookup(F.col("ctes"), d["table"]), F.array(d["table"])))),
        F.upper(d["alias"]), F.lit(""))
    rows = rows.withColumn("scopes", scopes.scopes(defs))
    # A column list belongs to the expression it precedes, or to the derived table of that name it follows.
    lists = F.transform(F.filter("defs", lambda d: d["what"].isin("C", "D")), lambda d: F.struct(
        d["open_pos"].alias("scope"), d["list_pos"].alias("list"), d["pos"].alias("close"), F.when(d["what"] == "D", d["alias"]).alias("alias")))
    return rows.select(
        *KEY, "kind", "target_table", "aliases", "items", "scopes", scopes.uses(defs, F.col("scopes")).alias("uses"), lists.alias("lists"),
        F.array_sort(F.filter(_base_tables(F.col("tabs"), F.col("ctes")), real)).alias("source_tables"),
        F.coalesce("target_def.full", "target_table").alias("target_full"),
        F.transform("tabs", lambda t: F.struct(t["table"].alias("table"), F.when(
            F.coalesce((t["table"] != F.col("target_table")) | ~F.col("other_target") | _differ(t["full"], F.col("target_def.full")), F.lit(True)),
            t["full"]).alias("full"))).alias("names"),
        first(_base_tables(F.slice("tabs", 1, 1), F.col("ctes"))).alias("left_table"),
        F.transform(F.filter(defs, lambda d: d["what"] == "N"), lambda n: F.struct(
            n["join_pos"].alias("at"), n["side"].alias("join_type"), scopes._let(right(n), resolved).alias("right_table"))).alias("join_defs"),
        F.transform(
            F.array_sort(F.transform(
                F.filter("items", lambda i: i["fact"] == X.INSERT_COLUMN),
                lambda i: F.struct(i["item_no"], F.try_element_at(i["pieces"], F.lit(-1))["raw"].alias("n")))),
            lambda x: table_key(x["n"])).alias("insert_columns"),
        F.array_min(F.transform(F.filter("items", lambda i: i["fact"] == X.SELECT), lambda i: i["at"])).alias("first_select"),
    )


def _text(pieces: Column) -> Column:
    return F.regexp_replace(F.array_join(F.transform(pieces, lambda p: p["raw"]), ""), r"^\s+|\s+$", "")


def _resolved_text(pieces: Column, aliases: Column) -> Column:
    """Text with alias prefixes replaced by table names and brackets removed."""
    def word(p):
        tables = F.when(p["key"].isNotNull(), _lookup(aliases, p["key"]))
        return F.when(F.size(tables) == 1, F.concat(F.regexp_extract(p["raw"], r"^\s*", 0), tables[0])).otherwise(p["raw"])
    joined = F.array_join(F.transform(pieces, word), "")
    return drop_brackets(F.regexp_replace(joined, r"^\s+|\s+$", ""))


_NAME_RX = r'^(?s:[\p{L}_#][\p{L}\p{N}_#@$]*|\[.*\]|".*")$'


def _split_items(rows: DataFrame) -> DataFrame:
    """Add `label` (the column an item writes to, as text) and `expr` (tokens of its expression)."""
    p = F.col("pieces")
    select, set_ = F.col("fact").isin(X.SELECT, X.INNER_SELECT), F.col("fact") == X.SET
    word = lambda i: F.coalesce(F.try_element_at("words", i if isinstance(i, Column) else F.lit(i)), F.lit(""))
    is_first = select & (F.col("item_no") == 0)
    rows = rows.withColumn("words", F.transform(p, lambda x: F.when(x["own"], x["u"]).otherwise(F.lower(x["u"]))))
    # DISTINCT | ALL, then TOP n | TOP (n) [PERCENT] [WITH TIES], belong to no item.
    rows = rows.withColumn("n1", F.when(is_first & word(1).isin("DISTINCT", "ALL"), 1).otherwise(0))
    rows = rows.withColumn(
        "n2",
        F.when(is_first & (word(F.col("n1") + 1) == "TOP"), F.when(
            word(F.col("n1") + 2) == "(", F.array_position(F.transform(p, lambda x: x["u"]), ")").cast("int")
        ).otherwise(F.col("n1") + 2)).otherwise(F.col("n1")))
    rows = rows.withColumn("n3", F.col("n2") + F.when(
        (F.col("n2") > F.col("n1")) & (word(F.col("n2") + 1) == "PERCENT"), 1).otherwise(0))
    rows = rows.withColumn("start", F.col("n3") + F.when(
        (F.col("n2") > F.col("n1")) & (word(F.col("n3") + 1) == "WITH"), 3).otherwise(1))
    rows = rows.withColumns({
        "size": F.size(p) - F.col("start") + 1, "w_last": word(-1), "w_prev": word(-2),
        "w_head": word(F.col("start")), "w_next": word(F.col("start") + 1),
        "eq": F.array_position("words", "=").cast("int"),
    })
    named = F.col("w_last").rlike(_NAME_RX) & ~F.col("w_last").isin(*RESERVED)
    ends_value = F.col("w_prev").rlike(r"^(?s:[\p{L}_#\[\"'\d].*|\))$") & (
        ~F.col("w_prev").isin(*RESERVED) | (F.col("w_prev") == "END"))
    rows = rows.withColumn(
        "shape",
        F.when(select & (F.col("size") >= 3) & (F.col("w_prev") == "AS"), "as")
        .when(select & (F.col("size") >= 3) & (F.col("w_next") == "=")
              & F.col("w_head").rlike(r"^[\p{L}_#@\[\"]"), "equals")
        .when(select & (F.col("size") >= 2) & named & ends_value, "plain")
        .when(set_ & (F.col("eq") > 1), "set"))
    shape, start, size = F.col("shape"), F.col("start"), F.col("size")
    raw = lambda i: F.try_element_at(p, i)["raw"]
    left = F.col("eq") - F.when(word(F.col("eq") - 1).rlike(r"^[-+*/%&|^]$"), 2).otherwise(1)
    return rows.withColumns({
        "label": F.when(shape.isin("as", "plain"), raw(F.lit(-1))).when(shape == "equals", raw(start))
        .when(shape == "set", raw(left))
        .when(F.col("fact") == X.VALUE, F.get("insert_columns", F.col("item_no"))),
        "expr": F.when(shape == "set", F.slice(p, F.col("eq") + 1, F.size(p)))
        .when(select, F.slice(
            p, start + F.when(shape == "equals", 2).otherwise(0),
            F.greatest(size - F.when(shape.isin("as", "equals"), 2).when(shape == "plain", 1).otherwise(0), F.lit(0))))
        .otherwise(p),
    }).drop("words", "n1", "n2", "n3", "start", "size", "w_last", "w_prev", "w_head", "w_next", "eq", "shape", "pieces")


@kept
def _texts() -> dict[str, Column]:
    return {
        "raw_text": _text(F.col("expr")),
        "text": _resolved_text(F.col("expr"), F.col("aliases")),
        "refs": F.array_distinct(F.transform(
            F.filter("expr", lambda p: p["c"].isNotNull()), lambda p: F.struct(p["q"], p["c"]))),
    }


@kept
def _class() -> Column:
    return classify(F.col("raw_text"))


def resolved_items(scripts: DataFrame, primary_only: bool = True) -> DataFrame:
    """One row per clause item with its text resolved; also carries the statement scope."""
    scope = _statement_scope(X.fact_rows(scripts, primary_only))
    rows = scope.select(
        *[c for c in scope.columns if c != "items"], F.explode_outer("items").alias("item")
    )
    rows = rows.select("*", "item.*").drop("item")
    rows = _split_items(rows)
    return rows.withColumns(_texts()).withColumn("type", _class())


def _label() -> Column:
    return table_key(F.regexp_replace("label", r"^\s*[Nn]?'|'\s*$", ""))


def _item_mappings(x: Column, solved: Column) -> Column:
    """Mappings of one item: a row per base column the expression reads, through derived tables and expressions."""
    aliases, sources = F.col("aliases"), F.col("source_tables")
    # A name that is no scope's own: the tables of its alias, itself, or the only source of the statement.
    otherwise = lambda r: F.when(r["q"].isNull(), F.when(F.size(sources) == 1, sources).otherwise(F.array(F.lit("")))).otherwise(
        F.coalesce(F.nullif(_lookup(aliases, r["q"]), F.array().cast("array<string>")), F.array(F.upper(r["q"]))))
    reads = lambda r: F.transform(otherwise(r), lambda t: F.struct(t.alias("t"), r["c"].alias("c")))
    star = F.transform(sources, lambda t: F.struct(t.alias("t"), F.lit("*").alias("c"))).cast(scopes.READS)

    def of(o: Column) -> Column:
        blank = F.array(F.struct(F.lit("").alias("t"), F.when(o["type"] == "constant", o["raw"]).otherwise(x["text"]).alias("c"))).cast(scopes.READS)
        found = F.when(o["type"] == "constant", blank).when((x["raw"] == "*") & (o["name"].isNull()), star).when(F.size(o["reads"]) > 0, o["reads"]).otherwise(blank)
        simple = F.when((x["type"] == "direct_copy") & (F.size(x["refs"]) == 1), x["refs"][0]["c"])
        target = F.coalesce(x["label"], o["name"], simple, x["text"])
        logic = F.when(o["type"] == "constant", F.concat(F.lit("Constant value: "), o["raw"])).otherwise(drop_brackets(F.coalesce(o["raw"], x["raw"])))
        return F.transform(found, lambda r: F.struct(
            drop_brackets(target).alias("target_column"), r["t"].alias("source_table"), r["t"].alias("source_table_qualified"),
            drop_brackets(r["c"]).alias("source_column"), o["type"].alias("transformation_type"), logic.alias("transformation_logic"),
            x["item_no"].cast("int").alias("insert_position"), x["insert_column"].alias("insert_column")))

    return F.flatten(F.transform(scopes.expand(x, F.lit(scopes.TOP), F.col("uses"), solved, reads), of))


@kept
def _solved() -> Column:
    """Columns of every scope of a statement."""
    follows = lambda n, x: (n["alias"] == x["opener"]) & (n["close"] < x["scope"])
    names = F.flatten(F.transform("listed", lambda x: F.transform(
        F.filter("lists", lambda n: (n["list"] == x["scope"]) | follows(n, x)),
        lambda n: F.struct(n["scope"].alias("scope"), x["item_no"].alias("item_no"), x["name"].alias("name")))))
    return scopes.solve(F.col("scopes"), F.col("uses"), F.col("inner"), names)


@kept
def _mapped() -> Column:
    """Items of a statement with their mappings."""
    return F.transform("items", lambda x: F.struct(
        x["at"].alias("at"), x["item_no"].alias("item_no"), _item_mappings(x, F.col("solved")).alias("m")))


def statement_facts(scripts: DataFrame, primary_only: bool = True) -> DataFrame:
    """One row per lineage statement: target, sources, aliases, mappings, joins, filters, grouping."""
    rows = resolved_items(scripts, primary_only)
    f = F.col("fact")
    usable = f.isin(X.SELECT, X.SET, X.VALUE) & (F.size("expr") > 0) & ~F.coalesce(
        F.col("label").rlike(r"^\s*@"), F.lit(False))
    keep = lambda letters, value: F.array_sort(F.collect_list(F.when(f.isin(*letters), value)))
    simple = F.when((F.col("type") == "direct_copy") & (F.size("refs") == 1), F.col("refs")[0]["c"])
    of_scope = F.struct("scope", "at", "item_no", F.upper(F.coalesce(_label(), simple)).alias("name"), "refs", "type", F.col("raw_text").alias("raw"))
    rows = rows.groupBy(*KEY, "kind", "target_table", "left_table").agg(
        F.first("source_tables").alias("source_tables"), F.first("aliases").alias("aliases"),
        F.first("target_full").alias("target_full"), F.first("names").alias("found_names"),
        F.first("scopes").alias("scopes"), F.first("uses").alias("uses"), F.first("lists").alias("lists"),
        F.first("join_defs").alias("join_defs"), F.first("first_select").alias("first_select"),
        F.array_sort(F.collect_list(F.when(usable, F.struct(
            "at", "item_no", F.lit(None).cast("string").alias("name"), _label().alias("label"), "refs", "type", "text", F.col("raw_text").alias("raw"),
            F.get("insert_columns", F.col("item_no")).alias("insert_column"))))).alias("items"),
        keep([X.INNER_SELECT], of_scope).alias("inner"),
        keep([X.NAME_LIST], F.struct("scope", "item_no", F.upper(table_key("raw_text")).alias("name"), "opener")).alias("listed"),
        keep([X.ON], F.struct("at", "text")).alias("conditions"),
        keep([X.WHERE, X.HAVING], F.struct(
            "at", "item_no", F.when(f == X.WHERE, "WHERE").otherwise("HAVING").alias("clause"),
            F.when(F.col("item_no") > 0, F.col("connective")).alias("connective"), "text")).alias("filters"),
        keep([X.GROUP], F.struct("at", "item_no", "text")).alias("grouping"),
    )
    rows = rows.withColumn("solved", _solved()).withColumn("mapped", _mapped())
    condition = lambda n: F.coalesce(F.try_element_at(
        F.filter("conditions", lambda c: c["at"] == n["at"]), F.lit(1))["text"], F.lit(""))
    text = lambda c: F.filter(c, lambda x: x["text"] != "")
    # The first branch of a set operation names the columns of all branches.
    names = F.transform(
        F.filter("mapped", lambda x: x["at"] == F.col("first_select")),
        lambda x: F.struct(x["item_no"].alias("item_no"), F.try_element_at(x["m"], F.lit(1))["target_column"].alias("name")))
    rows = rows.withColumn("names", names)
    name_of = lambda x: F.try_element_at(F.filter("names", lambda y: y["item_no"] == x["item_no"]), F.lit(1))["name"]
    branch = lambda x: F.when(x["at"] <= F.col("first_select"), x["m"]).otherwise(F.transform(
        x["m"], lambda m: m.withField("target_column", F.coalesce(name_of(x), m["target_column"]))))
    later = F.exists("mapped", lambda x: x["at"] > F.col("first_select"))
    # Of the names a source was read by, the one of most characters, then the first in order.
    longest = lambda n: F.coalesce(F.array_min(F.transform(
        F.filter("found_names", lambda t: (t["table"] == n) & t["full"].isNotNull()),
        lambda t: F.struct((-F.length(t["full"])).alias("l"), t["full"].alias("full"))))["full"], n)
    qualified = F.when(F.col("target_full").endswith(F.col("target_table")), F.col("target_full")).otherwise(F.col("target_table"))
    return rows.select(
        *KEY, "kind", "target_table", qualified.alias("target_table_qualified"), "source_tables",
        F.transform("source_tables", longest).alias("source_tables_qualified"), "aliases",
        F.flatten(F.when(later, F.transform("mapped", branch)).otherwise(F.transform("mapped", lambda x: x["m"]))).cast(f"ARRAY<{MAPPING}>").alias("column_mappings"),
        F.transform("join_defs", lambda n: F.struct(
            F.coalesce("left_table", F.lit("")).alias("left_table"), F.coalesce("left_table", F.lit("")).alias("left_table_qualified"),
            n["right_table"].alias("right_table"), n["right_table"].alias("right_table_qualified"),
            n["join_type"].alias("join_type"), condition(n).alias("condition"))).alias("joins"),
        text(F.col("filters")).alias("filters"), text(F.col("grouping")).alias("grouping"),
    )


def _first_of_each(mappings: Column) -> Column:
    """Drop later mappings with the same target, source table and source column."""
    key = lambda m: F.struct(m["target_column"], m["source_table"], m["source_column"])
    # The keys are made once; inside the filter they would be made for each mapping.
    return scopes._let(F.transform(mappings, key), lambda keys: F.filter(
        mappings, lambda m, i: F.array_position(keys, key(m)) == i + 1))


# Why a script yields no lineage record, in the order the checks are made.
FAILURE_REASONS = ["no_primary", "no_target", "temp_target", "no_source", "no_mapping"]


def extract_lineage(scripts: DataFrame, primary_only: bool = True) -> DataFrame:
    """One row per script (per statement with primary_only=False); `failure` tells why it has no lineage."""
    facts = statement_facts(scripts, primary_only)
    # Both sides read one exchange of (path, txt). The merge hint keeps Spark from broadcasting
    # the facts by an estimate that does not know how many tokens a text holds.
    base = by_script(scripts).select(
        "path", file_name(F.col("path")).alias("source_file"), procedure_name(F.col("txt")).alias("procedure_name"))
    rows = base.hint("merge").join(facts, "path", "left")
    failure = (
        F.when(F.col("kind").isNull(), "no_primary")
        .when(F.coalesce("target_table", F.lit("")) == "", "no_target")
        .when(F.col("target_table").rlike("^[#@]"), "temp_target")
        .when(F.size("source_tables") == 0, "no_source")
        .when(F.size("column_mappings") == 0, "no_mapping")
    )
    return rows.select(
        "path", "source_file", "stmt_no", "procedure_name", "target_table",
        "target_table_qualified", "source_tables", "source_tables_qualified",
        _first_of_each(F.col("column_mappings")).alias("column_mappings"), "joins",
        F.transform("filters", lambda x: x["text"]).alias("filters"),
        F.transform("grouping", lambda x: x["text"]).alias("grouping"),
        F.lit("regex").alias("extraction_method"), failure.alias("failure"),
    )


def lineage_records(scripts: DataFrame, primary_only: bool = True) -> DataFrame:
    """Records of the scripts that yield lineage."""
    return extract_lineage(scripts, primary_only).filter("failure is null").drop("failure", "stmt_no")


def normalise(records: DataFrame, keep_qualified: bool = False) -> DataFrame:
    """Reduce table names to their identity. The *_qualified fields take the names of the record, or, with `keep_qualified`,
    stay what the extraction found: up to three parts of target and sources."""
    named = lambda c: F.coalesce(table_key(c), F.lit(""))
    mapping = lambda m: m.withField("source_table_qualified", m["source_table"]).withField(
        "source_table", named(m["source_table"]))
    join = lambda j: (
        j.withField("left_table_qualified", j["left_table"]).withField("right_table_qualified", j["right_table"])
        .withField("left_table", named(j["left_table"])).withField("right_table", named(j["right_table"])))
    found = lambda full, name: F.coalesce(F.col(full), F.col(name)) if keep_qualified else F.col(name)
    return records.withColumns({
        "target_table_qualified": found("target_table_qualified", "target_table"), "target_table": table_key(F.col("target_table")),
        "source_tables_qualified": found("source_tables_qualified", "source_tables"),
        "source_tables": F.transform("source_tables", table_key),
        "column_mappings": F.transform("column_mappings", mapping), "joins": F.transform("joins", join),
    })


# Fact tables: one row per fact, for joins and SQL.

def source_tables(scripts: DataFrame) -> DataFrame:
    return statement_facts(scripts).select("path", "target_table", F.explode("source_tables").alias("source_table"))


def aliases(scripts: DataFrame) -> DataFrame:
    """(path, alias, table): later definitions of an alias replace earlier ones."""
    rows = statement_facts(scripts).select("path", F.posexplode("aliases").alias("no", "a"))
    last = rows.groupBy("path", F.col("a.name").alias("alias")).agg(F.max_by("a.tables", "no").alias("tables"))
    return last.select("path", "alias", F.explode("tables").alias("table_name"))


def column_mappings(records: DataFrame) -> DataFrame:
    return records.select("path", "source_file", "target_table", F.posexplode("column_mappings").alias("seq", "m")).select(
        "path", "source_file", "target_table", "seq", "m.*")


def joins(records: DataFrame) -> DataFrame:
    return records.select("path", "source_file", F.posexplode("joins").alias("seq", "j")).select(
        "path", "source_file", "seq", "j.*")


def filters(scripts: DataFrame) -> DataFrame:
    return statement_facts(scripts).select("path", F.posexplode("filters").alias("seq", "f")).select(
        "path", "seq", F.col("f.clause").alias("clause"), F.col("f.connective").alias("connective"), F.col("f.text").alias("condition"))


def grouping(scripts: DataFrame) -> DataFrame:
    return statement_facts(scripts).select("path", F.posexplode("grouping").alias("seq", "g")).select(
        "path", "seq", F.col("g.text").alias("item"))

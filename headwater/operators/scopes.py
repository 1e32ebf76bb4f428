"""Columns of derived tables and common table expressions, followed down to the tables they come from.

A statement's definitions form a tree of scopes: each derived table or common table expression is one, the
statement itself is -1. A scope's select items say which of its columns read which columns of the names
it uses. Scopes are solved in the order in which they close: what a scope uses is solved by then. One
statement is one row here, and never exceeds its script.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = -1
READS = "ARRAY<STRUCT<t: STRING, c: STRING>>"
#: A column of a scope: what it reads, the class and the text of the expression that makes it.
_OUT = f"STRUCT<name: STRING, reads: {READS}, type: STRING, raw: STRING>"
_SOLVED = f"ARRAY<STRUCT<scope: INT, outs: ARRAY<{_OUT}>>>"
_USES = "ARRAY<STRUCT<name: STRING, scope: INT, pos: INT, table: STRING, target: INT, source: BOOLEAN, main: BOOLEAN>>"
SCOPES = "ARRAY<STRUCT<close: INT, scope: INT>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def scopes(defs: Column) -> Column:
    """Scopes by the place where they close."""
    return F.array_sort(F.transform(F.filter(defs, lambda d: d["what"].isin("D", "C")), lambda d: F.struct(
        d["pos"].alias("close"), d["open_pos"].alias("scope")))).cast(SCOPES)


def uses(defs: Column, found: Column) -> Column:
    """Names that a scope may prefix columns with, in text order: what they stand for, and in which scope."""
    inside = lambda d: F.coalesce(F.array_max(F.transform(
        F.filter(found, lambda s: (s["scope"] < d["pos"]) & (d["pos"] < s["close"])), lambda s: s["scope"])), F.lit(TOP))
    cte = lambda d: _last(F.filter(defs, lambda c: (c["what"] == "C") & (c["table"] == d["table"]) & (c["open_pos"] < d["pos"])))["open_pos"]
    target = lambda d: F.when(d["what"] == "D", d["open_pos"]).when(d["what"] == "T", cte(d))
    named = F.transform(F.filter(defs, lambda d: d["what"].isin("T", "D", "F")), lambda d: F.struct(
        inside(d).alias("scope"), d["pos"].alias("pos"), d["table"].alias("table"), target(d).alias("target"), d["alias"].alias("alias"),
        F.coalesce(d["use"] == "source", d["what"].isin("D", "F")).alias("source"),
        F.when((d["what"] == "T") & (d["use"] == "source"), F.lower(d["table"])).alias("own")))
    # One entry of each definition is its main one: the table's name, else the alias, which may be missing.
    entry = lambda d, name, main: F.struct(name.alias("name"), *[d[c].alias(c) for c in ("scope", "pos", "table", "target", "source")], main.alias("main"))
    return F.flatten(F.transform(named, lambda d: F.filter(
        F.array(entry(d, F.coalesce(d["own"], d["alias"]), F.lit(True)), entry(d, F.when(d["own"].isNotNull(), d["alias"]), F.lit(False))),
        lambda e: e["main"] | e["name"].isNotNull()))).cast(_USES)


def _outs(solved: Column, scope: Column) -> Column:
    return F.coalesce(_last(F.filter(solved, lambda s: s["scope"] == scope))["outs"], F.array().cast(f"ARRAY<{_OUT}>"))


def _out(name: Column, reads: Column, type_: Column, raw: Column) -> Column:
    return F.struct(name.alias("name"), reads.cast(READS).alias("reads"), type_.alias("type"), raw.alias("raw")).cast(_OUT)


def _read(t: Column, c: Column) -> Column:
    return F.array(F.struct(t.alias("t"), c.alias("c")))


def _column_of(entry: Column, c: Column, solved: Column) -> Column:
    """The column `c` of what an entry of `uses` stands for."""
    copy = F.lit("direct_copy")
    none = F.lit(None).cast("string")

    def of_scope(outs: Column) -> Column:
        stars = F.flatten(F.transform(F.filter(outs, lambda o: o["name"] == "*"), lambda o: o["reads"]))
        through = F.when(F.size(stars) == 1, _read(stars[0]["t"], c)).otherwise(_read(F.lit(""), c))
        return F.coalesce(_last(F.filter(outs, lambda o: o["name"] == F.upper(c))), _out(c, through, copy, none))

    # A scope that is not solved yet reads itself: a recursive expression, whose first branch says what it reads.
    itself = _out(c, F.array().cast(READS), copy, none)
    is_solved = F.exists(solved, lambda s: s["scope"] == entry["target"])
    return F.when(entry["target"].isNull(), _out(c, _read(entry["table"], c), copy, none)).when(
        is_solved, _let(_outs(solved, entry["target"]), of_scope)).otherwise(itself)


def resolve(ref: Column, scope: Column, names: Column, solved: Column, otherwise: Callable[[Column], Column]) -> Column:
    """The column that a reference (q, c) in a scope stands for. `otherwise` gives the reads of one that no name explains."""
    blank = _out(ref["c"], otherwise(ref), F.lit("direct_copy"), F.lit(None).cast("string"))
    called = F.filter(names, lambda u: u["name"] == ref["q"])
    prefixed = _let(called, lambda found: F.coalesce(_last(F.filter(found, lambda u: u["scope"] == scope)), _last(found)))
    has = lambda u, name: F.exists(_outs(solved, u["target"]), lambda o: o["name"] == name)
    first = lambda a: F.get(a, F.lit(0))

    # Without a prefix: the only name of the scope, the only one of the scopes it uses that has such a column, or, where
    # none has and none passes a star on, the only table beside them.
    def plain(local: Column) -> Column:
        having = F.filter(local, lambda u: u["target"].isNotNull() & has(u, F.upper(ref["c"])))
        tables = F.filter(local, lambda u: u["target"].isNull())
        stars = F.exists(local, lambda u: u["target"].isNotNull() & has(u, F.lit("*")))
        return F.when((F.size(local) == 1) & ((scope != TOP) | first(local)["target"].isNotNull()), first(local)).otherwise(
            _let(having, lambda h: F.when(F.size(h) == 1, first(h)).when(
                (F.size(h) == 0) & (F.size(local) > 1) & (F.size(tables) == 1) & ~stars, first(tables))))

    of_scope = F.filter(names, lambda u: (u["scope"] == scope) & u["source"] & u["main"])
    entry = F.when(ref["q"].isNotNull(), prefixed).otherwise(_let(of_scope, plain))
    return _let(entry, lambda e: F.when(e.isNull(), blank).otherwise(_column_of(e, ref["c"], solved)))


def expand(item: Column, scope: Column, names: Column, solved: Column, otherwise: Callable[[Column], Column]) -> Column:
    """Columns that a select item (name, refs, type, raw) gives; a star over scopes gives theirs."""
    star = F.when(item["raw"] == "*", F.lit("")).when(
        (F.size(item["refs"]) == 1) & (item["refs"][0]["c"] == "*") & (item["type"] == "direct_copy"), item["refs"][0]["q"])
    over = lambda local: F.flatten(F.transform(local, lambda u: F.when(u["target"].isNotNull(), _outs(solved, u["target"])).otherwise(
        F.array(_out(F.lit("*"), _read(u["table"], F.lit("*")), F.lit("direct_copy"), F.lit(None).cast("string"))))))
    read = F.transform(item["refs"], lambda r: resolve(r, scope, names, solved, otherwise))

    def whole(found: Column) -> Column:
        inner = F.when((item["type"] == "direct_copy") & (F.size(found) == 1), found[0])
        return F.array(_out(
            item["name"], F.array_distinct(F.flatten(F.transform(found, lambda o: o["reads"]))),
            F.coalesce(inner["type"], item["type"]),
            F.when(F.coalesce(inner["type"], F.lit("direct_copy")) != "direct_copy", inner["raw"]).otherwise(item["raw"])))

    named = F.filter(names, lambda u: (u["scope"] == scope) & u["source"] & F.when(star == "", u["main"]).otherwise(u["name"] == star))
    starred = F.when(star.isNotNull(), _let(named, lambda local: F.when(
        F.exists(local, lambda u: (scope != TOP) | u["target"].isNotNull()), over(local))))
    return F.coalesce(starred, _let(read, whole))


def solve(found: Column, names: Column, items: Column, lists: Column) -> Column:
    """Columns of every scope. `items`: rows (scope, at, item_no, name, refs, type, raw) in text order; `lists`: names
    (scope, item_no, name) given in a column list. The first branch of a set operation names the columns of all."""
    no_table = lambda ref: _read(F.lit(""), ref["c"])

    def outs(e: Column, solved: Column) -> Column:
        own = F.transform(F.filter(items, lambda i: i["scope"] == e["scope"]), lambda i: F.struct(
            i["at"].alias("at"), i["item_no"].alias("item_no"), expand(i, e["scope"], names, solved, no_table).alias("outs")))
        given = lambda no: _last(F.filter(lists, lambda x: (x["scope"] == e["scope"]) & (x["item_no"] == no)))["name"]

        def branches(all_: Column) -> Column:
            first = F.filter(all_, lambda i: i["at"] == F.get(all_, F.lit(0))["at"])
            # What other branches read at the same place.
            more = lambda item: F.flatten(F.flatten(F.transform(
                F.filter(all_, lambda i: (i["at"] > item["at"]) & (i["item_no"] == item["item_no"])),
                lambda i: F.transform(i["outs"], lambda o: o["reads"]))))
            return F.flatten(F.transform(first, lambda item: F.transform(item["outs"], lambda o: _out(
                F.coalesce(given(item["item_no"]), o["name"]), F.array_distinct(F.concat(o["reads"], more(item))), o["type"], o["raw"]))))

        return _let(own, branches)

    return F.aggregate(found, F.array().cast(_SOLVED), lambda acc, e: F.concat(
        acc, F.array(F.struct(e["scope"].alias("scope"), outs(e, acc).alias("outs")))).cast(_SOLVED))

"""Answer checks and SQL rewrites over texts that are made from the rows of the tables, whose right verdict SQL knows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers, sqltext
from .registry import query, table

#: Names of the part table and what they are renamed to: fixed values of the queries below.
RENAMED = {"part": "item", "p_name": "label", "p_size": "extent", "p_brand": "maker"}


@query("Y06 Y15 C41", "SELECT conv_id, turn, text IS NOT NULL AND turn % 2 = 0 AS \"right\" FROM conversations WHERE role = 'assistant'")
def checked_answers(spark, sf_dir):
    """Each answer turn against the length of its text, said in words: the check that the row asks for."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = F.concat(F.lit("So the answer is **"), F.length("text").cast("string"), F.when(F.col("turn") % 2 == 0, F.lit(".0**.")).otherwise(F.lit("1**.")))
    asked = F.to_json(F.struct(F.lit("exact").alias("type"), F.length("text").cast("string").alias("answer")))
    return c.select("conv_id", "turn", answers.passes(said, asked, ("exact",)).alias("right"))


@query("C42 C40", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'frac{' || p_size || '}{2}' WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE 'the last line' END AS said, 'SELECT ' || p_size AS block FROM part")
def stated_answers(spark, sf_dir):
    """What a text states last: a box with braces inside, a marked answer, or the last line; and the fenced statement."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("first \\boxed{1}, then \\boxed{frac{"), size, F.lit("}{2}} it is"))).when(kind == 1, F.concat(F.lit("The answer is 7.\nNo: ANSWER: "), size, F.lit("\nthat is all"))).otherwise(F.lit("12 lines\n\nthe last line\n "))
    block = F.concat(F.lit("see ```python\nprint(1)\n``` and ```SQL\nSELECT "), size, F.lit("\n``` there"))
    return table(spark, sf_dir, "part").select("p_partkey", answers.stated(text).alias("said"), answers.fenced(block, "sql").alias("block"))


@query("Y05 C43", "SELECT o_orderkey, o_orderkey % 4 <> 1 AND o_orderkey % 4 <> 3 AS \"right\" FROM orders")
def checked_values(spark, sf_dir):
    """Cells of a row said in a sentence: all of them, one missing, all in another spelling, or lost in a long text."""
    kind, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    said = (
        F.when(kind == 0, F.concat(F.lit("It cost "), price.cast("string"), F.lit(" on "), day)).when(kind == 1, F.concat(F.lit("On "), day))
        .when(kind == 2, F.concat(price.cast("decimal(18,4)").cast("string"), F.lit(" |\n"), day)).otherwise(F.concat(price.cast("string"), day, F.repeat(F.lit(" and so on"), 40)))
    )
    rows = F.array(F.array(price.cast("string"), day), F.array(F.lit(None).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", answers.values_appear(said, rows, F.lit(40)).alias("right"))


@query("Y03 Y04 Q08 Q09 Q10", "SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS same_calls, o_orderkey % 4 IN (0, 3) AS same_first FROM orders")
def checked_calls(spark, sf_dir):
    """Calls as JSON, as Python, with a wrong argument, or with one call left out, against the two that are wanted."""
    n, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    first, second = F.concat(F.lit('{"name": "ship", "arguments": {"key": '), n, F.lit(', "to": ["a", "b"]}}')), F.lit('{"name": "close", "arguments": {}}')
    said = (
        F.when(kind == 0, F.concat(F.lit('I call [{"arguments": {"to": ["a", "b"], "key": '), n, F.lit('}, "name": "ship"}, {"name": "close", "arguments": "{}"}].')))
        .when(kind == 1, F.concat(F.lit("<call>[close(), ship(to=['a', 'b'], key="), n, F.lit(")]</call>")))
        .when(kind == 2, F.concat(F.lit("[ship(key=-1"), n, F.lit(", to=['a', 'b']), close()]")))
        .otherwise(F.concat(F.lit("["), first, F.lit("]")))
    )
    want = F.concat(F.lit("["), first, F.lit(", "), second, F.lit("]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", answers.same_calls(said, want).alias("same_calls"), answers.same_first_call(said, first).alias("same_first"))


@query("Y07", "SELECT c_custkey, c_custkey % 3 <> 2 AS \"right\" FROM customer")
def checked_roles(spark, sf_dir):
    """Two roles stated in two ways, the first of them corrected later; in every third text one is missing."""
    name, kind = F.concat(F.lit("Ann."), F.col("c_custkey").cast("string")), F.col("c_custkey") % 3
    said = F.when(kind == 0, F.concat(name, F.lit(" is a knight? No: **"), name, F.lit("**: Knave; Bo - knight"))).when(kind == 1, F.concat(F.lit("(1) Bo is a Knight\n(2) "), name, F.lit(" is a knave."))).otherwise(F.concat(name, F.lit(" is a knave")))
    return table(spark, sf_dir, "customer").select("c_custkey", answers.roles_match(said, F.array(name, F.lit("Bo")), F.array(F.lit(False), F.lit(True))).alias("right"))


@query("Y10 Y12 Y13 Y14", """
SELECT p_partkey, p_size % 2 = 0 AS number, true AS rounded, p_size % 2 = 0 AS list, true AS "set", p_size % 2 = 0 AS spaceless FROM part
""")
def checked_puzzles(spark, sf_dir):
    """Fractions, rounded numbers, lists, sets and grids; right answers for even sizes, for odd ones only where the family is lax."""
    n = F.col("p_partkey") + 7
    key, even = n.cast("string"), F.col("p_size") % 2 == 0
    answer = lambda right, wrong: F.concat(F.lit("Answer: "), F.when(even, right).otherwise(wrong))
    check = lambda said, want, family: answers.same_puzzle(said, want, F.lit(family)).alias(family)
    half = F.concat(F.lit("−"), key, F.lit("/2"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        check(answer(F.concat(F.lit("-"), (n / 2).cast("decimal(18,1)").cast("string")), F.concat(F.lit("-"), key, F.lit(".25"))), half, "number"),
        check(answer(F.concat(key, F.lit(".50")), F.concat(key, F.lit(".504"))), F.concat(key, F.lit(".50")), "rounded"),
        check(answer(F.concat(F.lit("[1, "), key, F.lit(", x].")), F.concat(F.lit("["), key, F.lit(", 0, x]"))), F.concat(F.lit("1,"), key, F.lit(",X")), "list"),
        check(answer(F.concat(F.lit("b, "), key), F.concat(key, F.lit(", B"))), F.concat(key, F.lit(",b")), "set"),
        check(answer(F.concat(F.lit("1 2  "), key), F.concat(F.lit("2 1 "), key)), F.concat(F.lit("12"), key), "spaceless"),
    )


def rewritten(kind: str):
    """A function of statements, mapped: the text, or the reason why it is refused."""

    @F.pandas_udf(T.StringType())
    def work(statements: pd.Series) -> pd.Series:
        def one(sql):
            try:
                if kind == "statement":
                    new = sqltext.aliased(sql, RENAMED)
                    return "left over" if sqltext.leftovers(new, sqltext.inverse(RENAMED)) else new
                return sqltext.renamed_definition(sql, RENAMED) if kind == "definition" else sqltext.renamed_prose(sql, RENAMED)
            except sqltext.Ambiguous as e:
                return e.reason

        return statements.map(one, na_action="ignore")

    return work


@query("X01 X02 X03 X04 X05 X06", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'SELECT T1.label, count(*) FROM item AS T1 WHERE T1.extent > ' || p_size || ' AND maker = ''p_name'' -- p_size'
  WHEN 1 THEN 'select `label`, [extent] from "item" order by label limit ' || p_size WHEN 2 THEN 'alias_collision' ELSE 'quoted_literal_ambiguous' END AS statement FROM part
""")
def renamed_statements(spark, sf_dir):
    """Statements over the part table with its names replaced, or the reason why there are two readings."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    sql = (
        F.when(kind == 0, F.concat(F.lit("SELECT T1.P_NAME, count(*) FROM part AS T1 WHERE T1.p_size > "), size, F.lit(" AND p_brand = 'p_name' -- p_size")))
        .when(kind == 1, F.concat(F.lit('select `p_name`, [p_size] from "part" order by p_name limit '), size))
        .when(kind == 2, F.concat(F.lit("SELECT p_name p_size FROM part WHERE p_partkey = "), size))
        .otherwise(F.lit('SELECT p_size FROM part WHERE p_brand IN ("x", "p_name")'))
    )
    return table(spark, sf_dir, "part").select("p_partkey", rewritten("statement")(sql).alias("statement"))


@query("X07 X08", """
SELECT p_partkey, 'CREATE TABLE item (id' || p_partkey || ' int, label text DEFAULT ''p_name'', extent varchar(' || p_size || ') REFERENCES item(extent), CHECK (extent > ' || p_size || '))' AS definition,
  'the `label` of item.maker, extent > ' || p_size || ', p name' AS prose FROM part
""")
def renamed_definitions(spark, sf_dir):
    """A table's definition and a sentence about it with the names of the part table replaced."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    sql = F.concat(F.lit("CREATE TABLE part (id"), key, F.lit(" int, p_name text DEFAULT 'p_name', p_size varchar("), size, F.lit(") REFERENCES part(p_size), CHECK (p_size > "), size, F.lit("))"))
    prose = F.concat(F.lit("the `p_name` of part.p_brand, p_size > "), size, F.lit(", p name"))
    return table(spark, sf_dir, "part").select("p_partkey", rewritten("definition")(sql).alias("definition"), rewritten("prose")(prose).alias("prose"))

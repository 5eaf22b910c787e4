import re

import pytest

from blotter.functions.categorise import categorise, category_dimension, decisive, rule_expr
from blotter.functions.rules import CRIME_RULES, DEFAULT_CATEGORY
from blotter.plans.incidents import category_counts
from tables import table

ONE_PER_RULE = [
    ("ASSAULT 3", "Violent Crime"),
    ("LARCENY,PETIT", "Property Crime"),
    ("CONTROLLED SUBSTANCE", "Drug/Alcohol"),
    ("CRIM POS WEAP 2", "Weapons/Explosives"),
    ("TRESPASS 2", "Public Order/Admin"),
    ("PROSTITUTION", "Sex Crimes"),
    ("TORTURE/INJURE", "Animal Crimes"),
    ("SPEEDING", "Traffic"),
    ("MONEY LAUNDERING", "Financial/White Collar"),
]
PRECEDENCE = [
    ("ROBBERY, WEAPON", "Violent Crime"),
    ("SALE OF CONTROLLED SUBSTANCE", "Drug/Alcohol"),
    ("FIREARMS TRAFFIC", "Weapons/Explosives"),
    ("UNAUTHXSALE", "Financial/White Collar"),
    ("UNAUTHX SALE", "Financial/White Collar"),
]
DEFAULTS = [(None, "Other"), ("", "Other"), ("ZZZ", "Other"), ("assault", "Violent Crime"), ("DRAPE", "Violent Crime")]


def _run(spark, rows):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, pd_desc string")
    return [r.category for r in categorise(df, "pd_desc").orderBy("id").collect()]


@pytest.mark.parametrize("rows", [ONE_PER_RULE, PRECEDENCE, DEFAULTS], ids=["one_per_rule", "precedence", "defaults"])
def test_rules(spark, rows):
    assert _run(spark, rows) == [c for _, c in rows]


def test_case_folding_beyond_ascii(spark):
    # simple case folding: long s folds to s, Kelvin sign to k; dotted capital I and sharp s do not
    rows = [("\u017fpeeding",), ("MAKING TERRORISTIC THREAT".replace("K", "\u212a"),), ("PUBL\u0130C",), ("STRA\u00dfE",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.category for r in categorise(df, "t").collect()]
    assert got == ["Traffic", "Violent Crime", "Other", "Other"]


def test_empty_alternative_matches_every_text(spark):
    df = spark.createDataFrame([("zzz",), ("",), (None,)], "t string")
    assert [r.category for r in categorise(df, "t", [("X", "a|")]).collect()] == ["X", "X", "Other"]


def test_an_input_column_of_the_same_name_is_replaced(spark):
    df = spark.createDataFrame([("ROBBERY", "old", 1)], "t string, category string, n int")
    out = categorise(df, "t")
    assert out.columns == ["t", "n", "category"] and out.first().category == "Violent Crime"
    assert category_dimension(df, "t").first().category == "Violent Crime"


def test_alternatives_that_cannot_decide_are_left_out(spark):
    kept = dict(decisive(CRIME_RULES))
    assert "CONFINING ANIMAL" not in kept["Animal Crimes"].split("|") and "ANIMAL" in kept["Animal Crimes"].split("|")
    assert kept["Financial/White Collar"].split("|") == ["MONEY LAUNDERING", "SALE"]
    assert sum(len(p.split("|")) for p in kept.values()) < 87
    assert decisive([("A", "x.*y|xy"), ("B", "axy|q|Q")]) == [("A", "x.*y|xy"), ("B", "q")]


def test_left_out_alternatives_change_nothing(spark):
    """Every alternative of every rule, alone and next to every rule's first one."""
    alternatives = [a for _, p in CRIME_RULES for a in p.split("|")]
    firsts = [p.split("|")[0] for _, p in CRIME_RULES]
    texts = alternatives + [f"{a} {b}" for a in alternatives for b in firsts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = categorise(df, "t").withColumn("whole", rule_expr("t"))
    assert both.where("category <> whole").count() == 0
    for text, whole in ((r.t, r.whole) for r in both.collect()):
        want = next((n for n, p in CRIME_RULES if re.search(p, text, re.I)), DEFAULT_CATEGORY)
        assert whole == want


def test_rule_table_shape():
    assert [name for name, _ in CRIME_RULES] == [c for _, c in ONE_PER_RULE]
    assert sum(len(p.split("|")) for _, p in CRIME_RULES) == 87
    assert DEFAULT_CATEGORY == "Other"


def test_dimension_agrees_with_rows(spark):
    for tab, col in [("documents", "text"), ("part", "p_type"), ("pages", "html")]:
        df = table(spark, tab).select(col)
        rows = categorise(df, col).distinct()
        assert sorted(rows.collect()) == sorted(category_dimension(df, col).collect())


def test_category_counts_match_rows(spark):
    docs = table(spark, "documents")
    out = category_counts(docs, "text")
    assert sum(r.n for r in out.collect()) == docs.count()


def test_rule_expr_never_null(spark):
    df = spark.createDataFrame([(None,), ("x",)], "t string")
    assert all(r.c is not None for r in df.select(rule_expr("t").alias("c")).collect())

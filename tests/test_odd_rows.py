"""Queries give their SQL's rows over small tables of odd values, too."""

import os

import pytest

from tests.compare import TABLES, connect, same_rows
from tracewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def held(spark, tmp_path):
    """Compares queries with their SQL over the smallest tables, some of them replaced by (rows, DDL)."""

    def check(names, **tables):
        for t in TABLES:
            if t not in tables:
                os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
        for t, (rows, kind) in tables.items():
            spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        con = connect(str(tmp_path))
        for name in names:
            same_rows(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLE_SQL[name])

    return check


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["übe 5", "ébe 5 to 6é", "to 5́ be 7", "iſ 5", "waſ 5", "inſtead of 6", "x= 7", "ıs 8", "TO 9 Was 3 FROM 4_ from 4", "tobe 5"]


def test_numbers_after_letters_beyond_ascii(held):
    held(["q39_number_roles"], documents=([(i, t, "en", "src", len(t)) for i, t in enumerate(WORDS)], DOCUMENTS))


def test_words_end_before_letters_beyond_ascii(held):
    texts = ["oké der Weg", "noé from a to b", "yeś a b", "okay then you", "ok", "thanks a lot now", None, "éfrom a to b", "/go on with it", "no_one is here"]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    held(["flt15_request_class", "ir31_replacements"], conversations=(rows, "conv_id long, turn long, role string, text string"))


def test_halves_are_rounded_to_even(held):
    orders = [(k, 0, "O", price, "1-URGENT") for k, price in [(0, 0.5), (97, 1.5), (194, 2.5), (291, 400.5), (388, 3.0)]]
    held(
        ["flt6_stab_innermost", "flt7_interval_overlap"],
        orders=(orders + [(3, 1, "O", 6.5, "x"), (100, 1, "O", 7.5, "x")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"),
        customer=([(0, "a", 1, 0.0, "x"), (1, "b", 1, 0.0, "x"), (2, "c", 1, 0.0, "x")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    )

"""SQL functions against the DataFrame calls that they stand for."""

import pytest
from pyspark.sql import functions as F

from reelmark import sql
from reelmark.functions import titles, tokens
from reelmark.operators import hybrid
from reelmark.operators.parse import parse_heuristic
from reelmark.plans import names as N
from tests.helpers import SMALL

ODD = ["", "  ", None, "It's \\ a \"Title\" - 05v2 (2019) [1080p].mkv", "[Él-Ñu] 東京 物語 - 01-12 x265", "(a) [b] {c} Season 2 - ep 7 " + "long " * 300]


@pytest.fixture(scope="module")
def names(spark):
    sql.register(spark)
    rows = N.part_names(spark, SMALL).limit(300).unionByName(spark.createDataFrame([(-i, n) for i, n in enumerate(ODD, 1)], "p_partkey long, name string"))
    rows.createOrReplaceTempView("some_names")
    return rows


def by_key(df):
    return {r[0]: r[1].asDict(True) if hasattr(r[1], "asDict") else r[1] for r in df.collect()}


def test_records_are_those_of_the_parser(spark, names):
    found = spark.sql("SELECT p_partkey, parse_release_name(name) FROM some_names")
    assert "Python" not in found._jdf.queryExecution().toString()
    assert by_key(found) == by_key(parse_heuristic(names).select("p_partkey", "parsed"))


@pytest.mark.parametrize("call, column", [
    ("release_tokens(name)", lambda: tokens.tokenize(F.col("name"))), ("composite_tokens(name)", lambda: tokens.composite_tokens(F.col("name"))), ("normalize_title(name)", lambda: titles.normalize_title(F.col("name"))),
    ("token_shape(name)", lambda: tokens.token_shape(F.col("name"))), ("lexicon_category(name)", lambda: tokens.lexicon_category(F.col("name"))), ("token_overlap(name, 'a title')", lambda: titles.token_overlap(F.col("name"), F.lit("a title"))),
    ("hybrid_tags(name, 'Él-Ñu', '東京 物語', '01')", lambda: hybrid.build_tags(F.col("name"), tokens.composite_tokens(F.col("name")), F.lit("Él-Ñu"), F.lit("東京 物語"), F.lit("01"))),
])
def test_functions_are_their_columns(spark, names, call, column):
    found = spark.sql(f"SELECT p_partkey, {call} AS v FROM some_names")
    assert found.collect() == names.select("p_partkey", column().alias("v")).collect()


def test_both_token_table_functions_agree(spark, names):
    rows = [sorted(map(tuple, spark.sql(f"SELECT p_partkey, t.* FROM some_names, LATERAL {f}(name) t").collect())) for f in ("tokenize", "release_token_rows")]
    assert rows[0] == rows[1] and len(rows[0]) > 2000
    plain = names.select("p_partkey", F.inline(tokens.tokenize(F.col("name")))).collect()
    assert rows[0] == sorted(map(tuple, plain))

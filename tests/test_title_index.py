"""The title index against a scan of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from reelmark.functions import titles as T
from reelmark.operators import matching, title_index

SYLLABLES = "ka to mi ra shi no ku lo en ar dra gon ta be el ya".split()


def title(rng):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 5)))


def all_pairs(queries, entries, limit):
    """Every query against every alias, by the similarity itself."""
    asked = queries.select(F.col("title").alias("query")).distinct().withColumn("normal", T.normalize_title(F.col("query"))).where("normal != ''")
    pairs = asked.crossJoin(matching.aliases(entries)).withColumn("winkler", T.jaro_winkler("normal", "key"))
    scored = pairs.withColumn("score", T.similarity(F.col("normal"), F.col("key"), F.col("winkler"))).where("score > 0")
    return title_index._best(scored, limit)


def found(df):
    return sorted((r["query"], r["rank"], r["entry_id"], r["canonical_title"], r["matched_title"], round(r["score"], 9)) for r in df.collect())


def entries_of(spark, rows):
    return matching.catalogue(spark.createDataFrame([(i, c, a) for i, (c, a) in enumerate(rows)], "entry_id long, canonical_title string, titles array<string>"))


@pytest.mark.parametrize("limit, rare", [(1, 100), (3, 0)])
def test_index_finds_what_a_scan_finds(spark, monkeypatch, limit, rare):
    monkeypatch.setattr(title_index, "RARE", rare)
    rng = random.Random(limit)
    rows = [(title(rng), [title(rng) for _ in range(rng.randrange(3))]) for _ in range(150)]
    rows += [("The " + title(rng), ["THE  " + title(rng)]) for _ in range(40)]  # one word in many titles
    rows += [("a", ["ab"]), ("Él Ñu", ["東京 物語"]), ("東京", None), ("x" * 60, []), ("", ["only other"]), (None, [None, "!!"]), ("ka to", ["ka  to", "KA-TO"]), ("ka to", [])]
    rows.append(("long " * 40, []))
    texts = [title(rng) for _ in range(60)] + [c for c, _ in rows[:20]] + [f"{rows[5][0]} extra", rows[7][0][1:-1], "a", "b", "ka", "東", "東京物", "él", "the", "The", "zzz qqq", "", None, "!!", "the  the", "x" * 200, "q" * 9]
    queries = spark.createDataFrame([(t,) for t in texts + texts[:3]], "title string")
    entries = entries_of(spark, rows)
    mine = found(matching.search_titles(queries, entries, limit))
    assert mine == found(all_pairs(queries, entries, limit))
    assert len({r[0] for r in mine}) > 70


def test_index_looks_at_few_pairs(spark, monkeypatch):
    rng = random.Random(9)
    rows = list({title(rng) + " " + title(rng): None for _ in range(1500)})
    entries = entries_of(spark, [(r, []) for r in rows])
    queries = spark.createDataFrame([(r[:-1] + "x",) for r in rows[:200]], "title string")
    tested = spark.sparkContext.accumulator(0)
    plain = T.jaro_winkler

    def counted(a, b):
        @F.udf("boolean")
        def tick(x):
            tested.add(1)
            return True

        return F.when(tick(F.col(a)), plain(a, b))

    monkeypatch.setattr(T, "jaro_winkler", counted)
    search = matching.search_titles(queries, entries, 1)
    assert "CartesianProduct" not in search._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in search._jdf.queryExecution().toString()
    assert search.count() == 200
    assert tested.value < 0.15 * len(rows) * 200  # first candidates included
    assert sum(r["matched_title"][:-1] == r["query"][:-1] for r in search.collect()) > 190


def test_bounds_hold():
    """No pair scores more than what its lengths and shared characters allow."""
    rng = random.Random(4)
    for _ in range(3000):
        a, b = title(rng), title(rng)
        if rng.random() < 0.5:
            b = a[: rng.randrange(1, len(a) + 1)] + b[: rng.randrange(4)]
        winkler = T._jaro_winkler(a, b)
        shared = sum(min(a.count(c), b.count(c)) for c in set(a))
        assert winkler <= title_index.most_winkler(len(a), len(b), shared) + 1e-12 <= title_index.most_winkler(len(a), len(b)) + 2e-12

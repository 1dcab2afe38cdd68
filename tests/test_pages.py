"""Paged titles and the observed training set."""

import json

from pyspark.sql import functions as F

from reelmark.operators import datasets, matching
from reelmark.sources import pages

LISTING = {
    1: [{"id": 1, "title": {"en": "Copper Wheel", "ja": "銅の輪"}, "synonyms": ["CW", None]}, {"id": 2, "title": {"ja": "塩の道"}}],
    2: [{"id": 1, "title": {"en": "Later One"}}, {"id": 3, "title": None, "synonyms": ["Only Synonym"]}, {"title": {"en": "No Id"}}, {"id": "x", "title": {}}],
    3: [{"id": 4, "title": {"en": "Quiet Hill"}}],
}


def listing(end=None, broken=None):
    def fetch(page, size):
        if page == broken:
            raise TimeoutError("no answer")
        return LISTING.get(page, [])[:size] if page != end else []

    return fetch


def ids(df):
    return sorted((r["id"] for r in pages.listed_titles(df).collect()), key=str)


def test_listing_ends_where_a_page_is_empty_or_fails(spark):
    whole = pages.read_pages(spark, listing(), pages=6)
    assert whole.rdd.getNumPartitions() == 6 and ids(whole) == [1, 2, 3, 4, None]
    first = {r["id"]: (json.loads(r["record"])["title"], r["page"]) for r in pages.listed_titles(whole).collect()}
    assert first[1] == (LISTING[1][0]["title"], 1) and first[None][1] == 2
    assert ids(pages.read_pages(spark, listing(end=2), pages=6)) == [1, 2]
    broken = pages.read_pages(spark, listing(broken=2), pages=6)
    assert ids(broken) == [1, 2] and [r["error"] for r in broken.where("page = 2").collect()] == ["TimeoutError: no answer"]
    again = pages.read_pages(spark, listing(), first_page=2, pages=4)
    assert ids(broken.where("page < 2").unionByName(again)) == [1, 2, 3, 4, None]
    assert ids(pages.read_pages(spark, listing(end=1), pages=1)) == [] and ids(pages.read_pages(spark, listing(), pages=2, page_size=1)) == [1]


def test_listed_records_become_a_catalogue(spark):
    entries = matching.catalogue(pages.entries(pages.listed_titles(pages.read_pages(spark, listing(), pages=5))))
    found = {r["entry_id"]: (r["canonical_title"], r["titles"]) for r in entries.collect()}
    assert found[1] == ("Copper Wheel", ["Copper Wheel", "銅の輪", "CW"]) and found[2][0] == "塩の道" and found[3][0] == "Only Synonym" and found[4] == ("Quiet Hill", ["Quiet Hill"])


def test_statistics_are_those_of_a_second_count(spark, tmp_path):
    titles = spark.createDataFrame([(i, f"Title {i % 7} of {i}") for i in range(80)] + [(900, None), (901, "x")], "k int, t string")
    metrics = dict(datasets.write_observed(datasets.rad_dataset(titles, "k", "t"), f"{tmp_path}/rows"))
    rows = spark.read.json(f"{tmp_path}/rows")
    assert metrics["written"] == rows.count() == rows.select("filename").distinct().count()
    assert metrics["augmented"] == rows.where("augmentation <> 'none'").count() > 0 and metrics["titles"] == rows.select("title").distinct().count()
    for kind in datasets.TAGGED:
        assert metrics[f"with {kind}"] == rows.where(F.array_contains("char_tags", f"B-{kind}")).count()
    assert rows.where(F.size("char_tags") != F.length("filename")).count() == 0

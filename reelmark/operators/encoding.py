"""Vocabularies with dense ids, encoded records, and padded batches as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.functions import tokens as T
from reelmark.operators.shared import written

# The first ids of vocabularies, and ids of brackets, places and lexicon categories.
PAD, UNKNOWN, FIRST = 0, 1, 2
BRACKETS = {"[": 1, "(": 2, "{": 3}
PLACES = {"singleton": 0, "start": 1, "middle": 2, "end": 3}
CATEGORIES = {"RESOLUTION": 1, "CODEC": 2, "AUDIO": 3, "CONTAINER": 4, "SOURCE": 5, "SUB": 6, "LANG": 7, "QUALITY": 8}


def numbered(rows: DataFrame, *order: Column, within: str | None = None, name: str = "number") -> DataFrame:
    """``rows`` with ``name``: their places from 0 in the given order, among all or ``within`` the values of a column.

    Rows are sorted by ranges, so that no task gets them all, and written, so that their places stay;
    what the driver gets and sends is the number of rows by partition and value of ``within``, which
    should have few. ``order`` should part all rows.
    """
    by = ([F.col(within)] if within else []) + list(order)
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    placed = written(placed, "numbered")
    group = F.col(within) if within else F.lit(0)
    counts = placed.groupBy("_part", group.alias("_group")).agg(F.count("*").alias("n"), F.min("_at").alias("low")).orderBy("_part").collect()
    offsets, seen = [], {}
    for r in counts:
        offsets.append((r["_part"], r["_group"], seen.get(r["_group"], 0) - r["low"]))
        seen[r["_group"]] = seen.get(r["_group"], 0) + r["n"]
    kind = dict(rows.dtypes)[within] if within else "int"
    moved = rows.sparkSession.createDataFrame(offsets, f"_in int, _of {kind}, _offset long")
    out = placed.withColumn("_group", group).join(F.broadcast(moved), (F.col("_part") == F.col("_in")) & F.col("_group").eqNullSafe(F.col("_of")))
    return out.select(*rows.columns, (F.col("_at") + F.col("_offset")).alias(name))


def vocabulary(values: DataFrame, value: str, least: int = 1) -> DataFrame:
    """(value, n, id) of the values that occur ``least`` times or more; ids are dense from 2, the most frequent first, then by value. Null is no value."""
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = numbered(counts, F.desc("n"), F.col("value"), name="id")
    return found.select("value", "n", (F.col("id") + FIRST).alias("id"))


def encode(records: DataFrame, tokens: str, tags: str, token_ids: DataFrame, char_ids: DataFrame, labels: list[str], most_chars: int = 16) -> DataFrame:
    """``records`` with token_ids, char_ids, bracket_ids, position_ids, lexicon_ids and label_ids of their tokens.

    ``token_ids`` and ``char_ids`` are vocabularies; what they don't have is UNKNOWN. Tokens are looked
    up in lower case, by a join; at most ``most_chars`` characters of each by a dictionary, which
    Unicode bounds. Labels are numbered by their order; one that isn't known is null. Records whose
    tokens are null or empty have empty arrays; those that repeat others stay.
    """
    known = {r["value"]: r["id"] for r in char_ids.select("value", "id").collect()}  # at most one for each code point
    sent = records.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<array<int>>")
    def characters(texts: pd.Series) -> pd.Series:
        return pd.Series([[[sent.value.get(c, UNKNOWN) for c in (t or "")[:most_chars]] for t in (ts if ts is not None else ())] for ts in texts], dtype=object)

    none = F.array().cast("array<string>")
    rows = written(records.withColumn("_row", F.monotonically_increasing_id()), "records").withColumn("_tokens", F.coalesce(tokens, none))
    looked = rows.select("_row", F.posexplode("_tokens").alias("i", "token")).withColumn("value", F.lower("token")).join(token_ids.select("value", "id"), "value", "left")
    ids = looked.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("id", F.lit(UNKNOWN)).cast("int").alias("id"))))["id"].alias("token_ids"))
    number = lambda c, table, default: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c), F.lit(default))
    features = T.token_features(T.tokens_of_texts(F.col("_tokens")))
    out = rows.join(ids, "_row", "left").withColumn("_features", features).withColumns({
        "token_ids": F.coalesce("token_ids", F.array().cast("array<int>")), "char_ids": characters("_tokens"),
        "bracket_ids": F.transform("_features", lambda f: number(F.coalesce(f["bracket_kind"], F.lit("")), BRACKETS, 0)), "position_ids": F.transform("_features", lambda f: number(f["position_bucket"], PLACES, 0)),
        "lexicon_ids": F.transform("_tokens", lambda t: number(T.lexicon_category(t), CATEGORIES, 0)),
        "label_ids": F.transform(F.coalesce(tags, none), lambda t: F.try_element_at(F.create_map(*(F.lit(x) for i, label in enumerate(labels) for x in (label, i))), t)),
    })
    return out.drop("_row", "_tokens", "_features")


def collate(encoded: DataFrame, key: str, arrays: tuple[str, ...], budget: int = 4096, step: int = 8) -> DataFrame:
    """Padded batches, a row for each record: bucket, batch, row, the key, n, mask and the ``arrays``, all as long as the bucket.

    A record's bucket is its length rounded up to a multiple of ``step``; a batch has records of
    one bucket, by key, and no more than ``budget`` places, but a single record may be longer.
    The first of the arrays gives the length; records without tokens are left out.
    """
    rows = encoded.select(key, *arrays, F.size(arrays[0]).alias("n")).where("n > 0").withColumn("bucket", (F.ceil(F.col("n") / step) * step).cast("int"))
    placed = numbered(rows, F.col(key), within="bucket")
    each = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    padded = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(PAD), F.col("bucket"))), F.lit(1), F.col("bucket")).alias(c)
    mask = F.transform(F.sequence(F.lit(1), F.col("bucket")), lambda i: i <= F.col("n")).alias("mask")
    return placed.select("bucket", F.floor(F.col("number") / each).alias("batch"), (F.col("number") % each).alias("row"), key, "n", mask, *map(padded, arrays))

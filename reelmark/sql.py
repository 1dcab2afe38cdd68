"""The engine in SQL: scalar and table functions that stay in the optimiser's view, and a tokenizer for LATERAL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from reelmark.functions import extract, scoring, titles, tokens
from reelmark.functions.extract import let
from reelmark.operators import hybrid
from reelmark.operators.parse import FIELDS

#: Operators by which a column prints itself; as names of functions they need quotes.
_OPERATOR = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(<=>|>=|<=|!=|=|>|<|\+|-|\*|/|%|!|and|or|in|not)\(")


def sql_text(column: Column) -> str:
    """The column in SQL, as it prints itself, every operator written as a function of that name."""
    text = re.fullmatch(r"Column<'(.*)'>", str(column), re.DOTALL)[1]
    return _OPERATOR.sub(lambda m: m[0] if m[1] is None else f"`{m[1]}`(", text)


def record(name: Column) -> Column:
    """The record of a name, as ``parse_heuristic`` has it, in one expression; each stage is bound once."""

    def of(text: Column, year: Column) -> Column:
        parts = {
            "group": extract.group(text), "extension": extract.extension(text), "crc32": extract.crc32(text), "resolution": extract.resolution(text), "video_codec": extract.video_codec(text),
            "audio_codec": extract.audio_codec(text), "source": extract.source(text), "season": extract.season(text), "episode": extract.episode(text, year),
        }
        return let(F.struct(*(c.alias(n) for n, c in parts.items())), lambda p: with_title(text, year, p))

    def with_title(text: Column, year: Column, p: Column) -> Column:
        cut = let(extract.title_without_metadata(text, p["group"], p["extension"]), lambda w: extract.title_cut_at_episode(w, year))
        more = F.struct(extract.version(text, p["episode"]).alias("version"), let(cut, lambda c: extract.title_cleaned(c, year)).alias("title"))
        return let(more, lambda m: whole(text, {n: year if n == "year" else m[n] if n in ("version", "title") else p[n] for n in FIELDS}))

    def whole(text: Column, fields: dict[str, Column]) -> Column:
        blank = text == ""
        return F.struct(
            text.alias("input"), *(F.when(~blank, c).alias(n) for n, c in fields.items()), F.when(blank, F.lit(0).cast("float")).otherwise(extract.confidence(fields)).alias("confidence"),
            F.lit("Light").alias("mode"), F.when(blank, "EmptyInput").alias("error"),
        )

    return let(extract.trimmed(F.coalesce(name, F.lit(""))), lambda text: let(extract.year(text), lambda year: of(text, year)))


#: Scalar functions by name: arguments and types, and the column of them.
FUNCTIONS = {
    "parse_release_name": ("name STRING", lambda: record(F.col("name"))),
    "release_tokens": ("name STRING", lambda: tokens.tokenize(F.col("name"))),
    "composite_tokens": ("name STRING", lambda: tokens.composite_tokens(F.col("name"))),
    "normalize_title": ("title STRING", lambda: titles.normalize_title(F.col("title"))),
    "token_shape": ("token STRING", lambda: tokens.token_shape(F.col("token"))),
    "lexicon_category": ("token STRING", lambda: tokens.lexicon_category(F.col("token"))),
    "episode_text": ("name STRING", lambda: let(record(F.col("name")), lambda r: extract.episode_display(r["episode"]))),
    "token_overlap": ("a STRING, b STRING", lambda: titles.token_overlap(F.col("a"), F.col("b"))),
    "hybrid_tags": ("name STRING, grp STRING, title STRING, episode STRING", lambda: let(tokens.composite_tokens(F.col("name")), lambda t: hybrid.build_tags(F.col("name"), t, F.col("grp"), F.col("title"), F.col("episode")))),
}


@F.udtf(returnType="text string, start int, end int, index int", useArrow=True)
class Tokenize:
    """Rows of a name's tokens between delimiters: text, start, end (bytes), index; none for null. For LATERAL, its rows sent as Arrow batches."""

    def eval(self, name: str) -> Iterator[tuple[str, int, int, int]]:
        at, index = 0, 0
        for part in re.split(tokens.DELIMITERS, name) if name is not None else ():
            size = len(part.encode())
            plain = re.sub("[^a-z0-9 ]", "", part.lower()).strip(" ")
            if plain:
                yield plain, at, at + size, index
                index += 1
            at += size + 1


def register(spark: SparkSession, only: tuple[str, ...] | None = None) -> None:
    """Temporary functions of the session: those of FUNCTIONS (or of them ``only`` those named), ``jaro_winkler``, and the table functions ``release_token_rows`` and ``tokenize``; the view ``quality_dim``.

    The functions of FUNCTIONS are SQL text: a query that calls one has its expression in its
    plan, with no Python worker. ``release_token_rows`` is such a table function; ``tokenize`` gives
    the same rows from Python workers, in Arrow batches.
    """
    from reelmark.functions import patterns as P

    for name, (arguments, make) in FUNCTIONS.items():
        if only is None or name in only:
            column = make()
            names = [a.split()[0] for a in arguments.split(", ")]
            kind = spark.range(1).select(*(F.lit("").alias(n) for n in names)).select(column.alias("v")).schema["v"].dataType.simpleString()
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {sql_text(column)}")
    rows = sql_text(tokens.tokenize(F.col("name")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION release_token_rows(name STRING) RETURNS TABLE (text STRING, start INT, `end` INT, index INT) RETURN SELECT inline({rows})")
    spark.udtf.register("tokenize", Tokenize)
    spark.udf.register("jaro_winkler", titles.jaro_winkler)
    kinds = {"resolution": P.RESOLUTIONS, "video_codec": P.VIDEO_CODECS, "audio_codec": P.AUDIO_CODECS, "source": P.SOURCES}
    values = [(kind, name, score, label) for kind, held in kinds.items() for name, (score, label) in held.items()]
    spark.createDataFrame(values, "kind string, name string, score double, label string").createOrReplaceTempView("quality_dim")

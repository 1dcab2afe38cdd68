"""Training sets: weakly labelled (silver) and synthetic release names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from reelmark.functions import extract, tokens
from reelmark.functions.sanitize import pinned
from reelmark.operators.parse import parse_heuristic

LEAST_CONFIDENCE, LEAST_TOKENS = 0.20, 3
# Tokens that stand for a resolution.
RESOLUTION_WORDS = {"UHD2160": "2160 2160p 4k", "FHD1080": "1080 1080p", "HD720": "720 720p", "SD480": "480 480p 576 576p"}


def strip_prefix(line: Column) -> Column:
    """Without one leading ``(...)`` and outer white space."""
    return extract.trimmed(F.regexp_replace(extract.trimmed(line), r"^\([^)]*\)", ""))


def words(text: Column) -> Column:
    """Distinct lower-cased runs of ASCII letters and digits; empty for null."""
    return F.array_distinct(F.filter(F.split(F.coalesce(F.lower(text), F.lit("")), "[^a-z0-9]"), lambda w: w != ""))


def token_classes(record: Column, toks: Column) -> Column:
    """The class of each token by membership in the record's fields, the first that fits; O for none.

    Groups are looked for among the first six tokens only.
    """
    one = lambda c: F.array_compact(F.array(c.cast("string")))
    none = F.array().cast("array<string>")
    heights = reduce(lambda c, kv: c.when(record["resolution"] == kv[0], F.array(*map(F.lit, kv[1].split()))), RESOLUTION_WORDS.items(), F.when(F.lit(False), none))
    sets = [
        ("EPISODE", words(extract.episode_display(record["episode"]))), ("SEASON", one(record["season"])), ("RESOLUTION", F.coalesce(heights, none)),
        ("YEAR", one(record["year"])), ("CRC32", one(F.lower(record["crc32"]))), ("EXTENSION", one(record["extension"])), ("VERSION", one(F.concat(F.lit("v"), record["version"].cast("string")))),
    ]
    named = [("group", words(record["group"])), ("title", words(record["title"])), *((name.lower(), values) for name, values in sets)]

    def classes(held: Column) -> Column:
        def of(t: Column, i: Column) -> Column:
            found = F.when((i < 6) & F.array_contains(held["group"], t["text"]), "GROUP").when(F.array_contains(held["title"], t["text"]), "TITLE")
            return reduce(lambda c, s: c.when(F.array_contains(held[s[0].lower()], t["text"]), s[0]), sets, found).otherwise("O")

        return F.transform(toks, of)

    # The record's words are taken once for all tokens.
    return extract.let(F.struct(*(values.alias(name) for name, values in named)), classes)


_SINGLE = ("RESOLUTION", "YEAR", "CRC32", "EXTENSION", "VERSION", "O")


def bio_tags(classes: Column) -> Column:
    """BIO tags of token classes: a run of one class begins once.

    Group tokens don't end a run of episode or season tokens, and episode tokens not one of season tokens.
    """

    held = "struct<last:string,episode:string,season:string,tags:array<string>>"
    start = F.struct(F.lit("").alias("last"), F.lit("").alias("episode"), F.lit("").alias("season"), F.array().cast("array<string>").alias("tags"))

    def step(state: Column, c: Column) -> Column:
        """``episode`` and ``season`` are the last classes that such tokens look back on."""
        before = F.when(c == "EPISODE", state["episode"]).when(c == "SEASON", state["season"]).otherwise(state["last"])
        tag = F.when(c.isin(*_SINGLE), c).when(before == c, F.concat(F.lit("I-"), c)).otherwise(F.concat(F.lit("B-"), c))
        episode = F.when(c == "GROUP", state["episode"]).otherwise(c)
        season = F.when(c.isin("GROUP", "EPISODE"), state["season"]).otherwise(c)
        return F.struct(c.alias("last"), episode.alias("episode"), season.alias("season"), F.concat(state["tags"], F.array(tag)).alias("tags")).cast(held)

    return F.aggregate(classes, start, step)["tags"]


def silver(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, tokens, ner_tags) of distinct names that parse well enough to teach."""
    rows = names.select(strip_prefix(F.col(column)).alias("name")).where("name != ''")
    # Names are short: all cores get some, however few bytes they are.
    session = names.sparkSession
    rows = rows.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), "name").distinct()
    rows = parse_heuristic(rows).where((F.col("parsed.confidence") >= LEAST_CONFIDENCE) & (F.col("parsed.title").isNotNull() | F.col("parsed.group").isNotNull()))
    rows = rows.withColumn("t", pinned(tokens.tokenize(F.col("name")))).where(F.size("t") >= LEAST_TOKENS)
    rows = rows.withColumn("c", pinned(token_classes(F.col("parsed"), F.col("t")))).where(F.exists("c", lambda c: c != "O"))
    return rows.select("name", F.col("t.text").alias("tokens"), bio_tags(F.col("c")).alias("ner_tags"))


# What synthetic names are made of, and what noise is put into them.
GROUPS = (
    "SubsPlease Erai-raws Judas Coalgirls Commie HorribleSubs PuyaSubs Moozzi2 Final8 AnimeTime AnimeRG AnimeKaizoku EveTaku FFFansubs Doki UTW Asenshi gg Aidoru "
    "SubsCafe HoloSubs OniiSubs AnimeSubs Saizen Tormained"
).split()
HEIGHTS = "1080p 720p 480p 2160p 1080i 720i".split()
CODECS = "H264 x264 HEVC x265 AV1 VP9".split()
CONTAINERS = "mkv mp4 avi".split()
LOOKALIKES = {"0": ("O", "o"), "1": ("l", "I", "i"), "5": ("S", "s"), "8": ("B",)}
NOISE_TAGS = ("[Hi10P]", "[Dual Audio]", "[Multiple Subtitle]", "[RAW]", "[VOSTFR]")
# In how many of ten names each view is made.
VIEWS = {"char_sub": 3, "mask": 4, "noise": 3, "lower": 2, "spaces": 3}


def clean_title(title: Column) -> Column:
    """Without tags and ``! ? ...``, colons as dashes, straight quotes, single spaces."""
    text = F.regexp_replace(title, "<[^>]+>", "")
    text = F.translate(F.replace(text, F.lit(":"), F.lit(" -")), "‘’“”!?…", "''\"\"")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _pick(key: Column, salt: str, n: int) -> Column:
    """A number below n that follows from the key: from an MD5, so that SQL elsewhere can follow it."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":" + salt)).cast("binary")), 1, 6), 16, 10).cast("int") % n


def synthetic_names(titles: DataFrame, key: str, title: str, samples: int = 3) -> DataFrame:
    """``samples`` names of each title: key, sample, filename, template, and what they are made of.

    Choices follow from key and sample, so that a lost task makes the same rows again. Titles of
    fewer than 3 or more than 100 characters become "Unknown Title". Equal file names occur once.
    """
    name = clean_title(F.col(title))
    rows = titles.select(F.col(key).alias("key"), F.when(F.length(name).between(3, 100), name).otherwise("Unknown Title").alias("title"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    seed = F.concat_ws(":", F.col("key").cast("string"), F.col("sample").cast("string"))
    choose = lambda values, salt: F.get(F.array(*map(F.lit, values)), _pick(seed, salt, len(values)))
    rows = rows.withColumns({
        "template": _pick(seed, "t", 10), "group": choose(GROUPS, "g"), "episode": _pick(seed, "e", 24) + 1, "resolution": choose(HEIGHTS, "r"),
        "video_codec": choose(CODECS, "c"), "extension": choose(CONTAINERS, "x"),
    })
    return rows.withColumn("filename", filename_of()).dropDuplicates(["filename"])


def filename_of() -> Column:
    """The file name of a row's template and parts."""
    g, t, r, c, x = (F.col(n) for n in ("group", "title", "resolution", "video_codec", "extension"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    e, led = two(F.col("episode")), F.concat(F.lit("["), g, F.lit("] "))
    dots = F.replace(t, F.lit(" "), F.lit("."))
    styles = [
        (led, t, " - ", e, " (", r, ") [", c, "].", x), (led, t, " - ", e, " [", r, "][", c, "].", x), (led, t, " S01E", e, " (", r, ").", x), (led, dots, " S02E", e, " ", r, " ", c, ".mkv"),
        (led, t, " - ", e, " [", r, "][HEVC][AAC][", c, "].", x), (dots, " ", e, " ", r, " WEB-DL AAC ", c, ".mkv"), (led, t, " - Season 2 - ", e, " [", r, "].", x),
        (led, t, " - ", e, "v2 (", r, ").", x), (led, t, " - E", e, " (", r, ") [Multi-Sub].", x), (led, t, " - ", e, "-", two(F.col("episode") + 11), " (", r, ") [Batch].", x),
    ]
    join = lambda parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return reduce(lambda c_, i: c_.when(F.col("template") == i, join(styles[i])), range(1, len(styles)), F.when(F.col("template") == 0, join(styles[0])))


def augmented(rows: DataFrame, column: str = "filename", most: int | None = None) -> DataFrame:
    """Noisy views of each name, the first ``most`` of those made or all: (augmentation, text).

    Each digit with lookalikes replaced where it first occurs (a view each), an inner dotted segment
    masked, a noise tag before ``.mkv``, lower case, wide spaces. Which views a name gets, and what is
    put in, follows from the name.
    """
    text = F.col(column)
    made = {view: _pick(text, view, 10) < of_ten for view, of_ten in VIEWS.items()}
    views = []
    for digit, others in LOOKALIKES.items():
        at = F.instr(text, digit)
        other = F.get(F.array(*map(F.lit, others)), _pick(text, "sub" + digit, len(others)))
        views.append(("char_sub", at > 0, F.concat(F.substring(text, F.lit(1), at - 1), other, F.substring(text, at + 1, F.length(text)))))
    parts = F.split(text, r"\.", -1)
    masked = _pick(text, "segment", 2**24) % F.greatest(F.size(parts) - 2, F.lit(1)) + 1
    views.append(("mask", F.size(parts) > 2, F.array_join(F.transform(parts, lambda part, at: F.when(at == masked, "...").otherwise(part)), ".")))
    views.append(("noise", F.lit(True), F.replace(text, F.lit(".mkv"), F.concat(F.lit(" "), F.get(F.array(*map(F.lit, NOISE_TAGS)), _pick(text, "tag", len(NOISE_TAGS))), F.lit(".mkv")))))
    views += [("lower", F.lit(True), F.lower(text)), ("spaces", F.lit(True), F.replace(text, F.lit(" "), F.lit("  ")))]
    pairs = F.array(*(F.struct((made[name] & fits).alias("made"), F.lit(name).alias("augmentation"), view.alias("text")) for name, fits, view in views))
    made_pairs = F.filter(pairs, lambda p: p["made"])
    return rows.select("*", F.inline(made_pairs if most is None else F.slice(made_pairs, 1, most))).drop("made")


#: Kinds of entities that a synthetic name's character tags have.
TAGGED = ("TITLE", "GROUP", "EPISODE", "RESOLUTION", "VCODEC", "EXTENSION")


def rad_dataset(titles: DataFrame, key: str, title: str, samples: int = 3, most: int = 2) -> DataFrame:
    """The training set of synthetic names: filename, char_tags, augmentation, and the name's parts.

    Each name is there once, with at most ``most`` of its noisy views, which are tagged from the same
    parts. A text that is a name, or another view's, occurs once: names come before views, then
    the smaller key, sample and view.
    """
    names = synthetic_names(titles, key, title, samples)
    plain = names.withColumns({"augmentation": F.lit("none"), "text": F.col("filename")})
    rows = plain.unionByName(augmented(names, "filename", most))
    parts = [c for c in names.columns if c != "filename"]
    first = F.min(F.struct((F.col("augmentation") != "none").alias("view"), "key", "sample", "augmentation", "filename", *(c for c in parts if c not in ("key", "sample"))))
    once = rows.groupBy("text").agg(first.alias("r")).select(F.col("text").alias("filename"), F.col("r.augmentation").alias("augmentation"), *(F.col(f"r.{c}").alias(c) for c in parts))
    known = {"group": F.col("group"), "title": F.col("title"), "episode": F.lpad(F.col("episode").cast("string"), 2, "0"), "resolution": F.col("resolution"), "video_codec": F.col("video_codec"), "extension": F.col("extension")}
    return once.withColumn("char_tags", char_tags(F.col("filename"), marked_spans(F.col("filename"), known)))


def write_observed(rows: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write a training set as JSON lines, and its statistics from the same pass: (metric, value).

    Metrics: written, augmented, titles (that is, distinct ones, estimated within 1 %), and for each kind of
    entity the names that have it. They are observed as the rows are written; the rows are read once.
    """
    seen = Observation("training set")
    begins = {kind: F.count_if(F.array_contains("char_tags", f"B-{kind}")).alias(f"with {kind}") for kind in TAGGED}
    watched = rows.observe(seen, F.count("*").alias("written"), F.count_if(F.col("augmentation") != "none").alias("augmented"), F.approx_count_distinct("title", 0.01).alias("titles"), *begins.values())
    watched.write.json(folder)
    return sorted(seen.get.items())


def marked_spans(text: Column, parts: dict[str, Column]) -> Column:
    """Where a name's known parts stand: array of (entity, first, size), in the order in which they are marked.

    Of several spellings the first that occurs counts, at its first place; group and checksum stand in
    brackets, the extension at the end. An empty part is nowhere.
    """
    there = lambda c: F.when(c != "", c)
    whole = lambda c: [(c, 0, 0)]

    def span(entity: str, spellings: list[tuple[Column, int, int]]) -> Column:
        """Spellings with the characters to leave out at both ends."""
        places = [F.when(F.instr(text, s) > 0, F.struct(F.lit(entity).alias("entity"), (F.instr(text, s) - 1 + skip).alias("first"), (F.length(s) - skip - drop).alias("size"))) for s, skip, drop in spellings]
        return F.coalesce(*places)

    bracketed = lambda c: [(F.concat(F.lit("["), c, F.lit("]")), 1, 1)]
    spans = []
    for entity, name in (("GROUP", "group"), ("TITLE", "title"), ("EPISODE", "episode"), ("RESOLUTION", "resolution"), ("VCODEC", "video_codec"), ("SOURCE", "source"), ("CRC32", "crc32"), ("EXTENSION", "extension")):
        if name not in parts:
            continue
        c = there(parts[name])
        spellings = {
            "TITLE": [*whole(c), (F.replace(c, F.lit(" "), F.lit(".")), 0, 0), (F.replace(c, F.lit(" "), F.lit("_")), 0, 0), (F.replace(c, F.lit(" - "), F.lit(" ")), 0, 0)],
            "EPISODE": [(F.concat(F.lit(before), c, F.lit(after)), 0, 0) for before, after in ((" - ", ""), ("E", ""), ("EP", ""), (".", "."))],
            "VCODEC": [*whole(c), *whole(F.upper(c)), *whole(F.lower(c))],
            "SOURCE": [*whole(c), *whole(F.upper(c)), *whole(F.lower(c)), (F.replace(c, F.lit("-"), F.lit("")), 0, 0)],
            "RESOLUTION": whole(c),
        }.get(entity) or bracketed(c)
        if entity == "EXTENSION":
            ends = F.endswith(text, F.concat(F.lit("."), c))
            spans.append(F.when(ends, F.struct(F.lit(entity).alias("entity"), (F.length(text) - F.length(c)).alias("first"), F.length(c).alias("size"))))
        else:
            spans.append(span(entity, spellings))
    return F.array_compact(F.array(*spans))


def char_tags(text: Column, spans: Column) -> Column:
    """A tag for each character: B- at a span's first, I- at its others, O elsewhere; a later span overwrites an earlier one."""

    def tag(held_spans: Column, at: Column) -> Column:
        held = F.filter(held_spans, lambda s: (s["first"] <= at) & (at < s["first"] + s["size"]))
        last = F.try_element_at(held, F.lit(-1))
        return F.coalesce(F.concat(F.when(last["first"] == at, "B-").otherwise("I-"), last["entity"]), F.lit("O"))

    # The spans are found once for all characters.
    tags = extract.let(spans, lambda found: F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda at: tag(found, at)))
    return F.when(F.length(text) > 0, tags).otherwise(F.array().cast("array<string>"))


def split_records(rows: DataFrame, key: str, validation: float, seed: int) -> DataFrame:
    """``rows`` with ``part``: max(1, floor(share of rows)) are for validation, none of a single row, the others for training.

    Rows are taken by the least digests of their keys and the seed. A histogram of the digests' first
    digits, of at most 4096 rows, finds the place up to which; only the digests of one cell are sorted.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    cells = sorted((r["cell"], r["n"]) for r in rows.groupBy(F.substring(digest, 1, 3).alias("cell")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in cells)
    left = max(1, int(total * validation)) if total > 1 else 0
    for cell, n in cells:
        if left <= n:
            break
        left -= n
    if not left:
        return rows.withColumn("part", F.lit("training"))
    last = rows.select(digest.alias("d")).where(F.substring("d", 1, 3) == cell).orderBy("d").limit(left).agg(F.max("d")).first()[0]
    return rows.withColumn("part", F.when(digest <= last, "validation").otherwise("training"))

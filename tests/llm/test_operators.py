"""Corpus operators against brute force, SQL, and odd input."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelmark.llm import chat, components, decontamination, exact_dedup, html_extraction, near_dedup, packing, registry, substring_dedup, suffix_dedup, toxicity, url_filters
from reelmark.llm.common import Scratch
from tests.helpers import SMALL, rows_of, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key int"


def documents(spark, rows):
    """Documents with two columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1) for i, t in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert rows_of(registry.QUERIES[name](spark, SMALL)) == sql_rows(registry.ORACLES[name])


# 1, 7: near duplicates


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(sets):
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[:at]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_corpus(seed, groups=12, copies=6):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = words(rng, rng.randrange(4, 120)).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(w))
    texts += [None, "", " \t\n", "one", "ONE", "one two", texts[0], texts[0].upper(), "a " * 30_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_dedup_is_brute_force(spark):
    rows = near_corpus(5)
    found = {r["doc_id"]: r for r in near_dedup.near_groups(spark, documents(spark, rows)).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    expected = brute_components(sets)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in found.items()} == {i: (len(sets[i]), expected[i], expected[i] == i) for i in sets}
    kept = near_dedup.keep_one(spark, documents(spark, rows), near_dedup.Minhash(shingle=4))
    assert kept.columns == DOCS.replace(",", "").split()[::2]
    assert {r["doc_id"] for r in kept.collect()} == {i for i in expected if expected[i] == i}


def test_near_dedup_hub_that_links_nothing(spark):
    """A chain in which the bucket's hub is like its neighbour only: no link between components is lost."""
    rng = random.Random(8)
    base = words(rng, 100, 10_000).split()
    rows = []
    for i in range(12):
        base[(i * 9) % 100] = f"x{i}"
        rows.append((i, " ".join(base)))
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark, documents(spark, rows)).collect()}
    assert found == brute_components({i: shingles(t, 4) for i, t in rows})


def test_near_dedup_odd_rows(spark):
    assert near_dedup.near_groups(spark, documents(spark, [])).count() == 0
    rows = [(None, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (9, "a b c d e f g h")]
    found = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in near_dedup.near_groups(spark, documents(spark, rows)).collect())
    assert found == [(-1, None, True), (3, 3, True), (3, 3, True), (9, 3, False)]


def test_near_dedup_of_ids_with_two_texts(spark):
    """Every text is compared, whatever its row's id, also beside a null id and ids beyond a double's reach."""
    rng = random.Random(12)
    first, second = words(rng, 60, 9000), words(rng, 60, 9000)
    rows = [(2**60 + 1, first), (2**60 + 1, second), (2**60 + 2, second + " tail"), (2**60 + 3, first + " tail"), (None, second), (5, words(rng, 60, 9000))]
    found = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dedup.near_groups(spark, documents(spark, rows)).collect())
    one = 2**60 + 1
    assert found == sorted([(one, one, True), (one, one, True), (one + 1, one, False), (one + 2, one, False), (-1, None, True), (5, 5, True)])
    assert {r["doc_id"] for r in near_dedup.keep_one(spark, documents(spark, rows)).collect()} == {one, None, 5}


@pytest.mark.parametrize("each", [20, 0])
def test_near_dedup_of_crowded_buckets(spark, monkeypatch, each):
    """Salted buckets, several blocks, and blocks tested whole give the same links."""
    for name, value in {"DEALT": 8, "BLOCK": 16, "PAIRS_EACH": each, "HUB_ROUNDS": 2, "PAIRS_AT_ONCE": 50}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(4)
    base, rows = words(rng, 120, 9000).split(), []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(120)] = f"y{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark, documents(spark, rows)).collect()}
    assert found == brute_components({i: shingles(t, 4) for i, t in rows})


def test_estimate_keeps_pairs_at_the_threshold():
    """Recall of banding and of the estimate, measured on pairs of sets at 0.8: neither loses what the parameters allow."""
    rng = np.random.default_rng(3)
    for spec, least in ((near_dedup.DOCUMENTS, 0.999), (substring_dedup.PARAGRAPHS, 0.985)):
        banded = estimated = 0
        for _ in range(1500):
            every = rng.integers(0, 2**63, 90, np.uint64)
            pair = [np.sort(every[:80]), np.sort(np.concatenate([every[:70], every[80:]]))]  # 70 of 90: below the threshold
            pair[1] = np.sort(np.concatenate([every[:72], every[80:88]]))  # 72 of 88: just above it
            planes, bands = near_dedup.signatures(np.concatenate(pair), np.array([80, 80]), spec)
            banded += bool((bands[:, 0] == bands[:, 1]).any())
            differ = sum(int(np.bitwise_count((planes[p, 0] ^ planes[p, 1]) | (planes[p + spec.planes, 0] ^ planes[p + spec.planes, 1]))) for p in range(spec.planes))
            estimated += (1 - differ / spec.hashes - 0.25) / 0.75 >= spec.least_estimate
        assert banded >= least * 1500 and estimated >= 0.999 * 1500


def test_substring_dedup_query(spark, tmp_path):
    """The query's own columns, with repeated ids, a null id, extra columns, and short lines that are listed but stay."""
    rng = random.Random(21)
    line, other, passage = words(rng, 30, 9000), words(rng, 30, 9000), words(rng, 60, 9000)
    big = 2**62
    rows = [(1, f"{line}\nhi there\n{other}"), (1, f"x\n{passage}"), (big, f"hi there\n{line}"), (big, f"{other} end\nlone"), (7, f"{words(rng, 40, 9000)} {passage} {words(rng, 40, 9000)}"), (8, None), (None, line)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = substring_dedup.op1_substring_dedup(spark, str(tmp_path))
    assert found.dtypes[:3] == [("doc_id", "bigint"), ("n_paragraphs", "bigint"), ("n_removed", "bigint")]
    got = sorted((r["doc_id"] or 0, r["n_paragraphs"], r["n_removed"], r["removed"], r["short"], len(r["passages"]), r["kept_in"]) for r in found.collect())
    assert got == sorted([
        (1, 3, 0, [], [], 0, []), (1, 2, 0, [], [], 0, []), (big, 2, 1, [1], [0], 0, [1]), (big, 2, 1, [0], [], 0, [1]),
        (7, 1, 1, [], [], 1, [1]), (8, 1, 0, [], [], 0, []), (0, 1, 0, [], [], 0, []),
    ])


def test_substring_dedup_is_brute_force(spark):
    rng = random.Random(3)
    shared = [words(rng, 60), words(rng, 55)]
    rows = [(None, shared[0]), (900, None), (901, ""), (902, "short line\nshort line"), (903, "\n\n")]
    for i in range(25):
        lines = [words(rng, rng.randrange(3, 40)) for _ in range(4)]
        if i % 2:
            passage = shared[i % 4 // 2].split()
            passage[rng.randrange(60) % len(passage)] = "zz"
            lines.insert(rng.randrange(5), " ".join(passage))
        rows.append((i, "\n".join(lines)))
    docs = documents(spark, rows)
    repeats = substring_dedup.repeated_paragraphs(spark, docs)
    found = {(r["doc_id"], r["place"]): (r["kept_doc"], r["kept_place"]) for r in repeats.collect()}
    sets = {(i, p): shingles(line, 5) for i, t in rows if i is not None for p, line in enumerate((t or "").split("\n")) if line.split()}
    expected = {i: c for i, c in brute_components(sets).items() if i != c}
    assert found == expected and {902, 0} < {i for i, _ in expected} | {0}
    expected = {at: c for at, c in expected.items() if len(dict(rows)[at[0]].split("\n")[at[1]].split()) >= 8}
    cleaned = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs, repeats).collect()}
    for i, t in rows:
        if i is not None and t is not None:
            assert cleaned[i] == "\n".join(line for p, line in enumerate(t.split("\n")) if (i, p) not in expected)
    assert cleaned[900] is None and substring_dedup.repeated_paragraphs(spark, documents(spark, [])).count() == 0


def brute_passages(rows, least):
    seen, out = {}, {}
    for i, text in sorted(rows):
        w, gone = (text or "").encode().lower().split(), set()
        for p in range(len(w) - least + 1):
            doc, first = seen.setdefault(tuple(w[p : p + least]), (i, p))
            if (doc, first) != (i, p):
                gone |= set(range(max(p, first + least) if doc == i else p, p + least))
        out[i] = gone
    return out


def test_substring_dedup_takes_passages_inside_lines(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 100)
    rng = random.Random(9)
    passages = [words(rng, 70) for _ in range(3)]
    rows = [(700, None), (701, ""), (702, "a " * 300), (703, "ab cd " * 200 + "e"), (704, words(rng, 49))]
    for i in range(30):
        p = passages[i % 3].split()[rng.randrange(15) : 70 - rng.randrange(15)]
        p[20 : 20 + i % 2] = [p[20].upper()] * (i % 2)
        rows.append((i, words(rng, rng.randrange(150)) + " " + (" ", "\n", "  ")[i % 3].join(p) + " " + words(rng, rng.randrange(60))))
    rows += [(100, rows[9][1]), (101, rows[9][1])]
    docs = documents(spark, rows + [(None, rows[9][1]), rows[9]])
    found = substring_dedup.repeated_passages(spark, docs)
    spans = {r["doc_id"]: {w for s in r["passages"] for w in range(s["begin"], s["finish"])} for r in found.collect()}
    expected = {i: gone for i, gone in brute_passages(rows, 50).items() if gone}
    assert spans == expected and len(expected) > 20
    cleaned = substring_dedup.without_passages(documents(spark, rows), spark.createDataFrame([], "doc_id long, row long, place int, words int, kept_doc long"), found)
    for r in cleaned.collect():
        text = dict(rows)[r["doc_id"]]
        left = [w for at, w in enumerate((text or "").split()) if at not in expected.get(r["doc_id"], ())]
        assert (r["text"] or "").split() == left and (r["text"] is None) == (text is None)
        assert r["doc_id"] in expected or r["text"] == text
    assert substring_dedup.repeated_passages(spark, documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    least = {n: n for n in nodes}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = components.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in found} == least and len(found) == len(nodes)
    assert components.components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


# 2: URL filters


def test_url_filters_odd_rows(spark):
    captures = [(1, "http://a.b.example.org/x/y?q", "2024-02-01"), (2, None, "2024-02-01"), (3, "no url", "2024-02-01"), (4, "HTTP://u@B.Example.org:80./x", None), (5, "http://other.net", "2024-02-01"), (1, "http://a.b.example.org/x/y?q", "2024-02-01")]
    pages = spark.createDataFrame([(*c, 1) for c in captures], "page_id long, url string, f string, key int").withColumn("fetched_at", F.col("f").cast("timestamp"))
    entries = [("example.org", "block", "2024-01-01"), ("example.org", "allow", "2024-03-01"), ("a.b.example.org/x", "allow", "2024-01-15"), (None, "block", "2024-01-01"), ("other.net", "block", None), ("b.example.org", "block", "2024-02-02")]
    listed = spark.createDataFrame(entries, "key string, action string, l string").withColumn("listed_at", F.col("l").cast("timestamp"))
    found = {r["page_id"]: (r["list_key"], r["kept"]) for r in url_filters.evaluate(pages, listed).collect()}
    assert found == {1: ("a.b.example.org/x", True), 2: (None, True), 3: (None, True), 4: (None, True), 5: (None, True)}
    assert url_filters.evaluate(pages, listed.limit(0)).where("kept").count() == 5 and url_filters.evaluate(pages.limit(0), listed).count() == 0
    early = pages.withColumn("fetched_at", F.lit("2024-01-10").cast("timestamp")).where("page_id = 1")
    assert url_filters.evaluate(early, listed).first()["kept"] is False


def test_url_filters_hosts_of_one_label(spark):
    pages = spark.createDataFrame([(1, "http://localhost/a"), (2, "http://intranet"), (3, "http://www.localhost/"), (4, "http://org/")], "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp"))
    listed = spark.createDataFrame([("localhost", "block"), ("intranet", "block"), ("org", "allow")], "key string, action string").withColumn("listed_at", F.lit("2024-01-01").cast("timestamp"))
    found = {r["page_id"]: (r["list_key"], r["kept"]) for r in url_filters.evaluate(pages, listed).collect()}
    assert found == {1: ("localhost", False), 2: ("intranet", False), 3: (None, True), 4: ("org", True)}


# 3: decontamination


def brute_leaks(rows, items):
    hashes = decontamination.PlainWords()
    found = set()
    for item_id, item in items:
        iw, _ = decontamination.plain_words([item or ""], hashes)
        if not len(iw):
            continue
        grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
        mine = grams(iw.tolist())
        for doc_id, text in rows:
            dw = decontamination.plain_words([text or ""], hashes)[0].tolist()
            for at in range(max(len(dw) - len(iw), 0) + 1):
                theirs = grams(dw[at : at + len(iw)])
                shared = (mine & theirs).total()
                if dw and shared / (mine.total() + theirs.total() - shared) >= 0.8:
                    found.add((doc_id, item_id))
    return found


def test_decontamination_is_brute_force(spark):
    rng = random.Random(4)
    items = [(i, words(rng, n)) for i, n in enumerate([1, 3, 5, 9, 14, 16, 25, 33, 47, 50, 59, 90, 130, 260])] + [(90, None), (91, ""), (92, "...")]
    rows = [(500, None), (501, ""), (502, "w1"), (503, words(rng, 8000))]
    for i in range(150):
        item = items[rng.randrange(14)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(item) + 1)
            item[at : at + rng.randrange(2)] = ["zz"] * rng.randrange(2)
        text = words(rng, rng.randrange(0, 60)) + " " + ", ".join(item).upper() + " " + words(rng, rng.randrange(0, 60))
        rows.append((i, text))
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark, docs, bench).collect()}
    expected = brute_leaks(rows, items)
    assert found == expected and len({d for d, _ in expected}) > 60
    clean = decontamination.drop_leaks(spark, docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in expected} and clean.columns == docs.columns
    assert decontamination.find_leaks(spark, docs, bench.limit(0)).count() == 0 and decontamination.drop_leaks(spark, docs, bench.limit(0)).count() == len(rows)
    assert decontamination.find_leaks(spark, documents(spark, []), bench).count() == 0


def test_decontamination_finds_truncated_items_and_exactly_the_threshold():
    rng = random.Random(7)
    items = [(n, words(rng, n, 100_000)) for n in (13, 18, 22, 27, 31, 36, 40, 44, 48)]
    index, rows = decontamination.ItemIndex(items), []
    for n, text in items:
        lost = (n - 4) // 5
        for before in range(4):
            w, around = text.split(), words(rng, before, 100_000)
            rows += [around, " ".join(w[lost:]), around, " ".join(w[: n - lost])]
            e = (n - 4) // 9
            rows.append(" ".join([*around.split(), *["zz"] * e, *w[e:], "end"]))
            rows.append(" ".join([*around.split(), *w[: n - e], *["zz"] * e, "end"]))
    leaks = index.leaks(rows, decontamination.PlainWords(), 0.8)
    found = {(at, item) for at, mine in enumerate(leaks) for item, _, _ in mine}
    assert found == brute_leaks(list(enumerate(rows)), items) and len(found) > 100


# 4: suffix array


def brute_repeats(rows, least):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - least + 1):
            piece = data[p : p + least]
            if piece in seen:
                gone[p : p + least] = True
            seen.add(piece)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefghij"])
def test_interval_expansion_is_brute_force(alphabet):
    """Places that share ``least`` bytes with the one before, as the transform alone tells."""
    rng = random.Random(len(alphabet))
    base = bytes(rng.choice(alphabet) for _ in range(60))
    for _ in range(60):
        least, texts = rng.choice([1, 2, 5, 12, 20]), []
        for _ in range(rng.randrange(1, 8)):
            begin = rng.randrange(30)
            text = bytearray(base[begin : begin + rng.randrange(20, 31)])
            text[rng.randrange(len(text))] = rng.choice(alphabet)
            texts.append(bytes(text))
        joined = b"\xff".join(texts) + b"\xff"
        data = np.frombuffer(joined, np.uint8)
        order = suffix_dedup.suffix_order(data, least)
        found = suffix_dedup.common_prefixes(data[order - 1], least)
        strings = [joined[at : at + least] for at in order]
        assert sorted(order) == list(range(len(joined)))
        for place in range(1, len(order)):
            if b"\xff" not in strings[place] or b"\xff" not in strings[place - 1]:
                assert found[place] == (strings[place] == strings[place - 1])


def test_starts_without_any_repeat():
    """Texts that share an anchor but no string of ``least`` bytes: a task may get nothing else."""
    texts = [bytes(range(97, 122)), bytes(range(100, 122)) + b"abc"]
    found = suffix_dedup.repeated_starts(texts, np.array([0, 1]), np.array([0, 5]), np.array([3, 3]), 23)
    assert found.tolist() == [False] * 6
    assert suffix_dedup.repeated_starts(texts[:1], np.array([0]), np.array([0]), np.array([3]), 23).tolist() == [False] * 3
    found = suffix_dedup.repeated_starts(texts, np.array([0, 1]), np.array([0, 5]), np.array([4, 4]), 22)
    assert found.tolist() == [False] * 4 + [True] + [False] * 3


@pytest.mark.parametrize("most", [1000, 1])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)
    monkeypatch.setattr(suffix_dedup, "TRANSFORM", 5000)
    rng = random.Random(6)
    passages = [words(rng, 40) for _ in range(3)]
    rows = [(800, None), (801, ""), (802, "x" * 99), (803, "y" * 3000), (804, "y" * 150), (805, "ab" * 400), (-5, passages[0])]
    for i in range(40):
        p = passages[i % 3]
        rows.append((i, words(rng, rng.randrange(30)) + p[rng.randrange(60) : len(p) - rng.randrange(60)] + "é" * rng.randrange(80) + words(rng, rng.randrange(30))))
    rows += [(100, rows[9][1]), (101, rows[9][1])]
    docs = documents(spark, rows)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found == brute_repeats(rows, 100)


def test_suffix_dedup_collapses_equal_slices(spark, monkeypatch):
    """Slices inside a passage that many texts share come to the transform once, not once for each text."""
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", 10)
    rng = random.Random(12)
    passage = words(rng, 60)
    rows = [(i, words(rng, 12, 10_000) + passage + words(rng, 12, 10_000)) for i in range(60)]
    given = []
    expand = suffix_dedup._expand
    monkeypatch.setattr(suffix_dedup, "_expand", lambda slices, least: given.append(slices) or expand(slices, least))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert found == brute_repeats(rows, 100)
    assert given[0].count() > 0 and given[0].count() == given[0].select("key", "bytes").distinct().count()


def test_suffix_dedup_odd_rows(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0
    text = words(random.Random(2), 80)
    found = sorted(((r["doc_id"] or -1), r["n_removed"] > 0) for r in suffix_dedup.remove_repeats(documents(spark, [(None, text), (4, text), (4, text)])).collect())
    assert found == [(-1, False), (4, True), (4, True)]
    twice = suffix_dedup.remove_repeats(documents(spark, [(4, text), (4, text)]), with_text=True).collect()
    assert [r["n_removed"] for r in twice] == [0, 0] and twice[0]["kept"] == text.encode()


# 5: HTML


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header class=site-header><a href=/>Home</a></header>"
    "<nav><ul><li><a href=/a>menu</a></li></ul></nav><div class='cookie-notice'>cookies</div><article class='post-12'><h1>Head &amp; more</h1><p>One\n two<br>three<p><b>Bold</b> text &#233;"
    "<div class=ad>advert</div><blockquote><p>Quote</p></blockquote><form><input value=x>form</form><script>no()</script><aside>side</aside></article>"
    "<section id=comments><p>reader says</p></section><footer>foot</footer>"
)
TEXT = "Head & more\nOne two three\nBold text é\nQuote"


def test_html_extraction(spark):
    rows = [(i, "http://a.example/x", PAGE) for i in range(3)] + [(3, None, PAGE), (4, "http://b.example", None), (5, "http://b.example", ""), (6, "junk", "plain < text"), (7, "http://c.example", "<body><div class='content'><p>" + "long text " * 3000 + "</p></div></body>")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, path string, host int")
    found = {r["page_id"]: r["text"] for r in html_extraction.extract(spark, pages).collect()}
    assert [found[i] for i in range(4)] == [TEXT] * 4
    assert (found[4], found[5], found[6]) == ("", "", "plain < text") and found[7] == ("long text " * 3000).strip()
    assert html_extraction.extract(spark, pages.limit(0)).count() == 0


def test_html_consensus_overrules_a_page(spark):
    """A page whose largest container is another takes its host's path all the same."""
    usual = "<body><div class=story><p>" + "story words " * 20 + "</p></div><div class=extra><p>x</p></div></body>"
    odd = "<body><div class=story><p>short</p></div><div class=extra><p>" + "extra words " * 50 + "</p></div></body>"
    rows = [(i, "http://a.example/", usual) for i in range(4)] + [(9, "http://a.example/", odd)]
    found = {r["page_id"]: r for r in html_extraction.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9]["text"] == "short" and found[9]["consensus"]


# 6: packing


def test_packing_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(200))) for i in range(60)] + [(90, None), (91, ""), (92, words(rng, 3000)), (93, "Ünïcode ΣΑΣ 日本 it's <|endoftext|> x"), (93, "again"), (None, "no id")]
    docs = documents(spark, rows)
    found = packing.pack(spark, docs, 512).toPandas()
    encode = packing.encoder(packing.vocabulary_path()).whole
    expected = Counter()
    for i, t in rows:
        ids = np.append(np.frombuffer(encode(t or ""), "<u4"), 1).astype("<u4")
        for piece, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            expected[(-1 if i is None else i, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = Counter(zip(found.doc_id.fillna(-1).astype(int), found.piece, found.start, found.length, found.ids_crc32))
    assert got == expected
    for _, one in found.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one.offset.tolist() == (one.length.cumsum() - one.length).tolist() and one.length.sum() <= 512
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 512) + 1
    assert packing.pack(spark, documents(spark, [])).count() == 0


def test_packing_sequences(spark):
    docs = documents(spark, [(1, "a b c"), (2, "d e f g")])
    found = packing.sequences(spark, docs, packing.pack(spark, docs, 16), 16).collect()
    assert len(found) == 1 and sum(p["length"] for p in found[0]["parts"]) == len(found[0]["ids"])


def test_encoder_is_the_tokenizer():
    encoder = packing.encoder(packing.vocabulary_path())
    rng = random.Random(9)
    letters = "abcdeéàüñßÆÿ0123456789²½'!?.,-_*%&$#@()[]{}<>/\\|~^+=:;\" \t\n\xa0"
    for text in ["it's 'S we'LL", "a" * 300, "x\x85y\x1cz", "İstanbul ſ", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000))]:
        assert encoder.encode(text) == encoder.whole(text), text


# 8: chat


def test_chat_events(spark):
    log = [
        (1, 1, "open", 1, "user", None), (1, 2, "delta", 1, None, "he"), (1, 3, "delta", 1, None, "llo"), (1, 3, "delta", 1, None, "llo"), (1, 4, "open", 2, "assistant", None),
        (1, 5, "delta", 2, None, "bad"), (1, 6, "open", 3, "user", None), (1, 7, "delta", 3, None, "gone"), (1, 8, "regenerate", 2, None, None), (1, 9, "delta", 2, None, "<s>\\[INST]"),
        (1, 10, "edit", 1, None, "hi \\ </s>"), (2, 1, "delta", 1, None, "no open"), (None, 1, "open", 1, None, None),
    ]
    events = spark.createDataFrame([(*e, 1) for e in log], "conv_id long, seq long, kind string, message long, role string, payload string, t int")
    messages = chat.fold_events(events)
    found = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in messages.collect()}
    assert found == {(1, 1): ("user", "hi \\ </s>"), (1, 2): ("assistant", "<s>\\[INST]"), (2, 1): ("", "no open"), (None, 1): ("", "")}
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(messages)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "hi \\ </s>"), ("assistant", "<s>\\[INST]")] and back[1]["loss_text"] == "<s>\\[INST]"
    assert chat.fold_events(events.limit(0)).count() == 0


def test_chat_escape_is_reversible(spark):
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "x", "\n", "/"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] and not any(c in r["e"] for c in (chat.BOS, chat.EOS, chat.OPEN, chat.CLOSE)) for r in rows)


# 9: exact


def test_cuckoo_index():
    index, live, rng = exact_dedup.CuckooIndex(8), {}, random.Random(7)
    for step in range(20_000):
        key = hashlib.sha256(str(rng.randrange(4000)).encode()).digest()
        if rng.random() < 0.3:
            assert index.delete(key) == (live.pop(key, None) is not None)
        elif index.find(key) is None:
            assert key not in live
            index.insert(key, step)
            live[key] = step
        else:
            assert key in live and index.may_contain(key)
    assert {k: p for k, p in index.records()} == live and index.size == len(live) and index.resizes > 0


def test_exact_dedup_odd_rows(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a  b"), (9, None), (8, ""), (7, " \t"), (1, "x"), (1, "x"), (None, "ab"), (2, " "), (6, "z" * 200_000)]
    docs = documents(spark, rows)
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(spark, docs).collect()}
    assert found == {(5, 4, 4, False), (3, 4, 4, False), (4, 4, 4, True), (None, 4, 4, False), (9, 7, 3, False), (8, 7, 3, False), (7, 7, 3, True), (1, 1, 2, True), (2, 2, 1, True), (6, 6, 1, True)}
    kept = exact_dedup.keep_one(spark, docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 6, 7] and kept.columns == docs.columns
    assert exact_dedup.exact_groups(spark, documents(spark, [])).count() == 0


def test_index_updates(spark):
    first = exact_dedup.digests(documents(spark, [(1, "a"), (2, "b"), (3, "b")]))
    index = exact_dedup.build_index(spark, first, 3)
    gone, new = exact_dedup.digests(documents(spark, [(0, "a"), (0, "not there")])), exact_dedup.digests(documents(spark, [(7, "c"), (8, "b ")]))
    after = exact_dedup.update_index(index, new, gone, 3)
    assert sorted((r["keep_id"], r["group_size"]) for r in after.collect()) == [(7, 1), (8, 3)]
    asked = exact_dedup.digests(documents(spark, [(1, "a"), (2, "b"), (3, "c")]))
    assert {r["doc_id"]: bool(r["live"]) for r in exact_dedup.lookup(after, asked, 3).collect()} == {1: False, 2: True, 3: True}


# 10: toxicity


def toxic_corpus(n=600):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        w = words(rng, rng.randrange(20, 60)).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["vermin", "blockhead"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus()
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "vermin"), (9002, "w1 " * 50_000)])
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train_model(spark, docs, labels, bits=14)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, bits=14).collect()}
    assert len(found) == 604 and all(0 <= s <= 1 for s in found.values())
    held = [(found[i] >= 0.5, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    kept = toxicity.drop_toxic(spark, docs, labels, bits=14)
    assert kept.columns == docs.columns and 450 < kept.count() < 500


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.train_model(spark, docs, labels, bits=10), bits=10).collect()] == [0.5, 0.5]
    assert toxicity.score(documents(spark, []), np.zeros(2**10 + 1), bits=10).count() == 0


def test_nb_ratio_scaling_finds_words():
    texts = [t for _, t, _ in toxic_corpus(200)]
    y = np.array([float(v) for _, _, v in toxic_corpus(200)])
    features = [toxicity.ngram_buckets(t, bits=12) for t in texts]
    assert all(np.array_equal(f, np.unique(f)) for f in features)
    ratios = np.random.default_rng(0).normal(size=1 << 12)
    assert toxicity.fit_logistic(features, y, ratios).shape == ((1 << 12) + 1,)
    assert pd.Series(toxicity.ngram_buckets("")).is_monotonic_increasing


# Ids: nulls beside ids beyond a double's reach, and one id with several texts

BIG = 2**60 + 1


def test_ids_stay_as_they_are(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(BIG, f"start {item} end"), (BIG + 1, f"other {item}"), (None, item), (5, "nothing of the kind"), (5, None), (None, None)]
    ids = Counter(i for i, _ in rows)
    docs = documents(spark, rows)
    leaks = decontamination.find_leaks(spark, docs, spark.createDataFrame([(BIG + 2, item)], "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in leaks) == Counter({(BIG, BIG + 2): 1, (BIG + 1, BIG + 2): 1, (None, BIG + 2): 1})
    packed = packing.pack(spark, docs).collect()
    assert Counter(r["doc_id"] for r in packed) == ids
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in packed) == Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in packing.token_pieces(docs).collect())
    weights = np.zeros((1 << 8) + 1)
    assert Counter((r["doc_id"], r["score"]) for r in toxicity.score(docs, weights, bits=8).collect()) == Counter({(i, 0.5): n for i, n in ids.items()})


def test_exact_dedup_keeps_one_whatever_the_ids(spark):
    rows = [(BIG, "a b"), (BIG + 1, "ab"), (None, "a  b "), (BIG + 2, "c d"), (BIG + 3, "c  d"), (None, "cd"), (None, "e"), (None, "e"), (7, "g h"), (7, "gh")]
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(spark, documents(spark, rows)).collect()}
    assert found == {
        (BIG, None, 3, False), (BIG + 1, None, 3, False), (None, None, 3, True), (BIG + 2, BIG + 3, 3, False), (BIG + 3, BIG + 3, 3, True), (None, BIG + 3, 3, False),
        (None, None, 2, True), (7, 7, 2, True), (7, 7, 2, False),
    }
    kept = Counter((r["doc_id"], r["text"]) for r in exact_dedup.keep_one(spark, documents(spark, rows)).collect())
    assert kept == Counter([(None, "a  b "), (BIG + 3, "c  d"), (None, "e"), (7, "g h")])


@pytest.mark.parametrize("most", [1, 1000])
def test_suffix_dedup_of_ids_with_two_texts(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)
    rng = random.Random(31)
    shared, tail = words(rng, 60, 9000), words(rng, 40, 9000)
    rows = [(4, f"{words(rng, 30, 9000)} {shared} {tail}"), (4, f"{shared} {words(rng, 30, 9000)}"), (4, "short"), (9, f"x {shared} {words(rng, 9, 9000)}"), (None, None)]
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"] > 300) for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect())
    sizes = [len((t or "").encode()) for _, t in rows]
    first = Counter({(4, sizes[0], False): 1, (4, sizes[1], True): 1, (4, sizes[2], False): 1, (9, sizes[3], True): 1, (None, 0, False): 1})
    other = Counter({(4, sizes[0], True): 1, (4, sizes[1], False): 1, (4, sizes[2], False): 1, (9, sizes[3], True): 1, (None, 0, False): 1})
    assert found in (first, other)


def test_html_of_broken_and_deep_pages():
    page = html_extraction.Page('<body><article><p>one <a href="x>link</a> two</p><p>it&amp;s <math><mi>x</mi></math></p></article></body>')
    assert page.text_at(page.best()[0]) == "one link two\nit&s x"
    assert html_extraction.Page("<body>" + "<span>a " * 20_000 + "</b>" * 20_000).all_text() == ("a " * 20_000).strip()
    assert html_extraction.Page("<body>" + "<div class='x'>a" * 5_000).all_text() == "\n".join("a" * 5_000)


def test_packing_places_by_sum_of_squares():
    """Every placement against the definition: of all open bins the one that leaves the least sum of squared counts per gap."""
    rng, capacity = np.random.default_rng(7), 30
    lengths = rng.integers(1, 31, 300)
    bins, offsets = packing.pack_lengths(lengths, capacity)
    gaps: dict[int, int] = {}
    for at in np.argsort(-lengths, kind="stable"):
        size, counts = int(lengths[at]), Counter(g for g in gaps.values() if g)

        def squares(gap):
            after = counts + Counter({gap - size: 1} if gap > size else {})
            after[gap] -= 1
            return sum(n * n for n in after.values())

        fitting = sorted(g for g in counts if g >= size)
        gap = gaps.get(bins[at], capacity)
        if fitting:
            assert bins[at] in gaps and gap == min(fitting, key=lambda g: (squares(g), g))
        else:
            assert bins[at] not in gaps
        assert offsets[at] == capacity - gap
        gaps[bins[at]] = gap - size


def test_toxicity_scores_are_the_definition(spark, tmp_path):
    """Ratios and scores of the query, recomputed from n-grams, counts and the fitted weights."""
    rng = random.Random(5)
    rows = [(i, words(rng, 20) + (" vile scum" if i % 3 == 0 else " kind folk")) for i in range(90)] + [(None, "vile scum"), (95, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    weights = toxicity.train_model(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    model = toxicity.Model(weights, toxicity.ORDERS, toxicity.BUCKET_BITS)
    expected = {i: float(model.scores([t])[0]) for i, t in rows}
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == held(r["doc_id"]) and abs(r["score"] - expected[r["doc_id"]]) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in found if r["doc_id"] is not None and r["doc_id"] < 90)
    train = [(t, int(i % 3 == 0)) for i, t in rows[:90] if not held(i)]
    counts = {c: Counter(b for t, toxic in train if toxic == c for b in set(toxicity.ngram_buckets(t).tolist())) for c in (0, 1)}
    got = {r["bucket"]: (r["other_docs"], r["toxic_docs"]) for r in toxicity.frequencies(spark.createDataFrame(train, "text string, toxic int")).collect()}
    assert got == {b: (counts[0][b], counts[1][b]) for b in counts[0] | counts[1]} | {-1: tuple(sum(x == c for _, x in train) for c in (0, 1))}

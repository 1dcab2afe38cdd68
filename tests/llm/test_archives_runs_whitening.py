"""WARC archives, periodic runs and whitening, each through its query against brute force or SQL, and on odd rows."""

import gzip
import hashlib
import io
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmark.llm import periodic_runs, warc, whitening
from tests.helpers import rows_of, sql_rows

# 11: WARC

PAGES = "page_id long, url string, html string, digest string, row int, first string, payload string, key int"


def pages(spark, rows):
    """Pages with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, u, h, "d", 1, "f", "p", 2) for i, u, h in rows], PAGES)


LONG = "<p>" + "same words " * 20 + "</p>"
ROWS = [
    (7, "http://a.b/1", LONG), (3, "http://a.b/2", LONG), (3, "http://a.b/3", LONG), (None, "http://a.b/4", LONG), (9, None, None), (10, "x\r\nWARC-Type: revisit\r\ny", ""), (11, "u", "é" * 49), (12, "u", "é" * 49),
    (13, "u", "é" * 50), (14, "u", "é" * 50), (15, "u", "WARC/1.1\r\n\r\n" + "x" * 300), (2**60 + 1, "u", "WARC/1.1\r\n\r\n" + "x" * 300), (-4, "u", "long " * 400_000), (16, "u", "a\r\nb\n\0c" * 30),
]


def test_warc_query(spark, tmp_path):
    pages(spark, ROWS).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    found = warc.op11_warc(spark, str(tmp_path))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = Counter(tuple(r) for r in found.collect())
    expected = Counter()
    for i, _, html in ROWS:
        data = (html or "").encode()
        same = [k for k, _, h in ROWS if (h or "") == (html or "")]
        least = min((k for k in same if k is not None), default=None)
        expected[i, len(data), hashlib.sha256(data).hexdigest(), len(data) >= 100 and len(same) > 1, least] += 1
    types = Counter((i, n, d) for i, n, d, _, _ in got.elements())
    assert types == Counter((i, n, d) for i, n, d, _, _ in expected.elements())
    by_type = {(r[0], r[3], r[4]) for r in got}
    assert {(3, "response", None), (3, "revisit", 3), (7, "revisit", 3), (None, "revisit", 3), (11, "response", None), (12, "response", None), (13, "response", None), (14, "revisit", 13), (2**60 + 1, "revisit", 15)} <= by_type
    assert rows_of(found) == sql_rows(warc.OP11_SQL, str(tmp_path))
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op11_warc(spark, f"{tmp_path}/none").count() == 0


def test_warc_archives_are_members_that_any_reader_takes(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 3} {'text ' * 40}</p>") for i in range(60)]
    warc.write_monolithic(pages(spark, rows).coalesce(2), f"{tmp_path}/mono")
    for path in tmp_path.glob("mono/*.gz"):  # a whole-file stream: one member
        data = path.read_bytes()
        inflater = zlib.decompressobj(31)
        assert len(inflater.decompress(data)) > len(data) and not inflater.unused_data
    manifest = warc.normalise(spark, f"{tmp_path}/mono", f"{tmp_path}/target")
    assert manifest.agg(F.sum("n_records")).first()[0] == 60 and not manifest.where("error IS NOT NULL").count()
    for m in manifest.collect():
        archive = open(m["archive"].removeprefix("file:"), "rb").read()
        source = gzip.decompress(open(m["source"].removeprefix("file:"), "rb").read())
        assert gzip.decompress(archive) == source and len(archive) == m["n_bytes"]
        index = [json.loads(x) for x in open(m["sidecar"].removeprefix("file:"))]
        assert [x["offset"] for x in index] == np.cumsum([0, *(x["length"] for x in index)])[:-1].tolist()
        for x in index:  # each place holds one whole member, which begins with its record
            inflater = zlib.decompressobj(31)
            text = inflater.decompress(archive[x["offset"] : x["offset"] + x["length"]])
            assert inflater.eof and not inflater.unused_data and text.startswith(b"WARC/1.1\r\n") and x["id"].encode() in text
    read = warc.read_records(warc.read_index(manifest), payloads=True).collect()
    assert Counter((r["id"].split(":")[2], bytes(r["payload"]).decode()) for r in read if r["type"] == "response") == Counter((str(i), h) for i, _, h in rows[:3])
    assert {r["uri"] for r in read} == {u for _, u, _ in rows} and all(r["payload"] is None for r in read if r["type"] == "revisit")


def test_warc_normaliser_takes_members_and_stops_at_breaks(spark, tmp_path):
    record = lambda n, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{n}>\r\nX-Folded: a\r\n b\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    whole = [record(i, b"body %d" % i * 50) for i in range(4)]
    files = {
        "members.gz": b"".join(map(gzip.compress, whole)), "torn.gz": gzip.compress(b"".join(whole))[:-30], "cut.gz": gzip.compress(b"".join(whole)[:-100]), "other.gz": gzip.compress(b"no archive"), "empty.gz": gzip.compress(b""),
        "plain.gz": b"not even gzip", "length.gz": gzip.compress(whole[0] + b"WARC/1.0\r\nContent-Length: x\r\n\r\n"),
    }
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    manifest = warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    found = {r["source"].rsplit("/", 1)[-1]: (r["n_records"], r["error"] is None) for r in manifest.collect()}
    assert found.pop("torn.gz")[1] is False
    assert found == {"members.gz": (4, True), "cut.gz": (3, False), "other.gz": (0, False), "empty.gz": (0, True), "plain.gz": (0, False), "length.gz": (1, False)}
    read = warc.read_records(warc.read_index(manifest.where("source LIKE '%members.gz'")), payloads=True).collect()
    assert sorted(bytes(r["payload"]) for r in read) == [b"body %d" % i * 50 for i in range(4)]
    with pytest.raises(ValueError, match="not the one"):
        warc.read_record(gzip.compress(b"WARC/1.0\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"), False)
    assert warc.read_head(io.BytesIO(b"\r\n\r\n")) is None


# 12: runs


def brute_runs(words, least=6, powers=4):
    found = {}
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, powers * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    words = periodic_runs.planted_period((text or "").encode().split(), doc_id)
    runs = brute_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest(),
    )


def periodic_text(rng):
    words = []
    for _ in range(rng.randrange(6)):
        if rng.random() < 0.5:
            period = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            words += (period * 9)[: rng.randrange(1, 60)]
        else:
            words += [f"w{rng.randrange(rng.choice([2, 3, 50]))}" for _ in range(rng.randrange(30))]
    return rng.choice([" ", "\t", "\n\x0b"]).join(words)


@pytest.mark.parametrize("together", [1 << 17, 40])
def test_periodic_runs_are_brute_force(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(periodic_runs, "WORDS_AT_ONCE", together)
    monkeypatch.setattr(periodic_runs, "PLACES_AT_ONCE", together)
    rng = random.Random(12)
    rows = [(i, periodic_text(rng)) for i in range(300)] + [(None, "a b " * 9), (None, None), (5, "x " * 50), (5, "x " * 50), (6, ""), (7, " \n "), (2**60 + 1, "é è " * 8), (301, "q" * 100_000 + " z" * 7), (302, "n\xa0n " * 6)]
    rows += [(400 + i, " ".join(f"t{(j * j + i) % 97}" for j in range(800))) for i in range(20)]
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, collapsed string").write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == Counter(expected_runs(*row) for row in rows)
    assert periodic_runs.op12_periodic_runs(spark, str(tmp_path)).where("n_runs > 1").count() > 20


def test_runs_of_a_very_long_text_and_shared_periods(spark):
    words = [f"w{i % 7}" for i in range(60_000)] + ["end"] + ["x", "y", "x", "y"] * 2_000 + [f"u{i}" for i in range(20_000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "a a a a a a b a a a a a a b a a a a a a b a a a a a a b")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in periodic_runs.collapse_runs(rows).collect()}
    assert [tuple(r) for r in found[1]["runs"]] == [(0, 60_000, 7), (60_001, 8_000, 2)] and found[1]["n_words"] == len(words)
    assert found[1]["collapsed"].split() == [*words[:7], "end", "x", "y", *words[-20_000:]]
    assert [tuple(r) for r in found[2]["runs"]] == [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]
    assert periodic_runs.collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(3, np.int64), np.array([3]), powers=2)


# 13: whitening


def test_whitening_is_a_dense_decomposition(spark, tmp_path):
    rng = np.random.default_rng(13)
    c = (rng.standard_normal((500, 20)) * np.linspace(0.2, 1.5, 20)) @ np.linalg.qr(rng.standard_normal((20, 20)))[0] + 3
    c[:150] = c[0]  # one vector holds a third of the rows
    good = [(i if i != 4 else None, v.astype("f4").tolist()) for i, v in enumerate(c)] + [(7, c[9].astype("f4").tolist())]
    bad = [(900, None), (901, [float("nan")] * 20), (902, [None] + [1.0] * 19), (903, [float("inf")] + [1.0] * 19), (904, []), (905, [1.0] * 3), (906, [3e38] * 20)]
    spark.createDataFrame([(i, v, 1, 2, "n") for i, v in good + bad], "vec_id long, embedding array<float>, label int, component int, key string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = whitening.op13_embedding_whitening(spark, str(tmp_path))
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = found.toPandas()
    x = np.floor(1024 * np.array([v for _, v in good]).astype("f4").astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), values / np.trace(covariance), rtol=1e-10)
    wide = got.assign(at=np.arange(len(got)) // 8).pivot(index="at", columns="component", values="whitened").to_numpy()
    expected = centred @ vectors / np.sqrt(values)
    signs = np.sign((wide[np.argsort(np.abs(wide[:, 0]))[-1]] * expected[np.argsort(np.abs(expected[:, 0]))[-1]]))
    assert np.allclose(np.sort(wide * signs, axis=0), np.sort(expected, axis=0), atol=1e-9)
    deviation = Counter(((n * x - sums) ** 2).sum(axis=1).tolist())
    assert Counter(got[got.component == 1].deviation.tolist()) == deviation and got.vec_id.isna().sum() == 8


@pytest.mark.parametrize("rows, components", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]], 1), ([[float(i), float(i * i % 7)] for i in range(9)], 2)])
def test_whitening_of_few_dimensions(spark, rows, components):
    got = whitening.whiten(spark, spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == components * len(rows) and {r["component"] for r in got} == set(range(1, components + 1))
    for k in range(1, components + 1):
        z = np.array([r["whitened"] for r in got if r["component"] == k])
        assert abs(z.mean()) < 1e-9 and abs((z**2).mean() - 1) < 1e-9


@pytest.mark.parametrize("size, gap", [(3, 0.5), (24, 0.3), (300, 0.02)])
def test_lobpcg_certifies_residuals(size, gap):
    rng = np.random.default_rng(size)
    axes = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = np.exp(-gap * np.arange(size))
    operator = (axes * values) @ axes.T
    got, vectors, worst = whitening.lobpcg(lambda block: operator @ block, size)
    assert np.allclose(got, values[: len(got)], rtol=1e-9) and worst <= whitening.ROUNDED
    assert np.linalg.norm(operator @ vectors - vectors * got, axis=0).max() <= 2 * max(worst, 1e-15)
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-12)
    repeated, _, _ = whitening.lobpcg(lambda block: block * np.repeat([2.0, 1.0], [size - 1, 1])[:, None], size)
    assert np.allclose(repeated[: size - 1], 2.0)


def test_deviations_beyond_64_bits_stay_exact():
    x, n, sums = np.array([[30_000, -1], [1, 2]]), 7_000_000_000, [5, -(10**18)]
    assert whitening.deviations(np.array([[3, 4]]), 2, [5, 7]).to_pylist() == [2]
    assert [int(v) for v in whitening.deviations(x, n, sums).to_pylist()] == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]

"""Legacy archives, fill-in-middle cuts and centroid clustering against plain Python."""

import gzip
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_compare import compare
from quarry.llm import simplex, warc, wavelet
from quarry.llm.queries import ORACLES, QUERIES

TEXTS = ["", "\n", "a", "a\nb", "a\nb\n", "\n\n\n", "x. y! z\n? é😀 　w\n" * 9, "no end " * 300 + "\n" + "z" * 200,
         "".join("ab \n."[(i * i + i // 7) % 5] for i in range(1_500))]
UNIT_PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^\s]*\s|[^\s]+", "sentences": r"[^\n.!?…。！？]*[\n.!?…。！？]|[^\n.!?…。！？]+"}


def duck_of(folder):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["op11_warc", "op12_fim"])
def test_equals_sql_on_odd_rows(spark, odd_dir, name):
    result = compare(spark, duck_of(odd_dir), name, QUERIES[name], ORACLES[name], odd_dir)
    assert result["ok"], result


@pytest.mark.parametrize("text", TEXTS)
def test_rank_and_select(text):
    found = wavelet.classes(text)
    matrix = wavelet.WaveletMatrix(found)
    for symbol in range(4):
        places = np.flatnonzero(found == symbol)
        assert [matrix.rank(symbol, i) for i in range(len(found) + 1)] == [int((places < i).sum()) for i in range(len(found) + 1)]
        assert [matrix.select(symbol, k + 1) for k in range(len(places))] == places.tolist()


@pytest.mark.parametrize("unit", sorted(UNIT_PATTERNS))
def test_units_are_those_of_the_pattern(unit):
    for text in TEXTS:
        pieces = re.findall(UNIT_PATTERNS[unit], text)
        units = wavelet.Units(text, unit)
        assert units.count == len(pieces)
        assert [units.end_of(k) for k in range(units.count + 1)] == [len("".join(pieces[:k])) for k in range(len(pieces) + 1)]


def test_fill_in_middle_against_slices(spark):
    texts = [*TEXTS, "has a <M> mark\nand more\n", None]
    docs = spark.createDataFrame([(k % 11, t) for k, t in enumerate(texts * 3)], "doc_id long, text string")
    made = wavelet.fill_in_middle(docs.withColumn("output", F.lit(3)).withColumn("n", F.lit("x")), rate=80, spm=40)
    rows = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output",
                       wavelet.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(rows) == 3 * len(texts)
    for r in rows:
        text = r["text"] or ""
        h = [int(hashlib.sha256(f"7:{r['doc_id']}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
        lines = re.findall(UNIT_PATTERNS["lines"], text)
        a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        form = "plain" if not text or "<M>" in text or h[2] % 100 >= 80 else "spm" if h[3] % 100 < 40 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["output"], r["back"]) == (len(lines), form, want, text)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))


def brute_clusters(rows, k=40, rounds=5, seed=2, size=64, limit=1 << 27):
    """vec_id, cluster, distance of every vector, by Python integers alone."""
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == size and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((key, [int(np.floor(min(max(256.0 * x, -limit), limit))) for x in vector]))
    hashed = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in set(of):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted(((i is not None, i or 0), *nearest(v)[::-1]) for i, v in kept), centroids


def clusters_of(spark, rows, **kwargs):
    out = simplex.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int, apex string, cluster string"), **kwargs)
    return out.collect()


@pytest.mark.parametrize("case", ["spread", "hot", "few", "line", "far", "same"])
def test_clusters_against_integers(spark, case):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(150, 64)) * rng.choice([0.1, 1, 3], size=(150, 1))
    if case == "hot":
        data[50:130] = data[0]
    if case == "few":
        data = data[:5]
    if case == "line":
        data = np.outer(rng.integers(-40, 40, 150), np.ones(64)) / 8
    if case == "far":
        data[::3] *= 1e5
        data[5] = 1e30
        data[7] = -1e30
    if case == "same":
        data[:] = data[0]
    rows = [(None if k == 9 else k % 120, x.tolist(), 1, "a", "b") for k, x in enumerate(data)]
    rows += [(500, None, 1, "a", "b"), (501, [1.0] * 63, 1, "a", "b"), (502, [float("nan")] * 64, 1, "a", "b"),
             (503, [None] + [1.0] * 63, 1, "a", "b"), (504, [float("-inf")] * 64, 1, "a", "b"), (505, [], 1, "a", "b")]
    got = clusters_of(spark, rows)
    want, centroids = brute_clusters([r[:2] for r in rows])
    assert sorted(((r["vec_id"] is not None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in got) == want
    assert {r["inertia"] for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_bounds_hold_the_distance_and_filter():
    rng = np.random.default_rng(5)
    middles = rng.integers(-200, 200, (12, 64))
    vectors = middles[rng.integers(0, 12, 400)] + rng.integers(-20, 20, (400, 64))
    found = simplex.build_simplex(vectors[:40])
    x = found.apexes(simplex.squared_distances(vectors, found.pivots))
    real = np.sqrt(simplex.squared_distances(vectors, vectors[:40]).astype(float))
    flat, height = x[:, None, :-1] - x[None, :40, :-1], x[:, None, -1]
    low = np.sqrt((flat**2).sum(2) + (height - x[None, :40, -1]) ** 2)
    high = np.sqrt((flat**2).sum(2) + (height + x[None, :40, -1]) ** 2)
    assert (low <= real + 1e-3).all() and (real <= high + 1e-3).all()
    possible = simplex.placed(found, middles).possible(x)
    assert possible.sum() < 0.3 * possible.size  # the bounds leave few centroids to compare


def arc_file(version, records):
    """An ARC file by hand: (url, date, mime, block)."""
    about = f"{version} 0 x\n{warc.ARC_FIELDS[version]}\n\n"
    more = " 200 - - 0 x" if version == 2 else ""
    out = f"filedesc://x.arc 0.0.0.0 20010203 text/plain{more} {len(about)}\n{about}".encode()
    for url, date, mime, block in records:
        out += f"{url} 1.2.3.4 {date} {mime}{more} {len(block)}\n".encode() + block + b"\n"
    return out


BODY = b"<p>" + b"x" * 200 + b"\r\n\r\nWARC/1.1\r\n\n"
RECORDS = [("http://a/", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\n" + BODY),
           ("http://a/b c", "2001020304", "text/html", b"HTTP/1.0 200 OK\n\n" + BODY),
           ("dns:a", "never", "text/dns", b"a IN A 1.2.3.4"),
           ("http://e/", "20010203040506", "text/html", b"")]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_declared_length(version):
    data = arc_file(version, RECORDS)
    got = list(warc.parse_arc(data))
    assert got[0].url == "filedesc://x.arc" and not got[0].truncated
    assert [(r.url, r.date, r.mime, r.block) for r in got[1:]] == RECORDS
    assert all(data[r.offset:].startswith(r.url.encode()) for r in got)
    cut = list(warc.parse_arc(data[:-30] if version == 1 else data[:len(data) - 60]))
    assert sum(r.truncated for r in cut) <= 1
    noisy = data + b"\nnot a header line\n" + f"http://z/ 1.2.3.4 20010203 text/html{' 200 - - 0 x' if version == 2 else ''} 2\nhi\n".encode()
    assert list(warc.parse_arc(noisy))[-1].block == b"hi"
    short = f"http://z/ 1.2.3.4 20010203 text/html{' 200 - - 0 x' if version == 2 else ''} 99\nhi".encode()
    assert list(warc.parse_arc(data + short))[-1].truncated


def test_conversion_by_hand():
    records = list(warc.parse_arc(arc_file(2, RECORDS)))
    data = b"\r\n\r\n".join(warc.converted(r, "x", ("<urn:uuid:1>", "http://a/", "2001-02-03T04:05:06Z") if k == 2 else None)
                            for k, r in enumerate(records)) + b"\r\n\r\n"
    got = list(warc.parse_warc(data))
    assert [r.headers["warc-type"] for r in got] == ["warcinfo", "response", "revisit", "resource", "resource"]
    assert got[1].block == RECORDS[0][3] and got[2].block == b"HTTP/1.0 200 OK\n\n"
    assert got[1].headers["warc-payload-digest"] == got[2].headers["warc-payload-digest"] == f"sha256:{hashlib.sha256(BODY).hexdigest()}"
    assert [r.headers["warc-date"] for r in got] == ["2001-02-03T00:00:00Z", "2001-02-03T04:05:06Z", "2001-02-03T04:00:00Z",
                                                     "1970-01-01T00:00:00Z", "2001-02-03T04:05:06Z"]
    assert got[1].headers["warc-ip-address"] == "1.2.3.4" and got[2].headers["warc-refers-to"] == "<urn:uuid:1>"
    assert len({r.headers["warc-record-id"] for r in got}) == 5
    assert got[3].headers["content-type"] == "text/dns"


def test_foreign_archives_and_small_archives(spark, tmp_path):
    """Plain and gzipped archives of others convert too; pages over the archive size have one of their own."""
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc").write_bytes(arc_file(1, RECORDS))
    (tmp_path / "arc" / "b.arc.gz").write_bytes(gzip.compress(arc_file(2, RECORDS[:1])) + gzip.compress(b""))
    files = warc.read_archives(spark, str(tmp_path / "arc"))
    warc.convert(files, str(tmp_path / "warc"))
    out = warc.read_warc(warc.read_archives(spark, str(tmp_path / "warc")), with_payload=True).collect()
    assert sorted(r["type"] for r in out) == ["resource", "resource", "response", "revisit", "revisit"]
    assert all(r["intact"] for r in out)
    assert [bytes(r["payload"]) for r in out if r["type"] == "response"] == [BODY]
    pages = spark.createDataFrame([(k, f"http://h/{k}", "é" * 3_000 + str(k % 3)) for k in range(12)], "page_id long, url string, html string")
    warc.write_arc(pages.coalesce(2), str(tmp_path / "small"), archive_bytes=10_000)
    small = warc.read_archives(spark, str(tmp_path / "small"))
    assert small.count() == 6
    assert sorted(r["key"] for r in warc.arc_responses(small).collect()) == list(range(12))


def test_pages_of_a_hot_payload(spark, monkeypatch):
    """A third of the rows share a payload; others come in pairs, and both ways of the join are taken."""
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    html = ["hot" * 50 if k % 3 == 0 else f"pair {k // 6} " * 20 if k % 3 == 1 else "short" for k in range(300)]
    pages = spark.createDataFrame([(300 - k, None if k % 7 == 0 else f"http://h/ {k}\n", t, "x", 1) for k, t in enumerate(html)],
                                  "page_id long, url string, html string, id string, size int")
    got = {r["page_id"]: r for r in warc.archive_pages(pages).collect()}
    first = {}
    for key, t in sorted((300 - k, t) for k, t in enumerate(html)):
        lead = first.setdefault(t, key)
        kind, refers = ("revisit", lead) if lead != key and len(t) >= 100 else ("response", None)
        r = got.pop(key)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (
            len(t), hashlib.sha256(t.encode()).hexdigest(), kind, refers)
    assert not got


def test_vectors_query_on_odd_rows(spark, odd_dir):
    assert QUERIES["op13_simplex"](spark, odd_dir).count() == 0  # none has 64 components

"""Each operator against a plain version, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from compare import differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slate.llm import ann_graph, bpe, cdc, common, kd_shards, langid, license_scan, metric_join, minhash_forest, mixing, queries, url_rules

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


LONG = " ".join(f"w{k}" for k in range(30_000))
EDGE = [(1, None), (2, ""), (3, "one"), (4, "One"), (5, LONG), (6, LONG), (None, "alone text here"), (7, " \t\n"), (8, "é漢😀 ünï"), (8, "é漢😀 ünï")]


# --- near-duplicates ---


def plain_components(texts, width, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_equals_brute_force(spark, docs, width):
    out = minhash_forest.near_duplicates(docs, width, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == plain_components(texts_of(docs), width, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_minhash_edges(spark):
    out = minhash_forest.near_duplicates(table(spark, EDGE).withColumn("component_id", F.lit(0)), 2).collect()
    assert len(out) == len(EDGE)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[4] == (1, 3, False) and got[6][1:] == (5, False) and got[None][1:] == (None, True)
    assert minhash_forest.near_duplicates(table(spark, []).limit(0), 2).count() == 0


def test_minhash_of_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c = passages(rng, 3)
    out = minhash_forest.near_duplicates(table(spark, [(3, a), (5, a), (5, b), (7, b + " end"), (8, c), (9, c)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8), (9, 8)]


def test_minhash_of_a_crowded_region(spark):
    """Many documents that share two thirds of their shingles, so all regions are crowded, and a few pairs at the threshold."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7))
    common = [word() for _ in range(200)]
    texts = {i: " ".join(common[:150] + [word() for _ in range(25)] + common[150:]) for i in range(600)}
    for i in range(0, 600, 40):  # 20 words of these 200 are exchanged
        w = texts[i].split()
        texts[1000 + i] = " ".join(w[:155] + [word() for _ in range(10)] + w[165:])
    out = minhash_forest.near_duplicates(table(spark, list(texts.items())), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == plain_components(texts, 2, 80)


def test_forest_and_graph_equal_sql(spark):
    assert differences(spark, SF, queries.op8_minhash_forest, queries.FOREST_SQL) is None
    assert differences(spark, SF, queries.op1_ann_graph, queries.GRAPH_SQL) is None


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(200, 201), (201, 202)], "a long, b long")
    assert {r.node: r.component for r in common.components(edges).collect()} == {k: 0 for k in range(n + 1)} | {200: 200, 201: 200, 202: 200}
    assert common.components(edges.limit(0)).count() == 0


# --- vectors ---


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


ODD = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [1.0, None], 0), (7, [0.0, 1.0], 1), (8, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (100, [float("inf"), 0.0], 1), (150, [], 1)]


def test_metric_join(spark):
    assert differences(spark, SF, queries.op9_metric_join, queries.VECTOR_SQL) is None
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_duplicates(vectors(spark, ODD)).collect()}
    assert got[8] == (3, 1, False) and got[2] == (3, 1, False) and got[7] == (0, 7, True)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 100, 150))
    assert metric_join.near_duplicates(vectors(spark, ODD).limit(0)).count() == 0


def test_metric_join_small_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 500)] + rng.normal(scale=0.2, size=(500, 8))
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    links = ((y @ y.T) >= 0.9).sum(1) - 1
    out = metric_join.near_duplicates(df, 0.9, cell=32).collect()
    assert {r.vec_id: r.n_links for r in out} == dict(enumerate(links.tolist()))


def shuffled(spark):
    """Bytes that each stage known to the session has written for shuffles."""
    context, java = spark.sparkContext, spark.sparkContext._gateway
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, java.new_array(java.jvm.double, 0), java.jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}


def test_metric_join_copies_nothing_to_disk(spark):
    x = np.random.default_rng(8).normal(size=(3000, 16)).astype(np.float32)
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    before = shuffled(spark)
    out = {r.vec_id: r.n_links for r in metric_join.near_duplicates(df, 0.9, cell=32).collect()}
    written = sum(size for stage, size in shuffled(spark).items() if stage > max(before, default=-1))
    assert written < 4 * x.size * 8  # whatever the number of blocks, some hundred here
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    assert out == dict(enumerate((((y @ y.T) >= 0.9).sum(1) - 1).tolist()))


def test_metric_join_several_jobs(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "JOB_PARTS", 3)
    test_metric_join_small_cells(spark)


def test_metric_join_limit_and_groups(spark):
    """Links a billionth beside the limit, doubles and floats in one table, groups of near copies over many blocks, repeated vectors."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 32))
    x[1::2][:300] = x[0] + rng.normal(scale=0.05, size=(300, 32))
    x[800:1000] = x[800:1000].astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(1000, 1400, 2):  # alternately just linked and just not
        z = x[k + 1] - (x[k + 1] @ x[k]) * x[k]
        c = 0.9 + (1e-9 if k % 4 else -1e-9)
        x[k + 1] = c * x[k] + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
    x[1400:] = x[1000:1100]
    mask = np.array([[sum((a * b).tolist()) for b in x[1000:]] for a in x[1000:]]) >= 0.9
    whole = (x @ x.T) >= 0.9
    whole[1000:, 1000:] = mask
    np.fill_diagonal(whole, True)
    component = np.arange(len(x))
    while ((new := np.where(whole, component, len(x)).min(axis=1)) != component).any():
        component = new
    assert mask[0, 1] != mask[2, 3] and (component == 0).sum() > 300
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    for cell in (16, 200, 4096):
        out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_duplicates(df, 0.9, cell=cell).collect()}
        assert out == {i: (int(whole[i].sum()) - 1, int(c), i == c) for i, c in enumerate(component)}


def test_graph_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:200] = x[50]
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    out = ann_graph.search(df, F.col("vec_id") % 50 == 0, 5, shard=700).collect()
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hits, by = 0, collections.defaultdict(list)
    for r in out:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 3000, 50):
        s = y @ y[q]
        s[q] = -2
        best = np.lexsort((np.arange(3000), -s.round(12)))[:5]
        got = sorted(by[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(abs(s[g[1]] - g[2]) < 1e-9 for g in got)
        hits += len({g[1] for g in got} & set(best.tolist()))
    assert hits / 300 >= 0.95
    assert [g[1] for g in sorted(by[50])] == [100, 101, 102, 103, 104]


def test_graph_search_edges(spark):
    out = [tuple(r) for r in ann_graph.search(vectors(spark, ODD), F.col("vec_id") % 50 == 0).collect()]
    assert [r[:3] for r in sorted(out)] == [(50, 1, 1), (50, 2, 2), (50, 3, 8), (50, 4, 7)]
    assert ann_graph.search(vectors(spark, ODD).limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- URLs ---


def test_urls(spark):
    assert differences(spark, SF, queries.op4_url_rules, queries.URL_SQL) is None
    rows = [(1, None), (2, "no scheme"), (3, "http://A.EXAMPLE.com/en/7x?q"), (4, "http://notexample.com/en/7"), (5, "http://example.net"), (6, "http://xcom/en/"), (7, "https://com/en/é"), (8, "http://h.org/EN/?casino"), (9, "http://a.b/casino/x"), (9, "http://a.b/casino/x"), (10, "")]
    pages = spark.createDataFrame([(i, u, "", "clash") for i, u in rows], "page_id long, url string, html string, host string")
    out = sorted((tuple(r) for r in url_rules.judge(pages, queries.URL_RULES).collect()), key=str)
    got = {r[0]: r[1:] for r in out}
    assert len(out) == 11 and got[1] == got[2] == got[10] == ("", "", None, "allow", None)
    assert got[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow", None) and got[4][2:4] == ("com/en/", "block")
    assert got[5] == ("example.net", "", None, "allow", None) and got[6][2] is None and got[7][2] == "com/en/" and got[9][3:] == ("block", "casino")
    assert url_rules.judge(pages.limit(0), queries.URL_RULES).count() == 0
    with pytest.raises(ValueError, match="no literal"):
        url_rules.judge(pages, [url_rules.Rule("digits", "block", r"\d{6}")])


def test_urls_equal_brute_force(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    shapes = [r"pills?[./-]", r"/en/\d*7(?:[./]|$)", r"(?:spam|ads)-(?:farm|track)\.", r"(?i)EXAMPLE\.org/(?:de|es)/[0-9]+", r"thth|ther\w+\.net", r"^www\.(?:\w+\.)?example", r"/(?:fr|en)/[13579]+\.html$"]
    rules = [url_rules.Rule(f"shape{k}", "block" if k % 2 else "allow", p) for k, p in enumerate(shapes)]
    urls = {}
    for r in pages.collect():
        rest = (r.url or "").partition("://")[2]
        host, path = re.match("([^/?#]*)([^?#]*)", rest).groups()
        urls[r.page_id] = re.sub("[A-Z]", lambda m: m[0].lower(), host) + path
    expected = {i: next((r.name for r in rules if re.search(r.pattern, u)), None) for i, u in urls.items()}
    assert len(set(expected.values())) > 4
    for most in (64, 2):  # the index in the plan, and as a table
        monkeypatch.setattr(url_rules, "IN_PLAN", most)
        assert {r.page_id: r.rule for r in url_rules.judge(pages, rules).collect()} == expected
        assert differences(spark, SF, queries.op4_url_rules, queries.URL_SQL) is None
    many = [url_rules.Rule(f"h{k}.example.com/en/", "block") for k in range(3000)]
    got = url_rules.judge(spark.createDataFrame([(1, "http://h2999.example.com/en/x"), (2, "http://h2999.example.com/")], "page_id long, url string"), many).collect()
    assert {r.page_id: r.rule for r in got} == {1: "h2999.example.com/en/", 2: None}


# --- shards ---


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_shards(spark, docs, shards):
    texts, out = texts_of(docs), kd_shards.shard(docs, shards).collect()
    by = collections.defaultdict(list)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by[r.shard].append(r)
    assert set(by) == set(range(shards)) and len(out) == len(texts)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in out) * np.ceil(np.log2(max(shards, 2)))


def test_shards_edges(spark):
    out = kd_shards.shard(table(spark, EDGE).withColumn("shard", F.lit("clash")), 4).collect()
    assert len(out) == len(EDGE) and {r.size for r in out if r.doc_id in (1, 2)} == {1}
    same = kd_shards.shard(table(spark, [(k, "same text") for k in range(80)]), 8).collect()
    assert sorted(collections.Counter(r.shard for r in same).values()) == [10] * 8
    assert kd_shards.shard(table(spark, EDGE).limit(0), 4).count() == 0
    assert len({r.shard for r in kd_shards.shard(table(spark, EDGE), None, target_bytes=200_000).collect()}) == 2
    few = kd_shards.shard(table(spark, [(1, "x" * 900), (2, "y")]), 8).collect()
    assert len(few) == 2 and len({r.shard for r in few}) == 2
    twice = kd_shards.shard(table(spark, [(1, "one row")] * 64), 8).collect()
    assert sorted(collections.Counter(r.shard for r in twice).values()) == [8] * 8


def test_shards_are_weighted_medians(spark, docs):
    rows = [(r.doc_id, r.text.encode(), r.n_chars, r.lang) for r in docs.collect()]
    number = lambda lang: int.from_bytes(lang.encode()[:6].ljust(6, b"\0")) + 1
    table_ = [{"id": i, "size": len(t) + 1, "crc": zlib.crc32(t), "dims": (n, number(lang), len(t) + 1)} for i, t, n, lang in rows]
    span = lambda part, d: max(r["dims"][d] for r in part) - min(r["dims"][d] for r in part)
    whole = [span(table_, d) for d in range(3)]

    def split(part, leaf, n):
        if n == 1 or not part:
            return {r["id"]: leaf for r in part}
        widest = max(range(3), key=lambda d: (span(part, d) / whole[d], -d))
        part = sorted(part, key=lambda r: (r["dims"][widest], r["crc"], r["id"]))
        total = sum(r["size"] for r in part)
        ends = np.cumsum([r["size"] for r in part])
        off = [abs(e - total * (n // 2) / n) + (kd_shards.SLACK * total if k + 1 < len(part) and part[k]["crc"] == part[k + 1]["crc"] else 0) for k, e in enumerate(ends)]
        cut = int(np.argmin(off)) + 1
        return split(part[:cut], leaf, n // 2) | split(part[cut:], leaf + n // 2, n - n // 2)

    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one range a leaf, as in the plain version
    try:
        for n in (2, 8, 11):
            assert {r.doc_id: r.shard for r in kd_shards.shard(docs, n).collect()} == split(table_, 0, n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_many_shards(spark, docs):
    out = kd_shards.shard(docs, 512).collect()
    assert len(out) == docs.count() and len({r.shard for r in out}) > 150 and max(r.shard for r in out) < 512


# --- licences ---


def plain_labels(text):
    """Labels by going through all places of all phrases."""
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    w, labels = word(text), set()
    for t in (*license_scan.BASE, *license_scan.OWN):
        own, after, places = word(t.text), 0, []
        for key in map(word, t.keys):
            at = next(k for k in range(after, len(own)) if own[k : k + len(key)] == key)
            places.append((at, key))
            after = at + len(key)
        found = [[k for k in range(len(w) - len(key) + 1) if w[k : k + len(key)] == key] for _, key in places]
        for start in found[0] if all(found) else ():
            starts = [start]
            for (at, _), f in zip(places[1:], found[1:], strict=True):
                starts.append(min(f, key=lambda k, at=at: (abs(k - start - at + places[0][0]), k)))
            near = all(abs(s - start - at + places[0][0]) <= license_scan.SLACK for s, (at, _) in zip(starts, places, strict=True))
            if near and starts == sorted(set(starts)):
                by = [max([0, *(j for j, (at, _) in enumerate(places) if at <= k)]) for k in range(len(own))]
                spots = [starts[by[k]] + k - places[by[k]][0] for k in range(len(own))]
                share, begin = np.mean([0 <= s < len(w) and w[s] == o for s, o in zip(spots, own, strict=True)]), start - places[0][0]
                if share < license_scan.COVER and len(own) > license_scan.SLACK:
                    window = w[max(0, begin - license_scan.SLACK) : begin + len(own) + license_scan.SLACK]
                    row = [0] * (len(window) + 1)
                    for o in own:
                        last, row = row, [0]
                        for j, x in enumerate(window):
                            row.append(last[j] + 1 if x == o else max(last[j + 1], row[j]))
                    share = row[-1] / len(own)
                if share >= license_scan.COVER:
                    labels.add(t.label)
    return labels


def test_licence_texts(spark):
    rng = random.Random(11)
    filler = lambda n: " ".join(rng.choice(["and", "software", "the", "license", "copy", "river", "use"]) for _ in range(n))
    texts, wanted = {}, {}
    for k, t in enumerate(license_scan.OWN):
        texts[k], wanted[k] = f"{filler(30)}\n{t.text.replace('HOLDER ', 'HOLDER, SOME COMPANY OF TWO ')}\n{filler(30)}", t.label
    first = {k: t.text[: len(t.text) // 3] for k, t in enumerate(license_scan.OWN) if len(t.keys) == 3}
    out = {r.doc_id: r for r in license_scan.scan(table(spark, [*texts.items(), *((100 + k, x) for k, x in first.items())])).collect()}
    assert all(wanted[k] in out[k].labels.split(",") and out[k].score >= license_scan.COVER for k in texts)
    assert {i: r.labels for i, r in out.items()} == {i: ",".join(sorted(plain_labels(t))) for i, t in [*texts.items(), *((100 + k, x) for k, x in first.items())]}


def test_licences(spark, docs):
    texts = texts_of(docs) | {-1: "CC BY cc\nby, All  rights-reserved! É", -2: "cc byé", -3: "by cc general public\n\nlicense"}
    out = license_scan.scan(table(spark, list(texts.items()))).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in out:
        w, starts, labels = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id])), [], set()
        for t in license_scan.BASE:
            p = t.text.split()
            found = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            starts += found
            labels |= {t.label} if found else set()
        assert tuple(r)[1:6] == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and (r.score > 0) == bool(r.labels)
    expected = {i: plain_labels(t) for i, t in texts.items()}
    assert {r.doc_id: r.labels for r in out} == {i: ",".join(sorted(x)) for i, x in expected.items()} and len(set().union(*expected.values())) > 4
    sql = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+|[^\x00-\x7F]+') AS w FROM '{}')
    SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'cc' AND w[i + 1] = 'by')) + len(list_filter(range(1, len(w) - 1), lambda i: (w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') OR (w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved'))) FROM w"""
    assert dict(duckdb.sql(sql.format(f"{SF}/documents.parquet")).fetchall()) == {r.doc_id: r.n_base for r in out if r.doc_id >= 0}
    mit = table(spark, [(1, "x Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (2, "hereby granted free of charge permission is")])
    assert [r.labels for r in license_scan.scan(mit).orderBy("doc_id").collect()] == ["mit", ""]


def test_licences_edges(spark):
    out = license_scan.scan(table(spark, EDGE)).collect()
    assert len(out) == len(EDGE) and {(r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in out if r.doc_id in (1, 2, 7)} == {(0, 0, None, "", 0.0)}
    assert license_scan.scan(table(spark, EDGE).limit(0)).count() == 0


# --- BPE ---


@pytest.fixture(scope="session")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, encoding):
    texts = texts_of(docs) | {-1: "a" * 5000 + LONG, -2: "<|endoftext|> \n\n  x"}
    for r in bpe.encode(table(spark, list(texts.items())), RANKS, P.PATTERN, with_ids=True).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    out = {r.doc_id: r for r in bpe.encode(table(spark, EDGE), RANKS, P.PATTERN).collect()}
    assert out[1] .n_tokens == 0 and out[1].ids_sha256 == hashlib.sha256(b"").hexdigest() == out[2].decoded_sha256
    assert bpe.encode(table(spark, EDGE).limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabtheing é漢😀'\n\t s19!"), max_size=80))
def test_bpe_any_text(encoding, text):
    own = bpe.codec(RANKS, P.PATTERN)
    own.known.clear(), own.older.clear()
    assert own.encode(text) == encoding.encode_ordinary(text)
    own.known.clear(), own.older.clear()
    own.learn(set(own.split.findall(text)))
    assert own.encode(text) == encoding.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()


# --- languages ---


def test_languages(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = langid.identify(docs).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97 and all(0 <= r.score <= 1 for r in out)
    model = langid.learn(docs, ~langid.held_out(F.col("doc_id")))
    texts = texts_of(docs)
    one = {lang: next(texts[i] for i in sorted(truth) if truth[i] == lang and len(texts[i]) > 1500)[:1500] for lang in ("en", "de")}
    mixed = langid.predict(table(spark, [*EDGE, (90, one["en"] + " " + one["de"]), (91, "123 !?")]), model).collect()
    got = {r.doc_id: r for r in mixed}
    assert set(got[90].languages) == {"de", "en"} and got[91].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and len(mixed) == 12
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.accepted(table(spark, EDGE))
    assert kept.columns == docs.columns
    assert langid.accepted(docs).count() == docs.count()


def test_language_sets_equal_brute_force(spark, docs):
    names, table_ = langid.learn(docs, ~langid.held_out(F.col("doc_id")))
    texts = [t[:1200] for i, t in sorted(texts_of(docs).items()) if len(t) > 200][:60]
    texts += [a[:500] + " " + b[:400] for a, b in zip(texts[::2], texts[1::2], strict=False)]
    counts, like = np.stack([langid.trigrams(t.encode()) for t in texts]).astype(float), table_.astype(float)
    got = langid.mixtures(counts, like.astype(np.float32))
    best = np.full(len(texts), -np.inf)
    sets, shares = [None] * len(texts), [None] * len(texts)
    for size in range(1, len(names) + 1):
        for own in itertools.combinations(range(len(names)), size):
            share = np.zeros((len(texts), len(names)))
            share[:, own] = 1 / size
            share, fit = langid._em(counts, like, share, 300)
            fit = fit - langid.PENALTY * np.log(np.maximum(counts.sum(1), 2)) * size
            for i in np.flatnonzero(fit > best + 1e-6):
                best[i], sets[i], shares[i] = fit[i], set(own), share[i]
    assert np.mean([set(np.flatnonzero(g)) == s for g, s in zip(got, sets, strict=True)]) >= 0.97
    assert np.mean([g.argmax() == s.argmax() for g, s in zip(got, shares, strict=True)]) >= 0.98 and len({len(s) for s in sets}) > 1


def test_many_languages(spark):
    rng = random.Random(3)
    letters = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for _ in range(240)]
    rows = [(k, " ".join("".join(rng.choice(letters[k % 240]) for _ in range(6)) for _ in range(150)), f"l{k % 240}", "s", 0) for k in range(960)]
    df = spark.createDataFrame(rows, DOCS)
    out = langid.identify(df).collect()
    assert len({r.lang_pred for r in out}) > 230 and np.mean([r.lang_pred == f"l{r.doc_id % 240}" for r in out if r.held_out]) > 0.9


# --- mixing ---


def test_mixing_equals_brute_force(spark, docs):
    out = queries.op3_mixing(spark, SF).collect()
    p, n, rate = (np.array([r[c] for r in out], float) for c in ("posterior", "n_tokens", "rate"))
    for targets in ([0.8, 0.15, 0.05], [0.98, 0.01, 0.01], [0.0, 0.0, 1.0]):
        soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
        residuals, off = mixing.fit_rates(soft, np.array(targets))
        ours, _ = mixing.replay(p, residuals)
        plain, total = np.ones(len(n)), n.sum()
        weigh = np.linalg.pinv((p * n[:, None]).T @ p / total)
        cost = lambda r: (lambda d: d @ weigh @ d)((r * n) @ p / total - targets)
        for _ in range(4000):
            plain = np.maximum(0, plain - 0.5 * p @ (weigh @ ((plain * n) @ p / total - targets)))
        assert cost(ours) <= cost(plain) + 1e-4 and (ours >= 0).all()
        assert off <= mixing.CLOSE or cost(plain) > 1e-6


def test_mixing(spark, docs):
    out = queries.op3_mixing(spark, SF).collect()
    p, n, rate = (np.array([r[c] for r in out]) for c in ("posterior", "n_tokens", "rate"))
    reached = (n * rate) @ p / n.sum()
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1) and len(out) == docs.count()
    assert np.abs(reached - [queries.MIX_TARGETS[k] for k in ("good", "plain", "toxic")]).max() <= 1e-3
    labels = queries.domains(spark, SF)
    truth = {r.doc_id: r.domain for r in labels.collect()}
    assert np.mean([truth[r.doc_id] == r.domain for r in out if r.doc_id in truth]) >= 0.9
    none = mixing.mix(docs, labels.limit(0), queries.MIX_TARGETS).collect()
    assert {(r.domain, r.rate) for r in none} == {("all", 1.0)}
    assert mixing.mix(docs.limit(0), labels, queries.MIX_TARGETS).count() == 0
    edge = mixing.mix(table(spark, EDGE).withColumn("rate", F.lit("clash")), labels, queries.MIX_TARGETS).collect()
    assert len(edge) == len(EDGE)
    applied = mixing.apply_mix(docs, labels, queries.MIX_TARGETS)
    assert applied.columns == docs.columns
    rates = {r.doc_id: r.rate for r in out}
    for i, times in collections.Counter(r.doc_id for r in applied.select("doc_id").collect()).items():
        assert np.floor(rates[i]) <= times <= np.floor(rates[i]) + 1


def test_mixing_keeps_whole_domains(spark, docs):
    labels = queries.domains(spark, SF)
    out = mixing.mix(docs, labels, queries.MIX_TARGETS, whole=("good", "plain")).collect()
    p, n, rate = (np.array([r[c] for r in out]) for c in ("posterior", "n_tokens", "rate"))
    assert min(r.rate for r in out if r.domain in ("good", "plain")) >= 1
    reached = (n * rate) @ p / (n * rate).sum()
    assert np.abs(reached - [queries.MIX_TARGETS[k] for k in ("good", "plain", "toxic")]).max() <= 1e-3
    applied = texts_of(mixing.apply_mix(docs, labels, queries.MIX_TARGETS, whole=("good", "plain")))
    assert {r.doc_id for r in out if r.domain in ("good", "plain")} <= set(applied)


# --- substring dedup ---


def passages(rng, n, words=60):
    return [" ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(words)) for _ in range(n)]


def test_repeats(spark):
    rng = random.Random(9)
    shared, own = passages(rng, 20), passages(rng, 80, 120)
    texts = {k: own[k] for k in range(80)}
    for k in range(40):
        cut = rng.randint(0, len(own[k]))
        texts[k] = own[k][:cut] + " " + shared[k // 2] + " " + own[k][cut:]
    df = table(spark, list(texts.items()))
    spans = cdc.repeated_spans(df).collect()
    assert {r.doc_id for r in spans} == set(range(40))
    for r in spans:
        piece = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert piece in texts[r.doc_id ^ 1] and r.kept == (r.doc_id % 2 == 0) and r.first_doc_id == r.doc_id & ~1
    left = texts_of(cdc.strip_repeats(df))
    assert all(left[k] == texts[k] for k in [*range(0, 40, 2), *range(40, 80)])
    assert all(len(left[k]) < len(texts[k]) - 150 for k in range(1, 40, 2))


def test_repeats_edges(spark):
    df = table(spark, [*EDGE, (60, "é" * 3000), (61, "é" * 3000), (62, "漢字仮名 " * 200), (63, "漢字仮名 " * 200)]).withColumn("first", F.lit(1))
    spans = cdc.repeated_spans(df).collect()
    assert {5, 6} <= {r.doc_id for r in spans} and 60 in {r.doc_id for r in spans}
    out = cdc.strip_repeats(df).collect()
    ids = [r.doc_id for r in out]
    assert 6 not in ids and 5 in ids and ids.count(8) == 2 and None in ids
    assert cdc.strip_repeats(df.limit(0)).count() == 0


def test_repeats_of_short_words(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts, edges = {}, {}
    for k in range(60):
        shared = " ".join(word(1 + k % 4) for _ in range(51 if k % 3 else 50))
        for i in (2 * k, 2 * k + 1):
            before = " ".join(word(5) for _ in range(rng.randint(1, 40)))
            texts[i] = f"{before} {shared} " + " ".join(word(5) for _ in range(rng.randint(1, 40)))
            edges[i] = (len(before) + 1, len(before) + 1 + len(shared), 2 * k, [2 * k], i % 2 == 0)
    df = table(spark, list(texts.items()))
    assert {r.doc_id: tuple(r)[1:] for r in cdc.repeated_spans(df).collect()} == {i: e for i, e in edges.items() if i // 2 % 3}
    left = texts_of(cdc.strip_repeats(df))
    assert all(left[i] == (texts[i] if kept or i // 2 % 3 == 0 else texts[i][:a] + " " + texts[i][b:]) for i, (a, b, _, _, kept) in edges.items())


def test_repeats_equal_brute_force(spark, docs):
    texts, having, windows = texts_of(docs), collections.defaultdict(set), {}
    for i, t in texts.items():
        w = list(re.finditer(rb"[^\x20\x09-\x0D]+", t.encode()))
        assert max((m.end() - m.start() for m in w), default=0) <= cdc.LONG
        windows[i] = [(w[k].start(), w[k + 50].end(), tuple(m[0] for m in w[k : k + 51])) for k in range(len(w) - 50)]
        for *_, x in windows[i]:
            having[x].add(i)
    expected, got = collections.defaultdict(set), collections.defaultdict(set)
    for i, own in windows.items():
        for a, b, x in own:
            if min(having[x]) < i or len(having[x]) > 1:
                expected[i, min(having[x]) == i] |= set(range(a, b))
    for r in cdc.repeated_spans(docs).collect():
        got[r.doc_id, r.kept] |= set(range(r.start_byte, r.end_byte))
    assert expected and got == expected


def test_repeats_without_spaces(spark):
    rng = random.Random(6)
    signs = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
    shared, texts = signs(51), {}
    for i in (1, 2):
        texts[i] = signs(90) + shared + signs(90)
    texts |= {3: signs(90) + shared[:50] + signs(90), 4: "same id, other text", 5: "p"}
    rows = [*texts.items(), (2, " ".join(f"own{k}" for k in range(200)))]
    spans = cdc.repeated_spans(table(spark, rows)).collect()
    assert [tuple(r) for r in sorted(spans)] == [(1, 270, 423, 1, [1], True), (2, 270, 423, 1, [1], False)]
    left = [r.text for r in cdc.strip_repeats(table(spark, rows)).where("doc_id = 2").collect()]
    assert sorted(left) == sorted([texts[2][:90] + " " + texts[2][141:], rows[-1][1]])


def test_repeats_are_of_one_document(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(6))
    own = [word() for _ in range(300)]
    texts = {k: " ".join([*(word() for _ in range(30)), *own[6 * k : 6 * k + 20], *(word() for _ in range(30))]) for k in range(47)}
    df = table(spark, [*texts.items(), (100, " ".join(own))])  # each 20 words of document 100 in another document
    assert cdc.repeated_spans(df).count() == 0
    assert texts_of(cdc.strip_repeats(df)) == texts | {100: " ".join(own)}


# --- pipeline ---


def test_near_duplicates_of_odd_ids(spark):
    import corpus_pipeline as C

    rng = random.Random(2)
    a, b, c, d = passages(rng, 4)
    rows = [(None, a), (None, a), (None, b), (5, a), (5, b), (5, b), (5, None), (7, a + " more"), (7, c), (9, d), (9, d + " more"), (11, c), (12, "")]
    out = [(r.doc_id, r.text) for r in C.drop_near_duplicates(spark, table(spark, rows), SF).collect()]
    ours = [(i, t) for i, t in out if i != 9]
    assert collections.Counter(ours) == collections.Counter([(None, a), (None, a), (None, b), (5, a), (5, b), (5, None), (7, c), (12, "")])
    assert [t for i, t in out if i == 9] in ([d], [d + " more"])
    single = [(None, a), (1, a), (2, a), (3, b)]
    out = C.drop_near_duplicates(spark, table(spark, single), SF)
    assert out.columns == table(spark, single).columns and collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter([(None, a), (1, a), (3, b)])


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        docs = common.save(stage(spark, docs, SF))
        seen[name] = docs
        assert docs.columns == columns or name == C.STAGES[-1][0]
    names = [n for n, _ in C.STAGES]
    assert seen[names[0]].count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    expected = {i for i, (_, root) in plain_components(texts_of(seen[names[0]]), 5, 80).items() if i == root}
    assert {r.doc_id for r in seen[names[1]].collect()} == expected
    before, after = texts_of(seen[names[1]]), texts_of(seen[names[2]])
    assert all(len(after[i]) <= len(before[i]) for i in after)
    assert seen[names[4]].count() == seen[names[3]].count() == C.run(spark, SF).count()


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert duckdb.sql("SELECT 1").fetchall() == [(1,)]

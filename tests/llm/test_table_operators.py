"""URL verdicts, nearest neighbours, and the pipeline."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrove.llm import ann, queries, url_reputation
from tidegrove.llm.url_reputation import ReputationConfig, judged_sql, reputation_sql


def test_url_verdicts(spark):
    urls = [
        "http://example.com/en/x?y#z", "https://www.EXAMPLE.com/en/", "http://a.www.example.com/en/1", "http://notexample.com/en/", "http://example.com", "http://example.com/",
        "ftp://x.net/es/1", "x.net/es/1", "http://x.net/fr", "http://x.net/fr/", "http://b.org/es/", None, "", "://", "http://://a", "http://É.NET/es/a?://", "http://x.net/de/", "http://co.uk/a", "http://a.b.co.uk/a",
    ]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://x.net/es/", "h"), (3, urls[3], "h")] + [(100 + i, f"http://h{i % 7}.bad.net/{('es', 'fr', 'de')[i % 3]}/{i}", "h") for i in range(60)]
    rows += [(200 + i, u, "h") for i, u in enumerate(["http://user:a@b@h1.bad.net:8080/de/", "http://1.2.3.4:80/es/", "http://1.2.3.4/", "http://[::1]:80/a", "http://[", "http://:80/", "http://co.uk:8080/", "http://@/"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").select("page_id", "url", "host", F.lit("x").alias("rule"))
    got = url_reputation.url_verdicts(pages)
    frame = pages.toArrow()
    cfg = ReputationConfig()
    con = duckdb.connect()
    con.register("pages", frame)
    want = con.sql(reputation_sql(cfg, judged_sql(cfg).replace("{text}", "VARCHAR"))).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want), key=str)
    by = {r.page_id: r for r in got.collect() if r.page_id is not None}
    assert [by[i].rule for i in range(6)] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", None, "com/"]
    assert (by[1].host, by[1].path, by[1].verdict) == ("www.example.com", "/en/", "allow")
    assert (by[6].rule, by[7].host, by[8].rule, by[9].rule, by[11].host, by[11].path) == ("net/es/", "", None, "net/fr/", "", "")
    assert by[15].host == "É.net" and by[10].verdict == "allow"
    assert by[102].rule is None and by[102].verdict == "block"
    assert url_reputation.url_verdicts(pages.limit(0)).count() == 0


def brute(rows, k=5):
    """query row -> ids and cosines of the nearest."""
    ok = [(i, v) for i, v in rows if v and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is None or i % 20:
            continue
        best = []
        for b, (j, w) in enumerate(ok):
            if a != b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                best.append((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), j is None, j or 0))
        for rank, (s, _, j) in enumerate(sorted(best)[:k]):
            out.append((i, rank + 1, j, -s))
    return out


@pytest.mark.parametrize("cell", [16_000, 30])
def test_nearest(spark, cell):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((6, 12))
    rows = [(i, (centers[i % 6] + 0.4 * rng.standard_normal(12)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(40, rows[3][1]), (440, None), (460, []), (480, [0.0] * 12), (500, [1.0, None] + [0.0] * 10), (520, [float("nan")] * 12), (540, [float("inf")] * 12), (560, [1.0, 2.0]), (561, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    cfg = ann.AnnConfig(cell_points=cell, leaf=16, cell_queries=8, confidence=0.999)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, cfg).collect()
    want = brute(rows)
    assert sorted((r.query_id, r["rank"]) for r in got) == sorted(w[:2] for w in want)
    mine, theirs = {(r.query_id, r.vec_id) for r in got}, {(w[0], w[2]) for w in want}
    assert len(mine & theirs) >= 0.97 * len(theirs)
    exact = {(w[0], w[1]): w for w in want if w[0] != 40}
    same = [r for r in got if (r.query_id, r["rank"]) in exact and exact[r.query_id, r["rank"]][2] == r.vec_id]
    assert all(abs(r.score - exact[r.query_id, r["rank"]][3]) < 1e-12 for r in same)
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_recall_and_chi_square():
    assert abs(float(ann.chi_square_cdf(np.array(15.507), 8)) - 0.95) < 1e-4
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-2


def test_recall_on_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op4_nearest"](spark, sf).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    hit = total = 0
    for k, (i, _) in enumerate(rows):
        if i % 50 == 0:
            s = x @ x[k]
            s[k] = -9
            hit += len({rows[j][0] for j in np.argsort(-s)[:5]} & {r.vec_id for r in got if r.query_id == i})
            total += 5
    assert hit >= 0.9 * total


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        assert 0 < docs.count() <= n
        n = docs.count()
        assert k == 4 or (docs.columns == columns and dict(docs.dtypes)["doc_id"] == "bigint")
    got = sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))
    assert got == sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()))


def test_every_query_has_a_schema(spark):
    for name, query in queries.QUERIES.items():
        if name not in ("op1_quality",):
            assert query(spark, "/root/testdata/sf0.001").columns


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    names = list(rel.columns)
    assert cols == sorted(names)
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())


def test_recall_at_the_default_confidence_over_many_cells(spark):
    """Clustered vectors, so that the tree prunes; cells small enough that many are skipped."""
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((40, 32))
    x = (centers[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, ann.AnnConfig(cell_points=200)).collect()
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    mine = {(r.query_id, r.vec_id) for r in got}
    hit = 0
    for i in range(0, 4000, 50):
        s = y @ y[i]
        s[i] = -9
        hit += len({(i, int(j)) for j in np.argsort(-s)[:5]} & mine)
    assert hit >= 0.9 * 400, hit
    print("recall", hit / 400)


def jaccard_classes(rows: list[tuple]) -> list[int]:
    """Of each row the number of its class by a similarity of 0.8 in five-word shingles."""
    sets = []
    for t in rows:
        words = (t[1] or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage on its own input, with nulls, ties, repeated rows, empty texts and clashing names."""
    import random

    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from tidegrove.llm import bpe, decontamination, quality
    from tidegrove.llm.common import table

    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    question = "The train leaves Boston at 15 km per hour and Alice counts 15 red apples while Boston sleeps under 7 blue lamps."
    docs: list[tuple] = []
    for i in range(50):
        docs.append((i, "\n".join(line(rng.randint(12, 40)) for _ in range(rng.randint(1, 4)))))
    docs += [(50 + i, "!!@@## 1%x&& " * rng.randint(5, 40)) for i in range(20)]
    docs += [(80, docs[0][1]), (81, docs[1][1] + " one more word"), (82, f"{line(20)}\n{question}"), (83, question.replace("Boston", "Denver").replace("15", "99")), (84, docs[2][1].split("\n")[0] + "\n" + line(25)), (85, docs[3][1]), (85, docs[4][1]), (85, docs[4][1]), (None, docs[5][1]), (None, line(30)), (86, ""), (87, None), (None, None)]
    rng.shuffle(docs)
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, leaks string, kept string, bucket string, key string, rest string"
    rows = [(i, t, "en", None, None if t is None else len(t), *"abcdefg") for i, t in docs]
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 0 if 50 <= i < 70 else 1) for i in range(80)] + [(None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, question), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    now = table(spark, sf, "documents")
    plain = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    order = lambda some: sorted(some, key=str)
    stages = dict(corpus_pipeline.STAGES)

    model = quality.fit_quality(now, table(spark, sf, "labels"), quality.fold() != 1)
    def score(text):
        x, lead = quality.passages(pa.array([text], pa.string()), 64)
        return model.forward(x, lead)["score"][0]

    want = [(i, t) for i, t in plain(now) if score(t) >= 0.5]
    now = stages["quality"](spark, now, sf).checkpoint()
    assert order(plain(now)) == order(want) and len(want) < len(docs)
    assert now.columns == [c.split()[0] for c in schema.split(", ")]

    before = plain(now)
    lines = [(k, i, n, frozenset(x.encode().lower().split())) for k, (i, t) in enumerate(before) for n, x in enumerate((t or "").split("\n"))]
    gone = {(k, n) for k, i, n, s in lines if i is not None and s and any(j is not None and (j, m) < (i, n) and o and len(s & o) >= 0.8 * len(s | o) for _, j, m, o in lines)}
    want = [(i, "\n".join(x for n, x in enumerate((t or "").split("\n")) if (k, n) not in gone)) for k, (i, t) in enumerate(before)]
    now = stages["line_dedup"](spark, now, sf).checkpoint()
    assert order(plain(now)) == order(want) and gone

    before = plain(now)
    classes = jaccard_classes(before)
    after = plain(stages["near_duplicates"](spark, now, sf))
    for c in set(classes):
        mine = [r for r, k in zip(before, classes) if k == c]
        kept = [r for r in after if r in mine]
        ids = [i for i, _ in mine if i is not None]
        assert len(kept) == 1 and (not ids or kept[0][0] == min(ids)), (mine, kept)
    now = stages["near_duplicates"](spark, now, sf).checkpoint()
    assert len(plain(now)) == len(set(classes)) < len(before)

    bench = decontamination.Bench([(1, question)], decontamination.TemplateConfig())
    want = [(i, t) for i, t in plain(now) if not bench.leaks([t or ""], decontamination.Canon())[0]]
    before = len(plain(now))
    now = stages["decontamination"](spark, now, sf).checkpoint()
    assert order(plain(now)) == order(want) and len(want) < before

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    out = stages["encoding"](spark, now, sf)
    digest = lambda t: hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()
    assert order((r.doc_id, r.ids_sha256) for r in out.collect()) == order((i, digest(t)) for i, t in plain(now))
    whole = corpus_pipeline.run(spark, sf)
    assert order((r.doc_id, r.ids_sha256) for r in whole.collect()) == order((r.doc_id, r.ids_sha256) for r in out.collect())

    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        table(spark, sf, name).limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0

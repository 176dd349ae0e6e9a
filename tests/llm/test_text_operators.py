"""The text operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidegrove.llm import bpe, decontamination, line_dedup, quality, secret_scan, sharding, simhash, substring_dedup
from tidegrove.llm.common import span_hashes, utf8, word_spans

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, leaks string, kept string, bucket string, key string, shard string"


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [line(rng.randint(20, 90)) for _ in range(6)]
    docs: list[tuple[int | None, str | None]] = []
    for i in range(n):
        parts = [line(rng.randint(1, 60)) for _ in range(rng.randint(1, 5))] + rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(parts)
        docs.append((i * 3, "\n".join(parts)))
    for i in range(12):
        words = docs[rng.randrange(n)][1].split(" ")
        words[rng.randrange(len(words))] = "zzz"
        docs.append((500 + i, " ".join(words)))
    docs += [(600, None), (601, ""), (602, " \n\t"), (603, docs[0][1]), (603, docs[0][1]), (604, docs[0][1]), (None, docs[0][1]), (None, None), (605, "x" * 70_000), (606, ("ab " * 9_000).strip())]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "a", "b", "c", "d", "e", "f", "g") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_rule():
    import pyarrow as pa

    texts = ["a b\x1cc\n\nd", "", None, "é f  g ", "\t", "h"]
    raw, off = utf8(pa.array(texts))
    starts, ends, first = word_spans(raw, off)
    got = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got == [w for ws in want for w in ws]
    assert np.diff(first).tolist() == [len(w) for w in want]


def test_bpe_equals_library_on_many_strings():
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.encoder(PATH, PATTERN)
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x2FFF)] + [" "] * 2000 + ["\x1c", "\x85", "​", "　", "\U0001f600", "²", "½", "\r\n", "Ab", " is", "  ", "'s"] * 200
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        ids = mine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()
    for text in ("a" * 5000, "\n" * 300 + " " * 301, "<|endoftext|>", "zq" * 2000):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_append_and_edit_equal_encoding_anew():
    enc = bpe.PrefixEncoder(bpe.load_ranks(PATH))
    rng = random.Random(2)
    draw = lambda n: bytes(rng.choice(b"theinganderoxq") for _ in range(n))
    for _ in range(40):
        piece = draw(rng.randint(1, 400))
        last = enc.extend(piece, [-1])
        more, longer = enc.append(piece, last, draw(9))
        assert longer == enc.extend(more, [-1]) and longer[: len(last)] == last
        a = rng.randint(0, len(piece))
        b = rng.randint(a, len(piece))
        text, table = enc.edit(piece, last, a, b, draw(rng.randint(0, 5)))
        assert table == enc.extend(text, [-1])
        assert b"".join(enc.bytes_of[t] for t in enc.tokens(table)) == text


def test_encode_texts(docs, none):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    got = bpe.encode_texts(docs, PATH, PATTERN).collect()
    want = sorted((str(i), library.encode_ordinary(t or "")) for i, t in corpus())
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    texts = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in corpus():
        if i is not None:
            assert texts[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(docs, PATH, PATTERN), PATH, PATTERN).select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in corpus())
    assert bpe.encode_texts(none, PATH, PATTERN).count() == 0


@pytest.mark.parametrize(("window", "shared"), [(8, 16), (50, 16), (8, 2)])
def test_substring_dedup(docs, none, window, shared, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARED", shared)
    rows = corpus()
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((str(i), len(w), int(gone.sum()), kept.decode()))
    got = substring_dedup.remove_repeats(docs, window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found) == sorted(want)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in found)
    assert sum(x[2] for x in want) > 0
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("order", [1, -1, 0])
def test_passage_of_all_documents(spark, order):
    """A passage that every document has is settled in the tasks, whatever the order of the documents."""
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 70))]
        at = rng.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + shared + words[at:])))
    rows = rng.sample(rows, len(rows)) if not order else rows[::order]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    assert got == {i: (len(t.split()), 60 if i else 0) for i, t in rows}


def test_words_have_hashes_of_their_own():
    rng = random.Random(10)
    words = sorted({"".join(rng.choice("abé") for _ in range(n)) for n in [*range(1, 40)] * 30 + [250, 256, 257, 300, 5000] * 4})
    words += ["x" * n for n in (7, 8, 9, 15, 16, 17, 255, 256, 257, 264, 265)]
    texts = pa.array([" ".join(words), *words])
    raw, off = utf8(texts)
    starts, ends, first = word_spans(raw, off)
    h = span_hashes(raw, starts, ends)
    assert (h[: len(words)] == h[len(words) :]).all() and len(set(h.tolist())) == len(words)
    assert span_hashes(raw[:0], starts[:0], ends[:0]).tolist() == []


def test_group_of_is_sparks_hash(spark):
    df = spark.range(-50, 50).select((F.col("id") * 123456789).alias("id"), F.pmod(F.xxhash64(F.col("id") * 123456789), F.lit(97)).alias("g")).toPandas()
    assert (substring_dedup.group_of(df["id"].values, 97) == df["g"].values).all()


@pytest.mark.parametrize(("small", "large"), [(48, 1024), (2, 1024), (2, 3)])
def test_line_dedup(docs, none, small, large, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "LARGE", large)
    monkeypatch.setattr(line_dedup, "FIRST_RUN", 2 if large == 3 else 64)
    cfg = line_dedup.LineConfig(similarity=Fraction(1, 2) if small == 2 else Fraction(4, 5))
    sets = []
    for k, (i, t) in enumerate(corpus()):
        for n, ln in enumerate((t or "").split("\n")):
            sets.append((k, i, n, frozenset(ln.encode().lower().split())))
    gone = set()
    for k, i, n, s in sets:
        if i is not None and s:
            for _, j, m, o in sets:
                if j is not None and (j < i or (j == i and m < n)) and o and len(s & o) >= cfg.similarity * len(s | o):
                    gone.add((k, n))
    want = []
    for k, (i, t) in enumerate(corpus()):
        lines = (t or "").split("\n")
        want.append((str(i), len(lines), "\n".join(ln for n, ln in enumerate(lines) if (k, n) not in gone)))
    got = line_dedup.remove_lines(docs, cfg)
    assert sorted((str(r.doc_id), r.n_lines, r.kept) for r in got.collect()) == sorted(want)
    assert got.select("rest.source", "rest.kept").distinct().collect()[0] == ("s", "d")
    assert gone
    assert line_dedup.remove_lines(none).count() == 0


def test_line_candidates_beyond_the_first_tries(spark):
    """A line whose most promising candidates fail is looked up again with all of them."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(20)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(20)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_lines(df, line_dedup.LineConfig(tries=1)).collect()}
    sets = [set(t.split()) for _, t in rows]
    for i, s in enumerate(sets):
        assert got[i] == int(any(5 * len(s & o) >= 4 * len(s | o) for o in sets[:i]))


def test_many_lines_of_one_template():
    """A posting of very many lines: none similar, all similar, and lines of the same rare words that differ in others."""
    cfg, rng = line_dedup.LineConfig(), random.Random(6)
    words = lambda i, n, k: [f"t{j}" for j in range(n)] + [f"v{i}.{j}" for j in range(k)]
    for n, k, similar in ((7, 1, False), (9, 1, True), (20, 2, True), (11, 3, False)):
        lines = [" ".join(words(i, n, k)) for i in range(20_000)]
        batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(lines)), pa.int64()), "text": lines})
        levels = np.zeros(line_dedup.SLOTS, np.uint8)
        # Template words are frequent.
        for h, *_ in [line_dedup._words(pa.array([" ".join(f"t{j}" for j in range(n))]))]:
            levels[(h >> np.uint64(44)).astype(np.int64)] = 100
        table = pa.Table.from_batches(list(line_dedup.prefixes(levels, 1, cfg)([batch])))
        classes = line_dedup._Classes(table)
        found = list(classes.best(cfg))
        later = np.unique(np.concatenate([x for x, _, _ in found])) if found else np.zeros(0, int)
        # All but the first of a word's list have a candidate, or none has (but for chance hits of the bitmap).
        if similar:
            assert len({int(d) for d in classes.docs[later]}) == len(lines) - 1
        else:
            assert not len(later)
    # Lines that share their rarest words, but differ in frequent ones.
    lines = [" ".join([*(f"r{j}" for j in range(16)), *rng.sample([f"c{j}" for j in range(60)], 4)]) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(lines)), pa.int64()), "text": lines})
    levels = np.zeros(line_dedup.SLOTS, np.uint8)
    classes = line_dedup._Classes(pa.Table.from_batches(list(line_dedup.prefixes(levels, 1, cfg)([batch]))))
    got = {(int(classes.docs[a]), int(classes.docs[b])) for x, y in classes.all(cfg, np.ones(len(classes.docs), bool)) for a, b in zip(x, y, strict=True)}
    sets = [frozenset(t.split()) for t in lines]
    want = {(i, j) for i in range(0, 3000, 10) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    same = {frozenset(x) for x in sets}
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    assert len(same) > 2900 and want
    assert all((i, j) in got for i, j in want if first[sets[i]] == i and first[sets[j]] == j)


def slow_print(text: str) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("points", [32_000, 4])
def test_simhash(docs, none, points, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", points)
    monkeypatch.setattr(simhash, "LEAF", 4 if points == 4 else 256)
    rows = corpus()
    prints = [slow_print(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 4:
                root[find(i)] = find(j)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted((str(i), f"{prints[k]:016x}", str(least.get(find(k)))) for k, (i, _) in enumerate(rows))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0
    if points == 4:
        kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
        assert sorted(x for x in kept if x is not None) == sorted(least.values())
        assert simhash.keep_one(docs).columns == docs.columns


def test_random_fingerprints_against_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (300, 3), dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips[:, 0], base ^ flips[:, 1] ^ flips[:, 2], np.arange(40, dtype=np.uint64)]))
    tree, shards = simhash.grow(fps[::7], 4)
    at, shard, home = simhash.place(tree, fps, 4)
    assert home.sum() == len(fps)
    linked = set()
    for s in range(shards):
        mine, own = at[shard == s], home[shard == s]
        forest = simhash.link_within(np.flatnonzero(own), fps[mine], 4)
        linked |= {(int(mine[i]), int(mine[r])) for i, r in enumerate(forest.roots(np.arange(len(mine)))) if i != r}
    close = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    reach = np.eye(len(fps), dtype=bool)
    for a, b in linked:
        reach[a, b] = reach[b, a] = True
    for m in (reach, close):
        for _ in range(10):
            np.matmul(m, m, out=m)
    assert (reach == close).all()


def test_shards(docs, none):
    got = sharding.assign_shards(docs, 5).collect()
    rows = corpus()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots: dict = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    where: dict = {}
    for r in got:
        where.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert sharding.assign_shards(none).count() == 0


def test_large_group_and_hot_sizes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 10)
    rows = [(7, "same text")] * 300 + [(i, f"{i:09d}") for i in range(600)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() <= 25 * 60
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])


def test_best_fit_decreasing_equals_item_by_item():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 80))]
        left: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [(x, k) for k, x in enumerate(left) if x >= s]
            if fits:
                left[min(fits)[1]] -= s
            else:
                left.append(40 - s)
        runs = sharding.best_fit_decreasing([(s, sizes.count(s)) for s in set(sizes)], 40)
        load = [0] * len(left)
        for s, a, b, k in runs:
            load[k] += s * (b - a)
        assert [40 - x for x in load] == left
    assert sharding.best_fit_decreasing([(50, 1)], 40) is None


def test_secrets(spark, none):
    texts = [
        "x password = 'abc123' y PASSWD:short token=ab api-key: 1 api_key=zzzzzz apikey\" : \"qqqqqq/=\"",
        "AKIA" + "A" * 16 + " AKIAB " + "AKIA" + "9" * 30 + "b",
        "deadbeef" * 3 + " " + "0" * 23 + " é\U0001f600 " + "ab" * 20,
        "aK9$ qX7Zt2Lw8Rv4Bn6Mc1Hy3Jd5 commit 3f786850e387550fdab836ed7e6dc881de23001b 123e4567-e89b-12d3-a456-426614174000 some_long_identifier_name_here AnotherVeryLongClassName 12345678901234567890123",
        "ſecret=abcdefgh toKen=abcdefgh",
        None,
        "",
    ]
    got = secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, PATTERN).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert got[3].spans == "random:5:29,hex:37:77"
    assert secret_scan.scan_secrets(none, PATH, PATTERN).count() == 0


def test_decontamination(spark, docs, none):
    question = "The train leaves Boston at 15 km per hour and Alice counts 15 red apples while Boston sleeps under 7 blue lamps tonight."
    renamed = "We saw it. The train leaves Denver at 99 km per hour and Maria counts 99 red apples while Denver sleeps under 3 blue lamps tonight. The end."
    broken = "The train leaves Denver at 99 km per hour and Maria counts 98 red apples while Paris sleeps under 99 blue lamps tonight."
    bench = spark.createDataFrame([(1, question), (2, None), (3, "too short"), (4, "wholly other words stand here alone"), (None, "")], "item_id long, text string")
    texts = [question, renamed, broken, question.upper(), None, "", "and so wholly other words stand here alone, he said", "word " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("leaks", F.lit("taken"))
    found, name = decontamination.find_leaks(df, bench)
    assert name == "leaks_" and found.columns == [*df.columns, name]
    got = {r.doc_id: list(r[name]) for r in found.collect()}
    assert got[0] == [1] and got[1] == [1] and got[2] == []
    assert got[6] == [4] and got[4] == got[5] == got[7] == []
    split, name = decontamination.find_leaks(df, bench, decontamination.TemplateConfig(block=1))
    assert {r.doc_id: sorted(r[name]) for r in split.collect()} == got
    none_found, name = decontamination.find_leaks(none, bench)
    assert none_found.count() == 0
    clean, name = decontamination.find_leaks(docs, bench.limit(0))
    assert clean.where(F.size(name) > 0).count() == 0 and clean.count() == docs.count()


def test_decontamination_of_runs_shorter_than_a_window(monkeypatch):
    items = [(1, "so five plain words stand"), (2, "a whole item of more than eight plain words stands here")]
    bench, canon = decontamination.Bench(items, decontamination.TemplateConfig()), decontamination.Canon()
    for n in range(12):
        assert bench.leaks([" ".join(["word"] * n)], canon) == [[]]
    assert bench.leaks(["so five plain words stand"], canon) == [[1]]
    assert bench.leaks(["he said so", "", "four words of text"], canon) == [[], [], []]
    # A long text fills a run, so that a short one after it is a run of its own.
    monkeypatch.setattr(decontamination, "TOGETHER", 100)
    runs = list(decontamination._runs(["word " * 50, "only four words here"]))
    assert [len(r) for r in runs] == [1, 1]
    assert [bench.leaks(r, canon) for r in runs] == [[[]], [[]]]


NAMES = ["Alice", "Bob", "Carlos", "Denver", "Paris", "Mary Jane", "Li Wei", "Oslo", "Quito", "Nora"]
NOUNS = [f"noun{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(10)]


def problem(rng: random.Random, length: int) -> list[tuple[str, str]]:
    """A word problem as (kind, word)."""
    out = []
    for _ in range(length):
        kind = rng.choices(["literal", "number", "name", "quantity"], [7, 1, 1, 1])[0]
        if kind == "quantity":
            out += [("number", str(rng.randint(2, 99))), ("unit", rng.choice(["kg", "km", "hours", "usd"]))]
        else:
            out.append((kind, {"literal": rng.choice(NOUNS), "number": str(rng.randint(2, 99)), "name": rng.choice(NAMES)}[kind]))
    return [("literal", "so"), *out]


def changed(rng: random.Random, item: list[tuple[str, str]], kinds: set[str]) -> str:
    """The item with other values for the slots of some kinds, one for one throughout."""
    fresh = {"number": [str(n) for n in range(100, 400)], "name": ["Zoe", "Yan", "Xena", "Walt", "Vera", "Uma Tran", "Theo", "Saul", "Ruth", "Quin"], "unit": ["lb", "mi", "minutes", "eur"]}
    for pool in fresh.values():
        rng.shuffle(pool)
    given: dict = {}
    for kind, w in item:
        if kind in kinds and (kind, w) not in given:
            given[kind, w] = fresh[kind][len([1 for k, _ in given if k == kind])]
    return " ".join(given.get(x, x[1]) for x in item)


def plainly_leaked(bench, words, j: int) -> bool:
    """The rule of one document and item, window by window."""
    cfg, (_, item, _) = bench.cfg, bench.items[j]
    matches = []
    size = min(cfg.window, len(item.value))
    for p in range(len(words.value) - size + 1):
        for q in range(len(item.value) - size + 1):
            if (words.value[p : p + size] == item.value[q : q + size]).all() and (size > 2 or words.first[p] and (p + size == len(words.first) or words.first[p + size])):
                matches.append((p - q, q, size, -1))
    size = min(cfg.window, len(item.token))
    if size >= cfg.shortest and len(words.token) >= size:
        good, theirs = decontamination._enough(words, cfg, size), decontamination._enough(item, cfg, size)
        for p in range(len(words.token) - size + 1):
            for q in range(len(item.token) - size + 1):
                if good[p] and theirs[q] and (words.token[p : p + size] == item.token[q : q + size]).all():
                    matches.append((int(words.start[p] - item.start[q]), q, size, p))
    return bool(matches) and bench._leaked(item, words, matches)


def test_decontamination_equals_the_rule_window_by_window():
    rng = random.Random(11)
    cfg = decontamination.TemplateConfig()
    templates = [problem(rng, rng.choice([2, 5, 9, 16, 30])) for _ in range(14)]
    items = [" ".join(w for _, w in t) for t in templates]
    # Many items of one template, some items twice.
    items += [changed(rng, templates[k], {"number", "name"}) for k in (3, 4, 5) for _ in range(6)] + items[:2]
    bench, canon = decontamination.Bench(list(enumerate(items)), cfg), decontamination.Canon()
    filler = lambda: " ".join(rng.choice(["and", "then", *NOUNS[:30]]) for _ in range(rng.randint(0, 8)))
    texts = []
    for k in range(70):
        body = [rng.choice(items), changed(rng, rng.choice(templates), {rng.choice(["number", "name", "unit"])}), " ".join(rng.sample(items[k % 14].split(), len(items[k % 14].split())))][k % 3].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            body[rng.randrange(len(body))] = rng.choice(["17", "Alice", "kg", NOUNS[0]])
        texts.append(f"{filler()}\n{' '.join(body)}. {filler()}")
    got = bench.leaks(texts, canon)
    for text, some in zip(texts, got, strict=True):
        words = canon.read([text])
        assert some == [j for j in range(len(items)) if plainly_leaked(bench, words, j)]
    assert sum(map(len, got)) > 50


def test_decontamination_recall_by_kind():
    """Verbatim copies in any case are all found; so are items of new numbers, names or units that have a few literals."""
    rng = random.Random(12)
    items = [problem(rng, rng.choice([14, 20, 30])) for _ in range(150)]
    texts = [" ".join(w for _, w in t) for t in items]
    texts += ["Mix 3 kg A, 5 kg B and 7 kg C at 20 % and 30 % for 2 h.", "Who painted Guernica exactly?", "A train travels 60 km in 2 hours. How many km in 5 hours?"]
    bench, canon = decontamination.Bench(list(enumerate(texts)), decontamination.TemplateConfig()), decontamination.Canon()
    for turn in (str, str.upper, str.lower):
        assert all(k in some for k, some in enumerate(bench.leaks([f"Once. {turn(t)} Then." for t in texts], canon)))
    share = {}
    for kinds in (("number",), ("name",), ("unit",), ("number", "name"), ("number", "name", "unit")):
        some = bench.leaks([changed(rng, t, set(kinds)) for t in items], canon)
        share[kinds] = sum(k in x for k, x in enumerate(some)) / len(items)
    assert min(share.values()) >= 0.8, share
    clean = bench.leaks([" ".join(w for _, w in problem(rng, 60)) for _ in range(200)], canon)
    assert not any(clean)
    print(share)


def test_decontamination_of_many_items_of_one_template():
    import time

    items = [f"A train with {i} red wagons leaves Boston at {i + 7} km per hour and needs {3 * i} blue lamps for the whole long night trip." for i in range(20_000)]
    began = time.time()
    bench = decontamination.Bench(list(enumerate(items)), decontamination.TemplateConfig())
    built = time.time() - began
    text = "A train with 5 red wagons leaves Denver at 77 km per hour and needs 99 blue lamps for the whole long night trip."
    broken = "A train with 5 red wagons"
    began = time.time()
    got = bench.leaks([text, broken, items[3]], decontamination.Canon())
    assert len(got[0]) > 19_000 and got[1] == [] and 3 in got[2]
    assert built < 30 and time.time() - began < 3


def test_passages_by_brute_force():
    """Features of each passage, counted byte by byte and word by word."""
    texts = [t for _, t in corpus(n=8)] + ["A b, c!\n\nD1 é\x00", "x " * 129, "  lead", "Same same Same"]
    for words in (4, 64):
        x, lead = quality.passages(pa.array(texts), words)
        at = 0
        for text in texts:
            raw = (text or "").encode()
            spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
            cuts = [0, *(spans[i][0] for i in range(words, len(spans), words)), len(raw)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                piece, some = raw[a:b], [raw[s:e] for s, e in spans[k * words : (k + 1) * words]]
                counts, pairs = np.zeros(quality._CLASSES), np.zeros(64)
                for c in piece:
                    counts[quality._CLASS[c]] += 1
                for c, d in zip(piece, piece[1:]):
                    pairs[quality._COARSE[c] * 8 + quality._COARSE[d]] += 1
                n = max(1, len(some))
                extra = [np.log1p(len(some)), len(piece) / n / 8, len(set(some)) / n, sum(p == q for p, q in zip(some, some[1:])) / n, sum(w[:1].isalpha() and w[:1].isupper() for w in some) / n]
                want = np.concatenate([np.sqrt(counts / max(1, len(piece))), np.sqrt(pairs / max(1, len(piece))), extra])
                assert np.allclose(x[at], want, atol=1e-6)
                at += 1
        assert at == len(x) == lead[-1]


def test_quality_of_repeated_and_very_long_rows(spark):
    """The model does not depend on how rows are dealt or repeated; long documents are scored, if not learnt from."""
    rows = [(i, ("Good words in a calm sentence, number %d. " % i) * 4 if i % 2 else "zx!!%d ## qq" % i * 9, i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2 + [(1, None), (61, "Good words. " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(61, 0)], "doc_id long, quality int")
    one = quality.fit_quality(docs.repartition(5), labels, F.lit(True))
    two = quality.fit_quality(docs.coalesce(1), labels, F.lit(True))
    assert all(np.array_equal(one.params[k], two.params[k]) for k in one.params)
    got = quality.score_quality(docs, one).collect()
    by_id: dict = {}
    for r in got:
        by_id.setdefault((r.doc_id, r.text), set()).add(r.score)
    assert len(got) == docs.count() and all(len(s) == 1 for s in by_id.values())
    assert max(by_id[61, "Good words. " * 20_000]) > 0.5


def test_quality_gradients_and_training():
    cfg = quality.QualityConfig(width=4, attention=3)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((9, 5))
    lead, y = np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.AttentionModel.fresh(x, cfg)

    def loss():
        s = model.forward(x, lead)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in model.gradients(x, lead, y).items():
        p = model.params[name]
        for i in np.ndindex(p.shape):
            old = p[i]
            p[i] = old + 1e-5
            up = loss()
            p[i] = old - 1e-5
            down = loss()
            p[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_quality_on_held_out_rows(spark, none):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 200))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), int(not bad)))
    df = spark.createDataFrame([(*r[:2], "x") for r in rows] + [(900, None, "x"), (901, "", "x"), (None, "abc", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (5, None, 0), (6, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(df, labels, quality.fold() != 1, quality.QualityConfig(epochs=15))
    got = quality.score_quality(df, model).collect()
    assert len(got) == 303 and all(0 <= r["score_"] <= 1 for r in got)
    held = [(r["score_"] >= 0.5) == bool(rows[r.doc_id][2]) for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean(held) > 0.97
    assert quality.fit_quality(df, labels.limit(0), quality.fold() != 1) is None
    assert quality.score_quality(none, model).count() == 0


def leaked(items: list[str], texts: list[str]) -> list[list]:
    bench = decontamination.Bench(list(enumerate(items)), decontamination.TemplateConfig())
    return bench.leaks(texts, decontamination.Canon())


def test_items_of_few_literals():
    items = [
        "A train travels 60 km in 2 hours. How many km in 5 hours?",
        "Convert 12 km 300 m to m and 45 min 20 s to s",
        "What is 12 times 15?",
        "The capital of France is Paris",
        "In 1969 Neil Armstrong and Buzz Aldrin landed on the Moon with Apollo 11",
        "Who wrote Hamlet?",
        "2+2=?",
    ]
    around = [f"Some words stand before it. {t} Others come after it." for t in items]
    assert leaked(items, [*items, *around]) == [[k] for k in range(7)] * 2
    assert leaked(items, [t.upper() for t in items]) == [[k] for k in range(7)]
    assert leaked(items, ["A train travels 80 km in 3 hours. How many km in 7 hours?", "Convert 7 km 100 m to m and 15 min 40 s to s"]) == [[0], [1]]
    clean = ["- - - " * 20, "1 2 3 " * 50, "Anna Berta Carla " * 20, "so 2+2 makes four", "What is 13 times 15?", "", "The capital of France"]
    assert leaked([*items, "- - -", "| --- | --- |", ""], clean) == [[]] * len(clean)


def test_items_in_other_case_and_with_longer_names():
    question = "The train leaves Boston at 15 km per hour and Alice counts 15 red apples while Boston sleeps under 7 blue lamps tonight."
    longer = question.replace("Alice", "Mary Jane").replace("Boston", "New York")
    texts = [question.lower(), question.upper(), longer, question.replace("15 km", "9").replace("15 red", "9 red")]
    assert leaked([question], texts) == [[0]] * 4
    pieces = "Red small birds sing sweet songs near water with Alice and then other grey birds fly over dark hills today"
    assert leaked([pieces], ["So it went: " + pieces.replace("with Alice and", "beside x y z and")]) == [[0]]


def random_found(text: str) -> list[str]:
    return [text[a:b] for a, _, b in secret_scan.random_spans(text, secret_scan._vocabulary(PATH, PATTERN), 1.9)]


def test_random_strings_after_equals_signs():
    secret = "qX7Zt2Lw8Rv4Bn6Mc1Hy3Jd5Kf9Gs0Pw2Ax8Vu4Te"
    for text in ("DB_PASS={}", "export STRIPE_KEY={}", "https://example.org/a?sig={}&x=1", "key: {}", "a={}\n", "x == {} == y", "{}=1", "a==={}==="):
        assert [x.rstrip("=") for x in random_found(text.format(secret))] == [secret]
    assert random_found(f"a={secret}==") == [secret + "=="]
    assert random_found("name=some_long_identifier_name_here id=123e4567-e89b-12d3-a456-426614174000") == []


def test_random_letters_are_no_identifiers():
    rng = random.Random(5)
    letters = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    low = [letters(32) for _ in range(200)]
    for some in (low, [x.upper() for x in low], ["-".join(letters(5) for _ in range(6)) for _ in range(200)], ["_".join(letters(6) for _ in range(5)) for _ in range(200)]):
        assert sum(random_found(x) == [x] for x in some) >= 150
    assert random_found("DEFAULT_CONNECTION_TIMEOUT_SECONDS AbstractSingletonProxyFactoryBean get_user_account_information state-of-the-art-technology ====================") == []


def test_keep_one_with_repeated_ids(spark):
    rows = [(1, "alpha beta gamma delta epsilon"), (1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "far away stands a small house"), (2, "far away stands a small house")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted({rows[0], rows[1], rows[3]})


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(0)
    n = np.array([0, 1, 2, 3, 5, 17, 100, 4096, 5000, 9000, 33])
    h = rng.integers(0, 1 << 48, int(n.sum()), dtype=np.uint64)
    got, keys, at = simhash.wide_print(h, n, 3), simhash.mix64(np.arange(1, 4, dtype=np.uint64)), 0
    for i, k in enumerate(n.tolist()):
        x = simhash.mix64(h[at : at + k][:, None] ^ keys)
        at += k
        counts = np.unpackbits(x.view(np.uint8).reshape(k, 3, 8), axis=2, bitorder="little").sum(0, dtype=int) if k else np.zeros((3, 64), int)
        assert (np.packbits(counts * 2 > k, axis=1, bitorder="little").view("<u8")[:, 0] == got[i]).all()


def shingle_set(text: str, size: int = 5) -> set:
    words = text.encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.mark.parametrize(("points", "visitors"), [(32_000, 128_000), (20, 50)])
def test_similar_documents(spark, none, points, visitors, monkeypatch):
    """Every pair of similarity 0.8 is in one component, and no component joins documents far below it; every cell of the grid is searched."""
    monkeypatch.setattr(simhash, "SHARD_POINTS", points)
    monkeypatch.setattr(simhash, "VISITORS", visitors)
    rng = random.Random(8)
    texts: list[str | None] = [None, "", " \n", "one", "One", "two words", "two  WORDS", "a b c d e f g h i j"]
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 30, 100, 300]))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            other = list(words)
            for _ in range(max(1, int(len(words) * rng.choice([0.005, 0.01, 0.02, 0.1])))):
                other[rng.randrange(len(other))] = f"x{rng.randrange(3000)}"
            # Longer and shorter ones cross the border of a band.
            texts.append(" ".join(other[: rng.choice([len(other), len(other) - len(other) // 12])]))
    texts += [texts[8]] * 30
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    sets = [shingle_set(t or "") for t in texts]
    alike = lambda a, b: 1.0 if not a and not b else len(a & b) / max(1, len(a | b))
    pairs = [(i, j, alike(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)]
    for i, j, x in pairs:
        if x >= 0.8:
            assert got[ids[i]] == got[ids[j]], (texts[i], texts[j], x)
    loose = list(range(len(sets)))

    def find(i):
        while loose[i] != i:
            i = loose[i]
        return i

    for i, j, x in pairs:
        if x >= 0.6:
            loose[find(i)] = find(j)
    members: dict = {}
    for i, k in enumerate(ids):
        members.setdefault(got[k], []).append((k, find(i)))
    assert all(c == min(k for k, _ in some) and len({f for _, f in some}) == 1 for c, some in members.items())
    kept = [r.doc_id for r in simhash.keep_one(df, size=5, similarity=0.8).collect()]
    assert sorted(kept) == sorted(members)
    assert simhash.keep_one(none, size=5, similarity=0.8).count() == 0


def test_hot_fingerprints_are_not_one_task(spark, monkeypatch):
    from tidegrove.llm import common

    monkeypatch.setattr(common, "FEW_ROWS", 1000)
    rows = [(i, "the same text in very many documents") for i in range(15_000)] + [(20_000 + i, f"text number {i} of its own kind {i * i}") for i in range(5_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = simhash.near_duplicates(df).groupBy("component_id").count().orderBy(F.desc("count")).first()
    assert tuple(got) == (0, 15_000)
    kept = simhash.keep_one(df.union(df.limit(0)), size=5, similarity=0.8)
    assert 1 <= kept.where("doc_id < 15000").count() == 1


def test_keep_one_of_rows_alike(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "q r s t u v", "z"), (None, None, "n"), (None, None, "m")]
    for size, similarity in ((4, None), (5, 0.8)):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, key string"), size=size, similarity=similarity).collect()
        assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "None"]


def test_secrets_of_nulls_repeats_long_texts_and_clashing_names(spark):
    rng = random.Random(13)
    token = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44))
    long = "word " * 100_000 + f"key={token} " + "tail " * 100_000
    rows = [(None, f"x {token}", "a", 1), (7, long, "b", 2), (7, long, "b", 2), (8, None, "c", 3), (8, "é" * 30 + f" {token}", "c", 3)]
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int"), PATH, PATTERN).collect()
    assert len(got) == 5 and got[0].__fields__[0] == "doc_id"
    spans = sorted((str(r.doc_id), r.spans) for r in got)
    at = long.index(token)
    assert spans == sorted([("None", "random:2:46"), ("7", f"random:{at}:{at + 44}"), ("7", f"random:{at}:{at + 44}"), ("8", ""), ("8", "random:31:75")])


def test_random_spans_by_brute_force():
    """Runs by a scan of characters, and their tokens by the library, one run after the other."""
    vocabulary = secret_scan._vocabulary(PATH, PATTERN)
    rng = random.Random(14)
    code, other = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", " .,:;=\"'()é\n="
    for _ in range(300):
        text = ""
        for _ in range(rng.randint(1, 12)):
            text += "".join(rng.choice(code) for _ in range(rng.choice([3, 19, 20, 21, 40]))) if rng.random() < 0.6 else rng.choice(["someLongIdentifierNameHere", "deadbeef" * 4, "1234567890" * 3, "under_score_words_in_a_row"])
            text += rng.choice(other) * rng.choice([0, 1, 1, 2, 3])
        want, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] in code:
                j += 1
            if j - i >= 20:
                # Up to two signs of padding, and none if a run would go on behind them.
                pads = len(text[j : j + 2]) - len(text[j : j + 2].lstrip("="))
                while pads and j + pads < len(text) and text[j + pads] in code:
                    pads -= 1
                run = text[i : j + pads]
                if not secret_scan.harmless(run, vocabulary, 1.9) and len(run) <= 1.9 * len(vocabulary.encode_ordinary(run)):
                    want.append((i, 3, j + pads))
            i = max(j, i + 1)
        assert secret_scan.random_spans(text, vocabulary, 1.9) == want, text


def test_write_shards(spark, tmp_path):
    rows = [(i, f"text {i % 17} " * (i % 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(tuple, back.select("doc_id", "text").collect())) == rows
    place = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(df, 5).collect()}
    assert all(place[r.doc_id] == (r.shard, r.slot) for r in back.collect())


@pytest.mark.parametrize("broadcast", [10_000, 5])
def test_components_by_brute_force(spark, broadcast, monkeypatch):
    """Chains, stars and random edges, with hot nodes told from others at any size."""
    from tidegrove.llm import common
    from tidegrove.llm import components as graph
    from tidegrove.llm.components import components

    monkeypatch.setattr(common, "HOT_SHARE", broadcast)
    if broadcast == 5:
        monkeypatch.setattr(common, "FEW_ROWS", 5)
        monkeypatch.setattr(graph, "FILE_EDGES", 50)
    rng = random.Random(16)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(7, 7)]
    edges += edges[:10] + [(b, a) for a, b in edges[:10]]
    root: dict = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.a: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}

"""Operators over texts against brute force, with nulls, empties, ties, repeats and clashing columns."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing, near, personal, quality, repeats, shingles
from strandline.llm import _text as T

from . import helpers as H

key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.fixture(scope="module", params=[1, 2])
def data(request):
    return H.rows(request.param)


@pytest.fixture
def docs(spark, data):
    return H.clashing(H.documents(spark, data)).repartition(3)


def test_repeats(docs, data):
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs).collect()), key=key)
    want = H.brute_repeats(data)
    assert got == sorted(want, key=key)


@pytest.mark.parametrize(("split", "rate"), [(2, 1 << 40), (20_000, 1), (3, 2)])
def test_repeats_of_split_anchors(docs, data, split, rate, monkeypatch):
    monkeypatch.setattr(repeats, "LEAST_HOT", 2)
    size, hot = repeats.hot_anchors(docs.select("doc_id", "text"), 50, rate)
    assert size == sum(len((t or "").encode()) for _, t, *_ in data) and (len(hot) > 0) == (rate < 9)
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs, split=split, rate=rate).collect()), key=key)
    assert got == sorted(H.brute_repeats(data), key=key)


def test_one_gram_before_many_texts(spark):
    """A line in every document, each followed by another text: its windows lie in the smaller documents, and nothing else does."""
    n, line = 120_000, "All of these begin with the same words and then each goes on alone: "
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(line), F.sha2(F.col("id").cast("string"), 256), F.lit(" "), F.sha2(F.concat(F.lit("x"), F.col("id")), 256)).alias("text"))
    seen, want = set(), {0: 0}
    for i in range(n):
        tail = H.sha(str(i).encode())
        if i:
            want[i] = len(line) + max(k for k in range(13) if not k or tail[:k] in seen)
        seen.update(tail[:k] for k in range(1, 13))
    for rate in (64, 1 << 40):
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(d, rate=rate).collect()}
        assert got == {i: (k, int(k > 0)) for i, k in want.items()}


def test_repeats_full(spark):
    a = "0123456789" * 6
    got = {r.doc_id: r for r in repeats.remove_repeats(H.documents(spark, [(1, a, "", "", 1), (2, "é" + a[:55] + "z", "", "", 1)]), full=True).collect()}
    assert bytes(got[2].kept) == "éz".encode() and [tuple(s) for s in got[2].spans] == [(2, 57)]
    assert bytes(got[1].kept) == a.encode() and not got[1].spans


def test_long_repeats_are_cut_at_fixed_places(spark):
    rng = np.random.default_rng(3)
    long = "".join(chr(97 + c) for c in rng.integers(0, 26, 700_000))
    data = [(1, long, "", "", 1), (2, "x" * 77 + long[100:650_000] + "y" * 30, "", "", 1)]
    got = {r.doc_id: r for r in repeats.remove_repeats(H.documents(spark, data)).collect()}
    assert (got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (649_900, 1, H.sha(b"x" * 77 + b"y" * 30))


def test_radix_groups():
    rng = np.random.default_rng(1)
    digits = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    group = rng.integers(0, 2, 500)
    got = repeats.radix_groups(digits, group)
    rows = [(g, *d) for g, d in zip(group.tolist(), digits.tolist())]
    for i in range(500):
        assert (got[i] >= 0) == (rows.count(rows[i]) > 1)
    assert all((got[i] == got[j]) == (rows[i] == rows[j]) for i in range(80) for j in range(80) if got[i] >= 0 and got[j] >= 0)


def test_personal(docs, data):
    got = {r.doc_id: r for r in personal.digest(personal.find_personal(docs)).collect()}
    for i, t, *_ in data:
        b = H.brute_personal(t)
        assert [got[i][f"n_{k}"] for k in personal.BASE] == [sum(x[0] == k for x in b) for k in personal.BASE]
        assert got[i].base_sha256 == H.sha(",".join(f"{k}:{a}:{z}" for k, a, z in b).encode())
    assert len(got) == len({r[0] for r in data})


HARD = ["a@b.c..d x_y@z.co.uk,q@r.s@t.u.v", "1.2.3.4.5.6 256.1.1.1 0255.001.1.1", "4111 1111 1111 1111-- 4111-1111-1111-1111 ", "+1 (784) 555-9999 +12 345 +1-2", "x" * 30000, "1 " * 20000, "+1" * 2000, "a@b" + ".c" * 9000, "é@ü.de a@é.de +49 (0) 30 1234 56 😀 b@c.de", "1.2." * 9000, "aaa@aaa.b_c@d.e"]


def test_personal_on_hard_texts(spark):
    d = H.documents(spark, [(i, t, "", "", 1) for i, t in enumerate(HARD)])
    got = {r.doc_id: r.base_sha256 for r in personal.digest(personal.find_personal(d)).collect()}
    assert got == {i: H.sha(",".join(f"{k}:{a}:{z}" for k, a, z in H.brute_personal(t)).encode()) for i, t in enumerate(HARD)}


def test_masking_and_added_spans(spark):
    t = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" for a@b.co, é +1 (784) 555-9999.'
    d = H.documents(spark, [(i, t if i % 2 else "plain words about a12 and 2020-01", "", "", 1) for i in range(40)])
    got = {r.doc_id: r.text for r in personal.mask_personal(d).collect()}
    assert got[1] == 'token = "[KEY]" for [EMAIL], é [PHONE].' and got[0] == "plain words about a12 and 2020-01"


def test_many_spans_of_one_text(spark):
    t = " ".join(f"a{i}@b{i}.co 10.0.{i % 256}.{i % 200} key=AKIA{i:012d}" for i in range(20_000)) + " " + "1.2.3.4." * 3000 + "x@y.zz end"
    d = H.documents(spark, [(1, t, "", "", 1)])
    began = time.monotonic()
    got = personal.digest(personal.find_personal(d)).first()
    base = H.brute_personal(t)
    assert got.n_email == 20_001 and got.base_sha256 == H.sha(",".join(f"{k}:{a}:{z}" for k, a, z in base).encode())
    masked = personal.mask_personal(d, mask="<{}%>").first().text
    assert masked == "<EMAIL%> <IP%> key=<KEY%> " * 20_000 + "<EMAIL%> end"
    assert time.monotonic() - began < 90


def test_fit_prefers_agreeing_voters():
    w = personal.fit([("key", (1, 1, 1, 1), 50), ("key", (-1, 0, 0, -1), 200), ("key", (1, 0, 1, 1), 30), ("local", (0, 0, -1, 0), 40)])
    assert w["vote", 2, 1] > 0 > w["vote", 3, -1]
    assert personal.fit([])["vote", 0, 1] == 1.0


def test_quality(docs, data):
    got = {r.doc_id: tuple(r)[1:8] for r in quality.judge_quality(docs).collect()}
    for i, t, *_ in data:
        assert got[i] == H.brute_quality(t), (i, t and t[:50])


@pytest.mark.parametrize("seed", range(6))
def test_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    row = np.sort(rng.integers(0, 4, 300))
    word = T.mix(rng.integers(0, 2 + seed, 300).astype(np.uint64))
    best = quality.common_prefixes(word, row)
    for i in range(300):
        want = 0
        for j in range(300):
            if i != j and row[i] == row[j]:
                k = 0
                while max(i, j) + k < 300 and row[i + k] == row[j + k] == row[i] and word[i + k] == word[j + k]:
                    k += 1
                want = max(want, k)
        assert best[i] == (want if want >= 4 else 0)


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 16 << 20), (5, 80, 16 << 20), (3, 85, 600)])
def test_near(docs, data, width, percent, block):
    got = near.near_duplicates(docs, width=width, percent=percent, block_bytes=block).collect()
    want = H.brute_near(data, width, percent)
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    n = {i: len(H.shingles(t, width)) for i, t, *_ in data}
    assert all(r.n_shingles == n[r.doc_id] for r in got)


def boilerplate(n, own=20, common=80):
    """Texts that share a long passage and are alike at (common / (common + 2 own)) or so."""
    rng = np.random.default_rng(5)
    shared = " ".join(f"c{k}" for k in range(common + 2))
    return [(i, shared + " " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, own)), "", "", 1) for i in range(n)]


@pytest.mark.parametrize("block", [16 << 20, 1 << 20])
def test_near_on_boilerplate_that_links_nothing(spark, block):
    data = boilerplate(10_000)
    data[77] = (77, data[5][1] + " x", "", "", 1)
    began = time.monotonic()
    got = near.near_duplicates(H.documents(spark, data).repartition(4), width=3, percent=85, block_bytes=block).filter("not kept").collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(77, 5)]
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("block", [16 << 20, 30_000])
def test_near_links_of_a_large_cluster(spark, block):
    rng = np.random.default_rng(6)
    data = boilerplate(60, own=8, common=92)
    for i in range(60, 240):
        w = data[int(rng.integers(0, i))][1].split(" ")
        for k in rng.integers(0, len(w), int(rng.integers(1, 4))):
            w[k] = f"n{rng.integers(0, 9)}"
        data.append((i, " ".join(w), "", "", 1))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(H.documents(spark, data), width=3, percent=80, block_bytes=block).collect()}
    assert got == H.brute_near(data, 3, 80)


def test_exact_clusters_need_no_bands(docs, data):
    got = near.near_duplicates(docs, width=3, percent=85, bands=1, rows=30, exact=True).collect()
    want = H.brute_near(data, 3, 85)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want


def test_super_minhash_is_unbiased_and_sharper():
    rng = np.random.default_rng(0)
    m, gaps, plain = 64, [], []
    for _ in range(150):
        pool = rng.integers(0, 1 << 50, 120).astype(np.uint64)
        a, b = np.unique(pool[:100]), np.unique(pool[20:])
        s = shingles.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), m)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        gaps.append((s[0] == s[1]).mean() - j)
        plain.append(j * (1 - j) / m)
    assert abs(np.mean(gaps)) < 0.02 and np.var(gaps) < np.mean(plain)
    small = shingles.super_minhash(np.array([5], np.uint64), np.array([0, 0, 1]), m)
    assert (small[0] == np.uint64(2**64 - 1)).all() and (small[1] != np.uint64(2**64 - 1)).all()


@pytest.mark.parametrize("n", [4095, 4096, 10_000])
def test_shingles_of_many_short_rows(n):
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else f"a{i % 50} b c{i % 3}" for i in range(n)]
    batch = pa.record_batch({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string())})
    got = pa.Table.from_batches(near.sign_batches(iter([batch]), 3, near.BANDS, near.ROWS)).to_pydict()
    assert got["doc_id"] == list(range(n))
    assert got["n_shingles"] == [len(H.shingles(t, 3)) for t in texts]
    alone = {}
    for t, code in zip(texts, got["code"]):
        assert alone.setdefault(t or "", code) == code
    assert len(set(alone.values())) == len(alone)


def test_mix(docs, data):
    got = mixing.mix(docs).collect()
    size = lambda t: len(H.WORD.findall(t or ""))
    held, taken, target = {}, {}, {}
    for i, t, _, s, _ in data:
        held[s] = held.get(s, 0) + size(t)
    of = {r[0]: r[3] for r in data}
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"]) for r in got) == sorted((r[0] if r[0] is not None else -1, size(r[1])) for r in data)
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == held[s] and 0 <= r.taken <= 3 * r["size"]
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    names = sorted(held, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    want, free, rest = {}, set(names), sum(held.values())
    while True:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * held[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * held[s]
            free.discard(s)
            rest -= 3 * held[s]
    want |= {s: level * weight[s] for s in free}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 3 for s in names)
    again = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)


def test_emitted_slots_are_what_is_taken(spark):
    d = H.documents(spark, [r for r in H.rows(4) if r[0] is not None][:60])
    taken = {r.doc_id: r.taken for r in mixing.mix(d).collect()}
    slots = mixing.emit(d).cache()
    assert {r.doc_id: r.n for r in slots.groupBy("doc_id").agg(F.sum(F.col("to") - F.col("from")).alias("n")).collect()} == {i: n for i, n in taken.items() if n}
    assert slots.groupBy("shard", "slot").agg(F.countDistinct("source", "block").alias("n")).agg(F.max("n")).first()[0] == 1
    # every block is drawn as often as any other of its source, or once more
    times = slots.select("shard", "slot", "source", "block").distinct().groupBy("source", "block").count().groupBy("source").agg((F.max("count") - F.min("count")).alias("gap"))
    assert times.agg(F.max("gap")).first()[0] <= 1


def test_shards_are_multinomial(spark):
    sources = spark.createDataFrame([(1, 90_000, 64, 1407, 3000), (2, 60_000, 64, 938, 1500), (3, 64, 1, 64, 500)], "number long, source_size long, block long, n long, slots long")
    rows = mixing.slots(sources, shard=100).collect()
    assert sorted((r["shard"], r.slot) for r in rows) == [(a, b) for a in range(50) for b in range(100)]
    counts = np.zeros((50, 3))
    for r in rows:
        counts[r["shard"], r.number - 1] += 1
    want = np.array([60, 30, 10])
    chi = (((counts - want) ** 2) / want).sum() * 49 / 50
    assert 60 < chi < 145  # 98 degrees of freedom
    drawn = [[r.block for r in rows if r.number == k] for k in (1, 2, 3)]
    assert [len(set(x)) for x in drawn] == [1407, 938, 64]


def test_remix_cuts_texts_at_blocks(spark):
    data = [(k if k % 3 else None, f" \n{k}a  {k}b\t" + " ".join(f"{k}w{j}" for j in range(k % 40)) + "\n\n", "en", "ab"[k % 2], 5) for k in range(300)]
    d = H.clashing(H.documents(spark, data))
    got = mixing.remix(d, block=16).collect()
    texts = {t: (i, s) for i, t, _, s, _ in data}
    whole = "\0".join(texts)
    seen = {"a": 0, "b": 0}
    for r in got:
        assert r.text in whole and r.n_chars == len(r.text) and H.WORD.search(r.text) and r.kept == "clash"
        seen[r.source] += len(H.WORD.findall(r.text))
    target = {r.source_size: r.target for r in mixing.mix(d).collect()}
    size = {s: sum(len(H.WORD.findall(t)) for t, (_, x) in texts.items() if x == s) for s in "ab"}
    assert all(abs(seen[s] - target[size[s]]) <= 0.03 * target[size[s]] for s in "ab")
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, mixing.remix(d.repartition(5), block=16).collect()), key=key)


@pytest.mark.parametrize("f", [repeats.remove_repeats, personal.find_personal, personal.mask_personal, quality.judge_quality, near.near_duplicates, mixing.mix, mixing.remix])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], H.SCHEMA)).collect() == []

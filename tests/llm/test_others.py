"""The other operators and the pipeline."""

import itertools
import math
import re
import zipfile
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import _shared, _text as T, fixity, mixing, neighbours, registry, segment, toxicity, urls, vocabulary

from . import helpers as H


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?y"), (2, "https://example.com/en/"), (3, "http://a.net/es/1"), (4, "http://a.org"), (5, None), (6, "no scheme casino"), (7, "http://casino-win.org/x"), (8, "http://x.org/casinox"), (9, "http://bet.org/poker"), (10, ""), (11, "http://x.com#f"), (11, "http://x.com#f"), (None, "http://net/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got == {
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "example.com", "/en/", "example.com/en/", "block"), (3, "a.net", "/es/1", "net/es/", "block"), (4, "a.org", "", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "block"), (7, "casino-win.org", "/x", None, "block"), (8, "x.org", "/casinox", None, "allow"), (9, "bet.org", "/poker", None, "block"), (10, "", "", None, "allow"),
        (11, "x.com", "", None, "allow"), (None, "net", "/fr/", "net/fr/", "block"),
    }
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_vocabulary_against_regular_expressions(spark):
    rng = np.random.default_rng(11)
    every = [*vocabulary.STRICT, *vocabulary.SOFT]
    assert len(set(every)) == len(every) > 250 and all(t == t.lower() and t.isascii() for t in every)
    glue = ["/", "-", ".", "_", "", "x", "9", "?q=", "%20"]
    made = ["http://h.org/" + "".join(rng.choice(every) + rng.choice(glue) for _ in range(int(rng.integers(0, 4)))).upper() for _ in range(400)] + ["http://h.org/" + "free-" * 50_000]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(list(enumerate(made)), "page_id long, url string")).collect()}
    for i, u in enumerate(made):
        hit = {t for t in every if t in u.lower() and re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", u.lower())}
        strict, soft = len(hit & set(vocabulary.STRICT)), sum(vocabulary.SOFT.get(t, 0) for t in hit)
        assert (got[i].strict_hits, got[i].soft_weight, got[i].verdict) == (strict, soft, "block" if strict or soft >= vocabulary.LIMIT else "allow")


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 600)] + 0.2 * rng.standard_normal((600, 16))
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (650, [0.0] * 16), (700, [math.nan] + [1.0] * 15), (750, [None] + [1.0] * 15), (None, [1.0] * 16), (800, [1.0] * 3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = neighbours.nearest(d, F.col("vec_id") % 50 == 0, block=20, queries=3).collect()
    s = x @ x.T / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((x * x).sum(1)))
    hit = 0
    for q in range(0, 600, 50):
        order = sorted((j for j in range(600) if j != q), key=lambda j: (-s[q, j], j))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(s[q, r.vec_id], abs=1e-12) for r in mine)
        assert all((-a.score, a.vec_id) <= (-b.score, b.vec_id) for a, b in itertools.pairwise(mine))
        hit += len({r.vec_id for r in mine} & set(order))
    assert hit >= 0.9 * 60
    assert {r.query_id for r in got} == set(range(0, 600, 50))  # 800 has no other vector of its dimension
    assert neighbours.nearest(d.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def exact_neighbours(x, ids, asked, k=5):
    u = x / np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for q in asked:
        s = u @ u[ids.index(q)]
        out[q] = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def test_neighbours_of_copies_and_extreme_values(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile(rng.standard_normal((1, 8)), (90, 1)), rng.standard_normal((60, 8))])
    x[100], x[101], x[102], x[103] = [1e200] + [0] * 7, [1e-200] + [0] * 7, [1e-300, 1e-300] + [0] * 6, [1.0] + [-0.0] * 7
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 9, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.nearest(d, (F.col("vec_id") % 50 == 0) | F.col("vec_id").isin(101, 103)).collect()
    by = lambda q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
    assert [i for i, _ in by(0)] == [1, 2, 3, 4, 5] and [i for i, _ in by(50)] == [0, 1, 2, 3, 4]
    assert by(100)[:2] == [(101, 1.0), (103, 1.0)] and by(101)[:2] == [(100, 1.0), (103, 1.0)] and by(103)[:2] == [(100, 1.0), (101, 1.0)]
    assert any(i == 102 and s == pytest.approx(math.sqrt(0.5)) for i, s in by(100))
    assert all(math.isfinite(r.score) for r in got)


def test_neighbours_recall_at_production_parameters(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = d.collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), [r.vec_id for r in rows]
    want = exact_neighbours(x, ids, [i for i in ids if i % 50 == 0])
    for block in (neighbours.BLOCK, 512):
        got = {}
        for r in neighbours.nearest(d, F.col("vec_id") % 50 == 0, block=block).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)
    s = neighbours.scaled(x)
    at = [i for i, v in enumerate(ids) if v % 50 == 0]
    seen = neighbours.search(np.array(ids)[at], s[at], np.array(ids), s, 6, neighbours.PROJECTIONS, neighbours.CONFIDENCE, neighbours.LEAF)[2]
    assert seen.mean() < 0.7 * len(x)


def test_kd_tree_skips_far_leaves():
    rng = np.random.default_rng(0)
    x = neighbours.scaled(np.repeat(rng.standard_normal((40, 8)), 50, 0) + 0.01 * rng.standard_normal((2000, 8)))
    ids = np.arange(2000)
    _, _, seen = neighbours.search(ids[:20], x[:20], ids, x, 5, 8, 0.95, 16)
    assert seen.mean() < 600
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)


def pages(spark, n=400):
    return spark.createDataFrame([(i, f"http://a/{i}" if i % 9 else None, f"<p>é{i}</p>" * (i % 50) if i % 11 else None) for i in range(n)], "page_id long, url string, html string")


def faults(left, right):
    return Counter((r.page_id, r.kind) for r in fixity.audit(left, right, size=8, fanout=4, levels=3).collect())


def test_fixity_finds_every_fault(spark):
    p = pages(spark).withColumn("digest", F.lit("clash"))
    index = fixity.archive(p, size=128)
    assert not faults(index, index)
    changed = p.withColumn("html", F.when(F.col("page_id").isin(3, 250), F.lit("longer than before")).otherwise(F.col("html"))).filter("page_id <> 77")
    bad = fixity.archive(changed, size=128)
    assert faults(index, bad) == {(3, "altered"): 1, (250, "altered"): 1, (77, "missing"): 1}
    assert faults(bad, index) == {(3, "altered"): 1, (250, "altered"): 1, (77, "extra"): 1}
    rows = index.filter("file = 0").orderBy("offset").collect()
    assert [r.page_id for r in rows] == list(range(128)) and all(a.offset + a.length == b.offset for a, b in itertools.pairwise(rows))
    assert fixity.audit_pages(p.limit(0)).collect() == []


def test_fixity_of_repeated_and_null_ids(spark):
    rows = [(i, f"u{i}", "x" * i) for i in range(300)] + [(1, f"v{k}", "y") for k in range(50)] + [(1, "v0", "y")] * 3 + [(None, f"n{k % 20}", "z" * k) for k in range(40)] + [(None, None, None)] * 2
    at = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = fixity.archive(at, size=128)
    assert index.count() == len(rows) and not faults(index, fixity.archive(at.repartition(7), size=128))
    del rows[200]
    assert faults(index, fixity.archive(spark.createDataFrame(rows, at.schema), size=128)) == {(200, "missing"): 1}
    rows.remove((1, "v0", "y"))
    rows.remove((None, "n3", "z" * 3))
    rows[rows.index((1, "v7", "y"))] = (1, "v7", "Y")
    rows.append((None, "new", "q"))
    got = faults(index, fixity.archive(spark.createDataFrame(rows, at.schema), size=128))
    assert got == {(200, "missing"): 1, (1, "altered"): 1, (1, "missing"): 1, (None, "missing"): 1, (None, "extra"): 1}


def test_roots_differ_on_one_byte(spark):
    a = fixity.nodes(fixity.archive(pages(spark, 20)))
    b = fixity.nodes(fixity.archive(fixity.damaged(pages(spark, 20))))
    assert a.first().hash != b.first().hash and fixity.above(a).first().hash != fixity.above(b).first().hash


def toxic_rows(n=600):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        w = [words[k] for k in rng.integers(0, 300, 60)]
        if bad:
            for k in rng.choice(60, 4, replace=False):
                w[k] = ["idiot", "grobold", "grobian", "scum"][rng.integers(0, 4)]
        rows.append((i, " ".join(w), "en", "s", 1))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    d = H.clashing(H.documents(spark, [*rows, (1000, None, "", "", 0), (1001, "", "", "", 0), (None, "scum idiot grobold scum", "", "", 0), rows[8]]))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, lab).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == toxicity.held_out(r.doc_id) for r in got.values())
    truth = [(i % 8 == 0, got[i].predicted == 1) for i in range(600) if got[i].held_out]
    assert sum(a == b for a, b in truth) >= 0.95 * len(truth)
    assert sum(a and b for a, b in truth) >= 0.9 * sum(a for a, _ in truth)
    assert got[1000].predicted == got[1001].predicted == 0 and got[1000].score == got[1001].score and got[None].held_out


def test_label_model_finds_rates_and_copies():
    """Rates of voters in either class without labels, and copies of a voter that count once."""
    rng = np.random.default_rng(8)
    n, truth = 6000, np.arange(6000) % 6 == 0
    on, off = rng.uniform(0.2, 0.6, 12), rng.uniform(0.0005, 0.002, 12)
    fires = rng.random((n, 12)) < np.where(truth[:, None], on, off)
    fires = np.concatenate([fires, np.repeat(fires[:, :1], 4, 1)], 1)
    row, col = np.nonzero(fires)
    post, got_on, got_off, share = toxicity.label_model(row, col, n, 16)
    assert ((post > 0.5) == truth).mean() > 0.985
    assert np.abs(got_on - np.append(on, [on[0]] * 4)).max() < 0.06 and np.abs(got_off - np.append(off, [off[0]] * 4)).max() < 0.012
    assert np.allclose(share[[0, 12, 13, 14, 15]], 0.2, atol=0.02) and np.allclose(share[1:12], 1)
    for i in range(0, n, 500):  # posteriors by hand
        log = sum(math.log(got_on[v] / got_off[v]) * share[v] for v in col[row == i]) - (0 if (row == i).any() else toxicity.ABSTAIN)
        p = post.mean()
        assert post[i] == pytest.approx(1 / (1 + math.exp(-log) * (1 - p) / p), abs=0.02)


def test_scores_are_sums_of_terms(spark):
    rows, labels = toxic_rows()
    d, lab = H.documents(spark, [*rows, (9000, "grobold " * 30_000 + "idiot", "", "", 1)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(d, lab)
    weight = dict(zip(model["codes"].tolist(), model["weights"].tolist()))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, lab).collect()}
    for i, t, *_ in [*rows[:60], (9000, "grobold idiot")]:
        words = set(t.lower().split())
        codes = {toxicity.term_code(w) for w in words} | {toxicity.term_code(w[:k], True) for w in words for k in toxicity.PREFIXES if len(w) >= k}
        assert got[i] == pytest.approx(1 / (1 + math.exp(-model["bias"] - sum(weight.get(c, 0.0) for c in codes))))


def test_toxicity_without_labels(spark):
    d = H.documents(spark, [(1, "you idiot", "", "", 1), (2, "you there", "", "", 1)])
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.score_toxicity(d.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@pytest.fixture(scope="module")
def vocab():
    return segment.vocabulary(segment.MODEL)


def segmentations(text, vocab):
    """Every segmentation of a text with its probability."""
    raw = text.encode()
    starts, ends = segment.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), vocab)
    ids = {}
    for i in vocab.id:
        ids.setdefault(vocab.bytes[i], i)

    def of(w):
        return [((), 1.0)] if not w else [((ids[w[:k]], *rest), vocab.weight[ids[w[:k]]] * p) for k in range(1, len(w) + 1) if w[:k] in ids for rest, p in of(w[k:])]

    out = [((), 1.0)]
    for a, b in zip(starts, ends):
        found = of(raw[a:b])
        z = sum(p for _, p in found)
        out = [(x + y, p * q / z) for x, p in out for y, q in found]
    return dict(out)


@pytest.mark.parametrize("text", ["the an", "of it", "hello"])
def test_samples_are_draws_without_replacement(vocab, text):
    exact, n, raw = segmentations(text, vocab), 20000, text.encode()
    data, offsets = np.frombuffer(raw * n, np.uint8), np.arange(n + 1) * len(raw)
    seen = [{}, {}]
    for at, parts in segment.sample_chunk(data, offsets, np.arange(n), 2, vocab):
        for s, (rows, piece, first, total, value, inclusion) in enumerate(parts):
            for r in rows:
                seen[s][r + at] = (tuple(piece[first[r] : first[r + 1]]), total[r], value[r], inclusion[r])
    want = [exact, Counter()]
    for a, b in itertools.permutations(exact, 2):
        want[1][b] += exact[a] * exact[b] / (1 - exact[a])
    for s in (0, 1):
        share = Counter(x[0] for x in seen[s].values())
        assert all(abs(share[x] / n - p) < 5 * math.sqrt(p / n) + 1e-3 for x, p in want[s].items())
        assert all(x[1] == pytest.approx(math.log(exact[x[0]]), abs=1e-9) for x in list(seen[s].values())[:300])
    assert all(seen[0][i][0] != seen[1][i][0] and seen[0][i][2] >= seen[1][i][2] for i in seen[1])
    estimate = np.mean([sum(math.exp(seen[s][i][1] - seen[s][i][3]) for s in (0, 1)) for i in range(n)])
    assert estimate == pytest.approx(1.0, abs=0.02)


TEXTS = ["", None, "a", "\n\n  x", "▁ ▁a", "😀é\x00", "x" * 500, "é" * 300, " " * 70, "The quick brown fox\tjumps.\r\n" * 20, "漢字" * 9000, "a  \n\n  b" * 40, "q" * 20000]


def test_segmentations_decode_exactly(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (2, "a")], "doc_id long, text string").withColumn("sample", F.lit("clash"))
    full = segment.sample_segmentations(d, k=3)
    for r in segment.decode_segmentations(full).collect():
        assert r.text == ("a b" if r.doc_id is None else TEXTS[r.doc_id] or "")
    ids = {}
    for r in full.collect():
        ids.setdefault(r.doc_id, []).append(tuple(r.ids))
        assert r.n_pieces == len(r.ids) and r.n_bytes == len(("a b" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()) and r.log_inclusion <= 0
    assert ids[0] == ids[1] == [()] and len(set(ids[9])) == 3
    assert sorted(map(str, full.collect())) == sorted(map(str, segment.sample_segmentations(d.repartition(5), k=3).collect()))
    assert segment.sample_segmentations(d.limit(0)).collect() == []


def test_units_end_where_no_piece_crosses(vocab):
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdeé漢字の  \n0/.-_AB"), 3000)) + "x" * 400 + "aaaaaaaab" * 60 + "漢字のない" * 80
    raw = text.encode()
    starts, _ = segment.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), vocab)
    pieces = {b for b in vocab.bytes if len(b) > 1}
    longest, spanned = max(map(len, pieces)), set()
    for i in range(len(raw)):
        for k in range(2, longest + 1):
            if raw[i : i + k] in pieces:
                spanned.update(range(i + 1, i + k))
    assert not spanned & set(starts.tolist()) and len(starts) > 500


def test_a_long_unit_is_sampled_whole(vocab):
    """Log-probabilities over a unit far longer than LONG, against masses as exact fractions."""
    raw = b"ab" * 300
    data = np.frombuffer(raw, np.uint8)
    assert len(segment.units(data, np.array([0, len(raw)]), vocab)[0]) == 1
    ids = {}
    for i in vocab.id:
        ids.setdefault(vocab.bytes[i], i)
    weight = {b: Fraction(float(vocab.weight[i])) for b, i in ids.items() if set(b) <= set(b"ab")}
    mass = [Fraction(0)] * len(raw) + [Fraction(1)]
    for i in range(len(raw) - 1, -1, -1):
        mass[i] = sum((w * mass[i + len(b)] for b, w in weight.items() if raw.startswith(b, i)), Fraction(0))
    log = lambda x: math.log(x.numerator) - math.log(x.denominator)
    (_, parts), = segment.sample_chunk(data, np.array([0, len(raw)]), np.array([5]), 3, vocab)
    assert len({tuple(p) for _, p, *_ in parts}) == 3
    for _, piece, _, total, *_ in parts:
        assert b"".join(vocab.bytes[i] for i in piece) == raw
        assert total[0] == pytest.approx(sum(log(weight[vocab.bytes[i]]) for i in piece) - log(mass[0]))


def test_word_hashes_do_not_depend_on_place():
    a, b = np.frombuffer(b"xx hello yy", np.uint8), np.frombuffer(b"hello", np.uint8)
    assert T.span_hashes(a, np.array([3]), np.array([8]))[0] == T.span_hashes(b, np.array([0]), np.array([5]))[0]
    column = pa.array(["ab", None, "", "c"])
    data, offsets = T.flat(column.slice(1))
    assert data.tobytes() == b"c" and offsets.tolist() == [0, 0, 0, 1]


def test_package_as_an_archive(spark):
    path = _shared.ship(spark)
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
    assert "strandline/llm/_text.py" in names and "strandline/__init__.py" in names


def test_registry_names():
    assert [sum(q.startswith(f"op{n}_") for q in registry.QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_pipeline_against_brute_force(spark, tmp_path):
    data = [r for r in H.rows(7) if r[0] is not None]
    data = [r for k, r in enumerate(data) if r[0] not in {q[0] for q in data[:k]}]
    H.documents(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {r[0]: r for r in data}
    quality, near, personal, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    docs = quality(spark, docs, str(tmp_path))
    kept = {i: r for i, r in kept.items() if H.brute_quality(r[1])[-1]}
    assert {r.doc_id for r in docs.collect()} == set(kept) and docs.columns == [c.split()[0] for c in H.SCHEMA.split(", ")]
    docs = near(spark, docs, str(tmp_path))
    root = H.brute_near(list(kept.values()), 5, 80)
    kept = {i: r for i, r in kept.items() if root[i] == i}
    assert {r.doc_id for r in docs.collect()} == set(kept)
    docs = personal(spark, docs, str(tmp_path))
    for r in docs.collect():
        text = kept[r.doc_id][1]
        for k, a, z in sorted(H.brute_personal(text), key=lambda x: -x[1]):
            text = text[:a] + f"[{k.upper()}]" + text[z:]
        assert r.text == text and r.n_chars == len(text)
    whole = {r.doc_id: r.text for r in docs.collect()}
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, block=512).collect()}
    mixed = mix(spark, docs, str(tmp_path)).collect()
    words = Counter()
    for r in mixed:
        assert r.text in whole[r.doc_id]
        words[r.doc_id] += len(H.WORD.findall(r.text))
    assert words == Counter({i: n for i, n in taken.items() if n})
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, segment.decode(r.ids)) for r in last if r["sample"] == 1) == Counter((r.doc_id, r.text) for r in mixed)


def test_stages_on_rows_that_are_hard(spark, tmp_path):
    docs = H.documents(spark, H.rows(9))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() > 0, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = docs if name == corpus_pipeline.STAGES[-1][0] else out.select(*docs.columns)


def test_stages_keep_rows_without_an_id(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    data = [(None, text(k), "en", "ab"[k % 2], 1) for k in range(60)] + [(None, "too short", "en", "a", 1), (None, None, "en", None, 1)]
    data += [(7, text(100), "en", "a", 1), (7, "short too", "en", "a", 1), (8, text(101), "en", "b", 1)]
    quality, _, _, mix, _ = (f for _, f in corpus_pipeline.STAGES)
    docs = H.documents(spark, data)
    want = [(r[0], r[1]) for r in data if H.brute_quality(r[1])[-1]]
    assert len(want) == 62
    kept = quality(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    near = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter((r[0], r[1]) for r in data)  # near-duplicates: no links without an id
    masked = dict(corpus_pipeline.STAGES)["personal data"](spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in masked.collect()) == Counter((r[0], r[1]) for r in data)
    taken = Counter()
    for r in mixing.mix(kept, block=512).collect():
        taken[r.doc_id] += r.taken
    mixed = mix(spark, kept, str(tmp_path)).collect()
    words, texts = Counter(), [r[1] for r in want]
    for r in mixed:
        assert any(r.text in t for t in texts)
        words[r.doc_id] += len(H.WORD.findall(r.text))
    assert words == taken and words[None] > 0
    hard = mix(spark, docs, str(tmp_path)).collect()
    assert all(r.text and H.WORD.search(r.text) for r in hard) and any(r.doc_id is None for r in hard)


def test_shared_folder_is_the_session_s(spark):
    assert _shared.folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Unset:
        class conf:
            @staticmethod
            def get(_key, default=None):
                return default

        class sparkContext:
            applicationId = "unset"
            master = "local[4]"

            @staticmethod
            def getConf():
                return Unset.conf

    assert _shared.folder(Unset) == _shared.folder(Unset) and _shared.folder(Unset).startswith("file://")
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        Unset.sparkContext.master = master
        with pytest.raises(RuntimeError):
            _shared.folder(Unset)

"""Near-duplicates of a five-word similarity, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from codeloom.llm import simhash
from codeloom.llm.common import connected_components


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def word_prints(texts):
    return [fp & (2**64 - 1) for _, fp in simhash.shingle_sets([(t or "").encode() for t in texts])]


def brute_kept(texts, radius=simhash.NEAR):
    """The first text of each class; radius 64: by similarity alone."""
    sets, prints, root = brute_sets(texts), word_prints(texts), list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) and (prints[i] ^ prints[j]).bit_count() <= radius:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [i for i, r in enumerate(root) if r == i]


def copies(rnd):
    """Short texts with copies of which one to four words in sixty are changed: similarities from 0.5 to 1."""
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(words, k=25))
    texts = [None, "", " ", "one", "One", "one two", "x y z", "a b c d e " * 40]
    for _ in range(12):
        base = rnd.choices(words, k=60)
        for _ in range(6):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(60)] = rnd.choice(words)
            texts.append(" ".join(w))
        texts.append(" ".join(base[:20]) + " " + passage)
    return texts


def test_half_masks_cover_every_pair():
    rnd = random.Random(1)
    for radius in (0, 1, 5, 8):
        masks = [m & (2**64 - 1) for m in simhash.half_masks(radius)]
        for _ in range(2000):
            diff = sum(1 << b for b in rnd.sample(range(64), radius))
            assert any(not diff & m for m in masks)
    assert len(simhash.half_masks(8)) == 46


@pytest.mark.parametrize("most", [simhash.MOST, 8])
def test_near_dedup_is_whole(spark, most):
    """Also with buckets that are dealt anew and cut into pieces."""
    texts = copies(random.Random(8))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.near_dedup(df, most=most).collect())
    assert got == brute_kept(texts)
    gone, all_ = len(texts) - len(got), len(texts) - len(brute_kept(texts, 64))
    assert gone >= 0.9 * all_ > 10


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_many_texts_about_the_threshold(spark, block, monkeypatch):
    """Groups in which nearly every pair is a candidate and some are similar: tied, compared in blocks, no link lost."""
    rnd = random.Random(5)
    texts = copies(random.Random(8))
    for _ in range(2):
        base = [f"{rnd.randrange(10**6)}" for _ in range(90)]
        for _ in range(60):
            w = list(base)
            for at in rnd.sample(range(2, 88), rnd.randint(1, 3)):
                w[at] = rnd.choice(["x", "y", "z"])
            texts.append(" ".join(w))
    tied, inner = [], simhash._group_links
    monkeypatch.setattr(simhash, "_group_links", lambda ties, *how: tied.append(ties.count()) or inner(ties, *how))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.near_dedup(df, partners=2, block=block).collect())
    assert got == brute_kept(texts)
    sets = brute_sets(texts)[-120:]
    alike = sum(5 * len(a & b) >= 4 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert 50 < alike < 1000 and tied[0] >= 50


def test_common_shingles():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, top, rng.integers(0, 60)).astype(np.uint64)) for top in rng.choice([20, 3000], 90)]
    left, right = sets[:40], sets[40:]
    got = simhash.common_shingles(left, right)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert simhash.common_shingles([sets[0][:0]], [sets[1][:0]]).tolist() == [[0]]


def test_parities_leave_out_no_similar_pair():
    rnd = random.Random(4)
    for _ in range(300):
        a = rnd.sample(range(10**6), rnd.randint(1, 400))
        b = a[rnd.randint(0, 3) :] + rnd.sample(range(10**6, 2 * 10**6), rnd.randint(0, 9))
        pair = [simhash.run_hashes(np.array(sorted(x), np.uint64), 1) for x in (a, b)]
        apart = sum(int(x).bit_count() for x in (simhash.parities(pair[0]) ^ simhash.parities(pair[1])).view(np.uint64))
        assert apart <= len(set(a) ^ set(b))


def test_same_words_in_other_orders(spark):
    """One fingerprint, many sets of shingles: only similar ones are linked, whatever the bucket."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        rnd.shuffle(words)
        texts += [" ".join(words), " ".join(words[1:] + words[:1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(df, most=6).collect()) == brute_kept(texts)


def test_recall_on_documents(spark):
    """Texts that exact five-word similarity links: at least 0.9 of those that it removes are removed."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").dropDuplicates(["text"]).where("text <> ''")
    rows = sorted(docs.select("doc_id", "text").collect())
    sets = brute_sets([r.text for r in rows])
    often = Counter(g for s in sets for g in s)
    first = defaultdict(list)
    for k, s in enumerate(sets):  # pairs of 0.8 share one of the rarest fifth
        for g in sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-4 * len(s) // 5) + 1]:
            first[g].append(k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for m in first.values() for b in m for a in m if a < b}:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {r.doc_id for k, r in enumerate(rows) if find(k) != k}
    gone = {r.doc_id for r in rows} - {r.doc_id for r in simhash.near_dedup(docs).collect()}
    assert gone <= want and len(gone) >= 0.9 * len(want) > 30


def test_stage_takes_similar_texts_beyond_three_bits(spark):
    texts = copies(random.Random(9))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == brute_kept(texts)


def test_ids_nulls_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "p q"), (4, "a b c"), (4, "a b c"), (4, "other"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in simhash.near_dedup(df).collect())
    assert got == [("2", "None"), ("4", "a b c"), ("4", "other"), ("None", "p q")]
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_components_alike_by_one_task_and_by_rounds(spark):
    """Chains, stars, repeated and self links and null ends, of numbers and of strings."""
    rnd = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 140)] + [(9, k) for k in range(10, 30)] + [(rnd.randrange(-300, 0), rnd.randrange(-300, 0)) for _ in range(120)]
    edges += edges[:5] + [(7, 7), (None, 3), (4, None)]
    for kind, of in (("long", lambda x: x), ("string", lambda x: None if x is None else f"n{x}")):
        df = spark.createDataFrame([(of(a), of(b)) for a, b in edges], f"a {kind}, b {kind}")
        one, rounds = (sorted(map(tuple, connected_components(df, small=n).collect())) for n in (10**6, 0))
        assert one == rounds and len({r for _, r in one}) > 2
    assert connected_components(df.limit(0)).count() == 0

"""Substring dedup: FM-index, and whole results against brute force."""

import random
import re

import numpy as np
import pytest

from codeloom.llm import substring


def words(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]


def brute(docs, n=20):
    """docs in order of id; rows with the same id and text are one document."""
    seen, out = {}, []
    for i, t in docs:
        w, gone = words(t), set()
        for s in range(len(w) - n + 1):
            first = seen.setdefault(tuple(w[s : s + n]), (i, s))
            if first != (i, s):
                gone |= set(range(s, s + n))
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def texts():
    rnd = random.Random(11)
    some = [None, "", " \n", "one two", "a b " * 3000, "x" * 4000, " ".join(f"u{i}" for i in range(19)), "é " * 45]
    passages = [[rnd.choice("abcdefghij") + str(rnd.randint(0, 30)) for _ in range(rnd.randint(15, 70))] for _ in range(6)]
    for _ in range(60):
        w = []
        for _ in range(rnd.randint(1, 4)):
            w += [f"r{rnd.random()}" for _ in range(rnd.randint(0, 25))]
            p = list(rnd.choice(passages))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = f"edit{rnd.random()}"
            w += p
        some.append((" " if rnd.random() < 0.5 else "\n\t ").join(w))
    for _ in range(20):  # few words, many ties
        some.append(" ".join(rnd.choices("ab", k=rnd.randint(18, 90))))
    return some


@pytest.mark.parametrize("most,tokens", [(20_000, 1 << 19), (0, 1 << 19), (3, 200)])
def test_whole_results(spark, most, tokens):
    docs = list(enumerate(texts()))
    docs += [docs[20], docs[30]]
    df = spark.createDataFrame([(*d, "clash", 3) for d in docs], "doc_id long, text string, anchor string, n_words int").repartition(5)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.dedup(df, most=most, tokens=tokens).collect())
    assert got == brute(sorted(docs, key=lambda d: d[0]))
    assert sum(g[2] for g in got) > 1000


def test_null_ids_string_ids_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), ("b", t), ("a", t + " more")], "doc_id string, text string")
    got = {r.doc_id: r.n_removed for r in substring.dedup(df).collect()}
    assert got == {None: 0, "a": 0, "b": 30}
    assert substring.dedup(df.limit(0)).count() == 0


def test_fm_index_counts_and_finds():
    rnd = np.random.default_rng(2)
    text = np.concatenate([rnd.integers(1, 5, 300), [0], rnd.integers(1, 5, 200), [0]])
    index = substring.FMIndex(text, 5, 8)
    for _ in range(200):
        p = rnd.integers(1, 5, rnd.integers(1, 8))
        low, high = np.zeros(1, np.int64), np.full(1, len(text), np.int64)
        for c in p[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.suffixes[low[0] : high[0]]) == want


def test_equal_windows_share_anchor_offsets():
    rnd = random.Random(3)
    w = np.array([rnd.randint(0, 3) for _ in range(400)], np.uint64)
    anchor, place = substring.anchors(w, 20)
    seen = {}
    for s in range(len(anchor)):
        key = w[s : s + 20].tobytes()
        assert seen.setdefault(key, (anchor[s], place[s] - s)) == (anchor[s], place[s] - s)

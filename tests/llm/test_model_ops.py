"""Language identification, decontamination and mixing."""

import random
import re
from collections import Counter

import pytest

from codeloom.llm import decontam, langid, mixing

DATA = "/root/testdata/sf0.01"


def docs_of(spark, data):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in data], "doc_id long, text string, lang string, source string, lang_pred string, score double")


def test_langid_held_out_accuracy(spark):
    from codeloom.llm.langid import op2_language_id

    out = op2_language_id(spark, DATA)
    both = out.join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(both) > 250
    assert sum(r.lang == r.lang_pred for r in both) / len(both) > 0.95
    assert all(0 <= r.score <= 1 for r in both)


def test_langid_edges(spark):
    train = [(i, f"the cat and the hat of number {i} " * 9, "en", "s") if i % 2 else (i, f"der hund und die katze von nummer {i} " * 9, "de", "s") for i in range(200)]
    odd = [(500, None, None, "s"), (501, "", "en", None), (502, "123 !! 456", "en", "s"), (503, "der hund und die katze", None, "s"), (None, "the cat and the hat", "en", "s"), (504, "the cat and the hat of it " * 20000, "en", "s"), (504, "the cat and the hat of it", "en", "s")]
    docs = docs_of(spark, train + odd)
    model = langid.train(docs, per_lang=50, steps=150)
    got = [(r.doc_id, r.lang_pred) for r in langid.classify(docs, model).where("doc_id >= 500 or doc_id is null").collect()]
    assert sorted(got, key=str) == sorted([(500, "und"), (501, "und"), (502, "und"), (503, "de"), (None, "en"), (504, "en"), (504, "en")], key=str)
    assert langid.train(docs.where("lang is null")) is None
    assert {r.lang_pred for r in langid.classify(docs, None).collect()} == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.where("doc_id >= 500").collect()} == {503, 504}
    assert langid.keep_identified(docs.limit(0)).count() == 0


def test_langid_learns_every_language(spark):
    """250 languages, more than the sample has rows for at its usual size; ids that repeat."""
    data = [(i % 40, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} " * 30 + str(k), f"l{i:03d}", "s") for i in range(250) for k in range(3)]
    docs = docs_of(spark, data)
    model = langid.train(docs, per_lang=50, most_rows=10, steps=5)
    assert len(model.langs) == 250


def test_langid_reads_the_whole_text(spark):
    train = [(i, ("the cat and the hat " if i % 2 else "der hund und die katze ") * 9, "en" if i % 2 else "de", "s") for i in range(200)]
    docs = docs_of(spark, train + [(900, "the cat and the hat " * 20 + "der hund und die katze " * 400, None, "s")])
    got = langid.classify(docs, langid.train(docs, steps=150)).where("doc_id = 900").first()
    assert got.lang_pred == "de" and 0.5 < got.score < 1


def fold(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if re.match(r"[!-/:-@\[-`{-~]", c) else c for c in t or "")
    return [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]


def brute_contaminated(docs, items, least=0.8):
    out = set()
    for d, t in docs:
        w = fold(t)
        for k, it in items:
            q = fold(it)
            if not q or not w:
                continue
            width, n = min(5, len(q)), min(len(q), len(w))
            bag = Counter(tuple(q[i : i + width]) for i in range(len(q) - width + 1))
            for s in range(len(w) - n + 1):
                x = w[s : s + n]
                own = Counter(tuple(x[i : i + width]) for i in range(len(x) - width + 1))
                both = (bag & own).total()
                if both and both / (bag.total() + own.total() - both) >= least:
                    out.add((d, k))
                    break
    return out


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 5, 12, 30, 60])))) for k in range(25)] + [(90, None), (91, ""), (92, " .. "), (None, "w1 w2 w3 w4 w5 w6")]
    items.append((93, items[7][1]))  # two ids of one text
    docs = [(i, t) for i, t in enumerate([None, "", "  \n", "w1", "w5 " * 20000])]
    for i in range(10, 90):
        own = rnd.choices(words, k=rnd.randint(0, 120))
        q = (rnd.choice(items[:25])[1]).split()
        for _ in range(rnd.randint(0, 3)):
            q[rnd.randrange(len(q))] = rnd.choice(words)
        at = rnd.randint(0, len(own))
        docs.append((i, " ".join(own[:at] + [x.upper() + "," for x in q] + own[at:])))
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contaminated(docs, items)
    for most in (16 << 20, 700):  # in one block and in many
        got = [(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, most_bytes=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    kept = decontam.decontaminate(df, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} and kept.columns == df.columns
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_multi_index_finds_all_within_radius():
    """All items of the size within the radius, and few of the others as candidates."""
    import numpy as np

    rnd = np.random.default_rng(1)
    items = [(k, " ".join(f"x{v}" for v in rnd.integers(0, 9, 20))) for k in range(600)]
    index = decontam.Index(items)
    probes = rnd.integers(0, 2**63, 200).astype(np.uint64)
    for k in range(100):  # some within the radius of an item
        probes[k] = index.prints[k] ^ np.uint64(sum(1 << int(b) for b in rnd.permutation(64)[: k % 18]))
    want = {(a, k) for a, p in enumerate(probes.tolist()) for k in range(600) if (p ^ int(index.prints[k])).bit_count() <= 15}
    at, item = index.items_near(20, probes)
    assert set(zip(at.tolist(), item.tolist())) == want and len(want) > 80
    index.candidates = index.compared = 0
    index.items_near(20, probes[100:])
    assert index.candidates < 0.05 * index.compared == 0.05 * 60_000


def test_windows_of_a_repeated_shingle_are_ranges():
    import numpy as np

    places = np.arange(5, 200_000)
    got = np.concatenate(list(decontam._pieces(np.maximum(0, places - 40), places + 1, 50)))
    assert (got == np.arange(0, 200_000)).all()
    rnd = np.random.default_rng(3)
    for _ in range(50):
        low = np.sort(rnd.integers(0, 500, 20))
        high = low + rnd.integers(1, 30)
        assert np.concatenate(list(decontam._pieces(low, high, 10))).tolist() == sorted({x for a, z in zip(low, high) for x in range(a, z)})


def test_budgets_redistribute_among_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 50), ("b", "en", "s4", 2000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.alloc for r in mixing.budgets(leaves, 1000, {"domain": {}, "lang": {}, "source": {}}, 1).collect()}
    assert got == {"s1": 10, "s2": 440, "s3": 50, "s4": 500}  # what s1 and s3 lack stays in domain a
    got = {r.source: r.alloc for r in mixing.budgets(leaves, 2800, {"domain": {"a": 1, "b": 1}, "lang": {}, "source": {}}, 1).collect()}
    assert got == {"s1": 10, "s2": 1000, "s3": 50, "s4": 1740}  # domain a is used up
    got = {r.source: r.alloc for r in mixing.budgets(leaves, 600, {"domain": {"b": 0}, "lang": {}, "source": {}}, 1).collect()}
    assert got == {"s1": 10, "s2": 540, "s3": 50}


@pytest.mark.parametrize("zero", [{"source": {"src0": 0}}, {"lang": {"en": 0}}, {"domain": {"d0": 0}}, {"source": {"src0": 0, "src1": 0, "src2": 0}, "lang": {"de": 0}}])
def test_weight_zero_at_any_level_loses_no_budget(spark, zero):
    import duckdb

    docs = [(i, "w " * (i % 7 + 1), ["en", "de", None][i % 3], f"src{i % 4}") for i in range(360)]
    weights = {"domain": {}, "lang": {}, "source": {}} | zero
    for few in (mixing.FEW_LEAVES, -1):
        had, mixing.FEW_LEAVES = mixing.FEW_LEAVES, few
        got = sorted(tuple(r) for r in mixing.select(docs_of(spark, docs), 0.4, weights).collect())
        mixing.FEW_LEAVES = had
        db = duckdb.connect()
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", docs)
        sql = "WITH " + mixing.oracle(share=0.4, weights=(weights["domain"], weights["lang"], weights["source"])).lstrip() + " SELECT doc_id, domain, lang, source, n_tokens, epoch FROM mixed"
        assert got == sorted(db.execute(sql).fetchall())
    total = sum(len(d[1].split()) for d in docs)
    assert sum(r[4] for r in got) > 0.4 * total - 8 * 12
    leaves = spark.createDataFrame([("d0", "en", "src0", 1000), ("d1", "en", "src1", 1000)], "domain string, lang string, source string, tokens long")
    assert {r.source: r.alloc for r in mixing.budgets(leaves, 1000, {"domain": {}, "lang": {}, "source": {"src0": 0}}, 1).collect()} == {"src1": 1000}


@pytest.mark.parametrize("share", [0.3, 2.5])
def test_selection_is_a_prefix_of_each_epoch(spark, share):
    rnd = random.Random(9)
    data = [(i, " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", "odd", None])) for i in range(400)]
    data += [(7, "same id again", "en", "src0"), (None, "no id here", "en", "src0"), (1000, None, "en", "src0"), (1001, "word " * 9000, "en", "src0")]
    docs = docs_of(spark, data)
    leaves = docs.select("*")
    rows = mixing.select(leaves, share).collect()
    total = sum(len((d[1] or "").split()) for d in data)
    assert rows and sum(r.n_tokens for r in rows) <= share * total
    assert all(r.n_tokens > 0 and 0 <= r.epoch < mixing.MAX_EPOCHS for r in rows)
    again = Counter(tuple(r) for r in mixing.select(leaves.repartition(7), share).collect())
    assert again == Counter(tuple(r) for r in rows)
    for r in rows:  # an epoch starts only when the last is whole
        if r.epoch:
            assert any(x.doc_id == r.doc_id and x.epoch == r.epoch - 1 for x in rows)
    assert mixing.select(docs.limit(0), share).count() == 0


def test_decontamination_judges_rows_not_ids(spark):
    """Rows without an id are judged too, and clean rows of a shared id stay."""
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(None, item), (None, "clean"), (1, "x " + item), (1, "also clean"), (2, None)], "doc_id long, text string")
    for most in (16 << 20, 10):
        got = decontam.decontaminate(df, bench, most_bytes=most).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("1", "also clean"), ("2", "None"), ("None", "clean")]

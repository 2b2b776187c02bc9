"""SimHash, personal data, quality rules and line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from codeloom.llm import common, linededup, pii, quality, simhash

EDGE = [None, "", " \n\t ", "one", "one two", "a b c d e " * 40, "x" * 5000, "word " * 30000, "Ünï cödé — ümläut nbsp"]


def rows(spark, texts, extra=True):
    data = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, fp string, kept int")


def brute_fp(text):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_masks_cover_every_pair():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(3)]
    rnd = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3)))
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("most", [1024, 3])
def test_simhash_classes(spark, most):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=120)) for _ in range(6)]
    texts = list(EDGE)
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(" ".join(w))
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.classes(rows(spark, texts), most=most).collect())
    fps = [brute_fp(t) for t in texts]
    assert [g[1] for g in got] == fps
    assert [g[2] for g in got] == brute_classes(fps)


def test_simhash_links_with_deep_buckets(spark):
    """Buckets over `most` are dealt anew down to FREE bits and lose no link."""
    rnd = random.Random(5)
    fps = list({(0x0F0F << 40) | sum(1 << b for b in rnd.sample(range(20), rnd.randint(0, 6))) for _ in range(250)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(df, 3, 8).collect()]
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert (find(a) == find(b)) or root.__setitem__(max(find(a), find(b)), min(find(a), find(b))) is None
    want = brute_classes(fps)
    assert len({find(x) for x in fps}) == len(set(want))


def test_simhash_ties_nulls_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.classes(df).collect()}
    assert got == {(None, 4), (None, 2), (4, 4), (2, 2)}
    assert simhash.classes(df.limit(0)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text or "", re.ASCII):
            d = re.sub(r"[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "phone" and not 10 <= len(d) <= 15 or k == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)):
                continue
            out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_pii_base_spans_match_patterns():
    rnd = random.Random(2)
    auto = pii.automaton()
    for _ in range(6000):
        t = "".join(rnd.choices(["@", ".", "+", "a", "B-", "1", "23", "255", " ", "(", ")", "-", "4539578763621486", "é", "x.y", "\n", "%_"], k=rnd.randint(0, 40)))
        assert [s for s in pii.spans(t, auto) if s[0] in pii.BASE] == brute_spans(t), t


def iban_of(country, body):
    """An IBAN with its check digits."""
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def brute_ibans(text):
    """Every place where a valid IBAN of its country's length stands between other characters, spaces within allowed singly."""
    out = set()
    for start in range(len(text)):
        size = pii.IBAN_SIZES.get(text[start : start + 2])
        if size is None or start and text[start - 1].isalnum():
            continue
        flat, at = "", start
        while at < len(text) and len(flat) < size:
            if re.match("[A-Z0-9]", text[at]):
                flat += text[at]
            elif not (text[at] == " " and text[at - 1] != " " and len(flat) >= 4):
                break
            at += 1
        if len(flat) == size and flat[2:4].isdigit() and not text[at : at + 1].isalnum() and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
            out.add((start, at))
    return out


def test_pii_ibans_match_brute_force():
    rnd, auto = random.Random(12), pii.automaton()
    good = [iban_of("DE", "370400440532013000"), iban_of("NO", "86011117947"), iban_of("GB", "WEST12345698765432"), iban_of("MT", "MALT011000012345MTLCAST001S")]
    spaced = [" ".join(x[k : k + 4] for k in range(0, len(x), 4)) for x in good]
    parts = [*good, *spaced, " ", " OK", "X", "7", ", ", "é", "DE", "iban ", "\n", good[0][:-1] + "1"]
    found = 0
    for _ in range(4000):
        t = "".join(rnd.choices(parts, k=rnd.randint(1, 6)))
        want = brute_ibans(t)
        assert {(a, z) for k, a, z in pii.spans(t, auto) if k == "iban"} == want, t
        found += len(want)
    assert found > 1000


def test_pii_secrets():
    auto = pii.automaton()
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    holds = {
        f'the token = "{key}" here': key, f"API_KEY={key}": key, "password: 'correct-horse'": "correct-horse", "x AKIA" + "Q" * 16 + " y": "AKIA" + "Q" * 16, "ghp_" + "a1" * 18: "ghp_" + "a1" * 18,
        "client_secret => abcd1234efgh": "abcd1234efgh", '"Token": "abc def", "pwd": "hunter22"': "hunter22", "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----": "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----",
    }
    for t, want in holds.items():
        assert [t[a:z] for k, a, z in pii.spans(t, auto) if k == "secret"] == [want], t
    for t in ("the token of love: friendship", "no password here", "secret: everlasting", "tokens = ", "AKIA12", "a secretary = 12345678a", "xghp_" + "a1" * 18):
        assert not [s for s in pii.spans(t, auto) if s[0] == "secret"], t


def test_pii_rows(spark):
    t = "é mail bob.x+1@mail.example.com, 10.0.0.255 or 10.0.0.256; card 4539 5787 6362 1486, +1 (017) 555-7713. IBAN: DE89 3704 0044 0532 0130 00 OK. https://me:pw@h.example/x account no 12345678"
    got = {r.doc_id: r.spans for r in pii.find(rows(spark, [*EDGE, t])).collect()}
    assert all(got[i] == [] for i in range(len(EDGE)))
    assert [(s.kind, t[s.start : s.end]) for s in got[len(EDGE)]][:4] == [("email", "bob.x+1@mail.example.com"), ("ip", "10.0.0.255"), ("card", "4539 5787 6362 1486"), ("phone", "+1 (017) 555-7713")]
    assert {"iban", "url", "account"} <= {s.kind for s in got[len(EDGE)]}
    red = {r.doc_id: r.text for r in pii.redact(rows(spark, [*EDGE, t])).collect()}
    assert red[0] is None and "[EMAIL]" in red[len(EDGE)] and "bob" not in red[len(EDGE)]


def brute_quality(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = {}
    for g in grams:
        n[g] = n.get(g, 0) + 1
    cov = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cov)


def test_quality_ledger(spark):
    rnd = random.Random(4)
    texts = EDGE + ["".join(rnd.choices(["a ", "b ", "c\n", "#", "dd ", "\n"], k=rnd.randint(0, 60))) for _ in range(60)]
    led = quality.ledger(rows(spark, texts))
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in led.collect())
    assert got == [(i, *brute_quality(t)) for i, t in enumerate(texts)]
    assert "Python" not in led._jdf.queryExecution().toString() and "Exchange" not in led._jdf.queryExecution().toString()
    kept = {r.doc_id: (r.fail_bits, r.kept) for r in quality.apply_policy(led).collect()}
    ab = {r.rule: r for r in quality.ablation(led).collect()}
    for rule in quality.RULES:
        assert ab[rule.name].n_failed == sum(f >> rule.bit & 1 for f, _ in kept.values())
        assert ab[rule.name].n_only_this == sum(f == 1 << rule.bit for f, _ in kept.values())
    assert {r.n_docs for r in quality.ablation(led.limit(0)).collect()} == {0}


def brute_lines(texts):
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        lines, keep = t.split("\n"), []
        for s, e in linededup.chunks_of(t):
            c = "\n".join(lines[s:e])
            if e - s >= 2 and c in seen:
                continue
            if e - s >= 2:
                seen.add(c)
            keep += lines[s:e]
        out.append("\n".join(keep))
    return out


def test_line_dedup(spark):
    rnd = random.Random(6)
    block = "\n".join(f"shared line {i}" for i in range(12))
    texts = [x for x in EDGE if x != EDGE[-2]]
    for i in range(20):
        own = "\n".join(f"own {i} {rnd.random()}" for _ in range(6))
        texts.append(own + "\n" + block + "\n" + own[::-1])
    texts += [texts[-1], block]
    got = {r.doc_id: r for r in linededup.remove(rows(spark, texts)).collect()}
    want = brute_lines(texts)
    assert [got[i].text for i in range(len(texts))] == want
    assert [got[i].fp for i in range(len(texts))] == ["clash"] * len(texts)
    assert sum(got[i]["__cl_gone"] for i in got) > 60
    assert linededup.remove(rows(spark, texts).limit(0)).count() == 0


def test_line_dedup_null_and_repeated_ids(spark):
    b = "\n".join(f"line {i}" for i in range(8))
    df = spark.createDataFrame([(None, b), (1, b), (1, b), (2, b + "\nmore")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in linededup.remove(df).collect())
    assert got[-1] == ("None", b) and [t for i, t in got if i == "1"] == [b, b]  # the same id and text: one document


def test_boundaries_resist_shifts():
    lines = [f"line {i} {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(80)]
    a = {"\n".join(lines[s:e]) for s, e in linededup.chunks_of("\n".join(lines))}
    moved = ["new first line", *lines]
    b = {"\n".join(moved[s:e]) for s, e in linededup.chunks_of("\n".join(moved))}
    assert len(a - b) <= 2


def test_line_dedup_recall(spark):
    """The share of lines in repeated runs (two lines or more, seen in an earlier text) that goes."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["text"]).where("text <> ''")
    seen, run = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        lines = r.text.split("\n")
        pairs = list(zip(lines, lines[1:]))
        run[r.doc_id] = len({i + k for i, p in enumerate(pairs) if p in seen for k in (0, 1)})
        seen.update(pairs)
    gone = {r.doc_id: r["__cl_gone"] for r in linededup.remove(docs).collect()}
    assert sum(gone.values()) > 0.5 * sum(run.values()) > 50
    cut = linededup.chunks_of("\n".join(f"line {i}" for i in range(500)))
    assert {e - s for s, e in cut} <= {2, 3} and linededup.chunks_of("one") == [(0, 1)]


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    rnd = random.Random(6)
    for size in (0, 1, 30, 400):
        text = "".join(rnd.choice("ab  \n") for _ in range(size)).encode() + b" " + b"x" * rnd.choice([0, 70]) + b" y"
        raw, _ = common.joined([text])
        monkeypatch.setattr(common, "PIECE", 1 << 19)
        whole = common.word_hashes(raw)
        assert [bytes(raw[a:z]) for a, z in zip(whole[0], whole[1])] == text.split()
        runs = common.run_hashes(whole[2], 3)
        for piece in (1, 7, 64):
            monkeypatch.setattr(common, "PIECE", piece)
            assert all(np.array_equal(x, y) for x, y in zip(common.word_hashes(raw), whole))
            assert np.array_equal(common.run_hashes(whole[2], 3), runs)

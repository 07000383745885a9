"""Operators 11 to 13 against brute force: token alignment, benchmark decontamination, periodic runs."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cograph.llm import alignment, decontamination, queries, runs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_a long, digest string, spans string, start long, tally boolean, window string"
PLAIN = [(1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, "word " * 30_000), (6, "One two three four five six."), (6, "One two three four five six."),
         (None, "One two three four five six."), (7, "日本語 🙂 <|endoftext|> <s> \x1c\xa0x é"), (8, "with ▁ inside"), (9, "a" * 20_000), (10, "\x00 tab\tnew\r\nline")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, True, "z") for i, t in PLAIN], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- 11
def token_bytes(text):
    """(ids, bytes) of both sides by the libraries' own calls; none where the bytes are not those of space + text."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    model = SentencePieceProcessor(model_file=B)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = []
    for x in text:
        a = [(i, bytes(byte_of[c] for c in t.id_to_token(i))) for i in t.encode(" " + x, add_special_tokens=False).ids] if x else []
        names = [(i, model.id_to_piece(i)) for i in model.encode(x)] if x else []
        b = [(i, bytes([int(n[3:5], 16)]) if re.fullmatch("<0x..>", n) else n.replace("▁", " ").encode()) for i, n in names]
        same = b"".join(y for _, y in a) == b"".join(y for _, y in b) == (" " + (x or "")).encode()
        out.append((a, b) if same else ([], []))
    return out


def brute_alignment(texts):
    rows, counts = [], collections.Counter()
    for a, b in token_bytes(texts):
        span = lambda side: [(sum(len(y) for _, y in side[:k]), sum(len(y) for _, y in side[: k + 1])) for k in range(len(side))]
        sa, sb = span(a), span(b)
        overlaps = {(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]}
        links = [(a[i][0], b[j][0]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[1] == y[1]]
        counts.update(links)
        cuts, groups, at = sorted({x[1] for x in sa} & {y[1] for y in sb}), [], 0
        for cut in cuts:
            groups.append(([a[i][0] for i, x in enumerate(sa) if at < x[1] <= cut], [b[j][0] for j, y in enumerate(sb) if at < y[1] <= cut]))
            at = cut
        rows.append((len(a), len(b), groups, overlaps, links))
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(highest.get(j, 0), n)
    text = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [(na, nb, len(g), len(li), sum(counts[x] == highest[x[1]] for x in li), sum(counts[x] for x in li), hashlib.sha256(text(g).encode()).hexdigest() if na else "", g, o)
            for na, nb, g, o, li in rows]


def test_alignment_against_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "internationalisation", "étude", "日本", "x1y2", "...", "don't", "  ", "\n", "🙂", "Straße", "<s>", "<|endoftext|>", "tion", "über"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "", "-"]) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), A, B, with_groups=True).collect()
    expected = dict(zip([r[0] for r in rows], brute_alignment([r[1] for r in rows]), strict=True))
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    for r in got:
        e = expected[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == e[:7]
        assert [(g.a, g.b) for g in r.groups] == e[7]
        assert {(o.a, o.b) for o in r.overlaps} == e[8] and r.n_overlaps == len(r.overlaps) == len(e[8])


def test_alignment_awkward_rows(awkward, empty):
    small = [(i, t) for i, t in PLAIN if not t or len(t) < 1_000]
    expected = sorted((str(i), *row[:4]) for (i, _), row in zip(small, brute_alignment([t for _, t in small]), strict=True))
    got = alignment.align(awkward, A, B).collect()
    assert len(got) == len(PLAIN)
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links) for r in got if r.doc_id not in (5, 9)) == expected
    by_id = {r.doc_id: r for r in got}
    for i in (1, 2, 8):  # null, empty, and a text that the pieces do not give back
        assert tuple(by_id[i])[1:] == (0, 0, 0, 0, 0, 0, 0, "")
    assert by_id[5].n_a == by_id[5].n_b == 30_001 and by_id[5].n_groups == 30_001
    assert alignment.align(empty, A, B, with_groups=True).collect() == []


def test_linkable_pairs_are_those_with_a_common_end():
    pairs, names_a, names_b = alignment.linkable(A, B), alignment._byte_level(A), alignment._pieces(B)
    rng = random.Random(1)
    for code in rng.sample(pairs.tolist(), 500):
        x, y = names_a[code // len(names_b)], names_b[code % len(names_b)]
        assert x and y and (x.endswith(y) or y.endswith(x))
    for i in rng.sample(range(len(names_a)), 20):
        expected = {i * len(names_b) + j for j, y in enumerate(names_b) if y and names_a[i] and (names_a[i].endswith(y) or y.endswith(names_a[i]))}
        assert {c for c in pairs.tolist() if c // len(names_b) == i} == expected


# ---------------------------------------------------------------- 12
def brute_words(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m.group()) + 32), text or "")
    return [(m.group(), m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute_scan(text, items, width=10):
    w, hit, found = [x for x, _ in brute_words(text)], set(), set()
    for item, t in items:
        v = [x for x, _ in brute_words(t)]
        n = min(width, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit.update(range(i, i + n))
                    found |= {str(item)} - {"None"}
    return len(w), hit, sorted(found)


ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two"), (2, "also one"), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
         (3, None), (4, ""), (5, "..."), (6, "Ünï çode"), (None, "nameless passage"), (7, "one two")]


def scan_texts():
    rng = random.Random(5)
    pool = ["alpha", "beta", "ONE", "two", "also", "Ünï", "çode", "nameless", "passage", "other", "ünï", "zeta"]
    long = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    made = [" ".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(40)]
    return [*made, long, f"x_{long.replace(' ', '--')}!", f"{long} {long}", "one-two one two", "(one) two. rest", *[f"word {long[: rng.randint(10, 60)]}" for _ in range(5)]]


def test_scan_and_remove_against_brute_force(spark):
    texts = scan_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.scan(docs, items).collect()}
    clean = {r.doc_id: r.text for r in decontamination.remove(docs, items).collect()}
    whole = {r.doc_id for r in decontamination.remove(docs, items, documents=True).collect()}
    assert len(got) == len(clean) == len(texts)
    for i, text in enumerate(texts):
        n, hit, found = brute_scan(text, ITEMS)
        r = got[i]
        assert (r.n_words, r.n_hit, r.items) == (n, len(hit), found)
        covered = [j for s in r.spans for j in range(s.start, s.end)]
        assert covered == sorted(hit) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        spans, out, at = [x for _, x in brute_words(text)], "", 0
        for s in r.spans:
            out, at = out + text[at : spans[s.start][0]] + " ", spans[s.end - 1][1]
        assert clean[i] == out + text[at:]
        assert (i in whole) == (not hit)


def test_scan_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(scan_texts())), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = lambda: sorted(map(str, decontamination.scan(docs, items).collect()))
    near = rows()
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    assert rows() == near


def test_scan_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame(ITEMS + [(8, "one two three four"), (9, "word")], "item_id long, text string")
    got = decontamination.scan(awkward, items).collect()
    assert len(got) == len(PLAIN)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_words == by_id[2].n_words == by_id[3].n_hit == 0 and by_id[1].items == []
    assert (by_id[5].n_words, by_id[5].n_hit, by_id[5].items) == (30_000, 30_000, ["9"])
    assert [(r.n_hit, r.items) for r in got if r.text and r.text.startswith("One two")] == [(4, ["2", "7", "8"])] * 3
    assert decontamination.scan(empty, items).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r.items == [] for r in decontamination.scan(awkward, none).collect())


# ---------------------------------------------------------------- 13
def brute_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng, n, kinds):
    w = [str(rng.randrange(kinds)) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(n)] = "x"
    return w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_brute_force(spark, least):
    rng = random.Random(least)
    rows = [(i, periodic_words(rng, rng.choice([0, 1, 5, 11, 12, 13, 30, 80, 200]), rng.choice([1, 2, 3, 5, 40]))) for i in range(400)]
    docs = spark.createDataFrame([(i, rng.choice([" ", "  ", "\n", "\t "]).join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in runs.find_runs(docs, least).collect()}
    for i, w in rows:
        expected = brute_runs(w, least)
        assert [tuple(x) for x in got[i].runs] == expected
        dropped = {k for s, n, q in expected for k in range(s + q, s + n)}
        assert got[i].collapsed == " ".join(x for k, x in enumerate(w) if k not in dropped) and got[i].n_words == len(w)


def test_runs_of_fibonacci_words_and_odd_squares():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    odd = ([b"a", b"b"] * 60 + [b"a"]) * 2 + [b"c"]
    rows, counts, _ = runs._rows([b, odd], 12)
    assert [tuple(r) for r in rows[: counts[0]].tolist()] == brute_runs(b)
    assert [tuple(r) for r in rows[counts[0] :].tolist()] == brute_runs(odd)


def test_successor_of_ranges():
    import numpy as np

    rng = np.random.default_rng(2)
    values = rng.permutation(5_000)[:900]
    tree = runs.WaveletTree(values)
    lo, hi = np.sort(rng.integers(0, 901, (2, 400)), axis=0)
    least = rng.integers(0, 9_000, 400)
    expected = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(lo, hi, least, strict=True)]
    assert tree.successor(lo, hi, least).tolist() == expected


def test_runs_awkward_rows(awkward, empty):
    got = runs.find_runs(awkward).collect()
    assert len(got) == len(PLAIN)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].n_words == 0 and by_id[i].runs == [] and by_id[i].collapsed == "" for i in (1, 2, 3))
    assert [tuple(x) for x in by_id[5].runs] == [(0, 30_000, 1)] and by_id[5].collapsed == "word"
    assert by_id[7].collapsed == "日本語 🙂 <|endoftext|> <s> \x1c\xa0x é"
    assert runs.find_runs(empty).collect() == []


def test_period_query_digests(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(periodic_words(rng, rng.choice([0, 3, 50, 120]), rng.choice([2, 30])))) for i in range(150)] + [(None, "a b"), (500, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_period_runs(spark, str(tmp_path)).collect()}
    chosen = 0
    for i, text in rows:
        w, h = (text or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            chosen += 1
            a, g = (h // 10) % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        expected, r = brute_runs(w), got[i]
        dropped = {k for s, n, q in expected for k in range(s + q, s + n)}
        assert r.n_runs == len(expected)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in expected).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in dropped).encode()).hexdigest()
        top = min(expected, key=lambda x: (-x[1], x[0], x[2])) if expected else (None, None, None)
        assert (r.start, r.length, r.period) == top and r.exponent_milli == (1000 * top[1] // top[2] if expected else None)
    assert chosen > 5


def test_queries_of_new_operators_have_contract_columns(spark):
    d = "/root/testdata/sf0.001"
    assert queries.op11_token_alignment(spark, d).dtypes[:8] == [(c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", "string")]
    assert dict(queries.op12_decontamination(spark, d).dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    assert queries.op13_period_runs(spark, d).where(F.col("collapsed_sha256").isNull() | F.col("runs_sha256").isNull()).count() == 0

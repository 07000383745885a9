"""Small tests of the training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cograph.llm import common, exact, extraction, language, lattice, mixing, packing, pu_quality, quotes, token_groups, url_lists

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, keep_id string"
AWKWARD = [(1, None, None, None, "x"), (2, "", "en", "a", "x"), (3, " \n\t ", "en", "a", "x"), (4, "Word", "en", "a", "x"),
           (5, "word " * 30_000, "en", "a", "x"), (6, "One two three four five six.", None, "b", "x"), (6, "One two three four five six.", None, "b", "x"),
           (None, "One two three four five six.", "en", "b", "x"), (7, "日本語 🙂 <|endoftext|> \x1c\xa0x", "ja", "b", "x")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def earliest_deadline_first(sources: dict[str, tuple[int, int]]) -> list[str]:
    """Brute force: whole schedule at once; sources -> (blocks, share)."""
    def fluid(num, den):  # slots used at virtual time num / den, as a fraction over den
        return sum(min(n * den, share * num) for n, share in sources.values())

    jobs = []
    for s, (n, share) in sources.items():
        for j in range(1, n + 1):
            jobs.append((-(-fluid(j, share) // share), s, j, fluid(j - 1, share) // share))
    jobs.sort()
    out = []
    for t in range(len(jobs)):
        k = next(i for i, job in enumerate(jobs) if job[3] <= t)
        assert jobs[k][0] >= t + 1  # deadline kept
        out.append(jobs.pop(k)[1])
    return out


def test_mixing_is_earliest_deadline_first_and_within_a_block(spark):
    sizes = {"a": 61, "b": 17, "c": 5, "d": 1}
    rows = [(i, s, 10) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    weights = {"a": 0.45, "b": 0.3, "c": 0.2, "d": 0.05}
    got = mixing.mix(docs, weights, shares=20, block=10, size=F.col("n")).toPandas().sort_values(["mix_slot", "mix_offset"])
    assert sorted(got.doc_id) == [r[0] for r in rows] and got.mix_slot.tolist() == list(range(len(rows)))
    shares = {s: max(1, round(20 * w)) for s, w in weights.items()}
    assert got.source.tolist() == earliest_deadline_first({s: (n, shares[s]) for s, n in sizes.items()})
    done = dict.fromkeys(sizes, 0)
    for t, s in enumerate(got.source[:16], 1):  # before any source but d ends
        done[s] += 1
        assert all(abs(done[x] - shares[x] * t / 20) < 1 for x in "abc")


def test_mixing_keeps_within_a_block_of_unrounded_weights(spark):
    sizes = {"a": 700, "b": 310, "c": 290, "d": 41, "e": 260, "f": 9, "g": 1}
    exact = {"a": 0.4637, "b": 0.2311, "c": 0.1873, "d": 0.0177, "e": 0.0932, "f": 0.0061, "g": 0.0009}
    rows = [(i, s, 10) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(docs, exact, block=10, size=F.col("n")).toPandas().sort_values("mix_slot")
    assert sorted(got.doc_id) == [r[0] for r in rows] and got.mix_slot.tolist() == list(range(len(rows)))
    whole = sum(exact.values())
    assert got.source.tolist() == earliest_deadline_first({s: (n, round(2**30 * exact[s] / whole)) for s, n in sizes.items()})
    done = dict.fromkeys(sizes, 0)
    for t, s in enumerate(got.source[:1_100], 1):  # before any source but g ends
        done[s] += 1
        assert all(abs(done[x] - exact[x] / whole * t) < 1 for x in "abcdef")


def test_mixing_awkward_rows(awkward, empty):
    got = mixing.mix(awkward, block=1000)
    assert got.count() == len(AWKWARD) and got.columns == [*awkward.columns, "mix_block", "mix_slot", "mix_offset"]
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(awkward).columns == awkward.columns


def test_quotes_find_originals_and_order(spark):
    rows = [("c", 0, "user", "First line.\nSecond line here."), ("c", 1, "assistant", "An answer."),
            ("c", 2, "user", "On Monday they wrote:\n> first   LINE.\n> second line\n> here.\n\nI agree."),
            ("c", 3, "user", "> I agree.\n>> An answer.\nMe too."), ("c", 4, None, "> nobody said this\nHm."), ("c", 5, "user", None),
            (None, 0, "user", "> An answer.\nx"), ("d", None, "user", "An answer."), ("d", 1, "user", "> An answer.\ny")]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert (by["c", 2].parent_turn, by["c", 2].own_text) == (0, "I agree.")
    assert (by["c", 3].parent_turn, by["c", 3].thread_turn, by["c", 3].depth, by["c", 3].own_text) == (2, 0, 2, "Me too.")
    assert (by["c", 4].parent_turn, by["c", 4].own_text, by["c", 4].formatted) == (None, "Hm.", "<|user|>\nHm.\n<|end|>\n")
    assert by["c", 5].own_text == "" and by["d", 1].parent_turn is None and by[None, 0].parent_turn is None
    order = [r.turn for r in quotes.in_reply_order(got.where("conv_id = 'c'")).collect()]
    assert order == [0, 2, 3, 1, 4, 5]
    assert quotes.link_quotes(got.limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).where("held_out AND lang IS NOT NULL")
    right, all_ = got.where("lang = lang_pred").count(), got.count()
    assert right >= 0.97 * all_


def test_language_model_sums_to_one():
    codes = language.letters("the cat sat on the mat and the dog sat too")
    keys, n = np.unique(language.grams(codes), return_counts=True)
    model = language.build({"x": (keys, n)})
    context = np.unique(keys >> np.uint64(16))
    letters = [0, *range(97, 123)]
    seen = {int(k) & 0xFFFF for k in keys}
    total = sum(np.exp(model.log_probs(context << np.uint64(16) | np.uint64(c))) for c in letters if c in seen)
    assert np.all(total <= 1 + 1e-5) and np.all(total > 0.8)  # the rest is left to unseen letters


def test_language_model_in_tables_has_all_counts(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").unionByName(awkward.select("doc_id", "text", "lang"))
    one = "ein kleiner satz der nur einmal steht"  # a language whose 4-grams all have the lowest counts
    docs = docs.unionByName(spark.createDataFrame([(i, one, "xx") for i in (1_000_003, 1_000_004) if zlib.crc32(str(i).encode()) % 5] or [(1_000_009, one, "xx")], "doc_id long, text string, lang string"))
    models = [language.train(docs), language.train(docs, broadcast_grams=10)]
    assert isinstance(models[0], language.Model) and isinstance(models[1], language.Tables) and models[0].langs == models[1].langs and "xx" in models[1].langs
    assert models[0].temperature == models[1].temperature and models[0].threshold == pytest.approx(models[1].threshold, abs=1e-4)
    want, got = (language.identify(docs, m).orderBy("doc_id", "text").toPandas() for m in models)
    assert want.columns.tolist() == got.columns.tolist() and len(want) == len(got) == docs.count()
    assert want.lang_pred.tolist() == got.lang_pred.tolist() and "xx" in set(got.lang_pred)
    assert np.allclose(want.score, got.score, atol=1e-3) and np.allclose(want.cross_entropy, got.cross_entropy, atol=1e-4, equal_nan=True)


def test_language_counts_the_calibration_fold_too(spark):
    only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:5]
    other = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 >= 2][:5]
    docs = spark.createDataFrame([(i, "zwölf boxkämpfer jagen viktor", "de") for i in only] + [(i, "the quick brown fox", "en") for i in other], "doc_id long, text string, lang string")
    assert language.train(docs).langs == ["de", "en"]


def test_language_awkward_rows(awkward, empty):
    got = {r.doc_id: r for r in language.identify(awkward).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert language.identify(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy, buy. All of it, now.</div>
<article><h1>Head &amp;amp; line</h1><p>First <b>par</b>agraph,
 with   space.<p>Second&nbsp;one &lt;x&gt;<br>goes on.</p><aside>Related</aside><form>Mail <input name="a>b"></form>
<blockquote>Quoted.</blockquote><section class="comments"><article class="comment"><p>A reader says so, at length.</p></article></section></article>
<footer>&copy; us</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<article><p>Cut off &am"), (5, "<p unclosed"), (1, PAGE)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, html string"))
    text = {r.page_id: (r.text, r.n_chars) for r in got.collect()}
    want = "Head &amp; line First paragraph, with space. Second one <x> goes on. Quoted."
    assert text == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("Cut off &am", 11), 5: ("", 0)}
    assert extraction.extract(got.limit(0)).count() == 0


LONG = "The council met on Monday, and after a long debate it agreed to repair the old bridge, which carries the road over the river."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">Contact</a></li></ul>'


@pytest.mark.parametrize("wrapper", ['<div class="layout has-sidebar"><article>{}</article></div>', '<div class="with-comments"><main>{}</main></div>',
    '<div class="overflow-hidden">{}</div>', '<div style="overflow:hidden">{}</div>', '<div aria-hidden="false" title="not hidden">{}</div>', '<div data-note="hidden">{}</div>',
    "<div>{}</div>"])
def test_extraction_keeps_articles_in_any_wrapper(wrapper):
    short = "So it was."  # alone boilerplate by its statistics: its neighbours decide
    page = f"<html><body><div>{MENU}</div>" + wrapper.format(f"<p>{LONG}</p><p>{short}</p><p>{LONG}</p>") + "<div><p>© us</p></div></body></html>"
    weights = np.array(extraction.DEFAULT_WEIGHTS)
    assert extraction.main_blocks(page, weights) == [LONG, short, LONG]


def test_extraction_text_outweighs_a_class_name():
    page = f'<div>{MENU}</div><div class="widget">' + f"<p>{' '.join([LONG] * 4)}</p>" * 3 + '<p><a href="/x">More</a></p></div><div class="content"><p><a href="/y">Share this</a></p></div>'
    assert extraction.main_blocks(page, np.array(extraction.DEFAULT_WEIGHTS)) == [" ".join([LONG] * 4)] * 3


def test_extraction_leaves_out_hidden_text_and_other_articles():
    weights = np.array(extraction.DEFAULT_WEIGHTS)
    for attrs in ("hidden", "class=x hidden=''", "aria-hidden=true", 'style="color:red; display : none"'):
        assert extraction.main_blocks(f"<div {attrs}><p>{LONG}</p></div><p>{LONG} Yes.</p>", weights) == [LONG + " Yes."]
    page = extraction.blocks(f'<aside><article><p>{LONG}</p></article></aside><div class="comments"><article><p>{LONG}</p></article></div><div class="has-sidebar"><article><p>{LONG}</p></article></div>')
    assert [b.says for b in page] == [-1, -1, 1]


def test_minimum_cut_is_least():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(side):
            return sum(max(0, o) if not s else max(0, -o) for o, s in zip(odds, side)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])  # noqa: B023

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(2**n))
        assert cost(extraction.minimum_cut(odds, edges)) == pytest.approx(best)


def test_url_lists_follow_time(spark):
    entries = [("domain", "Bad.example", "add", 10), ("domain", "bad.example", "add", 12), ("domain", "bad.example", "remove", 20), ("domain", "bad.example", "add", 30),
               ("path", "ok.example/ads", "add", 5), ("url", "ok.example/ads/one", "add", 15), ("url", "tie.example/", "add", None), ("domain", "same.example", "add", 7), ("domain", "same.example", "remove", 7)]
    captures = [(1, "http://www.bad.example:80/x", 9), (2, "http://www.bad.example/x", 10), (3, "https://u:p@BAD.example", 19), (4, "http://bad.example", 20), (5, "http://bad.example", 31),
                (6, "http://notbad.example", 31), (7, "http://ok.example/ads/one?q#f", 14), (8, "http://ok.example/ads/one/", 15), (9, "http://ok.example/adsx", 15), (10, None, 15), (11, "mailto:x", 15), (12, "http://bad.example", None), (13, "http://same.example", 8)]
    got = url_lists.judge(spark.createDataFrame(captures, "id long, url string, fetched_at long"), spark.createDataFrame(entries, "kind string, key string, action string, dated long"))
    by = {r.id: r for r in got.collect()}
    assert {i for i, r in by.items() if r.blocked} == {2, 3, 5, 7, 8}
    assert (by[7].rule_kind, by[8].rule_kind, by[5].rule_since) == ("path", "url", 30)


def test_lattice_decodes_to_nearest_point():
    x = np.random.default_rng(0).standard_normal((500, 8))
    p = lattice.decode(x)
    near = ((x - p) ** 2).sum(1)
    assert len(lattice.ROOTS) == 240 and (near[:, None] <= ((x[:, None] - p[:, None] - lattice.ROOTS) ** 2).sum(2) + 1e-9).all()


def test_lattice_dedup_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 32))
    rows = [(i, [float(v) for v in b], int(i % 2)) for i, b in enumerate(base)]
    rows += [(100 + i, [float(v) for v in 3 * base[i % 20] + 0.15 * rng.standard_normal(32)], int(i % 20 % 2)) for i in range(60)]
    rows += [(200 + i, rows[0][1], 0) for i in range(3)]
    odd = [(300, None, 0), (301, [0.0] * 32, 0), (302, [float("nan")] + [1.0] * 31, 0), (303, rows[0][1], None), (304, [1.0, None], 0), (305, [1e308] * 32, 0), (306, [], 0)]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])) & ~np.eye(len(rows), dtype=bool)
    found = sum(got[r[0]].n_links for r in rows)
    assert all(got[r[0]].n_links <= n for r, n in zip(rows, same.sum(1))) and found >= 0.9 * same.sum() > 0
    assert got[200].component_id == 0 and not got[200].kept and all(got[i].n_links == 0 and got[i].kept for i in range(300, 307))


def test_lattice_finds_borderline_pairs(spark):
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((2, 6_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b *= np.sqrt(1 - 0.9801**2) / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, 0.9801 * a + b]))]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links > 0").count() >= 0.999 * len(rows)


def test_exact_dedup(awkward, empty):
    rows = exact.mark_duplicates(awkward, capacity=2, depth=4).collect()
    assert len(rows) == len(AWKWARD)
    by = {(r.doc_id, r.text): r for r in rows}
    assert (by[1, None].keep_id, by[1, None].kept, by[2, ""].kept, by[2, ""].group_size) == (2, False, True, 2)
    assert by[1, None].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[6, AWKWARD[5][1]].group_size == 3 and by[None, AWKWARD[5][1]].kept is False
    assert exact.mark_duplicates(empty).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.createDataFrame([(k << 48,) for k in range(-8, 8)] + [(5 << 48 | i,) for i in range(40)], "__key long")
    d = exact.directory(keys, capacity=4, depth=16).toPandas()
    assert d.pointer.is_unique  # a pointer leads to one bucket; prefixes without records have none
    of = dict(zip(d.pointer, d.bucket))
    load = {}
    for (k,) in keys.collect():
        load.setdefault(of[(k >> 48) & 0xFFFF], set()).add((k >> 48) & 0xFFFF)
    assert all(len(v) <= 4 for v in load.values()) and d[d.pointer == 5].bits.iloc[0] == 16


def test_packing_ids_without_look_ahead():
    """Runs of white space are cut as the look ahead would: their last character goes with the word."""
    import random

    from tokenizers import Tokenizer

    assert "(?!" not in packing.PLAIN
    tokenizer, encode, rng = Tokenizer.from_file(TOKENIZER), packing._encoder(TOKENIZER), random.Random(8)
    texts = ["".join(rng.choices("ab's  \n\n\t\r.,!01\u00e9\u00b2_", k=rng.randrange(1, 30))) for _ in range(3000)]
    for text in [" ", "  ", "\n\nA", "a \n  b", "   'll  ", *texts]:
        assert np.frombuffer(encode(text), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_round_trip(spark, awkward, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(awkward, TOKENIZER, max_len=64, with_ids=True).toPandas()
    assert got.sequence_id.is_unique and set(got.offset) == {0} and {n & (n - 1) for n in got.length} == {0}
    for i, text, *_ in AWKWARD[:5] + AWKWARD[8:]:
        mine = got[got.doc_id == i].sort_values("start")
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert [x for part in mine.ids for x in part] == ids and set(mine.doc_tokens) == {len(ids)}
        assert mine.ids_crc32.tolist() == [zlib.crc32(np.array(part, "<u4").tobytes()) for part in mine.ids]
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_tokens_equal_the_tokenizer_on_whole_table(spark):
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(TOKENIZER), packing._encoder(TOKENIZER)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["don't  stop\n\n  1²½ ªº ÿ", "'s x's  \t", "a­b", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|", "日本<|endoftext|><|endoftext|>"]
    assert np.frombuffer(encode("a <|endoftext|> b"), np.uint32).tolist() == [64, 220, 50256, 275]
    assert all(np.frombuffer(encode(t), np.uint32).tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t in texts)


def test_quality_sample_is_bounded_in_rows(spark, monkeypatch):
    rows = [(1, f"repeated text {i}") for i in range(10_000)] + [(i, f"text number {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60) for _ in range(3)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(pu_quality, "fit", lambda p, u: seen.append((len(p), len(u))))
    pu_quality.train(docs, labels, positives=10, unlabelled=20)
    pu_quality.train(docs, labels)
    outside = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    assert seen == [(10, 20), (sum(i % 2 for i in outside), len(outside))]


@pytest.mark.parametrize("few", [None, 0])
def test_components_of_few_edges_shuffle_once(spark, monkeypatch, few):
    """A chain, a star, a cycle, loops, repeated and random edges; rounds of few edges plan no shuffle."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (100, 101), (101, 100)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    low = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in low:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    plans, write = [], common.cut_lineage
    monkeypatch.setattr(common, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or write(d))
    if few is not None:
        monkeypatch.setattr(common, "FEW_EDGES", few)
    found = common.components(spark.createDataFrame(edges, "a long, b long"))
    got = found.collect()
    assert len(got) == len(low) and {r.node: r.component for r in got} == low
    assert len(plans) > 2 and "Exchange hashpartitioning" in plans[0]
    assert [("Exchange hashpartitioning" in p) for p in plans[1:]] == [few == 0] * (len(plans) - 1)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_force_classes(rows):
    sets = {}
    for i, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for blank in "\t\n\x0b\x0c\r":
            words = words.replace(blank, " ")
        words = [w for w in words.split(" ") if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_jaccard_classes_against_brute_force(spark):
    """Copies with edits around the threshold, a passage that all share, texts of few words, chains of links."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    passage, rows = " ".join(rng.choices(vocabulary, k=60)), []
    for b in range(6):
        base = rng.choices(vocabulary, k=120)
        for _ in range(14):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text) + (" \n" + passage if b % 2 else "")))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \t", "One two", "one\ttwo", "one two three", passage, passage.upper(), "x " * 5000, "x " * 5001])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in token_groups.jaccard_classes(docs).collect()}
    assert got == brute_force_classes(rows)


def test_sketches_never_exceed_the_difference(spark):
    """Pairs are screened by sketches of two bits a token at most, which lose no link and turn unlike sets away."""
    rng = np.random.default_rng(5)
    sets = []
    for n, common in [(1, 0), (1, 1), (3, 2), (64, 64), (65, 60), (400, 390), (400, 200), (400, 0), (700, 690), (5000, 4900), (5000, 0), (300, 40)]:
        tokens = np.unique(rng.integers(0, 1 << 64, 3 * n, np.uint64))
        sets.append((tokens[:n], np.sort(np.concatenate([tokens[n - common : n], tokens[n : n + max(1, 4 * n // 5 - common)]]))))
    sets.append((sets[-1][0], sets[2][1]))  # sketches of very different lengths
    assert all(64 * len(token_groups.sketch(a)) <= max(64, 2 * len(a)) for a, _ in sets)
    rows = [(i, *(token_groups.sketch(t).tolist() for t in pair)) for i, pair in enumerate(sets)]
    d = spark.createDataFrame(rows, "i int, x array<bigint>, y array<bigint>")
    got = d.select("i", token_groups.differing("x", "y").alias("xy"), token_groups.differing("y", "x").alias("yx"), token_groups.differing("x", "x").alias("xx"))
    apart = np.array([list(r)[1:] for r in sorted(got.collect())]).T
    sizes = np.array([[len(a), len(b), len(np.setxor1d(a, b))] for a, b in sets]).T
    assert (apart[0] <= sizes[2]).all() and (apart[0] % 2 == sizes[2] % 2).all() and (apart[0] == apart[1]).all() and not apart[2].any()
    linked = 100 * (sizes[0] + sizes[1] - sizes[2]) >= 75 * (sizes[0] + sizes[1] + sizes[2])
    allowed = token_groups.possible(sizes[0], sizes[1], apart[0], 75)
    assert linked.any() and allowed[linked].all() and not allowed[[7, 10, 11]].any()


def test_jaccard_awkward_rows(awkward, empty):
    got = token_groups.jaccard_classes(awkward).collect()
    assert len(got) == len(AWKWARD) and [r.component_id for r in got if r.doc_id is None] == [None]
    assert token_groups.jaccard_classes(empty).count() == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = pu_quality.train(docs.select("doc_id", "text"), labels)
    got = pu_quality.classify(docs, model).join(labels, "doc_id").where("held_out")
    right, all_ = got.where("predicted = quality").count(), got.count()
    assert right >= 0.97 * all_ and 0.6 < model.prior < 0.95


def test_quality_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    for docs, n in ((awkward, len(AWKWARD)), (empty, 0)):
        got = pu_quality.classify(docs, pu_quality.train(docs, labels)).collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)


def test_pipeline_keeps_one_of_each_group(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.cut_lineage(out)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if name == "exact_dedup":
            assert set(after) == {max(i for i, t in before.items() if t == text) for text in set(before.values())}
        if name == "near_dedup":
            assert set(after) == {low for _, low in brute_force_classes(list(before.items())).values()}
        if name == "mix":
            assert after == before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).toPandas()
    assert set(packed.doc_id) == set(after) and packed.sequence_id.is_unique


def test_pipeline_packs_in_mixed_order(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    order = mixing.mix(docs).select("doc_id", "mix_slot", "mix_offset").toPandas().sort_values(["mix_slot", "mix_offset"])
    at = {i: n for n, i in enumerate(order.doc_id)}
    mixed = corpus_pipeline.cut_lineage(corpus_pipeline.mix(spark, docs, d))
    packed = corpus_pipeline.pack(spark, mixed, d).toPandas().sort_values("sequence_id")
    assert packed.sequence_id.is_unique and set(packed.doc_id) == set(at)
    for _, same in packed.groupby("length"):
        places = list(zip(same.doc_id.map(at), same.start))
        assert places == sorted(places) and (same.sequence_id // 11).tolist() == list(range(len(same)))


def test_sequences_follow_the_target_weights(spark):
    sizes, weights = {"a": 260, "b": 140, "c": 200}, {"a": 0.6, "b": 0.3, "c": 0.1}
    rows = [(i, s, "word " * 40) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = mixing.cut_lineage(mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=weights, block=200))
    packed = packing.pack(docs, TOKENIZER, max_len=32, order=[F.col("_metadata.file_name"), F.col("_metadata.row_index")]).toPandas()
    full = packed[packed.length == 32].sort_values("sequence_id").doc_id.map({r[0]: r[1] for r in rows}).tolist()
    assert len(full) == len(rows)
    for n in range(20, 400, 20):  # before a source ends
        assert all(abs(full[:n].count(s) - w * n) < 2 for s, w in weights.items())

"""Tokenisers, packing, extraction, quality, toxicity, language model, search."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe, extraction, language_model, packing, quality, topk, toxicity

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
_text = st.lists(st.sampled_from([*"aBéÉ'sLl1!,.- \n\t日ßİΣ<|>x", "\u0301", "\xa0", "\u3000", "<|endoftext|>"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(_text)
def test_bpe_parts_round_trip(text):
    ids = bpe.loaded(RANKS, public_tokenizers.PATTERN)[0].encode_ordinary(text)
    assert [i for p in bpe.parts(text, 5) for i in bpe.encode(p, RANKS, public_tokenizers.PATTERN)] == ids
    assert bpe.decode(ids, RANKS, public_tokenizers.PATTERN) == text.encode()


def test_bpe_rows(docs, texts, none):
    encoding = bpe.loaded(RANKS, public_tokenizers.PATTERN)[0]
    source = dict(texts)
    for r in bpe.encoded_rows(docs, RANKS, public_tokenizers.PATTERN).where("doc_id is not null").collect():
        text = source[r["doc_id"]] or ""
        ids = encoding.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encoded_rows(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.with_ids(docs.where("doc_id = 93"), RANKS, public_tokenizers.PATTERN).first()["ids"] == encoding.encode_ordinary("one")


@settings(max_examples=150, deadline=None)
@given(st.lists(_text, max_size=4))
def test_word_ids_are_the_tokenizers(texts):
    tokenizer = packing._encoder(WORDS).tokenizer
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert packing.encode_words(texts, WORDS) == want


def test_packing(docs, none):
    got = packing.packed_documents(docs, WORDS, 300).collect()
    tokenizer = packing._encoder(WORDS).tokenizer
    whole = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        whole.update((r["doc_id"], k, a, len(ids[a : a + 300]), zlib.crc32(ids[a : a + 300].tobytes())) for k, a in enumerate(range(0, len(ids), 300)))
    assert Counter(tuple(r)[:5] for r in got) == whole
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 300
    bound = packing.lower_bound(np.bincount([r["length"] for r in got], minlength=301), 300)
    assert bound <= len(rows) <= bound + 2
    assert packing.packed_documents(none, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_lower_bound_never_exceeds_the_optimum(lengths):
    def fits(rest, bins):
        if not rest:
            return True
        return any(fits(rest[1:], [*bins[:i], b - rest[0], *bins[i + 1 :]]) for i, b in enumerate(bins) if b >= rest[0] and b not in bins[:i])

    rest = sorted(lengths, reverse=True)
    best = next(k for k in range(1, len(rest) + 1) if fits(rest, [20] * k))
    assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= best
    where, offset, room = packing.best_fit(np.array(lengths), 20)
    assert len(room) >= best and all(room >= 0)


def test_repacking_of_gaps(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.randint(30, 70)) for i in range(600)], "doc_id bigint, length bigint")
    done = packing.pack(rows, 100, part=40)
    used = done.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert used.where("n > 100").isEmpty() and done.count() == 600
    once = packing._packed(rows, 15, 100, 0)
    assert used.count() <= once.select("sequence_id").distinct().count()


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "four " * 30)], "doc_id bigint, text string")
    packed = packing.packed_documents(docs, WORDS, 16)
    got = packing.sequences(docs, packed, WORDS, 16).collect()
    assert sum(len(r["ids"]) for r in got) == packed.agg(F.sum("length")).first()[0]
    assert all(len(r["ids"]) <= 16 for r in got)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy this now.</div>
<div id="cookie-notice"><p>We use cookies on this site and we hope that you agree.</p></div><article><header><h1>Title &amp; more</h1></header><p>First&nbsp;  paragraph <b>with</b> bold text of the
article, which is long enough to be taken as text.<script>x("</p>")</script><p>Short.<p>An end.</p><aside>Also read</aside></article><section class="comments"><article><p>I think that this is a very bad text and that all of it is wrong.</p></article></section>
<form><p>Name and address of the one who asks</p></form><footer>&copy; Us</footer></body>"""


def test_extraction():
    assert extraction.main_text(PAGE) == "Title & more\n\nFirst paragraph with bold text of the article, which is long enough to be taken as text.\n\nShort.\n\nAn end."


def test_extraction_without_article_element():
    long = "<p>" + "The house of the man was in the middle of the town, and it was old. " * 2 + "</p>"
    page = f"<div><a href=x>Home</a> <a href=y>News</a></div><h2>Head</h2>{long}<p>Yes.</p>{long}<div><a href=z>Next page</a></div><p>x</p>"
    found = extraction.main_text(page).split("\n\n")
    assert found[0] == "Head" and found[2] == "Yes." and len(found) == 4


ARTICLE = "<p>The house of the man was in the middle of the town, and it was as old as the hills that are around it.</p><p>All of that was not known to them when they came to the house in the year of the flood, but it is now.</p>"


@pytest.mark.parametrize("page", [
    f'<html><body class="has-sidebar">{ARTICLE}</body></html>', f'<div class="content with-sidebar">{ARTICLE}</div>', f'<div class="post legal">{ARTICLE}</div>', f'<div id="comment-policy-article">{ARTICLE}</div>',
    f"<svg width=1 />{ARTICLE}", f"<iframe src=x />{ARTICLE}", f"<datalist><option>a<option>b</datalist>{ARTICLE}", f"<iframe src=x>{ARTICLE}", f"<select><option>a<option>b</select>{ARTICLE}",
    f"<title>No</title><button>Press</button>{ARTICLE}<!-- an end", f"{ARTICLE}<script>if (a > b) c", f"<!-- <p>no</p> -->{ARTICLE}<style>p > a",
])
def test_ordinary_markup_keeps_the_article(page):
    assert extraction.main_text(page) == "\n\n".join(x.removesuffix("</p>") for x in ARTICLE.split("<p>")[1:])


@pytest.mark.parametrize("part", ['<a "', "<a '", "<!--", "<svg>", "<script ", "<b", "</", '<p x="', "<div class='ad", "<option>", "<a \"'>"])
def test_extraction_is_linear(part):
    import time

    began = time.perf_counter()
    extraction.main_text(part * (500_000 // len(part)))
    assert time.perf_counter() - began < 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<a href='", "'>", "<div class=\"ad\">", "</div>", "<article>", "</article>", "<!--", "-->", "<script>", "</script>", "text of the ", "&amp;", "&#x41;", "<", ">", "<br>", "</nav>", "<nav>", "\""]), max_size=40))
def test_extraction_never_raises(parts):
    text = extraction.main_text("".join(parts))
    assert "\n\n\n" not in text and text == text.strip()


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "w", ""), (1, "u", PAGE)], "page_id bigint, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(9))
    got = extraction.extracted(pages).collect()
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extraction.extracted(pages.limit(0)).count() == 0


def brute_stats(text):
    import re

    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    runs = defaultdict(list)
    for i in range(len(w) - 4):
        runs[tuple(w[i : i + 5])].append(i)
    covered = {k for own in runs.values() if len(own) > 1 for i in own for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, texts, none):
    source = dict(texts)
    for r in quality.quality_rows(docs).where("doc_id is not null").collect():
        n, chars, symbols, lines, repeats = brute_stats(source[r["doc_id"]])
        assert tuple(r)[1:6] == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rows(none).count() == 0


def test_quality_rejects_outliers_only(spark):
    rng = random.Random(9)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, make(rng.randint(40, 400)), "en" if i % 4 else None, "s") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in make(200).split()), "en", "s") for i in range(10)]
    rows += [(2000 + i, make(200).upper(), None, "s") for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rows(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(400)) and not any(v for i, v in got.items() if i >= 1000)


def test_chi_squared():
    assert abs(quality.chi_squared_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality.chi_squared_quantile(0.9999, 5) - 25.7448) < 1e-3
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200_000, quality.D))
    d = (x**2).sum(axis=1)
    near = x[d <= np.quantile(d, 0.75)]
    assert abs(quality.consistency(0.75) * near.var() - 1) < 0.02


def brute_mcd(rows, support=0.75, steps=3, prior=50.0):
    """rows: (lang, source, vector, units); each one's squared distance."""
    floor = np.diag([f[1] ** 2 for f in quality.FEATURES])
    x, units = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    binned = lambda d: np.floor(256 * np.maximum(np.log2(d + 1e-12), -20))
    distance = lambda y, m, c: np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(c), y - m)
    disc = lambda v, q: np.sort(v)[math.ceil(q * len(v) - 1e-12) - 1]
    estimate = lambda y: (y.mean(axis=0), np.cov(y.T, bias=True) + floor)
    sums, by = {}, defaultdict(list)
    for i, r in enumerate(rows):
        by[r[0], r[1]].append(i)
    for g, own in by.items():
        y = x[own]
        mid = np.array([disc(v, 0.5) for v in y.T])
        mad = np.array([disc(abs(v - m), 0.5) for v, m in zip(y.T, mid, strict=True)]) * 1.4826
        starts = [(mid, np.diag(mad**2) + floor)]
        b = binned(distance(y, *starts[0]))
        starts += [estimate(y[b <= disc(b, 0.5)]), estimate(y)]
        best = None
        for m, c in starts:
            for _ in range(steps):
                b = binned(distance(y, m, c))
                kept = y[b <= disc(b, support)]
                m, c = estimate(kept)
            z = round(float(np.linalg.slogdet(c)[1]) / 2, 9)
            if best is None or z < best[0]:
                best = (z, np.array([len(kept)]), kept.sum(axis=0), kept.T @ kept)
        sums[g] = best[1:]
    total = lambda some: [sum(p) for p in zip(*some, strict=True)]
    lean = lambda a, b: [a[0] + prior, a[1] + prior * b[1] / b[0], a[2] + prior * b[2] / b[0]]
    every, out = total(sums.values()), np.empty(len(rows))
    for g, own in by.items():
        n, s, p = lean(sums[g], lean(total([v for k, v in sums.items() if k[0] == g[0]]), every))
        m = s / n
        c = quality.consistency(support) * (p / n - np.outer(m, m)) + floor
        shrink = 1 / np.sqrt(1 + np.array([f[2] for f in quality.FEATURES]) / (np.maximum(units[own], 1) * np.diag(c)))
        out[own] = np.einsum("ij,jk,ik->i", (x[own] - m) * shrink, np.linalg.inv(c), (x[own] - m) * shrink)
    return out


def test_quality_equals_brute_force(spark):
    """Groups of 3 to 200 documents, some of them of other statistics."""
    rng = random.Random(11)
    rows = []
    for lang, source, size in (("en", "a", 200), ("en", None, 40), (None, "b", 60), ("de", "c", 3), ("de", "d", 12)):
        for _ in range(size):
            words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))).capitalize() if rng.random() < 0.1 else "".join(rng.choice("ijkl") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(12, 150))]
            if rng.random() < 0.08:
                words = [w + rng.choice(["", "#", "|||"]) for w in words]
            lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
            lines += lines[:1] * rng.choice([0, 0, 0, 0, 0, 1])
            rows.append((len(rows), "\n".join(lines), lang, source))
    got = {r["doc_id"]: r for r in quality.quality_rows(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)).collect()}
    vectors, ids = [], []
    for i, t, lang, source in rows:
        n, chars, symbols, dup, repeats = brute_stats(t)
        if got[i]["base_failed"]:
            continue
        lines, caps = t.count("\n") + 1, sum("A" <= c <= "Z" for c in t)
        v = [math.log(chars / n), *(math.sqrt(a / b) for a, b in ((symbols, chars), (repeats, n), (dup, lines), (caps, chars)))]
        unit = {"words": n, "chars": chars, "lines": lines}
        vectors.append((lang, source, [math.floor(4096 * u + 0.5) / 4096 for u in v], [unit[f[3]] for f in quality.FEATURES]))
        ids.append(i)
    want = brute_mcd(vectors)
    assert len(ids) > 250 and np.allclose([got[i]["distance"] for i in ids], want, rtol=1e-6, atol=1e-9)
    limit = quality.chi_squared_quantile(0.9999, quality.D)
    assert [got[i]["kept"] for i in ids] == (want <= limit).tolist() and 5 < (want > limit).sum() < 60


def test_toxicity_learns_pairs(spark):
    """Only the insult beside the group is toxic: no sum of single weights tells that."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(12)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["fool"] * insult + ["tribe"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    docs = spark.createDataFrame([*rows, (9999, None), (9998, "")], "doc_id bigint, text string")
    got = toxicity.toxicity_rows(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).toPandas().set_index("doc_id")
    truth = dict(labels)
    held = got[got.held_out & (got.index < 9000)]
    assert (held.predicted == [truth[i] for i in held.index]).mean() > 0.95
    assert got.score.between(0, 1).all() and len(got) == 1502
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()


def test_toxicity_learns_pairs_whose_words_say_nothing(spark):
    """Toxic if exactly one of two words is there."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(2000):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(10)]
        one, other = rng.random() < 0.5, rng.random() < 0.5
        words += ["fool"] * one + ["tribe"] * other
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(one != other)))
    got = toxicity.toxicity_rows(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert (held.predicted == [dict(labels)[i] for i in held.index]).mean() > 0.95


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(np.array([3, 5, 8, 11]), rng.normal(size=4), rng.normal(size=(4, 3)), 0.7)
    rows = [[], [5], [3, 8, 99], [11, 8, 5, 3], [2]]
    want = []
    for r in rows:
        k = [machine.ids.tolist().index(t) for t in r if t in machine.ids]
        want.append(0.7 + sum(machine.weight[i] for i in k) + sum(machine.factor[i] @ machine.factor[j] for i in k for j in k if i < j))
    got = machine.margin(np.array(sum(rows, [])), np.cumsum([0, *map(len, rows)]))
    assert np.allclose(got, want)


def test_toxicity_fits_one_row_of_each_id(spark, monkeypatch):
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, y, ids: seen.append(len(rows)) or fit(rows, y, ids))
    docs = spark.createDataFrame([(1, "bad fool")] * 50 + [(1, "other text")] * 50 + [(i, "bad fool" if i % 2 else "good day") for i in range(2, 60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id bigint, toxic int")
    machine = toxicity.train(docs, labels, sample=40)
    assert seen == [40] and len(machine.ids)


def test_toxicity_without_labels(docs, none, spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity_rows(docs, labels)
    assert got.where("score > 0.01 or score is null").isEmpty() and got.count() == docs.count()
    assert toxicity.toxicity_rows(none, labels).count() == 0
    assert toxicity.clean(docs, labels).columns == docs.columns


def test_language_model(docs, none):
    got = language_model.scored(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    want = Counter((r["doc_id"], held(r["doc_id"]), len(tokens(r["text"])), sum(w in c for w in tokens(r["text"])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r["text"])), 6)) for r in rows)
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.scored(none).count() == 0


def test_log_probabilities_are_normalised():
    rng = np.random.default_rng(0)
    k = 7
    p = {"R": rng.normal(size=(k, 4)), "Q": rng.normal(size=(k, 4)), "b": rng.normal(size=k), "C": rng.normal(size=(2, 4))}
    for a, b in ((3, 4), (5, 2)):
        total = sum(math.exp(language_model.log_probabilities(p, np.array([a, b, w]), np.array([0, 3]))[2]) for w in range(k))
        assert abs(total - 1) < 1e-9


def test_log_probabilities_equal_the_plain_softmax():
    rng = np.random.default_rng(1)
    for first, k in ((3, 40), (400, 400)):  # many contexts with few first words, and first words of their own
        p = {"R": rng.normal(size=(k, 4)), "Q": rng.normal(size=(30, 4)), "b": rng.normal(size=30), "C": rng.normal(size=(2, 4))}
        ids, seen, offsets = rng.integers(0, 30, 3000), rng.integers(0, first, 3000), np.array([0, 1, 700, 3000])
        one, two = language_model.contexts(seen, offsets)
        x = (p["C"][0] * p["R"][one] + p["C"][1] * p["R"][two]) @ p["Q"].T + p["b"]
        want = x[np.arange(3000), ids] - np.log(np.exp(x).sum(axis=1))
        for seconds in (None, language_model._seconds(p)):
            assert np.allclose(language_model.log_probabilities(p, ids, offsets, seen, seconds), want, atol=1e-9)


def test_log_probabilities_by_blocks_equal_the_plain_softmax(monkeypatch):
    for name, value in (("FIRSTS", 8), ("SECONDS", 4), ("FACTORS", 12)):
        monkeypatch.setattr(language_model, name, value)
    rng = np.random.default_rng(3)
    for scale, dtype, close in ((1, float, 1e-9), (40, float, 1e-7), (1, "f4", 1e-4)):  # at 40 the products of some contexts vanish
        p = {"R": scale * rng.normal(size=(50, 4)), "Q": rng.normal(size=(30, 4)), "b": rng.normal(size=30), "C": rng.normal(size=(2, 4))}
        p = {k: x.astype(dtype) for k, x in p.items()}
        ids, seen, offsets = rng.integers(0, 30, 4000), (50 * rng.random(4000) ** 3).astype("i4"), np.array([0, 1, 900, 4000])
        one, two = language_model.contexts(seen, offsets)
        x = ((p["C"][0] * p["R"][one] + p["C"][1] * p["R"][two]) @ p["Q"].T + p["b"]).astype(float)
        x -= x.max(axis=1)[:, None]
        want = x[np.arange(4000), ids] - np.log(np.exp(x).sum(axis=1))
        for alone in (0, 3, 1 << 30):  # every context by itself, some of them, none
            monkeypatch.setattr(language_model, "ALONE", alone)
            for seconds in (None, language_model._seconds(p)):
                assert np.allclose(language_model.log_probabilities(p, ids, offsets, seen, seconds), want, rtol=1e-6, atol=close)


def test_a_block_of_many_contexts_copies_no_rows():
    class Rows(np.ndarray):
        def take(self, *args, axis=None, **more):
            assert axis is None
            return super().take(*args, **more)

    rng = np.random.default_rng(4)
    left, right = rng.random((20, 6)).view(Rows), rng.random((30, 6)).view(Rows)
    one, two = rng.integers(0, 20, 5000), rng.integers(0, 30, 5000)
    got = language_model._products(left, right, one, two, np.array([0, 5000]))
    assert np.allclose(got, (np.asarray(left) @ np.asarray(right).T)[one, two])


def test_tokens_of_the_language_model():
    rng = random.Random(6)
    signs = [*"aAzZ \t\n\x0b\x0c\r\x1c\x1f\x85\xa0éÉİßK\u3000\x00"]
    texts = [None, "", " ", "a", *("".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(400))]
    column = pa.array([*texts, "cut off"], pa.string()).slice(0, len(texts))
    runs = list(language_model._parts(column, 300))
    assert [a for a, _ in runs[1:]] == [b for _, b in runs[:-1]] and (runs[0][0], runs[-1][1]) == (0, len(texts)) and len(runs) > 5
    for a, b in runs:
        words, which, bounds = language_model._tokens(column.slice(a, b - a))
        found = words.to_pylist()
        assert len(set(found)) == len(found)  # each word is looked up once
        for i in range(a, b):
            assert [found[k].encode() for k in which[bounds[i - a] : bounds[i - a + 1]]] == (texts[i] or "").encode().lower().split()


def test_gradients_of_repeated_rows_are_summed():
    rng = np.random.default_rng(2)
    at = rng.integers(0, 20, 200)
    for shape, of_gains in (((50, 3), (50, 3)), ((50, 3), (50, 1)), ((50,), (50,))):
        into, gains, grad = rng.normal(size=shape).astype("f4"), np.ones(of_gains, "f4"), rng.normal(size=(200, *shape[1:])).astype("f4")
        g = np.zeros(shape)
        np.add.at(g, at, grad)
        want_gains = gains + (g * g if of_gains == shape else (g * g).mean(axis=1, keepdims=True))
        want = into - 0.3 * g / np.sqrt(want_gains)
        language_model._add_rows(into, gains, language_model._distinct(at, np.empty(50, np.int64)), grad, 0.3)
        assert np.allclose(into, want, atol=1e-4) and np.allclose(gains, want_gains, rtol=1e-4)


def test_training_improves_on_the_unigram():
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.append(np.tile([2, 3, 4], 20)[: rng.integers(10, 50)], 1) for _ in range(400)])
    ends = np.flatnonzero(ids == 1) + 1
    offsets = np.concatenate([[0], ends])
    counts = np.bincount(ids, minlength=5) + 1.0

    class Look:
        classes, unigram = 5, counts / counts.sum()

    p = language_model.start(Look, 8)
    before = language_model.log_probabilities(p, ids, offsets).mean()
    for _ in range(5):
        language_model.nce(p, iter([(ids, offsets)]), Look.unigram, noise=8, size=128)
    assert language_model.log_probabilities(p, ids, offsets).mean() > before + 0.5


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(400, None), (None, rows[0][1]), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (600, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    single = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in single:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in single if i != q and len(v) == len(w))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_rows(frame).collect()} == want
    assert topk.top_rows(frame.limit(0)).count() == 0


def test_top_k_of_more_lengths_than_have_pivots(spark, monkeypatch):
    monkeypatch.setattr(topk, "LENGTHS", 2, raising=False)
    rng = random.Random(9)
    rows = [(i, [rng.randint(-40, 40) / 16 for _ in range(2 + i % 5)]) for i in range(150)]
    got = [tuple(r) for r in topk.top_rows(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()]
    want = []
    for q, x in rows:
        if q % 50 == 0:
            scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(got) == sorted(want)


def test_top_k_of_more_than_a_thousand_lengths(spark):
    rows = [(50 * d, [1.0] * d) for d in range(1, 1003)] + [(1, [2.0] * 1002), (2, [2.0])]
    got = {tuple(r) for r in topk.top_rows(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert got == {(50, 1, 2, 2 << 16), (50 * 1002, 1, 1, 1002 * (2 << 16))}


def test_top_k_of_clusters_with_ties(spark):
    """Many equal scores at the last rank, repeated query rows, blocks that are eliminated whole."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, [float(round(x * 4) / 4) for x in centres[i % 12] + rng.normal(size=8) * 0.2]) for i in range(900)]
    rows += [(2000 + i, rows[50][1]) for i in range(12)] + [rows[100]] * 2
    single = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in rows]
    want = set()
    for q, v in single:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in single if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_rows(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()} == want

"""Passage and near-duplicate operators against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash

from millrace.llm import common, components, passages, shingles, simhash


def words(t):
    return (t or "").encode().split()


def brute_repeats(texts, least=50):
    first, out = {}, {}
    for i, t in sorted(texts):
        w = words(t)
        for j in range(len(w) - least + 1):
            first.setdefault(tuple(w[j : j + least]), i)
    for i, t in texts:
        w, gone = words(t), set()
        for j in range(len(w) - least + 1):
            if first[tuple(w[j : j + least])] < i:
                gone.update(range(j, j + least))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("method", ["cover", "suffix"])
def test_repeats_equal_brute_force(docs, texts, none, method):
    want = brute_repeats(texts)
    got = passages.repeat_rows(docs, method).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]
    assert sum(n for _, n, _ in want.values()) > 500
    assert passages.repeat_rows(none, method).count() == 0


def test_passages_are_cut_from_the_text_as_written(docs, texts):
    got = passages.without_repeats(docs, "suffix")
    assert got.columns == docs.columns
    want, source = brute_repeats(texts), dict(texts)
    for r in got.where("doc_id is not null").collect():
        assert len(words(r["text"])) == want[r["doc_id"]][0] - want[r["doc_id"]][1]
        if not want[r["doc_id"]][1]:
            assert r["text"] == source[r["doc_id"]]
        else:
            assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("method", ["cover", "suffix"])
def test_a_copy_does_not_speak_for_other_texts_of_its_id(spark, method):
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, run("a", 80)), (5, run("a", 80)), (5, f"{run('b', 70)} {run('p', 60)}"), (9, f"{run('c', 30)} {run('p', 60)}")]
    got = passages.repeat_rows(spark.createDataFrame(rows, "doc_id bigint, text string"), method).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 80, 0), (5, 80, 80), (5, 130, 0), (9, 90, 60)]


def test_every_difference_is_covered():
    assert {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER} == set(range(passages.PERIOD))


def fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, radius):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(docs, texts, none):
    prints = {i: fingerprint(t) for i, t in texts}
    want = linked(prints, 2)
    for r in simhash.simhash_rows(docs).collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and len(r["fingerprint"]) == 16
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
    assert simhash.simhash_rows(none).count() == 0


@pytest.mark.parametrize(("bits", "radius"), [(64, 2), (64, 5), (256, 40)])
def test_bit_sliced_pairs(bits, radius):
    rng = np.random.default_rng(bits + radius)
    base = rng.integers(0, 1 << 63, (20, bits // 64), dtype=np.uint64)
    f = base[rng.integers(0, 20, 300)].copy()
    for row in f:
        for b in rng.choice(bits, rng.integers(0, 2 * radius), replace=False):
            row[b // 64] ^= np.uint64(1 << int(b % 64))
    group = np.sort(rng.integers(0, 4, 300))
    distance = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and distance[i, j] <= radius}
    assert {(int(a), int(b)) for i, j in simhash.bit_sliced_pairs(f, group, radius) for a, b in zip(i, j, strict=True)} == want


def test_exact_masks_leave_no_pair_out():
    rng = np.random.default_rng(0)
    masks = simhash.exact_masks(64, 2)
    for _ in range(200):
        flipped = set(rng.choice(64, 2, replace=False).tolist())
        assert any(not flipped & set(m.tolist()) for m in masks)


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = np.random.default_rng(1)
    prints = {i: int(rng.integers(0, 1 << 20)) for i in range(200)}
    rows = spark.createDataFrame([(i, [p]) for i, p in prints.items()], "doc_id bigint, f array<bigint>")
    assert {r["doc_id"]: r["component_id"] for r in simhash.grouped(rows, 2).collect()} == linked(prints, 2)


def test_one_of_each_group_stays(docs, texts, none):
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert ids.count(None) == 2 and len(ids) == len(set(ids)) + 1
    assert not {60, 61, 62, 63, 64, 65} & set(ids) and set(range(60)) <= set(ids)
    assert simhash.one_of_each(none).count() == 0


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_smallest(texts, least=0.8):
    """The smallest id of every group of texts that pairs of the similarity connect."""
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    """Planted pairs of similarity 0.65 to 1, and many texts that share a passage."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    texts, common = [], word(60)
    for k in range(60):
        w = word(int(rng.integers(80, 500)))
        other, shingles = list(w), len(w) - 4
        n = round((1 - (t := rng.uniform(0.65, 0.99))) / (1 + t) * shingles / 5)
        for p in rng.choice(np.arange(4, len(w) - 4, 5), min(n, len(w) // 5 - 2), replace=False):
            other[p] = f"x{p}"
        texts += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    texts += [(200 + k, " ".join(word(int(rng.integers(0, 40))) + common)) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    pairs = [len(a & b) / len(a | b) for a, b in ((shingle_set(texts[2 * k][1]), shingle_set(texts[2 * k + 1][1])) for k in range(60))]
    assert sum(0.8 <= x < 0.9 for x in pairs) > 10 and sum(0.7 <= x < 0.8 for x in pairs) > 10
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == brute_smallest(texts)


def near_copies(rng, group, words, changed):
    """Texts that differ from one text in ``changed`` words each."""
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, words)]
    texts = []
    for k in range(group):
        w = list(base)
        for p in rng.choice(words, changed, replace=False):
            w[p] = f"x{k}x{p}"
        texts.append(" ".join(w))
    return texts


def test_a_large_group_of_near_copies_makes_no_pairs(spark, monkeypatch):
    """No staged table grows with the square of the group, whether its pairs are links or not."""
    rng, rows = np.random.default_rng(11), []
    texts = list(enumerate(near_copies(rng, 300, 200, 4) + near_copies(rng, 100, 200, 1)))
    for module in (simhash, shingles, components):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: rows.append((df.columns, (out := cut(df)).count())) or out)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert got == brute_smallest(texts) and 200 < len(got) < 310
    assert max(n for columns, n in rows if columns == ["u", "v"]) < 300 * 299 // 2 // 5


def test_links_of_a_group_in_chunks_equal_brute_force(spark, monkeypatch):
    """Sets dealt into pairs of chunks, and a large component that most sets are found in."""
    monkeypatch.setattr(shingles, "GROUP", 1000)
    rng = np.random.default_rng(12)
    texts = list(enumerate(near_copies(rng, 40, 100, 2) + near_copies(rng, 30, 100, 1)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == brute_smallest(texts)
    sets = [shingles._set(t, 5) for _, t in texts]
    root = list(range(len(sets)))
    for i, js in shingles.linked(np.concatenate(sets), np.array([len(x) for x in sets]), 0.8):
        for j in js:
            old, new = sorted((root[i], root[j]), reverse=True)
            assert old != new
            root = [new if r == old else r for r in root]
    assert set(root) == brute_smallest(texts)


def test_shingles_that_many_texts_hold_are_no_keys(spark):
    """A passage that a few hundred texts share doesn't make one bucket of them, however many other shingles there are."""
    rng = np.random.default_rng(13)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = word(30)
    docs = spark.createDataFrame([(k, " ".join(word(400) + passage)) for k in range(600)], "doc_id bigint, text string").repartition(2)
    rows = shingles.classed(docs, 5, 4)
    classes = rows.where("often is null").select("c", "n", "f")
    late = shingles.common(rows)
    assert len(late[0]) == 26 and late[1].tolist() == [600] * 26
    assert shingles.shared_keys(docs, classes, 5, 0.8, late).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 22])
def test_texts_that_stay_do_not_move(spark, monkeypatch, few):
    """The result is the same either way; with few ids to go no text that stays is shuffled, whatever the session broadcasts."""
    monkeypatch.setattr(common, "FEW", few)
    rng = np.random.default_rng(14)
    texts = list(enumerate(near_copies(rng, 40, 100, 1) + [f"u{k} v{k}" for k in range(40)]))
    docs = spark.createDataFrame([*texts, (None, "of no id")], "doc_id bigint, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = simhash.one_of_each(docs)
        ids = [r["doc_id"] for r in got.collect()]
        plan = got._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(ids) == brute_smallest(texts) | {None} and len(ids) == len(set(ids))
    assert ("SortMergeJoin" in plan) == (few == 0)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "u bigint, v bigint")
    got = {r["u"]: r["v"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_slices_hold_all_documents_and_one_window_selects_one_suffix(monkeypatch):
    import pyarrow as pa

    from millrace.llm import rolling

    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 4, n).tolist() for n in (0, 7, 90, 3, 400, 0, 55, 1000)]
    column = pa.array(lists, pa.list_(pa.int64()))
    want = {}
    for size in (1 << 17, 64, 10):
        monkeypatch.setattr(rolling, "SLICE", size)
        got = {}
        for a, _, w in rolling.slices(column):
            starts, chosen = passages.selected(w, 5, 8)
            assert (np.diff(chosen) >= 0).all() and (chosen >= starts).all() and (chosen <= starts + 7).all()
            for s, c in zip(starts.tolist(), chosen.tolist(), strict=True):
                got[a + int(w.doc[s]), int(w.pos[s])] = (int(w.pos[c]), int(w.window(np.array([s]), 12)[0]))
        assert len(got) == sum(max(0, len(x) - 11) for x in lists)
        want = want or got
        assert got == want
    same = {}
    for (_, at), (chosen, h) in want.items():
        assert same.setdefault(h, chosen - at) == chosen - at  # equal windows select the same place

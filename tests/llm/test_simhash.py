import numpy as np
import pytest
from xxhash import xxh64_intdigest

from chatlake.llm import simhash
from chatlake.llm.common import least_reachable


def brute_print(text, shingle=3, seed=42):
    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxh64_intdigest(f, seed) for f in found]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(rows, budget=2):
    prints = [brute_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    noise = [b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base for x, y in rng.integers(0, 63, (12, 2))]
    a = np.unique(np.concatenate([base, np.array(noise, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 3}
    got = set()
    for i, j in simhash.trie_links(a, a, True, 64, 3, 3, chunk=64):
        got |= set(zip(i.tolist(), j.tolist()))
    assert got == want


@pytest.mark.parametrize("config", [simhash.OP8, simhash.SimHashConfig(task_rows=8, parallel_bits=3)])
def test_classes_equal_brute_force(spark, config):
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(1)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "x" * 50000)]
    for g in range(6):
        base = list(rng.choice(words, 400))
        for k in range(6):
            edited = list(base)
            for at in rng.integers(0, 400, k):
                edited[at] = f"e{g}{k}"
            rows.append((10 + g * 10 + k, " ".join(edited)))
    rows += [(6, "é ü " * 3000), (10, rows[6][1]), (None, rows[6][1]), (None, "only null here at all")]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs, config).collect()), key=str)
    assert got == brute_classes(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.without_near_copies(docs).count() == 0


def test_near_copies_go(spark):
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in rng.integers(0, 5000, 300)]
    near = list(base)
    near[100] = "changed"
    other = [f"word{i}" for i in rng.integers(0, 5000, 300)]
    rows = [(1, " ".join(base), "a"), (2, " ".join(near), "b"), (3, " ".join(other), "c"), (4, " ".join(base), "d"), (None, "x", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.root for r in least_reachable(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_copies_of_every_length_go(spark):
    rng = np.random.default_rng(11)
    rows = []
    for length in (9, 12, 15, 20, 30, 50, 100, 400):
        for k in range(12):
            base = [f"word{i}" for i in rng.integers(0, 3000, length)]
            near = ([*base, "more"], [*base[:-1], "other"], base[: length - length // 8])[k % 3]
            if alike(shingles(" ".join(base)), shingles(" ".join(near))):
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows) > 150
    assert {r.doc_id for r in simhash.without_near_copies(docs).collect()} == set(range(0, len(rows), 2))


def test_band_keys_of_long_sets_do_not_depend_on_the_chunk():
    hashes = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 3000, dtype=np.uint64))
    config = simhash.JaccardConfig()
    assert np.array_equal(simhash.band_keys(hashes, config), simhash.band_keys(hashes, config, chunk=100))
    assert len(simhash.band_keys(hashes, config)) == config.bands and not len(simhash.band_keys(hashes[:0], config))


def test_classes_of_a_large_group_around_the_threshold_are_those_of_all_pairs(spark):
    """Two bases, and edits of them by one to many words, some edited again: most links lie near 0.8, most pairs are none."""
    rng = np.random.default_rng(5)
    rows = []
    for size, copies in ((60, 160), (150, 120)):
        base = [f"w{size}x{i}" for i in rng.integers(0, 4000, size)]
        made = [base]
        for k in range(copies):
            words = list(base if k % 3 else made[rng.integers(len(made))])
            for at in rng.integers(0, len(words), 1 + int(rng.integers(0, 8))):
                words[at] = f"new{rng.integers(0, 30 if k % 2 else 5000)}"
            made.append(words)
        rows += [(None, " ".join(words)) for words in made]
    rows = [(int(i), t) for i, (_, t) in zip(rng.permutation(len(rows)), rows)]
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in sets}
    assert 40 < len(set(want.values())) < len(rows) - 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (8, 2):
        got = simhash.near_copies(docs, simhash.NEAR_COPIES, simhash.JaccardConfig(small_group=small))
        assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_near_copies_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 2), (2, "a b c", "y", 3)], "doc_id long, text string, __KEPT string, root long")
    assert [tuple(r) for r in simhash.without_near_copies(docs).collect()] == [(1, "a b c", "x", 2)]

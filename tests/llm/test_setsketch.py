from collections import Counter

import numpy as np
import pytest

from listwright.llm import setsketch
from listwright.llm.jaccard import ngram_sets
from listwright.llm.setsketch import alike, band_keys, estimate, merge, near_copies, sketch_sets
from tests.llm.test_groups import brute_components, near_copies as copies


def pair(rng, size, share):
    """Two sets of about so many numbers with about this similarity."""
    both = round(2 * size * share / (1 + share))
    pool = rng.integers(0, 2**63, 2 * size - both, dtype=np.uint64)
    return np.unique(pool[:size]), np.unique(pool[size - both :])


@pytest.mark.parametrize("size", [5, 40, 700])
@pytest.mark.parametrize("share", [0.2, 0.6, 0.9])
def test_estimates_are_right_on_average(size, share):
    rng = np.random.default_rng(size)
    errors, keys = [], 0
    for _ in range(60):
        a, b = pair(rng, size, share)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = sketch_sets([a, b])
        errors.append(estimate(x, len(a), y, len(b)) - true)
        keys += bool((band_keys(x[None])[0] == band_keys(y[None])[0]).any())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert share < 0.9 or keys == 60


def test_sketches_merge_and_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    a, b = pair(rng, 300, 0.4)
    c = np.arange(3, dtype=np.uint64)
    x, y, u, z, e = sketch_sets([a, b, np.union1d(a, b), c, c[:0]])
    assert (merge(x, y) == u).all() and (e == 0).all()
    assert (sketch_sets([c])[0] == z).all() and (sketch_sets([a])[0] == x).all()


def test_registers_are_exponential():
    """The least of n hashes of rate RATE is exponential with rate n * RATE in every register."""
    rng = np.random.default_rng(3)
    least = setsketch.lowest([rng.integers(0, 2**63, 50, dtype=np.uint64) for _ in range(400)]) * 50 * setsketch.RATE
    assert abs(least.mean() - 1) < 0.02 and abs(least.std() - 1) < 0.05
    assert np.abs(least.mean(axis=0) - 1).max() < 0.3
    assert abs(np.corrcoef(least[:, :64].T)[np.triu_indices(64, 1)]).mean() < 0.06


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for size in (1, 2, 7, 30):
        first = list(rng.choice(words, 60))
        texts += [" ".join(str(rng.choice(words)) if rng.random() < 0.015 else x for x in first) for _ in range(size)]
    sets = list(ngram_sets(texts, 3))
    got = alike(sets, 85, np.arange(len(sets)))
    want = [(x, y) for x in range(len(sets)) for y in range(x) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 85 * len(np.union1d(sets[x], sets[y]))]

    def groups(links):
        label = list(range(len(sets)))
        for x, y in links:
            old, new = label[x], label[y]
            label = [new if g == old else g for g in label]
        return [label.index(g) for g in label]

    assert groups(got) == groups(want) and set(map(tuple, got)) <= set(want)


@pytest.mark.parametrize("part, percent, n", [(1500, 85, 3), (7, 80, 5)])
def test_components_equal_brute_force(spark, monkeypatch, part, percent, n):
    monkeypatch.setattr(setsketch, "PART_CLASSES", part)
    rows = [*copies(part, n), (None, "one two"), (7, "another text with the same number"), (7, "another text with the same number"), (None, None)]
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, n, percent)


def test_a_chain_in_parts_stays_whole(spark, monkeypatch):
    """Neighbours in the chain link, far ones do not; parts of three classes tear it apart."""
    monkeypatch.setattr(setsketch, "PART_CLASSES", 3)
    words = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(25)] + [(100, " ".join(words[300:]))]
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 3, 80)


def test_awkward(spark, awkward, nothing):
    got = near_copies(awkward.withColumnRenamed("part", "component").withColumnRenamed("spans", "sketch"))
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 5, 80)
    assert near_copies(nothing).count() == 0

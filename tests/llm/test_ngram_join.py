import random

import numpy as np
import pytest

from test_neardup import brute, corpus, words
from trackloom.llm import ngram_join as nj
from trackloom.llm.ngram_join import band_starts, few_differences, ngram_join, parity_bitmap, plan, segment_keys


def edited(rng, a):
    b = list(a)
    for _ in range(rng.randint(0, max(1, len(a) // 4) + 1)):
        k = rng.randint(3)
        if k == 1:
            b.append(np.uint64(rng.randint(0, 2**63)))
        elif len(b) > 1:
            b.pop(rng.randint(len(b)))
            b += [np.uint64(rng.randint(0, 2**63))] * (k == 2)
    return np.unique(np.array(b, np.uint64))


@pytest.mark.parametrize("percent,narrow", [(80, False), (60, False), (90, False), (80, True)])
def test_linked_sets_share_a_probed_key(percent, narrow, monkeypatch):
    """Whatever the sizes; with few segments there must be shares on empty and second ones, and with hashes that crowd together."""
    if narrow:
        monkeypatch.setattr(nj, "SPARE", 0)
        monkeypatch.setattr(nj, "SPARE_LEAST", 0)
    rng, met = np.random.RandomState(1), 0
    p = plan(percent, {i: 1000 for i in range(len(band_starts(percent)))})
    for _ in range(2500):
        size = int(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 30, 60, 120, 400]))
        a = np.unique(rng.randint(0, 2**63 if rng.rand() < 0.7 else 2**40, size).astype(np.uint64))
        b = edited(rng, a)
        shared = len(np.intersect1d(a, b))
        union = len(a) + len(b) - shared
        if 100 * shared < percent * union or shared == union:
            continue
        met, keys = met + 1, ({}, {})
        for lower in (False, True):
            for key, which, probe in zip(*(x.tolist() for x in segment_keys([a, b], p, lower))):
                keys[which][key] = keys[which].get(key, False) or probe
        assert any(k in keys[1] and (v or keys[1][k]) for k, v in keys[0].items())
    assert met > 200


def test_keys_tell_unlike_sets_apart():
    """Two sets of nothing in common share hardly a key: those of empty segments are probed only where little else is left."""
    rng = np.random.RandomState(2)
    p = plan(80, {i: 1000 for i in range(len(band_starts(80)))})
    for size in (6, 40, 300):
        sets = [np.unique(rng.randint(0, 2**63, size).astype(np.uint64) * np.uint64(2)) for _ in range(20)]
        keys = [np.concatenate([segment_keys([s], p, lower)[0][segment_keys([s], p, lower)[2]] for lower in (False, True)]) for s in sets]
        flat = np.concatenate([np.unique(k) for k in keys])
        assert len(flat) - len(np.unique(flat)) <= (20 if size == 6 else 2)


def test_bitmaps_never_rule_out_a_link(spark):
    rng, rows = np.random.RandomState(3), []
    for _ in range(600):
        a = np.unique(rng.randint(0, 2**63, int(rng.choice([1, 5, 60, 64, 65, 129, 700, 2100]))).astype(np.uint64))
        b = edited(rng, a) if rng.rand() < 0.8 else np.unique(rng.randint(0, 2**63, len(a)).astype(np.uint64))
        shared = len(np.intersect1d(a, b))
        side = lambda s: [len(s), *parity_bitmap(s).tolist()]
        rows.append((side(a), side(b), 100 * shared >= 80 * (len(a) + len(b) - shared), shared))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, linked boolean, shared long")
    got = df.select("linked", "shared", few_differences(80)(df["a"], df["b"]).alias("likely")).collect()
    assert all(r.likely for r in got if r.linked)
    assert sum(r.likely for r in got if not r.shared) == 0


@pytest.mark.parametrize("seed,size", [(1, 5), (2, 2)])
def test_against_all_pairs(spark, seed, size):
    rows = corpus(seed)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, size)


def test_hot_passages_and_copies(spark, monkeypatch):
    """A third of the rows are copies of one text; hundreds share a passage and stay apart but for planted links."""
    monkeypatch.setattr(nj, "REMEMBERED", 3)
    rng, passage = random.Random(6), words(random.Random(1), 40)
    rows = [" ".join(passage + words(rng, 20)) for _ in range(150)]
    rows += [r + " tail" for r in rows[::20]] + [rows[1]] * 80
    rows = list(enumerate(rows, 1))
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 5)


def test_odd_cases(spark):
    a, b = " ".join(words(random.Random(7), 60)), " ".join(words(random.Random(8), 60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (6, "one two"), (None, "one two"), (8, "x " * 30000)]
    rows += [(9, a), (9, b), (7, a + " x"), (10, b + " y")]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id int, text string, bucket int, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (None, 1, None), (8, 1, 8), (9, 56, 7), (9, 56, 9), (7, 57, 7), (10, 57, 9)],
        key=str,
    )
    empty = ngram_join(df.limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0

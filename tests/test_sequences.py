"""Sequence search against full dynamic programming over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import graph, sequences


def full(a, b):
    """Best local score by the whole table, and identity, spans of a best alignment."""
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s = sequences.SAME if a[i - 1] == b[j - 1] else sequences.OTHER
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + sequences.GAP, h[i, j - 1] + sequences.GAP)
    i, j = np.unravel_index(h.argmax(), h.shape)
    end, same, columns = (i, j), 0, 0
    while i and j and h[i, j] > 0:
        s = sequences.SAME if a[i - 1] == b[j - 1] else sequences.OTHER
        columns += 1
        if h[i, j] == h[i - 1, j - 1] + s:
            same += a[i - 1] == b[j - 1]
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + sequences.GAP:
            i -= 1
        else:
            j -= 1
    return h.max(), same / max(columns, 1), (end[0] - i) / n, (end[1] - j) / m


def mutate(rng, s, rate, alphabet):
    out = []
    for x in s:
        r = rng.random()
        if r < rate / 3:
            continue
        out.append(rng.randrange(alphabet) if r < 2 * rate / 3 else x)
        if r > 1 - rate / 3:
            out.append(rng.randrange(alphabet))
    return out or [0]


@pytest.fixture(scope="module")
def every():
    rng = random.Random(8)
    out, n = {}, 0
    for _ in range(12):
        base = [rng.randrange(500) for _ in range(rng.randint(4, 90))]
        for _ in range(rng.randint(1, 6)):
            out[n] = mutate(rng, base, rng.choice([0, 0.05, 0.15, 0.3]), 500)
            n += 1
    hot = [rng.randrange(500) for _ in range(40)]
    for k in range(70):  # more than one subgroup shares its k-mers
        out[n + k] = mutate(rng, hot, 0.06, 500)
    n += 70
    out |= {n: out[0], n + 1: [7], n + 2: [7], n + 3: [7, 7, 7, 7], n + 4: [1] * 300, n + 5: [1] * 280}
    return out


def frame(spark, every):
    rows = [(k, [x for x in s], "x") for k, s in every.items()] + [(9000, None, "x"), (9001, [], "x")]
    return spark.createDataFrame(rows, "id long, s array<long>, rep string").repartition(4)


def test_search_recall_and_values(spark, every):
    found = {(r.a, r.b): r for r in sequences.search(frame(spark, every)).collect()}
    first = {}
    for k in sorted(every):
        first.setdefault(tuple(every[k]), k)
    reps = sorted(first.values())
    assert {x for pair in found for x in pair} <= set(reps) and all(a < b for a, b in found)
    want, hit, small = 0, 0, 0
    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            _, identity, qc, tc = full(every[a], every[b])
            if identity >= 0.5 and min(qc, tc) >= 0.8:
                want += 1
                r = found.get((a, b))
                if r is not None:
                    hit += 1
                    small += abs(r.identity - identity) < 0.1 and abs(r.query_coverage - qc) < 0.1 and abs(r.target_coverage - tc) < 0.1
    print(f"pairs of full alignment {want}, found {hit}, of the same identity and coverage {small}; aligned {len(found)} of {len(reps) * (len(reps) - 1) // 2}")
    assert want > 500 and hit >= 0.9 * want and small >= 0.98 * hit
    assert len(found) < len(reps) * (len(reps) - 1) // 3


def test_band_gives_the_scores_of_the_whole_table():
    rng = random.Random(3)
    a = [np.array([rng.randrange(30) for _ in range(rng.randint(1, 40))]) for _ in range(40)]
    b = [np.array(mutate(rng, list(x), 0.3, 30)) for x in a]
    got = sequences.align(a, b, np.zeros(40, int), band=80)
    for k in range(40):
        assert got[k, 0] == full(a[k], b[k])[0]


def test_edges_feed_components(spark, every):
    pairs = sequences.similar(sequences.search(frame(spark, every)), 0.5, 0.8)
    labels = {r.id: r.component for r in graph.components(spark.createDataFrame([(k,) for k in every], "id long"), pairs).collect()}
    reps = {r.id: r.rep for r in sequences.members(frame(spark, every)).collect()}
    hot = Counter(labels[reps[k]] for k in range(max(every) - 75, max(every) - 5))
    assert hot.most_common(1)[0][1] >= 66


def test_members_and_words(spark, every):
    rows = {r.id: r.rep for r in sequences.members(frame(spark, every)).collect()}
    assert set(rows) == set(every) and rows[max(every) - 5] == 0
    text = spark.createDataFrame([(1, "One  two\nTWO"), (2, " "), (3, None)], "id long, text string").select("id", sequences.words(F.col("text")).alias("s"))
    got = {r.id: r.s for r in text.collect()}
    assert len(got[1]) == 3 and got[1][1] == got[1][2] and got[2] == [] and got[3] is None


def test_sequences_are_made_once(spark, every):
    """residues were made anew for every join of the search."""
    made = spark.sparkContext.accumulator(0)

    def own(s):
        made.add(1)
        return s

    seqs = frame(spark, every).where("size(s) > 0").withColumn("s", F.udf(own, "array<long>")("s"))
    assert sequences.search(seqs).count() > 500
    assert made.value == len(every)


def test_rows_whose_band_misses_the_other_sequence_are_left_out():
    low, size = sequences.reach(np.array([20000, 20000, 5]), np.array([10, 10, 20000]), np.array([0, 15000, -9000]))
    assert list(low) == [0, 15000 - sequences.BAND, 0] and list(size) == [10 + sequences.BAND, 10 + 2 * sequences.BAND, 5]


def test_kmers_hash_as_spark_does(spark):
    s = [5, -7, 2**62, 0, 5, -(2**63)]
    want = [r.h for r in spark.createDataFrame([(s[i : i + 3],) for i in range(4)], "s array<long>").select(F.xxhash64("s").alias("h")).collect()]
    assert list(sequences._kmers(np.array(s), 3)) == want

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import near_duplicates as nd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgÉ") for _ in range(5))
    base = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 30, 400]))) for _ in range(120)]
    for t in base[:40]:
        w = t.split()
        w[rng.randrange(len(w))] = word()
        base += [t, t.upper(), " ".join(w)]
    return base + [None, "", " \n\t", "A B", "a b", "x " * 5000, "x " * 5000 + "y"]


def test_fingerprints_and_components(spark):
    rows = [(1000 - i, t, "mine") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    own, found = nd.near_duplicate_groups(df)
    got = {r["doc_id"]: r for r in own.drop("component_id").join(found, "__f0", "left").collect()}
    prints = {i: brute_print(t) for i, t, _ in rows}
    assert {i: r["__f0"] % 2**64 for i, r in got.items()} == prints
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r["component_id"] for i, r in got.items()} == groups(pairs, prints)


@pytest.mark.parametrize("near", [nd.EXACT, nd.LIKE])
def test_bit_slices_find_every_pair(near):
    rng = np.random.default_rng(3)
    n = 700
    values = rng.integers(0, 2**63, (n, near.bits // 64), dtype=np.uint64)
    for i in range(1, n):  # half of the rows are a few bits from the one before
        if rng.random() < 0.5:
            values[i] = values[i - 1]
            for _ in range(rng.integers(0, 2 * near.radius)):
                values[i, rng.integers(near.bits // 64)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    sizes = [1, 1, 2, 63, 64, 65, 130, 2]
    sizes.append(n - sum(sizes))
    starts, ends = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.cumsum(sizes), sizes)
    found = sorted((int(a), int(b)) for x in nd._hits(values, starts, ends, near) for a, b in zip(*x))
    want = [(i, j) for i in range(n) for j in range(i + 1, ends[i]) if np.bitwise_count(values[i] ^ values[j]).sum() <= near.radius]
    assert found == want
    labels = nd.stars(values, starts, ends, near)
    assert groups(want, range(n)) == dict(enumerate(labels.tolist()))


def test_stars_keep_links_of_earlier_batches():
    """One block of many batches: links of late rows tie what early rows had linked."""
    rng = np.random.default_rng(5)
    n = 5000
    values = rng.integers(0, 2**63, (n, 1), dtype=np.uint64)
    bits = lambda *of: np.uint64(sum(1 << b for b in of))
    values[5], values[4001], values[4002] = bits(), bits(0, 1), bits(2, 3)
    values[4501], values[4502] = bits(0, 1, 4, 5), bits(2, 3, 8, 9)
    values[3], values[2] = bits(0, 1, 4, 5, 6, 7), bits(2, 3, 8, 9, 10, 11)
    for i in range(600, 4000, 2):  # and pairs that span batches
        values[i] = values[i - 600] ^ bits(i % 64) if i >= 1200 else values[i]
    starts, ends = np.zeros(n, dtype=np.int64), np.full(n, n)
    batches = list(nd._hits(values, starts, ends, nd.EXACT))
    assert len(batches) > 5
    labels = nd.stars(values, starts, ends, nd.EXACT)
    assert {labels[i] for i in (2, 3, 5, 4001, 4002, 4501, 4502)} == {2}
    assert groups([(int(a), int(b)) for x in batches for a, b in zip(*x)], range(n)) == dict(enumerate(labels.tolist()))


def test_components_of_chains_and_hubs(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200 + i, 199) for i in range(50)] + [(500, 3), (7, 7 - 1)]
    got = {r["node"]: r["component"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == groups(edges, nodes)
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(80):
        w = [word() for _ in range(rng.choice([60, 200, 600]))]
        rows.append((i, " ".join(w)))
        for k in range(3):
            v = list(w)
            for at in rng.sample(range(len(v)), max(1, len(v) // 80)):
                v[at] = word()
            rows.append((1000 + 10 * i + k, " ".join(v)))
    rows += [(5000, rows[0][1]), (5000, rows[0][1]), (None, rows[0][1]), (6000, None), (6001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__x", F.lit(1))
    left = sorted(r["doc_id"] for r in nd.drop_near_duplicates(df).collect())
    assert set(range(80)) <= set(left) and 6000 in left and 6001 not in left and 5000 not in left
    assert len(left) <= 80 + 1 + 4  # near all near copies, at the recall of the blocks
    small = nd.drop_near_duplicates(df, nd.Near(shingle=5, bits=128, radius=36, repeats=False, max_block=16))
    assert set(range(80)) <= {r["doc_id"] for r in small.collect()}
    assert nd.drop_near_duplicates(df.limit(0)).count() == 0


def covered(words, shingles):
    """The share of words that stand in one of the shingles, in plain loops."""
    own = {p for k in range(len(words) - 4) if tuple(words[k : k + 5]) in shingles for p in range(k, k + 5)}
    return len(own) / len(words)


def test_only_similar_sets_are_near_copies(spark):
    """Documents that share long passages lie within the radius and stay; near copies and chains of them go."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(1000)]
    texts = {}
    for i in range(30):  # each shares 750 words with any other: three quarters
        texts[i] = base[:750] + [word() for _ in range(250)]
    for i in range(30, 60):  # a chain, each with 30 more words of its own than the one before
        texts[i] = texts[i - 1][30:] + [word() for _ in range(30)] if i > 30 else [word() for _ in range(600)]
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in texts.items()}
    similar = [(a, b) for a in sets for b in sets if a < b and covered(texts[a], sets[b]) * len(texts[a]) + covered(texts[b], sets[a]) * len(texts[b]) >= 0.8 * (len(texts[a]) + len(texts[b]))]
    within = [int.from_bytes(nd.fingerprint(" ".join(texts[i]), nd.LIKE)) for i in range(30)]
    assert sum((a ^ b).bit_count() <= nd.LIKE.radius for i, a in enumerate(within) for b in within[:i]) > 30
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    want = sorted(set(groups(similar, sets).values()))
    assert want[:30] == list(range(30)) and len(want) == 31
    for near in (nd.LIKE, nd.Near(shingle=5, bits=128, radius=36, repeats=False, max_texts=8)):
        assert sorted(r["doc_id"] for r in nd.drop_near_duplicates(df, near).collect()) == want


def test_similarity_of_shingle_sets():
    near = lambda a, b: nd.in_common(nd.shingles_of(a, nd.LIKE), nd.shingles_of(b, nd.LIKE), nd.LIKE)
    assert near("a b c d e f g", "B, c. D e f g") == pytest.approx(12 / 13) and near("a b c d e f g x y", "c d e f g z q") == pytest.approx(10 / 16)
    # Two edited words of twenty take ten of sixteen shingles, but only themselves from the words that are covered.
    words = [chr(97 + i) * 2 for i in range(20)]
    edited = [w if i not in (6, 13) else "new" for i, w in enumerate(words)]
    assert near(" ".join(words), " ".join(edited)) == pytest.approx(covered(edited, {tuple(words[k : k + 5]) for k in range(16)})) == pytest.approx(18 / 20)
    assert near("", "a") == 0 == near("", "...") and near("É_1 b", "é 1 B!") == 1


def test_near_copies_at_scale_of_edits(spark):
    """Of copies with a word in thirty edited, and the marks beside it, nine in ten at least go; recall against brute force."""
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(6))
    texts, copies = {}, set()
    for i in range(150):
        w = [word() for _ in range(rng.choice([90, 200, 450]))]
        texts[10 * i] = w
        for k in range(1, 4):
            v = [(word() + rng.choice(["", ".", ","]) if rng.random() < 1 / 45 else x) for x in w]
            texts[10 * i + k] = v
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    kept = {r["doc_id"] for r in nd.drop_near_duplicates(df).collect()}
    sets = {i: nd.shingles_of(" ".join(w), nd.LIKE) for i, w in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b < a + 10 and a // 10 == b // 10 and nd.in_common(sets[a], sets[b], nd.LIKE) >= 0.8]
    want = set(groups(pairs, sets).values())
    assert want <= kept and len(texts) - len(kept) >= 0.95 * (len(texts) - len(want)) and len(texts) - len(want) >= 0.8 * 450


def test_texts_that_share_nothing_are_no_candidates(spark, monkeypatch):
    """Fingerprints lie within a wide radius by chance; only texts that share a shingle are looked at together."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    texts = {i: [word() for _ in range(60)] for i in range(400)}
    texts |= {1000 + i: [*texts[i][:30], word(), *texts[i][31:]] for i in range(20)}
    near = nd.Near(shingle=5, bits=128, radius=52, repeats=False)
    prints = [int.from_bytes(nd.fingerprint(" ".join(texts[i]), near)) for i in range(400)]
    assert sum((a ^ b).bit_count() <= near.radius for i, a in enumerate(prints) for b in prints[:i]) > 800
    sizes, verified = [], nd.verified_links

    def watched(distinct, candidates, *rest):
        sizes.extend(r["count"] for r in candidates.groupBy("component").count().collect())
        return verified(distinct, candidates, *rest)

    monkeypatch.setattr(nd, "verified_links", watched)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nd.drop_near_duplicates(df, near).collect()) == list(range(400))
    assert sizes == [2] * 20


def test_similar_sets_share_a_least_hash():
    """At the least cosine, where the smaller set lies in the other, as at any Jaccard similarity, orders agree as often as they should."""
    rng, orders = np.random.default_rng(4), nd._orders(nd.LIKE)
    met, agreed = 0, 0
    for _ in range(2000):
        large = rng.integers(0, 2**64, 200, dtype=np.uint64)
        same = nd.least_hashes(large, orders) == nd.least_hashes(large[: round(200 * nd.LIKE.candidates**2)], orders)
        met, agreed = met + same.any(), agreed + same.mean()
    assert met / 2000 >= nd.LIKE.recall - 0.01 and agreed / 2000 == pytest.approx(nd.LIKE.candidates**2, abs=0.02)
    assert nd.least_hashes(np.zeros(0, dtype=np.uint64), orders).tolist() == [0] * len(orders)

"""Substring deduplication: against all windows of all documents in plain loops."""

import hashlib
import random

import pytest

from colloquy.llm import substring_dedup as sub


def brute(rows):
    docs = [(d, sub.LAST if d is None else d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for _, did, w in docs:
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            least[key] = min(did, least.get(key, did))
    out = []
    for d, did, w in docs:
        gone = {p for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < did for p in range(i, i + 13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def corpus(seed):
    """Passages of 5 to 40 words dealt into documents with other words around, few words so that runs repeat by chance."""
    rng = random.Random(seed)
    some = lambda n, k: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzé"[:k]) for _ in range(n))
    passages = [some(rng.choice([5, 12, 13, 14, 20, 40]), 27) for _ in range(12)]
    out = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.6 else some(rng.randint(0, 30), rng.choice([2, 3, 27])) for _ in range(rng.randint(0, 6))]
        out.append((i * 3 % 151, "  ".join(parts)))
    out += [(d, out[rng.randrange(50)][1].replace("  ", "\n")) for d in range(200, 240)]
    hot = some(30, 27)
    out += [(d, f"{some(4, 27)} {hot} {some(4, 27)}") for d in range(300, 380)]
    return [*out, (None, passages[0] * 3), (None, None), (1, None), (7, hot), (7, hot), (7, hot + " other"), (-5, passages[5] + " x"), (400, "a " * 5000), (401, "a " * 20), (402, "b a " * 2000)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_windows(spark, seed):
    rows = corpus(seed)
    clash = "doc_id long, text string, rid int, did int, words string, anchor int, owner string"
    docs = spark.createDataFrame([(d, t, 1, 2, "w", 3, "o") for d, t in rows], clash).repartition(7)
    assert sorted(repr(tuple(r)) for r in sub.digests(sub.remove_repeats(docs)).collect()) == brute(rows)
    assert sub.remove_repeats(docs.limit(0)).count() == 0


def test_spans_and_kept_text(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"one {passage} two"), (2, f"three four {passage} five"), (3, passage.replace("w30 ", "other "))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sub.remove_repeats(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["kept"] == f"one {passage} two" and got[1]["spans"] == []
    assert [tuple(s) for s in got[2]["spans"]] == [(2, 62)] and got[2]["kept"] == "three four five"
    assert [tuple(s) for s in got[3]["spans"]] == [(0, 30), (31, 60)] and got[3]["kept"] == "other"


def test_a_factor_goes_on_as_far_as_words_agree():
    words = [b"%d" % i for i in range(100)]
    grams = sub._grams(words)
    anchor = int(sub._least(grams)[20])
    at = int(sub._places(grams, sub._least(grams))[20])
    spans, loose = sub.factors(words, 5, [(1, words[10:80], [anchor], [at - 10])])
    start = int((sub._least(grams) == anchor).nonzero()[0][0])
    assert spans == [(start, 80)] and loose == []
    assert sub.factors(words, 1, [(1, words[10:80], [anchor], [at - 10])]) == ([], [])
    spans, loose = sub.factors(words, 5, [(1, [b"x"] * 80, [anchor], [at - 10])])
    assert spans == [] and start in loose

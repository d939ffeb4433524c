import random
import zlib

import duckdb
import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from colloquy.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string, size int"


def rows():
    rng = random.Random(5)
    out = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "a", "a", "b", "é", None]), 7) for i in range(600)]
    return out + [(1, None, "a", 7), (None, "x y", "b", 7), (None, None, None, 7), (2, "same words", "Z", 7), (2, "same words", "Z", 7)]


def test_mix_is_the_sql(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.with_copies(mixing.with_size(df.select("doc_id", "source", "text")).drop("text")).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows(), columns=["doc_id", "text", "source", "size"]).astype({"doc_id": "Int64"}))
    want = con.execute(mixing.ORACLE).df()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype(float).round(6).fillna(-9).to_numpy().tolist()))
    assert key(got) == key(want)
    assert (got.taken <= 2 * got["size"]).all()


def test_mix_meets_targets(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    own = mixing.with_copies(mixing.with_size(df)).toPandas()
    by = own.groupby(own.source.fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 and (by.target <= 2 * by["size"] + 1e-9).all()
    assert ((by.taken - by.target).abs() <= 300).all()  # the longest document
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns and mixed.count() == own.copies.sum()
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_fill_level(spark):
    df = spark.createDataFrame([(0, "a", 100), (1, "b", 10), (2, "c", 1000)], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    # b stops at 20, a at 200, the rest goes to c.
    assert got == {"a": 200.0, "b": 20.0, "c": 1445.0}


def test_tokens_are_the_tokenizers():
    own, whole, rng = packing.WordTokenizer(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER), random.Random(2)
    odd = "aÀéß' sSdDtT1²_-<|>\t\n\x0b\x1f\xa0\x85́ςΣİ日😀"
    texts = ["", " ", "Don't STOP, it's 3.14 <|endoftext|>x y<|", *["".join(rng.choice(odd) for _ in range(50)) for _ in range(300)]]
    for t in texts:
        assert own.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def check_plan(histogram, capacity):
    runs, room = sorted(packing.plan(histogram, capacity)), {}
    assert sum(histogram.values()) > 0
    by = {}
    for length, first, each, seq, offset in runs:
        by.setdefault(length, []).append((first, each, seq, offset))
    for length, n in histogram.items():
        own = by[length]
        for rank in range(n):
            first, each, seq, offset = [r for r in own if r[0] <= rank][-1]
            b, slot = divmod(rank - first, each)
            room.setdefault(seq + b, []).append((offset + slot * length, length))
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(room)


def test_plan_fills_without_gaps():
    rng = random.Random(1)
    for capacity in (10, 97, 2048):
        for _ in range(20):
            histogram = {}
            for _ in range(rng.randint(1, 400)):
                n = min(capacity, max(1, int(rng.expovariate(4 / capacity))))
                histogram[n] = histogram.get(n, 0) + 1
            used, least = check_plan(histogram, capacity), -(-sum(k * v for k, v in histogram.items()) // capacity)
            assert used <= 1.25 * least + 1
    assert check_plan({6: 2, 4: 2}, 10) == 2 and check_plan({5: 3}, 10) == 2 and check_plan({3: 7}, 10) == 3


def test_packing_round_trip(spark):
    rng, whole = random.Random(4), Tokenizer.from_file(packing.TOKENIZER)
    texts = [" ".join(rng.choice(["sun", "moon", "étoile", "1984"]) for _ in range(rng.choice([0, 3, 50, 700, 5000]))) for _ in range(60)] + [None, "", "same", "same"]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)] + [(None, "lost", "y")], "doc_id long, text string, piece string")
    got = packing.best_fit_packing(df).toPandas()
    want = []
    for i, t in [*zip(ids, texts), (None, "lost")]:
        tokens = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(-1 if i is None else i, k, k * 2048, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(tokens[a : a + 2048] for a in range(0, len(tokens), 2048))]
    assert sorted(want) == sorted(got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False, name=None))
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.best_fit_packing(df.limit(0)).count() == 0

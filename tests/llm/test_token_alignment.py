"""Alignment of two tokenizers: against plain loops with the libraries named for the files, and the hash by itself."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from colloquy.llm import token_alignment as ta


@pytest.fixture(scope="module")
def plain():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts():
    rng = random.Random(4)
    odd = ["a", "the ", " ", "  ", "\n", "\t", "é", "é", "日本", "😀", "<|endoftext|>", "<s>", "<unk>", "\x00", "1", "23", "'s", "\xa0", " ", "-", "ization", "Straße "]
    made = ["".join(rng.choice(odd) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    words = ["tokenization of words that are somewhat unusual", "The quick brown fox", "naïve café über", "a" * 3000, "a▁b", "x  y", "   "]
    return ["", None, *words, *words, *made, "word " * 8_000]


def brute(plain, rows):
    first, second = plain
    letters = ta._byte_letters()
    docs, counts = [], Counter()
    for text in rows:
        whole = b" " + (text or "").encode()
        a = first.encode(" " + text, add_special_tokens=False) if text else None
        b = second.encode(text) if text else []
        spelled_a = [bytes(letters[c] for c in t) for t in a.tokens] if text else []
        pieces = [second.id_to_piece(i) for i in b]
        spelled_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            docs.append(([], [], [], []))
            continue
        sa, sb = spans(spelled_a), spans(spelled_b)
        links, j = [], 0
        for i, (s, e) in enumerate(sa):
            while j and sb[j][0] > s:
                j -= 1
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((a.ids[i], b[k]))
                k += 1
        counts.update(links)
        docs.append((a.ids, b, links, (sa, sb)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for a, b, links, ends in docs:
        if not a:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        sa, sb = ends
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, i, j = [], 0, 0
        for end in common:
            x, y = [], []
            while i < len(sa) and sa[i][1] <= end:
                x.append(str(a[i]))
                i += 1
            while j < len(sb) and sb[j][1] <= end:
                y.append(str(b[j]))
                j += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out


def spans(spelled):
    out, at = [], 0
    for s in spelled:
        out.append((at, at + len(s)))
        at += len(s)
    return out


@pytest.mark.parametrize(("part_bytes", "fan"), [(ta.PART_BYTES, 16), (40_000, 2)])
def test_every_link(spark, plain, monkeypatch, part_bytes, fan):
    """At once, and with the table in several parts and vectors summed in a tree of several levels."""
    monkeypatch.setattr(ta, "BUCKET", 50)
    monkeypatch.setattr(ta, "FAN", fan)
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(rows)], "doc_id long, text string, a int, n string, pair int").repartition(16)
    got = {r["doc_id"]: tuple(r)[1:] for r in ta.described(ta.align(docs, part_bytes=part_bytes)).collect()}
    want = brute(plain, rows)
    assert sum(w[0] > 0 for w in want) > 100 and sum(w[0] == 0 for w in want) >= 4
    assert [got[i] for i in range(len(rows))] == want


def test_no_rows_and_no_tokens(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ta.described(ta.align(empty)).count() == 0
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r)[1:] for r in ta.described(ta.align(docs)).collect()))) == [str((0, 0, 0, 0, 0, 0, ""))] * 3


def test_same_ids_as_the_files_library(plain):
    tools, (first, _) = ta.tokenizers(ta.FIRST, ta.SECOND), plain
    rng = random.Random(9)
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x1F600, 0x1F650)) + list(range(0xFE00, 0x10000))
    texts = [" " + "".join(rng.choice([chr(rng.choice(points)), "a", "1", " ", "'s", "."]) for _ in range(60)) for _ in range(3000)]
    assert [tools.encoding.encode_ordinary(t) for t in texts] == [e.ids for e in first.encode_batch(texts, add_special_tokens=False)]


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        pairs = np.unique(rng.integers(0, 50_000 * 32_000, n))
        sizes, bits = ta.build_hash(pairs)
        numbers = ta.Numbering(0, 1, [sizes], [bits]).of(pairs)
        assert sorted(numbers.tolist()) == list(range(len(pairs)))
        assert ta._unpacked(sizes, np.packbits(bits).tobytes()).tolist() == bits.tolist()

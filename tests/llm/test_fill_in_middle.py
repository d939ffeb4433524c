"""Fill-in-the-middle: against plain string slices, at frame borders and over odd texts."""

import hashlib

import zstandard

from colloquy.llm import fill_in_middle as fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by string slices."""
    text = text or ""
    n, digest = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def rows():
    odd = ["a", "é", "日", "😀", "\n", "<", "<P", "<S", "<M", ">", "\x00", "P>", "́"]
    texts = ["", "a", "<", "<P", "x<S>y", "<M>", *["".join(odd[(i * j + j // 3) % len(odd)] for j in range(i * 7)) for i in range(60)]]
    texts += ["😀é" * (fim.FRAME + k) + "end" for k in (-1, 0, 1)] + ["w " * 900_000]
    out = list(enumerate(texts)) + [(i, f"text of {i}") for i in range(100, 160)]
    return out + [(5, None), (None, "no id"), (None, None), (-3, "below"), (7, "again"), (7, "again")]


def test_outputs_and_digests(spark):
    clash = "doc_id long, text string, n string, output int, frames int, form int"
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows()], clash)
    filled = fim.fill_in_middle(docs)
    want = sorted(map(repr, ((i, *plain(i, t)) for i, t in rows())))
    assert sorted(repr(tuple(r)) for r in fim.with_text(filled).collect()) == want
    got = sorted(repr(tuple(r)) for r in fim.digests(filled).collect())
    assert got == sorted(repr((i, *(p := plain(i, t))[:4], sha(p[4]), sha(t or ""))) for i, t in rows())
    assert {r["form"] for r in fim.digests(filled).collect()} == {"plain", "psm", "spm"}
    assert fim.digests(fim.fill_in_middle(docs.limit(0))).count() == 0


def test_only_cut_frames_are_unpacked():
    pack, opened = zstandard.ZstdCompressor().compress, []
    text = "".join(chr(97 + i % 26) for i in range(5 * fim.FRAME))
    frames = fim._numbered(fim._packed(text, pack))
    assert len(frames) == 5 and [f[0] for f in frames] == [k * fim.FRAME for k in range(5)]

    def unpack(data):
        opened.append(data)
        return zstandard.ZstdDecompressor().decompress(data)

    cut = fim._numbered(fim._cut(frames, 10, 3 * fim.FRAME + 5, pack, unpack))
    assert opened == [frames[0][2], frames[3][2]] and [f[2] for f in cut[1:3]] == [frames[1][2], frames[2][2]]
    opened.clear()
    assert b"".join(fim.read_units(frames, 2 * fim.FRAME + 1, 2 * fim.FRAME + 4, unpack)) == text[2 * fim.FRAME + 1 : 2 * fim.FRAME + 4].encode()
    assert opened == [frames[2][2]]

"""Operator 13, fill-in-the-middle over seekable compressed frames.

A text is stored as independent zstandard frames of FRAME code points, each with the number of code
points (units) before it, so that any span is read by decompressing the frames it touches. The cuts
of a document depend on its doc_id and its number of units alone. To transform it, only the frames
that hold a cut are decompressed; the others become frames of the output as they are. Digests read
frames in order, one at a time, and a text is rebuilt from the output by finding its markers in the
stream and reading the parts by their places.

A task holds a batch of few documents, in frames. Nothing is shuffled.

Defined results: a null text is an empty one and plain, with one digest of the empty string; a null
doc_id counts as the empty string where its decimal digits are asked for; rows that are repeated are
transformed each; an empty table gives no rows; a text of any length is cut anywhere; columns besides
doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FRAME, LEVEL = 16_384, 3
MARKERS = ("<P>", "<S>", "<M>")

Frame = tuple[int, int, bytes]  # units before it, its units, its compressed UTF-8
FRAMES = "array<struct<start:long,units:int,data:binary>>"
_FRAMES = pa.list_(pa.struct([("start", pa.int64()), ("units", pa.int32()), ("data", pa.binary())]))


def _numbered(parts: Iterable[tuple[int, bytes]]) -> list[Frame]:
    out, at = [], 0
    for units, data in parts:
        out.append((at, units, data))
        at += units
    return out


def _packed(text: str, pack: Callable[[bytes], bytes]) -> Iterator[tuple[int, bytes]]:
    for at in range(0, len(text), FRAME):
        part = text[at : at + FRAME]
        yield len(part), pack(part.encode())


def _touched(frames: list[Frame], start: int, end: int) -> Iterator[tuple[Frame, int, int]]:
    """The frames that hold units of [start, end), with the span of each within it."""
    if start >= end:
        return
    for k in range(bisect_right(frames, start, key=lambda f: f[0]) - 1, len(frames)):
        at, units, _ = frames[k]
        if at >= end:
            return
        yield frames[k], max(0, start - at), min(units, end - at)


def _cut(frames: list[Frame], start: int, end: int, pack: Callable[[bytes], bytes], unpack: Callable[[bytes], bytes]) -> Iterator[tuple[int, bytes]]:
    """Frames of the units of [start, end): whole ones as they are, cut ones packed anew."""
    for (_, units, data), a, b in _touched(frames, start, end):
        yield (units, data) if b - a == units else (b - a, pack(unpack(data).decode()[a:b].encode()))


def read_units(frames: list[Frame], start: int, end: int, unpack: Callable[[bytes], bytes]) -> Iterator[bytes]:
    """The UTF-8 of the units of [start, end), a frame at a time."""
    for (_, units, data), a, b in _touched(frames, start, end):
        yield unpack(data) if b - a == units else unpack(data).decode()[a:b].encode()


def _length(frames: list[Frame]) -> int:
    return frames[-1][0] + frames[-1][1] if frames else 0


def restored(frames: list[Frame], form: str, unpack: Callable[[bytes], bytes]) -> Iterator[bytes]:
    """The text that an output of this form was made from, a frame at a time.

    No text in psm or spm has a marker, so the first occurrence of each is the one that was put there.
    """
    end = _length(frames)
    if form == "plain":
        return read_units(frames, 0, end, unpack)
    second, third = ("<S>", "<M>") if form == "psm" else ("<P>", "<M>")
    found, before = {}, ""
    for at, _, data in frames:
        seen = before + unpack(data).decode()
        for marker in (second, third):
            if marker not in found and (place := seen.find(marker)) >= 0:
                found[marker] = at - len(before) + place
        before = seen[-2:]
    first, last = (3, found[second]), (found[third] + 3, end)
    between = (found[second] + 3, found[third])
    spans = (first, last, between) if form == "psm" else (between, last, first)
    return (part for a, b in spans for part in read_units(frames, a, b, unpack))


def _rows(column: pa.Array) -> list[list[Frame]]:
    return [[(f["start"], f["units"], f["data"]) for f in row] for row in column.to_pylist()]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        n, marked, frames = [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            n.append(len(text))
            marked.append(any(m in text for m in MARKERS))
            frames.append(_numbered(_packed(text, pack)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), pa.array(frames, _FRAMES)], ["doc_id", "n", "marked", "frames"])


def store_frames(docs: DataFrame) -> DataFrame:
    """(doc_id, n, marked, frames) of every document, written: n code points; marked: the text has a marker of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return materialize(own.mapInArrow(_store, f"doc_id {kind}, n long, marked boolean, frames {FRAMES}"), "frames")


def _draw(k: int) -> Column:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def with_cuts(stored: DataFrame) -> DataFrame:
    """stored with form, prefix_chars and middle_chars."""
    one, other = F.pmod(_draw(1), F.col("n") + 1), F.pmod(_draw(2), F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (F.pmod(_draw(3), F.lit(100)) >= 90)
    form = F.when(plain, "plain").when(F.pmod(_draw(4), F.lit(100)) < 20, "spm").otherwise("psm")
    return stored.withColumns({"form": form, "prefix_chars": F.when(~plain, F.least(one, other)), "middle_chars": F.when(~plain, F.abs(one - other))})


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack, unpack = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
    mark = {m: (len(m), pack(m.encode())) for m in MARKERS}
    for batch in batches:
        outputs = []
        for frames, n, form, prefix, middle in zip(_rows(batch.column("frames")), *(batch.column(c).to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars")), strict=True):
            if form == "plain":
                outputs.append(frames)
                continue
            ends = {"<P>": (0, prefix), "<M>": (prefix, prefix + middle), "<S>": (prefix + middle, n)}
            order = ("<P>", "<S>", "<M>") if form == "psm" else ("<S>", "<P>", "<M>")
            outputs.append(_numbered(f for m in order for f in (mark[m], *_cut(frames, *ends[m], pack, unpack))))
        columns = [c for c in batch.schema.names if c != "frames"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(outputs, _FRAMES)], [*columns, "output"])


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): output is the transformed text, in frames."""
    cut = with_cuts(store_frames(docs)).drop("marked")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut.mapInArrow(_transform, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output {FRAMES}")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        columns = [c for c in batch.schema.names if c != "output"]
        texts = [b"".join(read_units(f, 0, _length(f), unpack)).decode() for f in _rows(batch.column("output"))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, "output"])


def with_text(filled: DataFrame) -> DataFrame:
    """What fill_in_middle returns, with output as one string, for those who don't read frames."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in filled.schema if f.name != "output")
    return filled.mapInArrow(_texts, f"{schema}, output string")


def _digest(parts: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        output, text = [], []
        for frames, form in zip(_rows(batch.column("output")), batch.column("form").to_pylist(), strict=True):
            output.append(_digest(read_units(frames, 0, _length(frames), unpack)))
            text.append(_digest(restored(frames, form, unpack)))
        columns = [c for c in batch.schema.names if c != "output"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(output, pa.string()), pa.array(text, pa.string())], [*columns, "output_sha256", "restored_sha256"])


def digests(filled: DataFrame) -> DataFrame:
    """What fill_in_middle returns, with the SHA-256 of the output and of the text rebuilt from it in place of the output."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in filled.schema if f.name != "output")
    return materialize(filled.mapInArrow(_digests, f"{schema}, output_sha256 string, restored_sha256 string"), "filled")


ORACLE = """
WITH own AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (
    SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS b,
        CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS e FROM own),
formed AS (
    SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form,
        least(a, b) AS x, greatest(a, b) AS y FROM drawn),
parted AS (SELECT *, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parted
"""

"""Operator 12, substring deduplication by relative Lempel-Ziv parsing.

A window is WINDOW consecutive words. Words are removed that lie in a window which also starts in a
document of a smaller doc_id. Documents are factored against blocks of reference text:

1. Every window has an anchor: of its runs of GRAM words the one of least hash, the first of equals.
   Equal windows have equal anchors, so a window whose anchor is in one document only repeats
   nowhere. Of all anchors (two in nine words) those of two documents or more are kept.
2. The reference is the first occurrence of each such anchor: in its document of least doc_id, cut
   into blocks of BLOCK words with what stands around them, which index their anchors.
3. A document gets every block that holds one of its anchors, and is factored greedily: from a window
   that its anchor's block has at the same place as far as the words agree. Factors are at least a
   window long. The windows over a factor's end are tried again, with anchors and blocks of their own.
4. A window whose words differ from its block's may still repeat a later document's: such windows at
   the borders of factors, few, are looked up by 128-bit digests of their words.

It is whole: let f be the first document with window W. A later document with W either has it in a
factor of a smaller document, or compares it with the block of W's anchor. If that block has W, its
document is f, and W is in a factor; if not, the comparison fails in f and everywhere else, and the
lookup meets them all.

No task holds more of the corpus than a document and the blocks of its own anchors (at most some
twenty times its own words), and what is common to many documents is one block, sent to each.

Defined results: a null text has no words; a null doc_id comes after all others, and rows with the
same or no doc_id repeat nothing from each other; a row that is repeated has its result twice; texts
under WINDOW words lose nothing; an empty table gives no rows; texts of any length are parsed whole;
columns besides doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, scratch_folder

WINDOW, GRAM, BLOCK = 13, 6, 64
#: Anchors that a window chooses from.
CHOICE = WINDOW - GRAM + 1
#: Words before the first and after the last anchor's place in a block, so that it has all windows of its anchors.
AROUND = WINDOW - GRAM
LAST = (1 << 63) - 1

# Odd multipliers that mix the hashes of words (any would do).
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) + 2 * k & 0xFFFFFFFFFFFFFFFF for k in range(1, GRAM + 1)], np.uint64) | np.uint64(1)


def _grams(words: list[bytes]) -> np.ndarray:
    """48-bit hashes of the runs of GRAM words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for k in range(GRAM):
        g += h[k : k + n] * _MIX[k]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xD6E8FEB86659FD93)
    return (g >> np.uint64(16)).astype(np.int64)


def _least(grams: np.ndarray) -> np.ndarray:
    """The anchor of each window."""
    out, width = grams, 1
    while width < CHOICE:
        step = min(width, CHOICE - width)
        out, width = np.minimum(out[:-step], out[step:]), width + step
    return out


def _places(grams: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where each window's anchor stands first."""
    at = np.empty(len(least), np.int64)
    start = np.arange(len(least))
    for k in reversed(range(CHOICE)):
        np.copyto(at, start + k, where=grams[k : k + len(least)] == least)
    return at


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, texts, anchors = [], [], []
        for value in batch.column("text"):
            words = (value.as_py() or "").encode().split()
            n.append(len(words))
            texts.append(b" ".join(words).decode())
            anchors.append(np.unique(_least(_grams(words))) if len(words) >= WINDOW else [])
        own = [batch.column("rid"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array(anchors, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(own, ["rid", "doc_id", "n_words", "words", "anchors"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid, owner, block, start, texts, anchors, offsets = [], [], [], [], [], [], []
        for row in batch.to_pylist():
            words = row["words"].encode().split()
            grams = _grams(words)
            least = _least(grams)
            first = np.unique(grams, return_index=True)  # where each run of words stands first
            wanted = np.intersect1d(np.array(row["owned"], np.int64), least)
            where = first[1][np.searchsorted(first[0], wanted)]
            for k in np.unique(where // BLOCK):
                inside = where // BLOCK == k
                begin = max(0, int(k) * BLOCK - AROUND)
                rid.append(row["rid"])
                owner.append(row["did"])
                block.append(int(k))
                texts.append(b" ".join(words[begin : (int(k) + 1) * BLOCK + GRAM + AROUND]).decode())
                anchors.append(wanted[inside])
                offsets.append((where[inside] - begin).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid, pa.int64()), pa.array(owner, pa.int64()), pa.array(block, pa.int32()), pa.array(texts, pa.string()), pa.array(anchors, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int32()))],
            ["owner_rid", "owner", "block", "reference", "indexed", "offsets"],
        )


def factors(words: list[bytes], did: int, blocks: list[tuple[int, list[bytes], list[int], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of words that repeat a block of a smaller document, and windows that no block settles.

    blocks: (doc_id, words, anchors, their offsets) of each.
    """
    grams = _grams(words)
    least = _least(grams)
    places = _places(grams, least)
    index = {a: (k, o) for k, (_, _, anchors, offsets) in enumerate(blocks) for a, o in zip(anchors, offsets, strict=True)}
    sent = np.isin(least, np.fromiter(index, np.int64, len(index)))
    # Of other anchors this document has the first place itself, or the only one: windows at others of its places are compared with that.
    runs, at = np.unique(grams, return_index=True)
    first = at[np.searchsorted(runs, least)]
    spans, open_windows, done = [], [], 0
    for i in np.flatnonzero(sent | (places != first)).tolist():
        if i < done:
            continue
        within = int(places[i]) - i
        if sent[i]:
            k, offset = index[int(least[i])]
            owner, reference, _, _ = blocks[k]
        else:
            owner, reference, offset = did, words, int(first[i])
        r = offset - within
        if r < 0 or words[i : i + WINDOW] != reference[r : r + WINDOW]:
            open_windows.append(i)
        elif owner < did:
            end, r = i + WINDOW, r + WINDOW
            while end < len(words) and r < len(reference) and words[end] == reference[r]:
                end, r = end + 1, r + 1
            spans.append((i, end))
            done = end - WINDOW + 1  # the windows over the factor's end are tried next
    return spans, open_windows


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, digests, starts = [], [], []
        for row in batch.to_pylist():
            words = row["words"].encode().split()
            found, open_windows = factors(words, row["did"], [(b["owner"], b["reference"].encode().split(), b["indexed"], b["offsets"]) for b in row["blocks"]])
            spans.append(found)
            starts.append(open_windows)
            digests.append([xxhash.xxh3_128_digest(b" ".join(words[i : i + WINDOW])) for i in open_windows])
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("did"), pa.array(spans, _SPANS), pa.array(starts, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))], ["rid", "did", "spans", "starts", "digests"]
        )


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept, merged = [], [], []
        for text, found in zip(batch.column("words").to_pylist(), batch.column("found").to_pylist(), strict=True):
            spans: list[list[int]] = []
            for start, stop in sorted((s["start"], s["stop"]) for part in found or [] for s in part):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([start, stop])
            merged.append([tuple(s) for s in spans])
            removed.append(sum(b - a for a, b in spans))
            if spans:
                words, out, at = text.split(" "), [], 0
                for a, b in spans:
                    out += words[at:a]
                    at = b
                text = " ".join(out + words[at:])
            kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(merged, _SPANS), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row: spans of removed words, [start, stop), and the kept words joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    own = materialize(numbered.mapInArrow(_prepare, f"rid long, doc_id {kind}, n_words long, words string, anchors array<long>"), "words", drop_shuffles=True)
    own = own.withColumn("did", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    texts = own.where(F.col("n_words") >= WINDOW).select("rid", "did", "words")

    with scratch_folder(docs.sparkSession) as early:
        seen = own.select("rid", "did", F.explode("anchors").alias("anchor"))
        shared = seen.groupBy("anchor").agg(F.min("did").alias("owner"), F.max("did").alias("last")).where("owner < last").select("anchor", "owner")
        shared = materialize(seen.join(materialize(shared, "anchors", drop_shuffles=True), "anchor"), "shared", drop_shuffles=True)

        first = shared.where("did = owner").groupBy("anchor").agg(F.min("rid").alias("rid"))
        owned = first.groupBy("rid").agg(F.collect_list("anchor").alias("owned"))
        schema = "owner_rid long, owner long, block int, reference string, indexed array<long>, offsets array<int>"
        blocks = materialize(texts.join(owned, "rid").mapInArrow(_blocks, schema), "blocks", drop_shuffles=True)

    places = blocks.select("owner_rid", "block", F.explode("indexed").alias("anchor"))
    needed = shared.select("rid", "anchor").join(places, "anchor").where("rid <> owner_rid").select("rid", "owner_rid", "block").distinct()
    sent = needed.join(blocks, ["owner_rid", "block"]).select("rid", F.struct("owner", "reference", "indexed", "offsets").alias("block"))
    # Documents with blocks are factored whether they get any or not, for what others may share with them.
    own_blocks = blocks.select(F.col("owner_rid").alias("rid"), F.lit(None).cast(sent.schema["block"].dataType).alias("block"))
    sent = sent.unionByName(own_blocks).groupBy("rid").agg(F.collect_list("block").alias("blocks"))
    parsed = texts.join(sent, "rid").select("rid", "did", "words", "blocks")
    parsed = materialize(parsed.mapInArrow(_parse, "rid long, did long, spans array<struct<start:long,stop:long>>, starts array<long>, digests array<binary>"), "parsed", drop_shuffles=True)
    remove(docs.sparkSession, early)

    loose = parsed.select("rid", "did", F.explode(F.arrays_zip("starts", "digests")).alias("w")).select("rid", "did", F.col("w.starts").alias("start"), F.col("w.digests").alias("digest"))
    again = loose.groupBy("digest").agg(F.min("did").alias("least"), F.max("did").alias("last")).where("least < last").select("digest", "least")
    late = loose.join(again, "digest").where("did > least").select("rid", F.array(F.struct("start", (F.col("start") + WINDOW).alias("stop"))).alias("spans"))
    found = parsed.where(F.size("spans") > 0).select("rid", "spans").unionByName(late).groupBy("rid").agg(F.collect_list("spans").alias("found"))
    found = materialize(found, "spans", drop_shuffles=True)
    kept = own.select("rid", "doc_id", "n_words", "words").join(found, "rid", "left").select("doc_id", "n_words", "words", "found")
    return kept.mapInArrow(_keep, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string")


def digests(kept: DataFrame) -> DataFrame:
    """What remove_repeats returns, with the SHA-256 of the kept words in place of them."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH own AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {LAST}) AS did, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT rid, did, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS t FROM (SELECT rid, did, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM own)),
firsts AS (SELECT t, min(did) AS least FROM windows GROUP BY t HAVING min(did) < max(did)),
late AS (SELECT rid, i FROM windows JOIN firsts USING (t) WHERE did > least),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM late),
places AS (SELECT rid, list(p) AS ps FROM gone GROUP BY rid),
words AS (SELECT rid, p, w[p] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM own)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM own LEFT JOIN places USING (rid) LEFT JOIN kept USING (rid)
"""

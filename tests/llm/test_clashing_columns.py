"""Columns named like the operators' own come along untouched."""

from pyspark.sql import functions as F

from colloquy.llm import language_id, mixing, near_duplicates, url_filters

OWN = ["__ll", "__n", "__best", "__slice", "__class", "__mix", "__ps", "__bad", "__rule", "__f0", "__row", "__set", "__given", "given_0", "rank", "n", "b", "k", "w", "level", "bad", "mix_row"]


def with_own(df):
    return df.withColumns({c: F.concat(F.lit(c), F.col(df.columns[0]).cast("string")) for c in OWN})


def same(got, key):
    rows = got.select(key, *OWN).collect()
    return rows and all(r[c] == f"{c}{r[key]}" for r in rows for c in OWN)


def test_all(spark):
    text = "the cat and the dog went over the hill to the old town by the sea"
    docs = spark.createDataFrame([(i, f"{text} {i % 7} and {'so ' * (i % 5)}on", "en", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string, source string")
    plain = language_id.identify(language_id.document_evidence(docs))
    found = language_id.identify(language_id.document_evidence(with_own(docs)))
    assert same(found, "doc_id") and found.count() == 40 and set(plain.columns) | set(OWN) == set(found.columns)
    sized = mixing.with_copies(mixing.with_size(with_own(docs)))
    assert same(sized, "doc_id") and sized.agg(F.sum("taken")).first() == mixing.with_copies(mixing.with_size(docs)).agg(F.sum("taken")).first()
    assert same(mixing.mix_sources(with_own(docs)), "doc_id")
    kept = near_duplicates.drop_near_duplicates(with_own(docs))
    assert same(kept, "doc_id") and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in near_duplicates.drop_near_duplicates(docs).collect())
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}") for i in range(12)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 3 == 0) for i in range(12)], "page_id long, bad boolean").withColumn("bad", F.col("bad").cast("int"))
    judged = url_filters.judge(with_own(pages), outcomes)
    assert same(judged, "page_id") and sorted(r["verdict"] for r in judged.collect()) == sorted(r["verdict"] for r in url_filters.judge(pages, outcomes).collect())

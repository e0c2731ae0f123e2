"""License scan by diagonal voting.

Every rolling word k-gram of a document that occurs in a template votes, through a Spark join
from gram hashes to template positions, for the diagonal ``document position - template position``.
Neighbouring diagonals of a template (insertions and deletions shift them) are merged and a span is accepted
when enough distinct template positions agree and the span is not much longer than the template.

k is four, or the template's length where that is less; a template of up to four words is
found exactly where its words stand consecutively. A filter over the template grams (templates are bounded
by ``MAX_WORDS``) lets only document grams through that can vote. The join compares the gram's words as
well as its hash, so a hash collision is no match.

Defined results: a NULL or empty text has no words, no labels and score 0; repeated rows give
repeated results; an empty table gives an empty result; templates without words are an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.texts import ALPHANUMERIC, Words, bounded, list_array, map_arrow, window_owners, windows, words
from tillsight.session import stage

K = 4
MAX_WORDS = 1_000_000
NEIGHBOURS = 3
COVERAGE = 0.7
STRETCH = 1.5


class Template(NamedTuple):
    label: str
    text: str


def _grams(found: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start word and text of every k-gram inside one text."""
    starts, owner = window_owners(found.first, k)
    return windows(found.hashes, k)[starts], starts, owner


def _gram_text(found: Words, start: int, k: int) -> str:
    return " ".join(found.word(i) for i in range(start, start + k)).translate(_LOWER)


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_grams(templates: Sequence[Template]) -> list[tuple[int, str, int, int, int, int, str]]:
    """Rows (template, label, n_words, n_grams, position, hash, gram)."""
    rows, total = [], 0
    for number, template in enumerate(templates):
        found = words(pa.array([template.text]), ALPHANUMERIC)
        n = len(found.starts)
        total += n
        if not n or total > MAX_WORDS:
            raise ValueError("templates need words, and no more than MAX_WORDS together")
        k = min(K, n)
        hashes, starts, _ = _grams(found, k)
        for h, start in zip(hashes.view(np.int64).tolist(), starts.tolist(), strict=True):
            rows.append((number, template.label, n, n - k + 1, start, h, _gram_text(found, start, k)))
    return rows


GRAM_SCHEMA = "template int, label string, n_words int, n_grams int, position int, hash long, gram string"


def spans(docs: DataFrame, templates: Sequence[Template]) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, n_words), and the accepted spans of templates in them.

    Spans: row, template, label, start and last word, coverage (share of the template's grams).
    """
    spark = docs.sparkSession
    rows = template_grams(templates)
    sizes = sorted({min(K, r[2]) for r in rows})
    listed = spark.sparkContext.broadcast(np.unique(np.array([r[5] for r in rows], np.int64).view(np.uint64)))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed.value
        low = np.zeros(1 << 20, bool)
        low[known & np.uint64((1 << 20) - 1)] = True
        for batch in bounded(batches):
            found = words(batch.column("text"), ALPHANUMERIC)
            parts = []
            for k in sizes:
                hashes, starts, owner = _grams(found, k)
                hit = np.flatnonzero(low[hashes & np.uint64((1 << 20) - 1)])
                hit = hit[np.isin(hashes[hit], known)]
                parts.append((owner[hit], starts[hit], hashes[hit], np.full(len(hit), k)))
            owner, starts, hashes, size = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(owner, kind="stable")
            owner, starts, hashes, size = owner[order], starts[order], hashes[order], size[order]
            grams = [_gram_text(found, s, k) for s, k in zip(starts.tolist(), size.tolist(), strict=True)]
            counts = np.bincount(owner, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), pa.array(np.diff(found.first), pa.int64()),
                    list_array((starts - found.first[owner]).astype(np.int32), counts, pa.int32()),
                    list_array(hashes.view(np.int64), counts, pa.int64()), list_array(grams, counts, pa.string()),
                ],
                ["row", "doc_id", "n_words", "position", "hash", "gram"],
            )

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_words long, position array<int>, hash array<long>, gram array<string>"
    scanned = stage(map_arrow(narrow, vote, schema), "license_votes")
    hits = scanned.select("row", F.explode(F.arrays_zip("position", "hash", "gram")).alias("hit")).select(
        "row", F.col("hit.position").alias("at"), F.col("hit.hash").alias("hash"), F.col("hit.gram").alias("gram")
    )
    votes = hits.join(spark.createDataFrame(rows, GRAM_SCHEMA), ["hash", "gram"])
    diagonals = votes.groupBy("row", "template", "label", "n_words", "n_grams", (F.col("at") - F.col("position")).alias("diagonal")).agg(
        F.collect_set("position").alias("positions"), F.min("at").alias("start"), F.max("at").alias("last")
    )
    whole = F.col("n_grams") == 1
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS
    place = F.sum(F.when(F.coalesce(far, F.lit(False)) | whole, 1).otherwise(0)).over(order)
    merged = diagonals.withColumn("place", place).groupBy("row", "template", "label", "n_words", "n_grams", "place").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("votes"), F.min("start").alias("start"),
        F.max("last").alias("last"),
    )
    covered = F.col("votes") / F.col("n_grams")
    fits = F.col("last") - F.col("start") < F.col("n_grams") * F.lit(STRETCH) + NEIGHBOURS
    accepted = merged.where((covered >= COVERAGE) & fits).select("row", "template", "label", "start", "last", covered.alias("coverage"))
    return scanned.select("row", "doc_id", "n_words"), accepted


def label_documents(docs: DataFrame, phrases: Sequence[Template], templates: Sequence[Template]) -> DataFrame:
    """One row per document: places of the base ``phrases`` and the labels of phrases and ``templates``."""
    rows, found = spans(docs, [*phrases, *templates])
    base = F.col("template") < len(phrases)
    summary = found.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    )
    return rows.join(summary, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

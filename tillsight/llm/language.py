"""Language identification with bit-sliced Bloom filters over byte n-grams.

The model is one table of ``SLOTS`` bit masks with a bit for every language. An n-gram reads ``PROBES`` slots
and the AND of their masks is the set of all languages that list it. A language lists the n-grams whose share of
its own text is at least ``MIN_SHARE`` and at least ``DOMINANCE`` of the largest share in any language. Per language the hits of a text are counted (popcount of its bit) and corrected by the
filter's false positive rate for that language; the largest corrected count decides.

An n-gram is ``GRAM`` bytes of the text with A-Z lower-cased and every other ASCII byte taken as a
blank; n-grams of blanks only do not count. Whole texts are read.

Training reads labelled rows only. Their number is bounded in expectation by ``TRAIN_ROWS`` per
language: a hash of the id selects the same share of rows everywhere. Counting is a grouped sum over
(language, n-gram); as shares add up to 1, at most ``1 / MIN_SHARE`` rows per language reach the driver.

Defined results: a text that is NULL, empty or without a letter is ``und`` with score 0; a text without any
listed n-gram gets the most frequent language with score 0; ties go to the smaller language name;
with no labelled rows every text is ``und``; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.texts import bounded, flat, map_arrow, mix
from tillsight.session import stage

GRAM = 4
SLOTS = 1 << 20
PROBES = 3
MIN_SHARE = 1 / 50_000
DOMINANCE = 0.5
TRAIN_ROWS = 20_000
MIN_COVERAGE = 0.05
UNKNOWN = "und"

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_BLANKS = np.uint32(0x20202020)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts as 32-bit values, and where each text's begin (one more entry at the end)."""
    data, offsets = flat(column)
    folded = _LETTER[data].astype(np.uint32)
    n = max(len(data) - GRAM + 1, 0)
    packed = np.zeros(n, np.uint32)
    for i in range(GRAM):
        packed = (packed << np.uint32(8)) | folded[i : i + n]
    keep = packed != _BLANKS
    for back in range(1, GRAM):  # windows that run over the end of a text
        inner = offsets[1:-1] - back
        keep[inner[(inner >= 0) & (inner < n)]] = False
    return packed[keep], np.concatenate(([0], np.cumsum(keep)))[np.minimum(offsets, n)]


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.array([text is not None and any(map(str.isalpha, text)) for text in texts.to_pylist()], bool)


@dataclass
class Model:
    """Languages in order of name, the sliced filter, false positive rates, and the most frequent language."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    default: int

    @staticmethod
    def places(values: np.ndarray) -> Iterator[np.ndarray]:
        scrambled = mix(values.astype(np.uint64) + np.uint64(1))
        for i in range(PROBES):
            yield ((scrambled >> np.uint64(21 * i)) % np.uint64(SLOTS)).astype(np.int64)

    def masks(self, values: np.ndarray) -> np.ndarray:
        """Languages that list each n-gram, as bytes of bit masks."""
        out = None
        for place in self.places(values):
            found = self.slots[place]
            out = found if out is None else out & found
        return out

    def counts(self, values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Corrected number of listed n-grams of each text (rows) and language (columns)."""
        masks = self.masks(values)
        total = np.diff(edges)[:, None]
        hits = np.empty((len(edges) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            member = (masks[:, k >> 3] >> np.uint8(k & 7)) & np.uint8(1)
            hits[:, k] = np.diff(np.concatenate(([0], np.cumsum(member, dtype=np.int64)))[edges])
        return np.maximum((hits - total * self.false_rate) / (1 - self.false_rate), 0)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Model of the texts and non-NULL ``lang`` values of ``labelled`` (doc_id, text, lang)."""
    rows = labelled.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).withColumn("share", F.lit(float(train_rows)) / F.col("rows"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(F.broadcast(sizes.select("lang", "share")), "lang").where(unit < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            values, edges = grams(batch.column("text"))
            names = batch.column("lang").to_pylist()
            for name in sorted(set(names)):
                member = np.repeat([n == name for n in names], np.diff(edges))
                found, n = np.unique(values[member], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )

    counted = stage(map_arrow(chosen, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    same_gram = Window.partitionBy("gram")  # at most one row per language
    listed = shares.where(F.col("share") >= MIN_SHARE).withColumn("best", F.max("share").over(same_gram))
    found = listed.where(F.col("share") >= F.col("best") * DOMINANCE).select("lang", "gram").collect()
    return assemble([tuple(r) for r in found], {r["lang"]: r["rows"] for r in sizes.collect()})


def assemble(listed: list[tuple[str, int]], sizes: dict[str, int]) -> Model:
    """Set the bits of (language, n-gram) pairs and measure each language's false positive rate."""
    languages = sorted(sizes)
    slots = np.zeros((SLOTS, (len(languages) + 7) // 8), np.uint8)
    rates = np.zeros(len(languages))
    for k, name in enumerate(languages):
        values = np.array([g for lang, g in listed if lang == name], np.int64)
        for place in Model.places(values):
            slots[place, k >> 3] |= np.uint8(1 << (k & 7))
        filled = ((slots[:, k >> 3] >> np.uint8(k & 7)) & np.uint8(1)).mean() if SLOTS else 0.0
        rates[k] = filled**PROBES
    default = min(range(len(languages)), key=lambda k: (-sizes[languages[k]], languages[k]), default=0)
    return Model(languages, slots, rates, default)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (the language's part of all corrected counts) and ``coverage`` (its part of the n-grams)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in bounded(batches):
            letters = has_letter(batch.column("text"))
            if not model.languages:
                letters[:] = False
            values, edges = grams(batch.column("text"))
            counts = model.counts(values, edges) if model.languages else np.zeros((batch.num_rows, 1))
            best, top, total = counts.argmax(axis=1), counts.max(axis=1), counts.sum(axis=1)
            best = np.where(top > 0, best, model.default)
            score = np.where(letters & (total > 0), top / np.maximum(total, 1e-300), 0.0)
            coverage = np.where(letters, np.minimum(top / np.maximum(np.diff(edges), 1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(names[np.where(letters, best, -1)], pa.string()),
                    pa.array(np.clip(score, 0.0, 1.0)), pa.array(coverage),
                ],
                ["doc_id", "lang_pred", "score", "coverage"],
            )

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_arrow(narrow, decide, f"doc_id {kind}, lang_pred string, score double, coverage double")


def identified(docs: DataFrame, model: Model, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The documents whose language is one of the model's, with all their columns.

    Rejected are texts without a letter and texts of which less than ``min_coverage`` belongs to the
    predicted language. A text with letters that is too short for an n-gram (fewer than ``GRAM`` bytes) shows
    no foreign language and stays, unless the model has none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in bounded(batches):
            values, edges = grams(batch.column("text"))
            counts = model.counts(values, edges)
            coverage = counts.max(axis=1, initial=0) / np.maximum(np.diff(edges), 1)
            short = (np.diff(edges) == 0) & bool(model.languages)
            yield batch.filter(pa.array(has_letter(batch.column("text")) & (short | (coverage >= min_coverage))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, keep, schema)


def held_out(docs: DataFrame) -> Column:
    """True for the fifth of documents, by the CRC-32 of their id, that is kept from training."""
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0

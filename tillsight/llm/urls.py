"""URL filters: a blocked Bloom filter over the listed prefixes, then an exact hash join.

A list has rows (host, path, verdict). An entry fits a URL when the URL's host is the entry's
host or one of its subdomains and the URL's path starts with the entry's path; of the fitting
entries the longest ``host + path`` decides (ties: the longest host).

Every URL is tested against its host's suffixes and those prefixes of its path whose length occurs in
the list. The Bloom filter, of a size fixed by ``filter_bits`` whatever the list holds, is
broadcast and lets only possible hits through; these are joined exactly, which removes the
false positives. The list itself is never forced into a broadcast.

Defined results: a NULL URL, or one without ``://``, has an empty host and path and fits
nothing; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.bloom import Bloom, build
from tillsight.llm.texts import UPPER, hash_spans, map_arrow
from tillsight.session import stage

FILTER_BITS = 1 << 22


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    rest = F.coalesce(F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _text_hashes(texts: list[bytes]) -> np.ndarray:
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    return hash_spans(np.frombuffer(b"".join(texts), np.uint8), ends - lengths, ends)


def _keys(hosts: Iterable[str], paths: Iterable[str]) -> np.ndarray:
    """Hash of host, zero byte and path; the zero byte also keeps every span non-empty."""
    return _text_hashes([f"{h}\0{p}".encode() for h, p in zip(hosts, paths, strict=True)])


def listed(rules: DataFrame, level: int) -> DataFrame:
    """The list in canonical form, one row for each host and path: the verdict is the smallest of repeated ones."""
    clean = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    host = F.translate(F.col("host"), UPPER, UPPER.lower())
    return clean.groupBy(F.lit(level).alias("level"), host.alias("host"), "path").agg(F.min("verdict").alias("verdict"))


def _filter(rules: DataFrame, bits: int) -> tuple[Bloom, list[int]]:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["hash"])

    bloom = build(map_arrow(rules.select("host", "path"), hashed, "hash long"), bits)
    return bloom, sorted(row[0] for row in rules.select(F.char_length("path")).distinct().collect())


def matches(urls: DataFrame, rules: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """For each fitted ``row`` of ``urls`` (row, host, path): ``level``, ``rule`` and ``verdict`` of the deciding entry.

    ``row`` must be unique; ``rules`` are canonical, and lower levels go before higher ones. Besides
    the filter, only the distinct lengths of the list's paths are collected.
    """
    bloom, lengths = _filter(rules, filter_bits)
    shared = urls.sparkSession.sparkContext.broadcast((bloom, lengths))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, lengths = shared.value
        for batch in batches:
            owner, hosts, paths = [], [], []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                labels = host.split(".")
                fitting = [path[:n] for n in lengths if n <= len(path)]
                for k in range(len(labels)):
                    suffix = ".".join(labels[k:])
                    owner += [i] * len(fitting)
                    hosts += [suffix] * len(fitting)
                    paths += fitting
            if not owner:
                continue
            hit = np.flatnonzero(bloom.maybe(_keys(hosts, paths)))
            rows = batch.column("row").take(pa.array(np.array(owner, np.int64)[hit]))
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array([hosts[i] for i in hit], pa.string()), pa.array([paths[i] for i in hit], pa.string())],
                ["row", "host", "path"],
            )

    possible = map_arrow(urls, probe, "row long, host string, path string")
    text = F.concat("host", "path")
    rank = F.struct(-F.col("level"), F.char_length(text), F.char_length("host"))
    best = F.max_by(F.struct("level", text.alias("rule"), "verdict"), rank)
    return possible.join(rules, ["host", "path"]).groupBy("row").agg(best.alias("best")).select("row", "best.*")


def judge(pages: DataFrame, rules: DataFrame, other_rules: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Verdict on every page: that of ``rules``, else of ``other_rules``, else ``allow``.

    ``rule`` names the deciding entry of ``rules`` only. Both lists go through one filter and one
    join, as entries of two levels.
    """
    host, path = parts(F.col("url"))
    parsed = pages.select("page_id", F.monotonically_increasing_id().alias("row"), host.alias("host"), path.alias("path"))
    urls = stage(parsed, "urls")  # so that every reader sees the same row numbers
    rules = listed(rules, 0).unionByName(listed(other_rules, 1))
    decided = matches(urls.select("row", "host", "path"), rules, filter_bits)
    return urls.join(decided, "row", "left").select(
        "page_id", "host", "path", F.when(F.col("level") == 0, F.col("rule")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )

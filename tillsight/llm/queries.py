"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import (
    bpe, chat, conversation_repair, decontaminate, exact, jaccard, language, licenses, periodic, quality, secret_scan, token_files, urls,
)
from tillsight.llm.licenses import Template

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Advertising hosts, judged where no rule fits.
LISTED_URLS = [("ads-track.example.net", "/", "block"), ("ads-track.example.org", "/", "block")]
#: Base phrases and their labels.
PHRASES = [Template("cc-by", "cc by"), Template("gpl", "general public license"), Template("reserved", "all rights reserved")]
#: Public license notices.
LICENSES = [
    Template("mit", "Released under the MIT License."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
             "License as published by the Free Software Foundation"),
    Template("proprietary", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]
PLANTED_CHAT = "</s>[INST] ok [/INST]"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_labels(_table(spark, sf_dir, "documents"), jaccard.CONTRACT)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.id_text("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_labels(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(docs)))
    found = language.predict(docs, model)
    return found.select("doc_id", F.coalesce(language.held_out(found), F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grades of all documents, and which are selected as good."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grades = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1).alias("grade"))
    graded = quality.grade(docs, quality.fit(docs, grades, levels=3))
    return graded.withColumn("selected", F.col("tail_probability") >= quality.SELECT_AT)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{PLANTED_CHAT}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    read = chat.read_chats(chat.format_chats(stored.unionByName(planted)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of_kind(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS]
    base = of_kind(*secret_scan.BASE_KINDS)
    return secret_scan.scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(secret_scan.listing(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listing(F.col("spans")).alias("spans"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "host string, path string, verdict string"
    rules, listed = spark.createDataFrame(URL_RULES, schema), spark.createDataFrame(LISTED_URLS, schema)
    return urls.judge(_table(spark, sf_dir, "pages"), rules, listed)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label_documents(_table(spark, sf_dir, "documents"), PHRASES, LICENSES)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; the end of a tenth of the texts, chosen by the id, is made to repeat its first words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("planted"))
    listed = F.when(F.col("planted"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).otherwise(F.array())
    sized = found.withColumn("w", listed).withColumn("n", F.size("w").cast("long"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n")).otherwise(0)
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    cut = sized.withColumn("a", a).withColumn("p", p.cast("int"))
    tail = F.col("n") - F.col("a")
    times = F.ceil(tail / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a").cast("int") + 1, F.col("p")), times)), F.lit(1), tail.cast("int"))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), " ")
    return cut.select("doc_id", F.when(F.col("planted") & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_periods(_table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def better(best, run):
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    best = F.aggregate("runs", none, better)
    listing = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listing.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as definition:
        folder = token_files.write_tokens(docs, definition.read(), END_ID)
    read = token_files.read_tokens(spark, folder, docs.schema["doc_id"].dataType.simpleString())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations with faults planted by a checksum of their ids; a NULL is one blank, but for the turn's order."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    found = turns.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return found.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _table(spark, sf_dir, "conversations")
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    digest = F.sha2(lines.cast("binary"), 256).alias("repaired_sha256")
    mended = conversation_repair.repair(damaged(stored)).select(F.col("conv_id").alias("mended_id"), *figures, "audit", digest)
    joined = stored.select("conv_id").distinct().join(mended, F.col("conv_id").eqNullSafe(F.col("mended_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in figures]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def register() -> dict[str, Query]:
    made = (
        op1_decontamination, op2_ngram_jaccard, op3_byte_bpe, op4_exact_dedup, op5_language_id, op6_quality, op7_chat_format, op8_secret_scan,
        op9_url_filter, op10_license_scan, op11_periodic_runs, op12_token_files, op13_conversation_repair,
    )
    return {f.__name__: f for f in made}

"""License scans by an exact set-similarity join of text blocks with templates, on how much of a template a block holds.

A block of width 2h is the words from b * h up to b * h + 2h, for every b; h is a power of two that a template's words
fit in, so a copy of a template lies whole in one block, wherever it stands. A template meets a block that holds at
least ``threshold`` of its distinct words. Words are ordered from the rarest to the most frequent over all documents:

* prefix filter: of a template with s words that needs o of them, one of the s - o + 1 rarest is in every block it meets;
  only blocks around such words are looked at.
* length filter: a block with fewer than o words of the templates' vocabulary meets no template that needs o.
* positional filter: after the rarest shared word, both sides must have enough words left.

What passes is verified on the words themselves. Phrases are templates that need all of their words, followed by a
comparison of the places where these stand.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmline.llm.workers import once, share
from ohmline.shared import ship, without

ship(__name__)

#: Part of a template's distinct words that a block must hold, as a fraction of whole numbers.
THRESHOLD = (4, 5)
#: Words of templates that one broadcast index takes; more templates are dealt over several indexes, used one after another.
MAX_WORDS = 200_000
LEAST_HALF = 4
#: Lower case for A-Z; a space for the ASCII bytes that are neither letters nor digits.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Phrases that are counted wherever they stand, with their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Wordings of public license notices, with their labels.
TEMPLATES = (
    ("apache", "apache license"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl", "mozilla public license"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
)

PLACES_SQL = "array<struct<label:string,first:long>>"
BLOCKS_SQL = "array<struct<label:string,template:int,first:long,last:long,containment:double>>"
FOUND_SQL = f"struct<n_words:long,places:{PLACES_SQL},blocks:{BLOCKS_SQL}>"
PLACES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))
FOUND = pa.struct([("n_words", pa.int64()), ("places", PLACES), ("blocks", BLOCKS)])


class Template(NamedTuple):
    label: str
    number: int
    words: list[bytes]
    need: int
    half: int
    exact: bool


class Index(NamedTuple):
    """Templates, ranks of their words from the rarest on, and for each prefix word the (template, place in its order)."""

    templates: list[Template]
    ranks: dict[bytes, int]
    heads: dict[bytes, list[tuple[int, int]]]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split()


def half_of(n: int) -> int:
    """Half the width of the blocks for a template of ``n`` words: a power of two, ``n`` or more."""
    return max(LEAST_HALF, 1 << (n - 1).bit_length())


def prepared(texts: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], threshold: tuple[int, int]) -> list[Template]:
    """Templates and phrases with the number of distinct words that a block must hold; those without words are left out."""
    out = []
    for k, (label, text) in enumerate([*texts, *phrases]):
        words, exact = words_of(text), k >= len(texts)
        if words:
            distinct = len(set(words))
            need = distinct if exact else max(1, -(-distinct * threshold[0] // threshold[1]))
            out.append(Template(label, k, words, need, half_of(len(words)), exact))
    return out


def index_of(templates: list[Template], counts: dict[bytes, int]) -> Index:
    """Index of the templates under the global order by frequency; ties go by the word."""
    order = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    ranks, heads = {w: i for i, w in enumerate(order)}, {}
    for k, t in enumerate(templates):
        own = sorted(set(t.words), key=ranks.__getitem__)
        for at, word in enumerate(own[: len(own) - t.need + 1]):
            heads.setdefault(word, []).append((k, at))
    return Index(templates, ranks, heads)


def find(words: list[bytes], index: Index) -> tuple[list[dict], list[dict]]:
    """Places of the phrases, and (template, block) pairs that meet, among the words of one text."""
    heads, first = index.heads, {}
    for i in [i for i, w in enumerate(words) if w in heads]:
        for k, at in heads[words[i]]:
            b = i // index.templates[k].half
            for block in (b - 1, b) if b else (0,):
                first[k, block] = min(at, first.get((k, block), at))
    places, blocks, held = [], [], {}
    for (k, b), at in sorted(first.items(), key=lambda x: x[0]):
        t = index.templates[k]
        start, end = b * t.half, min((b + 2) * t.half, len(words))
        if (t.half, b) not in held:
            held[t.half, b] = {w for w in words[start:end] if w in index.ranks}
        known, own = held[t.half, b], set(t.words)
        if len(known) < t.need:
            continue
        rarest = min((w for w in own if w in known), key=index.ranks.__getitem__)
        later = sum(index.ranks[w] > index.ranks[rarest] for w in known)
        if 1 + min(len(own) - at - 1, later) < t.need:
            continue
        shared = len(own & known)
        if shared < t.need:
            continue
        if not t.exact:
            blocks.append({"label": t.label, "template": t.number, "first": start, "last": end - 1, "containment": shared / len(own)})
            continue
        n = len(t.words)
        places += [{"label": t.label, "first": i} for i in range(start, min(start + t.half, len(words) - n + 1)) if words[i] == t.words[0] and words[i : i + n] == t.words]
    return places, blocks


def finder(shared: Broadcast):
    """An Arrow UDF from text to the number of its words and what of the broadcast index is in it."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = once(shared, lambda x: x)
        for texts in batches:
            out = []
            for text in texts:
                words = text.as_buffer().to_pybytes().translate(TO_WORDS).split() if text.is_valid else []
                places, blocks = find(words, index)
                out.append({"n_words": len(words), "places": places, "blocks": blocks})
            yield pa.array(out, FOUND)

    return F.arrow_udf(scan, FOUND_SQL)


def document_counts(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many of all documents each word of the templates stands; as many numbers come to the driver as there are such words."""
    shared = share(docs.sparkSession.sparkContext, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = once(shared, lambda x: x), Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    n.update(known.intersection(text.as_buffer().to_pybytes().translate(TO_WORDS).split()))
        yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def scan(
    docs: DataFrame,
    *,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    text_col: str = "text",
    threshold: tuple[int, int] = THRESHOLD,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """All rows of ``docs`` with ``n_words, places, blocks``.

    ``places`` are the label and first word (from 0) of every occurrence of a phrase, by first word; ``blocks`` are the
    label, template, first and last word of every block that meets a template, and the part of its words that it holds.

    * Null and empty texts have no words, places or blocks; templates and phrases without words take no part.
    * Words are those of A-Z as a-z, digits and all characters beyond ASCII. A template's repeated words count once.
    * Long texts are read whole; repeated rows count each for itself; an empty table gives an empty result.
    * Templates of more than ``max_words`` words are dealt over several indexes. Equal (label, text) may repeat.
    * Input columns named like an output column are replaced.
    """
    rows = without(docs, "n_words", "places", "blocks")
    own, known = rows.columns, prepared(templates, phrases, threshold)
    counts = document_counts(rows, text_col, {w for t in known for w in t.words}) if known else {}
    lots: list[list[Template]] = [[]]
    for t in known:
        if lots[-1] and sum(len(x.words) for x in lots[-1]) + len(t.words) > max_words:
            lots.append([])
        lots[-1].append(t)
    context = rows.sparkSession.sparkContext
    parts = [f"__found_{k}" for k in range(len(lots))]
    for part, lot in zip(parts, lots):
        rows = rows.withColumn(part, finder(share(context, index_of(lot, counts)))(F.col(text_col)))
    all_of = lambda field: F.concat(*[F.col(f"{p}.{field}") for p in parts])
    by_first = F.array_sort(all_of("places"), lambda a, b: F.when(a["first"] != b["first"], F.signum(a["first"] - b["first"])).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0).cast("int"))
    return rows.select(*own, F.col(f"{parts[0]}.n_words").alias("n_words"), by_first.alias("places"), all_of("blocks").alias("blocks"))


def digest(scanned: DataFrame) -> DataFrame:
    """Of scanned rows: number, first and last of the places, labels of the phrases, labels of both, and the largest containment."""
    starts = F.transform("places", lambda p: p["first"])
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    held = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return scanned.withColumns(
        {
            "n_base": F.size("places").cast("long"),
            "first_word": F.array_min(starts),
            "last_word": F.array_max(starts),
            "base_labels": joined(labels("places")),
            "labels": joined(F.concat(labels("places"), labels("blocks"))),
            "score": F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(held, F.lit(0.0))),
        }
    )

"""Licence scans with a positional index of rare words.

Templates are licence texts and notices as sequences of words, each with a mandatory key phrase inside. The index holds,
per word, its postings: the templates and positions where it stands. Weights are inverse document frequencies counted
over the whole corpus. Of a file's licence words those of highest weight are looked up first: every template's key phrase
is filed under its rarest word, so a template is met if and only if that word is. A meeting fixes where the template
would start in the file; the postings of its other words, in falling weight, are intersected at that relative position,
and what is left is verified against the whole key phrase. The score is the weighted share of a template's words that
stand at their relative positions.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm.arrow import small, with_columns

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
GAP = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
CHUNK = 1 << 20  # bytes of a text whose words are held at once


@dataclass(frozen=True)
class Template:
    """``words`` with the mandatory ``key`` phrase at word ``at``. A label needs the key and a score of ``least``."""

    label: str
    words: tuple[bytes, ...]
    at: int
    n_key: int
    least: float = 0.0
    base: bool = False


def template(label: str, text: str, key: str | None = None, least: float = 0.0, base: bool = False) -> Template:
    """From plain text; the key is the whole text unless given, and must stand in it."""
    words = tuple(WORD.findall(text.lower().encode()))
    phrase = words if key is None else tuple(WORD.findall(key.lower().encode()))
    at = next(k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase)
    return Template(label, words, at, len(phrase), least, base)


# Phrases, their labels, and openings of well-known licences.
BASE = [
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
]
NOTICES = [
    template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "permission is hereby granted free of charge", 0.5),
    template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify", 0.6),
    template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms", 0.5),
    template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "you may not use this file except in compliance with the license", 0.5),
    template("gpl-2", "gnu general public license version 2"),
    template("gpl-3", "gnu general public license version 3"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl", "gnu affero general public license"),
    template("mpl-2", "mozilla public license version 2"),
    template("mpl-2", "mozilla public license v 2 0"),
    template("epl", "eclipse public license"),
    template("bsd", "bsd 2 clause"),
    template("bsd", "bsd 3 clause"),
    template("boost", "boost software license"),
    template("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software", 0.5),
    template("cc0", "cc0 1 0 universal"),
    template("cc-by", "creative commons attribution 4 0 international"),
    template("cc-by-nc", "creative commons attribution noncommercial"),
    template("cc-by-sa", "creative commons attribution sharealike"),
    template("cc-by-sa", "cc by sa"),
    template("cc-by-nd", "cc by nd"),
]
TEMPLATES = [*BASE, *NOTICES]

FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
]


def chunks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, lists of those of about ``CHUNK`` bytes; A-Z in lower case."""
    data = (text or "").encode().lower()  # of bytes, only A-Z have a lower case
    start = 0
    while start < len(data):
        gap = GAP.search(data, start + CHUNK) if start + CHUNK < len(data) else None
        end = len(data) if gap is None else gap.start()
        yield WORD.findall(data, start, end)
        start = end


def document_frequencies(docs: DataFrame, text: str, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """How many documents there are, and how many of them hold each word of the bounded ``vocabulary``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, dict.fromkeys(vocabulary, 0)
        for batch in small(batches):
            for value in batch.column(0).to_pylist():
                n += 1
                seen: set[bytes] = set()
                for words in chunks(value):
                    seen.update(vocabulary.intersection(words))
                for word in seen:
                    found[word] += 1
        rows = [(None, n), *((w, k) for w, k in found.items() if k)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], type=pa.binary()), pa.array([k for _, k in rows], type=pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in counted.collect()}  # a row per word of the vocabulary at most
    return got.pop(None, 0), got


@dataclass(frozen=True)
class Index:
    """Weights of words, and under each word the templates whose key phrase it is the rarest word of, with its offset from the key's start."""

    templates: list[Template]
    weight: dict[bytes, float]
    filed: dict[bytes, list[tuple[int, int]]]
    # per template: (weight, word, position from the template's start), rarest first, of the key and of all
    key: list[list[tuple[float, bytes, int]]]
    whole: list[list[tuple[float, bytes, int]]]


def build_index(templates: Sequence[Template], n_docs: int, frequency: dict[bytes, int]) -> Index:
    weight = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) + 1e-9 for t in templates for w in t.words}
    filed: dict[bytes, list[tuple[int, int]]] = {}
    keys, wholes = [], []
    for k, t in enumerate(templates):
        whole = sorted(((weight[w], w, p) for p, w in enumerate(t.words)), key=lambda x: (-x[0], x[1], x[2]))
        key = [x for x in whole if t.at <= x[2] < t.at + t.n_key]
        filed.setdefault(key[0][1], []).append((k, key[0][2]))
        keys.append(key)
        wholes.append(whole)
    return Index(list(templates), weight, filed, keys, wholes)


def _stands(places: array | None, place: int) -> bool:
    if places is None:
        return False
    k = bisect_left(places, place)
    return k < len(places) and places[k] == place


def scan_text(text: str | None, index: Index) -> tuple:
    """(n_words, places, labels, score): places are (start of the key phrase, template), all of them, verified."""
    postings: dict[bytes, array] = {}
    n = 0
    for words in chunks(text):
        if not index.weight.keys().isdisjoint(words):
            for k, word in enumerate(words, n):
                if word in index.weight:
                    postings.setdefault(word, array("q")).append(k)
        n += len(words)
    places, labels, score = [], set(), 0.0
    for word in sorted(postings.keys() & index.filed.keys(), key=lambda w: (-index.weight[w], w)):
        for k, offset in index.filed[word]:
            t = index.templates[k]
            # where the template would start; less than zero if only its key is in the text
            starts = [p - offset for p in postings[word] if p - offset + t.at >= 0]
            for _, other, position in index.key[k][1:]:
                if not starts:
                    break
                places_of = postings.get(other)
                starts = [s for s in starts if _stands(places_of, s + position)]
            if not starts:
                continue
            total = sum(w for w, _, _ in index.whole[k])
            share = 1.0 if t.n_key == len(t.words) else max(sum(w for w, o, p in index.whole[k] if _stands(postings.get(o), s + p)) for s in starts) / total
            if t.base or share >= t.least:
                places += [(s + t.at, k) for s in starts]
                labels.add(t.label)
                score = max(score, min(share, 1.0))
    return n, places, labels, score


def scan(docs: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES, frequencies: tuple[int, dict[bytes, int]] | None = None) -> DataFrame:
    """``docs`` with the columns of ``FIELDS``; columns of the same names are replaced, all others stay.

    n_words; n_base, first_word, last_word and base_labels of the base templates' places; labels of all templates;
    score, 0 without a label. Labels are distinct, sorted and joined by commas. Null texts count as empty; texts of any
    length are read whole, with the places of licence words in memory. An empty table gives an empty one.
    ``frequencies`` are those of ``document_frequencies``, counted over ``docs`` unless given.
    """
    vocabulary = {w for t in templates for w in t.words}
    index = build_index(templates, *(frequencies or document_frequencies(docs, text, vocabulary)))

    def make():
        def run(batch: pa.RecordBatch) -> list[list]:
            rows = []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                n, places, labels, score = scan_text(value, index)
                base = [p for p, k in places if index.templates[k].base]
                names = {index.templates[k].label for _, k in places if index.templates[k].base}
                rows.append((n, len(base), min(base, default=None), max(base, default=None), ",".join(sorted(names)), ",".join(sorted(labels)), score))
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in FIELDS]

        return run

    return with_columns(docs, FIELDS, make)


def spans(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, key: str = "doc_id", text: str = "text", frequencies: tuple[int, dict[bytes, int]] | None = None) -> DataFrame:
    """(``key``, label, base, first, last): a row per verified key phrase, its first and last word counted from 0."""
    vocabulary = {w for t in templates for w in t.words}
    index = build_index(templates, *(frequencies or document_frequencies(docs, text, vocabulary)))
    found = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))

    def make():
        def run(batch: pa.RecordBatch) -> list[list]:
            out = []
            for value in batch.column(1).to_pylist():
                _, places, _, _ = scan_text(value, index)
                named = [(p, index.templates[k]) for p, k in sorted(places)]
                out.append([{"label": t.label, "base": t.base, "first": p, "last": p + t.n_key - 1} for p, t in named])
            return [out]

        return run

    each: Column = F.explode("found").alias("f")
    scanned = with_columns(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), [T.StructField("found", found)], make)
    return scanned.select(F.col("key").alias(key), each).select(key, "f.label", "f.base", "f.first", "f.last")

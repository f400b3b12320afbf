"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a stretch of consecutive words; blocks overlap by half, so that every stretch
as long as a template lies whole in some block. Templates of about one length are joined with
blocks of their own. A block meets a template when it contains at least the template's share of its distinct words. The join orders
words by how often they occur in all documents. If a block holds ``need`` of a template's
``t`` words, it must hold one of the template's ``t - need + 1`` rarest (prefix filter); it
must have ``need`` words at all (length filter); and the words left behind the first
common one on either side must still suffice (positional filter). What remains is counted.

Phrases are templates all of whose words must also stand one after the other.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.bytewise import LOWER, PLAIN_WORDS, blocks, text_buffer, word_hashes, word_spans
from duelframe.llm.decontamination import plain_words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: share of the distinct words a block must contain
    share: float = 1.0
    #: all words must stand consecutively
    phrase: bool = False


# Phrases and labels.
PHRASES = (
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
)
# Openings of well-known public license texts.
LICENSES = (
    Template("apache", "licensed under the apache license version 2 0", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", 0.8),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", 0.8),
    Template("mit", "released under the mit license", 0.8),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", 0.8),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.8),
    # Passages from the bodies, for texts without the opening.
    Template(
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        0.8,
    ),
    Template(
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        0.8,
    ),
    Template(
        "gpl",
        "you should have received a copy of the gnu general public license along with this program if not see",
        0.8,
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        0.8,
    ),
    Template(
        "isc",
        "the software is provided as is and the author disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness",
        0.8,
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        0.8,
    ),
    Template(
        "mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        0.8,
    ),
    Template(
        "mit",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        0.8,
    ),
    Template(
        "mpl",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        0.8,
    ),
    Template(
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        0.8,
    ),
)

_PLACES = "array<struct<label: string, start: bigint, words: bigint, share: double, phrase: boolean>>"
_PLACES_ARROW = pa.list_(
    pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("share", pa.float64()), ("phrase", pa.bool_())])
)


def _hash_words(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), PLAIN_WORDS)
    return word_hashes(data, starts, ends)


class WordFinder:
    """Finds the places of a small set of words among many, by hash."""

    def __init__(self, words: list[bytes]):
        hashes = _hash_words(words) if words else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that hold one of the words, and which."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.flatnonzero(self.maybe[hashes >> np.uint64(48)])
        slot = np.minimum(np.searchsorted(self.sorted, hashes[place]), len(self.sorted) - 1)
        same = self.sorted[slot] == hashes[place]
        return place[same], self.order[slot[same]]


def _template_words(templates: tuple[Template, ...]) -> list[bytes]:
    return sorted({word for template in templates for word in plain_words(template.text)})


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[bytes, int]:
    """How often each template word occurs in all documents; as many numbers as template words."""
    words = _template_words(templates)
    finder = WordFinder(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for first, last in blocks(offsets):
                part = LOWER[data[offsets[first] : offsets[last]]]
                starts, ends, _ = word_spans(part, offsets[first : last + 1] - offsets[first], PLAIN_WORDS)
                _, which = finder.places(word_hashes(part, starts, ends))
                total += np.bincount(which, minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(total)], names=["word", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word long, n long")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {row["word"]: row["n"] for row in rows}
    return {word: found.get(i, 0) for i, word in enumerate(words)}


def length_classes(templates: tuple[Template, ...]) -> list[tuple[Template, ...]]:
    """Templates whose numbers of words lie between the same powers of two."""
    classes: dict[int, list[Template]] = defaultdict(list)
    for template in templates:
        classes[(len(plain_words(template.text)) - 1).bit_length()].append(template)
    return [tuple(found) for _, found in sorted(classes.items())]


class TemplateIndex:
    """Prefixes of templates of about one length under the frequency order, and the check of a block."""

    def __init__(self, templates: tuple[Template, ...], frequencies: dict[bytes, int]):
        self.templates = [(template, plain_words(template.text)) for template in templates]
        self.templates = [(template, words) for template, words in self.templates if words]
        self.rank = {word: i for i, word in enumerate(sorted(frequencies, key=lambda w: (frequencies[w], w)))}
        self.ordered = [sorted(set(words), key=self.rank.__getitem__) for _, words in self.templates]
        self.need = [max(1, math.ceil(template.share * len(words) - 1e-9)) for (template, _), words in zip(self.templates, self.ordered)]
        self.longest = max((len(words) for _, words in self.templates), default=1)
        self.step = self.longest
        prefixes: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (words, need) in enumerate(zip(self.ordered, self.need)):
            for i, word in enumerate(words[: len(words) - need + 1]):
                prefixes[word].append((t, i))
        self.keys = sorted(prefixes)
        self.prefixes = [prefixes[word] for word in self.keys]
        self.finder = WordFinder(self.keys)

    def candidates(self, hashes: np.ndarray, firsts: np.ndarray) -> dict[int, dict[int, set[int]]]:
        """Per document the blocks that hold a prefix word, by their first word, and the keys found in them."""
        at, keys = self.finder.places(hashes)
        owners = np.searchsorted(firsts, at, side="right") - 1
        found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for owner, place, key in zip(owners.tolist(), (at - firsts[owners]).tolist(), keys.tolist()):
            block = place // self.step * self.step
            found[owner][block].add(key)
            if block:
                found[owner][block - self.step].add(key)
        return found

    def search(self, words: list[bytes], begins: dict[int, set[int]]) -> list[tuple[str, int, int, float, bool]]:
        """Places in one document; ``begins`` maps a block's first word to the keys found in it."""
        found = set()
        for begin, keys in begins.items():
            block = words[begin : begin + 2 * self.step]
            inside = set(block)
            known = sorted((word for word in inside if word in self.rank), key=self.rank.__getitem__)
            position = {word: i for i, word in enumerate(known)}
            first: dict[int, tuple[int, int]] = {}
            for key in keys:
                if self.keys[key] in inside:
                    for t, i in self.prefixes[key]:
                        here = (i, position[self.keys[key]])
                        first[t] = min(first.get(t, here), here)
            for t, (i, j) in first.items():
                need, ordered = self.need[t], self.ordered[t]
                if len(inside) < need or min(len(ordered) - i, len(known) - j) < need:
                    continue
                common = sum(word in inside for word in ordered)
                if common < need:
                    continue
                template, sequence = self.templates[t]
                if template.phrase:
                    size = len(sequence)
                    for at in range(len(block) - size + 1):
                        if block[at : at + size] == sequence:
                            found.add((template.label, begin + at, size, 1.0, True))
                else:
                    found.add((template.label, begin, len(block), common / len(ordered), False))
        return sorted(found, key=lambda place: (place[1], place[0]))


def scan_licenses(
    docs: DataFrame,
    templates: tuple[Template, ...] = PHRASES + LICENSES,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """``keep`` columns with ``n_words`` and ``places``: label, first word, words, share, phrase.

    A null or blank text has no words and no place. Repeated documents each get their row;
    other columns are not looked at. An empty table gives an empty result.
    """
    frequencies = word_frequencies(docs, templates, text_col)
    shared = docs.sparkSession.sparkContext.broadcast([TemplateIndex(found, frequencies) for found in length_classes(templates)])
    kept = list(dict.fromkeys(keep))
    source = docs.select(*[F.col(name).alias(f"_keep{i}") for i, name in enumerate(kept)], F.col(text_col).cast("string").alias("_text"))
    schema = source.drop("_text").withColumn("n_words", F.lit(0).cast("long")).withColumn("places", F.expr(f"CAST(array() AS {_PLACES})")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            places: list[list] = []
            data, offsets = text_buffer(batch.column("_text"))
            for first, last in blocks(offsets):
                part = LOWER[data[offsets[first] : offsets[last]]]
                starts, ends, firsts = word_spans(part, offsets[first : last + 1] - offsets[first], PLAIN_WORDS)
                counts += np.diff(firsts).tolist()
                hashes, raw = word_hashes(part, starts, ends), part.tobytes()
                found: list[list] = [[] for _ in range(last - first)]
                for index in shared.value:
                    for owner, begins in index.candidates(hashes, firsts).items():
                        low, high = int(firsts[owner]), int(firsts[owner + 1])
                        words = [raw[a:b] for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist())]
                        found[owner] += index.search(words, begins)
                places += [sorted(row, key=lambda place: (place[1], place[0])) for row in found]
            names = ("label", "start", "words", "share", "phrase")
            rows = pa.array([[dict(zip(names, place)) for place in row] for row in places], _PLACES_ARROW)
            fresh = {"n_words": pa.array(counts, pa.int64()), "places": rows}
            yield pa.RecordBatch.from_arrays([fresh[n] if n in fresh else batch.column(n) for n in schema.names], names=schema.names)

    done = source.mapInArrow(scan, schema)
    return done.select(*[F.col(f"_keep{i}").alias(name) for i, name in enumerate(kept)], "n_words", "places")


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: words, phrase places, their labels, all labels, and the best share as ``score``.

    Null and blank texts have no words, no place, empty labels and a score of 0. Every row gives a row,
    also one without an id or with another's; an empty table gives none.
    """
    found = scan_licenses(docs)
    phrases = F.filter("places", lambda place: place["phrase"])
    label = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda place: place["label"]))), ",")
    start = F.transform(phrases, lambda place: place["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(phrases).cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        label(phrases).alias("base_labels"),
        label(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda place: place["share"])), F.lit(0.0)).alias("score"),
    )

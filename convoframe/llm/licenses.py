"""License templates in texts: MinHash bands over overlapping windows, then exact shingle containment.

A template of m shingles is looked for in windows of 2 m shingles that begin every m, so that each place
where it may stand lies whole in one window. A window that holds the share ``contained`` of the template's
shingles has a Jaccard similarity of at least contained / (3 - contained) with it; there are as many bands
of one row as make a miss at that similarity as rare as ``MISS``. A window that shares a band with a
template is a candidate, and is a match when it holds the share exactly. Windows without any shingle of a
template cannot share a band and are not signed.

Words are what white space separates, without signs at their ends, with A-Z read as a-z and the spelling
"licence" as "license"; of an address of Creative Commons the host and three parts count. Templates shorter than the shingle size are one shingle of all their words. Words are
compared by 64-bit hashes.

The table has three sorts of templates for a license. Names of a few words, alone where three words or more or
one with a version name it, and else after "under", "under the" and the like: these match word for word, and the
words around do not matter. Addresses of Creative Commons, single words. Paragraphs of the license's text, where a changed
word or two still leaves the share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import U64, mix, small_batches, split_words
from convoframe.llm.license_texts import PARAGRAPHS

MISS = 1e-8
SHINGLE = 5
CONTAINED = 0.8
# Templates that go to the tasks at once; more are looked for block by block.
TEMPLATES_PER_BLOCK = 2_000

# Names of a license; "L" stands for the word license.
_GNU = {"gpl": ("GNU General Public L", "GNU GPL"), "lgpl": ("GNU Lesser General Public L", "GNU Library General Public L", "GNU LGPL"),
        "agpl": ("GNU Affero General Public L", "GNU AGPL"), "gfdl": ("GNU Free Documentation L", "GNU FDL")}
_GNU_VERSIONS = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("3.0",), "gfdl": ("1.1", "1.2", "1.3")}
_VERSIONED = {
    "apache": ("Apache", ("1.0", "1.1", "2.0")),
    "mpl": ("Mozilla Public", ("1.0", "1.1", "2.0")),
    "epl": ("Eclipse Public", ("1.0", "2.0")),
    "artistic": ("Artistic", ("1.0", "2.0")),
    "bsl": ("Boost Software", ("1.0",)),
    "eupl": ("European Union Public", ("1.1", "1.2")),
    "osl": ("Open Software", ("3.0",)),
}
_PLAIN = {
    "mit": ("MIT L", "MIT/Expat L", "Expat L", "MIT"),
    "isc": ("ISC L", "ISC"),
    "zlib": ("zlib L", "zlib/libpng L", "zlib"),
    "unlicense": ("Unlicense", "The Unlicense"),
    "wtfpl": ("WTFPL", "Do What The Fuck You Want To Public L"),
    "bsd": ("BSD L", "BSD-style L", "BSD"),
    "bsd-2-clause": ("BSD 2-Clause L", "2-Clause BSD L", "Simplified BSD L", "BSD-2-Clause", "two-clause BSD L"),
    "bsd-3-clause": ("BSD 3-Clause L", "3-Clause BSD L", "New BSD L", "Modified BSD L", "BSD-3-Clause", "three-clause BSD L"),
    "0bsd": ("Zero-Clause BSD L", "0BSD"),
    "gpl": ("GPL",),
    "lgpl": ("LGPL", "Lesser General Public L"),
    "agpl": ("AGPL", "Affero General Public L"),
    "apache": ("Apache L",),
    "mpl": ("MPL", "Mozilla Public L"),
    "epl": ("EPL", "Eclipse Public L"),
    "cc0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0", "CC0-1.0"),
}
_CC = {
    "by": "Attribution",
    "by-sa": "Attribution-ShareAlike",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
_FRAMES = ("under", "under a", "under the", "terms of the", "SPDX-License-Identifier:", "license:")

# Grants and headers as they stand in source files.
_GRANTS = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.",),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.",),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    # Few words, so that the share tells the GNU licenses apart.
    "gpl": ("terms of the GNU General Public License as published",),
    "lgpl": ("terms of the GNU Lesser General Public License as published", "terms of the GNU Library General Public License as published"),
    "agpl": ("terms of the GNU Affero General Public License as published",),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def _short(version: str) -> list[str]:
    return [version, version[:-2]] if version.endswith(".0") else [version]


def _names() -> dict[str, set[str]]:
    """Names of each license."""
    out: dict[str, set[str]] = {}
    for license, names in _PLAIN.items():
        out.setdefault(license, set()).update(names)
    for family, names in _GNU.items():
        out.setdefault(family, set()).update(names)
        for version in _GNU_VERSIONS[family]:
            own = out.setdefault(f"{family}-{version}", set())
            own.update(f"{family}-{version}{end}" for end in ("", "-only", "-or-later", "+"))
            for v in _short(version):
                own.update(f"{n} {mark}{v}" for n in (*names, family) for mark in ("version ", "v", "v. ", ""))
                own.update((f"{family}v{v}", f"{family}-{v}", f"{family}v{v}+"))
    for family, (name, versions) in _VERSIONED.items():
        for version in versions:
            own = out.setdefault(f"{family}-{version}", set())
            for v in _short(version):
                own.update(f"{name} L {mark}{v}" for mark in ("version ", "v", "v. ", ""))
                own.update((f"{name} {v}", f"{name} {v} L", f"{family}-{v}", f"{family} {v}", f"{family}v{v}"))
    for kind, name in _CC.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            own = out.setdefault(f"cc-{kind}-{version}", set())
            own.update((f"CC {kind} {version}", f"CC-{kind} {version}", f"CC-{kind}-{version}", f"CC {kind} v{version}"))
            for words in {name, name.replace("-", " "), name.replace("-", " - "), name.replace("NonC", "Non-C")}:
                own.update(f"Creative Commons {words} {mark}{version}" for mark in ("", "L ", "version ", "L version "))
    return out


def table_of_templates() -> dict[str, str]:
    """Text of each template, under the license and, from the second on, a number after ``#``."""
    texts: dict[str, list[str]] = {license: list(own) for license, own in _GRANTS.items()}
    for license, names in _names().items():
        own = texts.setdefault(license, [])
        for name in sorted(" ".join("License" if w == "L" else w for w in n.split()) for n in names):
            words = name.split()
            alone = len(words) > 2 or len(words) == 1 and any(c in "123456789" for c in name)
            own.extend([name] if alone else [f"{frame} {name}" for frame in _FRAMES])
    for kind in _CC:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            texts[f"cc-{kind}-{version}"].append(f"creativecommons.org/licenses/{kind}/{version}")
    texts["cc0-1.0"].append("creativecommons.org/publicdomain/zero/1.0")
    for license, own in PARAGRAPHS.items():
        texts.setdefault(license, []).extend(own)
    out, seen = {}, set()
    for license, own in sorted(texts.items()):
        at = 0
        for text in own:
            words = license, *(w.strip(".,:;()\"") for w in text.lower().split())
            if words not in seen:
                seen.add(words)
                out[f"{license}#{at}" if at else license] = text
                at += 1
    return out


TEMPLATES = table_of_templates()


def bands_for(contained: float, miss: float = MISS) -> int:
    similarity = contained / (3 - contained)
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, hash of each word); words of signs only are left out."""
    import xxhash

    offsets, codes, words = split_words(texts)
    hashes = np.zeros(len(words), dtype=np.uint64)
    for at, word in enumerate(words.to_pylist()):
        low, high = 0, len(word)
        while low < high and not word[low].isalnum():
            low += 1
        while high > low and not word[high - 1].isalnum():
            high -= 1
        if low < high:
            word = word[low:high]
            if word.startswith("licence"):
                word = "license" + word[7:]
            elif "creativecommons.org/" in word:
                # The address of a license without what may stand before and after it.
                word = "/".join(word[word.index("creativecommons.org/") :].split("/")[:4])
            hashes[at] = xxhash.xxh3_64_intdigest(word) or 1
    h = hashes[codes]
    keep = h != 0
    return np.concatenate([[0], np.cumsum(keep)])[offsets], h[keep]


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` words from each position on that has so many after it."""
    n = max(len(h) - size + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(size):
            out = mix(out * U64(0x9E3779B97F4A7C15) + h[at : at + n] + U64(at + 1))
    return out


def _signature(shingles: np.ndarray, bands: int) -> np.ndarray:
    seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
    return mix(shingles[None, :] ^ seeds[:, None]).min(axis=1)


@dataclass
class Template:
    name: str
    words: int
    size: int
    shingles: np.ndarray
    signature: np.ndarray


def prepare(templates: list[tuple[str, str]], shingle: int, bands: int) -> list[Template]:
    """Signed templates; those without words are none."""
    out = []
    for name, text in sorted(templates):
        offsets, h = _word_hashes(pa.array([text], pa.string()))
        size = min(shingle, len(h))
        if size:
            own = np.unique(_shingles(h, size))
            out.append(Template(name, len(h), size, own, _signature(own, bands)))
    return out


def _matcher(templates: list[Template], bands: int, contained: float):
    by_size: dict[tuple[int, int], list[Template]] = {}
    for t in templates:
        by_size.setdefault((t.size, t.words - t.size + 1), []).append(t)
    groups = []
    for (size, m), own in sorted(by_size.items()):
        every = np.unique(np.concatenate([t.shingles for t in own]))
        groups.append((size, m, own, every, np.stack([t.signature for t in own])))

    by_shingle = {size: np.unique(np.concatenate([g[3] for g in groups if g[0] == size])) for size in {g[0] for g in groups}}

    def match(h: np.ndarray) -> list[tuple[str, int, int]]:
        out = []
        found = {}
        for size, every in by_shingle.items():
            shingles = _shingles(h, size)
            found[size] = shingles, np.flatnonzero(np.isin(shingles, every))
        for size, m, own, every, signatures in groups:
            shingles, met = found[size]
            met = met[np.isin(shingles[met], every)]
            if not len(met):
                continue
            windows = np.unique(np.concatenate([met // m, np.maximum(met // m - 1, 0)]))
            best: dict[str, tuple[int, int, int]] = {}
            for w in windows.tolist():
                part = shingles[w * m : w * m + 2 * m]
                shared = (_signature(part, bands)[None, :] == signatures).any(axis=1)
                for k in np.flatnonzero(shared):
                    t = own[k]
                    inside = np.flatnonzero(np.isin(part, t.shingles))
                    held = len(np.unique(part[inside]))
                    if held >= contained * len(t.shingles):
                        first, last = int(w * m + inside[0]), int(w * m + inside[-1] + size)
                        best[t.name] = max(best.get(t.name, (0, 0, 0)), (held, -first, last))
            out.extend((name, -first, last) for name, (_, first, last) in best.items())
        return sorted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One pass over a batch finds the texts that hold any shingle of a template.
        for whole in batches:
            for batch in small_batches([whole], "text"):
                offsets, h = _word_hashes(batch.column(1))
                likely = np.zeros(batch.num_rows, dtype=bool)
                for size, every in by_shingle.items():
                    met = np.flatnonzero(np.isin(_shingles(h, size), every))
                    likely[np.searchsorted(offsets, met, side="right") - 1] = True
                found = [match(h[offsets[r] : offsets[r + 1]]) if likely[r] else [] for r in range(batch.num_rows)]
                kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("after", pa.int64())]))
                rows = [[dict(zip(("license", "first", "after"), m, strict=True)) for m in x] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["key", "matches"])

    return run


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    key: str = "doc_id",
    shingle: int = SHINGLE,
    contained: float = CONTAINED,
    per_block: int = TEMPLATES_PER_BLOCK,
) -> DataFrame:
    """(``key``, matches array<struct<license, first, after>>): the templates that each text holds.

    ``first`` and ``after`` bound the words of the fullest window's shingles. Null and empty texts match
    nothing; rows are scanned one by one, repeated or not. Templates go out in blocks of ``per_block``. Texts may have
    any length: a batch holds 8 MB of them, or one. An empty table gives an empty table. Other columns are not
    looked at, whatever their names.
    """
    bands = bands_for(contained)
    ready = prepare(list((TEMPLATES if templates is None else templates).items()), shingle, bands)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), "text")
    matches = "matches array<struct<license string, first long, after long>>"
    blocks = [ready[i : i + per_block] for i in range(0, len(ready), per_block)] or [[]]
    if len(blocks) == 1:
        found = rows.mapInArrow(_matcher(blocks[0], bands, contained), f"key {kind}, {matches}")
        return found.withColumnRenamed("key", key)
    # Every block of templates goes over the rows by itself; a row's matches then meet by its number.
    numbered = rows.select(F.struct(F.monotonically_increasing_id().alias("n"), "key").alias("key"), "text")
    parts = [numbered.mapInArrow(_matcher(b, bands, contained), f"key struct<n: long, key: {kind}>, {matches}") for b in blocks]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = every.groupBy("key.n").agg(
        F.first("key.key").alias(key), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches")
    )
    return joined.select(key, "matches")

"""License scans (op 7), in DataFrame and SQL functions alone.

Template texts are cut into five-word shingles.  A document's words are read in overlapping windows, for
each template size class 2c words long and c apart, so that every stretch of c words lies whole in one.
A window that holds ``share`` of a template's shingles has a Jaccard similarity of at least ``least``
with it; with min-hashes of one row each, such a window and template agree in some band but for a chance of
(1 - least) ** bands, and each class of sizes has as many bands as bring that to ``miss``.  Windows that agree are verified by exact shingle containment.

A window that matches misses few of a template's shingles, so of one more than these it holds one.  For each
template as many shingles are covered by anchors, pairs of neighbouring words; windows that hold no anchor of their
class can't match and aren't hashed, and texts without the longest word of any anchor keep no words.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices that a text may carry, as their licenses word them.
TEMPLATES = {
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-no-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


@dataclass(frozen=True)
class LicenseParams:
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    shingle: int = 5
    share: float = 0.8
    #: Chance that a window which holds ``share`` of a template isn't retrieved; it settles the number of bands.
    miss: float = 1e-6


def words(text: str) -> list[str]:
    """ASCII letters and digits in lower case."""
    return re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m.group().lower(), text))


def _shingles(own: list[str], size: int) -> list[str]:
    return list(dict.fromkeys(" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1)))) if own else []


def sure_anchors(templates: list[list[str]], share: float) -> list[str]:
    """Word pairs (or words, of one-word shingles) of which every match holds one, pairs of longer words first: greedily those that cover most.

    Of each template fewer than ``share`` of the shingles stay without an anchor.
    """
    left = {i: list(own) for i, own in enumerate(templates)}
    out: list[str] = []
    while needy := [i for i, own in left.items() if own and len(own) >= _need(len(templates[i]), share)]:
        pairs = [{" ".join(w[j : j + 2]) for j in range(max(1, len(w) - 1))} for w in (s.split() for i in needy for s in left[i])]
        out.append(best := max(sorted({p for s in pairs for p in s}), key=lambda p: (min(map(len, p.split())) >= 4, sum(p in s for s in pairs), len(p))))
        left = {i: [s for s in own if f" {best} " not in f" {s} "] for i, own in left.items()}
    return out


def anchors(shingles: list[str]) -> list[str]:
    """Anchors of which every shingle holds one."""
    return sure_anchors([[s] for s in shingles], 1.0)


def _need(n: int, share: float) -> int:
    """Shingles of ``n`` that a match holds at least."""
    return math.ceil(share * n - 1e-9)


def size_class(n: int) -> int:
    c = 8
    while c < n:
        c *= 2
    return c


def bands_of(counts: list[int], window: int, p: LicenseParams) -> int:
    """One-row bands for templates of so many shingles and windows of ``window``: by the least Jaccard similarity of a match."""
    need = [(_need(n, p.share), n) for n in counts]
    least = min(k / (window + n - k) for k, n in need)
    return 1 if least >= 1 else max(1, math.ceil(math.log(p.miss) / math.log(1 - least)))


def _bands(hashes: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.xxhash64(j, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j)))))


def find_licenses(docs: DataFrame, p: LicenseParams = LicenseParams()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and ``matches``, an array of structs (template, containment) by name.

    Containment is the share of the template's shingles in the best window; a match has ``share`` at
    least.  Words are runs of ASCII letters and digits in lower case; a template of fewer than five words
    is one shingle of all its words.  A null text matches nothing; an empty table gives no rows; repeated
    rows give repeated rows; other columns are ignored.  Templates without words are left out.
    """
    size = p.shingle
    split = {name: words(t) for name, t in sorted(p.templates.items()) if words(t)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = "array<struct<template:string,containment:double>>"
    if not split:
        return rows.select("doc_id", F.array().cast(kind).alias("matches"))
    groups: dict[tuple[int, int], list[str]] = {}
    for name, own in split.items():
        groups.setdefault((size_class(len(own)), min(size, len(own))), []).append(name)
    picked = {key: sure_anchors([_shingles(split[n], key[1]) for n in own], p.share) for key, own in groups.items()}
    # Texts without the longest word of an anchor keep no words; lower() leaves ASCII letters where they are.
    longest = sorted({max(a.split(), key=len) for own in picked.values() for a in own})
    rows = rows.withColumn("low", F.lower("text"))
    held = functools.reduce(operator.or_, (F.contains("low", F.lit(x)) for x in longest))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.withColumn("w", F.when(held, F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))).drop("low", "text")
    found = []
    for (c, k), own in groups.items():
        hashes = {n: [F.xxhash64(F.lit(s)) for s in _shingles(split[n], k)] for n in own}
        bands = bands_of([len(x) for x in hashes.values()], 2 * c - k + 1, p)
        templates = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*hashes[n]).alias("own"), _bands(F.array(*hashes[n]), bands).alias("bands")) for n in own])
        names = ", ".join(repr(a) for a in picked[c, k])
        rows = rows.withColumn("at", F.expr(f"filter(transform(w, (x, i) -> case when concat_ws(' ', x, get(w, i + 1)) in ({names}) or x in ({names}) then i end), i -> i is not null)"))
        rows = rows.withColumn("numbers", F.expr(f"array_distinct(flatten(transform(at, i -> filter(array(cast(i div {c} as int) - 1, cast(i div {c} as int)), b -> b >= 0))))"))
        rows = rows.withColumn("windows", F.expr(f"filter(transform(numbers, b -> transform(sequence(0, greatest(0, least({2 * c}, size(w) - b * {c}) - {k})), i -> xxhash64(array_join(slice(w, b * {c} + i + 1, {k}), ' ')))), x -> size(x) > 0)"))
        rows = rows.withColumn("signed", F.transform("windows", lambda x: F.struct(x.alias("own"), _bands(x, bands).alias("bands"))))
        rows = rows.withColumn(f"t_{c}_{k}", F.when(F.size("at") > 0, templates))

        def near(t: Column) -> Column:
            return F.transform(F.filter("signed", lambda x: F.arrays_overlap(x["bands"], t["bands"])), lambda x: F.size(F.array_intersect(t["own"], x["own"])) / F.size(t["own"]))

        rows = rows.withColumn(f"m_{c}_{k}", F.transform(f"t_{c}_{k}", lambda t: F.struct(t["name"].alias("template"), F.array_max(near(t)).alias("containment"))))
        found.append(F.coalesce(f"m_{c}_{k}", F.array().cast(kind)))
        rows = rows.drop("at", "numbers", "windows", "signed", f"t_{c}_{k}")
    return rows.select("doc_id", F.sort_array(F.filter(F.concat(*found), lambda m: m["containment"] >= p.share)).alias("matches"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.transform("matches", lambda m: m["template"]), ",").alias("licenses"))

"""Licence scan with DataFrame functions only: lines, paragraphs and windows of words against licence templates.

Texts are normalised to lower-case words.  A template and a unit are compared by the Dice coefficient of
their sets of word bigrams (64-bit hashes), 2 * common / (a + b).  A coefficient of ``THRESHOLD`` or more bounds the size of
one set by that of the other, so a row is only compared with the templates of which it has enough bigrams, and a
unit only if the number of its distinct bigrams can reach the threshold.

Units are whole lines and paragraphs.  Where none of them matches a licence, windows of words do, wherever they begin and end:
a licence inside a longer line, across the lines of a comment, or in mid-sentence.  A window is no better for a bigram at its
end that the template lacks or that the window has elsewhere, too; so windows begin at a bigram of the template and end before
it comes again, and all such windows are compared.  ``n_units`` then counts disjoint windows.

Defined cases: a null or empty text matches nothing; a text or unit of one word has its word for a bigram; repeated
rows are reported one by one; each licence found has a row; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.decontaminate import words

THRESHOLD = 0.8
#: Usual notices by SPDX licence id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)


def _template_rows(spark: SparkSession, templates, threshold: float) -> list[tuple[str, list[int], int, int]]:
    """(license_id, hashes of its distinct bigrams, least and most bigrams of a set that can reach the threshold with it) per template."""
    rows = spark.createDataFrame([(a, t) for a, t in templates], "license_id string, text string")
    n = F.size("h")
    # rounding of the quotients doesn't move a bound
    low, high = F.ceil(n * threshold / (2 - threshold) - 1e-9).cast("int"), F.floor(n * (2 - threshold) / threshold + 1e-9).cast("int")
    return [tuple(r) for r in rows.select("license_id", F.array_distinct(_hashes(words(F.col("text")))).alias("h")).where("size(h) > 0").select("license_id", "h", low, high).collect()]


def _once(value, name: str):
    """``value`` as a column that Catalyst doesn't write out again wherever it is used."""
    return F.explode_outer(F.array(value)).alias(name)


def _hashes(w):
    """The hash of the bigram at each position; a text of one word has its word for a bigram."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))))
    return F.when(F.size(w) > 1, many).otherwise(F.transform(w, lambda x: F.xxhash64(x)))


def _from_start(p, x, high, size, threshold: float):
    """(stop, start, best) of the windows of ``p`` that begin at its element x: the nearest end that reaches the threshold, or -1, and the best coefficient."""
    rest = x["comes"] - x["i"]
    # a slice of more bigrams than the size allows holds every window from here; else the text repeats itself, and all of it is read
    short = F.slice(p, x["i"] + 1, F.least(rest, 2 * high))
    full = F.size(F.array_distinct(F.transform(short, lambda y: y["h"]))) > high
    reach = F.when(full, short).otherwise(F.slice(p, x["i"] + 1, rest))

    def step(a, y):
        new = y["was"] < x["i"]
        d, c = a["d"] + new.cast("int"), a["c"] + (new & y["own"]).cast("int")
        dice = 2 * c / (d + size)
        return F.struct(d.alias("d"), c.alias("c"), F.greatest(a["best"], dice).alias("best"), F.when((a["stop"] < 0) & (dice >= threshold), y["i"]).otherwise(a["stop"]).alias("stop"))

    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("c"), F.lit(0.0).alias("best"), F.lit(-1).alias("stop"))
    return F.aggregate(reach, zero, step, lambda a: F.struct(a["stop"].alias("stop"), x["i"].alias("start"), a["best"].alias("best")))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license_id, n_units, dice: a row per document row and licence found, with the best coefficient."""
    known = _template_rows(docs.sparkSession, templates, threshold)
    each = F.array(*(F.struct(F.lit(a).alias("license_id"), F.array(*map(F.lit, h)).alias("h"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for a, h, lo, hi in known))
    table = each.cast("array<struct<license_id:string,h:array<bigint>,low:int,high:int>>")
    vocabulary = F.array(*map(F.lit, sorted({x for r in known for x in r[1]}))).cast("array<bigint>")

    # row by row, and most rows end here: no text is shuffled
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("__row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    split = base.select("*", _once(words(F.col("text")), "w"))
    met = split.select("doc_id", "__row", "text", _once(F.array_intersect(_hashes(F.col("w")), vocabulary), "met")).where(F.size("met") >= min((r[2] for r in known), default=1))
    some = met.select("doc_id", "__row", "text", _once(F.filter(table, lambda t: F.size(F.array_intersect("met", t["h"])) >= t["low"]), "some")).where("size(some) > 0")

    lines = F.split("text", "\n")
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), lambda p: p.contains("\n"))
    units = some.select("doc_id", "__row", "text", "some", _once(F.concat(lines, paragraphs), "units"))
    unit_words = units.select("doc_id", "__row", "text", "some", _once(F.transform("units", words), "units"))
    sets = unit_words.select("doc_id", "__row", "some", _once(F.transform("units", lambda w: F.array_distinct(_hashes(w))), "sets"), "text")
    hashed = sets.select("doc_id", "__row", "some", "sets", _once(words(F.col("text")), "w")).select("doc_id", "__row", "some", "sets", _once(_hashes(F.col("w")), "h"))

    # by bigram, then position, neighbours tell where a bigram was before and where it comes again
    by_bigram = hashed.select("doc_id", "__row", "some", "sets", F.size("h").alias("n"), _once(F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))), "s"))

    def place(x, j):
        was, comes = F.when(j > 0, F.get("s", j - 1)), F.get("s", j + 1)
        return F.struct(x["i"].alias("i"), F.when(was["h"] == x["h"], was["i"]).otherwise(-1).alias("was"), F.when(comes["h"] == x["h"], comes["i"]).otherwise(F.col("n")).alias("comes"), x["h"].alias("h"))

    placed = by_bigram.select("doc_id", "__row", "some", "sets", _once(F.array_sort(F.transform("s", place)), "p"))
    one = placed.select("doc_id", "__row", "sets", "p", F.explode("some").alias("t")).select("doc_id", "__row", "t.license_id", "t.low", "t.high", "t.h", F.size("t.h").alias("size"), "sets", "p")
    unit_dice = F.transform(F.filter("sets", lambda x: F.size(x).between(F.col("low"), F.col("high"))), lambda x: 2 * F.size(F.array_intersect(x, "h")) / (F.size(x) + F.col("size")))
    own = F.transform("p", lambda x: F.struct(x["i"].alias("i"), x["was"].alias("was"), x["comes"].alias("comes"), F.array_contains("h", x["h"]).alias("own"), x["h"].alias("h")))
    one = one.select("doc_id", "__row", "license_id", "high", "size", F.filter(unit_dice, lambda x: x >= threshold).alias("units"), _once(own, "p"))
    windows = F.filter(F.transform(F.filter("p", lambda x: x["own"]), lambda x: _from_start(F.col("p"), x, F.col("high"), F.col("size"), threshold)), lambda x: x["stop"] >= 0)
    hit = one.select("doc_id", "__row", "license_id", "units", _once(windows, "windows")).where("size(windows) > 0 or size(units) > 0")

    best = hit.groupBy("__row", "doc_id", "license_id").agg(F.flatten(F.collect_list("units")).alias("units"), F.array_sort(F.flatten(F.collect_list("windows"))).alias("windows"))
    # by their ends, each window that begins behind the last one taken
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("stop"))
    apart = F.aggregate("windows", none, lambda a, x: F.when(x["start"] > a["stop"], F.struct((a["n"] + 1).alias("n"), x["stop"].alias("stop"))).otherwise(a), lambda a: a["n"])
    whole = F.size("units") > 0
    dice = F.when(whole, F.array_max("units")).otherwise(F.array_max(F.transform("windows", lambda x: x["best"])))
    return best.select("doc_id", "license_id", F.when(whole, F.size("units").cast("long")).otherwise(apart).alias("n_units"), F.round(dice, 6).alias("dice"))

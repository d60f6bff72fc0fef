"""Licence scan: a trained paragraph classifier with template comparison, in DataFrame functions only.

A sparse multinomial logistic regression over word 1- and 2-grams tells licence families, licence-like text of no
known family (``unknown``) and ordinary text apart. It is trained on variants of public licence notices (words dropped at
random) and on a bounded sample of the corpus's paragraphs as ordinary text; its probabilities are calibrated by a
temperature on held-out variants. A predicted family is confirmed by the overlap of the paragraph's 2-grams with
the family's notices and by the words and version that tell the family from others, else the paragraph is reported as unknown.

Few n-grams have weights. A paragraph without the rare words of those n-grams scores as ordinary text whatever else it
holds, so only paragraphs with such a word are scored; that changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

# Short public notices by family. BSD stands for the clause that its versions share.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "Licensed under the GNU GPL v3.",
    ),
    "GPL-2.0": (
        "Released under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under the GNU GPL v2.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Licensed under the GNU LGPL v2.1.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "Licensed under the GNU LGPL v3.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Licensed under the GNU AGPL v3.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "CC0-1.0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
    ),
}


def _all_of(*parts: str, none_of: str = "") -> str:
    return "^" + (f"(?!.*(?:{none_of}))" if none_of else "") + "".join(f"(?=.*(?:{p}))" for p in parts)


def _version(short: str, number: str) -> str:
    return rf"\b(?:version|v|licen[cs]e|{short})[ -]?v?{number}(?![0-9]|\.[0-9])"


def _commons(*kinds: str) -> str:
    told = {"nc": r"\bnc\b|non-? ?commercial", "sa": r"\bsa\b|share-? ?alike", "nd": r"\bnd\b|no-? ?deriv"}
    return _all_of(r"creative commons|\bcc\b", r"attribution|\bby\b", r"(?<![0-9.])4\.0(?![0-9.])", *(told[k] for k in kinds), none_of="|".join(v for k, v in told.items() if k not in kinds))


# What a paragraph's words, joined by blanks, must hold to be named so: the telling words and version of each family.
TELLING = {
    "MIT": r"\bmit\b|permission is hereby granted free of charge",
    "Apache-2.0": _all_of(r"\bapache\b", _version("apache", r"2(?:\.0)?")),
    "GPL-3.0": _all_of(r"general public licen[cs]e|\bgpl", _version("gpl", r"3(?:\.0)?"), none_of="lesser|library general|affero|lgpl|agpl"),
    "GPL-2.0": _all_of(r"general public licen[cs]e|\bgpl", _version("gpl", r"2(?:\.0)?"), none_of="lesser|library general|affero|lgpl|agpl"),
    "LGPL-2.1": _all_of(r"lesser general public licen[cs]e|\blgpl", _version("lgpl", r"2\.1")),
    "LGPL-3.0": _all_of(r"lesser general public licen[cs]e|\blgpl", _version("lgpl", r"3(?:\.0)?")),
    "AGPL-3.0": _all_of(r"affero general public licen[cs]e|\bagpl", _version("agpl", r"3(?:\.0)?")),
    "CC-BY-NC-4.0": _commons("nc"),
    "CC-BY-4.0": _commons(),
    "CC-BY-SA-4.0": _commons("sa"),
    "CC-BY-ND-4.0": _commons("nd"),
    "CC-BY-NC-SA-4.0": _commons("nc", "sa"),
    "CC-BY-NC-ND-4.0": _commons("nc", "nd"),
    "CC0-1.0": _all_of(r"\bcc0\b", r"1\.0"),
    "BSD-3-Clause": _all_of(r"\bbsd\b", r"\b(?:3|three)[ -]clause"),
    "BSD-2-Clause": _all_of(r"\bbsd\b", r"\b(?:2|two)[ -]clause"),
    "BSD": r"redistribution and use in source and binary forms",
    "MPL-2.0": _all_of(r"mozilla public licen[cs]e|\bmpl\b", _version("mpl", r"2\.0")),
    "EPL-2.0": _all_of(r"eclipse public licen[cs]e|\bepl\b", _version("epl", r"2\.0")),
    "ISC": r"\bisc\b|with or without fee is hereby granted",
    "all-rights-reserved": r"all rights reserved",
}
#: Licence-like sentences of no family; ``?`` stands for words of ordinary text.
OPEN_NOTICES = (
    "Licensed under the ? License.",
    "Released under the ? License, version ?.",
    "This work is licensed under the ? license.",
    "Distributed under the terms of the ? licence.",
    "Use is permitted under the terms of the ? agreement.",
    "Copyright ? by ?.",
)
NONE, UNKNOWN = "none", "unknown"
VARIANTS = 24
HELD_OUT = 6
#: Documents whose paragraphs serve as ordinary text in training: those with the smallest hash of their id.
SAMPLE_DOCS = 400
SAMPLE_PARAGRAPHS = 4_000
COMMON_SHARE = 0.01
#: Words of ordinary text that stand for ``?`` in the open notices.
FILLER_WORDS = 1_000
TEMPERATURES = (0.5, 0.7, 1.0, 1.5, 2.0, 3.0)
MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"), F.lit(0))


def bigrams(w: Column) -> Column:
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def grams(w: Column) -> Column:
    return F.array_distinct(F.concat(w, bigrams(w)))


def softmax_sum(z: Column, top: Column, temperature: float) -> Column:
    """Sum of a softmax whose largest term is one: the reciprocal is the probability of the best class."""
    return F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp((x - top) / temperature))


@dataclass
class LicenseModel:
    """Weights by n-gram (one per class), biases, temperature and the words without which a paragraph is ordinary text."""

    classes: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    temperature: float
    screen: list[str]

    def _array(self, values) -> Column:
        return F.array(*(F.lit(float(v)) for v in values))

    def logits(self, gram_list: Column) -> Column:
        """Sum of the weights of the n-grams, each counted once. Only those that have weights are looked up and added: few of a text's do."""
        start = self._array(self.bias)
        if not self.weights:
            return start
        table = F.map_from_arrays(F.array(*(F.lit(g) for g in self.weights)), F.array(*(self._array(v) for v in self.weights.values())))
        weighted = F.array_intersect(gram_list, F.array(*(F.lit(g) for g in self.weights)))  # a hash look-up each, in the order of the text
        return F.aggregate(weighted, start, lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda x, y: x + y))

    def pattern(self) -> str:
        """Regular expression of the screening words, for lower-case text."""
        return r"(?<![a-z0-9])(?:" + "|".join(w.replace(".", r"\.") for w in sorted(self.screen)) + r")(?![a-z0-9])"


def notices(spark: SparkSession) -> DataFrame:
    rows = [(f, k, t) for f, texts in NOTICES.items() for k, t in enumerate(texts)] + [(UNKNOWN, k, t) for k, t in enumerate(OPEN_NOTICES)]
    values = ", ".join("('{}', {}, '{}')".format(f, k, t.replace("'", "''")) for f, k, t in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(family, notice, text)")


def training_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(family, grams, held_out)``: notice variants, and sampled paragraphs without three words in common with a notice."""
    spark = df.sparkSession
    base = notices(spark)
    ids = df.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    sample = (df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")  # SAMPLE_DOCS rows
              .select("_id", F.posexplode(F.split("_text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
              .orderBy(F.xxhash64("_id", "pos"), "line").limit(SAMPLE_PARAGRAPHS).select(words(F.col("line")).alias("w")))
    sample = stored(sample, "ordinary")
    threes = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))
    known = base.select(words(F.col("text")).alias("w")).where(F.size("w") >= 3).select(F.explode(threes).alias("g")).distinct()
    marked = sample.withColumn("row", F.monotonically_increasing_id())
    like = marked.where(F.size("w") >= 3).select("row", F.explode(threes).alias("g")).join(known, "g").select("row").distinct()
    plain = marked.join(like, "row", "left_anti").select(F.lit(NONE).alias("family"), grams(F.col("w")).alias("grams"), (F.pmod(F.xxhash64("w"), F.lit(4)) == 0).alias("held_out"))
    filler = sorted(r.x for r in sample.select(F.explode("w").alias("x")).distinct().orderBy(F.xxhash64("x"), "x").limit(FILLER_WORDS).collect())
    variants = base.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    fill = F.array(*(F.lit(x) for x in filler)).cast("array<string>")
    spoken = F.regexp_replace("text", r"\?", "zzfill")
    pick = lambda i: F.get(fill, F.pmod(F.xxhash64("family", "notice", "variant", i), F.lit(max(1, len(filler)))).cast("int"))
    filled = F.transform(words(spoken), lambda x, i: F.when((x == "zzfill") & F.lit(bool(filler)), pick(i)).otherwise(x))
    dropped = F.filter("filled", lambda x, i: (F.col("variant") == 0) | (F.pmod(F.xxhash64("family", "notice", "variant", i, F.lit("drop")), F.lit(10)) > 0))
    noisy = variants.withColumn("filled", filled).select("family", grams(dropped).alias("grams"), (F.col("variant") >= VARIANTS - HELD_OUT).alias("held_out"))
    return plain.unionByName(noisy).where(F.size("grams") > 0)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Train on the notices and a bounded sample of ``df`` (``SAMPLE_DOCS`` documents, ``SAMPLE_PARAGRAPHS`` paragraphs)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    rows = stored(training_rows(df, id_col, text_col), "licence_rows").withColumn("row", F.monotonically_increasing_id())
    classes = [NONE, UNKNOWN, *NOTICES]
    plain = rows.where(F.col("family") == NONE)
    n = max(1, plain.count())
    usual = plain.select(F.explode("grams").alias("g")).groupBy("g").count()
    common = usual.where(F.col("count") > COMMON_SHARE * n).select("g")
    said = rows.where(F.col("family") != NONE).select(F.explode("grams").alias("g")).groupBy("g").count().where("count > 1").select("g")
    useful = stored(said.join(common, "g", "left_anti"), "licence_grams")  # n-grams of notices that ordinary text hardly has
    label = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("family")).cast("double") - 1
    held = rows.select("row", F.explode("grams").alias("g")).join(useful, "g").groupBy("row").agg(F.sort_array(F.collect_set("g")).alias("used"))
    ready = stored(rows.join(held, "row", "left").select(label.alias("label"), F.coalesce("used", F.array().cast("array<string>")).alias("used"), "held_out",
                                                         (F.col("family") == NONE).alias("plain"), "row"), "licence_ready")
    train = ready.where("not held_out").orderBy("row").coalesce(1)  # a few thousand rows, whatever the corpus
    vectors = CountVectorizer(inputCol="used", outputCol="x", vocabSize=8192, binary=True).fit(train)
    model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=2e-4, elasticNetParam=1.0, maxIter=80).fit(vectors.transform(train).select("x", "label"))
    matrix, bias = model.coefficientMatrix.toArray(), [float(v) for v in model.interceptVector.toArray()]
    k = len(bias)
    weights = {g: [float(matrix[c, i]) for c in range(k)] for i, g in enumerate(vectors.vocabulary) if any(abs(matrix[c, i]) > 1e-6 for c in range(k))}
    bias += [min(bias) - 20.0] * (len(classes) - k)
    weights = {g: v + [0.0] * (len(classes) - k) for g, v in weights.items()}
    count = {r.g: r["count"] for r in usual.join(useful.select(F.explode(F.split("g", " ")).alias("g")).distinct(), "g").collect()}  # words of notices
    screen = sorted({min(g.split(" "), key=lambda w: (count.get(w, 0), w)) for g in weights})
    out = LicenseModel(classes, bias, weights, 1.0, screen)
    tested = ready.where("held_out").select("label", out.logits(F.col("used")).alias("z")).withColumn("top", F.array_max("z"))
    own = F.element_at("z", (F.col("label") + 1).cast("int"))
    losses = tested.agg(*(F.sum(F.log(softmax_sum(F.col("z"), F.col("top"), t)) - (own - F.col("top")) / t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    if all(x is not None for x in losses):
        out.temperature = min(zip(losses, TEMPERATURES))[1]
    return out


def scan(df: DataFrame, model: LicenseModel, text_col: str = "text", out_col: str = "licences") -> DataFrame:
    """Add ``out_col``: array of ``(paragraph, family, probability, overlap)`` for the licence paragraphs (lines) of each text.

    ``family`` is the predicted family where the probability is at least 0.5 and half the 2-grams of the shorter of paragraph
    and notice agree and the family's telling words and version are there, else ``unknown``; ``overlap`` is that share. Ordinary paragraphs are not listed. Null and empty
    texts have an empty array; rows are independent of each other; a column of that name is replaced.
    """
    text = F.col(f"`{text_col}`")
    base = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != out_col.lower()))
    kind = "array<struct<paragraph:int,family:string,probability:double,overlap:double>>"
    if not model.weights:
        return base.withColumn(out_col, F.array().cast(kind))
    shown = F.array(*(F.struct(F.lit(f).alias("family"), F.array(*(F.lit(g) for g in sorted(set(_pairs(t))))).alias("grams")) for f, texts in NOTICES.items() for t in texts))
    pattern, classes = F.lit(model.pattern()), F.array(*(F.lit(c) for c in model.classes))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.cast("int").alias("paragraph"), F.lower(x).alias("line"))), lambda p: F.rlike(p["line"], pattern))
    split = F.transform(lines, lambda p: F.struct(p["paragraph"].alias("paragraph"), words(p["line"]).alias("w")))
    paired = F.transform(split, lambda p: F.struct(p["paragraph"].alias("paragraph"), p["w"].alias("w"), bigrams(p["w"]).alias("pairs")))
    scored = F.transform(paired, lambda p: F.struct(p["paragraph"].alias("paragraph"), p["w"].alias("w"), p["pairs"].alias("pairs"), model.logits(F.concat(p["w"], p["pairs"])).alias("z")))
    topped = F.transform(scored, lambda p: F.struct(p["paragraph"].alias("paragraph"), p["w"].alias("w"), p["pairs"].alias("pairs"), p["z"].alias("z"), F.array_max(p["z"]).alias("top")))
    best = F.transform(topped, lambda p: F.struct(p["paragraph"].alias("paragraph"), p["w"].alias("w"), p["pairs"].alias("pairs"), (1 / softmax_sum(p["z"], p["top"], model.temperature)).alias("probability"),
                                                  F.element_at(classes, F.array_position(p["z"], p["top"]).cast("int")).alias("family")))
    found = F.filter(best, lambda p: p["family"] != NONE)

    def overlap(p):
        shares = F.transform(F.filter(shown, lambda s: s["family"] == p["family"]),
                             lambda s: F.size(F.array_intersect(p["pairs"], s["grams"])) / F.greatest(F.least(F.size(p["pairs"]), F.size(s["grams"])), F.lit(1)))
        return F.coalesce(F.array_max(shares), F.lit(0.0))

    def telling(p):
        holds = F.lit(False)
        for f, told in TELLING.items():
            holds = F.when(p["family"] == f, F.rlike(F.array_join(p["w"], " "), F.lit(told))).otherwise(holds)
        return holds

    compared = F.transform(found, lambda p: F.struct(p["paragraph"].alias("paragraph"), p["family"].alias("family"), p["probability"].alias("probability"), overlap(p).alias("overlap"), telling(p).alias("telling")))
    told = F.transform(compared, lambda p: F.struct(p["paragraph"].alias("paragraph"),
                                                    F.when((p["probability"] >= MIN_PROBABILITY) & (p["overlap"] >= MIN_OVERLAP) & p["telling"], p["family"]).otherwise(F.lit(UNKNOWN)).alias("family"),
                                                    p["probability"].alias("probability"), p["overlap"].alias("overlap")))
    return base.withColumn(out_col, F.when(F.rlike(F.lower(text), pattern), told).otherwise(F.array().cast(kind)))


def _pairs(text: str) -> list[str]:
    import re

    w = re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", text.lower())
    return [f"{a} {b}" for a, b in zip(w, w[1:])] or w

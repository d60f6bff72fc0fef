"""Quality model, licence scan and pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from bidscope.llm import best_fit_packing as B
from bidscope.llm import license_scan as LS
from bidscope.llm import quality_gam as G
from bidscope.llm import queries as Q
from bidscope.llm.common import table
from conftest import SF01, SF001
from llm.conftest import components_of
from llm.test_dedup import plain_lines, plain_simhash, plain_substrings
from llm.test_tokens import check_packing


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    ones = y == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_gam_learns_main_effects_and_a_pair():
    g = np.random.default_rng(0)
    x = g.random((6000, len(G.FEATURES)))
    y = (((x[:, 2] > 0.7) | ((x[:, 5] > 0.5) != (x[:, 6] > 0.5))) ^ (g.random(6000) < 0.03)).astype(float)
    model = G.fit(x[:4000], y[:4000])
    assert (5, 6) in [(a, b) for a, b, _ in model.pairs] and auc(y[4000:], model.score(x[4000:])) > 0.95


def test_gam_without_both_labels_is_constant():
    model = G.fit(np.zeros((0, len(G.FEATURES))), np.zeros(0))
    assert model.score(np.ones((2, len(G.FEATURES)))).tolist() == [0.5, 0.5]


def test_features_of_edges():
    assert G.features(None) == G.features("") == G.features(" \n") == [0.0] * len(G.FEATURES)
    assert np.isfinite(G.features("x" * 10000)).all() and np.isfinite(G.features("\ud800 \x00")).all()


def test_op6_held_out(spark):
    rows = Q.QUERIES["op6_quality_classifier"](spark, SF01).collect()
    known = {r.doc_id: r.quality for r in table(spark, SF01, "labels").collect()}
    assert len(rows) == table(spark, SF01, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    test = [(known[r.doc_id], r.score) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert auc(np.array([y for y, _ in test]), np.array([s for _, s in test])) > 0.9


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted((r.doc_id, r.score) for r in G.score_quality(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_training_rows_are_bounded_where_ids_repeat(spark):
    docs = spark.range(300).selectExpr("id % 3 AS doc_id", "concat('some words of text ', id) AS text")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, quality int")
    x, y = G.training_rows(docs, labels, "quality", folds=1000, max_rows=5)
    assert len(x) == len(y) == 5


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, None), (6, 7), (7, 1), (None, 1)], "doc_id long, quality int")
    assert len(G.score_quality(edge_docs, labels).collect()) == edge_docs.count()
    assert G.score_quality(no_docs, labels).count() == 0
    assert {r.score for r in G.score_quality(edge_docs, labels.limit(0)).collect()} == {0.5}


def test_licence_scan(spark, edge_docs, no_docs):
    docs = table(spark, SF01, "documents").select("doc_id", "text")
    model = LS.fit(docs)
    lines = {re.sub(r"\s+", " ", t): f for f, texts in LS.NOTICES.items() for t in texts}
    hits = 0
    for r in LS.scan(docs, model).collect():
        want = {lines[x.strip()] for x in r.text.split("\n") if x.strip() in lines}
        assert want == {x.family for x in r.licences if x.family != LS.UNKNOWN}, r.doc_id
        hits += len(want)
    assert hits > 20
    cases = [(k, t.upper(), f) for k, (f, texts) in enumerate(LS.NOTICES.items()) for t in texts]
    got = LS.scan(spark.createDataFrame(cases, "doc_id long, text string, family string"), model).collect()
    assert all([x.family for x in r.licences] == [r.family] for r in got)
    open_case = spark.createDataFrame([("Licensed under the Zanzibar License.",), ("The cat sat on the mat.",), (None,), ("",)], "text string")
    assert [[x.family for x in r.licences] for r in LS.scan(open_case, model).collect()] == [[LS.UNKNOWN], [], [], []]
    edge = LS.scan(edge_docs, model).collect()
    assert len(edge) == edge_docs.count() and [x.family for r in edge if r.doc_id == 13 for x in r.licences] == ["Apache-2.0"]
    assert LS.scan(no_docs, model).count() == 0


def test_licences_not_in_the_training_notices(spark):
    """Telling words and versions decide: another version or kind of a known notice is never named as the known one."""
    known = {
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "Released under the GNU General Public License, version 3.": "GPL-3.0",
        "Released under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "Released under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "Licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "Distributed under the BSD 2-Clause License.": "BSD-2-Clause",
    }
    other = ["This work is licensed under the GNU General Public License, version 1.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC 3.0.",
             "This work is licensed under a Creative Commons Attribution 2.0 Generic License.", "Released under the BSD 4-Clause License.",
             "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."]
    assert not (set(known) | set(other)) & {t for texts in LS.NOTICES.values() for t in texts} and set(LS.TELLING) == set(LS.NOTICES)
    model = LS.fit(table(spark, SF001, "documents").select("doc_id", "text"))
    rows = LS.scan(spark.createDataFrame([(t,) for t in [*known, *other]], "text string"), model).collect()
    got = {r.text: [x.family for x in r.licences] for r in rows}
    assert {t: got[t] for t in known} == {t: [f] for t, f in known.items()}
    assert {t: got[t] for t in other} == {t: [LS.UNKNOWN] for t in other}


def test_licence_screen_changes_no_result(spark):
    """Paragraphs without a screening word score as ordinary text under the full model."""
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    model = LS.fit(docs)
    lines = docs.selectExpr("explode(split(lower(text), '\n')) AS line")
    from pyspark.sql import functions as F

    rest = lines.where(~F.rlike("line", F.lit(model.pattern()))).select(model.logits(LS.grams(LS.words(F.col("line")))).alias("z"))
    assert rest.where(F.array_position("z", F.array_max("z")) != 1).count() == 0


def test_licence_logits_add_weighted_n_grams_once(spark):
    """An n-gram counts once however often it is said, and n-grams without weights are not added up as rows of zeros."""
    model = LS.LicenseModel(["none", "a"], [0.5, -0.5], {"x": [0.0, 2.0], "x y": [1.0, 0.25]}, 1.0, ["x"])
    z = spark.createDataFrame([(["q", "x", "r", "x", "x y", "q"],), (["q"],), ([],)], "g array<string>").select(model.logits(F.col("g")).alias("z"))
    assert [r.z for r in z.collect()] == [[1.5, 1.75], [0.5, -0.5], [0.5, -0.5]]
    assert "array_intersect" in z._jdf.queryExecution().executedPlan().toString()


def test_licence_scan_runs_no_python_code(spark):
    plan = Q.QUERIES["op4_license_scan"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_by_brute_force(spark):
    docs = [r.asDict() for r in table(spark, SF001, "documents").collect()]
    frame = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in docs], table(spark, SF001, "documents").schema)
    model = G.fit_quality(frame, table(spark, SF001, "labels"))
    scores = model.score(np.array([G.features(d["text"]) for d in docs]))
    rows = [(d["doc_id"], d["source"], d["text"]) for d, s in zip(docs, scores) if s >= 0.3]
    rows = [(i, t) for (i, _, _), (_, _, t) in zip(rows, plain_lines([(s, t) for _, s, t in rows], 0.08, 5))]
    prints = {i: plain_simhash(t, 4) for i, t in rows}
    group = components_of(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    rows = [(i, t) for i, t in rows if group[i] == i]
    kept = {i: v for (i, _), v in plain_substrings(rows, 13).items()}
    stage = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], table(spark, SF001, "documents").schema)
    texts = {r.doc_id: r.text for r in C.substring_deduplication(spark, stage, SF001).collect()}
    assert {i: hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t)).encode()).hexdigest() for i, t in texts.items()} == {i: hashlib.sha256(v[2].encode()).hexdigest() for i, v in kept.items()}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    got = C.run(spark, SF001).collect()
    assert {r.doc_id for r in got} == set(ids)
    assert check_packing(got, ids, 2048) == B.lower_bound(dict(Counter(r.length for r in got)), 2048)


def test_stages_keep_the_columns_and_take_edges(spark, edge_docs):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = edge_docs.select(names)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == names and out.dtypes == docs.dtypes, name
        docs = out
    ids = [r.doc_id for r in docs.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    assert C.STAGES[-1][1](spark, docs, SF001).count() >= len(ids)

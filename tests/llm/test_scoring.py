"""Quality, toxicity, licences, chat, urls, mixing and top-k: held-out accuracy, SQL, brute force."""

import math
import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from oracle import same
from veriloom.llm import chat, licences, mixing, quality, topk, toxicity, url_filter
from veriloom.llm.tables import table

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(n for n in registry.oracle_sql() if n.startswith("op")))
def test_query_equals_its_sql(spark, name):
    same(registry.queries()[name](spark, SF), SF, registry.oracle_sql()[name])


def test_quality_on_held_out_labels(spark):
    got = registry.queries()["op2_quality_classifier"](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out")
    n, right, lost = got.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality")), F.count_if(F.expr("predicted = 0 and quality = 1"))).first()
    assert right / n > 0.95 and lost / n < 0.02


def test_quality_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (None, 1), (8, None), (11, 0)], "doc_id long, quality int")
    out = quality.classify(awkward, labels)
    assert out.count() == awkward.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.keep_good(awkward, labels.where("false")).columns == awkward.columns
    assert quality.classify(awkward.where("false"), labels).count() == 0


def slow_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    chars, n = len(text or ""), len(words)
    share = lambda count, of: count / of if of else 0.0
    count = lambda pattern: len(re.findall(pattern, text or ""))
    upper = sum(unicodedata.category(c) == "Lu" for c in text or "")
    plain = lambda w: unicodedata.category(w)[0] not in "LN"
    return {
        "log_words": math.log1p(n), "word_length": share(sum(map(len, words)), n), "variety": math.log(len(set(words))) / math.log(n) if n > 1 else 1.0,
        "repeated_words": share(sum(a == b for a, b in zip(words, words[1:])), n), "upper_case": share(upper, chars), "digits": share(count("[0-9]"), chars),
        "symbols": share(count(r"[#$%&*+<=>@\\^_`{|}~]"), chars), "doubled_signs": share(count(r"([#$%&*!?])\1"), n), "stops": share(count("[.,;:]"), chars),
        "lone_signs": share(sum(len(w) == 1 and plain(w) for w in words), n),
    }


def test_scores_are_what_the_rules_say(spark, awkward):
    """The compiled column against statistics and rules evaluated one text at a time."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"), table(spark, "/root/testdata/sf0.001", "labels").select("doc_id", "quality")
    model = quality.train(docs, labels)
    assert len(model.weights) > 3
    rows = quality.with_score(docs.unionByName(awkward.select("doc_id", "text")), model, "score").collect()
    for r in rows:
        stats = slow_statistics(r.text)
        total = model.intercept + sum(w for rule, w in model.weights if all(stats[n] > b if above else stats[n] <= b for n, above, b in rule.parts))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9, r.doc_id


def test_tree_rules():
    text = "DecisionTreeClassificationModel: depth=2\n  If (feature 0 <= 0.5)\n   If (feature 1 > 2.0)\n    Predict: 1.0\n   Else (feature 1 <= 2.0)\n    Predict: 0.0\n  Else (feature 0 > 0.5)\n   Predict: 0.0\n"
    assert [str(r) for r in quality.tree_rules(text, ["a", "b"])] == ["a <= 0.5", "a <= 0.5 and b > 2", "a <= 0.5 and b <= 2", "a > 0.5"]


def test_toxicity_on_held_out_labels(spark):
    graded = registry.queries()["op4_toxicity"](spark, SF).join(table(spark, SF, "labels").withColumnRenamed("toxic", "label"), "doc_id").where("held_out")
    n, right = graded.agg(F.count("*"), F.count_if(F.col("toxic") == F.col("label"))).first()
    assert right / n > 0.93


def test_toxicity_of_more_labels(spark):
    sf = "/root/testdata/sf0.1"
    graded = registry.queries()["op4_toxicity"](spark, sf).join(table(spark, sf, "labels").withColumnRenamed("toxic", "label"), "doc_id").where("held_out")
    bad, found, wrong = graded.agg(F.sum("label"), F.count_if(F.expr("toxic = 1 and label = 1")), F.count_if(F.expr("toxic = 1 and label = 0"))).first()
    assert found / bad > 0.85 and wrong / found < 0.03


def test_toxicity_of_awkward_rows(spark, awkward):
    rows = [(i, f"plain words number {i} here", 0) for i in range(40)] + [(100 + i, "you idiot " * (1 + i % 7) + f"text {i}", 1) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    assert list(model.thresholds) == sorted(model.thresholds)
    out = toxicity.severity(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= r.severity <= 3 for r in out)
    graded = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert graded[101].toxic == 1 and graded[3].toxic == 0 and graded[101].severity > graded[3].severity
    unlearned = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert unlearned.weights == {}
    for m in (model, unlearned):
        assert toxicity.severity(awkward.where("false"), m).count() == 0


def ordinal_rows(seed=3, n=300, d=6, levels=2):
    """Rows of the model itself: grades drawn with two weights that count and four that do not."""
    rng = np.random.default_rng(seed)
    dense = rng.random((n, d)) < 0.4
    latent = dense @ np.r_[2.0, -1.5, np.zeros(d - 2)] + rng.logistic(size=n)
    grade = (latent[:, None] > np.arange(levels)[None, :] * 1.5 + 0.5).sum(1)
    sizes = dense.sum(1)
    return toxicity.Rows(np.nonzero(dense)[1], np.cumsum(sizes) - sizes, grade, d), dense


def test_ordinal_loss_and_gradient_equal_brute_force():
    rows, dense = ordinal_rows(n=40)
    w, theta = np.array([0.5, -0.2, 0.1, 0.0, 0.3, -0.4]), np.array([0.2, -0.5])

    def slow(w, theta):
        cuts = [theta[0], theta[0] + math.exp(theta[1])]
        total = 0.0
        for x, g in zip(dense, rows.grade):
            more = [1.0, *(1 / (1 + math.exp(-(float(x @ w) - c))) for c in cuts), 0.0]
            total -= math.log(more[g] - more[g + 1])
        return total / len(dense)

    value, by_w, by_theta = toxicity.loss(rows, w, theta)
    assert abs(value - slow(w, theta)) < 1e-9
    for got, k in zip(np.r_[by_w, by_theta], range(8)):
        e = np.eye(8)[k] * 1e-6
        assert abs(got - (slow(w + e[:6], theta + e[6:]) - slow(w - e[:6], theta - e[6:])) / 2e-6) < 1e-5


def test_ordinal_fit_is_the_optimum():
    rows, _ = ordinal_rows()
    w, theta = toxicity.fit_rows(rows, 2, 0.01, most_steps=5000, tolerance=1e-13)
    _, by_w, by_theta = toxicity.loss(rows, w, theta)
    assert np.abs(by_theta).max() < 1e-4
    assert all(abs(g + 0.01 * np.sign(x)) < 1e-4 if x else abs(g) <= 0.01 + 1e-4 for x, g in zip(w, by_w))
    assert w[0] > 1 and w[1] < -0.5 and np.abs(w[2:]).max() < 0.4 and len(rows.take(rows.grade > 0).grade) == (rows.grade > 0).sum()


def test_licence_rules(spark, awkward):
    texts = ["Text.\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU General Public License, version 3.", "Released under the MIT License", "a licence of some kind", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.licence, r.n_sentences) for r in licences.scan(docs).orderBy("doc_id").collect()]
    assert got == [("MIT", 1), ("Apache-2.0", 2), ("GPL-3.0", 2), ("MIT", 1), (None, 0), (None, 0), (None, 0)]
    assert licences.scan(awkward).count() == awkward.count() and licences.scan(awkward.where("false")).count() == 0


OTHERS = [
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License. To view a copy", "CC-BY-NC-ND-4.0"),
    ("// SPDX-License-Identifier: Apache-2.0\nint main() {}", "Apache-2.0"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    ("Boost Software License - Version 1.0 - August 17th, 2003", "BSL-1.0"),
    ("To the extent possible under law, Ann Smith has waived all copyright and\nrelated or neighboring rights to This Work.", "CC0-1.0"),
    ("Mozilla public licenses are many", None),
]


def test_the_sql_and_the_scan_agree_on_full_texts(spark, tmp_path):
    texts = [t for t, _ in OTHERS] + [MIT, BSD_2, BSD_3, APACHE, APACHE_TEXT] + [GPL.format(k, v) for k, v in (("", 3), ("", 2), ("Lesser ", "2.1"), ("Affero ", 3))] + [None, "", "All rights reserved..5 x. All rights reserved"]
    texts += [f"licence\r\n{' '.join(t.split())} and more" for t in texts if t] + ["".join(f" * {line}\r\n" for line in t.splitlines()) for t in texts if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(docs).collect()}
    assert [got[i] for i in range(len(OTHERS))] == [licence for _, licence in OTHERS]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert same(licences.scan(docs), str(tmp_path), registry.oracle_sql()["op5_license_scans"]) == len(texts)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
BSD_2 = """Copyright (c) 2020, Ann. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the University of
   Somewhere nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
APACHE_TEXT = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.
"""
GPL = """This file is part of Foo.

Foo is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.
"""


@pytest.mark.parametrize("form", ["wrapped", "comment", "dos", "unwrapped"])
def test_full_licence_texts(spark, form):
    shape = {"wrapped": lambda t: t, "comment": lambda t: "".join(f" * {line}\n" for line in t.splitlines()), "dos": lambda t: t.replace("\n", "\r\n"), "unwrapped": lambda t: " ".join(t.split())}[form]
    cases = [(MIT, "MIT", "mit-grant mit-condition"), (BSD_2, "BSD-2-Clause", "all-rights-reserved bsd-grant bsd-source bsd-binary"), (BSD_3, "BSD-3-Clause", "all-rights-reserved bsd-grant bsd-source bsd-binary bsd-name")]
    cases += [(APACHE, "Apache-2.0", "apache-2-notice apache-2-condition"), (APACHE_TEXT, "Apache-2.0", "apache-2-title"), (GPL.format("", 3), "GPL-3.0", "gpl-3-header"), (GPL.format("", 2).replace(":", ";"), "GPL-2.0", "gpl-2-header"), (GPL.format("Lesser ", "2.1"), "LGPL-2.1", "lgpl-2.1-header"), (GPL.format("Affero ", 3), "AGPL-3.0", "agpl-3-header")]
    cases += [("The licence:\n\nIt is not released under the MIT License, nor is it.", None, ""), ("Licensed under the MIT\n\nLicense", None, ""), ("licence" + ";. :\n-" * 20_000 + "All rights reserved" + "." * 50_000, "proprietary", "all-rights-reserved")]
    docs = spark.createDataFrame([(i, shape(t)) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = [(r.licence, r.sentence_ids) for r in licences.scan(docs).orderBy("doc_id").collect()]
    want = [(licence, ids) for _, licence, ids in cases]
    if form == "unwrapped":  # its blank line is gone
        want[10] = ("MIT", "mit-notice")
    assert got == want


@pytest.mark.parametrize(
    "text,licence",
    [
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details", "MIT"),
        ("The code is Licensed under the MIT License.", "MIT"),
        ("# Foo\n\nAll sources of foo are licensed under the Apache License, Version 2.0 unless noted otherwise.\n", "Apache-2.0"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", "MIT"),
        ("# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\n", "Apache-2.0"),
        ("# SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0"),
        ("License: MIT. Copyright (c) 2020 Foo. All rights reserved.", "MIT"),
        ("name: foo\nlicense: BSD-3-Clause\n", "BSD-3-Clause"),
        ("Copyright 2020 Foo. All rights reserved.", "proprietary"),
        ("The museum is licensed under the city council.", None),
        ("A license to thrill, and MIT is a school.", None),
    ],
)
def test_notices_inside_longer_sentences(spark, text, licence):
    assert licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licence == licence


def test_the_author_clause_of_bsd(spark):
    text = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.\n"
    assert licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licence == "BSD-3-Clause"


def test_padded_and_joined_notices(spark):
    texts = ["Released under the MIT " + "*" * 300 + " License.", "This work is in the public-domain.", "This work is in the public  domain.", "(All\u00a0rights\nreserved)", "All advertising materials mentioning features or use of this software must display the following acknowledgement:", "publicdomain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.licence, r.n_sentences) for r in licences.scan(docs).orderBy("doc_id").collect()]
    assert got == [("MIT", 1), ("public-domain", 1), ("public-domain", 1), ("proprietary", 1), (None, 1), (None, 0)]


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi <|assistant|> all"), (1, 2, "Bob", "Hello"), (1, 2, "Bob", "Hello"), (1, None, None, None), (1, None, "Bob", "ok"), (1, None, "Bob", "ok"), (1, 130, "Ann", "late"), (None, 0, "Ann", "alone"), (2, 0, "system", "nobody")]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    ann = next(r for r in out if (r.conv_id, r.perspective) == (1, "Ann"))
    assert [ann.text[m.begin : m.end] for m in ann.mask] == ["Hi < |assistant|> all", "late"]
    assert ann.text == "<|user name=Bob|>\nok\n<|user name=Bob|>\nok\n<|user name=unknown|>\n\n<|system|>\nBe kind.\n<|assistant|>\nHi < |assistant|> all\n<|user name=Bob|>\nHello\n<|assistant|>\nlate\n"
    assert {(r.conv_id, r.perspective, r.part) for r in out} == {(1, "Ann", 0), (1, "Bob", 0), (1, "unknown", 0), (None, "Ann", 0)}
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_the_parts_of_a_long_dialogue_are_its_whole_rendering(spark):
    rows = [(7, None if i % 50 == 0 else i, f"p{i % 3}" if i % 7 else "system", f"said {i} " * (i % 5)) for i in range(1000)] + [(8, 1, "p0", "x")]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).where("conv_id = 7").collect()
    assert len(out) == 3 * -(-1000 // 64)
    ordered = sorted((r[1] is not None, r[1] or 0, r[2], r[3]) for r in rows[:1000])
    for who in ("p0", "p1", "p2"):
        parts = sorted((r for r in out if r.perspective == who), key=lambda r: r.part)
        whole = "".join(r.text for r in parts)
        heads = {who: "assistant", "system": "system"}
        assert whole == "".join(f"<|{heads.get(s, f'user name={s}')}|>\n{t}\n" for _, _, s, t in ordered)
        assert [whole[m.begin : m.end] for r in parts for m in r.mask] == [t for _, _, s, t in ordered if s == who]
        assert all(whole.startswith(r.text, r.begin) for r in parts)


def test_cascade_is_exact(spark):
    rng = random.Random(3)
    keys = [f"k{i}.example.com" for i in range(3000)]
    listed = set(rng.sample(keys, 400))
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,), (keys[0],)], "key string")
    cascade = url_filter.build_cascade(universe, spark.createDataFrame([(k,) for k in listed] + [(None,)], "site string"), false_positives=0.3)
    got = {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert got == listed and len(cascade.levels) > 1
    empty = url_filter.build_cascade(universe, universe.where("false"))
    assert universe.where(empty.contains(F.col("key"))).count() == 0
    for options in ({}, {"max_keys": 150}, {"max_keys": 100, "at_once": 2}):  # by one cascade, by three, by four in two passes
        flagged = url_filter.listed_flag(universe, F.array("key"), spark.createDataFrame([(k,) for k in listed], "site string"), "hit", **options)
        assert {r.key for r in flagged.where("hit").collect()} == listed and flagged.count() == universe.count()


def test_sites_below_listed_ones_in_tables_with_clashing_names(spark):
    urls = ["http://www.spam.com/x", "http://spam.com", "http://notspam.com", "http://a.b.spam.com?q", None, "http://spam.com.org"]
    pages = spark.createDataFrame([(i, u, "p", "q", "r", "s") for i, u in enumerate(urls)], "page_id long, url string, __host string, __path string, __listed string, verdict string")
    out = url_filter.filter_urls(pages, [], spark.createDataFrame([("spam.com",), (None,)], "site string"))
    assert [r.verdict for r in out.orderBy("page_id").collect()] == ["block", "block", "allow", "block", "allow", "allow"]
    assert [c for c in out.columns if c.startswith("__")] == ["__host", "__path", "__listed"] and out.first()["__host"] == "p"
    assert url_filter.filter_urls(pages.where("false"), [], pages.select("url").where("false")).count() == 0
    twice = url_filter.filter_urls(pages.unionByName(pages), [], spark.createDataFrame([("spam.com",), ("spam.com",)], "site string"))
    assert sorted(map(str, twice.collect())) == sorted(2 * list(map(str, out.collect())))


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/123", "https://x.org", "http://ads-track.example.net#top", "ftp://notexample.org/es/1", "http://h://x/y"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    listed = spark.createDataFrame([("ads-track.example.net",)], "site string")
    rules = [url_filter.Rule("org", "/", "allow"), url_filter.Rule("example.org", "/es/", "block"), url_filter.Rule("example.org", "/en/1", "block")]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, listed).orderBy("page_id").collect()]
    assert got == [("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/123", "example.org/en/1", "block"), ("x.org", "", None, "allow"), ("ads-track.example.net", "", None, "block"), ("notexample.org", "/es/1", "org/", "allow"), ("h:", "//x/y", None, "allow")]


def test_mixing(spark, awkward):
    out = mixing.curriculum(awkward)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r.taken <= 3 * r.size for r in rows)
    assert sorted(map(repr, mixing.curriculum(awkward.repartition(7)).collect())) == sorted(map(repr, rows))
    by = {}
    for r in rows:
        total, target, most = by.get(r.source, (0, 0, 0))
        by[r.source] = (total + r.taken, r.target, max(most, r.size))
        assert len(r.positions) * r.size == r.taken and all(0 <= p <= 1 for p in r.positions)
    assert all(abs(total - target) <= most for total, target, most in by.values())
    assert abs(sum(t for _, t, _ in by.values()) - sum(r.size for r in rows)) < 1e-6 * sum(r.size for r in rows)
    assert mixing.curriculum(awkward.where("false")).count() == 0


def test_demand_time_inverts_the_schedule(spark):
    for tilt in (-0.5, 0.0, 0.5):
        t = spark.range(0, 101).select((F.col("id") / 100).alias("t"))
        share = F.col("t") + tilt * (F.col("t") - F.col("t") * F.col("t"))
        assert t.select(F.max(F.abs(mixing.demand_time(share, F.lit(tilt)) - F.col("t")))).first()[0] < 1e-9


def test_top_k_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.gauss(0, 1)) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (950, [1.0, 2.0]), (951, [0.5, 0.5])]
    rows += [(0, rows[0][1]), (0, [0.25] * 8), (50, rows[50][1]), (120, rows[0][1]), (120, rows[0][1])]
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(usable):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(usable) if m != n and len(v) == len(w))
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, candidate_block=64, query_bytes=300)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    short = df.where("vec_id is not null").select("vec_id", F.expr("transform(embedding, x -> x / (1 + vec_id))").alias("embedding"))
    lengths = topk.top_k(short.where("vec_id < 400"), F.col("vec_id") % 50 == 0, k=2, candidate_block=32, query_bytes=300)
    exact = [(i, [math.floor(256 * (x / (1 + i))) for x in v]) for i, v in rows if i is not None and i < 400 and v]
    best = {(n, q): sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(exact) if m != n)[:2] for n, (q, v) in enumerate(exact) if q % 50 == 0}
    assert sorted(map(tuple, lengths.collect())) == sorted((q, r + 1, i, -s) for (_, q), found in best.items() for r, (s, i) in enumerate(found))
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)
    large = spark.createDataFrame([(i, [2.0**20 + i, 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(large, F.col("vec_id") == 0).orderBy("rank").collect()] == [39, 38, 37, 36, 35]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_toxicity_features_count_different_words():
    assert toxicity.features(None) == set() == toxicity.features("12 !")
    found = toxicity.features("Abcde abcdf abcdf ABCDG abcdh")
    assert {"abcde", "abcd-1", "abcd-2", "abcd-3"} <= found and "abcd-4" not in found and "abcde-1" not in found


def test_quality_learns_from_every_label(spark, monkeypatch):
    """Of 30,000 labelled documents all that are not held out are learned from."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(quality, "fit", lambda rows, names: rows.count())
    assert quality.train(docs, labels) == docs.where(~quality.held_out(F.col("doc_id"))).count() > 23_000

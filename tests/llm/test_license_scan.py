from fathom.llm import license_scan as ls


def score(model, line):
    import numpy as np

    words = ls.words_of(line)
    s = np.array(model.bias) + sum((np.array(model.weights[f]) for f in ls.features(words) if f in model.weights), np.zeros(len(model.classes)))
    p = np.exp(s / model.temperature - (s / model.temperature).max())
    p /= p.sum()
    return model.classes[int(p.argmax())], float(p.max())


def brute(model, text):
    """Each line scored and compared by itself."""
    hits = []
    for pos, line in enumerate((text or "").split("\n")):
        words = ls.words_of(line)
        if not words or not ls.features(words) & set(model.weights):
            continue
        label, p = score(model, line)
        if label == ls.NEITHER or p < ls.SURE:
            continue
        cut = lambda w: {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        mine = cut(words)
        sure = any(len(mine & cut(w)) >= ls.CONFIRM * min(len(mine), max(1, len(w) - 2)) for x in ls.TEMPLATES.get(label, ()) for w in [ls.words_of(x)])
        hits.append(f"{pos}:{label if sure else ls.UNKNOWN}")
    return ",".join(hits)


TEXTS = [
    None, "", "\n\n", "Released under the MIT License.", "x y z\nLicensed under the Apache License, Version 2.0.\n\nThis work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Foo Bar License, version 9.", "He lost his driving license.", "word " * 20_000 + "\nReleased under the MIT License.", "é ü ñ", "Released under the MIT License.\nReleased under the MIT License.",
]


def test_equals_brute_force_on_odd_rows(spark):
    model = ls.train()
    table = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], ""), (None, TEXTS[4], "")]
    docs = spark.createDataFrame(table, "doc_id long, text string, found string")
    got = ls.scan(docs).collect()
    assert sorted(((r.doc_id, r.found) for r in got), key=str) == sorted(((d, brute(model, t)) for d, t, _ in table), key=str)
    by = {r.doc_id: r for r in got}
    assert by[3].families == "mit" and by[4].families == "apache,gpl" and by[5].n_licence == 0 and by[6].found == ""
    assert ls.scan(docs.where("false")).count() == 0


def test_accuracy_on_examples_not_trained_on():
    import random

    model = ls.train()
    made = ls._examples(random.Random(99), 60)
    right = sum(score(model, " ".join(words))[0] == label for words, label in made)
    assert right / len(made) > 0.93


def test_clean_lines_stay_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ls.scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(bool(r.found) == ("icense" in r.text) for r in rows)
    plan = ls.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


#: Notices as projects write them; none is a template.
NOTICES = [
    ("mit", "This project is licensed under the terms of the MIT license, see the LICENSE file for details."),
    ("mit", "Code is released under the MIT license, copyright 2019 the authors."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this code, to deal in the Software without any restriction whatsoever"),
    ("apache", "Licensed to you under the Apache License, Version 2.0, by the contributors named below."),
    ("apache", "you may not use this file except in compliance with the License; a copy of the License is at the root of this tree"),
    ("apache", "Unless required by applicable law, the software distributed under the License is distributed on an AS IS BASIS, without warranties of any kind."),
    ("bsd", "Redistribution and use of this code in source and binary forms, with or without changes, are permitted provided that these conditions are met"),
    ("bsd", "The names of the contributors may not be used to endorse or promote products derived from this software without prior written permission."),
    ("gpl", "This script is free software; you may redistribute it and/or modify it under the terms of the GNU General Public License, version 2 or any later version."),
    ("gpl", "See the GNU General Public License for more details; it is useful but comes without any warranty."),
    ("lgpl", "You can use this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("agpl", "The server is published under the GNU Affero General Public License, either version 3 or any later version."),
    ("mpl", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("cc", "The photographs are licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "The authors have waived all copyright and related rights to this dataset, to the extent possible under law."),
    ("isc", "Permission to use, copy, modify and distribute this program for any purpose with or without fee is hereby granted, provided that this notice appears in all copies."),
    ("zlib", "Permission is granted to anyone to use this code for any purpose, also in commercial applications, and to alter it and redistribute it freely"),
    ("boost", "Distributed under the Boost Software License, Version 1.0, see the file LICENSE."),
    ("epl", "The plugin is made available under the terms of the Eclipse Public License v2.0"),
    ("unlicense", "This repository is free and unencumbered software released into the public domain."),
]


def test_recall_on_notices_that_are_no_templates(spark):
    clean = ["The committee gave its permission to copy the public list.", "A general fee of 3.0 per visitor is charged, free for children.", "Anyone may visit the library on any day, with or without a card.", "The version of the story that the author told was the second."]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(NOTICES)] + [(100 + i, t) for i, t in enumerate(clean)], "doc_id long, text string")
    got = {r.doc_id: r for r in ls.scan(rows).collect()}
    right = [got[i].families == family for i, (family, _) in enumerate(NOTICES)]
    noticed = [got[i].n_licence + got[i].n_unknown > 0 for i in range(len(NOTICES))]
    print("family", sum(right), "noticed", sum(noticed), "of", len(NOTICES), [t for (_, t), ok in zip(NOTICES, right, strict=True) if not ok])
    assert sum(right) >= 19 and sum(noticed) >= 17
    assert all(got[100 + i].found == "" for i in range(len(clean)))

import math
import random
import re
import textwrap

from basketlab.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(AZ))


def brute(text):
    w = words(text)
    places = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    labels, share = {x for _, x in places}, 0.0
    lines = [set(words(line)) for line in (text or "").split("\n")]
    for label, notice, required in licenses.TEMPLATES:
        t, run = set(words(notice)), len(words(notice))
        runs = [set(w[i : i + run]) for i in range(max(1, len(w) - run + 1))]
        for held in lines + runs:
            common = len(t & held)
            if set(words(required)) <= held and common >= math.ceil(0.8 * len(t) - 1e-9):
                labels, share = labels | {label}, max(share, common / len(t))
    starts = [i for i, _ in places]
    return (
        len(w),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({x for _, x in places})),
        ",".join(sorted(labels)),
        1.0 if places else round(share, 9),
    )


def got(df):
    return sorted(
        (
            (r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)))
            for r in licenses.scan(df).collect()
        ),
        key=str,
    )


def test_against_brute_force(docs_of):
    rng = random.Random(2)
    pool = ["cc", "by", "CC BY", "General", "public", "License", "all", "rights", "RESERVED", "é", "the", "\n", ",", "x1", "license"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(250)]
    for _, notice, _ in licenses.TEMPLATES:
        w = notice.split()
        for drop in (0, 1, 2, 4):
            kept = [x for k, x in enumerate(w) if k not in rng.sample(range(len(w)), min(drop, len(w) - 1))]
            texts.append("the of\nand " + " ".join(kept) + " of the\n" + rng.choice(pool))
    texts += [None, "", "cc-by", "CCBY cc  by.", "general--public LICENSE"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, "All rights reserved")]
    assert got(docs_of(rows)) == sorted(((d, brute(t)) for d, t in rows), key=str)


def test_empty_tables_and_blocks(docs_of, spark):
    assert got(docs_of([])) == []
    rows = docs_of([(1, "Released under the MIT License.")]).selectExpr("doc_id", "text", "xxhash64(text) AS text_hash")
    one = licenses.template_matches(rows, licenses.templates(spark)).collect()
    many = licenses.template_matches(rows, licenses.templates(spark), block=20).collect()
    assert {r.label for r in one} == {r.label for r in many} == {"mit"}
    assert licenses.template_matches(rows, licenses.templates(spark).where("false")).count() == 0


def test_wrapped_notices(docs_of):
    texts = {}
    for _, notice, _ in licenses.TEMPLATES:
        for width in (10, 30, 72):
            lines = textwrap.wrap(notice, width, break_long_words=False, break_on_hyphens=False)
            texts["intro of words\n\n" + "\n".join(lines) + "\nmore of them"] = notice
            texts["x " * 41 + "\n * " + "\r\n * ".join(lines) + "\n */ tail"] = notice
    labels = {notice: label for label, notice, _ in licenses.TEMPLATES}
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in licenses.scan(docs_of(rows)).collect()}
    for d, text in rows:
        assert labels[texts[text]] in found[d].labels.split(","), text
        assert found[d].score == 1.0, text


def test_runs_against_brute_force(docs_of):
    rng = random.Random(4)
    notices = [(label, n) for label, n, _ in licenses.TEMPLATES if label in ("mit", "bsd", "gpl", "reserved")]
    texts = []
    for _, notice in notices * 4:
        w = [x for x in notice.split() if rng.random() < 0.9]
        for _ in range(rng.randint(0, 6)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["some", "other", "the", "license", "granted"]))
        texts.append("one\n" * rng.randint(0, 90) + "\n".join(w) + "\ntwo" * rng.randint(0, 40))

    def brute_runs(text):
        w, out = words(text), set()
        for label, notice, required in licenses.TEMPLATES:
            t = words(notice)
            run, need = len(t), math.ceil(0.8 * len(set(t)) - 1e-9)
            parts = [set(w[i : i + run]) for i in range(max(1, len(w) - run + 1))]
            if any(set(words(required)) <= p and len(set(t) & p) >= need for p in parts):
                out.add(label)
        return out | {x for x in brute(text)[5].split(",") if x}

    rows = list(enumerate(texts))
    found = {r.doc_id: {x for x in r.labels.split(",") if x} for r in licenses.scan(docs_of(rows)).collect()}
    assert found == {d: brute_runs(t) for d, t in rows}
    assert any(found.values()) and not all(found.values())


NEAR_MISSES = {
    "Code released under the Apache license": "",
    "was released under the new license terms": "",
    "released under the same license": "",
    "Released under the BSD License.": "",
    "Released under the MIT License.": "mit",
    "Licensed under the Eclipse License, Version 2.0": "",
    "Licensed under the Mozilla License, Version 2.0": "",
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "Licensed under the Apache License Version 1.1": "",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons NonCommercial 4.0 International License": "",
    "Licensed under CC BY 4.0.": "cc-by",
    "Licensed under CC SA 4.0.": "",
    "Licensed under BY-NC 4.0.": "",
    "dedicated to the public domain under PDDL 1.0 Universal": "",
    "dedicated to the public domain under CC0 1.0 Universal": "cc0",
    "This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0": "",
    "This work is licensed under the European Union Public License, version 3.": "",
    "This work is licensed under the Affero General License, version 3.": "",
    "This program is free software: you can redistribute it and/or modify it under the terms of the Artistic License": "",
    "This program is free software: you can redistribute it and/or modify it under the terms of the Mozilla Public License": "",
    "Redistribution and use in source forms, with or without modification, are permitted provided that the following conditions are met": "",
    "Use is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "",
    "Permission is hereby refused, free of charge, to any person obtaining a copy of this software and associated documentation files": "",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this book and associated documentation files": "",
    "All rights granted.": "",
    "All seats reserved.": "",
    "you may not use this file except in compliance with the License, Version 2.0 of the Licensed work": "",
    "the License under the licensed MIT": "mit",
    "Released under the permissive License of MIT kind": "mit",
}


def test_near_misses(docs_of):
    rows = list(enumerate(NEAR_MISSES))
    found = {r.doc_id: r.labels for r in licenses.scan(docs_of(rows)).collect()}
    assert {text: found[d] for d, text in rows} == NEAR_MISSES


def test_every_notice_only_finds_its_own_license(docs_of):
    rows = [(k, notice) for k, (_, notice, _) in enumerate(licenses.TEMPLATES)]
    found = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(docs_of(rows)).collect()}
    for k, (label, notice, _) in enumerate(licenses.TEMPLATES):
        # The fuller name of CC BY-NC holds that of CC BY.
        assert found[k] - ({"cc-by"} if label == "cc-by-nc" else set()) == {label}, notice


def test_templates_without_required_words(docs_of, spark):
    notices = spark.createDataFrame([("a", "alpha beta gamma delta epsilon"), ("b", None)], "label string, text string")
    assert licenses.scan(docs_of([(1, "alpha beta gamma delta")]), notices).first().labels == "a"

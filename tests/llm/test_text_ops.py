"""PII, chat formatting, licences, line dedup and quality rules."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import chat, license, line_dedup, pii, quality, queries

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15),
]


def digits(m):
    return re.sub("[^0-9]", "", m)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in p.finditer(text or "") if ok(m.group()))


PII_TEXTS = [
    "write to a.b@c-d.org, a@b.c_d@e.f or @x.y", "ips 1.2.3.4 1.2.3.4.5 256.1.1.1 007.1.1.1 0000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 555-0100 or +12", "é😀 mail@host.example.com 😀", "token = \"9f86d081884c7d659a2feaa0c55ad015\" then", "password=b76fc1ffc4ac155723 x", "1 2 3 4", "", None, "@" * 50, "1" * 3000,
    "a" * 50_000 + "@b.co",
]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(3)
    texts = PII_TEXTS + ["".join(rng.choice("ab1.2@+- ()_3é\n") for _ in range(60)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in pii.annotate(frame).select("doc_id", pii.listed(pii.KINDS).alias("b")).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}


def planted(rng):
    """(kind, form, text, value) of personal data in the forms in which it is met."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum, hexes, caps = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    person = lambda: rng.choice(["Mary", "Hans", "Carlos", "Claire"]) + " " + rng.choice(["Miller", "Schmidt", "Dubois", "Garcia"])
    forms = {
        ("secret", "quoted"): ('token = "', lambda: some(hexes, 40), '" and'), ("secret", "key"): ("api_key=", lambda: some(alnum, 22) + "7a", " then"),
        ("secret", "password"): ("password=", lambda: some(alnum, 19) + "4", " ok"), ("secret", "header"): ("Authorization: Bearer ", lambda: "k1" + some(alnum, 30), " sent"),
        ("secret", "url"): ("https://x.example.com/a?access_token=", lambda: some(alnum, 30) + "3", "&page"), ("secret", "yaml"): ("secret: '", lambda: some(alnum, 30) + "5b", "' next"),
        ("id", "ssn"): ("SSN: ", lambda: f"{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", " on file"),
        ("id", "iban"): ("IBAN ", lambda: "DE" + some("0123456789", 20), " please"), ("birth", "iso"): ("born on ", lambda: f"19{rng.randint(40, 99)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", " in town"),
        ("birth", "dob"): ("DOB: ", lambda: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/19{rng.randint(40, 99)}", " noted"), ("name", "title"): ("seen with Dr. ", person, " today"),
        ("address", "street"): ("lives at ", lambda: f"{rng.randint(1, 999)} " + rng.choice(["Oak", "Elm", "Main"]) + " Street", " now"),
    }
    return [(kind, form, before, make(), after) for _ in range(30) for (kind, form), (before, make, after) in forms.items()]


PROSE = [
    "a-long-hyphenated-name-of-2024 number {}", "chapter {} of the well-known-and-much-read-book-2 says", "the meeting of 2019-03-1{} was long", "see section 12-34 and part {} there", "the file is /usr/lib/python3/dist-packages/some_module_{}",
    "The Street was wide and {} people stood", "They said A Thing Of {} Days", "call extension 123-45 or {} then",
]


def test_added_kinds_are_found_in_their_forms_and_prose_is_left(spark):
    rng = random.Random(7)
    rows = planted(rng)
    texts = ["plain words here " + b + v + a + " and more" for _, _, b, v, a in rows] + [p.format(i % 10) for i in range(400) for p in PROSE]
    got = {r.doc_id: r for r in pii.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    caught = {}
    for i, (kind, form, _, value, _) in enumerate(rows):
        spans = [texts[i][a:b] for a, b in got[i][kind]]
        caught.setdefault((kind, form), []).append(any(value in s or s in value and len(s) > 0.8 * len(value) for s in spans))
    assert all(np.mean(x) >= 0.95 for x in caught.values()), {k: np.mean(x) for k, x in caught.items()}
    assert not [(texts[i], k) for i in range(len(rows), len(texts)) for k in pii.ADDED if got[i][k]]


def brute_added(texts):
    """The added spans of each text, with plain Python for all but the two fits."""
    share = lambda m: len(digits(m)) / len(m)

    def said(kind, m, before):
        tail, vote = before[-40:].lower(), lambda yes, other: "1" if yes else other
        silent = "0" if kind in ("birth", "secret") else "-"
        out = vote(re.search(pii.STRICT[kind], m), "0" if kind in ("birth", "id") else "-") + vote(re.search(pii.GAZETTEER[kind], tail), silent) + vote(re.search(pii.CONTEXT[kind], tail), silent)
        if kind == "secret":
            out += vote(0.05 <= share(m) <= 0.9 and len(m) >= 16, "0") + ("0" if re.search(r"[a-z]{9,}|[-/_]{2,}|[a-z]-[a-z]+-[a-z]", m) else "-")
        if kind == "name":
            out += vote(re.search(rf"^{pii._TITLE}\b", m), "-") + vote(re.search(rf"\b{pii._GIVEN}\b", m), "-")
        grade = lambda c, a, b: "a" if c < a else "b" if c < b else "c"
        return out, grade(len(m), 20, 32) + grade(share(m), 0.25, 0.5)

    seen = {k: [] for k in pii.ADDED}
    for i, t in enumerate(texts):
        for k in pii.ADDED:
            last = 0
            for m in re.finditer(pii.CANDIDATES[k][0], t):
                seen[k].append((i, m.start(), m.end(), *said(k, m.group(), t[last : m.start()])))
                last = m.end()
    out = [[(m.start(), m.end()) for k, p, ok in BASE for m in p.finditer(t) if ok(m.group())] for t in texts]
    added = [set() for _ in texts]
    for k in pii.ADDED:
        counts = {}
        for *_, v, s in seen[k]:
            counts[v, s] = counts.get((v, s), 0) + 1
        weights = pii.train(counts) if counts else {}
        new = [(i, a, b) for i, a, b, v, s in seen[k] if weights["bias"] + sum(weights.get(f, 0) for f in pii._features(v, s)) >= 0 and not any(x < b and a < y for x, y in out[i])]
        for i, a, b in new:
            out[i].append((a, b))
            added[i].add((k, a, b))
    return added


def test_added_spans_equal_brute_force(spark, sf_dir):
    texts = [b + v + a for _, _, b, v, a in planted(random.Random(3))] + [p.format(i) for i in range(9) for p in PROSE]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = pii.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = brute_added(texts)
    for r in got:
        assert {(k, a, b) for k in pii.ADDED for a, b in r[k]} == want[r.doc_id], texts[r.doc_id]
    assert sum(map(len, want)) > 300


def test_pii_on_odd_documents(docs, wide, no_docs):
    one = sorted(map(repr, pii.annotate(docs).collect()))
    assert one == sorted(map(repr, pii.annotate(wide).collect())) and len(one) == docs.count()
    assert pii.annotate(no_docs).count() == 0


def turns(spark):
    rows = [
        (1, 0, "user", "hi\\ ### you </turn> <join>"), (1, 1, "assistant", "a####b"), (1, 2, "assistant", "\\b \\h <join"), (1, 3, "user", None), (1, 4, None, "x: y"),
        (2, None, "a: b", ""), (2, 0, "assistant", "e😀\n### a: </turn>\n"), (2, 0, "assistant", "e😀\n### a: </turn>\n"), (None, 1, "user", "z" * 100_000), (3, 0, "assistant", "\\" * 99),
    ]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_reads_back_every_turn(spark):
    rows, frame = turns(spark)
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(frame)).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((t is not None, t or 0, r or "null", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, _, r, x in own]
        assert back[c].loss_text == "".join(x for _, _, r, x in own if r == "assistant")
    assert back[1].formatted.count("</turn>\n") == 4  # two assistant turns share one


def test_chat_of_nothing(spark):
    _, frame = turns(spark)
    assert chat.formatted(frame.limit(0)).count() == 0
    more = frame.withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(2)).withColumn("p", F.lit(3))
    assert chat.formatted(more).count() == 4


NOTICES = {
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "mit": "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\"), to deal\n// in the Software without restriction, including without limitation the rights",
    "mpl": " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
    "apache": "   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either",
    "agpl": "it under the terms of the GNU Affero General Public License as published\n by the Free Software Foundation",
}
SHORT = {
    "Released under the GPL v3.": "gpl", "distributed under AGPL-3.0": "agpl", "SPDX: Apache-2.0": "apache", "MPL 2.0 applies.": "mpl", "BSD-3-Clause": "bsd",
    "SPDX-License-Identifier: MIT": "mit", "lizenziert unter CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "CC BY-SA 4.0": "cc-by-sa", "CC0-1.0": "cc0",
    "The MIT License was released under this, they say": "mit", "Released under the LGPL license": "lgpl",
}
NO_NOTICES = [*license.NEGATIVES, "she graduated from MIT in 1999", "my driver license is lost", "the license of the mit students", "apache county, version 2.0 of the map", "nothing here", ""]


def plain_windows(n=150):
    rng = random.Random(8)
    pool = [sentence_word(rng) for _ in range(400)] + ["the", "of", "a", "to", "and", "in", "under", "with", "is"] * 20
    return [[rng.choice(pool) for _ in range(60)] for _ in range(n)]


def sentence_word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))


@pytest.fixture(scope="module")
def licence_model():
    return license.train(plain_windows())


def brute_licences(text, model):
    """Families that some window of the text confirms, by plain Python."""
    out = set()
    for paragraph in re.split(r"\n[ \t\r]*\n", (text or "").lower()):
        w = [x for x in license.words(paragraph) if len(x) <= 40]
        for low in range(0, max(1, len(w) - 30), 30):
            own = w[low : low + 60]
            if own:
                family, p = model.predict(own)
                if family != license.UNKNOWN and p >= model.threshold and license.confirmed(own, family):
                    out.add(family)
    return ",".join(sorted(out))


def test_notices_as_they_stand_in_files_are_confirmed(spark, licence_model):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(plain_windows(1)[0]) for _ in range(n))
    said = [(f, t) for f, t in NOTICES.items()] + [(f, t) for t, f in SHORT.items()] + [("", t) for t in NO_NOTICES]
    rows = [(i, t) for i, (_, t) in enumerate(said)] + [(1000 + i, prose(90) + "\n" + t + "\n" + prose(70)) for i, (_, t) in enumerate(said)]
    got = {r.doc_id: r.families for r in license.licences(spark.createDataFrame(rows, "doc_id long, text string"), licence_model).collect()}
    for i, (family, text) in enumerate(said):
        assert got[i] == got[1000 + i] == family, text


def test_licences_equal_brute_force(spark, licence_model, docs, wide, no_docs, rows, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.families for r in license.licences(frame, licence_model).collect()}
    assert got == {r.doc_id: brute_licences(r.text, licence_model) for r in frame.collect()} and any(got.values())
    assert license.licences(docs, licence_model).count() == len(rows) == license.licences(wide, licence_model).count()
    mixed = [(i, t) for i, t in enumerate([*NOTICES.values(), *SHORT, "\n\n".join(NOTICES.values()), "." * 100_000 + " GPL v3", "a." * 50_000 + " MPL 2.0", None, ""])]
    own = {r.doc_id: r.families for r in license.licences(spark.createDataFrame(mixed, "doc_id long, text string"), licence_model).collect()}
    assert own == {i: brute_licences(t, licence_model) for i, t in mixed}
    assert license.licences(no_docs).count() == 0


def test_held_out_notices_are_recognised(licence_model):
    """In new surroundings nearly all; of templates kept from the training, whose words are partly new, two of five."""
    rng = np.random.default_rng(11)
    plain = plain_windows()
    fresh = license._augmented(rng, plain_windows(40)[::-1], 5)
    assert sum(licence_model.predict(w)[0] == f for w, f in fresh) > 0.95 * len(fresh)
    kept = license.TEMPLATES
    try:
        license.TEMPLATES = {f: [t for i, t in enumerate(ts) if i % 3 != 1] for f, ts in kept.items()}
        model = license.train(plain)
    finally:
        license.TEMPLATES = kept
    unseen = license._augmented(rng, plain, 3, fold=1, held=True)
    assert sum(model.predict(w)[0] == f for w, f in unseen) > 0.38 * len(unseen)
    assert not any(p >= model.threshold and f != license.UNKNOWN for f, p in map(model.predict, plain_windows(60)))


def brute_lines(rows):
    """Kept (doc_id, line) by all pairs over character runs."""
    found = sorted(((i is not None, i or 0, k), x) for i, t, *_ in rows for k, x in enumerate((t or "").split("\n")) if x.strip())
    names = list(dict.fromkeys(x for _, x in found))
    group = dict(zip(names, all_groups(names), strict=True))
    kept = {}
    for (known, i, k), x in found:
        kept.setdefault(group[x], (i if known else None, k))
    return set(kept.values())


def test_line_dedup_equals_all_pairs(docs, rows):
    out, n_lines, n_removed = line_dedup.dedup(docs)
    kept = brute_lines(rows)
    for r in out.collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        if text is None:
            assert r.text is None and r[n_lines] == 0
            continue
        left = [x for k, x in enumerate(text.split("\n")) if not x.strip() or (r.doc_id, k) in kept]
        assert r.text == "\n".join(left) and r[n_removed] == len(text.split("\n")) - len(left)


def all_groups(texts, threshold=0.8, width=5):
    """The group of each line that links of all pairs over character runs join."""
    runs = [{t[i : i + width] for i in range(max(1, len(t) - width + 1))} for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and len(runs[i] & runs[j]) >= threshold * len(runs[i] | runs[j]) - 1e-9:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def all_pairs(texts):
    """Lines that have a near copy before them."""
    group = all_groups(texts)
    return {i for i, g in enumerate(group) if g in group[:i]}


def left_after(spark, texts, **options):
    """Lines that go, of one document a line."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, _, n_removed = line_dedup.dedup(frame, **options)
    return {r.doc_id for r in out.where(f"{n_removed} > 0").collect()}


def test_short_and_blank_free_lines_equal_all_character_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    lines = [" ".join(word() for _ in range(n)) for n in (10, 10, 12, 14, 16, 20)] * 1 + ["\t".join(word() for _ in range(12)) for _ in range(4)]
    lines += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(70)) for _ in range(6)] + ["ab", "abc", "\U0001f600" * 3, "xyzzy"]
    changed = []
    for t in lines:
        at = len(t) * 2 // 3
        changed.append(t[:at] + ("#" if t[at] != "#" else "+") + t[at + 1 :])
    texts = lines + changed
    expected = all_pairs(texts)
    assert len(expected) >= 14 and not expected & set(range(len(lines)))
    assert left_after(spark, texts) == expected


def test_near_copies_among_templated_lines_are_found(spark):
    """Thousands of lines of shared boilerplate, below the threshold to each other, and near copies of some."""
    rng = random.Random(4)
    word = lambda n=6: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    boiler = [word() for _ in range(30)]
    lines = [" ".join([*boiler, *(word() for _ in range(9))]) for _ in range(3000)]
    copies = [t[:-2] + "#" + t[-1] for t in lines[::4]]
    runs = [{t[i : i + 5] for i in range(len(t) - 4)} for t in lines[:60]]
    assert 0.6 < max(len(x & y) / len(x | y) for x in runs for y in runs if x is not y) < 0.8
    gone = left_after(spark, lines + copies)
    assert not gone & set(range(3000)) and len(gone) >= 0.99 * len(copies)


def test_line_dedup_in_small_blocks_and_ranges(spark):
    rng = np.random.default_rng(3)
    key = np.concatenate([rng.integers(0, 300, 400), np.full(300, 7)])
    uid = np.concatenate([rng.integers(0, 5, 400), np.arange(300)])
    rows = list(zip(key.tolist(), uid.tolist(), strict=True))
    shared = {r for r in rows if len({u for k, u in set(rows) if k == r[0]}) > 1}
    got = [tuple(r) for r in line_dedup.met(spark.createDataFrame(rows * 2, "key long, uid long"), 7).collect()]
    assert len(got) == len(set(got)) and shared <= set(got) and len(set(got) - shared) <= 14


def test_line_dedup_carries_columns(docs, wide, no_docs):
    out, a, b = line_dedup.dedup(wide)
    assert out.columns[: len(wide.columns)] == wide.columns and out.count() == docs.count()
    assert a not in wide.columns and b not in wide.columns
    assert line_dedup.dedup(no_docs)[0].count() == 0


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\t#é\x1c\xa0") for _ in range(200)) for _ in range(60)] + ["a b c d e a b c d e", "", None, "x\ny\nx\n \n \n", "a " * 500]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: tuple(r.s[c] for c in quality.COUNTS) for r in frame.select("i", quality.text_statistics("text").alias("s")).collect()}
    assert got == {i: brute_stats(t) for i, t in enumerate(texts)}


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((900, len(quality.FEATURES)))
    bad = (x[:, 0] > 0.7) & (x[:, 3] <= 0.4)
    rules = quality.learn(x, bad)
    said = np.logical_or.reduce([r.covers(x) for r in rules])
    assert (said == bad).mean() > 0.97 and "and" in str(rules[0])
    assert quality.learn(x, np.zeros(900, bool)) == []


def test_quality_on_odd_documents(spark, docs, wide, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 1), (31, 0), (None, 1), (2, None), (999, 0)], "doc_id long, quality int")
    out, stats, failed, kept = quality.judge(wide, labels)
    assert out.columns[: len(wide.columns)] == wide.columns and out.count() == docs.count()
    assert {r.doc_id for r in out.where(f"`{failed}`").collect()} >= {22, 23, 24, 25, 26}
    assert quality.judge(no_docs, labels)[0].count() == 0
    assert quality.judge(docs, labels.limit(0))[0].count() == docs.count()


def test_registered_digest_of_the_trial_conversation(spark, sf_dir):
    r = queries.op3_chat(spark, sf_dir).where("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0

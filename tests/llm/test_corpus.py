"""The corpus operators against brute force on a small table with every odd case."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import ann, bpe, exact_dedup, language_id, license_scan, lm_scoring, mixing, ngram_join, queries, substring_dedup, suffix_array_dedup

KIND = "doc_id long, text string, lang string, source string, n_chars long, k int, id long, a int, _size long, rep long"


def table():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = [None, "", "  \n ", "123 !!", "one two", "One TWO", "x", "é" * 90, "ab " * 400, base[0], base[0], base[0].upper(), base[1] + "\n" + base[0], base[2] + " tail", base[2] + " tail end"]
    for b in base:  # near copies: one word changed each
        for _ in range(3):
            w = b.split()
            w[rng.randrange(60)] = word()
            texts.append(" ".join(w))
    texts += [base[3] + "\n" + base[4] + " " + base[5], " ".join(word() for _ in range(4000)), "Released under the MIT License.\nlicensed under cc by 4.0! x", "a<|endoftext|>b  it's"]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "ß", None]), 1, 0, 0, 0, 0, 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


def words(t):
    return (t or "").encode().split()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_exact(docs, rows):
    norm = {r[0]: (r[1] or "").encode().lower() for r in rows}
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert len(got) == len(rows)
    for key, t in norm.items():
        same = [k for k, u in norm.items() if u == t]
        r = got[key]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), key == max(same), sha(t))
    assert exact_dedup.drop_copies(docs).count() == len(set(norm.values()))


def test_near(docs, rows):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = ngram_join.near_components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(s), comp[k]) for k, s in sets.items()}


def test_near_with_heavy_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    monkeypatch.setattr(ngram_join, "PAIRS", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 230)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(76)} for i, t in rows}
    comp = {k: k for k in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_windows(docs, rows):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), r[0])
    got = {r.doc_id: r for r in substring_dedup.without_repeats(docs).collect()}
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < r[0]:
                gone[i : i + 13] = [True] * 13
        x = got[r[0]]
        assert (x.n_words, x.n_removed, x.kept_sha256) == (len(w), sum(gone), sha(b" ".join(a for a, g in zip(w, gone, strict=True) if not g)))
    assert sum(x.n_removed for x in got.values()) > 0


@pytest.mark.parametrize("in_memory", [2000, 0])
def test_bytes(docs, rows, monkeypatch, in_memory):
    monkeypatch.setattr(suffix_array_dedup, "GROUP_RUNS", in_memory)
    seen = Counter(d[i : i + 200] for r in rows for d in [(r[1] or "").encode()] for i in range(len(d) - 199))
    got = {r.doc_id: r for r in suffix_array_dedup.without_repeats(docs).collect()}
    for r in rows:
        d = (r[1] or "").encode()
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        x = got[r[0]]
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(d), sum(gone), spans, sha(bytes(a for a, g in zip(d, gone, strict=True) if not g)))


def test_mixing(docs, rows):
    mix = mixing.Mix(docs)
    size = {r[0]: len(words(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    taken = {r["_id"]: r["n"] for r in mix.uses().groupBy("_id").agg(F.sum("_taken").alias("n")).collect()}
    names = [s["name"] for s in mix.sources]
    assert names == sorted([n for n in names if n is not None]) + [None]
    assert math.isclose(sum(s["target"] for s in mix.sources), 1.5 * sum(size.values()))
    for s in mix.sources:
        assert s["target"] <= 2 * s["size"] + 1e-9
        assert abs(sum(n for k, n in taken.items() if source[k] == s["name"]) - s["target"]) <= 1
    assert all(n <= 2 * size[k] for k, n in taken.items())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(taken.values())


def test_permutation_and_shards():
    for n in (1, 2, 3, 10, 1000):
        p = mixing.permute(np.arange(n), n, b"k")
        assert sorted(p) == list(range(n)) and (mixing.permute(p, n, b"k", back=True) == np.arange(n)).all()
    assert (mixing.shard_counts([5, 0, 17], 4, 1).sum(0) == [5, 0, 17]).all()


def test_license(spark, docs, rows):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.sql(license_scan.SQL).df().sort_values("doc_id").astype(str).values.tolist()
    got = license_scan.license_scan(docs).select("doc_id", "n_sentences", "sentence_ids", "licenses").toPandas().sort_values("doc_id").astype(str).values.tolist()
    assert got == want and any("CC-BY-4.0,MIT" == r[3] for r in got)


def test_language(spark):
    rng = random.Random(1)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(2)) for _ in range(30))
    rows = [(i, make(p), lang) for i in range(60) for lang, p in (("aa", ["tha", "ing", "er"]), ("bb", ["sch", "keit", "ung"]))]
    rows += [(900, None, "aa"), (901, "12 !", "bb"), (902, "", None), (903, "日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = language_id.fit(df.where(~language_id.held_out(F.col("doc_id"))))
    got = {(r.doc_id, r.lang): (r.lang_pred, r.score) for r in language_id.predict(df, f, ["doc_id", "lang"]).collect()}
    assert all(p == lang for (i, lang), (p, _) in got.items() if i < 900) and all(0 <= s <= 1 for _, s in got.values())
    assert got[900, "aa"] == got[901, "bb"] == got[902, None] == ("und", 0.0) and got[903, None][0] in ("aa", "bb")
    empty = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, empty, ["doc_id"]).collect()} == {"und"}


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1100, [0.0] * 8, 1), (1200, [float("nan")] * 8, 1), (1300, [None] * 8, 1), (1400, [1.0], 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = x.astype(float)
    assert set(got) == {0, 100, 200, 300}
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        order = sorted((k for k in range(400) if k != q), key=lambda k: (d[k], k))[:10]
        assert [v for _, v, _ in sorted(found)] == order and all(abs(s - d[v]) < 1e-15 for _, v, s in found)
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_language_model(docs, rows):
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, ~lm_scoring.held_out(F.col("doc_id"))).collect()}
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update((r[1] or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = [*(r[1] or "").encode().lower().split(), None]
        x = got[r[0]]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(counts[t] > 0 for t in w), n)
        assert math.isclose(x.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in w), abs_tol=1e-9) and x.score < 0


def test_exchange_finds_classes():
    pairs = np.zeros((6, 6))
    for a in (0, 2, 4):
        for b in (1, 3, 5):
            pairs[a, b] = pairs[b, a] = 10
    own = lm_scoring.exchange(pairs[[0, 1, 3, 2, 4, 5]][:, [0, 1, 3, 2, 4, 5]], 2, 5)
    assert own[0] == own[3] == own[4] and own[1] == own[2] == own[5] and own[0] != own[1]


def test_exchange_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    k, classes = 24, 4
    kind = rng.permutation(np.arange(k) % classes)
    pairs = np.array([[40 if kind[b] == (kind[a] + 1) % classes else rng.integers(0, 3) for b in range(k)] for a in range(k)])
    pairs = np.pad(pairs, (0, 2), constant_values=1)  # other words and edges
    df = spark.createDataFrame([(a * (k + 2) + b, int(pairs[a, b])) for a in range(k + 2) for b in range(k + 2) if min(a, b) < k and pairs[a, b]], "pair long, n long").repartition(3)
    own = lm_scoring.clustered(df, k, classes)
    assert (own == lm_scoring.exchange(pairs[:k, :k], classes, lm_scoring.SWEEPS)).all()  # one part is plain exchange
    have = lm_scoring.class_pairs(df, own, classes)
    want = np.zeros((classes + 2, classes + 2))
    for a in range(k + 2):
        for b in range(k + 2):
            if min(a, b) < k:
                want[[*own, classes, classes + 1][a], [*own, classes, classes + 1][b]] += pairs[a, b]
    assert (have == want).all()
    monkeypatch.setattr(lm_scoring, "CLUSTERED", 9)
    monkeypatch.setattr(lm_scoring, "SWEEPS", 1)
    likelihood = lambda own: (lambda m: lm_scoring.f(m).sum() - lm_scoring.f(m.sum(0)).sum() - lm_scoring.f(m.sum(1)).sum())(lm_scoring.class_pairs(df, own, classes)[:classes, :classes])
    start = np.arange(k) % classes
    assert likelihood(lm_scoring.clustered(df, k, classes)) > likelihood(start)
    # a part's words move as if all others stood still
    both, got = lm_scoring.class_pairs(df, start, classes)[:classes, :classes], lm_scoring.swept(df, start, lm_scoring.class_pairs(df, start, classes)[:classes, :classes])
    for part in range(3):
        members = np.arange(part, k, 3)
        mine, fixed = start[members], np.setdiff1d(np.arange(k), members)
        right, left = np.zeros((len(members), classes)), np.zeros((len(members), classes))
        for i, w in enumerate(members):
            np.add.at(right[i], start[fixed], pairs[w, fixed])
            np.add.at(left[i], start[fixed], pairs[fixed, w])
        inner = pairs[np.ix_(members, members)]
        a, b = np.nonzero(inner)
        lm_scoring.sweep(mine, both.copy(), (a, b, inner[a, b].astype(float)), right, left)
        assert (got[members] == mine).all()


def test_language_model_score_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CLUSTERED", 8)
    monkeypatch.setattr(lm_scoring, "CLASSES", 3)
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghij") + str(int(rng.expovariate(0.5))) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, "never seen", "A1 a1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    plain = lm_scoring.word_classes

    def spy(*args):
        classed, classes = plain(*args)
        rows = classed.collect()
        seen.update({r.word: (r.c, r.g) for r in rows})
        return spark.createDataFrame(rows, classed.schema), classes

    monkeypatch.setattr(lm_scoring, "word_classes", spy)
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs, F.col("doc_id") % 3 != 0).collect()}
    name = lambda w: int(lm_scoring.Words(w, lower=True).grams(1)[0])
    split = {i: (t or "").lower().split() for i, t in enumerate(texts)}
    count = Counter(w for i, ws in split.items() if i % 3 for w in ws)
    assert {name(w): c for w, c in count.items()} == {h: c for h, (c, _) in seen.items()}
    classes = lm_scoring.vocabulary_size(len(count) + 1)[1]
    rare, edge = classes, classes + 1
    mass = Counter()
    for w, c in count.items():
        mass[seen[name(w)][1]] += 0.5 if c == 1 else c
    spread = lambda w: [(edge, 1.0)] if w is None else [(seen[name(w)][1], 0.5), (rare, 0.5)] if count[w] == 1 else [(seen[name(w)][1], 1.0)]
    n = np.zeros((edge + 1, edge + 1))
    for i, ws in split.items():
        if i % 3:
            for a, b in zip([None, *ws], [*ws, None], strict=True):
                for x, p in spread(a):
                    for y, q in spread(b):
                        n[x, y] += p * q
    single = (n.sum(0) + 1) / (n.sum() + len(n))
    kinds = np.maximum((n > 0).sum(1), 1)[:, None]
    p = (n + kinds * single) / (n.sum(1)[:, None] + kinds)
    once = sum(c == 1 for c in count.values())
    for i, ws in split.items():
        g = [edge, *(seen[name(w)][1] if w in count else rare for w in ws), edge]
        emit = sum(math.log10((0.5 if count[w] == 1 else count[w]) / mass[seen[name(w)][1]]) if w in count else -math.log10(once + 1) for w in ws)
        assert math.isclose(got[i], emit + sum(math.log10(p[x, y]) for x, y in zip(g, g[1:], strict=False)), abs_tol=1e-9)
    assert np.allclose(p.sum(1), 1)


def test_bpe(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    t = tokenizers.Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.bpe_digests(docs, path, with_ids=True).collect()}
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        x = got[r[0]]
        assert x.ids == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == sha(np.array(ids, "<u4").tobytes()) and x.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False).encode())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, f in queries.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_repeated_rows_and_null_ids(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (2, text + " more"), (None, None)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name, f in queries.QUERIES.items():
        if name != "op8_ann":
            assert f(spark, str(tmp_path)).count() == len(rows), name


def test_words_beyond_the_clustered_have_classes_of_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CLUSTERED", 4)
    monkeypatch.setattr(lm_scoring, "CLASSES", 4)
    rows = [(i, " ".join(f"a n{(i + j) % 90} b v{(i + j) % 90}" for j in range(3))) for i in range(90)]
    rows += [(900 + i, f"a n{i} b") for i in range(90)] + [(2000 + i, f"a v{i} b") for i in range(90)]
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 900).collect()}
    assert all(got[900 + i] > got[2000 + i] + 0.1 for i in range(90))


def whole_texts():
    """Public notices as they stand in files: wrapped, in comments, as headings, as tags."""
    comment = lambda t: "\n".join(f" * {x}".rstrip() for x in t.split("\n"))
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nLesser General Public License for more details.\n"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\n"
    gpl3 = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n"
    agpl = "This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your\noption) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT\nANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS\nFOR A PARTICULAR PURPOSE.\n"
    free = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n"
    return [
        (lgpl, "<209><11>", "LGPL-2.1-or-later"), (comment(lgpl), "<209><11>", "LGPL-2.1-or-later"), (mpl, "<37><39>", "MPL-2.0"), ("/*\n" + comment(mpl) + "\n */", "<37><39>", "MPL-2.0"),
        (isc, "<24>", "ISC"), (gpl3, "<26>", "GPL-3.0-only"), (agpl, "<213><11>", "AGPL-3.0-or-later"), (free, "<42><43>", "Unlicense"),
        ("// SPDX-License-Identifier: Apache-2.0\nint x;", "<101>", "Apache-2.0"), ("# SPDX-License-Identifier: GPL-3.0-or-later\n\nx = 1", "<105>", "GPL-3.0-or-later"),
        ("MIT License\n\nCopyright (c) 2020 A", "<55>", ""), ("a licence to print money", "", ""),
    ]


def test_license_in_wrapped_text(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n'
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details.\n"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n *\n * 1. Redistributions of source code must retain the above copyright notice, this\n *    list of conditions and the following disclaimer.\n * 3. Neither the name of the copyright holder nor the names of its\n *    contributors may be used to endorse or promote products derived from\n *    this software without specific prior written permission.\n"
    apache = '/* Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n * Unless required by law */'
    cases = [(mit, "<3><4>", "MIT"), (gpl, "<205><11>", "GPL-3.0-or-later"), (bsd, "<15><16><17>", "BSD-3-Clause"), (apache, "<301><7><8>", "Apache-2.0")]
    cases += whole_texts()
    cases += [("This project is licensed under the MIT License.", "<300>", "MIT"), ("Released under the MIT License; see the file", "<300>", "MIT"), ("This project is not licensed under the MIT License.", "", "")]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in license_scan.license_scan(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_license_by_consuming_rules(spark):
    """Names in their slots, grants with and without later versions, choices, expressions: exactly the licences that are named."""
    head = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    name = "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    grant = "{} is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, {}.\n"
    cases = [
        (head + name.format("the copyright holder"), "BSD-3-Clause"), (head + name.format("Acme Inc."), "BSD-3-Clause"), (head + name.format("the University of California, Berkeley"), "BSD-3-Clause"), (head, "BSD-2-Clause"),
        (head + name.format("Acme") + "\n" + head, "BSD-2-Clause,BSD-3-Clause"),
        (grant.format("Foo", "either version 3 of the License, or\n(at your option) any later version"), "GPL-3.0-or-later"), (grant.format("The Foo program", "version 2 of the License"), "GPL-2.0-only"), (grant.format("This program", "either version 2 of the License, or (at your option) any later version"), "GPL-2.0-or-later"),
        ("This work is licensed under the GNU General Public License version 3.", "GPL-3.0-only"), ("Foo is released under the GNU General Public License v3", "GPL-3.0-only"), ("Licensed under GPLv2 or later.", "GPL-2.0-or-later"),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"), ("// SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "BSD-3-Clause,GPL-2.0-only"), ("SPDX-License-Identifier: Foo-1.0", ""), ("Licensed under the Foo License, version 9.", ""), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert [(cases[i][0], got[i].licenses) for i in range(len(cases))] == cases
    assert [got[i].unknown for i in (15, 16)] == [["Foo-1.0"], ["licensed under the foo license version 9"]] and all(not got[i].unknown for i in range(15))


def test_license_in_a_text_of_megabytes(spark):
    text = "some words of no licence at all.\n" * 60_000 + "\nReleased under the MIT License.\n"
    docs = spark.createDataFrame([(1, text), (None, None), (1, ""), (1, "MIT License")], "doc_id long, text string").withColumn("unknown", F.lit(1)).withColumn("_m", F.lit("x"))
    assert sorted(r.licenses for r in license_scan.license_scan(docs).collect()) == ["", "", "", "MIT"]

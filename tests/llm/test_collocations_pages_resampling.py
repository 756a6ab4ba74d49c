"""Operators 11 to 13 against brute force, and their defined cases."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lattiq.llm import collocations, html_extraction, resampling

LOW = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

# ---- 11 ----------------------------------------------------------------------------------


def collocations_by_hand(rows, least, report, cover=80):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", LOW(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for lang in n:
        rows = []
        for (of, p), a in candidates.items():
            if of != lang or any(100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), b in candidates.items() if o == lang and len(q) > len(p)):
                continue
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:report])]
    return sorted(out)


def words_of_chance(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "ünd", "a", "日本", "x-y", "z\x00q", "(b)", "of"]
    texts = [(rng.choice(["en", "de", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]
    return texts + [("en", None), ("en", ""), (None, " .,; "), ("fr", "only these four words")] + texts[:5]


@pytest.mark.parametrize("block", [40, 10**6])
def test_collocations(spark, block, monkeypatch):
    monkeypatch.setattr(collocations, "PASS_ROWS", block)  # several passes, or one
    rows = words_of_chance(3, 60)
    df = spark.createDataFrame([(None if i % 7 == 0 else i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, block string, n int").repartition(3)
    got = collocations.collocations(df, least=4, report=25, block_words=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase"))
    assert sorted(map(tuple, got.collect())) == collocations_by_hand(rows, 4, 25)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")).collect() == []


def test_collocations_of_a_long_text(spark):
    text = "alpha beta gamma delta. " * 60_000  # megabytes, all in one row
    got = [tuple(r) for r in collocations.collocations(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).collect()]
    assert got == [("en", 1, "alpha beta gamma delta", 60_000, 60_000, 60_000, 240_000, 1_000_000)]


# ---- 12 ----------------------------------------------------------------------------------


def extracted(spark, pages):
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    rows = html_extraction.extract(df).collect()
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(pages)
    return {r.page_id: r.text for r in rows}


def test_article_without_what_stands_around(spark):
    inside = "<header><h1>A  title</h1><p>by me</p></header><p>One &amp; two&nbsp;three<br>four</p><div class='share'>Share</div><ul><li>x<li>y</ul><p>Fig&#x41; &copy &am <b>bold</b>ly"
    page = f"<html><head><title>T</title><script>if (a < b) document.write('<p>no</p>')</script></head><body class='nav-open'><header>Site</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><!-- <p>gone</p> --><main><article>{inside}</article><section id=comments><article><p>First!</p></article></section></main><aside>Side</aside><form><input value='<p>'>Search</form><div id='ad_1'>Buy</div><footer>&copy; us</footer>"
    assert extracted(spark, [(1, "http://h/1", page)]) == {1: "A title\n\nOne & two three four\n\nx\n\ny\n\nFigA © &am boldly"}


def test_template_without_names(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    want, pages = {}, []
    for i in range(40):
        body = [text(30) for _ in range(rng.randrange(1, 6))]
        want[i] = "\n\n".join(body)
        links = "".join(f"<a href='/{word()}'>{word()}</a> " for _ in range(5))
        extra = "<div>Seen on our pages since 1999</div>" if i % 2 else ""
        pages.append((i, f"https://User@Site.example:80/{i}", f"<div><div>Welcome to the site</div><div>{links}</div></div><div><div>{''.join(f'<p>{b}</p>' for b in body)}</div></div>{extra}<div>All rights reserved.</div>"))
    got = extracted(spark, pages)
    assert {k: v.replace("\n\nSeen on our pages since 1999", "") for k, v in got.items()} == want


def test_copies_are_one_witness(spark):
    page = "<article><h1>Same</h1><p>The same text on all of these pages.</p></article><footer>f</footer>"
    assert set(extracted(spark, [(i, "http://a.b/x", page) for i in range(50)]).values()) == {"Same\n\nThe same text on all of these pages."}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep down" + "</div>" * 10
    pages = [(1, None, "<p>no host</p>"), (1, "no url", "<p>again 1"), (2, "http://h", None), (3, "http://h", ""), (4, "http://h", "plain < text & more"), (5, "http://h/5", deep), (6, "http://h/6", "<p>open <a href='x>y</p>"), (None, "http://h", "<p>" + "long text " * 200_000)]
    rows = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = sorted((r.page_id or 0, r.text[:20]) for r in rows)
    assert got[1:] == [(1, "again 1"), (1, "no host"), (2, ""), (3, ""), (4, "plain < text & more"), (5, "deep down"), (6, got[-1][1])]
    assert next(r.n_chars for r in rows if r.page_id is None) == 1_999_999
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_trees_are_matched_by_the_largest_mapping():
    def count(a, b, x=0, y=0):  # the definition, without tables
        if a.labels[x] != b.labels[y]:
            return 0

        def pairs(us, vs):
            if not us or not vs:
                return 0
            return max(pairs(us[1:], vs), pairs(us, vs[1:]), count(a, b, us[0], vs[0]) + pairs(us[1:], vs[1:]))

        return 1 + pairs(a.children[x], b.children[y])

    rng = random.Random(9)
    for _ in range(60):
        trees = []
        for _ in range(2):
            n = rng.randrange(1, 9)
            labels, parents = ["r"] + [rng.choice("pq") for _ in range(n)], [-1] + [rng.randrange(0, i + 1) for i in range(n)]
            trees.append(html_extraction.Tree(f"[{labels}, {parents}]".replace("'", '"')))
        a, b = trees
        to = html_extraction.matching(a, b)
        assert len(to) == count(a, b)
        assert all(a.labels[u] == b.labels[v] and (not v or to[b.parents[v]] == a.parents[u]) for v, u in to.items())


def test_long_lists_of_children_are_matched_best():
    n = 400  # 160,000 pairs of children; an early partner of the wrong kind would take all others' partners away
    flat = lambda labels: html_extraction.Tree(json.dumps([["r", *labels], [-1, *[0] * len(labels)]]))
    a, b = flat([*["p", "q"] * (n // 2), "h"]), flat(["h", *["p", "q"] * (n // 2)])
    to = html_extraction.matching(a, b)
    assert len(to) == n + 1 and all(a.labels[u] == b.labels[v] for v, u in to.items())
    kept = [v for v in sorted(to) if v]
    assert [to[v] for v in kept] == sorted(to[v] for v in kept)


def test_templates_of_many_skeletons(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "MERGE", 3)
    pages = [(i, "http://h/", f"<div class='k{chr(97 + i % 20)}'><p>t{i}</p></div><div><p>body {i} " + "word " * 20 + "</p></div>") for i in range(40)]
    got = extracted(spark, pages)
    assert all(f"body {i}" in got[i] for i in range(40))


# ---- 13 ----------------------------------------------------------------------------------


def features_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOW(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for i in range(len(w)) for k in (1, 2) if i + k <= len(w)]


def resampled_by_hand(rows, target, percent=25):
    docs = [(k, *features_by_hand(t)) for k, t in rows]
    s = collections.Counter(b for d in docs for b in d[2])
    t = collections.Counter(b for x in target for b in features_by_hand(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000)))) for b in range(10_000)]
    out = []
    for key, n, f in docs:
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    size = percent * len(able) // 100
    place = {id(r): i + 1 for i, r in enumerate(able[:size])}
    return sorted((tuple(r[:4]) + (place.get(id(r)),) for r in out), key=str)


@pytest.mark.parametrize("stream", [50, 1 << 20])
def test_resampling(spark, monkeypatch, stream):
    monkeypatch.setattr(resampling, "STREAM", stream)
    rng = random.Random(8)
    vocabulary = ["The", "of", "naïve", "日本", "a1", "x-y", "q_", "é", "w" * 1500, "Zz"] + [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    rows += [(None, rows[5][1]), (None, rows[6][1]), (7, rows[7][1]), (7, rows[7][1]), (200, None), (201, ""), (202, " -- "), (203, "word " * 300_000)]
    target = [" ".join(rng.choice(vocabulary[:40]) for _ in range(30)) for _ in range(9)] + [None, ""]
    docs = spark.createDataFrame([(k, t, 1, "s") for k, t in rows], "doc_id long, text string, bucket int, score string").repartition(3)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    found = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=str)
    assert found == resampled_by_hand(rows, target)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    got = resampling.resample(spark.createDataFrame([(1, "w " * 30)] * 4, "doc_id long, text string"), none).collect()
    assert sorted((r.rank or 9, r.doc_id) for r in got) == [(1, 1), (9, 1), (9, 1), (9, 1)]

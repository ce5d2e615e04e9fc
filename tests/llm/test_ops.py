"""Each operator against a plain version of its contract, and its defined cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest_llm import CLASHING, SCHEMA, make
from pyspark.sql import functions as F

from leadspark.llm import bpe, components, decontaminate, exchange, language_model, licenses, minhash, quality_rules, resampling, suffix_dedup, toxicity, url_filter

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(t):
    return (t or "").translate(LOWER)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- 1 -----------------------------------------------------------------------------------------------------------------


def test_license_base(spark, corpus):
    extra = ["Licensed under the MIT license.", "Apache License, Version 2.0 / apache license version 2", "CC BY-NC 4.0, under the mit-license", "xunder the mit license", None]
    texts = corpus[:20] + extra
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = by_id(licenses.scan(make(spark, texts)))
    for i, t in enumerate(texts):
        w = ALNUM.findall(low(t))
        places = [(k, v) for p, v in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in places})))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


@pytest.mark.parametrize(("text", "labels"), [
    ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3"}), ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}), ("released under the Apache License, Version 2.0", {"apache-2"}),
    ("under the GNU General Public License", {"gpl"}), ("licensed under the GPL", {"gpl"}), ("under the BSD license", {"bsd"}), ("under the Apache License", {"apache"}), ("creativecommons.org/licenses/by-nc/4.0", {"cc-by-nc"}), ("opensource.org/licenses/MIT", {"mit"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files", {"mit"}), ("Redistribution and use in source and binary forms, with or without modification", {"bsd"}),
    ("not released under the MIT License", set()), ("It isn't licensed under the Apache License, Version 2.0.", set()), ("This is not advice. Released under the MIT License", {"mit"}), ("not only under the MIT License", {"mit"}), ("GNU Lesser General Public License", {"lgpl"}),
    ("Creative Commons Attribution-NonCommercial-ShareAlike", {"cc-by-nc-sa"}), ("the BSD 3-Clause license", {"bsd-3"}), ("All rights reserved.", {"proprietary"}), ("permit licensee", set()), ("MIT License and MPL 2.0: Mozilla Public License 2.0", {"mit", "mpl-2"}),
])
def test_license_rules(text, labels):
    assert {d[4] for d in licenses.detect(text)} == labels


def test_license_suppression():
    assert len(licenses.rules()) > 300
    a, b, c = (0, 20, 10, 0.5, "short"), (0, 30, 40, 0.9, "long"), (25, 40, 10, 0.5, "beside")
    assert licenses.resolve([a, b, c]) == [b, c]
    assert licenses.resolve([(0, 5, 1, 0.1, "x"), (0, 5, 2, 0.1, "y")]) == [(0, 5, 2, 0.1, "y")]
    assert len({s[0] for s in licenses.SIGNATURES}) > 5 and all(0 < s[1] <= 1 for s in licenses.SIGNATURES)


def test_license_suppression_is_as_told():
    rng = np.random.default_rng(12)
    for _ in range(200):
        found = [(a := int(rng.integers(0, 40)), a + int(rng.integers(1, 15)), int(rng.integers(1, 5)), 0.5, str(rng.choice(list("xyz")))) for _ in range(int(rng.integers(0, 25)))]
        kept = []
        for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[4])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert licenses.resolve(found) == sorted(kept)


def test_license_prefilter_loses_nothing(corpus):
    """All rules without the keywords' gate, over texts made of the rules' own words."""
    rng = np.random.default_rng(13)
    parts = [*WRAPPED, "the", "under", "license", "not", "GPL", "MIT", "BSD", "Apache", "v2", "version 3", "\n", "of", "CC-BY", "opensource.org/licenses/isc", "gnu.org/licenses/gpl-3.0.html", "neither the name of X may be used to endorse or promote products derived from this software", "SPDX-License-Identifier: ISC", "LGPL", "public domain"]
    for _ in range(300):
        t = " ".join(str(x) for x in rng.choice(parts, int(rng.integers(1, 12))))
        assert licenses.detect(t) == licenses.detect(t, gated=False), t
    for t in corpus[:30]:
        assert licenses.detect(t) == licenses.detect(t, gated=False)


def test_license_long_texts():
    import time

    began = time.process_time()
    text = "cc by nc MIT License " * 50_000
    found = licenses.detect(text)
    places, _ = licenses.base_places(licenses.alnum_words(text))
    assert len(found) == 100_000 and places[-1] == 5 * 49_999 and time.process_time() - began < 12


WRAPPED = [
    "MIT No Attribution License", "GNU General Public License, version 2", "GNU Lesser General Public License v2.1", "Common Development and Distribution License", "Common Public License", "do what the fuck you want to public license",
    "Creative Commons Zero", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution Share Alike", "Creative Commons Attribution No Derivatives", "Creative Commons Attribution Non Commercial", "Creative Commons Attribution Non Commercial Share Alike",
    "Creative Commons Attribution NonCommercial NoDerivs", "SIL Open Font License", "European Union Public License", "Python Software Foundation License", "Academic Free License", "Open Software License", "Open Data Commons Open Database License", "GNU Free Documentation License",
    "Server Side Public License", "Business Source License", "Universal Permissive License", "All rights reserved", "Public Domain Dedication", "dedicated to the public domain", "BSD 3-Clause License", "CC BY NC SA", "Licensed under the GNU General Public License version 3",
]


def test_license_wraps():
    assert {k for _, _, names in licenses.FAMILIES for _, k in names if " " in k} <= {k for t in WRAPPED for r in licenses.rules() if (k := r.keyword) in t.lower()}
    for t in WRAPPED:
        whole = [d[2:] for d in licenses.detect(t)]
        assert whole, t
        for gap in ("\n", "  ", "\r\n\t", "\u00a0"):
            wrapped = "see " + t.replace(" ", gap) + "."
            found = licenses.detect(wrapped)
            assert [d[2:] for d in found] == whole, wrapped
            assert all(not wrapped[a:b][0].isspace() and b <= len(wrapped) for a, b, *_ in found)


# --- 2 -----------------------------------------------------------------------------------------------------------------


def judged(text, items, window=13):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(str(i))
    w = ALNUM.findall(low(text))
    hit, found = [0] * len(w), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                found |= windows[tuple(w[k : k + n])]
                hit[k : k + n] = [1] * n
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)


@pytest.mark.parametrize("block_words", [200_000, 5])
def test_decontamination(spark, corpus, block_words):
    items = [(10, "a b c d e f g h i j k l m n o p"), (9, "a b c d e f g h i j k l m"), (2, "only three words"), (3, None), (4, "!!"), (10, "z " * 14), (11, "b c d e f g h i j k l m n o"), (12, "three")]
    full = "A b, c d e f g h i j k l m n o p"
    texts = corpus[:10] + [full, full + " pad" * 400, "x only three words y", "a b c d e f g h i j k l", "z " * 30, full + " " + full, None, "ONLY THREE words only three words"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.digest(decontaminate.scan(make(spark, texts), bench, block_words=block_words)))
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:] == judged(t, items), t
    kept = decontaminate.clean(make(spark, texts), bench)
    assert kept.columns == SCHEMA_NAMES and {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not judged(t, items)[-1]}
    assert not any(r.contaminated for r in decontaminate.scan(make(spark, texts), bench.limit(0)).collect())


@pytest.mark.parametrize("block_words", [200_000, 3])
def test_decontamination_spans(spark, block_words):
    run = "a b c d e f g h i j k l m n o p"
    items = spark.createDataFrame([(1, run), (2, "two words")], "item_id long, text string")
    pad = " ".join(f"p{i}" for i in range(40))
    texts = [f"Start, {run.upper()}! end {pad}", pad, run + " x", f"{pad} two words {pad}", None, "", f"{run}\n{pad} é ({run}) {pad}"]
    got = by_id(decontaminate.without_spans(make(spark, texts), items, block_words=block_words))
    assert {i: r.text for i, r in got.items()} == {0: f"Start, ! end {pad}", 1: pad, 3: texts[3], 4: None, 5: "", 6: f"\n{pad} é () {pad}"}
    assert got[0].lang == "en" and decontaminate.without_spans(make(spark, texts), items).columns == SCHEMA_NAMES
    short = by_id(decontaminate.without_spans(make(spark, texts), items, least_words=2, most_coverage=1.0, block_words=block_words))
    assert short[3].text == f"{pad}  {pad}" and short[2].text == " x"


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.mark.parametrize("block_words", [200_000, 2])
def test_decontamination_by_items_without_id(spark, block_words):
    named = [(1, "a b c d e f g h i j k l m n"), (2, "one more item")]
    nameless = ["p q r s t u v w x y z aa bb cc", "only three words", None, "one more item"]
    bench = spark.createDataFrame(named + [(None, t) for t in nameless], "item_id long, text string")
    texts = ["x p q r s t u v w x y z aa bb cc x", "only three words", "a b c d e f g h i j k l m only three words", "one more item", "p q r s t u v w x y z aa", None]
    got = by_id(decontaminate.digest(decontaminate.scan(make(spark, texts), bench, block_words=block_words)))
    for i, t in enumerate(texts):
        marks, names = judged(t, named + [(f"nameless {k}", x) for k, x in enumerate(nameless)]), judged(t, named)
        assert tuple(got[i])[1:] == (*marks[:2], *names[2:4], marks[4]), t
    assert [got[i].contaminated for i in range(6)] == [True, True, True, True, False, False] and got[0].n_items == 0
    assert {r.doc_id for r in decontaminate.clean(make(spark, texts), bench).collect()} == {4, 5}


def test_suffix_automaton_against_all_windows():
    rng = np.random.default_rng(4)
    for _ in range(60):
        items = [(str(i), " ".join(rng.choice(list("abcd"), rng.integers(0, 12)))) for i in range(4)]
        text = " ".join(rng.choice(list("abcde"), rng.integers(0, 40)))
        a = decontaminate.SuffixAutomaton([(i, t.encode().split()) for i, t in items], 4)
        mask, found = a.hits(text.encode().split())
        n, hit, count, digest, _ = judged(text, items, 4)
        assert (int(mask.sum()), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()) == (hit, count, digest)


# --- 3 -----------------------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def real():
    v = bpe.tokenizer(PATH, public_tokenizers.PATTERN).v
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.rank, special_tokens={})


def test_bpe_query(spark, corpus, odd, real):
    rows = by_id(bpe.encode(make(spark, corpus).unionByName(odd.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1000)), PATH, public_tokenizers.PATTERN, with_ids=True))
    texts = dict(enumerate(corpus)) | {r.doc_id + 1000: r.text for r in odd.filter("doc_id is not null").collect()}
    for i, t in texts.items():
        ids = real.encode_ordinary(t or "")
        r = rows[i]
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_append_and_edit(real):
    v, rng = bpe.tokenizer(PATH, public_tokenizers.PATTERN).v, np.random.default_rng(1)
    for _ in range(300):
        data = bytes(rng.choice(list(b"aeinrst th\xc3\xa9"), rng.integers(0, 80)).tolist())
        cut = int(rng.integers(0, len(data) + 1))
        e = bpe.PrefixEncoder(v, data[:cut]).append(data[cut:])
        assert e.ids() == real._encode_single_piece(data) if data else e.ids() == []
        i = int(rng.integers(0, len(data) + 1))
        e.replace(i, min(len(data), i + 3), b"the")
        assert e.ids() == real._encode_single_piece(e.data)


def test_bpe_edit_stays_near(real):
    v, rng = bpe.tokenizer(PATH, public_tokenizers.PATTERN).v, np.random.default_rng(5)
    data = bytes(rng.choice(list(b"aeinrst th"), 5000).tolist())
    for at in (0, 100, 2500, 4990):
        e = bpe.PrefixEncoder(v, data).replace(at, at + 4, b"ing")
        assert e.ids() == real._encode_single_piece(e.data) == bpe.PrefixEncoder(v, e.data).ids() and e.last == bpe.PrefixEncoder(v, e.data).last
        assert e.reencoded < 500


def test_bpe_long_texts_and_small_tables(real, monkeypatch):
    monkeypatch.setattr(bpe.Tokenizer, "CHUNK", 40)
    t = bpe.Tokenizer(PATH, public_tokenizers.PATTERN)
    t.pieces.most = 30
    texts = ["one two three " * 50, None, "", "y" * 200, "it's 12 words  and\n\nmore é日本 " * 9, "one two"]
    got = collections.defaultdict(list)
    for i, ids in t.encoded(texts):
        got[i] += ids
    assert [got[i] for i in range(len(texts))] == [real.encode_ordinary(x or "") for x in texts]
    assert len(t.pieces.young) <= 30 and t.decode(got[4]).decode() == texts[4]


# --- 4 -----------------------------------------------------------------------------------------------------------------


def removed(texts, length=100):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[i] = (len(b), sum(cover), sum(c and (not k or not cover[k - 1]) for k, c in enumerate(cover)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("pack_bytes", "most_runs", "fan_in"), [(3_000_000, 16_384, 100), (3000, 16_384, 100), (3000, 2, 3), (1000, 1, 100)])
def test_suffix_dedup(spark, corpus, pack_bytes, most_runs, fan_in):
    got = by_id(suffix_dedup.repeats(make(spark, corpus), pack_bytes=pack_bytes, most_runs=most_runs, fan_in=fan_in))
    assert {i: tuple(r)[1:] for i, r in got.items()} == removed(corpus)
    assert sum(r.n_removed for r in got.values()) > 3000


def test_suffix_block_without_alignment():
    rng = np.random.default_rng(3)
    for _ in range(20):
        s = bytes(rng.choice(list(b"ab"), 260).tolist())
        s = s + s[40:240] + b"c" * int(rng.integers(0, 130)) + s[: int(rng.integers(100, 200))]
        n = len(s) - 99
        at = np.arange(n)
        late = suffix_dedup.later(suffix_dedup.SuffixBlock(np.frombuffer(s, np.uint8)), at, np.zeros(n, np.int64), np.zeros(n, np.int64), at)
        seen, expected = set(), []
        for i in range(n):
            expected.append(s[i : i + 100] in seen)
            seen.add(s[i : i + 100])
        assert late.tolist() == expected


def test_suffix_dedup_texts(spark):
    a = " ".join(f"é{i * i}" for i in range(60))
    out = by_id(suffix_dedup.deduplicated(make(spark, [a, "y" + a[3:], None, "z"])))
    assert out[0].text == a and out[1].text == "y" and out[1].n_chars == 1 and (out[2].text, out[3].text) == ("", "z") and out[1].lang == "en"
    same = spark.createDataFrame([(1, a), (1, a), (0, a + "q")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.repeats(same).collect()) == [(0, 0), (1, len(a.encode())), (1, len(a.encode()))]
    alone = spark.createDataFrame([(1, a), (1, a)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.repeats(alone).collect()] == [0, 0]  # the same document and place


# --- 5 -----------------------------------------------------------------------------------------------------------------


def test_quality_base(spark, corpus):
    texts = corpus + ["a b c d e a b c d e", "a a a a a a a a a a a a", "x\ny\nx\n\n \n x\n", "## $$ a|b <c>", "w " * 30 + "end", " lead and trail ", None, "a b c d e f a b c d e f g a b c d e"]
    got = by_id(quality_rules.judge(make(spark, texts)))
    for i, t in enumerate(texts):
        w = SPACE.findall(t or "")
        wins = collections.defaultdict(list)
        for k in range(len(w) - 4):
            wins[tuple(w[k : k + 5])].append(k)
        cover = {x for v in wins.values() if len(v) > 1 for k in v for x in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        r = got[i]
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)), t
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_divergence(spark):
    plain = [" ".join(["the", "of", "and", "to", "word"] * 20 + [f"w{i}{k}" for k in range(40)]) for i in range(30)]
    got = by_id(quality_rules.judge(make(spark, plain + [" ".join(f"%%{k}$$#" for k in range(80)), "short #$%"])))
    assert got[30].class_distance > quality_rules.MOST_CLASS_DISTANCE and not got[30].kept
    r = spark.range(1).select(quality_rules.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))), quality_rules.js_distance(F.array(F.lit(2.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(1.0))), quality_rules.js_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert r[:] == (1.0, 0.0, 0.0)
    assert "Python" not in quality_rules.judge(make(spark, plain))._jdf.queryExecution().toString()


# --- 6 -----------------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net/en", "http://x.net", "http://x.net/", "https://shop.example.com/de/", "https://notexample.com/de/", "https://a.org/fr/x", "ftp://b.org/FR/", "no scheme", None, "http://a.net/b://c"]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, [(i, u, None) for i, u in enumerate(urls)])).collect()}
    assert [(got[i].host, got[i].path, got[i]["rule"], got[i].verdict) for i in range(len(urls))] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/en", "net/", "block"), ("x.net", "", None, "block"), ("x.net", "/", "net/", "block"),
        ("shop.example.com", "/de/", "example.com/de/", "block"), ("notexample.com", "/de/", None, "allow"), ("a.org", "/fr/x", "org/fr/", "allow"), ("b.org", "/FR/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "/b://c", "net/", "block"),
    ]


def test_url_redirect_classes(spark):
    link = '<link href="{}" rel="canonical">'.format
    refresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [(1, "http://a.com/", link("http://blocked.net/x")), (2, "http://b.com/", refresh("http://a.com/")), (3, "http://c.com/", link("http://b.com/")), (4, "http://d.com/", link("http://good.org/fr/")), (5, "http://e.com/", link("http://d.com/") + refresh("http://bad.net/")), (6, "http://www.c.com/?utm_source=x#y", None), (7, "http://f.com/", link("/relative")), (8, "http://c.com", None)]
    got = {r.page_id: r.verdict for r in url_filter.judge(pages(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "block"}
    more = spark.createDataFrame([("http://f.com/", "http://x.net/"), (None, "http://y.net/")], "source string, target string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages(spark, rows), redirects=more).collect()}[7] == "block"
    assert url_filter.judge(pages(spark, rows).limit(0)).count() == 0
    assert "Python" not in url_filter.judge(pages(spark, rows))._jdf.queryExecution().toString()


def test_url_pages_without_scheme_join_nothing(spark):
    link = '<link href="{}" rel="canonical">'.format
    rows = [(1, "plain one", link("http://bad.net/")), (2, "plain two", link("http://other.com/")), (3, "http://other.com/", None), (4, "/local", link("http://good.org/fr/")), (5, "http://still.com/", None)]
    got = {r.page_id: (r.verdict, r.aliased) for r in url_filter.judge(pages(spark, rows)).collect()}
    assert got == {i: ("allow", False) for i in range(1, 6)}
    more = spark.createDataFrame([("nowhere", "http://bad.net/"), ("elsewhere", "http://other.com/"), ("http://still.com/", "nothing"), ("http://bad.net/", "nothing")], "source string, target string")
    assert {r.page_id: (r.verdict, r.aliased) for r in url_filter.judge(pages(spark, rows), redirects=more).collect()} == got


def test_url_relative_links(spark):
    from urllib.parse import urljoin

    targets = ["/de/x", "//bad.net/x", "x", "./x", "../x", "../../../x/", "x/..", ".", "a/./b/../c?q=1#f", "?q=2", "#f", "", "http://b.net/?u", "/login?next=http://x.net/", "/a/b/../../c", "x?u=../y", "mailto:a@b.net"]
    urls = ["http://h.com", "http://h.com/", "https://h.com:8080/a/b/c?d=e/f#g", "http://h.com/a/b/", "http://h.com?q=/x/y"]
    df = spark.createDataFrame([(u, t) for u in urls for t in targets], "url string, target string")
    got = df.select("url", "target", url_filter.resolved(F.col("target"), F.col("url")).alias("to"), url_filter.alias_key(url_filter.resolved(F.col("target"), F.col("url"))).alias("node")).collect()
    wanted = {(u, t): None if t.startswith("mailto") else urljoin(u, t) for u in urls for t in targets}
    nodes = {r.url: r.node for r in spark.createDataFrame([(w,) for w in {*wanted.values()} - {None}], "url string").select("url", url_filter.alias_key(F.col("url")).alias("node")).collect()}
    for r in got:
        w = wanted[r.url, r.target]
        assert r.to is None if w is None else r.node == nodes[w], (r, w)
    link = '<link rel="canonical" href="{}">'.format
    refresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [(1, "http://a.example.com/", refresh("/de/x")), (2, "http://b.com/", link("//bad.net/x")), (3, "http://www.example.com/de", link("de/x")), (4, "http://c.com/p/q", refresh("../r")), (5, "http://c.com/r", link("//bad.net/y")), (6, "http://d.com/", '<base href="//bad.net/s/">' + link("t")), (7, "http://e.com/", link("t"))]
    assert {r.page_id: (r.verdict, r.aliased) for r in url_filter.judge(pages(spark, rows)).collect()} == {**{i: ("block", True) for i in range(1, 7)}, 7: ("allow", False)}
    assert "Python" not in url_filter.judge(pages(spark, rows))._jdf.queryExecution().toString()


def test_url_odd_rows(spark):
    far = "http://far.net/" + "x" * 200_000
    rows = [(1, far, None), (2, None, None), (None, "http://a.org/fr/", ""), (3, "://", "<link rel=canonical href=''>"), (4, "http://b.com/", f'<link rel="canonical" href="{far}">'), (4, "http://b.com/", None), (5, "", "<meta http-equiv=refresh content='0'>"), (6, "http://b.com", "x")]
    plain = pages(spark, rows)
    crowded = plain.withColumns({c: F.lit(f"x{c}") for c in [*CLASHING, "host", "path", "rule", "fit", "class", "component", "base", "target", "action", "a", "b", "inherited"]})
    got = [sorted(map(str, url_filter.judge(d).collect())) for d in (plain, crowded)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    told = {(r.page_id, r.verdict) for r in url_filter.judge(plain).collect()}
    assert told == {(1, "block"), (2, "allow"), (None, "allow"), (3, "allow"), (4, "block"), (5, "allow"), (6, "block")}
    tie = [("block", "a.com", "/x"), ("allow", "a.com", "/x")]
    for rules in (tie, tie[::-1]):
        assert url_filter.judge(pages(spark, [(1, "http://a.com/x", None)]), rules).first().verdict == "allow"


def test_components(spark):
    rng = np.random.default_rng(2)
    for edges in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51)], [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(50)], [(1, 1)], []):
        up = {x: x for e in edges for x in e}
        for _ in range(len(up)):
            for a, b in edges:
                m = min(up[a], up[b])
                up[a] = up[b] = m
        expected = {k: v for k, v in up.items() if any(k in e and e[0] != e[1] for e in edges)}
        df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
        assert {r.node: r.component for r in components.connected(df).collect()} == expected


# --- 7 -----------------------------------------------------------------------------------------------------------------


def plain_model(texts, order, add=0.1, prior=100.0):
    """p(word | history) straight from the formula; texts: lists of words with the end."""
    grams = collections.Counter(tuple(seq[i - n + 1 : i + 1]) for t in texts for seq in [[None, *t]] for i in range(1, len(seq)) for n in range(1, min(order, i + 1) + 1))
    after = collections.Counter()
    for g, c in grams.items():
        after[g[:-1]] += c
    n, v = after[()], sum(len(g) == 1 for g in grams)

    def p(h, w):
        if not h:
            return (grams[(w,)] + add) / (n + add * (v + 1)) if n else 1.0
        return (grams[(*h, w)] + prior * p(h[1:], w)) / (after[h] + prior)

    return lambda t: sum(math.log10(p(tuple([None, *t][max(0, i - order + 2) : i + 1]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize(("order", "pack_bytes", "fan_in"), [(2, 3_000_000, None), (2, 2000, None), (2, 2000, 3), (1, 2000, 4), (3, 4000, None), (3, 900, 2)])
def test_language_model(spark, corpus, order, pack_bytes, fan_in):
    got = by_id(language_model.scores(make(spark, corpus), order=order, pack_bytes=pack_bytes, fan_in=fan_in))
    tokens = [[*low(t).encode().split(), b""] for t in corpus]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(corpus))]
    training = [t for t, h in zip(tokens, held, strict=True) if not h]
    c = collections.Counter(w for t in training for w in t)
    n, v = sum(c.values()), len(c)
    score = plain_model(training, order)
    for i, (t, h) in enumerate(zip(tokens, held, strict=True)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, score(t), rel_tol=1e-9), (i, r.score, score(t))


def test_automaton_sums_to_one():
    texts = ["a b a c", "a b b", "c", "a b", "zz"]
    for order in (1, 2, 3):
        g = language_model.Grams(texts, np.array([True, True, True, False, False]), order)
        m = language_model.BackoffAutomaton(g, [np.concatenate((c[1:2], c[1:])) if n == 0 else c for n, c in enumerate(g.counts)], int(g.counts[0][1:].sum()), int((g.counts[0][1:] > 0).sum()))
        for state in {0, m.start, *m.target, *m.root_next}:
            total = 0.0
            for w in range(1, m.kinds):
                s, weight = state, 0.0
                while s and (a := m.arc.get(s * m.kinds + w)) is None:
                    weight, s = weight + m.fail_weight[s], m.fail[s]
                total += 10 ** (weight + (m.weight[a] if s else m.root_weight[w]))
            assert math.isclose(total, 1.0, rel_tol=1e-9)  # zz stands for all words unseen


@pytest.mark.parametrize("fan_in", [100, 3, 2])
def test_exchange(spark, fan_in):
    """Totals of keys against plain sums; a key that every pack has, and packs met over several levels."""
    rng = np.random.default_rng(3)
    packs = {int(i * 7 + (i % 3 << 32)): {int(k): int(v) for k, v in zip(rng.integers(0, 60, 25).astype(np.uint64) * np.uint64(1 << 57 | 12345), rng.integers(0, 400, 25), strict=True)} | {5: 1} for i in range(23)}
    level = exchange.Exchange.of(len(packs), 600, most=50, fan_in=fan_in)
    assert (level.cells == 1) == (fan_in > 23)

    def arrays(d):
        keys = np.array(sorted(d), np.uint64)
        return keys, keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7), np.array([d[int(k)] for k in keys])

    rows = [(r["cell"], r["unit"], r["keys"], r["counts"]) for u, d in packs.items() for b in level.messages(u, *arrays(d)) for r in b.to_pylist()]
    told = exchange.totals(spark.createDataFrame(rows, "cell long, unit long, keys binary, counts binary"), level, fan_in=fan_in).collect()
    whole = collections.Counter()
    for d in packs.values():
        whole.update(d)
    for u, d in packs.items():
        keys, deal, _ = arrays(d)
        assert level.totals_of(keys, deal, {r.family: bytes(r.data) for r in told if r.unit == u}).tolist() == [whole[int(k)] for k in keys]
    assert (sum(r.kinds for r in told), sum(r.total for r in told)) == (sum(v > 0 for v in whole.values()), sum(whole.values()))
    assert max(collections.Counter(r.unit for r in told).values()) <= level.families


# --- 8 -----------------------------------------------------------------------------------------------------------------


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_matcher_is_levenshtein():
    rng = np.random.default_rng(8)
    terms = [("idiot", False), ("moron", False), ("disgusting", False), ("bad", False), ("chlla", True), ("worthles", True)]
    m = toxicity.Matcher(terms)
    for _ in range(4000):
        t = list(terms[rng.integers(len(terms))][0])
        for _ in range(rng.integers(0, 4)):
            i = int(rng.integers(0, len(t) + 1))
            t = [t[:i] + t[i + 1 :], t[:i] + ["x"] + t[i:], t[:i] + ["q"] + t[i + 1 :]][rng.integers(3)]
        w = "".join(t) + ("zzz" if rng.random() < 0.3 else "")
        best = min(((min(distance(w[:k], s) for k in range(len(w) + 1)) if stem else distance(w, s)) for s, stem in terms for _ in [0] if (min(distance(w[:k], s) for k in range(len(w) + 1)) if stem else distance(w, s)) <= toxicity.edits_allowed(s, stem)), default=None) if w else None
        got = m.match(w)
        assert (got and got[1]) == best, w


def toxic_set(spark, n=400):
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("aeioubdlmnrst"), rng.integers(3, 8))) for _ in range(400)]
    bad = ["blarghest", "snorfler", "gruntkin"]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(vocabulary, 60))
        y = int(i % 5 == 0)
        if y:
            for b in rng.choice(bad, 2):
                w.insert(int(rng.integers(0, 60)), str(b))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, y))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), vocabulary


def test_toxicity(spark, odd):
    docs, labels, vocabulary = toxic_set(spark)
    got = toxicity.judged(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    model = toxicity.learn(docs, labels)
    assert {"blarghest", "snorfler", "gruntkin"} <= {t for t, _ in model.terms}
    misspelt = make(spark, [" ".join(vocabulary[:40]) + " blargest snorfller you gruntkn you blarghst", " ".join(vocabulary[:40])])
    a, b = (toxicity.score(misspelt, model).orderBy("doc_id").collect()[i] for i in (0, 1))
    assert a.n_matches == 4 and a.score > b.score
    x, hits = toxicity.features('he said "you blarghest" and left', toxicity.Matcher([("blarghest", False)]), frozenset())
    assert hits == [("blarghest", 0, 0, True)] and x[2] > 0
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 320
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}


def test_toxicity_of_misspelt_inflections(spark):
    rng = np.random.default_rng(16)
    vocabulary = ["".join(rng.choice(list("aeioubdlmnrst"), rng.integers(3, 8))) for _ in range(400)]
    bad = ["zorpling", "zorpster", "zorpheads"]
    rows = []
    for i in range(600):
        w = list(rng.choice(vocabulary, 60))
        if i % 5 == 0:
            w.insert(int(rng.integers(0, 60)), bad[i // 5 % 3])  # one each, so that the stem gathers more texts than any word
        rows.append(" ".join(w))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], LABELS)
    model = toxicity.learn(make(spark, rows), labels)
    assert any(stem and "zorpling".startswith(t) for t, stem in model.terms)
    m = toxicity.Matcher(model.terms)
    whole = m.match("zorpling")
    assert m.terms[whole[0]][1] and whole[1] == 0 and {m.match(w)[0] for w in [*bad, "zorpish"]} == {whole[0]}  # all count for the stem
    for word, edits in (("zrpling", 1), ("sorpling", 1), ("zoprheads", 2), ("xzorpster", 1)):
        assert m.match(word) == (whole[0], edits), word
    assert m.match("zrpish") is None
    hits = toxicity.score(make(spark, ["one zrpling two", "one zrpish two"]), model).orderBy("doc_id").collect()
    assert [r.n_matches for r in hits] == [1, 0] and hits[0].score > hits[1].score


def test_lexicon_keeps_covered_words():
    terms = toxicity.lexicon(["zorp*", "zorpling", "other", "zorps", "zorpli*", "othe*", "zorp"])
    assert terms == [("zorp", True), ("other", False), ("zorpling", False), ("zorps", False)]


# --- 9 -----------------------------------------------------------------------------------------------------------------


def classes(texts, size, least):
    def shingle(t):
        w = low(t).encode().split()
        return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [shingle(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("size", "least", "group_rows"), [(3, 85, 4096), (5, 80, 4096), (3, 85, 4), (3, 85, 9)])
def test_near_duplicates(spark, corpus, size, least, group_rows):
    got = minhash.near_duplicates(make(spark, corpus), size=size, least=least, group_rows=group_rows, slots=7 if least == 85 else 5)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == classes(corpus, size, least)


def test_documents_of_several_texts(spark):
    a = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (1, other), (2, a + " x"), (3, other + " y"), (4, "quite another text that stands alone here"), (5, other), (0, "z z z"), (6, "z z z"), (6, a), (None, a), (7, "lone words of the eighth"), (7, "more lone words here of the eighth")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for group_rows in (4096, 3):
        got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, size=3, least=85, group_rows=group_rows).collect() if r.doc_id is not None)
        assert got == sorted((i, c := 0 if i in (0, 1, 2, 3, 5, 6) else i, i == c) for i, _ in rows if i is not None)


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        a, b = pool[:200], pool[100:]
        s = minhash.signatures(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2, 64)
        errors.append((s[0] == s[1]).mean() - 1 / 3)
        assert (s < np.uint64(64 << 40)).all()
    assert abs(np.mean(errors)) < 0.02
    one = minhash.signatures(np.array([5], np.uint64), np.array([0]), 1, 189)
    assert len(np.unique(one >> np.uint64(40))) == 189  # one element gives each slot a step of its own


def test_representatives(spark, corpus):
    docs = make(spark, corpus)
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in classes(corpus, 5, 80).items() if v[2]}


# --- 10 ----------------------------------------------------------------------------------------------------------------


def test_resampling(spark):
    rng = np.random.default_rng(5)
    good = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(60)]
    bad = ["".join(rng.choice(list("uvwxyz"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(good if i % 2 else bad, 50)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    rows = by_id(resampling.select(make(spark, texts), labels, share=0.4))
    assert sum(r.selected for r in rows.values()) == 80 and all(i % 2 for i, r in rows.items() if r.selected)
    again = by_id(resampling.select(make(spark, texts).repartition(7), labels, share=0.4))
    assert {i for i, r in rows.items() if r.selected} == {i for i, r in again.items() if r.selected}
    top = sorted(rows.values(), key=lambda r: -r.gumbel_key)[:80]
    assert {r.doc_id for r in top} == {i for i, r in rows.items() if r.selected}
    assert all(r.log_weight == 0 for r in resampling.select(make(spark, texts), labels.limit(0)).collect())


def test_kth_largest(spark):
    rng = np.random.default_rng(9)
    for values in (rng.normal(size=500).tolist(), [1.0] * 300, [0.0, 1e-300, 5.0] * 50):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "key double, id long")
        ranked = sorted(((v, i) for i, v in enumerate(values)), key=lambda r: (-r[0], r[1]))
        for k in (1, 7, len(values) - 1):
            assert resampling.kth_largest(df, k, bins=5, few=10) == ranked[k - 1]
        assert resampling.kth_largest(df, len(values)) is None
    ids = [(1 << 60) + i for i in range(40)] + [-(1 << 61), 7, 7, 7] * 3
    ranked = sorted(ids)
    df = spark.createDataFrame([(2.0, i) for i in ids] + [(1.0, 3)], "key double, id long")
    for k in (1, 5, 11, 13, 14, 30, len(ids)):
        assert resampling.kth_largest(df, k, bins=4, few=3) == (2.0, ranked[k - 1]), k


def test_resampling_weights(spark, corpus):
    """The models counted anew: n-grams as tokens, their buckets by the operator's hash, all else plainly."""
    texts = [*corpus, None, "", "One, two! three"]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(0, len(texts), 2)], LABELS)
    rows = by_id(resampling.select(make(spark, texts), labels, share=0.5, buckets=97))
    hashes = resampling.WordHashes()

    def buckets(t):
        tokens = re.findall(r"[a-z0-9\x80-\U0010ffff]+|[^a-z0-9\x80-\U0010ffff\s]+", low(t), re.ASCII)
        h = [int(x) for x in hashes.of([w.encode() for w in tokens])]
        pairs = [int(resampling.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
        return [x % 97 for x in h + pairs]

    raw, target = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        raw.update(buckets(t))
        if i % 6 == 0:
            target.update(buckets(t))
    r, g = sum(raw.values()), sum(target.values())
    for i, t in enumerate(texts):
        wanted = sum(math.log((target[b] + 1) / (g + 97)) - math.log((raw[b] + 1) / (r + 97)) for b in buckets(t))
        assert rows[i].n_grams == len(buckets(t)) and math.isclose(rows[i].log_weight, wanted, rel_tol=1e-9, abs_tol=1e-9), t
    best = sorted(rows.values(), key=lambda x: (-x.gumbel_key, x.doc_id))[: math.ceil(0.5 * len(texts))]
    assert {x.doc_id for x in best} == {i for i, x in rows.items() if x.selected}


# --- defined cases of all ----------------------------------------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int"


def operators(spark):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 1), (6, 1, 0), (None, 1, 1), (8, None, None), (4, 1, 1)], LABELS)
    bench = spark.createDataFrame([(1, "same text here again"), (None, "x"), (2, None)], "item_id long, text string")
    return {
        "licenses": licenses.scan,
        "decontaminate": lambda d: decontaminate.scan(d, bench),
        "bpe": lambda d: bpe.encode(d, PATH, public_tokenizers.PATTERN),
        "suffix_dedup": suffix_dedup.repeats,
        "quality_rules": quality_rules.judge,
        "language_model": language_model.scores,
        "toxicity": lambda d: toxicity.judged(d, labels),
        "minhash": minhash.near_duplicates,
        "resampling": lambda d: resampling.select(d, labels),
        "decontaminate.clean": lambda d: decontaminate.clean(d, bench),
        "decontaminate.blocks": lambda d: decontaminate.without_spans(d, bench, least_words=2, most_coverage=1.0, block_words=1),
        "toxicity.clean": lambda d: toxicity.clean(d, toxicity.learn(d, labels)),
        "suffix_dedup.deduplicated": suffix_dedup.deduplicated,
        "minhash.representatives": minhash.representatives,
    }


NAMES = ["licenses", "decontaminate", "bpe", "suffix_dedup", "quality_rules", "language_model", "toxicity", "minhash", "resampling", "decontaminate.clean", "decontaminate.blocks", "toxicity.clean", "suffix_dedup.deduplicated", "minhash.representatives"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, clashing, name):
    run = operators(spark)[name]
    plain, crowded = run(odd), run(clashing)
    if "." in name:
        assert plain.columns == odd.columns and crowded.columns == odd.columns + CLASHING
    else:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in plain.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
        assert plain.columns == crowded.columns
    columns = [c for c in plain.columns if c not in ("detections", "hit_spans")]
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, crowded.select(columns).collect()))
    assert run(odd.limit(0)).count() == 0


def test_whole_pieces_are_prefix_encodings():
    v, rng = bpe.tokenizer(PATH, public_tokenizers.PATTERN).v, np.random.default_rng(2)
    for _ in range(300):
        data = bytes(rng.choice(list(b"aeinrst hg\xc3\xa9\xff"), rng.integers(1, 60)).tolist())
        assert list(v.encode_piece(data)) == bpe.PrefixEncoder(v, data).ids()

"""Every training-data operator on odd rows, against brute force where there is one."""

import collections
import hashlib
import json
import math
import random
import re
import zlib
from pathlib import Path

import pytest
from emberflow.llm import exact_dedup, html_extract, language_id, license_scan, line_dedup, lm_score, ngram_join, sentencepiece_codec, token_counts
from emberflow.llm.decontaminate import decontaminate
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RND = random.Random(3)
VOCABULARY = ["alpha", "Beta", "gamma", "Délta", "épsilon", "zeta9", "eta", "日本", "iota", "kappa"] + [f"w{i}" for i in range(300)]


def prose(n, rnd=RND):
    return " ".join(rnd.choices(VOCABULARY, k=n))


LONG = prose(40_000)
BASE = [prose(120) for _ in range(4)]
TEXTS = [None, "", "  ", "!!! ...", "A", "one two", BASE[0], BASE[0].upper(), BASE[0], BASE[1], BASE[1] + " tail", "head " + BASE[1], BASE[2], BASE[3], LONG, LONG + " x", "日" * 5000, "<|endoftext|> hi", "a\x1cb", None]
#: Identifiers with a null and a repeated row.
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, BASE[2]), (9, BASE[1]), (None, None)]
CLASH = "id bigint, norm string, sha string, n bigint, text_sha256 string, body string, n_words bigint, language string, k string, n_lines bigint, h bigint"


@pytest.fixture(scope="module")
def docs(spark):
    """The rows with columns whose names the operators use themselves, and a hot group of copies."""
    hot = [(1000 + i, "the same line again") for i in range(200)]
    rows = [(i, t, "en" if i is not None and i % 2 else None, None) for i, t in ROWS + hot]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)
    return df.withColumns({c.split()[0]: F.lit(1).cast(c.split()[1]) for c in CLASH.split(", ")})


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(docs):
    return docs.where("false")


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(docs, plain, keep):
    got = exact_dedup.exact_dedup(docs, keep=keep, partitions=7).collect()
    groups = collections.defaultdict(list)
    for i, t in plain:
        groups[(t or "").translate(LOWER)].append(i)
    assert len(got) == len(plain)
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert set(by) == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    for t, ids in groups.items():
        rows = by[hashlib.sha256(t.encode()).hexdigest()]
        some = [i for i in ids if i is not None]
        assert {r.group_size for r in rows} == {len(ids)}
        assert {r.keep_id for r in rows} == {(max if keep == "max" else min)(some) if some else None}
        assert sum(r.kept for r in rows) == 1
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0


def test_token_counts(docs, plain):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    want = collections.Counter((i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False))) for i, t in plain)
    got = token_counts.token_counts(docs, path)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert got.where("over_limit <> (n_tokens > 2048)").count() == 0
    assert token_counts.token_counts(empty(docs), path).count() == 0
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    some = docs.where("doc_id < 12")
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(some, path).collect()) == sorted((i, len(sp.encode(t or ""))) for i, t in plain if i is not None and i < 12)


def test_token_counts_of_random_chunks():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    model = Tokenizer.from_file(path)
    alphabet = ["a", "B", "'s", "é", "é", "́", " ", "\n", " ", "　", "\u0085", "\x1d", "9", "!?", "Σ", "ß", "<|endoftext|>", "日", "​"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(3000)]
    want = [len(model.encode(t, add_special_tokens=False)) for t in texts]
    known = {}
    assert token_counts.count_tokens(texts, path, known) == want
    assert token_counts.count_tokens(texts, path, known) == want


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_decontaminate(spark, docs, plain):
    bench = [(1, " ".join(words(BASE[3])[5:40])), (2, "one two"), (3, None), (4, ""), (5, "never seen words here at all"), (6, BASE[1][:300]), (10, "one two"), (2, "one two")]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    brute = {}
    for i, t in set(plain):
        w, hit, ids = words(t), set(), set()
        for k, b in bench:
            v = words(b)
            n = min(10, len(v))
            spots = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in spots:
                    hit.update(range(p, p + n))
                    ids.add(str(k))
        brute[(i, t)] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    for block in (1 << 20, 150):  # in one pass, and in several
        got = decontaminate(docs, items, carry=["doc_id", "text"], block_bytes=block).collect()
        assert {((r.doc_id, r.text), (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got} == set(brute.items())
    longest = decontaminate(docs.where("doc_id = 13"), items).first().matches
    assert [(m.item_id, m.n_words) for m in longest] == [("1", 35)]
    assert decontaminate(docs, items.where("false")).where("contaminated").count() == 0
    assert decontaminate(empty(docs), items).count() == 0


def brute_lines(rows, least):
    """The text without the runs, from a window to the end of the next one at most, that any earlier place holds."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    lines, windows = {}, {}
    for d in order:
        own = [(p, x.strip(" "), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for p, x in enumerate(d[1].split("\n"))]
        lines[d] = [x for x in own if x[2]]
    for d in order:
        for i in range(len(lines[d])):
            n = 0
            for j in range(i, len(lines[d])):
                n += lines[d][j][2]
                if n >= least:
                    windows[(d, i)] = j
                    break

    def reach(d, i):
        if i + 1 >= len(lines[d]):
            return windows[(d, i)]
        return windows.get((d, i + 1), len(lines[d]) - 1)

    first, gone = {}, collections.defaultdict(set)
    for (d, i), j in windows.items():
        for e in range(j, max(j, reach(d, i)) + 1):
            run = tuple(x[1] for x in lines[d][i : e + 1])
            if first.setdefault(run, (d, i)) != (d, i):
                gone[d].update(range(lines[d][i][0], lines[d][e][0] + 1))
    return {d: "\n".join(x for p, x in enumerate(d[1].split("\n")) if p not in gone[d]) for d in order}


def test_line_dedup(spark):
    rnd = random.Random(11)
    pool = [prose(n, rnd) for n in (1, 2, 3, 5, 8, 12, 20, 30, 55, 60)] * 2 + ["", " "]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 14)))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, rows[6][1]), (200, rows[7][1])]
    df = spark.createDataFrame([*rows, (300, None)], "doc_id bigint, text string").repartition(3).withColumns({"k": F.lit("x"), "own": F.lit(1), "gone": F.lit(2), "lines": F.lit(3), "n_lines": F.lit(9)})
    for least in (10, 50):
        want = brute_lines([r for r in rows if r[1] is not None], least)
        out = line_dedup.line_dedup(df, min_words=least)
        assert out.columns == ["doc_id", "text", "k", "own", "gone", "lines", "n_lines", "n_deleted"]
        got = out.collect()
        assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(i, want[(i, t)]) for i, t in rows] + [(300, None)])
    assert {(r.k, r.own, r.gone, r.lines) for r in got} == {("x", 1, 2, 3)}
    assert line_dedup.line_dedup(df.where("false")).count() == 0


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize(("block_sets", "split_share"), [(500, 0.5), (4, 0.5), (4, 0.9)])  # whole buckets, those too alike in blocks, and all that split
def test_ngram_join(spark, docs, plain, monkeypatch, block_sets, split_share):
    rnd = random.Random(2)
    near = []
    for b in range(6):
        base = prose(100, rnd).split()
        for i in range(rnd.choice([2, 5, 30])):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(VOCABULARY)
            near.append((5000 + 100 * b + i, " ".join(own)))
    rows = plain + near
    df = docs.select("doc_id", "text", "n", "h").unionByName(spark.createDataFrame(near, "doc_id bigint, text string"), allowMissingColumns=True)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block_sets)
    monkeypatch.setattr(ngram_join, "SPLIT_SHARE", split_share)
    got = ngram_join.ngram_join(df).collect()
    sets = [grams(t) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            s = len(sets[a] & sets[b])
            if s and s >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    assert collections.Counter((r.doc_id, r.n_links) for r in got) == collections.Counter((rows[i][0], links[i]) for i in range(len(rows)))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    want = collections.Counter()
    for ids in groups.values():
        some = [i for i in ids if i is not None]
        for i in ids:
            want[(i, min(some) if some else None, len(ids))] += 1
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert ngram_join.ngram_join(empty(docs)).count() == 0


def test_ngram_join_blocks(spark, monkeypatch):
    """Groups larger than a block are compared block by block, each pair once."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    rnd = random.Random(4)
    base = prose(80, rnd).split()
    rows = [(i, " ".join([f"x{i}", *base])) for i in range(40)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.class_id, r.n_links, r.class_size) for r in got} == {(0, 39, 40)}


def test_overlaps_by_postings_and_products():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 80))).astype(np.uint64) for _ in range(60)]
    got = ngram_join.overlaps(sets)
    for a in range(60):
        for b in range(60):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def lm_brute(rows):
    space = re.compile("[^\x20\x09-\x0D]+")
    toks = [(str("" if i is None else i), space.findall((t or "").translate(LOWER)) + [None]) for i, t in rows]
    rest = [zlib.crc32(i.encode()) % 10 for i, _ in toks]
    uni, bi = collections.Counter(), collections.Counter()
    dev_u, dev_b = collections.Counter(), collections.Counter()
    for (i, w), r in zip(toks, rest, strict=True):
        if r:
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w))
        if r == 9:
            dev_u.update(w)
            dev_b.update(zip(["<s>", *w[:-1]], w))
    uni["<s>"], dev_u["<s>"] = uni[None], dev_u[None]
    size = lambda u: sum(n for k, n in u.items() if k != "<s>")
    kinds = lambda u: sum(n > 0 for k, n in u.items() if k != "<s>")
    bucket = lambda c: min(math.ceil(math.log2(c + 1)), 41)
    a_u, a_b = uni - dev_u, bi - dev_b
    n_a, v_a = size(a_u), kinds(a_u)
    events = []
    for (i, w), r in zip(toks, rest, strict=True):
        if r == 9:
            for c, x in zip(["<s>", *w[:-1]], w):
                events.append((bucket(a_u[c]), a_u[x] / max(n_a, 1), a_b[(c, x)] / max(a_u[c], 1)))
    import numpy as np

    weights = lm_score.learn_weights(np.array([(b, 1, p1, p2) for b, p1, p2 in events]).reshape(-1, 4), 1 / (v_a + 1))
    n, v = size(uni), kinds(uni)
    out = []
    for (i, w), r in zip(toks, rest, strict=True):
        score = sum(math.log10(weights[bucket(uni[c])] @ [bi[(c, x)] / max(uni[c], 1), uni[x] / max(n, 1), 1 / (v + 1)]) for c, x in zip(["<s>", *w[:-1]], w)) if n else 0.0
        out.append((r == 0, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), score))
    return out


def test_lm_score(docs, plain):
    got = sorted(((str(r.doc_id), r.n_tokens), (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in lm_score.lm_score(docs, block_bytes=20_000).collect())
    want = sorted(((str(i), w[1]), w) for (i, _), w in zip(plain, lm_brute(plain), strict=True))
    for (k, g), (k2, w) in zip(got, want, strict=True):
        assert k == k2 and g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] == pytest.approx(w[5], rel=2e-2, abs=1e-6)  # the weights come from binned estimates
    assert lm_score.lm_score(empty(docs)).count() == 0


def test_lm_score_without_training(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    df = spark.createDataFrame([(i, "a b") for i in ids], "doc_id bigint, text string")
    assert {(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.lm_score(df).collect()} == {(True, 0, 0, 0.0, 0.0)}


def speech(letters, n, rnd):
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 8))) for _ in range(n))


def test_language_id(spark, docs):
    rnd = random.Random(6)
    kinds = {"en": "etaoinshr", "de": "enirsäüxß", "fr": "éèaçuqlpê"}
    rows = [(i, speech(kinds[k], 30, rnd), k if i < 300 else None, f"h{i % 3}.example.{k}") for i, k in enumerate(list(kinds) * 200)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, host string")
    model = language_id.fit(train, max_rows=200)
    assert set(model.languages) == {*kinds, "und"}
    out = language_id.identify(train, model, host=F.col("host")).where("lang is null").collect()
    assert sum(r.language == list(kinds)[r.doc_id % 3] for r in out) >= 0.99 * len(out)
    odd = spark.createDataFrame([(1, None, "h0.example.de"), (2, "", None), (3, "12 !!", "x"), (4, "a", "h0.example.en"), (5, "рыба и мясо " * 20, "z")], "doc_id bigint, text string, host string")
    got = {r.doc_id: r for r in language_id.identify(odd.unionByName(train.select("doc_id", "text", "host").where("doc_id > 10")), model, host=F.col("host")).collect()}
    assert [got[i].language for i in (1, 2, 3)] == [None] * 3 and not any(got[i].language_accepted for i in (1, 2, 3, 5))
    assert got[5].language == "und"
    # a text that says nothing follows its host, then its declaration
    hint = train.select("text", "host", F.lit("").alias("said")).unionByName(spark.createDataFrame([("ne", "h0.example.de", ""), ("ne", "other", "de"), ("ne", "other", "en-GB"), ("ne", "other", "tlh")], "text string, host string, said string"))
    got = {(r.host, r.said): r.language for r in language_id.identify(hint, model, host=F.col("host"), declared=F.col("said")).where("text = 'ne'").collect()}
    assert got[("h0.example.de", "")] == "de" and got[("other", "de")] == "de" and got[("other", "en-GB")] == "en"
    clash = language_id.identify(docs, model)
    assert clash.count() == docs.count() and sorted(clash.columns) == sorted({*docs.columns, "language", "language_confidence", "language_accepted"})
    assert language_id.identify(empty(docs), model).count() == 0


def test_language_id_salted_join(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, speech("etaoinshr" if i % 2 else "éèaçuqlpê", 20, rnd), "en" if i % 2 else "fr", f"h{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, host string")
    model = language_id.fit(df)
    a = sorted((r.doc_id, r.language, round(r.language_confidence, 9)) for r in language_id.identify(df, model, host=F.col("host")).collect())
    monkeypatch.setattr(language_id, "BROADCAST_HOSTS", 0)
    b = sorted((r.doc_id, r.language, round(r.language_confidence, 9)) for r in language_id.identify(df, model, host=F.col("host")).collect())
    assert a == b and len(a) == 200


def test_license_scan(spark, docs):
    mit = license_scan.TEXTS["MIT"]
    odd = mit.replace("<year> <copyright holders>", "1999 Someone, Inc.").replace("\n", "\n\n  ").upper().replace("SUBLICENSE", "SUB-LICENSE")
    rows = [(1, odd), (2, mit + "\nMore."), (3, "Intro.\nLicenced under the APACHE licence -- version 2.0\nEnd"), (4, None), (5, ""), (6, "Copyright (c) 2001 X"), (7, license_scan.TEXTS["ISC"]), (8, "copyright matters to us"), (9, odd)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].license_id for i in range(1, 10)] == ["MIT", None, None, None, None, None, "ISC", None, "MIT"]
    assert got[3].notices == ["Apache-2.0"] and got[3].n_notice_lines == 1
    assert got[4].text_digest == got[5].text_digest == got[6].text_digest != got[8].text_digest
    assert license_scan.license_scan(docs).count() == docs.count() and license_scan.license_scan(empty(docs)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Top</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<!-- x --><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>%s<aside>Side</aside><form><p>Search</p></form><section id="comments"><p>First!</p></section><footer>&copy; me</footer>"""


def test_html_extract(spark):
    cases = {
        "<article><h1>A &amp;amp; B</h1><p><b>one<br>two<p>three &#233;\n\t x</p></article>": "A &amp; B\none two\nthree é x",
        "<main><p>kept</p><div class='share'>no</div><p>too</p></main>": "kept\ntoo",
        "<article></article>": "",
        "<article><p>1 < 2 and <i>in</i>line</p><ul><li>a<li>b</ul><pre>c  d</pre></article>": "1 < 2 and inline\na\nb\nc d",
    }
    pages = [(i, f"https://h{i}.example/", PAGE % body) for i, body in enumerate(cases)]
    # without named elements, what differs from the host's other pages is content
    pages += [(100 + i, "http://soup.example/x", f"<body><div>Menu</div><div><p>Story {i}</p><p>Text {i * 7}</p></div><div>Imprint</div></body>") for i in range(6)]
    pages += [(200, "http://x.example", None), (201, None, ""), (202, "rel/path", "plain"), (203, "http://deep.example", "<div>" * 3000 + "deep"), (0, "https://h0.example/", pages[0][2])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({"host": F.lit("q"), "text": F.lit("q"), "body": F.lit(1)})
    for limit in (html_extract.BROADCAST_BYTES, 0):
        got = html_extract.html_extract(df, broadcast_bytes=limit).collect()
        assert len(got) == len(pages)
        by = {r.page_id: r for r in got}
        assert [by[i].text for i in range(len(cases))] == list(cases.values())
        assert [by[100 + i].text for i in range(6)] == [f"Story {i}\nText {i * 7}" for i in range(6)]
        assert [by[i].text for i in (200, 201, 202, 203)] == ["", "", "plain", "deep"]
        assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.html_extract(df.where("false")).count() == 0


def test_tree_matching_is_maximal():
    """Against the plain recursion over all ordered matchings."""

    def brute(a, b):
        x, y = html_extract._groups(a), html_extract._groups(b)
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                same = 0
                if x[i][0] == y[j][0]:
                    same = min(len(x[i][1]), len(y[j][1])) if x[i][0].endswith("*") else brute(x[i][1][0], y[j][1][0])
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + same)
        return 1 + m[-1][-1]

    rnd = random.Random(9)

    def make(d):
        return "".join(f"<{t}>{make(d - 1) if d and rnd.random() < 0.7 else 'x'}</{t}>" for t in rnd.choices(["div", "section", "p", "h2"], k=rnd.randint(1, 4)))

    for _ in range(40):
        a, b = html_extract.parse(make(3)), html_extract.parse(make(3))
        pairs = {}
        assert html_extract.match(a, b, pairs) == brute(a, b) == len(pairs)


def unigram_model(data):
    """The same pieces and scores as a unigram model: field 3 of the trainer's settings is 1."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in sentencepiece_codec._fields(data):
        value += varint(3 << 3) + varint(1) if number == 2 else b""
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_sentencepiece_against_the_library():
    import sentencepiece

    path = sentencepiece_codec.model_path()
    with open(path, "rb") as f:
        model = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(f.read()))
    c, rnd = sentencepiece_codec.codec(path), random.Random(1)
    for _ in range(1500):  # short, as the library adds scores in 32 bits
        t = "".join(rnd.choice(["the", "ing", " ", "Qu", "é", "ß", "word", "an", ".", "er"]) for _ in range(rnd.randint(0, 6)))
        mine, theirs = c.encode(t).tolist(), model.encode(t)
        score = lambda ids: sum(c.scores[i] for i in ids)
        assert mine == theirs or score(mine) > score(theirs), t
    for t in ["日本語 text\n\ttab", "🙂 emoji", "", " ", "a  b ", "\x00", "▁x"]:
        ids = c.encode(t).tolist()
        assert c.decode(ids) == model.decode(ids) == t.replace("▁", " ")
    assert c.decode([c.bytes[0xFF], c.bytes[0x41]]) == model.decode([c.bytes[0xFF], c.bytes[0x41]])


def test_sentencepiece_units_are_whole_viterbi():
    """The best segmentation of a text is that of its units: against brute force over the whole text."""
    c = sentencepiece_codec.codec(sentencepiece_codec.model_path())
    for t in [BASE[0][:200], "  two\n\nlines\t!! 123", "日本 und ▁▁ so"]:
        assert c.encode(t).tolist() == c.encode_unit(c.normalise(t))


def test_sentencepiece_operator(docs, plain):
    path = sentencepiece_codec.model_path()
    out = sentencepiece_codec.encode_texts(docs, path)
    got = out.collect()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got) and len(got) == len(plain)
    back = sentencepiece_codec.decode_ids(out.select("doc_id", "token_ids"), path)
    assert collections.Counter((r.doc_id, r.decoded_text) for r in back.collect()) == collections.Counter((i, t or "") for i, t in plain)
    assert sentencepiece_codec.encode_texts(empty(docs), path).count() == 0


def test_double_array_holds_exactly_its_keys():
    rnd = random.Random(2)
    keys = {bytes(rnd.choices(range(256), k=rnd.randint(1, 6))): i for i in range(2000)}
    trie = sentencepiece_codec.DoubleArray(keys)
    for k, v in keys.items():
        assert (len(k), v) in list(trie.walk(k))
    for _ in range(2000):
        k = bytes(rnd.choices(range(256), k=6))
        assert dict(trie.walk(k)) == {n: keys[k[:n]] for n in range(1, 7) if k[:n] in keys}


def test_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert json.dumps(sorted(found))


def pages_of(spark, bodies):
    rows = [(i, f"http://{host}/{i}", f"<body>{body}</body>") for i, (host, body) in enumerate(bodies)]
    return html_extract.html_extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()


def test_html_near_copies_support_no_template(spark):
    """What near copies share stays; the host's own lines go; trees of any depth are aligned."""
    story = "".join(f"<p>A long sentence number {k} of the story that was printed several times.</p>" for k in range(4))
    text = re.findall("<p>(.*?)</p>", story)
    page = "<div>Menu</div><div><p>Day {}</p>{}</div><div>Imprint</div>"
    bodies = [("copy.example", page.format(i, story)) for i in range(4)] + [("copy.example", page.format(i, f"<p>Own words {i} of another page, number {i * 7}.</p>")) for i in range(4, 12)]
    bodies += [("two.example", page.format(i, story)) for i in range(2)]
    bodies += [("deep.example", "<div>" * 900 + f"<p>Menu</p></div><div><p>Deep story {i}</p>") for i in range(4)]
    got = [r.text for r in pages_of(spark, bodies)]
    assert got[:4] == ["\n".join([f"Day {i}", *text]) for i in range(4)]
    assert got[4:12] == [f"Day {i}\nOwn words {i} of another page, number {i * 7}." for i in range(4, 12)]
    assert all(set(text) <= set(got[i].split("\n")) for i in (12, 13))
    assert got[14:] == [f"Deep story {i}" for i in range(4)]


def test_html_alignment_decides_within_and_beside_articles(spark):
    share = "<p>Tell your friends about us today</p>"
    bodies = [("line.example", f"<div>Menu</div><article><h1>Title {i}</h1>{''.join(f'<p>Words {i} {k} of it</p>' for k in range(1 + i % 3))}{share}</article><div>Now {i}</div>") for i in range(8)]
    bodies += [("beside.example", f"<div>Menu</div><article><p>Teaser {i}</p></article><div><p>The long report number {i} stands beside the teaser</p></div>") for i in range(6)]
    bodies += [("alike.example", f"<article><p>{i}</p><p>{'The same long sentence on all of the pages here. ' * 3}</p></article><p>Day {i}</p>") for i in range(6)]
    bodies += [("alone.example", "<div>Menu and a few words more than the article has</div><article><p>Short</p></article>")]
    got = [r.text for r in pages_of(spark, bodies)]
    assert got[:8] == ["\n".join([f"Title {i}", *(f"Words {i} {k} of it" for k in range(1 + i % 3))]) for i in range(8)]
    assert got[8:14] == [f"Teaser {i}\nThe long report number {i} stands beside the teaser" for i in range(6)]
    assert got[14:20] == [f"{i}\n{'The same long sentence on all of the pages here. ' * 3}".strip() for i in range(6)]
    assert got[20] == "Short"


def test_html_names_are_evidence_only(spark):
    article = "<header class='entry-header'><h1>Head {0}</h1></header><div class='post-header'><p>By me {0}</p></div><p>Words {0} of the text</p><div class='share-buttons'>Share {0}</div>"
    wrappers = ["<div class='content-with-sidebar'>{}</div>", "<div class='has-sidebar'>{}</div>", "<div id='page-with-menu'>{}</div>", "<div class='sidebar'>{}</div>", "<div class='content sidebar-wrapper'>{}<div class='sidebar'>Side</div></div>"]
    bodies = [(f"h{i}.example", w.format(f"<article>{article.format(i)}</article>")) for i, w in enumerate(wrappers)]
    bodies += [("wrap.example", f"<div>Menu</div><div class='ad'>Buy {i}</div><div class='widget'><p>The story number {i} is here</p><p>and has some more {i * 7} words to it</p></div>") for i in range(5)]
    bodies += [("empty.example", f"<div>A menu of many words</div><div class='ad'>Buy {i}</div>") for i in range(5)]
    got = [r.text for r in pages_of(spark, bodies)]
    assert got[:5] == [f"Head {i}\nBy me {i}\nWords {i} of the text" for i in range(5)]
    assert got[5:10] == [f"The story number {i} is here\nand has some more {i * 7} words to it" for i in range(5)]
    assert got[10:] == [""] * 5


def brute_runs(rows, least):
    """The later occurrences of the longest runs, by comparison with all earlier places."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    lines, gone = {}, collections.defaultdict(set)
    for d in order:
        own = [(p, x.strip(" "), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for p, x in enumerate(d[1].split("\n"))]
        lines[d] = [x for x in own if x[2]]
    spots = [(d, i) for d in order for i in range(len(lines[d]))]
    for at, (d, i) in enumerate(spots):
        for e, j in spots[:at]:
            n = size = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n][1] == lines[e][j + n][1]:
                size += lines[d][i + n][2]
                n += 1
            if size >= least:
                gone[d].update(range(lines[d][i][0], lines[d][i + n - 1][0] + 1))
    return {d: "\n".join(x for p, x in enumerate(d[1].split("\n")) if p not in gone[d]) for d in order}


def test_line_dedup_extends_to_the_longest_earlier_run(spark):
    rnd = random.Random(12)
    start, tail = prose(52, rnd), [prose(6, rnd) for _ in range(4)]
    pool = [prose(n, rnd) for n in (2, 5, 8, 12, 20, 30, 55)] + [""]
    rows = [(1, f"{start}\nother words"), (2, "\n".join([start, *tail])), (3, "\n".join([start, *tail[:3], "own end"])), (4, "\n".join([start, tail[0], "x y"]))]
    rows += [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 14)))) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for least in (10, 50):
        want = brute_runs(rows, least)
        got = {(r.doc_id): r.text for r in line_dedup.line_dedup(df, min_words=least).collect()}
        assert got == {i: want[(i, t)] for i, t in rows}
    assert got[3] == "own end" and got[4] == "x y"


def test_decontaminate_in_blocks_keeps_all_rows(spark):
    """Rows that repeat an identifier, or have none, with equally many words."""
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    rows = [(1, a), (1, a), (1, b), (1, " ".join(f"c{i}" for i in range(20))), (None, a), (None, b), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame([(k, " ".join(t.split()[k : k + 12])) for t in (a, b) for k in range(6)], "item_id bigint, text string")
    one, many = (collections.Counter(r[:6] for r in decontaminate(df, items, block_bytes=n).drop("matches").collect()) for n in (1 << 20, 100))
    assert one == many and sum(many.values()) == len(rows)


def test_readme_lists_the_known_licences():
    readme = (Path(license_scan.__file__).parents[2] / "README.md").read_text()
    listed = readme[readme.index("* `op2`") : readme.index("* `op3`")]
    names = {w.rstrip(".") for w in re.split(r"[\s,();]+", listed)}
    assert set(license_scan.NOTICES) | set(license_scan.TEXTS) <= names


def test_language_of_pages_by_markup_and_address(spark):
    """Texts without a known trigram are told by the html element's language, or by the address's suffix."""
    assert "llm_page_language" in language_id.QUERIES
    labelled = [(i, "the cat and the dog went home with us", "en") for i in range(20)] + [(20 + i, "der hund und die katze gehen nach hause", "de") for i in range(20)]
    model = language_id.fit(spark.createDataFrame(labelled, "doc_id bigint, text string, lang string"))
    same = "<html{}><body><p>qqq xxx qqq</p><script>the the the</script></body></html>"
    rows = [(1, "http://a.example/", same.format(" lang='de-AT'")), (2, "http://a.example/", same.format(' lang="en"'))]
    rows += [(100 + i, f"http://h{i}.de/", "<p>der hund und die katze gehen nach hause</p>") for i in range(30)]
    rows += [(200 + i, f"http://h{i}.uk/", "<p>the cat and the dog went home with us</p>") for i in range(30)]
    rows += [(3, "http://new.de/", same.format("")), (4, "http://new.uk/", same.format(""))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.language for r in language_id.identify_pages(df, model).collect()}
    assert len(got) == len(rows) and got[100] == "de" and got[200] == "en"
    assert (got[1], got[2]) == ("de", "en")
    odds = {r.page_id: r.language_confidence for r in language_id.identify_pages(df, model).collect()}
    assert got[3] != got[4] or odds[3] != odds[4]


def test_known_licence_texts_are_found_whole(spark):
    rows = [(i, t.replace("<year>", "2020").replace("<copyright holders>", "Some One").replace("\n\n", "\n  \n").upper()) for i, t in enumerate(license_scan.TEXTS.values())]
    rows += [(100, rows[0][1] + "\nand more"), (101, "my own licence")]
    own = spark.createDataFrame([("Own-1.0", "My own license"), ("None", None)], "license_id string, text string")
    got = {r.doc_id: r.license_id for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id int, text string"), known=license_scan.digests_of(own)).collect()}
    assert got == {**dict(enumerate(license_scan.TEXTS)), 100: None, 101: "Own-1.0"}


def test_long_texts_are_counted_in_bounded_calls(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(7)
    monkeypatch.setattr(token_counts, "PIECE", 50)
    monkeypatch.setattr(token_counts, "CALL", 120)
    monkeypatch.setattr(token_counts, "OFTEN", 10**6)
    texts = ["", " ", "x" * 500, " ".join(f"w{rnd.random()}" for _ in range(400)), "\n".join(prose(3, rnd) for _ in range(200))]
    sizes = []
    real = token_counts._counter(path)
    monkeypatch.setitem(token_counts._loaded, path, (lambda t: sizes.append(sum(map(len, t))) or real[0](t), *real[1:]))
    model = Tokenizer.from_file(path)
    assert token_counts.count_tokens(texts, path, {}) == [len(model.encode(t, add_special_tokens=False)) for t in texts]
    assert max(sizes) <= 500 + 120


def test_near_duplicate_links_of_a_fiftieth_against_all(spark):
    """Recall against brute force: the documents whose identifier 50 divides, against all, on the test table."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_links for r in ngram_join.ngram_join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).collect()}
    sets = {r.doc_id: grams(r.text) for r in rows}
    for i in (i for i in sets if i % 50 == 0):
        near = sum(1 for j, s in sets.items() if j != i and sets[i] and len(s & sets[i]) >= 0.8 * len(s | sets[i]) > 0)
        assert got[i] == near


def test_language_accuracy_on_held_out_rows(spark):
    """Fitted on even identifiers, judged on odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    got = language_id.identify(docs.where("doc_id % 2 = 1"), model, host=F.col("source")).where("language_accepted").select("lang", "language").collect()
    assert len(got) > 300 and sum(r.lang == r.language for r in got) >= 0.97 * len(got)


def test_likelihoods_by_hand():
    """Trigram likelihoods, with each letter trigram looked up by itself."""
    import numpy as np
    import pyarrow as pa
    from emberflow.llm.textkit import text_buffer

    rng = np.random.default_rng(3)
    model = language_id.LanguageModel(("aa", "bb", "und"), rng.normal(size=(language_id.CELLS, 3)))
    texts = ["", "ab", "Abc def", "  a ", "x9y zzz", "naïve Ünï", "a b c"]
    data, off = text_buffer(pa.array(texts))
    like, _ = model.likelihoods(data, off)
    for t, row in zip(texts, like, strict=True):
        raw = bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode())
        letters = [x if 97 <= x <= 122 or x >= 128 else 32 for x in raw]
        want = np.zeros(3)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            if (a, b, c).count(32) < 2:
                k = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
                want += model.logp[(k ^ (k >> 15)) % language_id.CELLS]
        assert np.allclose(row, want)


def test_mixture_weights_by_hand():
    """One round of expectation-maximisation, written out, leaves the learned weights where they are."""
    rnd = random.Random(9)
    cells = [(rnd.randint(0, 6), rnd.randint(1, 400), 10 ** -rnd.uniform(1, 5), 10 ** -rnd.uniform(0, 4)) for _ in range(200)]
    import numpy as np

    floor, prior = 1e-6, 50.0
    learned = lm_score.learn_weights(np.array(cells, float), floor, rounds=3000)
    share, total = collections.defaultdict(lambda: [0.0, 0.0, 0.0]), [0.0, 0.0, 0.0]
    for b, n, p1, p2 in cells:
        parts = [learned[b][0] * p2 * (b > 0), learned[b][1] * p1, learned[b][2] * floor]
        for k in range(3):
            share[b][k] += n * parts[k] / sum(parts)
            total[k] += n * parts[k] / sum(parts)
    for b in range(1, 7):
        for k in range(3):
            want = (share[b][k] + prior * total[k] / sum(total)) / (sum(share[b]) + prior)
            assert math.isclose(learned[b][k], want, rel_tol=1e-3, abs_tol=1e-6)


def test_stages_take_dotted_names_and_no_labels(spark, tmp_path):
    from emberflow.llm import stages

    spark.createDataFrame([(1, "nothing of this")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rnd = random.Random(1)
    rows = [(i, prose(60, rnd), None, "s", 5, i, "t") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` int, `c 0` string")
    for stage in (stages.language_stage, stages.line_stage, stages.near_duplicate_stage, stages.benchmark_stage, stages.encode_stage):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:7] == docs.columns
        assert sorted(r[5] for r in out.collect()) == list(range(6))

"""Operators against brute force, round trips and held-out accuracy."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe, chat, classifier, common, decontaminate, html_extract, ngram_join, pii, quality_rules, substring, url_filter

from ..conftest import SF


def low(text):
    return re.findall(common.WORD, (text or "").translate(common.ASCII_LOWER))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def corpus(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


# 1
def test_chat_folds_events(spark):
    rows = [
        (1, 0, 0, "message", "user", "he"), (1, 0, 1, "delta", None, "llo"), (1, 1, 2, "message", "assistant", "bad"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "go"), (1, 1, 5, "delta", None, "od"),
        (1, 0, 9, "edit", None, "hi"), (1, 2, 6, "message", "user", "gone"), (1, 2, 7, "delete", None, None), (2, 0, 0, "delta", "user", "only"),
    ]
    log = spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = [(r["conv_id"], *chat.read_message(r["rendered"])) for r in chat.render(log).orderBy("conv_id", "turn", "part").collect()]
    assert got == [(1, "user", "hi"), (1, "assistant", "good"), (2, "user", "only")]
    with pytest.raises(Exception, match="unknown kind"):
        chat.render(log.withColumn("kind", F.lit("nonsense"))).collect()


def test_chat_escapes_reversibly():
    rng = random.Random(1)
    parts = ["<|im_start|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "/", "x", "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        role = "".join(rng.choice(["user", "%", "\n", "<", "%25"]) for _ in range(rng.randint(0, 3)))
        piece, start, end = chat.render_message(role, text)
        assert chat.read_message(piece) == (role, text)
        assert not re.search(r"</?s>|\[/?INST\]|<\|im_(?:start|end)\|>", chat.escape(text))
        if start is not None:
            assert chat.unescape(piece[start:end]) == text


# 2
def test_bpe_is_the_library(corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, theirs = bpe.codec(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    pool = [*map(chr, range(0x250)), "\u2028", "\u3000", "\u200b", "\u0301", "\U0001f600", "中", "<|endoftext|>", "'re", "   "]
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text in [*corpus.values(), *made, "a" * 5000]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert list(own.encode(text)) == ids
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


# 3
def brute_components(corpus, k, num, den):
    sets = {}
    for i, t in corpus.items():
        w = low(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            inter = len(sets[i] & sets[j])
            if inter and den * inter >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_join_is_brute_force(documents, corpus, k, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(documents, k, num, 100).collect()}
    assert got == brute_components(corpus, k, num, 100)


@pytest.mark.parametrize("exact", [False, True])
def test_join_of_large_components(spark, monkeypatch, exact):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows, words = [], list(base)
    for i in range(300):  # near copies that drift: neighbours link, ends don't
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rng.choice(base) for _ in range(60))) for i in range(100)]
    other = [f"v{rng.randrange(3000)}" for _ in range(150)]
    for i in range(200):  # a family that is alike, some of it within the threshold, most of it not
        own = list(other)
        for at in rng.sample(range(150), rng.choice([1, 2, 8, 9, 10])):
            own[at] = f"y{rng.randrange(40)}"
        rows.append((2000 + i, " ".join(own)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(dict(rows), 3, 90, 100)
    monkeypatch.setattr(ngram_join, "MOST_SHINGLES", 4000)
    monkeypatch.setattr(ngram_join, "MOST_POINTS", 16)  # so that groups are cut into cells
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(df, 3, 90, 100, exact).collect()}
    assert got == want and 100 < len({c for _, c in want.values()}) < 450


def test_a_large_family_that_is_only_alike_stays_linear(spark, monkeypatch):
    rng = random.Random(4)
    frame, rows = [f"w{i}" for i in range(150)], []
    for i in range(1500):  # half of each text is the same boilerplate
        own = [f"z{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((i, " ".join(frame[:75] + own + frame[75:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = ngram_join.candidates
    monkeypatch.setattr(ngram_join, "MOST_SHINGLES", 1 << 17)
    monkeypatch.setattr(ngram_join, "candidates", lambda *a: seen.append((out := common.written(real(*a), "seen")).count()) or out)
    got = ngram_join.join_components(df, 5, 80, 100)
    assert got.where("component_id <> doc_id").count() == 0
    assert seen and sum(seen) < len(rows)  # not the million pairs of the family


def test_prefixes_route_every_link():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 2**63, n, dtype="u8"))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * rng.uniform(0.85, 1))), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype="u8")]))
        if ngram_join.overlaps(a, b, 90, 100):
            assert set(ngram_join.prefix_keys(a, 90, 100).tolist()) & set(ngram_join.prefix_keys(b, 90, 100).tolist())


def test_tree_finds_all_that_the_bound_allows():
    import numpy as np

    rng = np.random.default_rng(4)
    points = rng.poisson(2, (500, 16)).astype("u1")
    sizes = points.sum(axis=1).astype("i8")
    tree = ngram_join.Tree(points, sizes)
    for i in range(0, 500, 25):
        bound = np.minimum(points, points[i]).sum(axis=1, dtype="i8")
        want = np.flatnonzero((170 * bound >= 70 * (sizes + sizes[i])) & (100 * sizes >= 70 * sizes[i]) & (100 * sizes[i] >= 70 * sizes))
        assert sorted(tree.search(points[i], int(sizes[i]), 70, 100)) == want.tolist()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {v: v for e in edges for v in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for e in edges if e[0] != e[1] for v in e}


# 4
def test_classifier_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = classifier.train(documents, labels.where(~classifier.held_out()))
    rows = classifier.scores(documents, model).join(labels, "doc_id").where(classifier.held_out()).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows) / len(rows) > 0.95


def test_discriminant_is_its_formula():
    import numpy as np

    rng = np.random.default_rng(13)
    d = len(classifier.FEATURES)
    y = (rng.random(400) < 0.6).astype("i8")
    x = rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) + 2.0 * y[:, None] * rng.normal(size=d)
    model = classifier.fit(x, y)
    z = x / (x.std(axis=0) + 1e-3)
    pooled = sum((y == c).sum() * np.cov(z[y == c].T) for c in (0, 1)) / len(y)
    density = []
    for c in (0, 1):
        own = z[y == c]
        trust = 0.85 * len(own) / (len(own) + d)
        cov = trust * np.cov(own.T) + (1 - trust) * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 0.01 * np.eye(d)
        away = z - own.mean(axis=0)
        density.append([-0.5 * (v @ np.linalg.inv(cov) @ v + np.linalg.slogdet(cov)[1]) for v in away])
    assert np.allclose(model.raw(x), np.array(density[1]) - np.array(density[0]), rtol=1e-8, atol=1e-6)
    # The score rises with the difference of the densities.
    order = np.argsort(model.raw(x))
    assert (np.diff(model.score(x)[order]) >= 0).all() and ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9


def test_classifier_learns_from_repeated_rows_once(spark):
    good = [(i, f"a clean line of words number {i} that ends as it should, with a full stop.") for i in range(20)]
    junk = [(100 + i, " ".join(["JUNK!!"] * (5 + i))) for i in range(20)]
    once = spark.createDataFrame(good + junk, "doc_id long, text string")
    many = spark.createDataFrame(good + junk + good[:1] * 500, "doc_id long, text string")
    labels = once.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    a, b = (classifier.train(df, labels) for df in (once, many))
    assert (a.slope, a.offset) == (b.slope, b.offset) and all((x == y).all() for x, y in zip(a.factors, b.factors))


# 5
def test_windows_are_the_cartesian_tree():
    import numpy as np

    rng = np.random.default_rng(6)
    for n, least, most in ((30, 5, 2**62), (200, 46, 2**62), (46, 46, 2**62), (45, 46, 2**62), (500, 10, 2**62), (120, 7, 2**20)):
        h = rng.integers(0, most, (2, n), dtype="u8") << np.uint64(12)
        want = set()
        for f in range(2):
            for i in range(n):  # of equal hashes the leftmost is the least
                a = b = i
                while a > 0 and h[f, a - 1] > h[f, i]:
                    a -= 1
                while b < n - 1 and h[f, b + 1] >= h[f, i]:
                    b += 1
                if b - a + 1 >= least:
                    want.add((f, a, i, b))
        assert set(zip(*(x.tolist() for x in substring.compact_windows(h, least)))) == want


def test_repeated_passages_are_found(spark):
    rng = random.Random(7)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, line = text(55), text(9)
    rows = {i: text(rng.randrange(60, 200)) for i in range(120)}
    for i in range(0, 60):  # one passage in half of the documents
        at = rng.randrange(len(rows[i]))
        rows[i][at:at] = passage
    for i in range(120):  # one short line in all of them
        at = rng.randrange(len(rows[i]))
        if not (i < 60 and " ".join(passage) not in " ".join(rows[i][:at] + line + rows[i][at:])):
            rows[i][at:at] = line
    near = list(passage)
    near[30] = "other"
    rows[200] = text(30) + near + text(30)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.repeated_passages(df).collect()}
    assert {i for i, r in got.items() if r["passages"]} == {*range(60), 200}
    assert {got[i]["class_id"] for i in (*range(60), 200)} == {0}
    for i in range(60):
        words = " ".join(rows[i])
        assert any(" ".join(passage) in " ".join(rows[i][max(0, p["start"]) : p["end"]]) for p in got[i]["passages"]), words


def test_exact_repeats_of_the_corpus(documents, corpus):
    grams = collections.defaultdict(set)
    for i, t in corpus.items():
        w = low(t)
        for j in range(len(w) - 49):
            grams[tuple(w[j : j + 50])].add((i, j))
    got = {r["doc_id"]: r for r in substring.repeated_passages(documents).collect()}
    for found in grams.values():
        if len({i for i, _ in found}) > 1:
            assert len({got[i]["class_id"] for i, _ in found}) == 1
            for i, j in found:
                assert any(p["start"] <= j and j + 50 <= p["end"] for p in got[i]["passages"])
    assert all(bool(r["passages"]) == bool(r["partners"]) for r in got.values())


def test_passages_with_edits(spark):
    rng = random.Random(10)
    text = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    rows, families = {}, 60
    for g in range(families):  # six variants of one passage, each with three edits of its own: a word changed, left out or put in
        passage = text(100)
        for i in range(6):
            own = list(passage)
            for at in rng.sample(range(100), 3):
                own[at : at + rng.randint(0, 1)] = text(rng.randint(0, 1))
            rows[6 * g + i] = text(rng.randrange(40, 80)) + own + text(rng.randrange(40, 80))
    rows |= {1000 + i: text(150) for i in range(60)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.repeated_passages(df).collect()}
    found = [i for i, r in got.items() if r["passages"]]
    assert max(found) < 6 * families and len(found) >= 0.95 * 6 * families
    assert all(got[i]["class_id"] // 6 == i // 6 for i in found)
    # A passage is its document's own: it lies around the variant, within the words that chance adds at its ends.
    assert all(40 <= p["start"] and p["end"] <= len(rows[i]) - 40 for i in found for p in got[i]["passages"])


def test_exact_stretches_of_large_mixed_groups(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    line, rows, places = text(44), {}, {}
    for g in range(200):  # one line in all documents; each two share what stands around it, 50 words together
        before, rest = text(g % 7), text(6 - g % 7)
        for i in (g, 999 - g):
            lead = text(rng.randrange(30, 60))
            rows[i], places[i] = lead + before + line + rest + text(rng.randrange(30, 60)), len(lead)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    pairs = {(r["a"], r["b"]) for r in substring.exact_pairs(df, substring.chained(df)).collect()}
    assert {(g, 999 - g) for g in range(200)} <= pairs
    got = {r["doc_id"]: r for r in substring.repeated_passages(df).collect()}
    for i, r in got.items():
        assert 999 - i in r["partners"] and any(p["start"] <= places[i] and places[i] + 50 <= p["end"] for p in r["passages"])


def test_links_of_a_large_group_are_few_steps_apart(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    passage = text(60)
    df = spark.createDataFrame([(i, " ".join(text(20) + passage + text(20))) for i in range(200)], "doc_id long, text string")
    near = collections.defaultdict(set)
    for r in substring.exact_pairs(df, substring.chained(df)).collect():
        near[r["a"]].add(r["b"])
        near[r["b"]].add(r["a"])
    seen, now, steps = {0}, {0}, 0
    while now := {j for i in now for j in near[i]} - seen:
        seen, steps = seen | now, steps + 1
    assert len(seen) == 200 and steps <= 10  # components() takes rounds by the length of chains


def test_stretches_begin_at_any_run():
    import numpy as np

    # Runs of 20, 4 and 60 tokens, 5 apart: from the first one the share falls below the threshold at the second, whole it doesn't.
    at = np.array([*range(20), *range(32, 36), *range(41, 101)])
    assert substring._joined(at, np.zeros(len(at), "i8")) == [(0, 0, 101, 101)]


def test_short_texts_are_hashed_together(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    some = ["", None, "a", "A b c d", " x\ty z \u00c9\u4e2d w V ", "end", "word " * 3, "y" * 70_000, " ".join(f"W{i}" for i in range(20_000)), "", *("".join(rng.choice("aB \t\n\u00e9") for _ in range(rng.randrange(60))) for _ in range(500))]
    for k in (1, 3, 5):
        rows = []
        for first, own, bounds in common.runs_of_shingles(pa.array(["cut off", *some]).slice(1), k):
            assert first == len(rows)
            rows += [own[x:y].tolist() for x, y in zip(bounds, bounds[1:])]
        assert rows == [common.shingle_hashes(t or "", k).tolist() if len((t or "").split()) >= k else [] for t in some]
    # Windows and grams of texts that follow each other are those of each text alone, whatever the other ones hold.
    many = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(200))) for _ in range(200)]
    calls = []
    monkeypatch.setattr(common, "_word_hashes", lambda *x, f=common._word_hashes: calls.append(1) or f(*x))
    ((_, own, bounds),) = common.runs_of_shingles(pa.array(many), substring.SHINGLE)
    assert len(calls) == 1
    drawn = common.mixed(own + np.arange(2, dtype="u8")[:, None])
    got, grams = set(zip(*(x.tolist() for x in substring.compact_windows(drawn, substring.LEAST, bounds)))), list(zip(*(x.tolist() for x in substring.picked(own, bounds))))
    want, alone = set(), []
    for i, (x, y) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        want |= {(f, a + x, c + x, b + x) for f, a, c, b in zip(*(z.tolist() for z in substring.compact_windows(drawn[:, x:y])))}
        alone += [(i, g) for g in substring.picked(own[x:y], np.array([0, y - x]))[1].tolist()]
    assert got == want and grams == alone and len(grams) > 200


def test_passages_have_their_own_places(spark):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    p, q, own = text(60), text(60), text(300)
    rows = {1: p + q, 2: p + own + q, 3: (twice := text(60)) + text(40) + twice + text(40) + twice, 4: text(20) + twice}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["passages"]] for r in substring.repeated_passages(df).collect()}
    assert got == {1: [(0, 120)], 2: [(0, 60), (360, 420)], 3: [(0, 60), (100, 160), (200, 260)], 4: [(20, 80)]}
    cut = {r["doc_id"]: r["text"].split() for r in substring.without_repeats(df).collect()}
    assert cut[2] == own and cut[4] == rows[4][:20]


# 6
def test_article_text(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert html_extract.extract(r["html"]) == "\n".join(filter(None, blocks))


def test_page_parts_that_are_no_content():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1><ul class="menu"><li><a>x</a></ul></header><div id="sidebar">side text</div>
    <main><article class="post"><header><h1>Title &amp; x</h1><p>by me</p></header><p>First para&nbsp;with   <b>bold</b> text.<p>Second<br>para long enough.
    <div class="advert">Buy!</div><ul><li>One item<li>Two items</ul><form><input><p>mail</p></form><section id="comments"><p>A reader's long remark</p></section><p>Ok.</p></article></main><footer>(c)</footer></body></html>"""
    assert html_extract.extract(page) == "Title & x\nFirst para with bold text.\nSecond para long enough.\nOne item\nTwo items\nOk."
    assert html_extract.extract('<div class="nav">a</div><p>A paragraph of text that goes on.</p><p>x.</p><div class="cookie-notice">We use cookies</div>') == "A paragraph of text that goes on.\nx."


def test_ratios_choose_lines():
    para = "A paragraph of the text that goes on for a while, as they do, before it ends."
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "wxyz")
    page = f"<article><h1><a href='/'>Title</a></h1><p>{para}</p><ul>{links}</ul><p>Ok.</p><p>{para} <a href='/q'>More</a></p></article>"
    assert html_extract.extract(page) == f"Title\n{para}\nOk.\n{para} More"
    # Without an article: from the first to the last line above the cut, link lists left out.
    page = f"<div><p><a href='/'>Home</a></p><p><a href='/b'>Blog</a></p><p>{para}</p><p>Ok.</p><ul>{links}</ul><p>{para}</p></div><div><a href='/c'>Contact</a></div><div><a href='/d'>Imprint</a></div>"
    assert html_extract.extract(page) == f"{para}\nOk.\n{para}"
    # Short paragraphs of an article stay beside a very long one, and in any number.
    short = [f"No {i}." for i in range(30)]
    assert html_extract.extract("<article><p>" + 90 * para + "</p>" + "".join(f"<p><b>{x}</b></p>" for x in short) + "</article>").split("\n")[1:] == short


def test_wrappers_are_no_parts():
    para = "A paragraph of the text that goes on for a while, as they do, before it ends."
    assert html_extract.extract(f'<form id="aspnetForm"><article><p>{para}</p><form><p>mail</p></form></article></form>') == para
    assert html_extract.extract(f'<div class="print-friendly"><div class="share">Share this</div><p>{para}</p><p>Yes.</p></div>') == f"{para}\nYes."
    assert html_extract.extract(f'<div class="search-open"><main><p>{para}</p></main></div><div class="search">Find it</div>') == para
    assert html_extract.extract(f"<p>{para} <a href=/x>see<p>{para}<p>{para}") == f"{para} see\n{para}\n{para}"


def test_other_articles_are_remarks_or_teasers():
    para = "A paragraph of the text that goes on for a while, as they do, before it ends."
    own = f"<article><h1>Title</h1><p>{para}</p><p>{para}</p><p>{para}</p>%s</article>"
    want = "\n".join(["Title", para, para, para])
    teaser = "<article><h2><a href=/next>Read this next</a></h2><p>It is short.</p></article>"
    assert html_extract.extract(own % "" + teaser + teaser) == html_extract.extract(teaser + own % "") == want
    # Short ones without a link are parts of the text, and entries of like lengths are what the page is made of.
    assert html_extract.extract(own % "" + "<article><p>An afterword, short.</p></article>") == want + "\nAn afterword, short."
    assert html_extract.extract(teaser * 3) == "\n".join(["Read this next\nIt is short."] * 3)
    # Remarks stand in articles of their own inside of the article; a wrapper in an article is none.
    assert html_extract.extract(own % "<article><p>A reader's remark.</p></article>" + "<p>x</p>") == want
    assert html_extract.extract("<article>" + own % "" + "</article>") == want


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<span>" * 100_000, "<b>" * 50_000 + "<p>words</p>" * 5000, "<center>" * 50_000 + "<p>words" * 20_000, "<div class=share>" * 50_000 + "x", "</p>" * 100_000, "<header>" * 20_000 + "<p>x" * 20_000, "<article>" * 30_000 + "<li>x" * 20_000):
        began = time.process_time()
        html_extract.extract(page)
        assert time.process_time() - began < 3


# 7
def test_rules_of_urls(spark):
    cases = {"http://EXAMPLE.org/es/1": "example.org/es/", "https://a.example.org/en/12": "example.org/en/1", "https://a.example.org/en/2": "org/", "x://b.com/fr/": "com/fr/", "x://b.com/de/x?y": "com/de/", "x://com/fr/": "com/fr/", "x://org": None, "x://notorg/x": None, "y://a.net/fr/": None, "x://a.org?/x": None}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    assert [r["rule"] for r in url_filter.filter_urls(df).orderBy("page_id").collect()] == list(cases.values())


def test_url_plan_is_native(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    plan = url_filter.filter_urls(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hot_addresses_and_grams(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    hot = spark.range(3000).select((F.col("id") + 10**6).alias("page_id"), F.lit("http://one.hot.example.net/x/1").alias("url"))
    pages = df.unionByName(hot)
    want = sorted(map(str, url_filter.filter_urls(pages).collect()))
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    assert sorted(map(str, url_filter.filter_urls(pages).collect())) == want and len(want) == pages.count()


# 8
def edits_within(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_contamination_is_brute_force(spark, corpus):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Items(items)
    rng, texts = random.Random(8), list(corpus.values())
    for _ in range(60):
        k, text = rng.choice(items)
        x = list(text)
        for _ in range(rng.randint(0, int(0.14 * len(x)))):
            p = rng.randrange(len(x))
            x[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        doc = rng.choice(texts)[:300] + "".join(x) + rng.choice(texts)[:200]
        a, b = (decontaminate.stream(decontaminate.lowered(s).encode())[0].tobytes() for s in (text, doc))
        least, budget = edits_within(a, b), int(index.edits[index.ids.index(k)])
        found = [h for n in index.hits([doc]) for h in index.find(doc) if h[0] == k]
        assert bool(found) == (least <= budget)
        assert not found or min(h[3] for h in found) == least


def test_verbatim_items_are_found(spark, documents, corpus):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(i, r["item_id"]) for r in items.collect() for i, t in corpus.items() if r["text"] in t}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(documents, items).collect()}


def test_repeated_letters_and_long_texts(monkeypatch):
    import resource
    import time

    items = [(1, "a" * 2000), (2, "ab" * 500), (3, "One fine morning the quick brown fox jumped over all the lazy dogs of the village.")]
    index = decontaminate.Items(items)
    began, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = "x1" * 5000 + "a" * 2_000_000
    found = index.find(text)
    assert found[0] == (1, 10_000, 12_000, 0) and len(found) > 900
    assert all(h[0] == 1 and h[2] - h[1] == 2000 and not h[3] for h in found) and all(a[2] <= b[1] for a, b in zip(found, found[1:]))
    assert time.process_time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    # Texts longer than a piece, occurrences across its border included, and multi-byte letters around them.
    monkeypatch.setattr(decontaminate, "PIECE", 1000)
    for lead in (0, 900, 990, 1000, 2500):
        text = "é" * lead + " " + items[2][1].replace("fox", "cat") + " " + "ü" * 300
        assert [text[a:b] for i, a, b, _ in decontaminate.Items(items[2:]).find(text)] == [items[2][1][:-1].replace("fox", "cat")]


def test_repeats_in_items_lose_nothing():
    rng = random.Random(12)
    for _ in range(150):  # items of few letters, so that their q-grams repeat
        item = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) * rng.randint(10, 40)
        item = "".join(c if rng.random() > 0.02 else "c" for c in item)[: rng.randint(40, 120)]
        if len(item) < decontaminate.LEAST_BYTES:
            continue
        x = list(item)
        for _ in range(rng.randint(0, len(x) // 8)):
            p = rng.randrange(len(x))
            x[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        doc = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) + "".join(x) + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 80)))
        index = decontaminate.Items([(7, item)])
        least = edits_within(item.encode(), doc.encode())
        found = index.find(doc)
        assert bool(found) == (least <= int(index.edits[0]))
        assert not found or min(h[3] for h in found) == least


def test_further_blocks_of_items(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.matches(documents, items).collect()))
    kept = {r["doc_id"] for r in decontaminate.decontaminate(documents, items).collect()}
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 2000)
    assert len(list(decontaminate.blocks(items))) > 2
    assert sorted(map(tuple, decontaminate.matches(documents, items).collect())) == want
    assert {r["doc_id"] for r in decontaminate.decontaminate(documents, items).collect()} == kept


# 9
def test_surrogates_keep_type_and_are_distinct():
    assert len({tuple(pii.permuted([a, b, c], [3, 5, 7], b"k", "t")) for a in range(3) for b in range(5) for c in range(7)}) == 105
    rng = random.Random(9)
    cards = {"".join(rng.choice("0123456789") for _ in range(16)) for _ in range(2000)}
    new = {c: pii.surrogate("card", c, "k") for c in cards}
    assert len(set(new.values())) == len(cards) and all(pii.luhn(a) == pii.luhn(b) and a[0] == b[0] for a, b in new.items())
    ips = {f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(2000)}
    assert len({pii.surrogate("ip", x, "k") for x in ips}) == len(ips)
    assert pii.surrogate("ip", "10.1.2.3", "k").startswith("10.") or pii._band(int.from_bytes(bytes(map(int, pii.surrogate("ip", "10.1.2.3", "k").split("."))), "big")) == "private"
    assert re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.example\.com", pii.surrogate("email", "jane.07@mail3.example.com", "k"))
    assert pii.surrogate("email", "Jane@X.com", "k").lower() == pii.surrogate("email", "jane@x.com", "k")
    assert pii.surrogate("phone", "+1 (301) 555-0346", "k") != pii.surrogate("phone", "+1 (301) 555-0346", "other")
    assert re.sub(r"\D", "", pii.surrogate("phone", "+1 (301) 555-0346", "k")) == re.sub(r"\D", "", pii.surrogate("phone", "+1 301-555-0346", "k"))


def test_names_keep_gender_script_and_coreference():
    out, spans = pii.replace("Mr. James Wilson met Mary Smith. Later Wilson said: Иван Петров.", "k")
    words = re.findall(r"\w+", out)
    assert words[1] in pii.FIRST["latin", "m"] and words[4] in pii.FIRST["latin", "f"] and words[2] == words[7] != "Wilson" and words[9] in pii.FIRST["cyrillic", "m"]
    assert [out[a:b] for a, b, _ in spans] and len(spans) == 7
    clean = "The quick fox. Then he left, and she, too. Nothing 12 of 3.5 here 1999-2000."
    assert pii.replace(clean, "k") == (clean, [])


def test_all_entities_go(documents, corpus):
    found = {i: pii.find(t) for i, t in corpus.items()}
    for r in pii.anonymise(documents, "k", spans=True).collect():
        assert len(r["entities"]) == len(found[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        assert not any(v in r["text"] for *_, kind, v in found[r["doc_id"]] if kind not in ("first", "surname"))
        if not found[r["doc_id"]]:
            assert r["text"] == corpus[r["doc_id"]]


def test_collisions_are_drawn_anew(spark, monkeypatch):
    real = pii.surrogate
    df = spark.createDataFrame([("ssn", "111-11-1111"), ("ssn", "222-22-2222"), ("ssn", "333-33-3333")], "kind string, value string")
    monkeypatch.setattr(pii, "surrogate", lambda k, v, key, a=0: ("222-22-2222" if v[0] == "1" else "999-99-9999") if a == 0 else real(k, v, key, a))
    bad = {r["value"]: r["attempt"] for r in pii.collisions(df, "k").collect()}
    assert bad["111-11-1111"] >= 1 and len({"222-22-2222", "333-33-3333"} & set(bad)) == 1


def test_secrets_need_no_digit():
    for value in ("correcthorsebattery", "abcdefghijklmnop"):
        for lead in ("password: ", "api_key = "):
            alone, beside = f"the {lead}{value} stays", f"the {lead}{value} stays, 7 times"
            assert [x[2:] for x in pii.find(alone)] == [x[2:] for x in pii.find(beside)] == [("secret", value)]
            out = pii.replace(alone, "k")[0]
            assert value not in out and pii.replace(beside, "k")[0].startswith(out)
    assert [x[2] for x in pii.find("see " + "abcdef" * 6)] == ["secret"]


def test_crowded_formats_are_settled(spark, monkeypatch):
    full, half = [f"{c}@example.com" for c in "aeiouy"], [f"{c}@example.org" for c in "bcdfghjklm"]
    df = spark.createDataFrame([("email", v) for v in full + half] + [("first", n) for names in pii.FIRST.values() for n in names], "kind string, value string")
    bad = {r["value"]: r["drawn"] for r in pii.collisions(df, "k", 2).collect()}
    assert not set(bad) & set(pii._FIRST)
    new = {v: bad.get(v) or pii.surrogate("email", v, "k") for v in full + half}
    assert len(set(new.values())) == len(new) and all(v != w for v, w in new.items())
    assert {new[v] for v in full} == set(full)  # no room: permuted
    assert not {new[v] for v in half} & set(half) and all(pii.form("email", v) == pii.form("email", w) for v, w in new.items())  # room for all: no entity is met
    docs = spark.createDataFrame([(i, f"write to {v} now") for i, v in enumerate(full + half)], "doc_id long, text string")
    for most in (pii.MOST_BROADCAST, -1):
        monkeypatch.setattr(pii, "MOST_BROADCAST", most)
        got = {r["doc_id"]: r["text"].split()[2] for r in pii.anonymise(docs, "k").collect()}
        assert len(set(got.values())) == 16 and {got[i] for i in range(6)} == set(full) and not {got[i] for i in range(6, 16)} & set(half)


def test_forms_hold_their_surrogates():
    for kind, value in [("email", "jane.07@mail3.example.com"), ("phone", "+1 (301) 555-0346"), ("phone", "+13015550346"), ("card", "4111 1111 1111 1111"), ("ip", "10.1.2.3"), ("ssn", "123-45-6789"), ("secret", "sk-Abc123def456ghi789"), ("secret", "0f" * 16), ("surname", "Wilson"), ("surname", "Петрова")]:
        low = pii.canonical(kind, value)
        assert pii.form(kind, pii.canonical(kind, pii.surrogate(kind, value, "k"))) == pii.form(kind, low) and pii.form(kind, low)[1] > 1


def test_planted_entities_are_found():
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = next(c for c in iter(lambda: "4" + digits(15), "") if pii.luhn(c))
    planted = {
        "ip": ["192.168.7.21", "97.51.17.173"], "ip6": ["2001:db8:85a3:0:0:8a2e:370:7334", "fe80::1ff:fe23:4567:890a"], "mac": ["00:1A:2B:3C:4D:5E", "00-1a-2b-3c-4d-5e"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
        "phone": ["555-1234", "5551234567", "+44 20 7946 0958", "(301) 555-0346"], "card": [card, " ".join(card[i : i + 4] for i in range(0, 16, 4))], "email": ["ann.lee+x@mail.corp.com"], "ssn": ["123-45-6789"],
    }
    for kind, values in planted.items():
        for value in values:
            text = f"see the note on {value}, it has 3 parts"
            assert [x[2:] for x in pii.find(text)] == [(kind, value)]
            out, ((a, b, _),) = pii.replace(text, "k")
            new = out[a:b]
            assert new != value and ([x[2] for x in pii.find(out)] == [kind] or value == "555-1234") and (pii.form(kind, pii.canonical(kind, new)) == pii.form(kind, pii.canonical(kind, value)))
    for text, names in {
        "My name is Wei Zhang and I am here": ["Wei", "Zhang"], "Kind regards,\nAisha Khan": ["Aisha", "Khan"], "So Priya Natarajan said it. Natarajan left": ["Priya", "Natarajan", "Natarajan"], "Dear Mr. Okafor, hello": ["Okafor"],
        "ich heiße Torben Kowalczyk und": ["Torben", "Kowalczyk"], "je m'appelle Mireille Dubois": ["Mireille", "Dubois"], "Contact Aisha Khan now": ["Aisha", "Khan"], "меня зовут Глеб Сидоров": ["Глеб", "Сидоров"],
    }.items():
        assert [x[3] for x in pii.find(text)] == names and not any(n in pii.replace(text, "k")[0] for n in names)
    for clean in ("In the Green Garden they met at 12:30:45.", "std::vector, 1.2.3 and 4111111111111112 items", "pages 200-3000 of Volume Two", "The United Nations met. New York was cold."):
        assert pii.find(clean) == []


def test_spellings_move_together(spark, monkeypatch):
    spellings = {"email": ("Ann.Lee@Corp.com", "ann.lee@corp.com"), "phone": ("+44 20 7946 0958", "+442079460958"), "card": ("4111 1111 1111 1111", "4111111111111111"), "iban": ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), "mac": ("00:1A:2B:3C:4D:5E", "00-1a-2b-3c-4d-5e"), "surname": ("Wilson", "WILSON")}
    for kind, (a, b) in spellings.items():
        assert pii.canonical(kind, a) == pii.canonical(kind, b)
        for attempt in range(5):
            assert pii.canonical(kind, pii.surrogate(kind, a, "k", attempt)) == pii.canonical(kind, pii.surrogate(kind, b, "k", attempt))
            assert pii.like(kind, a, pii.canonical(kind, pii.surrogate(kind, a, "k", attempt))) == pii.surrogate(kind, a, "k", attempt)
    # A first draw that collides is drawn anew for both spellings, on the broadcast and on the joined path.
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda k, v, key, a=0: pii.like(k, v, "bob@corp.com") if k == "email" and a == 0 and pii.canonical(k, v) == "ann@corp.com" else real(k, v, key, a))
    docs = spark.createDataFrame([(1, "mail Ann@Corp.com now"), (2, "mail ann@corp.com now"), (3, "mail bob@corp.com now")], "doc_id long, text string")
    for most in (pii.MOST_BROADCAST, -1):
        monkeypatch.setattr(pii, "MOST_BROADCAST", most)
        found = pii.collisions(common.written(pii.entities(docs), "entities"), "k")
        assert {r["value"] for r in found.collect()} == {"ann@corp.com"}
        again = {pii.digest("k", r["kind"], r["value"]): (r["attempt"], r["drawn"]) for r in found.collect()}
        a, b = (pii.replace(f"mail {v} now", "k", again)[0] for v in ("Ann@Corp.com", "ann@corp.com"))
        assert a != b and a.lower() == b and "bob@corp.com" not in b


def test_no_table_of_entities_stays(spark, monkeypatch):
    import pathlib

    shared = pathlib.Path(common.shared_dir(spark))
    names = pii.FIRST["latin", "m"][:28]
    docs = spark.createDataFrame([(i, f"It was {n} Smith{c} who wrote to a@b.com") for i, (n, c) in enumerate(zip(names, "abcdefghijklmnopqrstuvwxyzab"))], "doc_id long, text string")
    for most in (pii.MOST_BROADCAST, -1):
        monkeypatch.setattr(pii, "MOST_BROADCAST", most)
        before = set(shared.iterdir())
        out = {r["doc_id"]: r["text"] for r in pii.anonymise(docs, "k").collect()}
        new = [out[i].split()[2] for i in range(28)]
        assert len(set(new)) == 28 and all(a != b for a, b in zip(names, new))
        assert {p.name.split("-")[1] for p in set(shared.iterdir()) - before} <= {"again"}


def test_phones_of_other_groupings_and_further_names():
    for phone in ("+44 20 7946 0958", "+33 1 42 68 53 00", "+49 30 1234567", "+34 912 34 56 78", "+13015550346", "3015550346", "+1 (301) 555-0346"):
        assert [x[2:] for x in pii.find(f"call {phone}, or 12 of us")] == [("phone", phone)]
        assert phone not in pii.replace(f"call {phone}.", "k")[0]
    assert [x[3] for x in pii.find("call +1 (301) 555-0346 10 times")] == ["+1 (301) 555-0346"]
    assert pii.find("1700000000 s since 2020-01-02, 3.1415926535, +5 10 20") == []
    for name in ("John Smith", "Thomas Weber", "Anna Schmidt"):
        assert [x[3] for x in pii.find(f"It was {name} who wrote.")] == name.split()
    latin = [set(pii.FIRST["latin", g]) for g in "mf"]
    assert not latin[0] & latin[1] and all(len(set(v)) == len(v) for v in pii.FIRST.values())


# 10
def test_line_rules():
    assert quality_rules.judge("One good line of words, ten of them at least, ends here.\nHome | About | Contact | More")[-1]
    assert not quality_rules.judge("Ok.\n" + "\n".join("a | b | c | d" for _ in range(9)))[-1]
    assert quality_rules.clean("A line that stays as it is.\nAll rights reserved.\n\nA line that stays as it is.\nMenu") == "A line that stays as it is.\n"
    prose = "The house passed a copyright bill last week, after a long debate in which more than thirty members spoke, most of them against it, for and against the rights of readers."
    assert quality_rules.judge(prose)[-1] and quality_rules.clean(prose) == prose
    assert quality_rules.clean("Copyright 2020, all rights reserved.\nWe use a cookie, see our privacy policy, and you may log in or sign up for more.\n" + prose) == prose
    for line in ("Tous droits réservés. Politique de confidentialité.", "Diese Seite verwendet Cookies, siehe Datenschutzerklärung.", "© 2021 Example, todos los derechos reservados.", "Lees meer over ons privacybeleid.", "COPYRIGHT (C) Example Inc., London."):
        assert quality_rules.clean(line + "\n" + prose) == prose
    for line in ("She took a cookie and left the room quickly.", "The copyright of a song lasts for long.", "He wrote it in JavaScript over one long weekend.", "Readers subscribe for a year at least."):
        assert quality_rules.clean(line) == line
    words = "a b c d e f g a b c d e x".split()
    brute = set()
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    for i in range(len(words) - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            brute |= set(range(i, i + 5))
    assert quality_rules.repeated_words(words) == len(brute) == 10


# The pipeline.
def test_pipeline_is_its_stages(spark, corpus):
    sf = SF
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in kept}
    one = {i for i, (_, c) in brute_components(texts, 5, 80, 100).items() if c == i}
    items = decontaminate.Items([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    clean = {i for i in one if not items.find(texts[i])}
    assert set(got) == clean
    import public_tokenizers

    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in got.items():
        text = pii.replace(texts[i], pii.session_key(spark))[0]
        assert r["text"] == text and r["ids"] == list(c.encode(text)) and r["n_tokens"] == len(r["ids"])

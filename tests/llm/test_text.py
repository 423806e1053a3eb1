import random
import time
import zlib
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from peptrail.llm import html_extract, license_scan, mixing, simhash, substring, topk, toxicity
from peptrail.llm.shared import min_components


# -- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    ids, fps = [i for i, _ in pairs], [f for _, f in pairs]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 or ids[i] == ids[j]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(ids):
        least[root(i)] = min(least.get(root(i), k), k)
    return {k: least[root(i)] for i, k in enumerate(ids)}


def test_fingerprints():
    r = random.Random(1)
    for text in ["", None, " \t", "one", "A b C", "É é ÀB", " ".join(r.choice("abcd") for _ in range(400)), "x" * 3000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("hot", [2048, 3])
def test_components_are_brute_force(docs_of, hot):
    r = random.Random(hot)
    base = [r.choice("abcdefgh") + r.choice("xyz") for _ in range(300)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 30])):
            words[r.randrange(300)] = r.choice("pqrs")
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "  "), (203, "same text"), (204, "same text"), (5, "another text of five")]
    got = simhash.near_duplicates(docs_of([*rows, (None, "same text")]), hot=hot).collect()
    want = brute_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert len(got) == len(rows) + 1
    for x in got:
        assert x.component_id == (None if x.doc_id is None else want[x.doc_id])


def test_near_copies_make_few_links(spark):
    """2,609 fingerprints of one group of near copies: links that span it, not all its pairs."""
    r = random.Random(4)
    base, seen = r.getrandbits(64), set()
    while len(seen) < 2609:
        x = base
        for b in r.sample(range(64), r.choice([1, 2, 3, 4])):
            x ^= 1 << b
        seen.add(x - 2**64 if x >= 2**63 else x)
    reps = spark.createDataFrame(list(enumerate(sorted(seen))), "rep long, fp long")
    for hot in (2048, 100):
        links = simhash.links_within(reps, 4, hot).distinct().collect()
        assert len(links) < (30_000 if hot == 2048 else 100_000)
        got = min_components(reps.selectExpr("rep as id"), spark.createDataFrame(links, "a long, b long"))
        assert {x.component for x in got.collect()} == {0}


def test_bucket_links_in_steps():
    r = np.random.default_rng(2)
    key = np.sort(r.integers(0, 60, 4000))
    fp = r.integers(0, 64, 4000) | (r.integers(0, 2, 4000) << 40)
    own, rep = r.random(4000) < 0.3, r.permutation(4000)
    order = np.lexsort((~own, key))
    key, own, fp, rep = key[order], own[order], fp[order], rep[order]
    whole = {frozenset(p) for p in zip(*simhash.bucket_links(key, own, fp, rep, 1))}
    assert whole == {frozenset(p) for p in zip(*simhash.bucket_links(key, own, fp, rep, 1, at_once=50))}
    want = set()
    for k in range(60):  # each bucket's components by brute force
        at = np.flatnonzero(key == k)
        least = rep[at].copy()
        near = (np.bitwise_count(fp[at][:, None] ^ fp[at]) <= 1) & (own[at][:, None] | own[at]) | np.eye(len(at), dtype=bool)
        for _ in range(len(at)):
            least = np.where(near, least, 10**6).min(1)
        want |= {frozenset((int(x), int(m))) for x, m in zip(rep[at], least) if x != m}
    assert whole == want


def test_segments_lose_no_pair():
    for n in (10, 10**5, 10**9, 10**13):
        for distance in (0, 1, 3, 4, 7):
            plan = simhash.segments_for(n, distance)
            r = random.Random(n)
            for _ in range(300):
                bits = r.sample(range(64), distance)
                assert any(sum(s.low <= b < s.low + s.width for b in bits) <= s.radius for s in plan)


def test_keep_first(docs_of, spark):
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "quite another text it is"), (3, "quite another text it is"), (None, "a b c d e f")])
    assert sorted((r.doc_id is None, r.doc_id) for r in simhash.keep_first(docs).collect()) == [(False, 1), (False, 3), (True, None)]
    assert simhash.keep_first(docs.limit(0)).count() == 0
    again = docs_of([(3, "b text of three"), (3, None), (3, "a text of three"), (4, "b text of three"), (5, "fives own words")])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_first(again).collect()) == [(3, None), (5, "fives own words")]


def test_min_components(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, k) for k in range(501, 560)]
    ids = sorted({x for p in links for x in p} | {999})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = min_components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links + [(None, 1)], "a long, b long"))
    assert dict(map(tuple, got.collect())) == {i: root(i) for i in ids}


# -- toxicity


def toxic_tables(spark, n=400):
    r = random.Random(9)
    plain = ["".join(r.choice("aeiou") + r.choice("bdgmn") for _ in range(r.randint(1, 3))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(words) // 40)):
                words[r.randrange(len(words))] = "zlurpish" + r.choice(["", "er", "ed", "x"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    labels.append((n + 5, None))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_holds_out_and_finds(spark, docs_of):
    rows, labels = toxic_tables(spark)
    docs = docs_of([*rows, (1001, "a zlurrpish word"), (1002, None), (1003, ""), (1004, "dune " * 30_000)])
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.with_scores(docs, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(r.out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, _ in rows if got[i].out]
    assert np.mean([(got[i].toxicity >= 0.7) == (i % 5 == 0) for i in held]) > 0.97
    assert got[1001].toxicity >= 0.7 and max(got[i].toxicity for i in (1002, 1003, 1004)) < 0.7
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = toxicity.train(docs, flipped)
    assert np.array_equal(again.margin, model.margin)  # held-out labels teach nothing


def test_rounds_are_those_that_judge_unseen_documents_best():
    """One round of descent at least; it does no worse than the start on documents not seen."""
    def tables(seed, n, stems):
        r = random.Random(seed)
        plain = ["".join(r.choice("aeiou") + r.choice("bdgmn") for _ in range(r.randint(1, 3))) for _ in range(400)]
        texts, toxic = [], []
        for i in range(n):
            words = [r.choice(plain) for _ in range(r.randint(60, 200))]
            if i % 5 == 0:  # words of rare stems, spelt anew each time, among plain ones of like spelling
                for _ in range(stems):
                    words[r.randrange(len(words))] = r.choice(["badomu", "gemani", "dubagi"]) + "z" + r.choice(plain)
            texts.append(" ".join(words))
            toxic.append(int(i % 5 == 0))
        return texts, np.array(toxic)

    for seed, stems in ((1, 1), (2, 3)):
        texts, toxic = tables(seed, 700, stems)
        missed = {}
        for rounds in (0, 4):
            model = toxicity.SubwordSoftmax()
            model.fit(texts[:500], toxic[:500], rounds=rounds)
            assert min(1, rounds) <= model.rounds <= rounds and model.window in toxicity.PASSAGES
            score = model.scores(texts[500:])
            missed[rounds] = np.mean([(a <= b) for a in score[toxic[500:] == 1] for b in score[toxic[500:] == 0]])
        assert missed[4] <= missed[0] + 0.01 and missed[4] < 0.1


def test_descent_follows_the_gradient(monkeypatch):
    """The first step goes against the slope of the weighted loss, which differences of the loss give too."""
    model = toxicity.SubwordSoftmax(buckets=97, dim=3)
    places, label = [["abcd", "ef"], ["gh"], ["abcd", "ijkl", "gh"]], np.array([1, 0, 0])
    rng = np.random.default_rng(3)
    table, head, bias = rng.normal(0, 0.5, (97, 3)), rng.normal(0, 0.5, (3, 2)), rng.normal(0, 0.5, 2)

    def loss(table, head, bias):
        total = 0.0
        for words, y in zip(places, label, strict=True):
            bag = np.mean([table[model.bags([w])[0]].mean(0) for w in words], 0)
            logit = bag @ head + bias
            total -= (logit[y] - np.log(np.exp(logit).sum())) / (2 * (label == y).sum())
        return total

    after = model._descend(table.copy(), head.copy(), bias.copy(), places, label, 1)
    for k, (old, new) in enumerate(zip((table, head, bias), after, strict=True)):
        for at in np.ndindex(old.shape):
            ends = []
            for shift in (1e-5, -1e-5):
                moved = [table.copy(), head.copy(), bias.copy()]
                moved[k][at] += shift
                ends.append(loss(*moved))
            slope = (ends[0] - ends[1]) / 2e-5
            if abs(slope) > 1e-3:  # Adam's first step has the slope's sign and the rate's size
                assert abs(new[at] - old[at] + 0.05 * np.sign(slope)) < 1e-3
    assert loss(*model._descend(table.copy(), head.copy(), bias.copy(), places, label, 40)) < loss(table, head, bias) / 2


def test_scores_of_clashing_columns_and_no_rows(docs_of):
    model = toxicity.SubwordSoftmax()
    docs = docs_of([(1, "a b"), (1, "a b"), (None, "a b")])
    assert len({r.toxicity for r in toxicity.with_scores(docs, model).collect()}) == 1 and toxicity.with_scores(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        toxicity.with_scores(docs, model, "source")


def test_toxicity_without_labels(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    for labels in ([], [(1, 1)], [(2, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(0 <= r.toxicity < 0.7 for r in toxicity.with_scores(docs, model).collect())


# -- HTML


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<html></html>", ""),
        ("<head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">buy this now please all of you</div><article><h1>Head &amp; tail</h1><p>One\n  two&nbsp;three<br>four<p>Fi<b>ve</b></article><footer>&copy; me and all the others</footer>", "Head & tail\nOne two three four\nFive"),
        ("<article><p>a &lt;b&gt; c<script>var x='</p><p>no';</script></p><aside>side words</aside><div class=comments><p>first!</p></div><form>name <input> age</form><p>end</article>", "a <b> c\nend"),
        ("<main><header><h1>T</h1></header><p>x < y</p><style>p{}</style><!-- <p>no</p> --></main><div id='cookie-notice'>We use cookies on this site for you</div>", "x < y"),
        ("<article><p>cut off", "cut off"),
        ("<div id=content><p>short</p></div><div class='sidebar'><p>links and more links of the week</p></div>", "short"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>Some words that stand in the article and go on for a while so that it is long.</p><p class="share-price">The share price rose a lot.</p><p>More words of the article which go on for a while.</p></article>',
         "Some words that stand in the article and go on for a while so that it is long.\nThe share price rose a lot.\nMore words of the article which go on for a while."),
        ('<article><p>Some words that stand in the article and go on for a while so that it is long.</p><div class="response-thread"><p>I do not agree with this at all, said a reader.</p></div></article>',
         "Some words that stand in the article and go on for a while so that it is long."),
        ("<article><p>a b c d e f g</p><button><div><div><div><div>Click me</div></div></div></div></button><object><p><b><i>x</i></b></p></object><p>end of it</p></article>", "a b c d e f g\nend of it"),
        ("<article><header><h1>Title</h1></header><p>text one two three four</p></article>", "text one two three four"),
        ("<article><p>one<!-->two</p><p>three --> four<!--->five</p><!-- six --><p>s<!-- x -->even</p></article>", "onetwo\nthree --> fourfive\nseven"),
        ("<article><p title='a>b' class=x>in</p><p data-x=\"1>2\">quotes</p><p>&lt;&#233;&amp;amp;</p></article>", "in\nquotes\n<é&amp;"),
        ("<div class='site-widget'><article><p>long words of the article that go on and on</p></article></div>", "long words of the article that go on and on"),
        ("<article><p>The words of the article, which has quite a few of them in it.</p></article><section class='commentList'><article><p>A remark of a reader that is not short either.</p></article></section>",
         "The words of the article, which has quite a few of them in it."),
        ("<script>var a = '<article><p>no</p></article>';</script><article><SCRIPT>x</script ><p>yes and no</p><textarea><p>not</p></textarea></article>", "yes and no"),
    ],
)
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("piece", ["<a ", '<a =">b="c', "<div>", "<button>", '<a "', "<a '>", "<!--", "</p", '<p class="x">', "<", "<script>", "&lt;"])
def test_two_megabytes_of_odd_markup(piece):
    began = time.process_time()
    html_extract.main_text("<article><p>x</p>" + piece * (2_000_000 // len(piece)) + "</article>")
    assert time.process_time() - began < 10


class PlainParser(HTMLParser):
    """An independent reading of well-formed pages: text by block of what lies in an article and in no frame part."""

    def __init__(self):
        super().__init__()
        self.path, self.blocks = [], [[]]

    def handle_starttag(self, tag, attributes):
        if tag in ("p", "h1", "h2", "li", "div", "ul", "blockquote", "article", "nav", "footer", "aside", "section", "form"):
            self.blocks.append([])
            self.path.append(tag if tag != "div" or not dict(attributes).get("class") else "ad")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "div", "ul", "blockquote", "article", "nav", "footer", "aside", "section", "form"):
            self.blocks.append([])
            self.path.pop()

    def handle_data(self, data):
        if "article" in self.path and not {"nav", "footer", "aside", "form", "ad"} & set(self.path):
            self.blocks[-1].append(data)


def test_pages_as_another_parser_reads_them():
    r = random.Random(3)
    words = lambda n: " ".join(r.choice(["one", "two", "&amp;", "th&eacute;", "<b>four</b>", "<a href='/x'>five</a>", "x &lt; y", "<i>a</i>b"]) for _ in range(n))
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 12)):
            kind = r.choice(["p", "p", "p", "h2", "list", "quote", "ad", "aside", "form"])
            parts.append({
                "p": f"<p>{words(r.randint(1, 80))}</p>", "h2": f"<h2>{words(3)}</h2>", "list": "<ul>" + "".join(f"<li>{words(r.randint(1, 9))}</li>" for _ in range(3)) + "</ul>",
                "quote": f"<blockquote><p>{words(20)}</p></blockquote>", "ad": f"<div class='{r.choice(['ad', 'newsletter-signup', 'comments', 'cookie notice'])}'><p>{words(r.randint(1, 40))}</p></div>",
                "aside": f"<aside><p>{words(9)}</p></aside>", "form": f"<form><p>{words(4)}</p></form>",
            }[kind])
        page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>{words(5)}</h1><p>{words(60)}</p>{''.join(parts)}</article><footer><p>{words(12)}</p></footer></body></html>"
        other = PlainParser()
        other.feed(page)
        assert html_extract.main_text(page) == "\n".join(t for t in (" ".join("".join(b).split()) for b in other.blocks) if t)


def test_the_neighbours_decide():
    """Without its neighbours' features the tree reads pages without an article otherwise."""
    def plain(tree, page):
        held = html_extract._Page(page)
        return [tree.predict((*row[:2], 0, 0.0, 0, 0.0, *row[6:])) for row in held.features()]

    body = "These are the words of a paragraph that goes on for quite some time and says nothing much at all, as they do."
    page = f"<div><a href=/a>A</a></div><div><a href=/b>B two</a></div><div>Short line</div><p>{body}</p><div>Another line</div><p>{body} {body}</p><div>Written by us</div><div><a href=/c>C</a></div>"
    tree, held = html_extract.default_tree(), html_extract._Page(page)
    assert plain(tree, page) != [tree.predict(row) for row in held.features()]
    assert {html_extract.FEATURES[f] for f, *_ in tree.nodes if f >= 0} & {"words_before", "links_before", "words_after", "links_after"}


def test_pages_without_an_article():
    long = "These are the words of a paragraph that goes on for quite some time and says nothing much at all, as they do."
    page = f"<body><div><a href=/a>A</a> <a href=/b>B</a></div><p>{long}</p><p>{long}</p><div><a href=/c>C more of it</a></div></body>"
    assert html_extract.main_text(page) == f"{long}\n{long}"


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é x</article>", 0), (1, "u", "<article><p>é x</article>", 0), (2, None, None, 1), (None, "v", "<p>" + "w " * 60_000, 2)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0), r.n_chars, r.text[:5]) for r in html_extract.extract(pages).collect())
    assert got == [(0, 119_999, "w w w"), (1, 3, "é x"), (1, 3, "é x"), (2, 0, "")]


# -- mixing


def deviation_is_under_a_block(weights, blocks):
    """Each source has at any time its exact share of the slots to within less than one block; blocks run in order."""
    exact, taken = mixing.exact_weights(weights), set()
    total, held = sum(exact), [0] * len(exact)
    whole = sum(map(Fraction, weights))
    assert all(Fraction(w) * total == k * whole for w, k in zip(weights, exact))
    for i, j, t in mixing.block_schedule(exact, blocks):
        # block j runs in slot t: before it the share was over j - 1, after it it is under j + 1 blocks
        assert j == held[i] and j * total < (t + 1) * exact[i] and t * exact[i] < (j + 1) * total
        held[i] += 1
        assert t not in taken
        taken.add(t)
    assert held == list(blocks)


def test_pfair_deviation():
    for seed in range(25):
        r = random.Random(seed)
        weights = [r.random() ** 3 + 0.001 for _ in range(r.randint(1, 40))]
        deviation_is_under_a_block(weights, [r.randint(0, 300) for _ in weights])
    deviation_is_under_a_block([1.0, 1.0, 1.0], [17_000, 17_000, 17_000])
    deviation_is_under_a_block([0.9, *[0.0001] * 1000], [45_000, *[5] * 1000])
    deviation_is_under_a_block([0.1, 1 / 3, 0.7, 1e-9], [10_000, 15_000, 25_000, 2])


def test_pfair_deviation_of_many_sources():
    r = random.Random(5)
    deviation_is_under_a_block([r.random() ** 4 + 1e-6 for _ in range(5000)], [r.randint(1, 20) for _ in range(5000)])


def test_mix_leaves_columns_named_as_its_helpers(spark):
    names = ["doc_id", "source", "__mix_hash", "__mix_block", "__mix_name", "kept __mix_hash", "w"]
    rows = [(k, f"s{k % 3}", f"h{k}", k * 2, "n", k, 0.5) for k in range(60)]
    docs = spark.createDataFrame(rows, names)
    for made in (mixing.mix(docs, block_rows=4), mixing.in_order(docs), mixing.mix(docs.withColumnRenamed("__mix_hash", "x").withColumnRenamed("source", "__mix_hash"), source="__mix_hash", block_rows=4)):
        at = made.columns[: len(names)]
        assert sorted(tuple(r[c] for c in at) for r in made.collect()) == sorted(rows) and at in (names, ["doc_id", "__mix_hash", "x", *names[3:]])


def test_a_small_mix_is_few_files_in_order(spark):
    docs = spark.createDataFrame([(k, f"s{k % 7}") for k in range(900)], "doc_id long, source string")
    want = [(r.doc_id, r.source) for r in sorted(mixing.mix(docs).collect(), key=lambda r: r.mix_position)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = mixing.in_order(docs)
        assert [tuple(r) for r in got.collect()] == want and got.rdd.getNumPartitions() < 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_mix_keeps_all_rows(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 11}") for i in range(3000)] + [(5000, None), (None, "big"), (5001, ""), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, block_rows=4).collect()
    assert sorted(((r.doc_id or -1), r.source or "") for r in got) == sorted((i or -1, s or "") for i, s in rows)
    assert len({r.mix_position for r in got}) == len(rows)
    weights = {"big": 3.0, "s0": 1.0}
    ordered = sorted(mixing.mix(docs.where("source in ('big', 's0')"), weights, block_rows=1).collect(), key=lambda r: r.mix_position)
    for n in range(1, 300):
        assert abs(sum(r.source == "big" for r in ordered[:n]) - 0.75 * n) < 1
    few = mixing.mix(docs, block_rows=4, most_blocks=20).collect()
    assert len(few) == len(rows) and len({r.mix_position for r in few}) == len(rows) and len({r.mix_slot for r in few}) <= 20 + 14
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": 0.0})
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [f.name for f in mixing.in_order(docs.limit(5)).schema] == ["doc_id", "source"]


def test_every_source_has_its_place(spark):
    rows = [(i, f"s{i % 1500}") for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1).collect()
    assert len({r.mix_position for r in got}) == len(rows)
    # equal weights: block j of a source runs in round j
    assert all(1500 * r.mix_block <= r.mix_slot < 1500 * (r.mix_block + 1) for r in got)
    thirds = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30_000)], "doc_id long, source string")
    assert all(3 * r.mix_block <= r.mix_slot < 3 * (r.mix_block + 1) for r in mixing.mix(thirds, block_rows=1).collect())


# -- licences


def test_license_scan_is_brute_force(docs_of):
    r = random.Random(6)
    texts = [*license_scan.TEMPLATES.values()]
    rows = [(0, None), (1, ""), (2, "one two three four"), (3, "x " * 50_000)]
    for i in range(150):
        words = [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(0, 60))]
        if i % 2:
            at = r.randint(0, len(words))
            words[at:at] = r.choice(texts).upper().split()
        if i % 5 == 0 and words:
            words[r.randrange(len(words))] = "zz"
        rows.append((10 + i, " ".join(words)))
    import re

    def grams(text):
        w = [x for x in re.split("[^a-z0-9]+", (text or "").lower()) if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    held = {n: grams(t) for n, t in license_scan.TEMPLATES.items()}
    want = {(i, n) for i, t in rows for n, g in held.items() if len(g & grams(t)) >= 0.8 * len(g)}
    got = {(r.doc_id, r.license) for r in license_scan.scan(docs_of(rows)).collect()}
    assert got == want and len(want) > 50 and {"mit-text", "bsd-2-clause-text"} <= {n for _, n in want}
    assert license_scan.scan(docs_of(rows).limit(0)).count() == 0


def test_license_places_are_brute_force(docs_of):
    """Shares and places of windows in texts that hold notices many times, cut and whole, against sets of shingles."""
    import re

    r = random.Random(8)
    notices = {"long": " ".join(r.choice("abcdefg") + str(r.randint(0, 9)) for _ in range(40)), "short": "k1 k2 k3 k4 k5 k6", "again": "a1 b1 " * 9}
    rows = []
    for i in range(40):
        words = []
        for _ in range(r.randint(1, 12)):
            held = r.choice([*notices.values()]).split()
            words += held[r.randint(0, 3) : len(held) - r.randint(0, 3)] + [r.choice("xyz") for _ in range(r.randint(0, 9))]
        rows.append((i, " ".join(words)))

    def grams(w):
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    got = {(x.doc_id, x.license): x for x in license_scan.scan(docs_of(rows), notices).collect()}
    seen = 0
    for i, text in rows:
        words = re.split("[^a-z0-9]+", text)
        for name, notice in notices.items():
            whole, n = set(grams(notice.split())), len(notice.split())
            shares = {}
            for at in range(0, len(words) - 4, 3):
                if any(g in whole for g in grams(words[at : at + 7])):
                    low = max(0, at - n)
                    shares[at] = len(whole & set(grams(words[low : low + 2 * n + 8]))) / len(whole)
            good = [at for at, s in shares.items() if s >= 0.8]
            found = got.get((i, name))
            assert (found is not None) == bool(good)
            if found and name == "long":  # its windows are met for sure where they are whole
                assert found.n_places <= len(good) and found.first_word in good and abs(found.containment - max(shares.values())) < 1e-6
                seen += 1
    assert seen > 10


def test_a_text_that_is_a_notice_many_times(docs_of):
    mit = license_scan.TEMPLATES["mit-text"]
    one, many = (license_scan.scan(docs_of([(1, f"{mit} and " * n)])).where("license = 'mit-text'").first() for n in (1, 300))
    assert many.containment == one.containment == 1.0 and many.n_places > 250 * one.n_places


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_licenses_of_null_and_repeated_ids(docs_of, monkeypatch, most):
    monkeypatch.setattr(license_scan, "BROADCAST_BYTES", most)
    mit, isc = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["isc"]
    rows = [(None, f"x {mit}"), (None, f"y {isc}"), (7, f"a b {mit}"), (7, f"a b {mit}"), (7, f"c {mit} and more {mit}"), (8, f"d {isc}"), (8, "nothing of it")]
    got = {(r.doc_id, r.license): r for r in license_scan.scan(docs_of(rows)).collect()}
    assert set(got) == {(None, "mit"), (None, "isc"), (7, "mit"), (8, "isc")}
    alone = {r.license: r.n_places for r in license_scan.scan(docs_of([(1, f"a b {mit}")])).collect()}
    both = {r.license: r.n_places for r in license_scan.scan(docs_of([(1, f"c {mit} and more {mit}")])).collect()}
    assert got[(7, "mit")].n_places == alone["mit"] + both["mit"] and got[(7, "mit")].first_word <= 3


# -- top-k


@pytest.mark.parametrize("copies", [0, 400])
def test_topk_is_brute_force(spark, copies):
    r = np.random.default_rng(copies)
    centres = r.normal(size=(6, 12))
    x = [(centres[i % 6] + r.normal(size=12) * 0.2).astype(np.float32).tolist() for i in range(700)]
    rows = [(i, v) for i, v in enumerate(x)] + [(1000 + i, x[3]) for i in range(copies)]
    rows += [(2000, None), (2050, [float("nan")] * 12), (2100, [None] + [1.0] * 11), (2150, [1.0] * 5), (2200, [2.0] * 5), (None, x[0])]
    data = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(data.where("id % 50 = 0"), data, 5, data_block=200, query_block=8).collect()
    sound = [(i, [int(np.floor(256 * float(e))) for e in v]) for i, v in rows if i is not None and v is not None and all(e is not None and np.isfinite(e) for e in v)]
    want = set()
    for q, v in sound:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q and len(w) == len(v))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(g) for g in got} == want and len(got) == len(want)


def test_topk_floors_keep_all(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 6))
    x[100:400] = x[7]  # a vector that many rows have
    data = topk.quantised(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    want = {tuple(g) for g in topk.top_k(data.where("id % 50 = 0"), data, 5, data_block=2000).collect()}
    for first in (1, 40, 5000):
        got = topk.top_k(data.where("id % 50 = 0"), data, 5, data_block=100, query_block=5, first_rows=first).collect()
        assert {tuple(g) for g in got} == want and len(got) == len(want) == 90
    assert topk.top_k(data.limit(0), data, 5).count() == 0 and topk.top_k(data, data.limit(0), 5).count() == 0


def test_topk_bounds_hold():
    r = np.random.default_rng(6)
    for scale in (1, 30):
        x = np.concatenate([r.normal(size=(200, 5)) + scale * r.normal(size=5) for _ in range(6)]) * 256
        search = topk.DualSearch(x[:300].astype(np.int64), np.arange(300), x.astype(np.int64), np.arange(len(x)), 3)
        nodes, below = [topk.cover_tree(search.q)], [topk.cover_tree(search.d)]
        for held in (nodes, below):
            for node in held:
                held += node.children
        for q in nodes[::3]:
            for d in below[::3]:
                assert (search.q[q.points] @ search.d[d.points].T).max() <= search._bound(q, d) + 0.5


def test_topk_prunes_and_stays_exact():
    r = np.random.default_rng(3)
    d = (r.normal(size=(3000, 8)) + 40 * r.normal(size=(20, 8))[r.integers(0, 20, 3000)]).astype(np.int64) * 100
    search = topk.DualSearch(d[:300], np.arange(300), d, np.arange(3000), 3)
    found = search.run()
    score = d[:300] @ d.T
    for q in range(300):
        assert [(-s, i) for s, i in found[q]] == sorted(((int(v), i) for i, v in enumerate(score[q]) if i != q), key=lambda t: (-t[0], t[1]))[:3]
    leaves = lambda node: sum(map(leaves, node.children)) if node.children else 1
    assert search.base_cases < 0.5 * leaves(topk.cover_tree(search.q)) * leaves(topk.cover_tree(search.d))
    big = np.full((3, 4), 2**40, np.int64)
    assert topk.DualSearch(big, np.arange(3), big, np.arange(3), 1).run()[0] == [(-(4 * 2**80), 1)]


# -- passages


def lines(r, n):
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def test_passages_and_cuts(docs_of):
    r = random.Random(8)
    passage = lines(r, 80)
    fuzzy = [w if k % 16 else f"q{k}" for k, w in enumerate(passage)]
    rows = [
        (1, " ".join(lines(r, 100) + passage + lines(r, 50))), (2, " ".join(lines(r, 30) + passage + lines(r, 60))), (3, " ".join(passage)),
        (4, " ".join(lines(r, 40) + fuzzy[:40] + ["more", "of", "it"] + fuzzy[40:] + lines(r, 30))), (5, " ".join(lines(r, 400))), (6, None), (7, ""), (None, " ".join(passage)),
        (8, " ".join(lines(r, 100) + passage[:30] + lines(r, 100))),
    ]
    docs = docs_of(rows)
    got = {x.doc_id: x for x in substring.passages(docs).collect()}
    assert set(got) == {2, 3, 4} and {x.other_id for x in got.values()} == {1}
    assert (got[2].start, got[2].end, got[2].other_start, got[2].equal_words) == (30, 110, 100, 80)
    assert got[4].end - got[4].start >= 75
    kept = {x.doc_id: x for x in substring.cut_repeats(docs).collect()}
    assert set(kept) == {1, 2, 4, 5, 6, 7, 8, None}
    assert len(kept[2].text.split()) == 90 and kept[2].n_chars == len(kept[2].text)
    assert all(kept[i].text == dict(rows)[i] for i in (1, 5, 6, 7, 8, None))
    assert substring.passages(docs.limit(0)).count() == 0


def test_a_passage_of_many_documents(docs_of):
    r = random.Random(2)
    passage = lines(r, 60)
    rows = [(i, " ".join(lines(r, 40) + passage + lines(r, 40))) for i in range(300)]
    got = {(x.doc_id, x.other_id) for x in substring.passages(docs_of(rows)).collect()}
    assert got == {(i, 0) for i in range(1, 300)}


def test_chains_are_best():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 7)
        parts = np.array(sorted([r.randrange(60), r.randrange(60), r.randint(5, 12), 1] for _ in range(n)))

        def best(i):
            out = parts[i][2]
            for j in range(n):
                if parts[j][0] + parts[j][2] <= parts[i][0] and parts[j][1] + parts[j][2] <= parts[i][1]:
                    gap = parts[i][0] - parts[j][0] - parts[j][2] + parts[i][1] - parts[j][1] - parts[j][2]
                    out = max(out, parts[i][2] + best(j) - substring.GAP_COST * gap)
            return out

        first = substring.chains(parts)[0]
        value = parts[first[0]][2]
        for a, b in zip(first, first[1:]):
            value += parts[b][2] - substring.GAP_COST * (parts[b][0] - parts[a][0] - parts[a][2] + parts[b][1] - parts[a][1] - parts[a][2])
        assert abs(value - max(best(i) for i in range(n))) < 1e-9
        assert sorted(k for c in substring.chains(parts) for k in c) == list(range(n))


def test_without_spans():
    assert substring.without_spans("a  b c\nd e", [(1, 3), (2, 4)]) == "a   e"
    assert substring.without_spans("a b", []) == "a b" and substring.without_spans("a b", [(0, 9)]) == ""


def covered(docs, rows, least=50):
    """Documents' words in exact runs of an earlier document by brute force, and those that the spans leave out."""
    first, want = {}, set()
    for i, text in rows:
        words = text.split()
        for s in range(len(words) - least + 1):
            if first.setdefault(tuple(words[s : s + least]), i) < i:
                want |= {(i, s + j) for j in range(least)}
    got = {(x.doc_id, j) for x in substring.passages(docs).collect() for j in range(x.start, x.end)}
    return want, want - got


def changed_passages(r, pieces, n, rate, times, rows):
    """Documents with a passage, its pieces in documents before, and a copy with changed words after: ids of the two."""
    names = [f"w{k}x" for k in range(30000)]
    some = lambda k: r.choices(names, k=k)
    out = []
    for _ in range(times):
        own = some(n)
        changed = list(own)
        for k in r.sample(range(1, n - 1), int(rate * n)):
            changed[k] = r.choice(names)
        parts = [own[k : k + pieces] for k in range(0, n, pieces)]
        for words in [*(some(20) + part + some(20) for part in parts), some(30) + own + some(30), some(30) + changed + some(30)]:
            rows.append((len(rows) + 1, " ".join(words)))
        out.append((len(rows), len(rows) - 1))
    return out


def test_changed_passages_whose_pieces_came_earlier(docs_of, monkeypatch):
    """Each seed meets the document that holds the passage, not just the first one, which holds a piece of it."""
    r, rows, cells = random.Random(7), [], {}
    for pieces in (12, 30):
        for n, rate in ((50, 0.06), (50, 0.15), (60, 0.1), (60, 0.15), (80, 0.18)):
            cells[pieces, n, rate] = changed_passages(r, pieces, n, rate, 30, rows)
    docs = docs_of(rows)
    got = [tuple(x) for x in substring.passages(docs).collect()]
    pairs = {x[:2] for x in got}
    for cell, own in cells.items():
        assert sum(p in pairs for p in own) >= 0.9 * len(own), cell
    assert not pairs - {p for own in cells.values() for p in own}
    # seeds that are dealt over several tasks give the same
    monkeypatch.setattr(substring, "HOT", 2)
    assert sorted(tuple(x) for x in substring.passages(docs).collect()) == sorted(got)


def test_like_pairs_by_hand():
    """Of all earlier occurrences among like words those stay that have three agreeing words which no likelier one has."""
    r = np.random.default_rng(3)
    size = [1, 2, 5, 40, 90, 300]
    key = np.repeat(np.arange(len(size)), size).astype(np.int64)
    doc = np.concatenate([np.sort(r.integers(0, 60, n)) for n in size]).astype(np.int64)
    base = r.integers(0, 16, (len(size), 32))
    words = np.where(r.random((len(key), 32)) < 0.8, base[key], r.integers(0, 16, (len(key), 32)))
    words[r.random(len(key)) < 0.3, 9:23] = 3
    packed = [sum(words[:, h + j].astype(np.uint64) << np.uint64(4 * j) for j in range(16)) for h in (0, 16)]
    x, y, mask = substring.like_pairs(key, doc, *packed, 16, at_once=50)
    want = set()
    for i in range(len(key)):
        found = []
        for j in range(i):
            same = words[i] == words[j]
            if key[j] == key[i] and doc[j] < doc[i] and same.sum() >= substring.AGREE:
                runs = set()
                for half in (0, 16):
                    row = [True, True, *same[half : half + 16].tolist()]  # the seed's own words agree
                    runs |= {half + k + d - 2 for k in range(16) for d in range(3) if all(row[k : k + 3]) and k + d >= 2}
                found.append((runs, j))
        while found:
            best = max(found, key=lambda f: (len(f[0]), -f[1]))[0]
            want.add((i, min(j for own, j in found if len(best - own) < 3)))
            found = [(own, j) for own, j in found if len(own - best) >= 3]
    assert {(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)} == want


def test_repeated_lines_are_passages(docs_of):
    r = random.Random(5)
    rows = []
    for period in (1, 2, 3, 7, 13, 14):
        line = lines(r, period)
        for length in (120, 90, 50):
            rows.append((len(rows), " ".join(lines(r, 30) + (line * length)[:length] + lines(r, 40))))
    want, lost = covered(docs_of(rows), rows)
    assert len(want) >= 6 * 140 and not lost


def test_a_passage_whose_pieces_came_earlier(docs_of):
    r = random.Random(6)
    rows = []
    for _ in range(30):
        passage, at = lines(r, 60), len(rows)
        for piece in (passage[:30], passage[30:], passage, passage):
            rows.append((len(rows), " ".join(lines(r, 40) + piece + lines(r, 40))))
        assert len(rows) == at + 4
    want, lost = covered(docs_of(rows), rows)
    assert len(want) >= 30 * 60 and not lost


def test_one_seed_is_enough(docs_of):
    r = random.Random(7)
    rows, n = [], 120
    for i in range(n):
        passage = lines(r, 50)
        changed = set(r.sample(range(2, 48), 7))
        rows += [(i, " ".join(lines(r, 60) + passage + lines(r, 60))), (n + i, " ".join(lines(r, 60) + [f"q{j}" if j in changed else w for j, w in enumerate(passage)] + lines(r, 60)))]
    got = {x.doc_id for x in substring.passages(docs_of(sorted(rows))).collect()}
    assert len(got) >= 0.8 * n


def test_a_link_hides_no_other(docs_of):
    r = random.Random(14)
    passage = lines(r, 80)
    changed = [w if k % 11 else f"q{k}" for k, w in enumerate(passage)]
    rows = [(i, " ".join(lines(r, 40) + p + lines(r, 40))) for i, p in ((1, passage), (2, changed), (3, changed))]
    got = {(x.doc_id, x.other_id) for x in substring.passages(docs_of(rows)).collect()}
    assert got == {(2, 1), (3, 2)}  # what 2 is like, 3 is, for they are equal there; that they are equal was hidden by (3, 1)


def test_rows_of_one_id(docs_of):
    r = random.Random(10)
    passage = " ".join(lines(r, 70))
    rows = [(1, passage), (2, "x " + passage), (2, "x " + passage), (3, passage + " y"), (3, "z z " + passage), (None, passage)]
    docs = docs_of(rows)
    got = substring.passages(docs).collect()
    assert sorted((x.doc_id, x.other_id) for x in got) == [(2, 1), (3, 1)]
    kept = [(x.doc_id, x.text) for x in substring.cut_repeats(docs).collect()]
    assert len([k for k in kept if k[0] == 2]) == 2 and len([k for k in kept if k[0] == 3]) == 2
    assert sum(len(t.split()) > 60 for i, t in kept if i == 3) == 1  # the other text of that id stays whole


def test_a_repeated_pair_of_words_gives_few_spans(docs_of):
    r = random.Random(12)
    rows = [(i, " ".join(lines(r, 40) + ["so", "on"] * (100 + 10 * i) + lines(r, 40))) for i in range(25)]
    docs = docs_of(rows)
    want, lost = covered(docs, rows)
    assert not lost and substring.passages(docs).count() < 25 * 6


def test_spans_that_cover():
    r = random.Random(11)
    for _ in range(300):
        spans = [(r.randrange(2), a, a + r.randint(1, 9), 0) for a in (r.randrange(40) for _ in range(r.randint(1, 12)))]
        kept = substring.covering(spans)
        words = lambda some: {(o, j) for o, a, b, _ in some for j in range(a, b)}
        assert words(kept) == words(spans) and set(kept) <= set(spans)
        assert all(words([k for k in kept if k is not f]) != words(kept) for f in kept)


def test_seeds_are_least_of_their_windows():
    r = random.Random(13)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 2) for _ in range(n)) for n in (0, 3, 5, 9, 17, 18, 40, 200)] + ["a b " * 40]
    words, count = substring.word_hashes(texts)
    assert count.tolist() == [len(t.split()) for t in texts]
    assert np.array_equal(words, np.concatenate([substring.word_hashes([t])[0] for t in texts]))
    assert np.array_equal(words, substring.word_hashes(texts, at_once=7)[0])
    gram, at = substring.winnowed(words, count, 5, 14)
    end = np.cumsum(count)
    for i, n in enumerate(count):
        alone, places = substring.winnowed(words[end[i] - n : end[i]], np.array([n]), 5, 14)
        here = (at >= end[i] - n) & (at < end[i])
        assert np.array_equal(at[here] - (end[i] - n), places) and np.array_equal(gram[here], alone)
        if n >= 18:  # every run of 18 words holds a seed
            assert np.diff(np.r_[-1, places, n - 4]).max() <= 14
    single = np.concatenate([substring.window_hashes(words[k : k + 7], 7) for k in range(len(words) - 6)])
    assert np.array_equal(substring.window_hashes(words, 7), single) and np.array_equal(substring.window_hashes(words, 7, at_once=10), single)


def test_common_words_of_gaps():
    r = random.Random(14)
    for _ in range(100):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for w in a:
            now = [0]
            for j, v in enumerate(b):
                now.append(max(now[-1], row[j + 1], row[j] + (v == w)))
            row = now
        assert substring._common(np.array(a), np.array(b)) == row[-1]


def test_both_ends_of_a_rewritten_middle(docs_of):
    r = random.Random(9)
    left, right = lines(r, 60), lines(r, 60)
    torn = lambda words: words[:18] + ["x1"] + words[18:38] + ["x2"] + words[38:]
    rows = [(1, " ".join(left + lines(r, 50) + right)), (2, " ".join(torn(left) + lines(r, 50) + torn(right)))]
    found = substring.passages(docs_of(rows)).collect()
    words = {j for x in found for j in range(x.start, x.end)}
    assert len(words & set(range(62))) >= 58 and len(words & set(range(112, 174))) >= 58

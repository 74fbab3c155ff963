"""The training-data operators against brute force, on small fixtures with odd rows."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from breakwater.llm import common, decontaminate, html_text, langid, licenses, lm_score, neardup_vectors, packing, simhash, toxicity, warc

from ..conftest import SF

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " \n\t ", "one", "Zwei Wörter", "a b c " * 3000, "\x00 \x1c odd", "12345 !!"]


def docs(spark, texts, more=()):
    """documents with a clashing extra column, a repeated row and a null id."""
    rows = [(i, t, "x", i) for i, t in enumerate([*texts, *more])]
    rows += [rows[0], (None, "a text without an id of its own", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, seed string, root long")


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()) + str(rng.randrange(60)) for _ in range(n)]


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 90)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7)]
    got, _ = common.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    want = roots({x for p in pairs if p[0] != p[1] for x in p}, pairs)
    assert {r.node: r.root for r in got.collect()} == want
    empty, _ = common.connected_components(spark.createDataFrame([], "a long, b long"))
    assert empty.count() == 0


# 8


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark):
    rng = random.Random(1)
    base = [" ".join(words(rng, 150)) for _ in range(8)]
    near = []
    for b in base:
        for _ in range(12):
            w = b.split()
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(9))
            near.append(" ".join(w))
    df = docs(spark, ODD, base + near + base[:2])
    got = simhash.simhash_components(df).collect()
    rows = df.collect()
    fps = {r.text: fingerprint(r.text) for r in rows}
    link = roots(set(fps.values()), [(a, b) for a in fps.values() for b in fps.values() if a < b and bin(a ^ b).count("1") <= 3])
    least = {}
    for r in rows:
        if r.doc_id is not None:
            k = link[fps[r.text]]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{fps[r.text]:016x}", least.get(link[fps[r.text]])) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert len(set(least.values())) < len({f for f in fps.values()})


def test_simhash_links_at_every_distance_to_three(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = list(base)
    for i, b in enumerate(base):
        for d in (1, 2, 3, 4):
            x = b
            for bit in rng.choice(64, d, replace=False):
                x ^= np.uint64(1) << np.uint64(bit)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got, _ = common.connected_components(simhash.fingerprint_links(df))
    signed = fps.view(np.int64).tolist()
    pairs = [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= 3]
    assert {r.node: r.root for r in got.collect()} == {k: v for k, v in roots({x for p in pairs for x in p}, pairs).items()}


@pytest.mark.parametrize("bits", [12, 15, 20])
def test_links_are_those_of_any_key_width(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "KEY_ROWS", 700)  # several runs of keys in a task
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8))) for s in seeds for _ in range(6)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got, _ = common.connected_components(simhash.fingerprint_links(df, bits))
    near = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    want = roots(range(len(fps)), near)
    named = {int(np.int64(r.node).view(np.uint64)): r.root for r in got.collect()}
    same = lambda a, b: fps[a] in named and fps[b] in named and named[fps[a]] == named[fps[b]]
    assert near and all(same(a, b) == (want[a] == want[b]) for a in range(len(fps)) for b in range(a))


def test_whole_keys():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(3).integers(0, 40, 1000))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(k))), pa.array(k)], ["fp", "key"]) for i in range(0, 1000, 90) if len(k := keys[i : i + 90])]
    got = list(simhash._whole_keys(iter(batches), 100))
    assert len(got) > 5 and [x for c in got for x in c[0].tolist()] == list(range(1000))
    seen = [set(c[1].tolist()) for c in got]
    assert all(not (a & b) for i, a in enumerate(seen) for b in seen[:i])
    assert list(simhash._whole_keys(iter([]), 100)) == []


def test_rows_of_a_key_stay_bounded_as_fingerprints_grow(spark):
    for n in (10**6, 10**8, 10**10, 10**11):
        bits = simhash.key_bits(n)
        assert n * simhash.rows_sent(bits) / 2**bits <= simhash.KEY_ROWS
        assert simhash.rows_sent(bits) < (65 + 2081) / 2 / 5  # of all variants
    for n in (1000, 4000, 16000):  # rows grow as the fingerprints do
        fps = spark.range(n).select(F.xxhash64("id").alias("fp"))
        assert simhash.sent_rows(fps, 12).count() == pytest.approx(n * simhash.rows_sent(12), rel=0.1)


def test_keep_one(spark):
    df = docs(spark, ["a b c d e f"] * 3 + ["other words stand here now"], [None, ""])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == {0: 1, 3: 1, 4: 1, None: 1}


def test_similar_documents_share_a_component(spark):
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        w = list(b)
        for at in (20, 70):
            w[at] = "other"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs(spark, texts, ODD)).collect()}
    assert sum(got[i + 25] == i for i in range(25)) >= 24 and all(got[i] == i for i in range(25))
    assert simhash.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_pairs_are_not_hidden_by_a_third(spark):
    # 40 pairs five bits apart in eight blocks and equal in two, where a smaller node, far from both, is equal too.
    rng = np.random.default_rng(7)
    first = rng.integers(0, 1 << 63, (40, 5), np.uint64)
    near, far = first.copy(), ~first
    near[:, 1:] ^= np.uint64(0x1F0000001F)
    far[:, 0] = first[:, 0]
    rows = [(i, *r) for i, r in enumerate(np.concatenate([far, first, near]).view(np.int64).tolist())]
    links = simhash.similar_links(spark.createDataFrame(rows, "node long, w0 long, w1 long, w2 long, w3 long, w4 long")).collect()
    assert roots(range(120), links) == {i: i - 40 if i >= 80 else i for i in range(120)}


def test_near_values():
    rng = np.random.default_rng(7)
    values = np.unique(rng.integers(0, 1 << 32, 300, np.uint32) & np.uint32(0x03000F3F))
    for byte in range(4):
        u, v = simhash._near_values(values, byte)
        mask = np.uint32(255 << 8 * byte)
        pairs = {(i, j) for j in range(len(values)) for i in range(j) if not (values[i] ^ values[j]) & mask and np.bitwise_count(values[i] ^ values[j]) <= 3}
        assert set(zip(u.tolist(), v.tolist())) == pairs


def test_links_without_any_variant_of_the_smaller_ball():
    one = np.array([0b111, 1 << 40], np.int64)
    for flips in (np.full(2, 2, np.int8), np.empty(0, np.int8)):
        a, b = simhash._links(one[: len(flips)], np.zeros(len(flips), np.int32), flips)
        assert len(a) == len(b) == 0
    none = np.empty(0, np.int64)
    assert len(simhash._similar(none, np.empty((0, simhash.LONG_WORDS), np.uint64), none)[0]) == 0


@pytest.mark.parametrize("n", [0, 1, 3])
def test_near_duplicates_of_few_rows_in_many_partitions(spark, n):
    texts = ["one short text", "another one of these short texts", "one short text"][:n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert {r.doc_id: r.component_id for r in simhash.simhash_components(df).collect()} == dict(list({0: 0, 1: 1, 2: 0}.items())[:n])
        assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 1][:n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_simhash_of_nothing(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 1


def test_decontamination(spark):
    rng = random.Random(4)
    items = [words(rng, n) for n in (40, 18, 120, 6, 13)] + [["same"] * 30]
    texts, want = [], set()
    for i, item in enumerate(items):
        swapped = [w if k % 9 != 4 or len(item) < 12 else "swapped" for k, w in enumerate(item)]
        for leak in (item, swapped):
            texts.append(" ".join([*words(rng, 60), *leak, *words(rng, 30)]).upper() + "!")
            want.add((len(texts) - 1, i))
    clean = [" ".join(words(rng, 80)) for _ in range(30)]
    bench = spark.createDataFrame([(i, " ".join(w), "extra") for i, w in enumerate(items)] + [(90, None, ""), (91, " .. ", "")], "item_id long, text string, doc_id string")
    df = docs(spark, texts, [*clean, *ODD])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in df.collect()} - {d for d, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(df, none).count() == 0


def brute_contaminated(texts, items):
    """Document and item ids, largest number of equal tokens of a window and its size, over all alignments."""
    want = {}
    for d, text in texts:
        for i, item in items:
            own, theirs = (re.findall(r"[^\W_]+", t.lower()) for t in (text, item))
            wide = min(len(theirs), decontaminate.OVERLAP)
            need = wide if wide < decontaminate.SHORT else decontaminate.SHARE * wide
            for shift in range(-len(theirs), len(own)):
                equal = [0 <= k + shift < len(own) and own[k + shift] == w for k, w in enumerate(theirs)]
                most = max((sum(equal[s : s + wide]) for s in range(len(theirs) - wide + 1)), default=0)
                if wide and most >= need:
                    want[(d, i)] = max(want.get((d, i), (0, wide)), (most, wide))
    return want


def test_decontamination_misses_no_substitution(spark):
    """Items of every length with as many substituted tokens as a window allows, anywhere, and repeated words."""
    rng = random.Random(8)
    items, texts = [], []
    for n in [*range(1, 22), 23, 30, 64, 150]:
        item = words(rng, n)
        items.append((n, " ".join(item)))
        for _ in range(6):
            wide = min(n, 16)
            at = rng.randrange(n - wide + 1)
            copy = list(item)
            for k in rng.sample(range(wide), rng.choice([0, 1, 2, 3]) if n >= 12 else rng.choice([0, 1]) if n > 1 else 0):
                copy[at + k] = f"other{rng.randrange(9)}"
            cut = copy[at : at + wide] if rng.random() < 0.5 else copy
            texts.append((len(texts), " ".join([*words(rng, rng.randrange(0, 5)), *cut, *words(rng, rng.randrange(0, 5))])))
    items += [(500, "la " * 30), (501, "la la lo " * 8), (502, "la la lo " * 8)]
    texts += [(900, "la " * 200), (901, "x " + "la lo la " * 20), (902, "la lo " * 12)]
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contaminated(texts, items)
    assert {(r.doc_id, r.item_id): (r.matched, r.compared) for r in got} == want
    assert len(want) > 80


def test_decontamination_in_blocks_and_of_nothing(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 20))) for i in range(9)]
    df = spark.createDataFrame([(i, f"start {t} end") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.contaminated(df, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK", 40)
    assert sorted(decontaminate.contaminated(df, bench).collect()) == whole and len(whole) == 9
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


# 2

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div class="menu"><a href=/>Home</a><a href=/x>News</a></div><div class=cookie-notice>We use cookies</div>
<div class="w1"><h1>Title %d &amp; more</h1><p>First   paragraph %s of&nbsp;some length that counts as an article, with words.</p><p>Second <b>one</b> %s<br>with a <a href="#">link</a> and many other words to read on.</p></div>
<div class="w2"><h3>Latest</h3><ul><li><a href=1>One %d</a></li><li><a href=2>Two</a></li></ul></div><div id="comments"><p>Nice post %d!</p></div><form><input><label>Mail</label></form><script>var t="<p>no</p>";</script><div>Copyright 2020 Example Inc.</div></body>"""


def test_main_text(spark):
    pages = [(i, f"http://h.example/{i}", PAGE % (i, f"w{i}", f"y{3 * i}", i, i)) for i in range(20)]
    pages += [(100, "http://one.example/a", "<article><header><h1>Only</h1></header><p>page</p><aside>no</aside></article><footer>f</footer>"), (101, None, None), (102, "http://x.example", ""), (103, "http://x.example", "plain &lt;text&gt;"), (0, pages[0][1], pages[0][2])]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")).collect()}
    for i in range(20):
        assert got[i].text.split("\n") == [f"Title {i} & more", f"First paragraph w{i} of some length that counts as an article, with words.", f"Second one y{3 * i} with a link and many other words to read on."]
        assert got[i].n_chars == len(got[i].text)
    assert got[100].text == "Only\npage" and got[101].text == got[102].text == "" and got[103].text == "plain <text>"


class NoTemplate:
    def __init__(self, pages):
        self.root = {}


def article(page):
    import html

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_template_decides_without_names():
    """On the hosts of the table, with all names of elements and classes hidden, the template alone finds every article; pages by themselves don't show it."""
    import pyarrow.parquet as pq

    hosts = {}
    for r in pq.read_table(SF.replace("0.001", "0.01") + "/pages.parquet").to_pylist():
        hosts.setdefault(re.sub(r"^\w+://([^/?#]*).*", r"\1", r["url"]), []).append(r["html"])
    hosts = {h: p for h, p in hosts.items() if len(set(p)) >= html_text.LEAST}
    right = lambda **how: [["\n".join(b) for b in html_text.extract(p, names=False, **how)] == [article(x) for x in p] for p in hosts.values()]
    assert len(hosts) > 3 and all(right()) and not all(right(template=NoTemplate))


NEUTRAL = """<html><body><div class=k1>%s</div><div class=k2><div class=k3><h2>%s</h2>%s</div><div class=k4>More on this site <b>now</b> %s</div></div><div class=k5><span>Written with care in our office. All prices in euro.</span></div></body></html>"""


def test_nested_classes_of_a_neutral_host(spark):
    """Records of links, of paragraphs, and of cards nested in each other; constant words; a page with more of the rest than of the article."""
    rng = random.Random(5)
    pages, want = [], []
    for i in range(30):
        links = "".join(f"<p><a href=/{k}>{' '.join(words(rng, 6))}</a></p>" for k in range(rng.randrange(5, 30)))
        body = [" ".join(words(rng, rng.randrange(15, 40))) for _ in range(1 if i == 7 else rng.randrange(3, 7))]
        cards = "".join(f"<div class=c><div class=d><a href=/>{' '.join(words(rng, 4))}</a></div><div class=e>Read on</div>{'<i>tag</i>' * rng.randrange(4)}</div>" for _ in range(rng.randrange(2, 9)))
        title = " ".join(words(rng, 5))
        pages.append((i, f"http://n.example/{i}", NEUTRAL % (links, title, "".join(f"<p>{b}</p>" for b in body), cards)))
        want.append("\n".join([title, *body]))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(30)] == want
    paths = html_text.Paths()
    template = html_text.Template([html_text.Page(h, paths) for _, _, h in pages])
    assert len(template.root) >= 16 and len(template.sizes) >= 3
    assert any(p[1] >= 0 for p in template.parents)  # a record inside a record
    assert [html_text.extract([h for _, _, h in pages], template=NoTemplate)[i] for i in range(30)] != [w.split("\n") for w in want]


def test_main_text_of_deep_and_long_pages(spark):
    deep = "<article>" + '<div class="c">x ' * 60_000 + "</div>" * 60_000 + "</article>"
    long = "<article>" + "".join(f"<p>word{i} and more" for i in range(60_000)) + "</article>"
    rows = [(i, "http://d.example/", h) for i, h in enumerate([deep, long, "<" * 30_000, "<div " * 20_000, "</div>" * 20_000, "<a><p>" * 20_000, "&#0;&lt", "<!-- never closed", "<script>also not"])]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "\n".join(["x"] * 60_000) and got[1].text.count("\n") == 59_999
    assert len(got) == len(rows) and html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def named_page(rng, name, i):
    text = [" ".join(words(rng, 30)) for _ in range(5)]
    menu = "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(6))
    comments = f"<div class=comments><p>{' '.join(words(rng, 25))}</p><p>{' '.join(words(rng, 9))}</p></div>"
    page = f"<html><head><title>{i}</title></head><body><div class=site-header><ul class=menu>{menu}</ul></div><div class='{name}'><h1>Title {i}</h1>{''.join(f'<p>{t}</p>' for t in text)}</div><div class=sidebar><a href=/x>{' '.join(words(rng, 6))}</a></div>{comments}<div class=site-footer>All rights kept 2020. A company of some town.</div></body></html>"
    return page, [f"Title {i}", *text]


@pytest.mark.parametrize("name", ["content", "post search-engines", "entry market-share", "side-effects", "article-body notices-law", "topic-legal", "content comment-culture", "comment", "legal", "k1"])
def test_names_never_close_the_article(name):
    """Whole articles, and only they, from hosts of many, few and single pages, whatever the container is called."""
    rng = random.Random(4)
    for n in (8, 3, 1):
        made = [named_page(rng, name, i) for i in range(n)]
        if name != "k1" or n > 1:
            assert html_text.extract([p for p, _ in made]) == [w for _, w in made], (name, n)
    mixed = [named_page(rng, f"{name} topic{i}", i) for i in range(9)]
    assert html_text.extract([p for p, _ in mixed]) == [w for _, w in mixed]


def test_comments_longer_than_the_article_stay_out():
    rng = random.Random(6)
    made = [named_page(rng, "text", i) for i in range(7)]
    long = [p.replace("<div class=comments>", "<div class=comments>" + "".join(f"<p>{' '.join(words(rng, 40))}</p>" for _ in range(12))) for p, _ in made]
    assert html_text.extract(long) == [w for _, w in made]


def test_copies_of_one_article_keep_it():
    page, want = named_page(random.Random(8), "content", 1)
    copies = [page.replace("Link 0", f"Link {i}") for i in range(8)]
    assert html_text.extract(copies) == [want] * 8


def test_unclosed_raw_elements_end_before_the_next_block():
    text = "<p>One whole paragraph of text.</p><p>And another one.</p>"
    want = [["One whole paragraph of text.", "And another one."]]
    for raw in ("<svg><path d='M0'>", "<svg/>", "<svg>icon</svg>", "<canvas>none", "<iframe src=x>", "<script>var x = 1 < 2;", "<style>p {color: red}", "<noscript>off</noscript>"):
        assert html_text.extract([f"<body>{raw}{text}</body>"]) == want, raw


def test_rows_of_one_key_are_spread(spark, monkeypatch):
    """Repeated and null keys are dealt like others; long pages make more groups."""
    rng = random.Random(9)
    rows, want = [], []
    for i in range(400):
        page, text = named_page(rng, "content", i)
        rows.append((None, None, page) if i % 2 else (7, "http://one.example/", page))
        want.append("\n".join(text))
    monkeypatch.setattr(html_text, "GROUP", 40)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    assert sorted(r.text for r in html_text.main_text(df).collect()) == sorted(want)
    monkeypatch.setattr(html_text, "GROUP_CHARS", 40_000)
    assert sorted(r.text for r in html_text.main_text(df).collect()) == sorted(want)


def test_main_text_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    for r in df.collect():
        assert got[r.page_id] == article(r.html)


# 3


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "LEAF", 64)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(260, 16))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.08, base[:10], np.repeat(base[:1], 90, 0) + rng.normal(size=(90, 16)) * 0.02])
    labels = [int(i % 2) for i in range(260)] + [int(i % 2) for i in range(60)] + [int(i % 2) for i in range(10)] + [0] * 90
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], labels[i], i) for i in range(len(x))]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, rows[0][1], None), (905, [], 0), (906, rows[0][1] + [0.0], 0), (907, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows + [(*o, 0) for o in odd], "vec_id long, embedding array<float>, label int, leaf long")
    got = {r.vec_id: r for r in neardup_vectors.near_vectors(df).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    found, true = sum(got[i].n_links for i in range(len(x))), int(near.sum())
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x))) and found >= 0.97 * true
    want = roots(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    assert sum(got[i].component_id == want[i] for i in range(len(x))) >= 0.97 * len(x)
    assert all(got[o[0]].n_links == 0 and got[o[0]].component_id == o[0] and got[o[0]].kept for o in odd)
    assert neardup_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_any_length(spark):
    """Squares of these components over- or underflow a double."""
    rows = [(i, [s * x for x in (3.0, 4.0, 0.1 * i)], 1) for i, s in enumerate([1e200, 1e-200, 1.0, 1e-310])] + [(9, [-3e200, 4e200, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 9: (0, 9)}


def test_leaves_are_bounded_and_rows_grow_little_faster_than_the_input(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "LEAF", 100)
    rng, made = np.random.default_rng(3), {}
    for n in (1000, 4000):
        rows = [(i, [float(x) for x in rng.normal(size=48)], i % 2) for i in range(n)]
        df = spark.createDataFrame(rows, "node long, v array<double>, label int").selectExpr("node", "v", "struct(label, size(v) dim) grp")
        got = neardup_vectors.leaves(df)
        counts = [r["count"] for r in got.groupBy("leaf").count().collect()]
        made[n] = sum(counts)
        assert max(counts) <= 200 and got.select("node").distinct().count() == n  # a leaf that four directions in a row do not part may stay larger
    assert made[4000] <= 4 * 2.5 * made[1000]


# 4


def test_toxicity(spark):
    rng = random.Random(6)
    texts = [" ".join(words(rng, rng.randrange(20, 200))) for _ in range(500)]
    for i in range(0, 500, 5):
        w = texts[i].split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["vilefoo", "vilebar", "grossbaz"]))
        texts[i] = " ".join(w)
    df = docs(spark, texts, ODD)
    labels = spark.createDataFrame([(i, int(i % 7 > 0), int(i % 5 == 0), "x") for i in range(300)] + [(None, 1, 1, ""), (3, 1, None, "")], "doc_id long, quality int, toxic int, text string")
    found = [r.doc_id for r in toxicity.rejected(df, labels).collect()]
    want = set(range(0, 500, 5))
    assert len(set(found) & want) >= 95 and len(set(found) - want) <= 2
    chain = toxicity.learn(df, labels, toxicity.default_categories())
    assert len(chain.weights) == 2 and len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert toxicity.score(df, chain).count() == df.count()
    assert toxicity.score(df.limit(0), chain).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.rejected(df, none).count() == 0
        p = toxicity.score(df, toxicity.learn(df, none, toxicity.default_categories())).collect()
        assert all(r.p_toxic == 0 for r in p) and len(p) == df.count()
    assert toxicity.rejected(df.limit(0), labels).count() == 0


def test_toxicity_learns_rare_words_beside_many_frequent_ones(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8))
    frequent, rare = [word() for _ in range(60)], [word() for _ in range(20)]
    texts = [words(rng, 40) for _ in range(1000)]
    for i in range(200):
        texts[i] += rng.sample(frequent, 6) if i < 160 else [rare[(i + 5 * k) % 20] for k in range(4)]
    texts += [words(rng, 40) + [rare[i], rare[i - 7]] for i in range(20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 200)) for i in range(1000)], "doc_id long, quality int, toxic int")
    found = {r.doc_id for r in toxicity.rejected(df, labels).collect()}
    assert found == {*range(200), *range(1000, 1020)}


def test_chain_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        own = rng.sample(vocabulary, 12)
        toxic, low = rng.random() < 0.3, rng.random() < 0.4
        own += ["vile"] * (toxic and rng.random() < 0.9) + ["buynow"] * (low and rng.random() < 0.8) + ["buynow"] * (rng.random() < 0.05)
        rows.append((i, " ".join(own)))
        labels.append((i, int(not low), int(toxic or (low and rng.random() < 0.3))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.default_categories())

    grams = [{f"<{w}>"[i:j] for w in t.split() for i in range(len(w) + 2) for j in range(i + 1, len(w) + 3) if j - i == len(w) + 2 or 3 <= j - i <= 5} for _, t in rows]
    targets = [np.array([1.0 - q for _, q, _ in labels]), np.array([float(t) for *_, t in labels])]
    held = Counter(g for d in grams for g in d)
    chosen: set[str] = set()
    for y in targets:
        for g, n in held.items():
            k, expect = sum(y[i] for i, d in enumerate(grams) if g in d), n * y.mean()
            if n >= toxicity.LEAST and (k - expect) ** 2 * (1 / expect + 1 / (n - expect)) >= toxicity.LEAST_CHI:
                chosen.add(g)
    assert set(chain.ids) == chosen and chosen

    def newton(x, y, penalty):
        """The minimum of the penalised loss by exact Newton steps with dense matrices."""
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        return w

    names = sorted(chosen)
    x = np.array([[g in d for g in names] for d in grams], float)
    earlier = np.empty((400, 0))
    final = np.empty((400, 0))
    for y in targets:
        both = np.hstack([x, earlier, np.ones((400, 1))])
        penalty = np.r_[np.full(both.shape[1] - 1, toxicity.RIDGE), 1e-6]
        w = newton(both, y, penalty)
        final = np.hstack([final, 1 / (1 + np.exp(-np.hstack([x, final, np.ones((400, 1))]) @ w))[:, None]])
        unseen = np.zeros(400)
        for f in range(toxicity.FOLDS):
            own = np.arange(400) % toxicity.FOLDS == f
            unseen[own] = 1 / (1 + np.exp(-both[own] @ newton(both[~own], y[~own], penalty)))
        earlier = np.hstack([earlier, unseen[:, None]])
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.score(df, chain).collect()}
    np.testing.assert_allclose(np.array([got[i] for i in range(400)]), final, atol=0.005)


def test_repeated_ids_teach_once(spark):
    rows = [(i, "vile words" if i % 5 == 0 else "good words") for i in range(100)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows + [(0, "zeal")] * 500 + [(1, None)] * 500, "doc_id long, text string")
    learn = lambda df: toxicity.learn(df, labels, toxicity.default_categories())
    a, b = learn(once), learn(often)
    assert a.ids == b.ids and all((u is None and v is None) or np.allclose(u, v) for u, v in zip(a.weights, b.weights))


def test_toxicity_reads_long_runs_to_their_end():
    run = "ab" * 60 + "vilefoo"
    assert {"vile", "foo>", f"<{run}>"} <= set(toxicity.features_of(run))
    ids = {f: i for i, f in enumerate(["vile", "zzz"])}
    assert toxicity.Seen(ids)(f"some {run} text") == [0]


# 5


def test_language(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.split_and_identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    profiles = langid.learn(df)
    odd = {r.doc_id: r for r in langid.identify(docs(spark, ODD), profiles).collect()}
    assert [odd[i].lang_pred == "und" for i in (0, 1, 2, 3, 7)] == [True, True, True, False, True]
    assert langid.learn(df.limit(0)).predict("text") == ("und", 0.0)


def test_out_of_place_distance():
    p = langid.Profiles({"a": [int(k) for k in langid.ranked(*langid.grams("aba abba"))], "b": [int(k) for k in langid.ranked(*langid.grams("zyz zzy"))]})
    mine = langid.ranked(*langid.grams("abba")).tolist()
    theirs = langid.ranked(*langid.grams("aba abba")).tolist()
    apart = sum(abs(i - theirs.index(k)) if k in theirs else langid.PROFILE for i, k in enumerate(mine))
    assert p.predict("abba") == ("a", 1 - apart / (langid.PROFILE * len(mine)))


# 6


def brute_scores(texts, order, backoff):
    ws = [(t or "").encode().split() for t in texts]
    counts = [Counter(tuple(w[i : i + k]) for w in ws for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    total, out = sum(map(len, ws)), []
    for w in ws:
        own = [Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
        c = lambda g: counts[len(g) - 1][g] - own[len(g) - 1][g] if g else total - len(w)  # noqa: B023, E731
        s = 0.0
        for i in range(len(w)):
            n = min(order, i + 1)
            for k in range(n, 0, -1):
                g = tuple(w[i + 1 - k : i + 1])
                if c(g) > 0 and c(g[:-1]) > 0:
                    s += math.log10(c(g) / c(g[:-1])) + (n - k) * math.log10(backoff)
                    break
            else:
                s += n * math.log10(backoff) - math.log10(max(c(()), 1))
        out.append(s)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, order, tmp_path, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH", 300)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(60)] + ["unseen words here", *ODD]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, bucket int").repartition(3).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in lm_score.lm_scores(spark.read.parquet(str(tmp_path / "d")), order=order).collect()}
    for i, s in enumerate(brute_scores(texts, order, 0.4)):
        assert got[i].log10_score == pytest.approx(s, abs=1e-6)
        assert (got[i].mean_log10 is None) == (got[i].n_tokens == 0)


def test_marks_and_packing_of_ngrams():
    a, b = np.array([1, 2, 3, 9], np.uint64), np.array([1, 2, 4, 8], np.uint64)
    assert lm_score._mark(a) != lm_score._mark(b)  # as many, and of equal sum
    assert (lm_score._mark(a[:2]) + lm_score._mark(a[2:]) - lm_score._mark(a)) % (1 << 64) == 0
    for n in (0, 1, 31, 32, 5000):
        x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert (lm_score._unpack(lm_score._pack(x), np.uint64) == x).all()


def test_documents_that_change_between_readings_are_refused(spark):
    """Other texts of as many n-grams when read again."""
    df = spark.range(40).selectExpr("id doc_id", "concat('w', reflect('java.util.UUID', 'randomUUID'), ' x') text")
    with pytest.raises(Exception, match="not the same when read again"):
        lm_score.lm_scores(df).collect()


def test_lm_scores_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert lm_score.lm_scores(spark.read.parquet(str(tmp_path / "d"))).count() == 0


# 7


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(9)
    df = docs(spark, [" ".join(words(rng, rng.randrange(1, 900))) for _ in range(120)], [*ODD, "x  y\n\n<|endoftext|> z"])
    rows = packing.pack_documents(df, TOKENIZER).collect()
    want = Counter()
    for r in df.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for at in range(0, len(ids), 1024):
            piece = ids[at : at + 1024]
            want[(r.doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) / (1024 * len(seqs)) > 0.9


def test_tokens_of_random_unicode():
    """Ids equal those of the tokenizer's own library for white space, controls, marks, emoji and unassigned points anywhere."""
    from tokenizers import Tokenizer

    own, ours, rng = Tokenizer.from_file(TOKENIZER), packing.Tokens(TOKENIZER), random.Random(12)
    odd = [*" \t\n\r\x0b\x0c\x00\x1c\x85\xa0\u1680\u2003\u2028\u200b\u3000\ufeff", "\u0301", "\u0e33", "\u0661", "\u2167", "\xbd", "\U0001f469\u200d\U0001f680", "\ufffd", "\U000e0100", "'s", "'LL", "<|", "\u2019", "__", "..."]
    for _ in range(1500):
        parts = [rng.choice(odd) if rng.random() < 0.5 else chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FFF), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(30))]
        text = "".join(parts)
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, ascii(text)


def test_placing_keeps_all_limits():
    rng = np.random.default_rng(1)
    need = np.stack([rng.integers(1, 1025, 700), rng.integers(1, 9, 700), rng.integers(0, 600, 700)], axis=1)
    limits = np.array([1024, 16, 800.0])
    bins = packing.place(need, limits)
    assert bins.min() == 0 and all((need[bins == b].sum(axis=0) <= limits).all() for b in range(bins.max() + 1))
    assert bins.max() + 1 <= 1.25 * (need / limits).sum(axis=0).max()
    assert len(set(packing.place(np.array([[2000, 1, 1], [5, 1, 1], [2000, 1, 1]]), limits))) == 3


def test_pack_examples(spark):
    df = spark.createDataFrame([(i, i % 500 + 1, 1, i % 100) for i in range(300)] + [(999, None, None, None)], "row long, tokens int, segments int, loss int")
    got = packing.pack_examples(df, ["tokens", "segments", "loss"], [1024, 8, 400]).toPandas()
    sums = got.groupby("sequence_id")[["tokens", "segments", "loss"]].sum().max()
    assert len(got) == 301 and (sums <= [1024, 8, 400]).all()
    assert packing.pack_examples(df.limit(0), ["tokens"], [1024]).count() == 0
    assert packing.pack_documents(docs(spark, ["a"]).limit(0), TOKENIZER).count() == 0


# 9


def test_licenses(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [f"words before\n{notice}\nwords after", notice.upper(), "licensed under the apache something else entirely", "Released under the MIT License", "x\nReleased under the  MIT license!\nReleased under the MIT License."]
    got = {(r.doc_id, r.license_id): r for r in licenses.license_scan(docs(spark, texts, ODD)).collect()}
    assert set(got) == {(0, "Apache-2.0"), (1, "Apache-2.0"), (3, "MIT"), (4, "MIT")}
    assert got[(4, "MIT")].n_places == 2 and got[(1, "Apache-2.0")].dice == 1.0 and got[(0, "Apache-2.0")].n_places == 2  # a row repeats
    assert licenses.license_scan(docs(spark, texts).limit(0)).count() == 0


def test_whole_license_texts_in_long_files(spark):
    """Wrapped at 60 columns behind comment signs, in the middle of a long text, across the cut of pieces."""
    rng = random.Random(4)
    rows, want = [], set()
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        lines, line = [], " *"
        for w in text.split():
            if len(line) + len(w) > 60:
                lines.append(line)
                line = " *"
            line += f" {w}"
        body = "\n".join([*lines, line])
        before = licenses.STEP - 40 if k % 2 else rng.randrange(900)
        rows.append((k, f"/* Copyright 2021 A. Person\n{' '.join(words(rng, before))}\n{body}\n*/ {' '.join(words(rng, 700))}"))
        want.add((k, name))
    got = {(r.doc_id, r.license_id): r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= set(got) and all(got[w].dice == 1.0 for w in want)
    assert {k for k, _ in set(got) - want} <= {k for k, (n, _) in enumerate(licenses.TEMPLATES) if n[:3] in ("BSD", "GPL", "LGP", "AGP", "MIT", "CC-", "MPL", "Apa")}


def test_size_bounds_lose_nothing(spark, monkeypatch):
    """Against every window of every text, with small pieces."""
    monkeypatch.setattr(licenses, "STEP", 7)
    rng = random.Random(2)
    templates = [(n, t) for n, t in licenses.TEMPLATES if len(t) < 300]
    norm = lambda t: re.findall(r"[^\W_]+", t.lower())
    vocabulary = sorted({w for _, t in templates for w in norm(t)})
    texts = []
    for _ in range(60):
        w = [w for _ in range(rng.choice([1, 1, 2])) for w in norm(rng.choice(templates)[1])]
        for _ in range(rng.randrange(5)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(vocabulary))
        texts.append(" ".join(w[rng.randrange(2) :]))
    want = {}
    for i, text in enumerate(texts):
        w = norm(text)
        pairs = list(zip(w, w[1:]))
        for name, template in templates:
            t = norm(template)
            grams, last = set(zip(t, t[1:])), None
            for s, p in enumerate(pairs):
                own = set(pairs[s : s + len(t) - 1])
                d = 2 * len(own & grams) / (len(own) + len(grams))
                if p in grams and d >= licenses.DICE:
                    best, n = want.get((i, name), (0, 0))
                    want[(i, name)] = (max(best, d), n + (last is None or 2 * (s - last) >= len(t)))
                    last = s
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.license_id): (r.dice, r.n_places) for r in licenses.license_scan(df, templates=templates).collect()} == want and len(want) > 60


# 10


def test_warc_round_trip(spark):
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(60_000))
    rows = [(3, "u\r\n%41", "same"), (1, None, "same"), (None, "z", "same"), (2, "b", None), (5, "c", ""), (6, "d", "é" * 3_000_000), (7, "e", noise), (8, "f", noise), (9, "g", "\x1f\x8b\x08 WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    archives = warc.write_archives(df, common.new_path(spark, "warc"))
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = set()
    for page, url, html in rows:
        first = min(p for p, _, h in rows if p is not None and (h or "") == (html or ""))
        want.add((page, url, len((html or "").encode()), sha(html), "response" if page == first else "revisit", None if page == first else first))
    for split in (50, 997, 1 << 23):
        got = warc.read_archives(spark, archives, True, split).collect()
        assert len(got) == len(rows)
        assert {(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
        assert {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}[6] == ("é" * 3_000_000).encode()
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("split", [200, 1 << 23])
def test_damaged_members_are_reported(spark, tmp_path, split):
    """One flipped byte anywhere fails the reading, or costs that record only where asked for."""
    rng = random.Random(2)
    rows = [(i, f"u{i}", "".join(rng.choice("abcdefgh <p>") for _ in range(300))) for i in range(4)]
    [(path, size)] = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}")
    data = open(path.removeprefix("file://"), "rb").read()
    starts = [0]
    while starts[-1] < size:
        d = zlib.decompressobj(31)
        d.decompress(data[starts[-1] :])
        starts.append(size - len(d.unused_data))
    for k in (0, 1, 3):
        for at in (starts[k] + 1, starts[k] + 60, starts[k + 1] - 30, starts[k + 1] - 6):
            broken = bytearray(data)
            broken[at] ^= 0x55
            read = lambda a, n: bytes(broken[a : a + n])  # noqa: E731, B023
            ranges = [(a, min(a + split, size)) for a in range(0, size, split)]
            with pytest.raises(warc.Damaged):
                for r in ranges:
                    list(warc.members(read, *r))
            left = [warc.parse(m)[0] for r in ranges for m in warc.members(read, *r, skip_damaged=True)]
            assert left == [i for i in range(4) if i != k]


def test_every_operator_has_a_query():
    from breakwater.llm import queries

    assert {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES} == set(range(1, 14))
    assert json.dumps(sorted(queries.ORACLES)) and set(queries.ORACLES) <= set(queries.QUERIES)

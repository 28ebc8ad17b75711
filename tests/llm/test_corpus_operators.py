"""Each operator against a brute-force version, with nulls, empty and repeated rows, clashing columns and empty tables."""

import base64
import gzip
import hashlib
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from exposura import session
from exposura.llm import ann, bpe, components, decontaminate, html_text, lm_scoring, ngram_join, ordering, secrets, substrings, toxicity, url_filter
from exposura.llm.queries import vocabulary_path

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi "
         "omega Über straße naïve 数据 one two three four five six seven eight nine ten").split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(rng, count=60):
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(count)]
    for i in range(count, count + 25):  # near and exact copies
        words = rows[rng.randrange(count)][1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return [*rows, (900, None), (901, ""), (902, " \t\n"), (903, "ONE Two"), (904, "one two"), (905, "x" * 5000)]


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    return df.withColumns({c: F.lit("other") for c in ("score", "n_shingles", "component_id", "row", "ids", "anchor", "names", "host")})


# --- n-gram join


def jaccard_groups(rows, words, percent):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("window,block,bits", [(32, 2048, 18), (1, 4, 2)])
def test_ngram_join(spark, monkeypatch, window, block, bits):
    rows = corpus(random.Random(1))
    rows += [(1000 + i, rows[0][1] + f" tail{i}") for i in range(12)]
    monkeypatch.setattr(ngram_join, "WINDOW", window)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    out = ngram_join.ngram_join(clashing(table(spark, [*rows, rows[3], (None, "one two three four five")])))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()]
    expected = jaccard_groups(rows, 4, 85)
    assert sorted(x for x in got if x[0] is not None) == sorted([(d, *v) for d, v in expected.items()] + [(rows[3][0], *expected[rows[3][0]])])
    assert [x for x in got if x[0] is None] == [(None, 2, None)]


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(table(spark, [])).collect() == []
    assert [tuple(r) for r in ngram_join.ngram_join(table(spark, [(4, None)])).collect()] == [(4, 0, 4)]


def test_common_ngrams_connect_no_other_documents(spark):
    """one n-gram of many documents made one candidate set of them all, which the exact product cuts into copies."""
    def own(doc):
        return [1000 * doc + i for i in range(55)]

    apart = [(doc, 400, [*own(doc), *([-1, -2] if doc % 2 else [-2])]) for doc in range(200)]
    copies = [(1000 + doc, 400 + doc % 60, [*range(-100, -39), 1000 * (1000 + doc)]) for doc in range(60)]
    leads = spark.createDataFrame(apart + copies, "doc_id long, n_shingles long, lead array<long>").repartition(3)
    found = {r.id: r.component for r in components.components(ngram_join.candidate_pairs(leads, 85)).collect()}
    assert found == {1000 + doc: 1000 for doc in range(60)}


def test_ngram_join_where_most_ngrams_are_common(spark, monkeypatch):
    """near copies of all sizes are found when hardly a group of n-grams is narrow; short and long sets, few and many copies."""
    monkeypatch.setattr(ngram_join, "WINDOW", 2)
    rng, rows, phrases = random.Random(8), [], [prose(random.Random(i), 6) for i in range(4)]
    for base in range(30):
        words = prose(rng, rng.choice([4, 9, 30, 70, 150, 300])).split()
        for _ in range(rng.choice([1, 2, 5, 9])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            more = rng.choice([0, 0, len(words) // 20, len(words) // 7])
            copy += [rng.choice(WORDS) for _ in range(more)] + rng.choice(phrases).split() * (len(words) > 20)
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(table(spark, rows)).collect()}
    assert got == jaccard_groups(rows, 4, 85) and len({c for _, c in got.values()}) < len(rows) - 20


@pytest.mark.parametrize("bits", [1 << 24, 1 << 15, 1])
def test_joins_with_few_keys_shuffle_only_what_may_meet(spark, monkeypatch, bits):
    monkeypatch.setattr(ordering, "MAP_BITS", bits)
    rows = spark.range(-3000, 3000).selectExpr("cast(if(id % 100 = 0, null, id) as int) as k", "id as `an id`")
    few = session.materialize(spark.range(0, 2500, 9).selectExpr("id as k", "id * 2 as v"))
    assert_same(ordering.join_few(rows, few, "k"), rows.join(few, "k"))
    assert_same(ordering.drop_few(rows, few, "k"), rows.join(few, "k", "left_anti"))
    assert ordering.drop_few(rows, few.limit(0), "k").count() == 6000 and ordering.join_few(rows, few.limit(0), "k").count() == 0
    if bits > 1 << 20:
        assert ordering._mark_partners(rows, few, "k").where("_may").count() < 300


def assert_same(got, expected):
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (300, 299)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- decontamination


def contained(docs, items, percent=80):
    def grams(text, n):
        w = (text or "").encode().lower().split()
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}

    out = {}
    for item, text in items:
        n = min(5, len((text or "").encode().lower().split()))
        if n:
            own = grams(text, n)
            for doc, body in docs:
                shared = len(own & grams(body, n))
                if doc is not None and 100 * shared >= percent * len(own):
                    out[doc, item] = (len(own), shared)
    return out


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([2, 4, 5, 9, 20, 40, 90]))) for i in range(40)] + [(99, None), (98, "")]
    docs = corpus(rng)
    for i in range(30):  # items inside long texts, some of them with a word changed, and one text with many
        words = rng.choice(items[:40])[1].split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "CHANGED"
        docs.append((2000 + i, f"{prose(rng, 400)} {' '.join(words).upper()} {prose(rng, 300)}"))
    docs.append((3000, " . ".join(t for _, t in items[:40])))
    out = decontaminate.contained_items(clashing(table(spark, [*docs, docs[0], (None, items[8][1])])), table(spark, items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in out.collect()} == contained(docs, items)
    assert decontaminate.contained_items(table(spark, docs), table(spark, [], "item_id long, text string")).collect() == []
    assert decontaminate.contained_items(table(spark, []), table(spark, items, "item_id long, text string")).collect() == []


def test_search_misses_no_pair_at_the_threshold():
    for item in range(8):
        for part in range(max(0, item - 1), 12):
            bands = decontaminate.bands_for(item, part)
            assert 0 <= bands <= decontaminate.BANDS
            if bands and part >= item:
                u, q = 2 ** (part + 1) - 1, 2 ** item
                assert (1 - 0.8 * q / (u + 0.2 * q)) ** bands <= 1.01e-9


# --- nearest neighbours


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_CELLS", 16 * 300)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 16))
    vectors[100:130] = vectors[100]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([*rows, rows[7]], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(ann.nearest(clashing(df), df.where("vec_id % 20 = 0"), 20).collect()):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        score = (vectors * vectors[q]).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - score[f[1]]) < 1e-12 for f in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({f[1] for f in found} & set(order))
    assert hits / (45 * 20) >= 0.9
    few = spark.createDataFrame(rows[:4], df.schema)
    assert [(r.query_id, r.vec_id) for r in sorted(ann.nearest(few, few.where("vec_id = 0"), 20).collect())] == [
        (0, int(i)) for i in np.lexsort((np.arange(4), -(vectors[:4] @ vectors[0]))) if i
    ]
    assert ann.nearest(df.limit(0), df).collect() == [] and ann.nearest(df, df.limit(0)).collect() == []


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (500, 16), dtype=np.uint8)
    codes[50:100] = codes[:50] ^ (rng.random((50, 16)) < 0.2).astype(np.uint8)
    for radius in (0, 3, 17, 60, 128):
        found = ann.BlockIndex(codes).within(codes[:50], radius)
        assert (found == (np.bitwise_count(codes[:50, None] ^ codes[None]).sum(axis=2) <= radius)).all()


# --- secrets


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


SECRET = 'token="abcdefgh12345678"'


@pytest.mark.parametrize("wrap", [
    lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
    lambda s: urllib.parse.quote(base64.b64encode(urllib.parse.quote(base64.b64encode(s.encode()).decode(), safe="").encode()).decode(), safe=""),
])
def test_secrets_in_layers(wrap):
    text = "é start " + wrap(SECRET) + " end"
    base, found, layers = secrets.find_secrets(text)
    assert not [s for s in base if s[1] == 0] and layers
    assert any(k == 0 and 8 <= a and b <= len(text) - 4 and b - a >= len(wrap(SECRET)) - 4 for a, k, b in found)


def test_secrets_end_and_keep_the_base(spark):
    rng = random.Random(5)
    parts = ["token=secret=abcdefghijklm", "Password : 'hunter2hunter2x'", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "0123456789abcdefF", "api_key:", "APIKEY=",
             "%41%4b", "\\u0041", "é", " ", "=", "ſecret=abcdefghijklmnop", "%25%34%31", base64.b64encode(b"token: abcdefghijklmnop").decode()]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for text in texts:
        base, found, _ = secrets.find_secrets(text)
        assert base == plain_secrets(text) and set(base) <= set(found) and found == sorted(set(found))
    rows = list(enumerate(texts[:50])) + [(60, None), (61, ""), (61, "")]
    out = {r.doc_id: r for r in secrets.scan_secrets(clashing(table(spark, rows))).collect()}
    for doc, text in rows:
        assert [(s.start, secrets.KINDS.index(s.kind), s.end) for s in out[doc].base_secrets] == plain_secrets(text or "")
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(table(spark, [*rows, (70, "a token=abcdefghijklmn b")])).collect()}
    assert masked[60] is None and masked[61] == "" and masked[70] == "a [SECRET] b"
    assert secrets.scan_secrets(table(spark, [])).collect() == []


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_an_encoded_secret_at_two_places(spark, pack):
    blob = base64.b64encode(pack(SECRET.encode())).decode()
    text = f"é first {blob} then\n{blob} end"
    rows = secrets.scan_secrets(table(spark, [(1, text)])).collect()
    places = [m.start() for m in re.finditer(re.escape(blob), text)]
    found = [(s.start, s.end) for s in rows[0].secrets if s.kind == "assign"]
    assert len(places) == 2 and [any(a <= at + 2 and b >= at + len(blob) - 4 for a, b in found) for at in places] == [True, True]
    masked = secrets.mask_secrets(table(spark, [(1, text)])).collect()[0].text
    assert masked.count("[SECRET]") == 2 and blob[:24] not in masked


BLOB = base64.b64encode(SECRET.encode()).decode()
PACKED = gzip.compress(random.Random(3).randbytes(90).hex(" ").encode() + SECRET.encode())


@pytest.mark.parametrize("coded", [
    "https://h/p/" + BLOB, "/" + BLOB, "id-" + BLOB, "ab" + BLOB, base64.encodebytes(b"words " * 8 + SECRET.encode() + b" words" * 20).decode(),
    base64.encodebytes(PACKED).decode(), "x/" + base64.b64encode(PACKED).decode(), *[base64.b64encode(f"{c} {SECRET}".encode()).decode() for c in "\u00a0\u3000\ufeff\0"],
    base64.b64encode(b"\xff" + SECRET.encode()).decode(), "%ff" + "".join(f"%{b:02x}" for b in SECRET.encode()), "".join(f"\\x{b:02x}" for b in b"\xff" + SECRET.encode()),
    "".join(f"%{b:02x}" for b in PACKED), urllib.parse.quote(PACKED), "".join(f"\\x{b:02x}" for b in PACKED), repr(PACKED),
    base64.b64encode(gzip.compress(b"one member") + PACKED).decode(),
])
def test_secrets_in_layers_that_do_not_stand_alone(coded):
    text = "start " + coded + " end"
    base, found, _ = secrets.find_secrets(text)
    assert not [s for s in base if s[1] == 0] and any(k == 0 and 6 <= a < b <= len(text) - 4 for a, k, b in found)
    assert all(6 <= a < b <= len(text) - 4 for a, _, b in found)


# --- pages


def lcs(a, b):
    table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
    return table_[-1][-1]


def test_secrets_behind_a_very_long_layer(spark, monkeypatch):
    secret = b" password = abcdefghijklmnop "
    bomb = base64.b64encode(gzip.compress(bytes(300 << 20) + secret)).decode().rstrip("=")
    assert len(bomb) < 500_000
    rows = [(1, "look: " + bomb), (2, "nothing here"), (3, "token=" + "z" * 20)]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in secrets.scan_secrets(table(spark, rows)).collect()}
    assert found == {1: [("assign", 6, 6 + len(bomb))], 2: [], 3: [("assign", 0, 26)]}
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(table(spark, rows)).collect()}
    assert masked[1] == "look: [SECRET]"
    monkeypatch.setattr(secrets, "_PIECE", 3000)  # borders of pieces hide nothing shorter than the overlap
    monkeypatch.setattr(secrets, "_OVERLAP", 200)
    rng = random.Random(2)
    for _ in range(20):
        filler = [prose(rng, rng.randint(50, 900)).encode() for _ in range(2)]
        text = base64.b64encode(gzip.compress(filler[0] + secret + filler[1])).decode().rstrip("=")
        assert secrets.find_secrets(text)[1] == [(0, 0, len(text))]


def test_nothing_is_placed_where_no_layer_can_be(monkeypatch):
    """places of all bytes were worked out for every run with a sign and every alignment, layers or not."""
    monkeypatch.setattr(secrets, "_content_layers", None)
    text = "100% %%%ab%4z a\\xq " + base64.b64encode(bytes([0, 1, 2, 255] * 30)).decode() + " token=abcdefghijkl12"
    found = secrets.find_secrets(text)
    assert found == (secrets.scan(text), secrets.scan(text), 0) and len(found[0]) == 1


def test_short_and_long_data_are_searched_alike(monkeypatch):
    rng = random.Random(6)
    some = [bytes(rng.choice(b"ab x^\x78\x9c\x1f\x8b\xc3\xa9\xe2\x82\xac\x00\n") for _ in range(rng.randint(2, 90))) for _ in range(400)]
    some += [data[:20] + "16 letters and é of a text".encode() + data[20:] for data in some[:50]]
    some += [bytes([a, b]) for a in range(256) for b in range(256)]
    short = [(secrets._headers(data), [m.span() for m in secrets._stretches(data)]) for data in some]
    monkeypatch.setattr(secrets, "_SHORT", 0)
    assert short == [(secrets._headers(data), [m.span() for m in secrets._stretches(data)]) for data in some]
    assert sum(len(h) for h, _ in short) > 500 and any(s for _, s in short)


def test_suspects_leave_out_no_secret():
    """texts that can hold no secret as they are were scanned for one, if they had a sign or a long word."""
    rng = random.Random(4)
    parts = ["token=abcdefghijkl12", "Api_Key: 'abcdefghijkl12'", "AKIA" + "A1B2" * 5, "deadbeef" * 2, "100%", "a\\x41", "W" * 20, "é", "plain words"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 3))) for _ in range(300)] + [None]
    found = list(secrets._each(pa.array(texts)))
    assert [f[1:] for f in found] == [secrets.find_secrets(t or "") for t in texts] and any(f[1] for f in found)
    assert secrets.find_secrets("token=abcdefghijkl12", True, False) == ([], [], 0)


def test_stretches_of_text_in_bytes():
    rng = random.Random(1)
    for _ in range(300):
        data = b"".join(rng.choice((
            rng.randbytes(rng.randint(0, 30)), prose(rng, 3).encode(), bytes(rng.choice(b"\xe0\xed\xf0\xf4\x80\x9f\xa0\xbf\xc2A") for _ in range(30)),
        )) for _ in range(rng.randint(0, 8)))
        assert [m.span() for m in secrets._stretches(data)] == [m.span() for m in secrets._STRETCH.finditer(data)]


def test_common_blocks_is_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        flags = html_text.common_blocks(a, b)
        rest = iter(b)
        assert flags.sum() == lcs(a, b) and all(x in rest for x, f in zip(a, flags) if f)


def test_common_blocks_in_little_memory(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(html_text, "_KEPT_BITS", 12)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        flags = html_text.common_blocks(a, b)
        rest = iter(b)
        assert flags.sum() == lcs(a, b) and all(x in rest for x, f in zip(a, flags) if f)


def kept(body):
    return [text for text, mark in html_text.page_blocks(page(body)) if mark != html_text.OTHER]


@pytest.mark.parametrize("name", ["site has-sidebar", "header-fixed", "layout-no-sidebar", "sidebar-right", "content-sidebar with-banner", "page-header"])
def test_names_of_wrappers_do_not_leave_out_the_article(name):
    assert kept(f"<div class='{name}'><article><p>Main text.</p></article></div><div class='sidebar'>side</div>") == ["Main text."]
    assert kept(f"<div class='{name}'><main><p>Main text.</p></main></div>") == ["Main text."]


@pytest.mark.parametrize("part", [
    "class='sidebar'", "class='comment-list'", "class='cookie-notice'", "class='related'", "id='comments'", "class='post-comments'",
    "class='nav-links'", "class='ad_slot_3'", "class='share-buttons'", "class='x newsletter-box'",
])
def test_what_is_no_article_goes_inside_an_article_too(part):
    inner = f"<div {part}><p>Other</p><article><p>A reader says one</p></article></div>" if "comment" in part or "related" in part else f"<div {part}><p>Other</p></div>"
    assert kept(f"<article><p>Main text.</p>{inner}<p>End.</p></article>") == ["Main text.", "End."]
    assert kept(f"<article><p>Main text.</p></article>{inner}") == ["Main text."]
    assert kept("<article><section id='comments-section'><p>c</p></section><section id='search'><p>About searching</p></section></article>") == ["About searching"]


def test_most_of_a_page_without_an_article_stays_whatever_its_name():
    assert kept("<div class='sidebar'><p>All the words that this page has</p></div><p>short</p>") == ["All the words that this page has", "short"]
    assert kept("<p>A few words</p><div class='comments'><p>Very many words of the readers</p></div>") == ["A few words"]


def page(body):
    return f"<html><head><title>t</title></head><body><nav>menu</nav>{body}<footer>foot</footer></body></html>"


def test_html_text(spark, tmp_path):
    rows = [
        (1, "http://a.com/x/1", page("<article><h1>Head &amp; x</h1><p>one<br>two <b>bold</b>\n t&eacute;xt<p>three<script>'<p>x</p>'</script><form>f</form>"
                                     "<div class='comments'><p>c</p></div></article><aside>s</aside>")),
        (2, "http://a.com/x/2", page("<div>Site name</div><div>Own words of two</div><div class='ad-box ad'>buy</div>")),
        (3, "http://a.com/x/3", page("<div>Site name</div><div>Own words of three</div>")),
        (4, "http://b.com/", page("<div>alone</div>")), (5, None, None), (6, "http://a.com/y", ""),
        (7, "http://c.com/1", page("<p>same</p>")), (8, "http://c.com/2", page("<p>same</p>")), (8, "http://c.com/2", page("<p>same</p>")),
    ]
    path = str(tmp_path / "pages")
    clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).write.parquet(path)
    out = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(spark.read.parquet(path)).collect()]
    texts = {1: "Head & x\none two bold téxt\nthree", 2: "Own words of two", 3: "Own words of three", 4: "alone", 5: "", 6: "", 7: "same", 8: "same"}
    assert sorted(out, key=str) == sorted([(i, u, texts[i], len(texts[i])) for i, u, _ in rows], key=str)


def test_differencing_judges_text_beside_articles(spark, tmp_path):
    card = "<article><h3>Card</h3><p>teaser</p></article>"
    rows = [
        (1, "http://a.com/x/1", page(f"{card}<div>Long own words of the first page</div><div>Site name</div>")),
        (2, "http://a.com/x/2", page(f"{card}<div>Long own words of the second page</div><div>Site name</div>")),
        (3, "http://b.com/x/1", page("<main><p>All prices without tax</p><p>own one</p></main>")),
        (4, "http://b.com/x/2", page("<main><p>All prices without tax</p><p>own two</p></main>")),
        (5, "http://c.com/x/1", page("<article><p>A repeated sentence</p><p>own one</p></article><div>Site name</div>")),
        (6, "http://c.com/x/2", page("<article><p>A repeated sentence</p><p>own two</p></article><div>Site name</div>")),
        (7, "http://d.com/x/1", page("<div>1 May</div><article><p>A copy of one article</p></article>")),
        (8, "http://d.com/x/2", page("<div>2 May</div><article><p>A copy of one article</p></article>")),
    ]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    assert {r.page_id: r.text for r in html_text.extract_text(spark.read.parquet(path)).collect()} == {
        1: "Long own words of the first page", 2: "Long own words of the second page", 3: "own one", 4: "own two",
        5: "A repeated sentence\nown one", 6: "A repeated sentence\nown two", 7: "1 May\nA copy of one article", 8: "2 May\nA copy of one article",
    }


def test_names_of_headings_and_sections_are_no_reason_to_leave_them_out():
    inner = ("<h2 id='search-algorithms'>a</h2><section id='related-work'><p>b</p></section><h2 id='header-files'>c</h2><div class='post-header'>d</div>"
             "<p class='alert'>e</p><h3 id='comments'>f</h3><div class='post ad'>g</div><section id='comments'><p>h</p></section>")
    for outer, texts in (("article", "abcdef"), ("main", "abcdef"), ("div", "abcef")):
        blocks = html_text.page_blocks(f"<{outer}>{inner}</{outer}><div id='related-links'>x</div>")
        assert "".join(t for t, kind in blocks if kind != html_text.OTHER) == texts


# --- URLs


def url_verdicts(rows):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]

    out = []
    for i, url in rows:
        host, path = parts(url)
        fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        out.append((i, host, path, best and best[1] + best[2], best and best[0]))
    return out


def test_url_filter(spark, monkeypatch):
    rng = random.Random(7)
    hosts = ["www.example.com", "a.example.com", "EXAMPLE.com", "shop.net", "news.org", "spam-farm.org", "com", "xcom", "casino.net", "example.com:80"]
    paths = ["/en/1", "/es/2?x=/en/", "/fr/3#a", "", "?q", "/EN/", "/en", "/de/page"]
    rows = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(300)]
    rows += [(400, None), (401, ""), (402, "no scheme"), (403, "http://"), (404, "x://y://z/é\nb"), (405, "http://news.org/" + "a" * 5000)]
    out = {r.page_id: r for r in url_filter.filter_urls(clashing(spark.createDataFrame(rows, "page_id long, url string"))).collect()}
    expected = url_verdicts(rows)
    assert [(i, out[i].host, out[i].path, out[i].rule) for i, *_ in rows] == [e[:4] for e in expected]
    urls = {i: url or "" for i, url in rows}
    scores = model_scores([(urls[i], e[4]) for i, e in zip(urls, expected)])
    for i, host, path, _, verdict in expected:
        if verdict:
            assert out[i].verdict == verdict and out[i].score is None
        else:
            assert math.isclose(out[i].score, scores[urls[i]], rel_tol=1e-9, abs_tol=1e-12)
            assert out[i].verdict == ("allow" if out[i].score >= out[i].threshold else "block")
    queries = [urls[i] for i, _, _, _, v in expected if not v and "?" in urls[i]]
    assert len({scores[u] for u in queries}) == len(set(queries)) > 3  # what stands behind the path counts
    monkeypatch.setattr(url_filter, "HOT_GRAMS", 10)  # the same when frequent grams are joined apart
    again = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(again[i].verdict == out[i].verdict and (again[i].score is None or math.isclose(again[i].score, out[i].score)) for i in out)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    lone = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")).collect()
    assert lone[0].verdict == "allow" and lone[0].score == 0


def model_scores(texts):
    """Straightforward Witten-Bell models; which URLs train is read off the same hash the operator documents."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    frame = spark.createDataFrame(sorted({t for t, _ in texts}), "string").select("value", F.pmod(F.xxhash64(F.lit("b"), "value"), F.lit(5)).alias("fold"))
    fold = {r["value"]: r["fold"] for r in frame.collect()}
    counts = {v: Counter() for v in ("allow", "block")}
    for text, verdict in {t for t in texts if t[1]}:
        if fold[text]:
            padded = "\u0002" * 4 + text + "\u0003"
            for i in range(len(text) + 1):
                for k in range(5):
                    counts[verdict][padded[i + 4 - k:i + 4], padded[i + 4]] += 1
    sums, kinds = ({v: Counter() for v in counts} for _ in range(2))
    for v, c in counts.items():
        for (context, _), n in c.items():
            sums[v][context] += n
            kinds[v][context] += 1

    def p(v, context, letter):
        out = 1 / 256
        for k in range(5):
            h = context[4 - k:]
            total = sums[v][h] + kinds[v][h]
            if total:
                out = (counts[v][h, letter] + kinds[v][h] * out) / total
        return out

    scores = {}
    for text in {t for t, _ in texts}:
        padded = "\u0002" * 4 + text + "\u0003"
        logs = [math.log(p("allow", padded[i:i + 4], padded[i + 4])) - math.log(p("block", padded[i:i + 4], padded[i + 4])) for i in range(len(text) + 1)]
        scores[text] = sum(logs) / len(logs)
    return scores


# --- toxicity


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        kind = i % 6
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        words += {0: ["vermin"], 1: ["idiot"], 2: ["grouping"], 3: ["idiot", "grouping"]}.get(kind, [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind in (0, 3))))
    docs, marks = table(spark, [*rows, (5000, None), (5001, ""), (5000, None)]), table(spark, [*labels, (0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(clashing(docs), marks).collect()
    assert len(out) == 1503 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    truth = dict(labels)
    unseen = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(7), marks).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)


def test_toxicity_learns_pairs_of_words_that_say_nothing_alone(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(2000):
        first, second = rng.choice(["kor", "lum"]), rng.choice(["vex", "zam"])
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 40))] + [first, second]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int((first, second) in (("kor", "vex"), ("lum", "zam")))))
    out = toxicity.toxicity(table(spark, rows), table(spark, labels, "doc_id long, toxic int")).where("held_out").collect()
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in out]) > 0.95


def test_toxicity_without_labels(spark):
    docs, none = table(spark, [(1, "a"), (2, None)]), table(spark, [], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.toxicity(docs, table(spark, [(1, 0), (3, 0)], "doc_id long, toxic int")).collect()} <= {0}
    assert toxicity.toxicity(table(spark, []), none).collect() == []


# --- repeated strings


def repeats(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                flags[i:i + length] = b"\1" * length
        kept = bytes(c for c, f in zip(t, flags) if not f)
        out.append((len(t), sum(flags), len(re.findall(rb"\x01+", bytes(flags))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("parts,windows,piece", [(4096, 1_500_000, 1 << 20), (2, 50, 200)])
def test_repeated_strings(spark, tmp_path, monkeypatch, parts, windows, piece):
    for name, value in (("PART_RUNS", parts), ("_WINDOWS", windows), ("_PIECE", piece)):
        monkeypatch.setattr(substrings, name, value)
    rng = random.Random(9)
    passages = [prose(rng, rng.randint(4, 30)) for _ in range(6)]
    rows = corpus(rng, 40) + [(300 + i, f"{prose(rng, 12)} {rng.choice(passages)} {prose(rng, 9)} {rng.choice(passages)[3:]}") for i in range(60)]
    rows += [(600, "ab" * 300), (601, "x" * 39), (602, "x" * 40), (None, rows[0][1])]
    path = str(tmp_path / "docs")
    clashing(table(spark, rows)).repartition(3).write.parquet(path)
    out = substrings.remove_repeats(spark.read.parquet(path), 40, 12).drop("kept")
    expected = repeats([(t or "").encode() for _, t in rows], 40)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((d, *e) for (d, _), e in zip(rows, expected)), key=str)


def test_no_task_compares_an_anchor_with_many_runs_as_a_whole(spark, tmp_path, monkeypatch):
    """A passage in all documents, each with its own words around it; some share a few of these with one other."""
    monkeypatch.setattr(substrings, "PART_RUNS", 8)
    plain = substrings._compare

    def bounded(*settings):
        work = plain(*settings)

        def checked(batches):
            batches, runs = list(batches), {}
            for batch in batches:
                for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    runs[key] = runs.get(key, 0) + 1
            if max(runs.values(), default=0) > 40:
                raise ValueError(f"{max(runs.values())} runs of an anchor in one comparison")
            yield from work(batches)

        return checked

    monkeypatch.setattr(substrings, "_compare", bounded)
    rng = random.Random(14)

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    passage, rows = noise(90), []
    for i in range(0, 300, 2):
        left, right = noise(rng.randint(0, 30)), noise(rng.randint(0, 30))
        rows += [(i + k, noise(60) + left + passage + right + noise(60)) for k in range(2)]
    path = str(tmp_path / "docs")
    table(spark, rows).repartition(3).write.parquet(path)
    out = substrings.remove_repeats(spark.read.parquet(path), 40, 12).drop("kept")
    expected = repeats([t.encode() for _, t in rows], 40)
    assert sorted(map(tuple, out.collect())) == sorted((d, *e) for (d, _), e in zip(rows, expected))


def test_repeated_strings_when_later_scans_are_split_otherwise(spark, tmp_path):
    """Spark cuts files by the cores it has at the time, so an executor that joins or leaves changes the parts of a scan."""
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(90)]
    rows += [(100 + i, f"{prose(rng, 5)} {t}") for i, t in rows[::3]]
    path = str(tmp_path / "docs")
    table(spark, rows).repartition(5).write.parquet(path)
    cut = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(cut)
    out = substrings.remove_repeats(spark.read.parquet(path), 40, 12).drop("kept")
    spark.conf.set(cut, "512b")
    try:
        found = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set(cut, before)
    expected = repeats([t.encode() for _, t in rows], 40)
    assert found == sorted((d, *e) for (d, _), e in zip(rows, expected))


def test_repeated_strings_of_a_table_that_is_not_stored(spark):
    rng = random.Random(16)
    rows = corpus(rng, 30)
    out = substrings.remove_repeats(table(spark, rows).repartition(3), 40, 12).drop("kept")
    expected = repeats([(t or "").encode() for _, t in rows], 40)
    assert sorted(map(tuple, out.collect())) == sorted((d, *e) for (d, _), e in zip(rows, expected))


# --- language model


def test_language_model_scores(spark, tmp_path):
    rng = random.Random(10)
    rows = [r for r in corpus(rng, 150)]
    path = str(tmp_path / "docs")
    clashing(table(spark, [*rows, rows[0]])).write.parquet(path)
    out = lm_scoring.score_texts(spark.read.parquet(path)).collect()
    counts = Counter()
    for doc, text in [*rows, rows[0]]:
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            counts.update([*(text or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    assert len(out) == len(rows) + 1
    for r in out:
        tokens = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.bits_per_byte is None) == (not texts[r.doc_id])
    assert lm_scoring.score_texts(table(spark, [])).collect() == []


def test_code_probabilities_sum_to_one():
    model, usage = lm_scoring.Mixer(), lm_scoring.Usage()
    rng = np.random.default_rng(11)
    names = rng.integers(0, 50, 4000).astype(np.uint64)
    rows = np.repeat(np.arange(40), 100)
    for _ in range(3):
        model.run(names, rows, usage)
    model.freeze()
    # a token of every code, each after the same two tokens
    by_code = {}
    for name in range(100_000):
        by_code.setdefault(int(lm_scoring.codes_of(np.array([name], np.uint64))[0]), name)
        if len(by_code) == 1 << lm_scoring.CODE_BITS:
            break
    tail = np.array(list(by_code.values()), np.uint64)
    tokens = np.stack([np.full(len(tail), 3, np.uint64), np.full(len(tail), 9, np.uint64), tail], axis=1).reshape(-1)
    logs = model.run(tokens, np.repeat(np.arange(len(tail)), 3))[2::3]
    assert math.isclose((2.0 ** logs).sum(), 1, rel_tol=1e-4)


# --- byte pairs


def test_bpe_matches_the_library_and_decodes(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(12)
    bits = ["'s", "'ll", " ", "  ", "\n", "\t", "é", "ß", "数据", "😀", "<|endoftext|>", "a", "the", "ing", "1", "23", ".", "!!", "\u00a0", "\u200b", "AB", "aaaaaaa", "   \n  ", "\x00", "\x1c"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "ab" * 20000), (503, " " * 3000), (500, None)]
    encoded = bpe.bpe_encode(clashing(table(spark, rows)), path)
    out = bpe.bpe_decode(encoded, path).select("doc_id", "ids", "decoded", bpe.ids_digest(F.col("ids")).alias("digest"), "score").collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == (texts[r.doc_id] or "") == library.decode(ids, skip_special_tokens=False) and r.score == "other"
        assert r.digest == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.bpe_encode(table(spark, []), path).collect() == []


def test_pages_meet_across_partitions(spark, monkeypatch):
    """However the pages are dealt out, a page is compared with the same neighbours."""
    rng = random.Random(13)
    rows = sorted((rng.choice("ab"), f"/{rng.choice('xyz')}/{i:03d}", i, [rng.randint(0, 6) for _ in range(rng.randint(0, 6))]) for i in range(40))
    frame = spark.createDataFrame(rows, "host string, path string, row long, names array<long>")
    expected = {}
    for at, (host, path, row, names) in enumerate(rows):
        near = [rows[i] for i in (at - 1, at + 1) if 0 <= i < len(rows) and rows[i][0] == host]
        best = max((len(html_text.commonprefix([path, n[1]])) for n in near), default=0)
        flags = np.zeros(len(names), bool)
        for n in near:
            if len(html_text.commonprefix([path, n[1]])) == best:
                flags |= html_text.common_blocks(names, n[3])
        expected[row] = flags.tolist()
    for parts in ("1", "7", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {r.row: r.shared for r in html_text.shared_blocks(frame).collect()} == expected
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

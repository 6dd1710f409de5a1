"""Byte-level BPE, fingerprints, HTML, language ID, toxicity and language-model scores."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, fingerprints, html_extract, language_id, lm_scoring, queries, toxicity
from corvane.llm import words as W

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.BPE_FILE)


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.Vocabulary.read(PATH).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a", "\n\n  \t x", "naïve façade — 東京 👩‍👩‍👧 \u0000 ﻿", "a" * 3000, "ab" * 999, " " * 700 + "x", "1234567890" * 30, "!?" * 500, "don't we'll I'M", "é" * 301]


def test_bpe_as_the_library_does(spark, reference):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None)]
    got = {r.doc_id: r for r in byte_bpe.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, text in rows:
        ids = reference.encode_ordinary(text or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_query_over_a_whole_table(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op9_byte_bpe(spark, FOLDER).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_encode_and_decode_columns(spark, reference):
    df = spark.createDataFrame([(1, "some text", 5), (2, None, 6)], "doc_id bigint, text string, ids int")
    coded = byte_bpe.encode(df, PATH, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in byte_bpe.decode(coded, PATH, public_tokenizers.PATTERN).collect()}
    assert rows[1].ids == reference.encode_ordinary("some text") and bytes(rows[1].decoded) == b"some text" and rows[2].ids == [] and bytes(rows[2].decoded) == b""


def test_appends_and_edits_agree_with_a_fresh_encoding():
    vocabulary = byte_bpe.Vocabulary.read(PATH)
    dice = random.Random(1)
    data = "the quick brown fox jumps over the lazy dog, naïvely".replace(" ", "").encode()
    grown = byte_bpe.PrefixEncoder(vocabulary)
    for i in range(len(data)):
        grown.append(data[i : i + 1])
        assert grown.ids() == vocabulary.merged(data[: i + 1]) == byte_bpe.PrefixEncoder(vocabulary, data).ids(i + 1)
    for _ in range(60):
        now = bytes(grown.data)
        a = dice.randrange(len(now))
        b = min(len(now), a + dice.randrange(4))
        new = bytes(dice.choice(b"abcxyz \xc3\xa9") for _ in range(dice.randrange(5)))
        grown.replace(a, b, new)
        assert bytes(grown.data) == now[:a] + new + now[b:] and grown.ids() == vocabulary.merged(bytes(grown.data))
    long = byte_bpe.PrefixEncoder(vocabulary, data * 40)
    assert long.replace(100, 103, b"zz") < len(data) * 20


def test_many_pieces_at_a_time_as_one_by_one():
    vocabulary, dice = byte_bpe.Vocabulary.read(PATH), random.Random(12)
    pieces = [bytes(dice.choice(b"abcdeinorst \xc3\xa9\xe6\x9d\xb1") for _ in range(dice.randrange(0, 40))) for _ in range(400)] + [b"", b"a" * 256, b" " * 256, b"ab" * 99]
    for piece, packed in zip(pieces, vocabulary.encode_many(pieces), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == vocabulary.merged(piece) == byte_bpe.PrefixEncoder(vocabulary, piece).ids()
    # ranks in another order than merging makes them: bytes are merged instead
    odd = byte_bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258, b"abcd": 259, b"cd": 260})
    assert not odd.ordered
    for piece in (b"abcd", b"abc", b"bcd", b"xabcdabc", b"cdcdab"):
        assert odd.encode_many([piece]) == [np.asarray(odd.merged(piece), "<u4").tobytes()]


def test_bpe_keeps_its_table_bounded(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 100)
    monkeypatch.setattr(byte_bpe, "TAKEN", 50)
    t = byte_bpe.Tokenizer(byte_bpe.Vocabulary.read(PATH), public_tokenizers.PATTERN)
    dice = random.Random(3)
    texts = [" ".join("".join(dice.choice("abcdefgh") for _ in range(dice.randrange(1, 60))) for _ in range(dice.randrange(90))) for _ in range(60)] + [None, ""]
    for text, packed in zip(texts, t.encode_many(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text or "")
        assert len(t._recent) + len(t._before) < 400


# ---- fingerprints


def spots(text, chain=2):
    words = ["".join(c for c in w) for w in regex.split(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    anchors, out = set(fingerprints.ANCHORS), set()
    content = [i for i, w in enumerate(words) if w not in anchors]
    for i in range(-1, len(words)):
        if i == -1 or words[i] in anchors:
            following = [k for k in content if k > i][:chain]
            if following:
                out.add(tuple(words[k] for k in following))
    return out or ({tuple(words)} if words else set())


def test_fingerprints_hold_the_spots(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()][:80] + [(900, ""), (901, "the of"), (902, "the a of content"), (903, "word")]
    for _, text in rows:
        values, _ = fingerprints.signatures([text.encode()])
        assert len(values) == len(spots(text)), text[:80]
    texts = [t for _, t in rows]
    values, offsets = fingerprints.signatures([t.encode() for t in texts])
    for i in range(len(texts) - 1):
        a, b = values[offsets[i] : offsets[i + 1]], values[offsets[i + 1] : offsets[i + 2]]
        x, y = spots(texts[i]), spots(texts[i + 1])
        assert fingerprints.likeness(a, b) == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def test_against_next_in_order_of_ids(spark):
    dice = random.Random(4)
    rows = [(i * 7 - 20, " ".join(dice.choice(["the", "fox", "runs", "é", "of", "night"]) for _ in range(dice.randint(0, 30)))) for i in range(150)] + [(5000, None), (None, "first of all")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    anchors = fingerprints.learn(frame)
    got = {r.doc_id: r for r in fingerprints.against_next(frame.repartition(7)).collect()}
    ordered = sorted(rows, key=lambda r: -(10**9) if r[0] is None else r[0])
    assert len(got) == len(rows)
    for (i, t), (_, f) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, f = t or "", f or ""
        half = len(t) // 2
        new = t[: len(t) - half] + f[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        own, changed, following = (fingerprints.signatures([x.encode()], gap=fingerprints.GAP, anchors=anchors)[0] for x in (t, new, f))
        assert got[i].fingerprint == fingerprints.packed(own) and got[i].near_edited == fingerprints.likeness(own, changed) and got[i].near_next == fingerprints.likeness(own, following)
    one = fingerprints.against_next(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert fingerprints.against_next(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_fingerprints_cover_text_without_anchors(spark):
    dice = random.Random(6)
    head = "The and attion to thanedble the, anea. Eriner thanea.\n"
    tables = [" | ".join("".join(dice.choice("bdfgkmprt") for _ in range(6)) for _ in range(120)) for _ in range(2)]
    rows = [(0, tables[0]), (1, tables[1]), (2, head + tables[0]), (3, head + tables[1]), (4, "xx yy " + tables[0])]
    got = {r.doc_id: fingerprints.unpacked(r.fingerprint) for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got[0]) >= 120 // fingerprints.GAP and fingerprints.likeness(got[2], got[3]) < 0.5
    # what stands before makes no difference further on, and every stretch has a signature
    assert fingerprints.likeness(got[0], got[4]) > 0.6
    words = tables[0].split(" | ")
    for i in range(2, 120 - 2 * fingerprints.GAP):
        changed = words[:i] + ["zzzz"] * (fingerprints.GAP + 2) + words[i + fingerprints.GAP + 2 :]
        assert len(np.setdiff1d(got[0], fingerprints.signatures([" ".join(changed).encode()], gap=fingerprints.GAP)[0]))
    near = {r.doc_id: r.near_edited for r in fingerprints.against_next(spark.createDataFrame(rows[:2], "doc_id bigint, text string")).collect()}
    assert near[0] < 0.8 and near[1] < 0.8


@pytest.mark.parametrize("least", [0.8, 0.55, 0.56, 1 / 3])
def test_similar_fingerprints(spark, least):
    """All pairs of different fingerprints, each by the smallest id that has it."""
    dice = random.Random(9)
    least, rows = round(least, 4), []
    name = lambda b, k: "".join(chr(97 + int(d)) for d in f"{b}{k:03}")
    for b in range(8):
        base = [name(b, k) if k % 2 else dice.choice(["the", "of", "and"]) for k in range(60)]
        for c in (0, 0, 1, 2, 5, 12, 20):
            own = list(base)
            for _ in range(c):
                own[dice.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(own[: 60 - 3 * (c % 4)])))
    prints = fingerprints.fingerprint(spark.createDataFrame([*rows, (99, ""), (98, "")], "doc_id bigint, text string"))
    sets: dict[str, int] = {}
    for r in prints.collect():
        sets[r.fingerprint] = min(r.doc_id, sets.get(r.fingerprint, r.doc_id))
    own = {i: set(fingerprints.unpacked(f).tolist()) for f, i in sets.items() if f}
    wanted = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) * 10_000 >= round(least * 10_000) * len(own[a] | own[b])}
    got = fingerprints.similar(prints, least).collect()
    assert {(r.a, r.b) for r in got} == wanted and wanted and len(got) == len(wanted)
    assert all(r.likeness == pytest.approx(len(own[r.a] & own[r.b]) / len(own[r.a] | own[r.b])) for r in got)


def test_prefixes_at_the_threshold_to_a_whole_number(spark):
    """Sets of n with exactly the least part in common, where floats would round the prefix down."""
    for least, n in ((0.55, 100), (0.56, 25), (0.8, 5)):
        common = round(least * n)
        a = np.arange(1, n + 1, dtype="<u4")
        pair = [(1, fingerprints.packed(a)), (2, fingerprints.packed(a[:common]))]
        pair += [(10 + i, fingerprints.packed(np.asarray([v], "<u4"))) for i, v in enumerate(a[common:])]
        frame = spark.createDataFrame(pair, "doc_id bigint, fingerprint string")
        assert [(r.a, r.b, r.likeness) for r in fingerprints.similar(frame, least).collect()] == [(1, 2, common / n)]


def test_anchors_are_learned_for_each_script(spark):
    dice = random.Random(14)
    russian, greek = ["и", "в", "не", "на"], ["και", "το"]
    make = lambda common, letters: " ".join(dice.choice(common) if k % 4 == 0 else "".join(dice.choice(letters) for _ in range(7)) for k in range(80))
    rows = [(i, make(russian, "бдгжзклмпрстф")) for i in range(90)] + [(200 + i, make(greek, "βγδζθκλμνξπρσ")) for i in range(30)]
    rows += [(300 + i, make(["lorem", "qua"], "bdfghjkl")) for i in range(100)] + [(900, None), (901, ""), (None, "и")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts in (1, 5, 40):
        anchors = fingerprints.learn(frame.repartition(parts, "doc_id"))
        low = lambda words: W.hashes([" ".join(words).encode()], W.LETTERS)[0] & ~np.uint64(15)  # noqa: E731, B023
        # of 30 Greek documents nothing is learned
        assert set(anchors.tolist()) == set(low([*fingerprints.ANCHORS, *russian, "lorem", "qua"]).tolist())
    head = "первое слово "
    one, two = (f"{head}{make(russian, 'бдгжзклмпрстф')}".encode() for _ in range(2))
    a, b = (fingerprints.signatures([t], gap=fingerprints.GAP, anchors=anchors)[0] for t in (one, two))
    assert len(a) > 10 and fingerprints.likeness(a, b) < 0.2


def test_many_documents_of_one_id_are_several_ranges(spark):
    rows = [(None, f"the words of {i} and more of {i * i}") for i in range(400)] + [(7, "same")] * 50 + [(i, None) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    out = fingerprints.against_next(frame)
    got = out.collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 400
    parts = out.select(F.spark_partition_id().alias("p"), "doc_id").filter("doc_id IS NULL").select("p").distinct().count()
    assert parts > 1
    # each text is the next of one other: around the circle
    import collections

    nexts = collections.Counter(r.edited_sha256 for r in got)
    wide = frame.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()
    ordered = [r.text for r in sorted(wide, key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.h))]
    wanted = collections.Counter(hashlib.sha256(fingerprints.edited(t, f).encode()).hexdigest() for t, f in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert nexts == wanted


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=sidebar>Side</div>{body}<div class="comments"><p>First!</p></div><form><p>Search</p></form><!-- <p>hidden</p> --><footer>&copy; Site</footer></body></html>"""
ARTICLE = "<article><header><h1>Head &amp; shoulders</h1></header><p>One\n  two<br>three <b>bold<p>Open paragraph &eacute;&#233;<section class=comment>spam</section><ul><li>a<li>b</ul></article>"


def test_html_of_a_marked_page():
    got = html_extract.main_text(html_extract.lines(PAGE.format(body=ARTICLE)), [])
    assert got == "Head & shoulders\n\nOne two three bold\n\nOpen paragraph éé\n\na\n\nb"


def test_html_differencing_takes_what_neighbours_share(spark):
    page = "<body><div>Acme news</div><div>{}</div><div>Read more tomorrow</div><p>{}</p><div>All rights kept</div></body>"
    rows = [(i, f"http://x.org/a/{i}", page.format(f"Story {i} of many words here", f"More of story {i}, told at length")) for i in range(6)]
    rows += [(100, "http://y.org/z", page.format("alone", "here")), (101, None, None), (102, "not a url", ""), (103, "http://x.org/b/1", rows[0][2])]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    assert len(got) == len(rows)
    for i in range(1, 6):
        assert got[i].text == f"Story {i} of many words here\n\nMore of story {i}, told at length" and got[i].n_chars == len(got[i].text)
    assert got[101].text == "" and got[102].text == "" and "Acme news" in got[100].text
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_html_copies_keep_their_article():
    page = html_extract.lines(PAGE.format(body=ARTICLE))
    assert html_extract.main_text(page, [page]) == html_extract.main_text(page, [])
    plain = html_extract.lines("<div>some</div><div>text</div>")
    assert html_extract.main_text(plain, [plain]) == "some\n\ntext"


@pytest.mark.parametrize("html", ["<", "<p", "</", "<p>a</p></div></p>b", "<script>never closed", "<!-- open", "<p class='ad>x</p>", "<p/>x<br/>y", "a < b > c", "&bogus; &#xD800;", "<table><tr><td>1<td>2</table>"])
def test_html_of_broken_pages(html):
    html_extract.main_text(html_extract.lines(html), [])


@pytest.mark.parametrize("aligned", [html_extract.ALIGNED, 2])
def test_longest_common_subsequence(monkeypatch, aligned):
    monkeypatch.setattr(html_extract, "ALIGNED", aligned)
    dice = random.Random(8)
    for _ in range(200):
        a, b = ([dice.choice("abcd") for _ in range(dice.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(html_extract.shared(a, b))
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(any(a[i] == y for y in rest) for i in found)


def _unmarked(html):
    """The page without any tag that says what a part of it is."""
    html = regex.sub(r"<(/?)(article|nav|footer|header|aside|main)\b", r"<\1div", html or "")
    return regex.sub(r" class=(\"[^\"]*\"|'[^']*')", "", html)


def _plain_pages(rows):
    """The query over (page_id, url, html), by sorting all pages, a table for each alignment and blocks one by one."""

    def place(row):
        found = regex.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", row[1] or "")
        host, path = (found[1].lower(), regex.sub(r"(/|\.html?|/index\.html?)$", "", found[2])) if found else ("", "")
        return host, path, str(row[0] if row[0] is not None else "").rjust(20, "0")

    order = sorted(rows, key=lambda r: ("\x01".join(place(r)), r[2] or ""))
    out = {}
    for at, row in enumerate(order):
        own = html_extract.lines(row[2])
        beside = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order) and place(order[k])[0] == place(row)[0]]

        def alike(other):
            a, b = (place(x)[1].split("/") for x in (row, other))  # noqa: B023
            return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

        beside.sort(key=alike, reverse=True)
        inside = html_extract._inside(own)
        body = [i for i, x in enumerate(own.lines) if (inside[i] if any(inside) else not x.aside)]
        keep = body
        for other in beside:
            a, b = [x.text for x in own.lines], [x.text for x in html_extract.lines(other[2]).lines]
            table = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, j in np.ndindex(len(a), len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
            common, i, j = set(), len(a), len(b)
            while i and j:
                if table[i, j] == table[i, j - 1]:
                    j -= 1
                elif table[i, j] == table[i - 1, j]:
                    i -= 1
                else:
                    i, j = i - 1, j - 1
                    common.add(i)
            size = sum(len(a[k]) for k in body)
            if size and 2 * sum(len(a[k]) for k in body if k in common) >= size:
                continue
            if any(inside):
                keep = [k for k in body if k not in common or own.lines[k].links < 0.6 * len(a[k])]
                break
            stays = [k for k in body if k not in common]

            def within(k, e):
                e_ = own.lines[k].block  # noqa: B023
                while e_ > e:
                    e_ = own.parents[e_]  # noqa: B023
                return e_ == e

            site = set()
            for e in range(1, len(own.parents)):
                held = [k for k in range(len(a)) if within(k, e)]
                if held and held[0] in common and 2 * sum(len(a[k]) for k in held if k in stays) < sum(len(a[k]) for k in stays):
                    site.update(held)
            keep = [k for k in stays if k not in site]
            break
        out[row[0]] = "\n\n".join(own.lines[k].text for k in keep)
    return out


@pytest.mark.parametrize("marks", [True, False])
def test_html_query_against_a_plain_version(spark, marks):
    rows = [(r.page_id, r.url, r.html if marks else _unmarked(r.html)) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    rows += [(1000 + i, f"http://x.org/{'ab'[i % 2]}/{i}", f"<div><b>Acme</b><a href=/>Home</a></div><div>{'Comments' if i % 3 else 'Links'}<p>own {i}</div><p>{'word ' * (i % 7)}{i}<p>{'long own text ' * 9}{i * i}<div>All rights kept</div>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df.repartition(5)).collect()} == _plain_pages(rows)


def test_html_differencing_decides_where_nothing_is_marked():
    """Articles of the table in unmarked pages with one template for each host: neighbours' help gives the article, without it the whole page is the text."""
    import duckdb

    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY url").fetchall()
    hosts: dict[str, list] = {}
    for _, url, html in rows:
        host, article = url.split("/")[2], _unmarked(regex.search(r"(?s)<article>(.*)</article>", html)[1])
        wanted = html_extract.main_text(html_extract.lines(html), [])
        top = f"<div><a href=/>{host}</a><a href=/n>News</a></div><div><p>We on {host} use cookies<p>Fine</div>"
        hosts.setdefault(host, []).append((wanted, html_extract.lines(f"<body>{top}<div>{article}</div><div>Related<p>{wanted[:9]}</div><div>All of {host}</div>")))
    n = right = helped = 0
    for own in hosts.values():
        for (wanted, page), (_, partner) in zip(own, own[1:], strict=False):
            got, alone = html_extract.main_text(page, [partner]), html_extract.main_text(page, [])
            n, right, helped = n + 1, right + (got == wanted), helped + (got != alone)
    assert n > 150 and helped > 0.95 * n and right > 0.9 * n


def test_html_wrappers_and_names_do_not_lose_text():
    article = "<article><div class='post-header'><h1>Title</h1></div><p>Text</p><section id='social'>About society</section></article>"
    page = html_extract.lines(f"<div class='layout with-sidebar'>{article}</div>")
    assert html_extract.main_text(page, []) == "Title\n\nText\n\nAbout society"
    other = html_extract.lines("<div class='layout with-sidebar'><article><h1>Other</h1><p>Else</p></article></div>")
    assert html_extract.main_text(page, [other]) == "Title\n\nText\n\nAbout society"
    linked = html_extract.lines("<div><a href=/a>Only a link here</a></div><div>And text</div>")
    assert html_extract.main_text(linked, []) == "Only a link here\n\nAnd text"


def test_html_blocks_that_open_with_a_shared_line_go():
    page = "<div><h1>{0}</h1><p>{0} is told at length here, in so many words</p></div><div><h3>Related</h3><a href=/x>More on {0}</a></div>"
    a, b = (html_extract.lines(page.format(x)) for x in ("Rain", "Snow"))
    assert html_extract.main_text(a, [b]) == "Rain\n\nRain is told at length here, in so many words"


@pytest.mark.parametrize(
    "html",
    ["<a " * 350_000, "<a \">\" " * 150_000 + ">", "<b>" * 300_000 + "</i>" * 200_000, "<i><div>" + "<b>" * 200_000 + "</i>" * 200_000, "<svg>" * 200_000, "<div>" * 200_000, "x<p>" * 250_000, "<!--" * 200_000, "<p>a<b>" * 140_000, "<div><b>" * 100_000 + "<hr>" * 100_000, "<script>" * 100_000, "a & b < c " * 100_000],
)
def test_html_of_a_megabyte_of_broken_markup(html):
    began = time.process_time()
    html_extract.main_text(html_extract.lines(html), [html_extract.lines("<p>x<p>y")])
    assert time.process_time() - began < 12


def test_html_alignment_of_many_equal_lines():
    began = time.process_time()
    a, b = ["x", "y"] * 20_000, ["y", "x", "x"] * 13_000
    found = html_extract.shared(a, b)
    assert len(found) > 25_000 and time.process_time() - began < 30
    assert len(html_extract.shared(["x"] * 100_000, ["x"] * 99_000)) == 99_000


# ---- language ID


def test_language_id_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op8_language_id(spark, folder).collect() if r.held_out]
    assert sum(labels[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_id_edges(spark):
    rows = [(1, "the cat and the dog " * 30, "en"), (2, "le chat et le chien " * 30, "fr"), (3, None, "en"), (None, "el gato", "es")]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert set(model.languages) == {"en", "fr"}
    asked = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog and the cat, the dog"), (5, "le chien et le chat"), (6, "x" * 200_000)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "fr"] and got[1].rejected and not got[4].rejected
    nothing = language_id.learn(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert {r.lang_pred for r in language_id.identify(spark.createDataFrame(asked, "doc_id bigint, text string"), nothing).collect()} == {"und"}


def test_language_id_against_a_plain_version(spark):
    """Where all fits into the sample, dictionaries hold every training text whole, and sizes are those of compressing by hand."""
    import zstandard

    dice = random.Random(2)
    sound = {"aa": "bade gofu", "bb": "rilo nume", "cc": "zyxa wuqo kep"}
    make = lambda k: " ".join("".join(dice.choice(sound[k]) for _ in range(dice.randint(2, 9))).strip() for _ in range(dice.randint(1, 900)))
    rows = [(i, make(k), k) for i, k in enumerate(dice.choice(list(sound)) for _ in range(60))]
    model = language_id.learn(spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, lang string"), sample_chars=10**6)
    assert model.languages == tuple(sorted(sound, key=lambda k: (-sum(r[2] == k for r in [*rows, rows[0]]), k)))
    for name, content in zip(model.languages, model.contents, strict=True):
        own = [language_id.letters(r[1][i : i + language_id.SAMPLE_PIECE]) for r in rows if r[2] == name for i in range(0, max(1, len(r[1])), language_id.SAMPLE_PIECE)]
        assert sorted(content.split(b"\n")) == sorted(set(own))
    asked = [(100 + i, make(k)) for i, k in enumerate(list(sound) * 5)] + [(200, "bade " * 20), (201, "qqq")]
    for r in language_id.identify(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect():
        data = language_id.letters(dict(asked)[r.doc_id])
        sizes = []
        for content in model.contents:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=language_id.LEVEL)
            packer = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(packer.compress(data[i : i + language_id.PIECE])) for i in range(0, len(data), language_id.PIECE)))
        margin = (sorted(sizes)[1] - min(sizes)) / min(sizes)
        assert r.lang_pred == model.languages[sizes.index(min(sizes))] and r.score == pytest.approx(margin / (margin + language_id.MARGIN))
        assert r.rejected == (r.score < language_id.LEAST_SCORE)


def test_language_id_learns_all_languages_and_rejects_ties(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k % 7}x" for k in range(60)).translate({48 + d: 103 + d for d in range(7)}), f"l{i}") for i in range(230)]
    rows += [(1000 + i, "equal words in two tongues", f"t{i}") for i in range(2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.learn(frame)
    assert set(model.languages) == {r[2] for r in rows}
    got = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    assert got[5].lang_pred == "l5" and not got[5].rejected and got[5].score > 0.5
    assert got[1000].lang_pred == "t0" and got[1000].score == 0 and got[1000].rejected


def test_language_id_samples_whole_texts_within_bounds(spark):
    text = "".join(chr(97 + i % 26) * 3 + " " for i in range(500_000))
    frame = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "kurz", "de"), (3, "kurz", "de")], "doc_id bigint, text string, lang string").withColumn("lang_pred", F.lit(7)).withColumn("other", F.lit(1))
    model = language_id.learn(frame, sample_chars=40_000)
    sizes = dict(zip(model.languages, map(len, model.contents), strict=True))
    assert 5_000 < sizes["en"] < 60_000 and sizes["de"] == 4
    out = language_id.identify(frame, model)
    assert out.columns == ["doc_id", "text", "lang", "other", "lang_pred", "score", "rejected"] and out.filter("doc_id = 1").first().lang_pred == "en" and out.count() == 4


# ---- toxicity


def labelled(n=800, seed=6):
    dice = random.Random(seed)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [dice.choice(plain) for _ in range(dice.randint(20, 80))]
        bad = i % 5 == 0
        for _ in range(dice.randint(1, 6) if bad else 0):
            words.insert(dice.randrange(len(words)), dice.choice(["vile", "scum!", "Rotten"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    documents = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id bigint, text string")
    known = spark.createDataFrame([r for r in labels if r[0] % 3] + [(None, 1, 1), (1, 1, None), (77777, 0, 1), (2, 1, 5)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(*toxicity.sample(documents, known))
    got = {r.doc_id: r for r in toxicity.score(documents, model).collect()}
    held = [(got[i], bad) for i, _, bad in labels if i % 3 == 0]
    assert all(r.toxic_pred == bool(bad) for r, bad in held)
    assert got[9000].severity == got[9001].severity < 0.5 and len(got) == len(rows) + 2
    many, few = ("vile scum rotten " + "w1 " * 20, "vile " + "w1 " * 22)
    worse, better = (toxicity.score(spark.createDataFrame([(1, t)], "doc_id bigint, text string"), model).first().severity for t in (many, few))
    assert worse > better and (model.thresholds[1:] >= model.thresholds[:-1]).all()


def test_toxicity_without_labels(spark):
    documents = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    row = toxicity.score(documents, toxicity.fit(*toxicity.sample(documents, none))).first()
    assert row.severity < 1e-9 and not row.toxic_pred
    assert toxicity.score(documents.limit(0), toxicity.fit(*toxicity.sample(documents, none))).collect() == []


def test_toxicity_scores_against_a_plain_version(spark):
    """Each text's severity from its words one by one, by the weights of the model."""
    rows, labels = labelled(400, 9)
    rows += [(5000, None), (5001, "VILE vile, scum! " * 4000), (5001, "again"), (None, "vile")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("severity", F.lit("x")).withColumn("places", F.lit(1))
    sampled = toxicity.sample(documents, spark.createDataFrame([*labels, (5001, 1, 1)], "doc_id bigint, quality int, toxic int"))
    assert len(sampled[0]) == 402  # a repeated id is two rows
    model = toxicity.fit(*sampled)
    weight = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
    out = toxicity.score(documents, model)
    assert out.columns == ["doc_id", "text", "places", "severity", "grade", "toxic_pred"] and out.count() == len(rows)
    for r in out.collect():
        counts: dict[int, int] = {}
        for w in regex.findall(r"[a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")):
            place = int(W.hashes([w.encode()], W.LETTERS)[0][0]) >> (64 - toxicity.BITS)
            counts[place] = counts.get(place, 0) + 1
        total = sum(weight.get(p, 0.0) * (1 + np.log(n)) for p, n in counts.items())
        chances = [1 / (1 + np.exp(t - total)) for t in model.thresholds]
        assert r.severity == pytest.approx(sum(chances), abs=1e-4) and r.toxic_pred == (chances[0] >= 0.5)


def test_toxicity_fits_by_the_gradient_of_the_likelihood():
    """No small step from the fitted weights and thresholds makes the penalised likelihood of the grades better."""
    dice = np.random.default_rng(4)
    places = [np.unique(dice.integers(0, 12, 6)) * 1000 for _ in range(300)]
    values = [np.ones(len(p)) for p in places]
    grade = np.clip(np.rint(np.asarray([(p < 4000).sum() for p in places]) + dice.normal(0, 0.7, 300) - 0.5), 0, 3).astype(np.int64)
    toxic = (grade > 0).astype(np.int64)
    rows = toxicity.Rows.of(toxic, places, values)
    weights, thresholds = toxicity._ordinal(rows, grade, 4, 3000)

    def loss(w, t):
        score = np.bincount(rows.row, rows.value * w[rows.column], 300)
        p = np.concatenate([np.ones((300, 1)), 1 / (1 + np.exp(-(score[:, None] - t))), np.zeros((300, 1))], axis=1)
        at = np.arange(300)
        return -np.log(p[at, grade] - p[at, grade + 1]).mean() + (rows.penalty * w**2).sum() / 2

    best = loss(weights, thresholds)
    for k in range(len(weights)):
        for step in (0.02, -0.02):
            moved = weights.copy()
            moved[k] += step
            assert loss(moved, thresholds) > best - 1e-6
    for k in range(3):
        for step in (0.02, -0.02):
            moved = thresholds.copy()
            moved[k] += step
            assert loss(weights, moved) > best - 1e-6


def test_toxicity_grades_are_bands_of_what_other_folds_say():
    toxic = np.asarray([0, 1] * 30)
    scores = np.arange(60.0)
    grade = toxicity.grades_of(toxic, scores)
    assert (grade[toxic == 0] == 0).all() and np.bincount(grade).tolist() == [30, 10, 10, 10] and (np.diff(grade[toxic == 1]) >= 0).all()
    # a word of one row only tells its fold's model nothing
    places = [np.asarray([7]) if t else np.asarray([9]) for t in toxic]
    places[1] = np.asarray([1234])
    fitted = toxicity.cross_fitted(toxic, places, [np.ones(1)] * 60)
    assert fitted[3] > 0 > fitted[1]


def test_toxicity_sample_is_bounded_in_rows_and_characters(spark):
    rows, labels = labelled(600)
    documents, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    size = {i: len(t) for i, t in rows}
    assert len(toxicity.sample(documents, known)[0]) == 600
    few = toxicity.sample(documents, known, chars=sum(size.values()) // 3)
    assert 0 < len(few[0]) < 300 and len(toxicity.sample(documents, known, rows=100)[0]) <= 100


# ---- language model


def test_lm_scores_are_sums_of_conditional_log_probabilities(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    words = lm_scoring.vocabulary(documents)
    net = lm_scoring.train(documents, words)
    rows = [(1, documents.first().text), (2, None), (3, ""), (4, "word")]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string"), words, net).collect()}
    assert (got[2].n_tokens, got[2].log_likelihood, got[2].mean_log_likelihood) == (0, 0.0, None) and got[4].n_tokens == 1
    context, target = lm_scoring.windows(*W.hashes([rows[0][1].encode()]), lm_scoring.places(words[0]), words[1])
    total = 0.0
    for c, t in zip(context, target, strict=True):
        h = np.tanh(sum(net.part["embed"][o][c[o]] for o in range(len(c))))
        top = np.exp(h @ net.part["top"] + net.part["top_bias"])
        k = t // lm_scoring.CLASSES
        low = np.exp(h @ net.part["low"][k] + net.part["low_bias"][k])
        total += np.log(top[k] / top.sum()) + np.log(low[t % lm_scoring.CLASSES] / low.sum())
    assert got[1].log_likelihood == pytest.approx(total, rel=1e-4) and got[1].n_tokens == len(target)


def test_lm_gradient_is_right():
    dice = np.random.default_rng(3)
    context, target = dice.integers(0, 1025, (50, len(lm_scoring.OFFSETS))), dice.integers(0, 1024, 50)
    net = lm_scoring.Network()
    before = net.vector.copy()
    net.learn(context, target)
    slope = np.sqrt(np.maximum(net.seen - 1e-6, 0))
    for place in np.argsort(-slope)[:20]:
        ends = []
        for step in (0.05, -0.05):
            moved = before.astype("f4").copy()
            moved[place] += step
            ends.append(lm_scoring.Network(moved).score(context, target).mean())
        assert abs(ends[0] - ends[1]) / 0.1 == pytest.approx(slope[place], rel=0.05, abs=1e-4)


def test_lm_prefers_prose_to_shuffled_words_and_random_letters(spark):
    """Of the mean log-likelihoods, that of a text is above that of its words in any order, and above all random letters."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = lm_scoring.vocabulary(documents)
    net, table = lm_scoring.train(documents, words), lm_scoring.spelling(documents, words)
    dice = random.Random(0)
    prose = [r.text for r in documents.filter(F.length("text").between(1500, 6000)).orderBy("doc_id").limit(100).collect()]
    rows = []
    for i, text in enumerate(prose):
        shuffled = text.split(" ")
        dice.shuffle(shuffled)
        rows += [(3 * i, text), (3 * i + 1, " ".join(shuffled)), (3 * i + 2, " ".join("".join(dice.choice("bcdfghjklmnpqrstvwxz") for _ in range(dice.randint(2, 9))) for _ in range(300)))]
    got = {r.doc_id: r.mean_log_likelihood for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string"), words, net, table=table).collect()}
    own, shuffled, letters = ([got[3 * i + k] for i in range(len(prose))] for k in range(3))
    assert np.mean([a > b for a, b in zip(own, shuffled, strict=True)]) >= 0.95
    assert max(letters) < np.quantile(own, 0.05)


def test_lm_vocabulary_grows_and_every_word_has_its_own_probability(spark):
    pool = [f"w{i}" for i in range(3000)]
    rows = [(k, " ".join(pool[i] for i in range(3000) if k < 12 + i % 7)) for k in range(20)] + [(50, "rowing rowed rower mowing mowed tower"), (51, None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = lm_scoring.vocabulary(documents)
    known, place = words
    assert len(known) == 3000 and len(lm_scoring.vocabulary(documents, least=1)[0]) == 3006
    share = np.exp(words.share)
    assert np.allclose(np.bincount(place, share)[np.unique(place)], 1, atol=1e-4) and lm_scoring.OTHER not in place
    net, table = lm_scoring.Network(), lm_scoring.spelling(documents, words)
    assert np.allclose(np.exp(table.reshape(256, 256)[97]).sum(), 1)
    # words that the vocabulary hasn't differ by their spelling, in equal contexts
    asked = spark.createDataFrame([(1, "mower"), (2, "zqxjk"), (3, "  Mower\n"), (4, None), (5, "w1 w2")], "doc_id bigint, text string")
    got = {r.doc_id: r.log_likelihood for r in lm_scoring.score(asked, words, net, table=table).collect()}
    assert got[1] > got[2] + 5 and got[1] == pytest.approx(got[3]) and got[4] == 0
    alone = {r.doc_id: r.log_likelihood for r in lm_scoring.score(asked, words, net).collect()}
    spelled = table.reshape(256, 256)
    assert alone[1] == alone[2] and got[1] - alone[1] == pytest.approx(sum(spelled[a, b] for a, b in zip(b" mower", b"mower ", strict=True)))
    assert got[5] - alone[5] == pytest.approx(sum(words.share[np.flatnonzero(known == h)[0]] for h in W.hashes([b"w1 w2"])[0]), abs=1e-4)
    assert lm_scoring.classes_for(10**6) > lm_scoring.classes_for(10**5) > lm_scoring.CLASSES
    empty = documents.limit(0)
    none = lm_scoring.vocabulary(empty)
    assert lm_scoring.score(documents, none, lm_scoring.train(empty, none), table=lm_scoring.spelling(empty, none)).count() == len(rows)

"""Operators that judge each row by itself: URL filter, host rules, HTML, BPE, secrets, language."""

import hashlib
import html
import random
import re
import time

import pytest

from bandwatch.llm import bpe, host_rules, html_text, language_id, secret_scan, token_counts, url_filter
from bandwatch.llm.common import remainder

from .helpers import LONG, empty, rough, table


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# URL filter

URLS = [
    (1, "http://Sub.Example.ORG/es/1?x=/en/1", "sub.example.org", "/es/1", "example.org/es/", "block"),
    (2, "https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    (4, "https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    (5, "http://a.com/de/x#y", "a.com", "/de/x", "com/de/", "block"),
    (6, "http://a.com/fr/x", "a.com", "/fr/x", "com/fr/", "allow"),
    (7, "http://cheap-pills.example.net/en/4", "cheap-pills.example.net", "/en/4", None, "block"),
    (8, "http://thering.example.net/en/4", "thering.example.net", "/en/4", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "no scheme/x", "", "", None, "allow"),
    (11, "http://org?q", "org", "", None, "allow"),
    (12, "x://A://b/c\nd", "a:", "//b/c\nd", None, None),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", 1, "x") for i, u, *_ in URLS], "page_id long, url string, html string, host int, rule string")
    got = rows(url_filter.judge(pages), "page_id")
    for i, _, host, path, rule, verdict in URLS:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert verdict in (None, got[i].verdict), i
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_model_tells_its_lists():
    weights, bias = url_filter.model()
    told = [(url_filter.chance(h, p, weights, bias) >= 0.5) == bool(y) for h, p, y in url_filter.labelled()]
    assert sum(told) / len(told) > 0.97


# Host rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_host_counts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a ", "b ", "é\t", "a b c ", "\n", "#x ", " \n", "\u2003z "]) for _ in range(rng.randint(0, 90))) for _ in range(80)]
    got = rows(host_rules.judge(table(spark, texts)))
    for i, t in enumerate(texts):
        r = got[i]
        n = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_host_verdicts(spark):
    """A host of junk loses its good documents too, one with two documents is drawn to the others' rate."""
    rng = random.Random(2)
    good, bad = (lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(80))), (lambda: " ".join(f"w{i}###" for i in range(60)))
    docs = table(spark, [good() for _ in range(200)], "good")
    junk = table(spark, [bad() for _ in range(200)] + [good()], "junk").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")
    small = table(spark, [bad(), good()], None).selectExpr("doc_id + 2000 AS doc_id", "text", "lang", "source", "n_chars")
    everything = docs.union(junk).union(small)
    got = rows(host_rules.judge(everything))
    assert all(got[i].kept for i in range(200))
    assert not got[1200].base_failed and not got[1200].kept and got[1200].host_verdict == "reject"
    kept = {r.doc_id for r in host_rules.keep(everything).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def brute_rates(hosts):
    """Shrunk rates of (docs, failures) per host, sum by sum."""
    n, k = sum(d for d, _ in hosts), sum(f for _, f in hosts)
    m, strength = k / n, 10_000.0
    chance = sum((1 - d / n) for d, _ in hosts)
    room = sum((1 - d / n) * (d - 1) for d, _ in hosts)
    if 0 < m < 1 and room > 1e-6:
        alike = (sum(d * (f / d - m) ** 2 for d, f in hosts) / (m * (1 - m)) - chance) / room
        strength = min(max(1 / alike - 1, 1.0), 10_000.0) if alike > 1e-9 else strength
    return [(f + m * strength) / (d + strength) for d, f in hosts]


@pytest.mark.parametrize("name", ["single", "mixed", "hot", "one", "all", "none"])
def test_host_prior(spark, name):
    """Chance is not taken for a difference between hosts: two failures of three reject no host among single documents."""
    rng = random.Random(3)
    hosts = {
        "single": [(1, int(i % 10 == 0)) for i in range(400)] + [(3, 2)],
        "mixed": [(n, sum(rng.random() < rate for _ in range(n))) for n, rate in ((rng.randint(1, 30), rng.choice([0.02, 0.2, 0.9])) for _ in range(150))],
        "hot": [(900, 30)] + [(rng.randint(1, 4), rng.randint(0, 1)) for _ in range(200)],
        "one": [(50, 20)],
        "all": [(3, 3), (1, 1)],
        "none": [(3, 0), (1, 0)],
    }[name]
    flags = [(f"h{i}", j < f) for i, (d, f) in enumerate(hosts) for j in range(d)]
    got = {r.host: r for r in host_rules.host_verdicts(spark.createDataFrame(flags, "host string, failed boolean")).collect()}
    for i, rate in enumerate(brute_rates(hosts)):
        assert got[f"h{i}"].shrunk_rate == pytest.approx(rate, rel=1e-9)
    if name == "single":
        assert got["h400"].host_verdict == "strict"
    if name == "mixed":
        assert {"reject", "strict"} <= {r.host_verdict for r in got.values()}


def test_host_rough(spark):
    docs = rough(spark)
    got = host_rules.judge(docs).collect()
    assert len(got) == 9 and all(r.base_failed for r in got if r.doc_id != 4)
    assert {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert host_rules.keep(docs).columns == docs.columns
    assert host_rules.judge(empty(spark)).count() == 0 and host_rules.keep(empty(spark)).count() == 0


# HTML

ARTICLE = "<article><h1>On &amp; on</h1><p><b>First, of   two.<br><p>Second\n one.</p><ul><li>a<li>b &lt;</ul></article>"
PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home, sweet home, all the way.</a></nav>" + ARTICLE + "<footer>F.</footer>", "On & on\nFirst, of two.\nSecond one.\na\nb <"),
    ('<div class="content"><h2>Title</h2><p>A long text, with commas. And more of it, that goes on and on.</p><p>Short.</p></div><div id="sidebar"><p>Latest, news. Other, things. And more than the text, perhaps, of all.</p></div>', "Title\nA long text, with commas. And more of it, that goes on and on.\nShort."),
    ("<article><p>Text, of it.</p><section class=comments><p>Nice post, thanks, bye.</p></section><form>f<input></form><aside>a</aside><div class='cookie-notice'>c</div></article>", "Text, of it."),
    ('<script>x = "<p>no</p>"</script><p title="a>b">q&nbsp;&#233;</p><!-- <p>c</p> --><script>open <p>never</p>', "q é"),
    ("just &lt;text&gt;", "just <text>"),
    ("<p></p>", ""),
    ("", ""),
    (None, ""),
    ("<p>" + LONG + "</p>", LONG),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = rows(html_text.main_text(pages), "page_id")
    for i, (_, want) in enumerate(PAGES):
        assert (got[i].url, got[i].text, got[i].n_chars) == (f"u{i}", want, len(want))
    assert html_text.main_text(pages.limit(0)).count() == 0


STORY = "A long story, with commas. And more of it, that goes on and on, until it ends."
TOLD = f"<h1>Title</h1><p>{STORY}</p><p>{STORY}</p>"
SAID = f"Title\n{STORY}\n{STORY}"
NOISE = "<div class='sidebar'><p>Latest, news.</p></div><div id=comments><p>Nice post, thanks, bye.</p></div>"


@pytest.mark.parametrize("page, want", [
    ('<article><p>On <a href="/the-hidden-valley">the valley, <b title="Hidden gems">its gems</b></a> and more.</p></article>', "On the valley, its gems and more."),
    ('<article data-hidden="false" title="Hidden gems"><p>Text, of it.</p></article>', "Text, of it."),
    ('<article><p>See <a href="/item?id=search">the item, or not</a> and more.</p></article>', "See the item, or not and more."),
    ("<article><p title='class=\"hidden\"'>Text, of it.</p><p class=x hidden>Not seen.</p><p style='display : none'>Nor this.</p></article>", "Text, of it."),
    (f'<div class="content has-sidebar">{TOLD}</div>{NOISE}', SAID),
    (f'<div id="main-no-comments">{TOLD}</div>{NOISE}', SAID),
    (f'<article class="post social-science">{TOLD}</article>{NOISE}', SAID),
    (f'<div class="page has-sidebar"><div class="post social-science">{TOLD}</div>{NOISE}</div>', SAID),
    (f'<form action="/"><div>{TOLD}</div>{NOISE}</form>', SAID),
    (f'<div class="widget"><main>{TOLD}</main></div><p>Some words.</p>{NOISE}', SAID),
    (f'<div class="overlay">{TOLD}</div>', SAID),
    (f"<div>{TOLD}</div><section class='related'><article><p>Another, story.</p></article></section>", SAID),
    (f"<article>{TOLD}</article><div class='comments-area'>" + f"<article class='comment'><p>{STORY} Yes.</p></article>" * 9 + "</div>", SAID),
    (f"<div>{TOLD}</div><form><label>Name</label><p>Leave a reply, please.</p></form>", SAID),
    (f"<article><p>{STORY} <span class='share'>Share this, now</span></p></article>", STORY),
])
def test_html_words_and_attributes(page, want):
    """Attributes count by their own name; a word in a class does not drop what the page is about."""
    assert html_text.extract(f"<html><body>{page}</body></html>") == want


def test_html_of_the_tables(spark):
    """Every page of the smallest table against its article cut out by pattern."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1].replace("<br>", " ")
        parts = [re.sub(r"<[^>]*>", "", x) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.extract(r.html) == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


# BPE


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.default_path())
    rng = random.Random(3)
    pool = "abcdefghijklmnop 'sSdDtTmMlLrReEvV  \n\t.,!?<|>0123456789éàçÄÖÜßñΣσςİ\u0300\u0301ÅΩ½²Ⅷ٣क्ष漢字😀\x1c\x1f\x85\xa0\u2028\u200b\u180e\ufeff\u3000\x00\xad"
    some = lambda n: "".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    texts = ["<|endoftext|>", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|>", "", "a" * 5000, "ab" * 400 + " " + "é" * 100, "x\u0301" * 90]
    texts += [some(40) + rng.choice(["", "<|endoftext|>", "<|startoftext|> "]) + some(40) for _ in range(2500)]
    for text, (ids, decoded, n) in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert (ids, n) == (" ".join(map(str, want)), len(want)), ascii(text)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_scan_and_heap_agree():
    vocabulary = bpe.Vocabulary(bpe.default_path())
    words = ["".join(random.Random(i).choices("theaningrs", k=2 + i % 60)).encode() for i in range(300)]
    assert vocabulary.merge(words) == [vocabulary._merge_long(w) for w in words]


def test_bpe_rough(spark):
    got = bpe.digests(rough(spark)).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == 9
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, nothing, nothing) for r in got if r.doc_id in (1, 2, 3))
    assert bpe.encode(empty(spark)).count() == 0
    told = {r.doc_id: r for r in bpe.encode(rough(spark)).collect()}
    assert told[7].decoded == "x</w>" and told[5].n_tokens == len(told[5].ids.split())


# Secrets

KEY = "AKIA" + "ABCD1234EFGH5678"


def plain_base(text):
    """The base patterns as stated, without short cuts."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(
        (
            ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
            ("access", r"AKIA[A-Z0-9]+", 0, 18),
            ("hex", r"[0-9a-f]+", 0, 16),
        )
    ):
        for m in re.finditer(pattern, text, re.A):
            if len(m[group]) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_secret_base_spans():
    rng = random.Random(5)
    bits = ["password", "ToKen", "api_key", "APIKEY", "ſecret", '"', "'", " ", ":", "=", "AKIA", "abcdef0123456789", "0f", "ABCDEFGH12345678", "é", "-", "/", "\n", "toKen = '"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secret_scan.base_spans(text) == plain_base(text), text


def test_secret_formats():
    """Unseen credentials of each shape are found, prose, numbers, dates and addresses are not."""
    rng = random.Random(6)
    for kind, start, rest, n in secret_scan.SHAPES:
        hits = [secret_scan.best(start + "".join(rng.choices(rest, k=n)))[1] >= secret_scan.MIN_BITS for _ in range(40)]
        assert sum(hits) >= 39, kind
    for text in ("thereisnothinghere12345", "4994226020900891", "https://www.example.com/page/12345", "2024-01-01T00:00:00Z", "name.92@mail2.example.com"):
        assert secret_scan.learned_spans(text, []) == []


def test_secret_inside_runs():
    """Credentials behind '=' and in addresses, without digits, several in a run and next to a base span."""
    key, other = "ghp_" + "aB3dEfGhIjKl" * 3, "npm_" + "ZyXwVuTsRqPo" * 3
    for text, want in (
        (f"export GH={key}", [key]),
        (f"https://{key}/owner/repository.git and more", [key]),
        (f"https://example.com/login/{other}/next-page/index.html", [other]),
        (f"a/b.c+d-{key}", [key]),
        (f"3D{key}", [key]),
        (other, [other]),
        (f"{key}={other}/{key}.", [key, other, key]),
        (f"{KEY}/{other}", [other]),
        ("a-plain-run-of-words/that_goes_on/for-a-while.and.ends=here", []),
    ):
        found = secret_scan.learned_spans(text, secret_scan.base_spans(text))
        assert [text[a:b] for a, b, _, _ in found] == want, text


@pytest.mark.parametrize("n", [70, 150, 323, 400, 1000, 20_000])
def test_secret_of_any_length(n):
    rng = random.Random(n)
    pool = secret_scan.UPPER + secret_scan.LOWER + secret_scan.DIGIT + "-_"
    part = lambda k: "".join(rng.choices(pool, k=k)) + "x"
    secret = "eyJ" + part(n // 3 - 5) + "." + part(n // 3) + "." + part(n - 2 * (n // 3) - 1)
    for before in ("Bearer ", "jwt=", "https://example.com/session/", "https://example.com/?jwt="):
        text = f"{before}{secret} and so on"
        at = len(before)
        assert [x[:3] for x in secret_scan.learned_spans(text, [])] == [(at, at + len(secret), "web_token")]


def test_secret_overlaps():
    """Of overlapping stretches the likeliest stays, as in a plain search over all pairs; a run of thousands of keys is no burden."""
    rng = random.Random(11)
    key = lambda: "AKIA" + "".join(rng.choices(secret_scan.UPPER + secret_scan.DIGIT, k=16))
    for _ in range(40):
        run = "".join(rng.choice([key(), "ghp_" + "".join(rng.choices(secret_scan.UPPER + secret_scan.LOWER, k=36)), "=", "/x"]) for _ in range(12))
        found = [(-bits, x, kind, y) for kind in secret_scan.model() for bits, x, y in secret_scan.stretches(run, kind) if bits >= secret_scan.MIN_BITS]
        plain = []
        for minus, x, kind, y in sorted(found):
            if all(y <= p or q <= x for p, q, _, _ in plain):
                plain.append((x, y, kind, -minus))
        assert secret_scan.learned_spans(run + " end", []) == sorted(plain) or len(run) < secret_scan.MIN_LENGTH
    begun = time.monotonic()
    assert len(secret_scan.learned_spans(("/" * 60).join(key() for _ in range(10000)), [])) == 10000
    assert time.monotonic() - begun < 30


def test_secret_digest_and_mask(spark):
    text = f"é {KEY} and token = 'abcdefghijkl' and ghp_{'aB3' * 12}."
    docs = table(spark, [text, "clean", None])
    got = rows(secret_scan.digest(secret_scan.find(docs)))
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex) == (1, 1, 0)
    assert got[0].base_sha256 == hashlib.sha256(b"access:2:22,assign:27:48").hexdigest()
    assert got[0].spans == "access:2:22,assign:27:48,code_host:54:94"
    assert got[1].spans == got[2].spans == ""
    masked = secret_scan.mask(docs)
    assert masked.columns == docs.columns
    assert [r.text for r in masked.orderBy("doc_id").collect()] == ["é [access] and [assign]' and [code_host].", "clean", None]


def test_secret_rough(spark):
    assert secret_scan.digest(secret_scan.find(rough(spark))).count() == 9
    assert secret_scan.find(empty(spark)).count() == 0 and secret_scan.mask(empty(spark)).count() == 0
    assert secret_scan.mask(rough(spark)).columns == rough(spark).columns


# Language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(language_id.learnable(docs))
    found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where(remainder(found.doc_id, 4) == 2).collect()
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_rejects(spark):
    texts = ["the house is on the hill and the river runs below"] * 5 + ["das Haus steht auf dem Hügel und der Fluss ist unten"] * 5
    docs = table(spark, texts).selectExpr("doc_id", "text", "if(doc_id < 5, 'en', 'de') AS lang", "source", "n_chars")
    model = language_id.fit(docs)
    got = rows(language_id.predict(table(spark, ["the hill", "der Hügel", "ёжик щука", None, "", "12 !?"]), model))
    assert [got[i].lang_pred for i in range(6)][:2] == ["en", "de"]
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    assert not got[0].rejected and all(got[i].rejected for i in (2, 3, 4, 5))
    kept = language_id.keep(table(spark, ["the hill", "ёжик щука", None]), model).collect()
    assert [(r.doc_id, r.lang) for r in kept] == [(0, "en")]


def test_language_long_text_in_pieces(monkeypatch):
    text = "mañana the Ünder " * 50
    whole = language_id.counted([text])
    monkeypatch.setattr(language_id, "BLOCK", 64)
    assert (language_id.counted([text]) == whole).all()


@pytest.mark.parametrize("labels", [True, False])
def test_language_rough(spark, labels):
    docs = rough(spark)
    model = language_id.fit(docs if labels else empty(spark))
    got = language_id.predict(docs, model).collect()
    assert len(got) == 9 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3) or not labels)
    assert language_id.keep(docs, model).columns == docs.columns
    assert language_id.predict(empty(spark), model).count() == 0


# Pages and texts that grow without bound


@pytest.mark.parametrize("page, want", [
    ("<div>" * 100_000 + "words, here.", "words, here."),
    ("</ " * 350_000, ("</ " * 350_000).strip()),
    ("<div>" * 30_000 + "</x>" * 30_000 + "words.", "words."),
    ("<b>" * 50_000 + "one<hr>two", "one\ntwo"),
    ("<p>a <!-- b " + "<q" * 10_000, "a"),
])
def test_deep_and_odd_pages_take_linear_time(page, want):
    import time

    began = time.time()
    assert html_text.extract(page) == want
    assert time.time() - began < 6


def test_encoder_remembers_within_bounds():
    rng = random.Random(8)
    e, letters = bpe.Encoder(bpe.default_path()), [chr(0x4E00 + i) for i in range(3000)]
    for _ in range(4):
        texts = ["".join(rng.choices(letters, k=300)) for _ in range(100)]
        again = bpe.Encoder(bpe.default_path()).encode(texts[:5])
        assert e.encode(texts)[:5] == again
    assert not e.known and e.bytes == 0
    e.encode(["a few short words a few"])
    assert sorted(e.known) == ["a", "few", "short", "words"]
    e.bytes = bpe.CACHED_BYTES + 1
    assert e.encode(["few new"])[0][2] == 2 and sorted(e.known) == ["few", "new"]


def test_bpe_merges_a_word_once():
    """A word that stood within a run is not merged again by itself, nor the other way round."""
    encoder = bpe.Encoder(bpe.default_path())
    first = encoder.encode(["'s storm, wind storm's 'swell été!"])
    merged = []
    merge = encoder.vocabulary.merge
    encoder.vocabulary.merge = lambda words: merged.extend(words) or merge(words)
    again = encoder.encode(["storm wind, été !", "", None])
    assert merged == []
    assert again == bpe.Encoder(bpe.default_path()).encode(["storm wind, été !", "", None])
    assert first == bpe.Encoder(bpe.default_path()).encode(["'s storm, wind storm's 'swell été!"])


def test_token_counts_take_the_faster_library_for_plain_texts():
    texts = ["a plain text's words, 12345  and <|endoftext|> blanks   \n\n", "été über", "x" * 3000, " " * 3000, "", None]
    slow = token_counts.Counter(token_counts.default_path())
    slow.fast = None
    expected = slow.counts([*texts, "漢 words"])
    counter = token_counts.Counter(token_counts.default_path())
    assert counter.counts([*texts, "漢 words"]) == expected
    counter._short = lambda texts, which, found: None if not which else pytest.fail("took the slower one")
    assert counter.counts(texts) == expected[:-1]

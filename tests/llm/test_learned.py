"""Quality, toxicity, licenses and HTML."""

import random
import re
import time
import zlib

import numpy as np
import pytest
import regex

from trackloom.llm import html_main, licences, quality, toxicity
from trackloom.llm.html_main import extract_main_text, main_text
from trackloom.llm.licences import NOTICES, Notices, scan, scan_licences
from trackloom.llm.quality import score_quality
from trackloom.llm.toxicity import Lexicon, drop_toxic, fold, score_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out_pairs(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    return [(r.score, r.predicted, r[label]) for r in rows]


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    scored = score_quality(docs, labels)
    pairs = held_out_pairs(scored, labels, "quality")
    assert scored.count() == docs.count() and len(pairs) > 30
    assert np.mean([p == y for _, p, y in pairs]) > 0.95
    bad, good = ([s for s, _, y in pairs if y == v] for v in (0, 1))
    assert np.mean([b < g for b in bad for g in good]) > 0.95
    r = scored.first()
    assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    pairs = held_out_pairs(score_toxicity(docs, labels), labels, "toxic")
    english = np.mean([p == y for _, p, y in pairs])
    assert len(pairs) > 30 and english > 0.93
    assert all(y for _, p, y in pairs if p)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()


@pytest.mark.parametrize("score,label", [(score_quality, "quality"), (score_toxicity, "toxic")])
def test_scores_of_odd_rows(spark, score, label):
    rows = [(1, None), (2, ""), (3, "word " * 60000), (4, "an idiot"), (4, "an idiot"), (None, "x"), (6, "😀 é")]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t in rows], "doc_id long, text string, label string, score double")
    for labels in ([], [(1, None), (2, 1), (3, 0), (2, 0), (9, 1)], [(1, 1)]):
        got = score(docs, spark.createDataFrame([(*x, 7) for x in labels], f"doc_id long, {label} int, text int")).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert score(docs.limit(0), none).count() == 0
    if label == "toxic":
        assert {r.doc_id: r.predicted for r in score(docs, none).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, None: 0, 6: 0}


def test_density_is_gaussian():
    rng = np.random.RandomState(0)
    x = np.r_[rng.randn(300, len(quality.FEATURES)), 2 + 0.3 * rng.randn(300, len(quality.FEATURES))]
    y = np.r_[np.zeros(300, int), np.ones(300, int)]
    model = quality.fit(x, y)
    z = (x - model.centre) / model.scale
    logs = []
    for m, i, p in zip(model.means, model.inverse, model.log_prior):
        cov = np.linalg.inv(i.T @ i)
        d = z - m
        logs.append(p - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -50, 50))))


def test_folding_and_exceptions():
    lexicon = Lexicon({"idiot": 4.0, "clown": 4.0, "stupid": 4.0})
    assert fold("1D10T, ѕtuріd!  Сlown") == " idiot stupid clown "
    assert lexicon.sums("you 1d10t")[0] == pytest.approx(np.log1p(4))
    assert lexicon.sums("a clown fish, idiots, stupidity") == (0.0, 0.0)
    assert lexicon.sums("idiot idiot clown")[0] == pytest.approx(np.log1p(12))
    assert lexicon.sums(None) == lexicon.sums("") == (0.0, 0.0)


def test_toxicity_by_brute_force(spark):
    """The learned entries, the sums of hits and the scores, each by its definition over whole texts."""
    rng = random.Random(13)
    mild, rude = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)], [f"vile{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(6000)]
    texts = [(i, " ".join(rng.choice(mild) for _ in range(900)), 0) for i in range(300)]
    texts += [(1000 + i, " ".join(x for w in rng.sample(rude, 400) for x in (rng.choice(mild), w)), 1) for i in range(300)]
    texts += [(2000, "trash bin IDI0T fоol", 1), (2001, "take out the trash, clown car", 0), (2002, "", 0), (2003, None, 0)]
    docs = spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    seen, size = {0: {}, 1: {}}, {0: 0, 1: 0}
    train = [x for x in texts if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    for _, t, y in train:
        words = fold(t).split()
        for before, w in zip(["", *words], words):
            if len(w) >= 3:
                seen[y].setdefault(w, set()).add(before)
        size[y] += len(t or "")
    odds = {w: len(b) / (len(seen[0].get(w, ())) + 0.5) * size[0] / size[1] for w, b in seen[1].items() if len(b) >= toxicity.CONTEXTS}
    lexicon = dict.fromkeys(toxicity.INSULTS, toxicity.INSULT_WEIGHT) | {w: float(np.log(o)) for w, o in odds.items() if o >= toxicity.ODDS}
    assert len(lexicon) > 5000

    def sums(text):
        words = fold(text).split()
        safe = set()
        for p in (p.split() for p in toxicity.EXCEPTIONS):
            safe |= {k for i in range(len(words)) if words[i : i + len(p)] == p for k in range(i, i + len(p))}
        total = sum(lexicon.get(w, 0) for k, w in enumerate(words) if k not in safe)
        return [np.log1p(total), np.log1p(1000 * total / max(1, len(words)))]

    x = np.array([sums(t) for _, t, _ in train])
    weights = toxicity.logistic(x, np.array([y for *_, y in train], float), np.ones(len(train)))
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    for i, t, _ in texts:
        assert abs(got[i] - 1 / (1 + np.exp(-(weights[0] + np.array(sums(t)) @ weights[1:])))) < 1e-6


def test_licence_words_by_brute_force(spark):
    rng, rows = random.Random(1), []
    bits = ["MIT", "License", "mit license", "Apache License", "general public license", "été", "a-b", "GNU", "x", "\n", "mit", "LICENSE,", "apache"]
    for i in range(200):
        rows.append((i, " ".join(rng.choice(bits) for _ in range(rng.randrange(12)))))
    rows += [(900, None), (901, ""), (902, "mit " * 40000 + "license"), (902, "mit license"), (None, "mit license")]
    got = scan_licences(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, next(t for k, t in rows if k == r.doc_id))))):
        if i in (902, None):
            continue
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} and r.score >= (1.0 if labels else 0.0)
    assert scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_notices_with_edits():
    engine, rng = Notices(NOTICES), random.Random(2)
    for text, k in zip(engine.texts, engine.edits):
        for _ in range(20):
            edited = list(text)
            for _ in range(rng.randrange(k + 1)):
                at = rng.randrange(2, len(edited) - 2)
                if " " not in edited[at - 1 : at + 2]:  # a lost word takes a space with it
                    edited[at : at + 1] = rng.choice([[], ["q"], [edited[at], "q"]])
            *_, labels, spans, score = scan("xx " + "".join(edited) + " yy", engine)
            assert NOTICES[text] in labels and spans and score > 0.8
    assert scan("nothing of this kind is here, no license at all", engine)[3] == set()
    assert scan("Licensed under CC BY-ND 4.0. All rights reservd", engine)[3] == {"cc-by-nd", "proprietary"}
    spans = [(0, 10, 1, 0), (5, 15, 2, 1), (10, 20, 3, 1), (12, 14, 4, 2), (21, 25, 5, 2), (22, 24, 6, 1)]
    assert licences._least_edited(sorted(spans)) == [(0, 10, 1, 0), (10, 20, 3, 1), (22, 24, 6, 1)]


def test_finds_of_few_edits_by_brute_force():
    """Every find is within its edits, and every place within them is found or overlaps a better find."""
    rng = random.Random(5)
    engine = Notices({"abcde fghij": "x", "fghij klmno": "y"})
    for _ in range(300):
        text = " ".join(rng.choice(["abcde", "fghij", "klmno", "abde", "fghiij", "q"]) for _ in range(rng.randrange(1, 9)))
        found = engine.spans(text)
        for n, notice in enumerate(engine.texts):
            for m in re.finditer(rf"(?=\b({notice})\b)", text):
                assert any(f[2] == n and f[3] == 0 and f[0] == m.start() for f in found)
        for a, b, n, k in found:
            assert regex.fullmatch(rf"(?:{engine.texts[n]}){{e<={k}}}", text[a:b])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Menu one</a><li><a href=/2>Menu two</a></ul></nav><!-- c --><div class="ad box">Buy now</div>
<div id=cookie-notice>We use cookies</div><article><h1>Head &amp; line</h1><p>First   para<b>graph</b>\n of &lt;text&gt; &#233;.<p>Second<br>third &nbsp; x</p>
<form><input name=q>Ask<button>Go</button></form><aside>Related</aside><ul><li>point one</ul><section class="comments"><p>I agree</p></section></article>
<footer>&copy; nobody</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line\nFirst paragraph of <text> é.\nSecond\nthird x\npoint one"
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(5))
    assert main_text(f"<div><a href=x>aa</a></div><div><a>b</a></div><div><a>c</a></div>{body}").count("\n") == 4
    assert [main_text(x) for x in (None, "", "<p></p><script>x</script>", "<!-- x")] == [""] * 4
    assert main_text("<p class=ad>no<p>yes") == "yes"
    assert main_text("<p>" + "long text " * 100000) == ("long text " * 100000).strip()


def test_main_text_of_plain_raw_pages():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(3))
    plain = main_text(f"<article>{body}</article>")
    assert plain.count("\n") == 2
    for around in ("<body class='single has-sidebar'>%s</body>", "<div id='content' class='col with-sidebar'>%s</div>", "<form id=aspnet>%s</form>", "<div data-id=ad data-role='menu'>%s</div>", '<div title="class=ad">%s</div>'):
        assert main_text(around % f"<article>{body}</article>") == plain, around
    assert main_text(f"<body class='ad-free'>{body}</body>") == main_text(f"<div data-id=ad>{body}</div>") == plain
    assert main_text(f"<html><head><meta charset=x><title>T</title><body>{body}</body>") == plain
    assert main_text(f"<p>{'word ' * 30}0</p><svg width=1 /><iframe src=x />{body[body.index('</p>') + 4:]}") == plain
    assert main_text(f"<canvas>{body}<button>") == main_text(f"<a name=top>{body}") == main_text(f"<a href=x>{body}") == plain
    assert main_text(f"<article>{body}</article><div id=comments><article class=comment><p>{'no ' * 99}</p></article></div>") == plain
    assert main_text(f"{body}<script>{body}") == plain


def test_main_text_keeps_an_articles_light_and_linked_lines():
    long, short = "word " * 400, "end " * 75
    links = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(3))
    want = f"Title\n{long.strip()}\nlink 0\nlink 1\nlink 2\n{short.strip()}"
    for tag in ("article", "main"):
        assert main_text(f"<p>before</p><{tag}><h1><a href=/>Title</a></h1><p>{long}</p><ul>{links}</ul><p>{short}</p></{tag}><p>after</p>") == want
    assert main_text(f"<p>{long}</p><ul>{links}</ul><p>{short}</p>") == long.strip()  # without such an element lines are weighed
    padded = "one two three four <a href=x>\n" + " " * 60 + "&nbsp;&#x20;five</a>"
    assert main_text(f"<p>{padded}</p>") == "one two three four five"


def test_main_text_where_windows_decide():
    """Text between first surge and last dive stays whole; what lies outside goes, with or without an article's mark."""
    long = "word " * 60 + "end."
    menu = "".join(f"<li><a href=/{i}>see {i}</a>" for i in range(4))
    inner = f"<h1>Head</h1><p>{long}</p><p><a href=r>See the full report of the committee here</a></p><ul>{menu}</ul><p>Closing words.</p>"
    want = f"Head\n{long}\nSee the full report of the committee here\nsee 0\nsee 1\nsee 2\nsee 3\nClosing words."
    assert main_text(f"<article><ul>{menu}</ul>{inner}<ul>{menu}</ul></article>") == want
    plain = f"<p>Home</p><p>About us</p><p>Contact</p><h1>Head</h1><p>{long}</p><p>short item</p><p>{long}</p><p>Imprint</p><p>Privacy</p>"
    assert main_text(plain) == f"Head\n{long}\nshort item\n{long}"
    assert main_text("<article><p>ab</p></article>") == "ab" and main_text("<article><a href=x>ab</a></article>") == "ab"


def test_names_and_light_lines_of_an_article():
    """Whole names tell what stands beside the article; a link or label at its end, and a list in a recipe, stay."""
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(3))
    plain = main_text(f"<article>{body}</article>")
    for name in ("entry-ad-free", "social-science-article", "article-header", "no-sidebar", "has_menu_open", "notice-of-motion"):
        for page in (f'<div class="{name}">{body}</div>', f'<article><div class="{name}">{body}</div></article>'):
            assert main_text(page) == plain, name
    for name in ("ad", "x ad", "cookie-banner", "site-footer", "comments-list", "top_nav", "sidebar-left"):
        for page in (f'<div class="{name}"><p>{"other " * 50}</p></div>{body}', f'<article>{body}<div id="{name}"><p>{"other " * 50}</p><p>more.</p></div></article>'):
            assert main_text(page) == plain, name
    for last in ("<p><a href=x>Source</a></p>", "<ul><li>point<li><a href=x>Full text</a></ul>", "<p>fin</p>"):
        got = main_text(f"<article>{body}{last}</article>")
        assert got.startswith(plain) and got.split("\n")[-1] in ("Source", "Full text", "fin")
    assert main_text(f"<div>{body}<p>Flour</p><p>Sugar</p><p>Salt</p><p>Mix well.</p></div>") == f"{plain}\nFlour\nSugar\nSalt\nMix well."
    # a menu of several lines between paragraphs is one line and parts nothing
    assert main_text(f"{body}<nav><p>a</p><p>b</p><p>c</p><p>d</p><p>e</p></nav><p>{'word ' * 3}end.</p>").endswith("end.")


def test_windows_choose_the_text(spark):
    """Without the windows the pages' lines are other texts, with them they are the articles."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    every = ["\n".join(x.text for x in html_main.lines(p) if x.text) for p in pages]
    assert sum(main_text(p) == e for p, e in zip(pages, every)) == 0
    assert all(main_text(p) in e for p, e in zip(pages, every))


def test_odd_tables_of_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>one two three.</p>", 5)] * 3 + [(1, "v", None, 5), (None, None, "<p>x</p>", 5)], "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, extract_main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", "one two three.", 14)] * 3 + [(1, "v", "", 0), (None, None, "x", 1)], key=str)
    assert extract_main_text(df.limit(0)).count() == 0 and extract_main_text(df).columns == ["page_id", "url", "text", "n_chars"]


def plain_runs(weights, window):
    """By the definition: lines from a surge (nothing in the window before) to the next dive (nothing in the window after)."""
    out, start = [], None
    for i, w in enumerate(weights):
        if w and start is None:
            start = i
        if w and sum(weights[i + 1 : i + 1 + window]) == 0:
            out.append((start, i + 1))
            start = None
    return out


def test_runs_by_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, 1, 40]) for _ in range(rng.randrange(40))]
        for window in (1, 2, 3, 5):
            assert html_main.runs(weights, window) == plain_runs(weights, window)


def test_malformed_pages_take_time_in_proportion():
    for page in ("<script " * 150_000, "<a " * 300_000, "<div>" * 40_000 + "</p>" * 40_000, '<a href="x' * 100_000, "<svg>" * 80_000, "<![CDATA[" * 100_000, "<div><article>" * 20_000):
        began = time.perf_counter()
        assert main_text(page) == ""
        assert time.perf_counter() - began < 8, page[:20]


def test_pages_against_their_paragraphs(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        plain = [html_main.entities.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"<(?:p|/p|br|h1|/h1)>", inner)]
        assert r.text == "\n".join(y for x in plain if (y := " ".join(x.split()))) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None, "a"), (1, "u", "", "b")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in extract_main_text(odd).collect()] == [("", 0)] * 2

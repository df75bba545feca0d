"""Cases that an operator once left out: each test failed before its operator did the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendwise.llm import license_scan as LS
from lendwise.llm import line_dedup as LD
from lendwise.llm import page_text as PT
from lendwise.llm import toxicity_crf as TX

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], DOCS)


# --- 1 line dedup --------------------------------------------------------------------------------


def test_long_passages_on_few_sites(spark):
    rng = np.random.default_rng(5)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 50)) for _ in range(4)]
    hanzi = "".join(chr(0x4E00 + x) for x in rng.integers(0, 5000, 60))
    nineteen = " ".join(f"w{x}" for x in rng.integers(0, 5000, 19))
    rows = []
    for i in range(60):
        lines = [f"own line {i}", "short line"]
        if i < 12:  # on 2, 3 and 4 sites, and four times on one
            lines.insert(i % 3, passages[i % 4])
        if i in (20, 21):
            lines += [hanzi, nineteen]
        rows.append((i, "\n".join(lines), "en", "s0" if i < 12 and i % 4 == 0 else f"s{i % 6}"))
    sites = {}
    for _, t, _, s in rows:
        for line in t.split("\n"):
            sites.setdefault(line, set()).add(s)
    assert len(sites[passages[0]]) == 1 and {len(sites[p]) for p in passages[1:]} <= {2, 3, 4} and len(sites["short line"]) == 6
    wide = {p for p in [*passages, hanzi] if len(sites[p]) >= 2}
    seen, expect = set(), []
    for i, t, _, _ in rows:
        kept = []
        for line in t.split("\n"):
            if line not in wide or line not in seen:
                kept.append(line)
            seen.add(line)
        expect.append((i, "\n".join(kept)))
    out = LD.remove_boilerplate_lines(docs(spark, rows))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == expect
    assert out.agg(F.sum("lines_removed")).first()[0] == sum(t.count(p) for p in wide for _, t, _, _ in rows) - len(wide)


# --- 3 license scans -------------------------------------------------------------------------------


def licenses(text, templates=None):
    return {m[0] for m in LS.scan_text(LS.Index.build(templates or LS.TEMPLATES), text)}


def test_short_notices_need_their_distinguishing_words():
    assert licenses("Text is Licensed under CC BY-NC 4.0.") == {"CC-BY-NC-4.0-notice"}
    for other in ("Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", "Licensed under CC BY-NC-SA 4.0"):
        assert "CC-BY-NC-4.0-notice" not in licenses(f"Text is {other}.")
    gpl = LS.TEMPLATES["GPL-3.0-notice"]
    assert licenses(f"so {gpl} so") == {"GPL-3.0-notice"}
    assert "GPL-3.0-notice" not in licenses(gpl.replace("version 3", "version 2"))
    assert "GPL-3.0-notice" not in licenses(gpl.replace("GNU General", "GNU Lesser General"))
    for mit in ("It is released under MIT license.", "Released under the MIT Licence", "released under the MIT License"):
        assert licenses(mit) == {"MIT-notice"}
    assert licenses("licensed under the MIT License or the Apache License, Version 2.0") == {"MIT-notice", "Apache-2.0-notice"}


def test_each_license_text_is_reported_as_itself():
    templates = LS.catalogue()
    index = LS.Index.build(templates)
    for name, text in templates.items():
        got = LS.scan_text(index, f"Some words before. {text} Some words after.")
        assert [m[0] for m in got] == [name] and got[0][1] == 1.0, (name, got)
    names = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-3-Clause", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0"}
    assert {f"{n}-text" for n in names} <= set(templates)
    edited = templates["BSD-3-Clause-text"].replace("copyright holder", "Foundation").replace("COPYRIGHT HOLDERS", "AUTHORS")
    assert [m[0] for m in LS.scan_text(index, edited)] == ["BSD-3-Clause-text"]
    assert LS.scan_text(index, "The man of the house is in the city, as well as one of the others.") == []


def test_file_notices_are_not_taken_for_each_other():
    templates = LS.catalogue()
    index = LS.Index.build(templates)
    gnu = {n: templates[n] for n in LS.GNU_FAMILY}
    assert len(gnu) == 6
    for name, text in gnu.items():
        assert [m[0] for m in LS.scan_text(index, f"/* {text} */ int main")] == [name]
        assert [m[0] for m in LS.scan_text(index, text.replace("hope", "wish").replace("either", ""))] == [name]
    apache = templates["Apache-2.0"]
    assert [m[0] for m in LS.scan_text(index, apache)] == ["Apache-2.0"]
    assert "Apache-2.0" not in licenses(apache.replace("Version 2.0", "Version 1.1").replace("LICENSE-2.0", "LICENSE-1.1"), templates)
    for version in ("1", "4"):
        assert not licenses(templates["GPL-3.0"].replace("version 3", f"version {version}"), templates) & set(gnu)


# --- 4 page text -------------------------------------------------------------------------------------


@pytest.mark.parametrize("attrs", [
    'class="layout has-sidebar"', "class='no-comments'", 'title="the hidden cost"', 'data-hidden="false"', 'data-x="a class=ad"',
    'id="sidebar"', 'class="widget"', 'data-role="navigation" lang=en',
])
def test_attributes_around_the_text(attrs):
    page = f'<body><div class="ad">buy</div><nav>menu</nav><div {attrs}><p>First words of it.</p><p>Second words.</p></div></body>'
    assert PT.main_text(page) == "First words of it. Second words."


def test_attributes_inside_the_article():
    page = ('<article><p>see <a href="https://x.org/hidden/gems">gems</a> and <a href="/p?id=share">that</a></p>'
            '<div class="cookie-banner">we use</div><p hidden>no</p><p class="x" hidden>no</p><p STYLE="display: none">no</p></article>')
    assert PT.main_text(page) == "see gems and that"


def test_site_lines_inside_main_and_past_copies(spark):
    site = "<div>Share this page with friends</div>"
    inner = "<main>{s}<p>Story {0} tells at length what happened to {0} in the year {0}.</p><p>More about {0} here.</p><div>Imprint</div></main>"
    bare = "<body><div>Site name</div><p>Body {0} with its own words.</p><p>Rest {0}</p><div>All rights</div></body>"
    rows = [(i, f"http://m.com/p/{i}", inner.format(f"n{i}", s=site)) for i in range(5)]
    rows += [(10 + i, f"http://n.com/p/{i}", bare.format("same")) for i in range(12)]  # copies
    rows += [(30, "http://n.com/q/1", bare.format("other"))]
    article = "<article><p>One long text that stands on two pages of a site.</p><p>It goes on here.</p></article>"
    rows += [(40, "http://o.com/a", article + "<p>x1</p><p>x2</p>"), (41, "http://o.com/b", article + "<p>y1</p><p>y2</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in PT.extract_main_text(pages, page_block=4).collect()}
    for i in range(5):
        assert got[i] == f"Story n{i} tells at length what happened to n{i} in the year n{i}. More about n{i} here."
    assert {got[10 + i] for i in range(12)} == {"Body same with its own words. Rest same"}
    assert got[30] == "Body other with its own words. Rest other"
    assert got[40] == got[41] == "One long text that stands on two pages of a site. It goes on here."


def test_articles_keep_what_one_neighbour_shares(spark):
    """A quoted sentence, a closing paragraph of a whole site and loose lines in the middle are the article's own."""
    page = ("<body><div>Site name</div><article><div>Share this</div><p>Story {0} begins on its own day {0}.</p><div>loose {1}</div>"
            "<p>{2}</p><p>All texts are free to copy.</p></article><div>All rights</div></body>")
    quote = "One sentence that two pages quote."
    rows = [(i, f"http://q.com/p/{i}", page.format(f"n{i}", "on every page", quote if i in (3, 4) else f"Words of {i} alone.")) for i in range(9)]
    rows += [(20 + i, f"http://r.com/{i}", f"<article><div>Only {'two' if i < 2 else i} share</div><p>Body {i} has its words, own {i}.</p></article>")
             for i in range(6)]
    got = {r["page_id"]: r["text"] for r in PT.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(9):
        middle = quote if i in (3, 4) else f"Words of {i} alone."
        assert got[i] == f"Story n{i} begins on its own day n{i}. loose on every page {middle} All texts are free to copy."
    assert got[20] == "Only two share Body 0 has its words, own 0." and got[24] == "Only 4 share Body 4 has its words, own 4."


# --- 10 toxicity -------------------------------------------------------------------------------------


def test_training_windows_over_the_whole_text():
    marks = np.ones(TX.WINDOW * 40, np.int8)
    got = [TX.chosen_windows(marks, k) for k in range(50)]
    assert all(len(set(g)) == TX.WINDOWS_PER_DOC - 1 and g == TX.chosen_windows(marks, k) for k, g in enumerate(got))
    assert {s for g in got for s in g} == set(range(0, len(marks), TX.WINDOW))
    assert TX.chosen_windows(marks[: TX.WINDOW + 1], 3) == [0, TX.WINDOW] and TX.chosen_windows(marks[:0], 3) == []


def test_sample_is_counted_with_documents(spark, monkeypatch):
    frame = docs(spark, [(i, f"text {i}", "en", "a") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(8000)], "doc_id bigint, toxic int")
    sizes, real = [], TX.evidence_features

    def seen(sample):
        sizes.append(sample.count())
        return real(sample)

    monkeypatch.setattr(TX, "evidence_features", seen)
    TX.train_toxicity(frame, labels, train_rows=400)
    assert sizes[0] > 280  # all rows outside the held-out fold


# --- 7 packing ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_every_vocabulary_are_the_library_s(name):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from lendwise.llm.packing import WordTokenizer

    path = public_tokenizers.path(name)
    ours, library, rng = WordTokenizer(path), Tokenizer.from_file(path), random.Random(1)
    assert ours.word_wise == name.startswith("word")
    texts = ["", "  Don't STOP\u00b2 it's 100\u00bd ok_go\n\n", "<|endoftext|> x", "a\x1cb \u0130\u00aa\u00ba \u00b5m \u00df"]
    texts += ["".join(chr(rng.choice([rng.randrange(0x21, 0x100), 32, rng.randrange(0x20, 0x17F), 39, 115])) for _ in range(60)) for _ in range(1500)]
    texts += [f"{chr(c)}a {chr(c)}1{chr(c)}" for c in range(1, 0x300)]
    got = [np.frombuffer(i, dtype="<u4").tolist() for i in ours.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]

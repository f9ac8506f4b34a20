"""Mixing, quality sampling, licences and HTML."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import html_text, licences, mixing, quality

WEIGHTS = {"domain": {"d0": 4, "d1": 1}, "lang": {"en": 3}, "source": {"src1": 5}}


def slow_budgets(leaves, weights, budget, levels=mixing.LEVELS):
    """Water filling by bisection-free exact arithmetic: full children leave, the rest share again."""
    out = {}

    def share(items, budget, depth):
        children = defaultdict(dict)
        for path, cap in items.items():
            children[path[depth]][path] = cap
        caps = {c: sum(v.values()) for c, v in children.items()}
        weight = {c: weights.get(levels[depth], {}).get(c, 1) for c in children}
        open_, left, got = set(children), budget, {}
        while True:
            total = sum(weight[c] for c in open_)
            full = [c for c in open_ if Fraction(caps[c], weight[c]) <= Fraction(left, total)]
            if not full:
                break
            for c in full:
                got[c] = caps[c]
                open_.discard(c)
            left = budget - sum(got.values())
            if not open_:
                break
        total = sum(weight[c] for c in open_)
        for c in open_:
            got[c] = left * weight[c] // total
        for c, v in children.items():
            if depth == 2:
                out.update({p: got[c] for p in v})
            else:
                share(v, got[c], depth + 1)

    share(leaves, budget, 0)
    return out


def words(t):
    return len((t or "").encode().split())


ZERO = {"domain": {"d0": 4, "d1": 0}, "lang": {"en": 3, "fr": 0}, "source": {"src1": 5, "src2": 0}}
ALL_ZERO = {"lang": {"": 0, "en": 0, "de": 0, "fr": 0, "es": 0}}


@pytest.mark.parametrize(
    ("name", "permille", "epochs", "weights"),
    [
        ("docs", 1000, 2, WEIGHTS), ("docs", 300, 1, WEIGHTS), ("docs", 5000, 3, WEIGHTS), ("odd", 1000, 2, WEIGHTS), ("empty", 1000, 2, WEIGHTS),
        ("docs", 1000, 2, ZERO), ("odd", 1000, 2, ZERO), ("docs", 1000, 2, ALL_ZERO),
    ],
)
def test_mix(request, name, permille, epochs, weights):
    frame = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"], r["lang"] or "", r["source"] or "") for r in frame.collect()]
    leaf = lambda lang, s: (f"d{int('0' + ''.join(c for c in s if c.isdigit())) % 4}", lang, s)
    tokens = defaultdict(list)
    for i, t, lang, s in rows:
        if words(t):
            tokens[leaf(lang, s)].append(("" if i is None else str(i), words(t)))
    for k in list(tokens):  # weight 0 leaves out
        if not all(weights.get(level, {}).get(name, 1) for level, name in zip(mixing.LEVELS, k, strict=True)):
            del tokens[k]
    total = sum(n for v in tokens.values() for _, n in v)
    caps = {k: epochs * sum(n for _, n in v) for k, v in tokens.items()}
    expected = Counter()
    if tokens:
        budgets = slow_budgets(caps, weights, min(total * permille // 1000, sum(caps.values())))
        for k, v in tokens.items():
            size = sum(n for _, n in v)
            whole, rest = divmod(budgets[k], size)
            key = lambda i, e=whole: hashlib.sha256(f"3:{e}:{i}".encode()).hexdigest()
            for i, n in v:
                upto = sum(m for j, m in v if key(j) <= key(i))
                for e in range(whole + (rest > 0 and upto <= rest)):
                    expected[i, k, n, e] += 1
    got = mixing.mix(frame, weights, seed=3, budget_permille=permille, max_epochs=epochs).collect()
    found = Counter(("" if r["r"]["doc_id"] is None else str(r["r"]["doc_id"]), (r["domain"], r["lang"], r["source"]), r["tokens"], r["epoch"]) for r in got)
    assert found == expected


@pytest.mark.parametrize("weights", [{"domain": {"d0": -1}}, {"country": {"x": 1}}])
def test_wrong_weights_raise(docs, weights):
    with pytest.raises(ValueError, match="weights of"):
        mixing.mix(docs, weights)


def test_mix_over_many_ranges(docs, monkeypatch):
    expected = Counter((r["r"]["doc_id"], r["epoch"]) for r in mixing.mix(docs, WEIGHTS, seed=3).collect())
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 4)
    assert Counter((r["r"]["doc_id"], r["epoch"]) for r in mixing.mix(docs, WEIGHTS, seed=3).collect()) == expected


def test_importance_sample(docs, labels):
    rows = quality.importance_sample(docs, labels, seed=1).collect()
    assert len(rows) == docs.count()
    k = sum(r["kept"] for r in rows)
    order = sorted(rows, key=lambda r: (-r["key"], r["doc_id"]))
    assert [r["kept"] for r in order] == [True] * k + [False] * (len(rows) - k)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = [r["kept"] == (known[r["doc_id"]] == 1) for r in rows if r["doc_id"] in known]
    assert np.mean(right) > 0.95


def test_sample_holds_out(spark, docs, labels):
    """Labels of even ids train, odd ids judge."""
    got = quality.importance_sample(docs, labels.where("doc_id % 2 = 0"), seed=1)
    judged = got.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in judged]) > 0.9


def test_sample_odd_tables(spark, odd, empty, labels):
    none = spark.createDataFrame([], labels.schema)
    got = quality.importance_sample(odd, none).collect()
    assert len(got) == odd.count() and all(r["kept"] and r["score"] == 0 for r in got)
    assert quality.importance_sample(empty, labels).count() == 0
    left = quality.keep_target_like(odd, none)
    assert left.columns == odd.columns and left.count() == odd.count()


def slow_sample(rows, labels, seed, k, neutral):
    """Both models as plain dictionaries, the sum of log ratios, noise, and the k first."""
    import math

    from cuelake.llm import ngrams

    def grams(text):
        tokens = [int(x) for x in ngrams.token_hashes(text or "")]
        for i, t in enumerate(tokens):
            mixed = [t * 0x9E3779B97F4A7C15]
            if i + 1 < len(tokens):
                pair = (t * 0xC2B2AE3D27D4EB4F + tokens[i + 1] * 0x165667B19E3779F9) % 2**64
                mixed.append(pair ^ pair >> 29)
            yield from ((x % 2**64 >> 33) % quality.BINS for x in mixed)

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if labels.get(i) == (1, 0):
            target.update(grams(t))
    total = sum(target.values()) + quality.SMOOTHING * quality.BINS, sum(raw.values()) + quality.SMOOTHING * quality.BINS
    out = []
    for i, t in rows:
        score = sum(
            math.log((target[b] + quality.SMOOTHING) / total[0]) - math.log((raw[b] + quality.SMOOTHING) / total[1]) - neutral for b in grams(t)
        )
        h = hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest()
        noise = -math.log(-math.log((int.from_bytes(h, "little") + 0.5) / 2.0**64))
        out.append((i, score, score + noise))
    return out, {i for i, _, _ in sorted(out, key=lambda r: (-r[2], r[0]))[:k]}


@pytest.mark.parametrize("k", [1, 57, 200])
def test_sample_equals_slow_models(docs, labels, k):
    known = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    neutral = 0.0 if k == 57 else quality.fit(docs, labels).threshold
    slow, kept = slow_sample(rows, known, 4, k, neutral)
    given = 0.0 if k == 57 else None
    got = {r["doc_id"]: r for r in quality.importance_sample(docs, labels, seed=4, k=k, neutral=given).collect()}
    assert len(got) == len(slow)
    for i, score, key in slow:
        assert got[i]["score"] == pytest.approx(score, abs=1e-6) and got[i]["key"] == pytest.approx(key, abs=1e-6)
    assert {i for i, r in got.items() if r["kept"]} == kept


def test_ties_at_the_cut(spark, monkeypatch):
    """Equal keys go by id, repeated ids together, null ids first; bounds that close in find the same row."""
    rows = [(2.0, 5), (1.0, 9), (1.0, 3), (1.0, 3), (1.0, 7), (0.5, 1), (0.5, None)] + [(-float(i), 100 + i) for i in range(300)]
    frame = spark.createDataFrame(rows, "key double, id long")
    order = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
    for ranked in (1 << 18, 4):
        monkeypatch.setattr(quality, "RANKED", ranked)
        for k in (1, 2, 3, 4, 5, 6, 7, 8, 150, 306):
            assert quality._cut(frame, k) == order[k - 1]
    many = spark.range(2000).select(F.lit(1.0).alias("key"), "id")
    assert quality._cut(many, 700) == (1.0, 699)


def test_keep_equals_sample(docs, labels):
    kept = {r["doc_id"] for r in quality.importance_sample(docs, labels, seed=1).where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_target_like(docs, labels, seed=1).collect()} == kept


def registered(docs, labels, **more):
    """As the query and the pipeline call it: plain ratios, a text counts as 50 n-grams, k from the labels' share."""
    return quality.importance_sample(docs, labels, share=quality.good_share(labels), neutral=0.0, length=50, **more)


def test_registered_sample_is_no_threshold(spark):
    """Which rows are kept changes with the seed near the cut, and only there; their number does not."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    k = round(quality.good_share(labels) * docs.count())
    drawn, means = [], {}
    for seed in range(4):
        rows = registered(docs, labels, seed=seed).collect()
        means = {r["doc_id"]: r["mean"] for r in rows}
        assert all(r["score"] == pytest.approx(50 * r["mean"]) for r in rows)
        drawn.append(frozenset(r["doc_id"] for r in rows if r["kept"]))
        assert len(drawn[-1]) == k
    above = frozenset(sorted(means, key=lambda i: (-means[i], i))[:k])
    assert len(set(drawn)) > 1 and any(d != above for d in drawn)
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert all(len(good & d) > 0.97 * len(good) for d in drawn)


@pytest.mark.parametrize("k", [1, 2])
def test_inclusion_follows_the_weights(k):
    """Over many seeds, the first of the top k is drawn in proportion to the weights, the second among those left."""
    scores = np.log([8.0, 4.0, 2.0, 1.0, 1.0])
    drawn = np.zeros((5, 5))
    n = 6000
    for seed in range(n):
        model = quality.Model(np.zeros(quality.BINS), 0.0, seed, 0.0, 50)
        key = [s + model.gumbel(str(i)) for i, s in enumerate(scores)]
        first, second = np.argsort(key)[::-1][:2]
        drawn[first, second] += 1
    w = np.exp(scores) / np.exp(scores).sum()
    expected = w if k == 1 else w + np.array([sum(w[j] * w[i] / (1 - w[j]) for j in range(5) if j != i) for i in range(5)])
    got = (drawn.sum(axis=1) + (drawn.sum(axis=0) if k == 2 else 0)) / n
    assert np.abs(got - expected).max() < 4 * 0.5 / np.sqrt(n)


def test_share_of_labels(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 0), (None, 1, None)]
    assert quality.good_share(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")) == 0.75
    assert quality.good_share(spark.createDataFrame([], "doc_id long, quality int, toxic int")) == 1.0


def test_ngrams_piece_by_piece():
    from cuelake.llm import ngrams

    tokens = ngrams.token_hashes("the quick brown fox, jumps over the lazy dog again and again")
    whole = np.sort(ngrams.bins(tokens, 1024))
    for step in (1, 2, 5, 100):
        assert np.array_equal(np.sort(np.concatenate(list(ngrams.pieces(tokens, 1024, step)))), whole)


@pytest.fixture(scope="module")
def classifier():
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()
    rng = np.random.default_rng(2)
    return licences.train([" ".join(rng.choice(words, 12)) for _ in range(200)])


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("lorem ipsum. Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("You need a driving license to rent a car here.", None),
        ("dolor sit amet lorem", None), ("", None), ("the version of this license is under the software", None),
    ],
)
def test_licence_lines(classifier, text, family):
    assert [f for _, f, _, _ in licences.scan_text(classifier, f"lorem\n{text}\nipsum dolor")] == ([family] if family else [])


def test_licence_scan(docs, odd, empty):
    got = {r["doc_id"]: r["families"] for r in licences.scan(docs).collect()}
    marks = {
        "Apache License": "apache-2.0", "MIT License": "mit", "GNU General": "gpl", "CC BY-NC": "cc-by-nc", "All rights reserved.": "proprietary",
    }
    expected = {r["doc_id"]: sorted(f for m, f in marks.items() if m in r["text"]) for r in docs.collect()}
    assert got == expected
    assert licences.scan(odd).where("n_found > 0").count() == 0 and licences.scan(odd).count() == odd.count()
    assert licences.scan(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("SPDX-License-Identifier: LGPL-3.0-or-later", "lgpl"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl"), ("SPDX-License-Identifier: BSD-2-Clause", "bsd"),
        ("SPDX-License-Identifier: AGPL-3.0-only", "agpl"), ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"), ("Licensed under CC BY-NC-ND 3.0", "cc-by-nc-nd"),
        ("Licensed under CC BY 3.0", "cc-by"), ("                    GNU GENERAL PUBLIC LICENSE", "gpl"), ("Apache License", "apache-2.0"),
        ("SPDX-License-Identifier: EPL-2.0", None), ("Licensed under the Eclipse Public License v2.0", None), ("SPDX-License-Identifier: Artistic-2.0", None),
        ("SPDX-License-Identifier: WTFPL", None), ("Distributed under the Boost Software License, Version 1.0.", None),
    ],
)
def test_families_versions_and_strangers(classifier, text, family):
    assert [f for _, f, _, _ in licences.scan_text(classifier, text)] == ([family] if family else [])


def test_whole_templates_held_out():
    """Trained without every third template of a family: most of the rest is classed right, and hardly any confirmed wrongly."""
    known = licences.templates()
    fit = {f: [t for i, t in enumerate(texts) if i % 3 != 2] for f, texts in known.items()}
    plain = [f"a plain line number {i} about nothing in particular that somebody wrote" for i in range(100)]
    model = licences.train(plain, known=fit)
    right = wrong = total = 0
    for family, texts in known.items():
        for text in texts[2::3]:
            found = [f for _, f, _, _ in licences.scan_text(model, text)]
            classed = model.families[model.predict(licences._bins([text]))[0][0]]
            right, wrong, total = right + (classed == family), wrong + (found not in ([], [family])), total + 1
    assert right > 0.6 * total and wrong < 0.1 * total


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("All rights reserved.", "proprietary"), ("Copyright 2020 Some Company. All rights reserved.", "proprietary"),
        ("No part of this work may be reproduced without written permission.", "proprietary"), ("CC0 1.0 Universal.", "public-domain"),
        ("All seats on the train were reserved.", None), ("All rights of way across the field are old.", None),
    ],
)
def test_sentences_of_notices(classifier, text, family):
    assert [f for _, f, _, _ in licences.scan_text(classifier, f"lorem\n{text}\nipsum dolor")] == ([family] if family else [])


def test_every_template_is_found_under_its_family(classifier):
    """Whole templates, the standard notices of the three GNU licences among them; the classifier knew them."""
    missed = [(f, t) for f, texts in licences.templates().items() for t in texts if f not in {x[1] for x in licences.scan_text(classifier, t)}]
    assert missed == []


GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)


@pytest.mark.parametrize(
    ("text", "family"),
    [
        (GNU.format(""), "gpl"), (GNU.format("Lesser "), "lgpl"), (GNU.format("Affero "), "agpl"), ("This file is part of Foo. Foo" + GNU.format("")[12:], "gpl"),
        ("Dieses Werk steht unter der Lizenz CC BY-SA 4.0", "cc-by-sa"),
        ("Cette œuvre est mise à disposition sous licence CC BY-NC 4.0.", "cc-by-nc"), ("Esta obra está bajo una licencia CC BY 4.0", "cc-by"),
        ("Eclipse Public License - v 2.0", None), ("European Union Public Licence v. 1.2", None), ("The Artistic License 2.0", None), ("GPLv3000", None),
    ],
)
def test_short_notices_languages_and_strangers(classifier, text, family):
    assert [x[1] for x in licences.scan_text(classifier, text)] == ([family] if family else [])


def test_tree_knows_its_pages():
    for html, known in html_text.LABELLED:
        found = html_text.blocks(html)
        assert html_text.tree().predict(html_text.features(found)).tolist() == [bool(k) for k in known]


def test_html_pages(spark, sf_dir):
    import html as h
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html_text.extract(pages).collect():
        body = re.search(r"<article>(.*?)</article>", r["r"]["html"], re.S)[1]
        assert r["text"] == " ".join(h.unescape(re.sub(r"<[^>]+>", " ", body)).split())
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("html", ["", None, "<", "<p", "<script>x", "<!-- <p>a", "a & b &lt; &#x41;", "<a href='>'>x</a>", "</div></div><p>", "<p>" * 2000])
def test_broken_html(spark, html):
    row = html_text.extract(spark.createDataFrame([(1, html, "t")], "page_id long, html string, text string")).first()
    assert row["r"]["text"] == "t" and row["n_chars"] == len(row["text"])


def test_references_and_noise():
    para = "several plain words that make a paragraph of the article here "
    page = (
        f"<body><div class='cookie-notice'>{para * 3}</div><header>top</header><article><p>A &amp; B&nbsp;&#8211; {para}</p><p>{para}<br>x</p>"
        f"<div class=comments><p>{para}</p></div><form><p>{para}</p></form></article><aside>{para * 4}</aside></body>"
    )
    assert html_text.main_text(page) == f"A & B – {para}{para}x"


def test_comments_teasers_and_page_names():
    import re

    para = "several plain words that make a paragraph of the article here "
    story = f"<h1>a title</h1><p>{para * 3}</p><p>{para * 2}</p><p>the end</p>"
    text = " ".join(re.sub(r"<[^>]+>", " ", story).split())
    comment, teaser = (f"<article class={c}><p>{para * 3}</p><p>{para * 2}</p></article>" for c in ("comment", "teaser"))
    for page in (
        f"<article>{story}</article><section class=comments>{comment}{comment}</section>",
        f"<article>{story}</article><section class=comments>{comment.replace(' class=comment', '')}</section>",
        f"<article>{story}</article>{comment}{comment}", f"<article>{story}</article><aside>{teaser}</aside>",
        f"<article>{story}</article><div class='related-posts'>{teaser}{teaser}</div>", f"<article>{story}</article><footer>{teaser}</footer>",
        f"<div class=has-sidebar><article class='post ad-free share'>{story}</article><aside>{teaser}</aside></div>",
        f"<form><div id=page class=comments-open><main class=content>{story}</main></div></form>",
    ):
        assert html_text.main_text(f"<html class=nav-open><body class='has-sidebar single-post'>{page}<footer>the site</footer></body></html>") == text
    bare = "".join(f"<p>{para * n}</p>" for n in (6, 3, 4))
    for names in ("", " class=has-sidebar", " id=menu class='post content'"):
        page = f"<body{names}><p><a href=x>one</a></p><p><a href=x>two more</a></p><div>{bare}</div><p><a href=x>terms</a></p></body>"
        assert html_text.main_text(page) == (para * 13).strip()


PARA = "several plain words that make a paragraph of the article which goes on until it has about forty words in it, so that nobody could take it for a line of a menu or for the few words below a picture, and then it ends. "


@pytest.mark.parametrize(
    "page",
    [
        "<body class='post-template header-fixed sidebar-right'>{0}</body>", "<div class='post has-sidebar'>{0}</div>", "<div class='layout-menu'>{0}</div>",
        "<div class='header'>{0}</div>", "<div class='widget'><div class=menu-x>{0}</div></div>", "<article>{0}", "<nav><a href=x>home</a></nav><main>{0}</main>",
        "{0}<footer>all rights reserved</footer>", "<header class='site-header'>name</header><div class='no-sidebar'>{0}</div><nav><a href=x>next</a></nav>",
    ],
)
def test_theme_names_do_not_lose_the_article(page):
    assert html_text.main_text(page.format(f"<p>{PARA}</p><p>{PARA}</p>")) == (PARA * 2).strip()


SIXTY = "word " * 59 + "end."
TWENTY = "these are some twenty words that stand beside the story and are not a part of it at all, as anyone sees."


@pytest.mark.parametrize(
    "tag",
    ["div id=sidebar-left", "div class=sidebar-right", "div class='alert alert-info'", "div class=cookiebar", "div class=cc-window", "div id=sitenotice",
     "section id=discussion", "div class=legal-disclaimer", "div hidden", "div aria-hidden=true", "div style='display: none'", "div role=complementary"],
)
def test_boilerplate_beside_a_short_article(tag):
    name = tag.split()[0]
    for page in ("<article><p>{0}</p></article>{1}", "{1}<article><p>{0}</p></article>"):
        html = page.format(SIXTY, f"<{tag}><p>{TWENTY}</p></{name}>")
        assert html_text.main_text(f"<html><body>{html}</body></html>") == SIXTY


@pytest.mark.parametrize(
    "page",
    ["<div class='ads-layout'><article>{0}</article></div>", "<div class='related-content-wrap'><article>{0}</article></div>",
     "<div class='promo-article'>{0}</div>", "<div class=comments-wrap>{0}</div>", "<nav><a href=x>home</a></nav><div class=sponsored>{0}</div>"],
)
def test_misleading_names_do_not_lose_the_article(page):
    assert html_text.main_text(page.format(f"<h1>A title here</h1><p>{PARA}</p><p>{PARA}</p>")) == f"A title here {PARA}{PARA}".strip()


def test_long_comments_stay_out():
    comments = f"<div class=comments><p>{PARA}</p><p>{PARA}</p><p>{PARA}</p><p>{PARA}</p></div>"
    for page in (f"<article><p>{PARA}</p><p>{PARA}</p></article>{comments}", f"<div><p>{PARA}</p><p>{PARA}</p></div>{comments}"):
        assert html_text.main_text(page) == (PARA * 2).strip()


def test_names_are_one_feature_of_several():
    """The root of the tree is no list of names, and the blocks before and after have their splits."""

    def used(node):
        return set() if node.feature < 0 else {node.feature} | used(node.left) | used(node.right)

    assert html_text.tree().feature == 3
    assert used(html_text.tree()) & {0, 1} and used(html_text.tree()) & {4, 5} and {2, 6, 7} <= used(html_text.tree())


def test_attributes_by_the_rules():
    story = f"{PARA}</p><p>{PARA}</p>"
    for tag in ("<p title=it's>", "<p class=\"x>", "<p class='x>", '<p title="a > b">', "<p title='a > b' x>", "<p a=b/>", "<p a = b>", '<p "x">', "<p a=>", "<p =a>", "<p\na\n=\n'b'\n>"):
        assert html_text.main_text(f"<article>{tag}{story}</article>") == (PARA * 2).strip(), tag
    kinds = [(k, v, a) for k, v, a in html_text.tokens("<A HREF='x' b=it's c>t</a ><svg/>u<script>if (a</b) x</script >v<!-- w --><?pi?>x</>y")]
    assert kinds == [
        ("open", "a", [("href", "x"), ("b", "it's"), ("c", "")]), ("text", "t", []), ("close", "a", []), ("text", " ", []), ("text", "u", []),
        ("text", " ", []), ("text", "v", []), ("text", "x", []), ("text", "y", []),
    ]


@pytest.mark.parametrize(
    "page",
    ["<p " * 100_000, "<p a='" * 100_000, '<p a="' * 99_999, "<" * 200_000, "<!--" * 100_000, "<script>" * 100_000, "<svg/>" * 50_000, "</" * 100_000,
     "<p a" + " " * 1_000_000 + ">x", "<p " + "= " * 100_000, "<div>" * 50_000 + "</nav>" * 50_000, "<div><nav>" * 30_000 + "</div>" * 30_000, "&" * 200_000,
     "<div class=menu><p>a b</p>" * 50_000, "<div class=comments><p>a b</p>" * 50_000],
)
def test_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 10


def test_pages_of_all_kinds(spark):
    """Empty table, repeated rows, null keys and very long pages."""
    schema = "page_id long, url string, html string, r string, text string"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    page = "<nav><a href=x>home</a></nav><article>" + f"<p>{PARA}</p>" * 5000 + "</article>"
    rows = [(1, "u", page, "r", "t"), (1, "u", page, "r", "t"), (None, None, None, None, None), (None, "v", "<p>", "r", None)]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["text"] for r in got) == ["", "", (PARA * 5000).strip(), (PARA * 5000).strip()]
    assert all(r["n_chars"] == len(r["text"]) for r in got)

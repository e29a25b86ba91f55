"""The page labeller: blocks of broken and clean markup, held-out accuracy, and the articles of the given pages."""

import html
import re
import time

import numpy as np
import pytest

from lodestone.llm import main_text as mt
from lodestone.llm.html_blocks import leaf_blocks

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        (" \n&nbsp; ", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b &lt;i&gt;<i>c</i>d<br>e\n\t f</p>g", ["a", "b <i>cd e f", "g"]),
        ("<ul><li>a<li>b</ul>x<table><tr><td>1<td>2<tr><th>3</table>", ["a", "b", "x", "1", "2", "3"]),
        ("<head><title>t</head></title><script>'</head><p>no'</script></head><body>yes", ["yes"]),
        ("<HEAD><meta charset=utf-8><BODY CLASS=x>open head", ["open head"]),
        ("a<!-- <p>no</p> -->b<!doctype html><?php no ?>c", ["abc"]),
        ("a<!-- no end <p>no", ["a"]),
        ("<script>no</script><STYLE>no</STYLE><noscript>no</noscript><textarea><p>no</textarea>yes", ["yes"]),
        ("<button>yes", ["yes"]),
        ("<div title='a>b' class=\"c\">x</div><a href=\"y>z\">w</a>", ["x", "w"]),
        ("1 < 2 and 3 <4 </ 5 <", ["1 < 2 and 3 <4 </ 5 <"]),
        ("<p class=\"open>x</p><p>y</p>", ["x", "y"]),
        ("</div></p></li>a</ul>", ["a"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in leaf_blocks(page)] == texts


def test_paths_and_links():
    (block,) = leaf_blocks('<div id="SideBar"><section class=most-read>a <a href=x>bc</a></section></div>')
    assert block.own == "section" and block.linked == 2 and block.text == "a bc"
    same = leaf_blocks("<div class='side bar'><section role='most read'>x</section></div>")[0]
    assert block.path == same.path


@pytest.mark.parametrize("part", ["<a \"", "<", "<div>", "<!--", "<script>", "<head>", "</div>", "<svg>", "<p>", "<li>", "<b", "&", "<button>", "'\"<x "])
def test_long_pages_take_linear_time(part):
    start = time.perf_counter()
    leaf_blocks(part * 200_000 + "x")
    assert time.perf_counter() - start < 5


def test_gradients():
    pages, labels = mt.labelled_blocks(5, 1)
    model = {k: v.astype(float) for k, v in mt._new_model(np.random.default_rng(0)).items()}
    features, truth = mt.Features(pages), np.concatenate(labels)
    _, grads = mt.gradients(model, features, truth)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for step in (1e-3, -2e-3):
            model[name][at] += step
            losses.append(mt.gradients(model, features, truth)[0])
        model[name][at] += 1e-3
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[at], rel=0.02)


def test_both_ways_of_reading_agree():
    """Pages of any lengths together give what the padded network of training gives."""
    model = mt.trained(60, 1)
    pages, labels = mt.labelled_blocks(40, 3)
    for page, label, chance in zip(pages, labels, mt.judged(model, pages)):
        (alone,) = mt.judged(model, [page])
        assert np.allclose(chance, alone, atol=1e-4)
        loss = -np.mean(np.where(label, np.log(chance + 1e-7), np.log(1 - chance + 1e-7)))
        assert mt.gradients(model, mt.Features([page]), label)[0] == pytest.approx(loss, rel=1e-3)


def test_held_out_accuracy():
    pages, labels = mt.labelled_blocks(500, 20_001)
    said, y = np.concatenate(mt.judged(mt.trained(), pages)) > 0.5, np.concatenate(labels)
    assert (said == y).mean() > 0.98
    assert (said & y).sum() / said.sum() > 0.97 and (said & y).sum() / y.sum() > 0.97


def plain_article(page):
    """The given pages keep their article in its own element."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page).group(1)
    blocks = [re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inner)]
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_given_pages(spark):
    got = spark.read.parquet(PAGES)
    want = {r.page_id: plain_article(r.html) for r in got.collect()}
    found = {r.page_id: r.text for r in mt.main_text(got).collect()}
    assert set(found) == set(want)
    assert sum(found[i] == want[i] for i in want) >= 0.985 * len(want)


def test_rows_without_text(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<nav><a href=x>home</a></nav>"), (4, "u", "<article><h1>Plain words</h1><p>" + "The words of the long text go on. " * 20 + "</p></article>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars").repartition(3)
    got = sorted((str(r.page_id), r.url or "", r.text[:11]) for r in mt.main_text(df).collect())
    assert got == sorted([("1", "u", ""), ("2", "", ""), ("None", "u", ""), ("3", "u", ""), ("4", "u", "Plain words")] * 2)
    assert mt.main_text(df.where("false")).count() == 0

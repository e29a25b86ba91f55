"""Chunker rules, one hand-written document each, and random outlines against a stack walk."""

import random

import pytest

from lodestone.functions.text import anchor, stripped, token_estimate
from lodestone.operators.chunker import chunk_documents, last_of_each_id, split_paragraphs
from pyspark.sql import functions as F


def docs(spark, *contents):
    return spark.createDataFrame([(f"d{i}.md", c, "dom", "con", "1") for i, c in enumerate(contents)], "path string, content string, domain string, concept string, version string")


def chunked(spark, *contents, most=1500):
    rows = chunk_documents(docs(spark, *contents), most).orderBy("file_path", "pos").collect()
    return [[(r.text, list(r.parent_headings)) for r in rows if r.file_path == f"d{i}.md"] for i in range(len(contents))]


def test_golden_documents(spark):
    big = "word " * 1300
    got = chunked(
        spark,
        "", "# T\nbody", "intro\n# T\nx\n## A\ny", "## A", "# T\n### S\n## A", "## A\n```\n## no\n```\nend", "## A\n```\n## no\n## nor", "## A\n#x\n####### x\n ## x",
        f"## Top\nlost\n### One\n{big}\n### Two\n{big}", f"## Top\n{big}{big}", "## A\none\n## A\ntwo", None,
    )
    intro = ("# Introduction", [])
    assert got[0] == [intro] and got[11] == [intro]
    assert got[1] == [intro, ("# T\n\nbody", [])]
    assert got[2] == [("## A\n\ny", ["T"])]
    assert got[3] == [("## A", ["Introduction"])]
    assert got[4] == [("## A", ["T"])]
    assert got[5] == [("## A\n\n```\n## no\n```\nend", ["Introduction"])]
    assert got[6] == [("## A\n\n```\n## no\n## nor", ["Introduction"])]
    assert got[7] == [("## A\n\n#x\n####### x\n ## x", ["Introduction"])]
    assert [(t[:7], p) for t, p in got[8]] == [("### One", ["Introduction", "Top"]), ("### Two", ["Introduction", "Top"])]
    assert len(got[9]) == 1
    assert [t for t, _ in got[10]] == ["## A\n\none", "## A\n\ntwo"]


def walk(content, most):
    """Chunks by a stack and recursion."""
    root = {"level": 0, "kids": []}
    node = {"level": 1, "heading": "Introduction", "lines": [], "kids": []}
    root["kids"].append(node)
    stack, code = [root, node], False
    for line in content.split("\n"):
        hashes = len(line) - len(line.lstrip("#"))
        if line.strip().startswith("```"):
            code = not code
        elif not code and 1 <= hashes <= 6 and line[hashes : hashes + 1] == " ":
            node = {"level": hashes, "heading": line[hashes:].strip(), "lines": [], "kids": []}
            while stack[-1]["level"] >= hashes:
                stack.pop()
            stack[-1]["kids"].append(node)
            stack.append(node)
            continue
        node["lines"].append(line)

    def render(s):
        own = [("#" * s["level"] + " " + s["heading"]).strip(), "\n".join(s["lines"]).strip()]
        return "\n\n".join([x for x in own if x] + [render(k) for k in s["kids"]])

    def cut(s, parents):
        text = render(s)
        if max(1, len(text) // 4) <= most or not s["kids"]:
            return [(text, parents)]
        return [c for k in s["kids"] for c in cut(k, parents + [s["heading"]])]

    def all_of(s, parents):
        here = [(s, parents)] if s["level"] else []
        below = parents + ([s["heading"]] if s["level"] else [])
        return here + [x for k in s["kids"] for x in all_of(k, below)]

    every = all_of(root, [])
    target = 2 if any(s["level"] == 2 for s, _ in every) else 1
    return [c for s, p in every if s["level"] == target for c in cut(s, p)]


def test_random_outlines_match_a_stack_walk(spark):
    rng = random.Random(5)
    contents = []
    for _ in range(120):
        lines = []
        for _ in range(rng.randrange(25)):
            lines.append(rng.choice(["", "some words here", "```", "#" * rng.randrange(1, 7) + " " + rng.choice(["A", "B b", "C-c"]), "#" * rng.randrange(1, 7) + " h", "text"]))
        contents.append("\n".join(lines))
    assert chunked(spark, *contents, most=12) == [walk(c, 12) for c in contents]


def test_scalars(spark):
    rows = [("Été & Co.",), ("a  b--c",), ("!!!",), ("  X_y ",), ("",)]
    got = spark.createDataFrame(rows, "h string").select(anchor(F.col("h")), token_estimate(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("été-co", 2), ("a-b-c", 1), ("", 1), ("x_y", 1), ("", 1)]
    assert spark.createDataFrame([("  a b\x1f\n",)], "h string").select(stripped(F.col("h"))).first()[0] == "a b"


def test_equal_headings_keep_the_last(spark):
    rows = last_of_each_id(chunk_documents(docs(spark, "## A\none\n## A\ntwo"))).collect()
    assert [(r.id, r.text, r.dup_count) for r in rows] == [("d0.md#a", "## A\n\ntwo", 2)]


@pytest.mark.parametrize("most", [3, 8])
def test_paragraphs(spark, most):
    giant = "x" * (8 * most)
    text = f"One two. Three four! Five six? Seven.\n\nshort\n\n{giant}. Tail one. Tail two."
    got = [r.part for r in split_paragraphs(spark.createDataFrame([(text,), ("",), (None,)], "text string"), most).orderBy("part_no").collect()]
    want = []
    for para in text.split("\n\n"):
        if max(1, len(para) // 4) <= most:
            want.append(para)
            continue
        run = ""
        import re

        for s in re.split(r"(?<=[.!?])\s+", para):
            joined = f"{run} {s}" if run else s
            if max(1, len(joined) // 4) <= most:
                run = joined
                continue
            want += [run] if run else []
            run = s
            if max(1, len(s) // 4) > most:
                want.append(s)
                run = ""
        want += [run] if run else []
    assert got == want


def test_documents_are_dealt_once(spark):
    """Lines, sections, chunks and the last of each id stay where their document was dealt to."""
    rows = spark.createDataFrame([("a.md", "x\n## A\none\n## A\ntwo", "d", "c", "1"), ("b.md", None, None, None, None), ("c.md", "## B\n" + "z " * 40 + "\n### C\nw", "", "", "")], "path string, content string, domain string, concept string, version string")
    found = last_of_each_id(chunk_documents(rows, 5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    text_shuffles = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(text_shuffles) <= 2, plan  # the lines, and the metadata of the documents
    assert sorted((r.id, r.dup_count) for r in found.collect()) == [("a.md#a", 2), ("b.md#introduction", 1), ("c.md#c", 1)]

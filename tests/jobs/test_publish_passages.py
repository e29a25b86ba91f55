"""Passages by domain: runs again, runs of some domains, odd rows, against a plain cutter."""

import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs.publish_passages import DEFAULTS, publish, read_catalogue, read_passages

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
SHORT = {"max_tokens": 60}


def plain_passages(text, most):
    """Paragraphs, and greedy runs of whole sentences of the long ones."""
    out = []
    for p in (p.strip() for p in (text or "").split("\n\n")):
        if not p:
            continue
        if len(p) // 4 <= most:
            out.append(p)
            continue
        run = ""
        for s in re.split(r"(?<=[.!?])\s+", p):
            joined = f"{run} {s}" if run else s
            if len(joined) // 4 <= most:
                run = joined
                continue
            out += [run] if run else []
            run = s if len(s) // 4 <= most else ""
            out += [] if run else [s]
        out += [run] if run else []
    return out


def shown(spark, target):
    return sorted((r.domain, r.doc_id, r.part_no, r.passage) for r in read_passages(spark, target).collect())


@pytest.fixture()
def target(tmp_path):
    return str(tmp_path / "published")


def test_passages_and_catalogue(spark, target):
    counts = publish(spark, DOCUMENTS, target, SHORT)
    docs = spark.read.parquet(DOCUMENTS).collect()
    want = sorted((d.lang, d.doc_id, i, p) for d in docs for i, p in enumerate(plain_passages(d.text, 60)))
    assert shown(spark, target) == want
    assert counts == {"read": len(docs), "written": len(want), "domains": len({w[0] for w in want})}
    listed = {r.domain: r for r in read_catalogue(spark, target).collect()}
    for domain, r in listed.items():
        mine = [w for w in want if w[0] == domain]
        assert (r.documents, r.passages, r.tokens) == (len({w[1] for w in mine}), len(mine), sum(max(1, len(w[3]) // 4) for w in mine))
    # Again: the same rows, none twice.
    assert publish(spark, DOCUMENTS, target, SHORT) == counts and shown(spark, target) == want


def test_one_domain_anew(spark, target, tmp_path):
    docs = spark.read.parquet(DOCUMENTS)
    publish(spark, DOCUMENTS, target, SHORT)
    before = shown(spark, target)
    changed = str(tmp_path / "changed.parquet")
    docs.withColumn("text", F.lit("All new. ")).write.parquet(changed)
    publish(spark, changed, target, {**SHORT, "domains": ["de"]})
    after = shown(spark, target)
    assert [r for r in after if r[0] != "de"] == [r for r in before if r[0] != "de"]
    assert {r[3] for r in after if r[0] == "de"} == {"All new."}
    listed = {r.domain: r.passages for r in read_catalogue(spark, target).collect()}
    assert listed["de"] == docs.where("lang = 'de'").count() and set(listed) == {r[0] for r in before}
    # All anew: a domain that the input no longer has is gone.
    fewer = str(tmp_path / "fewer.parquet")
    docs.where("lang <> 'fr'").write.parquet(fewer)
    publish(spark, fewer, target, SHORT)
    assert shown(spark, target) == [r for r in before if r[0] != "fr"]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_odd_rows(spark, target, tmp_path):
    odd = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\n ", None, None), (4, "one\n\n\n\ntwo", None, "b"), (4, "three", "", None), (None, "nameless", "en", "c"), (5, "x" * 100_000, "de", "d"), (6, "No end " * 20_000, "de", "d")]
    source = str(tmp_path / "odd.parquet")
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").selectExpr("*", "'clash' AS part", "'clash' AS domain").write.parquet(source)
    publish(spark, source, target, SHORT)
    found = [(d, i, n, len(p)) for d, i, n, p in sorted(shown(spark, target), key=str)]
    assert sorted(found, key=str) == sorted([("de", 5, 0, 100_000), ("de", 6, 0, 139_999), ("en", None, 0, 8), ("unknown", 4, 0, 3), ("unknown", 4, 1, 3), ("unknown", 4, 0, 5)], key=str)
    empty = str(tmp_path / "empty.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(empty)
    assert publish(spark, empty, target, SHORT) == {"read": 0, "written": 0, "domains": 0} and shown(spark, target) == []


def test_no_shuffle_of_texts(spark):
    from jobs.publish_passages import passages_of

    plan = passages_of(spark.read.parquet(DOCUMENTS), DEFAULTS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_command_line(tmp_path):
    settings = tmp_path / "settings.json"
    settings.write_text('{"max_tokens": 60, "domains": ["en", "fr"]}')
    done = subprocess.run([sys.executable, "-m", "jobs.publish_passages", DOCUMENTS, str(tmp_path / "out"), "--config", str(settings)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert sorted(p.name for p in (tmp_path / "out" / "passages").glob("domain=*")) == ["domain=en", "domain=fr"] and "'read': 200" in done.stderr

"""Scalar text expressions of the chunker, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, plus the four separators that Java's class lacks.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def stripped(c: Column) -> Column:
    """Without leading and trailing Unicode white space. A run of white space inside is tried from its start alone, and once,
    and only in texts that have such space at their ends."""
    outer = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    cut = F.regexp_replace(F.regexp_replace(c, rf"^{SPACE}++", ""), r"(?U)(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z", "")
    return F.when(outer.rlike(SPACE), cut).otherwise(c)


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4).cast("long"))


def anchor(heading: Column) -> Column:
    """Lower case, letters, digits and underscores kept, white space and hyphens as single hyphens."""
    kept = F.regexp_replace(stripped(F.lower(heading)), r"(?U)[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, rf"{SPACE}+", "-"), "-+", "-"), "^-|-$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(path: Column, anchor_text: Column) -> Column:
    return F.concat_ws("#", path, anchor_text)

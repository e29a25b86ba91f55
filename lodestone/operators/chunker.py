"""Structure-aware markdown chunks as one DataFrame plan: running windows over lines and sections, no recursion.

Stages: lines (fence parity, heading level), sections (a heading and its own body), subtrees (extent, size, whether
they are split), chunks. All windows are partitioned by document, so one shuffle deals the lines and none is global.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import LINE_END, SPACE, anchor, chunk_id, content_hash, stripped, token_estimate

LEVELS = range(1, 7)


def _by_document() -> WindowSpec:
    """A document's rows in order."""
    return Window.partitionBy("path").orderBy("pos")


def _earlier() -> WindowSpec:
    return _by_document().rowsBetween(Window.unboundedPreceding, -1)


def _so_far() -> WindowSpec:
    return _by_document().rowsBetween(Window.unboundedPreceding, 0)


def _later() -> WindowSpec:
    """The rows after each, from the last one back: a frame that grows, as one that shrinks is read anew for each row."""
    return Window.partitionBy("path").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)


def lines(docs: DataFrame) -> DataFrame:
    """path, pos, line, is_fence, in_code and level (of a heading; else null) of every line of (path, content).

    A line whose stripped text starts with three backticks opens or closes code; headings count outside of it only.
    """
    return _lines(docs).where("pos >= 0")


def _lines(docs: DataFrame) -> DataFrame:
    """The lines, and before each document's a start: an empty line at -1, so that all has been dealt by document once."""
    content = F.coalesce("content", F.lit(""))
    # A line end at the text's end ends its last line and begins none; an empty text has no line.
    split = F.when(content != "", F.split(F.regexp_replace(content, rf"(?:{LINE_END})\z", ""), LINE_END)).otherwise(F.array().cast("array<string>"))
    started = F.concat(F.array(F.lit("")), split)
    each = docs.select("path", F.posexplode(started).alias("at", "line")).select("path", (F.col("at") - 1).alias("pos"), "line")
    fenced = each.withColumn("is_fence", F.col("line").rlike(rf"^{SPACE}*```"))
    parity = F.coalesce(F.sum(F.col("is_fence").cast("int")).over(_earlier()), F.lit(0)) % 2 == 1
    marked = fenced.withColumn("in_code", parity)
    hashes = F.length(F.regexp_extract("line", rf"^(#{{1,6}}){SPACE}", 1))
    return marked.withColumn("level", F.when(~F.col("is_fence") & ~F.col("in_code") & (hashes > 0), hashes))


def sections(docs: DataFrame) -> DataFrame:
    """path, pos, level, heading and body of every section; each document begins with "Introduction" at level 1."""
    heading = F.when(F.col("level").isNotNull(), stripped(F.regexp_replace("line", rf"^#{{1,6}}{SPACE}+", "")))
    owned = _lines(docs).select("path", "pos", "level", heading.alias("heading"), "line", F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("pos"))).over(_so_far()), F.lit(-1)).alias("section"))
    own = F.when(F.col("level").isNull() & (F.col("pos") >= 0), F.struct("pos", "line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["line"]), "\n")
    # The start belongs to the introduction, which has no heading line.
    return owned.groupBy("path", F.col("section").alias("pos")).agg(F.coalesce(F.max("level"), F.lit(1)).alias("level"), F.coalesce(F.max("heading"), F.lit("Introduction")).alias("heading"), stripped(body).alias("body"))


def _ancestor(level: int, what: str) -> Column:
    """`what` of the section of that level above this one, from the columns a1 to a6; null if there is none."""
    mine = F.col(f"a{level}")
    nearer = [F.coalesce(F.col(f"a{j}.pos"), F.lit(-2)) < mine["pos"] for j in range(1, level)]
    return F.when(reduce(Column.__and__, nearer, (F.col("level") > level) & mine.isNotNull()), mine[what])


def outline(docs: DataFrame, max_chunk_tokens: int = 1500) -> DataFrame:
    """Every section with its subtree and its place among the chunks.

    Adds part (its own rendered text), end (the first later section of its level or above; null: none), tokens of the
    rendered subtree, is_split (too large, and it has children), parents (headings from the root), and emitted: the
    section is a chunk. Chunks are the level-2 sections, or the level-1 ones of a document without any; a split one
    gives way to its children.
    """
    title = stripped(F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("heading")))
    part = F.array_join(F.filter(F.array(title, F.col("body")), lambda x: x != ""), "\n\n")
    parts = sections(docs).withColumn("part", part)
    # A subtree's text is its parts joined by two line ends: its length follows from running sums.
    sized = parts.withColumn("before", F.coalesce(F.sum(F.length("part") + 2).over(_earlier()), F.lit(0)))
    nexts = [F.min(F.when(F.col("level") <= k, F.struct("pos", "before"))).over(_later()).alias(f"n{k}") for k in LEVELS]
    ended = sized.select("*", *nexts, (F.sum(F.length("part") + 2).over(Window.partitionBy("path"))).alias("total"), F.lead("level").over(_by_document()).alias("following"), F.max((F.col("level") == 2).cast("int")).over(Window.partitionBy("path")).alias("has_h2"))
    next_one = F.coalesce(*[F.when(F.col("level") == k, F.col(f"n{k}")) for k in LEVELS])
    length = F.coalesce(next_one["before"], F.col("total")) - F.col("before") - 2
    tokens = F.greatest(F.lit(1).cast("long"), F.floor(length / 4).cast("long"))
    trees = ended.select("path", "pos", "level", "heading", "body", "part", "has_h2", next_one["pos"].alias("end"), tokens.alias("tokens"), (F.col("following") > F.col("level")).alias("has_child"))
    judged = trees.withColumn("is_split", (F.col("tokens") > max_chunk_tokens) & F.coalesce("has_child", F.lit(False)))
    above = [F.max(F.when(F.col("level") == k, F.struct("pos", "heading", "is_split"))).over(_earlier()).alias(f"a{k}") for k in LEVELS]
    placed = judged.select("*", *above)
    parents = F.filter(F.array(*[_ancestor(k, "heading") for k in LEVELS]), lambda x: x.isNotNull())
    target = F.when(F.col("has_h2") == 1, F.lit(2)).otherwise(F.lit(1))
    splits = F.array(*[F.when(F.lit(k) >= target, _ancestor(k, "is_split")) for k in LEVELS])
    top = F.when(target == 2, _ancestor(2, "pos")).otherwise(_ancestor(1, "pos"))
    below = (F.col("level") > target) & top.isNotNull() & F.forall(splits, lambda x: F.coalesce(x, F.lit(True)))
    emitted = ~F.col("is_split") & ((F.col("level") == target) | below)
    return placed.select("path", "pos", "level", "heading", "body", "part", "end", "tokens", "is_split", parents.alias("parents"), emitted.alias("emitted"))


def chunk_documents(docs: DataFrame, max_chunk_tokens: int = 1500) -> DataFrame:
    """Chunks of documents (path, content, domain, concept, version), with pos, their order in the document.

    Ids are path#anchor, so equal headings of one document share an id. Null content is that of an empty document.
    """
    plan = outline(docs, max_chunk_tokens)
    # Chunks' subtrees don't overlap: a section's chunk is the last one that starts at or before it and hasn't ended.
    holder = F.last(F.when(F.col("emitted"), F.struct("pos", "end", "heading", "parents")), ignorenulls=True).over(_so_far())
    held = plan.select("path", "pos", "part", holder.alias("chunk")).where(F.col("chunk").isNotNull() & (F.col("chunk.end").isNull() | (F.col("pos") < F.col("chunk.end"))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n\n")
    rendered = held.groupBy("path", F.col("chunk.pos").alias("pos"), F.col("chunk.heading").alias("section_heading"), F.col("chunk.parents").alias("parent_headings")).agg(text.alias("text"))
    meta = docs.select("path", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("domain", "concept", "version")])
    named = rendered.join(meta, "path").withColumn("section_anchor", anchor(F.col("section_heading")))
    return named.select(
        chunk_id(F.col("path"), F.col("section_anchor")).alias("id"), "text", F.col("path").alias("file_path"), "domain", "concept", "version",
        "section_heading", "section_anchor", "parent_headings", token_estimate(F.col("text")).alias("token_count"), content_hash(F.col("text")).alias("content_hash"), "pos",
    )


def code_blocks(docs: DataFrame) -> DataFrame:
    """path, section_pos (of the heading above it; -1: none), block_no (from 1 in a document), language and code of every
    fenced block of (path, content), with both fences; one that is never closed is none.

    The language is the first word after the opening fence, "" without one.
    """
    opened = (F.col("is_fence") & ~F.col("in_code")).cast("int")
    section = F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("pos"))).over(_so_far()), F.lit(-1))
    within = lines(docs).select("path", "pos", "line", "is_fence", "in_code", F.sum(opened).over(_so_far()).alias("block_no"), section.alias("section_pos")).where("is_fence OR in_code")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    grouped = within.groupBy("path", "block_no").agg(F.min("section_pos").alias("section_pos"), F.count(F.when(F.col("is_fence"), 1)).alias("fences"), F.transform(ordered, lambda x: x["line"]).alias("each"))
    language = F.regexp_extract(F.col("each")[0], rf"^{SPACE}*```+{SPACE}*([^\s`]*)", 1)
    return grouped.where("fences = 2").select("path", "section_pos", "block_no", language.alias("language"), F.array_join("each", "\n").alias("code"))


def last_of_each_id(chunks: DataFrame) -> DataFrame:
    """One chunk for each id, the last in document order, with dup_count (how many there were). An id is its file's path, #
    and an anchor without #, so equal ids are of one file, and chunks that are dealt by file stay where they are."""
    same = Window.partitionBy("file_path", "id")
    ranked = chunks.withColumn("_rank", F.row_number().over(same.orderBy(F.desc("pos")))).withColumn("dup_count", F.count(F.lit(1)).over(same))
    return ranked.where("_rank = 1").drop("_rank")


def split_paragraphs(texts: DataFrame, max_tokens: int = 1500, text_col: str = "text") -> DataFrame:
    """The rows' texts cut to paragraphs (at blank lines), and oversized ones to runs of whole sentences.

    Adds part_no and part. Sentences are packed greedily while their joined size stays within the bound; one that is
    oversized alone stands alone. A text without a paragraph gives no row.
    """
    paragraphs = F.filter(F.transform(F.split(F.col(text_col), "\n\n"), stripped), lambda p: p != "")

    def fits(text: Column) -> Column:
        return F.floor(F.length(text) / 4) <= max(max_tokens, 0) if max_tokens >= 1 else F.lit(False)

    def packed(paragraph: Column) -> Column:
        # The state: runs that are done, and the open one ("" for none).
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def step(state: Column, sentence: Column) -> Column:
            joined = F.when(state["open"] == "", sentence).otherwise(F.concat(state["open"], F.lit(" "), sentence))
            flushed = F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], state["open"]))
            return (
                F.when(fits(joined), F.struct(state["done"].alias("done"), joined.alias("open")))
                .when(fits(sentence), F.struct(flushed.alias("done"), sentence.alias("open")))
                .otherwise(F.struct(F.array_append(flushed, sentence).alias("done"), F.lit("").alias("open")))
            )

        sentences = F.split(paragraph, r"(?<=[.!?])(?U)\s+")
        return F.aggregate(sentences, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))

    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(fits(p), F.array(p)).otherwise(packed(p))))
    return texts.select("*", F.posexplode(parts).alias("part_no", "part"))

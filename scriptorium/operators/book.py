"""A book's parts: sections, zones, front pages, notes, captions, claims and overrides, from tables of blocks, headings and flow items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import DEFAULT, Thresholds
from scriptorium.functions.text import ends_with_attribution, fold_key, has_isbn, heading_numbering, list_marker, squash_key, starts_with_caption_prefix
from scriptorium.operators import ledger
from scriptorium.operators.contents import BACK_WORDS, FRONT_WORDS

# The signs that number notes on a page, in their cycle, and what may end a run-in heading.
NOTE_CYCLE = ["*", "†", "‡", "§", "‖", "¶"]
MAX_LEVEL = 6


def _in(doc: str = "doc", order: str = "at"):
    return Window.partitionBy(doc).orderBy(order)


# --- sections ---


def section_tree(headings: DataFrame) -> DataFrame:
    """Headings (doc, at, level, ...) with ``parent``: the place of the last heading before it that is less deep, null at the top. Running maxima of places, one for each level."""
    w = _in().rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("at"))).over(w)) for k in range(1, MAX_LEVEL)]
    return headings.withColumn("parent", F.greatest(*above))


def first_word(text: Column) -> Column:
    return fold_key(F.regexp_replace(F.regexp_extract(text, r"^\s*(\S+)", 1), "[:.,]+$", ""))


def part_of(text: Column, words: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]), first_word(text))


def zones(headings: DataFrame, resets: DataFrame, last_pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Headings (doc, at, page, text, level) with front, back (what their first word says) and zone.

    The body begins at the page where arabic numbers start anew (``resets``: doc, page), or without one at the first heading that isn't of the front; the back at the first later heading that
    names a part of it, late enough in the book (``last_pages``: doc, last).
    """
    h = headings.join(resets.select("doc", F.col("page").alias("reset")), "doc", "left").join(last_pages, "doc", "left")
    h = h.withColumns({"front": part_of(F.col("text"), FRONT_WORDS), "back": part_of(F.col("text"), BACK_WORDS)})
    body = F.when(F.col("reset").isNotNull(), F.col("page") >= F.col("reset")).otherwise(F.col("front").isNull())
    everything = Window.partitionBy("doc")
    h = h.withColumn("body_at", F.min(F.when(body, F.col("at"))).over(everything))
    late = F.col("back").isNotNull() & (F.col("page") >= t.back_min_page_share * F.col("last")) & (F.col("at") > F.col("body_at"))
    h = h.withColumn("back_at", F.min(F.when(late, F.col("at"))).over(everything))
    zone = F.when(F.coalesce(F.col("at") >= F.col("back_at"), F.lit(False)), "back").when(F.coalesce(F.col("at") >= F.col("body_at"), F.lit(False)), "body").otherwise("front")
    return h.withColumn("zone", zone).select(*headings.columns, "front", "back", "zone")


def section_roles(zoned: DataFrame) -> DataFrame:
    """Zoned headings with ``role``: of the front and back by their first word, of the body part, chapter (at the top, or under a part) or section."""
    rows = section_tree(zoned)
    part = F.coalesce(heading_numbering(F.col("text"))["kind"] == "part", F.lit(False)) & (F.col("zone") == "body")
    rows = rows.withColumn("is_part", part)
    parents = rows.select("doc", F.col("at").alias("parent"), F.col("is_part").alias("under_part"))
    rows = rows.join(parents, ["doc", "parent"], "left")
    body = F.when(F.col("is_part"), "part").when((F.col("level") == 1) | F.coalesce("under_part", F.lit(False)), "chapter").otherwise("section")
    role = F.when(F.col("zone") == "front", F.concat(F.lit("front:"), F.coalesce("front", F.lit("other")))).when(F.col("zone") == "back", F.concat(F.lit("back:"), F.coalesce("back", F.lit("other")))).otherwise(body)
    return rows.withColumn("role", role).drop("is_part", "under_part")


def section_warnings(sections: DataFrame) -> DataFrame:
    """(doc, code) of sections (doc, at, parent, zone, first, last): zones out of order at the top, a section that ends before it begins, tops that go back."""
    rank = F.array_position(F.array(*map(F.lit, ["front", "body", "back"])), F.col("zone"))
    top = sections.where("parent is null").withColumns({"rank": rank, "was": F.lag(rank).over(_in()), "before": F.lag("first").over(_in())})
    zone = top.where("rank < was").select("doc", F.lit("W_ZONES_OUT_OF_ORDER").alias("code"))
    pages = top.where("first < before").select("doc", F.lit("W_SECTION_PAGES_NOT_MONOTONE").alias("code"))
    spans = sections.where("last < first").select("doc", F.lit("W_SECTION_PAGES_NOT_MONOTONE").alias("code"))
    return zone.union(pages).union(spans).distinct()


def front_page_kinds(pages: DataFrame, titles: DataFrame, told: DataFrame | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, page, kind) of the pages before the first heading (doc, page, text, links, last): contents, copyright, title, half-title, epigraph, dedication or other.

    Of two title pages or more, the first is the half-title unless it says more than the second. ``told`` (doc, page, kind) decides what else would be other or a dedication.
    """
    key = titles.select("doc", F.when(F.length(squash_key(F.col("title"))) >= t.front_min_title_key, squash_key(F.col("title"))).alias("key"))
    p = pages.join(key, "doc", "left").withColumn("words", F.regexp_count("text", F.lit(r"\S+")))
    kind = (
        F.when(F.col("words") == 0, "other")
        .when(F.col("links"), "contents")
        .when(F.contains("text", F.lit("©")) | has_isbn(F.col("text")), "copyright")
        .when((F.col("words") <= t.front_title_max_words) & F.coalesce(F.contains(squash_key(F.col("text")), F.col("key")), F.lit(False)), "title")
        .when((F.col("words") <= t.front_epigraph_max_words) & ends_with_attribution(F.col("last")), "epigraph")
        .when((F.col("words") <= t.front_dedication_max_words) & ~F.rlike("text", F.lit(r"\p{N}")), "dedication")
        .otherwise("other")
    )
    p = p.withColumn("kind", kind)
    w = Window.partitionBy("doc", "kind").orderBy("page")
    half = (F.col("kind") == "title") & (F.row_number().over(w) == 1) & F.coalesce(F.col("words") <= F.lead("words").over(w), F.lit(False))
    p = p.withColumn("kind", F.when(half, "half_title").otherwise(F.col("kind")))
    if told is not None:
        p = p.join(told.select("doc", "page", F.col("kind").alias("said")), ["doc", "page"], "left")
        p = p.withColumn("kind", F.when(F.col("kind").isin("other", "dedication"), F.coalesce("said", "kind")).otherwise(F.col("kind")))
    return p.select("doc", "page", "kind")


def front_sections(kinds: DataFrame) -> DataFrame:
    """(doc, section, kind, first, last): neighbouring pages of one kind are one section."""
    new = F.coalesce(F.col("kind") != F.lag("kind").over(_in(order="page")), F.lit(True))
    runs = kinds.withColumn("new", new.cast("int")).withColumn("section", F.sum("new").over(_in(order="page")))
    return runs.groupBy("doc", "section", "kind").agg(F.min("page").alias("first"), F.max("page").alias("last"))


def page_breaks(flow: DataFrame) -> DataFrame:
    """(doc, at, page): the first flow item (doc, at, page) of each page, before which its break goes."""
    return flow.groupBy("doc", "page").agg(F.min("at").alias("at")).select("doc", "at", "page")


def walk(nodes: DataFrame, depth: int = 16) -> DataFrame:
    """Nodes (doc, node, parent, ord, ...) with ``depth`` and ``place`` in the order of a walk that goes down before it goes on. Trees deeper than ``depth`` are an error.

    Each round brings the children of the last level to their parents' paths.
    """
    level = nodes.where("parent is null").withColumns({"path": F.array(F.struct("ord", "node")), "depth": F.lit(0)})
    done = level
    for k in range(1, depth + 1):
        up = level.select("doc", F.col("node").alias("parent"), F.col("path").alias("above"))
        level = nodes.join(up, ["doc", "parent"]).withColumns({"path": F.concat("above", F.array(F.struct("ord", "node"))), "depth": F.lit(k)}).select(*nodes.columns, "path", "depth")
        done = done.unionByName(level)
    return done.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("path")) - 1).drop("path")


def text_pieces(nodes: DataFrame, depth: int = 16) -> DataFrame:
    """(doc, place, text) of the nodes that have text, in the order of a walk."""
    return walk(nodes, depth).where("text is not null").select("doc", "place", "text")


def apply_overrides(rows: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the columns that a patch (keys, columns; null: as it is) sets, and an entry (keys, reason, removed, added) for each value that it changes."""
    p = patch.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    both = rows.join(p, keys, "left")
    changed = F.explode(F.array(*[F.struct(F.col(c).cast("string").alias("removed"), F.col(f"new_{c}").cast("string").alias("added")) for c in columns]))
    entries = both.select(*keys, changed.alias("x")).where("x.added is not null and not x.added <=> x.removed").select(*keys, F.lit("UserOverride").alias("reason"), "x.removed", "x.added")
    return both.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns]), entries


# --- claims: which part of the structure takes which block ---


def contested(claims: DataFrame) -> DataFrame:
    """(doc, block, claims) of blocks that are claimed more than once; claims count, not claimants."""
    return claims.groupBy("doc", "block").agg(F.count("*").alias("claims")).where("claims > 1")


def overclaimed(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, block) of contested blocks whose claims (doc, block, by, text) hold more of some character than the block (doc, block, text) itself."""
    twice = contested(claims).select("doc", "block")
    keys = ["doc", "block"]
    more = ledger.difference(ledger.histogram(claims.join(twice, keys, "left_semi"), keys), ledger.histogram(blocks.join(twice, keys, "left_semi"), keys), keys)
    return more.select(*keys).distinct()


def orphaned_claims(claims: DataFrame, emitted: DataFrame) -> DataFrame:
    """Claims whose claimant (doc, by) isn't in the output."""
    return claims.join(emitted.select("doc", "by").distinct(), ["doc", "by"], "left_anti")


# --- notes and captions ---


def leading_marker(first_run: Column, raised: Column, text: Column) -> Column:
    """The sign or number that a note's line begins with: a raised run that is one, a sign of the cycle, or digits before a stop or bracket; null if none."""
    run, token = F.trim(first_run), F.regexp_extract(text, r"^\s*(\S+)", 1)
    digits = F.regexp_extract(token, r"^([0-9]+)[.)]+$", 1)
    is_mark = F.rlike(run, F.lit("^[0-9]+$")) | run.isin(NOTE_CYCLE)
    return F.when(F.coalesce(raised & is_mark, F.lit(False)), run).when(token.isin(NOTE_CYCLE), token).when(digits != "", digits)


def note_blocks(lines: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(block) of blocks of small type, low on the page, with a line that has a marker. ``lines``: block, size, body (size of the body's type), band (0 at the page's top, 1 at its foot), marker."""
    small = (F.col("body") > 0) & (F.col("size") / F.col("body") < t.note_size_ratio_max) & (F.col("band") >= t.note_zone_band_min)
    return lines.where(small).groupBy("block").agg(F.count("marker").alias("n")).where("n > 0").select("block")


def note_bodies(zone: DataFrame) -> DataFrame:
    """(doc, note, page, marker, text) of the zone's lines (doc, at, page, text, marker): a marked line opens a note, others go on with the one before it, or open one without a marker."""
    w = _in()
    rows = zone.withColumn("opens", (F.col("marker").isNotNull() | (F.row_number().over(w) == 1)).cast("int")).withColumn("note", F.sum("opens").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.trim("text").alias("text")))), lambda x: x["text"]), " ")
    return rows.groupBy("doc", "note").agg(F.min("page").alias("page"), F.first("marker", ignorenulls=True).alias("marker"), text.alias("text")).select("doc", "note", "page", "marker", "text")


def body_markers(runs: DataFrame, zone: DataFrame) -> DataFrame:
    """Raised runs (block, raised, text, ...) outside the zone (block) whose text is a note's mark."""
    mark = F.trim("text")
    return runs.join(zone, "block", "left_anti").where(F.col("raised") & (F.rlike(mark, F.lit("^[0-9]+$")) | mark.isin(NOTE_CYCLE)))


def separator_rules(notes: DataFrame, rules: DataFrame, body: float, t: Thresholds = DEFAULT) -> DataFrame:
    """(note) of notes (note, page, y0, column_width) with a short horizontal rule (page, x0, y0, x1, y1) close above. A page has few rules."""
    r = rules.where("x1 - x0 >= y1 - y0").select("page", (F.col("x1") - F.col("x0")).alias("length"), F.col("y1").alias("foot"))
    near = (F.col("column_width") > 0) & (F.col("length") / F.col("column_width") < t.note_rule_max_width_ratio) & (F.col("foot") <= F.col("y0")) & (F.col("y0") - F.col("foot") <= body * t.note_rule_gap_max_em)
    return notes.join(r, "page").where(near).select("note").distinct()


def caption_candidates(blocks: DataFrame, body: Column, t: Thresholds = DEFAULT) -> DataFrame:
    """Blocks (text, size, italic, width_ratio, ...) with has_prefix: those that begin as captions do, or are small or italic, and aren't wider than a caption."""
    rows = blocks.where(F.trim("text") != "").withColumn("has_prefix", starts_with_caption_prefix(F.col("text")))
    small = (body > 0) & (F.col("size") < body)
    return rows.where((F.col("has_prefix") | small | F.col("italic")) & (F.col("width_ratio") <= t.caption_max_width_ratio))


# --- margins, type, lists ---


def left_margins(blocks: DataFrame) -> DataFrame:
    """(doc, margin): the most frequent left edge to a point; of several the leftmost."""
    counts = blocks.groupBy("doc", F.floor(F.col("x0") + 0.5).alias("edge")).agg(F.count("*").alias("n"))
    return counts.groupBy("doc").agg(F.max(F.struct("n", (-F.col("edge")).alias("less")))["less"].alias("less")).select("doc", (-F.col("less")).alias("margin"))


def monospaced(runs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(block, mono): whether every run (block, at, text, x0, x1) of more than three characters is as wide a character as the first, to a hundredth, and there are enough of them."""
    rows = runs.where(F.length("text") > 3).withColumn("advance", (F.col("x1") - F.col("x0")) / F.length("text"))
    s = rows.groupBy("block").agg(F.count("*").alias("n"), F.min_by("advance", "at").alias("first"), F.min("advance").alias("low"), F.max("advance").alias("high"))
    even = (F.col("n") >= F.greatest(F.lit(2), F.lit(t.monospace_min_runs))) & (F.col("first") > 0) & (F.abs(F.col("high") - F.col("first")) / F.col("first") < 0.01) & (F.abs(F.col("low") - F.col("first")) / F.col("first") < 0.01)
    return s.select("block", even.alias("mono"))


def built_lists(lines: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(doc, run, at, depth, kind, ordinal, start, gap) of the marked lines of lists (doc, run, at, x0, line): depth by steps of indent, ``start`` on the first item of an ordered list that doesn't begin with 1,
    ``gap`` where a number doesn't follow the one before it at its depth.

    The top level is the least indent; its items must be enough and of one kind, else there is no list.
    """
    m = lines.withColumn("m", list_marker(F.col("line"))).where("m is not null").select("doc", "run", "at", "x0", "m.kind", "m.ordinal")
    step = F.floor((F.col("x0") - F.min("x0").over(Window.partitionBy("doc", "run"))) / t.list_indent_step_pt)
    m = m.withColumn("step", step)
    rungs = m.select("doc", "run", "step").distinct().withColumn("depth", F.row_number().over(Window.partitionBy("doc", "run").orderBy("step")))
    m = m.join(rungs, ["doc", "run", "step"]).withColumn("depth", F.least("depth", F.lit(t.list_max_depth)))
    tops = m.where("depth = 1").groupBy("doc", "run").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds")).where((F.col("n") >= t.list_min_siblings) & (F.col("kinds") == 1))
    m = m.join(tops.select("doc", "run"), ["doc", "run"], "left_semi")
    own = Window.partitionBy("doc", "run", "depth").orderBy("at")
    first = F.row_number().over(own) == 1
    gap = F.coalesce((F.col("ordinal") != F.lag("ordinal").over(own) + 1) & (F.col("kind") != "bullet"), F.lit(False))
    return m.select("doc", "run", "at", "depth", "kind", "ordinal", F.when(first & (F.col("ordinal") != 1), F.col("ordinal")).alias("start"), gap.alias("gap"))

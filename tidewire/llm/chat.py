"""Chat formatting: link quoted passages to the messages they come from and order conversations by replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.llm.components import flatten
from tidewire.operators.scans import position
from tidewire.session import cut_lineage

#: Marks of a quoted line, one per level, and the line that announces a quote.
QUOTED = r"^[ \t]*(?:>[ \t]?)+"
ANNOUNCED = r"(?i)^[ \t]*(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$"
#: Turns of a conversation that are searched together for the origin of a passage.
SPAN = 1024
#: Words of the runs by which passages are found whose lines were broken anew.
WINDOW = 5
_LINES = "array<struct<level:int,body:string>>"


def quote_lines(text: Column) -> Column:
    """(level, body) of each line: level counts the quote marks before it."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, QUOTED, 0), "[^>]", "")).cast("int").alias("level"),
            F.regexp_replace(x, QUOTED, "").alias("body"),
        ),
    ).cast(_LINES)


def normal(body: Column) -> Column:
    """A passage as it is compared: lower case, single blanks, no edges."""
    return F.btrim(F.regexp_replace(F.lower(body), r"\s+", " "))


def own_text(lines: Column) -> Column:
    """What the author wrote: lines without quote marks, less announcements of a quote that follows."""
    kept = F.filter(
        lines,
        lambda x, i: (x["level"] == 0)
        & ~(x["body"].rlike(ANNOUNCED) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)),
    )
    joined = F.array_join(F.transform(kept, lambda x: x["body"]), "\n")
    return F.btrim(joined, F.lit(" \t\r\n"))


def passages(lines: Column) -> Column:
    """(level, h) of every line that has a word, by the hash of its normalised body."""
    said = F.filter(lines, lambda x: x["body"].rlike(r"\w"))
    return F.transform(said, lambda x: F.struct(x["level"].alias("level"), F.xxhash64(normal(x["body"])).alias("h")))


def _runs(words: Column, size: Column) -> Column:
    """Hashes of all runs of ``size`` words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, size), " ")))


def quoted_runs(lines: Column, level: Column) -> Column:
    """Hashes of the runs of WINDOW words in each block of lines at ``level``, line breaks folded.

    A block of fewer words, but two, is one run. Lines of other levels end a block.
    """
    marked = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["body"]).otherwise("\0")), " ")
    blocks = F.transform(F.split(marked, "\0"), lambda b: F.split(normal(b), " "))
    long = F.filter(blocks, lambda ws: F.size(ws) > 1)
    return F.array_distinct(F.flatten(F.transform(long, lambda ws: _runs(ws, F.least(F.size(ws), F.lit(WINDOW))))))


def written_runs(text: Column) -> Column:
    """Hashes of the runs of two to WINDOW words of a text, line breaks folded."""
    words = F.split(normal(text), " ")
    return F.array_distinct(F.concat(*[_runs(words, F.lit(k)) for k in range(2, WINDOW + 1)]))


def origins(quoted: DataFrame, written: DataFrame) -> DataFrame:
    """For each quoted passage (conv, h, turn, row, tag) the latest earlier message of the conversation that wrote it.

    An as-of search, so a passage that many messages write and quote makes no pairs: the last writer
    before each quote is carried along the turns, inside spans of turns and from span to span.
    """
    wanted = quoted.select("conv", "h").distinct()
    writers = written.join(wanted, ["conv", "h"], "left_semi").select("conv", "h", "turn", "row", F.lit(None).cast("int").alias("tag"), F.lit(0).alias("quote"))
    both = cut_lineage(
        writers.unionByName(quoted.select("conv", "h", "turn", "row", "tag", F.lit(1).alias("quote"))).withColumn(
            "span", F.floor(F.col("turn") / SPAN)
        )
    )
    who = F.when(F.col("quote") == 0, F.struct("turn", "row"))
    last = both.groupBy("conv", "h", "span").agg(F.max(who).alias("in_span"))
    spans = W.partitionBy("conv", "h").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.max("in_span").over(spans)).select("conv", "h", "span", "carried")
    # At one turn quotes come first: a message does not quote itself or its twins.
    inside = W.partitionBy("conv", "h", "span").orderBy("turn", F.desc("quote"), "row").rowsBetween(W.unboundedPreceding, -1)
    found = both.withColumn("near", F.max(who).over(inside)).where("quote = 1").join(carried, ["conv", "h", "span"], "left")
    return found.select("conv", "row", "tag", F.coalesce("near", "carried").alias("origin")).where("origin is not null")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Messages with own text, place in reply order, and the turn that each answers.

    Input: conv_id, turn, role, text; nulls are allowed everywhere (null text: empty; rows of null
    conv_id make one conversation; null turns come first, as turn -1 for links). Output: conv_id,
    turn, role, position, reply_to, n_quoted, text, formatted; one row per input row.

    Quoted lines of every level are matched with the own lines of earlier messages, else with lines
    that these quote one level lower. Where the lowest level finds no line, runs of words are matched
    with line breaks folded, as mail programs wrap quotes anew. The lowest level with an origin decides,
    at one level in this order; the answered message is the one with most matches, then the latest. Messages
    are ordered by the turn of the first message of their thread, then by their own, so a reply
    follows what it answers; messages without a quote start a thread of their own.
    """
    text = F.coalesce("text", F.lit(""))
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn_in"),
        F.col("role").cast("string").alias("role"),
        quote_lines(text).alias("lines"),
    )
    parsed = cut_lineage(
        rows.select(
            "conv_id",
            "turn_in",
            "role",
            F.coalesce("conv_id", F.lit(-1)).alias("conv"),
            F.coalesce("turn_in", F.lit(-1)).alias("turn"),
            own_text(F.col("lines")).alias("text"),
            passages(F.col("lines")).alias("passages"),
            F.when(F.exists("lines", lambda x: x["level"] > 0), F.col("lines")).alias("quoting"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    each = parsed.select("conv", "turn", "row", F.explode("passages").alias("p")).select("conv", "turn", "row", "p.level", "p.h")
    own, deep = each.where("level = 0"), each.where("level > 0")
    # A tag orders the ways to find an origin: level, then own lines, lines quoted there, runs of words.
    tag = lambda kind: (F.col("level") * 3 + kind).cast("int").alias("tag")
    place = ["conv", "turn", "row"]
    quoted = deep.select(*place, "h", tag(0)).unionByName(
        deep.where("level > 1").select(*place, F.xxhash64("h", "level").alias("h"), tag(1))
    )
    written = own.select(*place, "h").unionByName(deep.select(*place, F.xxhash64("h", F.col("level") + 1).alias("h")))
    lines = cut_lineage(origins(quoted.distinct(), written.distinct()))
    settled = lines.groupBy("row").agg(F.min("tag").alias("tag"))
    least = F.array_min(F.transform("passages", lambda p: F.when(p["level"] > 0, p["level"])))
    open_rows = (
        parsed.where("quoting is not null").select(*place, "quoting", "passages", least.alias("least"))
        .join(settled, "row", "left")
        .where("least is not null and (tag is null or floor(tag / 3) > least)")
    )
    levels = F.array_distinct(F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p: p["level"]))
    asked = cut_lineage(
        open_rows.select(*place, "quoting", F.explode(levels).alias("level"))
        .select(*place, tag(2), F.explode(quoted_runs(F.col("quoting"), F.col("level"))).alias("h"))
    )
    told = parsed.join(asked.select("conv").distinct(), "conv", "left_semi")
    runs = origins(asked, told.select(*place, F.explode(written_runs(F.col("text"))).alias("h")))
    votes = lines.unionByName(runs)
    answered = cut_lineage(
        votes.groupBy("row", "tag", "origin").agg(F.count("*").alias("n"))
        .groupBy("row").agg(F.max_by("origin", F.struct(-F.col("tag"), "n", "origin")).alias("o"))
        .select("row", F.col("o.row").alias("origin"), F.col("o.turn").alias("reply_to"))
    )
    roots = flatten(answered.select(F.col("row").alias("node"), F.col("origin").alias("up")))
    first = parsed.select(F.col("row").alias("up"), F.col("turn").alias("root_turn"))
    placed = roots.join(first, "up").select(F.col("node").alias("row"), "root_turn")
    joined = (
        parsed.join(answered.select("row", "reply_to"), "row", "left")
        .join(placed, "row", "left")
        .withColumn("thread", F.coalesce("root_turn", "turn"))
    )
    # thread and turn in one ordered number: both are small compared with 2^31.
    ordered = cut_lineage(joined.withColumn("order", F.col("thread") * F.lit(1 << 31) + F.col("turn")))
    ranked = position(ordered, ["conv"], "order", "row", name="position", width=SPAN << 31)
    role = F.coalesce("role", F.lit("unknown"))
    return ranked.select(
        "conv_id",
        F.col("turn_in").alias("turn"),
        role.alias("role"),
        F.col("position").cast("long").alias("position"),
        "reply_to",
        F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long").alias("n_quoted"),
        "text",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")).alias("formatted"),
    )

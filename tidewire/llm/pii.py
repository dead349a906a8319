"""Personal data: base patterns, and identifiers found by patterns of context that the base matches induce."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.llm.arrays import BLANKS, running_sum
from tidewire.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that the regular expression engine does linear work and does not recurse
#: over a long match: runs are entered at their start only (or where the last match ended), and a card is
#: a maximal chain of 13 to 19 digits. They match the same spans as the plain forms.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What an identifier looks like when it is new: a run without blanks and with five digits or an at sign.
CANDIDATE = rf"(?<![^{BLANKS}])(?=[^{BLANKS}]*?(?:@|(?:[0-9][^{BLANKS}0-9]{{0,2}}){{5}}))[^{BLANKS}]++"
#: Code points of text kept on each side of a match for its context.
REACH = 48
_SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string,before:string,after:string>>"


@dataclass(frozen=True)
class Bootstrap:
    """How sure a pattern must be.

    support: different known values that a pattern must be seen with. confidence: mean confidence of
    the values of a pattern from which on it may find new ones, and of a new value to be accepted.
    rounds: how often patterns and values are scored in turn, before accepted values join the known ones.
    """

    support: int = 3
    confidence: float = 0.7
    rounds: int = 3


def _found(text: Column, kind: int, pattern: str) -> Column:
    """Spans of all matches of a pattern, in order, with text around them.

    The pieces between the matches and the matches alternate, so positions are running sums.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def spans(both: Column) -> Column:
        v, g = both["v"], both["g"]
        steps = F.zip_with(v, F.slice(g, 1, F.size(v)), lambda x, p: F.length(p) + F.length(x).cast("bigint"))
        ahead = running_sum(steps)
        return F.transform(
            v,
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                (F.get(ahead, i) + F.length(F.get(g, i))).alias("start"),
                (F.get(ahead, i) + F.length(F.get(g, i)) + F.length(x)).alias("end"),
                x.alias("value"),
                F.right(F.get(g, i), F.lit(REACH)).alias("before"),
                F.left(F.get(g, i + 1), F.lit(REACH)).alias("after"),
            ),
        )

    held = F.transform(F.array(F.struct(values.alias("v"), gaps.alias("g"))), spans)
    return F.coalesce(F.get(held, F.lit(0)), F.array().cast(_SPAN)).cast(_SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether the digits have a valid check digit."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
        # Leading zeros may take all of a zero part.
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans per kind that pass the kind's check, as array columns. Cheap tests skip most texts."""
    quick = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": F.contains(text, F.lit("+")),
    }
    none = F.array().cast(_SPAN)
    out = {}
    for i, kind in enumerate(KINDS):
        out[kind] = F.when(quick[kind], _checked(_found(text, i, PATTERNS[kind]), kind)).otherwise(none)
    return out


def _contexts(before: Column, after: Column) -> Column:
    """Patterns around a value: two words before, two after, one on each side; case and digits folded.

    Line breaks count as words, a missing side as a boundary.
    """
    fold = lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"\n", " ⏎ ")), "[0-9]", "0")
    left = F.filter(F.split(fold(before), f"[{BLANKS}]+"), lambda w: w != "")
    right = F.filter(F.split(fold(after), f"[{BLANKS}]+"), lambda w: w != "")
    last = lambda k: F.coalesce(F.get(left, F.size(left) - k), F.lit("⌐"))
    next_ = lambda k: F.coalesce(F.get(right, F.lit(k - 1)), F.lit("⌐"))
    return F.array(
        F.concat(F.lit("L "), last(2), F.lit(" "), last(1)),
        F.concat(F.lit("R "), next_(1), F.lit(" "), next_(2)),
        F.concat(F.lit("M "), last(1), F.lit(" _ "), next_(1)),
    )


def scan(docs: DataFrame) -> DataFrame:
    """_row, doc_id, the base spans of each kind, and candidates; of each row, without the text.

    Written once to the shared folder: the row numbers and spans are then fixed for what follows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = base_spans(text)
    open_ = F.when(text.rlike("@|[0-9]"), _found(text, -1, CANDIDATE)).otherwise(F.array().cast(_SPAN))
    rows = docs.select(F.col("doc_id"), *[c.alias(k) for k, c in spans.items()], open_.alias("candidates"))
    return cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))


def _accepted(links: DataFrame, seeds: DataFrame, settings: Bootstrap) -> DataFrame:
    """(value, found, c): the values that patterns of the seeds (pattern, value, kind, own) make sure enough.

    found is the kind and c the confidence; known values of the patterns are among them.
    """
    strong = (
        seeds.groupBy("pattern", "kind").agg(F.count("*").alias("known")).where(F.col("known") >= settings.support)
    )
    # Only links of patterns with enough known values can ever matter.
    graph = cut_lineage(
        links.select("pattern", "value").join(strong.select("pattern", "kind"), "pattern")
        .join(seeds, ["pattern", "kind", "value"], "left")
        .groupBy("pattern", "kind", "value").agg(F.coalesce(F.max("own"), F.lit(0.0)).alias("own"))
    )
    trust = graph.groupBy("kind", "value").agg(F.max("own").alias("c"))
    for _ in range(settings.rounds):
        scores = graph.join(trust, ["kind", "value"]).groupBy("pattern", "kind").agg(F.avg("c").alias("score"))
        best = graph.join(scores, ["pattern", "kind"]).groupBy("kind", "value").agg(
            F.max("own").alias("own"),
            F.max(F.when(F.col("score") >= settings.confidence / 2, F.col("score"))).alias("score"),
        )
        trust = cut_lineage(best.select("kind", "value", F.when(F.col("own") > 0, F.col("own")).otherwise(F.coalesce("score", F.lit(0.0))).alias("c")))
    return (
        trust.where(F.col("c") >= settings.confidence)
        .groupBy("value").agg(F.max(F.struct(F.col("c"), (-F.col("kind")).alias("k"))).alias("b"))
        .select("value", (-F.col("b")["k"]).alias("found"), F.col("b")["c"].alias("c"))
    )


def discover(scanned: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """_row, kind, start, end of identifiers that the base patterns miss.

    A graph links each value (of base matches: known, of candidates: open) with the patterns of the
    contexts it stands in, per kind. In turn, a pattern gets the mean confidence of its values, if it
    has enough known ones of one kind, and an open value the best mean over its patterns of that kind.
    Known values keep confidence 1. Values that are accepted then are known too, with the confidence they
    were accepted with, and induce patterns in all their contexts; this goes on until no value
    is accepted. Candidates that overlap a base match are left out.
    """
    every = scanned.select("_row", F.explode(F.concat(*KINDS, "candidates")).alias("s")).select("_row", "s.*")
    # An open span overlaps a base span if one that starts before ends in it, or one after starts in it.
    by_place = W.partitionBy("_row").orderBy("start", F.desc("kind"))
    earlier = F.max(F.when(F.col("kind") >= 0, F.col("end"))).over(by_place.rowsBetween(W.unboundedPreceding, 0))
    later = F.min(F.when(F.col("kind") >= 0, F.col("start"))).over(by_place.rowsBetween(0, W.unboundedFollowing))
    placed = every.withColumns({"_earlier": earlier, "_later": later})
    apart = (F.coalesce("_earlier", F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("_later") >= F.col("end"), F.lit(True)))
    kept = placed.where((F.col("kind") >= 0) | apart)
    trimmed = F.regexp_replace("value", r"^[\p{P}\p{S}&&[^+@]]+|[\p{P}\p{S}]+$", "")
    seen = cut_lineage(
        kept.withColumn("value", F.when(F.col("kind") >= 0, F.col("value")).otherwise(trimmed)).withColumn(
            "contexts", _contexts(F.col("before"), F.col("after"))
        ).drop("before", "after", "_earlier", "_later")
    )
    links = cut_lineage(
        seen.select("kind", "value", F.explode("contexts").alias("pattern")).groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")).drop("n")
    )
    seeds = links.where("kind >= 0").select("pattern", "value", "kind", F.lit(1.0).alias("own"))
    open_links = links.where("kind < 0 and value != ''").select("pattern", "value")
    accepted = None
    while True:
        found = _accepted(links, seeds, settings)
        new = cut_lineage(found if accepted is None else found.join(accepted, "value", "left_anti"))
        accepted = new if accepted is None else accepted.unionByName(new)
        learned = cut_lineage(open_links.join(new, "value").select("pattern", "value", F.col("found").alias("kind"), F.col("c").alias("own")))
        if learned.isEmpty():
            break
        seeds = seeds.unionByName(learned)
    cut = F.length(F.regexp_extract("raw", r"^[\p{P}\p{S}&&[^+@]]*", 0))
    fresh = seen.where("kind < 0 and value != ''").join(accepted.select("value", "found"), "value")
    raw = scanned.select("_row", F.explode("candidates").alias("s")).select("_row", F.col("s.start").alias("start"), F.col("s.value").alias("raw"))
    return (
        fresh.join(raw, ["_row", "start"])
        .select("_row", F.col("found").alias("kind"), (F.col("start") + cut).alias("start"), (F.col("start") + cut + F.length("value")).alias("end"))
    )


def find_personal_data(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id, base (spans of the base patterns) and spans (with the discovered ones), per row of (doc_id, text).

    Both are arrays of (kind, start, end), by kind as in ``KINDS`` and then start; code points, end
    exclusive. Null and empty texts have none. Repeated rows and rows without doc_id stay apart.
    """
    scanned = scan(docs)
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = (
        discover(scanned, settings)
        .groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    )
    base = plain(F.concat(*KINDS))
    return scanned.join(found, "_row", "left").select(
        "doc_id",
        base.alias("base"),
        F.when(F.col("more").isNull(), base).otherwise(F.sort_array(F.concat(base, "more"))).alias("spans"),
    )


def written(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
    )


def redact(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """The rows of ``docs`` with each span of personal data in text replaced by its kind in brackets.

    Overlapping spans are replaced by one name, the first one's. n_chars, where there is such a
    column, is set anew for changed texts. The rows get a number and are written once, so that spans
    and texts meet again; rows without spans pass as they are.
    """
    held = cut_lineage(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("doc_id")))
    found = find_personal_data(held.select("doc_id", F.col("_doc.text").alias("text")), settings)
    by_start = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    spans = found.where(F.size("spans") > 0).select("doc_id", F.sort_array(F.transform("spans", by_start)).alias("s"))
    text, s = F.col("_doc.text"), F.col("s")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def replace(a: Column, x: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        grown = F.when(x["start"] >= a["at"], F.concat(a["out"], gap, F.get(names, x["kind"]))).otherwise(a["out"])
        return F.struct(grown.alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

    joined = held.join(spans, "doc_id", "left")
    clean = F.aggregate(s, zero, replace, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    redone = joined.select(F.struct(F.col("_doc"), F.when(s.isNull(), text).otherwise(clean).alias("t")).alias("x"), s.isNotNull().alias("c"))
    out = {"text": F.col("x.t"), "n_chars": F.when(F.col("c"), F.length("x.t").cast("long")).otherwise(F.col("x._doc.n_chars")) if "n_chars" in docs.columns else None}
    return redone.select(*[out[c].alias(c) if out.get(c) is not None else F.col("x._doc")[c].alias(c) for c in docs.columns])

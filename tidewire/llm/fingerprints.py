"""Order MinHash fingerprints of texts, as array expressions over whole texts."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.llm.arrays import positions, words

#: Words of a k-mer, k-mers of a tuple, tuples of a fingerprint (a power of two).
KMER, TUPLE, UNITS = 3, 2, 32


def order_minhash(text: Column) -> Column:
    """Array of ``UNITS`` longs: for each unit the hash of its ``TUPLE`` minimal k-mers in text order.

    k-mers of words are numbered by occurrence: the n-th time a k-mer comes it is another element, so
    repetition counts. One hash orders all elements on a ring; unit j takes the first elements from
    j / UNITS of the ring on, which is the order of the hash turned by j. The elements of a unit are
    put in text order before hashing, so that the fingerprint feels moved text and not only its set.
    Texts of fewer words than a k-mer are one k-mer; texts without a word have units of null.
    Sorting is the only step over linear in the words.
    """

    def kmers(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))

        def joined(h: Column) -> Column:
            at = positions(F.size(h) - KMER + 1)
            return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(KMER)]))

        short = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) < KMER, short).otherwise(bound(hashed, joined))

    def numbered(k: Column) -> Column:
        """(u, i): element hashes and places, ascending."""
        by_hash = F.sort_array(F.transform(k, lambda h, i: F.struct(h.alias("u"), i.alias("i"))))

        def with_runs(s: Column, starts: Column) -> Column:
            size = F.size(s)
            run = F.flatten(
                F.transform(starts, lambda st, j: F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1), size) - st - 1))
            )
            again = F.zip_with(
                s,
                run,
                lambda x, o: F.struct(
                    F.when(o == 0, x["u"]).otherwise(F.xxhash64(x["u"], o)).alias("u"), x["i"].alias("i")
                ),
            )
            return F.when(F.size(starts) == size, s).otherwise(F.sort_array(again))

        def runs(s: Column) -> Column:
            starts = F.filter(positions(F.size(s)), lambda i: (i == 0) | (F.get(s, i)["u"] != F.get(s, i - 1)["u"]))
            return bound(starts, lambda st: with_runs(s, st))

        return bound(by_hash, runs)

    shift = 64 - (UNITS - 1).bit_length()
    place = lambda x: F.shiftright(x["u"], shift) + UNITS // 2

    def units(s: Column) -> Column:
        size = F.size(s)
        firsts = F.transform(
            F.filter(
                positions(size), lambda i: (i == 0) | (place(F.get(s, i)) != place(F.get(s, F.greatest(i - 1, F.lit(0)))))
            ),
            lambda i: F.struct(place(F.get(s, i)).alias("b"), i.alias("i")),
        )

        def unit(first: Column) -> Column:
            chosen = F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.least(F.lit(TUPLE), size) - 1),
                    lambda t: _flip(F.get(s, (first + t) % size)),
                )
            )
            return F.xxhash64(F.transform(chosen, lambda x: x["u"]))

        def all_units(f: Column) -> Column:
            start = lambda j: F.coalesce(F.get(F.filter(f, lambda x: x["b"] >= j), F.lit(0))["i"], F.lit(0))
            return F.transform(F.sequence(F.lit(0), F.lit(UNITS - 1)), lambda j: unit(start(j)))

        return F.when(size == 0, F.array_repeat(F.lit(None).cast("bigint"), UNITS)).otherwise(bound(firsts, all_units))

    return bound(words(text), lambda w: bound(kmers(w), lambda k: bound(numbered(k), units)))


def _flip(x: Column) -> Column:
    return F.struct(x["i"].alias("i"), x["u"].alias("u"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with value computed once, though ``use`` may name it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal units, 0 to 1; units of two texts without words are equal."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x)
    return F.size(same) / F.lit(float(UNITS))


def as_hex(units: Column) -> Column:
    """Sixteen hexadecimal digits per unit; zeros for a unit of null."""
    return F.concat_ws("", F.transform(units, lambda x: F.lpad(F.lower(F.hex(F.coalesce(x, F.lit(0)))), 16, "0")))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Add next_NAME for each carried column: the document after, in descending doc_id; after the last, the first.

    Equal ids are ordered by the hash of the text, then the text; rows without doc_id come last, by
    hash. Documents are dealt by ranges of doc_id whose bounds are quantiles, so texts move once; the
    last document of a range gets its neighbour from the head of the next range. What comes to the
    driver is one id per range, and ranges are as many as shuffle partitions ask for.
    """
    spark = docs.sparkSession
    side = max(4, isqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    points = [i / (side * side) for i in range(1, side * side)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", points, 20 * side * side)).first()[0] or []))
    fine = [bounds[i : i + side] for i in range(0, len(bounds), side)]

    def longs(values: list[int]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<bigint>")

    # Two levels of bounds, so finding a range takes twice the root of their number.
    below = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    row = below(longs([x[0] for x in fine]))
    inner = below(F.get(F.array(*map(longs, fine or [[]])), row - 1))
    known = F.when(row == 0, F.lit(0)).otherwise((row - 1) * side + inner)
    hashed = F.xxhash64("text")
    # Rows without id may be many: they are cut into ranges of their hash.
    unknown = -1 - (F.shiftright(hashed, 64 - 7) + 64).cast("int")
    bucket = F.when(F.col("doc_id").isNull(), unknown).otherwise(known)
    placed = docs.select("*", bucket.alias("_bucket"), hashed.alias("_hash"))

    tops = docs.where("doc_id is not null").select("doc_id", known.alias("b")).groupBy("b").agg(F.max("doc_id")).collect()
    nulls = docs.where("doc_id is null").select(unknown.alias("b"), hashed.alias("h")).groupBy("b").agg(F.min("h")).collect()
    chain = sorted([b for b, _ in tops] + [b for b, _ in nulls], reverse=True)
    follows = spark.createDataFrame(
        [(b, chain[(i + 1) % len(chain)]) for i, b in enumerate(chain)], "_bucket int, _next int"
    )
    is_head = F.col("doc_id").isin([t for _, t in tops]) | (F.col("doc_id").isNull() & hashed.isin([h for _, h in nulls]))
    heads = (
        placed.where(is_head)
        .groupBy(F.col("_bucket").alias("_next"))
        .agg(F.min(F.struct("_hash", "text", *[c for c in carried if c != "text"])).alias("_head"))
        .join(follows, "_next")
        .select("_bucket", "_head")
    )
    inside = W.partitionBy("_bucket").orderBy(F.desc("doc_id"), F.asc("_hash"), F.asc("text"))
    led = placed.select(
        "*", F.lead(F.lit(1)).over(inside).isNull().alias("_last"), *[F.lead(c).over(inside).alias(f"next_{c}") for c in carried]
    )
    joined = led.join(heads, "_bucket", "left")
    chosen = {f"next_{c}": F.when(F.col("_last"), F.col("_head")[c]).otherwise(F.col(f"next_{c}")) for c in carried}
    return joined.withColumns(chosen).drop("_bucket", "_hash", "_last", "_head")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of an edited text, and their likeness; null text: empty.

    The edited text has its last floor(n_chars / 2) code points replaced by as many from the start of
    the next document (fewer, if that is shorter).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.withColumn("units", order_minhash(F.col("text")))
    both = with_next(marked, ["text", "units"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    built = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "units", "next_units")
    return built.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "units",
        order_minhash(F.col("edited")).alias("edited_units"),
        "next_units",
    ).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("units")).alias("fingerprint"),
        as_hex(F.col("edited_units")).alias("edited_fingerprint"),
        likeness(F.col("units"), F.col("edited_units")).alias("near_edited"),
        likeness(F.col("units"), F.col("next_units")).alias("near_next"),
    )

"""Text functions: cleaning, keywords, entities, categories, sentiment, language."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from tidewire import fixed

WORD = r"[\p{L}\p{N}_]+"
TITLE_CASE = (
    r"^[^\p{Lu}\p{Ll}]*\p{Lu}\p{Ll}*(?:[^\p{Lu}\p{Ll}]+\p{Lu}\p{Ll}*)*[^\p{Lu}\p{Ll}]*$"
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Lower-case word tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def str_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """True when ``text`` holds any of ``parts`` as a substring."""
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def joined_keywords(keywords: Column) -> Column:
    """The lower-case, blank-joined form the substring tests look at."""
    return F.lower(F.array_join(keywords, " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_line(text: Column) -> Column:
    """Collapse blanks, then keep word characters, blanks and ``- . , ! ?``."""
    return F.regexp_replace(collapse(text), r"[^\p{L}\p{N}_\s\-.,!?]", "")


def clean_body(text: Column) -> Column:
    """Drop tags, then collapse blanks."""
    return collapse(F.regexp_replace(text, r"<[^>]+>", ""))


def sanitize(text: Column, max_length: int | None = None) -> Column:
    """Drop control characters, collapse blanks, shorten with an ellipsis."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    out = collapse(out)
    if max_length:
        short = F.concat(F.left(out, F.lit(max_length - 3)), F.lit("..."))
        out = F.when(F.length(out) > max_length, short).otherwise(out)
    return out


def html_text(html: Column) -> Column:
    """Visible text of a page: script, style, nav and comments go, then all tags."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    return collapse(F.regexp_replace(body, r"<[^>]+>", " "))


def keywords(
    text: Column, limit: int = 10, stop_words: Sequence[str] = fixed.KEYWORD_STOP_WORDS
) -> Column:
    """Distinct words longer than three characters, in order of first sight."""
    kept = F.filter(words_of(text), lambda w: (F.length(w) > 3) & ~w.isin(*stop_words))
    return F.slice(F.array_distinct(kept), 1, limit)


def categories(
    text: Column, words: Mapping[str, Sequence[str]] = fixed.CATEGORY_WORDS, limit: int = 3
) -> Column:
    def found(low: Column) -> Column:
        hits = F.array(*[F.when(contains_any(low, ws), F.lit(name)) for name, ws in words.items()])
        return F.slice(F.array_compact(hits), 1, limit)

    return bind(F.lower(text), found)


def entity_candidates(text: Column) -> Column:
    """Title-case tokens longer than two characters."""
    parts = F.split(F.trim(text), r"\s+")
    return F.filter(parts, lambda w: w.rlike(TITLE_CASE) & (F.length(w) > 2))


def entity_texts(entities: Column, labels: Sequence[str]) -> Column:
    """Texts of those entity structs whose label is in ``labels``."""
    return F.transform(F.filter(entities, lambda e: e["label"].isin(*labels)), lambda e: e["text"])


def word_weight_mean(text: Column, weights: Mapping[str, float] = fixed.OPINION_WORDS) -> Column:
    """Mean weight of the opinion words of a text; 0 when it has none."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    hits = F.filter(words_of(text), lambda w: w.isin(*weights))
    return F.aggregate(
        hits,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda acc, w: F.struct(
            (acc["sum"] + F.element_at(table, w)).alias("sum"), (acc["n"] + 1).alias("n")
        ),
        lambda acc: F.when(acc["n"] > 0, acc["sum"] / acc["n"]).otherwise(F.lit(0.0)),
    )


def word_weight_share(text: Column, weights: Mapping[str, float] = fixed.OPINION_WORDS) -> Column:
    """Subjectivity: mean absolute weight of the opinion words, 0 when none."""
    return word_weight_mean(text, {w: abs(v) for w, v in weights.items()})


def guess_language(
    text: Column, lexicon: Mapping[str, Sequence[str]] = fixed.FUNCTION_WORDS
) -> Column:
    """Language whose function words occur most often; first listed wins a tie."""
    listed = sorted({w for ws in lexicon.values() for w in ws})

    def count(acc: Column, w: Column) -> Column:
        return F.struct(
            *[(acc[lang] + F.when(w.isin(*ws), 1).otherwise(0)).alias(lang) for lang, ws in lexicon.items()]
        )

    def best(acc: Column) -> Column:
        scored = [
            F.struct(acc[lang].alias("n"), F.lit(-i).alias("rank"), F.lit(lang).alias("lang"))
            for i, lang in enumerate(lexicon)
        ]
        top = F.greatest(*scored)
        return F.when(top["n"] > 0, top["lang"]).otherwise(F.lit("unknown"))

    return F.aggregate(
        F.filter(words_of(F.coalesce(text, F.lit(""))), lambda w: w.isin(*listed)),
        F.struct(*[F.lit(0).alias(lang) for lang in lexicon]),
        count,
        best,
    )


def language_code(name: Column, table: Mapping[str, str] = fixed.LANGUAGE_CODES) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    low = F.lower(name)
    return F.coalesce(F.try_element_at(lookup, low), low)


def language_name(code: Column, table: Mapping[str, str] = fixed.LANGUAGE_NAMES) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, code), F.lit("Unknown"))


def translation_acceptable(original: Column, translated: Column) -> Column:
    ratio = F.length(translated) / F.greatest(F.length(original), F.lit(1))
    return (ratio > 0.1) & (F.trim(translated) != "")


def needs_translation(language: Column, target: str = "en") -> Column:
    return (language != target) & (language != "unknown")


def parse_domains(
    reply: Column, known: Sequence[str] = fixed.DOMAIN_CATEGORIES
) -> Column:
    """Known categories named in a comma-separated reply.

    Each part stands for the first category that contains it; "uncategorized"
    anywhere wins alone. Parts that fit no category are dropped.
    """
    low = F.lower(F.trim(reply))
    cats = str_array(known)
    parts = F.filter(F.transform(F.split(low, ","), lambda p: F.trim(p)), lambda p: p != "")
    picked = F.transform(
        parts,
        lambda p: F.element_at(
            F.concat(F.filter(cats, lambda c: F.contains(F.lower(c), p)), F.array(F.lit(None))), 1
        ),
    )
    return F.when(
        F.contains(low, F.lit("uncategorized")), F.array(F.lit("Uncategorized"))
    ).otherwise(F.array_compact(picked))


def domain_confidence(domains: Column) -> Column:
    n = F.size(domains)
    return (
        F.when(n <= 0, 0.0).when(n == 1, 0.9).when(n == 2, 0.7).when(n == 3, 0.5).otherwise(0.3)
    )


def domain_words(names: Column) -> Column:
    """Distinct words of category names, cut at blanks, "/" and "-"."""
    parts = F.flatten(F.transform(names, lambda d: F.split(F.lower(d), r"[\s/\-]+")))
    return F.array_distinct(F.filter(parts, lambda w: w != ""))

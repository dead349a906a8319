"""Small dimension tables, written for this project from general knowledge.

They are literals in the plan, so the optimizer knows their size and broadcasts
them without a hint. Larger ones can be read from Parquet with the same columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire import fixed

# Country: ISO alpha-2, two-letter event-feed (FIPS) code, region, languages.
COUNTRIES = (
    ("Argentina", "AR", "AR", "Americas", "es"),
    ("Australia", "AU", "AS", "Oceania", "en"),
    ("Austria", "AT", "AU", "Europe", "de"),
    ("Bangladesh", "BD", "BG", "Asia", "bn"),
    ("Belgium", "BE", "BE", "Europe", "nl fr de"),
    ("Brazil", "BR", "BR", "Americas", "pt"),
    ("Cambodia", "KH", "CB", "Asia", "km"),
    ("Canada", "CA", "CA", "Americas", "en fr"),
    ("Chile", "CL", "CI", "Americas", "es"),
    ("China", "CN", "CH", "Asia", "zh"),
    ("Colombia", "CO", "CO", "Americas", "es"),
    ("Czechia", "CZ", "EZ", "Europe", "cs"),
    ("Denmark", "DK", "DA", "Europe", "da"),
    ("Egypt", "EG", "EG", "Africa", "ar"),
    ("Ethiopia", "ET", "ET", "Africa", "am"),
    ("Finland", "FI", "FI", "Europe", "fi sv"),
    ("France", "FR", "FR", "Europe", "fr"),
    ("Georgia", "GE", "GG", "Asia", "ka"),
    ("Germany", "DE", "GM", "Europe", "de"),
    ("Greece", "GR", "GR", "Europe", "el"),
    ("Hungary", "HU", "HU", "Europe", "hu"),
    ("India", "IN", "IN", "Asia", "hi en"),
    ("Indonesia", "ID", "ID", "Asia", "id"),
    ("Iran", "IR", "IR", "Asia", "fa"),
    ("Iraq", "IQ", "IZ", "Asia", "ar ku"),
    ("Ireland", "IE", "EI", "Europe", "en ga"),
    ("Israel", "IL", "IS", "Asia", "he ar"),
    ("Italy", "IT", "IT", "Europe", "it"),
    ("Japan", "JP", "JA", "Asia", "ja"),
    ("Kenya", "KE", "KE", "Africa", "en sw"),
    ("Mexico", "MX", "MX", "Americas", "es"),
    ("Myanmar", "MM", "BM", "Asia", "my"),
    ("Netherlands", "NL", "NL", "Europe", "nl"),
    ("Nigeria", "NG", "NI", "Africa", "en"),
    ("Norway", "NO", "NO", "Europe", "no"),
    ("Pakistan", "PK", "PK", "Asia", "ur en"),
    ("Philippines", "PH", "RP", "Asia", "en tl"),
    ("Poland", "PL", "PL", "Europe", "pl"),
    ("Portugal", "PT", "PO", "Europe", "pt"),
    ("Romania", "RO", "RO", "Europe", "ro"),
    ("Russia", "RU", "RS", "Europe", "ru"),
    ("Saudi Arabia", "SA", "SA", "Asia", "ar"),
    ("Serbia", "RS", "RI", "Europe", "sr"),
    ("South Africa", "ZA", "SF", "Africa", "af en zu"),
    ("South Korea", "KR", "KS", "Asia", "ko"),
    ("Spain", "ES", "SP", "Europe", "es"),
    ("Sweden", "SE", "SW", "Europe", "sv"),
    ("Switzerland", "CH", "SZ", "Europe", "de fr it"),
    ("Taiwan", "TW", "TW", "Asia", "zh"),
    ("Thailand", "TH", "TH", "Asia", "th"),
    ("Turkey", "TR", "TU", "Asia", "tr"),
    ("Ukraine", "UA", "UP", "Europe", "uk"),
    ("United Arab Emirates", "AE", "AE", "Asia", "ar"),
    ("United Kingdom", "GB", "UK", "Europe", "en"),
    ("United States", "US", "US", "Americas", "en"),
    ("Vietnam", "VN", "VM", "Asia", "vi"),
)
ALIASES = (
    ("usa", "United States"), ("us", "United States"), ("america", "United States"),
    ("uk", "United Kingdom"), ("great britain", "United Kingdom"), ("britain", "United Kingdom"),
    ("england", "United Kingdom"), ("russian federation", "Russia"), ("persia", "Iran"),
    ("republic of korea", "South Korea"), ("burma", "Myanmar"), ("czech republic", "Czechia"),
    ("holland", "Netherlands"), ("uae", "United Arab Emirates"), ("prc", "China"),
    ("bharat", "India"), ("türkiye", "Turkey"),
)
REGIONS = (
    ("kurdistan", "ku ar"), ("balkans", "sr hr sq"), ("catalonia", "ca es"), ("tibet", "bo zh"),
    ("kashmir", "ur hi"), ("sahel", "fr ar"), ("caucasus", "ru ka hy"), ("donbas", "uk ru"),
    ("arab world", "ar"), ("latin america", "es pt"),
)
VARIANTS = (("zh", "zh-CN"), ("zh", "zh-TW"), ("zh", "zh-HK"))
MODEL_CODES = (
    ("ar", "arb_Arab"), ("de", "deu_Latn"), ("en", "eng_Latn"), ("es", "spa_Latn"),
    ("fa", "pes_Arab"), ("fr", "fra_Latn"), ("he", "heb_Hebr"), ("hi", "hin_Deva"),
    ("it", "ita_Latn"), ("ja", "jpn_Jpan"), ("ko", "kor_Hang"), ("pt", "por_Latn"),
    ("ru", "rus_Cyrl"), ("tr", "tur_Latn"), ("uk", "ukr_Cyrl"), ("zh", "zho_Hans"),
)


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({value} AS DOUBLE)"


def inline_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A table of literals (a local relation of known size)."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def countries(spark: SparkSession) -> DataFrame:
    table = inline_table(spark, ("country", "alpha2", "gkg_code", "region", "langs"), COUNTRIES)
    return table.withColumn("languages", F.split("langs", " ")).drop("langs")


def aliases(spark: SparkSession) -> DataFrame:
    """alias (lower case), country, priority: exact names before conversions and variations."""
    names = [(c[0].lower(), c[0], 0.0) for c in COUNTRIES]
    codes = [(c[1].lower(), c[0], 1.0) for c in COUNTRIES]
    other = [(a, c, 2.0) for a, c in ALIASES]
    return inline_table(spark, ("alias", "country", "priority"), names + codes + other)


def regions(spark: SparkSession) -> DataFrame:
    table = inline_table(spark, ("region", "langs"), REGIONS)
    return table.withColumn("languages", F.split("langs", " ")).drop("langs")


def variants(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ("language", "variant"), VARIANTS)


def model_codes(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ("language", "model_code"), MODEL_CODES)


def prices(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ("provider", "model", "price_in", "price_out"), fixed.TOKEN_PRICES)


def in_region(table: DataFrame, region: str) -> DataFrame:
    return table.where(F.lower("region") == region.lower())


def speaking(table: DataFrame, language: str) -> DataFrame:
    return table.where(F.array_contains("languages", language))

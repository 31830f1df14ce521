"""Names and addresses as comparable tokens, in Column expressions; only the accent strip of texts that are not ASCII runs in Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import LANDMARK, LEGAL, NAME_STOP, SHORT


def fold(s: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


def strip_accents(c: Column) -> Column:
    """``fold`` of the texts that have anything to fold; the others go to no worker but as nulls."""
    return F.coalesce(_fold(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def tokens(folded: Column) -> Column:
    """Tokens of text that has been through ``strip_accents``; null gives none."""
    s = F.lower(F.coalesce(folded, F.lit("")))
    # fixed values: the three patterns
    s = F.regexp_replace(s, r"(?U)\bm\s*/\s*s\b", " ")
    s = F.regexp_replace(s, "&", " and ")
    s = F.regexp_replace(s, "['’]", " ")
    s = F.regexp_replace(s, r"(?U)\b(\d{3})[\s-](\d{3})\b", "$1$2")
    words = F.filter(F.split(F.regexp_replace(s, "[^0-9a-z]+", " "), " "), lambda t: t != "")
    short = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(short, t), t))


def merge_initials(words: Column) -> Column:
    """Runs of single letters become one token."""
    joined = F.regexp_replace(F.array_join(words, " "), "(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", "")
    return F.filter(F.split(joined, " "), lambda t: t != "")


def normalize_records(raw: DataFrame) -> DataFrame:
    """raw: entity_id, src, business_name, business_address, country -> the 15 record columns, and the raw texts."""
    base = raw.select("entity_id", "src", *[c for c in ("_order",) if c in raw.columns], F.coalesce("business_name", F.lit("")).alias("raw_name"), F.coalesce("business_address", F.lit("")).alias("raw_addr"), F.coalesce("country", F.lit("")).alias("country"))
    base = base.select("*", strip_accents(F.col("raw_name")).alias("_n"), strip_accents(F.col("raw_addr")).alias("_a"))
    base = base.withColumn("nt", merge_initials(tokens(F.col("_n")))).withColumn("at", tokens(F.col("_a"))).drop("_n", "_a")
    core = F.filter("nt", lambda t: ~t.isin(*LEGAL, *NAME_STOP))
    base = base.withColumn("core", F.when(F.size(core) > 0, core).otherwise(F.col("nt")))
    tail = F.slice("at", F.greatest(F.size("at") - 3, F.lit(1)), 4)
    base = base.withColumn("postal", F.coalesce(F.get(F.filter(F.reverse(tail), lambda t: t.rlike("^([0-9]{5}|[0-9]{6})$")), F.lit(0)), F.lit("")))
    country = F.regexp_replace("country", r"(?U)^\s+|\s+$", "")
    return base.select(
        "entity_id",
        "src",
        F.when(country == "", "UNK").otherwise(country).alias("country"),
        F.array_join("nt", " ").alias("name_norm"),
        F.array_join("core", " ").alias("name_core"),
        F.array_distinct("core").alias("core_set"),
        F.coalesce(F.get("core", F.lit(0)), F.lit("")).alias("core_first"),
        F.array_distinct(F.filter("nt", lambda t: t.isin(*LEGAL))).alias("legal"),
        F.when(F.size("core") >= 2, F.array_join(F.transform("core", lambda t: F.substring(t, 1, 1)), "")).otherwise("").alias("acronym"),
        F.array_distinct(F.filter("core", lambda t: t.rlike("^[0-9]+$"))).alias("name_digits"),
        F.array_join("at", " ").alias("addr_norm"),
        F.array_distinct("at").alias("addr_set"),
        "postal",
        F.array_distinct(F.filter("at", lambda t: t.rlike("[0-9]") & (t != F.col("postal")))).alias("nums"),
        F.exists("at", lambda t: t.isin(*LANDMARK)).cast("int").alias("landmark"),
        "raw_name",
        "raw_addr",
        *[c for c in ("_order",) if c in raw.columns],
    )


def entity_text(kind: str) -> Column:
    """Text of a normalized record for an encoder ('dense'), the full view ('full') or a pair scorer ('pair').
    Raw text is offered too ('raw'), as tokens keep Latin letters and digits only."""
    return {
        "dense": F.concat_ws(" | ", "name_core", "addr_norm"),
        "full": F.concat_ws(" | ", "name_core", "addr_norm"),
        "name": F.col("name_core"),
        "pair": F.concat(F.lit("name: "), F.col("name_norm"), F.lit(" | address: "), F.col("addr_norm")),
        "raw": F.concat_ws(" | ", "raw_name", "raw_addr"),
    }[kind]

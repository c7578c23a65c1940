"""Aspects that reviews mention: extraction, canonical forms, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import lexicons
from gristmill.functions.text import contains_any, py_strip, tokens


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])


def canonical(aspects: Column, forms: dict[str, str] = lexicons.CANONICAL_ASPECTS, empty=lexicons.EMPTY_ASPECTS) -> Column:
    """Canonical forms without empty ones, sorted and distinct."""
    known = _map(forms)
    renamed = F.transform(aspects, lambda a: F.coalesce(F.try_element_at(known, a), a))
    return F.array_sort(F.array_distinct(F.array_except(renamed, _array(empty))))


def term_aspects(text: Column, vocabulary=lexicons.DOMAIN_TERMS) -> Column:
    """Words of the text that are in the vocabulary. (V6)"""
    return F.array_intersect(tokens(F.lower(text)), _array(vocabulary))


def chunk_aspects(chunks: Column, vocabulary=lexicons.DOMAIN_TERMS) -> Column:
    """Aspects of noun chunks that a parser has found: array<struct<text,head_pos>>. (V7)"""
    cleaned = F.transform(chunks, lambda c: F.struct(py_strip(F.lower(c["text"])).alias("t"), c["head_pos"].alias("p")))
    vocab, empty = _array(vocabulary), _array(lexicons.EMPTY_ASPECTS)
    kept = F.filter(cleaned, lambda c: ~F.array_contains(empty, c["t"]) & ((F.length(c["t"]) >= 4) | F.array_contains(vocab, c["t"])) & c["p"].isin("NOUN", "PROPN"))
    own = F.transform(kept, lambda c: F.regexp_replace(c["t"], "^(" + "|".join(lexicons.POSSESSIVES) + r")\s+", ""))
    return F.array_distinct(F.filter(own, lambda t: F.length(t) >= 3))


def extract(text: Column, chunks: Column | None = None, vocabulary=lexicons.DOMAIN_TERMS, forms=lexicons.CANONICAL_ASPECTS) -> Column:
    """Sorted canonical aspects of a text; null for blank text."""
    found = term_aspects(text, vocabulary)
    if chunks is not None:
        found = F.array_union(chunk_aspects(chunks, vocabulary), found)
    return F.when(F.coalesce(py_strip(text) != "", F.lit(False)), canonical(found, forms))


def ranking_form(aspect: Column, forms: dict[str, str | None] = lexicons.RANKING_ASPECTS) -> Column:
    """The form that is ranked: null drops the mention, unknown ones stay as they are. (V8)"""
    key = py_strip(F.lower(aspect))
    drop = [k for k, v in forms.items() if v is None]
    return F.when(key.isin(drop), F.lit(None)).otherwise(F.coalesce(F.try_element_at(_map({k: v for k, v in forms.items() if v}), key), aspect))


def mentions(reviews: DataFrame, aspects: str = "aspects", forms: dict[str, str | None] = lexicons.RANKING_ASPECTS) -> DataFrame:
    """One row for each mention, repeats included. (V9)"""
    rows = reviews.withColumn("aspect", F.explode(aspects)).withColumn("aspect", ranking_form(F.col("aspect"), forms))
    return rows.where("aspect is not null").drop(aspects) if aspects != "aspect" else rows


def is_feature(aspect: Column, brands=lexicons.BRANDS, noise=lexicons.NOISE_SUBSTRINGS) -> Column:
    """No brand and no noise word anywhere in it."""
    low = F.lower(aspect)
    return ~py_strip(low).isin(*brands) & ~contains_any(low, noise)


def drop_entities(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Without aspects that a recogniser lists as names: entities (aspect). (V10, second stage)"""
    return rows.join(entities.select("aspect").distinct(), "aspect", "left_anti")

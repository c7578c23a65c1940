"""Scores of texts: built-in lexicon scores, and a place for models of the caller's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import lexicons
from gristmill.functions.text import tokens

PREFIX = 150
#: Rows of a batch that a model gets.
BATCH = 256


def _hits(text: Column, place: int, lexicon) -> Column:
    """Lexicon values of the words of a text that are in it; letters alone are compared."""
    known = F.create_map(*[F.lit(x) for row in lexicon for x in (row[0], float(row[place]))])
    words = F.transform(tokens(F.lower(text)), lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))
    return F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda v: v.isNotNull())


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def compound(text: Column, lexicon=lexicons.SENTIMENT) -> Column:
    """Sum of valences of the first 150 characters, squashed to -1..1.

    Negated and intensified words count as they are. Null text: null.
    """
    s = _total(_hits(F.substring(text, 1, PREFIX), 1, lexicon))
    return s / F.sqrt(s * s + F.lit(15.0))


def subjectivity(text: Column, lexicon=lexicons.SENTIMENT) -> Column:
    """Mean subjectivity of the lexicon's words in the text; 0 without any."""
    v = _hits(text, 2, lexicon)
    return F.coalesce(_total(v) / F.nullif(F.size(v), F.lit(0)), F.lit(0.0))


def polarity(text: Column, lexicon=lexicons.SENTIMENT) -> Column:
    """Mean valence of the lexicon's words, scaled to -1..1; 0 without any."""
    v = _hits(text, 1, lexicon)
    return F.coalesce(_total(v) / F.nullif(F.size(v), F.lit(0)) / F.lit(4.0), F.lit(0.0))


Model = Callable[[list[str | None]], list[dict]]


def with_model(rows: DataFrame, load: Callable[[], Model], schema: str, text: str = "text") -> DataFrame:
    """Rows with the columns of `schema` from a model, which is loaded once for each partition and gets batches of texts.

    A batch that fails is scored text by text; a text that fails has nulls. Blank texts aren't sent. (V22, V30, X6)
    """
    from pyspark.sql.types import StructType

    own = StructType.fromDDL(schema)
    names, out = own.names, StructType([*rows.schema.fields, *own.fields])

    def score(model: Model, texts: list[str]) -> list[dict]:
        try:
            got = model(texts)
            if len(got) != len(texts):
                raise ValueError("a result for each text is needed")
            return got
        except Exception:
            if len(texts) == 1:
                return [{}]
            return [x for t in texts for x in score(model, [t])]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for lo in range(0, len(pdf), BATCH):
                part = pdf.iloc[lo : lo + BATCH].reset_index(drop=True)
                sent = [i for i, t in enumerate(part[text]) if isinstance(t, str) and t.strip()]
                got: list[dict] = [{}] * len(part)
                for i, x in zip(sent, score(model, [part[text][i] for i in sent]) if sent else [], strict=True):
                    got[i] = x or {}
                yield part.assign(**{n: pd.Series([x.get(n) for x in got], dtype=object) for n in names})

    return rows.mapInPandas(go, out)


def constant_model(**values) -> Callable[[], Model]:
    """A stand-in that gives every text the same values, e.g. for dry runs."""
    return lambda: lambda texts: [dict(values) for _ in texts]

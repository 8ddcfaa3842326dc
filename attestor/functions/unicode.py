"""Unicode functions that Spark has no expression for, as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """Compatibility composition, case folded; white space as it is."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def nfkc_fold(text: pd.Series) -> pd.Series:
    """Compatibility composition, case folded, white space collapsed."""
    return text.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip())


def aligned(text: str) -> tuple[str, np.ndarray]:
    """The normal form of a text, and for each of its characters the place in the text that it comes from. Forms are
    taken once for each distinct character; of a run of white space the first character stays, as a blank."""
    places = np.arange(len(text))
    forms = {c: " " if c.isspace() else re.sub(r"\s", " ", unicodedata.normalize("NFKC", c).casefold()) for c in set(text)}
    if not all(len(f) == 1 for f in forms.values()):
        places = np.repeat(places, [len(forms[c]) for c in text])
    whole = np.array(list("".join(map(forms.__getitem__, text))), dtype="<U1")
    blank = whole == " "
    keep = ~blank
    if len(blank):
        keep[1:] |= ~blank[:-1]  # a blank after something else
    return "".join(whole[keep]), places[keep]


@F.pandas_udf(StructType().add("start", IntegerType()).add("end", IntegerType()))
def locate(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """Where a quote stands in a text, both normalised; offsets are those of the text as it is, -1 if it isn't there."""
    tables: dict[str, tuple[str, np.ndarray]] = {}
    found = np.full((len(text), 2), -1, np.int32)
    for row, (t, q) in enumerate(zip(text.fillna(""), quote.fillna(""), strict=True)):
        wanted = aligned(q)[0].strip()
        if t not in tables:
            tables = {t: aligned(t)}  # the quotes of a text follow one another
        normal, places = tables[t]
        at = normal.find(wanted) if wanted else -1
        if at >= 0:
            found[row] = places[at], places[at + len(wanted) - 1] + 1
    return pd.DataFrame(found, columns=["start", "end"])

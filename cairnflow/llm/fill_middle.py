"""Fill-in-middle transformation of texts, and back.

A text is cut into units (a run of ASCII letters, or any other character). Two cuts drawn from a hash of the document's id part it into
prefix, middle and suffix, which are written behind marks in the order of the form drawn: ``psm`` (prefix, suffix, middle) or
``spm`` (suffix, prefix, middle). Texts that are empty, hold a mark, or are drawn to stay are ``plain``. A pandas UDF gets
Arrow batches; in it the regex library finds the units, of which only the end offsets are kept, and two lookups there cut the text.

No mark can arise across the ends of parts, since each mark begins with its only ``<``; so the first of each mark in an
output is the one written, and ``restored`` gives the exact text.

Defined results: a null text counts as empty (plain, no units); a null id is hashed as the text ``null``; repeated rows give a row
each; other columns are kept, and those named as the new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNIT = regex.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are transformed, and of a hundred transformed ones so many as ``spm``.
CHANGED, SUFFIX_FIRST = 90, 20

_end = type(regex.match("", "")).end


def unit_ends(text: str) -> np.ndarray:
    """End offsets of the units of a text, in code points."""
    return np.fromiter(map(_end, UNIT.finditer(text)), np.uint32)


def transformed_text(key: str, text: str, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text; ``key`` names the document."""
    seed = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(seed[k : k + 8], 16) for k in range(0, 32, 8))
    ends = unit_ends(text)
    n = len(ends)
    if not text or h3 % 100 >= changed or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(ends[u - 1]) if u else 0 for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored_text(output: str, form: str) -> str:
    """The text that was transformed to ``output``."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with ``n`` (long), ``form``, ``prefix_chars`` and ``middle_chars`` (long, null if plain), ``output`` and
    ``output_sha256``."""
    kinds = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "output_sha256": "string"}

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in kinds.items()))
    def fim(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transformed_text(k, t, changed, suffix_first) for k, t in zip(keys, texts, strict=True)]
        out = pd.DataFrame([(*r, _sha256(r[-1])) for r in rows], columns=list(kinds))
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    (made,) = common.unused(docs, "_made")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = docs.withColumn(made, fim(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text))
    return both.select(*[c for c in docs.columns if c.lower() not in kinds], *[F.col(f"{made}.{c}").alias(c) for c in kinds])


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``df`` with ``restored``, the exact text rebuilt from output and form, and ``restored_sha256``."""

    @F.pandas_udf("restored string, restored_sha256 string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [restored_text(o, f) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"restored": texts, "restored_sha256": [_sha256(t) for t in texts]})

    new = ["restored", "restored_sha256"]
    (made,) = common.unused(df, "_made")
    both = df.withColumn(made, back(F.col(output_col), F.col(form_col)))
    return both.select(*[c for c in df.columns if c.lower() not in new], *[F.col(f"{made}.{c}").alias(c) for c in new])


def op12(spark, sf_dir: str) -> DataFrame:
    out = restored(transformed(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    # written here, so that few texts at a time go to Python
    return common.written(out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"), "fill-middle")

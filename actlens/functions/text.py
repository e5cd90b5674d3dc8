"""Text functions: paragraphs, names, normalisation, token pieces."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that queries strip and split at; one explicit class for both engines.
SPACE = r"[ \t\r\n]"
#: Concatenative tokenizers, one for each stream: words with a leading space, three characters, runs of one class.
PIECES = (r" ?[^ \n]+| |\n", r"(?s).{1,3}", r"[ \n]|[0-9]+|[!-/:-@\[-`{-~]+|[^ \n0-9!-/:-@\[-`{-~]+")

#: What a code point is to the third tokenizer: 0 stands alone, others run; the last entry is for all beyond ASCII.
_CLASS = np.array([0 if chr(i) in " \n" else 1 if "0" <= chr(i) <= "9" else 2 if 33 <= i <= 126 and not chr(i).isalnum() else 3 for i in range(128)] + [3], np.uint8)


def piece_starts(code: np.ndarray, first: np.ndarray, stream: int) -> np.ndarray:
    """Where pieces of a stream's tokenizer begin in the code points of several texts, joined; ``first`` has where texts begin, and their end."""
    if stream == 1:
        each = -(-np.diff(first) // 3)
        return np.repeat(first[:-1] - 3 * (np.cumsum(each) - each), each) + 3 * np.arange(each.sum())
    starts = np.empty(len(code), bool)
    if stream == 0:  # a space always begins a piece, and a word only without one before it
        feed = code == 10
        np.logical_or(code == 32, feed, out=starts)
        starts[1:] |= feed[:-1]
    elif stream == 2:
        kind = _CLASS[np.minimum(code, 128)]
        np.equal(kind, 0, out=starts)
        starts[1:] |= kind[1:] != kind[:-1]
    else:
        raise ValueError(f"no tokenizer: {stream}")
    starts[first[:-1][first[:-1] < first[1:]]] = True
    return np.flatnonzero(starts)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def paragraphs(text: Column) -> Column:
    """The non-empty stripped parts between runs of line feeds."""
    return F.filter(F.transform(F.split(text, r"\n+"), strip), lambda p: p != "")


def pieces(text: Column, stream: int) -> Column:
    """Token pieces of a stream's tokenizer; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(PIECES[stream]), F.lit(0))


def is_content(piece: Column, special: tuple[str, ...] = ()) -> Column:
    """Whether a token has text: white space and the tokenizer's ``special`` tokens have none."""
    solid = F.regexp_replace(piece, f"{SPACE}+", "") != ""
    return solid & ~piece.isin(*special) if special else solid


def solid_length(piece: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(piece, SPACE, ""))


def file_slug(name: Column) -> Column:
    """For file names: slashes become underscores, other unusual runs a hyphen."""
    return F.regexp_replace(F.replace(F.trim(name), F.lit("/"), F.lit("_")), "[^a-zA-Z0-9._-]+", "-")


def file_slug_of(name: str) -> str:
    """:func:`file_slug` of one name."""
    return re.sub("[^a-zA-Z0-9._-]+", "-", name.strip().replace("/", "_"))


def parameter_slug(name: Column) -> Column:
    """For parameter names: dots, slashes and hyphens become underscores."""
    return F.translate(name, "./-", "___")


def normalize(s: str) -> str:
    """NFKC, white space to single spaces, case folded, stripped."""
    return " ".join(unicodedata.normalize("NFKC", s).split()).casefold().strip()


def normalized(x: Column) -> Column:
    """:func:`normalize` on a column; Spark has neither NFKC nor case folding."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else normalize(v))

    return F.pandas_udf(run, T.StringType())(x)


def format_window(parts: Column) -> Column:
    """The quoted pieces of a window, joined by a middle dot."""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("'"), F.replace(p, F.lit("\n"), F.lit("\\n")), F.lit("'"))), "·")


def cell(x: Column, width: int = 32) -> Column:
    """A text of at most ``width`` characters; longer ones end in three dots."""
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 3), F.lit("..."))).otherwise(x)

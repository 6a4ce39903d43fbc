"""What models answer: points, label probabilities, repeated phrases, near-equal texts; and what nodes are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType


def predicted_point(answer: Column, scale: int = 1000) -> Column:
    """x and y of 0 to 1 that an answer names, null if it names none.

    The last bracket with two or four numbers counts, else the whole answer if it has so many
    numbers; of a box the centre; numbers over 1 are on the scale.
    """
    def numbers(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))

    def usable(values: Column) -> Column:
        return F.size(values).isin(2, 4)

    groups = F.filter(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]*)\]"), 1), numbers), usable)
    whole = numbers(answer)
    found = F.when(F.size(groups) > 0, F.element_at(groups, -1)).when(usable(whole), whole)
    point = F.when(F.size(found) == 4, F.array((found[0] + found[2]) / 2, (found[1] + found[3]) / 2)).otherwise(found)
    return F.when(F.exists(found, lambda v: v > 1), F.transform(point, lambda v: v / scale)).otherwise(point)


def label_probability(tokens: Column, start: str = "summary", label: str = "yes") -> Column:
    """Probability of the first short token with the label behind the last token with `start`; 0 without one.

    tokens: an array of (token, logprob). Without a start token the search begins at the second.
    """
    plain = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), F.lower(F.btrim(t["token"])).alias("token"), t["logprob"].alias("logprob")))
    at = F.coalesce(F.array_max(F.transform(F.filter(plain, lambda t: F.contains(t["token"], F.lit(start))), lambda t: t["i"])), F.lit(0))
    hits = F.filter(plain, lambda t: (t["i"] > at) & (F.length(t["token"]) <= 3) & F.contains(t["token"], F.lit(label)))
    return F.when(F.size(hits) > 0, F.exp(F.get(hits, F.lit(0))["logprob"])).otherwise(0.0)


def node_label(text: Column, description: Column, resource: Column) -> Column:
    """The best name of a node: its description, with the text behind it if that says less; the text; the last part of its id."""
    said, shown = F.btrim(description), F.when(text != "", text)
    said = F.when(said != "", said)
    part = F.btrim(F.substring_index(resource, "/", -1))
    both = F.when(F.length(said) > F.length(shown), F.concat(said, F.lit(", "), shown))
    return F.coalesce(both, said, shown, F.when(part != "", part))


def node_kind(text: Column, description: Column, view: Column) -> Column:
    """Icon, Image or Text."""
    filled = lambda c: F.coalesce(F.btrim(c) != "", F.lit(False))
    return F.when(F.contains(F.lower(view), F.lit("image")), "Image").when(filled(text) & ~filled(description), "Text").otherwise("Icon")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: twice the common subsequence by both lengths; two empty texts give 100, null gives null."""
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        return 200.0 * _common(x, y) / (len(x) + len(y)) if x or y else 100.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def repeats_phrase(text: str | None, times: int = 3) -> bool:
    """Whether some words stand there so many times in a row.

    For each length the runs of words that equal the word so far ahead are measured at once.
    """
    words = (text or "").split()
    _, w = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True) if words else (None, np.zeros(0, int))
    for size in range(1, len(w) // times + 1):
        same = np.flatnonzero(np.append(w[size:] != w[:-size], True))
        if np.diff(same, prepend=-1).max() - 1 >= size * (times - 1):
            return True
    return False


@F.pandas_udf(BooleanType())
def has_repeated_phrase(text: pd.Series) -> pd.Series:
    """repeats_phrase of each text, three times; null and empty texts have none."""
    return text.map(repeats_phrase).astype(bool)


def with_model(rows: DataFrame, prompt: str, answer: Callable[[list[str]], list[str]], batch: int = 64, name: str = "response") -> DataFrame:
    """rows with a model's responses; `answer` takes and gives lists and is loaded once a task by its own closure.

    Null prompts stay null and don't reach the model. No shuffle: each partition is one stream of batches.
    """
    schema = rows.withColumn(name, F.lit(None).cast("string")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch].copy()
                asked = part[prompt].notna()
                part[name] = None
                if asked.any():
                    part.loc[asked, name] = pd.Series(answer(part.loc[asked, prompt].tolist()), index=part.index[asked], dtype=object)
                yield part

    return rows.mapInPandas(run, schema)

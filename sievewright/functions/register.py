"""Functions of this library under names that SQL texts can use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievewright.functions import text as tx
from sievewright.operators import extract


def _text_function(of):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else of(t))

    return run


@F.udtf(returnType="name string, affiliation string")
class LinkedPeople:
    """One row per name and affiliation that a block of linked data states, however deep the article lies in it."""

    def eval(self, block: str) -> Iterator[tuple[str, str]]:
        yield from extract.linked_people(block)


def register(spark: SparkSession, prefix: str = "sw_") -> list[str]:
    """Registers the functions and returns their names."""
    functions = {"unescape": extract.unescape, "normal_text": _text_function(tx.normal_text), "normal_words": _text_function(tx.normal_words), "normal_name": _text_function(tx.normal_name), "encoding_undone": _text_function(tx.encoding_undone)}
    for name, function in functions.items():
        spark.udf.register(prefix + name, function)
    spark.udtf.register(prefix + "linked_people", LinkedPeople)
    return [prefix + n for n in (*functions, "linked_people")]

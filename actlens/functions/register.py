"""Functions for SQL: normalisation and checks as SQL functions, number words as an Arrow function, table rows as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from actlens.functions.numbers import words_to_number


def register_functions(spark: SparkSession) -> None:
    """words_to_number_it(string), parse_amount_it(string), and valid_vat(string) for use in SQL."""

    @F.pandas_udf("double")
    def number_words(s: pd.Series) -> pd.Series:
        return s.map(lambda x: words_to_number(x) if x else None).astype("float64")

    spark.udf.register("words_to_number_it", number_words)
    spark.sql("create or replace temporary function parse_amount_it(s string) returns double return case when s like '%,%' then try_cast(replace(replace(s, '.', ''), ',', '.') as double) else try_cast(s as double) end")
    spark.sql(
        "create or replace temporary function valid_vat(s string) returns boolean return s rlike '^[0-9]{11}$' and aggregate(sequence(1, 11), 0, (a, i) -> a + if(i % 2 = 1, try_cast(substring(s, i, 1) as int), if(2 * try_cast(substring(s, i, 1) as int) > 9, 2 * try_cast(substring(s, i, 1) as int) - 9, 2 * try_cast(substring(s, i, 1) as int)))) % 10 = 0"
    )


def register_tables(spark: SparkSession) -> None:
    """windows_of(text, size, overlap): the fixed windows of a text as rows."""

    @F.udtf(returnType="chunk_no int, chunk string")
    class Windows:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
            step, k, n = size - overlap, 0, 1
            while text is not None and (k == 0 or k + overlap < len(text)):
                yield n, text[k : k + size]
                k, n = k + step, n + 1

    spark.udtf.register("windows_of", Windows)

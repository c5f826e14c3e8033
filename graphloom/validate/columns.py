"""Schemas applied to columns of JSON texts, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .engine import Validator


def _with(df: DataFrame, column: str, schema, fields: list[tuple[str, T.DataType, pa.DataType]], work, remote=None) -> DataFrame:
    validator = Validator(schema, remote)
    out = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [work(validator, x.as_py()) for x in batch.column(column)]
            columns = [pa.array([r[k] for r in rows], f[2]) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], out.names)

    return df.mapInArrow(run, out)


def validated(df: DataFrame, column: str, schema, remote=None) -> DataFrame:
    """df with valid and errors; a null text is absent and invalid, text that is no JSON too."""

    def work(v: Validator, text):
        if text is None:
            return False, ["$: absent"]
        try:
            found = v.errors(json.loads(text))
        except ValueError:
            return False, ["$: not JSON"]
        return not found, found

    return _with(df, column, schema, [("valid", T.BooleanType(), pa.bool_()), ("errors", T.ArrayType(T.StringType()), pa.list_(pa.string()))], work, remote)


def with_defaults(df: DataFrame, column: str, schema) -> DataFrame:
    """df with completed: the JSON text with defaults."""
    return _with(df, column, schema, [("completed", T.StringType(), pa.string())], lambda v, t: (None if t is None else json.dumps(v.with_defaults(json.loads(t)), separators=(",", ":")),))


def projected(df: DataFrame, column: str, schema) -> DataFrame:
    """df with projected: the declared properties as a JSON text, or null if the value is invalid."""

    def work(v: Validator, text):
        try:
            return (json.dumps(v.project(json.loads(text)), separators=(",", ":")),)
        except (ValueError, TypeError):
            return (None,)

    return _with(df, column, schema, [("projected", T.StringType(), pa.string())], work)


def variants(df: DataFrame, column: str, schema) -> DataFrame:
    """df with one_of (the index of the only match, or null) and any_of (all matches)."""

    def work(v: Validator, text):
        value = json.loads(text) if text is not None else None
        return v.one_of_index(value), v.any_of_indices(value)

    return _with(df, column, schema, [("one_of", T.IntegerType(), pa.int32()), ("any_of", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], work)

"""Decoding of the JSON text of RRC messages, only the fields the detectors need."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from callcause import schemas as S


def message_schema(root: str, paths: Iterable[str]) -> T.StructType:
    """Struct type with one long at the end of every path; ``name[]`` is an array."""
    tree: dict = {}
    for path in paths:
        level = tree
        for step in f"{root}.{path}".split("."):
            level = level.setdefault(step, {})

    def build(children: dict) -> T.DataType:
        if not children:
            return T.LongType()
        fields = []
        for step, below in children.items():
            kind = build(below)
            is_array = step.endswith("[]")
            fields.append(T.StructField(step.removesuffix("[]"), T.ArrayType(kind) if is_array else kind))
        return T.StructType(fields)

    return build(tree)


def _decode(df: DataFrame, message: str, only: Column, root: str,
            paths: Mapping[str, str], wanted: Iterable[str]) -> DataFrame:
    wanted = list(wanted)
    schema = message_schema(root, [paths[name] for name in wanted])
    # Other messages are not parsed at all; broken text gives nulls.
    parsed = df.withColumn("_parsed", F.from_json(F.when(only, F.col(message)), schema))
    fields = {name: F.col(f"_parsed.{root}.{paths[name].replace('[]', '')}") for name in wanted}
    return parsed.withColumns(fields).drop("_parsed")


def decode_downlink(df: DataFrame, message: str, only: Column,
                    wanted: Iterable[str] = tuple(S.DOWNLINK_PATHS)) -> DataFrame:
    """Add the wanted fields of reconfiguration messages, one column each."""
    return _decode(df, message, only, S.DOWNLINK_ROOT, S.DOWNLINK_PATHS, wanted)


def decode_uplink(df: DataFrame, message: str, only: Column,
                  wanted: Iterable[str] = tuple(S.UPLINK_PATHS)) -> DataFrame:
    """Add the wanted fields of measurement reports, one column each."""
    return _decode(df, message, only, S.UPLINK_ROOT, S.UPLINK_PATHS, wanted)

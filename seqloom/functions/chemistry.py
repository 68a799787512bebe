"""Hooks for chemistry and language-model libraries, which Spark has no functions for.

Each takes a Python function on one string and makes an Arrow UDF of it; without one, the library is imported on the
executors, and a missing library is an error there, not silently an empty column.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rdkit_bits(radius: int, bits: int) -> Callable[[str], list[int] | None]:
    def run(smiles: str):
        from rdkit import Chem
        from rdkit.Chem import rdFingerprintGenerator

        molecule = Chem.MolFromSmiles(smiles)
        if molecule is None:
            return None
        return list(rdFingerprintGenerator.GetMorganGenerator(radius=radius, fpSize=bits).GetFingerprint(molecule).GetOnBits())

    return run


def fingerprint(smiles: Column, compute: Callable[[str], list[int] | None] | None = None, radius: int = 2, bits: int = 2048) -> Column:
    """Set bits of a molecule's fingerprint; null where it can't be read."""
    one = compute or _rdkit_bits(radius, bits)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else one(x))

    return run(smiles)


def descriptors(smiles: Column, names: list[str], compute: Callable[[str], list[float] | None]) -> Column:
    """struct of named numbers; a failure gives nulls."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [compute(x) if x is not None else None for x in s]
        return pd.DataFrame([r if r is not None else [None] * len(names) for r in rows], columns=names, dtype="float64")

    return run(smiles)


GRAPH = T.StructType([T.StructField("nodes", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("edges", T.ArrayType(T.StructType([T.StructField("src", T.IntegerType()), T.StructField("dst", T.IntegerType()), T.StructField("feat", T.ArrayType(T.IntegerType()))])))])


def graph(smiles: Column, compute: Callable[[str], dict]) -> Column:
    """struct(nodes, edges) from a function that gives a dict of both."""

    @F.pandas_udf(GRAPH)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compute(x) if x is not None else {"nodes": None, "edges": None} for x in s], columns=["nodes", "edges"])

    return run(smiles)


def embedding(sequence: Column, compute: Callable[[list[str]], list[list[float]]]) -> Column:
    """Vectors from a function on a batch of strings, so that a model sees whole Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(compute([x or "" for x in s]))

    return run(sequence)

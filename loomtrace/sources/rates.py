"""Rate cards from TOML: exact decimal strings, aliases expanded to rows of their model."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, SparkSession

_DECIMAL = re.compile(r"\d{1,6}(\.\d{1,6})?")
PRICES = ("input", "cached_input", "output")


def parse(text: str) -> list[tuple]:
    """model, canonical model and prices of every model and alias; raises ValueError on anything inexact."""
    card = tomllib.loads(text)
    rows = {}
    for name, model in card.get("models", {}).items():
        for field in PRICES:
            price = model.get(field)
            if price is None and field == "cached_input":
                continue
            if not isinstance(price, str) or not _DECIMAL.fullmatch(price):
                raise ValueError(f"{name}: {field} must be a plain decimal in quotes")
        rows[name] = (name, name, *(model.get(f) for f in PRICES))
    for alias, name in card.get("aliases", {}).items():
        if alias in rows or name not in card.get("models", {}):
            raise ValueError(f"alias {alias} hides a model or names none")
        rows[alias] = (alias, *rows[name][1:])
    return sorted(rows.values())


def read_card(spark: SparkSession, text: str) -> DataFrame:
    raw = spark.createDataFrame(parse(text), "model string, canonical string, input string, cached_input string, output string")
    return raw.selectExpr("model", "canonical", *(f"cast({p} as decimal(12,6)) as {p}" for p in PRICES))

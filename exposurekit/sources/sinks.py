"""Writers. Every one writes in parallel; none gathers rows on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

# How this library writes CSV: quotes are doubled, blanks and line breaks kept, and a
# missing value (a private-use character) differs from an empty text.
CSV_TEXT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_OWN = {**CSV_TEXT, "nullValue": "\ue000", "emptyValue": ""}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(**{**CSV_OWN, "emptyValue": '""'}).csv(path)
    else:
        writer.format(fmt).save(path)


def write_records(df: DataFrame, path: str, mode: str = "error") -> None:
    """Result records: one JSON object per row, missing fields kept as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """Rationales and training examples, one JSON object per line."""
    df.write.mode(mode).json(path)

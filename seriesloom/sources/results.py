"""Result documents and window files, written and read by Spark; tables for the console."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_windows(windows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Feature windows as Parquet, or as CSV with a header."""
    w = windows.write.mode("overwrite")
    (w.option("header", True).csv if fmt == "csv" else w.parquet)(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One result document as a JSON file in the folder `path`."""
    spark.range(1).select(F.lit(json.dumps(document)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The fields of `schema` of JSON documents; other fields are ignored."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def rows(df: DataFrame, order: list[str], most: int = 10_000) -> list[dict]:
    """The rows of a small result, such as one a class; more than `most` are refused."""
    found = df.orderBy(*order).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a result document holds {most} rows of one table at most")
    return [r.asDict() for r in found]


def table_text(records: list[dict], digits: int = 3) -> str:
    """Records as aligned columns."""
    if not records:
        return "(no rows)"
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [list(records[0]), *([show(v) for v in r.values()] for r in records)]
    widths = [max(len(x[i]) for x in lines) for i in range(len(lines[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(x, widths, strict=True)).rstrip() for x in lines)


def evaluation(overall: DataFrame, classes: DataFrame, matrix: DataFrame) -> dict:
    """The evaluation document: accuracy, macro_f1, labels, dense matrix and per-class metrics."""
    per = rows(classes, ["label_idx"])
    name = next(c for c in classes.columns if c not in ("label_idx", "precision", "recall", "f1", "support"))
    dense = [[0] * len(per) for _ in per]
    for r in rows(matrix, ["true_idx", "pred_idx"], 250_000):
        dense[r["true_idx"]][r["pred_idx"]] = r["n"]
    total = overall.first()
    return {
        "accuracy": total["accuracy"], "macro_f1": total["macro_f1"], "labels": [r[name] for r in per], "confusion_matrix": dense,
        "per_class": [{"label": r[name], **{k: r[k] for k in ("precision", "recall", "f1", "support")}} for r in per],
    }

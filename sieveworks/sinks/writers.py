"""Exports of a prepared dataset and the artifact allow-list.

Writers never overwrite (``errorifexists``) and write one file per task, so
export width scales with the cluster; there is no row cap.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(df: DataFrame) -> DataFrame:
    """Nested values become JSON text (CSV cells are scalars)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_csv(df: DataFrame, path: str) -> None:
    (_flat(df).write.mode("errorifexists").option("header", True).option("escape", '"')
     .option("quoteAll", False).csv(path))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def txt_lines(df: DataFrame) -> DataFrame:
    """A single-column row is written as its value, any other row as JSON."""
    if len(df.columns) == 1:
        f = df.schema.fields[0]
        c = F.col(f.name)
        if not isinstance(f.dataType, T.StringType):
            c = F.to_json(F.struct(c)) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) \
                else c.cast("string")
        return df.select(F.coalesce(c, F.lit("None")).alias("value"))
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
                     .alias("value"))


def export_txt(df: DataFrame, path: str) -> None:
    txt_lines(df).write.mode("errorifexists").option("lineSep", "\n\n").text(path)


# Final artifact names that may leave a training run.
FINAL_ARTIFACT_NAMES = [
    "config.json", "generation_config.json", "adapter_config.json", "tokenizer.json", "tokenizer_config.json",
    "special_tokens_map.json", "added_tokens.json", "vocab.json", "merges.txt", "spiece.model",
    "sentencepiece.bpe.model", "model.safetensors", "model.safetensors.index.json", "adapter_model.safetensors",
    "pytorch_model.bin", "pytorch_model.bin.index.json", "training.json", "README.md", "metadata.json",
    "pattern_model.json", "predictor.json", "classifier.json",
]
# Name patterns of sharded weights and tokenizer files.
FINAL_ARTIFACT_PATTERNS = [r"model-.*\.safetensors", r"pytorch_model-.*\.bin", r".*\.tiktoken"]


def filter_manifest(manifest: DataFrame, relative: str = "relative") -> DataFrame:
    """Keep allowed artifact names; any path with a part starting with
    ``checkpoint`` (any case) is dropped."""
    parts = F.split(F.col(relative), "/")
    name = F.element_at(parts, -1)
    in_checkpoint = F.exists(parts, lambda p: F.lower(p).startswith("checkpoint"))
    allowed = name.isin(*FINAL_ARTIFACT_NAMES)
    for pat in FINAL_ARTIFACT_PATTERNS:
        allowed = allowed | name.rlike("^" + pat + "$")
    return manifest.filter(allowed & ~in_checkpoint)


def allowed_final_file(path: str) -> bool:
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    if any(p.lower().startswith("checkpoint") for p in parts):
        return False
    name = parts[-1] if parts else ""
    return name in FINAL_ARTIFACT_NAMES or any(re.fullmatch(p, name) for p in FINAL_ARTIFACT_PATTERNS)


def export_json_arrays(df: DataFrame, path: str) -> DataFrame:
    """One JSON array file per task (``[{...}, ...]``), streamed by the tasks
    through pyarrow's filesystem layer and named by partition, so a task that
    runs again replaces its file; returns the written file paths."""
    import pandas as pd
    from pyspark import TaskContext

    lines = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
                      .alias("j"))

    def run(batches):
        from .files import write_once

        filled = (pdf["j"] for pdf in batches if len(pdf))
        first = next(filled, None)
        if first is None:
            return

        def chunks():
            yield ("[" + ",\n".join(first)).encode("utf-8")
            for more in filled:
                yield (",\n" + ",\n".join(more)).encode("utf-8")
            yield b"]"

        target = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.json"
        write_once(target, chunks())
        yield pd.DataFrame({"path": [target]})

    return lines.mapInPandas(run, "path string")

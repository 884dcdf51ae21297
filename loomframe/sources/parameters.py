"""Parameter files: sections of a stated length and type, one `name value` a line, stars as rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {"integer": int, "real": float, "complex": complex, "logical": lambda s: s.strip(".").upper().startswith("T"), "character": str}


def parse_parameters(text: str) -> dict[str, object]:
    """Values by name; a section's kind holds until the next one, a value that doesn't fit it stays text."""
    out: dict[str, object] = {}
    kind = str
    for line in text.splitlines():
        words = line.split()
        if line.startswith("*"):
            if line.lstrip("*").startswith("length_and_type"):
                kind = _KINDS.get(words[-1].split("*")[0].lower(), str)
            continue
        if len(words) < 2:
            continue
        name, values = words[0], words[1:]
        try:
            own = [kind(v) for v in values]
        except ValueError:
            own = values
        out[name] = own[0] if len(own) == 1 else own
    return out


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value) of all files under a path, one row a name."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(f, k, str(v)) for f, t in zip(b["file"], b["value"]) for k, v in parse_parameters(t).items()]
            yield pd.DataFrame(rows, columns=["file", "name", "value"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInPandas(run, "file string, name string, value string")

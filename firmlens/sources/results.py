"""Result sinks."""

from datetime import datetime

from pyspark.sql import DataFrame

from firmlens.schemas import RESULT_BASENAME, RESULT_SCHEMA


def default_path(folder: str = ".", suffix: str = ".csv") -> str:
    stamp = datetime.now().strftime("%Y%m%d_%H%M%S")
    return f"{folder.rstrip('/')}/{RESULT_BASENAME}_{stamp}{suffix}"


def write_results(results: DataFrame, path: str | None = None, folder: str = ".") -> str:
    """Write the result columns as a folder of CSV parts, or Parquet by extension.

    Returns the path. Nothing is overwritten, and a failed write raises.
    """
    path = path or default_path(folder)
    chosen = results.select(*RESULT_SCHEMA.names)
    if path.endswith(".parquet"):
        chosen.write.parquet(path)
    else:
        chosen.write.csv(
            path,
            header=True,
            quote='"',
            escape='"',
            emptyValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    return path

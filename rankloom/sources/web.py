"""Web sources, fetched by the driver into a file that Spark then reads."""

from __future__ import annotations

import os
import shutil
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession

from rankloom.sources.shared import file_system

AGENT = "rankloom"
PART = 2**20


def hub_query(base: str, limit: int = 300, task: str = "text-generation") -> str:
    """The address under which the source itself filters by task, sorts by downloads and gives the first `limit`."""
    return base + "?" + urllib.parse.urlencode({"sort": "downloads", "direction": -1, "limit": limit, "filter": task})


def _opened(url: str, headers: dict[str, str] | None, timeout: float):
    return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT, **(headers or {})}), timeout=timeout)


def fetched_text(url: str, headers: dict[str, str] | None = None, timeout: float = 30) -> str:
    """The answer's text. Anything but success raises."""
    with _opened(url, headers, timeout) as answer:
        return answer.read().decode("utf-8")


def download(url: str, path: str, headers: dict[str, str] | None = None, timeout: float = 30, spark: SparkSession | None = None) -> str:
    """Writes the answer to path, whole or not at all, and gives path back.

    It is passed on piece by piece, whatever its size. With a session it goes to the file system that
    the executors read from (Hadoop's), else to a file of this machine.
    """
    with _opened(url, headers, timeout) as answer:
        if spark is None:
            with open(f"{path}.part", "wb") as f:
                shutil.copyfileobj(answer, f, PART)
            os.replace(f"{path}.part", path)
            return path
        pieces: Iterator[bytes] = iter(lambda: answer.read(PART), b"")
        fs, part = file_system(spark, f"{path}.part")
        out = fs.create(part, True)
        try:
            for piece in pieces:
                out.write(bytearray(piece))
        finally:
            out.close()
        _, whole = file_system(spark, path)
        fs.delete(whole, True)
        if not fs.rename(part, whole):
            raise OSError(f"cannot rename {path}.part")
    return path

"""Settings of extraction, the log, and what is written down while debugging."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators import ingest


@dataclass(frozen=True)
class ExtractorSettings:
    """``max_context``: characters of a text that go to the extractor at once. ``merge_actions``: inverse actions and facets are merged."""

    max_context: int = 2048
    merge_actions: bool = True

    def merged(self, knowledge: DataFrame, inverse: str = "inverse_actions") -> DataFrame:
        """Extracted knowledge as these settings want it."""
        if not self.merge_actions:
            return knowledge
        if inverse in knowledge.columns:
            knowledge = ingest.merge_inverse(knowledge, inverse)
        return ingest.merge_facets(knowledge)

    def pieces(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """``texts`` with a row for each piece of at most ``max_context`` characters and its place; nothing is cut away."""
        starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(self.max_context))
        cut = texts.select("*", F.posexplode(F.transform(starts, lambda a: F.substring(F.col(text), a + 1, F.lit(self.max_context)))).alias("piece", "piece_text"))
        return cut


class Log(Protocol):
    def __call__(self, message: str) -> None: ...


class Debug:
    """Off unless switched on: then messages go to the log, and prompts are written to a folder."""

    def __init__(self, on: bool = False, folder: str | None = None, log: Log = logging.getLogger("palaver").info):
        self.on, self.folder, self.log = on, folder, log

    def say(self, message: str) -> None:
        if self.on:
            self.log(message)

    def prompt(self, text: str, name: str = "prompt") -> str | None:
        """Write a prompt down; the file's path."""
        if not self.on or self.folder is None:
            return None
        path = Path(self.folder) / f"{name}-{uuid.uuid4().hex}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return str(path)

"""A log of the model's replies, a file each, so that no call is paid for twice.

A reply is kept under the digest of what was asked: the row's keys, the attempt and
the prompt. The task that has made a call writes its reply before it makes the next
one: under another name first, then renamed, so that a file is whole or not there. A
run looks all digests up by a join before it asks; a task that runs again looks at the
file itself. Files are written from Python, by any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.storage import exists

REPLY = "digest string, content string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"


def digest(keys: Sequence[str], attempt: int = 0, salt: str = "") -> Column:
    """What a reply is kept under. salt: another one asks anew."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, "system", "user")]
    return F.sha2(F.concat_ws(chr(0), F.lit(salt), F.lit(str(attempt)), *parts), 256)


class Ledger:
    """A task's side. path: a folder, as a URI or a local path."""

    def __init__(self, path: str) -> None:
        if "://" in path or path.startswith("file:"):
            self.fs, self.path = arrow_fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        else:
            self.fs, self.path = arrow_fs.LocalFileSystem(), path

    def file(self, key: str) -> str:
        return f"{self.path}/{key[:2]}/{key}.json"

    def find(self, key: str) -> tuple[str, dict[str, int]] | None:
        if self.fs.get_file_info(self.file(key)).type != arrow_fs.FileType.File:
            return None
        with self.fs.open_input_stream(self.file(key)) as f:
            got = json.loads(f.read())
        return got.pop("content"), {k: v for k, v in got.items() if k != "digest"}

    def keep(self, key: str, content: str, usage: dict[str, int]) -> None:
        part = f"{self.path}/.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.path}/{key[:2]}", recursive=True)
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps({"digest": key, "content": content} | usage, ensure_ascii=False).encode("utf-8", "replace"))
        self.fs.move(part, self.file(key))


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    """All replies that are kept."""
    return spark.read.schema(REPLY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).dropDuplicates(["digest"]) if exists(spark, path) else None

"""Small JSON documents that name the files of a table: ``<path>/_manifest/<n>.json``, the highest one is current.

A document appears by a rename once it is whole, so a reader never sees a part of one, and data files that no document
names do not exist for it. A path has one writer, see ``versions.claim``.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from wrenchline.sources.versions import filesystem

FOLDER = "_manifest"


def numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = filesystem(spark, f"{path}/{FOLDER}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def read_manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict] | None:
    """(number, document) of the current or of a given manifest; None when there is none."""
    if number is None:
        known = numbers(spark, path)
        if not known:
            return None
        number = known[-1]
    fs, file = filesystem(spark, f"{path}/{FOLDER}/{number}.json")
    stream = fs.open(file)
    try:
        return number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_manifest(spark: SparkSession, path: str, number: int, document: dict) -> None:
    """Make ``document`` the current manifest, which needs a number above all others."""
    known = numbers(spark, path)
    if known and known[-1] >= number:
        raise ValueError(f"{path} is at {known[-1]} already, not below {number}")
    fs, whole = filesystem(spark, f"{path}/{FOLDER}/{number}.json")
    _, part = filesystem(spark, f"{path}/{FOLDER}/_{number}.part")
    made = fs.create(part, True)
    try:
        spark._jvm.org.apache.commons.io.IOUtils.write(json.dumps(document), made, "UTF-8")
    finally:
        made.close()
    if not fs.rename(part, whole):
        raise OSError(f"cannot commit {whole}")


def is_committed(spark: SparkSession, path: str, number: int) -> bool:
    """Whether the manifest of a repeated micro-batch is there; a newer one belongs to another history."""
    known = numbers(spark, path)
    if known and known[-1] > number:
        raise ValueError(f"{path} is at {known[-1]}, beyond {number}: it belongs to another checkpoint")
    return bool(known) and known[-1] == number


def forget(spark: SparkSession, path: str, keep: int) -> list[dict]:
    """Remove all but the newest ``keep`` manifests; returns the documents that stay."""
    known = numbers(spark, path)
    for number in known[:-keep]:
        fs, file = filesystem(spark, f"{path}/{FOLDER}/{number}.json")
        fs.delete(file, False)
    return [read_manifest(spark, path, number)[1] for number in known[-keep:]]


def remove_others(spark: SparkSession, folder: str, named: set[str]) -> None:
    """Remove the folders below ``folder`` that are not named."""
    fs, root = filesystem(spark, folder)
    if not fs.exists(root):
        return
    for status in fs.listStatus(root):
        if status.isDirectory() and status.getPath().getName() not in named:
            fs.delete(status.getPath(), True)

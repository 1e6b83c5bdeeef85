"""A log of numbered manifests next to a dataset: what readers see changes by a new manifest, never in place.

A manifest is a small JSON file ``commits/<number>``, created without overwriting. Readers take the highest complete one; a
file that a crash left half written is no JSON and is passed over. A writer that finds a higher manifest which does not
descend from its own has been overtaken while writing, and makes its change again on top of that one. Changes are made by
functions of the current entry that may be applied twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "commits"
Entry = dict


def _folder(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{FOLDER}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, target: str) -> list[int]:
    """Numbers taken, complete or not, highest first."""
    fs, folder = _folder(spark, target)
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted((int(name) for name in names if name.isdigit()), reverse=True)


def _read(spark: SparkSession, target: str, number: int) -> Entry | None:
    fs, folder = _folder(spark, target)
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, _name(number)))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and found.get("number") == number else None


def _name(number: int) -> str:
    return f"{number:020d}"


def history(spark: SparkSession, target: str) -> list[Entry]:
    """Complete manifests, newest first."""
    found = (_read(spark, target, number) for number in _numbers(spark, target))
    return [entry for entry in found if entry is not None]


def latest(spark: SparkSession, target: str) -> Entry | None:
    for number in _numbers(spark, target):
        entry = _read(spark, target, number)
        if entry is not None:
            return entry
    return None


def _create(spark: SparkSession, target: str, entry: Entry) -> bool:
    """Write a manifest under its number; false if the number is taken."""
    fs, folder = _folder(spark, target)
    try:
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, _name(entry["number"])), False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    out.close()
    return True


def append(spark: SparkSession, target: str, change: Callable[[Entry], Entry]) -> Entry:
    """Commit ``change`` of the current entry ({} at first) and return what readers see from then on."""
    while True:
        before = latest(spark, target) or {"number": 0}
        taken = _numbers(spark, target)
        number = (taken[0] if taken else 0) + 1
        body = change({k: v for k, v in before.items() if k not in ("number", "previous")})
        entry = {**body, "number": number, "previous": before["number"]}
        if not _create(spark, target, entry):
            continue
        if _descends(history(spark, target), number):
            return entry


def _descends(entries: list[Entry], number: int) -> bool:
    """Whether the highest manifest is this one or was made on top of it."""
    by_number = {e["number"]: e for e in entries}
    at = entries[0]
    while at["number"] > number and at["previous"] in by_number:
        at = by_number[at["previous"]]
    return at["number"] == number

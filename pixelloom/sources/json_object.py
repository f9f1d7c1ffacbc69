"""One JSON object of any size, from keys to records, read in byte ranges and written in order.

A reader that begins in the middle of a file doesn't know whether it stands inside
a string, nor how deep. So a first pass runs the automaton of strings and depth over
every range under both beginnings, and gives three numbers: whether strings
toggle, and by how much the depth changes if the range begins outside or
inside a string. Put together in order, a row per range, they tell where each
range really begins. In the second pass a range owns the entries whose preceding brace or
comma at the top level lies in it, and reads on behind its end for the rest of the last one.

Ranges never begin behind a backslash, so that no range begins with an escaped character.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import exists, opened

#: Bytes of a range, bytes that are looked at together, and bytes of ranges beside each other that make a task at most.
SPLIT, PIECE, TASK = 64 << 20, 1 << 20, 16 << 20
_QUOTE, _BACKSLASH, _COMMA = b'"'[0], b"\\"[0], b","[0]


def _pieces(file, at: int, end: int, own: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(position, bytes) from ``at`` to ``end`` in pieces of which none ends with a backslash, but for the last.

    Up to ``own`` they are as large as they may be; behind it, where little may be needed, they begin with 4 KB and double.
    """
    file.seek(at)
    held, behind = b"", 2 << 10
    while at + len(held) < end:
        here = at + len(held)
        if own is None or here < own:
            size = (end if own is None else min(own, end)) - here
        else:
            size = behind = behind * 2
        more = file.read(min(PIECE, size, end - here))
        if not more:
            break
        held += more
        if held.endswith(b"\\") and at + len(held) < end:
            continue
        yield at, np.frombuffer(held, np.uint8)
        at, held = at + len(held), b""
    if held:
        yield at, np.frombuffer(held, np.uint8)


def begin_of(file, at: int, size: int) -> int:
    """The first place from ``at`` on that isn't behind a backslash."""
    while 0 < at < size:
        file.seek(at - 1)
        window = file.read(256)
        behind = len(window) - len(window.lstrip(b"\\"))
        if not behind:
            return at
        at += behind
        if behind < len(window):
            return at
    return min(at, size)


def _outside(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Which bytes are outside strings, and whether a string is open at the end."""
    where = np.arange(len(data))
    run = where - np.maximum.accumulate(np.where(data != _BACKSLASH, where, -1))
    escaped = np.zeros(len(data), bool)
    escaped[1:] = run[:-1] % 2 == 1
    quotes = np.cumsum((data == _QUOTE) & ~escaped)
    return ((quotes + inside) & 1) == 0, bool((quotes[-1] + inside) & 1) if len(data) else inside


def _steps(data: np.ndarray) -> np.ndarray:
    """+1 at opening brackets, -1 at closing ones."""
    return np.isin(data, np.frombuffer(b"{[", np.uint8)).astype(np.int64) - np.isin(data, np.frombuffer(b"}]", np.uint8))


def summary(file, at: int, end: int) -> tuple[bool, int, int]:
    """Whether strings toggle from ``at`` to ``end``; the change of depth if ``at`` is outside a string, and if it is inside."""
    inside, out, within = False, 0, 0
    for _, data in _pieces(file, at, end):
        outside, inside = _outside(data, inside)
        steps = _steps(data)
        out, within = out + int(steps[outside].sum()), within + int(steps[~outside].sum())
    return inside, out, within


def entries_of(file, at: int, end: int, size: int, inside: bool, depth: int) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of the entries whose preceding brace or comma lies from ``at`` to ``end``."""
    start, held = None, []
    for place, data in _pieces(file, at, size, end):
        if start is None and place >= end:
            return
        outside, inside = _outside(data, inside)
        steps = np.where(outside, _steps(data), 0)
        after = depth + np.cumsum(steps)
        marks = outside & (((data == _COMMA) & (after == 1)) | ((steps == 1) & (after == 1)) | ((steps == -1) & (after == 0)))
        depth = int(after[-1])
        begin = 0
        for k in np.flatnonzero(marks).tolist():
            if start is not None:
                held.append(data[begin:k].tobytes())
                yield start, b"".join(held)
                start, held = None, []
            if place + k >= end or steps[k] == -1:
                if place + k >= end:
                    return
                continue
            start, begin = place + k + 1, k + 1
        if start is not None:
            held.append(data[begin:].tobytes())


def _parted(entry: bytes) -> tuple[str, str] | None:
    text = entry.decode().strip()
    if not text:
        return None
    key, end = json.JSONDecoder().raw_decode(text)
    return key, text[end:].lstrip().removeprefix(":").strip()


def read_object(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """key, value (JSON as it stands there) and place (its byte) of every entry of the object in ``path``."""
    system, name = opened(path)
    size = system.get_file_info(name).size
    if size is None:
        raise FileNotFoundError(path)
    n = max(1, -(-size // split))
    # Tasks have several small ranges; there are some for each core, as long as there are ranges.
    tasks = min(n, 10_000, max(4 * spark.sparkContext.defaultParallelism, -(-size // TASK)))
    ranges = spark.range(n, numPartitions=tasks).select("id")

    def bounds(file, k: int) -> tuple[int, int]:
        return begin_of(file, k * split, size), begin_of(file, min(size, (k + 1) * split), size)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = opened(path)
        with system.open_input_file(name) as file:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [summary(file, *bounds(file, k)) for k in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[c] for f in found], t) for c, t in enumerate((pa.bool_(), pa.int64(), pa.int64()))]], ["id", "toggles", "out", "within"])

    inside, depth, begins = False, 0, []
    for row in sorted(ranges.mapInArrow(look, "id long, toggles boolean, out long, within long").collect()):
        begins.append((row.id, inside, depth))
        depth += row.within if inside else row.out
        inside ^= row.toggles
    if inside or depth:
        raise ValueError(f"{path} isn't one whole JSON object")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = opened(path)
        with system.open_input_file(name) as file:
            for batch in batches:
                for row in batch.to_pylist():
                    at, end = bounds(file, row["id"])
                    rows, weight = [], 0
                    for place, entry in entries_of(file, at, end, size, row["inside"], row["depth"]):
                        if (parted := _parted(entry)) is not None:
                            rows.append((*parted, place))
                            weight += len(entry)
                        if weight >= 4 * PIECE:
                            yield _batch(rows)
                            rows, weight = [], 0
                    yield _batch(rows)

    known = spark.createDataFrame(begins, "id long, inside boolean, depth long")
    return known.repartitionByRange(tasks, "id").mapInArrow(read, "key string, value string, place long")


def _batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["key", "value", "place"])


def write_object(entries: DataFrame, path: str, order: str = "place") -> None:
    """Write ``entries`` (key, value as JSON, and ``order``) as one object in their order.

    Ranges of the order are written as texts by all tasks. A single file has a
    single writer, so these are then streamed behind each other, a bounded buffer at a time,
    under a temporary name that is renamed at the end.
    """
    quoted = F.to_json(F.struct(F.col("key").alias("k")))
    line = F.concat(quoted.substr(F.lit(6), F.length(quoted) - 6), F.lit(": "), F.col("value"))
    system, name = opened(path)
    parts = f"{name}.parts"
    address = path.rstrip("/") + ".parts"
    entries.repartitionByRange(order).sortWithinPartitions(order).select(line.alias("value")).write.mode("overwrite").option("lineSep", ",\n").text(address)
    files = sorted(x.path for x in system.get_file_info(fs.FileSelector(parts)) if x.base_name.startswith("part-") and x.size)
    with system.open_output_stream(f"{name}.tmp") as out:
        out.write(b"{\n")
        for k, part in enumerate(files):
            left = system.get_file_info(part).size - (2 if k == len(files) - 1 else 0)
            with system.open_input_stream(part) as source:
                while left > 0 and (data := source.read(min(PIECE, left))):
                    out.write(data)
                    left -= len(data)
        out.write(b"\n}\n")
    system.move(f"{name}.tmp", name)
    if exists(system, parts):
        system.delete_dir(parts)


def cleaned(entries: DataFrame) -> DataFrame:
    """``entries`` with clean tags and captions inside their records; empty ones, and all other fields, stay as they are."""
    from ..functions.text import clean_caption, clean_tags

    record = F.from_json("value", "map<string, variant>")

    def rewritten(k, v):
        text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        new = F.when(k == "tags", clean_tags(text)).when(k == "caption", clean_caption(text))
        return F.when(k.isin("tags", "caption") & (F.coalesce(text, F.lit("")) != ""), new.cast("variant")).otherwise(v)

    return entries.withColumn("value", F.to_json(F.transform_values(record, rewritten)))

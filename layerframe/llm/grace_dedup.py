"""Exact deduplication by recursive hash partitioning.

1. Each task folds its own rows into an open-addressing table that compares
   complete contents, so a text that fills a third of the corpus leaves a task
   as a few rows.  The folded rows are written to the shared folder.
2. They are dealt out by a hash of their content.  A task writes its share to
   spill files by further bits of the hash and splits a file again until it
   fits the memory bound; then an open-addressing table over the complete
   contents finds the row that stays and the number of equal ones.
3. The verdict on each folded row goes back to the ids it stands for.  The key
   of that join is one per folded row, so it has no hot value.

The memory of a task is bounded by ``table_bytes``; a single content with more
folded rows than that is streamed past its one table entry.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerframe.llm.common import ids_and_texts, store

#: Bytes of content that one table holds at a time.
TABLE_BYTES = 48 << 20
#: Ids that one folded row stands for at most; more make another row.
MOST_IDS = 65_536
FAN_OUT = 16

TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

FOLDED = "home long, slot long, hash long, sha string, largest long, ids array<long>, content binary"
JUDGED = "home long, slot long, keep_id long, group_size long"
NO_ID = -(1 << 63)


def normal_form(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(TO_LOWER)


class OpenTable:
    """Open addressing with linear probing; a hit needs the complete content."""

    def __init__(self, slots: int = 1024):
        self.slots: list[int] = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list = []
        self.bytes = 0

    def place(self, hashed: int, content: bytes) -> tuple[int, bool]:
        """The entry of this content, and whether it is new."""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = hashed & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == hashed and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.values.append(None)
        self.bytes += len(content) + 200
        return self.slots[at], True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def hash_of(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content)


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def fold_rows(
    rows: Iterator[tuple[int | None, str]], home: int, table_bytes: int = TABLE_BYTES, most_ids: int = MOST_IDS
) -> Iterator[tuple]:
    """Equal texts of one task as one row each (several if the table fills up)."""
    slot, table = 0, OpenTable()

    def emptied() -> Iterator[tuple]:
        nonlocal slot
        for hashed, content, ids in zip(table.hashes, table.contents, table.values, strict=True):
            if ids:
                yield _folded(home, slot, hashed, content, ids)
                slot += 1

    for key, text in rows:
        content = normal_form(text)
        entry, new = table.place(hash_of(content), content)
        if new:
            table.values[entry] = []
        ids = table.values[entry]
        ids.append(key)
        if len(ids) >= most_ids:
            yield _folded(home, slot, table.hashes[entry], content, ids)
            slot += 1
            table.values[entry] = []
        if table.bytes > table_bytes:
            yield from emptied()
            table = OpenTable()
    yield from emptied()


def _folded(home: int, slot: int, hashed: int, content: bytes, ids: list) -> tuple:
    known = [i for i in ids if i is not None]
    largest = max(known) if known else NO_ID
    return home, slot, signed(hashed), hashlib.sha256(content).hexdigest(), largest, list(ids), content


def grace(
    rows: Iterator[tuple[int, int, int, int, int, bytes]],
    table_bytes: int = TABLE_BYTES,
    bits: int = 0,
    folder: str | None = None,
) -> Iterator[tuple[int, int, int, int]]:
    """(home, slot, keep, size) for rows of (home, slot, hash, largest, count, content).

    Rows are spilled by four bits of the hash, from the top; a file that is
    larger than the bound is dealt again by the next bits.
    """
    root = folder or tempfile.mkdtemp(prefix="grace-")
    try:
        for path, size in _spill(rows, bits, root):
            if size > table_bytes and bits + 4 < 64 and _splits(path, bits + 4):
                yield from grace(_read(path), table_bytes, bits + 4, tempfile.mkdtemp(dir=root))
            else:
                yield from _judge(path)
            os.unlink(path)
    finally:
        shutil.rmtree(root, ignore_errors=True)


def _spill(rows: Iterator[tuple], bits: int, root: str) -> list[tuple[str, int]]:
    files: dict[int, tuple] = {}
    sizes: dict[int, int] = {}
    try:
        for row in rows:
            part = ((row[2] & ((1 << 64) - 1)) >> (60 - bits)) % FAN_OUT
            if part not in files:
                files[part] = open(os.path.join(root, f"{part:02d}"), "wb")  # noqa: SIM115
            pickle.dump(row, files[part], protocol=5)
            sizes[part] = sizes.get(part, 0) + len(row[5]) + 200
    finally:
        for file in files.values():
            file.close()
    return [(os.path.join(root, f"{part:02d}"), sizes[part]) for part in sorted(files)]


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _splits(path: str, bits: int) -> bool:
    """Do the rows differ in the bits that are left?"""
    rows = _read(path)
    first = next(rows)[2] & ((1 << (64 - bits)) - 1)
    return any(row[2] & ((1 << (64 - bits)) - 1) != first for row in rows)


def _judge(path: str) -> Iterator[tuple[int, int, int, int]]:
    table = OpenTable()
    for _, _, hashed, largest, count, content in _read(path):
        entry, new = table.place(hashed & ((1 << 64) - 1), content)
        keep, size = table.values[entry] or (NO_ID, 0)
        table.values[entry] = (max(keep, largest), size + count)
    for home, slot, hashed, _, _, content in _read(path):
        entry, _ = table.place(hashed & ((1 << 64) - 1), content)
        yield home, slot, *table.values[entry]


def _batched(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Record batches of about 8 MB."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total > 8 << 20 or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


FOLDED_ARROW = pa.schema(
    [
        ("home", pa.int64()),
        ("slot", pa.int64()),
        ("hash", pa.int64()),
        ("sha", pa.string()),
        ("largest", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("content", pa.binary()),
    ]
)
JUDGED_ARROW = pa.schema([(name, pa.int64()) for name in ("home", "slot", "keep_id", "group_size")])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    def rows() -> Iterator[tuple[int | None, str]]:
        for batch in batches:
            for key, text in zip(batch[0], batch[1], strict=True):
                yield key.as_py(), text.as_py()

    home = TaskContext.get().partitionId()
    yield from _batched(fold_rows(rows(), home), FOLDED_ARROW, lambda r: len(r[6]) + 8 * len(r[5]) + 200)


def _grace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                yield tuple(x.as_py() for x in row)

    yield from _batched(grace(rows()), JUDGED_ARROW, lambda r: 32)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z only.

    One row per input row: doc_id, keep_id (the group's largest id), group_size
    (rows in the group), kept, text_sha256 of the normalised UTF-8 text.  A null
    text counts as empty, and empty texts form a group.  A repeated id with the
    same text counts as often as it occurs, and all its rows are kept if it is
    the largest.  A null id is never kept, unless its group has no other ids:
    then keep_id is null and ``kept`` is true.  Other columns are not read.
    """
    folded = store(ids_and_texts(df, id_col, text_col).mapInArrow(_fold, FOLDED), "exact-folded")
    judged = (
        folded.select("home", "slot", "hash", "largest", F.size("ids").cast("long").alias("n"), "content")
        .repartition("hash")
        .mapInArrow(_grace, JUDGED)
    )
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return (
        folded.select("home", "slot", "sha", "ids")
        .join(judged, ["home", "slot"])
        .select(F.explode("ids").alias("doc_id"), keep.alias("keep_id"), "group_size", F.col("sha").alias("text_sha256"))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )

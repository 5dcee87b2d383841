"""Best-fit packing planned over a histogram of lengths.

Documents become token ids and, where longer than a sequence, pieces.  Only the
number of pieces of each length reaches the driver: at most as many rows as a
sequence has tokens.  Best fit in falling order of length runs over those counts
and not over documents: sequences filled alike are one range of numbers, and a
length is placed on a whole range at a time.  The plan is a list of slots, runs
of equal pieces on a range of sequences.  Pieces are numbered within their
length in two levels and join the plan on that rank.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerframe.llm.bpe import byte_symbols
from layerframe.llm.common import store

CAPACITY, END = 4096, 1
#: Pieces of one length that are numbered together, and ranks that look up the plan together.
PART, CHUNK = 1024, 256
#: Texts whose ids are held at a time; characters of the longest word that is remembered; words remembered.
ROWS, LONGEST, WORDS = 512, 64, 500_000
#: Words that normal form leaves alone.
PLAIN = re.compile("[!-~\u00c0-\u00ff]+")
PIECES = "doc_id long, piece int, start long, length long, ids binary"
SLOTS = "length long, first long, bins long, each long, bin long, offset long"


class WordEncoder(dict):
    """Ids of words between ASCII white space, encoded by the library when first met.

    The vocabulary's own normaliser and splitter never look across white space,
    so the ids of a text are those of its words one after the other.  A word of
    plain letters, digits and signs is lower-cased and split here, where that is
    all the vocabulary does to it, and only its parts go to the library's model;
    any other word goes to the library whole.  Both tables are emptied at
    ``WORDS`` entries.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.split = split_of(json.loads(model))
        self.symbols = {b: c for c, b in byte_symbols().items()}

    def part(self, part: str) -> bytes:
        """Ids of a word of the splitter's."""
        found = self.parts.get(part)
        if found is None:
            symbols = part if part.isascii() else "".join(map(self.symbols.__getitem__, part.encode()))
            found = self.parts[part] = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.split and text.isascii() and text.isalpha():
            packed = self.part(text.lower())
        elif self.split and PLAIN.fullmatch(text) and "<|" not in text:
            packed = b"".join(map(self.part, self.split.findall(text.lower())))
        else:
            packed = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST:
            self[word] = packed
        return packed

    def encode(self, text: bytes) -> bytes:
        """Ids of a text, four little-endian bytes each."""
        for table in (self, self.parts):
            if len(table) > WORDS:
                table.clear()
        # fewer different words where case is lost anyway; names of special tokens keep theirs
        words = text.lower() if self.split and b"<|" not in text else text
        return b"".join(map(self.__getitem__, words.split()))


def split_of(spec: dict) -> regex.Pattern | None:
    """The vocabulary's splitter, if lower-casing and splitting are all that is done to a plain word."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"}
    if not plain or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or spec.get("post_processor"):
        return None
    names = [x["content"] for x in spec.get("added_tokens", [])]
    if not all(n.startswith("<|") for n in names) or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
        return None
    if cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or "Regex" not in cuts[0]["pattern"]:
        return None
    return regex.compile(cuts[0]["pattern"]["Regex"])


_encoders: dict[str, WordEncoder] = {}


def encoder_of(model: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(model)
    return _encoders[key]


def encode_pieces(
    df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """doc_id, piece, start, length, ids of every whole text and the ``end`` token behind it.

    ``model`` is the content of a tokenizer file, broadcast once.  A document of
    more than ``capacity`` ids is cut into pieces of that many; only its last one
    may be shorter.  Null and empty texts hold the end token alone; repeated rows
    give repeated pieces; a null id stays null; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    last, size = end.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                part = batch.slice(begin, ROWS)
                keys, numbers, starts, ids = [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    whole = encoder.encode(text.as_py()) + last
                    for at in range(0, len(whole), size):
                        keys.append(key)
                        numbers.append(at // size)
                        starts.append(at // 4)
                        ids.append(whole[at : at + size])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, PIECES)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first, bins, each, bin, offset) and the number of sequences.

    The pieces of ``length`` ranked ``first`` and on lie ``each`` to a sequence,
    from ``offset`` on, in ``bins`` sequences from number ``bin`` on.  Each length
    splits one range of sequences in three at most, and a sequence holds less
    than the root of twice its capacity of different lengths, so the plan's size
    follows the capacity and not the documents.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened = 0

    def keep(left: int, bin_: int, bins: int) -> None:
        if left and bins:
            if left not in free:
                free[left] = []
                insort(sizes, left)
            free[left].append((bin_, bins))

    def place(length: int, first: int, count: int, left: int, bin_: int, bins: int) -> int:
        """Fills a range of sequences that have ``left`` tokens free; how many pieces it took."""
        each = left // length
        full = min(bins, count // each)
        if full:
            slots.append((length, first, full, each, bin_, capacity - left))
            keep(left - each * length, bin_, full)
        taken, over = full * each, 0
        if taken < count and full < bins:
            over = count - taken
            slots.append((length, first + taken, 1, over, bin_ + full, capacity - left))
            keep(left - over * length, bin_ + full, 1)
        keep(left, bin_ + full + (over > 0), bins - full - (over > 0))
        return taken + over

    for length in sorted(counts, reverse=True):
        first, count = 0, counts[length]
        # the tightest sequences first; what stays free in one is less than the length
        for left in sizes[bisect_left(sizes, length) :]:
            if first == count:
                break
            ranges, free[left] = free[left], []
            for i, (bin_, bins) in enumerate(ranges):
                if first == count:
                    free[left].extend(ranges[i:])
                    break
                first += place(length, first, count - first, left, bin_, bins)
            if not free[left]:
                del free[left]
                sizes.remove(left)
        if first < count:
            new = -(-(count - first) // (capacity // length))
            place(length, first, count - first, capacity, opened, new)
            opened += new
    return slots, opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Every piece gets a place, gapless from 0 in its sequence.  Columns of the
    same names are replaced; all others are kept.  An empty table stays empty.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    stored = store(pieces.select(*kept, F.monotonically_increasing_id().alias("_row")), "pieces")
    # one row per length: as many as a sequence has tokens, whatever the documents
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan_slots(counts, capacity)
    # a length with many pieces is numbered in several parts
    parts = spark.createDataFrame([(k, -(-n // PART)) for k, n in counts.items()], "length long, _parts long")
    dealt = stored.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")))
    held = dealt.groupBy("length", "_part").agg(F.count("*").alias("_held"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "_part", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_part").orderBy("_row")
    ranked = (
        dealt.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_part"])
        .withColumn("_rank", F.col("_start") + F.col("_at"))
        .withColumn("_chunk", F.expr(f"_rank div {CHUNK}"))
    )
    plan = spark.createDataFrame(slots, SLOTS).withColumn("until", F.expr("first + bins * each"))
    spread = plan.withColumn("_chunk", F.explode(F.sequence(F.expr(f"first div {CHUNK}"), F.expr(f"(until - 1) div {CHUNK}"))))
    by_chunk = spread.groupBy("length", "_chunk").agg(F.collect_list(F.struct("first", "until", "each", "bin", "offset")).alias("_slots"))
    mine = F.filter("_slots", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["until"]))[0]
    met = ranked.join(by_chunk, ["length", "_chunk"]).withColumn("_slot", mine)
    return met.select(
        *kept,
        F.expr("_slot.bin + (_rank - _slot.first) div _slot.each").alias("sequence_id"),
        F.expr("_slot.offset + (_rank - _slot.first) % _slot.each * length").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed ids themselves, from pieces that carry theirs."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))

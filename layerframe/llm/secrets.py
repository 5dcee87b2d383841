"""Secret scan: keyword automaton, anchored patterns at its hits, checksums.

An Aho-Corasick automaton over the lower-cased text (A-Z only, so offsets stay)
finds the keywords every pattern must start with; a pattern is tried only where
one of its keywords begins.  Runs of hexadecimal digits have no keyword, so they
are the one kind whose pattern runs over the whole text.  Formats that carry a
checksum are reported only when it holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from layerframe.llm.common import ids_and_texts, sha256_hex

#: The kinds in the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex", "checked")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A three-letter family, 30 random characters, and six that hold their CRC-32.
CHECKED = re.compile(r"(?:gh[opsur]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS_WORDS = ("akia",)
CHECKED_WORDS = ("gho_", "ghp_", "ghs_", "ghu_", "ghr_", "npm_")
LEAST_VALUE, LEAST_ACCESS = 12, 18

DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, "
    "base_sha256 string, spans string, n_checked long"
)


def base62(number: int, width: int = 6) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = DIGITS62[digit] + out
    return out.rjust(width, "0")


def checksum_holds(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode("ascii"))) == check


def keyword_automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, words in (
        ("assign", ASSIGN_WORDS),
        ("access", ACCESS_WORDS),
        ("checked", CHECKED_WORDS),
    ):
        for word in words:
            machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def scan(text: str, machine) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span of one text, sorted."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    starts: dict[str, list[int]] = {"assign": [], "access": [], "checked": []}
    for last, (kind, length) in machine.iter(lowered):
        starts[kind].append(last - length + 1)
    found: list[tuple[int, int, int]] = []

    def anchored(kind: str, pattern: re.Pattern, keep) -> None:
        free = 0
        for start in sorted(starts[kind]):
            if start >= free and (hit := pattern.match(text, start)):
                free = hit.end()
                if keep(hit):
                    found.append((start, KINDS.index(kind), free))

    anchored("assign", ASSIGN, lambda m: len(m[2]) >= LEAST_VALUE)
    anchored("access", ACCESS, lambda m: len(m[0]) >= LEAST_ACCESS)
    anchored("checked", CHECKED, lambda m: checksum_holds(m[1], m[2]))
    found += ((m.start(), 2, m.end()) for m in HEX.finditer(text))
    return sorted(found)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every text, one row per input row.

    A null or empty text has no span (counts 0, empty ``spans``); repeated rows
    give repeated results; a null id is kept as null.  Other columns are not
    read.  The work is row-local: no shuffle, memory of one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = keyword_automaton()
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for key, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                spans = scan(text.as_py(), machine)
                base = [s for s in spans if s[1] < len(BASE_KINDS)]
                counts = [sum(s[1] == k for s in spans) for k in range(len(KINDS))]
                row = (key, *counts[:3], sha256_hex(digest(base).encode()), digest(spans), counts[3])
                for name, value in zip(names, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names])
    return ids_and_texts(df, id_col, text_col).mapInArrow(run, SCHEMA)

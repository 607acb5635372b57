"""Token counts by offset-mapped attribution.

The fields of a row are rendered into one document and the whole document is
encoded once.  A byte-level vocabulary gives every token its exact byte
length, so the cumulated lengths are the tokens' spans; spans are joined to
the spans of the fields, or of the lines of a field, as an interval join on
the sorted bounds.  A token that crosses a boundary goes where ``rule``
says: ``start`` (the section with its first byte), ``end`` (its last byte) or
``most`` (the section with most of its bytes, ties to the earlier one), so
the sections' counts add up to the document's.

Sections tile the document: a field or line ends before the next begins, and
a separator or line break belongs to the section it closes.  Empty sections
hold no bytes and get no tokens.

Defined results: a null field is an empty section; a document without bytes
has no tokens; texts are encoded whole, whatever their length (a very long run of
blanks goes to the merge directly, cut where the pattern cuts it); strings that
look like special tokens are ordinary text; repeated rows are counted each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palletwise.llm import _text
from palletwise.session import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pre-tokenisation pattern published with this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 16 << 20
RULES = ("start", "end", "most")
LONG_RUN = 10_000  # blanks in a row from which on the pattern is not asked
# fixed value: the characters with the property White_Space
BLANK = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def load_ranks(spark: SparkSession, path: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary file (token in base64, rank), read through Spark; its
    size is checked because it is sent to every task."""
    row = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if row is None or row["length"] > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary missing or over {MAX_VOCABULARY_BYTES} bytes: {path}")
    pairs = (line.split() for line in bytes(row["content"]).splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


_ENCODERS: dict = {}


def encoder(name: str, ranks: dict[bytes, int], pattern: str = PATTERN):
    """(encoding, byte length of each rank), built once per worker."""
    if name not in _ENCODERS:
        import tiktoken

        length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length
    return _ENCODERS[name]


def encode(enc, text: str, long_run: int = LONG_RUN) -> np.ndarray:
    """The token ids of a text.  The pattern steps back through a run of
    blanks blank by blank, on a stack that a run of a million overflows; its
    outcome is known: all blanks but the last are one piece, or all of them
    at the end of the text."""
    ids, at = [], 0
    for run in re.finditer(f"{BLANK}{{{long_run},}}", text):
        end = run.end() - (run.end() < len(text))
        ids += [enc.encode_to_numpy(text[at : run.start()], disallowed_special=()),
                np.asarray(enc._encode_single_piece(text[run.start() : end].encode()), dtype=np.int64)]
        at = end
    ids.append(enc.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(ids).astype(np.int64)


def attribute(token_end: np.ndarray, section_end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section: interval join of two tilings of the same
    bytes, given by their sorted ends."""
    if not len(token_end):
        return np.zeros(len(section_end), dtype=np.int64)
    begin = np.concatenate([[0], token_end[:-1]])
    first = np.searchsorted(section_end, begin, side="right")
    if rule == "start":
        owner = first
    else:
        last = np.searchsorted(section_end, token_end - 1, side="right")
        owner = last
        if rule == "most":
            owner = first.copy()
            for t in np.flatnonzero(last > first):  # the few that cross a boundary
                cuts = np.clip(section_end[first[t] : last[t] + 1], None, token_end[t])
                owner[t] += int(np.argmax(np.diff(np.concatenate([[begin[t]], cuts]))))
    return np.bincount(owner, minlength=len(section_end)).astype(np.int64)


def count_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), by_line: bool = True, rule: str = "most",
                 separator: str = "\n\n", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, sections): ``sections`` is an array of struct
    (field, line, n_bytes, n_tokens), one per field, or one per line of each
    field if ``by_line`` (field and line from 0)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(spark, vocabulary))
    sep, names = separator.encode(), [f"f{i}" for i in range(len(fields))]
    name = f"{vocabulary}|{pattern}"

    def run(batches):
        import pyarrow as pa

        enc, length = encoder(name, ranks.value, pattern)
        for part in _text.slices(batches, names):
            values = [_text.as_bytes(part.column(c)) for c in names]
            total, offsets, cols = [], [0], [[], [], [], []]
            for row in zip(*values, strict=True):
                field, line, size = [], [], []
                for i, value in enumerate(row):
                    pieces = value.split(b"\n") if by_line else [value]
                    own = [len(p) + 1 for p in pieces]
                    own[-1] += len(sep) * (i < len(row) - 1) - 1
                    field += [i] * len(own)
                    line += range(len(own))
                    size += own
                ids = encode(enc, sep.join(row).decode())
                counts = attribute(np.cumsum(length[ids]), np.cumsum(size), rule)
                total.append(len(ids))
                offsets.append(offsets[-1] + len(size))
                for col, more in zip(cols, (field, line, size, counts.tolist()), strict=True):
                    col.extend(more)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            parts = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                               ["field", "line", "n_bytes", "n_tokens"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)],
                ["doc_id", "n_tokens", "sections"])

    text = [F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text)
    return rows.mapInArrow(run, "doc_id long, n_tokens long, sections array<struct<field int, line int, n_bytes long, n_tokens long>>")

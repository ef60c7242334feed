"""Token counts with a byte-level BPE file of the tokenizers library.

Most pre-tokens are themselves one token. Which strings of the vocabulary the
merges put together when they stand alone is proved beforehand, once for each
string of the vocabulary; a pre-token among them counts one without any merging.
The merges are run only for the others, and their counts are remembered, up to
``REMEMBER`` at a time.

The file is read on the driver and sent to the tasks as text, so that its path
need exist there only. Whole texts are counted; a null or empty text has 0
bytes and 0 tokens; repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LIMIT = 1024
REMEMBER = 200_000
# Fixed value: how the byte-level pre-tokenizer of the library splits a text.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


@functools.cache
def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 characters for
    themselves, the other bytes for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def spelled(piece: str) -> str:
    letters = byte_letters()
    return "".join(letters[b] for b in piece.encode())


def whole_tokens(model: Tokenizer) -> frozenset[str]:
    """Pre-tokens that the merges make into one token, proved one by one."""
    byte_of = {c: b for b, c in byte_letters().items()}
    pattern, found = regex.compile(PIECES), set()
    for name in model.get_vocab(with_added_tokens=False):
        if not all(c in byte_of for c in name):
            continue
        try:
            piece = bytes(byte_of[c] for c in name).decode()
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(piece) and len(model.model.tokenize(name)) == 1:
            found.add(piece)
    return frozenset(found)


@functools.cache
def counter_of(file: str, whole: frozenset[str]) -> Counter:
    """One counter a worker, whatever the number of its tasks."""
    return Counter(file, whole)


class Counter:
    """Counts the tokens of texts as the library does."""

    def __init__(self, file: str, whole: frozenset[str] | None = None):
        settings = json.loads(file)
        split, added = settings["pre_tokenizer"], settings["added_tokens"]
        plain = (
            settings["normalizer"] is None
            and settings["post_processor"] is None
            and split["type"] == "ByteLevel"
            and split["use_regex"]
            and not split["add_prefix_space"]
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        )
        if not plain:
            raise ValueError("only plain byte-level BPE files can be counted")
        self.tokenizer = Tokenizer.from_str(file)
        self.whole = whole_tokens(self.tokenizer) if whole is None else whole
        self.known = dict.fromkeys(self.whole, 1)
        self.pieces = regex.compile(PIECES).findall
        # Added tokens are found first, longer ones before shorter ones.
        names = sorted((regex.escape(a["content"]) for a in added), key=len, reverse=True)
        self.special = regex.compile("|".join(names)) if names else None

    def count(self, text: str) -> int:
        parts, extra = [text], 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            extra = len(parts) - 1
        known, total = self.known, extra
        for part in parts:
            counts = list(map(known.get, found := self.pieces(part)))
            if None in counts:
                counts = [self.merged(p) if c is None else c for c, p in zip(counts, found, strict=True)]
            total += sum(counts)
        return total

    def merged(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.tokenizer.model.tokenize(spelled(piece)))
            if len(self.known) - len(self.whole) >= REMEMBER:
                self.known = dict.fromkeys(self.whole, 1)
            self.known[piece] = n
        return n


def token_counts(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit."""
    with open(tokenizer_path, encoding="utf-8") as f:
        file = f.read()
    # As large as the vocabulary, whatever the table.
    shared = docs.sparkSession.sparkContext.broadcast((file, Counter(file).whole))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(*shared.value)
        for batch in batches:
            n = [counter.count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())],
                names=["key", "n_bytes", "n_tokens"],
            )

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    return rows.mapInArrow(count, f"key {kind}, n_bytes bigint, n_tokens bigint").select(
        F.col("key").alias(key),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )

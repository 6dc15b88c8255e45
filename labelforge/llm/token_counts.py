"""Operator 1, token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded on its own; those that come back as exactly
one token are proved whole. A text is normalised and cut into pre-tokens as the tokenizer
does it; a pre-token in the proved set counts one, and only the rest go through the merges.
White space always ends a pre-token, so counts are remembered by white-space word.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

#: The pre-token pattern of the tokenizer file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
#: Characters whose class and lower case are the same in every Unicode version and library.
_UNUSUAL = re.compile("[^\t-\r -~¡-įı-ɏ]")
_MEMO = 400_000


def whole_tokens(path: str) -> frozenset[str]:
    """Byte-level pre-tokens (without the word-end mark) that are proved to encode as one token."""
    model = Tokenizer.from_file(path).model
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    names = [v[:-len(SUFFIX)] for v in vocabulary if v.endswith(SUFFIX) and len(v) > len(SUFFIX)]
    return frozenset(v for v in names if len(model.tokenize(v)) == 1)


class _WordCounts(dict):
    """Tokens of a normalised white-space word; unknown words are cut, looked up and merged."""

    def __init__(self, tokenizer: Tokenizer, whole: frozenset[str]):
        super().__init__()
        self.model, self.whole = tokenizer.model, whole
        self.find = regex.compile(PRE_TOKEN).findall
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, word: str) -> int:
        n = sum(self.of_piece(p if p.isascii() else self.to_bytes(p)[0][0]) for p in self.find(word))
        if len(self) < _MEMO:  # frequent words come early and stay
            self[word] = n
        return n

    def of_piece(self, piece: str) -> int:
        return 1 if piece in self.whole else len(self.model.tokenize(piece))


class TextCounter:
    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer = Tokenizer.from_file(path)
        self.words = _WordCounts(self.tokenizer, whole)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def plain(self, text: str) -> int:
        if _UNUSUAL.search(text) or not unicodedata.is_normalized("NFC", text):
            if not text:
                return 0
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
            return sum(self.words.of_piece(p) for p, _ in cut)
        return sum(map(self.words.__getitem__, text.lower().split()))


@functools.lru_cache(maxsize=2)
def _counter(path: str, whole: frozenset[str]) -> TextCounter:
    return TextCounter(path, whole)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    Null and empty texts have 0 tokens; a null doc_id stays null; repeated rows are each
    counted; an empty table gives an empty result. Special strings inside a text count as
    the tokenizer's special tokens. The proved set is bounded by the vocabulary file. A very
    long text is counted whole, pre-token by pre-token. Other columns, whatever their names, are not read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, whole.value)
        for b in batches:
            text = b.column("text")
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            n_tokens = pa.array([counter(t.as_py()) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))

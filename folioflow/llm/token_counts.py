"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Long texts are cut at safe boundaries, before a run of white space after which no token can span, so that the batches
handed to the encoder hold about equally many bytes. The ranks of the definition's vocabulary drive a batch BPE encoder;
segments with characters whose class depends on the Unicode version go to the tokenizer's own library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe_automaton import byte_symbols
from .common import id_and_text, read_bytes, slices_by_bytes

#: Characters of a batch, and those after which a text is cut.
BATCH_CHARS, SEGMENT_CHARS = 1 << 20, 1 << 16

#: The pattern by which byte-level BPE splits text; a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = re.compile(r"(?<=[A-Za-z0-9.,;:!?])[ \n](?=[A-Za-z0-9])")


def segments(text: str, most: int = SEGMENT_CHARS) -> list[str]:
    """The text in parts of about `most` characters whose token counts add up to that of the text.

    A part ends before a single space or line break between a letter, digit or point and a letter or digit: the pattern
    always starts a new word there. A text without such places stays whole.
    """
    out, start = [], 0
    while len(text) - start > most:
        found = _CUT.search(text, start + most)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


class Counter:
    """Lengths of encoded texts, as the tokenizers library gives them for a byte-level BPE definition."""

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        self.library = Tokenizer.from_buffer(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.fast = None
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            number = {s: b for b, s in enumerate(byte_symbols())}
            ranks = {bytes(number[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
            self.fast = tiktoken.Encoding("definition", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        slow = []
        special = set(self.special)
        for i, t in enumerate(texts):
            if self.fast is not None and (t.isascii() or max(t) < "ɐ"):
                out[i] = len(self.fast.encode(t, allowed_special=special, disallowed_special=()))
            elif t:
                slow.append(i)
        for i, e in zip(slow, self.library.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = len(e)
        return out


_built: dict[str, Counter] = {}


def counter_of(definition: bytes) -> Counter:
    key = hashlib.sha256(definition).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Counter(definition)
    return _built[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty (0, 0, false). One result row for each row, with equal or null ids too. One pass without
    shuffle; only counts leave the Arrow function.
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_bytes(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(definition.value)
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            total = [0] * len(column)
            parts: list[str] = []
            owner: list[int] = []
            size = 0
            for i, t in enumerate(column):
                cut = segments(t.as_py())
                parts += cut
                owner += [i] * len(cut)
                size += sum(map(len, cut))
                if size >= BATCH_CHARS or i == len(column) - 1:
                    for a, b in slices_by_bytes(parts, BATCH_CHARS):
                        for k, n in zip(owner[a:b], counter.counts(parts[a:b]), strict=True):
                            total[k] += n
                    parts, owner, size = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(column).cast(pa.int64()), pa.array(total, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    counted = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


"""Token counts by the whole-token shortcut.

``prove`` runs once, before any text is read: it checks that no vocabulary string crosses a pre-token boundary (so that
merges of a text are the merges of its pre-tokens) and lists the strings that the encoder gives back as one token.
Pre-tokens among these are counted without merging; the encoder merges only the rest, each distinct one once.

Null texts count as empty (0 tokens). Very long texts are counted whole: memory is a text's own distinct pre-tokens
plus a memo of at most ``MEMO`` entries a worker, which is emptied when full. Repeated rows are counted each. An empty
table gives an empty result. Columns of the input other than the two named are carried along unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's mark for a space, which stands before the words that it begins.
SPACE = "▁"
#: A pre-token: spaces and what follows up to the next space or line end; or a line end.
PRE_TOKEN = re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
MEMO = 300_000


@dataclass(frozen=True)
class Proof:
    """What holds for a vocabulary. split: a text's merges never cross pre-tokens; whole: pre-tokens that are one token."""

    split: bool
    whole: frozenset[str]


def _encoder(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _merged(encoder, pre_token: str) -> int:
    """Tokens of one pre-token. The encoder puts a space before what it gets, so one is left out, or a line end added."""
    if pre_token[0] == SPACE:
        return len(encoder.encode(pre_token[1:].replace(SPACE, " "))) if len(pre_token) > 1 else 1
    return len(encoder.encode("\n" + pre_token)) - len(encoder.encode("\n"))


def prove(model: bytes) -> Proof:
    """Checks every vocabulary string with the encoder itself."""
    encoder = _encoder(model)
    pieces = [encoder.id_to_piece(i) for i in range(encoder.vocab_size()) if not (encoder.is_control(i) or encoder.is_unknown(i) or encoder.is_byte(i))]
    probe = "a  b\n céＡ "
    split = (
        all(SPACE not in p.lstrip(SPACE) and "\n" not in p for p in pieces)
        and SPACE in pieces
        and encoder.normalize(probe) == SPACE + probe.replace(" ", SPACE)
    )
    whole = frozenset(p for p in pieces if PRE_TOKEN.fullmatch(p) and _merged(encoder, p) == 1) if split else frozenset()
    return Proof(split, whole)


def counter(model: bytes, proof: Proof):
    """A function from a text to its number of tokens."""
    encoder = _encoder(model)
    whole, memo = proof.whole, {}

    def count(text: str) -> int:
        if not text:
            return 0
        if not proof.split:
            return len(encoder.encode(text))
        total = 0
        for pre_token, times in Counter(PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE))).items():
            if pre_token in whole:
                total += times
                continue
            if (n := memo.get(pre_token)) is None:
                if len(memo) >= MEMO:
                    memo.clear()
                n = _merged(encoder, pre_token)
                if len(pre_token) < 200:
                    memo[pre_token] = n
            total += times * n
        return total

    return count


def with_token_counts(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the column ``out``: tokens of the column ``text`` under the vocabulary at ``model_path``.

    The vocabulary (fixed size, half a megabyte here) and the proof travel with the task, so executors need no file.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    proof = prove(model)
    at = docs.columns.index(text)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model, proof)
        for batch in them:
            counts = pa.array([count(t) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, out])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(batches, StructType([*docs.schema.fields, StructField(out, LongType())]))


def op1(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """The contract's columns; the text itself isn't sent back from the Python workers."""
    from lumitrack.llm.common import utf8_bytes

    with open(model_path, "rb") as file:
        model = file.read()
    proof = prove(model)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model, proof)
        for batch in them:
            counts = pa.array([count(t) if t else 0 for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", utf8_bytes(F.col("text")).alias("n_bytes"), "text").mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

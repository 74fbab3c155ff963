"""Vector bin packing of token sequences by the dot-product heuristic."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.common import text_and_id

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 1024, 256, 1024
#: Examples that one heuristic run sees; a task runs it batch after batch.
BATCH = 8192
END_ID = 0

#: Fixed values of the byte-level vocabulary: how a text is cut before merging.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_CUT_RUNS = _CUT.replace(r"|\s+", r"|\s+(?!\S)|\s+")
_RUNS = re.compile(r"\s\s")
_WHOLE = re.compile(r"[\x1c-\x1f]|<\|")


def _printed_bytes() -> dict[str, int]:
    """Byte-level vocabularies print bytes that are no visible Latin-1 character as U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Token ids, as little-endian 32-bit bytes, of a byte-level BPE file of ``tokenizers``.

    Ids rise in the order of merging in such files, so ``tiktoken`` gives the same ids from
    the same vocabulary several times faster; the pattern with a look-ahead is needed only
    where white space stands twice. Texts with a special token or with control characters
    that the two libraries class differently go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        printed = _printed_bytes()
        ranks = {bytes(printed[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in printed for c in t) and t != "<|endoftext|>"}
        self.plain, self.runs = (tiktoken.Encoding(f"{path} {n}", pat_str=cut, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary for n, cut in enumerate((_CUT, _CUT_RUNS)))
        probe = "The quick  brown fox's\n\n 12 émigrés, \u4e2d\u6587!? "
        if self.runs(probe) != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} is no byte-level vocabulary in order of merging")

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _WHOLE.search(text):
            got = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            got = (self.runs if _RUNS.search(text) else self.plain)(text)
        return (array("I", got) if sys.byteorder == "little" else np.array(got, "<u4")).tobytes()


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def place(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bin of each row of ``demands`` (n x d), all limits holding in each bin.

    Fills one bin at a time: of the examples that fit it takes the one whose demand has the
    largest dot product with what is left in the bin, both as shares of the limits (ties:
    the first). An example beyond a limit gets a bin of its own.
    """
    kinds, kind_of = np.unique(demands, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    count = np.bincount(kind_of, minlength=len(kinds))
    members = np.argsort(kind_of, kind="stable")
    taken = np.cumsum(count) - count  # where the next example of each kind stands in members
    share = kinds / limits
    bins, at = np.full(len(demands), -1, np.int64), 0
    while len(share):
        left, open_ = np.ones(share.shape[1]), np.arange(len(share))
        used = False
        while len(open_):
            pick = open_[np.argmax(share[open_] @ left)]
            bins[members[taken[pick]]] = at
            taken[pick] += 1
            count[pick] -= 1
            left, used = left - share[pick], True
            open_ = open_[(share[open_] <= left + 1e-12).all(axis=1) & (count[open_] > 0)]
        at += used
        some = count > 0
        if not some.all():
            share, count, taken = share[some], count[some], taken[some]
    return bins


def _offsets(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each piece starts in its bin: after the pieces before it."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
    base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
    out = np.empty(len(bins), np.int64)
    out[order] = ends - lengths[order] - base
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS) -> DataFrame:
    """Pieces of all documents, packed: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids and a closing ``END_ID``. What fills whole sequences is cut
    off; the rests are examples for :func:`place` under the limits on tokens, segments and
    loss-bearing tokens (here all tokens). Each task packs what it reads, in batches, so
    nothing is shuffled and memory is bounded; a sequence id holds the task's number.
    ``tokenizer`` is a file of the ``tokenizers`` library that every executor has.
    Null and empty texts are one closing id; repeated rows are packed each; a null doc_id
    stays null; empty input gives an empty result; other columns are not read.
    """
    df = text_and_id(docs, id_col, text_col)
    most, limits = min(max_tokens, max_loss), np.array([max_tokens, max_segments, max_loss], float)
    close = np.array([END_ID], "<u4").tobytes()
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, used = tokens_of(tokenizer), TaskContext.get().partitionId() << 40, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rests: list[tuple] = []

        def out(rows: list[tuple], seq: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            ids, *cols = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, pa.int64()) for c in cols), pa.array(seq + task), pa.array(offset)], names)

        def packed() -> pa.RecordBatch:
            nonlocal used
            lengths = np.array([r[2] for r in rests], np.int64)
            bins = place(np.stack([lengths, np.ones_like(lengths), lengths], axis=1), limits)
            got = out(rests, bins + used, _offsets(bins, lengths))
            used += int(bins.max()) + 1
            rests.clear()
            return got

        for b in batches:
            id_type, full = b.column(0).type, []
            ids_col, texts = b.column(0).to_pylist(), b.column(1)
            for doc, text in zip(ids_col, texts):
                ids = tokens.ids(text.as_py()) + close
                n = len(ids) // 4
                for start in range(0, n, most):
                    piece = ids[4 * start : 4 * (start + most)]
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), n)
                    (full if row[2] == most else rests).append(row)
            if full:
                yield out(full, used + np.arange(len(full), dtype=np.int64), np.zeros(len(full), np.int64))
                used += len(full)
            if len(rests) >= BATCH:
                yield packed()
        if rests:
            yield packed()

    return df.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_examples(examples: DataFrame, demands: list[str], limits: list[int]) -> DataFrame:
    """``examples`` with ``sequence_id``: the bin of each row under all limits at once.

    ``demands`` names integer columns (null: 0), such as tokens, segments and loss-bearing
    tokens of an instruction example, ``limits`` their limits. An example beyond a limit
    has a sequence of its own. Rows keep all their columns;
    equal and repeated rows are placed each; an empty table gives an empty result.
    """
    need = F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("double") for c in demands])
    df = examples.select(F.struct(*[F.col(c) for c in examples.columns]).alias("row"), need.alias("need"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, used = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            if not b.num_rows:
                continue
            need = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, len(limits))
            bins = place(need, np.array(limits, float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins + used + task)], ["row", "sequence_id"])
            used += int(bins.max()) + 1

    schema = f"row {df.schema['row'].dataType.simpleString()}, sequence_id long"
    return df.mapInArrow(run, schema).select("row.*", "sequence_id")

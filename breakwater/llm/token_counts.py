"""Token counts by a map-side lookup in two tiers.

A text falls into pre-tokens that no merge of the vocabulary crosses, so its count is the sum
of theirs. Lengths of the pre-tokens that are frequent in the corpus are broadcast as one
compact table; the others are encoded once by each worker, which keeps them in a bounded
cache. No pre-token is shuffled but for the few that each task finds frequent.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm import common

#: Share of all pre-tokens from which on one is frequent: the broadcast table has at most its inverse entries.
FREQUENT = 1e-5
#: Code points of the longest pre-token that is kept anywhere; longer ones are encoded each time.
KEPT = 48
#: Entries of a worker's cache, and of the counts of one task, before they are cut.
CACHE, COUNTED = 400_000, 400_000
#: Texts longer than this are walked through, not split into one list.
LONG = 1 << 20
LIMIT = 4096

#: The mark that the vocabulary has for a space.
_SPACE = "▁"
_CUT = re.compile(f"\n|{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+")


class Encoder:
    """Lengths of pre-tokens under a ``sentencepiece`` file of byte-pair merges with byte fallback.

    A pre-token is a line break, spaces with what follows them up to the next space or break,
    or what follows a break. That no piece goes on after a word into a space, or holds a
    break, is checked on the whole vocabulary, and the sum against the library on a probe.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probe = " ▁The  quick\n\n brown fox's 中文\t<s> \U0001f600\n end "
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p or " " in p for p in pieces) or sum(map(self.length, _CUT.findall(_SPACE + probe.replace(" ", _SPACE)))) != self.whole(probe):
            raise ValueError(f"pieces of {path} cross spaces or line breaks")

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def length(self, token: str) -> int:
        """The library puts a space before every text, which stands for the first space of a pre-token."""
        if token == "\n":
            return 1
        if token[0] == _SPACE:
            return self.whole(token[1:]) if len(token) > 1 else 1
        return self.whole("\n" + token) - 2  # the space, the break


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


class Lengths(dict):
    """Both tiers in a worker: the broadcast table, and a cache that starts anew when it is full."""

    def __init__(self, path: str, tokens: str, lengths: bytes):
        super().__init__(zip(tokens.split(" ") if tokens else [], lengths))
        self.encoder = encoder_of(path)
        self.cache: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        found = self.cache.get(token)
        if found is None:
            found = self.encoder.length(token)
            if len(token) <= KEPT:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[token] = found
        return found

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        text = _SPACE + text.replace(" ", _SPACE)
        if len(text) <= LONG:
            return sum(map(self.__getitem__, _CUT.findall(text)))
        return sum(self[m.group()] for m in _CUT.finditer(text))


@lru_cache(maxsize=2)
def lengths_of(path: str, tokens: str, lengths: bytes) -> Lengths:
    return Lengths(path, tokens, lengths)


def _cut(counts: Counter) -> Counter:
    """The upper half of the counts."""
    middle = sorted(counts.values())[len(counts) // 2]
    return Counter({t: n for t, n in counts.items() if n > middle})


def frequent(docs: DataFrame, share: float = FREQUENT) -> DataFrame:
    """``token, n``: what each task finds frequent among its own pre-tokens, summed, and null with all pre-tokens.

    A pre-token that makes up ``share`` of the corpus does so in some task, so it is among
    them; ``n`` may lack what tasks have where it is rare. Reads all texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = Counter(), 0
        for b in batches:
            for text in b.column(0):
                text = text.as_py()
                if not text:
                    continue
                text = _SPACE + text.replace(" ", _SPACE)
                for at in range(0, len(text), LONG):  # a pre-token over an edge counts as two here
                    tokens = _CUT.findall(text[at : at + LONG])
                    total += len(tokens)
                    counts.update(tokens)
                    if len(counts) > COUNTED:
                        counts = _cut(counts)
        least = max(2, share * total)
        own = [(t, n) for t, n in counts.items() if n >= least and len(t) <= KEPT]
        tokens, n = zip(*own, (None, total))
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(n, pa.int64())], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def table_of(docs: DataFrame, tokenizer: str, share: float = FREQUENT) -> tuple[str, bytes]:
    """The broadcast table: frequent pre-tokens in one string, and their lengths in bytes; at most ``1 / share`` entries."""
    found, path = common.write_table(frequent(docs, share), "pretokens")
    total = found.where("token is null").agg(F.sum("n")).first()[0] or 0
    tokens = sorted(r.token for r in found.where(F.col("token").isNotNull() & (F.col("n") >= max(1.0, share * total))).collect())
    common.drop_table(docs.sparkSession, path)
    encoder = encoder_of(tokenizer)
    kept = [(t, n) for t in tokens if (n := encoder.length(t)) < 256]
    return " ".join(t for t, _ in kept), bytes(n for _, n in kept)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, share: float = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    ``tokenizer`` is a ``sentencepiece`` file that driver and executors have; neither a begin nor
    an end nor another special token is counted, and strings of special tokens inside texts are
    text. A null text is empty; an empty one has no tokens, one of spaces only has tokens; repeated
    rows are counted each; a null id stays null; an empty table gives an empty result;
    other columns are not read. A text without a space or line break is encoded whole.
    """
    df = common.text_and_id(docs, id_col, text_col)
    tokens, lengths = table_of(df, tokenizer, share)
    table = df.sparkSession.sparkContext.broadcast((tokens, lengths))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers = lengths_of(tokenizer, *table.value)
        for b in batches:
            text = b.column(1)
            size = pc.fill_null(pc.binary_length(text.cast(pa.binary())), 0).cast(pa.int64())
            n = np.fromiter((tiers.count(t.as_py() or "") for t in text), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

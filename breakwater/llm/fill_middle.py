"""Fill-in-middle transformation by in-place block rotation.

A text is cut in three at token boundaries. Its bytes become one bytearray, into which the
sentinels are inserted at the cuts; blocks then change places by three reversals in the
same array, and the same rotation the other way restores the text exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle. Texts that hold one stay plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percentages of documents that stay plain, and of the others that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of text in a batch of output, about, and of one step of a reversal.
BATCH_BYTES, STEP = 1 << 24, 1 << 16


def token_starts(text: bytes) -> np.ndarray:
    """Offsets of the tokens: runs of ASCII letters, and every other code point."""
    at = np.frombuffer(text, np.uint8)
    lower = at | 32
    letter = (lower >= 97) & (lower <= 122)
    start = ~letter & ((at & 0xC0) != 0x80)
    start[:1] |= letter[:1]
    start[1:] |= letter[1:] & ~letter[:-1]
    return np.flatnonzero(start)


def _reverse(buffer: bytearray, start: int, end: int) -> None:
    view = np.frombuffer(buffer, np.uint8)
    while end - start > 1:
        k = min(STEP, (end - start) // 2)
        low = view[start : start + k][::-1].copy()
        view[start : start + k] = view[end - k : end][::-1]
        view[end - k : end] = low
        start, end = start + k, end - k


def rotate(buffer: bytearray, start: int, split: int, end: int) -> None:
    """Lets the blocks ``start:split`` and ``split:end`` change places, by three reversals in place."""
    _reverse(buffer, start, split)
    _reverse(buffer, split, end)
    _reverse(buffer, start, end)


def arrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with sentinels, cut at two byte offsets: psm or spm, the order of prefix, suffix and middle."""
    buffer = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restore(output: bytes, form: str) -> bytes:
    """The text that :func:`arrange` was given, from its output and form alone."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    # A sentinel begins and ends with brackets, so none can arise where texts and sentinels meet.
    start, split = (buffer.find(SUFFIX), buffer.find(MIDDLE)) if form == "psm" else (0, buffer.find(PREFIX))
    rotate(buffer, start, split, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.find(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def _points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def decide(doc, text: bytes, seed: int, plain: int, suffix_first: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    starts = token_starts(text)
    n = len(starts)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < suffix_first else "psm"
    first, second = (int(starts[k]) if k < n else len(text) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, form, _points(text[:first]), _points(text[first:second]), bytes(arrange(text, first, second, form))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document.

    Cuts and form follow from a digest of seed and id alone, so equal ids are cut by the same
    numbers and a retried task gives the same rows; nothing is shuffled. Whole texts, however
    long, are one bytearray each. A null text is empty, an empty text plain with no tokens; a
    null id counts as an empty one in the digest and stays null; repeated rows are done each; an empty table
    gives an empty result; other columns are not read.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type, rows, held = b.column(0).type, [], 0

            def out() -> pa.RecordBatch:
                ids, n, form, prefix, middle, output = zip(*rows)
                return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], names)

            for doc, text in zip(b.column(0), b.column(1).cast(pa.binary())):
                doc, text = doc.as_py(), text.as_py() or b""
                rows.append((doc, *decide(doc, text, seed, plain, suffix_first)))
                held += len(text)
                if held > BATCH_BYTES:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()

    return df.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(moved: DataFrame) -> DataFrame:
    """``moved`` with ``restored``: the text of each row, from its ``output`` and ``form`` alone."""
    kind = moved.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held = 0, []
            forms, outputs = b.column(2), b.column(5).cast(pa.binary())
            size = 0
            for i in range(b.num_rows):
                text = restore(outputs[i].as_py(), forms[i].as_py())
                held.append(text)
                size += len(text)
                if size > BATCH_BYTES or i + 1 == b.num_rows:
                    part = b.slice(at, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary()).cast(pa.string())], [*b.schema.names, "restored"])
                    at, held, size = i + 1, [], 0

    return moved.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def oracle_sql() -> str:
    """The digests of op11, from lists of tokens; no array is rotated."""
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT doc_id, n, form, text, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s"""

"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

Documents are dealt with in batches of a task. A batch explodes into its n-grams (64-bit
hashes, counted within the batch); these are shuffled by hash bucket, where the bucket's
count table is summed over all batches and joined back to what each batch asked for; the
answers are shuffled by batch, where each document's scores are summed. Shuffled rows hold
compressed arrays: one row per batch and bucket that it has n-grams in, so never more rows
than distinct n-grams of the batches. As a batch sends an n-gram once, frequent n-grams are
no hot keys. Hashes have 64 bits at every corpus size, so whether two n-grams share one does
not depend on the other documents.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.common import parts, text_and_id

#: Longest n-gram and the factor of each step back.
ORDER, BACKOFF = 3, 0.4
#: Tokens of a batch, about, and bytes of text per bucket.
BATCH, BUCKET_BYTES = 1_500_000, 8 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _pack(values: np.ndarray) -> bytes:
    """An array's bytes; of long arrays equal places together, compressed."""
    import zstandard

    v = np.ascontiguousarray(values)
    if len(v) < 32:
        return b"\0" + v.tobytes()
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T)
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    if data[0] == 0:
        return np.frombuffer(data, kind, offset=1)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], np.ndarray]]:
    """Batch id, document ids, words of all documents in order, and their numbers; ids repeat on a reread."""
    task, k = TaskContext.get().partitionId() << 32, 0
    ids: list = []
    words: list[bytes] = []
    sizes: list[int] = []
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            own = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            ids.append(doc)
            sizes.append(len(own))
            words += own
            if len(words) >= BATCH or len(ids) >= 200_000:
                yield task | k, ids, words, np.array(sizes, np.int64)
                ids, words, sizes, k = [], [], [], k + 1
    if ids:
        yield task | k, ids, words, np.array(sizes, np.int64)


def _word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word among the distinct ones, and the distinct words' hashes."""
    import xxhash

    values = np.empty(len(words), object)
    values[:] = words
    codes, distinct = pd.factorize(values)
    return codes.astype(np.uint32), np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)


def _ngrams(hashes: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order the hash of the k-gram that ends at each word; past a document's start, of the longest there is."""
    whole = np.full(len(hashes), 1, np.uint64)
    out = [np.zeros(len(hashes), np.uint64)]
    for k in range(1, order + 1):
        before = np.empty_like(hashes)
        before[1:], before[:1] = whole[:-1], 1
        whole = np.where(place >= k - 1, _mix(before * _A + hashes + np.uint64(k)), whole)
        out.append(whole)
    return out


def _asked(hashes: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    grams = _ngrams(hashes, place, order)
    return np.concatenate([g[place >= k - 1] for k, g in enumerate(grams)])


def _numbered(hashes: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct n-grams, sorted, and for k = 0..order the number among them of the k-gram that ends at each word (0 if none does).

    One sort gives both; a search for every n-gram in the sorted ones would cost far more.
    """
    grams, inverse = np.unique(_asked(hashes, place, order), return_inverse=True)
    at, start = [], 0
    for k in range(order + 1):
        where = place >= k - 1
        number = np.zeros(len(place), np.int64)
        n = int(where.sum())
        number[where] = inverse[start : start + n]
        at.append(number)
        start += n
    return grams, at


def _mark(grams: np.ndarray) -> int:
    """A number that tells sets of n-grams apart; those of disjoint sets add up."""
    return int(_mix(grams + _A).sum(dtype=np.uint64).view(np.int64))


def _places(sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def _bounds(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def score_batch(sizes: np.ndarray, at: list[np.ndarray], counts: np.ndarray, order: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sum of log10 scores, and how many of its words have a seen n-gram of the order.

    ``at`` numbers the batch's n-grams by :func:`_numbered`, ``counts`` holds their corpus counts.
    """
    place, doc = _places(sizes), np.repeat(np.arange(len(sizes)), sizes)

    def others(number: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Counts in other documents: the corpus count less the document's own."""
        key = doc[where] * len(counts) + number[where]
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        out = np.zeros(len(number), np.int64)
        out[where] = counts[number[where]] - own[inverse]
        return out

    # A document has the empty n-gram once for each of its words.
    left = [counts[at[0]] - sizes[doc], *(others(at[k], place >= k - 1) for k in range(1, order + 1))]
    # The context of a k-gram is the (k-1)-gram that ends at the word before; of a word, the empty one.
    longest = np.minimum(place + 1, order)
    value = np.full(len(doc), np.nan)
    todo = np.ones(len(doc), bool)
    seen_full = np.zeros(len(doc), bool)
    for k in range(order, 0, -1):
        context = left[0] if k == 1 else np.concatenate([[0], left[k - 1][:-1]])
        hit = todo & (place >= k - 1) & (left[k] > 0) & (context > 0)
        value[hit] = np.log10(left[k][hit] / context[hit]) + (longest[hit] - k) * np.log10(backoff)
        seen_full |= hit & (k == order)
        todo &= ~hit
    value[todo] = longest[todo] * np.log10(backoff) - np.log10(np.maximum(left[0][todo], 1))
    return np.bincount(doc, value, len(sizes)), np.bincount(doc[seen_full], minlength=len(sizes))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """``doc_id, n_tokens, n_seen, log10_score, mean_log10``: each document under the model of all others.

    Words are what ASCII white space separates. Counts are those of the whole corpus less the
    document's own. A word scores count(n-gram) / count(context) for the longest n-gram (of at
    most ``order`` words, within the document) seen elsewhere, times ``backoff`` for each step
    back; a word not seen elsewhere scores ``backoff`` once more, over the number of words.
    ``n_seen`` counts words whose n-gram of ``order`` words is seen elsewhere.

    A null or empty text has no words, score 0 and a null mean; repeated rows are documents of
    their own; a null doc_id stays null; an empty table gives an empty result; other columns
    are not read. ``docs`` is read twice and must give the same rows in the same tasks, as
    a table's files do; else the query fails (it never gives other counts).
    """
    spark = docs.sparkSession
    df = text_and_id(docs, id_col, text_col)
    size = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(parts(spark), -(-size // BUCKET_BYTES))
    kind = df.schema["doc_id"].dataType

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(buckets)
        for batch, _, words, sizes in _batches(batches):
            codes, hashes = _word_hashes(words)
            grams, counts = np.unique(_asked(hashes[codes], _places(sizes), order), return_counts=True)
            cut = [0, *np.searchsorted(grams, bounds).tolist(), len(grams)]
            rows = [(i, a, b) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            if rows:
                steps = [np.diff(grams[a:b], prepend=np.uint64(0)) for _, a, b in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch] * len(rows), pa.int64()), pa.array([i for i, _, _ in rows], pa.int32()), pa.array([_pack(s) for s in steps], pa.binary()), pa.array([_pack(counts[a:b].astype(np.uint32)) for _, a, b in rows], pa.binary()), pa.array([_mark(grams[a:b]) for _, a, b in rows], pa.int64())],
                    ["batch", "bucket", "grams", "counts", "mark"],
                )

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = [np.cumsum(_unpack(g, np.uint64), dtype=np.uint64) for g in pdf["grams"]]
        _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate([_unpack(c, np.uint32) for c in pdf["counts"]]))[inverse].astype(np.uint64)
        ends = np.cumsum([len(g) for g in grams])[:-1]
        return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "counts": [_pack(s) for s in np.split(sums, ends)], "mark": pdf["mark"]})

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, words, sizes in _batches(batches):
            codes, hashes = _word_hashes(words)
            table = pa.table({"doc_id": pa.array(ids, id_type), "size": sizes})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            head, c, h = sink.getvalue().to_pybytes(), _pack(codes), hashes.tobytes()
            blob = struct.pack("<qqq", len(head), len(c), len(h)) + head + c + h
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([blob], pa.binary())], ["batch", "texts"])

    def score(answers: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        if len(texts) != 1:
            raise RuntimeError("the documents were not the same when read again")
        blob = texts["texts"].iat[0]
        a, b, c = struct.unpack("<qqq", blob[:24])
        with pa.ipc.open_stream(blob[24 : 24 + a]) as head:
            table = head.read_all()
        hashes = np.frombuffer(blob, np.uint64, c // 8, 24 + a + b)[_unpack(blob[24 + a : 24 + a + b], np.uint32)] if b and c else np.empty(0, np.uint64)
        sizes = table["size"].to_numpy()
        grams, at = _numbered(hashes, _places(sizes), order)
        answers = answers.sort_values("bucket")
        counts = np.concatenate([np.empty(0, np.uint64), *(_unpack(x, np.uint64) for x in answers["counts"])]).astype(np.int64)
        marks = int(answers["mark"].to_numpy(np.int64).sum(dtype=np.int64)) if len(answers) else 0
        if len(counts) != len(grams) or marks != _mark(grams):
            raise RuntimeError("the documents were not the same when read again")
        value, seen = score_batch(sizes, at, counts, order, backoff)
        mean = pd.array(np.divide(value, sizes, out=np.full(len(sizes), np.nan), where=sizes > 0), dtype="Float64")
        mean[np.asarray(sizes == 0)] = pd.NA
        return pd.DataFrame({"doc_id": table["doc_id"].to_pandas(types_mapper=pd.ArrowDtype), "n_tokens": sizes, "n_seen": seen, "log10_score": value, "mean_log10": mean})

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    asked = df.mapInArrow(ask, "batch long, bucket int, grams binary, counts binary, mark long")
    answers = asked.groupBy("bucket").applyInPandas(total, "batch long, bucket int, counts binary, mark long")
    texts = df.mapInArrow(keep, "batch long, texts binary")
    return answers.groupBy("batch").cogroup(texts.groupBy("batch")).applyInPandas(score, f"doc_id {kind.simpleString()}, n_tokens long, n_seen long, log10_score double, mean_log10 double")


def oracle_sql(backoff: float = BACKOFF) -> str:
    """The same result for order 3 in DuckDB's SQL, rounded as the query rounds."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
g AS (SELECT r, p, w, lag(w) OVER x AS v, lag(w, 2) OVER x AS u FROM t WINDOW x AS (PARTITION BY r ORDER BY p)),
a AS (SELECT r, p, w, v, u, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS n1,
  CASE WHEN p > 0 THEN count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY r, v, w) ELSE 0 END AS n2,
  CASE WHEN p > 1 THEN count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY r, u, v, w) ELSE 0 END AS n3 FROM g),
x AS (SELECT r, p, n1, n2, n3, (SELECT count(*) FROM t) - count(*) OVER (PARTITION BY r) AS n0, lag(n1) OVER y AS c1, lag(n2) OVER y AS c2 FROM a WINDOW y AS (PARTITION BY r ORDER BY p)),
s AS (SELECT r, sum(CASE WHEN n3 > 0 THEN log10(n3 / c2)
  WHEN n2 > 0 THEN log10(n2 / c1) + (least(p, 2) - 1) * log10({backoff})
  WHEN n1 > 0 THEN log10(n1 / n0) + least(p, 2) * log10({backoff})
  ELSE (least(p, 2) + 1) * log10({backoff}) - log10(greatest(n0, 1)) END) AS score, sum(CASE WHEN n3 > 0 THEN 1 ELSE 0 END) AS seen FROM x GROUP BY r)
SELECT doc_id, len(ws) AS n_tokens, CAST(coalesce(seen, 0) AS BIGINT) AS n_seen, round(coalesce(score, 0), 4) AS log10_score,
  CASE WHEN len(ws) > 0 THEN round(score / len(ws), 6) END AS mean_log10 FROM d LEFT JOIN s USING (r)"""

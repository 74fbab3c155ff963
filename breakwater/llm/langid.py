"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.common import text_and_id

#: n-grams of a profile, and the longest n-gram.
PROFILE, LONGEST = 300, 3
#: Documents of each language that profiles are learned from, about: those of the smallest hashes.
SAMPLE = 2000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (three code points of 21 bits each) and their counts in a whole text, within words.

    Words are lower-cased runs of letters with a space on either side. Sorted by n-gram.
    """
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    s, letter = np.where(letter, codes, 32)[keep], letter[keep]
    if len(s) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = (s[:-1] << 42) | (s[1:] << 21)
    triples = (pairs[:-1] | s[2:])[letter[1:-1]]
    return np.unique(np.concatenate([s[letter] << 42, pairs, triples]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, by count and then by n-gram."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """Profiles of the learned languages; ``predict`` compares a text with each of them."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), PROFILE, np.int64)
        self.missing = len(self.keys)
        for j, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.keys, np.array(profiles[name], np.int64)), j] = np.arange(len(profiles[name]))
        self.absent = self.ranks == PROFILE

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the out-of-place distance as a share of the largest possible."""
        mine = ranked(*grams(text or ""))
        if not len(mine) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, mine)
        at[(at >= self.missing) | (self.keys[np.minimum(at, self.missing - 1)] != mine)] = self.missing
        apart = np.abs(self.ranks[at] - np.arange(len(mine))[:, None])
        apart[(at == self.missing)[:, None] | self.absent[at]] = PROFILE
        total = apart.sum(axis=0)
        best = int(np.argmin(total))
        return self.languages[best], float(1 - total[best] / (PROFILE * len(mine)))


def learn(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> Profiles:
    """Profiles of each language of the given rows (null texts and languages are no rows).

    Learns from about ``sample`` documents of each language, whole texts, picked by a hash
    of id and text (so copies of one text don't come together); all their n-grams count.
    """
    df = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)).alias("at")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in df.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({})
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int((1 << 30) * min(1.0, sample / n)))])
    picked = df.where(F.col("at") < F.element_at(limit, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                seen.setdefault(lang, []).append(grams(text.as_py()))
            for lang, got in seen.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([c for _, c in got]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    counted = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.groupBy("lang").agg(F.expr(f"slice(array_sort(collect_list(struct(-n as n, gram))), 1, {PROFILE})").alias("best"))
    return Profiles({r["lang"]: [x["gram"] for x in r["best"]] for r in best.collect()})


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row, from the whole text.

    ``und`` with score 0 for a null text or one without a letter. Ties go to the first
    language by name; repeated rows and null ids stay; other columns are not read.
    """
    df = text_and_id(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [profiles.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is held out: crc32 of its id as text leaves 0 by 5; a null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def split_and_identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the rows that are not held out.

    A row with a null doc_id is judged but teaches nothing and is not held out; null texts and texts
    without a letter are ``und``; languages at equal distance go by their names; repeated
    rows are judged each; an empty table, or one without a labelled text, gives ``und`` or nothing.
    """
    profiles = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Problem 6: held-out test passages inside a training corpus.

Each Arrow batch of the corpus is a shard with its own suffix array over word
numbers; every suffix of every test text is looked up in it by binary search.
The array holds only suffixes that can match: a passage of ``min_words`` words
needs as many words in a row that occur in the test texts, so positions with a
shorter such run are left out.  Nothing is lost by that, and names and numbers
that no test text has cut most of a corpus away.

Nothing is shuffled but the found rows.  The test texts go to the executors
whole; their size is measured first, and more than ``block_chars`` characters
are worked off in blocks, one pass over the corpus for each.

Words are runs of letters and digits after mapping of look-alike characters,
removal of markup and case folding.

Defined results: null or short texts match nothing; items with fewer than
``min_words`` words match nothing; repeated rows count once; extra columns are
ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.fold import strip_markup

MIN_WORDS = 12
BLOCK_CHARS = 32_000_000

_WORD = re.compile(r"[^\W_]+")
_MATCH = "doc_id long, item_id long, match_words int, doc_word int, item_word int"


def words(text: str | None) -> list[str]:
    return _WORD.findall(strip_markup(text).casefold()) if text else []


def _digits(ids: np.ndarray) -> np.ndarray:
    """Word numbers as three bytes of 1..255 each, so that byte order is number order and no byte is 0."""
    v = ids.astype(np.int64)
    return np.stack([v // 65025 + 1, v // 255 % 255 + 1, v % 255 + 1], axis=-1).astype(np.uint8)


class TestIndex:
    """Suffixes of the test texts, for lookup in a shard's suffix array."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str | None]], min_words: int):
        self.m, self.vocab = min_words, {}
        tokens: list[int] = []
        item_of: list[int] = []
        self.start: dict[int, int] = {}
        for item, text in items:
            w = words(text)
            if len(w) < min_words:
                continue
            self.start[item] = len(tokens)
            tokens += [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w] + [0]
            item_of += [item] * (len(w) + 1)
        if len(self.vocab) >= 255**3 - 1:
            raise ValueError("too many different words in one block of test texts; lower block_chars")
        self.tokens = np.asarray(tokens + [0] * min_words, dtype=np.int64)
        self.item_of = np.asarray(item_of, dtype=np.int64)
        self.pos = _runs(self.tokens, min_words)
        self.keys = _windows(self.tokens, self.pos, min_words)


_HELD: dict[str, TestIndex] = {}


def _index(name: str, items: list[tuple[int, str | None]], min_words: int) -> TestIndex:
    """The index of a block of tests, made once in each worker process; a worker holds one at a time."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = TestIndex(items, min_words)
    return _HELD[name]


def _runs(tokens: np.ndarray, m: int) -> np.ndarray:
    """Positions from which m words in a row are known (number above 0)."""
    n = len(tokens)
    if n < m:
        return np.empty(0, dtype=np.int64)
    bad = np.concatenate([[0], np.cumsum(tokens <= 0)])
    return np.flatnonzero(bad[m:] - bad[:-m] == 0)


def _windows(tokens: np.ndarray, pos: np.ndarray, m: int) -> np.ndarray:
    if not len(pos):
        return np.empty(0, dtype=f"S{3 * m}")
    w = _digits(np.lib.stride_tricks.sliding_window_view(tokens, m)[pos]).reshape(len(pos), 3 * m)
    return np.ascontiguousarray(w).view(f"S{3 * m}").ravel()


def search_shard(index: TestIndex, ids: list[int], texts: list[str | None]) -> dict[str, np.ndarray]:
    """Longest verbatim match for each pair of document and item in one shard."""
    m, vocab = index.m, index.vocab
    tokens: list[int] = []
    starts: list[int] = []
    for t in texts:
        starts.append(len(tokens))
        tokens += [vocab.get(w, 0) for w in words(t)]
        tokens.append(0)
    corpus = np.asarray(tokens + [0] * m, dtype=np.int64)
    pos = _runs(corpus, m)
    keys = _windows(corpus, pos, m)
    order = np.argsort(keys, kind="stable")
    pos, keys = pos[order], keys[order]
    lo, hi = np.searchsorted(keys, index.keys, "left"), np.searchsorted(keys, index.keys, "right")
    hits = hi - lo
    q = np.repeat(np.arange(len(hits)), hits)
    if not len(q):
        return {}
    p = pos[np.repeat(lo, hits) + np.arange(len(q)) - np.repeat(np.cumsum(hits) - hits, hits)]
    t = index.pos[q]
    length = np.full(len(p), m)
    live = np.arange(len(p))
    while len(live):
        a, b = corpus[np.minimum(p[live] + length[live], len(corpus) - 1)], index.tokens[np.minimum(t[live] + length[live], len(index.tokens) - 1)]
        live = live[(a > 0) & (a == b)]
        length[live] += 1
    s = np.asarray(starts)
    doc = np.searchsorted(s, p, "right") - 1
    item = index.item_of[t]
    best = np.lexsort((p, -length, item, doc))
    first = np.ones(len(best), dtype=bool)
    first[1:] = (doc[best][1:] != doc[best][:-1]) | (item[best][1:] != item[best][:-1])
    k = best[first]
    begin = np.asarray([index.start[i] for i in item[k]], dtype=np.int64)
    return {
        "doc_id": np.asarray(ids)[doc[k]], "item_id": item[k], "match_words": length[k].astype(np.int32),
        "doc_word": (p[k] - s[doc[k]]).astype(np.int32), "item_word": (t[k] - begin).astype(np.int32),
    }


def leaked_passages(
    corpus: DataFrame, tests: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "problem", min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Longest passage of ``min_words`` words or more for each document and item.

    Columns: ``doc_id, item_id, match_words, doc_word, item_word`` (places are
    word numbers from 0).
    """
    spark = corpus.sparkSession
    items = tests.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_chars))
    docs = corpus.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        # at most about block_chars characters
        held = spark.sparkContext.broadcast([(r.i, r.t) for r in part.toLocalIterator()])
        name = uuid.uuid4().hex

        def search(batches: Iterator[pd.DataFrame], held=held, name=name) -> Iterator[pd.DataFrame]:
            for batch in batches:
                index = _index(name, held.value, min_words)
                if found := search_shard(index, batch["doc_id"].tolist(), batch["text"].tolist()):
                    yield pd.DataFrame(found)

        found = docs.mapInPandas(search, _MATCH)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], T._parse_datatype_string(_MATCH))
    return out.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("match_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("b")
    ).select(
        "doc_id", "item_id", F.col("b.match_words").alias("match_words"), (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word")
    )


def without_leaks(corpus: DataFrame, passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The corpus without documents that hold a test passage."""
    hit = passages.select(F.col("doc_id").alias(id_col)).distinct()
    return corpus.join(hit, id_col, "left_anti")


def leak_report(passages: DataFrame, tests: DataFrame, item_col: str = "item_id") -> DataFrame:
    """Per test item: documents that hold some of it and the longest passage."""
    per = passages.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("match_words").cast("long").alias("longest"))
    return (
        tests.select(F.col(item_col).cast("long").alias("item_id")).distinct().join(per, "item_id", "left")
        .select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest", F.lit(0)).alias("longest"))
    )

"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at the 1s of a mask laid over a text; the 0s may hold anything, so a
substituted word spoils only the placements that read it. Every placement in every text is looked up among
the benchmark's, and around each hit text and item are compared word by word along the hit's diagonal: of
all runs with at least four fifths equal words, wherever their differences lie, the one that matches most is
taken. A text is contaminated where such a run holds enough of the item's words.

The benchmark's seeds go to every task in blocks of bounded size, one pass over the texts for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import MARKS, encoded, mix, word_hashes
from .tables import keep_rows, map_rows

#: Weight 6, chosen so that one of them fits any 14 words with 2 substituted and any 15, 20 or 25 with a fifth
#: substituted, as tests show; any run of LEAST matches and four fifths equal words holds one of these.
MASKS = ("1101101011", "110011000111", "11101000010011", "10110100111", "111111", "110001010011")
#: Words that a run must match; of an item with fewer than that by a fifth, four fifths of its words.
LEAST = 12
#: Seeds of a benchmark block (16 bytes each, and a filter of 1 MB), which every task holds.
BLOCK = 1 << 20
_BITS = 23
#: Placements of a text's seeds in items that are laid out at a time.
PLACEMENTS = 1 << 20


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each placement of the mask."""
    at = [i for i, c in enumerate(mask) if c == "1"]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in at:
            total = (total + words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return total


def needed(n: int) -> int:
    """Matches that a run needs for an item of n words."""
    return min(LEAST, -(-4 * n // 5))


def short_masks(n: int) -> set[str]:
    """Masks for items of n words, fewer than MASKS are made for: any two of so many parts that the
    substitutions the item may have leave two whole."""
    spare = n - needed(n)
    if not spare:
        return {"1" * n}
    cuts = [n * k // (spare + 2) for k in range(spare + 3)]
    return {"".join("1" if cuts[a] <= i < cuts[a + 1] or cuts[b] <= i < cuts[b + 1] else "0" for i in range(n)).strip("0") for a, b in combinations(range(spare + 2), 2)}


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """Matches, start and end of the run that matches most, of those with at least four fifths equal words.

    It starts and ends at a match.
    """
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    matched = np.concatenate([[0], np.cumsum(same)])
    # the first start from which the score doesn't fall up to each end
    start = np.searchsorted(-np.minimum.accumulate(score), -score)
    end = int(np.argmax(matched - matched[start]))
    at = np.nonzero(same[start[end] : end])[0]
    return (len(at), int(start[end] + at[0]), int(start[end] + at[-1]) + 1) if len(at) else (0, 0, 0)


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of runs of letters and digits, in lower case."""
    return word_hashes(encoded([t.lower() if t else t for t in texts]), MARKS)


class Benchmark:
    """A block of items with the seeds of all masks; items too short for the masks have some of their own."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        short = {len(w) for w in words if 0 < len(w) < max(map(len, MASKS))}
        own = {n: short_masks(n) for n in short}
        self.masks = [*MASKS, *sorted(set().union(*own.values()) - set(MASKS))]
        self.tables = []
        for mask in self.masks:
            of = [(k, seeds(w, mask)) for k, w in enumerate(words) if mask in MASKS or mask in own.get(len(w), ())]
            seed = np.concatenate([s for _, s in of] or [np.zeros(0, np.uint64)])
            item = np.concatenate([np.full(len(s), k) for k, s in of] or [np.zeros(0, int)]).astype(np.int32)
            at = np.concatenate([np.arange(len(s)) for _, s in of] or [np.zeros(0, int)]).astype(np.int32)
            order = np.argsort(seed, kind="stable")
            known = np.zeros(1 << _BITS, bool)
            known[(seed >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((seed[order], item[order], at[order], np.packbits(known)))

    def need(self, k: int) -> int:
        """Matches that a run needs for this item."""
        return needed(len(self.words[k]))

    def hits(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of every placement that text and item share."""
        out: set[tuple[int, int]] = set()
        for mask, (seed, item, at, known) in zip(self.masks, self.tables, strict=True):
            s = seeds(words, mask)
            if not len(s) or not len(seed):
                continue
            bucket = (s >> np.uint64(64 - _BITS)).astype(np.int64)
            place = np.nonzero(known[bucket >> 3] >> (7 - (bucket & 7)) & 1)[0]
            if not len(place):
                continue
            low, high = np.searchsorted(seed, s[place], "left"), np.searchsorted(seed, s[place], "right")
            total = np.concatenate([[0], np.cumsum(high - low)])
            # a seed that text and items repeat has very many placements: they are laid out some at a time
            cuts = [*np.searchsorted(total, np.arange(0, total[-1], PLACEMENTS)).tolist(), len(place)]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                n = (high - low)[first:last]
                if not n.sum():
                    continue
                where = np.repeat(low[first:last] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                diagonal = np.repeat(place[first:last], n) - at[where]
                found = np.unique((item[where].astype(np.int64) << np.int64(40)) + diagonal + (1 << 39))
                out.update(zip((found >> np.int64(40)).tolist(), ((found & ((1 << 40) - 1)) - (1 << 39)).tolist(), strict=True))
        return out

    def overlaps(self, words: np.ndarray) -> list[dict]:
        """The best run of each item that the text holds enough of."""
        best: dict[int, dict] = {}
        for k, d in sorted(self.hits(words)):
            item = self.words[k]
            a, b = max(0, -d), min(len(item), len(words) - d)
            same = item[a:b] == words[a + d : b + d]
            if np.count_nonzero(same) < self.need(k):
                continue
            matched, start, end = best_run(same)
            if matched >= self.need(k) and (k not in best or matched > best[k]["matched"]):
                best[k] = {"item_id": self.ids[k], "matched": matched, "run": end - start, "item_words": len(item), "word_start": a + d + start}
        return list(best.values())


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Benchmark]:
    """The items in blocks of at most BLOCK seeds (an item alone may be longer)."""
    ids, words, size = [], [], 0
    for r in benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).orderBy("id", "text").toLocalIterator():
        w = words_of([r.text])[0]
        if not len(w):
            continue
        if size and size + len(w) * len(MASKS) > BLOCK:
            yield Benchmark(ids, words)
            ids, words, size = [], [], 0
        ids.append(r.id)
        words.append(w)
        size += len(w) * len(MASKS)
    if ids:
        yield Benchmark(ids, words)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each text and benchmark item of which it holds a run: ids, matched and run in words, the
    item's words, and the run's first word in the text.

    Null or empty texts and items, and those without letters and digits, match nothing. An item of few
    words is found by the same rule, so an item of one word marks every text with that word: leave such items out of the
    benchmark where that isn't wanted. A text of any length is searched whole; of several runs of an item the one that matches most is told, of equal ones the first. An item
    repeated under several ids is reported under each; a repeated text is reported again. Empty tables give an
    empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, matched int, run int, item_words int, word_start bigint"
    out = None
    for block in benchmark_blocks(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(block)

        def run(cols, sent=sent):
            held = sent.value
            for s in range(0, len(cols["id"]), 512):
                ids = cols["id"][s : s + 512]
                found = [(i, o) for i, w in zip(ids, words_of(cols["text"][s : s + 512]), strict=True) for o in held.overlaps(w)]
                yield {id_col: [i for i, _ in found], item_col: [o["item_id"] for _, o in found], **{c: [o[c] for _, o in found] for c in ("matched", "run", "item_words", "word_start")}}

        part = map_rows(slim, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns whatever their names, whose text overlaps no benchmark item; nothing is shuffled.

    Null, empty, long and repeated texts, and empty tables, as in ``find_overlaps``: a row without a text stays.
    """
    for block in benchmark_blocks(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        docs = keep_rows(docs, text_col, lambda texts, sent=sent: [not sent.value.overlaps(w) for w in words_of(texts)])
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_overlaps(docs, items)

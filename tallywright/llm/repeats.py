"""Removal of passages that repeat anywhere: a logarithmic family of suffix arrays behind content-chosen buckets.

A byte goes if a string of ``length`` bytes over it also starts somewhere else in the corpus. Equal strings
have equal minimizers (the k-gram of least hash within them), so a text is cut into stretches whose windows
share one minimizer, and equal windows always lie in stretches of one key. Most keys occur once: nothing there
repeats. Stretches with equal bytes repeat in full, which counting tells. What is left are keys with several
different stretches, at the edges of repeated passages: one copy of each goes, by key, to a task that compares
windows; those of a key of very many stretches are dealt by their own content.

The index is a logarithmic family in both places. Across batches (``RepeatIndex``) a level is a table of stretches
in order of key; within a task (``SuffixFamily``) it is an array of windows in order of content. What is new gets a
level of its own, is scanned against every level for equal content, and levels of equal size merge.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from .shingles import _INVERSE, _M, _powers, encoded, mix, runs
from .tables import map_rows

#: Bytes of a k-gram; of a text that is worked on at a time, with a window's overlap; windows of an index batch.
GRAM, CHUNK, BATCH = 40, 1 << 20, 1 << 14
#: Windows that one index task is meant to hold, stretches of a key that go to one task, and those for each part of a
#: key that has more.
TASK_WINDOWS, HOT, PART = 1 << 18, 1024, 256


def stretches(texts: list[bytes], length: int, gram: int = GRAM):
    """For each text: keys, content hashes, first windows and window counts of its stretches."""
    gram = min(gram, max(1, length // 2))
    out = [[] for _ in texts]
    parts = []  # (text, offset, bytes): long texts in overlapping parts
    for i, t in enumerate(texts):
        if len(t) >= length:
            for a in range(0, len(t) - length + 1, CHUNK):
                parts.append((i, a, t[a : a + CHUNK + length - 1]))
    span = length - gram + 1
    for first, last in runs([p for _, _, p in parts], CHUNK):
        chosen = parts[first:last]
        buf = np.frombuffer(b"".join(p for _, _, p in chosen), np.uint8)
        n = len(buf)
        with np.errstate(over="ignore"):
            back = _powers(n, _INVERSE)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(n, _M))])
            key = mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
        low = np.uint64((1 << 22) - 1)
        least = (key & ~low) | np.arange(len(key), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & low).astype(np.int64)  # the minimizer of the window at each place
        sizes = np.array([len(p) for _, _, p in chosen])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        valid = np.zeros(len(at) + 1, np.int8)
        np.add.at(valid, starts, 1)
        np.add.at(valid, ends - length + 1, -1)
        valid = np.cumsum(valid[:-1]).astype(bool)
        new = valid.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        new[starts] = True
        begin = np.nonzero(new)[0]
        owner = np.searchsorted(ends, begin, "right")
        stop = np.append(begin[1:], len(at))
        stop = np.minimum(stop, ends[owner] - length + 1)  # past the last window
        with np.errstate(over="ignore"):
            body = (sums[stop + length - 1] - sums[begin]) * back[begin]
            content = mix(body + (at[begin] - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (stop - begin).astype(np.uint64))
        cuts = np.searchsorted(owner, np.arange(len(chosen) + 1))
        for (i, offset, _), a, b, s in zip(chosen, cuts[:-1], cuts[1:], starts, strict=True):
            out[i].append((key[at[begin[a:b]]].view(np.int64), content[a:b].view(np.int64), begin[a:b] - s + offset, (stop - begin)[a:b]))
    none = (np.zeros(0, np.int64),) * 4
    return [tuple(np.concatenate([p[c] for p in o]) for c in range(4)) if o else none for o in out]


class SuffixFamily:
    """Suffix arrays in levels of doubling size; adding a batch finds windows that lie in any of them or twice in it."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[list[np.ndarray]] = []  # windows in order of content, who owns them, whether they repeat
        self.repeated: list[np.ndarray] = []

    def add(self, data: list[bytes], owners: np.ndarray) -> None:
        """data: stretches; owners: one number for each of their windows."""
        view = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(d, np.uint8), self.length) for d in data]
        windows = np.ascontiguousarray(np.concatenate(view)).view(f"S{self.length}").ravel()
        order = np.argsort(windows, kind="stable")
        windows, owners = windows[order], owners[order]
        new = np.ones(len(windows), bool)
        new[1:] = windows[1:] != windows[:-1]
        group = np.cumsum(new) - 1
        first = np.nonzero(new)[0]
        seen = np.zeros(len(first), bool)
        twice = np.bincount(group) > 1
        for held, _, dup in self.levels:
            at = np.minimum(np.searchsorted(held, windows[first]), len(held) - 1)
            hit = held[at] == windows[first]
            dup[at[hit]] = True
            seen |= hit
        # owners of windows known before, or but the first owner of a window that is new, are known to repeat
        self.repeated.append(owners[seen[group] | ~new])
        fresh = first[~seen]
        if len(fresh):
            self.levels.append([windows[fresh], owners[fresh], twice[~seen].copy()])
        while len(self.levels) > 1 and len(self.levels[-1][0]) * 2 > len(self.levels[-2][0]):
            b, a = self.levels.pop(), self.levels.pop()
            merged = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.argsort(merged[0], kind="stable")  # merges two sorted runs
            self.levels.append([x[order] for x in merged])

    def finish(self) -> np.ndarray:
        """Owners of all windows that repeat."""
        return np.concatenate([*self.repeated, *(owner[dup] for _, owner, dup in self.levels), np.zeros(0, np.int64)])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_hashes(data: bytes, length: int) -> np.ndarray:
    """A 64-bit hash of the window at each place."""
    buf = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(len(buf), _M))])
        return mix((sums[length:] - sums[:-length]) * _powers(len(buf), _INVERSE)[: len(buf) - length + 1]).view(np.int64)


#: Of a stretch, or of its windows that go to one part of a key.
PIECES = "key bigint, part bigint, row bigint, first bigint, data binary, windows array<bigint>, starts array<bigint>"


def dealt(key: int, deal: int, row: int, first: int, data: bytes, length: int):
    """A stretch as it is, or for a key that is dealt its windows by their own content, as rows of PIECES."""
    if not deal:
        yield key, 0, row, first, data, None, None
        return
    h = window_hashes(data, length).view(np.uint64)
    part = (h >> np.uint64(32)) % np.uint64(deal)
    own = mix(h ^ np.uint64(key & (1 << 64) - 1)).view(np.int64)
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
        yield key, int(part[at[0]]), row, None, None, own[at], first + at


def repeated_windows(pieces: DataFrame, length: int, tasks: int) -> DataFrame:
    """row and spans of the windows that lie in several pieces of a key: whole stretches by an index family a task,
    dealt windows by their hashes."""

    def index(batches):
        family, rows_, firsts, data, owners, size = SuffixFamily(length), [], [], [], [], 0
        counts: list[int] = []
        hashed: list[tuple[int, np.ndarray, np.ndarray]] = []

        def settle():
            nonlocal data, owners, size
            if data:
                family.add(data, np.concatenate(owners))
            data, owners, size = [], [], 0

        def out(row, start):
            """Rows in order of row and start as batches of spans."""
            import pyarrow as pa

            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            new = np.ones(len(row), bool)
            new[1:] = row[1:] != row[:-1]
            ahead = new.copy()
            ahead[1:] |= start[1:] > start[:-1] + length
            begin = np.nonzero(ahead)[0]
            last = np.append(begin[1:], len(row)) - 1
            spans = pa.StructArray.from_arrays([pa.array(start[begin]), pa.array(start[last] + length)], names=["a", "b"])
            cuts = np.append(np.searchsorted(begin, np.nonzero(new)[0]), len(begin))
            yield pa.RecordBatch.from_arrays([pa.array(row[new]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans).cast(kind)], names=["row", "spans"])

        done = 0
        for batch in batches:
            cols = batch.select(["row", "first", "data"]).to_pydict()
            for i, (row, first, body) in enumerate(zip(cols["row"], cols["first"], cols["data"], strict=True)):
                if body is None:
                    hashed.append((row, *(batch.column(c)[i].values.to_numpy() for c in ("windows", "starts"))))
                    continue
                n = len(body) - length + 1
                rows_.append(row)
                firsts.append(first)
                counts.append(n)
                data.append(body)
                owners.append(np.arange(done, done + n))
                done += n
                size += n
                if size >= BATCH:
                    settle()
        settle()
        if counts:
            found = np.unique(family.finish())
            base = np.concatenate([[0], np.cumsum(counts)])  # of each stretch's windows, in the numbering of owners
            stretch = np.searchsorted(base, found, "right") - 1
            start, row = np.array(firsts)[stretch] + found - base[stretch], np.array(rows_)[stretch]
            order = np.lexsort((start, row))
            if len(order):
                yield from out(row[order], start[order])
        if hashed:
            row = np.repeat(np.array([r for r, _, _ in hashed]), [len(w) for _, w, _ in hashed])
            start = np.concatenate([x for _, _, x in hashed])
            _, group, n = np.unique(np.concatenate([w for _, w, _ in hashed]), return_inverse=True, return_counts=True)
            again = np.nonzero(n[group] > 1)[0]
            order = again[np.lexsort((start[again], row[again]))]
            if len(order):
                yield from out(row[order], start[order])

    return pieces.repartition(tasks, "key", "part").mapInArrow(index, "row bigint, spans array<struct<a:bigint,b:bigint>>")


def merged(spans: DataFrame) -> DataFrame:
    """row and the union of its spans."""

    def join(cols):
        yield {"row": cols["row"], "spans": [[{"a": a, "b": b} for a, b in union([(x["a"], x["b"]) for x in s])] for s in cols["spans"]]}

    return map_rows(spans.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), join, "row bigint, spans array<struct<a:bigint,b:bigint>>")


class RepeatIndex:
    """An index family of all batches added so far, as tables in the shared folder.

    A level holds one entry for each different stretch: key, content, how many copies, and the place of one of them,
    in order of key. A new batch is cut into stretches of its own, scanned against every level by key, and enters as a
    level; levels of about equal size merge, so a stretch is rewritten a logarithmic number of times. Bytes that a
    batch shares with earlier ones go from both. The tables of earlier batches must stay readable.
    """

    def __init__(self, spark, length: int = 200, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT):
        self.spark, self.length, self.id_col, self.text_col, self.hot = spark, length, id_col, text_col, hot
        self.scratch = Scratch(spark, "repeats")
        self.levels: list[tuple[DataFrame, int]] = []
        self.who: list[DataFrame] = []  # of each batch: row, id, digest of long texts
        self.texts: list[DataFrame] = []
        self.found: list[DataFrame] = []  # row, spans

    def add(self, docs: DataFrame) -> None:
        spark, length, scratch = self.spark, self.length, self.scratch
        kind = dict(docs.dtypes)[self.id_col]
        slim = docs.select(F.col(f"`{self.id_col}`").alias("id"), F.coalesce(F.col(f"`{self.text_col}`"), F.lit("")).alias("text"))

        def cut(cols):
            for s in range(0, len(cols["id"]), 512):
                texts = encoded(cols["text"][s : s + 512])
                found = stretches(texts, length)
                yield {
                    "id": cols["id"][s : s + 512], "digest": [hashlib.sha256(t).hexdigest() for t in texts],
                    "parts": [[{"key": k, "content": c, "first": f, "n": n} for k, c, f, n in zip(*(x.tolist() for x in z), strict=True)] for z in found],
                }

        part = "struct<key:bigint,content:bigint,first:bigint,n:bigint>"
        rows = map_rows(slim.filter(F.octet_length("text") >= length), cut, f"id {kind}, digest string, parts array<{part}>")
        # numbers of rows don't meet those of earlier batches
        rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id() + F.lit(len(self.who) << 56)), "rows")
        self.who.append(rows.select("row", "id", "digest"))
        self.texts.append(slim)
        each = rows.select("row", F.inline("parts"))
        bodies = scratch.write(each.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct("row", "first", "n")).alias("one")), "bodies")
        end = F.col("first") + F.col("n") - 1 + length

        # stretches that repeat in full
        again = bodies.filter("copies > 1").select("key", "content")
        held = self._levels()
        if held is not None:
            # merge-scan: entries of the levels at the batch's keys
            held = scratch.write(held.join(bodies.select("key").distinct(), "key", "left_semi"), "held")
            again = again.union(bodies.join(held.select("key", "content"), ["key", "content"], "left_semi").select("key", "content")).distinct()
        full = each.join(again, ["key", "content"], "left_semi").select("row", F.col("first").alias("a"), end.alias("b"))
        if held is not None:
            old = held.filter("copies = 1").join(bodies.select("key", "content"), ["key", "content"], "left_semi")
            full = full.union(old.select("one.*").select("row", F.col("first").alias("a"), end.alias("b")))
        self.found.append(scratch.write(full.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "full"))

        # of keys with several different stretches one copy of each
        entries = bodies if held is None else bodies.unionByName(held)
        several = entries.groupBy("key").agg(F.min("content").alias("x"), F.max("content").alias("y"), F.count("*").alias("contents")).filter("x <> y")
        deal = F.when(F.col("contents") > self.hot, F.ceil(F.col("contents") / PART)).otherwise(F.lit(0)).cast("long")
        mixed = entries.join(several.select("key", deal.alias("deal")), "key").select("key", "deal", "one.*").distinct()
        mixed = scratch.write(mixed, "mixed")
        total = mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WINDOWS))
        edges = repeated_windows(self._pieces(mixed), length, tasks)
        self.found.append(scratch.write(merged(edges), "edges"))
        scratch.drop(mixed, *([] if held is None else [held]))
        self._enter(bodies)

    def _levels(self) -> DataFrame | None:
        out = None
        for t, _ in self.levels:
            out = t if out is None else out.unionByName(t)
        return out

    def _enter(self, bodies: DataFrame) -> None:
        """The batch becomes a level; while the last is more than half of the one before, both become one."""
        self.levels.append((bodies, bodies.count()))
        while len(self.levels) > 1 and 2 * self.levels[-1][1] > self.levels[-2][1]:
            (x, _), (y, _) = self.levels.pop(), self.levels.pop()
            both = x.unionByName(y).groupBy("key", "content").agg(F.sum("copies").alias("copies"), F.min("one").alias("one"))
            both = self.scratch.write(both.repartitionByRange("key").sortWithinPartitions("key", "content"), "level")
            self.levels.append((both, both.count()))
            self.scratch.drop(x, y)

    def _pieces(self, mixed: DataFrame) -> DataFrame:
        """The stretches, as rows of PIECES."""
        length = self.length
        cuts = mixed.groupBy("row").agg(F.collect_list(F.struct("key", "deal", "first", "n")).alias("cuts"))

        def take(cols):
            import zstandard

            z = zstandard.ZstdDecompressor()
            for body, cuts in zip(cols["body"], cols["cuts"], strict=True):
                data = z.decompress(body)
                rows = [x for c in cuts for x in dealt(c["key"], c["deal"], c["row"], c["first"], data[c["first"] : c["first"] + c["n"] - 1 + length], length)]
                yield dict(zip(("key", "part", "row", "first", "data", "windows", "starts"), zip(*rows, strict=True), strict=True))

        out = None
        for slim, who in zip(self.texts, self.who, strict=True):
            wanted = cuts.join(who, "row")
            of_row = F.transform("cuts", lambda c: F.struct(F.col("row"), c["key"].alias("key"), c["deal"].alias("deal"), c["first"].alias("first"), c["n"].alias("n")))
            wanted = wanted.groupBy(F.col("id").alias("id_"), F.col("digest").alias("digest_")).agg(F.flatten(F.collect_list(of_row)).alias("cuts"))
            same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_"))
            found = packed(slim).join(wanted, same).select("id", "digest", "body", "cuts").dropDuplicates(["id", "digest"])
            found = map_rows(found, take, PIECES)
            out = found if out is None else out.unionByName(found)
        return out

    def stripped(self, batch: int, texts_out: bool = False) -> DataFrame:
        """Of each row of a batch: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the bytes kept."""
        spans = self.found[0]
        for t in self.found[1:]:
            spans = spans.union(t)
        slim = self.texts[batch]
        kind = dict(slim.dtypes)["id"]
        spans = spans.join(self.who[batch], "row").groupBy(F.col("id").alias("id_"), F.col("digest").alias("digest_")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
        spans = self.scratch.write(spans, "spans")

        def strip(cols):
            import zstandard

            z = zstandard.ZstdDecompressor()
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for body, digest, found in zip(cols["body"], cols["digest"], cols["spans"], strict=True):
                data = z.decompress(body)
                gone = union([(s["a"], s["b"]) for s in found or ()])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(left))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest() if gone else digest)
                out["kept"].append(left if texts_out else None)
            yield {"id": cols["id"], **out}

        same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_"))
        out = packed(slim).join(spans, same, "left").select("id", "digest", "body", "spans")
        out = map_rows(out, strip, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
        return out.select(F.col("id").alias(self.id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts_out else []))


def packed(slim: DataFrame) -> DataFrame:
    """id, digest and body: the text's bytes, compressed, for a shuffle of whole texts."""
    kind = dict(slim.dtypes)["id"]

    def pack(cols):
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        for s in range(0, len(cols["id"]), 1024):
            texts = encoded(cols["text"][s : s + 1024])
            yield {"id": cols["id"][s : s + 1024], "digest": [hashlib.sha256(t).hexdigest() for t in texts], "body": [c.compress(t) for t in texts]}

    return map_rows(slim, pack, f"id {kind}, digest string, body binary")


def remove_repeats(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the bytes kept.

    Strings are compared as UTF-8 bytes of the input and never cross rows. A null text is empty; a text shorter
    than ``length`` keeps everything; one of any length is cut in parts that overlap, which changes no result. Rows
    that repeat a long text lose all of it, whichever comes first. An empty table gives an empty result; other columns
    are ignored, whatever their names. Texts are one batch of a ``RepeatIndex``, to which more can be added.

    Stretches are equal if the 64-bit hashes of their minimizer and of their bytes both are: two different ones of a
    key pass as equal about once in 2^64 pairs. Windows of ordinary keys are compared byte by byte, those of keys with
    more than ``hot`` different stretches by such hashes; it changes no result.
    """
    index = RepeatIndex(docs.sparkSession, length, id_col, text_col, hot)
    index.add(docs)
    return index.stripped(0, texts_out)


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 200 bytes or more taken out of every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Repeated runs of lines, found by winnowing and deleted where they come later.

Lines with a word are hashed. A window is the least run of neighbouring lines that
has ``min_words`` words, taken forward from each line and backward from each line.
Every window selects its minimal line hash (the first of equal ones), and the
selected lines are the document's fingerprints: the choice depends on a window's
lines alone, so two places that share a run of that many words share fingerprints.

Fingerprints that stand in one place only are dropped. The positions of the others
are joined, each through the windows that selected it, so that a line which very many
documents have is still split by what stands around it and no pairs of positions
are made. A match is extended both ways by the windows before and behind it: a longer
run is the union of the forward windows from each of its lines and the backward
windows to each of its lines. Those all match with their own first place, which may
lie in different documents; extending against one earlier copy would lose a run
whose only earlier copy is in another. Windows are compared by 128 bits, two
independent hashes of their lines' bytes. Of a later run, the lines outside its
first occurrence are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_batches
from .textkit import OTHER_SEED, SEED, Texts, as_long, mix, texts

MIN_WORDS = 50
OFTEN = 1 << 12  # a fingerprint is frequent if it has more than this part of all windows
_U = np.uint64


def lines_of(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and words of every line in a slice, and each document's first line (one more at the end)."""
    feeds = np.flatnonzero(t.buf == 10)
    doc_of_feed = np.searchsorted(t.offs[1:], feeds, "right")
    doc = np.concatenate([np.arange(t.n), doc_of_feed])
    begin = np.concatenate([t.offs[:-1], feeds + 1])
    end = np.concatenate([t.offs[1:], feeds])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    order = np.lexsort((end, np.concatenate([np.arange(t.n), doc_of_feed])))
    end = end[order]
    starts, _, _ = t.words()
    words = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
    return begin, end, words, np.searchsorted(doc, np.arange(t.n + 1))


def _chained(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run of line hashes, item after item."""
    out = hashes[first].copy()
    at = np.flatnonzero(first < last)
    step = 1
    while len(at):
        out[at] = mix(out[at] * _U(3) + hashes[first[at] + step])
        step += 1
        at = at[first[at] + step <= last[at]]
    return out


def _minima(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the least hash in each run, the first of equal ones."""
    place = first.copy()
    at = np.flatnonzero(first < last)
    step = 1
    while len(at):
        other = first[at] + step
        place[at] = np.where(hashes[other] < hashes[place[at]], other, place[at])
        step += 1
        at = at[first[at] + step <= last[at]]
    return place


def windows(words: np.ndarray, edges: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every window, over lines with words; ``edges`` has each document's first line."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    begin, end = np.repeat(edges[:-1], np.diff(edges)), np.repeat(edges[1:], np.diff(edges))
    stop = np.searchsorted(total, total[:-1] + min_words)  # forward: lines at .. stop - 1
    ok = stop <= end
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1  # backward: lines back .. at
    fits = back >= begin
    both = np.unique(np.concatenate([at[ok] * (n + 1) + stop[ok] - 1, back[fits] * (n + 1) + at[fits]]))
    return both // (n + 1), both % (n + 1)


_PRINT = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64()), ("print", pa.int64()), ("lead", pa.bool_()), ("key", pa.int64()), ("key2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]
)
_PRINT_SQL = "doc_id long, mark long, print long, lead boolean, key long, key2 long, first int, last int"


def _prints(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The windows of each document with the fingerprint each selects; ``lead`` on one row of each selected place."""
    for b in batches:
        for t in texts(b.column(2)):
            begin, end, words, edges = lines_of(t)
            some = np.flatnonzero(words)
            bounds = np.searchsorted(some, edges)
            first, last = windows(words[some], bounds, min_words)
            if not len(first):
                continue
            hashes, others = (t.spans(begin[some], end[some], seed=x) for x in (SEED, OTHER_SEED))
            place = _minima(hashes, first, last)
            lead = np.zeros(len(place), bool)
            lead[np.unique(place, return_index=True)[1]] = True
            doc = np.searchsorted(bounds, first, "right") - 1
            at = pa.array(doc + t.first)
            start = edges[doc]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(as_long(hashes[place])), pa.array(lead), pa.array(as_long(_chained(hashes, first, last))),
                 pa.array(as_long(_chained(others, first, last))), pa.array((some[first] - start).astype(np.int32)), pa.array((some[last] - start).astype(np.int32))],
                schema=_PRINT,
            )


def _without(batches: Iterator[pa.RecordBatch], at: int, cuts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts without the runs in column ``cuts``, a slice of a batch at a time."""
    for b in batches:
        for t in texts(b.column(at)):
            part = b.slice(t.first, t.n)
            feeds = np.concatenate([[0], np.cumsum(t.buf == 10)])
            lines = pa.array(feeds[t.offs[1:]] - feeds[t.offs[:-1]] + 1, mask=part.column(at).is_null().to_numpy(zero_copy_only=False))
            gone, text = np.zeros(t.n, np.int64), part.column(at)
            cut = np.flatnonzero(part.column(cuts).is_valid().to_numpy(zero_copy_only=False))
            if len(cut):
                fresh = text.to_pylist()
                for i in cut.tolist():
                    rows = fresh[i].split("\n")
                    drop = np.zeros(len(rows) + 1, np.int64)
                    for x in part.column(cuts)[i].as_py():
                        drop[x["first"]] += 1
                        drop[x["last"] + 1] -= 1
                    drop = np.cumsum(drop)[:-1] > 0
                    gone[i] = int(drop.sum())
                    fresh[i] = "\n".join(r for r, d in zip(rows, drop.tolist()) if not d)
                text = pa.array(fresh, pa.string())
            cols = [text if j == at else c for j, c in enumerate(part.columns) if j != cuts]
            yield pa.RecordBatch.from_arrays([*cols, lines, pa.array(gone)], schema=schema)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with later repeats cut from ``text``, and n_lines and n_deleted.

    First is the smallest (doc_id, text hash, line); null ids come last. Repeats
    within a document count, and where one overlaps its first occurrence, the lines of
    that stay. Runs below ``min_words`` words stay, blank lines inside a deleted run go
    with it. Rows equal in doc_id and text are one document and are treated alike.
    Null and empty texts stay as they are; other columns are carried, but for ones
    named n_lines and n_deleted (in any case, where the session ignores case), which are
    replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    # columns of the caller may have any names, so they travel in one struct
    cased = docs.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    names = [c for c in docs.columns if (c if cased else c.lower()) not in ("n_lines", "n_deleted")]
    keyed = docs.select(
        F.struct(*names).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_id"), F.xxhash64("text", "doc_id").alias("_mark"), F.col("text").alias("_text")
    )

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prints(batches, min_words)

    found = cut(keyed.select("_id", "_mark", "_text").mapInArrow(prints, _PRINT_SQL))
    again = found.where("lead").groupBy("print").agg(F.count("*").alias("n")).where("n > 1")
    # a line that very many documents have is one key of this join: there are OFTEN such prints at most, so they are
    # sent to all tasks and their rows stay where they are
    often = F.col("n") * OFTEN > found.count()
    marked = found.join(F.broadcast(again.where(often).select("print", F.lit(True).alias("often"))), "print", "left")
    seldom = marked.where("often is null").join(again.where(~often).select("print"), "print", "leftsemi")
    found = cut(marked.where("often").unionByName(seldom).select("key", "key2", F.struct("doc_id", "mark", "first", "last").alias("place")))
    heads = found.groupBy("key", "key2").agg(F.min("place").alias("head"), F.max("place").alias("tail"), F.count("*").alias("n")).where("head != tail")
    heads = cut(heads.select("key", "key2", "head", "n"))
    # and so is a window that very many copies share, with its first place
    marked = found.join(F.broadcast(heads.where(often).drop("n")), ["key", "key2"], "left")
    seldom = marked.where("head is null").drop("head").join(heads.where(~often).drop("n"), ["key", "key2"])
    later = marked.where("head is not null").unionByName(seldom).where("place != head")
    overlaps = (F.col("place.doc_id") == F.col("head.doc_id")) & (F.col("place.mark") == F.col("head.mark")) & (F.col("place.first") <= F.col("head.last"))
    runs = later.select("place.doc_id", "place.mark", F.when(overlaps, F.col("head.last") + 1).otherwise(F.col("place.first")).alias("first"), "place.last").where("first <= last").distinct()
    runs = runs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))
    joined = keyed.drop("_text").join(runs, (keyed["_id"] == runs["doc_id"]) & (keyed["_mark"] == runs["mark"]), "left")
    joined = joined.select(*[F.col("row")[c].alias(c) for c in names], F.col("_runs").alias("n_deleted"))
    schema = docs.select(*names).schema.add("n_lines", "long").add("n_deleted", "long")
    arrow = to_arrow_schema(schema)
    at, cuts = names.index("text"), len(names)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _without(batches, at, cuts, arrow)

    return joined.mapInArrow(without, schema)

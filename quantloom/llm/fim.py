"""Fill-in-the-middle rewriting of whole texts, cut at the ends of lines.

The cut points are the ends of the a-th and b-th line of a text. They are found in
the UTF-8 bytes eight at a time: a slice of a batch is viewed as 64-bit words, the
bytes that end a line are marked in each word by carry-free arithmetic, marks are
counted per word and summed, the word of the k-th mark is searched in the sums, and
the mark is selected inside the word. No string is split and no line is built, so the
work on a text is a few passes over its bytes, whatever its number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Texts, texts

TAGS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle
SEED, RATE, SPM = 7, 100, 50  # rate: percent of texts that are rewritten; spm: percent of those with the suffix first
_U = np.uint64
_LOW, _HIGH, _ONES = _U(0x7F7F7F7F7F7F7F7F), _U(0x8080808080808080), _U(0x0101010101010101)
_FEEDS = _U(10) * _ONES


def ends_of_lines(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a line feed. Nothing is carried from byte to byte."""
    x = words ^ _FEEDS
    return ~(((x & _LOW) + _LOW) | x) & _HIGH


def leads(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that starts a character (it is not of the form 10xxxxxx)."""
    return ~(words & (~words << _U(1))) & _HIGH


class Marks:
    """Counts and places of marked bytes in a buffer of words."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.total = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def before(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes among the first ``at`` bytes."""
        word, byte = at >> 3, (at & 7).astype(_U)
        below = (_U(1) << (byte << _U(3))) - _U(1)
        part = np.append(self.marks, _U(0))[word] & below
        return self.total[word] + np.bitwise_count(part).astype(np.int64)

    def place(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th mark, from 1."""
        word = np.searchsorted(self.total, k, "left") - 1
        left, w = k - self.total[word] - 1, self.marks[word]
        for step in range(7):  # a word holds eight marks at most: clear the lowest until the one sought is
            more = left > step
            if not more.any():
                break
            w = np.where(more, w & (w - _U(1)), w)
        return word * 8 + (np.bitwise_count((w & (~w + _U(1))) - _U(1)).astype(np.int64) >> 3)


def cuts(t: Texts, ha: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, bytes where its prefix and its middle end, and code points of both."""
    raw = np.zeros(-(-len(t.buf) // 8) * 8, np.uint8)
    raw[: len(t.buf)] = t.buf
    words = raw.view("<u8").astype(_U, copy=False)
    feeds, chars = Marks(ends_of_lines(words)), Marks(leads(words))
    begin, end = t.offs[:-1], t.offs[1:]
    first = feeds.before(begin)
    closed = feeds.before(end) - first
    open_ = (end > begin) & (raw[np.maximum(end, 1) - 1] != 10) if len(raw) else np.zeros(t.n, bool)
    n = closed + open_
    x, y = ha % (n + 1), hb % (n + 1)
    edges = []
    for k in (np.minimum(x, y), np.maximum(x, y)):
        at = np.where(k > closed, end, begin)  # no line is the beginning, an open last line ends with the text
        inside = (k > 0) & (k <= closed)
        at[inside] = feeds.place(first[inside] + k[inside]) + 1
        edges.append(at)
    a, b = edges
    return n, a, b, chars.before(a) - chars.before(begin), chars.before(b) - chars.before(a)


_OUT = pa.schema(
    [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


def _rewritten(batches: Iterator[pa.RecordBatch], rate: int, spm: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Columns: id, text, h1 to h4."""
    schema = pa.schema([pa.field("doc_id", id_type), *_OUT])
    p, s, m = (x.encode() for x in TAGS)
    for b in batches:
        for t in texts(b.column(1)):
            part = b.slice(t.first, t.n)
            h = [part.column(2 + j).to_numpy() for j in range(4)]
            n, a, z, prefix, middle = cuts(t, h[0], h[1])
            raw, offs = t.buf.tobytes(), t.offs.tolist()
            plain = (np.diff(t.offs) == 0) | (h[2] % 100 >= rate)
            first = h[3] % 100 < spm
            tagged = any(x in raw for x in (p, s, m))  # of the slice: most have none
            made: list[bytes] = []
            for i, (x, y) in enumerate(zip(a.tolist(), z.tolist())):
                begin, end = offs[i], offs[i + 1]
                if tagged and any(raw.find(x_, begin, end) >= 0 for x_ in (p, s, m)):
                    plain[i] = True
                if plain[i]:
                    made.append(raw[begin:end])
                elif first[i]:
                    made.append(b"".join((s, raw[y:end], p, raw[begin:x], m, raw[x:y])))
                else:
                    made.append(b"".join((p, raw[begin:x], s, raw[y:end], m, raw[x:y])))
            form = np.where(plain, "plain", np.where(first, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(form, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(made, pa.binary()).cast(pa.string())],
                schema=schema,
            )


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per document: doc_id, n (its lines), form, prefix_chars, middle_chars, output.

    A line ends with its line feed or with the text. The prefix ends after the smaller
    and the middle after the larger of two line counts that a hash of ``seed`` and the
    id draws from 0 to n; further hashes draw ``rate`` percent of all documents and
    ``spm`` percent of those with the suffix first. A text that is null or empty (n is
    0), that holds one of the tags, or that is not drawn stays as it is: plain, with null
    lengths. A null id is drawn like an empty one. Rows with equal ids are cut alike;
    repeated rows stay. An empty table gives no rows; other columns are ignored.
    """
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(code, 1 + 8 * j, 8), 16, 10).cast("long").alias(f"h{j + 1}") for j in range(4)]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rewritten(batches, rate, spm, arrow)

    schema = f"doc_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *draws).mapInArrow(rewritten, schema)


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text that an output was made of.

    No text that is rewritten holds a tag, and none arises where text and tags meet,
    for a tag's only ``<`` is its first character; so an output has each tag once.
    """
    parts = F.split(output, "|".join(TAGS), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(parts[2], parts[3], parts[1]))

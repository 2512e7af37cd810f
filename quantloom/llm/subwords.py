"""Byte-level BPE ids for many texts at once.

The ids are those of the ``tokenizers`` file; the equal ``.tiktoken`` ranks do
the work because they are faster. The split pattern of this vocabulary never
joins characters across the start of an ASCII white-space run, nor from a letter
to the ASCII punctuation after it, so a text falls into units that can be
tokenised alone. Each distinct unit of a slice is looked up once; what is new is
encoded and kept (at most ``CACHE`` units, then the table starts anew).
"""

from __future__ import annotations

import base64
import secrets

import numpy as np
import pyarrow as pa

from .textkit import _SPACE, Texts, texts

CACHE = 1 << 19
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
#: Lead bytes of characters that may be white space beyond ASCII, or controls whose class libraries dispute.
_ODD = np.zeros(256, bool)
_ODD[[0xC2, 0xE1, 0xE2, 0xE3, *range(0x1C, 0x20)]] = True
NEWLINE_RANK = b"\n"


def default_files() -> tuple[str, str]:
    """The JSON vocabulary and its ranks, where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Encodes Arrow string columns; one per task."""

    def __init__(self, json_file: str, ranks_file: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_file)
        self.seed = np.uint64(secrets.randbits(64))  # ids do not depend on it, and no text can be made to fit it
        self.specials = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.exact.get_vocab_size() <= 1 << 16 else np.uint32
        self.quick = None
        if ranks_file:
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.newline = ranks[NEWLINE_RANK]
        self._reset()

    def _reset(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Encodes new units; those of the form blank + word go through one call, with line feeds between them."""
        plain = [i for i, u in enumerate(units) if u[:1] == b" " and b"\n" not in u and u[1:2].strip()]
        got: dict[int, np.ndarray] = {}
        if plain:
            out = np.array(self.quick.encode_ordinary("\n".join([units[i].decode() for i in plain])), self.dtype)
            parts = np.split(out, np.flatnonzero(out == self.newline))
            if len(parts) == len(plain):
                got = {i: p[1:] if j else p for j, (i, p) in enumerate(zip(plain, parts))}
        ids = [got[i] if i in got else np.array(self.quick.encode_ordinary(u.decode()), self.dtype) for i, u in enumerate(units)]
        if len(self.known) + len(ids) > CACHE:
            self._reset()
        n = len(self.first) - 1
        self.ids = np.concatenate([self.ids, *ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in ids])])
        known, at = np.concatenate([self.known, hashes]), np.concatenate([self.at, np.arange(n, n + len(ids))])
        order = np.argsort(known)
        self.known, self.at = known[order], at[order]

    def _slice(self, t: Texts) -> list[np.ndarray]:
        buf, offs = t.buf, t.offs
        if not len(buf):
            return [np.zeros(0, self.dtype)] * t.n
        space = _SPACE[buf]
        cut = np.zeros(len(buf), bool)
        cut[0] = True
        cut[1:] = space[1:] & ~space[:-1]
        letter = _ALNUM[buf]
        letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        cut[1:] |= _PUNCT[buf[1:]] & letter[:-1]
        cut[offs[:-1][offs[:-1] < len(buf)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        hashes = t.spans(starts, ends, seed=self.seed)
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        for _ in range(2):
            pos = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
            new = self.known[pos] != distinct if len(self.known) else np.ones(len(distinct), bool)
            if not new.any():
                break
            if len(self.known) + new.sum() > CACHE:  # then all of this slice anew
                self._reset()
                new[:] = True
            k = where[new]
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[k].tolist(), ends[k].tolist())])
        unit = self.at[pos][which]
        begin, size = self.first[unit], self.first[unit + 1] - self.first[unit]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        edges = total[np.searchsorted(starts, offs)]
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null is an empty text."""
        out: list[np.ndarray] = []
        for t in texts(column):
            odd = np.add.reduceat(_ODD[t.buf], np.minimum(t.offs[:-1], max(0, len(t.buf) - 1))) if len(t.buf) else np.zeros(t.n)
            odd = np.where(np.diff(t.offs) > 0, odd, 0)
            got = self._slice(t) if self.quick else None
            for i in range(t.n):
                raw = t.buf[t.offs[i] : t.offs[i + 1]]
                if got is None or odd[i] or any(s.encode() in raw.tobytes() for s in self.specials if len(raw) >= len(s)):
                    out.append(self.slow(raw.tobytes().decode("utf-8", "replace")))
                else:
                    out.append(got[i])
        return out

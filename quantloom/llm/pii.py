"""Personal data: fixed base patterns, and boosted trees over candidates.

Base patterns give e-mail, ip, card and phone spans, which always stay. High-recall
generators propose further, overlapping spans (keys and tokens, local phone numbers,
national and account numbers, spelled-out e-mail addresses). Gradient-boosted trees
score a candidate by its format and its context; thresholds per kind select what is
added. Examples are generated from seeded templates, so training needs no personal
data. Thresholds are calibrated on examples that the trees did not see and whose
context words are none of those the features know, so that a threshold does not lean
on words that templates and features share.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textkit import Texts, table, texts

KINDS = ("email", "ip", "card", "phone")
MORE = ("secret", "local_phone", "number", "spelled_email")
ORDER = {k: i for i, k in enumerate(KINDS + MORE)}

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a failed try at the first digit of a run fails at its later digits too, so only first digits are tried
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(s: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, found from each @ backwards, so text without one costs nothing."""
    done, at = 0, s.find("@")
    while at >= 0:
        begin = at
        while begin > done and s[begin - 1] in _LOCAL:
            begin -= 1
        m = _EMAIL.match(s, begin) if begin < at else None
        if m:
            yield m.span()
            done = m.end()
        else:
            done = max(done, at)  # the run before the next @ cannot reach across this one
        at = s.find("@", max(done, at + 1))


def base_spans(s: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points by start, then kind."""
    out = [(a, b, "email") for a, b in _emails(s)]
    for m in _IP.finditer(s):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(s):
        if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in s:
        for m in _PHONE.finditer(s):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


# generators: (kind, pattern, group); each begins at a place that few texts have
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_NUMBER = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){7,}+")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?(?:\(at\)|\[at\]|(?<= )at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|(?<= )dot ) ?[A-Za-z0-9-]++)+")
#: A value with a digit behind a word for passwords, in a few languages.
_SHORT = re.compile(
    r"(?i)(?<![a-z])(?:pass(?:word|wort|wd|code|phrase)?|pwd|pin|kennwort|wachtwoord|senha|secret)(?:[\"']?\s?[:=]\s?|\sis\s|\sist\s)[\"']?((?=[^\s\"'<>,;]{0,63}[0-9])[^\s\"'<>,;]{3,63}[^\s\"'<>,;.)])"
)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Numbers with a trunk zero, as written in many countries.
_NATIONAL = re.compile(r"(?<![0-9+(./-])\(?0[0-9]{1,4}\)?[ ./-]{1,3}[0-9]{2,8}(?:[ ./-][0-9]{2,5}){0,4}(?![0-9])")
_LONG = re.compile(rb"[A-Za-z0-9_+/=-]{16}")  # in every text with a secret


def candidates(s: str) -> list[tuple[int, int, str]]:
    """Overlapping spans of the four further kinds."""
    # capitals alone are a long word in a line of capitals
    out = [(*m.span(), "secret") for m in _SECRET.finditer(s) if re.search("[A-Za-z]", x := m.group()) and not re.fullmatch("[A-Z]+", x)]
    for a, b, _ in out[:]:  # NAME=token is one run of token characters
        if (k := s.rfind("=", a, b - 16)) >= a:
            out.append((k + 1, b, "secret"))
    out += [(*m.span(1), "secret") for m in _SHORT.finditer(s) if m.end(1) - m.start(1) < 16]
    for kind, pattern in (("local_phone", _LOCAL_PHONE), ("local_phone", _NATIONAL), ("number", _NUMBER), ("number", _IBAN)):
        out += [(*m.span(), kind) for m in pattern.finditer(s)]
    out = list(dict.fromkeys(out))  # two patterns may find one span
    if " dot " in s or "dot)" in s or "dot]" in s:
        out += [(*m.span(), "spelled_email") for m in _SPELLED.finditer(s)]
    return out


_HINTS = {
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "api", "bearer", "auth", "credential", "passwort", "kennwort", "passcode", "passphrase", "pin"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "ring"),
    "number": ("ssn", "account", "iban", "bic", "passport", "social", "tax", "licence", "license", "id", "konto", "card", "insurance"),
    "spelled_email": ("mail", "email", "contact", "write", "reach"),
}
#: Context words of examples that no feature looks for.
_CUES = {
    "secret": ("session", "cookie", "signature", "private", "login", "client"),
    "local_phone": ("dial", "hotline", "reach me on", "whatsapp", "office", "home"),
    "number": ("policy", "member", "taxpayer", "customer", "patient", "employee"),
    "spelled_email": ("ping", "address", "send to", "or", "questions to"),
}
_COUNTER = ("page", "pages", "vol", "version", "isbn", "order", "build", "commit", "year", "population", "section", "figure", "table", "row", "revision", "sha", "md", "digest", "checksum", "hash", "fingerprint", "uuid", "etag", "object", "blob")
_SHORT_CUES = (("password", "passwort", "pwd", "passcode", "pass"), ("wachtwoord", "senha"))  # known to features, and not


def _iban(x: str) -> bool:
    """The check digits of an account number with letters (ISO 7064, mod 97-10)."""
    x = x.replace(" ", "").upper()
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{8,31}", x)) and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def describe(s: str, a: int, b: int, kind: str) -> list[float]:
    """Format and context of a candidate as numbers."""
    x = s[a:b]
    before = s[max(0, a - 30) : a].lower()
    words = re.findall("[a-z]+", before)[-3:]
    counts: dict[str, int] = {}
    for c in x:
        counts[c] = counts.get(c, 0) + 1
    n = len(x)
    p = np.array(list(counts.values())) / n
    digits, upper, lower = sum(c.isdigit() for c in x), sum(c.isupper() for c in x), sum(c.islower() for c in x)
    last = before.rstrip()[-1:]
    return [
        float(ORDER[kind]), n, digits, upper, lower, float(-(p * np.log2(p)).sum()), float(set(x) <= set("0123456789abcdef")), n - digits - upper - lower,
        float(any(w in _HINTS[kind] for w in words)), float(any(w in _COUNTER for w in words)), float(last in ("=", ":")), float(last in ('"', "'")),
        float(s[b : b + 1] in ('"', "'")), float(bool(digits) and luhn(_digits(x))), float("(" in x), float(x.count("-")), float(sum(1 for g in re.split("[^0-9]+", x) if g)),
        float(bool(re.fullmatch("(19|20)[0-9]{2}[ -][0-9]{2,4}[ -]?[0-9]{2,4}", x))), float(bool(re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", x))),
        float(sum(x[i].isdigit() != x[i + 1].isdigit() for i in range(n - 1))), float(max((len(g) for g in re.split("[^a-z]+", x)), default=0)),
        float(_iban(x)), float(s[a - 1 : a].isalnum() if a else False), float(bool(re.match("[ ./-]?[A-Za-z]?[0-9]", s[b : b + 3]))), float(any(w in _COUNTER for w in re.findall("[a-z]+", s[b : b + 20].lower())[:2])),
        float(x[:1] == "0" or x[:2] == "(0"), float(bool(re.fullmatch("[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}|[0-9]{4})", x))),
    ]


@dataclass
class Boosted:
    """Depth-limited regression trees on logistic loss, as nested tuples, and the cut of each kind."""

    base: float
    trees: list
    cuts: dict[str, float]

    @staticmethod
    def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(x) < 20:
            return leaf
        best = (1e-6, None, None)
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            gain = cg[at] ** 2 / (ch[at] + 1) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[at[k]] + v[at[k] + 1]) / 2))
        if best[1] is None:
            return leaf
        _, j, cut = best
        less = x[:, j] < cut
        return (j, cut, Boosted._grow(x[less], g[less], h[less], depth - 1), Boosted._grow(x[~less], g[~less], h[~less], depth - 1))

    @staticmethod
    def _leaf(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        less = x[:, j] < cut
        out = np.empty(len(x))
        out[less], out[~less] = Boosted._leaf(low, x[less]), Boosted._leaf(high, x[~less])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for t in self.trees:
            f += 0.2 * self._leaf(t, x)
        return 1 / (1 + np.exp(-f))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, kinds: np.ndarray, train: np.ndarray, rounds: int = 60, depth: int = 3, precision: float = 0.99) -> "Boosted":
        """Rows of ``train`` grow the trees; the others set, for each kind, the least cut with that precision and every cut above it."""
        odd = train
        p = float(np.clip(y[odd].mean(), 0.01, 0.99))
        m = cls(float(np.log(p / (1 - p))), [], {})
        f = np.full(odd.sum(), m.base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            m.trees.append(cls._grow(x[odd], y[odd] - q, q * (1 - q), depth))
            f += 0.2 * cls._leaf(m.trees[-1], x[odd])
        s = m.score(x)
        for k in MORE:
            own = ~odd & (kinds == ORDER[k])
            m.cuts[k] = 2.0  # nothing, unless examples say otherwise
            order = np.argsort(-s[own])
            hits = np.cumsum(y[own][order])
            good = np.flatnonzero(hits / np.arange(1, len(order) + 1) < precision)
            upto = good[0] if len(good) else len(order)
            if upto:
                m.cuts[k] = max(0.5, float(s[own][order][upto - 1]))
        return m


def _examples(seed: int, n: int, known: float = 0.5) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Texts with the spans in them that are personal, from templates; ``known``: the share of context words that features look for."""
    rng = random.Random(seed)
    pick = rng.choice
    chars = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    digit, hexa, mixed = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: chars("etaoinshrdlucmfwypvbgk", rng.randrange(2, 11))

    def national() -> str:
        gap = pick(("/", " / ", "-", ".", " "))
        inner = pick((" ", "-", ".", ""))
        return f"0{chars(digit, rng.randrange(2, 5))}{gap}{chars('23456789', 1)}{chars(digit, 2)}{inner}{chars(digit, rng.randrange(3, 5))}"

    def iban() -> str:
        land = chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2)
        body = pick(("", "", chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4))) + chars(digit, rng.randrange(10, 19))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        x = f"{land}{check:02d}{body}"
        return " ".join(x[i : i + 4] for i in range(0, len(x), 4)) if rng.random() < 0.6 else x

    def positive() -> tuple[str, str, str]:
        kind = pick(MORE)
        hint = pick((_HINTS if rng.random() < known else _CUES)[kind]) + pick((" = ", ": ", " ", "=")) if rng.random() < 0.85 else ""
        if kind == "secret" and rng.random() < 0.3:
            q = pick(('"', "'", "", ""))
            value = pick((word() + chars(digit, rng.randrange(1, 5)), word().capitalize() + chars(digit, rng.randrange(2, 5)) + pick(("", "!", "?", "#")), chars(mixed, 8) + chars(digit, 1)))
            return pick(_SHORT_CUES[rng.random() >= known]) + pick((": ", "=", " = ", " is ")) + q, value, q
        if kind == "secret":
            q = pick(('"', "'", ""))
            if not hint:  # digests alone are nobody's secret
                return q, chars(mixed, rng.randrange(20, 64)), q
            return hint + q, pick((chars(hexa, 40), chars(hexa, 32), chars(hexa, 64), chars(mixed, rng.randrange(20, 64)))), q
        if kind == "local_phone":
            return hint, pick((f"({chars(digit, 3)}) {chars(digit, 3)}-{chars(digit, 4)}", f"{chars(digit, 3)}-{chars(digit, 3)}-{chars(digit, 4)}", f"{chars(digit, 3)} {chars(digit, 3)} {chars(digit, 4)}", national())), ""
        if kind == "number":
            return hint or "account ", pick((f"{chars(digit, 3)}-{chars(digit, 2)}-{chars(digit, 4)}", chars(digit, rng.randrange(9, 20)), chars(digit, rng.randrange(9, 14)), iban())), ""
        return hint, f"{word()}{pick((' at ', ' (at) ', '[at]'))}{word()}{pick((' dot ', ' (dot) ', '[dot]'))}{pick(('com', 'org', 'net', 'de'))}", ""

    def negative() -> str:
        return pick(
            (
                f"{chars('12', 1)}{chars(digit, 3)}-{chars('01', 1)}{chars(digit, 1)}-{chars('012', 1)}{chars(digit, 1)}", f"version {chars(digit, 1)}.{chars(digit, 2)}.{chars(digit, 3)}",
                f"{pick(_COUNTER)} {chars(digit, rng.randrange(2, 12))}", f"{chars(digit, 3)},{chars(digit, 3)},{chars(digit, 3)}", f"{chars(digit, 4)}-{chars(digit, 4)}",
                f"{chars('19', 1)}9{chars(digit, 2)} - 20{chars(digit, 2)}", f"{word()} at {word()}", word() + "-" + word() + "-" + word() + "-" + chars(digit, 2), f"isbn 978-{chars(digit, 10)}",
                word() + word() + chars(digit, 2), "_".join(word() for _ in range(4)) + chars(digit, 1), f"population {chars(digit, 8)}", f"{chars(digit, 2)} 000 000 {word()}", f"order {chars(digit, 9)}",
                "/" + "/".join(word() for _ in range(4)) + "/" + chars(digit, 4), f"{chars(digit, 8)} {word()}", f"table {chars(digit, 3)} {chars(digit, 3)} {chars(digit, 4)}",
                f"{pick(_COUNTER[-10:])}{pick(('', '256', '5', '1'))}{pick((' ', ': ', '=', ' = '))}{chars(hexa, pick((32, 40, 64)))}", f"{chars(hexa, pick((32, 40, 64)))} {pick(_COUNTER[-10:])}", chars(hexa, pick((32, 40, 64))),
                f"0{chars(digit, 1)}{(sep := pick('/.-'))}{chars('01', 1)}{chars(digit, 1)}{sep}{pick(('19', '20', ''))}{chars(digit, 2)}", f"{pick(_SHORT_CUES[0] + _SHORT_CUES[1])}{pick((': ', ' is ', '='))}{word()}", f"0{chars(digit, 1)}-{chars(digit, 2)} {word()}",
                f"{word()} at {word()} dot dot dot", f"{word()} {word()} at {word()} dot dot {word()}", " ".join(chars(digit, 4) for _ in range(rng.randrange(3, 7))), " ".join(chars(digit, 1) + "000" for _ in range(rng.randrange(2, 6))),
            )
        )

    for _ in range(n):
        parts, spans, at = [], [], 0
        for _ in range(4):
            lead = " ".join(word() for _ in range(rng.randrange(3, 9))) + " "
            parts.append(lead)
            at += len(lead)
            if rng.random() < 0.5:
                pre, body, post = positive()
                spans.append((at + len(pre), at + len(pre) + len(body)))
                piece = pre + body + post + " "
            else:
                piece = negative() + " "
            parts.append(piece)
            at += len(piece)
        yield "".join(parts), spans


@lru_cache(maxsize=1)
def model(seed: int = 11, n: int = 2000) -> Boosted:
    """The trees, fitted on generated examples; the same on every machine."""
    x, y, kinds, train = [], [], [], []
    for fits, known in ((True, 0.5), (False, 0.0)):
        for s, spans in _examples(seed + fits, n, known):
            for a, b, kind in candidates(s):
                hit = any(min(b, d) - max(a, c) >= 0.9 * (max(b, d) - min(a, c)) for c, d in spans)
                x.append(describe(s, a, b, kind))
                y.append(float(hit))
                kinds.append(ORDER[kind])
                train.append(fits)
    return Boosted.fit(np.array(x), np.array(y), np.array(kinds), np.array(train))


def more_spans(s: str, base: list[tuple[int, int, str]], m: Boosted) -> list[tuple[int, int, str]]:
    """Selected candidates that touch no base span, the best of those that overlap one another."""
    found = []
    starts = np.array([a for a, _, _ in base], np.int64)
    reach = np.maximum.accumulate([b for _, b, _ in base]) if base else starts
    for c in candidates(s):
        k = int(np.searchsorted(starts, c[1]))
        if not k or reach[k - 1] <= c[0]:
            found.append(c)
    if not found:
        return []
    score = m.score(np.array([describe(s, *c) for c in found]))
    chosen: list[tuple[int, int, str]] = []  # by place, none touching another
    for i in sorted(range(len(found)), key=lambda i: (-score[i], found[i][0], found[i][1])):
        a, b, kind = found[i]
        k = bisect_left(chosen, (b,))  # the first that begins at b or later
        if score[i] >= m.cuts[kind] and (not k or chosen[k - 1][1] <= a):
            chosen.insert(k, found[i])
    return chosen


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], ORDER[x[2]], x[1])))


def _interesting(t: Texts) -> np.ndarray:
    """Documents with a digit or an @; the others have spans only with a long token or a spelled-out dot."""
    total = np.concatenate([[0], np.cumsum(((t.buf >= 48) & (t.buf < 58)) | (t.buf == 64))])
    return (total[t.offs[1:]] - total[t.offs[:-1]]) > 0


_OUT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, their digest, and all spans, for every row and whole text.

    Null and empty texts have no spans. Rows with equal or null ids are read one
    by one; columns other than doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for t in texts(b.column(1)):
                rows: list[tuple] = []
                some = _interesting(t)
                for i in range(t.n):
                    raw = t.buf[t.offs[i] : t.offs[i + 1]].tobytes()
                    if not some[i] and b" dot " not in raw and b"dot)" not in raw and b"dot]" not in raw and not _LONG.search(raw):
                        rows.append((0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), ""))
                        continue
                    s = raw.decode("utf-8", "replace")
                    base = base_spans(s)
                    kinds = [k for _, _, k in base]
                    rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more_spans(s, base, m))))
                cols = list(zip(*rows))
                yield table(_OUT, doc_id=b.column(0).slice(t.first, t.n), **{f.name: cols[k] for k, f in enumerate(list(_OUT)[1:])})

    sql = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, sql)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; other columns are carried."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())
    at = docs.columns.index("text")

    def clean(s: str | None) -> str | None:
        if s is None:
            return None
        base = base_spans(s)
        out, done = [], 0
        for a, b, k in sorted(base + more_spans(s, base, shared.value)):
            if a >= done:
                out += [s[done:a], f"<{k}>"]
            done = max(done, b)
        return "".join([*out, s[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([clean(s) for s in b.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)

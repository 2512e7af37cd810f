"""Fill-in-the-middle, exact copies and the source audit against plain versions, and on rows that are easy to get wrong."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.llm import divergence, fim, recipes
from quantloom.llm.textkit import texts

SCHEMA = "doc_id long, text string, lang string, source string, N long, Form string, `h1` string, norm string, key string, term int, P int"


def docs(spark, rows):
    """rows of (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([((*r, "en", "s")[:4] if len(r) == 2 else r) + (7, "x", "y", "z", "k", 1, 2) for r in rows], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


LONG = " ".join(f"word{i % 977} é{i}\n" for i in range(60_000))  # over 700,000 characters
ODD = [
    (1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (4, "a"), (4, "a"), (None, "b\nc"), (None, "b\nc"), (5, "é ü\n漢字 🙂 x\n"), (6, "\n\n\n"), (7, "has <S> in it\nb\n"),
    (8, "<\nP>\n<S"), (9, LONG), (10, "a\n" * 5000), (11, "ab" * 100_000), (12, "x\r\ny\r\n"),
]


# 11


def plain_fim(i, s):
    s = s or ""
    lines = re.findall("[^\n]*\n|[^\n]+", s)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * j : 8 * j + 8], 16) for j in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, x = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not s or any(t in s for t in fim.TAGS):
        return len(lines), "plain", None, None, s
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"


def plain_rebuilt(output, form):
    """The pieces between tags, put in order."""
    if form == "plain":
        return output
    at = {output[m.start() : m.end()]: m for m in re.finditer("<[PSM]>", output)}
    ends = sorted(m.start() for m in at.values()) + [len(output)]
    piece = {t: output[m.end() : next(e for e in ends if e > m.start())] for t, m in at.items()}
    return piece["<P>"] + piece["<M>"] + piece["<S>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from("ab\né漢🙂\r\x8aĊ "), max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=9))
def test_cuts_of_words_equal_cuts_of_lines(rows):
    for t in texts(pa.array([r[0] for r in rows], pa.string())):
        n, a, b, p, m = fim.cuts(t, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        for i, (s, x, y) in enumerate(rows):
            lines = re.findall("[^\n]*\n|[^\n]+", s)
            x, y = sorted((x % (len(lines) + 1), y % (len(lines) + 1)))
            begin = t.offs[i]
            assert n[i] == len(lines) and (p[i], m[i]) == (len("".join(lines[:x])), len("".join(lines[x:y])))
            assert t.buf[begin : a[i]].tobytes().decode() == "".join(lines[:x]) and t.buf[a[i] : b[i]].tobytes().decode() == "".join(lines[x:y])


def test_marks_are_exact_for_every_byte():
    words = np.random.default_rng(1).integers(0, 256, 8 * 5000, dtype=np.uint8)
    words[: 8 * 256] = np.arange(256).repeat(8)
    for marks, want in ((fim.ends_of_lines(words.view("<u8")), words == 10), (fim.leads(words.view("<u8")), (words & 0xC0) != 0x80)):
        assert (marks.view(np.uint8) == want * 128).all()
        m = fim.Marks(marks)
        assert (m.place(np.arange(1, m.total[-1] + 1)) == np.flatnonzero(want)).all()
        assert (m.before(np.arange(len(words) + 1)) == np.concatenate([[0], np.cumsum(want)])).all()


def test_fim_equals_a_plain_version(spark):
    rnd = random.Random(2)
    rows = ODD + [(i, "".join(rnd.choice("abc é\n<PSM>") for _ in range(rnd.randint(0, 80)))) for i in range(100, 500)]
    got = fim.transform(docs(spark, rows)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, *plain_fim(i, s)) for i, s in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, s or "") for i, s in rows)
    assert all(plain_rebuilt(r.output, r.form) == r.back for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_rate_draws_a_share_and_no_rows_give_none(spark):
    d = docs(spark, [(i, "a\nb\nc\n") for i in range(2000)])
    assert 0.25 < fim.transform(d, rate=30).where("form <> 'plain'").count() / 2000 < 0.35
    assert {r.form for r in fim.transform(d, spm=100).select("form").distinct().collect()} == {"spm"}
    assert fim.transform(d.where("false")).count() == 0


# 12


def plain_copies(rows):
    groups = defaultdict(list)
    for k, (i, s) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", s or "")].append((-len(s or ""), i is None, i or 0, k))
    out = []
    for text, g in groups.items():
        keep = rows[min(g)[3]][0]
        out += [(rows[k][0], keep, len(g), sha(text)) for _, _, _, k in g]
    return Counter(out), len(groups)


def some_copies(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeionrstl漢字") for _ in range(rnd.randint(1, 9)))
    rows = list(ODD)
    for i in range(60):
        t = [word() for _ in range(rnd.choice([3, 40, 400]))]
        for j in range(rnd.choice([1, 1, 2, 5])):
            rows.append((1000 + 10 * i + j, rnd.choice([" ", "\n", "  "]).join(t)))
        t[-1] += "x"  # a near copy is another text
        rows.append((5000 + i, " ".join(t)))
    return rows + [(90_000 + i, "the hot text that many rows hold " * 9) for i in range(900)]


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_copies_equal_a_plain_version(spark, bits):
    """Few bits make nearly all identifiers stand for several chunks, so the dictionary has to number them."""
    rows = some_copies()
    want, n = plain_copies(rows)
    got = recipes.copies(docs(spark, rows).repartition(5), bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n and all(r.keep_id == r.doc_id for r in kept)


def test_copies_on_both_sides_of_hot_groups(spark, monkeypatch):
    rows = some_copies(4)
    want, _ = plain_copies(rows)
    for often in (1, 1 << 40):
        monkeypatch.setattr(recipes, "OFTEN", often)
        got = recipes.copies(docs(spark, rows)).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want


def test_chunks_follow_the_content_and_add_up(spark):
    rnd = random.Random(5)
    s = " ".join("".join(rnd.choice("aeionrstlmdh") for _ in range(rnd.randint(2, 7))) for _ in range(4000))
    rows = docs(spark, [(1, s), (2, "zz" + s), (3, "q" * 5000), (4, "漢" * 3000), (5, "")])
    got = {r.doc_id: r for r in rows.select("doc_id", recipes.normal(F.col("text")).alias("t"), recipes.chunks(recipes.normal(F.col("text"))).alias("c")).collect()}
    assert all("".join(r.c) == r.t for r in got.values()) and max(len(c) for r in got.values() for c in r.c) <= recipes.MOST
    assert len(set(got[1].c) & set(got[2].c)) > 0.9 * len(got[1].c)  # two characters in front shift no later cut
    assert recipes.copies(rows.where("false")).count() == 0


# 13


def plain_audit(rows):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seen = [(g or "", s or "", Counter(term.findall((t or "").translate(lower)))) for _, t, g, s in rows]
    out = []
    for lang in {x[0] for x in seen}:
        own = [x for x in seen if x[0] == lang]
        df = Counter(t for *_, c in own for t in c)
        kept = [t for t in df if df[t] >= 10]
        count = {s: Counter() for _, s, _ in own}
        for _, s, c in own:
            count[s].update({t: n for t, n in c.items() if df[t] >= 10})
        whole = sum(count.values(), Counter())
        v = len(kept)
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pair = [(-sum(f(p(count[s], t), p(count[o], t)) for t in kept), o.encode(), o) for o in count if o != s]
            out += [(lang, s, "pair", o, -x, r) for r, (x, _, o) in enumerate(sorted(pair), 1)]
            top = [(-f(p(count[s], t), p(whole, t)), t.encode(), t) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            out += [(lang, s, "term", t, -x, r) for r, (x, _, t) in enumerate(sorted(top)[:10], 1)]
    return sorted(out)


def audited(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize("held, kept, sent", [(divergence.HELD, divergence.KEPT, divergence.SENT), (50, 300, 0), (1, 20, 0)])
def test_audit_equals_a_plain_version(spark, monkeypatch, held, kept, sent):
    """Also where sums are handed on early and groups are shuffled."""
    for name, value in (("HELD", held), ("KEPT", kept), ("SENT", sent)):
        monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(6)
    words = ["Alpha", "beta", "ÄÖ", "äö", "漢字", "don't", "x1y", "🙂", "Z_z", "\x00nul", "[br]{ace}", "eta", "theta", "iota", "rare%d"]
    rows = [(1, None, None, None), (2, "", "en", ""), (3, " 12 ", "en", "none"), (4, "only", "fr", "a"), (5, "only", "fr", "b"), (6, LONG, "en", "s0"), (None, "beta " * 40, "en", "s1"), (None, "beta " * 40, "en", "s1")]
    for i in range(300):
        n = rnd.choice([0, 3, 30])
        rows.append((10 + i, rnd.choice([" ", "\n", "-"]).join(rnd.choice(words[k % 3 :]).replace("%d", "x" * i) for k in range(n)), rnd.choice(["en", "en", "de", None]), f"s{min(i % 7, rnd.randrange(9))}"))
    assert audited(divergence.audit(docs(spark, rows).repartition(3))) == plain_audit(rows)


def test_audit_of_no_rows_and_of_no_kept_terms(spark):
    rows = [(1, "a b", "en", "x"), (2, "a c", "en", "y"), (3, None, "en", "z")]
    assert audited(divergence.audit(docs(spark, rows))) == plain_audit(rows) and plain_audit(rows)[0][4] == 0
    assert divergence.audit(docs(spark, rows).where("false")).count() == 0


def test_shares_do_not_overflow(spark):
    n, total, kept = 10**15 + 7, 3 * 10**15, 10**9
    df = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)

"""Rows that share an id, columns whose names clash, files of one task."""

import random

from quantloom.llm import line_dedup, warc

import corpus_pipeline


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_near_copies_decides_by_row(spark, tmp_path):
    rnd = random.Random(1)
    a, other = prose(rnd, 60), prose(rnd, 70)
    rows = [(3, a), (7, a + " x"), (7, other), (7, other), (8, other + " y"), (None, a + " z"), (None, prose(rnd, 30)), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)
    # the text of 7 that is found nowhere else but in 8 stays once: as 8, whose id stands for one text
    assert kept == sorted([(False, 3, a), (False, 8, other + " y"), (True, 0, rows[6][1]), (False, 9, "")])


def test_lines_replace_columns_that_clash_in_another_case(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, N_LINES int, N_Deleted int, Key int")
    got = line_dedup.drop_repeats(docs)
    assert got.columns == ["doc_id", "text", "Key", "n_lines", "n_deleted"] and got.select("n_lines", "N_DELETED", "key").first() == (1, 0, 7)


def test_warc_files_of_one_task(spark, tmp_path, monkeypatch):
    """A task that fills several files, and a second run of it in the same folder, lose and mix nothing."""
    monkeypatch.setattr(warc, "FILE_BYTES", 1)
    rnd = random.Random(2)
    pages = spark.createDataFrame([(i, f"http://x/{i}", prose(rnd, 50)) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    first, second = (warc.write(pages, folder) for _ in range(2))
    paths = [{r.path for r in f.collect()} for f in (first, second)]
    assert len(paths[0]) == len(paths[1]) == 6 and not paths[0] & paths[1]
    for files in (first, second):
        assert sorted(r.page_id for r in warc.read(files).collect()) == list(range(6))


def test_rules_without_any_good_label(spark):
    """Nothing tells a score apart then: only the base rules reject."""
    from quantloom.llm import quality_rules

    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, long), (2, "too short"), (3, None)], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int")
        assert [r.doc_id for r in quality_rules.keep_good(docs, known).collect()] == [1]
        judged = quality_rules.judge(docs, quality_rules.fit(docs, known))
        assert sorted((r.doc_id, r.kept) for r in judged.collect()) == [(1, True), (2, False), (3, False)]

import re

from probelake.llm import quality

PROSE = "The river ran slowly past the old mill and the children watched it from the bridge."


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


TEXTS = [None, "", " \n\t ", "word", PROSE, PROSE + "\n" + PROSE, "a b c d e a b c d e", "a a a a a a a a a a a a", "a b c d e f a b c d e f a b c d",
         "x y z\x0bq \x1c r", "# * $ % & | < >", "Home | News | About | Contact\n" + PROSE, "日本語 です。 これ は 文 です ね はい そう です", "\n\n" + PROSE + "\n\n",
         "one two three four five six seven eight nine ten eleven", " ".join(f"w{i % 50}" for i in range(3000)) + "."]


def test_base_counts_are_those_of_a_plain_reading(make):
    got = {r["doc_id"]: r for r in quality.judge(make(list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(t), t
        n, _, _, _, rep = counts(t)
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_lines_fail_alone_and_documents_by_what_they_lose(make):
    mostly_menu = "Home | News | About | Contact | Login | Search | Shop | Map | Jobs\n" * 1 + "A short sentence stands here now, and then it ends quickly."
    rows = [(1, PROSE), (2, "Home | News | About\n" + PROSE + "\nAll rights reserved.\nno end of sentence"), (3, mostly_menu),
            (4, "BUY!! NOW!! CHEAP!! OFFER!! TODAY!! ONLY!! HERE!! FOR!! YOU!! AND!! ALL!!"), (5, PROSE + "\nAnother line follows the first one, says something else and ends like it."), (5, PROSE + " It was late.")]
    docs = make(rows)
    got = {(r["doc_id"], r["n_lines"]): r for r in quality.judge(docs).collect()}
    assert got[1, 1]["kept"] and got[2, 4]["clean_text"] == PROSE and got[2, 4]["n_lines_removed"] == 3
    assert not got[3, 2]["kept"] and not got[4, 1]["kept"] and got[5, 2]["kept"]
    cleaned = quality.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    two = [r for r in cleaned.collect() if r["doc_id"] == 2]
    assert (two[0]["text"], two[0]["n_chars"]) == (PROSE, len(PROSE))
    assert quality.judge(make([])).count() == 0 and quality.clean(make([])).count() == 0


def test_long_runs_of_blanks_take_linear_time(make):
    import time

    rows = [(1, "one" + " " * 1_000_000 + "two."), (2, " \t" * 400_000 + PROSE + "\x0b " * 400_000), (3, PROSE + '"' * 300_000 + "x")]
    start = time.time()
    got = {r["doc_id"]: r for r in quality.judge(make(rows)).collect()}
    assert time.time() - start < 30
    assert (got[1]["n_words"], got[1]["n_lines_removed"]) == (2, 0) and got[2]["kept"] and got[2]["n_lines_removed"] == 0 and got[3]["n_lines_removed"] == 1


def test_sentences_end_at_the_end_of_the_line_only(make, tmp_path):
    """Line separators that are no line feed do not end a line; the SQL agrees."""
    import duckdb

    from probelake.llm.sql import SQL

    tails = ["\u2028", "\u0085", "\u2029", "\r", "\u2028x", '"', "\u00a0", " "]
    rows = [(i, PROSE + t) for i, t in enumerate(tails)]
    make(rows).write.parquet(str(tmp_path / "d"))
    got = sorted((r["doc_id"], r["n_lines_removed"], r["kept"]) for r in quality.judge(make(rows)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = con.execute(f"SELECT doc_id, n_lines_removed, kept FROM ({SQL['op3_quality_rules']}) ORDER BY 1").fetchall()
    assert got == want and [r[1] for r in got] == [1, 1, 1, 0, 1, 0, 1, 0]

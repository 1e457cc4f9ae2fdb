import itertools
import unicodedata
from collections import defaultdict

from talus.llm import line_dedup as D

SCHEMA = "doc_id long, text string, rest string, row int, flat string, d1 long"
PASSAGE = ("The first sentence of the passage is here. Then a second one follows it, with some more words. A third sentence makes the passage "
           "longer still. Nobody would write these sentences twice by chance. And the last one ends the whole passage now.")


def words_in(t):
    """Words, and half a word for every character of a script without spaces."""
    return len(t.split()) + sum(unicodedata.name(c, "").startswith(("CJK UNIFIED", "HIRAGANA", "KATAKANA", "THAI")) for c in t) // 2


def lines_of(t):
    """Units of every line."""
    line = []
    for s, e in D.units(t):
        line.append((s, e))
        if "\n" in t[s:e]:
            yield line
            line = []
    if line:
        yield line


def plain(docs):
    """Spans by the definition, over dictionaries of all units and lines: a run of repeated units of 20
    words goes, and a repeated line of 12. docs: (doc_id, text)."""
    first = {}
    for doc, t in sorted((d for d in docs if d[0] is not None and d[1]), key=lambda x: x[0]):
        for line in lines_of(t):
            for s, e in [*line, (line[0][0], line[-1][1])]:
                first.setdefault(D.digest(t[s:e]), doc)
    out = defaultdict(list)
    for doc, t in docs:
        if t is None:
            out[doc, t].append((None, []))
            continue
        gone, removed, seen = [], set(), set()
        for line in lines_of(t):
            for s, e in line:
                d = D.digest(t[s:e])
                again = d is not None and (d in seen or (doc is not None and first[d] < doc))
                gone.append((s, e, again or d is None and bool(gone) and gone[-1][2]))
                seen.add(d)
            whole = t[line[0][0] : line[-1][1]]
            d = D.digest(whole)
            if words_in(whole) >= 12 and (gone[-1][2] if len(line) == 1 else d in seen or (doc is not None and first[d] < doc)):
                removed |= set(range(line[0][0], line[-1][1]))
            seen.add(d)
        for repeated, run in itertools.groupby(gone, key=lambda x: x[2]):
            run = list(run)
            if repeated and words_in(t[run[0][0] : run[-1][1]]) >= 20:
                removed |= set(range(run[0][0], run[-1][1]))
        spans = []
        for i in sorted(removed):
            if spans and spans[-1][1] == i:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i, i + 1))
        out[doc, t].append(("".join(c for i, c in enumerate(t) if i not in removed), spans))
    return out


def check(rows, docs):
    want = plain(docs)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append((r.text, [tuple(x) for x in r.removed]))
    assert sum(map(len, by_id.values())) == len(docs)
    for (doc, _), results in want.items():
        for x in results:
            assert x in by_id[doc]


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    rows = D.remove_repeats(df).collect()
    check(rows, docs)
    assert any(r.changed for r in rows) and all(r.n_removed == len(r.removed) and r.chars_removed == sum(x.end - x.start for x in r.removed) for r in rows)


def test_passage_inside_lines_and_clean_text(spark):
    docs = [(1, f"Some words before it {PASSAGE} some words after it."), (2, f"Other text starts this one\nand goes on {PASSAGE} until here."),
            (3, "Clean text. It says. The. Then a second thing."), (4, PASSAGE), (5, "Clean text. It says. The end.")]
    rows = {r.doc_id: r for r in D.remove_repeats(spark.createDataFrame([(d, t, "", 0, "", 0) for d, t in docs], SCHEMA)).collect()}
    assert not rows[1].changed and not rows[3].changed and not rows[5].changed
    assert "Nobody would write" not in rows[2].text and rows[2].text.startswith("Other text starts this one\nand goes on") and rows[2].text.endswith("until here.")
    assert len(rows[4].text) < len(PASSAGE) / 3
    check(rows.values(), docs)


def test_short_lines_and_scripts_without_spaces(spark):
    line = "Twelve words make a line that is. Short enough to be no passage."
    chinese = "".join(chr(0x4E00 + i * 7 % 5000) + ("。" if i % 24 == 23 else "") for i in range(500))
    docs = [(1, f"First of all.\n{line}\nMore text here."), (2, f"Another beginning.\n{line}\nIt ends in another way."), (3, chinese), (4, f"別的開頭在此。{chinese}"),
            (5, f"It stands inside. {line} And it goes on."), (6, f"A\n{line}\n{line}"), (7, "One short line.\nB"), (8, "One short line.\nC"), (9, f"{line}\n\n \nEnd of it.")]
    rows = {r.doc_id: r for r in D.remove_repeats(spark.createDataFrame([(d, t, "", 0, "", 0) for d, t in docs], SCHEMA)).collect()}
    assert not any(rows[i].changed for i in (1, 3, 5, 7, 8))
    assert rows[2].text == "Another beginning.\nIt ends in another way." and rows[6].text == "A\n" and rows[9].text == "End of it." and len(rows[4].text) < 30
    check(rows.values(), docs)


def test_nulls_repeats_inside_ties_empty(spark):
    docs = [(1, None), (2, ""), (3, f"{PASSAGE}\n{PASSAGE}\n"), (9, PASSAGE), (9, PASSAGE), (None, PASSAGE), (7, " \n \n"), (8, "word " * 30_000)]
    rows = D.remove_repeats(spark.createDataFrame([(d, t, "", 0, "", 0) for d, t in docs], SCHEMA).repartition(3)).collect()
    check(rows, docs)
    assert [r.text for r in rows if r.doc_id == 3] == [f"{PASSAGE}\n"] and [r.text for r in rows if r.doc_id is None] == [PASSAGE]
    empty = spark.createDataFrame([], SCHEMA)
    assert D.remove_repeats(empty).count() == 0 and D.strip_repeats(empty).columns == empty.columns


def test_strip_keeps_the_other_columns(spark):
    df = spark.createDataFrame([(1, PASSAGE, "a", 1, "b", 5), (2, PASSAGE, "c", 2, None, 6)], SCHEMA)
    rows = {r.doc_id: r for r in D.strip_repeats(df).collect()}
    assert rows[1].text == PASSAGE and rows[2].text == "" and (rows[2].rest, rows[2].row, rows[2].flat, rows[2].d1) == ("c", 2, None, 6)


def test_units_cover_the_text():
    for t in [PASSAGE, "a. b. c d e. f", "\n\nx\n \ny", "", "No end", "One two three! Four five six? Seven"]:
        u = D.units(t)
        assert "".join(t[s:e] for s, e in u) == t

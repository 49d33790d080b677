"""Line rules against a plain reading of the contract."""

import re
from collections import Counter

import pytest

from episodica.llm import line_rules

from .helpers import docs, rows_of

PROSE = "The reading of the tables took the whole of a long day. Nobody had asked for it before, and nobody did after."


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked), failed)


CASES = [
    None, "", " \n\t", "One.", PROSE, PROSE + "\n" + PROSE, "a b c d e f a b c d e", "é ü ß — « x » \x0b y\x0cz " * 2, "x " * 50,
    "# * $ % & | < > " + PROSE, "a\nb\na\n a\nb\n\n\n" + PROSE, "w" * 100_000 + " " + PROSE, "\n".join(f"{PROSE} {i}." for i in range(400)),
    " wide spaces are letters here \x1c and so is this one, is it not so now?",
]


def test_base_features(spark):
    got = {r["doc_id"]: r for r in rows_of(line_rules.clean_lines(docs(spark, [(i, t, "s") for i, t in enumerate(CASES)])))}
    for i, text in enumerate(CASES):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(text), text


@pytest.mark.parametrize(
    "line,why",
    [
        (PROSE, None), ('He said: "It is done."', None), ("No mark at the end of this line", "punctuation"), ("Twice. It goes on without one", None),
        ("REALLY!!! NOW!!! YES!!!", "punctuation"), ("Home | News | About us | Contact.", "navigation"), ("Login Register Help", "navigation"),
        ("This site needs a Cookie to work.", "boilerplate"), ("Tous droits réservés.", "boilerplate"), ("你好，世界。", None),
    ],
)
def test_reasons(line, why):
    raw = line.encode()
    phrases = [p for p in line_rules._PHRASES if p in raw.translate(line_rules._LOWER)]
    assert line_rules.reason(raw, line_rules._chars(raw), phrases) == why


def test_lines_go_before_documents(spark):
    menu = "Home | News | About | Contact | Help"
    rows = [(0, f"{menu}\n{PROSE}\n\nRead more here.", "s"), (1, "\n".join([f"{menu} | {i}" for i in range(9)] + [PROSE]), "s"), (2, PROSE, "s"), (2, PROSE, "s")]
    got = sorted(rows_of(line_rules.clean_lines(docs(spark, rows))), key=lambda r: r["doc_id"])
    assert [r["kept"] for r in got] == [True, False, True, True]
    assert got[0]["clean_text"] == PROSE and got[0]["lost_navigation"] == len(menu.replace(" ", "")) and got[0]["lost_boilerplate"] == 13
    assert all(r["lost_chars"] == r["lost_boilerplate"] + r["lost_navigation"] + r["lost_punctuation"] for r in got)


def test_odd_tables(spark):
    odd = docs(spark, [(None, PROSE, "s", 7)], ", n_words int").toDF("doc_id", "text", "source", "n_words")
    assert [(r["doc_id"], r["n_words"]) for r in rows_of(line_rules.clean_lines(odd))] == [(None, 22)]
    assert rows_of(line_rules.clean_lines(docs(spark, []))) == []


def test_labels_agree(spark):
    """Nearly all documents labelled good stay, nearly none labelled bad."""
    dir_ = "/root/testdata/sf0.01"
    judged = line_rules.op12_line_rules(spark, dir_).join(spark.read.parquet(f"{dir_}/labels.parquet"), "doc_id").where("n_words >= 10")
    rates = {r["quality"]: r["rate"] for r in judged.selectExpr("quality", "cast(kept as int) as k").groupBy("quality").avg("k").withColumnRenamed("avg(k)", "rate").collect()}
    assert rates[1] > 0.97 and rates[0] < 0.03

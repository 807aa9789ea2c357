"""Every program of the command line, end to end on small files."""

from __future__ import annotations

from pathlib import Path

import pytest

from stoneloom.__main__ import PROGRAMS, main

DUMP = "".join(
    f'<page><title>{t}</title><ns>0</ns><id>{i}</id><text xml:space="preserve">{x}</text></page>\n'
    for i, t, x in [(1, "A", "see [[B]] and [[C]]"), (2, "B", "#REDIRECT [[A]]"), (3, "C", "back to [[a]]")]
)
FILES = {
    "text": "a b c\nA b\n",
    "log": "k 1 k 4\n",
    "weighted": "1 0 2 5 3 1\n2 -1 3 1\n3 -1\n",
    "graph": "1 1.0 2 3\n2 1.0 3\n3 1.0\n",
    "names": "a b\nb a\n",
    "points": "0 0 x\n0 1\n9 9\n",
    "dump.xml": f"<w>{DUMP}</w>",
    "titles.txt": "a\t1\nc\t3\n",
    "ids": "3\n",
    "towns": "1 2 New York City USA\n1 2 Paris FR\n",
}
CALLS = [
    ("wordcount", "alnum", "text", "OUT", "3"),
    ("logmean", "log", "OUT"),
    *[("cooccurrence", form, "text", "OUT") for form in ("pairs", "stripes", "relative", "absolute")],
    ("pagerank-step", "weighted", "OUT"),
    ("pagerank", "graph", "OUT", "3", "2"),
    ("pagerank-vertex", "graph", "OUT", "2"),
    ("pagerank-simple", "names", "OUT", "3"),
    ("bfs", "weighted", "OUT", "5"),
    ("kmeans", "points", "OUT", "2", "3"),
    ("titles", "dump.xml", "OUT"),
    ("links", "dump.xml", "OUT", "titles.txt"),
    ("separate", "dump.xml", "OUT"),
    ("find", "dump.xml", "OUT", "ids"),
    ("redirects", "dump.xml", "OUT"),
    ("linkcount", "graph", "OUT", "2"),
    ("cities", "towns", "OUT", "oneFile"),
    ("cities", "towns", "OUT"),
    ("dump", "dump.xml", "OUT", "en"),
]


def lines(path: Path) -> list[str]:
    return sorted(x for p in path.glob("part-*") for x in p.read_text().splitlines())


@pytest.fixture
def files(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    return tmp_path


@pytest.mark.parametrize("call", CALLS, ids=lambda c: "-".join(c[:2]))
def test_program(spark, files, call):
    args = [str(files / a) if a in FILES or a == "OUT" else a for a in call]
    assert main(args, spark) == 0
    assert any((files / "OUT").rglob("part-*"))


def test_results(spark, files):
    out = files / "OUT"
    for call, want in [
        (("wordcount", "alnum", "text", "OUT"), ["a\t2", "b\t2", "c\t1"]),
        (("logmean", "log", "OUT"), ["k\t2"]),
        (("links", "dump.xml", "OUT", "titles.txt"), ["1\t1.0\t3", "2\t1.0\t1", "3\t1.0\t1"]),
        (("titles", "dump.xml", "OUT"), ["a\t1", "c\t3"]),
        (("bfs", "weighted", "OUT", "5"), ["1\t0", "2\t5", "3\t1"]),
        (("linkcount", "graph", "OUT"), ["2\t1", "3\t2"]),
    ]:
        assert main([str(files / a) if a in FILES or a == "OUT" else a for a in call], spark) == 0
        assert lines(out) == want, call


def test_index_program(spark, files):
    docs = files / "docs"
    spark.createDataFrame([(1, "cat"), (2, "cat sat")], "doc_id long, text string").write.parquet(str(docs))
    assert main(["index", str(docs), str(files / "OUT"), "2"], spark) == 0
    assert spark.read.parquet(str(files / "OUT")).count() == 2


def test_wrong_calls(spark, files):
    assert main([], spark) == main(["nothing"], spark) == main(["bfs"], spark) == 2
    assert {c[0] for c in CALLS} | {"index"} == set(PROGRAMS)

"""The searcher's cursors and the command line, end to end over dump files."""

import pytest
from corpusloom import cli
from corpusloom.operators.postings import build_index
from corpusloom.plans import search
from corpusloom.plans.service import Searcher


def test_searcher(spark):
    docs = spark.createDataFrame([(i, "a b" if i % 3 else "b c a") for i in range(130)], "doc_id long, text string")
    index = build_index(docs)
    s = Searcher(index, docs, kept=2)
    for text in ("a b", "a & b"):
        want = [r["doc_id"] for r in search.search(index, text).orderBy("rank_pos").collect()]
        pages = [s.page(text, n) for n in (1, 0, 2, 3)]
        assert pages == [want[50:100], want[:50], want[100:150], want[150:200]]
    assert s.page("zzz") == [] and s.view("zzz") == []
    assert len(s._cursors) == 2
    s.page("c")
    assert len(s._cursors) == 2
    assert [r["doc_id"] for r in s.view("c")] == s.page("c") and s.view("c")[0]["snippet"] == "... c ..."


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text('<doc id="1" url="u1" title="One">new york is new</doc>\n<doc id="2" url="u2" title="Two">old york</doc>', encoding="utf-8")
    c, i = str(tmp_path / "c"), str(tmp_path / "i")
    cli.main(["clean", c, str(tmp_path / "in")])
    assert "'n_docs': 2, 'n_tokens': 6" in capsys.readouterr().out
    cli.main(["dictionary", str(tmp_path / "d"), c])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "d")).collect()] == ["is", "old", "new", "york"]
    (tmp_path / "lemmas").write_text("new\tnew\nyork\tyork\nold\tnew\n")
    cli.main(["index", i, c, "--lemmas", str(tmp_path / "lemmas")])
    cli.main(["search", i, c, '"new york"'])
    out = capsys.readouterr().out
    assert out.splitlines()[0] in ("1\tOne\tu1", "2\tTwo\tu2") and "Two" in out
    cli.main(["archive", c, "2"])
    assert capsys.readouterr().out.strip() == "old york"
    cli.main(["collocations", c])
    assert "---- chi ----" in capsys.readouterr().out
    cli.main(["paths", str(tmp_path / "p"), str(tmp_path / "in")])
    assert spark.read.text(str(tmp_path / "p")).first()["value"] == f"f {tmp_path}/in"
    with pytest.raises(SystemExit):
        cli.main([])

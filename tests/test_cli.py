import pytest

from lexweave.cli import main


def test_build_and_ask(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/deal.txt").write_text("1. Payment\nThe buyer pays the seller.\n2. Term\nThe term is a year.")
    (tmp_path / "c.yaml").write_text("method: bm25\nk_rerank: 1\n")
    config = ["--config", str(tmp_path / "c.yaml")]
    assert main([*config, "build", str(tmp_path / "in"), str(tmp_path / "index")]) == 0
    assert "stored 2, failed 0" in capsys.readouterr().out
    assert main([*config, "ask", str(tmp_path / "index"), "Who pays the seller?"]) == 0
    out = capsys.readouterr().out
    assert "The buyer pays the seller." in out and "a year" not in out and "Who pays the seller?" in out
    with pytest.raises(SystemExit):
        main(["ask", str(tmp_path / "index"), "  "])

from folioframe.cli import run
from folioframe.sources import paged

PAGES = ["cover", "Contents\nOne .... 1\nTwo .... 2", "One\nbody", "Two\nbody", "end"]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "zoo.md").write_text("# Cats\n\nCats purr.\n\n# Dogs\n\nDogs bark.")
    lib = ["--library", str(tmp_path / "lib")]
    assert run([*lib, "query", "anything"], spark) == 0 and "No embedded chunks" in capsys.readouterr().out
    assert run([*lib, "ingest", str(tmp_path / "zoo.md")], spark) == 0 and capsys.readouterr().out.strip() == "1"
    assert run([*lib, "status"], spark) == 0 and capsys.readouterr().out.split() == ["zoo", "2", "2", "0", "0", "2"]
    assert run([*lib, "query", "bark", "--book", "zoo", "--top-k", "1"], spark) == 0 and "[zoo -- " in capsys.readouterr().out
    assert run([*lib, "query", "bark", "--book", "none"], spark) == 1
    assert run([*lib, "ingest", str(tmp_path / "zoo.docx")], spark) == 1 and ".docx" in capsys.readouterr().err
    assert run([*lib, "section", "1", "1", "0"], spark) == 0 and capsys.readouterr().out.strip() == "Dogs bark."
    assert run([*lib, "delete", "nothing", "--yes"], spark) == 1
    assert run([*lib, "delete", "zoo", "--yes"], spark) == 0


def test_contents_tools(spark, tmp_path, capsys):
    (tmp_path / "b.pdf").write_bytes(b"x")
    pages = list(PAGES)
    paged.set_decoder(lambda content: (pages, [], "Book", None))
    try:
        lib = ["--library", str(tmp_path / "lib")]
        assert run([*lib, "dump-toc", str(tmp_path / "b.pdf")], spark) == 0 and "One .... 1" in capsys.readouterr().out
        (tmp_path / "e.json").write_text('[["One", 1], ["Two", 2]]')
        assert run([*lib, "resolve-toc", str(tmp_path / "b.pdf"), "--entries", str(tmp_path / "e.json")], spark) == 0
        assert capsys.readouterr().out.splitlines() == ["3-3\tOne", "4-5\tTwo"]
        assert run([*lib, "ingest", str(tmp_path / "b.pdf")], spark) == 0
    finally:
        paged.set_decoder(paged.decode_pdf)

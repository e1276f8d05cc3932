import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_the_subpackage():
    for file in [*ROOT.glob("shelfspark/**/*.py"), *ROOT.glob("checks/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in file.relative_to(ROOT).parts:
            assert "shelfspark.llm" not in file.read_text() and "corpus_pipeline" not in file.read_text(), file


def test_the_rest_works_without_it(tmp_path):
    for part in ("shelfspark", "checks"):
        for file in (ROOT / part).rglob("*.py"):
            if "llm" not in file.parts:
                target = tmp_path / file.relative_to(ROOT)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(file.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    n, *without = said.stdout.split()
    assert int(n) > 70 and without == ["False", "False"], said.stderr


def test_a_memo_is_bounded_and_gives_way():
    from shelfspark.llm.words import Memo, claim

    one, two = Memo(lambda x: x + 1, 4), Memo(str)
    assert [one[i] for i in range(20)] == list(range(1, 21)) and len(one) <= 4
    assert two[5] == "5"
    claim(two)
    assert not one and two == {5: "5"}

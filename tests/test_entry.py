import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract

ROOT = Path(contract.__file__).parent


def test_registers_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["n_name", "facilities"] and rows.count() > 0


def test_the_engine_stands_alone(tmp_path):
    """Without the training-data subpackage the registers still can be read, and nothing else imports it."""
    (tmp_path / "meridian").mkdir()
    for p in (ROOT / "meridian").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "meridian" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(sorted(e.queries())[0], any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and out.stdout.split()[1] == "False", out.stderr
    for p in (ROOT / "meridian").rglob("*.py"):
        if "llm" not in p.parts:
            assert "meridian.llm" not in p.read_text()

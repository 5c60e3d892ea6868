"""Nothing but the entry point and the pipeline knows the subpackage for training data."""

from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_no_import_of_the_optional_subpackage():
    own = [p for p in (ROOT / "sprachwerk").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert own
    assert [p for p in own if "sprachwerk.llm" in p.read_text()] == []

from collections import Counter
from pathlib import Path


def test_modules_have_names_of_their_own():
    """pytest imports test modules by their base names: of two equal ones the second is not collected."""
    names = Counter(p.name for p in Path(__file__).parent.rglob("test_*.py"))
    assert [n for n, times in names.items() if times > 1] == []

"""Nothing outside the subpackage imports it."""

from __future__ import annotations

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_llm():
    for p in (ROOT / "tessella").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "tessella").parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p

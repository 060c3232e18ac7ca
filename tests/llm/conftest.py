import pytest

pytest.importorskip("sparkfolio.llm.queries")

import pytest

pytest.importorskip("chronopanel.llm.queries")

import pytest

pytest.importorskip("docquality.llm")

import pytest

pytest.importorskip("loamgrid.llm")

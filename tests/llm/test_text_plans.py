"""What the plans of the queries on text must and must not have."""

import re
from pathlib import Path

import pytest

from ledgerloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="the test tables aren't here")


def below(text, node):
    """The lines of the plan under the last node of a name."""
    lines = text.split("\n")
    at = max(i for i, line in enumerate(lines) if node in line)
    depth = lines[at].index(node)
    end = next((i for i in range(at + 1, len(lines)) if len(lines[i]) - len(lines[i].lstrip(" :+-")) <= depth), len(lines))
    return "\n".join(lines[at:end])


@pytest.mark.parametrize("name", ["p8_found", "p9_found", "p9_pieces"])
def test_documents_are_read_narrow_and_not_shuffled_as_text(spark, name):
    text = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert all("text_tgt" not in schema and "source" not in schema for schema in re.findall(r"ReadSchema: (\S+)", text))
    assert "FileScan" in below(text, "MapInArrow") and "Exchange" not in below(text, "MapInArrow"), "nothing moves below the search or the cutting"
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_size_and_length_are_tested_before_python(spark):
    text = QUERIES["p9_found"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert text.index("MapInArrow") < text.index("regexp_count") if "regexp_count" in text else "regexp_extract_all" in text

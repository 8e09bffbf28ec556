"""What the operators broadcast by hint or bring to the driver is of bounded size."""

from pathlib import Path

import truegauge.llm

FOLDER = Path(truegauge.llm.__file__).parent
#: Module -> why its hinted sides and driver tables are bounded.
BOUNDED = {
    "mixing.py": "a period of the schedule and the share of each source, both by the number of sources",
    "toxicity.py": "a sample of labelled rows of documented size",
    "simhash.py": "the sample of the top tree",
    "lm.py": "counts by context bucket and probability step",
}


def test_hints_and_driver_tables_are_the_known_ones():
    found = {p.name for p in FOLDER.glob("*.py") if "F.broadcast(" in p.read_text() or "toPandas" in p.read_text()}
    assert found == set(BOUNDED)


def test_no_local_checkpoint_and_no_cross_join():
    for p in FOLDER.glob("*.py"):
        text = p.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, p.name

import re
from pathlib import Path

from keelson.plans import catalog


def test_what_is_not_built_is_named_by_no_query():
    text = (Path(__file__).resolve().parents[1] / "README.md").read_text()
    named = {i for ids in catalog.COVERS.values() for i in ids}
    count, listed = re.search(r"512 rows, (\d+) are named", text)[1], re.search(r"nothing of their own: ([^.]*)\.", text)[1].split()
    absent = {f"{a[0]}{k:02}" for a, _, b in (x.partition("-") for x in listed) for k in range(int(a[1:]), int((b or a)[1:]) + 1)}
    assert int(count) == len(named) and not absent & named
    assert "V20" in absent and len(absent) == int(re.search(r"These (\d+) have nothing", text)[1])
